"""Operators for building training corpora: deduplication, cleaning, mixing, packing and sharding.

Nothing outside this folder imports it; ``__spark_entry__.py`` adds its queries only where it is present.
"""
