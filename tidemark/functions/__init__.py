"""Scalar functions: as Columns where Catalyst has them, else as plain Python for Pandas UDFs."""
