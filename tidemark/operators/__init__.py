"""Operators: DataFrame in, DataFrame out, every instant an explicit argument."""
