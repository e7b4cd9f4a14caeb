"""Operators over the operation log: DataFrame in, DataFrame out."""
