"""Versioned key-value state on Spark: an append-only log of operations, and plans that answer from it."""
