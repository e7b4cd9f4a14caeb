"""Queries over the driver tables: each binds operators to a workload, with the same query in SQL."""
