"""Operators for preparing language-model training data.

Nothing outside this subpackage imports it. Every operator takes DataFrames and
returns DataFrames; :mod:`tidelog.llm.queries` binds them to the driver tables.
"""
