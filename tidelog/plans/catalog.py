"""All registered queries."""

from __future__ import annotations

from . import changes, extensions, measuring, merging, more, reads, rewriting, streams, tables  # noqa: F401
from .registry import QUERIES, SQL

__all__ = ["QUERIES", "SQL"]
