"""Extensions by kind and string id, as options name them."""

from __future__ import annotations

from collections.abc import Callable

from . import comparators, merges, prefixes


def create(kind: str, name: str) -> Callable:
    """A merge operator, comparator or key transform by its id: ``create("merge", "uint64add")``, ``create("prefix", "fixed:4")``."""
    makers: dict[str, Callable[[str], Callable]] = {"merge": merges.get, "comparator": comparators.get, "prefix": prefixes.from_string}
    if kind not in makers:
        raise ValueError(f"there are no extensions of the kind {kind!r}")
    return makers[kind](name)
