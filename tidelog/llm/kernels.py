"""Array kernels over UTF-8 text.

A batch of documents is one byte buffer with offsets, straight from Arrow. Words,
hashes and per-document sums are numpy passes over that buffer, with no Python
string per document or word. Null texts count as empty ones.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa

U64 = np.uint64
#: The white space that the contracts name: space and 0x09-0x0D.
SPACE = np.isin(np.arange(256), [0x20, 9, 10, 11, 12, 13])
#: ASCII upper case to lower case; other bytes stay.
LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32
#: Bytes of letters and digits; those of non-ASCII characters count as letters.
WORDLIKE = np.zeros(256, bool)
WORDLIKE[48:58] = WORDLIKE[65:91] = WORDLIKE[97:123] = WORDLIKE[128:] = True

_BASE = 0x9E3779B97F4A7C15 | 1
_BYTE = np.random.default_rng(20240607).integers(1, 2**63, 256, dtype=np.int64).astype(U64) | U64(1)
_OTHER_BYTE = np.random.default_rng(20240613).integers(1, 2**63, 256, dtype=np.int64).astype(U64) | U64(1)


class Texts:
    """``data`` holds the bytes of all texts; text i is ``data[starts[i]:starts[i + 1]]``."""

    __slots__ = ("data", "starts")

    def __init__(self, data: np.ndarray, starts: np.ndarray):
        self.data, self.starts = data, starts

    def __len__(self) -> int:
        return len(self.starts) - 1

    def part(self, a: int, b: int) -> Texts:
        s = self.starts[a : b + 1]
        return Texts(self.data[s[0] : s[-1]], s - s[0])


def texts(column: pa.Array | pa.ChunkedArray) -> Texts:
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    column = column.fill_null("" if not pa.types.is_binary(column.type) else b"")
    wide = pa.types.is_large_string(column.type) or pa.types.is_large_binary(column.type)
    _, offsets, data = column.buffers()
    if not len(column):
        return Texts(np.zeros(0, np.uint8), np.zeros(1, np.int64))
    starts = np.frombuffer(offsets, np.int64 if wide else np.int32)[column.offset : column.offset + len(column) + 1].astype(np.int64)
    whole = np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8)
    return Texts(whole[starts[0] : starts[-1]], starts - starts[0])


def slices(t: Texts, most: int = 1 << 20, texts_most: int = 2048) -> Iterator[tuple[int, int]]:
    """Ranges of texts of at most ``most`` bytes and ``texts_most`` texts each; a longer text makes a range alone."""
    a = 0
    while a < len(t):
        b = max(a + 1, int(np.searchsorted(t.starts, t.starts[a] + most, "right")) - 1)
        b = min(b, a + texts_most)
        yield a, b
        a = b


def words(t: Texts, inside: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Starts and ends of words, and the first word of each text (with one more entry).

    ``inside`` says which bytes belong to words; by default those that aren't space.
    """
    word = (~SPACE if inside is None else inside)[t.data]
    edge = np.zeros(len(t.data) + 1, bool)
    edge[t.starts] = True
    begin, end = word.copy(), word.copy()
    begin[1:] &= ~word[:-1] | edge[1:-1]
    end[:-1] &= ~word[1:] | edge[1:-1]
    ws, we = np.flatnonzero(begin), np.flatnonzero(end) + 1
    return ws, we, np.searchsorted(ws, t.starts)


def owner(first: np.ndarray) -> np.ndarray:
    """The text of each item, from the first item of each text."""
    return np.repeat(np.arange(len(first) - 1), np.diff(first))


@lru_cache(maxsize=2)
def _powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    inverse = pow(_BASE, -1, 1 << 64)
    out = []
    for base in (_BASE, inverse):
        p = np.full(n, U64(base))
        p[0] = 1
        out.append(np.cumprod(p, dtype=U64))
    return out[0], out[1]


class Hasher:
    """64-bit hashes of any spans of a buffer, each in constant time. ``other``: those of another function."""

    def __init__(self, data: np.ndarray, other: bool = False):
        n = 1 << max(18, int(len(data) + 1).bit_length())
        power, self._inverse = _powers(n)
        self._sums = np.zeros(len(data) + 1, U64)
        np.cumsum((_OTHER_BYTE if other else _BYTE)[data] * power[: len(data)], out=self._sums[1:])

    def spans(self, s: np.ndarray, e: np.ndarray) -> np.ndarray:
        return mix((self._sums[e] - self._sums[s]) * self._inverse[s])


def mix(x: np.ndarray) -> np.ndarray:
    """A bijection that spreads all bits."""
    x = (x ^ (x >> U64(32))) * U64(0xD6E8FEB86659FD93)
    x = (x ^ (x >> U64(29))) * U64(0xC2B2AE3D27D4EB4F)
    return x ^ (x >> U64(32))


def grams(h: np.ndarray, first: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of n successive items that lie in one text; the index of each one's first item."""
    if len(h) < n:
        return np.zeros(0, U64), np.zeros(0, np.int64)
    g = h[: len(h) - n + 1].copy()
    for k in range(1, n):
        g = mix(g * U64(0x9FB21C651E98DF25) + h[k : len(h) - n + 1 + k])
    last = np.repeat(first[1:], np.diff(first))[: len(g)]
    at = np.flatnonzero(np.arange(len(g)) + n <= last)
    return g[at], at


def per_text(values: np.ndarray, first: np.ndarray) -> np.ndarray:
    """Sums of values by text."""
    sums = np.zeros(len(values) + 1, np.int64 if values.dtype.kind in "bui" else np.float64)
    np.cumsum(values, out=sums[1:])
    return sums[first[1:]] - sums[first[:-1]]


def distinct(h: np.ndarray, doc: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Each text's distinct hashes, sorted within the text."""
    order = np.lexsort((h, doc))
    h, doc = h[order], doc[order]
    new = np.ones(len(h), bool)
    new[1:] = (h[1:] != h[:-1]) | (doc[1:] != doc[:-1])
    return h[new], doc[new]


def code_points(data: np.ndarray) -> np.ndarray:
    """Whether each byte begins a character."""
    return (data & 0xC0) != 0x80
