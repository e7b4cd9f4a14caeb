"""Removal of repeated byte strings by a family of sorted suffix indexes.

A byte goes if a string of LENGTH bytes that covers it also starts earlier, in a document of smaller id
or before it in its own. Suffixes matter only up to LENGTH bytes here.

Most suffixes have no equal anywhere and must not be moved. Sync points find the others. Of the
GRAM-byte strings inside a window of LENGTH bytes, the one of least hash is the window's anchor;
equal windows have equal anchors. Windows in a row with one anchor make a block.

1. Blocks are dealt by their anchor's hash. An anchor seen once: none of its windows is repeated.
   A block equal to an earlier one is repeated as a whole. Other blocks of repeated anchors are candidates.
   Each batch of documents first does the same among its own, and sends one row for an anchor at most.
2. Candidates meet their texts. Each batch of texts gets the suffix array of its candidate windows: their places in
   the order of the letters that follow. Neighbours with a common prefix of LENGTH bytes are repeats; the first of each
   is dealt by its fingerprint to the levels.
3. :class:`LevelFamily` is the family in each task: a batch is merge-scanned against each level, and added; levels of
   about equal size merge, so that sizes grow geometrically and each entry is merged a logarithmic number of times.
4. Repeated windows meet the texts once more, and the bytes they cover are removed.

All three exchanges carry packed arrays, one row for each source batch and target partition, so a
very common passage makes no hot partition; the number of partitions follows the bytes.

With an ``index``, a folder, blocks are kept there in levels, too, and a later batch of documents is
held against them: levels are merge-scanned for the batch's anchors, the texts of earlier documents are read only where
some of their blocks are candidates, and levels of about equal size merge.

Fingerprints have 96 bits. Two windows that differ would have to agree in them to be taken for one: among 10**12 windows
the chance of that is under 10**-5.

Defined cases: a null text is an empty one; texts under LENGTH bytes are kept whole; a row with a null id
has no place in the order, so it is kept whole and removes nothing; rows with equal ids are one document,
so none is earlier than the other, and a place that is found repeated in one goes from each; ids that aren't whole
numbers have the order of their values (not with an index); extra columns are not read.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import kernels as K
from .runtime import drop_path, integer_ids, own_ids, read_json, routes, task_count, write_json, written

LENGTH, GRAM = 100, 24
#: Bytes of texts whose blocks are compared in a task before any is sent.
TOGETHER = 32 << 20
#: Bytes of texts whose blocks, windows and marks a task gets.
TASK_BYTES = 64 << 20
#: Bytes of windows that are put in order at once.
ORDERED = 128 << 20


def _firsts(run: np.ndarray, doc: np.ndarray, start: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """For entries sorted by run and place: which come first in their run, and which lie at a later place."""
    new = np.ones(len(run), bool)
    new[1:] = run[1:] != run[:-1]
    first = np.maximum.accumulate(np.where(new, np.arange(len(run)), 0))
    return new, (doc != doc[first]) | (start != start[first])


class LevelFamily:
    """Sorted arrays of (fingerprint, document, start), each fingerprint once, with its earliest place. Fingerprints may be of any type with an order."""

    def __init__(self) -> None:
        self.levels: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []

    def insert(self, f: np.ndarray, doc: np.ndarray, start: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Adds a batch; gives the places now known to be repeated: those that have an equal earlier."""
        order = np.lexsort((start, doc))
        order = order[np.argsort(f[order], kind="stable")]
        f, doc, start = f[order], doc[order], start[order]
        new, after = _firsts(f, doc, start)
        late = [(doc[after], start[after])]
        f, doc, start = f[new], doc[new], start[new]
        for lf, ld, ls in self.levels:  # merge-scan
            at = np.searchsorted(lf, f)
            hit = np.flatnonzero((at < len(lf)) & (lf[np.minimum(at, len(lf) - 1)] == f)) if len(lf) else np.zeros(0, np.int64)
            at = at[hit]
            later = (doc[hit] > ld[at]) | ((doc[hit] == ld[at]) & (start[hit] > ls[at]))
            late.append((doc[hit[later]], start[hit[later]]))
            sooner = (doc[hit] < ld[at]) | ((doc[hit] == ld[at]) & (start[hit] < ls[at]))
            swap, into = hit[sooner], at[sooner]
            late.append((ld[into], ls[into]))
            ld[into], ls[into] = doc[swap], start[swap]
            keep = np.ones(len(f), bool)
            keep[hit] = False
            f, doc, start = f[keep], doc[keep], start[keep]
        level = (f, doc.copy(), start.copy())
        while self.levels and len(self.levels[-1][0]) <= 2 * len(level[0]):
            level = self._merge(self.levels.pop(), level)
        self.levels.append(level)
        return np.concatenate([d for d, _ in late]), np.concatenate([s for _, s in late])

    @staticmethod
    def _merge(a: tuple, b: tuple) -> tuple:
        at = np.searchsorted(a[0], b[0])
        return tuple(np.insert(x, at, y) for x, y in zip(a, b))


def blocks(t: K.Texts, length: int = LENGTH, gram: int = GRAM) -> tuple[np.ndarray, ...]:
    """(key, print, start, count) of each block: hash of the anchor, hash of the block, first window, windows."""
    none = (np.zeros(0, K.U64), np.zeros(0, K.U64), np.zeros(0, np.int64), np.zeros(0, np.int64))
    n = len(t.data)
    if n < length:
        return none
    hasher = K.Hasher(t.data)
    p = np.arange(n - gram + 1)
    v = hasher.spans(p, p + gram)
    place = max(28, n.bit_length())  # low bits hold the position
    v &= K.U64((1 << 64) - (1 << place))
    v |= p.astype(K.U64)  # equal hashes: the leftmost is least
    size, m = 1, v
    while size * 2 <= length - gram + 1:
        m = np.minimum(m[:-size], m[size:])
        size *= 2
    rest = length - gram + 1 - size
    if rest:
        m = np.minimum(m[:-rest], m[rest:])
    # windows that end within their text
    valid = np.ones(n - length + 1, bool)
    ends = t.starts[1:]
    for_bad = np.zeros(n + 2, np.int32)
    a, b = np.maximum(ends - length + 1, t.starts[:-1]), ends
    np.add.at(for_bad, a, 1)
    np.add.at(for_bad, b, -1)
    valid = np.cumsum(for_bad[: n - length + 1]) == 0
    m = (m & K.U64((1 << place) - 1)).astype(np.int64)
    begin, last = valid.copy(), valid.copy()
    differs = m[1:] != m[:-1]
    begin[1:] &= ~valid[:-1] | differs
    last[:-1] &= ~valid[1:] | differs
    s, e = np.flatnonzero(begin), np.flatnonzero(last)
    if not len(s):
        return none
    anchor = m[s]
    return hasher.spans(anchor, anchor + gram), K.mix(hasher.spans(s, e + length) + (e - s).astype(K.U64)), s, e - s + 1


def _pack(*arrays: np.ndarray) -> bytes:
    """Numbers go as planes of their bytes: in rows that are in the order of documents, the upper ones compress to little."""
    return b"".join((a.view(np.uint8).reshape(len(a), -1).T if a.dtype.kind == "i" else a).tobytes() for a in map(np.ascontiguousarray, arrays))


def _unpack(blob: bytes, *kinds: str) -> list[np.ndarray]:
    each = [np.dtype(k).itemsize for k in kinds]
    n, at, out = len(blob) // sum(each), 0, []
    for k, size in zip(kinds, each):
        if k[1] == "i":
            out.append(np.ascontiguousarray(np.frombuffer(blob, np.uint8, n * size, at).reshape(size, n).T).view(k).ravel())
        else:
            out.append(np.frombuffer(blob, k, n, at))
        at += size * n
    return out


def _dealt(where: np.ndarray, to: np.ndarray, kind: int, *arrays: np.ndarray) -> Iterator[tuple]:
    """One packed row for each target: (route, kind, id, blob)."""
    if not len(where):
        return
    order = np.argsort(where, kind="stable")
    cut = np.flatnonzero(np.diff(where[order])) + 1
    for part in np.split(order, cut):
        yield int(to[where[part[0]]]), kind, _pack(*(a[part] for a in arrays))


_ROW = "route bigint, kind int, blob binary"
_SCHEMA = pa.schema([("route", pa.int64()), ("kind", pa.int32()), ("blob", pa.binary())])


def _rows(rows: list[tuple]) -> pa.RecordBatch:
    columns = list(zip(*rows)) if rows else [(), (), ()]
    return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(columns, _SCHEMA)], schema=_SCHEMA)


#: Kinds of rows: blocks for step 1; repeated ranges of windows and candidate blocks, dealt by document; blocks for a level, and those of levels.
_BLOCKS, _REPEATED, _CANDIDATE, _KEPT, _LEVEL = 0, 1, 2, 3, 4
_ENTRY = ("V6", "V6", "<i8", "<i4")


def _count(length: int) -> str:
    """The type of the number of windows in a block."""
    return "u1" if length < 256 else "<i4"


def _short(x: np.ndarray) -> np.ndarray:
    """The upper 48 bits."""
    return (x >> K.U64(16)).view(np.uint8).reshape(-1, 8)[:, :6].copy().view("V6").ravel()


def _places(doc: np.ndarray, parts: int) -> np.ndarray:
    return (K.mix(doc.view(K.U64)) % K.U64(parts)).astype(np.int64)


def _anchor_parts(key: np.ndarray, parts: int) -> np.ndarray:
    return ((key >> K.U64(16)) % K.U64(parts)).astype(np.int64)


def _first_pass(parts: int, to: np.ndarray, length: int, gram: int, keep: bool):
    small = _count(length)

    def sent(got: list[tuple]) -> pa.RecordBatch:
        key, fp, doc, start, n = (np.concatenate(x) for x in zip(*got))
        order = np.lexsort((start, doc, fp, key))
        key, fp, doc, start, n = (x[order] for x in (key, fp, doc, start, n))
        new, copy = _firsts(key ^ K.mix(fp), doc, start)
        rows = list(_dealt(_places(doc[copy], parts), to, _REPEATED, doc[copy], start[copy], n[copy]))
        key, fp, doc, start, n = (x[new] for x in (key, fp, doc, start, n))
        again = np.zeros(len(key), bool)
        again[1:] = key[1:] == key[:-1]
        several = again.copy()
        several[:-1] |= again[1:]
        rows += _dealt(_places(doc[several], parts), to, _CANDIDATE, doc[several], start[several], n[several])
        if keep:
            rows += _dealt(_anchor_parts(key, parts), to, _KEPT, _short(key), _short(fp), doc, start, n)
        n = np.where(several, 0, n).astype(small)  # 0: only tells that the anchor is repeated
        key, fp, doc, start, n = (x[~again] for x in (key, fp, doc, start, n))
        order = np.lexsort((start, doc))
        key, fp, doc, start, n = (x[order] for x in (key, fp, doc, start, n))
        rows += _dealt(_anchor_parts(key, parts), to, _BLOCKS, _short(key), _short(fp), doc, start, n)
        return _rows(rows)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        got, size = [], 0
        for batch in batches:
            ids = batch.column(0).to_numpy()
            t = K.texts(batch.column(1))
            for a, b in K.slices(t):
                part = t.part(a, b)
                key, fp, s, n = blocks(part, length, gram)
                d = np.searchsorted(part.starts, s, "right") - 1
                got.append((key, fp, ids[a:b][d], (s - part.starts[d]).astype(np.int32), n.astype(small)))
                size += len(part.data)
                if size > TOGETHER:
                    yield sent(got)
                    got, size = [], 0
        if got:
            yield sent(got)

    return run


def _long(x: np.ndarray) -> np.ndarray:
    out = np.zeros((len(x), 8), np.uint8)
    out[:, :6] = np.frombuffer(x.tobytes(), np.uint8).reshape(-1, 6)
    return out.view(K.U64).ravel()


def _block_pass(parts: int, to: np.ndarray, length: int):
    small = _count(length)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        got, kept, levels = [], [], []
        for batch in batches:
            kinds = batch.column(1).to_numpy()
            keep = np.flatnonzero((kinds == _REPEATED) | (kinds == _CANDIDATE))
            if len(keep):
                yield batch.take(pa.array(keep))
            for i in np.flatnonzero((kinds != _REPEATED) & (kinds != _CANDIDATE)):
                entries = _unpack(batch.column(2)[int(i)].as_py(), *_ENTRY, small)
                if kinds[i] == _BLOCKS:
                    got.append((_long(entries[0]), _long(entries[1]), *entries[2:]))
                else:
                    (kept if kinds[i] == _KEPT else levels).append(entries)
        if kept:  # the batch's own level, in the order of its anchors
            entries = [np.concatenate(x) for x in zip(*kept)]
            kept.clear()
            order = np.argsort(_long(entries[0]), kind="stable")
            entries = [x[order] for x in entries]
            yield _rows(list(_dealt(_anchor_parts(_long(entries[0]) << K.U64(16), parts), to, _LEVEL, *entries)))
        if not got:
            return
        new = np.sort(np.concatenate([key for key, *_ in got]))
        for entries in levels:  # merge-scan: entries of a level are in the order of their anchors
            key = _long(entries[0])
            at = np.searchsorted(new, key)
            hit = new[np.minimum(at, len(new) - 1)] == key
            got.append((key[hit], _long(entries[1])[hit], *(x[hit] for x in entries[2:])))
        key, fp, doc, start, n = (np.concatenate(x) for x in zip(*got))
        got.clear()
        order = np.argsort(key, kind="stable")
        key = key[order]
        several = np.zeros(len(key), bool)
        several[1:] = key[1:] == key[:-1]
        several[:-1] |= several[1:].copy()
        order = order[several]  # anchors that are seen once are done with
        key, fp, doc, start, n = key[several], fp[order], doc[order], start[order], n[order]
        order = np.lexsort((start, doc, fp, key))
        key, fp, doc, start, n = (x[order] for x in (key, fp, doc, start, n))
        real = n > 0
        opens = np.ones(len(key), bool)
        opens[1:] = key[1:] != key[:-1]
        group = np.cumsum(opens) - 1
        told = np.bincount(group[~real], minlength=group[-1] + 1 if len(group) else 0) > 0
        new = opens.copy()
        new[1:] |= fp[1:] != fp[:-1]
        prints = np.bincount(group[new], minlength=len(told))
        # a flag row holds a block, too, but its batch has made a candidate of it: its print is no copy's first
        run_id = np.cumsum(new) - 1
        first_real = np.full(run_id[-1] + 1 if len(run_id) else 0, len(key))
        np.minimum.at(first_real, run_id[real], np.flatnonzero(real))
        if not len(key):
            return
        at = np.minimum(first_real[run_id], len(key) - 1)
        copy = real & ((doc != doc[at]) | (start != start[at]))
        candidate = real & (np.arange(len(key)) == at) & (told[group] | (prints[group] > 1))
        rows = list(_dealt(_places(doc[copy], parts), to, _REPEATED, doc[copy], start[copy], n[copy]))
        rows += _dealt(_places(doc[candidate], parts), to, _CANDIDATE, doc[candidate], start[candidate], n[candidate])
        yield _rows(rows)

    return run


def _by_document(marks: list[tuple[np.ndarray, ...]]) -> dict[int, tuple[np.ndarray, ...]]:
    if not marks:
        return {}
    doc, *rest = (np.concatenate(x) for x in zip(*marks))
    order = np.argsort(doc, kind="stable")
    doc = doc[order]
    cut = np.concatenate([[0], np.flatnonzero(np.diff(doc)) + 1, [len(doc)]]) if len(doc) else [0]
    rest = [x[order] for x in rest]
    return {int(doc[a]): tuple(x[a:b] for x in rest) for a, b in zip(cut[:-1], cut[1:])}


def suffix_order(data: np.ndarray, at: np.ndarray, length: int) -> tuple[np.ndarray, np.ndarray]:
    """The places ``at`` in the order of the ``length`` bytes that follow, equal ones in the order given; and which begin a run of equal ones."""
    window = np.ascontiguousarray(np.lib.stride_tricks.sliding_window_view(data, length)[at]).view(f"S{length}").ravel()
    order = np.argsort(window, kind="stable")  # all have the same length, so that zeros at their ends make no difference
    window = window[order]
    new = np.ones(len(at), bool)
    new[1:] = window[1:] != window[:-1]
    return order, new


def prints(data: np.ndarray, at: np.ndarray, length: int) -> np.ndarray:
    """96-bit fingerprints of the ``length`` bytes at each place, as strings of 12 bytes."""
    out = np.empty((len(at), 3), ">u4")
    f = K.Hasher(data).spans(at, at + length)
    out[:, 0], out[:, 1] = f >> K.U64(32), f & K.U64(0xFFFFFFFF)
    out[:, 2] = K.Hasher(data, other=True).spans(at, at + length) >> K.U64(32)
    return out.view("S12").ravel()


def _first_parts(f: np.ndarray, parts: int) -> np.ndarray:
    return f.view(">u4").reshape(-1, 3)[:, 2].astype(np.int64) % parts


def _window_pass(parts: int, to: np.ndarray, length: int):
    """Rows sorted by kind: marks come first, then texts, whose candidate windows are put in order and dealt."""
    small = _count(length)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        marks: list[tuple] = []
        found: dict | None = None
        for batch in batches:
            kinds = batch.column(1).to_numpy()
            for i in np.flatnonzero(kinds == _CANDIDATE):
                marks.append(tuple(_unpack(batch.column(2)[int(i)].as_py(), "<i8", "<i4", small)))
            texts = np.flatnonzero(kinds == _TEXT)
            if not len(texts):
                continue
            if found is None:
                found = _by_document(marks)
                marks.clear()
            ids = batch.column(3).fill_null(-1).to_numpy()
            texts = texts[[int(ids[i]) in found for i in texts]] if found else texts[:0]
            if not len(texts):
                continue
            t = K.texts(batch.column(2).take(pa.array(texts)))
            ids = ids[texts].astype(np.int64)
            for a, b in K.slices(t):
                part = t.part(a, b)
                size = [len(found[int(d)][0]) for d in ids[a:b]]
                base = np.repeat(part.starts[:-1], size)
                doc = np.repeat(ids[a:b], size)
                start = np.concatenate([found[int(d)][0] for d in ids[a:b]]).astype(np.int64)
                n = np.concatenate([found[int(d)][1] for d in ids[a:b]]).astype(np.int64)
                step = np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)
                end = np.repeat(np.repeat(part.starts[1:], size), n)
                base, doc, start = np.repeat(base, n), np.repeat(doc, n), np.repeat(start, n) + step
                inside = base + start + length <= end  # rows with equal ids can differ in size
                base, doc, start = base[inside], doc[inside], start[inside]
                order = np.lexsort((start, doc))
                base, doc, start = base[order], doc[order], start[order].astype(np.int32)
                rows = []
                for s in range(0, len(doc), max(1, ORDERED // length)):
                    at, d, w = (base + start)[s : s + ORDERED // length], doc[s : s + ORDERED // length], start[s : s + ORDERED // length]
                    order, new = suffix_order(part.data, at, length)
                    run_id = np.cumsum(new) - 1
                    head = np.flatnonzero(new)[run_id]
                    again = (d[order] != d[order][head]) | (w[order] != w[order][head])
                    rows += _dealt(_places(d[order][again], parts), to, _REPEATED, d[order][again], w[order][again], np.ones(again.sum(), small))
                    order = np.sort(order[new])  # by document again
                    f = prints(part.data, at[order], length)
                    rows += _dealt(_first_parts(f, parts), to, _BLOCKS, f, d[order], w[order])
                yield _rows(rows)

    return run


_TEXT = 9


def _family_pass(parts: int, to: np.ndarray, length: int):
    small = _count(length)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        family = LevelFamily()
        rows: list[tuple] = []
        for batch in batches:
            kinds = batch.column(1).to_numpy()
            keep = np.flatnonzero(kinds != _BLOCKS)
            if len(keep):
                yield batch.take(pa.array(keep))
            got = [_unpack(batch.column(2)[int(i)].as_py(), "S12", "<i8", "<i4") for i in np.flatnonzero(kinds == _BLOCKS)]
            if got:
                doc, start = family.insert(*(np.concatenate(x) for x in zip(*got)))
                rows += _dealt(_places(doc, parts), to, _REPEATED, doc, start, np.ones(len(doc), small))
            if len(rows) > 2000:
                yield _rows(rows)
                rows = []
        yield _rows(rows)

    return run


def _removal_pass(length: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        marks: list[tuple] = []
        found: dict | None = None
        for batch in batches:
            kinds = batch.column(1).to_numpy()
            for i in np.flatnonzero(kinds == _REPEATED):
                marks.append(tuple(_unpack(batch.column(2)[int(i)].as_py(), "<i8", "<i4", _count(length))))
            texts = np.flatnonzero(kinds == _TEXT)
            if not len(texts):
                continue
            if found is None:
                found = _by_document(marks)
                marks.clear()
            ids = batch.column(3)
            rows = []
            for i in texts:
                raw = batch.column(2)[int(i)].as_py()
                doc = ids[int(i)].as_py()  # null: has no marks
                size, removed, spans, kept = len(raw), 0, 0, raw
                if doc in found:
                    start, n = found[doc]
                    edge = np.zeros(size + 1, np.int64)
                    np.add.at(edge, np.minimum(start, size), 1)
                    np.add.at(edge, np.minimum(start.astype(np.int64) + n - 1 + length, size), -1)
                    gone = np.cumsum(edge[:-1]) > 0
                    removed = int(gone.sum())
                    spans = int(np.diff(gone.astype(np.int8), prepend=0).clip(0).sum())
                    kept = np.frombuffer(raw, np.uint8)[~gone].tobytes()
                rows.append((doc, size, removed, spans, hashlib.sha256(kept).hexdigest(), kept))
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows), (pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.string(), pa.binary()))], names=["id", "n_bytes", "n_removed", "n_spans", "kept_sha256", "kept"])

    return run


def _merged(batches: Iterator[pa.RecordBatch], parts: int, to: np.ndarray, small: str) -> Iterator[pa.RecordBatch]:
    """Rows of levels, those of a partition together in the order of their anchors."""
    level: list[np.ndarray] | None = None
    for batch in batches:
        for blob in batch.column(2):
            entries = _unpack(blob.as_py(), *_ENTRY, small)
            if level is not None:
                at = np.searchsorted(_long(level[0]), _long(entries[0]))
                entries = [np.insert(x, at, y) for x, y in zip(level, entries)]
            level = entries
    if level is not None:
        yield _rows(list(_dealt(_anchor_parts(_long(level[0]) << K.U64(16), parts), to, _LEVEL, *level)))


class StoredLevels:
    """The levels of an index in a folder: tables of blocks by anchor, and a manifest that names them."""

    def __init__(self, spark: SparkSession, path: str, length: int, gram: int):
        self.spark, self.path = spark, path.rstrip("/")
        self.state = read_json(spark, f"{self.path}/MANIFEST") or {"length": length, "gram": gram, "parts": 0, "top": None, "batches": 0, "levels": []}
        if (self.state["length"], self.state["gram"]) != (length, gram):
            raise ValueError("the index was made with another length")

    def rows(self, names: list[str] | None = None) -> DataFrame:
        return self.spark.read.schema(_ROW).parquet(*(f"{self.path}/{n}" for n in names or [n for n, _ in self.state["levels"]]))

    def add(self, rows: DataFrame, parts: int, to: np.ndarray, top: int | None) -> None:
        """A batch's level is written, levels of about equal size merge, and then the manifest names the new ones."""
        small = _count(self.state["length"])
        width = sum(np.dtype(k).itemsize for k in (*_ENTRY, small))
        self.state["batches"] += 1
        name = f"level-{self.state['batches']}"
        rows.write.mode("overwrite").parquet(f"{self.path}/{name}")
        size = (self.rows([name]).agg(F.sum(F.octet_length("blob"))).first()[0] or 0) // width
        levels, gone = self.state["levels"], []
        while levels and levels[-1][1] <= 2 * size:
            other, n = levels.pop()
            gone += [name, other]
            both = self.rows([name, other]).repartition(parts, "route").mapInArrow(lambda batches: _merged(batches, parts, to, small), _ROW)
            name += f"-{other.split('-')[1]}"
            both.write.mode("overwrite").parquet(f"{self.path}/{name}")
            size += n
        self.state |= {"parts": parts, "top": top if self.state["top"] is None or (top is not None and top > self.state["top"]) else self.state["top"], "levels": [*levels, [name, size]]}
        write_json(self.spark, f"{self.path}/MANIFEST", self.state)
        for other in gone:
            drop_path(self.spark, f"{self.path}/{other}")


def remove_repeats(docs: DataFrame, id_column: str = "doc_id", text_column: str = "text", length: int = LENGTH, gram: int = GRAM, keep_bytes: bool = True, index: str | None = None, earlier: DataFrame | None = None) -> DataFrame:
    """(id, n_bytes, n_removed, n_spans, kept_sha256, and ``kept`` binary if asked for).

    ``index``: a folder in which blocks are kept for later batches. ``earlier`` then has the documents of the batches before, whose ids
    must all be smaller; only those are read that share an anchor with the new ones.
    """
    spark = docs.sparkSession
    docs, own = integer_ids(docs, id_column)
    blob = F.coalesce(F.col(text_column).cast("binary"), F.lit(b"")).alias("blob")
    texts = docs.select(F.col(id_column).alias("id"), blob)
    size, least, top = texts.agg(F.sum(F.octet_length("blob")), F.min("id"), F.max("id")).first()
    stored = None
    if index:
        if own is not None:
            raise ValueError("documents of an index need whole numbers for ids")
        stored = StoredLevels(spark, index, length, gram)
        if stored.state["top"] is not None and least is not None and least <= stored.state["top"]:
            raise ValueError(f"ids of a new batch must be greater than {stored.state['top']}")
    # an index keeps its partitions, so that rows of its levels lie where they are looked for
    parts = (stored.state["parts"] if stored else 0) or task_count(spark, size or 0, TASK_BYTES)
    to = routes(spark, parts)

    def placed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            where = _places(batch.column(0).fill_null(0).to_numpy(), parts)
            yield pa.RecordBatch.from_arrays([pa.array(to[where]), pa.array(np.full(batch.num_rows, _TEXT, np.int32)), batch.column(1), batch.column(0)], names=["route", "kind", "blob", "id"])

    def meet(some: DataFrame, marks: DataFrame) -> DataFrame:
        rows = some.mapInArrow(placed, _ROW + ", id bigint").unionByName(marks.withColumn("id", F.lit(None).cast("bigint")))
        return rows.repartition(parts, "route").sortWithinPartitions("kind")

    blocks_ = texts.where("id IS NOT NULL").mapInArrow(_first_pass(parts, to, length, gram, stored is not None), _ROW)
    if stored and stored.state["levels"]:
        blocks_ = blocks_.unionByName(stored.rows())
    marks = written(blocks_.repartition(parts, "route").mapInArrow(_block_pass(parts, to, length), _ROW), "blocks")
    candidates = marks.where(F.col("kind") == _CANDIDATE)
    read = texts
    if stored and stored.state["levels"]:
        if earlier is None:
            raise ValueError("the documents of the batches before are needed")

        def old(batches: Iterator[pa.RecordBatch], top=stored.state["top"]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                for x in batch.column(2):
                    doc = np.unique(_unpack(x.as_py(), "<i8", "<i4", _count(length))[0])
                    yield pa.RecordBatch.from_arrays([pa.array(doc[doc <= top])], names=["id"])

        needed = written(candidates.mapInArrow(old, "id bigint").distinct(), "needed")
        before = earlier.select(F.col(id_column).cast("bigint").alias("id"), blob)
        read = texts.unionByName(before.join(needed.hint("shuffle_merge"), "id", "left_semi"))
    windows = meet(read, candidates).mapInArrow(_window_pass(parts, to, length), _ROW)
    repeated = written(windows.repartition(parts, "route").mapInArrow(_family_pass(parts, to, length), _ROW), "repeated")
    if stored:
        stored.add(marks.where(F.col("kind") == _LEVEL), parts, to, top)
    out = meet(texts, repeated.unionByName(marks.where(F.col("kind") == _REPEATED))).mapInArrow(_removal_pass(length), "id bigint, n_bytes bigint, n_removed bigint, n_spans bigint, kept_sha256 string, kept binary")
    out = (out if keep_bytes else out.drop("kept")).withColumnRenamed("id", id_column)
    return own_ids(out, own, id_column, id_column)
