"""Quality rules: hashed n-gram log-likelihood ratio of a trusted target against the raw corpus.

Words and word pairs are hashed into buckets. Two multinomials over the buckets, of the
trusted documents and of all documents, are counted over the whole corpus; a document's
score is the mean log ratio of its n-grams, and ``kept`` compares it with one threshold for all: as far below the
trusted documents' QUANTILE as that lies below their median, both taken from a histogram of all their scores.
The counts of plain rules (word characters, symbols, repeated lines and word windows) come
from the same pass.

Defined cases: a null text is an empty one, whose counts are zero, whose score is zero and
which fails the base rule; equal lines after the first count as repeated; rows with equal ids
or texts each get a row; with no trusted document every score is zero, and only the base rule rejects; extra columns are not read.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import kernels as K

BUCKETS = 1 << 16
#: Counts that each bucket's ratio is drawn to the corpus's ratio with.
SHRINK = 20.0
#: The quantile of the trusted documents' scores that the threshold follows from.
QUANTILE = 0.01
#: Cells of the histogram for each nat.
CELLS = 1000

_SYMBOL = np.isin(np.arange(256), list(b"#*$%&|<>"))


def _grams(t: K.Texts) -> tuple:
    ws, we, first = K.words(t)
    hasher = K.Hasher(t.data)
    h = hasher.spans(ws, we)
    pairs, at = K.grams(h, first, 2)
    doc = K.owner(first)
    bucket = np.concatenate([h, pairs]) >> K.U64(48)
    return hasher, h, first, doc, bucket.astype(np.int64), np.concatenate([doc, doc[at]])


def rule_counts(t: K.Texts, hasher: K.Hasher, h: np.ndarray, first: np.ndarray, doc: np.ndarray) -> dict[str, np.ndarray]:
    """n_words, word_chars, n_symbols, n_dup_lines and n_repeat_words of each text."""
    n = len(t)
    plain = ~K.SPACE[t.data]
    out = {"n_words": np.diff(first), "word_chars": K.per_text(plain & K.code_points(t.data), t.starts), "n_symbols": K.per_text(_SYMBOL[t.data], t.starts)}

    breaks = np.flatnonzero(t.data == 10)
    # a text's last line is empty if it ends with a break; that place is the next text's first line, and counts once
    s = np.unique(np.concatenate([t.starts[:-1], breaks + 1]))
    text_of = np.searchsorted(t.starts[1:], s, "right") if n else s
    cut = np.searchsorted(breaks, s)
    e = np.minimum(np.append(breaks, len(t.data))[cut], t.starts[1:][np.minimum(text_of, n - 1)]) if n else s
    inner = np.zeros(len(plain) + 1, np.int64)
    np.cumsum(plain, out=inner[1:])
    some = (inner[np.maximum(e, s)] - inner[s] > 0) & (text_of < n)
    lines, line_doc = hasher.spans(s[some], e[some]), text_of[some]
    out["n_dup_lines"] = np.bincount(line_doc, minlength=n) - np.bincount(K.distinct(lines, line_doc)[1], minlength=n)

    tri, at = K.grams(h, first, 3)
    covered = np.zeros(len(h), bool)
    if len(tri):
        d = doc[at]
        order = np.lexsort((tri, d))
        same = (tri[order][1:] == tri[order][:-1]) & (d[order][1:] == d[order][:-1])
        twice = np.zeros(len(tri), bool)
        twice[order[1:][same]] = twice[order[:-1][same]] = True
        hit = at[twice]
        covered[hit] = covered[hit + 1] = covered[hit + 2] = True
    out["n_repeat_words"] = K.per_text(covered, first)
    return out


def count_buckets(docs: DataFrame, target_column: str, text_column: str = "text") -> DataFrame:
    """(bucket, n_raw, n_target) over all documents; each task adds up its own first."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros((2, BUCKETS), np.int64)
        for batch in batches:
            target = np.asarray(batch.column(0).fill_null(False).to_numpy(zero_copy_only=False), bool)
            t = K.texts(batch.column(1))
            for a, b in K.slices(t):
                *_, bucket, doc = _grams(t.part(a, b))
                total[0] += np.bincount(bucket, minlength=BUCKETS)
                total[1] += np.bincount(bucket[target[a:b][doc]], minlength=BUCKETS)
        at = np.flatnonzero(total[0])
        yield pa.RecordBatch.from_arrays([pa.array(at.astype(np.int32)), pa.array(total[0][at]), pa.array(total[1][at])], names=["bucket", "n_raw", "n_target"])

    parts = docs.select(F.col(target_column).cast("boolean").alias("t"), text_column).mapInArrow(run, "bucket int, n_raw bigint, n_target bigint")
    return parts.groupBy("bucket").agg(F.sum("n_raw").alias("n_raw"), F.sum("n_target").alias("n_target"))


def train(docs: DataFrame, target_column: str, text_column: str = "text") -> np.ndarray:
    """The log ratio of each bucket: at most BUCKETS rows come to the driver."""
    rows = count_buckets(docs, target_column, text_column).toPandas()
    raw, target = np.zeros(BUCKETS), np.zeros(BUCKETS)
    raw[rows["bucket"]], target[rows["bucket"]] = rows["n_raw"], rows["n_target"]
    if not target.sum():
        return np.zeros(BUCKETS, np.float32)
    share = target.sum() / raw.sum()
    return np.log((target + SHRINK * share) / ((raw + SHRINK) * share)).astype(np.float32)


def _means(bucket: np.ndarray, owner: np.ndarray, ratio: np.ndarray, n: int) -> np.ndarray:
    return np.bincount(owner, ratio[bucket], minlength=n) / np.maximum(np.bincount(owner, minlength=n), 1)


def threshold_of(trusted: DataFrame, ratio: np.ndarray, text_column: str = "text", quantile: float = QUANTILE) -> float:
    """The threshold, from the scores of all trusted documents; only the cells of their histogram come to the driver."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        low = int(np.floor(ratio.min() * CELLS)) - 1
        total = np.zeros(int(np.ceil(ratio.max() * CELLS)) - low + 2, np.int64)
        for batch in batches:
            t = K.texts(batch.column(0))
            for a, b in K.slices(t):
                *_, bucket, owner = _grams(t.part(a, b))
                total += np.bincount(np.floor(_means(bucket, owner, ratio, b - a) * CELLS).astype(np.int64) - low, minlength=len(total))
        at = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(at + low), pa.array(total[at])], names=["cell", "n"])

    rows = trusted.select(text_column).mapInArrow(run, "cell bigint, n bigint").groupBy("cell").agg(F.sum("n").alias("n")).orderBy("cell").collect()
    if not rows:
        return float("-inf")
    cell, upto = np.array([r["cell"] for r in rows]), np.cumsum([r["n"] for r in rows])
    at = lambda q: cell[np.searchsorted(upto, q * upto[-1])] / CELLS
    return float(2 * at(quantile) - at(0.5))


def score(docs: DataFrame, ratio: np.ndarray, id_column: str = "doc_id", text_column: str = "text", threshold: float = float("-inf")) -> DataFrame:
    """(id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, kept, llr)."""
    names = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            t = K.texts(batch.column(1))
            for a, b in K.slices(t):
                part = t.part(a, b)
                hasher, h, first, doc, bucket, owner = _grams(part)
                counts = rule_counts(part, hasher, h, first, doc)
                llr = _means(bucket, owner, ratio, b - a)
                n, repeat = counts["n_words"], counts["n_repeat_words"]
                failed = (n < 50) | (100 * repeat > 50 * n)
                yield pa.RecordBatch.from_arrays(
                    [batch.column(0).slice(a, b - a), *(pa.array(counts[k].astype(np.int64)) for k in names), pa.array(failed), pa.array(~failed & (llr >= threshold)), pa.array(llr.astype(np.float64))],
                    names=["id", *names, "base_failed", "kept", "llr"],
                )

    kind = docs.schema[id_column].dataType.simpleString()
    schema = f"id {kind}, {', '.join(f'{k} bigint' for k in names)}, base_failed boolean, kept boolean, llr double"
    return docs.select(id_column, text_column).mapInArrow(run, schema).withColumnRenamed("id", id_column)
