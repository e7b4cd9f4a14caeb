"""Language identification as multilingual mixture inference.

Training counts hashed byte trigrams of words by language, over every learning document.
A document's words then have a likelihood in each language; expectation-maximisation
estimates the proportions of the languages, and the set of languages is the one of best
likelihood less a penalty of ``penalty * log(words)`` for each language more. Sets have any size up to all
learned languages; all sets of a size are tried where there are at most SETS of them, else the languages of the
largest proportions. Likelihoods are within TOLERANCE of their maximum (after ROUNDS rounds at the latest), and sizes
that can't gain their penalty aren't tried.

Defined cases: a null text or one without letters is ``und`` with score 0; rows with a
null language aren't learned from; without any learned language all is ``und``; ties go to
the language that sorts first; repeated rows each get a row; extra columns are not read.
"""

from __future__ import annotations

import itertools
import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import kernels as K

BUCKETS = 1 << 16
#: How far a log likelihood may be from its maximum, the most rounds until then, and the most sets of a size that are all tried.
TOLERANCE, ROUNDS, SETS = 0.05, 1000, 64
#: Of words without a letter nothing is learned or inferred.
_LETTER = np.zeros(256, bool)
_LETTER[65:91] = _LETTER[97:123] = _LETTER[128:] = True


def _trigrams(t: K.Texts) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Buckets of byte trigrams of letter runs with their bounds, the first of each word, the first word of each text."""
    ws, we, first = K.words(t, _LETTER)
    size = we - ws  # a word of n bytes has n trigrams of " word "
    begin = np.zeros(len(ws) + 1, np.int64)
    np.cumsum(size, out=begin[1:])
    at = np.arange(begin[-1]) - np.repeat(begin[:-1] - ws, size)
    low = K.LOWER[t.data].astype(np.uint32)
    padded = np.concatenate([[np.uint32(32)], low, [np.uint32(32)]])
    left, mid, right = padded[at], padded[at + 1], padded[at + 2]
    left[begin[:-1]] = 32
    right[begin[1:] - 1] = 32
    return (((left << 16) | (mid << 8) | right) * np.uint32(2654435761)) >> np.uint32(16), begin, first


def count_grams(docs: DataFrame, lang_column: str = "lang", text_column: str = "text") -> DataFrame:
    """(lang, bucket, n): each task adds up its own counts before the shuffle."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total: dict[str, np.ndarray] = {}
        for batch in batches:
            langs, t = np.asarray(batch.column(0).to_pylist(), object), K.texts(batch.column(1))
            for a, b in K.slices(t):
                gram, begin, first = _trigrams(t.part(a, b))
                doc = np.repeat(K.owner(first), np.diff(begin))
                names, which = np.unique(langs[a:b].astype(str), return_inverse=True)
                cell = np.bincount(which[doc] * BUCKETS + gram, minlength=len(names) * BUCKETS)
                for k, name in enumerate(names):
                    total[name] = total.get(name, 0) + cell[k * BUCKETS : (k + 1) * BUCKETS]
        for name, n in total.items():
            at = np.flatnonzero(n)
            yield pa.RecordBatch.from_arrays([pa.array([name] * len(at), pa.string()), pa.array(at.astype(np.int32)), pa.array(n[at].astype(np.int64))], names=["lang", "bucket", "n"])

    return docs.select(lang_column, text_column).mapInArrow(run, "lang string, bucket int, n bigint").groupBy("lang", "bucket").agg(F.sum("n").alias("n"))


def train(docs: DataFrame, lang_column: str = "lang", text_column: str = "text") -> tuple[list[str], np.ndarray]:
    """Languages and log probabilities (bucket, language). The table has at most languages x BUCKETS rows."""
    rows = count_grams(docs.where(F.col(lang_column).isNotNull()), lang_column, text_column).toPandas()
    names = sorted(rows["lang"].unique())
    counts = np.full((BUCKETS, len(names)), 0.05, np.float64)
    counts[rows["bucket"].to_numpy(), np.searchsorted(names, rows["lang"].to_numpy())] += rows["n"].to_numpy()
    return names, np.log(counts / counts.sum(0)).astype(np.float32) if names else counts.astype(np.float32)


def _mixture(like: np.ndarray, n: np.ndarray, floor: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Proportions of all columns, log likelihoods, and how far these can be from their maximum, by document of ``n`` words.

    A document is done once that is at most TOLERANCE, or once its likelihood can't get over ``floor``. As the likelihood is
    concave, it can grow by no more than n * (g - 1), where g is the largest factor by which a round changes a proportion.
    """
    pi = np.full((len(n), like.shape[1]), 1 / like.shape[1])
    ll, gap = np.zeros(len(n)), np.zeros(len(n))
    at, p = np.arange(len(n)), pi
    for _ in range(ROUNDS):
        if not len(at):
            break
        first = np.cumsum(n) - n
        total = np.einsum("ij,ij->i", like, np.repeat(p, n, axis=0))
        now = np.add.reduceat(np.log(total), first)
        g = np.add.reduceat(like / total[:, None], first, axis=0) / n[:, None]
        more = n * (g.max(1) - 1)
        pi[at], ll[at], gap[at] = p, now, more
        go = (more > TOLERANCE) & (now + more > floor)
        if not go.all():
            like = like[np.repeat(go, n)]
        at, n, floor, p = at[go], n[go], floor[go], (p * g)[go]
    return pi, ll, gap


def _sets(pi: np.ndarray, k: int) -> Iterator[np.ndarray]:
    """Sets of k languages to try, by document: all if they are at most SETS, else those of the largest proportions."""
    size = pi.shape[1]
    if math.comb(size, k) <= SETS:
        for some in itertools.combinations(range(size), k):
            yield np.tile(np.array(some), (len(pi), 1))
    else:
        yield np.sort(np.argsort(-pi, axis=1, kind="stable")[:, :k], axis=1)


def infer(t: K.Texts, logp: np.ndarray, penalty: float) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """By document: proportions (zero outside the chosen set), the size of the set, whether any word was found."""
    gram, begin, first = _trigrams(t)
    size, found = logp.shape[1], np.diff(first) > 0
    out, chosen = np.zeros((len(t), size)), np.zeros(len(t), np.int64)
    if not len(gram):
        return out, chosen, found
    per_word = np.add.reduceat(logp[gram], begin[:-1], axis=0)
    per_word -= per_word.max(1, keepdims=True)
    per_word = np.maximum(per_word, -30).astype(np.float64)
    like, n = np.exp(per_word), np.diff(first)[found]
    cost = penalty * np.log(np.maximum(n, 2))
    single = np.add.reduceat(per_word, first[:-1][found], axis=0)
    best, count = single.max(1), np.ones(len(n), np.int64)
    got = np.zeros((len(n), size))
    got[np.arange(len(n)), single.argmax(1)] = 1
    # no set is likelier than all languages together
    pi, ll, gap = _mixture(like, n, best + cost)
    for k in range(2, size + 1):
        open_ = np.flatnonzero(ll + gap - (k - 1) * cost > best)
        if not len(open_):
            break
        some = like[np.repeat(np.isin(np.arange(len(n)), open_), n)]
        for columns in _sets(pi[open_], k):
            share, value, _ = _mixture(np.take_along_axis(some, np.repeat(columns, n[open_], axis=0), 1), n[open_], best[open_] + (k - 1) * cost[open_])
            value -= (k - 1) * cost[open_]
            better = value > best[open_]
            rows = open_[better]
            best[rows], count[rows], got[rows] = value[better], k, 0
            got[rows[:, None], columns[better]] = share[better]
    out[found], chosen[found] = got, count
    return out, chosen, found


def predict(docs: DataFrame, model: tuple[list[str], np.ndarray], id_column: str = "doc_id", text_column: str = "text", penalty: float = 3.0) -> DataFrame:
    """(id, lang_pred, score, n_langs, langs): the largest proportion and the chosen set, largest first."""
    names, logp = model

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            t = K.texts(batch.column(1))
            for a, b in K.slices(t):
                part = t.part(a, b)
                pred, score, sets = ["und"] * (b - a), np.zeros(b - a), [""] * (b - a)
                chosen = np.zeros(b - a, np.int64)
                if names:
                    pi, chosen, found = infer(part, logp, penalty)
                    ascii_letter = K.per_text(np.concatenate([_LETTER[:128], np.zeros(128, bool)])[part.data], part.starts) > 0
                    for i in np.flatnonzero(found & ~ascii_letter):
                        found[i] = any(c.isalpha() for c in bytes(part.data[part.starts[i] : part.starts[i + 1]]).decode("utf-8", "replace"))
                    top = np.argsort(-pi, axis=1, kind="stable")
                    for i in np.flatnonzero(found):
                        pred[i] = names[top[i, 0]]
                        score[i] = min(1.0, max(0.0, float(pi[i, top[i, 0]])))
                        sets[i] = ",".join(names[k] for k in top[i, : chosen[i]])
                    chosen = np.where(found, chosen, 0)
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(a, b - a), pa.array(pred), pa.array(score), pa.array(chosen), pa.array(sets)], names=["id", "lang_pred", "score", "n_langs", "langs"])

    kind = docs.schema[id_column].dataType.simpleString()
    return docs.select(id_column, text_column).mapInArrow(run, f"id {kind}, lang_pred string, score double, n_langs bigint, langs string").withColumnRenamed("id", id_column)
