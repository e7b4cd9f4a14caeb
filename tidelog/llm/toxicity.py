"""Toxic spans by a linear-chain conditional random field.

Tokens are runs of letters and digits, lower-cased in ASCII. Each carries hashed features: the
word, prefixes and a suffix. Where only documents are labelled, a token of a toxic document is
labelled toxic if one of its features is found in toxic documents much more often than in others.
The field has two states and is trained by exact gradients of the likelihood; forward-backward
marginals of whole texts are summed up into a document score, calibrated on the training documents,
and runs of tokens with a marginal of a half or more are the offending spans.

Defined cases: a null or empty text, or one without a token, gets the score of a document
without any toxic token; without labels of both kinds the score is the share of label 1
(0 without labels); repeated rows each get a row; rows with a null label aren't learned from;
extra columns are not read.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import kernels as K

#: The most labelled rows that are fitted on, whatever the length of their texts.
SAMPLE = 4000
TABLE = 1 << 18
#: Bytes of texts whose chains are run together, as each step serves all of them.
TOGETHER = 24 << 20
#: Feature templates: whole word, prefixes of so many bytes, a suffix of so many.
PREFIXES, SUFFIX = (3, 4, 5, 6), 4


def token_features(t: K.Texts) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(features, tokens) buckets with 0 for none, starts, ends, first token of each text."""
    ws, we, first = K.words(t, K.WORDLIKE)
    hasher = K.Hasher(K.LOWER[t.data])
    size = we - ws
    rows = [hasher.spans(ws, we)]
    for k in PREFIXES:
        rows.append(np.where(size > k, hasher.spans(ws, np.minimum(ws + k, we)) + K.U64(k), K.U64(0)))
    rows.append(np.where(size > SUFFIX, hasher.spans(np.maximum(we - SUFFIX, ws), we) ^ K.U64(0x5BD1E995), K.U64(0)))
    return np.stack([(r >> K.U64(46)).astype(np.int32) for r in rows]), ws, we, first


@dataclass
class Model:
    weights: np.ndarray  # of each feature bucket, for toxic against clean
    bias: float
    move: np.ndarray  # log potentials [from, to]
    calibration: tuple[float, float, float]  # intercept, of log(1 + expected toxic tokens), of the largest marginal


def marginals(e: np.ndarray, first: np.ndarray, move: np.ndarray) -> np.ndarray:
    """P(toxic) of each token, by forward-backward over each whole text. ``e``: log odds of emission."""
    n = np.diff(first)
    order = np.argsort(-n, kind="stable")
    size, begin = n[order], first[:-1][order]
    active = np.searchsorted(-size, -np.arange(1, (size[0] if len(size) else 0) + 1), "right")  # texts longer than t
    m = np.exp(move - move.max())
    odds = np.exp(np.clip(e, -30, 30))
    ahead, after = np.empty(len(e)), np.empty(len(e))
    p = np.full(len(size), 0.5)
    for t, k in enumerate(active):
        at = begin[:k] + t
        a1 = p[:k]
        a0 = 1 - a1
        one, zero = (a0 * m[0, 1] + a1 * m[1, 1], a0 * m[0, 0] + a1 * m[1, 0]) if t else (0.5, 0.5)
        one = one * odds[at]
        p = one / (one + zero)
        ahead[at] = p
    b = np.full(len(size), 0.5)  # backward messages, as the share of state 1
    for t in range(len(active) - 1, -1, -1):
        k = active[t]
        at = begin[:k] + t
        b1 = b[:k]
        after[at] = b1
        one, zero = b1 * odds[at], 1 - b1
        up1 = m[1, 1] * one + m[1, 0] * zero
        b[:k] = up1 / (up1 + m[0, 1] * one + m[0, 0] * zero)
    both = ahead * after
    return both / np.maximum(both + (1 - ahead) * (1 - after), 1e-300)


def _weak_labels(feats: np.ndarray, doc: np.ndarray, toxic: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Labels of tokens, and which buckets are found in three documents or more."""
    n1 = max(toxic.sum(), 1)
    n0 = max(len(toxic) - toxic.sum(), 1)
    bad = np.zeros(TABLE)
    support = np.zeros(TABLE, np.int64)
    for row in feats:
        pairs = np.unique(row.astype(np.int64) * len(toxic) + doc)
        bucket, d = pairs // len(toxic), pairs % len(toxic)
        a = np.bincount(bucket[toxic[d]], minlength=TABLE)
        b = np.bincount(bucket[~toxic[d]], minlength=TABLE)
        odds = np.log((a + 0.1) / (n1 + 0.2)) - np.log((b + 0.1) / (n0 + 0.2))
        bad = np.maximum(bad, np.where((a >= 4) & (odds > 3.0), odds, 0))
        support = np.maximum(support, a + b)
    bad[0] = 0
    hit = np.max(bad[feats], axis=0) > 0
    return hit & toxic[doc], support >= 3


def _logistic(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    """Newton's method with a small ridge."""
    x = np.column_stack([np.ones(len(x)), x])
    w = np.zeros(x.shape[1])
    for _ in range(30):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        g = x.T @ (p - y) + 0.05 * w
        h = (x * (p * (1 - p))[:, None]).T @ x + 0.05 * np.eye(len(w))
        w -= np.linalg.solve(h, g)
    return w


def fit(column: pa.Array, toxic: np.ndarray, epochs: int = 30, rate: float = 0.5, chain: int = 64) -> Model:
    """Trains on whole chains of at most ``chain`` tokens."""
    t = K.texts(column)
    share = float(toxic.mean()) if len(toxic) else 0.0
    prior = np.log(max(share, 1e-4) / max(1 - share, 1e-4))
    if not len(toxic) or toxic.min() == toxic.max():
        return Model(np.zeros(TABLE, np.float32), -6.0, np.zeros((2, 2)), (prior, 0.0, 0.0))
    parts = [(a, token_features(t.part(a, b))) for a, b in K.slices(t)]
    feats = np.concatenate([p[1][0] for p in parts], axis=1)
    first = np.concatenate([[0], np.cumsum(np.concatenate([np.diff(p[1][3]) for p in parts]))])
    doc = K.owner(first)
    label, known = _weak_labels(feats, doc, toxic)
    feats = np.where(known[feats], feats, 0)
    cuts = np.unique(np.concatenate([first, np.arange(0, first[-1], chain)]))  # chains end with texts, too
    w, bias, move = np.zeros(TABLE), -4.0, np.zeros((2, 2))
    square, square_rest = np.full(TABLE, 1e-6), np.full(5, 1e-6)
    y = label.astype(np.float64)
    inner = np.ones(len(y), bool)
    inner[cuts[:-1]] = False
    inner = np.flatnonzero(inner)
    seen = np.zeros((2, 2))
    np.add.at(seen, (label[inner - 1].astype(int), label[inner].astype(int)), 1)
    n = len(y)
    for _ in range(epochs):
        e = w[feats].sum(0) + bias
        p = marginals(e, cuts, move)
        grad = np.zeros(TABLE)
        for row in feats:
            grad += np.bincount(row, p - y, minlength=TABLE)
        grad[0] = 0
        # expected moves, from the marginals and the chain's local potentials
        m = np.exp(move - move.max())
        a, o = p[inner - 1], p[inner]
        q = np.stack([(1 - a) * (1 - o) * m[0, 0], (1 - a) * o * m[0, 1], a * (1 - o) * m[1, 0], a * o * m[1, 1]])
        q /= np.maximum(q.sum(0), 1e-300)
        rest = np.append(q.sum(1) - seen.ravel() + 0.01 * n * 1e-3 * move.ravel(), (p - y).sum())
        grad += 0.02 * w
        square += grad * grad
        square_rest += rest * rest
        w -= rate * grad / np.sqrt(square)
        step = 0.2 * rest / np.sqrt(square_rest)
        move = np.clip(move - step[:4].reshape(2, 2), -3, 3)
        bias = float(np.clip(bias - step[4], -9, -1))
    p = marginals(w[feats].sum(0) + bias, first, move)
    c = _logistic(_summary(p, first), toxic.astype(float))
    return Model(w.astype(np.float32), bias, move, tuple(map(float, c)))


def _summary(p: np.ndarray, first: np.ndarray) -> np.ndarray:
    most = np.zeros(len(first) - 1)
    some = np.flatnonzero(np.diff(first))
    if len(some):
        most[some] = np.maximum.reduceat(p, first[:-1][some])
    return np.column_stack([np.log1p(K.per_text(np.where(p >= 0.05, p, 0), first)), most])


def train(docs: DataFrame, labels: DataFrame, label_column: str = "toxic", id_column: str = "doc_id", text_column: str = "text", sample: int = SAMPLE) -> Model:
    """Fits on at most ``sample`` labelled rows: those whose ids hash lowest."""
    chosen = labels.where(F.col(label_column).isNotNull()).select(F.col(id_column), F.col(label_column).cast("int").alias("y__")).orderBy(F.xxhash64(id_column), id_column).limit(sample)
    rows = docs.select(id_column, text_column).join(F.broadcast(chosen), id_column).orderBy(F.xxhash64(id_column), text_column).limit(sample).toArrow()
    return fit(rows.column(text_column), np.asarray(rows.column("y__").to_numpy(), float) == 1)


def _spans(part: K.Texts, ws: np.ndarray, we: np.ndarray, first: np.ndarray, hot: np.ndarray) -> list[str]:
    out = [""] * len(part)
    at = np.flatnonzero(hot)
    if not len(at):
        return out
    points = np.zeros(len(part.data) + 1, np.int64)
    np.cumsum(K.code_points(part.data), out=points[1:])
    doc = np.searchsorted(first, at, "right") - 1
    opens = np.ones(len(at), bool)
    opens[1:] = (at[1:] != at[:-1] + 1) | (doc[1:] != doc[:-1])
    begin = np.flatnonzero(opens)
    end = np.append(begin[1:], len(at)) - 1
    base = points[part.starts[doc[begin]]]
    s, e = points[ws[at[begin]]] - base, points[we[at[end]]] - base
    for d, a, b in zip(doc[begin], s, e):
        out[d] += ("," if out[d] else "") + f"{a}:{b}"
    return out


def score(docs: DataFrame, model: Model, id_column: str = "doc_id", text_column: str = "text", threshold: float = 0.7) -> DataFrame:
    """(id, score, predicted, n_toxic_tokens, spans): spans are start:end in code points, comma-joined."""

    def scored(pending: list[tuple]) -> Iterator[pa.RecordBatch]:
        first = np.concatenate([[0], np.cumsum(np.concatenate([np.diff(x[4]) for x in pending]))])
        p = marginals(np.concatenate([x[5] for x in pending]), first, model.move)
        c, x = model.calibration, _summary(p, first)
        value = 1 / (1 + np.exp(-np.clip(c[0] + c[1] * x[:, 0] + c[2] * x[:, 1], -30, 30)))
        hot = p >= 0.5
        count = K.per_text(hot, first)
        word, row = 0, 0
        for ids, part, ws, we, inner, _ in pending:
            n = len(part)
            spans = _spans(part, ws, we, inner, hot[word : word + len(ws)])
            v = value[row : row + n]
            yield pa.RecordBatch.from_arrays([ids, pa.array(v), pa.array((v >= threshold).astype(np.int32)), pa.array(count[row : row + n].astype(np.int64)), pa.array(spans, pa.string())], names=["id", "score", "predicted", "n_toxic_tokens", "spans"])
            word, row = word + len(ws), row + n

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pending, size = [], 0
        for batch in batches:
            t = K.texts(batch.column(1))
            for a, b in K.slices(t):
                part = t.part(a, b)
                feats, ws, we, first = token_features(part)
                e = np.full(feats.shape[1], model.bias, np.float32)
                for row in feats:
                    e += model.weights[row]
                pending.append((batch.column(0).slice(a, b - a), part, ws.astype(np.int32), we.astype(np.int32), first, e))
                size += len(part.data)
                if size > TOGETHER:
                    yield from scored(pending)
                    pending, size = [], 0
        if pending:
            yield from scored(pending)

    kind = docs.schema[id_column].dataType.simpleString()
    return docs.select(id_column, text_column).mapInArrow(run, f"id {kind}, score double, predicted int, n_toxic_tokens bigint, spans string").withColumnRenamed("id", id_column)
