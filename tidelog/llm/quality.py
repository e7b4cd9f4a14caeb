"""Quality classifier: a sparse ensemble of rules over text statistics.

Statistics of whole texts are computed once. On a bounded sample of labelled rows, shallow
trees are grown on resampled rows and every path from a root becomes a rule, a conjunction of
comparisons. A logistic model with an L1 penalty weighs the rules; most weights become zero.
The others are compiled into one Spark column expression, which scores every document.

Defined cases: a null text is an empty one, with all statistics zero, and is scored by the same
rules; without labels of both kinds the score is the share of label 1 (0.5 without any);
repeated rows each get a row; rows with a null label aren't learned from; extra columns are not read.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from . import kernels as K
from .llr import rule_counts

#: The most labelled rows that are fitted on: those whose ids hash lowest.
SAMPLE = 6000
STATS = ("words", "mean_word", "upper", "symbols", "bangs", "bars", "digits", "distinct_words", "runs", "dup_lines", "repeated", "letters", "line_words", "endings", "last_half_runs", "top_word", "symbol_words", "upper_words")

_UPPER = np.zeros(256, bool)
_UPPER[65:91] = True
_ALPHA = np.zeros(256, bool)
_ALPHA[65:91] = _ALPHA[97:123] = _ALPHA[128:] = True
_DIGIT = np.zeros(256, bool)
_DIGIT[48:58] = True
_SYMBOL = np.isin(np.arange(256), list(b"#*$%&<>@^~_=+"))
_END = np.isin(np.arange(256), list(b".!?"))


def text_statistics(t: K.Texts) -> np.ndarray:
    """One row of STATS for each text."""
    n, d = len(t), t.data
    ws, we, first = K.words(t)
    hasher = K.Hasher(d)
    h, doc = hasher.spans(ws, we), K.owner(first)
    counts = rule_counts(t, hasher, h, first, doc)
    nw = np.maximum(counts["n_words"], 1)
    size = np.maximum(np.diff(t.starts), 1)
    letters = K.per_text(_ALPHA[d], t.starts)
    uniq, uniq_doc = K.distinct(h, doc)
    run = np.zeros(len(h), bool)
    run[1:] = (h[1:] == h[:-1]) & (doc[1:] == doc[:-1])
    late = run & (np.arange(len(h)) - first[doc] >= nw[doc] // 2)
    order = np.lexsort((h, doc))
    new = np.ones(len(h), bool)
    new[1:] = (h[order][1:] != h[order][:-1]) | (doc[order][1:] != doc[order][:-1])
    begin = np.flatnonzero(new)
    top = np.zeros(n)
    np.maximum.at(top, doc[order][begin], np.diff(np.append(begin, len(h))))

    def in_words(mark: np.ndarray) -> np.ndarray:
        sums = np.zeros(len(d) + 1, np.int64)
        np.cumsum(mark[d], out=sums[1:])
        return sums[we] - sums[ws]

    word_upper, word_alpha = in_words(_UPPER), in_words(_ALPHA)
    lines = K.per_text(d == 10, t.starts) + 1
    return np.column_stack([
        counts["n_words"], counts["word_chars"] / nw, K.per_text(_UPPER[d], t.starts) / np.maximum(letters, 1), K.per_text(_SYMBOL[d], t.starts) / size,
        K.per_text(d == 33, t.starts) / nw, K.per_text(d == 124, t.starts) / nw, K.per_text(_DIGIT[d], t.starts) / size, np.bincount(uniq_doc, minlength=n) / nw,
        K.per_text(run, first) / nw, counts["n_dup_lines"] / lines, counts["n_repeat_words"] / nw, letters / size, counts["n_words"] / lines,
        K.per_text(_END[d], t.starts) / nw, K.per_text(late, first) / nw, top / nw, K.per_text(in_words(_SYMBOL) > 1, first) / nw, K.per_text((word_upper > 1) & (word_upper * 2 >= word_alpha), first) / nw,
    ]).astype(np.float64).round(6)


def names_beside(columns: list[str]) -> tuple[str, ...]:
    """Names for STATS that none of the columns has, and one for the text."""
    prefix = "stat__"
    while any(c.lower().startswith(prefix) for c in columns):
        prefix = "_" + prefix
    return tuple(prefix + s for s in (*STATS, "text"))


def with_statistics(docs: DataFrame, columns: list[str] | None = None, text_column: str = "text") -> DataFrame:
    """``columns`` of the documents (the id by default), and a column for each of STATS, by the names of :func:`names_beside`."""
    columns = columns or ["doc_id"]
    *names, text = names_beside(columns)
    kept = docs.select(F.col(text_column).alias(text), *columns)
    schema = T.StructType([*kept.schema.fields[1:], *(T.StructField(c, T.DoubleType()) for c in names)])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            t = K.texts(batch.column(0))
            for a, b in K.slices(t):
                x = text_statistics(t.part(a, b))
                yield pa.RecordBatch.from_arrays([*batch.slice(a, b - a).columns[1:], *(pa.array(np.ascontiguousarray(x[:, k])) for k in range(len(STATS)))], names=[*batch.schema.names[1:], *names])

    return kept.mapInArrow(run, schema)


def _paths(x: np.ndarray, y: np.ndarray, rng: np.random.Generator, depth: int, path: tuple, out: set) -> None:
    """Grows a tree by Gini impurity and adds each node's path to ``out``."""
    if path:
        out.add(path)
    if depth == 0 or len(y) < 16 or y.min() == y.max():
        return
    best = (1e-9, None, None)
    p = y.mean()
    for k in rng.choice(x.shape[1], max(3, x.shape[1] // 2), replace=False):
        values = x[:, k]
        order = np.argsort(values, kind="stable")
        v, c = values[order], np.cumsum(y[order])
        cut = np.flatnonzero(v[1:] > v[:-1]) + 1
        cut = cut[(cut >= 5) & (len(y) - cut >= 5)]
        if not len(cut):
            continue
        left, right = c[cut - 1] / cut, (c[-1] - c[cut - 1]) / (len(y) - cut)
        gain = p * (1 - p) - (cut * left * (1 - left) + (len(y) - cut) * right * (1 - right)) / len(y)
        i = int(np.argmax(gain))
        if gain[i] > best[0]:
            best = (gain[i], int(k), float((v[cut[i] - 1] + v[cut[i]]) / 2))
    _, k, at = best
    if k is None:
        return
    below = x[:, k] <= at
    _paths(x[below], y[below], rng, depth - 1, (*path, (k, True, at)), out)
    _paths(x[~below], y[~below], rng, depth - 1, (*path, (k, False, at)), out)


def _holds(rule: tuple, x: np.ndarray) -> np.ndarray:
    ok = np.ones(len(x), bool)
    for k, below, at in rule:
        ok &= (x[:, k] <= at) if below else (x[:, k] > at)
    return ok


def _lasso(r: np.ndarray, y: np.ndarray, penalty: float, steps: int = 400) -> tuple[np.ndarray, float]:
    """L1-penalised logistic weights and a free intercept, by accelerated proximal steps."""
    n = len(y)
    mean = r.mean(0)
    z = r - mean
    rate = 4 / max(np.linalg.norm(z, 2) ** 2 / n + 1, 1e-9)
    w = v = np.zeros(r.shape[1])
    b = vb = float(np.log(y.mean() / (1 - y.mean())))
    t = 1.0
    for _ in range(steps):
        g = 1 / (1 + np.exp(-(z @ v + vb))) - y
        new = v - rate * (z.T @ g) / n
        new = np.sign(new) * np.maximum(np.abs(new) - rate * penalty, 0)
        new_b = vb - rate * g.mean()
        s = (1 + np.sqrt(1 + 4 * t * t)) / 2
        v, vb = new + (t - 1) / s * (new - w), new_b + (t - 1) / s * (new_b - b)
        w, b, t = new, new_b, s
    return w, b - float(mean @ w)


def fit(x: np.ndarray, y: np.ndarray, trees: int = 40, depth: int = 3, penalty: float = 0.002, seed: int = 7) -> tuple[float, list[tuple[float, tuple]]]:
    """Intercept, and the rules with their weights."""
    if not len(y) or y.min() == y.max():
        p = min(max(y.mean(), 1e-3), 1 - 1e-3) if len(y) else 0.5
        return float(np.log(p / (1 - p))), []
    rng = np.random.default_rng(seed)
    found: set = set()
    for _ in range(trees):
        rows = rng.integers(0, len(y), min(len(y), 2000))
        _paths(x[rows], y[rows], rng, depth, (), found)
    rules, seen = [], set()
    for rule in sorted(found):
        hit = _holds(rule, x)
        key = hit.tobytes()
        if 3 <= hit.sum() <= len(y) - 3 and key not in seen:
            seen.add(key)
            rules.append((rule, hit))
    if not rules:
        return float(np.log(y.mean() / (1 - y.mean()))), []
    w, b = _lasso(np.column_stack([hit for _, hit in rules]).astype(np.float64), y.astype(np.float64), penalty)
    return b, [(float(a), rule) for a, (rule, _) in zip(w, rules) if abs(a) > 1e-4]


def compile_score(model: tuple[float, list[tuple[float, tuple]]], columns: list[str] | None = None) -> Column:
    """The ensemble as one column expression over STATS, for :func:`with_statistics` with the same ``columns``."""
    intercept, rules = model
    names = names_beside(columns or [])
    total = F.lit(float(intercept))
    for weight, rule in rules:
        test = F.lit(True)
        for k, below, at in rule:
            c = F.col(names[k])
            test = test & (c <= F.lit(at) if below else c > F.lit(at))
        total = total + F.when(test, F.lit(float(weight))).otherwise(F.lit(0.0))
    return F.lit(1.0) / (F.lit(1.0) + F.exp(-total))


def train(docs: DataFrame, labels: DataFrame, label_column: str = "quality", id_column: str = "doc_id", sample: int = SAMPLE, text_column: str = "text") -> tuple[float, list[tuple[float, tuple]]]:
    """Fits on at most ``sample`` labelled rows."""
    chosen = labels.where(F.col(label_column).isNotNull()).select(F.col(id_column), F.col(label_column).cast("int").alias("y__")).orderBy(F.xxhash64(id_column), id_column).limit(sample)
    names = names_beside([id_column])[:-1]
    texts = docs.select(id_column, text_column).join(F.broadcast(chosen.select(id_column)), id_column, "left_semi")
    rows = with_statistics(texts, [id_column], text_column).join(F.broadcast(chosen), id_column).orderBy(F.xxhash64(id_column), *names[:2]).limit(sample).toPandas()
    return fit(rows[list(names)].to_numpy(float), rows["y__"].to_numpy(float))
