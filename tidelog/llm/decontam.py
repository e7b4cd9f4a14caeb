"""Benchmark decontamination: a BM25 index of test items, searched by block-max WAND.

The index holds the items' segments of at most SEGMENT words; the last one of an item ends with it. A training text is cut into
passages of two successive blocks of SEGMENT words, so that a segment in it lies whole in one of them, and each
passage is a query. An entry's score is divided by the score of the entry's own text, so 1 is a whole match and
one threshold fits all. All entries at or above it are retrieved; an item is confirmed if the
text holds enough of the word triples of its question and of its answer (the last line, or else the last
sentence, of the item).

Most passages are excluded at once, for a whole batch of texts. For each entry, the rarest terms
are essential until the others carry no more than half of the threshold: a passage whose essential terms carry
less than the other half can't reach it. What is left is searched by block-max WAND: cursors over postings, a pivot
from the terms' upper bounds, and, where the bounds of the pivot's blocks can't reach the threshold together, a skip of
all cursors beyond the first of these blocks to end.

The index is made on the driver from one shard of distinct item texts of bounded size after the other; document
frequencies and the average length are those of all items, so that results don't depend on the shards.

Defined cases: null texts and texts without words match nothing; items without a word are not searched; items of fewer
than LEAST words, whose words chance would find anywhere, are found where they stand as a whole sentence or line; equal
items are each found; repeated rows are each searched; without items nothing is found; extra columns are not read.
"""

from __future__ import annotations

import re
from bisect import bisect_left
from collections.abc import Iterator
from operator import itemgetter

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_type

from . import kernels as K
from .runtime import written

SEGMENT, LEAST = 64, 5
K1, SHAPE = 1.2, 0.75
THRESHOLD = 0.6
#: Shares of the question's and the answer's triples that a text must hold.
QUESTION, ANSWER = 0.7, 0.5
#: Bytes of item texts in one index.
SHARD_BYTES = 16 << 20
#: Postings in a block.
BLOCK = 8


def term_hashes(t: K.Texts) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of the lower-cased runs of letters and digits, and the first of each text."""
    lower = K.LOWER[t.data]
    ws, we, first = K.words(K.Texts(lower, t.starts), K.WORDLIKE)
    return K.Hasher(lower).spans(ws, we), first


def triples(h: np.ndarray) -> np.ndarray:
    """Distinct hashes of three words in a row; of fewer words, of each word."""
    if len(h) < 3:
        return np.unique(h)
    return np.unique(K.grams(h, np.array([0, len(h)]), 3)[0])


def question_and_answer(text: str) -> tuple[str, str]:
    """The answer is the last line with a word, or the last sentence where there is one line, or else the last quarter of the words."""
    lines = [x for x in text.split("\n") if re.search(r"\w", x)]
    if len(lines) > 1:
        return "\n".join(lines[:-1]), lines[-1]
    parts = [x for x in re.split(r"(?<=[.!?])\s+", text.strip()) if re.search(r"\w", x)]
    if len(parts) > 1:
        return " ".join(parts[:-1]), parts[-1]
    words = text.split()
    cut = max(1, len(words) * 3 // 4)
    return " ".join(words[:cut]), " ".join(words[cut:])


def segments(words: int) -> list[int]:
    """Where an item's entries begin."""
    return sorted({*range(0, max(1, words - SEGMENT + 1), SEGMENT), max(0, words - SEGMENT)}) if words >= LEAST else []


def entry_terms(t: K.Texts) -> tuple[np.ndarray, ...]:
    """(text of each entry, its number of words; entry, term, times) of all items' entries."""
    h, first = term_hashes(t)
    found = [(i, first[i] + a, min(SEGMENT, first[i + 1] - first[i] - a)) for i in range(len(t)) for a in segments(int(first[i + 1] - first[i]))]
    item, begin, size = (np.array(x, np.int64) for x in zip(*found)) if found else (np.zeros(0, np.int64),) * 3
    at = np.repeat(begin - (np.cumsum(size) - size), size) + np.arange(size.sum())
    entry, term = np.repeat(np.arange(len(item)), size), h[at]
    order = np.lexsort((term, entry))
    entry, term = entry[order], term[order]
    new = np.ones(len(term), bool)
    new[1:] = (term[1:] != term[:-1]) | (entry[1:] != entry[:-1])
    times = np.diff(np.append(np.flatnonzero(new), len(term)))
    return item, size, entry[new], term[new], times


_STOP = np.isin(np.arange(256), list(b"\n.!?"))


def sentences(t: K.Texts) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Hashes of the word sequences of all sentences and lines of fewer than LEAST words, their numbers of words, and their texts."""
    lower = K.LOWER[t.data]
    ws, we, first = K.words(K.Texts(lower, t.starts), K.WORDLIKE)
    h = K.Hasher(lower).spans(ws, we)
    stops = np.concatenate([[0], np.cumsum(_STOP[t.data])])
    opens = np.zeros(len(h), bool)
    opens[1:] = stops[ws[1:]] > stops[we[:-1]]
    opens[first[:-1][np.diff(first) > 0]] = True
    at = np.flatnonzero(opens)
    n = np.diff(np.append(at, len(h)))
    at, n = at[n < LEAST], n[n < LEAST]
    out = np.zeros(len(at), K.U64)
    for k in range(LEAST - 1):
        more = n > k
        out[more] = K.mix(out[more] * K.U64(0x9FB21C651E98DF25) + h[at[more] + k])
    return out, n, np.searchsorted(first, at, "right") - 1


class Index:
    """Postings with normalised BM25 impacts, their blocks, the essential terms, and the items' triples.

    ``statistics``: document frequencies by term, the number of entries and of their words, where there are more shards than this.
    """

    def __init__(self, ids: list, texts: list[str], threshold: float, statistics: tuple[dict[int, int], int, int] | None = None):
        self.ids, self.threshold = ids, threshold
        t = K.texts(pa.array(texts, pa.string()))
        self.question, self.answer = [], []
        for text in texts:
            q, a = question_and_answer(text)
            both, cut = term_hashes(K.texts(pa.array([q, a])))
            self.question.append(triples(both[: cut[1]]))
            self.answer.append(triples(both[cut[1] :]))
        self.item, size, entry, term, times = entry_terms(t)
        self.terms, at, df = np.unique(term, return_inverse=True, return_counts=True)
        n, total = len(self.item), int(size.sum())
        if statistics:
            df, n, total = np.array([statistics[0][int(x)] for x in self.terms.view(np.int64)], np.int64), statistics[1], statistics[2]
        idf = np.log(1 + (n - df + 0.5) / (df + 0.5))
        impact = idf[at] * times * (K1 + 1) / (times + K1 * (1 - SHAPE + SHAPE * size[entry] / (total / max(n, 1))))
        impact /= np.bincount(entry, impact, minlength=len(self.item))[entry]
        # the rarest terms of an entry are essential until those left carry no more than half of the threshold
        order = np.lexsort((at, df[at], entry))
        run = np.cumsum(impact[order])
        opens = np.searchsorted(entry[order], np.arange(len(self.item)))
        before = run - impact[order] - (run - impact[order])[opens][entry[order]] if len(entry) else run
        essential = np.zeros(len(entry), bool)
        essential[order] = 1 - before > threshold / 2
        # postings by term, then entry
        order = np.lexsort((entry, at))
        self.first = np.searchsorted(at[order], np.arange(len(self.terms) + 1))
        self.posting_entry, self.posting_impact = entry[order], impact[order]
        order = order[essential[order]]
        self.essential_terms = np.unique(at[order])
        self.offsets = np.append(np.searchsorted(at[order], self.essential_terms), len(order))
        self.entry, self.impact = entry[order], impact[order]
        self.essential_hash = self.terms[self.essential_terms]
        self.filter = np.zeros(1 << 20, bool)
        self.filter[(self.essential_hash >> K.U64(44)).astype(np.int64)] = True
        h, n_words, of = sentences(t)
        alone = np.isin(of, np.flatnonzero((np.bincount(of, minlength=len(texts)) == 1) & (np.diff(term_hashes(t)[1]) < LEAST)))
        order = np.argsort(h[alone], kind="stable")
        self.short, self.short_item = h[alone][order], of[alone][order]
        self.lists: dict[int, tuple] = {}

    def posting(self, term: int) -> tuple[list, list, list, list, float]:
        """(entries, impacts, blocks' largest impacts, blocks' last entries, largest impact) of a term."""
        if term not in self.lists:
            s = slice(self.first[term], self.first[term + 1])
            e, w = self.posting_entry[s], self.posting_impact[s]
            cut = range(0, len(e), BLOCK)
            self.lists[term] = (e.tolist(), w.tolist(), [float(w[b : b + BLOCK].max()) for b in cut], [int(e[min(b + BLOCK, len(e)) - 1]) for b in cut], float(w.max()))
        return self.lists[term]

    def wand(self, terms: list[int]) -> list[tuple[int, float]]:
        """(entry, score) of all entries that score the threshold or more for the distinct terms."""
        limit, none = self.threshold - 1e-9, len(self.item)
        cursors = []  # [entry, place, posting]
        for t in terms:
            p = self.posting(t)
            cursors.append([p[0][0], 0, p])
        cursors.sort(key=itemgetter(0))
        out = []
        self.skipped = 0
        while cursors:
            bound, pivot = 0.0, -1
            for k, c in enumerate(cursors):
                bound += c[2][4]
                if bound >= limit:
                    pivot = k
                    break
            if pivot < 0:
                break
            target = cursors[pivot][0]
            while pivot + 1 < len(cursors) and cursors[pivot + 1][0] == target:
                pivot += 1
            # the blocks that hold the target, or would: up to the first of their ends nothing can score more
            here, bound, until = cursors[: pivot + 1], 0.0, cursors[pivot + 1][0] if pivot + 1 < len(cursors) else none
            for c in here:
                lasts = c[2][3]
                b = bisect_left(lasts, target, c[1] // BLOCK)
                if b < len(lasts):
                    bound += c[2][2][b]
                    until = min(until, lasts[b] + 1)
            if bound < limit:
                self.skipped += until > target + 1
                target = until
            elif cursors[0][0] == target:
                score = sum(c[2][1][c[1]] for c in here)
                if score >= limit:
                    out.append((target, score))
                target += 1
            for c in here:
                if c[0] < target:
                    c[1] = bisect_left(c[2][0], target, c[1])
                    c[0] = c[2][0][c[1]] if c[1] < len(c[2][0]) else none
            cursors.sort(key=itemgetter(0))
            while cursors and cursors[-1][0] >= none:
                cursors.pop()
        return out

    def search(self, t: K.Texts) -> list[tuple[int, int, float, float, float]]:
        """(text, item, score, shares of the question and the answer) of confirmed items, each once for a text."""
        return self._exact(t) + self._scored(t) if len(t.data) else []

    def _exact(self, t: K.Texts) -> list[tuple[int, int, float, float, float]]:
        """Short items that stand as a whole sentence or line."""
        if not len(self.short):
            return []
        h, _, doc = sentences(t)
        a, b = np.searchsorted(self.short, h), np.searchsorted(self.short, h, "right")
        return [(d, i, 1.0, 1.0, 1.0) for d, i in sorted({(int(doc[k]), int(self.short_item[x])) for k in np.flatnonzero(a < b) for x in range(a[k], b[k])})]

    def _scored(self, t: K.Texts) -> list[tuple[int, int, float, float, float]]:
        n = len(self.item)
        if not n:
            return []
        h, first = term_hashes(t)
        hit = np.flatnonzero(self.filter[(h >> K.U64(44)).astype(np.int64)])
        at = np.searchsorted(self.essential_hash, h[hit])
        ok = self.essential_hash[np.minimum(at, len(self.essential_hash) - 1)] == h[hit]
        hit, at = hit[ok], at[ok]
        if not len(hit):
            return []
        # blocks of SEGMENT words, with an empty one after each text
        size = -(-np.diff(first) // SEGMENT)
        base = np.concatenate([[0], np.cumsum(size + 1)])
        doc = np.searchsorted(first, hit, "right") - 1
        block = base[doc] + (hit - first[doc]) // SEGMENT
        pair = np.unique(block * len(self.essential_terms) + at)
        block, at = pair // len(self.essential_terms), pair % len(self.essential_terms)
        many = self.offsets[at + 1] - self.offsets[at]
        posting = np.arange(many.sum()) - np.repeat(np.cumsum(many) - many - self.offsets[at], many)
        cell, index = np.unique(np.repeat(block, many) * n + self.entry[posting], return_inverse=True)
        mass = np.bincount(index, self.impact[posting])
        after = np.searchsorted(cell, cell + n)
        bound = mass + np.where(cell[np.minimum(after, len(cell) - 1)] == cell + n, mass[np.minimum(after, len(cell) - 1)], 0)
        live = bound >= self.threshold / 2 - 1e-9
        # where the passage's first block holds no essential term, all of them are in its second
        heavy = cell[mass >= self.threshold / 2 - 1e-9] // n
        before = heavy[~np.isin(heavy, base)] - 1
        passages = np.unique(np.concatenate([cell[live] // n, before]))
        best: dict[tuple[int, int], float] = {}
        for b in passages.tolist():
            d = int(np.searchsorted(base, b, "right") - 1)
            s = first[d] + (b - base[d]) * SEGMENT
            words = np.unique(h[s : min(s + 2 * SEGMENT, first[d + 1])])
            where = np.searchsorted(self.terms, words)
            known = where[(where < len(self.terms)) & (self.terms[np.minimum(where, len(self.terms) - 1)] == words)]
            for entry, score in self.wand(known.tolist()):
                key = (d, int(self.item[entry]))
                best[key] = max(best.get(key, 0.0), score)
        out = []
        grams: dict[int, np.ndarray] = {}
        for (d, i), score in sorted(best.items()):
            if d not in grams:
                w = h[first[d] : first[d + 1]]
                grams[d] = np.concatenate([triples(w), np.unique(w)])
            q, a = (float(np.isin(x, grams[d]).mean()) if len(x) else 1.0 for x in (self.question[i], self.answer[i]))
            if q >= QUESTION and a >= ANSWER:
                out.append((d, i, score, q, a))
        return out


def shards(items: DataFrame, id_column: str, text_column: str, threshold: float, shard_bytes: int = SHARD_BYTES) -> Iterator[Index]:
    """Indexes of distinct texts, each from about ``shard_bytes`` of them at most; sizes are checked first. Of equal items, each has the smallest id."""
    items = items.select(F.col(id_column).alias("id"), F.col(text_column).alias("text")).where("text IS NOT NULL AND text <> ''")
    items = items.groupBy("text").agg(F.min("id").alias("id")).select("id", "text")
    size = items.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    n = -(-size // shard_bytes)
    if n > 1:
        items = items.withColumn("shard", F.pmod(F.xxhash64("text"), F.lit(n)).cast("int"))

        def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                item, sizes, entry, term, _ = entry_terms(K.texts(batch.column(1)))
                shard = batch.column(0).to_numpy()[item].astype(np.int32)
                yield pa.RecordBatch.from_arrays([pa.array(shard[entry]), pa.array(term.view(np.int64)), pa.array(np.zeros(len(term), np.int64))], names=["shard", "term", "words"])
                yield pa.RecordBatch.from_arrays([pa.array(shard), pa.array([None] * len(item), pa.int64()), pa.array(sizes)], names=["shard", "term", "words"])

        counts = written(items.select("shard", "text").mapInArrow(count, "shard int, term bigint, words bigint").groupBy("shard", "term").agg(F.count("*").alias("n"), F.sum("words").alias("words")), "terms")
        entries, words = counts.where("term IS NULL").agg(F.sum("n"), F.sum("words")).first()
        total = counts.where("term IS NOT NULL").groupBy("term").agg(F.sum("n").alias("df"))
        of_shard = written(counts.where("term IS NOT NULL").select("shard", "term").join(total, "term"), "frequencies")
    for k in range(n):
        rows = (items.where(F.col("shard") == k) if n > 1 else items).orderBy("id", "text").collect()
        known = ({r["term"]: r["df"] for r in of_shard.where(F.col("shard") == k).collect()}, entries, words) if n > 1 else None
        yield Index([r[0] for r in rows], [r[1] for r in rows], threshold, known)


def find(docs: DataFrame, items: DataFrame, id_column: str = "doc_id", text_column: str = "text", item_id: str = "item_id", item_text: str = "text", threshold: float = THRESHOLD, shard_bytes: int = SHARD_BYTES) -> DataFrame:
    """(id, item_id, score, question_overlap, answer_overlap): the items that each document holds."""
    spark = docs.sparkSession
    item_arrow = to_arrow_type(items.schema[item_id].dataType)
    kind, item_kind = docs.schema[id_column].dataType.simpleString(), items.schema[item_id].dataType.simpleString()
    schema = f"id {kind}, item_id {item_kind}, score double, question_overlap double, answer_overlap double"
    out = spark.createDataFrame([], schema)
    for index in shards(items, item_id, item_text, threshold, shard_bytes):
        shared = spark.sparkContext.broadcast(index)  # of one shard

        def run(batches: Iterator[pa.RecordBatch], shared=shared) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                t = K.texts(batch.column(1))
                for a, b in K.slices(t):
                    found = shared.value.search(t.part(a, b))
                    if found:
                        d, i, score, q, r = zip(*found)
                        ids = batch.column(0).take(pa.array([a + x for x in d]))
                        yield pa.RecordBatch.from_arrays([ids, pa.array([shared.value.ids[x] for x in i], item_arrow), pa.array(score), pa.array(q), pa.array(r)], names=["id", "item_id", "score", "question_overlap", "answer_overlap"])

        out = out.unionByName(docs.select(id_column, text_column).mapInArrow(run, schema))
    same = items.select(F.col(item_id).alias("each"), F.col(item_text).alias("text")).where("text IS NOT NULL AND text <> ''")
    again = same.groupBy("text").agg(F.min("each").alias("item_id"), F.count("*").alias("n")).where("n > 1")
    if not again.isEmpty():  # each of some equal items is found
        members = same.join(again, "text").select("item_id", "each")
        out = out.join(members, "item_id", "left").withColumn("item_id", F.coalesce("each", "item_id")).drop("each")
    return out.select(F.col("id").alias(id_column), "item_id", "score", "question_overlap", "answer_overlap")


def clean(docs: DataFrame, items: DataFrame, text_column: str = "text", item_id: str = "item_id", item_text: str = "text", threshold: float = THRESHOLD) -> DataFrame:
    """The documents that hold no item, with all their columns; nothing is shuffled."""
    at = docs.columns.index(text_column)
    for index in shards(items, item_id, item_text, threshold):
        shared = docs.sparkSession.sparkContext.broadcast(index)

        def run(batches: Iterator[pa.RecordBatch], shared=shared) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                t = K.texts(batch.column(at))
                keep = np.ones(batch.num_rows, bool)
                for a, b in K.slices(t):
                    for d, *_ in shared.value.search(t.part(a, b)):
                        keep[a + d] = False
                yield batch.filter(pa.array(keep))

        docs = docs.mapInArrow(run, docs.schema)
    return docs
