"""Near-duplicate removal by b-bit MinHash.

A document's set holds hashes of its distinct word shingles. Documents with equal sets are one class
from the start, by a 128-bit fingerprint of the set; the smallest id stands for it. For these:

1. PERMUTATIONS minima are drawn. Bands of ROWS minima give keys; two documents of similarity 0.8
   share no key with a probability of (1 - 0.8**ROWS)**BANDS, under 1e-7. Of each minimum the
   lowest B bits stay, packed into longs.
2. In each bucket of a band, all are paired with one hub: the document that meets most others in
   buckets (a text that copies were made from, rather than a copy).
3. Packed signatures are compared by counting equal B-bit fields; the share m of them estimates the
   similarity as (m - 2**-B) / (1 - 2**-B). Pairs far below the threshold go. So do pairs that a second
   packed row excludes for certain: it holds for each of PARITIES cells whether the number of shingles in it is odd,
   and two sets differ in at least as many shingles as their rows differ in bits.
4. The others are confirmed on full sets.
5. In buckets that still hold several components, the documents outside the hub's component are
   compared by signature with all of the bucket outside their own component that are of about their size, and confirmed alike.
   So no link between components is lost. A bucket in which most documents are alike emits few pairs; one that holds many
   of about one size that are not can still compare them all.

Components come from rounds of stars over the confirmed links.

Defined cases: null texts and texts without a word have empty sets and link with nothing; texts
of fewer words than a shingle are one shingle; a row with a null id is linked with nothing and kept;
of different texts with one id, the one of the least fingerprint stands for the document in links, and each row has its own
text's component; ties of hubs go to the smaller id; ids that aren't whole numbers have the order of their values; extra
columns are not read.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import kernels as K
from .components import components
from .runtime import integer_ids, join_apart, join_checked, own_ids, written

ROWS, BANDS, B = 4, 32, 2
PERMUTATIONS = ROWS * BANDS
#: Estimates below the threshold by this much are not confirmed: over four standard deviations.
SLACK = 0.18
#: Bits of the parity row.
PARITIES = 2048
_LONGS, _ODD = PERMUTATIONS * B // 64, PARITIES // 64
_SIG = ["n_shingles", "sig", "odd"]
#: Bytes and texts that a Python worker handles at once: what it once held it keeps, beside the JVM's own memory.
_SLICE = (1 << 19, 512)
_MULTIPLY = np.random.default_rng(20240611).integers(1, 2**63, PERMUTATIONS, dtype=np.int64).astype(K.U64) * K.U64(2) + K.U64(1)
_FIELD = 0x5555555555555555


def shingles(t: K.Texts, n: int) -> tuple[np.ndarray, np.ndarray]:
    """Each text's distinct shingle hashes, sorted, and the first of each text."""
    lower = K.LOWER[t.data]
    ws, we, first = K.words(K.Texts(lower, t.starts))
    h = K.Hasher(lower).spans(ws, we)
    grams, at = K.grams(h, first, n)
    count = np.diff(first)
    doc = K.owner(first)[at]
    short = np.flatnonzero((count > 0) & (count < n))
    if len(short):
        whole = np.empty(len(short), K.U64)
        for k, i in enumerate(short):
            g = h[first[i] : first[i] + 1]
            for j in range(first[i] + 1, first[i + 1]):
                g = K.mix(g * K.U64(0x9FB21C651E98DF25) + h[j : j + 1])
            whole[k] = g[0] ^ K.U64(int(count[i]))
        grams, doc = np.concatenate([grams, whole]), np.concatenate([doc, short])
    h, doc = K.distinct(grams, doc)
    return h, np.searchsorted(doc, np.arange(len(t) + 1))


def _minima(h: np.ndarray, first: np.ndarray) -> np.ndarray:
    """(texts with a shingle, PERMUTATIONS)."""
    some = first[:-1][np.diff(first) > 0]
    out = np.empty((PERMUTATIONS, len(some)), K.U64)
    product = np.empty_like(h)
    for k, a in enumerate(_MULTIPLY):
        np.multiply(h, a, out=product)
        np.minimum.reduceat(product, some, out=out[k])
    return out.T


def signatures(docs: DataFrame, words: int, id_column: str, text_column: str) -> DataFrame:
    """(id, n_shingles, fp_a, fp_b, keys, sig, odd array<bigint>): of band keys, packed minima and parities; all empty for empty sets."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            t = K.texts(batch.column(1))
            for a, b in K.slices(t, *_SLICE):
                h, first = shingles(t.part(a, b), words)
                n = np.diff(first)
                some = np.flatnonzero(n)
                fp = _fingerprints(h, first)
                minima = _minima(h, first) if len(some) else np.empty((0, PERMUTATIONS), K.U64)
                keys = np.zeros((len(some), BANDS), K.U64)
                for r in range(ROWS):
                    keys = K.mix(keys * K.U64(0x9FB21C651E98DF25) + minima[:, r::ROWS])
                keys = K.mix(keys + np.arange(BANDS, dtype=K.U64))
                bits = (K.mix(minima) & K.U64((1 << B) - 1)).reshape(len(some), _LONGS, 64 // B)
                packed = (bits << (np.arange(64 // B, dtype=K.U64) * K.U64(B))).sum(2, dtype=K.U64)
                valid = n > 0
                lists = lambda x: pa.ListArray.from_arrays(pa.array(np.concatenate([[0], np.cumsum(np.where(valid, x.shape[1], 0))]).astype(np.int32)), pa.array(np.ascontiguousarray(x).view(np.int64).ravel()))  # noqa: B023, E731
                cells = (h >> K.U64(64 - PARITIES.bit_length() + 1)).astype(np.int64)
                odd = np.bincount(np.repeat(np.arange(b - a), n) * PARITIES + cells, minlength=(b - a) * PARITIES).reshape(b - a, PARITIES) & 1
                odd = np.packbits(odd.astype(bool), axis=1, bitorder="little").view(np.int64)
                yield pa.RecordBatch.from_arrays(
                    [batch.column(0).slice(a, b - a), pa.array(n.astype(np.int64)), pa.array(fp[0].view(np.int64)), pa.array(fp[1].view(np.int64)), lists(keys), lists(packed), lists(odd[valid])],
                    names=["id", "n_shingles", "fp_a", "fp_b", "keys", "sig", "odd"],
                )

    schema = "id bigint, n_shingles bigint, fp_a bigint, fp_b bigint, keys array<bigint>, sig array<bigint>, odd array<bigint>"
    return docs.select(F.col(id_column).cast("bigint").alias("id"), text_column).mapInArrow(run, schema)


def _fingerprints(h: np.ndarray, first: np.ndarray) -> np.ndarray:
    """128 bits of each set in two longs; zero for empty ones."""
    some = np.flatnonzero(np.diff(first))
    fp = np.zeros((2, len(first) - 1), K.U64)
    for row, salt in zip(fp, (0x243F6A8885A308D3, 0x13198A2E03707344)):
        if len(some):
            row[some] = np.add.reduceat(K.mix(h ^ K.U64(salt)), first[:-1][some])
    return fp


def shingle_sets(docs: DataFrame, words: int, id_column: str, text_column: str) -> DataFrame:
    """(id, fp_a, fp_b, set array<bigint>)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            t = K.texts(batch.column(1))
            for a, b in K.slices(t, *_SLICE):
                h, first = shingles(t.part(a, b), words)
                fp = _fingerprints(h, first).view(np.int64)
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(a, b - a), pa.array(fp[0]), pa.array(fp[1]), pa.ListArray.from_arrays(pa.array(first.astype(np.int32)), pa.array(h.view(np.int64)))], names=["id", "fp_a", "fp_b", "set"])

    return docs.select(F.col(id_column).cast("bigint").alias("id"), text_column).mapInArrow(run, "id bigint, fp_a bigint, fp_b bigint, set array<bigint>")


def estimate(left: str, right: str) -> Column:
    """Collision-corrected similarity of packed signatures, from counts of equal fields."""
    equal = None
    for k in range(_LONGS):
        x = F.get(f"{left}sig", F.lit(k)).bitwiseXOR(F.get(f"{right}sig", F.lit(k)))
        for _ in range(1, B):
            x = x.bitwiseOR(F.shiftrightunsigned(x, 1))
        n = F.lit(64 // B) - F.bit_count(x.bitwiseAND(F.lit(_FIELD)))
        equal = n if equal is None else equal + n
    chance = 2.0**-B
    return (equal / F.lit(float(PERMUTATIONS)) - F.lit(chance)) / F.lit(1 - chance)


def possible(left: str, right: str, percent: int) -> Column:
    """Whether the estimate is near the threshold or above, and parities don't exclude that the pair reaches it."""
    differ = None
    for k in range(_ODD):
        n = F.bit_count(F.get(f"{left}odd", F.lit(k)).bitwiseXOR(F.get(f"{right}odd", F.lit(k))))
        differ = n if differ is None else differ + n
    sizes = F.col(f"{left}n_shingles") + F.col(f"{right}n_shingles")
    return (estimate(left, right) >= F.lit(percent / 100 - SLACK)) & (differ * F.lit(100 + percent) <= sizes * F.lit(100 - percent))


def _with_signatures(pairs: DataFrame, sig: DataFrame) -> DataFrame:
    for side in "ab":
        pairs = pairs.join(sig.select(F.col("id").alias(side), *(F.col(k).alias(f"{side}{k}") for k in _SIG)).hint("shuffle_merge"), side)
    return pairs


def _one_text(rows: DataFrame) -> DataFrame:
    """Of rows with one id, that of the least fingerprint."""
    least = rows.groupBy("id").agg(F.min(F.struct("fp_a", "fp_b")).alias("least__"))
    several = rows.groupBy("id").agg(F.count("*").alias("n__")).where("n__ > 1").select("id")
    if several.isEmpty():
        return rows
    return rows.join(least.hint("shuffle_merge"), "id").where((F.col("fp_a") == F.col("least__.fp_a")) & (F.col("fp_b") == F.col("least__.fp_b"))).drop("least__").dropDuplicates(["id"])


def confirmed(pairs: DataFrame, docs: DataFrame, words: int, percent: int, id_column: str, text_column: str) -> DataFrame:
    """The pairs (a, b) whose full sets have 100 * intersection >= percent * union."""
    needed = written(pairs.select(F.col("a").alias(id_column)).union(pairs.select(F.col("b").alias(id_column))).distinct(), "needed")
    texts = join_checked(docs.select(id_column, text_column).where(F.col(id_column).isNotNull()), needed, id_column, "left_semi")
    sets = written(_one_text(shingle_sets(texts, words, id_column, text_column).where(F.size("set") > 0)).select("id", "set"), "sets")
    both = pairs.join(sets.withColumnRenamed("id", "a").withColumnRenamed("set", "set_a").hint("shuffle_merge"), "a").join(sets.withColumnRenamed("id", "b").withColumnRenamed("set", "set_b").hint("shuffle_merge"), "b")
    shared = F.size(F.array_intersect("set_a", "set_b"))
    return both.select("a", "b", shared.alias("i"), (F.size("set_a") + F.size("set_b") - shared).alias("u")).where(F.lit(100) * F.col("i") >= F.lit(percent) * F.col("u")).select("a", "b")


def _ordered(x: str, y: str) -> tuple[Column, Column]:
    return F.least(x, y).alias("a"), F.greatest(x, y).alias("b")


def near_duplicates(docs: DataFrame, words: int = 5, percent: int = 80, id_column: str = "doc_id", text_column: str = "text") -> DataFrame:
    """(id, n_shingles, component_id, kept), one row for each document."""
    docs, own = integer_ids(docs, id_column)
    sig = written(signatures(docs, words, id_column, text_column), "signatures")
    full = sig.where("n_shingles > 0 AND id IS NOT NULL")
    heads = written(full.groupBy("fp_a", "fp_b", "n_shingles").agg(F.min("id").alias("head")), "heads")
    reps = written(_one_text(written(full.join(heads.select(F.col("head").alias("id")).hint("shuffle_merge"), "id", "left_semi"), "heads-rows")), "representatives")

    entries = reps.select("id", F.explode("keys").alias("key"))
    crowded = entries.groupBy("key").agg(F.count("*").alias("n")).where("n > 1")
    entries = written(join_apart(entries, crowded, "key"), "buckets")
    degree = entries.groupBy("id").agg(F.sum("n").alias("degree"))
    hubs = entries.join(degree.hint("shuffle_merge"), "id").groupBy("key").agg(F.max(F.struct("degree", (-F.col("id")).alias("other"))).alias("h")).select("key", (-F.col("h.other")).alias("hub"))
    hubs = written(hubs, "hubs")
    stars = entries.join(hubs.hint("shuffle_merge"), "key").where("id <> hub").select(*_ordered("id", "hub")).distinct()
    tried = written(_with_signatures(stars, reps).where(possible("a", "b", percent)).select("a", "b"), "pairs")
    links = written(confirmed(tried, docs, words, percent, id_column, text_column), "links")
    found = components(links)

    # buckets of several components
    label = entries.select("key", "id").join(found.hint("shuffle_merge"), "id", "left").select("key", "id", F.coalesce("component", "id").alias("c"))
    mixed = label.groupBy("key").agg(F.min("c").alias("lo"), F.max("c").alias("hi")).where("lo < hi").select("key")
    label = written(join_apart(label, mixed, "key"), "mixed")
    hub_of = hubs.join(label.select("key", F.col("id").alias("hub"), F.col("c").alias("hub_c")).hint("shuffle_merge"), ["key", "hub"])
    signed = written(label.join(hub_of.select("key", "hub_c").hint("shuffle_merge"), "key").join(reps.select("id", *_SIG).hint("shuffle_merge"), "id"), "signed")
    cols = ["key", "id", "c", *_SIG]
    # sets whose sizes differ by more than the similarity allows can't be linked: only classes of size next to each other meet
    size = F.floor(F.log(F.col("n_shingles").cast("double")) / F.lit(max(math.log(100 / percent), 1e-6) * (1 + 1e-9)))
    apart = signed.where("c <> hub_c").select("key", F.explode(F.array(size - 1, size, size + 1)).alias("class"), *(F.col(x).alias(f"x{x}") for x in cols[1:]))
    rest = signed.select("key", size.alias("class"), "hub_c", *(F.col(x).alias(f"y{x}") for x in cols[1:]))
    cross = apart.join(rest.hint("shuffle_merge"), ["key", "class"]).where((F.col("xc") != F.col("yc")) & ((F.col("yc") == F.col("hub_c")) | (F.col("xid") < F.col("yid"))) & possible("x", "y", percent))
    cross = cross.select(*_ordered("xid", "yid")).distinct().join(tried.hint("shuffle_merge"), ["a", "b"], "left_anti")
    more = written(cross, "cross")
    if not more.isEmpty():
        found = components(links.union(written(confirmed(more, docs, words, percent, id_column, text_column), "more")))

    class_of = heads.join(found.withColumnRenamed("id", "head").hint("shuffle_merge"), "head", "left").select("fp_a", "fp_b", "n_shingles", F.coalesce("component", "head").alias("component"))
    out = sig.select("id", "n_shingles", "fp_a", "fp_b").join(class_of.hint("shuffle_merge"), ["fp_a", "fp_b", "n_shingles"], "left")
    component = F.when((F.col("n_shingles") > 0) & F.col("id").isNotNull(), F.col("component")).otherwise(F.col("id"))
    out = out.select(F.col("id").alias(id_column), "n_shingles", component.alias("component_id"), F.col("id").eqNullSafe(component).alias("kept"))
    return own_ids(out, own, id_column, id_column, "component_id")
