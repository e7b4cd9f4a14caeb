"""WARC archives: writing with revisit records, and reading by boundary-chain verification.

Writing: one record for each page. Pages with equal payloads share one response, that of the
smallest id; the others become revisit records that name it and have no block of their own.

Reading: every place where a record could begin is a candidate. Tasks read ranges of bytes and emit each
candidate with the offset to which its chain of successors, by their content lengths, leads out of the range; pointer
jumping from the files' starts, by joins in steps that double, marks the candidates that the chains reach. Others are
text inside payloads. Time is linear in the bytes, whatever they hold.

Defined cases: a null payload is an empty one; a null URL is left out of its record; a null
id is written as none and read as null, is never the smallest, and makes its record a response
only where no page with that payload has an id; pages with the same id and payload are each
a response; an empty table gives no record; extra columns are not read. A file that doesn't begin with a record gives
none, and one that was cut or damaged gives the records before that place.
"""

from __future__ import annotations

import base64
import hashlib
import re
from collections.abc import Iterator
from itertools import groupby

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .runtime import is_small, join_checked, written

MAGIC = b"WARC/1.0\r\n"
END = b"\r\n\r\n"
#: RFC 4648's alphabet.
BASE32 = "ABCDEFGHIJKLMNOPQRSTUVWXYZ234567"


def base32(hex_digest: Column) -> Column:
    """Upper-case base32 of 40 hexadecimal digits: each 5 of them are 4 letters."""
    letters = []
    for g in range(8):
        v = F.conv(F.substring(hex_digest, 5 * g + 1, 5), 16, 10).cast("int")
        letters += [F.substring(F.lit(BASE32), F.shiftright(v, s).bitwiseAND(F.lit(31)) + 1, F.lit(1)) for s in (15, 10, 5, 0)]
    return F.concat(*letters)


def records(pages: DataFrame, id_column: str = "page_id", url_column: str = "url", payload_column: str = "html", date: str = "2024-01-01T00:00:00Z", least: int = 0) -> DataFrame:
    """(record): one text for each page. Payloads of under ``least`` bytes are never revisits."""
    p = pages.select(F.col(id_column).alias("id"), F.col(url_column).cast("string").alias("url"), F.coalesce(F.col(payload_column), F.lit("")).alias("payload"))
    p = p.withColumn("digest", F.sha1(F.col("payload").cast("binary"))).withColumn("size", F.octet_length("payload"))
    # payloads aren't shuffled: ids and digests tell which pages are revisits, and those are looked up by page
    slim = p.select("id", "digest", "size")
    heads = slim.where(F.col("size") >= least).groupBy("digest").agg(F.min("id").alias("head"))
    again = written(slim.join(heads, "digest").where(F.col("head").isNotNull() & ~F.col("id").eqNullSafe(F.col("head"))).select(F.col("id").alias("r_id"), F.col("digest").alias("r_digest"), "head").distinct(), "revisits")
    p = p.join(F.broadcast(again) if is_small(again) else again.hint("shuffle_merge"), F.col("id").eqNullSafe(F.col("r_id")) & (F.col("digest") == F.col("r_digest")), "left")
    revisit = F.col("head").isNotNull()
    line = lambda name, value: F.coalesce(F.concat(F.lit(f"{name}: "), value.cast("string"), F.lit("\r\n")), F.lit(""))
    clean = F.regexp_replace(F.regexp_replace("url", "\r", "%0D"), "\n", "%0A")
    head = F.concat(
        F.lit("WARC/1.0\r\n"), F.concat(F.lit("WARC-Type: "), F.when(revisit, "revisit").otherwise("response"), F.lit("\r\n")),
        F.concat(F.lit("WARC-Record-ID: <urn:page:"), F.coalesce(F.col("id").cast("string"), F.lit("")), F.lit(">\r\n")), F.lit(f"WARC-Date: {date}\r\n"),
        line("WARC-Target-URI", clean), F.lit("Content-Type: text/html; charset=utf-8\r\n"), line("WARC-Payload-Digest", F.concat(F.lit("sha1:"), base32(F.col("digest")))),
        F.when(revisit, F.concat(F.lit("WARC-Profile: http://netpreserve.org/warc/1.1/revisit/identical-payload-digest\r\nWARC-Refers-To: <urn:page:"), F.col("head").cast("string"), F.lit(">\r\n"), line("WARC-Full-Payload-Length", F.col("size")))).otherwise(F.lit("")),
        line("Content-Length", F.when(revisit, F.lit(0)).otherwise(F.col("size"))), F.lit("\r\n"),
    )
    return p.select(F.concat(head, F.when(revisit, F.lit("")).otherwise(F.col("payload"))).alias("record"))


def write(pages: DataFrame, path: str, **options) -> None:
    """An archive for each task, of any size, as they are read in ranges. Spark's committer keeps only whole files of tasks that ended."""
    records(pages, **options).write.option("lineSep", END.decode()).text(path)


#: The bytes between a record's header and its block, and after its block.
_GAP = len(END)
_HEADER = re.compile(rb"([A-Za-z-]+): ?([^\r\n]*)\r\n")
_ID = re.compile(rb"<urn:page:(-?[0-9]*)>")


def fields_of(head: bytes) -> dict[bytes, bytes]:
    """A header's fields; names in lower case."""
    return {k.lower(): v for k, v in _HEADER.findall(head + b"\r\n")}


def successor(at: int, size: int, head: bytes | None, tail: bytes) -> int:
    """Where the record that may begin at ``at`` ends, as its content length says; -1 if it can be none.

    ``size`` bytes follow its magic before the next one, ``head`` ends before the first empty line among them, and
    ``tail`` is the end of them. A record that ends among them must end with them; a longer one holds magic in its block.
    """
    if head is None:
        return -1
    length = fields_of(head).get(b"content-length", b"")
    if not length.isdigit() or len(length) > 15:
        return -1
    past = len(head) + 2 * _GAP + int(length)
    return -1 if past < size or (past == size and tail != END) else at + len(MAGIC) + past


def exits(at: np.ndarray, to: np.ndarray) -> np.ndarray:
    """Where the chain from each candidate leaves the candidates given, by pointer jumping: rounds grow with the logarithm of their count."""
    n = len(at)
    step = np.searchsorted(at, to)
    inside = (step < n) & (to >= 0)
    inside[inside] = at[step[inside]] == to[inside]
    jump = np.where(inside, step, np.arange(n))  # those whose successor isn't here stay
    while True:
        further = jump[jump]
        if (further == jump).all():
            return to[jump]
        jump = further


def pieces(spark: SparkSession, path: str) -> DataFrame:
    """(path, file, block, bytes, value): what lies between two magics, in the order of the archive within each range of bytes.

    Spark's text source reads the ranges: a row belongs to the range in which the magic before it begins, or right after.
    """
    meta = F.col("_metadata")
    return spark.read.option("lineSep", MAGIC.decode()).text(path).select(meta["file_path"].alias("path"), F.xxhash64(meta["file_path"]).alias("file"), meta["file_block_start"].alias("block"), meta["file_size"].alias("bytes"), "value")


def _by_range(batches: Iterator[pa.RecordBatch], columns: int) -> Iterator[tuple[tuple, Iterator]]:
    """Rows grouped by range, in order: (path, file, block, bytes) and the other columns' values."""

    def rows():
        for batch in batches:
            head = [batch.column(k).to_pylist() for k in range(4)]
            rest = [batch.column(k) for k in range(4, 4 + columns)]
            for i, key in enumerate(zip(*head)):
                yield key, [c[i].as_py() for c in rest]

    return groupby(rows(), key=lambda r: r[0])


def _emit(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Candidates of each range, with offsets from its first piece: where each one's chain leaves the range. A first row gives the range's own size."""
    for (path, file, block, size), rows in _by_range(batches, 3):
        at, to, here = [], [], 0
        for k, (_, (n, head, tail)) in enumerate(rows):
            if block or k:  # nothing comes before the archive's first magic
                s = here - len(MAGIC)
                at.append(s)
                to.append(successor(s, n, head, tail))
            here += n + len(MAGIC)
        a, b = np.array(at, np.int64), np.array(to, np.int64)
        out = exits(a, b)
        n = len(a)
        yield pa.RecordBatch.from_arrays(
            [pa.array([path] * 1 + [None] * n, pa.string()), pa.array([file] * (n + 1), pa.int64()), pa.array([block] * (n + 1), pa.int64()), pa.array([size] * (n + 1), pa.int64()), pa.array([None, *at], pa.int64()), pa.array([here, *(None if x < 0 else x for x in out.tolist())], pa.int64())],
            names=["path", "file", "block", "bytes", "at", "exit"],
        )


def chain(spark: SparkSession, path: str) -> DataFrame:
    """(path, file, block, base, entry, rest) of each range: where its first piece lies, and the first record at or after it that the chain from the file's start reaches.

    There is no entry where the chain ended before. ``rest`` says whether the range begins inside a record. Records are reached by pointer jumping over the table of ranges'
    candidates, in joins whose number grows with the logarithm of the ranges in a file.
    """
    value = F.col("value")
    head = F.substring_index(value, END.decode(), 1).cast("binary")
    raw = value.cast("binary")
    slim = pieces(spark, path).select("path", "file", "block", "bytes", F.octet_length(value).cast("bigint").alias("n"), F.when(F.octet_length(head) < F.octet_length(value), head).alias("head"), F.substring(raw, -_GAP, _GAP).alias("tail"))
    seen = written(slim.mapInArrow(_emit, "path string, file bigint, block bigint, bytes bigint, at bigint, exit bigint"), "candidates")
    order = Window.partitionBy("file").orderBy("block")
    ranges = seen.where("at IS NULL").withColumn("base", F.coalesce(F.sum("exit").over(order.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)))
    ranges = written(ranges.select("path", "file", "block", "bytes", "base"), "ranges")
    at = join_checked(seen.where("at IS NOT NULL").select("file", "block", "at", "exit"), ranges.select("file", "block", "base"), ["file", "block"], "inner")
    # only candidates to which some chain leads, and the files' starts, can begin a range's part of the chain
    at = at.select("file", "block", (F.col("at") + F.col("base")).alias("at"), (F.col("exit") + F.col("base")).alias("to"))
    heads = at.where("to IS NOT NULL").select("file", F.col("to").alias("at")).union(ranges.select("file", F.lit(0).cast("bigint"))).distinct()
    hop = written(join_checked(at, heads, ["file", "at"], "left_semi"), "hops")
    reached = hop.where("at = 0").select("file", "block", "at")
    nodes = hop.select("file", "block", "at")
    n = -1
    while True:
        on = reached.select("file", "at").join(hop.select("file", "at", "to"), ["file", "at"]).select("file", F.col("to").alias("at")).join(nodes, ["file", "at"])
        reached = written(reached.unionByName(on.select("file", "block", "at")).distinct(), "reached")
        n, before = reached.count(), n
        if n == before:
            break
        then = hop.select("file", F.col("at").alias("to"), F.col("to").alias("then"))
        hop = written(hop.join(then, ["file", "to"], "left").select("file", "block", "at", F.coalesce("then", "to").alias("to")), "hops")
    first = reached.groupBy("file", "block").agg(F.min("at").alias("own"))
    after = Window.partitionBy("file").orderBy("block").rowsBetween(Window.currentRow, Window.unboundedFollowing)
    whole = hop.join(ranges.where("block = 0").select("file", "bytes"), "file").where("at = 0 AND to = bytes").select("file", F.lit(True).alias("whole"))
    # the last record of a file ends with it, unless the chain ended before
    end = F.when(F.col("whole"), F.col("bytes"))
    found = ranges.join(first, ["file", "block"], "left").join(whole, "file", "left").withColumn("entry", F.coalesce(F.first("own", ignorenulls=True).over(after), end))
    return written(found.select("path", "file", "block", "base", "entry", F.coalesce((F.col("block") > 0) & (F.col("entry") > F.col("base") - len(MAGIC)), F.lit(False)).alias("rest")), "chain")


def _parsed(file: str, at: int, head: bytes, block: bytes) -> tuple:
    fields = fields_of(head)
    kind = fields[b"warc-type"].decode()
    number = lambda key: int(m[1]) if (m := _ID.fullmatch(fields.get(key, b""))) and m[1] else None
    if kind == "revisit":
        digest, full = fields[b"warc-payload-digest"].removeprefix(b"sha1:").decode(), int(fields[b"warc-full-payload-length"])
    else:
        digest, full = base64.b32encode(hashlib.sha1(block).digest()).decode(), len(block)
        if digest != fields[b"warc-payload-digest"].removeprefix(b"sha1:").decode():
            raise ValueError(f"{file}: the payload at {at} doesn't match its digest")
    url = fields.get(b"warc-target-uri")
    return number(b"warc-record-id"), full, digest, kind, number(b"warc-refers-to"), url.decode() if url is not None else None, None if kind == "revisit" else block.decode(), file, at


def _record(file: str, at: int, data: bytes, end: int) -> tuple | None:
    """The record from ``at`` to ``end`` whose bytes after the magic are ``data``; None if they aren't all there, as in a file that was cut."""
    if at + len(MAGIC) + len(data) != end or not data.endswith(END):
        return None
    head = data[: data.index(END)]
    return _parsed(file, at, head, data[len(head) + _GAP : -_GAP])


def _walk(rest: bool, most: int = 8 << 20):
    """Records of ranges that come with (base, entry): whole ones, or with ``rest`` the pieces of those that cross ranges."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        out: list[tuple] = []
        size = 0
        for (path, file, block, _), rows in _by_range(batches, 3):
            here, want, parts, start = None, None, [], 0
            for k, (_, (base, entry, value)) in enumerate(rows):
                if base is None:
                    raise ValueError(f"{path}: the range at {block} was not there when the chain was made")
                here = base if here is None else here
                at, here = here - len(MAGIC), here + len(value) + len(MAGIC)
                if entry is None or (want is not None and at > want):
                    break  # the chain ended before
                if not block and not k:
                    continue  # what comes before the first magic
                if want is None and at < entry:  # of a record that began in an earlier range
                    if rest:
                        out.append((file, entry, at, value, path))
                        size += len(value)
                else:
                    if want is None or at >= want:
                        head_end = value.find(END)
                        step = successor(at, len(value), value[:head_end] if head_end >= 0 else None, value[-_GAP:])
                        if step < 0:
                            break  # the chain ends here
                        want, parts, start = step, [], at
                    parts.append(value)
                    if here - len(MAGIC) >= want:
                        if not rest and (r := _record(path, start, MAGIC.join(parts), want)):
                            out.append(r)
                            size += len(r[6] or "")
                        parts = []
                if size > most:
                    yield _batch(out, _PARTS if rest else _FIELDS)
                    out, size = [], 0
            if rest and parts:
                at = start
                for p in parts:
                    out.append((file, want, at, p, path))
                    at += len(p) + len(MAGIC)
        yield _batch(out, _PARTS if rest else _FIELDS)

    return run


def _join_parts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        rows = [_record(path, at, MAGIC.join(parts), end) for path, end, at, parts in zip(*(c.to_pylist() for c in batch.columns))]
        yield _batch([r for r in rows if r], _FIELDS)


def read(spark: SparkSession, path: str) -> DataFrame:
    """(page_id, payload_bytes, payload_digest, record_type, refers_to, url, payload, file, offset).

    Archives are read in ranges of bytes, whatever their size; only a record's own payload must fit a task. ``chain`` tells each
    range where its first record begins, and the range's task follows the chain from there. Pieces of records that cross ranges
    and hold magic are put together by record; they are looked for only where there are any.
    """
    key = "spark.sql.files.minPartitionNum"
    if spark.conf.get(key, None) is None:  # ranges must be the same in both readings, even if executors come or go
        spark.conf.set(key, spark.sparkContext.defaultParallelism)
    links = chain(spark, path)
    schema = lambda fields: ", ".join(f"{n} {t}" for n, t, _ in fields)
    base = links.select("file", "block", "base", "entry")
    few = is_small(base)

    def ranged(rows: DataFrame) -> DataFrame:
        if few:
            rows = rows.join(F.broadcast(base), ["file", "block"], "left")
        else:
            rows = rows.withColumn("row", F.monotonically_increasing_id()).join(base, ["file", "block"], "left").sortWithinPartitions("file", "block", "row")
        return rows.select("path", "file", "block", "bytes", "base", "entry", F.col("value").cast("binary").alias("value"))

    all_pieces = pieces(spark, path)
    out = ranged(all_pieces).mapInArrow(_walk(False), schema(_FIELDS))
    crossing = links.where("rest").select("file").distinct()
    if crossing.isEmpty():
        return out
    parts = ranged(join_checked(all_pieces, crossing, "file", "left_semi")).mapInArrow(_walk(True), schema(_PARTS))
    whole = parts.groupBy("path", "end").agg(F.min("at").alias("at"), F.transform(F.array_sort(F.collect_list(F.struct("at", "data"))), lambda x: x["data"]).alias("parts"))
    return out.unionByName(whole.mapInArrow(_join_parts, schema(_FIELDS)))


_FIELDS = [
    ("page_id", "bigint", pa.int64()), ("payload_bytes", "bigint", pa.int64()), ("payload_digest", "string", pa.string()), ("record_type", "string", pa.string()), ("refers_to", "bigint", pa.int64()),
    ("url", "string", pa.string()), ("payload", "string", pa.string()), ("file", "string", pa.string()), ("offset", "bigint", pa.int64()),
]
_PARTS = [("file", "bigint", pa.int64()), ("end", "bigint", pa.int64()), ("at", "bigint", pa.int64()), ("data", "binary", pa.binary()), ("path", "string", pa.string())]


def _batch(rows: list[tuple], fields: list) -> pa.RecordBatch:
    columns = list(zip(*rows)) if rows else [()] * len(fields)
    return pa.RecordBatch.from_arrays([pa.array(c, t) for c, (_, _, t) in zip(columns, fields)], names=[n for n, _, _ in fields])
