"""Byte-level BPE encoding and decoding with the tiktoken library and a local rank file.

Long texts are cut at safe boundaries first: before a single space between two word
characters no match of the pre-tokenising pattern goes on, so the pieces' ids, put
together, are those of the whole text. Decoding gives raw bytes.

Defined cases: a null text is an empty one; an empty text has no ids and the digest of
no bytes; rows with equal texts or ids each get a row; extra columns are not read.
"""

from __future__ import annotations

import base64
import hashlib
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

#: Texts are cut into pieces of about so many characters.
PIECE = 1 << 14
_SAFE = re.compile(r"(?<=\w) (?=\w)")
_made: dict = {}


def codec(ranks: bytes, pattern: str):
    """The encoding, made once in each worker."""
    key = (hashlib.sha1(ranks).digest(), pattern)
    if key not in _made:
        import tiktoken

        table = {base64.b64decode(token): int(rank) for token, rank in map(bytes.split, ranks.splitlines()) if token}
        _made.clear()
        _made[key] = tiktoken.Encoding("local", pat_str=pattern, mergeable_ranks=table, special_tokens={})
    return _made[key]


def pieces(text: str, size: int = PIECE) -> Iterator[str]:
    """The text, cut only where no token can cross."""
    at = 0
    while len(text) - at > size and (m := _SAFE.search(text, at + size)):
        yield text[at : m.start()]
        at = m.start()
    yield text[at:]


def encode(enc, text: str, size: int = PIECE) -> np.ndarray:
    if len(text) <= size:
        ids = [enc.encode_to_numpy(text, disallowed_special=())]
    else:
        ids = [enc.encode_to_numpy(p, disallowed_special=()) for p in pieces(text, size)]
    return np.concatenate(ids).astype("<u4")


def decode(enc, ids: np.ndarray) -> bytes:
    """Raw bytes; they need not be whole characters when ids were cut."""
    return enc.decode_bytes(ids.tolist())


def encode_documents(docs: DataFrame, rank_file: str, pattern: str, id_column: str = "doc_id", text_column: str = "text", keep_ids: bool = True) -> DataFrame:
    """(id, ids binary of little-endian unsigned 32-bit integers if ``keep_ids``, n_tokens, ids_sha256, decoded_sha256)."""
    spark = docs.sparkSession
    with open(rank_file, "rb") as f:
        ranks = spark.sparkContext.broadcast(f.read())  # one vocabulary: a fixed size

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc = codec(ranks.value, pattern)
        for batch in batches:
            for a in range(0, batch.num_rows, 512):
                part = batch.slice(a, 512)
                rows = []
                for text in part.column(1):
                    ids = encode(enc, text.as_py() or "")
                    raw = ids.tobytes()
                    rows.append((len(ids), hashlib.sha256(raw).hexdigest(), hashlib.sha256(decode(enc, ids)).hexdigest(), raw if keep_ids else b""))
                n, i, d, raw = zip(*rows)
                columns = [part.column(0), pa.array(n, pa.int64()), pa.array(i), pa.array(d)] + ([pa.array(raw, pa.binary())] if keep_ids else [])
                yield pa.RecordBatch.from_arrays(columns, names=["id", "n_tokens", "ids_sha256", "decoded_sha256"] + ["ids"] * keep_ids)

    kind = docs.schema[id_column].dataType.simpleString()
    schema = f"id {kind}, n_tokens bigint, ids_sha256 string, decoded_sha256 string" + ", ids binary" * keep_ids
    return docs.select(id_column, text_column).mapInArrow(run, schema).withColumnRenamed("id", id_column)


def decode_documents(encoded: DataFrame, rank_file: str, pattern: str, id_column: str = "doc_id") -> DataFrame:
    """(id, bytes) from the ``ids`` that :func:`encode_documents` gives; null ids give no bytes."""
    with open(rank_file, "rb") as f:
        ranks = encoded.sparkSession.sparkContext.broadcast(f.read())

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc = codec(ranks.value, pattern)
        for batch in batches:
            raw = [decode(enc, np.frombuffer(x.as_py() or b"", "<u4")) for x in batch.column(1)]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(raw, pa.binary())], names=["id", "bytes"])

    kind = encoded.schema[id_column].dataType.simpleString()
    return encoded.select(id_column, "ids").mapInArrow(run, f"id {kind}, bytes binary").withColumnRenamed("id", id_column)
