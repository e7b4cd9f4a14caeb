"""The operators over the driver tables, with production parameters."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import bpe, decontam, langid, llr, minhash, pii, quality, suffix, toxicity, warc
from .runtime import documents, fold, join_checked, labels, prepared, stage_path


def op1_toxicity_crf(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = documents(spark, sf_dir)
    held_out = fold("doc_id", 3) == 1
    model = toxicity.train(docs, labels(spark, sf_dir).where(~held_out))
    return toxicity.score(docs, model).select("doc_id", held_out.alias("held_out"), "score", "predicted", "n_toxic_tokens", "spans")


def op2_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontam.find(documents(spark, sf_dir), spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def op3_pii_bilstm_crf(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = documents(spark, sf_dir)
    return pii.find(docs, pii.train(docs))


def op4_suffix_index_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return suffix.remove_repeats(documents(spark, sf_dir), keep_bytes=False)


#: Every window of 100 bytes, by a 128-bit digest.
OP4_SQL = '''
WITH d AS (SELECT doc_id, hex(encode(coalesce(text, ''))) AS h, strlen(coalesce(text, ''))::BIGINT AS n FROM documents),
w AS (SELECT doc_id, s, md5_number(substr(h, 2 * s + 1, 200)) AS x FROM (SELECT doc_id, h, unnest(range(n - 99)) AS s FROM d WHERE n >= 100)),
rep AS (SELECT doc_id, s FROM w QUALIFY row_number() OVER (PARTITION BY x ORDER BY doc_id, s) > 1),
g AS (SELECT doc_id, s, CASE WHEN s <= lag(s) OVER (PARTITION BY doc_id ORDER BY s) + 100 THEN 0 ELSE 1 END AS opens FROM rep),
i AS (SELECT doc_id, s, sum(opens) OVER (PARTITION BY doc_id ORDER BY s) AS k FROM g),
r AS (SELECT doc_id, min(s) AS a, max(s) + 100 AS b FROM i GROUP BY doc_id, k),
p AS (SELECT doc_id, coalesce(lag(b) OVER (PARTITION BY doc_id ORDER BY a), 0) AS since, a AS upto FROM r UNION ALL SELECT doc_id, coalesce(max(b), 0), max(n) FROM d LEFT JOIN r USING (doc_id) GROUP BY doc_id),
k AS (SELECT doc_id, unhex(string_agg(substr(h, 2 * since + 1, 2 * (upto - since)), '' ORDER BY since)) AS kept FROM p JOIN d USING (doc_id) GROUP BY doc_id),
c AS (SELECT doc_id, sum(b - a)::BIGINT AS n_removed, count(*) AS n_spans FROM r GROUP BY doc_id)
SELECT doc_id, n AS n_bytes, coalesce(n_removed, 0) AS n_removed, coalesce(n_spans, 0) AS n_spans, sha256(kept) AS kept_sha256 FROM d JOIN k USING (doc_id) LEFT JOIN c USING (doc_id)
'''


def op5_quality_rules_ensemble(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = documents(spark, sf_dir)
    held_out = fold("doc_id", 4) == 2
    model = quality.train(docs, labels(spark, sf_dir).where(~held_out))
    scored = quality.with_statistics(docs).select("doc_id", quality.compile_score(model).alias("score"))
    return scored.select("doc_id", held_out.alias("held_out"), "score", (F.col("score") >= 0.7).cast("int").alias("predicted"))


def op6_ngram_llr(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = documents(spark, sf_dir).select("doc_id", "text")
    trusted = labels(spark, sf_dir).where("quality = 1").select("doc_id").distinct().withColumn("trusted", F.lit(True))
    ratio = llr.train(join_checked(docs, trusted, "doc_id", "left"), "trusted")
    return llr.score(docs, ratio, threshold=llr.threshold_of(join_checked(docs, trusted, "doc_id", "left_semi"), ratio))


def op7_minhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return minhash.near_duplicates(documents(spark, sf_dir), words=4)


#: Links by counting shared shingles, and what can be reached over them.
OP7_SQL = r'''
WITH RECURSIVE w AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS v FROM documents),
s AS MATERIALIZED (SELECT DISTINCT doc_id, md5_number(array_to_string(list_slice(v, i, i + 3), ' ')) AS x FROM (SELECT doc_id, v, unnest(range(1, greatest(len(v) - 3, 1) + 1)) AS i FROM w WHERE len(v) > 0)),
n AS MATERIALIZED (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id),
l AS MATERIALIZED (SELECT a.doc_id AS a, b.doc_id AS b FROM s a JOIN s b ON a.x = b.x AND a.doc_id <> b.doc_id JOIN n na ON na.doc_id = a.doc_id JOIN n nb ON nb.doc_id = b.doc_id GROUP BY a.doc_id, b.doc_id, na.n, nb.n HAVING 100 * count(*) >= 80 * (na.n + nb.n - count(*))),
r AS (SELECT doc_id AS a, doc_id AS c FROM documents UNION SELECT l.b, r.c FROM r JOIN l ON l.a = r.a WHERE r.c < l.b)
SELECT d.doc_id, coalesce(n.n, 0) AS n_shingles, min(r.c) AS component_id, min(r.c) = d.doc_id AS kept FROM documents d LEFT JOIN n USING (doc_id) JOIN r ON r.a = d.doc_id GROUP BY d.doc_id, n.n
'''


def op8_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = stage_path(spark, "warc")
    warc.write(spark.read.parquet(f"{sf_dir}/pages.parquet"), path)
    return warc.read(spark, path).select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")


OP8_SQL = '''
WITH p AS (SELECT page_id, coalesce(html, '') AS h FROM pages),
d AS (SELECT page_id, strlen(h)::BIGINT AS payload_bytes, sha1(h) AS x FROM p),
f AS (SELECT x, min(page_id) AS head FROM d GROUP BY x)
SELECT page_id, payload_bytes,
       array_to_string(list_transform(range(32), lambda i: substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567', 1 + ((('0x' || substr(x, 1 + 5 * (i // 4), 5))::BIGINT >> (15 - 5 * (i % 4))) & 31)::INT, 1)), '') AS payload_digest,
       CASE WHEN page_id = head THEN 'response' ELSE 'revisit' END AS record_type,
       CASE WHEN page_id <> head THEN head END AS refers_to
FROM d JOIN f USING (x)
'''


def op9_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    return bpe.encode_documents(documents(spark, sf_dir), public_tokenizers.path("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN, keep_ids=False)


def op10_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = documents(spark, sf_dir)
    held_out = fold("doc_id", 5) == 0
    model = langid.train(docs.where(~held_out))
    return langid.predict(docs, model).withColumn("held_out", held_out).select("doc_id", "held_out", "lang_pred", "score", "n_langs", "langs")


def pipeline(spark: SparkSession, sf_dir: str) -> DataFrame:
    import corpus_pipeline

    return corpus_pipeline.run(spark, sf_dir)


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {f.__name__: prepared(f) for f in (op1_toxicity_crf, op2_decontamination, op3_pii_bilstm_crf, op4_suffix_index_dedup, op5_quality_rules_ensemble, op6_ngram_llr, op7_minhash, op8_warc, op9_byte_bpe, op10_language_id, pipeline)}


def oracle_sql() -> dict[str, str]:
    return {"op4_suffix_index_dedup": OP4_SQL, "op7_minhash": OP7_SQL, "op8_warc": OP8_SQL}
