"""A training corpus from raw documents, stage by stage.

Every stage takes (spark, docs, sf_dir) and gives a DataFrame that is written as Parquet in the
shared folder and read again as the next stage's documents. All but the last keep the columns of
``documents``; the last gives token ids.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidelog.llm import bpe, decontam, minhash, pii, quality
from tidelog.llm.runtime import fold, join_checked, labels, prepare, written

#: The score under which the quality classifier rejects a document.
QUALITY = 0.7


def quality_classifier(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the rule ensemble, trained as in the query of its own, doesn't reject.

    Null and empty texts are scored like others; equal rows stay or go together; an empty table stays empty; all columns are kept, whatever their names.
    """
    prepare(spark)
    model = quality.train(docs, labels(spark, sf_dir).where(fold("doc_id", 4) != 2))
    return quality.with_statistics(docs, docs.columns).where(quality.compile_score(model, docs.columns) >= QUALITY).select(*docs.columns)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near-duplicates over five-word shingles: that of the smallest id.

    Rows with a null id, a null text or no word are kept; rows of one id stay or go together, and stay if one of them does; all columns are kept.
    """
    prepare(spark)
    gone = written(minhash.near_duplicates(docs, words=5).groupBy("doc_id").agg(F.bool_or("kept").alias("kept")).where("NOT kept").select("doc_id"), "near-duplicates")
    return join_checked(docs, gone, "doc_id", "left_anti").select(*docs.columns)


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold no benchmark item.

    Null and empty texts, and null ids, are kept; without items all stay; equal rows stay or go together; all columns are kept.
    """
    prepare(spark)
    return decontam.clean(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def personal_data(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, with personal data replaced by its kind in brackets; n_chars follows the text where it has changed.

    Null texts stay null; equal rows each stay; an empty table stays empty; all columns are kept.
    """
    prepare(spark)
    return pii.redact(docs, pii.train(docs), count_column="n_chars")


def tokens(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """(doc_id, n_tokens, ids_sha256, decoded_sha256, ids): ids are little-endian unsigned 32-bit integers.

    A row for each document, equal ones included; a null text is an empty one, of no token; other columns are dropped.
    """
    import public_tokenizers

    prepare(spark)
    return bpe.encode_documents(docs, public_tokenizers.path("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN)


STAGES = [("quality", quality_classifier), ("near-duplicates", near_duplicates), ("decontamination", decontamination), ("personal data", personal_data), ("tokens", tokens)]

#: SQL can't express the trained stages; tests hold run() against the stages' own results and brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES:
        docs = written(stage(spark, docs, sf_dir), name.replace(" ", "-"))
    return docs
