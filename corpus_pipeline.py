"""The corpus pipeline: five stages, each a call of one training-data operator.

A stage takes (spark, docs, sf_dir) and returns the documents that it keeps, with the columns of documents;
the last one returns token ids.  Between stages documents are written as Parquet in the shared folder and
read again, so a lost executor costs no earlier stage.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidebook.llm import bpe, common, decontaminate, near_dedup, quality, queries, secret_scan


def keep_quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the classifier takes for good ones; it learns from the labelled documents among ``docs``."""
    model = quality.train(docs, common.table(spark, sf_dir, "labels"))
    return quality.score(docs, model).where("quality_score >= 0.5").select(docs.columns)


def keep_one_of_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The document with the smallest id of each group of linked ones."""
    others = near_dedup.near_duplicates(docs).where("component_id <> doc_id").select("doc_id")
    return docs.join(others, "doc_id", "left_anti").select(docs.columns)


def drop_contaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that leak no benchmark item."""
    return decontaminate.find_leaks(docs, common.table(spark, sf_dir, "benchmark")).where(F.size("leaks") == 0).select(docs.columns)


def redact_secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Every document, with its secrets replaced and its length counted anew."""
    return secret_scan.redact_documents(docs).withColumn("n_chars", F.char_length("text").cast("long")).select(docs.columns)


def encode(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """doc_id, n_tokens, token_ids and the decoded text's digest of every document."""
    coded = bpe.encode_documents(docs, queries.VOCABULARY)
    ids = F.when(F.col("n_tokens") > 0, F.split("ids", " ").cast("array<int>")).otherwise(F.array().cast("array<int>"))
    return coded.select("doc_id", "n_tokens", ids.alias("token_ids"), F.sha2("decoded", 256).alias("decoded_sha256"))


STAGES = [
    ("quality classifier", keep_quality),
    ("MinHash near-dedup", keep_one_of_near_duplicates),
    ("benchmark decontamination", drop_contaminated),
    ("secret scans", redact_secrets),
    ("BPE encoding", encode),
]

#: Neither a trained classifier nor a tokenizer can be put in SQL; tests/llm compares with a plain version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, before = common.table(spark, sf_dir, "documents"), None
    for _, stage in STAGES:
        with common.scratch(spark):
            kept = common.cut_lineage(stage(spark, docs, sf_dir))
        if before is not None:
            common.remove(before)  # the stage before, once this one is written; never the input
        docs = before = kept
    return docs
