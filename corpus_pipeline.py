"""Cleans and packs a corpus: quality, toxicity, near duplicates, secrets, then sequences for training."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidebars.llm import near_dup, neural, packing, secrets
from tidebars.llm.common import as_table, drop_tables, free_name, scratch_path, scratch_tables
from tidebars.llm.queries import WORD_TOKENS

COLUMNS = ("doc_id", "text", "lang", "source", "n_chars")


def _labels(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/labels.parquet")


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops rows whose probability of good quality is under one half. Each row is judged by its own text (null: empty), so ids may be
    null or repeated; other columns may have any names. An empty table gives an empty one."""
    score = free_name(docs, "score")
    return neural.quality_scores(docs, _labels(spark, sf_dir), whole=True, out=score).where(F.col(score) >= 0.5).select(docs.columns)


def toxicity(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops rows whose probability of being toxic is 0.3 or more. Rows, columns and empty tables as in quality."""
    score = free_name(docs, "score")
    return neural.toxicity_scores(docs, _labels(spark, sf_dir), whole=True, out=score).where(F.col(score) < 0.3).select(docs.columns)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps one row of each group of near duplicates (similarity 0.8 or more), the first of those with the smallest id; null ids
    come last. Rows are told apart by a number of their own, so ids may be null or repeated. Rows without words stay."""
    row = free_name(docs, "_row")
    keyed = as_table(docs.withColumn(row, F.monotonically_increasing_id()), "keyed")
    found = near_dup.near_duplicates(keyed.select(F.col(row).alias("doc_id"), "text"), 80)
    order = F.struct(F.col("doc_id").isNull().alias("last"), "doc_id", F.col(row).alias("row"))
    first = found.select(F.col("doc_id").alias(row), "component_id").join(keyed.select(row, "doc_id"), row).groupBy("component_id").agg(F.min(order).alias("first"))
    return keyed.join(first.select(F.col("first.row").alias(row)), row, "left_semi").select(docs.columns)


def secret_scan(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Puts a mark in the place of every secret; rows stay, whatever their ids, null and empty texts as they are. n_chars, where there is such a column,
    follows. Other columns may have any names. An empty table gives an empty one."""
    spans = free_name(docs, "spans")
    ledger = as_table(secrets.scan_new_blobs(docs), "ledger")
    clean = secrets.join_findings(docs, ledger, out=spans).withColumn("text", secrets.redact(F.col("text"), F.col(spans)))
    if "n_chars" in docs.columns:
        clean = clean.withColumn("n_chars", F.length("text").cast(docs.schema["n_chars"].dataType))
    return clean.select(docs.columns)


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of the texts in sequences of at most 2048 tokens. Null and empty texts are a piece of one token each, long texts are cut, repeated rows and ids
    are packed each, other columns aren't read. An empty table gives an empty one."""
    return packing.pack_documents(docs, public_tokenizers.path(WORD_TOKENS))


STAGES = [(f.__name__, f) for f in (quality, toxicity, near_duplicates, secret_scan, pack)]
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over documents; each stage's rows are written to the shared folder and read by the next. A stage's own tables go when its rows
    are written, and its rows when the next stage's are; those that the result reads stay."""
    docs, last = spark.read.parquet(f"{sf_dir}/documents.parquet"), []
    for name, stage in STAGES[:-1]:
        with scratch_tables(spark):
            path, out = scratch_path(spark, name, keep=True), stage(spark, docs, sf_dir)
            out.write.option("compression", "zstd").parquet(path)
        drop_tables(spark, last)
        docs, last = spark.read.schema(out.schema).parquet(path), [path]
    return STAGES[-1][1](spark, docs, sf_dir)
