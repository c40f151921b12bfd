"""Transitions that a stream adds to their history exactly once."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.replay import append_transitions
from ..sources import commits

C = F.col
ROW = "date date, code string, from_state string, to_state string, signals string, close double"
_PLACE = "commit string, month string"


def read_transitions(spark: SparkSession, path: str, version: int | None = None) -> DataFrame:
    """The history as of a version, the newest if not given."""
    _, now = commits.manifest(spark, path, version)
    return commits.read_parts(spark, path, "transitions", now.get("parts", {}), f"{ROW}, {_PLACE}").drop("commit", "month")


def add_transitions(rows: DataFrame, path: str, stream: str, batch: int) -> bool:
    """Puts a stream's batch over the history, of rows with the same date, code, from_state and to_state the new one staying, and says whether it did: a batch that
    the history holds already, or an older one, changes nothing.

    Only the months that have new rows are written anew, beside the old ones; the manifest that names them also holds each stream's last
    batch, so rows and batch number are seen together or not at all. Rows without a date have no place in a history and go; of rows that repeat a key within
    the batch any stays. An empty batch is noted like any other."""
    spark = rows.sparkSession
    before, old = commits.manifest(spark, path)
    batches = old.get("batches", {})
    if batches.get(stream, -1) >= batch:
        return False
    staged = f"{path}/_staged/{stream}-{batch}"
    names = [f.split()[0] for f in ROW.split(", ")]
    once = append_transitions(rows.limit(0).select(*names), rows.where(C("date").isNotNull()).select(*names))
    once.select(*names, F.date_format("date", "yyyy-MM").alias("month")).write.mode("overwrite").parquet(staged)
    try:
        fresh = spark.read.schema(f"{ROW}, month string").parquet(staged)
        merge = lambda kept, new: append_transitions(kept.drop("month"), new.drop("month")).withColumn("month", F.date_format("date", "yyyy-MM"))
        parts = old.get("parts", {})
        if not fresh.isEmpty():
            parts, _, _ = commits.rewrite_parts(fresh, path, "transitions", parts, ["month"], f"{ROW}, {_PLACE}", merge)
        commits.commit(spark, path, {"parts": parts, "batches": batches | {stream: batch}}, before)
    finally:
        commits.delete(spark, staged)
    return True


def transitions_sink(path: str, stream: str) -> Callable[[DataFrame, int], None]:
    """For writeStream.foreachBatch: a batch that is run again after a failure leaves the history as one run would."""

    def add(rows: DataFrame, batch: int) -> None:
        add_transitions(rows, path, stream, batch)

    return add
