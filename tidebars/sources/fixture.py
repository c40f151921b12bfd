"""Bars and their companions, derived from the star-schema tables in whole cents, so that sums are exact."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window, WindowSpec
from pyspark.sql import functions as F

from . import commits

PART_BYTES = 1 << 21  # of stored lines, some 250,000, to a task


def _read(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{table}.parquet")


def _days(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One row for each instrument and trading day, on a calendar that ends on the same day for all. Rows are dealt by code once, before anything is
    summed (a day has hardly more than one), so neither this nor the windows by code that follow move them again."""
    cents = lambda c: F.round(F.col(c) * 100).cast("long")
    side = F.when(F.col("l_returnflag") == "A", 1).when(F.col("l_returnflag") == "R", -1).otherwise(0)
    rows = _read(spark, sf_dir, "lineitem").select(
        F.lpad(F.col("l_suppkey").cast("string"), 6, "0").alias("code"), F.col("l_suppkey").alias("k"), F.to_date("l_shipdate").alias("d"), (cents("l_discount") - 5).alias("r"), cents("l_tax").alias("tax"),
        F.col("l_quantity").alias("volume"), (side * cents("l_extendedprice")).alias("inflow"),
    )
    parts = max(spark.sparkContext.defaultParallelism, commits.size(spark, f"{sf_dir}/lineitem.parquet") // PART_BYTES + 1)  # else adaptive joining of partitions makes some as large as tasks can hold
    days = rows.repartition(parts, "code").groupBy("code", "k", "d").agg(F.sum("r").alias("r"), F.max("tax").alias("hi"), F.min("tax").alias("lo"), F.sum("volume").alias("volume"), F.sum("inflow").alias("inflow"))
    after = F.count("*").over(_own_days().rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)) - F.row_number().over(_own_days())
    return days.withColumn("date", F.date_sub(F.lit("2001-12-31").cast("date"), after.cast("int")))


def _own_days() -> WindowSpec:
    return Window.partitionBy("code", "k").orderBy("d")


def load_bars(spark: SparkSession, sf_dir: str) -> DataFrame:
    """code, date, open, high, low, close, volume, amount, turnover, amplitude, pct_chg and chg; the last three are null."""
    close = _days(spark, sf_dir).withColumn("close", F.floor(2000 * F.exp(F.sum("r").over(_own_days()) / 200)))
    open_ = close.withColumn("open", F.coalesce(F.lag("close").over(_own_days()), F.col("close")))
    bars = open_.withColumns({"high": F.expr("greatest(open, close) * (400 + hi) div 400"), "low": F.expr("least(open, close) * (400 - lo) div 400")})
    nothing = F.lit(None).cast("double")
    return bars.select(
        "code", "date", *(F.col(c).cast("double").alias(c) for c in ("open", "high", "low", "close", "volume")), (F.col("volume") * F.col("close")).cast("double").alias("amount"),
        (F.col("volume") / 10).alias("turnover"), nothing.alias("amplitude"), nothing.alias("pct_chg"), nothing.alias("chg"),
    )


def load_benchmark(spark: SparkSession, sf_dir: str) -> DataFrame:
    """date and close of one index over all instruments. Its days are as many as the calendar's, whatever the data."""
    day = _days(spark, sf_dir).groupBy("date").agg(F.floor(F.sum("r") / F.count("*").cast("double")).alias("r"))
    return day.select(F.lit("index").alias("code"), "date", F.floor(2000 * F.exp(F.sum("r").over(Window.orderBy("date")) / 200)).cast("double").alias("close"))


def load_universe(spark: SparkSession, sf_dir: str) -> DataFrame:
    s, n = _read(spark, sf_dir, "supplier"), _read(spark, sf_dir, "nation")
    return s.join(n, s["s_nationkey"] == n["n_nationkey"]).select(
        F.lpad(F.col("s_suppkey").cast("string"), 6, "0").alias("code"), F.when(F.col("s_suppkey") % 17 == 0, F.concat(F.lit("*ST "), "s_name")).otherwise(F.col("s_name")).alias("name"),
        F.col("n_name").alias("market"), (F.abs(F.col("s_acctbal")) * 1e6).alias("float_market_cap"), (F.col("s_suppkey") % 23 == 0).alias("is_delisting"),
    )


def load_flow(spark: SparkSession, sf_dir: str) -> DataFrame:
    """code, date and main_net_inflow_amount in cents."""
    return _days(spark, sf_dir).select("code", "date", F.col("inflow").cast("double").alias("main_net_inflow_amount"))


def load_sessions(bars: DataFrame) -> DataFrame:
    """date and session_no of the days that any instrument traded on; a calendar, so small whatever the data."""
    return bars.select("date").distinct().withColumn("session_no", F.row_number().over(Window.orderBy("date")))
