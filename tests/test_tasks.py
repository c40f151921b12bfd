"""How rows are dealt to tasks: sorted once, spread before they multiply, parts of a store in several files."""

from datetime import date, timedelta

from pyspark.sql import functions as F

from tidebars.operators import replay, signals
from tidebars.sources import commits, history


def test_a_share_of_a_day_takes_one_sort(spark):
    df = spark.createDataFrame([(date(2024, 1, 2), x) for x in (3.0, 1.0, 3.0, None, 2.0)], "date date, x double")
    out = signals.pct_rank_average(df, "x", "share")
    assert out._jdf.queryExecution().executedPlan().toString().count("Sort [") == 1
    assert sorted(r["share"] for r in out.where("x IS NOT NULL").collect()) == [0.25, 0.5, 0.875, 0.875]
    assert [r["share"] for r in out.where("x IS NULL").collect()] == [None]


def test_codes_are_spread_over_tasks_before_their_sessions(spark):
    days = [date(2024, 1, 1) + timedelta(i) for i in range(40)]
    sessions = spark.createDataFrame(list(enumerate(days, 1)), "session_no int, date date")
    market = spark.createDataFrame([(f"{i:06d}", days[0], 5.0) for i in range(40)], "code string, date date, close double")
    chosen = market.select("date", "code", F.lit("chip_base_ready").alias("signal"), F.lit(1.0).alias("score_total"), "close", F.lit(6.0).alias("resistance_price"), F.lit(4.0).alias("support_price"))
    out = replay.watchlist_replay(replay.watchlist_events(chosen, market, sessions, 10))
    tasks = out.withColumn("task", F.spark_partition_id()).agg(F.count_distinct("task").alias("n"), F.count("*").alias("rows")).first()
    assert tasks["rows"] == 1600 and tasks["n"] > 1


def test_a_large_part_has_several_files_and_a_code_one(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(commits, "SHARE_BYTES", 1 << 10)
    bars = spark.range(40 * 30).select(F.lpad((F.col("id") % 40).cast("string"), 6, "0").alias("code"), F.date_add(F.lit("2024-01-01").cast("date"), (F.col("id") / 40).cast("int")).alias("date"), (F.col("id") * 7 % 101).cast("double").alias("close"))
    history.upsert_history(bars, str(tmp_path / "a store"), "2024-12-31", "a", buckets=1)
    rows = history.read_history(spark, str(tmp_path / "a store")).select("code", "date", "close", F.col("_metadata.file_path").alias("f"))
    assert rows.select("f").distinct().count() > 1
    assert rows.groupBy("code").agg(F.count_distinct("f").alias("n")).agg(F.max("n")).first()[0] == 1
    assert rows.drop("f").exceptAll(bars).isEmpty() and rows.count() == 1200
    found = history.scan_history(bars.select("code"), str(tmp_path / "a store"), "2024-01-30")
    assert {(r["state"], r["files"]) for r in found.collect()} == {("fresh", 1)}
