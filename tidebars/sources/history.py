"""Stored histories: buckets of codes and years that a refresh rewrites only where it has new rows, and what state each code's history is in."""

from __future__ import annotations

import uuid
from collections.abc import Iterable
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.features import dedupe_bars
from . import commits

C = F.col
FORMAT = 1
BUCKETS = 64
NUMBERS = ("open", "high", "low", "close", "volume", "amount", "turnover", "amplitude", "pct_chg", "chg")
_BAR = "code string, date date, " + ", ".join(f"{n} double" for n in NUMBERS) + ", source string, kind string, adjusted int, start date, as_of date"
_STATS = "code string, bars long, checksum long, first_date date, last_date date, format int, source string, kind string, adjusted int, start date, as_of date"
_PLACE = "commit string, bucket int, year int"
STATES = ("missing", "incompatible", "corrupt", "empty", "fresh", "stale_date")


def bucket_of(buckets: int) -> Column:
    return F.pmod(F.xxhash64("code"), F.lit(buckets)).cast("int")


def _checksum() -> Column:
    return F.bit_xor(F.xxhash64("code", "date", *NUMBERS))


def _read(spark: SparkSession, path: str, table: str, parts: dict[str, str], schema: str) -> DataFrame:
    return commits.read_parts(spark, path, table, parts, f"{schema}, {_PLACE}")


def _places(part: str) -> tuple[int, int]:
    bucket, year = (int(x.split("=")[1]) for x in part.split("/"))
    return bucket, year


def upsert_history(bars: DataFrame, path: str, session: str, source: str, kind: str = "stock", adjusted: int = 1, start: str = "1990-01-01", whole: bool = False, buckets: int = BUCKETS) -> int:
    """Puts bars up to the session over the stored ones and returns the store's new version.

    The store is dealt by hash of code and by year. Only the parts (bucket and year) that have new rows are written anew, each as a new
    folder beside the old one, and the manifest that names the parts changes last: other parts' files are never touched or read, readers of older
    versions go on, and a writer that dies leaves the store as it was. Rows of the same code and date are replaced, all others
    stay; with whole, all stored rows of the given codes go. The same bars again give the same rows. Two writers at once: one gets
    commits.Conflict and can run again.

    Of rows that repeat a code and date the last by ingest_seq counts, if there is such a column, else any. Rows without code or date go;
    other columns than NUMBERS aren't stored. Bars without a row up to the session are refused: ValueError. The number of buckets is set by the store's first
    version. Beside the rows each part has a row for each code: its bars, a checksum, and where they come from, which scan_history holds the rows against."""
    spark = bars.sparkSession
    before, old = commits.manifest(spark, path)
    buckets = old.get("buckets", buckets)
    new = bars.where(C("code").isNotNull() & (C("date") <= F.lit(session).cast("date")))
    new = dedupe_bars(new) if "ingest_seq" in bars.columns else new.dropDuplicates(["code", "date"])
    about = {"source": F.lit(source), "kind": F.lit(kind), "adjusted": F.lit(adjusted), "start": F.lit(start).cast("date"), "as_of": F.lit(session).cast("date")}
    numbers = [(C(n).cast("double") if n in bars.columns else F.lit(None).cast("double")).alias(n) for n in NUMBERS]
    rows = new.select("code", "date", *numbers, *(c.alias(k) for k, c in about.items()))
    staged = f"{path}/_staged/{uuid.uuid4().hex}"
    rows.withColumns({"bucket": bucket_of(buckets), "year": F.year("date")}).write.partitionBy("bucket", "year").parquet(staged)
    try:
        fresh = spark.read.schema(f"{_BAR}, bucket int, year int").parquet(staged)
        if fresh.isEmpty():
            raise ValueError("there is no bar up to the session")
        had, by, key = old.get("parts", {}), ["bucket", "year"], ["code"] if whole else ["code", "date"]
        own = lambda touched: {p for p in had if _places(p)[0] in {_places(t)[0] for t in touched}} if whole else touched
        merge = lambda kept, new: kept.join(new.select(*key).distinct(), key, "left_anti").unionByName(new)
        parts, written, name = commits.rewrite_parts(fresh, path, "bars", had, by, f"{_BAR}, {_PLACE}", merge, own)
        _stats(written).repartition(*by).sortWithinPartitions(*by, "code").write.partitionBy(*by).parquet(f"{path}/stats/commit={name}")
        return commits.commit(spark, path, {"buckets": buckets, "format": FORMAT, "parts": parts}, before)
    finally:
        commits.delete(spark, staged)


def _stats(rows: DataFrame) -> DataFrame:
    """A row for each code of each part."""
    newest = F.max_by(F.struct("source", "kind", "adjusted", "start"), "as_of")
    counts = rows.groupBy("bucket", "year", "code").agg(F.count("*").alias("bars"), _checksum().alias("checksum"), F.min("date").alias("first_date"), F.max("date").alias("last_date"), newest.alias("_m"), F.max("as_of").alias("as_of"))
    return counts.select("code", "bars", "checksum", "first_date", "last_date", F.lit(FORMAT).alias("format"), "_m.*", "as_of", "bucket", "year")


def read_history(spark: SparkSession, path: str, since: str | None = None, codes: Iterable[str] | None = None, version: int | None = None) -> DataFrame:
    """The stored bars as of a version (the newest, if not given), with where they come from. since and codes prune parts before any file is listed."""
    parts, buckets = _pruned(spark, path, since, codes, version)
    rows = _read(spark, path, "bars", parts, _BAR).drop("commit", "bucket", "year")
    rows = rows.where(C("date") >= F.lit(since).cast("date")) if since else rows
    return rows.where(C("code").isin(list(codes))) if codes is not None else rows


def _pruned(spark: SparkSession, path: str, since: str | None, codes: Iterable[str] | None, version: int | None) -> tuple[dict[str, str], int]:
    _, now = commits.manifest(spark, path, version)
    parts, buckets = now.get("parts", {}), now.get("buckets", BUCKETS)
    if since:
        parts = {p: c for p, c in parts.items() if _places(p)[1] >= int(since[:4])}
    if codes is not None:
        frame = spark.createDataFrame([(c,) for c in set(codes)], "code string")
        own = {r["bucket"] for r in frame.select(bucket_of(buckets).alias("bucket")).distinct().collect()}
        parts = {p: c for p, c in parts.items() if _places(p)[0] in own}
    return parts, buckets


def scan_history(universe: DataFrame, path: str, expected: str, kind: str = "stock", adjusted: int = 1, start: str = "1990-01-01", sources: tuple[str, ...] = (), since: str | None = None, verify: bool = True, version: int | None = None) -> DataFrame:
    """(code, state, bars, last_date, files) for every code of the universe, by its stored history up to the expected date:

    missing: the store has no row about it. incompatible: written in another format, kind, adjustment or start, or by a source whose name begins with none
    of `sources` (if any are given). corrupt: the rows that are read aren't those that were written, by their number and, with verify, their checksum:
    files that are damaged or gone, or that no writer of the store wrote. empty: no bar up to the date. fresh: the last bar is of the date. Else
    stale_date. files: how many files hold the code's rows, by the files' own metadata.

    since leaves older years' parts out, of rows and of what is known about them alike. Repeated codes of the universe are one row, null codes none."""
    spark, day = universe.sparkSession, F.lit(expected).cast("date")
    parts, _ = _pruned(spark, path, since, None, version)
    year = F.lit(int(since[:4]) if since else 0)
    known = _read(spark, path, "stats", parts, _STATS).where(C("year") >= year)
    right = (C("format") == FORMAT) & (C("kind") == kind) & (C("adjusted") == adjusted) & (C("start") == F.lit(start).cast("date"))
    if sources:
        right = right & reduce(lambda a, b: a | b, (C("source").startswith(s) for s in sources))
    known = known.groupBy("code").agg(F.bool_and(F.coalesce(right, F.lit(False))).alias("_right"), F.sum("bars").alias("_bars"), F.bit_xor("checksum").alias("_sum"))
    stored = _read(spark, path, "bars", parts, _BAR)
    rows = stored.where(C("year") >= year).select("code", "date", *(NUMBERS if verify else ()), C("_metadata.file_path").alias("_file")) if parts else stored.withColumn("_file", F.lit(""))
    upto = C("date") <= day
    found = rows.groupBy("code").agg(
        F.count("*").alias("_n"), (_checksum() if verify else F.lit(None).cast("long")).alias("_found"), F.count_if(upto).alias("bars"), F.max(F.when(upto, C("date"))).alias("last_date"), F.size(F.collect_set("_file")).alias("files"),
    )
    out = universe.where(C("code").isNotNull()).select("code").distinct().join(known, "code", "left").join(found, "code", "left")
    same = F.coalesce(C("_n") == C("_bars"), F.lit(False)) & (F.coalesce(C("_found") == C("_sum"), F.lit(False)) if verify else F.lit(True))
    state = F.when(C("_bars").isNull(), "missing").when(~C("_right"), "incompatible").when(~same, "corrupt").when(C("bars") == 0, "empty").when(C("last_date") == day, "fresh").otherwise("stale_date")
    usable = state.isin("fresh", "stale_date")
    return out.select("code", state.alias("state"), F.when(usable, C("bars")).otherwise(0).alias("bars"), F.when(usable, C("last_date")).alias("last_date"), F.coalesce("files", F.lit(0)).alias("files"))


def vacuum(spark: SparkSession, path: str, keep: int = 2) -> list[str]:
    """Deletes the folders that none of the newest `keep` versions name, and the older manifests; readers that pinned one of those fail afterwards."""
    known = commits.versions(spark, path)
    live, gone = known[-keep:], known[:-keep]
    named = {c for v in live for c in commits.manifest(spark, path, v)[1]["parts"].values()}
    old = {c for v in gone for c in commits.manifest(spark, path, v)[1]["parts"].values()} - named
    for c in sorted(old):
        for table in ("bars", "stats"):
            commits.delete(spark, f"{path}/{table}/commit={c}")
    for v in gone:
        commits.delete(spark, f"{path}/_commits/{v:010d}.json")
    return sorted(old)
