"""Features that go on from a state of each code, where a refresh brings some weeks of new bars and the years before needn't be read."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.frames import W
from . import market
from .features import MEANS, NUMBERS, all_features, fill_change_cols, in_order, prepared

C = F.col
#: How many bars a feature looks back at most (the position among 250), and how many days a refresh may rewrite.
BACK, REFRESH_DAYS = 250, 30
_STARTED = 15  # bars until every mean has a value
_BAR = ("date", *NUMBERS)


def _numbered(bars: DataFrame) -> DataFrame:
    """Bars with _no, their number in the whole history, of which a state may hold that of the first."""
    return bars.withColumn("_no", F.row_number().over(W()).cast("long") + (F.coalesce(C("before"), F.lit(0)) if "before" in bars.columns else F.lit(0)))


def carry(bars: DataFrame, refresh_days: int = REFRESH_DAYS, back: int = BACK) -> DataFrame:
    """A row for each code (code, before, seeds, tail): tail, its last bars from `back` before the first that the next refresh may rewrite on; seeds,
    the exponential means as of the tail's first bar; before, the number of bars before it. Codes whose whole history is no longer have all of it
    as tail, no seeds and before 0. bars are a whole history, or prepared bars with the columns before and seeds of an earlier state."""
    df = bars if "seeds" in bars.columns else prepared(bars)
    df = _numbered(fill_change_cols(in_order(df, tuple(MEANS))))
    whole = Window.partitionBy("code")
    cut = F.date_sub(F.max("date").over(whole), refresh_days)
    df = df.withColumn("_cut", F.max(F.when(C("date") <= cut, C("_no"))).over(whole))
    first = C("_cut") - back
    anchored = F.coalesce(first >= _STARTED, F.lit(False))
    count = lambda x: C("_no") - 1 if x in ("gain", "loss") else C("_no")
    means = F.struct(*(F.struct(C(name).alias("value"), count(x).alias("n")).alias(name) for name, (x, _, _) in MEANS.items()))
    rows = df.where(~anchored | (C("_no") >= first)).select("code", "_no", F.struct(*_BAR).alias("bar"), F.when(anchored & (C("_no") == first), means).alias("means"))
    kept = rows.groupBy("code").agg(F.min("_no").alias("_no"), F.max("means").alias("seeds"), F.array_sort(F.collect_list("bar")).alias("tail"))  # back + refresh_days bars, or a short history
    return kept.select("code", (C("_no") - 1).alias("before"), "seeds", "tail")


def _with_state(rows: DataFrame, state: DataFrame) -> DataFrame:
    return rows.join(state.select("code", "before", "seeds"), "code", "left")


def refresh(state: DataFrame, new: DataFrame, refresh_days: int = REFRESH_DAYS, least: int = 3) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Features of the new bars of each code and of its bars after them, as feature_panel of the whole history would give, with bars, their number in
    it; the state after the refresh; and the codes that need a whole history again.

    Only the state and the new bars are read. New bars are put over those of the state's tail under market.merge_incremental's rule: codes whose closes
    disagree, those that share fewer than `least` dates with it, and those without a state are the ones to rebuild, and have no features here. New bars
    may begin refresh_days before the state's last bar, not earlier: rows before that are left out. Codes without new bars keep their state.
    Sums of whole volumes are exact; means agree with those of a whole run to rounding."""
    tail = state.select("code", F.explode("tail").alias("bar")).select("code", "bar.*")
    last = state.select("code", F.date_sub(F.array_max(F.transform("tail", lambda b: b["date"])), refresh_days).alias("_from"))
    fresh = prepared(new).select("code", *_BAR).join(last, "code", "left").where(C("_from").isNull() | (C("date") >= C("_from"))).drop("_from")
    merged, rebuild = market.merge_incremental(tail, fresh, least)
    rows = _with_state(merged, state)
    started = fresh.join(rebuild, "code", "left_anti").groupBy("code").agg(F.min("date").alias("_since"))
    found = _numbered(all_features(rows)).withColumnRenamed("_no", "bars").drop("before", "seeds")
    found = found.join(started, "code").where(C("date") >= C("_since")).drop("_since")
    return found, carry(rows, refresh_days), rebuild


def snapshot_of(state: DataFrame, features: DataFrame) -> DataFrame:
    """The last bar's features of each code that has new ones."""
    latest: Column = F.row_number().over(Window.partitionBy("code").orderBy(C("date").desc()))
    return features.join(state.select("code"), "code", "left_semi").withColumn("_at", latest).where("_at = 1").drop("_at")
