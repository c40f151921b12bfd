"""Universe, sessions, freshness and the merge of refreshed histories."""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.frames import W, ago, pct, yes

C = F.col
# The main boards' code prefixes.
MAIN_BOARD = ("600", "601", "603", "605", "000", "001", "002", "003")


def normalize_code(code: Column) -> Column:
    """The code with zeros in front, six characters at least; longer codes stay whole."""
    return F.when(F.length(code) >= 6, code).otherwise(F.lpad(code, 6, "0"))


def is_mainboard(code: Column) -> Column:
    return F.substring(code, 1, 3).isin(*MAIN_BOARD)


def market_symbol(code: Column) -> dict[str, Column]:
    """A code in the three forms that providers use."""
    sh = F.substring(code, 1, 3).isin(*MAIN_BOARD[:4])
    return {"secid": F.concat(F.when(sh, "1.").otherwise("0."), code), "prefixed": F.concat(F.when(sh, "sh").otherwise("sz"), code), "dotted": F.concat(F.when(sh, "sh.").otherwise("sz."), code)}


def parse_number(text: Column) -> Column:
    """A number written with thousands separators or a per cent sign; null for anything else."""
    return F.regexp_replace(text, "[,%]", "").try_cast("double")


# Fixed value: the sign in the names of instruments that leave the exchange.
LEAVING = "\u9000"


def filter_universe(universe: DataFrame, mainboard: bool = True, leaving: str = LEAVING) -> DataFrame:
    """Instruments that are on a main board, not under special treatment and not leaving; one row a code, the first in order of its columns.

    Both states are read from the name, so any ingested universe will do; a column is_delisting, if there is one, counts beside it. A null name has
    neither sign. Rows without a code go; an empty table gives an empty one. min_universe in Params says how many must be left."""
    df = universe.where(C("code").isNotNull()).withColumn("code", normalize_code(C("code").cast("string")))
    leaves = yes(C("name").contains(leaving)) | (yes(C("is_delisting").cast("boolean")) if "is_delisting" in universe.columns else F.lit(False))
    df = df.where(~yes(F.upper("name").contains("ST")) & ~leaves)
    df = df.where(is_mainboard(C("code"))) if mainboard else df
    rest = [c for c in df.columns if c != "code"]
    return df.groupBy("code").agg(F.min(F.struct(*rest)).alias("_row")).select(*(C("code") if c == "code" else C("_row")[c].alias(c) for c in df.columns))


CONTEXT = ("market_cap", "float_market_cap", "main_net_inflow_amount", "main_net_inflow_ratio_pct")


def join_universe_context(df: DataFrame, universe: DataFrame) -> DataFrame:
    """df with the universe's market values and inflows, as far as the universe has such columns. Codes are brought to one form."""
    own = [c for c in CONTEXT if c in universe.columns]
    return df.drop(*own).join(universe.select(normalize_code(C("code").cast("string")).alias("code"), *own).dropDuplicates(["code"]), "code", "left")


def names_lookup(df: DataFrame, universe: DataFrame) -> DataFrame:
    """df with each code's name, empty for codes that the universe doesn't have."""
    return df.drop("name").join(universe.select("code", "name").dropDuplicates(["code"]), "code", "left").withColumn("name", F.coalesce("name", F.lit("")))


def benchmark_context(benchmark: DataFrame) -> DataFrame:
    """date, the index's returns over 20 and 60 bars, and whether its trend bears risk: the close at most 3 % under its mean of 20
    bars and the return over 20 bars above -8 %."""
    past = lambda n: pct(C("close"), ago("close", n))
    ok = yes(C("close") >= F.avg("close").over(W().rowsBetween(-19, 0)) * 0.97) & yes(past(20) > -8)
    return benchmark.select("date", *(past(n).alias(f"benchmark_return_{n}d_pct") for n in (20, 60)), ok.cast("int").alias("benchmark_risk_ok"))


def fetch_status(universe: DataFrame, bars: DataFrame, session: str, least: int) -> DataFrame:
    """code, bars, last_date and status of each instrument: ok, failed (no rows), stale_hist or insufficient_bars."""
    have = bars.groupBy("code").agg(F.count("*").alias("bars"), F.max("date").alias("last_date"))
    status = F.when(C("bars").isNull(), "failed").when(C("last_date") < F.lit(session).cast("date"), "stale_hist").when(C("bars") < least, "insufficient_bars").otherwise("ok")
    return universe.select("code").join(have, "code", "left").select("code", F.coalesce("bars", F.lit(0)).alias("bars"), "last_date", status.alias("status"))


def coverage_gate(status: DataFrame, least_pct: float) -> DataFrame:
    """One row: universe, ok, coverage in per cent, and whether the run is valid."""
    n = status.agg(F.count("*").alias("universe"), F.count_if(C("status") == "ok").alias("ok"))
    return n.withColumn("coverage_pct", F.round(C("ok") / F.when(C("universe") > 0, C("universe")) * 100, 2)).withColumn("valid", F.coalesce(C("coverage_pct") >= least_pct, F.lit(False)))


MOST_DAYS = 200_000  # of a calendar, some centuries


def calendar_of(sessions: DataFrame) -> DataFrame:
    """One row (first, upto, dates): the calendar as arrays to broadcast. upto has for each day from the first session on how many sessions there were by
    then, dates the sessions in order. Its size is that of the calendar's span, which is checked, however many rows are looked up."""
    spark = sessions.sparkSession
    days = [r["date"] for r in sessions.where(C("date").isNotNull()).select("date").distinct().limit(MOST_DAYS + 1).collect()]
    if len(days) > MOST_DAYS or (days and (max(days) - min(days)).days > MOST_DAYS):
        raise ValueError(f"a calendar of more than {MOST_DAYS} days")
    days.sort()
    marks = np.zeros((days[-1] - days[0]).days + 1 if days else 0, np.int32)
    marks[[(d - days[0]).days for d in days]] = 1
    return spark.createDataFrame([(days[0] if days else None, np.cumsum(marks).tolist(), days)], "first date, upto array<int>, dates array<date>")


def _sessions_upto(day: Column) -> Column:
    """How many sessions there are up to a day, by one look into calendar_of's array."""
    at = F.datediff(day, C("first"))
    return F.when(F.size("upto") == 0, 0).when(at < 0, 0).when(at.isNotNull(), F.get("upto", F.least(at, F.size("upto") - 1)))


def session_offset(sessions: DataFrame, count: int) -> DataFrame:
    """date and the date that many sessions later (earlier, if negative), null beyond the calendar. Every session is looked up in the broadcast calendar."""
    then = _sessions_upto(C("date")) - 1 + count
    return sessions.crossJoin(F.broadcast(calendar_of(sessions))).select("date", F.when(then >= 0, F.get("dates", then)).alias("target"))  # one row


def sessions_between(pairs: DataFrame, sessions: DataFrame) -> DataFrame:
    """pairs (start, end) with n: the sessions from start to end less one, 0 if there is none; null dates count none. Any two dates are looked up in the broadcast
    calendar, each by its distance from the first session: no search, no join and no order over the pairs."""
    own = pairs.select("start", "end").crossJoin(F.broadcast(calendar_of(sessions)))  # one row
    n = _sessions_upto(C("end")) - _sessions_upto(F.date_sub(C("start"), 1)) - 1
    return own.select("start", "end", F.coalesce(F.greatest(n, F.lit(0)), F.lit(0)).cast("long").alias("n"))


def merge_incremental(old: DataFrame, new: DataFrame, least: int = 3) -> tuple[DataFrame, DataFrame]:
    """Histories with refreshed rows put over the old ones, and the codes that need a full rebuild.

    A code merges if at least `least` dates have a close in both and all of those agree within 0.011 plus 0.15 % of the new one."""
    both = old.select("code", "date", C("close").alias("was")).join(new.select("code", "date", C("close").alias("now")), ["code", "date"])
    ok = both.groupBy("code").agg(((F.count(C("was") + C("now")) >= least) & F.bool_and(F.abs(C("was") - C("now")) <= 0.011 + 0.0015 * F.abs("now"))).alias("ok"))
    codes = new.select("code").distinct().join(ok, "code", "left").withColumn("ok", F.coalesce("ok", F.lit(False)))
    fresh = new.join(codes.where("ok").select("code"), "code", "left_semi").withColumn("_seq", F.lit(1))
    latest = Window.partitionBy("code", "date").orderBy(C("_seq").desc())
    merged = old.withColumn("_seq", F.lit(0)).unionByName(fresh).withColumn("_at", F.row_number().over(latest)).where("_at = 1").drop("_at", "_seq")
    return merged, codes.where(~C("ok")).select("code")


def join_evidence_asof(df: DataFrame, evidence: DataFrame, as_of: str, columns: tuple[str, ...]) -> DataFrame:
    """df with the columns of each code's newest evidence row up to as_of, whole rows; its values win over df's own."""
    row = F.max_by(F.struct(*columns), "date")
    last = evidence.where(C("date") <= F.lit(as_of).cast("date")).groupBy("code").agg(F.max("date").alias("evidence_date"), row.alias("_e"))
    out = df.join(last, "code", "left")
    return out.withColumns({c: F.coalesce(C("_e")[c], C(c)) if c in df.columns else C("_e")[c] for c in columns}).drop("_e")


def join_evidence_panel(panel: DataFrame, evidence: DataFrame, columns: tuple[str, ...]) -> DataFrame:
    """panel (code, date and any columns) with the columns of the newest evidence row of its code up to each row's own date, and that row's date as
    evidence_date: what was known on the day, so a backtest may use it. Whole rows of evidence count; their values win over the panel's own, where they have one.

    Both sides meet in one order of code and date, and the last evidence row is carried along: as many rows as both have, however many evidence rows a
    code has. Evidence of a day comes before the panel's rows of the day; of evidence rows that repeat a code and date the greatest counts. Rows
    without code or date get nothing."""
    row, own = F.struct(*(C(c) for c in columns)), [c for c in panel.columns if c != "evidence_date"]
    news = evidence.where(C("code").isNotNull() & C("date").isNotNull()).groupBy("code", "date").agg(F.max(row).alias("_e"))
    kind = panel.select(*own).schema
    left = panel.select("code", "date", F.lit(1).alias("_side"), F.struct(*own).alias("_row"), F.lit(None).cast(f"struct<at:date,row:{news.schema['_e'].dataType.simpleString()}>").alias("_news"))
    right = news.select("code", "date", F.lit(0).alias("_side"), F.lit(None).cast(kind).alias("_row"), F.struct(C("date").alias("at"), C("_e").alias("row")).alias("_news"))
    line = Window.partitionBy("code").orderBy("date", "_side").rowsBetween(Window.unboundedPreceding, 0)
    last = F.when(C("code").isNotNull() & C("date").isNotNull(), F.last("_news", ignorenulls=True).over(line))
    out = left.unionByName(right).withColumn("_last", last).where("_side = 1")
    shown = [C("_row")[c].alias(c) if c not in columns else F.coalesce(C("_last.row")[c], C("_row")[c]).alias(c) for c in own]
    return out.select(*shown, C("_last.at").alias("evidence_date"), *(C("_last.row")[c].alias(c) for c in columns if c not in own))
