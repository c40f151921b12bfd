"""Queries that write the tables out as provider text and read it back, with the SQL of what must come back."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import market
from ..sources import fixture, landed
from . import reference_sql as ref

C = F.col
PRICES = ("open", "high", "low", "close", "volume")


def _text(*columns: str) -> list[Column]:
    return [F.coalesce(C(c).cast("string"), F.lit("-")) for c in columns]


def _twice(lines: Callable[[DataFrame], DataFrame], bars: DataFrame) -> DataFrame:
    """Lines of the bars, and of the even days once more, later and with a close that is 1 higher. The bars are worked out once for both."""
    seq = F.explode(F.when(F.day("date") % 2 == 0, F.array(F.lit(1), F.lit(2))).otherwise(F.array(F.lit(1))))
    return lines(bars.withColumn("seq", seq).withColumn("close", C("close") + C("seq") - 1))


def ingest_csv_bars(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Lines of the 13th of a month are a field short, those of the 14th have no date."""

    def lines(bars: DataFrame) -> DataFrame:
        rest = F.concat_ws(",", *_text(*landed.BAR_FIELDS[1:-1]))
        line = F.concat_ws(",", F.when(F.day("date") == 14, "-").otherwise(C("date").cast("string")), rest, F.when(F.day("date") != 13, C("turnover").cast("string")))
        return bars.select(C("code").cast("int").cast("string").alias("code"), "seq", line.alias("line"))

    return landed.ingest_csv_bars(_twice(lines, fixture.load_bars(spark, sf_dir))).select("code", "date", *PRICES, "amount", "turnover")


def _documents(bars: DataFrame) -> DataFrame:
    """A JSON list for each code, seq and month."""
    row = F.array(C("date").cast("string"), *(C(c).cast("string") for c in landed.ARRAY_FIELDS[1:]), F.lit("x"))
    return bars.groupBy("code", "seq", F.trunc("date", "month").alias("month")).agg(F.to_json(F.collect_list(row)).alias("body")).select("code", "seq", "body")


def ingest_array_bars(spark: SparkSession, sf_dir: str) -> DataFrame:
    return landed.ingest_array_bars(_twice(_documents, fixture.load_bars(spark, sf_dir))).select("code", "date", *PRICES)


def infer_turnover(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A fourth of the instruments each has a quote, a market value, a hint or nothing to infer turnover from."""
    bars = fixture.load_bars(spark, sf_dir).select("code", *landed.ARRAY_FIELDS)
    no = C("code").cast("int")
    basis = fixture.load_universe(spark, sf_dir).select(
        "code", F.when(no % 4 == 0, 500.0).alias("quote_volume"), F.when(no % 4 == 0, 2.5).alias("quote_turnover"), F.when(no % 4 <= 1, C("float_market_cap")).alias("float_market_cap"),
        F.lit(20.0).alias("latest"), F.when(no % 4 == 2, 1.25).alias("turnover_hint"),
    )
    out = landed.infer_turnover(bars, basis)[0]
    return out.select("code", "date", "turnover_source", *(F.round(c, 6).alias(c) for c in ("turnover", "amount", "pct_chg", "chg", "amplitude")))


def ingest_tabular_bars(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Nothing trades on the 9th, and half the opens of the 10th are blank."""

    def lines(bars: DataFrame) -> DataFrame:
        bad = (F.day("date") == 10) & (C("code").cast("int") % 2 == 0)
        row = [c.alias(n) for n, c in zip(("date", *PRICES, "amount"), _text("date", *PRICES, "amount"), strict=True)]
        return bars.select("code", "seq", *row, F.lit("1000").alias("preclose"), C("turnover").cast("string").alias("turn"), F.lit("0.5").alias("pctChg"), F.when(F.day("date") == 9, "0").otherwise("1").alias("tradestatus")).withColumn("open", F.when(~bad, C("open")).otherwise(""))

    out = landed.ingest_tabular_bars(_twice(lines, fixture.load_bars(spark, sf_dir)))
    return out.select("code", "date", "close", "turnover", "pct_chg", "chg", F.round("amplitude", 6).alias("amplitude"))


def ingest_quote_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = spark.read.parquet(f"{sf_dir}/customer.parquet")
    name = F.when(C("c_custkey") % 7 == 0, "").otherwise(C("c_name"))
    body = F.concat_ws(",", name, F.lit("1"), F.lit("2"), C("c_custkey").cast("string"), F.lit("3"), F.lit("4"), F.lit("5"), F.lit("6"), F.when(C("c_custkey") % 5 == 0, "-").otherwise((C("c_custkey") * 3).cast("string")), F.lit("1,5"))
    symbol = F.concat(F.when(C("c_custkey") % 2 == 0, "sh").otherwise("sz"), F.lpad(C("c_custkey").cast("string"), 6, "0"))
    lines = rows.select(F.concat(F.lit("var hq_str_"), symbol, F.lit('="'), body, F.lit('";')).alias("value"))
    return landed.ingest_quote_text(lines).select("code", "name", "market", "latest", "volume", "amount", "turnover")


def ingest_universe_json(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = spark.read.parquet(f"{sf_dir}/supplier.parquet")
    item = F.struct(
        C("s_suppkey").cast("string").alias("f12"), F.concat(F.lit(" "), "s_name").alias("f14"), (C("s_suppkey") % 2).alias("f13"), F.when(C("s_suppkey") % 3 == 0, "-").otherwise(C("s_suppkey").cast("string")).alias("f2"),
        F.format_number(C("s_suppkey") * 1000, 0).alias("f21"), F.lit("1.5%").alias("f8"),
    )
    pages = rows.groupBy(F.floor(C("s_suppkey") / 50).alias("page")).agg(F.to_json(F.struct(F.struct(F.collect_list(item).alias("diff")).alias("data"))).alias("body"))
    return landed.ingest_universe_json(pages).select("code", "name", "market", "latest", "float_market_cap", "turnover", "amount")


def ingest_listing(spark: SparkSession, sf_dir: str) -> DataFrame:
    front = F.element_at(F.array(*map(F.lit, (*market.MAIN_BOARD, "399", "688"))), (C("c_custkey") % 10 + 1).cast("int"))
    code = F.concat(F.when(C("c_custkey") % 3 == 0, "sh.").otherwise("sz."), front, F.lpad((C("c_custkey") % 1000).cast("string"), 3, "0"))
    rows = spark.read.parquet(f"{sf_dir}/customer.parquet").select(code.alias("code"), C("c_name").alias("code_name"), (C("c_custkey") % 2).cast("string").alias("tradeStatus"))
    return landed.ingest_listing(rows).select("code", "name", "market", "trade_status", "latest")


def ingest_fund_flow(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Lines of the 13th are a field short, those of the 14th have no main inflow."""
    flow = fixture.load_flow(spark, sf_dir)
    main = F.when(F.day("date") == 14, "-").otherwise(C("main_net_inflow_amount").cast("string"))
    line = F.concat_ws(",", C("date").cast("string"), main, *(F.lit(str(i)) for i in range(12)), F.when(F.day("date") != 13, "0"))
    out = landed.ingest_fund_flow(flow.select("code", F.lit(0).alias("seq"), line.alias("line")))
    return out.select("code", "date", "main_net_inflow_amount", "small_net_inflow_amount", "super_large_net_inflow_ratio_pct", "close", "pct_chg")


def parse_number(spark: SparkSession, sf_dir: str) -> DataFrame:
    n = C("p_partkey")
    text = F.when(n % 4 == 0, F.format_number(n * 1000, 0)).when(n % 4 == 1, F.concat(n.cast("string"), F.lit("%"))).when(n % 4 == 2, "-").otherwise(n.cast("string"))
    return spark.read.parquet(f"{sf_dir}/part.parquet").select("p_partkey", market.parse_number(text).alias("number"))


def universe_completeness(spark: SparkSession, sf_dir: str) -> DataFrame:
    universe = fixture.load_universe(spark, sf_dir).select(F.floor(C("code").cast("int") / 50).alias("page"), "code")
    return landed.universe_completeness(universe.where(C("code").cast("int") % 100 != 0), 100)


def latest_complete_session(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Just before the last session's bar is complete: 15:09 in the exchange's zone."""
    return landed.latest_complete_session(fixture.load_sessions(fixture.load_bars(spark, sf_dir)), "2001-12-31 07:09:00")


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    f.__name__: f for f in (ingest_csv_bars, ingest_array_bars, infer_turnover, ingest_tabular_bars, ingest_quote_text, ingest_universe_json, ingest_listing, ingest_fund_flow, parse_number, universe_completeness, latest_complete_session)
}

_B = f"WITH {ref.BARS}"
_LAST = "CASE WHEN day(date) % 2 = 0 THEN close + 1 ELSE close END"
_CODE = "lpad(CAST(c_custkey AS VARCHAR), 6, '0')"
_FRONT = f"[{', '.join(repr(p) for p in (*market.MAIN_BOARD, '399', '688'))}][c_custkey % 10 + 1]"
ORACLES: dict[str, str] = {
    "ingest_csv_bars": f"{_B} SELECT code, date, open, high, low, {_LAST} AS close, volume, amount, turnover FROM bars WHERE day(date) NOT IN (13, 14)",
    "ingest_array_bars": f"{_B} SELECT code, date, open, high, low, {_LAST} AS close, volume FROM bars",
    "infer_turnover": f"""{_B}, cap AS (SELECT lpad(CAST(s_suppkey AS VARCHAR), 6, '0') AS code, abs(s_acctbal) * 1e6 AS cap FROM supplier JOIN nation ON s_nationkey = n_nationkey),
      last AS (SELECT code, arg_max(volume, date) AS v FROM bars GROUP BY 1),
      unit AS (SELECT last.code, CASE CAST(last.code AS INTEGER) % 4 WHEN 0 THEN 20000 WHEN 1 THEN cap / 2000 WHEN 2 THEN v * 100 / 1.25 END AS u,
      CASE CAST(last.code AS INTEGER) % 4 WHEN 0 THEN 'turnover_from_quote' WHEN 1 THEN 'turnover_from_float_market_cap' WHEN 2 THEN 'turnover_from_snapshot_hint' END AS turnover_source FROM last JOIN cap USING (code)),
      past AS (SELECT *, lag(close) OVER (PARTITION BY code ORDER BY date) AS p FROM bars)
      SELECT code, date, turnover_source, round(volume / u * 100, 6) AS turnover, round(volume * 100 * (open + high + low + close) / 4, 6) AS amount, round((close / p - 1) * 100, 6) AS pct_chg,
      round(close - p, 6) AS chg, round((high - low) * 100 / p, 6) AS amplitude FROM past JOIN unit USING (code) WHERE turnover_source IS NOT NULL AND u > 0""",
    "ingest_tabular_bars": f"""{_B} SELECT code, date, {_LAST} AS close, turnover, CAST(0.5 AS DOUBLE) AS pct_chg, {_LAST} - 1000 AS chg, round((high - low) * 100 / 1000, 6) AS amplitude FROM bars
      WHERE day(date) <> 9 AND NOT (day(date) = 10 AND CAST(code AS INTEGER) % 2 = 0)""",
    "ingest_quote_text": f"""SELECT {_CODE} AS code, c_name AS name, CASE WHEN c_custkey % 2 = 0 THEN 'sh' ELSE 'sz' END AS market, CAST(c_custkey AS DOUBLE) AS latest,
      CASE WHEN c_custkey % 5 <> 0 THEN CAST(c_custkey * 3 AS DOUBLE) END AS volume, CAST(1 AS DOUBLE) AS amount, CAST(NULL AS DOUBLE) AS turnover FROM customer WHERE c_custkey % 7 <> 0""",
    "ingest_universe_json": """SELECT lpad(CAST(s_suppkey AS VARCHAR), 6, '0') AS code, s_name AS name, CAST(s_suppkey % 2 AS VARCHAR) AS market, CASE WHEN s_suppkey % 3 <> 0 THEN CAST(s_suppkey AS DOUBLE) END AS latest,
      CAST(s_suppkey * 1000 AS DOUBLE) AS float_market_cap, CAST(1.5 AS DOUBLE) AS turnover, CAST(NULL AS DOUBLE) AS amount FROM supplier""",
    "ingest_listing": f"""SELECT {_FRONT} || lpad(CAST(c_custkey % 1000 AS VARCHAR), 3, '0') AS code, c_name AS name, CASE WHEN c_custkey % 3 = 0 THEN 'sh' ELSE 'sz' END AS market, CAST(c_custkey % 2 AS DOUBLE) AS trade_status,
      CAST(NULL AS DOUBLE) AS latest FROM customer WHERE (c_custkey % 3 = 0 AND c_custkey % 10 < 4) OR (c_custkey % 3 <> 0 AND c_custkey % 10 BETWEEN 4 AND 7)""",
    "ingest_fund_flow": f"""{_B} SELECT code, date, inflow AS main_net_inflow_amount, CAST(0 AS DOUBLE) AS small_net_inflow_amount, CAST(8 AS DOUBLE) AS super_large_net_inflow_ratio_pct, CAST(9 AS DOUBLE) AS close, CAST(10 AS DOUBLE) AS pct_chg
      FROM bars WHERE day(date) NOT IN (13, 14)""",
    "parse_number": "SELECT p_partkey, CAST(CASE p_partkey % 4 WHEN 0 THEN p_partkey * 1000 WHEN 2 THEN NULL ELSE p_partkey END AS DOUBLE) AS number FROM part",
    "universe_completeness": """SELECT count(*) AS codes, 0 AS repeated_pages, count(*) >= 98 AS complete FROM supplier JOIN nation ON s_nationkey = n_nationkey WHERE s_suppkey % 100 <> 0""",
    "latest_complete_session": f"{_B} SELECT max(date) AS session FROM bars WHERE date < DATE '2001-12-31'",
}
