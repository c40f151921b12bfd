"""Landed provider text as typed rows: bars, quotes, universes, fund flow and evidence.

Every reader takes a DataFrame of raw lines or documents, so that Spark splits the files; a row that can't be read is
dropped by rule, never an error. Where lines repeat a key, the one with the highest `seq` wins."""

from __future__ import annotations

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.frames import ago, over
from ..operators.market import MAIN_BOARD, normalize_code, parse_number

C = F.col
# The order of fields in providers' answers.
BAR_FIELDS = ("date", "open", "close", "high", "low", "volume", "amount", "amplitude", "pct_chg", "chg", "turnover")
ARRAY_FIELDS = ("date", "open", "close", "high", "low", "volume")
FLOW_FIELDS = (
    "date", "main_net_inflow_amount", "small_net_inflow_amount", "medium_net_inflow_amount", "large_net_inflow_amount", "super_large_net_inflow_amount",
    "main_net_inflow_ratio_pct", "small_net_inflow_ratio_pct", "medium_net_inflow_ratio_pct", "large_net_inflow_ratio_pct", "super_large_net_inflow_ratio_pct", "close", "pct_chg",
)
FLOW_WIDTH = 15  # the last two are not used
ITEM_FIELDS = {
    "latest": "f2", "pct_chg": "f3", "volume": "f5", "amount": "f6", "turnover": "f8", "market_cap": "f20", "float_market_cap": "f21",
    "main_net_inflow_amount": "f62", "main_net_inflow_ratio_pct": "f184",
}
UNIVERSE_NUMBERS = tuple(ITEM_FIELDS)
REQUIRED = ("date", "open", "high", "low", "close", "volume")


def _number(text: Column) -> Column:
    """A plain number; null for anything else, NaN included. Text without a digit, or an infinity's i, isn't tried: every try that fails
    raises an exception within Spark, which takes longer than the rest of a line."""
    x = F.trim(text)
    return F.when(x.rlike("[0-9iI]"), F.nanvl(x.try_cast("double"), F.lit(None).cast("double")))


def _fields(parts: Column, names: tuple[str, ...]) -> list[Column]:
    return [F.trim(F.get(parts, F.lit(i))).try_cast("date").alias(n) if n == "date" else _number(F.get(parts, F.lit(i))).alias(n) for i, n in enumerate(names)]


def _parsed(lines: DataFrame, names: tuple[str, ...], width: int) -> DataFrame:
    """code, seq and the named fields of lines (code, seq, line) that have as many fields as width. A line is cut up once: a generator stands between the fields
    and whatever is asked of them later, which would else be worked out from the line again for each condition and each field."""
    parts = lines.select(normalize_code(C("code")).alias("code"), "seq", F.split("line", ",").alias("_parts"))
    whole = F.when(F.size("_parts") >= width, F.array(F.struct(*_fields(C("_parts"), names))))
    return parts.select("code", "seq", F.inline(whole))


def _last_by(df: DataFrame, *keys: str) -> DataFrame:
    """One row for each key, the one with the highest seq; seq goes."""
    rest = [c for c in df.columns if c not in (*keys, "seq")]
    return df.groupBy(*keys).agg(F.max_by(F.struct(*rest), "seq").alias("_row")).select(*keys, "_row.*")


def ingest_csv_bars(lines: DataFrame) -> DataFrame:
    """Bars of lines (code, seq, line) with the BAR_FIELDS joined by commas. Lines with fewer fields, or without a date,
    prices or volume, go."""
    rows = _parsed(lines, BAR_FIELDS, len(BAR_FIELDS))
    return _last_by(rows.na.drop(subset=list(REQUIRED)), "code", "date")


def ingest_array_bars(documents: DataFrame) -> DataFrame:
    """Bars of documents (code, seq, body), each a JSON list of lists that start with the ARRAY_FIELDS."""
    rows = documents.select(normalize_code(C("code")).alias("code"), "seq", F.posexplode(F.from_json("body", "array<string>")).alias("at", "item"))
    parts = F.from_json("item", "array<string>")
    rows = rows.where(F.size(parts) >= len(ARRAY_FIELDS)).select("code", F.struct("seq", "at").alias("seq"), *_fields(parts, ARRAY_FIELDS))
    return _last_by(rows.na.drop(subset=list(REQUIRED)), "code", "date")


def infer_turnover(bars: DataFrame, basis: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Bars (code and ARRAY_FIELDS) with turnover, amount, pct_chg, chg, amplitude and turnover_source, and the codes without a basis.

    basis: code, quote_volume, quote_turnover, float_market_cap, latest, turnover_hint. The number of floating units is the
    quote's volume over its turnover; else market value over price; else the last bar's volume over the hint. Volumes are
    in lots of 100."""
    good = lambda c: (C(c) > 0) & (C(c) < float("inf"))
    last = bars.groupBy("code").agg(F.max_by("volume", "date").alias("_volume"))
    ways = (
        ("turnover_from_quote", good("quote_volume") & good("quote_turnover"), C("quote_volume") * 100 / C("quote_turnover")),
        ("turnover_from_float_market_cap", good("float_market_cap") & good("latest"), C("float_market_cap") / C("latest") / 100),
        ("turnover_from_snapshot_hint", good("turnover_hint") & good("_volume"), C("_volume") * 100 / C("turnover_hint")),
    )
    chosen = F.coalesce(*(F.when(ok, F.struct(F.lit(name).alias("turnover_source"), units.alias("units"))) for name, ok, units in ways))
    units = last.join(basis, "code", "left").select("code", chosen.alias("_u"))
    rejects = units.where(C("_u").isNull()).select("code")
    df = bars.join(units.where(C("_u").isNotNull()), "code")
    was = ago("close")
    return df.select(
        *bars.columns, (C("volume") / C("_u.units") * 100).alias("turnover"), (C("volume") * 100 * (C("open") + C("high") + C("low") + C("close")) / 4).alias("amount"),
        ((over(C("close"), was) - 1) * 100).alias("pct_chg"), (C("close") - was).alias("chg"), over((C("high") - C("low")) * 100, was).alias("amplitude"), C("_u.turnover_source").alias("turnover_source"),
    ), rejects


def ingest_tabular_bars(rows: DataFrame, stock: bool = True) -> DataFrame:
    """Bars of a provider's table of text columns: code, seq, date, open, high, low, close, preclose, volume, amount, and for
    stocks turn, pctChg and tradestatus; days on which a stock didn't trade go. An index has no turnover."""
    text = lambda c: C(c).cast("string") if c in rows.columns else F.lit(None).cast("string")
    n = {c: _number(text(c)) for c in ("open", "close", "high", "low", "volume", "amount", "pctChg", "preclose", "turn")}
    df = rows.where(C("tradestatus").cast("string") == "1") if stock and "tradestatus" in rows.columns else rows
    df = df.select(
        (normalize_code(C("code")) if stock else C("code")).alias("code"), "seq", text("date").try_cast("date").alias("date"), *(n[c].alias(c) for c in ("open", "close", "high", "low", "volume", "amount")),
        over((n["high"] - n["low"]) * 100, n["preclose"]).alias("amplitude"), n["pctChg"].alias("pct_chg"), (n["close"] - n["preclose"]).alias("chg"), (n["turn"] if stock else F.lit(None).cast("double")).alias("turnover"),
    )
    return _last_by(df.na.drop(subset=list(REQUIRED)), "code", "date")


def _universe(df: DataFrame, **have: Column) -> DataFrame:
    """code, name and market with the universe's numbers, null where there is none."""
    return df.select("code", "name", "market", *(have.get(c, F.lit(None).cast("double")).alias(c) for c in UNIVERSE_NUMBERS))


def ingest_quote_text(lines: DataFrame) -> DataFrame:
    """Universe rows of text lines (value) such as `var hq_str_sh600000="NAME,...";`. Lines of another form, symbols that
    aren't 8 long and blank names go."""
    df = lines.select(F.regexp_extract("value", r"^[^=]*hq_str_([^=]*)=", 1).alias("symbol"), F.split(F.regexp_extract("value", r'^[^=]*=[\s]*"*([^";]*)', 1), ",").alias("f"))
    df = df.select(F.trim("symbol").alias("symbol"), F.trim(F.get("f", F.lit(0))).alias("name"), "f").where((F.length("symbol") == 8) & ~C("name").isin("", "NULL"))
    df = df.withColumns({"code": F.substring("symbol", 3, 6), "market": F.substring("symbol", 1, 2)})
    return _universe(df, **{c: parse_number(F.trim(F.get("f", F.lit(i)))) for c, i in (("latest", 3), ("volume", 8), ("amount", 9))})


def ingest_universe_json(pages: DataFrame) -> DataFrame:
    """Universe rows of JSON pages (body), whose items lie in data.diff and have numbered fields."""
    fields = ("f12", "f13", "f14", *ITEM_FIELDS.values())
    items = F.from_json("body", f"data struct<diff: array<struct<{', '.join(f'{f}: string' for f in fields)}>>>")["data"]["diff"]
    df = pages.select(F.explode(items).alias("x")).select(normalize_code(F.coalesce(C("x.f12"), F.lit(""))).alias("code"), F.trim(F.coalesce(C("x.f14"), F.lit(""))).alias("name"), C("x.f13").alias("market"), "x")
    return _universe(df, **{c: parse_number(F.trim(C(f"x.{f}"))) for c, f in ITEM_FIELDS.items()})


def ingest_listing(rows: DataFrame) -> DataFrame:
    """Universe rows of a listing (code such as sh.600000, code_name, tradeStatus). Rows whose exchange and prefix disagree,
    indexes among them, go."""
    exchange, code = F.split_part("code", F.lit("."), F.lit(1)), normalize_code(F.split_part("code", F.lit("."), F.lit(-1)))
    df = rows.select(code.alias("code"), F.coalesce("code_name", F.lit("")).alias("name"), exchange.alias("market"), F.coalesce(_number(C("tradeStatus").cast("string")), F.lit(0.0)).alias("trade_status"))
    front = F.substring("code", 1, 3)
    df = df.where(((C("market") == "sh") & front.isin(*MAIN_BOARD[:4])) | ((C("market") == "sz") & front.isin(*MAIN_BOARD[4:])))
    return df.select("*", *(F.lit(None).cast("double").alias(c) for c in UNIVERSE_NUMBERS))


def ingest_fund_flow(lines: DataFrame) -> DataFrame:
    """Fund flow of lines (code, seq, line) of 15 fields; rows without a date or a main inflow go."""
    rows = _parsed(lines, FLOW_FIELDS, FLOW_WIDTH)
    return _last_by(rows.na.drop(subset=["date", "main_net_inflow_amount"]), "code", "date")


def universe_completeness(pages: DataFrame, total: int, least_share: float = 0.98) -> DataFrame:
    """One row of pages (page, code): distinct codes, pages that repeat another page's codes, and whether the list is complete."""
    whole = pages.groupBy("page").agg(F.sum(F.xxhash64("code").cast("decimal(38,0)")).alias("mark"), F.count("*").alias("n"))
    repeated = whole.groupBy("mark", "n").agg((F.count("*") - 1).alias("again")).agg(F.coalesce(F.sum("again"), F.lit(0)).alias("repeated_pages"))
    out = pages.agg(F.count_distinct("code").alias("codes")).crossJoin(F.broadcast(repeated))  # one row each
    return out.withColumn("complete", (C("codes") >= least_share * total) & (C("repeated_pages") == 0))


def scan_universe(universe: DataFrame, version: int, session: str, now: str, max_age_hours: int) -> DataFrame:
    """The universe with state: fresh if its version, as_of and saved_at fit, else stale."""
    young = F.lit(now).cast("timestamp") - C("saved_at") < F.expr(f"INTERVAL '{max_age_hours}' HOUR")
    ok = (C("version") == version) & (C("as_of") == F.lit(session).cast("date")) & young
    return universe.withColumn("state", F.when(F.coalesce(ok, F.lit(False)), "fresh").otherwise("stale"))


def scan_evidence(spark: SparkSession, path: str, columns: tuple[str, ...]) -> DataFrame:
    """code, date and the numeric columns of a CSV of evidence. A missing or empty file, or one without keys, has no rows."""
    schema = ", ".join(("code string", "date date", *(f"{c} double" for c in columns)))
    try:
        raw = spark.read.option("header", True).csv(path)
    except AnalysisException as e:
        if e.getCondition() not in ("PATH_NOT_FOUND", "UNABLE_TO_INFER_SCHEMA"):
            raise
        return spark.createDataFrame([], schema)
    if not {"code", "date"} <= set(raw.columns):
        return spark.createDataFrame([], schema)
    value = lambda c: parse_number(C(c)) if c in raw.columns else F.lit(None).cast("double")
    return raw.select(normalize_code(C("code")).alias("code"), C("date").try_cast("date").alias("date"), *(value(c).alias(c) for c in columns)).where(C("code").isNotNull() & C("date").isNotNull())


def latest_complete_session(sessions: DataFrame, now: str, buffer_minutes: int = 10, zone: str = "Asia/Shanghai") -> DataFrame:
    """One row: the latest session whose close, 15:00 plus the buffer in the exchange's zone, is past at `now` (UTC text)."""
    close = F.to_utc_timestamp(C("date").cast("timestamp"), zone) + F.expr(f"INTERVAL '{15 * 60 + buffer_minutes}' MINUTE")
    return sessions.where(close <= F.lit(now).cast("timestamp")).agg(F.max("date").alias("session"))
