"""Fund flow of candidates: choice, summary and re-ranking."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

C = F.col
SPANS = (3, 5, 10, 20)


def flow_candidates(selected: DataFrame, order: tuple[str, ...], limit: int) -> DataFrame:
    """Up to limit distinct codes, taken in turn from each signal's list by falling score: code, turn, signal_no, total."""
    place = F.array_position(F.array(*map(F.lit, order)), C("signal")) - 1
    rows = selected.withColumns({"signal_no": place.cast("int"), "turn": F.row_number().over(Window.partitionBy("signal").orderBy(C("model_score").desc_nulls_last(), "code"))})
    first = rows.groupBy("code").agg(F.min(F.struct("turn", "signal_no")).alias("at"))
    total = first.agg(F.count("*").alias("total"))
    taken = first.select("code", "at.*").orderBy("turn", "signal_no", "code").limit(limit)
    return taken.crossJoin(F.broadcast(total))  # one row


def flow_summary(flow: DataFrame, as_of: str) -> DataFrame:
    """For each code the sums of its last 3, 5, 10 and 20 rows up to as_of (null where it has fewer), and what they say."""
    last = Window.partitionBy("code").orderBy(C("date").desc())
    rows = flow.where(C("main_net_inflow_amount").isNotNull() & (C("date") <= F.lit(as_of).cast("date"))).withColumn("at", F.row_number().over(last)).where(C("at") <= max(SPANS))
    sums = [F.when(F.count("*") >= n, F.sum(F.when(C("at") <= n, C("main_net_inflow_amount")))).alias(f"main_net_inflow_{n}d_amount") for n in SPANS]
    out = rows.groupBy("code").agg(F.max("date").alias("fund_flow_latest_date"), (F.count("*") >= max(SPANS)).cast("int").alias("fund_flow_available"), *sums)
    positive = sum((F.coalesce(C(f"main_net_inflow_{n}d_amount") > 0, F.lit(False)).cast("int") for n in SPANS), F.lit(0))
    out = out.withColumns({"fund_flow_is_current": (C("fund_flow_latest_date") == F.lit(as_of).cast("date")).cast("int"), "fund_flow_positive_window_count": positive})
    out = out.withColumn("fund_flow_all_windows_positive", ((C("fund_flow_available") == 1) & (C("fund_flow_positive_window_count") == len(SPANS))).cast("int"))
    reason = F.when(C("fund_flow_is_current") == 0, F.concat(F.lit("stale since "), C("fund_flow_latest_date").cast("string"))).when(C("fund_flow_all_windows_positive") == 1, "net inflow in all windows")
    reason = reason.when(C("fund_flow_available") == 1, F.concat("fund_flow_positive_window_count", F.lit("/4 windows with net inflow"))).otherwise("fewer than 20 days")
    return out.withColumn("fund_flow_rank_reason", reason)


def flow_rank(selected: DataFrame, summary: DataFrame) -> DataFrame:
    """Each signal's rows in a new order: current flow, then its windows, then the model score; missing counts as 0."""
    keys = ("fund_flow_is_current", "fund_flow_all_windows_positive", "fund_flow_positive_window_count", *(f"main_net_inflow_{n}d_amount" for n in SPANS))
    rows = selected.join(summary, "code", "left")
    order = Window.partitionBy("signal").orderBy(*(F.coalesce(k, F.lit(0)).desc() for k in keys), C("model_score").desc(), "code")
    return rows.withColumn("rank", F.row_number().over(order))
