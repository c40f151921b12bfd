"""The watchlist: one session's update, its transitions, and many sessions in a row."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

C = F.col
STATES = {"chip_base_ready": ("SETUP", 1), "chip_base_launch": ("TRIGGER", 3), "chip_base_rebound": ("RETEST", 2)}
ACTIVE = ("SETUP", "TRIGGER", "RETEST")
COLUMNS = "code string, state string, signals string, first_seen_date date, last_signal_date date, last_evaluated_date date, data_status string, age_sessions int, score_total double, close double, resistance_price double, support_price double, expires_date date, trigger_date date, trigger_price double"


def current_state(selected: DataFrame, *by: str) -> DataFrame:
    """For each code (or other key) with signals: the state of highest priority, the signals' names, and the first signal's values."""
    order = F.create_map(*(x for i, s in enumerate(STATES) for x in (F.lit(s), F.lit(i))))[C("signal")]
    state = F.create_map(*(x for s, (name, n) in STATES.items() for x in (F.lit(s), F.struct(F.lit(n).alias("n"), F.lit(name).alias("name")))))[C("signal")]
    return selected.groupBy(*(by or ("code",))).agg(
        F.max(state)["name"].alias("new_state"), F.array_join(F.array_sort(F.collect_set("signal")), ",").alias("new_signals"),
        *(F.min_by(c, order).alias(f"new_{c}") for c in ("score_total", "close", "resistance_price", "support_price")),
    )


def watchlist_update(previous: DataFrame, selected: DataFrame, market: DataFrame, sessions: DataFrame, today: str, ttl: int) -> DataFrame:
    """The list after the session today, with old_state. previous has COLUMNS, selected a row for each code and signal,
    market code and close, sessions date and session_no (a calendar, so its lookups are two values and a small join)."""
    day = F.lit(today).cast("date")
    no = sessions.select("date", "session_no")
    now = no.where(C("date") <= day).agg(F.max("session_no").alias("_now"))
    ends = now.join(no, C("session_no") == C("_now") + ttl, "left").select("_now", C("date").alias("_ends"))
    seen = no.select(C("date").alias("last_evaluated_date"), C("session_no").alias("_seen"))
    rows = previous.withColumn("_old", F.lit(True)).join(seen, "last_evaluated_date", "left").join(current_state(selected), "code", "full_outer").join(market.select("code", C("close").alias("_close")), "code", "left").crossJoin(F.broadcast(ends))
    hit, old = C("new_state").isNotNull(), F.coalesce(C("state"), F.lit(""))
    fresh = hit & ~old.isin(*ACTIVE)
    have = C("_close").isNotNull()
    lost = have & (C("_close") < C("support_price") * 0.98)
    state = F.when(hit, C("new_state")).when(F.coalesce(lost, F.lit(False)), "INVALID").when(have & (C("expires_date") < day), "EXPIRED").otherwise(C("state"))
    aged = F.when(fresh, 0).when(hit, C("age_sessions")).when(C("last_evaluated_date") < day, C("age_sessions") + F.coalesce(F.greatest(C("_now") - C("_seen"), F.lit(0)), F.lit(0))).otherwise(C("age_sessions"))
    trigger = C("new_state") == "TRIGGER"
    return rows.select(
        "code", state.alias("state"), F.coalesce("new_signals", F.lit("")).alias("signals"), F.when(fresh, day).otherwise(C("first_seen_date")).alias("first_seen_date"),
        F.when(hit, day).otherwise(C("last_signal_date")).alias("last_signal_date"), day.alias("last_evaluated_date"), F.when(hit | have, "ok").otherwise("missing_today").alias("data_status"), aged.cast("int").alias("age_sessions"),
        F.when(hit, C("new_score_total")).otherwise(C("score_total")).cast("double").alias("score_total"), F.when(hit, C("new_close")).when(have, C("_close")).otherwise(C("close")).alias("close"),
        F.when(hit, C("new_resistance_price")).otherwise(C("resistance_price")).alias("resistance_price"), F.when(hit, C("new_support_price")).otherwise(C("support_price")).alias("support_price"),
        F.when(hit, C("_ends")).otherwise(C("expires_date")).alias("expires_date"), F.when(trigger, day).otherwise(C("trigger_date")).alias("trigger_date"),
        F.when(trigger, C("new_close")).otherwise(C("trigger_price")).alias("trigger_price"), C("state").alias("old_state"),
    )


def watchlist_transitions(updated: DataFrame) -> DataFrame:
    """Rows whose state changed: date, code, from_state (NEW if there was none), to_state, signals, close."""
    return updated.where(~C("state").eqNullSafe(C("old_state")) & C("state").isNotNull()).select(C("last_evaluated_date").alias("date"), "code", F.coalesce("old_state", F.lit("NEW")).alias("from_state"), C("state").alias("to_state"), "signals", "close")


def watchlist_active(updated: DataFrame) -> DataFrame:
    return updated.where(C("state").isin(*ACTIVE))
