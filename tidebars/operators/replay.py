"""The watchlist folded over many sessions."""

from __future__ import annotations

from collections.abc import Iterator
from datetime import date

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .watchlist import ACTIVE, current_state

C = F.col
#: What a session says about a code: its close, if it traded, and the state that its signals give, if it has any.
EVENT = "code string, session_no int, date date, expires_date date, close double, new_state string, new_signals string, new_score_total double, new_close double, new_resistance_price double, new_support_price double"
STATE = "state string, signals string, first_seen_date date, last_signal_date date, last_evaluated_date date, data_status string, age_sessions int, score_total double, close double, resistance_price double, support_price double, expires_date date, trigger_date date, trigger_price double"
FIELDS = tuple(f.split()[0] for f in STATE.split(", "))
OUT = f"code string, {STATE}, old_state string"


def watchlist_events(selected: DataFrame, market: DataFrame, sessions: DataFrame, ttl: int) -> DataFrame:
    """EVENT rows for every code that ever has a signal and every session from its first on. selected: date, code, signal and the
    signal's values; market: date, code, close; sessions: date, session_no. Days without a bar have a row too, as the list counts
    sessions."""
    now = current_state(selected, "code", "date")
    ends = sessions.select((C("session_no") - ttl).alias("session_no"), C("date").alias("expires_date"))
    calendar = sessions.select("session_no", "date").join(ends, "session_no", "left")
    # codes are few and narrow until each is spread over its sessions: adaptive execution would leave them to one task
    first = now.join(calendar.select("date", "session_no"), "date").repartition(_parts(now), "code").groupBy("code").agg(F.min("session_no").alias("_first"))
    end = F.broadcast(sessions.agg(F.max("session_no").alias("_end")))  # one row
    days = first.crossJoin(end).select("code", F.explode(F.sequence("_first", "_end")).alias("session_no")).join(calendar, "session_no")
    rows = days.join(market.select("code", "date", "close"), ["code", "date"], "left").join(now, ["code", "date"], "left")
    return rows.select(*(C(f.split()[0]).cast(f.split()[1]) for f in EVENT.split(", ")))


def _parts(df: DataFrame) -> int:
    """A number of partitions that is asked for is kept."""
    return int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))


def _missing(x) -> bool:
    return x is None or x != x


def step(old: dict | None, last_no: int | None, e: dict) -> tuple[dict | None, str | None]:
    """The state after one session, and the state's name before. The rules of watchlist_update, for one code."""
    was = old["state"] if old else None
    today, no = e["date"], e["session_no"]
    hit, traded = not _missing(e["new_state"]), not _missing(e["close"])
    if old is None and not hit:
        return None, None
    new = dict(old) if old else dict.fromkeys(FIELDS)
    if hit:
        if was not in ACTIVE:
            new |= {"first_seen_date": today, "age_sessions": 0}
        new |= {k: e[f"new_{k}"] for k in ("state", "signals", "score_total", "close", "resistance_price", "support_price")}
        new |= {"last_signal_date": today, "expires_date": e["expires_date"], "data_status": "ok"}
        if new["state"] == "TRIGGER":
            new |= {"trigger_date": today, "trigger_price": e["new_close"]}
    else:
        new |= {"signals": "", "data_status": "ok" if traded else "missing_today"}
        if traded:
            new["close"] = e["close"]
            if not _missing(new["support_price"]) and e["close"] < new["support_price"] * 0.98:
                new["state"] = "INVALID"
            elif not _missing(new["expires_date"]) and new["expires_date"] < today:
                new["state"] = "EXPIRED"
        if new["last_evaluated_date"] != today:
            new["age_sessions"] += max(0, no - (no if last_no is None else last_no))
    new["last_evaluated_date"] = today
    return new, was


def _clean(record: dict) -> dict:
    """pandas' missing values as None, its timestamps as dates, its numpy numbers as Python's."""
    out = {}
    for k, x in record.items():
        x = None if x is None or x is pd.NaT or x != x else x
        out[k] = x.date() if isinstance(x, pd.Timestamp) else x.item() if hasattr(x, "item") else x
    return out


def fold(code: str, frame: pd.DataFrame, state: dict | None, last_no: int | None) -> tuple[list[dict], dict | None, int | None]:
    rows = []
    for event in frame.sort_values("session_no").to_dict("records"):
        e = _clean(event)
        state, was = step(state, last_no, e)
        if state is not None:
            last_no = e["session_no"]
            rows.append({"code": code, **state, "old_state": was})
    return rows, state, last_no


OUT_COLUMNS = ["code", *FIELDS, "old_state"]


def _floats(column: pa.Array) -> np.ndarray:
    return column.to_numpy(zero_copy_only=False).astype(np.float64)


def _days(column: pa.Array) -> np.ndarray:
    """Dates as days, NEVER for null."""
    return column.cast(pa.int32()).fill_null(NEVER).to_numpy().astype(np.int64)


NEVER = -(1 << 31)
#: States by number; -1 is none.
STATE_NAMES = (*ACTIVE, "INVALID", "EXPIRED")
INVALID, EXPIRED = STATE_NAMES.index("INVALID"), STATE_NAMES.index("EXPIRED")


def fold_many(events: pa.Table) -> pa.Table:
    """OUT rows of EVENT rows in order of code and session, of many codes side by side: session after session, each step is one of arrays over
    the codes. The rules are those of step."""
    n = events.num_rows
    events = events.combine_chunks()
    get = lambda name: events.column(name).combine_chunks()
    code = get("code").dictionary_encode()
    edges = np.flatnonzero(np.diff(code.indices.to_numpy(), prepend=-1))
    lengths = np.diff(np.append(edges, n))
    order = np.argsort(-lengths, kind="stable")
    signals = get("new_signals").dictionary_encode()
    said = [*signals.dictionary.to_pylist(), ""]
    new_state = np.array([STATE_NAMES.index(x) if x in STATE_NAMES else -1 for x in get("new_state").to_pylist()], np.int64)
    rows = {
        "no": get("session_no").to_numpy(zero_copy_only=False).astype(np.int64), "day": _days(get("date")), "ends": _days(get("expires_date")), "close": _floats(get("close")), "state": new_state,
        "signals": signals.indices.fill_null(len(said) - 1).to_numpy().astype(np.int64), **{k: _floats(get(f"new_{k}")) for k in ("score_total", "close", "resistance_price", "support_price") if k != "close"}, "signal_close": _floats(get("new_close")),
    }
    width, empty = len(edges), len(said) - 1
    whole = lambda fill, kind: np.full(width, fill, kind)
    now = {k: whole(np.nan, np.float64) for k in ("score_total", "close", "resistance_price", "support_price", "trigger_price")}
    now |= {k: whole(NEVER, np.int64) for k in ("first_seen_date", "last_signal_date", "last_evaluated_date", "expires_date", "trigger_date")}
    now |= {"state": whole(-1, np.int64), "signals": whole(empty, np.int64), "ok": whole(0, np.int64), "age_sessions": whole(0, np.int64), "no": whole(0, np.int64)}
    out = {k: np.empty(n, v.dtype) for k, v in now.items()} | {"old": np.empty(n, np.int64)}
    for t in range(int(lengths.max()) if n else 0):
        m = int(np.searchsorted(-lengths[order], -t, "left"))  # codes that have a row t
        at, s = edges[order[:m]] + t, {k: v[:m] for k, v in now.items()}
        e = {k: v[at] for k, v in rows.items()}
        was, hit, traded = s["state"].copy(), e["state"] >= 0, ~np.isnan(e["close"])
        fresh, quiet = hit & ~((was >= 0) & (was < len(ACTIVE))), ~hit & (was >= 0)
        triggers = hit & (e["state"] == STATE_NAMES.index("TRIGGER"))
        lost = quiet & traded & (e["close"] < s["support_price"] * 0.98)
        late = quiet & traded & ~lost & (s["expires_date"] != NEVER) & (s["expires_date"] < e["day"])
        aged = quiet & (s["last_evaluated_date"] != e["day"])
        put = lambda name, where, value: np.copyto(s[name], value, where=where)  # noqa: E731, B023
        put("age_sessions", aged, s["age_sessions"] + np.maximum(0, e["no"] - s["no"]))
        put("age_sessions", fresh, 0)
        put("first_seen_date", fresh, e["day"])
        for name in ("state", "signals", "score_total", "resistance_price", "support_price"):
            put(name, hit, e[name])
        put("close", hit, e["signal_close"])
        put("close", quiet & traded, e["close"])
        put("signals", quiet, empty)
        put("last_signal_date", hit, e["day"])
        put("expires_date", hit, e["ends"])
        put("trigger_date", triggers, e["day"])
        put("trigger_price", triggers, e["signal_close"])
        put("state", lost, INVALID)
        put("state", late, EXPIRED)
        put("ok", hit | quiet, hit | traded)
        put("last_evaluated_date", hit | quiet, e["day"])
        put("no", hit | quiet, e["no"])
        for name, values in s.items():
            out[name][at] = values
        out["old"][at] = was
    listed = np.flatnonzero(out["state"] >= 0)
    names = lambda values, which: pa.array(np.array([*which, None], object)[values[listed]], pa.string())
    dates = lambda values: pa.array(values[listed].astype(np.int32), pa.int32(), mask=values[listed] == NEVER).cast(pa.date32())
    columns = {"code": get("code").take(pa.array(listed)), "state": names(out["state"], STATE_NAMES), "signals": names(out["signals"], said), "data_status": names(out["ok"], ("missing_today", "ok")), "age_sessions": pa.array(out["age_sessions"][listed].astype(np.int32)), "old_state": names(out["old"], STATE_NAMES)}
    columns |= {k: dates(out[k]) for k in FIELDS if k.endswith("_date")} | {k: pa.array(out[k][listed], pa.float64(), from_pandas=True) for k in ("score_total", "close", "resistance_price", "support_price", "trigger_price")}
    return pa.table({k: columns[k] for k in OUT_COLUMNS})


FOLD_ROWS = 1 << 17  # rows that are folded together, or one code's sessions if these are more


def watchlist_replay(events: DataFrame) -> DataFrame:
    """The list after each session (OUT rows). A task takes its codes' sessions in order and folds some hundred codes at a time, side by side; it
    holds FOLD_ROWS rows and one code's sessions, which the calendar bounds."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []
        for batch in batches:
            held.append(batch)
            if sum(b.num_rows for b in held) >= FOLD_ROWS:
                table = pa.Table.from_batches(held)
                codes = table.column("code").combine_chunks().dictionary_encode().indices.to_numpy()
                last = int(np.flatnonzero(codes != codes[-1])[-1]) + 1 if (codes != codes[-1]).any() else 0  # the last code may go on
                if last:
                    yield from fold_many(table.slice(0, last)).to_batches()
                held = table.slice(last).to_batches()
        if sum(b.num_rows for b in held):
            yield from fold_many(pa.Table.from_batches(held)).to_batches()

    return events.repartition(_parts(events), "code").sortWithinPartitions("code", "session_no").mapInArrow(run, OUT)


def append_transitions(history: DataFrame, new: DataFrame) -> DataFrame:
    """The history of transitions with new ones; of rows with the same date, code, from_state and to_state the new one stays."""
    key = ["date", "code", "from_state", "to_state"]
    rest = [c for c in history.columns if c not in key]
    rows = history.withColumn("_seq", F.lit(0)).unionByName(new.withColumn("_seq", F.lit(1)))
    return rows.groupBy(*key).agg(F.max_by(F.struct(*rest), "_seq").alias("_r")).select(*key, "_r.*")


def session_of(rows: DataFrame, day: date) -> DataFrame:
    """The list after one session."""
    return rows.where(C("last_evaluated_date") == F.lit(day))
