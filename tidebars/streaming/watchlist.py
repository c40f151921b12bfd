"""The watchlist as a stream with a state for each code."""

from __future__ import annotations

from collections.abc import Iterator
from datetime import UTC, date, datetime

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout
from pyspark.sql.streaming.stateful_processor import TimerValues

from ..operators.market import MOST_DAYS
from ..operators.replay import EVENT, FIELDS, OUT, OUT_COLUMNS, STATE, _clean, fold, step


def watchlist_stream(events: DataFrame) -> DataFrame:
    """The same over a stream of EVENT rows: each micro-batch holds whole sessions, in order. A code keeps one row of state.

    A session that comes again, or late, is skipped: it was evaluated before."""

    def run(key: tuple, frames: Iterator[pd.DataFrame], group: GroupState) -> Iterator[pd.DataFrame]:
        state, last_no = None, None
        if group.exists:
            *values, last_no = group.get
            state = dict(zip(FIELDS, values, strict=True))
        frame = pd.concat(list(frames))
        if last_no is not None:
            frame = frame[frame["session_no"] > last_no]
        rows, state, last_no = fold(key[0], frame, state, last_no)
        if state is not None:
            group.update((*(state[f] for f in FIELDS), last_no))
        yield pd.DataFrame(rows, columns=OUT_COLUMNS)

    return events.groupBy("code").applyInPandasWithState(run, OUT, f"{STATE}, last_no int", "append", GroupStateTimeout.NoTimeout)


class _Sessions(StatefulProcessor):
    """One code's list, where only sessions with a bar or a signal arrive. Sessions between two that arrive are filled in when the later one does; those
    after the last are evaluated by a timer, once the watermark shows that they are over."""

    def __init__(self, calendar: list[tuple[int, date]]):
        self.days = dict(calendar)
        self.last = max(self.days, default=0)

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle, self.list = handle, handle.getValueState("list", f"{STATE}, last_no int")

    def _empty(self, no: int) -> dict:
        return dict.fromkeys(EVENTS) | {"session_no": no, "date": self.days[no]}

    def _fold(self, code: str, events: list[dict]) -> Iterator[pd.DataFrame]:
        state, no = None, None
        if self.list.exists():
            *values, no = self.list.get()
            state = dict(zip(FIELDS, _plain(values), strict=True))
        rows = []
        for event in sorted(events, key=lambda e: e["session_no"]):
            if no is not None and event["session_no"] <= no:
                continue
            for e in (*(self._empty(n) for n in range(event["session_no"] if no is None else no + 1, event["session_no"])), event):
                state, was = step(state, no, e)
                if state is not None:
                    no = e["session_no"]
                    rows.append({"code": code, **state, "old_state": was})
        if rows:
            self.list.update((*(state[f] for f in FIELDS), no))
        yield pd.DataFrame(rows, columns=OUT_COLUMNS)

    def _await(self, timers: TimerValues) -> None:
        """A timer for the end of the session after the last one seen."""
        no = self.list.get()[-1] + 1 if self.list.exists() else self.last + 1
        if no <= self.last:
            self.handle.registerTimer(_millis(self.days[no]))

    def handleInputRows(self, key: tuple, rows: Iterator[pd.DataFrame], timerValues: TimerValues) -> Iterator[pd.DataFrame]:  # noqa: N802, N803
        for timer in list(self.handle.listTimers()):
            self.handle.deleteTimer(timer)
        events = [_clean(e) for frame in rows for e in frame[EVENTS].to_dict("records")]
        yield from self._fold(key[0], events)
        self._await(timerValues)

    def handleExpiredTimer(self, key: tuple, timerValues: TimerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:  # noqa: ANN001, N802, N803
        over = timerValues.getCurrentWatermarkInMs()
        no = self.list.get()[-1] if self.list.exists() else self.last
        yield from self._fold(key[0], [self._empty(n) for n in range(no + 1, self.last + 1) if _millis(self.days[n]) <= over])
        self._await(timerValues)

    def close(self) -> None:
        pass


EVENTS = [f.split()[0] for f in EVENT.split(", ")]


def _millis(day: date) -> int:
    return int(datetime(day.year, day.month, day.day, tzinfo=UTC).timestamp() * 1000)


def _plain(values: list) -> list:
    return [x.date() if isinstance(x, datetime) else x for x in values]


def watchlist_sessions(events: DataFrame, sessions: DataFrame) -> DataFrame:
    """The list after every session (OUT rows) over a stream of EVENT rows of which only those with a bar or a signal have to come: a code that doesn't trade
    costs no row. sessions (date, session_no) is the calendar, whose size is checked.

    Each code keeps one row of state and one timer. The watermark follows the events' dates without delay, so a micro-batch holds whole
    sessions; a session is over once a later row of any code has come, or with its last one where the stream ends. Rows of a session that is over, late
    or again, change nothing. Needs the RocksDB state store; survives a restart from its checkpoint. The session's time zone has to be UTC, in which dates become event times."""
    calendar = [(r["session_no"], r["date"]) for r in sessions.select("session_no", "date").limit(MOST_DAYS + 1).collect()]
    if len(calendar) > MOST_DAYS:
        raise ValueError(f"a calendar of more than {MOST_DAYS} days")
    timed = events.withColumn("at", F.col("date").cast("timestamp")).withWatermark("at", "0 seconds")
    return timed.groupBy("code").transformWithStateInPandas(_Sessions(calendar), OUT, "append", "eventTime")


def run_to(events: DataFrame, sessions: DataFrame, path: str, checkpoint: str) -> None:
    """Runs watchlist_sessions over what has come by now, from where the checkpoint ends, and appends its rows to path."""
    spark, name = events.sparkSession, "spark.sql.streaming.stateStore.providerClass"
    before = spark.conf.get(name)
    spark.conf.set(name, "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")
    try:
        query = watchlist_sessions(events, sessions).writeStream.format("parquet").option("path", path).option("checkpointLocation", checkpoint).outputMode("append").trigger(availableNow=True).start()
        query.awaitTermination()
    finally:
        spark.conf.set(name, before)
