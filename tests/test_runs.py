"""Landed text, the watchlist over many sessions, reports and what a run writes."""

from datetime import date, timedelta

import numpy as np
import pytest
from pyspark.sql import functions as F

from tidebars.operators import publish, replay, watchlist
from tidebars.sources import landed
from tidebars.streaming.watchlist import watchlist_stream

DAY = date(2024, 1, 1)
SESSIONS = [DAY + timedelta(i) for i in range(40) if i % 7 < 5]


def sessions(spark):
    return spark.createDataFrame(list(enumerate(SESSIONS)), "session_no int, date date")


def story(spark, seed=4):
    """Random closes with missing days, and random signals."""
    rng, market, chosen = np.random.default_rng(seed), [], []
    for code in ("000001", "000002", "600003"):
        for d in SESSIONS[:24]:
            close = float(rng.integers(80, 120))
            if rng.random() < 0.85:
                market.append((d, code, close))
                for s in watchlist.STATES:
                    if rng.random() < 0.06:
                        chosen.append((d, code, s, float(rng.integers(50, 90)), close, close + 5, close - 1))
    selected = spark.createDataFrame(chosen, "date date, code string, signal string, score_total double, close double, resistance_price double, support_price double")
    return selected, spark.createDataFrame(market, "date date, code string, close double")


def keyed(rows):
    return {(r["code"], r["last_evaluated_date"]): r.asDict() for r in rows}


def test_replay_equals_one_update_after_another(spark):
    selected, market = story(spark)
    got = keyed(replay.watchlist_replay(replay.watchlist_events(selected, market, sessions(spark), 4)).collect())
    state = spark.createDataFrame([], watchlist.COLUMNS)
    for d in SESSIONS[:24]:
        on = F.col("date") == F.lit(d)
        out = watchlist.watchlist_update(state, selected.where(on), market.where(on), sessions(spark), d.isoformat(), 4).collect()
        for r in out:
            assert got[r["code"], d] == r.asDict()
        state = spark.createDataFrame([tuple(r[c] for c in ("code", *replay.FIELDS)) for r in out], watchlist.COLUMNS)
    assert any(r["state"] == "INVALID" for r in got.values()) and any(r["state"] == "EXPIRED" for r in got.values())


def test_stream_equals_batch(spark, tmp_path):
    selected, market = story(spark, 5)
    events = replay.watchlist_events(selected, market, sessions(spark), 4)
    for i in range(3):
        events.where((F.col("session_no") >= i * 10) & (F.col("session_no") < i * 10 + 10)).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(replay.EVENT).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in"))
    query = watchlist_stream(stream).writeStream.format("parquet").option("path", str(tmp_path / "out")).option("checkpointLocation", str(tmp_path / "state")).trigger(availableNow=True).start()
    assert query.awaitTermination(120)
    assert keyed(spark.read.parquet(str(tmp_path / "out")).collect()) == keyed(replay.watchlist_replay(events).collect())


def test_append_transitions_keeps_the_last(spark):
    schema = "date date, code string, from_state string, to_state string, signals string, close double"
    old = spark.createDataFrame([(DAY, "1", "NEW", "SETUP", "a", 1.0), (DAY, "2", "NEW", "SETUP", "a", 1.0)], schema)
    new = spark.createDataFrame([(DAY, "1", "NEW", "SETUP", "a", 2.0)], schema)
    assert sorted((r["code"], r["close"]) for r in replay.append_transitions(old, new).collect()) == [("1", 2.0), ("2", 1.0)]


def test_lines_that_cannot_be_read_go(spark):
    good = "2024-01-02,10,11,12,9,100,1000,1,2,3,4"
    rows = [("1", 1, good), ("1", 2, good.replace(",11,", ",11.5,")), ("1", 3, "2024-01-03,10"), ("1", 4, "x" + good), ("1", 5, good.replace(",100,", ",-,")), ("2", 1, None)]
    got = landed.ingest_csv_bars(spark.createDataFrame(rows, "code string, seq int, line string")).collect()
    assert [(r["code"], r["close"], r["turnover"]) for r in got] == [("000001", 11.5, 4.0)]
    body = '[["2024-01-02","10","11","12","9","100"], 7, ["2024-01-03"], ["2024-01-04",10,11,12,9,"nan"]]'
    got = landed.ingest_array_bars(spark.createDataFrame([("1", 1, body), ("2", 1, "{"), ("3", 1, None)], "code string, seq int, body string")).collect()
    assert [(r["code"], r["volume"]) for r in got] == [("000001", 100.0)]


def test_no_basis_is_a_reject(spark):
    bars = spark.createDataFrame([("1", DAY, 1.0, 1.0, 1.0, 1.0, 5.0), ("2", DAY, 1.0, 1.0, 1.0, 1.0, 5.0)], "code string, date date, open double, close double, high double, low double, volume double")
    basis = spark.createDataFrame([("1", None, 0.0, -1.0, 3.0, 2.0)], "code string, quote_volume double, quote_turnover double, float_market_cap double, latest double, turnover_hint double")
    out, rejects = landed.infer_turnover(bars, basis)
    assert [(r["code"], r["turnover"], r["turnover_source"]) for r in out.collect()] == [("1", 2.0, "turnover_from_snapshot_hint")] and [r["code"] for r in rejects.collect()] == ["2"]


def test_missing_evidence_is_no_error(spark, tmp_path):
    assert landed.scan_evidence(spark, str(tmp_path / "none.csv"), ("flow",)).count() == 0
    (tmp_path / "a.csv").write_text("code,date,flow\n1,2024-01-02,\"1,000\"\n2,bad,3\n")
    (tmp_path / "b.csv").write_text("x\n1\n")
    assert [tuple(r) for r in landed.scan_evidence(spark, str(tmp_path / "a.csv"), ("flow", "other")).collect()] == [("000001", date(2024, 1, 2), 1000.0, None)]
    assert landed.scan_evidence(spark, str(tmp_path / "b.csv"), ("flow",)).count() == 0


def test_an_invalid_run_publishes_no_candidates(spark, tmp_path):
    rows = spark.createDataFrame([("000001", 1.234)], "code string, score double")
    path = str(tmp_path / "runs")
    publish.publish_run({"selected": rows, "watchlist": rows, "scored": rows}, False, path, "2024-01-02")
    assert publish.latest_run(spark, path, "selected").count() == 0 and publish.latest_run(spark, path, "provisional_selected").count() == 1
    assert not (tmp_path / "runs" / "watchlist").exists()
    publish.publish_run({"selected": rows, "watchlist": rows}, True, path, "2024-01-03")
    assert publish.latest_run(spark, path, "watchlist").count() == 1
    with pytest.raises(ValueError):
        publish.publish_history(spark.createDataFrame([], "code string, date date"), path + "/bars", "2024-01-02", "test")


def test_labels_and_audit(spark):
    rows = spark.createDataFrame([("ready", 1.239), ("other", None)], "signal string, score double")
    assert [tuple(r) for r in publish.label_view(rows, {"signal": {"ready": "Ready"}}).collect()] == [("Ready", 1.24), ("other", None)]
    listed = spark.createDataFrame([("1", "one", 1), ("9", "nine", 0)], "code string, reference_name string, acceptance_example int")
    one = spark.createDataFrame([("1", "ONE", "ok", 7, DAY, 3.0, "a", "b", "step")], "code string, name string, status string, bars int, last_date date, close double, signal string, closest_signal string, failed_at string")
    got = {r["code"]: r for r in publish.join_reference_audit(listed, one, one, one, one, one, ("a", "b")).collect()}
    assert (got["1"]["name"], got["1"]["a"], got["1"]["b"], got["1"]["selected_any"]) == ("ONE", 1, 0, 1)
    assert (got["9"]["name"], got["9"]["in_universe"], got["9"]["selected_any"], got["9"]["fetch_status"]) == ("nine", 0, 0, None)
