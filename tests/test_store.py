"""Stored histories, runs behind manifests, features from carried states, and what streams add."""

import glob
import os
from datetime import date, timedelta

import numpy as np
import pytest
from pyspark.sql import functions as F

from tidebars.functions import frames
from tidebars.operators import carried, cost, features, market, publish, replay, watchlist
from tidebars.plans.params import Params
from tidebars.sources import commits, history
from tidebars.streaming import transitions
from tidebars.streaming import watchlist as stream

DAY = date(2023, 1, 2)
BAR = "code string, date date, open double, high double, low double, close double, volume double, amount double, turnover double"


def walk(code, n, seed=0, start=DAY, holes=True):
    """Bars of a random walk, on working days or with holes."""
    rng = np.random.default_rng([seed, int(code)])
    closes, day, out = np.round(np.exp(np.cumsum(rng.normal(0, 0.02, n))) * 50, 2).tolist(), start, []
    for i, c in enumerate(closes):
        o = float(closes[i - 1]) if i else float(c)
        volume = float(rng.integers(100, 5000))
        out.append((code, day, o, round(max(o, c) * 1.01, 2), round(min(o, c) * 0.99, 2), float(c), volume, volume * float(c), float(rng.integers(1, 90)) / 10))
        day += timedelta(int(rng.integers(1, 4)) if holes else 1)
    return out


def plain(df, *columns):
    return sorted(tuple(r) for r in df.select(*columns).collect())


# --- histories ---------------------------------------------------------------------------------------------------


def test_a_refresh_leaves_other_codes_alone(spark, tmp_path):
    path, codes = str(tmp_path / "h"), [f"{i:06d}" for i in range(12)]
    bars = spark.createDataFrame([r for c in codes for r in walk(c, 400)], BAR)
    assert history.upsert_history(bars, path, "2030-01-01", "first", buckets=4) == 1
    first = commits.manifest(spark, path)[1]["parts"]
    one = bars.where((F.col("code") == codes[3]) & (F.col("date") >= "2024-06-01")).withColumn("close", F.col("close") + 1)
    for version in (2, 3):
        assert history.upsert_history(one, path, "2030-01-01", "second") == version
    now, key = history.read_history(spark, path), ("code", "date", "close", "source")
    rest = bars.join(one.select("code", "date"), ["code", "date"], "left_anti")
    assert plain(now, *key) == sorted(plain(rest.withColumn("source", F.lit("first")), *key) + plain(one.withColumn("source", F.lit("second")), *key))
    parts = commits.manifest(spark, path)[1]["parts"]
    touched = {p for p in parts if parts[p] != first[p]}
    assert len({p.split("/")[0] for p in touched}) == 1 and {p.split("/")[1] for p in touched} <= {"year=2024", "year=2025"} and len(touched) < len(parts)
    assert plain(history.read_history(spark, path, version=1), *key) == plain(bars.withColumn("source", F.lit("first")), *key)
    history.upsert_history(one, path, "2030-01-01", "third", whole=True)
    now = history.read_history(spark, path)
    assert plain(now.where(F.col("code") == codes[3]), *key) == plain(one.withColumn("source", F.lit("third")), *key) and now.count() == bars.count() - 400 + one.count()
    gone = history.vacuum(spark, path, keep=1)
    assert gone and history.read_history(spark, path).count() == now.count() and commits.versions(spark, path) == [4]


def test_a_writer_that_fails_or_comes_second_changes_nothing(spark, tmp_path):
    path, bars = str(tmp_path / "h"), spark.createDataFrame(walk("000001", 20), BAR)
    history.upsert_history(bars, path, "2030-01-01", "first", buckets=2)
    broken = bars.withColumn("close", F.when(F.col("close") > 0, F.raise_error(F.lit("no")).cast("double")))
    with pytest.raises(Exception, match="no"):
        history.upsert_history(broken, path, "2030-01-01", "second")
    for none in (bars.limit(0), bars.withColumn("date", F.lit(None).cast("date")), bars.withColumn("code", F.lit(None).cast("string"))):
        with pytest.raises(ValueError, match="no bar"):
            history.upsert_history(none, path, "2030-01-01", "second")
    commits.commit(spark, path, commits.manifest(spark, path)[1], 1)
    with pytest.raises(commits.Conflict):
        commits.commit(spark, path, {}, 1)
    assert commits.versions(spark, path) == [1, 2] and plain(history.read_history(spark, path), "date", "close") == plain(bars, "date", "close")


def test_states_of_histories(spark, tmp_path):
    path, codes = str(tmp_path / "h"), [f"{i:06d}" for i in range(8)]
    bars = spark.createDataFrame([r for c in codes[:6] for r in walk(c, 300, holes=False)], BAR)
    end = (DAY + timedelta(299)).isoformat()
    repeated = bars.withColumn("ingest_seq", F.lit(1)).unionByName(bars.withColumns({"close": F.lit(0.0), "ingest_seq": F.lit(0)}))
    history.upsert_history(repeated, path, end, "a:1", buckets=8)
    history.upsert_history(bars.where(F.col("code") == codes[0]), path, end, "b:1")
    history.upsert_history(bars.where(F.col("code") == codes[1]).withColumn("close", F.col("close") + 0), path, end, "a:1", adjusted=0)
    universe = spark.createDataFrame([(c,) for c in [*codes, codes[2], None]], "code string")
    states = lambda **kw: {r["code"]: (r["state"], r["bars"]) for r in history.scan_history(universe, path, end, **kw).collect()}
    fresh = {c: ("fresh", 300) for c in codes[:6]} | {c: ("missing", 0) for c in codes[6:]}
    assert states(sources=("a:",)) == fresh | {codes[0]: ("incompatible", 0), codes[1]: ("incompatible", 0)}
    assert {r["files"] for r in history.scan_history(universe, path, end).where("state = 'fresh'").collect()} == {1}
    early = (DAY - timedelta(1)).isoformat()
    assert {s for s, _ in ((r["state"], 0) for r in history.scan_history(universe, path, early).collect())} == {"empty", "incompatible", "missing"}
    late = (DAY + timedelta(400)).isoformat()
    assert {r["state"] for r in history.scan_history(universe, path, late).collect()} == {"stale_date", "incompatible", "missing"}
    bucket = history.read_history(spark, path).select("code", history.bucket_of(8).alias("b")).distinct().collect()
    mine = next(r["b"] for r in bucket if r["code"] == codes[2])
    own = {r["code"] for r in bucket if r["b"] == mine}
    part = f"bucket={mine}/year=2023"
    (file,) = glob.glob(f"{path}/bars/commit={commits.manifest(spark, path)[1]['parts'][part]}/{part}/*.parquet")
    with open(file, "r+b") as f:
        f.seek(4)
        f.write(b"\xff" * 200)
    for crc in glob.glob(f"{path}/bars/**/.*.crc", recursive=True):
        os.remove(crc)
    got = states()
    assert {c for c, (s, _) in got.items() if s == "corrupt"} == own - {codes[1]} and got[codes[1]][0] == "incompatible"
    assert states(since="2024-01-01") == {c: ("missing", 0) for c in codes}


def test_years_prune_files(spark, tmp_path):
    path = str(tmp_path / "h")
    history.upsert_history(spark.createDataFrame(walk("000001", 900), BAR), path, "2030-01-01", "a", buckets=2)
    years = {p.split("=")[-1] for p in commits.manifest(spark, path)[1]["parts"]}
    assert len(years) > 2
    rows = history.read_history(spark, path, since=f"{max(years)}-01-01", codes=["000001"])
    assert len(rows.inputFiles()) == 1 and rows.count() == sum(r[1].year == int(max(years)) for r in walk("000001", 900))
    plan = history.scan_history(rows.select("code"), path, "2030-01-01", since=f"{max(years)}-01-01")._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters: [isnotnull(year#" in plan


# --- runs --------------------------------------------------------------------------------------------------------


def test_a_run_is_seen_whole_or_not_at_all(spark, tmp_path):
    path, rows = str(tmp_path / "runs"), spark.createDataFrame([("000001", 1.5)], "code string, score double")
    assert publish.publish_run({"scored": rows, "selected": rows}, True, path, "2024-01-02") == 1
    broken = rows.withColumn("score", F.raise_error(F.lit("died")).cast("double"))
    with pytest.raises(Exception, match="died"):
        publish.publish_run({"scored": rows.withColumn("score", F.lit(9.0)), "selected": broken}, True, path, "2024-01-03")
    assert publish.latest_run(spark, path, "scored").first()["score"] == 1.5 and len(glob.glob(f"{path}/runs/*")) == 1
    publish.publish_run({"scored": rows.withColumn("score", F.lit(2.0)), "twice": lambda done: done["scored"].withColumn("score", F.col("score") * 2)}, True, path, "2024-01-03")
    assert publish.latest_run(spark, path, "twice").first()["score"] == 4.0 and publish.latest_run(spark, path, "selected").first()["score"] == 1.5
    assert publish.latest_run(spark, path, "scored", version=1).first()["score"] == 1.5
    with pytest.raises(ValueError, match="published"):
        publish.latest_run(spark, path, "other")


def test_gates_count_in_the_run_s_own_passes(spark, tmp_path):
    path, universe = str(tmp_path / "runs"), spark.createDataFrame([(f"{i:06d}", "ok" if i < 8 else "failed") for i in range(10)], "code string, status string")
    for least, rows in ((11, universe), (1, universe.limit(0)), (1, universe.where("code < ''"))):
        counted, gate = publish.universe_gate(rows, least)
        with pytest.raises(publish.GateFailed, match="too small"):
            publish.publish_run({"status": counted, "selected": universe}, True, path, "2024-01-02", (gate,))
    assert commits.versions(spark, path) == []
    for least_pct, valid in ((80.0, True), (80.1, False)):
        counted, gate = publish.coverage_counts(universe)
        publish.publish_run({"status": counted, "selected": universe}, lambda seen, p=least_pct: "status" not in seen or publish.covered(seen, p), path, "2024-01-02", (gate,))
        assert commits.manifest(spark, path)[1]["valid"] is valid and publish.latest_run(spark, path, "selected").count() == (10 if valid else 0)
    bench, gate = publish.fresh_gate(spark.createDataFrame([(date(2024, 1, 1), 1.0)], "date date, close double"), "2024-01-02")
    with pytest.raises(publish.GateFailed, match="2024-01-01"):
        publish.publish_run({"scored": universe.crossJoin(bench.select("close"))}, True, path, "2024-01-02", (gate,))
    listed, gate = publish.complete_gate(universe, 11)
    with pytest.raises(publish.GateFailed, match="10 of 11"):
        publish.publish_run({"universe": listed}, True, path, "2024-01-02", (gate,))


def test_parameters_are_checked():
    for wrong in ({"min_history_bars": 100}, {"min_coverage_pct": 0}, {"ready_score": 101}, {"max_position_250": 1.2}, {"strong_peak_band_share_pct": 5.0}, {"refresh_days": 5}, {"horizon": 0}):
        with pytest.raises(ValueError, match="out of range"):
            Params(**wrong)


# --- features ----------------------------------------------------------------------------------------------------


def close_to(a, b):
    return a == b or (a is not None and b is not None and abs(a - b) <= 1e-9 * max(1, abs(a), abs(b)))


def test_features_go_on_from_a_state(spark):
    rows = [r for c, n in (("000001", 420), ("000002", 300), ("000003", 12), ("000004", 330)) for r in walk(c, n, seed=3)]
    bars = spark.createDataFrame(rows, BAR).cache()
    last = {c: max(r[1] for r in rows if r[0] == c) for c in ("000001", "000002", "000003", "000004")}
    until = lambda days: F.col("date") <= F.date_sub(F.max("date").over(frames.W().rowsBetween(-10**6, 10**6)), days)
    early = bars.withColumn("_k", until(40)).where("_k").drop("_k").cache()
    later = bars.withColumn("_k", until(15)).where("_k").drop("_k").cache()
    whole = {(r["code"], r["date"]): r.asDict() for r in features.feature_panel(bars).withColumn("bars", F.row_number().over(frames.W())).collect()}
    state = spark.createDataFrame(carried.carry(early).collect(), carried.carry(early).schema)
    assert {r["code"] for r in state.collect() if r["seeds"] is not None} >= {"000001", "000004"}
    _, second, _ = carried.refresh(state, later.join(early.groupBy("code").agg(F.date_sub(F.max("date"), 30).alias("f")), "code").where("date >= f").drop("f"))
    second = spark.createDataFrame(second.collect(), second.schema)
    new = bars.join(later.groupBy("code").agg(F.date_sub(F.max("date"), 30).alias("f")), "code").where("date >= f").drop("f")
    off = new.withColumn("close", F.when(F.col("code") == "000004", F.col("close") * 1.2).otherwise(F.col("close")))
    other = spark.createDataFrame(walk("000009", 5, start=last["000001"]), BAR)
    found, third, rebuild = carried.refresh(second, off.unionByName(other))
    got = {(r["code"], r["date"]): r.asDict() for r in found.collect()}
    assert {r["code"] for r in rebuild.collect()} >= {"000004", "000009"} and {c for c, _ in got} == {"000001", "000002", "000003"} - {r["code"] for r in rebuild.collect()}
    for key, r in got.items():
        for name, value in r.items():
            if name != "ingest_seq":
                assert close_to(value, whole[key][name]) if isinstance(value, float) or value is None else value == whole[key][name], (key, name, value, whole[key][name])
    assert {r["code"] for r in third.collect()} == {"000001", "000002", "000004"} and max(len(r["tail"]) for r in third.collect()) < 300
    assert {key for key in whole if key[0] == "000001" and key[1] >= max(k[1] for k in got if k[0] == "000001") - timedelta(1)} <= set(got)


def test_quantiles_move_over_batches(spark):
    assert np.allclose(features.rolling_quantiles(np.arange(30.0)[::-1], 20), [[np.quantile(np.arange(30.0)[::-1][i : i + 20], q) for q in (0.9, 0.1)] for i in range(11)])
    rows = [r for c, n in (("000001", 150), ("000002", 7), ("000003", 61)) for r in walk(c, n)]
    before = spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch")
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "13")
    try:
        got = features.in_order(spark.createDataFrame(rows, BAR)).orderBy("code", "date").collect()
    finally:
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", before)
    for i, r in enumerate(got):
        own = [x["close"] for x in got[: i + 1] if x["code"] == r["code"]]
        want = [float(np.quantile(own[-w:], q)) if len(own) >= w else None for w in features.WINDOWS for q in features.QUANTILES]
        assert all(close_to(a, b) for a, b in zip(r["_quantiles"], want, strict=True))
        fast = own[0]
        for c in own[1:]:
            fast += 2 / 13 * (c - fast)
        gains = [max(b - a, 0.0) for a, b in zip(own, own[1:], strict=False)]
        up = gains[0] if gains else None
        for g in gains[1:]:
            up += (g - up) / 14
        assert close_to(r["_fast"], fast) and close_to(r["_up"], up if len(gains) >= 14 else None)


def test_repeats_and_bad_numbers_count_nowhere(spark):
    bars = spark.createDataFrame(walk("000001", 130), BAR)
    odd = bars.withColumn("ingest_seq", F.lit(1)).unionByName(bars.withColumns({"close": F.lit(1.0), "ingest_seq": F.lit(0)})).unionByName(bars.withColumns({"high": F.lit(float("inf")), "ingest_seq": F.lit(2)}))
    exact = bars.unionByName(bars)
    for some in (odd, exact):
        assert plain(features.feature_panel(some), "date", "ma20", "rsi14", "adaptive_base_quality") == plain(features.feature_panel(bars), "date", "ma20", "rsi14", "adaptive_base_quality")
        assert plain(cost.cost_profile(some), "chip_peak_price", "chip_model_coverage_pct") == plain(cost.cost_profile(bars), "chip_peak_price", "chip_model_coverage_pct")
        assert plain(cost.cost_distribution_panel(some), "date", "chip_peak_price") == plain(cost.cost_distribution_panel(bars), "date", "chip_peak_price")
    nan = bars.withColumn("turnover", F.when(F.day("date") == 3, float("nan")).when(F.day("date") == 4, float("inf")).otherwise(F.col("turnover")))
    null = bars.withColumn("turnover", F.when(~F.day("date").isin(3, 4), F.col("turnover")))
    assert plain(cost.cost_profile(nan), "chip_peak_price", "chip_model_coverage_pct") == plain(cost.cost_profile(null), "chip_peak_price", "chip_model_coverage_pct")
    for bad in ({"bins": 299}, {"lookback": 59}):
        for model in (cost.cost_profile, cost.cost_distribution_asof, cost.cost_distribution_panel):
            with pytest.raises(ValueError, match="300 bins"):
                model(bars, **bad)


def test_a_period_of_the_cost_panel_is_that_of_the_whole(spark):
    bars = spark.createDataFrame([r for c, n in (("000001", 700), ("000002", 90)) for r in walk(c, n, holes=False)], BAR)
    columns = ("code", "date", "chip_peak_price", "chip_model_coverage_pct", "chip_peak_position")
    whole = cost.cost_distribution_panel(bars, lookback=100, block=64)
    for start, end in (("2024-03-01", "2024-06-01"), (None, "2023-02-01"), ("2024-10-01", None), ("2031-01-01", "2031-02-01")):
        part = cost.cost_distribution_panel(bars, lookback=100, block=64, start=start, end=end)
        want = plain(whole.where(F.col("date").between(start or "1900-01-01", end or "2999-01-01")), *columns)
        assert [r[:2] for r in plain(part, *columns)] == [r[:2] for r in want]
        assert all(close_to(a, b) for x, y in zip(plain(part, *columns), want, strict=True) for a, b in zip(x[2:], y[2:], strict=True))


# --- joins -------------------------------------------------------------------------------------------------------


def test_evidence_is_what_was_known_on_the_day(spark):
    d = [DAY + timedelta(i) for i in range(6)]
    panel = spark.createDataFrame([("1", d[0], 9.0, "p"), ("1", d[2], 9.0, "p"), ("1", d[2], 8.0, "p"), ("1", d[4], None, "p"), ("2", d[4], 1.0, "p"), (None, d[4], 1.0, "p"), ("1", None, 1.0, "p")], "code string, date date, flow double, _side string")
    evidence = spark.createDataFrame([("1", d[1], 5.0, "a"), ("1", d[2], None, "b"), ("1", d[5], 7.0, "c"), ("1", d[1], 4.0, "z"), (None, d[1], 5.0, "n"), ("1", None, 5.0, "n")], "code string, date date, flow double, note string")
    got = market.join_evidence_panel(panel, evidence, ("flow", "note"))
    assert got.columns == ["code", "date", "flow", "_side", "evidence_date", "note"]
    want = [("1", d[0], 9.0, None, None), ("1", d[2], 9.0, d[2], "b"), ("1", d[2], 8.0, d[2], "b"), ("1", d[4], None, d[2], "b"), ("2", d[4], 1.0, None, None), (None, d[4], 1.0, None, None), ("1", None, 1.0, None, None)]
    assert sorted(map(str, (tuple(r) for r in got.select("code", "date", "flow", "evidence_date", "note").collect()))) == sorted(map(str, want))
    assert market.join_evidence_panel(panel, evidence.limit(0), ("flow",)).where("evidence_date is not null").count() == 0


def test_calendars_are_looked_up(spark):
    days = [DAY + timedelta(i) for i in range(30) if i % 7 < 5]
    sessions = spark.createDataFrame([(i, d) for i, d in enumerate(days)], "session_no int, date date")
    ends = [DAY + timedelta(i) for i in range(-5, 40, 3)]
    pairs = spark.createDataFrame([(a, b) for a in ends for b in ends] + [(None, DAY), (DAY, None)], '`start` date, `end` date')
    for r in market.sessions_between(pairs, sessions).collect():
        want = 0 if None in (r["start"], r["end"]) else max(0, sum(r["start"] <= d <= r["end"] for d in days) - 1)
        assert r["n"] == want
    for count in (0, 3, -3, 100):
        got = {r["date"]: r["target"] for r in market.session_offset(sessions, count).collect()}
        assert got == {d: days[i + count] if 0 <= i + count < len(days) else None for i, d in enumerate(days)}
    for df in (market.sessions_between(pairs, sessions), market.session_offset(sessions, 3)):
        assert "SinglePartition" not in df._jdf.queryExecution().executedPlan().toString()
    assert market.sessions_between(pairs, sessions.limit(0)).agg(F.max("n")).first()[0] == 0


def test_universes_as_they_come(spark):
    rows = [("600001", "A"), ("600001", "B"), ("600002", "*st C"), ("600003", f"D{market.LEAVING}"), ("600004", None), ("900001", "E"), (None, "F"), ("1", "G")]
    got = market.filter_universe(spark.createDataFrame(rows, "code string, name string"))
    assert sorted((r["code"], r["name"]) for r in got.collect()) == [("000001", "G"), ("600001", "A"), ("600004", None)]
    flagged = spark.createDataFrame([("600001", "A", True), ("600002", "B", None), ("600003", "C", False)], "code string, name string, is_delisting boolean")
    assert sorted(r["code"] for r in market.filter_universe(flagged).collect()) == ["600002", "600003"]


# --- streams -----------------------------------------------------------------------------------------------------


def test_a_batch_that_comes_again_changes_nothing(spark, tmp_path):
    path = str(tmp_path / "t")
    rows = spark.createDataFrame([(date(2024, m, 5), c, "NEW", "SETUP", "a", float(m)) for m in (1, 2, 3) for c in ("1", "2")] + [(None, "3", "NEW", "SETUP", "a", 1.0)], transitions.ROW)
    add = transitions.transitions_sink(path, "list")
    add(rows.where(F.month("date") < 3), 0)
    first = commits.manifest(spark, path)[1]["parts"]
    add(rows.where(F.month("date") < 3).withColumn("close", F.lit(99.0)), 0)
    add(rows.limit(0), 1)
    assert commits.versions(spark, path) == [1, 2]
    add(rows.where((F.month("date") > 1) | F.col("date").isNull()).withColumn("close", F.col("close") + 10), 2)
    add(rows, 1)
    got = sorted((r["date"].month, r["code"], r["close"]) for r in transitions.read_transitions(spark, path).collect())
    assert got == [(1, "1", 1.0), (1, "2", 1.0), (2, "1", 12.0), (2, "2", 12.0), (3, "1", 13.0), (3, "2", 13.0)]
    assert commits.manifest(spark, path)[1]["parts"]["month=2024-01"] == first["month=2024-01"]
    transitions.transitions_sink(path, "other")(rows.where("code = '1'").withColumn("code", F.lit("7")), 0)
    assert transitions.read_transitions(spark, path).count() == 9


def test_sessions_without_rows_are_evaluated_by_timers(spark, tmp_path):
    rng = np.random.default_rng(6)
    days = [DAY + timedelta(i) for i in range(40) if i % 7 < 5]
    sessions = spark.createDataFrame(list(enumerate(days)), "session_no int, date date")
    chosen, traded = [], []
    for code in ("000001", "000002", "000003"):
        for i, d in enumerate(days):
            close = float(rng.integers(80, 120))
            if rng.random() < 0.6 and not (code == "000003" and i > 12):
                traded.append((d, code, close))
                chosen += [(d, code, s, 60.0, close, close + 5, close - 1) for s in watchlist.STATES if rng.random() < 0.1]
    selected = spark.createDataFrame(chosen, "date date, code string, signal string, score_total double, close double, resistance_price double, support_price double")
    events = replay.watchlist_events(selected, spark.createDataFrame(traded, "date date, code string, close double"), sessions, 4).cache()
    want = {(r["code"], r["last_evaluated_date"]): r.asDict() for r in replay.watchlist_replay(events).collect()}
    sparse = events.where(F.col("close").isNotNull() | F.col("new_state").isNotNull())
    path = str(tmp_path)
    for low, high in ((0, 9), (10, 18), (19, 99)):
        part = sparse.where(F.col("session_no").between(low, high))
        again = sparse.where(F.col("session_no") == low - 5).withColumn("close", F.lit(1.0))  # late, and evaluated before
        part.unionByName(again).coalesce(1).write.mode("append").parquet(f"{path}/in")
        stream.run_to(spark.readStream.schema(replay.EVENT).parquet(f"{path}/in"), sessions, f"{path}/out", f"{path}/state")
    got = {(r["code"], r["last_evaluated_date"]): r.asDict() for r in spark.read.schema(replay.OUT).parquet(f"{path}/out").collect()}
    assert got == want and any(r["data_status"] == "missing_today" for r in got.values())
