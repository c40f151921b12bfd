"""Reports over a run, and what a run and a backtest write."""

from __future__ import annotations

import uuid
from collections.abc import Callable, Mapping
from dataclasses import dataclass

from pyspark.sql import DataFrame, Observation, SparkSession
from pyspark.sql import functions as F

from ..sources import commits, history

C = F.col


def flow_status(candidates: DataFrame, summary: DataFrame) -> DataFrame:
    """Each candidate's flow: ok, stale (not of the session) or failed (none)."""
    rows = candidates.select("code").join(summary.select("code", "fund_flow_latest_date", "fund_flow_is_current"), "code", "left")
    return rows.select("code", "fund_flow_latest_date", F.when(C("fund_flow_latest_date").isNull(), "failed").when(C("fund_flow_is_current") == 1, "ok").otherwise("stale").alias("status"))


def evidence_metadata(joined: DataFrame, rows: int) -> DataFrame:
    """One row about an as-of join of evidence that had so many rows: loaded, matched codes, newest date and a note."""
    out = joined.agg(F.count_if(C("evidence_date").isNotNull()).alias("matched_codes"), F.max("evidence_date").alias("newest_date"))
    note = F.lit("no evidence") if rows == 0 else F.when(C("matched_codes") == 0, "no evidence up to the session").otherwise("")
    return out.select(F.lit(rows > 0).alias("loaded"), "matched_codes", "newest_date", note.alias("note"))


def run_report(status: DataFrame, snapshots: DataFrame, selected: DataFrame, least_pct: float) -> DataFrame:
    """One row: counts by status, coverage, distinct candidates (none published if coverage is too low), their rate in per cent
    and its band."""
    by_status = F.map_from_entries(F.array_sort(F.collect_list(F.struct("status", "n"))))  # as many entries as kinds of status
    counts = status.groupBy("status").agg(F.count("*").alias("n")).agg(by_status.alias("status_counts"), F.coalesce(F.sum("n"), F.lit(0)).alias("universe"))
    ready = snapshots.agg(F.count_distinct("code").alias("snapshots"))
    found = selected.agg(F.count_distinct("code").alias("provisional"))
    one = counts.crossJoin(F.broadcast(ready)).crossJoin(F.broadcast(found))  # one row each
    share = lambda a, b: F.when(C(b) > 0, a / F.when(C(b) > 0, C(b)) * 100).otherwise(0.0)
    one = one.withColumn("coverage_pct", F.round(share(C("snapshots"), "universe"), 2))
    one = one.withColumn("valid", C("coverage_pct") >= least_pct).withColumn("candidates", F.when(C("valid"), C("provisional")).otherwise(0))
    rate = share(C("candidates"), "snapshots")
    band = F.when(~C("valid"), "coverage too low").when(rate < 0.2, "very few").when(rate < 1.0, "selective").otherwise("many")
    return one.select("*", F.round(rate, 3).alias("candidate_rate_pct"), band.alias("assessment"))


def join_reference_audit(listed: DataFrame, universe: DataFrame, status: DataFrame, scored: DataFrame, selected: DataFrame, missed: DataFrame, signals: tuple[str, ...]) -> DataFrame:
    """Every listed code (code, reference_name, acceptance_example) with its name, status, readiness, a flag for each signal and
    where it failed. Spark chooses the joins by listed's size."""
    mine = lambda df, *cols: df.join(listed.select("code"), "code", "left_semi").select("code", *cols)
    flags = mine(selected, "signal").groupBy("code").agg(*(F.max((C("signal") == s).cast("int")).alias(s) for s in signals))
    out = listed.join(mine(universe, C("name").alias("market_name")), "code", "left").join(mine(status, C("status").alias("fetch_status"), "bars", "last_date"), "code", "left")
    out = out.join(mine(scored, "close"), "code", "left").join(flags, "code", "left").join(mine(missed, "closest_signal", "failed_at").dropDuplicates(["code"]), "code", "left")
    on = [F.coalesce(s, F.lit(0)) for s in signals]
    return out.select(
        "code", F.coalesce("market_name", "reference_name").alias("name"), "acceptance_example", F.greatest(*on, F.lit(0)).alias("selected_any"), "fetch_status", "last_date", "bars",
        C("market_name").isNotNull().cast("int").alias("in_universe"), C("close").isNotNull().cast("int").alias("indicators_ready"), *(c.alias(s) for s, c in zip(signals, on, strict=True)), "closest_signal", "failed_at",
    )


def label_view(df: DataFrame, labels: Mapping[str, Mapping[str, str]], digits: int = 2) -> DataFrame:
    """df with codes replaced by labels, for the columns that have any (codes without one stay), and doubles rounded."""
    out = []
    for field in df.schema:
        c = C(field.name)
        if labels.get(field.name):
            table = F.create_map(*(F.lit(x) for pair in labels[field.name].items() for x in pair))
            c = F.coalesce(F.try_element_at(table, c), c)
        elif field.dataType.typeName() in ("double", "float"):
            c = F.round(c, digits)
        out.append(c.alias(field.name))
    return df.select(*out)


def publish(artefacts: Mapping[str, DataFrame], path: str, session: str) -> None:
    """Writes each artefact below path/name/session=..., replacing that session alone. Running it again gives the same files."""
    for name, df in artefacts.items():
        df.drop("session").write.mode("overwrite").parquet(f"{path}/{name}/session={session}")


class GateFailed(ValueError):
    """A run isn't published: what was written of it has no manifest, and the run before stays the newest."""


@dataclass(frozen=True)
class Gate:
    """What the run's own passes count, without a job for it: once the artefact is written, check looks at what the observation saw and says why the run
    may not be published, or nothing."""

    artefact: str
    observation: Observation
    check: Callable[[dict], str | None]


Step = DataFrame | Callable[[dict[str, DataFrame]], DataFrame]


def resolved(steps: Mapping[str, Step]) -> dict[str, DataFrame]:
    """Steps as DataFrames: one that is a function gets those before it."""
    done: dict[str, DataFrame] = {}
    for name, step in steps.items():
        done[name] = step(done) if callable(step) else step
    return done


def publish_run(artefacts: Mapping[str, Step], valid: bool | Callable[[dict[str, dict]], bool], path: str, session: str, gates: tuple[Gate, ...] = ()) -> int:
    """Writes a run's artefacts into a folder of its own and makes them the newest run, by a manifest that appears last and at once. A reader finds the
    run before or this one, whole, also if the writer dies between artefacts. The run's version is returned.

    An artefact may be a function of those before it: it gets them as they were written, so nothing is worked out twice. Gates are
    checked as soon as their artefact is written; valid may be a function of what they saw, by artefact. Without enough coverage (not valid) candidates are
    published empty and the rows kept as provisional. Artefacts that this run doesn't have stay those of the run before; a run that isn't
    valid leaves the watchlist and its transitions alone in this way."""
    spark = next(df for df in artefacts.values() if isinstance(df, DataFrame)).sparkSession
    before, old = commits.manifest(spark, path)
    folder = f"runs/{session}-{uuid.uuid4().hex}"
    done: dict[str, DataFrame] = {}
    seen: dict[str, dict] = {}
    named = dict(old.get("artefacts", {}))

    def write(name: str, df: DataFrame) -> None:
        df.write.parquet(f"{path}/{folder}/{name}")
        done[name], named[name] = spark.read.schema(df.schema).parquet(f"{path}/{folder}/{name}"), f"{folder}/{name}"

    try:
        for name, step in artefacts.items():
            fine = valid(seen) if callable(valid) else valid
            if not fine and name.startswith(("watchlist", "transitions")):
                continue
            df = step(done) if callable(step) else step
            if not fine and name.startswith("selected"):
                write(f"provisional_{name}", df)
                df = df.limit(0)
            write(name, df)
            for gate in (g for g in gates if g.artefact == name):
                seen.setdefault(name, {}).update(found := gate.observation.get)
                if reason := gate.check(found):
                    raise GateFailed(reason)
        fine = valid(seen) if callable(valid) else valid
        return commits.commit(spark, path, {"session": session, "valid": fine, "artefacts": named}, before)
    except BaseException:
        commits.delete(spark, f"{path}/{folder}")
        raise


def universe_gate(universe: DataFrame, least: int, artefact: str = "status") -> tuple[DataFrame, Gate]:
    """A universe with fewer rows than `least` stops the run that writes the artefact. The frame counts its rows as they pass."""
    seen = Observation()
    check = lambda found: None if (found.get("universe") or 0) >= least else f"the universe is too small: {found.get('universe') or 0} < {least}"
    return universe.observe(seen, F.count(F.lit(1)).alias("universe")), Gate(artefact, seen, check)


def fresh_gate(benchmark: DataFrame, session: str, artefact: str = "scored") -> tuple[DataFrame, Gate]:
    """A benchmark that doesn't end on the session stops the run that writes the artefact."""
    seen = Observation()
    check = lambda found: None if found.get("last") == session else f"the benchmark ends on {found.get('last')}, not on {session}"
    return benchmark.observe(seen, F.max("date").cast("string").alias("last")), Gate(artefact, seen, check)


def complete_gate(universe: DataFrame, total: int, least_share: float = 0.98, artefact: str = "universe") -> tuple[DataFrame, Gate]:
    """A listing of which fewer codes came than its source announced stops the run that writes the artefact; universe has one row a code."""
    seen = Observation()
    check = lambda found: None if (found.get("codes") or 0) >= least_share * total else f"{found.get('codes')} of {total} codes"
    return universe.observe(seen, F.count("code").alias("codes")), Gate(artefact, seen, check)


def coverage_counts(status: DataFrame, artefact: str = "status") -> tuple[DataFrame, Gate]:
    """Status rows that count what a run's coverage needs as they pass: universe and ok."""
    seen = Observation()
    return status.observe(seen, F.count(F.lit(1)).alias("universe"), F.count_if(C("status") == "ok").alias("ok")), Gate(artefact, seen, lambda found: None)


def covered(seen: dict[str, dict], least_pct: float) -> bool:
    """Whether what coverage_counts saw is enough: as market.coverage_gate, in per cent to two digits."""
    found = seen.get("status", {})
    universe, ok = found.get("universe") or 0, found.get("ok") or 0
    return bool(universe) and round(ok / universe * 100, 2) >= least_pct


def publish_shape_checkpoint(selected: DataFrame, path: str, session: str, signals: tuple[str, ...]) -> None:
    """Each signal's rows as chosen by shape alone, before flow reorders them."""
    publish({f"shape_only_{s}": selected.where(C("signal") == s) for s in signals}, path, session)


def publish_history(bars: DataFrame, path: str, session: str, source: str, buckets: int = history.BUCKETS) -> int:
    """Bars up to the session put over those of the store, with where they came from: history.upsert_history. Empty histories are refused."""
    return history.upsert_history(bars, path, session, source, buckets=buckets)


def publish_backtest(judged: DataFrame, daily: DataFrame, metrics: DataFrame, path: str) -> None:
    """A backtest's signals with outcomes, its daily summary and, as JSON, its metrics."""
    judged.write.mode("overwrite").parquet(f"{path}/signals")
    daily.write.mode("overwrite").parquet(f"{path}/daily")
    metrics.coalesce(1).write.mode("overwrite").json(f"{path}/metrics")


def latest_run(spark: SparkSession, path: str, name: str, version: int | None = None) -> DataFrame:
    """An artefact as of the newest run, or of a run by its version. A reader of several artefacts pins the version that commits.versions gives."""
    _, run = commits.manifest(spark, path, version)
    if name not in run.get("artefacts", {}):
        raise ValueError(f"no run has published {name}")
    return spark.read.parquet(f"{path}/{run['artefacts'][name]}")


def require_fresh_benchmark(benchmark: DataFrame, session: str) -> None:
    last = benchmark.agg(F.max("date").cast("string").alias("d")).first()["d"]
    if last != session:
        raise ValueError(f"the benchmark ends on {last}, not on {session}")
