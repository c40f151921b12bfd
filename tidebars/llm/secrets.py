"""Secret scans over an incremental blob ledger, in DataFrame functions only."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import as_table, free_name


@dataclass(frozen=True)
class Rule:
    """Finds pattern's leftmost non-overlapping matches and drops those with fewer than least characters after prefix.
    A text with none of the hints (its lower-case form, if folded) has no match."""

    kind: str
    pattern: str
    prefix: str = ""
    least: int = 1
    hints: tuple[str, ...] = ()
    folded: bool = False
    version: int = 1


_ASSIGN = r"""(?i:(password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?"""
RULES = (
    Rule("assign", _ASSIGN + "([A-Za-z0-9+/_.=-]+)", _ASSIGN, 6, ("password", "passwd", "secret", "token", "apikey", "api_key"), True),
    Rule("access", "AKIA[A-Z0-9]+", "", 20, ("AKIA",)),
    Rule("hex", "[0-9a-f]{24,}"),
    Rule("pem", "-----BEGIN [A-Z ]{0,40}PRIVATE KEY-----", hints=("PRIVATE KEY-----",)),
    Rule("github", r"\bgh[pousr]_[A-Za-z0-9]{36,}", hints=("ghp_", "gho_", "ghu_", "ghs_", "ghr_")),
    Rule("slack", r"\bxox[abprs]-[A-Za-z0-9-]{10,}", hints=("xox",)),
    Rule("jwt", r"\beyJ[A-Za-z0-9_-]{8,}\.[A-Za-z0-9_-]{8,}\.[A-Za-z0-9_-]*", hints=("eyJ",)),
)
BASE = ("assign", "access", "hex")
SPAN = "array<struct<start:bigint,end:bigint,kind:string,version:int>>"


def _let(value: Column, use: Callable[[Column], Column]) -> Column:
    """use(value), with value worked out once, however often and in whatever loop it is used."""
    return F.get(F.transform(F.array(value), use), F.lit(0))


def _before(values: Column, op: Callable[[Column, Column], Column], zero: Column, depth: int = 4, width: int = 32) -> Column:
    """For each value op over all values before it, zero for the first. Chunks of chunks are summed up and only within a chunk each value looks back, so
    the time is in proportion to the number of values (up to width ** (depth + 1), 33 million)."""
    within = lambda chunk, start: F.transform(chunk, lambda x, i: F.aggregate(F.slice(chunk, F.lit(1), i), start, op))
    if depth == 0:
        return within(values, zero)

    def chunked(chunks: Column) -> Column:
        starts = _let(F.transform(chunks, lambda c: F.aggregate(c, zero, op)), lambda totals: _before(totals, op, zero, depth - 1, width))
        return F.flatten(F.zip_with(chunks, starts, within))

    def cut(v: Column) -> Column:
        chunks = F.transform(F.sequence(F.lit(0), F.floor((F.size(v) - 1) / width).cast("int")), lambda k: F.slice(v, k * width + 1, F.lit(width)))
        return F.when(F.size(v) == 0, v).otherwise(_let(chunks, chunked))

    return _let(values, cut)


def _spans(text: Column, rule: Rule) -> Column:
    """The rule's spans in code points: what lies between matches, and the matches, give each match's place, by running sums of their lengths."""

    def ok(match: Column) -> Column:
        return F.length(F.regexp_replace(match, "^" + rule.prefix, "") if rule.prefix else match) >= rule.least

    def pairs(found: Column) -> Column:
        return F.zip_with(F.slice(F.split(text, rule.pattern, -1), F.lit(1), F.size(found)), found, lambda gap, match: F.struct((F.length(gap) + F.length(match)).cast("bigint").alias("both"), F.length(match).cast("bigint").alias("own"), ok(match).alias("ok")))

    def placed(parts: Column) -> Column:
        starts = _before(F.transform(parts, lambda p: p["both"]), lambda a, b: a + b, F.lit(0).cast("bigint"))
        both = F.zip_with(parts, starts, lambda p, at: F.struct(p["ok"].alias("ok"), (at + p["both"] - p["own"]).alias("start"), (at + p["both"]).alias("end")))
        return F.transform(F.filter(both, lambda p: p["ok"]), lambda p: F.struct(p["start"], p["end"], F.lit(rule.kind).alias("kind"), F.lit(rule.version).alias("version")))

    spans = _let(_let(F.regexp_extract_all(text, F.lit(rule.pattern), F.lit(0)), pairs), placed)
    some = F.lower(text) if rule.folded else text
    screen = reduce(lambda a, b: a | b, (some.contains(h) for h in rule.hints)) if rule.hints else text.rlike(rule.pattern)
    return F.when(screen, spans).otherwise(F.array().cast(SPAN))


def pair_of(rule: Rule) -> str:
    return f"{rule.kind}.{rule.version}"


def _pairs(rules: tuple[Rule, ...]) -> Column:
    return F.array(*(F.lit(pair_of(r)) for r in rules))


def find_spans(text: Column, rules: tuple[Rule, ...] = RULES, lacking: Column | None = None) -> Column:
    """Spans of a text (null: empty) by the rules, or by those whose pair is in lacking; the others don't touch the text."""
    whole = F.coalesce(text, F.lit(""))
    due = lambda r: F.lit(True) if lacking is None else F.array_contains(lacking, pair_of(r))
    return F.concat(*(F.when(due(r), _spans(whole, r)).otherwise(F.array().cast(SPAN)) for r in rules))


def blob_of(text: Column) -> Column:
    """A text's SHA-256; a null text is the empty blob."""
    return F.sha2(F.coalesce(text, F.lit("")), 256)


def scan_new_blobs(versions: DataFrame, ledger: DataFrame | None = None, rules: tuple[Rule, ...] = RULES, text_col: str = "text", generation: int = 1) -> DataFrame:
    """Ledger rows (blob, rules, generation, spans): each blob in versions that lacks a (blob, rule, version) pair in the ledger, with
    the pairs that it lacks and the spans of those rules alone. A rule of a new version leaves the other rules' findings as they are.

    A blob is scanned once however many paths and versions have it. Blobs without findings have rows too, or they would be
    scanned again. versions may repeat rows and have any other columns; an empty table gives an empty one."""
    text = F.coalesce(F.col(text_col), F.lit(""))
    blobs = versions.select(blob_of(F.col(text_col)).alias("blob"), text.alias("text")).dropDuplicates(["blob"]).withColumn("rules", _pairs(rules))
    if ledger is not None:
        have = ledger.groupBy("blob").agg(F.flatten(F.collect_list("rules")).alias("have"))
        blobs = blobs.join(have, "blob", "left").withColumn("rules", F.when(F.col("have").isNull(), F.col("rules")).otherwise(F.array_except("rules", "have")))
        blobs = blobs.where(F.size("rules") > 0)
    return blobs.select("blob", "rules", F.lit(generation).alias("generation"), find_spans(F.col("text"), rules, None if ledger is None else F.col("rules")).alias("spans"))


def findings(ledger: DataFrame, rules: tuple[Rule, ...] = RULES) -> DataFrame:
    """blob, spans by the rules' present versions in order of start, then of the rules, and the first generation, for each
    blob that the ledger holds for all rules."""
    kinds, pairs = F.array(*(F.lit(r.kind) for r in rules)), _pairs(rules)
    now = F.transform(
        F.filter("spans", lambda s: F.array_contains(pairs, F.concat_ws(".", s["kind"], s["version"].cast("string")))),
        lambda s: F.struct(s["start"], F.array_position(kinds, s["kind"]).alias("rank"), s["end"], s["kind"]),
    )
    known = ledger.groupBy("blob").agg(F.array_sort(F.flatten(F.collect_list(now))).alias("spans"), F.flatten(F.collect_list("rules")).alias("have"), F.min("generation").alias("generation"))
    return known.where(F.size(F.array_except(pairs, F.col("have"))) == 0).select("blob", "spans", "generation")


def join_findings(versions: DataFrame, ledger: DataFrame, rules: tuple[Rule, ...] = RULES, text_col: str = "text", out: str = "spans") -> DataFrame:
    """versions with the column out, spans from the ledger: every path of a blob gets the blob's findings; a hot blob's rows are a
    skewed join that Spark splits. Blobs that the ledger doesn't hold for all rules get null. A column out of versions is replaced."""
    blob, rows = free_name(versions, "_blob"), versions.drop(out)
    mine = findings(ledger, rules).select(F.col("blob").alias(blob), F.col("spans").alias(out))
    return rows.withColumn(blob, blob_of(F.col(text_col))).join(mine, blob, "left").drop(blob)


def scan(docs: DataFrame, rules: tuple[Rule, ...] = RULES, ledger: DataFrame | None = None, deliveries: Column | None = None) -> tuple[DataFrame, DataFrame]:
    """Rows' ids with their blobs' spans and generation (doc_id, spans, generation), and the ledger with the new blobs, which is written first.

    With deliveries, a number from 1 for each row, the rows arrive one delivery after another: each is a generation that scans
    only what the ledger lacks by then. Ids may be null or repeated; every row gets its own text's findings."""
    turns = [F.lit(True)] if deliveries is None else [deliveries == i + 1 for i in range(docs.select(deliveries.alias("n")).agg(F.max("n")).first()[0] or 0)]
    start = 0 if ledger is None else ledger.agg(F.max("generation")).first()[0] or 0
    for i, mine in enumerate(turns):
        new = as_table(scan_new_blobs(docs.where(mine), ledger, rules, generation=start + i + 1), "ledger", keep=True)
        ledger = new if ledger is None else ledger.unionByName(new)
    if ledger is None:
        ledger = scan_new_blobs(docs, None, rules)
    ids = docs.select("doc_id", blob_of(F.col("text")).alias("blob"))  # no text in the join
    return ids.join(findings(ledger, rules), "blob", "left").select("doc_id", "spans", "generation"), ledger


def spans_line(spans: Column) -> Column:
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))), ",")


PIECE = 256  # code points of the pieces that texts are cut into to be taken apart


def _cut(pieces: Column, low: Column, high: Column) -> Column:
    """The text from code point low up to high, out of its pieces: only those that it touches are looked at."""
    first, last = F.floor(low / PIECE).cast("int"), F.floor(high / PIECE).cast("int")
    at = lambda k: F.coalesce(F.get(pieces, k), F.lit(""))
    inside = F.substring(at(first), (low % PIECE + 1).cast("int"), (high - low).cast("int"))
    ends = lambda middle: F.concat(F.substring(at(first), (low % PIECE + 1).cast("int"), F.lit(PIECE)), F.array_join(middle, ""), F.substring(at(last), F.lit(1), (high % PIECE).cast("int")))
    return F.when(high <= low, "").when(first == last, inside).otherwise(ends(F.slice(pieces, first + 2, F.greatest(last - first - 1, F.lit(0)))))


def redact(text: Column, spans: Column, mark: str = "[SECRET]") -> Column:
    """The text with each run of overlapping or touching spans, which come in order of start, replaced by one mark. A null text, or null or no spans, leave it as it is.
    Time is in proportion to the text and its spans."""
    whole = F.coalesce(text, F.lit(""))
    nothing = F.lit(0).cast("bigint")

    def built(own: Column, pieces: Column) -> Column:
        reached = _before(F.transform(own, lambda s: s["end"]), lambda a, b: F.greatest(a, b), nothing)
        gaps = F.zip_with(own, reached, lambda s, at: F.when((s["start"] > at) | (at == 0), F.concat(_cut(pieces, at, s["start"]), F.lit(mark))).otherwise(""))
        end = F.aggregate(own, nothing, lambda at, s: F.greatest(at, s["end"]))
        return F.concat(F.array_join(gaps, ""), _let(end, lambda at: _cut(pieces, at, F.length(whole).cast("bigint"))))

    cut = F.regexp_extract_all(whole, F.lit(f"(?s).{{1,{PIECE}}}"), F.lit(0))
    return F.when(F.size(spans) > 0, _let(spans, lambda own: _let(cut, lambda pieces: built(own, pieces)))).otherwise(text)
