"""Near duplicates by MinHash with tensored banding, confirmed on full shingle sets."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import as_table, mix64, scratch_tables, text_slices, word_hashes

WORDS = 5  # in a shingle
G = 3  # minhashes in a group
SKETCH = 192  # smallest shingle hashes that are kept to screen candidates
CROWD, STRIP = 64, 1000  # nodes of one group that meet by a join at most; of a larger one's strips, which are compared as matrices
SIGMAS = 5.5  # how far a sketch may fall short of what a pair at the threshold has on average
SIGNATURE = "doc_id long, n_shingles long, set_hash binary, groups array<long>, sketch array<int>"


def shingle_sets(blobs: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """Sorted distinct 64-bit shingle hashes of each text, and offsets. With fewer than WORDS words the whole sequence is
    one shingle; without words there is none."""
    h, offsets = word_hashes(blobs)
    factor = mix64(np.arange(1, WORDS + 1, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15)) | np.uint64(1)
    all_ = np.zeros(max(0, len(h) - WORDS + 1), np.uint64)
    for k in range(WORDS):
        all_ += h[k : k + len(all_)] * factor[k]
    all_ = mix64(all_)
    sets = []
    for a, b in zip(offsets[:-1].tolist(), offsets[1:].tolist(), strict=True):
        n = b - a
        if n >= WORDS:
            sets.append(np.unique(all_[a : b - WORDS + 1]))
        elif n:
            sets.append(mix64(np.array([int((h[a:b] * factor[:n]).sum(dtype=np.uint64)) ^ (n * 0x1851F42D4C957F2D)], np.uint64)))
        else:
            sets.append(np.zeros(0, np.uint64))
    return np.concatenate(sets) if sets else np.zeros(0, np.uint64), np.cumsum([0, *map(len, sets)])


def groups_for(num: int, den: int, missed: float = 5e-4) -> int:
    """How many groups each of the two collections needs so that a pair at the threshold shares none of one of them, and so no
    table key, with a probability of at most `missed`."""
    u = 1
    while 2 * (1 - (num / den) ** G) ** u > missed:
        u += 1
    return u


def signatures(docs: DataFrame, u: int, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """SIGNATURE rows and text_hash, one for each row. groups: 2 * u numbers, each of G minhashes: u * u tables from 2 * u * G
    minhashes. sketch: the smallest shingle hashes."""
    rng = np.random.default_rng(85)
    xors, factors = rng.integers(0, 1 << 63, 2 * u * G, dtype=np.uint64), rng.integers(0, 1 << 63, 2 * u * G, dtype=np.uint64) | np.uint64(1)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch, blobs in text_slices(batches, "text"):
            flat, offsets = shingle_sets(blobs)
            full = np.flatnonzero(np.diff(offsets))
            groups = np.zeros((len(blobs), 2 * u), np.uint64)
            if len(full):
                firsts = offsets[full]
                for j in range(2 * u):
                    mins = [np.minimum.reduceat((flat ^ xors[k]) * factors[k], firsts) for k in range(j * G, j * G + G)]
                    groups[full, j] = mix64(sum((m * np.uint64(2 * i + 3) for i, m in enumerate(mins)), np.full(len(full), j, np.uint64)))
            hashes, sketches = [], []
            for a, b in zip(offsets[:-1].tolist(), offsets[1:].tolist(), strict=True):
                s = flat[a:b]
                hashes.append(hashlib.blake2b(s.tobytes(), digest_size=16).digest() if b > a else None)
                sketches.append((s[:SKETCH] >> np.uint64(32)).astype(np.uint32).view(np.int32))
            width = np.cumsum([0, *map(len, sketches)]).astype(np.int32)
            yield pa.RecordBatch.from_arrays(
                [
                    batch.column("doc_id"),
                    batch.column("text_hash"),
                    pa.array(np.diff(offsets), pa.int64()),
                    pa.array(hashes, pa.binary()),
                    pa.ListArray.from_arrays(pa.array(np.arange(len(blobs) + 1, dtype=np.int32) * (2 * u)), pa.array(groups.ravel().view(np.int64))),
                    pa.ListArray.from_arrays(pa.array(width), pa.array(np.concatenate(sketches) if sketches else np.zeros(0, np.int32))),
                ],
                ["doc_id", "text_hash", "n_shingles", "set_hash", "groups", "sketch"],
            )

    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), _text_hash(F.col(text_col)).alias("text_hash"), F.col(text_col).alias("text"))
    return rows.mapInArrow(run, SIGNATURE.replace("n_shingles", "text_hash string, n_shingles"))


def _text_hash(text: Column) -> Column:
    return F.md5(F.coalesce(text, F.lit("")))


def tensor_keys(nodes: DataFrame, u: int) -> DataFrame:
    """(key, node): the table keys. Only groups that two nodes share can make a shared key, so the 2 * u groups are counted
    first and keys are formed from pairs of shared groups alone."""
    groups = nodes.select("node", F.posexplode("groups").alias("at", "value"))
    shared = groups.groupBy("at", "value").agg(F.count("*").alias("n")).where("n > 1").select("at", "value")
    mine = groups.join(shared, ["at", "value"]).groupBy("node").agg(
        F.collect_list(F.when(F.col("at") < u, F.struct("at", "value"))).alias("left"), F.collect_list(F.when(F.col("at") >= u, F.struct("at", "value"))).alias("right")
    )
    keys = mine.select("node", F.explode("left").alias("l"), "right").select("node", "l", F.explode("right").alias("r")).select(F.xxhash64("l.at", "l.value", "r.at", "r.value").alias("key"), "node")
    many = keys.groupBy("key").agg(F.count("*").alias("n")).where("n > 1").select("key")
    return keys.join(many, "key")


def overlap_needed(na: Column, nb: Column, num: int, den: int) -> Column:
    """The least intersection of sets of these sizes whose Jaccard similarity is num / den or more."""
    return F.ceil((na + nb) * F.lit(num) / F.lit(num + den))


def sketch_need(na: Column, nb: Column, num: int, den: int, sigmas: float) -> Column:
    """Common sketch entries of a pair at the threshold, less so many standard deviations. Exact where both sets are whole
    in their sketches."""
    most, need = F.greatest(na, nb), overlap_needed(na, nb, num, den)
    part, k = need / most, F.least(most, F.lit(SKETCH))
    return F.when(most <= SKETCH, need).otherwise(part * k - sigmas * F.sqrt(k * part * F.abs(1 - part) * (1 - SKETCH / most)))


def components(edges: DataFrame) -> DataFrame:
    """(node, root): the smallest node that each node of edges (a, b) reaches, by alternating large and small stars.

    Each round is a few group minima and joins, and its edges are written; hot nodes are skewed joins, nothing is collected."""
    now = as_table(edges.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).where("u <> v").distinct(), "edges")
    before = None
    while True:
        mark = now.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        if mark == before or mark[0] == 0:
            return now.select(F.col("u").alias("node"), F.col("v").alias("root")).unionByName(now.select(F.col("v").alias("node"), F.col("v").alias("root")).distinct())
        before = mark
        both = now.unionByName(now.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        large = both.join(least, "u").where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v").distinct()
        least = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(least, "u").where("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v"))
        now = as_table(small.unionByName(least.select("u", F.col("m").alias("v"))).distinct(), "edges")


def _first_shared(low: int, u: int) -> Column:
    """Which group, from 1, of a collection is the first that nodes with groups ga and gb share; 0: none."""
    return F.array_position(F.zip_with(F.slice("ga", low + 1, u), F.slice("gb", low + 1, u), lambda p, q: p == q), F.lit(True))


def _meetings(members: DataFrame, u: int, num: int, den: int) -> DataFrame:
    """Pairs (a, b) of members (node, root, n, groups, sketch) with different roots that share a table key and pass the screen.

    Nodes meet by the groups of the first collection, in the first that they share, if they share one of the second too. The
    nodes of a group of more than CROWD are dealt into strips of about STRIP, and every two strips are a tile, which one task compares
    by products of small matrices. So texts just under the threshold cost time in the square of their number, spread over tiles, but
    no task holds more than two strips, and only pairs that pass leave it."""
    grouped = members.select("node", F.posexplode(F.slice("groups", 1, u)).alias("i", "value"))
    counts = as_table(grouped.groupBy("i", "value").count().where("count > 1"), "counts")
    few = grouped.join(counts.where(F.col("count") <= CROWD).select("i", "value"), ["i", "value"]).join(members, "node")
    x, y = (few.select("i", "value", F.col("node").alias(k), F.col("root").alias(f"r{k}"), F.col("n").alias(f"n{k}"), F.col("groups").alias(f"g{k}"), F.col("sketch").alias(f"s{k}")) for k in "ab")
    common = F.size(F.array_intersect("sa", "sb"))
    near = (F.least("na", "nb") * F.lit(den) >= F.greatest("na", "nb") * F.lit(num)) & (common >= sketch_need(F.col("na"), F.col("nb"), num, den, SIGMAS))
    table = (_first_shared(0, u) == F.col("i") + 1) & (_first_shared(u, u) > 0)
    found = x.join(y, ["i", "value"]).where((F.col("a") < F.col("b")) & (F.col("ra") != F.col("rb")) & table & near).select("a", "b")
    many = counts.where(F.col("count") > CROWD).select("i", "value", F.ceil(F.col("count") / STRIP).cast("int").alias("strips"))
    if not many.limit(1).count():
        return found.distinct()
    dealt = grouped.join(many, ["i", "value"]).withColumn("own", F.pmod(F.xxhash64("node"), "strips").cast("int")).withColumn("other", F.explode(F.sequence(F.lit(0), F.col("strips") - 1)))
    dealt = dealt.withColumns({"low": F.least("own", "other"), "high": F.greatest("own", "other")}).select("i", "value", "low", "high", "own", "node")
    compared = dealt.join(members, "node").groupBy("i", "value", "low", "high").applyInArrow(_tile(u, num, den), "a long, b long")
    return found.unionByName(compared).distinct()


def _tile(u: int, num: int, den: int):
    def lists(column: pa.ChunkedArray) -> tuple[np.ndarray, np.ndarray]:
        whole = column.combine_chunks()
        return whole.flatten().to_numpy(), np.diff(whole.offsets.to_numpy())

    def compare(tile: pa.Table) -> pa.Table:
        node, root, n = (tile.column(c).to_numpy() for c in ("node", "root", "n"))
        own, i = tile.column("own").to_numpy(), tile.column("i")[0].as_py()
        left, right = (np.flatnonzero(own == tile.column(c)[0].as_py()) for c in ("low", "high"))
        groups = lists(tile.column("groups"))[0].reshape(len(node), 2 * u)
        mask = np.outer(np.ones(len(left), bool), np.ones(len(right), bool))
        for j in range(i):  # the first group that they share is this one
            mask &= groups[left, j][:, None] != groups[right, j][None, :]
        shared = np.zeros_like(mask)
        for j in range(u, 2 * u):
            shared |= groups[left, j][:, None] == groups[right, j][None, :]
        most, least = np.maximum.outer(n[left], n[right]), np.minimum.outer(n[left], n[right])
        mask &= shared & (root[left][:, None] != root[right][None, :]) & (least * den >= most * num)
        if len(left) == len(right) and (left == right).all():
            mask &= np.tri(len(left), k=-1, dtype=bool)
        if mask.any():
            entry, widths = lists(tile.column("sketch"))
            _, column, times = np.unique(entry, return_inverse=True, return_counts=True)
            row = np.repeat(np.arange(len(node)), widths)
            place = np.full(len(times), -1)
            place[times > 1] = np.arange((times > 1).sum())
            column = place[column]
            common = np.zeros(mask.shape, np.float32)
            for low in range(0, int((times > 1).sum()), 4096):
                some = (column >= low) & (column < low + 4096)
                has = np.zeros((len(node), 4096), np.float32)
                has[row[some], column[some] - low] = 1
                common += has[left] @ has[right].T
            need = np.ceil((least + most) * (num / (num + den)))
            part, k = need / most, np.minimum(most, SKETCH)
            wide = part * k - SIGMAS * np.sqrt(k * part * np.abs(1 - part) * np.maximum(0, 1 - SKETCH / most))
            mask &= common >= np.where(most <= SKETCH, need, wide) - 1e-3
        x, y = np.nonzero(mask)
        a, b = node[left][x], node[right][y]
        return pa.table([pa.array(np.minimum(a, b)), pa.array(np.maximum(a, b))], names=["a", "b"])

    return compare


def _confirmed(pairs: DataFrame, nodes: DataFrame, docs: DataFrame, num: int, den: int) -> DataFrame:
    """pairs (a, b) with ok: whether the full sets' similarity is num / den or more. Only the texts of nodes in pairs are
    hashed again; each pair's two sets meet in one row."""
    wanted = pairs.select(F.col("a").alias("node")).unionByName(pairs.select(F.col("b").alias("node"))).distinct().join(nodes.select("node", "text_hash", "set_hash"), "node")
    texts = docs.select(_text_hash(F.col("text")).alias("text_hash"), "text").join(wanted, "text_hash").groupBy("node").agg(F.first("set_hash").alias("set_hash"), F.first("text").alias("text"))

    def sets(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch, blobs in text_slices(batches, "text"):
            flat, offsets = shingle_sets(blobs)
            own = [flat[a:b].tobytes() for a, b in zip(offsets[:-1].tolist(), offsets[1:].tolist(), strict=True)]
            same = [hashlib.blake2b(s, digest_size=16).digest() == h for s, h in zip(own, batch.column("set_hash").to_pylist(), strict=True)]
            yield pa.RecordBatch.from_arrays([batch.column("node").filter(pa.array(same)), pa.array([s for s, k in zip(own, same, strict=True) if k], pa.binary())], ["node", "shingles"])

    have = as_table(texts.mapInArrow(sets, "node long, shingles binary"), "sets")

    def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ok = []
            for x, y in zip(batch.column("sa"), batch.column("sb"), strict=True):
                x, y = np.frombuffer(x.as_buffer(), np.uint64), np.frombuffer(y.as_buffer(), np.uint64)
                both = len(x) + len(y) - len(np.union1d(x, y))
                ok.append(den * both >= num * (len(x) + len(y) - both))
            yield pa.RecordBatch.from_arrays([batch.column("a"), batch.column("b"), pa.array(ok, pa.bool_())], ["a", "b", "ok"])

    joined = pairs.join(have.select(F.col("node").alias("a"), F.col("shingles").alias("sa")), "a").join(have.select(F.col("node").alias("b"), F.col("shingles").alias("sb")), "b")
    return as_table(joined.select("a", "b", "sa", "sb").mapInArrow(compare, "a long, b long, ok boolean"), "confirmed")


def near_duplicates(docs: DataFrame, num: int = 85, den: int = 100) -> DataFrame:
    """doc_id, n_shingles, component_id and kept for every row: texts whose sets of five-word shingles have a Jaccard
    similarity of num / den or more are linked, components are what links reach, and the smallest doc_id of each is kept.

    1. Rows with equal sets are one node, so copies cost nothing after the signatures.
    2. Nodes that share a table key are candidates: each with the smallest node of its bucket, screened by sketches.
    3. Candidates that pass the screen clearly join nodes for now; other pairs in a bucket are looked at only where these
       joins don't already connect them; see _meetings.
    4. All screened pairs are confirmed on full sets, and only confirmed links count. If a provisional join fails, step 3
       runs again over confirmed links until no new pair turns up, so no pair in a bucket is missed for it.

    A pair at the threshold is missed with a probability of at most 5e-4 by the tables, and about 1e-4 by the screen.
    Texts without words (null, empty) are linked with nothing. Ids may be null or repeated, and rows may repeat: rows with equal
    sets are one node, whatever their ids. A row with a null doc_id has the smallest doc_id of its component or null, and is
    not kept; rows that repeat a kept doc_id are kept. Other columns of docs are ignored."""
    with scratch_tables(docs.sparkSession):
        return as_table(_classes(docs, num, den), "classes", keep=True)


def _classes(docs: DataFrame, num: int, den: int) -> DataFrame:
    u = groups_for(num, den)
    rows = as_table(signatures(docs, u), "signatures")
    first = F.min_by(F.struct("n_shingles", "groups", "sketch", "text_hash"), "text_hash")
    nodes = rows.where("n_shingles > 0").groupBy("set_hash").agg(F.min("doc_id").alias("first_id"), first.alias("f")).select("set_hash", "first_id", F.col("f.n_shingles").alias("n"), "f.groups", "f.sketch", "f.text_hash")
    nodes = as_table(nodes.withColumn("node", F.monotonically_increasing_id()), "nodes")
    keys = as_table(tensor_keys(nodes.select("node", "groups"), u), "keys")
    a, b = (nodes.select(F.col("node").alias(x), F.col("n").alias(f"n{x}"), F.col("sketch").alias(f"s{x}")) for x in "ab")
    common = F.size(F.array_intersect("sa", "sb"))
    star = keys.join(keys.groupBy("key").agg(F.min("node").alias("a")), "key").where("node <> a").select("a", F.col("node").alias("b")).distinct()
    star = star.join(a, "a").join(b, "b").withColumn("common", common).where(F.col("common") >= sketch_need(F.col("na"), F.col("nb"), num, den, SIGMAS))
    tried = as_table(star.select("a", "b", (F.col("common") >= sketch_need(F.col("na"), F.col("nb"), num, den, -1.0)).alias("clear")), "star")
    linked, confirmed = tried.where("clear").select("a", "b"), None
    tried = tried.select("a", "b")
    while True:
        roots = components(linked)
        of = keys.join(roots, "node", "left").select("key", "node", F.coalesce("root", "node").alias("root"))
        open_ = of.groupBy("key").agg(F.min("root").alias("lo"), F.max("root").alias("hi")).where("lo <> hi").select("key")
        members = as_table(of.join(open_, "key").select("node", "root").distinct().join(nodes.select("node", "n", "groups", "sketch"), "node"), "members")
        rest = _meetings(members, u, num, den)
        new = as_table(rest.join(tried, ["a", "b"], "left_anti"), "rest")
        todo = new if confirmed is not None else tried.unionByName(new)
        if confirmed is None or new.limit(1).count():
            more = _confirmed(todo, nodes, docs, num, den)
            confirmed, tried = (more if confirmed is None else confirmed.unionByName(more)), tried.unionByName(new)
        elif confirmed is not None:
            break
        good = confirmed.where("ok").select("a", "b")
        if not linked.join(good, ["a", "b"], "left_anti").limit(1).count():
            linked = good
            break
        linked = good
    member = nodes.select("set_hash", "node", "first_id").join(components(linked), "node", "left").withColumn("root", F.coalesce("root", "node"))
    smallest = member.groupBy("root").agg(F.min("first_id").alias("component_id"))
    found = member.join(smallest, "root").select("set_hash", "component_id")
    out = rows.select("doc_id", "n_shingles", "set_hash").join(found, "set_hash", "left")
    out = out.withColumn("component_id", F.when(F.col("n_shingles") > 0, F.col("component_id")).otherwise(F.col("doc_id")))
    return out.select("doc_id", "n_shingles", "component_id", F.coalesce(F.col("doc_id") == F.col("component_id"), F.lit(False)).alias("kept"))
