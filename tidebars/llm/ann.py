"""Approximate nearest neighbours by a hash-prefix forest."""

from __future__ import annotations

import math
from collections.abc import Iterator
from functools import cache, reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import as_table, scratch_tables

TREES, BITS = 24, 64
SIGNS, SYMBOLS = 7, 4  # bits of a symbol, one of the 2 * AXES directions; so many symbols lead a string, the rest are sides of hyperplanes
AXES = 1 << (SIGNS - 1)
LEAF_ROWS, LEAF_STEP = 1 << 16, 6  # rows of a leaf at most, and by how many bits a larger one is cut further
FIRST, ROUNDS = 96, 3  # nodes that the first ascent is to meet, and how many ascents there are before the root
MISSED = 0.11  # the chance, on average over the neighbours found, of missing such a neighbour at which a query stops
BLOCK_ROWS, BLOCK_PAIRS = 4096, 1 << 22  # nodes that are scored together, and how many pairs of them with queries at once
CLOSE = 4e-6  # how far cosines of single precision may be off


@cache
def _planes(dim: int) -> np.ndarray:
    """Random directions: for each tree the axes of its symbols and the normals of its hyperplanes."""
    return np.random.default_rng(17).standard_normal((dim, TREES * (SYMBOLS * AXES + BITS - SYMBOLS * SIGNS))).astype(np.float32)


def hash_strings(x: np.ndarray, second: bool = False) -> np.ndarray:
    """For each vector and tree a string of BITS bits, as a 64-bit number with its first bit on top: SYMBOLS times the axis (with its sign) that the vector is
    furthest along, of AXES random ones, then sides of hyperplanes. With second, its first symbol is the axis next to that."""
    own = (x @ _planes(x.shape[1])).reshape(len(x), TREES, -1)
    along = own[:, :, : SYMBOLS * AXES].reshape(len(x), TREES, SYMBOLS, AXES)
    far = np.abs(along)
    best = far.argmax(-1)
    if second:
        far = far[:, :, 0].copy()
        np.put_along_axis(far, best[:, :, :1], -1.0, -1)
        best[:, :, 0] = far.argmax(-1)
    sign = np.take_along_axis(along, best[..., None], -1)[..., 0] > 0
    out = np.zeros((len(x), TREES), np.uint64)
    for k in range(SYMBOLS):
        out = out << np.uint64(SIGNS) | (best[:, :, k] * 2 + sign[:, :, k]).astype(np.uint64)
    for k in range(SYMBOLS * AXES, own.shape[2]):
        out = out << np.uint64(1) | (own[:, :, k] > 0).astype(np.uint64)
    return out


@cache
def _shared(points: int = 101, pairs: int = 20_000) -> np.ndarray:
    """For cosines from 0 to 1 the chances that a neighbour's symbol is a vector's own, and that it is its second one: by random pairs."""
    rng, out = np.random.default_rng(5), np.zeros((points, 2))
    a, noise = (rng.standard_normal((pairs, AXES)).astype(np.float32) for _ in range(2))
    order = np.argsort(-np.abs(a), axis=1)[:, :2]
    code = lambda v, at: at * 2 + (np.take_along_axis(v, at[:, None], 1)[:, 0] > 0)
    for i, c in enumerate(np.linspace(0, 1, points)):
        b = c * a + math.sqrt(max(0.0, 1 - c * c)) * noise
        mine = code(b, np.abs(b).argmax(1))
        out[i] = (mine == code(a, order[:, 0])).mean(), (mine == code(a, order[:, 1])).mean()
    return out


LEVELS = (*range(SIGNS, SYMBOLS * SIGNS + 1, SIGNS), *range(SYMBOLS * SIGNS + 4, BITS + 1, 4))


@cache
def chances() -> dict[int, list[float]]:
    """For each of LEVELS the chance that one of the trees shares so many bits with a neighbour, for cosines from 0 to 1 in hundredths."""
    out = {}
    for level in LEVELS:
        own, both = _shared()[:, 0], np.minimum(_shared().sum(1), 1.0)
        side = 1 - np.arccos(np.linspace(0, 1, 101)) / math.pi
        one = both * own ** (min(SYMBOLS, level // SIGNS) - 1) * side ** max(0, level - SYMBOLS * SIGNS)
        out[level] = (1 - (1 - one) ** TREES).tolist()
    return out


def usable(v: Column) -> Column:
    """Not null or empty, without null or non-finite components, not zero."""
    fine = F.forall(v, lambda c: F.coalesce(~F.isnan(c) & (F.abs(c) < float("inf")), F.lit(False)))
    return F.coalesce((F.size(v) > 0) & fine & F.exists(v, lambda c: c != 0), F.lit(False))


def _unit(column: pa.Array) -> np.ndarray:
    x = np.array(column.to_pylist(), np.float64)
    return (x / np.linalg.norm(x, axis=1, keepdims=True)).astype(np.float32)


def _hashed(nodes: DataFrame, second: bool = False) -> DataFrame:
    """(tree, hash, node): every node's string in every tree; with second, the one that begins with its second symbol."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for low in range(0, whole.num_rows, 500):
                batch = whole.slice(low, 500)
                keys = hash_strings(_unit(batch.column("v")), second)
                tree = np.tile(np.arange(TREES, dtype=np.int32), len(keys))
                yield pa.RecordBatch.from_arrays([pa.array(tree), pa.array(keys.ravel().view(np.int64)), batch.column("node").take(pa.array(np.repeat(np.arange(len(keys)), TREES)))], ["tree", "hash", "node"])

    return nodes.select("node", "v").mapInArrow(run, "tree int, hash long, node long")


def forest(nodes: DataFrame, asked: DataFrame, n: int) -> DataFrame:
    """Rows (tree, bits, prefix, hash, node, query): the trees' strings, dealt to leaves. A leaf is all strings of a tree that begin with
    the same bits: as many bits as leaves of LEAF_ROWS / 2 need on average, more where a leaf would be larger. Queries have two rows
    more, in the leaves where their two strings fall."""
    bits = min(BITS - 4, max(0, math.ceil(math.log2(max(1, 2 * n / LEAF_ROWS)))))
    cut = lambda b: F.when(b > 0, F.expr(f"shiftrightunsigned(hash, cast({BITS} - bits as int))")).otherwise(F.lit(0).cast("long"))
    own = nodes.join(asked.select("node").distinct(), "node", "left_semi")
    rows = _hashed(nodes).withColumn("query", F.lit(False))
    rows = reduce(DataFrame.unionByName, (_hashed(own, second).withColumn("query", F.lit(True)) for second in (False, True)), rows)
    rows = rows.withColumn("bits", F.lit(bits)).withColumn("prefix", cut(F.col("bits")))
    rows = as_table(rows, "forest")
    while True:
        large = rows.where(~F.col("query")).groupBy("tree", "bits", "prefix").count().where((F.col("count") > LEAF_ROWS) & (F.col("bits") + LEAF_STEP < BITS)).drop("count")
        large = as_table(large, "large")
        if not large.limit(1).count():
            return rows
        deeper = rows.join(large, ["tree", "bits", "prefix"], "left_semi").withColumn("bits", F.col("bits") + LEAF_STEP).withColumn("prefix", cut(F.col("bits")))
        rows = as_table(rows.join(large, ["tree", "bits", "prefix"], "left_anti").unionByName(deeper.select(rows.columns)), "forest")


def _span(keys: np.ndarray, q: np.ndarray, level: np.ndarray | int) -> tuple[np.ndarray, np.ndarray]:
    """First and last place of the sorted keys that begin with q's first `level` bits."""
    low = np.where(np.asarray(level) >= BITS, np.uint64(0), np.uint64(0xFFFFFFFFFFFFFFFF) >> np.minimum(np.asarray(level), BITS - 1).astype(np.uint64))
    return np.searchsorted(keys, q & ~low, "left"), np.searchsorted(keys, q | low, "right")


def _counts(rows: DataFrame) -> DataFrame:
    """(qnode, tree, floor, counts): for each query and tree how many nodes of its leaf share its first 64, 63, ... bits, down to the leaf's."""

    def run(leaf: pa.Table) -> pa.Table:
        ask, key = leaf.column("query").to_numpy(), leaf.column("hash").to_numpy().view(np.uint64)
        floor, keys, q = leaf.column("bits")[0].as_py(), np.sort(key[~ask]), key[ask]
        levels = np.arange(BITS, floor - 1, -1)
        low, high = _span(keys, q[:, None], levels[None, :])
        n = (high - low).astype(np.int32)
        return pa.table([leaf.column("node").filter(pa.array(ask)), pa.array(np.repeat(leaf.column("tree")[0].as_py(), len(q)), pa.int32()), pa.array(np.full(len(q), floor), pa.int32()), pa.array(list(n), pa.list_(pa.int32()))], names=["qnode", "tree", "floor", "counts"])

    return rows.groupBy("tree", "bits", "prefix").applyInArrow(run, "qnode long, tree int, floor int, counts array<int>")


def _reached(rows: DataFrame, asks: DataFrame, blocks: int) -> DataFrame:
    """(qnode, block, nodes): the nodes that share `level` bits or more with a query in some tree, but fewer than `below`, by block of nodes. asks: qnode, level, below."""

    def run(leaf: pa.Table) -> pa.Table:
        ask, key, node, block = leaf.column("query").to_numpy(), leaf.column("hash").to_numpy().view(np.uint64), leaf.column("node").to_numpy(), leaf.column("block").to_numpy()
        order = np.argsort(key[~ask], kind="stable")
        keys, nodes, places = key[~ask][order], node[~ask][order], block[~ask][order]
        q, level, below = key[ask], leaf.column("level").to_numpy(zero_copy_only=False)[ask].astype(int), leaf.column("below").to_numpy(zero_copy_only=False)[ask].astype(int)
        low, high = _span(keys, q, level)
        skip, upto = _span(keys, q, np.minimum(below, BITS))
        found: list[tuple[int, int, np.ndarray]] = []
        for qnode, a, b, c, d, z in zip(node[ask].tolist(), low.tolist(), high.tolist(), skip.tolist(), upto.tolist(), below.tolist(), strict=True):
            at = np.concatenate([np.arange(a, c), np.arange(d, b)]) if z <= BITS else np.arange(a, b)
            at = at[np.argsort(places[at], kind="stable")]
            first = np.flatnonzero(np.diff(places[at], prepend=-1))
            found += [(qnode, int(places[at[i]]), part) for i, part in zip(first, np.split(nodes[at], first[1:]), strict=True)] if len(at) else []
        lists = pa.ListArray.from_arrays(pa.array(np.cumsum([0, *(len(x) for _, _, x in found)]), pa.int32()), pa.array(np.concatenate([np.zeros(0, np.int64), *(x for _, _, x in found)])))
        return pa.table([pa.array([f[0] for f in found], pa.int64()), pa.array([f[1] for f in found], pa.int32()), lists], names=["qnode", "block", "nodes"])

    mine = rows.where("query").join(asks.withColumnRenamed("qnode", "node"), "node")
    leaves = mine.select("tree", "bits", "prefix").distinct()
    own = rows.where(~F.col("query")).join(leaves, ["tree", "bits", "prefix"], "left_semi").withColumns({"level": F.lit(None).cast("int"), "below": F.lit(None).cast("int")})
    both = own.unionByName(mine.select(own.columns)).withColumn("block", F.pmod(F.xxhash64("node"), F.lit(blocks)).cast("int"))
    met = both.groupBy("tree", "bits", "prefix").applyInArrow(run, "qnode long, block int, nodes array<long>")
    return met.groupBy("qnode", "block").agg(F.array_distinct(F.flatten(F.collect_list("nodes"))).alias("nodes"))  # BLOCK_ROWS nodes at most


def _sequential(x: np.ndarray, q: np.ndarray) -> np.ndarray:
    """Cosines in double precision, summed in order, so that equal vectors have equal ones wherever they are worked out."""
    dots = [np.zeros(len(x)) for _ in range(3)]
    for j in range(x.shape[1]):
        for total, a, b in zip(dots, (x[:, j], x[:, j], q[j]), (q[j], x[:, j], q[j]), strict=True):
            total += a * b
    return dots[0] / (np.sqrt(dots[1]) * np.sqrt(dots[2]))


def _scored(asks: DataFrame, nodes: DataFrame, blocks: int, pairs: int, k: int) -> DataFrame:
    """(qnode, node, first, score, met): of each block the k + 1 best of the nodes that a query asks of it (nodes, or all if null), by exact cosine and then by the nodes'
    first ids, and on the first of them how many were scored. asks: qnode, block, nodes. A task has a block and some of the queries that ask of it."""
    parts = max(1, math.ceil(pairs / blocks / BLOCK_PAIRS))
    other = nodes.select(F.col("node").alias("qnode"), F.col("v").alias("qv"))
    mine = asks.join(other, "qnode").withColumn("part", F.pmod(F.xxhash64("qnode"), F.lit(parts)).cast("int"))
    own = nodes.select("node", F.get("ids", F.lit(0)).alias("first"), "v", F.pmod(F.xxhash64("node"), F.lit(blocks)).cast("int").alias("block"), F.explode(F.sequence(F.lit(0), F.lit(parts - 1))).alias("part"))

    def score(left: pa.Table, right: pa.Table) -> pa.Table:
        out: list[list] = [[], [], [], [], []]
        if left.num_rows and right.num_rows:
            order = np.argsort(left.column("node").to_numpy())
            node, first = left.column("node").to_numpy()[order], left.column("first").to_numpy()[order]
            x = np.array(left.column("v").to_pylist(), np.float64)[order]
            unit = (x / np.linalg.norm(x, axis=1, keepdims=True)).astype(np.float32)
            whole = np.arange(len(node))
            for qnode, q, some in zip(right.column("qnode").to_pylist(), np.array(right.column("qv").to_pylist(), np.float64), right.column("nodes"), strict=True):
                at = np.searchsorted(node, np.sort(some.values.to_numpy())) if some.is_valid else whole
                near = unit[at] @ (q / np.linalg.norm(q)).astype(np.float32)
                kept = at[near >= np.partition(near, -(k + 1))[-(k + 1)] - CLOSE] if len(near) > k + 1 else at
                exact = _sequential(x[kept], q)
                best = np.lexsort((first[kept], -exact))[: k + 1]
                for column, values in zip(out, ([qnode] * len(best), node[kept][best], first[kept][best], exact[best], [len(at)] + [0] * (len(best) - 1)), strict=True):
                    column.extend(values)
        return pa.table([pa.array(c, t) for c, t in zip(out, (pa.int64(), pa.int64(), pa.int64(), pa.float64(), pa.int64()), strict=True)], names=["qnode", "node", "first", "score", "met"])

    return own.groupBy("block", "part").cogroup(mine.groupBy("block", "part")).applyInArrow(score, "qnode long, node long, first long, score double, met long")


def _best(scores: DataFrame, k: int) -> DataFrame:
    at = F.row_number().over(Window.partitionBy("qnode").orderBy(F.col("score").desc(), "first"))
    once = scores.groupBy("qnode", "node", "first").agg(F.max("score").alias("score"))
    return once.withColumn("at", at).where(F.col("at") <= k)


def nearest(vectors: DataFrame, every: int = 50, k: int = 5, id_col: str = "vec_id", vector_col: str = "embedding", missed: float = MISSED) -> DataFrame:
    """query_id, rank, vec_id, score and scored: for each row whose id is divisible by `every`, the k nearest other rows by cosine, and
    how many nodes were scored for it.

    Vectors that are equal, or equal but for a power of two, are one node with its k + 1 smallest ids, which are all that an answer can need, so hot
    vectors cost nothing. Each tree holds the nodes' hash strings, sorted, in leaves of bounded size. A string begins with symbols, the random axes that a vector
    is furthest along, which tell a cosine of 0.4 from none far better than sides of planes do; those follow, for finer prefixes. A query has two
    strings in a tree, by its first and its second axis.

    1. Each query descends to its longest prefix matches; all trees ascend together, bit by bit, to the level at which FIRST nodes
       share so many bits with it in some tree. Only the counts of nodes by level are needed for that; then those nodes are scored.
    2. The k best scores found tell down to which level such neighbours would have been met in some tree, but for a chance of `missed` on average. Queries
       that stopped above it ascend to that level, or by a symbol, and only what is added is scored; so for ROUNDS.
    3. Where one symbol isn't enough (neighbours found at cosines under about 0.36), where the trees together have as many strings at a level as there are nodes, or where fewer than k others were met,
       a query ends at the root: it is scored against all nodes, exactly. With missed = 0 all do, and the search is exact.

    Nodes are scored in blocks, each once a round whatever the number of queries, and a query's ties are cut by id. So a query costs what its
    neighbourhood needs: of neighbours at a cosine of 0.9 some hundred nodes, of neighbours at 0.4 to 0.6 about a fourth of all. Strings
    of 60 equal bits are one leaf whatever its size: nodes of one direction to within a few degrees.

    Unusable vectors, rows without an id, and vectors of another length than most have take no part. Repeated ids are separate
    rows; one with the query's id is not its neighbour. Fewer candidates than k give all of them; an empty table gives an empty one."""
    spark = vectors.sparkSession
    with scratch_tables(spark):
        own = vectors.select(F.col(id_col).cast("long").alias("vec_id"), F.col(vector_col).alias("v")).where(F.col("vec_id").isNotNull() & usable(F.col("v")))
        dim = own.groupBy(F.size("v").alias("dim")).count().orderBy(F.col("count").desc(), F.col("dim").desc()).first()
        if dim is None:
            return spark.createDataFrame([], "query_id long, rank int, vec_id long, score double, scored long")
        return as_table(_nearest(own.where(F.size("v") == dim["dim"]), every, k, missed), "nearest", keep=True)


def _one_scale(v: Column) -> Column:
    """The vector times the power of two that brings its largest component to between 1 and 2: exact, and the same cosines."""
    top = F.array_max(F.transform(v, lambda c: F.abs(c.cast("double"))))
    return F.transform(v, lambda c: c.cast("double") * F.pow(F.lit(2.0), -F.floor(F.log2(top))))


def _nearest(own: DataFrame, every: int, k: int, missed: float) -> DataFrame:
    own = own.withColumn("v", _one_scale(F.col("v")))
    own = own.withColumns({"h1": F.xxhash64("v"), "h2": F.xxhash64("v", F.lit(1))})
    first = Window.partitionBy("h1", "h2").orderBy("vec_id")
    few = own.withColumn("at", F.row_number().over(first)).where(F.col("at") <= k + 1)
    nodes = few.groupBy("h1", "h2").agg(F.min_by("v", "at").alias("v"), F.array_sort(F.collect_list("vec_id")).alias("ids"))
    nodes = as_table(nodes.withColumn("node", F.monotonically_increasing_id()), "nodes")
    asked = own.where(F.col("vec_id") % every == 0).select(F.col("vec_id").alias("query_id"), "h1", "h2").join(nodes.select("h1", "h2", "node"), ["h1", "h2"])
    asked = as_table(asked.select("query_id", "node"), "asked")
    n = nodes.count()
    blocks = max(1, -(-n // BLOCK_ROWS))
    rows = forest(nodes, asked, n)

    # How many nodes share so many bits, over all trees, for every level; beyond its leaf a tree adds nothing.
    counts = _counts(rows).select("qnode", "floor", F.posexplode("counts").alias("i", "n")).withColumn("level", F.lit(BITS) - F.col("i"))
    levels = counts.groupBy("qnode", "level").agg(F.sum("n").alias("n"), F.max("floor").alias("floor"))
    levels = as_table(levels.withColumn("floor", F.max("floor").over(Window.partitionBy("qnode"))).where(F.col("level") >= F.col("floor")), "levels")
    start = levels.groupBy("qnode").agg(F.max(F.when(F.col("n") >= FIRST, F.struct("level", "n"))).alias("enough"), F.min(F.struct("level", "n")).alias("all"))
    start = start.select("qnode", F.coalesce("enough", "all").alias("s")).select("qnode", F.col("s.level").alias("level"), F.lit(BITS + 1).alias("below"), F.col("s.n").alias("n"))

    asks, scores = as_table(start.where(F.col("n") <= max(FIRST, n)) if missed > 0 else start.limit(0), "asks"), []
    hundredth = lambda c: F.floor(F.greatest(F.lit(0.0), F.least(F.lit(1.0), c)) * 100).cast("int")
    chance = lambda level: F.aggregate("near", F.lit(0.0), lambda total, c: total + F.get(F.lit(chances()[level]), hundredth(c)) / k)
    need = F.greatest(F.lit(0), *(F.when(chance(level) >= 1 - missed, level).otherwise(0) for level in LEVELS))
    for turn in range(ROUNDS):
        pairs = asks.agg(F.sum("n")).first()[0] or 0
        scores.append(as_table(_scored(_reached(rows, asks.select("qnode", "level", "below"), blocks), nodes, blocks, pairs, k), "scores"))
        others = _best(reduce(DataFrame.unionByName, scores), k + 1).where("at > 1").groupBy("qnode").agg(F.collect_list("score").alias("near"))
        kth = others.where(F.size("near") == k).select("qnode", need.alias("need"))
        state = asks.join(kth, "qnode", "left")
        met = state.where(F.col("need") >= F.col("level")).select("qnode")
        done = as_table(met if turn == 0 else done.unionByName(met), "done")
        if turn + 1 == ROUNDS:
            break
        # To the level needed; where none is, or few were met, by a symbol: more nodes may show that one is enough.
        up = F.when(F.col("need") > 0, F.col("need")).otherwise(F.floor((F.col("level") - 1) / SIGNS) * SIGNS).cast("int")
        higher = state.where(F.coalesce(F.col("need") < F.col("level"), F.lit(True))).select("qnode", up.alias("level"), F.col("level").alias("below")).where(F.col("level") >= SIGNS)
        asks = as_table(higher.join(levels.select("qnode", "level", "n"), ["qnode", "level"]).where(F.col("n") <= n), "asks")

    everyone = asked.select("node").distinct().withColumnRenamed("node", "qnode")
    poor = as_table(everyone.join(done, "qnode", "left_anti"), "poor")
    if many := poor.count():
        every_block = poor.select("qnode", F.explode(F.sequence(F.lit(0), F.lit(blocks - 1))).alias("block"), F.lit(None).cast("array<long>").alias("nodes"))
        scores.append(_scored(every_block, nodes, blocks, many * n, k))
    found = reduce(DataFrame.unionByName, scores)
    short = _best(found, k + 1).join(nodes.select("node", "ids"), "node")
    cost = found.groupBy("qnode").agg(F.sum("met").alias("scored"))
    answers = asked.select("query_id", F.col("node").alias("qnode")).join(short, "qnode").select("query_id", "qnode", F.explode("ids").alias("vec_id"), "score").where("vec_id <> query_id")
    rank = F.row_number().over(Window.partitionBy("query_id").orderBy(F.col("score").desc(), "vec_id"))
    ranked = answers.withColumn("rank", rank.cast("int")).where(F.col("rank") <= k)
    return ranked.join(cost, "qnode").select("query_id", "rank", "vec_id", "score", "scored")
