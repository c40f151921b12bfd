"""Small numpy classifiers over documents: quality from random-indexing vectors, toxicity from positive and unlabelled text."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import BLOCKS, array_blocks, as_table, scratch_tables, shape_hashes, summed, text_slices, word_hashes


def _sigmoid(z: np.ndarray) -> np.ndarray:
    return 0.5 * (1 + np.tanh(0.5 * z))


def labelled_sample(docs: DataFrame, labels: DataFrame, label: str, most: int) -> DataFrame:
    """doc_id, text and y of at most `most` labelled rows, those with the smallest hashes of their ids, one row an id: of
    documents that share an id the least text, of labels that share one the largest. Labels without an id or a value are left out."""
    some = labels.where(F.col("doc_id").isNotNull() & F.col(label).isin(0, 1)).groupBy("doc_id").agg(F.max(label).cast("int").alias("y"))
    some = some.orderBy(F.xxhash64("doc_id"), "doc_id").limit(most)  # bounded by most, so it can be broadcast
    return docs.select("doc_id", "text").join(F.broadcast(some), "doc_id").groupBy("doc_id", "y").agg(F.min("text").alias("text"))


def _score(docs: DataFrame, predict: Callable[[list[bytes]], np.ndarray], whole: bool = False, out: str = "score") -> DataFrame:
    """doc_id and the score as column out, for every row; with whole, all columns and out, which no column of docs may be called."""
    rows = docs if whole else docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    own = docs.columns if whole else ["doc_id"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch, blobs in text_slices(batches, "text"):
            yield pa.RecordBatch.from_arrays([*map(batch.column, own), pa.array(predict(blobs), pa.float64())], [*own, out])

    return rows.mapInArrow(run, T.StructType([*rows.select(own).schema, T.StructField(out, T.DoubleType())]))


# --- quality -----------------------------------------------------------------------------------------------------

WORD_ROWS, SHAPE_ROWS, DIM, SPOTS, REACH = 1 << 14, 1 << 12, 32, 4, 2


def _index_vectors(rows: int, seed: int) -> tuple[np.ndarray, np.ndarray]:
    """A sparse ternary vector for each row: SPOTS places and signs."""
    rng = np.random.default_rng(seed)
    return rng.integers(0, DIM, (rows, SPOTS)), rng.choice(np.array([-1, 1], np.int32), (rows, SPOTS))


def _streams(blobs: list[bytes]) -> list[tuple[np.ndarray, np.ndarray]]:
    return [((h % np.uint64(n)).astype(np.int64), o) for (h, o), n in ((word_hashes(blobs, lower=False), WORD_ROWS), (shape_hashes(blobs), SHAPE_ROWS))]


def context_vectors(docs: DataFrame) -> list[np.ndarray]:
    """Random-indexing vectors of hashed words and of hashed word shapes: each row of the tables is the sum of the index
    vectors of all neighbours within REACH words, over all documents, scaled to unit length. The tables' size is fixed."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tables = [np.zeros(n * DIM, np.int32) for n in (WORD_ROWS, SHAPE_ROWS)]
        index = [_index_vectors(WORD_ROWS, 1), _index_vectors(SHAPE_ROWS, 2)]
        for _, blobs in text_slices(batches, "text"):
            for table, (places, signs), (rows, offsets) in zip(tables, index, _streams(blobs), strict=True):
                doc = np.repeat(np.arange(len(blobs)), np.diff(offsets))
                for reach in range(1, REACH + 1):
                    if len(rows) <= reach:
                        continue
                    same = doc[reach:] == doc[:-reach]
                    left, right = rows[:-reach][same], rows[reach:][same]
                    for me, other in ((left, right), (right, left)):
                        at = me * DIM
                        for k in range(SPOTS):
                            np.add.at(table, at + places[other, k], signs[other, k])
        yield from array_blocks(np.concatenate(tables))

    total = summed(docs.select("text").mapInArrow(run, BLOCKS), (WORD_ROWS + SHAPE_ROWS) * DIM).reshape(-1, DIM)
    total /= np.maximum(np.linalg.norm(total, axis=1, keepdims=True), 1e-9)
    return [total[:WORD_ROWS], total[WORD_ROWS:]]


def pooled(blobs: list[bytes], vectors: list[np.ndarray]) -> np.ndarray:
    """Mean vectors of each text's words and shapes, the log of its length, and its shares of distinct words and shapes."""
    out = []
    for (rows, offsets), table in zip(_streams(blobs), vectors, strict=True):
        n = np.diff(offsets)
        full = np.flatnonzero(n)
        mean, distinct = np.zeros((len(blobs), DIM), np.float32), np.zeros((len(blobs), 1), np.float32)
        if len(full):
            mean[full] = np.add.reduceat(table[rows], offsets[:-1][full], axis=0) / n[full, None]
            doc = np.repeat(np.arange(len(blobs)), n)
            seen = np.unique(doc * (1 << 20) + rows) >> 20
            distinct[:, 0] = np.bincount(seen, minlength=len(blobs)) / np.maximum(n, 1)
        out += [mean, distinct]
    return np.concatenate([*out, np.log1p(n)[:, None].astype(np.float32)], 1)


class TwoLayers:
    """Features, tanh units, one logit. Fitted by Adam; its temperature is set on rows that the fit doesn't see."""

    def __init__(self, x: np.ndarray, y: np.ndarray, hidden: int = 32, epochs: int = 40, seed: int = 0):
        rng = np.random.default_rng(seed)
        self.prior, self.temperature = (float(y.mean()) if len(y) else 0.5), 1.0
        self.shift, self.scale = (x.mean(0), x.std(0) + 1e-6) if len(x) else (0.0, 1.0)
        self.w = None
        if len(set(y.tolist())) < 2:
            return
        x = (x - self.shift) / self.scale
        held = rng.random(len(x)) < 0.15
        if len(set(y[held].tolist())) < 2 or len(set(y[~held].tolist())) < 2:
            held[:] = False
        fx, fy = x[~held], y[~held].astype(np.float32)
        w = [rng.normal(0, 1 / np.sqrt(x.shape[1]), (x.shape[1], hidden)), np.zeros(hidden), rng.normal(0, 1 / np.sqrt(hidden), hidden), np.array(np.log((fy.mean() + 1e-3) / (1 - fy.mean() + 1e-3)))]
        w = [p.astype(np.float32) for p in w]
        m, v, t = [np.zeros_like(p) for p in w], [np.zeros_like(p) for p in w], 0
        for _ in range(epochs):
            order = rng.permutation(len(fx))
            for some in np.array_split(order, max(1, len(order) // 128)):
                h = np.tanh(fx[some] @ w[0] + w[1])
                d = (_sigmoid(h @ w[2] + w[3]) - fy[some]) / len(some)
                back = d[:, None] * w[2] * (1 - h * h)
                t += 1
                for i, g in enumerate((fx[some].T @ back + 1e-4 * w[0], back.sum(0), h.T @ d + 1e-4 * w[2], d.sum())):
                    m[i] = 0.9 * m[i] + 0.1 * g
                    v[i] = 0.999 * v[i] + 0.001 * g * g
                    w[i] = w[i] - 0.005 * (m[i] / (1 - 0.9**t)) / (np.sqrt(v[i] / (1 - 0.999**t)) + 1e-8)
        self.w = w
        if held.any():
            z, hy = self._logits(x[held]), y[held]
            losses = [(np.logaddexp(0, np.where(hy == 1, -z, z) / s).mean(), s) for s in np.geomspace(0.25, 8, 41)]
            self.temperature = float(min(losses)[1])

    def _logits(self, x: np.ndarray) -> np.ndarray:
        return np.tanh(x @ self.w[0] + self.w[1]) @ self.w[2] + self.w[3]

    def __call__(self, x: np.ndarray) -> np.ndarray:
        if self.w is None:
            return np.full(len(x), self.prior)
        return _sigmoid(self._logits((x - self.shift) / self.scale).astype(np.float64) / self.temperature)


def quality_scores(docs: DataFrame, labels: DataFrame, label: str = "quality", most: int = 20_000, whole: bool = False, out: str = "score") -> DataFrame:
    """doc_id (with whole: all columns) and out, the calibrated probability of label 1, for every row of docs (null text: empty).

    Vectors come from all documents; the network is fitted on at most `most` of the given labels, one text an id. With labels of
    one class only, or none, every score is their mean or 0.5. Null ids, repeated ids and repeated rows are judged by their own texts,
    whole texts however long; with whole, columns pass through whatever their names, but none may be called out."""
    spark = docs.sparkSession
    vectors = spark.sparkContext.broadcast(context_vectors(docs))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch, blobs in text_slices(batches, "text"):
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), batch.column("y"), pa.array([r.tobytes() for r in pooled(blobs, vectors.value)], pa.binary())], ["doc_id", "y", "x"])

    rows = labelled_sample(docs, labels, label, most).mapInArrow(run, "doc_id long, y int, x binary").collect()
    rows.sort(key=lambda r: (r["doc_id"], bytes(r["x"])))
    width = 2 * (DIM + 1) + 1
    x = np.frombuffer(b"".join(r["x"] for r in rows), np.float32).reshape(-1, width)
    net = spark.sparkContext.broadcast(TwoLayers(x, np.array([r["y"] for r in rows], np.int64)))
    return _score(docs, lambda blobs: net.value(pooled(blobs, vectors.value)), whole, out)


# --- toxicity ----------------------------------------------------------------------------------------------------

BUCKETS = 1 << 18


HEADS, TIMES = (4, 5, 6, 7), (1, 2, 4)


def word_buckets(blobs: list[bytes]) -> list[np.ndarray]:
    """Distinct hashed features of each text: that a word (punctuation apart), or a head of some bytes that longer words
    begin with, stands there at least so many TIMES."""
    words, offsets = word_hashes(blobs, punctuation=True)
    heads, _ = word_hashes(blobs, punctuation=True, heads=HEADS)
    doc = np.repeat(np.arange(len(blobs)), np.diff(offsets))
    rows = np.concatenate([words, *heads])
    doc = np.tile(doc, 1 + len(HEADS))[rows != 0]
    rows = (rows[rows != 0] % np.uint64(BUCKETS)).astype(np.int64)
    both, n = np.unique(doc * BUCKETS + rows, return_counts=True)
    doc, rows = both // BUCKETS, both % BUCKETS
    doc, rows = (np.concatenate(x) for x in zip(*((doc[n >= k], (rows[n >= k] * (2 * k - 1) + (k - 1) * 7919) % BUCKETS) for k in TIMES), strict=True))
    order = np.argsort(doc, kind="stable")
    return np.split(rows[order].astype(np.int32), np.searchsorted(doc[order], np.arange(1, len(blobs))))


FEATURES, SHARD_ROWS = 4096, 8192  # features with a weight at most; distinct feature sets that a task learns from


class PositiveUnlabelled:
    """A linear classifier over hashed words: weights of the used buckets, and a bias."""

    def __init__(self, used: np.ndarray, weights: np.ndarray, bias: float):
        self.weights, self.bias = np.zeros(BUCKETS, np.float32), float(bias)
        self.weights[used] = weights

    def __call__(self, sets: list[np.ndarray]) -> np.ndarray:
        flat = np.concatenate(sets) if sets else np.zeros(0, np.int32)
        owner = np.repeat(np.arange(len(sets)), [len(x) for x in sets])
        return _sigmoid(np.bincount(owner, self.weights[flat].astype(np.float64), len(sets)) + self.bias)


def used_features(a: np.ndarray, b: np.ndarray, na: float, nb: float, least: float = 5.0) -> np.ndarray:
    """The buckets, FEATURES at most, whose share a / na of the positive texts is furthest above their share b / nb of the
    unlabelled ones: by `least` standard errors or more."""
    if not na or not nb:
        return np.zeros(0, np.int64)
    share = (a + b + 1) / (na + nb + 2)
    above = (a / na - b / nb) / np.sqrt(share * (1 - share) * (1 / na + 1 / nb))
    return np.sort(np.argsort(-above, kind="stable")[: min(FEATURES, int((above > least).sum()))])


def nnpu(positive: list[np.ndarray], unlabelled: list[np.ndarray], times: np.ndarray, prior: float, w: np.ndarray, steps: int) -> np.ndarray:
    """Weights, and a bias as their last number, after some Adam steps from w on the non-negative positive-unlabelled risk.

    Risk: prior * E_p[loss(f, +)] + max(0, E_u[loss(f, -)] - prior * E_p[loss(f, -)]), logistic loss. Where the second
    part is negative, the step goes against its gradient, which undoes the overfit. The weights' penalty falls with the number of
    positives. times: how often each unlabelled set occurs."""
    w, n = w.astype(np.float64), len(w) - 1
    flat = [np.concatenate([np.zeros(0, np.int64), *x]).astype(np.int64) for x in (positive, unlabelled)]
    owner = [np.repeat(np.arange(len(x)), [len(i) for i in x]) for x in (positive, unlabelled)]
    share = times / times.sum()
    m, v = np.zeros(n + 1), np.zeros(n + 1)
    for t in range(1, steps + 1):
        fp, fu = (np.bincount(o, w[x], len(rows)) + w[n] for o, x, rows in zip(owner, flat, (positive, unlabelled), strict=True))
        rest = (share * np.logaddexp(0, fu)).sum() - prior * np.logaddexp(0, fp).mean()
        sign = 1 if rest >= 0 else -1
        gp = (-prior * _sigmoid(-fp) * (sign > 0) - sign * prior * _sigmoid(fp)) / len(positive)
        gu = sign * share * _sigmoid(fu)
        g = np.append(np.bincount(flat[0], gp[owner[0]], n) + np.bincount(flat[1], gu[owner[1]], n) + w[:n] / len(positive), gp.sum() + gu.sum())
        m, v = 0.9 * m + 0.1 * g, 0.999 * v + 0.001 * g * g
        w -= 0.03 * (m / (1 - 0.9**t)) / (np.sqrt(v / (1 - 0.999**t)) + 1e-8)
    return w


def _counted(texts: DataFrame) -> np.ndarray:
    """In how many texts each bucket's feature stands, and the number of texts."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(BUCKETS + 1)
        for _, blobs in text_slices(batches, "text"):
            total[:BUCKETS] += np.bincount(np.concatenate(word_buckets(blobs)), minlength=BUCKETS)
            total[BUCKETS] += len(blobs)
        yield from array_blocks(total)

    return summed(texts.select("text").mapInArrow(run, BLOCKS), BUCKETS + 1).astype(np.float64)


def _shard_learner(now, prior: float, steps: int) -> Callable[[pa.Table], pa.Table]:
    def learn(part: pa.Table) -> pa.Table:
        part = part.sort_by("x")
        sets, times = [np.frombuffer(x.as_buffer(), np.int16) for x in part.column("x")], part.column("n").to_numpy()
        out = nnpu(now.value[0], sets, times, prior, now.value[1], steps)
        return pa.Table.from_batches(array_blocks(np.append(out, 1.0) * times.sum()))

    return learn


def toxicity_model(docs: DataFrame, positive: DataFrame, unlabelled: DataFrame, prior: float, steps: tuple[int, ...] = (150, 60)) -> PositiveUnlabelled:
    """Learns from the texts of positive, a sample of bounded size, and of all rows of unlabelled.

    1. Features are counted over all texts, in arrays of fixed size, and FEATURES of them chosen.
    2. Every unlabelled text is cut down to its chosen features; equal sets are one row with a count.
    3. Those rows are dealt into shards by their hash, sets with many copies over all shards in equal parts. Each shard takes
       steps from the same weights, with all positives; the mean of the shards' weights, by texts, starts the next turn.

    What comes to the driver: two arrays of counts, the weights, and the positives' chosen features (2 bytes each, FEATURES
    a text at most). The result hangs on the texts alone and not on how they are partitioned."""
    spark, start = docs.sparkSession, float(np.log(max(prior, 1e-4) / max(1 - prior, 1e-4)))
    a, b = _counted(positive), _counted(unlabelled)
    used = used_features(a[:BUCKETS], b[:BUCKETS], a[BUCKETS], b[BUCKETS])
    if not len(used):
        return PositiveUnlabelled(used, np.zeros(0), start)
    column = np.full(BUCKETS, -1, np.int16)
    column[used] = np.arange(len(used))
    columns = spark.sparkContext.broadcast(column)

    def chosen(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for _, blobs in text_slices(batches, "text"):
            cut = [columns.value[x] for x in word_buckets(blobs)]
            yield pa.RecordBatch.from_arrays([pa.array([np.unique(c[c >= 0]).tobytes() for c in cut], pa.binary())], ["x"])

    known = [np.frombuffer(r["x"], np.int16) for r in positive.select("text").mapInArrow(chosen, "x binary").sort("x").collect()]
    table = as_table(unlabelled.select("text").mapInArrow(chosen, "x binary").groupBy("x").agg(F.count("*").alias("n")), "features")
    columns.destroy()
    shards = max(1, -(-table.count() // SHARD_ROWS))
    spread = F.col("n") >= shards
    places = F.when(spread, F.sequence(F.lit(0), F.lit(shards - 1))).otherwise(F.array(F.pmod(F.xxhash64("x"), F.lit(shards)).cast("int")))
    dealt = table.select("x", F.explode(places).alias("shard"), F.when(spread, F.col("n") / shards).otherwise(F.col("n")).cast("double").alias("n"))
    w = np.append(np.zeros(len(used)), start)
    for count in steps:
        now = spark.sparkContext.broadcast((known, w))
        total = summed(dealt.groupBy("shard").applyInArrow(_shard_learner(now, prior, count), BLOCKS), len(w) + 1).astype(np.float64)
        w = total[:-1] / total[-1]
        now.destroy()
    return PositiveUnlabelled(used, w[:-1], w[-1])


def toxicity_scores(docs: DataFrame, labels: DataFrame, unlabelled: DataFrame | None = None, label: str = "toxic", most: int = 4000, whole: bool = False, out: str = "score") -> DataFrame:
    """doc_id (with whole: all columns) and out, the score, for every row of docs (null text: empty).

    Positives: at most `most` texts with label 1, one for each id. Unlabelled: all rows of `unlabelled` (docs, if not given), whatever
    their labels. The class prior is label 1's share of the given labels. Without positives every score is the prior.
    Null ids, repeated ids and repeated rows are judged by their own texts; with whole, other columns pass through whatever
    their names, but none may be called out."""
    spark = docs.sparkSession
    known = labels.where(F.col("doc_id").isNotNull() & F.col(label).isin(0, 1)).groupBy("doc_id").agg(F.max(label).alias(label))
    n, ones = known.agg(F.count("*"), F.sum(label)).first()
    prior = float(ones or 0) / n if n else 0.1
    with scratch_tables(spark):
        positive = as_table(labelled_sample(docs, known.where(F.col(label) == 1), label, most), "positive")
        model = spark.sparkContext.broadcast(toxicity_model(docs, positive, docs if unlabelled is None else unlabelled, prior))
    return _score(docs, lambda blobs: model.value(word_buckets(blobs)), whole, out)
