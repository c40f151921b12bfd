"""A hashed maximum-entropy language model: class-factored softmax over n-gram and skip features."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import BLOCKS, array_blocks, as_table, mix64, scratch_path, scratch_tables, summed, task_number, text_slices, word_hashes

CLASSES, ITEMS, OWN_ITEMS = 32, 32, 24  # in each class so many items are a word of their own; the other words are leaves below the other items
HEAD, TOP, FORKS = CLASSES * OWN_ITEMS, CLASSES * ITEMS, ITEMS - OWN_ITEMS
END, START = np.uint64(0x2545F4914F6CDD1D), np.uint64(0x9E3779B97F4A7C15)
BLOCK_BYTES = 16 << 20  # text in a block
TASK_BLOCKS = 2  # that a learning task steps through at least, as each sends its changes of all rows that it touched
BATCH, RATE = 8192, 0.1

TOKENS = "block long, turn int, doc_ids array<long>, held array<boolean>, offsets binary, low binary, mid binary, high binary, top binary, vocab binary, counts binary"
PLANES = ("low", "mid", "high", "top")


def token_blocks(docs: DataFrame, rounds: int = 1) -> DataFrame:
    """Documents (doc_id, text, held) as rows of TOKENS: for some MB of text the distinct words' hashes, the words' counts in
    texts that aren't held out, and each text's words and one end as numbers in that list (four planes of bytes). turn: the round, dealt in order within a task."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        base, done = task_number() << 32, 0
        ids, held, parts, lengths, size = [], [], [], [], 0

        def flush() -> pa.RecordBatch:
            words = np.concatenate(parts)
            vocab, inverse = np.unique(words, return_inverse=True)
            order = np.argsort(-np.bincount(inverse, minlength=len(vocab)), kind="stable")
            place = np.empty(len(order), np.uint32)
            place[order] = np.arange(len(order), dtype=np.uint32)
            tokens, n = place[inverse], np.array(lengths)
            learn = np.repeat(~np.array(held, bool), n)
            counts = np.bincount(tokens[learn], minlength=len(vocab)).astype(np.int64)
            planes = tokens.astype("<u4").view(np.uint8).reshape(-1, 4)
            raw = [np.cumsum([0, *n]).astype(np.int64), *(planes[:, k] for k in range(4)), vocab[order], counts]
            return pa.RecordBatch.from_arrays([pa.array([base + done], pa.int64()), pa.array([((base >> 32) + done) % rounds], pa.int32()), pa.array([ids], pa.list_(pa.int64())), pa.array([held], pa.list_(pa.bool_())), *(pa.array([x.tobytes()], pa.binary()) for x in raw)], [f.split()[0] for f in TOKENS.split(", ")])

        for batch, blobs in text_slices(batches, "text"):
            h, offsets = word_hashes(blobs)
            parts.append(np.insert(h, offsets[1:], END))
            lengths += (np.diff(offsets) + 1).tolist()
            ids += batch.column("doc_id").to_pylist()
            held += batch.column("held").to_pylist()
            size += sum(map(len, blobs))
            if size >= BLOCK_BYTES:
                yield flush()
                done += 1
                ids, held, parts, lengths, size = [], [], [], [], 0
        if ids:
            yield flush()

    return docs.select("doc_id", "text", "held").mapInArrow(run, TOKENS)


def _tokens(block: dict) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    planes = [np.frombuffer(block[k], np.uint8) for k in PLANES]
    return np.stack(planes, 1).reshape(-1).view("<u4").astype(np.int64), np.frombuffer(block["offsets"], np.int64), np.frombuffer(block["vocab"], np.uint64)


def leaf_shape(n_words: int) -> tuple[int, int]:
    """Levels and width of the trees below the shared items, for a vocabulary's size: at least 85 * sqrt(V) leaves in all, in forks
    of 32 ways at most, so that a word's cost grows with the logarithm of the vocabulary."""
    bits = max(1, int(np.ceil(np.log2(max(1.0, np.sqrt(n_words) / 3)))))
    levels = -(-bits // 5)
    return levels, 1 << -(-bits // levels)


def slots_of(words: np.ndarray, head: np.ndarray, places: np.ndarray, leaves: int) -> np.ndarray:
    """Each word's slot: class * ITEMS + item for the words of head (sorted hashes; places: their slots), otherwise TOP + a leaf's number
    among the `leaves` of each shared item, class by class."""
    fork = (words >> np.uint64(20)) % np.uint64(CLASSES) * np.uint64(FORKS) + (words >> np.uint64(40)) % np.uint64(FORKS)
    slots = (np.uint64(TOP) + fork * np.uint64(leaves) + mix64(words ^ END) % np.uint64(leaves)).astype(np.int64)
    if len(head):
        at = np.minimum(np.searchsorted(head, words), len(head) - 1)
        mine = head[at] == words
        slots[mine] = places[at[mine]]
    return slots


def own_slots(words: list[int]) -> tuple[np.ndarray, np.ndarray]:
    """head and places for slots_of, of words from frequent to rare: dealt over the classes in turn."""
    head, rank = np.array(words, np.int64).view(np.uint64), np.arange(len(words))
    order = np.argsort(head)
    return head[order], (rank % CLASSES * ITEMS + rank // CLASSES)[order]


def before(words: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The word before each token and the one before that; before a text's first word stands a mark of its own."""
    out = []
    for last in (words, None):
        last = out[0] if last is None else last
        now = np.empty_like(words)
        now[1:] = last[:-1]
        now[offsets[:-1]] = START
        out.append(now)
    return out[0], out[1]


def _row(x: np.ndarray, seed: int, rows: int) -> np.ndarray:
    return (mix64(x + np.uint64(seed)) & np.uint64(rows - 1)).astype(np.int64)


def class_rows(one: np.ndarray, two: np.ndarray, rows: int) -> list[np.ndarray]:
    """Hashed rows of the class table: the word before; both words before; the word before last, a skip."""
    return [_row(one, 1, rows), _row(one * np.uint64(3) + two * np.uint64(0x94D049BB133111EB), 2, rows), _row(two, 3, rows)]


def node_rows(one: np.ndarray, two: np.ndarray, nodes: np.ndarray, seed: int, rows: int) -> list[np.ndarray]:
    """Hashed rows of a table below the classes: the node (a class or a fork) with the word before; with the word before last."""
    with_node = nodes.astype(np.uint64) * np.uint64(0xD6E8FEB86659FD93)
    return [_row(one ^ with_node, seed, rows), _row(two ^ with_node, seed + 1, rows)]


def _shifted(bias: np.ndarray, table: np.ndarray, rows: list[np.ndarray]) -> np.ndarray:
    """Bias and rows of the table added up, less each line's largest entry."""
    z = table.take(rows[0], axis=0)
    for row in rows[1:]:
        z += table.take(row, axis=0)
    z += bias
    most, half = z, z.shape[1]
    while half > 1:
        half //= 2
        most = np.maximum(most[:, :half], most[:, half:])
    z -= most
    return z


class MaxEnt:
    """log P(class) + log P(item | class) + log P(branch | fork) for each fork on the way to a leaf, each a softmax of a bias and the
    features' rows. flat: the weights of three tables, of classes, items and branches, of `rows` rows each."""

    def __init__(self, slot_counts: np.ndarray, rows: int, levels: int, width: int, flat: np.ndarray | None = None):
        shared = slot_counts[TOP:].reshape(CLASSES * FORKS, -1)
        n = slot_counts[:TOP].reshape(CLASSES, ITEMS) + 1.0
        n[:, OWN_ITEMS:] += shared.sum(1).reshape(CLASSES, FORKS)
        self.rows, self.levels, self.width, self.widths = rows, levels, width, (CLASSES, ITEMS, width)
        self.class_bias = np.log(n.sum(1) / n.sum()).astype(np.float32)
        self.item_bias = np.log(n / n.sum(1, keepdims=True)).astype(np.float32)
        self.leaf_bias = []
        for level in range(levels):
            m = shared.reshape(CLASSES * FORKS * width**level, width, -1).sum(2) + 1.0
            self.leaf_bias.append(np.log(m / m.sum(1, keepdims=True)).astype(np.float32))
        self.flat = np.zeros(rows * sum(self.widths), np.float32) if flat is None else flat
        self.tables = tables_of(self.flat, self.widths)

    def _steps(self, s: np.ndarray, one: np.ndarray, two: np.ndarray) -> Iterator[tuple[np.ndarray | slice, int, np.ndarray, list[np.ndarray], np.ndarray]]:
        """For each softmax on the way to the slots: which tokens pass it, the table's number, bias, the table's rows, and the way taken."""
        fork = (s - TOP) // self.width**self.levels
        tail = np.flatnonzero(s >= TOP)
        classes = np.where(s < TOP, s // ITEMS, fork // FORKS)
        yield slice(None), 0, self.class_bias, class_rows(one, two, self.rows), classes
        yield slice(None), 1, self.item_bias[classes], node_rows(one, two, classes, 4, self.rows), np.where(s < TOP, s % ITEMS, OWN_ITEMS + fork % FORKS)
        node, leaf, one, two = fork[tail], (s[tail] - TOP) % self.width**self.levels, one[tail], two[tail]
        for level in range(self.levels if len(tail) else 0):
            way = leaf // self.width ** (self.levels - 1 - level) % self.width
            yield tail, 2, self.leaf_bias[level][node], node_rows(one, two, node, 6 + 2 * level, self.rows), way
            node = node * self.width + way

    def log_probs(self, words: np.ndarray, slots: np.ndarray, offsets: np.ndarray) -> np.ndarray:
        one, two = before(words, offsets)
        out = np.zeros(len(slots))
        for low in range(0, len(slots), BATCH):
            at = slice(low, low + BATCH)
            for mine, t, bias, rows, way in self._steps(slots[at], one[at], two[at]):
                z = _shifted(bias, self.tables[t], rows)
                out[at][mine] += z[np.arange(len(z)), way] - np.log(np.exp(z) @ np.ones(z.shape[1], np.float32))
        return out

    def learn(self, words: np.ndarray, slots: np.ndarray, offsets: np.ndarray, state: np.ndarray, hits: np.ndarray) -> None:
        """One pass of minibatch gradient steps, each scaled by the rows' past gradients (state). hits: how often a row was stepped.
        Both have a line for each table."""
        one, two = before(words, offsets)
        for low in range(0, len(slots), BATCH):
            at = slice(low, low + BATCH)
            for _, t, bias, rows, way in self._steps(slots[at], one[at], two[at]):
                g = _shifted(bias, self.tables[t], rows)
                np.exp(g, out=g)
                g /= (g @ np.ones(g.shape[1], np.float32))[:, None]
                g[np.arange(len(g)), way] -= 1
                for row in rows:
                    _step(self.tables[t], state[t], hits[t], row, g)


def tables_of(flat: np.ndarray, widths: tuple[int, ...]) -> list[np.ndarray]:
    """Views of the tables that lie behind each other in flat, all of as many rows."""
    ends = np.cumsum([0, *widths]) * (len(flat) // sum(widths))
    return [flat[low:high].reshape(-1, w) for low, high, w in zip(ends, ends[1:], widths, strict=False)]


def _sums(gradient: np.ndarray, order: np.ndarray, firsts: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """Sums of the gradient's lines by run. Most runs are short: the second lines of all are added at once, then the third ones and so
    on, until few runs are left, and these are summed each by itself."""
    ordered = gradient.take(order, axis=0)
    total, k, live = ordered.take(firsts, axis=0), 1, np.flatnonzero(lengths > 1)
    while len(live) > 64:
        total[live] += ordered.take(firsts[live] + k, axis=0)
        k += 1
        live = live[lengths[live] > k]
    for i in live:
        total[i] += ordered[firsts[i] + k : firsts[i] + lengths[i]].sum(0)
    return total


def _step(table: np.ndarray, state: np.ndarray, hits: np.ndarray, rows: np.ndarray, gradient: np.ndarray) -> None:
    order = np.argsort(rows.astype(np.uint16) if len(table) <= 1 << 16 else rows, kind="stable")
    ordered = rows[order]
    firsts = np.flatnonzero(np.diff(ordered, prepend=-1))
    own, lengths = ordered[firsts], np.diff(np.append(firsts, len(ordered)))
    total = _sums(gradient, order, firsts, lengths)
    state[own] += np.einsum("ij,ij->i", total, total) / total.shape[1]
    hits[own] += lengths
    total *= (RATE / np.sqrt(state[own] + 1e-3))[:, None]
    table[own] = table.take(own, axis=0) - total


def language_scores(docs: DataFrame, held_out: str = "pmod(crc32(coalesce(cast(doc_id as string), '')), 7) = 2", rounds: int = 2, density: int = 24) -> DataFrame:
    """doc_id, held_out, n_tokens, n_known, train_tokens, base_score and score for every row, learnt from the rows that
    aren't held out.

    Tokens: lower-case words and one end a text (null or empty: the end alone). Words are counted exactly, by 64-bit hash,
    over all training text; base_score adds up log10((c + 1) / (N + V + 1)).

    score is log10 of the model's probability: the class by maximum entropy over the words before, then the item in the class
    likewise. The HEAD most frequent words are items of their own; the others are dealt by hash over the leaves of trees below the
    other items, each fork of which is a softmax of the words before as well. There are 85 * sqrt(V) leaves or more; words of one leaf
    have its probability times (c + 1) / (N_leaf + V_leaf + 1). Features are hashed from whole words. The tables have density * sqrt(V)
    rows, up to a power of 2. So the model grows with the vocabulary, inputs and outputs, without a bound.

    In each round tasks take gradient steps from the same weights over their share of the blocks, each block in one round; a
    row's update is the mean of the tasks' changes, weighted by how often each had the row. Which texts a task has hangs on how the
    table is partitioned, so scores of the model (not base_score) may differ by a little between layouts.

    The vocabulary is shuffled, never collected: it is summed within tasks first, so that a frequent word has one row a task. What
    comes to the driver is the weights, HEAD words, and two counts for each leaf. Repeated and null ids keep their rows, other
    columns are ignored, texts may be of any length, and an empty table gives an empty one."""
    with scratch_tables(docs.sparkSession):
        return as_table(_scores(docs, held_out, rounds, density), "scores", keep=True)


CHANGES = "part int, salt int, hits binary, change binary"  # of PART rows of one table: hits float32 for each; changes, of rows with hits only
PART = 1024


def _changes(old: list[np.ndarray], new: list[np.ndarray], hits: np.ndarray, salts: int) -> Iterator[pa.RecordBatch]:
    """Each touched row's change, in half precision, as rows of CHANGES."""
    parts, salt = -(-hits.shape[1] // PART), task_number() % salts
    for t, (before_, after) in enumerate(zip(old, new, strict=True)):
        for k in range(parts):
            at = slice(k * PART, (k + 1) * PART)
            if (had := hits[t, at] > 0).any():
                change = (after[at][had] - before_[at][had]).astype(np.float16)
                yield pa.RecordBatch.from_arrays([pa.array([t * parts + k], pa.int32()), pa.array([salt], pa.int32()), pa.array([hits[t, at].astype(np.float32).tobytes()], pa.binary()), pa.array([change.tobytes()], pa.binary())], ["part", "salt", "hits", "change"])


def _mean_changes(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Means of the changes by part, weighted by hits, with the sums of hits. Holds one sum for each part that is dealt to the task."""
    sums: dict[int, list[np.ndarray]] = {}
    for batch in batches:
        for part, hits, change in zip(batch.column("part").to_pylist(), batch.column("hits"), batch.column("change"), strict=True):
            hits = np.frombuffer(hits.as_buffer(), np.float32)
            had = np.flatnonzero(hits)
            change = np.frombuffer(change.as_buffer(), np.float16).reshape(len(had), -1).astype(np.float32)
            if part not in sums:
                sums[part] = [np.zeros(len(hits), np.float32), np.zeros((len(hits), change.shape[1]), np.float32)]
            sums[part][0] += hits
            sums[part][1][had] += change * hits[had, None]
    for part, (hits, change) in sums.items():
        had = hits > 0
        mean = (change[had] / hits[had, None]).astype(np.float16)
        yield pa.RecordBatch.from_arrays([pa.array([part], pa.int32()), pa.array([0], pa.int32()), pa.array([hits.tobytes()], pa.binary()), pa.array([mean.tobytes()], pa.binary())], ["part", "salt", "hits", "change"])


def _moved(weights: np.ndarray, widths: tuple[int, ...], changes: DataFrame, salts: int) -> np.ndarray:
    """The weights after the tasks' mean changes. Many tasks are summed by salt first, so that no task reads the changes of all."""
    tasks = max(2, min(64, int(changes.sparkSession.conf.get("spark.sql.shuffle.partitions"))))
    if salts > 1:
        changes = changes.repartition(max(tasks, salts), "part", "salt").mapInArrow(_mean_changes, CHANGES)
    out = weights.copy()
    tables = tables_of(out, widths)
    parts = -(-len(tables[0]) // PART)
    for r in changes.repartition(tasks, "part").mapInArrow(_mean_changes, CHANGES).toLocalIterator():
        had = r["part"] % parts * PART + np.flatnonzero(np.frombuffer(r["hits"], np.float32))
        tables[r["part"] // parts][had] += np.frombuffer(r["change"], np.float16).reshape(len(had), -1).astype(np.float32)
    return out


def _learner(now, rows: int, shape: tuple[int, int], salts: int):
    def learn(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = None
        for batch in batches:
            for block in batch.to_pylist():
                n_slot, head, places, weights = now.value
                if model is None:
                    model, state, hits = MaxEnt(n_slot, rows, *shape, weights.copy()), np.zeros((3, rows), np.float32), np.zeros((3, rows))
                tokens, offsets, vocab = _tokens(block)
                keep, n_each = ~np.array(block["held"], bool), np.diff(offsets)
                if keep.any():
                    tokens = tokens[np.repeat(keep, n_each)]
                    slots = slots_of(vocab, head, places, shape[1] ** shape[0])
                    model.learn(vocab[tokens], slots[tokens], np.cumsum([0, *n_each[keep]]), state, hits)
        if model is not None:
            yield from _changes(tables_of(now.value[3], model.widths), model.tables, hits, salts)

    return learn


def _scores(docs: DataFrame, held_out: str, rounds: int, density: int) -> DataFrame:
    spark = docs.sparkSession
    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text", F.expr(held_out).alias("held"))
    path = scratch_path(spark, "tokens")
    # a row group for each block, so that a round's scan skips the others by their least and greatest turn
    token_blocks(texts, rounds).write.option("compression", "zstd").option("parquet.block.row.count.limit", "1").parquet(path)
    blocks = spark.read.schema(TOKENS).parquet(path)

    def words(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for block, vocab, counts in zip(batch.column("block").to_pylist(), batch.column("vocab").to_pylist(), batch.column("counts").to_pylist(), strict=True):
                vocab, counts = np.frombuffer(vocab, np.int64), np.frombuffer(counts, np.int64)
                yield pa.RecordBatch.from_arrays([pa.array(np.full(len(vocab), block)), pa.array(np.arange(len(vocab), dtype=np.int32)), pa.array(vocab), pa.array(counts)], ["block", "at", "word", "n"])

    listed = blocks.select("block", "vocab", "counts").mapInArrow(words, "block long, at int, word long, n long")
    counted = as_table(listed.where("n > 0").groupBy("word").agg(F.sum("n").alias("c")), "counted")
    totals = counted.agg(F.coalesce(F.sum("c"), F.lit(0)).alias("n"), F.count("*").alias("v")).first()
    n_all, v_all = totals["n"], totals["v"]
    head, places = own_slots([r["word"] for r in counted.orderBy(F.col("c").desc(), "word").limit(HEAD).collect()])
    levels, width = shape = leaf_shape(v_all)
    leaves = width**levels
    n_slots = TOP + CLASSES * FORKS * leaves

    def slotted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums = np.zeros((2, n_slots))
        for batch in batches:
            at = slots_of(batch.column("word").to_numpy().view(np.uint64), head, places, leaves)
            sums += np.bincount(at, batch.column("c").to_numpy(), n_slots), np.bincount(at, minlength=n_slots)
        yield from array_blocks(sums)

    n_slot, v_slot = summed(counted.mapInArrow(slotted, BLOCKS), 2 * n_slots).reshape(2, -1)
    rows = 1 << max(8, int(np.ceil(np.log2(density * np.sqrt(max(1, v_all))))))

    model, n_blocks = MaxEnt(n_slot, rows, levels, width), blocks.count()
    weights, widths = model.flat, model.widths
    tasks = max(1, -(-n_blocks // (rounds * TASK_BLOCKS)))
    salts = 1 if tasks <= 64 else int(np.sqrt(tasks))
    for turn in range(rounds):
        now = spark.sparkContext.broadcast((n_slot, head, places, weights))
        mine = blocks.where(F.col("turn") == turn).coalesce(tasks)
        changes = mine.select("block", "held", "offsets", *PLANES, "vocab").mapInArrow(_learner(now, rows, shape, salts), CHANGES)
        weights = _moved(weights, widths, changes, salts)
        now.destroy()
    final = spark.sparkContext.broadcast((n_slot, v_slot, head, places, weights))
    out = "doc_id long, held_out boolean, n_tokens long, n_known long, train_tokens long, base_score double, score double"

    def score(left: pa.Table, right: pa.Table) -> pa.Table:
        n_s, v_s, own, at, w = final.value
        model = MaxEnt(n_s, rows, levels, width, w)
        block = left.to_pylist()[0]
        tokens, offsets, vocab = _tokens(block)
        c = np.zeros(len(vocab))
        c[right.column("at").to_numpy()] = right.column("c").to_numpy()
        s = slots_of(vocab, own, at, leaves)
        within = np.where(s < TOP, 0.0, np.log10((c + 1) / (n_s[s].astype(np.float64) + v_s[s] + 1)))
        base = np.log10((c + 1) / (n_all + v_all + 1))
        full = model.log_probs(vocab[tokens], s[tokens], offsets) / np.log(10) + within[tokens]
        firsts = offsets[:-1]
        sums = [np.add.reduceat(x, firsts) for x in ((c > 0)[tokens].astype(np.int64), base[tokens], full)]
        return pa.table([pa.array(block["doc_ids"], pa.int64()), pa.array(block["held"], pa.bool_()), pa.array(np.diff(offsets)), pa.array(sums[0]), pa.array(np.full(len(firsts), n_all)), pa.array(sums[1]), pa.array(sums[2])], names=[f.split()[0] for f in out.split(", ")])

    known = listed.select("block", "at", "word").join(counted, "word").select("block", "at", "c")
    parts = max(int(spark.conf.get("spark.sql.shuffle.partitions")), -(-n_blocks // 4))  # a few blocks a task, however many there are
    sides = blocks.drop("counts", "turn").repartition(parts, "block"), known.repartition(parts, "block")
    return sides[0].groupBy("block").cogroup(sides[1].groupBy("block")).applyInArrow(score, out)


def held_out_rows(remainder: int, modulus: int) -> str:
    return f"pmod(crc32(coalesce(cast(doc_id as string), '')), {modulus}) = {remainder}"


__all__ = ["held_out_rows", "language_scores", "token_blocks"]
