"""Repair of conversations' structure: the cheapest edits to a legal order of roles, by a dynamic programme with checkpoints."""

from __future__ import annotations

import hashlib
import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import as_table, task_number

BLOCK_ROWS, BLOCK_BYTES = 1024, 1 << 22
WHITE = " \t\n\x0b\x0c\r"
FAR = 1 << 40  # a cost that no edits have
#: What the rows kept so far end with: nothing, a system row, a user row, an assistant row.
EMPTY, SYSTEM, USER, ASSISTANT = range(4)
INITIALS = "sua"
#: The state after a user or assistant row is put where it may stand, and after a row of each initial (or another) is kept; -1 where it mayn't be.
NEXT = np.array([USER, USER, ASSISTANT, USER])
KEPT = np.array([[SYSTEM, USER, -1, -1], [-1, USER, -1, -1], [-1, -1, ASSISTANT, -1], [-1, USER, -1, -1]])
#: The cost of what has to follow for a legal end: after a system row a user and an assistant, after a user row an assistant.
END = np.array([0, 4, 2, 0], np.int64)
PLACED = {USER: "user", ASSISTANT: "assistant"}

_ROWS = "conv_id, turn, role, text, copies, initial, blank, truncated, repeated"
_SUMMARY = "n long, first_turn long, last_turn long, turns long, blank long, duplicate long, truncated long, illegal long, first_initial int, last_initial int, costs binary"
_PAYLOAD = "roles array<string>, texts array<string>, initials binary, must binary, cut binary, copies binary"


def _spaced(name: str) -> Column:
    return F.coalesce(F.col(name).cast("string"), F.lit(" "))


def damaged(rows: DataFrame) -> DataFrame:
    """(conv_id, turn, role, text) as a feed that loses and garbles rows might give them: by crc32 of conv_id:turn, modulo 20, a row is dropped (0),
    emptied (1), stripped of its .!? (2), repeated (3), or given to the user (4). Nulls are one space."""
    kind = F.crc32(F.concat_ws(":", _spaced("conv_id"), _spaced("turn"))) % 20
    some = rows.select(F.col("conv_id").cast("long").alias("conv_id"), F.col("turn").cast("long").alias("turn"), _spaced("role").alias("role"), _spaced("text").alias("text"), kind.alias("kind")).where("kind <> 0")
    text = F.when(F.col("kind") == 1, "").when(F.col("kind") == 2, F.regexp_replace("text", "[.!?]", "")).otherwise(F.col("text"))
    copies = F.explode(F.when(F.col("kind") == 3, F.array(F.lit(0), F.lit(1))).otherwise(F.array(F.lit(0)))).alias("copy")
    return some.select("conv_id", "turn", F.when(F.col("kind") == 4, "user").otherwise(F.col("role")).alias("role"), text.alias("text"), copies).drop("copy")


def marked(rows: DataFrame) -> DataFrame:
    """Rows with their faults. Equal rows (conversation, turn, role and text) are one with a number of copies, counted before they meet, so that a row
    repeated without end is one row; repeated says that the conversation has role and text at an earlier turn."""
    text = F.col("text")
    same = rows.select("conv_id", "turn", _spaced("role").alias("role"), _spaced("text").alias("text")).withColumn("digest", F.sha2(text, 256))
    once = same.groupBy("conv_id", "turn", "role", "digest").agg(F.count("*").alias("copies"), F.first("text").alias("text"))
    order = F.struct(F.col("turn").isNotNull().alias("known"), F.col("turn").alias("turn"))
    again = same.groupBy("conv_id", "role", "digest").agg(F.min(order).alias("earliest"), F.max(order).alias("latest")).where("earliest <> latest")
    again = again.select(F.col("conv_id").alias("_conv"), F.col("role").alias("_role"), F.col("digest").alias("_digest"), "earliest")
    both = once.join(again, F.col("conv_id").eqNullSafe(F.col("_conv")) & (F.col("role") == F.col("_role")) & (F.col("digest") == F.col("_digest")), "left")
    trimmed = F.rtrim(text, F.lit(WHITE))
    initial = F.coalesce(F.nullif(F.instr(F.lit(INITIALS), F.substring("role", 1, 1)), F.lit(0)), F.lit(4)) - 1
    return both.select(
        "conv_id", "turn", "role", "text", "digest", "copies",
        F.when(F.col("role") == "", 3).otherwise(initial).cast("int").alias("initial"), (trimmed == "").alias("blank"), (~F.substring(trimmed, -1, 1).isin(".", "!", "?")).alias("truncated"),
        F.coalesce(order > F.col("earliest"), F.lit(False)).alias("repeated"),
    )


def back(after: np.ndarray, initial: np.ndarray, must: np.ndarray, cut: np.ndarray, extra: np.ndarray) -> np.ndarray:
    """State costs before a row, of many conversations at once, from those after it: (n, ..., 4). A row is deleted (3, and must be if blank or
    repeated), kept (0) or given the role that may stand there (2), with 1 for a truncated row that stays; its further copies are deleted.
    Before it rows may be inserted (2); a third one would bring back a state of the first."""
    wide = (slice(None), *[None] * (after.ndim - 1))
    rest = 3 * extra[wide]
    best = rest + 3 + after
    stay = np.where(must[wide], FAR, rest + cut[wide])
    kept = KEPT[:, initial].T
    at = np.broadcast_to(np.maximum(kept, 0)[(slice(None), *[None] * (after.ndim - 2))], after.shape)
    keep = np.where((kept >= 0)[(slice(None), *[None] * (after.ndim - 2))], np.take_along_axis(after, at, -1), FAR)
    best = np.minimum(best, stay + np.minimum(keep, 2 + after[..., NEXT]))
    return np.minimum(np.minimum(best, 2 + best[..., NEXT]), np.minimum(4 + best[..., NEXT[NEXT]], FAR))


def grouped(lengths: list[int], most: int = 1 << 17) -> list[np.ndarray]:
    """Numbers of blocks, by falling length, in groups that take `most` places when padded to their longest."""
    order, out = np.argsort(-np.array(lengths, np.int64), kind="stable"), []
    while len(order):
        take = max(1, most // max(1, lengths[order[0]]))
        out.append(order[:take])
        order = order[take:]
    return out


class Padded:
    """Blocks of rows of several lengths, side by side, the longest first: row i of all blocks that have one is a prefix."""

    def __init__(self, blocks: list[tuple[np.ndarray, ...]]):
        self.lengths = np.array([len(b[0]) for b in blocks], np.int64)
        self.order = np.argsort(-self.lengths, kind="stable")
        self.longest = int(self.lengths.max()) if len(blocks) else 0
        self.active = np.array([int((self.lengths > i).sum()) for i in range(self.longest)], np.int64)
        self.columns = [np.zeros((self.longest, len(blocks)), np.int64) for _ in range(4)]
        for j, k in enumerate(self.order):
            for column, values in zip(self.columns, blocks[k], strict=True):
                column[: len(values), j] = values

    def row(self, i: int) -> tuple[int, list[np.ndarray]]:
        m = self.active[i]
        initial, must, cut, extra = (c[i, :m] for c in self.columns)
        return m, [initial, must.astype(bool), cut, extra]

    def backward(self, after: np.ndarray, low: int, high: int, keep: bool = False) -> np.ndarray:
        """State costs before row low from those before row high; with keep those before every row from low to high."""
        now, all_ = after.copy(), [after]
        for i in range(high - 1, low - 1, -1):
            m, row = self.row(i)
            now = now.copy() if keep else now
            now[:m] = back(now[:m], *row)
            all_.append(now)
        return np.stack(all_[::-1]) if keep else now

    def costs_between(self) -> np.ndarray:
        """For each block the least cost from each state before it (last axis) to each state after it."""
        after = np.broadcast_to(np.where(np.eye(4, dtype=bool), 0, FAR), (len(self.order), 4, 4)).astype(np.int64)
        out = np.empty_like(after)
        out[self.order] = self.backward(after, 0, self.longest)
        return out

    def walk(self, after: np.ndarray, which: np.ndarray, state: np.ndarray) -> tuple[list[bytes], np.ndarray]:
        """For walks through blocks `which` from states before them: the least of the cheapest edits' initials, and the states after. after: each
        block's state costs at its end.

        State costs are kept at every root of the longest block's length; the blocks between are worked out again, one after another, while
        the walk goes forward."""
        step = max(1, math.isqrt(max(0, self.longest - 1)) + 1)
        marks = [after[self.order].astype(np.int64)]
        ends = [self.longest]
        for low in range((self.longest - 1) // step * step, -1, -step):
            marks.append(self.backward(marks[-1], low, ends[-1]))
            ends.append(low)
        rank = np.empty_like(self.order)
        rank[self.order] = np.arange(len(self.order))
        at, state = rank[which], state.copy()
        said, times = np.zeros((len(at), self.longest, 4), np.uint8), np.zeros((len(at), self.longest, 4), np.int64)
        for k in range(len(ends) - 1, 0, -1):
            low, high = ends[k], ends[k - 1]
            costs = self.backward(marks[k - 1], low, high, True)
            for i in range(low, high):
                m, (initial, must, cut, extra) = self.row(i)
                live = np.flatnonzero(at < m)
                said[live, i, 3], times[live, i, 3] = ord("D"), extra[at[live]]
                for slot in range(3):
                    b, s = at[live], state[live]
                    rest, kept, now, then = 3 * extra[b], KEPT[s, initial[b]], costs[i - low, b], costs[i - low + 1, b]
                    want = np.take_along_axis(now, s[:, None], 1)[:, 0]
                    reach = lambda c, t: np.take_along_axis(c, np.maximum(t, 0)[:, None], 1)[:, 0]  # noqa: E731, B023
                    delete = want == 3 + rest + reach(then, s)
                    insert = ~delete & (want == 2 + reach(now, NEXT[s]))
                    keep = ~delete & ~insert & ~must[b] & (kept >= 0) & (want == cut[b] + rest + reach(then, kept))
                    said[live, i, slot] = np.where(delete, ord("D"), np.where(insert, ord("I"), np.where(keep, ord("K"), ord("R"))))
                    times[live, i, slot] = 1
                    state[live] = np.where(delete, s, np.where(keep, kept, NEXT[s]))
                    live = live[insert]
                    if not len(live):
                        break
        return [np.repeat(a.ravel(), t.ravel()).tobytes() for a, t in zip(said, times, strict=True)], state


def _edges(batch: pa.RecordBatch) -> np.ndarray:
    """Where blocks begin: at another conversation, and so that a block has BLOCK_ROWS rows and about BLOCK_BYTES of text at most."""
    conv, n = batch.column("conv_id"), batch.num_rows
    ids, null = conv.fill_null(0).to_numpy(), conv.is_null().to_numpy(zero_copy_only=False)
    new = np.ones(n, bool)
    new[1:] = (ids[1:] != ids[:-1]) | (null[1:] != null[:-1])
    start = np.maximum.accumulate(np.where(new, np.arange(n), 0))
    size = np.cumsum([len(x) for x in batch.column("text").cast(pa.binary()).to_pylist()])
    new |= (np.arange(n) - start) % BLOCK_ROWS == 0
    new[1:] |= (size[1:] - size[start[1:]]) // BLOCK_BYTES != (size[:-1] - size[start[:-1]]) // BLOCK_BYTES
    return np.append(np.flatnonzero(new), n)


def blocks_of(rows: DataFrame) -> DataFrame:
    """Marked rows as blocks in the order of their turns: a table of (conv_id, block), a summary of each block with its costs between states, and its rows.

    Rows are dealt by ranges of conversation and turn, so a conversation of any length is many blocks in many tasks. A block's number grows with its place."""
    keys = ["conv_id", "turn", "role", "digest"]
    dealt = rows.repartitionByRange(*keys).sortWithinPartitions(*keys)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        number = task_number() << 33
        for batch in batches:
            if not batch.num_rows:
                continue
            edges = _edges(batch)
            lows, sizes = edges[:-1], np.diff(edges)
            get = lambda c: batch.column(c).to_numpy(zero_copy_only=False)  # noqa: E731, B023
            initial, copies, blank, cut, again = get("initial").astype(np.int64), get("copies").astype(np.int64), get("blank"), get("truncated"), get("repeated")
            must, extra = blank | again, copies - 1
            cut = cut & ~must
            parts = [np.split(x, edges[1:-1]) for x in (initial, must.astype(np.int64), cut.astype(np.int64), extra)]
            blocks, costs = list(zip(*parts, strict=True)), np.empty((len(lows), 4, 4), np.int64)
            for some in grouped([len(b[0]) for b in blocks]):
                costs[some] = Padded([blocks[j] for j in some]).costs_between()
            add = lambda x: np.add.reduceat(x, lows)  # noqa: E731, B023
            turn = batch.column("turn")
            known, turns = ~turn.is_null().to_numpy(zero_copy_only=False), turn.fill_null(0).to_numpy()
            inside = np.ones(batch.num_rows, bool)
            inside[lows] = False
            other = known.copy()
            other[1:] &= ~(inside[1:] & known[:-1] & (turns[1:] == turns[:-1]))
            wrong = np.zeros(batch.num_rows, np.int64)
            wrong[1:] = inside[1:] & ~np.isin(initial[:-1] * 4 + initial[1:], (0 * 4 + 1, 1 * 4 + 2, 2 * 4 + 1))
            has = add(known.astype(np.int64)) > 0
            first = np.minimum.reduceat(np.where(known, turns, np.iinfo(np.int64).max), lows)
            last = np.maximum.reduceat(np.where(known, turns, np.iinfo(np.int64).min), lows)
            lists = lambda c: pa.ListArray.from_arrays(pa.array(edges, pa.int32()), batch.column(c))  # noqa: E731, B023
            raw = lambda x, kind: pa.array([p.astype(kind).tobytes() for p in x], pa.binary())
            columns = [
                batch.column("conv_id").take(pa.array(lows)), pa.array(number + np.arange(len(lows))), pa.array(add(copies)), pa.array(first, mask=~has), pa.array(last, mask=~has), pa.array(add(other.astype(np.int64))),
                pa.array(add(np.where(blank, copies, 0))), pa.array(add(np.where(blank, 0, np.where(again, copies, extra)))), pa.array(add(cut.astype(np.int64))), pa.array(add(wrong + extra)),
                pa.array(initial[lows].astype(np.int32)), pa.array(initial[lows + sizes - 1].astype(np.int32)), pa.array([c.tobytes() for c in costs], pa.binary()),
                lists("role"), lists("text"), raw(parts[0], "u1"), raw(parts[1], "u1"), raw(parts[2], "u1"), raw(parts[3], "<i8"),
            ]
            number += len(lows)
            yield pa.RecordBatch.from_arrays(columns, [c.split()[0] for c in f"conv_id long, block long, {_SUMMARY}, {_PAYLOAD.replace('copies', 'extra')}".split(", ")])

    names = [c.strip() for c in _ROWS.split(",")]
    return dealt.select(*names).mapInArrow(run, f"conv_id long, block long, {_SUMMARY}, {_PAYLOAD.replace('copies', 'extra')}")


class _Conversation:
    """What the walk carries of a conversation: summaries of its blocks, then the state costs at their ends."""

    def __init__(self, conv_id: int | None):
        self.conv_id, self.blocks, self.at, self.state, self.said, self.ends = conv_id, [], 0, EMPTY, 0, None

    def checkpoints(self) -> list[np.ndarray]:
        """State costs at the ends of the blocks, from the last block's to the first's."""
        if self.ends is None:
            self.ends = [END]
            for b in reversed(self.blocks):
                costs = np.frombuffer(b["costs"], np.int64).reshape(4, 4)
                self.ends.append((costs + self.ends[-1][:, None]).min(0))
            self.ends = self.ends[::-1]
        return self.ends

    def totals(self) -> dict:
        """Counts over the whole conversation; blocks' ends are compared where they meet."""
        out = {k: sum(b[k] for b in self.blocks) for k in ("blank", "duplicate", "truncated", "illegal", "turns")}
        some = [b for b in self.blocks if b["first_turn"] is not None]
        out["turns"] -= sum(a["last_turn"] == b["first_turn"] for a, b in zip(some, some[1:], strict=False))
        out["illegal"] += sum(a["last_initial"] * 4 + b["first_initial"] not in (1, 6, 9) for a, b in zip(self.blocks, self.blocks[1:], strict=False))
        out["gaps"] = some[-1]["last_turn"] - some[0]["first_turn"] + 1 - out.pop("turns") if some else out.pop("turns")
        return out | {"cost": int(self.checkpoints()[0][EMPTY])}


_OUT = "conv_id long, block long, last boolean, audit string, roles array<string>, texts array<string>, gaps long, blank long, duplicate long, truncated long, illegal long, cost long"
_COUNTS = ("gaps", "blank", "duplicate", "truncated", "illegal", "cost")


def _applied(audit: bytes, state: int, roles: list[str], texts: list[str], extra: np.ndarray) -> tuple[list[str], list[str]]:
    """The rows that a block's edits leave."""
    out, says, i, more = [], [], 0, 0
    for edit in audit.decode():
        if edit == "I":
            state = NEXT[state]
            out.append(PLACED[state])
            says.append("")
            continue
        if more:
            more -= 1
        else:
            if edit == "K":
                state = KEPT[state, (INITIALS + roles[i][0]).index(roles[i][0])]
                out.append(roles[i])
                says.append(texts[i])
            elif edit == "R":
                state = NEXT[state]
                out.append(PLACED[state])
                says.append(texts[i])
            more = int(extra[i])
            i += 1
    return out, says


def _walked(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Of each conversation first the summaries of all its blocks come, then the blocks."""
    now: _Conversation | None = None
    for batch in batches:
        todo: list[tuple[_Conversation, int, dict]] = []
        for row in batch.to_pylist():
            if now is None or (row["roles"] is None and now.at) or row["conv_id"] != now.conv_id:
                now = _Conversation(row["conv_id"])
            if row["roles"] is None:
                now.blocks.append(row)
            else:
                todo.append((now, now.at, row))
                now.at += 1
        if not todo:
            continue
        parts = [[np.frombuffer(r[c], kind).astype(np.int64) for c, kind in (("initials", "u1"), ("must", "u1"), ("cut", "u1"), ("extra", "<i8"))] for _, _, r in todo]
        ways: list[dict[int, tuple[bytes, int]]] = [{} for _ in todo]  # from each state that a block may begin with
        for some in grouped([len(p[0]) for p in parts]):
            starts = [range(4) if todo[j][1] else [EMPTY] for j in some]
            which, state = np.repeat(np.arange(len(some)), [len(x) for x in starts]), np.array([s for x in starts for s in x])
            edits, ends = Padded([parts[j] for j in some]).walk(np.stack([todo[j][0].checkpoints()[todo[j][1] + 1] for j in some]), which, state)
            for w, s, edit, end in zip(which.tolist(), state.tolist(), edits, ends.tolist(), strict=True):
                ways[some[w]][s] = edit, end
        out = []
        for j, (conv, k, row) in enumerate(todo):
            before, last = conv.state, k + 1 == len(conv.blocks)
            audit, conv.state = ways[j][before]
            if last:
                audit += b"I" * (int(END[conv.state]) // 2)
            roles, texts = _applied(audit, before, row["roles"], row["texts"], parts[j][3])
            totals = conv.totals() if last else dict.fromkeys(_COUNTS)
            out.append({"conv_id": conv.conv_id, "block": k, "last": last, "audit": audit.decode(), "roles": roles, "texts": texts} | totals)
        columns = [c.split() for c in _OUT.split(", ")]
        kinds = {"long": pa.int64(), "boolean": pa.bool_(), "string": pa.string(), "array<string>": pa.list_(pa.string())}
        yield pa.RecordBatch.from_arrays([pa.array([r[name] for r in out], kinds[kind]) for name, kind in columns], [name for name, _ in columns])


def repaired(rows: DataFrame) -> DataFrame:
    """(conv_id, block, last, audit, roles, texts, and in a conversation's last block gaps, blank, duplicate, truncated, illegal, cost): the rows that the
    cheapest edits of each conversation leave, block after block in one task's order, and the edits' initials.

    Rows are taken by turn (nulls first), then role, then the text's SHA-256; copies stand side by side. A row's first fault counts: blank, duplicate (role and
    text seen before), truncated. Edits: Keep 0, Rerole to user or assistant 2, Delete 3 (blank and duplicate rows must go), Insert an empty row of
    user or assistant 2; a truncated row that stays costs 1. What stays has the initials (s?(ua)+)?, and of equally cheap edits the least in ASCII are taken.

    1. Equal rows become one with a count, rows are cut into blocks of BLOCK_ROWS at most, and each block is summed up by its least costs
       between the four states; both in parallel, also within a conversation, and written.
    2. Blocks meet by conversation, their summaries first: from the end, state costs are worked out for the blocks' ends alone, the checkpoints.
       Then each block is walked forward, in whose walk state costs are kept at every root of its length and worked out again between.

    So a task holds a block and 150 bytes for each other block of one conversation. Null roles and texts are one space, and a null conv_id is a conversation.
    Other columns are not read. An empty table gives an empty one; a conversation without rows has no row here."""
    table = as_table(blocks_of(marked(rows)), "blocks", keep=True)
    payload = [c.split()[0] for c in _PAYLOAD.replace("copies", "extra").split(", ")]
    summaries = table.withColumns({c: F.lit(None).cast(table.schema[c].dataType) for c in payload})
    summary = [c.split()[0] for c in _SUMMARY.split(", ")]
    bodies = table.withColumns({c: F.lit(None).cast(table.schema[c].dataType) for c in summary})
    both = summaries.withColumn("kind", F.lit(0)).unionByName(bodies.withColumn("kind", F.lit(1)))
    return both.repartition("conv_id").sortWithinPartitions("conv_id", "kind", "block").drop("kind").mapInArrow(_walked, _OUT)


def _hashed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    digest, audit, empty = hashlib.sha256(), [], True
    for batch in batches:
        out = []
        for r in batch.to_pylist():
            for role, text in zip(r["roles"], r["texts"], strict=True):
                digest.update(f"{'' if empty else chr(10)}{role}:{text}".encode())
                empty = False
            audit.append(r["audit"])
            if r["last"]:
                out.append([r["conv_id"], *(r[c] for c in _COUNTS), "".join(audit), digest.hexdigest()])
                digest, audit, empty = hashlib.sha256(), [], True
        if out:
            kinds = [pa.int64()] * 7 + [pa.string()] * 2
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*out, strict=True), kinds, strict=True)], ["conv_id", *_COUNTS, "audit", "repaired_sha256"])


def audits(rows: DataFrame, every: DataFrame | None = None) -> DataFrame:
    """(conv_id, gaps, blank, duplicate, truncated, illegal, cost, audit, repaired_sha256), a row for each conversation of rows, and of `every`
    (conv_id), if given: one without rows has zeros, an empty audit and the hash of nothing. The hash is that of the repaired rows, role:text, a line each."""
    done = repaired(rows).mapInArrow(_hashed, "conv_id long, gaps long, blank long, duplicate long, truncated long, illegal long, cost long, audit string, repaired_sha256 string")
    if every is None:
        return done
    ids = every.select(F.col("conv_id").cast("long").alias("_id")).distinct()
    both = ids.join(done, F.col("_id").eqNullSafe(F.col("conv_id")), "left")
    count = lambda c: F.coalesce(F.col(c), F.lit(0).cast("long")).alias(c)
    nothing = hashlib.sha256(b"").hexdigest()
    return both.select(F.col("_id").alias("conv_id"), *map(count, _COUNTS), F.coalesce("audit", F.lit("")).alias("audit"), F.coalesce("repaired_sha256", F.lit(nothing)).alias("repaired_sha256"))
