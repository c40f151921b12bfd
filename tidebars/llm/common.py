"""Helpers that the training-data operators share: scratch tables, text batches, word hashes."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Iterable, Iterator
from contextlib import contextmanager
from contextvars import ContextVar
from functools import cache

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

_scope: ContextVar[list[str] | None] = ContextVar("scratch", default=None)


@cache
def _own_dir() -> str:
    return tempfile.mkdtemp(prefix="spark-")


def scratch_path(spark: SparkSession, name: str, keep: bool = False) -> str:
    """A new path below the cluster's shared checkpoint folder; a local folder only where none is set. Unless kept, it is
    dropped with the scratch_tables block that it is made in."""
    base = spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if not base:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        base = _own_dir()
    path = f"{base}/tables/{uuid.uuid4().hex}/{name}"
    if (paths := _scope.get()) is not None and not keep:
        paths.append(path)
    return path


@contextmanager
def scratch_tables(spark: SparkSession) -> Iterator[None]:
    """A block at whose end the scratch tables made in it are deleted; what is read later has to be made with keep. Each thread
    has its own blocks, so that jobs side by side leave each other's tables alone."""
    paths: list[str] = []
    token = _scope.set(paths)
    try:
        yield
    finally:
        _scope.reset(token)
        drop_tables(spark, paths)


def drop_tables(spark: SparkSession, paths: list[str]) -> None:
    """Deletes scratch tables that nothing reads any more, wherever they lie."""
    for path in paths:
        at = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
        at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(at, True)


def as_table(df: DataFrame, name: str, keep: bool = False) -> DataFrame:
    """df written as Parquet in the shared folder and read again: cuts the lineage, survives lost executors."""
    spark, path = df.sparkSession, scratch_path(df.sparkSession, name, keep)
    df.write.option("compression", "zstd").parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def free_name(df: DataFrame, name: str) -> str:
    """The name, with underscores before it until no column of df has it, in any case of letters."""
    have = {c.lower() for c in df.columns}
    while name.lower() in have:
        name = "_" + name
    return name


def crc32_of(col: Column | str) -> Column:
    """crc32 of an id written as text; a null id counts as empty text."""
    return F.crc32(F.coalesce(F.col(col).cast("string") if isinstance(col, str) else col.cast("string"), F.lit("")))


def task_number() -> int:
    context = TaskContext.get()
    return context.partitionId() if context else 0


def text_slices(batches: Iterable[pa.RecordBatch], column: str, limit: int = 1 << 20) -> Iterator[tuple[pa.RecordBatch, list[bytes]]]:
    """Rows with their texts in UTF-8 (null: empty), in slices of about `limit` bytes, so that memory follows the
    longest text and not the batch."""
    for batch in batches:
        blobs = [x or b"" for x in batch.column(column).cast(pa.binary()).to_pylist()]
        low = size = 0
        for i, blob in enumerate(blobs):
            if i > low and size + len(blob) > limit:
                yield batch.slice(low, i - low), blobs[low:i]
                low, size = i, 0
            size += len(blob)
        if blobs:
            yield batch.slice(low), blobs[low:]


# --- word hashes -------------------------------------------------------------------------------------------------

_BASE = 0x9E3779B97F4A7C15 | 1
_WHITE = [0x20, *range(0x09, 0x0E)]


def mix64(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit numbers whose every output bit depends on every input bit."""
    x = x ^ (x >> np.uint64(33))
    x *= np.uint64(0xFF51AFD7ED558CCD)
    x ^= x >> np.uint64(33)
    x *= np.uint64(0xC4CEB9FE1A85EC53)
    x ^= x >> np.uint64(33)
    return x


@cache
def _tables(lower: bool, punctuation: bool) -> tuple[np.ndarray, np.ndarray]:
    """A random code for each byte, and which bytes end a word."""
    code = np.random.default_rng(20240607).integers(1, 1 << 63, 256, dtype=np.uint64)
    ends = np.zeros(256, bool)
    ends[_WHITE] = True
    if punctuation:
        ends[[b for b in range(128) if not chr(b).isalnum()]] = True
    if lower:
        code[0x41:0x5B] = code[0x61:0x7B]
    return code, ends


_powers: dict[int, np.ndarray] = {}


def _power_table(base: int, n: int) -> np.ndarray:
    """base**0, base**1, ... modulo 2**64; kept only up to 4 Mi entries."""
    have = _powers.get(base)
    if have is None or len(have) < n:
        have = np.full(max(n, 1 << 20), base, np.uint64)
        have[0] = 1
        np.cumprod(have, out=have)
        if n <= 1 << 22:
            _powers[base] = have
    return have[:n]


def word_hashes(blobs: list[bytes], lower: bool = True, punctuation: bool = False, heads: tuple[int, ...] = ()) -> tuple[np.ndarray, np.ndarray]:
    """A 64-bit hash for each word of the texts, and offsets: words offsets[i]:offsets[i + 1] are those of text i.

    Words are runs of bytes other than white space (also ASCII punctuation, with `punctuation`). The hash is a
    polynomial in the word's bytes, read off one running sum over all bytes. With heads, a row of hashes for each: of the
    words' first so many bytes, and 0 for words that are not longer."""
    raw = np.frombuffer(b"\n".join(blobs) + b"\n", np.uint8)
    code, ends_word = _tables(lower, punctuation)
    inside = ~ends_word[raw]
    edges = np.flatnonzero(np.diff(inside.view(np.int8), prepend=np.int8(0)))
    starts, ends = edges[0::2], edges[1::2]
    sums = np.zeros(len(raw) + 1, np.uint64)
    np.cumsum(code[raw] * _power_table(_BASE, len(raw)), out=sums[1:])
    back = _power_table(pow(_BASE, -1, 1 << 64), len(raw))[starts]
    places = np.searchsorted(starts, np.cumsum([0, *(len(b) + 1 for b in blobs)]))
    if heads:
        long = [ends - starts > n for n in heads]
        return np.stack([np.where(k, mix64((sums[np.minimum(starts + n, len(raw))] - sums[starts]) * back + np.uint64(n)), np.uint64(0)) for n, k in zip(heads, long, strict=True)]), places
    return mix64((sums[ends] - sums[starts]) * back), places


def shape_hashes(blobs: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """As word_hashes, of the words' shapes: letters become A or a, digits 0, and a run of one sign counts once."""
    return word_hashes([_shape(b) for b in blobs], lower=False)


_SHAPE = bytes(0x41 if 0x41 <= b < 0x5B else 0x61 if 0x61 <= b < 0x7B or b >= 0x80 else 0x30 if 0x30 <= b < 0x3A else b for b in range(256))


def _shape(blob: bytes) -> bytes:
    raw = np.frombuffer(blob.translate(_SHAPE), np.uint8)
    return raw[np.diff(raw, prepend=np.uint8(0)) != 0].tobytes() if len(raw) else b""


# --- sums of arrays over tasks -----------------------------------------------------------------------------------

BLOCKS = "block int, salt int, data binary"


def array_blocks(array: np.ndarray, size: int = 1 << 16) -> Iterator[pa.RecordBatch]:
    """A float32 array as rows of BLOCKS."""
    flat, salt = np.ascontiguousarray(array, np.float32).ravel(), task_number() % 8
    for k in range(0, len(flat), size):
        yield pa.RecordBatch.from_pydict({"block": pa.array([k // size], pa.int32()), "salt": pa.array([salt], pa.int32()), "data": pa.array([flat[k : k + size].tobytes()], pa.binary())})


def _add_up(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    sums: dict[int, np.ndarray] = {}
    for batch in batches:
        for block, data in zip(batch.column("block").to_pylist(), batch.column("data"), strict=True):
            part = np.frombuffer(data.as_buffer(), np.float32)
            if block in sums:
                sums[block] += part
            else:
                sums[block] = part.copy()
    for block, total in sums.items():
        yield pa.RecordBatch.from_pydict({"block": pa.array([block], pa.int32()), "salt": pa.array([0], pa.int32()), "data": pa.array([total.tobytes()], pa.binary())})


def summed(blocks: DataFrame, n: int) -> np.ndarray:
    """The sum of all tasks' arrays of n numbers. Two streaming levels, so that no task holds more than the blocks
    dealt to it; only the sum, whose size the caller's parameters fix, comes to the driver."""
    tasks = max(2, min(64, int(blocks.sparkSession.conf.get("spark.sql.shuffle.partitions"))))
    first = blocks.repartition(tasks, "block", "salt").mapInArrow(_add_up, BLOCKS)
    rows = first.repartition(tasks, "block").mapInArrow(_add_up, BLOCKS).collect()
    out = np.zeros(n, np.float32)
    for r in rows:
        part = np.frombuffer(r["data"], np.float32)
        at = r["block"] * (1 << 16)
        out[at : at + len(part)] += part
    return out
