"""Best-fit packing of token sequences, certified by dual-feasible-function bounds."""

from __future__ import annotations

import math
import string
import unicodedata
import zlib
from collections.abc import Iterator
from functools import cache

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import as_table, text_slices

PIECES = "doc_id long, piece int, start long, length long, ids_crc32 long"


class ChunkTokens:
    """Ids of white-space chunks, remembered between texts.

    The tokenizer drops white space and never joins what white space parts, so a text's ids are those of its chunks. It cuts
    a chunk into contractions, runs of letters, single digits and runs of other signs. So what follows a chunk's last letter or
    digit is encoded apart, where that one is sure to be a letter or digit for the tokenizer too."""

    CHUNKS, WORDS = 300_000, 800_000  # that are remembered at most

    def __init__(self, path: str):
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        vocab = self.tokenizer.get_vocab()
        self.ends = np.zeros(max(vocab.values()) + 1, bool)
        self.ends[[i for piece, i in vocab.items() if piece.endswith("</w>")]] = True
        self.chunks: dict[bytes, bytes] = {}
        self.words: dict[str, bytes] = {}

    def encode(self, blobs: list[bytes]) -> list[bytes]:
        """Each text's ids as little-endian unsigned 32-bit numbers."""
        split = [b.split() for b in blobs]
        new = set().union(*split).difference(self.chunks)
        if new:
            if len(self.chunks) + len(new) > self.CHUNKS:
                self.chunks.clear()
                new = set().union(*split)
            self._learn(new)
        return [b"".join(map(self.chunks.__getitem__, chunks)) for chunks in split]

    def _learn(self, chunks: set[bytes]) -> None:
        parts = {}
        for chunk in chunks:
            text = chunk.decode("utf-8", "replace")
            if "<|" in text:
                parts[chunk] = (text, "")
            else:
                text = text.lower() if text.isascii() else text
                word = text.rstrip(string.punctuation)
                parts[chunk] = (word, text[len(word) :]) if _ends_plainly(word) else (text, "")
        new = {x for pair in parts.values() for x in pair if x}.difference(self.words)
        if len(self.words) + len(new) > self.WORDS:
            self.words.clear()
            new = {x for pair in parts.values() for x in pair if x}
        plain = [x for x in new if x.isalpha() and unicodedata.is_normalized("NFC", x)]
        for low in range(0, len(plain), 256):
            some = plain[low : low + 256]
            ids = np.array(self.tokenizer.encode(" ".join(some), add_special_tokens=False).ids, "<u4")
            cuts = np.flatnonzero(self.ends[ids]) + 1
            if len(cuts) == len(some):
                data, at = ids.tobytes(), 0
                for x, cut in zip(some, cuts.tolist(), strict=True):
                    self.words[x] = data[at : 4 * cut]
                    at = 4 * cut
        rest = [x for x in new if x not in self.words]
        for x, e in zip(rest, self.tokenizer.encode_batch(rest, add_special_tokens=False), strict=True):
            self.words[x] = np.array(e.ids, "<u4").tobytes()
        self.words[""] = b""
        for chunk, (word, tail) in parts.items():
            self.chunks[chunk] = self.words[word] + self.words[tail]


def _ends_plainly(word: str) -> bool:
    """Whether the last character is a letter or digit that normalising and lower-casing leave one."""
    if not word or word.isascii():
        return word[-1:].isalnum()
    last = word[-1]
    return (last.isascii() and last.isalnum()) or (last < "\u0530" and last.isalpha() and len(last.lower()) == 1 and unicodedata.is_normalized("NFC", word))


@cache
def _tokens(path: str) -> ChunkTokens:
    return ChunkTokens(path)


def token_pieces(docs: DataFrame, tokenizer_path: str, capacity: int = 2048, end_id: int = 0, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Each text's ids, then end_id; those longer than capacity are cut into pieces of capacity ids.

    A null or empty text has end_id alone. Ids may be null or repeated: every row has its own pieces. Columns: PIECES."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tokens, end, step = _tokens(tokenizer_path), np.array([end_id], "<u4").tobytes(), 4 * capacity
        for batch, blobs in text_slices(batches, "text"):
            rows = []
            for doc, ids in zip(batch.column("doc_id").to_pylist(), tokens.encode(blobs), strict=True):
                ids += end
                rows += [(doc, k // step, k // 4, min(step, len(ids) - k) // 4, zlib.crc32(ids[k : k + step])) for k in range(0, len(ids), step)]
            columns = list(zip(*rows, strict=True))
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, (pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int64()), strict=True)], ["doc_id", "piece", "start", "length", "ids_crc32"])

    return docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text")).mapInArrow(run, PIECES)


def best_fit_decreasing(lengths: np.ndarray, capacity: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Bin and offset of each item, and each bin's free space. Items go by falling length (ties: as given) to the
    fullest bin that takes them; a bit for each free space that some bin has finds it at once."""
    bins, offsets = np.empty(len(lengths), np.int64), np.empty(len(lengths), np.int64)
    by_free: list[list[int]] = [[] for _ in range(capacity + 1)]
    free, have = [], 0
    for i in np.argsort(-lengths, kind="stable").tolist():
        n = int(lengths[i])
        fits = have >> n
        if fits:
            space = n + (fits & -fits).bit_length() - 1
            b = by_free[space].pop()
            if not by_free[space]:
                have &= ~(1 << space)
        else:
            b, space = len(free), capacity
            free.append(capacity)
        bins[i], offsets[i] = b, capacity - space
        free[b] = space - n
        if free[b]:
            by_free[free[b]].append(b)
            have |= 1 << free[b]
    return bins, offsets, np.array(free, np.int64)


def bin_bound(lengths: np.ndarray, capacity: int) -> int:
    """A number of bins that no packing can go below: the best of three families of dual-feasible functions.

    u_t: items over capacity - t count as whole bins, those under t as nothing, for every t up to half.
    f_k: an item counts as floor((k + 1) x) / k, or as x where (k + 1) x is whole (x: its share of a bin).
    Items over half a bin: one bin each."""
    if not len(lengths):
        return 0
    count = np.bincount(lengths, minlength=capacity + 1)
    n, total = np.cumsum(count), np.cumsum(count * np.arange(capacity + 1))
    t = np.arange(1, capacity // 2 + 1)
    u = (n[-1] - n[capacity - t]) * capacity + total[capacity - t] - total[t - 1]
    best = max(-(-int(total[-1]) // capacity), -(-int(u.max()) // capacity) if len(u) else 0, int(n[-1] - n[capacity // 2]))
    x = np.arange(capacity + 1)
    for k in range(1, 33):
        whole = (k + 1) * x % capacity == 0
        scaled = np.where(whole, k * x, (k + 1) * x // capacity * capacity)  # k * capacity times the item's value
        best = max(best, -(-int((count * scaled).sum()) // (k * capacity)))
    return best


def pack(pieces: DataFrame, capacity: int = 2048, shard_rows: int = 20_000, rounds: int = 3) -> DataFrame:
    """Packs pieces (column length, 1 to capacity) into as few sequences of capacity as it can.

    Rows are dealt into shards of about shard_rows; each runs best-fit decreasing and compares its bins with its bound.
    Shards at their bound are certified. The others exchange what lies in their unfilled bins: those rows are dealt
    anew over all such shards and packed again, which is kept if it saves bins, for some rounds.
    Adds sequence_id, offset, and certified (the shard's bins equal its bound); columns of these names are replaced, all others stay,
    whatever their names. Repeated rows are packed each. An empty table gives an empty table."""
    own, size = pieces.columns, f"c{pieces.columns.index('length')}"
    rows = as_table(pieces.toDF(*(f"c{i}" for i in range(len(own)))).withColumn("_row", F.monotonically_increasing_id()), "pieces")
    n = rows.count()
    types = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in rows.schema.fields)
    out_type = f"{types}, _shard long, _bin long, offset long, _free long, _gap boolean"

    def one(frame: pd.DataFrame) -> pd.DataFrame:
        frame = frame.sort_values("_row", ignore_index=True)
        lengths = frame[size].to_numpy(np.int64)
        bins, offsets, free = best_fit_decreasing(lengths, capacity)
        return frame.assign(_bin=bins, offset=offsets, _free=free[bins], _gap=len(free) > bin_bound(lengths, capacity))

    def deal(some: DataFrame, first: int, shards: int, seed: int) -> DataFrame:
        some = some.withColumn("_shard", F.pmod(F.xxhash64("_row", F.lit(seed)), F.lit(shards)) + F.lit(first))
        return as_table(some.groupBy("_shard").applyInPandas(one, out_type).select(*rows.columns, "_shard", "_bin", "offset", "_free", "_gap"), "packed")

    done, first = [], max(1, math.ceil(n / shard_rows))
    packed = deal(rows, 0, first, 0)
    for turn in range(1, rounds + 1):
        movable = F.col("_gap") & (F.col("_free") > 0)
        before = packed.where(movable).agg(F.count("*"), F.sum((F.col("offset") == 0).cast("int")), F.count_distinct("_shard")).first()
        if before[0] == 0 or before[2] < 2:
            break
        shards = max(1, math.ceil(before[0] / shard_rows))
        again = deal(packed.where(movable).select(rows.columns), first, shards, turn)
        if again.where(F.col("offset") == 0).count() >= before[1]:
            break
        done.append(packed.where(~movable))
        packed, first = again, first + shards
    for other in done:
        packed = packed.unionByName(other)
    kept = [F.col(f"c{i}").alias(c) for i, c in enumerate(own) if c.lower() not in ("sequence_id", "offset", "certified")]
    return packed.select(*kept, (F.col("_shard") * F.lit(1 << 32) + F.col("_bin")).alias("sequence_id"), "offset", (~F.col("_gap")).alias("certified"))


def pack_documents(docs: DataFrame, tokenizer_path: str, capacity: int = 2048) -> DataFrame:
    """Texts to packed pieces: token_pieces, then pack. A null or empty text is one piece of the end's id alone; very long texts are cut into pieces of
    capacity; repeated rows and null ids are packed each; other columns aren't read. An empty table gives an empty one."""
    return pack(token_pieces(docs, tokenizer_path, capacity), capacity)
