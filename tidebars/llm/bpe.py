"""Byte-level BPE through a sentencepiece model that is serialised directly from a rank file."""

from __future__ import annotations

import base64
import hashlib
import struct
from collections.abc import Iterator
from functools import cache

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import text_slices

# Bytes that stand for themselves in byte-level vocabularies; the others get the characters from 256 on.
_PLAIN = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
_CHAR = {b: chr(b) for b in _PLAIN} | {b: chr(256 + i) for i, b in enumerate(sorted(set(range(256)) - set(_PLAIN)))}
_MAPPED = [_CHAR[b] for b in range(256)]


def byte_mapped(data: bytes) -> str:
    """One character for each byte, none of them white space."""
    return data.decode("latin-1").translate(_MAPPED)


def _field(number: int, value: bytes | int | float) -> bytes:
    def varint(n: int) -> bytes:
        out = bytearray()
        while n > 127:
            out.append(n & 127 | 128)
            n >>= 7
        out.append(n)
        return bytes(out)

    if isinstance(value, bytes):
        return varint(number << 3 | 2) + varint(len(value)) + value
    if isinstance(value, float):
        return varint(number << 3 | 5) + struct.pack("<f", value)
    return varint(number << 3) + varint(value)


def piece_model(ranks: dict[bytes, int]) -> bytes:
    """A BPE model: the piece of id n is the byte-mapped token of rank n with score -n, so that the best-scored merge is
    the lowest-ranked; an unknown piece follows, which no byte-mapped text needs; normalisation changes nothing."""
    by_rank = sorted(ranks, key=ranks.__getitem__)
    if [ranks[t] for t in by_rank] != list(range(len(by_rank))):
        raise ValueError("ranks must run from 0 without gaps")
    pieces = b"".join(_field(1, _field(1, byte_mapped(t).encode()) + _field(2, float(-i)) + _field(3, 1)) for i, t in enumerate(by_rank))
    unknown = _field(1, _field(1, b"<unk>") + _field(2, 0.0) + _field(3, 2))
    trainer = _field(2, _field(3, 2) + _field(4, len(by_rank) + 1) + _field(40, len(by_rank)))
    normalizer = _field(3, _field(1, b"identity") + _field(2, b"") + _field(3, 0) + _field(4, 0) + _field(5, 0))
    return pieces + unknown + trainer + normalizer


def load_ranks(path: str) -> dict[bytes, int]:
    with open(path, "rb") as f:
        return {base64.b64decode(a): int(b) for a, b in map(bytes.split, f) if a}


class PieceCodec:
    """Encodes pre-tokens, each once while remembered, and decodes ids; ids are in decimal, as the digests want them."""

    MOST = 500_000

    def __init__(self, ranks: dict[bytes, int], pattern: str):
        import regex
        from sentencepiece import SentencePieceProcessor

        self.find = regex.compile(pattern).findall
        self.pieces = SentencePieceProcessor(model_proto=piece_model(ranks))
        self.whole = {t: str(i) for t, i in ranks.items()}
        self.bytes_of = {str(i): t for t, i in ranks.items()}
        self.known: dict[str, str] = {}

    def encode(self, texts: list[str]) -> list[str]:
        split = [self.find(t) for t in texts]
        new = set().union(*split).difference(self.known)
        if new:
            if len(self.known) + len(new) > self.MOST:
                self.known.clear()
                new = set().union(*split)
            rest = []
            for token in new:
                data = token.encode()
                if (i := self.whole.get(data)) is not None:
                    self.known[token] = i
                else:
                    rest.append((token, byte_mapped(data)))
            for (token, _), ids in zip(rest, self.pieces.encode([m for _, m in rest], num_threads=1), strict=True):
                self.known[token] = " ".join(map(str, ids))
        return [" ".join(map(self.known.__getitem__, tokens)) for tokens in split]

    def decode(self, ids: str) -> bytes:
        return b"".join(map(self.bytes_of.__getitem__, ids.split(" "))) if ids else b""


@cache
def _codec(path: str, pattern: str) -> PieceCodec:
    return PieceCodec(load_ranks(path), pattern)


def encode_texts(docs: DataFrame, ranks_path: str, pattern: str, id_col: str = "doc_id", text_col: str = "text", with_ids: bool = True) -> DataFrame:
    """doc_id, n_tokens, ids (array, left out unless with_ids), ids_sha256 of the decimal ids joined by spaces, and
    decoded_sha256 of the bytes that the ids decode to. A null or empty text has no ids; every row gives a row."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        codec = _codec(ranks_path, pattern)
        for batch, blobs in text_slices(batches, "text"):
            ids = codec.encode([b.decode("utf-8", "replace") for b in blobs])
            columns = [batch.column("doc_id"), pa.array([s.count(" ") + bool(s) for s in ids], pa.int64())]
            if with_ids:
                columns.append(pa.array([[int(x) for x in s.split(" ")] if s else [] for s in ids], pa.list_(pa.int32())))
            columns += [pa.array([hashlib.sha256(x).hexdigest() for x in some], pa.string()) for some in ([s.encode() for s in ids], [codec.decode(s) for s in ids])]
            yield pa.RecordBatch.from_arrays(columns, [f.split()[0] for f in out.split(", ")])

    out = "doc_id long, n_tokens long, " + "ids array<int>, " * with_ids + "ids_sha256 string, decoded_sha256 string"
    return docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text")).mapInArrow(run, out)


def decode_ids(encoded: DataFrame, ranks_path: str, pattern: str) -> DataFrame:
    """doc_id and text from doc_id and ids: the inverse of encode_texts. Null ids give a null text, no ids an empty one; bytes that aren't UTF-8, as
    of a cut list, give signs of replacement. An id that the ranks don't have is an error: the list is of another vocabulary. Null and repeated doc_ids
    keep their rows; other columns aren't read. An empty table gives an empty one."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        codec = _codec(ranks_path, pattern)
        for batch in batches:
            texts = [None if x is None else codec.decode(" ".join(map(str, x))).decode("utf-8", "replace") for x in batch.column("ids").to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(texts, pa.string())], ["doc_id", "text"])

    return encoded.select("doc_id", "ids").mapInArrow(run, "doc_id long, text string")
