"""Media columns: texts' bytes in ISO media containers, and what a walk over the boxes tells of any container."""

from __future__ import annotations

import hashlib
import struct
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import as_table, text_slices

FRAME, RATE, CHUNK, KEY_EVERY = 64, 25, 256, 16  # bytes a sample (8 x 8 grey), samples a second, a chunk, a keyframe

_MATRIX = struct.pack(">9i", 0x10000, 0, 0, 0, 0x10000, 0, 0, 0, 0x40000000)
_PARENTS = {b"moov", b"trak", b"mdia", b"minf", b"stbl", b"edts", b"dinf", b"mvex", b"udta"}


def _box(kind: bytes, *parts: bytes) -> bytes:
    body = b"".join(parts)
    return struct.pack(">I4s", len(body) + 8, kind) + body


def _full(kind: bytes, *parts: bytes, flags: int = 0) -> bytes:
    return _box(kind, struct.pack(">I", flags), *parts)


def write_container(payload: bytes) -> bytes:
    """One video track of raw 8-bit grey samples whose bytes are the payload, which must be whole samples."""
    n = len(payload) // FRAME
    chunks, last = -(-n // CHUNK), (n - 1) % CHUNK + 1
    runs = ([(1, CHUNK, 1)] if chunks > 1 else []) + ([(chunks, last, 1)] if last != CHUNK or chunks == 1 else [])
    keys = np.arange(1, n + 1, KEY_EVERY, dtype=">u4")
    head = _box(b"ftyp", b"isom", struct.pack(">I", 512), b"isomiso2mp41")
    entry = _box(b"raw ", bytes(6), struct.pack(">H16xHHIIIH32sHh", 1, 8, 8, 0x480000, 0x480000, 0, 1, b"", 40, -1))

    def moov(base: int) -> bytes:
        places = (base + np.arange(chunks, dtype=np.int64) * CHUNK * FRAME).astype(">u8" if base + len(payload) >= 1 << 32 else ">u4")
        table = _box(
            b"stbl",
            _full(b"stsd", struct.pack(">I", 1), entry),
            _full(b"stts", struct.pack(">III", 1, n, 1)),
            _full(b"stss", struct.pack(">I", len(keys)), keys.tobytes()),
            _full(b"stsc", struct.pack(">I", len(runs)), *(struct.pack(">III", *r) for r in runs)),
            _full(b"stsz", struct.pack(">II", FRAME, n)),
            _full(b"stco" if places.itemsize == 4 else b"co64", struct.pack(">I", chunks), places.tobytes()),
        )
        info = _box(b"minf", _full(b"vmhd", bytes(8), flags=1), _box(b"dinf", _full(b"dref", struct.pack(">I", 1), _full(b"url ", flags=1))), table)
        media = _box(b"mdia", _full(b"mdhd", struct.pack(">IIIIHH", 0, 0, RATE, n, 0x55C4, 0)), _full(b"hdlr", struct.pack(">I4s12x", 0, b"vide"), b"text bytes\0"), info)
        track = _box(b"trak", _full(b"tkhd", struct.pack(">IIIII8xhhhH", 0, 0, 1, 0, n, 0, 0, 0, 0), _MATRIX, struct.pack(">II", 8 << 16, 8 << 16), flags=3), media)
        return _box(b"moov", _full(b"mvhd", struct.pack(">IIIIIH10x", 0, 0, RATE, n, 0x10000, 0x100), _MATRIX, bytes(24), struct.pack(">I", 2)), track)

    wide = len(payload) + 8 >= 1 << 32
    lead = struct.pack(">I4sQ", 1, b"mdat", len(payload) + 16) if wide else struct.pack(">I4s", len(payload) + 8, b"mdat")
    base = len(head) + len(moov(0)) + len(lead)
    if base + len(payload) >= 1 << 32:
        base = len(head) + len(moov(1 << 32)) + len(lead)
    return b"".join((head, moov(base), lead, payload))


def walk_boxes(data: bytes, low: int = 0, high: int | None = None, path: tuple[bytes, ...] = ()) -> Iterator[tuple[tuple[bytes, ...], int, int]]:
    """Path, first and past-last byte of each box's body, parents before children. Sizes 0 (to the end) and 1 (64 bits)
    are known; a box that runs past its parent ends the walk with ValueError."""
    high = len(data) if high is None else high
    while low + 8 <= high:
        size, kind = struct.unpack_from(">I4s", data, low)
        start = low + 8
        if size == 1:
            if low + 16 > high:
                raise ValueError("a box's size is cut off")
            size, start = struct.unpack_from(">Q", data, start)[0], low + 16
        end = high if size == 0 else low + size
        if end > high or end < start:
            raise ValueError(f"box {kind!r} runs past its parent")
        yield (*path, kind), start, end
        if kind in _PARENTS:
            yield from walk_boxes(data, start, end, (*path, kind))
        low = end


def _numbers(data: bytes, at: int, n: int, kind: str, high: int) -> np.ndarray:
    if at + n * np.dtype(kind).itemsize > high:
        raise ValueError("a sample table is cut off")
    return np.frombuffer(data, kind, n, at).astype(np.int64)


def read_tracks(data: bytes) -> list[dict]:
    """Each track's handler, codec, size, duration, and place, size and sync flag of every sample."""
    tracks: list[dict] = []
    for path, at, end in walk_boxes(data):
        kind = path[-1]
        if kind == b"trak":
            tracks.append({})
        if not tracks or b"trak" not in path:
            continue
        t = tracks[-1]
        if kind == b"mdhd":
            wide = data[at] == 1
            t["rate"], t["ticks"] = struct.unpack_from(">IQ" if wide else ">II", data, at + (20 if wide else 12))
        elif kind == b"hdlr":
            t["handler"] = data[at + 8 : at + 12].decode("latin-1")
        elif kind == b"stsd" and struct.unpack_from(">I", data, at + 4)[0]:
            t["codec"] = data[at + 12 : at + 16].decode("latin-1")
            if t.get("handler") == "vide":
                t["width"], t["height"] = struct.unpack_from(">HH", data, at + 40)
        elif kind in (b"stsz", b"stz2"):
            same, n = struct.unpack_from(">II", data, at + 4)
            if kind == b"stz2":
                bits = same & 255
                if bits == 4:
                    pairs = _numbers(data, at + 12, (n + 1) // 2, ">u1", end)
                    t["sizes"] = np.stack([pairs >> 4, pairs & 15], 1).ravel()[:n]
                else:
                    t["sizes"] = _numbers(data, at + 12, n, f">u{bits // 8}", end)
            else:
                t["sizes"] = np.full(n, same, np.int64) if same else _numbers(data, at + 12, n, ">u4", end)
        elif kind in (b"stco", b"co64"):
            t["chunks"] = _numbers(data, at + 8, struct.unpack_from(">I", data, at + 4)[0], ">u4" if kind == b"stco" else ">u8", end)
        elif kind == b"stsc":
            t["runs"] = _numbers(data, at + 8, 3 * struct.unpack_from(">I", data, at + 4)[0], ">u4", end).reshape(-1, 3)
        elif kind == b"stts":
            t["times"] = _numbers(data, at + 8, 2 * struct.unpack_from(">I", data, at + 4)[0], ">u4", end).reshape(-1, 2)
        elif kind == b"stss":
            t["sync"] = _numbers(data, at + 8, struct.unpack_from(">I", data, at + 4)[0], ">u4", end) - 1
    for t in tracks:
        sizes, chunks, runs = t.get("sizes", np.zeros(0, np.int64)), t.get("chunks", np.zeros(0, np.int64)), t.get("runs", np.zeros((0, 3), np.int64))
        each = np.repeat(runs[:, 1], np.diff(np.append(runs[:, 0], len(chunks) + 1))) if len(runs) else np.zeros(0, np.int64)
        if each.sum() != len(sizes) or len(each) != len(chunks):
            raise ValueError("the sample tables disagree")
        before = np.cumsum(sizes) - sizes
        first = np.cumsum(each) - each
        t["places"] = np.repeat(chunks - (before[first] if len(first) else 0), each) + before
        t["sizes"] = sizes
        t["keys"] = t.get("sync", np.arange(len(sizes)))
        if len(t["keys"]) and (t["keys"].min() < 0 or t["keys"].max() >= len(sizes)):
            raise ValueError("a keyframe has no sample")
        if "times" in t:
            t["ticks"] = int((t["times"][:, 0] * t["times"][:, 1]).sum())
    return tracks


def sample_bytes(data: bytes, track: dict) -> bytes:
    """The samples' stored bytes in order, neighbours read at once."""
    places, sizes = track["places"], track["sizes"]
    if not len(places):
        return b""
    if int((places + sizes).max()) > len(data):
        raise ValueError("a sample lies past the end")
    cut = np.flatnonzero(places[1:] != places[:-1] + sizes[:-1]) + 1
    firsts, lasts = np.append(0, cut), np.append(cut, len(places)) - 1
    return b"".join(data[a:b] for a, b in zip(places[firsts].tolist(), (places[lasts] + sizes[lasts]).tolist(), strict=True))


def store_texts(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, n_bytes and media: each text's UTF-8 bytes (null: none), padded with 0 to a positive multiple of 64, as a
    container. One row per row, whatever its id."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch, blobs in text_slices(batches, "text"):
            media = [write_container(b + bytes(-len(b) % FRAME if b else FRAME)) for b in blobs]
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(map(len, blobs), pa.int64()), pa.array(media, pa.binary())], ["doc_id", "n_bytes", "media"])

    return docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text")).mapInArrow(run, "doc_id long, n_bytes long, media binary")


PROBE = (
    "doc_id long, n_bytes long, payload_bytes long, payload_sha256 string, tail_crc32 long, media_bytes long, media_sha256 string, feature string, "
    "codec string, duration_s double, n_samples long, keyframes array<struct<offset: long, length: long>>, error string"
)


def probe(media: DataFrame) -> DataFrame:
    """From doc_id, n_bytes and media: the first track's codec, duration and keyframe byte ranges, the digests of its
    samples' bytes and of the container, and a line that sums up the track. Samples are not decoded.

    Null or broken media has nulls and an error. Repeated rows are rows of their own, other columns aren't read, and an empty table gives an empty one."""
    key = pa.struct([("offset", pa.int64()), ("length", pa.int64())])

    def one(data: bytes | None) -> tuple:
        if data is None:
            return (None,) * 11 + ("no media",)
        stored = (len(data), hashlib.sha256(data).hexdigest())
        try:
            t = read_tracks(data)[0]
            payload = sample_bytes(data, t)
            ranges = np.stack([t["places"][t["keys"]], t["sizes"][t["keys"]]], 1)
            said = f"{t['handler']}/{t['codec'].strip()} {t.get('width', 0)}x{t.get('height', 0)} {t['ticks']}/{t['rate']} samples={len(t['sizes'])} keyframes={len(ranges)} ranges={zlib.crc32(ranges.tobytes()):08x}"
            keys = [{"offset": a, "length": b} for a, b in ranges.tolist()]
            return (len(payload), hashlib.sha256(payload).hexdigest(), zlib.crc32(payload[-FRAME:]), *stored, said, t["codec"].strip(), t["ticks"] / t["rate"], len(t["sizes"]), keys, None)
        except (ValueError, KeyError, IndexError, ZeroDivisionError, struct.error) as e:
            return (None, None, None, *stored, None, None, None, None, None, f"{type(e).__name__}: {e}")

    kinds = [pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.string(), pa.string(), pa.string(), pa.float64(), pa.int64(), pa.list_(key), pa.string()]
    names = ["payload_bytes", "payload_sha256", "tail_crc32", "media_bytes", "media_sha256", "feature", "codec", "duration_s", "n_samples", "keyframes", "error"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for low in range(0, whole.num_rows, 256):
                batch = whole.slice(low, 256)
                rows = [one(x.as_py())[:11] if x.is_valid else (*(None,) * 10, "no media") for x in batch.column("media")]
                yield pa.RecordBatch.from_arrays([batch.column("doc_id"), batch.column("n_bytes"), *(pa.array(c, k) for c, k in zip(zip(*rows, strict=True), kinds, strict=True))], ["doc_id", "n_bytes", *names])

    return media.select("doc_id", "n_bytes", "media").mapInArrow(run, PROBE)


def media_round_trip(docs: DataFrame) -> DataFrame:
    """store_texts to a table in the shared folder, then probe of what that table holds; the table stays, as the result reads it. Null texts count as empty,
    null and repeated ids keep their rows, texts are whole however long, and other columns aren't read. An empty table gives an empty one."""
    return probe(as_table(store_texts(docs), "media"))
