"""WARC archives of pages, and the external merge of their capture indexes."""

from __future__ import annotations

import hashlib
import uuid
import zlib
from collections.abc import Iterator
from datetime import datetime, timedelta
from urllib.parse import urlsplit

import pyarrow as pa
from pyarrow import fs as pafs
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import as_table, scratch_path, scratch_tables, task_number

FILE_BYTES, FILE_RECORDS, RANGE_ROWS = 64 << 20, 50_000, 100_000  # an archive's size and records, and a merged range's rows, at most or about
PERIOD = 1_000_000_000  # seconds after which capture times start again
START = datetime(2024, 1, 1)
ARCHIVES = "archive string, records long, bytes long"
INDEX = (
    "url_key string, captured string, page_id long, url string, payload_bytes long, payload_digest string, record_type string, refers_to long, "
    "archive string, offset long, length long"
)
NAMES = [f.split()[0] for f in INDEX.split(", ")]


def _batch(rows: list[tuple], schema: str) -> pa.RecordBatch:
    columns = zip(*rows, strict=True)
    return pa.RecordBatch.from_pydict({f.split()[0]: pa.array(c, pa.string() if f.endswith("string") else pa.int32() if f.endswith("int") else pa.int64()) for f, c in zip(schema.split(", "), columns, strict=True)})


def decided(pages: DataFrame, least: int) -> DataFrame:
    """page_id, url, html, digest, size and first: the page that a record revisits, else null.

    Of records with equal payloads of `least` bytes or more, the one with the smallest page_id is a response, the others revisit
    it; a null page_id revisits if any other page has its payload, and is a response else. Rows that repeat the smallest page_id
    are all responses, as a record can't revisit itself. Only (page_id, digest) is shuffled, and the list of repeated payloads is written first, so that Spark knows its size: the pages
    move only if that list is too long to be broadcast."""
    html = F.coalesce(F.col("html"), F.lit(""))
    rows = pages.select(F.col("page_id").cast("long").alias("page_id"), F.coalesce(F.col("url"), F.lit("")).alias("url"), html.alias("html"), F.sha2(html, 256).alias("digest"), F.octet_length(html).cast("long").alias("size"))
    firsts = rows.where(F.col("size") >= least).groupBy("digest").agg(F.min("page_id").alias("first"), F.count("*").alias("n")).where("n > 1 and first is not null")
    rows = rows.join(as_table(firsts.select("digest", "first"), "firsts"), "digest", "left")
    return rows.withColumn("first", F.when(~F.col("first").eqNullSafe(F.col("page_id")), F.col("first")))


def record(page: int | None, url: str, html: bytes, digest: str, first: int | None) -> bytes:
    """A WARC/1.1 record. Payload: html in UTF-8; a revisit has no body. A page's capture time is START plus page_id seconds (tables
    of pages have no time), modulo PERIOD."""
    again = first is not None
    day = (START + timedelta(seconds=(page or 0) % PERIOD)).strftime("%Y-%m-%dT%H:%M:%SZ")
    lines = [
        "WARC/1.1", f"WARC-Type: {'revisit' if again else 'response'}", f"WARC-Record-ID: <urn:page:{'null' if page is None else page}>", f"WARC-Date: {day}", f"WARC-Target-URI: {url.translate(_LINES)}", f"WARC-Payload-Digest: sha256:{digest}",
        *((f"WARC-Refers-To: <urn:page:{first}>", "WARC-Profile: http://netpreserve.org/warc/1.1/revisit/identical-payload-digest", f"WARC-Payload-Length: {len(html)}") if again else ()), "Content-Type: text/html", f"Content-Length: {0 if again else len(html)}",
    ]
    return "\r\n".join(lines).encode() + b"\r\n\r\n" + (b"" if again else html) + b"\r\n\r\n"


_LINES = {10: None, 13: None}


def write_archives(pages: DataFrame, path: str, least: int = 100) -> DataFrame:
    """Writes a record for every page (null html: empty) and gives the list of archives (ARCHIVES), which is written too.

    Tasks write gzipped archives below path, a member for each record, so that a record can be read by its offset and length; an
    archive ends at FILE_BYTES or FILE_RECORDS. Its name is new in every attempt and only finished attempts are listed, so tasks may be
    lost and run again. path has to be on a file system that Arrow opens (local or shared folders, HDFS, S3, GCS)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        system, base = pafs.FileSystem.from_uri(path)
        system.create_dir(base, recursive=True)
        out = name = None
        records = size = 0
        for batch in batches:
            for row in zip(*(batch.column(c) for c in ("page_id", "url", "html", "digest", "first")), strict=True):
                page, url, html, digest, first = (row[0].as_py(), row[1].as_py(), row[2].as_buffer().to_pybytes() if row[2].as_buffer() else b"", row[3].as_py(), row[4].as_py())
                if out is None:
                    name = f"{task_number():06d}-{uuid.uuid4().hex}.warc.gz"
                    out, records, size = system.open_output_stream(f"{base}/{name}", compression=None), 0, 0
                packer = zlib.compressobj(6, zlib.DEFLATED, 31)
                member = packer.compress(record(page, url, html, digest, first)) + packer.flush()
                out.write(member)
                records, size = records + 1, size + len(member)
                if size >= FILE_BYTES or records >= FILE_RECORDS:
                    out.close()
                    out = None
                    yield _batch([(f"{path}/{name}", records, size)], ARCHIVES)
        if out is not None:
            out.close()
            yield _batch([(f"{path}/{name}", records, size)], ARCHIVES)

    return as_table(decided(pages, least).select("page_id", "url", "html", "digest", "first").mapInArrow(run, ARCHIVES), "archives", keep=True)


def read_members(stream, step: int = 1 << 20) -> Iterator[tuple[int, int, bytes]]:
    """Offset, length and content of each gzip member of an open file, read a piece at a time."""
    at, data = 0, stream.read(step)
    while data:
        unpack, parts, length = zlib.decompressobj(31), [], 0
        while not unpack.eof:
            if not data:
                raise ValueError("an archive is cut off")
            parts.append(unpack.decompress(data))
            length += len(data) - len(unpack.unused_data)
            data = unpack.unused_data if unpack.eof else stream.read(step)
        yield at, length, b"".join(parts)
        at += length
        data = data or stream.read(step)


def parse_record(data: bytes) -> tuple[dict[str, str], bytes]:
    """Headers (names in lower case) and payload, which is what Content-Length says, so that it may hold any bytes."""
    end = data.find(b"\r\n\r\n")
    lines = data[: max(end, 0)].decode("utf-8", "replace").split("\r\n")
    if not lines[0].startswith("WARC/"):
        raise ValueError("this is no record")
    head = {k.strip().lower(): v.strip() for k, _, v in (x.partition(":") for x in lines[1:])}
    size = int(head["content-length"])
    if data[end + 4 + size :] != b"\r\n\r\n":
        raise ValueError("a record's length is wrong")
    return head, data[end + 4 : end + 4 + size]


def url_key(url: str) -> str:
    """The sort key of a URL: its host's labels from the right without www, then port, path and query, in lower case."""
    try:
        parts = urlsplit(url.strip())
        host, port = (parts.hostname or "").lower(), parts.port
    except ValueError:
        return url.strip().lower()
    labels = host.removeprefix("www.").split(".")
    return ",".join(reversed(labels)) + (f":{port}" if port and port not in (80, 443) else "") + ")" + (parts.path.lower() or "/") + (f"?{parts.query.lower()}" if parts.query else "")


def read_index(archives: DataFrame) -> DataFrame:
    """The capture index (INDEX) of archives: a row for each record, each archive's rows sorted by _order: a run. Payload length and digest are
    computed from a response's bytes; a revisit has no bytes and tells those of its response. A task holds one archive's rows."""

    def page(said: str) -> int | None:
        number = said.removeprefix("<urn:page:").rstrip(">")
        return None if number == "null" else int(number)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for path in batch.column("archive").to_pylist():
                rows, (system, name) = [], pafs.FileSystem.from_uri(path)
                with system.open_input_stream(name, compression=None) as stream:
                    for offset, length, data in read_members(stream):
                        head, body = parse_record(data)
                        kind, uri = head["warc-type"], head["warc-target-uri"]
                        full = (int(head["warc-payload-length"]), head["warc-payload-digest"].removeprefix("sha256:")) if kind == "revisit" else (len(body), hashlib.sha256(body).hexdigest())
                        rows.append((url_key(uri), head["warc-date"], page(head["warc-record-id"]), uri, *full, kind, page(head["warc-refers-to"]) if "warc-refers-to" in head else None, path, offset, length))
                rows.sort(key=_order)
                for low in range(0, len(rows), 5000):
                    yield _batch(rows[low : low + 5000], INDEX)

    return archives.repartition(max(1, archives.count())).select("archive").mapInArrow(run, INDEX)


def fetch(path: str, offset: int, length: int) -> tuple[dict[str, str], bytes]:
    """A record's headers and body by its place in an archive: nothing else of the archive is read. A place where no record begins is an error (of zlib, or ValueError)."""
    system, name = pafs.FileSystem.from_uri(path)
    with system.open_input_file(name) as file:
        file.seek(offset)
        return parse_record(zlib.decompress(file.read(length), 31))


def _order(row: tuple) -> tuple:
    return row[0], row[1], row[2] is not None, row[2] or 0, row[8], row[9]


def merge_runs(runs: list[list[tuple]], key=_order) -> Iterator[tuple]:
    """A k-way merge of sorted runs by a loser tree: each inner node holds the loser of its match, so that the next row
    costs one path of log k matches."""
    k = len(runs)
    if k == 0:
        return
    heads = [iter(r) for r in runs]
    now = [next(h, None) for h in heads]
    keys = [None if x is None else key(x) for x in now]

    def beats(a: int, b: int) -> bool:
        return a >= 0 and keys[a] is not None and (b < 0 or keys[b] is None or (keys[a], a) < (keys[b], b))

    losers = [-1] * k

    def play(node: int) -> int:
        if node >= k:
            return node - k
        a, b = play(2 * node), play(2 * node + 1)
        losers[node] = b if beats(a, b) else a
        return a if beats(a, b) else b

    winner = play(1) if k > 1 else 0
    while keys[winner] is not None:
        yield now[winner]
        now[winner] = next(heads[winner], None)
        keys[winner] = None if now[winner] is None else key(now[winner])
        node = (winner + k) // 2
        while node:
            if beats(losers[node], winner):
                winner, losers[node] = losers[node], winner
            node //= 2


def natural_runs(rows: Iterator[tuple]) -> list[list[tuple]]:
    """Rows cut where their order breaks. Runs that arrive whole or in sorted pieces stay as they are."""
    runs: list[list[tuple]] = []
    last = None
    for row in rows:
        key = _order(row)
        if last is None or key < last:
            runs.append([])
        runs[-1].append(row)
        last = key
    return runs


def merge_index(index: DataFrame) -> DataFrame:
    """The index in one order over all archives: INDEX, capture (a URL key's captures numbered from 1), range_no and position.

    The key space is cut into ranges of about RANGE_ROWS rows at sampled (url_key, captured, page_id), so that one hot URL or host
    spreads over many ranges and a task's memory is that of a range, however many there are. In a range the archives' sorted
    shares are merged by a loser tree, without sorting them again. (range_no, position) is the global order. A URL key's captures that go on
    from one range to the next are numbered on by the counts of its ranges before."""
    ranges = max(int(index.sparkSession.conf.get("spark.sql.shuffle.partitions")), -(-index.count() // RANGE_ROWS))
    out_type = f"{INDEX}, capture long, range_no int, position long"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows = (row for batch in batches for row in zip(*(batch.column(n).to_pylist() for n in NAMES), strict=True))
        out: list[tuple] = []
        key, capture = None, 0
        for position, row in enumerate(merge_runs(natural_runs(rows))):
            capture = capture + 1 if row[0] == key else 1
            key = row[0]
            out.append((*row, capture, task_number(), position))
            if len(out) == 5000:
                yield _batch(out, out_type)
                out = []
        if out:
            yield _batch(out, out_type)

    merged = as_table(index.repartitionByRange(ranges, "url_key", "captured", "page_id").mapInArrow(run, out_type), "merged", keep=True)
    parts = merged.groupBy("url_key", "range_no").agg(F.max("capture").alias("n"))
    so_far = Window.partitionBy("url_key").orderBy("range_no").rowsBetween(Window.unboundedPreceding, -1)
    on = as_table(parts.withColumn("_on", F.sum("n").over(so_far)).where("_on > 0").select("url_key", "range_no", "_on"), "spans", keep=True)  # a row a range at most
    return merged.join(on, ["url_key", "range_no"], "left").withColumn("capture", F.col("capture") + F.coalesce("_on", F.lit(0))).select(*NAMES, "capture", "range_no", "position")


def archive_pages(pages: DataFrame, least: int = 100) -> DataFrame:
    """Writes the archives to the shared folder, reads them back and merges their indexes. Rows may repeat, ids may be null, pages of
    any length; other columns are ignored; an empty table gives an empty index."""
    spark = pages.sparkSession
    with scratch_tables(spark):
        archives = write_archives(pages, scratch_path(spark, "warc", keep=True), least)
        return merge_index(as_table(read_index(archives), "index"))
