"""Versions of a folder of tables: what a writer wrote is seen once a manifest names it, and a manifest appears by one rename.

A reader takes the newest manifest, or a version, and reads what it names; nothing that a manifest names is ever changed. A writer that dies
leaves files that no manifest names."""

from __future__ import annotations

import json
import uuid
from collections.abc import Callable
from urllib.parse import unquote

from py4j.protocol import Py4JJavaError
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

SHARE_BYTES = 1 << 24  # of stored rows to a task that writes a part


class Conflict(RuntimeError):
    """Another writer committed the version first."""


def _at(spark: SparkSession, path: str):
    return spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)


def _system(spark: SparkSession, path: str):
    return _at(spark, path).getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())


def exists(spark: SparkSession, path: str) -> bool:
    return _system(spark, path).exists(_at(spark, path))


def delete(spark: SparkSession, path: str) -> None:
    _system(spark, path).delete(_at(spark, path), True)


def size(spark: SparkSession, path: str) -> int:
    """Bytes of a file, or of all files below a folder."""
    return _system(spark, path).getContentSummary(_at(spark, path)).getLength()


def versions(spark: SparkSession, path: str) -> list[int]:
    """The folder's versions, oldest first."""
    if not exists(spark, f"{path}/_commits"):
        return []
    names = (f.getPath().getName() for f in _system(spark, path).listStatus(_at(spark, f"{path}/_commits")))
    return sorted(int(n.removesuffix(".json")) for n in names if n.endswith(".json") and not n.startswith((".", "_")))


def manifest(spark: SparkSession, path: str, version: int | None = None) -> tuple[int, dict]:
    """A version and its manifest: the newest, or the given one. A folder without any is version 0, with an empty manifest."""
    if version is None:
        version = max(versions(spark, path), default=0)
    if not version:
        return 0, {}
    text = spark.read.option("wholetext", True).text(f"{path}/_commits/{version:010d}.json").first()[0]
    return version, json.loads(text)


def commit(spark: SparkSession, path: str, content: dict, after: int) -> int:
    """Makes content the manifest of the version after `after`, which must be the newest still: else Conflict, and nothing changes."""
    jvm, version = spark.sparkContext._jvm, after + 1
    draft, final = f"{path}/_commits/.{uuid.uuid4().hex}", f"{path}/_commits/{version:010d}.json"
    stream = _system(spark, path).create(_at(spark, draft), False)
    stream.write(json.dumps(content, sort_keys=True).encode())
    stream.close()
    files = jvm.org.apache.hadoop.fs.FileContext.getFileContext(_system(spark, path).getUri(), spark.sparkContext._jsc.hadoopConfiguration())
    try:
        files.rename(_at(spark, draft), _at(spark, final), spark.sparkContext._gateway.new_array(jvm.org.apache.hadoop.fs.Options.Rename, 0))
    except Py4JJavaError as e:
        delete(spark, draft)
        if "FileAlreadyExists" in str(e.java_exception) or exists(spark, final):
            raise Conflict(f"{path}: version {version} exists") from e
        raise
    return version


def read_parts(spark: SparkSession, path: str, table: str, parts: dict[str, str], schema: str) -> DataFrame:
    """Rows of the parts (folder names such as bucket=1/year=2001, each with the commit that wrote it), with a column commit and one for each level; schema
    names them all. Files that are damaged or gone count as empty."""
    folders = [f"{path}/{table}/commit={commit}/{part}" for part, commit in sorted(parts.items())]
    if not folders:
        return spark.createDataFrame([], schema)
    return spark.read.schema(schema).option("basePath", f"{path}/{table}").option("ignoreCorruptFiles", True).option("ignoreMissingFiles", True).parquet(*folders)


def _parts(df: DataFrame, by: list[str]) -> set[str]:
    return {"/".join(f"{c}={r[c]}" for c in by) for r in df.select(*by).distinct().collect()}  # as many as there are parts


def rewrite_parts(fresh: DataFrame, path: str, table: str, parts: dict[str, str], by: list[str], schema: str, merge: Callable[[DataFrame, DataFrame], DataFrame], wider: Callable[[set[str]], set[str]] = set) -> tuple[dict[str, str], DataFrame, str]:
    """Merges fresh, a table that holds still, with the parts that it touches (wider: more parts that have to be written anew), as new folders beside
    the old ones. The parts as they are to be named by the next manifest, the rows written, and the commit's name.

    Parts that are large are dealt by code to several tasks and so have several files: the number of parts is fixed when the store is made, its rows aren't."""
    spark, name = fresh.sparkSession, uuid.uuid4().hex
    touched = _parts(fresh, by)
    touched |= wider(touched) & set(parts)
    kept = read_parts(spark, path, table, {p: c for p, c in parts.items() if p in touched}, schema).drop("commit")
    out = f"{path}/{table}/commit={name}"
    stored = sum(size(spark, unquote(folder)) for folder in {f.rsplit("/", 1)[0] for f in (*fresh.inputFiles(), *kept.inputFiles())})
    shares = -(-stored // (SHARE_BYTES * max(len(touched), 1)))
    share = F.pmod(F.hash(F.lit("share"), F.col("code")), F.lit(max(shares, 1)))  # a code's rows of a part stay in one file
    rows = merge(kept, fresh)
    dealt = rows.repartition(len(touched) * shares, *by, share) if shares > 1 else rows.repartition(*by)
    dealt.sortWithinPartitions(*by, "code", "date").write.partitionBy(*by).parquet(out)
    written = spark.read.schema(", ".join(f for f in schema.split(", ") if not f.startswith("commit "))).parquet(out)
    return {p: c for p, c in parts.items() if p not in touched} | dict.fromkeys(_parts(written, by), name), written, name
