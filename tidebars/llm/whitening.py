"""Whitening of embedding tables by MLlib's distributed block matrices."""

from __future__ import annotations

from collections.abc import Iterator
from decimal import Decimal
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.mllib.common import callMLlibFunc
from pyspark.mllib.linalg import Matrices
from pyspark.mllib.linalg.distributed import BlockMatrix, IndexedRowMatrix
from pyspark.mllib.util import MLUtils
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import as_table, scratch_tables

LEAST_ROWS, MOST_BLOCKS = 512, 1 << 14  # rows of a block at least; blocks of rows at most, for the driver plans by their numbers
MATRIX_ROWS = 1 << 30  # rows of one block matrix: Spark numbers a matrix's rows by 32-bit integers when it turns blocks into rows
LARGEST = float(1 << 40)  # entries further out than this (scaled) can't be squared exactly
FLAT = 1e-12  # a component with less than this share of the whole variance is rounding, and can't be scaled to one


def finite(v: Column, scale: float) -> Column:
    """Neither null nor empty, all entries finite numbers that fit into whole numbers when scaled."""
    return F.coalesce((F.size(v) > 0) & F.forall(v, lambda c: F.coalesce(~F.isnan(c) & (F.abs(c.cast("double")) < LARGEST / scale), F.lit(False))), F.lit(False))


def _totals(rows: DataFrame) -> tuple[list[int], list[int], list[int]]:
    """Each dimension's sum, least and greatest entry: a row a task and dimension, summed by Spark."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = low = high = None
        for batch in batches:
            if batch.num_rows:
                x = batch.column("x").flatten().to_numpy().reshape(batch.num_rows, -1)
                a, b, c = x.sum(0), x.min(0), x.max(0)
                total, low, high = (a, b, c) if total is None else (total + a, np.minimum(low, b), np.maximum(high, c))
        if total is not None:
            yield pa.RecordBatch.from_arrays([pa.array(np.arange(len(total)), pa.int32()), pa.array(total), pa.array(low), pa.array(high)], ["i", "total", "low", "high"])

    parts = rows.select("x").mapInArrow(run, "i int, total long, low long, high long")
    sums = sorted(parts.groupBy("i").agg(F.sum("total").alias("total"), F.min("low").alias("low"), F.max("high").alias("high")).collect())  # as many rows as dimensions
    return [r["total"] for r in sums], [r["low"] for r in sums], [r["high"] for r in sums]


def _multiply(a: BlockMatrix, b: BlockMatrix, splits: int) -> BlockMatrix:
    """a times b, with the inner dimension dealt to so many tasks, whose products are summed: else all blocks meet in the task of the one block of the result."""
    return BlockMatrix(a._java_matrix_wrapper.call("multiply", b._java_matrix_wrapper._java_model, splits), a.rowsPerBlock, b.colsPerBlock)


def _gram(m: BlockMatrix) -> np.ndarray:
    """The matrix's transpose times itself, as large as its columns are many."""
    return _multiply(m.transpose(), m, max(1, -(-m.numRowBlocks // 4))).toLocalMatrix().toArray()


def components(covariance: np.ndarray, most: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Eigenvalues by size, those above rounding and `most` at most; their unit vectors as columns, the entry furthest from
    zero positive; and their shares of the trace."""
    values, vectors = np.linalg.eigh((covariance + covariance.T) / 2)
    values, vectors = values[::-1], vectors[:, ::-1]
    trace = float(np.trace(covariance))
    k = int((values[:most] > FLAT * trace).sum())
    vectors = vectors[:, :k] * np.sign(vectors[np.abs(vectors[:, :k]).argmax(0), np.arange(k)])
    return values[:k], vectors, values[:k] / trace if k else values[:0]


def whiten(vectors: DataFrame, most: int = 32, scale: float = 64.0, shift: int = 1_000_000, id_col: str = "vec_id", vector_col: str = "embedding", matrix_rows: int = MATRIX_ROWS) -> DataFrame:
    """(vec_id, x, whitened, n, deviation, explained, identity_error) for every usable row: x, its entries as whole numbers
    floor(scale * c) + shift; whitened, its projections on the `most` first components of the table's covariance, each over the root
    of its eigenvalue; deviation, the exact sum of (n * x - sum)**2 as a decimal(38, 0); explained, the components' shares of the variance;
    identity_error, how far the covariance of whitened is from the identity at most.

    1. Entries become whole numbers in a written table; their sums are exact, and so is n * x - sum, of which a centred entry is the n-th part.
    2. Centred rows are indexed by their place in the table and become a BlockMatrix. Its transpose times itself, over n, is the covariance.
    3. The driver decomposes that matrix, whose size follows the number of dimensions alone.
    4. The BlockMatrix times the whitening matrix, of one block, projects the rows; the product's own transpose product gives identity_error.

    Blocks grow with the table, so that the driver plans MOST_BLOCKS of them and a block for each partition at most; tables of more than
    matrix_rows rows are several matrices, whose scatters add up. No block spans two partitions of the table.

    Null vectors, empty ones, and those with null, non-finite or huge entries (2**40 and beyond, scaled) have no row, and neither have vectors
    of another length than most have (of equally frequent lengths the largest counts). Null ids and repeated rows are rows of their own. Components
    whose variance is rounding (constant or repeated dimensions) are left out, so whitened may have fewer entries, or none (one row, or
    equal rows). An empty table gives an empty one. Other columns are not read."""
    spark = vectors.sparkSession
    with scratch_tables(spark):
        entry = lambda c: F.floor(c.cast("double") * scale).cast("long") + shift
        own = vectors.select(F.col(id_col).cast("long").alias("vec_id"), F.col(vector_col).alias("v")).where(finite(F.col("v"), scale))
        dim = own.groupBy(F.size("v").alias("dim")).count().orderBy(F.col("count").desc(), F.col("dim").desc()).first()
        if dim is None:
            return spark.createDataFrame([], "vec_id long, x array<long>, whitened array<double>, n long, deviation decimal(38,0), explained array<double>, identity_error double")
        rows = as_table(own.where(F.size("v") == dim["dim"]).select("vec_id", F.transform("v", entry).alias("x")).withColumn("at", F.monotonically_increasing_id()), "entries", keep=True)
        return _whitened(spark, rows, most, matrix_rows)


def _whitened(spark: SparkSession, rows: DataFrame, most: int, matrix_rows: int) -> DataFrame:
    place = F.expr("at & 8589934591")  # the lower 33 bits; the upper ones are the number of the partition that wrote the row
    n, longest = rows.agg(F.count("*"), F.max(place)).first()
    sums, low, high = _totals(rows)
    block = max(LEAST_ROWS, -(-n // MOST_BLOCKS))
    stride = -(-(longest + 1) // block) * block
    together = max(1, matrix_rows // stride)  # partitions in a matrix
    part = F.shiftright("at", 33)
    rows = rows.withColumns({"matrix": F.floor(part / together).cast("int"), "index": (part % together) * stride + place})
    differ = F.zip_with("x", F.lit(sums), lambda x, s: x * n - s)
    centred = rows.select("matrix", "index", array_to_vector(F.transform(differ, lambda d: d.cast("double") / n)).alias("vector"))
    dims, parts = len(sums), [r["matrix"] for r in rows.select("matrix").distinct().sort("matrix").collect()]
    matrices = [IndexedRowMatrix(MLUtils.convertVectorColumnsFromML(centred.where(F.col("matrix") == m).select("index", "vector"), "vector"), 0, dims).toBlockMatrix(block, dims) for m in parts]

    values, axes, share = components(sum(map(_gram, matrices)) / n, most)
    k = len(values)
    product, error = spark.createDataFrame([], "matrix int, index long, whitened array<double>"), 0.0
    if k:
        scaler = BlockMatrix(spark.sparkContext.parallelize([((0, 0), Matrices.dense(dims, k, (axes / np.sqrt(values)).ravel("F")))], 1), dims, k)
        whitened = [m.multiply(scaler) for m in matrices]
        row = lambda y: callMLlibFunc("getIndexedRows", y.toIndexedRowMatrix()._java_matrix_wrapper._java_model)
        product = reduce(DataFrame.unionByName, (row(y).select(F.lit(m).alias("matrix"), F.col("index"), vector_to_array("vector").alias("whitened")) for m, y in zip(parts, whitened, strict=True)))
        product = as_table(product, "whitened", keep=True)
        error = float(np.abs(sum(map(_gram, whitened)) / n - np.eye(k)).max())

    fits = dims * max(max(abs(n * a - s), abs(n * b - s)) for a, b, s in zip(low, high, sums, strict=True)) ** 2 < 1 << 63
    kind = T.LongType() if fits else T.DecimalType(38, 0)
    deviation = F.aggregate(differ, F.lit(0 if fits else Decimal(0)).cast(kind), lambda total, d: (total + d.cast(kind) * d.cast(kind)).cast(kind)).cast("decimal(38,0)")
    out = rows.join(product, ["matrix", "index"], "left").select("vec_id", "x", F.coalesce("whitened", F.array().cast("array<double>")).alias("whitened"), F.lit(n).cast("long").alias("n"), deviation.alias("deviation"))
    return out.withColumns({"explained": F.lit(share.tolist()).cast("array<double>") if k else F.array().cast("array<double>"), "identity_error": F.lit(error)})


def by_component(rows: DataFrame) -> DataFrame:
    """whiten's rows, one a row and component: vec_id, component from 1, n, deviation as a long (an error where it doesn't fit), whitened, explained, identity_error."""
    each = rows.select("vec_id", F.posexplode(F.arrays_zip("whitened", "explained")).alias("at", "both"), "n", F.col("deviation").cast("long").alias("deviation"), "identity_error")
    return each.select("vec_id", (F.col("at") + 1).alias("component"), "n", "deviation", F.col("both.whitened").alias("whitened"), F.col("both.explained").alias("explained"), "identity_error")
