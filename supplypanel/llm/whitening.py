"""Embedding whitening with MLlib's BlockMatrix.

Entries become whole numbers ``x``; their sums per dimension, and how far a row lies from the
mean (``n x - S``, whole numbers too), are exact. Rows are numbered, centred, and indexed into
a distributed ``BlockMatrix``. Its transpose times itself is the scatter; a local ``eigh`` of
that matrix, which has the size of a vector squared, gives the whitening matrix; the blocks
times this matrix are the projected rows. The scatter of the projected rows, again by blocks,
gives the error reported.

Vectors that are null or hold null, NaN or infinite entries are dropped, and so are those
shorter than the longest one, empty ones included: what they lack counts as null. An entry
whose ``x`` does not fit a long fails the job. Repeated rows count each; a null ``vec_id`` is
returned as it is. ``deviation`` is NULL where it does not fit a long. Components with no
variance beyond rounding, and all where every vector is the same, are not returned. An empty
table gives an empty result. Other columns of the input are not read.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyspark.sql.functions as F
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.mllib.common import callMLlibFunc
from pyspark.mllib.linalg import Matrices
from pyspark.mllib.linalg.distributed import BlockMatrix, IndexedRowMatrix
from pyspark.mllib.util import MLUtils
from pyspark.sql import DataFrame, SparkSession, Window

from .common import drop_folder, table, written

# How entries become whole numbers.
FACTOR, SHIFT = 1024, 100_000
COMPONENTS = 8
# Rows of a block, and how many blocks one task multiplies at most.
BLOCK_ROWS = 2048
TASK_BLOCKS = 32
LARGEST = 2.0**52
# Variances below this share of the largest are rounding.
ROUNDING = 1e-13


def whole_numbers(vectors: DataFrame, column: str, size: int) -> DataFrame:
    """``vec_id``, ``x`` and ``place`` (task and row in it) of the vectors that can be fitted."""

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            vectors = batch.column(1)
            # lists without nulls and of full length, then those with finite entries only
            flat = vectors.flatten()
            length = vectors.value_lengths().fill_null(0).to_numpy(zero_copy_only=False)
            bad = np.concatenate([[0], np.cumsum(flat.is_null().to_numpy(zero_copy_only=False))])
            ends = np.concatenate([[0], np.cumsum(length)])
            whole = (length == size) & (bad[ends[1:]] == bad[ends[:-1]])
            kept = pa.array(whole)
            values = vectors.filter(kept).flatten().cast(pa.float64()).to_numpy(zero_copy_only=False)
            values = values.reshape(-1, size)
            finite = np.isfinite(values).all(axis=1)
            values = np.floor(values[finite] * FACTOR)
            if len(values) and np.abs(values).max() > LARGEST:
                raise ValueError("an entry is too large for a whole number")
            x = values.astype(np.int64) + SHIFT
            at = np.arange(len(x) + 1, dtype=np.int32) * size
            yield pa.RecordBatch.from_arrays(
                [
                    batch.column(0).filter(kept).filter(pa.array(finite)),
                    pa.ListArray.from_arrays(pa.array(at, pa.int32()), pa.array(x.ravel(), pa.int64())),
                ],
                names=["vec_id", "x"],
            )

    kind = vectors.select("vec_id").schema["vec_id"].dataType.simpleString()
    found = vectors.select("vec_id", column).mapInArrow(rows, f"vec_id {kind}, x array<bigint>")
    return found.withColumn("place", F.monotonically_increasing_id())


def sums(rows: DataFrame, size: int) -> tuple[int, list[int]]:
    """The number of rows and the sum of each dimension, exact: a partial sum of a batch fits
    a long, these are added as decimals."""

    def partial(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            x = batch.column(0).flatten().to_numpy(zero_copy_only=False).reshape(-1, size)
            for begin in range(0, len(x), 512):  # 2^9 numbers below 2^53
                part = x[begin : begin + 512]
                yield pa.RecordBatch.from_arrays(
                    [
                        pa.array(np.full(size, len(part), dtype=np.int64)),
                        pa.array(np.arange(size, dtype=np.int32)),
                        pa.array(part.sum(axis=0)),
                    ],
                    names=["n", "dimension", "total"],
                )

    found = rows.select("x").mapInArrow(partial, "n bigint, dimension int, total bigint")
    total = F.sum(F.col("total").cast("decimal(19,0)"))
    out = found.groupBy("dimension").agg(F.sum("n").alias("n"), total.alias("s")).collect()
    by_dimension = {r["dimension"]: r for r in out}
    if not out:
        return 0, []
    return out[0]["n"], [int(by_dimension[k]["s"]) for k in range(size)]


def centred(rows: DataFrame, n: int, s: list[int]) -> DataFrame:
    """``row`` (from 0, without gaps), ``vec_id``, ``deviation`` and ``centred``."""
    size = len(s)
    own = rows.select(F.shiftright("place", 33).alias("task"), "place")
    counts = own.groupBy("task").agg(F.count("*").alias("rows"))
    # one row for each task
    before = F.sum("rows").over(Window.orderBy("task").rowsBetween(Window.unboundedPreceding, -1))
    starts = counts.select(
        F.col("task").alias("_task"), F.coalesce(before, F.lit(0)).alias("start")
    )

    def distances(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.array(s, dtype=object)
        fits = n * (LARGEST + SHIFT) < 2**62
        for batch in batches:
            x = batch.column(2).flatten().to_numpy(zero_copy_only=False).reshape(-1, size)
            fast = fits or n * int(np.abs(x).max(initial=0)) < 2**62
            off = x * np.int64(n) - total.astype(np.int64) if fast else x.astype(object) * n - total
            if fast and int(np.abs(off).max(initial=0)) ** 2 * size < 2**63:
                squares = pa.array((off * off).sum(axis=1))
            else:
                exact = [sum(int(v) ** 2 for v in row) for row in off]
                squares = pa.array([v if v < 2**63 else None for v in exact], type=pa.int64())
            shares = (off / n).astype(np.float64)
            at = np.arange(len(x) + 1, dtype=np.int32) * size
            yield pa.RecordBatch.from_arrays(
                [
                    batch.column(0),
                    batch.column(1),
                    squares,
                    pa.ListArray.from_arrays(pa.array(at, pa.int32()), pa.array(shares.ravel())),
                ],
                names=["row", "vec_id", "deviation", "centred"],
            )

    numbered = rows.withColumn("task", F.shiftright("place", 33)).join(
        starts, F.col("task") == F.col("_task")
    )
    in_task = F.col("place").bitwiseAND(F.lit((1 << 33) - 1))
    kind = rows.schema["vec_id"].dataType.simpleString()
    return numbered.select((F.col("start") + in_task).alias("row"), "vec_id", "x").mapInArrow(
        distances, f"row bigint, vec_id {kind}, deviation bigint, centred array<double>"
    )


def block_matrix(rows: DataFrame, column: str, n: int, size: int) -> BlockMatrix:
    """The vectors in ``column`` as blocks, by ``row``."""
    vectors = rows.select("row", array_to_vector(column).alias("vector"))
    vectors = MLUtils.convertVectorColumnsFromML(vectors, "vector")
    return IndexedRowMatrix(vectors, n, size).toBlockMatrix(BLOCK_ROWS, size)


def scatter(blocks: BlockMatrix, n: int, tasks: int) -> np.ndarray:
    """The transpose times the matrix, summed over as many tasks as keep few blocks each."""
    count = -(-n // BLOCK_ROWS)
    parts = max(min(count, tasks), -(-count // TASK_BLOCKS))
    own = blocks._java_matrix_wrapper
    product = blocks.transpose()._java_matrix_wrapper.call("multiply", own._java_model, parts)
    size = blocks.colsPerBlock
    return BlockMatrix(product, size, size).toLocalMatrix().toArray()


def projected(spark: SparkSession, blocks: BlockMatrix, matrix: np.ndarray) -> BlockMatrix:
    """The rows times a small matrix."""
    size, k = matrix.shape
    local = Matrices.dense(size, k, matrix.ravel(order="F"))
    right = BlockMatrix(spark.sparkContext.parallelize([((0, 0), local)], 1), size, k, size, k)
    return blocks.multiply(right)


def whitening_matrix(covariance: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """The leading eigenvectors, each over the root of its eigenvalue, and the eigenvalues."""
    values, vectors = np.linalg.eigh((covariance + covariance.T) / 2)
    values, vectors = values[::-1], vectors[:, ::-1]
    real = values > values[0] * ROUNDING if values[0] > 0 else np.zeros(len(values), dtype=bool)
    kept = min(k, int(real.sum()))
    return vectors[:, :kept] / np.sqrt(values[:kept]), values[:kept]


RESULT = (
    "component int, n bigint, deviation bigint, whitened double, explained double, "
    "identity_error double"
)


def whiten(vectors: DataFrame, column: str = "embedding", k: int = COMPONENTS) -> DataFrame:
    """One row per vector of ``vectors`` (``vec_id``, ``column``) and component: vec_id,
    component, n, deviation, whitened, explained, identity_error."""
    spark = vectors.sparkSession
    tasks = int(spark.conf.get("spark.sql.shuffle.partitions"))
    kind = vectors.schema["vec_id"].dataType.simpleString()
    own = vectors.select("vec_id", F.col(column).cast("array<double>").alias("_vector"))
    size = own.agg(F.max(F.size("_vector"))).first()[0] or 0
    empty = spark.createDataFrame([], f"vec_id {kind}, {RESULT}")
    if size <= 0:
        return empty
    rows, first = written(whole_numbers(own, "_vector", size), "whole-numbers")
    n, s = sums(rows, size)
    if n == 0:
        drop_folder(spark, first)
        return empty
    points, second = written(centred(rows, n, s), "centred")
    drop_folder(spark, first)
    blocks = block_matrix(points, "centred", n, size)
    covariance = scatter(blocks, n, tasks) / n
    matrix, values = whitening_matrix(covariance, k)
    if not len(values):
        drop_folder(spark, second)
        return empty
    white = projected(spark, blocks, matrix)
    # the columns are centred, as all rows are
    error = float(np.abs(scatter(white, n, tasks) / n - np.eye(len(values))).max())
    explained = (values / np.trace(covariance)).tolist()

    indexed = white._java_matrix_wrapper.call("toIndexedRowMatrix")
    scores = callMLlibFunc("getIndexedRows", indexed)
    scores = scores.select(F.col("index").alias("_row"), vector_to_array("vector").alias("white"))
    shares = F.array(*[F.lit(e) for e in explained])
    out = (
        points.select("row", "vec_id", "deviation")
        .join(scores, F.col("row") == F.col("_row"))
        .select("vec_id", "deviation", F.posexplode("white").alias("_at", "whitened"))
        .select(
            "vec_id",
            (F.col("_at") + 1).cast("int").alias("component"),
            F.lit(n).cast("long").alias("n"),
            "deviation",
            "whitened",
            F.get(shares, F.col("_at")).alias("explained"),
            F.lit(error).alias("identity_error"),
        )
    )
    done, _ = written(out, "whitened")
    drop_folder(spark, second)
    return done


def op11_embedding_whitening(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The whitened embeddings."""
    return whiten(table(spark, sf_dir, "embeddings"))
