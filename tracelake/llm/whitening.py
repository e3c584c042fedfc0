"""Whitening of embeddings by a distributed singular value decomposition.

Components of a vector become integers, floor(1024 * component) + 100000, so
sums over all rows and every row's deviation from them are exact. Rows are
centred by those sums and handed to MLlib's RowMatrix.computeSVD; a singular
value s of the centred rows is the square root of n times an eigenvalue of the
covariance with divisor n, so eigenvalues are s * s / n. The total variance comes
from the exact deviations, not from the singular values. Nothing is shuffled but
sums; the driver holds numbers by dimension only, never by row.

Defined cases: vectors that are null or hold null, non-finite or entries of
2**52 and more in size (their integers would not fit a long) take no part, nor do vectors of another length than most
have (of equally frequent lengths the larger); components with no variance
(eigenvalues that can't be told from rounding errors of the largest) cannot be scaled and are not
returned, so equal vectors, a single one and an empty table give no rows.
Repeated ids and vectors are rows of their own. Deviations beyond a long are null
in the query. All columns of the caller pass through transform(); one with the
name of the result is replaced.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass
from decimal import Decimal

import numpy as np
import pyarrow as pa
from pyspark.ml.functions import array_to_vector
from pyspark.mllib.linalg.distributed import RowMatrix
from pyspark.mllib.util import MLUtils
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tracelake.llm.common import small_batches, table, tidy

SCALE, SHIFT, MOST = 1024, 100_000, float(1 << 52)
COMPONENTS, LOW = 8, 31
#: Eigenvalues of so little beside the largest, times the dimensions, are rounding errors.
ROUNDING = 2.0**-50


def grid(vector: Column) -> Column:
    """The integers of a vector."""
    return F.transform(vector, lambda c: F.floor(F.lit(float(SCALE)) * c.cast("double")) + F.lit(SHIFT))


def usable(vector: Column) -> Column:
    return vector.isNotNull() & F.forall(vector, lambda c: F.coalesce(F.abs(c.cast("double")) < MOST, F.lit(False)))


@dataclass(frozen=True)
class Whitening:
    """What fit() learned: n rows of so many dimensions, their sums, components as columns, eigenvalues, and the exact sum of all deviations."""

    n: int
    sums: np.ndarray
    components: np.ndarray
    values: np.ndarray
    deviations: int

    @property
    def trace(self) -> float:
        """The total variance: sum of (n * x - S)**2 / n**3 over all rows and dimensions."""
        return float(Decimal(self.deviations) / Decimal(self.n) ** 3) if self.n else 0.0

    @property
    def explained(self) -> np.ndarray:
        return self.values / self.trace if len(self.values) else self.values


def prepared(rows: DataFrame, vector: str) -> tuple[DataFrame, int]:
    """The rows that take part, with their integers in __x, and their number of dimensions."""
    good = rows.where(usable(F.col(vector)))
    lengths = good.groupBy(F.size(vector).alias("d")).agg(F.count("*").alias("n")).agg(F.max_by("d", F.struct("n", "d"))).first()[0]
    d = lengths or 0
    return good.where(F.size(vector) == d).withColumn("__x", grid(F.col(vector))), d


def exact(n: int, sums: np.ndarray):
    """A mapInArrow function from integers __x to (deviation, centred): the exact sum of (n * x - S)**2 and (n * x - S) / n."""

    def of(x: pa.Array) -> tuple[list[int], np.ndarray]:
        values = x.values.to_numpy(zero_copy_only=False)[x.offsets[0].as_py() : x.offsets[-1].as_py()].reshape(len(x), len(sums))
        most = n * int(np.abs(values).max(initial=0)) + int(np.abs(sums).max(initial=0))
        if most * most * len(sums) >= 1 << 63:  # beyond a long: Python's integers
            apart = n * values.astype(object) - sums.astype(object)
            return [int((row * row).sum()) for row in apart], (apart / n).astype(np.float64)
        apart = n * values - sums
        return (apart * apart).sum(axis=1).tolist(), apart / n

    return of


def fit(rows: DataFrame, vector: str = "embedding", most: int = COMPONENTS) -> Whitening:
    """Learns components from all rows that take part."""
    good, d = prepared(rows, vector)
    none = Whitening(0, np.zeros(d, np.int64), np.zeros((d, 0)), np.zeros(0), 0)
    if not d:
        return none
    # Two sums a dimension, of high and low bits, so that none leaves a long.
    x = [F.col("__x")[i] for i in range(d)]
    n, *halves = good.agg(F.count("*"), *[F.sum(F.shiftright(v, LOW)) for v in x], *[F.sum(v.bitwiseAND((1 << LOW) - 1)) for v in x]).first()
    whole = [(high << LOW) + low for high, low in zip(halves[:d], halves[d:], strict=True)]
    sums = np.array(whole, np.int64 if max(map(abs, whole)) < 1 << 62 else object)
    of = exact(n, sums)

    def centred(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            deviation, apart = of(batch.column(0))
            lists = pa.ListArray.from_arrays(pa.array(np.arange(0, apart.size + 1, d, dtype=np.int32)), pa.array(apart.ravel()))
            yield pa.RecordBatch.from_arrays([pa.array([Decimal(v) for v in deviation], pa.decimal128(38, 0)), lists], names=["deviation", "centred"])

    small_batches(rows.sparkSession)
    apart = good.select("__x").mapInArrow(tidy(centred), "deviation decimal(38,0), centred array<double>")
    total = int(apart.agg(F.coalesce(F.sum("deviation"), F.lit(0).cast("decimal(38,0)"))).first()[0])
    if not total:
        return Whitening(n, sums, none.components, none.values, 0)
    vectors = MLUtils.convertVectorColumnsFromML(apart.select(array_to_vector("centred").alias("v")), "v")
    # All components are asked for: then the decomposition is exact, not iterative.
    found = RowMatrix(vectors, n, d).computeSVD(d, rCond=math.sqrt(d * ROUNDING))
    values = found.s.toArray()
    return Whitening(n, sums, found.V.toArray()[:, :most], (values * values / n)[:most], total)


def transform(rows: DataFrame, model: Whitening, vector: str = "embedding", result: str = "whitening") -> DataFrame:
    """The rows that take part, with a struct of deviation (decimal) and whitened (array of doubles, by component)."""
    kept = rows.drop(result)
    good = kept.where(usable(F.col(vector)) & (F.size(vector) == len(model.sums)))
    schema = T.StructType([*kept.schema.fields, T.StructField(result, T.StructType.fromDDL("deviation decimal(38,0), whitened array<double>"))])
    of, names, turn = exact(model.n, model.sums), schema.names, model.components / np.sqrt(model.values)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            deviation, apart = of(batch.column(batch.num_columns - 1))
            white = apart @ turn
            lists = pa.ListArray.from_arrays(pa.array(np.arange(batch.num_rows + 1, dtype=np.int32) * turn.shape[1]), pa.array(white.ravel()))
            both = pa.StructArray.from_arrays([pa.array([Decimal(v) for v in deviation], pa.decimal128(38, 0)), lists], names=["deviation", "whitened"])
            yield pa.RecordBatch.from_arrays([*batch.columns[:-1], both], names=names)

    small_batches(rows.sparkSession)
    return good.select("*", grid(F.col(vector)).alias("__x")).mapInArrow(tidy(run), schema)


def identity_error(whitened: DataFrame, column: str, k: int) -> float:
    """The largest entry, in size, of the covariance of whitened rows (divisor their number) minus the identity."""
    pairs = [(i, j) for i in range(k) for j in range(i, k)]
    w = F.col(column)
    found = whitened.agg(*[F.covar_pop(w[i], w[j]) for i, j in pairs]).first() if pairs else []
    return max((abs(c - (i == j)) for c, (i, j) in zip(found, pairs, strict=True)), default=0.0)


def op13_whitening(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Whitened values of every vector by component, with what its component explains."""
    rows = table(spark, sf_dir, "embeddings").select("vec_id", "embedding")
    model = fit(rows)
    white = transform(rows, model).select("vec_id", "whitening.*")
    k = len(model.values)
    error = identity_error(white, "whitened", k)
    explained = F.array(*[F.lit(float(v)) for v in model.explained]).cast("array<double>")
    each = white.select("vec_id", "deviation", F.posexplode("whitened").alias("at", "whitened"))
    return each.select(
        "vec_id", (F.col("at") + 1).alias("component"), F.lit(model.n).cast("long").alias("n"), F.col("deviation").try_cast("long").alias("deviation"), "whitened",
        explained[F.col("at")].alias("explained"), F.lit(error).alias("identity_error"),
    )
