"""Whitening of embeddings: projection on principal components, scaled to variance one.

Entries are quantised to whole numbers, floor(256 * c). The fit list holds each distinct quantised vector once;
it is written to the shared folder, as every pass reads it again. Components come from a randomised range
finder: a random orthonormal basis of k + ``oversample`` columns goes through power passes, each an aggregation
over all centred rows (rows are centred first, then multiplied) to a matrix of dimensions x columns. Each pass
gives Ritz values and vectors of the basis (Rayleigh-Ritz). Where the residuals of the first k are not at
rounding level, against the gap to the next value, after ``passes`` passes, the basis is completed to all
dimensions, where one pass more is exact. What comes to the driver depends on the dimension alone: at most
dimension^2 sums, so dimensions of some thousands are within bounds.

Counts, sums and deviations are exact whole numbers.

Defined cases: vectors that are null or hold null or non-finite entries are dropped; shorter vectors count as
filled up with zeros to the longest length; entries beyond the range of a long are held at its ends; repeated
vectors count once in the fit and have rows of their own in the result; a component without variance
(fewer distinct vectors than components) has null for whitened, and explained is null where nothing varies
at all; identity_error is over the components with variance; a deviation beyond the range of a long is null;
with fewer dimensions than k there are as many components as dimensions; an empty table gives an empty
result; extra columns are carried along by ``whitened`` and ignored by ``component_rows``.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from hypolake.llm.common import written

SCALE, COMPONENTS, OVERSAMPLE, PASSES = 256, 4, 8, 6
#: Largest residual of a component, against the gap between its value and the nearest other.
RESIDUAL = 1e-12


def is_sound(vector: Column) -> Column:
    """Neither null nor with an entry that is null or not finite."""
    bad = lambda v: v.isNull() | F.isnan(v) | (F.abs(v) == float("inf"))
    return vector.isNotNull() & ~F.coalesce(F.exists(vector, bad), F.lit(False))


def quantised(vector: Column, dimension: int) -> Column:
    """floor(256 * c) of every entry, filled up with zeros to the dimension."""
    whole = F.transform(vector, lambda v: F.floor(v.cast("double") * SCALE).cast("long"))
    return F.concat(whole, F.array_repeat(F.lit(0).cast("long"), F.greatest(F.lit(0), dimension - F.size(whole))))


def _matrix(column: pa.Array) -> np.ndarray:
    """Rows of a list column, all of one length."""
    values = column.flatten().to_numpy(zero_copy_only=False)
    return values.reshape(len(column), -1) if len(column) else values.reshape(0, 0)


def exact_sums(fit_list: DataFrame, dimension: int) -> tuple[int, list[int]]:
    """Number of vectors and sum of each dimension. Tasks add up the halves of 64 bits, so that nothing overflows."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        high, low = np.zeros(dimension + 1, np.int64), np.zeros(dimension + 1, np.int64)
        for batch in batches:
            x = _matrix(batch.column(0))
            if len(x):
                high[:-1] += (x >> 32).sum(axis=0)
                low[:-1] += (x & 0xFFFFFFFF).sum(axis=0)
                low[-1] += len(x)
        yield pa.RecordBatch.from_arrays([pa.array(range(dimension + 1), pa.int32()), pa.array(high), pa.array(low)], ["i", "high", "low"])

    total = lambda c: F.sum(F.col(c).cast("decimal(20,0)"))
    rows = fit_list.mapInArrow(run, "i int, high long, low long").groupBy("i").agg(total("high"), total("low")).collect()
    sums = [0] * (dimension + 1)
    for i, high, low in rows:
        sums[i] = (int(high) << 32) + int(low)
    return sums[-1], sums[:-1]


def covariance_times(fit_list: DataFrame, mean: np.ndarray, n: int, basis: np.ndarray) -> tuple[np.ndarray, float]:
    """Covariance matrix times the basis, and its trace, by one pass over all centred rows."""
    d, columns = basis.shape

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        product, trace = np.zeros((d, columns)), 0.0
        for batch in batches:
            x = _matrix(batch.column(0))
            if len(x):
                centred = x - mean
                product += centred.T @ (centred @ basis)
                trace += float((centred * centred).sum())
        cells = np.append(product.ravel(), trace) / n
        yield pa.RecordBatch.from_arrays([pa.array(range(len(cells)), pa.int32()), pa.array(cells)], ["cell", "v"])

    sums = fit_list.mapInArrow(run, "cell int, v double").groupBy("cell").agg(F.sum("v").alias("v")).toArrow()
    cells = np.zeros(d * columns + 1)
    cells[sums["cell"].to_numpy()] = sums["v"].to_numpy()
    return cells[:-1].reshape(d, columns), float(cells[-1])


def rayleigh_ritz(basis: np.ndarray, product: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Ritz values, falling, their unit vectors and the lengths of their residuals, from covariance * basis."""
    small = basis.T @ product
    values, turn = np.linalg.eigh((small + small.T) / 2)
    values, turn = values[::-1], turn[:, ::-1]
    vectors = basis @ turn
    residuals = np.linalg.norm(product @ turn - vectors * values, axis=0)
    return values, vectors / np.linalg.norm(vectors, axis=0), residuals


def has_converged(values: np.ndarray, residuals: np.ndarray, k: int) -> bool:
    gaps = np.abs(values[:, None] - values[None, :]) + np.where(np.eye(len(values)), np.inf, 0)
    return bool((residuals[:k] <= RESIDUAL * gaps.min(axis=1)[:k]).all())


def principal_components(
    fit_list: DataFrame, mean: np.ndarray, n: int, k: int, oversample: int = OVERSAMPLE, passes: int = PASSES, seed: int = 11
) -> tuple[np.ndarray, np.ndarray, float, int]:
    """Largest k eigenvalues of the covariance, their vectors as columns, its trace, and the columns of the last basis."""
    d, rng = len(mean), np.random.default_rng(seed)
    basis = np.linalg.qr(rng.normal(size=(d, min(d, k + oversample))))[0]
    for _ in range(passes + 1):
        product, trace = covariance_times(fit_list, mean, n, basis)
        values, vectors, residuals = rayleigh_ritz(basis, product)
        if basis.shape[1] == d or has_converged(values, residuals, k):
            return values[:k], vectors[:, :k], trace, basis.shape[1]
        basis = np.linalg.qr(product)[0]
    basis = np.linalg.qr(np.hstack([basis, rng.normal(size=(d, d - basis.shape[1]))]))[0]
    product, trace = covariance_times(fit_list, mean, n, basis)
    values, vectors, _ = rayleigh_ritz(basis, product)
    return values[:k], vectors[:, :k], trace, d


@dataclass
class Model:
    """Of the fit list: number of vectors and sums by dimension, both exact; eigenvalues (falling), components as columns."""

    n: int
    sums: list[int]
    values: np.ndarray
    vectors: np.ndarray
    trace: float
    identity_error: float | None = None
    columns: int = 0

    @property
    def mean(self) -> np.ndarray:
        return np.array([s / self.n for s in self.sums])

    @property
    def varied(self) -> np.ndarray:
        """Whether a component has variance beyond rounding."""
        return self.values > 10 * max(1, len(self.sums)) * np.finfo(float).eps * max(self.values, default=0.0)

    def whitening(self) -> np.ndarray:
        """What centred rows are multiplied with; columns of components without variance are NaN."""
        return self.vectors / np.sqrt(np.where(self.varied, self.values, np.nan))

    def deviations(self, x: np.ndarray) -> list[int | None]:
        """Sum over the dimensions of (n * x - S)^2, exactly: in machine words where all of it fits, else in Python's integers."""
        reach = max((abs(self.n * float(np.abs(x.astype(float)).max(initial=0))) + abs(s) for s in self.sums), default=0.0)
        if len(self.sums) * reach * reach < 2.0**62:
            return ((self.n * x - np.array(self.sums, np.int64)) ** 2).sum(axis=1).tolist()
        sums = [int(s) for s in self.sums]
        exact = [sum((self.n * v - s) ** 2 for v, s in zip(row, sums)) for row in x.tolist()]
        return [e if e < 2**63 else None for e in exact]


def fit(df: DataFrame, vector_col: str = "embedding", k: int = COMPONENTS, oversample: int = OVERSAMPLE, passes: int = PASSES) -> Model:
    """Model of the distinct quantised vectors of df."""
    rows = df.where(is_sound(F.col(vector_col)))
    d = rows.agg(F.max(F.size(vector_col))).first()[0] or 0
    if not d:
        return Model(0, [], np.zeros(0), np.zeros((0, 0)), 0.0)
    fit_list = written(rows.select(quantised(F.col(vector_col), d).alias("x")).distinct())
    n, sums = exact_sums(fit_list, d)
    model = Model(n, sums, np.zeros(0), np.zeros((d, 0)), 0.0)
    mean, k = model.mean, min(k, d)
    model.values, model.vectors, model.trace, model.columns = principal_components(fit_list, mean, n, k, oversample, passes)
    scaled = model.whitening()[:, model.varied]
    if scaled.shape[1]:
        product, _ = covariance_times(fit_list, mean, n, scaled)
        model.identity_error = float(np.abs(scaled.T @ product - np.eye(scaled.shape[1])).max())
    return model


def whitened(df: DataFrame, model: Model, vector_col: str = "embedding") -> DataFrame:
    """df's rows with sound vectors, with deviation and whitened (a value for each component; null: no variance)."""
    dimension, mean, matrix = len(model.sums), model.mean if model.n else np.zeros(0), model.whitening()

    @F.pandas_udf("deviation long, whitened array<double>")
    def projected(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        for vectors in batches:
            x = np.stack(vectors.to_list()).astype(np.int64) if len(vectors) else np.zeros((0, dimension), np.int64)
            found = (x - mean) @ matrix
            rows = [[None if math.isnan(v) else v for v in row] for row in found.tolist()]
            yield pd.DataFrame({"deviation": pd.Series(model.deviations(x), dtype="Int64"), "whitened": pd.Series(rows, dtype=object)})

    rest = [F.col(f"`{c}`") for c in df.columns if c.lower() not in ("deviation", "whitened")]
    rows = df.where(is_sound(F.col(vector_col))).select(*rest, projected(quantised(F.col(vector_col), dimension)).alias("__white"))
    return rows.select(*rest, F.col("__white.deviation").alias("deviation"), F.col("__white.whitened").alias("whitened"))


def component_rows(df: DataFrame, model: Model, id_col: str = "vec_id", vector_col: str = "embedding") -> DataFrame:
    """A row for each sound vector and component, from 1: deviation, whitened, and the component's share of variance."""
    rows = whitened(df.select(id_col, vector_col), model, vector_col)
    shares = [float(v / model.trace) if model.trace > 0 else None for v in model.values]
    explained = F.array(*[F.lit(s).cast("double") for s in shares]).cast("array<double>")
    out = rows.select(id_col, "deviation", F.posexplode("whitened").alias("place", "whitened"))
    return out.select(
        id_col, (F.col("place") + 1).cast("int").alias("component"), F.lit(model.n).cast("long").alias("n"), "deviation", "whitened",
        F.get(explained, F.col("place")).alias("explained"), F.lit(model.identity_error).cast("double").alias("identity_error"),
    )
