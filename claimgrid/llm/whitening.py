"""Embedding whitening: projection on the leading components of the covariance, scaled to unit variance.

Embeddings become integers, floor(256 c). The fit list holds each different integer vector once, so that copies do not
pull the components. Sums are exact; the covariance is summed from vectors centred by the exact mean, in one matrix for
each task, and only its entries come to the driver (a bounded number: ``MAX_DIMENSIONS``). There Householder reflections
make the matrix tridiagonal, bisection on Sturm counts finds the leading eigenvalues, and inverse iteration their
vectors, orthogonalised anew within clusters of close eigenvalues. The components, a few thousand numbers, are
broadcast and every row is projected where it lies.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, DoubleType, LongType, StructField, StructType

from claimgrid.llm.tables import query, table, written

SCALE, COMPONENTS, MAX_DIMENSIONS = 256, 4, 4096
SAFE, LOW_BITS = 1 << 62, 32
CLUSTER = 1e-3  # eigenvalues closer than this part of the norm belong to one cluster


# ---- eigenvalues of a symmetric matrix ------------------------------------------------------------------------------

def tridiagonal(matrix: np.ndarray) -> tuple[np.ndarray, np.ndarray, list[np.ndarray]]:
    """Diagonal, the entries beside it, and the unit vector of each Householder reflection."""
    a = np.array(matrix, float)
    d = len(a)
    reflections = []
    for k in range(d - 2):
        v = a[k + 1:, k].copy()
        size = np.linalg.norm(v)
        if size > 0:
            v[0] += np.copysign(size, v[0])
            v /= np.linalg.norm(v)
            part = a[k + 1:, k + 1:]
            p = part @ v
            w = 2 * (p - (v @ p) * v)
            part -= np.outer(v, w) + np.outer(w, v)
            below = a[k + 1:, k]
            below -= 2 * v * (v @ below)
        reflections.append(v)
    return np.diag(a).copy(), np.diag(a, -1).copy(), reflections


def sturm_count(diagonal: np.ndarray, beside: np.ndarray, at: np.ndarray) -> np.ndarray:
    """How many eigenvalues lie below each value: the negative pivots of the shifted matrix."""
    least = np.finfo(float).tiny * max(1.0, float(np.max(beside**2, initial=0.0)))
    q = diagonal[0] - at
    count = (q < 0).astype(np.int64)
    for k in range(1, len(diagonal)):
        q = np.where(np.abs(q) < least, -least, q)
        q = diagonal[k] - at - beside[k - 1] ** 2 / q
        count += q < 0
    return count


def leading_values(diagonal: np.ndarray, beside: np.ndarray, k: int) -> np.ndarray:
    """The k largest eigenvalues, falling, by bisection until no double lies between the bounds."""
    around = np.append(np.abs(beside), 0) + np.append(0, np.abs(beside))
    low = np.full(k, np.min(diagonal - around) - 1e-300)
    high = np.full(k, np.max(diagonal + around) * (1 + 4e-16) + 1e-300)
    rank = len(diagonal) - 1 - np.arange(k)
    while True:
        middle = low + (high - low) / 2
        open_ = (middle > low) & (middle < high)
        if not open_.any():
            return high
        below = sturm_count(diagonal, beside, middle)
        low = np.where(open_ & (below <= rank), middle, low)
        high = np.where(open_ & (below > rank), middle, high)


def solved(diagonal: np.ndarray, beside: np.ndarray, shift: float, right: np.ndarray) -> np.ndarray:
    """(T - shift) x = right by elimination with row exchanges; a pivot of zero becomes a tiny one."""
    d = len(diagonal)
    tiny = np.finfo(float).eps * max(np.max(np.abs(diagonal), initial=0.0), np.max(np.abs(beside), initial=0.0), 1e-300)
    first, second, third = np.zeros(d), np.zeros(d), np.zeros(d)  # the rows of the upper triangle
    x = np.array(right, float)
    a, b, c = diagonal[0] - shift, beside[0] if d > 1 else 0.0, 0.0
    for k in range(d - 1):
        p, q, r = beside[k], diagonal[k + 1] - shift, beside[k + 1] if k + 2 < d else 0.0
        if abs(p) > abs(a):
            first[k], second[k], third[k] = p, q, r
            factor = a / p
            a, b, c = b - factor * q, c - factor * r, 0.0
            x[k], x[k + 1] = x[k + 1], x[k] - factor * x[k + 1]
        else:
            a = a if abs(a) > tiny else tiny
            first[k], second[k], third[k] = a, b, c
            factor = p / a
            x[k + 1] -= factor * x[k]
            a, b, c = q - factor * b, r - factor * c, 0.0
    first[d - 1] = a if abs(a) > tiny else tiny
    for k in range(d - 1, -1, -1):
        rest = x[k]
        if k + 1 < d:
            rest -= second[k] * x[k + 1]
        if k + 2 < d:
            rest -= third[k] * x[k + 2]
        x[k] = rest / first[k]
        if abs(x[k]) > 1e200:
            x /= abs(x[k])
    return x


def leading(matrix: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """The k largest eigenvalues of a symmetric matrix and their unit vectors (rows), the largest entry of each positive."""
    scale = float(np.max(np.abs(matrix), initial=0.0))
    k = min(k, len(matrix))
    if not scale or not k:
        return np.zeros(0), np.zeros((0, len(matrix)))
    matrix = matrix / scale
    diagonal, beside, reflections = tridiagonal(matrix)
    values = leading_values(diagonal, beside, k)
    norm = max(float(np.max(np.abs(diagonal))), float(np.max(np.abs(beside), initial=0.0)))
    rng = np.random.default_rng(11)
    vectors: list[np.ndarray] = []
    shift, since = np.inf, 0
    for i, value in enumerate(values.tolist()):
        if i and values[i - 1] - value > CLUSTER * norm:
            since = i
        shift = min(value, shift - 4e-16 * norm)  # equal eigenvalues are solved at slightly different shifts
        x = rng.normal(size=len(diagonal))
        for _ in range(6):
            x /= np.max(np.abs(x))
            x = solved(diagonal, beside, shift, x)
            for _ in range(2):
                for held in vectors[since:]:
                    x -= (held @ x) * held
            x /= np.linalg.norm(x)
        vectors.append(x)
    out = np.array(vectors)
    for j in range(len(reflections) - 1, -1, -1):
        v = reflections[j]
        if v.any():
            out[:, j + 1:] -= 2 * np.outer(out[:, j + 1:] @ v, v)
    out /= np.linalg.norm(out, axis=1, keepdims=True)
    out *= np.sign(out[np.arange(k), np.argmax(np.abs(out), axis=1)])[:, None]
    values = np.einsum("ki,ij,kj->k", out, matrix, out) * scale
    return values, out


# ---- sums over the fit list -----------------------------------------------------------------------------------------

def whole_numbers(vector: Column) -> Column:
    """floor(256 c) of each entry, null where the vector is null or an entry is null or not finite. Numbers beyond the
    range of a long stay at its end."""
    numbers = vector.cast("array<double>")
    finite = F.forall(numbers, lambda c: c.isNotNull() & ~F.isnan(c) & (F.abs(c) < float("inf")))
    return F.when(finite, F.transform(numbers, lambda c: F.floor(c * SCALE)))


def _rows(batch: pa.RecordBatch, d: int) -> np.ndarray:
    return batch.column(batch.schema.get_field_index("x")).flatten().to_numpy(zero_copy_only=False).reshape(-1, d)


def _sums(d: int) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """For each dimension the sums of the upper and the lower 32 bits; both stay exact for 2**31 rows of a task."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        n, upper, lower = 0, np.zeros(d, np.int64), np.zeros(d, np.int64)
        for batch in batches:
            x = _rows(batch, d)
            n += len(x)
            upper += (x >> LOW_BITS).sum(axis=0)
            lower += (x & ((1 << LOW_BITS) - 1)).sum(axis=0)
        if n:
            yield pa.RecordBatch.from_arrays([pa.array(np.arange(d, dtype=np.int32)), pa.array(np.full(d, n)), pa.array(upper), pa.array(lower)], ["i", "n", "upper", "lower"])

    return run


def spread(x: np.ndarray, n: int, sums: list[int]) -> np.ndarray:
    """n x - S, exact: in 64 bits where they hold it, else in Python integers."""
    most = max(abs(int(x.max(initial=0))), abs(int(x.min(initial=0))))
    if n * most + max(map(abs, sums), default=0) < SAFE:
        return x * np.int64(n) - np.array(sums, np.int64)
    return x.astype(object) * n - np.array(sums, object)


def centred(x: np.ndarray, n: int, sums: list[int]) -> np.ndarray:
    return spread(x, n, sums).astype(float) / n


def _products(d: int, n: int, sums: list[int], components: np.ndarray | None = None, scales: np.ndarray | None = None) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """Summed products of centred vectors, or of their whitened projections, one matrix for each task, by rows; the row
    numbered -1 holds the sums."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = 0
        for batch in batches:
            y = centred(_rows(batch, d), n, sums)
            if components is not None:
                y = y @ components.T / scales
            total = total + np.vstack([y.sum(axis=0), y.T @ y])
        if not np.isscalar(total):
            size = total.shape[1]
            yield pa.RecordBatch.from_arrays(
                [pa.array(np.arange(-1, size, dtype=np.int32)), pa.ListArray.from_arrays(pa.array(np.arange(0, (size + 1) * size + 1, size, dtype=np.int32)), pa.array(total.ravel()))], ["i", "row"])

    return run


def _matrix(sums: DataFrame, size: int) -> tuple[np.ndarray, np.ndarray]:
    """Summed rows of all tasks: the vector of sums and the matrix of products, (size + 1) * size numbers."""
    cells = sums.select("i", F.posexplode("row").alias("j", "v")).groupBy("i", "j").agg(F.sum("v").alias("v")).toArrow()
    out = np.zeros((size + 1, size))
    out[cells["i"].to_numpy() + 1, cells["j"].to_numpy()] = cells["v"].to_numpy()
    return out[0], out[1:]


@dataclass
class Whitening:
    """``n`` different vectors with the sums ``sums``; eigenvalues falling, components as rows, the trace of the
    covariance, and the largest deviation of the whitened covariance from the identity."""

    n: int
    sums: list[int]
    values: np.ndarray
    components: np.ndarray
    trace: float
    identity_error: float


def fit(vectors: DataFrame, k: int = COMPONENTS) -> Whitening:
    """``vectors``: x, array<long>. Vectors of another length than the most frequent one (of equally frequent ones the
    longest) are left out. Components without variance (an eigenvalue within rounding of 0) are not made."""
    different = written(vectors.filter("size(x) > 0").select("x").distinct(), "whitening-fit")
    length = different.groupBy(F.size("x").alias("d")).count().orderBy(F.desc("count"), F.desc("d")).first()
    if length is None:
        return Whitening(0, [], np.zeros(0), np.zeros((0, 0)), 0.0, 0.0)
    d = length.d
    if d > MAX_DIMENSIONS:
        raise ValueError(f"vectors of {d} entries; at most {MAX_DIMENSIONS} are worked on")
    different = different.filter(F.size("x") == d)
    exact = lambda c: F.sum(F.col(c).cast("decimal(38,0)")).alias(c)
    rows = different.mapInArrow(_sums(d), "i int, n long, upper long, lower long").groupBy("i").agg(F.sum("n").alias("n"), exact("upper"), exact("lower")).orderBy("i").collect()  # d rows
    n, sums = int(rows[0].n), [(int(r.upper) << LOW_BITS) + int(r.lower) for r in rows]
    _, products = _matrix(different.mapInArrow(_products(d, n, sums), "i int, row array<double>"), d)
    covariance = (products + products.T) / (2 * n)
    values, components = leading(covariance, k)
    trace = float(np.trace(covariance))
    real = values > 1e-14 * d * trace
    values, components = values[real], components[real]
    error = 0.0
    if len(values):
        size = len(values)
        mean, products = _matrix(different.mapInArrow(_products(d, n, sums, components, np.sqrt(values)), "i int, row array<double>"), size)
        error = float(np.max(np.abs(products / n - np.outer(mean, mean) / n**2 - np.eye(size))))
    return Whitening(n, sums, values, components, trace, error)


def _projected(held) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model: Whitening = held.value
        d, k = len(model.sums), len(model.values)
        for batch in batches:
            x = _rows(batch, d)
            far = spread(x, model.n, model.sums)
            if far.dtype == object or d * max(abs(int(far.max(initial=0))), abs(int(far.min(initial=0)))) ** 2 >= 1 << 63:
                deviation = [v if v < 1 << 63 else None for v in (far.astype(object) ** 2).sum(axis=1)]
            else:
                deviation = (far * far).sum(axis=1)
            white = far.astype(float) / model.n @ model.components.T / np.sqrt(model.values)
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array(deviation, pa.int64()), pa.ListArray.from_arrays(pa.array(np.arange(0, len(x) * k + 1, k, dtype=np.int32)) if k else pa.array(np.zeros(len(x) + 1, np.int32)), pa.array(white.ravel()))],
                ["row", "deviation", "whitened"])

    return run


def whiten(df: DataFrame, vector: str = "embedding", k: int = COMPONENTS) -> tuple[DataFrame, Whitening]:
    """``row`` (all columns of df, whatever their names), ``deviation`` (sum of (n x - S)^2) and ``whitened`` (up to k
    numbers), with the fit.

    Rows whose vector is null, empty, of another length than the most frequent one, or holds a null or non-finite entry
    are left out. Repeated rows are kept, and count once in the fit. Without rows or without variance there are no
    components. A deviation that no long holds is null. Sums of doubles depend on the order of tasks in the last digits.
    """
    row = F.struct(*[F.col(f"`{c}`") for c in df.columns])
    vectors = df.select(row.alias("row"), whole_numbers(F.col(f"`{vector}`")).alias("x")).filter("x is not null")
    model = fit(vectors.select("x"), k)
    schema = StructType([vectors.schema["row"], StructField("deviation", LongType()), StructField("whitened", ArrayType(DoubleType()))])
    held = df.sparkSession.sparkContext.broadcast(model)
    return vectors.filter(F.size("x") == len(model.sums)).filter("size(x) > 0").mapInArrow(_projected(held), schema), model


def components(df: DataFrame, k: int = COMPONENTS) -> DataFrame:
    """One row for each embedding and component: vec_id, component, n, deviation, whitened, explained, identity_error."""
    done, model = whiten(df, "embedding", k)
    shares = F.array(*[F.lit(float(v / model.trace)) for v in model.values]) if len(model.values) else F.array().cast("array<double>")
    flat = done.select(F.col("row.vec_id").alias("vec_id"), "deviation", F.posexplode("whitened").alias("at", "whitened"))
    return flat.select("vec_id", (F.col("at") + 1).alias("component"), F.lit(model.n).cast("long").alias("n"), "deviation", "whitened",
                       shares[F.col("at")].alias("explained"), F.lit(model.identity_error).alias("identity_error"))


@query("op11_embedding_whitening")
def op11(spark, sf):
    return components(table(spark, sf, "embeddings"))
