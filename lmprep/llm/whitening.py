"""Whitening of embeddings by shifted CholeskyQR.

The distinct vectors, centred, are a tall matrix A that is never gathered. Each pass over it adds up a Gram matrix in Spark: the
first that of A, from integers and exact; a shift above its rounding error makes its Cholesky factor safe, and triangular solves
give rows that are nearly orthonormal. Further passes repeat this on the solved rows until their Gram matrix is the identity to
double precision. The factors compose to R with A = QR, whose squared condition never arises, and the singular value decomposition
of R gives the components.

Columns that depend on others (constant ones, repeats) are found by exact elimination of the first Gram matrix; they stand outside the solves
and join R as combinations of the pivots.

Only sums of ``width`` squared numbers leave the tasks, whatever the number of rows.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lmprep.llm.store import written
from lmprep.llm.vectors import longest, matrix, quantized

EPS = np.finfo(float).eps
#: Passes after the first; two are enough unless the matrix is near to singular, when passes are shifted again.
MOST_PASSES = 8
#: Rows of a block inside a task, so that integer sums of products fit in 64 bits.
BLOCK = 4096


@dataclass(frozen=True)
class Whitening:
    """``components`` are columns; ``variances`` are their eigenvalues, falling; those without variance are left out."""

    n: int
    sums: list[int]
    components: np.ndarray
    variances: np.ndarray
    trace: float
    passes: int

    def project(self, x: np.ndarray) -> np.ndarray:
        """Whitened rows."""
        return _centring(self.n, self.sums)(x) @ self.components / np.sqrt(self.variances)


def _added(rows: DataFrame, width: int, each: Callable[[np.ndarray], np.ndarray], exact: bool = False) -> np.ndarray:
    """The sum over all rows of the matrix that ``each`` makes of a block of rows.

    A task sends one number per entry; Spark adds them up by entry, as decimals if ``exact``, and in the order of the
    tasks otherwise, so that the same layout gives the same sum.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total: np.ndarray | None = None
        for batch in batches:
            for start in range(0, batch.num_rows, BLOCK):
                part = each(matrix(batch.column(0).slice(start, BLOCK), width))
                total = part.astype(object if exact else float) if total is None else total + part
        if total is not None:
            flat = total.ravel().tolist()
            values = pa.array([str(v) for v in flat]) if exact else pa.array(flat, pa.float64())
            yield pa.RecordBatch.from_arrays([pa.array(range(len(flat)), pa.int32()), values], names=["entry", "value"])

    parts = rows.select("x").mapInArrow(run, f"entry int, value {'string' if exact else 'double'}")
    if exact:
        totals = parts.groupBy("entry").agg(F.sum(F.col("value").cast("decimal(38,0)")).alias("total"))
    else:
        parts = parts.withColumn("task", F.spark_partition_id())
        ordered = F.transform(F.array_sort(F.collect_list(F.struct("task", "value"))), lambda p: p["value"])
        totals = parts.groupBy("entry").agg(F.aggregate(ordered, F.lit(0.0), lambda a, v: a + v).alias("total"))
    found = {r["entry"]: r["total"] for r in totals.collect()}  # entries of one small matrix
    return np.array([found[i] for i in range(len(found))], object if exact else float)


def _exact(x: np.ndarray, bits: int) -> np.ndarray:
    """``x``, as Python integers where a component has more than ``bits`` bits."""
    return x if not x.size or -(1 << bits) < x.min() <= x.max() < 1 << bits else x.astype(object)


def _products(x: np.ndarray) -> np.ndarray:
    """Exact x'x of a block: in doubles where all sums stay below 2^53, else in wider integers."""
    if not x.size or np.abs(x).max() < 1 << 20:
        y = x.astype(float)
        return (y.T @ y).astype(np.int64)
    x = _exact(x, 25)
    return x.T @ x


def _pivots(gram: np.ndarray) -> list[int]:
    """Columns that span the matrix with this Gram matrix of integers, by exact elimination, the largest remainder first."""
    rest, last = gram.copy(), 1
    chosen: list[int] = []
    while len(chosen) < len(gram):
        left = np.diag(rest).copy()
        left[chosen] = 0
        best = int(left.argmax())
        if left[best] <= 0:
            break
        chosen.append(best)
        pivot, row = rest[best, best], rest[best].copy()
        rest = (rest * pivot - np.outer(row, row)) // last  # divides without remainder
        last = pivot
    return sorted(chosen)


def _factor(gram: np.ndarray, n: int) -> np.ndarray:
    """Upper Cholesky factor; of a matrix near to singular with a shift above the rounding of a Gram matrix of ``n`` rows."""
    k = len(gram)
    values = np.linalg.eigvalsh(gram)
    shift = 11 * (math.sqrt(n) + k) * k * EPS * values[-1]
    return np.linalg.cholesky(gram + (shift if values[0] < 100 * shift else 0.0) * np.eye(k)).T


def _centring(n: int, sums: list[int]) -> Callable[[np.ndarray], np.ndarray]:
    """x to x - S / n, from the exact n x - S where 64 bits hold it."""
    mean, fits = np.array([s / n for s in sums]), max(map(abs, sums), default=0) < 1 << 61

    def centred(x: np.ndarray) -> np.ndarray:
        if fits and x.size and n * int(np.abs(x).max()) < 1 << 61:
            return (n * x - np.array(sums)) / n
        return x - mean

    return centred


def _solved(centred: np.ndarray, factors: list[np.ndarray]) -> np.ndarray:
    """Rows times the inverses of upper triangular factors, one triangular solve after the other."""
    out = centred.T
    for r in factors:
        out = _forward(r.T, out)
    return out.T


def _forward(lower: np.ndarray, right: np.ndarray) -> np.ndarray:
    out = np.empty_like(right)
    for i in range(len(lower)):
        out[i] = (right[i] - lower[i, :i] @ out[:i]) / lower[i, i]
    return out


def fit(rows: DataFrame, components: int = 4) -> Whitening | None:
    """Fit on every row of ``rows`` (x: longs, no nulls); None without rows or without any variance."""
    width, n = longest(rows, "x"), rows.count()
    if not n or not width:
        return None
    sums = [int(s) for s in _added(rows, width, lambda x: _exact(x, 50).sum(axis=0), exact=True)]
    # n times the covariance is sum(xx') - ss' / n; times n once more, it is in integers
    products = _added(rows, width, _products, exact=True).reshape(width, width)
    whole = np.array([[n * int(products[i, j]) - sums[i] * sums[j] for j in range(width)] for i in range(width)], object)
    gram = np.array([[v / n for v in row] for row in whole.tolist()], float)
    trace = int(sum(whole[i, i] for i in range(width))) / n / n
    if not trace:
        return None
    pivots = _pivots(whole)
    dependent = [i for i in range(width) if i not in pivots]
    own = gram[np.ix_(pivots, pivots)]
    factors, taken, centred = [_factor(own, n)], np.array(pivots), _centring(n, sums)
    for _ in range(MOST_PASSES):

        def solved_gram(x: np.ndarray, factors=tuple(factors)) -> np.ndarray:
            q = _solved(centred(x)[:, taken], list(factors))
            return q.T @ q

        again = _added(rows, width, solved_gram).reshape(len(pivots), -1)
        factors.append(_factor((again + again.T) / 2, n))
        if np.abs(again - np.eye(len(pivots))).max() < 1e-13 * max(10, len(pivots)):
            break
    r = np.linalg.multi_dot(factors[::-1])
    full = np.zeros((len(pivots), width))
    full[:, pivots] = r
    if dependent:
        scale = 1 / np.sqrt(np.diag(own))
        shares = np.linalg.lstsq(own * np.outer(scale, scale), gram[np.ix_(pivots, dependent)] * scale[:, None], rcond=None)[0]
        full[:, dependent] = r @ (shares * scale[:, None])
    _, singular, directions = np.linalg.svd(full, full_matrices=False)
    kept = min(components, len(singular))
    vectors = directions[:kept].T
    vectors = vectors * np.where(vectors[np.abs(vectors).argmax(axis=0), np.arange(kept)] < 0, -1.0, 1.0)
    return Whitening(n, sums, vectors, singular[:kept] ** 2 / n, trace, len(factors))


def identity_error(rows: DataFrame, w: Whitening) -> float:
    """Largest absolute entry of the covariance of the whitened rows of ``rows`` minus the identity."""
    width, k = len(w.sums), len(w.variances)
    middle = _added(rows, width, lambda x: w.project(x).sum(axis=0)) / w.n

    def products(x: np.ndarray) -> np.ndarray:
        y = w.project(x) - middle
        return y.T @ y

    return float(np.abs(_added(rows, width, products).reshape(k, k) / w.n - np.eye(k)).max())


def whiten(table: DataFrame, id_col: str = "vec_id", vector: str = "embedding", components: int = 4) -> DataFrame:
    """(vec_id, component, n, deviation, whitened, explained, identity_error) for each row of ``table`` and each component.

    Rows whose vector is null or holds null or non-finite components are left out. All others have their rows in the result,
    repeated rows and null ids too, each as often as it occurs; the fit has each distinct vector once. Shorter vectors count as filled up with zeros,
    also when they are told apart. Components are numbered by falling variance; components without any are not there, so an empty table, a single distinct vector or empty vectors
    give no rows. ``deviation`` is the exact sum of ``(n x - S)^2`` as a decimal of 38 digits, null beyond them. Other columns
    of ``table``, whatever their names, are not read.
    """
    spark = table.sparkSession
    rows = table.select(F.col(f"`{id_col}`").cast("long").alias("vec_id"), quantized(F.col(f"`{vector}`")).alias("x")).where("x IS NOT NULL")
    rows = written(rows, "vectors")
    width = longest(rows, "x")
    filled = F.concat("x", F.array_repeat(F.lit(0).cast("long"), F.lit(width) - F.size("x"))).alias("x")
    distinct = written(rows.select(filled).distinct(), "distinct")
    schema = "vec_id long, component int, n long, deviation decimal(38,0), whitened double, explained double, identity_error double"
    w = fit(distinct, components)
    if w is None:
        return spark.createDataFrame([], schema)
    error = identity_error(distinct, w)
    k, explained = len(w.variances), w.variances / w.trace
    sums = np.array(w.sums, object)
    small = max(map(abs, w.sums), default=0) < 1 << 61

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for start in range(0, batch.num_rows, BLOCK):
                ids, x = batch.column("vec_id").slice(start, BLOCK), matrix(batch.column("x").slice(start, BLOCK), width)
                yield pa.RecordBatch.from_arrays(
                    [
                        ids.take(pa.array(np.repeat(np.arange(len(x)), k))),
                        pa.array(np.tile(np.arange(1, k + 1), len(x)), pa.int32()),
                        pa.array([str(d) for d in _deviations(x, w.n, sums, small) for _ in range(k)], pa.string()),
                        pa.array(w.project(x).ravel()),
                        pa.array(np.tile(explained, len(x))),
                    ],
                    names=["vec_id", "component", "deviation", "whitened", "explained"],
                )

    out = rows.mapInArrow(run, "vec_id long, component int, deviation string, whitened double, explained double")
    return out.select(
        "vec_id", "component", F.lit(w.n).cast("long").alias("n"), F.col("deviation").try_cast("decimal(38,0)").alias("deviation"),
        "whitened", "explained", F.lit(error).alias("identity_error"),
    )


def _deviations(x: np.ndarray, n: int, sums: np.ndarray, small: bool) -> list[int]:
    """Sum over dimensions of ``(n x - S)^2``, in 64 bits where that is surely enough."""
    largest = n * int(np.abs(x).max(initial=0)) + max((abs(int(s)) for s in sums), default=0)
    if small and largest < 1 << 31 and len(sums) * largest**2 < 1 << 62:
        return ((n * x - sums.astype(np.int64)) ** 2).sum(axis=1).tolist()
    return ((n * x.astype(object) - sums) ** 2).sum(axis=1).tolist()
