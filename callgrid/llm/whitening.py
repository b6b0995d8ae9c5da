"""Whitening of embeddings: principal components of the distinct vectors, scaled to unit variance.

Entries become whole numbers, so copies and sums are exact. Spark sums the vectors and then the products of centred
vectors, block by block inside tasks; only numbers of the vectors' dimension reach the driver, a matrix of d * d.
There the matrix is brought to tridiagonal form by Householder reflections, its leading eigenvalues are found by
bisection on Sturm counts, and its eigenvectors by inverse iteration, orthogonalised again inside clusters of close
eigenvalues. Components (at most d * k numbers) go to all tasks, which project rows where they lie.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import read, saved, small_batches

#: Steps of a whole entry's unit; components.
SCALE, COMPONENTS = 256, 4
#: Eigenvalues closer than this share of the matrix norm are one cluster; those below RANK of the largest count as 0.
CLUSTER, RANK = 1e-3, 1e-12
_EPS = float(np.finfo(float).eps)


def tridiagonal(a: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Diagonal, off-diagonal and Householder vectors (rows; zero where nothing is reflected) of a symmetric matrix."""
    a, n = a.astype(float).copy(), len(a)
    mirrors = np.zeros((max(n - 2, 0), n))
    for j in range(n - 2):
        x = a[j + 1 :, j].copy()
        tail = np.abs(x[1:]).max(initial=0.0)
        if not tail:
            continue
        x /= max(tail, abs(x[0]))  # no under- or overflow in the norm
        x[0] += math.copysign(float(np.linalg.norm(x)), x[0])
        v = x / np.linalg.norm(x)
        mirrors[j, j + 1 :] = v
        rest = a[j + 1 :, j + 1 :]
        p = rest @ v
        w = p - (v @ p) * v
        rest -= 2 * (np.outer(v, w) + np.outer(w, v))
        a[j + 1 :, j] -= 2 * v * (v @ a[j + 1 :, j])
        a[j, j + 1 :] = a[j + 1 :, j]
    return np.diag(a).copy(), np.diag(a, -1).copy(), mirrors


def below(diagonal: np.ndarray, off: np.ndarray, x: float) -> int:
    """Sturm count: how many eigenvalues are less than ``x``."""
    count, q, least = 0, 1.0, np.finfo(float).tiny / _EPS
    for i, d in enumerate(diagonal.tolist()):
        q = d - x - (off[i - 1] ** 2 / q if i else 0.0)
        if abs(q) < least:
            q = -least
        count += q < 0
    return count


def leading(diagonal: np.ndarray, off: np.ndarray, k: int) -> list[float]:
    """The ``k`` greatest eigenvalues, falling, each bisected to the last bits of a double."""
    n = len(diagonal)
    reach = np.abs(np.append(off, 0)) + np.abs(np.insert(off, 0, 0))
    low, high = float((diagonal - reach).min()), float((diagonal + reach).max())
    room = _EPS * max(abs(low), abs(high), np.finfo(float).tiny / _EPS) * n
    found = []
    for i in range(k):
        lo, hi = low - room, high + room
        while True:
            mid = lo + (hi - lo) / 2
            if mid <= lo or mid >= hi or hi - lo <= 2 * _EPS * max(abs(lo), abs(hi)):
                break
            lo, hi = (mid, hi) if below(diagonal, off, mid) <= n - 1 - i else (lo, mid)
        found.append(lo + (hi - lo) / 2)
    return found


def _solve(diagonal: np.ndarray, off: np.ndarray, shift: float, b: np.ndarray, norm: float) -> np.ndarray:
    """(T - shift) x = b by elimination with row exchanges; a pivot of 0 gives way to a tiny one."""
    n = len(diagonal)
    # the rows of U: pivots and the two diagonals above them
    u, v, w, x = diagonal - shift, np.append(off, 0.0), np.zeros(n), b.astype(float).copy()
    under, least = off.copy(), _EPS * norm or 1.0
    for i in range(n - 1):
        if abs(under[i]) > abs(u[i]):
            u[i], under[i] = under[i], u[i]
            u[i + 1], v[i] = v[i], u[i + 1]
            w[i], v[i + 1] = v[i + 1], 0.0
            x[i], x[i + 1] = x[i + 1], x[i]
        if u[i] == 0:
            u[i] = least
        f = under[i] / u[i]
        u[i + 1] -= f * v[i]
        v[i + 1] -= f * w[i]
        x[i + 1] -= f * x[i]
    if abs(u[-1]) < least:
        u[-1] = least
    for i in range(n - 1, -1, -1):
        x[i] = (x[i] - (v[i] * x[i + 1] if i + 1 < n else 0) - (w[i] * x[i + 2] if i + 2 < n else 0)) / u[i]
        if abs(x[i]) > 1e150:  # only the direction matters
            x[i:] *= 1e-150
            x[:i] *= 1e-150
    return x


def _apart(x: np.ndarray, others: list[np.ndarray]) -> np.ndarray:
    """``x`` less its parts along ``others`` (unit, orthogonal), taken off twice against rounding."""
    for _ in range(2):
        for y in others:
            x = x - (x @ y) * y
    return x


def components(a: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """The ``k`` greatest eigenvalues of a symmetric matrix and their unit eigenvectors, as rows. The largest entry of a vector is positive."""
    diagonal, off, mirrors = tridiagonal(a)
    values, n = leading(diagonal, off, k), len(a)
    norm = float(max(np.abs(diagonal).max(), np.abs(off).max(initial=0.0)))
    random, vectors, cluster = np.random.default_rng(1), [], 0
    for i, value in enumerate(values):
        if i and values[i - 1] - value > CLUSTER * norm:
            cluster = i
        shift = value - 4 * _EPS * norm * (i - cluster)  # equal eigenvalues: other factors for each
        x = random.standard_normal(n)
        for _ in range(8):
            x = _solve(diagonal, off, shift, x / np.linalg.norm(x), norm)
            x /= np.linalg.norm(x / np.abs(x).max()) * np.abs(x).max()
            rest = _apart(x, vectors[cluster:])
            if np.linalg.norm(rest) < 1e-6:  # nothing but rounding is left: another start, apart from the cluster
                rest = _apart(random.standard_normal(n), vectors[cluster:])
            x = rest
        x = _apart(x / np.linalg.norm(x), vectors[cluster:])
        vectors.append(x / np.linalg.norm(x))
    out = np.array(vectors).reshape(k, n)
    for v in mirrors[::-1]:
        out -= 2 * np.outer(out @ v, v)
    return np.array(values), out * np.sign(out[np.arange(k), np.abs(out).argmax(axis=1)])[:, None]


def _whole(df: DataFrame, column: str) -> DataFrame:
    """The rows whose vector has only finite entries, with x, the entries as floor(256 * c), and size, their number."""
    c = F.col(column)
    big = F.transform(c, lambda e: F.floor(e.cast("double") * SCALE).cast("long"))
    good = c.isNotNull() & (F.size(c) > 0) & F.forall(c, lambda e: e.isNotNull() & ~F.isnan(e.cast("double")) & (F.abs(e.cast("double")) < float("inf")))
    return df.where(good).withColumn("__x", big).withColumn("__size", F.size(c))


def _vectors(batch: pa.RecordBatch, place: int, d: int) -> np.ndarray:
    return batch.column(place).flatten().to_numpy().reshape(-1, d)


def _sums(fit: DataFrame, d: int) -> tuple[int, list[int]]:
    """The number of vectors and their sums by dimension, exact; a task hands on one row."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        n, total = 0, [0] * d
        for b in batches:
            if b.num_rows:
                x = _vectors(b, 0, d)
                n += len(x)
                high, low = (x >> 32).sum(axis=0), (x & 0xFFFFFFFF).sum(axis=0)  # no overflow
                total = [t + (int(h) << 32) + int(l) for t, h, l in zip(total, high, low, strict=True)]
        yield pa.RecordBatch.from_arrays([pa.array([n]), pa.array([[str(t) for t in total]], pa.list_(pa.string()))], names=["n", "s"])

    parts = fit.mapInArrow(run, "n long, s array<string>").select("n", F.posexplode("s").alias("j", "s"))
    found = parts.groupBy("j").agg(F.sum("n").alias("n"), F.sum(F.col("s").cast("decimal(38,0)")).alias("s")).orderBy("j").collect()  # d rows
    return found[0]["n"], [int(r["s"]) for r in found]


def _covariance(rows: DataFrame, width: int, centred) -> np.ndarray:
    """The sum of z z' over all rows, where ``centred`` gives the z of a batch; a task hands on its own sums, which are added in the order of the tasks."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        total, some = np.zeros((width, width)), False
        for b in batches:
            if b.num_rows:
                z = centred(b)
                total += z.T @ z
                some = True
        if some:
            part = TaskContext.get().partitionId()
            yield pa.RecordBatch.from_arrays([pa.array(range(width), pa.int32()), pa.array([part] * width, pa.int32()), pa.array(total.tolist(), pa.list_(pa.float64()))], names=["i", "part", "row"])

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        found: dict[int, np.ndarray] = {}
        for b in batches:
            for i, row in zip(b.column(0).to_pylist(), b.column(2).flatten().to_numpy().reshape(-1, width), strict=True):
                found[i] = found.get(i, 0) + row
        yield pa.RecordBatch.from_arrays([pa.array(list(found), pa.int32()), pa.array([r.tolist() for r in found.values()], pa.list_(pa.float64()))], names=["i", "row"])

    parts = rows.mapInArrow(run, "i int, part int, row array<double>").repartition("i").sortWithinPartitions("i", "part")
    out = np.zeros((width, width))
    for r in parts.mapInArrow(add, "i int, row array<double>").collect():  # width rows
        out[r["i"]] = r["row"]
    return (out + out.T) / 2


def whiten(df: DataFrame, most: int = COMPONENTS, key: str = "vec_id", column: str = "embedding") -> DataFrame:
    """``key``, component, n, deviation, whitened, explained and identity_error of each row of ``df`` and component.

    Rows whose vector is null or empty, or holds null or non-finite entries, drop out; so do vectors that are not of
    the most frequent length (of equally frequent ones the greatest). Equal vectors count once in the fit and each row
    has its own results; repeated and null keys stay. Components whose eigenvalue is 0 (below RANK of the largest)
    have no whitened value and give no row: fewer distinct vectors than components, or equal ones only, give fewer or no
    rows. deviation is null beyond the range of a long. An empty table gives no rows; other columns are ignored.
    """
    spark = df.sparkSession
    small_batches(spark, 5000)
    schema = f"{key} {dict(df.dtypes)[key]}, component int, n long, deviation long, whitened double, explained double, identity_error double"
    rows = _whole(df.select(F.col(key), F.col(column)), column)
    sizes = rows.groupBy("__size").count().orderBy(F.desc("count"), F.desc("__size")).first()
    if sizes is None:
        return spark.createDataFrame([], schema)
    d = sizes["__size"]
    rows = rows.where(F.col("__size") == d)
    fit = saved(rows.select("__x").distinct(), "distinct-vectors")
    n, s = _sums(fit, d)
    # the mean as a whole number and a rest, so that centring loses no bits of great numbers
    base = np.array([t // n for t in s], np.int64)
    rest = np.array([(t % n) / n for t in s])
    covariance = _covariance(fit, d, lambda b: (_vectors(b, 0, d) - base) - rest) / n
    k = min(most, d)
    values, vectors = components(covariance, k)
    good = (values > RANK * max(values[0], 0)) & (values > 0)
    values, vectors = values[good], vectors[good]
    if not len(values):
        return spark.createDataFrame([], schema)
    share = (values / np.trace(covariance)).tolist()
    axes = (vectors / np.sqrt(values)[:, None]).T  # d * k numbers, in each task's closure
    k = len(values)
    error = float(np.abs(_covariance(fit, k, lambda b: ((_vectors(b, 0, d) - base) - rest) @ axes) / n - np.eye(k)).max())
    whole = np.array([t - n * (t // n) for t in s], object)  # S - n * base
    limit = float(1 << 62)

    def deviations(y: np.ndarray) -> list[int | None]:
        """Sums of (n * y - rest of S) squared, exact; in 64 bits where they fit."""
        estimate = (((y - rest) * n) ** 2).sum(axis=1)
        if estimate.max(initial=0) < limit:
            z = y * n - whole.astype(np.int64)
            return (z * z).sum(axis=1).tolist()
        exact = [sum((n * int(v) - int(w)) ** 2 for v, w in zip(row, whole, strict=True)) for row in y]
        return [v if v < 1 << 63 else None for v in exact]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            if not b.num_rows:
                continue
            y = _vectors(b, 1, d) - base
            white = (y - rest) @ axes
            m = len(y)
            at = pa.array(np.repeat(np.arange(m), k))
            yield pa.RecordBatch.from_arrays(
                [
                    b.column(0).take(at), pa.array(np.tile(np.arange(1, k + 1), m), pa.int32()), pa.array(np.full(m * k, n), pa.int64()), pa.array(deviations(y), pa.int64()).take(at),
                    pa.array(white.ravel()), pa.array(share * m, pa.float64()), pa.array(np.full(m * k, error)),
                ],
                names=[key, "component", "n", "deviation", "whitened", "explained", "identity_error"],
            )

    return rows.select(key, "__x").mapInArrow(run, schema)


def op13_embedding_whitening(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The four leading whitened components of every valid vector of ``embeddings``."""
    return whiten(read(spark, sf_dir, "embeddings"))
