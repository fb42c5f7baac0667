"""Whitening of embeddings by a distributed covariance and an own symmetric eigensolver.

An entry c becomes the whole number ``floor(64 * c) + 1000000``. The mean and the covariance
are those of the *fit list*, every distinct vector once. Spark does what grows with the table:

1. distinct vectors (partial aggregation first, so a hot copy is one row per task);
2. their count and exact sums, then the sum of products of *centred* vectors: each task folds
   its rows into one d x d matrix, and matrices meet by row number, not on the driver;
3. projection of every row on the components, which are sent to the tasks as d x k numbers;
4. the covariance of the whitened fit list, by the same sum of products.

The driver sees d sums and one d x d matrix (``max_dims`` bounds d) and finds the leading
eigenpairs: Householder reflections to tridiagonal form, bisection on Sturm counts for the
eigenvalues, inverse iteration from random starts for the vectors, with reorthogonalisation
inside clusters of close eigenvalues, and the reflections applied backwards.

Defined results: rows whose vector is null or empty, or holds null, NaN or an infinity, are
left out; so are vectors whose length is not the most frequent one among the rest (ties: the
shorter). Entries beyond +-2**53 / 64 count as that bound. Repeated rows give repeated results; a null vec_id is
carried along. Components whose eigenvalue is zero to working precision do not exist, so a
table of one distinct vector gives no rows, as an empty one does. A deviation beyond 64 bits
is null. A component's sign makes its entry of largest size positive.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from fractions import Fraction

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quire.llm import store


@dataclass(frozen=True)
class Settings:
    components: int = 16
    scale: int = 64
    shift: int = 1_000_000
    max_dims: int = 4096
    max_tasks: int = 2048
    cluster: float = 1e-3


_EPS = np.finfo(float).eps
_WIDEST = float(1 << 53)


def tridiagonal(matrix: np.ndarray) -> tuple[np.ndarray, np.ndarray, list[np.ndarray]]:
    """(diagonal, off-diagonal, reflectors): Householder's form T of a symmetric matrix, with
    matrix = Q T Q' and Q the product of the reflections in order."""
    a, d = matrix.astype(float).copy(), len(matrix)
    reflectors = []
    for k in range(d - 2):
        x = a[k + 1:, k]
        size = np.abs(x).max()
        v = np.zeros(len(x))
        if size > 0 and np.abs(x[1:]).max() > 0:
            v = x / size
            v[0] += np.copysign(np.linalg.norm(v), v[0])
            v /= np.linalg.norm(v)
            part = a[k + 1:, k + 1:]
            p = 2 * (part @ v)
            w = p - (v @ p) * v
            part -= np.outer(v, w) + np.outer(w, v)
            a[k + 1:, k] -= 2 * v * (v @ a[k + 1:, k])
            a[k, k + 1:] = a[k + 1:, k]
        reflectors.append(v)
    return np.diag(a).copy(), np.diag(a, -1).copy(), reflectors


def below(diagonal: np.ndarray, off: np.ndarray, points: np.ndarray) -> np.ndarray:
    """How many eigenvalues of the tridiagonal matrix lie below each point: the negative terms
    of its Sturm sequence, all points at once."""
    least = max(np.abs(off).max(initial=0.0), np.abs(diagonal).max(initial=0.0)) * _EPS * _EPS + np.finfo(float).tiny
    count = np.zeros(len(points), np.int64)
    q = np.ones(len(points))
    for k, value in enumerate(diagonal):
        q = value - points - (off[k - 1] ** 2 / q if k else 0.0)
        q = np.where(np.abs(q) < least, -least, q)
        count += q < 0
    return count


def leading_values(diagonal: np.ndarray, off: np.ndarray, k: int) -> np.ndarray:
    """The k largest eigenvalues, falling, each by bisection between Gershgorin's bounds."""
    d = len(diagonal)
    reach = np.r_[0.0, np.abs(off)] + np.r_[np.abs(off), 0.0]
    low, high = np.full(k, (diagonal - reach).min()), np.full(k, (diagonal + reach).max())
    width = np.abs([low[0], high[0]]).max() * _EPS
    low, high = low - 2 * width, high + 2 * width
    wanted = d - 1 - np.arange(k)
    for _ in range(200):
        middle = (low + high) / 2
        if ((high - low <= width / 4) | (middle == low) | (middle == high)).all():
            break
        under = below(diagonal, off, middle) <= wanted
        low, high = np.where(under, middle, low), np.where(under, high, middle)
    return (low + high) / 2


def _solver(diagonal: np.ndarray, off: np.ndarray, value: float):
    """Solves (T - value) x = b by elimination with row exchanges; zero pivots become tiny."""
    d = len(diagonal)
    least = max(np.abs(diagonal).max(), np.abs(off).max(initial=0.0), np.finfo(float).tiny) * _EPS
    main, above, second = diagonal - value, np.r_[off, 0.0], np.zeros(d)
    swapped, factor = np.zeros(d, bool), np.zeros(d)
    for i in range(d - 1):
        if abs(main[i]) < abs(off[i]):
            swapped[i] = True
            factor[i] = main[i] / off[i]
            top = (off[i], main[i + 1], above[i + 1])
            main[i + 1], above[i + 1] = above[i] - factor[i] * top[1], -factor[i] * top[2]
            main[i], above[i], second[i] = top
        else:
            pivot = main[i] if main[i] else least
            main[i], factor[i] = pivot, off[i] / pivot
            main[i + 1] -= factor[i] * above[i]
    main = np.where(np.abs(main) < least, np.copysign(least, main), main)

    def solve(b: np.ndarray) -> np.ndarray:
        x = b.copy()
        for i in range(d - 1):
            if swapped[i]:
                x[i], x[i + 1] = x[i + 1], x[i] - factor[i] * x[i + 1]
            else:
                x[i + 1] -= factor[i] * x[i]
        for i in range(d - 1, -1, -1):
            x[i] = (x[i] - (above[i] * x[i + 1] if i + 1 < d else 0.0)
                    - (second[i] * x[i + 2] if i + 2 < d else 0.0)) / main[i]
        return x

    return solve


def leading_vectors(diagonal: np.ndarray, off: np.ndarray, values: np.ndarray, cluster: float) -> np.ndarray:
    """Unit eigenvectors (columns) by inverse iteration. Values closer than ``cluster`` times the
    matrix's size belong together: their vectors are made orthogonal in every step."""
    d, size = len(diagonal), max(np.abs(diagonal).max(), np.abs(off).max(initial=0.0), np.finfo(float).tiny)
    rng = np.random.default_rng(1912)
    out, start = np.zeros((d, len(values))), 0
    for k, value in enumerate(values):
        if k and values[k - 1] - value > cluster * size:
            start = k
        solve, near = _solver(diagonal, off, value - (k - start) * _EPS * size), out[:, start:k]
        x = rng.standard_normal(d)
        for _ in range(5):
            for _ in range(2):  # twice: one pass of subtraction leaves rounding behind
                x -= near @ (near.T @ x)
            x /= np.linalg.norm(x)
            x = solve(x)
            x /= np.abs(x).max()
        for _ in range(2):
            x -= near @ (near.T @ x)
        out[:, k] = x / np.linalg.norm(x)
    return out


def eigenpairs(matrix: np.ndarray, k: int, cluster: float = 1e-3) -> tuple[np.ndarray, np.ndarray]:
    """(values, vectors as columns) of the at most k leading eigenpairs of a covariance matrix
    that differ from zero."""
    scale = np.abs(matrix).max(initial=0.0)
    if scale == 0:
        return np.zeros(0), np.zeros((len(matrix), 0))
    diagonal, off, reflectors = tridiagonal(matrix / scale)
    values = leading_values(diagonal, off, min(k, len(matrix)))
    values = values[values > 8 * len(matrix) * _EPS * np.abs(diagonal).max()]
    vectors = leading_vectors(diagonal, off, values, cluster)
    for j in range(len(reflectors) - 1, -1, -1):
        v, part = reflectors[j], vectors[j + 1:]
        part -= 2 * np.outer(v, v @ part)
    top = vectors[np.abs(vectors).argmax(axis=0), np.arange(vectors.shape[1])]
    return values * scale, vectors * np.where(top < 0, -1.0, 1.0)


def whole(docs: DataFrame, setting: Settings, vector: str = "embedding", key: str = "vec_id") -> DataFrame:
    """(vec_id, x): the whole-numbered vectors of the rows that take part, as little-endian longs."""
    kind = docs.schema[key].dataType.simpleString()

    def convert(batches):
        for batch in batches:
            at, values = batch["_v"].offsets.to_numpy(), batch["_v"].flatten()
            c = values.to_numpy(zero_copy_only=False).astype(float)
            at = at - at[0]
            bad = np.r_[0, np.cumsum(~np.isfinite(c))]
            keep = np.flatnonzero((at[1:] > at[:-1]) & (bad[at[1:]] == bad[at[:-1]]))
            with np.errstate(over="ignore", invalid="ignore"):
                x = np.clip(np.floor(setting.scale * c), -_WIDEST, _WIDEST)
            x = np.where(np.isfinite(x), x, 0).astype("<i8") + setting.shift
            rows = [x[at[i]:at[i + 1]].tobytes() for i in keep]
            yield pa.RecordBatch.from_arrays(
                [batch[key].take(pa.array(keep)), pa.array(rows, pa.binary())], [key, "x"])

    vectors = docs.where(F.col(vector).isNotNull()).select(
        key, F.col(vector).cast("array<double>").alias("_v"))
    vectors = store.keep(vectors.mapInArrow(convert, f"{key} {kind}, x binary"))
    lengths = vectors.groupBy(F.length("x").alias("n")).count()
    most = lengths.orderBy(F.desc("count"), "n").first()
    if most is None:
        return vectors
    if most["n"] > 8 * setting.max_dims:
        raise ValueError(f"vectors of {most['n'] // 8} entries; max_dims is {setting.max_dims}")
    return vectors.where(F.length("x") == most["n"])


def _rows(column: pa.Array, d: int) -> np.ndarray:
    """A binary column of equal-length vectors as a matrix."""
    return np.frombuffer(b"".join(column.to_pylist()), "<i8").reshape(-1, d)


def sums(fit: DataFrame, d: int) -> tuple[int, list[int]]:
    """(n, sums per dimension) of the fit list, exact beyond 64 bits: high and low halves of the
    entries are summed apart, one row per task and dimension, and added by dimension."""

    def add(batches):
        n, low, high = 0, np.zeros(d, np.int64), np.zeros(d, np.int64)
        for batch in batches:
            x = _rows(batch["x"], d)
            n += len(x)
            low += (x & 0xFFFFFFFF).sum(axis=0)
            high += (x >> 32).sum(axis=0)
        yield pa.RecordBatch.from_arrays(
            [pa.array(np.arange(d)), pa.array([n] * d), pa.array(low), pa.array(high)], ["i", "n", "low", "high"])

    total = (fit.select("x").mapInArrow(add, "i long, n long, low long, high long").groupBy("i")
             .agg(F.sum("n").alias("n"), F.sum(F.col("low").cast("decimal(38,0)")).alias("low"),
                  F.sum(F.col("high").cast("decimal(38,0)")).alias("high")).orderBy("i").collect())
    if not total:
        return 0, []
    return int(total[0]["n"]), [(int(r["high"]) << 32) + int(r["low"]) for r in total]


class Centre:
    """The mean S/n as a whole part and a fraction below one, so that x - S/n loses nothing to
    the size of S."""

    def __init__(self, n: int, total: list[int]) -> None:
        self.base = np.array([s // n for s in total], np.int64)
        self.rest = np.array([float(Fraction(s % n, n)) for s in total])

    def __call__(self, x: np.ndarray) -> np.ndarray:
        return (x - self.base).astype(float) - self.rest


def product(fit: DataFrame, d: int, k: int, transform, tasks: int) -> np.ndarray:
    """The k x k sum of outer products of ``transform(x)`` over all rows. At most ``tasks`` tasks
    hand over a matrix each, row by row, and rows of equal number are added in Spark."""

    def fold(batches):
        total = np.zeros((k, k))
        for batch in batches:
            x = _rows(batch["x"], d)
            for start in range(0, len(x), 4096):
                y = transform(x[start:start + 4096])
                total += y.T @ y
        yield pa.RecordBatch.from_arrays(
            [pa.array(np.arange(k)), pa.array([r.tobytes() for r in total], pa.binary())], ["i", "row"])

    def add(key: tuple[pa.Scalar, ...], batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(k)
        for batch in batches:
            for row in batch["row"]:
                total += np.frombuffer(row.as_py(), float)
        yield pa.RecordBatch.from_arrays([pa.array([key[0].as_py()]), pa.array([total.tobytes()], pa.binary())], ["i", "row"])

    found = (fit.select("x").coalesce(tasks).mapInArrow(fold, "i long, row binary").groupBy("i")
             .applyInArrow(add, "i long, row binary").collect())
    out = np.zeros((k, k))
    for r in found:
        out[r["i"]] = np.frombuffer(bytes(r["row"]), float)
    return (out + out.T) / 2


def whiten(vectors: DataFrame, setting: Settings = Settings(), vector: str = "embedding", key: str = "vec_id") -> DataFrame:
    """vec_id, component, n, deviation, whitened, explained, identity_error of every row and component."""
    kind = vectors.schema[key].dataType.simpleString()
    shape = (f"{key} {kind}, component int, n long, deviation long, whitened double, explained double, "
             "identity_error double")
    rows = whole(vectors, setting, vector, key)
    fit = store.keep(rows.select("x").distinct())
    first = fit.first()
    d = len(first["x"]) // 8 if first else 0
    n, total = sums(fit, d) if first else (0, [])
    if n == 0:
        return rows.where("false").selectExpr(
            f"`{key}`", "0 AS component", "0L AS n", "0L AS deviation", "0D AS whitened", "0D AS explained",
            "0D AS identity_error")
    centre = Centre(n, total)
    covariance = product(fit, d, d, centre, setting.max_tasks) / n
    values, axes = eigenpairs(covariance, setting.components, setting.cluster)
    k, trace = len(values), float(np.trace(covariance))
    projection = axes / np.sqrt(values)
    error = (float(np.abs(product(fit, d, k, lambda x: centre(x) @ projection, setting.max_tasks) / n - np.eye(k)).max()) if k else 0.0)
    share, number = values / trace if k else values, np.arange(1, k + 1, dtype=np.int32)

    def deviation(x: np.ndarray) -> list[int | None]:
        whole_part = x - centre.base
        rest = np.array([s % n for s in total], np.int64)
        widest = int(np.abs(whole_part).max(initial=0)) + 1
        if (widest * n) ** 2 * d < 1 << 62:
            return ((whole_part * n - rest) ** 2).sum(axis=1).tolist()
        exact = [sum((n * int(a) - int(b)) ** 2 for a, b in zip(r, rest)) for r in whole_part]
        return [v if v < 1 << 63 else None for v in exact]

    def project(batches):
        for batch in batches:
            for start in range(0, batch.num_rows if k else 0, 2048):
                part = batch.slice(start, 2048)
                x = _rows(part["x"], d)
                m = len(x)
                owner = pa.array(np.repeat(np.arange(m), k))
                yield pa.RecordBatch.from_arrays(
                    [part[key].take(owner), pa.array(np.tile(number, m)), pa.array(np.full(m * k, n)),
                     pa.array(deviation(x), pa.int64()).take(owner), pa.array((centre(x) @ projection).ravel()),
                     pa.array(np.tile(share, m)), pa.array(np.full(m * k, error))],
                    [key, "component", "n", "deviation", "whitened", "explained", "identity_error"])

    return rows.mapInArrow(project, shape)
