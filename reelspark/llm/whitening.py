"""Operator 11: embedding whitening by spectral divide and conquer.

Entries become whole numbers, each distinct vector counts once (copies are combined before the shuffle), and tasks add up sums and
centred products, so that only a d x d covariance comes to the driver. There QDWH iterations give the polar factor of the
covariance less a shift; it has eigenvalues 1 and -1, so it makes the spectral projector of the eigenvalues above
the shift. Bases of the projector and of its complement split the space into two invariant subspaces, which are split in turn
until each is one component (or a multiple of the identity, where any basis serves). The projection on the leading components,
d x k numbers, is broadcast and applied to every row, copies too.

Edge cases: rows whose vector is null, empty, or holds a null or non-finite entry are dropped; where vectors differ in length, the most
frequent length stays (of equally frequent ones the longest); entries beyond 9e15 / 64 count as that; components without
variance (fewer distinct vectors than dimensions, one vector only) are not returned; a deviation that no long can hold is
null; a null or repeated vec_id stays as it is; an empty table gives an empty result; other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F

from .common import Tables

K = 16
SCALE, SHIFT, MOST = 64, 1_000_000, 9e15
EPS = np.finfo(np.float64).eps
SLICE = 4096

RESULT = "vec_id long, component int, n long, deviation long, whitened double, explained double, identity_error double"


# ---- spectral divide and conquer of a symmetric matrix


def polar(a: np.ndarray) -> np.ndarray:
    """The orthogonal polar factor of a regular symmetric matrix, by QR-based dynamically weighted Halley steps."""
    n = len(a)
    x = a / np.linalg.norm(a)
    try:
        low = min(1.0, 1 / np.linalg.norm(np.linalg.inv(x)))  # at most the least singular value
    except np.linalg.LinAlgError:
        low = EPS
    low = max(low, EPS * EPS)
    for _ in range(60):
        d = np.cbrt(4 * (1 - low**2) / low**4)
        wa = np.sqrt(1 + d) + 0.5 * np.sqrt(max(0.0, 8 - 4 * d + 8 * (2 - low**2) / (low**2 * np.sqrt(1 + d))))
        wb = (wa - 1) ** 2 / 4
        wc = wa + wb - 1
        q, _ = np.linalg.qr(np.vstack([np.sqrt(wc) * x, np.eye(n)]))
        new = wb / wc * x + (wa - wb / wc) / np.sqrt(wc) * (q[:n] @ q[n:].T)
        new = (new + new.T) / 2
        low = min(1.0, low * (wa + wb * low**2) / (1 + wc * low**2))
        moved, x = np.linalg.norm(new - x), new
        if 1 - low < 4 * EPS and moved < 1e-8:
            break
    return x


def split(a: np.ndarray, scale: float) -> tuple[np.ndarray, np.ndarray] | None:
    """Orthonormal bases of two complementary invariant subspaces of a; None where a is a multiple of the identity as far as
    doubles tell, against `scale`."""
    n = len(a)
    radius = np.abs(a).sum(1) - np.abs(np.diag(a))
    lo, hi = float((np.diag(a) - radius).min()), float((np.diag(a) + radius).max())
    shift = float(np.median(np.diag(a)))
    rng = np.random.default_rng(n)
    while hi - lo > 4 * n * EPS * scale:
        if not lo < shift < hi:
            shift = (lo + hi) / 2
        u = polar(a - shift * np.eye(n))
        if np.linalg.norm(u @ u - np.eye(n)) > 1e-6:  # an eigenvalue lies on the shift
            shift += (hi - lo) * rng.uniform(-0.05, 0.05)
            continue
        p = (np.eye(n) + u) / 2
        k = round(float(np.trace(p)))
        if 0 < k < n:
            q, _ = np.linalg.qr(p @ rng.standard_normal((n, k)))
            q, _ = np.linalg.qr(p @ q)
            whole, _ = np.linalg.qr(np.hstack([q, rng.standard_normal((n, n - k))]))
            return whole[:, :k], whole[:, k:]
        lo, hi = (shift, hi) if k else (lo, shift)
        shift = (lo + hi) / 2
    return None


def spectrum(v: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Eigenvalues in falling order and unit eigenvectors as columns; of each, the largest entry is positive."""
    scale, open_, parts = float(np.linalg.norm(v)), [np.eye(len(v))], []
    while open_:
        basis = open_.pop()
        a = basis.T @ v @ basis
        halves = split((a + a.T) / 2, scale) if basis.shape[1] > 1 else None
        if halves is None:
            parts.append(basis)
        else:
            open_ += [basis @ h for h in halves]
    q, _ = np.linalg.qr(np.hstack(parts))
    e = np.einsum("ij,ij->j", q, v @ q)
    order = np.argsort(-e, kind="stable")
    q = q[:, order]
    return e[order], q * np.sign(q[np.abs(q).argmax(0), np.arange(len(v))])


# ---- sums over the distinct vectors


class Centre(NamedTuple):
    """Number and per-dimension sums of the distinct vectors."""

    n: int
    sums: list[int]

    def offsets(self, x: np.ndarray) -> np.ndarray:
        """n * x - S, exact: 64-bit where that holds it, else Python's whole numbers."""
        most = max(int(np.abs(x).max(initial=0)), 1)
        if 2 * self.n * most < 2**62 and max(map(abs, self.sums)) < 2**62:
            return self.n * x - np.array(self.sums, np.int64)
        return self.n * x.astype(object) - np.array(self.sums, object)


def matrix(column: pa.Array, d: int) -> np.ndarray:
    """Vectors of equal length as rows."""
    return column.flatten().to_numpy(zero_copy_only=False).astype(np.int64).reshape(-1, d)


def products(centre: Centre, projection: np.ndarray | None = None) -> Callable:
    """(i, total, row) of a task's vectors: sums of their centred entries and of those entries' products, after a projection if one is
    given."""
    d = len(centre.sums)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        k = d if projection is None else projection.shape[1]
        total, gram = np.zeros(k), np.zeros((k, k))
        for b in batches:
            for i in range(0, b.num_rows, SLICE):
                y = centre.offsets(matrix(b.column(0).slice(i, SLICE), d)).astype(np.float64) / centre.n
                y = y if projection is None else y @ projection
                total += y.sum(0)
                gram += y.T @ y
        yield pa.RecordBatch.from_arrays([pa.array(range(k), pa.int32()), pa.array(total), pa.array(list(gram), pa.list_(pa.float64()))], names=["i", "total", "row"])

    return run


def covariance(fit: DataFrame, centre: Centre, projection: np.ndarray | None = None) -> np.ndarray:
    """Covariance of the vectors (after the projection), added up over tasks: d numbers for each of d rows."""
    k = len(centre.sums) if projection is None else projection.shape[1]
    parts = fit.select("x").mapInArrow(products(centre, projection), "i int, total double, row array<double>")
    sums = parts.groupBy("i").agg(F.sum("total").alias("total"), F.array(*[F.sum(F.col("row")[j]) for j in range(k)]).alias("row")).collect()
    mean, gram = np.zeros(k), np.zeros((k, k))
    for r in sums:
        mean[r["i"]], gram[r["i"]] = r["total"] / centre.n, np.array(r["row"]) / centre.n
    return (gram + gram.T) / 2 - np.outer(mean, mean)


class Whitening(NamedTuple):
    """What is broadcast: the centre, k components over the roots of their eigenvalues, and shares of the variance."""

    centre: Centre
    projection: np.ndarray
    explained: np.ndarray
    identity_error: float


def whole(c: Column) -> Column:
    return F.floor(F.greatest(F.least(c * SCALE, F.lit(MOST)), F.lit(-MOST))) + F.lit(SHIFT).cast("long")


def usable(embeddings: DataFrame) -> DataFrame:
    """(vec_id, x) of the rows that remain, with vectors of one length."""
    v = F.col("_v")
    broken = F.exists(v, lambda c: F.coalesce(F.isnan(c) | (F.abs(c) == float("inf")), F.lit(True)))
    rows = embeddings.select(F.col("vec_id").cast("long").alias("vec_id"), F.col("embedding").cast("array<double>").alias("_v"))
    rows = rows.filter(v.isNotNull() & (F.size(v) > 0) & ~broken)
    length = rows.groupBy(F.size(v).alias("d")).count().orderBy(F.desc("count"), F.desc("d")).first()
    return rows.filter(F.size(v) == (length["d"] if length else 0)).select("vec_id", F.transform(v, whole).alias("x"))


def fit_whitening(rows: DataFrame, k: int = K) -> Whitening | None:
    """The whitening of (vec_id, x) rows; None where there is no row."""
    t = Tables(rows.sparkSession)
    fit = t(rows.select("x").distinct(), "fit")
    first = fit.first()
    if first is None:
        t.drop(fit)
        return None
    d = len(first["x"])
    exact = [F.sum(F.col("x")[j].cast("decimal(20,0)")) for j in range(d)]
    n, *sums = fit.agg(F.count("*"), *exact).first()
    centre = Centre(n, [int(s) for s in sums])
    v = covariance(fit, centre)
    e, q = spectrum(v)
    k = min(k, int((e > d * EPS * max(e[0], 0.0)).sum())) if e[0] > 0 else 0
    projection = q[:, :k] / np.sqrt(e[:k])
    error = float(np.abs(covariance(fit, centre, projection) - np.eye(k)).max()) if k else 0.0
    t.drop(fit)
    return Whitening(centre, projection, e[:k] / np.trace(v) if k else e[:0], error)


def applied(shared) -> Callable:
    """A row for each vector and component."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        centre, projection, explained, error = shared.value
        d, k = projection.shape
        for b in batches:
            for i in range(0, b.num_rows, SLICE):
                part = b.slice(i, SLICE)
                away = centre.offsets(matrix(part.column(1), d))
                wide = away.dtype == object or d * float(np.abs(away).max(initial=0)) ** 2 > 2**62
                squares = (away.astype(object) ** 2).sum(1).tolist() if wide else (away**2).sum(1).tolist()
                squares = pa.array([s if s < 2**63 else None for s in squares], pa.int64())
                white = (away.astype(np.float64) / centre.n) @ projection
                row = pa.array(np.repeat(np.arange(part.num_rows), k))
                size = part.num_rows * k
                yield pa.RecordBatch.from_arrays([
                    part.column(0).take(row), pa.array(np.tile(np.arange(1, k + 1, dtype=np.int32), part.num_rows)), pa.array(np.full(size, centre.n, np.int64)),
                    squares.take(row), pa.array(white.ravel()), pa.array(np.tile(explained, part.num_rows)), pa.array(np.full(size, error)),
                ], names=[f.split()[0] for f in RESULT.split(", ")])

    return run


def whiten(embeddings: DataFrame, k: int = K) -> DataFrame:
    """(vec_id, component, n, deviation, whitened, explained, identity_error) for every remaining row and component."""
    rows = usable(embeddings)
    model = fit_whitening(rows, k)
    if model is None or not len(model.explained):
        return embeddings.sparkSession.createDataFrame([], RESULT)
    return rows.mapInArrow(applied(rows.sparkSession.sparkContext.broadcast(model)), RESULT)
