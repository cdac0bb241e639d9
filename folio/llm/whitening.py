"""Whitening of embeddings by spectral divide and conquer.

Method: the covariance, shifted, has a polar factor whose +1 and -1 spaces are those of the eigenvalues above and below the
shift.  QDWH iterations (inverse-free, by QR factors, then by Cholesky factors) find the polar factor; (I + U) / 2 projects on the
upper space, an orthonormal base of which and of its complement splits the covariance in two smaller ones.  Splitting goes on
until spaces have one dimension or one eigenvalue, and only where leading components are still missing.  The components, a
matrix of bounded size, are broadcast, and every row is whitened where it lies.

Entries are whole numbers, so sums and products over the fit list are exact: tasks hand in integer sums of any size, which Spark
adds up as decimals.  What comes to the driver has the size of a covariance, whatever the number of rows.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator
from decimal import Decimal
from fractions import Fraction

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from folio.llm.common import register, released, table
from folio.session import materialise

SCALE = 256.0
COMPONENTS = 4
LIMB = 62
EXACT = 2**53
LEAST_SHARE = 1e-12  # a component with less of the variance counts as having none
TURNS = 60


# --- spectral divide and conquer -------------------------------------------------------------------------------------

def polar(a: np.ndarray, most: float, least: float) -> np.ndarray:
    """The orthogonal polar factor of a symmetric matrix by QDWH; its norm is ``most`` or less, its singular values about ``least`` or more."""
    n = len(a)
    x, low = a / most, max(least / most, np.finfo(float).eps)
    eye = np.eye(n)
    for _ in range(TURNS):
        d = np.cbrt(4 * (1 - low**2) / low**4)
        top = math.sqrt(1 + d) + 0.5 * math.sqrt(max(8 - 4 * d + 8 * (2 - low**2) / (low**2 * math.sqrt(1 + d)), 0.0))
        b = (top - 1) ** 2 / 4
        c = top + b - 1
        if c > 100:  # by QR factors, which do not square what is badly conditioned
            q, _ = np.linalg.qr(np.vstack([math.sqrt(c) * x, eye]))
            new = (b / c) * x + (top - b / c) / math.sqrt(c) * (q[:n] @ q[n:].T)
        else:
            w = np.linalg.cholesky(eye + c * (x.T @ x))
            new = (b / c) * x + (top - b / c) * np.linalg.solve(w.T, np.linalg.solve(w, x.T)).T
        new = (new + new.T) / 2
        low = min(1.0, low * (top + b * low**2) / (1 + c * low**2))
        moved = np.linalg.norm(new - x)
        x = new
        if abs(1 - low) < 1e-14 and moved < 1e-9:
            break
    return x


def split(a: np.ndarray, shift: float) -> tuple[np.ndarray, np.ndarray] | None:
    """Orthonormal bases of the spaces of eigenvalues above and below ``shift``, or None if the shift does not part them."""
    n = len(a)
    moved = a - shift * np.eye(n)
    most = float(np.sqrt(np.linalg.norm(moved, 1) * np.linalg.norm(moved, np.inf)))
    if most == 0:
        return None
    u = polar(moved, most, most * 1e-15)
    above = (u + np.eye(n)) / 2
    k = round(float(np.trace(above)))
    if not 0 < k < n or np.linalg.norm(above @ above - above) > 1e-6 * n:
        return None
    # a base of the projector's range: its image of fixed directions, orthonormalised twice
    seed = np.random.default_rng(n).standard_normal((n, n))
    q, _ = np.linalg.qr(np.hstack([above @ seed[:, :k], seed[:, k:] - above @ seed[:, k:]]))
    q, _ = np.linalg.qr(np.hstack([above @ q[:, :k], q[:, k:] - above @ q[:, k:]]))
    return q[:, :k], q[:, k:]


def leading(v: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """The ``k`` largest eigenvalues of a symmetric matrix, falling, and their unit eigenvectors as columns."""
    scale = float(np.abs(v).max(initial=0.0))
    values, vectors = [], []

    def down(base: np.ndarray) -> None:
        """Add the components of the space of ``base``, from the largest, until there are ``k``."""
        if len(values) >= k:
            return
        n = base.shape[1]
        a = base.T @ v @ base
        a = (a + a.T) / 2
        if n == 1:
            values.append(float(a[0, 0]))
            vectors.append(base[:, 0])
            return
        middle = float(np.trace(a)) / n
        spread = np.linalg.norm(a - middle * np.eye(n))
        if spread <= n * np.finfo(float).eps * scale:  # one eigenvalue: any base will do
            for j in range(n):
                values.append(float(a[j, j]))
                vectors.append(base[:, j])
            return
        parts = None
        if n == 2:  # the two eigenvalues lie on either side of the mean
            parts = split(a, middle)
        else:
            wanted = np.sort(np.diag(a))
            for shift in (float(np.median(wanted)), middle, *(middle + f * spread / math.sqrt(n) for f in (0.07, -0.07, 0.19, -0.19, 0.41, -0.41))):
                parts = split(a, shift)
                if parts is not None:
                    break
        if parts is None:
            raise ArithmeticError("no shift parts the spectrum")
        down(base @ parts[0])
        down(base @ parts[1])

    down(np.eye(len(v)))
    order = np.argsort(-np.array(values), kind="stable")[:k]
    return np.array(values)[order], np.array(vectors).T[:, order] if vectors else np.zeros((len(v), 0))


# --- exact sums --------------------------------------------------------------------------------------------------------

def whole(vectors: DataFrame, scale: float = SCALE, vector: str = "embedding", vec_id: str = "vec_id") -> DataFrame:
    """(vec_id, dim, x): components as floor(scale * c), as longs; rows whose vector is null or has a null or non-finite entry are left out.

    An entry beyond the range of a long is taken at its limit.
    """
    bad = F.exists(vector, lambda c: c.isNull() | F.isnan(c.cast("double")) | (F.abs(c.cast("double")) == float("inf")))
    def entry(c):
        y = F.lit(scale) * c.cast("double")
        inside = (y < 2.0**63) & (y >= -(2.0**63))
        return F.when(inside, F.floor(F.when(inside, y).otherwise(F.lit(0.0)))).when(y > 0, F.lit(2**63 - 1)).otherwise(F.lit(-(2**63)))
    return vectors.where(F.col(vector).isNotNull() & ~F.coalesce(bad, F.lit(True))).select(
        F.col(vec_id).cast("bigint").alias("vec_id"), F.size(vector).alias("dim"), F.transform(vector, entry).alias("x"))


def _stacked(batch: pa.RecordBatch) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """(dim, places, vectors) for each length of vector in a batch with ``dim`` and ``x``."""
    dims = batch.column("dim").to_numpy()
    for dim in np.unique(dims).tolist():
        at = np.nonzero(dims == dim)[0]
        part = batch.column("x") if len(at) == len(dims) else batch.column("x").take(pa.array(at))
        yield dim, at, part.flatten().to_numpy(zero_copy_only=False).reshape(len(at), dim)


def _exact(x: np.ndarray, factor: int) -> np.ndarray:
    """``x``, or as Python's unbounded integers where products with ``factor`` might leave the range of a long."""
    most = max(abs(int(x.max(initial=0))), abs(int(x.min(initial=0))))
    return x if most * factor < 2**62 else x.astype(object)


def column_sums(x: np.ndarray) -> list[int]:
    return [int(s) for s in _exact(x, len(x)).sum(axis=0)]


def products(y: np.ndarray) -> np.ndarray:
    """Exact y' y as Python integers: by double precision where every sum fits it, else in integers."""
    most = max(abs(int(y.max(initial=0))), abs(int(y.min(initial=0))))
    if most * most * len(y) < EXACT:
        f = y.astype(np.float64)
        return (f.T @ f).astype(np.int64).astype(object)
    o = y.astype(object)
    return o.T @ o


def _summed(rows: DataFrame, cells: Callable[[int, np.ndarray], list[int]]) -> dict[int, list[int]]:
    """Per length of vector the sums over all rows of what ``cells`` (dim, vectors) gives for a batch, exact at any size.

    A task adds its batches up and hands in one row a cell, in two limbs; Spark adds these, map side first.
    """
    amount = pa.decimal128(38, 0)

    def run(batches):
        total: dict[int, list[int]] = {}
        for b in batches:
            for dim, _, x in _stacked(b):
                new = cells(dim, x)
                total[dim] = [p + q for p, q in zip(total[dim], new, strict=True)] if dim in total else new
        for dim, sums in total.items():
            limbs = [(s >> LIMB, s & ((1 << LIMB) - 1)) for s in sums]
            yield pa.RecordBatch.from_arrays(
                [pa.array([dim] * len(sums), pa.int32()), pa.array(range(len(sums)), pa.int32()),
                 *(pa.array([Decimal(limb[i]) for limb in limbs], amount) for i in range(2))], names=["dim", "cell", "hi", "lo"])

    parts = rows.select("dim", "x").mapInArrow(lambda b: released(run(b)), "dim int, cell int, hi decimal(38,0), lo decimal(38,0)")
    whole_sums = parts.groupBy("dim", "cell").agg(F.sum("hi").alias("hi"), F.sum("lo").alias("lo")).collect()
    out: dict[int, dict[int, int]] = {}
    for r in whole_sums:
        out.setdefault(r["dim"], {})[r["cell"]] = (int(r["hi"]) << LIMB) + int(r["lo"])
    return {dim: [cells_[i] for i in range(len(cells_))] for dim, cells_ in out.items()}


def _rounded_mean(total: int, n: int) -> int:
    return (2 * total + n) // (2 * n)


class Fit:
    """Mean, covariance and leading components of one fit list of vectors of ``dim`` entries."""

    def __init__(self, dim: int, n: int, sums: list[int], centre: list[int], gram: np.ndarray, offset: list[int], k: int):
        self.dim, self.n, self.sums = dim, n, sums
        # gram and offset are of vectors less ``centre``; what is left of the mean is taken out exactly before division
        top = [[n * int(gram[i, j]) - offset[i] * offset[j] for j in range(dim)] for i in range(dim)]
        self.covariance = np.array([[float(Fraction(t, n * n)) for t in row] for row in top]).reshape(dim, dim)
        trace = Fraction(sum(top[i][i] for i in range(dim)), n * n)
        self.values, self.vectors = leading(self.covariance, min(k, dim))
        total = float(trace)
        self.alive = self.values > LEAST_SHARE * total if total > 0 else np.zeros(len(self.values), bool)
        self.explained = [float(e) / total if total > 0 else None for e in self.values]
        self.base = self.vectors[:, self.alive] / np.sqrt(self.values[self.alive])
        self.identity_error: float | None = None

    def centred(self, x: np.ndarray) -> np.ndarray:
        """n * x - sums, exact."""
        most = max(abs(int(x.max(initial=0))), abs(int(x.min(initial=0)))) * self.n + max(map(abs, self.sums), default=0)
        kind = np.int64 if most < 2**62 else object
        return x.astype(kind) * self.n - np.array(self.sums, dtype=kind)

    def whitened(self, x: np.ndarray) -> np.ndarray:
        return (self.centred(x) / self.n).astype(np.float64) @ self.base


def fit(rows: DataFrame, k: int = COMPONENTS) -> dict[int, Fit]:
    """The fit of ``rows`` (dim, x), as :func:`whole` gives them, one for each length of vector; every distinct vector counts once."""
    distinct = materialise(rows.select("dim", "x").where("dim > 0").groupBy("dim", "x").count().select("dim", "x"))
    first = _summed(distinct, lambda dim, x: [len(x), *column_sums(x)])
    centres = {dim: [_rounded_mean(s, got[0]) for s in got[1:]] for dim, got in first.items()}
    upper = {dim: np.triu_indices(dim) for dim in first}

    def second(dim: int, x: np.ndarray) -> list[int]:
        c = np.array(centres[dim], dtype=object)
        inside = max(abs(int(x.max(initial=0))), abs(int(x.min(initial=0))), max(map(abs, centres[dim]))) < 2**61
        y = x - c.astype(np.int64) if inside else x.astype(object) - c
        return [*column_sums(y), *products(y)[upper[dim]].tolist()]

    fits = {}
    for dim, got in _summed(distinct, second).items():
        gram = np.zeros((dim, dim), dtype=object)
        gram[upper[dim]] = got[dim:]
        gram = gram + gram.T - np.diag(np.diag(gram))
        fits[dim] = Fit(dim, first[dim][0], first[dim][1:], centres[dim], gram, got[:dim], k)
    for dim, error in _identity_errors(distinct, fits).items():
        fits[dim].identity_error = error
    return fits


def _identity_errors(distinct: DataFrame, fits: dict[int, Fit]) -> dict[int, float]:
    """Per length of vector the largest entry of the whitened fit list's covariance less the identity, measured on all of it.

    Tasks hand in count, mean and centred products, which merge without cancellation.
    """
    known = distinct.sparkSession.sparkContext.broadcast(fits)

    def merged(a, b):
        n = a[0] + b[0]
        gap = b[1] - a[1]
        return n, a[1] + gap * (b[0] / n), a[2] + b[2] + np.outer(gap, gap) * (a[0] * b[0] / n)

    def run(batches):
        total = {}
        for b in batches:
            for dim, _, x in _stacked(b):
                w = known.value[dim].whitened(x)
                mean = w.mean(axis=0)
                new = (len(w), mean, (w - mean).T @ (w - mean))
                total[dim] = merged(total[dim], new) if dim in total else new
        for dim, (n, mean, m) in total.items():
            yield pa.RecordBatch.from_arrays([pa.array([dim], pa.int32()), pa.array([n], pa.int64()), pa.array([mean.tolist()], pa.list_(pa.float64())), pa.array([m.ravel().tolist()], pa.list_(pa.float64()))], names=["dim", "n", "mean", "m"])

    def joined(batches):
        total = {}
        for b in batches:
            for r in b.to_pylist():
                size = len(r["mean"])
                new = (r["n"], np.array(r["mean"]), np.array(r["m"]).reshape(size, size))
                total[r["dim"]] = merged(total[r["dim"]], new) if r["dim"] in total else new
        for dim, (n, _, m) in total.items():
            yield pa.RecordBatch.from_arrays([pa.array([dim], pa.int32()), pa.array([float(np.abs(m / n - np.eye(len(m))).max()) if len(m) else None], pa.float64())], names=["dim", "error"])

    parts = distinct.mapInArrow(lambda b: released(run(b)), "dim int, n bigint, mean array<double>, m array<double>")
    return {r["dim"]: r["error"] for r in parts.coalesce(1).mapInArrow(joined, "dim int, error double").collect()}


OUT = "vec_id bigint, component int, n bigint, deviation bigint, whitened double, explained double, identity_error double, deviation_text string"


def whiten(rows: DataFrame, fits: dict[int, Fit]) -> DataFrame:
    """vec_id, component (from 1), n, deviation, whitened, explained, identity_error and deviation_text for each row of ``rows``.

    ``rows`` comes from :func:`whole`, ``fits`` from :func:`fit`.  ``deviation`` is the exact sum of (n * x - sums) ** 2 and null
    where it leaves the range of a long; ``deviation_text`` has its digits at any size.  A component without variance (share
    below ``LEAST_SHARE``) has no whitened value.  Vectors are whitened with the fit of their own length; those without
    entries, or of a length without a fit, give no rows.  Repeated rows and null or repeated ids are whitened like any other.
    """
    known = rows.sparkSession.sparkContext.broadcast(fits)

    def run(batches):
        for b in batches:
            ids = b.column("vec_id").to_numpy(zero_copy_only=False) if not b.column("vec_id").null_count else np.array(b.column("vec_id").to_pylist(), dtype=object)
            for dim, at, x in _stacked(b):
                f = known.value.get(dim)
                if f is None:
                    continue
                d = f.centred(x)
                most = max(abs(int(d.max(initial=0))), abs(int(d.min(initial=0))))
                d2 = d if most * most * dim < 2**62 else d.astype(object)
                dev = [int(v) for v in (d2 * d2).sum(axis=1)]
                k = len(f.values)
                w = np.full((len(x), k), None, dtype=object)
                w[:, f.alive] = (d / f.n).astype(np.float64) @ f.base
                rep = lambda v: [e for e in v for _ in range(k)]
                n = len(x) * k
                yield pa.RecordBatch.from_arrays(
                    [pa.array(rep(ids[at].tolist()), pa.int64()), pa.array(list(range(1, k + 1)) * len(x), pa.int32()), pa.array([f.n] * n, pa.int64()),
                     pa.array(rep([v if v < 2**63 else None for v in dev]), pa.int64()), pa.array(w.ravel().tolist(), pa.float64()),
                     pa.array(f.explained * len(x), pa.float64()), pa.array([f.identity_error] * n, pa.float64()), pa.array(rep([str(v) for v in dev]))],
                    names=["vec_id", "component", "n", "deviation", "whitened", "explained", "identity_error", "deviation_text"])

    return rows.where("dim > 0").mapInArrow(lambda b: released(run(b)), OUT)


@register
def op13_whitening(spark: SparkSession, sf: str) -> DataFrame:
    """All embeddings on the leading components of their covariance, each of unit variance."""
    rows = whole(table(spark, sf, "embeddings"))
    return whiten(rows, fit(rows))
