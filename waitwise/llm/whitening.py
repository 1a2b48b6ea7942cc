"""Whitening of embeddings by Chebyshev-filtered subspace iteration.

Entries are quantised to integers, so means and deviations are exact: a row's centred entry is the integer
n * x - S over n, and nothing is lost by subtracting two large numbers. The covariance is never formed. Each
pass sends a narrow block Q (dimensions x block) to the rows and sums XᵀXQ of the centred rows in the tasks; a
three-term recurrence over such passes is a Chebyshev polynomial of the covariance that stays within 1 on the
unwanted part of the spectrum and grows fast above it. After each polynomial, QR and a Rayleigh-Ritz step on the
block give eigenvalue estimates with residuals; the iteration ends when every wanted residual is at rounding
level (certified) and raises if that is not reached. The interval that is damped runs from a lower bound of the
spectrum (a short Lanczos run, less its residual) to the smallest Ritz value of the block.

Driver data: matrices of dimensions x block, whatever the number of rows. Every pass is one stored scan and a
grouped sum, so lost executors cost a re-read.

Edge cases: vectors that are null, empty, or hold null or non-finite entries (or entries beyond 2**53 / 64, which
have no exact integer) take no part, neither do vectors whose length is not the commonest (ties: the longer); rows
without an id or with a repeated id are rows of their own; equal vectors count once in the fit; directions without
variance (up to rounding) have no whitened value, so there are fewer components than asked for when the rank is
lower, and no rows when all vectors are equal or the table is empty; a deviation beyond 64 bits is null; extra
columns are not used, whatever their names.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from waitwise.llm.common import stored

#: Quantisation: floor(SCALE * c) + OFFSET.
SCALE, OFFSET = 64, 1_000_000
#: Wanted components, passes of the Lanczos run for the lower bound, passes of a polynomial, polynomials at most.
COMPONENTS, LANCZOS, DEGREE, SWEEPS = 16, 8, 8, 60
#: Residual, relative to the largest eigenvalue, at which a component is certified; and the relative variance
#: below which a direction counts as having none.
TOLERANCE, FLAT = 4e-15, 1e-13
SEED = 20240607


def quantised(vector: Column, scale: int = SCALE, offset: int = OFFSET) -> Column:
    """Entries as integers; null if an entry is null, not finite, or too large for an exact integer."""
    v = vector.cast("array<double>")
    most = float(2**53) / scale
    ok = F.forall(v, lambda c: F.coalesce((F.abs(c) < most) & ~F.isnan(c), F.lit(False)))
    return F.when(ok & (F.size(v) > 0), F.transform(v, lambda c: F.floor(c * scale).cast("long") + F.lit(offset)))


def usable(vectors: DataFrame) -> tuple[DataFrame, int]:
    """(vec_id, x) of the rows that take part, and their dimension."""
    rows = vectors.select("vec_id", quantised(F.col("embedding")).alias("x")).filter(F.col("x").isNotNull())
    top = rows.groupBy(F.size("x").alias("d")).count().orderBy(F.desc("count"), F.desc("d")).first()
    dim = top["d"] if top else 0
    return rows.filter(F.size("x") == dim), dim


def _matrix(col: pa.Array, dim: int) -> np.ndarray:
    return np.asarray(col.flatten(), np.int64).reshape(-1, dim)


@dataclass
class Centre:
    """Number of fitted vectors and their exact sums."""

    n: int
    sums: np.ndarray

    def integers(self, x: np.ndarray) -> np.ndarray:
        """n * x - S, exactly."""
        # the shift keeps the product small: n * (x - c) - (S - n * c)
        c = self.sums // self.n
        y, rest = x - c, self.sums - self.n * c
        if len(y) and float(np.abs(y).max()) * self.n > 2.0**62:
            return (y.astype(object) * self.n) - rest.astype(object)
        return y * np.int64(self.n) - rest

    def centred(self, x: np.ndarray) -> np.ndarray:
        return self.integers(x).astype(np.float64) / self.n


def _summed(fit: DataFrame, dim: int, width: int, part: Callable[[np.ndarray], np.ndarray]) -> np.ndarray:
    """Sum over all rows of ``part(x)``, a matrix of some rows x ``width``: added up in each task, then grouped by row."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = None
        for b in batches:
            if b.num_rows:
                got = part(_matrix(b.column("x"), dim))
                total = got if total is None else total + got
        if total is not None:
            yield pa.RecordBatch.from_arrays([pa.array(np.arange(len(total), dtype=np.int32)), *[pa.array(np.ascontiguousarray(c)) for c in total.T]],
                                             names=["i", *[f"c{k}" for k in range(width)]])
    names = [f"c{k}" for k in range(width)]
    rows = fit.mapInArrow(run, "i int, " + ", ".join(f"{c} double" for c in names))
    got = rows.groupBy("i").agg(*[F.sum(c).alias(c) for c in names]).toArrow()
    out = np.zeros((int(np.asarray(got.column("i")).max(initial=-1)) + 1, width))
    for k, c in enumerate(names):
        out[np.asarray(got.column("i")), k] = np.asarray(got.column(c))
    return out


def fit_centre(fit: DataFrame, dim: int) -> Centre:
    """n and S: integer sums per dimension, in the tasks and then over them."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            x = _matrix(b.column("x"), dim)
            yield pa.RecordBatch.from_arrays([pa.array(np.arange(dim, dtype=np.int32)), pa.array(np.full(dim, len(x))), pa.array(x.sum(axis=0))], names=["i", "n", "s"])
    rows = fit.mapInArrow(run, "i int, n long, s long").groupBy("i").agg(F.sum("n").alias("n"), F.sum("s").alias("s")).orderBy("i").collect()
    return Centre(rows[0]["n"] if rows else 0, np.array([r["s"] for r in rows], np.int64))


@dataclass
class Whitening:
    """Fitted components: the columns of ``vectors`` with ``values`` by falling eigenvalue."""

    centre: Centre
    values: np.ndarray
    vectors: np.ndarray
    trace: float
    #: Largest residual of a component relative to the largest eigenvalue, and passes over the rows.
    residual: float
    passes: int
    identity_error: float = 0.0


class _Passes:
    """Products of the covariance with a block, one distributed pass each."""

    def __init__(self, fit: DataFrame, dim: int, centre: Centre):
        self._fit, self._dim, self._centre, self.count = fit, dim, centre, 0

    def __call__(self, q: np.ndarray) -> np.ndarray:
        centre, self.count = self._centre, self.count + 1

        def part(x: np.ndarray) -> np.ndarray:
            z = centre.centred(x)
            return z.T @ (z @ q)
        return _summed(self._fit, self._dim, q.shape[1], part) / centre.n

    def trace(self) -> float:
        centre = self._centre
        return float(_summed(self._fit, self._dim, 1, lambda x: (centre.centred(x) ** 2).sum(axis=0)[:, None]).sum()) / centre.n


def lower_bound(apply: Callable[[np.ndarray], np.ndarray], dim: int, steps: int = LANCZOS, seed: int = SEED) -> float:
    """A value near the smallest eigenvalue, from below: the smallest Ritz value of a Lanczos run, less its residual."""
    q = np.random.default_rng(seed).normal(size=dim)
    basis = [q / np.linalg.norm(q)]
    alpha, beta = [], []
    for _ in range(min(steps, dim)):
        w = apply(basis[-1][:, None])[:, 0]
        alpha.append(float(w @ basis[-1]))
        for _ in range(2):                            # fully orthogonalised: a handful of vectors
            w = w - np.array(basis).T @ (np.array(basis) @ w)
        beta.append(float(np.linalg.norm(w)))
        if beta[-1] <= 1e-12 * max(map(abs, alpha)):
            break
        basis.append(w / beta[-1])
    t, s = np.linalg.eigh(np.diag(alpha) + np.diag(beta[:-1], 1) + np.diag(beta[:-1], -1))
    return max(0.0, float(t[0] - abs(beta[-1] * s[-1, 0])))


def chebyshev(apply: Callable[[np.ndarray], np.ndarray], q: np.ndarray, vq: np.ndarray, degree: int, low: float, high: float, top: float) -> np.ndarray:
    """The scaled Chebyshev polynomial of ``degree`` on [low, high] times ``q``; ``vq`` is the first product, known already."""
    c, e = (high + low) / 2, (high - low) / 2
    sigma = first = e / (top - c)
    before, now = q, (vq - c * q) * (sigma / e)
    for _ in range(2, degree + 1):
        grown = 1 / (2 / first - sigma)
        before, now = now, 2 * (grown / e) * (apply(now) - c * now) - sigma * grown * before
        sigma = grown
    return now


def fit_whitening(fit: DataFrame, dim: int, components: int = COMPONENTS, seed: int = SEED) -> Whitening | None:
    """Leading components of the covariance of ``fit`` (distinct integer vectors x); None without any variance."""
    centre = fit_centre(fit, dim)
    if centre.n == 0:
        return None
    apply = _Passes(fit, dim, centre)
    trace = apply.trace()
    if trace <= 0:
        return None
    k = min(components, dim)
    block = min(dim, 2 * k + 4)
    q = np.eye(dim) if block == dim else np.linalg.qr(np.random.default_rng(seed).normal(size=(dim, block)))[0]
    low = 0.0 if block == dim else lower_bound(apply, dim)
    best, stale = np.inf, 0
    for _ in range(SWEEPS):
        vq = apply(q)
        h = q.T @ vq
        values, turn = np.linalg.eigh((h + h.T) / 2)
        values, turn = values[::-1], turn[:, ::-1]
        q, vq = q @ turn, vq @ turn
        wanted = values[:k] > FLAT * trace
        residual = float(np.linalg.norm(vq[:, :k] - q[:, :k] * values[:k], axis=0)[wanted].max(initial=0.0) / values[0])
        # rounding of the sums sets the floor: at it, a further polynomial no longer halves the residual
        stale = stale + 1 if residual > best / 2 else 0
        best = min(best, residual)
        if block == dim or residual <= TOLERANCE or (stale and residual <= 1e-12):
            k = int(wanted.sum())
            return Whitening(centre, values[:k], q[:, :k], trace, residual, apply.count)
        high, top = values[-1], values[0]
        if high <= FLAT * trace:                      # the block holds all there is: no spectrum left to damp
            high = values[:k][wanted][-1] / 4
        low = min(low, high / 2) if low >= high else low
        # growth of the largest and of the last wanted direction; their ratio must not drown the latter
        c, e = (high + low) / 2, (high - low) / 2
        grow = [np.arccosh(max((v - c) / e, 1.0 + 1e-12)) for v in (top, values[:k][wanted][-1])]
        degree = int(np.clip(np.log(1e10) / max(grow[0] - grow[1], 1e-9), 2, DEGREE))
        q = np.linalg.qr(chebyshev(apply, q, vq, degree, low, high, top))[0]
    raise RuntimeError(f"components not certified after {SWEEPS} polynomials: residual {best:.3g} of the largest eigenvalue")


def identity_error(fit: DataFrame, dim: int, model: Whitening) -> float:
    """Largest absolute entry of the covariance of the whitened fit list minus the identity."""
    centre, turn = model.centre, model.vectors / np.sqrt(model.values)
    k = len(model.values)

    def part(x: np.ndarray) -> np.ndarray:
        w = centre.centred(x) @ turn
        return np.vstack([w.T @ w, w.sum(axis=0)])
    got = _summed(fit, dim, k, part) / centre.n
    return float(np.abs(got[:k] - np.outer(got[k], got[k]) - np.eye(k)).max())


def _transform(rows: DataFrame, dim: int, model: Whitening) -> DataFrame:
    centre, turn, k = model.centre, model.vectors / np.sqrt(model.values), len(model.values)
    id_type = rows.schema["vec_id"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            x = _matrix(b.column("x"), dim)
            z = centre.integers(x)
            whitened = z.astype(np.float64) / centre.n @ turn
            if z.dtype == object or (len(z) and (z.astype(np.float64) ** 2).sum(axis=1).max() > 2.0**62):
                z = z.astype(object)
            deviation = (z * z).sum(axis=1)
            if z.dtype == object:
                deviation = [int(v) if v < 2**63 else None for v in deviation]
            yield pa.RecordBatch.from_arrays(
                [b.column("vec_id"), pa.array(deviation, pa.int64()), pa.FixedSizeListArray.from_arrays(pa.array(whitened.ravel()), k).cast(pa.list_(pa.float64()))],
                names=["vec_id", "deviation", "whitened"])
    return rows.mapInArrow(run, f"vec_id {id_type}, deviation long, whitened array<double>")


def whiten(vectors: DataFrame, components: int = COMPONENTS) -> tuple[DataFrame, Whitening | None]:
    """(vec_id, deviation, whitened array) of each row that takes part, and the fitted model; without variance no rows and None."""
    rows, dim = usable(vectors)
    rows = stored(rows, "whitening-rows")
    fit = stored(rows.select("x").distinct(), "whitening-fit")
    model = fit_whitening(fit, dim, components) if dim else None
    if model is None:
        return rows.limit(0).select("vec_id", F.lit(0).cast("long").alias("deviation"), F.array().cast("array<double>").alias("whitened")), None
    model.identity_error = identity_error(fit, dim, model)
    return _transform(rows, dim, model), model


def whitening_rows(vectors: DataFrame, components: int = COMPONENTS) -> DataFrame:
    """One row per vector and component: vec_id, component (from 1), n, deviation, whitened, explained, identity_error."""
    out, model = whiten(vectors, components)
    n, error = (model.centre.n, model.identity_error) if model else (0, 0.0)
    share = F.array(*[F.lit(float(v / model.trace)) for v in model.values]) if model else F.array().cast("array<double>")
    return out.select("vec_id", "deviation", F.posexplode("whitened").alias("k", "whitened")).select(
        "vec_id", (F.col("k") + 1).alias("component"), F.lit(n).cast("long").alias("n"), "deviation", "whitened",
        F.get(share, F.col("k")).alias("explained"), F.lit(error).alias("identity_error"))
