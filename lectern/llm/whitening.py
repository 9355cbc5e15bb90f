"""Embedding whitening by a block Jacobi-Davidson method.

The covariance is never formed: products with a few vectors at a time are sums over the centred rows, made by Spark
tasks. The driver holds the search subspace, whose size depends on the dimensions alone. Each round takes Ritz pairs of
the subspace, locks those whose residuals are at double precision, solves a projected correction equation for the
others by some steps of MINRES, all columns in one product a step, and widens the subspace by the corrections.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .scratch import keep

#: Components, what is added to floor(SCALE * c), MINRES steps of a round, most rounds.
COMPONENTS, SHIFT, SCALE, STEPS, ROUNDS = 16, 1_000_000, 64, 6, 200
#: Residuals up to this multiple of the largest eigenvalue are at double precision; below the second one an eigenvalue is 0.
PRECISION, NOTHING = 1e-13, 1e-13
#: Least floats of a block of centred rows.
BLOCK = 1 << 17

Product = Callable[[np.ndarray], np.ndarray]


def shifted(vector: Column, scale: int = SCALE, shift: int = SHIFT) -> Column:
    """floor(scale * c) + shift of each entry as array<bigint>; null if the vector is null or has a null or non-finite one."""
    whole = F.forall(vector, lambda c: c.isNotNull() & ~F.isnan(c) & (F.abs(c) < F.lit(float("inf"))))
    return F.when(vector.isNotNull() & whole, F.transform(vector, lambda c: F.floor(F.lit(scale) * c.cast("double")) + F.lit(shift)))


def _orthonormal(new: np.ndarray, *against: np.ndarray) -> np.ndarray:
    """An orthonormal basis of the columns of ``new`` outside the other spaces; columns inside them go."""
    new = new[:, np.linalg.norm(new, axis=0) > 0]
    new = new / np.linalg.norm(new, axis=0)
    for _ in range(2):
        for space in against:
            new = new - space @ (space.T @ new)
        size = np.linalg.norm(new, axis=0)
        new = new[:, size > 1e-10] / size[size > 1e-10]
        if not new.shape[1]:
            return new
        u, s, _v = np.linalg.svd(new, full_matrices=False)
        new = u[:, s > 1e-10]
    return new


def minres(product: Product, theta: np.ndarray, space: np.ndarray, right: np.ndarray, steps: int) -> np.ndarray:
    """Steps of MINRES on (I - QQ') (V - theta I) (I - QQ') t = right for every column, with Q = ``space``."""
    tiny = np.finfo(float).tiny
    size = np.linalg.norm(right, axis=0)
    t = np.zeros_like(right)
    v0, v1 = np.zeros_like(right), right / np.maximum(size, tiny)
    w0, w1 = np.zeros_like(right), np.zeros_like(right)
    c0 = c1 = np.ones(len(theta))
    s0 = s1 = np.zeros(len(theta))
    eta, beta, open_ = size.copy(), np.zeros(len(theta)), size > 0
    for _ in range(steps):
        if not open_.any():
            break
        z = product(v1) - v1 * theta
        z = z - space @ (space.T @ z)
        alpha = (v1 * z).sum(0)
        z = z - alpha * v1 - beta * v0
        after = np.linalg.norm(z, axis=0)
        delta = c1 * alpha - c0 * s1 * beta
        rho = np.hypot(delta, after)
        open_ = open_ & (rho > tiny)
        rho = np.where(open_, rho, 1)
        w2 = (v1 - s0 * beta * w0 - (s1 * alpha + c0 * c1 * beta) * w1) / rho
        c2, s2 = delta / rho, after / rho
        t = t + np.where(open_, c2 * eta, 0) * w2
        eta = -s2 * eta
        open_ = open_ & (after > 1e-14 * size) & (abs(eta) > 1e-15 * size)
        v0, v1, beta = v1, z / np.where(open_, np.maximum(after, tiny), 1), after
        w0, w1, c0, c1, s0, s1 = w1, w2, c1, c2, s1, s2
    return t


def jacobi_davidson(product: Product, dims: int, count: int, steps: int = STEPS, seed: int = 1) -> tuple[np.ndarray, np.ndarray]:
    """The ``count`` largest eigenvalues of a symmetric positive semidefinite matrix, falling, and their unit vectors.

    ``product`` multiplies it with the columns of a dims x m array. Raises RuntimeError if ROUNDS do not bring all
    residuals to PRECISION times the largest eigenvalue.
    """
    count = min(count, dims)
    most = min(dims, 4 * count + 8)
    basis = _orthonormal(np.random.default_rng(seed).standard_normal((dims, min(dims, count + 4))))
    image = product(basis)
    locked, values = np.empty((dims, 0)), np.empty(0)
    for _ in range(ROUNDS):
        h = basis.T @ image
        theta, y = np.linalg.eigh((h + h.T) / 2)
        order = np.argsort(-theta)
        theta, y = theta[order], y[:, order]
        want = count - locked.shape[1]
        ritz, of_ritz = basis @ y, image @ y
        left = of_ritz - ritz * theta
        left = left - locked @ (locked.T @ left)
        scale = max(abs(theta[0]) if len(theta) else 0.0, abs(values).max(initial=0.0))
        done = np.linalg.norm(left, axis=0) <= PRECISION * scale
        # pairs are locked from the largest on, so that none is passed over
        now = int(np.argmin(np.r_[done[:want], False]))
        locked, values = np.c_[locked, ritz[:, :now]], np.r_[values, theta[:now]]
        if locked.shape[1] >= count:
            break
        ritz, of_ritz, theta, left, want = ritz[:, now:], of_ritz[:, now:], theta[now:], left[:, now:], want - now
        if ritz.shape[1] + want > most - locked.shape[1]:
            ritz, of_ritz, theta, left = (x[..., : 2 * want] for x in (ritz, of_ritz, theta, left))
        active = np.flatnonzero(np.linalg.norm(left[:, :want], axis=0) > PRECISION * scale)
        space = np.c_[locked, ritz[:, :want]]
        fix = minres(product, theta[active], space, -(left[:, active] - space @ (space.T @ left[:, active])), steps)
        new = _orthonormal(fix, locked, ritz)
        if not new.shape[1] and ritz.shape[1] + locked.shape[1] < dims:
            new = _orthonormal(np.random.default_rng(seed + locked.shape[1]).standard_normal((dims, 1)), locked, ritz)
        if new.shape[1]:
            basis, image = np.c_[ritz, new], np.c_[of_ritz, product(new)]
        else:  # the subspace is everything that is left; a fresh product of it takes rounding errors away
            basis = _orthonormal(ritz, locked)
            image = product(basis)
    else:
        raise RuntimeError("the residuals did not reach double precision")
    order = np.argsort(-values, kind="stable")
    return values[order], locked[:, order]


def _matrix(column: pd.Series, dims: int) -> np.ndarray:
    out = np.zeros((len(column), dims), np.int64)
    out[:] = SHIFT
    for i, v in enumerate(column):
        out[i, : len(v)] = v
    return out


def _centred(x: np.ndarray, n: int, sums: np.ndarray) -> np.ndarray:
    """n * x - S, exact."""
    if n * max(abs(int(x.max(initial=0))), abs(int(x.min(initial=0)))) + int(np.abs(sums).max()) >= 2**63:
        raise ValueError("n * x leaves 64 bits")
    return n * x - sums


def _deviations(d: np.ndarray) -> np.ndarray:
    if len(d) and float(np.abs(d).max()) ** 2 * d.shape[1] >= 2**62:
        exact = [sum(int(v) * int(v) for v in row) for row in d]
        if max(exact) >= 2**63:
            raise ValueError("a deviation leaves 64 bits")
        return np.array(exact, np.int64)
    return (d * d).sum(1)


class Fit:
    """The fit list as blocks of centred rows, kept as a table: each distinct x vector of ``vectors(x)`` once."""

    def __init__(self, vectors: DataFrame):
        spark = vectors.sparkSession
        distinct = keep(vectors.select("x").distinct(), "distinct")
        self.n, self.dims = distinct.agg(F.count("*"), F.max(F.size("x"))).first()
        self.dims = max(self.dims or 0, 0)
        if not self.n or not self.dims:
            self.n = 0
            return
        at = distinct.select(F.posexplode("x").alias("i", "v")).groupBy("i").agg(F.sum("v").alias("s"), F.count("*").alias("c"))
        self.sums = np.zeros(self.dims, np.int64)
        for r in at.collect():  # a row for each dimension
            self.sums[r["i"]] = r["s"] + (self.n - r["c"]) * SHIFT
        n, sums, dims = self.n, self.sums, self.dims
        size = max(1, BLOCK // dims)

        def blocks(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            for batch in batches:
                for lo in range(0, len(batch), size):
                    yield pd.DataFrame({"block": [(_centred(_matrix(batch["x"].iloc[lo : lo + size], dims), n, sums) / n).tobytes()]})

        self._spark, self._blocks = spark, keep(distinct.mapInPandas(blocks, "block binary"), "centred")

    def summed(self, each: Callable[[np.ndarray], np.ndarray]) -> np.ndarray:
        """The sum over all blocks of ``each(rows)``, an array of two dimensions."""
        dims = self.dims

        def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            total = None
            for batch in batches:
                for block in batch["block"]:
                    part = each(np.frombuffer(block).reshape(-1, dims))
                    total = part if total is None else total + part
            if total is not None:
                yield pd.DataFrame({"i": np.arange(len(total)), "v": list(total)})

        parts = self._blocks.mapInPandas(run, "i int, v array<double>")
        width = each(np.zeros((1, dims))).shape[1]
        rows = parts.groupBy("i").agg(F.array(*[F.sum(F.col("v")[j]) for j in range(width)]).alias("v")).collect()
        out = np.zeros((len(rows), width))
        for r in rows:
            out[r["i"]] = r["v"]
        return out

    def product(self, vectors: np.ndarray) -> np.ndarray:
        """The covariance times ``vectors``."""
        return self.summed(lambda c: c.T @ (c @ vectors)) / self.n

    def trace(self) -> float:
        return float(self.summed(lambda c: np.array([[(c * c).sum()]]))[0, 0]) / self.n

    def identity_error(self, map_: np.ndarray) -> float:
        """Largest absolute entry of the covariance of the rows times ``map_``, less the identity."""
        mean = self.summed(lambda c: (c @ map_).sum(0, keepdims=True)) / self.n
        spread = self.summed(lambda c: (c @ map_ - mean).T @ (c @ map_ - mean)) / self.n
        return float(np.abs(spread - np.eye(map_.shape[1])).max())


def whiten(vectors: DataFrame, components: int = COMPONENTS) -> DataFrame:
    """vec_id, component (from 1), n, deviation, whitened, explained, identity_error for each row of
    ``vectors(vec_id, embedding)`` and each of the first ``components`` components.

    Vectors that are null, or hold null or non-finite entries, take no part. Repeated rows are returned as often as
    they are but fitted once, as are rows of one vector; missing trailing entries count as 0. Components whose
    eigenvalue is 0 to double precision cannot be whitened and have no rows: none, then, for a single vector. An empty
    table gives no rows. Eigenvectors have their largest entry positive. Values that leave 64 bits raise an error.
    """
    rows = vectors.select("vec_id", shifted(F.col("embedding")).alias("x")).where("x is not null")
    schema = "vec_id long, component int, n long, deviation long, whitened double, explained double, identity_error double"
    fit = Fit(rows)
    if fit.n < 2:
        return vectors.sparkSession.createDataFrame([], schema)
    trace = fit.trace()
    values, axes = jacobi_davidson(fit.product, fit.dims, components) if trace > 0 else (np.empty(0), np.empty((fit.dims, 0)))
    some = values > NOTHING * trace
    values, axes = values[some], axes[:, some]
    if not len(values):
        return vectors.sparkSession.createDataFrame([], schema)
    axes = axes * np.sign(axes[np.abs(axes).argmax(0), np.arange(len(values))])
    map_, explained, error = axes / np.sqrt(values), values / trace, fit.identity_error(axes / np.sqrt(values))
    n, sums, dims, count = fit.n, fit.sums, fit.dims, len(values)
    size = max(1, BLOCK // dims)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for lo in range(0, len(batch), size):
                part = batch.iloc[lo : lo + size]
                d = _centred(_matrix(part["x"], dims), n, sums)
                yield pd.DataFrame({
                    "vec_id": np.repeat(part["vec_id"].to_numpy(), count), "component": np.tile(np.arange(1, count + 1, dtype=np.int32), len(part)), "n": n,
                    "deviation": np.repeat(_deviations(d), count), "whitened": ((d / n) @ map_).ravel(), "explained": np.tile(explained, len(part)), "identity_error": error,
                })

    return rows.mapInPandas(run, schema)
