"""Fits whose sums by level stay on executors: one grouping factor with any number of levels.

The sums of a level (Z'WZ, Z'WX, Z'Wr) are a row of a table. The deviance at covariance parameters theta needs of it only
sums over levels: log-determinants, the Schur parts of the fixed effects, and, for the gradient, the inverse blocks and the
cross products of what a level's effects depend on. A task adds these up for its levels, for each theta of a batch; what
the tasks have is added by one aggregation, so a job returns a number of cells that depends on the model alone. Effects are
computed where the sums are, and predictions join them. Nothing of a level goes to the driver.

A level's sums come again from the rows if an executor that keeps them is lost.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark import StorageLevel
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from varicomp.errors import NumericalError, ResourceLimitError, SpecificationError
from varicomp.operators import pls, stats


@dataclass
class LevelTable:
    """What a fit needs of the rows. blocks: level, and sums s0, s1, ... of pairs of random columns with all columns."""

    blocks: DataFrame
    sizes: list[list[int]]
    gram: np.ndarray  # of fixed columns and response
    log_w: float
    n: int
    p: int
    shift: float
    levels: int
    order: list[int] = field(default_factory=lambda: [0])

    @property
    def k(self) -> int:
        return sum(self.sizes[0])

    def points(self, thetas: list[np.ndarray], reml: bool) -> list[pls.Point | None]:
        """The points at several thetas by one job; a gradient at a diagonal of 0 means nothing."""
        k, p = self.k, self.p
        factors = [pls.factors(np.asarray(t, float), self.sizes)[0] for t in thetas]
        parts = self.blocks.mapInArrow(_added(factors, p), "theta int, sums array<double>").select("theta", F.posexplode("sums").alias("cell", "value"))
        sums = np.zeros((len(thetas), 1 + k * k + (p + 1) ** 2 + (k * (p + 1)) ** 2))
        for t, cell, value in parts.groupBy("theta", "cell").agg(F.sum("value")).collect():
            sums[t, cell] = value
        return [_point(self, t, f, v, reml) for t, f, v in zip(thetas, factors, sums, strict=True)]

    def __getattr__(self, name: str):
        if name in ("labels", "a", "m", "f", "rr", "rf", "yy", "q2", "sparse"):
            raise ResourceLimitError("the sums of this fit stay on executors; this step needs them on the driver")
        raise AttributeError(name)


def collect(rows: DataFrame, kept: list[int], sizes: list[list[int]]) -> LevelTable:
    """rows: a frame's, with one grouping factor; kept: numbers of the independent fixed columns."""
    x = [f"__x{k}" for k in kept]
    z = [f"__z0_{j}" for j in range(sum(sizes[0]))]
    head = stats.head_of(rows, x)
    rows = rows.withColumn("__r", F.col("__y") - F.col("__o") - F.lit(head.shift))
    every = [*x, "__r"]
    blocks = stats.products(rows, ["__g0"], [(a, b) for a in z for b in [*z, *every]]).withColumnRenamed("__g0", "level")
    whole = stats.products(rows, [], [(a, b) for i, a in enumerate(every) for b in every[i:]]).first()
    gram = np.zeros((len(every),) * 2)
    gram[np.triu_indices(len(every))] = whole
    gram = np.triu(gram) + np.triu(gram, 1).T
    blocks = blocks.persist(StorageLevel.MEMORY_AND_DISK)
    return LevelTable(blocks, sizes, gram, head.log_w, head.n, len(x), head.shift, blocks.count())


def _cells(batch: pa.RecordBatch, k: int, p: int) -> np.ndarray:
    """(levels, k, k + p + 1) of a batch (level, sums)."""
    return np.column_stack([batch.column(j).to_numpy() for j in range(1, batch.num_columns)]).reshape(-1, k, k + p + 1)


def _solved(cells: np.ndarray, factor: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Of each level the system's Cholesky factor, its right-hand side by fixed columns and response, and the solution."""
    k = len(factor)
    system = np.eye(k) + factor.T @ cells[:, :, :k] @ factor
    right = factor.T @ cells[:, :, k:]
    return np.linalg.cholesky(system), right, np.linalg.solve(system, right)


def _added(factors: list[np.ndarray], p: int):
    """For each theta one row a task: the sums of the task's levels, end to end."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total: list[np.ndarray | float] = [0.0] * len(factors)
        for batch in batches:
            if not batch.num_rows:
                continue
            cells = _cells(batch, len(factors[0]), p)
            for t, factor in enumerate(factors):
                k = len(factor)
                chol, right, solution = _solved(cells, factor)
                log_c = 2 * np.log(np.diagonal(chol, axis1=1, axis2=2)).sum()
                inverse = np.linalg.inv(chol)
                flat = solution.reshape(len(cells), -1)
                schur = right.reshape(-1, p + 1).T @ solution.reshape(-1, p + 1)
                total[t] = total[t] + np.concatenate([[log_c], np.einsum("gia,gib->ab", inverse, inverse).ravel(), schur.ravel(), (flat.T @ flat).ravel()])
                if not np.isfinite(total[t]).all():
                    total[t] = np.full(len(total[t]), np.nan)
        rows = [(t, v.tolist()) for t, v in enumerate(total) if not isinstance(v, float)]
        if rows:
            yield pa.RecordBatch.from_arrays([pa.array([t for t, _ in rows], pa.int32()), pa.array([v for _, v in rows], pa.list_(pa.float64()))], names=["theta", "sums"])

    return run


def evaluate_many(s: LevelTable, thetas: list[np.ndarray], reml: bool) -> list[pls.Point | None]:
    """The points at several thetas, with gradients, by one job; None where the system is not positive definite."""
    floor = pls.lower_bounds(s.sizes) == 0
    # as in pls, a gradient at a diagonal of 0 is taken just inside; the value is that of theta itself
    inside = [np.where(floor, np.maximum(t, 1e-5), t) for t in thetas]
    asked = [*thetas, *[t for t, u in zip(inside, thetas, strict=True) if not np.array_equal(t, u)]]
    points = s.points(asked, reml)
    out, more = [], iter(points[len(thetas) :])
    for t, u, point in zip(inside, thetas, points, strict=False):
        if not np.array_equal(t, u):
            near = next(more)
            if point is not None and near is not None:
                point.gradient = near.gradient
        out.append(point)
    return out


def fixed_part(s: LevelTable, schur: np.ndarray, log_c: float, reml: bool) -> tuple[float, np.ndarray, np.ndarray, float, int, float] | None:
    """Objective, coefficients, inverse system, penalised residual sum, degrees of freedom and log-determinant of the fixed effects."""
    p = s.p
    try:
        log_s = 2 * float(np.log(np.diag(np.linalg.cholesky(schur[:p, :p]))).sum()) if p else 0.0
        s_inv = np.linalg.inv(schur[:p, :p])
        beta = np.linalg.solve(schur[:p, :p], schur[:p, p])
    except np.linalg.LinAlgError:
        return None
    pwrss, nu = float(schur[p, p] - schur[:p, p] @ beta), s.n - p if reml else s.n
    if not (np.isfinite(log_c) and np.isfinite(pwrss) and pwrss > 0 and nu > 0):
        return None
    objective = log_c - s.log_w + (log_s if reml else 0.0) + nu * (1 + np.log(2 * np.pi * pwrss / nu))
    return float(objective), beta, s_inv, pwrss, nu, log_s


def _point(s: LevelTable, theta: np.ndarray, factor: np.ndarray, sums: np.ndarray, reml: bool) -> pls.Point | None:
    k, p = s.k, s.p
    log_c = float(sums[0])
    inverse = sums[1 : 1 + k * k].reshape(k, k)
    schur = s.gram - sums[1 + k * k : 1 + k * k + (p + 1) ** 2].reshape(p + 1, p + 1)
    cross = sums[1 + k * k + (p + 1) ** 2 :].reshape(k, p + 1, k, p + 1)
    solved = fixed_part(s, schur, log_c, reml)
    if solved is None:
        return None
    objective, beta, s_inv, pwrss, nu, log_s = solved
    tail = np.r_[-beta, 1.0]  # a level's effects are its solution by the response less those by the fixed columns
    squares = np.einsum("iajb,a,b->ij", cross, tail, tail)
    spread = inverse + (np.einsum("iajb,ab->ij", cross[:, :p, :, :p], s_inv) if reml else 0)
    slope = np.zeros((k, k))
    if np.diag(factor).all():
        slope = 2 * np.linalg.solve(factor.T, s.levels * np.eye(k) - spread - nu / pwrss * squares)
    gradient, o = [], 0
    for size in s.sizes[0]:
        gradient += [slope[o + j : o + size, o + j] for j in range(size)]
        o += size
    shown = beta.copy()
    shown[0] += s.shift
    return pls.Point(np.asarray(theta, float), float(objective), shown, [], [], pwrss, float(np.sqrt(pwrss / nu)), log_c, log_s, s_inv, pwrss - float(np.trace(squares)), np.concatenate(gradient))


def effects(s: LevelTable, point: pls.Point) -> DataFrame:
    """(level, u0, u1, ..., b0, b1, ...) of every level, computed where its sums are."""
    if len(s.sizes) > 1:
        raise ResourceLimitError("effects of several grouping factors are found on the driver, which their sums are too large for")
    k, p = s.k, s.p
    factor = pls.factors(point.theta, s.sizes)[0]
    beta = point.beta.copy()
    beta[0] -= s.shift
    tail = np.r_[-beta, 1.0]
    names = [f"{c}{j}" for c in "ub" for j in range(k)]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            u = _solved(_cells(batch, k, p), factor)[2] @ tail
            both = np.column_stack([u, u @ factor.T])
            yield pa.RecordBatch.from_arrays([batch.column(0), *(pa.array(np.ascontiguousarray(c)) for c in both.T)], names=["level", *names])

    return s.blocks.mapInArrow(run, "level string, " + ", ".join(f"{n} double" for n in names))


class Deviance:
    """The objective as a function of theta; each value costs a job, so values are kept."""

    def __init__(self, s: LevelTable, reml: bool, most: int):
        self.s, self.reml, self.most, self.seen = s, reml, most, {}

    def points(self, thetas: list[np.ndarray]) -> list[pls.Point | None]:
        new = [t for t in {t.tobytes(): t for t in thetas}.values() if t.tobytes() not in self.seen]
        if new:
            self.seen |= {t.tobytes(): v for t, v in zip(new, evaluate_many(self.s, new, self.reml), strict=True)}
        return [self.seen[t.tobytes()] for t in thetas]

    def __call__(self, theta: np.ndarray) -> tuple[float, np.ndarray]:
        point = self.points([theta])[0]
        return (float("inf"), np.zeros(len(theta))) if point is None else (point.objective, point.gradient)


def minimise(s: LevelTable, reml: bool, most: int, beside) -> tuple[pls.Point, int, str]:
    """Quasi-Newton steps, a job each; beside(theta, low) names points to look at from a diagonal of 0, all in one job."""
    from varicomp.plans import optimize

    low, f = pls.lower_bounds(s.sizes), Deviance(s, reml, most)
    start, message = (low == 0).astype(float), "ok"
    value = lambda point: float("inf") if point is None else point.objective
    for _ in range(5):
        theta, settled = optimize.quasi_newton(f, start, low, most)
        zero = np.where((low == 0) & (theta <= 1e-4), 0.0, theta)
        here, there = map(value, f.points([theta, zero]))
        theta = zero if there <= here + optimize.rounding(here) else theta
        around = [theta, *beside(theta, low)]
        start = around[int(np.argmin([value(q) for q in f.points(around)]))]
        if start is theta or len(f.seen) >= most:
            break
    if len(f.seen) >= most:
        message = f"stopped after {len(f.seen)} evaluations"
    elif not settled or start is not theta:
        message = "the steps ended before the slope vanished"
    point = f.points([theta])[0]
    if point is None:
        raise NumericalError("the system is not positive definite")
    return point, len(f.seen), message


def at(s: LevelTable, theta: np.ndarray, reml: bool) -> pls.Point:
    if len(theta) != pls.n_theta(s.sizes):
        raise SpecificationError("theta has the wrong length")
    point = evaluate_many(s, [np.asarray(theta, float)], reml)[0]
    if point is None:
        raise NumericalError("the system is not positive definite")
    return point
