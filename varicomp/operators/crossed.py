"""Fits of two crossed or nested random intercepts whose sums stay on executors.

Levels of the two factors that occur together are linked; the links' connected parts (components) share nothing but the
fixed effects. A component is a row of a table: its level sums and its cells. A task eliminates the factor with more levels
level by level, then the other densely, within each component. The deviance and its gradient need only sums of the results
over components, so a job returns a number of cells that depends on the model alone. Nested factors have a component for
each outer level; factors that are crossed throughout have one.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark import StorageLevel
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from varicomp.errors import ResourceLimitError
from varicomp.operators import pls, stats, tier

PACKED = "swapped boolean, n1 long, n2 long, first binary, second binary, start binary, col binary, value binary"
PAIRS_AT_ONCE = 1_000_000


@dataclass
class Components(tier.LevelTable):
    """blocks: a component a row, as PACKED; levels: of the factor that has most."""

    other_levels: int = 0

    def points(self, thetas: list[np.ndarray], reml: bool) -> list[pls.Point | None]:
        p = self.p
        parts = self.blocks.mapInArrow(_added([np.asarray(t, float) for t in thetas], p), "theta int, sums array<double>").select("theta", F.posexplode("sums").alias("cell", "value"))
        sums = np.zeros((len(thetas), 3 + 3 * (p + 1) ** 2))
        for t, cell, value in parts.groupBy("theta", "cell").agg(F.sum("value")).collect():
            sums[t, cell] = value
        return [self._point(t, v, reml) for t, v in zip(thetas, sums, strict=True)]

    def _point(self, theta: np.ndarray, sums: np.ndarray, reml: bool) -> pls.Point | None:
        p, n = self.p, (self.levels, self.other_levels)
        schur, *cross = sums[3:].reshape(3, p + 1, p + 1)
        solved = tier.fixed_part(self, self.gram - schur, float(sums[0]), reml)
        if solved is None:
            return None
        objective, beta, s_inv, pwrss, nu, log_s = solved
        tail = np.r_[-beta, 1.0]
        squares = [float(tail @ c @ tail) for c in cross]
        spread = [float(sums[1 + k] + (np.sum(cross[k][:p, :p] * s_inv) if reml else 0.0)) for k in range(2)]
        gradient = np.array([2 / t * (n[k] - spread[k] - nu / pwrss * squares[k]) if t else 0.0 for k, t in enumerate(theta)])
        shown = beta.copy()
        shown[0] += self.shift
        return pls.Point(np.asarray(theta, float), objective, shown, [], [], pwrss, float(np.sqrt(pwrss / nu)), float(sums[0]), log_s, s_inv, pwrss - sum(squares), gradient)


def collect(rows: DataFrame, kept: list[int], sizes: list[list[int]]) -> Components:
    """rows: a frame's, with two random intercepts; kept: numbers of the independent fixed columns."""
    if sizes != [[1], [1]]:
        raise ResourceLimitError("the cross block of the grouping factors is too large")
    x = [f"__x{k}" for k in kept]
    head = stats.head_of(rows, x, 2)
    order = sorted(range(2), key=lambda k: -head.levels[k])
    i, j = (f"__g{t}" for t in order)
    every = [*x, "__r"]
    rows = rows.withColumn("__r", F.col("__y") - F.col("__o") - F.lit(head.shift)).withColumn("__one", F.lit(1.0))
    gram = np.zeros((len(every),) * 2)
    gram[np.triu_indices(len(every))] = stats.products(rows, [], [(a, b) for k, a in enumerate(every) for b in every[k:]]).first()
    gram = np.triu(gram) + np.triu(gram, 1).T
    # all rows of a level of the larger factor in one task: links are then among the levels of the other
    cells = stats.products(rows.select(i, j, "__w", "__one", *every).repartition(i), [i, j], [("__one", c) for c in ("__one", *every)])
    cells = cells.withColumnsRenamed({i: "i", j: "j"}).persist(StorageLevel.MEMORY_AND_DISK)
    try:
        blocks = cells.join(_components(cells), F.xxhash64("j") == F.col("vertex")).drop("vertex").repartition("component").sortWithinPartitions("component")
        blocks = blocks.mapInArrow(_packing(len(x)), PACKED).persist(StorageLevel.MEMORY_AND_DISK)
        most = blocks.agg(F.max("n2")).first()[0]
    finally:
        cells.unpersist()
    if most * most > stats.MOST_CELLS:
        blocks.unpersist()
        raise ResourceLimitError(f"{most} levels of each factor at least are crossed with each other: the cross block of the grouping factors is too large")
    return Components(blocks, [[1], [1]], gram, head.log_w, head.n, len(x), head.shift, head.levels[order[0]], order, head.levels[order[1]])


def roots(a: np.ndarray, b: np.ndarray, n: int) -> np.ndarray:
    """For each of n vertices the smallest that the links a[k] - b[k] lead to."""
    parent = np.arange(n)
    while True:
        one, other = parent[a], parent[b]
        apart = one != other
        if not apart.any():
            return parent
        np.minimum.at(parent, np.maximum(one, other)[apart], np.minimum(one, other)[apart])
        while not np.array_equal(up := parent[parent], parent):
            parent = up


def _components(cells: DataFrame) -> DataFrame:
    """(vertex, component) for the hash of each level of the smaller factor; levels of one hash are in one component."""

    def linked(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Links among column vertex through equal values of column by."""
        got = [np.column_stack([b.column(k).to_numpy() for k in range(2)]) for b in batches if b.num_rows]
        if got:
            by, vertex = np.concatenate(got).T
            names, code = np.unique(vertex, return_inverse=True)
            ways, through = np.unique(by, return_inverse=True)
            found = roots(code, len(names) + through, len(names) + len(ways))[: len(names)]
            yield pa.RecordBatch.from_arrays([pa.array(names[found]), pa.array(names)], names=["by", "vertex"])

    links = cells.select(F.xxhash64("i").alias("by"), F.xxhash64("j").alias("vertex")).mapInArrow(linked, "by long, vertex long")
    edges = links.repartition(8).mapInArrow(_merged, "by long, vertex long").toArrow()
    by, vertex = _merge(edges["by"].to_numpy(), edges["vertex"].to_numpy())
    return cells.sparkSession.createDataFrame(pa.table({"vertex": vertex, "component": by}))


def _merge(by: np.ndarray, vertex: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    names = np.unique(np.concatenate([by, vertex]))
    found = roots(np.searchsorted(names, by), np.searchsorted(names, vertex), len(names))
    return names[found], names


def _merged(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    got = [np.column_stack([b.column(k).to_numpy() for k in range(2)]) for b in batches if b.num_rows]
    if got:
        by, vertex = _merge(*np.concatenate(got).T)
        yield pa.RecordBatch.from_arrays([pa.array(by), pa.array(vertex)], names=["by", "vertex"])


def _packing(p: int):
    sums = [f"s{k}" for k in range(p + 2)]

    def packed(rows: pa.Table) -> pa.RecordBatch:
        code = [stats.codes(rows[c]) for c in "ij"]
        n = [int(c.max()) + 1 for c in code]
        swapped = n[1] > n[0]
        if swapped:
            code, n = code[::-1], n[::-1]
        order = np.lexsort(code[::-1])
        value = [rows[c].to_numpy() for c in sums]
        by_level = [np.column_stack([np.bincount(c, v, m) for v in value]) for c, m in zip(code, n, strict=True)]
        start = np.r_[0, np.cumsum(np.bincount(code[0], minlength=n[0]))]
        arrays = [*by_level, start, code[1][order].astype(np.int32), value[0][order]]
        return pa.RecordBatch.from_arrays([pa.array([swapped]), *(pa.array([m]) for m in n), *(pa.array([a.tobytes()], pa.binary()) for a in arrays)], names=["swapped", "n1", "n2", "first", "second", "start", "col", "value"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Rows come sorted by component; those of the last one wait for the next batch."""
        rest, now = [], None
        for batch in batches:
            if not batch.num_rows:
                continue
            component = batch.column("component").to_numpy()
            cuts = [0, *(np.flatnonzero(component[1:] != component[:-1]) + 1).tolist(), len(component)]
            for a, b in zip(cuts, cuts[1:], strict=False):
                if rest and component[a] != now:
                    yield packed(pa.Table.from_batches(rest))
                    rest = []
                now = component[a]
                rest.append(batch.slice(a, b - a))
        if rest:
            yield packed(pa.Table.from_batches(rest))

    return run


def _rows_of_cells(start: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Rows with the same number of cells, and the places of their cells; so many that their pairs of cells are not too many."""
    n = np.diff(start)
    for size in np.unique(n):
        same = np.flatnonzero(n == size)
        step = max(1, PAIRS_AT_ONCE // int(size * size))
        for k in range(0, len(same), step):
            at = same[k : k + step]
            yield at, start[at][:, None] + np.arange(size)


def _part(first: np.ndarray, second: np.ndarray, start: np.ndarray, col: np.ndarray, value: np.ndarray, theta1: float, theta2: float) -> list[np.ndarray]:
    """Of one component log-determinant, traces of the inverse by factor, Schur part of the fixed columns and response, and
    cross products of the two factors' solutions by them."""
    n2 = len(second)
    a, right1, right2 = first[:, 0], first[:, 1:], second[:, 1:]
    c1 = 1 + theta1**2 * a
    weight = theta1**2 / c1
    row = np.repeat(np.arange(len(a)), np.diff(start))
    system = np.zeros(n2 * n2)
    for at, cells in _rows_of_cells(start):
        up, down = np.triu_indices(cells.shape[1])
        c, v = col[cells].astype(np.int64), value[cells]
        np.subtract.at(system, (c[:, up] * n2 + c[:, down]).ravel(), ((weight[at, None] * v)[:, up] * v[:, down]).ravel())
    system = system.reshape(n2, n2)
    system *= theta2**2
    system += np.triu(system, 1).T
    system[np.arange(n2), np.arange(n2)] += 1 + theta2**2 * second[:, 0]
    log_c = float(np.log(c1).sum()) + 2 * float(np.log(np.diag(np.linalg.cholesky(system))).sum())
    inverse = np.linalg.inv(system)
    across = lambda w: np.column_stack([np.bincount(col, value * w[row, k], n2) for k in range(w.shape[1])])
    d = theta2 * (right2 - across(weight[:, None] * right1))
    solved2 = inverse @ d
    along = np.column_stack([np.bincount(row, value * solved2[col, k], len(a)) for k in range(d.shape[1])])
    solved1 = theta1 / c1[:, None] * (right1 - theta2 * along)
    trace1, share = float((1 / c1).sum()), (theta1 * theta2 / c1) ** 2
    flat = inverse.ravel()
    for at, cells in _rows_of_cells(start):
        up, down = np.triu_indices(cells.shape[1])
        c, v = col[cells].astype(np.int64), value[cells]
        both = flat[c[:, up] * n2 + c[:, down]] * v[:, up] * v[:, down] * np.where(up == down, 1.0, 2.0)
        trace1 += float(share[at] @ both.sum(axis=1))
    return [np.array([log_c]), np.array([trace1]), np.array([np.trace(inverse)]), right1.T @ (weight[:, None] * right1) + d.T @ solved2, solved1.T @ solved1, solved2.T @ solved2]


def _added(thetas: list[np.ndarray], p: int):
    """For each theta one row a task: the sums of the task's components, end to end."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total: list[np.ndarray | float] = [0.0] * len(thetas)
        for batch in batches:
            for k in range(batch.num_rows):
                swapped, n1, n2, *raw = (batch.column(c)[k].as_py() for c in range(batch.num_columns))
                first, second, start, col, value = (np.frombuffer(b, kind) for b, kind in zip(raw, (float, float, np.int64, np.int32, float), strict=True))
                for t, theta in enumerate(thetas):
                    one, other = theta[::-1] if swapped else theta
                    try:
                        part = _part(first.reshape(n1, -1), second.reshape(n2, -1), start, col, value, one, other)
                        if swapped:
                            part[1], part[2], part[4], part[5] = part[2], part[1], part[5], part[4]
                        total[t] = total[t] + np.concatenate([v.ravel() for v in part])
                    except np.linalg.LinAlgError:
                        total[t] = np.full(3 + 3 * (p + 1) ** 2, np.nan)
        rows = [(t, v.tolist()) for t, v in enumerate(total) if not isinstance(v, float)]
        if rows:
            yield pa.RecordBatch.from_arrays([pa.array([t for t, _ in rows], pa.int32()), pa.array([v for _, v in rows], pa.list_(pa.float64()))], names=["theta", "sums"])

    return run
