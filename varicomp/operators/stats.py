"""Sufficient statistics: the only passes over rows that a fit needs, each one hash aggregation on a group key."""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass, replace
from functools import cached_property

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from varicomp.errors import ResourceLimitError, SpecificationError

MOST_CELLS = 50_000_000  # of the dense cross block between the largest factor and the rest


def products(rows: DataFrame, keys: list[str], pairs: list[tuple[str, str]]) -> DataFrame:
    """sum(w * a * b) of each pair, by keys; Catalyst combines within tasks before the shuffle."""
    sums = [F.sum(F.col("__w") * F.col(a) * F.col(b)).alias(f"s{k}") for k, (a, b) in enumerate(pairs)]
    return rows.groupBy(*keys).agg(*sums) if keys else rows.agg(*sums)


def added(rows: DataFrame, cells: Callable[[pa.RecordBatch], np.ndarray]) -> np.ndarray:
    """The sum over batches of what cells makes of one: added up in each task, then by one aggregation."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = sum(cells(b) for b in batches if b.num_rows)
        if isinstance(total, np.ndarray):
            yield pa.RecordBatch.from_arrays([pa.array([total.tolist()], pa.list_(pa.float64()))], names=["sums"])

    parts = rows.mapInArrow(run, "sums array<double>").select(F.posexplode("sums").alias("cell", "value"))
    return np.array([r[1] for r in sorted(parts.groupBy("cell").agg(F.sum("value")).collect())])


def codes(column: pa.ChunkedArray) -> np.ndarray:
    """Equal numbers for equal values."""
    return column.combine_chunks().dictionary_encode(null_encoding="encode").indices.to_numpy()


def _local_r(p: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        r = np.zeros((0, p))
        for b in batches:
            x = np.column_stack([c.to_numpy() for c in b.columns])
            r = np.linalg.qr(np.vstack([r, x]), mode="r")
        if len(r):
            yield pa.RecordBatch.from_arrays([pa.array(r[:, k]) for k in range(p)], names=[f"r{k}" for k in range(p)])

    return run


def r_factor(rows: DataFrame, names: list[str]) -> np.ndarray:
    """R of the QR decomposition: locally in each task, then of the stacked factors, p rows a task."""
    p = len(names)
    parts = rows.select(*names).mapInArrow(_local_r(p), ", ".join(f"r{k} double" for k in range(p))).collect()
    return np.linalg.qr(np.array([tuple(r) for r in parts]).reshape(-1, p), mode="r")


def independent_columns(r: np.ndarray, tolerance: float = 1e-7) -> list[int]:
    """Columns in order, without those that nearly depend on the kept ones before them."""
    kept: list[int] = []
    for k in range(r.shape[1]):
        v = r[:, k]
        if kept:
            q = np.linalg.qr(r[:, kept])[0]
            v = v - q @ (q.T @ v)
        if np.linalg.norm(v) > tolerance * max(np.linalg.norm(r[:, k]), 1e-300):
            kept.append(k)
    return kept


@dataclass
class Stats:
    """Sums over rows; r is the response less offset and shift. The first term is eliminated level by level."""

    labels: list[list[str]]  # by term, largest first
    sizes: list[list[int]]  # of each term's correlated parts
    a: np.ndarray  # (g, k, k)
    m: np.ndarray  # (g, k, q2 + p): first term by [other terms | X]
    f: np.ndarray  # (g, k)
    rr: np.ndarray  # (q2 + p, q2 + p)
    rf: np.ndarray  # (q2 + p)
    yy: float
    log_w: float
    n: int
    p: int
    shift: float
    order: list[int]  # the formula's number of each term

    @property
    def q2(self) -> int:
        return self.rr.shape[0] - self.p

    @cached_property
    def sparse(self) -> Sparse | None:
        """m by its cells that are not zero, if the first term is one intercept and few are."""
        if self.a.shape[1:] != (1, 1) or not self.q2:
            return None
        row, col = np.nonzero(self.m[:, 0, :])
        n = np.bincount(row, minlength=len(self.m))
        if (pairs := int((n**2).sum())) > min(MOST_CELLS, len(self.m) * len(self.rr) ** 2 // 20):
            return None
        value, start = self.m[row, 0, col], np.cumsum(n) - n
        i = np.repeat(np.arange(len(row)), n[row])
        j = start[row[i]] + np.arange(pairs) - np.repeat(np.cumsum(n[row]) - n[row], n[row])
        i, j = i[col[i] <= col[j]], j[col[i] <= col[j]]
        pair = col[i] * len(self.rr) + col[j]
        order = np.argsort(pair.astype(np.int32) if len(self.rr) < 46_000 else pair, kind="stable")
        cell, first = np.unique(pair[order], return_index=True)
        return Sparse(row, col, value, row[i[order]].astype(np.int32), value[i[order]] * value[j[order]], cell, first)


@dataclass(frozen=True)
class Sparse:
    row: np.ndarray
    col: np.ndarray
    value: np.ndarray
    pair_row: np.ndarray  # for each pair of cells of a row, by its place in an upper triangle: the row, and the product
    product: np.ndarray
    cell: np.ndarray  # the places, and the first pair of each
    first: np.ndarray

    def gram(self, weight: np.ndarray, n: int) -> np.ndarray:
        """m' diag(weight) m, its upper triangle, end to end."""
        by_pair = weight[self.pair_row]
        by_pair *= self.product
        out = np.zeros(n * n)
        out[self.cell] = np.add.reduceat(by_pair, self.first)
        return out


@dataclass(frozen=True)
class Head:
    n: int
    shift: float  # the weighted mean of the response less offset
    log_w: float
    levels: list[int]


def head_of(rows: DataFrame, x: list[str], terms: int = 0) -> Head:
    """Checked totals over a frame's rows, and how many levels each of the first terms has."""
    r = F.col("__y") - F.col("__o")
    bad = F.sum(sum([(F.isnan(c) | (F.abs(c) == float("inf"))).cast("int") for c in (F.col("__y"), F.col("__w"), F.col("__o"), *map(F.col, x))]))
    found = rows.agg(F.count("*"), F.min("__w"), (F.sum(F.col("__w") * r) / F.sum("__w")), F.sum(F.ln("__w")), bad, *[F.countDistinct(f"__g{k}") for k in range(terms)]).first()
    if not found[0]:
        raise SpecificationError("no rows are left")
    if found[4] or not found[1] > 0:
        raise SpecificationError("values must be finite and weights positive")
    return Head(found[0], float(found[2]), float(found[3]), list(found[5:]))


def collect(rows: DataFrame, kept: list[int], sizes: list[list[int]]) -> Stats:
    """rows: a frame's; kept: numbers of the independent fixed columns."""
    terms = range(len(sizes))
    x = [f"__x{k}" for k in kept]
    head = head_of(rows, x, len(sizes))
    n, shift, log_w = head.n, head.shift, head.log_w
    order = sorted(terms, key=lambda k: -head.levels[k])
    columns = [head.levels[t] * sum(sizes[t]) for t in order]
    after = sum(columns[1:]) + len(x)
    if columns[0] * after > MOST_CELLS or after**2 > MOST_CELLS:  # before anything is fetched
        raise ResourceLimitError("the cross block of the grouping factors is too large")
    rows = rows.withColumn("__r", F.col("__y") - F.col("__o") - F.lit(shift))
    z = {t: [f"__z{t}_{j}" for j in range(sum(sizes[t]))] for t in terms}
    first, rest = order[0], order[1:]
    p, k1 = len(x), len(z[first])
    labels, start, at = [], {}, 0
    per = {}
    for t in order:
        pairs = [(a, b) for a in z[t] for b in [*z[t], *x, "__r"]]
        per[t] = products(rows, [f"__g{t}"], pairs).toPandas().sort_values(f"__g{t}")
        labels.append(per[t][f"__g{t}"].tolist())
        if t != first:
            start[t] = at
            at += len(labels[-1]) * len(z[t])
    q2, g = at, len(labels[0])
    number = {t: {v: k for k, v in enumerate(lv)} for t, lv in zip(order, labels, strict=True)}
    block = {t: d.iloc[:, 1:].to_numpy(float).reshape(len(d), len(z[t]), -1) for t, d in per.items()}
    m, rr, rf = np.zeros((g, k1, q2 + p)), np.zeros((q2 + p, q2 + p)), np.zeros(q2 + p)
    m[:, :, q2:] = block[first][:, :, k1 : k1 + p]
    for t in rest:
        k, b = len(z[t]), block[t]
        for c in range(len(b)):
            s = slice(start[t] + c * k, start[t] + (c + 1) * k)
            rr[s, s], rr[s, q2:], rf[s] = b[c, :, :k], b[c, :, k : k + p], b[c, :, -1]
            rr[q2:, s] = rr[s, q2:].T
        for u in [first, *[u for u in rest if u > t or rest.index(u) > rest.index(t)]]:
            if u == t:
                continue
            cross = products(rows, [f"__g{u}", f"__g{t}"], [(a, b) for a in z[u] for b in z[t]]).toPandas()
            v = cross.iloc[:, 2:].to_numpy(float).reshape(len(cross), len(z[u]), k)
            i, j = cross.iloc[:, 0].map(number[u]).to_numpy(), cross.iloc[:, 1].map(number[t]).to_numpy()
            for a in range(len(z[u])):
                for b2 in range(k):
                    if u == first:
                        m[i, a, start[t] + j * k + b2] = v[:, a, b2]
                    else:
                        rr[start[u] + i * len(z[u]) + a, start[t] + j * k + b2] = v[:, a, b2]
                        rr[start[t] + j * k + b2, start[u] + i * len(z[u]) + a] = v[:, a, b2]
    whole = np.array(products(rows, [], [(a, b) for i, a in enumerate([*x, "__r"]) for b in [*x, "__r"][i:]]).first(), float)
    gram = np.zeros((p + 1, p + 1))
    gram[np.triu_indices(p + 1)] = whole
    gram = np.triu(gram) + np.triu(gram, 1).T
    rr[q2:, q2:], rf[q2:] = gram[:p, :p], gram[:p, p]
    return Stats(labels, [sizes[t] for t in order], block[first][:, :, :k1], m, block[first][:, :, -1], rr, rf, float(gram[p, p]), float(log_w), n, p, float(shift), order)


def with_response(base: Stats, rows: DataFrame, kept: list[int]) -> Stats | None:
    """base for another response of the same rows: only sums that hold it are made. None if the rows are not base's."""
    x = [f"__x{k}" for k in kept]
    r = F.col("__y") - F.col("__o")
    gram = [(a, b) for i, a in enumerate(x) for b in x[i:]]
    bad = F.count_if(F.isnan(r) | (F.abs(r) == float("inf")))
    head = rows.agg(F.count("*"), F.sum(F.ln("__w")), bad, F.sum(F.col("__w") * r) / F.sum("__w"), *[F.sum(F.col("__w") * F.col(a) * F.col(b)) for a, b in gram]).first()
    if head[2]:
        raise SpecificationError("values must be finite")
    same = base.rr[base.q2 :, base.q2 :][np.triu_indices(base.p)]
    if head[0] != base.n or not np.isclose(head[1], base.log_w) or not np.allclose(head[4:], same, rtol=1e-10, atol=1e-10):
        return None
    rows = rows.withColumn("__r", r - F.lit(head[3]))
    f, rf = base.f.copy(), base.rf.copy()
    at = 0
    for place, (t, labels) in enumerate(zip(base.order, base.labels, strict=True)):
        k = sum(base.sizes[place])
        found = products(rows, [f"__g{t}"], [(f"__z{t}_{j}", "__r") for j in range(k)]).toPandas().sort_values(f"__g{t}")
        if found[f"__g{t}"].tolist() != labels:
            return None
        sums = found.iloc[:, 1:].to_numpy(float)
        if place == 0:
            f = sums
        else:
            rf[at : at + sums.size] = sums.ravel()
            at += sums.size
    whole = products(rows, [], [(a, "__r") for a in [*x, "__r"]]).first()
    rf[base.q2 :] = whole[: base.p]
    return replace(base, f=f, rf=rf, yy=float(whole[base.p]), shift=float(head[3]))
