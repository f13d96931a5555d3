"""Exact top-k search by inner product with dual cover trees.

Vectors are dealt to the nearest of at most PIVOTS rows; such a cell has a covering radius. A query first searches its own
cell, which gives it a k-th score to beat. For a cell of queries with centre c and radius r, and a cell of data with
centre e and radius s, no inner product is over c.e + |c| s + |e| r + r s: pairs of cells for which that is below the worst
k-th score of all their queries are pruned before anything is shuffled. In the other pairs, cut to blocks of at most about
BLOCK rows and GROUP queries, both sides are indexed by a cover tree, and the trees are descended together with the same
bound on each pair of nodes. A tree costs NET distances a point and level: a node whose first NET children cover under a
quarter of its points keeps the others itself, so vectors without structure, which no bound can prune, cost no more than
comparing all.

Scores are found in floating point with a margin for its error and then made exact in integers, so they hold for all
vectors whose inner products fit 63 bits; others fail the job.

Vectors that are null, or hold null or non-finite components, and rows with a null id take no part; shorter vectors count
as padded with zeros. A query's own id is never its result; of repeated rows each counts.
"""

from __future__ import annotations

from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .common import materialize

BLOCK = 16_384
GROUP = 8_192
PIVOTS = 256
LEAF = 32
NET = 16


@dataclass
class Node:
    centre: np.ndarray
    radius: float
    own: np.ndarray  # points of this node that are in no child
    every: np.ndarray  # all points below
    children: list[Node] = field(default_factory=list)


def _distance(x: np.ndarray, centre: np.ndarray) -> np.ndarray:
    return np.sqrt(((x - centre) ** 2).sum(axis=1))


def cover_tree(x: np.ndarray) -> Node:
    def build(points: np.ndarray) -> Node:
        centre = x[points[0]]
        node = Node(centre, float(_distance(x[points], centre).max()), points, points)
        if len(points) <= LEAF or node.radius == 0:
            return node
        left = points
        while len(left) and len(node.children) < NET:  # a net of points over radius / 2 apart; others go to the first that covers them
            near = _distance(x[left], x[left[0]]) <= node.radius / 2
            near[0] = True
            node.children.append(build(left[near]))
            left = left[~near]
        if 4 * len(left) <= 3 * len(points):  # the net goes on below, as long as it takes in a part of the points each time
            node.own = left[:0]
            if len(left):
                node.children.append(build(left))
        else:
            node.own = left
        return node

    return build(np.arange(len(x)))


class DualSearch:
    """The k best of rows x for each of the queries; worst: scores that a result must at least have."""

    def __init__(self, queries: np.ndarray, query_ids: np.ndarray, x: np.ndarray, ids: np.ndarray, k: int, worst: np.ndarray | None = None):
        self.exact_q, self.exact_x, self.q_ids, self.ids, self.k = queries, x, query_ids, ids, k
        self.q, self.x = queries.astype(float), x.astype(float)
        self.q_length, self.x_length = np.sqrt((self.q**2).sum(axis=1)), np.sqrt((self.x**2).sum(axis=1))
        self.error = 4 * (queries.shape[1] + 4) * 2.0**-53  # of a score, as a share of both lengths
        self.worst = np.full(len(queries), -np.inf) if worst is None else worst.astype(float)
        self.row, self.score, self.id = (np.zeros(0, np.int64) for _ in range(3))
        self.compared = 0

    def compare(self, who: np.ndarray, points: np.ndarray) -> None:
        for lo in range(0, len(points), 1024):
            part = points[lo : lo + 1024]
            self.compared += len(who) * len(part)
            scores = self.q[who] @ self.x[part].T
            scores[self.q_ids[who][:, None] == self.ids[part][None, :]] = -np.inf  # the query itself, however often
            margin = self.error * self.q_length[who] * self.x_length[part].max()
            least = self.worst[who] - margin
            if len(part) > 4 * self.k:
                least = np.maximum(least, np.partition(scores, len(part) - self.k, axis=1)[:, len(part) - self.k] - 2 * margin)
            rows, cols = np.nonzero((scores >= least[:, None]) & (scores > -np.inf))
            if len(rows):
                if np.abs(scores[rows, cols]).max() + margin.max() >= 2.0**63:
                    raise OverflowError("an inner product does not fit 63 bits")
                self.add(who[rows], (self.exact_q[who[rows]] * self.exact_x[part[cols]]).sum(axis=1), self.ids[part[cols]])

    def add(self, row: np.ndarray, score: np.ndarray, id_: np.ndarray) -> None:
        row, score, id_ = np.r_[self.row, row], np.r_[self.score, score], np.r_[self.id, id_]
        order = np.lexsort((id_, ~score, row))  # ~: falls as the score rises, at either end of the range too
        row, score, id_ = row[order], score[order], id_[order]
        place = np.arange(len(row)) - np.searchsorted(row, row)
        last = place == self.k - 1
        self.worst[row[last]] = np.maximum(self.worst[row[last]], score[last].astype(float))
        self.row, self.score, self.id = row[place < self.k], score[place < self.k], id_[place < self.k]

    def bound(self, a: Node, b: Node) -> float:
        return upper_bound(a.centre, a.radius, b.centre, b.radius)

    def run(self, a: Node, b: Node) -> None:
        todo = [(a, b)]
        while todo:
            a, b = todo.pop()
            if self.bound(a, b) < self.worst[a.every].min():
                continue
            if a.children and a.radius >= b.radius:
                if len(a.own):
                    todo.append((Node(a.centre, a.radius, a.own, a.own), b))
                todo += [(c, b) for c in a.children]
                continue
            if len(b.own):
                lb = np.sqrt(b.centre @ b.centre)
                most = self.q[a.every] @ b.centre + self.q_length[a.every] * b.radius
                who = a.every[most + 1e-6 * (1 + np.abs(most) + self.q_length[a.every] * lb) >= self.worst[a.every]]
                if len(who):
                    self.compare(who, b.own)
            todo += sorted(((a, c) for c in b.children), key=lambda p: self.bound(*p))

    def search(self) -> None:
        if len(self.q) and len(self.x):
            self.run(cover_tree(self.q), cover_tree(self.x))


def upper_bound(c: np.ndarray, r: float, e: np.ndarray, s: float) -> float:
    """No inner product of a vector within r of c and one within s of e is over this."""
    lc, le = np.sqrt(c @ c), np.sqrt(e @ e)
    return float(c @ e + lc * s + le * r + r * s + 1e-6 * (1 + (lc + r) * (le + s)))


def _matrix(column: pa.ChunkedArray, width: int) -> np.ndarray:
    rows = column.combine_chunks()
    values, offsets = rows.flatten().to_numpy(), np.r_[0, np.cumsum(rows.value_lengths().to_numpy())]
    out = np.zeros((len(rows), width), np.int64)
    size = np.diff(offsets)
    out[np.repeat(np.arange(len(rows)), size), np.arange(len(values)) - np.repeat(offsets[:-1], size)] = values
    return out


def _search(k: int, width: int):
    def run(queries: pa.Table, data: pa.Table) -> pa.Table:
        q_ids = queries.column("id").to_numpy()
        worst = queries.column("worst").to_numpy() if len(queries) else None
        found = DualSearch(_matrix(queries.column("vector"), width), q_ids, _matrix(data.column("vector"), width), data.column("id").to_numpy(), k, worst)
        found.search()
        return pa.table({"query_id": q_ids[found.row], "vec_id": found.id, "score": found.score})

    return run


def quantised(vector: Column, scale: int = 256) -> Column:
    """floor(scale * x) of each component; null unless all are finite numbers."""
    whole = F.forall(vector, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    return F.when(whole, F.transform(vector, lambda x: F.floor(x.cast("double") * scale)))


def _nearest(pivots: np.ndarray):
    """From (id, vector, query): also the nearest pivot and the distance to it, rounded up."""

    def run(batches):
        norms = (pivots**2).sum(axis=1)
        for batch in batches:
            x = _matrix(pa.chunked_array([batch.column(1)]), pivots.shape[1]).astype(float)
            cell = (norms[None, :] - 2 * (x @ pivots.T)).argmin(axis=1)
            far = np.sqrt(((x - pivots[cell]) ** 2).sum(axis=1)) * (1 + 1e-9)
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(cell.astype(np.int32)), pa.array(far)], names=[*batch.schema.names, "cell", "far"])

    return run


def _met(queries: DataFrame, data: DataFrame, pairs: list[tuple[int, int]], parts: dict[int, tuple[int, int]], k: int, width: int) -> DataFrame:
    """The k best of each query (id, vector, worst, cell) among the rows (id, vector, cell) of the cells that are paired with its own."""
    spark = data.sparkSession
    rows = [(q, d, parts[q][0], parts[d][1]) for q, d in pairs]  # at most PIVOTS squared
    known = F.broadcast(spark.createDataFrame(rows, "q int, d int, groups int, blocks int"))
    part = lambda n: F.pmod(F.xxhash64("id", "vector"), F.col(n)).cast("int")
    left = queries.join(known, F.col("cell") == F.col("q")).withColumn("group", part("groups")).withColumn("block", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
    right = data.join(known, F.col("cell") == F.col("d")).withColumn("block", part("blocks")).withColumn("group", F.explode(F.sequence(F.lit(0), F.col("groups") - 1)))
    by = ["q", "d", "group", "block"]
    # aliases: both sides come from one table, and cogroup must tell their columns apart
    left, right = (df.select(*[F.col(c).alias(c) for c in (*by, "id", "vector", *more)]) for df, more in ((left, ["worst"]), (right, [])))
    return left.groupBy(*by).cogroup(right.groupBy(*by)).applyInArrow(_search(k, width), "query_id long, vec_id long, score long")


def _best(found: DataFrame, k: int) -> DataFrame:
    place = F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id"))
    return found.withColumn("rank", place).where(F.col("rank") <= k)


def top_k(rows: DataFrame, is_query: Column, k: int = 5, block: int = BLOCK, group: int = GROUP) -> DataFrame:
    """rows: id (long) and vector (array of integers). Returns query_id, rank, vec_id, score; ties to the smaller id."""
    rows = rows.select("id", F.col("vector").cast("array<long>").alias("vector"), is_query.alias("__query")).where("id is not null and vector is not null")
    total, width = rows.agg(F.count("*"), F.max(F.size("vector"))).first()
    # the cells are fitted on a bounded sample; every row is dealt to one
    few = rows.orderBy(F.xxhash64("id"), "id").limit(max(1, min(PIVOTS, total // block))).select("vector").collect()
    width = width or 0
    pivots = np.unique(np.array([r[0] + [0] * (width - len(r[0])) for r in few], float).reshape(len(few), width), axis=0) if few else np.zeros((1, width))
    celled = materialize(rows.mapInArrow(_nearest(pivots), "id long, vector array<long>, __query boolean, cell int, far double"), "vectors")
    data, queries = celled.select("id", "vector", "cell"), celled.where("__query").select("id", "vector", "cell")
    stats = celled.groupBy("cell").agg(F.count("*"), F.max("far"), F.count_if("__query"), F.max(F.when(F.col("__query"), F.col("far")))).collect()  # at most PIVOTS rows
    parts = {r[0]: (-(-r[3] // group), -(-r[1] // block)) for r in stats}
    asking = [r[0] for r in stats if r[3]]
    own = _met(queries.withColumn("worst", F.lit(float("-inf"))), data, [(c, c) for c in asking], parts, k, width)
    if len(stats) > 1:
        own = materialize(own, "own")
        kth = _best(own, k).groupBy("query_id").agg(F.max(F.when(F.col("rank") == k, F.col("score"))).alias("kth"))
        worst = queries.join(kth, queries["id"] == kth["query_id"], "left").select("id", "vector", "cell", F.coalesce(F.col("kth").cast("double"), F.lit(float("-inf"))).alias("worst"))
        worst = materialize(worst, "queries")
        least = dict(worst.groupBy("cell").agg(F.min("worst")).collect())
        reach = {r[0]: (r[2], r[4]) for r in stats}
        pairs = [(q, d) for q in asking for d in reach if q != d and upper_bound(pivots[q], reach[q][1], pivots[d], reach[d][0]) >= least[q]]
        own = own.union(_met(worst, data, pairs, parts, k, width))
    return _best(own, k).select("query_id", "rank", "vec_id", "score")
