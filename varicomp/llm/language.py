"""Language identification by prediction by partial matching.

For each language a context tree of the last 0 to ORDER bytes holds frozen counts of the next byte. A byte costs what it
has in the longest context that was seen, or else the escape (method C, with exclusion) and what it has in the next
shorter one; unseen everywhere, an equal share of the bytes that are left. The costs depend on the context and the byte
only, so they become one table over the union of the languages' trees, and a text is scored in bulk: ORDER table steps
to each position's context, and one look-up of the costs. The language with the least code length wins, ties to the
first by name.

The trees are learned from at most `sample` documents a language (those with the smallest hash of the id); contexts seen
fewer than `least` times in all are left out. Rows with a null id, text or language are not learned from. A null text,
one without a letter, or any text if nothing could be learned, is `und` with score 0. Repeated rows are kept.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .common import map_arrow, small_batches, utf8_views

ORDER = 3
SAMPLE = 800
LEAST = 4
SCALE = 4096  # costs are integers, in 1 / SCALE bits, so that sums are exact


def _grams(data: np.ndarray, offsets: np.ndarray, order: int) -> np.ndarray:
    """Each byte with the `order` bytes before it in its document (zeros before the start), as integers."""
    size = np.diff(offsets)
    row = np.repeat(np.arange(len(size)), size)
    padded = np.zeros(len(data) + order * len(size), np.int64)
    at = np.arange(len(data)) + order * (row + 1)
    padded[at] = data
    out = np.zeros(len(data), np.int64)
    for k in range(order, -1, -1):
        out = out << 8 | padded[at - k]
    return out


def _count(order: int):
    """From (lang, text): (lang, gram, n)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            langs = batch.column(0).to_pylist()
            for lang in set(langs):
                some = batch.filter(pa.array([x == lang for x in langs]))
                gram, n = np.unique(_grams(*utf8_views(some.column(1)), order), return_counts=True)
                yield pa.RecordBatch.from_arrays([pa.array([lang] * len(gram), pa.string()), pa.array(gram), pa.array(n)], names=["lang", "gram", "n"])

    return run


class ContextTrees:
    def __init__(self, langs: list[str], lang: np.ndarray, gram: np.ndarray, n: np.ndarray, order: int = ORDER, least: int = LEAST):
        """lang, gram, n: for each language's number and each byte with its context, how often they were seen."""
        self.langs, self.order = langs, order
        seen = np.unique([gram >> 8 * k & 255 for k in range(order + 1)])  # also the zeros before a start
        self.symbol = np.full(256, len(seen), np.int64)  # the last stands for all bytes never seen
        self.symbol[seen] = np.arange(len(seen))
        # contexts: depth by depth those seen often enough, as the bytes with a leading 1
        contexts = [np.array([1])]
        for depth in range(1, order + 1):
            mask = (1 << 8 * depth) - 1
            c, at = np.unique(gram >> 8 & mask, return_inverse=True)
            contexts.append((c | 1 << 8 * depth)[np.bincount(at, n) >= least])
        names = np.concatenate(contexts)
        depth = np.repeat(np.arange(order + 1), [len(c) for c in contexts])
        rank = np.argsort(names)

        def find(name: np.ndarray) -> np.ndarray:
            at = np.minimum(np.searchsorted(names[rank], name), len(names) - 1)
            return np.where(names[rank][at] == name, rank[at], -1)

        shorter = np.where(depth > 0, find(names & ((1 << 8 * np.maximum(depth - 1, 0)) - 1) | 1 << 8 * np.maximum(depth - 1, 0)), 0)
        self._steps(names, depth, shorter, seen, find)
        cost = np.zeros((len(langs), len(names), len(seen) + 1))
        for k in range(len(langs)):
            mine = lang == k
            counts = np.zeros((len(names), len(seen) + 1))
            for d in range(order + 1):
                node = find(gram[mine] >> 8 & ((1 << 8 * d) - 1) | 1 << 8 * d)
                ok = node >= 0
                np.add.at(counts, (node[ok], self.symbol[gram[mine][ok] & 255]), n[mine][ok])
            cost[k] = self._code_lengths(counts, depth, shorter)
        self.cost = np.ascontiguousarray(np.rint(cost * SCALE).astype(np.int32).transpose(1, 2, 0)).reshape(-1, len(langs))

    def _steps(self, names, depth, shorter, seen, find) -> None:
        """step[node, symbol]: the longest context that ends with node's and the byte."""
        self.step = np.zeros((len(names), len(seen) + 1), np.int32)
        for d in range(self.order + 1):
            nodes = np.flatnonzero(depth == d)
            if d < self.order:
                bits = names[nodes][:, None] << 8 | seen[None, :]
                to = find(bits.ravel()).reshape(bits.shape)
            else:
                to = np.full((len(nodes), len(seen)), -1)
            other = self.step[shorter[nodes]][:, :-1] if d else np.zeros_like(to)
            self.step[nodes, :-1] = np.where(to >= 0, to, other)

    def _code_lengths(self, counts, depth, shorter) -> np.ndarray:
        """Bits of each byte in each context; the last column is any byte never seen."""
        unseen = counts == 0
        total, kinds = counts.sum(axis=1), (~unseen).sum(axis=1)
        bits = np.zeros_like(counts)
        beyond = np.zeros_like(counts)  # bits of a byte unseen here, after the escape
        with np.errstate(divide="ignore"):
            for d in range(self.order + 1):
                v = np.flatnonzero(depth == d)
                if d == 0:
                    left = 256 - kinds[v]
                    beyond[v] = np.log2(np.maximum(left, 1))[:, None]
                else:
                    s = shorter[v]
                    rest = np.where(unseen[v], counts[s], 0)  # excludes bytes that the longer context has seen
                    n, k = rest.sum(axis=1), (rest > 0).sum(axis=1)
                    empty = n == 0
                    there = -np.log2(np.where(rest > 0, rest, 1) / np.where(empty, 1, n + k)[:, None])
                    on = -np.log2(np.where(empty, 1.0, k / np.where(empty, 1, n + k)))[:, None] + beyond[s]
                    beyond[v] = np.where(rest > 0, there, on)
                n, k = total[v], kinds[v]
                empty = n == 0
                own = -np.log2(np.where(counts[v] > 0, counts[v], 1) / np.where(empty, 1, n + k)[:, None])
                escape = -np.log2(np.where(empty, 1.0, k / np.where(empty, 1, n + k)))[:, None]
                bits[v] = np.where(counts[v] > 0, own, escape + beyond[v])
        return bits

    def code_lengths(self, data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
        """Of each document in each language, in 1 / SCALE bits."""
        size, width = np.diff(offsets), self.order
        out = np.zeros((len(size), len(self.langs)), np.int64)
        if not len(data):
            return out
        row = np.repeat(np.arange(len(size)), size)
        at = np.arange(len(data)) + width * (row + 1)
        symbols = np.full(len(data) + width * len(size), self.symbol[0], np.int32)
        symbols[at] = self.symbol[data]
        full = len(self.step[0])
        state, step = np.zeros(len(data), np.int32), self.step.ravel()
        for k in range(width, 0, -1):
            state = step[state * full + symbols[at - k]]
        cost = self.cost[state * full + symbols[at]]
        some = size > 0
        out[some] = np.add.reduceat(cost, offsets[:-1][some], axis=0, dtype=np.int64)
        return out


def learn(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang", sample: int = SAMPLE, order: int = ORDER) -> ContextTrees | None:
    small_batches(docs.sparkSession)
    rows = docs.select(F.col(f"`{id_col}`").alias("id"), F.col(f"`{lang_col}`").cast("string").alias("lang"), F.col(f"`{text_col}`").cast("string").alias("text")).where("id is not null and lang is not null and text is not null")
    # a hash of id and text under a limit that about twice the sample has, so that few rows meet in a language's task
    rows = rows.withColumn("h", F.xxhash64("id", "text"))
    # limits has a row a language, as the model has; broadcast, so that texts over the limit are never shuffled
    share = F.least(F.lit(1.0), F.lit(2.0 * sample + 1000) / F.col("n"))
    limits = rows.groupBy("lang").agg(F.approx_count_distinct("h").alias("n")).select("lang", share.alias("share"))
    near = rows.join(F.broadcast(limits), "lang").where((F.col("h") / F.lit(2.0**63) + 1) / 2 <= F.col("share"))
    near = near.groupBy("lang", "id", "h").agg(F.min("text").alias("text"))  # repeated rows count once
    place = F.row_number().over(Window.partitionBy("lang").orderBy("h", "id"))
    texts = near.withColumn("place", place).where(F.col("place") <= sample).select("lang", "text")
    found = texts.mapInArrow(_count(order), "lang string, gram long, n long").groupBy("lang", "gram").agg(F.sum("n").alias("n")).toPandas()
    if not len(found):
        return None
    langs = sorted(set(found["lang"]))
    number = {x: k for k, x in enumerate(langs)}
    return ContextTrees(langs, found["lang"].map(number).to_numpy(), found["gram"].to_numpy(), found["n"].to_numpy(), order)


def _predict(handle):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        trees = handle.value
        for batch in batches:
            data, offsets = utf8_views(batch.column(batch.num_columns - 2))
            letters = batch.column(batch.num_columns - 1).to_numpy(zero_copy_only=False)
            bits = trees.code_lengths(data, offsets)
            best = bits.argmin(axis=1)
            excess = np.minimum((bits - bits.min(axis=1)[:, None]) / SCALE, 1000)
            score = np.where(letters, 1 / np.exp2(-excess).sum(axis=1), 0.0)
            langs = [trees.langs[k] if x else "und" for k, x in zip(best.tolist(), letters.tolist(), strict=True)]
            yield pa.RecordBatch.from_arrays([*batch.columns[:-2], pa.array(langs, pa.string()), pa.array(score)], names=[*batch.schema.names[:-2], "lang_pred", "score"])

    return run


def with_language(docs: DataFrame, trees: ContextTrees | None, text_col: str = "text") -> DataFrame:
    """docs with lang_pred and score in place of the text."""
    small_batches(docs.sparkSession)
    kept = [F.col(f"`{c}`") for c in docs.columns if c != text_col]
    if trees is None:
        return docs.select(*kept, F.lit("und").alias("lang_pred"), F.lit(0.0).alias("score"))
    letters = F.coalesce(F.col(f"`{text_col}`").rlike("\\p{L}"), F.lit(False))
    rows = docs.select(*kept, F.col(f"`{text_col}`").cast("string").alias("__text"), letters.alias("__letters"))
    fields = "".join(f"`{f.name}` {f.dataType.simpleString()}, " for f in rows.schema if not f.name.startswith("__"))
    # bounded by the sample: contexts seen in it, times the bytes, times the languages
    handle = docs.sparkSession.sparkContext.broadcast(trees)
    return map_arrow(rows, _predict(handle), fields + "lang_pred string, score double")
