"""Periodic runs of words, by probes on harmonic grids.

For every period p up to a third of a text, words stand against those p further on at the grid points 0, p, 2p, ...: n / p
tests, n log n in all. A run of period p that is long enough holds a known number of neighbouring points, so only rows of so many
equal points (whose next words are equal as well) are extended, word by word in growing chunks, to both sides until a word
differs. Periods come in ascending order. A point inside a run already found whose period divides p would only find that run
again, and is skipped. A stretch with two periods has a smaller one that divides both, so what is found twice has its smallest
period first.

A row is returned for each row of the input, whatever is repeated. Null texts have no words; a text without words has no runs
and an empty collapsed text. A null loop key plants nothing. Other columns are neither read nor returned.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import small_batches, utf8_views
from .words import SPACED, Words, slices

SHORTEST = 24
TIMES = 3
PROBES = 2_000_000  # grid points that are tested at once
CHUNK = 64, 1 << 16  # words that are compared at once, at first and at most
_RUN = pa.struct([("start", pa.int64()), ("length", pa.int64()), ("period", pa.int64())])


def _equal_after(x: np.ndarray, a: int, b: int) -> int:
    """How many words from a on equal those from b on."""
    n, chunk = 0, CHUNK[0]
    while True:
        differs = x[a + n : a + n + min(chunk, len(x) - b - n)] != x[b + n : b + n + chunk]
        if differs.any():
            return n + int(differs.argmax())
        n, chunk = n + len(differs), min(2 * chunk, CHUNK[1])


def _equal_before(x: np.ndarray, a: int, b: int) -> int:
    """How many words before a equal those before b."""
    n, chunk = 0, CHUNK[0]
    while True:
        m = min(chunk, a - n)
        differs = x[a - n - m : a - n] != x[b - n - m : b - n]
        if differs.any():
            return n + int(differs[::-1].argmax())
        n, chunk = n + m, min(2 * chunk, CHUNK[1])


class RunFinder:
    """The runs of texts whose words are numbers, end to end; edge has the word at which each text begins."""

    def __init__(self, numbers: np.ndarray, edge: np.ndarray, shortest: int = SHORTEST, times: int = TIMES):
        self.n, self.shortest, self.times = np.diff(edge), shortest, times
        texts = np.arange(len(self.n))
        # a number of its own stands before each text and after the last, so that no comparison leaves a text
        self.base = edge[:-1] + texts + 1
        self.place = np.arange(len(numbers)) + np.repeat(texts, self.n) + 1
        self.x = np.full(len(numbers) + len(texts) + 1, -1, np.int64)
        self.x[self.place] = numbers
        self.x[np.r_[self.base - 1, len(self.x) - 1]] = -1 - np.arange(len(texts) + 1)
        self.until = np.zeros(len(self.x), np.int64)  # the end of a run that has this word, and its period
        self.period = np.ones(len(self.x), np.int64)
        self.runs: dict[tuple[int, int], tuple[int, int]] = {}  # (first, end) -> (text, period)
        low = 1
        while len(text := np.flatnonzero(self.n >= max(shortest, times * low))):
            count = np.minimum(2 * low - 1, self.n[text] // times) - low + 1
            at = np.repeat(text, count)
            p = low + np.arange(len(at)) - np.repeat(np.cumsum(count) - count, count)
            edges = np.r_[0, np.cumsum((self.n[at] - 1) // p)]
            for lo, hi in slices(edges, PROBES):
                self._probe(at[lo:hi], p[lo:hi])
            low *= 2

    def _probe(self, text: np.ndarray, period: np.ndarray) -> None:
        """Tests the grids of texts and periods, and extends the points that can lie in a run."""
        points = (self.n[text] - 1) // period
        row = np.repeat(np.arange(len(text)), points)
        j = np.arange(len(row)) - np.repeat(np.cumsum(points) - points, points)
        p = period[row]
        a = self.base[text[row]] + j * p
        k = np.flatnonzero(self.x[a] == self.x[a + p])
        k = k[(self.until[a[k]] <= a[k] + p[k]) | (p[k] % self.period[a[k]] != 0)]
        # points whose next point and next word are equal too; a run has at least `needed` of them in a row
        follows = np.r_[(k[1:] == k[:-1] + 1) & (row[k[1:]] == row[k[:-1]]), False][: len(k)]
        k = k[follows]
        k = k[self.x[a[k] + 1] == self.x[a[k] + p[k] + 1]]
        head = np.r_[True, (k[1:] != k[:-1] + 1) | (row[k[1:]] != row[k[:-1]])][: len(k)]
        first = np.flatnonzero(head)
        last = np.r_[first[1:], len(k)] - 1
        needed = np.maximum(self.shortest, self.times * period) // period - 2
        long = last - first + 1 >= needed[row[k[first]]]
        for i0, i1 in zip(k[first[long]].tolist(), k[last[long]].tolist(), strict=True):
            self._extend(int(text[row[i0]]), int(period[row[i0]]), int(j[i0]), int(j[i1]), int(needed[row[i0]]))

    def _extend(self, text: int, p: int, j: int, last: int, needed: int) -> None:
        base = int(self.base[text])
        while last - j + 1 >= needed:
            a = base + j * p
            ahead = _equal_after(self.x, a, a + p)
            start, end = a - _equal_before(self.x, a, a + p), a + p + ahead
            if end - start >= max(self.shortest, self.times * p) and (start, end) not in self.runs:
                self.runs[start, end] = text, p
                further = self.until[start:end] < end
                self.until[start:end][further] = end
                self.period[start:end][further] = p
            j = (a + ahead - 1 - base) // p + 1  # the points between lie in what was found

    def table(self) -> np.ndarray:
        """Rows (text, start, length, period), in this order."""
        rows = [(t, s - self.base[t], e - s, p) for (s, e), (t, p) in self.runs.items()]
        return np.array(sorted(rows), np.int64).reshape(-1, 4)

    def dropped(self) -> np.ndarray:
        """Which words a run has after its first period."""
        out = np.zeros(len(self.x), bool)
        for (start, end), (_, p) in self.runs.items():
            out[start + p : end] = True
        return out[self.place]


def strongest(runs: list[tuple[int, int, int]]) -> tuple[int, int, int]:
    """Of (start, length, period) that with the greatest length / period; of equal ones the first, then the shorter period."""
    best = runs[0]
    for r in runs[1:]:
        more = r[1] * best[2] - best[1] * r[2]
        if more > 0 or (more == 0 and (r[0], r[2]) < (best[0], best[2])):
            best = r
    return best


def looped(order: np.ndarray, edge: np.ndarray, keys: list[int | None]) -> np.ndarray:
    """The words' places, where a text whose key is a multiple of 10 repeats a stretch of p words from word a on to its end."""
    for k, h in enumerate(keys):
        n, lo = int(edge[k + 1] - edge[k]), int(edge[k])
        if h is not None and h % 10 == 0 and n:
            g = h // 10
            a = g % n
            p = 1 + (n - a) // (3 + g % 8)
            order[lo + a : lo + n] = lo + a + np.arange(n - a) % p
    return order


def _slice(data: np.ndarray, offsets: np.ndarray, keys: list[int | None], shortest: int, times: int) -> list[pa.Array]:
    words = Words(data, offsets, SPACED)
    order = looped(np.arange(len(words)), words.edge, keys)
    numbers = pc.dictionary_encode(words.array()).indices.to_numpy().astype(np.int64)[order] if len(words) else order
    finder = RunFinder(numbers, words.edge, shortest, times)
    found = finder.table()
    count = len(offsets) - 1
    edge = np.searchsorted(found[:, 0], np.arange(count + 1))
    best = []
    for lo, hi in zip(edge[:-1].tolist(), edge[1:].tolist(), strict=True):
        best.append(dict(zip(("start", "length", "period"), strongest(found[lo:hi, 1:].tolist()), strict=True)) if hi > lo else None)
    fields = [pa.array(np.ascontiguousarray(found[:, k])) for k in (1, 2, 3)]
    runs = pa.ListArray.from_arrays(pa.array(edge.astype(np.int32)), pa.StructArray.from_arrays(fields, fields=list(_RUN)))
    kept = ~finder.dropped()
    collapsed = words.joined(order[kept], np.r_[0, np.cumsum(kept)][words.edge])
    return [pa.array(np.diff(words.edge)), runs, pa.array(best, _RUN), collapsed]


def _find(shortest: int, times: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            data, offsets = utf8_views(batch.column(2))
            keys = batch.column(1).to_pylist()
            for lo, hi in slices(offsets):
                part = offsets[lo : hi + 1] - offsets[lo]
                columns = _slice(data[offsets[lo] : offsets[hi]], part, keys[lo:hi], shortest, times)
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(lo, hi - lo), *columns], names=["id", "n_words", "runs", "best", "collapsed"])

    return run


def periodic_runs(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", loop_key: Column | None = None, shortest: int = SHORTEST, times: int = TIMES) -> DataFrame:
    """(id, n_words, runs, best, collapsed): every run of at least `shortest` words and `times` periods as (start, length,
    period), the one with the most periods (null without runs), and the words that no run has after its first period.

    loop_key (a long) plants known runs before the search: see looped(). Without it the texts are taken as they are.
    """
    if shortest < 3 or times < 3:
        raise ValueError("a run needs at least 3 words and 3 periods")
    small_batches(docs.sparkSession)
    key = F.lit(None).cast("long") if loop_key is None else loop_key.cast("long")
    rows = docs.select(F.col(f"`{id_col}`").cast("long").alias("id"), key.alias("key"), F.col(f"`{text_col}`").cast("string").alias("text"))
    run = "struct<start: long, length: long, period: long>"
    return rows.mapInArrow(_find(shortest, times), f"id long, n_words long, runs array<{run}>, best {run}, collapsed string")
