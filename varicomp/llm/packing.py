"""Packing of token sequences by a configuration linear program over the length histogram.

The histogram (at most `size` rows, whatever the input) goes to the driver. Lengths are put in groups of about equal sums;
each group counts as its longest length. Multiplicative weights price the groups, and a knapsack dynamic program finds the
best configuration for the prices, round by round; the configurations cover the demand. They are rounded, filled with the
real lengths, and what is left, the shortest lengths above all, goes where it leaves the smallest gap. Best fit alone is
tried too, and the plan with the fewest sequences is taken, so the program never costs a sequence. A plan has rows for
sets of sequences with equal contents: a bounded number however many sequences there are. The rows of pieces are dealt to
sequences by their rank within their length, which is found in two levels.

Null texts count as empty and have the end token only. Repeated rows and null ids are packed like any other row.
"""

from __future__ import annotations

import zlib
from bisect import bisect_left, insort
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .common import CACHES, giving_back, map_arrow, materialize, partitions, small_batches, utf8_views

ROUNDS = 2000
GROUPS = 64
#: Share of all tokens, in the shortest lengths, that is kept to fill gaps, and the largest gap that is left to them.
TRIES = ((0.007, 1), (0.007, 64), (0.0, 64))
MOST_WORDS = 400_000
KEPT_LENGTH = 10
SLICE = 4 << 20  # bytes of text that are looked up at once
#: ASCII punctuation but the apostrophe, which can begin a contraction.
_MARKS = "!\"#$%&()*+,-./:;<=>?@[\\]^_`{|}~"
_CLASS = "".join("\\" + c for c in _MARKS)
_MARKED = f"(?s)[0-9A-Za-zªµºÀ-ÖØ-öø-ÿ][{_CLASS}]+$"
_PLAIN = "^[a-zªµºß-öø-ÿ]+$"


class Words:
    """Words and the ids of each, laid end to end."""

    def __init__(self, words: pa.Array, ids: np.ndarray, size: np.ndarray):
        self.words, self.ids, self.size = words, ids, size
        self.start = np.cumsum(size) - size

    def and_(self, other: Words) -> Words:
        return Words(pa.concat_arrays([self.words, other.words]), np.r_[self.ids, other.ids], np.r_[self.size, other.size])

    def place(self, words: pa.Array) -> np.ndarray:
        """Where each word is; -1 if it isn't here."""
        return pc.fill_null(pc.index_in(words, self.words), -1).to_numpy().astype(np.int64)

    def take(self, at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The ids of the words at these places, and how many each has."""
        n = self.size[at]
        before = np.cumsum(n) - n
        return self.ids[np.repeat(self.start[at] - before, n) + np.arange(n.sum())], n


class WordCache:
    """Token ids of texts. The tokenizer treats white-space-separated words apart, so each word is encoded once.

    Words of lower-case Latin-1 letters only are left as they are by the normaliser and are one unit to the splitter, so
    they go through the same model many at a time, split at spaces; the last token of a word is one that ends a word.
    All others take the tokenizer's own way.
    """

    def __init__(self, path: str):
        from tokenizers import Tokenizer, normalizers
        from tokenizers import pre_tokenizers as split

        self.tokenizer, self.plain = Tokenizer.from_file(path), Tokenizer.from_file(path)
        self.added = [t.content for t in self.tokenizer.get_added_tokens_decoder().values()]
        self.plain.normalizer = normalizers.Sequence([])
        self.plain.pre_tokenizer = split.Sequence([split.CharDelimiterSplit(" "), split.ByteLevel(add_prefix_space=False, use_regex=False)])
        vocabulary = self.tokenizer.get_vocab()
        self.ends = np.zeros(max(vocabulary.values()) + 1, bool)
        self.ends[[k for w, k in vocabulary.items() if w.endswith("</w>")]] = True
        self.none = Words(pa.array([""], pa.large_string()), np.zeros(0, "<u4"), np.zeros(1, np.int64))
        self.known = self.none

    def _encoded(self, lines: list[str], tokenizer) -> tuple[np.ndarray, np.ndarray]:
        found = [np.array(e.ids, "<u4") for at in range(0, len(lines), 20) for e in tokenizer.encode_batch_fast(lines[at : at + 20], add_special_tokens=False)]
        return np.concatenate([np.zeros(0, "<u4"), *found]), np.fromiter(map(len, found), np.int64, len(found))

    def _new(self, words: pa.Array) -> tuple[Words, np.ndarray]:
        """The words with their ids, in another order, and the place that each has there."""
        plain = pc.match_substring_regex(words, _PLAIN)
        some = words.filter(plain)
        edge = np.minimum(np.arange(0, len(some) + 100, 100), len(some))
        lines = pc.binary_join(pa.ListArray.from_arrays(edge.astype(np.int32), some.cast(pa.string())), " ").to_pylist() if len(some) else []
        ids, _ = self._encoded(lines, self.plain)
        size = np.diff(np.r_[-1, np.flatnonzero(self.ends[ids])])
        others = words.filter(pc.invert(plain))
        order = np.argsort(~plain.to_numpy(zero_copy_only=False), kind="stable")
        return Words(some, ids, size).and_(Words(others, *self._encoded(others.to_pylist(), self.tokenizer))), np.argsort(order)

    def learn(self, words: pa.Array) -> Words:
        """The ids of words, which are all different."""
        # marks after a Latin-1 letter or digit are a unit of their own (other letters may end in a mark when lowered)
        base = pc.if_else(pc.match_substring_regex(words, _MARKED), pc.utf8_rtrim(words, _MARKS), words)
        parts = pa.concat_arrays([base, _after(words, pc.binary_length(base).to_numpy())]).dictionary_encode()
        if len(self.known.words) > MOST_WORDS:
            self.known = self.none
        at = self.known.place(parts.dictionary)
        new, place = self._new(parts.dictionary.filter(pa.array(at < 0)))
        at[at < 0] = len(self.known.words) + place
        store = self.known.and_(new)
        ids, n = store.take(at[parts.indices.to_numpy()].reshape(2, -1).T.ravel())
        kept = np.flatnonzero(pc.utf8_length(new.words).to_numpy() <= KEPT_LENGTH)  # longer ones seldom come again
        self.known = self.known.and_(Words(new.words.take(pa.array(kept)), *new.take(kept)))
        return Words(words, ids, n.reshape(-1, 2).sum(axis=1))

    def encode(self, texts: list[str]) -> list[bytes]:
        """The ids of each text as little-endian unsigned 32-bit integers."""
        lowered = [t.lower() if _is_latin(t) else t for t in texts]  # the tokenizer lowers such letters in the same way
        # added tokens are found in the text as it is, before words are; such a text takes the tokenizer's own way
        special = [k for k, t in enumerate(lowered) if any(x in t for x in self.added)]
        for k in special:
            lowered[k] = ""
        split = pc.split_pattern(pc.replace_substring(pa.array(lowered, pa.large_string()), "\n", " "), " ")
        edge, words = split.offsets.to_numpy(), split.flatten().dictionary_encode()
        ids, n = self.learn(words.dictionary).take(words.indices.to_numpy())
        data, edge = ids.tobytes(), 4 * np.r_[0, np.cumsum(n)][edge - edge[0]]
        out = [data[a:b] for a, b in zip(edge[:-1].tolist(), edge[1:].tolist(), strict=True)]
        for k in special:
            out[k] = np.array(self.tokenizer.encode(texts[k], add_special_tokens=False).ids, "<u4").tobytes()
        return out


def _after(words: pa.Array, skip: np.ndarray) -> pa.Array:
    """Each word without its first bytes."""
    data, offsets = utf8_views(words)
    n = np.diff(offsets) - skip
    edge = np.r_[0, np.cumsum(n)]
    tail = data[np.repeat(offsets[:-1] + skip - edge[:-1], n) + np.arange(edge[-1])]
    return pa.LargeStringArray.from_buffers(len(n), pa.py_buffer(edge.astype(np.int64)), pa.py_buffer(tail))


def _is_latin(text: str) -> bool:
    try:
        text.encode("latin-1")
    except UnicodeEncodeError:
        return False
    return True


#: A worker process serves many tasks; those of other operators empty this.
_CACHES: dict[str, WordCache] = CACHES.setdefault("packing", {})


def _cache(path: str) -> WordCache:
    if path not in _CACHES:
        _CACHES[path] = WordCache(path)
    return _CACHES[path]


def _slices(batch: pa.RecordBatch, most: int) -> Iterator[pa.RecordBatch]:
    """The batch in slices of at most `most` bytes of its last column, or one row."""
    _, offsets = utf8_views(batch.column(batch.num_columns - 1))
    at = 0
    while at < batch.num_rows:
        to = max(at + 1, int(np.searchsorted(offsets, offsets[at] + most, "right")) - 1)
        yield batch.slice(at, to - at)
        at = to


def _pieces(path: str, size: int, end: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import os

        os.environ["TOKENIZERS_PARALLELISM"] = "false"  # a task has one core
        words, stop = _cache(path), np.array([end], "<u4").tobytes()
        for batch in batches:
            for part in _slices(batch, SLICE):
                rows = []
                for doc, ids in zip(part.column(0).to_pylist(), words.encode([t or "" for t in part.column(1).to_pylist()]), strict=True):
                    ids += stop
                    for k, at in enumerate(range(0, len(ids), 4 * size)):
                        piece = ids[at : at + 4 * size]
                        rows.append((doc, k, at // 4, len(piece) // 4, zlib.crc32(piece)))
                cols = zip(*rows, strict=True)
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, (pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int64()), strict=True)], names="doc_id piece start length ids_crc32".split())

    return run


def tokenized_pieces(docs: DataFrame, path: str, size: int = 4096, end: int = 1, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, piece, start, length, ids_crc32): each document's ids and the end id, cut only where longer than size."""
    small_batches(docs.sparkSession)
    rows = docs.select(F.col(f"`{id_col}`").cast("long"), F.col(f"`{text_col}`").cast("string"))
    return rows.mapInArrow(giving_back(_pieces(path, size, end), "packing"), "doc_id long, piece int, start long, length long, ids_crc32 long")


def knapsack(sizes: np.ndarray, worth: np.ndarray, most: np.ndarray, room: int) -> np.ndarray:
    """How many of each size the most valuable filling of the room takes, at most `most` of each; worth: integers."""
    stages = [np.zeros(room + 1, np.int64)]
    for w, v, n in zip(sizes.tolist(), worth.tolist(), np.minimum(most, room // sizes).tolist()):
        best = stages[-1].copy()
        k = 1
        while n > 0:  # 1, 2, 4, ... copies at once reach every number of them
            k = min(k, n)
            np.maximum(best[k * w :], best[: -k * w] + k * v, out=best[k * w :])
            n -= k
            k *= 2
        stages.append(best)
    took, c = np.zeros(len(sizes), np.int64), room
    for k in range(len(sizes) - 1, -1, -1):
        w, v = int(sizes[k]), int(worth[k])
        while stages[k][c - took[k] * w] + took[k] * v != stages[k + 1][c]:
            took[k] += 1
        c -= int(took[k]) * w
    return took


def linear_program(sizes: np.ndarray, demand: np.ndarray, room: int, rounds: int = ROUNDS, step: float = 0.125, rate: float = 24.0) -> tuple[np.ndarray, np.ndarray, float]:
    """Configurations, how many sequences have each (a fraction), and a lower bound on the number of sequences.

    The program: least total of sequences so that the configurations hold each size as often as it is demanded. A size
    weighs exp(-rate x its covered share), its price is that over its demand, and each round adds the configuration that
    the knapsack finds for the prices, as far as it covers `step` of the demand of one of its sizes. Prices over the
    value of that configuration are a solution of the dual program, so each round gives a bound.
    """
    covered, found, bound = np.zeros(len(sizes)), {}, 0.0
    for _ in range(rounds):
        short = covered < 1
        if not short.any():
            break
        weight = np.where(short, np.exp(-rate * (covered - covered.min())), 0.0)
        price = weight / demand
        worth = np.floor(price * (2.0**40 / price.max())).astype(np.int64)
        config = knapsack(sizes, worth, demand, room)
        bound = max(bound, float(worth @ demand) / float(worth @ config))
        used = config > 0
        x = float((step * demand[used] / config[used]).min())
        covered = covered + config * x / demand
        found.setdefault(config.tobytes(), [config, 0.0])[1] += x
    if not found:
        return np.zeros((0, len(sizes)), np.int64), np.zeros(0), bound
    return np.array([c for c, _ in found.values()]), np.array([x for _, x in found.values()]), bound


def grouped(lengths: np.ndarray, count: np.ndarray, groups: int) -> np.ndarray:
    """The first place of each group, of the descending lengths, so that groups have about equal sums of lengths."""
    mass = np.cumsum(lengths * count)
    turn = (mass - 1) * groups // mass[-1]
    return np.flatnonzero(np.r_[True, turn[1:] != turn[:-1]])


class Plan:
    """Which ranks of which lengths go where; sequences with equal contents are dealt with together."""

    def __init__(self, counts: dict[int, int], size: int):
        self.size, self.sequences = size, 0
        self.from_program = 0  # sequences that configurations of the linear program began
        self.count = np.zeros(size + 1, np.int64)
        self.count[list(counts)] = list(counts.values())
        self.left = self.count.copy()
        self.rows: list[tuple[int, int, int, int, int, int]] = []
        self.gaps: list[int] = []  # ascending
        self.open: dict[int, list[tuple[int, int]]] = {}

    def put(self, length: int, each: int, times: int, sequence: int, offset: int) -> None:
        """`each` items of the length into each of `times` sequences."""
        lo = int(self.count[length] - self.left[length])
        self.rows.append((length, lo, lo + each * times, times, sequence, offset))
        self.left[length] -= each * times

    def leave(self, gap: int, sequence: int, times: int) -> None:
        if gap and times:
            if gap not in self.open:
                insort(self.gaps, gap)
                self.open[gap] = []
            self.open[gap].append((sequence, times))

    def best_fit(self) -> None:
        """All that is left, long ones first, each where it leaves the smallest gap."""
        for length in np.flatnonzero(self.left)[::-1].tolist():
            while n := int(self.left[length]):
                at = bisect_left(self.gaps, length)
                if at == len(self.gaps):
                    each = min(n, self.size // length)
                    gap, sequence, times = self.size, self.sequences, n // each
                    have = times
                    self.sequences += times
                else:
                    gap = self.gaps[at]
                    sequence, have = self.open[gap].pop()
                    if not self.open[gap]:
                        del self.open[gap], self.gaps[at]
                    each = min(n, gap // length)
                    times = min(have, n // each)
                self.put(length, each, times, sequence, self.size - gap)
                self.leave(gap, sequence + times, have - times)
                self.leave(gap - each * length, sequence, times)

    def by_program(self, program: tuple[np.ndarray, ...], kept_back: float, slack: int) -> None:
        """Sequences by the rounded linear program; the shortest lengths, `kept_back` of the sum, stay to fill gaps."""
        shortest, longest, configs, x = program
        mass = np.cumsum(np.arange(self.size + 1) * self.left)
        few = int(np.searchsorted(mass, kept_back * mass[-1]))
        short = self.left[:few].copy()
        self.left[:few] = 0
        # rounded by carrying the fractions on, so that the total stays
        times = np.diff(np.floor(np.r_[0, np.cumsum(x)] + 0.5).astype(np.int64))
        for config, n in zip(configs, times.tolist(), strict=True):
            slots = np.repeat(np.arange(len(config)), config).tolist()
            self.deal([(int(shortest[g]), int(longest[g])) for g in slots], n, slack)
        self.left[:few] = short

    def deal(self, slots: list[tuple[int, int]], times: int, slack: int) -> None:
        """times sequences, or fewer if lengths run out: an item for each slot but the last, then one or two that leave at most `slack`."""
        while times:
            config: Counter[int] = Counter()
            for low, high in slots[:-1] or slots:
                free = self.left[low : high + 1].copy()
                for k in config.keys() & set(range(low, high + 1)):
                    free[k - low] -= config[k]
                there = np.flatnonzero(free)
                if not len(there):
                    return
                config[low + int(there[-1])] += 1
            room = self.size - sum(k * n for k, n in config.items())
            free = self.left.copy()
            for k, n in config.items():
                free[k] -= n
            for gap in range(min(slack + 1, room)):
                if rest := one_or_two(free, room - gap):
                    break
            else:
                rest = []
                if room and len(slots) > 1:
                    return
            config.update(rest)
            n = min(times, min(int(self.left[k]) // n for k, n in config.items()))
            offset = 0
            for k, each in config.items():
                self.put(k, each, n, self.sequences, offset)
                offset += k * each
            self.leave(self.size - offset, self.sequences, n)
            self.sequences += n
            self.from_program += n
            times -= n


def one_or_two(left: np.ndarray, room: int) -> list[int]:
    """The one or two lengths that fill the room exactly, the most frequent of those left; empty if there are none.

    Pairs of lengths that are near to each other come first, so that the shortest stay to fill gaps at the end.
    """
    for least in (room // 3, room // 8, 1):
        low = np.arange(max(least, 1), room // 2 + 1)
        pairs = np.minimum(left[low], left[room - low])
        if len(pairs) and not room % 2:
            pairs[-1] = left[room // 2] // 2
        at = int(pairs.argmax()) if len(pairs) else 0
        if len(pairs) and pairs[at] > left[room]:
            return [int(low[at]), room - int(low[at])]
        if left[room]:
            return [room]
    return []


def grouped_program(counts: dict[int, int], size: int, groups: int, rounds: int) -> tuple[np.ndarray, ...]:
    """Shortest and longest length of each group, and the linear program's configurations and numbers of sequences."""
    lengths = np.array(sorted((k for k in counts if k < size), reverse=True), np.int64)
    if not len(lengths):
        return lengths, lengths, np.zeros((0, 0), np.int64), np.zeros(0)
    count = np.array([counts[k] for k in lengths.tolist()], np.int64)
    first = grouped(lengths, count, groups)
    configs, x, _ = linear_program(lengths[first], np.add.reduceat(count, first), size, rounds)
    return lengths[np.r_[first[1:], len(lengths)] - 1], lengths[first], configs, x


def plan(counts: dict[int, int], size: int, rounds: int = ROUNDS, groups: int = GROUPS) -> Plan:
    """The plan with the fewest sequences: by the linear program and then best fit, or by best fit alone."""
    counts = {k: n for k, n in counts.items() if n}
    program, found = grouped_program(counts, size, groups, rounds), []
    for kept_back, slack in TRIES:
        found.append(Plan(counts, size))
        found[-1].by_program(program, kept_back, slack)
        found[-1].best_fit()
    found.append(Plan(counts, size))
    found[-1].best_fit()
    return min(found, key=lambda p: p.sequences)


def _placed(rows: np.ndarray, names: list[str], at_length: int):
    """From (__rank, other columns with length): sequence_id and offset in place of the rank."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        length, lo, _, times, sequence, offset = rows.T
        key = (length << 50) + lo
        for batch in batches:
            rank, of = batch.column(0).to_numpy(), batch.column(at_length).to_numpy()
            at = np.searchsorted(key, (of << 50) + rank, "right") - 1
            turn = rank - lo[at]
            yield pa.RecordBatch.from_arrays([*batch.columns[1:], pa.array(sequence[at] + turn % times[at]), pa.array(offset[at] + turn // times[at] * of)], names=names)

    return run


def pack(pieces: DataFrame, size: int = 4096, rounds: int = ROUNDS) -> DataFrame:
    """pieces (with length, a long from 1 to size), and sequence_id and offset (long). Other columns pass through."""
    spark = pieces.sparkSession
    pieces = materialize(pieces, "pieces")
    counts = {r[0]: r[1] for r in pieces.groupBy("length").count().collect()}  # at most size rows
    rows = np.array(sorted(plan(counts, size, rounds).rows), np.int64).reshape(-1, 6)  # bounded by size and rounds, not by the input
    cols = [F.col(f"`{c}`") for c in pieces.columns]
    deal = pieces.withColumn("__cell", F.pmod(F.xxhash64(*cols), F.lit(partitions(spark))))
    cells = deal.groupBy("length", "__cell").count()
    before = F.sum("count").over(Window.partitionBy("length").orderBy("__cell")) - F.col("count")
    cells = cells.select("length", "__cell", before.alias("__before"))
    # ordered by all columns: a task that runs again ranks its rows as before
    ranked = deal.withColumn("__rank", F.row_number().over(Window.partitionBy("length", "__cell").orderBy(*cols)) - 1)
    ranked = ranked.join(cells, ["length", "__cell"]).select((F.col("__rank") + F.col("__before")).alias("__rank"), *cols)
    names = [*pieces.columns, "sequence_id", "offset"]
    fields = "".join(f"`{f.name}` {f.dataType.simpleString()}, " for f in pieces.schema)
    return map_arrow(ranked, _placed(rows, names, pieces.columns.index("length") + 1), fields + "sequence_id long, offset long")
