"""Near-duplicates by SimHash and pivot distances, verified by the similarity of word shingles; an exact join finds the rest.

Documents link where the sets of their 5-word shingles (as XXH64 hashes) have a Jaccard similarity of at least 0.8; a
class is a connected component of links. The first pairs are those of SimHash: each set has a fingerprint, fingerprints
within RADIUS bits are found by their distances to references (simhash.link_edges), and the sets of each pair are compared.
SimHash alone does not reach this rule: at 0.8 two 64-bit fingerprints differ in about 10 bits, and bands that let 10 bits
differ have 5 or 6 bits each, which nearly all documents share. So an exact join follows, for what is not in one class yet.

The sets are put in one order, in which frequent shingles are last. Of two that link, the beginnings, of size - least
overlap + 1 shingles, have a shingle in common, so documents meet under the shingles of their beginnings; sizes and places
rule most pairs out, and the sets of the rest are compared. Any order gives the same links, so frequencies need only be
about right: they are counted in pieces of a task, and at most FREQUENT shingles count as frequent.

Only classes are asked for, so a group of near copies is not expanded into its pairs: under each shingle documents are
first compared with their neighbours in one or another order (ROUNDS of them), then each with the one under its shingle that
has the most links so far, an original of which the others are copies, say. These are as many pairs as rows and join most
of a group; then pairs are formed of documents that share a shingle and are not in one class yet. A sketch rules most of these
out before they are written: a bit for each of SKETCH bins, whether the set has an odd number of hashes in it. Sets that differ
in d hashes have sketches that differ in d bits at most, so a pair whose sketches differ in more bits than its sizes allow cannot link.

Sets are told apart by 128 bits of their hash. Its first half is a set's key; where sets share that half, which at many
billions of texts some will, their keys are made of both halves.

Texts with fewer words than a shingle are one shingle; null and wordless texts have the empty set and are one class.
"""

from __future__ import annotations

from collections.abc import Iterator
from fractions import Fraction
from itertools import repeat

import numpy as np
import pyarrow as pa
import xxhash
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import bitmap, chained, giving_back, id_key, map_arrow, materialize, partitions, small_batches, utf8_views, where_marked
from .simhash import components, fingerprint_of
from .simhash import link_edges as fingerprint_edges

WORDS = 5
SIMILARITY = 0.8
RADIUS = 2
FREQUENT = 100_000
ROUNDS = 2
SKETCH = 512


def shingles(data: bytes, words: int = WORDS) -> np.ndarray:
    """The distinct hashes of a text's shingles, sorted."""
    w = data.lower().split()  # of bytes: A-Z only, and the six ASCII spaces
    if len(w) <= words:
        texts = [b" ".join(w)] if w else []
    else:
        texts = map(b" ".join, zip(*(w[k:] for k in range(words)), strict=False))
    return np.unique(np.fromiter(map(xxhash.xxh64_intdigest, texts, repeat(42)), np.uint64)).view(np.int64)


def _sets(batch: pa.RecordBatch, words: int) -> Iterator[np.ndarray]:
    """The set of each text of the last column."""
    data, offsets = utf8_views(batch.column(batch.num_columns - 1))
    data, at = data.tobytes(), offsets.tolist()
    for a, b in zip(at[:-1], at[1:], strict=True):
        yield shingles(data[a:b], words)


def _digest(s: np.ndarray) -> bytes:
    return xxhash.xxh3_128_digest(s.tobytes(), 7)


def _keys(words: int):
    """The text, last, is replaced by its compressed bytes, which are shuffled in its place, and followed by its set's fingerprint and both halves of its set's hash."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pack = zstandard.ZstdCompressor(level=3)
        for batch in batches:
            numbers = np.array([[fingerprint_of(s), *np.frombuffer(_digest(s), np.int64)] for s in _sets(batch, words)], np.int64).reshape(-1, 3)
            z = [None if t is None else pack.compress(t.encode()) for t in batch.column(batch.num_columns - 1).to_pylist()]
            numbers = (pa.array(np.ascontiguousarray(c)) for c in numbers.T)
            yield pa.RecordBatch.from_arrays([*batch.columns[:-1], pa.array(z, pa.binary()), *numbers], names=[*batch.schema.names, "__code", "__fp", "__fp2"])

    return run


def _unpacked(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The last column, compressed, as text."""
    unpack = zstandard.ZstdDecompressor()
    for batch in batches:
        text = pa.array([None if z is None else unpack.decompress(z).decode() for z in batch.column(batch.num_columns - 1).to_pylist()], pa.string())
        yield pa.RecordBatch.from_arrays([*batch.columns[:-1], text], names=batch.schema.names)


def _counts(words: int, at_once: int = 1_000_000, least: int = 3):
    """(h, n): the shingles that at least a few of the documents of a piece have."""

    def count(held: list[np.ndarray]) -> pa.RecordBatch:
        h, n = np.unique(np.concatenate(held), return_counts=True)
        return pa.RecordBatch.from_arrays([pa.array(h[n >= least]), pa.array(n[n >= least])], names=["h", "n"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, size = [], 0
        for batch in batches:
            for s in _sets(batch, words):
                held.append(s)
                size += len(s)
            if size >= at_once:
                yield count(held)
                held, size = [], 0
        if held:
            yield count(held)

    return run


def _beginnings(words: int, limit: Fraction, frequent: np.ndarray, place: np.ndarray):
    """From (key, text), (token, size, key, at): the first shingles of each set in the common order."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            token, size, key, at = [], [], [], []
            for k, s in zip(batch.column(0).to_pylist(), _sets(batch, words), strict=True):
                n = len(s) - -(-len(s) * limit.numerator // limit.denominator) + 1
                if not len(s):
                    continue
                if len(frequent):
                    j = np.minimum(np.searchsorted(frequent, s), len(frequent) - 1)
                    s = s[np.argsort(np.where(frequent[j] == s, place[j], -1), kind="stable")]
                token.append(s[:n])
                size.append(np.full(n, len(s)))
                key.append(np.full(n, k))
                at.append(np.arange(n))
            if token:
                yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(c)) for c in (token, size, key, at)], names=["token", "size", "key", "at"])

    return run


def _shared(limit: Fraction):
    """From (token, size, key, at), sorted: the rows whose token has another row of a size that may link."""
    p, q = limit.numerator, limit.denominator

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last, good = np.zeros((0, 4), np.int64), False
        for batch in batches:
            if not batch.num_rows:
                continue
            rows = np.concatenate([last, np.column_stack([batch.column(k).to_numpy() for k in range(4)])])
            near = (rows[1:, 0] == rows[:-1, 0]) & (rows[:-1, 1] * q >= rows[1:, 1] * p)  # of neighbours: sizes ascend
            keep = np.r_[near, False] | np.r_[False, near]
            keep[0] |= good and len(last) > 0
            yield _rows(rows[:-1][keep[:-1]])
            last, good = rows[-1:], bool(keep[-1])
        if good:
            yield _rows(last)

    return run


def _rows(rows: np.ndarray) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(np.ascontiguousarray(rows[:, k])) for k in range(4)], names=["token", "size", "key", "at"])


def _may_link(rows: np.ndarray, i: np.ndarray, j: np.ndarray, limit: Fraction) -> np.ndarray:
    """Whether sizes, places and sketches let rows i and j (token, class, size, key, at, sketch) link, and their classes differ."""
    p, q = limit.numerator, limit.denominator
    m, n = rows[i, 2], rows[j, 2]
    most = np.minimum(m - rows[i, 4], n - rows[j, 4])
    may = (rows[i, 1] != rows[j, 1]) & (np.minimum(m, n) * q >= np.maximum(m, n) * p) & (most * (p + q) >= p * (m + n))
    if rows.shape[1] > 5:
        k = np.flatnonzero(may)
        apart = np.bitwise_count((rows[i[k], 5:] ^ rows[j[k], 5:]).view(np.uint64)).sum(axis=1, dtype=np.int64)
        may[k] = apart * (p + q) <= (q - p) * (m + n)[k]
    return may


def _distinct(rows: np.ndarray, i: np.ndarray, j: np.ndarray) -> pa.RecordBatch:
    a, b = rows[i, 3], rows[j, 3]
    pairs = np.unique(np.column_stack([np.minimum(a, b), np.maximum(a, b)]), axis=0)
    return pa.RecordBatch.from_arrays([pa.array(np.ascontiguousarray(pairs[:, k])) for k in range(2)], names=["a", "b"])


def _neighbours(limit: Fraction):
    """From (token, class, size, key, at), sorted by token and any order: pairs of neighbours that may link."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last = np.zeros((0, 5), np.int64)
        for batch in batches:
            if batch.num_rows:
                rows = np.concatenate([last, np.column_stack([batch.column(k).to_numpy() for k in range(5)])])
                i = np.flatnonzero(rows[1:, 0] == rows[:-1, 0])
                i = i[_may_link(rows, i, i + 1, limit)]
                yield _distinct(rows, i, i + 1)
                last = rows[-1:]

    return run


def _hubs(limit: Fraction):
    """From (token, class, size, key, at), sorted by token and links so far: pairs of a token's first with its others that may link."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        first = np.zeros((0, 5), np.int64)
        for batch in batches:
            if batch.num_rows:
                rows = np.concatenate([first, np.column_stack([batch.column(k).to_numpy() for k in range(5)])])
                hub = np.searchsorted(rows[:, 0], rows[:, 0])
                j = np.flatnonzero(_may_link(rows, hub, np.arange(len(rows)), limit))
                yield _distinct(rows, hub[j], j)
                first = rows[hub[-1:]]

    return run


def _sketches(words: int):
    """From (key, compressed text): the key and the sketch of its set as numbers."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        unpack = zstandard.ZstdDecompressor()
        for batch in batches:
            sets = (shingles(unpack.decompress(z), words) for z in batch.column(1).to_pylist())
            odd = [np.packbits(np.bincount(s & (SKETCH - 1), minlength=SKETCH) & 1).view(np.int64) for s in sets]
            odd = np.array(odd, np.int64).reshape(-1, SKETCH // 64)
            yield pa.RecordBatch.from_arrays([batch.column(0), *(pa.array(np.ascontiguousarray(c)) for c in odd.T)], names=["key", *_sketch_names()])

    return run


def _sketch_names() -> list[str]:
    return [f"sketch{k}" for k in range(SKETCH // 64)]


def _across(limit: Fraction, at_once: int = 50_000, pairs_at_once: int = 100_000):
    """From (token, class, size, key, at, sketch), sorted by token and class: all pairs of different classes that may link."""

    def meet(rows: np.ndarray) -> Iterator[pa.RecordBatch]:
        token = rows[:, 0]
        end = np.searchsorted(token, token, "right")
        block = np.flatnonzero(np.r_[True, (rows[1:, :2] != rows[:-1, :2]).any(axis=1)])
        own_end = np.r_[block[1:], len(rows)][np.searchsorted(block, np.arange(len(rows)), "right") - 1]
        n = end - own_end
        total, lo = np.cumsum(n), 0
        while lo < len(rows):
            hi = max(lo + 1, int(np.searchsorted(total, total[lo] - n[lo] + pairs_at_once, "right")))
            i = np.repeat(np.arange(lo, hi), n[lo:hi])
            j = own_end[i] + np.arange(len(i)) - np.repeat(total[lo:hi] - n[lo:hi] - (total[lo] - n[lo]), n[lo:hi])
            may = _may_link(rows, i, j, limit)
            if may.any():
                yield _distinct(rows, i[may], j[may])
            lo = hi

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[np.ndarray] = []
        n, most = 0, at_once
        for batch in batches:
            held.append(np.column_stack([c.to_numpy() for c in batch.columns]))
            n += batch.num_rows
            if n >= most:
                rows = np.concatenate(held)
                cut = int(np.searchsorted(rows[:, 0], rows[-1, 0]))
                if cut:
                    yield from meet(rows[:cut])
                held, n = [rows[cut:]], len(rows) - cut
                most = max(at_once, 2 * n)  # a token with many rows is put together a few times only
        if n:
            yield from meet(np.concatenate(held))

    return run


def _verified(limit: Fraction, words: int):
    """From (a, b, compressed texts of a and b): (v, m) of the pairs that link."""
    p, q = limit.numerator, limit.denominator

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        unpack = zstandard.ZstdDecompressor()
        for batch in batches:
            link = []
            for x, y in zip(batch.column(2).to_pylist(), batch.column(3).to_pylist(), strict=True):
                both = np.sort(np.concatenate([shingles(unpack.decompress(z), words) for z in (x, y)]))
                link.append(int((both[1:] == both[:-1]).sum()) * (p + q) >= p * len(both))
            link = pa.array(link, pa.bool_())
            yield pa.RecordBatch.from_arrays([batch.column(1).filter(link), batch.column(0).filter(link)], names=["v", "m"])

    return run


def alike(codes: DataFrame, radius: int = RADIUS) -> DataFrame:
    """From (key, code), each key once: pairs (a, b) of keys whose fingerprints, the codes, link them, directly or over others.

    Each key of a code is paired with the code's first, and this with the first of the codes it links with: these pairs have the
    classes of all links, and are as many as a spanning forest has in each block.
    """
    firsts = materialize(codes.groupBy("code").agg(F.min("key").alias("first")), "codes")
    edges = fingerprint_edges(firsts.select(F.col("code").alias("fp")), radius)
    ends = edges.join(firsts.toDF("v", "x"), "v").join(firsts.toDF("m", "y"), "m").select(F.least("x", "y").alias("a"), F.greatest("x", "y").alias("b"))
    return codes.join(firsts, "code").where("key != first").select(F.col("first").alias("a"), F.col("key").alias("b")).union(ends)


def link_edges(best: DataFrame, words: int = WORDS, similarity: float = SIMILARITY, frequent: int = FREQUENT) -> DataFrame:
    """(v, m): links between the keys of best (key, code: fingerprint, z: compressed text; each key and each set once) that have the components of all links."""
    n, limit = partitions(best.sparkSession), Fraction(similarity).limit_denominator(1000)
    texts = best.select("key", "z")
    top = texts.mapInArrow(giving_back(chained(_unpacked, _counts(words))), "h long, n long").groupBy("h").agg(F.sum("n").alias("n")).orderBy(F.desc("n"), "h").limit(frequent).toArrow()
    h, count = (top.column(k).to_numpy() for k in ("h", "n"))
    order = np.argsort(h)
    starts = texts.mapInArrow(giving_back(chained(_unpacked, _beginnings(words, limit, h[order], count[order]))), "token long, size long, key long, at long")
    met = starts.repartition(n, "token").sortWithinPartitions("token", "size", "key")
    shared = materialize(met.mapInArrow(giving_back(_shared(limit)), "token long, size long, key long, at long"), "shared")
    keys = shared.select("key").distinct()
    sets = texts.mapInArrow(giving_back(where_marked(bitmap(keys), "key")), "key long, z binary")
    sets = materialize(sets.join(keys, "key", "left_semi"), "sets")
    compared, edges = None, None
    for turn in range(-1, ROUNDS + 2):
        if turn > ROUNDS:
            compared, edges = compared.union(first_pairs), edges.union(first_links)
        classed = _classed(shared, edges)
        if turn < 0:
            pairs = alike(best.select("key", "code"))
        elif turn == ROUNDS:
            links = edges.select(F.explode(F.array("v", "m")).alias("end")).groupBy("end").agg(F.count("*").alias("links"))
            known = classed.join(links, F.col("key") == F.col("end"), "left").drop("end")
            pairs = known.repartition(n, "token").sortWithinPartitions("token", F.desc_nulls_last("links"), "key").drop("links").mapInArrow(giving_back(_hubs(limit)), "a long, b long")
        elif turn < ROUNDS:
            order = F.col("size") if turn == 0 else F.xxhash64("key", F.lit(turn))
            pairs = classed.repartition(n, "token").sortWithinPartitions("token", order, "key").mapInArrow(giving_back(_neighbours(limit)), "a long, b long")
        else:
            several = classed.groupBy("token").agg((F.min("class") != F.max("class")).alias("several")).where("several").select("token")
            sketched = sets.mapInArrow(giving_back(_sketches(words)), "key long, " + ", ".join(f"{c} long" for c in _sketch_names()))
            met = classed.join(several, "token", "left_semi").join(materialize(sketched, "sketches"), "key").select(*classed.columns, *_sketch_names())
            pairs = met.repartition(n, "token").sortWithinPartitions("token", "class").mapInArrow(giving_back(_across(limit)), "a long, b long")
        pairs = pairs.distinct()
        if compared is not None:
            pairs = pairs.join(compared, ["a", "b"], "left_anti")
        pairs = materialize(pairs, "pairs")
        both = pairs.join(sets.withColumnsRenamed({"key": "a", "z": "s"}), "a").join(sets.withColumnsRenamed({"key": "b", "z": "t"}), "b").select("a", "b", "s", "t")
        found = materialize(both.mapInArrow(giving_back(_verified(limit, words)), "v long, m long"), "links")
        if turn < 0:  # kept apart until the rest: these links would make hubs of the first of a fingerprint, which is seldom an original
            first_pairs, first_links = pairs, found
            continue
        compared = pairs if compared is None else compared.union(pairs)
        edges = found if edges is None else edges.union(found)
    return edges


def _classed(rows: DataFrame, edges: DataFrame | None) -> DataFrame:
    """rows (token, size, key, at) with the class of each key by the links so far."""
    if edges is None:
        return rows.select("token", F.col("key").alias("class"), "size", "key", "at")
    known = components(edges)
    return rows.join(known, rows["key"] == known["v"], "left").select("token", F.coalesce("m", "key").alias("class"), "size", "key", "at")


def _own_keys(best: DataFrame) -> DataFrame:
    """best (__fp, __fp2, row) with an __fp of its own for each set."""
    shared = best.groupBy("__fp").count().where("count > 1").select("__fp", F.lit(True).alias("__shared"))
    shared = materialize(shared, "shared-keys")
    if not shared.isEmpty():
        own = F.when(F.col("__shared"), F.xxhash64("__fp", "__fp2")).otherwise(F.col("__fp"))
        best = materialize(best.join(shared, "__fp", "left").select(own.alias("__fp"), "row"), "texts")
    return best.select("__fp", "row")


def one_of_each(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", words: int = WORDS, **options) -> DataFrame:
    """The rows of docs without near-duplicates: of each class the row with the smallest id (a null id is smallest)."""
    small_batches(docs.sparkSession)
    others = [c for c in docs.columns if c != text_col]
    last = docs.select(*[F.col(f"`{c}`") for c in others], F.col(f"`{text_col}`").cast("string"))
    fields = "".join(f"`{f.name}` {f.dataType.simpleString()}, " for f in last.schema[: len(others)])
    tagged = map_arrow(last, _keys(words), fields + "__z binary, __code long, __fp long, __fp2 long")
    row = F.struct(*[F.col(f"`{c}`") for c in others], "__z", "__code")
    best = tagged.groupBy("__fp", "__fp2").agg(F.min_by(row, F.struct(id_key(id_col), F.xxhash64("__z"))).alias("row"))
    best = _own_keys(materialize(best, "texts"))
    edges = link_edges(best.select(F.col("__fp").alias("key"), F.col("row.__code").alias("code"), F.coalesce("row.__z", F.lit(zstandard.ZstdCompressor().compress(b""))).alias("z")), words, **options)
    firsts = best.select("__fp", id_key(f"row.`{id_col}`").alias("key"))
    named = firsts.join(components(edges), firsts["__fp"] == F.col("v"), "left").select("__fp", "key", F.coalesce("m", "__fp").alias("root"))
    top = named.groupBy("root").agg(F.min(F.struct("key", "__fp")).alias("top")).select(F.col("top.__fp").alias("__fp"))
    kept = best.join(top, "__fp", "left_semi").select(*[F.col(f"row.`{c}`") for c in others], F.col("row.__z"))
    return map_arrow(kept, _unpacked, fields + f"`{text_col}` string").select(*[F.col(f"`{c}`") for c in docs.columns])
