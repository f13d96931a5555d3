"""SimHash near-duplicates by pivot distance tables.

A fingerprint has a bit set where over half the XXH64 hashes (seed 42) of the document's 3-word shingles have it; two
documents link where fingerprints differ in at most `radius` bits; a class is a connected component of links.

Distinct fingerprints only are compared. Each is dealt to one block for each of radius + 1 bands of its bits, so that
linked ones meet in a block (they differ in no bit of some band). In a block a table holds the distances of each
fingerprint to REFERENCES fixed reference fingerprints; by the triangle inequality a pair whose distances to any
reference differ by more than the radius cannot link. So the block is sorted by the first distance, only fingerprints
whose first distances are near are paired, pairs with a larger difference in any coordinate are discarded, and survivors
are verified. A block yields a spanning forest, not its pairs.

Blocks over MAX_BLOCK are split by their distances to one reference after another: a fingerprint goes to the cell of its
distance, and also to the one below if that is within the radius, so that linked ones still meet, whatever the radius.
Random codes lie about 32 +- 4 bits from a reference, so a reference makes about three cells. What LEVELS references
leave over MAX_BLOCK, codes much closer to each other than random ones, is compared as it is; at a radius up to 2 by a way
that is linear: such fingerprints meet under each code at distance 1 (65 keys each, links in a key to the one before).

Null and wordless texts have fingerprint 0. Rows with a null id get the class of their fingerprint; a class id is the
smallest id that isn't null. Repeated rows each get a row. Other columns do not matter.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce
from itertools import repeat

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import NULL_ID, giving_back, id_key, map_arrow, materialize, partitions, small_batches, utf8_views

REFERENCES = 32
MAX_BLOCK = 20_000
LEVELS = 8
_BITS = ((np.arange(256)[:, None] >> np.arange(8)) & 1).astype(np.int64)
_PLACE = (np.arange(8) * 256)[None, :]


def fingerprint(data: bytes, words: int = 3) -> int:
    w = data.lower().split()  # of bytes: A-Z only, and the six ASCII spaces
    if not w:
        return 0
    if len(w) <= words:
        shingles = [b" ".join(w)]
    else:
        shingles = map(b" ".join, zip(*(w[k:] for k in range(words)), strict=False))
    return fingerprint_of(np.fromiter(map(xxhash.xxh64_intdigest, shingles, repeat(42)), np.uint64))


def fingerprint_of(h: np.ndarray) -> int:
    """The bits that over half of 64-bit hashes have, as a signed long."""
    counts = np.bincount((h.view(np.uint8).reshape(-1, 8) + _PLACE).ravel(), minlength=2048).reshape(8, 256) @ _BITS
    return int.from_bytes(np.packbits((2 * counts > len(h)).ravel(), bitorder="little").tobytes(), "little", signed=True)


def _fingerprints(words: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            data, offsets = utf8_views(batch.column(batch.num_columns - 1))
            data, at = data.tobytes(), offsets.tolist()
            fp = [fingerprint(data[a:b], words) for a, b in zip(at[:-1], at[1:], strict=True)]
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(fp, pa.int64())], names=[*batch.schema.names, "__fp"])

    return run


def with_fingerprint(docs: DataFrame, text_col: str = "text", words: int = 3) -> DataFrame:
    """docs (its text column last) and __fp (long)."""
    small_batches(docs.sparkSession)
    docs = docs.select(*[F.col(f"`{c}`") for c in docs.columns if c != text_col], F.col(f"`{text_col}`").cast("string"))
    fields = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in docs.schema)
    return map_arrow(docs, _fingerprints(words), fields + ", __fp long")


def references(n: int = REFERENCES) -> np.ndarray:
    return np.random.default_rng(64).integers(0, 2**64, n, dtype=np.uint64)


def band_masks(n: int) -> list[int]:
    """n disjoint masks over the 64 bits, as signed longs."""
    edge = [64 * k // n for k in range(n + 1)]
    masks = [((1 << b) - (1 << a)) for a, b in zip(edge[:-1], edge[1:], strict=True)]
    return [m - 2**64 if m >= 2**63 else m for m in masks]


def labels(n: int, i: np.ndarray, j: np.ndarray) -> np.ndarray:
    """The smallest index of each of n nodes' component."""
    lab = np.arange(n)
    while len(i):
        a, b = lab[i], lab[j]
        apart = a != b
        i, j, a, b = i[apart], j[apart], a[apart], b[apart]
        np.minimum.at(lab, np.maximum(a, b), np.minimum(a, b))
        while True:
            up = lab[lab]
            if (up == lab).all():
                break
            lab = up
    return lab


def close_pairs(fp: np.ndarray, size: np.ndarray, radius: int, refs: np.ndarray, pairs_at_once: int = 500_000) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Of fingerprints that lie block after block, the linked pairs of one block, in pieces of bounded size."""
    table = np.bitwise_count(fp[:, None] ^ refs[None, :]).astype(np.int16)
    place = np.repeat(np.arange(len(size)) * 256, size) + table[:, 0]  # blocks apart by more than any distance
    order = np.argsort(place, kind="stable")
    place = place[order]
    # in the order of the first distances, a row meets the rows after it that are at most the radius further
    after = np.searchsorted(place, place + radius, "right") - np.arange(len(fp)) - 1
    rows = np.flatnonzero(after > 0)
    cut = np.cumsum(after[rows])
    at = 0
    while at < len(rows):
        to = max(at + 1, int(np.searchsorted(cut, (cut[at - 1] if at else 0) + pairs_at_once, "right")))
        r = rows[at:to]
        i = np.repeat(r, after[r])
        j = order[i + 1 + np.arange(len(i)) - np.repeat(np.cumsum(after[r]) - after[r], after[r])]
        i = order[i]
        for k in range(1, len(refs)):
            keep = np.abs(table[i, k] - table[j, k]) <= radius
            i, j = i[keep], j[keep]
            if len(i) < 64:
                break
        keep = np.bitwise_count(fp[i] ^ fp[j]) <= radius
        yield i[keep], j[keep]
        at = to


def _forest(fp: np.ndarray, pairs: Iterator[tuple[np.ndarray, np.ndarray]]) -> pa.RecordBatch | None:
    node, at = np.unique(fp.view(np.int64), return_inverse=True)
    lab = np.arange(len(node))
    for i, j in pairs:
        lab = labels(len(node), np.r_[at[i], np.arange(len(node))], np.r_[at[j], lab])
    tied = np.flatnonzero(lab != np.arange(len(node)))
    if not len(tied):
        return None
    return pa.RecordBatch.from_arrays([pa.array(node[tied]), pa.array(node[lab[tied]])], names=["v", "m"])


def _blocks(radius: int, at_once: int = 200_000):
    """From (band, value, fp), sorted: edges of a spanning forest of the blocks' links."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        refs = references()
        held: list[np.ndarray] = []

        def flush(rows: np.ndarray) -> pa.RecordBatch | None:
            head = np.r_[True, (rows[1:, :2] != rows[:-1, :2]).any(axis=1)]
            size = np.diff(np.r_[np.flatnonzero(head), len(rows)])
            fp = np.ascontiguousarray(rows[:, 2]).view(np.uint64)
            return _forest(fp, close_pairs(fp, size, radius, refs))

        n = 0
        for batch in batches:
            held.append(np.column_stack([batch.column(k).to_numpy() for k in range(3)]))
            n += batch.num_rows
            if n >= at_once:
                rows = np.concatenate(held)
                same = (rows[:, :2] == rows[-1, :2]).all(axis=1)
                cut = len(rows) - int(same.sum())
                if cut and (out := flush(rows[:cut])) is not None:
                    yield out
                held, n = [rows[cut:]], len(rows) - cut
        if n and (out := flush(np.concatenate(held))) is not None:
            yield out

    return run


def _balls(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """From fp: (key, fp) for each key that differs from it in at most one bit."""
    flips = np.r_[np.zeros(1, np.uint64), np.uint64(1) << np.arange(64, dtype=np.uint64)]
    for batch in batches:
        fp = batch.column(0).to_numpy().view(np.uint64)
        for lo in range(0, len(fp), 1000):
            part = fp[lo : lo + 1000]
            key = (part[:, None] ^ flips[None, :]).ravel()
            yield pa.RecordBatch.from_arrays([pa.array(key.view(np.int64)), pa.array(np.repeat(part, len(flips)).view(np.int64))], names=["key", "fp"])


def _key_links(radius: int):
    """From (key, fp), sorted: an edge from each fingerprint to the one before it under the key, if they link.

    Complete only at radius 2, at which all fingerprints of a key link.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last: list[np.ndarray] = [np.zeros(0, np.int64)] * 2
        for batch in batches:
            key, fp = (np.r_[a, batch.column(k).to_numpy()] for k, a in enumerate(last))
            hit = (key[1:] == key[:-1]) & (np.bitwise_count((fp[1:] ^ fp[:-1]).view(np.uint64)) <= radius)
            if hit.any():
                yield pa.RecordBatch.from_arrays([pa.array(np.maximum(fp[1:], fp[:-1])[hit]), pa.array(np.minimum(fp[1:], fp[:-1])[hit])], names=["v", "m"])
            last = [key[-1:], fp[-1:]]

    return run


def _with_count(rows: DataFrame) -> DataFrame:
    """rows (band, value, fp) of blocks with several fingerprints, and how many they have."""
    sizes = rows.groupBy("band", "value").count().where("count > 1")
    return materialize(rows.join(sizes, ["band", "value"]).select("band", "value", "fp", "count"), "blocks")


def link_edges(fps: DataFrame, radius: int = 2, max_block: int = MAX_BLOCK, levels: int = LEVELS) -> DataFrame:
    """(v, m): edges of a graph over the distinct fingerprints of fps (column fp) with the components of their links."""
    n = partitions(fps.sparkSession)
    masks = F.array(*[F.lit(m) for m in band_masks(radius + 1)])
    banded = fps.select("fp", F.posexplode(masks).alias("band", "mask")).select(F.col("band").cast("long"), F.col("fp").bitwiseAND(F.col("mask")).alias("value"), "fp")
    met = _with_count(banded)
    small, large = [met.where(F.col("count") <= max_block)], met.where(F.col("count") > max_block)
    width = 2 * (radius + 1)
    for ref in references().view(np.int64).tolist()[:levels]:
        if large.isEmpty():
            break
        far = F.bit_count(F.col("fp").bitwiseXOR(F.lit(ref)))
        cells = F.array_distinct(F.array(F.floor(far / width), F.floor((far - radius) / width)))
        split = large.withColumn("cell", F.explode(cells)).select("band", F.xxhash64("value", "cell").alias("value"), "fp")
        met = _with_count(split)
        small.append(met.where(F.col("count") <= max_block))
        large = met.where(F.col("count") > max_block)
    if radius > 2:
        small.append(large)  # a block in a task, in pieces
    blocks = reduce(DataFrame.union, small).select("band", "value", "fp").repartition(n, "band", "value").sortWithinPartitions("band", "value")
    edges = blocks.mapInArrow(giving_back(_blocks(radius)), "v long, m long")
    if radius in (1, 2) and not large.isEmpty():
        codes = large.select("fp").distinct()
        keys = codes.mapInArrow(giving_back(_balls), "key long, fp long")
        if radius == 1:  # a key links with a fingerprint only as one itself
            edges = edges.union(keys.where("key < fp").join(codes.withColumnRenamed("fp", "key"), "key").select(F.col("fp").alias("v"), F.col("key").alias("m")))
        else:
            edges = edges.union(keys.repartition(n, "key").sortWithinPartitions("key", "fp").mapInArrow(giving_back(_key_links(radius)), "v long, m long"))
    return edges


def _local_forest(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        if batch.num_rows:
            v, m = batch.column(0).to_numpy(), batch.column(1).to_numpy()
            out = _forest(np.r_[v, m], iter([(np.arange(len(v)), len(v) + np.arange(len(v)))]))
            if out is not None:
                yield out


def components(edges: DataFrame) -> DataFrame:
    """(v, m): for each node but the smallest of a component, that smallest node. Alternates large and small stars."""
    cur, before = materialize(edges.mapInArrow(giving_back(_local_forest), "v long, m long"), "edges"), None
    while True:
        both = cur.union(cur.select(F.col("m").alias("v"), F.col("v").alias("m")))
        least = both.groupBy("v").agg(F.min("m").alias("low")).select(F.col("v"), F.least("v", "low").alias("low"))
        large = both.join(least, "v").where("m > v").select(F.col("m").alias("v"), F.col("low").alias("m")).distinct()
        root = large.groupBy("v").agg(F.min("m").alias("low"))
        small = large.join(root, "v").where("m != low").select(F.col("m").alias("v"), F.col("low").alias("m")).union(root.select("v", F.col("low").alias("m"))).distinct()
        cur = materialize(small, "edges")
        now = cur.agg(F.count("*"), F.sum(F.xxhash64("v", "m").cast("decimal(38,0)")), F.countDistinct("v")).first()
        roots_free = now[0] == now[2]
        if now[:2] == before or now[0] == 0:
            return cur
        before = now[:2] if roots_free else None


def classes(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", radius: int = 2, words: int = 3, max_block: int = MAX_BLOCK) -> tuple[DataFrame, DataFrame]:
    """rows (id, fp) of docs, and (fp, component_id, winner): the class of each fingerprint, and which fingerprint holds its first row."""
    rows = with_fingerprint(docs.select(F.col(f"`{id_col}`"), F.col(f"`{text_col}`")), text_col, words)
    rows = materialize(rows.select(F.col(f"`{id_col}`").cast("long").alias("doc_id"), F.col("__fp").alias("fp")), "fingerprints")
    fps = rows.groupBy("fp").agg(F.min("doc_id").alias("low"), F.min(id_key("doc_id")).alias("key"))
    roots = components(link_edges(fps.select("fp"), radius, max_block))
    named = fps.join(roots, fps.fp == roots.v, "left").select("fp", "low", "key", F.coalesce("m", "fp").alias("root"))
    tops = named.groupBy("root").agg(F.min("low").alias("component_id"), F.min(F.struct("key", "fp")).alias("top"))
    return rows, named.join(tops, "root").select("fp", "component_id", F.col("top.fp").alias("winner"))


def near_duplicates(docs: DataFrame, **options) -> DataFrame:
    """(doc_id, fp long, component_id): a row for each row of docs."""
    rows, found = classes(docs, **options)
    return rows.join(found, "fp").select("doc_id", "fp", "component_id")


def one_of_each(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", **options) -> DataFrame:
    """The rows of docs without near-duplicates: of each class the row with the smallest id (a null id is smallest)."""
    _, found = classes(docs, id_col, text_col, **options)
    tagged = with_fingerprint(docs, text_col, options.get("words", 3))
    cols = [f"`{c}`" for c in docs.columns]
    best = tagged.groupBy("__fp").agg(F.min_by(F.struct(*cols), F.struct(id_key(id_col), F.xxhash64(f"`{text_col}`"))).alias("row"))
    top = found.where("fp = winner").select(F.col("fp").alias("__fp"))
    return best.join(top, "__fp", "left_semi").select(*[F.col(f"row.{c}") for c in cols])


__all__ = ["NULL_ID", "classes", "components", "fingerprint", "fingerprint_of", "link_edges", "near_duplicates", "one_of_each", "with_fingerprint"]
