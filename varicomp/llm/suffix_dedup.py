"""Exact removal of repeated byte strings by a sparse suffix array.

A byte goes if some `length`-byte string that covers it also starts earlier (smaller id, or the same document and an
earlier start). Of all suffixes only anchors are sorted: every window of `length` bytes has as its anchor the position
whose next GRAM bytes hash lowest, so equal windows have equal anchors, and about one position in 35 is one.

1. Each document is cut into segments, the runs of windows with one anchor. Sampled splitters range-partition the anchor
   suffixes by their leading bytes; each bucket is sorted, and neighbours are compared. A string that is a splitter itself
   is dealt out by what follows it, so equal suffixes always share a bucket and nothing straddles a boundary. A segment
   with the hash of an earlier one is a candidate for removal as a whole; an anchor with one segment only has no repeat.
2. Candidates and the segments they repeat are cut from the texts, sorted by their hash and compared byte for byte. Segments
   of several anchors may share a 64-bit hash: each then counts as a repeat of those with its own bytes alone. Should two of
   one anchor share it and differ, which a job of any size will hardly see, it fails rather than lose repeats. The segments of anchors that have several
   (the ends of repeated passages) are cut out too, their windows are ordered by a multikey quicksort over 8-byte words
   within each anchor, and equal neighbours give the exact ends. An anchor with more than HOT_ANCHOR segments is dealt out
   by the windows' own content instead, with the same result.
3. The spans are joined to the texts.

Rows that repeat an id are one document each, told apart and ordered by a 64-bit hash of the text; null ids sort first. Of rows with equal
id and equal text, all but one count as later copies. Null texts are empty. Other columns pass through.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .common import chained, giving_back, id_key, map_arrow, materialize, partitions, small_batches, utf8_views

GRAM = 32
HOT_ANCHOR = 50_000
BUCKET = 256 << 20  # bytes of anchors in a bucket, at most about
CHUNK = 1 << 18
_U = np.uint64
_MASK = _U(CHUNK * 2 - 1)
_MULTIPLIER = 0x9E3779B97F4A7C15


def _mix(x: np.ndarray) -> np.ndarray:
    x = x ^ (x >> _U(32))
    x = x * _U(0xD6E8FEB86659FD93)
    return x ^ (x >> _U(29))


class _Hasher:
    """Polynomial hashes modulo 2**64 of any substring of a buffer, from one running sum."""

    _cache: dict[int, tuple[np.ndarray, np.ndarray]] = {}

    def __init__(self, data: np.ndarray):
        n = len(data) + 1
        size = 1 << max(12, (n - 1).bit_length())
        if size not in self._cache:
            self._cache.clear()
            with np.errstate(over="ignore"):
                up = np.full(size, _U(_MULTIPLIER))
                down = np.full(size, _U(pow(_MULTIPLIER, -1, 2**64)))
                up[0] = down[0] = 1
                self._cache[size] = np.cumprod(up), np.cumprod(down)
        power, self.inverse = self._cache[size]
        self.sums = np.zeros(n, _U)
        np.cumsum(_TABLE[data] * power[: n - 1], out=self.sums[1:])

    def of(self, start: np.ndarray, end: np.ndarray) -> np.ndarray:
        return (self.sums[end] - self.sums[start]) * self.inverse[start]


_TABLE = np.random.default_rng(20).integers(1, 2**63, 256, dtype=np.uint64) * _U(2) + _U(1)


def _word(data: np.ndarray, at: np.ndarray) -> np.ndarray:
    """The 8 bytes from each place, so that their order is the numbers' order."""
    out = np.zeros(len(at), _U)
    for k in range(8):
        out = (out << _U(8)) | data[at + k]
    return out


def _sliding_min(x: np.ndarray, w: int) -> np.ndarray:
    done, cur = 1, x
    while done * 2 <= w:
        cur = np.minimum(cur[:-done], cur[done:])
        done *= 2
    return np.minimum(cur[: len(x) - w + 1], cur[w - done :]) if w > done else cur


def segments(data: np.ndarray, offsets: np.ndarray, length: int) -> Iterator[tuple[np.ndarray, ...]]:
    """For each chunk: row of the document, first and last window start in it, anchor hash, leading bytes, segment hash."""
    row, n_rows, span = 0, len(offsets) - 1, length - GRAM + 1
    while row < n_rows:
        last = row + 1
        while last < n_rows and offsets[last + 1] - offsets[row] <= CHUNK:
            last += 1
        lo, hi = int(offsets[row]), int(offsets[last])
        for at in range(lo, max(lo + 1, hi - length + 1), CHUNK):  # more than once only for one very long document
            part = data[at : min(hi, at + CHUNK + length - 1)]
            n = len(part)
            if n < length:
                break
            h = _Hasher(part)
            gram = _mix((h.sums[GRAM:] - h.sums[:-GRAM]) * h.inverse[: n - GRAM + 1])
            anchor = (_sliding_min((gram & ~_MASK) | np.arange(len(gram), dtype=_U), span) & _MASK).astype(np.int64)
            starts = np.arange(len(anchor))
            if last - row > 1:
                lengths = np.diff(offsets[row : last + 1])
                ends = np.repeat(offsets[row + 1 : last + 1] - lo, lengths)[: len(anchor)]
                valid = starts + length <= ends
            else:
                valid = np.ones(len(anchor), bool)
            turn = np.r_[True, anchor[1:] != anchor[:-1]]
            first = np.flatnonzero(valid & (turn | ~np.r_[False, valid[:-1]]))
            end = np.flatnonzero(valid & (np.r_[turn[1:], True] | ~np.r_[valid[1:], False]))
            place = anchor[first]
            of = np.searchsorted(offsets[row : last + 1] - at, first, "right") - 1
            shape = ((place - first) * 256 + (end - first)).astype(_U)
            seg = _mix(h.of(first, end + length) + shape * _U(0xC2B2AE3D27D4EB4F))
            doc_start = offsets[row + of] - at
            yield row + of, first - doc_start, end - doc_start, gram[place], _word(part, place), seg
        row = last


def merge_spans(doc: np.ndarray, start: np.ndarray, end: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Unions of overlapping or touching spans, by document."""
    if not len(doc):
        return doc, start, end
    o = np.lexsort((start, doc))
    doc, start, end = doc[o], start[o], end[o]
    base = np.cumsum(np.r_[0, doc[1:] != doc[:-1]]) * (int(end.max()) + 2)
    reach = np.maximum.accumulate(end + base)
    head = np.r_[True, (start + base)[1:] > reach[:-1]]
    at = np.flatnonzero(head)
    last = np.r_[at[1:], len(doc)] - 1
    return doc[at], start[at], (reach - base)[last]


def first_rows(keys: list[np.ndarray], order: list[np.ndarray]) -> np.ndarray:
    """For each row the one of smallest order among those with its keys; one of keys must tell nearly all apart."""
    out = np.arange(len(keys[0]))
    mixed = keys[0]
    for k in keys[1:]:
        mixed = _mix(mixed) + k
    o = np.argsort(mixed)
    same = mixed[o][1:] == mixed[o][:-1]
    at = o[np.r_[False, same] | np.r_[same, False]] if len(o) else o
    if len(at):
        at = at[np.lexsort([x[at] for x in (order[::-1] + keys[::-1])])]
        head = np.r_[True, np.any([x[at][1:] != x[at][:-1] for x in keys], axis=0)]
        out[at] = at[np.maximum.accumulate(np.where(head, np.arange(len(at)), 0))]
    return out


def equal_bytes(data: np.ndarray, a: np.ndarray, b: np.ndarray, n: np.ndarray, at_once: int = 1 << 22) -> np.ndarray:
    """Whether the n bytes from a and from b are the same."""
    out, total, lo = np.ones(len(a), bool), np.cumsum(n), 0
    while lo < len(a):
        hi = max(lo + 1, int(np.searchsorted(total, total[lo] + at_once)))
        row = np.repeat(np.arange(lo, hi), n[lo:hi])
        shift = np.arange(len(row)) - np.repeat(total[lo:hi] - n[lo:hi] - (total[lo] - n[lo]), n[lo:hi])
        out[row[data[a[row] + shift] != data[b[row] + shift]]] = False
        lo = hi
    return out


_ROW = "lead long, h long, seg long, doc long, th long, p long, e int"


def _pack(pos: np.ndarray, n: np.ndarray) -> np.ndarray:
    return (pos.astype(np.int64) << 8) | n.astype(np.int64)


def _unpack(p: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    return p >> 8, p & 255


def _batch(schema_names: str, *columns) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(c) for c in columns], names=schema_names.split())


def _cut(length: int):
    """From (doc, th, text): a row for each segment, and (e > 0) the spans that an equal segment of the same batch covers."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            doc, th = batch.column(0).to_numpy(zero_copy_only=False), batch.column(1).to_numpy(zero_copy_only=False)
            data, offsets = utf8_views(batch.column(2))
            found = list(segments(data, offsets, length))
            if not found:
                continue
            row, first, end, h, lead, seg = (np.concatenate(x) for x in zip(*found, strict=True))
            p = _pack(first, end - first)
            like = first_rows([h, seg], [doc[row], th[row], p])
            gone = (doc[row] != doc[row][like]) | (th[row] != th[row][like]) | (p != p[like])
            some = np.flatnonzero(gone)
            place = offsets[row] + first
            gone[some] = equal_bytes(data, place[some], place[like[some]], (end - first + length)[some])
            keep = ~gone
            yield _batch("lead h seg doc th p e", lead[keep].view(np.int64), h[keep].view(np.int64), seg[keep].view(np.int64), doc[row][keep], th[row][keep], p[keep], np.zeros(keep.sum(), np.int32))
            if gone.any():
                r, a, b = merge_spans(row[gone], first[gone], end[gone] + length)
                spread = _mix(_mix(r.astype(_U)) + a.astype(_U) + th[r].astype(_U)).view(np.int64)
                yield _batch("lead h seg doc th p e", spread, spread, spread, doc[r], th[r], _pack(a, np.zeros_like(a)), b.astype(np.int32))

    return run


def _to_bucket(lead: np.ndarray, h: np.ndarray, splitters: np.ndarray) -> np.ndarray:
    """Range of each suffix among the splitters; a string that several splitters equal is dealt out over them by what follows."""
    lo, hi = np.searchsorted(splitters, lead, "left"), np.searchsorted(splitters, lead, "right")
    return lo + (h.view(_U) % (hi - lo + 1).astype(_U)).astype(np.int64)


def _with_bucket(splitters: np.ndarray):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            lead, h = (batch.column(k).to_numpy() for k in (0, 1))
            to = _to_bucket(lead.view(_U), h, splitters)
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(to.astype(np.int32))], names=[*batch.schema.names, "bucket"])

    return run


def _neighbours(length: int):
    """From a sorted bucket: spans known to be repeats (h and v null), segments whose anchor has several (h set), and those
    that have the hash of others (v set, and equal for these)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = "doc th start stop h v"
        kept, forced = None, False  # first row of the last segment so far; whether its anchor is known to have several
        for turn, batch in enumerate(batches):
            cols = [batch.column(k).to_numpy() for k in range(7)]
            whole = cols[6] > 0
            if whole.any():
                a, _ = _unpack(cols[5][whole])
                yield _batch(names, cols[3][whole], cols[4][whole], a, cols[6][whole].astype(np.int64), *[pa.nulls(int(whole.sum()), pa.int64())] * 2)
                cols = [c[~whole] for c in cols]
            if not len(cols[0]):
                continue
            carried = kept is not None
            if carried:
                cols = [np.r_[np.array([k], c.dtype), c] for k, c in zip(kept, cols, strict=True)]
            lead, h, seg, doc, th, p, _ = cols
            new_group = np.r_[True, (lead[1:] != lead[:-1]) | (h[1:] != h[:-1])]
            new_seg = new_group | np.r_[True, seg[1:] != seg[:-1]]
            group = np.cumsum(new_group) - 1
            many = np.bincount(group, new_seg) >= 2
            many[0] |= forced
            first = np.maximum.accumulate(np.where(new_seg, np.arange(len(h)), 0))
            later = (doc != doc[first]) | (th != th[first]) | (p != p[first])
            if later.any():
                # under a key for each batch, so that a hash that very many segments have is compared by many tasks
                both = np.unique(np.r_[np.flatnonzero(later), first[later]])
                a, n = _unpack(p[both])
                yield _batch(names, doc[both], th[both], a, a + n + length, pa.nulls(len(both), pa.int64()), (_mix(h[both].view(_U) + np.full(1, turn, _U) * _U(_MULTIPLIER)) + seg[both].view(_U)).view(np.int64))
            open_ = new_seg & many[group]
            if carried and forced:
                open_[0] = False
            if open_.any():
                a, n = _unpack(p[open_])
                yield _batch(names, doc[open_], th[open_], a, a + n + length, h[open_], pa.nulls(len(a), pa.int64()))
            forced = bool(many[-1])
            at = first[-1]
            kept = [c[at] for c in cols]

    return run


def multikey_classes(data: np.ndarray, at: np.ndarray, cls: np.ndarray, length: int) -> np.ndarray:
    """Splits classes of windows by their bytes, a word at a time; only classes with several windows are looked at again."""
    for k in [*range(0, length - 8, 8), length - 8]:
        size = np.bincount(cls)
        live = np.flatnonzero(size[cls] > 1)
        if not len(live):
            break
        w, c = _word(data, at[live] + k), cls[live]
        o = np.lexsort((w, c))
        new = np.r_[True, (c[o][1:] != c[o][:-1]) | (w[o][1:] != w[o][:-1])]
        base = int(cls.max()) + 1
        out = cls.copy()
        out[live[o]] = base + np.cumsum(new) - 1
        cls = np.unique(out, return_inverse=True)[1]
    return cls


def _excerpts(length: int):
    """From (doc, th, packed text, segments): the bytes of each segment under its anchor, or of each window of a hot anchor;
    and those of each candidate and what it repeats (whole) under their hash."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        unpack = zstandard.ZstdDecompressor()
        for batch in batches:
            out: list[tuple] = []
            hot: list[tuple] = []
            for doc, th, z, starts, stops, hs, vs, is_hot in zip(*(batch.column(k).to_pylist() for k in range(8)), strict=True):
                text = unpack.decompress(z) if z else b""
                for a, b, h, v, many in zip(starts, stops, hs, vs, is_hot, strict=True):
                    if v is not None:
                        out.append((v, doc, th, a, text[a:b], True))
                    elif many:
                        hot += [(text[s : s + length], doc, th, s) for s in range(a, b - length + 1)]
                    else:
                        out.append((h, doc, th, a, text[a:b], False))
            first: dict[bytes, tuple] = {}
            for w in hot:
                if w[0] not in first or w[1:] < first[w[0]][1:]:
                    first[w[0]] = w
            gone = [w for w in hot if w[1:] != first[w[0]][1:]]
            if first:
                ws = list(first.values())
                data = np.frombuffer(b"".join(w[0] for w in ws), np.uint8)
                at = np.arange(len(ws)) * length
                keys = _mix(_Hasher(data).of(at, at + length)).view(np.int64).tolist()
                out += [(k, *w[1:], w[0], False) for k, w in zip(keys, ws, strict=True)]
            # a null key marks a span that is known already
            out += [(None, w[1], w[2], w[3], w[0], False) for w in gone]
            if out:
                h, doc, th, a, text, whole = zip(*out, strict=True)
                yield pa.RecordBatch.from_arrays([pa.array(h, pa.int64()), pa.array(doc, pa.int64()), pa.array(th, pa.int64()), pa.array(a, pa.int64()), pa.array(text, pa.binary()), pa.array(whole)], names="h doc th start bytes whole".split())

    return run


def _share_a_gram(a: bytes, b: bytes) -> bool:
    """Whether any GRAM bytes occur in both, as the anchor's do where it is one."""
    grams = {a[k : k + GRAM] for k in range(len(a) - GRAM + 1)}
    return any(b[k : k + GRAM] in grams for k in range(len(b) - GRAM + 1))


def _compare(length: int, at_once: int = 5_000):
    """From excerpts sorted by anchor or hash: the spans of windows, and of whole segments, that an equal, earlier one precedes."""

    def checked(batch: pa.RecordBatch, last: tuple) -> tuple[list, tuple]:
        """The later ones of whole segments of the same bytes, and the last hash with the first of each segment under it."""
        out = []
        for h, doc, th, start, data in zip(*(batch.column(k).to_pylist() for k in ("h", "doc", "th", "start", "bytes")), strict=True):
            if h != last[0]:
                last = h, {}
            if data not in last[1]:
                if any(_share_a_gram(data, other) for other in last[1]):
                    raise ValueError("two different segments of one anchor have one hash; run again with another multiplier")
                last[1][data] = doc, th, start
            elif (doc, th, start) != last[1][data]:
                out.append((doc, th, start, start + len(data)))
        return out, last

    def spans(part: pa.Table) -> pa.RecordBatch | None:
        part = part.combine_chunks()
        data, offsets = utf8_views(part.column("bytes").chunk(0))
        h, doc, th, start = (part.column(k).to_numpy() for k in ("h", "doc", "th", "start"))
        n = np.maximum(np.diff(offsets) - length + 1, 0)
        row = np.repeat(np.arange(len(n)), n)
        shift = np.arange(len(row)) - np.repeat(np.cumsum(n) - n, n)
        group = np.unique(h, return_inverse=True)[1]
        cls = multikey_classes(data, offsets[:-1][row] + shift, group[row], length)
        live = np.flatnonzero(np.bincount(cls, minlength=1)[cls] > 1) if len(cls) else row
        if not len(live):
            return None
        c, d, t, s = cls[live], doc[row][live], th[row][live], start[row][live] + shift[live]
        o = np.lexsort((s, t, d, c))
        c, d, t, s = c[o], d[o], t[o], s[o]
        head = np.r_[True, c[1:] != c[:-1]]
        first = np.maximum.accumulate(np.where(head, np.arange(len(c)), 0))
        later = (d != d[first]) | (t != t[first]) | (s != s[first])
        if not later.any():
            return None
        d, t, s = d[later], t[later], s[later]
        o = np.lexsort((s, t, d))
        d, t, s = d[o], t[o], s[o]
        key = np.cumsum(np.r_[0, (d[1:] != d[:-1]) | (t[1:] != t[:-1])])
        k, a, b = merge_spans(key, s, s + length)
        at = np.searchsorted(key, k)
        return _batch("doc th start stop", d[at], t[at], a, b)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []
        rows, last = 0, (None, {})
        for batch in batches:
            if pc.any(batch.column("whole")).as_py():
                out, last = checked(batch.filter(batch.column("whole")), last)
                if out:
                    yield _batch("doc th start stop", *(np.array(c, np.int64) for c in zip(*out, strict=True)))
                batch = batch.filter(pc.invert(batch.column("whole")))
            known = batch.column("h").is_null()
            if batch.column("h").null_count:
                sure = batch.filter(known)
                s = sure.column("start").to_numpy()
                yield _batch("doc th start stop", sure.column("doc").to_numpy(), sure.column("th").to_numpy(), s, s + length)
                batch = batch.filter(batch.column("h").is_valid())
            if not batch.num_rows:
                continue
            h = batch.column("h").to_numpy()
            cut = int(np.searchsorted(h, h[-1], "left"))  # the last anchor may go on
            ready = rows + cut
            if cut and ready >= at_once or held and rows >= at_once and h[0] != held[-1].column("h")[-1].as_py():
                if cut:
                    held.append(batch.slice(0, cut))
                if (out := spans(pa.Table.from_batches(held))) is not None:
                    yield out
                held, rows, batch = [], 0, batch.slice(cut)
            held.append(batch)
            rows += batch.num_rows
        if held and (out := spans(pa.Table.from_batches(held))) is not None:
            yield out

    return run


def _keep(n_pass: int, names: list[str]):
    """From (other columns, packed text, copy number, starts, stops): counts and the bytes that stay."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        unpack = zstandard.ZstdDecompressor()
        for batch in batches:
            size, gone, runs, kept = [], [], [], []
            for z, copy, length, starts, stops in zip(*(batch.column(n_pass + k).to_pylist() for k in range(5)), strict=True):
                text = unpack.decompress(z) if z else b""
                if copy > 1 and len(text) >= length:
                    starts, stops = [0], [len(text)]
                out, at, removed, n = [], 0, 0, 0
                if starts:
                    _, a, b = merge_spans(np.zeros(len(starts), np.int64), np.array(starts), np.array(stops))
                    n = len(a)
                    for s, e in zip(a.tolist(), b.tolist(), strict=True):
                        out.append(text[at:s])
                        removed += e - s
                        at = e
                out.append(text[at:])
                size.append(len(text)), gone.append(removed), runs.append(n), kept.append(b"".join(out))
            yield pa.RecordBatch.from_arrays([*batch.columns[:n_pass], pa.array(size, pa.int64()), pa.array(gone, pa.int64()), pa.array(runs, pa.int64()), pa.array(kept, pa.binary())], names=names)

    return run


def _packed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Compresses the last column, the text, before it is shuffled."""
    pack = zstandard.ZstdCompressor(level=1)
    for batch in batches:
        data, offsets = utf8_views(batch.column(batch.num_columns - 1))
        data = data.tobytes()
        z = [pack.compress(data[a:b]) if b > a else None for a, b in zip(offsets[:-1].tolist(), offsets[1:].tolist(), strict=True)]
        yield pa.RecordBatch.from_arrays([*batch.columns[:-1], pa.array(z, pa.binary())], names=batch.schema.names)


def remove_repeats(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", length: int = 100, hot_anchor: int = HOT_ANCHOR) -> DataFrame:
    """All columns of docs but the text, and __size, __removed, __spans (long) and __kept (binary, the bytes that stay)."""
    spark = docs.sparkSession
    small_batches(spark)
    n = partitions(spark)
    text = F.coalesce(F.col(f"`{text_col}`").cast("string"), F.lit(""))
    keyed = [id_key(id_col).alias("__doc"), F.expr(f"xxhash64(coalesce(cast(`{text_col}` as string), ''))").alias("__th")]
    texts = docs.select(*keyed, text.cast("binary").alias("__text"))
    share = min(1.0, 400 / max(1, docs.count()))
    few = texts.sample(share, 5).mapInArrow(giving_back(_cut(length)), _ROW)
    sample = np.sort(np.array([r[0] for r in few.where("e = 0").select("lead").limit(200_000).collect()], np.int64).view(_U))  # only balances the ranges
    n = max(n, int(len(sample) / share * 64) // BUCKET)  # buckets do not grow with the input
    splitters = sample[np.linspace(0, len(sample) - 1, n + 1).astype(int)[1:-1]] if len(sample) else sample
    rows = texts.mapInArrow(giving_back(chained(_cut(length), _with_bucket(splitters))), _ROW + ", bucket int")
    buckets = rows.repartitionById(n, "bucket").sortWithinPartitions("lead", "h", "seg", "doc", "th", "p")
    first = materialize(buckets.drop("bucket").mapInArrow(giving_back(_neighbours(length)), "doc long, th long, start long, stop long, h long, v long"), "repeats")

    open_ = first.where("h is not null or v is not null")
    hot = materialize(open_.where("h is not null").groupBy("h").count().where(F.col("count") > hot_anchor).select("h", F.lit(True).alias("hot")), "hot")
    marked = open_.withColumn("hot", F.lit(False)) if hot.isEmpty() else open_.join(hot, "h", "left")
    # as long as the text is, a list stays in proportion to its row
    lists = marked.groupBy("doc", "th").agg(F.collect_list(F.struct("start", "stop", "h", "v", F.coalesce("hot", F.lit(False)).alias("hot"))).alias("s"))
    packed = docs.select(*keyed, text.cast("binary").alias("z")).mapInArrow(giving_back(_packed), "__doc long, __th long, z binary").withColumnsRenamed({"__doc": "doc", "__th": "th"})
    cut = lists.join(packed, ["doc", "th"]).select("doc", "th", "z", "s.start", "s.stop", "s.h", "s.v", "s.hot")
    excerpts = cut.mapInArrow(giving_back(_excerpts(length)), "h long, doc long, th long, start long, bytes binary, whole boolean")
    ends = excerpts.repartition(n, F.coalesce("h", F.xxhash64("doc", "start"))).sortWithinPartitions("h", "whole", "doc", "th", "start").mapInArrow(giving_back(_compare(length)), "doc long, th long, start long, stop long")

    spans = first.where("h is null and v is null").select("doc", "th", "start", "stop").union(ends)
    spans = spans.groupBy("doc", "th").agg(F.sort_array(F.collect_list(F.struct("start", "stop"))).alias("s")).select(F.col("doc").alias("__doc"), F.col("th").alias("__th"), F.col("s.start").alias("__starts"), F.col("s.stop").alias("__stops"))
    others = [c for c in docs.columns if c != text_col]
    fields = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in docs.schema if f.name != text_col)
    fields += ", " if fields else ""
    whole = map_arrow(docs.select(*[F.col(f"`{c}`") for c in others], *keyed, text.cast("binary").alias("__z")), _packed, fields + "__doc long, __th long, __z binary")
    whole = whole.withColumn("__copy", F.row_number().over(Window.partitionBy("__doc", "__th").orderBy("__th")))
    joined = whole.join(spans, ["__doc", "__th"], "left").select(*[F.col(f"`{c}`") for c in others], "__z", "__copy", F.lit(length).alias("__length"), "__starts", "__stops")
    names = [*others, "__size", "__removed", "__spans", "__kept"]
    return map_arrow(joined, _keep(len(others), names), fields + "__size long, __removed long, __spans long, __kept binary")


def repeats_removed(docs: DataFrame, **options) -> DataFrame:
    """docs with each repeat cut from the text; bytes of characters cut in two go too. The columns and their order stay."""
    out = remove_repeats(docs, **options)
    text_col = options.get("text_col", "text")
    whole = F.expr("cast(__kept as string)")
    text = F.when((F.col("__removed") == 0) | F.is_valid_utf8(whole), whole).otherwise(F.regexp_replace(F.make_valid_utf8(whole), "\ufffd", ""))
    return out.withColumn(text_col, text).select(*[F.col(f"`{c}`") for c in docs.columns])

