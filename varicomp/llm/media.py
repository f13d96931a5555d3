"""Interleaved document sequences with media columns.

HTML is parsed to an ordered array of items: text, or a reference to a medium with its caption (the figcaption of its
figure, or else its alt text). Payloads live in a store that holds each content once, as a lossless 8-bit greyscale PNG
of 64 samples a row, under the SHA-256 of the payload; references are resolved by a join on the digest, and each item
keeps its position. What is computed from a payload is computed once for each stored medium.

Null HTML has no items. References without a payload resolve to nulls. Repeated rows and null ids are kept.
"""

from __future__ import annotations

import hashlib
import struct
import zlib
from collections.abc import Iterator
from html.parser import HTMLParser

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import bitmap, chained, map_arrow, materialize, small_batches, where_marked

WIDTH = 64
LEVEL = 6  # the store is written to disk
_SIGNATURE = b"\x89PNG\r\n\x1a\n"
_SILENT = ("script", "style", "title", "noscript", "template")
_OF_HEAD = ("html", "head", "base", "link", "meta", *_SILENT)
_MEDIA = ("img", "video", "audio", "source", "embed")
ITEMS = "array<struct<position:int,kind:string,text:string,ref:string,caption:string>>"


class _Items(HTMLParser):
    """The head ends at its end tag or, as HTML allows, where something begins that can't be in one. Figures may be nested; a
    caption belongs to the media of its figure, before and after it, that no inner figure captions."""

    def __init__(self):
        super().__init__(convert_charrefs=True)
        self.items: list[list] = []
        self.silent, self.head = 0, False
        self.figures: list[list] = []  # first item, words of the caption or None, whether it's open

    def handle_starttag(self, tag, attrs):
        if tag == "head":
            self.head = True
        elif tag not in _OF_HEAD:
            self.head = False
        if tag in _SILENT:
            self.silent += 1
        elif tag == "figure":
            self.figures.append([len(self.items), None, False])
        elif tag == "figcaption" and self.figures:
            self.figures[-1][1:] = [self.figures[-1][1] or [], True]
        elif tag in _MEDIA:
            a = dict(attrs)
            if a.get("src"):
                self.items.append(["media", None, a["src"], a.get("alt"), False])

    def handle_startendtag(self, tag, attrs):
        if tag in _MEDIA:
            self.handle_starttag(tag, attrs)

    def handle_endtag(self, tag):
        if tag == "head":
            self.head = False
        elif tag in _SILENT:
            self.silent = max(0, self.silent - 1)
        elif tag == "figcaption" and self.figures:
            self.figures[-1][2] = False
        elif tag == "figure" and self.figures:
            first, words, _ = self.figures.pop()
            for item in self.items[first:] if words is not None else ():
                if item[0] == "media" and not item[4]:
                    item[3:] = [" ".join("".join(words).split()), True]

    def handle_data(self, data):
        if self.silent or (self.head and not data.strip()):
            return
        self.head = False
        if self.figures and self.figures[-1][2]:
            self.figures[-1][1].append(data)
        elif data.strip():
            if self.items and self.items[-1][0] == "text":
                self.items[-1][1] += data
            else:
                self.items.append(["text", data, None, None, False])

    def close(self):
        super().close()
        while self.figures:
            self.handle_endtag("figure")


def parse(html: str | None) -> list[tuple]:
    """(position, kind, text, ref, caption) in the order of the page."""
    p = _Items()
    p.feed(html or "")
    p.close()
    return [(k, *item[:4]) for k, item in enumerate(p.items)]


def _parse(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    kind = pa.list_(pa.struct([("position", pa.int32()), ("kind", pa.string()), ("text", pa.string()), ("ref", pa.string()), ("caption", pa.string())]))
    names = ("position", "kind", "text", "ref", "caption")
    for batch in batches:
        items = [[dict(zip(names, i, strict=True)) for i in parse(h)] for h in batch.column(batch.num_columns - 1).to_pylist()]
        yield pa.RecordBatch.from_arrays([*batch.columns[:-1], pa.array(items, kind)], names=[*batch.schema.names[:-1], "items"])


def interleaved(pages: DataFrame, html_col: str = "html") -> DataFrame:
    """pages with items in place of the HTML."""
    small_batches(pages.sparkSession)
    others = [F.col(f"`{c}`") for c in pages.columns if c != html_col]
    rows = pages.select(*others, F.col(f"`{html_col}`").cast("string"))
    fields = "".join(f"`{f.name}` {f.dataType.simpleString()}, " for f in pages.schema if f.name != html_col)
    return map_arrow(rows, _parse, fields + f"items {ITEMS}")


def to_png(payload: bytes) -> bytes:
    """payload: a positive multiple of WIDTH bytes."""
    rows = np.zeros((len(payload) // WIDTH, WIDTH + 1), np.uint8)  # a filter byte, none, before each row
    rows[:, 1:] = np.frombuffer(payload, np.uint8).reshape(-1, WIDTH)
    chunk = lambda name, data: struct.pack(">I", len(data)) + name + data + struct.pack(">I", zlib.crc32(name + data))
    size = struct.pack(">IIBBBBB", WIDTH, len(rows), 8, 0, 0, 0, 0)
    return _SIGNATURE + chunk(b"IHDR", size) + chunk(b"IDAT", zlib.compress(rows.tobytes(), LEVEL)) + chunk(b"IEND", b"")


def from_png(png: bytes) -> bytes:
    """The samples of what to_png writes."""
    if png[:8] != _SIGNATURE:
        raise ValueError("not a PNG")
    at, data, width = 8, [], 0
    while at < len(png):
        (n,) = struct.unpack_from(">I", png, at)
        name, body = png[at + 4 : at + 8], png[at + 8 : at + 8 + n]
        if zlib.crc32(name + body) != struct.unpack_from(">I", png, at + 8 + n)[0]:
            raise ValueError("damaged PNG")
        if name == b"IHDR":
            width = struct.unpack_from(">I", body)[0]
        elif name == b"IDAT":
            data.append(body)
        at += 12 + n
    rows = np.frombuffer(zlib.decompress(b"".join(data)), np.uint8).reshape(-1, width + 1)
    if rows[:, 0].any():
        raise ValueError("a filtered PNG")
    return rows[:, 1:].tobytes()


def feature(payload: bytes) -> str:
    """Mean in thousandths, and the shares of eight equal bins of samples, in thousandths."""
    x = np.frombuffer(payload, np.uint8)
    bins = np.bincount(x >> 5, minlength=8)
    return f"mean={int(x.sum(dtype=np.int64)) * 1000 // len(x)};bins=" + ",".join(str(int(b) * 1000 // len(x)) for b in bins)


def _store(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        first: dict[str, bytes] = {}
        for digest, payload in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
            if digest not in first:
                first[digest] = to_png(payload.as_py())
        yield pa.RecordBatch.from_arrays([pa.array(first.keys(), pa.string()), pa.array(first.values(), pa.binary())], names=["digest", "media"])


def media_store(payloads: DataFrame) -> DataFrame:
    """From (digest, payload): writes (digest, media), a row for each content, to the shared folder and opens it.

    Digests are counted first. Media of those that occur once, as most do, are written where they are coded; only the others, and
    the few that the bitmap takes for them, are shuffled.
    """
    small_batches(payloads.sparkSession)
    keyed = payloads.select("digest", "payload", F.xxhash64("digest").alias("key"))
    again = bitmap(keyed.groupBy("key").count().where("count > 1").select("key"))
    once, several = (keyed.mapInArrow(chained(where_marked(again, "key", marked), _store), "digest string, media binary") for marked in (False, True))
    return materialize(once.union(several.groupBy("digest").agg(F.first("media").alias("media"))), "media")


_FEATURES = "digest string, payload_bytes long, payload_sha256 string, tail_crc32 long, media_bytes long, media_sha256 string, feature string"


def _features(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        rows = []
        for digest, media in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
            media = media.as_py()
            p = from_png(media)
            rows.append((digest, len(p), hashlib.sha256(p).hexdigest(), zlib.crc32(p[-64:]), len(media), hashlib.sha256(media).hexdigest(), feature(p)))
        if rows:
            yield pa.RecordBatch.from_arrays([pa.array(c) for c in zip(*rows, strict=True)], names=[f.split()[0] for f in _FEATURES.split(", ")])


def media_features(store: DataFrame) -> DataFrame:
    """What the stored bytes, read back, show: a row for each medium."""
    return store.mapInArrow(_features, _FEATURES)


def resolved(sequences: DataFrame, contents: DataFrame, scheme: str = "sha256:") -> DataFrame:
    """A row for each item of sequences (with items), and the columns of contents (digest first) that its reference names.

    Only references are shuffled, as 32 bytes if they are digests; text items are appended with nulls.
    """
    flat = sequences.select(*[F.col(f"`{c}`") for c in sequences.columns if c != "items"], F.explode("items").alias("item")).select("*", "item.*").drop("item")
    key = F.when(F.col("ref").rlike(f"^{scheme}[0-9a-f]{{64}}$"), F.unhex(F.substring("ref", len(scheme) + 1, 64)))
    media = flat.where("kind = 'media'").withColumn("__key", key).withColumn("ref", F.when(F.col("__key").isNull(), F.col("ref")))
    texts = flat.where("kind != 'media'")
    met = media.join(contents.withColumn("__key", F.unhex("digest")).drop("digest"), "__key", "left").withColumn("digest", F.lower(F.hex("__key"))).drop("__key")
    return met.withColumn("ref", F.coalesce("ref", F.concat(F.lit(scheme), "digest"))).unionByName(texts, allowMissingColumns=True)


def padded(text: Column) -> Column:
    """UTF-8 bytes, then zero bytes up to a positive multiple of WIDTH."""
    data = F.coalesce(text.cast("binary"), F.lit(b""))
    size = F.greatest(F.lit(1), F.ceil(F.octet_length(data) / WIDTH)).cast("int") * WIDTH
    return F.rpad(data, size, F.lit(b"\0"))


def as_page(text: Column, digest: Column, caption: Column) -> Column:
    """A page that shows a text and, after its first paragraph, a medium with a caption."""
    safe = F.coalesce(text, F.lit(""))
    for a, b in (("&", "&amp;"), ("<", "&lt;"), (">", "&gt;")):
        safe = F.replace(safe, F.lit(a), F.lit(b))
    first = F.split_part(safe, F.lit("\n\n"), F.lit(1))
    figure = F.concat(F.lit('</p><figure><img src="sha256:'), digest, F.lit('"><figcaption>'), caption, F.lit("</figcaption></figure><p>"))
    return F.concat(F.lit("<article><p>"), first, figure, F.substr(safe, F.length(first) + 1), F.lit("</p></article>"))
