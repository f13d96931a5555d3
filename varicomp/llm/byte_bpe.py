"""Byte-level BPE: encoding by segment trees over byte positions, and decoding.

A segment tree over the byte positions of a piece of text stores, at the root, the leftmost of the pairs with minimum
rank. A merge is three point updates, at the pair, at its second half and at the live neighbour before it, each
logarithmic in the piece. Trees of pieces of like size are rows of one array and advance together. A piece is encoded
once a worker while the cache holds it.

Null texts are empty and have no ids. Repeated rows and null ids are kept; other columns pass through.
"""

from __future__ import annotations

import base64
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import map_arrow, small_batches

MOST_PIECES = 600_000
KEPT_LENGTH = 24
_NONE = np.int64(1) << np.int64(62)


class Vocabulary:
    def __init__(self, path: str, pattern: str):
        with open(path, "rb") as f:
            self.ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
        self.bytes = {r: b for b, r in self.ranks.items()}
        self.findall = regex.compile(pattern).findall
        pairs = [(self.ranks[t[:k]], self.ranks[t[k:]], r) for t, r in self.ranks.items() for k in range(1, len(t)) if t[:k] in self.ranks and t[k:] in self.ranks]
        table = np.array(pairs or [(0, 0, 0)], np.int64).reshape(-1, 3)
        key = table[:, 0] << 32 | table[:, 1]
        order = np.argsort(key)
        self.pair_key, self.pair_rank = key[order], table[order, 2]
        self.byte_rank = np.array([self.ranks[bytes([b])] for b in range(256)], np.int64)
        self.known: dict[str, bytes] = {}

    def rank(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """Rank of each pair's union; _NONE if it is no token or either is missing (-1)."""
        key = a << 32 | b
        at = np.minimum(np.searchsorted(self.pair_key, key), len(self.pair_key) - 1)
        return np.where((self.pair_key[at] == key) & (a >= 0) & (b >= 0), self.pair_rank[at], _NONE)

    def merge_all(self, pieces: list[bytes]) -> list[np.ndarray]:
        """Ids of pieces of at least two bytes, by segment trees of one size."""
        n, longest = len(pieces), max(map(len, pieces))
        size = 1 << max(1, (longest - 1).bit_length())
        length = np.array([len(p) for p in pieces])
        token = np.full((n, size + 1), -1, np.int64)  # the last column stands for no neighbour
        inside = np.arange(size)[None, :] < length[:, None]
        token[:, :size][inside] = self.byte_rank[np.frombuffer(b"".join(pieces), np.uint8)]
        after = np.tile(np.minimum(np.arange(1, size + 2), size), (n, 1))
        after[:, :size][np.arange(1, size + 1)[None, :] >= length[:, None]] = size
        before = np.tile(np.r_[size, np.arange(size)], (n, 1))
        tree = np.full((n, 2 * size), _NONE, np.int64)  # rank * size + position
        pair = self.rank(token[:, :-1], np.column_stack([token[:, 1:size], np.full(n, -1)]))
        tree[:, size:] = np.where(pair < _NONE, pair * size + np.arange(size), _NONE)
        level = size
        while level > 1:
            level //= 2
            tree[:, level : 2 * level] = np.minimum(tree[:, 2 * level : 4 * level : 2], tree[:, 2 * level + 1 : 4 * level : 2])
        row = np.flatnonzero(tree[:, 1] < _NONE)
        while len(row):
            best = tree[row, 1]
            at, rank = best % size, best // size
            gone = after[row, at]
            then, prior = after[row, gone], before[row, at]
            token[row, at], token[row, gone] = rank, -1
            after[row, at], before[row, then] = then, at
            here = self.rank(rank, token[row, then])
            ahead = self.rank(token[row, prior], rank)
            for leaf, value in ((gone, _NONE), (at, np.where(here < _NONE, here * size + at, _NONE)), (prior, np.where(ahead < _NONE, ahead * size + prior, _NONE))):
                some = leaf < size
                r, node = row[some], leaf[some] + size
                tree[r, node] = value[some] if isinstance(value, np.ndarray) else value
                while len(node) and node[0] > 1:
                    node = node >> 1
                    tree[r, node] = np.minimum(tree[r, 2 * node], tree[r, 2 * node + 1])
            row = row[tree[row, 1] < _NONE]
        return [t[t >= 0] for t in token[:, :size]]

    def encode_pieces(self, pieces: list[str]) -> dict[str, bytes]:
        """Ids of each piece as little-endian unsigned 32-bit integers."""
        out, rest = {}, {}
        for p in pieces:
            b = p.encode()
            r = self.ranks.get(b)
            if r is None:
                rest.setdefault((len(b) - 1).bit_length(), []).append((p, b))
            else:
                out[p] = r.to_bytes(4, "little")
        for bits, some in rest.items():
            step = max(1, (1 << 16) >> bits)
            for lo in range(0, len(some), step):
                for (p, _), ids in zip(some[lo : lo + step], self.merge_all([b for _, b in some[lo : lo + step]]), strict=True):
                    out[p] = ids.astype("<u4").tobytes()
        return out

    def encode(self, texts: list[str]) -> list[bytes]:
        if len(self.known) > MOST_PIECES:
            self.known = {}
        known, found, late = self.known, [], []
        for k, text in enumerate(texts):
            pieces = self.findall(text)
            ids = list(map(known.get, pieces))
            if None in ids:
                late.append((k, [(i, pieces[i]) for i, x in enumerate(ids) if x is None]))
            found.append(ids)
        if late:
            new = self.encode_pieces(list({p for _, missing in late for _, p in missing}))
            for k, missing in late:
                for i, p in missing:
                    found[k][i] = new[p]
            known.update((p, ids) for p, ids in new.items() if len(p) <= KEPT_LENGTH)
        return [b"".join(ids) for ids in found]

    def decode(self, ids: bytes) -> bytes:
        return b"".join(map(self.bytes.__getitem__, np.frombuffer(ids, "<u4").tolist()))


#: A worker process serves many tasks.
_LOADED: dict[tuple[str, str], Vocabulary] = {}


def vocabulary(path: str, pattern: str) -> Vocabulary:
    if (path, pattern) not in _LOADED:
        _LOADED[path, pattern] = Vocabulary(path, pattern)
    return _LOADED[path, pattern]


def _encode(path: str, pattern: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words = vocabulary(path, pattern)
        for batch in batches:
            texts = [t or "" for t in batch.column(batch.num_columns - 1).to_pylist()]
            ids = [x for lo in range(0, len(texts), 250) for x in words.encode(texts[lo : lo + 250])]
            yield pa.RecordBatch.from_arrays([*batch.columns[:-1], pa.array(ids, pa.binary())], names=[*batch.schema.names[:-1], "__ids"])

    return run


def _decode(path: str, pattern: str, at: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words = vocabulary(path, pattern)
        for batch in batches:
            out = pa.array([words.decode(i or b"") for i in batch.column(at).to_pylist()], pa.binary())
            yield pa.RecordBatch.from_arrays([*batch.columns, out], names=[*batch.schema.names, "__decoded"])

    return run


def _fields(df: DataFrame) -> str:
    return "".join(f"`{f.name}` {f.dataType.simpleString()}, " for f in df.schema)


def with_ids(docs: DataFrame, path: str, pattern: str, text_col: str = "text") -> DataFrame:
    """docs with __ids (binary, little-endian unsigned 32-bit integers) in place of the text."""
    small_batches(docs.sparkSession)
    others = docs.select(*[F.col(f"`{c}`") for c in docs.columns if c != text_col])
    rows = docs.select(*[F.col(f"`{c}`") for c in others.columns], F.col(f"`{text_col}`").cast("string"))
    return map_arrow(rows, _encode(path, pattern), _fields(others) + "__ids binary")


def with_decoded(encoded: DataFrame, path: str, pattern: str) -> DataFrame:
    """Adds __decoded (binary), the bytes that __ids stand for."""
    return map_arrow(encoded, _decode(path, pattern, encoded.columns.index("__ids")), _fields(encoded) + "__decoded binary")
