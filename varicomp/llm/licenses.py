"""Licence notices by a positional index of rare words.

Each template is a sequence of words, with phrases of it that are mandatory. The index has, for each licence word, the
templates and positions that hold it. How rare a word is comes from all texts: its inverse document frequency. A file
looks up, for each template, the words with the highest frequency of this kind among those it holds; a posting at position j
and a word of the file at i say that the template begins at i - j. Postings are intersected by this relative position: what
enough of the words agree on, within a few words of drift, is a candidate. Its mandatory phrases must then stand there, word by word.

A phrase that is a template by itself is looked up by its rarest word and allows no drift, so that every place of it is found,
whatever the frequencies are. The score is the share of a template's words that stand where they should, of the best match.

A row is returned for each row of the input. Null texts count as empty; a text without matches has no labels, null places and
score 0. Words and letters: A-Z is lowered, a word is made of digits, a-z and everything beyond ASCII. Other columns are not
read.
"""

from __future__ import annotations

from collections.abc import Iterator
from math import log

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import small_batches, utf8_views
from .words import ALNUM, LOWER, Words, slices

# fixed values: labels, phrases, and excerpts of well-known licences and notices
PHRASES = [
    ("cc-by", "cc by"),
    ("gpl", "general public license"),
    ("reserved", "all rights reserved"),
]
#: Label, words, mandatory phrases.
TEMPLATES = [
    ("mit", "released under the mit license", ["mit license"]),
    ("mit", "permission is hereby granted free of charge to any person obtaining a copy of this software and associated documentation files the software to deal in the software without restriction", ["permission is hereby granted free of charge", "deal in the software without restriction"]),
    ("apache-2.0", "licensed under the apache license version 2 0", ["apache license version 2 0"]),
    ("apache-2.0", "licensed under the apache license version 2 0 the license you may not use this file except in compliance with the license", ["apache license", "except in compliance with the license"]),
    ("bsd", "redistribution and use in source and binary forms with or without modification are permitted provided that the following conditions are met", ["source and binary forms", "following conditions are met"]),
    ("isc", "permission to use copy modify and or distribute this software for any purpose with or without fee is hereby granted", ["for any purpose with or without fee is hereby granted"]),
    ("mpl-2.0", "this source code form is subject to the terms of the mozilla public license v 2 0", ["mozilla public license"]),
    ("lgpl", "licensed under the gnu lesser general public license", ["lesser general public license"]),
    ("agpl", "licensed under the gnu affero general public license", ["affero general public license"]),
    ("gpl-3.0", "this work is licensed under the gnu general public license version 3", ["gnu general public license version 3"]),
    ("gpl-2.0", "this work is licensed under the gnu general public license version 2", ["gnu general public license version 2"]),
    ("cc-by-nc", "licensed under cc by nc 4 0", ["cc by nc"]),
    ("cc-by-sa", "licensed under cc by sa 4 0", ["cc by sa"]),
    ("cc-by-nd", "licensed under cc by nd 4 0", ["cc by nd"]),
    ("cc-by-4.0", "this work is licensed under a creative commons attribution 4 0 international license", ["creative commons attribution 4 0"]),
    ("cc0", "to the extent possible under law the author has waived all copyright and related or neighboring rights to this work", ["waived all copyright and related or neighboring rights"]),
    ("unlicense", "this is free and unencumbered software released into the public domain", ["free and unencumbered software", "public domain"]),
]
#: Words that a file looks up for a template, and the drift in words that a match may have.
RARE, DRIFT = 4, 3


class Index:
    """Postings of the templates' words. idf: from word to its inverse document frequency."""

    def __init__(self, phrases, templates, idf: dict[str, float] | None = None):
        self.templates = [(label, text.split(), [text.split()], 1, 0, True) for label, text in phrases]
        self.templates += [(label, text.split(), [m.split() for m in must], RARE, DRIFT, False) for label, text, must in templates]
        self.words = sorted({w for t in self.templates for w in (*t[1], *(x for m in t[2] for x in m))})
        self.number = {w: k for k, w in enumerate(self.words)}
        self.vocabulary = pa.array([w.encode() for w in self.words], pa.large_binary())
        idf = idf or {}
        rare = lambda w: (-idf.get(w, 0.0), w)
        self.by_rarity = [np.array([self.number[w] for w in sorted(set(t[1]), key=rare)]) for t in self.templates]
        self.sequence = [np.array([self.number[w] for w in t[1]]) for t in self.templates]
        self.must = [[np.array([self.number[w] for w in m]) for m in t[2]] for t in self.templates]

    def number_words(self, words: Words) -> np.ndarray:
        """The number of each word; -1 for those that no template has."""
        if not len(words):
            return np.zeros(0, np.int64)
        coded = words.array().dictionary_encode()
        place = pc.fill_null(pc.index_in(coded.dictionary, self.vocabulary), -1).to_numpy().astype(np.int64)
        return place[coded.indices.to_numpy()]

    def matches(self, number: np.ndarray, edge: np.ndarray) -> Iterator[tuple[int, np.ndarray, np.ndarray, np.ndarray]]:
        """Of each template: (template, text, place of its first word, score) of what is verified."""
        text_of = np.repeat(np.arange(len(edge) - 1), np.diff(edge))
        at = np.flatnonzero(number >= 0)
        word, text = number[at], text_of[at]
        held = np.zeros((len(edge) - 1, len(self.words)), bool)
        held[text, word] = True
        for t, (_, _, _, rare, drift, _) in enumerate(self.templates):
            able = held[:, np.unique(np.concatenate(self.must[t]))].all(axis=1)  # no mandatory word may be missing
            if not able.any():
                continue
            looked = held[:, self.by_rarity[t]]
            looked &= looked.cumsum(axis=1) <= rare
            chosen = np.zeros_like(held)
            chosen[:, self.by_rarity[t]] = looked
            hit = np.flatnonzero(able[text] & chosen[text, word])
            where, length = self._postings(t, word[hit])
            hit = np.repeat(hit, length)
            begin, of, votes = at[hit] - where, text[hit], word[hit]
            enough = np.minimum(2 if rare > 1 else 1, looked.sum(axis=1))
            yield t, *self._verified(t, number, edge, *_intersected(of, begin, votes, enough, drift), drift)

    def _postings(self, t: int, word: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Positions in template t of each of these words, one after another, and how many each has."""
        order = np.argsort(self.sequence[t], kind="stable")
        lo, hi = (np.searchsorted(self.sequence[t][order], word, s) for s in ("left", "right"))
        size = hi - lo
        return order[np.repeat(lo - np.cumsum(size) + size, size) + np.arange(size.sum())], size

    def _verified(self, t: int, number: np.ndarray, edge: np.ndarray, text: np.ndarray, begin: np.ndarray, drift: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        n = len(self.sequence[t])
        lo, hi = np.maximum(begin - drift, edge[text]), np.minimum(begin + n + drift, edge[text + 1])
        good = np.ones(len(text), bool)
        for phrase in self.must[t]:
            found = np.zeros(len(text), bool)
            for k in range(n + 2 * drift - len(phrase) + 1):
                a = begin - drift + k
                inside = (a >= lo) & (a + len(phrase) <= hi)
                stands = inside.copy()
                for j, w in enumerate(phrase.tolist()):
                    stands &= number[np.where(inside, a + j, 0)] == w
                found |= stands
            good &= found
        text, begin, lo, hi = text[good], begin[good], lo[good], hi[good]
        share = np.zeros(len(text))
        for i, w in enumerate(self.sequence[t].tolist()):
            near = np.zeros(len(text), bool)
            for d in range(-drift, drift + 1):
                a = begin + i + d
                inside = (a >= lo) & (a < hi)
                near |= inside & (number[np.where(inside, a, 0)] == w)
            share += near
        return text, begin, share / n


def _intersected(text: np.ndarray, begin: np.ndarray, word: np.ndarray, enough: np.ndarray, drift: int) -> tuple[np.ndarray, np.ndarray]:
    """(text, begin) on which enough different words of the text agree within the drift."""
    order = np.lexsort((word, begin, text))
    text, begin, word = text[order], begin[order], word[order]
    key = text * (2**40) + begin + 2**20  # in ascending order; places of one text are far from those of the next
    far = np.searchsorted(key, key + drift, "right")
    agreed = np.ones(len(key), np.int64)
    most = int((far - np.arange(len(key))).max(initial=1))
    seen = {0: word}
    for d in range(1, most):
        other = np.r_[word[d:], np.full(d, -1)] if d < len(word) else np.full(len(word), -1)
        new = np.arange(len(key)) + d < far
        for prior in seen.values():
            new &= other != prior
        agreed += new
        seen[d] = other
    first = agreed >= enough[text]
    found = np.unique(np.column_stack([text[first], begin[first]]), axis=0) if first.any() else np.zeros((0, 2), np.int64)
    return found[:, 0], found[:, 1]


def _document_frequencies(index: Index):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(len(index.words), np.int64)
        for batch in batches:
            data, offsets = utf8_views(batch.column(0))
            for lo, hi in slices(offsets):
                words = Words(LOWER[data[offsets[lo] : offsets[hi]]], offsets[lo : hi + 1] - offsets[lo], ALNUM)
                number = index.number_words(words)
                text = np.repeat(np.arange(hi - lo), np.diff(words.edge))[number >= 0]
                pairs = np.unique(text * len(index.words) + number[number >= 0])
                total += np.bincount(pairs % len(index.words), minlength=len(index.words))
        yield pa.RecordBatch.from_arrays([pa.array(index.words), pa.array(total)], names=["word", "n"])

    return run


def inverse_frequencies(docs: DataFrame, index: Index, text_col: str = "text") -> dict[str, float]:
    """Of each licence word, from all texts. As many numbers as the templates have words go to the driver."""
    small_batches(docs.sparkSession)
    counts = docs.select(F.col(f"`{text_col}`").cast("string").alias("text")).mapInArrow(_document_frequencies(index), "word string, n long").groupBy("word").agg(F.sum("n").alias("n")).collect()
    n = docs.count()
    return {r.word: log((1 + n) / (1 + r.n)) for r in counts}


def _scan(index: Index):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            data, offsets = utf8_views(batch.column(1))
            for lo, hi in slices(offsets):
                words = Words(LOWER[data[offsets[lo] : offsets[hi]]], offsets[lo : hi + 1] - offsets[lo], ALNUM)
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(lo, hi - lo), pa.array(np.diff(words.edge)), *_found(index, index.number_words(words), words.edge)], names=["id", "n_words", "n_base", "first_word", "last_word", "base_labels", "labels", "score"])

    return run


def _found(index: Index, number: np.ndarray, edge: np.ndarray) -> list[pa.Array]:
    n = len(edge) - 1
    places, score = np.zeros(n, np.int64), np.zeros(n)
    low, high = np.full(n, np.iinfo(np.int64).max), np.full(n, -1)
    labels: list[dict[int, set[str]]] = [{}, {}]  # of phrases only, and of all templates
    for t, text, begin, share in index.matches(number, edge):
        label, phrase = index.templates[t][0], index.templates[t][5]
        np.maximum.at(score, text, share)
        for k in np.unique(text).tolist():
            labels[1].setdefault(k, set()).add(label)
            if phrase:
                labels[0].setdefault(k, set()).add(label)
        if phrase:
            places += np.bincount(text, minlength=n)
            np.minimum.at(low, text, begin - edge[text])
            np.maximum.at(high, text, begin - edge[text])
    none = places == 0
    joined = [pa.array([",".join(sorted(found.get(k, ()))) for k in range(n)], pa.string()) for found in labels]
    return [pa.array(places), pa.array(low, mask=none), pa.array(high, mask=none), *joined, pa.array(score)]


def license_notices(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", phrases=PHRASES, templates=TEMPLATES) -> DataFrame:
    """(id, n_words, n_base, first_word, last_word, base_labels, labels, score): how many places of phrases, the smallest and
    greatest of them, and the labels of the phrases and of all templates."""
    small_batches(docs.sparkSession)
    idf = inverse_frequencies(docs, Index(phrases, templates), text_col)
    rows = docs.select(F.col(f"`{id_col}`").cast("long").alias("id"), F.col(f"`{text_col}`").cast("string").alias("text"))
    return rows.mapInArrow(_scan(Index(phrases, templates, idf)), "id long, n_words long, n_base long, first_word long, last_word long, base_labels string, labels string, score double")
