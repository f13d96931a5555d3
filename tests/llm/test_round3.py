"""Periodic runs, the filter audit and licence notices, against brute force."""

import hashlib
import re
import zlib
from collections import Counter
from fractions import Fraction
from itertools import permutations

import duckdb
import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from varicomp.llm import licenses, queries, runs
from varicomp.llm.filter_audit import audit

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def sha(t):
    return hashlib.sha256(t.encode()).hexdigest()


# --- 11


def brute_runs(w, shortest=24, times=3):
    found = {}
    for p in range(1, len(w) // times + 1):
        i = 0
        while i + p < len(w):
            if w[i] != w[i + p]:
                i += 1
                continue
            k = i
            while k + p < len(w) and w[k] == w[k + p]:
                k += 1
            if k + p - i >= max(shortest, times * p):
                found.setdefault((i, k + p), p)
            i = k
    return sorted((s, e - s, p) for (s, e), p in found.items())


def brute_op11(doc_id, text):
    w = WORD.findall(text or "")
    n, h = len(w), None if doc_id is None else zlib.crc32(str(doc_id).encode())
    if n and h is not None and h % 10 == 0:
        g = h // 10
        a = g % n
        p = 1 + (n - a) // (3 + g % 8)
        w = [w[i] if i < a else w[a + (i - a) % p] for i in range(n)]
    found = brute_runs(w)
    drop = {i for s, m, q in found for i in range(s + q, s + m)}
    best = min(found, key=lambda r: (-Fraction(r[1], r[2]), r[0], r[2])) if found else (None,) * 3
    return (doc_id, len(found), *best, found and 1000 * best[1] // best[2] or None, sha("".join(f"{s},{m},{q}\n" for s, m, q in found)), sha(" ".join(x for i, x in enumerate(w) if i not in drop)))


def run_texts():
    line = "one two three four five six seven eight nine"
    out = [None, "", "  \n", "a", "word " * 300, "x" * 5000, "x y " * 11 + "x y", "x y " * 12, " ".join([line] * 3), " ".join([line] * 2 + ["one"]), "\x0b".join(["é 漢 z"] * 30)]
    out += ["a b c " * 9 + "q " + "a b c " * 9, ("a " * 30 + "b ") * 4, "a a b " * 20 + "a b " * 20, " ".join(["p"] * 23), " ".join(["p"] * 24)]
    fib = ["a", "a b"]
    while len(fib[-1]) < 900:
        fib.append(f"{fib[-1]} {fib[-2]}")
    rng = np.random.default_rng(5)
    out += [fib[-1], *[" ".join(map(str, rng.integers(0, k, n))) for k, n in ((2, 400), (1, 50), (3, 900), (50, 300))]]
    period = [str(x) for x in rng.integers(0, 4, 150)]
    return [*out, " ".join(period * 4), " ".join(period * 3 + ["end"]), " ".join(["k"] * 200 + ["m"] + ["k"] * 200 + ["m"] + ["k"] * 200)]


@settings(max_examples=150, deadline=None)
@given(st.lists(st.lists(st.integers(0, 2), max_size=90), max_size=4), st.integers(1, 4), st.integers(3, 24))
def test_runs_of_random_words(texts, again, shortest):
    texts = [t * again for t in texts]
    finder = runs.RunFinder(np.array([x for t in texts for x in t], np.int64), np.r_[0, np.cumsum([len(t) for t in texts])].astype(np.int64), shortest)
    want = [(k, *r) for k, t in enumerate(texts) for r in brute_runs(t, shortest)]
    assert list(map(tuple, finder.table().tolist())) == want


def test_runs_in_small_portions(monkeypatch):
    rng = np.random.default_rng(2)
    texts = [np.tile(rng.integers(0, 3, rng.integers(1, 40)), 6) for _ in range(60)]
    edge = np.r_[0, np.cumsum([len(t) for t in texts])]
    want = runs.RunFinder(np.concatenate(texts), edge).table()
    monkeypatch.setattr(runs, "PROBES", 7)
    monkeypatch.setattr(runs, "CHUNK", (1, 2))
    assert np.array_equal(runs.RunFinder(np.concatenate(texts), edge).table(), want) and len(want) > 50


def test_long_repeats_stay_linear():
    """A million equal words: one run, whose grid points no later period extends again."""
    finder = runs.RunFinder(np.zeros(1_000_000, np.int64), np.array([0, 1_000_000]))
    assert finder.table().tolist() == [[0, 0, 1_000_000, 1]]


def written(spark, path, name, rows, schema):
    spark.createDataFrame(rows, schema).repartition(3).write.parquet(f"{path}/{name}.parquet")


def test_registered_runs(spark, tmp_path):
    rows = [(k, t, "clash", 1) for k, t in enumerate(run_texts() * 12)]
    rows += [(None, "a " * 40, None, 2), (None, "a " * 40, None, 2), (5, "b " * 50, None, 3), (5, "b " * 50, None, 3)]
    written(spark, tmp_path, "documents", rows, "doc_id long, text string, runs string, `a.b` int")
    got = [tuple(r) for r in queries.op11_periodic_runs(spark, str(tmp_path)).select("doc_id", "n_runs", "start", "length", "period", "exponent_milli", "runs_sha256", "collapsed_sha256").collect()]
    want = [brute_op11(r[0], r[1]) for r in rows]
    assert Counter(got) == Counter(want) and sum(zlib.crc32(str(r[0]).encode()) % 10 == 0 for r in rows) > 10


def test_runs_of_nothing(spark):
    assert runs.periodic_runs(spark.createDataFrame([], "doc_id long, text string")).collect() == []
    r = runs.periodic_runs(spark.createDataFrame([(1, "a b " * 13 + "c")], "doc_id long, text string")).first()
    assert [tuple(x) for x in r.runs] == [(0, 26, 2)] and r.collapsed == "a b c" and r.best.period == 2 and r.n_words == 27
    with pytest.raises(ValueError):
        runs.periodic_runs(spark.createDataFrame([], "doc_id long, text string"), times=2)


# --- 12


def brute_audit(docs, labels):
    low = {}
    for d, t, _ in docs:
        if d is not None:
            low[t or ""] = min(d, low.get(t or "", d))
    good, toxic = ({d for d, *v in labels if v[k] == 1} for k in (0, 1))
    flags = {}
    for d, t, part in docs:
        t = t or ""
        w = WORD.findall(t)
        f = {x for x, bad in zip("ABCDE", (len(w) < 50, 100 * len(set(w)) < 65 * len(w), 100 * sum("A" <= c <= "Z" for c in t) > 5 * len(t), bool(set(t) & set("#$%&*|")), d is not None and low[t] < d), strict=True) if bad}
        flags.setdefault(part or "", []).append((f, d in good, d in toxic))
    out = []
    for part, rows in flags.items():
        shapley, steps = Counter(), []
        for order in permutations("ABCDE"):
            for k, x in enumerate(order):
                before = set(order[:k])
                gone = [r for r in rows if x in r[0] and not r[0] & before]
                shapley[x] += len(gone)
                steps.append((part, "".join(order), k + 1, sum(not r[0] & {*before, x} for r in rows), len(gone), sum(x in r[0] and bool(r[0] & before) for r in rows), sum(r[0] == {x} for r in rows), sum(r[1] for r in gone), sum(r[2] for r in gone), x))
        out += [(*s[:-1], shapley[s[-1]]) for s in steps]
    return sorted(out)


COLUMNS = ["part", "filter_order", "step", "kept", "removed", "redundant", "unique_fails", "good_lost", "toxic_lost", "shapley"]


def audit_rows():
    rng = np.random.default_rng(3)
    prose = " ".join(f"w{k}" for k in range(80))
    texts = [None, "", prose, prose + " #", prose.upper(), "w " * 90, "short", "Short É x", "W" * 30 + " $", prose + "\t|" + "A " * 10, "\v" + prose, prose + "\n"]
    docs = [(int(k), texts[rng.integers(len(texts))], ["a", "b", None, "", "é"][rng.integers(5)]) for k in rng.permutation(200)]
    docs += [(None, prose, "a"), (None, prose, "a"), (7, prose, "b"), (7, prose, "b"), (900, None, "only"), (901, "", "only")]
    labels = [(k, int(rng.integers(2)), int(rng.integers(2))) for k in range(0, 200, 2)] + [(2, None, 1), (2, 1, None), (None, 1, 1), (900, 1, 1), (5000, 1, 1)]
    return docs, labels


def test_audit(spark, tmp_path):
    docs, labels = audit_rows()
    written(spark, tmp_path, "documents", [(*d, "x", 1) for d in docs], "doc_id long, text string, source string, part string, `digest.x` int")
    written(spark, tmp_path, "labels", labels, "doc_id long, quality int, toxic int")
    got = sorted(map(tuple, queries.op12_filter_audit(spark, str(tmp_path)).select(*COLUMNS).collect()))
    assert got == brute_audit(docs, labels)
    con = duckdb.connect()
    for name in ("documents", "labels"):
        con.execute(f"CREATE VIEW {name} AS SELECT * FROM '{tmp_path}/{name}.parquet/*.parquet'")
    cursor = con.execute(queries.ORACLE["op12_filter_audit"])
    names = [c[0] for c in cursor.description]
    assert sorted(tuple(r[names.index(c)] for c in COLUMNS) for r in cursor.fetchall()) == got


def test_audit_of_nothing(spark):
    docs, labels = spark.createDataFrame([], "doc_id long, text string, source string"), spark.createDataFrame([], "doc_id long, quality int, toxic int")
    assert audit(docs, labels).collect() == []
    one = audit(spark.createDataFrame([(None, None, None)], docs.schema), labels)
    assert one.count() == 600 and one.where("kept > 0").count() == 240  # an empty text fails only A, which has 0 to 4 filters before it


# --- 13


def words_of(text):
    return re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))


def brute_base(text):
    w, hits = words_of(text), []
    for label, phrase in (("cc-by", "cc by"), ("gpl", "general public license"), ("reserved", "all rights reserved")):
        p = phrase.split()
        hits += [(i, label) for i in range(len(w)) if w[i : i + len(p)] == p]
    at = [i for i, _ in hits]
    return len(w), len(hits), min(at, default=None), max(at, default=None), ",".join(sorted({x for _, x in hits}))


def license_texts():
    notices = ["Released under the MIT License.", "Licensed under CC BY-NC 4.0", "All rights reserved. ALL RIGHTS  reserved", "This work is licensed under the GNU General Public License, version 3.", "general public\nlicense general public_license", "cc  by cc by by cc", "all rights", "ccby cc.by écc by", "Licensed under the Apache License, Version 2.0."]
    rng = np.random.default_rng(4)
    vocabulary = ["cc", "by", "general", "public", "license", "all", "rights", "reserved", "Licensed", "é", "x1"]
    mixed = [" ".join(rng.choice(vocabulary, n)) for n in (5, 60, 400, 3000)]
    return [None, "", " ", "漢字 🙂", "\x00\x7f", *notices, *mixed, "license " * 5000, "no notice at all " * 40 + notices[3], " ".join(notices)]


def test_registered_licences(spark, tmp_path):
    rows = [(k, t, "clash", 1) for k, t in enumerate(license_texts())] + [(None, "cc by", None, 2), (3, "cc by", None, 2), (3, "cc by", None, 2)]
    written(spark, tmp_path, "documents", rows, "doc_id long, text string, labels string, `a.b` int")
    found = queries.op13_license_scan(spark, str(tmp_path)).collect()
    assert Counter((r.doc_id, r.n_words, r.n_base, r.first_word, r.last_word, r.base_labels) for r in found) == Counter((r[0], *brute_base(r[1])) for r in rows)
    for r in found:
        base, every = (set(filter(None, c.split(","))) for c in (r.base_labels, r.labels))
        assert base <= every and r.labels == ",".join(sorted(every)) and 0 <= r.score <= 1 and (r.score > 0) == bool(every)
    labels = {r.doc_id: r.labels for r in found if r.doc_id and r.doc_id < 14}
    assert labels[5] == "mit" and labels[6] == "cc-by,cc-by-nc" and labels[8] == "gpl,gpl-3.0" and labels[13] == "apache-2.0"


def test_licences_with_edits(spark):
    mit = dict((t[0], t[1]) for t in licenses.TEMPLATES)["mit"]
    w = mit.split()
    filler = ["lorem"] * 300
    cases = {
        1: mit,
        2: " ".join([*filler, *w[:12], "extra", *w[12:], *filler]),  # a word more, within the drift
        3: mit.replace("person", "human"),  # a word that's no mandatory one
        4: mit.replace("restriction", "limits"),  # breaks a mandatory phrase
        5: " ".join([*w[:8], *filler, *w[8:]]),  # phrases that stand far apart
        6: " ".join(sorted(w)),
        7: "THE TERMS OF THE MOZILLA PUBLIC LICENSE, v. 2.0; this Source Code Form is subject to",
    }
    found = {r.id: r for r in licenses.license_notices(spark.createDataFrame(list(cases.items()), "doc_id long, text string")).collect()}
    assert [found[k].labels for k in range(1, 7)] == ["mit", "mit", "mit", "", "", ""]
    assert found[1].score == 1 and 0.9 < found[3].score < 1 and found[4].score == 0
    assert licenses.license_notices(spark.createDataFrame([], "doc_id long, text string")).collect() == []
