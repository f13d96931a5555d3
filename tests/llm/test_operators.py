"""Each operator against a brute-force version, on documents with every odd case."""

import hashlib
import random
import re
import zlib
from collections import Counter, defaultdict
from itertools import product

import numpy as np
import public_tokenizers
import pyarrow as pa
import pytest
import tiktoken
import xxhash
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F
from tokenizers import Tokenizer

import corpus_pipeline
from varicomp.llm import byte_bpe, language, media, packing, pii, queries, simhash, similar, suffix_dedup, topk, toxicity, warc

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, fingerprint string, length long, z binary, count int, `a.b` string"


def texts():
    rng = random.Random(4)
    words = ["".join(rng.choice("abcdeé") for _ in range(rng.randint(1, 7))) for _ in range(80)]
    prose = lambda n: " ".join(rng.choice(words) for _ in range(n))
    passage, base = prose(60), prose(300)
    out = [None, "", " ", "a", "\n\t x", base, base, base + " tail", base[:900] + " Q " + base[900:], "word " * 300, "漢字かな 🙂 " * 20, "x" * 700, prose(3000)]
    return out + [prose(rng.randint(1, 40)) + " " + passage + " " + prose(rng.randint(1, 40)) for _ in range(8)] + [prose(rng.randint(0, 120)) for _ in range(20)]


def rows():
    out = [(k, t, "en" if k % 2 else "fr", None, None, "clash", 7, b"z", k, "dot") for k, t in enumerate(texts())]
    return [*out, (None, "no id at all", None, None, None, None, None, None, None, None)]


@pytest.fixture(scope="module")
def docs(spark):
    return spark.createDataFrame(rows(), SCHEMA).repartition(3)


def brute_repeats(items, length=100):
    seen, out = set(), {}
    for d, t in sorted(items, key=lambda r: (r[0] is not None, r[0] or 0)):
        b = (t or "").encode()
        gone = bytearray(len(b))
        for s in range(len(b) - length + 1):
            if b[s : s + length] in seen:
                gone[s : s + length] = b"\1" * length
            seen.add(b[s : s + length])
        kept = bytes(x for x, g in zip(b, gone, strict=True) if not g)
        out[d] = (len(b), sum(gone), sum(g and (not i or not gone[i - 1]) for i, g in enumerate(gone)), kept)
    return out


@pytest.mark.parametrize("hot", [50_000, 2])
def test_repeats(docs, hot):
    want = brute_repeats([r[:2] for r in rows()])
    got = {r.doc_id: (r["__size"], r["__removed"], r["__spans"], bytes(r["__kept"])) for r in suffix_dedup.remove_repeats(docs, hot_anchor=hot).collect()}
    assert got == want
    assert suffix_dedup.repeats_removed(docs).columns == docs.columns


def test_repeated_rows_of_repeats(spark):
    t = "abcdefghij" * 3 + "".join(map(str, range(200)))
    df = spark.createDataFrame([(1, t), (1, t), (1, t + "x"), (2, "short"), (2, "short")], "doc_id long, text string")
    got = sorted((r.doc_id, r["__size"] - r["__removed"]) for r in suffix_dedup.remove_repeats(df).collect())
    n = len(t)
    assert got[3:] == [(2, 5), (2, 5)] and sum(k for _, k in got[:3]) in (n + 1, n)


def test_many_texts_without_ids(spark):
    """Far more than a short hash could tell apart; each two share a passage."""
    rng = random.Random(9)
    letters = lambda n: "".join(rng.choices("abcdefghijklmnopqrstuvwxyz", k=n))
    texts = [letters(130) + p + letters(130) for _ in range(1200) for p in [letters(110)] for _ in range(2)]
    got = suffix_dedup.remove_repeats(spark.createDataFrame([(None, t) for t in texts], "doc_id long, text string")).agg(F.count("*"), F.sum("__removed"), F.sum("__spans"), F.min("__removed")).first()
    assert got[0] == 2400 and got[2] == 1200 and got[3] == 0 and 110 * 1200 <= got[1] < 111 * 1200


def test_repeats_in_very_long_texts(spark):
    """Texts over a chunk, with a passage over the chunk's edge, at another shift, and twice in one text."""
    rng = random.Random(12)
    letters = lambda n: "".join(rng.choices("abcdefgh", k=n))
    n = suffix_dedup.CHUNK
    passage = letters(5000)
    texts_ = [(1, letters(n - 2000) + passage + letters(n)), (2, letters(777) + passage + letters(50) + passage[:300]), (3, letters(n + 99)), (4, passage[1000:1100])]
    got = {r.doc_id: (r["__size"], r["__removed"], r["__spans"], bytes(r["__kept"])) for r in suffix_dedup.remove_repeats(spark.createDataFrame(texts_, "doc_id long, text string")).collect()}
    assert got == brute_repeats(texts_)


def test_segments_with_one_hash_are_compared_by_their_bytes(spark, monkeypatch):
    """Under one hash only equal bytes are repeats; of one anchor, which then would be lost, different ones end the job."""
    rng = random.Random(3)
    letters = lambda n: "".join(rng.choices("abcdefgh", k=n))
    middle, texts_ = letters(40), []
    for k in range(6):
        texts_.append((k, letters(80) + middle + letters(80)))
    rows_ = [(5, 7, k, 0, 0, t[60:200].encode(), True) for k, t in texts_[:2]]
    batch = pa.RecordBatch.from_arrays([pa.array([r[0] for r in rows_]), *(pa.array([r[k] for r in rows_]) for k in (2, 3, 4)), pa.array([r[5] for r in rows_]), pa.array([True] * 2)], names="h doc th start bytes whole".split())
    with pytest.raises(ValueError, match="one hash"):
        list(suffix_dedup._compare(100)(iter([batch])))
    a, b, c = (letters(140).encode() for _ in range(3))
    rows_ = [(5, 1, 0, 0, a), (5, 1, 0, 300, b), (5, 2, 0, 7, b), (5, 3, 0, 0, a), (5, 4, 0, 0, c), (6, 5, 0, 0, a), (6, 6, 0, 9, a)]
    names = "h doc th start bytes whole".split()
    batches = [pa.RecordBatch.from_arrays([*(pa.array([r[k] for r in part]) for k in range(5)), pa.array([True] * len(part))], names=names) for part in (rows_[:3], rows_[3:])]
    got = pa.Table.from_batches(suffix_dedup._compare(100)(iter(batches))).to_pydict()
    assert list(zip(got["doc"], got["start"], got["stop"], strict=True)) == [(2, 7, 147), (3, 0, 140), (6, 9, 149)]
    monkeypatch.setattr(suffix_dedup._Hasher, "of", lambda self, a, b: np.zeros(len(a), np.uint64))
    pieces = pa.RecordBatch.from_arrays([pa.array([k for k, _ in texts_]), pa.array([0] * 6), pa.array([t.encode() for _, t in texts_])], names=["doc", "th", "text"])
    out = pa.Table.from_batches(suffix_dedup._cut(100)(iter([pieces])))
    assert not any(out.column("e").to_pylist())


@settings(max_examples=40, deadline=None)
@given(st.lists(st.text("ab", max_size=90), min_size=1, max_size=5))
def test_segments_cover_each_window_once(parts):
    data = b"".join(p.encode() for p in parts)
    offsets = np.r_[0, np.cumsum([len(p) for p in parts])]
    seen = defaultdict(list)
    for row, first, end, *_ in suffix_dedup.segments(np.frombuffer(data, np.uint8), offsets, 40):
        for r, a, b in zip(row, first, end, strict=True):
            seen[int(r)] += range(int(a), int(b) + 1)
    assert {k: len(p) - 39 for k, p in enumerate(parts) if len(p) >= 40} == {k: len(v) for k, v in seen.items()}
    assert all(sorted(v) == list(range(len(v))) for v in seen.values())


def slow_fingerprint(text):
    w = re.findall("[^\x20\x09-\x0d]+", "".join(c.lower() if "A" <= c <= "Z" else c for c in text or ""))
    if not w:
        return 0
    h = [xxhash.xxh64_intdigest(" ".join(w[i : i + 3]).encode(), 42) for i in range(max(1, len(w) - 2))]
    return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))


@pytest.mark.parametrize("most", [20_000, 1])
def test_near_duplicates(docs, most):
    items = [(r[0], slow_fingerprint(r[1])) for r in rows()]
    owner = list(range(len(items)))
    for _ in items:
        for i, a in enumerate(items):
            for j, b in enumerate(items):
                if (a[1] ^ b[1]).bit_count() <= 2:
                    owner[i] = owner[j] = min(owner[i], owner[j])
    low = {o: min((items[k][0] for k in range(len(items)) if owner[k] == o and items[k][0] is not None), default=None) for o in owner}
    want = {d: (fp, low[o]) for (d, fp), o in zip(items, owner, strict=True)}
    got = {r.doc_id: (r.fp % 2**64, r.component_id) for r in simhash.near_duplicates(docs, max_block=most).collect()}
    assert got == want
    if most > 1:
        kept = simhash.one_of_each(docs)
        assert kept.columns == docs.columns
        assert sorted(r.doc_id for r in kept.where("doc_id is not null").collect()) == sorted({v for v in low.values() if v is not None} - {v for k, v in low.items() if k == owner[-1]})


@pytest.mark.parametrize(("radius", "most", "levels"), [(2, 20_000, 8), (2, 3, 8), (2, 3, 0), (1, 4, 3), (3, 3, 8), (3, 20, 2), (4, 5, 3)])
def test_dense_clusters_keep_their_links(spark, radius, most, levels):
    rng = random.Random(1)
    codes = set()
    for _ in range(12):
        c = rng.getrandbits(64)
        for _ in range(25):
            x = c
            for _ in range(rng.randint(0, 3 + radius)):
                x ^= 1 << rng.randrange(64)
            codes.add(x)
    a = np.array(sorted(codes), np.uint64)
    lab = simhash.labels(len(a), *np.nonzero(np.triu(np.bitwise_count(a[:, None] ^ a[None, :]) <= radius, 1)))
    df = spark.createDataFrame([(int(v),) for v in a.view(np.int64)], "fp long")
    root = {r.v: r.m for r in simhash.components(simhash.link_edges(df, radius, most, levels)).collect()}
    parts = defaultdict(set)
    for v, k in zip(a.view(np.int64).tolist(), lab.tolist(), strict=True):
        parts[k].add(root.get(v, v))
    assert all(len(p) == 1 for p in parts.values()) and len({next(iter(p)) for p in parts.values()}) == len(parts)


def test_similar_texts_by_brute_force(spark):
    """Groups of near copies whose links make chains: the classes of all links of 5-word shingles at 0.8."""
    rng = random.Random(21)
    words = [f"w{k}" for k in range(4000)]
    texts_ = []
    for size in (6, 30, 120):
        for _ in range(6):
            base = [rng.choice(words) for _ in range(size)]
            for _ in range(14):
                copy = list(base)
                for _ in range(rng.randint(0, max(1, size // 30))):
                    copy[rng.randrange(size)] = rng.choice(words)
                texts_.append(" ".join(copy))
                if rng.random() < 0.3:
                    base = copy
    sets = [set(similar.shingles(t.encode()).tolist()) for t in texts_]
    linked = [[5 * len(a & b) >= 4 * len(a | b) for b in sets] for a in sets]
    lab = simhash.labels(len(sets), *np.nonzero(np.array(linked)))
    kept = similar.one_of_each(spark.createDataFrame(list(enumerate(texts_)), "doc_id long, text string")).collect()
    assert 20 < len(kept) < 200 and {r.doc_id for r in kept} == set(lab.tolist())


def test_packing(docs):
    path = public_tokenizers.path("word_bpe_49k.json")
    t, want = Tokenizer.from_file(path), {}
    for d, text, *_ in rows():
        ids = [*t.encode(text or "", add_special_tokens=False).ids, 1]
        for k, at in enumerate(range(0, len(ids), 64)):
            want[d, k] = (at, len(ids[at : at + 64]), zlib.crc32(np.array(ids[at : at + 64], "<u4").tobytes()))
    out = packing.pack(packing.tokenized_pieces(docs, path, 64), 64).collect()
    assert {(r.doc_id, r.piece): (r.start, r.length, r.ids_crc32) for r in out} == want
    check_packed(out, 64)


def check_packed(out, size):
    by = defaultdict(list)
    for r in out:
        by[r.sequence_id].append((r.offset, r.length))
    for s in by.values():
        at = 0
        for offset, length in sorted(s):
            assert offset == at
            at += length
        assert at <= size
    return len(by)


def loads(plan):
    """Of each sequence the filled room; checks that its items lie one after the other, and that each item is placed once."""
    spans, where = defaultdict(list), defaultdict(list)
    for length, lo, hi, times, sequence, offset in plan.rows:
        spans[length].append((lo, hi))
        assert (hi - lo) % times == 0
        for s in range(times):
            where[sequence + s] += [(offset + k * length, length) for k in range((hi - lo) // times)]
    for k, v in spans.items():
        v.sort()
        assert v[0][0] == 0 and v[-1][1] == plan.count[k] and all(a[1] == b[0] for a, b in zip(v[:-1], v[1:], strict=True))
    assert set(spans) == set(np.flatnonzero(plan.count).tolist()) and set(where) == set(range(plan.sequences))
    for items in where.values():
        items.sort()
        assert all(a == sum(n for _, n in items[:k]) for k, (a, _) in enumerate(items))
    return [sum(n for _, n in items) for items in where.values()]


@settings(max_examples=40, deadline=None)
@given(st.dictionaries(st.integers(1, 50), st.integers(1, 400), min_size=1, max_size=20))
def test_plan_places_every_item_once_and_never_costs_a_sequence(counts):
    found, alone = packing.plan(counts, 50, 200, 8), packing.Plan(counts, 50)
    alone.best_fit()
    assert max(loads(found)) <= 50 and max(loads(alone)) <= 50 and found.sequences <= alone.sequences
    assert packing.plan({}, 50).rows == []


def test_most_sequences_come_from_the_linear_program():
    rng = np.random.default_rng(8)
    lengths = np.clip(rng.lognormal(6, 1, 40_000).astype(int), 1, 4095)
    counts = dict(zip(*(x.tolist() for x in np.unique(lengths, return_counts=True)), strict=True))
    found, alone = packing.plan(counts, 4096), packing.Plan(counts, 4096)
    alone.best_fit()
    assert found.from_program > 0.6 * found.sequences and found.sequences <= alone.sequences
    assert found.sequences <= 1.001 * lengths.sum() / 4096 + 1 and max(loads(found)) <= 4096


def test_linear_program_by_brute_force():
    """The best configuration of all, and a bound under what the program reaches."""
    sizes, demand = np.array([9, 7, 4, 3]), np.array([30, 40, 50, 60])
    worth = np.array([90, 66, 39, 31])
    every = [c for c in product(range(3), range(3), range(6), range(7)) if np.dot(c, sizes) <= 20]
    assert worth @ packing.knapsack(sizes, worth, demand, 20) == max(worth @ np.array(c) for c in every)
    configs, x, bound = packing.linear_program(sizes, demand, 20)
    assert (configs @ sizes <= 20).all() and (x @ configs >= demand * (1 - 1e-9)).all()
    assert 0 < bound <= x.sum() and sizes @ demand / 20 <= x.sum() <= 1.1 * 47  # 47: what the best packing takes


WORDS = st.text(st.sampled_from("ab .,'sÀéΣİß１\t\n\r\x1c　<|>0"), max_size=40)


@settings(max_examples=200, deadline=None)
@given(WORDS)
def test_word_cache_is_the_tokenizer(text):
    path = public_tokenizers.path("word_bpe_49k.json")
    cache = packing._cache(path)
    assert np.frombuffer(cache.encode([text])[0], "<u4").tolist() == cache.tokenizer.encode(text, add_special_tokens=False).ids


def test_byte_bpe(docs):
    path, pattern = public_tokenizers.path("byte_bpe_multi_50k.tiktoken"), public_tokenizers.PATTERN
    reference = tiktoken.Encoding("own", pat_str=pattern, mergeable_ranks=byte_bpe.vocabulary(path, pattern).ranks, special_tokens={})
    out = byte_bpe.with_decoded(byte_bpe.with_ids(docs.select("doc_id", "text"), path, pattern), path, pattern).collect()
    for r in out:
        text = {x[0]: x[1] for x in rows()}[r.doc_id] or ""
        assert np.frombuffer(bytes(r["__ids"]), "<u4").tolist() == reference.encode_ordinary(text) and bytes(r["__decoded"]) == text.encode()


@settings(max_examples=150, deadline=None)
@given(st.text(max_size=60))
def test_byte_bpe_of_any_text(text):
    v = byte_bpe.vocabulary(public_tokenizers.path("byte_bpe_multi_50k.tiktoken"), public_tokenizers.PATTERN)
    reference = tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=v.ranks, special_tokens={})
    ids = v.encode([text])[0]
    assert np.frombuffer(ids, "<u4").tolist() == reference.encode_ordinary(text) and v.decode(ids) == text.encode()


def test_media(spark, docs):
    html = "<p>One &amp; <b>two</b></p><script>no</script><figure><img src='sha256:aa' alt='x'><figcaption>A  cat</figcaption></figure><p>three<img src='u' alt='dog'>four"
    assert media.parse(html) == [(0, "text", "One & two", None, None), (1, "media", None, "sha256:aa", "A cat"), (2, "text", "three", None, None), (3, "media", None, "u", "dog"), (4, "text", "four", None, None)]
    assert media.parse(None) == []
    for n in (64, 640):
        p = bytes(random.Random(n).randbytes(n))
        assert media.from_png(media.to_png(p)) == p
    with pytest.raises(ValueError, match="damaged"):
        media.from_png(media.to_png(bytes(64)).replace(b"IDAT", b"IDAX"))
    d = docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text")).withColumn("payload", media.padded(F.col("text"))).withColumn("digest", F.sha2("payload", 256))
    seq = media.interleaved(d.select("doc_id", media.as_page(F.col("text"), F.col("digest"), F.concat(F.lit("no. "), F.coalesce(F.col("doc_id").cast("string"), F.lit("?")))).alias("html")))
    out = media.resolved(seq, media.media_features(media.media_store(d)))
    for r in out.where("kind = 'media'").collect():
        b = ({x[0]: x[1] for x in rows()}[r.doc_id] or "").encode()
        b += bytes(-len(b) % 64 or (0 if b else 64))
        assert (r.payload_bytes, r.payload_sha256, r.tail_crc32, r.media_sha256) == (len(b), hashlib.sha256(b).hexdigest(), zlib.crc32(b[-64:]), hashlib.sha256(media.to_png(b)).hexdigest())
        assert r.caption == f"no. {'?' if r.doc_id is None else r.doc_id}" and r.position == (1 if ({x[0]: x[1] for x in rows()}[r.doc_id] or "").split("\n\n")[0].strip() else 0)
    # several media on a page, in their order and with their captions, from one store
    digests = [hashlib.sha256(bytes([k]) * 64).hexdigest() for k in range(3)]
    store = media.media_store(spark.createDataFrame([(h, bytes([k]) * 64) for k, h in enumerate(digests)] * 2, "digest string, payload binary"))
    html = "".join(f"<p>before {k}</p><img src='sha256:{h}' alt='cap {k}'>" for k, h in enumerate(digests)) + f"<img src='sha256:{digests[0]}'>"
    found = sorted(media.resolved(media.interleaved(spark.createDataFrame([(1, html, "p")], "page_id long, html string, `u.v` string")), media.media_features(store)).collect(), key=lambda r: r.position)
    assert store.count() == 3 and [(r.kind, r.text or r.caption) for r in found] == [("text", "before 0"), ("media", "cap 0"), ("text", "before 1"), ("media", "cap 1"), ("text", "before 2"), ("media", "cap 2"), ("media", None)]
    assert [r.payload_sha256 for r in found if r.kind == "media"] == [hashlib.sha256(bytes([k]) * 64).hexdigest() for k in (0, 1, 2, 0)]
    missing = spark.createDataFrame([("<img src='sha256:" + "0" * 64 + "'>",)], "html string")
    assert media.resolved(media.interleaved(missing), media.media_features(media.media_store(d))).first().feature is None


def test_language(spark):
    rng = random.Random(2)
    make = lambda letters: " ".join("".join(rng.choice(letters) for _ in range(rng.randint(2, 6))) for _ in range(40))
    data = [(k, make("abcdeé" if k % 2 else "vwxyzß"), "aa" if k % 2 else "bb") for k in range(60)] + [(90, None, "aa"), (91, "123 !", "aa"), (92, "", None), (None, "abc", "bb")]
    df = spark.createDataFrame(data, "doc_id long, text string, lang string")
    trees = language.learn(df.where("doc_id < 40"))
    out = {r.doc_id: (r.lang_pred, r.score) for r in language.with_language(df.select("doc_id", "text"), trees).collect()}
    assert all(out[k][0] == ("aa" if k % 2 else "bb") and 0.5 < out[k][1] <= 1 for k in range(60))
    assert out[90] == out[91] == out[92] == ("und", 0.0)
    # exact code: in each context the shares of all 256 bytes add to 1
    share = 2.0 ** -(trees.cost.reshape(*trees.step.shape, -1) / language.SCALE)
    total = share[:, :-1].sum(axis=1) + share[:, -1] * (256 - share.shape[1] + 1)
    assert abs(total - 1).max() < 1e-3
    assert language.with_language(df.select("doc_id", "text"), language.learn(df.where("false"))).where("lang_pred != 'und'").count() == 0


def test_code_lengths_by_brute_force():
    texts_ = [b"abracadabra", b"abcabcabd"]
    gram = np.concatenate([language._grams(np.frombuffer(t, np.uint8), np.array([0, len(t)]), 3) for t in texts_])
    g, n = np.unique(gram, return_counts=True)
    trees = language.ContextTrees(["x"], np.zeros(len(g), int), g, n, 3, 1)
    counts = [defaultdict(lambda: defaultdict(int)) for _ in range(4)]
    for t in texts_:
        padded = bytes(3) + t
        for i in range(3, len(padded)):
            for d in range(4):
                counts[d][padded[i - d : i]][padded[i]] += 1

    def bits(context, byte):
        excluded, total = set(), 0.0
        for d in range(3, -1, -1):
            c = counts[d].get(context[3 - d :])
            if c is None:
                continue
            c = {s: k for s, k in c.items() if s not in excluded}
            if not c:
                continue
            m = sum(c.values()) + len(c)
            if byte in c:
                return total - np.log2(c[byte] / m)
            total -= np.log2(len(c) / m)
            excluded |= set(c)
        return total + np.log2(256 - len(excluded))

    for t in (b"abra", b"dabz\xff", b"cabcab"):
        padded = bytes(3) + t
        want = sum(bits(padded[i - 3 : i], padded[i]) for i in range(3, len(padded)))
        got = trees.code_lengths(np.frombuffer(t, np.uint8), np.array([0, len(t)]))[0, 0] / language.SCALE
        assert got == pytest.approx(want, abs=0.01)


def test_warc(spark):
    data = [(5, "http://a", "x"), (3, "http://b", "x"), (9, None, None), (7, "u\r\nEvil: 1", ""), (11, "http://c", "é" * 500), (None, "http://n", "x")]
    store, headers = warc.write_archive(spark.createDataFrame(data, "page_id long, url string, html string"))
    assert store.count() == 3
    out = {r.id: r for r in warc.record_bytes(warc.read_records(store, headers)).collect()}
    assert {k: (r.record_type, r.refers_to) for k, r in out.items()} == {5: ("revisit", 3), 3: ("response", None), 9: ("revisit", 7), 7: ("response", None), 11: ("response", None), None: ("revisit", 3)}
    assert bytes(out[5].payload) == b"x" and bytes(out[11].record).endswith("é".encode() * 500 + b"\r\n\r\n") and b"Content-Length: 1000\r\n" in bytes(out[11].record)
    assert b"\r\nEvil" not in bytes(out[7].record)
    import base64

    assert b"sha1:" + base64.b32encode(hashlib.sha1(b"x").digest()) in bytes(out[3].record)
    bad = store.withColumn("payload", F.lit(b"other"))
    with pytest.raises(Exception, match="does not have its digest"):
        warc.read_records(bad, headers).collect()


@pytest.mark.parametrize("block", [7, 60, 5000])
def test_top_k(spark, block):
    rng = np.random.default_rng(3)
    v = [(k, rng.integers(-4, 5, 6).tolist()) for k in range(120)] + [(200, None), (None, [1] * 6), (150, [9, 9]), (250, [9, 9])]
    out = defaultdict(list)
    for r in topk.top_k(spark.createDataFrame(v, "id long, vector array<long>"), F.col("id") % 50 == 0, 5, block).collect():
        out[r.query_id].append((r["rank"], r.vec_id, r.score))
    x = {k: np.array(a + [0] * (6 - len(a))) for k, a in v if k is not None and a is not None}
    for q in (0, 50, 100, 150, 250):
        best = sorted(((-int(x[q] @ a), k) for k, a in x.items() if k != q))[:5]
        assert sorted(out[q]) == [(i + 1, k, -s) for i, (s, k) in enumerate(best)]
    with pytest.raises(Exception, match="63 bits"):
        topk.top_k(spark.createDataFrame([(0, [2**40]), (1, [2**40])], "id long, vector array<long>"), F.col("id") % 50 == 0).collect()
    q = spark.createDataFrame([(1, [0.1, -0.001]), (2, [float("nan"), 1.0]), (3, [None, 1.0])], "id long, v array<double>")
    assert [r[0] for r in q.select(topk.quantised(F.col("v"))).collect()] == [[25, -1], None, None]


def test_top_k_of_large_components_and_repeats(spark):
    """Scores that a double cannot tell apart, and a query's own id ten times in a leaf."""
    a = 3037000499
    v = [(0, [a, 1, 1]), (1, [a, 0, 0]), (2, [a, 1, 0]), (3, [a, 1, 1]), *[(50, [9, 9, 9])] * 10, *[(60 + k, [k % 7, 1, 1]) for k in range(30)]]
    out = topk.top_k(spark.createDataFrame(v, "id long, vector array<long>"), F.col("id") % 50 == 0).collect()
    first = [(r.vec_id, r.score) for r in sorted(out, key=lambda r: r["rank"]) if r.query_id == 0][:3]
    assert first == [(3, a * a + 2), (2, a * a + 1), (1, a * a)]
    assert 50 not in {r.vec_id for r in out if r.query_id == 50}


def test_trees_prune_where_there_is_structure():
    rng = np.random.default_rng(6)
    centres = rng.integers(-400, 400, (40, 16))
    x = centres[rng.integers(0, 40, 6000)] + rng.integers(-8, 9, (6000, 16))
    q = centres[rng.integers(0, 40, 300)] + rng.integers(-8, 9, (300, 16))
    found = topk.DualSearch(q, np.arange(300) + 10**6, x, np.arange(6000), 5)
    found.search()
    assert found.compared < 0.35 * 300 * 6000
    for k in range(300):
        best = sorted(((-s, i) for i, s in enumerate((x @ q[k]).tolist())))[:5]
        mine = found.row == k
        assert list(zip((-found.score[mine]).tolist(), found.id[mine].tolist(), strict=True)) == best


def slow_spans(text):
    out = []
    for m in re.finditer(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", text):
        out.append((m.start(), m.end(), "email"))
    for m in re.finditer(r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", text):
        if all(int(p) <= 255 for p in m[0].split(".")):
            out.append((m.start(), m.end(), "ip"))
    for m in re.finditer(r"[0-9]([\x20-]?[0-9])+", text):
        d = [int(c) for c in m[0] if c.isdigit()]
        s = sum(d[-1::-2]) + sum(x * 2 - 9 * (x > 4) for x in d[-2::-2])
        if 14 <= len(d) <= 19 and s % 10 == 0:
            out.append((m.start(), m.end(), "card"))
    for m in re.finditer(r"\+[0-9][\x20().0-9-]+[0-9]", text):
        if 10 <= sum(c.isdigit() for c in m[0]) <= 15:
            out.append((m.start(), m.end(), "phone"))
    return sorted(out)


@settings(max_examples=400, deadline=None)
@given(st.text(st.sampled_from("aB.@-+_ 0123459()é"), max_size=60))
def test_base_spans(text):
    assert sorted(pii.detect(text)) == slow_spans(text)


def test_disguises_map_to_the_source(docs):
    cases = {"x ann at mail dot example dot com y": "ann at mail dot example dot com", "bob [at] site (dot) org": "bob [at] site (dot) org", "ѕаm@ехample.com!": "ѕаm@ехample.com", "call plus one five five five one two three four five six seven now": "plus one five five five one two three four five six seven", "１２３.4.5.6": "１２３.4.5.6"}
    for text, span in cases.items():
        base, found = pii.find(text)
        assert [text[a:b] for a, b, _ in found] == [span] and not base
    assert pii.masked("to a@b.co at 1.2.3.4") == "to <EMAIL> at <IP>"
    out = pii.personal_data(docs)
    assert out.count() == len(rows()) and pii.without_personal_data(docs).columns == docs.columns
    assert pii.find("meet at noon, polka dot dress") == ([], [])


def test_chain_by_another_fit():
    """The weights are where plain gradient descent ends, later models with out-of-fold predictions of the earlier ones."""
    rng = np.random.default_rng(2)
    x = rng.integers(0, 2, (240, 5)).astype(float)
    y0 = (x @ [2, -1, 0, 1, 0] + rng.normal(size=240) > 0.5).astype(int)
    y1 = (x @ [0, 1, 1, 0, -1] + 1.5 * y0 + rng.normal(size=240) > 1).astype(int)
    fold = np.arange(240) % 4

    def descend(x, y):
        x, w = np.column_stack([x, np.ones(len(x))]), np.zeros(x.shape[1] + 1)
        ridge = np.r_[np.ones(x.shape[1] - 1), 1e-6]
        for _ in range(20_000):
            w = w - 0.01 * (x.T @ (1 / (1 + np.exp(-x @ w)) - y) + ridge * w)
        return w

    chain = toxicity.fit_chain(x, np.column_stack([y0, y1]), fold)
    held = np.zeros(240)
    for f in range(4):
        w = descend(x[fold != f], y0[fold != f])
        held[fold == f] = 1 / (1 + np.exp(-(x[fold == f] @ w[:-1] + w[-1])))
    assert np.allclose(chain[0], descend(x, y0), atol=1e-5) and np.allclose(chain[1], descend(np.column_stack([x, held]), y1), atol=1e-5)


def test_toxic_words_with_capitals_and_labels_that_disagree(spark):
    data = [(k, f"plain words number{k} of text" + (" \u00c9vil" if k % 2 else "")) for k in range(120)]
    labels = [(k, k % 2) for k in range(100)] + [(1, 0), (3, None)]
    chain = toxicity.train(spark.createDataFrame(data, "doc_id long, text string"), spark.createDataFrame(labels, "doc_id long, toxic int"), ["toxic"])
    p = {r.doc_id: r["__p_toxic"] for r in toxicity.with_probabilities(spark.createDataFrame(data, "doc_id long, text string"), chain).collect()}
    assert all((v >= 0.5) == bool(k % 2) for k, v in p.items())


def test_toxicity(spark):
    rng = random.Random(5)
    words = ["".join(rng.choice("abcdef") for _ in range(4)) for _ in range(60)]
    data, labels = [], []
    for k in range(400):
        bad = k % 4 == 0
        data.append((k, " ".join(rng.choice(words) for _ in range(30)) + (" Vile, nasty" if bad else "")))
        if k % 2 == 0 or k % 3 == 0:
            labels.append((k, 1 - bad, int(bad)))
    df = spark.createDataFrame([*data, (900, None), (901, ""), (None, "vile nasty")], "doc_id long, text string")
    chain = toxicity.train(df, spark.createDataFrame([*labels, (5, None, 1), (None, 0, 1)], "doc_id long, quality int, toxic int"), ["quality", "toxic"])
    p = {r.doc_id: r["__p_toxic"] for r in toxicity.with_probabilities(df, chain).collect()}
    assert all((p[k] >= 0.5) == (k % 4 == 0) for k in range(400)) and p[900] < 0.5 and p[901] < 0.5 and p[None] > 0.5
    assert toxicity.clean_documents(df, chain).count() == 302
    none = toxicity.train(df.where("false"), spark.createDataFrame([], "doc_id long, quality int, toxic int"), ["quality", "toxic"])
    assert toxicity.clean_documents(df, none).count() == 403


@pytest.fixture(scope="module")
def folder(spark, tmp_path_factory):
    path = str(tmp_path_factory.mktemp("tables"))
    spark.createDataFrame(rows(), SCHEMA).write.parquet(f"{path}/documents.parquet")
    spark.createDataFrame([(k, k % 2, int(k % 9 == 0)) for k in range(30)], "doc_id long, quality int, toxic int").write.parquet(f"{path}/labels.parquet")
    spark.createDataFrame([(1, "u", "<p>x</p>")], "page_id long, url string, html string").write.parquet(f"{path}/pages.parquet")
    spark.createDataFrame([(k, [0.1 * k, -0.2]) for k in range(60)], "vec_id long, embedding array<float>").write.parquet(f"{path}/embeddings.parquet")
    return path


def test_pipeline_is_its_operators_one_by_one(spark, folder):
    out = corpus_pipeline.run(spark, folder).collect()
    d = {r[0]: r[1] for r in rows()}
    chain = queries.toxicity_chain(spark, folder)
    clean = [r.doc_id for r in toxicity.with_probabilities(queries.documents(spark, folder).select("doc_id", "text"), chain).where("__p_toxic < 0.5").collect()]
    owner = {k: k for k in clean}
    key = lambda k: (k is not None, k or 0)
    sets = {k: set(similar.shingles((d[k] or "").encode()).tolist()) for k in clean}
    for _ in clean:
        for a in clean:
            for b in clean:
                if 5 * len(sets[a] & sets[b]) >= 4 * len(sets[a] | sets[b]):
                    owner[a] = owner[b] = min(owner[a], owner[b], key=key)
    kept = sorted({k for k in clean if owner[k] == k}, key=key)
    left = {k: v[3].decode("utf-8", "ignore") for k, v in brute_repeats([(k, d[k]) for k in kept]).items()}
    t, want = Tokenizer.from_file(public_tokenizers.path("word_bpe_49k.json")), {}
    for k, text in left.items():
        ids = [*t.encode(pii.masked(text), add_special_tokens=False).ids, 1]
        want |= {(k, i // 4096): zlib.crc32(np.array(ids[i : i + 4096], "<u4").tobytes()) for i in range(0, len(ids), 4096)}
    assert {(r.doc_id, r.piece): r.ids_crc32 for r in out} == want
    check_packed(out, 4096)


DISGUISED = [
    ("write to " + "a" * 100 + " at " + "b" * 80 + " dot com", 1),
    ("john   [  at  ]   x   (dot)   org, twice john [at] x dOt org", 2),
    ("call plus four nine triple five triple two nine one or 192 dot 168 dot 1 dot 1", 2),
    ("card four one one one one one one one one one one one one one one one", 1),
    ("no data at all, polka dot dress", 0),
]


@pytest.fixture(scope="module")
def repeated(spark, folder, tmp_path_factory):
    """The tables with repeated rows, disguised personal data and more columns."""
    path = str(tmp_path_factory.mktemp("repeated"))
    more = [(5000 + k, t, None, None, None, None, None, None, None, None) for k, (t, _) in enumerate(DISGUISED)]
    all_rows = [*rows(), *more, rows()[5], rows()[5], rows()[0], rows()[-1]]
    spark.createDataFrame(all_rows, SCHEMA).write.parquet(f"{path}/documents.parquet")
    pages = [(5, "u", "x", 1), (3, "v", "x", 2), (3, "v", "x", 2), (9, None, None, 3), (7, "w", "", 4), (None, "n", "x", 5)]
    spark.createDataFrame(pages, "page_id long, url string, html string, digest int").write.parquet(f"{path}/pages.parquet")
    return path, [r[:2] for r in all_rows]


def tally(df, *columns):
    return Counter(tuple(r[c] for c in columns) for r in df.collect())


def test_registered_queries_equal_brute_force(spark, repeated):
    path, items = repeated
    run = lambda name: queries.QUERIES[name](spark, path)
    t, want = Tokenizer.from_file(public_tokenizers.path("word_bpe_49k.json")), Counter()
    for d, text in items:
        ids = np.array([*t.encode(text or "", add_special_tokens=False).ids, 1], "<u4")
        for k in range(0, len(ids), 4096):
            want[d, k // 4096, k, len(ids[k : k + 4096]), zlib.crc32(ids[k : k + 4096].tobytes())] += 1
    out = run("op1_best_fit_packing")
    assert tally(out, "doc_id", "piece", "start", "length", "ids_crc32") == want
    check_packed(out.collect(), 4096)

    path2, pattern = public_tokenizers.path("byte_bpe_multi_50k.tiktoken"), public_tokenizers.PATTERN
    reference, want = tiktoken.Encoding("own", pat_str=pattern, mergeable_ranks=byte_bpe.vocabulary(path2, pattern).ranks, special_tokens={}), Counter()
    sha = lambda b: hashlib.sha256(b).hexdigest()
    for d, text in items:
        ids = np.array(reference.encode_ordinary(text or ""), "<u4")
        want[d, len(ids), sha(ids.tobytes()), sha((text or "").encode())] += 1
    assert tally(run("op2_byte_bpe"), "doc_id", "n_tokens", "ids_sha256", "decoded_sha256") == want

    want = Counter()
    for d, text in items:
        b = (text or "").encode()
        p = b + bytes(-len(b) % 64 or (0 if b else 64))
        want[d, len(b), len(p), sha(p), zlib.crc32(p[-64:]), len(media.to_png(p)), sha(media.to_png(p)), media.feature(p)] += 1
    assert tally(run("op3_media_columns"), "doc_id", "n_bytes", "payload_bytes", "payload_sha256", "tail_crc32", "media_bytes", "media_sha256", "feature") == want

    got = tally(run("op4_language"), "doc_id", "held_out")
    assert got == Counter((d, d is not None and zlib.crc32(str(d).encode()) % 3 == 1) for d, _ in items)

    fps, want = [slow_fingerprint(text) for _, text in items], Counter()
    lab = simhash.labels(len(fps), *np.nonzero(np.array([[(a ^ b).bit_count() <= 2 for b in fps] for a in fps])))
    for (d, _), fp, k in zip(items, fps, lab, strict=True):
        low = min((e for (e, _), j in zip(items, lab, strict=True) if j == k and e is not None), default=None)
        want[d, f"{fp:016x}", low] += 1
    assert tally(run("op7_simhash"), "doc_id", "fingerprint", "component_id") == want

    want, found = Counter(), run("op8_pii").collect()
    for d, text in items:
        spans = sorted(slow_spans(text or ""), key=lambda x: (x[0], pii.KINDS.index(x[2])))
        want[d, *(sum(x[2] == k for x in spans) for k in pii.KINDS), sha(",".join(f"{k}:{a}:{b}" for a, b, k in spans).encode())] += 1
    assert Counter((r.doc_id, r.n_email, r.n_ip, r.n_card, r.n_phone, r.base_sha256) for r in found) == want
    added = {r.doc_id: r.n_added for r in found}
    assert [added[5000 + k] for k in range(len(DISGUISED))] == [n for _, n in DISGUISED]

    seen, want = set(), Counter()
    for d, text in sorted(items, key=lambda r: (r[0] is not None, r[0] or 0, r[1] or "")):
        b = (text or "").encode()
        gone = bytearray(len(b))
        for k in range(len(b) - 99):
            if b[k : k + 100] in seen:
                gone[k : k + 100] = b"\1" * 100
            seen.add(b[k : k + 100])
        want[d, len(b), sum(gone), sum(g and (not i or not gone[i - 1]) for i, g in enumerate(gone)), sha(bytes(x for x, g in zip(b, gone, strict=True) if not g))] += 1
    assert tally(run("op9_suffix_dedup"), "doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256") == want

    got = tally(run("op5_warc"), "page_id", "record_type", "refers_to")
    assert got == Counter({(5, "revisit", 3): 1, (3, "response", None): 2, (9, "revisit", 7): 1, (7, "response", None): 1, (None, "revisit", 3): 1})


@pytest.mark.parametrize("name", sorted(queries.QUERIES))
def test_empty_tables(spark, folder, name, tmp_path):
    for t in ("documents", "labels", "pages", "embeddings"):
        spark.read.parquet(f"{folder}/{t}.parquet").where("false").write.parquet(f"{tmp_path}/{t}.parquet")
    assert queries.QUERIES[name](spark, str(tmp_path)).collect() == []
    if name == "op1_best_fit_packing":
        assert corpus_pipeline.run(spark, str(tmp_path)).collect() == []


@pytest.mark.parametrize("name", sorted(queries.QUERIES))
def test_odd_tables(spark, folder, name):
    assert queries.QUERIES[name](spark, folder).count() > 0


def test_spans_merge():
    d, a, b = suffix_dedup.merge_spans(np.array([0, 1, 0, 0]), np.array([5, 0, 0, 20]), np.array([9, 3, 5, 30]))
    assert (d.tolist(), a.tolist(), b.tolist()) == ([0, 0, 1], [0, 20, 0], [9, 30, 3])
    assert suffix_dedup.first_rows([np.array([1, 1, 2], np.uint64)], [np.array([4, 3, 0])]).tolist() == [1, 1, 2]
    data = np.frombuffer(b"abcabdxabc", np.uint8)
    for at_once in (2, 100):
        assert suffix_dedup.equal_bytes(data, np.array([0, 0, 3]), np.array([3, 7, 7]), np.array([3, 3, 2]), at_once).tolist() == [False, True, True]
    assert pa.__version__
