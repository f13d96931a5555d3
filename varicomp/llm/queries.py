"""The registered queries of the operators: thin, over whole tables, with production parameters."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import byte_bpe, filter_audit, language, licenses, media, packing, pii, runs, simhash, suffix_dedup, topk, toxicity, warc
from .common import table

#: The label columns in the order of the chain.
CATEGORIES = ["quality", "toxic"]


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "documents")


def toxicity_chain(spark: SparkSession, sf_dir: str) -> toxicity.Chain:
    return toxicity.train(documents(spark, sf_dir), table(spark, sf_dir, "labels"), CATEGORIES)


def op1_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack(packing.tokenized_pieces(documents(spark, sf_dir), public_tokenizers.path("word_bpe_49k.json")))


def op2_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    vocabulary = public_tokenizers.path("byte_bpe_multi_50k.tiktoken"), public_tokenizers.PATTERN
    coded = byte_bpe.with_decoded(byte_bpe.with_ids(documents(spark, sf_dir).select("doc_id", "text"), *vocabulary), *vocabulary)
    return coded.select("doc_id", F.floor(F.octet_length("__ids") / 4).alias("n_tokens"), F.sha2("__ids", 256).alias("ids_sha256"), F.sha2("__decoded", 256).alias("decoded_sha256"))


def op3_media_columns(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = documents(spark, sf_dir).select("doc_id", F.coalesce("text", F.lit("")).alias("text")).withColumn("payload", media.padded(F.col("text"))).withColumn("digest", F.sha2("payload", 256))
    caption = F.concat(F.lit("text of document "), F.coalesce(F.col("doc_id").cast("string"), F.lit("without id")))
    sequences = media.interleaved(docs.select("doc_id", F.octet_length("text").cast("long").alias("n_bytes"), media.as_page(F.col("text"), F.col("digest"), caption).alias("html")))
    texts = F.transform(F.filter("items", lambda i: i.kind == "text"), lambda i: i.text)
    sequences = sequences.withColumns({"n_text": F.size(texts), "text_hash": F.unhex(F.sha2(F.array_join(texts, ""), 256))})
    contents = media.media_features(media.media_store(docs))
    found = media.resolved(sequences, contents).where("kind = 'media'")
    return found.select("doc_id", "n_bytes", "payload_bytes", "payload_sha256", "tail_crc32", "media_bytes", "media_sha256", "feature", "position", "caption", "n_text", F.lower(F.hex("text_hash")).alias("text_sha256"))


def op4_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    held_out = F.coalesce(F.crc32(F.col("doc_id").cast("string")) % 3 == 1, F.lit(False))
    docs = documents(spark, sf_dir).select("doc_id", "text", "lang", held_out.alias("held_out"))
    trees = language.learn(docs.where("not held_out").select("doc_id", "text", "lang"))
    return language.with_language(docs.select("doc_id", "held_out", "text"), trees)


def op5_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    archive = warc.write_archive(table(spark, sf_dir, "pages"))
    records = warc.read_records(*archive, payload_bytes=F.octet_length("payload").cast("long"), payload_digest=warc.base32_sha1(F.col("payload")))
    return records.select(F.col("id").alias("page_id"), "payload_bytes", "payload_digest", "record_type", "refers_to")


def op6_top_k(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("id"), topk.quantised(F.col("embedding")).alias("vector"))
    return topk.top_k(rows, F.col("id") % 50 == 0)


def op7_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = simhash.near_duplicates(documents(spark, sf_dir))
    return found.select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


def op8_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pii.personal_data(documents(spark, sf_dir))


def op9_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = suffix_dedup.remove_repeats(documents(spark, sf_dir).select("doc_id", "text"))
    return found.select("doc_id", F.col("__size").alias("n_bytes"), F.col("__removed").alias("n_removed"), F.col("__spans").alias("n_spans"), F.sha2("__kept", 256).alias("kept_sha256"))


def op10_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    scored = toxicity.with_probabilities(documents(spark, sf_dir).select("doc_id", "text"), toxicity_chain(spark, sf_dir))
    return scored.select("doc_id", *[F.col(f"__p_{c}").alias(f"p_{c}") for c in CATEGORIES], (F.col(f"__p_{CATEGORIES[-1]}") >= 0.5).cast("int").alias("toxic"))


def op11_periodic_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = runs.periodic_runs(documents(spark, sf_dir), loop_key=F.crc32(F.col("doc_id").cast("string")))
    lines = F.transform("runs", lambda r: F.concat(F.concat_ws(",", r.start.cast("string"), r.length.cast("string"), r.period.cast("string")), F.lit("\n")))
    best = [F.col(f"best.{c}").alias(c) for c in ("start", "length", "period")]
    milli = F.expr("1000 * best.length div best.period").alias("exponent_milli")
    return found.select(F.col("id").alias("doc_id"), F.size("runs").cast("long").alias("n_runs"), *best, milli, F.sha2(F.array_join(lines, ""), 256).alias("runs_sha256"), F.sha2("collapsed", 256).alias("collapsed_sha256"))


def op12_filter_audit(spark: SparkSession, sf_dir: str) -> DataFrame:
    return filter_audit.audit(documents(spark, sf_dir), table(spark, sf_dir, "labels"))


def op13_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return licenses.license_notices(documents(spark, sf_dir)).withColumnRenamed("id", "doc_id")


QUERIES = {f.__name__: f for f in (op1_best_fit_packing, op2_byte_bpe, op3_media_columns, op4_language, op5_warc, op6_top_k, op7_simhash, op8_pii, op9_suffix_dedup, op10_toxicity, op11_periodic_runs, op12_filter_audit, op13_license_scan)}

_BASE32 = " || ".join(f"substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567', 1 + ((('0x' || substr(h, {1 + 5 * k}, 5))::BIGINT >> {5 * j}) & 31)::INT, 1)" for k in range(8) for j in (3, 2, 1, 0))

#: Counts by part and failing letters, then every order and step by what fails before; no sets of filters.
_FILTER_AUDIT = """
    WITH t AS (SELECT doc_id, coalesce(source, '') AS part, coalesce(text, '') AS body,
                      regexp_extract_all(coalesce(text, ''), '[^\\x20\\x09-\\x0D]+') AS words,
                      min(doc_id) OVER (PARTITION BY coalesce(text, '')) AS low FROM documents),
    f AS (SELECT doc_id, part,
                 CASE WHEN len(words) < 50 THEN 'A' ELSE '' END
              || CASE WHEN 100 * len(list_distinct(words)) < 65 * len(words) THEN 'B' ELSE '' END
              || CASE WHEN 100 * length(regexp_replace(body, '[^A-Z]+', '', 'g')) > 5 * length(body) THEN 'C' ELSE '' END
              || CASE WHEN regexp_matches(body, '[#$%&*|]') THEN 'D' ELSE '' END
              || CASE WHEN low < doc_id THEN 'E' ELSE '' END AS fails FROM t),
    l AS (SELECT doc_id, max((quality = 1)::INT) AS good, max((toxic = 1)::INT) AS toxic FROM labels GROUP BY doc_id),
    c AS (SELECT part, fails, count(*) AS n, sum(coalesce(good, 0)) AS good, sum(coalesce(toxic, 0)) AS toxic
          FROM f LEFT JOIN l USING (doc_id) GROUP BY part, fails),
    x AS (SELECT unnest(['A', 'B', 'C', 'D', 'E']) AS x),
    o AS (SELECT a.x || b.x || c.x || d.x || e.x AS filter_order FROM x a, x b, x c, x d, x e
          WHERE len(list_distinct([a.x, b.x, c.x, d.x, e.x])) = 5),
    s AS (SELECT filter_order, step, substr(filter_order, step, 1) AS letter, substr(filter_order, 1, step - 1) AS before
          FROM o, (SELECT unnest([1, 2, 3, 4, 5])::INT AS step)),
    r AS (SELECT part, filter_order, step, letter,
                 sum(n) FILTER (translate(fails, before || letter, '') = fails) AS kept,
                 sum(n) FILTER (translate(fails, before, '') = fails AND contains(fails, letter)) AS removed,
                 sum(n) FILTER (translate(fails, before, '') <> fails AND contains(fails, letter)) AS redundant,
                 sum(n) FILTER (fails = letter) AS unique_fails,
                 sum(good) FILTER (translate(fails, before, '') = fails AND contains(fails, letter)) AS good_lost,
                 sum(toxic) FILTER (translate(fails, before, '') = fails AND contains(fails, letter)) AS toxic_lost
          FROM s, c GROUP BY part, filter_order, step, letter)
    SELECT part, filter_order, step, coalesce(kept, 0)::BIGINT AS kept, coalesce(removed, 0)::BIGINT AS removed,
           coalesce(redundant, 0)::BIGINT AS redundant, coalesce(unique_fails, 0)::BIGINT AS unique_fails,
           coalesce(good_lost, 0)::BIGINT AS good_lost, coalesce(toxic_lost, 0)::BIGINT AS toxic_lost,
           (sum(coalesce(removed, 0)) OVER (PARTITION BY part, letter))::BIGINT AS shapley FROM r"""

ORACLE: dict[str, str] = {
    "op12_filter_audit": _FILTER_AUDIT,
    "op5_warc": f"""
        WITH p AS (SELECT page_id, coalesce(html, '') AS body FROM pages),
        d AS (SELECT page_id, strlen(body) AS n, sha1(body) AS h, min(page_id) OVER (PARTITION BY body) AS low FROM p)
        SELECT page_id, n::BIGINT AS payload_bytes, {_BASE32} AS payload_digest,
               CASE WHEN page_id = low THEN 'response' ELSE 'revisit' END AS record_type,
               CASE WHEN page_id = low THEN NULL ELSE low END AS refers_to FROM d""",
    "op6_top_k": """
        WITH v AS (SELECT vec_id, list_transform(embedding, lambda x: floor(256 * x::DOUBLE)) AS v FROM embeddings
                   WHERE len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
        s AS (SELECT q.vec_id AS query_id, c.vec_id, list_inner_product(q.v, c.v)::BIGINT AS score
              FROM v q JOIN v c ON c.vec_id <> q.vec_id WHERE q.vec_id % 50 = 0),
        r AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS place FROM s)
        SELECT query_id, place::INT AS rank, vec_id, score FROM r WHERE place <= 5""",
}
