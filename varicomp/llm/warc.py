"""A content-addressed WARC archive.

The payload of each distinct content is stored once, under its SHA-256 and checked against it when read; the record
headers are stored exactly, apart, with the digest. Records are put together again by a join on the digest. Of records
with equal payloads of at least `least` bytes, the one with the smallest id is a response and the others revisit it.

Null payloads are empty; a null URL is an empty target. A null id is never the smallest one, unless all are null: then
all are responses. Rows that repeat the smallest id are all responses. Line breaks in a URL are percent-encoded.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import materialize

_PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
_END = "\r\n"


def base32_sha1(payload: Column) -> Column:
    """The SHA-1 in base 32: each five hexadecimal digits are four characters."""
    digest = F.sha1(payload)
    parts = [F.lpad(F.conv(F.substring(digest, 1 + 5 * k, 5), 16, 32), 4, "0") for k in range(8)]
    return F.translate(F.concat(*parts), "0123456789ABCDEFGHIJKLMNOPQRSTUV", "ABCDEFGHIJKLMNOPQRSTUVWXYZ234567")


def write_archive(pages: DataFrame, id_col: str = "page_id", url_col: str = "url", payload_col: str = "html", least: int = 0, date: str = "2024-01-01T00:00:00Z") -> tuple[DataFrame, DataFrame]:
    """Writes the payloads (digest, first_id, payload) and the headers (digest, header) to the shared folder, and opens both."""
    payload = F.coalesce(F.col(f"`{payload_col}`").cast("binary"), F.lit(b""))
    rows = pages.select(F.col(f"`{id_col}`").cast("long").alias("id"), F.coalesce(F.col(f"`{url_col}`").cast("string"), F.lit("")).alias("url"), payload.alias("payload")).withColumn("digest", F.sha2("payload", 256))
    # equal payloads meet within each task before anything is shuffled
    store = materialize(rows.groupBy("digest").agg(F.min("id").alias("first_id"), F.first("payload").alias("payload")), "payloads")
    slim = rows.select("id", "url", "digest", F.octet_length("payload").cast("long").alias("size"), base32_sha1(F.col("payload")).alias("sha1"))
    known = slim.join(store.select("digest", "first_id"), "digest")
    response = (F.col("size") < least) | F.col("first_id").isNull() | F.col("id").eqNullSafe(F.col("first_id"))
    url = F.replace(F.replace(F.col("url"), F.lit("\r"), F.lit("%0D")), F.lit("\n"), F.lit("%0A"))
    name = lambda c: F.concat(F.lit("<urn:page:"), F.coalesce(F.col(c).cast("string"), F.lit("")), F.lit(">"))
    header = F.concat(
        F.lit(f"WARC/1.1{_END}WARC-Type: "), F.when(response, "response").otherwise("revisit"),
        F.lit(f"{_END}WARC-Record-ID: "), name("id"), F.lit(f"{_END}WARC-Target-URI: "), url, F.lit(f"{_END}WARC-Date: {date}{_END}WARC-Payload-Digest: sha1:"), F.col("sha1"),
        F.when(response, "").otherwise(F.concat(F.lit(f"{_END}WARC-Profile: {_PROFILE}{_END}WARC-Refers-To: "), name("first_id"))),
        F.lit(f"{_END}Content-Type: text/html; charset=utf-8{_END}Content-Length: "), F.when(response, F.col("size")).otherwise(F.lit(0)).cast("string"), F.lit(_END * 2),
    )
    return store, materialize(known.select("digest", header.alias("header")), "headers")


def field(name: str) -> Column:
    """A field of the column header; null if there is none."""
    return F.nullif(F.regexp_extract("header", rf"\r\n{name}: ([^\r\n]*)\r\n", 1), F.lit(""))


def read_records(store: DataFrame, headers: DataFrame, **of_payload: Column) -> DataFrame:
    """A row for each record: id, record_type, url, refers_to, header, and its payload, also of a revisit.

    of_payload: columns of the column payload to return in its place; they are made once for each stored payload, and
    only they are shuffled. A payload that doesn't have its digest fails the job.
    """
    checked = store.withColumn("payload", F.when(F.sha2("payload", 256) == F.col("digest"), F.col("payload")).otherwise(F.raise_error(F.lit("a stored payload does not have its digest"))))
    contents = checked.select("digest", *[c.alias(k) for k, c in (of_payload or {"payload": F.col("payload")}).items()])
    number = lambda c: F.regexp_extract(c, "<urn:page:(-?[0-9]+)>", 1).try_cast("long")
    records = headers.select("digest", "header", number(field("WARC-Record-ID")).alias("id"), F.regexp_extract("header", "WARC-Type: ([a-z]+)", 1).alias("record_type"), field("WARC-Target-URI").alias("url"), number(field("WARC-Refers-To")).alias("refers_to"))
    return records.join(contents, "digest")


def record_bytes(records: DataFrame) -> DataFrame:
    """records (with header, record_type, payload) and record, the bytes of the archive's record."""
    body = F.when(F.col("record_type") == "response", F.col("payload")).otherwise(F.lit(b""))
    return records.withColumn("record", F.concat(F.col("header").cast("binary"), body, F.lit(b"\r\n\r\n")))
