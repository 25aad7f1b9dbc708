"""A content-addressed WARC archive: payloads stored once under a strong digest, exact record headers beside them.

``headers`` holds one row per record: the header block, byte for byte, and the SHA-256 of the payload that belongs to it. ``payloads``
holds each different payload once. A record is the header block, then, for a response, the payload that the join by digest finds,
then two line ends. Reading checks every payload against its digest and its length against the header.
"""

from __future__ import annotations

from datetime import datetime, timezone

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from pricetrail.operators.joins import spread_lookup

#: RFC 4648 base 32 alphabet beside the digits that conv() writes. Fixed values.
_CONV, _BASE32 = "0123456789ABCDEFGHIJKLMNOPQRSTUV", "ABCDEFGHIJKLMNOPQRSTUVWXYZ234567"
END = "\r\n\r\n"


def base32_sha1(payload: Column) -> Column:
    """Bare upper-case base32 SHA-1, as WARC writes digests: 5 bytes become 8 digits, four times."""
    digest = F.sha1(payload)
    part = lambda k: F.lpad(F.upper(F.conv(F.substring(digest, 10 * k + 1, 10), 16, 32)), 8, "0")
    return F.translate(F.concat(*[part(k) for k in range(4)]), _CONV, _BASE32)


def record_id(key: Column) -> Column:
    return F.concat(F.lit("<urn:page:"), F.coalesce(key.cast("string"), F.lit("none")), F.lit(">"))


def _header(date: str) -> Column:
    line = lambda name, value: F.concat(F.lit(f"{name}: "), value, F.lit("\r\n"))
    uri = F.replace(F.replace("url", F.lit("\r"), F.lit("%0D")), F.lit("\n"), F.lit("%0A"))
    revisit = F.col("record_type") == "revisit"
    return F.concat(
        F.lit("WARC/1.1\r\n"), line("WARC-Type", F.col("record_type")), line("WARC-Record-ID", record_id(F.col("key"))),
        line("WARC-Date", F.lit(date)),
        F.coalesce(line("WARC-Target-URI", uri), F.lit("")),
        F.when(revisit, F.concat(
            F.lit("WARC-Profile: http://netpreserve.org/warc/1.1/revisit/identical-payload-digest\r\n"),
            line("WARC-Refers-To", record_id(F.col("refers_to"))))).otherwise(""),
        line("WARC-Payload-Digest", F.concat(F.lit("sha1:"), F.col("sha1"))), line("Content-Type", F.lit("text/html")),
        line("Content-Length", F.when(revisit, F.lit(0)).otherwise(F.col("size")).cast("string")), F.lit("\r\n"))


def write_archive(
    pages: DataFrame, folder: str, least_bytes: int = 0, key: str = "page_id", url: str = "url", html: str = "html", date: str | None = None
) -> None:
    """Write a record per row of ``pages`` below ``folder``, dated ``date`` (as 2024-05-01T00:00:00Z; the time of writing by default).

    The payload is the html in UTF-8; null is an empty payload. Among records with equal payloads of at least ``least_bytes`` bytes, the
    one with the largest key is the response and the others revisit it; repeated rows that tie for the largest key are responses
    alike, and if no such record has a key, all are responses. Line ends in a URL are written as %0D and %0A; a null URL leaves
    its line out. Rows that share a key, and rows without one, share a record id. Other columns are ignored; an empty table makes an
    archive without records. A payload is shuffled at most once for each task that holds it; headers are narrow.
    """
    date = date or datetime.now(timezone.utc).strftime("%Y-%m-%dT%H:%M:%SZ")
    rows = pages.select(
        F.col(key).cast("long").alias("key"), F.col(url).cast("string").alias("url"), F.encode(F.coalesce(F.col(html).cast("string"), F.lit("")), "UTF-8").alias("payload"))
    rows = rows.withColumn("sha256", F.sha2("payload", 256))
    rows.groupBy("sha256").agg(F.first("payload").alias("payload")).write.parquet(f"{folder}/payloads")
    narrow = rows.select("key", "url", "sha256", F.length("payload").cast("long").alias("size"), base32_sha1(F.col("payload")).alias("sha1"))
    heads = narrow.filter(F.col("size") >= least_bytes).groupBy("sha256").agg(F.max("key").alias("head"))
    records = spread_lookup(narrow, heads, ["sha256"], "url")
    again = F.coalesce(F.col("head").isNotNull() & ~F.col("key").eqNullSafe(F.col("head")), F.lit(False))
    records = records.withColumn("record_type", F.when(again, "revisit").otherwise("response")).withColumn("refers_to", F.when(again, F.col("head")))
    records.select("sha256", F.encode(_header(date), "UTF-8").alias("header")).write.parquet(f"{folder}/headers")


def _field(header: Column, name: str) -> Column:
    found = F.regexp_extract(header, f"\r\n{name}: ([^\r\n]*)\r\n", 1)
    return F.when(found != "", found)


def _page(uri: Column) -> Column:
    return F.regexp_extract(uri, "^<urn:page:(-?[0-9]+)>$", 1).try_cast("long")


def read_archive(spark: SparkSession, folder: str) -> DataFrame:
    """page_id, record_type, refers_to, url, payload_bytes, payload_digest, sound, payload, record (the exact bytes) per record.

    All but the payload's own facts is read from the header. ``sound`` says that the payload has the digests it is stored under
    and written with, and that a response's Content-Length is its length. The payload of a revisit is that of the response.
    """
    payloads = spark.read.parquet(f"{folder}/payloads")
    payloads = payloads.select(
        "sha256", "payload", F.length("payload").cast("long").alias("payload_bytes"), base32_sha1(F.col("payload")).alias("payload_digest"),
        (F.sha2("payload", 256) == F.col("sha256")).alias("verified"))
    headers = spark.read.parquet(f"{folder}/headers").withColumn("text", F.decode("header", "UTF-8"))
    both = spread_lookup(headers, payloads, ["sha256"], "header")
    text = F.col("text")
    kind = _field(text, "WARC-Type")
    length = F.when(kind == "revisit", 0).otherwise(F.col("payload_bytes"))
    sound = (F.col("verified") & (F.concat(F.lit("sha1:"), F.col("payload_digest")) == _field(text, "WARC-Payload-Digest"))
             & (length == _field(text, "Content-Length").cast("long")))
    body = F.when(kind == "revisit", F.lit(b"")).otherwise(F.col("payload"))
    return both.select(
        _page(_field(text, "WARC-Record-ID")).alias("page_id"), kind.alias("record_type"), _page(_field(text, "WARC-Refers-To")).alias("refers_to"),
        _field(text, "WARC-Target-URI").alias("url"), "payload_bytes", "payload_digest", F.coalesce(sound, F.lit(False)).alias("sound"),
        "payload", F.concat(F.col("header"), body, F.encode(F.lit(END), "UTF-8")).alias("record"))

