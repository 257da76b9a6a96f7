"""WARC as a content-addressed archive: each payload stored once under its digest, record headers
apart, original records rebuilt by joins."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tallyframe.llm.common import let

#: The alphabet of base32.
BASE32 = "ABCDEFGHIJKLMNOPQRSTUVWXYZ234567"
CRLF = "\r\n"


def base32_sha1(data: Column) -> Column:
    """Bare upper-case base32 of the SHA-1: each 5 hex digits give 4 letters."""
    letters = F.lit(BASE32)

    def encoded(digest):
        parts = []
        for at in range(0, 40, 5):
            value = F.conv(F.substring(digest, at + 1, 5), 16, 10).cast("int")
            parts += [F.substr(letters, F.shiftright(value, 15 - 5 * k).bitwiseAND(31) + 1,
                               F.lit(1)) for k in range(4)]
        return F.concat(*parts)
    return let(F.sha1(data), encoded)


def _payload() -> Column:
    return F.coalesce(F.col("html").cast("string"), F.lit("")).cast("binary")


def _urn(page_id: Column) -> Column:
    return F.concat(F.lit("<urn:page:"), F.coalesce(page_id.cast("string"), F.lit("none")),
                    F.lit(">"))


def _headers(lines: list[tuple[str, Column]]) -> Column:
    """A header block; lines whose value is null are left out."""
    pairs = [F.concat(F.lit(f"{name}: "), value.cast("string"), F.lit(CRLF))
             for name, value in lines]
    return F.concat(F.lit("WARC/1.1" + CRLF), F.concat_ws("", *pairs))


def write_archive(pages: DataFrame, path: str, min_bytes: int = 0) -> None:
    """Write one WARC record per row of ``pages`` (``page_id, url, html``) below ``path``.

    ``payloads`` holds each distinct payload once, under its SHA-256; ``headers`` holds the exact
    header block of every record with that key. Of the records with equal payloads of at least
    ``min_bytes`` bytes, the one with the largest ``page_id`` is the response and the others
    revisit it; smaller payloads are all responses.

    Copies of a payload combine inside each task before the one shuffle that payloads take; headers
    are joined by digest without payloads, so a payload that a third of all records share costs a
    row a task.

    * Null ``html``: the empty payload. Null ``url``: no target line; line ends in it are escaped.
    * Null ``page_id``: smaller than every id; its record is named ``none``.
    * Repeated rows and ties: one record each; of several with the largest id, one is the response.
    * Empty table: an empty archive. Other columns are ignored, whatever they are called.
    """
    rows = pages.select(F.col("page_id").cast("long"), F.col("url").cast("string").alias("url"),
                        _payload().alias("payload"))
    keyed = rows.withColumn("key", F.sha2("payload", 256))
    keyed.groupBy("key").agg(F.first("payload").alias("payload")).write.parquet(f"{path}/payloads")

    facts = keyed.select("page_id", "url", "key", base32_sha1(F.col("payload")).alias("digest"),
                         F.length("payload").cast("long").alias("size"))
    facts = facts.groupBy(*facts.columns).agg(F.count("*").alias("copies"))
    # Among repeated rows the first copy of the smallest url is the response.
    last = facts.groupBy("key").agg(F.max(F.struct(
        F.col("page_id").isNotNull().alias("known"), "page_id")).alias("last"))
    heads = facts.join(last, "key").where(F.col("page_id").eqNullSafe(F.col("last.page_id")))
    heads = heads.groupBy("key", "page_id").agg(F.min(F.struct(
        F.col("url").isNotNull().alias("known"), "url")).alias("head")).select(
        "key", F.col("page_id").alias("head_id"), F.col("head.url").alias("head_url"))
    records = facts.join(heads, "key").withColumn(
        "copy", F.explode(F.sequence(F.lit(1), F.col("copies").cast("int"))))
    first = F.col("page_id").eqNullSafe(F.col("head_id")) & F.col("url").eqNullSafe(
        F.col("head_url")) & (F.col("copy") == 1)
    revisit = ~(first | (F.col("size") < min_bytes))
    block = _headers([
        ("WARC-Type", F.when(revisit, "revisit").otherwise("response")),
        ("WARC-Record-ID", _urn(F.col("page_id"))),
        ("WARC-Target-URI", F.replace(F.replace("url", F.lit("\r"), F.lit("%0D")),
                                      F.lit("\n"), F.lit("%0A"))),
        ("WARC-Payload-Digest", F.concat(F.lit("sha1:"), F.col("digest"))),
        ("WARC-Refers-To", F.when(revisit, _urn(F.col("head_id")))),
        ("WARC-Profile", F.when(revisit, F.lit(
            "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"))),
        ("Content-Length", F.when(revisit, F.lit(0)).otherwise(F.col("size"))),
    ])
    records.select("key", block.alias("header")).write.parquet(f"{path}/headers")


def read_payloads(spark: SparkSession, path: str) -> DataFrame:
    """``key, payload, size, sha1`` of the stored payloads. The SHA-256 of every payload that is
    read is computed again; a payload that does not match its key stops the job."""
    rows = spark.read.schema("key string, payload binary").parquet(f"{path}/payloads")
    sound = F.when(F.sha2("payload", 256) == F.col("key"), F.col("key")).otherwise(
        F.raise_error(F.concat(F.lit("damaged payload "), "key")))
    return rows.select(sound.alias("key"), "payload",
                       F.length("payload").cast("long").alias("size"),
                       base32_sha1(F.col("payload")).alias("sha1"))


def _field(name: str) -> Column:
    found = F.regexp_extract("header", rf"(?md)^{name}: (.*)\r$", 1)
    return F.when(found != "", found)


def read_archive(spark: SparkSession, path: str) -> DataFrame:
    """The records of an archive: ``page_id, url, record_type, refers_to, payload_digest,
    payload_bytes``, the full ``payload``, and ``record``, the bytes of the WARC record as they
    would stand in a file. Everything but the payload is parsed from the header blocks; a stated
    digest that differs from the payload's stops the job.

    Digests are computed where the payloads are read, before the join, so a reader that does not
    select ``payload`` or ``record`` shuffles no payload.
    """
    headers = spark.read.schema("key string, header string").parquet(f"{path}/headers")
    number = lambda name: F.regexp_extract(
        "header", rf"(?md)^{name}: <urn:page:(-?\d+)>\r$", 1)
    as_id = lambda name: F.when(number(name) != "", number(name)).cast("long")
    records = headers.join(read_payloads(spark, path), "key")
    digest = F.when(_field("WARC-Payload-Digest") == F.concat(F.lit("sha1:"), "sha1"),
                    F.col("sha1")).otherwise(F.raise_error(F.lit("digest differs")))
    kind = _field("WARC-Type")
    body = F.when(kind == "response", F.col("payload")).otherwise(F.lit(b""))
    end = F.lit((CRLF * 2).encode())
    return records.select(
        as_id("WARC-Record-ID").alias("page_id"), _field("WARC-Target-URI").alias("url"),
        F.col("size").alias("payload_bytes"), digest.alias("payload_digest"),
        kind.alias("record_type"), as_id("WARC-Refers-To").alias("refers_to"), "payload",
        F.concat(F.col("header").cast("binary"), F.lit(CRLF.encode()), body, end).alias("record"))


SQL = f"""
WITH hashed AS (
  SELECT page_id, coalesce(html, '') AS body FROM pages),
keyed AS (
  SELECT page_id, octet_length(encode(body)) AS payload_bytes, sha1(body) AS hex FROM hashed),
coded AS (
  SELECT page_id, CAST(payload_bytes AS BIGINT) AS payload_bytes,
         array_to_string(list_transform(range(32), lambda k: substr('{BASE32}', CAST(
           ((('0x' || substr(hex, CAST(k // 4 * 5 + 1 AS BIGINT), 5))::BIGINT
             >> CAST(15 - 5 * (k % 4) AS INTEGER)) & 31) + 1 AS BIGINT), 1)), '')
           AS payload_digest FROM keyed),
heads AS (SELECT payload_digest, max(page_id) AS head FROM coded GROUP BY 1)
SELECT page_id, payload_bytes, payload_digest,
       CASE WHEN page_id = head THEN 'response' ELSE 'revisit' END AS record_type,
       CASE WHEN page_id <> head THEN head END AS refers_to
FROM coded JOIN heads USING (payload_digest)
"""
