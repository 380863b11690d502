r"""Content-addressed WARC archive.

Every page becomes a WARC/1.1 record.  The archive is two tables in a folder:
``headers`` keeps the exact header bytes of each record (the WARC header and,
for responses, the HTTP header) with the payload's address; ``payloads`` stores
each payload once under its SHA-256, with the number of slots that its records
are dealt over, so that the records of a hot payload meet it in many tasks.  Reading back verifies the address of
every stored payload and joins headers to payloads, which gives the original
records byte for byte.

Of the records with equal payloads of at least ``min_bytes`` bytes the one with
the smallest page_id is a ``response``, the others are ``revisit`` records that
refer to it; rows that share that smallest page_id are all responses, a null
page_id counts as larger than any other.  A null html is an empty payload; a
null url an empty target; line ends in a url are percent-encoded, as a header
line cannot hold them.  An empty table gives empty archives; further columns
are ignored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import join_counted, written

DATE = "2024-01-01T00:00:00Z"   # capture time written when the table has none
MIN_BYTES = 0                   # payloads from this size on have one response, and revisits
SLOT_ROWS = 256                 # records of one payload that share a join key (about)

# The header lines of the format.
CRLF = "\r\n"
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"


def base32(hexa: Column) -> Column:
    """Upper-case base32 of 40 hexadecimal digits: 5 of them give 4 base-32 digits, 8 times."""
    digits = [F.lpad(F.conv(F.substring(hexa, 5 * i + 1, 5), 16, 32), 4, "0") for i in range(8)]
    return F.translate(F.concat(*digits), "0123456789ABCDEFGHIJKLMNOPQRSTUV", "ABCDEFGHIJKLMNOPQRSTUVWXYZ234567")


def record_id(page_id: Column, address: Column, row: Column) -> Column:
    """URN of one row: rows that repeat page_id and payload have ids of their own."""
    name = F.concat_ws(":", F.lit("page"), F.coalesce(page_id.cast("string"), F.lit("null")), address, row.cast("string"))
    return F.concat(F.lit("<urn:uuid:"), F.regexp_replace(F.md5(name), "^(.{8})(.{4})(.{4})(.{4})(.{12})$", "$1-$2-$3-$4-$5"), F.lit(">"))


def _line(name: str, value: Column) -> Column:
    return F.concat(F.lit(name + ": "), value, F.lit(CRLF))


def _payloads(pages: DataFrame) -> DataFrame:
    """(page_id, url, payload, address) of every page."""
    payload = F.coalesce(F.col("html").cast("string"), F.lit("")).cast("binary")
    rows = pages.select(F.col("page_id").cast("long").alias("page_id"), F.col("url").cast("string").alias("url"), payload.alias("payload"))
    return rows.withColumn("address", F.sha2("payload", 256))


def _measured(pages: DataFrame) -> DataFrame:
    """(row, page_id, url, address, n_bytes, digest): one written row per page, numbered; no payload is kept."""
    rows = _payloads(pages).withColumn("sha1", F.sha1("payload"))
    return written(rows.select(F.monotonically_increasing_id().alias("row"), "page_id", "url", "address",
                               F.octet_length("payload").alias("n_bytes"), base32(F.col("sha1")).alias("digest")), "warc-rows")


def _responses(rows: DataFrame) -> DataFrame:
    """(address, first_id, first_row, n): per payload the row with the smallest page_id, and how many rows share it."""
    order = F.struct(F.col("page_id").isNull().alias("none"), "page_id", "row")
    firsts = rows.groupBy("address").agg(F.min(order).alias("first"), F.count("*").alias("n"))
    return written(firsts.select("address", F.col("first.page_id").alias("first_id"), F.col("first.row").alias("first_row"), "n"), "warc-firsts")


def build_headers(rows: DataFrame, firsts: DataFrame, min_bytes: int = MIN_BYTES, date: str = DATE) -> DataFrame:
    """(page_id, address, slot, header): one record head per row."""
    rows = join_counted(rows, firsts, ["address"], "n")
    is_response = (F.col("n_bytes") < min_bytes) | F.col("page_id").eqNullSafe(F.col("first_id"))
    rows = rows.withColumn("is_response", is_response)
    http = F.concat(F.lit("HTTP/1.1 200 OK" + CRLF + "Content-Type: text/html; charset=utf-8" + CRLF),
                    _line("Content-Length", F.col("n_bytes").cast("string")), F.lit(CRLF))
    uri = F.replace(F.replace(F.coalesce("url", F.lit("")), F.lit("\r"), F.lit("%0D")), F.lit("\n"), F.lit("%0A"))
    head = F.concat(
        F.lit("WARC/1.1" + CRLF), _line("WARC-Type", F.when(F.col("is_response"), "response").otherwise("revisit")),
        _line("WARC-Target-URI", uri), _line("WARC-Date", F.lit(date)),
        _line("WARC-Record-ID", record_id(F.col("page_id"), F.col("address"), F.col("row"))),
        F.coalesce(_line("X-Page-Id", F.col("page_id").cast("string")), F.lit("")),
        _line("WARC-Payload-Digest", F.concat(F.lit("sha1:"), "digest")))
    response = F.concat(head, _line("Content-Type", F.lit("application/http; msgtype=response")),
                        _line("Content-Length", (F.octet_length(http) + F.col("n_bytes")).cast("string")), F.lit(CRLF), http)
    revisit = F.concat(head, _line("WARC-Profile", F.lit(PROFILE)),
                       _line("WARC-Refers-To", record_id(F.col("first_id"), F.col("address"), F.col("first_row"))),
                       _line("X-Refers-To-Page-Id", F.col("first_id").cast("string")), _line("Content-Length", F.lit("0")), F.lit(CRLF))
    slot = F.pmod(F.xxhash64("row"), _slots()).cast("int")
    return rows.select("page_id", "address", slot.alias("slot"), F.when(F.col("is_response"), response).otherwise(revisit).alias("header"))


def _slots() -> Column:
    """Into how many parts the records of a payload are dealt."""
    return F.ceil(F.col("n") / SLOT_ROWS).cast("int")


def write_archive(pages: DataFrame, path: str, min_bytes: int = MIN_BYTES, date: str = DATE) -> None:
    """Write the two tables of the archive under ``path`` (a folder all executors share).

    Responses are found on digests alone; then every payload is shuffled once, by
    (address, page_id), so that copies of one payload go to different tasks, and
    the response's copy is stored.
    """
    rows = _measured(pages)
    firsts = _responses(rows)
    build_headers(rows, firsts, min_bytes, date).write.parquet(f"{path}/headers")
    holder = lambda c: F.coalesce(F.col(c).cast("string"), F.lit("null")).alias("holder")
    # rows that repeat page_id and payload are one before the shuffle
    held = _payloads(pages).select("address", holder("page_id"), "payload").groupBy("address", "holder").agg(F.first("payload").alias("payload"))
    chosen = firsts.select("address", holder("first_id"), _slots().alias("slots"))
    held.join(chosen, ["address", "holder"]).select("address", "slots", "payload").write.parquet(f"{path}/payloads")


def read_archive(spark: SparkSession, path: str) -> DataFrame:
    """(page_id, header, payload, payload_bytes, payload_digest): the original records, payloads of revisits included.

    Size and digest are taken from the stored payload, once per payload, and joined to
    its records; where only they are selected, no payload leaves its task.  Fails
    if a stored payload does not have the digest it is stored under, or if a
    header refers to a payload that is missing.
    """
    payloads = spark.read.schema("address string, slots int, payload binary").parquet(f"{path}/payloads")
    wrong = F.sha2("payload", 256) != F.col("address")
    payloads = payloads.select("address", "slots", F.when(wrong, F.raise_error(F.concat(
        F.lit("payload does not match its digest: "), F.col("address")))).otherwise(F.col("payload")).alias("payload"))
    payloads = payloads.select("*", F.octet_length("payload").cast("long").alias("payload_bytes"), F.sha1("payload").alias("sha1"))
    payloads = payloads.select("address", "payload", "payload_bytes", base32(F.col("sha1")).alias("payload_digest"),
                               F.explode(F.sequence(F.lit(0), F.col("slots") - 1)).alias("slot"))
    headers = spark.read.schema("page_id long, address string, slot int, header string").parquet(f"{path}/headers")
    found = headers.join(payloads, ["address", "slot"], "left")
    missing = F.raise_error(F.concat(F.lit("no payload stored for "), F.col("address")))
    return found.select("page_id", "header", F.coalesce("payload", missing.cast("binary")).alias("payload"),
                        F.coalesce("payload_bytes", missing.cast("long")).alias("payload_bytes"),
                        F.coalesce("payload_digest", missing.cast("string")).alias("payload_digest"))


def header_value(header: Column, name: str) -> Column:
    """Value of a WARC header line, null where it is absent."""
    value = F.regexp_extract(header, r"\n" + name + r": ([^\r\n]*)\r\n", 1)
    return F.when(F.contains(header, F.lit(CRLF + name + ": ")), value)


def export_warc(records: DataFrame, path: str) -> None:
    """Write records (header, payload) as WARC files: header, block and two line ends each; revisits have no block."""
    block = F.when(header_value(F.col("header"), "WARC-Type") == "response", F.col("payload").cast("string")).otherwise("")
    records.select(F.concat("header", block).alias("value")).write.option("lineSep", CRLF + CRLF).text(path)


def describe(records: DataFrame) -> DataFrame:
    """(page_id, payload_bytes, payload_digest, record_type, refers_to), read from the records.

    Fails if a payload does not have the SHA-1 its header states.
    """
    stated = F.substring(header_value(F.col("header"), "WARC-Payload-Digest"), 6, 32)
    rows = records.select(header_value(F.col("header"), "X-Page-Id").cast("long").alias("page_id"), "payload_bytes", "payload_digest",
                          stated.alias("stated"), header_value(F.col("header"), "WARC-Type").alias("record_type"),
                          header_value(F.col("header"), "X-Refers-To-Page-Id").cast("long").alias("refers_to"))
    checked = F.when(F.col("stated") == F.col("payload_digest"), F.col("payload_digest")).otherwise(
        F.raise_error(F.concat(F.lit("payload differs from its header's digest "), F.col("stated"))))
    return rows.select("page_id", "payload_bytes", checked.alias("payload_digest"), "record_type", "refers_to")


#: The query's rows in DuckDB SQL.
ORACLE = """
WITH p AS (SELECT page_id, coalesce(html, '') AS body FROM pages),
f AS (SELECT *, min(page_id) OVER (PARTITION BY body) AS first_id, sha1(body) AS hexa FROM p),
d AS (SELECT *, array_to_string(list_transform(list_transform(range(0, 8), lambda i: CAST('0x' || substr(hexa, 5 * i + 1, 5) AS INTEGER)),
        lambda x: substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567', x // 32768 + 1, 1) || substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567', x // 1024 % 32 + 1, 1)
          || substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567', x // 32 % 32 + 1, 1) || substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567', x % 32 + 1, 1)), '')
        AS payload_digest FROM f)
SELECT page_id, CAST(strlen(body) AS BIGINT) AS payload_bytes, payload_digest,
       CASE WHEN page_id IS NOT DISTINCT FROM first_id THEN 'response' ELSE 'revisit' END AS record_type,
       CASE WHEN page_id IS DISTINCT FROM first_id THEN first_id END AS refers_to
FROM d
"""
