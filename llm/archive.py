"""A content-addressed archive of web pages in WARC form.

Payload bytes lie once per content under their SHA-256; the exact header of every record lies in a table of its own.
Records are put together again by joining both, after each stored payload's digest has been computed anew.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from placemap.sources.storage import stored

#: Payloads below so many bytes are never replaced by a reference.
LEAST = 1000
VERSION = "WARC/1.1"
#: One time for all records, so that writing the same pages again gives the same archive.
DATE = "2024-01-01T00:00:00Z"
_PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"


def _identity(page_id) -> F.Column:
    return F.concat(F.lit("<urn:page:"), F.coalesce(page_id.cast("string"), F.lit("none")), F.lit(">"))


def write_archive(pages: DataFrame, folder: str, *, least: int = LEAST, date: str = DATE) -> None:
    """Write one record per row of pages (page_id, url, html) below ``folder``: tables ``headers`` and ``payloads``.

    The payload is html in UTF-8 (null: empty). Of records with equal payloads of at least ``least`` bytes, the one
    with the largest page_id is the response and the others are revisits that name it; all others are responses.
    Rows with the same payload and the same page_id are all responses; a row without page_id is a response only if
    no row with that payload has one. A null url leaves out the target line; line ends in a url become blanks. Other
    columns are not read. An empty table gives empty tables.

    Payloads are exchanged once, by digest, and of equal ones a task sends one. Groups of any size are reduced to
    their largest page_id in the same way.
    """
    bytes_ = F.encode(F.coalesce(F.col("html").cast("string"), F.lit("")), "UTF-8")
    rows = pages.select(F.col("page_id").cast("long").alias("page_id"), F.col("url").cast("string").alias("url"), bytes_.alias("payload"))
    rows = rows.withColumn("sha256", F.sha2("payload", 256)).withColumn("sha1", F.sha1("payload"))
    owners = rows.groupBy("sha256").agg(F.max("page_id").alias("owner"))
    light = rows.select("page_id", "url", "sha256", "sha1", F.length("payload").cast("long").alias("size")).join(owners, "sha256")
    revisit = (F.col("size") >= least) & ~F.col("page_id").eqNullSafe(F.col("owner"))
    eol = F.lit("\r\n")
    header = F.concat(
        F.lit(f"{VERSION}\r\nWARC-Type: "), F.when(revisit, "revisit").otherwise("response"), eol,
        F.lit("WARC-Record-ID: "), _identity(F.col("page_id")), eol,
        F.lit(f"WARC-Date: {date}\r\n"),
        F.coalesce(F.concat(F.lit("WARC-Target-URI: "), F.translate("url", "\r\n", "  "), eol), F.lit("")),
        F.lit("WARC-Payload-Digest: sha256:"), F.col("sha256"), eol,
        F.when(revisit, F.concat(F.lit("WARC-Refers-To: "), _identity(F.col("owner")), F.lit(f"\r\nWARC-Profile: {_PROFILE}\r\n"))).otherwise(F.lit("")),
        F.lit("Content-Type: text/html; charset=utf-8\r\nContent-Length: "), F.when(revisit, F.lit(0)).otherwise(F.col("size")).cast("string"), eol,
    )
    light.select(F.col("sha256").alias("digest"), header.alias("header")).write.mode("overwrite").parquet(f"{folder}/headers")
    # one row per content; each task passes on one row per content it has read
    once = rows.groupBy("sha256").agg(F.first("payload").alias("payload"))
    once.select(F.col("sha256").alias("digest"), "payload").write.mode("overwrite").parquet(f"{folder}/payloads")


def _field(name: str):
    found = F.regexp_extract("header", rf"(?md)^{name}: (.*?)\r?$", 1)  # d: only a line feed ends a line
    return F.when(found != "", found)


def _page(field):
    return F.regexp_extract(field, r"<urn:page:(-?\d+)>", 1).try_cast("long")


def _parsed(headers: DataFrame) -> DataFrame:
    """The table with page_id, record_type, refers_to and digest, as its ``header`` says."""
    return headers.withColumns({
        "page_id": _page(_field("WARC-Record-ID")), "record_type": _field("WARC-Type"), "refers_to": _page(_field("WARC-Refers-To")),
        "digest": F.regexp_replace(_field("WARC-Payload-Digest"), "^sha256:", ""),
    })


def records(spark: SparkSession, folder: str) -> DataFrame:
    """The bytes of each WARC record: header, empty line, block (empty for a revisit), two line ends.

    Only responses are joined with payloads. A payload that is missing, or whose digest is not the stored one, stops the job.
    """
    headers = _parsed(spark.read.parquet(f"{folder}/headers")).select("header", "digest", "record_type")
    payloads = spark.read.parquet(f"{folder}/payloads").withColumn("proven", F.sha2("payload", 256) == F.col("digest"))
    responses = headers.filter("record_type = 'response'").join(payloads, "digest", "left")
    said = F.concat(F.lit("payload missing or altered: sha256:"), F.coalesce("digest", F.lit("none")))
    block = F.when(F.col("proven"), F.col("payload")).otherwise(F.raise_error(said))
    revisits = headers.filter("record_type <> 'response'").select("header", F.lit(b"").alias("block"))
    whole = responses.select("header", block.alias("block")).unionByName(revisits)
    end = F.lit(b"\r\n")
    return whole.select(F.concat(F.encode("header", "UTF-8"), end, "block", end, end).alias("record"))


def read_records(rows: DataFrame) -> DataFrame:
    """page_id, record_type, refers_to, digest, header and block of each ``record``, from its bytes alone.

    The header ends at the first empty line. A block that is not as long as Content-Length says, or is not followed by
    two line ends, stops the job.
    """
    cut = rows.select("record", F.substring_index(F.col("record").cast("string"), "\r\n\r\n", 1).alias("header"))
    start, size = F.octet_length("header") + 4, F.octet_length("record") - F.octet_length("header") - 8
    whole = (_field("Content-Length").try_cast("long") == size) & (F.substring(F.col("record"), F.lit(-4), F.lit(4)) == F.lit(b"\r\n\r\n"))
    block = F.when(whole, F.substring(F.col("record"), start + 1, size)).otherwise(F.raise_error(F.concat(F.lit("not a whole record: "), F.col("header"))))
    return _parsed(cut.withColumn("block", block)).select("page_id", "record_type", "refers_to", "digest", "header", "block")


def read_archive(spark: SparkSession, folder: str) -> DataFrame:
    """page_id, payload_bytes, payload_digest (SHA-1), record_type and refers_to of every record, read from the rebuilt records.

    A revisit has its payload's length and digest from the response with the payload it names. An empty archive gives no rows.
    """
    block = F.col("block")
    found = read_records(records(spark, folder)).select(
        "page_id", "record_type", "refers_to", "digest", F.length(block).cast("long").alias("payload_bytes"), F.sha1(block).alias("payload_digest")
    )
    found = stored(found, "records")
    names = ("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")
    responses = found.filter("record_type = 'response'")
    full = responses.groupBy("digest").agg(F.first("payload_bytes").alias("payload_bytes"), F.first("payload_digest").alias("payload_digest"))
    revisits = found.filter("record_type <> 'response'").drop("payload_bytes", "payload_digest").join(full, "digest", "left")
    lost = F.raise_error(F.concat(F.lit("no response with the payload sha256:"), "digest"))
    revisits = revisits.withColumn("payload_bytes", F.coalesce("payload_bytes", lost.cast("long")))
    return responses.select(*names).unionByName(revisits.select(*names))
