"""Content-addressed WARC archive.

Each distinct payload is stored once under its SHA-256; the exact header bytes of
each record stand in a table of their own; a join on the digest gives the original
records back, byte for byte.  Records are read again from these bytes: header, length and block.
Digests are computed again on what was read, so a damaged or wrongly addressed payload is found and
not handed on.

Cases: null html is an empty payload; equal payloads below ``least`` bytes are all
responses (but stored once); repeated rows of one id are records of their own with ids of
their own, and the largest id of a group is the response (all its rows are; revisits refer to the last
of them); a null id counts as smaller than any id; CR and LF in a url are percent-encoded in the header;
payloads of any length are handled whole; empty tables give empty archives; extra columns are ignored.
"""

from __future__ import annotations

import uuid
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .shared import named, shared_dir

CRLF = "\r\n"
#: WARC-Date of archives made from tables without a fetch time.
UNDATED = "1970-01-01T00:00:00Z"
REVISIT_PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"


@dataclass(frozen=True)
class Archive:
    """Two Parquet tables: ``payloads`` (address, payload) and ``headers`` (record_id, address, header)."""

    payloads: str
    headers: str


def records(pages: DataFrame, least: int = 1000, page_id: str = "page_id", url: str = "url", html: str = "html") -> DataFrame:
    """id, row (a number of each row), address (SHA-256), sha1, bytes, record_type, refers_to, refers_row, url of each row; payloads are not carried."""
    own = named(pages, id=page_id, url=url, html=html).select("id", "url", F.monotonically_increasing_id().alias("row"), F.encode(F.coalesce("html", F.lit("")), "UTF-8").alias("p"))
    own = own.select(F.col("id").cast("long").alias("id"), "url", "row", F.sha2("p", 256).alias("address"), F.sha1("p").alias("sha1"), F.octet_length("p").cast("long").alias("bytes"))
    last = own.where(F.col("bytes") >= least).groupBy("address").agg(F.max(F.struct("id", "row")).alias("last"), F.count(F.lit(1)).alias("n")).where("n > 1").select(F.col("address").alias("at"), "last")
    both = own.join(last, own.address == last.at, "left")
    revisit = F.col("at").isNotNull() & ~F.col("id").eqNullSafe(F.col("last.id"))
    return both.select("id", "row", "url", "address", "sha1", "bytes", F.when(revisit, "revisit").otherwise("response").alias("record_type"), F.when(revisit, F.col("last.id")).alias("refers_to"), F.when(revisit, F.col("last.row")).alias("refers_row"))


def header(r: DataFrame) -> DataFrame:
    """Adds the WARC/1.1 header block, up to and with its empty line."""
    uri = lambda c, row: F.concat(F.lit("<urn:page:"), F.coalesce(c.cast("string"), F.lit("null")), F.lit("/"), row.cast("string"), F.lit(">"))
    line = lambda name, value: F.concat(F.lit(f"{name}: "), value, F.lit(CRLF))
    safe = F.replace(F.replace(F.coalesce("url", F.lit("")), F.lit("\r"), F.lit("%0D")), F.lit("\n"), F.lit("%0A"))
    kept = F.col("record_type") == "response"
    text = F.concat(
        F.lit(f"WARC/1.1{CRLF}"),
        line("WARC-Type", F.col("record_type")),
        line("WARC-Record-ID", uri(F.col("id"), F.col("row"))),
        line("WARC-Date", F.lit(UNDATED)),
        line("WARC-Target-URI", safe),
        line("WARC-Payload-Digest", F.concat(F.lit("sha1:"), F.col("sha1"))),
        F.when(kept, F.lit("")).otherwise(F.concat(line("WARC-Refers-To", uri(F.col("refers_to"), F.col("refers_row"))), line("WARC-Profile", F.lit(REVISIT_PROFILE)))),
        line("Content-Type", F.lit("text/html; charset=utf-8")),
        line("Content-Length", F.when(kept, F.col("bytes")).otherwise(F.lit(0)).cast("string")),
        F.lit(CRLF),
    )
    return r.withColumn("header", F.encode(text, "UTF-8"))


def write_archive(pages: DataFrame, folder: str | None = None, least: int = 1000, page_id: str = "page_id", url: str = "url", html: str = "html") -> Archive:
    """Write both tables. Payload copies are dropped before the shuffle as well as after it."""
    folder = folder or f"{shared_dir(pages.sparkSession)}/warc-{uuid.uuid4().hex}"
    out = Archive(f"{folder}/payloads", f"{folder}/headers")
    header(records(pages, least, page_id, url, html)).select(F.col("id").alias("record_id"), "address", "header").write.option("compression", "zstd").parquet(out.headers)
    body = F.encode(F.coalesce(pages[html], F.lit("")), "UTF-8")
    one = pages.select(F.sha2(body, 256).alias("address"), body.alias("payload"))
    one.dropDuplicates(["address"]).write.option("compression", "zstd").parquet(out.payloads)
    return out


def read_archive(spark: SparkSession, archive: Archive) -> DataFrame:
    """One row per record: record_id, header, payload (full, of revisits too), record bytes, verified.

    ``record`` is the record as WARC/1.1 writes it: header, block (empty for a revisit), two line ends.
    """
    heads = spark.read.parquet(archive.headers)
    bodies = spark.read.parquet(archive.payloads).select(F.col("address").alias("at"), "payload", (F.sha2("payload", 256) == F.col("address")).alias("verified"))
    both = heads.join(bodies, heads.address == bodies.at, "left")
    block = F.when(F.contains(F.decode("header", "ISO-8859-1"), F.lit("\r\nWARC-Type: revisit\r\n")), F.lit(b"")).otherwise(F.col("payload"))
    return both.select("record_id", "header", "payload", F.concat("header", block, F.lit(b"\r\n\r\n")).alias("record"), F.coalesce("verified", F.lit(False)).alias("verified"))


def parse_records(read: DataFrame) -> DataFrame:
    """page_id, payload_bytes, payload_digest, record_type, refers_to from the records' bytes.

    Everything comes from ``record``; only a revisit, whose block is empty, has its payload from the
    join.  A record whose payload is absent, fails its address, or has not the digest that
    its header names raises, as does one whose block is not as long as its header says.
    """
    # the header ends before the first empty line; Latin-1 keeps one character a byte
    head = F.substring_index(F.decode("record", "ISO-8859-1"), "\r\n\r\n", 1)
    field = lambda name, value: F.regexp_extract(F.col("h"), f"\r\n{name}: {value}(?:\r\n|$)", 1)
    cut = read.select("payload", "verified", "record", head.alias("h"))
    cut = cut.select("payload", "verified", "record", "h", F.octet_length(F.encode("h", "ISO-8859-1")).alias("n"), field("Content-Length", "([0-9]+)").cast("int").alias("size"), field("WARC-Type", "([a-z]+)").alias("record_type"))
    whole = F.octet_length("record") == F.col("n") + F.col("size") + 8
    block = F.expr("substring(record, n + 5, size)")
    body = F.when(F.col("record_type") == "revisit", F.col("payload")).otherwise(block)
    sure = F.when(F.col("verified") & whole, body).otherwise(F.raise_error(F.lit("record or payload is not as its header and digest say")).cast("binary"))
    got = cut.select("h", "record_type", sure.alias("p")).select("h", "record_type", F.octet_length("p").cast("long").alias("payload_bytes"), F.sha1("p").alias("sha1"))
    named_digest = field("WARC-Payload-Digest", "sha1:([0-9a-f]+)")
    page = lambda name: F.expr(f"try_cast(regexp_extract(h, '\\r\\n{name}: <urn:page:(-?[0-9]+)/', 1) as bigint)")
    return got.select(
        page("WARC-Record-ID").alias("page_id"),
        "payload_bytes",
        F.when(F.col("sha1") == named_digest, F.col("sha1")).otherwise(F.raise_error(F.lit("payload has not the digest of its header"))).alias("payload_digest"),
        "record_type",
        page("WARC-Refers-To").alias("refers_to"),
    )
