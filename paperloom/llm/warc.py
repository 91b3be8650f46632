"""Content-addressed WARC archive.

An archive is two tables in one folder. ``payloads`` holds each different payload once, by its SHA-256.
``headers`` holds one row per record: the exact bytes of its WARC header and HTTP header, and the digest of
its payload. A record's original bytes come back by joining the two on the digest. Reading verifies: a
payload whose bytes don't give its digests, or a header without its payload, stops the read.

Equal payloads of at least ``min_revisit`` bytes are stored under the record with the largest page_id, the
response; the others are revisits that refer to it. Smaller ones are all responses.

Defined cases: a null html is an empty payload; a null url is written as an empty target; a null page_id
sorts below all others, and a record whose group has no other id is a response; of repeated rows with the
same id and payload each is a record, and all of the largest id are responses; a payload of any length, up to what
a binary cell holds (2 GB), is one cell; an empty table gives an empty archive; other columns are ignored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from paperloom.llm.common import work_dir

MIN_REVISIT = 1000
#: Fixed value: the date of all records, as pages carry none.
DATE = "2020-01-01T00:00:00Z"
REVISIT_PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
EOL = "\r\n"


def page_urn(page_id: Column) -> Column:
    """A record's id; a null page_id is written as the word null."""
    return F.concat(F.lit("<urn:page:"), F.coalesce(page_id.cast("string"), F.lit("null")), F.lit(">"))


def write_archive(pages: DataFrame, path: str, min_revisit: int = MIN_REVISIT) -> None:
    """Write pages(page_id, url, html) as an archive in the folder path."""
    rows = pages.select(
        "page_id", F.coalesce(F.col("url").cast("string"), F.lit("")).alias("url"), F.coalesce(F.col("html").cast("string"), F.lit("")).cast("binary").alias("payload")
    ).withColumns({"sha256": F.sha2("payload", 256), "sha1": F.sha1("payload"), "size": F.octet_length("payload").cast("long")})
    # first() of equal bytes: which row's copy is kept makes no difference, so partial results merge before the shuffle
    rows.groupBy("sha256").agg(F.first("payload").alias("payload"), F.first("sha1").alias("sha1"), F.first("size").alias("size")).write.mode("overwrite").parquet(f"{path}/payloads")
    heads = rows.drop("payload")
    chosen = heads.filter(F.col("size") >= min_revisit).groupBy("sha256").agg(F.max("page_id").alias("chosen"), F.count("*").alias("n"))
    # only groups of two or more have revisits
    heads = heads.join(chosen.filter("n > 1").drop("n"), "sha256", "left")
    revisit = F.col("chosen").isNotNull() & ~F.col("page_id").eqNullSafe(F.col("chosen"))
    http = F.concat(F.lit(f"HTTP/1.1 200 OK{EOL}Content-Type: text/html; charset=utf-8{EOL}Content-Length: "), F.col("size").cast("string"), F.lit(EOL + EOL))
    line = lambda name, value: F.concat(F.lit(f"{name}: "), value, F.lit(EOL))
    heads = heads.select(
        "page_id", "sha256",
        F.when(revisit, F.lit("revisit")).otherwise(F.lit("response")).alias("record_type"),
        F.when(revisit, F.col("chosen")).alias("refers_to"), "url", "sha1", "size", http.alias("http"),
    ).withColumn(
        "warc",
        F.concat(
            F.lit("WARC/1.1" + EOL),
            line("WARC-Type", F.col("record_type")),
            line("WARC-Record-ID", page_urn(F.col("page_id"))),
            line("WARC-Date", F.lit(DATE)),
            # a target must stay on one line
            line("WARC-Target-URI", F.regexp_replace("url", r"[\x00-\x20\x7f]", "%20")),
            line("WARC-Payload-Digest", F.concat(F.lit("sha1:"), F.col("sha1"))),
            F.when(F.col("record_type") == "revisit", F.concat(line("WARC-Profile", F.lit(REVISIT_PROFILE)), line("WARC-Refers-To", page_urn(F.col("refers_to"))))).otherwise(F.lit("")),
            line("Content-Type", F.lit("application/http; msgtype=response")),
            line("Content-Length", (F.octet_length("http") + F.when(F.col("record_type") == "revisit", F.lit(0)).otherwise(F.col("size"))).cast("string")),
            F.lit(EOL),
        ),
    )
    heads.select("page_id", "sha256", F.concat(F.col("warc"), F.col("http")).cast("binary").alias("header")).write.mode("overwrite").parquet(f"{path}/headers")


def read_payloads(spark: SparkSession, path: str) -> DataFrame:
    """sha256, payload and size of each stored payload. Stops if the bytes don't give the digest."""
    stored = spark.read.parquet(f"{path}/payloads")
    bad = F.raise_error(F.concat(F.lit("damaged payload "), F.col("sha256")))
    return stored.select("sha256", F.when(F.sha2("payload", 256) == F.col("sha256"), F.col("payload")).otherwise(bad.cast("binary")).alias("payload"))


def field(header: Column, name: str) -> Column:
    """A WARC header field's value, or null."""
    found = F.regexp_extract(header, rf"(?m)^{name}: ([^\r\n]*)$", 1)
    return F.when(found != "", found)


def read_records(spark: SparkSession, path: str) -> DataFrame:
    """One row per record (an id that was no integer is null): page_id, record_type, refers_to, payload, the digest its header names, and record, its original bytes.

    The headers, which may share a payload by thousands, meet each payload once in a shuffled join; adaptive
    execution splits a digest that holds many headers.
    """
    heads = spark.read.parquet(f"{path}/headers").withColumn("head", F.col("header").cast("string"))
    joined = heads.join(read_payloads(spark, path), "sha256", "left")
    missing = F.raise_error(F.concat(F.lit("no payload "), F.col("sha256"))).cast("binary")
    kind = field(F.col("head"), "WARC-Type")
    number = lambda name: F.regexp_extract(F.coalesce(field(F.col("head"), name), F.lit("")), r"^<urn:page:(-?[0-9]+)>$", 1)
    as_id = lambda text: F.when(text != "", text.cast("long"))
    end = F.lit(EOL + EOL).cast("binary")
    return joined.select(
        as_id(number("WARC-Record-ID")).alias("page_id"), kind.alias("record_type"), as_id(number("WARC-Refers-To")).alias("refers_to"),
        F.regexp_extract("head", r"(?m)^WARC-Payload-Digest: sha1:([0-9a-f]{40})$", 1).alias("header_digest"),
        F.coalesce(F.col("payload"), missing).alias("payload"),
        F.concat(F.col("header"), F.when(kind == "response", F.col("payload")).otherwise(F.lit("").cast("binary")), end).alias("record"),
    )


def record_digests(records: DataFrame) -> DataFrame:
    """page_id, payload_bytes, payload_digest, record_type, refers_to, record_bytes and record_sha1; stops where header and payload disagree."""
    bad = F.raise_error(F.concat(F.lit("header and payload differ in page "), F.coalesce(F.col("page_id").cast("string"), F.lit("null")))).cast("string")
    digest = F.sha1("payload")
    return records.select(
        "page_id", F.octet_length("payload").cast("long").alias("payload_bytes"),
        F.when(digest == F.col("header_digest"), digest).otherwise(bad).alias("payload_digest"), "record_type", "refers_to",
        F.octet_length("record").cast("long").alias("record_bytes"), F.sha1("record").alias("record_sha1"),
    )


def warc_round_trip(pages: DataFrame) -> DataFrame:
    """Write an archive to the shared work folder and read it back."""
    path = work_dir(pages.sparkSession, "warc")
    write_archive(pages, path)
    return record_digests(read_records(pages.sparkSession, path))
