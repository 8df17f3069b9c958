"""A content-addressed WARC archive: payload bytes once, record headers apart, records by join.

Method: an archive is a folder of two Parquet tables. ``payloads`` holds each distinct payload
once under its SHA-256 address; ``records`` holds, per record, the exact bytes of its WARC
header and the address of its payload. Payloads are grouped by their bytes, not by the digest
alone, and two payloads under one address stop the write. Of records with equal payloads the
one with the largest id is the response, the others are revisits that refer to it.

Reading joins the two tables, checks every payload against its address and its header (length
and SHA-1), and returns header and payload of the original records; fields are parsed from the
header bytes. All of it is DataFrame code. Copies are folded before the shuffle and the joins
on addresses can be split, so one payload may belong to any share of the records.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

BASE32 = "ABCDEFGHIJKLMNOPQRSTUVWXYZ234567"
DIGITS = "0123456789ABCDEFGHIJKLMNOPQRSTUV"  # what conv() writes in base 32
CRLF = "\r\n"
RECORD_URN = "urn:page:"
REVISIT_PROFILE = "http://netpreservecommons.org/warc/1.0/revisit/identical-payload-digest"  # fixed value
DATE = "1970-01-01T00:00:00Z"


def base32_sha1(payload: Column) -> Column:
    """Bare upper-case base32 of the SHA-1: five hex digits become four base32 digits."""
    digest = F.sha1(payload)
    parts = [F.lpad(F.conv(F.substring(digest, 1 + 5 * i, 5), 16, 32), 4, "0") for i in range(8)]
    return F.translate(F.concat(*parts), DIGITS, BASE32)


def _line(name: str, value: Column) -> Column:
    """A header line; nothing for a null value. Line ends inside a value are percent-encoded."""
    safe = F.replace(F.replace(value, F.lit("\r"), F.lit("%0D")), F.lit("\n"), F.lit("%0A"))
    return F.coalesce(F.concat(F.lit(name + ": "), safe, F.lit(CRLF)), F.lit(""))


def _urn(id_column: Column) -> Column:
    return F.concat(F.lit(f"<{RECORD_URN}"), F.coalesce(id_column.cast("string"), F.lit("none")), F.lit(">"))


def _header(row_id: Column, url: Column, kind: Column, size: Column, sha1: Column, response: Column) -> Column:
    revisit = kind == "revisit"
    return F.encode(F.concat(
        F.lit("WARC/1.0" + CRLF),
        _line("WARC-Type", kind),
        _line("WARC-Record-ID", _urn(row_id)),
        _line("WARC-Date", F.lit(DATE)),
        _line("WARC-Target-URI", url),
        _line("WARC-Payload-Digest", F.concat(F.lit("sha1:"), sha1)),
        _line("WARC-Refers-To", F.when(revisit, _urn(response))),
        _line("WARC-Profile", F.when(revisit, F.lit(REVISIT_PROFILE))),
        _line("Content-Type", F.lit("text/html; charset=UTF-8")),
        _line("Content-Length", F.when(revisit, F.lit(0)).otherwise(size).cast("string")),
        _line("X-Payload-Length", size.cast("string")),
        F.lit(CRLF),
    ), "UTF-8")


def write_archive(
    pages: DataFrame, folder: str, *, id_col: str = "page_id", url_col: str = "url", payload_col: str = "html",
    min_bytes: int = 0,
) -> None:
    """Write one record per row of ``pages`` to a new archive at ``folder``.

    A null payload is empty. Payloads shorter than ``min_bytes`` are all responses. A row
    without an id is a revisit where an equal payload has an id, else a response; repeated
    rows of the responding id are all responses. An empty table writes two empty tables.
    Other columns are not read.
    """
    rows = pages.select(
        F.col(id_col).cast("long").alias("page_id"), F.col(url_col).cast("string").alias("url"),
        F.encode(F.coalesce(F.col(payload_col).cast("string"), F.lit("")), "UTF-8").alias("payload"),
    ).withColumn("address", F.sha2("payload", 256))
    (
        rows.groupBy("address", "payload").agg(F.max("page_id").alias("response_id"), F.count("*").alias("n_records"))
        .withColumn("sha1", base32_sha1(F.col("payload"))).withColumn("n_bytes", F.octet_length("payload").cast("long"))
        .write.parquet(f"{folder}/payloads")
    )
    stored = pages.sparkSession.read.parquet(f"{folder}/payloads").drop("payload")
    taken_twice = stored.groupBy("address").count().filter("count > 1")
    if not taken_twice.isEmpty():
        raise ValueError(f"different payloads under one address: {taken_twice.first()['address']}")
    first = (F.col("n_bytes") < min_bytes) | F.col("page_id").eqNullSafe(F.col("response_id"))
    (
        rows.drop("payload").join(stored, "address")
        .withColumn("kind", F.when(first, "response").otherwise("revisit"))
        .select(
            "address",
            _header(F.col("page_id"), F.col("url"), F.col("kind"), F.col("n_bytes"), F.col("sha1"), F.col("response_id")).alias("header"),
        )
        .write.parquet(f"{folder}/records")
    )


def _field(name: str) -> Column:
    """A header field's value, or null."""
    found = F.regexp_extract(F.decode("header", "UTF-8"), rf"\r\n{name}: ([^\r\n]*)\r\n", 1)
    return F.when(found != "", found)


def _id_in(name: str) -> Column:
    return F.regexp_extract(_field(name), f"<{RECORD_URN}(-?[0-9]+)>", 1).try_cast("long")


def read_archive(spark: SparkSession, folder: str) -> DataFrame:
    """One row per record: page_id, url, record_type, payload_bytes, payload_digest, refers_to, header, payload.

    ``payload`` is the full payload, of revisits too. A payload that does not match its
    address, or a header whose digest or length differs from the payload, is an error.
    """
    sound = F.col("address") == F.sha2("payload", 256)
    payloads = spark.read.parquet(f"{folder}/payloads").select(
        "address",
        F.when(sound, F.col("payload")).otherwise(F.raise_error(F.concat(F.lit("damaged payload "), "address"))).alias("payload"),
    ).withColumn("actual", base32_sha1(F.col("payload")))
    records = spark.read.parquet(f"{folder}/records")
    full = records.join(payloads, "address").withColumn("payload_bytes", F.octet_length("payload").cast("long"))
    agrees = (_field("WARC-Payload-Digest") == F.concat(F.lit("sha1:"), "actual")) & (
        _field("X-Payload-Length") == F.col("payload_bytes").cast("string")
    )
    return full.select(
        _id_in("WARC-Record-ID").alias("page_id"), _field("WARC-Target-URI").alias("url"),
        _field("WARC-Type").alias("record_type"), "payload_bytes",
        F.when(agrees, F.col("actual")).otherwise(F.raise_error(F.lit("header and payload differ"))).alias("payload_digest"),
        _id_in("WARC-Refers-To").alias("refers_to"), "header", "payload",
    )


def record_bytes(records: DataFrame) -> DataFrame:
    """``(page_id, record)``: the bytes of each record as they stand in a WARC file."""
    body = F.when(F.col("record_type") == "response", F.col("payload")).otherwise(F.encode(F.lit(""), "UTF-8"))
    end = F.encode(F.lit(CRLF + CRLF), "UTF-8")
    return records.select("page_id", F.concat("header", body, end).alias("record"))


def write_warc_files(records: DataFrame, folder: str) -> None:
    """Write records as plain .warc text parts; the record end is the writer's line separator."""
    text = F.decode(F.col("record"), "UTF-8")
    whole = record_bytes(records).select(F.substring(text, F.lit(1), F.length(text) - 4).alias("value"))
    whole.write.option("lineSep", CRLF + CRLF).text(folder)
