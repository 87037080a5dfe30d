"""WARC archive addressed by content.

An archive has two tables. ``payloads`` holds the bytes of every distinct payload once,
under their SHA-256. ``headers`` holds, for every record, its exact WARC header and the
key of its payload. Reading joins the two again, after the bytes under each key have been
checked against it, so a record that only refers to another one still has its payload.

Of records with equal payloads of ``REVISIT_BYTES`` or more, that with the largest id is
the response; the others are revisits that refer to it.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from replipulse.llm.common import pick, written

REVISIT_BYTES = 1000
DATE = "2024-01-01T00:00:00Z"
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
END = "\r\n"
_ID = "urn:page:"
_LEAST = -(2**63)


def _line(name: str, value: Column) -> Column:
    """A header line, or nothing for a null value. Line ends in a value become %0D and %0A."""
    clean = F.replace(F.replace(value, F.lit("\r"), F.lit("%0D")), F.lit("\n"), F.lit("%0A"))
    return F.coalesce(F.concat(F.lit(f"{name}: "), clean, F.lit(END)), F.lit(""))


def _urn(record_id: Column) -> Column:
    return F.concat(F.lit(f"<{_ID}"), F.coalesce(record_id.cast("string"), F.lit("")), F.lit(">"))


def _header() -> Column:
    """The header of a record, up to and with the empty line."""
    revisit = F.col("record_type") == "revisit"
    return F.encode(
        F.concat(
            F.lit(f"WARC/1.1{END}"),
            _line("WARC-Type", F.col("record_type")),
            _line("WARC-Record-ID", _urn(F.col("id"))),
            _line("WARC-Date", F.lit(DATE)),
            _line("WARC-Target-URI", F.col("url")),
            _line("WARC-Payload-Digest", F.concat(F.lit("sha1:"), F.col("sha1"))),
            _line("WARC-Refers-To", F.when(revisit, _urn(F.col("refers_to")))),
            _line("WARC-Profile", F.when(revisit, F.lit(PROFILE))),
            _line("Content-Type", F.lit("text/html; charset=utf-8")),
            _line("Content-Length", F.when(revisit, F.lit("0")).otherwise(F.col("size").cast("string"))),
            F.lit(END),
        ),
        "UTF-8",
    )


def write_archive(
    pages: DataFrame,
    folder: str,
    id_col: str = "page_id",
    url_col: str = "url",
    html_col: str = "html",
    revisit_bytes: int = REVISIT_BYTES,
) -> None:
    """Write a record per row.

    Null html is an empty payload, a null url leaves its header line out. Rows that repeat
    an id and its payload are records each, of one type; of rows with equal payloads, a
    null id comes before all others. An empty table gives an empty archive. Columns other
    than those named are not read.
    """
    rows = pick(pages, id=id_col, url=url_col, html=html_col).select(
        "id", "url", F.encode(F.coalesce("html", F.lit("")), "UTF-8").alias("payload")
    )
    place = F.coalesce(F.col("id").cast("long"), F.lit(_LEAST))
    keyed = rows.select("*", F.sha2("payload", 256).alias("key"), place.alias("place"))
    narrow = keyed.select("id", "url", "key", "place", F.sha1("payload").alias("sha1"), F.octet_length("payload").alias("size"))
    # Combines before the shuffle: a payload that a third of all pages share is a row per task.
    owners = written(keyed.groupBy("key").agg(F.max("place").alias("owner")), "warc-owners")
    # Stored: both sides of the join are plain, so Spark splits the records of a frequent payload.
    decided = narrow.join(owners, "key")
    revisit = (F.col("size") >= revisit_bytes) & (F.col("place") != F.col("owner"))
    records = decided.select(
        "id",
        "url",
        "key",
        "sha1",
        "size",
        F.when(revisit, "revisit").otherwise("response").alias("record_type"),
        F.when(revisit, F.col("owner")).alias("refers_to"),
    )
    _write(records.select("key", _header().alias("header")), f"{folder}/headers")
    # The bytes move once, by key and id, which no payload shares with many pages.
    stored = keyed.select("key", "place", "payload").join(
        owners.withColumnRenamed("owner", "place"), ["key", "place"], "left_semi"
    )
    _write(stored.dropDuplicates(["key", "place"]).select("key", "payload"), f"{folder}/payloads")


def _write(df: DataFrame, path: str) -> None:
    df.write.option("compression", "zstd").parquet(path)


def _field(header: Column, name: str) -> Column:
    found = F.regexp_extract(header, rf"\r\n{name}: ([^\r\n]*)\r\n", 1)
    return F.when(found != "", found)


def _id_in(value: Column) -> Column:
    return F.regexp_extract(value, rf"^<{_ID}(-?\d+)>$", 1).try_cast("long")


def read_headers(spark: SparkSession, folder: str) -> DataFrame:
    """``id``, ``record_type``, ``refers_to``, ``url``, ``key`` and the exact ``header`` of every record."""
    rows = spark.read.schema("key string, header binary").parquet(f"{folder}/headers")
    text = F.decode("header", "UTF-8")
    return rows.select(
        _id_in(_field(text, "WARC-Record-ID")).alias("id"),
        _field(text, "WARC-Type").alias("record_type"),
        _id_in(_field(text, "WARC-Refers-To")).alias("refers_to"),
        _field(text, "WARC-Target-URI").alias("url"),
        "key",
        "header",
    )


def read_payloads(spark: SparkSession, folder: str) -> DataFrame:
    """``key`` and ``payload``; bytes that do not have their digest are an error."""
    rows = spark.read.schema("key string, payload binary").parquet(f"{folder}/payloads")
    wrong = F.raise_error(F.concat(F.lit("payload does not match its digest "), F.col("key")))
    checked = F.when(F.sha2("payload", 256) == F.col("key"), F.col("payload")).otherwise(wrong.cast("binary"))
    return rows.select("key", checked.alias("payload"))


def read_records(spark: SparkSession, folder: str) -> DataFrame:
    """Records as they were: header, payload, and ``record``, the bytes of the WARC record.

    A revisit has no payload in its record bytes, but keeps it in ``payload``.
    """
    joined = read_headers(spark, folder).join(read_payloads(spark, folder), "key")
    block = F.when(F.col("record_type") == "revisit", F.lit(b"")).otherwise(F.col("payload"))
    return joined.withColumn("record", F.concat("header", block, F.lit(b"\r\n\r\n")))


def export(records: DataFrame, path: str) -> None:
    """Write records as WARC files; two line ends stand after each record."""
    text = F.decode("record", "UTF-8")
    whole = F.left(text, F.length(text) - 4)
    records.select(whole.alias("value")).write.option("lineSep", "\r\n\r\n").text(path)


def inventory(spark: SparkSession, folder: str) -> DataFrame:
    """What the archive says of every record: size and SHA-1 of its checked payload, type, reference."""
    sized = read_payloads(spark, folder).select(
        "key", F.octet_length("payload").cast("long").alias("payload_bytes"), F.sha1("payload").alias("payload_digest")
    )
    headers = read_headers(spark, folder).select("id", "key", "record_type", "refers_to")
    return headers.join(sized, "key").select("id", "payload_bytes", "payload_digest", "record_type", "refers_to")
