"""A content-addressed web archive.

Two tables: ``payloads`` holds each distinct payload once under its SHA-256, ``records`` holds the exact header bytes of
every record with the digest of its payload. A record's original bytes are the header and, for a
response, the payload, found again by a join on the digest. Reading checks every stored payload against its
key, so a damaged file or a digest that does not belong stops the read.

All in DataFrame functions. The only wide steps are an aggregation of digests (pre-aggregated, so a payload that a
third of the pages share is no hot key), one join on (digest, id) that picks the payload to store, and the join on
reading, an equi-join that adaptive execution splits where one digest is frequent.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

_HEX32, _RFC32 = "0123456789ABCDEFGHIJKLMNOPQRSTUV", "ABCDEFGHIJKLMNOPQRSTUVWXYZ234567"
_CRLF = "\r\n"
#: The format's name for a revisit whose payload is that of an earlier record.
_SAME_PAYLOAD = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"


def base32_sha1(payload: Column) -> Column:
    """Upper-case base32 of the SHA-1: 40 hex digits are four groups of 40 bits, eight base-32 digits each."""
    digest = F.sha1(payload)
    groups = [F.lpad(F.conv(F.substring(digest, 1 + 10 * i, 10), 16, 32), 8, "0") for i in range(4)]
    return F.translate(F.concat(*groups), _HEX32, _RFC32)


def write_archive(
    pages: DataFrame,
    folder: str,
    id_col: str = "page_id",
    url: str = "url",
    html: str = "html",
    min_bytes: int = 0,
    date: str | None = None,
) -> None:
    """Write one record per row of ``pages`` below ``folder``.

    Of records whose payloads are equal and have at least ``min_bytes`` bytes, the one with the largest id is
    the response and the others are revisits that name it; smaller payloads are all responses. Null html is an empty
    payload, a null url an empty target; line ends in a url are percent-encoded. A null id sorts below all others and is
    written as an empty record id; rows that repeat the largest id are all responses. An empty table gives an empty archive;
    a payload may be as long as a row of Spark can be. Other columns take no part, whatever their names. ``date`` is the
    time of capture (a timestamp column's name; by default the time of writing, one for the archive).
    """
    moment = F.current_timestamp() if date is None else F.coalesce(F.col(f"`{date}`"), F.current_timestamp())
    named = pages.select(
        F.col(f"`{id_col}`").cast("long").alias("id"),
        F.coalesce(F.col(f"`{url}`"), F.lit("")).alias("uri"),
        F.date_format(F.to_utc_timestamp(moment, F.current_timezone()), "yyyy-MM-dd'T'HH:mm:ss'Z'").alias("date"),
        F.encode(F.coalesce(F.col(f"`{html}`"), F.lit("")), "UTF-8").alias("payload"),
    ).withColumn("key", F.sha2("payload", 256))
    newest = named.groupBy("key").agg(F.max("id").alias("newest"))
    facts = named.select(
        "id", "uri", "date", "key", base32_sha1(F.col("payload")).alias("sha1"), F.octet_length("payload").alias("size")
    )
    placed = facts.join(newest, "key").withColumn(
        "refers", F.when((F.col("size") >= min_bytes) & ~F.col("id").eqNullSafe(F.col("newest")), F.col("newest"))
    )
    lines = [
        F.lit("WARC/1.1"),
        F.concat(F.lit("WARC-Type: "), F.when(F.col("refers").isNull(), "response").otherwise("revisit")),
        F.concat(F.lit("WARC-Record-ID: <urn:page:"), F.coalesce(F.col("id").cast("string"), F.lit("")), F.lit(">")),
        F.concat(F.lit("WARC-Date: "), "date"),
        F.concat(F.lit("WARC-Target-URI: "), F.replace(F.replace("uri", F.lit("\r"), F.lit("%0D")), F.lit("\n"), F.lit("%0A"))),
        F.concat(F.lit("WARC-Payload-Digest: sha1:"), F.col("sha1")),
        F.when(F.col("refers").isNotNull(), F.concat(F.lit("WARC-Refers-To: <urn:page:"), "refers", F.lit(">"))),
        F.when(F.col("refers").isNotNull(), F.lit(f"WARC-Profile: {_SAME_PAYLOAD}")),
        F.concat(
            F.lit("Content-Length: "), F.when(F.col("refers").isNull(), F.col("size")).otherwise(F.lit(0)).cast("string")
        ),
    ]
    header = F.encode(F.concat(F.concat_ws(_CRLF, *lines), F.lit(_CRLF * 2)), "UTF-8")
    placed.select(header.alias("header"), "key").write.mode("overwrite").parquet(f"{folder}/records")
    lowest = F.lit(-(1 << 63))
    kept = named.select("key", F.coalesce("id", lowest).alias("rank"), "payload").join(
        newest.select("key", F.coalesce("newest", lowest).alias("rank")), ["key", "rank"]
    )
    # rows that repeat an id hold the same bytes under a key, so any one of them will do
    once = kept.dropDuplicates(["key", "rank"])
    once.select("key", "payload").write.mode("overwrite").parquet(f"{folder}/payloads")


def read_archive(spark: SparkSession, folder: str) -> DataFrame:
    """Every record again: ``header`` and ``block`` (its exact bytes) and the full ``payload`` behind it."""
    payloads = spark.read.parquet(f"{folder}/payloads").select(
        F.when(F.sha2("payload", 256) == F.col("key"), F.col("payload"))
        .otherwise(F.raise_error(F.concat(F.lit("payload does not match its digest "), "key")))
        .alias("payload"),
        "key",
    )
    records = spark.read.parquet(f"{folder}/records").join(payloads, "key")
    kind = F.regexp_extract(F.decode("header", "UTF-8"), r"\r\nWARC-Type: (\w+)", 1)
    body = F.when(kind == "response", F.col("payload")).otherwise(F.lit(b""))
    return records.select("header", F.concat("header", body, F.lit(b"\r\n\r\n")).alias("block"), "payload")


def parse_records(records: DataFrame) -> DataFrame:
    """Fields of the rebuilt records, read from ``block`` alone; a revisit's payload is the one joined to it.

    The payload's length and SHA-1 must be those that its header states, else the read stops.
    """
    # a cast takes the bytes as they are: the body need not be UTF-8
    head = F.substring_index(F.col("block").cast("string"), _CRLF * 2, 1)

    def field(name: str, value: str) -> Column:
        return F.nullif(F.regexp_extract("head", rf"\r\n{name}: {value}\r\n", 1), F.lit(""))

    length = field("Content-Length", r"(\d+)").cast("int")
    body = F.substring(F.col("block"), F.octet_length("head") + 3, length)
    ends = F.octet_length("block") == F.octet_length("head") + 2 + length + 4
    fields = records.select("block", F.concat(head, F.lit(_CRLF)).alias("head"), "payload").select(
        field("WARC-Record-ID", r"<urn:page:(-?\d*)>").cast("long").alias("page_id"),
        F.when(field("WARC-Type", r"(\w+)") == "response", F.when(ends, body)).otherwise(F.col("payload")).alias("payload"),
        field("WARC-Payload-Digest", r"sha1:(\w+)").alias("stated"),
        field("WARC-Type", r"(\w+)").alias("record_type"),
        field("WARC-Refers-To", r"<urn:page:(-?\d+)>").cast("long").alias("refers_to"),
    )
    return fields.select(
        "page_id",
        F.octet_length("payload").cast("long").alias("payload_bytes"),
        F.when(base32_sha1(F.col("payload")) == F.col("stated"), F.col("stated"))
        .otherwise(F.raise_error(F.lit("payload does not match its header")))
        .alias("payload_digest"),
        "record_type",
        "refers_to",
    )
