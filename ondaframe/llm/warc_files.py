"""WARC files as DataFrames: records in, records out.

Files are read with the text source, records being its lines: the blank line
that ends a record and the version line of the next are the separator, so
that plain files are split like any text and nothing is parsed outside
expressions.  Compressed files are read whole by a task each.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

_END = "\r\n\r\n"


def _header_map(head: Column) -> Column:
    """name: value lines as a map by lower-case name; values of a repeated name are joined by commas."""
    lines = F.filter(F.split(head, "\r\n"), lambda x: x.contains(":"))
    pairs = F.transform(lines, lambda x: F.struct(F.lower(F.trim(F.substring_index(x, ":", 1))).alias("k"), F.trim(x.substr(F.instr(x, ":") + 1, F.length(x))).alias("v")))
    names = F.array_distinct(F.transform(pairs, lambda p: p["k"]))
    return F.map_from_arrays(names, F.transform(names, lambda n: F.array_join(F.transform(F.filter(pairs, lambda p: p["k"] == n), lambda p: p["v"]), ", ")))


def read(spark: SparkSession, path: str) -> DataFrame:
    """Response and revisit records: record_id, kind, url, ts (seconds), status, etag, last_modified, headers, digest, payload, whole.

    Fields that a record lacks are null.  whole: the block has the length that
    the record states; a block that itself holds a record's border is cut there
    and not whole.  Other kinds of record are left out.
    """
    raw = spark.read.text(path, lineSep=_END + "WARC/").where(F.length("value") > 0)
    value = F.col("value")
    cut = raw.select(F.substring_index(value, _END, 1).alias("head"), value.cast("binary").alias("b"), value)
    cut = cut.withColumn("w", _header_map(F.col("head"))).withColumn("size", F.try_to_number(F.col("w")["content-length"], F.lit("999999999999")).cast("int"))
    at = F.octet_length("head") + 5
    cut = cut.where(F.col("w")["warc-type"].isin("response", "revisit")).withColumn("block", F.substring("b", at, F.greatest(F.coalesce("size", F.lit(0)), F.lit(0))))
    http = F.substring_index(F.col("block").cast("string"), _END, 1)
    cut = cut.withColumn("http", http).withColumn("h", _header_map(F.col("http")))
    w, h = F.col("w"), F.col("h")
    return cut.select(
        w["warc-record-id"].alias("record_id"), w["warc-type"].alias("kind"), F.regexp_replace(w["warc-target-uri"], "^<|>$", "").alias("url"),
        F.try_to_timestamp(F.regexp_replace(w["warc-date"], "T", " ")).cast("bigint").alias("ts"), F.regexp_extract("http", r"^HTTP/\S+ (\d{3})", 1).try_cast("int").alias("status"),
        h["etag"].alias("etag"), h["last-modified"].alias("last_modified"), h.alias("headers"), w["warc-payload-digest"].alias("digest"),
        F.substring("block", F.octet_length("http") + 5, F.col("size")).alias("payload"), (F.octet_length("block") == F.col("size")).alias("whole"),
    )


def lines(records: DataFrame) -> DataFrame:
    """value: a record as text that write() ends.  Null fields are left out; a null payload is empty."""
    name = lambda n, c: F.when(F.col(c).isNotNull(), F.concat(F.lit(n + ": "), F.col(c).cast("string")))
    heads = F.transform(F.array_sort(F.map_entries(F.coalesce("headers", F.create_map().cast("map<string,string>")))), lambda e: F.concat(e["key"], F.lit(": "), e["value"]))
    start = F.concat(F.lit("HTTP/1.1 "), F.coalesce(F.col("status").cast("string"), F.lit("200")), F.lit(" -"))
    block = F.concat(F.array_join(F.concat(F.array(start), heads), "\r\n"), F.lit(_END), F.coalesce(F.col("payload"), F.lit(b"")).cast("string"))
    date = F.date_format(F.timestamp_seconds("ts"), "yyyy-MM-dd'T'HH:mm:ss'Z'")
    of = records.withColumn("_b", block).withColumn("_d", date).withColumn("_n", F.octet_length("_b"))
    head = F.array_compact(F.array(F.lit("WARC/1.1"), name("WARC-Type", "kind"), name("WARC-Record-ID", "record_id"), name("WARC-Target-URI", "url"), name("WARC-Date", "_d"), name("WARC-Payload-Digest", "digest"), F.lit("Content-Type: application/http"), name("Content-Length", "_n")))
    return of.select(F.concat(F.array_join(head, "\r\n"), F.lit(_END), "_b").alias("value"))


def write(records: DataFrame, path: str) -> None:
    """Write records, as read() has them, as WARC files in the folder."""
    lines(records).write.text(path, lineSep=_END)
