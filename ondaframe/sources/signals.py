"""Signals as DataFrames: sampled streams, framed blocks, spectra and bytes over the driver's tables."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

FULL_SCALE = 32768.0


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def to_pcm16(value: Column, scale: float) -> Column:
    """16-bit sample: half-even rounding, saturated."""
    return F.least(F.lit(32767.0), F.greatest(F.lit(-32768.0), F.rint(value * scale))).cast("int")


def numbered(df: DataFrame, stream: str, order: str, bucket_width: int = 1 << 16) -> DataFrame:
    """Adds n: the row's 0-based place in its stream by `order` (an integral column, unique in its stream).

    Counts of (stream, bucket of order) are summed first, so that a stream of
    any length is numbered by many tasks: no window holds a whole stream.
    """
    cut = df.withColumn("_b", F.floor(F.col(order) / bucket_width))
    counts = cut.groupBy(stream, "_b").agg(F.count("*").alias("_c"))
    before = Window.partitionBy(stream).orderBy("_b").rowsBetween(Window.unboundedPreceding, -1)
    base = counts.select(stream, "_b", F.coalesce(F.sum("_c").over(before), F.lit(0)).alias("_base"))
    inside = F.row_number().over(Window.partitionBy(stream, "_b").orderBy(order)) - 1
    return cut.withColumn("_i", inside).join(base, [stream, "_b"]).withColumn("n", (F.col("_base") + F.col("_i")).cast("bigint")).drop("_b", "_i", "_base")


def pcm(spark: SparkSession, sf_dir: str) -> DataFrame:
    """stream, n, s: one stream of 16-bit samples per event type."""
    events = table(spark, sf_dir, "events").select(F.col("event_type").alias("stream"), "event_id", to_pcm16(F.col("value"), 64.0).alias("s"))
    return numbered(events, "stream", "event_id").select("stream", "n", "s")


def frames(samples: DataFrame, size: int, scale: float = 1.0) -> DataFrame:
    """stream, f, x array<double>: complete frames of `size` samples over `scale`; an incomplete tail is dropped."""
    cut = samples.groupBy("stream", F.floor(F.col("n") / size).alias("f")).agg(F.array_sort(F.collect_list(F.struct("n", "s"))).alias("r"))
    return cut.where(F.size("r") == size).select("stream", "f", F.transform("r", lambda r: r["s"] / F.lit(scale)).alias("x"))


def with_previous(framed: DataFrame, size: int) -> DataFrame:
    """Adds p: the samples of the frame before (zeros where there is none).

    Each frame is sent to its own and the next number, so that a stream is
    split by frame; no window holds a whole stream.
    """
    none = F.lit(None).cast("array<double>")
    sent = framed.select("stream", "f", "x", none.alias("p")).unionByName(framed.select("stream", (F.col("f") + 1).alias("f"), none.alias("x"), F.col("x").alias("p")))
    met = sent.groupBy("stream", "f").agg(F.first("x", ignorenulls=True).alias("x"), F.first("p", ignorenulls=True).alias("p"))
    return met.where(F.col("x").isNotNull()).withColumn("p", F.coalesce("p", F.array_repeat(F.lit(0.0), size)))


def spectra(spark: SparkSession, sf_dir: str) -> DataFrame:
    """vec_id, x array<double>: each embedding as 64 spectral lines."""
    return table(spark, sf_dir, "embeddings").select("vec_id", F.col("embedding").cast("array<double>").alias("x"))


def long_form(df: DataFrame, column: str, at: str = "i", value: str = "v") -> DataFrame:
    """One row per array element."""
    keep = [c for c in df.columns if c != column]
    return df.select(*keep, F.posexplode(column).alias(at, value))


#: The same relations for the SQL side.
PCM_SQL = "pcm as (select event_type as stream, row_number() over (partition by event_type order by event_id) - 1 as n, cast(least(32767.0, greatest(-32768.0, round_even(value * 64, 0))) as integer) as s from events)"


def frames_sql(size: int, scale: float = 1.0) -> str:
    """CTEs pcm and fr(stream, f, i, x)."""
    return f"{PCM_SQL}, fr as (select stream, n // {size} as f, n % {size} as i, s / cast({scale} as double) as x from pcm qualify count(*) over (partition by stream, n // {size}) = {size})"


SPEC_SQL = "sp as (select vec_id, unnest(range(64)) as k, cast(unnest(embedding) as double) as x from embeddings)"
