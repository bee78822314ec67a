"""Connected components of an edge table, without collecting it."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import stage_out


def _both(edges: DataFrame) -> DataFrame:
    return edges.select("u", "v").unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))


def _star(pairs: DataFrame, large: bool) -> DataFrame:
    """pairs (u, v): u's neighbours.  Links each neighbour above (large) or below u to the least of u's neighbourhood."""
    least = pairs.groupBy("u").agg(F.min("v").alias("m")).withColumn("m", F.least("u", "m"))
    far = pairs.where(F.col("v") > F.col("u")) if large else pairs.where(F.col("v") < F.col("u"))
    linked = far.join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v"))
    if not large:
        linked = linked.unionByName(least.select("u", F.col("m").alias("v")))
    return linked.where(F.col("u") != F.col("v")).distinct()


def components(edges: DataFrame, rounds: int = 100) -> DataFrame:
    """u, label: the least node of u's component, for every node that is not itself the least.

    edges: u, v of one orderable type; direction, repeats and loops don't matter.
    Alternates large and small stars; a round's edges are written to the shared
    folder, and the number of rounds grows with the logarithm of a component's
    diameter.  Nodes of any degree are handled by joins and sums, never gathered.
    """
    now = stage_out(edges.where(F.col("u") != F.col("v")).select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct(), "edges")
    sign = F.struct(F.count("*").alias("n"), F.bit_xor(F.xxhash64("u", "v")).alias("x"))
    before = now.agg(sign.alias("s")).first()["s"]
    for _ in range(rounds if before["n"] else 0):
        large = _star(_both(now), True)
        now = stage_out(_star(large.select("u", "v"), False), "edges")
        after = now.agg(sign.alias("s")).first()["s"]
        if after == before:
            break
        before = after
    return now.select("u", F.col("v").alias("label"))
