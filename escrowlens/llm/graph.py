"""Connected components of a table of links, as DataFrame rounds."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from escrowlens.llm.common import staged


def _state(links: DataFrame) -> tuple:
    r = links.agg(F.count(F.lit(1)).alias("n"),
                  F.sum(F.pmod(F.xxhash64("a", "b"), F.lit(1 << 31))).alias("s")).first()
    return r["n"], r["s"]


def components(links: DataFrame) -> DataFrame:
    """(id, root) for every id of ``links`` (a, b): root is the smallest id that
    can be reached.  Ids without links are absent.

    Alternates two steps until nothing changes: every node hands its larger
    neighbours to its smallest one, then every node hands its smaller
    neighbours and itself to the smallest.  Each step is an aggregate and a
    join; a node with very many neighbours is aggregated map-side and its rows
    can be split by the adaptive skew join.  Only a count and a checksum per
    round come to the driver.
    """
    now = staged(links.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b"))
                 .filter("a <> b").distinct(), "links")
    seen = _state(now)
    while seen[0]:
        both = now.unionByName(now.select(F.col("b").alias("a"), F.col("a").alias("b")))
        low = both.groupBy("a").agg(F.min("b").alias("_m")).withColumn("_m", F.least("a", "_m"))
        large = (both.filter("b > a").join(low, "a")
                 .select(F.col("b").alias("a"), F.col("_m").alias("b")).distinct())
        low = large.groupBy("a").agg(F.min("b").alias("_m"))
        small = large.join(low, "a")
        step = (small.select(F.col("b").alias("a"), F.col("_m").alias("b")).filter("a <> b")
                .unionByName(low.select("a", F.col("_m").alias("b"))).distinct())
        now = staged(step, "links")
        if (state := _state(now)) == seen:
            break
        seen = state
    ids = now.select(F.col("a").alias("id"), F.col("b").alias("root"))
    return ids.unionByName(now.select(F.col("b").alias("id"), F.col("b").alias("root")).distinct())
