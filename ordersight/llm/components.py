"""Connected components of a distributed edge table, by alternating large and small stars.

Every round joins each node's neighbours to the smallest label it sees; both
the minimum (pre-aggregated) and the join back are ordinary shuffles, a node
with very many neighbours is split by adaptive skew joins, and nothing is
gathered on the driver but one count and one checksum a round. Rounds are
written to the shared checkpoint folder, so a lost executor repeats one round.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import materialize


def _stars(edges: DataFrame) -> DataFrame:
    """One large-star and one small-star step over distinct edges ``u > v``."""
    both = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
    least = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
    large = (both.where("v > u").join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v"))
             .where("u > v").distinct())
    low = large.groupBy("u").agg(F.min("v").alias("m"))
    small = (large.join(low, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u > v")
             .unionByName(low.select("u", F.col("m").alias("v"))))
    return small.distinct()


def components(edges: DataFrame) -> DataFrame:
    """``(node, component)`` of every node of ``edges (a, b)``; the component is its smallest node.

    Null ends and loops are left out; a table without edges gives no rows.
    """
    e = materialize(edges.where("a is not null and b is not null and a <> b")
                    .select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).distinct(), "edges")
    seen = None
    while True:
        mark = e.agg(F.count("*"), F.coalesce(F.sum(F.xxhash64("u", "v").cast("decimal(38,0)")), F.lit(0))).collect()[0]
        if mark == seen or not mark[0]:
            break
        seen = mark
        e = materialize(_stars(e), "stars")
    return (e.select(F.col("u").alias("node"), F.col("v").alias("component"))
            .unionByName(e.select(F.col("v").alias("node"), F.col("v").alias("component"))).distinct())
