"""Connected components of a link table by alternating stars, as DataFrame rounds."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def components(edges: DataFrame) -> DataFrame:
    """(node, root) for the nodes of undirected ``edges`` (u, v), u != v: root is the
    smallest node of the component.

    Each round hangs the neighbours of every node on the smallest of them (first the larger
    neighbours, then the smaller); rounds grow with the logarithm of the component.  Each
    table is written to the checkpoint folder; minima are pre-aggregated and joined back, and
    no node's links are gathered in one place (a hub's rows in a join on ``u`` are split by Spark's
    skew join).  The rounds end when a round changes no row.
    """
    e = (edges.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).where("u <> v")
         .distinct().checkpoint())
    n = e.count()
    while n:
        both = e.unionByName(e.select(F.col("v").alias("u"), F.col("u").alias("v"))).checkpoint()
        low = both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m")).checkpoint()
        large = (both.join(low, "u").where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v"))
                 .where("u <> v").distinct().checkpoint())
        low = large.groupBy("u").agg(F.min("v").alias("m")).checkpoint()
        small = (large.join(low, "u").where("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v"))
                 .unionByName(low.select("u", F.col("m").alias("v"))).distinct().checkpoint())
        # both tables are distinct: of one size, and none new, they are equal
        m = small.count()
        same = m == n and small.join(e, ["u", "v"], "left_anti").isEmpty()
        e, n = small, m
        if same:
            break
    return (e.select(F.col("u").alias("node"), F.col("v").alias("root"))
            .unionByName(e.select(F.col("v").alias("node"), F.col("v").alias("root")).distinct()))
