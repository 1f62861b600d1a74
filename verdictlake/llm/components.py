"""Connected components of an edge table, by alternating large and small stars."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from verdictlake.llm.common import stable


def components(edges: DataFrame) -> DataFrame:
    """edges (a, b), long and not null, to (node, root): root is the smallest node that the node reaches.

    Nodes are those of edges with a <> b. Every round is a partial minimum and a join; rounds end when a round changes
    nothing. Edges and labels stay in tables.
    """
    near = stable(edges.where("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct(), "edges")
    mark = None
    while True:
        both = near.unionByName(near.select(F.col("b").alias("a"), F.col("a").alias("b")))
        low = both.groupBy("a").agg(F.min("b").alias("m")).select("a", F.least("a", "m").alias("m"))
        large = both.where("b > a").join(low, "a").select(F.col("b").alias("a"), F.col("m").alias("b"))
        large = stable(large.where("a <> b").distinct(), "edges-large")
        low = large.groupBy("a").agg(F.min("b").alias("m"))
        small = large.join(low, "a")
        small = small.select(F.col("b").alias("a"), F.col("m").alias("b")).unionByName(low.select("a", F.col("m").alias("b")))
        near = stable(small.where("a <> b").distinct(), "edges-small")
        now = near.agg(F.count("*"), F.sum(F.pmod(F.xxhash64("a", "b"), F.lit(1 << 40)))).first()
        if now == mark:
            break
        mark = now
    leaves = near.groupBy("a").agg(F.min("b").alias("root")).select(F.col("a").alias("node"), "root")
    return leaves.unionByName(leaves.select(F.col("root").alias("node"), "root").distinct())
