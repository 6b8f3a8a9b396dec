"""Connected components."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import materialise
from .joins import join_counted


def components(edges: DataFrame) -> DataFrame:
    """(node, root) of all nodes that edges (src, dst) join; the root is the smallest node of the class.

    Large and small stars by turns: every node's larger neighbours, then its smaller ones with
    itself, are linked to the smallest in its neighbourhood, until nothing changes. A star of many
    leaves is an aggregation of its edges, not a list, and where its centre meets them again they are
    dealt over many tasks. Each round goes to the checkpoint folder. Edges with a null end and edges
    from a node to itself are left out; repeated edges count once; no edges give no rows."""
    current = materialise(edges.where("src <> dst").select(F.greatest("src", "dst").alias("src"), F.least("src", "dst").alias("dst")).distinct())
    while True:
        both = current.unionByName(current.select(F.col("dst").alias("src"), F.col("src").alias("dst")))
        least = both.groupBy("src").agg(F.min("dst").alias("m"), F.count(F.lit(1)).alias("n")).select("src", F.least("src", "m").alias("m"), "n")
        large = join_counted(both, least, "src", "n", F.col("dst")).where("dst > src").select(F.col("dst").alias("src"), F.col("m").alias("dst"))
        large = large.where("src <> dst").distinct()
        least = large.groupBy("src").agg(F.min("dst").alias("m"), F.count(F.lit(1)).alias("n"))
        small = join_counted(large, least, "src", "n", F.col("dst"))
        small = small.select("src", F.col("m").alias("dst")).unionByName(small.where("dst <> m").select(F.col("dst").alias("src"), F.col("m").alias("dst"))).distinct()
        following = materialise(small)
        changed = following.exceptAll(current).limit(1).count() or current.exceptAll(following).limit(1).count()
        current = following
        if not changed:
            return current.select(F.col("src").alias("node"), F.col("dst").alias("root"))
