"""Connected components of an undirected graph given as an edge table."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from loopgrade.functions.session import cut


def connected_components(edges: DataFrame, src: str = "src", dst: str = "dst", max_rounds: int = 100) -> DataFrame:
    """``(node, comp)`` for every node that has an edge; ``comp`` is the smallest node reachable.

    Each round takes the smallest label among the neighbours and then follows the label's own label
    (pointer jumping), so long chains shrink geometrically. Both joins are plain equi-joins that AQE
    can split on a hot hub, the minimum is combined before its shuffle, and every round is
    checkpointed to the shared folder. Null ends and self loops are ignored; an empty edge table
    gives an empty result.
    """
    e = edges.select(F.col(src).alias("a"), F.col(dst).alias("b")).where("a is not null and b is not null and a <> b")
    both = F.explode(F.array(F.struct("a", "b"), F.struct(F.col("b").alias("a"), F.col("a").alias("b")))).alias("x")  # the edges are computed once
    e = cut(e.select(both).select("x.a", "x.b").distinct())
    labels = cut(e.groupBy("a").agg(F.min("b").alias("b")).select(F.col("a").alias("node"), F.least("a", "b").alias("comp")))
    for _ in range(max_rounds):
        near = e.join(labels.withColumnRenamed("node", "b"), "b").groupBy(F.col("a").alias("node")).agg(F.min("comp").alias("near"))
        low = labels.join(near, "node").select("node", F.least("comp", "near").alias("low"), F.col("comp").alias("old"))
        jump = labels.select(F.col("node").alias("low"), F.col("comp").alias("far"))
        step = cut(low.join(jump, "low").select("node", F.least("low", "far").alias("comp"), "old"))
        moved = step.where("comp <> old").limit(1).count()
        labels = step.select("node", "comp")
        if not moved:
            return labels
    raise RuntimeError(f"components did not settle in {max_rounds} rounds")
