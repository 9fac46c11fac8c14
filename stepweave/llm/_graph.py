"""Connected components with joins and aggregations, checkpointed round by round."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import _base


def connected_components(edges: DataFrame, a: str = "a", b: str = "b") -> DataFrame:
    """(key, root) for every end of an edge; root is the smallest key of its component.

    In each round all that share a label take the smallest label among their
    neighbours, and that label's own, so labels that can still change halve at
    least and the rounds grow with the logarithm of their number. Joins know how
    many rows a key or a label has, so that none gathers in one task.
    """
    pairs = edges.select(F.col(a).alias("a"), F.col(b).alias("b")).where("a <> b")
    with _base.without_constraints(edges.sparkSession):
        both = _base.checkpoint(pairs.unionByName(pairs.select(F.col("b").alias("a"), F.col("a").alias("b"))).distinct())
        labels = _base.checkpoint(both.groupBy("a").agg(F.min("b").alias("n"), F.count("*").alias("degree")).select(F.col("a").alias("key"), F.least("a", "n").alias("root"), "degree"))
        while True:
            side = labels.select(F.col("key").alias("b"), "root", "degree")
            near = _base.spread_join(both, side, ["b"], "degree").groupBy("a").agg(F.min("root").alias("near"))
            step = _base.checkpoint(labels.join(near.withColumnRenamed("a", "key"), "key").select("key", "degree", F.col("root").alias("old"), F.least("root", "near").alias("new")))
            best = step.groupBy("old").agg(F.min("new").alias("best"), F.count("*").alias("n"))
            onward = best.select(F.col("old").alias("best"), F.col("best").alias("onward"))
            jump = _base.checkpoint(best.join(onward, "best", "left").select("old", F.least("best", F.coalesce("onward", "best")).alias("root"), "n"))
            labels = _base.checkpoint(_base.spread_join(step.drop("new"), jump, ["old"], "n").select("key", "degree", "old", "root"))
            if labels.where("old <> root").isEmpty():
                return labels.select("key", "root")
            labels = labels.drop("old")
