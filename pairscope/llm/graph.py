"""Connected components by the smallest label, with pointer jumping; nothing but counts reaches the driver."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pairscope.llm.common import drop_path, saved


def components(edges: DataFrame) -> DataFrame:
    """edges (a, b: of any type with an order) -> (node, root): every node of an edge with the smallest node it reaches."""
    both = edges.select("a", "b").union(edges.select("b", "a")).where("a <> b").distinct()
    both, both_path = saved(both, "edges")
    # the start already is one step of propagation
    labels, path = saved(both.groupBy("a").agg(F.min("b").alias("low")).select(F.col("a").alias("node"), F.least("a", "low").alias("root")), "labels")
    while True:
        near = both.join(labels, F.col("b") == F.col("node")).groupBy("a").agg(F.min("root").alias("low"))
        lower = labels.join(near, F.col("node") == F.col("a")).select("node", F.least("root", "low").alias("mid"), F.col("root").alias("old"))
        jump = labels.select(F.col("node").alias("mid"), F.col("root").alias("far"))
        moved = lower.join(jump, "mid", "left").select("node", F.least("mid", F.coalesce("far", "mid")).alias("root"), "old")
        moved, moved_path = saved(moved, "labels")
        drop_path(edges.sparkSession, path)
        labels, path = moved.select("node", "root"), moved_path
        if moved.where("root <> old").isEmpty():
            drop_path(edges.sparkSession, both_path)
            return labels
