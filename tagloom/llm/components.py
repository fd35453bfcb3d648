"""Connected components of an edge table: every node takes the smallest id it can reach."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tagloom.llm.base import stored


def components(edges: DataFrame, files: int | None = None) -> DataFrame:
    """(k, label) for each node of the edges (a, b): the smallest node it is connected with.

    Each round takes the smallest label of the neighbours and then that label's label, so long chains shrink
    quickly. Labels live in stored tables of at most so many ``files``, never on the driver; the number of those that
    changed ends the loop.
    """
    both = stored(edges.select("a", "b").union(edges.select("b", "a")).distinct(), "edges", files)
    labels = stored(both.groupBy(F.col("a").alias("k")).agg(F.least(F.min("b"), F.first("a")).alias("label")), "labels", files)
    while True:
        near = both.join(labels, F.col("b") == F.col("k")).groupBy("a").agg(F.min("label").alias("near"))
        low = labels.join(near, F.col("k") == F.col("a"), "left").select("k", "label", F.least("label", "near").alias("low"))
        jump = labels.select(F.col("k").alias("at"), F.col("label").alias("far"))
        new = stored(low.join(jump, F.col("low") == F.col("at"), "left").select("k", F.least("low", "far").alias("label"), (F.least("low", "far") < F.col("label")).alias("changed")), "labels", files)
        labels = new.select("k", "label")
        if new.filter("changed").isEmpty():
            return labels
