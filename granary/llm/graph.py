"""Connected components by minimum labels and pointer jumping."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from granary.llm.common import materialize


def components(edges: DataFrame) -> DataFrame:
    """id, label for every end of edges (a, b): label is the smallest id reachable.

    Each round takes the least label among the neighbours and follows it once; rounds grow with the logarithm of the
    diameter. Every round is a table in the shared folder. Joins on a large component's label are split by the planner.
    """
    both = materialize(edges.select("a", "b").unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b"))).filter("a <> b").distinct(), "edges")
    labels = materialize(both.groupBy(F.col("a").alias("id")).agg(F.min("b").alias("m")).select("id", F.least("id", "m").alias("label")), "labels")
    while True:
        near = both.join(labels.select(F.col("id").alias("b"), "label"), "b").groupBy(F.col("a").alias("id")).agg(F.min("label").alias("m"))
        least = labels.join(near, "id").select("id", F.col("label").alias("old"), F.least("label", "m").alias("label"))
        least = materialize(least, "labels")
        up = least.select(F.col("id").alias("label"), F.col("label").alias("up"))
        new = materialize(least.join(up, "label", "left").select("id", "old", F.least("label", F.coalesce("up", "label")).alias("label")), "labels")
        labels = new.select("id", "label")
        if new.filter("old <> label").isEmpty():
            return labels
