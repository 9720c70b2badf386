"""Connected components of a distributed edge table, by label propagation with pointer jumping.

Each round a vertex takes the smallest label among its neighbours and then the
label of its label. Minima are combined before each shuffle, labels are
written once a round, and joins have one row per vertex on one side, so that
adaptive execution can split the edges of a vertex that a third of all edges
share. Only a count of changes comes to the driver.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sparkgrid.session import stage


def connected_components(edges: DataFrame) -> DataFrame:
    """(vertex, label) for each vertex of ``edges`` (a, b); the label is the smallest vertex reachable."""
    both = stage(edges.select("a", "b").union(edges.select("b", "a")).where("a <> b").distinct(), "edges")
    labels = stage(both.groupBy(F.col("a").alias("vertex")).agg(
        F.least(F.first("a"), F.min("b")).alias("label")), "labels")
    while True:
        near = both.join(labels, F.col("b") == F.col("vertex")).groupBy("a").agg(F.min("label").alias("near"))
        closer = labels.join(near, F.col("vertex") == F.col("a")).select(
            "vertex", F.col("label").alias("old"), F.least("label", "near").alias("label"))
        parents = labels.select(F.col("vertex").alias("parent"), F.col("label").alias("above"))
        moved = stage(closer.join(parents, F.col("label") == F.col("parent"), "left").select(
            "vertex", "old", F.least("label", F.coalesce("above", "label")).alias("label")), "labels")
        labels = moved.select("vertex", "label")
        if moved.where("old <> label").isEmpty():
            return labels
