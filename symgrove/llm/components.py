"""Connected components of stored edges, by labels that shrink along edges and along themselves."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from symgrove.llm.tables import stored


def components(edges: DataFrame) -> DataFrame:
    """(node, label) for every node of edges (a, b): label is the smallest node of its component.

    Each round a node takes the smallest label around it, then the label that
    this one has itself, so that long chains halve. Labels are written every
    round: joins read them from the shared folder, and a hot label or node is
    a skewed join that adaptive execution can split.
    """
    both = stored(edges.select(F.col("a").alias("node"), F.col("b").alias("other")).union(
        edges.select("b", "a")).distinct(), "edges")
    labels = stored(both.groupBy("node").agg(F.least(F.min("other"), F.first("node")).alias("label")), "labels")
    while True:
        seen = labels.select(F.col("node").alias("other"), F.col("label").alias("near"))
        near = stored(both.join(seen, "other").groupBy("node").agg(F.min("near").alias("near")), "near")
        lower = stored(labels.join(near, "node").select(
            "node", F.col("label").alias("old"), F.least("label", "near").alias("label")), "lower")
        jump = lower.select(F.col("node").alias("label"), F.col("label").alias("next"))
        labels = stored(lower.join(jump, "label").select("node", "old", F.col("next").alias("label")), "labels")
        if labels.where("old != label").isEmpty():
            return labels.select("node", "label")
