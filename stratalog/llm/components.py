"""Connected components as a loop of joins over written tables."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from stratalog.llm.store import written


def components(edges: DataFrame, rounds: int = 60) -> DataFrame:
    """(v, label): each node of ``edges`` (a, b) with the least node of its component.

    A round takes the least label among neighbours and then the label's own
    label, so a long path is halved each time.  Labels are written after each
    step: the loop outlives lost executors, and both sides of each join come
    from files, so that Spark may broadcast them by size or split a hot node.
    """
    one = written(edges.where("a <> b").select("a", "b"), "edges")

    def neighbours(*ways: DataFrame) -> DataFrame:
        """(v, near): the least near value of each node over both ways along the edges."""
        ahead, back = (w.groupBy("v").agg(F.min("near").alias("near")) for w in ways)
        return ahead.union(back).groupBy("v").agg(F.min("near").alias("near"))

    ids = neighbours(one.select(F.col("a").alias("v"), F.col("b").alias("near")), one.select(F.col("b").alias("v"), F.col("a").alias("near")))
    labels = written(ids.select("v", F.least("v", "near").alias("label")), "labels")
    for _ in range(rounds):
        at_b = one.join(labels.select(F.col("v").alias("b"), F.col("label").alias("near")), "b").select(F.col("a").alias("v"), "near")
        at_a = one.join(labels.select(F.col("v").alias("a"), F.col("label").alias("near")), "a").select(F.col("b").alias("v"), "near")
        step = written(labels.join(neighbours(at_b, at_a), "v").select("v", F.least("label", "near").alias("next"), F.col("label").alias("before")), "labels")
        on = step.select(F.col("v").alias("next"), F.col("next").alias("far"))
        jumped = written(step.join(on, "next").select("v", F.col("far").alias("label"), "before"), "labels")
        labels = jumped.select("v", "label")
        if jumped.where("label <> before").isEmpty():
            return labels
    raise RuntimeError(f"no fixed point after {rounds} rounds")
