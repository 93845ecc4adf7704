"""Merkle trees over records, and checks against stored roots."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

# Fixed value: SHA-1 of nothing, the partner of a level's odd last node.
PAD = "da39a3ee5e6b4b0d3255bfef95601890afd80709"
FAN = 8  # tree levels per step: 256 nodes meet in one row


def _up(nodes: Column) -> Column:
    """The next level of an array of hex nodes."""
    half = F.ceil(F.size(nodes) / 2).cast("int")

    def parent(i: Column) -> Column:
        right = F.coalesce(F.try_element_at(nodes, 2 * i + 2), F.lit(PAD))
        return F.sha1(F.unhex(F.concat(F.element_at(nodes, 2 * i + 1), right)))

    return F.transform(F.sequence(F.lit(0), half - 1), parent)


def merkle_levels(leaves: DataFrame, *by: str) -> DataFrame:
    """(by..., pos, node) one step of ``FAN`` levels above (by..., pos, node); a tree of one node stays."""
    chunk = F.floor(F.col("pos") / (1 << FAN)).cast("long")
    rows = leaves.groupBy(*by, chunk.alias("pos")).agg(F.array_sort(F.collect_list(F.struct("pos", "node"))).alias("x"), F.max("n").alias("n"))
    rows, left = rows.withColumn("x", F.transform("x", lambda s: s["node"])), F.col("n")
    for _ in range(FAN):
        up = F.when(left > 1, _up(F.col("x"))).otherwise(F.col("x"))
        rows = rows.withColumns({"x": up, "n": F.when(left > 1, F.ceil(left / 2)).otherwise(left)})
    return rows.select(*by, "pos", F.col("x")[0].alias("node"), F.col("n").cast("long").alias("n"))


def merkle_root(leaves: DataFrame, most: int, *by: str) -> DataFrame:
    """(by..., root) over (by..., pos from 0, node); ``most`` is at least the largest tree's number of leaves.

    Each step folds up to 256 neighbours in one row, so a tree of n leaves
    takes about log256(n) exchanges, each of a 256th of the rows before.
    """
    sizes = leaves.groupBy(*by).agg(F.count("*").alias("n"))
    rows = leaves.join(sizes, list(by)) if by else leaves.join(F.broadcast(sizes), F.lit(True))
    while most > 1:
        rows = merkle_levels(rows, *by)
        most = -(-most >> FAN)
    return rows.select(*by, F.col("node").alias("root"))


def text_leaves(spark: SparkSession, path: str) -> DataFrame:
    """(pos, node): one leaf for each line of a text file, in order."""
    lines = spark.read.text(path, wholetext=True).select(F.posexplode(F.split("value", "\n", -1)).alias("pos", "line"))
    return lines.select(F.col("pos").cast("long").alias("pos"), F.sha1("line").alias("node"))


def verify(content: DataFrame, roots: DataFrame, *by: str) -> DataFrame:
    """(by..., sound): whether each run's root is the stored one (an extension)."""
    return content.join(roots.withColumnRenamed("root", "stored"), list(by), "left").select(*by, (F.col("root") == F.coalesce("stored", F.lit(""))).alias("sound"))
