"""Newest versions and reads over them.

Every read is a filter over the newest live version of each key.  A predicate
on the key itself goes below the choice of versions down to the scan; the
tombstone filter stays above it.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F



def current(oplog: DataFrame, *by: Column) -> DataFrame:
    """The newest version of each key, tombstones included.

    The rank-one filter is pushed into each task before the exchange, so a hot
    key moves one row a task.
    """
    order = by or (F.desc("ts"), F.desc("seq"))
    newest = F.row_number().over(Window.partitionBy("key").orderBy(*order))
    return oplog.withColumn("__n", newest).where("__n = 1").drop("__n")


def live(oplog: DataFrame, *by: Column) -> DataFrame:
    """Newest versions without deleted keys."""
    return current(oplog, *by).where(~F.col("tombstone"))


def get(oplog: DataFrame, key: str) -> DataFrame:
    return live(oplog.where(F.col("key") == key))


def multi_get(oplog: DataFrame, keys: DataFrame) -> DataFrame:
    """Each asked key with ``found``, and its live version if there is one."""
    asked = keys.select("key").distinct()
    return asked.join(live(oplog.join(asked, "key", "left_semi")).withColumn("__found", F.lit(True)), "key", "left").withColumn("found", F.coalesce("__found", F.lit(False))).drop("__found")


def in_range(low: str, high: str) -> Column:
    """Inclusive, by bytes."""
    return F.col("key").between(low, high)


def has_prefix(prefix: str) -> Column:
    return F.col("key").startswith(prefix)


def paginate(rows: DataFrame, length: int, number: int, *order: Column) -> DataFrame:
    """Page ``number`` (from 1) of ``length`` rows; page or length 0 is empty."""
    if length < 1 or number < 1:
        return rows.limit(0)
    return rows.orderBy(*(order or (F.col("key"),))).offset((number - 1) * length).limit(length)


def range_scan(oplog: DataFrame, low: str, high: str, length: int, number: int) -> DataFrame:
    return paginate(live(oplog.where(in_range(low, high))), length, number)


def list_scan(oplog: DataFrame, prefix: str, length: int, number: int) -> DataFrame:
    return paginate(live(oplog.where(has_prefix(prefix))), length, number)


def recency_page(ranked: DataFrame, where: Column, length: int, number: int) -> DataFrame:
    """A page in the order of probing: newest run first, then key; rows have ``run_rank`` (0: the open tail)."""
    newest = live(ranked.where(where), F.col("run_rank"), F.desc("ts"), F.desc("seq"))
    return paginate(newest, length, number, F.col("run_rank"), F.col("key"))


def without(oplog: DataFrame, keys: DataFrame) -> DataFrame:
    """Physical removal of all versions of ``keys``."""
    return oplog.join(keys.select("key").distinct(), "key", "left_anti")


def as_of(oplog: DataFrame, ts: int) -> DataFrame:
    """Live versions at a time (an extension: earlier versions are in the log)."""
    return live(oplog.where(F.col("ts") <= ts))


def merged(*runs: DataFrame) -> DataFrame:
    """Keyed union of runs, given oldest first: the newest time wins, equal times go to the newer run."""
    every = reduce(DataFrame.unionByName, [r.withColumn("__age", F.lit(i)) for i, r in enumerate(runs)])
    return current(every, F.desc("ts"), F.desc("__age"), F.desc("seq")).drop("__age")
