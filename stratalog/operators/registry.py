"""Sketches stored as values under reserved prefixes of the op log."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from stratalog.operators.state import live
from stratalog.schema import RESERVED


def store(sketch: DataFrame, kind: str, name: str, ts: int, seq: int, *columns: str) -> DataFrame:
    """One put whose value is the sketch's sorted rows as JSON; a sketch has a fixed number of cells."""
    if kind not in RESERVED:
        raise ValueError(f"kind is one of {RESERVED}")
    rows = sketch.agg(F.to_json(F.array_sort(F.collect_list(F.struct(*columns)))).alias("value"))
    return rows.select(F.lit(kind + name).alias("key"), "value", F.lit(ts).cast("long").alias("ts"), F.lit(False).alias("tombstone"), F.lit(seq).cast("long").alias("seq"))


def store_each(rows: DataFrame, kind: str, name: str, value: str, ts: int) -> DataFrame:
    """One put for each row: ``value`` under the sketch name in column ``name``; ``seq`` is the name's order."""
    if kind not in RESERVED:
        raise ValueError(f"kind is one of {RESERVED}")
    return rows.select(F.concat(F.lit(kind), F.col(name).cast("string")).alias("key"), F.col(value).alias("value"), F.lit(ts).cast("long").alias("ts"), F.lit(False).alias("tombstone"), F.col(name).cast("long").alias("seq"))


def store_parts(parts: DataFrame, kind: str, name: str, part: str, value: str, ts: int) -> DataFrame:
    """One put for each part of a sketch too large for one value; ``seq`` is the number in column ``part``."""
    if kind not in RESERVED:
        raise ValueError(f"kind is one of {RESERVED}")
    return parts.select(F.concat(F.lit(f"{kind}{name}#"), F.col(part).cast("string")).alias("key"), F.col(value).alias("value"), F.lit(ts).cast("long").alias("ts"), F.lit(False).alias("tombstone"), F.col(part).cast("long").alias("seq"))


def load_parts(oplog: DataFrame, kind: str, name: str) -> DataFrame:
    """(value): a sketch's parts, those of the newest put alone; none if it is not there."""
    head = f"{kind}{name}#"
    found = live(oplog.where(F.col("key").startswith(head) & F.substring("key", len(head) + 1, 1 << 30).rlike("^[0-9]+$")))
    newest = found.agg(F.max("ts").alias("ts"))  # one row
    return found.join(F.broadcast(newest), "ts", "left_semi").select("value")


def stored(oplog: DataFrame, kind: str) -> DataFrame:
    """(name, value) of the live sketches of a kind."""
    found = live(oplog.where(F.col("key").startswith(kind)))
    return found.select(F.substring("key", len(kind) + 1, 1 << 30).alias("name"), "value")


def load(oplog: DataFrame, kind: str, name: str, schema: str) -> DataFrame:
    """A stored sketch's rows; none if it is not there."""
    found = live(oplog.where(F.col("key") == kind + name))
    return found.select(F.explode(F.from_json("value", f"array<struct<{schema}>>")).alias("s")).select("s.*")


def remove(oplog: DataFrame, kind: str, name: str, ts: int, seq: int) -> DataFrame:
    """The log with a tombstone for the sketch."""
    spark = oplog.sparkSession
    gone = spark.range(1).select(F.lit(kind + name).alias("key"), F.lit("").alias("value"), F.lit(ts).cast("long").alias("ts"), F.lit(True).alias("tombstone"), F.lit(seq).cast("long").alias("seq"))
    return oplog.select(*gone.columns).unionByName(gone)


def listing(oplog: DataFrame) -> DataFrame:
    """(kind, name) of the live sketches."""
    kind = F.regexp_extract("key", "^(" + "|".join(RESERVED) + ")", 1)
    found = live(oplog.where(F.col("key").rlike("^(" + "|".join(RESERVED) + ")")))
    return found.select(kind.alias("kind"), F.expr(f"substring(key, length(regexp_extract(key, '^({'|'.join(RESERVED)})', 1)) + 1)").alias("name"))
