"""Op logs over the test tables, and constructors for operations."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from stratalog.schema import OPLOG, RESERVED


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def seconds(ts: str) -> Column:
    return F.unix_seconds(F.col(ts).cast("timestamp"))


def from_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One key per user; an "error" event deletes it.  ``amount`` rides along."""
    return table(spark, sf_dir, "events").select(
        F.lpad(F.col("user_id").cast("string"), 6, "0").alias("key"),
        F.col("event_type").alias("value"),
        seconds("ts").alias("ts"),
        (F.col("event_type") == "error").alias("tombstone"),
        F.col("event_id").alias("seq"),
        F.col("value").alias("amount"),
    )


def from_orders(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One key per customer, with ties in time; a finished order deletes it."""
    return table(spark, sf_dir, "orders").select(
        F.lpad(F.col("o_custkey").cast("string"), 8, "0").alias("key"),
        F.col("o_orderpriority").alias("value"),
        seconds("o_orderdate").alias("ts"),
        (F.col("o_orderstatus") == "F").alias("tombstone"),
        F.col("o_orderkey").alias("seq"),
        F.col("o_totalprice").alias("amount"),
    )


def from_order_keys(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One put per order: no key twice."""
    return table(spark, sf_dir, "orders").select(
        F.lpad(F.col("o_orderkey").cast("string"), 10, "0").alias("key"),
        F.col("o_orderpriority").alias("value"),
        seconds("o_orderdate").alias("ts"),
        F.lit(False).alias("tombstone"),
        F.col("o_orderkey").alias("seq"),
    )


def from_customers(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "customer").select(F.col("c_name").alias("key"), F.col("c_mktsegment").alias("value"), F.lit(0).cast("long").alias("ts"), F.lit(False).alias("tombstone"), F.col("c_custkey").alias("seq"))


def from_pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "pages").select(F.col("url").alias("key"), F.col("html").alias("value"), F.lit(0).cast("long").alias("ts"), F.lit(False).alias("tombstone"), F.col("page_id").alias("seq"))


def normalised(column: str) -> Column:
    """Without white space at either end."""
    return F.regexp_replace(column, r"^\s+|\s+$", "")


def is_reserved(key: str) -> Column:
    return F.col(key).rlike("^(" + "|".join(RESERVED) + ")")


def has_digit(column: str) -> Column:
    """Whether any digit occurs."""
    return F.col(column).rlike("[0-9]")


def put(spark: SparkSession, rows: list[tuple[str, str, int, int]]) -> DataFrame:
    """Puts (key, value, ts, seq); reserved keys are refused."""
    return _ops(spark, [(k, v, ts, False, seq) for k, v, ts, seq in rows])


def delete(spark: SparkSession, rows: list[tuple[str, int, int]]) -> DataFrame:
    """Tombstones (key, ts, seq)."""
    return _ops(spark, [(k, "", ts, True, seq) for k, ts, seq in rows])


def _ops(spark: SparkSession, rows: list[tuple]) -> DataFrame:
    rows = [(r[0].strip(), r[1].strip(), *r[2:]) for r in rows]
    if bad := [r[0] for r in rows if r[0].startswith(RESERVED)]:
        raise ValueError(f"reserved keys: {bad}")
    return spark.createDataFrame(rows, OPLOG)


def accepted(requests: DataFrame) -> DataFrame:
    """Requests as operations: keys and values without outer white space, reserved keys left out."""
    return requests.withColumns({"key": normalised("key"), "value": normalised("value")}).where(~is_reserved("key"))


def generate(spark: SparkSession, n: int, seed: int = 42, letters: int = 5) -> DataFrame:
    """``n`` puts of seeded random lower-case keys and values, ten a second."""
    word = lambda salt: F.concat(*[F.char(97 + F.pmod(F.xxhash64(F.lit(seed), F.lit(salt), F.lit(i), "id"), F.lit(26))) for i in range(letters)])
    return spark.range(n).select(word("key").alias("key"), word("value").alias("value"), (F.col("id") / 10).cast("long").alias("ts"), F.lit(False).alias("tombstone"), F.col("id").alias("seq"))


def segment_number(path: str = "path") -> Column:
    """Number of a log segment from its file name ``wal_00001.log``."""
    return F.regexp_extract(path, r"wal_(\d+)\.log", 1).cast("int")


def run_address(path: str = "path") -> Column:
    """Level and run from a path such as ``level1/sstable250``."""
    part = lambda i: F.regexp_extract(path, r"level(\d+)/sstable(\d+)", i).cast("int")
    return F.struct(part(1).alias("level"), part(2).alias("run"))


def append(ops: DataFrame, path: str) -> None:
    """Append operations to a log directory."""
    ops.write.mode("append").parquet(path)


def read(spark: SparkSession, path: str) -> DataFrame:
    """The operations of a log directory, in order."""
    return spark.read.parquet(path).orderBy("seq")


def latest_segment(log: DataFrame) -> DataFrame:
    """Replay's input: rows of the newest segment."""
    newest = log.agg(F.max("segment").alias("segment"))
    return log.join(F.broadcast(newest), "segment", "left_semi")


def retained(log: DataFrame, water_mark: int) -> DataFrame:
    """Segments after collection: all while there are at most ``water_mark``, else only the newest, as segment 0."""
    most = log.agg(F.max("segment").alias("newest"))  # one row
    kept = log.join(F.broadcast(most), F.lit(True))
    full = F.col("newest") > water_mark
    return kept.where(~full | (F.col("segment") == F.col("newest"))).withColumn("segment", F.when(full, 0).otherwise(F.col("segment"))).drop("newest")
