"""Tables in the folder that driver and executors share."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def shared_dir(spark: SparkSession) -> str:
    """The session's ``spark.checkpoint.dir``; where it is unset on a local master, as in tests, a temporary folder."""
    sc = spark.sparkContext
    named = spark.conf.get("spark.checkpoint.dir", None) or sc.getCheckpointDir()
    if not named:
        if not sc.master.startswith("local"):
            raise RuntimeError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        sc.setCheckpointDir(tempfile.mkdtemp(prefix="stratalog-"))
        named = sc.getCheckpointDir()
    return named.rstrip("/")


def place(spark: SparkSession, name: str) -> str:
    """A new path there."""
    return f"{shared_dir(spark)}/tables/{name}-{uuid.uuid4().hex}"


def written(df: DataFrame, name: str) -> DataFrame:
    """``df`` written there and read back: its lineage ends, and it outlives lost executors."""
    path = place(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def numbered(df: DataFrame, *order: str, name: str = "rn") -> DataFrame:
    """Rows numbered from 1 in global order, without one task that sees them all.

    Rows are dealt by range and sorted in each part; a row's number is its place
    in its part after the sizes of the parts before.
    """
    from pyspark.sql import Window
    from pyspark.sql import functions as F

    parts = written(df.repartitionByRange(*order).sortWithinPartitions(*order).withColumn("__id", F.monotonically_increasing_id()), "numbered")
    part, place = F.shiftright("__id", 33), F.col("__id").bitwiseAND((1 << 33) - 1)
    sizes = parts.groupBy(part.alias("__part")).agg(F.count("*").alias("__n"))  # one row for each part
    before = sizes.withColumn("__before", F.coalesce(F.sum("__n").over(Window.orderBy("__part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))).drop("__n")
    return parts.withColumn("__part", part).join(before, "__part").withColumn(name, F.col("__before") + place + 1).drop("__part", "__id", "__before")
