"""Streaming forms against the batch forms."""

from pyspark.sql import functions as F
from stratalog.operators import state, stateful
from stratalog.sources import oplog
from stratalog.streaming import live


def run(stream, mode, name):
    q = stream.writeStream.outputMode(mode).format("memory").queryName(name).start()
    q.processAllAvailable()
    q.stop()
    return stream.sparkSession.table(name)


def test_latest(spark, sf, tmp_path):
    ops = oplog.from_events(spark, sf).drop("amount")
    ops.repartition(3).write.parquet(str(tmp_path / "ops"))
    stream = spark.readStream.schema(ops.schema).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "ops"))
    got = run(live.latest(stream), "complete", "latest_versions")
    want = state.current(ops)
    assert sorted(map(tuple, got.select("key", "seq").collect())) == sorted(map(tuple, want.select("key", "seq").collect()))


def test_admission(spark, sf, tmp_path):
    rows = spark.read.parquet(f"{sf}/events.parquet").select(F.col("user_id").cast("string").alias("client"), F.col("event_id").alias("seq"), oplog.seconds("ts").alias("ts"))
    rows.coalesce(1).write.parquet(str(tmp_path / "rows"))
    stream = spark.readStream.schema(rows.schema).parquet(str(tmp_path / "rows"))
    got = run(live.admission(stream, 1e-4, 3), "append", "admitted_requests")
    want = stateful.token_bucket(rows, 1e-4, 3)
    assert sorted(map(tuple, got.select("seq", "accepted").collect())) == sorted(map(tuple, want.select("seq", "accepted").collect()))
