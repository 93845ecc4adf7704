"""The binary record: checksum, time, tombstone, sizes, key, value; big-endian.

Encoding and checking are SQL expressions.  Decoding walks a file of records
from its start, which has no SQL form; it runs in Arrow batches, one file a row.
"""

from __future__ import annotations

import struct
import zlib
from collections.abc import Iterator
from itertools import batched

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

HEADER = struct.Struct(">IQBQQ")


def _big(n: Column, octets: int) -> Column:
    return F.unhex(F.lpad(F.hex(n), 2 * octets, "0"))


def body(key: str = "key", value: str = "value", ts: str = "ts", tombstone: str = "tombstone") -> Column:
    """All of a record after its checksum."""
    k, v = F.encode(F.col(key), "UTF-8"), F.encode(F.coalesce(F.col(value), F.lit("")), "UTF-8")
    return F.concat(_big(F.col(ts), 8), F.when(F.col(tombstone), F.unhex(F.lit("01"))).otherwise(F.unhex(F.lit("00"))), _big(F.octet_length(k), 8), _big(F.octet_length(v), 8), k, v)


def checksum(data: Column) -> Column:
    """CRC-32 (IEEE)."""
    return F.crc32(data)


def encoded(ops: DataFrame) -> DataFrame:
    """``ops`` with its record bytes as ``record`` and their checksum as ``crc``."""
    with_body = ops.withColumn("__body", body()).withColumn("crc", checksum(F.col("__body")))
    return with_body.withColumn("record", F.concat(_big(F.col("crc"), 4), F.col("__body"))).drop("__body")


def parse(data: bytes) -> Iterator[tuple[str, str, int, bool, bool]]:
    """(key, value, ts, tombstone, sound) of each record; a cut-off record at the end is left out."""
    at = 0
    while at + HEADER.size <= len(data):
        crc, ts, dead, k, v = HEADER.unpack_from(data, at)
        end = at + HEADER.size + k + v
        if end > len(data):
            return
        raw = data[at + HEADER.size : end]
        yield raw[:k].decode("utf-8", "replace"), raw[k:].decode("utf-8", "replace"), ts, bool(dead), zlib.crc32(data[at + 4 : end]) == crc
        at = end


def decoded(files: DataFrame) -> DataFrame:
    """Records in rows (path, content): path, n (place in the file), key, value, ts, tombstone, sound."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = ["path", "n", "key", "value", "ts", "tombstone", "sound"]
        for batch in batches:
            for path, content in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                for rows in batched(((path, i, *r) for i, r in enumerate(parse(content or b""))), 10_000):
                    yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), (pa.string(), pa.int64(), pa.string(), pa.string(), pa.int64(), pa.bool_(), pa.bool_()), strict=True)], names=names)

    return files.select("path", "content").mapInArrow(run, "path string, n long, key string, value string, ts long, tombstone boolean, sound boolean")


def segmented(ops: DataFrame, size: int) -> DataFrame:
    """(path, content): the records of each ``size`` operations as one segment file's bytes."""
    number = F.floor(F.col("seq") / size).cast("long")
    rows = encoded(ops).groupBy(number.alias("segment")).agg(F.array_sort(F.collect_list(F.struct("seq", F.hex("record").alias("hex")))).alias("x"))
    return rows.select(F.format_string("wal_%05d.log", "segment").alias("path"), F.unhex(F.array_join(F.transform("x", lambda r: r["hex"]), "")).alias("content"))


def read_log(spark: SparkSession, path: str) -> DataFrame:
    """All records of the segment files under ``path``, with their segment."""
    from stratalog.sources.oplog import segment_number

    files = spark.read.format("binaryFile").load(path)
    return decoded(files).withColumn("segment", segment_number("path"))
