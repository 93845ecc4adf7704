"""Bloom filter, Count-Min, HyperLogLog and SimHash as DataFrames.

Sketches are long tables of plain numbers: they merge by union and one more
aggregation, and partial aggregation in each task bounds what is exchanged.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from hashlib import md5
from itertools import pairwise

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from stratalog.functions.hashing import fnv1a_32, slots
from stratalog.sources.shared import written

BASE = 1_700_000_000  # seeds are a parameter, so that sketches can be made again and merged


def bloom_params(n: int, p: float) -> tuple[int, int]:
    """(M, K) for n keys; p is any rate but 1 (a rate over 1 acts like its inverse)."""
    if n < 1 or p <= 0 or p == 1:
        raise ValueError("needs n >= 1 and a rate above 0 other than 1")
    m = math.ceil(n * abs(math.log(p)) / math.log(2) ** 2)
    return m, math.ceil(m / n * math.log(2))


def cms_params(epsilon: float, delta: float) -> tuple[int, int]:
    """(M, K): columns and rows."""
    return math.ceil(math.e / epsilon), math.ceil(math.log(math.e / delta))


def bloom(keys: DataFrame, m: int, k: int, *by: str, base: int = BASE) -> DataFrame:
    """(by..., slot): the set bits of the filter of ``key``, one filter for each value of ``by``."""
    return keys.select(*by, F.explode(slots(F.col("key"), base, k, m)).alias("s")).select(*by, F.col("s.slot").alias("slot")).distinct()


def bloom_probe(probes: DataFrame, bits: DataFrame, m: int, k: int, base: int = BASE) -> DataFrame:
    """``probes`` (distinct ``key``) with ``maybe``: whether all k bits are set."""
    asked = probes.select("key").distinct()
    one = asked.select("key", F.explode(slots(F.col("key"), base, k, m)).alias("s")).select("key", F.col("s.slot").alias("slot"))
    hit = one.join(bits.select("slot", F.lit(1).alias("set")), "slot", "left")
    return hit.groupBy("key").agg((F.count("set") == k).alias("maybe"))


def bloom_bytes(bits: DataFrame, m: int) -> DataFrame:
    """(byte, value): the filter's bytes that are not zero, first bit highest."""
    octet = F.floor(F.col("slot") / 8).cast("int")
    return bits.groupBy(octet.alias("byte")).agg(F.sum(F.pow(F.lit(2.0), 7 - F.col("slot") % 8).cast("int")).cast("int").alias("value"))


PAGE = 8192  # bytes of a filter in one packed row


def bloom_pack(bits: DataFrame, m: int, k: int, base: int = BASE) -> DataFrame:
    """(page, packed): the filter as bytes, one row for each ``PAGE`` of them, so that no task holds a large filter.

    Big-endian: m in eight bytes, k and base in four each, the page's first byte
    in eight, then the page's bits, first bit highest.
    """
    every = bits.sparkSession.range((m + 7) // 8).select(F.col("id").cast("int").alias("byte"))
    octets = every.join(bloom_bytes(bits, m), "byte", "left").select("byte", F.lpad(F.hex(F.coalesce("value", F.lit(0))), 2, "0").alias("octet"))
    pages = octets.groupBy(F.floor(F.col("byte") / PAGE).cast("long").alias("page")).agg(F.array_sort(F.collect_list(F.struct("byte", "octet"))).alias("own"))
    first = F.lpad(F.hex(F.col("page") * PAGE), 16, "0")
    body = F.array_join(F.transform("own", lambda x: x["octet"]), "")
    return pages.select("page", F.unhex(F.concat(F.lit(f"{m:016x}{k:08x}{base & 0xFFFFFFFF:08x}"), first, body)).alias("packed"))


def _packed_field(at: int, n: int) -> Column:
    return F.conv(F.hex(F.substring("packed", at + 1, n)), 16, 10).cast("long")


def bloom_header(packed: DataFrame) -> DataFrame:
    """(m, k, base) of packed filters."""
    return packed.select(_packed_field(0, 8).alias("m"), _packed_field(8, 4).alias("k"), _packed_field(12, 4).alias("base")).distinct()


def bloom_unpack(packed: DataFrame) -> DataFrame:
    """(m, k, base, slot): header and set bits of packed filters."""
    octets = F.regexp_extract_all(F.hex(F.substring("packed", 25, PAGE)), F.lit(".."), F.lit(0))
    rows = packed.select(_packed_field(0, 8).alias("m"), _packed_field(8, 4).alias("k"), _packed_field(12, 4).alias("base"), _packed_field(16, 8).alias("first"), F.posexplode(octets).alias("at", "octet"))
    rows = rows.withColumn("value", F.conv("octet", 16, 10).cast("int")).where("value > 0")
    bit = F.explode(F.filter(F.sequence(F.lit(0), F.lit(7)), lambda i: F.floor(F.col("value") / F.pow(F.lit(2.0), 7 - i)) % 2 == 1)).alias("bit")
    return rows.select("m", "k", "base", "first", "at", bit).select("m", "k", "base", ((F.col("first") + F.col("at")) * 8 + F.col("bit")).alias("slot"))


def cms(keys: DataFrame, m: int, k: int, base: int = BASE) -> DataFrame:
    """(row, col, cnt)."""
    one = keys.select(F.explode(slots(F.col("key"), base, k, m)).alias("s"))
    return one.groupBy(F.col("s.i").alias("row"), F.col("s.slot").alias("col")).agg(F.count("*").alias("cnt"))


def cms_estimate(probes: DataFrame, table: DataFrame, m: int, k: int, base: int = BASE) -> DataFrame:
    """(key, estimate): the least of its k counters."""
    asked = probes.select("key").distinct()
    one = asked.select("key", F.explode(slots(F.col("key"), base, k, m)).alias("s")).select("key", F.col("s.i").alias("row"), F.col("s.slot").alias("col"))
    return one.join(table, ["row", "col"], "left").groupBy("key").agg(F.min(F.coalesce("cnt", F.lit(0))).alias("estimate"))


def merged_cms(*tables: DataFrame) -> DataFrame:
    every = tables[0]
    for t in tables[1:]:
        every = every.unionByName(t)
    return every.groupBy("row", "col").agg(F.sum("cnt").alias("cnt"))


def hll_registers(keys: DataFrame, precision: int, *by: str) -> DataFrame:
    """(by..., bucket, rank): top bits choose the bucket; trailing zeros of the others, and one, the rank."""
    if not 4 <= precision <= 16:
        raise ValueError("precision is 4 to 16")
    low_bits = 32 - precision
    h = keys.select(*by, fnv1a_32(F.col("key")).alias("h"))
    low = F.col("h") % (1 << low_bits)
    rank = F.when(low == 0, low_bits + 1).otherwise(F.bit_count(low.bitwiseXOR(low - 1)))
    return h.select(*by, F.shiftright("h", low_bits).alias("bucket"), rank.cast("int").alias("rank")).groupBy(*by, "bucket").agg(F.max("rank").alias("rank"))


def merged_hll(*tables: DataFrame) -> DataFrame:
    every = tables[0]
    for t in tables[1:]:
        every = every.unionByName(t)
    return every.groupBy("bucket").agg(F.max("rank").alias("rank"))


def hll_estimate(registers: DataFrame, precision: int, *by: str) -> DataFrame:
    """(by..., non_empty, estimate), rounded to six places."""
    m = 1 << precision
    alpha = 0.7213 / (1 + 1.079 / m)
    sums = registers.groupBy(*by).agg(F.count("*").alias("non_empty"), F.sum(F.pow(F.lit(2.0), -F.col("rank"))).alias("z"))
    raw = F.lit(alpha * m * m) / (F.col("z") + (m - F.col("non_empty")))
    empty = m - F.col("non_empty")
    small = m * F.log(F.lit(float(m)) / empty)
    large = -F.lit(2.0**32) * F.log(1 - raw / 2.0**32)
    estimate = F.when((raw <= 2.5 * m) & (empty > 0), small).when(raw > 2.0**32 / 30, large).otherwise(raw)
    return sums.select(*by, "non_empty", F.round(estimate, 6).alias("estimate"))


def simhash_token(word: Column) -> Column:
    """Upper case (a sharp s stays one letter), then , . ! ? trimmed in that order, once each."""
    out = F.upper(F.replace(word, F.lit("ß"), F.lit("ẞ")))
    for sign in ",.!?":
        out = F.btrim(out, F.lit(sign))
    return out


SLICE_WORDS = 1 << 18  # words that a task counts at once; a longer text is alone


def _listed(texts: DataFrame, key: str, text: str) -> DataFrame:
    """(key, words): words between single spaces, empty ones too."""
    return texts.where(F.col(text).isNotNull()).select(key, F.transform(F.split(F.col(text), " ", -1), simhash_token).alias("words"))


def _counted(batch: pa.RecordBatch) -> Iterator[tuple[pa.Array, pa.Array, np.ndarray, np.ndarray, np.ndarray, np.ndarray]]:
    """Slices of a batch: keys, vocabulary, words' numbers by row, their counts, where each row's begin, and rows' sizes."""
    keys, lists = batch.column(0), batch.column(1)
    every, ends = lists.flatten(), np.asarray(lists.offsets).astype(np.int64)
    ends -= ends[0]
    i = 0
    while i < len(keys):
        j = max(i + 1, int(np.searchsorted(ends, ends[i] + SLICE_WORDS, "right")) - 1)
        sizes = np.diff(ends[i : j + 1])
        coded = every.slice(ends[i], ends[j] - ends[i]).dictionary_encode()
        wide = len(coded.dictionary)
        own, n = np.unique(np.repeat(np.arange(j - i), sizes) * wide + np.asarray(coded.indices), return_counts=True)
        yield keys.slice(i, j - i), coded.dictionary, own % wide, n, np.searchsorted(own, np.arange(j - i + 1) * wide), sizes
        i = j


def simhash_tokens(texts: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """(key, word, n): words between single spaces, empty ones too, with their counts.

    A text is one row, so its words are counted there and not exchanged; only
    texts whose key other texts have too are counted by key.
    """
    schema = T.StructType([texts.schema[key], T.StructField("word", T.StringType()), T.StructField("n", T.LongType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for keys, words, own, n, begins, _ in _counted(batch):
                rows = np.repeat(np.arange(len(keys)), np.diff(begins))
                yield pa.RecordBatch.from_arrays([keys.take(pa.array(rows)), words.take(pa.array(own)), pa.array(n, pa.int64())], names=schema.names)

    count = lambda of: _listed(of, key, text).mapInArrow(run, schema)
    again = written(texts.groupBy(key).agg(F.count("*").alias("n")).where("n > 1").select(F.col(key).alias("__again")), "again")
    if again.isEmpty():
        return count(texts)
    same = F.col(key).eqNullSafe(F.col("__again"))
    several = count(texts.join(again, same, "left_semi")).groupBy(key, "word").agg(F.sum("n").alias("n"))
    return count(texts.join(again, same, "left_anti")).unionByName(several)


def simhash(texts: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """(key, fingerprint): 256 characters 0 or 1, one row for each row whose text is not null.

    A word's 256 bits are the ASCII bits of its MD5 in hex; a place is 1 where
    more than half of the text's words (repeats count) have it.  A text is one
    row, so its votes are summed there: nothing is exchanged, and what a task
    holds is one slice's distinct words.
    """
    schema = T.StructType([texts.schema[key], T.StructField("fingerprint", T.StringType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for keys, words, own, n, begins, sizes in _counted(batch):
                digest = np.frombuffer("".join(md5(w.encode()).hexdigest() for w in words.to_pylist()).encode(), np.uint8).reshape(-1, 32)
                out = []
                for (lo, hi), size in zip(pairwise(begins.tolist()), sizes.tolist(), strict=True):
                    votes = np.zeros(256)
                    for i in range(lo, hi, 1024):
                        part = slice(i, min(i + 1024, hi))
                        votes += n[part] @ np.unpackbits(digest[own[part]], axis=1).astype(np.float64)
                    out.append(((2 * votes > size) + ord("0")).astype(np.uint8).tobytes().decode())
                yield pa.RecordBatch.from_arrays([keys, pa.array(out, pa.string())], names=schema.names)

    return _listed(texts, key, text).mapInArrow(run, schema)


def hamming(a: Column, b: Column) -> Column:
    """Places in which two fingerprints differ."""
    part = lambda c, k: F.conv(F.substring(c, 32 * k + 1, 32), 2, 10).cast("long")
    return sum((F.bit_count(part(a, k).bitwiseXOR(part(b, k))) for k in range(1, 8)), F.bit_count(part(a, 0).bitwiseXOR(part(b, 0)))).cast("int")
