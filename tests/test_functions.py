"""Hashes, sketches, records and trees against fixed values and plain Python."""

import hashlib

import pyarrow as pa
import pytest
from pyspark.sql import functions as F
from stratalog.functions import sketches as sk
from stratalog.functions.hashing import fnv1a_32, seeded
from stratalog.operators import integrity, registry
from stratalog.schema import OPLOG
from stratalog.sources import records


def test_fnv_and_seeded(spark):
    rows = spark.createDataFrame([("a",), ("foobar",), ("hé",), ("",)], "k string")
    assert [r[0] for r in rows.select(fnv1a_32(F.col("k"))).collect()] == [3826002220, 3214735720, 3433450703, 2166136261]
    h = rows.where("k = 'a'").select(seeded(F.col("k"), 1700000000, 0).alias("h")).first().h
    assert int(h) == 5276252103065247398 and int(h) % 58 == 20


def test_sizes():
    assert sk.bloom_params(40, 2.0) == (58, 2) and sk.bloom_params(100, 0.01) == (959, 7) and sk.bloom_params(1000, 0.001) == (14378, 10)
    assert sk.cms_params(0.1, 0.1) == (28, 4) and sk.cms_params(0.01, 0.01) == (272, 6) and sk.cms_params(0.001, 0.01) == (2719, 6)
    with pytest.raises(ValueError):
        sk.bloom_params(10, 1)


def test_bloom_has_no_false_negative(spark):
    keys = spark.range(500).select(F.col("id").cast("string").alias("key"))
    m, k = sk.bloom_params(500, 0.01)
    bits = sk.bloom(keys, m, k)
    assert sk.bloom_probe(keys, bits, m, k).where("not maybe").count() == 0
    others = spark.range(1000, 3000).select(F.col("id").cast("string").alias("key"))
    assert sk.bloom_probe(others, bits, m, k).where("maybe").count() < 60


def test_cms_never_underestimates(spark):
    rows = spark.range(2000).select((F.col("id") % 90).cast("string").alias("key"))
    m, k = sk.cms_params(0.1, 0.1)
    got = sk.cms_estimate(rows, sk.cms(rows, m, k), m, k).join(rows.groupBy("key").count(), "key").collect()
    assert all(r.estimate >= r["count"] for r in got)
    half = sk.cms(rows.where("key < '5'"), m, k), sk.cms(rows.where("key >= '5'"), m, k)
    assert sorted(map(tuple, sk.merged_cms(*half).collect())) == sorted(map(tuple, sk.cms(rows, m, k).collect()))


def test_hll_small(spark):
    rows = spark.createDataFrame([("a",), ("b",), ("c",), ("a",)], "key string")
    regs = sk.hll_registers(rows, 4)
    assert [tuple(r) for r in regs.collect()] == [(14, 3)]
    assert sk.hll_estimate(regs, 4).first().estimate == 1.032616
    with pytest.raises(ValueError):
        sk.hll_registers(rows, 3)


def test_simhash_distances(spark):
    texts = ["the quick brown fox", "brown the quick fox!", "the quick brown dog"]
    got = sk.simhash(spark.createDataFrame(list(enumerate(texts)), "doc_id int, text string")).collect()
    prints = {r.doc_id: r.fingerprint for r in got}
    rows = spark.createDataFrame([(prints[0], prints[1]), (prints[0], prints[2])], "a string, b string")
    assert [r[0] for r in rows.select(sk.hamming(F.col("a"), F.col("b"))).collect()] == [0, 26]


def test_simhash_of_more_than_two_million_words(spark):
    texts = [(1, "a" + " " * 2_200_000), (2, " ")]
    prints = dict(sk.simhash(spark.createDataFrame(texts, "doc_id int, text string")).collect())
    assert prints[1] == prints[2] == "".join(f"{ord(c):08b}" for c in "d41d8cd98f00b204e9800998ecf8427e")


def test_record_bytes_and_round_trip(spark):
    ops = spark.createDataFrame([("a", "1", 1700000000, False, 1), ("b", "", 1700000001, True, 2), ("é", "ß", 3, False, 3)], OPLOG)
    raw = [bytes(r.record) for r in records.encoded(ops).orderBy("seq").collect()]
    assert raw[0].hex() == "b46b4349000000006553f10000000000000000000100000000000000016131"
    assert raw[1].hex() == "d73558a9000000006553f101010000000000000001000000000000000062"
    broken = bytearray(raw[0])
    broken[-1] ^= 1
    files = spark.createDataFrame([("wal_00007.log", bytearray(b"".join(raw))), ("bad", bytearray(broken)), ("cut", bytearray(raw[0][:-1])), ("empty", bytearray())], "path string, content binary")
    back = records.decoded(files).collect()
    assert [(r.key, r.value, r.ts, r.tombstone, r.sound) for r in back if r.path == "wal_00007.log"] == [("a", "1", 1700000000, False, True), ("b", "", 1700000001, True, True), ("é", "ß", 3, False, True)]
    assert [r.sound for r in back if r.path == "bad"] == [False] and not [r for r in back if r.path in ("cut", "empty")]


def test_log_files(spark, tmp_path):
    ops = spark.createDataFrame([("a", "1", 1, False, 1)], OPLOG)
    (tmp_path / "wal_00003.log").write_bytes(bytes(records.encoded(ops).first().record))
    row = records.read_log(spark, str(tmp_path)).first()
    assert (row.segment, row.key, row.sound) == (3, "a", True)


def brute_root(nodes):
    while len(nodes) > 1:
        nodes = [hashlib.sha1(bytes.fromhex(nodes[i] + (nodes[i + 1] if i + 1 < len(nodes) else integrity.PAD))).hexdigest() for i in range(0, len(nodes), 2)]
    return nodes[0]


@pytest.mark.parametrize("n", [1, 2, 3, 100, 256, 257, 1025])
def test_merkle(spark, n):
    leaves = spark.range(n).select(F.col("id").alias("pos"), F.sha1(F.concat(F.lit("data "), (F.col("id") + 1).cast("string"))).alias("node"))
    want = brute_root([hashlib.sha1(f"data {i + 1}".encode()).hexdigest() for i in range(n)])
    assert integrity.merkle_root(leaves, n).first().root == want
    if n == 100:
        assert want == "cbfc9b625a3351334d143928571bbeaba7da7248"


def test_leaves_from_text(spark, tmp_path):
    (tmp_path / "data.txt").write_text("\n".join(f"data {i}" for i in range(1, 101)))
    leaves = integrity.text_leaves(spark, str(tmp_path / "data.txt"))
    assert integrity.merkle_root(leaves, 100).first().root == "cbfc9b625a3351334d143928571bbeaba7da7248"


def test_bloom_bytes_round_trip(spark):
    keys = spark.createDataFrame([(f"k{i}",) for i in range(30)], "key string")
    bits = sk.bloom(keys, 283, 7)
    back = sk.bloom_unpack(sk.bloom_pack(bits, 283, 7))
    assert {(r.m, r.k, r.base) for r in back.collect()} == {(283, 7, sk.BASE)}
    assert sorted(r.slot for r in back.collect()) == sorted(r.slot for r in bits.collect())


def test_large_filter_is_packed_in_pages(spark):
    keys = spark.range(60_000).select(F.col("id").cast("string").alias("key"))
    m = 2 * 8 * sk.PAGE + 4001
    bits = sk.bloom(keys, m, 3)
    packed = sk.bloom_pack(bits, m, 3)
    raw = b"".join(bytes(r.packed)[24:] for r in packed.orderBy("page").collect())
    assert packed.count() == 3 and len(raw) == (m + 7) // 8
    want = bytearray(len(raw))
    for r in bits.collect():
        want[r.slot // 8] |= 128 >> r.slot % 8
    assert raw == bytes(want)
    assert sorted(r.slot for r in sk.bloom_unpack(packed).collect()) == sorted(r.slot for r in bits.collect())
    older = registry.store_parts(packed.select(F.hex("packed").alias("v"), "page"), "BloomFilter", "x", "page", "v", 1)
    newer = registry.store_parts(spark.createDataFrame([(0, "00")], "page long, v string"), "BloomFilter", "x", "page", "v", 2)
    assert registry.load_parts(older, "BloomFilter", "x").count() == 3
    assert [r.value for r in registry.load_parts(older.unionByName(newer), "BloomFilter", "x").collect()] == ["00"]


def test_words_are_counted_without_exchanging_them(spark, monkeypatch):
    rows = [(1, "a  b a"), (2, None), (3, "ß. b"), (1, "a c"), (None, "x"), (None, "x y"), (4, "")]
    texts = spark.createDataFrame(rows, "doc_id int, text string")
    want = {(1, "A", 3), (1, "", 1), (1, "B", 1), (1, "C", 1), (3, "ẞ", 1), (3, "B", 1), (None, "X", 2), (None, "Y", 1), (4, "", 1)}
    for most in (1 << 17, 3, 1):
        monkeypatch.setattr(sk, "SLICE_WORDS", most)
        got = list(map(tuple, sk.simhash_tokens(texts).collect()))
        assert len(got) == len(want) and set(got) == want
    plan = sk.simhash_tokens(texts.where("doc_id > 2"))._jdf.queryExecution().executedPlan().toString()
    assert "Exchange" not in plan


def test_fingerprints_are_made_slice_by_slice(spark):
    batch = pa.RecordBatch.from_arrays([pa.array([1, 2, 3]), pa.array([["a"] * sk.SLICE_WORDS, ["b"] * sk.SLICE_WORDS, ["c", "b"]])], names=["doc_id", "words"])
    parts = list(sk._counted(batch))
    assert [(x[0].to_pylist(), x[1].to_pylist(), x[3].tolist()) for x in parts] == [([1], ["a"], [sk.SLICE_WORDS]), ([2], ["b"], [sk.SLICE_WORDS]), ([3], ["c", "b"], [1, 1])]
