"""Reads, merges and runs on small logs."""

import random

import numpy as np
import pyarrow.parquet as pq
import pytest
from pyspark.sql import functions as F
from stratalog.functions import sketches
from stratalog.functions.hashing import slots
from stratalog.operators import compaction, memtable, registry, runs, state, stateful
from stratalog.schema import OPLOG, EngineConfig
from stratalog.sources import oplog, shared


def log(spark, rows):
    return spark.createDataFrame(rows, OPLOG)


def keys(df):
    return [r.key for r in df.orderBy("key").collect()]


def test_delete_hides_and_put_again_shows(spark):
    a = log(spark, [("k", "1", 1, False, 1), ("k", "", 2, True, 2), ("x", "1", 1, False, 3)])
    assert keys(state.live(a)) == ["x"]
    assert keys(state.current(a)) == ["k", "x"]
    again = a.union(log(spark, [("k", "3", 3, False, 4)]))
    assert state.get(again, "k").first().value == "3"


def test_tie_in_time_goes_to_later_operation(spark):
    a = log(spark, [("k", "old", 5, False, 1), ("k", "new", 5, False, 2)])
    assert state.get(a, "k").first().value == "new"


def test_delete_of_unknown_key_is_kept_as_tombstone(spark):
    a = oplog.delete(spark, [("k", 1, 1)])
    assert state.live(a).count() == 0 and state.current(a).first().tombstone


def test_merge_loses_nothing(spark):
    one = lambda *ks: log(spark, [(k, "v", 1, False, i) for i, k in enumerate(ks)])
    assert keys(state.merged(one("a"), one("b"))) == ["a", "b"]
    assert keys(state.merged(one("b"), one("a", "c"))) == ["a", "b", "c"]
    older, newer = log(spark, [("k", "older", 7, False, 9)]), log(spark, [("k", "newer", 7, False, 1)])
    assert state.merged(older, newer).first().value == "newer"


def test_pages_tile_the_scan(spark):
    a = log(spark, [(f"{i:03d}", "v", 1, i % 7 == 0, i) for i in range(50)])
    whole = [r.key for r in state.live(a).orderBy("key").collect()]
    pages = []
    for page in range(1, 8):
        pages += [r.key for r in state.range_scan(a, "000", "999", 8, page).collect()]
    assert pages == whole


@pytest.mark.parametrize("length,number", [(10, 0), (0, 1), (10, 99)])
def test_empty_pages(spark, length, number):
    a = log(spark, [("a", "v", 1, False, 1)])
    assert state.range_scan(a, "a", "z", length, number).count() == 0


def test_range_edges(spark):
    a = log(spark, [("", "e", 1, False, 1), ("a", "v", 1, False, 2), ("é", "v", 1, False, 3), ("z", "v", 1, False, 4)])
    assert keys(state.live(a.where(state.in_range("a", "a")))) == ["a"]
    assert state.live(a.where(state.in_range("z", "a"))).count() == 0
    assert keys(state.live(a)) == ["", "a", "z", "é"]


def test_reserved_keys_are_refused(spark):
    with pytest.raises(ValueError):
        oplog.put(spark, [("BloomFilterx", "v", 1, 1)])


def test_predicate_on_key_reaches_the_scan(spark, sf):
    plan = state.live(spark.read.parquet(f"{sf}/events.parquet").select(F.col("event_type").alias("key"), F.unix_seconds(F.col("ts").cast("timestamp")).alias("ts"), F.col("event_id").alias("seq"), F.lit(False).alias("tombstone")).where("key = 'click'"))
    assert "EqualTo(event_type,click)" in plan._jdf.queryExecution().executedPlan().toString()


def test_compaction_keeps_the_live_state(spark, sf):
    ops = oplog.from_events(spark, sf)
    before = sorted(map(tuple, state.live(ops).select("key", "seq").collect()))
    content = runs.run_content(runs.fixed_runs(ops, 40)).withColumns({"level": F.lit(1), "run": F.col("run") + 1})
    after = compaction.size_tiered(content, 7)
    assert sorted(map(tuple, state.live(after).select("key", "seq").collect())) == before
    split = compaction.resplit(ops, 40)
    assert split.count() == ops.select("key").distinct().count()
    assert split.groupBy("file").count().agg(F.max("count")).first()[0] <= 40


@pytest.mark.parametrize("n,top", [(1, 4), (7, 4), (250, 7), (599, 5)])
def test_closed_form_is_the_pairing(spark, n, top):
    levels = {1: list(range(1, n + 1)), **{i: [] for i in range(2, top + 1)}}
    levels = {i: [[x] for x in v] for i, v in levels.items()}
    for i in range(1, top):
        while len(levels[i]) >= 2:
            a, b, *rest = levels[i]
            levels[i + 1].append(a + b)
            levels[i] = rest
    want = {x: (lv, r + 1) for lv, blocks in levels.items() for r, block in enumerate(blocks) for x in block}
    got = spark.range(1, n + 1).select("id", compaction.closed_form(F.col("id"), n, top).alias("a")).collect()
    assert {r.id: (r.a.level, r.a.run) for r in got} == want


def test_leveled_calls_in_turn(spark):
    """Two calls with new runs in between, against a plain simulation."""
    size, multiplier, top = 4, 2, 4
    levels = {i: [] for i in range(1, top + 1)}

    def call():
        for at in range(1, top):
            keep = multiplier ** (at - 1) if at > 1 else 0
            if len(levels[at]) <= keep:
                continue
            moving, levels[at] = levels[at][: len(levels[at]) - keep], levels[at][len(levels[at]) - keep :]
            low, high = min(min(r) for r in moving), max(max(r) for r in moving)
            met = [r for r in levels[at + 1] if not (max(r) < low or min(r) > high)]
            merged = {}
            for r in met + moving:
                for k, v in r.items():
                    merged[k] = max(v, merged.get(k, v))
            keys = sorted(merged)
            cut = [{k: merged[k] for k in keys[i : i + size]} for i in range(0, len(keys), size)]
            levels[at + 1] = sorted([r for r in levels[at + 1] if r not in met] + cut, key=min)

    rows, seq, schema = None, 0, "level int, run long, key string, value string, ts long, tombstone boolean, seq long"
    for turn in range(2):
        for run in range(5):
            new = {}
            for i in range(size):
                seq += 1
                new[f"{(seq * 7 + turn * 5) % (23 + 20 * turn):03d}"] = seq
            levels[1].append(new)
            df = spark.createDataFrame([(1, run + 1, k, "v", v, False, v) for k, v in new.items()], schema)
            rows = df if rows is None else rows.unionByName(df)
        call()
        rows = compaction.leveled_compact(rows, size, multiplier, top)
        got = {(r.level, r.run, r.key, r.seq) for r in rows.collect()}
        assert got == {(lv, i + 1, k, v) for lv, rs in levels.items() for i, r in enumerate(rs) for k, v in r.items()}


def test_flush_counts_distinct_keys(spark):
    a = log(spark, [(k, "v", 1, False, i) for i, k in enumerate("aabacddab")])
    rows = runs.exact_runs(a, 3).orderBy("seq").collect()
    assert [r.seq for r in rows if r.flushed] == [4, 8]
    assert [r.seq for r in runs.tail(runs.exact_runs(a, 4)).collect()] == [6, 7, 8]


def test_registry_round_trip(spark):
    cells = spark.createDataFrame([(0, 3), (1, 5)], "bucket long, rank int")
    stored = registry.store(cells, "HyperLogLog", "x", 1, 1, "bucket", "rank")
    assert sorted(map(tuple, registry.load(stored, "HyperLogLog", "x", "bucket: bigint, rank: int").collect())) == [(0, 3), (1, 5)]
    assert registry.load(registry.remove(stored, "HyperLogLog", "x", 2, 2), "HyperLogLog", "x", "bucket: bigint, rank: int").count() == 0


def test_lru_delete_is_a_miss_until_read_again(spark):
    rows = spark.createDataFrame([(1, i, k, drop) for i, (k, drop) in enumerate([("a", False), ("a", False), ("a", True), ("a", False), ("a", False)])], "client int, seq long, key string, drop boolean")
    assert [r.hit for r in stateful.lru_hits(rows, 2).orderBy("seq").collect()] == [False, True, False, False, True]


def test_token_bucket_whole_refills(spark):
    rows = spark.createDataFrame([("c", i, t) for i, t in enumerate([0, 0, 0, 1, 3])], "client string, seq long, ts long")
    assert [r.accepted for r in stateful.token_bucket(rows, 0.5, 2).orderBy("seq").collect()] == [True, True, False, False, True]


def test_config_clamps(tmp_path):
    c = EngineConfig(wal_buffer_capacity=1, wal_water_mark=100_000, skiplist_max_height=200, lsm_max_level=2, compaction_type="x", memtable_size=0)
    assert (c.wal_buffer_capacity, c.wal_water_mark, c.skiplist_max_height, c.lsm_max_level, c.compaction_type, c.memtable_size) == (10, 99999, 99, 4, "size_tiered", 20)
    (tmp_path / "c.yml").write_text("memtable_size: 40\nmemtable_structure: skiplist # kind\n")
    assert EngineConfig.read(str(tmp_path / "c.yml")).memtable_size == 40


def test_reserved_keys_are_refused_after_trimming(spark):
    with pytest.raises(ValueError):
        oplog.put(spark, [(" BloomFilterx", "v", 1, 1)])
    requests = spark.createDataFrame([(" SimHash1 ", "v", 1, False, 1, "c"), (" k ", " v ", 2, False, 2, "c")], "key string, value string, ts long, tombstone boolean, seq long, client string")
    assert [(r.key, r.value) for r in stateful.admitted(requests, 1, 10).collect()] == [("k", "v")]


def test_refused_requests_are_not_applied(spark):
    requests = spark.createDataFrame([("a", "1", 0, False, 1, "c"), ("a", "2", 0, False, 2, "c"), ("a", "", 0, True, 3, "c"), ("a", "4", 9, False, 4, "d")], "key string, value string, ts long, tombstone boolean, seq long, client string")
    assert [r.seq for r in stateful.admitted(requests, 0.0, 2).orderBy("seq").collect()] == [1, 2, 4]


@pytest.mark.parametrize("run_block,probe_block", [(1024, 16384), (2, 3)])
def test_pruning_against_brute_force(run_block, probe_block, spark):
    m, k = 64, 2
    rows = [(i // 5, f"{i * 7 % 40:02d}", i) for i in range(40)]
    content = spark.createDataFrame([(r, key, "v", 1, False, i) for r, key, i in rows], "run long, key string, value string, ts long, tombstone boolean, seq long")
    probes = spark.createDataFrame([(f"{i:02d}",) for i in range(60)] + [("07",), (None,), ("é",)], "key string")
    bits = {r: set() for r, _, _ in rows}
    for r in sketches.bloom(content, m, k, "run").collect():
        bits[r.run].add(r.slot)
    asked = {r.key: {s.slot for s in r.s} for r in probes.where("key is not null").distinct().select("key", slots(F.col("key"), sketches.BASE, k, m).alias("s")).collect()}
    want = {}
    for run in bits:
        held = sorted(key for r, key, _ in rows if r == run)
        maybe = [key for key, s in asked.items() if s <= bits[run]]
        read = sum(held[0] <= key <= held[-1] for key in maybe)
        want[run] = (len(asked) - len(maybe), len(maybe) - read, read)
    got = runs.pruning_report(content, probes, m, k, run_block, probe_block).collect()
    assert {r.run: (r.n_bloom, r.n_range, r.n_read) for r in got} == want


def test_flushed_files_are_skipped_by_key(spark, sf, tmp_path):
    ops = oplog.from_orders(spark, sf)
    runs.flush(ops, str(tmp_path / "run"))
    found = runs.flushed(spark, str(tmp_path / "run"), F.col("key") == "00000007")
    assert "EqualTo(key,00000007)" in found._jdf.queryExecution().executedPlan().toString()
    want = state.current(ops).where("key = '00000007'")
    assert sorted(map(tuple, found.collect())) == sorted(map(tuple, want.collect()))
    files = pq.ParquetDataset(str(tmp_path / "run")).fragments
    ends = sorted((g.statistics["key"]["min"], g.statistics["key"]["max"]) for f in files for g in f.row_groups)
    assert ends and all(a[1] < b[0] for a, b in zip(ends, ends[1:], strict=False))


def test_manifest_names_the_next_run(spark, tmp_path):
    content = log(spark, [("a", "v", 1, False, 0), ("b", "v", 1, False, 1)]).withColumns({"level": F.lit(2), "run": F.lit(3).cast("long")})
    roots = spark.createDataFrame([(2, 3, "x")], "level int, run long, root string")
    runs.save_manifest(content, roots, str(tmp_path / "m"), "level", "run")
    manifest = spark.read.parquet(str(tmp_path / "m"))
    assert (manifest.first().min_key, manifest.first().max_key, manifest.first().root) == ("a", "b", "x")
    assert (runs.next_run(manifest, 2), runs.next_run(manifest, 1)) == (4, 1)


def test_open_memtable_is_newest(spark):
    a = log(spark, [(k, str(i), 1, False, i) for i, k in enumerate("abcabcab")])
    rows = runs.ranked(runs.exact_runs(a, 3))
    assert {r.seq: r.run_rank for r in rows.collect()} == {0: 2, 1: 2, 2: 2, 3: 1, 4: 1, 5: 1, 6: 0, 7: 0}
    page = state.recency_page(rows, state.in_range("a", "z"), 10, 1).collect()
    assert [(r.key, r.value) for r in page] == [("a", "6"), ("b", "7"), ("c", "5")]
    levels = compaction.store_levels(rows, EngineConfig(lsm_max_level=4)).collect()
    assert sorted((r.level, r.key, r.value) for r in levels) == [(0, "a", "6"), (0, "b", "7"), (2, "a", "3"), (2, "b", "4"), (2, "c", "5")]


def test_shared_folder_is_asked_for_on_a_cluster(spark):
    class Context:
        master = "spark://host:7077"

        def getCheckpointDir(self):
            return None

    class Session:
        sparkContext = Context()

        class conf:
            get = staticmethod(lambda name, default=None: default)

    with pytest.raises(RuntimeError):
        shared.shared_dir(Session())


@pytest.mark.parametrize(("n", "n_keys", "size", "block"), [(300, 12, 5, 16), (300, 4, 5, 16), (90, 6, 6, 4), (64, 3, 1, 16), (20, 4, 4, 1)])
def test_flush_boundaries_of_many_blocks(spark, n, n_keys, size, block):
    """As one pass over the log finds them; keys are skewed, rare keys make runs that span blocks, some logs never fill one."""
    rng = random.Random(n * n_keys + size)
    keys = [None if x == 2 else f"k{x}" for x in (min(int(n_keys * rng.random() ** 2), n_keys - 1) for _ in range(n))]
    run, held, want = 1, set(), []
    for i, key in enumerate(keys):
        held.add(key)
        full = len(held) == size
        want.append((i, run, full))
        if full:
            run, held = run + 1, set()
    log = spark.createDataFrame([(i, key, "x") for i, key in enumerate(keys)], "seq long, key string, kind string").repartition(3)
    got = memtable.exact_runs(log, size, block)
    assert sorted((r.seq, r.run, r.flushed) for r in got.collect()) == want
    assert got.columns == ["seq", "key", "kind", "run", "flushed"]


def test_flush_boundaries_of_no_log(spark):
    assert memtable.exact_runs(spark.createDataFrame([], "seq long, key string"), 3).count() == 0


def test_overlaps_with_equal_ends(spark):
    """Ranges that share a key overlap; single keys, repeated ranges and an empty manifest."""
    ranges = [("a", "c"), ("c", "d"), ("c", "c"), ("a", "c"), ("e", "f"), ("g", "g"), ("b", "z")]
    table = spark.createDataFrame([(i, lo, hi) for i, (lo, hi) in enumerate(ranges)], "run long, min_key string, max_key string")
    want = {i: sum(j != i and lo <= b and a <= hi for j, (a, b) in enumerate(ranges)) for i, (lo, hi) in enumerate(ranges)}
    assert {r.run: r.n_overlaps for r in runs.overlap_counts(table).collect()} == want
    assert runs.overlap_counts(table.limit(0)).count() == 0


@pytest.mark.parametrize("n,m,asked", [(3, 40, 5), (130, 64, 700), (70, 250, 1024)])
def test_filters_held_against_probes_in_words(n, m, asked):
    rng = np.random.default_rng(n)
    on, need = rng.random((n, m)) < 0.6, rng.integers(0, m, (asked, 3)).astype(np.int32)
    first, last = np.sort(rng.integers(0, asked + 1, (2, n)), axis=0)
    passed, read = runs._maybe(on, need, first, last)
    for i in range(n):
        maybe = on[i][need].all(1)
        assert (passed[i], read[i]) == (maybe.sum(), maybe[first[i] : last[i]].sum())


def test_pruning_with_runs_of_null_keys(spark):
    content = spark.createDataFrame([(1, None, False), (2, "b", False), (2, None, False)], "run long, key string, tombstone boolean")
    probes = spark.createDataFrame([("a",), ("b",)], "key string")
    got = {r.run: (r.n_bloom, r.n_range, r.n_read) for r in runs.pruning_report(content, probes, 1000, 5).collect()}
    assert got == {1: (2, 0, 0), 2: (1, 0, 1)}
