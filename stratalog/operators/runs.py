"""Sorted runs: flush boundaries, manifest, sparse index and pruning."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from stratalog.functions.fold import by_group, ordered_fold
from stratalog.functions.hashing import slots
from stratalog.functions.sketches import BASE
from stratalog.operators import memtable
from stratalog.operators.state import current
from stratalog.sources.shared import numbered, written


def fixed_runs(oplog: DataFrame, size: int) -> DataFrame:
    """``run``: slices of ``size`` operations. Distributes; the default for analytics."""
    return oplog.withColumn("run", F.floor(F.col("seq") / size).cast("long"))


def exact_runs(oplog: DataFrame, memtable_size: int, *shard: str) -> DataFrame:
    """``run`` (from 1) as a memtable makes them: a flush whenever ``memtable_size`` distinct keys are held.

    Without shards the log is one sequence, as a single store's log is; many
    tasks find its boundaries (see ``memtable``).  With shards each has its own
    memtable; a task streams through a shard and holds at most
    ``memtable_size`` keys.  ``flushed`` marks the operation that fills the run.
    """
    if not shard:
        return memtable.exact_runs(oplog, memtable_size)

    def step(state: tuple[int, set], values: tuple) -> tuple[tuple[int, set], tuple]:
        run, held = state
        held.add(values[0])
        if len(held) >= memtable_size:
            return (run + 1, set()), (run, True)
        return (run, held), (run, False)

    return ordered_fold(oplog, list(shard), ["seq"], ["key"], "run long, flushed boolean", lambda: (1, set()), step)


def flush_bounds(runs: DataFrame) -> DataFrame:
    """(run, end): the operation that ended each full run."""
    return runs.where("flushed").select("run", F.col("seq").alias("end"))


def tail(runs: DataFrame) -> DataFrame:
    """The open memtable: operations after the last flush."""
    open_run = runs.agg(F.max(F.when(F.col("flushed"), F.col("run"))).alias("last"))
    return runs.join(F.broadcast(open_run), F.col("run") > F.coalesce("last", F.lit(0))).drop("last")


def run_content(runs: DataFrame, *by: str) -> DataFrame:
    """The newest version of each key within each run."""
    by = by or ("run",)
    newest = F.row_number().over(Window.partitionBy(*by, "key").orderBy(F.desc("ts"), F.desc("seq")))
    return runs.withColumn("__n", newest).where("__n = 1").drop("__n")


def manifest(content: DataFrame, *by: str) -> DataFrame:
    """First and last key and number of entries of each run."""
    by = by or ("run",)
    return content.groupBy(*by).agg(F.min("key").alias("min_key"), F.max("key").alias("max_key"), F.count("*").alias("n"), F.count_if("tombstone").alias("n_tombstones"))


def placed(content: DataFrame, *by: str) -> DataFrame:
    """``content`` with ``rn``, each entry's place (from 1) in its run's key order.

    From a global number, so that a single large run is still many tasks' work.
    """
    by = by or ("run",)
    rows = written(numbered(content, *by, "key", name="__n"), "placed")
    first = rows.groupBy(*by).agg(F.min("__n").alias("__first"))
    return rows.join(first, list(by)).withColumn("rn", F.col("__n") - F.col("__first") + 1).drop("__n", "__first")


def _entries(rows: DataFrame, interval: int, *by: str) -> DataFrame:
    """(by..., entry, entry_key): every ``interval``-th key of each run, numbered from 0."""
    return rows.where((F.col("rn") - 1) % interval == 0).select(*by, F.floor((F.col("rn") - 1) / interval).cast("long").alias("entry"), F.col("key").alias("entry_key"))


def sparse_index(content: DataFrame, interval: int, *by: str) -> DataFrame:
    """Every ``interval``-th key of each run, with the next such key as upper bound."""
    by = by or ("run",)
    picked = written(_entries(placed(content, *by), interval, *by), "index")
    after = picked.select(*by, (F.col("entry") - 1).alias("entry"), F.col("entry_key").alias("next_key"))
    return picked.join(after, [*by, "entry"], "left").select(*by, F.col("entry_key").alias("key"), "next_key")


def lookup(content: DataFrame, probes: DataFrame, interval: int) -> DataFrame:
    """For each probe key that is there: the newest run that holds it, the index entry before it and the steps from there.

    (key, run, entry_key, steps, value, tombstone).  Runs that cannot hold a
    key never come up, as the join is on the key; ``pruning_report`` says how
    filters and ranges would have kept them away from a probe.
    """
    rows = written(placed(content), "placed")
    newest = F.row_number().over(Window.partitionBy("key").orderBy(F.desc("run")))
    found = rows.join(probes.select("key").distinct(), "key", "left_semi").withColumn("__n", newest).where("__n = 1")
    at = found.withColumns({"entry": F.floor((F.col("rn") - 1) / interval).cast("long"), "steps": ((F.col("rn") - 1) % interval).cast("long")})
    return at.join(_entries(rows, interval, "run"), ["run", "entry"]).select("key", "run", "entry_key", "steps", "value", "tombstone")


def next_run(manifest: DataFrame, level: int) -> int:
    """The number of a level's next run, by a manifest with levels."""
    return (manifest.where(F.col("level") == level).agg(F.max("run")).first()[0] or 0) + 1


def expected_size(level: Column | int, memtable_size: int) -> Column:
    """Entries of a run of a level when every key is new."""
    return (F.pow(F.lit(2.0), F.lit(level) - 1) * memtable_size).cast("long")


def ranked(runs: DataFrame) -> DataFrame:
    """``runs`` (as ``exact_runs`` gives them) with ``run_rank``: 0 for the open memtable, then 1 for the newest run, and so on."""
    last = runs.agg(F.coalesce(F.max(F.when(F.col("flushed"), F.col("run"))), F.lit(0)).alias("last"))  # one row
    return runs.join(F.broadcast(last), F.lit(True)).withColumn("run_rank", F.greatest(F.col("last") - F.col("run") + 1, F.lit(0))).drop("last")


def overlap_counts(runs: DataFrame) -> DataFrame:
    """(run, n_overlaps): other runs whose key range overlaps, for each run of a manifest with distinct runs.

    Counted, not paired.  Where the first and last keys of all runs stand in one
    order, first keys before equal last keys, a run's first key has behind it
    the runs that ended before, and its last key those that have begun; each is
    the key's place among all less its place among its kind.
    """
    runs = written(runs.select("run", "min_key", "max_key"), "ranges")
    begins, ends = (runs.select(F.col(c).alias("k"), F.lit(i).alias("kind"), "run") for i, c in enumerate(("min_key", "max_key")))
    every = written(numbered(begins.unionByName(ends), "k", "kind", "run", name="__n"), "ends")

    def others(of: DataFrame, kind: int, name: str) -> DataFrame:
        own = numbered(of.select("k", "run"), "k", "run", name="__own").select("run", "__own")
        return every.where(F.col("kind") == kind).join(own, "run").select("run", (F.col("__n") - F.col("__own")).alias(name))

    out = others(begins, 0, "ended").join(others(ends, 1, "begun"), "run")
    return out.select("run", (F.col("begun") - F.col("ended") - 1).alias("n_overlaps"))


CHUNK, TILE = 256, 8192  # probes and runs that are held against each other at once


def _counted(rows: np.ndarray) -> np.ndarray:
    """How often each bit is set in the rows of uint64 words; a power of two of rows, at most ``CHUNK``.

    Rows are added two by two, bit by bit: plane i holds digit i of all counts.
    """
    planes = [rows]
    while len(planes[0]) > 4:
        half, carry, out = len(planes[0]) // 2, None, []
        for x in planes:
            a, b = x[:half], x[half:]
            one, two = a ^ b, a & b
            if carry is not None:
                two |= one & carry
                one ^= carry
            out.append(one)
            carry = two
        planes = [*out, carry]
    ones = [np.unpackbits(x.view(np.uint8), axis=1, bitorder="little").sum(0, dtype=np.int32) for x in planes]
    return sum(x << i for i, x in enumerate(ones))


def _maybe(on: np.ndarray, need: np.ndarray, first: np.ndarray, last: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """For each run, how many probes its filter lets through, and how many of those in the places ``first`` to ``last``.

    ``on`` has a row for each run and a column for each slot; ``need`` the slots of each probe, in the order of keys.
    A word holds 64 runs' bits of a slot, so a probe is held against them by one AND for each of its slots.
    """
    k, m, places = need.shape[1], on.shape[1], -(-len(need) // CHUNK) * CHUNK
    padded = np.full((places, k), m)  # slot m is set in no filter
    padded[: len(need)] = need
    total, inside = np.zeros(len(on), np.int64), np.zeros(len(on), np.int64)
    for lo in range(0, len(on), TILE):
        own = on[lo : lo + TILE]
        n = len(own)
        wide = np.zeros((m + 1, -(-n // 64) * 64), bool)
        wide[:m, :n] = own.T
        words = np.packbits(wide, axis=1, bitorder="little").view(np.uint64)
        before = np.zeros((places // CHUNK + 1, n), np.int32)  # let through before each chunk
        other = np.empty((CHUNK, words.shape[1]), np.uint64)
        for c in range(places // CHUNK):
            slot = padded[c * CHUNK : (c + 1) * CHUNK]
            rows = words[slot[:, 0]]
            for j in range(1, k):
                rows &= np.take(words, slot[:, j], axis=0, out=other, mode="clip")
            before[c + 1] = before[c] + _counted(rows)[:n]
        total[lo : lo + n] = before[-1]
        for at, sign in ((last[lo : lo + n], 1), (first[lo : lo + n], -1)):
            count = before[at // CHUNK, np.arange(n)].astype(np.int64)
            for i in np.flatnonzero(at % CHUNK):  # the begun chunk
                count[i] += np.count_nonzero(own[i][need[at[i] // CHUNK * CHUNK : at[i]]].all(1))
            inside[lo : lo + n] += sign * count
    return total, inside


def pruning_report(content: DataFrame, probes: DataFrame, m: int, k: int, run_block: int = 32768, probe_block: int = 65536) -> DataFrame:
    """For each run: how many distinct probe keys its filter, or its key range, rules out, and how many are read.

    Packed filters of ``run_block`` runs meet ``probe_block`` probes in one
    task, which holds 64 runs against a probe by k words; the range test is two
    places among the sorted probes for each run, and only counts leave the
    task.  The probes are a stated set that has to be held against every run, in
    blocks; no pair of a run and a probe becomes a row.
    """
    asked = probes.select("key").where("key is not null").distinct()
    packed = lambda of: F.unhex(F.array_join(of, ""))
    fixed = lambda x, n: F.lpad(F.hex(x), n, "0")
    slot_list = packed(F.transform(slots(F.col("key"), BASE, k, m), lambda s: fixed(s["slot"], 8)))
    keys = written(numbered(asked.select("key", slot_list.alias("data")), "key"), "probes")
    content = written(content.select("run", "key", "tombstone"), "content")
    set_slots = content.where("key is not null").select("run", F.explode(slots(F.col("key"), BASE, k, m)).alias("s")).select("run", F.col("s.slot").alias("slot"))
    bit = F.call_function("shiftleft", F.lit(1).cast("long"), (F.col("slot") % 64).cast("int"))
    words = set_slots.groupBy("run", F.floor(F.col("slot") / 64).cast("int").alias("word")).agg(F.bit_or(bit).alias("bits"))
    cells = F.collect_list(F.concat(fixed(F.col("word"), 8), fixed(F.col("bits"), 16)))  # at most m / 64 of them
    filters = words.groupBy("run").agg(packed(cells).alias("data"))
    runs = written(manifest(content).join(filters, "run", "left").select("run", "min_key", "max_key", F.coalesce("data", F.lit(b"")).alias("data")), "filters")
    total = keys.count()
    n_runs, n_probes = max(1, -(-runs.count() // run_block)), max(1, -(-total // probe_block))
    part = lambda of, n, seed: F.pmod(F.xxhash64(F.lit(seed), of), F.lit(n)).cast("int")
    every = lambda n: F.explode(F.sequence(F.lit(0), F.lit(n - 1)))
    # No null in these rows: Spark's Arrow writer walks back over a column's nulls at every row.
    low, high = F.coalesce("min_key", F.lit("")), F.coalesce("max_key", F.lit(""))
    left = runs.select(part("run", n_runs, 1).alias("r"), every(n_probes).alias("p"), F.lit(True).alias("filter"), "run", low.alias("low"), high.alias("high"), "data")
    right = keys.select(every(n_runs).alias("r"), F.floor((F.col("rn") - 1) / probe_block).cast("int").alias("p"), F.lit(False).alias("filter"), F.lit(0).cast("long").alias("run"), F.col("key").alias("low"), F.lit("").alias("high"), "data")
    block = (F.col("r").cast("long") * n_probes + F.col("p")).alias("block")
    rows = left.unionByName(right).select(block, "filter", "run", "low", "high", "data").repartition(min(n_runs * n_probes, 4096), "block").sortWithinPartitions("block")

    def counts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for table in by_group(batches):
            own, ask = table.filter(table["filter"]), table.filter(pc.invert(table["filter"]))
            n, n_ask = own.num_rows, ask.num_rows
            if not n or not n_ask:
                continue
            # A run's first key stands before an equal probe, its last key behind it.
            ends = pa.table({"key": pa.chunked_array([*own["low"].chunks, *ask["low"].chunks, *own["high"].chunks]), "kind": np.repeat([0, 1, 2], [n, n_ask, n])})
            order = np.asarray(pc.sort_indices(ends, sort_keys=[("key", "ascending"), ("kind", "ascending")])).astype(np.int64)
            probe = (order >= n) & (order < n + n_ask)
            place = np.empty(len(order), np.int64)
            place[order] = np.cumsum(probe)
            need = np.frombuffer(b"".join(ask["data"].to_pylist()), ">i4").astype(np.int32).reshape(n_ask, k)[order[probe] - n]
            cells = np.frombuffer(b"".join(own["data"].to_pylist()), [("word", ">i4"), ("bits", ">i8")])
            filters = np.zeros((n, -(-m // 64)), np.int64)
            filters[np.repeat(np.arange(n), pc.binary_length(own["data"]).to_numpy() // 12), cells["word"]] = cells["bits"]
            on = np.unpackbits(filters.view(np.uint8), axis=1, bitorder="little")[:, :m].view(bool)
            passed, read = _maybe(on, need, place[:n], place[n + n_ask :])
            yield pa.RecordBatch.from_arrays([own["run"].combine_chunks(), pa.array(passed - read), pa.array(read)], names=["run", "n_range", "n_read"])

    sums = rows.mapInArrow(counts, "run long, n_range long, n_read long").groupBy("run").agg(F.sum("n_range").alias("n_range"), F.sum("n_read").alias("n_read"))
    n_range, n_read = F.coalesce("n_range", F.lit(0)), F.coalesce("n_read", F.lit(0))
    return runs.select("run").join(sums, "run", "left").select("run", (F.lit(total) - n_range - n_read).alias("n_bloom"), n_range.alias("n_range"), n_read.alias("n_read"))


def dump(content: DataFrame, *by: str) -> DataFrame:
    """Everything, tombstones too, by run and key."""
    return content.orderBy(*(by or ("run",)), "key")


def flush(oplog: DataFrame, path: str) -> None:
    """Write the newest versions as key-ordered files with a key filter, so that readers skip by range and filter."""
    current(oplog).repartitionByRange("key").sortWithinPartitions("key").write.mode("overwrite").option("parquet.bloom.filter.enabled#key", "true").parquet(path)


def flushed(spark: SparkSession, path: str, where: Column) -> DataFrame:
    """Entries of flushed files that meet ``where``, a predicate on the key that reaches the scan."""
    return spark.read.parquet(path).where(where)


def save_manifest(content: DataFrame, roots: DataFrame, path: str, *by: str) -> None:
    """Write each run's key range, sizes and Merkle root."""
    manifest(content, *by).join(roots, list(by or ("run",))).write.mode("overwrite").parquet(path)
