"""Exact flush boundaries of one log, found by many tasks.

A memtable that is opened at an operation is full at the operation that brings
the n-th distinct key.  Where that is depends on what follows only, so it is
found for every operation at once, block by block; the log's true boundaries are
then those that are reached from its first operation.
"""

from __future__ import annotations

from collections import OrderedDict
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from stratalog.functions.fold import by_group
from stratalog.sources.shared import numbered, written

BLOCK = 1 << 18  # operations that a task holds at once


def heads(ops: DataFrame, size: int, n_blocks: int) -> DataFrame:
    """(block, key, rn): the first ``size`` distinct keys from each block's beginning on, and where each is first.

    Asked for the blocks of ``ops``.  A block with fewer keys takes on those of the blocks behind it; what a row
    reaches over doubles in each round.
    """
    nearest = F.row_number().over(Window.partitionBy("block").orderBy("rn"))

    def first(rows: DataFrame) -> DataFrame:
        return rows.groupBy("block", "key").agg(F.min("rn").alias("rn")).withColumn("__n", nearest).where(F.col("__n") <= size).drop("__n")

    out, reach = written(first(ops), "heads"), 1
    while reach < n_blocks:
        short = out.groupBy("block").agg(F.count("*").alias("n")).where((F.col("n") < size) & (F.col("block") + reach < n_blocks)).select("block")
        if short.isEmpty():
            break
        behind = out.withColumn("block", F.col("block") - reach).join(short, "block", "left_semi")
        out, reach = written(first(out.unionByName(behind)), "heads"), 2 * reach
    return out


def jumps(ops: DataFrame, after: DataFrame, size: int, block: int) -> DataFrame:
    """For each operation where a memtable opened there is full, and where its successors leave the block.

    (block, rn, full, leaves, n): ``full`` is null where the log ends first;
    ``leaves`` is the first operation behind the block at which one of the
    successors opens, after ``n`` flushes, null if there is none.
    A task goes backwards through a block with ``size`` keys in hand, the least
    recently met one being the last to come.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for table in by_group(batches):
            b = table["block"][0].as_py()
            high = (b + 1) * block
            held: OrderedDict = OrderedDict()
            rns, full, leaves, n = [], [], [], []  # the block's last operation first
            for rn, key in zip(table["rn"].to_pylist(), table["key"].to_pylist(), strict=True):
                held[key] = rn
                held.move_to_end(key)
                if len(held) > size:
                    held.popitem(last=False)
                if rn > high:
                    continue
                rns.append(rn)
                end = next(iter(held.values())) if len(held) == size else None
                full.append(end)
                if end is None:
                    leaves.append(None)
                    n.append(0)
                elif end < rns[0]:
                    then = rns[0] - end - 1
                    leaves.append(leaves[then])
                    n.append(n[then] + 1)
                else:
                    leaves.append(end + 1)
                    n.append(1)
            columns = ([b] * len(rns), rns, full, leaves, n)
            yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in columns], names=["block", "rn", "full", "leaves", "n"])

    rows = ops.unionByName(after).repartition("block").sortWithinPartitions("block", F.desc("rn"))
    return rows.select("block", "rn", "key").mapInArrow(run, "block long, rn long, full long, leaves long, n long")


def reached(steps: DataFrame, n_blocks: int) -> DataFrame:
    """(rn, done): operations that lead in a block at which a memtable opens, and the flushes before; by pointer doubling.

    Every step leaves its block, so there are no more of them than blocks.
    """
    asked = steps.where("leaves is not null").select(F.col("leaves").alias("rn")).distinct()
    found = steps.where("rn = 1").select("rn", F.lit(0).cast("long").alias("done"))
    links = written(steps.join(asked, "rn", "left_semi").unionByName(steps.where("rn = 1")).where("leaves is not null").select("rn", "leaves", "n"), "links")
    for left in reversed(range(n_blocks.bit_length())):
        found = written(found.unionByName(found.join(links, "rn").select(F.col("leaves").alias("rn"), (F.col("done") + F.col("n")).alias("done"))), "found")
        if not left:
            break
        on = links.select(F.col("rn").alias("leaves"), F.col("leaves").alias("to"), F.col("n").alias("more"))
        links = written(links.join(on, "leaves").select("rn", F.col("to").alias("leaves"), (F.col("n") + F.col("more")).alias("n")), "links")
    return found


def exact_runs(oplog: DataFrame, size: int, block: int = BLOCK) -> DataFrame:
    """``oplog`` with ``run`` (from 1) and ``flushed``, true at the operation that fills a run.

    A memtable is flushed whenever it holds ``size`` distinct keys (a null key is
    one); operations are in the order of ``seq``.  Nothing but block numbers and
    counts reaches the driver, and a task holds one block of slim rows.
    """
    log = numbered(oplog, "seq", name="__rn")
    of = lambda rn: F.floor((rn - 1) / block).cast("long")
    ops = written(log.select(of(F.col("__rn")).alias("block"), F.col("__rn").alias("rn"), "key"), "operations")
    total = ops.count()
    if not total:
        return oplog.withColumns({"run": F.lit(1).cast("long"), "flushed": F.lit(False)})
    n_blocks = -(-total // block)
    after = heads(ops.where("block > 0"), size, n_blocks).withColumn("block", F.col("block") - 1)
    steps = written(jumps(ops, after, size, block), "jumps")
    opens = written(reached(steps, n_blocks).join(steps, "rn").select("block", "rn", "done", "leaves", "n"), "opens")

    # What a block has to be told: where its first memtable opens, which run goes on into it, and where that one ends.
    row = lambda kind, rn, value: (F.lit(kind).alias("kind"), rn.alias("rn"), value.alias("value"))
    none = F.lit(None).cast("long")
    going = F.col("done") + F.col("n") + F.when(F.col("leaves").isNull(), 1).otherwise(0)
    last = F.coalesce(of(F.col("leaves") - 1), F.lit(n_blocks - 1))
    goes_on = opens.where(last > F.col("block"))
    told = opens.select("block", *row(1, F.col("rn"), F.col("done")))
    told = told.unionByName(goes_on.select(F.explode(F.sequence(F.col("block") + 1, last)).alias("block"), *row(2, none, going)))
    told = told.unionByName(goes_on.where("leaves is not null").select(last.alias("block"), *row(3, F.col("leaves") - 1, none)))
    rows = steps.select("block", *row(0, F.col("rn"), F.col("full"))).unionByName(told)

    def assign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for table in by_group(batches):
            kind, rn, value = (table[c].to_numpy() for c in ("kind", "rn", "value"))
            own = kind == 0
            names, full = rn[own].astype(np.int64), table["value"].filter(pa.array(own)).fill_null(-1).to_numpy()
            run, flushed = np.zeros(len(names), np.int64), np.zeros(len(names), bool)
            run[:] = value[kind == 2][0] if (kind == 2).any() else 0
            flushed[rn[kind == 3].astype(np.int64) - names[0]] = True
            for at, number in zip((rn[kind == 1].astype(np.int64) - names[0]).tolist(), value[kind == 1].astype(np.int64).tolist(), strict=True):
                while at < len(names):
                    number += 1
                    end = int(full[at] - names[0]) if full[at] >= 0 else len(names)
                    run[at : end + 1] = number
                    flushed[end : end + 1] = True
                    at = end + 1
            yield pa.RecordBatch.from_arrays([pa.array(names), pa.array(run), pa.array(flushed)], names=["__rn", "run", "flushed"])

    runs = rows.select("block", "kind", "rn", "value").repartition("block").sortWithinPartitions("block", "kind", "rn").mapInArrow(assign, "__rn long, run long, flushed boolean")
    return log.join(runs, "__rn").drop("__rn")
