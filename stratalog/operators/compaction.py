"""Compaction: rows keep their data and get a new (level, run).

Only run counts per level, or a manifest of key ranges, steer it; rows move once,
when the newest version in each new run is chosen.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from stratalog.operators.runs import run_content
from stratalog.schema import EngineConfig
from stratalog.sources.shared import numbered, written


def closed_form(ordinal: Column, runs: int, max_level: int) -> Column:
    """(level, run) of the flush numbered ``ordinal`` (from 1) after one call over ``runs`` flushes and empty levels above.

    From oldest to newest: blocks of 2 ** (max_level - 1) flushes in the last
    level, then one block for each set bit of the rest, larger first.
    """
    top = 1 << (max_level - 1)
    done = runs // top * top
    out = F.when(ordinal <= done, F.struct(F.lit(max_level).alias("level"), (F.floor((ordinal - 1) / top) + 1).cast("long").alias("run")))
    for bit in range(max_level - 2, -1, -1):
        if runs >> bit & 1:
            out = out.when((ordinal > done) & (ordinal <= done + (1 << bit)), F.struct(F.lit(bit + 1).alias("level"), F.lit(1).cast("long").alias("run")))
            done += 1 << bit
    return out


def size_tiered(content: DataFrame, max_level: int) -> DataFrame:
    """One call over (level, run, key, ts, seq, ...): pairs of runs merge into the next level, level by level.

    Run 1 of a level is its oldest; an odd run stays as run 1.  Tombstones stay.
    """
    counts = {r.level: r.n for r in content.groupBy("level").agg(F.max("run").alias("n")).collect()}
    level, run = F.col("level"), F.col("run")
    moved = content
    for at in range(1, max_level):
        n = counts.get(at, 0)
        if n < 2:
            continue
        above, pairs = counts.get(at + 1, 0), n // 2
        here = F.col("level") == at
        paired = here & (F.col("run") <= 2 * pairs)
        run = F.when(paired, F.lit(above) + F.ceil(F.col("run") / 2)).when(here, F.lit(1)).otherwise(F.col("run")).cast("long")
        level = F.when(paired, at + 1).otherwise(F.col("level"))
        moved = moved.withColumns({"level": level, "run": run})
        counts[at], counts[at + 1] = n - 2 * pairs, above + pairs
    return run_content(moved, "level", "run")


def resplit(rows: DataFrame, size: int) -> DataFrame:
    """Merge all rows by key and cut them, in key order, into files of ``size`` keys (``file`` from 0)."""
    from stratalog.operators.state import current

    return numbered(current(rows), "key").withColumn("file", F.floor((F.col("rn") - 1) / size).cast("long")).drop("rn")


def leveled(files: DataFrame, n_files: int, multiplier: int, max_level: int) -> DataFrame:
    """Level of each key-ordered file (``file`` from 0) after one call from empty levels above the first.

    Level i keeps at most multiplier ** (i - 1) files; the excess, lowest keys
    first, goes down (nothing there overlaps it).
    """
    out, high = F.lit(max_level), n_files
    branches = []
    for at in range(2, max_level):
        low = max(0, high - multiplier ** (at - 1))
        branches.append((at, low))
        high = low
    for at, low in reversed(branches):
        out = F.when(F.col("file") >= low, at).otherwise(out)
    return files.withColumn("level", out)


def leveled_compact(content: DataFrame, size: int, multiplier: int, max_level: int) -> DataFrame:
    """One leveled call over (level, run, key, ts, seq, ...); runs of level 2 and up are disjoint and numbered by key.

    Level 1 moves down as a whole; level i keeps multiplier ** (i - 1) runs and
    moves the excess, lowest keys first.  What moves is merged with the runs of
    the next level that overlap its key range and cut into files of ``size``
    keys, which take those runs' place in the order.  Only counts and the two
    ends of the moving range reach the driver; rows are written after each level.
    """
    rows = written(content, "levels")
    columns = content.columns
    for at in range(1, max_level):
        here, below = rows.where(F.col("level") == at), rows.where(F.col("level") == at + 1)
        n = here.agg(F.coalesce(F.max("run"), F.lit(0))).first()[0]
        excess = n - (multiplier ** (at - 1) if at > 1 else 0)
        if excess <= 0:
            continue
        moving = here.where(F.col("run") <= excess)
        low, high = moving.agg(F.min("key"), F.max("key")).first()
        ends = below.groupBy("run").agg(F.min("key").alias("min_key"), F.max("key").alias("max_key"))
        met = ends.where((F.col("max_key") >= low) & (F.col("min_key") <= high)).select("run")
        first, n_met, before = ends.agg(F.min(F.when((F.col("max_key") >= low) & (F.col("min_key") <= high), F.col("run"))), F.count_if((F.col("max_key") >= low) & (F.col("min_key") <= high)), F.count_if(F.col("max_key") < low)).first()
        first = first or before + 1
        files = written(resplit(moving.unionByName(below.join(met, "run", "left_semi").select(*columns)), size), "files")
        n_files = files.agg(F.max("file") + 1).first()[0]
        new = files.withColumns({"run": (F.col("file") + first).cast("long"), "level": F.lit(at + 1)}).select(*columns)
        untouched = below.join(met, "run", "left_anti").withColumn("run", F.when(F.col("run") < first, F.col("run")).otherwise(F.col("run") - n_met + n_files).cast("long")).select(*columns)
        stays = here.where(F.col("run") > excess).withColumn("run", (F.col("run") - excess).cast("long"))
        others = rows.where(~F.col("level").isin(at, at + 1))
        rows = written(others.unionByName(stays).unionByName(untouched).unionByName(new), "levels")
    return rows


def compact(content: DataFrame, config: EngineConfig) -> DataFrame:
    """One call of the compaction that the settings name."""
    if config.compaction_type == "leveled":
        return leveled_compact(content, config.memtable_size, config.leveled_compaction_multiplier, config.lsm_max_level)
    return size_tiered(content, config.lsm_max_level)


def store_levels(runs: DataFrame, config: EngineConfig) -> DataFrame:
    """The whole store after one compaction: (level, run, key, ...) with the open memtable as level 0, run 0.

    ``runs`` is a log with ``run`` and ``run_rank`` (see ``runs.ranked``).
    """
    filled = run_content(runs.where("run_rank > 0")).withColumn("level", F.lit(1))
    memtable = run_content(runs.where("run_rank = 0")).withColumns({"level": F.lit(0), "run": F.lit(0).cast("long")})
    columns = ["level", "run", "key", "value", "ts", "tombstone", "seq"]
    return compact(filled.select(*columns), config).select(*columns).unionByName(memtable.select(*columns))


def drop_tombstones(content: DataFrame, last_level: int) -> DataFrame:
    """Leave out tombstones in the last level (an extension; merges keep them)."""
    return content.where(~(F.col("tombstone") & (F.col("level") == last_level)))
