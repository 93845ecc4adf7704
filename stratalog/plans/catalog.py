"""Registered queries of the key-value engine and their DuckDB counterparts."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import replace

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from stratalog.functions import sketches as sk
from stratalog.functions.hashing import fnv1a_32, seed_hex
from stratalog.operators import compaction, integrity, registry, runs, state, stateful
from stratalog.schema import EngineConfig
from stratalog.sources import oplog, records
from stratalog.sources.shared import numbered, place, written

SETTINGS = EngineConfig(memtable_size=40, sstable_interval=10, lsm_max_level=7, leveled_compaction_multiplier=3, wal_water_mark=20)
MEMTABLE = SETTINGS.memtable_size
INTERVAL = SETTINGS.sstable_interval
MAX_LEVEL = SETTINGS.lsm_max_level
MULTIPLIER = SETTINGS.leveled_compaction_multiplier
WAL_MARK = SETTINGS.wal_water_mark

_QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
_SQL: dict[str, str] = {}

# Op logs in DuckDB, as the adapters in sources.oplog make them.
F1 = "f1 as (select lpad(cast(user_id as varchar), 6, '0') as key, event_type as value, cast(epoch(date_trunc('second', ts)) as bigint) as ts, event_type = 'error' as tombstone, event_id as seq, value as amount from events)"
F2 = "f2 as (select lpad(cast(o_custkey as varchar), 8, '0') as key, o_orderpriority as value, cast(epoch(date_trunc('second', o_orderdate)) as bigint) as ts, o_orderstatus = 'F' as tombstone, o_orderkey as seq, o_totalprice as amount from orders)"
F3 = "f3 as (select lpad(cast(o_orderkey as varchar), 10, '0') as key, o_orderpriority as value, cast(epoch(date_trunc('second', o_orderdate)) as bigint) as ts, false as tombstone, o_orderkey as seq from orders)"
F4 = "f4 as (select c_name as key, c_mktsegment as value, c_custkey as seq from customer)"


def newest(of: str, name: str = "cur", order: str = "ts desc, seq desc", by: str = "key") -> str:
    return f"{name} as (select * exclude (rn_) from (select *, row_number() over (partition by {by} order by {order}) rn_ from {of}) where rn_ = 1)"


def query(name: str, sql: str | None = None) -> Callable:
    def add(f: Callable) -> Callable:
        _QUERIES[name] = f
        if sql is not None:
            _SQL[name] = sql
        return f

    return add


# --- newest versions and reads ---


@query("current_versions", f"with {F1}, {newest('f1')} select key, value, ts, tombstone, seq from cur")
def current_versions(spark, d):
    return state.current(oplog.from_events(spark, d)).select("key", "value", "ts", "tombstone", "seq")


@query("live_state", f"with {F1}, {newest('f1')} select key, value, ts, seq, amount from cur where not tombstone")
def live_state(spark, d):
    return state.live(oplog.from_events(spark, d)).select("key", "value", "ts", "seq", "amount")


@query("live_state_ties", f"with {F2}, {newest('f2')} select key, value, ts, seq, amount from cur where not tombstone")
def live_state_ties(spark, d):
    return state.live(oplog.from_orders(spark, d)).select("key", "value", "ts", "seq", "amount")


@query("get_point", f"with {F1}, {newest('f1')} select key, value, ts, seq from cur where key = '000007' and not tombstone")
def get_point(spark, d):
    return state.get(oplog.from_events(spark, d), "000007").select("key", "value", "ts", "seq")


@query("multi_get", f"""with {F1}, {newest('f1')}, asked as (select distinct lpad(cast(c_custkey as varchar), 6, '0') as key from customer)
select asked.key, coalesce(not tombstone, false) as found, case when not tombstone then value end as value, case when not tombstone then seq end as seq from asked left join cur using (key)""")
def multi_get(spark, d):
    keys = oplog.table(spark, d, "customer").select(F.lpad(F.col("c_custkey").cast("string"), 6, "0").alias("key"))
    return state.multi_get(oplog.from_events(spark, d), keys).select("key", "found", "value", "seq")


@query("range_scan_page", f"with {F1}, {newest('f1')} select key, value, ts, seq, amount from cur where not tombstone and key between '000010' and '000060' order by key limit 10 offset 10")
def range_scan_page(spark, d):
    return state.range_scan(oplog.from_events(spark, d), "000010", "000060", 10, 2).select("key", "value", "ts", "seq", "amount")


@query("range_scan_all", f"with {F2}, {newest('f2')} select key, value, seq from cur where not tombstone and key between '00000100' and '00000900'")
def range_scan_all(spark, d):
    return state.live(oplog.from_orders(spark, d).where(state.in_range("00000100", "00000900"))).select("key", "value", "seq")


@query("list_scan_page", f"with {F4} select key, value, seq from f4 where starts_with(key, 'Customer#0000001') order by key limit 10 offset 10")
def list_scan_page(spark, d):
    return state.list_scan(oplog.from_customers(spark, d), "Customer#0000001", 10, 2).select("key", "value", "seq")


@query("list_scan_urls", f"with p as (select url as key, page_id as seq, cast(length(html) as bigint) as n from pages), {newest('p', order='seq desc')} select key, seq, n from cur where starts_with(key, 'https://')")
def list_scan_urls(spark, d):
    return state.live(oplog.from_pages(spark, d).where(state.has_prefix("https://"))).select("key", "seq", F.length("value").cast("long").alias("n"))


PAGES = ((10, 0), (0, 1), (10, 1), (10, 3), (7, 5), (10, 99))


@query("empty_page", f"with {F1}, {newest('f1')}, n as (select count(*) n from cur where not tombstone and key between '000010' and '000060') select length, number, cast(case when length < 1 or number < 1 then 0 else greatest(0, least(length, n - (number - 1) * length)) end as bigint) as n_rows from (values {', '.join(map(str, PAGES))}) t(length, number) cross join n")
def empty_page(spark, d):
    """How many rows each page has: none for page 0, length 0 and pages past the end."""
    ops = oplog.from_events(spark, d)
    out = None
    for length, number in PAGES:
        one = state.range_scan(ops, "000010", "000060", length, number).agg(F.lit(length).alias("length"), F.lit(number).alias("number"), F.count("*").alias("n_rows"))
        out = one if out is None else out.unionByName(one)
    return out


@query("recency_page", f"with {F1}, r as (select *, seq // {MEMTABLE} as run from f1), {newest('r', order='run desc, ts desc, seq desc')} select key, value, seq, run from cur where not tombstone and key between '000010' and '000060' order by run desc, key limit 10 offset 10")
def recency_page(spark, d):
    rows = runs.fixed_runs(oplog.from_events(spark, d), MEMTABLE).withColumn("run_rank", -F.col("run"))
    return state.recency_page(rows, state.in_range("000010", "000060"), 10, 2).select("key", "value", "seq", "run")


@query("result_projection", f"with {F1}, {newest('f1')} select key, value, strftime(to_timestamp(ts) at time zone 'UTC', '%Y-%m-%d %H:%M:%S') as at from cur where not tombstone")
def result_projection(spark, d):
    at = F.date_format(F.timestamp_seconds("ts"), "yyyy-MM-dd HH:mm:ss")
    return state.live(oplog.from_events(spark, d)).select("key", "value", at.alias("at"))


@query("physical_remove", f"with {F2} select key, seq from f2 where key not in (select key from f2 where tombstone and ts < 800000000)")
def physical_remove(spark, d):
    ops = oplog.from_orders(spark, d)
    return state.without(ops, ops.where("tombstone and ts < 800000000")).select("key", "seq")


@query("as_of_state", f"with {F2}, g as (select * from f2 where ts <= 800000000), {newest('g')} select key, value, seq from cur where not tombstone")
def as_of_state(spark, d):
    return state.as_of(oplog.from_orders(spark, d), 800_000_000).select("key", "value", "seq")


@query("reserved_filter", "with k as (select page_id as seq, case when page_id % 3 = 0 then 'HyperLogLog' || url else url end as key from pages) select seq, key from k where not regexp_matches(key, '^(BloomFilter|CountMinSketch|HyperLogLog|SimHash)')")
def reserved_filter(spark, d):
    keys = oplog.table(spark, d, "pages").select(F.col("page_id").alias("seq"), F.when(F.col("page_id") % 3 == 0, F.concat(F.lit("HyperLogLog"), "url")).otherwise(F.col("url")).alias("key"))
    return keys.where(~oplog.is_reserved("key"))


@query("numeric_token", "select url as key, regexp_matches(url, '[0-9]') as numeric from pages")
def numeric_token(spark, d):
    return oplog.table(spark, d, "pages").select(F.col("url").alias("key"), oplog.has_digit("url").alias("numeric"))


@query("trim_input", r"select page_id, md5(regexp_replace(html, '^[ \t\n\x0B\f\r]+|[ \t\n\x0B\f\r]+$', '', 'g')) as trimmed from pages")
def trim_input(spark, d):
    return oplog.table(spark, d, "pages").select("page_id", F.md5(oplog.normalised("html")).alias("trimmed"))


# --- log and runs ---

BOUNDS = f"""p as (select event_id q, lag(event_id) over (partition by user_id order by event_id) pq from events),
w(run, e) as (select 0::bigint, -1::bigint union all
 select run, e from (select w.run + 1 run, p.q e, row_number() over (order by p.q) rn from w join p on p.q > w.e and coalesce(p.pq, -1) <= w.e) where rn = {MEMTABLE})"""


@query("flush_bounds", f"with recursive {BOUNDS} select run, e as \"end\" from w where run > 0")
def flush_bounds(spark, d):
    return runs.flush_bounds(runs.exact_runs(oplog.from_events(spark, d), MEMTABLE))


@query("wal_segments", f"with recursive {BOUNDS}, {F1}, b as (select run, e, lag(e) over (order by run) as s from w), x as (select count(*) n from w where run > 0) select seq, key, coalesce(run, n + 1) as segment from f1 left join b on seq > s and seq <= e cross join x")
def wal_segments(spark, d):
    return runs.exact_runs(oplog.from_events(spark, d), MEMTABLE).select("seq", "key", F.col("run").alias("segment"))


@query("wal_replay_tail", f"with recursive {BOUNDS}, {F1}, t as (select * from f1 where seq > (select max(e) from w)), {newest('t', order='seq desc')} select key, value, ts, tombstone, seq from cur")
def wal_replay_tail(spark, d):
    return state.current(runs.tail(runs.exact_runs(oplog.from_events(spark, d), MEMTABLE)), F.desc("seq")).select("key", "value", "ts", "tombstone", "seq")


@query("wal_latest_segment", f"with {F1}, s as (select *, seq // 1000 as segment from f1) select segment, seq, key from s where segment = (select max(segment) from s)")
def wal_latest_segment(spark, d):
    log = runs.fixed_runs(oplog.from_events(spark, d), 1000).withColumnRenamed("run", "segment")
    return oplog.latest_segment(log).select("segment", "seq", "key")


@query("wal_retention", f"with {F1}, s as (select *, seq // 100 as segment from f1), m as (select max(segment) n from s) select cast(case when n > {WAL_MARK} then 0 else segment end as bigint) as segment, seq, key from s cross join m where n <= {WAL_MARK} or segment = n")
def wal_retention(spark, d):
    log = runs.fixed_runs(oplog.from_events(spark, d), 100).withColumnRenamed("run", "segment")
    return oplog.retained(log, WAL_MARK).select(F.col("segment").cast("long").alias("segment"), "seq", "key")


def _flushed(spark, d):
    return runs.run_content(runs.fixed_runs(oplog.from_events(spark, d), MEMTABLE))


CONTENT = f"{F1}, r as (select *, seq // {MEMTABLE} as run from f1), {newest('r', 'content', by='run, key')}"


@query("flush_runs", f"with {CONTENT} select run, key, value, ts, tombstone, seq from content")
def flush_runs(spark, d):
    return _flushed(spark, d).select("run", "key", "value", "ts", "tombstone", "seq")


@query("dump_all", f"with {CONTENT} select run, key, value, tombstone from content")
def dump_all(spark, d):
    return runs.dump(_flushed(spark, d)).select("run", "key", "value", "tombstone")


@query("run_manifest", f"with {CONTENT} select run, min(key) as min_key, max(key) as max_key, count(*) as n, cast(count(*) filter (where tombstone) as bigint) as n_tombstones from content group by run")
def run_manifest(spark, d):
    return runs.manifest(_flushed(spark, d))


@query("sparse_index", f"with {F3}, x as (select seq // {MEMTABLE} as run, key, row_number() over (partition by seq // {MEMTABLE} order by key) rn from f3) select run, key, lead(key) over (partition by run order by key) as next_key from x where (rn - 1) % {INTERVAL} = 0")
def sparse_index(spark, d):
    return runs.sparse_index(runs.fixed_runs(oplog.from_order_keys(spark, d), MEMTABLE), INTERVAL)


@query("run_address", "select distinct cast(1 + o_orderkey % 3 as integer) as level, cast(o_orderkey // 3 as integer) as run from orders")
def run_address(spark, d):
    path = F.format_string("level%d/sstable%d", 1 + F.col("o_orderkey") % 3, F.floor(F.col("o_orderkey") / 3))
    return oplog.table(spark, d, "orders").select(path.alias("path")).distinct().select(oplog.run_address().alias("a")).select("a.level", "a.run").distinct()


@query("overlap_runs", f"with {CONTENT}, m as (select run, min(key) lo, max(key) hi from content group by run) select a.run, cast(count(b.run) as bigint) as n_overlaps from m a left join m b on a.run <> b.run and not (a.hi < b.lo or a.lo > b.hi) group by a.run")
def overlap_runs(spark, d):
    return runs.overlap_counts(runs.manifest(_flushed(spark, d)))


def _customer_keys(spark, d):
    return oplog.table(spark, d, "customer").select(F.lpad(F.col("c_custkey").cast("string"), 6, "0").alias("key"))


def _slot(key: str, base: int, i: int, m: int) -> str:
    return f"cast(('0x' || substr(md5(unhex(hex(encode({key})) || '{seed_hex(base, i)}')), 1, 16))::ubigint % {m} as bigint)"


def _slots(key: str, m: int, k: int) -> str:
    return "[" + ", ".join(f"{{'i': {i}, 'slot': {_slot(key, sk.BASE, i, m)}}}" for i in range(k)) + "]"


PRUNE_M, PRUNE_K = sk.bloom_params(MEMTABLE, 0.05)


@query("pruning_report", f"""with {CONTENT}, bits as (select distinct run, s.slot from (select run, unnest({_slots('key', PRUNE_M, PRUNE_K)}) s from content)),
asked as (select distinct lpad(cast(c_custkey as varchar), 6, '0') as key from customer),
one as (select distinct key, s.slot from (select key, unnest({_slots('key', PRUNE_M, PRUNE_K)}) s from asked)),
met as (select run, key, count(*) n from one join bits using (slot) group by run, key),
maybe as (select run, met.key from met join (select key, count(*) need from one group by key) x on x.key = met.key and need = n),
m as (select run, min(key) lo, max(key) hi from content group by run),
s as (select m.run, count(maybe.key) filter (where maybe.key < lo or maybe.key > hi) n_range, count(maybe.key) filter (where maybe.key between lo and hi) n_read from m left join maybe on m.run = maybe.run group by m.run)
select run, (select count(*) from asked) - n_range - n_read as n_bloom, n_range, n_read from s""")
def pruning_report(spark, d):
    return runs.pruning_report(_flushed(spark, d), _customer_keys(spark, d), PRUNE_M, PRUNE_K)


@query("run_lookup", f"""with {CONTENT}, x as (select *, row_number() over (partition by run order by key) - 1 as at from content), {newest('x', 'top', order='run desc')},
asked as (select distinct lpad(cast(c_custkey as varchar), 6, '0') as key from customer)
select top.key, top.run, x.key as entry_key, top.at % {INTERVAL} as steps, top.value, top.tombstone from top join asked using (key) join x on x.run = top.run and x.at = top.at - top.at % {INTERVAL}""")
def run_lookup(spark, d):
    return runs.lookup(_flushed(spark, d), _customer_keys(spark, d), INTERVAL)


@query("flushed_scan", f"with {F1}, {newest('f1')} select key, value, ts, tombstone, seq from cur where key between '000010' and '000060'")
def flushed_scan(spark, d):
    path = place(spark, "flushed")
    runs.flush(oplog.from_events(spark, d), path)
    return runs.flushed(spark, path, state.in_range("000010", "000060")).select("key", "value", "ts", "tombstone", "seq")


SEGMENTS = f"{BOUNDS}, {F1}, b as (select run, e, lag(e) over (order by run) as s from w), x as (select count(*) n from w where run > 0), g as (select f1.*, coalesce(run, n + 1) as segment, n from f1 left join b on seq > s and seq <= e cross join x)"


@query("memtable_page", f"with recursive {SEGMENTS}, {newest('g', order='segment desc, ts desc, seq desc')} select key, value, seq, cast(n + 1 - segment as bigint) as run_rank from cur where not tombstone and key between '000010' and '000060' order by segment desc, key limit 20 offset 0")
def memtable_page(spark, d):
    """A page over the open memtable and the runs, newest first."""
    rows = runs.ranked(runs.exact_runs(oplog.from_events(spark, d), MEMTABLE))
    return state.recency_page(rows, state.in_range("000010", "000060"), 20, 1).select("key", "value", "seq", "run_rank")


@query("log_append", f"with {F1} select key, value, ts, tombstone, seq from f1")
def log_append(spark, d):
    """A log written by two appends and read back in order."""
    path = place(spark, "log")
    ops = oplog.from_events(spark, d).select("key", "value", "ts", "tombstone", "seq")
    for i in range(2):
        oplog.append(ops.where(F.col("seq") % 2 == i), path)
    return oplog.read(spark, path)


@query("log_dump", f"with {F3} select seq // {MEMTABLE} as segment, seq % {MEMTABLE} as n, key, value, ts, tombstone, true as sound from f3")
def log_dump(spark, d):
    """Every record of the segment files, in order."""
    files = written(records.segmented(oplog.from_order_keys(spark, d), MEMTABLE), "segments")
    return records.decoded(files).withColumn("segment", oplog.segment_number("path").cast("long")).select("segment", "n", "key", "value", "ts", "tombstone", "sound").orderBy("segment", "n")


# --- compaction ---


@query("merge_two_runs", f"with {F2}, r as (select *, seq % 2 as age from f2), {newest('r', 'each', by='age, key')}, {newest('each', order='ts desc, age desc, seq desc')} select key, value, ts, tombstone, seq from cur")
def merge_two_runs(spark, d):
    ops = oplog.from_orders(spark, d)
    older, newer = (state.current(ops.where(F.col("seq") % 2 == i)) for i in (0, 1))
    return state.merged(older, newer).select("key", "value", "ts", "tombstone", "seq")


@query("merge_k_resplit", f"with {F2}, {newest('f2')}, n as (select *, row_number() over (order by key) rn from cur) select key, seq, tombstone, (rn - 1) // {MEMTABLE} as file from n")
def merge_k_resplit(spark, d):
    return compaction.resplit(oplog.from_orders(spark, d), MEMTABLE).select("key", "seq", "tombstone", "file")


def _tiers(n: str, r: str) -> str:
    """(level, run) of flush r of n, from the pairing rule: blocks by the binary digits of n."""
    top = 1 << (MAX_LEVEL - 1)
    done = f"({n} // {top} * {top})"
    level, run = f"when {r} <= {done} then {MAX_LEVEL}", f"when {r} <= {done} then ({r} - 1) // {top} + 1"
    for bit in range(MAX_LEVEL - 2, -1, -1):
        level += f" when ({n} >> {bit}) & 1 = 1 and {r} > ({n} >> {bit + 1} << {bit + 1}) and {r} <= ({n} >> {bit} << {bit}) then {bit + 1}"
        run += f" when {r} > {done} then 1" if bit == MAX_LEVEL - 2 else ""
    return f"case {level} end as level, case {run} end as tier_run"


TIERED = f"{CONTENT}, n as (select max(run) + 1 n from content), t as (select content.* exclude (run), {_tiers('n', '(run + 1)')} from content cross join n), {newest('t', 'tiered', by='level, tier_run, key')}"


@query("size_tiered_levels", f"with {TIERED} select cast(level as integer) as level, cast(tier_run as bigint) as run, count(*) as n, min(key) as min_key, max(key) as max_key from tiered group by 1, 2")
def size_tiered_levels(spark, d):
    rows = _flushed(spark, d).withColumns({"level": F.lit(1), "run": F.col("run") + 1})
    return runs.manifest(compaction.size_tiered(rows, MAX_LEVEL), "level", "run").select(F.col("level").cast("int").alias("level"), "run", "n", "min_key", "max_key")


@query("size_tiered_live", f"with {F1}, {newest('f1')} select key, value, seq from cur where not tombstone")
def size_tiered_live(spark, d):
    rows = _flushed(spark, d).withColumns({"level": F.lit(1), "run": F.col("run") + 1})
    return state.live(compaction.size_tiered(rows, MAX_LEVEL)).select("key", "value", "seq")


@query("size_tiered_closed_form", f"select o_orderkey as r, {_tiers('(select count(*) from orders)', '(o_orderkey + 1)').replace('as tier_run', 'as run')} from orders")
def size_tiered_closed_form(spark, d):
    orders = oplog.table(spark, d, "orders")
    n = orders.count()
    return orders.select(F.col("o_orderkey").alias("r"), compaction.closed_form(F.col("o_orderkey") + 1, n, MAX_LEVEL).alias("a")).select("r", "a.level", "a.run")


def _leveled_sql() -> str:
    out, high = [], "(max(file) over () + 1)"
    for at in range(2, MAX_LEVEL):
        low = f"greatest(0, {high} - {MULTIPLIER ** (at - 1)})"
        out.append(f"when file >= {low} then {at}")
        high = low
    return "case " + " ".join(out) + f" else {MAX_LEVEL} end"


@query("leveled_files", f"with {F3}, x as (select key, (row_number() over (order by key) - 1) // {MEMTABLE} as file from f3), l as (select file, {_leveled_sql()} as level from (select distinct file from x)) select level, count(*) as n_files, min(file) as first_file, max(file) as last_file from l group by level")
def leveled_files(spark, d):
    files = compaction.resplit(oplog.from_order_keys(spark, d), MEMTABLE).select("file").distinct()
    n = files.agg(F.max("file") + 1).first()[0]
    return compaction.leveled(files, n, MULTIPLIER, MAX_LEVEL).groupBy("level").agg(F.count("*").alias("n_files"), F.min("file").alias("first_file"), F.max("file").alias("last_file"))


def _leveled_run_sql() -> str:
    low, out = "(max(file) over () + 1)", []
    for at in range(2, MAX_LEVEL):
        low = f"greatest(0, {low} - {MULTIPLIER ** (at - 1)})"
        out.append(f"when file >= {low} then file - {low} + 1")
    return "case " + " ".join(out) + " else file + 1 end"


@query("leveled_compaction", f"with {F2}, {newest('f2')}, x as (select key, seq, tombstone, (row_number() over (order by key) - 1) // {MEMTABLE} as file from cur) select key, seq, tombstone, cast({_leveled_sql()} as integer) as level, cast({_leveled_run_sql()} as bigint) as run from x")
def leveled_compaction(spark, d):
    log = runs.fixed_runs(oplog.from_orders(spark, d), 400)
    rows = runs.run_content(log).withColumns({"level": F.lit(1), "run": F.col("run") + 1})
    return compaction.leveled_compact(rows, MEMTABLE, MULTIPLIER, MAX_LEVEL).select("key", "seq", "tombstone", F.col("level").cast("int").alias("level"), "run")


@query("tombstone_gc", f"with {TIERED} select cast(level as integer) as level, key, seq from tiered where not (tombstone and level = {MAX_LEVEL})")
def tombstone_gc(spark, d):
    rows = _flushed(spark, d).withColumns({"level": F.lit(1), "run": F.col("run") + 1})
    return compaction.drop_tombstones(compaction.size_tiered(rows, MAX_LEVEL), MAX_LEVEL).select(F.col("level").cast("int").alias("level"), "key", "seq")


@query("store_dump", f"""with recursive {SEGMENTS}, filled as (select * exclude (n) from g where segment <= n), {newest('filled', 'content', by='segment, key')},
t as (select content.* exclude (segment), {_tiers('n', 'segment')} from content cross join x), {newest('t', 'tiered', by='level, tier_run, key')},
opened as (select * from g where segment > n), {newest('opened', 'memtable')}
select cast(level as integer) as level, cast(tier_run as bigint) as run, key, value, tombstone, seq from tiered union all select 0, 0, key, value, tombstone, seq from memtable""")
def store_dump(spark, d):
    """Everything the store holds: the open memtable and every level."""
    rows = runs.ranked(runs.exact_runs(oplog.from_events(spark, d), MEMTABLE))
    return compaction.store_levels(rows, SETTINGS).select(F.col("level").cast("int").alias("level"), "run", "key", "value", "tombstone", "seq")


@query("configured_compaction", f"""with {F2}, r as (select *, seq // 400 as run from f2), {newest('r', 'content', by='run, key')}, n as (select max(run) + 1 n from content),
t as (select content.* exclude (run), {_tiers('n', '(run + 1)')} from content cross join n), {newest('t', 'tiered', by='level, tier_run, key')},
{newest('f2')}, y as (select (row_number() over (order by key) - 1) // {MEMTABLE} as file from cur), l as (select {_leveled_sql()} as level from y)
select 'size_tiered' as kind, cast(level as integer) as level, count(*) as n from tiered group by 2 union all select 'leveled', cast(level as integer), count(*) from l group by 2""")
def configured_compaction(spark, d):
    """Entries in each level after either kind of compaction, as the settings choose it."""
    content = runs.run_content(runs.fixed_runs(oplog.from_orders(spark, d), 400)).withColumns({"level": F.lit(1), "run": F.col("run") + 1}).select("level", "run", "key", "value", "ts", "tombstone", "seq")
    out = None
    for kind in ("size_tiered", "leveled"):
        one = compaction.compact(content, replace(SETTINGS, compaction_type=kind)).groupBy(F.col("level").cast("int").alias("level")).agg(F.lit(kind).alias("kind"), F.count("*").alias("n"))
        out = one if out is None else out.unionByName(one)
    return out.select("kind", "level", "n")


@query("expected_run_size", f"select cast(unnest(range(1, {MAX_LEVEL + 1})) as integer) as level, cast(pow(2, unnest(range(1, {MAX_LEVEL + 1})) - 1) * {MEMTABLE} as bigint) as size")
def expected_run_size(spark, d):
    return spark.range(1, MAX_LEVEL + 1).select(F.col("id").cast("int").alias("level"), runs.expected_size(F.col("id"), MEMTABLE).alias("size"))


# --- sketches ---

BLOOM_P = 0.01
BLOOM_K = sk.bloom_params(1000, BLOOM_P)[1]  # depends on the rate alone
CMS_M, CMS_K = sk.cms_params(0.01, 0.01)
P = 12


@query("bloom_params", "select n, p, cast(ceil(n * abs(ln(p)) / pow(ln(2), 2)) as integer) as m, cast(ceil(ceil(n * abs(ln(p)) / pow(ln(2), 2)) / n * ln(2)) as integer) as k from (values (40, 2.0::double), (100, 0.01::double), (1000, 0.001::double)) t(n, p)")
def bloom_params(spark, d):
    return spark.createDataFrame([(n, p, *sk.bloom_params(n, p)) for n, p in ((40, 2.0), (100, 0.01), (1000, 0.001))], "n int, p double, m int, k int")


@query("cms_params", "select epsilon, delta, cast(ceil(exp(1) / epsilon) as integer) as m, cast(ceil(ln(exp(1) / delta)) as integer) as k from (values (0.1::double, 0.1::double), (0.01::double, 0.01::double), (0.001::double, 0.01::double)) t(epsilon, delta)")
def cms_params(spark, d):
    return spark.createDataFrame([(e, x, *sk.cms_params(e, x)) for e, x in ((0.1, 0.1), (0.01, 0.01), (0.001, 0.01))], "epsilon double, delta double, m int, k int")


BLOOM_M = "(select m from bm)"
FILTER = f"{F1}, bm as (select cast(ceil(count(distinct key) * abs(ln({BLOOM_P}::double)) / pow(ln(2), 2)) as ubigint) as m from f1), bits as (select distinct s.slot from (select unnest({_slots('key', BLOOM_M, BLOOM_K)}) s from (select distinct key from f1)))"


def _user_filter(spark, d):
    """The filter of all users' keys, and its size by their number."""
    keys = oplog.from_events(spark, d).select("key").distinct()
    m, k = sk.bloom_params(max(keys.count(), 1), BLOOM_P)
    return sk.bloom(keys, m, k), m, k


@query("bloom_bits", f"with {FILTER} select slot from bits")
def bloom_bits(spark, d):
    return _user_filter(spark, d)[0]


@query("bloom_bytes", f"with {FILTER} select cast(slot // 8 as integer) as byte, cast(sum(1 << (7 - slot % 8)) as integer) as value from bits group by 1")
def bloom_bytes(spark, d):
    bits, m, _ = _user_filter(spark, d)
    return sk.bloom_bytes(bits, m)


PROBED = f"with {FILTER}, asked as (select distinct lpad(cast(c_custkey as varchar), 6, '0') as key from customer), one as (select key, unnest({_slots('key', BLOOM_M, BLOOM_K)}) s from asked) select key, count(bits.slot) = {BLOOM_K} as maybe from one left join bits on bits.slot = one.s.slot group by key"


@query("bloom_probe", PROBED)
def bloom_probe(spark, d):
    bits, m, k = _user_filter(spark, d)
    return sk.bloom_probe(_customer_keys(spark, d), bits, m, k)


@query("bloom_packed", PROBED)
def bloom_packed(spark, d):
    """The filter packed to pages of bytes, stored, loaded, unpacked and probed."""
    bits, m, k = _user_filter(spark, d)
    pages = sk.bloom_pack(bits, m, k).select("page", F.hex("packed").alias("packed"))
    stored = written(registry.store_parts(pages, "BloomFilter", "users", "page", "packed", 1), "filter")
    loaded = registry.load_parts(stored, "BloomFilter", "users").select(F.unhex("value").alias("packed"))
    header = sk.bloom_header(loaded).first()
    return sk.bloom_probe(_customer_keys(spark, d), sk.bloom_unpack(loaded), header.m, header.k, header.base)


COUNTS = f"{F1}, c as (select s.i as row, s.slot as col, count(*) as cnt from (select unnest({_slots('key', CMS_M, CMS_K)}) s from f1) group by 1, 2)"


@query("cms_table", f"with {COUNTS} select row, col, cnt from c")
def cms_table(spark, d):
    return sk.cms(oplog.from_events(spark, d), CMS_M, CMS_K)


@query("cms_estimate", f"with {COUNTS}, x as (select key, count(*) as exact from f1 group by key), one as (select key, unnest({_slots('key', CMS_M, CMS_K)}) s from x), e as (select key, min(coalesce(cnt, 0)) as estimate from one left join c on c.row = one.s.i and c.col = one.s.slot group by key) select key, estimate, exact from e join x using (key)")
def cms_estimate(spark, d):
    ops = oplog.from_events(spark, d)
    return sk.cms_estimate(ops, sk.cms(ops, CMS_M, CMS_K), CMS_M, CMS_K).join(ops.groupBy("key").agg(F.count("*").alias("exact")), "key")


@query("cms_stored", f"with {COUNTS}, x as (select distinct key from f1), one as (select key, unnest({_slots('key', CMS_M, CMS_K)}) s from x) select key, min(coalesce(cnt, 0)) as estimate from one left join c on c.row = one.s.i and c.col = one.s.slot group by key")
def cms_stored(spark, d):
    """Estimates from a table that was stored and loaded."""
    ops = oplog.from_events(spark, d)
    stored = registry.store(sk.cms(ops, CMS_M, CMS_K), "CountMinSketch", "users", 1, 1, "row", "col", "cnt")
    return sk.cms_estimate(ops, registry.load(stored, "CountMinSketch", "users", "row: int, col: bigint, cnt: bigint"), CMS_M, CMS_K)


FNV = "list_reduce(list_prepend(2166136261::bigint, list_transform(range(0, strlen({k})), lambda i: ('0x' || substr(hex(encode({k})), (2 * i + 1)::int, 2))::bigint)), lambda h, b: (xor(h, b) * 16777619) % 4294967296)"
REGISTERS = f"h as (select t, {FNV.format(k='key')} as h from k), r as (select t, h // {1 << (32 - P)} as bucket, max(case when h % {1 << (32 - P)} = 0 then {33 - P} else bit_count(xor(h % {1 << (32 - P)}, h % {1 << (32 - P)} - 1)) end) as rank from h group by 1, 2)"
USERS = "k as (select event_type as t, cast(event_id as varchar) as key from events)"
ESTIMATE = f"s as (select t, count(*) as non_empty, sum(pow(2.0, -rank)) as z from r group by t), v as (select t, non_empty, {0.7213 / (1 + 1.079 / (1 << P)) * (1 << P) ** 2} / (z + ({1 << P} - non_empty)) as raw from s)"


@query("fnv1a", f"select c_name as key, {FNV.format(k='c_name')} as h from customer")
def fnv1a(spark, d):
    return oplog.table(spark, d, "customer").select(F.col("c_name").alias("key"), fnv1a_32(F.col("c_name")).alias("h"))


def _event_keys(spark, d):
    return oplog.table(spark, d, "events").select(F.col("event_type").alias("t"), F.col("event_id").cast("string").alias("key"))


@query("hll_registers", f"with {USERS}, {REGISTERS} select t, cast(bucket as bigint) as bucket, cast(rank as integer) as rank from r")
def hll_registers(spark, d):
    return sk.hll_registers(_event_keys(spark, d), P, "t")


@query("hll_estimate", f"with {USERS}, {REGISTERS}, {ESTIMATE} select t, non_empty, round(case when raw <= 2.5 * {1 << P} and non_empty < {1 << P} then {1 << P} * ln({1 << P} / ({1 << P} - non_empty)::double) when raw > pow(2, 32) / 30 then -pow(2, 32) * ln(1 - raw / pow(2, 32)) else raw end, 6) as estimate from v")
def hll_estimate(spark, d):
    return sk.hll_estimate(sk.hll_registers(_event_keys(spark, d), P, "t"), P, "t")


@query("hll_merge", f"with k as (select 'all' as t, cast(event_id as varchar) as key from events), {REGISTERS}, {ESTIMATE} select non_empty, round(case when raw <= 2.5 * {1 << P} and non_empty < {1 << P} then {1 << P} * ln({1 << P} / ({1 << P} - non_empty)::double) else raw end, 6) as estimate from v")
def hll_merge(spark, d):
    parts = sk.hll_registers(_event_keys(spark, d), P, "t").drop("t")
    return sk.hll_estimate(sk.merged_hll(parts), P)


@query("hll_stored", f"with k as (select 'all' as t, cast(event_id as varchar) as key from events), {REGISTERS}, {ESTIMATE} select non_empty, round(case when raw <= 2.5 * {1 << P} and non_empty < {1 << P} then {1 << P} * ln({1 << P} / ({1 << P} - non_empty)::double) else raw end, 6) as estimate from v")
def hll_stored(spark, d):
    """The estimate from registers that were stored and loaded."""
    stored = registry.store(sk.hll_registers(_event_keys(spark, d), P), "HyperLogLog", "events", 1, 1, "bucket", "rank")
    return sk.hll_estimate(registry.load(stored, "HyperLogLog", "events", "bucket: bigint, rank: int"), P)


@query("hll_native", "select event_type as t, count(distinct event_id) as exact, true as ours_near, true as native_near from events group by 1")
def hll_native(spark, d):
    """The sketch beside Spark's own: whether each is within a tenth of the exact number."""
    keys = _event_keys(spark, d)
    ours = sk.hll_estimate(sk.hll_registers(keys, P, "t"), P, "t").select("t", "estimate")
    exact = keys.groupBy("t").agg(F.count_distinct("key").alias("exact"))
    native = keys.groupBy("t").agg(F.approx_count_distinct("key", 0.02).alias("native"))
    near = lambda c: F.abs(F.col(c) - F.col("exact")) <= 0.1 * F.col("exact") + 1
    return exact.join(ours, "t").join(native, "t").select("t", "exact", near("estimate").alias("ours_near"), near("native").alias("native_near"))


TOKENS = "tok as (select doc_id, " + "rtrim(ltrim(rtrim(ltrim(rtrim(ltrim(rtrim(ltrim(upper(replace(w, 'ß', 'ẞ')), ','), ','), '.'), '.'), '!'), '!'), '?'), '?')" + " as word, count(*) as n from (select doc_id, unnest(string_split(text, ' ')) as w from documents) group by 1, 2)"


def _fingerprint_sql() -> str:
    sums = ["sum(n) as n_"]
    bits = []
    for j in range(32):
        code = f"ascii(substr(md5(word), {j + 1}, 1))"
        for b in range(7, -1, -1):
            sums.append(f"sum(n * (({code} >> {b}) & 1)) as b{j}_{b}")
            bits.append(f"case when 2 * b{j}_{b} > n_ then '1' else '0' end")
    return f"{TOKENS}, packed as (select doc_id, {', '.join(sums)} from tok group by doc_id), fp as (select doc_id, {' || '.join(bits)} as fingerprint from packed)"


@query("simhash_tokens", f"with {TOKENS} select doc_id, md5(word) as word, n from tok")
def simhash_tokens(spark, d):
    return sk.simhash_tokens(oplog.table(spark, d, "documents")).select("doc_id", F.md5(F.encode("word", "UTF-8")).alias("word"), "n")


@query("simhash_fingerprint", f"with {_fingerprint_sql()} select doc_id, fingerprint from fp")
def simhash_fingerprint(spark, d):
    return sk.simhash(oplog.table(spark, d, "documents"))


DIFFER = "cast(len(list_filter(range(1, 257), lambda i: substr(a, i, 1) <> substr(b, i, 1))) as integer) as distance"


@query("simhash_distance", f"with {_fingerprint_sql()}, x as (select doc_id, fingerprint as a, lag(fingerprint) over (partition by lang_ order by doc_id) as b from fp join (select doc_id, lang as lang_ from documents) using (doc_id)) select doc_id, {DIFFER} from x where b is not null")
def simhash_distance(spark, d):
    """How far each text is from the one before it in its language; neighbours meet by their global numbers."""
    docs = oplog.table(spark, d, "documents")
    prints = written(sk.simhash(docs).join(docs.select("doc_id", "lang"), "doc_id"), "prints")
    rows = written(numbered(prints, "lang", "doc_id"), "prints")
    before = rows.select((F.col("rn") + 1).alias("rn"), F.col("lang").alias("lang_"), F.col("fingerprint").alias("before"))
    pairs = rows.join(before, "rn").where(F.col("lang").eqNullSafe(F.col("lang_")))
    return pairs.select("doc_id", sk.hamming(F.col("fingerprint"), F.col("before")).alias("distance"))


@query("simhash_stored", f"with {_fingerprint_sql()}, x as (select doc_id, fingerprint as a, (select fingerprint from fp order by doc_id limit 1) as b from fp) select cast(doc_id as varchar) as name, {DIFFER} from x")
def simhash_stored(spark, d):
    """Fingerprints stored under their names, and each compared with the first one's."""
    docs = oplog.table(spark, d, "documents")
    log = written(registry.store_each(sk.simhash(docs), "SimHash", "doc_id", "fingerprint", 1), "prints")
    first = docs.agg(F.min("doc_id").cast("string").alias("name"))  # one row
    prints = registry.stored(log, "SimHash")
    asked = prints.join(F.broadcast(first), "name").select(F.col("value").alias("other"))  # one row
    return prints.join(F.broadcast(asked), F.lit(True)).select("name", sk.hamming(F.col("value"), F.col("other")).alias("distance"))


@query("sketch_registry", "select * from (values ('BloomFilter', 'users'), ('CountMinSketch', 'users'), ('HyperLogLog', 'events')) t(kind, name)")
def sketch_registry(spark, d):
    ops = oplog.from_events(spark, d)
    stored = registry.store(_user_filter(spark, d)[0], "BloomFilter", "users", 1, 1, "slot")
    stored = stored.unionByName(registry.store(sk.cms(ops, CMS_M, CMS_K), "CountMinSketch", "users", 1, 2, "row", "col", "cnt"))
    stored = stored.unionByName(registry.store(sk.hll_registers(_event_keys(spark, d), P), "HyperLogLog", "events", 1, 3, "bucket", "rank"))
    stored = stored.unionByName(registry.store(sk.hll_registers(_event_keys(spark, d), 4), "HyperLogLog", "old", 1, 4, "bucket", "rank"))
    return registry.listing(registry.remove(stored, "HyperLogLog", "old", 2, 5))


@query("sketch_load", f"with {FILTER} select slot from bits")
def sketch_load(spark, d):
    stored = registry.store(_user_filter(spark, d)[0], "BloomFilter", "users", 1, 1, "slot")
    return registry.load(stored, "BloomFilter", "users", "slot: bigint")


# --- records, integrity, order-dependent operators ---


@query("record_encode", f"with {F3} select seq, lower(lpad(to_hex(ts), 16, '0') || '00' || lpad(to_hex(strlen(key)), 16, '0') || lpad(to_hex(strlen(value)), 16, '0') || hex(encode(key)) || hex(encode(value))) as body from f3")
def record_encode(spark, d):
    return records.encoded(oplog.from_order_keys(spark, d)).select("seq", F.lower(F.substring(F.hex("record"), 9, 1 << 30)).alias("body"))


@query("record_crc")
def record_crc(spark, d):
    return records.encoded(oplog.from_order_keys(spark, d)).select("seq", "crc")


def _leaves(spark, d):
    docs = oplog.table(spark, d, "documents")
    return docs.select(F.col("doc_id").alias("pos"), F.sha1(F.concat_ws("|", F.col("doc_id").cast("string"), "lang")).alias("node"))


MERKLE = f"""with recursive l as (select doc_id as pos, sha1(concat_ws('|', cast(doc_id as varchar), lang)) as node from documents),
t(lvl, nodes) as (select 0, list(node order by pos) from l union all
 select lvl + 1, list_transform(range(0, (len(nodes) + 1) // 2), lambda i: sha1(unhex(nodes[2 * i + 1] || coalesce(nodes[2 * i + 2], '{integrity.PAD}')))) from t where len(nodes) > 1)
select nodes[1] as root from t where len(nodes) = 1"""


@query("merkle_root", MERKLE)
def merkle_root(spark, d):
    leaves = _leaves(spark, d)
    return integrity.merkle_root(leaves, leaves.count())


def _run_roots(spark, d):
    rows = records.encoded(runs.placed(runs.fixed_runs(oplog.from_order_keys(spark, d), MEMTABLE)))
    return integrity.merkle_root(rows.select("run", (F.col("rn") - 1).alias("pos"), F.sha1("record").alias("node")), MEMTABLE, "run")


@query("verify_runs", f"select o_orderkey // {MEMTABLE} as run, o_orderkey // {MEMTABLE} % 7 <> 3 as sound from orders group by 1, 2")
def verify_runs(spark, d):
    roots = _run_roots(spark, d)
    stored = roots.withColumn("root", F.when(F.col("run") % 7 == 3, F.sha1("root")).otherwise(F.col("root")))
    return integrity.verify(roots, stored, "run")


BODY = "unhex(lpad(to_hex(ts), 16, '0') || '00' || lpad(to_hex(strlen(key)), 16, '0') || lpad(to_hex(strlen(value)), 16, '0') || hex(encode(key)) || hex(encode(value)))"


@query("manifest_stored", f"""with recursive {F3}, l as (select seq // {MEMTABLE} as run, key, sha1({BODY}) as node from f3),
t(run, nodes) as (select run, list(node order by key) from l group by run union all
 select run, list_transform(range(0, (len(nodes) + 1) // 2), lambda i: sha1(unhex(nodes[2 * i + 1] || coalesce(nodes[2 * i + 2], '{integrity.PAD}')))) from t where len(nodes) > 1),
m as (select run, min(key) as min_key, max(key) as max_key, count(*) as n from l group by run)
select m.run, min_key, max_key, n, nodes[1] as root from m join t on t.run = m.run where len(nodes) = 1""")
def manifest_stored(spark, d):
    """The manifest with each run's root over its records (without their checksums), written and read back."""
    content = runs.fixed_runs(oplog.from_order_keys(spark, d), MEMTABLE)
    leaves = runs.placed(content).select("run", (F.col("rn") - 1).alias("pos"), F.sha1(records.body()).alias("node"))
    path = place(spark, "manifest")
    runs.save_manifest(content, integrity.merkle_root(leaves, MEMTABLE, "run"), path)
    return spark.read.parquet(path).select("run", "min_key", "max_key", "n", "root")


ACCESS = "a as (select user_id as client, event_id as seq, event_type as key from events)"


@query("lru_hits", f"""with {ACCESS}, p as (select client, seq, key, lag(seq) over (partition by client, key order by seq) pq from a),
x as (select p.client, p.seq, count(distinct b.key) n from p join a b on b.client = p.client and b.seq > p.pq and b.seq < p.seq group by p.client, p.seq)
select p.client, p.seq, p.key, (pq is not null and coalesce(n, 0) < 3) as hit from p left join x on x.client = p.client and x.seq = p.seq""")
def lru_hits(spark, d):
    rows = oplog.table(spark, d, "events").select(F.col("user_id").alias("client"), F.col("event_id").alias("seq"), F.col("event_type").alias("key"))
    return stateful.lru_hits(rows, 3)


@query("lru_contents", f"with {ACCESS}, l as (select client, key, max(seq) m from a group by 1, 2), r as (select client, key, cast(row_number() over (partition by client order by m desc) as integer) as place from l) select client, key, place from r where place <= 3")
def lru_contents(spark, d):
    rows = oplog.table(spark, d, "events").select(F.col("user_id").alias("client"), F.col("event_id").alias("seq"), F.col("event_type").alias("key"))
    return stateful.lru_contents(rows, 3)


@query("token_bucket", """with recursive e as (select user_id as client, event_id as seq, cast(epoch(date_trunc('second', ts)) as bigint) as t, row_number() over (partition by user_id order by event_id) n from events),
w(client, n, seq, t, av) as (select client, n, seq, t, 3::bigint from e where n = 1 union all
 select e.client, e.n, e.seq, e.t, least(3, (w.av - (w.av >= 1)::int) + floor(0.0001 * (e.t - w.t))::bigint) from w join e on e.client = w.client and e.n = w.n + 1)
select client, seq, av >= 1 as accepted from w""")
def token_bucket(spark, d):
    rows = oplog.table(spark, d, "events").select(F.col("user_id").alias("client"), F.col("event_id").alias("seq"), oplog.seconds("ts").alias("ts"))
    return stateful.token_bucket(rows, 0.0001, 3).select("client", "seq", "accepted")


@query("admitted_state", f"""with recursive {F1}, e as (select user_id as client, event_id as seq, cast(epoch(date_trunc('second', ts)) as bigint) as t, row_number() over (partition by user_id order by event_id) n from events),
w(client, n, seq, t, av) as (select client, n, seq, t, 3::bigint from e where n = 1 union all
 select e.client, e.n, e.seq, e.t, least(3, (w.av - (w.av >= 1)::int) + floor(0.0001 * (e.t - w.t))::bigint) from w join e on e.client = w.client and e.n = w.n + 1),
g as (select f1.* from f1 join w on w.seq = f1.seq where av >= 1), {newest('g')} select key, value, ts, seq from cur where not tombstone""")
def admitted_state(spark, d):
    """What is live if only requests with a token are applied."""
    requests = oplog.from_events(spark, d).withColumn("client", F.col("key"))
    return state.live(stateful.admitted(requests, 0.0001, 3)).select("key", "value", "ts", "seq")


@query("generate_entries")
def generate_entries(spark, d):
    return oplog.generate(spark, 10_000)


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return dict(_QUERIES)


def oracle_sql() -> dict[str, str]:
    return dict(_SQL)
