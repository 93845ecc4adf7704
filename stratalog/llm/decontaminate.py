"""Benchmark decontamination with a generalised suffix automaton over words.

The automaton of all test items is built in each task from a broadcast block of
items; each document's words stream through it, keeping the longest matching
length.  Where that length reaches a window (``window`` item words, or a whole
shorter item), the window's words are hit.  Blocks hold at most ``block_words``
item words, so what is broadcast and kept in a task has a fixed bound; a larger
test set becomes several passes, each of which adds its hits and is written, so
that no worker ever holds two automata.  Nothing is shuffled.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from itertools import repeat

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from stratalog.llm import textbatch
from stratalog.llm.spans import replaced
from stratalog.llm.store import aside, written

WORD = re.compile(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+")  # before A-Z are lower-cased
_FOLD = bytes(c or 0x20 for c in textbatch.ALNUM.tolist())
_RANGES = T.ArrayType(T.StructType([T.StructField("start", T.IntegerType()), T.StructField("end", T.IntegerType())]))
ADDED = ("n_words", "hit_words", "hit_chars", "items")
_BITS = 1 << 20


def split(text: str | None) -> list[bytes]:
    """The words of a text: A-Z lower-cased, runs of letters, digits and non-ASCII characters."""
    return (text or "").encode().translate(_FOLD).split()


class Automaton:
    """Generalised suffix automaton of items, with the windows that end in each state."""

    def __init__(self, items: list[tuple[str, str]], window: int):
        self.vocabulary: dict[bytes, int] = {}
        self.next: list[dict[int, int]] = [{}]
        self.length, self.link = [0], [-1]
        self.pairs = np.zeros(_BITS, bool)
        rows = []
        for item, text in items:
            ids = [self.vocabulary.setdefault(w, len(self.vocabulary) + 1) for w in split(text)]
            if ids:
                rows.append((item, ids))
                last = 0
                for c in ids:
                    last = self._extend(last, c)
                x = np.array(ids, np.int64)
                self.pairs[self._pair(x[:-1], x[1:])] = True
        self.windows: dict[tuple[int, int], list[str]] = {}
        for item, ids in rows:
            size = min(window, len(ids))
            state = 0
            for i, c in enumerate(ids):
                state = self.suffix(self.next[state][c], size)
                if i + 1 >= size:
                    at = self.windows.setdefault((size, state), [])
                    if not at or at[-1] != item:
                        at.append(item)
        self.sizes = sorted({k for k, _ in self.windows}, reverse=True)

    @staticmethod
    def _pair(a: np.ndarray, b: np.ndarray) -> np.ndarray:
        return (a * 0x9E3779B1 + b * 0x85EBCA6B) % _BITS

    def _new(self, length: int, link: int, follow: dict[int, int]) -> int:
        self.length.append(length)
        self.link.append(link)
        self.next.append(follow)
        return len(self.link) - 1

    def _split(self, p: int, c: int, q: int) -> int:
        """The state for p's longest string and c, split from q if q holds longer ones too."""
        if self.length[q] == self.length[p] + 1:
            return q
        clone = self._new(self.length[p] + 1, self.link[q], dict(self.next[q]))
        self.link[q] = clone
        while p >= 0 and self.next[p].get(c) == q:
            self.next[p][c] = clone
            p = self.link[p]
        return clone

    def _extend(self, last: int, c: int) -> int:
        if c in self.next[last]:
            return self._split(last, c, self.next[last][c])
        state, p = self._new(self.length[last] + 1, 0, {}), last
        while p >= 0 and c not in self.next[p]:
            self.next[p][c] = state
            p = self.link[p]
        if p >= 0:
            self.link[state] = self._split(p, c, self.next[p][c])
        return state

    def suffix(self, state: int, size: int) -> int:
        """The state of the last ``size`` words of a match that ends in ``state``; of the whole match if it is shorter."""
        while state and self.length[self.link[state]] >= size:
            state = self.link[state]
        return state

    def hits(self, ids: list[int]) -> Iterator[tuple[int, int, list[str]]]:
        """(first, end, items) of each window that occurs, as words stream through.

        A match is cut to the state of its last words, as many as the largest
        window has: what is before cannot matter, and states of smaller windows
        are then at most that many links away.
        """
        state = length = 0
        most = self.sizes[0]
        for i, c in enumerate(ids):
            while state and c not in self.next[state]:
                state = self.link[state]
                length = self.length[state]
            if c in self.next[state]:
                state = self.suffix(self.next[state][c], most)
                length = min(length + 1, self.length[state])
                for size in self.sizes:
                    if size <= length and (found := self.windows.get((size, self.suffix(state, size)))):
                        yield i + 1 - size, i + 1, found

    def scan(self, texts: list[list[bytes]]) -> dict[int, tuple[list[tuple[int, int]], set[str]]]:
        """Hit word ranges and items by text number, for the texts that have any.

        A match of two or more words needs each pair of neighbours to be
        neighbours in some item, so only runs of such pairs stream through.
        """
        if not self.sizes:
            return {}
        least, starts, ids = self.sizes[-1], [], []
        for x in texts:
            starts.append(len(ids))
            ids.extend(map(self.vocabulary.get, x, repeat(0)))
            ids.append(0)
        a = np.array(ids, np.int64)
        on = a > 0 if least == 1 else np.append((a[:-1] > 0) & (a[1:] > 0) & self.pairs[self._pair(a[:-1], a[1:])], False)
        edges = np.flatnonzero(np.diff(np.concatenate(([False], on, [False])).astype(np.int8)))
        first, end = edges[::2], edges[1::2] + (least > 1)
        out: dict[int, tuple[list[tuple[int, int]], set[str]]] = {}
        for i, j in zip(first.tolist(), end.tolist(), strict=True):
            if j - i < least:
                continue
            k = int(np.searchsorted(starts, i, "right")) - 1
            for lo, hi, items in self.hits(ids[i:j]):
                ranges, found = out.setdefault(k, ([], set()))
                ranges.append((lo + i - starts[k], hi + i - starts[k]))
                found.update(items)
        return out


def merged(ranges: list[tuple[int, int]]) -> list[tuple[int, int]]:
    """Disjoint ranges in order that cover the same places."""
    out: list[list[int]] = []
    for lo, hi in sorted(ranges):
        if out and lo <= out[-1][1]:
            out[-1][1] = max(out[-1][1], hi)
        else:
            out.append([lo, hi])
    return [tuple(x) for x in out]


def _blocks(benchmark: DataFrame, block_words: int) -> Iterator[list[tuple[str, str]]]:
    rows = benchmark.select(F.col("item_id").cast("string").alias("item"), "text").where("item is not null and text is not null")
    block, n = [], 0
    for row in rows.toLocalIterator():
        size = len(split(row.text))
        if block and n + size > block_words:
            yield block
            block, n = [], 0
        block.append((row.item, row.text))
        n += size
    yield block


def scan(docs: DataFrame, benchmark: DataFrame, window: int = 10, block_words: int = 100_000) -> DataFrame:
    """``docs`` with the words that lie in occurrences of benchmark windows.

    Added columns (any of the same names are replaced): ``n_words``;
    ``hit_words`` and ``hit_chars``, disjoint ranges of word numbers and of
    characters (end exclusive); ``items``, the ids, as sorted strings, of items
    with occurring windows.  Null and empty texts have no words; items without
    words or without an id have no windows; an item listed twice counts once.
    Rows are neither dropped nor merged.  The driver reads the items block by
    block.
    """
    docs = docs.select(*[c for c in docs.columns if c not in ADDED])
    schema = T.StructType([*docs.schema.fields, T.StructField("n_words", T.LongType()), T.StructField("hit_words", _RANGES), T.StructField("hit_chars", _RANGES), T.StructField("items", T.ArrayType(T.StringType()))])
    names, text = schema.names, docs.columns.index("text")
    pair = pa.list_(pa.struct([("start", pa.int32()), ("end", pa.int32())]))
    sc = docs.sparkSession.sparkContext
    for number, block in enumerate(_blocks(benchmark, block_words)):
        shared = sc.broadcast(block)
        if number:
            docs = written(docs, "passes")

        def run(batches: Iterator[pa.RecordBatch], shared=shared, later=number > 0) -> Iterator[pa.RecordBatch]:
            automaton = Automaton(shared.value, window)
            for batch in batches:
                for i, j in textbatch.slices(textbatch.utf8(batch.column(text))[1]):
                    part = batch.slice(i, j - i)
                    raw = part.column(text).to_pylist()
                    cut = [split(x) for x in raw]
                    found = automaton.scan(cut)
                    ranges, chars, items = ([[] for _ in raw] for _ in range(3))
                    if later:
                        ranges = [[(x["start"], x["end"]) for x in r] for r in part.column(names.index("hit_words")).to_pylist()]
                        items = part.column(names.index("items")).to_pylist()
                    for k, (more, own) in found.items():
                        ranges[k] = merged(ranges[k] + more)
                        items[k] = sorted({*items[k], *own}, key=str.encode)
                    for k, r in enumerate(ranges):
                        if r:
                            at = [m.span() for m in WORD.finditer(raw[k])]
                            chars[k] = [(at[lo][0], at[hi - 1][1]) for lo, hi in r]
                    rows = [[{"start": a, "end": b} for a, b in r] for r in ranges], [[{"start": a, "end": b} for a, b in r] for r in chars]
                    columns = [*part.columns[: len(names) - 4], pa.array(map(len, cut), pa.int64()), pa.array(rows[0], pair), pa.array(rows[1], pair), pa.array(items, pa.list_(pa.string()))]
                    yield pa.RecordBatch.from_arrays(columns, names=names)

        docs = docs.mapInArrow(run, schema)
    return docs


def n_hit() -> F.Column:
    return F.aggregate("hit_words", F.lit(0).cast("long"), lambda n, r: n + (r["end"] - r["start"]).cast("long"))


def decontaminate(docs: DataFrame, benchmark: DataFrame, window: int = 10, max_coverage: float = 0.8) -> DataFrame:
    """Documents without benchmark passages.

    Every hit span goes from the text; a document of whose words more than
    ``max_coverage`` are hit goes as a whole.  Other documents, null texts
    among them, stay as they are.  ``n_chars``, if there, follows the text.
    """
    moved, own = aside(docs, ADDED)
    found = scan(moved, benchmark, window)
    found = found.where((F.size("hit_words") == 0) | (n_hit() <= max_coverage * F.col("n_words")))
    left = replaced(F.col("text"), F.transform("hit_chars", lambda r: F.struct(r["start"].alias("start"), r["end"].alias("end"), F.lit("").alias("label"))))
    cleaned = {"text": F.when(F.size("hit_chars") > 0, left).otherwise(F.col("text"))}
    out = found.withColumns(cleaned)
    if "n_chars" in docs.columns:
        out = out.withColumn("n_chars", F.when(F.size("hit_chars") > 0, F.length("text").cast(docs.schema["n_chars"].dataType)).otherwise(F.col("n_chars")))
    return out.select(*own)


def query(spark, sf_dir: str) -> DataFrame:
    """op7: hit words and items of every document."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    found = scan(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))
    return found.select(
        "doc_id",
        "n_words",
        n_hit().alias("n_hit"),
        F.size("items").cast("long").alias("n_items"),
        F.sha2(F.array_join("items", ","), 256).alias("items_sha256"),
        (n_hit() > 0).alias("contaminated"),
    )


SQL = r"""
with d as (
  select doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') w from documents),
b as (
  select cast(item_id as varchar) item, regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') w
  from benchmark where item_id is not null and text is not null),
s as (select item, w, least(len(w), 10) k from b where len(w) > 0),
win as (select distinct item, k, array_to_string(w[i:i + k - 1], ' ') g from (select item, w, k, unnest(range(1, len(w) - k + 2)) i from s)),
dw as (select doc_id, k, i, array_to_string(w[i:i + k - 1], ' ') g
  from (select doc_id, w, k, unnest(range(1, len(w) - k + 2)) i from d cross join (select distinct k from win) where len(w) >= k)),
h as (select doc_id, i, k, item from dw join win using (k, g)),
n as (select doc_id, count(distinct p) n_hit from (select doc_id, unnest(range(i, i + k)) p from h) group by doc_id),
t as (select doc_id, count(*) n_items, string_agg(item, ',' order by item) items from (select distinct doc_id, item from h) group by doc_id)
select d.doc_id, cast(len(w) as bigint) n_words, cast(coalesce(n_hit, 0) as bigint) n_hit, cast(coalesce(n_items, 0) as bigint) n_items,
  sha256(coalesce(items, '')) items_sha256, coalesce(n_hit, 0) > 0 contaminated
from d left join n on n.doc_id = d.doc_id left join t on t.doc_id = d.doc_id
"""
