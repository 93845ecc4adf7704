"""Substring dedup by content-defined chunking.

A gear hash rolls over the bytes of each text; a byte ends a chunk where the
hash there is the least within ``RADIUS`` bytes on either side.  Cuts depend on
nearby bytes only, so an insertion moves no cut beyond its neighbourhood and a
passage is cut alike wherever it stands.  Neighbouring chunks are matched, two
by two, by a digest of 96 bits over the whole corpus; a chain of such pairs that
occur in more than one document is the core of a repeated passage.  Where a text
repeats itself, pairs are numbered from the beginning of that run, so a long run
is not taken for a short one elsewhere.  A passage's ragged ends, where chunks of
different documents differ, are found word by word: what is next to a chain's
outer pairs is held against the first and the last document that have these
pairs, and the passage goes as far as one of them goes along.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from stratalog.llm import textbatch
from stratalog.llm.spans import replaced
from stratalog.llm.store import fresh, written

RADIUS = 20
CORE = 40  # characters that a chain needs at least to be looked at
REACH = 24  # words by which a passage may go on beyond its chain, on either side
LEAST = 50  # words
PERIOD = 8  # chunks: the longest period of a run of chunks that is numbered
_INVERSE = np.uint64(pow(0xD6E8FEB86659FD93, -1, 1 << 64))
_GEAR = textbatch.mix(np.arange(1, 257, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15))
_POWER = np.uint64(0xD6E8FEB86659FD93)
_TABLE = textbatch.mix(np.arange(1, 64 * 256 + 1, dtype=np.uint64) * np.uint64(0xC2B2AE3D27D4EB4F))  # one number for each byte and place modulo 64
_MASK = (1 << 31) - 1
SPANS = "array<struct<start:int,end:int>>"


def gear(data: np.ndarray) -> np.ndarray:
    """The gear hash at each byte, h = 2 h + G[byte], over a window of 16 bytes."""
    h = _GEAR[data]
    for k in (1, 2, 4, 8):
        older = h[:-k] << np.uint64(k)
        h = h.copy()
        h[k:] += older
    return textbatch.mix(h)


def cuts(h: np.ndarray, radius: int = RADIUS) -> np.ndarray:
    """Places whose hash is the least within ``radius``; where text repeats with a short period, one in each period."""
    n, width = len(h), 2 * radius + 1
    if n < 2:
        return np.zeros(0, np.int64)
    top = np.uint64(0xFFFFFFFFFFFFFFFF)
    low = np.concatenate([np.full(radius, top), h, np.full(radius, top)])
    reach = 1
    while 2 * reach <= width:
        low = np.minimum(low[:-reach], low[reach:])
        reach *= 2
    rest = width - reach
    low = np.minimum(low[: len(low) - rest], low[rest:]) if rest else low
    return np.flatnonzero(h == low[:n])


def chunk(data: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Starts of a text's chunks (bytes) and two independent hashes of each."""
    starts = np.concatenate(([0], cuts(gear(data)) + 1))
    starts = starts[starts < len(data)]
    size = np.diff(starts, append=len(data))
    at = np.arange(len(data)) - np.repeat(starts, size)
    powers = np.full(int(size.max()) + 1, _POWER)
    powers[0] = 1
    powers = np.multiply.accumulate(powers)
    length = textbatch.mix(size.astype(np.uint64))
    one = np.add.reduceat((data.astype(np.uint64) + np.uint64(1)) * powers[at], starts)
    two = np.add.reduceat(_TABLE[((at & 63) << 8) + data] * powers[at >> 6], starts)
    return starts, textbatch.mix(one ^ length), textbatch.mix(two + length)


def turns(chunks: np.ndarray) -> np.ndarray:
    """For each chunk (by hash) how long it has been so that a chunk is the same as the one a period before; 0 for less than a period.

    Of periods up to ``PERIOD`` chunks that with the longest run counts.
    """
    out = np.zeros(len(chunks), np.int64)
    if len(np.unique(chunks)) == len(chunks):
        return out
    for p in range(1, min(PERIOD, len(chunks) - 1) + 1):
        same, at = chunks[p:] == chunks[:-p], np.arange(len(chunks) - p)
        run = at - np.maximum.accumulate(np.where(same, -1, at))
        out[p:] = np.maximum(out[p:], np.where(run >= p, run, 0))
    return out


def paired(docs: DataFrame) -> DataFrame:
    """(doc_id, one, two, place, start, middle, end): each two neighbouring chunks of each text with an id.

    ``one`` and ``two`` are the digest of both chunks, and of their number in a
    run of chunks with a short period (``turns``); ``place`` counts chunks and
    tells different texts of one id apart.  Start, middle and end count code
    points; a byte that goes on with a character belongs to the chunk where the
    character begins.
    """
    schema = "doc_id long, one long, two int, place long, start int, middle int, end int"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            data, offsets = textbatch.utf8(batch.column(1))
            for i, j in textbatch.slices(offsets):
                out: list[list[np.ndarray]] = [[] for _ in range(7)]
                doc, key = (np.asarray(batch.column(c).slice(i, j - i)) for c in (0, 2))
                for k, (lo, hi) in enumerate(zip(offsets[i:j].tolist(), offsets[i + 1 : j + 1].tolist(), strict=True)):
                    if hi - lo < 2:
                        continue
                    text = data[lo:hi]
                    starts, one, two = chunk(text)
                    if len(starts) < 2:
                        continue
                    begun = np.concatenate(([0], np.cumsum((text & 0xC0) != 0x80))).astype(np.int32)[np.append(starts, len(text))]
                    turn = textbatch.mix(turns(one)[1:].astype(np.uint64))
                    one = textbatch.mix(one[:-1] + textbatch.mix(one[1:] + turn + np.uint64(1)))
                    two = textbatch.mix(two[:-1] ^ textbatch.mix((two[1:] ^ turn) + np.uint64(2)))
                    n = len(one)
                    parts = (np.full(n, doc[k]), one.view(np.int64), (two >> np.uint64(32)).astype(np.uint32).view(np.int32), (int(key[k]) << 31) + np.arange(n), begun[:-2], begun[1:-1], begun[2:])
                    for column, part in zip(out, parts, strict=True):
                        column.append(part)
                if out[0]:
                    yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(c)) for c in out], names=["doc_id", "one", "two", "place", "start", "middle", "end"])

    rows = docs.where("doc_id is not null and text is not null")
    return rows.select(F.col("doc_id").cast("long").alias("doc_id"), "text", text_key().alias("key")).mapInArrow(run, schema)


def text_key() -> F.Column:
    """Tells texts of one id apart."""
    return F.xxhash64("text").bitwiseAND(_MASK)


def _chains(doc: np.ndarray, place: np.ndarray, one: np.ndarray, two: np.ndarray, start: np.ndarray, middle: np.ndarray, end: np.ndarray, first: np.ndarray, places: np.ndarray) -> pa.RecordBatch:
    """The chains of whole documents from their repeated pairs, ordered by (doc, place)."""
    once = np.ones(len(doc), bool)
    once[1:] = (doc[1:] != doc[:-1]) | (place[1:] != place[:-1])
    doc, place, one, two, start, middle, end, first, places = (x[once] for x in (doc, place, one, two, start, middle, end, first, places))
    n = len(doc)
    new = np.ones(n, bool)
    new[1:] = (doc[1:] != doc[:-1]) | (place[1:] != place[:-1] + 1)
    head = np.flatnonzero(new)
    last = np.append(head[1:], n) - 1
    chain = np.cumsum(new) - 1
    # A chain of r pairs has r + 1 chunks: those of its pairs' first halves, and the last pair's second.
    lo, hi, gone = np.zeros(n + len(head), np.int32), np.zeros(n + len(head), np.int32), np.zeros(n + len(head), bool)
    at = np.arange(n) + chain
    lo[at], hi[at] = start, middle
    ends = last + np.arange(len(head)) + 1
    lo[ends], hi[ends] = middle[last], end[last]
    elsewhere = first != doc
    gone[at] = elsewhere
    gone[at + 1] |= elsewhere
    begins = head + np.arange(len(head))
    opens, closes = gone.copy(), gone.copy()
    opens[1:] &= ~gone[:-1]
    opens[begins] = gone[begins]
    closes[:-1] &= ~gone[1:]
    closes[ends] = gone[ends]
    counts = np.add.reduceat(opens.astype(np.int32), begins)
    drop = pa.ListArray.from_arrays(
        pa.array(np.concatenate(([0], np.cumsum(counts))).astype(np.int32)),
        pa.StructArray.from_arrays([pa.array(lo[opens]), pa.array(hi[closes])], names=["start", "end"]),
    )
    columns = (doc[head], place[head] >> 31, start[head], end[last], (last - head + 2).astype(np.int32), first[head], places[head], one[head], two[head], one[last], two[last])
    names = ["doc_id", "text_key", "low", "high", "n_chunks", "first_doc_id", "n_places", "head_one", "head_two", "last_one", "last_two", "drop"]
    return pa.RecordBatch.from_arrays([*map(pa.array, columns), drop], names=names).filter(pa.array(end[last] - start[head] >= CORE))


def chains(pairs: DataFrame) -> DataFrame:
    """Chains of repeated pairs; a task streams through its documents' pairs in order."""
    schema = f"doc_id long, text_key long, low int, high int, n_chunks int, first_doc_id long, n_places long, head_one long, head_two int, last_one long, last_two int, drop {SPANS}"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[np.ndarray] | None = None
        for batch in batches:
            if not batch.num_rows:
                continue
            new = [np.asarray(c) for c in batch.columns]
            held = new if held is None else [np.concatenate(x) for x in zip(held, new, strict=True)]
            whole = int(np.searchsorted(held[0], held[0][-1]))  # the last document may go on
            if whole:
                yield _chains(*[x[:whole] for x in held])
                held = [x[whole:] for x in held]
        if held is not None:
            yield _chains(*held)

    rows = pairs.select("doc_id", "place", "one", "two", "start", "middle", "end", "first_doc_id", "n_places")
    return rows.repartition("doc_id").sortWithinPartitions("doc_id", "place").mapInArrow(run, schema)


def around(text: np.ndarray, side: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """What stands outside of places in a text (bytes): side 0 before, side 1 behind.

    For each place and step 0 to ``REACH``: a hash of what lies between the
    place and the beginning (end) of the nth word from there, how far that is,
    and the number of words that begin before (end by) it; and how many steps there are.
    """
    space = np.isin(text, np.frombuffer(b" \t\n\x0b\x0c\r", np.uint8))
    edge = np.concatenate(([True], space))
    starts, ends = np.flatnonzero(edge[:-1] & ~space), np.flatnonzero(~space & np.append(space[1:], True)) + 1
    powers = np.full(len(text) + 1, _POWER)
    powers[0] = 1
    powers = np.multiply.accumulate(powers)
    sums = np.concatenate((np.zeros(1, np.uint64), np.cumsum((text.astype(np.uint64) + np.uint64(1)) * powers[:-1])))
    inverse = np.full(len(text) + 1, _INVERSE)
    inverse[0] = 1
    inverse = np.multiply.accumulate(inverse)
    before, behind = np.searchsorted(starts, at), np.searchsorted(ends, at, "right")
    step = np.arange(REACH + 1)
    left = side[:, None] == 0
    word = np.where(left, before[:, None] - step, behind[:, None] + step - 1)
    there = (step == 0) | np.where(left, word >= 0, word < len(ends))
    safe = np.clip(word, 0, len(starts) - 1)
    reach = np.where(step == 0, at[:, None], np.where(left, starts[safe], ends[safe]))
    lo, hi = np.minimum(reach, at[:, None]), np.maximum(reach, at[:, None])
    value = textbatch.mix((sums[hi] - sums[lo]) * inverse[lo] ^ textbatch.mix((hi - lo).astype(np.uint64)))
    number = np.where(left, before[:, None] - step, behind[:, None] + step)
    return value, reach, number, there.sum(1)


def contexts(docs: DataFrame, places: DataFrame) -> DataFrame:
    """``places`` (doc_id, text_key, side, at, one, two, ends, stands) with ``keys``, ``reach`` and ``words``: see ``around``.

    Steps 0 have no key.  All of a document's places come to its text at once.
    """
    fields = ("side", "at", "one", "two", "ends", "stands")
    asked = places.groupBy("doc_id", "text_key").agg(F.collect_list(F.struct(*fields)).alias("places"))
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), text_key().alias("text_key"), "text")
    schema = "doc_id long, text_key long, side int, at int, one long, two int, ends boolean, stands boolean, keys array<int>, reach array<int>, words array<int>"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            data, offsets = textbatch.utf8(batch.column(2))
            lists = batch.column(3)
            bounds, flat = np.asarray(lists.offsets), lists.values
            side, at = (np.asarray(flat.field(k)) for k in range(2))
            keys, reaches, words, counts = [], [], [], []
            for k in range(batch.num_rows):
                text, own = data[offsets[k] : offsets[k + 1]], slice(bounds[k], bounds[k + 1])
                begun = (text & 0xC0) != 0x80
                value, reach, number, steps = around(text, side[own], np.append(np.flatnonzero(begun), len(text))[at[own]])
                there = np.arange(REACH + 1) < steps[:, None]
                keys.append((value[:, 1:] >> np.uint64(32)).astype(np.uint32).view(np.int32)[there[:, 1:]])
                reaches.append(np.concatenate(([0], np.cumsum(begun)))[reach][there].astype(np.int32))  # characters begun before each byte
                words.append(number[there].astype(np.int32))
                counts.append(steps)
            if not counts:
                continue
            steps = np.concatenate(counts)
            lists_of = lambda parts, n: pa.ListArray.from_arrays(pa.array(np.concatenate(([0], np.cumsum(n))).astype(np.int32)), pa.array(np.concatenate(parts)))
            row = pa.array(np.repeat(np.arange(batch.num_rows), np.diff(bounds)))
            inner = flat.slice(bounds[0], bounds[-1] - bounds[0])
            yield pa.RecordBatch.from_arrays(
                [batch.column(0).take(row), batch.column(1).take(row), *[inner.field(k) for k in range(len(fields))], lists_of(keys, steps - 1), lists_of(reaches, steps), lists_of(words, steps)],
                names=["doc_id", "text_key", *fields, "keys", "reach", "words"],
            )

    return rows.join(asked, ["doc_id", "text_key"]).select("doc_id", "text_key", "text", "places").mapInArrow(run, schema)


def repeats(docs: DataFrame, least_words: int = LEAST) -> DataFrame:
    """Repeated passages of ``least_words`` words or more: one row for each place where one stands.

    A passage is a chain of neighbouring chunks, each two neighbours of which
    stand side by side in more than one document, with the words on either side
    as far as the first or the last other document with the same outer pair has
    them too (at most ``REACH``).  Words are what white space parts; those that
    lie wholly inside count.  Columns: ``doc_id``; ``text_key``, which tells
    texts of one id apart; ``start`` and ``end`` in code points; ``n_words``;
    ``n_chunks``; ``first_doc_id``, the smallest id of a document that holds the
    first pair; ``n_places``, how often that pair occurs; ``drop``, the spans of
    the chunks that belong to a pair first held by another document, and
    ``keep``, whether there are none.  A chunk is dropped for one with a smaller
    id only, so each stays somewhere.  Null ids and texts take no part; texts of
    one chunk have no pairs; a row listed twice is one document.

    The pairs are made twice (it is cheaper to make than to keep them): once
    for the counts, summed in each task before the exchange, once for the join,
    whose both sides are exchanged, so that hot digests can be split.
    """
    digest, place = ["one", "two"], ["doc_id", "text_key", "side", "at"]
    own = paired(docs).groupBy(*digest).agg(F.count("*").alias("n_places"), F.min("doc_id").alias("first_doc_id"), F.max("doc_id").alias("last_doc_id"))
    held = written(own.where("first_doc_id < last_doc_id"), "chunks")
    pairs = written(paired(docs).join(held, digest), "pairs")
    found = written(chains(pairs), "chains")
    side = lambda n, at, a, b: F.struct(F.lit(n).alias("side"), F.col(at).alias("at"), F.col(a).alias("one"), F.col(b).alias("two"))
    ends = found.select("doc_id", "text_key", F.explode(F.array(side(0, "low", "head_one", "head_two"), side(1, "high", "last_one", "last_two"))).alias("o")).select("doc_id", "text_key", "o.*")
    # Outer pairs where they stand in the first and the last document that has them; there once, if they stand there often.
    known = pairs.where("doc_id = first_doc_id or doc_id = last_doc_id")
    at = F.when(F.col("side") == 0, F.col("start")).otherwise(F.col("end"))
    stand = known.join(ends.select("side", *digest).distinct(), digest).groupBy("side", *digest, "doc_id").agg(F.min(F.struct(F.shiftright("place", 31).alias("text_key"), at.alias("at"))).alias("p"))
    stand = stand.select("doc_id", "p.text_key", "side", "p.at", *digest)
    flags = lambda df, a, b: df.withColumns({"ends": F.lit(a), "stands": F.lit(b)})
    places = flags(ends, True, False).unionByName(flags(stand, False, True)).groupBy(*place, *digest).agg(F.max("ends").alias("ends"), F.max("stands").alias("stands"))
    near = written(contexts(docs, places), "contexts")
    # Two, or more texts under their ids; written, so that the join behind has plain exchanges and a hot pair can be split.
    others = written(near.where("stands").groupBy("side", *digest).agg(F.collect_set(F.struct(F.col("doc_id").alias("other"), F.col("keys").alias("theirs"))).alias("others")), "others")
    along = F.transform(F.filter("others", lambda o: o["other"] != F.col("doc_id")), lambda o: F.size(F.filter(F.zip_with("keys", o["theirs"], lambda a, b: F.coalesce(a == b, F.lit(False))), lambda same: same)))
    far = F.coalesce(F.array_max(along), F.lit(0)) + 1
    edge = near.where("ends").join(others, ["side", *digest]).select(*place, F.element_at("reach", far).alias("reach"), F.element_at("words", far).alias("words"))
    edges = written(edge.groupBy(*place).agg(F.max("reach").alias("reach"), F.max("words").alias("words")), "edges")
    end = lambda n, at, reach, words: edges.where(F.col("side") == n).select("doc_id", "text_key", F.col("at").alias(at), F.col("reach").alias(reach), F.col("words").alias(words))
    out = found.join(end(0, "low", "start", "w0"), ["doc_id", "text_key", "low"]).join(end(1, "high", "end", "w1"), ["doc_id", "text_key", "high"])
    n_words = (F.col("w1") - F.col("w0")).cast("int")
    return out.where(n_words >= least_words).select("doc_id", "text_key", "start", "end", n_words.alias("n_words"), "n_chunks", "first_doc_id", "n_places", (F.size("drop") == 0).alias("keep"), "drop")


def dedup(docs: DataFrame, least_words: int = LEAST) -> DataFrame:
    """``docs`` without repeated passages, but for the chunks of which a document is the first holder.

    All other rows and columns stay as they are; ``n_chars``, if there, follows the text.
    """
    id_, key, spans = (fresh(docs, f"__{x}") for x in ("id", "key", "spans"))
    label = lambda s: F.struct(s["start"].alias("start"), s["end"].alias("end"), F.lit("").alias("label"))
    cut = repeats(docs, least_words).where("not keep").groupBy(F.col("doc_id").alias(id_), F.col("text_key").alias(key)).agg(F.array_sort(F.transform(F.flatten(F.collect_list("drop")), label)).alias(spans))
    rows = docs.withColumns({id_: F.col("doc_id").cast("long"), key: text_key()}).join(cut, [id_, key], "left")
    text = F.when(F.size(spans) > 0, replaced(F.col("text"), F.col(spans))).otherwise(F.col("text"))
    out = rows.withColumn("text", text)
    if "n_chars" in docs.columns:
        out = out.withColumn("n_chars", F.when(F.size(spans) > 0, F.length("text").cast(docs.schema["n_chars"].dataType)).otherwise(F.col("n_chars")))
    return out.select(*docs.columns)


def query(spark, sf_dir: str) -> DataFrame:
    """op1: every place of a passage that repeats across documents."""
    return repeats(spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text"))
