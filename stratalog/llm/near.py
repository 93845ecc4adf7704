"""N-gram Jaccard join by chosen paths.

Texts become sets of word 5-shingles; texts with the same words are one
representative.  Each set is embedded as ``COORDINATES`` min-hash tokens.  A run
splits all sets on sampled tokens: sets that share a sampled token go down that
path together.  Buckets of more than ``BUCKET`` sets are split again on further
tokens, but for sets close to the bucket's center, which are joined to it; small buckets are brute-forced on the embedded sets.  As many runs are
made as the target recall needs; runs share their first level, so they cost one
exchange in all.

What brute force finds likely (with a margin below the threshold) joins sets to
candidate components.  Inside a component every pair is then decided on the
exact shingle sets, in blocks, each pair once: no link between members is lost,
the links are counted without listing pairs, and the true links give the classes.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from stratalog.llm import textbatch
from stratalog.llm.components import components
from stratalog.llm.store import fresh, written
from stratalog.llm.textbatch import mix

WORDS = 5
THRESHOLD = (4, 5)  # Jaccard similarity, as a fraction
COORDINATES = 128
BUCKET = 256
BLOCK = 128
BLOCK_BYTES = 16 << 20
DEPTH = 5
RECALL = 0.9999
_RNG = np.random.default_rng(20240229)
_A = _RNG.integers(0, 1 << 32, COORDINATES, np.uint32) | np.uint32(1)
_B = _RNG.integers(0, 1 << 32, COORDINATES, np.uint32)
_MIX = [np.uint64(x) for x in (0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0xD6E8FEB86659FD93, 0xA0761D6478BD642F)]


def runs_needed(recall: float, threshold: float) -> int:
    """Runs after which a pair at the threshold has met with probability ``recall``.

    In a run each coordinate is sampled with probability 1 / (threshold x
    coordinates), so a pair shares one sampled token in the mean.
    """
    once = 1 - (1 - 1 / COORDINATES) ** COORDINATES
    return math.ceil(math.log(1 - recall) / math.log(1 - once))


def sampled(recall: float, threshold: float) -> np.ndarray:
    """The coordinates on which the runs split at their first level."""
    rng = np.random.default_rng(1)
    on = rng.random((runs_needed(recall, threshold), COORDINATES)) < 1 / (threshold * COORDINATES)
    return np.flatnonzero(on.any(0))


def shingles(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Shingle hashes (repeats kept) of the texts that have words, their starts, and the texts' numbers.

    A text of fewer than ``WORDS`` words is one shingle.
    """
    h, _, first = textbatch.words(data, offsets, textbatch.ALNUM)
    size = np.diff(first)
    docs = np.flatnonzero(size)
    if not len(docs):
        return np.zeros(0, np.uint64), np.zeros(0, np.int64), docs
    count = np.maximum(size[docs] - WORDS + 1, 1)
    starts = np.concatenate(([0], np.cumsum(count)[:-1]))
    at = np.arange(count.sum()) - np.repeat(starts - first[docs], count)
    end = np.repeat(first[docs] + size[docs], count)
    out = np.zeros(len(at), np.uint64)
    padded = np.append(h, np.zeros(WORDS, np.uint64))
    for k in range(WORDS):
        out += np.where(at + k < end, padded[at + k] * _MIX[k] + _MIX[k], np.uint64(0))
    return mix(out), starts, docs


def word_rows(data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """A 64-bit hash of each text's row of words; 0 for none."""
    h, _, first = textbatch.words(data, offsets, textbatch.ALNUM)
    size = np.diff(first)
    out = np.zeros(len(size), np.uint64)
    docs = np.flatnonzero(size)
    if len(docs):
        powers = np.full(int(size.max()), _MIX[3])
        powers[0] = 1
        powers = np.multiply.accumulate(powers)
        at = np.arange(len(h)) - np.repeat(first[docs], size[docs])
        out[docs] = mix(np.add.reduceat(h * powers[at], first[docs]) + size[docs].astype(np.uint64)) | np.uint64(1)
    return out


def sketched(docs: DataFrame, recall: float) -> DataFrame:
    """(doc_id, rep, sig, nodes, size): hash of the words, one byte per coordinate, first-level paths, number of shingles; nulls for no words."""
    chosen = sampled(recall, THRESHOLD[0] / THRESHOLD[1])
    schema = "doc_id long, rep long, sig binary, nodes array<long>, size long"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            data, offsets = textbatch.utf8(batch.column(1))
            for i, j in textbatch.slices(offsets):
                text, own = data[offsets[i] : offsets[j]], offsets[i : j + 1] - offsets[i]
                h, starts, there = shingles(text, own)
                x = (h >> np.uint64(32)).astype(np.uint32)
                low = np.empty((len(there), COORDINATES), np.uint32)
                for k in range(COORDINATES if len(there) else 0):
                    low[:, k] = np.minimum.reduceat(x * _A[k] + _B[k], starts)
                sig = (mix(low.astype(np.uint64)) & np.uint64(255)).astype(np.uint8)
                nodes = mix((low[:, chosen].astype(np.uint64) << np.uint64(16)) + chosen.astype(np.uint64)).view(np.int64)
                reps = word_rows(text, own)
                sigs, paths, sizes = [None] * (j - i), [None] * (j - i), np.zeros(j - i, np.int64)
                sizes[there] = np.diff(starts, append=len(h))
                for k, d in enumerate(there.tolist()):
                    sigs[d], paths[d] = sig[k].tobytes(), nodes[k]
                yield pa.RecordBatch.from_arrays(
                    [batch.column(0).slice(i, j - i), pa.array(reps.view(np.int64), mask=reps == 0), pa.array(sigs, pa.binary()), pa.array(paths, pa.list_(pa.int64())), pa.array(sizes)],
                    names=["doc_id", "rep", "sig", "nodes", "size"],
                )

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(run, schema)


def _roots(link: np.ndarray, names: np.ndarray) -> np.ndarray:
    """For each row the least name in its component of a boolean link matrix."""
    low = names.copy()
    while True:
        best = np.where(link, low[None, :], np.iinfo(np.int64).max).min(1)
        best = np.minimum(best, low)
        if (best == low).all():
            return low
        low = best


def _forest(name: np.ndarray, root: np.ndarray) -> pa.RecordBatch:
    on = root != name
    return pa.RecordBatch.from_arrays([pa.array(name[on]), pa.array(root[on])], names=["a", "b"])


def likely_edges(buckets: DataFrame, margin: float) -> DataFrame:
    """(a, b): forests of the sets in each bucket (bucket, rep, sig) whose embedded sets agree in ``margin`` or more."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for table in textbatch.grouped(batches):
            name = np.asarray(table["rep"])
            sig = np.frombuffer(b"".join(table["sig"].to_pylist()), np.uint8).reshape(-1, COORDINATES)
            same = np.empty((len(name), len(name)), bool)
            for i in range(len(name)):
                same[i] = (sig == sig[i]).sum(1) >= margin * COORDINATES
            yield _forest(name, _roots(same, name))

    dealt = buckets.select("bucket", "rep", "sig").repartition("bucket").sortWithinPartitions("bucket")
    return dealt.mapInArrow(run, "a long, b long")


def _splits(n: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """How many tokens each path below a bucket of n sets takes at once, and how many such paths.

    Enough tokens that a bucket in which six of ten sets share a token comes to
    about ``BUCKET`` sets, and enough paths that a pair at the threshold is in
    the mean together on 1.6 of them.
    """
    tokens = np.clip(np.ceil(np.log(n / BUCKET) / np.log(1 / 0.6)), 1, 6).astype(np.int64)
    return tokens, np.ceil(1.6 / (THRESHOLD[0] / THRESHOLD[1]) ** tokens).astype(np.int64)


def _descended(rows: DataFrame, joined: float, settled: float) -> DataFrame:
    """One step down from each row (rep, node, n, sig, center) of a large bucket of n sets.

    Gives (rep, other, edge).  A set that agrees with its bucket's center in
    ``joined`` or more is joined to the bucket (edge, other: the node).  One
    that agrees in ``settled`` or more is done here: disagreement is a metric,
    so whatever likely is linked to it is near enough to the center to be joined
    as well.  The others go on (no edge, other: a path below the node) on tokens
    sampled by the node.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for lo in range(0, batch.num_rows, 2000):
                part = batch.slice(lo, 2000)
                rep = np.asarray(part.column(0))
                sig, core = (np.frombuffer(b"".join(part.column(c).to_pylist()), np.uint8).reshape(-1, COORDINATES) for c in (3, 4))
                agree = (sig == core).mean(1)
                on = agree >= joined
                reps, others = [rep[on]], [np.asarray(part.column(1))[on]]
                left = np.flatnonzero(agree < settled)
                node, (tokens, paths) = np.asarray(part.column(1)).view(np.uint64), _splits(np.asarray(part.column(2)))
                for d in np.unique(tokens[left]).tolist():
                    own = left[tokens[left] == d]
                    for q in range(int(paths[own[0]])):
                        path = mix(node[own] * _MIX[1] + np.uint64(q + 1) * _MIX[2])
                        at = path
                        for _ in range(d):
                            at = mix(at + _MIX[0])
                            value = sig[own, (at % np.uint64(COORDINATES)).astype(np.int64)]
                            path = mix(path ^ (value.astype(np.uint64) * _MIX[4] + np.uint64(1)))
                        reps.append(rep[own])
                        others.append(path.view(np.int64))
                reps, others = np.concatenate(reps), np.concatenate(others)
                yield pa.RecordBatch.from_arrays([pa.array(reps), pa.array(others), pa.array(np.arange(len(reps)) < on.sum())], names=["rep", "other", "edge"])

    return rows.select("rep", "node", "n", "sig", "center").mapInArrow(run, "rep long, other long, edge boolean")


def _centers(members: DataFrame, sample: int = 33) -> DataFrame:
    """(node, n, center): of each bucket (node, n, rep, sig) the commonest value at each coordinate.

    Taken over ``sample`` members; the rank filter works in each task before
    the exchange.  A center only saves work: members far from it go on.
    """
    first = F.row_number().over(Window.partitionBy("node").orderBy(F.xxhash64("node", "rep")))
    some = members.withColumn("__k", first).where(F.col("__k") <= sample)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for table in textbatch.grouped(batches):
            sig = np.frombuffer(b"".join(table["sig"].to_pylist()), np.uint8).reshape(-1, COORDINATES)
            mode = bytes(int(np.bincount(sig[:, k]).argmax()) for k in range(COORDINATES))
            yield pa.RecordBatch.from_arrays([pa.array([table["node"][0].as_py()]), pa.array([table["n"][0].as_py()]), pa.array([mode], pa.binary())], names=["node", "n", "center"])

    return some.select("node", "n", "sig").repartition("node").sortWithinPartitions("node").mapInArrow(run, "node long, n long, center binary")


def candidates(reps: DataFrame, margin: float = 0.66) -> DataFrame:
    """(a, b): edges that join every pair likely at the threshold, over representatives (rep, sig, nodes).

    Ends of edges are representatives or, for large buckets, nodes.
    """
    sigs = reps.select("rep", "sig")
    rows = reps.select("rep", F.explode("nodes").alias("node"))
    edges = None
    for level in range(DEPTH):
        stats = rows.groupBy("node").agg(F.count("*").alias("n"), F.sum(F.xxhash64("rep").bitwiseAND((1 << 40) - 1)).alias("print"), F.min("rep").alias("least")).where("n > 1")
        stats = written(stats, "nodes")
        small = stats.where(f"n <= {BUCKET}").groupBy("n", "print", "least").agg(F.min("node").alias("node"))
        members = rows.join(small.select("node"), "node").select(F.col("node").alias("bucket"), "rep").join(sigs, "rep")
        found = likely_edges(members, margin)
        edges = found if edges is None else edges.union(found)
        big = stats.where(f"n > {BUCKET}")
        if big.isEmpty():
            break
        inside = written(rows.join(big.select("node", "n"), "node").join(sigs, "rep"), "inside")
        if level == DEPTH - 1:  # sets that still go together after so many splits
            edges = edges.union(inside.select(F.col("rep").alias("a"), F.col("node").alias("b")))
        else:
            below = written(_descended(inside.join(written(_centers(inside), "centers").drop("n"), "node"), 0.45, 0.8), "paths")
            edges = edges.union(below.where("edge").select(F.col("rep").alias("a"), F.col("other").alias("b")))
            rows = below.where("not edge").select("rep", F.col("other").alias("node"))
    return edges.where("a <> b").distinct()


def decided(sets: DataFrame) -> DataFrame:
    """(rep, links, root): the exact links of each block pair.

    Rows: (pair, rep, side, weight, shingles as binary).  Side 0 and 1 are the
    two blocks of a pair, 2 a block with itself.  ``links`` is the weight of the
    rep's partners in this pair of blocks, ``root`` the least rep it is linked to here.
    """
    top, bottom = THRESHOLD

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for table in textbatch.grouped(batches):
            name, first = np.unique(np.asarray(table["rep"]), return_index=True)
            if len(name) < 2:
                continue
            side, weight = np.asarray(table["side"])[first], np.asarray(table["weight"])[first]
            raw = table["shingles"].take(pa.array(first)).to_pylist()
            own = [np.frombuffer(x, np.uint64) for x in raw]
            size = np.array([len(x) for x in own])
            row = np.repeat(np.arange(len(own)), size)
            _, col, seen = np.unique(np.concatenate(own), return_inverse=True, return_counts=True)
            shared = seen > 1
            number = np.cumsum(shared) - 1
            keep = shared[col]
            row, col = row[keep], number[col[keep]]
            order = np.argsort(col, kind="stable")
            row, col = row[order], col[order]
            both = np.zeros((len(own), len(own)), np.float32)
            for lo in range(0, int(shared.sum()), 4096):
                i, j = np.searchsorted(col, (lo, lo + 4096))
                x = np.zeros((len(own), 4096), np.float32)
                x[row[i:j], col[i:j] - lo] = 1
                both += x @ x.T
            common = both.astype(np.int64)
            link = bottom * common >= top * (size[:, None] + size[None, :] - common)
            np.fill_diagonal(link, False)
            link &= (side[:, None] == 2) | (side[:, None] != side[None, :])
            on = link.any(1)
            yield pa.RecordBatch.from_arrays([pa.array(name[on]), pa.array((link @ weight)[on]), pa.array(_roots(link, name)[on])], names=["rep", "links", "root"])

    dealt = sets.select("pair", "rep", "side", "weight", "shingles").repartition("pair").sortWithinPartitions("pair")
    return dealt.mapInArrow(run, "rep long, links long, root long")


def _sets(docs: DataFrame) -> DataFrame:
    """(rep, doc_id, shingles): each text's set of shingles, sorted 64-bit hashes."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            data, offsets = textbatch.utf8(batch.column(1))
            for i, j in textbatch.slices(offsets):
                text, own = data[offsets[i] : offsets[j]], offsets[i : j + 1] - offsets[i]
                h, starts, there = shingles(text, own)
                parts = [np.unique(p).tobytes() for p in np.split(h, starts[1:])] if len(there) else []
                reps = word_rows(text, own)[there].view(np.int64)
                yield pa.RecordBatch.from_arrays([pa.array(reps, pa.int64()), batch.column(0).slice(i, j - i).take(pa.array(there)), pa.array(parts, pa.binary())], names=["rep", "doc_id", "shingles"])

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(run, "rep long, doc_id long, shingles binary")


def classes(docs: DataFrame, recall: float = RECALL) -> DataFrame:
    """(doc_id, class_id, n_links): one row per document.

    ``class_id`` is the least id in the document's class: documents joined by
    links, where a link is a Jaccard similarity of 0.8 or more between the sets
    of word 5-shingles (A-Z lower-cased; words of letters, digits and non-ASCII
    characters; a shorter text is one shingle).  ``n_links`` counts the linked
    documents, copies one by one.  Null, empty and wordless texts have no links
    and are classes of their own.  Rows with a null id take part; a class of
    null ids only has a null id.
    """
    return _classes(docs, recall).select("doc_id", "class_id", "n_links")


def _classes(docs: DataFrame, recall: float) -> DataFrame:
    """What ``classes`` gives, with ``rep`` (hash of the words) and ``label`` (of the class)."""
    table = written(sketched(docs, recall), "sketches")
    grouped = table.where("rep is not null").groupBy("rep").agg(F.count("*").alias("weight"), F.min("doc_id").alias("id"), F.first("sig").alias("sig"), F.first("nodes").alias("nodes"), F.first("size").alias("size"))
    reps = written(grouped, "representatives")
    edges = candidates(reps)
    group = components(edges).withColumnRenamed("v", "rep").join(reps.select("rep", "weight", "id", "size"), "rep")
    blocks = F.greatest(F.ceil(F.count("*") / BLOCK), F.ceil(8 * F.sum("size") / BLOCK_BYTES))
    sizes = group.groupBy("label").agg(blocks.cast("int").alias("blocks"))
    member = group.drop("size").join(sizes, "label")
    member = written(member.withColumn("block", F.pmod(F.xxhash64("rep"), "blocks").cast("int")), "members")
    other = F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)).alias("other")
    sets = _sets(docs).join(member.hint("merge"), "rep").where("doc_id <=> id").select("label", "rep", "block", "weight", "shingles", other)
    side: Column = F.when(F.col("block") == F.col("other"), 2).when(F.col("block") < F.col("other"), 0).otherwise(1)
    pair = F.xxhash64("label", F.least("block", "other"), F.greatest("block", "other"))
    links = written(decided(sets.select(pair.alias("pair"), "rep", side.cast("int").alias("side"), "weight", "shingles")), "links")
    label = components(links.select(F.col("rep").alias("a"), F.col("root").alias("b")))
    count = links.groupBy("rep").agg(F.sum("links").alias("links"))
    named = reps.select("rep", "weight", "id").join(label.withColumnRenamed("v", "rep"), "rep", "left").join(count, "rep", "left")
    named = written(named.withColumn("label", F.coalesce("label", "rep")), "labelled")
    least = written(named.groupBy("label").agg(F.min("id").alias("class_id")), "classes")
    final = written(named.join(least, "label").select("rep", "label", "class_id", (F.col("weight") - 1 + F.coalesce("links", F.lit(0))).alias("n_links")), "classes")
    out = table.select("doc_id", "rep").join(final, "rep", "left")
    return out.select("doc_id", "rep", "label", F.when(F.col("rep").isNull(), F.col("doc_id")).otherwise(F.col("class_id")).alias("class_id"), F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"))


def one_of_each(docs: DataFrame, recall: float = RECALL) -> DataFrame:
    """``docs`` with one row of each class: a row whose id names the class.

    Rows without words stay, and so do rows with a null id: nothing names
    them.  Ids that stand for several texts are told apart by their words; of
    rows that repeat both id and words, one stays.
    """
    rep, id_, keep, own = (fresh(docs, f"__{x}") for x in ("rep", "id", "keep", "own"))
    named = _classes(docs, recall).where("rep is not null and doc_id = class_id")
    first = named.groupBy("label").agg(F.min(F.struct("rep", "doc_id")).alias("k"))
    keepers = written(first.select(F.col("k.rep").alias(rep), F.col("k.doc_id").alias(id_), F.lit(True).alias(keep)), "keepers")
    rows = _with_rep(docs, rep).withColumn(id_, F.col("doc_id").cast("long"))
    kept = rows.join(keepers, [id_, rep], "left").where(F.col(keep) | F.col(id_).isNull() | F.col(rep).isNull())
    alone = F.when(F.col(keep), F.lit(-1)).otherwise(F.monotonically_increasing_id())
    return kept.withColumn(own, alone).dropDuplicates([id_, rep, own]).select(*docs.columns)


def _with_rep(docs: DataFrame, name: str) -> DataFrame:
    """``docs`` with the hash of each text's words."""
    schema = T.StructType([*docs.schema.fields, T.StructField(name, T.LongType())])
    where = docs.columns.index("text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            data, offsets = textbatch.utf8(batch.column(where))
            parts = [word_rows(data[offsets[i] : offsets[j]], offsets[i : j + 1] - offsets[i]) for i, j in textbatch.slices(offsets)]
            rep = np.concatenate(parts) if parts else np.zeros(0, np.uint64)
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(rep.view(np.int64), mask=rep == 0)], names=schema.names)

    return docs.mapInArrow(run, schema)


def query(spark, sf_dir: str) -> DataFrame:
    """op6: class and number of links of every document."""
    return classes(spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text"))
