"""Language-model scoring with a probabilistic suffix tree.

The tree's alphabet is every byte of the training texts (A-Z lower-cased), an
escape for bytes that never stand there and an end.  Counts of all contexts of up to
``DEPTH`` symbols, with the next symbol, come from every training text.  A
context stays if its next-symbol counts diverge from those of its longest kept
suffix by more than a likelihood-ratio test allows; kept distributions are
smoothed towards that suffix.  A symbol is scored in the longest kept suffix of
what stands before it.

Every symbol counted after a context that occurs at least twice takes part in
the test.  It runs depth by depth as joins and groups of written tables, which
grow with the corpus.  Only a head is broadcast: codes (a symbol and the
``DEPTH`` before it) with a share of at least ``p_min`` of all places, so at
most 1 / ``p_min`` of them.  The other codes of a text are joined with the
tables, so ``p_min`` does not change a score.

Word counts for the base score have no such bound.  The commonest words (at
most ``head``, found from a histogram of the counts) are broadcast; each other
word of a text is joined with the counts by hash.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from stratalog.llm import textbatch
from stratalog.llm.language import held_out
from stratalog.llm.store import fresh, written

SYMBOLS = 258
DEPTH = 5
END, ESCAPE = SYMBOLS - 1, SYMBOLS - 2
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
_WORD, _GRAM, _TEXT = 0, 1, 2


def alphabet(histogram: np.ndarray) -> np.ndarray:
    """The symbol of each byte: itself, or the escape if it was never counted."""
    return np.where(histogram > 0, np.arange(256), ESCAPE)


def codes(data: np.ndarray, offsets: np.ndarray, symbol: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """For each byte, and each text's end, its symbol and the ``DEPTH`` before it as one number; where each text starts.

    Before a text stand ends.
    """
    n, docs = len(data), len(offsets) - 1
    row = np.full(n + (DEPTH + 1) * docs, END, np.int64)
    size = np.diff(offsets)
    row[np.arange(n) + np.repeat((DEPTH + 1) * np.arange(docs) + DEPTH, size)] = symbol[_LOWER[data]]
    own = np.arange(n + docs) + np.repeat(DEPTH * np.arange(1, docs + 1), size + 1)
    code = row[own - DEPTH]
    for k in range(DEPTH - 1, -1, -1):
        code = code * SYMBOLS + row[own - k]
    return code, offsets[:-1] + np.arange(docs)


@dataclass
class Level:
    """The head of one depth: kept contexts, sorted, with the factor for symbols that are not in the head;
    and symbols after contexts (context x SYMBOLS + symbol), sorted, with their probability."""

    contexts: np.ndarray
    left: np.ndarray
    grams: np.ndarray
    p: np.ndarray

    def apply(self, grams: np.ndarray, shorter: np.ndarray) -> np.ndarray:
        out = shorter
        if len(self.contexts):
            context = grams // SYMBOLS
            at = np.minimum(np.searchsorted(self.contexts, context), len(self.contexts) - 1)
            out = np.where(self.contexts[at] == context, self.left[at] * shorter, shorter)
        found, p = known_in(self.grams, self.p, grams)
        return np.where(found, p, out)


def known_in(keys: np.ndarray, values: np.ndarray, asked: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Whether each key asked for is in the sorted ``keys``, and its value."""
    if not len(keys):
        return np.zeros(len(asked), bool), np.zeros(len(asked))
    at = np.minimum(np.searchsorted(keys, asked), len(keys) - 1)
    return keys[at] == asked, values[at]


@dataclass
class Tree:
    """Each symbol's probability without context, the heads of depths 1 to ``DEPTH``, and log10 of each byte within its symbol.

    ``tables`` has for each depth the whole of it: context, gram, n, total, shorter, kept, p and left.
    """

    symbol: np.ndarray
    single: np.ndarray
    levels: list[Level]
    byte: np.ndarray
    tables: list[DataFrame]

    def probability(self, code: np.ndarray) -> np.ndarray:
        """By the head alone: exact for its codes; the others after a context share what is left."""
        p = self.single[code % SYMBOLS]
        for k, level in enumerate(self.levels, 1):
            p = level.apply(code % SYMBOLS ** (1 + k), p)
        return p


def logs(codes: DataFrame, tree: Tree) -> DataFrame:
    """(code, log): log10 probability of distinct codes by the whole tree.

    A code that was never counted has the probability of its longest counted
    suffix, times what the longer kept contexts leave.
    """
    spark = codes.sparkSession
    whole = tree.tables[-1].select(F.col("gram").alias("code"), "p")
    joined = written(codes.join(whole, "code", "left"), "codes")
    parts = [spark.createDataFrame([(0, i, float(p)) for i, p in enumerate(tree.single)], "kind int, key long, value double")]
    asked = [F.struct(F.lit(0).alias("kind"), (F.col("code") % SYMBOLS).alias("key"))]
    for depth, table in enumerate(tree.tables, 1):
        parts.append(table.select(F.lit(depth).alias("kind"), F.col("gram").alias("key"), F.col("p").alias("value")))
        parts.append(table.where("kept").groupBy("context").agg(F.first("left").alias("value")).select(F.lit(-depth).alias("kind"), F.col("context").alias("key"), "value"))
        gram = F.col("code") % SYMBOLS ** (depth + 1)
        asked += [F.struct(F.lit(depth).alias("kind"), gram.alias("key")), F.struct(F.lit(-depth).alias("kind"), F.expr(f"(code % {SYMBOLS ** (depth + 1)}) div {SYMBOLS}").alias("key"))]
    values = parts[0]
    for part in parts[1:]:
        values = values.unionByName(part)
    one = joined.where("p is null").select("code", F.explode(F.array(*asked)).alias("a")).select("code", "a.kind", "a.key")
    found = one.join(values, ["kind", "key"]).groupBy("code").agg(F.max(F.when(F.col("kind") >= 0, F.struct("kind", "value"))).alias("suffix"), F.collect_list(F.when(F.col("kind") < 0, F.struct("kind", "value"))).alias("left"))
    left = F.aggregate("left", F.lit(0.0), lambda a, x: a + F.when(-x["kind"] > F.col("suffix.kind"), F.log10(x["value"])).otherwise(0.0))
    new = found.select("code", (F.log10("suffix.value") + left).alias("log"))
    return joined.where("p is not null").select("code", F.log10("p").alias("log")).unionByName(new)


def _histogram(texts: DataFrame) -> np.ndarray:
    """Counts of the bytes, A-Z lower-cased: one row for each task and byte, summed by Spark."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(256, np.int64)
        for batch in batches:
            data, offsets = textbatch.utf8(batch.column(0))
            for i, j in textbatch.slices(offsets):
                total += np.bincount(_LOWER[data[offsets[i] : offsets[j]]], minlength=256)
        yield pa.RecordBatch.from_arrays([pa.array(range(256), pa.int32()), pa.array(total)], names=["byte", "n"])

    out = np.zeros(256, np.int64)
    for row in texts.select("text").mapInArrow(run, "byte int, n long").groupBy("byte").agg(F.sum("n").alias("n")).collect():
        out[row.byte] = row.n
    return out


def _summed(keys: list[np.ndarray], counts: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    key, at = np.unique(np.concatenate(keys), return_inverse=True)
    return key, np.bincount(at, np.concatenate(counts)).astype(np.int64)


def _counted(texts: DataFrame, symbol: np.ndarray) -> DataFrame:
    """(kind, key, n): counts of words by hash, of grams by code, and of texts."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        grams: tuple[np.ndarray, np.ndarray] = (np.zeros(0, np.int64), np.zeros(0, np.int64))
        texts = 0

        def rows(kind: int, key: np.ndarray, n: np.ndarray) -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array(np.full(len(key), kind, np.int32)), pa.array(key), pa.array(n)], names=["kind", "key", "n"])

        for batch in batches:
            data, offsets = textbatch.utf8(batch.column(0))
            texts += len(offsets) - 1
            for i, j in textbatch.slices(offsets, 2 << 20):
                text, own = data[offsets[i] : offsets[j]], offsets[i : j + 1] - offsets[i]
                seen, n = np.unique(codes(text, own, symbol)[0], return_counts=True)
                grams = _summed([grams[0], seen], [grams[1], n])
                key, n = np.unique(textbatch.words(text, own, textbatch.SPACED)[0], return_counts=True)
                yield rows(_WORD, key.view(np.int64), n)
        yield rows(_GRAM, *grams)
        yield rows(_TEXT, np.zeros(1, np.int64), np.array([texts], np.int64))

    return texts.select("text").mapInArrow(run, "kind int, key long, n long").groupBy("kind", "key").agg(F.sum("n").alias("n"))


@dataclass
class Lexicon:
    """Sizes of the training words, the commonest words' hashes (sorted) and counts, and the table of the others."""

    tokens: int
    distinct: int
    texts: int
    words: np.ndarray
    counts: np.ndarray
    rest: DataFrame | None


def _tree(grams: DataFrame, histogram: np.ndarray, p_min: float, pull: float = 4.0, test: float = 2.0) -> Tree:
    """The tree from (key, n) counts of codes; each table that reaches the driver is bounded (see above)."""
    symbol = alphabet(histogram)
    rare = symbol == ESCAPE
    byte = np.zeros(256)
    byte[rare] = np.log10((histogram[rare] + 0.5) / (histogram[rare].sum() + 0.5 * rare.sum()))
    single = np.ones(SYMBOLS)
    for row in grams.groupBy((F.col("key") % SYMBOLS).alias("key")).agg(F.sum("n").alias("n")).collect():
        single[row.key] += row.n
    single /= single.sum()
    tree = Tree(symbol, single, [], byte, [])
    least = max(2, int(np.ceil(p_min * histogram.sum())))
    shorter = grams.sparkSession.createDataFrame(list(enumerate(single.tolist())), "suffix long, shorter double")

    def gathered(rows: DataFrame) -> list[np.ndarray]:
        columns = [c.to_numpy() for c in rows.toArrow().columns]
        order = np.argsort(columns[0])
        return [c[order] for c in columns]

    for depth in range(1, DEPTH + 1):
        counts = grams.groupBy((F.col("key") % SYMBOLS ** (depth + 1)).alias("gram")).agg(F.sum("n").alias("n"))
        rows = counts.withColumn("suffix", F.col("gram") % SYMBOLS**depth).join(shorter, "suffix").select(F.expr(f"gram div {SYMBOLS}").alias("context"), "gram", "n", "shorter")
        group = Window.partitionBy("context")
        rows = rows.withColumns({"total": F.sum("n").over(group), "gain": F.sum(F.col("n") * F.log(F.col("n") / F.col("shorter"))).over(group), "seen": F.count("*").over(group)})
        kept = (F.col("total") >= 2) & (2 * (F.col("gain") - F.col("total") * F.log("total")) > test * (F.col("seen") + int(depth > 3)))
        left = F.lit(pull) / (F.col("total") + pull)
        rows = rows.withColumns({"kept": kept, "left": left})
        p = F.when(F.col("kept"), F.col("n") / (F.col("total") + pull) + F.col("left") * F.col("shorter")).otherwise(F.col("shorter"))
        table = written(rows.select("context", "gram", "n", "total", "shorter", "kept", p.alias("p"), "left"), "contexts")
        tree.tables.append(table)
        head = F.col("n") >= least
        sums = table.where((F.col("total") >= least) & F.col("kept")).groupBy("context").agg(F.first("left").alias("left"), (F.sum(F.when(~head, F.col("n")).otherwise(0)) / (F.first("total") + pull)).alias("rest"), F.sum(F.when(head, F.col("shorter")).otherwise(0.0)).alias("passed"))
        contexts, left, rest, passed = gathered(sums)
        tree.levels.append(Level(contexts, left + rest / np.maximum(1 - passed, 1e-12), *gathered(table.where(head).select("gram", "p"))))
        shorter = table.select(F.col("gram").alias("suffix"), F.col("p").alias("shorter"))
    return tree


def learn(training: DataFrame, head: int = 200_000, p_min: float = 3e-7) -> tuple[Tree, Lexicon]:
    """Tree and word counts of all texts in ``training`` (column text; null is empty)."""
    texts = training.select(F.coalesce("text", F.lit("")).alias("text"))
    histogram = _histogram(texts)
    table = written(_counted(texts, alphabet(histogram)), "counts")
    tree = _tree(table.where(F.col("kind") == _GRAM).select("key", "n"), histogram, p_min)
    words = table.where(F.col("kind") == _WORD)
    # Counts up to 1,000 by themselves, larger ones by three digits: some thousand rows at most.
    digits = F.greatest(F.length(F.col("n").cast("string")) - 3, F.lit(0))
    rounded = (F.floor(F.col("n") / F.pow(F.lit(10.0), digits)) * F.pow(F.lit(10.0), digits)).cast("long")
    sizes = sorted(words.groupBy(rounded.alias("least")).agg(F.count("*").alias("words"), F.sum("n").alias("n")).collect(), reverse=True)
    least, taken = None, 0
    for row in sizes:
        if taken + row.words > head:
            break
        least, taken = row.least, taken + row.words
    common = words.where(F.col("n") >= least).select("key", "n").toArrow() if least is not None else None
    key = np.asarray(common["key"], np.int64).view(np.uint64) if common else np.zeros(0, np.uint64)
    order = np.argsort(key)
    docs = table.where(F.col("kind") == _TEXT).agg(F.coalesce(F.sum("n"), F.lit(0))).first()[0]
    lexicon = Lexicon(
        sum(r.n for r in sizes) + docs,
        sum(r.words for r in sizes) + (docs > 0),
        docs,
        key[order],
        np.asarray(common["n"], np.int64)[order] if common else np.zeros(0, np.int64),
        words.where(F.col("n") < least).select("key", "n") if least is not None else words.select("key", "n"),
    )
    return tree, lexicon


def score(docs: DataFrame, tree: Tree, lexicon: Lexicon) -> DataFrame:
    """``docs`` (without its text) with n_tokens, n_known, train_tokens, base_score and score.

    A null text is empty: one token, the end.  Rows stay as they are; columns
    of the added names are replaced.
    """
    rest = [c for c in docs.columns if c not in ("n_tokens", "n_known", "train_tokens", "base_score", "score", "text")]
    base_, rare_, tail_, row_ = (fresh(docs, f"__{x}") for x in ("base", "rare", "tail", "row"))
    added = T.StructType.fromDDL(f"n_tokens long, n_known long, {base_} double, score double, {rare_} array<long>, {tail_} array<struct<code:long,times:long>>")
    docs = docs.select(*rest, "text")
    schema = T.StructType([*docs.schema.fields[:-1], *added.fields])
    shared = docs.sparkSession.sparkContext.broadcast((tree.symbol, tree.byte, tree.levels[-1].grams, np.log10(tree.levels[-1].p), lexicon.words, lexicon.counts))
    ends = lexicon.texts

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        symbol, byte, grams, chances, words, counts = shared.value
        logs = np.append(np.log10(counts + 0.1), -1.0)  # the last: a rare word, until the join finds it
        words = np.append(words, np.uint64(0xFFFFFFFFFFFFFFFF))
        real = len(counts)
        for batch in batches:
            data, offsets = textbatch.utf8(batch.column(len(rest)))
            for i, j in textbatch.slices(offsets):
                text, own = data[offsets[i] : offsets[j]], offsets[i : j + 1] - offsets[i]
                h, _, first = textbatch.words(text, own, textbatch.SPACED)
                at = np.searchsorted(words[:real], h)
                found = (words[at] == h) & (at < real)
                gain = np.concatenate(([0.0], np.cumsum(logs[np.where(found, at, real)])))
                known = np.concatenate(([0], np.cumsum(found)))
                rare = h[~found].view(np.int64)
                left = np.arange(len(h) + 1) - known
                code, starts = codes(text, own, symbol)
                seen, place = np.unique(code, return_inverse=True)
                settled, chance = known_in(grams, chances, seen)
                extra = np.concatenate(([0.0], np.cumsum(byte[_LOWER[text]])))
                total = np.add.reduceat(np.where(settled, chance, 0.0)[place], starts) + extra[own[1:]] - extra[own[:-1]]
                open_ = np.flatnonzero(~settled[place])
                pair = (np.searchsorted(starts, open_, "right") - 1) * len(seen) + place[open_]
                pair, times = np.unique(pair, return_counts=True)
                ends_at = np.searchsorted(pair, np.arange(len(own)) * len(seen)).astype(np.int32)
                tail = pa.StructArray.from_arrays([pa.array(seen[pair % len(seen)]), pa.array(times)], names=["code", "times"])
                yield pa.RecordBatch.from_arrays(
                    [
                        *[c.slice(i, j - i) for c in batch.columns[: len(rest)]],
                        pa.array(np.diff(first) + 1),
                        pa.array(np.diff(known[first]) + (ends > 0)),
                        pa.array(np.diff(gain[first]) + np.log10(ends + 0.1)),
                        pa.array(total),
                        pa.ListArray.from_arrays(pa.array(left[first].astype(np.int32)), pa.array(rare)),
                        pa.ListArray.from_arrays(pa.array(ends_at), tail),
                    ],
                    names=schema.names,
                )

    table = written(docs.mapInArrow(run, schema).withColumn(row_, F.monotonically_increasing_id()), "scores")
    rare = table.where(F.size(rare_) > 0).select(row_, F.explode(rare_).alias("key"))
    tail = table.where(F.size(tail_) > 0).select(row_, F.explode(tail_).alias("t")).select(row_, "t.code", "t.times")
    found = rare.join(lexicon.rest, "key").select(row_, F.lit(1).alias("found"), (F.log10(F.col("n") + 0.1) + 1.0).alias("gain"), F.lit(0.0).alias("more"))
    later = tail.join(logs(tail.select("code").distinct(), tree), "code").select(row_, F.lit(0).alias("found"), F.lit(0.0).alias("gain"), (F.col("times") * F.col("log")).alias("more"))
    sums = found.unionByName(later).groupBy(row_).agg(F.struct(F.sum("found").alias("found"), F.sum("gain").alias("gain"), F.sum("more").alias("more")).alias(rare_))
    whole = float(np.log10(lexicon.tokens + 0.1 * (lexicon.distinct + 1)))
    out = table.drop(rare_, tail_).join(sums, row_, "left")
    more = lambda c: F.coalesce(F.col(rare_)[c], F.lit(0))
    return out.select(
        *rest,
        "n_tokens",
        (F.col("n_known") + more("found")).alias("n_known"),
        F.lit(lexicon.tokens).cast("long").alias("train_tokens"),
        (F.col(base_) + more("gain") - F.col("n_tokens") * whole).alias("base_score"),
        (F.col("score") + more("more")).alias("score"),
    )


def query(spark, sf_dir: str) -> DataFrame:
    """op8: base and model score of every document."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    tree, lexicon = learn(docs.where(~held_out(10, 0)))
    return score(docs.withColumn("held_out", held_out(10, 0)), tree, lexicon).select("doc_id", "held_out", "n_tokens", "n_known", "train_tokens", "base_score", "score")
