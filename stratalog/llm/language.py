"""Language identification with error-correcting output codes.

Every language has a codeword of +1 and -1; for each of its places a binary
n-gram classifier tells the languages with +1 from those with -1.  A text's
margins are decoded to the codeword of least weighted loss, where a language's
weight on a place follows how well that classifier parts it from the border;
a small lead over the next codeword flags the text as ambiguous.

Training gathers, over all labelled rows, the counts of hashed byte n-grams of
each language: one partial row of counts per task, language and block of
buckets, summed by Spark.  The model is languages x buckets numbers, whatever
the number of documents.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from stratalog.llm import textbatch
from stratalog.llm.store import fresh

BUCKETS = 1 << 14
BLOCK = 1 << 10
ADDED = ("lang_pred", "score", "ambiguous")
UNDETERMINED = "und"
_FOLD = np.arange(256, dtype=np.uint8)
_FOLD[65:91] += 32
_FOLD[:65] = 32  # controls, digits and signs count as space
_FOLD[91:97] = 32
_FOLD[123:128] = 32


def grams(data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """The bucket of the byte trigram that ends at each byte; none spans two texts."""
    b = _FOLD[data].astype(np.uint32)
    b1, b2 = np.empty_like(b), np.empty_like(b)
    b1[1:], b2[2:] = b[:-1], b[:-2]
    heads = offsets[:-1]
    at = heads[heads < len(b)]
    b1[at] = 32
    b2[at] = 32
    at = at[at + 1 < len(b)] + 1
    b2[at] = 32
    return (((b2 << 16) | (b1 << 8) | b) * np.uint32(0x9E3779B1)) >> np.uint32(32 - 14)


@dataclass
class Model:
    """Languages, codewords (languages x places), gram weights (buckets x places), scales and decoding weights."""

    langs: list[str]
    code: np.ndarray
    gram: np.ndarray
    scale: np.ndarray
    weight: np.ndarray
    prior: float = 8.0

    def margins(self, data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
        """Mean margin of each text and place, about 1 in size for a plain text of one language."""
        sums = np.zeros((len(offsets) - 1, self.code.shape[1]))
        if len(data):
            h = grams(data, offsets)
            full = np.flatnonzero(np.diff(offsets))
            for k in range(self.code.shape[1]):
                sums[full, k] = np.add.reduceat(self.gram[k][h], offsets[full], dtype=np.float64)
        return sums / (np.diff(offsets)[:, None] + self.prior) / self.scale

    def losses(self, margins: np.ndarray) -> np.ndarray:
        """Weighted logistic loss of each text against each codeword."""
        loss = np.logaddexp(0.0, -3.0 * margins[:, None, :] * self.code[None, :, :])
        return (loss * self.weight[None, :, :]).sum(2)

    def predict(self, data: np.ndarray, offsets: np.ndarray) -> tuple[list[str], np.ndarray, np.ndarray]:
        """Best language, its share of exp(-loss), and its lead over the next."""
        losses = self.losses(self.margins(data, offsets))
        order = np.argsort(losses, 1, kind="stable")
        p = np.exp(4.0 * (losses.min(1, keepdims=True) - losses))
        p /= p.sum(1, keepdims=True)
        ranked = np.take_along_axis(p, order, 1)
        lead = ranked[:, 0] - (ranked[:, 1] if ranked.shape[1] > 1 else 0.0)
        return [self.langs[i] for i in order[:, 0].tolist()], ranked[:, 0], lead


def codewords(n: int, seed: int = 7) -> np.ndarray:
    """All ways to part up to 5 languages in two; for more, the best of 64 random codes of 10 log2(n) places."""
    if n < 2:
        return np.ones((n, 1), np.int8)
    if n <= 5:
        cut = np.arange(1, 1 << (n - 1))
        return np.where((cut[None, :] >> np.arange(n)[:, None]) & 1, 1, -1).astype(np.int8)
    places, rng, best = math.ceil(10 * math.log2(n)), np.random.default_rng(seed), None
    for _ in range(64):
        code = rng.choice(np.array([-1, 1], np.int8), (n, places))
        code = code[:, np.abs(code.sum(0)) < n]
        far = ((code[:, None, :] != code[None, :, :]).sum(2) + 10**6 * np.eye(n, dtype=int)).min()
        if best is None or far > best[0]:
            best = (far, code)
    return best[1]


def fit(counts: dict[str, np.ndarray]) -> Model:
    """The classifiers of all places, from each language's gram counts; languages weigh alike."""
    langs = sorted(counts)
    c = np.stack([counts[x] for x in langs]).astype(np.float64)
    p = (c + 0.5) / (c.sum(1, keepdims=True) + 0.5 * c.shape[1])
    code = codewords(len(langs))
    gram, scale, weight = [], [], []
    for k in range(code.shape[1]):
        on = code[:, k] > 0
        w = np.log(p[on].mean(0)) - np.log(p[~on].mean(0)) if on.any() and not on.all() else np.zeros(p.shape[1])
        mean = p @ w
        centre = (mean[on].min() + mean[~on].max()) / 2 if on.any() and not on.all() else 0.0
        w -= centre
        mean -= centre
        spread = np.sqrt(np.maximum(p @ w**2 - mean**2, 1e-12))
        gram.append(w.astype(np.float32))
        scale.append(max(np.abs(mean).mean(), 1e-9))
        weight.append(np.maximum(mean * code[:, k], 0) / spread)
    weight = np.array(weight).T + 1e-6
    return Model(langs, code.astype(np.float64), np.stack(gram), np.array(scale), weight / weight.sum(1, keepdims=True))


def gram_counts(rows: DataFrame) -> DataFrame:
    """(lang, block, counts): n-gram counts of each language, as arrays of ``BLOCK`` buckets."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total: dict[str, np.ndarray] = {}
        for batch in batches:
            data, offsets = textbatch.utf8(batch.column(1))
            for i, j in textbatch.slices(offsets):
                langs = batch.column(0).slice(i, j - i).to_pylist()
                names = sorted(set(langs))
                own = offsets[i : j + 1] - offsets[i]
                h = grams(data[offsets[i] : offsets[j]], own).astype(np.int64)
                number = {x: n for n, x in enumerate(names)}
                which = np.repeat(np.array([number[x] for x in langs], np.int64), np.diff(own))
                found = np.bincount(which * BUCKETS + h, minlength=len(names) * BUCKETS).reshape(-1, BUCKETS)
                for x, row in zip(names, found, strict=True):
                    total[x] = total[x] + row if x in total else row
        for x, row in total.items():
            blocks = row.reshape(-1, BLOCK)
            yield pa.RecordBatch.from_arrays([pa.array([x] * len(blocks)), pa.array(range(len(blocks)), pa.int32()), pa.array(blocks.tolist(), pa.list_(pa.int64()))], names=["lang", "block", "counts"])

    def add(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total: dict[tuple[str, int], np.ndarray] = {}
        for part in parts:
            if part.num_rows:
                rows = np.stack([np.asarray(x) for x in part.column(2).to_pylist()])
                for x, block, row in zip(part.column(0).to_pylist(), part.column(1).to_pylist(), rows, strict=True):
                    total[x, block] = total[x, block] + row if (x, block) in total else row
        yield pa.RecordBatch.from_arrays(
            [pa.array([k[0] for k in total], pa.string()), pa.array([k[1] for k in total], pa.int32()), pa.array([v.tolist() for v in total.values()], pa.list_(pa.int64()))],
            names=["lang", "block", "counts"],
        )

    schema = "lang string, block int, counts array<long>"
    partial = rows.select("lang", F.coalesce("text", F.lit("")).alias("text")).mapInArrow(run, schema)
    return partial.repartition("lang", "block").mapInArrow(add, schema)


def train(rows: DataFrame) -> Model | None:
    """A model from ``rows`` (text, lang); None where no row has a language.

    All rows with a language count.  The driver gets one row of ``BLOCK``
    counts at a time and keeps ``BUCKETS`` counts for each language; any number
    of languages is taken, and none of it grows with the documents.
    """
    counts: dict[str, np.ndarray] = {}
    for row in gram_counts(rows.where("lang is not null")).toLocalIterator():
        counts.setdefault(row.lang, np.zeros(BUCKETS, np.int64))[row.block * BLOCK : (row.block + 1) * BLOCK] = row.counts
    return fit(counts) if counts else None


def identify(docs: DataFrame, model: Model | None, ambiguity: float = 0.1, text_back: bool = True) -> DataFrame:
    """``docs`` with ``lang_pred``, ``score`` (0 to 1) and ``ambiguous``.

    Only the text is looked at; without ``text_back`` it is not returned.  A
    text that is null or has no letter, or any text under no model, is ``und``
    with score 0.  Columns of the added names are replaced; rows stay as they
    are; nothing is shuffled.
    """
    docs = docs.select(*[c for c in docs.columns if c not in (*ADDED, "text")], "text")
    rest = docs.columns[: None if text_back else -1]
    added = [T.StructField("lang_pred", T.StringType()), T.StructField("score", T.DoubleType()), T.StructField("ambiguous", T.BooleanType())]
    schema = T.StructType([*(docs.schema[c] for c in rest), *added])
    if model is None:
        return docs.select(*rest, F.lit(UNDETERMINED).alias("lang_pred"), F.lit(0.0).alias("score"), F.lit(True).alias("ambiguous"))
    shared, text = docs.sparkSession.sparkContext.broadcast(model), len(docs.columns) - 1
    lettered = F.coalesce(F.col("text").rlike(r"\p{L}"), F.lit(False)).alias(fresh(docs, "__lettered"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = shared.value
        for batch in batches:
            on = np.asarray(batch.column(text + 1), bool)
            data, offsets = textbatch.utf8(batch.column(text))
            names, scores, leads = [], [np.zeros(0)], [np.zeros(0)]
            for i, j in textbatch.slices(offsets):
                n, s, lead = model.predict(data[offsets[i] : offsets[j]], offsets[i : j + 1] - offsets[i])
                names += n
                scores.append(s)
                leads.append(lead)
            names = [n if x else UNDETERMINED for n, x in zip(names, on.tolist(), strict=True)]
            score, lead = np.where(on, np.concatenate(scores), 0.0), np.where(on, np.concatenate(leads), 0.0)
            yield pa.RecordBatch.from_arrays([*batch.columns[: len(rest)], pa.array(names, pa.string()), pa.array(score), pa.array(lead < ambiguity)], names=schema.names)

    return docs.select("*", lettered).mapInArrow(run, schema)


def held_out(modulus: int, remainder: int) -> Column:
    """Whether crc32 of doc_id as text leaves ``remainder``; false for a null id."""
    return F.coalesce(F.crc32(F.col("doc_id").cast("string")) % modulus == remainder, F.lit(False))


def query(spark, sf_dir: str) -> DataFrame:
    """op4: the predicted language of every document."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    model = train(docs.where(~held_out(4, 2)).select("text", "lang"))
    return identify(docs.select("doc_id", "text"), model, text_back=False).select("doc_id", held_out(4, 2).alias("held_out"), "lang_pred", "score", "ambiguous")
