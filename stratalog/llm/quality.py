"""Quality classifier from weak labels.

Overlapping heuristic labellers vote good, bad or nothing on each text.
Expectation-maximisation over the counts of all vote patterns in the corpus
(at most 3 ** labellers rows, whatever the corpus) estimates how each labeller
votes on good and on bad texts; the posterior of a text's votes is its weak
label.  Weak labels of a bounded sample train a linear scorer over hashed byte
trigrams, which then scores every whole text.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from stratalog.llm import textbatch

LABELLERS = ("signs", "variety", "repeats", "sentences", "capitals", "word_size", "letters", "echoes")
BUCKETS = 1 << 12
SHORT = 40  # bytes of no evidence added to a text, so that a few trigrams decide little
_LINES = np.arange(256, dtype=np.uint8)
_LINES[10] = 0
_LINES[0] = 10
_CLASS = np.zeros(256, np.int8)  # 1 letter, 2 capital, 3 digit, 4 space, 5 sign
_CLASS[33:128] = 5
_CLASS[48:58] = 3
_CLASS[97:123] = 1
_CLASS[65:91] = 2
_CLASS[128:] = 1
_CLASS[[9, 10, 11, 12, 13, 32]] = 4


def _distinct(h: np.ndarray, first: np.ndarray) -> np.ndarray:
    """Distinct values in each stretch that begins at ``first``."""
    doc = np.repeat(np.arange(len(first) - 1), np.diff(first))
    _, at = np.unique(h ^ textbatch.mix(doc.astype(np.uint64) + np.uint64(1)), return_index=True)
    return np.bincount(doc[at], minlength=len(first) - 1)


def votes(data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """For each text and labeller 1 (good), 0 (bad) or -1 (no vote)."""
    size = np.diff(offsets)
    kind = _CLASS[data]
    count = lambda on: np.diff(np.concatenate(([0], np.cumsum(on)))[offsets])
    share = lambda a, b: a / np.maximum(b, 1)
    h, _, first = textbatch.words(data, offsets, textbatch.SPACED)
    n_words = np.diff(first)
    variety = share(_distinct(h, first), n_words)
    echo = np.zeros(len(h), bool)
    echo[1:] = h[1:] == h[:-1]
    echo[first[:-1][first[:-1] < len(h)]] = False
    echoes = share(np.diff(np.concatenate(([0], np.cumsum(echo)))[first]), n_words)
    h, _, first = textbatch.words(data, offsets, _LINES)
    n_lines = np.diff(first)
    repeats = 1 - share(_distinct(h, first), np.maximum(n_lines, 1))
    last = np.ones(len(data), bool)
    last[:-1] = data[1:] == 10
    ends = offsets[1:][size > 0] - 1
    last[ends] = True
    last &= data != 10
    sentences = share(count(last & ((data == 46) | (data == 33) | (data == 63)) & (np.concatenate(([0], data[:-1])) != data)), count(last))
    letters, capitals, signs = count((kind == 1) | (kind == 2)), count(kind == 2), count(kind == 5)
    spaces = count(kind == 4)
    word_size = share(size - spaces, n_words)

    def vote(value: np.ndarray, good: np.ndarray, bad: np.ndarray, on: np.ndarray) -> np.ndarray:
        return np.where(on & bad(value), 0, np.where(on & good(value), 1, -1))

    some = n_words >= 3
    return np.stack(
        [
            vote(share(signs, size), lambda x: x < 0.045, lambda x: x > 0.08, size >= 120),
            vote(variety, lambda x: x > 0.6, lambda x: x < 0.5, n_words >= 12),
            vote(repeats, lambda x: x < 0.1, lambda x: x > 0.25, n_lines >= 4),
            vote(sentences, lambda x: x > 0.97, lambda x: x < 0.85, some),
            vote(share(capitals, letters), lambda x: x < 0.06, lambda x: x > 0.15, some),
            vote(word_size, lambda x: (x > 4.0) & (x < 7.2), lambda x: (x < 3.0) | (x > 9.0), some),
            vote(share(letters, size), lambda x: x > 0.76, lambda x: x < 0.7, size >= 120),
            vote(echoes, lambda x: x < 0.04, lambda x: x > 0.15, n_words >= 8),
        ],
        1,
    )


def pattern(v: np.ndarray) -> np.ndarray:
    return ((v + 1) * 3 ** np.arange(v.shape[1])).sum(1)


def unpattern(p: np.ndarray) -> np.ndarray:
    return p[:, None] // 3 ** np.arange(len(LABELLERS)) % 3 - 1


@dataclass
class Labellers:
    """Share of good texts, and how each labeller that votes does (0, 1) on bad and on good ones."""

    good: float
    votes: np.ndarray  # labeller x truth x vote

    def posterior(self, v: np.ndarray) -> np.ndarray:
        """Probability that a text with these votes is good."""
        odds = np.log(self.good) - np.log1p(-self.good)
        for k in range(v.shape[1]):
            gain = np.append(np.log(self.votes[k, 1]) - np.log(self.votes[k, 0]), 0.0)  # the last: no vote says nothing
            odds = odds + gain[v[:, k]]
        return 1 / (1 + np.exp(-np.clip(odds, -500, 500)))


def estimate(patterns: np.ndarray, counts: np.ndarray, rounds: int = 200) -> Labellers:
    """Expectation-maximisation from vote patterns and their counts; majorities are the first guess."""
    v = unpattern(patterns)
    cast = (v >= 0).sum(1)
    p = np.where(cast > 0, ((v == 1).sum(1) + 0.5) / (cast + 1), 0.5)
    for _ in range(rounds):
        table = np.empty((v.shape[1], 2, 2))
        for truth, weight in ((0, counts * (1 - p)), (1, counts * p)):
            for k in range(v.shape[1]):
                table[k, truth] = np.bincount(v[:, k] + 1, weight, 3)[1:] + 0.5
        table /= table.sum(2, keepdims=True)
        good = float(np.clip((counts @ p + 1) / (counts.sum() + 2), 1e-3, 1 - 1e-3))
        model = Labellers(good, table)
        new = model.posterior(v)
        if np.abs(new - p).max(initial=0) < 1e-9:
            break
        p = new
    return model


def features(data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """The bucket of the byte trigram that ends at each byte; case counts; none spans two texts."""
    b = data.astype(np.uint32)
    b1, b2 = np.zeros_like(b), np.zeros_like(b)
    b1[1:], b2[2:] = b[:-1], b[:-2]
    at = offsets[:-1][offsets[:-1] < len(b)]
    b1[at] = 0
    b2[at] = 0
    b2[at[at + 1 < len(b)] + 1] = 0
    return (((b2 << 16) | (b1 << 8) | b) * np.uint32(0x9E3779B1)) >> np.uint32(32 - 12)


@dataclass
class Scorer:
    """A logistic model over shares of trigram buckets."""

    weight: np.ndarray
    bias: float

    def score(self, data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
        total = np.concatenate(([0.0], np.cumsum(self.weight[features(data, offsets)], dtype=np.float64)))
        z = (total[offsets[1:]] - total[offsets[:-1]]) / (np.diff(offsets) + SHORT) + self.bias
        return 1 / (1 + np.exp(-np.clip(z, -500, 500)))


def train(shares: np.ndarray, p: np.ndarray, rounds: int = 300, decay: float = 1e-4) -> Scorer:
    """Fit to soft labels p by accelerated gradient descent; either class weighs half."""
    if not len(p):
        return Scorer(np.zeros(BUCKETS), 0.0)
    scale = 1 / np.sqrt(shares.mean(0) + 1e-5)
    x = np.concatenate([shares * scale, np.ones((len(p), 1))], 1).astype(np.float32)
    importance = np.where(p > 0.5, 0.5 / max(p.sum(), 1e-9), 0.5 / max((1 - p).sum(), 1e-9)).astype(np.float32)
    step = 4 / max(float((importance[:, None] * x**2).sum()), 1e-9)
    w = np.zeros(x.shape[1], np.float32)
    ahead = w
    for t in range(rounds):
        z = 1 / (1 + np.exp(-np.clip(x @ ahead, -60, 60)))
        new = ahead - step * (x.T @ (importance * (z - p)) + decay * ahead)
        ahead, w = new + t / (t + 3) * (new - w), new
    return Scorer((w[:-1] * scale).astype(np.float64), float(w[-1]))


def _voted(docs: DataFrame, share: float | None = None) -> DataFrame:
    """(pattern), or for a sample of the rows (pattern, bucket, share) arrays; the sample goes by a hash of the text."""
    sample = share is not None
    schema = "pattern int, bucket array<int>, share array<double>" if sample else "pattern int"
    if sample:
        docs = docs.where((F.xxhash64(F.lit(11), "text").bitwiseAND((1 << 40) - 1)) < int(share * (1 << 40)))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            data, offsets = textbatch.utf8(batch.column(0))
            for i, j in textbatch.slices(offsets):
                text, own = data[offsets[i] : offsets[j]], offsets[i : j + 1] - offsets[i]
                columns = [pa.array(pattern(votes(text, own)).astype(np.int32))]
                if sample:
                    h = features(text, own)
                    found = [np.unique(h[a:b], return_counts=True) for a, b in zip(own[:-1], own[1:], strict=True)]
                    columns += [pa.array([f[0].astype(np.int32) for f in found], pa.list_(pa.int32())), pa.array([f[1] / max(f[1].sum(), 1) for f in found], pa.list_(pa.float64()))]
                yield pa.RecordBatch.from_arrays(columns, names=["pattern", "bucket", "share"][: len(columns)])

    return docs.select("text").mapInArrow(run, schema)


def learn(docs: DataFrame, sample_rows: int = 4000) -> tuple[Labellers, Scorer]:
    """Labellers from all texts, a scorer from about ``sample_rows`` of them.

    The sample is those whose text hash is below a threshold, so equal texts go
    together; at most 2 x ``sample_rows`` rows of it are used, which bounds the
    driver's matrix of shares.
    """
    texts = docs.select(F.coalesce("text", F.lit("")).alias("text"))
    rows = _voted(texts).groupBy("pattern").agg(F.count("*").alias("n")).collect()
    model = estimate(np.array([r.pattern for r in rows], np.int64), np.array([r.n for r in rows], np.float64))
    total = sum(r.n for r in rows)
    taken = _voted(texts, min(1.0, sample_rows / max(total, 1))).limit(2 * sample_rows).collect()
    shares = np.zeros((len(taken), BUCKETS), np.float32)
    for i, r in enumerate(taken):
        shares[i, r.bucket] = r.share
    p = model.posterior(unpattern(np.array([r.pattern for r in taken], np.int64))) if taken else np.zeros(0)
    return model, train(shares, p.astype(np.float32))


def classify(docs: DataFrame, model: Labellers, scorer: Scorer, least: float = 0.5) -> DataFrame:
    """``docs`` with ``weak_label`` (posterior of its votes), ``quality`` (the scorer's probability) and ``keep``.

    ``keep`` asks the mean of both log-odds to be that of ``least`` or more.  A
    null text is empty and, as an empty one, not kept.  Rows stay
    as they are; columns of the added names are replaced; nothing is shuffled.
    """
    added = ("weak_label", "quality", "keep")
    docs = docs.select(*[c for c in docs.columns if c not in added])
    schema = T.StructType([*docs.schema.fields, *T.StructType.fromDDL("weak_label double, quality double, keep boolean").fields])
    shared, where = docs.sparkSession.sparkContext.broadcast((model, scorer)), docs.columns.index("text")
    border = 2 * np.log(least / (1 - least))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model, scorer = shared.value
        odds = lambda p: np.log(np.clip(p, 1e-9, 1 - 1e-9)) - np.log1p(-np.clip(p, 1e-9, 1 - 1e-9))
        for batch in batches:
            data, offsets = textbatch.utf8(batch.column(where))
            for i, j in textbatch.slices(offsets):
                text, own = data[offsets[i] : offsets[j]], offsets[i : j + 1] - offsets[i]
                weak, p = model.posterior(votes(text, own)), scorer.score(text, own)
                keep = (odds(weak) + odds(p) >= border) & (np.diff(own) > 0)
                yield pa.RecordBatch.from_arrays([*[c.slice(i, j - i) for c in batch.columns], pa.array(weak), pa.array(p), pa.array(keep)], names=schema.names)

    return docs.mapInArrow(run, schema)


def query(spark, sf_dir: str) -> DataFrame:
    """op2: weak label, quality score and decision for every document."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    return classify(docs, *learn(docs)).select("doc_id", "weak_label", "quality", "keep")
