"""A corpus pipeline of five stages over ``documents``.

Each stage takes (spark, docs, sf_dir) and gives a DataFrame; it is written as
Parquet and read back as the next stage's documents.  All but the last keep the
columns of ``documents``.  The first stage drops null texts with the others that
have no language; rows with a null id pass through all stages.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from stratalog.llm import decontaminate, language, near, pieces, pii
from stratalog.llm.store import aside, written


def language_id(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drop documents whose language the model cannot tell.

    That is texts without a letter (null ones too), and those whose best
    codeword has hardly a lead over the next.  Where no document has a language
    to learn from, there is no model and all stay.
    """
    model = language.train(docs.where(~language.held_out(4, 2)).select("text", "lang"))
    if model is None:
        return docs
    moved, own = aside(docs, language.ADDED)
    found = language.identify(moved, model)
    return found.where((F.col("lang_pred") != language.UNDETERMINED) & ~F.col("ambiguous")).select(*own)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each class of linked documents stays."""
    return near.one_of_each(docs)


def benchmark_passages(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Cut passages of benchmark items; drop documents that are little else."""
    return decontaminate.decontaminate(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def personal_data(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Put kinds in place of personal data."""
    return pii.redact(docs)


def piece_ids(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Encode each text; keep its ids and what they decode to."""
    out = pieces.encode(docs.select("doc_id", "lang", "source", "text"))
    return out.select("doc_id", "lang", "source", F.size("piece_ids").cast("long").alias("n_tokens"), "piece_ids", "decoded")


STAGES = [
    ("language_id", language_id),
    ("near_duplicates", near_duplicates),
    ("benchmark_passages", benchmark_passages),
    ("personal_data", personal_data),
    ("piece_ids", piece_ids),
]

#: Stages 1, 2 and 5 have no SQL form; tests/llm/test_pipeline.py holds each stage against a plain version of it.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``; each stage's result is written and read back."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES[:-1]:
        docs = written(stage(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)
