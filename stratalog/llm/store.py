"""Intermediate tables in the folder that driver and executors share."""

from collections.abc import Iterable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from stratalog.sources.shared import shared_dir, written

__all__ = ["aside", "fresh", "shared_dir", "written"]


def fresh(df: DataFrame, name: str) -> str:
    """``name``, with underscores added until no column of ``df`` has it."""
    taken = {c.lower() for c in df.columns}
    while name.lower() in taken:
        name += "_"
    return name


def aside(df: DataFrame, names: Iterable[str]) -> tuple[DataFrame, list[Column]]:
    """``df`` with columns called ``names`` moved to other names, and the columns that give it back."""
    moved = {c: fresh(df, f"__{c}") for c in df.columns if c in set(names)}
    return df.withColumnsRenamed(moved), [F.col(moved.get(c, c)).alias(c) for c in df.columns]
