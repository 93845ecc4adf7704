"""Ordered folds: state that goes from row to row of a key, in bounded memory."""

from __future__ import annotations

from collections.abc import Callable, Iterator
from typing import Any

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import types as T


def ordered_fold(rows: DataFrame, keys: list[str], order: list[str], inputs: list[str], added: str, start: Callable[[], Any], step: Callable[[Any, tuple], tuple[Any, tuple]]) -> DataFrame:
    """``rows`` with columns ``added`` (DDL) from a fold over each key's rows in order.

    Rows are dealt by key and sorted in their part; a task streams through them
    in Arrow batches and holds one key's state, not its rows.  ``step`` takes
    the state and the values of ``inputs`` and gives the state and the new values.
    With no keys the whole table is one sequence.
    """
    more = T.StructType.fromDDL(added)
    schema = T.StructType([*rows.schema.fields, *more.fields])
    at = [rows.columns.index(c) for c in keys]
    of = [rows.columns.index(c) for c in inputs]
    dealt = rows.repartition(*keys) if keys else rows.coalesce(1)
    kinds = [{"boolean": pa.bool_(), "long": pa.int64(), "bigint": pa.int64(), "int": pa.int32(), "double": pa.float64(), "string": pa.string()}[f.dataType.simpleString()] for f in more.fields]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last, state = None, start()
        for batch in batches:
            own = list(zip(*[batch.column(i).to_pylist() for i in at], strict=True)) if at else [()] * batch.num_rows
            out = []
            for key, values in zip(own, zip(*[batch.column(i).to_pylist() for i in of], strict=True), strict=True):
                if key != last:
                    last, state = key, start()
                state, new = step(state, values)
                out.append(new)
            columns = list(zip(*out, strict=True)) if out else [()] * len(kinds)
            yield pa.RecordBatch.from_arrays([*batch.columns, *[pa.array(c, k) for c, k in zip(columns, kinds, strict=True)]], names=schema.names)

    return dealt.sortWithinPartitions(*keys, *order).mapInArrow(run, schema)


def by_group(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.Table]:
    """The rows of each group; rows come sorted by the group, a long in the first column; groups are bounded."""
    held: list[pa.RecordBatch] = []
    last = None
    for batch in batches:
        if not batch.num_rows:
            continue
        g = np.asarray(batch.column(0))
        cuts = [0, *(np.flatnonzero(g[1:] != g[:-1]) + 1).tolist(), len(g)]
        for lo, hi in zip(cuts, cuts[1:], strict=False):
            if last is not None and g[lo] != last:
                yield pa.Table.from_batches(held)
                held = []
            held.append(batch.slice(lo, hi - lo))
            last = g[lo]
    if held:
        yield pa.Table.from_batches(held)
