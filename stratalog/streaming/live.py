"""The newest version of each key over a stream of operations, and admission by token bucket."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from stratalog.operators.stateful import take


def latest(ops: DataFrame) -> DataFrame:
    """(key, value, ts, tombstone, seq) of each key's newest version; for update or complete mode.

    State is one version per key, whatever the order of arrival.
    """
    newest = F.max(F.struct("ts", "seq", "value", "tombstone")).alias("v")
    return ops.groupBy("key").agg(newest).select("key", "v.value", "v.ts", "v.tombstone", "v.seq")


def admission(requests: DataFrame, rate: float, capacity: int) -> DataFrame:
    """(client, seq, ts) with ``accepted``; each client's bucket is kept between batches."""

    def step(key: tuple, frames: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        tokens, last = state.get if state.exists else (float(capacity), None)
        rows = pd.concat(list(frames)).sort_values("seq")
        out = []
        for now in rows["ts"].tolist():
            tokens, ok = take(tokens, now if last is None else last, now, rate, capacity)
            last = now
            out.append(ok)
        state.update((tokens, last))
        yield rows.assign(accepted=out)[["client", "seq", "ts", "accepted"]]

    return requests.select("client", "seq", "ts").groupBy("client").applyInPandasWithState(step, "client string, seq long, ts long, accepted boolean", "tokens double, last long", "append", GroupStateTimeout.NoTimeout)
