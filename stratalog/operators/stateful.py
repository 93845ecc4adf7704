"""Order-dependent simulations: LRU cache and token bucket."""

from __future__ import annotations

from collections import OrderedDict
from math import floor

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from stratalog.functions.fold import ordered_fold
from stratalog.sources.oplog import accepted


def lru_hits(accesses: DataFrame, capacity: int, client: str = "client") -> DataFrame:
    """(client, seq, key) with ``hit``; a delete (column ``drop`` true) takes its key out and misses.

    One cache per client; a task holds at most ``capacity`` keys.
    """

    def step(cache: OrderedDict, values: tuple) -> tuple[OrderedDict, tuple]:
        key, drop = values
        hit = key in cache and not drop
        if drop:
            cache.pop(key, None)
        else:
            cache[key] = True
            cache.move_to_end(key)
            if len(cache) > capacity:
                cache.popitem(last=False)
        return cache, (hit,)

    rows = accesses if "drop" in accesses.columns else accesses.withColumn("drop", F.lit(False))
    return ordered_fold(rows, [client], ["seq"], ["key", "drop"], "hit boolean", OrderedDict, step).drop("drop")


def lru_contents(accesses: DataFrame, capacity: int, client: str = "client") -> DataFrame:
    """(client, key, place): the keys in each cache at the end, latest first."""
    last = accesses.groupBy(client, "key").agg(F.max("seq").alias("last"))
    place = F.row_number().over(Window.partitionBy(client).orderBy(F.desc("last")))
    return last.withColumn("place", place).where(F.col("place") <= capacity).select(client, "key", "place")


def take(tokens: float, last: int, now: int, rate: float, capacity: int, fractional: bool = False) -> tuple[float, bool]:
    """Tokens left and whether one could be taken; refills are whole numbers unless ``fractional``."""
    gained = rate * (now - last)
    tokens = min(capacity, tokens + (gained if fractional else floor(gained)))
    return (tokens - 1, True) if tokens >= 1 else (tokens, False)


def token_bucket(requests: DataFrame, rate: float, capacity: int, client: str = "client", fractional: bool = False) -> DataFrame:
    """(client, seq, ts) with ``accepted``; buckets start full, the clock moves on at every request."""

    def step(state: tuple[float, int | None], values: tuple) -> tuple[tuple, tuple]:
        tokens, last = state
        (now,) = values
        tokens, ok = take(tokens, now if last is None else last, now, rate, capacity, fractional)
        return (tokens, now), (ok,)

    return ordered_fold(requests, [client], ["seq"], ["ts"], "accepted boolean", lambda: (capacity, None), step)


def admitted(requests: DataFrame, rate: float, capacity: int, client: str = "client") -> DataFrame:
    """Requests (put, delete or get) that got a token, as operations; the others, and reserved keys, are not applied.

    A request for a reserved key takes its token before it is refused.
    """
    return accepted(token_bucket(requests, rate, capacity, client).where("accepted").drop("accepted"))
