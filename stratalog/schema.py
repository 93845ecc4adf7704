"""The op log's schema, the reserved namespaces and the engine's settings."""

from __future__ import annotations

import os
from dataclasses import dataclass, fields

from pyspark.sql import types as T

#: An append-only log of timestamped puts and tombstones. ``ts`` is in seconds; ``seq`` breaks ties.
OPLOG = T.StructType(
    [
        T.StructField("key", T.StringType(), False),
        T.StructField("value", T.StringType()),
        T.StructField("ts", T.LongType(), False),
        T.StructField("tombstone", T.BooleanType(), False),
        T.StructField("seq", T.LongType(), False),
    ]
)

# Key prefixes under which sketches are stored, not allowed for user keys.
RESERVED = ("BloomFilter", "CountMinSketch", "HyperLogLog", "SimHash")


def _at_least(low, default):
    return lambda x: default if x < low else x


@dataclass
class EngineConfig:
    """Settings with their defaults; values out of range are clamped on creation."""

    # The defaults, and below the limits that replace values out of range.
    wal_buffer_capacity: int = 10
    wal_water_mark: int = 20
    memtable_size: int = 20
    memtable_structure: str = "b_tree"
    sstable_interval: int = 10
    bloom_falsepositive_rate: float = 2.0
    btree_num_of_children: int = 3
    skiplist_max_height: int = 10
    sstable_file_config: str = "single"
    lsm_max_level: int = 4
    token_cap: int = 25
    token_rate: int = 15
    compaction_type: str = "size_tiered"
    lru_cap: int = 10
    leveled_compaction_multiplier: int = 10

    def __post_init__(self) -> None:
        default = {f.name: f.default for f in fields(self)}
        rules = {
            "wal_buffer_capacity": _at_least(2, default["wal_buffer_capacity"]),
            "wal_water_mark": lambda x: 20 if x < 10 else min(x, 99999),
            "skiplist_max_height": lambda x: default["skiplist_max_height"] if x == 0 else 99 if x > 100 else x,
            "lsm_max_level": _at_least(4, default["lsm_max_level"]),
            "leveled_compaction_multiplier": _at_least(2, default["leveled_compaction_multiplier"]),
            "memtable_structure": lambda x: x if x in ("skiplist", "b_tree") else default["memtable_structure"],
            "sstable_file_config": lambda x: x if x in ("single", "multi") else default["sstable_file_config"],
            "compaction_type": lambda x: x if x in ("size_tiered", "leveled") else default["compaction_type"],
        }
        for name, value in default.items():
            rule = rules.get(name, lambda x, d=value: d if x == 0 else x)
            setattr(self, name, rule(getattr(self, name)))

    @classmethod
    def read(cls, path: str) -> EngineConfig:
        """Settings from a file of ``name: value`` lines; absent names have their defaults."""
        known = {f.name: type(f.default) for f in fields(cls)}
        found = {}
        if os.path.exists(path):
            with open(path) as lines:
                for line in lines:
                    name, _, value = line.split("#")[0].partition(":")
                    if (name := name.strip()) in known and value.strip():
                        found[name] = known[name](value.strip().strip("\"'"))
        return cls(**found)
