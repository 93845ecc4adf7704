"""The hashes that sketches are built on, as SQL expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Offset basis and prime of 32-bit FNV-1a.
FNV_BASIS = 2166136261
FNV_PRIME = 16777619


def fnv1a_32(key: Column) -> Column:
    """32-bit FNV-1a of the UTF-8 bytes, as a long."""
    raw = F.encode(key, "UTF-8")
    octets = F.octet_length(key)

    def step(h: Column, i: Column) -> Column:
        byte = F.conv(F.hex(F.substr(raw, i, F.lit(1))), 16, 10).cast("long")
        return F.pmod(h.bitwiseXOR(byte) * F.lit(FNV_PRIME), F.lit(1 << 32))

    return F.when(octets == 0, F.lit(FNV_BASIS).cast("long")).otherwise(F.aggregate(F.sequence(F.lit(1), octets), F.lit(FNV_BASIS).cast("long"), step))


def seed_hex(base: int, i: int) -> str:
    """32 bytes: big-endian (base + i) in the first four, then zeros."""
    return f"{(base + i) & 0xFFFFFFFF:08x}" + "0" * 56


def seeded(key: Column, base: int, i: int) -> Column:
    """The first eight bytes of MD5(key, seed), big-endian, as decimal(20, 0)."""
    digest = F.md5(F.concat(F.encode(key, "UTF-8"), F.unhex(F.lit(seed_hex(base, i)))))
    return F.conv(F.substring(digest, 1, 16), 16, 10).cast("decimal(20,0)")


def slots(key: Column, base: int, k: int, m: int) -> Column:
    """Array of (i, slot) for k seeded hashes modulo m."""
    return F.array(*[F.struct(F.lit(i).alias("i"), (seeded(key, base, i) % m).cast("long").alias("slot")) for i in range(k)])
