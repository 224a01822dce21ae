"""64- and 128-bit hashes with wrap-around arithmetic: vectorised over Arrow batches, since SQL multiplication doesn't wrap.

Results are decimal(20,0), which holds all of an unsigned 64-bit number; slots are bigint.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.functions import pandas_udf

#: The golden ratio in 64 bits, the SplitMix64 multipliers, a MurmurHash multiplier, FNV-1a offsets and primes.
GOLDEN = 0x9E3779B97F4A7C15
SPLITMIX = (0xBF58476D1CE4E5B9, 0x94D049BB133111EB)
MURMUR = 0xC6A4A7935BD1E995
FNV64 = (0xCBF29CE484222325, 0x100000001B3)
FNV128 = (0x6C62272E07BB014262B821756295C58D, 0x1000000000000000000013B)


def _u(x: pd.Series | np.ndarray | int) -> np.ndarray:
    if isinstance(x, pd.Series):
        return np.array([int(v) & 0xFFFFFFFFFFFFFFFF for v in x], np.uint64) if x.dtype == object else x.to_numpy().astype(np.int64).view(np.uint64)
    return np.asarray(x, np.uint64)


def mix(x: np.ndarray) -> np.ndarray:
    """SplitMix64's finaliser after an exclusive or with the golden ratio."""
    with np.errstate(over="ignore"):
        z = x ^ np.uint64(GOLDEN)
        for shift, factor in zip((30, 27), SPLITMIX, strict=True):
            z = (z ^ (z >> np.uint64(shift))) * np.uint64(factor)
        return z ^ (z >> np.uint64(31))


def slots(h: np.ndarray, count: int) -> np.ndarray:
    return (h % np.uint64(count) if count else np.zeros_like(h)).astype(np.int64)


def slot_of_two(struct_id: np.ndarray, tenant: np.ndarray, count: int) -> np.ndarray:
    with np.errstate(over="ignore"):
        return slots(mix(tenant ^ struct_id * np.uint64(GOLDEN)), count)


def slot_of_four(struct_id: np.ndarray, tenant: np.ndarray, shard: np.ndarray, created_at: np.ndarray, count: int) -> np.ndarray:
    with np.errstate(over="ignore"):
        rotated = created_at << np.uint64(17) | created_at >> np.uint64(47)
        high = struct_id * np.uint64(GOLDEN) ^ shard << np.uint64(48) ^ created_at
        return slots(mix(high) + mix(tenant ^ rotated) * np.uint64(GOLDEN), count)


def probe_step(struct_id: np.ndarray, tenant: np.ndarray, shard: np.ndarray, count: int) -> np.ndarray:
    if count <= 1:
        return np.ones(len(tenant), np.int64)
    with np.errstate(over="ignore"):
        return slots(mix(tenant * np.uint64(MURMUR) ^ struct_id ^ shard << np.uint64(32)), count) | 1


def fnv64(columns: list[tuple[np.ndarray, int]]) -> np.ndarray:
    """FNV-1a over the little-endian bytes of the columns, each with its width."""
    with np.errstate(over="ignore"):
        h = np.full(len(columns[0][0]), FNV64[0], np.uint64)
        for values, width in columns:
            for k in range(width):
                h = (h ^ (values >> np.uint64(8 * k) & np.uint64(0xFF))) * np.uint64(FNV64[1])
    return h


def fnv64_text(text: str) -> int:
    h = FNV64[0]
    for b in text.encode():
        h = (h ^ b) * FNV64[1] & 0xFFFFFFFFFFFFFFFF
    return h


def fnv128_bytes(data: bytes) -> bytes:
    h = FNV128[0]
    for b in data:
        h = (h ^ b) * FNV128[1] & ((1 << 128) - 1)
    return h.to_bytes(16, "big")


def _decimals(h: np.ndarray) -> pd.Series:
    from decimal import Decimal

    return pd.Series([Decimal(int(v)) for v in h])


def mix64(x: Column) -> Column:
    @pandas_udf("decimal(20,0)")
    def run(v: pd.Series) -> pd.Series:
        return _decimals(mix(_u(v)))

    return run(x)


def tuple2_slot(struct_id: Column, tenant: Column, count: int) -> Column:
    @pandas_udf("bigint")
    def run(s: pd.Series, t: pd.Series) -> pd.Series:
        return pd.Series(slot_of_two(_u(s), _u(t), count))

    return run(struct_id.cast("bigint"), tenant.cast("bigint"))


def tuple4_slot(struct_id: Column, tenant: Column, shard: Column, created_at: Column, count: int) -> Column:
    @pandas_udf("bigint")
    def run(s: pd.Series, t: pd.Series, h: pd.Series, c: pd.Series) -> pd.Series:
        return pd.Series(slot_of_four(_u(s), _u(t), _u(h), _u(c), count))

    return run(*(x.cast("bigint") for x in (struct_id, tenant, shard, created_at)))


def double_hash_step(struct_id: Column, tenant: Column, shard: Column, count: int) -> Column:
    @pandas_udf("bigint")
    def run(s: pd.Series, t: pd.Series, h: pd.Series) -> pd.Series:
        return pd.Series(probe_step(_u(s), _u(t), _u(h), count))

    return run(*(x.cast("bigint") for x in (struct_id, tenant, shard)))


def partition_hash(tenant: Column, shard: Column) -> Column:
    @pandas_udf("decimal(20,0)")
    def run(t: pd.Series, s: pd.Series) -> pd.Series:
        return _decimals(fnv64([(_u(t), 8), (_u(s), 2)]))

    return run(tenant.cast("bigint"), shard.cast("bigint"))


def content_hash128(data: Column) -> Column:
    """FNV-1a in 128 bits, as 32 hexadecimal digits. Slow: for parity; elsewhere sha2 names contents."""

    @pandas_udf("string")
    def run(v: pd.Series) -> pd.Series:
        return v.map(lambda x: None if x is None else fnv128_bytes(bytes(x)).hex())

    return run(data.cast("binary"))


def page_slot(kind: str, count: int, **parts: Column) -> Column:
    """Slot by the rule for the kind of record: "unique" and "tracker" go by two parts, all else by four."""
    if kind in ("unique", "tracker"):
        return tuple2_slot(parts["struct_id"], parts["tenant"], count)
    return tuple4_slot(parts["struct_id"], parts["tenant"], parts["shard"], parts["created_at"], count)


def page_checksum(data: Column) -> Column:
    return F.crc32(data.cast("binary"))
