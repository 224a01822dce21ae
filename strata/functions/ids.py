"""Composite ids: tenant (48 bits), shard (12), struct id (20) and creation tick (48), as flat columns or 16 big-endian bytes.

Values that need more bits are masked silently. Everything is a built-in expression.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from strata.errors import ShardOutOfRange, StructIdOutOfRange, TenantOutOfRange, TickOutOfRange

ID_COLUMNS = ("tenant", "shard", "struct_id", "created_at")
BITS = {"tenant": 48, "shard": 12, "struct_id": 20, "created_at": 48}
#: Where each part stands among the 32 hexadecimal digits, from 1.
DIGITS = {"tenant": (1, 12), "shard": (13, 3), "struct_id": (16, 5), "created_at": (21, 12)}
#: Ticks of the clock: 100 microseconds.
TICK_MICROS = 100
#: Shard that trackers use; records can't.
RESERVED_SHARD = 0xFFF


def _c(x: Column | str | int) -> Column:
    return F.col(x) if isinstance(x, str) else x if isinstance(x, Column) else F.lit(x)


def masked(part: str, value: Column | str | int) -> Column:
    return _c(value).cast("bigint").bitwiseAND(F.lit((1 << BITS[part]) - 1))


def id_hex(tenant: Column | str | int = "tenant", shard: Column | str | int = "shard", struct_id: Column | str | int = "struct_id", created_at: Column | str | int = "created_at") -> Column:
    """32 lower-case digits; they sort as the ids do."""
    parts = zip(BITS, (tenant, shard, struct_id, created_at), strict=True)
    return F.lower(F.concat(*(F.lpad(F.hex(masked(p, v)), DIGITS[p][1], "0") for p, v in parts)))


def id_bytes(*parts: Column | str | int) -> Column:
    """16 big-endian bytes, so binary order is numeric order."""
    return F.unhex(id_hex(*parts))


def part_of(part: str, packed: Column | str) -> Column:
    """A part of an id given as 16 bytes."""
    return part_of_hex(part, F.hex(_c(packed)))


def part_of_hex(part: str, digits: Column | str) -> Column:
    return F.conv(F.substring(_c(digits), *DIGITS[part]), 16, 10).cast("bigint")


def anchor_hex(tenant: Column | str | int = "tenant", shard: Column | str | int = "shard", struct_id: Column | str | int = "struct_id") -> Column:
    """The id without its tick: a reference that all versions of the record share."""
    return id_hex(tenant, shard, struct_id, 0)


def anchor_of_hex(digits: Column | str) -> Column:
    return F.concat(F.substring(_c(digits), 1, 20), F.lit("0" * 12))


def id_text(tenant: Column | str | int = "tenant", shard: Column | str | int = "shard", struct_id: Column | str | int = "struct_id", created_at: Column | str | int = "created_at") -> Column:
    values = [masked(p, v) for p, v in zip(BITS, (tenant, shard, struct_id, created_at), strict=True)]
    return F.format_string("Id(t=%d, s=%d, sid=%d, c=%d)", *values)


def header(struct_id: Column | str | int, version: Column | str | int) -> Column:
    return F.shiftleft(_c(struct_id).cast("bigint"), 8).bitwiseOR(_c(version).cast("bigint"))


def header_struct(h: Column | str) -> Column:
    return F.shiftright(_c(h), 8)


def header_version(h: Column | str) -> Column:
    return _c(h).bitwiseAND(F.lit(0xFF))


def tick_of(ts: Column | str) -> Column:
    """Tick of a timestamp (with or without zone; the session's zone counts)."""
    micros = F.unix_micros(_c(ts).cast("timestamp"))
    return ((micros - F.pmod(micros, F.lit(TICK_MICROS))) / TICK_MICROS).cast("bigint")


def checked(tenant: int, shard: int, struct_id: int, created_at: int) -> tuple[int, int, int, int]:
    """The parts of an id, if each fits: for callers that want an error where the packing functions mask."""
    kinds = {"tenant": TenantOutOfRange, "shard": ShardOutOfRange, "struct_id": StructIdOutOfRange, "created_at": TickOutOfRange}
    for part, value in zip(ID_COLUMNS, (tenant, shard, struct_id, created_at), strict=True):
        if not 0 <= value < 1 << BITS[part]:
            raise kinds[part](part, value, BITS[part])
    return tenant, shard, struct_id, created_at


def anchor_of_unique(struct_id: int, tenant: Column | str | int = "tenant") -> Column:
    """The key of a tenant's record of a unique family: shard and tick are zero."""
    return id_hex(tenant, 0, struct_id, 0)


def order_columns() -> list[Column]:
    """Numeric order of ids."""
    return [F.col(c) for c in ID_COLUMNS]
