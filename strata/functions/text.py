"""Text and display functions, all built-in expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Blanks of Unicode, which trim() of SQL doesn't strip.
UNICODE_BLANKS = "\\t-\\r \\x{85}\\x{A0}\\x{1680}\\x{2000}-\\x{200A}\\x{2028}\\x{2029}\\x{202F}\\x{205F}\\x{3000}"


def trim_unicode(text: Column) -> Column:
    return F.regexp_replace(text, f"^[{UNICODE_BLANKS}]+|[{UNICODE_BLANKS}]+$", "")


def is_blank(text: Column) -> Column:
    return F.length(trim_unicode(text)) == 0


def longer_than(text: Column, most_bytes: int) -> Column:
    return F.octet_length(text) > most_bytes


def human_bytes(size: Column) -> Column:
    out = F.concat(size.cast("string"), F.lit("B"))
    for unit, power in (("K", 1), ("M", 2), ("G", 3)):
        scaled = F.concat(F.format_string("%.1f", F.bround(size.cast("double") / float(1024**power), 1)), F.lit(unit))
        out = F.when(size >= 1024**power, scaled).otherwise(out)
    return out


def short_hex(digits: Column) -> Column:
    return F.right(digits, F.lit(8))


def occupation(used: Column, total: Column) -> Column:
    """0 to 63: how full, in 64ths."""
    return F.when(total == 0, F.lit(0)).otherwise(F.least(F.lit(63), F.floor(used * 64 / total))).cast("int")


def fill_percent(used: Column, total: Column) -> Column:
    return F.when(total == 0, F.lit(0.0)).otherwise(used * 100.0 / total)


def health_label(answered: Column, error: Column) -> Column:
    return F.when(answered, F.lit("OK")).when(error.isNotNull(), F.lit("ERROR")).otherwise(F.lit("UNKNOWN"))


def heat_level(heat: Column) -> Column:
    """0 for cold, then 1 to 4 by quarters of 0 to 255."""
    return F.when(heat == 0, 0).when(heat < 64, 1).when(heat < 128, 2).when(heat < 192, 3).otherwise(4)


def descriptor_pack(start: Column, blocks: Column, occupied: Column, in_journal: Column, in_memory: Column) -> Column:
    """48 bits of start, 8 of length, 6 of occupation and two flags, from the top."""
    bits = lambda v, n: v.cast("bigint").bitwiseAND(F.lit((1 << n) - 1))
    out = F.shiftleft(bits(start, 48), 16).bitwiseOR(F.shiftleft(bits(blocks, 8), 8))
    return out.bitwiseOR(F.shiftleft(bits(occupied, 6), 2)).bitwiseOR(F.shiftleft(in_journal.cast("bigint"), 1)).bitwiseOR(in_memory.cast("bigint"))
