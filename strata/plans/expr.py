"""The filter language: comparisons of a field with a literal, joined by and, or, not; true or false, never unknown.

A comparison that can't be made (no such field, a kind that isn't comparable, a literal of another kind, null, NaN) is false, also for
"not equal"; its negation is true. compile() pushes every negation down to the comparisons, so that the plain ones reach the Parquet scan.
"""

from __future__ import annotations

import json
import math
from dataclasses import dataclass
from decimal import Decimal
from typing import Any

from pyspark.sql import Column
from pyspark.sql import functions as F

from strata.errors import MalformedPayload
from strata.schema import FILTERABLE, FLOATS, INTEGERS, WIDE, Version

OPS = ("eq", "ne", "gt", "gte", "lt", "lte")
INVERSE = {"eq": "ne", "ne": "eq", "gt": "lte", "gte": "lt", "lt": "gte", "lte": "gt"}
EXACT = 1 << 53
Literal = int | float | str | bool | bytes


class Expr:
    def __and__(self, other: Expr) -> Expr:
        return And(self, other)

    def __or__(self, other: Expr) -> Expr:
        return Or(self, other)

    def __invert__(self) -> Expr:
        return Not(self)

    def negate(self) -> Expr:
        return Not(self)


@dataclass(frozen=True)
class All(Expr):
    """Every live record."""


@dataclass(frozen=True)
class Compare(Expr):
    op: str
    field: str
    value: Literal


@dataclass(frozen=True)
class And(Expr):
    left: Expr
    right: Expr


@dataclass(frozen=True)
class Or(Expr):
    left: Expr
    right: Expr


@dataclass(frozen=True)
class Not(Expr):
    inner: Expr


@dataclass(frozen=True)
class Field:
    """A handle on a column, by name; the name need not exist."""

    name: str

    def eq(self, value: Literal) -> Expr:
        return Compare("eq", self.name, value)

    def ne(self, value: Literal) -> Expr:
        return Compare("ne", self.name, value)

    def gt(self, value: Literal) -> Expr:
        return Compare("gt", self.name, value)

    def gte(self, value: Literal) -> Expr:
        return Compare("gte", self.name, value)

    def lt(self, value: Literal) -> Expr:
        return Compare("lt", self.name, value)

    def lte(self, value: Literal) -> Expr:
        return Compare("lte", self.name, value)


def field(name: str) -> Field:
    return Field(name)


def fits(kind: str, value: Literal) -> bool:
    """Whether a literal can be compared with a field of that kind."""
    if kind not in FILTERABLE:
        return False
    if isinstance(value, bool):
        return kind == "bool"
    if isinstance(value, (int, float)):
        return kind in INTEGERS or kind in FLOATS
    return isinstance(value, str) and kind == "str" or isinstance(value, (bytes, bytearray)) and kind == "bytes"


def _apply(op: str, a: Any, b: Any) -> Any:
    return {"eq": lambda: a == b, "ne": lambda: a != b, "gt": lambda: a > b, "gte": lambda: a >= b, "lt": lambda: a < b, "lte": lambda: a <= b}[op]()


def _wide_double(c: Column, signed: bool) -> Column:
    half = lambda at: F.conv(F.substring(F.hex(c), at, 16), 16, 10).cast("decimal(20,0)").cast("double")
    out = half(1) * float(1 << 64) + half(17)
    return out - float(1 << 127) if signed else out


def _sides(kind: str, op: str, c: Column, value: Literal) -> tuple[str, Column, Column] | bool:
    """The comparison to make, or what it is for every value that isn't null."""
    if kind in INTEGERS:
        if isinstance(value, float):
            if kind in WIDE or abs(value) >= EXACT:
                return op, (_wide_double(c, kind == "i128") if kind in WIDE else c.cast("double")), F.lit(value)
            if value != math.floor(value):
                if op in ("eq", "ne"):
                    return op == "ne"
                value = math.floor(value) if op in ("gt", "lte") else math.ceil(value)
            value = int(value)
        if kind in WIDE:
            shifted = value + (1 << 127) if kind == "i128" else value
            if not 0 <= shifted < 1 << 128:
                return _apply(op, 0, value)
            return op, c, F.lit(shifted.to_bytes(16, "big"))
        if abs(value) >= 10**38:
            return _apply(op, 0, value)
        if kind == "u64" or not -(1 << 63) <= value < 1 << 63:
            return op, c, F.lit(Decimal(value)).cast("decimal(38,0)" if abs(value) >= 10**20 else "decimal(20,0)")
        return op, c, F.lit(value)
    if kind in FLOATS:
        return op, c if kind == "f64" else c.cast("double"), F.lit(float(value))
    return op, c, F.lit(bytes(value) if isinstance(value, bytearray) else value)


def _leaf(x: Compare, version: Version, negated: bool) -> Column:
    spec = version.spec(x.field)
    if spec is None or not fits(spec.kind, x.value) or isinstance(x.value, float) and math.isnan(x.value):
        return F.lit(negated)
    c = F.col(f"`{x.field}`")
    found = _sides(spec.kind, x.op, c, x.value)
    if isinstance(found, bool):
        if found:
            return c.isNull() if negated else c.isNotNull()
        return F.lit(negated)
    op, left, right = found
    guarded = spec.kind in FLOATS and op in ("ne", "gt", "gte")
    if not negated:
        plain = _apply(op, left, right)
        return plain & ~F.isnan(c) if guarded else plain
    other = _apply(INVERSE[op], left, right) | c.isNull()
    return other | F.isnan(c) if guarded else other


def compile_expr(x: Expr, version: Version, negated: bool = False) -> Column:
    """A column for one layout; null counts as false there."""
    if isinstance(x, All):
        return F.lit(not negated)
    if isinstance(x, Not):
        return compile_expr(x.inner, version, not negated)
    if isinstance(x, (And, Or)):
        a, b = compile_expr(x.left, version, negated), compile_expr(x.right, version, negated)
        return a & b if isinstance(x, And) != negated else a | b
    if isinstance(x, Compare):
        return _leaf(x, version, negated)
    raise MalformedPayload(f"not an expression: {x!r}")


def evaluate(x: Expr, version: Version, row: dict[str, Any]) -> bool:
    """The same for one row in plain Python; 128-bit fields as int."""
    if isinstance(x, All):
        return True
    if isinstance(x, Not):
        return not evaluate(x.inner, version, row)
    if isinstance(x, And):
        return evaluate(x.left, version, row) and evaluate(x.right, version, row)
    if isinstance(x, Or):
        return evaluate(x.left, version, row) or evaluate(x.right, version, row)
    spec, value = version.spec(x.field), row.get(x.field)
    if spec is None or value is None or not fits(spec.kind, x.value):
        return False
    if isinstance(x.value, float) or isinstance(value, float):
        if math.isnan(float(x.value)) or math.isnan(float(value)):
            return False
        return _apply(x.op, float(value), float(x.value))
    return _apply(x.op, value, x.value)


def to_json(x: Expr) -> str:
    def tree(e: Expr) -> Any:
        if isinstance(e, All):
            return ["all"]
        if isinstance(e, Not):
            return ["not", tree(e.inner)]
        if isinstance(e, (And, Or)):
            return [type(e).__name__.lower(), tree(e.left), tree(e.right)]
        v = e.value
        kind = "bytes" if isinstance(v, (bytes, bytearray)) else type(v).__name__
        return [e.op, e.field, kind, bytes(v).hex() if kind == "bytes" else repr(v) if kind in ("float", "int") else v]

    return json.dumps(tree(x))


def from_json(text: str) -> Expr:
    read = {"int": int, "float": float, "str": str, "bool": bool, "bytes": bytes.fromhex}

    def build(t: Any) -> Expr:
        if t == ["all"]:
            return All()
        if t[0] == "not" and len(t) == 2:
            return Not(build(t[1]))
        if t[0] in ("and", "or") and len(t) == 3:
            return (And if t[0] == "and" else Or)(build(t[1]), build(t[2]))
        if t[0] in OPS and len(t) == 4 and isinstance(t[1], str):
            return Compare(t[0], t[1], read[t[2]](t[3]))
        raise ValueError(t)

    try:
        return build(json.loads(text))
    except (ValueError, KeyError, IndexError, TypeError) as e:
        raise MalformedPayload(f"not a filter: {text[:80]}") from e
