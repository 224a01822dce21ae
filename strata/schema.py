"""Families of records: kinds of fields, versions, shapes and the registry. All of it lives on the driver."""

from __future__ import annotations

import re
from collections.abc import Callable, Iterable
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame
from pyspark.sql import types as T

from strata.errors import DuplicateHeader, ShapeMismatch, StrataError, StructIdOutOfRange, UnknownHeader, Unsupported

UNIQUE, NON_UNIQUE, NESTED = "unique", "non_unique", "nested"
MAX_STRUCT_ID, MAX_VERSION = (1 << 20) - 1, 255

#: Kind -> Spark type. Unsigned kinds take the next wider signed type; 128-bit kinds are 16 big-endian bytes, which sort as numbers.
KINDS: dict[str, T.DataType] = {
    "u8": T.ShortType(), "u16": T.IntegerType(), "u32": T.LongType(), "u64": T.DecimalType(20, 0), "u128": T.BinaryType(),
    "i8": T.ByteType(), "i16": T.ShortType(), "i32": T.IntegerType(), "i64": T.LongType(), "i128": T.BinaryType(),
    "f32": T.FloatType(), "f64": T.DoubleType(), "bool": T.BooleanType(), "str": T.StringType(), "bytes": T.BinaryType(),
    "char": T.StringType(), "id": T.StringType(), "list": T.ArrayType(T.StringType()), "option": T.StringType(), "other": T.StringType(),
}
INTEGERS = frozenset(k for k in KINDS if re.fullmatch(r"[iu]\d+", k))
FLOATS = frozenset({"f32", "f64"})
WIDE = frozenset({"u128", "i128"})
FILTERABLE = INTEGERS | FLOATS | {"bool", "str", "bytes"}
RESERVED = ("id", "metadata")


@dataclass(frozen=True)
class FieldSpec:
    name: str
    kind: str
    type: T.DataType | None = None

    def __post_init__(self) -> None:
        if self.kind not in KINDS:
            raise StrataError(f"{self.name}: no kind {self.kind}")
        if self.name in RESERVED:
            raise StrataError(f"{self.name} is injected in every record and can't be declared")

    @property
    def data_type(self) -> T.DataType:
        return self.type or KINDS[self.kind]


@dataclass(frozen=True)
class Version:
    """One layout of a family, its hooks, and how rows move between it and the version before."""

    number: int
    fields: tuple[FieldSpec, ...]
    checks: tuple[tuple[str | None, str, Callable[[], Column]], ...] = ()
    preprocess: Callable[[DataFrame], DataFrame] | None = None
    late_checks: tuple[tuple[str | None, str, Callable[[], Column]], ...] = ()
    forward: Callable[[DataFrame], DataFrame] | None = None
    rollback: Callable[[DataFrame], DataFrame] | None = None
    #: As forward and rollback, with the session that reads: a move may look other families up.
    forward_with: Callable[[object, DataFrame], DataFrame] | None = None
    rollback_with: Callable[[object, DataFrame], DataFrame] | None = None
    first_try: Callable[[], DataFrame | None] | None = None
    fallback: Callable[[], DataFrame] | None = None

    def spec(self, name: str) -> FieldSpec | None:
        return next((f for f in self.fields if f.name == name), None)

    @property
    def names(self) -> tuple[str, ...]:
        return tuple(f.name for f in self.fields)


@dataclass(eq=False)
class Family:
    """All versions of one kind of record."""

    name: str
    struct_id: int
    shape: str
    versions: tuple[Version, ...]
    parent: str | None = None
    primary_anchor: tuple[str, ...] = ()
    secondary_anchors: tuple[tuple[str, ...], ...] = ()
    btree_threshold: int = 50
    auto_crud: bool = True
    by_number: dict[int, Version] = field(init=False, repr=False)

    def __post_init__(self) -> None:
        if not 0 <= self.struct_id <= MAX_STRUCT_ID:
            raise StructIdOutOfRange("struct id", self.struct_id, 20)
        if self.shape not in (UNIQUE, NON_UNIQUE, NESTED):
            raise StrataError(f"{self.name}: no shape {self.shape}")
        if not self.versions:
            raise StrataError(f"{self.name}: no version")
        self.by_number = {}
        for v in self.versions:
            if not 0 <= v.number <= MAX_VERSION:
                raise StrataError(f"{self.name}: version {v.number} needs more than 8 bits")
            if v.number in self.by_number:
                raise DuplicateHeader(f"{self.name}: version {v.number} twice")
            self.by_number[v.number] = v
        known = {n for v in self.versions for n in v.names}
        for names in (self.primary_anchor, *self.secondary_anchors):
            if missing := [n for n in names if n not in known]:
                raise StrataError(f"{self.name}: anchors name unknown fields {missing}")

    @property
    def latest(self) -> Version:
        return self.by_number[max(self.by_number)]

    def version(self, number: int | None = None) -> Version:
        number = self.latest.number if number is None else number
        if number not in self.by_number:
            raise UnknownHeader(f"{self.name}: no version {number}")
        return self.by_number[number]

    def must_have_crud(self) -> None:
        """A family may keep the store's writes out, so that only its own functions write it (through the log)."""
        if not self.auto_crud:
            raise Unsupported(f"{self.name} has writes of its own")

    def must_be(self, *shapes: str) -> None:
        if self.shape not in shapes:
            raise ShapeMismatch(f"{self.name} is {self.shape}, not {' or '.join(shapes)}")

    def __getitem__(self, name: str):
        from strata.plans.expr import Field

        return Field(name)

    def __getattr__(self, name: str):
        if name.startswith("_") or name == "by_number":
            raise AttributeError(name)
        if any(name in v.names for v in self.__dict__.get("versions", ())):
            return self[name]
        raise AttributeError(f"{self.__dict__.get('name')} has no field {name}")


def pack_header(struct_id: int, version: int) -> int:
    return struct_id << 8 | version


def unpack_header(header: int) -> tuple[int, int]:
    return header >> 8, header & 0xFF


def version_of_name(name: str) -> tuple[str, int]:
    """Splits a trailing number off a type's name: Order2 is version 2 of Order."""
    m = re.fullmatch(r"(.*?[A-Za-z_])(\d+)", name)
    if not m or not 0 <= int(m[2]) <= MAX_VERSION:
        raise StrataError(f"{name} doesn't end in a version number from 0 to {MAX_VERSION}")
    return m[1], int(m[2])


class Registry:
    """Looks families and versions up by header; two declarations of one header are an error."""

    def __init__(self, families: Iterable[Family] = ()) -> None:
        self.families: dict[int, Family] = {}
        for f in families:
            self.add(f)

    def add(self, family: Family) -> Family:
        if family.struct_id in self.families:
            raise DuplicateHeader(f"struct id {family.struct_id} is declared twice")
        self.families[family.struct_id] = family
        return family

    def find(self, header: int) -> tuple[Family, Version]:
        struct_id, number = unpack_header(header)
        if struct_id not in self.families or number not in self.families[struct_id].by_number:
            raise UnknownHeader(f"header {header:#x}")
        return self.families[struct_id], self.families[struct_id].by_number[number]

    def contains(self, header: int) -> bool:
        struct_id, number = unpack_header(header)
        return struct_id in self.families and number in self.families[struct_id].by_number

    def latest_version(self, struct_id: int) -> int:
        if struct_id not in self.families:
            raise UnknownHeader(f"struct id {struct_id}")
        return self.families[struct_id].latest.number

    def headers(self) -> list[int]:
        return sorted(pack_header(s, n) for s, f in self.families.items() for n in f.by_number)
