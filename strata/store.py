"""The store: a registry of families over a version log, and sessions that are bound to a user and a tenant."""

from __future__ import annotations

import re
import uuid
from dataclasses import dataclass, field
from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from strata.errors import MigrationFailed, PermissionDenied, Unsupported
from strata.functions.ids import DIGITS, ID_COLUMNS
from strata.operators import live as L
from strata.operators import permissions
from strata.plans.expr import All, Expr, compile_expr
from strata.plans.hooks import run_hooks
from strata.plans.migrate import Move, check_links, first_try_or, read_as
from strata.runtime import materialise, stage_path
from strata.schema import NESTED, NON_UNIQUE, UNIQUE, Family, Registry, pack_header
from strata.sources.log import Part, VersionLog, minted

REJECTS = "struct_id int, version int, code string, field string, message string, row string"


@dataclass(frozen=True)
class Saved:
    accepted: DataFrame
    rejected: DataFrame


@dataclass(frozen=True)
class StoreConfig:
    """What a store needs to be opened: where its log lies, its families, and the addresses of its peers and archive."""

    root: str | None = None
    families: tuple[Family, ...] = ()
    peers: tuple[str, ...] = ()
    archive: str | None = None
    replicas: int = field(default=1)

    def open(self, spark: SparkSession) -> Store:
        return Store(spark, self.root, Registry(self.families))


class Store:
    """root: where the log lies. Without a registry the store is blind to schemas."""

    def __init__(self, spark: SparkSession, root: str | None = None, registry: Registry | None = None) -> None:
        self.spark, self.registry = spark, registry or Registry()
        self.root = root or stage_path(spark, "store")
        self.log = VersionLog(spark, self.root)
        for f in self.registry.families.values():
            check_links(f)

    def session(self, user: int, tenant: int) -> Session:
        return Session(self, user, tenant)

    def known(self, family: Family) -> Family:
        self.registry.find(pack_header(family.struct_id, family.latest.number))
        return family

    def rejects(self) -> DataFrame:
        path = f"{self.root}/rejects"
        from strata.runtime import exists

        return self.spark.read.schema(REJECTS + ", commit string").parquet(path).drop("commit") if exists(self.spark, path) else self.spark.createDataFrame([], REJECTS)

    def compact(self, family: Family, files: int = 8) -> None:
        self.log.compact(family, files)

    def vacuum(self, family: Family) -> int:
        return self.log.vacuum(family)


@dataclass(frozen=True)
class Session:
    store: Store
    user: int
    tenant: int

    def for_tenant(self, tenant: int) -> Session:
        return Session(self.store, self.user, tenant)

    def _live_ids(self, family: Family, until: int | None, parts: list[Part] | None = None) -> DataFrame:
        log = self.store.log.system(family, self.tenant, parts)
        return (L.live(log, family) if until is None else L.as_of(log, family, until)).select(*ID_COLUMNS, "version")

    def _rows(self, family: Family, expr: Expr, version: int | None, until: int | None, after: bool) -> DataFrame:
        """Scan by stored version, filter in that layout, keep what is live, then migrate; in this order.

        Rows of a family of many records are scanned once and only meet the tombstones' ids; a unique family's meet the id that is live.
        """
        self.store.known(family)
        wanted = family.version(version)
        at = self.store.log.parts(family)
        seen = F.lit(True) if until is None else F.col("seq") <= until
        gone = self.store.log.system(family, self.tenant, at).where((F.col("op") == "D") & seen).select(*ID_COLUMNS).distinct()
        parts = []
        for stored in sorted({v for _, v in at} & set(family.by_number)) or [wanted.number]:
            rows = self.store.log.read(family, stored, self.tenant, at).where((F.col("op") == "U") & seen)
            if not after and not isinstance(expr, All):
                rows = rows.where(compile_expr(expr, family.version(stored)))
            if family.shape == UNIQUE:
                rows = rows.join(self._live_ids(family, until, at).where(F.col("version") == stored).drop("version"), list(ID_COLUMNS), "left_semi")
            else:
                rows = rows.join(gone, list(ID_COLUMNS), "left_anti")
            moved = read_as(rows, family, stored, wanted.number, self)
            if missing := [n for n in wanted.names if n not in moved.columns]:
                raise MigrationFailed(f"{family.name}: version {stored} as {wanted.number} lacks {missing}")
            parts.append(moved.select(*ID_COLUMNS, "seq", "user", "permission", *wanted.names, F.lit(stored).alias("stored_version")))
        out = reduce(DataFrame.unionByName, parts)
        return out.where(compile_expr(expr, wanted)) if after and not isinstance(expr, All) else out

    def query(self, family: Family, expr: Expr | None = None, version: int | None = None, ordered: bool = False, filter_after_migration: bool = False, until: int | None = None) -> DataFrame:
        """Live records that the filter takes, in the wanted version's layout; in commit order if asked."""
        family.must_be(NON_UNIQUE, NESTED)
        out = self._rows(family, expr or All(), version, until, filter_after_migration)
        return out.orderBy("created_at", "shard") if ordered else out

    def find(self, family: Family, version: int | None = None, until: int | None = None) -> DataFrame:
        """The one live record of a unique family, or no row."""
        family.must_be(UNIQUE)
        found = self._rows(family, All(), version, until, False)
        return first_try_or(found, family, family.version(version).number)

    def get(self, family: Family, shard: int, created_at: int, version: int | None = None) -> DataFrame:
        rows = self._rows(family, All(), version, None, False)
        return rows.where((F.col("shard") == shard) & (F.col("created_at") == created_at)).limit(1)

    def get_by_anchor(self, family: Family, shard: int = 0, version: int | None = None) -> DataFrame:
        return L.by_anchor(self._rows(family, All(), version, None, False), self.tenant, shard, family.struct_id)

    def read_anchor(self, family: Family, key: str, blobs: DataFrame | None = None) -> DataFrame:
        """Picks the read by what the key is: 64 digits name a blob; 32 are an id, whose tick is zero if it stands for a unique or the oldest record."""
        if len(key) == 64 and blobs is not None:
            return blobs.where(F.col("content_hash") == key)
        if not re.fullmatch("[0-9a-f]{32}", key):
            raise Unsupported(f"{key} is no anchor")
        tenant, shard, struct_id, tick = (int(key[a - 1 : a - 1 + n], 16) for a, n in (DIGITS[p] for p in ID_COLUMNS))
        if (tenant, struct_id) != (self.tenant, family.struct_id):
            raise PermissionDenied(f"{key} isn't of {family.name} of tenant {self.tenant}")
        if tick:
            return self.get(family, shard, tick)
        return self.find(family) if family.shape == UNIQUE else self.get_by_anchor(family, shard)

    def split(self, family: Family, targets: dict[Family, Move], order: tuple[str, ...] = ("created_at",)) -> dict[str, Saved]:
        """The live records of a family as records of others, with ids of their own there. The source stays."""
        rows = self.query(family) if family.shape != UNIQUE else self.find(family)
        return {t.name: self.save(t, rows.orderBy(*order).transform(move)) for t, move in targets.items()}

    def history(self, family: Family) -> DataFrame:
        """All rows of the log, tombstones included, with links between versions."""
        return L.version_chain(self.store.log.system(family, self.tenant).where("op = 'U'"))

    def save(self, family: Family, rows: DataFrame, version: int | None = None, order: tuple[str, ...] | None = None) -> Saved:
        """Checks, preprocesses, mints ids (in the given order, or as the rows come) and appends. Every save is a new record; a unique family shows the last one only."""
        self.store.known(family).must_have_crud()
        wanted = family.version(version)
        missing = [n for n in wanted.names if n not in rows.columns]
        if missing:
            raise Unsupported(f"{family.name}: no columns {missing}")
        extra = [c for c in ("device", "permission") if c in rows.columns]
        good, bad = run_hooks(rows.select(*wanted.names, *extra), family, wanted)
        if wanted.checks or wanted.late_checks:
            bad = materialise(bad, "rejects")
            bad.write.parquet(f"{self.store.root}/rejects/commit={uuid.uuid4().hex}")  # a directory of its own: writers don't meet
        else:
            bad = self.store.spark.createDataFrame([], REJECTS)
        new = minted(good, family, self.tenant, list(order) if order else None, lambda n: self.store.log.reserve(family, self.tenant, n))
        new = new.withColumn("user", F.lit(self.user))
        for name, kind in (("device", "bigint"), ("permission", permissions.PERMISSION)):
            new = new if name in extra else new.withColumn(name, F.lit(None).cast(kind))
        self.store.log.append(family, wanted.number, new)  # numbered rows are a table already: what is returned reads that
        return Saved(new, bad)

    def delete(self, family: Family, ids: DataFrame) -> DataFrame:
        """Tombstones for ids of this tenant; ids that are gone already change nothing, ids of others are refused."""
        self.store.known(family).must_have_crud()
        foreign = ids.where((F.col("tenant") != self.tenant) | (F.col("struct_id") != family.struct_id))
        if not foreign.isEmpty():
            raise PermissionDenied(f"ids of another tenant than {self.tenant}")
        live = self._live_ids(family, None)
        gone = live.join(ids.select(*ID_COLUMNS).distinct(), list(ID_COLUMNS), "left_semi")
        numbered = minted(gone.withColumn("__at", F.col("created_at")), family, None, ["__at"], lambda n: self.store.log.reserve(family, self.tenant, n))
        marks = numbered.withColumn("created_at", F.col("__at")).withColumn("op", F.lit("D")).withColumn("user", F.lit(self.user)).drop("__at")
        empty = family.latest
        blank = marks.select("*", F.lit(None).cast("bigint").alias("device"), F.lit(None).cast(permissions.PERMISSION).alias("permission"), *(F.lit(None).cast(f.data_type).alias(f.name) for f in empty.fields))
        self.store.log.append(family, empty.number, blank)
        return marks
