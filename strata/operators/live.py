"""Live records of a version log: which rows a query sees, and as of when.

A log has the columns struct_id, version, tenant, shard, created_at, op ('U' or 'D'), seq and the family's fields. An id is
(tenant, shard, struct_id, created_at); a row with op 'D' is the tombstone of an id.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from strata.functions.ids import ID_COLUMNS
from strata.schema import UNIQUE, Family

SEGMENT = 256


def of_tenant(log: DataFrame, family: Family, tenant: int | Column | None = None) -> DataFrame:
    rows = log.where(F.col("struct_id") == family.struct_id)
    return rows if tenant is None else rows.where(F.col("tenant") == tenant)


def without_tombstones(log: DataFrame) -> DataFrame:
    """Writes whose id has no tombstone. Only the ids of tombstones take part in the join, and deletes are few."""
    gone = log.where("op = 'D'").select(*ID_COLUMNS).distinct()
    return log.where("op = 'U'").join(gone, list(ID_COLUMNS), "left_anti")


def newest(rows: DataFrame, by: list[str], order: list[str]) -> DataFrame:
    """The row of the greatest order in each group. Spark keeps one row a group in each task before it deals them, and reads only the columns that are used."""
    first = Window.partitionBy(*by).orderBy(*(F.desc(c) for c in order))
    return rows.withColumn("__nth", F.row_number().over(first)).where("__nth = 1").drop("__nth")


def live(log: DataFrame, family: Family, tenant: int | None = None) -> DataFrame:
    """What a query sees. A unique family has its last write, unless that was deleted; others all that wasn't deleted."""
    rows = of_tenant(log, family, tenant)
    if family.shape == UNIQUE:
        last = newest(rows.where("op = 'U'"), ["tenant"], ["created_at", "seq"])
        return last.join(rows.where("op = 'D'").select(*ID_COLUMNS).distinct(), list(ID_COLUMNS), "left_anti").select(*log.columns)
    return without_tombstones(rows).select(*log.columns)


def as_of(log: DataFrame, family: Family, tick: int, tenant: int | None = None) -> DataFrame:
    """Live records as they were at a tick, by the log's seq."""
    return live(log.where(F.col("seq") <= tick), family, tenant)


def by_id(log: DataFrame, tenant: int, shard: int, struct_id: int, created_at: int) -> DataFrame:
    """Point read in the history: equality on flat columns, which Parquet statistics prune."""
    return log.where((F.col("tenant") == tenant) & (F.col("struct_id") == struct_id) & (F.col("created_at") == created_at) & (F.col("shard") == shard) & (F.col("op") == "U"))


def by_anchor(rows: DataFrame, tenant: int, shard: int, struct_id: int) -> DataFrame:
    """The oldest live record with that anchor."""
    same = (F.col("tenant") == tenant) & (F.col("shard") == shard) & (F.col("struct_id") == struct_id)
    return rows.where(same).orderBy("created_at", "seq").limit(1)


def tenant_range(tenant: int) -> tuple[bytes, bytes]:
    """First and last id of a tenant, as 16 big-endian bytes."""
    return (tenant << 80).to_bytes(16, "big"), ((tenant << 80) + (1 << 80) - 1).to_bytes(16, "big")


def key_range(rows: DataFrame, key: Column, low: bytes, high: bytes) -> DataFrame:
    """Ids between two keys, both included."""
    return rows.where((key >= F.lit(low)) & (key <= F.lit(high)))


def rebuild(tracked: DataFrame, replayed: DataFrame) -> DataFrame:
    """Union of two lists of ids without repeats; recovery from a log that overlaps what was stored."""
    ids = list(ID_COLUMNS)
    return tracked.select(*ids).unionByName(replayed.select(*ids)).dropDuplicates(ids)


def segments(rows: DataFrame, by: tuple[str, ...] = ("tenant",)) -> DataFrame:
    """rows and segment: which run of 256 ids, in commit order, each belongs to."""
    order = Window.partitionBy(*by).orderBy("created_at", *[c for c in ("shard", "seq") if c in rows.columns])
    return rows.withColumn("segment", F.floor((F.row_number().over(order) - 1) / SEGMENT).cast("bigint"))


def version_chain(log: DataFrame, by: tuple[str, ...] = ("tenant", "shard", "struct_id")) -> DataFrame:
    """log and its links: the record before and after each in its group, whether it is the first, and whether it is live."""
    order = Window.partitionBy(*by).orderBy("created_at", "seq")
    linked = log.withColumn("old_id", F.lag("created_at").over(order)).withColumn("new_id", F.lead("created_at").over(order))
    return linked.withColumn("is_first", F.col("old_id").isNull()).withColumn("is_live", F.col("new_id").isNull())


def since_checkpoint(log: DataFrame, kind: str = "op", mark: str = "C") -> DataFrame:
    """Entries after the last checkpoint marker, all if there is none."""
    last = log.where(F.col(kind) == mark).agg(F.max("seq").alias("last"))
    return log.crossJoin(F.broadcast(last)).where((F.col(kind) != mark) & (F.col("seq") > F.coalesce("last", F.lit(-1)))).drop("last")


def merge_on_read(base: DataFrame, pending: DataFrame, key: list[str], order: str, deleted: str = "deleted") -> DataFrame:
    """Stored rows under rows that are still pending; a pending row with deleted set takes its key away."""
    both = base.withColumn(deleted, F.lit(False)).withColumn("__layer", F.lit(0)).unionByName(pending.withColumn("__layer", F.lit(1)))
    return newest(both, key, ["__layer", order]).where(~F.col(deleted)).drop("__layer", deleted)
