"""Access by tenant, by a list of users in the record, or by a group.

A permission is null (the record's tenant only), or a struct of kind ('inline' or 'group'), users and group.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

PERMISSION = "struct<kind:string,users:array<bigint>,group:bigint>"
PROMOTED = 50


def allows_user(permission: Column, user: Column) -> Column:
    """By the record alone: a group says no here."""
    return F.coalesce(F.when(permission["kind"] == "inline", F.array_contains(permission["users"], user)), F.lit(False))


def register(groups: DataFrame, new: DataFrame) -> DataFrame:
    """Groups (group_id, users) with new ones in place of those of the same id."""
    return groups.join(new, "group_id", "left_anti").unionByName(new)


def with_access(records: DataFrame, groups: DataFrame, user: Column, user_tenant: Column, permission: str = "permission", tenant: str = "tenant") -> DataFrame:
    """records and allowed. A missing group denies; inline lists and groups don't look at the tenant."""
    asked = records.withColumn("__user", user).withColumn("__group", F.col(permission)["group"])
    pairs = groups.select(F.col("group_id").alias("__g"), F.explode(F.array_distinct("users")).alias("__u"))
    met = asked.join(pairs, (F.col("__group") == F.col("__g")) & (F.col("__user") == F.col("__u")), "left")
    p = F.col(permission)
    allowed = F.when(p.isNull(), user_tenant == F.col(tenant)).when(p["kind"] == "inline", F.array_contains(p["users"], F.col("__user"))).otherwise(F.col("__g").isNotNull())
    return met.withColumn("allowed", F.coalesce(allowed, F.lit(False))).drop("__user", "__group", "__g", "__u")


def visible(records: DataFrame, groups: DataFrame, user: int, user_tenant: int, **names: str) -> DataFrame:
    return with_access(records, groups, F.lit(user), F.lit(user_tenant), **names).where("allowed").drop("allowed")


def promoted(permission: Column) -> Column:
    """Whether the list is long enough to be kept as a table of its own; membership is the same."""
    return F.coalesce(F.size(F.array_distinct(permission["users"])) > PROMOTED, F.lit(False))


def promote(records: DataFrame, key: str, permission: str = "permission") -> tuple[DataFrame, DataFrame]:
    """records with long lists taken out (kind 'listed'), and those lists as a table of key and user, which is met by a join."""
    p = F.col(permission)
    long = promoted(p)
    users = records.where(long).select(F.col(key).alias("listed"), F.explode(F.array_distinct(p["users"])).alias("user"))
    short = F.struct(F.when(long, F.lit("listed")).otherwise(p["kind"]).alias("kind"), F.when(~long, p["users"]).alias("users"), p["group"].alias("group"))
    return records.withColumn(permission, F.when(p.isNotNull(), short)), users


def with_access_promoted(records: DataFrame, lists: DataFrame, groups: DataFrame, key: str, user: int, user_tenant: int, permission: str = "permission", tenant: str = "tenant") -> DataFrame:
    """As with_access, for records that promote() made: only one user's entries of the long lists and the groups take part in the joins."""
    mine = lists.where(F.col("user") == user).select("listed").distinct()
    member = groups.where(F.array_contains("users", user)).select(F.col("group_id").alias("__g")).distinct()
    p = F.col(permission)
    met = records.join(mine, F.col(key) == F.col("listed"), "left").join(member, p["group"] == F.col("__g"), "left")
    short = F.coalesce(F.array_contains(p["users"], user), F.lit(False))
    allowed = F.when(p.isNull(), F.lit(user_tenant) == F.col(tenant)).when(p["kind"] == "listed", F.col("listed").isNotNull()).when(p["kind"] == "inline", short).otherwise(F.col("__g").isNotNull())
    return met.withColumn("allowed", allowed).drop("listed", "__g")
