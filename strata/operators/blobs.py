"""Large values by content: one stored copy, many owners.

Values up to the inline limit stay with their record. A larger one is named by its SHA-256; equal names are the same bytes.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

INLINE = 64
SPILL = 65_536


def placed(records: DataFrame, owner: str, value: str, inline: int = INLINE) -> DataFrame:
    """owner, content_hash (null: inline), size and value as bytes."""
    data = F.col(value).cast("binary")
    return records.select(F.col(owner).alias("owner"), F.when(F.octet_length(data) > inline, F.sha2(data, 256)).alias("content_hash"), F.octet_length(data).cast("bigint").alias("size"), data.alias("value"))


def store(records: DataFrame, owner: str, value: str, inline: int = INLINE) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Inline values, blobs (content_hash, size, value and verified: all values of the name are the same bytes) and owners (content_hash, owner); an owner counts once."""
    rows = placed(records, owner, value, inline)
    kept = rows.where("content_hash is null").select("owner", "size", "value")
    large = rows.where("content_hash is not null")
    blobs = large.groupBy("content_hash").agg(F.max("size").alias("size"), F.min("value").alias("value"), (F.min("value") == F.max("value")).alias("verified"))
    return kept, blobs, large.select("content_hash", "owner").distinct()


def clashes(records: DataFrame, owner: str, value: str, inline: int = INLINE) -> DataFrame:
    """Names that stand for unlike bytes: the least and the greatest value of a name are compared in full. None, unless SHA-256 is broken."""
    large = placed(records, owner, value, inline).where("content_hash is not null")
    return large.groupBy("content_hash").agg(F.min("value").alias("least"), F.max("value").alias("most")).where("least <> most").select("content_hash")


def owners_of(owners: DataFrame) -> DataFrame:
    return owners.groupBy("content_hash").agg(F.countDistinct("owner").alias("owners"))


def read(blobs: DataFrame, content_hash: str) -> DataFrame:
    return blobs.where(F.col("content_hash") == content_hash)


def release(blobs: DataFrame, owners: DataFrame, released: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Blobs that live on, owners that are left, and names that died with their last owner. Owners that never were change nothing."""
    left = owners.join(released, ["content_hash", "owner"], "left_anti")
    touched = owners.join(released, ["content_hash", "owner"], "left_semi").select("content_hash").distinct()
    dead = touched.join(left.select("content_hash").distinct(), "content_hash", "left_anti")
    return blobs.join(dead, "content_hash", "left_anti"), left, dead


def spilled(rows: DataFrame, key: str, value: str, most: int = SPILL) -> tuple[DataFrame, DataFrame]:
    """Rows with values over the limit replaced by their name, and the table of those values."""
    large = F.octet_length(value) > most
    name = F.sha2(F.col(value).cast("binary"), 256)
    return rows.withColumn("blob", F.when(large, name)).withColumn(value, F.when(large, F.lit(None)).otherwise(F.col(value))), rows.where(large).select(name.alias("blob"), F.col(value)).dropDuplicates(["blob"])
