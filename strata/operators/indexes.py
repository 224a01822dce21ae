"""Lookups by property: point, range and bucket reads. Sorted Parquet with its statistics stands in for index structures."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from strata.schema import Family


def lookup(rows: DataFrame, key: str, value: object, order: list[str]) -> DataFrame:
    """The first entry with the key."""
    return rows.where(F.col(key) == F.lit(value)).orderBy(*order).limit(1)


def half_open(rows: DataFrame, key: str, low: object, high: object) -> DataFrame:
    return rows.where((F.col(key) >= F.lit(low)) & (F.col(key) < F.lit(high)))


def all_sorted(rows: DataFrame, key: str, most: int = (1 << 63) - 1) -> DataFrame:
    """Every entry in order; as a half-open range it leaves the greatest possible key out."""
    return rows.where(F.col(key) < most).orderBy(key)


def is_tree(count: int, threshold: int = 50) -> bool:
    """Whether an adaptive index of so many entries, about to take another, is a tree."""
    return count >= threshold


def structure(rows: DataFrame, by: list[str], threshold: int = 50) -> DataFrame:
    return rows.groupBy(*by).agg(F.count("*").alias("entries")).withColumn("backend", F.when(F.col("entries") > threshold, "tree").otherwise("array"))


def bucket_counts(rows: DataFrame, bucket: Column) -> DataFrame:
    return rows.groupBy(bucket.alias("bucket")).agg(F.count("*").alias("entries"))


def write_sorted(rows: DataFrame, path: str, key: list[str], files: int) -> None:
    """A layout that min and max statistics prune well on the key."""
    rows.repartitionByRange(files, *key).sortWithinPartitions(*key).write.mode("overwrite").parquet(path)


def duplicates(rows: DataFrame, family: Family) -> DataFrame:
    """Values of the primary anchor that more than one live record of a tenant has."""
    return rows.groupBy("tenant", *family.primary_anchor).agg(F.count("*").alias("records")).where("records > 1")


def aliases(rows: DataFrame, family: Family) -> DataFrame:
    """alias -> primary anchor, a row for each secondary anchor."""
    text = lambda cols: F.concat_ws("\u001f", *(F.col(c).cast("string") for c in cols))
    out = [rows.select("tenant", F.lit(",".join(s)).alias("anchor"), text(s).alias("alias"), text(family.primary_anchor).alias("primary")) for s in family.secondary_anchors]
    first = out[0]
    for x in out[1:]:
        first = first.unionByName(x)
    return first
