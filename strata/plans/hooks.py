"""Hooks of a write: checks, then a projection, then late checks. Rows that fail go to a reject table with the first failure."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from strata.schema import Family, Version

REJECT = "struct<code:string,field:string,message:string>"


def first_failure(checks: tuple, code: str) -> Column:
    """A struct of the first check that doesn't hold (null counts as not holding), else null."""
    out = F.lit(None).cast(REJECT)
    for name, message, good in reversed(checks):
        failed = F.struct(F.lit(code).alias("code"), F.lit(name).cast("string").alias("field"), F.lit(message).alias("message"))
        out = F.when(~F.coalesce(good(), F.lit(False)), failed).otherwise(out)
    return out


def run_hooks(df: DataFrame, family: Family, version: Version) -> tuple[DataFrame, DataFrame]:
    """Accepted rows (after preprocess), and rejects: struct_id, version, code, field, message and the row as JSON."""
    reject = "__reject"
    checked = df.withColumn(reject, first_failure(version.checks, "ValidationFailed"))
    good, bad = checked.where(F.col(reject).isNull()).drop(reject), checked.where(F.col(reject).isNotNull())
    if version.preprocess:
        good = good.transform(version.preprocess)
    if version.late_checks:
        late = good.withColumn(reject, first_failure(version.late_checks, "PreprocessFailed"))
        good, more = late.where(F.col(reject).isNull()).drop(reject), late.where(F.col(reject).isNotNull())
        bad = bad.select(*df.columns, reject).unionByName(more.select(*df.columns, reject))
    rows = bad.select(F.lit(family.struct_id).alias("struct_id"), F.lit(version.number).alias("version"), f"{reject}.code", f"{reject}.field", f"{reject}.message", F.to_json(F.struct(*df.columns)).alias("row"))
    return good, rows


def route(df: DataFrame, registry, header_col: str = "header") -> tuple[DataFrame, DataFrame]:
    """Rows whose header is declared, and rejects of the rest."""
    known = F.col(header_col).isin(registry.headers())
    bad = df.where(~F.coalesce(known, F.lit(False)))
    rejects = bad.select(F.floor(F.col(header_col) / 256).cast("int").alias("struct_id"), (F.col(header_col) % 256).cast("int").alias("version"), F.lit("UnknownHeader").alias("code"), F.lit(None).cast("string").alias("field"), F.lit("not declared").alias("message"), F.to_json(F.struct(*df.columns)).alias("row"))
    return df.where(known), rejects
