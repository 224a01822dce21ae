"""References between families, as joins that Catalyst plans: one to one, one to many, many to many, nested, aliases and orphans."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from strata.errors import StrataError
from strata.runtime import materialise


def one_to_one(a: DataFrame, b: DataFrame, on: Column, back: Column | None = None) -> DataFrame:
    """Pairs that refer to each other; back is the reference the other way, if b has one."""
    return a.join(b, on if back is None else on & back)


def one_to_many(parent: DataFrame, child: DataFrame, on: Column, keep_childless: bool = False) -> DataFrame:
    return parent.join(child, on, "left" if keep_childless else "inner")


def many_to_many(a: DataFrame, junction: DataFrame, b: DataFrame, on_a: Column, on_b: Column) -> DataFrame:
    """Pairs that a junction family ties together."""
    return a.join(junction, on_a).join(b, on_b)


def members(a: DataFrame, anchors: DataFrame, on: Column) -> DataFrame:
    """Rows of a whose anchor is among the anchors, each once."""
    return a.join(anchors, on, "left_semi")


def any_of(a: DataFrame, b: DataFrame, conditions: list[Column], key_a: list[str], key_b: list[str]) -> DataFrame:
    """Pairs for which any of several equalities holds: a union of equi-joins, not a nested loop."""
    pairs = reduce(DataFrame.unionByName, (a.join(b, c) for c in conditions))
    return pairs.dropDuplicates([*key_a, *key_b])


def orphans(child: DataFrame, parent: DataFrame, on: Column) -> DataFrame:
    """Rows whose reference leads nowhere."""
    return child.join(parent, on, "left_anti")


def nest(child: DataFrame, by: list[str], order: list[str], columns: list[str], name: str = "children") -> DataFrame:
    """Children as one sorted array for each parent."""
    return child.groupBy(*by).agg(F.sort_array(F.collect_list(F.struct(*(F.col(c) for c in [*order, *[x for x in columns if x not in order]])))).alias(name))


def unnest(parent: DataFrame, name: str = "children") -> DataFrame:
    rest = [c for c in parent.columns if c != name]
    return parent.select(*rest, F.explode(name).alias("__child")).select(*rest, "__child.*")


def resolve_alias(refs: DataFrame, aliases: DataFrame, ref: str, alias: str, primary: str) -> DataFrame:
    """Secondary anchors replaced by the primary they stand for; others as they are."""
    return refs.join(aliases.select(F.col(alias).alias("__alias"), F.col(primary).alias("__primary")), F.col(ref) == F.col("__alias"), "left").withColumn(ref, F.coalesce("__primary", ref)).drop("__alias", "__primary")


def descend(nodes: DataFrame, key: str, parent: str) -> DataFrame:
    """nodes and depth below a root, however deep. Keys are unique; what hangs below a parent that isn't there is left out, and a cycle is an error.

    Each node knows an ancestor and how far up it is; a pass puts that ancestor's own in its place, so the distances double and
    the passes grow with the logarithm of the depth. Every pass is a table of its own.
    """
    up = lambda df: df.select(F.col("__key").alias("__of"), F.col("__up").alias("__next"), F.col("__far").alias("__more"))
    start = nodes.select(F.col(key).alias("__key"), F.col(parent).alias("__up"), F.when(F.col(parent).isNull(), 0).otherwise(1).cast("bigint").alias("__far"))
    at, many, reach = materialise(start, "ancestors"), None, 1
    while not at.where("__up is not null").isEmpty():
        many = at.count() if many is None else many
        if reach > 2 * many:
            raise StrataError(f"the {parent}s of some {key}s lead in a circle")
        met = at.where("__up is not null").join(up(at), F.col("__up") == F.col("__of"))  # an inner join: orphans go
        at = materialise(at.where("__up is null").unionByName(met.select("__key", F.col("__next").alias("__up"), (F.col("__far") + F.col("__more")).alias("__far"))), "ancestors")
        reach *= 2
    return nodes.join(at.select("__key", F.col("__far").alias("depth")), F.col(key) == F.col("__key")).drop("__key")
