"""Which node holds a partition: a consistent ring of virtual nodes, replicas, pins, shard ranges, transfers, and slots that move.

The ring's table has nodes times virtual nodes rows. Looking up is a search in that sorted table on Arrow batches; the
table goes along with the function up to max_ring rows, a limit that is checked.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.functions import pandas_udf

from strata.errors import Unsupported
from strata.functions.hashing import _u, fnv64, fnv64_text
from strata.runtime import ship

VIRTUAL_NODES = 150
MAX_RING = 2_000_000


def node_id_of(address: str) -> int:
    return fnv64_text(address)


def ring_positions(nodes: list[int], virtual: int = VIRTUAL_NODES) -> tuple[np.ndarray, np.ndarray]:
    """Sorted positions and the node at each; of two nodes at one place the later one has it."""
    if len(nodes) * virtual > MAX_RING:
        raise Unsupported(f"a ring of more than {MAX_RING} places")
    n = np.repeat(np.array(nodes, np.uint64), virtual)
    places = fnv64([(n, 8), (np.tile(np.arange(virtual, dtype=np.uint64), len(nodes)), 4)]) if len(nodes) else np.empty(0, np.uint64)
    at = dict(zip(places.tolist(), n.tolist(), strict=True))
    keys = np.array(sorted(at), np.uint64)
    return keys, np.array([at[k] for k in keys.tolist()], np.uint64)


def walk(keys: np.ndarray, owners: np.ndarray, wanted: np.ndarray, n: int) -> list[list[int]]:
    """For each hash the next n distinct nodes clockwise."""
    most = min(n, len(np.unique(owners)))
    memo: dict[int, list[int]] = {}
    out = []
    for start in (np.searchsorted(keys, wanted, "left") % max(1, len(keys))).tolist() if len(keys) else [0] * len(wanted):
        if start not in memo:
            found: list[int] = []
            i = start
            while len(found) < most:
                if (node := int(owners[i])) not in found:
                    found.append(node)
                i = (i + 1) % len(keys)
            memo[start] = found
        out.append(memo[start])
    return out


def replicas_of(spark: SparkSession, nodes: list[int], tenant: Column, shard: Column, n: int, virtual: int = VIRTUAL_NODES) -> Column:
    """Node ids (as signed 64-bit numbers), the owner first."""
    ship(spark)
    keys, owners = ring_positions(nodes, virtual)

    @pandas_udf("array<bigint>")
    def run(t: pd.Series, s: pd.Series) -> pd.Series:
        found = walk(keys, owners, fnv64([(_u(t), 8), (_u(s), 2)]), n)
        return pd.Series([np.array(x, np.uint64).view(np.int64) for x in found])

    return run(tenant.cast("bigint"), shard.cast("bigint"))


def owner_of(spark: SparkSession, nodes: list[int], tenant: Column, shard: Column, virtual: int = VIRTUAL_NODES) -> Column:
    return F.get(replicas_of(spark, nodes, tenant, shard, 1, virtual), F.lit(0))


def with_pins(placed: DataFrame, pins: DataFrame, owner: str = "owner") -> DataFrame:
    """Pins (tenant, shard, pinned) go before the ring."""
    return placed.join(pins, ["tenant", "shard"], "left").withColumn(owner, F.coalesce("pinned", owner)).drop("pinned")


def in_range(shard: Column, first: Column, last: Column) -> Column:
    return shard.between(first, last)


def range_size(first: Column, last: Column) -> Column:
    return F.greatest(F.lit(0), last - first + 1)


def owned(partitions: DataFrame, ranges: DataFrame) -> DataFrame:
    """partitions and owned: whether some range (tenant, first, last) of the tenant holds the shard."""
    hit = partitions.select("tenant", "shard").distinct().join(ranges, "tenant").where(F.col("shard").between(F.col("first"), F.col("last"))).select("tenant", "shard").distinct().withColumn("owned", F.lit(True))
    return partitions.join(hit, ["tenant", "shard"], "left").withColumn("owned", F.coalesce("owned", F.lit(False)))


def with_range(ranges: DataFrame, tenant: int, first: int, last: int) -> DataFrame:
    """ranges and one more; the same one twice counts twice."""
    return ranges.unionByName(ranges.sparkSession.createDataFrame([(tenant, first, last)], "tenant bigint, first int, last int"))


def without_range(ranges: DataFrame, tenant: int, first: int, last: int) -> DataFrame:
    """ranges without one entry that is exactly this; nothing changes if there is none."""
    same = (F.col("tenant") == tenant) & (F.col("first") == first) & (F.col("last") == last)
    return ranges.where(~same).unionByName(ranges.where(same).groupBy("tenant", "first", "last").agg(F.count("*").alias("n")).where("n > 1").select("tenant", "first", "last", F.explode(F.expr("sequence(2, n)")).alias("k")).drop("k"))


def transfers(events: DataFrame) -> DataFrame:
    """The latest state of each transfer (transfer, seq, state), and whether it still goes on."""
    last = events.groupBy("transfer").agg(F.max_by("state", "seq").alias("state"))
    return last.withColumn("active", F.col("state").isin("pending", "accepted"))


def moved(before: Column, after: Column) -> Column:
    """Whether growing the table moves an entry."""
    return before != after


def grown(slots: int, factor: float = 1.75) -> int:
    return int(slots * factor)


def first_distinct(ring: DataFrame, by: str, node: str, distance: str, n: int) -> DataFrame:
    """The n nearest distinct nodes of each key, with SQL alone: nearest place of each node, then the nearest nodes."""
    near = ring.groupBy(by, node).agg(F.min(distance).alias(distance))
    return near.withColumn("nth", F.row_number().over(Window.partitionBy(by).orderBy(distance))).where(F.col("nth") <= n)
