"""Operational figures: snapshots, heat maps, deltas, rings of history, totals, samples and verdicts."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

HEAT_SLOTS = 512
LAST = 60
SAMPLE = 150


def snapshot(log: DataFrame, rejects: DataFrame, size: Column) -> DataFrame:
    """Writes, deletes, bytes, tenants and rejects, as one row."""
    wrote = F.col("op") == "U"
    one = log.agg(F.count_if(wrote).alias("writes"), F.count_if(F.col("op") == "D").alias("deletes"), F.coalesce(F.sum(F.when(wrote, size)), F.lit(0)).alias("bytes"), F.countDistinct("tenant").alias("tenants"))
    return one.crossJoin(F.broadcast(rejects.agg(F.count("*").alias("rejected"))))


def metrics(log: DataFrame, rejects: DataFrame, reads: DataFrame, replicated: DataFrame, slot: Column, size: Column) -> DataFrame:
    """All figures of a node as one row: the snapshot, and reads, records taken over from others, and pages (slots that were written)."""
    one = lambda df, name: df.agg(F.count("*").alias(name))
    pages = log.where("op = 'U'").agg(F.countDistinct(slot).alias("pages"))
    out = snapshot(log, rejects, size)
    for more in (one(reads, "reads"), one(replicated, "replicated"), pages):  # one row each
        out = out.crossJoin(F.broadcast(more))
    return out.withColumn("memory", F.col("bytes") + 65_536)


def cache_bytes(rows: DataFrame, kinds: list[str], entry: int = 256) -> DataFrame:
    """What a cache of these records would take: so many bytes for each distinct key of each kind."""
    counts = [F.countDistinct(k) for k in kinds]
    total = counts[0]
    for c in counts[1:]:
        total = total + c
    return rows.agg((total * entry).alias("cache_bytes"))


def heat_map(rows: DataFrame, slot: Column, size: Column) -> DataFrame:
    """Bytes of each slot that has any."""
    return rows.groupBy(slot.alias("slot")).agg(F.sum(size).cast("bigint").alias("bytes"))


def scaled(heat: DataFrame) -> DataFrame:
    """heat and level: 0 for none, else 1 to 255 in proportion to the hottest. The greatest value is one row, so it is broadcast."""
    most = heat.agg(F.max("bytes").alias("most"))
    level = F.when(F.col("bytes") == 0, F.lit(0)).otherwise(F.greatest(F.lit(1), F.least(F.lit(255), F.expr("bytes * 255 div most"))))
    return heat.crossJoin(F.broadcast(most)).withColumn("level", level.cast("int")).drop("most")


def touched(heat: DataFrame) -> DataFrame:
    return heat.agg(F.count_if(F.col("bytes") > 0).alias("touched"))


def hottest(heat: DataFrame) -> DataFrame:
    return heat.withColumn("rank", F.rank().over(Window.orderBy(F.desc("bytes"))))


def page_fill(heat: DataFrame, pages: int) -> DataFrame:
    return heat.agg((F.count_if(F.col("bytes") > 0) / F.lit(pages)).alias("fill"))


def deltas(totals: DataFrame, by: list[str], at: str, value: str, skip_first: bool = False) -> DataFrame:
    """Growth of a running total from tick to tick, never under zero; the first tick counts from zero, or is left out."""
    before = F.lag(value).over(Window.partitionBy(*by).orderBy(at)) if by else F.lag(value).over(Window.partitionBy(F.lit(0)).orderBy(at))
    out = totals.withColumn("before", before)
    if skip_first:
        out = out.where("before is not null")
    return out.withColumn("delta", F.greatest(F.lit(0), F.col(value) - F.coalesce("before", F.lit(0)))).drop("before")


def ring_history(samples: DataFrame, at: str, value: str, last: int, size: int = LAST) -> DataFrame:
    """The last samples up to a tick, zero where there is none."""
    ticks = samples.sparkSession.range(last - size + 1, last + 1).select(F.col("id").alias(at))
    return ticks.join(samples.select(at, value), at, "left").withColumn(value, F.coalesce(value, F.lit(0)))


def cluster_totals(nodes: DataFrame, sums: list[str], health: str = "health") -> DataFrame:
    return nodes.agg(*(F.coalesce(F.sum(c), F.lit(0)).alias(c) for c in sums), F.count_if(F.col(health) == "OK").alias("nodes_up"), F.count("*").alias("nodes"))


def family_bytes(summaries: DataFrame, order: list[str], most: int = SAMPLE) -> DataFrame:
    """Bytes of each family among the first summaries (a sample for display), one at least."""
    return summaries.orderBy(*order).limit(most).groupBy(F.floor(F.col("header") / 256).cast("bigint").alias("family")).agg(F.greatest(F.lit(1), F.sum("data_bytes")).cast("bigint").alias("bytes"))


def search(nodes: DataFrame, query: str, url: str = "url", node: str = "node_id") -> DataFrame:
    """Nodes whose address or hexadecimal id contains the text, whatever its case; nothing for an empty text."""
    if not query:
        return nodes.where(F.lit(False))
    return nodes.where(F.lower(F.concat_ws(" ", F.col(url), F.lpad(F.hex(node), 16, "0"))).contains(query.lower()))


def recovered(ids: DataFrame, count: int, key: str = "id") -> DataFrame:
    """How many of the ids 1 to count are there."""
    return ids.where(F.col(key).between(1, count)).agg(F.countDistinct(key).alias("recovered"))


def tier_verdict(measured: DataFrame, tiers: DataFrame) -> DataFrame:
    """measured (name, and a figure a dimension) against tiers (tier, and a least figure a dimension); both are small tables of limits."""
    dims = [c for c in tiers.columns if c != "tier"]
    limits = tiers.select("tier", *(F.col(c).alias("least_" + c) for c in dims))
    both = measured.crossJoin(F.broadcast(limits))
    met = [(F.col(c) >= F.col("least_" + c)).alias("meets_" + c) for c in dims]
    out = both.select("name", "tier", *met)
    verdict = F.lit(True)
    for c in dims:
        verdict = verdict & F.col("meets_" + c)
    return out.withColumn("meets", verdict)


def perf_sample(records: Column, seconds: Column, size: Column, on_disk: Column) -> list[Column]:
    per = lambda a, b: F.when(b == 0, F.lit(0.0)).otherwise(a / b)
    return [per(records, seconds).alias("records_per_sec"), per(records * size / 1048576.0, seconds).alias("mib_per_sec"), per(on_disk, records).alias("bytes_per_record")]


def backpressure(writes: DataFrame, order: list[str], size: Column, capacity: int) -> DataFrame:
    """writes and how full the buffer is after each: the share, a warning from 0.8 and a stop from 1.0."""
    used = F.sum(size).over(Window.partitionBy("tenant").orderBy(*order).rowsBetween(Window.unboundedPreceding, 0))
    ratio = used / F.lit(capacity)
    return writes.withColumn("usage", ratio).withColumn("warn", ratio >= 0.8).withColumn("block", ratio >= 1.0)


def event_ring(events: DataFrame, at: list[str], size: int = 500) -> DataFrame:
    """The last messages, newest first."""
    return events.orderBy(*(F.desc(c) for c in at)).limit(size)
