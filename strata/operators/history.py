"""The archive of versioned records: idempotent upserts, reads by id, summaries, retention and compaction.

Archive rows have tenant, record_id (text), data (binary or text), write_seq, and where needed version and struct_id.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from strata.functions.ids import header
from strata.operators.live import newest, since_checkpoint

DEFAULT_BROWSE = 4096
ENTRY_OVERHEAD = 24


def apply_flush(archive: DataFrame, batch: DataFrame) -> DataFrame:
    """Upsert by (tenant, record_id): the last write wins, and a batch that comes twice changes nothing."""
    return newest(archive.unionByName(batch, allowMissingColumns=True), ["tenant", "record_id"], ["write_seq"])


def deduplicated(deliveries: DataFrame, order: str = "write_seq") -> DataFrame:
    return newest(deliveries, ["tenant", "record_id"], [order])


def history_get(archive: DataFrame, tenant: int, record_id: str) -> DataFrame:
    return archive.where((F.col("tenant") == tenant) & (F.col("record_id") == record_id))


def tenant_summaries(archive: DataFrame, data: str = "data") -> DataFrame:
    """Records and bytes of each tenant, ascending."""
    return archive.groupBy("tenant").agg(F.count("*").alias("record_count"), F.sum(F.octet_length(data)).alias("total_bytes")).orderBy("tenant")


def tenant_count(archive: DataFrame, approximate: bool = False) -> DataFrame:
    count = F.approx_count_distinct("tenant") if approximate else F.countDistinct("tenant")
    return archive.agg(count.alias("tenants"))


def index_size(archive: DataFrame, data: str = "data") -> DataFrame:
    """Records and the bytes that an index of them takes."""
    return archive.agg(F.count("*").alias("records"), F.coalesce(F.sum(F.octet_length(data) + ENTRY_OVERHEAD), F.lit(0)).alias("index_bytes"))


def flush_count(archive: DataFrame) -> DataFrame:
    """Batches applied so far, as far as the rows show: the greatest sequence number."""
    return archive.agg(F.coalesce(F.max("write_seq"), F.lit(0)).alias("flushes"))


def high_water(acks: DataFrame, seq: str = "write_seq") -> DataFrame:
    """The greatest acknowledged sequence number of each tenant; late and reordered acks don't lower it."""
    return acks.groupBy("tenant").agg(F.coalesce(F.max(seq), F.lit(0)).alias("high_water"))


def record_summaries(archive: DataFrame, tenant: int | None, most: int = 0, data: str = "data") -> tuple[DataFrame, DataFrame]:
    """A page of summaries by id (tenant None: of each tenant), and whether it was cut. most 0: the default page."""
    most = min(most or DEFAULT_BROWSE, DEFAULT_BROWSE)
    rows = archive if tenant is None else archive.where(F.col("tenant") == tenant)
    by = Window.partitionBy("tenant").orderBy("record_id")
    out = rows.select("tenant", "record_id", F.octet_length(data).cast("bigint").alias("data_bytes"), "write_seq", header("struct_id", "version").alias("header"))
    page = out.withColumn("nth", F.row_number().over(by)).where(F.col("nth") <= most).drop("nth")
    cut = rows.groupBy("tenant").agg((F.count("*") > most).alias("truncated"))
    return page, cut


def retained(log: DataFrame, through: int) -> DataFrame:
    """Drops the prefix of the log up to a sequence number."""
    return log.where(F.col("seq") > through)


def compacted(log: DataFrame, files: int) -> DataFrame:
    """The log's rows for a rewrite into few files, by tenant and tick, so that statistics prune."""
    return log.repartitionByRange(files, "tenant", "created_at").sortWithinPartitions("tenant", "created_at", "seq")


def lag_behind(sent: DataFrame, acked: DataFrame) -> DataFrame:
    """Sent minus acknowledged of each peer, never under zero."""
    s = sent.groupBy("peer").agg(F.max("seq").alias("sent"))
    a = acked.groupBy("peer").agg(F.max("seq").alias("acked"))
    return s.join(a, "peer", "left").select("peer", "sent", F.coalesce("acked", F.lit(0)).alias("acked"), F.greatest(F.lit(0), F.col("sent") - F.coalesce("acked", F.lit(0))).alias("lag"))


def fully_replicated(acked: DataFrame, seq: int) -> DataFrame:
    """Whether every peer has acknowledged seq; with no peer, yes."""
    least = acked.groupBy("peer").agg(F.max("seq").alias("acked")).agg(F.min("acked").alias("least"))
    return least.select(F.coalesce(F.col("least") >= seq, F.lit(True)).alias("fully_replicated"))


def watermarks(acked: DataFrame) -> DataFrame:
    return acked.groupBy("peer").agg(F.coalesce(F.max("seq"), F.lit(0)).alias("acked")).orderBy("peer")


def flush_batches(log: DataFrame, most: int) -> DataFrame:
    """log and batch: runs of at most so many records of each tenant, oldest first, as they go to the archive."""
    by = Window.partitionBy("tenant").orderBy("seq")
    return log.withColumn("batch", F.floor((F.row_number().over(by) - 1) / most))


def drained(base: DataFrame, log: DataFrame) -> tuple[DataFrame, DataFrame]:
    """The archive with what the log holds after its last checkpoint, and how many records those are."""
    fresh = since_checkpoint(log)
    return apply_flush(base, fresh.select(*base.columns)), fresh.agg(F.count("*").alias("drained"))
