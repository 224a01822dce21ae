"""Exact deduplication as a stateful stream (operator 2, native).

The documents arrive as a file stream. A keyed streaming aggregation over RocksDB state (on disk, without expiry) retains
for each SHA-256 digest of the normalised text: the count, the stable identifier (largest doc_id) and the content locator
(file and row) of the row that stays. Every row whose digest has been seen more than once is a hit; its full bytes are
compared with the bytes found at the locator. Rows that differ in spite of equal digests are grouped by their full text.

Digests travel, texts don't: only the texts of hits are shuffled, found in the scan by their locators.

Defined results. Null text counts as empty. Null doc_id sorts before every other. Of rows with equal text and equal
doc_id, the one in the later file position stays. An empty table gives no rows. Further columns of the input are not read, whatever
their names. Texts of any length are hashed and compared whole. The path is taken literally, without patterns.

Skew: the state holds one row a digest, and Spark aggregates on the map side before rows are dealt by digest. Hits are
compared in joins whose large partitions AQE splits.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from strata.llm.common import among, ascii_lower, col, delete, exists, literal, materialise, stage_path, text_of

#: State on disk; all instances of an executor share one bounded cache and are closed soon after their query ends. Files aren't allocated ahead, and
#: commits upload changes: small states in many partitions stay small.
STATE_SETTINGS = {
    "spark.sql.streaming.stateStore.providerClass": "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider",
    "spark.sql.streaming.stateStore.rocksdb.boundedMemoryUsage": "true",
    "spark.sql.streaming.stateStore.rocksdb.maxMemoryUsageMB": "128",
    "spark.sql.streaming.stateStore.rocksdb.allowFAllocate": "false",
    "spark.sql.streaming.stateStore.rocksdb.changelogCheckpointing.enabled": "true",
    "spark.sql.streaming.stateStore.maintenanceInterval": "5s",
}


def _glob(path: str) -> str:
    """A file stream takes no single file, but a pattern that matches one."""
    path = path.rstrip("/")
    return f"{literal(path[:-1])}[{path[-1]}]"


def normalised(text: str = "text") -> Column:
    return ascii_lower(text_of(text))


def _located(df: DataFrame, id_col: str, text_col: str) -> DataFrame:
    meta = df.metadataColumn("_metadata")
    place = F.struct(meta["file_path"].alias("file"), meta["row_index"].alias("row"))
    return df.select(col(id_col).cast("long").alias("doc_id"), place.alias("place"), normalised(text_col).alias("norm"))


def _place_key(place: str) -> Column:
    return F.xxhash64(F.col(place)["file"], F.col(place)["row"])


def stream_state(spark: SparkSession, path: str, id_col: str = "doc_id", text_col: str = "text", checkpoint: str | None = None, max_bytes_per_trigger: str | None = None) -> DataFrame:
    """Digest, count, identifier and locator of every text, after the stream has taken all files under path.

    With a checkpoint that outlives the call, the next call takes only new files and goes on from the kept state.
    """
    own = checkpoint is None
    checkpoint = checkpoint or stage_path(spark, "dedup-stream")
    out = checkpoint + "-state"
    reader = spark.readStream.schema(spark.read.parquet(literal(path)).schema)
    if max_bytes_per_trigger:
        reader = reader.option("maxBytesPerTrigger", max_bytes_per_trigger)
    rows = _located(reader.parquet(_glob(path)), id_col, text_col)
    seen = rows.groupBy(F.sha2("norm", 256).alias("digest")).agg(
        F.count("*").alias("group_size"),
        F.max(F.struct("doc_id", "place")).alias("keep"),
    )

    def keep(batch: DataFrame, epoch: int) -> None:
        batch.write.mode("overwrite").parquet(f"{out}/epoch={epoch}")

    before = {k: spark.conf.get(k, None) for k in STATE_SETTINGS}
    for k, v in STATE_SETTINGS.items():
        spark.conf.set(k, v)
    try:
        query = seen.writeStream.outputMode("update").foreachBatch(keep).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
        query.awaitTermination()
    finally:
        for k, v in before.items():
            spark.conf.set(k, v) if v is not None else spark.conf.unset(k)
        if own:  # nobody goes on from it
            delete(spark, checkpoint)
    schema = "digest string, group_size long, keep struct<doc_id:bigint,place:struct<file:string,row:bigint>>, epoch int"
    updates = spark.read.schema(schema).option("basePath", out).parquet(out) if exists(spark, out) else spark.createDataFrame([], schema)
    if not max_bytes_per_trigger and updates.select("epoch").distinct().count() <= 1:
        return updates.drop("epoch")
    return materialise(updates.groupBy("digest").agg(F.max_by(F.struct("group_size", "keep"), "epoch").alias("x")).select("digest", "x.*"), "dedup-state")


def exact_dedup(spark: SparkSession, path: str, id_col: str = "doc_id", text_col: str = "text", checkpoint: str | None = None, max_bytes_per_trigger: str | None = None) -> DataFrame:
    """One row per row under path: doc_id, keep_id, group_size, kept, text_sha256."""
    groups = stream_state(spark, path, id_col, text_col, checkpoint, max_bytes_per_trigger).where("group_size > 1").select(F.col("digest").alias("of"), "keep", "group_size")
    rows = _located(spark.read.parquet(literal(path)), id_col, text_col)
    digests = materialise(rows.select("doc_id", "place", F.sha2("norm", 256).alias("digest")), "digests")
    marked = materialise(digests.join(groups, F.col("digest") == F.col("of"), "left").drop("of"), "marked")
    hits = marked.where("group_size > 1")

    # the texts of hits, picked in the scan by locator
    is_hit = among(hits.select(_place_key("place").alias("key")), "key")
    found = rows.where(is_hit(_place_key("place"))).select(F.col("place").alias("at"), "norm")
    hits = materialise(hits.join(found, F.col("place") == F.col("at")).drop("at"), "hits")
    # the bytes that the groups' locators point at, once for each group
    kept_bytes = hits.where("place = keep.place").select(F.col("digest").alias("of"), F.col("norm").alias("kept_norm"))
    hits = hits.join(kept_bytes, F.col("digest") == F.col("of"))
    same = F.col("norm") == F.col("kept_norm")
    checked = materialise(hits.select("doc_id", "place", "digest", same.alias("same"), F.when(~same, F.col("norm")).alias("other")), "checked")

    def answer(df: DataFrame, keep: Column, size: Column) -> DataFrame:
        return df.select("doc_id", keep["doc_id"].alias("keep_id"), size.alias("group_size"), (keep["place"] == F.col("place")).alias("kept"), F.col("digest").alias("text_sha256"))

    own = F.struct("doc_id", "place")
    if checked.where(~F.col("same")).isEmpty():
        return answer(marked, F.coalesce("keep", own), F.coalesce("group_size", F.lit(1).cast("long")))
    alone = answer(marked.where("group_size is null"), own, F.lit(1).cast("long"))
    regrouped = checked.groupBy("digest", "same", "other").agg(F.count("*").alias("size"), F.max(F.struct("doc_id", "place")).alias("stay"))
    again = checked.alias("c").join(regrouped.alias("g"), (F.col("c.digest") == F.col("g.digest")) & (F.col("c.same") == F.col("g.same")) & F.col("c.other").eqNullSafe(F.col("g.other"))).select("c.doc_id", "c.place", "c.digest", "g.size", "g.stay")
    return alone.unionByName(answer(again, F.col("stay"), F.col("size")))


def op2(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact_dedup(spark, f"{sf_dir}/documents.parquet")


OP2_SQL = """
WITH n AS (SELECT doc_id, translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS norm FROM documents)
SELECT doc_id, max(doc_id) OVER w AS keep_id, count(*) OVER w AS group_size,
       doc_id = max(doc_id) OVER w AS kept, sha256(norm) AS text_sha256
FROM n WINDOW w AS (PARTITION BY norm)
"""
