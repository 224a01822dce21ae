"""Streams over the log: change feed, seen filter, archive sink, watermarks, gossip and heartbeats."""

from __future__ import annotations

import math
from functools import reduce
from operator import and_

import numpy as np
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from strata.functions.ids import anchor_hex
from strata.operators.history import apply_flush
from strata.runtime import exists, materialise


def read_log(spark: SparkSession, path: str, schema: T.StructType, max_files: int | None = None) -> DataFrame:
    """New files of a log directory, or of a pattern, as they come."""
    reader = spark.readStream.schema(schema)
    return (reader.option("maxFilesPerTrigger", max_files) if max_files else reader).parquet(path)


def one_path(path: str) -> str:
    """A pattern that matches one file or directory: a file stream takes no single file."""
    path = path.rstrip("/")
    return f"{path[:-1]}[{path[-1]}]"


def change_events(log: DataFrame) -> DataFrame:
    """anchor, deleted and the row's columns: an event for each row of the log, batch or stream."""
    return log.withColumn("anchor", anchor_hex()).withColumn("deleted", F.col("op") == "D")


def run_to_end(stream: DataFrame, name: str, checkpoint: str, mode: str = "append") -> DataFrame:
    """Takes all there is into a table in memory; for tests and small feeds."""
    query = stream.writeStream.format("memory").queryName(name).outputMode(mode).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
    query.awaitTermination()
    return stream.sparkSession.table(name)


def archive_stream(stream: DataFrame, target: str, checkpoint: str, interval: str | None = None):
    """Appends a stream of writes to the archive. The file sink's commits make each row arrive once, also after a restart."""
    writer = stream.writeStream.format("parquet").option("path", target).option("checkpointLocation", checkpoint)
    return (writer.trigger(processingTime=interval) if interval else writer.trigger(availableNow=True)).start()


def upsert_stream(stream: DataFrame, target: str, checkpoint: str):
    """Merges each batch into generations of the archive: <target>/epoch=<n> holds the whole of it after batch n."""
    spark = stream.sparkSession

    def merge(batch: DataFrame, epoch: int) -> None:
        before = f"{target}/epoch={epoch - 1}"
        old = spark.read.schema(batch.schema).parquet(before) if exists(spark, before) else spark.createDataFrame([], batch.schema)
        apply_flush(old, batch).write.mode("overwrite").parquet(f"{target}/epoch={epoch}")

    return stream.writeStream.foreachBatch(merge).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def high_water_stream(acks: DataFrame, by: str = "tenant", seq: str = "seq") -> DataFrame:
    """The greatest sequence number so far; in update mode a row whenever it rises. Late acks can't lower a maximum."""
    return acks.groupBy(by).agg(F.max(seq).alias("high_water"))


def high_water_table(acks: DataFrame, target: str, by: str = "tenant", seq: str = "seq") -> DataFrame:
    """Takes all acks there are; each batch leaves the marks that rose, of which the greatest counts."""
    spark = acks.sparkSession
    marks = high_water_stream(acks, by, seq)

    def keep(batch: DataFrame, epoch: int) -> None:
        batch.write.mode("overwrite").parquet(f"{target}/epoch={epoch}")

    marks.writeStream.outputMode("update").foreachBatch(keep).option("checkpointLocation", target + "-checkpoint").trigger(availableNow=True).start().awaitTermination()
    return spark.read.schema(marks.schema).parquet(target).groupBy(by).agg(F.max("high_water").alias("high_water"))


def replication_marks(acks: DataFrame, target: str) -> DataFrame:
    """peer, sent, acked and lag from a stream of (peer, kind, seq), kind 'sent' or 'acked'. Both marks only rise, whatever the order of arrival."""
    of = lambda kind: F.coalesce(F.max(F.when(F.col("kind") == kind, F.col("seq"))), F.lit(0)).cast("bigint")
    marks = acks.groupBy("peer").agg(of("sent").alias("sent"), of("acked").alias("acked"))

    def keep(batch: DataFrame, epoch: int) -> None:
        batch.write.mode("overwrite").parquet(f"{target}/epoch={epoch}")

    marks.writeStream.outputMode("update").foreachBatch(keep).option("checkpointLocation", target + "-checkpoint").trigger(availableNow=True).start().awaitTermination()
    last = acks.sparkSession.read.schema(marks.schema).parquet(target).groupBy("peer").agg(F.max("sent").alias("sent"), F.max("acked").alias("acked"))
    return last.withColumn("lag", F.greatest(F.lit(0), F.col("sent") - F.col("acked")).cast("bigint"))


def drain(query, seconds: int = 600) -> bool:
    """Lets a running stream take what is there, then stops it; whether it came to its end. Its checkpoint lets the next start go on."""
    query.processAllAvailable()
    query.stop()
    return query.awaitTermination(seconds) is not False and query.exception() is None


def last_epoch(spark: SparkSession, target: str, schema: str) -> DataFrame:
    """The newest generation that upsert_stream left."""
    at = spark._jvm.org.apache.hadoop.fs.Path(target)
    names = [x.getPath().getName() for x in at.getFileSystem(spark._jsc.hadoopConfiguration()).listStatus(at)]
    newest = max((int(n.split("=")[1]) for n in names if n.startswith("epoch=")), default=None)
    return spark.createDataFrame([], schema) if newest is None else spark.read.schema(schema).parquet(f"{target}/epoch={newest}")


def gossip_once(messages: DataFrame, within: str | None = None, at: str = "ts") -> DataFrame:
    """Each (origin, epoch) once. On a stream, within bounds the state by event time."""
    if within:
        return messages.withWatermark(at, within).dropDuplicatesWithinWatermark(["origin", "epoch"])
    return messages.dropDuplicates(["origin", "epoch"])


def heartbeat_gaps(beats: DataFrame, by: str, at: str, interval: int, missed: int = 3) -> DataFrame:
    """Beats that came more than so many intervals after the one before: the node had been given up meanwhile."""
    gap = F.col(at) - F.lag(at).over(Window.partitionBy(by).orderBy(at))
    return beats.withColumn("gap", gap).where(F.col("gap") > interval * missed)


def session_windows(beats: DataFrame, by: str, at: str, gap: str) -> DataFrame:
    """The same as session windows, also on streams."""
    return beats.groupBy(F.session_window(at, gap), by).agg(F.count("*").alias("beats"))


def unseen(changes: DataFrame, seen: DataFrame, key: str) -> DataFrame:
    """Changes that weren't seen before, exactly."""
    return changes.join(seen.select(key).distinct(), key, "left_anti")


class SeenFilter:
    """A Bloom filter over text keys for a client, of fixed size: never forgets one, and takes few unknown ones for known while it holds no more than items. SeenTable is for tables."""

    def __init__(self, items: int = 100_000, false_positives: float = 0.01) -> None:
        self.bits = max(64, math.ceil(-items * math.log(false_positives) / math.log(2) ** 2))
        self.hashes = max(1, round(self.bits / items * math.log(2)))
        self.words = np.zeros(-(-self.bits // 8), np.uint8)

    def places(self, keys: list[str]) -> np.ndarray:
        import hashlib

        pairs = np.array([np.frombuffer(hashlib.blake2b(k.encode(), digest_size=16).digest(), np.uint64) for k in keys], np.uint64).reshape(-1, 2)
        with np.errstate(over="ignore"):
            return (pairs[:, :1] + np.arange(self.hashes, dtype=np.uint64) * (pairs[:, 1:] | np.uint64(1))) % np.uint64(self.bits)

    def mark(self, keys: list[str]) -> None:
        at = self.places(keys).ravel().astype(np.int64)
        np.bitwise_or.at(self.words, at >> 3, (1 << (at & 7)).astype(np.uint8))

    def probably_seen(self, keys: list[str]) -> np.ndarray:
        at = self.places(keys).astype(np.int64)
        return ((self.words[at >> 3] >> (at & 7).astype(np.uint8)) & 1).all(1)

    def to_bytes(self) -> bytes:
        return self.words.tobytes()

    def merge(self, other: bytes) -> None:
        self.words |= np.frombuffer(other, np.uint8)


class SeenTable:
    """A seen filter for any number of keys: a table of blocks of 256 bits, in four words. A key sets a bit in each of a block's eight halves of words, and a join by block asks for them.

    Keys are compared as text; null is a key of its own. Asking works on streams too.
    """

    WORDS = 4

    def __init__(self, table: DataFrame, blocks: int) -> None:
        self.table, self.blocks = table, blocks

    @staticmethod
    def rate(load: float) -> float:
        """Share of unknown keys taken for known with so many keys a block on average, as keys fall into blocks by chance."""
        halves = 2 * SeenTable.WORDS
        return sum((-1) ** j * math.comb(halves, j) * math.exp(-load * (1 - (31 / 32) ** j)) for j in range(halves + 1))

    @staticmethod
    def load(false_positives: float) -> float:
        """The most keys a block may get on average."""
        if not 1e-9 <= false_positives <= 0.5:
            raise ValueError(f"false_positives must be between 1e-9 and 0.5, not {false_positives}")
        low, high = 0.0, 1000.0
        for _ in range(60):
            mid = (low + high) / 2
            low, high = (mid, high) if SeenTable.rate(mid) <= false_positives else (low, mid)
        return low

    def masks(self, digest: F.Column) -> list[F.Column]:
        bits = F.xxhash64(digest)
        one = lambda shift, at: F.call_function("shiftleft", F.lit(1).cast("bigint"), (F.shiftright(bits, shift).bitwiseAND(31) + at).cast("int"))
        return [one(10 * i, 0).bitwiseOR(one(10 * i + 5, 32)) for i in range(self.WORDS)]

    def block(self, digest: F.Column) -> F.Column:
        return F.pmod(digest, F.lit(self.blocks))

    @staticmethod
    def build(rows: DataFrame, key: str, items: int = 100_000, false_positives: float = 0.01) -> SeenTable:
        """Room for all keys there are, and for items at least. Their number is estimated to 0.8 %, with six times that as a reserve."""
        digests = rows.select(F.xxhash64(F.col(key).cast("string")).alias("digest"))
        found = digests.agg(F.approx_count_distinct("digest", 0.01)).first()[0]
        out = SeenTable(rows, math.ceil(max(items, 1.05 * found) / SeenTable.load(false_positives)))
        marks = digests.select(out.block(F.col("digest")).alias("block"), *(m.alias(f"w{i}") for i, m in enumerate(out.masks(F.col("digest")))))
        out.table = materialise(marks.groupBy("block").agg(*(F.bit_or(f"w{i}").alias(f"w{i}") for i in range(SeenTable.WORDS))), "seen")
        return out

    def probably_seen(self, rows: DataFrame, key: str, name: str) -> DataFrame:
        """The rows, with whether their key has probably been seen under that name."""
        kept = rows.columns
        asked = rows.withColumn("_digest", F.xxhash64(F.col(key).cast("string")))
        blocks = self.table.select(F.col("block").alias("_block"), *(F.col(f"w{i}").alias(f"_w{i}") for i in range(self.WORDS)))
        both = asked.join(blocks, self.block(F.col("_digest")) == F.col("_block"), "left")
        hits = [F.col(f"_w{i}").bitwiseAND(m) == m for i, m in enumerate(self.masks(F.col("_digest")))]
        return both.select(*(F.col(f"`{c}`") for c in kept), F.coalesce(reduce(and_, hits), F.lit(False)).alias(name))


def replicated(stream: DataFrame, targets: list[str], checkpoint: str):
    """Each batch to every replica as it is, without running hooks again; a batch that is repeated overwrites itself."""

    def copy(batch: DataFrame, epoch: int) -> None:
        kept = batch.persist()
        for t in targets:
            kept.write.mode("overwrite").parquet(f"{t}/epoch={epoch}")
        kept.unpersist()

    return stream.writeStream.foreachBatch(copy).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def sticky(stream: DataFrame, view, target: str, checkpoint: str):
    """Evaluates a view anew whenever rows come, and leaves its latest result in target."""

    def again(batch: DataFrame, epoch: int) -> None:
        view().write.mode("overwrite").parquet(target)

    return stream.writeStream.foreachBatch(again).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
