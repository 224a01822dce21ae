"""The version log on disk: Parquet in directories that are written once and listed in a manifest.

A writer puts its rows in a new directory version=<v>/commit=<c>/bucket=<b> and then commits a manifest that names it. Manifests are numbered, and
each number is written once: who comes second reads again and tries the next. So a reader sees whole commits only, and appends that run
side by side, or beside a compaction, all stay. The same goes for sequence numbers, which are reserved for each tenant.

The bucket is a hash of the tenant. A query for one tenant names its bucket too, so Spark reads that partition only.
Compaction writes what a manifest names into few files and commits a manifest that names those instead; old directories stay until vacuum().
"""

from __future__ import annotations

import json
import uuid
from collections.abc import Callable
from functools import reduce

from py4j.protocol import Py4JJavaError
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from strata.errors import Conflict
from strata.functions.ids import masked
from strata.operators.live import newest
from strata.operators.permissions import PERMISSION
from strata.runtime import exists, materialise
from strata.schema import Family, Version

BUCKETS = 64
SYSTEM = "struct_id int, tenant bigint, shard int, created_at bigint, op string, seq bigint, user bigint, device bigint"


def log_schema(version: Version) -> T.StructType:
    system = T._parse_datatype_string(SYSTEM + f", permission {PERMISSION}")
    return T.StructType([*system.fields, *(T.StructField(f.name, f.data_type) for f in version.fields)])


def bucket_of(tenant: Column) -> Column:
    return F.pmod(F.xxhash64(tenant.cast("bigint")), F.lit(BUCKETS)).cast("int")


class Chain:
    """Numbered small texts in a folder; each number is written once. Needs a file system whose rename or link refuses an existing target, as HDFS and local disks do."""

    def __init__(self, spark: SparkSession, path: str, keep: int = 64) -> None:
        self.jvm, self.path, self.keep = spark._jvm, path, keep
        at = self._at(path)
        self.fs = at.getFileSystem(spark._jsc.hadoopConfiguration())
        self.local = self.fs.makeQualified(at).toUri().getScheme() == "file"

    def _at(self, path: str):
        return self.jvm.org.apache.hadoop.fs.Path(path)

    def _numbers(self) -> list[int]:
        at = self._at(self.path)
        names = [x.getPath().getName() for x in self.fs.listStatus(at)] if self.fs.exists(at) else []
        return sorted(int(n) for n in names if n.isdigit())

    def last(self) -> tuple[int, str]:
        """The greatest number and its text; -1 and nothing in the beginning."""
        numbers = self._numbers()
        if not numbers:
            return -1, ""
        stream = self.fs.open(self._at(f"{self.path}/{numbers[-1]:020d}"))
        try:
            return numbers[-1], self.jvm.org.apache.commons.io.IOUtils.toString(stream, "UTF-8")
        finally:
            stream.close()

    def push(self, number: int, text: str) -> bool:
        """Whether the number was still free and is the last one now."""
        tmp, target = self._at(f"{self.path}/_{uuid.uuid4().hex}"), self._at(f"{self.path}/{number:020d}")
        stream = self.fs.create(tmp, True)
        stream.write(bytearray(text.encode()))
        stream.close()
        done = self._link(tmp, target) if self.local else not self.fs.exists(target) and self.fs.rename(tmp, target)
        self.fs.delete(tmp, False)
        if not done:
            return False
        numbers = self._numbers()
        if numbers[-1] > number:  # older numbers are cleared away: this one had been taken and cleared before
            return False
        for old in numbers[: -self.keep]:
            self.fs.delete(self._at(f"{self.path}/{old:020d}"), False)
        return True

    def _link(self, tmp, target) -> bool:
        local = lambda p: self.jvm.java.io.File(p.toUri().getPath()).toPath()
        try:
            self.jvm.java.nio.file.Files.createLink(local(target), local(tmp))
        except Py4JJavaError as e:
            if e.java_exception.getClass().getSimpleName() != "FileAlreadyExistsException":
                raise
            return False
        return True


#: A directory of rows and the version they are stored in.
Part = tuple[str, int]


class VersionLog:
    def __init__(self, spark: SparkSession, root: str) -> None:
        self.spark, self.root = spark, root.rstrip("/")

    def _home(self, family: Family) -> str:
        return f"{self.root}/family={family.struct_id}"

    def _rows(self, family: Family, version: int) -> str:
        return f"{self._home(family)}/rows/version={version}"

    def parts(self, family: Family) -> list[Part]:
        """What the last manifest names: a consistent state of the whole log."""
        _, text = Chain(self.spark, f"{self._home(family)}/_manifest").last()
        return [(d, v) for d, v in json.loads(text or "[]")]

    def commit(self, family: Family, change: Callable[[list[Part]], list[Part]]) -> None:
        """Puts change(parts) in the place of parts, on top of what others have committed meanwhile."""
        chain = Chain(self.spark, f"{self._home(family)}/_manifest")
        while True:
            number, text = chain.last()
            if chain.push(number + 1, json.dumps(change([(d, v) for d, v in json.loads(text or "[]")]))):
                return

    def reserve(self, family: Family, tenant: int, count: int) -> int:
        """The first of count sequence numbers that no other writer of the tenant gets. Numbers of a writer that fails stay unused."""
        chain = Chain(self.spark, f"{self._home(family)}/_seq/tenant={tenant}")
        while True:
            number, text = chain.last()
            first = int(text or -1) + 1
            if chain.push(number + 1, str(first + count - 1)):
                return first

    def read(self, family: Family, version: int, tenant: int | None = None, parts: list[Part] | None = None) -> DataFrame:
        """The log of one stored version; of one tenant, with partition pruning."""
        schema = log_schema(family.version(version))
        paths = [f"{self._rows(family, v)}/commit={d}" for d, v in (self.parts(family) if parts is None else parts) if v == version]
        if not paths:
            return self.spark.createDataFrame([], schema)
        places = [T.StructField("commit", T.StringType()), T.StructField("bucket", T.IntegerType())]
        rows = self.spark.read.schema(T.StructType([*schema.fields, *places])).option("basePath", self._rows(family, version)).parquet(*paths)
        if tenant is not None:
            rows = rows.where((F.col("bucket") == bucket_of(F.lit(tenant))) & (F.col("tenant") == tenant))
        return rows.drop("commit", "bucket")

    def system(self, family: Family, tenant: int | None = None, parts: list[Part] | None = None) -> DataFrame:
        """The columns that all versions share, and the version."""
        names = log_schema(family.latest).fieldNames()[:9]
        parts = self.parts(family) if parts is None else parts
        stored = [self.read(family, v, tenant, parts).select(*names, F.lit(v).alias("version")) for v in sorted(family.by_number)]
        return reduce(DataFrame.unionByName, stored)

    def append(self, family: Family, version: int, rows: DataFrame) -> None:
        new = (uuid.uuid4().hex, version)
        schema = log_schema(family.version(version))
        out = rows.select(*(F.col(f"`{f.name}`").cast(f.dataType).alias(f.name) for f in schema.fields), bucket_of(F.col("tenant")).alias("bucket"))
        out.write.partitionBy("bucket").parquet(f"{self._rows(family, version)}/commit={new[0]}")
        self.commit(family, lambda parts: [*parts, new])

    def compact(self, family: Family, files: int = 8) -> None:
        """Few sorted files a version in place of many small ones. Rows that are appended meanwhile stay where they are."""
        before = self.parts(family)
        new = [(uuid.uuid4().hex, v) for v in sorted({v for _, v in before})]
        for d, v in new:
            rows = self.read(family, v, None, before).withColumn("bucket", bucket_of(F.col("tenant")))
            rows.repartitionByRange(files, "bucket", "tenant", "created_at").sortWithinPartitions("bucket", "tenant", "created_at").write.partitionBy("bucket").parquet(f"{self._rows(family, v)}/commit={d}")

        def change(parts: list[Part]) -> list[Part]:
            if not set(before) <= set(parts):
                raise Conflict(f"{family.name}: another compaction came first")
            return [*new, *(p for p in parts if p not in before)]

        self.commit(family, change)

    def vacuum(self, family: Family) -> int:
        """Removes directories that the manifest doesn't name, while nobody writes or reads an older state; gives their number."""
        named, gone = set(self.parts(family)), 0
        for v in family.by_number:
            at = self.spark._jvm.org.apache.hadoop.fs.Path(self._rows(family, v))
            fs = at.getFileSystem(self.spark._jsc.hadoopConfiguration())
            for x in fs.listStatus(at) if fs.exists(at) else []:
                if (x.getPath().getName().removeprefix("commit="), v) not in named:
                    gone += fs.delete(x.getPath(), True)
        return gone


def minted(rows: DataFrame, family: Family, tenant: int | None, order: list[str] | None, reserve: Callable[[int], int]) -> DataFrame:
    """rows with id columns and seq, numbered in the given order (None: as they come) without one task that sees all rows. reserve: gives the first of so many numbers.

    Rows are dealt by ranges and numbered within each; a table of counts, one row a partition, gives each its offset.
    """
    dealt = rows.repartitionByRange(*order).sortWithinPartitions(*order) if order else rows
    marked = materialise(dealt.withColumn("__part", F.spark_partition_id()).withColumn("__nth", F.monotonically_increasing_id().bitwiseAND(F.lit((1 << 33) - 1))), "minted")
    counts = materialise(marked.groupBy("__part").agg(F.count("*").alias("n")), "counts")
    total = counts.agg(F.sum("n")).first()[0] or 0
    base = reserve(total) if total else 0
    before = F.coalesce(F.sum("n").over(Window.orderBy("__part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    offsets = F.broadcast(counts.select("__part", before.alias("__before")))
    out = marked.join(offsets, "__part").withColumn("seq", F.lit(base) + F.col("__before") + F.col("__nth")).drop("__part", "__nth", "__before")
    if tenant is not None:
        out = out.withColumn("tenant", masked("tenant", tenant))
    return out.withColumn("struct_id", F.lit(family.struct_id)).withColumn("shard", F.lit(0)).withColumn("created_at", masked("created_at", "seq")).withColumn("op", F.lit("U"))


def copy_on_write(spark: SparkSession, path: str, changes: DataFrame, partition: str, key: list[str], order: str) -> list:
    """Upserts changes into a table partitioned by a column, and writes only the partitions that they touch anew; gives their values.

    The latest row of a key wins, by order. Other partitions keep their files.
    """
    touched = [r[0] for r in changes.select(partition).distinct().collect()]  # partition values: directories, few by design
    stored = spark.read.schema(changes.schema).parquet(path).where(F.col(partition).isin(touched)) if exists(spark, path) else changes.limit(0)
    merged = materialise(newest(stored.unionByName(changes), key, [order]), "touched")
    merged.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy(partition).parquet(path)
    return sorted(touched)
