"""What the operators of this subpackage share: reading, shared storage, row keys and native text rules."""

from __future__ import annotations

import atexit
import contextlib
import re
import tempfile
import uuid
import weakref
from collections.abc import Callable

from py4j.protocol import Py4JError
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: Characters that part words: space, tab, line feed, vertical tab, form feed, carriage return.
BLANKS = " \t\n\x0b\f\r"
#: Learning uses rows whose crc32(doc_id as text) mod 3 is not this.
HELD_OUT = 1


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share. Only a local master may do without: there it is a new folder of the machine's own, as in tests."""
    found = spark.conf.get("spark.checkpoint.dir", None)
    if not found:
        master = spark.sparkContext.master
        if not (master == "local" or master.startswith("local[")):
            raise RuntimeError(f"spark.checkpoint.dir is not set: with the master {master} it must name a folder that driver and executors share")
        found = "file://" + tempfile.mkdtemp(prefix="strata-")
        spark.conf.set("spark.checkpoint.dir", found)
    return found.rstrip("/")


_SCRATCH: set[str] = set()
_PATHS: weakref.WeakKeyDictionary[DataFrame, str] = weakref.WeakKeyDictionary()
#: Drops the shuffle files of a write as soon as it is done. Nothing reads them again: the table stands in for them.
_CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


def stage_path(spark: SparkSession, name: str) -> str:
    """A new path in the application's scratch folder, which is removed when the driver's process ends in good order."""
    scratch = f"{shared_dir(spark)}/strata-llm/{spark.sparkContext.applicationId}"
    if scratch not in _SCRATCH:
        _SCRATCH.add(scratch)
        atexit.register(_at_exit, spark, scratch)
    return f"{scratch}/{uuid.uuid4().hex}/{name}"


def _at_exit(spark: SparkSession, path: str) -> None:
    with contextlib.suppress(Py4JError, OSError):  # the JVM may have gone before
        delete(spark, path)


def delete(spark: SparkSession, path: str) -> None:
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    at.getFileSystem(spark._jsc.hadoopConfiguration()).delete(at, True)


def exists(spark: SparkSession, path: str) -> bool:
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    return at.getFileSystem(spark._jsc.hadoopConfiguration()).exists(at)


def materialise(df: DataFrame, name: str) -> DataFrame:
    """Cuts lineage with a table in the shared folder, so that a lost executor costs no recomputation from the start."""
    spark, path = df.sparkSession, stage_path(df.sparkSession, name)
    before = spark.conf.get(_CLEANUP)
    spark.conf.set(_CLEANUP, "true")
    try:
        df.write.parquet(path)
    finally:
        spark.conf.set(_CLEANUP, before)
    out = spark.read.schema(df.schema).parquet(path)
    _PATHS[out] = path
    return out


def discard(table_: DataFrame) -> None:
    """Removes a table that materialise() wrote and that nothing will read any more."""
    if path := _PATHS.pop(table_, None):
        delete(table_.sparkSession, path)


def literal(path: str) -> str:
    """The path for readers that take patterns: its own characters only."""
    return re.sub(r"([*?\[\]{}\\,])", r"\\\1", path.rstrip("/"))


def among(keys: DataFrame, key: str, most_bits: int = 1 << 26) -> Callable[[Column], Column]:
    """A test that holds for all 64-bit hashes in a table's column, and for few others: a bit each, in one array of at most most_bits / 8 bytes.

    With n hashes at most n / most_bits of all others pass, or a 16th while the array can grow. What passes is joined
    exactly afterwards, so only the number of rows that are shuffled depends on it.
    """
    spark, n = keys.sparkSession, keys.count()
    if not n:
        return lambda _: F.lit(False)
    bits = min(most_bits, 1 << max(16, (16 * n - 1).bit_length()))
    place = lambda k: F.pmod(k, F.lit(bits))
    word = lambda k: F.shiftright(place(k), 6).cast("int")
    bit = lambda k: place(k).bitwiseAND(F.lit(63)).cast("int")
    marks = keys.select(word(col(key)).alias("w"), bit(col(key)).alias("b")).groupBy("w").agg(F.bit_or(F.expr("shiftleft(1L, b)")).alias("x"))
    dense = spark.range(bits // 64).select(F.col("id").cast("int").alias("w")).join(marks, "w", "left").select("w", F.shiftright("w", 10).alias("block"), F.coalesce("x", F.lit(0)).cast("long").alias("x"))
    sorted_ = lambda at: F.transform(F.sort_array(F.collect_list(F.struct(at, "x"))), lambda p: p["x"])
    blocks = dense.groupBy("block").agg(sorted_("w").alias("x"))
    array = materialise(blocks.agg(F.flatten(sorted_("block")).alias("x")), "key-bits").scalar()
    return lambda k: F.getbit(F.get(array, word(k)), bit(k)) == 1


def first_of_equal(keyed: DataFrame, twice: DataFrame | None = None) -> tuple[DataFrame, DataFrame | None]:
    """Of rows that are equal in doc and hash one each, and the others (None: there are none). twice: the doc and hash of such rows, if they are known."""
    if twice is None:
        twice = keyed.groupBy("doc", "hash").agg(F.count("*").alias("n")).where("n > 1")
    twice = materialise(twice.select(F.col("doc").alias("of_doc"), F.col("hash").alias("of_hash")), "repeated-keys")
    if twice.isEmpty():
        return keyed, None
    may = among(twice.select(F.xxhash64("of_doc", "of_hash").alias("key")), "key")(F.xxhash64("doc", "hash"))
    on = F.col("doc").eqNullSafe(F.col("of_doc")) & (F.col("hash") == F.col("of_hash"))
    # numbered as they are written, so that no recomputation deals other numbers
    same = materialise(keyed.where(may).join(twice, on, "left_semi").withColumn("nth", F.monotonically_increasing_id()), "repeated-rows")
    first = same.groupBy(F.col("doc").alias("of_doc"), F.col("hash").alias("of_hash")).agg(F.min("nth").alias("stays"))
    same = same.join(materialise(first, "first-rows"), on)
    one = keyed.where(~may).unionByName(keyed.where(may).join(twice, on, "left_anti")).unionByName(same.where("nth = stays").select(*keyed.columns))
    return one, same.where("nth <> stays").select(*keyed.columns)


def col(name: str) -> Column:
    """A top-level column of that very name, dots included."""
    return F.col("`" + name.replace("`", "``") + "`")


def text_of(name: str = "text") -> Column:
    return F.coalesce(col(name).cast("string"), F.lit(""))


def row_hash(text: Column) -> Column:
    """With the document's id, this tells rows apart without any number that a recomputation could deal differently."""
    return F.xxhash64(text)


def is_held_out(doc_id: Column) -> Column:
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % 3, F.lit(0)) == HELD_OUT


def ascii_lower(text: Column) -> Column:
    """Lower-cases A-Z only. Pure ASCII takes the JVM's fast path; the rest is translated."""
    upper = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
    return F.when(F.octet_length(text) == F.char_length(text), F.lower(text)).otherwise(F.translate(text, upper, upper.lower()))


def without(text: Column, chars: str) -> Column:
    for c in chars:
        text = F.replace(text, F.lit(c))
    return text


def stripped(text: Column) -> Column:
    return F.btrim(text, F.lit(BLANKS))


def words(text: Column) -> Column:
    """The runs of anything but the six blanks, in order."""
    bare = stripped(text)
    return F.when(bare == "", F.array().cast("array<string>")).otherwise(F.split(bare, "[\\x20\\x09-\\x0D]+"))


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """body(value) with value computed once, also where lambdas inside body refer to it."""
    return F.transform(F.array(value), body)[0]


def own_name(df: DataFrame, wanted: str) -> str:
    """wanted, or the next free variation if the input has a column of that name."""
    have = {c.lower() for c in df.columns}
    while wanted.lower() in have:
        wanted += "_"
    return wanted


def with_row(packed: DataFrame, rest: str) -> T.StructType:
    """The schema of the struct column row and of the columns that follow it. Names in the struct may hold any characters."""
    return T.StructType([packed.schema["row"], *T._parse_datatype_string(rest).fields])


def named_apart(row: str, given: tuple[str, ...], made: tuple[str, ...]) -> list[Column]:
    """The given columns of a struct before the columns made: a given one whose name is among those gets an underscore more."""
    taken, out = {m.lower() for m in made}, []
    for name in given:
        new = name
        while new.lower() in taken:
            new += "_"
        taken.add(new.lower())
        out.append(F.col(row)[name].alias(new))
    return [*out, *(F.col(m) for m in made)]


def sql_literal(text: str) -> str:
    return "'" + re.sub("'", "''", text) + "'"
