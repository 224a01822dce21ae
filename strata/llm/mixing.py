"""Mixing sources to target weights by Poisson replication (operator 6, native).

A source of n documents that shall give the share w of a total of T has the mean repetition rate T * w / n. Each document draws
a number in (0, 1) from the md5 of a seed and its id, and the inverted Poisson distribution with its source's mean makes that its count
of copies. Each copy is a row; rows are dealt and ordered by another hash, which shuffles the corpus globally.

The distribution is summed in logarithms over the counts within REACH standard deviations (and 30) of the mean; outside lie less than 10^-30 of it.
So a source's table grows with the square root of its mean, and a document looks through fewer entries than it gets copies.

Defined results. Null source is a source of its own. Without weights all sources weigh the same; with weights, sources that
they do not name get no rows. Rows with equal doc_id draw alike; null doc_id draws as the text "null". An empty table gives no rows.
Output columns that the input has already get an underscore. Texts are not looked at: null, empty and very long ones travel as they are.

Skew: sources are counted with map-side aggregation. The table of distributions is broadcast only up to max_broadcast bytes (its size is
summed first), beyond that it is joined by shuffle, whose large partitions AQE splits. Rows are dealt by a hash of id and copy. A document of many copies
is first made a row for each BLOCK of them; the blocks are dealt before their copies are made.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from strata.llm.common import col, materialise, own_name, table

DIGITS = 13
SEED = "mix-1"
REACH = 12
#: Copies that one task makes of a document at once.
BLOCK = 4096
#: From this count on, Stirling's series gives the logarithm of a factorial to the last digits.
STIRLING = 256


def _draw(key: Column) -> Column:
    return (F.conv(F.substring(F.md5(key.cast("binary")), 1, DIGITS), 16, 10).cast("double") + 0.5) / float(16**DIGITS)


def _key(name: str) -> Column:
    return F.coalesce(col(name).cast("string"), F.lit("null"))


def _log_first(mean: Column, k: Column) -> Column:
    """Logarithm of the Poisson probability of k. The series is only used from STIRLING on, and k is 0 below."""
    x = k.cast("double")
    series = 1 / (12 * x) - 1 / (360 * x * x * x) + 1 / (1260 * F.pow(x, F.lit(5.0)))
    far = (x - mean) + x * F.log1p((mean - x) / x) - 0.5 * F.log(2 * math.pi * x) - series
    return F.when(k == 0, -mean).otherwise(far)


def rates(docs: DataFrame, weights: dict[str | None, float] | None = None, total: float | None = None, source_col: str = "source") -> DataFrame:
    """source, n, mean, least (the smallest count that is looked at) and cdf (probabilities of at most least, least + 1, ... copies)."""
    counts = docs.groupBy(col(source_col).cast("string").alias("source")).agg(F.count("*").alias("n"))
    if weights is None:
        weighed = counts.withColumn("w", F.lit(1.0))
    else:
        given = docs.sparkSession.createDataFrame([(k, float(v)) for k, v in weights.items()], "name string, w double")
        weighed = counts.join(given, F.col("source").eqNullSafe(F.col("name")), "left").drop("name").fillna(0.0, "w")
    weighed = materialise(weighed, "sources")
    both = weighed.agg(F.sum("w").alias("w"), F.sum("n").alias("n")).first()
    whole = float(total if total is not None else both["n"] or 0)
    out = weighed.withColumn("mean", F.lit(whole) * F.col("w") / F.lit(both["w"] or 1.0) / F.col("n")).where("mean > 0")
    reach = REACH * F.sqrt("mean") + 30
    low = F.floor(F.col("mean") - reach)
    out = out.withColumn("least", F.when(low < STIRLING, 0).otherwise(low).cast("long")).withColumn("most", F.ceil(F.col("mean") + reach).cast("long"))
    steps = out.select("source", "n", "mean", "least", F.explode(F.sequence("least", "most")).alias("k"))
    upto = Window.partitionBy("source").orderBy("k")
    p = F.exp(_log_first(F.col("mean"), F.col("least")) + F.sum(F.when(F.col("k") == F.col("least"), 0.0).otherwise(F.log(F.col("mean") / F.col("k")))).over(upto))
    summed = steps.withColumn("p", p).withColumn("c", F.sum("p").over(upto))
    lists = summed.groupBy("source", "n", "mean", "least").agg(F.sort_array(F.collect_list(F.struct("k", "c"))).alias("x"))
    return lists.select("source", "n", "mean", "least", F.transform("x", lambda x: x["c"]).alias("cdf"))


def mix(docs: DataFrame, weights: dict[str | None, float] | None = None, total: float | None = None, seed: str = SEED, id_col: str = "doc_id", source_col: str = "source", max_broadcast: int = 8 << 20) -> DataFrame:
    """docs's columns, n_copies, copy (from 0) and mix_key, by which the rows are dealt and ordered."""
    per = materialise(rates(docs, weights, total, source_col).select(F.col("source").alias("of"), "least", "cdf"), "rates")
    size = per.agg(F.sum(F.size("cdf") * 8 + F.coalesce(F.octet_length("of"), F.lit(0)) + 64).alias("bytes"), F.max(F.col("least") + F.size("cdf")).alias("most")).first()
    if (size["bytes"] or 0) <= max_broadcast:
        per = F.broadcast(per)
    names = [own_name(docs, x) for x in ("n_copies", "copy", "mix_key")]
    packed = docs.select(F.struct(*(col(c) for c in docs.columns)).alias("row"), _key(id_col).alias("key"), col(source_col).cast("string").alias("source"))
    drawn = packed.join(per, F.col("source").eqNullSafe(F.col("of"))).withColumn("u", _draw(F.concat(F.lit(seed + ":"), "key")))
    below = F.size(F.filter("cdf", lambda c: c < F.col("u")))
    counted = drawn.select("row", "key", F.when(below > 0, F.col("least") + below).otherwise(F.col("least")).cast("long").alias("n")).where("n > 0")
    parts = int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    copies = F.explode(F.sequence(F.lit(0).cast("long"), F.col("n") - 1))
    if (size["most"] or 0) <= BLOCK:  # no document can have more
        rows = counted.withColumn("copy", copies)
    else:
        blocks = counted.where(F.col("n") > BLOCK).withColumn("block", F.explode(F.sequence(F.lit(0).cast("long"), F.floor((F.col("n") - 1) / BLOCK)))).repartition(parts, "key", "block")
        inside = F.explode(F.sequence(F.col("block") * BLOCK, F.least(F.col("n"), (F.col("block") + 1) * BLOCK) - 1))
        rows = counted.where(F.col("n") <= BLOCK).withColumn("copy", copies).unionByName(blocks.withColumn("copy", inside).drop("block"))
    rows = rows.withColumn("at", F.md5(F.concat(F.lit(seed + ":order:"), "key", F.lit(":"), F.col("copy").cast("string")).cast("binary")))
    dealt = rows.repartition(parts, "at").sortWithinPartitions("at")
    return dealt.select("row.*", F.col("n").alias(names[0]), F.col("copy").alias(names[1]), F.col("at").alias(names[2]))


def op6(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mix(table(spark, sf_dir, "documents"))


def stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """docs in the new proportions, each copy a row of docs' columns. Nulls, empty texts and repeated rows as in mix()."""
    return mix(docs).select(*(col(c) for c in docs.columns))


OP6_SQL = f"""
WITH s AS (SELECT source, count(*) AS n FROM documents GROUP BY source),
r AS (SELECT source, CAST((SELECT sum(n) FROM s) AS DOUBLE) * 1.0 / (SELECT CAST(count(*) AS DOUBLE) FROM s) / n AS mean FROM s),
k AS (SELECT source, mean, unnest(range(0, CAST(ceil(mean + 12 * sqrt(mean) + 30) AS BIGINT) + 1)) AS k FROM r),
p AS (SELECT source, k, exp(-mean + sum(CASE WHEN k = 0 THEN 0 ELSE ln(mean / k) END) OVER (PARTITION BY source ORDER BY k)) AS p FROM k),
c AS (SELECT source, k, sum(p) OVER (PARTITION BY source ORDER BY k) AS c FROM p),
u AS (SELECT *, (CAST('0x' || substr(md5('{SEED}:' || CAST(doc_id AS VARCHAR)), 1, {DIGITS}) AS BIGINT) + 0.5) / {16**DIGITS}.0 AS u FROM documents),
n AS (SELECT u.doc_id, u.text, u.lang, u.source, u.n_chars, count(c.k) FILTER (WHERE c.c < u.u) AS n_copies
      FROM u JOIN c ON u.source IS NOT DISTINCT FROM c.source GROUP BY ALL),
e AS (SELECT *, unnest(range(n_copies)) AS copy FROM n WHERE n_copies > 0)
SELECT *, md5('{SEED}:order:' || CAST(doc_id AS VARCHAR) || ':' || CAST(copy AS VARCHAR)) AS mix_key FROM e
"""
