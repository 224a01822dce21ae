"""Line deduplication over overlapping three-line windows (operator 5, native).

Lines are split at line feeds and compared without blanks at their ends; lines without a word stand in no window. Every three
consecutive lines make a window, known by two 64-bit hashes. A window that stands more than once in the corpus keeps its first
place (smallest doc_id, then text hash, then position); all other places are covered, and covered lines go.

Defined results. Null text counts as empty. Texts of fewer than three lines with words stay as they are. Null doc_id sorts first.
Of rows equal in doc_id and text, which one is the first doesn't matter: one of them keeps what it has first, and all windows of the others are
later places. Removed lines include blank ones only if they lie between covered lines of one window; a text may end up empty. Very
long texts are cut whole, an empty table gives no rows, and the input's columns travel in a struct, whatever their names.

Skew: windows are counted with map-side aggregation, and marking the later places is a join whose large partitions AQE splits;
only windows that stand twice are on its other side. Only texts with something to remove are shuffled, to meet their spans.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from strata.llm.common import among, col, first_of_equal, let, materialise, row_hash, stripped, table, text_of

SPAN = 3


def _numbered(text: Column) -> Column:
    lines = F.transform(F.split(text, "\n"), lambda x, i: F.struct(i.alias("i"), stripped(x).alias("t")))
    return F.filter(lines, lambda x: x["t"] != "")


def _in_windows(text: Column, one: Callable[[Column, Column], Column]) -> Column:
    """one(lines with words, k) for each window that begins at the k-th of them; null without a window."""
    return let(_numbered(text), lambda x: F.when(F.size(x) >= SPAN, F.transform(F.sequence(F.lit(0), F.size(x) - SPAN), lambda k: one(x, k))))


def windows(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc, hash (the row's key), k (position among the lines with words), first and last line number, a and b (hashes)."""
    text = text_of(text_col)
    span = lambda x, k: tuple(x[k + j]["t"] for j in range(SPAN))
    one = lambda x, k: F.struct(F.xxhash64(*span(x, k)).alias("a"), F.xxhash64(F.lit(1), *span(x, k)).alias("b"), x[k]["i"].alias("first"), x[k + SPAN - 1]["i"].alias("last"))
    made = _in_windows(text, one)
    rows = docs.select(col(id_col).cast("long").alias("doc"), row_hash(text).alias("hash"), made.alias("w"))
    return rows.select("doc", "hash", F.explode("w").alias("w")).select("doc", "hash", "w.*")


def covered(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc, hash, spans: the later places of repeated windows in each document, as (first, last) line numbers."""
    found = windows(docs, id_col, text_col)
    place = F.struct("doc", "hash", "first")
    again = found.groupBy("a", "b").agg(F.count("*").alias("n"), F.min(place).alias("stays")).where("n > 1").drop("n")
    again = materialise(again, "repeated-windows")  # as a table of its own, so that AQE can split a frequent window in the join
    later = found.join(again, ["a", "b"]).where(place != F.col("stays"))
    return later.groupBy("doc", "hash").agg(F.sort_array(F.collect_set(F.struct("first", "last"))).alias("spans"))


def _clean(rows: DataFrame) -> DataFrame:
    """row, clean, n_lines and n_removed of rows with row, text and spans (null: nothing to remove)."""
    gone = F.array_distinct(F.flatten(F.transform("spans", lambda s: F.sequence(s["first"], s["last"]))))
    stay = lambda lines: F.transform(F.array_except(F.sequence(F.lit(0), F.size(lines) - 1), gone), lambda i: lines[i])
    kept = F.when(F.col("spans").isNotNull(), let(F.split("text", "\n"), lambda lines: F.array_join(stay(lines), "\n")))
    removed = F.when(F.col("spans").isNull(), 0).otherwise(F.size(gone))
    return rows.select("row", F.coalesce(kept, F.col("text")).alias("clean"), F.size(F.split("text", "\n")).cast("long").alias("n_lines"), removed.cast("long").alias("n_removed"))


def line_dedup(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row for each of docs: row (its columns), clean (the text without covered lines), n_lines, n_removed."""
    text = text_of(text_col)
    keyed = docs.select(F.struct(*(col(c) for c in docs.columns)).alias("row"), text.alias("text"), col(id_col).cast("long").alias("doc"), row_hash(text).alias("hash"))
    keyed, repeated = first_of_equal(keyed)
    spans = materialise(covered(docs, id_col, text_col), "spans").withColumnsRenamed({"doc": "of_doc", "hash": "of_hash"})
    has_spans = among(spans.select(F.xxhash64("of_doc", "of_hash").alias("key")), "key")(F.xxhash64("doc", "hash"))
    met = keyed.where(has_spans).join(spans, F.col("doc").eqNullSafe(F.col("of_doc")) & (F.col("hash") == F.col("of_hash")), "left").select("row", "text", "spans")
    rest = keyed.where(~has_spans).select("row", "text", F.lit(None).cast(spans.schema["spans"].dataType).alias("spans"))
    out = _clean(rest).unionByName(_clean(met))
    if repeated is None:
        return out
    all_windows = _in_windows(F.col("text"), lambda x, k: F.struct(x[k]["i"].alias("first"), x[k + SPAN - 1]["i"].alias("last")))
    return out.unionByName(_clean(repeated.select("row", "text", all_windows.alias("spans"))))


def op5(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = line_dedup(table(spark, sf_dir, "documents"))
    return out.select("row.doc_id", "n_lines", "n_removed", F.col("clean").alias("text"))


def stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """docs with cleaned texts; rows that lost their last word go."""
    out = line_dedup(docs)
    new = {"text": F.col("clean"), "n_chars": F.char_length("clean").cast(docs.schema["n_chars"].dataType) if "n_chars" in docs.columns else None}
    left = out.where((F.col("n_removed") == 0) | (stripped(F.col("clean")) != ""))
    return left.select(*(F.when(F.col("n_removed") > 0, new[c]).otherwise(F.col("row")[c]).alias(c) if new.get(c) is not None else F.col("row")[c].alias(c) for c in docs.columns))


_TRIM = "trim(l, ' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13))"
OP5_SQL = f"""
WITH split AS (SELECT doc_id, string_split(coalesce(text, ''), chr(10)) AS lines FROM documents),
l AS (SELECT doc_id, unnest(lines) AS l, unnest(range(len(lines))) AS i FROM split),
t AS (SELECT doc_id, i, {_TRIM} AS t FROM l WHERE {_TRIM} <> ''),
w AS (SELECT doc_id, i AS a, lead(i, 2) OVER o AS z, t AS t0, lead(t) OVER o AS t1, lead(t, 2) OVER o AS t2 FROM t WINDOW o AS (PARTITION BY doc_id ORDER BY i)),
r AS (SELECT doc_id, a, z, row_number() OVER (PARTITION BY t0, t1, t2 ORDER BY doc_id, a) AS nth FROM w WHERE z IS NOT NULL),
g AS (SELECT DISTINCT doc_id, unnest(range(a, z + 1)) AS i FROM r WHERE nth > 1),
k AS (SELECT l.doc_id, l.i, l.l FROM l ANTI JOIN g ON l.doc_id = g.doc_id AND l.i = g.i),
c AS (SELECT doc_id, string_agg(l, chr(10) ORDER BY i) AS text, count(*) AS n FROM k GROUP BY doc_id)
SELECT s.doc_id, CAST(len(s.lines) AS BIGINT) AS n_lines, CAST(len(s.lines) - coalesce(c.n, 0) AS BIGINT) AS n_removed, coalesce(c.text, '') AS text
FROM split s LEFT JOIN c ON s.doc_id = c.doc_id
"""
