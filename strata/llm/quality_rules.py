"""Quality rules as a learned decision list (operator 10, native).

Statistics of every whole text are Spark expressions. A bounded sample of labelled rows (max_rows, those with the smallest
hashes of doc_id, rows of the held-out fold left out) teaches an ordered list of rules by sequential covering: each rule grows
a conjunction of thresholds by information gain on two thirds of the rows, is pruned on the other third, and what it covers
is taken out before the next. The list is emitted as one ordered conditional expression, so the verdict on all rows runs in
the JVM. Only the features of the sample reach the driver, one row an id: of rows that share an id, the one of the smallest features teaches.

Defined results. Null or empty text has no words: all counts are 0, base_failed is true, kept is false. Without labelled rows of
both kinds the list is empty and keeps whatever the base rules keep. Repeated rows are judged each on its own, an empty table gives no rows, very long texts
are counted whole, and the input's columns travel in a struct, whatever their names.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from strata.llm.common import BLANKS, col, is_held_out, let, stripped, table, text_of, without, words

SYMBOLS = "#*$%&|<>"
STATS = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "n_upper", "n_marks")
FEATURES = ("mean_word", "symbol_share", "dup_lines_share", "repeat_share", "upper_share", "mark_share")


def _repeat_words(w: Column) -> Column:
    """Words in three-word windows that stand twice or more. Linear with one sort; windows are compared by 64-bit hash."""
    windows = F.transform(F.sequence(F.lit(0), F.size(w) - 3), lambda i: F.xxhash64(w[i], w[i + 1], w[i + 2]))

    def cover(at: Column) -> Column:
        steps = F.transform(at, lambda p, j: F.when(j + 1 < F.size(at), F.least(F.lit(3), at[j + 1] - p)).otherwise(3))
        return F.aggregate(steps, F.lit(0), lambda x, y: x + y)

    def among(pairs: Column) -> Column:
        again = lambda p, j: ((j > 0) & (pairs[F.greatest(j - 1, F.lit(0))]["h"] == p["h"])) | ((j + 1 < F.size(pairs)) & (pairs[F.least(j + 1, F.size(pairs) - 1)]["h"] == p["h"]))
        return let(F.array_sort(F.transform(F.filter(pairs, again), lambda p: p["i"])), cover)

    def count(h: Column) -> Column:
        pairs = F.array_sort(F.transform(h, lambda x, i: F.struct(x.alias("h"), i.alias("i"))))
        return F.when(F.size(F.array_distinct(h)) == F.size(h), 0).otherwise(let(pairs, among))

    return F.when(F.size(w) < 4, 0).otherwise(let(windows, count))


def with_statistics(docs: DataFrame, text_col: str = "text") -> DataFrame:
    """One row for each of docs: row (its columns) and the statistics of its text."""
    text = text_of(text_col)
    lines = F.filter(F.split(text, "\n"), lambda x: stripped(x) != "")
    both = let(words(text), lambda w: F.struct(F.size(w).cast("long").alias("n"), _repeat_words(w).cast("long").alias("r")))
    gone = lambda chars: F.char_length(text) - F.char_length(without(text, chars))
    out = docs.select(
        F.struct(*(col(c) for c in docs.columns)).alias("row"),
        both.alias("both"),
        F.char_length(without(text, BLANKS)).cast("long").alias("word_chars"),
        gone(SYMBOLS).cast("long").alias("n_symbols"),
        let(lines, lambda x: F.size(x) - F.size(F.array_distinct(x))).cast("long").alias("n_dup_lines"),
        F.regexp_count(text, F.lit("\\p{Lu}")).cast("long").alias("n_upper"),
        gone("!?").cast("long").alias("n_marks"),
    )
    counts = {"n_words": F.col("both.n"), "n_repeat_words": F.col("both.r")}
    return out.select("row", *(counts.get(c, F.col(c)).alias(c) for c in STATS))


def features() -> dict[str, Column]:
    per = lambda a, b: F.when(F.col(b) > 0, F.col(a) / F.col(b)).otherwise(0.0)
    return {
        "mean_word": per("word_chars", "n_words"), "symbol_share": per("n_symbols", "word_chars"), "dup_lines_share": per("n_dup_lines", "n_words"),
        "repeat_share": per("n_repeat_words", "n_words"), "upper_share": per("n_upper", "word_chars"), "mark_share": per("n_marks", "n_words"),
    }


@dataclass(frozen=True)
class Rule:
    """Rejects where every condition holds: (feature, +1 for >= or -1 for <=, threshold)."""

    conditions: tuple[tuple[str, int, float], ...]

    def mask(self, x: dict[str, np.ndarray]) -> np.ndarray:
        out = np.ones(len(next(iter(x.values()))), bool)
        for name, sign, at in self.conditions:
            out &= (x[name] >= at) if sign > 0 else (x[name] <= at)
        return out

    def column(self, by: dict[str, Column]) -> Column:
        out = F.lit(True)
        for name, sign, at in self.conditions:
            out = out & ((by[name] >= at) if sign > 0 else (by[name] <= at))
        return out


def _cuts(v: np.ndarray, most: int = 64) -> np.ndarray:
    u = np.unique(v)
    mid = (u[1:] + u[:-1]) / 2
    return mid if len(mid) <= most else np.unique(np.quantile(v, np.linspace(0, 1, most + 2)[1:-1]))


def _grow(x: dict[str, np.ndarray], bad: np.ndarray, most: int) -> list[tuple[str, int, float]]:
    """Adds the condition of the largest FOIL gain until no good row is covered."""
    conditions: list[tuple[str, int, float]] = []
    inside = np.ones(len(bad), bool)
    while len(conditions) < most and (~bad & inside).any():
        p0, n0 = (bad & inside).sum(), (~bad & inside).sum()
        best, gain = None, 1e-9
        for name, v in x.items():
            for at in _cuts(v[inside]):
                for sign in (1, -1):
                    hit = inside & ((v >= at) if sign > 0 else (v <= at))
                    p, n = (bad & hit).sum(), (~bad & hit).sum()
                    if p and (g := p * (np.log2(p / (p + n)) - np.log2(p0 / (p0 + n0)))) > gain:
                        best, gain = (name, sign, float(at)), g
        if best is None:
            break
        conditions.append(best)
        inside &= (x[best[0]] >= best[2]) if best[1] > 0 else (x[best[0]] <= best[2])
    return conditions


def learn(x: dict[str, np.ndarray], bad: np.ndarray, max_rules: int = 12, max_conditions: int = 3, min_precision: float = 0.95, min_cover: int = 3, seed: int = 7) -> list[Rule]:
    rules: list[Rule] = []
    left = np.ones(len(bad), bool)
    fold = np.random.default_rng(seed).permutation(len(bad)) % 3
    while len(rules) < max_rules and (bad & left).any() and (~bad & left).any():
        grow, prune = left & (fold != 2), left & (fold == 2)
        conditions = _grow({k: v[grow] for k, v in x.items()}, bad[grow], max_conditions)
        if not conditions:
            break

        def worth(c: list, rows: np.ndarray = prune) -> float:
            hit = Rule(tuple(c)).mask(x) & rows
            p, n = (bad & hit).sum(), (~bad & hit).sum()
            return (p - n) / (p + n) if p + n else -1.0

        best = max((conditions[:k] for k in range(len(conditions), 0, -1)), key=worth)
        rule = Rule(tuple(best))
        hit = rule.mask(x) & left
        p, n = int((bad & hit).sum()), int((~bad & hit).sum())
        if p < min_cover or p < min_precision * (p + n) or worth(best) < 2 * min_precision - 1:
            break
        rules.append(rule)
        left &= ~hit
    return rules


def verdict(rules: list[Rule]) -> Column:
    """The ordered conditional expression: the first rule that holds rejects, else the row is kept."""
    by, out = features(), F.lit(True)
    for rule in reversed(rules):
        out = F.when(rule.column(by), F.lit(False)).otherwise(out)
    return out


def labelled_sample(docs: DataFrame, labels: DataFrame, label: str, max_rows: int, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Texts and labels of at most max_rows labelled rows outside the held-out fold. The ids are bounded, so they are broadcast."""
    marked = labels.where(col(label).isNotNull() & col(id_col).isNotNull() & ~is_held_out(col(id_col)))
    ids = marked.groupBy(col(id_col).cast("long").alias("id")).agg(F.max(col(label).cast("int")).alias("label")).orderBy(F.xxhash64("id"), "id").limit(max_rows)
    chosen = docs.sparkSession.createDataFrame([(int(r[0]), int(r[1])) for r in ids.collect()], "id long, label int")
    return docs.select(col(id_col).cast("long").alias("id"), text_of(text_col).alias("text")).join(F.broadcast(chosen), "id")


def fit(docs: DataFrame, labels: DataFrame, label: str = "quality", max_rows: int = 20000, id_col: str = "doc_id", text_col: str = "text", **options) -> list[Rule]:
    sample = labelled_sample(docs, labels, label, max_rows, id_col, text_col)
    rows = with_statistics(sample).select("row.id", "row.label", F.struct(*(c.alias(k) for k, c in features().items())).alias("x"))
    one = rows.groupBy("id", "label").agg(F.min("x").alias("x"))  # max_rows rows, however often an id stands in docs
    seen = one.select("id", "label", "x.*").toPandas().sort_values(list(FEATURES) + ["id"], kind="stable")
    if seen["label"].nunique() < 2:
        return []
    return learn({k: seen[k].to_numpy(float) for k in FEATURES}, seen["label"].to_numpy() == 0, **options)


def quality_rules(docs: DataFrame, rules: list[Rule], text_col: str = "text", min_words: int = 50, max_repeat: int = 50) -> DataFrame:
    """One row for each of docs: row (its columns), the statistics, base_failed and kept."""
    failed = (F.col("n_words") < min_words) | (100 * F.col("n_repeat_words") > max_repeat * F.col("n_words"))
    return with_statistics(docs, text_col).withColumn("base_failed", failed).withColumn("kept", ~F.col("base_failed") & verdict(rules))


def op10(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    judged = quality_rules(docs, fit(docs, table(spark, sf_dir, "labels")))
    return judged.select("row.doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept")


def stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Only what the rules keep, with the input's columns. Null and empty texts go (they have fewer words than the base rules ask); repeated rows stay or go together."""
    return quality_rules(docs, fit(docs, table(spark, sf_dir, "labels"))).where("kept").select("row.*")
