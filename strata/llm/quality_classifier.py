"""Quality classifier: a factorisation machine over hashed words, structure statistics and metadata (operator 1).

Every whole text gives a sparse vector: words hashed to 2^16 places (logarithm of the count, scaled to length one), and dense
places for statistics of structure and for the metadata column n_chars. The pairwise term is computed in linear time:
half the sum over factors of (sum of v x)^2 - sum of (v x)^2. Labels, lang, source and doc_id are not read for a score.

The model is fitted on at most max_rows labelled rows (the smallest hashes of doc_id, rows of the held-out fold left out): only
their vectors reach the driver, one an id (of rows that share an id, the one of the smallest text hash teaches) and of 2^16 places at most.
The broadcast model has a fixed size, (2^16 + 15) * (1 + factors) numbers. Scoring is one pass, no shuffle.

Defined results. Null text counts as empty and has a score too; null or missing n_chars is a statistic of its own. Without labels of
both kinds every score is the share of label 1 among those there are, or one half. Repeated rows get equal scores, an empty table gives no rows, very long
texts are read whole, and given columns named score get an underscore.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from strata.llm.arrow import per_text, raw, settled, slices, texts, word_hashes
from strata.llm.common import col, is_held_out, named_apart, row_hash, table, text_of, with_row
from strata.runtime import ship

PLACES = 1 << 16
STATISTICS = ("words", "word_bytes", "upper", "digits", "punctuation", "symbols", "marks", "non_ascii", "lines", "distinct", "stutter", "n_chars", "no_n_chars", "n_chars_off", "one")
DENSE = len(STATISTICS)


def _classes() -> dict[str, np.ndarray]:
    out = {k: np.zeros(256, bool) for k in ("upper", "digits", "punctuation", "symbols", "marks", "non_ascii", "lines")}
    out["upper"][65:91] = True
    out["digits"][48:58] = True
    out["punctuation"][[*range(33, 48), *range(58, 65), *range(91, 97), *range(123, 127)]] = True
    out["symbols"][list(b"#*$%&|<>")] = True
    out["marks"][list(b"!?")] = True
    out["non_ascii"][128:] = True
    out["lines"][10] = True
    return out


_CLASSES = _classes()


def vectors(column: pa.Array, n_chars: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Of each text: where its words' places begin (and the last ends), the places, their values, and the statistics. n_chars: NaN where unknown."""
    data, bounds = raw(column)
    starts, _, hashes = word_hashes(data, bounds)
    at = per_text(starts, bounds)
    counts = np.diff(at)
    of = np.repeat(np.arange(len(counts)), counts)
    keys, times = np.unique(of.astype(np.int64) << 16 | (hashes >> np.uint64(48)).astype(np.int64), return_counts=True)
    doc, place = keys >> 16, (keys & 0xFFFF).astype(np.int32)
    value = np.log1p(times.astype(np.float32))
    norm = np.sqrt(np.bincount(doc, value * value, len(counts)))
    value = (value / norm[doc]).astype(np.float32)
    begin = np.searchsorted(doc, np.arange(len(counts) + 1))
    words, size = np.maximum(counts, 1), np.maximum(np.diff(bounds), 1)
    share = {}
    for name, inside in _CLASSES.items():
        sums = np.concatenate(([0], np.cumsum(inside[data])))
        share[name] = (sums[bounds[1:]] - sums[bounds[:-1]]) / size
    blank_or_not = np.concatenate(([0], np.cumsum((data & 0xC0) != 0x80)))
    chars = blank_or_not[bounds[1:]] - blank_or_not[bounds[:-1]]
    again = (hashes[1:] == hashes[:-1]) & (of[1:] == of[:-1]) if len(hashes) else np.empty(0, bool)
    known = ~np.isnan(n_chars)
    given = np.where(known, n_chars, 0.0)
    share |= {
        "words": np.log1p(counts), "word_bytes": np.minimum(size / words, 40.0), "distinct": np.diff(begin) / words, "stutter": np.bincount(of[1:][again], minlength=len(counts)) / words,
        "n_chars": np.log1p(np.maximum(given, 0)), "no_n_chars": (~known).astype(float), "n_chars_off": (known & (given != chars)).astype(float), "one": np.ones(len(counts)),
    }
    return begin, place, value, np.stack([share[k] for k in STATISTICS], 1).astype(np.float32)


@dataclass
class Model:
    bias: float
    weights: np.ndarray
    factors: np.ndarray
    mean: np.ndarray
    spread: np.ndarray

    def dense(self, statistics: np.ndarray) -> np.ndarray:
        return np.clip((statistics - self.mean) / self.spread, -4, 4).astype(np.float32)

    def score(self, begin: np.ndarray, place: np.ndarray, value: np.ndarray, statistics: np.ndarray) -> np.ndarray:
        return 1 / (1 + np.exp(-np.clip(self.raw(begin, place, value, self.dense(statistics))[0], -60, 60)))

    def raw(self, begin: np.ndarray, place: np.ndarray, value: np.ndarray, dense: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The machine's output, and the sum of v x of each factor."""
        w, v = self.weights, self.factors
        x = value[:, None]
        vx = v[place] * x
        sums = _sum_rows(vx, begin) + dense @ v[PLACES:]
        squares = _sum_rows(vx * vx, begin) + (dense * dense) @ (v[PLACES:] ** 2)
        linear = _sum_rows(w[place][:, None] * x, begin)[:, 0] + dense @ w[PLACES:]
        return self.bias + linear + 0.5 * (sums * sums - squares).sum(1), sums


def _sum_rows(x: np.ndarray, begin: np.ndarray) -> np.ndarray:
    out = np.zeros((len(begin) - 1, x.shape[1]), np.float64)
    full = np.flatnonzero(np.diff(begin))
    if len(full):
        out[full] = np.add.reduceat(x, begin[full], axis=0)
    return out


def train(begin: np.ndarray, place: np.ndarray, value: np.ndarray, statistics: np.ndarray, label: np.ndarray, factors: int = 4, epochs: int = 40, rate: float = 0.05, decay: float = 1e-5, seed: int = 11) -> Model:
    """Logistic loss, Adam over all rows at once; deterministic."""
    share = float(label.mean()) if len(label) else 0.5
    size = PLACES + DENSE
    model = Model(0.0, np.zeros(size, np.float32), np.zeros((size, factors), np.float32), np.zeros(DENSE, np.float32), np.ones(DENSE, np.float32))
    if len(np.unique(label)) < 2:
        model.bias = float(np.log(max(share, 1e-9) / max(1 - share, 1e-9))) if len(label) else 0.0
        return model
    model.mean, model.spread = statistics.mean(0), np.maximum(statistics.std(0), 1e-6)
    model.mean[-1], model.spread[-1] = 0, 1
    model.factors = np.random.default_rng(seed).normal(0, 0.02, (size, factors)).astype(np.float32)
    model.bias = float(np.log(share / (1 - share)))
    dense = model.dense(statistics)
    of = np.repeat(np.arange(len(label)), np.diff(begin))
    params = [model.weights, model.factors]
    first, second = [np.zeros_like(p) for p in params], [np.zeros_like(p) for p in params]
    for step in range(1, epochs + 1):
        out, sums = model.raw(begin, place, value, dense)
        error = (1 / (1 + np.exp(-np.clip(out, -60, 60))) - label) / len(label)
        e = error[of] * value
        grad_w = np.concatenate((np.bincount(place, e, PLACES), dense.T @ error)) + decay * model.weights
        grad_v = np.empty((size, factors))
        quad = np.concatenate((np.bincount(place, e * value, PLACES), (dense * dense).T @ error))
        for f in range(factors):
            grad_v[:, f] = np.concatenate((np.bincount(place, e * sums[of, f], PLACES), dense.T @ (error * sums[:, f]))) - quad * model.factors[:, f]
        grad_v += decay * model.factors
        model.bias -= rate * float(error.sum())
        for p, g, m1, m2 in zip(params, (grad_w, grad_v), first, second, strict=True):
            m1 += 0.1 * (g - m1)
            m2 += 0.001 * (g * g - m2)
            p -= (rate * (m1 / (1 - 0.9**step)) / (np.sqrt(m2 / (1 - 0.999**step)) + 1e-8)).astype(np.float32)
    return model


def _with_n_chars(docs: DataFrame) -> F.Column:
    return col("n_chars").cast("double") if "n_chars" in docs.columns else F.lit(None).cast("double")


def _numbers(batch: pa.RecordBatch, name: str) -> np.ndarray:
    return batch.column(batch.schema.get_field_index(name)).to_numpy(zero_copy_only=False).astype(float)


def fit(docs: DataFrame, labels: DataFrame, label: str = "quality", max_rows: int = 8000, id_col: str = "doc_id", text_col: str = "text", **options) -> Model:
    ship(docs.sparkSession)
    marked = labels.where(col(label).isNotNull() & col(id_col).isNotNull() & ~is_held_out(col(id_col)))
    ids = marked.groupBy(col(id_col).cast("long").alias("id")).agg(F.max(col(label).cast("int")).alias("label")).orderBy(F.xxhash64("id"), "id").limit(max_rows).collect()
    chosen = docs.sparkSession.createDataFrame([(int(r[0]), int(r[1])) for r in ids], "id long, label int")  # bounded by max_rows
    rows = docs.select(col(id_col).cast("long").alias("id"), text_of(text_col).alias("text"), _with_n_chars(docs).alias("n_chars")).join(F.broadcast(chosen), "id")
    rows = rows.groupBy("id", "label").agg(F.min(F.struct(row_hash(F.col("text")).alias("hash"), "text", "n_chars")).alias("x")).select("id", "label", "x.text", "x.n_chars")

    @settled
    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            column, given = texts(batch), _numbers(batch, "n_chars")
            ids_, marks = batch.column(batch.schema.get_field_index("id")), batch.column(batch.schema.get_field_index("label"))
            for a, b in slices(column):
                begin, place, value, statistics = vectors(column.slice(a, b - a), given[a:b])
                lists = [pa.LargeListArray.from_arrays(pa.array(begin), pa.array(x)).cast(pa.list_(t)) for x, t in ((place, pa.int32()), (value, pa.float32()))]
                dense = pa.FixedSizeListArray.from_arrays(pa.array(statistics.ravel()), DENSE).cast(pa.list_(pa.float32()))
                yield pa.RecordBatch.from_arrays([ids_.slice(a, b - a), marks.slice(a, b - a), *lists, dense], ["id", "label", "place", "value", "statistics"])

    got = rows.mapInArrow(work, "id long, label int, place array<int>, value array<float>, statistics array<float>").toArrow()
    got = got.sort_by([("id", "ascending")]).combine_chunks()
    if not got.num_rows:
        return train(np.zeros(1, np.int64), np.empty(0, np.int32), np.empty(0, np.float32), np.empty((0, DENSE), np.float32), np.empty(0))
    begin = np.concatenate(([0], np.cumsum([len(x) for x in got["place"]])))
    flat = lambda name: got[name].combine_chunks().flatten().to_numpy(zero_copy_only=False)
    return train(begin, flat("place"), flat("value"), flat("statistics").reshape(-1, DENSE), got["label"].to_numpy().astype(float), **options)


def score(docs: DataFrame, model: Model, columns: tuple[str, ...] = ("doc_id",), text_col: str = "text") -> DataFrame:
    """The given columns and score."""
    ship(docs.sparkSession)
    shared = docs.sparkSession.sparkContext.broadcast(model)
    packed = docs.select(F.struct(*(col(c) for c in columns)).alias("row"), text_of(text_col).alias("text"), _with_n_chars(docs).alias("n_chars"))

    @settled
    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            column, given = texts(batch), _numbers(batch, "n_chars")
            for a, b in slices(column):
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(a, b - a), pa.array(shared.value.score(*vectors(column.slice(a, b - a), given[a:b])))], ["row", "score"])

    return packed.mapInArrow(work, with_row(packed, "score double")).select(*named_apart("row", columns, ("score",)))


def op1(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    scored = score(docs, fit(docs, table(spark, sf_dir, "labels")))
    return scored.select("doc_id", is_held_out(F.col("doc_id")).alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))
