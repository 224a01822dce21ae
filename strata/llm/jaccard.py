"""N-gram Jaccard join with adaptive multi-match prefixes (operator 7).

A document's set are its distinct five-word shingles, each known by 46 bits of a 64-bit hash. Documents of equal sets are one class,
known by a 64-bit digest of the set; a second digest finds digests that stand for two sets, and tells those apart. Every shingle travels once to the task that counts its classes. Shingles of a single
class can link nothing; the others go back to their classes with their frequency. There the order is: shingles of one class first,
then by rising frequency. A pair of at least the wanted similarity shares m shingles among the first n - ceil(t n) + m of each, for
any m; each class takes the m for which the estimated cost (postings to read and candidates to verify) is least, and a pair
must share as many prefix shingles as the smaller of its two m before it is verified.

Candidates come in three rounds. In the first two, the members of a shingle's list are held only against one of them, first
the one whose shingles are most frequent, then one picked by hash; what is linked becomes one component. The third takes all remaining pairs of a list whose members are in
different components, if their sizes, the places of the shingle and 512-bit sketches allow it, so no link between components is lost, while a group of copies never gives all its pairs.
Pairs are verified on 46-bit fingerprints. Where one wrong match or a lost fingerprint would change the verdict, the pair is verified again on 64 bits of its texts' shingles.

Defined results. Null text counts as empty: an empty set, linked with nothing. Null doc_id can be in a component, but is never its name
unless no member has another. Rows with equal doc_id are linked by their texts like others. An empty table gives no rows. Very long texts are read whole; further columns are not read.

Skew and size: copies are collapsed within each slice and again where shingles meet. Blobs of arrays, not rows, are shuffled, to exactly
one key a partition, and sorted there (Spark spills) by cells of some CELL pairs, sized from the counted shingles: a task holds one cell at a time. Shingles that
stand often in slices are found in a first pass and never gathered: a list of them (bounded by the mean set size times SHARE) is broadcast, and they
go straight to their classes. A list is never crossed with itself except between components, and then in blocks.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from strata.llm.arrow import _mix, grams, per_text, raw, settle, settled, slices, texts, word_hashes
from strata.llm.common import among, col, first_of_equal, materialise, row_hash, table, text_of
from strata.llm.components import components
from strata.runtime import ship

SHINGLE, PERCENT, BITS, LEAST_PARTS, MOST_MATCHES, VERIFY_COST, SKETCH = 5, 75, 46, 64, 8, 4.0, 512
#: Pairs of class and shingle that a task holds at once; classes of a list that are held against all others in one block.
CELL, BLOCK = 4 << 20, 4096
#: A shingle is frequent from this part of the documents on; a slice reports what OFTEN of its classes have, or twice that part of them.
SHARE, OFTEN = 1000, 8
HEAD = np.dtype([("d", "<u8"), ("n", "<u4"), ("c", "<u4"), ("k", "<u4")])
ENTRY = np.dtype([("d", "<u8"), ("n", "<u4"), ("c", "<u4"), ("df", "<u4"), ("lo", "<u4"), ("hi", "<u2")])


def _text_grams(column: pa.Array, size: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Number of words, and all (text, 64-bit shingle) pairs, repeats included; shorter texts are one shingle."""
    data, bounds = raw(column)
    starts, _, hashes = word_hashes(data, bounds)
    at = per_text(starts, bounds)
    counts = np.diff(at)
    of = np.repeat(np.arange(len(counts)), counts)
    all_grams = grams(hashes, size)
    inside = of[: len(all_grams)] == of[size - 1 :] if len(all_grams) else np.empty(0, bool)
    doc, gram = of[: len(all_grams)][inside], all_grams[inside]
    first = np.concatenate(([0], np.cumsum(np.maximum(counts - size + 1, 0))))
    few = np.flatnonzero((counts > 0) & (counts < size))
    if len(few):
        whole = [_mix(grams(hashes[at[i] : at[i + 1]], int(counts[i])) ^ np.uint64(0xA5A5A5A5 + int(counts[i])))[0] for i in few]
        doc, gram = np.concatenate((doc, few)), np.concatenate((gram, np.array(whole, np.uint64)))
    return counts, first, doc, gram


def _sets(column: pa.Array, size: int, twins: np.ndarray | None = None) -> tuple[np.ndarray, ...]:
    """Of each text: class, second digest, set size and fingerprints lost to equal bits; and all (text, fingerprint) pairs, sorted. twins: digests that name no class."""
    counts, first, doc, gram = _text_grams(column, size)
    short = gram >> np.uint64(64 - BITS)
    pairs = np.sort(doc.astype(np.uint64) << np.uint64(BITS) | short)
    fresh = np.ones(len(pairs), bool)
    fresh[1:] = pairs[1:] != pairs[:-1]
    repeated = np.unique((pairs[~fresh] >> np.uint64(BITS)).astype(np.int64))
    pairs = pairs[fresh]
    doc = (pairs >> np.uint64(BITS)).astype(np.int64)
    tok = pairs & np.uint64((1 << BITS) - 1)
    m = np.bincount(doc, minlength=len(counts)).astype(np.int64)
    n = m.copy()
    for i in repeated.tolist():
        if counts[i] >= size:
            n[i] = len(np.unique(gram[first[i] : first[i + 1]]))
    ends = np.cumsum(m)
    with np.errstate(over="ignore"):
        digests = []
        for factor, add, by in ((0xC2B2AE3D27D4EB4F, 1, 0x9FB21C651E98DF25), (0x165667B19E3779F9, 0x27D4EB2F165667C5, 0xD6E8FEB86659FD93)):
            sums = np.concatenate((np.zeros(1, np.uint64), np.cumsum(_mix(tok * np.uint64(factor) + np.uint64(add)), dtype=np.uint64)))
            digests.append(_mix((sums[ends] - sums[ends - m]) + n.astype(np.uint64) * np.uint64(by)))
    digest, check = digests
    if twins is not None and len(twins):
        digest = np.where(np.isin(digest, twins), check, digest)
    return digest, check, n, n - m, doc, tok


def _first_of_each(digest: np.ndarray) -> np.ndarray:
    _, chosen = np.unique(digest, return_index=True)
    first = np.zeros(len(digest), bool)
    first[chosen] = True
    return first


def members(docs: DataFrame, size: int = SHINGLE, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row for each of docs: doc_id, hash (of the text), n_shingles, class (null for the empty set) and check, a second digest of the set. Rows with toks are no documents: they count shingles
    that stand often in a slice."""

    @settled
    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            column = texts(batch)
            for a, b in slices(column):
                digest, check, n, _, doc, tok = _sets(column.slice(a, b - a), size)
                classes = [pa.array(x.view(np.int64), mask=n == 0) for x in (digest, check)]
                nothing = pa.nulls(b - a, pa.list_(pa.int64()))
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(a, b - a), batch.column(1).slice(a, b - a), pa.array(n), *classes, nothing, nothing], names)
                first = _first_of_each(digest)
                toks, times = np.unique(tok[first[doc]], return_counts=True)
                often = times >= max(OFTEN, 2 * int(first.sum()) // SHARE)
                if often.any():
                    lists = [pa.array([x[often].astype(np.int64)], pa.list_(pa.int64())) for x in (toks, times)]
                    yield pa.RecordBatch.from_arrays([*(pa.nulls(1, pa.int64()) for _ in range(5)), *lists], names)

    names = ["doc_id", "hash", "n_shingles", "class", "check", "toks", "times"]
    rows = docs.select(col(id_col).cast("long").alias("doc_id"), row_hash(text_of(text_col)).alias("hash"), text_of(text_col).alias("text"))
    return rows.mapInArrow(work, "doc_id long, hash long, n_shingles long, class long, check long, toks array<long>, times array<long>")


def frequent(rows: DataFrame, share: int = SHARE) -> tuple[np.ndarray, np.ndarray]:
    """Shingles that slices report for a part of the documents or more, and how often they do: share times the mean set size at most.

    A shingle that isn't named is counted like any other, so results don't depend on it. Its frequency only has to be the same for all its classes.
    """
    n = rows.where("toks is null").count()
    pairs = rows.where("toks is not null").select(F.explode(F.arrays_zip("toks", "times")).alias("x")).groupBy(F.col("x.toks").alias("tok")).agg(F.sum("x.times").alias("times"))
    found = pairs.where(F.col("times") >= max(64, n // share)).orderBy("tok").toPandas()
    return found["tok"].to_numpy(np.uint64), found["times"].to_numpy(np.int64)


def partition_keys(spark: SparkSession, parts: int) -> list[int]:
    """For each partition a number that repartition(parts, number) deals to it, and to no other."""
    for many in (32, 128, 512):
        rows = spark.range(0, parts * many, numPartitions=1).groupBy(F.pmod(F.hash("id"), F.lit(parts)).alias("p")).agg(F.min("id").alias("k")).collect()
        if len(rows) == parts:
            return [r["k"] for r in sorted(rows, key=lambda r: r["p"])]
    raise RuntimeError("no key for some partition")


def _cells(many: np.ndarray, cells: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The order by cell, the cells that there are, and where each begins (and the last ends) in that order."""
    cell = (many % np.uint64(cells)).astype(np.int64)
    order = np.argsort(cell, kind="stable")
    here, start = np.unique(cell[order], return_index=True)
    return order, here, np.append(start, len(cell))


def _entries(d: np.ndarray, n: np.ndarray, lost: np.ndarray, df: np.ndarray, tok: np.ndarray, keys: list[int], cells: int) -> tuple[list[int], list[int], list[bytes]]:
    """ENTRY records of (class, shingle) pairs, in blobs by the partition and cell of the class."""
    entry = np.empty(len(d), ENTRY)
    entry["d"], entry["n"], entry["c"], entry["df"] = d, n, lost, df
    entry["lo"], entry["hi"] = tok & np.uint64(0xFFFFFFFF), tok >> np.uint64(32)
    order, here, cut = _cells(d, cells)
    entry = entry[order]
    return [keys[x % len(keys)] for x in here.tolist()], [x // len(keys) for x in here.tolist()], [entry[cut[i] : cut[i + 1]].tobytes() for i in range(len(here))]


def _batch(names: list[str], to: list[int], sub: list[int], *blobs: list[bytes]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(to, pa.int64()), pa.array(sub, pa.int64()), *(pa.array(b, pa.binary()) for b in blobs)], names)


def _spread(docs: DataFrame, keys: list[int], cells: int, size: int, text_col: str, hot: tuple[np.ndarray, np.ndarray], twins: np.ndarray) -> DataFrame:
    """to and sub (partition and cell), head (HEAD records) and body (quotients of fingerprints by the number of cells: 4 and 1 bytes).

    Frequent shingles don't meet in one task: they go straight to their classes, as rows of an empty head and ENTRY records.
    """
    shared = docs.sparkSession.sparkContext.broadcast((*hot, twins))
    names = ["to", "sub", "head", "body"]

    @settled
    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        often, times, twins_ = shared.value
        for batch in batches:
            column = texts(batch)
            for a, b in slices(column):
                digest, _, n, lost, doc, tok = _sets(column.slice(a, b - a), size, twins_)
                first = _first_of_each(digest)
                doc, tok = doc[first[doc]], tok[first[doc]]
                if len(often) and len(tok):
                    at = np.minimum(np.searchsorted(often, tok), len(often) - 1)
                    hit = often[at] == tok
                    if hit.any():
                        d = doc[hit]
                        to, sub, blobs = _entries(digest[d], n[d], lost[d], times[at[hit]], tok[hit], keys, cells)
                        yield _batch(names, to, sub, [b""] * len(to), blobs)
                        doc, tok = doc[~hit], tok[~hit]
                if not len(doc):
                    continue
                order, here, rows = _cells(tok, cells)
                cell, doc, q = (tok[order] % np.uint64(cells)).astype(np.int64), doc[order], tok[order] // np.uint64(cells)
                new = np.ones(len(cell), bool)
                new[1:] = (cell[1:] != cell[:-1]) | (doc[1:] != doc[:-1])
                at = np.flatnonzero(new)
                head = np.empty(len(at), HEAD)
                head["d"], head["n"], head["c"], head["k"] = digest[doc[at]], n[doc[at]], lost[doc[at]], np.diff(np.append(at, len(cell)))
                low, high = (q & np.uint64(0xFFFFFFFF)).astype("<u4"), (q >> np.uint64(32)).astype(np.uint8)
                cut = np.append(np.searchsorted(cell[at], here), len(at))
                heads = [head[cut[i] : cut[i + 1]].tobytes() for i in range(len(here))]
                bodies = [low[rows[i] : rows[i + 1]].tobytes() + high[rows[i] : rows[i + 1]].tobytes() for i in range(len(here))]
                yield _batch(names, [keys[x % len(keys)] for x in here.tolist()], [x // len(keys) for x in here.tolist()], heads, bodies)
            settle()

    return docs.select(text_of(text_col).alias("text")).mapInArrow(work, "to long, sub long, head binary, body binary")


def _gathered(rows: DataFrame, parts: int) -> DataFrame:
    """Blobs in their partitions, cell after cell. Spark sorts them and spills where they don't fit."""
    return rows.repartition(parts, "to").sortWithinPartitions("to", "sub")


def _by_cell(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[int, int, list[tuple[bytes, ...]]]]:
    """Partition key, cell and blobs of one cell after the other; no more than a cell is held."""
    at, blobs = None, []
    for batch in batches:
        for to, sub, *blob in zip(*(c.to_pylist() for c in batch.columns), strict=True):
            if at != (to, sub):
                if blobs:
                    yield *at, blobs
                at, blobs = (to, sub), []
            blobs.append(tuple(blob))
    if blobs:
        yield *at, blobs


def _shared(spread: DataFrame, keys: list[int], cells: int) -> DataFrame:
    """to, sub and entries (ENTRY records) of fingerprints that two classes or more have."""
    which = {k: p for p, k in enumerate(keys)}
    names = ["to", "sub", "entries"]

    @settled
    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for to, sub, blobs in _by_cell(batches):
            ready = [body for head, body in blobs if not head]
            for a in range(0, len(ready), 64):
                part = ready[a : a + 64]
                yield _batch(names, [to] * len(part), [sub] * len(part), part)
            blobs = [x for x in blobs if x[0]]
            if not blobs:
                continue
            head = np.concatenate([np.frombuffer(h, HEAD) for h, _ in blobs])
            q = np.empty(int(head["k"].sum()), np.uint64)
            done = 0
            for _, body in blobs:
                n = len(body) // 5
                q[done : done + n] = np.frombuffer(body, "<u4", n).astype(np.uint64) | np.frombuffer(body, np.uint8, n, 4 * n).astype(np.uint64) << np.uint64(32)
                done += n
            of = np.repeat(np.arange(len(head), dtype=np.int32), head["k"])
            order = np.argsort(q)
            q, of = q[order], of[order]
            same = q[1:] == q[:-1]
            again = np.zeros(len(q), bool)
            again[1:] |= same
            again[:-1] |= same
            q, of = q[again], of[again]
            d = head["d"][of]
            order = np.lexsort((d, q))
            q, of, d = q[order], of[order], d[order]
            fresh = np.ones(len(q), bool)
            fresh[1:] = (q[1:] != q[:-1]) | (d[1:] != d[:-1])
            q, of, d = q[fresh], of[fresh], d[fresh]
            if not len(q):
                continue
            start = np.flatnonzero(np.concatenate(([True], q[1:] != q[:-1])))
            length = np.diff(np.append(start, len(q)))
            df = np.repeat(length, length)
            q, of, d, df = q[df > 1], of[df > 1], d[df > 1], df[df > 1]
            tok = q * np.uint64(cells) + np.uint64(sub * len(keys) + which[to])
            yield _batch(names, *_entries(d, head["n"][of], head["c"][of], df, tok, keys, cells))
            settle()

    return _gathered(spread, len(keys)).mapInArrow(work, "to long, sub long, entries binary")


def _prefixes(shared: DataFrame, parts: int, percent: int) -> DataFrame:
    """Classes with candidates: d, n, lost (fingerprints lost to equal bits), s and alone (shingles shared with another class, and not), need (prefix shingles
    to share), center (mean frequency), sketch (parities of the shared shingles' hashes), toks (prefix shingles), shared (all shared shingles, sorted)."""

    @settled
    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for _, _, blobs in _by_cell(batches):
            yield from cell(np.frombuffer(b"".join(x for (x,) in blobs), ENTRY))

    def cell(e: np.ndarray) -> Iterator[pa.RecordBatch]:
        tok = e["lo"].astype(np.uint64) | e["hi"].astype(np.uint64) << np.uint64(32)
        order = np.lexsort((tok, e["df"], e["d"]))
        e, tok = e[order], tok[order]
        fresh = np.ones(len(e), bool)  # copies in several slices bring their frequent shingles several times
        fresh[1:] = (e["d"][1:] != e["d"][:-1]) | (tok[1:] != tok[:-1])
        e, tok = e[fresh], tok[fresh]
        start = np.flatnonzero(np.concatenate(([True], e["d"][1:] != e["d"][:-1])))
        s = np.diff(np.append(start, len(e)))
        n, c = e["n"][start].astype(np.int64), e["c"][start].astype(np.int64)
        least = -(-percent * n // 100)
        alone = n - c - s
        sums = np.concatenate(([0], np.cumsum(e["df"].astype(np.int64))))
        best, need, take = np.full(len(start), np.inf), np.ones(len(start), np.int64), np.zeros(len(start), np.int64)
        for m in range(1, MOST_MATCHES + 1):
            k = np.clip(n - least + m - alone, 0, s)
            postings = sums[start + k] - sums[start]
            cost = postings + VERIFY_COST * (postings - k) / m
            better = (cost < best) & (m <= np.maximum(1, least - c))
            best, need, take = np.where(better, cost, best), np.where(better, m, need), np.where(better, k, take)
        take[(n - least + 1 - alone) <= 0] = 0  # nothing shared among the first: nothing can be linked
        rows = np.flatnonzero(take)
        for some in np.array_split(rows, max(1, int(s[rows].sum() >> 20))) if len(rows) else ():
            toks = [tok[a : a + k].astype(np.int64) for a, k in zip(start[some].tolist(), take[some].tolist(), strict=True)]
            whole = [np.sort(tok[a : a + k]) for a, k in zip(start[some].tolist(), s[some].tolist(), strict=True)]
            odd = np.stack([np.bincount((x % np.uint64(SKETCH)).astype(np.int64), minlength=SKETCH) for x in whole]) & 1
            sketch = np.packbits(odd.astype(np.uint8), axis=1).view(np.int64)
            packed = [(x & np.uint64(0xFFFFFFFF)).astype("<u4").tobytes() + (x >> np.uint64(32)).astype("<u2").tobytes() for x in whole]
            yield pa.RecordBatch.from_arrays(
                [
                    pa.array(e["d"][start[some]].astype(np.uint64).view(np.int64)), pa.array(n[some]), pa.array(c[some]), pa.array(s[some]), pa.array(alone[some]), pa.array(need[some]), pa.array((sums[start + s] - sums[start])[some] / n[some]),
                    pa.array(sketch.tolist(), pa.list_(pa.int64())), pa.array(toks, pa.list_(pa.int64())), pa.array(packed, pa.binary()),
                ],
                ["d", "n", "lost", "s", "alone", "need", "center", "sketch", "toks", "shared"],
            )

    return _gathered(shared, parts).mapInArrow(work, "d long, n long, lost long, s long, alone long, need long, center double, sketch array<long>, toks array<long>, shared binary")


def _unpack(x: bytes) -> np.ndarray:
    n = len(x) // 6
    return np.frombuffer(x, "<u4", n).astype(np.uint64) | np.frombuffer(x, "<u2", n, 4 * n).astype(np.uint64) << np.uint64(32)


def _common(su: list[np.ndarray], sv: list[np.ndarray]) -> np.ndarray:
    """How many numbers each two of the sorted arrays share."""
    return np.array([len(np.intersect1d(a, b, assume_unique=True)) for a, b in zip(su, sv, strict=True)], np.int64)


def verified(pairs: DataFrame, classes: DataFrame, percent: int) -> DataFrame:
    """Of the pairs (u, v): those that are as similar as wanted, with sure; and with sure false those for which a wrong match or a lost fingerprint decides."""
    own = lambda x: classes.select(F.col("d").alias(x), F.col("n").alias("n" + x), F.col("lost").alias("l" + x), F.col("shared").alias("s" + x))
    rows = pairs.join(own("v"), "v").join(own("u"), "u").where(f"100 * least(nu, nv) >= {percent} * greatest(nu, nv)")

    @settled
    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for a in range(0, batch.num_rows, 1024):
                part = batch.slice(a, 1024)
                u, v, nu, nv, lost, su, sv = (part.column(i) for i in range(7))
                keyed = [_unpack(x) | np.uint64(i << BITS) for col_ in (su, sv) for i, x in enumerate(col_.to_pylist())]
                both = np.sort(np.concatenate(keyed))
                hit = (both[1:][both[1:] == both[:-1]] >> np.uint64(BITS)).astype(np.int64)
                same, lost = np.bincount(hit, minlength=part.num_rows), lost.to_numpy()
                union = nu.to_numpy() + nv.to_numpy() - same
                sure = 100 * (same - 1) >= percent * (union + 1)
                maybe = pa.array(sure | (100 * (same + lost) >= percent * (union - lost)))
                yield pa.RecordBatch.from_arrays([u.filter(maybe), v.filter(maybe), pa.array(sure).filter(maybe)], ["u", "v", "sure"])

    return rows.select("u", "v", "nu", "nv", F.least("lu", "lv").alias("lost"), "su", "sv").mapInArrow(work, "u long, v long, sure boolean")


def verified_again(pairs: DataFrame, docs: DataFrame, found: DataFrame, size: int, percent: int, id_col: str, text_col: str) -> DataFrame:
    """Those of the pairs (u, v) that are as similar as wanted on 64 bits a shingle: one text of each class is read again. Only these texts are shuffled."""
    wanted = pairs.select(F.col("u").alias("of")).unionByName(pairs.select(F.col("v").alias("of"))).distinct()
    one = found.join(wanted, F.col("class") == F.col("of"), "left_semi").groupBy("class").agg(F.min(F.struct("doc_id", "hash")).alias("x"))
    one = materialise(one.select("class", F.col("x.doc_id").alias("of_doc"), F.col("x.hash").alias("of_hash")), "read-again")
    rows = docs.select(col(id_col).cast("long").alias("doc"), row_hash(text_of(text_col)).alias("hash"), text_of(text_col).alias("text"))
    may = among(one.select(F.xxhash64("of_doc", "of_hash").alias("key")), "key")(F.xxhash64("doc", "hash"))
    read = rows.where(may).join(one, F.col("doc").eqNullSafe(F.col("of_doc")) & (F.col("hash") == F.col("of_hash"))).select("class", "text")

    @settled
    def shingles(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            column = texts(batch)
            for a, b in slices(column):
                counts, _, doc, gram = _text_grams(column.slice(a, b - a), size)
                order = np.argsort(doc, kind="stable")
                at = np.searchsorted(doc[order], np.arange(len(counts) + 1))
                sets = [np.unique(gram[order[at[i] : at[i + 1]]]).tobytes() for i in range(len(counts))]
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(a, b - a), pa.array(sets, pa.binary())], ["class", "full"])

    sets = read.mapInArrow(shingles, "class long, full binary")
    sets = materialise(sets.groupBy("class").agg(F.min("full").alias("full")), "full-sets")
    own = lambda x: sets.select(F.col("class").alias(x), F.col("full").alias("s" + x))

    @settled
    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            su, sv = ([np.frombuffer(x, np.uint64) for x in batch.column(i).to_pylist()] for i in (2, 3))
            same = _common(su, sv)
            union = np.array([len(a) + len(b) for a, b in zip(su, sv, strict=True)], np.int64) - same
            ok = pa.array(100 * same >= percent * union)
            yield pa.RecordBatch.from_arrays([batch.column(0).filter(ok), batch.column(1).filter(ok)], ["u", "v"])

    return pairs.join(own("v"), "v").join(own("u"), "u").select("u", "v", "su", "sv").mapInArrow(work, "u long, v long")


def _labelled(postings: DataFrame, labels: DataFrame) -> DataFrame:
    return postings.join(labels, F.col("d") == F.col("node"), "left").select("tok", "d", "n", "need", "at", F.coalesce("root", "d").alias("comp"))


def linked_classes(docs: DataFrame, found: DataFrame, hot: tuple[np.ndarray, np.ndarray], twins: np.ndarray, size: int = SHINGLE, percent: int = PERCENT, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """node and root: for each class that is linked to one of a smaller digest, the smallest of its component. found: doc_id, hash, n_shingles and class of docs."""
    spark = docs.sparkSession
    ship(spark)
    parts = max(LEAST_PARTS, int(spark.conf.get("spark.sql.shuffle.partitions")))
    pairs = found.agg(F.sum("n_shingles")).first()[0] or 0
    cells = parts * max(1, -(-pairs // (CELL * parts)))
    keys = partition_keys(spark, parts)
    classes = materialise(_prefixes(_shared(_spread(docs, keys, cells, size, text_col, hot, twins), keys, cells), parts, percent), "classes")
    postings = classes.select("d", "n", "need", "center", (F.col("alone")).alias("alone"), F.posexplode("toks").alias("i", "tok")).withColumn("at", F.col("alone") + F.col("i")).drop("i", "alone")
    links = lambda pairs_, name: materialise(verified(pairs_, classes, percent).where("sure").select("u", "v"), name)

    # the least edited of a group of copies has the most frequent shingles: what links at all mostly links with it
    lists = postings.groupBy("tok").agg(F.max(F.struct("center", "d"))["d"].alias("u"), F.count("*").alias("k")).where("k > 1").drop("k")
    lists = materialise(lists, "lists")  # as a table of its own, so that AQE can split a long list in the join
    stars = postings.join(lists, "tok").where("d <> u").select("u", F.col("d").alias("v")).distinct()
    labels = components(links(stars, "links"))

    rows = materialise(_labelled(postings, labels), "postings")
    pick = F.struct("comp", F.xxhash64("d", "tok").alias("x"), "d")
    lists = rows.groupBy("tok").agg(F.min(pick).alias("lead"), F.max("comp").alias("most")).where("lead.comp < most").select("tok", "lead")
    lists = materialise(lists, "lists-2")
    stars = rows.join(lists, "tok").where("comp <> lead.comp").select(F.col("lead.d").alias("u"), F.col("d").alias("v")).distinct()
    as_links = lambda found: found.select(F.col("node").alias("u"), F.col("root").alias("v"))
    labels = components(as_links(labels).unionByName(links(stars, "links-2")))

    rows = _labelled(postings, labels)
    blocks = F.ceil(F.count("*") / BLOCK).cast("int").alias("blocks")
    mixed = rows.groupBy("tok").agg(F.min("comp").alias("least"), F.max("comp").alias("most"), blocks).where("least < most").select("tok", "blocks")
    mixed = materialise(mixed, "lists-3")
    marks = classes.select("d", "s", "lost", *(F.col("sketch")[i].alias(f"b{i}") for i in range(SKETCH // 64)))
    rows = materialise(rows.join(mixed, "tok").join(marks, "d"), "postings-2")
    # a block of a long list against all of it: many tasks share one list
    own = [c for c in rows.columns if c not in ("tok", "blocks")]
    left = rows.select("tok", F.pmod(F.xxhash64("d"), "blocks").cast("int").alias("block"), *(F.col(c).alias(c + "u") for c in own))
    right = rows.select("tok", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)).alias("block"), *(F.col(c).alias(c + "v") for c in own))
    least = F.ceil(percent * (F.col("nu") + F.col("nv")) / F.lit(100 + percent)) - F.col("lostu") - F.col("lostv")
    # no common shingle stands before the first one, and each odd place of the sketches' difference holds a shingle that is not common
    room = F.least(F.col("nu") - F.col("atu"), F.col("nv") - F.col("atv")) + F.least("needu", "needv") - 1
    differ = sum((F.bit_count(F.col(f"b{i}u").bitwiseXOR(F.col(f"b{i}v"))) for i in range(SKETCH // 64)), F.lit(0))
    near = (F.col("compu") < F.col("compv")) & (100 * F.least("nu", "nv") >= percent * F.greatest("nu", "nv")) & (room >= least) & (F.col("su") + F.col("sv") - differ >= 2 * least)
    pairs = left.join(right, (left["tok"] == right["tok"]) & (left["block"] == right["block"]) & near).groupBy(F.col("du").alias("u"), F.col("dv").alias("v")).agg(F.count("*").alias("k"), F.least(F.first("needu"), F.first("needv")).alias("need"))
    more = materialise(verified(pairs.where("k >= need").select("u", "v"), classes, percent), "links-3")
    sure, open_ = more.where("sure").select("u", "v"), more.where("not sure").select("u", "v")
    if not open_.isEmpty():
        sure = sure.unionByName(materialise(verified_again(open_, docs, found, size, percent, id_col, text_col), "links-4"))
    return components(as_links(labels).unionByName(sure)) if not sure.isEmpty() else labels


def rooted(docs: DataFrame, size: int = SHINGLE, percent: int = PERCENT, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row for each of docs: doc_id, hash (of the text), n_shingles, root (of its component; null for the empty set) and component_id."""
    ship(docs.sparkSession)
    made = materialise(members(docs, size, id_col, text_col), "members")
    found = made.where("toks is null").drop("toks", "times")
    named = lambda rows: materialise(rows.where("class is not null").groupBy("class").agg(F.min("doc_id").alias("least"), F.min("check").alias("a"), F.max("check").alias("b")), "classes-found")
    least = named(found)
    # digests of two sets or more: at n classes some n * n / 2^65 of them, none up to a thousand million. Their sets go by the second digest.
    twins = least.where("a <> b").select("class").toPandas()["class"].to_numpy(np.int64).view(np.uint64)
    if len(twins):
        found = found.withColumn("class", F.when(F.col("class").isin(twins.view(np.int64).tolist()), F.col("check")).otherwise(F.col("class")))
        least = named(found)
    roots = linked_classes(docs, found, frequent(made), twins, size, percent, id_col, text_col)
    least = materialise(least.join(roots, F.col("class") == F.col("node"), "left").select("class", "least", F.coalesce("root", "class").alias("root")), "named")
    names = materialise(least.groupBy("root").agg(F.min("least").alias("component_id")), "names")
    by_class = least.select("class", "root").join(names, "root").select("class", "root", "component_id")
    return found.join(by_class, "class", "left").select("doc_id", "hash", "n_shingles", "root", F.coalesce("component_id", "doc_id").alias("component_id"))


def jaccard_components(docs: DataFrame, size: int = SHINGLE, percent: int = PERCENT, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row for each of docs: doc_id, hash (of the text), n_shingles, component_id."""
    return rooted(docs, size, percent, id_col, text_col).drop("root")


def op7(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jaccard_components(table(spark, sf_dir, "documents")).select("doc_id", "n_shingles", "component_id")


def stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One row of each component stays: that of the smallest doc_id (null last), then of the smallest text hash, and one of those that are equal in both. Texts without words stay."""
    found = materialise(rooted(docs), "rooted")
    linked = found.where("root is not null")
    first = linked.groupBy(F.col("root").alias("of")).agg(F.min(F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "hash")).alias("x"))
    stays = linked.join(materialise(first, "stays"), F.col("root") == F.col("of")).withColumn("stay", F.col("doc_id").eqNullSafe(F.col("x.doc_id")) & (F.col("hash") == F.col("x.hash")))
    gone = materialise(stays.where("not stay").select(F.col("doc_id").alias("of_doc"), F.col("hash").alias("of_hash")).distinct(), "gone")
    twice = stays.where("stay").groupBy(F.col("doc_id").alias("doc"), "hash").agg(F.count("*").alias("n")).where("n > 1")
    keyed = docs.select(F.struct(*(col(c) for c in docs.columns)).alias("row"), col("doc_id").cast("long").alias("doc"), row_hash(text_of()).alias("hash"))
    may = among(gone.select(F.xxhash64("of_doc", "of_hash").alias("key")), "key")(F.xxhash64("doc", "hash"))
    left = keyed.where(may).join(gone, F.col("doc").eqNullSafe(F.col("of_doc")) & (F.col("hash") == F.col("of_hash")), "left_anti")
    return first_of_equal(keyed.where(~may).unionByName(left), twice)[0].select("row.*")
