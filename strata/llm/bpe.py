"""Byte-pair encoding and decoding with a segment tree over adjacent pair ranks (operator 4).

Each leaf holds the rank of a symbol and its right neighbour together with the place; each inner node holds the smaller of its
two. The root is the leftmost pair of the lowest rank. Merging it changes the ranks of two pairs at most and takes one out, each
a point update in logarithmic time, until no pair can be merged. Short words that have not been met lately are merged together,
one tree a row of an array; long words have a tree of their own.

The vocabulary file is read on the driver and broadcast; it is a parameter of fixed size. Rows stay where they are: no shuffle.

Defined results. Null text counts as empty: no ids, empty decoded text. The strings of special tokens in a text give their ids, as in
the tokenizers library. Repeated rows are encoded each on its own, an empty table gives no rows, and given columns whose names the result needs get an underscore. Very long texts
are encoded whole: memory follows a slice of texts (SLICE bytes, or one text) and a cache of words of CACHE bytes. A vocabulary file with another
normaliser, another word pattern or another model than this one is refused.
"""

from __future__ import annotations

import json
import re
import unicodedata
from collections.abc import Iterator
from dataclasses import dataclass
from pathlib import Path

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from strata.llm.arrow import settled, slices, texts
from strata.llm.common import col, named_apart, table, text_of, with_row
from strata.runtime import ship

CACHE = 48 << 20
#: Bytes of a cached word besides its letters and ids.
CACHED = 200
NONE = np.uint64(0xFFFFFFFFFFFFFFFF)
SHORT = 64
#: Word pattern of the public word-level BPE vocabulary, for ASCII and for all texts. Blanks are the Unicode ones.
ASCII_WORDS = re.compile(r"'s|'t|'re|'ve|'m|'ll|'d|[a-z]+|[0-9]|[^\t-\r a-z0-9]+")
ALL_WORDS = r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\t-\r\x85\p{Z}\p{L}\p{N}]+"

#: What a vocabulary file says that is read as this module reads it.
NORMALIZERS = [{"type": "NFC"}, {"type": "Replace", "pattern": {"Regex": r"\s+"}, "content": " "}, {"type": "Lowercase"}]
SPLIT = r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+"
PRE_TOKENIZERS = [{"type": "Split", "pattern": {"Regex": SPLIT}, "behavior": "Removed", "invert": True}, {"type": "ByteLevel", "add_prefix_space": False, "trim_offsets": True, "use_regex": False}]
MODEL = {"type": "BPE", "dropout": None, "continuing_subword_prefix": None, "byte_fallback": False, "ignore_merges": False}

#: Outside these, Unicode versions differ in what is a letter or a composition: there the tokenizers library cuts the words.
RARE = re.compile(r"[^\x00-\u036F\u0386-\u03FF\u0400-\u052F\u1E00-\u1FFF\u2000-\u2064\u20A0-\u20BF\u2100-\u214F\u3000-\u30FF\u4E00-\u9FFF\uAC00-\uD7A3]")


def byte_symbols() -> list[str]:
    """The printable character that stands for each byte in byte-level vocabularies."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    other = iter(range(256, 512))
    return [chr(b) if b in plain else chr(next(other)) for b in range(256)]


@dataclass(frozen=True)
class Vocabulary:
    """tokens by id; first: the id of each byte inside a word, last: at its end; merges: pair -> (rank, merged id)."""

    tokens: list[str]
    first: np.ndarray
    last: np.ndarray
    merges: dict[int, tuple[int, int]]
    special: dict[str, int]
    source: str

    @staticmethod
    def load(path: str | Path) -> Vocabulary:
        source = Path(path).read_text(encoding="utf-8")
        spec = json.loads(source)
        model, vocab = spec["model"], spec["model"]["vocab"]
        same = [
            (spec["normalizer"] or {}).get("normalizers") == NORMALIZERS, (spec["pre_tokenizer"] or {}).get("pretokenizers") == PRE_TOKENIZERS, spec["decoder"] is None,
            all(model.get(k) == v for k, v in MODEL.items()), not any(t[k] for t in spec["added_tokens"] for k in ("single_word", "lstrip", "rstrip", "normalized")),
        ]
        if not all(same):
            raise ValueError(f"{path}: not a vocabulary of lower-case words with byte-level BPE")
        end = model.get("end_of_word_suffix") or ""
        special = {t["content"]: t["id"] for t in spec["added_tokens"]}
        size = max([*vocab.values(), *special.values()]) + 1
        tokens = [""] * size
        for token, i in [*vocab.items(), *special.items()]:
            tokens[i] = token
        symbols = byte_symbols()
        merges = {}
        for rank, pair in enumerate(model["merges"]):
            a, b = pair.split(" ") if isinstance(pair, str) else pair
            merges.setdefault(vocab[a] << 32 | vocab[b], (rank, vocab[a + b]))
        return Vocabulary(tokens, np.array([vocab[s] for s in symbols]), np.array([vocab[s + end] for s in symbols]), merges, special, source)


class MergeTree:
    """The segment tree of one word."""

    def __init__(self, ids: list[int], merges: dict[int, tuple[int, int]]) -> None:
        self.ids, self.merges = ids, merges
        n = len(ids)
        self.after, self.before = [*range(1, n), -1], [-1, *range(n - 1)]
        self.size = 1 << max(0, (n - 1).bit_length())
        self.none = 1 << 62
        self.tree = [self.none] * (2 * self.size)
        for i in range(n):
            self.tree[self.size + i] = self.key(i)
        for i in range(self.size - 1, 0, -1):
            self.tree[i] = min(self.tree[2 * i], self.tree[2 * i + 1])

    def key(self, i: int) -> int:
        j = self.after[i]
        found = self.merges.get(self.ids[i] << 32 | self.ids[j]) if j >= 0 else None
        return found[0] << 32 | i if found else self.none

    def put(self, i: int, key: int) -> None:
        at, tree = self.size + i, self.tree
        tree[at] = key
        while at > 1:
            at >>= 1
            least = min(tree[2 * at], tree[2 * at + 1])
            if tree[at] == least:
                break
            tree[at] = least

    def run(self) -> list[int]:
        while self.tree[1] < self.none:
            i = self.tree[1] & 0xFFFFFFFF
            j = self.after[i]
            self.ids[i] = self.merges[self.ids[i] << 32 | self.ids[j]][1]
            self.after[i] = k = self.after[j]
            if k >= 0:
                self.before[k] = i
            self.put(j, self.none)
            self.put(i, self.key(i))
            if (h := self.before[i]) >= 0:
                self.put(h, self.key(h))
        out, i = [], 0
        while i >= 0:
            out.append(self.ids[i])
            i = self.after[i]
        return out


class Encoder:
    def __init__(self, vocabulary: Vocabulary) -> None:
        import regex

        self.v = vocabulary
        self.pattern = regex.compile(ALL_WORDS)
        self.special = re.compile("(" + "|".join(re.escape(t) for t in sorted(vocabulary.special, key=len, reverse=True)) + ")") if vocabulary.special else None
        self.pairs = np.array(sorted(vocabulary.merges), np.int64)
        found = [vocabulary.merges[int(p)] for p in self.pairs]
        self.rank = np.array([x[0] for x in found], np.uint64)
        self.merged = np.array([x[1] for x in found], np.int64)
        self.cache: dict[str, bytes] = {}
        self.held = 0
        self.bytes_of = {c: b for b, c in enumerate(byte_symbols())}
        self.library = None

    def _library_words(self, text: str) -> list[str]:
        if self.library is None:
            from tokenizers import Tokenizer

            self.library = Tokenizer.from_str(self.v.source)
        cut = self.library.pre_tokenizer.pre_tokenize_str(self.library.normalizer.normalize_str(text))
        return [bytes(map(self.bytes_of.__getitem__, w)).decode() for w, _ in cut]

    def words(self, text: str) -> list[str]:
        """The normalised words of a text without special tokens."""
        if text.isascii():
            return ASCII_WORDS.findall(text.lower())
        if RARE.search(text):
            return self._library_words(text)
        text = unicodedata.normalize("NFC", text)
        return self.pattern.findall(text.replace("Σ", "σ").lower())  # letter by letter: no final sigma

    def _keys(self, ids: np.ndarray, after: np.ndarray, row: np.ndarray, i: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Rank and place of the pairs at (row, i), and where their merges stand."""
        j = after[row, i]
        pair = ids[row, i] << 32 | ids[row, np.maximum(j, 0)]
        at = np.minimum(np.searchsorted(self.pairs, pair), len(self.pairs) - 1)
        ok = (i >= 0) & (j >= 0) & (self.pairs[at] == pair)
        return np.where(ok, self.rank[at] << np.uint64(8) | i.astype(np.uint64), NONE), at

    def _merge_rows(self, ids: np.ndarray, lengths: np.ndarray) -> list[bytes]:
        """One tree a row; all rows take a merge at a time."""
        n, size = ids.shape
        place = np.arange(size)
        after = np.where(place[None, :] + 1 < lengths[:, None], place[None, :] + 1, -1)
        before = np.where(place[None, :] < lengths[:, None], place[None, :] - 1, -1)
        tree = np.full((n, 2 * size), NONE)
        rows = np.repeat(np.arange(n), size)
        tree[:, size:] = self._keys(ids, after, rows, np.tile(place, n))[0].reshape(n, size)
        for k in range(size - 1, 0, -1):
            tree[:, k] = np.minimum(tree[:, 2 * k], tree[:, 2 * k + 1])

        def put(row: np.ndarray, i: np.ndarray, key: np.ndarray) -> None:
            at = size + i
            tree[row, at] = key
            for _ in range(size.bit_length() - 1):
                at = at >> 1
                tree[row, at] = np.minimum(tree[row, 2 * at], tree[row, 2 * at + 1])

        gone = place[None, :] >= lengths[:, None]
        row = np.flatnonzero(tree[:, 1] != NONE)
        while len(row):
            i = (tree[row, 1] & np.uint64(0xFF)).astype(np.int64)
            j = after[row, i]
            _, at = self._keys(ids, after, row, i)
            ids[row, i] = self.merged[at]
            gone[row, j] = True
            k = after[row, j]
            after[row, i] = k
            before[row[k >= 0], k[k >= 0]] = i[k >= 0]
            put(row, j, np.full(len(row), NONE))
            put(row, i, self._keys(ids, after, row, i)[0])
            h = before[row, i]
            has = h >= 0
            put(row[has], h[has], self._keys(ids, after, row[has], h[has])[0])
            row = row[tree[row, 1] != NONE]
        counts = size - gone.sum(1)
        flat, ends = ids[~gone].astype("<u4").tobytes(), np.cumsum(counts) * 4
        return [flat[e - 4 * c : e] for e, c in zip(ends.tolist(), counts.tolist(), strict=True)]

    def _learn(self, new: list[str]) -> None:
        coded = [w.encode() for w in new]
        by_size: dict[int, list[int]] = {}
        for k, b in enumerate(coded):
            by_size.setdefault(1 << (len(b) - 1).bit_length() if len(b) > 1 else 1, []).append(k)
        for size, group in by_size.items():
            if size > SHORT:
                for k in group:
                    b = np.frombuffer(coded[k], np.uint8)
                    ids = [*self.v.first[b[:-1]].tolist(), int(self.v.last[b[-1]])]
                    self.cache[new[k]] = np.array(MergeTree(ids, self.v.merges).run(), "<u4").tobytes()
                continue
            lengths = np.array([len(coded[k]) for k in group])
            data = np.frombuffer(b"".join(coded[k].ljust(size, b"\0") for k in group), np.uint8).reshape(len(group), size)
            ids = self.v.first[data]
            ends = (np.arange(len(group)), lengths - 1)
            ids[ends] = self.v.last[data[ends]]
            for k, b in zip(group, self._merge_rows(ids, lengths), strict=True):
                self.cache[new[k]] = b

    def encode(self, many: list[str]) -> list[bytes]:
        """The ids of each text, as little-endian unsigned 32-bit integers."""
        pieces: list[list] = []
        for text in many:
            if self.special is not None and any(t in text for t in self.v.special):
                parts = self.special.split(text)
                pieces.append([x for k, p in enumerate(parts) for x in ([self.v.special[p]] if k % 2 else self.words(p))])
            else:
                pieces.append(self.words(text))
        if self.held > CACHE:
            self.cache.clear()
            self.held = 0
        new = list(dict.fromkeys(w for ws in pieces for w in ws if w.__class__ is str and w not in self.cache))
        if new:
            self._learn(new)
            self.held += sum(CACHED + 4 * len(w) + len(self.cache[w]) for w in new)
        cache = self.cache
        return [b"".join([cache[w] if w.__class__ is str else np.uint32(w).tobytes() for w in ws]) for ws in pieces]

    def decode(self, ids: bytes) -> str:
        """The tokens with a space between each two: the vocabulary file names no decoder."""
        return " ".join(map(self.v.tokens.__getitem__, np.frombuffer(ids, "<u4").tolist()))


_ENCODERS: dict[int, Encoder] = {}


def vocabulary_path(name: str = "word_bpe_49k.json") -> str:
    import public_tokenizers

    return str(public_tokenizers.path(name))


def encode_decode(docs: DataFrame, path: str | None = None, columns: tuple[str, ...] = ("doc_id",), text_col: str = "text") -> DataFrame:
    """The given columns, ids (binary: little-endian unsigned 32-bit) and decoded."""
    spark = docs.sparkSession
    ship(spark)
    shared = spark.sparkContext.broadcast(Vocabulary.load(path or vocabulary_path()))
    packed = docs.select(F.struct(*(col(c) for c in columns)).alias("row"), text_of(text_col).alias("text"))

    @settled
    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key = id(shared.value)  # a worker keeps the value, and the encoder with its cache, from task to task
        if key not in _ENCODERS:
            _ENCODERS.clear()
            _ENCODERS[key] = Encoder(shared.value)
        coder = _ENCODERS[key]
        for batch in batches:
            column = texts(batch)
            for a, b in slices(column):
                ids = coder.encode(column.slice(a, b - a).to_pylist())
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(a, b - a), pa.array(ids, pa.binary()), pa.array([coder.decode(x) for x in ids], pa.string())], ["row", "ids", "decoded"])

    return packed.mapInArrow(work, with_row(packed, "ids binary, decoded string")).select(*named_apart("row", columns, ("ids", "decoded")))


def _digests(coded: DataFrame) -> DataFrame:
    return coded.select("doc_id", (F.octet_length("ids") / 4).cast("long").alias("n_tokens"), F.sha2("ids", 256).alias("ids_sha256"), F.sha2("decoded", 256).alias("decoded_sha256"))


def op4(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _digests(encode_decode(table(spark, sf_dir, "documents")))


def stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """doc_id, n_tokens and the digests of ids and decoded text of each row of docs: null ids stay, null texts are empty, repeated rows give repeated rows."""
    return _digests(encode_decode(docs))
