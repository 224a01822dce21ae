"""Compression of single values, on Arrow batches. Tables don't need it: Parquet has codecs and dictionaries of its own."""

from __future__ import annotations

import pandas as pd
import zstandard
from pyspark.sql import Column
from pyspark.sql.functions import pandas_udf


def trained(samples: list[bytes], size: int = 16_384) -> bytes:
    """A dictionary for small values that look alike; empty if the samples are too few to learn from."""
    try:
        return zstandard.train_dictionary(size, samples).as_bytes()
    except zstandard.ZstdError:
        return b""


def _dictionary(data: bytes) -> zstandard.ZstdCompressionDict | None:
    return zstandard.ZstdCompressionDict(data) if data else None


def compressed(value: Column, level: int = 3, dictionary: bytes = b"") -> Column:
    @pandas_udf("binary")
    def run(v: pd.Series) -> pd.Series:
        c = zstandard.ZstdCompressor(level=level, dict_data=_dictionary(dictionary))
        return v.map(lambda x: None if x is None else c.compress(bytes(x)))

    return run(value.cast("binary"))


def decompressed(value: Column, dictionary: bytes = b"") -> Column:
    @pandas_udf("binary")
    def run(v: pd.Series) -> pd.Series:
        d = zstandard.ZstdDecompressor(dict_data=_dictionary(dictionary))
        return v.map(lambda x: None if x is None else d.decompress(bytes(x)))

    return run(value)
