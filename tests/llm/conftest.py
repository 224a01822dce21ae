import random

import pytest

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"
#: Names that operators might use inside.
CLASH = ["row", "kept", "n_words", "copy", "n_copies", "mix_key", "digest", "class", "hash", "d", "label", "score", "id", "doc", "clean", "spans", "found", "ids", "decoded", "key", "at", "u", "cdf", "of", "n", "kind", "place", "norm", "base_failed", "component_id", "_metadata", "start", "secret", "n_lines", "of_doc"]
WORDS = "ba be bi bo bu ca ce ci co cu da de di do du fa fe fi fo fu ga ge gi go gu".split()


def prose(rng, n):
    return " ".join(rng.choice(WORDS) + rng.choice(WORDS) + rng.choice(WORDS) for _ in range(n))


def odd_rows():
    """Nulls, empty and very long texts, ties, repeated rows."""
    rng = random.Random(4)
    base = prose(rng, 90)
    lines = "\n".join(prose(rng, 9) for _ in range(6))
    long = prose(rng, 30_000)
    return [
        (1, base, "en", "a", len(base)), (1, base, "en", "a", len(base)), (2, base, "en", "b", len(base)), (3, None, None, None, None), (4, "", "en", "a", 0), (None, base, "en", None, 3), (None, None, None, None, None),
        (5, lines, "en", "a", 1), (6, lines + "\nmore here", "en", "a", 1), (6, "other text under the same id", "en", "a", 1), (7, long, "en", "c", len(long)), (8, long + " tail", "en", "c", 5), (9, " \t\n ", "en", "a", 4), (10, "one", "en", "a", 3), (11, "ONE", "en", "a", 3),
        (12, "\n\n\n", "", "", -1), (13, "x" * 50_000, "en", "a", 50_000), (14, base.upper() + "!", "en", "a", 9), (15, "é́ ß İ ǅ 👍🏽 日本 \u0000 ퟿  ", "??", "ü", 12), (16, "same same same same same same", "en", "a", 2),
    ]


@pytest.fixture(scope="session")
def odd(spark):
    return spark.createDataFrame(odd_rows(), SCHEMA)


@pytest.fixture(scope="session")
def clashing(spark, odd):
    from pyspark.sql import functions as F

    return odd.select("*", *(F.lit("x").alias(c) for c in CLASH), F.lit(1).alias("dotted.name"))


@pytest.fixture(scope="session")
def empty(spark):
    return spark.createDataFrame([], SCHEMA)


@pytest.fixture(scope="session")
def documents(spark, sf):
    return spark.read.parquet(f"{sf}/documents.parquet")


@pytest.fixture(scope="session")
def labels(spark, sf):
    return spark.read.parquet(f"{sf}/labels.parquet")
