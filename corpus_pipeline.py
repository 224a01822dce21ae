"""A corpus from documents, in five stages; each stage's rows are written and read again before the next.

Every function takes (spark, docs, sf_dir). All but the last return the columns of documents.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from strata.llm import bpe, jaccard, line_dedup, mixing, quality_rules
from strata.llm.common import materialise, table

STAGES = [
    ("quality rules", quality_rules.stage),
    ("line dedup", line_dedup.stage),
    ("n-gram jaccard join", jaccard.stage),
    ("mixing sources", mixing.stage),
    ("bpe encoding and decoding", bpe.stage),
]
#: SQL can't express the learned rules, the Jaccard join's shingles at any useful speed, or byte-pair encoding.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for k, (name, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if k < len(STAGES) - 1:
            docs = materialise(docs, name.replace(" ", "-"))
    return docs
