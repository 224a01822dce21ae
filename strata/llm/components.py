"""Connected components of links, by alternating large and small stars on DataFrames; nothing is gathered on the driver."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from strata.llm.common import materialise


#: Edges from which each star's minima are written, so that AQE can split a hub's edges in the join.
MANY = 1_000_000


def _star(edges: DataFrame, large: bool, many: bool) -> DataFrame:
    """Each node's larger (or smaller) neighbours are tied to the smallest of the node and its neighbours."""
    back = edges.select(F.col("v").alias("u"), F.col("u").alias("v"))
    around = edges.unionByName(back) if large else back
    least = around.groupBy("u").agg(F.least(F.min("v"), F.first("u")).alias("m"))
    if many:
        least = materialise(least, "least")
    joined = around.join(least, "u")
    tied = joined.where("v > u").select(F.col("m").alias("u"), "v") if large else joined.select(F.col("m").alias("u"), "v").unionByName(least.select(F.col("m").alias("u"), F.col("u").alias("v")))
    return tied.where("u < v").distinct()


def components(links: DataFrame, name: str = "links") -> DataFrame:
    """links: u and v. Gives node and root (the smallest node reachable), for nodes that aren't roots."""
    edges = materialise(links.select(F.least("u", "v").alias("u"), F.greatest("u", "v").alias("v")).where("u < v").distinct(), name)
    before = (edges.count(),)
    while True:
        many = before[0] > MANY
        edges = materialise(_star(_star(edges, True, many), False, many), name)
        now = edges.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        if now == before or not now[0]:
            return edges.select(F.col("v").alias("node"), F.col("u").alias("root"))
        before = now
