"""Every registered query against the same in SQL, and the entry module's contract."""

import pytest

import __spark_entry__ as entry
from strata.catalog import QUERIES, SQL


#: Queries whose answer is that nothing matches, or whose rows the smallest tables don't have (all but the first have some at sf0.01).
EMPTY = {"filter_type_mismatch", "unique_find_tenant", "retention", "monitor_search"}


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query(name, spark, sf, duck, same):
    df = QUERIES[name](spark, sf)
    if name in SQL:
        same(df, duck.sql(SQL[name]))
        assert name in EMPTY or df.count() > 0
    else:
        assert df.count() > 0


def test_entry(spark):
    assert entry.entry(spark).count() > 0
    assert set(entry.oracle_sql()) <= set(entry.queries())
    assert set(SQL) <= set(QUERIES)


def test_ring_against_plain_search(spark, sf):
    from strata.functions.hashing import FNV64
    from strata.queries import NODES

    def fnv(data):
        h = FNV64[0]
        for b in data:
            h = (h ^ b) * FNV64[1] % 2**64
        return h

    ring = sorted((fnv(n.to_bytes(8, "little") + v.to_bytes(4, "little")), n) for n in NODES for v in range(150))
    for row in QUERIES["ring_replicas"](spark, sf).join(spark.read.parquet(f"{sf}/customer.parquet"), "c_custkey").limit(60).collect():
        key = fnv(row["c_custkey"].to_bytes(8, "little") + row["c_nationkey"].to_bytes(2, "little"))
        order = [n for p, n in ring if p >= key] + [n for _, n in ring]
        assert [int(x) % 2**64 for x in row["replicas"].split(",")] == list(dict.fromkeys(order))[:3]
