import math
import random

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from strata.errors import MalformedPayload
from strata.plans.expr import OPS, All, And, Compare, Not, Or, compile_expr, evaluate, field, from_json, to_json
from strata.schema import FieldSpec, Version

KINDS = {"i": "i64", "s": "i16", "f": "f64", "g": "f32", "t": "str", "b": "bool", "y": "bytes", "u": "u64", "w": "u128", "x": "i128", "o": "option"}
V = Version(1, tuple(FieldSpec(k, v) for k, v in KINDS.items()))
VALUES = {
    "i": [None, -5, 0, 3, 7, 2**62], "s": [None, -2, 0, 3, 150], "f": [None, math.nan, -1.5, 0.0, 3.0, math.inf], "g": [None, math.nan, -1.5, 3.0], "t": [None, "", "a", "é", "z"], "b": [None, True, False],
    "y": [None, b"", b"\x00", b"\xff"], "u": [None, 0, 3, 2**64 - 1], "w": [None, 0, 3, 2**127 + 1, 2**128 - 1], "x": [None, -(2**127), -1, 0, 3, 2**127 - 1], "o": [None, "a"],
}
LITERALS = st.sampled_from([-5, 0, 3, 7, 149.5, 3.0, -1.5, 2.5, math.nan, math.inf, -math.inf, 2**62, 2**64 - 1, 2**64, 2**127 + 1, 2**128, -(2**127), 1e300, "", "a", "é", True, False, b"", b"\x00"])
LEAVES = st.one_of(st.just(All()), st.builds(Compare, st.sampled_from(OPS), st.sampled_from([*KINDS, "nowhere"]), LITERALS))
EXPRS = st.recursive(LEAVES, lambda x: st.one_of(st.builds(And, x, x), st.builds(Or, x, x), st.builds(Not, x)), max_leaves=6)


@pytest.fixture(scope="module")
def rows(spark):
    rng = random.Random(1)
    plain = [{k: rng.choice(v) for k, v in VALUES.items()} for _ in range(120)]
    from decimal import Decimal

    def stored(k, v):
        if v is None:
            return None
        if k == "u":
            return Decimal(v)
        return (v + (2**127 if k == "x" else 0)).to_bytes(16, "big") if k in "wx" else v

    schema = "n int, " + ", ".join(f"{f.name} {f.data_type.simpleString()}" for f in V.fields)
    df = spark.createDataFrame([(n, *(stored(k, r[k]) for k in KINDS)) for n, r in enumerate(plain)], schema).cache()
    return plain, df


@settings(max_examples=60, deadline=None)
@given(exprs=st.lists(EXPRS, min_size=8, max_size=8))
def test_compiled_like_evaluated(rows, exprs):
    plain, df = rows
    found = df.select("n", *(compile_expr(e, V).alias(f"e{i}") for i, e in enumerate(exprs))).collect()
    for r in found:
        for i, e in enumerate(exprs):
            assert bool(r[f"e{i}"]) == evaluate(e, V, plain[r["n"]]), (e, plain[r["n"]])


@given(EXPRS)
def test_json_round_trip(e):
    again = from_json(to_json(e))
    assert to_json(again) == to_json(e)


@pytest.mark.parametrize("text", ["", "[]", "[1]", '["eq","a"]', '["and",["all"]]', '["eq","a","int","x"]', "{}", '["xor",["all"],["all"]]', '["eq", 3, "int", "1"]'])
def test_malformed(text):
    with pytest.raises(MalformedPayload):
        from_json(text)


def test_two_valued():
    row = {"i": None}
    assert not evaluate(field("i").eq(1), V, row) and not evaluate(field("i").ne(1), V, row) and evaluate(~field("i").eq(1), V, row)
    assert evaluate(~field("o").eq("a"), V, {"o": "a"}) and not evaluate(field("o").eq("a"), V, {"o": "a"})


def test_reaches_the_scan(spark, sf):
    from strata.queries import ORDERS

    spark.conf.set("spark.sql.maxMetadataStringLength", "5000")
    df = spark.read.parquet(f"{sf}/orders.parquet").where(compile_expr(ORDERS.o_orderkey.gt(5) & ~ORDERS.o_orderstatus.eq("F"), ORDERS.latest)).select("o_orderkey")
    plan = df._jdf.queryExecution().executedPlan().toString()
    assert "GreaterThan(o_orderkey,5)" in plan and "Or(Not(EqualTo(o_orderstatus,F)),IsNull(o_orderstatus))" in plan
    assert "o_totalprice" not in plan.split("ReadSchema")[1]
