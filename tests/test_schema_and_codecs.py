import pytest
from hypothesis import given
from hypothesis import strategies as st
from pyspark.sql import functions as F

from strata import errors
from strata.functions import hashing, ids, text
from strata.schema import NON_UNIQUE, UNIQUE, Family, FieldSpec, Registry, Version, pack_header, unpack_header, version_of_name
from strata.sources import wire

A = Version(1, (FieldSpec("amount", "u64"), FieldSpec("status", "str")))
B = Version(2, (*A.fields, FieldSpec("note", "str")))


def test_registry():
    r = Registry([Family("Order", 7001, NON_UNIQUE, (A, B))])
    assert r.latest_version(7001) == 2 and r.contains(pack_header(7001, 1)) and not r.contains(pack_header(7001, 3))
    assert unpack_header(pack_header(7001, 2)) == (7001, 2)
    assert r.find(pack_header(7001, 2))[1] is B
    with pytest.raises(errors.UnknownHeader):
        r.find(pack_header(1, 1))
    with pytest.raises(errors.DuplicateHeader):
        r.add(Family("Again", 7001, UNIQUE, (A,)))
    with pytest.raises(errors.DuplicateHeader):
        Family("Twice", 1, UNIQUE, (A, A))


@pytest.mark.parametrize("make", [lambda: FieldSpec("id", "u8"), lambda: FieldSpec("x", "u7"), lambda: Family("F", 1 << 20, UNIQUE, (A,)), lambda: Family("F", 1, "many", (A,)), lambda: Family("F", 1, UNIQUE, ()), lambda: Family("F", 1, UNIQUE, (A,), primary_anchor=("zip",)), lambda: version_of_name("Order"), lambda: version_of_name("Order256")])
def test_refused(make):
    with pytest.raises(errors.StrataError):
        make()


def test_names_and_shapes():
    f = Family("Order", 1, NON_UNIQUE, (A,))
    assert version_of_name("Order12") == ("Order", 12)
    assert f.amount.name == "amount" and f["anything"].name == "anything"
    with pytest.raises(AttributeError):
        _ = f.nowhere
    with pytest.raises(errors.ShapeMismatch):
        f.must_be(UNIQUE)


FIELDS = (FieldSpec("a", "u8"), FieldSpec("b", "i64"), FieldSpec("s", "str"), FieldSpec("f", "f64"), FieldSpec("w", "u128"), wire.Optional_("o", "str"), FieldSpec("y", "bytes"), FieldSpec("t", "bool"), FieldSpec("c", "char"))
ROWS = st.fixed_dictionaries({"a": st.integers(0, 255), "b": st.integers(-(2**63), 2**63 - 1), "s": st.text(), "f": st.floats(allow_nan=False), "w": st.integers(0, 2**128 - 1), "o": st.none() | st.text(), "y": st.binary(), "t": st.booleans(), "c": st.characters(exclude_categories=["Cs"])})


@given(ROWS, st.binary(max_size=3))
def test_wire_round_trip(row, more):
    data = wire.encode(FIELDS, row)
    assert wire.decode(FIELDS, data) == row
    assert wire.split_header(wire.with_header(9, 2, data)) == (9, 2, data)
    assert wire.unframe(wire.frame(data) + more) == (data, more)
    assert wire.unframe(wire.frame(data)[:-1] if data else b"\0") is None
    if more:
        with pytest.raises(errors.MalformedPayload):
            wire.decode(FIELDS, data + more)
    with pytest.raises(errors.MalformedPayload):
        wire.decode(FIELDS, data[: len(data) // 2])


def test_wire_layout():
    assert wire.layout(A.fields) == {"amount": 0, "status": 8}
    assert wire.encode(A.fields, {"amount": 258, "status": "ok"}) == bytes([2, 1, 0, 0, 0, 0, 0, 0, 2, 0, 0, 0]) + b"ok"


def test_wire_frames(spark):
    rows = spark.createDataFrame([(1, wire.encode(A.fields, {"amount": 2**64 - 1, "status": "é"})), (2, b"\x01")], "n int, data binary")
    got = {r["n"]: r for r in wire.decoded(rows, A).collect()}
    assert int(got[1]["amount"]) == 2**64 - 1 and got[1]["status"] == "é" and got[1]["error"] is None
    assert got[2]["amount"] is None and "bytes" in got[2]["error"]
    back = wire.encoded(wire.decoded(rows, A).where("error is null"), A).collect()
    assert bytes(back[0]["data"]) == bytes(rows.where("n = 1").first()["data"])
    headed = spark.createDataFrame([(bytearray(wire.with_header(7001, 2, b"x")),)], "data binary")
    assert headed.select(wire.peek_header(F.col("data"))).first()[0] == pack_header(7001, 2)


def test_ids(spark):
    rows = [(0, 0, 0, 0), (2**48 - 1, 4095, 2**20 - 1, 2**48 - 1), (5, 7, 9, 11), (2**50 + 3, 5000, 2**21 + 1, 2**49 + 2)]
    df = spark.createDataFrame(rows, "tenant bigint, shard bigint, struct_id bigint, created_at bigint")
    for r in df.select("*", ids.id_hex().alias("h"), *(ids.part_of(p, ids.id_bytes()).alias("p_" + p) for p in ids.ID_COLUMNS), ids.id_text().alias("t"), ids.anchor_of_hex(ids.id_hex()).alias("a")).collect():
        t, s, i, c = r["tenant"] % 2**48, r["shard"] % 2**12, r["struct_id"] % 2**20, r["created_at"] % 2**48
        assert int(r["h"], 16) == t << 80 | s << 68 | i << 48 | c
        assert [r["p_" + p] for p in ids.ID_COLUMNS] == [t, s, i, c]
        assert r["t"] == f"Id(t={t}, s={s}, sid={i}, c={c})" and int(r["a"], 16) == t << 80 | s << 68 | i << 48


@given(st.integers(0, 2**20 - 1), st.integers(0, 2**48 - 1), st.integers(0, 4095), st.integers(0, 2**48 - 1), st.sampled_from([0, 1, 7, 512, 1000]))
def test_slots(struct_id, tenant, shard, tick, count):
    import numpy as np

    m = 2**64

    def mix(x):
        z = x ^ hashing.GOLDEN
        z = (z ^ z >> 30) * hashing.SPLITMIX[0] % m
        z = (z ^ z >> 27) * hashing.SPLITMIX[1] % m
        return z ^ z >> 31

    u = lambda v: np.array([v], np.uint64)
    two = mix(tenant ^ struct_id * hashing.GOLDEN % m)
    turned = (tick << 17 | tick >> 47) % m
    four = (mix(struct_id * hashing.GOLDEN % m ^ shard << 48 ^ tick) + mix(tenant ^ turned) * hashing.GOLDEN) % m
    assert hashing.slot_of_two(u(struct_id), u(tenant), count)[0] == (two % count if count else 0)
    assert hashing.slot_of_four(u(struct_id), u(tenant), u(shard), u(tick), count)[0] == (four % count if count else 0)
    step = mix(tenant * hashing.MURMUR % m ^ struct_id ^ shard << 32)
    assert hashing.probe_step(u(struct_id), u(tenant), u(shard), count)[0] == (1 if count <= 1 else step % count | 1)


def test_known_hashes(spark):
    assert hashing.fnv64_text("a") == 0xAF63DC4C8601EC8C
    assert hashing.fnv128_bytes(b"").hex() == "6c62272e07bb014262b821756295c58d"
    df = spark.createDataFrame([(b"",), (b"a",)], "b binary")
    assert [r[0] for r in df.select(hashing.content_hash128(F.col("b"))).collect()] == [hashing.fnv128_bytes(b"").hex(), hashing.fnv128_bytes(b"a").hex()]


def test_text(spark):
    df = spark.createDataFrame([("\t  x y 　\n",), (" ",), ("",)], "t string")
    assert [r[0] for r in df.select(text.trim_unicode(F.col("t"))).collect()] == ["x y", "", ""]
    assert [r[0] for r in df.select(text.is_blank(F.col("t"))).collect()] == [False, True, True]
    sizes = spark.createDataFrame([(0,), (1023,), (1024,), (1536,), (5 * 2**30,)], "n bigint")
    assert [r[0] for r in sizes.select(text.human_bytes(F.col("n"))).collect()] == ["0B", "1023B", "1.0K", "1.5K", "5.0G"]
    packed = spark.range(1).select(text.descriptor_pack(F.lit(3), F.lit(2), F.lit(63), F.lit(True), F.lit(False)))
    assert packed.first()[0] == 3 << 16 | 2 << 8 | 63 << 2 | 2
