import pytest
from pyspark.sql import functions as F

from strata import errors
from strata.operators import blobs, live, permissions, placement
from strata.plans import migrate
from strata.schema import NON_UNIQUE, UNIQUE, Family, FieldSpec, Registry, Version
from strata.store import Store
from strata.streaming import feed

O1 = Version(1, (FieldSpec("amount", "i64"), FieldSpec("status", "str")), checks=(("amount", "must be positive", lambda: F.col("amount") > 0),), preprocess=lambda d: d.withColumn("status", F.upper(F.trim("status"))))
O2 = Version(2, (*O1.fields, FieldSpec("edited", "bool")), forward=lambda d: d.withColumn("edited", F.lit(False)), rollback=lambda d: d.drop("edited"))
ORDER = Family("Order", 7401, NON_UNIQUE, (O1, O2))
SETTINGS = Family("Settings", 7400, UNIQUE, (Version(1, (FieldSpec("name", "str"),)),))


@pytest.fixture
def store(spark, tmp_path):
    return Store(spark, f"file://{tmp_path}/store", Registry([ORDER, SETTINGS]))


def test_many(store, spark):
    s = store.session(1, 42)
    assert s.query(ORDER).count() == 0
    saved = s.save(ORDER, spark.createDataFrame([(50, " a"), (150, "b"), (200, "c"), (-1, "bad")], "amount long, status string"), version=1, order=("amount",))
    assert saved.accepted.count() == 3
    assert [tuple(r) for r in saved.rejected.select("code", "field", "message").collect()] == [("ValidationFailed", "amount", "must be positive")]
    assert store.rejects().count() == 1
    s.save(ORDER, spark.createDataFrame([(300, "d", True)], "amount long, status string, edited boolean"), version=2)
    rows = s.query(ORDER, ORDER.amount.gt(100), ordered=True).collect()
    assert [(r["amount"], r["status"], r["edited"], r["stored_version"]) for r in rows] == [(150, "B", False, 1), (200, "C", False, 1), (300, "d", True, 2)]
    assert [r["amount"] for r in s.query(ORDER, ORDER.edited.eq(False)).collect()] == []
    assert s.query(ORDER, ORDER.edited.eq(False), filter_after_migration=True).count() == 3
    assert s.query(ORDER, version=1).columns[-3:] == ["amount", "status", "stored_version"]
    assert s.for_tenant(43).query(ORDER).count() == 0
    gone = saved.accepted.where("amount = 150")
    s.delete(ORDER, gone)
    assert s.delete(ORDER, gone).count() == 0
    assert sorted(r["amount"] for r in s.query(ORDER).collect()) == [50, 200, 300]
    assert sorted(r["amount"] for r in s.query(ORDER, until=2).collect()) == [50, 150, 200]
    assert s.query(ORDER, until=2).count() == 3 and s.query(ORDER, until=-1).count() == 0
    with pytest.raises(errors.PermissionDenied):
        s.for_tenant(43).delete(ORDER, gone)
    with pytest.raises(errors.ShapeMismatch):
        s.find(ORDER)
    store.compact(ORDER, 1)
    assert sorted(r["amount"] for r in s.query(ORDER).collect()) == [50, 200, 300]
    first = s.query(ORDER, ordered=True).first()
    assert s.get(ORDER, 0, first["created_at"]).first()["amount"] == 50
    assert s.get_by_anchor(ORDER).first()["amount"] == 50
    assert s.history(ORDER).count() == 4


def test_one(store, spark):
    s = store.session(1, 5)
    assert s.find(SETTINGS).isEmpty()
    for name in ("a", "b"):
        saved = s.save(SETTINGS, spark.createDataFrame([(name,)], "name string"))
    assert [r["name"] for r in s.find(SETTINGS).collect()] == ["b"]
    s.delete(SETTINGS, saved.accepted)
    assert s.find(SETTINGS).isEmpty()
    with pytest.raises(errors.ShapeMismatch):
        s.query(SETTINGS)


def test_two_writers(store, spark):
    """Saves and deletes side by side, over several tenants: nothing is lost and no number is dealt twice."""
    from concurrent.futures import ThreadPoolExecutor

    def work(k):
        return store.session(k, 42 + k % 2).save(ORDER, spark.createDataFrame([(100 * k + i, "a") for i in range(1, 6)], "amount long, status string"), version=1).accepted.count()

    with ThreadPoolExecutor(4) as pool:
        assert list(pool.map(work, range(6))) == [5] * 6
    for tenant in (42, 43):
        rows = store.session(1, tenant).query(ORDER).collect()
        assert sorted(r["amount"] for r in rows) == [100 * k + i for k in range(tenant - 42, 6, 2) for i in range(1, 6)]
        assert sorted(r["seq"] for r in rows) == list(range(15)) and len({r["created_at"] for r in rows}) == 15


def test_append_while_compacting(store, spark, monkeypatch):
    """Rows that come while a compaction writes stay; a second compaction of the same state gives way."""
    s = store.session(1, 42)
    save = lambda *x: s.save(ORDER, spark.createDataFrame([(v, "a") for v in x], "amount long, status string"), version=1)
    save(1, 2)
    save(3)
    before, commit, late = store.log.parts(ORDER), store.log.commit, []

    def slow(family, change):
        if not late:
            late.append(1)
            save(4)
        commit(family, change)

    monkeypatch.setattr(store.log, "commit", slow)
    store.compact(ORDER, 1)
    monkeypatch.undo()
    assert sorted(r["amount"] for r in s.query(ORDER).collect()) == [1, 2, 3, 4]
    assert len(store.log.parts(ORDER)) == 2 and not set(before) & set(store.log.parts(ORDER))
    monkeypatch.setattr(store.log, "parts", lambda family: before)
    with pytest.raises(errors.Conflict):
        store.compact(ORDER, 1)
    monkeypatch.undo()
    assert store.vacuum(ORDER) == 3 and sorted(r["amount"] for r in s.query(ORDER).collect()) == [1, 2, 3, 4]


def test_chain(spark, tmp_path):
    from strata.sources.log import Chain

    chain = Chain(spark, f"file://{tmp_path}/chain", keep=3)
    assert chain.last() == (-1, "")
    assert all(chain.push(i, f"text {i} é") for i in range(6)) and not chain.push(5, "again") and chain.last() == (5, "text 5 é")
    assert not chain.push(1, "a number that was cleared away") and chain.last() == (5, "text 5 é")


def test_rows_are_scanned_once(store, spark):
    s = store.session(1, 5)
    s.save(ORDER, spark.createDataFrame([(1, "a")], "amount long, status string"), version=1)
    plan = s.query(ORDER, ORDER.amount.gt(0))._jdf.queryExecution().executedPlan().toString()
    assert sum("status" in line for line in plan.splitlines() if "ReadSchema" in line) == 1


def test_moves_with_session(store, spark):
    """A move may look up another family through the session."""
    v2 = Version(2, (FieldSpec("amount", "i64"), FieldSpec("owner", "str")), forward_with=lambda s, d: d.crossJoin(s.find(SETTINGS).select(F.col("name").alias("owner"))), rollback_with=lambda s, d: d.drop("owner"))
    bill = Family("Bill", 7403, NON_UNIQUE, (Version(1, (FieldSpec("amount", "i64"),)), v2))
    store.registry.add(bill)
    s = store.session(1, 5)
    s.save(SETTINGS, spark.createDataFrame([("Ann",)], "name string"))
    s.save(bill, spark.createDataFrame([(7,)], "amount long"), version=1)
    assert [(r["amount"], r["owner"]) for r in s.query(bill).collect()] == [(7, "Ann")]
    with pytest.raises(errors.NoMigrationPath):
        migrate.read_as(spark.createDataFrame([(7,)], "amount long"), bill, 1, 2)


def test_split_has_ids_of_its_own(store, spark):
    part = Family("Part", 7404, NON_UNIQUE, (Version(1, (FieldSpec("amount", "i64"),)),))
    store.registry.add(part)
    s = store.session(1, 5)
    saved = s.save(ORDER, spark.createDataFrame([(5, "a"), (6, "b"), (7, "c")], "amount long, status string"), version=1, order=("amount",))
    s.delete(ORDER, saved.accepted.where("amount = 5"))
    s.split(ORDER, {part: lambda d: d.select("amount")}, order=("amount",))
    assert sorted((r["amount"], r["created_at"]) for r in s.query(part).collect()) == [(6, 0), (7, 1)]
    assert sorted(r["amount"] for r in s.query(ORDER).collect()) == [6, 7]


def test_anchors(store, spark):
    from strata.functions import ids

    s = store.session(1, 5)
    saved = s.save(ORDER, spark.createDataFrame([(5, "a"), (6, "b")], "amount long, status string"), version=1, order=("amount",))
    s.save(SETTINGS, spark.createDataFrame([("Ann",)], "name string"))
    key = lambda *x: spark.range(1).select(ids.id_hex(*x)).first()[0]
    assert s.read_anchor(ORDER, key(5, 0, 7401, saved.accepted.where("amount = 6").first()["created_at"])).first()["amount"] == 6
    assert s.read_anchor(ORDER, key(5, 0, 7401, 0)).first()["amount"] == 5
    assert s.read_anchor(SETTINGS, spark.range(1).select(ids.anchor_of_unique(7400, F.lit(5))).first()[0]).first()["name"] == "Ann"
    blob = spark.createDataFrame([("a" * 64, "x")], "content_hash string, value string")
    assert s.read_anchor(ORDER, "a" * 64, blob).first()["value"] == "x"
    for bad, error in (("zz", errors.Unsupported), (key(6, 0, 7401, 0), errors.PermissionDenied)):
        with pytest.raises(error):
            s.read_anchor(ORDER, bad)


def test_own_writes_only(spark, tmp_path):
    from strata.store import StoreConfig

    closed = Family("Closed", 7405, NON_UNIQUE, (Version(1, (FieldSpec("amount", "i64"),)),), auto_crud=False)
    s = StoreConfig(f"file://{tmp_path}/store", (closed,)).open(spark).session(1, 5)
    with pytest.raises(errors.Unsupported):
        s.save(closed, spark.createDataFrame([(7,)], "amount long"))
    assert s.query(closed).count() == 0


@pytest.mark.parametrize(("parts", "error"), [((1 << 48, 0, 0, 0), errors.TenantOutOfRange), ((0, 4096, 0, 0), errors.ShardOutOfRange), ((0, 0, 1 << 20, 0), errors.StructIdOutOfRange), ((0, 0, 0, 1 << 48), errors.TickOutOfRange)])
def test_ids_out_of_range(parts, error):
    from strata.functions import ids

    assert ids.checked(1, 2, 3, 4) == (1, 2, 3, 4)
    with pytest.raises(error):
        ids.checked(*parts)


def test_descend(spark):
    from strata.operators import refs

    chain = spark.range(77).select("id", F.when(F.col("id") > 0, F.col("id") - 1).alias("up"), F.lit("x").alias("depth_")).unionByName(spark.createDataFrame([(500, 499, "orphan"), (501, 500, "below")], "id long, up long, depth_ string"))
    assert {r["id"]: r["depth"] for r in refs.descend(chain, "id", "up").collect()} == {i: i for i in range(77)}
    assert refs.descend(chain.limit(0), "id", "up").count() == 0
    with pytest.raises(errors.StrataError):
        refs.descend(chain.unionByName(spark.createDataFrame([(900, 901, ""), (901, 900, "")], chain.schema)), "id", "up").count()


def test_copy_on_write(spark, tmp_path):
    from strata.sources.log import copy_on_write

    path = f"file://{tmp_path}/pages"
    rows = lambda *x: spark.createDataFrame(x, "id long, v string, seq long, page long")
    copy_on_write(spark, path, rows((1, "a", 1, 0), (2, "b", 2, 1), (3, "c", 3, 2)), "page", ["id"], "seq")
    files = {r[0] for r in spark.read.parquet(path).where("page = 2").select(F.input_file_name()).collect()}
    assert copy_on_write(spark, path, rows((1, "z", 4, 0), (2, "late", 1, 1), (4, "d", 5, 1)), "page", ["id"], "seq") == [0, 1]
    assert sorted((r["id"], r["v"]) for r in spark.read.parquet(path).collect()) == [(1, "z"), (2, "b"), (3, "c"), (4, "d")]
    assert files == {r[0] for r in spark.read.parquet(path).where("page = 2").select(F.input_file_name()).collect()}


def test_one_tenant_reads_one_bucket(store, spark):
    s = store.session(1, 5)
    s.save(ORDER, spark.createDataFrame([(1, "a")], "amount long, status string"), version=1)
    plan = s.query(ORDER, ORDER.amount.gt(0))._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters: [isnotnull(bucket" in plan


def test_first_try_and_fallback(spark):
    found = spark.createDataFrame([("x",)], "name string")
    v = Version(1, (FieldSpec("name", "str"),), fallback=lambda: spark.createDataFrame([("default",)], "name string"))
    f = Family("S", 1, UNIQUE, (v,))
    assert migrate.first_try_or(found, f, 1).first()[0] == "x"
    assert migrate.first_try_or(found.limit(0), f, 1).first()[0] == "default"
    w = Version(1, v.fields, first_try=lambda: spark.createDataFrame([("tried",)], "name string"))
    assert migrate.first_try_or(found, Family("S", 1, UNIQUE, (w,)), 1).first()[0] == "tried"


def test_graph(spark):
    g = migrate.MigrationGraph()
    g.add((1, 1), (1, 2), lambda d: d.withColumn("b", F.lit(1)), rollback=lambda d: d.drop("b"))
    g.add((1, 2), (1, 3), lambda d: d.withColumn("c", F.lit(2)))
    g.compose(((1, 3), (2, 1)), (3, 1))
    assert g.resolve((1, 1), (1, 1)) == [] and len(g.resolve((1, 1), (3, 1))) == 3 and g.count() == 4
    assert g.can_roll_back((1, 2), (1, 1)) and not g.can_roll_back((1, 3), (1, 1))
    df = spark.range(1)
    assert g.migrate(df, (1, 1), (1, 3)).columns == ["id", "b", "c"]
    assert g.roll_back(g.migrate(df, (1, 1), (1, 2)), (1, 2), (1, 1)).columns == ["id"]
    for bad in (lambda: g.resolve((1, 3), (1, 1)), lambda: g.roll_back(df, (1, 3), (1, 1)), lambda: g.migrate(df, (1, 3), (3, 1))):
        with pytest.raises(errors.NoMigrationPath):
            bad()
    with pytest.raises(errors.StrataError):
        migrate.check_links(Family("F", 1, UNIQUE, (O2,)))


@pytest.mark.parametrize("n", [1, 255, 256, 257])
def test_segments(spark, n):
    rows = spark.range(n).select(F.lit(1).alias("tenant"), F.col("id").alias("created_at"), F.col("id").alias("seq"))
    counts = sorted(r["count"] for r in live.segments(rows).groupBy("segment").count().collect())
    assert sum(counts) == n and max(counts) == min(n, 256) and len(counts) == -(-n // 256)


@pytest.mark.parametrize(("users", "promoted"), [(50, False), (51, True)])
def test_access_threshold(spark, users, promoted):
    p = F.struct(F.lit("inline").alias("kind"), F.sequence(F.lit(1), F.lit(users)).cast("array<bigint>").alias("users"), F.lit(None).cast("bigint").alias("group"))
    rows = spark.range(1).select(F.lit(1).alias("tenant"), p.alias("permission"))
    groups = spark.createDataFrame([], "group_id bigint, users array<bigint>")
    assert rows.select(permissions.promoted(F.col("permission"))).first()[0] is promoted
    assert permissions.visible(rows, groups, users, 99).count() == 1 and permissions.visible(rows, groups, users + 1, 1).count() == 0


def test_groups_are_replaced(spark):
    old = spark.createDataFrame([(1, [5]), (2, [6])], "group_id bigint, users array<bigint>")
    new = permissions.register(old, spark.createDataFrame([(1, [7])], old.schema))
    assert {r["group_id"]: r["users"] for r in new.collect()} == {1: [7], 2: [6]}


def test_blobs(spark):
    rows = spark.createDataFrame([(1, "x" * 100), (2, "x" * 100), (2, "x" * 100), (3, "short"), (4, "y" * 100)], "o int, v string")
    kept, stored, owners = blobs.store(rows, "o", "v")
    assert (kept.count(), stored.count(), owners.count()) == (1, 2, 3)
    alive, left, dead = blobs.release(stored, owners, owners.where("owner in (1, 4)").unionByName(spark.createDataFrame([("nowhere", 9)], "content_hash string, owner int")))
    assert (alive.count(), left.count(), dead.count()) == (1, 1, 1)


def test_ring():
    nodes = [placement.node_id_of(f"n{i}") for i in range(4)]
    keys, owners = placement.ring_positions(nodes)
    found = placement.walk(keys, owners, keys[:50], 9)
    assert all(len(set(f)) == 4 for f in found) and [f[0] for f in found] == owners[:50].tolist()
    fewer = placement.ring_positions(nodes[:3])
    was, now = (dict(zip(range(999), (x[0] for x in placement.walk(*r, keys[:500], 1)), strict=False)) for r in ((keys, owners), fewer))
    assert all(now[k] == was[k] for k in was if was[k] != nodes[3])


def test_seen_filter():
    f = feed.SeenFilter(10_000)
    f.mark([str(i) for i in range(10_000)])
    assert f.probably_seen([str(i) for i in range(10_000)]).all()
    assert f.probably_seen([f"x{i}" for i in range(10_000)]).mean() < 0.02


def test_seen_filter_of_many_keys(spark, tmp_path):
    from strata.catalog import QUERIES

    spark.range(400_000).withColumnRenamed("id", "event_id").write.parquet(f"{tmp_path}/events.parquet")
    assert [tuple(r) for r in QUERIES["seen_filter"](spark, str(tmp_path)).collect()] == [(400_000, True)]


def test_seen_filter_of_odd_keys(spark, tmp_path):
    from strata.catalog import QUERIES

    rows = spark.range(-2000, 2000).selectExpr("nullif(id, 7) AS event_id")
    rows.unionByName(spark.range(3000).selectExpr("CAST(NULL AS bigint) AS event_id")).unionByName(rows).write.parquet(f"{tmp_path}/odd/events.parquet")
    assert [tuple(r) for r in QUERIES["seen_filter"](spark, f"{tmp_path}/odd").collect()] == [(11_000, True)]
    rows.limit(0).write.parquet(f"{tmp_path}/none/events.parquet")
    assert [tuple(r) for r in QUERIES["seen_filter"](spark, f"{tmp_path}/none").collect()] == [(0, True)]


def test_seen_table(spark, tmp_path):
    for share in (0.001, 0.01, 0.1):
        keys = spark.range(30_000).selectExpr("concat('k', id) AS k").unionByName(spark.createDataFrame([(None,)] + [("k5",)] * 1000, "k string"))
        known = feed.SeenTable.build(keys, "k", items=1, false_positives=share)
        assert known.blocks <= 1 + 1.11 * 30_001 / feed.SeenTable.load(share)
        assert known.probably_seen(keys, "k", "yes").where("yes").count() == 31_001
        others = known.probably_seen(spark.range(60_000).selectExpr("concat('x', id) AS k", "id AS n"), "k", "yes")
        assert others.columns == ["k", "n", "yes"] and others.count() == 60_000
        assert 0.4 * share < others.where("yes").count() / 60_000 < 1.2 * share
    few = feed.SeenTable.build(spark.createDataFrame([("a",)], "k string"), "k")
    asked = [(r["k"], r["yes"]) for r in few.probably_seen(spark.createDataFrame([("a",), ("b",), (None,), ("None",)], "k string"), "k", "yes").collect()]
    assert sorted(asked, key=str) == [("None", False), ("a", True), ("b", False), (None, False)]


def test_seen_table_on_a_stream(spark, tmp_path):
    known = feed.SeenTable.build(spark.range(50), "id")
    spark.range(40, 60).write.parquet(f"{tmp_path}/in")
    found = known.probably_seen(feed.read_log(spark, f"{tmp_path}/in", spark.range(1).schema), "id", "yes")
    rows = feed.run_to_end(found, "seen_on_a_stream", f"{tmp_path}/checkpoint").collect()
    assert len(rows) == 20 and {r["id"] for r in rows if r["yes"]} == set(range(40, 50))


def test_stream_resumes(spark, tmp_path):
    src, target = f"{tmp_path}/in", f"{tmp_path}/out"
    spark.range(5).withColumnRenamed("id", "seq").write.parquet(src)
    stream = lambda: feed.read_log(spark, src, spark.read.parquet(src).schema)
    for _ in range(2):
        feed.archive_stream(stream(), target, f"{tmp_path}/checkpoint").awaitTermination()
    assert spark.read.parquet(target).count() == 5
    spark.range(5, 8).withColumnRenamed("id", "seq").write.mode("append").parquet(src)
    feed.archive_stream(stream(), target, f"{tmp_path}/checkpoint").awaitTermination()
    assert sorted(r[0] for r in spark.read.parquet(target).collect()) == list(range(8))


def test_replicas_and_views(spark, tmp_path):
    src = f"{tmp_path}/in"
    spark.range(4).write.parquet(src)
    stream = feed.read_log(spark, src, spark.read.parquet(src).schema)
    targets = [f"{tmp_path}/a", f"{tmp_path}/b"]
    feed.replicated(stream, targets, f"{tmp_path}/c1").awaitTermination()
    assert all(spark.read.parquet(t).count() == 4 for t in targets)
    feed.sticky(stream, lambda: spark.read.parquet(src).agg(F.sum("id").alias("s")), f"{tmp_path}/view", f"{tmp_path}/c2").awaitTermination()
    assert spark.read.parquet(f"{tmp_path}/view").first()[0] == 6


def test_compression(spark):
    from strata.functions import compress
    from strata.runtime import ship

    ship(spark)
    samples = [f"record {i} of the same kind {i * 7}".encode() for i in range(400)]
    for words in (b"", compress.trained(samples, 1024)):
        df = spark.createDataFrame([(s,) for s in samples[:20]] + [(None,), (b"",)], "v binary")
        back = df.select("v", compress.decompressed(compress.compressed(F.col("v"), 19, words), words).alias("w")).collect()
        assert all(r["v"] == r["w"] for r in back)
    assert compress.trained([b"x"]) == b""


def test_tokens():
    from strata.functions import auth

    t = auth.mint(b"key", 1, 77, 1000)
    assert auth.verify(b"key", t, 1, 1030) and not auth.verify(b"key", t, 1, 1031) and not auth.verify(b"key", t, 2, 1000) and not auth.verify(b"other", t, 1, 1000)
