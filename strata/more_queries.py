"""Further registered queries: hashes, the ring, the wire format, streams that stop and go on, and the store's less common ways."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from strata import errors
from strata.functions import auth, compress, hashing, ids, text
from strata.operators import blobs, indexes, monitor, permissions, placement, refs
from strata.plans import hooks, migrate
from strata.queries import CUSTOMERS, NODES, ORDER_FIELDS, ORDERS, ORDERS3, PARTS, _event_stream, _guarded, events_log, query, read
from strata.runtime import ship, stage_path
from strata.schema import NON_UNIQUE, Family, FieldSpec, Registry, Version, pack_header
from strata.sources import wire
from strata.sources.log import copy_on_write
from strata.store import Store, StoreConfig
from strata.streaming import feed

_TWO64 = "(CAST(9223372036854775808 AS UHUGEINT) * 2)"


def _times(a: str, factor: int) -> str:
    return f"CAST((CAST({a} AS UHUGEINT) * CAST({factor} AS UHUGEINT)) % {_TWO64} AS UBIGINT)"


def _plus(a: str, b: str) -> str:
    return f"CAST((CAST({a} AS UHUGEINT) + CAST({b} AS UHUGEINT)) % {_TWO64} AS UBIGINT)"


def _let(value: str, name: str, body: str) -> str:
    return f"list_transform([{value}], lambda {name}: {body})[1]"


def _mix(x: str, tag: str) -> str:
    a, b, c = (f"{tag}{i}" for i in range(3))
    inner = _let(_times(f"xor({b}, {b} >> 27)", hashing.SPLITMIX[1]), c, f"xor({c}, {c} >> 31)")
    return _let(f"xor({x}, CAST({hashing.GOLDEN} AS UBIGINT))", a, _let(_times(f"xor({a}, {a} >> 30)", hashing.SPLITMIX[0]), b, inner))


def _fnv(parts: list[tuple[str, int]]) -> str:
    h = f"CAST({hashing.FNV64[0]} AS UBIGINT)"
    for value, width in parts:
        for k in range(width):
            h = _times(f"xor({h}, (CAST({value} AS UBIGINT) >> {8 * k}) & 255)", hashing.FNV64[1])
    return h


_U = "CAST({} AS UBIGINT)"
_RING = f"(SELECT n.node, {_fnv([('n.node', 8), ('v.v', 4)])} AS pos FROM (SELECT unnest([{', '.join(_U.format(n) for n in NODES)}]) AS node) n, (SELECT unnest(range({placement.VIRTUAL_NODES})) AS v) v)"
_NEAR = "(SELECT k.c_custkey, r.node, min((CAST(r.pos AS HUGEINT) - CAST(k.h AS HUGEINT) + 18446744073709551616) % 18446744073709551616) AS far FROM (SELECT c_custkey, {h} AS h FROM customer) k, " + _RING + " r GROUP BY 1, 2)"
_SIGNED = "CAST(CASE WHEN node >= 9223372036854775808 THEN CAST(node AS HUGEINT) - 18446744073709551616 ELSE CAST(node AS HUGEINT) END AS BIGINT)"


@query(f"SELECT c_custkey, {_SIGNED} AS owner FROM (SELECT c_custkey, arg_min(node, far) AS node FROM {_NEAR.format(h=_fnv([('c_custkey', 8), ('0', 2)]))} d GROUP BY 1) x")
def ring_owner(spark, sf):
    t = read(spark, sf, "customer")
    return t.select("c_custkey", placement.owner_of(spark, NODES, F.col("c_custkey"), F.lit(0)).alias("owner"))


@query(f"SELECT c_custkey, string_agg({_SIGNED}, ',' ORDER BY far) AS replicas FROM (SELECT *, row_number() OVER (PARTITION BY c_custkey ORDER BY far) AS nth FROM {_NEAR.format(h=_fnv([('c_custkey', 8), ('c_nationkey', 2)]))} d) x WHERE nth <= 3 GROUP BY 1")
def ring_replicas(spark, sf):
    t = read(spark, sf, "customer")
    return t.select("c_custkey", F.array_join(placement.replicas_of(spark, NODES, F.col("c_custkey"), F.col("c_nationkey"), 3).cast("array<string>"), ",").alias("replicas"))


_CRC_BYTE = "list_reduce([xor(c, b), 0, 0, 0, 0, 0, 0, 0, 0], lambda x, y: CASE WHEN x & 1 = 1 THEN xor(x >> 1, 3988292384) ELSE x >> 1 END)"


@query(f"SELECT CAST(xor(list_reduce(list_prepend(CAST(4294967295 AS BIGINT), list_transform(range(1, strlen(props) + 1), lambda i: CAST(ascii(substr(props, i, 1)) AS BIGINT))), lambda c, b: {_CRC_BYTE}), 4294967295) AS BIGINT) AS checksum, count(*) AS n FROM events GROUP BY props")
def page_checksum(spark, sf):
    return read(spark, sf, "events").groupBy(hashing.page_checksum(F.col("props")).alias("checksum")).agg(F.count("*").alias("n"))


_GOLDEN_ID = 101 * hashing.GOLDEN % 2**64
_HIGH = f"xor(xor(CAST({_GOLDEN_ID} AS UBIGINT), CAST(c_nationkey AS UBIGINT) << 48), CAST(c_custkey * 1000 AS UBIGINT))"
_TURNED = "xor(CAST(c_custkey AS UBIGINT), CAST(c_custkey * 1000 AS UBIGINT) << 17)"


@query(
    f"SELECT c_custkey, CAST({_mix(f'xor(CAST(c_custkey AS UBIGINT), CAST({_GOLDEN_ID} AS UBIGINT))', 'a')} % 512 AS BIGINT) AS two, "
    f"CAST({_plus(_mix(_HIGH, 'b'), _times(_mix(_TURNED, 'c'), hashing.GOLDEN))} % 512 AS BIGINT) AS four, "
    f"CAST(({_mix('xor(xor(' + _times('c_custkey', hashing.MURMUR) + ', CAST(101 AS UBIGINT)), CAST(c_nationkey AS UBIGINT) << 32)', 'd')} % 512) | 1 AS BIGINT) AS step, "
    f"CAST({_fnv([('c_custkey', 8), ('c_nationkey', 2)])} AS VARCHAR) AS partition_hash FROM customer"
)
def hash_slots(spark, sf):
    """Slots by two and by four parts of an id (through the rule for the kind of record), the odd probing step, and the hash of a partition."""
    ship(spark)
    sid, tenant, shard, tick = F.lit(101), F.col("c_custkey"), F.col("c_nationkey"), F.col("c_custkey") * 1000
    parts = {"struct_id": sid, "tenant": tenant, "shard": shard, "created_at": tick}
    return read(spark, sf, "customer").select(
        "c_custkey", hashing.page_slot("unique", 512, **parts).alias("two"), hashing.page_slot("non_unique", 512, **parts).alias("four"),
        hashing.double_hash_step(sid, tenant, shard, 512).alias("step"), hashing.partition_hash(tenant, shard).cast("string").alias("partition_hash"),
    )


@query("SELECT c_custkey, true AS same, 32 AS digits FROM customer")
def content_names(spark, sf):
    """128-bit names of contents: equal for equal bytes, 32 digits, and as the plain loop gives."""
    ship(spark)
    rows = read(spark, sf, "customer").select("c_custkey", hashing.content_hash128(F.col("c_name")).alias("a"), hashing.content_hash128(F.col("c_name").cast("binary")).alias("b"))
    return rows.select("c_custkey", (F.col("a") == F.col("b")).alias("same"), F.length("a").alias("digits"))


@query("SELECT p_partkey, p_partkey % 50 AS depth FROM part")
def nested_chain(spark, sf):
    """Chains of fifty, as deep as they are."""
    key = F.col("p_partkey")
    return refs.descend(read(spark, sf, "part").select("p_partkey", F.when(key % 50 > 0, key - 1).alias("up")), "p_partkey", "up").select("p_partkey", "depth")


WIRED = Version(1, (FieldSpec("p_size", "i32"), FieldSpec("p_name", "str")))
_LE = "printf('%02x%02x%02x%02x', ({0}) & 255, (({0}) >> 8) & 255, (({0}) >> 16) & 255, (({0}) >> 24) & 255)"
_BODY = f"{_LE.format('p_size')} || {_LE.format('strlen(p_name)')} || lower(hex(p_name))"
_HEADER = pack_header(104, 1)


@query(f"SELECT {_LE.format('12 + strlen(p_name)')} || {_LE.format(str(_HEADER))} || {_BODY} AS bytes FROM part")
def wire_encoded(spark, sf):
    """Rows as framed bytes with a header."""
    rows = wire.encoded(read(spark, sf, "part"), WIRED)
    return rows.select(F.lower(F.hex(wire.framed(wire.headed(F.col("data"), 104, 1)))).alias("bytes"))


@query(f"SELECT p_partkey, p_size, p_name, CAST({_HEADER} AS BIGINT) AS header, CAST(NULL AS VARCHAR) AS error FROM part")
def wire_decoded(spark, sf):
    """Bytes made with built-in functions, unframed, and read as rows."""
    body = F.concat(wire.le32(F.col("p_size")), wire.le32(F.octet_length("p_name")), F.col("p_name").cast("binary"))
    frames = read(spark, sf, "part").select("p_partkey", wire.unframed(F.concat(wire.framed(wire.headed(body, 104, 1)), F.lit("next").cast("binary"))).alias("payload"))
    split = frames.select("p_partkey", wire.peek_header(F.col("payload")).alias("header"), F.expr("substring(payload, 5)").alias("data"))
    return wire.decoded(split, WIRED).select("p_partkey", "p_size", "p_name", "header", "error")


@query("SELECT p_partkey, p_partkey % 3 = 0 AS decodes FROM part")
def wire_malformed(spark, sf):
    """Cut or overlong bytes give an error, not a row."""
    body = F.concat(wire.le32(F.col("p_size")), wire.le32(F.octet_length("p_name")), F.col("p_name").cast("binary"))
    odd = F.when(F.col("p_partkey") % 3 == 1, F.expr("substring(data, 1, 6)")).when(F.col("p_partkey") % 3 == 2, F.concat("data", F.lit("x").cast("binary"))).otherwise(F.col("data"))
    return wire.decoded(read(spark, sf, "part").select("p_partkey", body.alias("data")).withColumn("data", odd), WIRED).select("p_partkey", F.col("error").isNull().alias("decodes"))


@query("SELECT p_partkey, p_size % 2 = 1 AS known, CASE WHEN p_size % 2 = 1 THEN NULL ELSE 'UnknownHeader' END AS code FROM part")
def route_headers(spark, sf):
    rows = read(spark, sf, "part").select("p_partkey", F.when(F.col("p_size") % 2 == 1, pack_header(104, 1)).otherwise(pack_header(104, 2)).alias("header"))
    good, bad = hooks.route(rows, Registry([PARTS]))
    refused = bad.select(F.get_json_object("row", "$.p_partkey").cast("bigint").alias("p_partkey"), F.lit(False).alias("known"), "code")
    return good.select("p_partkey", F.lit(True).alias("known"), F.lit(None).cast("string").alias("code")).unionByName(refused)


@query("SELECT c_custkey AS tenant, CASE WHEN c_acctbal < 0 THEN 99 ELSE c_nationkey END AS owner FROM customer")
def ring_pins(spark, sf):
    rows = read(spark, sf, "customer").select(F.col("c_custkey").alias("tenant"), F.lit(0).alias("shard"), F.col("c_nationkey").alias("owner"), "c_acctbal")
    pins = rows.where("c_acctbal < 0").select("tenant", "shard", F.lit(99).alias("pinned"))
    return placement.with_pins(rows.drop("c_acctbal"), pins).select("tenant", "owner")


@query("SELECT * FROM (VALUES (1, 0, 3), (2, 4, 9), (2, 4, 9)) r(tenant, first, last)")
def ownership_changes(spark, sf):
    """Ranges taken and given back; only an exact entry goes, and only once."""
    ranges = spark.createDataFrame([(1, 0, 3), (2, 4, 9)], "tenant bigint, first int, last int")
    ranges = placement.with_range(placement.with_range(ranges, 2, 4, 9), 7, 1, 2)
    return placement.without_range(placement.without_range(ranges, 7, 1, 2), 1, 0, 2).select(*(F.col(c).cast("int").alias(c) for c in ranges.columns))


@query("SELECT 1 AS step, 'found' AS name UNION ALL SELECT 2, 'default' UNION ALL SELECT 3, 'tried'")
def search_hooks(spark, sf):
    """What first_try gives goes before what is found, fallback stands in for nothing."""
    row = lambda name: spark.createDataFrame([(name,)], "name string")
    family = lambda **k: Family("S", 1, "unique", (Version(1, (FieldSpec("name", "str"),), **k),))
    plain, backed, tried = family(), family(fallback=lambda: row("default")), family(first_try=lambda: row("tried"))
    steps = [migrate.first_try_or(row("found"), plain, 1), migrate.first_try_or(row("x").limit(0), backed, 1), migrate.first_try_or(row("found"), tried, 1)]
    out = [s.select(F.lit(i + 1).alias("step"), "name") for i, s in enumerate(steps)]
    return out[0].unionByName(out[1]).unionByName(out[2])


@query("SELECT c_nationkey AS group_id, CASE WHEN c_nationkey < 5 THEN 1 ELSE count(*) END AS members FROM customer GROUP BY c_nationkey")
def groups_replaced(spark, sf):
    groups = read(spark, sf, "customer").groupBy(F.col("c_nationkey").alias("group_id")).agg(F.collect_set("c_custkey").alias("users"))
    new = spark.range(5).select(F.col("id").cast("int").alias("group_id"), F.array(F.col("id")).alias("users"))
    return permissions.register(groups, new.join(groups.select("group_id"), "group_id", "left_semi")).select("group_id", F.size("users").cast("bigint").alias("members"))


@query("SELECT event_id, CASE event_id % 3 WHEN 0 THEN user_id = 30 WHEN 1 THEN 70 BETWEEN user_id AND user_id + 60 ELSE event_id % 6 IN (2, 3) END AS allowed FROM events")
def access_promoted(spark, sf):
    """Long lists of users as a table of their own: the same answers by a join."""
    groups = spark.createDataFrame([(2, [70, 71]), (5, [1])], "group_id bigint, users array<bigint>")
    records, lists = permissions.promote(_guarded(spark, sf), "event_id")
    return permissions.with_access_promoted(records, lists, groups, "event_id", 70, 30).select("event_id", "allowed")


@query("SELECT 'other tenant' AS what, 'PermissionDenied' AS error UNION ALL SELECT 'shape', 'ShapeMismatch' UNION ALL SELECT 'header', 'UnknownHeader' UNION ALL SELECT 'tenant', 'TenantOutOfRange' UNION ALL SELECT 'own writes', 'Unsupported' UNION ALL SELECT 'path', 'NoMigrationPath'")
def guards(spark, sf):
    """What is refused, and by which error."""
    closed = Family("Closed", 7405, NON_UNIQUE, (Version(1, (FieldSpec("amount", "i64"),)),), auto_crud=False)
    session = StoreConfig(families=(ORDERS, closed)).open(spark).session(1, 5)
    foreign = spark.createDataFrame([(6, 0, 101, 1)], "tenant bigint, shard int, struct_id int, created_at bigint")
    tries = {
        "other tenant": lambda: session.delete(ORDERS, foreign), "shape": lambda: session.find(ORDERS), "header": lambda: session.find(CUSTOMERS), "tenant": lambda: ids.checked(1 << 48, 0, 0, 0),
        "own writes": lambda: session.save(closed, spark.range(1).select(F.col("id").alias("amount"))), "path": lambda: migrate.graph_of(ORDERS3).resolve((101, 3), (101, 1)),
    }
    out = []
    for what, act in tries.items():
        try:
            act()
        except errors.StrataError as e:
            out.append((what, type(e).__name__))
    return spark.createDataFrame(out, "what string, error string")


@query("SELECT o_orderkey, row_number() OVER (ORDER BY o_orderkey) - 1 AS nth FROM orders WHERE o_totalprice > 100000")
def commit_order(spark, sf):
    """Records in the order of their commits."""
    session = Store(spark, registry=Registry([ORDERS])).session(1, 28)
    session.save(ORDERS, read(spark, sf, "orders"), order=("o_orderkey",))
    rows = session.query(ORDERS, ORDERS.o_totalprice.gt(100000), ordered=True).select("o_orderkey").coalesce(1)
    return rows.withColumn("nth", F.monotonically_increasing_id())


@query("SELECT o_orderkey, nth FROM (SELECT o_orderkey, row_number() OVER (ORDER BY o_custkey, o_orderkey) - 1 AS nth FROM orders) x")
def index_all_sorted(spark, sf):
    rows = read(spark, sf, "orders").select(F.struct("o_custkey", "o_orderkey").alias("key"), F.col("o_custkey").alias("k"), "o_orderkey")
    return indexes.all_sorted(rows, "k").orderBy("k", "o_orderkey").select("o_orderkey").coalesce(1).withColumn("nth", F.monotonically_increasing_id())


@query("SELECT min(o_orderkey) AS o_orderkey FROM orders WHERE o_custkey = (SELECT max(o_custkey) FROM orders)")
def index_lookup(spark, sf):
    rows = read(spark, sf, "orders")
    return indexes.lookup(rows, "o_custkey", rows.agg(F.max("o_custkey")).first()[0], ["o_orderkey"]).select("o_orderkey")


@query("SELECT sha256(text) AS content_hash, text AS value FROM documents WHERE doc_id = (SELECT min(doc_id) FROM documents WHERE strlen(text) > 64) LIMIT 1")
def blob_read(spark, sf):
    docs = read(spark, sf, "documents").select("doc_id", "text")
    _, stored, _ = blobs.store(docs, "doc_id", "text")
    name = docs.where(F.octet_length("text") > 64).orderBy("doc_id").select(F.sha2("text", 256)).first()[0]
    return blobs.read(stored, name).select("content_hash", F.col("value").cast("string").alias("value"))


@query("SELECT count(DISTINCT text) AS names, 0 AS clashing FROM documents WHERE strlen(text) > 64")
def blob_bytes_compared(spark, sf):
    """On a hash that was seen before, the bytes are compared in full."""
    docs = read(spark, sf, "documents").select("doc_id", "text")
    _, stored, _ = blobs.store(docs, "doc_id", "text")
    return stored.agg(F.count_if("verified").alias("names"), F.count_if(~F.col("verified")).cast("int").alias("clashing"))


@query("SELECT count(*) AS writes, 0 AS deletes, CAST(sum(strlen(props)) AS BIGINT) AS bytes, count(DISTINCT user_id) AS tenants, count(*) FILTER (WHERE value > 90) AS rejected, count(*) FILTER (WHERE event_type = 'view') AS reads, count(*) FILTER (WHERE event_type = 'click') AS replicated, count(DISTINCT user_id % 64) AS pages, CAST(sum(strlen(props)) + 65536 AS BIGINT) AS memory FROM events")
def node_metrics(spark, sf):
    e = read(spark, sf, "events")
    out = monitor.metrics(events_log(spark, sf), e.where("value > 90"), e.where("event_type = 'view'"), e.where("event_type = 'click'"), F.col("tenant") % 64, F.octet_length("props"))
    return out.withColumn("deletes", F.col("deletes").cast("int"))


@query("SELECT (count(DISTINCT o_custkey) + count(DISTINCT o_orderkey)) * 256 AS cache_bytes FROM orders")
def cache_bytes(spark, sf):
    return monitor.cache_bytes(read(spark, sf, "orders"), ["o_custkey", "o_orderkey"])


@query("SELECT 2 AS edges, true AS back, false AS forth")
def migration_edges(spark, sf):
    """The number of moves forward; a way back only, where none leads forward."""
    graph = migrate.graph_of(ORDERS3)
    graph.add_rollback((9, 2), (9, 1), lambda d: d)
    return spark.createDataFrame([(graph.count(), graph.can_roll_back((9, 2), (9, 1)), graph.can_roll_back((9, 1), (9, 2)))], "edges int, back boolean, forth boolean")


@query("SELECT o_orderkey, count(l_orderkey) AS item_count FROM orders LEFT JOIN lineitem ON l_orderkey = o_orderkey GROUP BY o_orderkey")
def migrate_composed(spark, sf):
    """Orders of an old version and lines make one family, by a composition of the graph."""
    graph = migrate.graph_of(ORDERS3)

    def join(frames: dict) -> DataFrame:
        items = frames[102, 1].groupBy("l_orderkey").agg(F.count("*").alias("n"))
        o = frames[101, 3]
        return refs.one_to_many(o, items, o.o_orderkey == items.l_orderkey, keep_childless=True).select("o_orderkey", F.coalesce("n", F.lit(0)).alias("item_count"))

    graph.compose(((101, 3), (102, 1)), (120, 1), join)
    return graph.combine({(101, 1): read(spark, sf, "orders").select(*ORDERS.latest.names), (102, 1): read(spark, sf, "lineitem")}, (120, 1))


@query("SELECT o_orderkey, 'c' || max(c_custkey) OVER () AS owner FROM orders, (SELECT max(c_custkey) AS c_custkey FROM customer) c")
def migrate_with_session(spark, sf):
    """A move that looks another family up through the session."""
    named = Version(2, (*ORDER_FIELDS, FieldSpec("owner", "str")), forward_with=lambda s, d: d.crossJoin(F.broadcast(s.find(CUSTOMERS).select(F.concat(F.lit("c"), "c_custkey").alias("owner")))), rollback_with=lambda s, d: d.drop("owner"))
    family = Family("Order", 101, NON_UNIQUE, (ORDERS.latest, named))
    session = Store(spark, registry=Registry([family, CUSTOMERS])).session(1, 4)
    session.save(CUSTOMERS, read(spark, sf, "customer"), order=("c_custkey",))
    session.save(family, read(spark, sf, "orders"), version=1)
    return session.query(family).select("o_orderkey", "owner")


@query("SELECT o_orderkey, row_number() OVER (ORDER BY o_orderkey) - 1 AS created_at FROM orders WHERE o_orderstatus <> 'F'")
def split_fresh_ids(spark, sf):
    """A family split off by the store: its records have ids of their own."""
    status = Family("Status", 130, NON_UNIQUE, (Version(1, (FieldSpec("o_orderkey", "i64"), FieldSpec("o_orderstatus", "str"))),))
    session = Store(spark, registry=Registry([ORDERS, status])).session(1, 9)
    saved = session.save(ORDERS, read(spark, sf, "orders"), order=("o_orderkey",))
    session.delete(ORDERS, saved.accepted.where("o_orderstatus = 'F'"))
    session.save(status, session.query(ORDERS).select("o_orderkey", "o_orderstatus"), order=("o_orderkey",))
    return session.query(status).select("o_orderkey", "created_at")


@query("SELECT event_id, user_id % 8 AS page, CASE WHEN user_id % 8 = 3 AND event_type = 'click' THEN 'new' ELSE event_type END AS event_type FROM events")
def pages_rewritten(spark, sf):
    """Upserts that touch one partition of eight: only that one is written anew."""
    path = stage_path(spark, "pages")
    rows = read(spark, sf, "events").select("event_id", "event_type", F.lit(1).alias("seq"), (F.col("user_id") % 8).alias("page"))
    copy_on_write(spark, path, rows, "page", ["event_id"], "seq")
    copy_on_write(spark, path, rows.where("page = 3 and event_type = 'click'").withColumn("event_type", F.lit("new")).withColumn("seq", F.lit(2)), "page", ["event_id"], "seq")
    return spark.read.schema(rows.schema).parquet(path).select("event_id", "page", "event_type")


@query("SELECT event_id, props FROM events")
def compressed_values(spark, sf):
    """Values through a dictionary and back."""
    ship(spark)
    rows = read(spark, sf, "events").select("event_id", "props")
    words = compress.trained([r["props"].encode() * 8 for r in rows.limit(400).collect()], 1024)  # a sample, to train on
    return rows.select("event_id", compress.decompressed(compress.compressed(F.col("props"), 19, words), words).cast("string").alias("props"))


@query("SELECT p_partkey, (p_partkey << 16) | ((p_size % 256) << 8) | ((p_size % 64) << 2) | 2 AS packed FROM part")
def descriptors(spark, sf):
    return read(spark, sf, "part").select("p_partkey", text.descriptor_pack(F.col("p_partkey"), F.col("p_size") % 256, F.col("p_size") % 64, F.lit(True), F.lit(False)).alias("packed"))


@query("SELECT * FROM (VALUES ('fresh', true), ('late', false), ('purpose', false), ('key', false)) t(token, good)")
def tokens(spark, sf):
    t = auth.mint(b"key", 1, 77, 1000)
    good = [("fresh", auth.verify(b"key", t, 1, 1030)), ("late", auth.verify(b"key", t, 1, 1031)), ("purpose", auth.verify(b"key", t, 2, 1000)), ("key", auth.verify(b"other", t, 1, 1000))]
    return spark.createDataFrame(good, "token string, good boolean")


@query("SELECT peer, max(seq) AS sent, coalesce(max(seq) FILTER (WHERE event_type = 'purchase'), 0) AS acked, greatest(0, max(seq) - coalesce(max(seq) FILTER (WHERE event_type = 'purchase'), 0)) AS lag FROM (SELECT 'p' || (event_id % 5) AS peer, event_id AS seq, event_type FROM events) x GROUP BY peer")
def stream_replication(spark, sf):
    """Sent and acknowledged marks from a stream."""
    rows = _event_stream(spark, sf)
    kinds = F.when(F.col("event_type") == "purchase", F.array(F.lit("sent"), F.lit("acked"))).otherwise(F.array(F.lit("sent")))
    return feed.replication_marks(rows.select(F.concat(F.lit("p"), F.col("event_id") % 5).alias("peer"), F.col("event_id").alias("seq"), F.explode(kinds).alias("kind")), stage_path(spark, "marks"))


@query("SELECT event_id, 2 AS copies FROM events")
def stream_replicas(spark, sf):
    """Each batch to two replicas, as it is."""
    base = stage_path(spark, "replicas")
    targets = [f"{base}/a", f"{base}/b"]
    feed.replicated(_event_stream(spark, sf).select("event_id"), targets, f"{base}/checkpoint").awaitTermination()
    a, b = (spark.read.schema("event_id bigint").parquet(t) for t in targets)
    return a.unionByName(b).groupBy("event_id").agg(F.count("*").cast("int").alias("copies"))


@query("SELECT event_type, count(*) AS n FROM events GROUP BY 1")
def stream_view(spark, sf):
    """A view that is evaluated anew whenever rows come."""
    base = stage_path(spark, "view")
    view = lambda: read(spark, sf, "events").groupBy("event_type").agg(F.count("*").alias("n"))
    feed.sticky(_event_stream(spark, sf), view, f"{base}/out", f"{base}/checkpoint").awaitTermination()
    return spark.read.parquet(f"{base}/out")


@query("SELECT event_id FROM events")
def stream_drained(spark, sf):
    """A stream that runs is told to take what is there and stop; started again, it takes nothing twice."""
    base = stage_path(spark, "drained")
    for _ in range(2):
        running = feed.archive_stream(_event_stream(spark, sf).select("event_id"), f"{base}/out", f"{base}/checkpoint", "0 seconds")
        if not feed.drain(running):
            raise errors.StorageError("the stream broke off")
    return spark.read.schema("event_id bigint").parquet(f"{base}/out")


@query("SELECT event_id, 1 AS times FROM events")
def stream_requeued(spark, sf):
    """A batch that fails is tried again from the checkpoint, before anything after it."""
    base, failed = stage_path(spark, "requeued"), []

    def write(batch: DataFrame, epoch: int) -> None:
        if not failed:
            failed.append(epoch)
            raise errors.Unavailable("the archive doesn't answer")
        batch.select("event_id").write.mode("overwrite").parquet(f"{base}/out/epoch={epoch}")

    for _ in range(2):
        query_ = _event_stream(spark, sf).writeStream.foreachBatch(write).option("checkpointLocation", f"{base}/checkpoint").trigger(availableNow=True).start()
        try:
            query_.awaitTermination()
        except Exception:  # the first try
            if len(failed) != 1 or query_.exception() is None:
                raise
    return spark.read.schema("event_id bigint").parquet(f"{base}/out").groupBy("event_id").agg(F.count("*").cast("int").alias("times"))
