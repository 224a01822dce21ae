"""Registered queries over the test tables, each with the SQL that gives the same rows.

The tables stand for families: customer is unique (a tenant each), orders and events have many records, lineitem and the turns of conversations
are nested, documents hold large values.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from strata.functions import hashing, ids, text
from strata.operators import blobs, history, indexes, live, monitor, permissions, placement, refs
from strata.plans import hooks, migrate
from strata.plans.expr import All, Expr, compile_expr, field, from_json, to_json
from strata.runtime import ship, stage_path
from strata.schema import NESTED, NON_UNIQUE, UNIQUE, Family, FieldSpec, Registry, Version
from strata.store import Store
from strata.streaming import feed

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
SQL: dict[str, str] = {}


def query(sql: str | None) -> Callable[[Query], Query]:
    def add(f: Query) -> Query:
        QUERIES[f.__name__] = f
        if sql is not None:
            SQL[f.__name__] = sql
        return f

    return add


def read(spark: SparkSession, sf: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf}/{name}.parquet")


def _fields(**kinds: str) -> tuple[FieldSpec, ...]:
    return tuple(FieldSpec(k, v) for k, v in kinds.items())


ORDER_FIELDS = _fields(o_orderkey="i64", o_custkey="i64", o_orderstatus="str", o_totalprice="f64", o_orderpriority="str")
ORDERS = Family("Order", 101, NON_UNIQUE, (Version(1, ORDER_FIELDS),), primary_anchor=("o_orderkey",), secondary_anchors=(("o_custkey", "o_orderpriority"), ("o_orderstatus",)))
CUSTOMERS = Family("Customer", 100, UNIQUE, (Version(1, _fields(c_custkey="i64", c_name="str", c_acctbal="f64", c_mktsegment="str")),))
LINES = Family("Line", 102, NESTED, (Version(1, _fields(l_orderkey="i64", l_partkey="i64", l_suppkey="i64", l_linenumber="i32", l_quantity="f64")),), parent="Order")
EVENTS = Family("Event", 103, NON_UNIQUE, (Version(1, _fields(event_id="i64", user_id="i64", event_type="str", value="f64", props="str")),))
LAST_EVENT = Family("LastEvent", 103, UNIQUE, EVENTS.versions)
PARTS = Family("Part", 104, NON_UNIQUE, (Version(1, _fields(p_partkey="i64", p_name="str", p_brand="str", p_size="i32", p_retailprice="f64")),))


def as_log(df: DataFrame, family: Family, tenant: str, key: str) -> DataFrame:
    """A table as a log of writes: the tenant's column, and the key as creation tick and sequence number."""
    system = [F.lit(family.struct_id).alias("struct_id"), F.lit(1).alias("version"), F.col(tenant).cast("bigint").alias("tenant"), F.lit(0).alias("shard"), F.col(key).cast("bigint").alias("created_at"), F.lit("U").alias("op"), F.col(key).cast("bigint").alias("seq")]
    return df.select(*system, *family.latest.names)


def orders_log(spark: SparkSession, sf: str) -> DataFrame:
    return as_log(read(spark, sf, "orders"), ORDERS, "o_custkey", "o_orderkey")


def events_log(spark: SparkSession, sf: str) -> DataFrame:
    return as_log(read(spark, sf, "events"), EVENTS, "user_id", "event_id")


def with_deletes(log: DataFrame) -> DataFrame:
    """An error takes back the id before it, if it is its own tenant's."""
    marks = log.where("event_type = 'error'").withColumn("created_at", F.col("created_at") - 1).withColumn("op", F.lit("D"))
    return log.unionByName(marks)


def filtered(spark: SparkSession, sf: str, name: str, family: Family, expr: Expr) -> DataFrame:
    return read(spark, sf, name).where(compile_expr(expr, family.latest))


def _compare(op: str, sign: str) -> None:
    def run(spark: SparkSession, sf: str) -> DataFrame:
        return filtered(spark, sf, "orders", ORDERS, getattr(ORDERS.o_totalprice, op)(100000)).select("o_orderkey", "o_totalprice")

    QUERIES[f"filter_{op}"] = run
    SQL[f"filter_{op}"] = f"SELECT o_orderkey, o_totalprice FROM orders WHERE o_totalprice {sign} 100000"


for _op, _sign in (("gt", ">"), ("gte", ">="), ("lt", "<"), ("lte", "<="), ("ne", "<>")):
    _compare(_op, _sign)


@query("SELECT o_orderkey, o_orderstatus FROM orders WHERE o_orderstatus = 'F'")
def filter_eq(spark, sf):
    return filtered(spark, sf, "orders", ORDERS, ORDERS.o_orderstatus.eq("F")).select("o_orderkey", "o_orderstatus")


@query("SELECT o_orderkey, o_custkey, o_orderstatus, o_totalprice FROM orders WHERE o_totalprice > 100000 AND NOT (o_orderstatus = 'F')")
def flagship(spark, sf):
    return filtered(spark, sf, "orders", ORDERS, ORDERS.o_totalprice.gt(100000) & ~ORDERS.o_orderstatus.eq("F")).select("o_orderkey", "o_custkey", "o_orderstatus", "o_totalprice")


@query("SELECT o_orderkey FROM orders")
def filter_all(spark, sf):
    return filtered(spark, sf, "orders", ORDERS, All()).select("o_orderkey")


@query("SELECT o_orderkey FROM orders WHERE (o_totalprice > 150000 OR o_orderstatus = 'O') AND NOT (o_orderpriority = '1-URGENT' AND o_totalprice <= 200000) AND NOT (NOT (o_orderkey >= 10))")
def filter_and_or_not(spark, sf):
    o = ORDERS
    expr = (o.o_totalprice.gt(150000) | o.o_orderstatus.eq("O")) & ~(o.o_orderpriority.eq("1-URGENT") & o.o_totalprice.lte(200000)) & ~~o.o_orderkey.gte(10)
    return filtered(spark, sf, "orders", o, expr).select("o_orderkey")


@query("SELECT o_orderkey FROM orders WHERE o_totalprice < 50000 OR o_orderstatus <> 'O'")
def filter_from_json(spark, sf):
    expr = from_json(to_json(ORDERS.o_totalprice.lt(50000) | ORDERS.o_orderstatus.ne("O")))
    return filtered(spark, sf, "orders", ORDERS, expr).select("o_orderkey")


def _with_nulls(spark, sf):
    return read(spark, sf, "events").withColumn("value", F.when(F.col("event_type") == "click", F.lit(None)).otherwise(F.col("value")))


_NULLED = "(SELECT event_id, event_type, CASE WHEN event_type = 'click' THEN NULL ELSE value END AS value FROM events)"


@query(f"SELECT event_id, 'not_gt' AS rule FROM {_NULLED} WHERE NOT coalesce(value > 50, false) UNION ALL SELECT event_id, 'ne' FROM {_NULLED} WHERE value <> 50 UNION ALL SELECT event_id, 'not_ne' FROM {_NULLED} WHERE NOT coalesce(value <> 50, false)")
def filter_not_null_semantics(spark, sf):
    rows, v = _with_nulls(spark, sf), EVENTS.value
    one = lambda name, e: rows.where(compile_expr(e, EVENTS.latest)).select("event_id", F.lit(name).alias("rule"))
    return one("not_gt", ~v.gt(50)).unionByName(one("ne", v.ne(50))).unionByName(one("not_ne", ~v.ne(50)))


_NAN = "(SELECT event_id, CASE WHEN event_id % 7 = 0 THEN 'NaN'::DOUBLE WHEN event_id % 11 = 0 THEN NULL ELSE value END AS v FROM events)"
_NAN_RULES = {"eq": "v = 50", "ne": "v <> 50", "gt": "v > 50", "gte": "v >= 50", "lt": "v < 50", "lte": "v <= 50"}


@query(" UNION ALL ".join(f"SELECT event_id, '{k}' AS rule FROM {_NAN} WHERE coalesce({r} AND NOT isnan(v), false) UNION ALL SELECT event_id, 'not_{k}' FROM {_NAN} WHERE NOT coalesce({r} AND NOT isnan(v), false)" for k, r in _NAN_RULES.items()))
def filter_nan_semantics(spark, sf):
    v = F.when(F.col("event_id") % 7 == 0, F.lit(float("nan"))).when(F.col("event_id") % 11 == 0, F.lit(None)).otherwise(F.col("value"))
    rows, out = read(spark, sf, "events").withColumn("value", v), None
    for op in _NAN_RULES:
        for name, e in ((op, getattr(EVENTS.value, op)(50)), (f"not_{op}", ~getattr(EVENTS.value, op)(50))):
            part = rows.where(compile_expr(e, EVENTS.latest)).select("event_id", F.lit(name).alias("rule"))
            out = part if out is None else out.unionByName(part)
    return out


@query("SELECT o_orderkey FROM orders")
def filter_unknown_field(spark, sf):
    """No row matches a field that isn't there; so all match the negation."""
    return filtered(spark, sf, "orders", ORDERS, ~field("nowhere").eq(1) & ~field("nowhere").ne(1)).select("o_orderkey")


@query("SELECT o_orderkey FROM orders WHERE false")
def filter_type_mismatch(spark, sf):
    return filtered(spark, sf, "orders", ORDERS, ORDERS.o_orderkey.ne("text") | ORDERS.o_orderstatus.gt(1)).select("o_orderkey")


@query("SELECT p_partkey FROM part WHERE (p_size > 24.5 AND p_size <= 40) OR p_size = 3")
def filter_cross_width(spark, sf):
    size = PARTS.p_size
    return filtered(spark, sf, "part", PARTS, size.gt(24.5) & size.lte(40.0) & size.lt(1 << 40) | size.eq(3.0) | size.eq(7.5)).select("p_partkey")


@query("SELECT p_partkey, p_name FROM part WHERE p_name >= 'm' AND p_name < 't'")
def filter_string_order(spark, sf):
    return filtered(spark, sf, "part", PARTS, PARTS.p_name.gte("m") & PARTS.p_name.lt("t")).select("p_partkey", "p_name")


@query("SELECT event_id, user_id AS tenant FROM events")
def live_scan(spark, sf):
    return live.live(events_log(spark, sf), EVENTS).select("event_id", "tenant")


_LIVE = "SELECT e.* FROM events e WHERE NOT EXISTS (SELECT 1 FROM events d WHERE d.event_type = 'error' AND d.user_id = e.user_id AND d.event_id - 1 = e.event_id)"


@query(f"SELECT event_id, user_id AS tenant, event_type FROM ({_LIVE}) x")
def live_after_delete(spark, sf):
    return live.live(with_deletes(events_log(spark, sf)), EVENTS).select("event_id", "tenant", "event_type")


@query(f"SELECT event_id, event_type FROM ({_LIVE}) x WHERE user_id = 7 AND value > 20")
def filtered_live_scan(spark, sf):
    rows = live.live(with_deletes(events_log(spark, sf)), EVENTS, 7)
    return rows.where(compile_expr(EVENTS.value.gt(20), EVENTS.latest)).select("event_id", "event_type")


@query("SELECT user_id AS tenant, event_id, event_type FROM events QUALIFY row_number() OVER (PARTITION BY user_id ORDER BY event_id DESC) = 1")
def unique_latest(spark, sf):
    return live.live(events_log(spark, sf), LAST_EVENT).select("tenant", "event_id", "event_type")


@query("SELECT e.user_id AS tenant, e.event_id FROM (SELECT * FROM events QUALIFY row_number() OVER (PARTITION BY user_id ORDER BY event_id DESC) = 1) e WHERE NOT EXISTS (SELECT 1 FROM events d WHERE d.event_type = 'error' AND d.user_id = e.user_id AND d.event_id - 1 = e.event_id)")
def unique_latest_deleted(spark, sf):
    return live.live(with_deletes(events_log(spark, sf)), LAST_EVENT).select("tenant", "event_id")


@query("SELECT event_id, event_type, value FROM events WHERE user_id = 42 ORDER BY event_id DESC LIMIT 1")
def unique_find_tenant(spark, sf):
    return live.live(events_log(spark, sf), LAST_EVENT, 42).select("event_id", "event_type", "value")


@query("SELECT event_id, event_type FROM events WHERE user_id = (SELECT user_id FROM events WHERE event_id = 500) AND event_id = 500")
def get_by_id(spark, sf):
    log = events_log(spark, sf)
    tenant = log.where("created_at = 500").select("tenant").first()
    return live.by_id(log, tenant[0] if tenant else -1, 0, 103, 500).select("event_id", "event_type")


@query("SELECT event_id, user_id AS tenant FROM events WHERE user_id = 11 ORDER BY event_id LIMIT 1")
def get_by_anchor(spark, sf):
    return live.by_anchor(live.live(events_log(spark, sf), EVENTS), 11, 0, 103).select("event_id", "tenant")


_HEX = "lower(printf('%012x%03x%05x%012x', {0}, {1}, {2}, {3}))"


@query("SELECT o_orderkey, " + _HEX.format("o_custkey", "o_orderkey % 4095", "101", "o_orderkey") + " AS id_hex FROM orders")
def id_pack_hex(spark, sf):
    return read(spark, sf, "orders").select("o_orderkey", ids.id_hex("o_custkey", F.col("o_orderkey") % 4095, 101, "o_orderkey").alias("id_hex"))


@query("SELECT o_orderkey, o_custkey AS tenant, o_orderkey % 4095 AS shard, CAST(101 AS BIGINT) AS struct_id, o_orderkey AS created_at FROM orders")
def id_unpack(spark, sf):
    packed = read(spark, sf, "orders").withColumn("id", ids.id_bytes("o_custkey", F.col("o_orderkey") % 4095, 101, "o_orderkey"))
    return packed.select("o_orderkey", *(ids.part_of(p, "id").alias(p) for p in ids.ID_COLUMNS))


@query("SELECT o_orderkey, " + _HEX.format("(o_orderkey + 281474976710656) % 281474976710656", "o_orderkey % 4096", "o_orderkey % 1048576", "o_custkey") + " AS id_hex FROM orders")
def id_truncation(spark, sf):
    return read(spark, sf, "orders").select("o_orderkey", ids.id_hex(F.col("o_orderkey") + (1 << 48), F.col("o_orderkey"), F.col("o_orderkey") + (3 << 20), "o_custkey").alias("id_hex"))


@query("SELECT o_orderkey, 'Id(t=' || o_custkey || ', s=0, sid=101, c=' || o_orderkey || ')' AS id_text FROM orders")
def id_text(spark, sf):
    return read(spark, sf, "orders").select("o_orderkey", ids.id_text("o_custkey", 0, 101, "o_orderkey").alias("id_text"))


@query("SELECT DISTINCT " + _HEX.format("o_custkey", "0", "101", "0") + " AS anchor, " + _HEX.format("o_custkey", "0", "101", "0") + " AS again FROM orders")
def anchor_key(spark, sf):
    rows = read(spark, sf, "orders").select(ids.anchor_hex("o_custkey", 0, 101).alias("anchor"), ids.anchor_of_hex(ids.id_hex("o_custkey", 0, 101, "o_orderkey")).alias("again"))
    return rows.distinct()


@query("SELECT p_partkey, p_partkey * 256 + p_size AS header, p_partkey AS struct_id, CAST(p_size AS BIGINT) AS version FROM part")
def header_pack(spark, sf):
    rows = read(spark, sf, "part").select("p_partkey", ids.header("p_partkey", "p_size").alias("header"))
    return rows.select("p_partkey", "header", ids.header_struct("header").alias("struct_id"), ids.header_version("header").alias("version"))


@query("SELECT o_orderkey, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderkey) AS nth FROM orders")
def id_order(spark, sf):
    rows = read(spark, sf, "orders").withColumn("id", ids.id_bytes("o_custkey", 0, 101, "o_orderkey"))
    return rows.select("o_orderkey", F.row_number().over(Window.partitionBy("o_custkey").orderBy("id")).cast("bigint").alias("nth"))


@query("SELECT o_orderkey FROM orders WHERE o_custkey = 21")
def tenant_range_scan(spark, sf):
    rows = read(spark, sf, "orders").withColumn("id", ids.id_bytes("o_custkey", 0, 101, "o_orderkey"))
    return live.key_range(rows, F.col("id"), *live.tenant_range(21)).select("o_orderkey")


@query("SELECT event_id, CAST(floor(epoch_us(ts) / 100) AS BIGINT) AS tick FROM events")
def ticks(spark, sf):
    return read(spark, sf, "events").select("event_id", ids.tick_of("ts").alias("tick"))


@query("SELECT event_id FROM events WHERE event_id > (SELECT max(event_id) FROM events WHERE event_type = 'signup')")
def entries_since_checkpoint(spark, sf):
    log = read(spark, sf, "events").select(F.col("event_id").alias("seq"), F.when(F.col("event_type") == "signup", "C").otherwise("U").alias("op"))
    return live.since_checkpoint(log).select(F.col("seq").alias("event_id"))


@query("SELECT o_orderkey, CASE WHEN o_orderpriority = '1-URGENT' THEN 'new' ELSE o_orderstatus END AS o_orderstatus FROM orders WHERE o_orderstatus <> 'P' OR o_orderpriority = '1-URGENT'")
def merge_on_read(spark, sf):
    rows = read(spark, sf, "orders")
    base = rows.select("o_orderkey", "o_orderstatus", F.lit(0).alias("at"))
    gone = rows.where("o_orderstatus = 'P'").select("o_orderkey", "o_orderstatus", F.lit(1).alias("at"), F.lit(True).alias("deleted"))
    new = rows.where("o_orderpriority = '1-URGENT'").select("o_orderkey", F.lit("new").alias("o_orderstatus"), F.lit(2).alias("at"), F.lit(False).alias("deleted"))
    return live.merge_on_read(base, gone.unionByName(new), ["o_orderkey"], "at").select("o_orderkey", "o_orderstatus")


@query("SELECT o.o_orderkey, c_name FROM customer JOIN (SELECT o_custkey, max(o_orderkey) AS o_orderkey FROM orders GROUP BY 1) o ON o.o_custkey = c_custkey")
def join_1_1(spark, sf):
    """Each customer and its newest order, which refers back."""
    newest = live.newest(orders_log(spark, sf), ["tenant"], ["created_at"]).select("o_orderkey", "o_custkey", "tenant")
    c = read(spark, sf, "customer")
    return refs.one_to_one(newest, c, newest.o_custkey == c.c_custkey, newest.tenant == c.c_custkey).select("o_orderkey", "c_name")


@query("SELECT n_name, c_custkey FROM nation LEFT JOIN customer ON c_nationkey = n_nationkey AND c_acctbal > 9000")
def join_1_n(spark, sf):
    n, c = read(spark, sf, "nation"), read(spark, sf, "customer").where("c_acctbal > 9000")
    return refs.one_to_many(n, c, c.c_nationkey == n.n_nationkey, keep_childless=True).select("n_name", "c_custkey")


@query("SELECT DISTINCT p_partkey, s_suppkey FROM part JOIN lineitem ON p_partkey = l_partkey JOIN supplier ON l_suppkey = s_suppkey")
def join_m_n(spark, sf):
    p, li, s = read(spark, sf, "part"), read(spark, sf, "lineitem").select("l_partkey", "l_suppkey"), read(spark, sf, "supplier")
    return refs.many_to_many(p, li, s, p.p_partkey == li.l_partkey, li.l_suppkey == s.s_suppkey).select("p_partkey", "s_suppkey").distinct()


@query("SELECT c_custkey FROM customer WHERE c_custkey IN (SELECT o_custkey FROM orders WHERE o_totalprice > 300000)")
def semi_membership(spark, sf):
    c, o = read(spark, sf, "customer"), read(spark, sf, "orders").where("o_totalprice > 300000")
    return refs.members(c, o, c.c_custkey == o.o_custkey).select("c_custkey")


@query("SELECT s_suppkey, n_nationkey FROM supplier JOIN nation ON s_nationkey = n_nationkey OR s_suppkey % 25 = n_nationkey")
def join_disjunctive(spark, sf):
    s, n = read(spark, sf, "supplier"), read(spark, sf, "nation")
    return refs.any_of(s, n, [s.s_nationkey == n.n_nationkey, s.s_suppkey % 25 == n.n_nationkey], ["s_suppkey"], ["n_nationkey"]).select("s_suppkey", "n_nationkey")


@query("SELECT o_orderkey FROM orders WHERE NOT EXISTS (SELECT 1 FROM customer WHERE o_custkey = c_custkey AND c_acctbal > 0)")
def orphan_anti(spark, sf):
    c, o = read(spark, sf, "customer").where("c_acctbal > 0"), read(spark, sf, "orders")
    return refs.orphans(o, c, c.c_custkey == o.o_custkey).select("o_orderkey")


@query("SELECT l_orderkey, string_agg(l_linenumber || ':' || l_partkey, ',' ORDER BY l_linenumber, l_partkey) AS lines FROM lineitem GROUP BY l_orderkey")
def nested_collect(spark, sf):
    nested = refs.nest(read(spark, sf, "lineitem"), ["l_orderkey"], ["l_linenumber", "l_partkey"], [])
    return nested.select("l_orderkey", F.array_join(F.transform("children", lambda x: F.concat_ws(":", x["l_linenumber"], x["l_partkey"])), ",").alias("lines"))


@query("SELECT o_custkey, count(DISTINCT o_orderkey) AS orders, count(l_orderkey) AS lines FROM orders LEFT JOIN lineitem ON l_orderkey = o_orderkey GROUP BY o_custkey")
def nested_two_level(spark, sf):
    lines = refs.nest(read(spark, sf, "lineitem"), ["l_orderkey"], ["l_linenumber"], ["l_partkey"], "lines")
    o = read(spark, sf, "orders")
    both = refs.one_to_many(o, lines, o.o_orderkey == lines.l_orderkey, keep_childless=True)
    return both.groupBy("o_custkey").agg(F.count("*").alias("orders"), F.sum(F.coalesce(F.size("lines"), F.lit(0))).alias("lines"))


@query("SELECT conv_id, turn, role FROM conversations")
def nested_unnest(spark, sf):
    return refs.unnest(refs.nest(read(spark, sf, "conversations"), ["conv_id"], ["turn"], ["role"])).select("conv_id", "turn", "role")


@query("SELECT o_orderkey, CASE WHEN c_mktsegment = 'BUILDING' THEN 'c' || o_custkey ELSE 'x' || o_custkey END AS ref FROM orders LEFT JOIN customer ON c_custkey = o_custkey")
def secondary_anchor(spark, sf):
    rows = read(spark, sf, "orders").select("o_orderkey", F.concat(F.lit("x"), "o_custkey").alias("ref"))
    names = read(spark, sf, "customer").where("c_mktsegment = 'BUILDING'").select(F.concat(F.lit("x"), "c_custkey").alias("alias"), F.concat(F.lit("c"), "c_custkey").alias("primary"))
    return refs.resolve_alias(rows, names, "ref", "alias", "primary")


@query("SELECT n_nationkey, 1 AS depth FROM nation UNION ALL SELECT 100 + r_regionkey, 0 FROM region")
def nested_depth(spark, sf):
    top = read(spark, sf, "region").select((F.col("r_regionkey") + 100).alias("n_nationkey"), F.lit(None).cast("int").alias("up"))
    nodes = top.unionByName(read(spark, sf, "nation").select("n_nationkey", (F.col("n_regionkey") + 100).alias("up")))
    return refs.descend(nodes, "n_nationkey", "up").select("n_nationkey", "depth")


@query("SELECT event_id, coalesce(lag(event_id) OVER w, 0) AS old_id, coalesce(lead(event_id) OVER w, 0) AS new_id FROM events WINDOW w AS (PARTITION BY user_id ORDER BY event_id)")
def version_chain(spark, sf):
    return live.version_chain(events_log(spark, sf)).select("event_id", F.coalesce("old_id", F.lit(0)).alias("old_id"), F.coalesce("new_id", F.lit(0)).alias("new_id"))


@query("SELECT user_id AS tenant, count(*) FILTER (WHERE p IS NULL) AS firsts, count(*) FILTER (WHERE n IS NULL) AS live FROM (SELECT user_id, lag(event_id) OVER w AS p, lead(event_id) OVER w AS n FROM events WINDOW w AS (PARTITION BY user_id ORDER BY event_id)) x GROUP BY user_id")
def chain_flags(spark, sf):
    return live.version_chain(events_log(spark, sf)).groupBy("tenant").agg(F.count_if("is_first").alias("firsts"), F.count_if("is_live").alias("live"))


@query("SELECT user_id AS tenant, event_id, event_type FROM events WHERE event_id <= 5000 QUALIFY row_number() OVER (PARTITION BY user_id ORDER BY event_id DESC) = 1")
def as_of(spark, sf):
    return live.as_of(events_log(spark, sf), LAST_EVENT, 5000).select("tenant", "event_id", "event_type")


@query("SELECT event_type AS bucket, segment, count(*) AS ids FROM (SELECT event_type, (row_number() OVER (PARTITION BY event_type ORDER BY event_id) - 1) // 256 AS segment FROM events) x GROUP BY 1, 2")
def live_segments(spark, sf):
    return live.segments(events_log(spark, sf), ("event_type",)).groupBy(F.col("event_type").alias("bucket"), "segment").agg(F.count("*").alias("ids"))


@query("SELECT DISTINCT user_id AS tenant, event_id AS created_at FROM events")
def rebuild_union_dedup(spark, sf):
    """Two lists that overlap, each without what the other alone has."""
    log = events_log(spark, sf)
    return live.rebuild(log.where("event_type <> 'view'"), log.where("event_type <> 'click'")).select("tenant", "created_at")


def _archive(spark, sf):
    return read(spark, sf, "events").select(F.col("user_id").alias("tenant"), F.concat(F.lit("r"), F.col("event_id") % 977).alias("record_id"), F.col("props").alias("data"), F.col("event_id").alias("write_seq"), F.lit(103).alias("struct_id"), (F.col("event_id") % 3 + 1).alias("version"))


_ARCHIVE = "(SELECT user_id AS tenant, 'r' || (event_id % 977) AS record_id, props AS data, event_id AS write_seq, event_id % 3 + 1 AS version FROM events QUALIFY row_number() OVER (PARTITION BY user_id, event_id % 977 ORDER BY event_id DESC) = 1)"


@query(f"SELECT tenant, record_id, write_seq FROM {_ARCHIVE} a")
def flush_idempotent(spark, sf):
    rows = _archive(spark, sf)
    empty = rows.limit(0)
    once = history.apply_flush(empty, rows)
    return history.apply_flush(once, rows.where("version = 2")).select("tenant", "record_id", "write_seq")


@query(f"SELECT tenant, record_id, write_seq, data FROM {_ARCHIVE} a WHERE tenant = (SELECT user_id FROM events WHERE event_id = 500) AND record_id = 'r500'")
def history_get(spark, sf):
    rows = _archive(spark, sf)
    return history.history_get(history.deduplicated(rows), rows.where("write_seq = 500").first()["tenant"], "r500").select("tenant", "record_id", "write_seq", "data")


@query(f"SELECT tenant, count(*) AS record_count, CAST(sum(strlen(data)) AS BIGINT) AS total_bytes FROM {_ARCHIVE} a GROUP BY tenant")
def tenant_summaries(spark, sf):
    return history.tenant_summaries(history.deduplicated(_archive(spark, sf)))


@query("SELECT count(DISTINCT user_id) AS tenants FROM events")
def tenant_count(spark, sf):
    return history.tenant_count(_archive(spark, sf))


@query(f"SELECT count(*) AS records, CAST(sum(strlen(data) + 24) AS BIGINT) AS index_bytes FROM {_ARCHIVE} a")
def index_bytes(spark, sf):
    return history.index_size(history.deduplicated(_archive(spark, sf)))


@query("SELECT max(event_id) AS flushes FROM events")
def flush_count(spark, sf):
    return history.flush_count(_archive(spark, sf))


@query("SELECT user_id AS tenant, max(event_id) AS high_water FROM events GROUP BY user_id")
def high_water(spark, sf):
    return history.high_water(_archive(spark, sf))


@query(f"SELECT tenant, record_id, CAST(strlen(data) AS BIGINT) AS data_bytes, write_seq, CAST(103 * 256 + version AS BIGINT) AS header FROM {_ARCHIVE} a QUALIFY row_number() OVER (PARTITION BY tenant ORDER BY record_id) <= 10")
def record_summaries_capped(spark, sf):
    return history.record_summaries(history.deduplicated(_archive(spark, sf)), None, 10)[0]


@query(f"SELECT tenant, count(*) > 60 AS truncated FROM {_ARCHIVE} a GROUP BY tenant")
def record_summaries_truncated(spark, sf):
    return history.record_summaries(history.deduplicated(_archive(spark, sf)), None, 60)[1]


@query("SELECT event_id FROM events WHERE event_id > 9000")
def retention(spark, sf):
    return history.retained(events_log(spark, sf), 9000).select("event_id")


@query("SELECT event_id, user_id AS tenant FROM events")
def compaction(spark, sf):
    return history.compacted(events_log(spark, sf), 4).select("event_id", "tenant")


@query("SELECT user_id AS tenant, b AS batch, count(*) AS records FROM (SELECT user_id, (row_number() OVER (PARTITION BY user_id ORDER BY event_id) - 1) // 20 AS b FROM events) x GROUP BY 1, 2")
def flush_batches(spark, sf):
    return history.flush_batches(events_log(spark, sf), 20).groupBy("tenant", "batch").agg(F.count("*").alias("records"))


@query("SELECT count(*) AS drained FROM events WHERE event_id > (SELECT max(event_id) FROM events WHERE event_type = 'signup')")
def drain(spark, sf):
    rows = _archive(spark, sf).join(read(spark, sf, "events").select(F.col("event_id").alias("write_seq"), "event_type"), "write_seq")
    log = rows.withColumn("seq", F.col("write_seq")).withColumn("op", F.when(F.col("event_type") == "signup", "C").otherwise("U"))
    return history.drained(_archive(spark, sf).limit(0), log)[1]


_ACKS = "(SELECT 'p' || (event_id % 5) AS peer, event_id AS seq, event_type FROM events)"


def _acks(spark, sf):
    return read(spark, sf, "events").select(F.concat(F.lit("p"), F.col("event_id") % 5).alias("peer"), F.col("event_id").alias("seq"), "event_type")


@query(f"SELECT s.peer, s.sent, coalesce(a.acked, 0) AS acked, greatest(0, s.sent - coalesce(a.acked, 0)) AS lag FROM (SELECT peer, max(seq) AS sent FROM {_ACKS} x GROUP BY peer) s LEFT JOIN (SELECT peer, max(seq) AS acked FROM {_ACKS} y WHERE event_type = 'purchase' AND peer <> 'p3' GROUP BY peer) a ON s.peer = a.peer")
def replication_lag(spark, sf):
    a = _acks(spark, sf)
    return history.lag_behind(a, a.where("event_type = 'purchase' and peer <> 'p3'"))


@query(f"SELECT coalesce(min(acked) >= 50, true) AS fully_replicated FROM (SELECT peer, max(seq) AS acked FROM {_ACKS} x GROUP BY peer) y")
def fully_replicated(spark, sf):
    return history.fully_replicated(_acks(spark, sf), 50)


@query(f"SELECT peer, max(seq) AS acked FROM {_ACKS} x GROUP BY peer")
def watermark_snapshot(spark, sf):
    return history.watermarks(_acks(spark, sf))


_M = "(CAST(9223372036854775808 AS UHUGEINT) * 2)"


def _mixed(more: int) -> str:
    """z such that xor(z, z >> 31) is mix64 of o_orderkey with more in it."""
    return f"(SELECT o_orderkey, z FROM (SELECT o_orderkey, a, CAST((CAST(xor(a, a >> 27) AS UHUGEINT) * CAST({hashing.SPLITMIX[1]} AS UHUGEINT)) % {_M} AS UBIGINT) AS z FROM (SELECT o_orderkey, CAST((CAST(xor(x, x >> 30) AS UHUGEINT) * CAST({hashing.SPLITMIX[0]} AS UHUGEINT)) % {_M} AS UBIGINT) AS a FROM (SELECT o_orderkey, xor(CAST(o_orderkey AS UBIGINT), CAST({hashing.GOLDEN ^ more} AS UBIGINT)) AS x FROM orders) p) q) r)"


@query(f"SELECT o_orderkey, CAST(xor(z, z >> 31) AS VARCHAR) AS mixed FROM {_mixed(0)} s")
def mix64(spark, sf):
    ship(spark)
    return read(spark, sf, "orders").select("o_orderkey", hashing.mix64(F.col("o_orderkey")).cast("string").alias("mixed"))


@query(f"SELECT CAST(xor(z, z >> 31) % 512 AS BIGINT) AS slot, CAST(count(*) * 8 AS BIGINT) AS bytes FROM {_mixed(101 * hashing.GOLDEN % 2**64)} s GROUP BY 1")
def heat_map(spark, sf):
    """Slots by struct id and tenant."""
    ship(spark)
    return monitor.heat_map(read(spark, sf, "orders"), hashing.tuple2_slot(F.lit(101), F.col("o_orderkey"), 512), F.lit(8))


def _heat(spark, sf):
    return monitor.heat_map(read(spark, sf, "orders"), F.col("o_custkey") % 512, F.round("o_totalprice").cast("bigint"))


_HEAT = "(SELECT o_custkey % 512 AS slot, CAST(sum(CAST(round(o_totalprice) AS BIGINT)) AS BIGINT) AS bytes FROM orders GROUP BY 1)"


@query(f"SELECT slot, bytes, CAST(CASE WHEN bytes = 0 THEN 0 ELSE greatest(1, least(255, bytes * 255 // (SELECT max(bytes) FROM {_HEAT} m))) END AS INTEGER) AS level FROM {_HEAT} h")
def heat_map_scaled(spark, sf):
    return monitor.scaled(_heat(spark, sf))


@query(f"SELECT count(*) FILTER (WHERE bytes > 0) AS touched FROM {_HEAT} h")
def touched_slots(spark, sf):
    return monitor.touched(_heat(spark, sf))


@query(f"SELECT slot, bytes, CAST(rank() OVER (ORDER BY bytes DESC) AS INTEGER) AS rank FROM {_HEAT} h")
def hot_first(spark, sf):
    return monitor.hottest(_heat(spark, sf))


@query(f"SELECT count(*) FILTER (WHERE bytes > 0) / 512.0::DOUBLE AS fill FROM {_HEAT} h")
def page_fill(spark, sf):
    return monitor.page_fill(_heat(spark, sf), 512)


_TOTALS = "(SELECT event_type, minute, CAST(sum(n) OVER (PARTITION BY event_type ORDER BY minute) AS BIGINT) AS total FROM (SELECT event_type, CAST(floor(epoch_us(ts) / 3600000000) AS BIGINT) AS minute, count(*) AS n FROM events GROUP BY 1, 2) x)"


def _totals(spark, sf):
    hours = read(spark, sf, "events").groupBy("event_type", F.floor(ids.tick_of("ts") / 36_000_000).alias("minute")).agg(F.count("*").alias("n"))
    return hours.select("event_type", "minute", F.sum("n").over(Window.partitionBy("event_type").orderBy("minute")).alias("total"))


@query(f"SELECT event_type, minute, total, greatest(0, total - coalesce(lag(total) OVER (PARTITION BY event_type ORDER BY minute), 0)) AS delta FROM {_TOTALS} t")
def throughput_delta(spark, sf):
    return monitor.deltas(_totals(spark, sf), ["event_type"], "minute", "total")


@query(f"SELECT event_type, minute, total, greatest(0, total - before) AS delta FROM (SELECT *, lag(total) OVER (PARTITION BY event_type ORDER BY minute) AS before FROM {_TOTALS} t) x WHERE before IS NOT NULL")
def throughput_skip_first(spark, sf):
    return monitor.deltas(_totals(spark, sf), ["event_type"], "minute", "total", skip_first=True)


@query("SELECT tick.t AS k, CAST(coalesce(s.n, 0) AS BIGINT) AS n FROM (SELECT unnest(range(41, 101)) AS t) tick LEFT JOIN (SELECT user_id AS k, count(*) AS n FROM events WHERE event_type = 'error' GROUP BY 1) s ON s.k = tick.t")
def ring_history(spark, sf):
    samples = read(spark, sf, "events").where("event_type = 'error'").groupBy(F.col("user_id").alias("k")).agg(F.count("*").alias("n"))
    return monitor.ring_history(samples, "k", "n", 100)


@query("SELECT CAST(sum(s_suppkey) AS BIGINT) AS writes, CAST(sum(s_nationkey) AS BIGINT) AS reads, count(*) FILTER (WHERE s_acctbal >= 0) AS nodes_up, count(*) AS nodes FROM supplier")
def cluster_totals(spark, sf):
    nodes = read(spark, sf, "supplier").select(F.col("s_suppkey").alias("writes"), F.col("s_nationkey").cast("bigint").alias("reads"), text.health_label(F.col("s_acctbal") >= 0, F.lit("down")).alias("health"))
    return monitor.cluster_totals(nodes, ["writes", "reads"])


@query("SELECT p_partkey, CASE WHEN p_size % 10 = 0 THEN 0.0 ELSE (p_size % 7) * 100.0::DOUBLE / (p_size % 10) END AS fill, CAST(CASE WHEN p_size % 10 = 0 THEN 0 ELSE least(63, (p_size % 7) * 64 // (p_size % 10)) END AS INTEGER) AS occupation FROM part")
def fill_ratio(spark, sf):
    used, total = F.col("p_size") % 7, F.col("p_size") % 10
    return read(spark, sf, "part").select("p_partkey", text.fill_percent(used, total).alias("fill"), text.occupation(used, total).alias("occupation"))


@query("SELECT family, CAST(greatest(1, sum(b)) AS BIGINT) AS bytes FROM (SELECT event_id % 4 AS family, strlen(props) AS b FROM events ORDER BY event_id LIMIT 150) x GROUP BY family")
def family_bytes(spark, sf):
    rows = read(spark, sf, "events").select("event_id", (F.col("event_id") % 4 * 256 + 1).alias("header"), F.octet_length("props").alias("data_bytes"))
    return monitor.family_bytes(rows, ["event_id"])


@query("SELECT s_suppkey FROM supplier WHERE contains(lower(s_name) || ' ' || lpad(lower(printf('%x', s_suppkey)), 16, '0'), '00a')")
def monitor_search(spark, sf):
    return monitor.search(read(spark, sf, "supplier").select(F.col("s_name").alias("url"), F.col("s_suppkey").alias("node_id")), "00A").select(F.col("node_id").alias("s_suppkey"))


@query("SELECT count(*) AS writes, 0 AS deletes, CAST(sum(strlen(props)) AS BIGINT) AS bytes, count(DISTINCT user_id) AS tenants, (SELECT count(*) FROM events WHERE value > 90) AS rejected FROM events")
def node_snapshot(spark, sf):
    return monitor.snapshot(events_log(spark, sf), read(spark, sf, "events").where("value > 90"), F.octet_length("props")).withColumn("deletes", F.col("deletes").cast("int"))


@query("SELECT count(DISTINCT o_orderkey) AS recovered FROM orders WHERE o_orderkey >= 1")
def recoverable_count(spark, sf):
    return monitor.recovered(read(spark, sf, "orders"), 10**12, "o_orderkey")


@query("SELECT p_brand AS name, tier, a >= iops AS meets_iops, b >= space AS meets_space, (a >= iops AND b >= space) AS meets FROM (SELECT p_brand, max(p_retailprice) AS a, count(*) AS b FROM part GROUP BY 1) x CROSS JOIN (VALUES ('slow', 1000.0, 10), ('fast', 1900.0, 40)) t(tier, iops, space)")
def tier_verdict(spark, sf):
    measured = read(spark, sf, "part").groupBy(F.col("p_brand").alias("name")).agg(F.max("p_retailprice").alias("iops"), F.count("*").alias("space"))
    return monitor.tier_verdict(measured, spark.createDataFrame([("slow", 1000.0, 10), ("fast", 1900.0, 40)], "tier string, iops double, space int"))


@query("SELECT s_suppkey, CASE WHEN s_nationkey = 0 THEN 0 ELSE s_suppkey / s_nationkey::DOUBLE END AS records_per_sec, CASE WHEN s_nationkey = 0 THEN 0 ELSE (s_suppkey * 128 / 1048576.0::DOUBLE) / s_nationkey END AS mib_per_sec, CASE WHEN s_suppkey = 0 THEN 0 ELSE 150.0::DOUBLE * s_nationkey / s_suppkey END AS bytes_per_record FROM supplier")
def perf_sample(spark, sf):
    n, s = F.col("s_suppkey"), F.col("s_nationkey")
    return read(spark, sf, "supplier").select("s_suppkey", *monitor.perf_sample(n, s, F.lit(128), s * 150.0))


@query("SELECT event_id, u >= 0.8 AS warn, u >= 1.0 AS block FROM (SELECT event_id, sum(strlen(props)) OVER (PARTITION BY user_id ORDER BY event_id ROWS UNBOUNDED PRECEDING) / 1000.0::DOUBLE AS u FROM events) x")
def backpressure(spark, sf):
    return monitor.backpressure(events_log(spark, sf), ["event_id"], F.octet_length("props"), 1000).select("event_id", "warn", "block")


@query("SELECT event_id, event_type FROM events ORDER BY event_id DESC LIMIT 500")
def event_ring(spark, sf):
    return monitor.event_ring(read(spark, sf, "events"), ["event_id"]).select("event_id", "event_type")


@query("SELECT s_suppkey, CASE WHEN n >= 1073741824 THEN printf('%.1f', n / 1073741824.0) || 'G' WHEN n >= 1048576 THEN printf('%.1f', n / 1048576.0) || 'M' WHEN n >= 1024 THEN printf('%.1f', n / 1024.0) || 'K' ELSE n || 'B' END AS size FROM (SELECT s_suppkey, s_suppkey * s_suppkey * s_suppkey * 256 AS n FROM supplier) x")
def human_bytes(spark, sf):
    return read(spark, sf, "supplier").select("s_suppkey", text.human_bytes(F.col("s_suppkey") * F.col("s_suppkey") * F.col("s_suppkey") * 256).alias("size"))


@query("SELECT o_orderkey, right(" + _HEX.format("o_custkey", "0", "101", "o_orderkey") + ", 8) AS short, CAST(CASE WHEN h = 0 THEN 0 WHEN h < 64 THEN 1 WHEN h < 128 THEN 2 WHEN h < 192 THEN 3 ELSE 4 END AS INTEGER) AS heat FROM (SELECT *, o_orderkey % 256 AS h FROM orders) x")
def short_hex_and_heat(spark, sf):
    return read(spark, sf, "orders").select("o_orderkey", text.short_hex(ids.id_hex("o_custkey", 0, 101, "o_orderkey")).alias("short"), text.heat_level(F.col("o_orderkey") % 256).alias("heat"))


ORDER_V2 = Version(2, (*ORDER_FIELDS, FieldSpec("note", "str")), forward=lambda d: d.withColumn("note", F.lit("none")), rollback=lambda d: d.drop("note"))
ORDER_V3 = Version(3, (*ORDER_FIELDS, FieldSpec("note", "str"), FieldSpec("cents", "i64")), forward=lambda d: d.withColumn("cents", F.round(F.col("o_totalprice") * 100).cast("bigint")), rollback=lambda d: d.drop("cents"))
ORDERS3 = Family("Order", 101, NON_UNIQUE, (ORDERS.latest, ORDER_V2, ORDER_V3))


def _at(spark, sf, version: int, mixed: bool = False) -> DataFrame:
    """Orders as stored in a version; mixed: only those that a family of three stored versions has in that one."""
    rows = read(spark, sf, "orders").select(*ORDERS.latest.names)
    if mixed:
        rows = rows.where(F.col("o_orderkey") % 3 + 1 == version)
    if version > 1:
        rows = rows.withColumn("note", F.concat(F.lit("n"), "o_custkey"))
    return rows.withColumn("cents", F.col("o_orderkey")) if version > 2 else rows


_CENTS = "CAST(round(o_totalprice * 100) AS BIGINT)"


@query("SELECT o_orderkey, 'none' AS note FROM orders")
def migrate_add_column(spark, sf):
    return migrate.read_as(_at(spark, sf, 1), ORDERS3, 1, 2).select("o_orderkey", "note")


@query("SELECT o_orderkey, o_custkey, o_orderstatus, o_totalprice, o_orderpriority FROM orders")
def migrate_rollback_drop(spark, sf):
    return migrate.read_as(_at(spark, sf, 2), ORDERS3, 2, 1)


@query(f"SELECT o_orderkey, 'none' AS note, {_CENTS} AS cents FROM orders")
def migrate_two_hop(spark, sf):
    graph = migrate.graph_of(ORDERS3)
    return graph.migrate(_at(spark, sf, 1), (101, 1), (101, 3)).select("o_orderkey", "note", "cents")


@query("SELECT o_orderkey, o_custkey, o_orderstatus, o_totalprice, o_orderpriority FROM orders")
def migrate_rollback_chain(spark, sf):
    return migrate.graph_of(ORDERS3).roll_back(_at(spark, sf, 3), (101, 3), (101, 1))


@query(f"SELECT o_orderkey, CASE WHEN o_orderkey % 3 = 0 THEN 'none' ELSE 'n' || o_custkey END AS note, CASE WHEN o_orderkey % 3 = 2 THEN o_orderkey ELSE {_CENTS} END AS cents FROM orders")
def migrate_mixed_versions(spark, sf):
    out = None
    for v in (1, 2, 3):
        part = migrate.read_as(_at(spark, sf, v, mixed=True), ORDERS3, v, 3).select("o_orderkey", "note", "cents")
        out = part if out is None else out.unionByName(part)
    return out


@query("SELECT o_orderkey, 'n' || o_custkey AS note FROM orders WHERE o_orderkey % 3 <> 0 AND 'n' || o_custkey > 'n5'")
def migrate_filter_before(spark, sf):
    """The filter sees the stored layout: rows of version 1 have no note, so none of them passes."""
    out = None
    for v in (1, 2, 3):
        rows = _at(spark, sf, v, mixed=True).where(compile_expr(field("note").gt("n5"), ORDERS3.version(v)))
        part = migrate.read_as(rows, ORDERS3, v, 3).select("o_orderkey", "note")
        out = part if out is None else out.unionByName(part)
    return out


@query("SELECT o_orderkey AS key, 'core' AS family, o_orderstatus AS what FROM orders UNION ALL SELECT o_orderkey, 'price', CAST(o_custkey AS VARCHAR) FROM orders")
def migrate_split(spark, sf):
    parts = migrate.split(orders_log(spark, sf), {"core": migrate.lifted(("o_orderkey", "o_orderstatus")), "price": migrate.lifted(("o_orderkey", "o_custkey"))})
    core = parts["core"].select(F.col("o_orderkey").alias("key"), F.lit("core").alias("family"), F.col("o_orderstatus").alias("what"))
    return core.unionByName(parts["price"].select(F.col("o_orderkey").alias("key"), F.lit("price").alias("family"), F.col("o_custkey").cast("string").alias("what")))


@query("SELECT o_orderkey, count(l_orderkey) AS item_count FROM orders LEFT JOIN lineitem ON l_orderkey = o_orderkey GROUP BY o_orderkey")
def migrate_compose(spark, sf):
    o, items = read(spark, sf, "orders").select("o_orderkey"), read(spark, sf, "lineitem").groupBy("l_orderkey").agg(F.count("*").alias("n"))
    return refs.one_to_many(o, items, o.o_orderkey == items.l_orderkey, keep_childless=True).select("o_orderkey", F.coalesce("n", F.lit(0)).alias("item_count"))


@query("SELECT 103 AS struct_id, CAST(max(v) AS INTEGER) AS latest FROM (SELECT event_id % 3 + 1 AS v FROM events) x")
def registry_latest(spark, sf):
    return _archive(spark, sf).groupBy("struct_id").agg(F.max("version").cast("int").alias("latest"))


CHECKED = Version(
    1, EVENTS.latest.fields,
    checks=(("value", "too small", lambda: F.col("value") > 10), ("event_type", "errors aren't kept", lambda: F.col("event_type") != "error"), ("props", "too long", lambda: ~text.longer_than(F.col("props"), 9))),
    preprocess=lambda d: d.withColumn("event_type", F.upper(text.trim_unicode(F.concat(F.lit("\t "), "event_type", F.lit(" \n"))))),
    late_checks=(("user_id", "closed", lambda: F.col("user_id") != 3),),
)
_GOOD = "value > 10 AND event_type <> 'error' AND strlen(props) <= 9"


@query(f"SELECT event_id, CASE WHEN value <= 10 THEN 'ValidationFailed' WHEN event_type = 'error' THEN 'ValidationFailed' WHEN strlen(props) > 9 THEN 'ValidationFailed' ELSE 'PreprocessFailed' END AS code, CASE WHEN value <= 10 THEN 'value' WHEN event_type = 'error' THEN 'event_type' WHEN strlen(props) > 9 THEN 'props' ELSE 'user_id' END AS field FROM events WHERE NOT ({_GOOD}) OR user_id = 3")
def validate_rejects(spark, sf):
    _, bad = hooks.run_hooks(read(spark, sf, "events").select(*EVENTS.latest.names), EVENTS, CHECKED)
    return bad.select(F.get_json_object("row", "$.event_id").cast("bigint").alias("event_id"), "code", "field")


@query("SELECT CASE WHEN value <= 10 THEN 'too small' WHEN event_type = 'error' THEN 'errors aren''t kept' ELSE 'too long' END AS message, count(*) AS n FROM events WHERE NOT (value > 10 AND event_type <> 'error' AND strlen(props) <= 9) GROUP BY 1")
def validate_first_failure(spark, sf):
    failed = hooks.first_failure(CHECKED.checks, "ValidationFailed")
    return read(spark, sf, "events").select(failed["message"].alias("message")).where("message is not null").groupBy("message").agg(F.count("*").alias("n"))


@query(f"SELECT event_id, upper(event_type) AS event_type FROM events WHERE {_GOOD} AND user_id <> 3")
def preprocess_normalise(spark, sf):
    good, _ = hooks.run_hooks(read(spark, sf, "events").select(*EVENTS.latest.names), EVENTS, CHECKED)
    return good.select("event_id", "event_type")


def _guarded(spark, sf):
    u = F.col("user_id")
    listed = F.struct(F.lit("inline").alias("kind"), F.sequence(u, u + 60).alias("users"), F.lit(None).cast("bigint").alias("group"))
    grouped = F.struct(F.lit("group").alias("kind"), F.lit(None).cast("array<bigint>").alias("users"), (F.col("event_id") % 6).alias("group"))
    kind = F.col("event_id") % 3
    return read(spark, sf, "events").select("event_id", F.col("user_id").alias("tenant"), F.when(kind == 1, listed).when(kind == 2, grouped).alias("permission"))


@query("SELECT event_id, CASE event_id % 3 WHEN 0 THEN user_id = 30 WHEN 1 THEN 70 BETWEEN user_id AND user_id + 60 ELSE event_id % 6 IN (2, 3) END AS allowed FROM events")
def access(spark, sf):
    groups = spark.createDataFrame([(2, [70, 71]), (5, [1])], "group_id bigint, users array<bigint>")
    return permissions.with_access(_guarded(spark, sf), groups, F.lit(70), F.lit(30)).select("event_id", "allowed")


@query("SELECT event_id, event_id % 3 = 1 AS promoted, event_id % 3 = 1 AND 70 BETWEEN user_id AND user_id + 60 AS allowed_alone FROM events")
def access_alone(spark, sf):
    p = F.col("permission")
    return _guarded(spark, sf).select("event_id", permissions.promoted(p).alias("promoted"), permissions.allows_user(p, F.lit(70)).alias("allowed_alone"))


NODES = [placement.node_id_of(f"10.0.0.{i}:7000") for i in range(1, 6)]


@query("SELECT event_type AS k, user_id AS node, dist, nth FROM (SELECT event_type, user_id, min(event_id) AS dist, CAST(row_number() OVER (PARTITION BY event_type ORDER BY min(event_id)) AS INTEGER) AS nth FROM events GROUP BY 1, 2) x WHERE nth <= 3")
def distinct_walk(spark, sf):
    ring = read(spark, sf, "events").select(F.col("event_type").alias("k"), F.col("user_id").alias("node"), F.col("event_id").alias("dist"))
    return placement.first_distinct(ring, "k", "node", "dist", 3)


@query("SELECT c_custkey AS tenant, CAST(c_nationkey AS BIGINT) AS shard, c_nationkey BETWEEN 3 AND 9 AND c_acctbal > 0 AS owned FROM customer")
def shard_ranges(spark, sf):
    rows = read(spark, sf, "customer").select(F.col("c_custkey").alias("tenant"), F.col("c_nationkey").cast("bigint").alias("shard"), "c_acctbal")
    ranges = rows.where("c_acctbal > 0").select("tenant", F.lit(3).alias("first"), F.lit(9).alias("last"))
    return placement.owned(rows.drop("c_acctbal"), ranges)


@query("SELECT user_id AS transfer, s AS state, s IN ('pending', 'accepted') AS active FROM (SELECT user_id, CASE event_type WHEN 'view' THEN 'pending' WHEN 'click' THEN 'accepted' WHEN 'error' THEN 'rejected' ELSE 'complete' END AS s, event_id FROM events QUALIFY row_number() OVER (PARTITION BY user_id ORDER BY event_id DESC) = 1) x")
def transfer_states(spark, sf):
    state = F.when(F.col("event_type") == "view", "pending").when(F.col("event_type") == "click", "accepted").when(F.col("event_type") == "error", "rejected").otherwise("complete")
    return placement.transfers(read(spark, sf, "events").select(F.col("user_id").alias("transfer"), F.col("event_id").alias("seq"), state.alias("state")))


@query("SELECT count(*) FILTER (WHERE o_orderkey % 512 <> o_orderkey % 896) AS moved, count(*) AS entries FROM orders")
def rebalance(spark, sf):
    return read(spark, sf, "orders").agg(F.count_if(placement.moved(F.col("o_orderkey") % 512, F.col("o_orderkey") % placement.grown(512))).alias("moved"), F.count("*").alias("entries"))


@query("SELECT sha256(text) AS content_hash, CAST(strlen(text) AS BIGINT) AS size, count(DISTINCT doc_id) AS owners FROM documents WHERE strlen(text) > 64 GROUP BY 1, 2")
def blob_dedup(spark, sf):
    _, stored, owners = blobs.store(read(spark, sf, "documents"), "doc_id", "text")
    return stored.select("content_hash", "size").join(blobs.owners_of(owners), "content_hash")


@query("SELECT sha256(text) AS content_hash, count(DISTINCT doc_id) FILTER (WHERE lang <> 'fr') AS owners FROM documents WHERE strlen(text) > 64 GROUP BY 1 HAVING count(*) FILTER (WHERE lang <> 'fr') > 0")
def blob_release(spark, sf):
    docs = read(spark, sf, "documents").select("doc_id", "lang", "text")
    _, stored, owners = blobs.store(docs, "doc_id", "text")
    gone = owners.join(docs.where("lang = 'fr'").select(F.col("doc_id").alias("owner")), "owner", "left_semi").select("content_hash", "owner")
    alive, left, _ = blobs.release(stored, owners, gone)
    return alive.select("content_hash").join(blobs.owners_of(left), "content_hash")


@query("SELECT doc_id, strlen(text) > 4096 AS spilled FROM documents")
def blob_spill(spark, sf):
    rows, _ = blobs.spilled(read(spark, sf, "documents").select("doc_id", "text"), "doc_id", "text", 4096)
    return rows.select("doc_id", F.col("blob").isNotNull().alias("spilled"))


@query("SELECT o_orderkey, o_custkey FROM orders WHERE o_custkey >= 50 AND o_custkey < 60")
def index_range_half_open(spark, sf):
    return indexes.half_open(read(spark, sf, "orders"), "o_custkey", 50, 60).select("o_orderkey", "o_custkey")


@query("SELECT o_orderstatus AS bucket, count(*) AS entries FROM orders GROUP BY 1")
def bucket_counts(spark, sf):
    return indexes.bucket_counts(read(spark, sf, "orders"), F.col("o_orderstatus"))


@query("SELECT o_custkey, count(*) AS entries, CASE WHEN count(*) > 10 THEN 'tree' ELSE 'array' END AS backend FROM orders GROUP BY 1")
def index_backend(spark, sf):
    return indexes.structure(read(spark, sf, "orders"), ["o_custkey"], 10)


@query("SELECT o_custkey AS tenant, 'o_custkey,o_orderpriority' AS anchor, o_custkey || chr(31) || o_orderpriority AS alias, CAST(o_orderkey AS VARCHAR) AS \"primary\" FROM orders UNION ALL SELECT o_custkey, 'o_orderstatus', o_orderstatus, CAST(o_orderkey AS VARCHAR) FROM orders")
def secondary_aliases(spark, sf):
    return indexes.aliases(orders_log(spark, sf), ORDERS)


@query("SELECT user_id AS tenant, event_type, count(*) AS records FROM events GROUP BY 1, 2 HAVING count(*) > 1")
def anchor_duplicates(spark, sf):
    family = Family("Event", 103, NON_UNIQUE, EVENTS.versions, primary_anchor=("event_type",))
    return indexes.duplicates(events_log(spark, sf), family)


def _event_stream(spark, sf) -> DataFrame:
    path = f"{sf}/events.parquet"
    schema = spark.read.parquet(path).schema
    return feed.read_log(spark, feed.one_path(path), schema)


@query("SELECT event_id, user_id AS tenant, event_type = 'error' AS deleted FROM events")
def change_feed(spark, sf):
    """The log as a stream of changes, through the file sink."""
    rows = as_log(_event_stream(spark, sf), EVENTS, "user_id", "event_id").withColumn("op", F.when(F.col("event_type") == "error", "D").otherwise("U"))
    target = stage_path(spark, "feed")
    feed.archive_stream(feed.change_events(rows).select("event_id", "tenant", "deleted"), target, target + "-checkpoint").awaitTermination()
    return spark.read.schema("event_id bigint, tenant bigint, deleted boolean").parquet(target)


@query("SELECT user_id AS tenant, max(event_id) AS high_water FROM events GROUP BY user_id")
def stream_high_water(spark, sf):
    acks = _event_stream(spark, sf).select(F.col("user_id").alias("tenant"), F.col("event_id").alias("seq"))
    return feed.high_water_table(acks, stage_path(spark, "high-water"))


@query("SELECT user_id AS tenant, 'r' || (event_id % 977) AS record_id, max(event_id) AS write_seq FROM events GROUP BY 1, 2")
def stream_upsert(spark, sf):
    rows = _event_stream(spark, sf).select(F.col("user_id").alias("tenant"), F.concat(F.lit("r"), F.col("event_id") % 977).alias("record_id"), F.col("event_id").alias("write_seq"))
    target = stage_path(spark, "upsert")
    feed.upsert_stream(rows, target, target + "-checkpoint").awaitTermination()
    return feed.last_epoch(spark, target, "tenant bigint, record_id string, write_seq bigint")


@query("SELECT event_id FROM events WHERE user_id NOT IN (SELECT user_id FROM events WHERE event_type = 'error' AND value > 90)")
def seen_delta(spark, sf):
    changes = read(spark, sf, "events").select("event_id", "user_id")
    return feed.unseen(changes, read(spark, sf, "events").where("event_type = 'error' and value > 90"), "user_id").select("event_id")


@query("SELECT count(*) AS marked, true AS few_others FROM events")
def seen_filter(spark, sf):
    """No marked key is ever taken for unknown, and of as many unknown ones no more than a fiftieth for known."""
    rows = read(spark, sf, "events").select(F.col("event_id").cast("string").alias("key"))
    known = feed.SeenTable.build(rows, "key")
    unknown = F.concat(F.lit("not "), F.coalesce("key", F.lit("")))  # no number reads like this
    asked = rows.select("key", F.lit(True).alias("marked")).unionByName(rows.select(unknown.alias("key"), F.lit(False).alias("marked")))
    found = known.probably_seen(asked, "key", "yes")
    return found.agg(F.count_if(F.expr("marked and yes")).alias("marked"), (F.count_if(F.expr("not marked and yes")) * 50 <= F.count_if(~F.col("marked"))).alias("few_others"))


@query("SELECT event_id, tick - before AS gap FROM (SELECT event_id, CAST(floor(epoch_us(ts) / 1000000) AS BIGINT) AS tick, lag(CAST(floor(epoch_us(ts) / 1000000) AS BIGINT)) OVER (PARTITION BY user_id ORDER BY ts) AS before FROM events) x WHERE tick - before > 3 * 36000")
def heartbeat_gaps(spark, sf):
    beats = read(spark, sf, "events").select("event_id", "user_id", F.floor(F.unix_micros(F.col("ts").cast("timestamp")) / 1_000_000).alias("tick"))
    return feed.heartbeat_gaps(beats, "user_id", "tick", 36_000).select("event_id", "gap")


@query("SELECT DISTINCT user_id % 10 AS origin, event_id % 50 AS epoch FROM events")
def gossip_dedup(spark, sf):
    messages = _event_stream(spark, sf).select((F.col("user_id") % 10).alias("origin"), (F.col("event_id") % 50).alias("epoch"))
    target = stage_path(spark, "gossip")
    feed.archive_stream(feed.gossip_once(messages), target, target + "-checkpoint").awaitTermination()
    return spark.read.schema("origin bigint, epoch bigint").parquet(target)


@query("SELECT o_orderkey, o_totalprice FROM orders WHERE o_totalprice > 1000 AND o_orderstatus <> 'F'")
def store_round_trip(spark, sf):
    """Through a store on disk: save the table, delete the finished, filter the rest."""
    session = Store(spark, registry=Registry([ORDERS])).session(1, 28)
    saved = session.save(ORDERS, read(spark, sf, "orders"), order=("o_orderkey",))
    session.delete(ORDERS, saved.accepted.where("o_orderstatus = 'F'"))
    return session.query(ORDERS, ORDERS.o_totalprice.gt(1000)).select("o_orderkey", "o_totalprice")


@query("SELECT c_custkey, c_name FROM customer ORDER BY c_custkey DESC LIMIT 1")
def store_unique(spark, sf):
    """Every save of a unique family replaces what find gives."""
    session = Store(spark, registry=Registry([CUSTOMERS])).session(1, 3)
    session.save(CUSTOMERS, read(spark, sf, "customer"), order=("c_custkey",))
    return session.find(CUSTOMERS).select("c_custkey", "c_name")