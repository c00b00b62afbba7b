"""Joins, set operations and graph queries."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from setwise.functions.measures import money
from setwise.operators import aggregates as ag
from setwise.operators import graph, joins as jn
from setwise.plans.aggregation import revenue
from setwise.plans.registry import day_text, number, query, time_text
from setwise.sources.tables import Tables

FIVE_MINUTES = 300_000_000


def order_intervals(t: Tables) -> DataFrame:
    """Orders as intervals of up to 89 days."""
    return t.orders.select(
        "o_orderkey", "o_orderstatus", F.col("o_orderdate").alias("start"),
        (F.col("o_orderdate") + F.make_dt_interval(days=(F.col("o_orderkey") % 90).cast("int"))).alias("end"))


_INTERVALS = "(SELECT o_orderkey, o_orderstatus, o_orderdate AS s, o_orderdate + to_days(CAST(o_orderkey % 90 AS INTEGER)) AS e FROM orders)"


@query("active_at", sql=f"""
SELECT o_orderkey, o_orderstatus, strftime(s, '%Y-%m-%d') AS started, strftime(e, '%Y-%m-%d') AS ended FROM {_INTERVALS}
WHERE TIMESTAMP '1998-03-07' BETWEEN s AND e AND o_orderstatus <> 'P'""")
def active_at(t: Tables):
    moment = F.lit("1998-03-07").cast("timestamp_ntz")
    out = jn.active_at(order_intervals(t), F.col("start"), F.col("end"), moment, "o_orderstatus", "P")
    return out.select("o_orderkey", "o_orderstatus", day_text("start", "started"), day_text("end", "ended"))


@query("active_at_many", sql=f"""
WITH b AS (SELECT date_trunc('month', MIN(o_orderdate)) AS lo, MAX(o_orderdate) AS hi FROM orders),
p AS (SELECT unnest(generate_series(lo, hi, INTERVAL 1 MONTH)) AS probe FROM b)
SELECT strftime(probe, '%Y-%m-%d') AS probe, COUNT(*) AS n, SUM(o_orderkey)::BIGINT AS key_sum
FROM p JOIN {_INTERVALS} ON probe BETWEEN s AND e GROUP BY probe""")
def active_at_many(t: Tables):
    """Orders open at each month start."""
    first, last = F.trunc(F.min("o_orderdate"), "month"), F.max(F.col("o_orderdate").cast("date"))
    probes = t.orders.agg(first.alias("lo"), last.alias("hi")).select(
        F.explode(F.sequence("lo", "hi", F.expr("interval 1 month"))).alias("probe")
    ).select(F.col("probe").cast("timestamp_ntz").alias("probe"))
    day = 86_400_000_000
    hits = jn.active_at_many(order_intervals(t), "start", "end", probes, "probe", day)
    return hits.groupBy("probe").agg(F.count(F.lit(1)).alias("n"), F.sum("o_orderkey").alias("key_sum")).select(
        day_text("probe", "probe"), "n", "key_sum")


@query("near_join", sql="""
SELECT event_id, user_id FROM events e WHERE event_type = 'error' AND EXISTS (
  SELECT 1 FROM events v WHERE v.user_id = e.user_id AND v.event_type = 'view'
  AND abs(epoch_us(v.ts) - epoch_us(e.ts)) <= 300000000)""")
def near_join(t: Tables):
    """Errors within five minutes of a view by the same user."""
    errors = t.events.where("event_type = 'error'").select("event_id", "user_id", "ts")
    views = t.events.where("event_type = 'view'").select("user_id", "ts")
    return jn.near_join(errors, views, ["user_id"], "ts", "ts", FIVE_MINUTES).drop("ts")


@query("near_join_kinds", sql="""
SELECT DISTINCT e.event_id, e.user_id, v.event_type AS near_type FROM events e JOIN events v ON v.user_id = e.user_id
AND v.ts::DATE = e.ts::DATE AND abs(epoch_us(v.ts) - epoch_us(e.ts)) < 600000000
WHERE e.event_type = 'error' AND v.event_type <> 'error'""")
def near_join_kinds(t: Tables):
    """What else happened within ten minutes of an error, the same user and day."""
    day = F.col("ts").cast("date").alias("day")
    errors = t.events.where("event_type = 'error'").select("event_id", "user_id", day, "ts")
    others = t.events.where("event_type <> 'error'").select("user_id", day, F.col("event_type").alias("near_type"), "ts")
    out = jn.near_join(errors, others, ["user_id", "day"], "ts", "ts", 2 * FIVE_MINUTES, ["near_type"], inclusive=False)
    return out.select("event_id", "user_id", "near_type")


@query("orphans", sql="SELECT o_orderkey, o_custkey FROM orders WHERE NOT EXISTS (SELECT 1 FROM lineitem WHERE l_orderkey = o_orderkey)")
def orphans(t: Tables):
    """Orders without lines."""
    rows = t.orders.select("o_orderkey", "o_custkey")
    return jn.orphans(rows, t.lineitem, F.col("o_orderkey") == F.col("l_orderkey"))


@query("except_then_in", sql="""
SELECT c_custkey, c_name FROM customer WHERE c_custkey IN (SELECT c_custkey FROM customer
  EXCEPT SELECT o_custkey FROM orders WHERE o_orderdate >= TIMESTAMP '2001-01-01')""")
def except_then_in(t: Tables):
    """Customers with no order since 2001."""
    recent = t.orders.where(F.col("o_orderdate") >= F.lit("2001-01-01").cast("timestamp_ntz")).select(
        F.col("o_custkey").alias("c_custkey"))
    return jn.except_then_in(t.customer.select("c_custkey", "c_name"), t.customer, recent, "c_custkey")


@query("union_distinct", sql="SELECT c_nationkey AS nation FROM customer UNION SELECT s_nationkey FROM supplier")
def union_distinct(t: Tables):
    return jn.union_distinct(
        t.customer.select(F.col("c_nationkey").alias("nation")), t.supplier.select(F.col("s_nationkey").alias("nation")))


@query("union_all", sql="""
SELECT nation, kind, COUNT(*) AS n FROM (SELECT c_nationkey AS nation, 'customer' AS kind FROM customer
  UNION ALL SELECT s_nationkey, 'supplier' FROM supplier) GROUP BY ALL""")
def union_all(t: Tables):
    both = jn.union_all(
        t.customer.select(F.col("c_nationkey").alias("nation"), F.lit("customer").alias("kind")),
        t.supplier.select(F.col("s_nationkey").alias("nation"), F.lit("supplier").alias("kind")))
    return ag.count_by(both, "nation", "kind")


@query("effective_grants", sql="""
WITH g AS (SELECT 'customer:' || c_custkey AS principal, c_mktsegment AS permission FROM customer WHERE c_acctbal > 9000
  UNION ALL SELECT 'nation:' || s_nationkey, 'supply' FROM supplier WHERE s_acctbal > 8000),
m AS (SELECT 'customer:' || c_custkey AS principal, 'nation:' || c_nationkey AS role FROM customer)
SELECT principal, permission, 'direct' AS role_name FROM g WHERE principal NOT IN (SELECT role FROM m)
UNION SELECT m.principal, COALESCE(permission, 'none'), m.role FROM m LEFT JOIN g ON g.principal = m.role""")
def effective_grants(t: Tables):
    """Customers' own grants and those of the nation they belong to."""
    who = lambda kind, key: F.concat(F.lit(kind), F.col(key).cast("string"))
    own = t.customer.where("c_acctbal > 9000").select(
        who("customer:", "c_custkey").alias("principal"), F.col("c_mktsegment").alias("permission"))
    roles = t.supplier.where("s_acctbal > 8000").select(
        who("nation:", "s_nationkey").alias("principal"), F.lit("supply").alias("permission"))
    members = t.customer.select(
        who("customer:", "c_custkey").alias("principal"), who("nation:", "c_nationkey").alias("role"))
    out = jn.effective_grants(own.unionByName(roles).distinct(), members, "principal", "role", ["permission"])
    return out.select(
        "principal", F.coalesce("permission", F.lit("none")).alias("permission"),
        F.coalesce("role_name", F.lit("direct")).alias("role_name"))


_DIFF_SQL = """
WITH a AS (SELECT doc_id, CASE WHEN quality = 1 THEN 'good' END AS grade FROM labels),
b AS (SELECT doc_id, CASE WHEN n_chars > 1500 THEN 'good' WHEN n_chars > 500 THEN 'poor' END AS grade FROM documents)
SELECT a.doc_id, COALESCE(a.grade, '-') AS grade, COALESCE(b.grade, '-') AS other_grade FROM a JOIN b ON a.doc_id = b.doc_id WHERE """


def _graded(t: Tables) -> tuple[DataFrame, DataFrame]:
    labelled = t.labels.select("doc_id", F.when(F.col("quality") == 1, "good").alias("grade"))
    measured = t.documents.select(
        "doc_id", F.when(F.col("n_chars") > 1500, "good").when(F.col("n_chars") > 500, "poor").alias("grade"))
    return labelled, measured


def _shown(df: DataFrame) -> DataFrame:
    return df.select("doc_id", *[F.coalesce(c, F.lit("-")).alias(c) for c in ("grade", "other_grade")])


@query("null_safe_diff", sql=_DIFF_SQL + "a.grade IS DISTINCT FROM b.grade")
def null_safe_diff(t: Tables):
    return _shown(jn.null_safe_diff(*_graded(t), ["doc_id"], ["grade"]))


@query("null_blind_diff", sql=_DIFF_SQL + "a.grade <> b.grade")
def null_blind_diff(t: Tables):
    return _shown(jn.null_safe_diff(*_graded(t), ["doc_id"], ["grade"], null_aware=False))


@query("or_join", sql="""
SELECT p_brand, COUNT(*) AS n, CAST(SUM(CAST(l_quantity AS DECIMAL(18,2))) AS DOUBLE) AS quantity
FROM lineitem JOIN part ON p_partkey = l_partkey OR p_partkey = l_suppkey GROUP BY p_brand""")
def or_join(t: Tables):
    """Parts matched by a line's part key or by its supplier key."""
    lines = t.lineitem.select("l_partkey", "l_suppkey", "l_quantity")
    hits = jn.or_join(lines, t.part.select("p_partkey", "p_brand"), ["l_partkey", "l_suppkey"], "p_partkey")
    return hits.groupBy("p_brand").agg(F.count(F.lit(1)).alias("n"), number(F.sum(money("l_quantity")), "quantity"))


@query("or_join_left", sql="""
SELECT o_orderstatus, COALESCE(c_mktsegment, 'none') AS segment, COUNT(*) AS n
FROM orders LEFT JOIN (SELECT * FROM customer WHERE c_acctbal < 0) ON c_custkey = o_custkey OR c_custkey = o_orderkey GROUP BY ALL""")
def or_join_left(t: Tables):
    """Orders with the indebted customers of either key; orders without any are kept."""
    debtors = t.customer.where("c_acctbal < 0").select("c_custkey", "c_mktsegment")
    out = jn.or_join(t.orders.select("o_orderkey", "o_custkey", "o_orderstatus"), debtors, ["o_custkey", "o_orderkey"], "c_custkey", how="left")
    return out.groupBy("o_orderstatus", F.coalesce("c_mktsegment", F.lit("none")).alias("segment")).agg(F.count(F.lit(1)).alias("n"))


@query("star_report", sql="""
SELECT r_name, n_name, year(o_orderdate) AS y, COUNT(*) AS lines,
  CAST(SUM(CAST(l_extendedprice AS DECIMAL(18,2)) * (1 - CAST(l_discount AS DECIMAL(4,2)))) AS DOUBLE) AS revenue
FROM lineitem JOIN orders ON l_orderkey = o_orderkey JOIN customer ON o_custkey = c_custkey
JOIN nation ON c_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey GROUP BY ALL""")
def star_report(t: Tables):
    # Lines shrink to one row per order before the joins.
    per_order = t.lineitem.groupBy("l_orderkey").agg(F.count(F.lit(1)).alias("lines"), F.sum(revenue()).alias("revenue"))
    return (
        per_order.join(t.orders.select("o_orderkey", "o_custkey", "o_orderdate"), F.col("l_orderkey") == F.col("o_orderkey"))
        .join(t.customer.select("c_custkey", "c_nationkey"), F.col("o_custkey") == F.col("c_custkey"))
        .join(t.nation, F.col("c_nationkey") == F.col("n_nationkey"))
        .join(t.region, F.col("n_regionkey") == F.col("r_regionkey"))
        .groupBy("r_name", "n_name", F.year("o_orderdate").alias("y"))
        .agg(F.sum("lines").alias("lines"), number(F.sum("revenue"), "revenue")))


@query("star_rows", sql="""
SELECT o_orderkey, c_name, n_name, r_name, COALESCE(last_line, 'none') AS last_line FROM orders JOIN customer ON o_custkey = c_custkey
JOIN nation ON c_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey
LEFT JOIN (SELECT l_orderkey, strftime(MAX(l_shipdate), '%Y-%m-%d') AS last_line FROM lineitem GROUP BY 1) ON l_orderkey = o_orderkey""")
def star_rows(t: Tables):
    """Orders with their descriptions and a side that may be missing."""
    shipped = t.lineitem.groupBy("l_orderkey").agg(F.date_format(F.max("l_shipdate"), "yyyy-MM-dd").alias("last_line"))
    return (
        t.orders.select("o_orderkey", "o_custkey").join(t.customer, F.col("o_custkey") == F.col("c_custkey"))
        .join(t.nation, F.col("c_nationkey") == F.col("n_nationkey")).join(t.region, F.col("n_regionkey") == F.col("r_regionkey"))
        .join(shipped, F.col("o_orderkey") == F.col("l_orderkey"), "left")
        .select("o_orderkey", "c_name", "n_name", "r_name", F.coalesce("last_line", F.lit("none")).alias("last_line")))


@query("self_pairs", sql="""
SELECT cn.n_name AS customer_nation, sn.n_name AS supplier_nation, COUNT(*) AS lines
FROM lineitem JOIN orders ON l_orderkey = o_orderkey JOIN customer ON o_custkey = c_custkey JOIN supplier ON l_suppkey = s_suppkey
JOIN nation cn ON c_nationkey = cn.n_nationkey JOIN nation sn ON s_nationkey = sn.n_nationkey GROUP BY ALL""")
def self_pairs(t: Tables):
    """One table in two roles: the nations of a line's customer and of its supplier."""
    buyer = t.nation.select(F.col("n_nationkey").alias("c_nationkey"), F.col("n_name").alias("customer_nation"))
    seller = t.nation.select(F.col("n_nationkey").alias("s_nationkey"), F.col("n_name").alias("supplier_nation"))
    lines = t.lineitem.groupBy("l_orderkey", "l_suppkey").agg(F.count(F.lit(1)).alias("lines"))
    return (
        lines.join(t.orders.select("o_orderkey", "o_custkey"), F.col("l_orderkey") == F.col("o_orderkey"))
        .join(t.customer.select("c_custkey", "c_nationkey"), F.col("o_custkey") == F.col("c_custkey"))
        .join(t.supplier.select("s_suppkey", "s_nationkey"), F.col("l_suppkey") == F.col("s_suppkey"))
        .groupBy("c_nationkey", "s_nationkey").agg(F.sum("lines").alias("lines"))
        .join(buyer, "c_nationkey").join(seller, "s_nationkey").select("customer_nation", "supplier_nation", "lines"))


@query("scalar_cross", sql="""
SELECT o_orderkey, o_totalprice FROM orders
WHERE CAST(o_totalprice AS DECIMAL(18,2)) > (SELECT SUM(CAST(o_totalprice AS DECIMAL(18,2))) / COUNT(*) FROM orders)""")
def scalar_cross(t: Tables):
    """Orders above the mean."""
    rows = t.orders.select("o_orderkey", "o_totalprice", money("o_totalprice").alias("price"))
    return jn.above_average(rows, "price").select("o_orderkey", "o_totalprice")


@query("first_non_null", sql="""
SELECT d.doc_id, COALESCE(quality, -1) AS quality FROM documents d LEFT JOIN labels l ON l.doc_id = d.doc_id""")
def first_non_null(t: Tables):
    return jn.first_non_null(t.documents.select("doc_id"), [(t.labels, "quality")], "doc_id", "quality", -1)


@query("chained_lookup", sql="""
SELECT l.l_orderkey, l.l_linenumber, COALESCE(p_name, '?') AS part, COALESCE(s_name, '?') AS supplier,
  COALESCE(n_name, '?') AS nation, COALESCE(r_name, '?') AS region, COUNT(*) AS n
FROM lineitem l LEFT JOIN (SELECT * FROM part WHERE p_size < 40) ON p_partkey = l_partkey
LEFT JOIN (SELECT * FROM supplier WHERE s_acctbal > 0) ON s_suppkey = l_suppkey
LEFT JOIN nation ON n_nationkey = COALESCE(s_nationkey, l_linenumber) LEFT JOIN region ON r_regionkey = n_regionkey GROUP BY ALL""")
def chained_lookup(t: Tables):
    """Names for a line's ids through a chain with gaps: a missing supplier falls back to another key."""
    ids = "l_orderkey", "l_linenumber", "l_partkey", "l_suppkey"
    parts = jn.parts_for(t.lineitem)
    lines = jn.dealt(t.lineitem.select(*ids), parts, *ids).groupBy(*ids).agg(F.count(F.lit(1)).alias("n"))
    out = jn.chained_lookup(lines, [
        (t.part.where("p_size < 40"), "p_partkey", "l_partkey", ["p_name"]),
        (t.supplier.where("s_acctbal > 0"), "s_suppkey", "l_suppkey", ["s_name", "s_nationkey"]),
        (t.nation, "n_nationkey", "coalesce(s_nationkey, l_linenumber)", ["n_name", "n_regionkey"]),
        (t.region, "r_regionkey", "n_regionkey", ["r_name"]),
    ], parts=parts)
    named = out.select("l_orderkey", "l_linenumber", "n", *[
        F.coalesce(c, F.lit("?")).alias(name)
        for c, name in (("p_name", "part"), ("s_name", "supplier"), ("n_name", "nation"), ("r_name", "region"))])
    names = "l_orderkey", "l_linenumber", "part", "supplier", "nation", "region"
    return jn.dealt(named, parts, *names).groupBy(*names).agg(F.sum("n").alias("n"))


def turn_edges(t: Tables) -> DataFrame:
    """Conversation turns, each waiting for the one before."""
    key = lambda turn: F.concat_ws("-", F.col("conv_id").cast("string"), turn.cast("string"))
    return t.conversations.select(
        "conv_id", "turn", key(F.col("turn")).alias("node"),
        F.when(F.col("turn") > 0, key(F.col("turn") - 1)).alias("waits_for"))


@query("descendant_count", sql="""
SELECT conv_id, turn, MAX(turn) OVER (PARTITION BY conv_id) - turn AS blocked_count FROM conversations""")
def descendant_count(t: Tables):
    return graph.descendant_count(turn_edges(t), "node", "waits_for").select("conv_id", "turn", "blocked_count")


@query("chase_missing", sql="""
WITH s AS (SELECT conv_id, MAX(turn) AS last FROM conversations WHERE role = 'user' GROUP BY conv_id)
SELECT c.conv_id, c.turn FROM conversations c JOIN s ON s.conv_id = c.conv_id AND c.turn <= s.last""")
def chase_missing(t: Tables):
    """All turns referenced, directly or not, from each conversation's last user turn."""
    turns = turn_edges(t)
    last = t.conversations.where("role = 'user'").groupBy("conv_id").agg(F.max("turn").alias("turn"))
    seeds = turns.join(last, ["conv_id", "turn"], "left_semi")
    return graph.chase_missing(seeds, turns, "node", "waits_for").select("conv_id", "turn")


@query("descendant_count_multi", sql="""
WITH RECURSIVE e AS (SELECT c_custkey AS n, unnest([c_custkey // 2, c_custkey // 3]) AS u FROM customer),
k AS (SELECT DISTINCT n, u FROM e WHERE u <> n AND u IN (SELECT c_custkey FROM customer)),
r AS (SELECT n, u FROM k UNION SELECT r.n, k.u FROM r JOIN k ON k.n = r.u),
c AS (SELECT u, COUNT(*) AS m FROM r GROUP BY u)
SELECT c_custkey, COALESCE(m, 0) AS blocked_count FROM customer LEFT JOIN c ON u = c_custkey""")
def descendant_count_multi(t: Tables):
    """Customers that wait for two others each: everybody behind one is counted once."""
    half = t.customer.select("c_custkey", F.explode(F.array(F.expr("c_custkey div 2"), F.expr("c_custkey div 3"))).alias("waits_for"))
    return graph.descendant_count(half, "c_custkey", "waits_for").select("c_custkey", "blocked_count").distinct()
