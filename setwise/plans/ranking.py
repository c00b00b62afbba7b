"""Numbering, top rows, latest rows."""

from __future__ import annotations

from pyspark.sql import functions as F

from setwise.functions.measures import money
from setwise.operators import aggregates as ag
from setwise.operators import ranking as rk
from setwise.plans.registry import day_text, number, query
from setwise.sources.tables import Tables


@query("row_number_all", sql="""
SELECT o_orderkey, o_custkey, ROW_NUMBER() OVER (PARTITION BY o_custkey ORDER BY o_orderdate, o_orderkey) AS row_no FROM orders""")
def row_number_all(t: Tables):
    rows = t.orders.select("o_orderkey", "o_custkey", "o_orderdate")
    out = rk.row_number_by(rows, ["o_custkey"], [F.col("o_orderdate").asc(), F.col("o_orderkey").asc()])
    return out.drop("o_orderdate")


@query("row_number_global", sql="""
SELECT o_orderkey, ROW_NUMBER() OVER (ORDER BY o_totalprice DESC, o_orderkey) AS row_no FROM orders""")
def row_number_global(t: Tables):
    rows = t.orders.select("o_orderkey", "o_totalprice")
    return rk.row_number_by(rows, [], [F.col("o_totalprice").desc(), F.col("o_orderkey").asc()]).drop("o_totalprice")


@query("keep_first", sql="""
SELECT user_id, MIN(event_id) AS event_id FROM events WHERE event_type = 'signup' GROUP BY user_id""")
def keep_first(t: Tables):
    rows = t.events.where("event_type = 'signup'").select("user_id", "event_id")
    return rk.keep_first(rows, ["user_id"], {"event_id": False})


@query("best_row", sql="""
SELECT l_orderkey, l_partkey, l_suppkey, l_linenumber, l_quantity, l_extendedprice FROM (
  SELECT *, ROW_NUMBER() OVER (PARTITION BY l_orderkey ORDER BY l_extendedprice DESC, l_quantity DESC, l_partkey DESC,
    l_suppkey DESC, l_linenumber DESC) AS r FROM lineitem) WHERE r = 1""")
def best_row(t: Tables):
    columns = ["l_orderkey", "l_partkey", "l_suppkey", "l_linenumber", "l_quantity", "l_extendedprice"]
    order = ["l_extendedprice", "l_quantity", "l_partkey", "l_suppkey", "l_linenumber"]
    return rk.best_row(t.lineitem.select(*columns), ["l_orderkey"], {c: True for c in order})


@query("dense_rank_ids", sql="""
SELECT o_orderkey, o_custkey, DENSE_RANK() OVER (ORDER BY o_custkey) AS dense_id FROM orders""")
def dense_rank_ids(t: Tables):
    return rk.dense_ids(t.orders.select("o_orderkey", "o_custkey"), "o_custkey")


@query("broadcast_aggregate", sql="""
SELECT o_orderkey, o_custkey, CAST(SUM(CAST(o_totalprice AS DECIMAL(18,2))) OVER w AS DOUBLE) AS spent,
  COUNT(*) OVER w AS n, MAX(o_totalprice) OVER w AS largest,
  ROUND(100 * o_totalprice / CAST(SUM(CAST(o_totalprice AS DECIMAL(18,2))) OVER w AS DOUBLE), 4) AS pct
FROM orders WINDOW w AS (PARTITION BY o_custkey)""")
def broadcast_aggregate(t: Tables):
    rows = t.orders.select("o_orderkey", "o_custkey", "o_totalprice")
    totals = {"spent": F.sum(money("o_totalprice")).cast("double"), "n": F.count(F.lit(1)), "largest": F.max("o_totalprice")}
    out = rk.with_group_totals(rows, ["o_custkey"], totals)
    return out.withColumn("pct", F.round(F.lit(100) * F.col("o_totalprice") / F.col("spent"), 4)).drop("o_totalprice")


@query("top_n_score", sql="""
SELECT l_partkey, CAST(SUM(CAST(l_extendedprice AS DECIMAL(18,2)) * CAST(l_quantity AS DECIMAL(6,2))) AS DOUBLE) AS score
FROM lineitem GROUP BY l_partkey ORDER BY score DESC, l_partkey LIMIT 20""")
def top_n_score(t: Tables):
    value = money("l_extendedprice") * F.col("l_quantity").cast("decimal(6,2)")
    per_part = t.lineitem.groupBy("l_partkey").agg(F.sum(value).alias("total"))
    return rk.top_n(per_part, F.col("total"), 20, [F.col("l_partkey").asc()]).select("l_partkey", number("score"))


@query("top_n_members", sql="""
WITH top AS (SELECT o_custkey FROM orders GROUP BY o_custkey ORDER BY SUM(CAST(o_totalprice AS DECIMAL(18,2))) DESC, o_custkey LIMIT 20)
SELECT o_orderkey, o_custkey FROM orders WHERE o_custkey IN (SELECT o_custkey FROM top)""")
def top_n_members(t: Tables):
    """Rows whose key is among the 20 best keys."""
    per = t.orders.groupBy("o_custkey").agg(F.sum(money("o_totalprice")).alias("spent"))
    best = rk.top_n(per, F.col("spent"), 20, [F.col("o_custkey").asc()])
    # Twenty rows by construction: small enough to send everywhere.
    return t.orders.select("o_orderkey", "o_custkey").join(F.broadcast(best.select("o_custkey")), "o_custkey", "left_semi")


@query("ordered_report", sql="""
SELECT n_name, COUNT(*) AS customers, 0 AS last FROM customer JOIN nation ON c_nationkey = n_nationkey GROUP BY n_name
UNION ALL SELECT 'all', COUNT(*), 1 FROM customer""")
def ordered_report(t: Tables):
    per = t.customer.groupBy("c_nationkey").agg(F.count(F.lit(1)).alias("customers")).join(
        t.nation, F.col("c_nationkey") == F.col("n_nationkey")).select("n_name", "customers")
    report = per.unionByName(per.agg(F.sum("customers").alias("customers")).select(F.lit("all").alias("n_name"), "customers"))
    last = F.when(F.col("n_name") == "all", 1).otherwise(0)
    return rk.ordered_report(report.withColumn("last", last), F.col("last").asc(), F.col("customers").desc(), F.col("n_name").asc())


@query("top1_per_apply", sql="""
SELECT c_custkey, COALESCE(o.o_orderkey, -1) AS first_order, COALESCE(strftime(o.o_orderdate, '%Y-%m-%d'), 'none') AS first_date
FROM customer LEFT JOIN (SELECT *, ROW_NUMBER() OVER (PARTITION BY o_custkey ORDER BY o_orderdate, o_orderkey) AS r
  FROM orders WHERE o_orderstatus = 'P') o ON o.o_custkey = c_custkey AND o.r = 1""")
def top1_per_apply(t: Tables):
    """First order with status P per customer; customers without one stay."""
    partial = t.orders.where("o_orderstatus = 'P'").select("o_custkey", "o_orderkey", "o_orderdate")
    first = rk.best_row(partial, ["o_custkey"], {"o_orderdate": False, "o_orderkey": False})
    rows = t.customer.select("c_custkey").join(first, F.col("c_custkey") == F.col("o_custkey"), "left")
    return rows.select(
        "c_custkey", F.coalesce("o_orderkey", F.lit(-1)).alias("first_order"),
        F.coalesce(F.date_format("o_orderdate", "yyyy-MM-dd"), F.lit("none")).alias("first_date"))


@query("latest_per_group", sql="""
SELECT o_custkey, o_orderkey, o_orderstatus, strftime(o_orderdate, '%Y-%m-%d') AS o_orderdate FROM (
  SELECT *, ROW_NUMBER() OVER (PARTITION BY o_custkey ORDER BY o_orderdate DESC, o_orderkey DESC) AS r FROM orders)
WHERE r = 1 AND o_orderstatus <> 'F'""")
def latest_per_group(t: Tables):
    """Customers whose latest order is not finished: the filter comes after the choice."""
    rows = t.orders.select("o_custkey", "o_orderkey", "o_orderstatus", "o_orderdate")
    latest = rk.latest_per_group(rows, ["o_custkey"], "o_orderdate", ["o_orderkey"]).where("o_orderstatus <> 'F'")
    return latest.select("o_custkey", "o_orderkey", "o_orderstatus", day_text("o_orderdate", "o_orderdate"))


@query("latest_or_none", sql="""
SELECT c_custkey, COALESCE(strftime(o_orderdate, '%Y-%m-%d'), ' none') AS last_partial FROM customer LEFT JOIN (
  SELECT *, ROW_NUMBER() OVER (PARTITION BY o_custkey ORDER BY o_orderdate DESC, o_orderkey DESC) AS r
  FROM orders WHERE o_orderstatus = 'P') o ON o_custkey = c_custkey AND r = 1""")
def latest_or_none(t: Tables):
    rows = t.orders.where("o_orderstatus = 'P'").select(
        F.col("o_custkey").alias("c_custkey"), "o_orderkey", F.date_format("o_orderdate", "yyyy-MM-dd").alias("last_partial"))
    out = rk.latest_or_none(
        t.customer.select("c_custkey"), rows, "c_custkey", "last_partial", ["o_orderkey"], "last_partial")
    return out.select("c_custkey", "last_partial")
