"""Grouped, share-of-total and string aggregation queries."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from setwise.functions.measures import money, safe_ratio, smoothed_ratio
from setwise.operators import aggregates as ag
from setwise.operators.incremental import rollup_since
from setwise.plans.registry import day_text, number, query, time_text
from setwise.sources.tables import Tables

def revenue() -> Column:
    return money("l_extendedprice") * (F.lit(1) - F.col("l_discount").cast("decimal(4,2)"))

_REV_SQL = "CAST(l_extendedprice AS DECIMAL(18,2)) * (1 - CAST(l_discount AS DECIMAL(4,2)))"


def revenue_by_part(t: Tables) -> DataFrame:
    """One row per part key: the big table shrinks before any join."""
    return t.lineitem.groupBy("l_partkey").agg(F.sum(revenue()).alias("revenue"))


def revenue_by_brand(t: Tables) -> DataFrame:
    joined = revenue_by_part(t).join(t.part.select("p_partkey", "p_brand"), F.col("l_partkey") == F.col("p_partkey"))
    return joined.groupBy("p_brand").agg(F.sum("revenue").cast("decimal(28,4)").alias("revenue"))


@query("pareto", sql=f"""
WITH b AS (SELECT p_brand, SUM({_REV_SQL}) AS revenue FROM lineitem JOIN part ON l_partkey = p_partkey GROUP BY p_brand),
w AS (SELECT p_brand, revenue, SUM(revenue) OVER () AS total,
  SUM(revenue) OVER (ORDER BY revenue DESC, p_brand ROWS UNBOUNDED PRECEDING) AS running,
  ROW_NUMBER() OVER (ORDER BY revenue DESC, p_brand) AS row_no FROM b)
SELECT p_brand, row_no, CAST(revenue AS DOUBLE) AS revenue, CAST(running AS DOUBLE) AS running,
  ROUND(CAST(100 * running AS DOUBLE) / CAST(total AS DOUBLE), 4) AS running_pct
FROM w WHERE (running - revenue) * 100 < 95 * total""")
def pareto(t: Tables) -> DataFrame:
    """Brands making 95 % of revenue."""
    out = ag.pareto(revenue_by_brand(t), "p_brand", "revenue", 95)
    pct = (F.col("running").cast("double") * 100 / F.col("total").cast("double"))
    return out.select("p_brand", "row_no", number("revenue"), number("running"), F.round(pct, 4).alias("running_pct"))


@query("pareto_parts", sql=f"""
WITH b AS (SELECT l_partkey, SUM({_REV_SQL}) AS revenue FROM lineitem GROUP BY l_partkey),
w AS (SELECT l_partkey, revenue, SUM(revenue) OVER () AS total,
  SUM(revenue) OVER (ORDER BY revenue DESC, l_partkey ROWS UNBOUNDED PRECEDING) AS running,
  ROW_NUMBER() OVER (ORDER BY revenue DESC, l_partkey) AS row_no FROM b)
SELECT l_partkey, row_no, CAST(revenue AS DOUBLE) AS revenue, CAST(running AS DOUBLE) AS running
FROM w WHERE (running - revenue) * 100 < 80 * total""")
def pareto_parts(t: Tables) -> DataFrame:
    """Parts making 80 % of revenue: the item list itself is large."""
    items = revenue_by_part(t).withColumn("revenue", F.col("revenue").cast("decimal(28,4)"))
    out = ag.pareto(items, "l_partkey", "revenue", 80)
    return out.select("l_partkey", "row_no", number("revenue"), number("running"))


@query("rollup_total", sql="""
WITH d AS (SELECT r_name, n_name, COUNT(*) AS customers, SUM(CAST(c_acctbal AS DECIMAL(18,2))) AS balance
  FROM customer JOIN nation ON c_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey GROUP BY r_name, n_name)
SELECT r_name, n_name, customers, CAST(balance AS DOUBLE) AS balance, 0 AS sort_group FROM d
UNION ALL SELECT '', '*** Total ***', SUM(customers)::BIGINT, CAST(SUM(balance) AS DOUBLE), 1 FROM d""")
def rollup_total(t: Tables) -> DataFrame:
    per_nation = t.customer.groupBy("c_nationkey").agg(
        F.count(F.lit(1)).alias("n"), F.sum(money("c_acctbal")).alias("b"))
    rows = per_nation.join(t.nation, F.col("c_nationkey") == F.col("n_nationkey")).join(
        t.region, F.col("n_regionkey") == F.col("r_regionkey"))
    out = ag.rollup_total(rows, "r_name", "n_name", {"customers": F.sum("n"), "balance": F.sum("b")})
    return out.select(F.coalesce("r_name", F.lit("")).alias("r_name"), "n_name", "customers", number("balance"), "sort_group")


@query("share_of_total", sql=f"""
WITH b AS (SELECT p_brand, SUM({_REV_SQL}) AS revenue FROM lineitem JOIN part ON l_partkey = p_partkey GROUP BY p_brand)
SELECT p_brand, CAST(revenue AS DOUBLE) AS revenue,
  ROUND(100 * CAST(revenue AS DOUBLE) / CAST(SUM(revenue) OVER () AS DOUBLE), 2) AS pct FROM b""")
def share_of_total(t: Tables) -> DataFrame:
    out = ag.share_of_total(revenue_by_brand(t), "revenue")
    return out.select("p_brand", number("revenue"), number("pct"))


@query("status_summary", sql="""
SELECT year(ts) AS y, month(ts) AS m, (dayofyear(ts) + dayofweek(date_trunc('year', ts)) - 1) // 7 + 1 AS week,
  day(ts) AS d, COUNT(*) AS executions,
  COUNT(*) FILTER (event_type IN ('purchase', 'signup')) AS successes,
  COUNT(*) FILTER (event_type = 'error') AS errors,
  COUNT(*) FILTER (event_type NOT IN ('purchase', 'signup', 'error')) AS others
FROM events GROUP BY ALL""")
def status_summary(t: Tables) -> DataFrame:
    from setwise.functions.times import week_us

    keys = [F.year("ts").alias("y"), F.month("ts").alias("m"), week_us("ts").alias("week"), F.dayofmonth("ts").alias("d")]
    labels = {"successes": ["purchase", "signup"], "errors": ["error"]}
    return ag.status_summary(t.events, keys, "event_type", labels).withColumn(
        "others", F.col("executions") - F.col("successes") - F.col("errors"))


@query("status_by_order_year", sql="""
SELECT year(o_orderdate) AS y, COUNT(*) AS executions, COUNT(*) FILTER (o_orderstatus = 'F') AS finished,
  COUNT(*) FILTER (o_orderstatus = 'O') AS open, COUNT(*) FILTER (o_orderstatus = 'P') AS partial
FROM orders GROUP BY 1""")
def status_by_order_year(t: Tables) -> DataFrame:
    labels = {"finished": ["F"], "open": ["O"], "partial": ["P"]}
    return ag.status_summary(t.orders, [F.year("o_orderdate").alias("y")], "o_orderstatus", labels)


_BUCKETS_SQL = ",\n  ".join(
    f"COUNT(*) FILTER (l_quantity BETWEEN {lo} AND {lo + 5}) AS bucket{lo + 5}" for lo in range(0, 50, 5))


@query("bucket_profile", sql=f"""
SELECT l_returnflag, COUNT(*) AS touches, ROUND(AVG(CAST(l_extendedprice AS DECIMAL(18,2))), 3) AS avg_duration,
  CAST(SUM(CAST(l_extendedprice AS DECIMAL(18,2))) AS DOUBLE) AS total_duration,
  ROUND(AVG(CAST(l_quantity AS DECIMAL(18,2))), 3) AS avg_measure,
  {_BUCKETS_SQL}
FROM lineitem WHERE l_shipdate > TIMESTAMP '1996-01-01' GROUP BY 1""")
def bucket_profile(t: Tables) -> DataFrame:
    since = t.lineitem.where(F.col("l_shipdate") > F.lit("1996-01-01").cast("timestamp_ntz"))
    edges = list(range(0, 51, 5))
    out = ag.bucket_profile(since, "l_returnflag", money("l_extendedprice"), money("l_quantity"), edges)
    return out.withColumns({
        "avg_duration": F.round(F.col("avg_duration").cast("double"), 3),
        "total_duration": F.col("total_duration").cast("double"),
        "avg_measure": F.round(F.col("avg_measure").cast("double"), 3)})


@query("count_by", sql="SELECT event_type, COUNT(*) AS n FROM events GROUP BY event_type")
def count_by(t: Tables) -> DataFrame:
    return ag.count_by(t.events, "event_type").orderBy(F.col("n").desc(), "event_type")


TABLE_NAMES = ("region nation customer supplier part orders lineitem events documents embeddings pages benchmark "
               "labels conversations").split()


@query("row_counts", sql=" UNION ALL ".join(
    f"SELECT '{n}' AS table_name, COUNT(*) AS rows FROM {n}" for n in TABLE_NAMES))
def row_counts(t: Tables) -> DataFrame:
    return ag.row_counts({n: t.read(n) for n in TABLE_NAMES})


@query("safe_ratios", sql="""
WITH a AS (SELECT s_suppkey, COUNT(l_suppkey) AS n, COALESCE(SUM(CAST(l_extendedprice AS DECIMAL(18,2))), 0) AS price,
  COUNT(*) FILTER (l_returnflag = 'R') AS returned
  FROM supplier LEFT JOIN lineitem ON l_suppkey = s_suppkey GROUP BY s_suppkey)
SELECT s_suppkey, ROUND(CAST(price AS DOUBLE) / (1 + n), 2) AS smoothed,
  ROUND(CAST(price AS DOUBLE) / NULLIF(returned, 0), 2) AS per_return FROM a""")
def safe_ratios(t: Tables) -> DataFrame:
    per = t.lineitem.groupBy("l_suppkey").agg(
        F.count(F.lit(1)).alias("n"), F.sum(money("l_extendedprice")).alias("price"),
        F.count_if(F.col("l_returnflag") == "R").alias("returned"))
    rows = t.supplier.select("s_suppkey").join(per, F.col("s_suppkey") == F.col("l_suppkey"), "left").fillna(
        0, ["n", "price", "returned"]).withColumn("price", F.col("price").cast("double"))
    return rows.select(
        "s_suppkey", F.round(smoothed_ratio("price", F.col("n")).cast("double"), 2).alias("smoothed"),
        F.round(safe_ratio("price", "returned"), 2).alias("per_return"))


@query("global_average", sql="""
SELECT ROUND(AVG(CAST(o_totalprice AS DECIMAL(18,2))), 2) AS average, COUNT(*) AS n FROM orders WHERE o_orderstatus = 'O'""")
def global_average(t: Tables) -> DataFrame:
    return t.orders.where("o_orderstatus = 'O'").agg(
        F.round(F.avg(money("o_totalprice")).cast("double"), 2).alias("average"), F.count(F.lit(1)).alias("n"))


@query("distinct_rows", sql="""
SELECT DISTINCT c_nationkey, c_mktsegment, o_orderstatus FROM customer JOIN orders ON o_custkey = c_custkey""")
def distinct_rows(t: Tables) -> DataFrame:
    # Distinct before the join too: one order row per (customer, status) is enough.
    statuses = t.orders.select("o_custkey", "o_orderstatus").distinct()
    joined = t.customer.join(statuses, F.col("o_custkey") == F.col("c_custkey"))
    return joined.select("c_nationkey", "c_mktsegment", "o_orderstatus").distinct()


@query("merge_partials", sql="""
SELECT user_id, event_type, strftime(MAX(ts), '%Y-%m-%d %H:%M:%S.%f') AS latest,
  strftime(MIN(ts), '%Y-%m-%d %H:%M:%S.%f') AS earliest, COUNT(*) AS n FROM events GROUP BY user_id, event_type""")
def merge_partials(t: Tables) -> DataFrame:
    daily = rollup_since(t.events.withColumn("day", F.col("ts").cast("date")), None, ["day", "user_id", "event_type"], "ts")
    out = ag.merge_partials(daily, ["user_id", "event_type"], ["latest"], ["earliest"], ["n"])
    return out.select("user_id", "event_type", time_text("latest", "latest"), time_text("earliest", "earliest"), "n")


@query("count_distinct_sources", sql="""
WITH o AS (SELECT o_custkey, o_orderkey, COUNT(*) AS part FROM orders JOIN lineitem ON l_orderkey = o_orderkey GROUP BY ALL)
SELECT o_custkey, SUM(part)::BIGINT AS total, COUNT(*) AS parts FROM o GROUP BY o_custkey HAVING SUM(part) > 40""")
def count_distinct_sources(t: Tables) -> DataFrame:
    # Lines are counted per order before they meet the orders.
    lines = t.lineitem.groupBy("l_orderkey").agg(F.count(F.lit(1)).alias("lines"))
    rows = t.orders.select("o_orderkey", "o_custkey").join(lines, F.col("o_orderkey") == F.col("l_orderkey"))
    return ag.two_level_count(
        rows, ["o_custkey", "o_orderkey"], ["o_custkey"], lambda: F.sum("lines"), F.col("total") > 40)


@query("group_concat", sql="""
WITH d AS (SELECT DISTINCT p_brand, p_type FROM part)
SELECT p_brand, string_agg(p_type, ',' ORDER BY p_type) AS types FROM d GROUP BY p_brand""")
def group_concat(t: Tables) -> DataFrame:
    return ag.group_concat(t.part, ["p_brand"], "p_type", distinct=True, name="types")


@query("group_concat_sorted", sql="""
SELECT r_name, string_agg(n_name, '|' ORDER BY n_name DESC) AS nations, string_agg(n_name, '|' ORDER BY n_name) AS nations_up
FROM nation JOIN region ON n_regionkey = r_regionkey GROUP BY r_name""")
def group_concat_sorted(t: Tables) -> DataFrame:
    rows = t.nation.join(t.region, F.col("n_regionkey") == F.col("r_regionkey"))
    down = ag.group_concat(rows, ["r_name"], "n_name", "|", descending=True, name="nations")
    return down.join(ag.group_concat(rows, ["r_name"], "n_name", "|", name="nations_up"), "r_name")


@query("group_concat_parts", sql="""
WITH r AS (SELECT p_brand, p_partkey, (ROW_NUMBER() OVER (PARTITION BY p_brand ORDER BY p_partkey) - 1) // 50 + 1 AS part_no FROM part)
SELECT p_brand, part_no, COUNT(*) AS n, string_agg(p_partkey::VARCHAR, ',' ORDER BY p_partkey) AS parts
FROM r GROUP BY p_brand, part_no""")
def group_concat_parts(t: Tables) -> DataFrame:
    return ag.group_concat_parts(
        t.part.select("p_brand", "p_partkey"), ["p_brand"], "p_partkey", [F.col("p_partkey").asc()], rows_per_part=50,
        name="parts")


@query("rollup_strings", sql="""
WITH d AS (SELECT DISTINCT n_name, o_orderpriority, o_orderstatus FROM orders JOIN customer ON o_custkey = c_custkey JOIN nation ON c_nationkey = n_nationkey),
i AS (SELECT n_name, o_orderpriority, string_agg(o_orderstatus, ',' ORDER BY o_orderstatus) AS s FROM d GROUP BY ALL)
SELECT n_name, string_agg(o_orderpriority || '=' || s, '; ' ORDER BY o_orderpriority) AS priorities FROM i GROUP BY n_name""")
def rollup_strings(t: Tables) -> DataFrame:
    per_customer = t.orders.select("o_custkey", "o_orderpriority", "o_orderstatus").distinct()
    rows = per_customer.join(t.customer, F.col("o_custkey") == F.col("c_custkey")).join(
        t.nation, F.col("c_nationkey") == F.col("n_nationkey"))
    return ag.rollup_strings(rows, ["n_name"], "o_orderpriority", "o_orderstatus", name="priorities")


@query("accumulate_list", sql="""
SELECT string_agg('"' || substr(e, 2) || '"', ', ' ORDER BY '"' || substr(e, 2) || '"') AS seen
FROM (SELECT DISTINCT event_type AS e FROM events)""")
def accumulate_list(t: Tables) -> DataFrame:
    return ag.accumulate_list(t.events, "event_type", strip_chars=1, name="seen")


@query("accumulate_parts", sql="""
WITH d AS (SELECT DISTINCT '"' || substr(url, 2) || '"' AS e FROM pages WHERE url IS NOT NULL),
r AS (SELECT e, (ROW_NUMBER() OVER (ORDER BY e) - 1) // 100 + 1 AS part_no FROM d)
SELECT part_no, COUNT(*) AS n, string_agg(e, ', ' ORDER BY e) AS seen FROM r GROUP BY part_no""")
def accumulate_parts(t: Tables) -> DataFrame:
    """All different addresses as numbered lists of a hundred."""
    return ag.accumulate_parts(t.pages, "url", strip_chars=1, rows_per_part=100, name="seen")


@query("wait_digest", sql="""
WITH w AS (SELECT user_id, event_type, COUNT(*) AS n, MIN(v) AS lo, MAX(v) AS hi, SUM(v)::BIGINT // COUNT(*) AS mid
  FROM (SELECT user_id, event_type, CAST(ROUND(value * 100) AS BIGINT) AS v FROM events) GROUP BY ALL)
SELECT user_id, string_agg('(' || n || 'x: ' || CASE WHEN lo = hi THEN lo::VARCHAR WHEN n = 2 THEN lo || '/' || hi
  ELSE lo || '/' || mid || '/' || hi END || 'ms)' || event_type, ', ' ORDER BY n DESC, event_type) AS digest
FROM w GROUP BY user_id""")
def wait_digest(t: Tables) -> DataFrame:
    rows = t.events.select("user_id", "event_type", F.round(F.col("value") * 100).cast("bigint").alias("ms"))
    return ag.wait_digest(rows, ["user_id"], "event_type", "ms")


@query("txn_digest", sql="""
WITH w AS (SELECT o_custkey, o_orderpriority, COUNT(*) AS n, CAST(SUM(CAST(ROUND(o_totalprice) AS BIGINT)) AS BIGINT) // 1024 AS kb, MIN(o_orderdate) AS b
  FROM orders GROUP BY ALL)
SELECT o_custkey, string_agg(o_orderpriority || ': ' || n || ' (' || kb || ' kB)', ', ' ORDER BY o_orderpriority) AS digest,
  strftime(MIN(b), '%Y-%m-%d') AS first_begin FROM w GROUP BY o_custkey""")
def txn_digest(t: Tables) -> DataFrame:
    rows = t.orders.select(
        "o_custkey", "o_orderpriority", F.lit(1).cast("bigint").alias("writes"),
        F.round("o_totalprice").cast("bigint").alias("bytes"), "o_orderdate")
    out = ag.txn_digest(rows, ["o_custkey"], "o_orderpriority", "writes", "bytes", "o_orderdate")
    return out.select("o_custkey", "digest", day_text("first_begin", "first_begin"))


@query("share_of_capacity", sql="""
WITH q AS (SELECT l_partkey, SUM(CAST(l_quantity AS DECIMAL(18,2))) AS moved, SUM(CAST(l_quantity AS DECIMAL(18,2))) FILTER (l_returnflag = 'R') AS back
  FROM lineitem WHERE l_shipdate < TIMESTAMP '1995-06-01' GROUP BY 1)
SELECT p_partkey, CAST(COALESCE(back, 0) AS DOUBLE) AS back, CAST(COALESCE(moved, 0) AS DOUBLE) AS moved,
  ROUND(CAST(100 * COALESCE(back, 0) AS DOUBLE) / CASE WHEN COALESCE(moved, 0) = 0 THEN 0.001 ELSE CAST(moved AS DOUBLE) END, 2) AS pct
FROM part LEFT JOIN q ON l_partkey = p_partkey""")
def share_of_capacity(t: Tables) -> DataFrame:
    """Share of each part's early quantity that came back; parts that never moved have a capacity of zero."""
    early = t.lineitem.where(F.col("l_shipdate") < F.lit("1995-06-01").cast("timestamp_ntz"))
    moved = early.groupBy("l_partkey").agg(
        F.sum(money("l_quantity")).alias("moved"), F.sum(F.when(F.col("l_returnflag") == "R", money("l_quantity"))).alias("back"))
    rows = t.part.select("p_partkey").join(moved, F.col("l_partkey") == F.col("p_partkey"), "left").select(
        "p_partkey", *[F.coalesce(F.col(c), F.lit(0)).cast("double").alias(c) for c in ("back", "moved")])
    return ag.share_of_capacity(rows, "back", "moved", type_="double").withColumn("pct", F.round("pct", 2))
