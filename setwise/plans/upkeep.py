"""Snapshot, rollup, upsert, queue and documentation queries."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from setwise.functions.measures import money
from setwise.functions.times import int_div
from setwise.operators import aggregates as ag
from setwise.operators import documentation as doc
from setwise.operators import incremental as inc
from setwise.operators import joins as jn
from setwise.operators import maintenance as mt
from setwise.operators import ranking as rk
from setwise.plans.aggregation import TABLE_NAMES
from setwise.plans.registry import day_text, number, query, time_text
from setwise.session import scratch_path
from setwise.sources import sinks, tables
from setwise.sources.tables import Dataset, Tables, choose_datasets, for_each_dataset, run_each_dataset


def user_snapshot(t: Tables, until: str) -> DataFrame:
    """Running totals per user as captured at one moment."""
    seen = t.events.where(F.col("ts") < F.lit(until).cast("timestamp_ntz"))
    is_start = F.when(F.col("event_type") == "signup", F.col("ts"))
    return seen.groupBy("user_id").agg(
        F.max(is_start).alias("started"), F.sum(money("value")).alias("value"), F.count(F.lit(1)).alias("reads"),
        F.count_if(F.col("event_type") == "error").alias("errors"))


_SNAP = """SELECT user_id, MAX(ts) FILTER (event_type = 'signup') AS started, SUM(CAST(value AS DECIMAL(18,2))) AS value, COUNT(*) AS reads,
  COUNT(*) FILTER (event_type = 'error') AS errors FROM events WHERE ts < TIMESTAMP '{}' GROUP BY user_id"""


@query("snapshot_delta", sql=f"""
WITH a AS ({_SNAP.format('2024-01-10')}), b AS ({_SNAP.format('2024-01-12')}),
j AS (SELECT b.user_id, b.reads, b.value - a.value AS v, b.reads - a.reads AS r, b.errors - a.errors AS e, a.started = b.started AS same FROM b LEFT JOIN a ON a.user_id = b.user_id)
SELECT user_id, reads, COALESCE(CASE WHEN same AND v >= 0 THEN CAST(v AS DOUBLE) END, -1) AS value_delta,
  COALESCE(CASE WHEN same THEN r END, -1) AS reads_delta, COALESCE(CASE WHEN same THEN greatest(r, e) END, -1) AS busiest_delta FROM j""")
def snapshot_delta(t: Tables):
    """What users did between two captures; NULL (-1 here) after a new signup in between."""
    out = inc.snapshot_delta(
        user_snapshot(t, "2024-01-10"), user_snapshot(t, "2024-01-12"), ["user_id"], "started", ["value", "reads"],
        {"busiest": ("reads", "errors")})
    filled = lambda c: F.coalesce(F.col(c), F.lit(-1)).alias(c)
    return out.select("user_id", "reads", F.coalesce(number("value_delta"), F.lit(-1.0)).alias("value_delta"),
                      filled("reads_delta"), filled("busiest_delta"))


@query("snapshot_series_delta", sql="""
WITH l AS (SELECT event_id, user_id, ROUND(value * 100)::BIGINT AS cents, event_type, LAG(ROUND(value * 100)::BIGINT) OVER w AS p, LAG(event_type) OVER w AS pt,
  ROW_NUMBER() OVER w AS capture_no FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts, event_id))
SELECT event_id, capture_no, COALESCE(CASE WHEN event_type = pt AND cents >= p THEN cents - p END, -1) AS cents_delta FROM l""")
def snapshot_series_delta(t: Tables):
    """Each event as a capture of its user: growth since the one before of the same kind."""
    rows = t.events.select("event_id", "user_id", "ts", "event_type", F.round(F.col("value") * 100).cast("bigint").alias("cents"))
    out = inc.snapshot_series_delta(rows, ["user_id"], "ts", ["cents"], "event_type", ["event_id"])
    return out.select("event_id", "capture_no", F.coalesce("cents_delta", F.lit(-1)).alias("cents_delta"))


@query("hwm_rollup", sql="""
SELECT user_id, event_type, strftime(MAX(ts), '%Y-%m-%d %H:%M:%S.%f') AS latest, strftime(MIN(ts), '%Y-%m-%d %H:%M:%S.%f') AS earliest,
  COUNT(*) AS n FROM events GROUP BY ALL""")
def hwm_rollup(t: Tables):
    """Three runs over a growing table, each adding only what is newer than the store; then merged."""
    store = scratch_path(t.spark, "rollup")
    mark = None
    for until in ("2024-01-10", "2024-01-20", None):
        source = t.events if until is None else t.events.where(F.col("ts") < F.lit(until).cast("timestamp_ntz"))
        sinks.append(inc.rollup_since(source, mark, ["user_id", "event_type"], "ts"), store)
        mark = inc.high_water_mark(t.spark.read.parquet(store))
    merged = ag.merge_partials(t.spark.read.parquet(store), ["user_id", "event_type"], ["latest"], ["earliest"], ["n"])
    return merged.select("user_id", "event_type", time_text("latest", "latest"), time_text("earliest", "earliest"), "n")


@query("rollup_unread", sql="""
SELECT user_id, event_type, strftime(MAX(ts), '%Y-%m-%d %H:%M:%S.%f') AS latest, strftime(MIN(ts), '%Y-%m-%d %H:%M:%S.%f') AS earliest,
  COUNT(*) AS n FROM events GROUP BY ALL""")
def rollup_unread(t: Tables):
    """Four loads, each with events of the whole time: what was read is remembered, so late and tied ones are counted."""
    loads = t.events.withColumn("load", F.col("event_id") % 4)
    store, done = scratch_path(t.spark, "rollup"), scratch_path(t.spark, "loads")
    for arrived in range(4):
        read = None if not arrived else t.spark.read.schema("load bigint").parquet(done)
        source = loads.where(F.col("load") <= arrived)
        sinks.append(inc.rollup_unread(source, read, "load", ["user_id", "event_type"], "ts"), store)
        sinks.append(source.select("load").distinct(), done)
    merged = ag.merge_partials(t.spark.read.parquet(store), ["user_id", "event_type"], ["latest"], ["earliest"], ["n"])
    return merged.select("user_id", "event_type", time_text("latest", "latest"), time_text("earliest", "earliest"), "n")


def daily_summary(orders: DataFrame) -> DataFrame:
    return orders.groupBy(F.col("o_orderdate").cast("date").alias("snapshot_date")).agg(
        F.count(F.lit(1)).alias("n"), F.sum(money("o_totalprice")).alias("price"))


@query("replace_snapshot", sql="""
SELECT strftime(o_orderdate, '%Y-%m') AS month, COUNT(*) AS n, CAST(SUM(CAST(o_totalprice AS DECIMAL(18,2))) AS DOUBLE) AS price FROM orders GROUP BY 1""")
def replace_snapshot(t: Tables):
    """A monthly summary loaded twice for its last months: the second load replaces, not adds."""
    store = scratch_path(t.spark, "snapshot")
    monthly = daily_summary(t.orders).groupBy(F.date_format("snapshot_date", "yyyy-MM").alias("month")).agg(
        F.sum("n").alias("n"), F.sum("price").alias("price"))
    sinks.replace_partitions(monthly, store, ["month"])
    sinks.replace_partitions(monthly.where("month >= '2000-01'"), store, ["month"])
    stored = t.spark.read.schema("n bigint, price decimal(38,2), month string").parquet(store)
    return stored.select("month", "n", number("price"))


@query("capacity_snapshot", sql="""
WITH s AS (SELECT l_suppkey, SUM(l_quantity::BIGINT) FILTER (l_linestatus = 'O') AS d, SUM(l_quantity::BIGINT) FILTER (l_linestatus = 'F') AS l,
  SUM(l_linenumber) FILTER (l_linestatus = 'O') AS du, SUM(l_linenumber) FILTER (l_linestatus = 'F') AS lu, MAX(l_shipdate) AS m FROM lineitem GROUP BY 1)
SELECT l_suppkey, ROUND(d / 128, 4) AS data_size, ROUND(l / 128, 4) AS log_size, ROUND((d - du) / 128, 4) AS data_free, ROUND((l - lu) / 128, 4) AS log_free,
  strftime(m, '%Y-%m-%d') AS latest FROM s""")
def capacity_snapshot(t: Tables):
    """Per supplier: size and free space by kind, and the latest date."""
    files = t.lineitem.select("l_suppkey", "l_linestatus", F.col("l_quantity").cast("bigint").alias("pages"), "l_linenumber", "l_shipdate")
    out = inc.capacity_snapshot(
        files, "l_suppkey", "l_linestatus", {"data": "O", "log": "F"}, "pages", "l_linenumber",
        also={"latest": F.date_format(F.max("l_shipdate"), "yyyy-MM-dd")})
    return out.select("l_suppkey", *[number(c) for c in ("data_size", "log_size", "data_free", "log_free")], "latest")


def index_metrics(t: Tables) -> DataFrame:
    """Lines read as physical statistics of indexes."""
    return t.lineitem.select(
        F.col("l_suppkey").alias("database_id"), F.col("l_partkey").alias("object_id"), F.col("l_linenumber").alias("index_id"),
        (F.col("l_orderkey") % 3 + 1).cast("int").alias("partition_number"),
        F.round(F.col("l_discount") * 500).cast("int").alias("fragmentation"), F.col("l_quantity").cast("int").alias("page_count"),
        F.floor("l_extendedprice").alias("range_scan_count"), F.when(F.col("l_returnflag") == "A", 1).otherwise(0).alias("index_level"),
        F.col("l_quantity").cast("bigint").alias("rows"), (F.col("l_linestatus") == "F").alias("contains_lob"),
        (F.round(F.col("l_tax") * 100).cast("int") % 2 == 0).alias("allow_page_locks"))


def index_exclusions(t: Tables) -> DataFrame:
    """Every index has weekdays on which it rests."""
    return t.lineitem.select(
        F.col("l_suppkey").alias("database_id"), F.col("l_partkey").alias("object_id"), F.col("l_linenumber").alias("index_id")
    ).distinct().withColumn("exclusion_mask", ((F.col("database_id") + F.col("object_id")) % 128).cast("int"))


_QUEUE = """WITH m AS (SELECT l_suppkey AS database_id, l_partkey AS object_id, l_linenumber AS index_id, CAST(l_orderkey % 3 + 1 AS INTEGER) AS partition_number,
  CAST(ROUND(l_discount * 500) AS INTEGER) AS fragmentation, CAST(l_quantity AS INTEGER) AS page_count, CAST(floor(l_extendedprice) AS BIGINT) AS range_scan_count,
  CASE WHEN l_returnflag = 'A' THEN 1 ELSE 0 END AS index_level, l_linestatus = 'F' AS lob, CAST(ROUND(l_tax * 100) AS INTEGER) % 2 = 0 AS locks FROM lineitem),
q AS (SELECT database_id, object_id, index_id, partition_number, range_scan_count, SUM(fragmentation)::BIGINT AS fragmentation, SUM(page_count)::BIGINT AS page_count,
  bool_or(lob) AS lob, bool_and(locks) AS locks FROM m WHERE fragmentation >= 10 AND index_id > 0 AND page_count > 8 AND index_level = 0 GROUP BY ALL),
s AS (SELECT database_id, object_id, index_id, MAX(partition_number) AS parts FROM m GROUP BY ALL),
k AS (SELECT q.*, parts FROM q JOIN s USING (database_id, object_id, index_id) WHERE NOT (parts > 1 AND partition_number = parts)
  AND (((database_id + object_id) % 128) & 4) = 0 AND page_count BETWEEN 8 AND 60),
a AS (SELECT *, CASE WHEN (fragmentation < 30 OR lob OR parts > 1) AND locks THEN 'REORGANIZE'
  WHEN (fragmentation >= 30 OR NOT locks) AND NOT lob AND parts <= 1 THEN 'REBUILD' ELSE 'NONE' END AS action FROM k)
"""
_OPTIONS = mt.QueueOptions(max_pages=60, exclude_max_partition=True, order_column="fragmentation")


def tuesday_queue(t: Tables) -> DataFrame:
    return mt.maintenance_queue(index_metrics(t), index_exclusions(t), 3, _OPTIONS)


@query("maintenance_queue", sql=_QUEUE + """
SELECT database_id, object_id, index_id, partition_number, range_scan_count, fragmentation, page_count, action FROM a""")
def maintenance_queue(t: Tables):
    """What to maintain on a Tuesday, and how."""
    return tuesday_queue(t).orderBy(*mt.queue_order(_OPTIONS)).select(
        *mt.QUEUE_KEYS, "range_scan_count", "fragmentation", "page_count", "action")


@query("budgeted_queue", sql=_QUEUE + """,
w AS (SELECT *, ROW_NUMBER() OVER o AS queue_no, SUM(page_count) OVER (o ROWS UNBOUNDED PRECEDING) AS end_at FROM a
  WINDOW o AS (ORDER BY fragmentation DESC, database_id, object_id, index_id, partition_number, range_scan_count))
SELECT queue_no, database_id, object_id, index_id, partition_number, action, end_at::BIGINT AS end_at, (end_at - page_count)::BIGINT AS start_at FROM w WHERE end_at - page_count < 28800""")
def budgeted_queue(t: Tables):
    """The queue until eight hours (in seconds, one per page) are spent."""
    out = mt.budgeted_queue(tuesday_queue(t), mt.queue_order(_OPTIONS), "page_count", 8 * 3600)
    return out.select("queue_no", "database_id", "object_id", "index_id", "partition_number", "action", "end_at", "start_at")


def customer_changes(t: Tables) -> DataFrame:
    """Suppliers as customer changes: every fourth has no key yet, some keys do not exist."""
    key = F.when(F.col("s_suppkey") % 4 == 0, F.lit(0)).otherwise(F.col("s_suppkey") * 20 + 1)
    return t.supplier.select(
        key.cast("bigint").alias("c_custkey"), F.col("s_name").alias("c_name"), F.col("s_nationkey").alias("c_nationkey"),
        F.col("s_acctbal").alias("c_acctbal"), F.lit("CHANGED").alias("c_mktsegment"))


@query("keyed_table", sql="""
WITH s AS (SELECT CASE WHEN s_suppkey % 4 = 0 THEN 0 ELSE s_suppkey * 20 + 1 END AS k, s_name, s_nationkey, s_acctbal FROM supplier),
u AS (SELECT * FROM s WHERE k <> 0 AND k IN (SELECT c_custkey FROM customer))
SELECT * FROM customer WHERE c_custkey NOT IN (SELECT k FROM u)
UNION ALL SELECT k, s_name, s_nationkey, s_acctbal, 'CHANGED' FROM u
UNION ALL SELECT (SELECT MAX(c_custkey) FROM customer) + ROW_NUMBER() OVER (ORDER BY s_name, s_nationkey, s_acctbal), s_name, s_nationkey, s_acctbal, 'CHANGED' FROM s WHERE k = 0""")
def keyed_table(t: Tables):
    """Insert where the key is empty, update where it exists."""
    return inc.upsert(t.customer, customer_changes(t), "c_custkey")


@query("keyed_table_text", sql="""
WITH s AS (SELECT CASE WHEN s_suppkey % 4 = 0 THEN '' ELSE c_name END AS k, s_nationkey, s_acctbal FROM supplier JOIN customer ON c_custkey = s_suppkey * 10),
v AS (SELECT k, s_nationkey, s_acctbal, 1 AS version FROM s UNION ALL SELECT k, s_nationkey, s_acctbal + 1, 2 FROM s)
SELECT c_name, c_nationkey, c_acctbal FROM customer WHERE c_name NOT IN (SELECT k FROM s)
UNION ALL SELECT k, s_nationkey, s_acctbal FROM v WHERE k <> '' AND version = 2
UNION ALL SELECT k, s_nationkey, s_acctbal FROM v WHERE k = ''""")
def keyed_table_text(t: Tables):
    """Text keys: an empty one inserts as it is; of two changes for a key the later version holds."""
    named = t.supplier.join(t.customer, F.col("c_custkey") == F.col("s_suppkey") * 10).select(
        F.when(F.col("s_suppkey") % 4 == 0, "").otherwise(F.col("c_name")).alias("c_name"), F.col("s_nationkey").alias("c_nationkey"),
        F.col("s_acctbal").alias("c_acctbal"))
    versions = named.withColumn("version", F.lit(1)).unionByName(
        named.withColumns({"c_acctbal": F.col("c_acctbal") + 1, "version": F.lit(2)}))
    return inc.upsert(t.customer.select("c_name", "c_nationkey", "c_acctbal"), versions, "c_name", order="version")


@query("keyed_table_delete", sql="""
SELECT c_custkey, c_name FROM customer WHERE c_custkey NOT IN (SELECT CASE WHEN s_suppkey % 4 = 0 THEN 0 ELSE s_suppkey * 20 + 1 END FROM supplier)""")
def keyed_table_delete(t: Tables):
    return inc.delete_keys(t.customer, customer_changes(t), "c_custkey").select("c_custkey", "c_name")


@query("keyed_table_get", sql="SELECT c_custkey, c_name, c_mktsegment FROM customer WHERE c_custkey = (SELECT MAX(c_custkey) FROM customer)")
def keyed_table_get(t: Tables):
    newest = t.customer.agg(F.max("c_custkey")).first()[0]
    return inc.get_by_key(t.customer, "c_custkey", newest).select("c_custkey", "c_name", "c_mktsegment")


@query("for_each_dataset", sql=" UNION ALL ".join(
    f"SELECT '{n}' AS dataset, {c} AS nation, COUNT(*) AS n, 'none' AS query_error FROM {n} GROUP BY 2"
    for n, c in (("customer", "c_nationkey"), ("supplier", "s_nationkey")))
    + " UNION ALL SELECT 'part', -1, -1, 'UNRESOLVED_COLUMN.WITH_SUGGESTION'")
def each_dataset(t: Tables):
    """One query over several datasets; the one without the column reports its error."""
    read = lambda n: lambda: t.read(n).toDF(*[doc.key_suffix(c) for c in t.read(n).columns])
    sets = [Dataset(n, read(n), facts={"kind": "entity"}) for n in ("customer", "supplier", "part")]
    sets += [Dataset(n, read(n), system=True, facts={"kind": "lookup"}) for n in ("nation", "region")]
    chosen = choose_datasets(sets, pattern="*", user_only=True, kind="entity")
    out = for_each_dataset(
        t.spark, chosen, lambda df: df.groupBy(F.col("nationkey").alias("nation")).agg(F.count(F.lit(1)).alias("n")), keep_errors=True)
    return out.select("dataset", *[F.coalesce(c, F.lit(-1)).alias(c) for c in ("nation", "n")],
                      F.coalesce("query_error", F.lit("none")).alias("query_error"))


@query("dated_archive", sql="""
SELECT 'now' AS version, event_type, COUNT(*) AS n FROM events GROUP BY ALL
UNION ALL SELECT 'old', event_type, COUNT(*) FROM events WHERE ts < TIMESTAMP '2024-01-15' GROUP BY ALL""")
def dated_archive(t: Tables):
    """A rollup written twice: the second takes the first's place, which is kept under its date."""
    path = f"{scratch_path(t.spark, 'archive')}/rollup"
    rollup = lambda rows: rows.groupBy("event_type").agg(F.count(F.lit(1)).alias("n"))
    sinks.replace_and_archive(rollup(t.events.where(F.col("ts") < F.lit("2024-01-15").cast("timestamp_ntz"))), path, "2024-01-14")
    old = sinks.replace_and_archive(rollup(t.events), path, "2024-01-15")
    read = lambda p, version: t.spark.read.parquet(p).select(F.lit(version).alias("version"), "event_type", "n")
    return read(path, "now").unionByName(read(old, "old"))


@query("event_files", sql="""
SELECT strftime(ts, '%Y-%m-%d') AS day, event_type, COUNT(*) AS n, COUNT(json_extract_string(props, '$.k')) AS n_k FROM events GROUP BY ALL""")
def event_files(t: Tables):
    """Events landed as JSON files, read in one batch with a declared schema."""
    landed = scratch_path(t.spark, "event-files")
    t.events.write.json(landed)
    read = tables.event_files(t.spark, landed, "event_id bigint, ts timestamp_ntz, event_type string, props string")
    return read.groupBy(day_text("ts", "day"), "event_type").agg(
        F.count(F.lit(1)).alias("n"), F.count(F.get_json_object("props", "$.k")).alias("n_k"))


def labels_by_dataset(t: Tables) -> DataFrame:
    """Labels of each entity by key, from datasets of which one has texts where numbers are asked for and one cannot be read."""
    unreadable = scratch_path(t.spark, "no-parquet")
    t.region.select("r_name").write.text(unreadable)
    broken = lambda: t.spark.read.schema("nationkey bigint, name string").parquet(unreadable)
    read = lambda n, key, label: lambda: t.read(n).select(F.col(key).alias("nationkey"), F.col(label).alias("name"))
    sets = [
        Dataset("customer", read("customer", "c_custkey", "c_name")), Dataset("supplier", read("supplier", "s_suppkey", "s_name")),
        Dataset("part", read("part", "p_brand", "p_name")), Dataset("region", broken)]
    query = lambda df: df.select(F.col("nationkey").cast("bigint").alias("key"), F.col("name").alias("label"))
    return run_each_dataset(t.spark, sets, query, scratch_path(t.spark, "parts"))


_FAILED_DATASETS = "(VALUES ('part', 'CAST_INVALID_INPUT'), ('region', 'FAILED_READ_FILE.NO_HINT')) AS f(dataset, query_error)"


@query("datasets_apart", sql=f"""
SELECT 'customer' AS dataset, c_custkey AS key, c_name AS label, 'none' AS query_error FROM customer
UNION ALL SELECT 'supplier', s_suppkey, s_name, 'none' FROM supplier UNION ALL SELECT dataset, -1, 'none', query_error FROM {_FAILED_DATASETS}""")
def datasets_apart(t: Tables):
    """One query over datasets of which two fail while they run: the others are complete."""
    return labels_by_dataset(t).select(
        "dataset", F.coalesce("key", F.lit(-1)).alias("key"), *[F.coalesce(c, F.lit("none")).alias(c) for c in ("label", "query_error")])


@query("chained_lookup_datasets", sql=f"""
WITH w AS (SELECT 'customer' AS dataset, o_orderkey AS id, o_custkey AS k FROM orders UNION ALL SELECT 'supplier', l_orderkey * 10 + l_linenumber, l_suppkey FROM lineitem
  UNION ALL SELECT 'part', p_partkey, p_partkey FROM part),
t AS (SELECT 'customer' AS dataset, c_custkey AS k, c_name AS label FROM customer UNION ALL SELECT 'supplier', s_suppkey, s_name FROM supplier)
SELECT w.dataset, id, COALESCE(label, 'unknown') AS label, COALESCE(query_error, 'none') AS query_error, COUNT(*) AS n
FROM w LEFT JOIN t USING (dataset, k) LEFT JOIN {_FAILED_DATASETS} ON f.dataset = w.dataset GROUP BY ALL""")
def chained_lookup_datasets(t: Tables):
    """Keys of three datasets resolved in one pass; those of the dataset that failed say so."""
    held = labels_by_dataset(t)
    work = t.orders.select(F.lit("customer").alias("dataset"), F.col("o_orderkey").alias("id"), F.col("o_custkey").alias("k")).union(
        t.lineitem.select(F.lit("supplier"), F.expr("l_orderkey * 10 + l_linenumber"), "l_suppkey")).union(
        t.part.select(F.lit("part"), "p_partkey", "p_partkey"))
    parts = jn.parts_for(work)
    out = jn.chained_lookup(work, [(held.where("query_error IS NULL"), "key", "k", ["label"])], "dataset", held.where("query_error IS NOT NULL"), parts)
    named = out.select("dataset", "id", F.coalesce("label", F.lit("unknown")).alias("label"), F.coalesce("query_error", F.lit("none")).alias("query_error"))
    return jn.dealt(named, parts, *named.columns).groupBy(*named.columns).agg(F.count(F.lit(1)).alias("n"))


@query("restore_chain", sql="""
WITH f AS (SELECT o_custkey, o_orderdate AS fd, o_orderkey AS fk FROM (SELECT *, ROW_NUMBER() OVER (PARTITION BY o_custkey ORDER BY o_orderdate DESC, o_orderkey DESC) AS r
  FROM orders WHERE o_orderstatus = 'F' AND o_orderpriority <> '5-LOW') WHERE r = 1),
d AS (SELECT o_custkey, dk FROM (SELECT o.o_custkey, o.o_orderkey AS dk, ROW_NUMBER() OVER (PARTITION BY o.o_custkey ORDER BY o.o_orderdate DESC, o.o_orderkey DESC) AS r
  FROM orders o JOIN f ON f.o_custkey = o.o_custkey AND o.o_orderdate > fd WHERE o.o_orderstatus = 'P' AND o.o_orderpriority <> '5-LOW') WHERE r = 1)
SELECT o.o_custkey, o.o_orderkey, CASE WHEN o.o_orderkey = fk THEN 1 WHEN o.o_orderkey = dk THEN 2 ELSE 3 END AS step
FROM orders o LEFT JOIN f ON f.o_custkey = o.o_custkey LEFT JOIN d ON d.o_custkey = o.o_custkey
WHERE o.o_orderkey = fk OR o.o_orderkey = dk OR (o.o_orderstatus = 'O' AND o.o_orderkey >= COALESCE(dk, fk, 0))""")
def restore_chain(t: Tables):
    """Orders as backups: finished is full, partial is differential, open is log."""
    rows = t.orders.select("o_custkey", "o_orderkey", "o_orderdate", "o_orderstatus", "o_orderpriority").withColumn(
        "lsn", F.col("o_orderkey"))
    out = inc.restore_chain(
        rows, "o_custkey", "o_orderstatus", "o_orderdate", "lsn", "o_orderkey", F.col("o_orderpriority") == "5-LOW", "F", "P", "O")
    return out.select("o_custkey", "o_orderkey", "step")


@query("restore_files", sql="""
WITH f AS (SELECT o_custkey, o_orderdate AS fd, o_orderkey AS fk FROM (SELECT *, ROW_NUMBER() OVER (PARTITION BY o_custkey ORDER BY o_orderdate DESC, o_orderkey DESC) AS r
  FROM orders WHERE o_orderstatus = 'F') WHERE r = 1),
m AS (SELECT l_orderkey, string_agg('disk' || s, ', ' ORDER BY 'disk' || s) AS devices FROM (SELECT DISTINCT l_orderkey, l_suppkey AS s FROM lineitem) GROUP BY 1)
SELECT f.o_custkey, fk AS o_orderkey, devices FROM f LEFT JOIN m ON l_orderkey = fk""")
def restore_files(t: Tables):
    """The newest full backup of each customer with the list of its devices."""
    rows = t.orders.where("o_orderstatus = 'F'").select("o_custkey", "o_orderkey", "o_orderdate", "o_orderstatus", F.col("o_orderkey").alias("lsn"))
    media = t.lineitem.select(F.col("l_orderkey").alias("o_orderkey"), F.concat(F.lit("disk"), F.col("l_suppkey").cast("string")).alias("device"))
    out = inc.restore_chain(
        rows, "o_custkey", "o_orderstatus", "o_orderdate", "lsn", "o_orderkey", F.lit(False), "F", "P", "O", media, "o_orderkey", "device")
    return out.select("o_custkey", "o_orderkey", "devices")


@query("work_log", sql="""
SELECT o_orderkey, strftime(MIN(l_shipdate), '%Y-%m-%d') AS started, CASE WHEN o_orderstatus = 'P' THEN 'stopped' END AS error,
  CASE WHEN MIN(l_shipdate) IS NULL THEN NULL WHEN o_orderstatus = 'P' THEN -1 ELSE (epoch(MAX(l_shipdate)) - epoch(MIN(l_shipdate)))::BIGINT END AS duration_seconds
FROM orders LEFT JOIN lineitem ON l_orderkey = o_orderkey GROUP BY o_orderkey, o_orderstatus
HAVING o_orderstatus <> 'P' OR MIN(l_shipdate) IS NOT NULL""")
def work_log(t: Tables):
    """Orders as queued work: begun with the first shipment, done with the last, failed where partial, or not started."""
    times = t.lineitem.groupBy("l_orderkey").agg(F.min("l_shipdate").alias("started"), F.max("l_shipdate").alias("finished"))
    outcomes = times.join(t.orders, F.col("l_orderkey") == F.col("o_orderkey")).select(
        "o_orderkey", "started", "finished", F.when(F.col("o_orderstatus") == "P", "stopped").alias("error"))
    queue = t.orders.select("o_orderkey", "o_orderstatus")
    out = mt.work_log(queue, outcomes, ["o_orderkey"], "started", "finished", "error")
    return out.where("o_orderstatus <> 'P' or started is not null").select(
        "o_orderkey", day_text("started", "started"), "error", F.col("duration_seconds").cast("bigint").alias("duration_seconds"))


@query("update_from", sql="""
SELECT d.doc_id, lang, COALESCE(l.quality, -1) AS quality, COALESCE(l.toxic, 0) AS toxic FROM documents d LEFT JOIN labels l ON l.doc_id = d.doc_id""")
def update_from(t: Tables):
    """Documents take over labels where there are any."""
    rows = t.documents.select("doc_id", "lang", F.lit(-1).alias("quality"), F.lit(0).alias("toxic"))
    return inc.update_from(rows, t.labels, "doc_id", {"quality": "quality", "toxic": "toxic"})


@query("delete_from", sql="""
SELECT o_orderkey, o_custkey FROM (SELECT *, ROW_NUMBER() OVER (PARTITION BY o_custkey ORDER BY o_orderdate DESC, o_orderkey DESC) AS r FROM orders) WHERE r > 1""")
def delete_from(t: Tables):
    """Orders without each customer's latest."""
    rows = t.orders.select("o_orderkey", "o_custkey", "o_orderdate")
    latest = rk.latest_per_group(rows, ["o_custkey"], "o_orderdate", ["o_orderkey"])
    return inc.delete_from(rows, latest, ["o_orderkey"]).select("o_orderkey", "o_custkey")
