"""Pivot, string, XML, JSON and text-layout queries."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from setwise.functions import measures as ms
from setwise.functions import texts as tx
from setwise.functions import xmlpath as xp
from setwise.operators import shaping as sh
from setwise.operators import textindex as ti
from setwise.plans.aggregation import revenue
from setwise.plans.registry import number, query
from setwise.session import scratch_path
from setwise.sources.tables import Tables


@query("dynamic_pivot", sql="""
SELECT c_nationkey, CAST(SUM(p) FILTER (o_orderstatus = 'F') AS DOUBLE) AS F, CAST(SUM(p) FILTER (o_orderstatus = 'O') AS DOUBLE) AS O,
  CAST(SUM(p) FILTER (o_orderstatus = 'P') AS DOUBLE) AS P
FROM (SELECT c_nationkey, o_orderstatus, CAST(o_totalprice AS DECIMAL(18,2)) AS p FROM orders JOIN customer ON o_custkey = c_custkey) GROUP BY 1""")
def dynamic_pivot(t: Tables):
    """Order value per customer nation, one column per status found in the data."""
    spent = t.orders.groupBy("o_custkey", "o_orderstatus").agg(F.sum(ms.money("o_totalprice")).alias("price"))
    rows = spent.join(t.customer, F.col("o_custkey") == F.col("c_custkey"))
    out = sh.dynamic_pivot(rows, "c_nationkey", "o_orderstatus", "price", "sum")
    return out.select("c_nationkey", *[number(c) for c in out.columns[1:]])


@query("dynamic_pivot_text", sql="""
SELECT user_id::VARCHAR AS user_id, MAX(k) FILTER (event_type = 'error')::VARCHAR AS error, MAX(k) FILTER (event_type = 'purchase')::VARCHAR AS purchase
FROM (SELECT user_id, event_type, CAST(json_extract_string(props, '$.k') AS INTEGER) AS k FROM events) GROUP BY 1
HAVING COUNT(*) FILTER (event_type IN ('error', 'purchase')) > 0""")
def dynamic_pivot_text(t: Tables):
    """The text form under a filter: largest k per user for two event types."""
    rows = t.events.select("user_id", "event_type", F.get_json_object("props", "$.k").cast("int").alias("k"))
    return sh.dynamic_pivot(
        rows, "user_id", "event_type", "k", where=F.col("event_type").isin("error", "purchase"), as_text=True)


@query("static_pivot", sql="""
SELECT strftime(ts, '%Y-%m-%d') AS day, MAX(value) FILTER (event_type = 'view') AS view, MAX(value) FILTER (event_type = 'click') AS click,
  MAX(value) FILTER (event_type = 'purchase') AS purchase FROM events GROUP BY 1""")
def static_pivot(t: Tables):
    rows = t.events.withColumn("day", F.date_format("ts", "yyyy-MM-dd"))
    return sh.static_pivot(rows, ["day"], "event_type", "value", ["view", "click", "purchase"])


@query("split_ordinal", sql=r"""
WITH w AS (SELECT unnest(string_split_regex(text, '\s+')) AS item, generate_subscripts(string_split_regex(text, '\s+'), 1) AS ordinal FROM documents)
SELECT item, COUNT(*) AS n, SUM(ordinal)::BIGINT AS ordinals FROM w WHERE item <> '' GROUP BY item""")
def split_ordinal(t: Tables):
    """Every word of every text with its position, counted."""
    words = sh.split_ordinal(t.documents.select("text"), "text", r"[\t\n\x0B\f\r ]+", keep_empty=False)
    return words.groupBy("item").agg(F.count(F.lit(1)).alias("n"), F.sum("ordinal").alias("ordinals"))


@query("zero_pad", sql="""
SELECT o_orderkey, lpad(o_orderkey::VARCHAR, 8, '0') AS wide,
  COALESCE(CASE WHEN length(o_orderkey::VARCHAR) <= 3 THEN lpad(o_orderkey::VARCHAR, 3, '0') END, 'too long') AS narrow FROM orders""")
def zero_pad(t: Tables):
    return t.orders.select(
        "o_orderkey", tx.zero_pad("o_orderkey", 8).alias("wide"),
        F.coalesce(tx.zero_pad("o_orderkey", 3), F.lit("too long")).alias("narrow"))


def parameter_xml(t: Tables) -> DataFrame:
    """Customers as XML parameter lists with a namespace and attributes."""
    node = lambda name, value, extra="": F.concat(
        F.lit(f"<p:ParameterValue{extra}><p:Name>{name}</p:Name><p:Value>"), xp.xml_escape(value), F.lit("</p:Value></p:ParameterValue>"))
    seq = F.concat(F.lit('<p:Item rank="'), F.col("c_nationkey").cast("string"), F.lit('"><p:Balance>'),
                   F.col("c_acctbal").cast("decimal(18,2)").cast("string"), F.lit("</p:Balance></p:Item>"))
    other = F.concat(F.lit('<p:Item rank="-1"><p:Note>no balance</p:Note></p:Item>'))
    body = F.concat(
        F.lit('<p:Doc xmlns:p="urn:example:parameters">'), node("TO", F.concat("c_name", F.lit(" & <co>"))),
        node("SEGMENT", F.col("c_mktsegment")), seq, other, F.lit("</p:Doc>"))
    return t.customer.select("c_custkey", body.alias("xml"))


@query("xml_nodes", sql="""
SELECT c_custkey, c_nationkey AS rank, CAST(CAST(c_acctbal AS DECIMAL(18,2)) AS DOUBLE) AS balance FROM customer
UNION ALL SELECT c_custkey, -1, -999999 FROM customer""")
def xml_nodes(t: Tables):
    """One row per Item node: attribute and element typed, absent elements NULL."""
    out = sh.xml_nodes(parameter_xml(t), "xml", "Item", {"_rank": "int", "Balance": "decimal(18,2)"}, keep=["c_custkey"])
    return out.select("c_custkey", "rank", F.coalesce(number("Balance"), F.lit(-999999.0)).alias("balance"))


@query("xml_nodes_deep", sql="""
SELECT o_orderkey, o_orderkey AS id, 'status <b xmlns="x">' || o_orderstatus || '</b> & more' AS body, NULL::DOUBLE AS price FROM orders
UNION ALL SELECT o_orderkey, -1, o_orderpriority, CAST(CAST(o_totalprice AS DECIMAL(18,2)) AS DOUBLE) FROM orders""")
def xml_nodes_deep(t: Tables):
    """Query nodes at two depths of a document with namespaces, one of them with CDATA that looks like markup."""
    xml = F.concat(
        F.lit('<r:Report xmlns:r="urn:example:report"><r:Sets><r:Set><r:Query r:id="'), F.col("o_orderkey").cast("string"),
        F.lit('"><r:Body><![CDATA[status <b xmlns="x">'), F.col("o_orderstatus"), F.lit('</b> & more]]></r:Body></r:Query></r:Set></r:Sets><Query id="-1"><Body>'),
        F.col("o_orderpriority"), F.lit("</Body><Price>"), F.col("o_totalprice").cast("decimal(18,2)").cast("string"), F.lit("</Price></Query></r:Report>"))
    # Parsing is the work here, and the few columns it starts from are cheap to deal out.
    orders = t.orders.select("o_orderkey", "o_orderstatus", "o_orderpriority", "o_totalprice").repartition(4 * t.spark.sparkContext.defaultParallelism)
    rows = orders.select("o_orderkey", xml.alias("xml"))
    out = sh.xml_nodes_anywhere(rows, "xml", "Query", {"_id": "bigint", "Body": "string", "Price": "decimal(18,2)"}, ["o_orderkey"])
    return out.select("o_orderkey", "id", F.col("Body").alias("body"), number("Price", "price"))


@query("xml_value", sql="SELECT c_custkey, c_name || ' & <co>' AS recipient, c_mktsegment AS segment FROM customer")
def xml_value(t: Tables):
    """Values picked by the name beside them."""
    return parameter_xml(t).select(
        "c_custkey", xp.value_by_sibling("xml", "ParameterValue", "TO").alias("recipient"),
        xp.value_by_sibling("xml", "ParameterValue", "SEGMENT").alias("segment"))


@query("nested_doc", sql="""
WITH c AS (SELECT o_custkey, o_orderstatus, o_orderpriority, COUNT(*) AS n FROM orders GROUP BY ALL),
g AS (SELECT o_custkey, o_orderstatus, string_agg('{"name":"' || o_orderpriority || '","count":' || n || '}', ',' ORDER BY o_orderpriority) AS items FROM c GROUP BY ALL)
SELECT o_custkey, '[' || string_agg('{"group":"' || o_orderstatus || '","items":[' || items || ']}', ',' ORDER BY o_orderstatus) || ']' AS doc FROM g GROUP BY 1""")
def nested_doc(t: Tables):
    """Per customer: statuses, in each the priorities with counts."""
    return sh.nested_counts(t.orders, "o_custkey", "o_orderstatus", "o_orderpriority")


@query("doc_append", sql="""
SELECT c_custkey, '{"key":' || c_custkey || ',"segment":"' || c_mktsegment || '"' || COALESCE(',"nation":"' || n_name || '"', '') || '}' AS doc
FROM customer LEFT JOIN (SELECT * FROM nation WHERE n_regionkey <> 0) ON n_nationkey = c_nationkey""")
def doc_append(t: Tables):
    """A nation name goes into the document only where one was found."""
    known = t.nation.where("n_regionkey <> 0")
    rows = t.customer.join(known, F.col("n_nationkey") == F.col("c_nationkey"), "left")
    doc = F.struct(F.col("c_custkey").alias("key"), F.col("c_mktsegment").alias("segment"))
    return rows.select("c_custkey", sh.append_fields(doc, {"nation": F.col("n_name")}).alias("doc"))


@query("kv_extract", sql=r"""
SELECT event_id, CAST(json_extract_string(props, '$.k') AS BIGINT) AS k FROM events""")
def kv_extract(t: Tables):
    """A value out of a JSON-like property text by name."""
    return t.events.select("event_id", tx.kv_value("props", "k", assign=r'"\s*:\s*"?', stop=',}" ').alias("k"))


@query("kv_extract_urls", sql=r"""
SELECT page_id, COALESCE(TRY_CAST(NULLIF(regexp_extract(url, '[^A-Za-z0-9_]page=([^,&;} ]*)', 1), '') AS BIGINT), -1) AS page,
  COALESCE(NULLIF(regexp_extract(url, '[^A-Za-z0-9_]ref=([^,&;} ]*)', 1), ''), '-') AS ref FROM pages""")
def kv_extract_urls(t: Tables):
    return t.pages.select(
        "page_id", F.coalesce(tx.kv_value("url", "page"), F.lit(-1)).alias("page"),
        F.coalesce(tx.kv_value("url", "ref", "string"), F.lit("-")).alias("ref"))


@query("text_slice", sql="""
WITH o AS (SELECT doc_id, text, doc_id % 120 - 10 AS a, CASE WHEN doc_id % 4 = 0 THEN -1 ELSE doc_id % 120 + 2 * (doc_id % 90) END AS b FROM documents),
f AS (SELECT *, CASE WHEN b = -1 THEN length(text) - 1 ELSE b // 2 END AS last FROM o)
SELECT doc_id, CASE WHEN a >= 0 AND a // 2 < length(text) AND last >= a // 2 AND last < length(text)
  THEN substr(text, a // 2 + 1, last - a // 2 + 1) ELSE text END AS slice FROM f""")
def text_slice(t: Tables):
    k = F.col("doc_id")
    rows = t.documents.select(
        "doc_id", "text", (k % 120 - 10).alias("a"), F.when(k % 4 == 0, F.lit(-1)).otherwise(k % 120 + 2 * (k % 90)).alias("b"))
    return rows.select("doc_id", tx.text_slice("text", "a", "b").alias("slice"))


@query("scrub_control", sql=r"""
SELECT doc_id, regexp_replace(chr(7) || text || chr(31) || chr(9), '[\x01-\x08\x0B\x0C\x0E-\x1F]', '?', 'g') AS clean FROM documents""")
def scrub_control(t: Tables):
    """Texts with control characters put in and taken out again."""
    dirty = F.concat(F.char(F.lit(7)), F.col("text"), F.char(F.lit(0)), F.char(F.lit(31)), F.char(F.lit(9)))
    return t.documents.select("doc_id", tx.scrub_control(dirty).alias("clean"))


@query("size_text", sql="""
WITH s AS (SELECT source, COUNT(*) AS n, SUM(n_chars)::BIGINT // 1024 AS kb FROM documents GROUP BY source)
SELECT source, kb, ROUND(kb / 1024, 4) AS mb, ROUND(1024.0 * kb / n, 5) AS bytes_per_doc FROM s""")
def size_text(t: Tables):
    """Sizes written as texts and read back, in other units."""
    per = t.documents.groupBy("source").agg(F.count(F.lit(1)).alias("n"), F.sum("n_chars").alias("chars"))
    written = per.select("source", "n", F.concat((F.col("chars") / 1024).cast("bigint").cast("string"), F.lit(" KB")).alias("size"))
    kb = tx.size_kb("size")
    return written.select(
        "source", kb.alias("kb"), F.round(kb / 1024, 4).alias("mb"),
        F.round(ms.safe_ratio(kb * 1024, "n"), 5).alias("bytes_per_doc"))


@query("code_labels", sql="""
SELECT CASE l_returnflag WHEN 'R' THEN 'Returned' WHEN 'A' THEN 'Accepted' ELSE 'other ' || l_returnflag END AS flag,
  CASE l_linestatus WHEN 'O' THEN 'Open' WHEN 'F' THEN 'Filled' ELSE l_linestatus END AS status, COUNT(*) AS n FROM lineitem GROUP BY ALL""")
def code_labels(t: Tables):
    counted = t.lineitem.groupBy("l_returnflag", "l_linestatus").agg(F.count(F.lit(1)).alias("n"))
    flag = ms.code_label("l_returnflag", {"R": "Returned", "A": "Accepted"}, F.concat(F.lit("other "), F.col("l_returnflag")))
    status = ms.code_label("l_linestatus", {"O": "Open", "F": "Filled"}, F.col("l_linestatus"))
    return counted.select(flag.alias("flag"), status.alias("status"), "n")


@query("flag_columns", sql="""
SELECT p_partkey, CASE WHEN p_size & 1 <> 0 THEN 'X' ELSE '' END AS sysadmin, CASE WHEN p_size & 4 <> 0 THEN 'X' ELSE '' END AS backup,
  CASE WHEN p_size & 32 <> 0 THEN 'X' ELSE '' END AS audit,
  array_to_string([x FOR x IN [CASE WHEN p_size & 1 <> 0 THEN 'a' END, CASE WHEN p_size & 2 <> 0 THEN 'b' END, CASE WHEN p_size & 4 <> 0 THEN 'c' END] IF x IS NOT NULL], ', ') AS names FROM part""")
def flag_columns(t: Tables):
    return t.part.select(
        "p_partkey", *[ms.flag_mark("p_size", b).alias(n) for n, b in (("sysadmin", 1), ("backup", 4), ("audit", 32))],
        ms.flag_names("p_size", "abc").alias("names"))


@query("select_like", sql="SELECT l_extendedprice, l_tax, l_orderkey, l_partkey, l_suppkey FROM lineitem")
def select_like(t: Tables):
    return sh.select_like(t.lineitem, "[l_%price%][l_tax][l_[o-s]%key]")


@query("order_like", sql="SELECT c_custkey, c_nationkey, c_mktsegment FROM customer")
def order_like(t: Tables):
    return sh.order_like(sh.select_like(t.customer, "[c_%key][c_mkt%]"), "[c_nation%] ASC, [c_cust%] DESC")


@query("filter_pair", sql="""
SELECT event_id, user_id, event_type FROM events WHERE user_id::VARCHAR LIKE '1%' AND NOT (event_type LIKE '%r%')""")
def filter_pair(t: Tables):
    fields = {"user": "user_id", "type": "event_type"}
    return sh.filter_pair(t.events, fields, "1%", "user", "%r%", "type").select("event_id", "user_id", "event_type")


@query("thousands", sql="""
WITH b AS (SELECT p_brand, SUM(CAST(l_extendedprice AS DECIMAL(18,2))) AS v, COUNT(*) AS n FROM lineitem JOIN part ON l_partkey = p_partkey GROUP BY 1),
f AS (SELECT p_brand, format('{:,}', CAST(floor(v) AS BIGINT)) || '.' || right(v::VARCHAR, 2) AS revenue, format('{:,}', n) AS lines FROM b)
SELECT p_brand, lpad(revenue, CAST(MAX(length(revenue)) OVER () AS INTEGER), ' ') AS revenue, lpad(lines, CAST(MAX(length(lines)) OVER () AS INTEGER), ' ') AS lines FROM f""")
def thousands(t: Tables):
    per_part = t.lineitem.groupBy("l_partkey").agg(F.sum(ms.money("l_extendedprice")).alias("v"), F.count(F.lit(1)).alias("n"))
    per = per_part.join(t.part, F.col("l_partkey") == F.col("p_partkey")).groupBy("p_brand").agg(
        F.sum("v").alias("revenue"), F.sum("n").alias("lines"))
    return sh.aligned_thousands(per, {"revenue": 2, "lines": 0})


@query("text_search", sql="""
SELECT 'page' AS kind, page_id AS id FROM pages WHERE contains(lower(html), 'href')
UNION ALL SELECT 'document', doc_id FROM documents WHERE contains(lower(text), 'license')""")
def text_search(t: Tables):
    """Whole texts searched for a snippet in any letter case; pages as binary."""
    binary = t.pages.select("page_id", F.encode("html", "UTF-8").alias("content"))
    pages = binary.where(tx.contains_text(tx.decode_utf8("content"), "HREF"))
    documents = t.documents.where(tx.contains_text("text", "License"))
    return pages.select(F.lit("page").alias("kind"), F.col("page_id").alias("id")).unionByName(
        documents.select(F.lit("document").alias("kind"), F.col("doc_id").alias("id")))


# What the indexed search looks for.
SNIPPETS = ["License", "the ", "All rights reserved", "example.com", "class=", "No text holds this", "Ä", "q7"]


@query("text_search_indexed", sql="WITH s(snippet) AS (VALUES " + ", ".join(f"('{s}')" for s in SNIPPETS) + """)
SELECT 'page' AS kind, snippet, page_id AS id FROM pages, s WHERE contains(lower(html), lower(snippet))
UNION ALL SELECT 'document', snippet, doc_id FROM documents, s WHERE contains(lower(text), lower(snippet))""")
def text_search_indexed(t: Tables):
    """Several snippets found by a stored trigram index of all texts; pages as binary."""
    pages = t.pages.select("page_id", F.encode("html", "UTF-8").alias("content"))
    out = []
    for kind, texts, key, text in (("page", pages, "page_id", tx.decode_utf8("content")), ("document", t.documents, "doc_id", F.col("text"))):
        index = scratch_path(t.spark, "text-index")
        ti.build_index(texts, key, text, index)
        out.append(ti.search(texts, key, text, index, SNIPPETS).select(F.lit(kind).alias("kind"), "snippet", F.col("key").alias("id")))
    return out[0].unionByName(out[1])


_GRID = """WITH g AS (SELECT h, w FROM range(24) a(h), range(1, 8) b(w)),
e AS (SELECT hour(ts) AS h, dayofweek(ts) + 1 AS w, COUNT(*) AS n FROM events GROUP BY ALL)
"""


@query("char_ramp_grid", sql=_GRID + """
SELECT w, string_agg(substr(' .:-=+*#%@', CAST(COALESCE(n, 0) * 9 // (SELECT MAX(n) FROM e) + 1 AS INTEGER), 1), '' ORDER BY h) AS line
FROM g LEFT JOIN e USING (h, w) GROUP BY w""")
def char_ramp_grid(t: Tables):
    """Event density by hour (across) and weekday (down)."""
    cells = t.events.select(F.hour("ts").alias("h"), F.dayofweek("ts").alias("w"))
    return sh.char_ramp_grid(cells, ("h", 0, 23), ("w", 1, 7))


@query("cross_grid", sql=_GRID + "SELECT h, w, COALESCE(n, 0) AS n FROM g LEFT JOIN e USING (h, w)")
def cross_grid(t: Tables):
    """Every cell of the two axes with its count, empty ones included."""
    counted = t.events.groupBy(F.hour("ts").alias("h"), F.dayofweek("ts").alias("w")).agg(F.count(F.lit(1)).alias("n"))
    grid = sh.grid_axes(t.events, ("h", 0, 23), ("w", 1, 7))
    return grid.join(counted, ["h", "w"], "left").withColumn("n", F.coalesce("n", F.lit(0)))


@query("path_split", sql=r"""
SELECT page_id, regexp_extract(url, '^[A-Za-z][A-Za-z0-9+.-]*://([^/?#]*)', 1) AS host, regexp_extract(url, '^[A-Za-z][A-Za-z0-9+.-]*://[^/?#]*([^?#]*)', 1) AS path,
  CASE WHEN contains(url, '/') THEN substr(url, 1, length(url) - length(split_part(url, '/', -1)) - 1) ELSE '' END AS directory,
  split_part(url, '/', -1) AS file, split_part(regexp_extract(url, '^[A-Za-z][A-Za-z0-9+.-]*://([^/?#]*)', 1), '.', -1) AS top_name FROM pages""")
def path_split(t: Tables):
    return t.pages.select(
        "page_id", tx.url_host("url").alias("host"), tx.url_path("url").alias("path"),
        tx.path_directory("url").alias("directory"), tx.path_file("url").alias("file"),
        tx.name_part(tx.url_host("url"), 1).alias("top_name"))


@query("guid_bytes", sql="""
WITH h AS (SELECT o_orderkey, o_custkey, lpad(hex(o_orderkey), 16, '0') AS x FROM orders)
SELECT o_orderkey, o_custkey, substr(x, 15, 2) || substr(x, 13, 2) || substr(x, 11, 2) || substr(x, 9, 2) || substr(x, 7, 2)
  || substr(x, 5, 2) || substr(x, 3, 2) || substr(x, 1, 2) AS swapped FROM h""")
def guid_bytes(t: Tables):
    """Byte-swapped hex keys as the join key between two tables that write them differently."""
    code = F.lpad(F.hex("o_orderkey"), 16, "0")  # a 64-bit key never has more digits
    plain = t.orders.select("o_custkey", tx.swap_bytes(code).alias("swapped"))
    swapped = t.orders.select("o_orderkey", tx.swap_bytes(code).alias("swapped"))
    return swapped.join(plain, "swapped").select("o_orderkey", "o_custkey", "swapped")


@query("quoted_names", sql="""
SELECT n_nationkey, '[' || replace(n_name || ']x', ']', ']]') || ']' AS quoted, length(rtrim(n_name || '   ')) AS len FROM nation""")
def quoted_names(t: Tables):
    return t.nation.select(
        "n_nationkey", tx.quote_name(F.concat("n_name", F.lit("]x"))).alias("quoted"),
        tx.length_trimmed(F.concat("n_name", F.lit("   "))).alias("len"))
