"""Calendar, slot, schedule and elapsed-time queries."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from setwise.functions import schedules as sc
from setwise.functions import times as tm
from setwise.functions.measures import money
from setwise.operators import calendar as cal
from setwise.operators.shaping import aligned_elapsed
from setwise.plans.registry import day_text, number, query, time_text
from setwise.sources.tables import Tables

_SPINE = """WITH b AS (SELECT MIN(o_orderdate)::DATE AS lo, MAX(o_orderdate)::DATE AS hi FROM orders),
s AS (SELECT unnest(generate_series(lo, hi, INTERVAL 1 DAY))::DATE AS d FROM b)"""


def daily_orders(t: Tables) -> DataFrame:
    return t.orders.groupBy(F.col("o_orderdate").cast("date").alias("calendar_date")).agg(
        F.count(F.lit(1)).alias("n_orders"), F.sum(money("o_totalprice")).alias("price"))


@query("date_spine", sql=_SPINE + """
SELECT strftime(d, '%Y-%m-%d') AS day, COUNT(o_orderkey) AS n_orders FROM s LEFT JOIN orders ON o_orderdate::DATE = d GROUP BY d""")
def date_spine(t: Tables):
    """Orders per day with the empty days filled in."""
    filled = cal.fill_gaps(cal.spine_over(t.orders, "o_orderdate"), daily_orders(t), "calendar_date", {"n_orders": 0})
    return filled.select(day_text("calendar_date", "day"), "n_orders")


_CALENDAR_DATES = ("calendar_date", "first_day_in_week", "last_day_in_week", "first_day_in_month", "last_day_in_month",
                   "first_day_in_quarter", "last_day_in_quarter")


@query("calendar_table", sql=_SPINE + """,
c AS (SELECT d, year(d) AS y, month(d) AS m, day(d) AS dd, quarter(d) AS q, dayofweek(d) + 1 AS dow, dayofyear(d) AS doy,
  date_trunc('month', d)::DATE AS fm, last_day(d) AS lm, (dayofyear(d) + dayofweek(date_trunc('year', d)) - 1) // 7 + 1 AS wk,
  CASE WHEN dayofweek(d) IN (0, 6) THEN 0 ELSE 1 END AS wd, dayofyear(make_date(year(d), 12, 31)) - 365 AS leap FROM s),
k AS (SELECT *, MIN(d) OVER pq AS fq, MAX(d) OVER pq AS lq, wk - MIN(wk) OVER pq + 1 AS wq, SUM(wd) OVER pm AS wim, SUM(wd) OVER pq AS wiq,
  SUM(wd) OVER (PARTITION BY y, m ORDER BY d) AS mwc, SUM(wd) OVER (PARTITION BY y, q ORDER BY d) AS qwc,
  ROW_NUMBER() OVER (PARTITION BY y, m, dow ORDER BY d) AS im, ROW_NUMBER() OVER (PARTITION BY y, q, dow ORDER BY d) AS iq,
  ROW_NUMBER() OVER (PARTITION BY y, dow ORDER BY d) AS iy
  FROM c WINDOW pm AS (PARTITION BY y, m), pq AS (PARTITION BY y, q)),
o AS (SELECT o_orderdate::DATE AS od, COUNT(*) AS n FROM orders GROUP BY 1)
SELECT strftime(d, '%Y-%m-%d') AS calendar_date, y AS calendar_year, m AS calendar_month, dd AS calendar_day, q AS calendar_quarter,
  strftime(d - (dow - 1)::INTEGER, '%Y-%m-%d') AS first_day_in_week, strftime(d + (7 - dow)::INTEGER, '%Y-%m-%d') AS last_day_in_week,
  CASE WHEN month(d - (dow - 1)::INTEGER) = month(d + (7 - dow)::INTEGER) THEN 1 ELSE 0 END AS is_week_in_same_month,
  strftime(fm, '%Y-%m-%d') AS first_day_in_month, strftime(lm, '%Y-%m-%d') AS last_day_in_month, (d = lm)::INTEGER AS is_last_day_in_month,
  strftime(fq, '%Y-%m-%d') AS first_day_in_quarter, strftime(lq, '%Y-%m-%d') AS last_day_in_quarter, (d = lq)::INTEGER AS is_last_day_in_quarter,
  dow AS day_of_week, (dd + dayofweek(fm) - 1) // 7 + 1 AS week_of_month, wq AS week_of_quarter, wk AS week_of_year, day(lm) AS days_in_month,
  day(lm) - dd AS month_days_remaining, wim AS weekdays_in_month, wim - mwc AS month_weekdays_remaining, mwc AS month_weekdays_completed,
  lq - fq + 1 AS days_in_quarter, lq - d AS quarter_days_remaining, d - fq + 1 AS quarter_days_completed, wiq AS weekdays_in_quarter,
  wiq - qwc AS quarter_weekdays_remaining, qwc AS quarter_weekdays_completed, doy AS day_of_year, 365 + leap - doy AS year_days_remaining,
  wd AS is_weekday, leap AS is_leap_year, (m = 1 AND dd = 1)::INTEGER AS is_holiday, dayname(d) AS day_name, im AS month_day_name_instance,
  iq AS quarter_day_name_instance, iy AS year_day_name_instance, monthname(d) AS month_name, y || lpad(wk::VARCHAR, 2, '0') AS year_week,
  y || lpad(m::VARCHAR, 2, '0') AS year_month, y || 'Q' || q AS year_quarter, COALESCE(n, 0) AS n_orders FROM k LEFT JOIN o ON od = d""")
def calendar_table(t: Tables):
    """The date dimension over the order dates, New Year's Day as holiday, with orders per day."""
    spine = cal.spine_over(t.orders, "o_orderdate")
    new_year = spine.where((F.month("calendar_date") == 1) & (F.dayofmonth("calendar_date") == 1))
    days = cal.calendar_columns(spine, new_year)
    out = cal.fill_gaps(days, daily_orders(t).drop("price"), "calendar_date", {"n_orders": 0})
    return out.withColumns({c: F.date_format(c, "yyyy-MM-dd") for c in _CALENDAR_DATES})


@query("calendar_weekday_revenue", sql="""
WITH o AS (SELECT o_orderdate::DATE AS d, SUM(CAST(o_totalprice AS DECIMAL(18,2))) AS p, COUNT(*) AS n FROM orders GROUP BY 1)
SELECT dayname(d) AS day_name, (day(d) - 1) // 7 + 1 AS instance, SUM(n)::BIGINT AS n_orders, CAST(SUM(p) AS DOUBLE) AS price FROM o GROUP BY ALL""")
def calendar_weekday_revenue(t: Tables):
    """Revenue per weekday instance of a month (first Monday, second Monday, ...)."""
    days = cal.calendar_columns(cal.spine_over(t.orders, "o_orderdate")).select(
        "calendar_date", "day_name", F.col("month_day_name_instance").alias("instance"))
    return days.join(daily_orders(t), "calendar_date").groupBy("day_name", "instance").agg(
        F.sum("n_orders").alias("n_orders"), number(F.sum("price"), "price"))


@query("time_slots", sql="""
WITH b AS (SELECT date_trunc('day', MIN(ts)) AS lo, date_trunc('day', MAX(ts)) + INTERVAL 1 DAY AS hi FROM events),
s AS (SELECT unnest(generate_series(lo, hi, INTERVAL 15 MINUTE)) AS st FROM b),
r AS (SELECT st, ROW_NUMBER() OVER (ORDER BY st) AS slot_id FROM s),
e AS (SELECT time_bucket(INTERVAL 15 MINUTE, ts) AS b, COUNT(*) AS n FROM events GROUP BY 1)
SELECT slot_id, strftime(st, '%Y-%m-%d %H:%M') AS slot_time, dayofweek(st) + 1 AS week_day, COALESCE(n, 0) AS n FROM r LEFT JOIN e ON b = st""")
def time_slots(t: Tables):
    """Events per quarter of an hour, empty slots included."""
    width = 15 * 60_000_000
    binned = t.events.groupBy(tm.slot_of("ts", width).alias("__slot")).agg(F.count(F.lit(1)).alias("n"))
    slots = cal.slots_over(t.events, "ts").withColumn("__slot", tm.slot_of("slot_time", width))
    return cal.fill_gaps(slots, binned, "__slot", {"n": 0}).select(
        "slot_id", F.date_format("slot_time", "yyyy-MM-dd HH:mm").alias("slot_time"), "week_day", "n")


@query("utc_to_local", sql="""
WITH l AS (SELECT event_id, ts - INTERVAL 6 HOUR AS lt FROM events),
y AS (SELECT *, make_date(year(lt), 3, 8) AS a, make_date(year(lt), 11, 1) AS z FROM l),
f AS (SELECT *, (a + ((7 - dayofweek(a)) % 7)::INTEGER)::TIMESTAMP + INTERVAL 2 HOUR AS s, (z + ((7 - dayofweek(z)) % 7)::INTEGER)::TIMESTAMP + INTERVAL 2 HOUR AS e FROM y)
SELECT event_id, strftime(CASE WHEN lt BETWEEN s AND e THEN lt + INTERVAL 1 HOUR ELSE lt END, '%Y-%m-%d %H:%M:%S.%f') AS local_time FROM f""")
def utc_to_local(t: Tables):
    return t.events.select("event_id", time_text(tm.utc_to_local("ts"), "local_time"))


@query("utc_to_local_tzdb", sql="""
WITH u AS (SELECT o_orderkey, o_orderdate + to_minutes(CAST(o_orderkey % 1440 AS BIGINT)) AS utc FROM orders),
y AS (SELECT *, make_date(year(utc), 4, 1) AS a, make_date(year(utc), 10, 25) AS z FROM u),
f AS (SELECT *, (a + ((7 - dayofweek(a)) % 7)::INTEGER)::TIMESTAMP + INTERVAL 8 HOUR AS s, (z + ((7 - dayofweek(z)) % 7)::INTEGER)::TIMESTAMP + INTERVAL 7 HOUR AS e FROM y)
SELECT o_orderkey, strftime(utc - CASE WHEN utc >= s AND utc < e THEN INTERVAL 5 HOUR ELSE INTERVAL 6 HOUR END, '%Y-%m-%d %H:%M:%S.%f') AS local_time FROM f""")
def utc_to_local_tzdb(t: Tables):
    """Order moments by the time zone database, in years in which summer began on the first Sunday of April and ended on October's last."""
    moment = (F.col("o_orderdate") + F.make_dt_interval(mins=(F.col("o_orderkey") % 1440).cast("int"))).cast("timestamp_ntz")
    return t.orders.select("o_orderkey", time_text(tm.utc_to_local(moment, mode="tzdb"), "local_time"))


@query("utc_to_local_orders", sql="""
WITH l AS (SELECT o_orderkey, o_orderdate + to_minutes(CAST(o_orderkey % 1440 AS BIGINT)) - INTERVAL 6 HOUR AS lt FROM orders),
y AS (SELECT *, make_date(year(lt), 4, 1) AS a, make_date(year(lt), 10, 25) AS z FROM l),
f AS (SELECT *, (a + ((7 - dayofweek(a)) % 7)::INTEGER)::TIMESTAMP + INTERVAL 2 HOUR AS s, (z + ((7 - dayofweek(z)) % 7)::INTEGER)::TIMESTAMP + INTERVAL 2 HOUR AS e FROM y)
SELECT month(lt) AS m, hour(CASE WHEN lt BETWEEN s AND e THEN lt + INTERVAL 1 HOUR ELSE lt END) AS h, COUNT(*) AS n FROM f GROUP BY ALL""")
def utc_to_local_orders(t: Tables):
    """Local hour histogram under the older daylight-saving rule."""
    moment = F.col("o_orderdate") + F.make_dt_interval(mins=(F.col("o_orderkey") % 1440).cast("int"))
    rows = t.orders.select(moment.alias("utc"), tm.utc_to_local(moment).alias("local"))
    month = F.month(F.col("utc") - F.make_dt_interval(hours=F.lit(6))).alias("m")
    return rows.groupBy(month, F.hour("local").alias("h")).agg(F.count(F.lit(1)).alias("n"))


@query("to_offset_time", sql="""
SELECT event_id, strftime(ts, '%Y-%m-%d %H:%M:%S') || ' -06:00' AS local_text,
  strftime(ts + INTERVAL 360 MINUTE, '%Y-%m-%d %H:%M:%S.%f') AS instant FROM events""")
def to_offset_time(t: Tables):
    rows = t.events.select("event_id", tm.to_offset_time("ts", -360).alias("o"))
    return rows.select("event_id", tm.offset_time_text(F.col("o")).alias("local_text"), time_text("o.instant", "instant"))


@query("packed_datetime", sql="""
SELECT event_id, strftime(ts, '%Y-%m-%d %H:%M:%S') AS decoded, hour(ts) * 3600 + minute(ts) * 60 + second(ts) AS seconds,
  strftime(ts, '%H:%M:%S') AS clock, strftime(ts + INTERVAL 5 HOUR, '%Y-%m-%d %H:%M:%S') AS shifted FROM events""")
def packed_datetime(t: Tables):
    """Times packed to YYYYMMDD and HHMMSS integers and decoded again."""
    d = (F.year("ts") * 10000 + F.month("ts") * 100 + F.dayofmonth("ts")).alias("d")
    c = (F.hour("ts") * 10000 + F.minute("ts") * 100 + F.second("ts")).alias("c")
    packed = t.events.select("event_id", d, c)
    decoded = tm.packed_to_timestamp("d", "c")
    form = "yyyy-MM-dd HH:mm:ss"
    return packed.select(
        "event_id", F.date_format(decoded, form).alias("decoded"), tm.packed_seconds("c").alias("seconds"),
        tm.packed_clock("c").alias("clock"),
        F.date_format(decoded + F.make_dt_interval(hours=F.lit(5)), form).alias("shifted"))


_MASK_LIST = lambda mask, names, sep: "array_to_string([x FOR x IN [" + ", ".join(
    f"CASE WHEN ({mask}) & {1 << i} <> 0 THEN '{n}' END" for i, n in enumerate(names)) + f"] IF x IS NOT NULL], '{sep}')"
_DAY_LIST = "array_to_string(list_transform(list_filter(range(1, 32), lambda d: (dm >> (d - 1)) & 1 = 1), lambda d: d::VARCHAR), ',')"
_SCHEDULE_SQL = f"""
WITH s AS (SELECT o_orderkey AS id, o_orderkey % 7 + 1 AS kind, o_orderdate + to_minutes(CAST(o_orderkey * 37 % 1440 AS BIGINT)) AS st,
  CASE WHEN o_orderkey % 3 = 0 THEN o_orderdate + INTERVAL 30 DAY END AS en, o_orderkey % 300 + 1 AS mi, o_orderkey % 5 + 1 AS dy,
  o_orderkey % 3 + 1 AS wk, o_custkey % 128 AS dw, (o_orderkey * 7919 + 1) % 2147483647 AS dm,
  CASE WHEN o_orderkey % 4 = 0 THEN 4095 ELSE o_custkey % 4096 END AS mo, o_orderkey % 5 + 1 AS mw FROM orders),
p AS (SELECT *, 'At ' || ((hour(st) + 11) % 12 + 1) || ':' || strftime(st, '%M') || CASE WHEN hour(st) >= 12 THEN ' PM' ELSE ' AM' END AS atx,
  strftime(st, '%m/%d/%Y') AS sd, COALESCE(' and ending ' || strftime(en, '%m/%d/%Y'), '') AS ex,
  strftime(st, '%H:%M') || CASE WHEN hour(st) >= 12 THEN ' PM' ELSE ' AM' END AS c24,
  {_MASK_LIST('dw', sc.WEEKDAYS, ', ')} AS dws, {_DAY_LIST} AS dms,
  CASE WHEN mo = 4095 THEN 'every month' ELSE {_MASK_LIST('mo', sc.MONTHS, ', ')} END || ', ' AS mos,
  CASE mw WHEN 1 THEN 'first' WHEN 2 THEN 'second' WHEN 3 THEN 'third' WHEN 4 THEN 'fourth' ELSE 'last' END AS mws FROM s)
SELECT id, CASE kind WHEN 1 THEN atx || ' on ' || sd
  WHEN 2 THEN 'Every ' || (mi // 60) || ' hour(s) and ' || (mi % 60) || ' minute(s), starting ' || sd || ' at ' || c24 || ex
  WHEN 3 THEN atx || ' every ' || CASE WHEN dy = 1 THEN 'day, ' ELSE dy || ' days, ' END || 'starting ' || sd || ex
  WHEN 4 THEN atx || ' every ' || dws || ' of every ' || CASE WHEN wk = 1 THEN 'week,' ELSE wk || ' weeks,' END || ' starting ' || sd || ex
  WHEN 5 THEN atx || ' on day(s) ' || dms || ' of ' || mos || 'starting ' || sd || ex
  WHEN 6 THEN atx || ' on the ' || mws || ' ' || dws || ' of ' || mos || 'starting ' || sd || ex
  ELSE 'At ' || c24 || ' starting ' || sd || ex END AS sentence FROM p"""


@query("schedule_text", sql=_SCHEDULE_SQL)
def schedule_text(t: Tables):
    """Recurrence rules made from order keys, as sentences."""
    k, c = F.col("o_orderkey"), F.col("o_custkey")
    rows = t.orders.select(
        k.alias("id"), (k % 7 + 1).alias("kind"),
        (F.col("o_orderdate") + F.make_dt_interval(mins=(k * 37 % 1440).cast("int"))).alias("starts"),
        F.when(k % 3 == 0, F.col("o_orderdate") + F.make_dt_interval(days=F.lit(30))).alias("ends"),
        (k % 300 + 1).alias("minutes"), (k % 5 + 1).alias("days"), (k % 3 + 1).alias("weeks"), (c % 128).alias("weekday_mask"),
        ((k * 7919 + 1) % 2147483647).alias("day_mask"),
        F.when(k % 4 == 0, F.lit(sc.ALL_MONTHS).cast("bigint")).otherwise(c % 4096).alias("month_mask"),
        (k % 5 + 1).alias("month_week"))
    text = sc.schedule_text(
        "kind", "starts", "ends", "minutes", "days", "weeks", "weekday_mask", "day_mask", "month_mask", "month_week")
    return rows.select("id", text.alias("sentence"))


@query("job_schedule_text", sql=f"""
WITH s AS (SELECT o_orderkey AS id, CAST(power(2, [0, 2, 3, 4, 5, 6][CAST(o_orderkey % 6 AS INTEGER) + 1]) AS BIGINT) AS ft, o_orderkey % 10 + 1 AS fi,
  CAST(power(2, o_orderkey % 5) AS BIGINT) AS fr, o_orderkey % 4 + 1 AS ff, CAST(power(2, o_custkey % 4) AS BIGINT) AS sub, o_custkey % 50 + 1 AS ev,
  CAST(strftime(o_orderdate + to_minutes(CAST(o_orderkey % 1440 AS BIGINT)), '%H%M%S') AS INTEGER) AS tt FROM orders),
x AS (SELECT *, strptime(lpad(tt::VARCHAR, 6, '0'), '%H%M%S') AS clock FROM s)
SELECT id, CASE ft WHEN 1 THEN 'Once' WHEN 4 THEN 'Every ' || fi || ' day(s)'
  WHEN 8 THEN 'Every ' || ff || ' week(s) on ' || {_MASK_LIST('fi', sc.WEEKDAYS, ', ')}
  WHEN 16 THEN 'Day ' || fi || ' of every ' || ff || ' month(s)'
  WHEN 32 THEN 'The ' || CASE fr WHEN 1 THEN 'First' WHEN 2 THEN 'Second' WHEN 4 THEN 'Third' WHEN 8 THEN 'Fourth' ELSE 'Last' END || ' ' ||
    ['Sunday', 'Monday', 'Tuesday', 'Wednesday', 'Thursday', 'Friday', 'Saturday', 'Day', 'Weekday', 'Weekend Day'][fi] || ' of every ' || ff || ' month(s)'
  ELSE 'At service start' END AS occurs,
  CASE WHEN sub = 1 THEN 'Occurs once at ' || strftime(clock, '%H:%M:%S') ELSE 'Occurs every ' || ev || ' ' ||
    CASE sub WHEN 2 THEN 'Second(s)' WHEN 4 THEN 'Minute(s)' ELSE 'Hour(s)' END || ' starting at ' || strftime(clock, '%H:%M:%S') || ' ending at 23:59:59' END AS frequency
FROM x""")
def job_schedule_text(t: Tables):
    """Job schedules made from order keys, as text."""
    k, c = F.col("o_orderkey"), F.col("o_custkey")
    moment = F.col("o_orderdate") + F.make_dt_interval(mins=(k % 1440).cast("int"))
    bit = lambda n: F.call_function("shiftleft", F.lit(1).cast("bigint"), n.cast("int"))
    kinds = F.array(*[F.lit(v).cast("bigint") for v in (1, 4, 8, 16, 32, 64)])
    rows = t.orders.select(
        k.alias("id"), F.element_at(kinds, (k % 6 + 1).cast("int")).alias("ft"), (k % 10 + 1).alias("fi"),
        bit(k % 5).alias("fr"), (k % 4 + 1).alias("ff"), bit(c % 4).alias("sub"), (c % 50 + 1).alias("ev"),
        (F.hour(moment) * 10000 + F.minute(moment) * 100 + F.second(moment)).alias("starts"), F.lit(235959).alias("ends"))
    return rows.select(
        "id", sc.job_occurrence("ft", "fi", "fr", "ff").alias("occurs"),
        sc.job_frequency("sub", "ev", "starts", "ends").alias("frequency"))


_LAST = """WITH u AS (SELECT user_id, MAX(ts) AS last FROM events GROUP BY user_id),
m AS (SELECT user_id, last, (epoch_us(TIMESTAMP '2024-02-15') - epoch_us(last)) // 1000 AS ms FROM u),
p AS (SELECT *, ms // 86400000 AS dd, greatest(2, MAX(length((ms // 86400000)::VARCHAR)) OVER ()) AS w FROM m)
"""


@query("elapsed_text", sql=_LAST + """
SELECT user_id, lpad(dd::VARCHAR, CAST(w AS INTEGER), '0') || ' ' || lpad((ms // 3600000 % 24)::VARCHAR, 2, '0') || ':' || lpad((ms // 60000 % 60)::VARCHAR, 2, '0')
  || ':' || lpad((ms // 1000 % 60)::VARCHAR, 2, '0') || '.' || lpad((ms % 1000)::VARCHAR, 3, '0') AS elapsed,
  (ms // 3600000) || 'hrs' || (ms % 3600000 // 60000) || 'min' || (ms % 60000 // 1000) || 'sec' AS words,
  (date_diff('minute', last, TIMESTAMP '2024-02-15') // 60) || ' hours & ' || (date_diff('minute', last, TIMESTAMP '2024-02-15') % 60) || ' minutes' AS uptime
FROM p""")
def elapsed_text(t: Tables):
    """Time since each user's last event, in three layouts."""
    as_of = F.lit("2024-02-15").cast("timestamp_ntz")
    last = t.events.groupBy("user_id").agg(F.max("ts").alias("last"))
    ms = tm.int_div(tm.micros(as_of) - tm.micros("last"), 1000)
    out = aligned_elapsed(last.withColumn("ms", ms), "ms")
    return out.select("user_id", "elapsed", tm.elapsed_words("ms").alias("words"), tm.uptime_words("last", as_of).alias("uptime"))


@query("calendar_parts", sql="""
SELECT event_id, year(ts) AS year, month(ts) AS month, monthname(ts) AS month_name, dayname(ts) AS weekday_name,
  dayofweek(ts) + 1 AS weekday FROM events""")
def calendar_parts(t: Tables):
    return t.events.select("event_id", *[c.alias(n) for n, c in tm.calendar_parts("ts").items()])


@query("age_days", sql="""
SELECT c_custkey, COALESCE(date_diff('day', MAX(o_orderdate), TIMESTAMP '2002-01-01'), -1) AS days
FROM customer LEFT JOIN orders ON o_custkey = c_custkey GROUP BY c_custkey""")
def age_days(t: Tables):
    """Days since each customer's last order."""
    last = t.orders.groupBy("o_custkey").agg(F.max("o_orderdate").alias("last"))
    rows = t.customer.select("c_custkey").join(last, F.col("c_custkey") == F.col("o_custkey"), "left")
    days = tm.age_days(F.lit("2002-01-01").cast("date"), "last")
    return rows.select("c_custkey", F.coalesce(days, F.lit(-1)).alias("days"))


@query("boundary_counts", sql="""
SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey, l_quantity, date_diff('day', o_orderdate, l_shipdate) AS days, date_diff('month', o_orderdate, l_shipdate) AS months,
  date_diff('quarter', o_orderdate, l_shipdate) AS quarters, date_diff('year', o_orderdate, l_shipdate) AS years,
  ((l_shipdate::DATE - dayofweek(l_shipdate)::INTEGER) - (o_orderdate::DATE - dayofweek(o_orderdate)::INTEGER)) // 7 AS weeks
FROM lineitem JOIN orders ON o_orderkey = l_orderkey""")
def boundary_counts(t: Tables):
    """Calendar boundaries between order and shipping, which may come first."""
    rows = t.lineitem.select("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "l_quantity", "l_shipdate").join(
        t.orders.select("o_orderkey", "o_orderdate"), F.col("l_orderkey") == F.col("o_orderkey"))
    return rows.select("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "l_quantity", *[
        tm.boundaries(u, "o_orderdate", "l_shipdate").alias(f"{u}s") for u in ("day", "week", "month", "quarter", "year")])
