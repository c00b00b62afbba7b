"""Column helpers on literal values."""

from datetime import date, datetime
from decimal import Decimal

import pytest
from pyspark.sql import functions as F

from setwise.functions import measures as ms
from setwise.functions import schedules as sc
from setwise.functions import texts as tx
from setwise.functions import times as tm
from setwise.functions import xmlpath as xp


@pytest.fixture
def value(spark):
    return lambda c: spark.range(1).select(c).first()[0]


def ts(text):
    return F.lit(text).cast("timestamp_ntz")


@pytest.mark.parametrize("day, week", [("2024-01-07", 2), ("2000-12-31", 54), ("2024-01-06", 1), ("2023-12-31", 53)])
def test_week_us(value, day, week):
    assert value(tm.week_us(F.lit(day))) == week


@pytest.mark.parametrize("unit, a, b, n", [
    ("day", "2024-01-01 23:59:00", "2024-01-02 00:01:00", 1), ("week", "2024-01-06 12:00:00", "2024-01-07 12:00:00", 1),
    ("month", "2024-01-31 00:00:00", "2024-02-01 00:00:00", 1), ("quarter", "2023-12-31 00:00:00", "2024-01-01 00:00:00", 1),
    ("year", "2023-12-31 00:00:00", "2024-01-01 00:00:00", 1), ("hour", "2024-01-01 00:59:59", "2024-01-01 01:00:00", 1),
    ("minute", "2024-01-01 00:00:59", "2024-01-01 00:01:00", 1), ("second", "1969-12-31 23:59:59.5", "1970-01-01 00:00:00", 1),
    ("day", "2024-01-02 00:00:00", "2024-01-01 00:00:00", -1),
])
def test_boundaries(value, unit, a, b, n):
    assert value(tm.boundaries(unit, ts(a), ts(b))) == n


def test_packed(value):
    assert value(tm.packed_to_timestamp(F.lit(20150307), F.lit(150200))) == datetime(2015, 3, 7, 15, 2)
    assert value(tm.packed_to_timestamp(F.lit(0), F.lit(0))) is None
    assert value(tm.packed_seconds(F.lit(13005))) == 5405
    assert value(tm.packed_clock(F.lit(13005))) == "01:30:05"
    assert value(sc.packed_time_text(F.lit(5))) == "00:00:05"


@pytest.mark.parametrize("utc, local", [
    ("2024-03-10 07:59:59", "2024-03-10 01:59:59"), ("2024-03-10 08:00:00", "2024-03-10 03:00:00"),
    ("2024-11-03 08:00:00", "2024-11-03 03:00:00"), ("2024-11-03 08:00:01", "2024-11-03 02:00:01"),
    ("2006-04-02 07:59:59", "2006-04-02 01:59:59"), ("2006-04-02 08:00:00", "2006-04-02 03:00:00"),
    ("2006-10-29 08:00:01", "2006-10-29 02:00:01"), ("2006-03-20 12:00:00", "2006-03-20 06:00:00"),
])
def test_utc_to_local_rule(value, utc, local):
    assert str(value(tm.utc_to_local(ts(utc)))) == local


def test_utc_to_local_tzdb(value):
    assert str(value(tm.utc_to_local(ts("2024-11-03 07:30:00"), mode="tzdb"))) == "2024-11-03 01:30:00"
    with pytest.raises(ValueError):
        tm.utc_to_local(ts("2024-11-03 07:30:00"), mode="other")


def test_offset_time(value):
    offset = tm.to_offset_time(ts("2024-01-01 00:00:00"), -360)
    assert value(offset["instant"]) == datetime(2024, 1, 1, 6)
    assert value(tm.offset_time_text(offset)) == "2024-01-01 00:00:00 -06:00"
    assert value(tm.offset_time_text(tm.to_offset_time(ts("2024-01-01 12:00:00"), 330))) == "2024-01-01 12:00:00 +05:30"


def test_elapsed(value):
    ms_ = ((3 * 24 + 4) * 3600 + 5 * 60 + 6) * 1000 + 7
    assert value(tm.elapsed_parts_text(F.lit(ms_))) == "03 04:05:06.007"
    assert value(tm.elapsed_parts_text(F.lit(ms_), 4)) == "0003 04:05:06.007"
    assert value(tm.elapsed_words(F.lit(3_725_999))) == "1hrs2min5sec"
    assert value(tm.uptime_words(ts("2024-01-01 00:00:30"), ts("2024-01-01 02:05:00"))) == "2 hours & 5 minutes"
    # More milliseconds than 24 days hold in 32 bits.
    assert value(tm.elapsed_parts_text(F.lit(40 * 86_400_000))) == "40 00:00:00.000"


def test_age_days(value):
    assert value(tm.age_days(F.lit("2024-03-01"), ts("2024-02-28 23:00:00"))) == 2
    assert value(tm.age_days(F.lit("2024-03-01"), F.lit(None).cast("date"))) is None


@pytest.mark.parametrize("n, width, out", [(5, 4, "0005"), (12345, 3, None), (7, 25, "0" * 24 + "7"), (10**21 + 5, 25, "0001" + "0" * 20 + "5")])
def test_zero_pad(value, n, width, out):
    assert value(tx.zero_pad(F.lit(n if n < 2**63 else Decimal(n)), width)) == out


def test_names_and_paths(value):
    assert value(tx.quote_name(F.lit("a]b"))) == "[a]]b]"
    assert value(tx.name_part(F.lit("db.dbo.t"), 1)) == "t"
    assert value(tx.name_part(F.lit("db.dbo.t"), 3)) == "db"
    assert value(tx.name_part(F.lit("t"), 2)) is None
    assert value(tx.path_directory(F.lit("C:\\a\\b.trc"), "\\")) == "C:\\a"
    assert value(tx.path_file(F.lit("C:\\a\\b.trc"), "\\")) == "b.trc"
    assert value(tx.path_directory(F.lit("b"))) == ""
    assert value(tx.swap_first_bytes(F.lit("0A1B2C3D-77"))) == "3D2C1B0A"
    assert value(tx.length_trimmed(F.lit("ab  "))) == 2


def test_scrub_control(value):
    assert value(tx.scrub_control(F.lit("a\x00b\x01c\td\x1fe\nf"))) == "ab?c\td?e\nf"


@pytest.mark.parametrize("a, b, out", [
    (0, -1, "abcdef"), (4, -1, "cdef"), (2, 6, "bcd"), (-2, 4, "abcdef"), (40, -1, "abcdef"), (6, 2, "abcdef"), (0, 80, "abcdef")])
def test_text_slice(value, a, b, out):
    assert value(tx.text_slice(F.lit("abcdef"), F.lit(a), F.lit(b))) == out


def test_kv_value(value):
    text = F.lit("objid=12, principal_id = 34, hash = 0x0f")
    assert value(tx.kv_value(text, "principal_id")) == 34
    assert value(tx.kv_value(text, "id")) is None
    assert value(tx.kv_value(text, "hash")) is None
    assert value(tx.kv_value(text, "hash", "string")) == "0x0f"


def test_sizes_and_ratios(value):
    assert value(tx.size_kb(F.lit("123 KB"))) == 123
    assert value(ms.safe_ratio(F.lit(1.0), F.lit(0))) is None
    assert value(ms.smoothed_ratio(F.lit(3.0), F.lit(0))) == 3.0
    assert float(value(ms.floor_zero(F.lit(0)))) == 0.001
    assert value(tm.int_div(F.lit(-7), 2)) == -3


@pytest.mark.parametrize("pattern, yes, no", [
    ("l_%price%", "l_extendedprice", "p_price"), ("a_c", "abc", "ac"), ("[a-c]x", "bx", "dx"), ("[^a]x", "bx", "ax"), ("100[%]", "100%", "100x")])
def test_wildcards(value, pattern, yes, no):
    assert value(F.lit(yes).rlike(tx.wildcard_regex(pattern)))
    assert not value(F.lit(no).rlike(tx.wildcard_regex(pattern)))


def test_flags_and_labels(value):
    assert value(ms.flag_names(F.lit(5), ["a", "b", "c"])) == "a, c"
    assert value(ms.flag_mark(F.lit(4), 4)) == "X"
    assert value(ms.code_label(F.lit(9), {0: "Failed", 1: "Succeeded"}, F.lit("9"))) == "9"


def schedule(kind, start="2024-05-06 00:05:00", end=None, **over):
    args = dict(minutes=90, days=1, weeks=2, weekday_mask=2 | 32, month_day_mask=1 | 1 << 30, month_mask=4095, month_week=5) | over
    lit = lambda x: F.lit(x).cast("timestamp_ntz") if isinstance(x, str) else F.lit(x)
    return sc.schedule_text(F.lit(kind), lit(start), F.lit(end).cast("timestamp_ntz"), *[F.lit(args[k]) for k in (
        "minutes", "days", "weeks", "weekday_mask", "month_day_mask", "month_mask", "month_week")])


@pytest.mark.parametrize("kind, text", [
    (1, "At 12:05 AM on 05/06/2024"),
    (2, "Every 1 hour(s) and 30 minute(s), starting 05/06/2024 at 00:05 AM"),
    (3, "At 12:05 AM every day, starting 05/06/2024"),
    (4, "At 12:05 AM every Mon, Fri of every 2 weeks, starting 05/06/2024"),
    (5, "At 12:05 AM on day(s) 1,31 of every month, starting 05/06/2024"),
    (6, "At 12:05 AM on the last Mon, Fri of every month, starting 05/06/2024"),
    (7, "At 00:05 AM starting 05/06/2024"),
])
def test_schedule_text(value, kind, text):
    assert value(schedule(kind)) == text


def test_schedule_noon_and_end(value):
    assert value(schedule(1, "2024-05-06 12:00:00")) == "At 12:00 PM on 05/06/2024"
    assert value(schedule(3, end="2024-06-01 00:00:00", days=3)).endswith("every 3 days, starting 05/06/2024 and ending 06/01/2024")
    assert value(schedule(5, month_mask=5)).startswith("At 12:05 AM on day(s) 1,31 of Jan, Mar, ")


def test_job_texts(value):
    args = lambda *xs: [F.lit(x) for x in xs]
    assert value(sc.job_occurrence(*args(8, 3, 0, 2))) == "Every 2 week(s) on Sun, Mon"
    assert value(sc.job_occurrence(*args(32, 9, 16, 1))) == "The Last Weekday of every 1 month(s)"
    assert value(sc.job_frequency(*args(4, 15, 80000, 170000))) == "Occurs every 15 Minute(s) starting at 08:00:00 ending at 17:00:00"


def test_xml(value):
    xml = F.lit('<a:P xmlns:a="u"><a:V><a:Name>TO</a:Name><a:Value>x &amp; y</a:Value></a:V><a:V><a:Name>CC</a:Name><a:Value>z</a:Value></a:V></a:P>')
    assert value(xp.value_by_sibling(xml, "V", "CC")) == "z"
    assert value(xp.value_by_sibling(xml, "V", "TO")) == "x & y"
    assert value(xp.xml_escape(F.lit("<&>"))) == "&lt;&amp;&gt;"


@pytest.mark.parametrize("name", ["plain", 'a "b"', "it's", """both ' and " and '"'"""])
def test_xml_values_are_not_edited(value, name):
    inside = '<![CDATA[x xmlns="u" <a:b>]]>'
    xml = F.lit(f'<p:D xmlns:p="u"><p:V><p:Name><![CDATA[{name}]]></p:Name><p:Value>{inside}</p:Value></p:V></p:D>')
    assert value(xp.value_by_sibling(xml, "V", name)) == 'x xmlns="u" <a:b>'
    assert value(xp.value_by_sibling(xml, "V", name + "?")) == ""


@pytest.mark.parametrize("text", ["<open", "plain", "", "<a>x</b>", None])
def test_text_that_is_no_xml(value, text):
    assert value(xp.value_by_sibling(F.lit(text).cast("string"), "V", "x")) is None
