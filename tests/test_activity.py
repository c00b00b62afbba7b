from datetime import datetime

import pytest

from setwise.functions import sqlnames
from setwise.operators.activity import ActivityOptions, activity_report

SESSION = ("session_id int, request_id int, start_time int, reads int, CPU int, thread_CPU int, status string, "
           "blocking_session_id int, login_name string, program_name string")


@pytest.fixture
def sessions(make):
    return make([(51, 0, 1, 10, 5, 50, "running", None, "sa", "x"), (52, 0, 1, 20, 5, 50, "suspended", 51, "bob", "y"),
                 (53, 0, 1, 30, 5, 50, "sleeping", 52, "bob", "y")], SESSION)


def test_plain(sessions):
    out = activity_report(sessions, ActivityOptions(columns="[session_id][reads]", order="[reads] DESC"))
    assert [tuple(r) for r in out.collect()] == [(53, 30), (52, 20), (51, 10)]


def test_delta_and_block_leaders(make, sessions):
    before = make([(51, 0, 1, 4, 1, 10, "running", None, "sa", "x"), (52, 0, 0, 4, 1, 10, "running", None, "bob", "y")], SESSION)
    options = ActivityOptions(
        include="bob", include_by="login", metrics=["reads"], largest_cpu=("CPU", "thread_CPU"), find_block_leaders=True,
        columns="[session_id][reads_delta][CPU_delta][blocked%]")
    out = activity_report(sessions, options, previous=before)
    assert [tuple(r) for r in out.collect()] == [(52, None, None, 1), (53, None, None, 0)]
    everyone = activity_report(sessions, ActivityOptions(metrics=["reads"], largest_cpu=("CPU", "thread_CPU"),
                               columns="[session_id][%_delta]"), previous=before)
    assert tuple(everyone.first()) == (51, 6, 40)


def test_parts_join_only_when_given(make, sessions, plan_of):
    waits = make([(51, 0, "LCK", 5), (51, 0, "LCK", 9)], "session_id int, request_id int, wait_type string, wait_duration_ms long")
    trans = make([(51, 0, "db", 2, 4096, 7)], "session_id int, request_id int, database string, log_record_count long, log_bytes_used long, begin_time int")
    locks = make([(51, "db", "X"), (51, "db", "X")], "session_id int, database_name string, request_mode string")
    out = activity_report(sessions, ActivityOptions(include="51", columns="[wait%][tran%][locks]"), None, waits, trans, locks)
    assert tuple(out.first()) == ("(2x: 5/9ms)LCK", "db: 2 (4 kB)", 7, '[{"group":"db","items":[{"name":"X","count":2}]}]')
    assert "Join" not in plan_of(activity_report(sessions))


def test_destination_and_schema(spark, sessions):
    options = ActivityOptions(columns="[session_id][status]", show_sleeping=False)
    assert activity_report(sessions, options, return_schema=True) == "`session_id` int, `status` string"
    activity_report(sessions, options, destination="activity_rows")
    activity_report(sessions, options, destination="activity_rows")
    assert spark.table("activity_rows").count() == 4


def test_sql_functions(spark, make):
    make([("a", 10.0, 4, datetime(2024, 1, 2)), ("a", 5.0, 6, datetime(2024, 1, 3)), ("b", 1.0, 1, datetime(2020, 1, 1))],
         "database_name string, fragmentation double, duration_seconds int, started timestamp_ntz").createOrReplaceTempView("defrag_log")
    sqlnames.register(spark, "defrag_log")
    one = lambda e: spark.sql(f"select {e}").first()[0]
    assert one("zero_pad(5, 4)") == "0005" and one("zero_pad(12345, 3)") is None and len(one("zero_pad(7, 25)")) == 25
    assert one("week_us(date'2024-01-07')") == 2 and one("packed_seconds(13005)") == 5405
    assert one("packed_datetime(20150307, 150200)") == datetime(2015, 3, 7, 15, 2) and one("packed_datetime(0, 0)") is None
    assert one("swap_first_bytes('0A1B2C3D')") == "3D2C1B0A" and one("quote_name('a]b')") == "[a]]b]"
    assert one("utc_to_local(timestamp_ntz'2024-03-10 08:00:00')") == datetime(2024, 3, 10, 3)
    assert one("utc_to_local(timestamp_ntz'2006-03-20 12:00:00')") == datetime(2006, 3, 20, 6)
    rows = spark.sql("select * from bucket_profile(timestamp_ntz'2024-01-01 00:00:00')").collect()
    assert [tuple(r)[:7] for r in rows] == [("a", 2, 5.0, 10, 7.5, 2, 1)]


def test_sleeping_sessions(make, sessions):
    """All, none, or those with an open transaction; a session without a status is not asleep."""
    more = make([(54, "sleeping", 2), (55, "sleeping", None), (56, None, 0), (57, "running", 0), (58, "sleeping", 0)], "session_id int, status string, open_tran_count int")
    shown = lambda how: sorted(r[0] for r in activity_report(more, ActivityOptions(columns="[session_id]", order="[session_id]", show_sleeping=how)).collect())
    assert shown(True) == [54, 55, 56, 57, 58] and shown(False) == [56, 57] and shown("open") == [54, 56, 57]
    with pytest.raises(ValueError):
        shown("some")
