from datetime import date, datetime

import pytest
from pyspark.sql import functions as F

from setwise.operators import incremental as inc
from setwise.operators import maintenance as mt
from setwise.session import scratch_path
from setwise.sources import sinks

SNAP = "id int, started int, cpu int, thread_cpu int, reads int"


def test_snapshot_delta_guards(make):
    first = make([(1, 5, 10, 100, 7), (3, 5, 10, 100, 7), (4, 5, 10, 100, 7)], SNAP)
    second = make([(1, 5, 12, 140, 9), (2, 5, 50, 50, 50), (3, 6, 12, 140, 9), (4, 5, 12, 90, 5)], SNAP)
    out = inc.snapshot_delta(first, second, ["id"], "started", ["reads"], {"work": ("cpu", "thread_cpu")})
    got = {r.id: (r.reads_delta, r.work_delta) for r in out.collect()}
    assert got == {1: (2, 40), 2: (None, None), 3: (None, None), 4: (None, 2)}


def test_rollup_since(make, spark):
    events = make([("a", 1), ("a", 5), ("b", 3)], "k string, t int")
    store = scratch_path(spark, "store")
    sinks.append(inc.rollup_since(events.where("t < 4"), None, ["k"], "t"), store)
    mark = inc.high_water_mark(spark.read.parquet(store))
    assert mark == 3
    fresh = inc.rollup_since(events, mark, ["k"], "t")
    assert [tuple(r) for r in fresh.collect()] == [("a", 5, 5, 1)]
    assert inc.high_water_mark(events.limit(0).withColumn("latest", F.col("t"))) is None


def test_replace_is_repeatable(make, spark, rows):
    path = scratch_path(spark, "days")
    put = lambda data: sinks.replace_partitions(make(data, "v int, day date"), path, ["day"])
    put([(1, date(2024, 1, 1)), (2, date(2024, 1, 2))])
    put([(3, date(2024, 1, 2))])
    put([(3, date(2024, 1, 2))])
    assert rows(spark.read.parquet(path)) == [(1, date(2024, 1, 1)), (3, date(2024, 1, 2))]


def test_upsert(make, rows):
    target = make([(1, "a"), (2, "b")], "id int, v string")
    changes = make([(2, "B"), (0, "y"), (None, "x"), (9, "ghost")], "id int, v string")
    assert rows(inc.upsert(target, changes, "id")) == [(1, "a"), (2, "B"), (3, "x"), (4, "y")]
    assert rows(inc.upsert(target.limit(0), changes, "id")) == [(1, "x"), (2, "y")]
    assert rows(inc.delete_keys(target, changes, "id")) == [(1, "a")]
    assert rows(inc.get_by_key(target, "id", 2)) == [(2, "b")]


def test_update_and_delete_from(make, rows):
    target = make([(1, "a", 1), (2, "b", 2)], "id int, v string, w int")
    source = make([(1, "A"), (2, None)], "id int, new string")
    assert rows(inc.update_from(target, source, "id", {"v": "new"})) == [(1, "A", 1), (2, "b", 2)]
    assert rows(inc.delete_from(target, source.where("id = 1"), ["id"])) == [(2, "b", 2)]


BACKUP = "db string, kind string, t int, lsn long, id int, copy boolean"


def chain(make, data):
    out = inc.restore_chain(make(data, BACKUP), "db", "kind", "t", "lsn", "id", F.col("copy"))
    return sorted((r.db, r.step, r.t) for r in out.collect())


def test_restore_chain(make):
    data = [("a", "D", 1, 10, 1, False), ("a", "D", 5, 50, 2, False), ("a", "D", 9, 90, 3, True), ("a", "I", 3, 30, 4, False),
            ("a", "I", 6, 60, 5, False), ("a", "I", 7, 70, 6, False), ("a", "L", 6, 65, 7, False), ("a", "L", 8, 70, 8, False),
            ("a", "L", 9, 95, 9, False), ("b", "D", 1, 10, 10, False), ("b", "L", 2, 20, 11, False), ("b", "L", 0, 5, 12, False),
            ("c", "L", 2, 20, 13, False)]
    assert chain(make, data) == [("a", 1, 5), ("a", 2, 7), ("a", 3, 8), ("a", 3, 9), ("b", 1, 1), ("b", 3, 2), ("c", 3, 2)]


def test_capacity(make):
    files = make([("a", "data", 256, 128), ("a", "data", 128, 128), ("a", "log", 64, 0)], "db string, kind string, size int, used int")
    row = inc.capacity_snapshot(files, "db", "kind", {"data": "data", "log": "log"}, "size", "used").first()
    assert [float(x) for x in row[1:]] == [3.0, 0.5, 1.0, 0.5]


METRICS = ("database_id int, object_id int, index_id int, partition_number int, fragmentation double, page_count int, "
           "range_scan_count int, index_level int, rows long, contains_lob boolean, allow_page_locks boolean")


def metric(object_id, frag, part=1, pages=100, index_id=1, level=0, rows=5, lob=False, locks=True, scans=1):
    return (1, object_id, index_id, part, float(frag), pages, scans, level, rows, lob, locks)


@pytest.mark.parametrize("frag, lob, partitioned, locks, action", [
    (9.9, False, False, True, None), (10, False, False, True, "REORGANIZE"), (29.9, False, False, True, "REORGANIZE"),
    (30, False, False, True, "REBUILD"), (30, True, False, True, "REORGANIZE"), (30, False, True, True, "REORGANIZE"),
    (30, True, True, True, "REORGANIZE"), (10, False, False, False, "REBUILD"), (30, False, False, False, "REBUILD"),
    (10, True, False, False, "NONE"), (30, False, True, False, "NONE"), (30, True, True, False, "NONE"),
])
def test_queue_decisions(make, frag, lob, partitioned, locks, action):
    data = [metric(1, frag, lob=lob, locks=locks)] + ([metric(1, 0, part=2)] if partitioned else [])
    got = [r.action for r in mt.maintenance_queue(make(data, METRICS)).collect()]
    assert got == ([action] if action else [])


def test_queue_filters(make):
    data = [metric(1, 50), metric(2, 50, pages=8), metric(3, 50, index_id=0), metric(4, 50, level=1), metric(5, 50, pages=5000),
            metric(6, 50, part=1), metric(6, 60, part=2), metric(6, 0, part=3, rows=0)]
    keys = lambda **kw: sorted((r.object_id, r.partition_number) for r in mt.maintenance_queue(make(data, METRICS), **kw).collect())
    assert keys() == [(1, 1), (5, 1), (6, 1), (6, 2)]
    assert keys(options=mt.QueueOptions(max_pages=1000)) == [(1, 1), (6, 1), (6, 2)]
    assert keys(options=mt.QueueOptions(exclude_max_partition=True)) == [(1, 1), (5, 1), (6, 1)]
    masks = make([(1, 1, 1, 1 | 64), (1, 5, 1, 2)], "database_id int, object_id int, index_id int, exclusion_mask int")
    assert keys(exclusions=masks, weekday=1) == [(5, 1), (6, 1), (6, 2)]
    assert keys(exclusions=masks, weekday=2) == [(1, 1), (6, 1), (6, 2)]


def test_queue_order_and_defaults(make):
    data = [metric(1, 50, scans=3), metric(2, 60, scans=9)]
    order = lambda o: [r.object_id for r in mt.maintenance_queue(make(data, METRICS), options=o).orderBy(*mt.queue_order(o)).collect()]
    assert order(mt.QueueOptions()) == [2, 1]
    assert order(mt.QueueOptions(order_column="rows; drop", descending=False)) == [1, 2]
    assert mt.QueueOptions(min_fragmentation=101, rebuild_threshold=-1).checked().rebuild_threshold == 30.0


def test_series_delta(make, rows):
    df = make([(1, 1, 5, 0), (1, 2, 9, 0), (1, 3, 4, 0), (1, 4, 6, 1), (2, 1, 7, 0)], "id int, t int, v int, started int")
    out = inc.snapshot_series_delta(df, ["id"], "t", ["v"], "started")
    assert rows(out.select("id", "capture_no", "v_delta")) == [(1, 1, None), (1, 2, 4), (1, 3, None), (1, 4, None), (2, 1, None)]


def test_work_log(make, rows):
    queue = make([(1,), (2,), (3,)], "id int")
    at = lambda s: datetime(2024, 1, 1, 0, 0, s)
    done = make([(1, at(1), at(9), None), (2, at(9), at(12), "lock timeout")], "id int, began timestamp_ntz, ended timestamp_ntz, error string")
    out = mt.work_log(queue, done, ["id"], "began", "ended", "error")
    assert rows(out.select("id", "duration_seconds", "error")) == [(1, 8, None), (2, -1, "lock timeout"), (3, None, None)]


def test_upsert_repeated_and_text_keys(make, rows):
    target = make([("a", 1), ("b", 2)], "id string, v int")
    changes = make([("a", 5, 1), ("a", 6, 2), ("", 7, 1), ("zz", 8, 1)], "id string, v int, at int")
    assert rows(inc.upsert(target, changes, "id", order="at")) == [("", 7), ("a", 6), ("b", 2)]
    with pytest.raises(Exception, match="several changes for id a"):
        inc.upsert(target, changes, "id").collect()


def test_rollup_unread_counts_late_and_tied(make, rows):
    loads = make([(1, "k", 10), (1, "k", 20), (2, "k", 20), (2, "k", 5)], "load int, k string, t int")
    first = inc.rollup_unread(loads.where("load = 1"), None, "load", ["k"], "t")
    second = inc.rollup_unread(loads, loads.where("load = 1").select("load"), "load", ["k"], "t")
    assert rows(first) == [("k", 20, 10, 2)] and rows(second) == [("k", 20, 5, 2)]
