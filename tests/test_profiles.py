"""Profiles of batches merge to the profile of the whole."""

import random

from setwise.operators import profiles
from setwise.session import scratch_path

SCHEMA = "a int, b double, c string, d timestamp_ntz, e array<int>"


def test_batches_merge_to_the_whole(make, spark):
    rnd = random.Random(1)
    rows = [(rnd.randrange(3000), rnd.random() if i % 4 else None, f"t{rnd.randrange(700)}", None, [rnd.randrange(5)]) for i in range(6000)]
    folder, one = scratch_path(spark, "profiles"), scratch_path(spark, "profiles")
    for batch in range(3):
        part = make(rows[batch::3], SCHEMA)
        profiles.store_batch(part, "t", batch, folder)
        profiles.store_batch(part, "t", batch, folder)  # a repeated batch replaces itself
    profiles.store_batch(make([], SCHEMA), "t", 3, folder)
    profiles.store_batch(make(rows, SCHEMA), "t", 0, one)
    got = {r.column_name: r for r in profiles.merged_profile(profiles.stored_batches(spark, folder)).collect()}
    whole = {r.column_name: r for r in profiles.merged_profile(profiles.stored_batches(spark, one)).collect()}
    for name, i in zip("abcde", range(5), strict=True):
        r, w = got[name], whole[name]
        values = [x[i] for x in rows if x[i] is not None]
        assert (r.rows, r.nulls, r.low, r.high, r.low_text, r.high_text) == (w.rows, w.nulls, w.low, w.high, w.low_text, w.high_text)
        assert (r.rows, r.nulls) == (6000, 6000 - len(values))
        assert abs(r.distinct - len({str(v) for v in values})) <= 5 * profiles.DISTINCT_ERROR * max(len(values), 1)
    assert got["d"].quantile is None and got["c"].quantile is None
    rank = sum(x[0] < got["a"].quantile for x in rows) / 6000
    assert abs(rank - 0.5) <= 2 * profiles.RANK_ERROR
    assert (got["c"].low_text, got["c"].high_text) == (min(x[2] for x in rows), max(x[2] for x in rows))


def test_staleness_from_profiles(make, spark):
    folder = scratch_path(spark, "profiles")
    profiles.store_batch(make([(1, "b"), (5, "c")], "x int, y string"), "t", 0, folder)
    profiles.store_batch(make([(3, "a"), (4, None)], "x int, y string"), "t", 1, folder)
    got = profiles.profile_staleness(profiles.stored_batches(spark, folder), 1).collect()
    assert [(r.table_name, r.rows, r.rows_known, r.columns_widened, r.known_percent) for r in got] == [("t", 4, 2, 1, 50.0)]
