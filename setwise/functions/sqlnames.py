"""The scalar helpers and one report as SQL functions, for users who write SQL."""

from __future__ import annotations

from pyspark.sql import SparkSession

# name(parameters) -> (type, body)
SCALARS = {
    "zero_pad(n bigint, width int)": (
        "string", "if(length(string(n)) <= width, lpad(string(n), width, '0'), null)"),
    "week_us(d date)": ("int", "int(floor((dayofyear(d) + dayofweek(trunc(d, 'year')) - 2) / 7)) + 1"),
    "packed_seconds(hhmmss int)": ("int", "int(hhmmss div 10000 * 3600 + hhmmss div 100 % 100 * 60 + hhmmss % 100)"),
    "packed_datetime(d int, t int)": (
        "timestamp_ntz", "if(d = 0, null, make_timestamp_ntz(int(d div 10000), int(d div 100 % 100), d % 100, "
                         "int(t div 10000), int(t div 100 % 100), t % 100))"),
    "swap_first_bytes(x string)": (
        "string", "concat(substring(x, 7, 2), substring(x, 5, 2), substring(x, 3, 2), substring(x, 1, 2))"),
    "quote_name(x string)": ("string", "concat('[', replace(x, ']', ']]'), ']')"),
    "dst_bound(y int, new_month int, new_day int, old_month int, old_day int)": (
        "timestamp_ntz",
        "cast(if(y > 2006, next_day(date_sub(make_date(y, new_month, new_day), 1), 'Sun'), "
        "next_day(date_sub(make_date(y, old_month, old_day), 1), 'Sun')) as timestamp_ntz) + interval 2 hours"),
    "us_standard_to_local(t timestamp_ntz)": (
        "timestamp_ntz",
        "t + if(t between dst_bound(year(t), 3, 8, 4, 1) and dst_bound(year(t), 11, 1, 10, 25), interval 1 hour, interval 0 hour)"),
    "utc_to_local(t timestamp_ntz)": ("timestamp_ntz", "us_standard_to_local(t - interval 6 hours)"),
}


def register(spark: SparkSession, log_view: str | None = None) -> None:
    """Create the functions for this session; with ``log_view`` also ``bucket_profile(since)`` over it.

    The view has database_name, fragmentation, duration_seconds, started.
    """
    for head, (type_, body) in SCALARS.items():
        spark.sql(f"create or replace temporary function {head} returns {type_} return {body}")
    if log_view:
        buckets = ", ".join(
            f"count_if(fragmentation between {lo} and {lo + 10}) as frag{lo + 10}" for lo in range(0, 100, 10))
        names = ", ".join(f"frag{hi} bigint" for hi in range(10, 101, 10))
        spark.sql(f"""create or replace temporary function bucket_profile(since timestamp_ntz) returns table (
            database_name string, touches bigint, avg_duration double, total_duration bigint, avg_fragmentation double, {names})
            return select database_name, count(*), avg(duration_seconds), sum(duration_seconds), avg(fragmentation), {buckets}
            from {log_view} where started > since group by database_name""")
