"""Date and time expressions."""

from __future__ import annotations

from pyspark.sql import Column, functions as F

MICROS_PER_DAY = 86_400_000_000


def col(x: Column | str) -> Column:
    return F.col(x) if isinstance(x, str) else x


def micros(ts: Column | str) -> Column:
    """Microseconds since the epoch, for zoned and naive timestamps alike."""
    return F.unix_micros(col(ts).cast("timestamp"))


def from_micros(us: Column | str) -> Column:
    return F.timestamp_micros(col(us)).cast("timestamp_ntz")


def week_start(d: Column | str) -> Column:
    """The Sunday on or before ``d``."""
    day = col(d).cast("date")
    return F.date_sub(day, F.dayofweek(day) - 1)


def week_us(d: Column | str) -> Column:
    """Week of year where January 1st is in week 1 and weeks start on Sunday."""
    day = col(d).cast("date")
    offset = F.dayofweek(F.trunc(day, "year"))
    return F.floor((F.dayofyear(day) + offset - F.lit(2)) / F.lit(7)).cast("int") + F.lit(1)


def boundaries(unit: str, start: Column | str, end: Column | str) -> Column:
    """How many ``unit`` boundaries lie between two moments.

    23:59 to 00:01 is one day boundary; ``timestampdiff`` would say zero days.
    """
    a, b = col(start), col(end)
    if unit == "day":
        return F.datediff(b.cast("date"), a.cast("date"))
    if unit == "week":
        return F.floor(F.datediff(week_start(b), week_start(a)) / 7).cast("int")
    if unit in ("year", "quarter", "month"):
        per_year, part = {
            "year": (1, lambda x: F.lit(0)), "quarter": (4, F.quarter), "month": (12, F.month),
        }[unit]
        return (F.year(b) - F.year(a)) * per_year + part(b) - part(a)
    width = {"hour": 3_600_000_000, "minute": 60_000_000, "second": 1_000_000, "millisecond": 1_000}[unit]
    return slot_of(b, width) - slot_of(a, width)


def _floor_div(x: Column, width: int) -> Column:
    return F.call_function("div", x - F.pmod(x, F.lit(width)), F.lit(width).cast("bigint"))


def slot_of(ts: Column | str, width_us: int) -> Column:
    """Index of the fixed-width slot that holds ``ts`` (floor division)."""
    return _floor_div(micros(ts), width_us)


def packed_to_timestamp(date_int: Column | str, time_int: Column | str) -> Column:
    """YYYYMMDD and HHMMSS integers to a naive timestamp; date 0 is NULL."""
    d, t = col(date_int).cast("int"), col(time_int).cast("int")
    return F.when(
        d != 0,
        F.make_timestamp_ntz(
            int_div(d, 10_000), int_div(d, 100) % 100, d % 100,
            int_div(t, 10_000), int_div(t, 100) % 100, t % 100,
        ),
    )


def packed_seconds(duration_int: Column | str) -> Column:
    """HHMMSS duration to seconds; the hour part may exceed 23."""
    v = col(duration_int)
    return int_div(v, 10_000) * 3600 + int_div(v, 100) % 100 * 60 + v % 100


def packed_clock(duration_int: Column | str) -> Column:
    """HHMMSS duration as ``hh:mm:ss``, hours widening past two digits."""
    return clock_text(packed_seconds(duration_int))


def int_div(a: Column | str, b: Column | int) -> Column:
    """Integer division truncating toward zero."""
    right = F.lit(b) if isinstance(b, int) else b
    return F.call_function("div", col(a), right)


def two_digits(x: Column) -> Column:
    return F.when(x < 10, F.concat(F.lit("0"), x.cast("string"))).otherwise(x.cast("string"))


def clock_text(seconds: Column) -> Column:
    return F.concat_ws(
        ":", two_digits(int_div(seconds, 3600)), two_digits(int_div(seconds, 60) % 60), two_digits(seconds % 60)
    )


def elapsed_parts_text(ms: Column | str, day_width: Column | int = 2) -> Column:
    """``dd hh:mm:ss.mss`` with the day count left-padded to ``day_width``."""
    v = col(ms).cast("bigint")
    days = int_div(v, 86_400_000).cast("string")
    width = F.lit(day_width) if isinstance(day_width, int) else day_width
    rest = v % 86_400_000
    return F.concat(
        F.repeat(F.lit("0"), F.greatest(width - F.length(days), F.lit(0))), days, F.lit(" "),
        clock_text(int_div(rest, 1000)), F.lit("."),
        F.lpad((rest % 1000).cast("string"), 3, "0"),
    )


def elapsed_words(ms: Column | str) -> Column:
    """``Xhrs`` ``Ymin`` ``Zsec`` run together."""
    v = col(ms).cast("bigint")
    return F.concat(
        int_div(v, 3_600_000).cast("string"), F.lit("hrs"),
        int_div(v % 3_600_000, 60_000).cast("string"), F.lit("min"),
        int_div(v % 60_000, 1000).cast("string"), F.lit("sec"),
    )


def uptime_words(start: Column | str, end: Column | str) -> Column:
    """``H hours & M minutes`` from minute boundaries crossed."""
    minutes = boundaries("minute", start, end)
    return F.concat(
        int_div(minutes, 60).cast("string"), F.lit(" hours & "), (minutes % 60).cast("string"), F.lit(" minutes")
    )


def first_sunday_from(year: Column, month: int, day: int) -> Column:
    """First Sunday on or after the given month and day of ``year``."""
    return F.next_day(F.date_sub(F.make_date(year, F.lit(month), F.lit(day)), 1), "Sun")


def utc_to_local(ts: Column | str, offset_hours: int = -6, mode: str = "rule", zone: str = "America/Chicago") -> Column:
    """UTC to US local time.

    ``mode='rule'`` shifts by a fixed offset and adds an hour between the two
    daylight-saving Sundays, both bounds compared at 02:00 standard time and
    inclusive. ``mode='tzdb'`` uses the time zone database instead.
    """
    t = col(ts).cast("timestamp_ntz")
    if mode == "tzdb":
        return F.convert_timezone(F.lit("UTC"), F.lit(zone), t)
    if mode != "rule":
        raise ValueError(f"unknown mode {mode!r}")
    local = t + F.make_dt_interval(hours=F.lit(offset_hours))
    year = F.year(local)
    recent = year > 2006
    starts = F.when(recent, first_sunday_from(year, 3, 8)).otherwise(first_sunday_from(year, 4, 1))
    ends = F.when(recent, first_sunday_from(year, 11, 1)).otherwise(first_sunday_from(year, 10, 25))
    two = F.make_dt_interval(hours=F.lit(2))
    in_dst = local.between(starts.cast("timestamp_ntz") + two, ends.cast("timestamp_ntz") + two)
    return F.when(in_dst, local + F.make_dt_interval(hours=F.lit(1))).otherwise(local)


def to_offset_time(ts: Column | str, offset_minutes: int) -> Column:
    """Attach a UTC offset to a naive local time: struct(instant, offset_minutes)."""
    t = col(ts).cast("timestamp_ntz")
    return F.struct(
        (t - F.make_dt_interval(mins=F.lit(offset_minutes))).alias("instant"),
        F.lit(offset_minutes).alias("offset_minutes"),
    )


def offset_time_text(value: Column) -> Column:
    """Render ``to_offset_time`` output as local time followed by ``±hh:mm``."""
    off = value["offset_minutes"]
    local = value["instant"] + F.make_dt_interval(mins=off)
    return F.concat(
        F.date_format(local, "yyyy-MM-dd HH:mm:ss"), F.lit(" "),
        F.when(off < 0, F.lit("-")).otherwise(F.lit("+")),
        two_digits(int_div(F.abs(off), 60)), F.lit(":"), two_digits(F.abs(off) % 60),
    )


def age_days(as_of: Column | str, moment: Column | str) -> Column:
    """Whole calendar days from ``moment`` to ``as_of``; NULL stays NULL."""
    return F.datediff(col(as_of).cast("date"), col(moment).cast("date"))


def calendar_parts(ts: Column | str) -> dict[str, Column]:
    t = col(ts)
    return {
        "year": F.year(t), "month": F.month(t), "month_name": F.date_format(t, "MMMM"),
        "weekday_name": F.date_format(t, "EEEE"), "weekday": F.dayofweek(t),
    }
