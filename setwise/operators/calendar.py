"""Date dimensions and time slots."""

from __future__ import annotations

from datetime import date, datetime, timedelta

from pyspark.sql import Column, DataFrame, SparkSession, Window, functions as F

from setwise.functions.times import boundaries, week_us
from setwise.functions.times import two_digits


def date_spine(spark: SparkSession, start: date | str, end: date | str, step: str = "1 day") -> DataFrame:
    """Every date from ``start`` to ``end``, both included."""
    first, last = F.lit(str(start)).cast("date"), F.lit(str(end)).cast("date")
    return spark.range(1).select(
        F.explode(F.sequence(first, last, F.expr(f"interval {step}"))).alias("calendar_date")
    )


def spine_over(df: DataFrame, moment: str, step: str = "1 day") -> DataFrame:
    """Every date between the first and last ``moment`` of a table."""
    bounds = df.agg(F.min(F.col(moment).cast("date")).alias("lo"), F.max(F.col(moment).cast("date")).alias("hi"))
    return bounds.where("lo is not null").select(
        F.explode(F.sequence("lo", "hi", F.expr(f"interval {step}"))).alias("calendar_date")
    )


def time_slots(spark: SparkSession, start: datetime | str, end: datetime | str, minutes: int = 15) -> DataFrame:
    """Fixed-width slots from ``start`` to ``end`` inclusive: slot_id from 1, slot_time, week_day (Sunday 1).

    A range of numbers, so the axis is made in as many tasks as it needs.
    """
    first, last = (datetime.fromisoformat(str(x)) for x in (start, end))
    slots = (last - first) // timedelta(minutes=minutes) + 1
    at = F.lit(str(first)).cast("timestamp_ntz")
    return spark.range(max(slots, 0)).withColumn("slot_time", F.timestamp_add("MINUTE", (F.col("id") * minutes).cast("int"), at)).select(
        (F.col("id") + 1).cast("int").alias("slot_id"), "slot_time", F.dayofweek("slot_time").alias("week_day"))


def slots_over(df: DataFrame, moment: str, minutes: int = 15) -> DataFrame:
    """Slots from midnight of a table's first day to midnight after its last; the two days reach the driver."""
    day = F.col(moment).cast("timestamp_ntz").cast("date")
    first, last = df.agg(F.min(day), F.date_add(F.max(day), 1)).first()
    slots = time_slots(df.sparkSession, first or "2000-01-01", last or "2000-01-01", minutes)
    return slots if first else slots.limit(0)


def calendar(spark: SparkSession, start: date | str, end: date | str, holidays: DataFrame | None = None) -> DataFrame:
    return calendar_columns(date_spine(spark, start, end), holidays)


def calendar_columns(spine: DataFrame, holidays: DataFrame | None = None) -> DataFrame:
    """The 42-column date dimension over a ``calendar_date`` spine.

    Quarter edges are those present in the spine. Windows are per month,
    quarter or year, so the largest holds 366 rows whatever the range.
    ``holidays`` (one ``calendar_date`` column) fills ``is_holiday``, else NULL.
    """
    d = F.col("calendar_date")
    year, month, quarter = F.year(d), F.month(d), F.quarter(d)
    text = lambda c: c.cast("string")
    as_int = lambda c: c.cast("int")
    base = spine.select(
        d,
        year.alias("calendar_year"), month.alias("calendar_month"), F.dayofmonth(d).alias("calendar_day"),
        quarter.alias("calendar_quarter"),
        F.date_sub(d, F.dayofweek(d) - 1).alias("first_day_in_week"),
        F.date_add(d, F.lit(7) - F.dayofweek(d)).alias("last_day_in_week"),
        F.trunc(d, "month").cast("date").alias("first_day_in_month"), F.last_day(d).alias("last_day_in_month"),
        F.dayofweek(d).alias("day_of_week"), week_us(d).alias("week_of_year"), F.dayofyear(d).alias("day_of_year"),
        as_int(~F.dayofweek(d).isin(1, 7)).alias("is_weekday"),
        F.date_format(d, "EEEE").alias("day_name"), F.date_format(d, "MMMM").alias("month_name"),
        (boundaries("week", F.trunc(d, "month"), d) + 1).alias("week_of_month"),
        as_int(F.dayofyear(F.make_date(year, F.lit(12), F.lit(31))) == 366).alias("is_leap_year"),
        F.concat(text(year), two_digits(week_us(d))).alias("year_week"),
        F.concat(text(year), two_digits(month)).alias("year_month"),
        F.concat(text(year), F.lit("Q"), text(quarter)).alias("year_quarter"),
        F.dayofmonth(F.last_day(d)).alias("days_in_month"),
    )
    per_month, per_quarter = Window.partitionBy("year_month"), Window.partitionBy("year_quarter")
    upto = lambda w: w.orderBy("calendar_date").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    instance = lambda period: F.row_number().over(Window.partitionBy(period, "day_name").orderBy("calendar_date"))
    wide = base.select(
        "*",
        F.min(d).over(per_quarter).alias("first_day_in_quarter"),
        F.max(d).over(per_quarter).alias("last_day_in_quarter"),
        (F.col("week_of_year") - F.min("week_of_year").over(per_quarter) + 1).alias("week_of_quarter"),
        F.sum("is_weekday").over(per_month).cast("int").alias("weekdays_in_month"),
        F.sum("is_weekday").over(per_quarter).cast("int").alias("weekdays_in_quarter"),
        F.sum("is_weekday").over(upto(per_month)).cast("int").alias("month_weekdays_completed"),
        F.sum("is_weekday").over(upto(per_quarter)).cast("int").alias("quarter_weekdays_completed"),
        instance("year_month").alias("month_day_name_instance"),
        instance("year_quarter").alias("quarter_day_name_instance"),
        instance("calendar_year").alias("year_day_name_instance"),
    )
    first_q, last_q = F.col("first_day_in_quarter"), F.col("last_day_in_quarter")
    out = wide.select(
        "calendar_date", "calendar_year", "calendar_month", "calendar_day", "calendar_quarter",
        "first_day_in_week", "last_day_in_week",
        as_int((F.col("first_day_in_week") >= F.col("first_day_in_month"))
               & (F.col("last_day_in_week") <= F.col("last_day_in_month"))).alias("is_week_in_same_month"),
        "first_day_in_month", "last_day_in_month",
        as_int(d == F.col("last_day_in_month")).alias("is_last_day_in_month"),
        "first_day_in_quarter", "last_day_in_quarter", as_int(d == last_q).alias("is_last_day_in_quarter"),
        "day_of_week", "week_of_month", "week_of_quarter", "week_of_year", "days_in_month",
        (F.col("days_in_month") - F.col("calendar_day")).alias("month_days_remaining"),
        "weekdays_in_month",
        (F.col("weekdays_in_month") - F.col("month_weekdays_completed")).alias("month_weekdays_remaining"),
        "month_weekdays_completed",
        (F.datediff(last_q, first_q) + 1).alias("days_in_quarter"),
        F.datediff(last_q, d).alias("quarter_days_remaining"),
        (F.datediff(d, first_q) + 1).alias("quarter_days_completed"),
        "weekdays_in_quarter",
        (F.col("weekdays_in_quarter") - F.col("quarter_weekdays_completed")).alias("quarter_weekdays_remaining"),
        "quarter_weekdays_completed", "day_of_year",
        (F.lit(365) + F.col("is_leap_year") - F.col("day_of_year")).alias("year_days_remaining"),
        "is_weekday", "is_leap_year", "day_name", "month_day_name_instance", "quarter_day_name_instance",
        "year_day_name_instance", "month_name", "year_week", "year_month", "year_quarter",
    )
    if holidays is None:
        return out.withColumn("is_holiday", F.lit(None).cast("int"))
    marked = holidays.select("calendar_date").distinct().withColumn("__h", F.lit(1))
    return out.join(marked, "calendar_date", "left").withColumn("is_holiday", F.coalesce("__h", F.lit(0))).drop("__h")


def fill_gaps(spine: DataFrame, facts: DataFrame, on: str, zeros: dict[str, Column | int]) -> DataFrame:
    """Left-join aggregated facts to a spine, absent rows filled."""
    out = spine.join(facts, on, "left")
    for name, value in zeros.items():
        out = out.withColumn(name, F.coalesce(F.col(name), F.lit(value)))
    return out
