from datetime import date, datetime

from pyspark.sql import functions as F

from setwise.operators import calendar as cal


def test_full_range(spark):
    days = cal.calendar(spark, "2000-01-01", "2030-12-31").cache()
    assert days.count() == 11_323 and len(days.columns) == 42
    pick = lambda d: days.where(F.col("calendar_date") == F.lit(d)).first()
    assert pick("2024-01-07").week_of_year == 2
    assert pick("2000-12-31").week_of_year == 54
    assert pick("2024-02-29").is_leap_year == 1 and pick("2024-02-29").is_last_day_in_month == 1
    assert pick("2024-01-01").year_week == "202401" and pick("2024-05-05").year_quarter == "2024Q2"
    bad = days.where(
        (F.col("month_weekdays_completed") + F.col("month_weekdays_remaining") != F.col("weekdays_in_month"))
        | (F.col("quarter_weekdays_completed") + F.col("quarter_weekdays_remaining") != F.col("weekdays_in_quarter"))
        | (F.col("quarter_days_completed") + F.col("quarter_days_remaining") != F.col("days_in_quarter"))
        | (F.col("is_last_day_in_month") == 1) & (F.col("month_weekdays_remaining") != 0)
        | (F.col("is_last_day_in_quarter") == 1) & (F.col("quarter_weekdays_remaining") != 0)
        | F.col("is_holiday").isNotNull())
    assert bad.isEmpty()
    # A weekend opening the second month of a quarter has what is left of the quarter, not all of it.
    june = pick("2024-06-01")
    assert june.day_name == "Saturday" and june.quarter_weekdays_remaining == 20
    assert june.month_weekdays_remaining == june.weekdays_in_month == 20


def test_quarters_are_clipped_to_the_range(spark):
    days = cal.calendar(spark, "2024-02-10", "2024-05-20")
    first = days.orderBy("calendar_date").first()
    assert first.first_day_in_quarter == date(2024, 2, 10) and first.days_in_quarter == 51


def test_holidays(spark, make):
    days = cal.calendar(spark, "2024-01-01", "2024-01-03", make([(date(2024, 1, 1),)], "calendar_date date"))
    assert [r.is_holiday for r in days.orderBy("calendar_date").collect()] == [1, 0, 0]


def test_slots(spark):
    slots = cal.time_slots(spark, "2012-01-01", "2017-12-31")
    assert slots.agg(F.count("*"), F.min("slot_id"), F.max("slot_id")).first() == (210_337, 1, 210_337)
    assert slots.where("slot_id = 97").first() == (97, datetime(2012, 1, 2), 2)


def test_spine_of_nothing(make):
    assert cal.spine_over(make([], "t timestamp_ntz"), "t").count() == 0
