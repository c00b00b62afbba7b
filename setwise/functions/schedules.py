"""Recurrence rules to sentences."""

from __future__ import annotations

from pyspark.sql import Column, functions as F

from setwise.functions.measures import code_label, flag_names
from setwise.functions.times import col, int_div, two_digits

# The words the sentences are made of.
WEEKDAYS = ("Sun", "Mon", "Tue", "Wed", "Thu", "Fri", "Sat")
MONTHS = ("Jan", "Feb", "Mar", "Apr", "May", "Jun", "Jul", "Aug", "Sep", "Oct", "Nov", "Dec")
MONTH_DAYS = tuple(str(d) for d in range(1, 32))
WEEK_ORDINALS = {1: "first", 2: "second", 3: "third", 4: "fourth", 5: "last"}
ALL_MONTHS = 4095
JOB_OCCURS = {
    1: "Once", 4: "Daily", 8: "Weekly", 16: "Monthly", 32: "Monthly relative",
    64: "At service start", 128: "When the processor is idle",
}
JOB_ORDINALS = {1: "First", 2: "Second", 4: "Third", 8: "Fourth", 16: "Last"}
JOB_DAYS = {
    1: "Sunday", 2: "Monday", 3: "Tuesday", 4: "Wednesday", 5: "Thursday", 6: "Friday", 7: "Saturday",
    8: "Day", 9: "Weekday", 10: "Weekend Day",
}
SUBDAY_UNITS = {2: "Second(s)", 4: "Minute(s)", 8: "Hour(s)"}


def us_date(ts: Column | str) -> Column:
    return F.date_format(col(ts), "MM/dd/yyyy")


def clock12(ts: Column | str) -> Column:
    """``h:mm AM`` with noon and midnight as 12."""
    t = col(ts)
    hour = (F.hour(t) + 11) % 12 + 1
    half = F.when(F.hour(t) >= 12, F.lit(" PM")).otherwise(F.lit(" AM"))
    return F.concat(hour.cast("string"), F.lit(":"), two_digits(F.minute(t)), half)


def schedule_text(
    kind: Column | str, start: Column | str, end: Column | str, minutes: Column | str, days: Column | str,
    weeks: Column | str, weekday_mask: Column | str, month_day_mask: Column | str, month_mask: Column | str,
    month_week: Column | str,
) -> Column:
    """One sentence for a report schedule of recurrence ``kind`` 1 to 6.

    1 once, 2 every n minutes, 3 every n days, 4 weekdays every n weeks,
    5 days of the month, 6 weekdays of the nth week of the month.
    """
    starts, ends = col(start), col(end)
    text = lambda x: col(x).cast("string")
    ending = F.when(ends.isNotNull(), F.concat(F.lit(" and ending "), us_date(ends))).otherwise(F.lit(""))
    span = F.concat(F.lit(" starting "), us_date(starts), ending)
    at = F.concat(F.lit("At "), clock12(starts))
    weekdays = flag_names(weekday_mask, WEEKDAYS)
    month_days = flag_names(month_day_mask, MONTH_DAYS, ",")
    months = F.when(col(month_mask) == ALL_MONTHS, F.lit("every month")).otherwise(flag_names(month_mask, MONTHS))
    months = F.concat(months, F.lit(", "))
    half = F.when(F.hour(starts) >= 12, F.lit("PM")).otherwise(F.lit("AM"))
    clock24 = F.concat(F.date_format(starts, "HH:mm"), F.lit(" "), half)
    every_days = F.when(col(days) == 1, F.lit("day, ")).otherwise(F.concat(text(days), F.lit(" days, ")))
    every_weeks = F.when(col(weeks) == 1, F.lit("week,")).otherwise(F.concat(text(weeks), F.lit(" weeks,")))
    k = col(kind)
    return (
        F.when(k == 1, F.concat(at, F.lit(" on "), us_date(starts)))
        .when(k == 2, F.concat(
            F.lit("Every "), int_div(minutes, 60).cast("string"), F.lit(" hour(s) and "),
            (col(minutes) % 60).cast("string"), F.lit(" minute(s), starting "), us_date(starts),
            F.lit(" at "), clock24, ending))
        .when(k == 3, F.concat(at, F.lit(" every "), every_days, F.ltrim(span)))
        .when(k == 4, F.concat(at, F.lit(" every "), weekdays, F.lit(" of every "), every_weeks, span))
        .when(k == 5, F.concat(at, F.lit(" on day(s) "), month_days, F.lit(" of "), months, F.ltrim(span)))
        .when(k == 6, F.concat(
            at, F.lit(" on the "), code_label(month_week, WEEK_ORDINALS), F.lit(" "), weekdays, F.lit(" of "),
            months, F.ltrim(span)))
        .otherwise(F.concat(F.lit("At "), clock24, span))
    )


def job_occurrence(
    freq_type: Column | str, interval: Column | str, relative: Column | str, factor: Column | str,
) -> Column:
    """How often a job schedule comes round."""
    k, every = col(freq_type), col(factor).cast("string")
    return (
        F.when(k == 1, F.lit("Once"))
        .when(k == 4, F.concat(F.lit("Every "), col(interval).cast("string"), F.lit(" day(s)")))
        .when(k == 8, F.concat(F.lit("Every "), every, F.lit(" week(s) on "), flag_names(interval, WEEKDAYS)))
        .when(k == 16, F.concat(
            F.lit("Day "), col(interval).cast("string"), F.lit(" of every "), every, F.lit(" month(s)")))
        .when(k == 32, F.concat(
            F.lit("The "), code_label(relative, JOB_ORDINALS), F.lit(" "), code_label(interval, JOB_DAYS),
            F.lit(" of every "), every, F.lit(" month(s)")))
        .otherwise(code_label(freq_type, JOB_OCCURS))
    )


def packed_time_text(t: Column | str) -> Column:
    """HHMMSS integer of any length to ``hh:mm:ss``."""
    digits = F.lpad(col(t).cast("string"), 6, "0")
    return F.concat_ws(":", *[F.substring(digits, i, 2) for i in (1, 3, 5)])


def job_frequency(subday_type: Column | str, every: Column | str, start_time: Column | str, end_time: Column | str) -> Column:
    """How a job schedule repeats within its day."""
    k = col(subday_type)
    repeat = F.concat(
        F.lit("Occurs every "), col(every).cast("string"), F.lit(" "), code_label(subday_type, SUBDAY_UNITS),
        F.lit(" starting at "), packed_time_text(start_time), F.lit(" ending at "), packed_time_text(end_time))
    return F.when(k == 1, F.concat(F.lit("Occurs once at "), packed_time_text(start_time))).otherwise(repeat)
