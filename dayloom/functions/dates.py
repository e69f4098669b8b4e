"""Date helpers. ``as_of`` is always an argument so that results can be repeated."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F

from dayloom.functions.measures import col


def iso_stamp_to_date(text: Column | str) -> Column:
    return F.to_date(F.try_to_timestamp(col(text)))


def day_first_date(text: Column | str) -> Column:
    return F.to_date(F.try_to_timestamp(col(text), F.lit("dd/MM/yyyy")))


def partial_date(text: Column | str) -> Column:
    """ISO date whose day may be missing; a missing day is the first of the month."""
    t = F.trim(col(text))
    return F.coalesce(
        F.to_date(F.try_to_timestamp(t, F.lit("yyyy-MM-dd"))),
        F.to_date(F.try_to_timestamp(t, F.lit("yyyy-MM"))),
    )


def month_start(c: Column | str) -> Column:
    return F.trunc(col(c), "MM").cast("date")


def year_start(c: Column | str) -> Column:
    return F.trunc(col(c), "YEAR").cast("date")


def month_ceiling(c: Column | str) -> Column:
    """First day of the next month, also for a date on the first."""
    return F.add_months(month_start(c), 1)


def months_before(c: Column | str, months: int) -> Column:
    return F.add_months(col(c), -months)


def weeks_before(c: Column | str, weeks: int) -> Column:
    return F.date_sub(col(c), 7 * weeks)


def two_year_window(as_of: Column | str) -> tuple[Column, Column]:
    return months_before(as_of, 24), col(as_of)


def five_year_window(as_of: Column | str) -> tuple[Column, Column]:
    """From the start of the year five years back."""
    return months_before(year_start(as_of), 60), col(as_of)


def iso_weekday(c: Column | str) -> Column:
    """Monday is 1, Sunday is 7."""
    return F.weekday(col(c)) + 1


def is_weekend(c: Column | str) -> Column:
    return iso_weekday(c).isin(6, 7)


def non_working_flag(date: Column | str, holiday: Column | str) -> Column:
    """1.0 on a holiday or at the weekend, else 0.0; a missing holiday flag is no holiday."""
    return (F.coalesce(col(holiday), F.lit(False)) | is_weekend(date)).cast("double")


def outside_range(date: Column | str, start: str, stop: str) -> Column:
    """Keep everything but the open interval between two dates."""
    d = col(date)
    return (d <= F.lit(start).cast("date")) | (d >= F.lit(stop).cast("date"))


def in_days(date: Column | str, days: Sequence[str]) -> Column:
    return col(date).isin(*[F.lit(d).cast("date") for d in days])
