"""Dates: month starts, month numbers, parsing."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Accepted spellings of a month or day, in the order they are tried.
DATE_FORMATS = ("yyyy'M'MM", "yyyy-MM-dd", "yyyy-MM")


def month_start(c: Column) -> Column:
    return F.trunc(c.cast("date"), "MM")


def month_number(c: Column) -> Column:
    """Running month count, so that neighbouring months differ by one."""
    return F.year(c) * 12 + F.month(c) - 1


def parse_date(c: Column) -> Column:
    """``1960M01``, ``YYYY-MM-DD`` or ``YYYY-MM`` to a date; anything else to NULL."""
    return F.coalesce(*[F.try_to_timestamp(c, F.lit(f)).cast("date") for f in DATE_FORMATS])
