"""Calendar arithmetic as columns."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def is_leap_year(year: Column) -> Column:
    return ((year % 4 == 0) & (year % 100 != 0)) | (year % 400 == 0)


def days_in_month(month: Column, year: Column) -> Column:
    """0 for a month outside 1 ... 12."""
    return (
        F.when(month.isin(4, 6, 9, 11), 30)
        .when(month == 2, F.when(is_leap_year(year), 29).otherwise(28))
        .when(month.between(1, 12), 31)
        .otherwise(0)
    )


def fields(v: Column, fmt) -> tuple[Column, Column, Column]:
    """Day, month and year of a text that the format matches."""
    return tuple(F.substring(v, at, n).try_cast("int") if at else F.lit(None).cast("int") for at, n in ((fmt.day, 2), (fmt.month, 2), (fmt.year, 4)))


def has_format(v: Column, fmt) -> Column:
    """Whether the whole text has the format: its fields have fixed widths, so digits turned into 0 give its shape."""
    return v.rlike(fmt.regex) if fmt.regex else F.translate(v, "123456789", "0" * 9) == fmt.shape


def fault(day: Column, month: Column, year: Column, year_code: int, month_code: int, day_code: int) -> Column:
    """0, or the code of the first part out of range: year 1900-2100, then month, then day."""
    return (
        F.when(~year.between(1900, 2100), year_code)
        .when(~month.between(1, 12), month_code)
        .when((day < 1) | (day > days_in_month(month, year)), day_code)
        .otherwise(0)
    )
