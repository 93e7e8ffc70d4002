"""Stand-alone parsing, checking and normalising of locale-formatted values.

These accept more than the checks of validation do (see ``strict``); both are
kept as they are. Each function takes a column and a locale id.
"""

from __future__ import annotations

import re

from pyspark.sql import Column
from pyspark.sql import functions as F

from . import dates
from .locales import date_formats, get_locale
from .script import SPACE, leading_number, let, number_string, trimmed


def parse_date(v: Column, locale_id: str) -> Column:
    """struct(day, month, year), or NULL; the first format that matches decides."""
    out = F.lit(None).cast("struct<day:int,month:int,year:int>")
    for fmt in reversed(date_formats(locale_id)):
        d, m, y = dates.fields(v, fmt)
        found = F.struct(d.alias("day"), m.alias("month"), y.alias("year"))
        out = F.when(dates.has_format(v, fmt), F.when(dates.fault(d, m, y, 4, 2, 3) == 0, found)).otherwise(out)
    return F.when(v != "", out)


def validate_date(v: Column, locale_id: str) -> Column:
    """0 valid (also empty), 1 format, 2 month, 3 day, 4 year."""
    out = F.lit(1)
    for fmt in reversed(date_formats(locale_id)):
        out = F.when(dates.has_format(v, fmt), dates.fault(*dates.fields(v, fmt), 4, 2, 3)).otherwise(out)
    return F.when(v == "", 0).otherwise(out)


def normalize_date(v: Column, locale_id: str) -> Column:
    """YYYY-MM-DD or NULL."""
    two = lambda x: F.lpad(x.cast("string"), 2, "0")
    return let(parse_date(v, locale_id), lambda d: F.concat(d["year"].cast("string"), F.lit("-"), two(d["month"]), F.lit("-"), two(d["day"])))


def _unpointed(v: Column, locale_id: str) -> Column:
    """Without thousands separators, the first decimal separator as a point."""
    own = get_locale(locale_id)
    if own.thousands:
        v = F.replace(v, F.lit(own.thousands), F.lit(""))
    return first_point(v, own.decimal)


def first_point(v: Column, decimal: str) -> Column:
    """The first decimal separator as a point."""
    return v if decimal == "." else F.regexp_replace(v, rf"\A([^{re.escape(decimal)}]*){re.escape(decimal)}", "$1.")


def parse_number(v: Column, locale_id: str) -> Column:
    """A double from the leading number (12abc is 12); NULL if there is none."""
    t = trimmed(v)
    x = leading_number(_unpointed(F.regexp_replace(t, r"\A-", ""), locale_id))
    return x * F.when(t.startswith("-"), -1.0).otherwise(1.0)


def validate_number(v: Column, locale_id: str) -> Column:
    """0 valid (also empty), 1 invalid."""
    return F.when((v == "") | parse_number(v, locale_id).isNotNull(), 0).otherwise(1)


def normalize_number(v: Column, locale_id: str) -> Column:
    return number_string(parse_number(v, locale_id))


def strip_currency(v: Column, locale_id: str) -> Column:
    """Without symbols: for each in turn, one at the start and one at the end."""
    t = trimmed(v)
    for symbol in map(re.escape, get_locale(locale_id).symbols):
        t = F.regexp_replace(t, rf"\A{symbol}[{SPACE}]*", "")
        t = F.regexp_replace(t, rf"[{SPACE}]*{symbol}\z", "")
    return t


def parse_currency(v: Column, locale_id: str) -> Column:
    return parse_number(strip_currency(v, locale_id), locale_id)


def validate_currency(v: Column, locale_id: str) -> Column:
    """0 valid (also empty), 1 invalid (also a symbol alone)."""
    stripped = strip_currency(v, locale_id)
    return F.when(v == "", 0).when(stripped == "", 1).otherwise(validate_number(stripped, locale_id))


def normalize_currency(v: Column, locale_id: str) -> Column:
    return number_string(parse_currency(v, locale_id))


def strip_phone(v: Column) -> Column:
    """Without white space, dashes, parentheses and dots."""
    return F.regexp_replace(v, rf"[{SPACE}\-().]", "")


def parse_phone(v: Column, locale_id: str) -> Column:
    """+ and digits: a leading + stays, a leading 0 becomes the country code."""
    t, code = strip_phone(v), "+" + get_locale(locale_id).country_code.replace("+", "", 1)
    rest = F.when(t.startswith("0"), F.substring(t, F.lit(2), F.length(t))).otherwise(t)
    return F.when(v == "", "").when(t.startswith("+"), t).otherwise(F.concat(F.lit(code), rest))


def phone_faults(v: Column, locale_id: str) -> tuple[Column, Column]:
    """Whether the number of digits is off, and whether another country's code leads."""
    own, t = get_locale(locale_id), strip_phone(v)
    digits = F.length(F.regexp_replace(t, "[^0-9]", ""))
    return ~digits.between(own.phone_digits - 2, own.phone_digits + 2), t.startswith("+") & ~t.startswith("".join(own.country_code.split()))


def validate_phone(v: Column, locale_id: str) -> Column:
    """0 valid (also empty), 1 invalid."""
    count, country = phone_faults(v, locale_id)
    return F.when((v != "") & (count | country), 1).otherwise(0)


def normalize_phone(v: Column, locale_id: str) -> Column:
    """E.164 or NULL."""
    return F.when((v != "") & (validate_phone(v, locale_id) == 0), parse_phone(v, locale_id))


def parse_boolean(v: Column, locale_id: str) -> Column:
    own, t = get_locale(locale_id), trimmed(F.lower(v))
    return F.when(v == "", F.lit(None).cast("boolean")).when(t.isin(*own.true_values), F.lit(True)).when(t.isin(*own.false_values), F.lit(False))


def validate_boolean(v: Column, locale_id: str) -> Column:
    """0 valid (also empty), 1 invalid."""
    return F.when((v == "") | parse_boolean(v, locale_id).isNotNull(), 0).otherwise(1)


def normalize_boolean(v: Column, locale_id: str) -> Column:
    return parse_boolean(v, locale_id).cast("string")
