"""The type checks of validation that follow a locale.

Each gives failures as (condition, offset of the internal code) in the order
they are tested, the messages by offset, and the value that later rules see.
"""

from __future__ import annotations

import re
from dataclasses import dataclass, field

from pyspark.sql import Column
from pyspark.sql import functions as F

from . import dates
from .liberal import first_point, phone_faults
from .locales import date_formats, get_locale
from .script import SPACE, number, trimmed


@dataclass
class Check:
    faults: list[tuple[Column, int]]
    messages: list[str] = field(default_factory=list)
    value: Column | None = None


def number_regex(locale_id: str) -> str:
    """Plain digits, or digits grouped in threes; then an optional decimal part."""
    own = get_locale(locale_id)
    thousands = rf"[{SPACE}]" if own.thousands == " " else re.escape(own.thousands)
    decimal = rf"(?:{re.escape(own.decimal)}\d+)?"
    return rf"\A-?(?:\d{{1,3}}(?:{thousands}\d{{3}})*|\d+){decimal}\z"


def number_value(v: Column, locale_id: str) -> Column:
    """What min and max compare: thousands removed, the first decimal separator a point."""
    own = get_locale(locale_id)
    v = F.regexp_replace(v, f"[{SPACE}]", "") if own.thousands == " " else F.replace(v, F.lit(own.thousands), F.lit(""))
    return number(first_point(v, own.decimal))


def date_check(v: Column, locale_id: str) -> Check:
    """Every format that matches is checked; later formats after it too."""
    faults, matched = [], F.lit(False)
    for fmt in date_formats(locale_id):
        hit, (d, m, y) = dates.has_format(v, fmt), dates.fields(v, fmt)
        for bad, offset in ((~y.between(1900, 2100), 3), (~m.between(1, 12), 1), ((d < 1) | (d > dates.days_in_month(m, y)), 2)):
            faults.append((hit & bad, offset))
        matched = matched | hit
    return Check([*faults, (~matched, 0)], ["Invalid date format", "Invalid month (1-12)", "Invalid day for month", "Invalid year (1900-2100)"])


def number_check(v: Column, locale_id: str) -> Check:
    return Check([(~v.rlike(number_regex(locale_id)), 0)], ["Invalid number format"])


def currency_check(v: Column, locale_id: str) -> Check:
    """One symbol at most is stripped on each side; later rules see the rest."""
    symbols = "|".join(re.escape(s) for s in get_locale(locale_id).symbols)
    t = F.regexp_replace(trimmed(v), rf"\A(?:{symbols})[{SPACE}]*", "")
    t = trimmed(F.regexp_replace(t, rf"[{SPACE}]*(?:{symbols})\z", ""))
    return Check([(t == "", 0), (~t.rlike(number_regex(locale_id)), 1)], ["Invalid currency format", "Invalid number in currency"], F.when(v == "", v).otherwise(t))


def phone_check(v: Column, locale_id: str) -> Check:
    count, country = phone_faults(v, locale_id)
    return Check([(count, 0), (country, 1)], ["Invalid phone number", "Wrong country code"])


def boolean_check(v: Column, locale_id: str) -> Check:
    own = get_locale(locale_id)
    return Check([(~trimmed(F.lower(v)).isin(*own.true_values, *own.false_values), 0)], ["Invalid boolean value"])


CHECKS = {"date": date_check, "number": number_check, "currency": currency_check, "phone": phone_check, "boolean": boolean_check}


def locale_check(kind: str, v: Column, locale_id: str) -> Check:
    """The check of a locale-aware type; faults apply to non-empty values only."""
    return CHECKS[kind](v, locale_id)
