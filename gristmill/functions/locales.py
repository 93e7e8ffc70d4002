"""The registry of locales, and their date formats as expressions."""

from __future__ import annotations

import re
from dataclasses import dataclass


@dataclass(frozen=True)
class Locale:
    id: str
    date_formats: tuple[str, ...]
    thousands: str
    decimal: str
    symbols: tuple[str, ...]
    country_code: str
    phone_digits: int
    true_values: tuple[str, ...]
    false_values: tuple[str, ...]
    currency_position: str = "both"
    phone_patterns: tuple[str, ...] = ()


#: Fixed values of the built-in locales.
TR = Locale("tr", ("DD.MM.YYYY", "DD/MM/YYYY"), ".", ",", ("₺", "TL", "TRY"), "+90", 12, ("evet", "doğru", "e", "1", "true", "yes"), ("hayır", "yanlış", "h", "0", "false", "no"), "both")
EN = Locale("en", ("MM/DD/YYYY", "YYYY-MM-DD"), ",", ".", ("$", "USD"), "+1", 11, ("true", "yes", "y", "1"), ("false", "no", "n", "0"), "prefix")
EN_GB = Locale("en-GB", ("DD/MM/YYYY", "YYYY-MM-DD"), ",", ".", ("£", "GBP"), "+44", 12, ("true", "yes", "y", "1"), ("false", "no", "n", "0"), "prefix")
DE = Locale("de", ("DD.MM.YYYY", "YYYY-MM-DD"), ".", ",", ("€", "EUR"), "+49", 13, ("ja", "wahr", "j", "1", "true", "yes"), ("nein", "falsch", "n", "0", "false", "no"), "both")
FR = Locale("fr", ("DD/MM/YYYY", "YYYY-MM-DD"), " ", ",", ("€", "EUR"), "+33", 11, ("oui", "vrai", "o", "1", "true", "yes"), ("non", "faux", "n", "0", "false", "no"), "suffix")

_registry = {"tr": TR, "en": EN, "en-US": EN, "en-GB": EN_GB, "de": DE, "fr": FR}


def get_locale(locale_id: str) -> Locale:
    """The locale, or English if it isn't registered."""
    return _registry.get(locale_id, EN)


def has_locale(locale_id: str) -> bool:
    return locale_id in _registry


def register_locale(locale: Locale) -> None:
    """Add a locale or replace one; plans built later see it."""
    _registry[locale.id] = locale


def locale_ids() -> list[str]:
    return list(_registry)


@dataclass(frozen=True)
class DateFormat:
    """The shape of a whole text, digits as 0, with the places (from 1, 0 if absent) of day, month and year.

    Where a format itself has digits the shape can't tell; then ``regex``, a Java expression, does.
    """

    shape: str
    regex: str | None
    day: int
    month: int
    year: int


def date_format(text: str) -> DateFormat:
    """Only DD, MM and YYYY are fields; anything else stands for itself."""
    places, shape, parts = {}, "", []
    for piece in re.split("(DD|MM|YYYY)", text):
        if piece in ("DD", "MM", "YYYY") and piece not in places:
            places[piece] = len(shape) + 1
            shape += "0" * len(piece)
            parts.append(rf"\d{{{len(piece)}}}")
        else:
            shape += piece
            parts.append(re.escape(piece))
    plain = not re.search("[0-9]", re.sub("DD|MM|YYYY", "", text))
    return DateFormat(shape, None if plain else "^" + "".join(parts) + r"\z", places.get("DD", 0), places.get("MM", 0), places.get("YYYY", 0))


def date_formats(locale_id: str) -> list[DateFormat]:
    return [date_format(x) for x in get_locale(locale_id).date_formats]
