"""Schemas: columns with a logical type, rules, a locale and aliases; error codes.

Logical types are predicates over strings: physical columns stay strings, and
the empty string is the only missing value (nulls count as empty).
"""

from __future__ import annotations

from collections.abc import Callable, Mapping, Sequence
from dataclasses import dataclass, field
from typing import Any

#: Public error codes.
ERROR_CODES = {
    "VALID": 0, "REQUIRED": 1, "TYPE": 2, "MIN": 3, "MAX": 4, "PATTERN": 5, "ENUM": 6, "UNIQUE": 7,
    "MIN_LENGTH": 8, "MAX_LENGTH": 9, "EMAIL": 10, "CUSTOM": 11,
}
#: The public code of each rule name.
CODE_OF_NAME = {
    "required": 1, "type": 2, "min": 3, "max": 4, "pattern": 5, "enum": 6, "unique": 7,
    "minLength": 8, "maxLength": 9, "email": 10, "custom": 11,
}
TYPES = ("string", "number", "integer", "boolean", "date", "enum", "phone", "currency")
LOCALE_TYPES = ("date", "number", "currency", "phone", "boolean")


def error_code_from_name(name: str) -> int:
    """The public code of a rule name; 0 if there is none."""
    return CODE_OF_NAME.get(name, 0)


@dataclass(frozen=True)
class Rule:
    """One rule. ``value`` is a bound, ``values`` an enum's, ``pattern`` and ``flags`` a regular expression's.

    A custom rule has ``fn``: a Python predicate on the value, or with
    ``native`` a function from Column to a boolean Column.
    """

    rule: str
    value: float | int | None = None
    values: tuple[str, ...] = ()
    pattern: str = ""
    flags: str = ""
    fn: Callable | None = field(default=None, compare=False)
    message: str | None = None
    native: bool = False

    def __post_init__(self):
        if self.rule not in CODE_OF_NAME or self.rule == "type":
            raise ValueError(f"unknown rule {self.rule!r}")

    @staticmethod
    def of(given: Rule | Mapping[str, Any] | str) -> Rule:
        """A rule from itself, from a mapping such as {"rule": "min", "value": 0}, or from a bare name."""
        if isinstance(given, Rule):
            return given
        if isinstance(given, str):
            return Rule(given)
        own = dict(given)
        own["values"] = tuple(own.get("values", ()))
        return Rule(**own)


def required() -> Rule:
    return Rule("required")


def minimum(value: float) -> Rule:
    return Rule("min", value=value)


def maximum(value: float) -> Rule:
    return Rule("max", value=value)


def min_length(value: int) -> Rule:
    return Rule("minLength", value=value)


def max_length(value: int) -> Rule:
    return Rule("maxLength", value=value)


def pattern(source: str, flags: str = "") -> Rule:
    return Rule("pattern", pattern=source, flags=flags)


def enum(*values: str) -> Rule:
    return Rule("enum", values=values)


def email() -> Rule:
    return Rule("email")


def unique() -> Rule:
    return Rule("unique")


def custom(fn: Callable, message: str | None = None, native: bool = False) -> Rule:
    return Rule("custom", fn=fn, message=message, native=native)


@dataclass(frozen=True)
class ColumnDef:
    type: str = "string"
    rules: tuple[Rule, ...] = ()
    locale: str | None = None
    aliases: tuple[str, ...] = ()

    def __post_init__(self):
        if self.type not in TYPES:
            raise ValueError(f"unknown type {self.type!r}")
        object.__setattr__(self, "rules", tuple(Rule.of(r) for r in self.rules))
        object.__setattr__(self, "aliases", tuple(self.aliases))


@dataclass(frozen=True)
class Schema:
    """Columns in declared order. (Integer-like names keep that order too.)"""

    columns: Mapping[str, ColumnDef]
    locale: str | None = None

    def __post_init__(self):
        own = {k: c if isinstance(c, ColumnDef) else ColumnDef(**c) for k, c in self.columns.items()}
        object.__setattr__(self, "columns", own)

    @property
    def names(self) -> list[str]:
        return list(self.columns)


def number_text(x: float) -> str:
    """A bound as messages show it: 5, not 5.0."""
    return str(int(x)) if float(x).is_integer() else repr(float(x))


def rule_message(rule: Rule) -> str:
    """The text of a rule's failures."""
    match rule.rule:
        case "required":
            return "This field is required"
        case "min":
            return f"Value must be at least {number_text(rule.value)}"
        case "max":
            return f"Value must be at most {number_text(rule.value)}"
        case "minLength":
            return f"Length must be at least {number_text(rule.value)}"
        case "maxLength":
            return f"Length must be at most {number_text(rule.value)}"
        case "pattern":
            return "Value does not match the required pattern"
        case "enum":
            return "Value must be one of: " + ", ".join(rule.values)
        case "email":
            return "Invalid email address"
        case "unique":
            return "Value must be unique"
        case _:
            return rule.message or "Custom validation failed"


#: Messages of the type checks without a locale, and of a repeated value.
TYPE_MESSAGES = {
    "number": "Value must be a valid number",
    "integer": "Value must be a valid integer",
    "boolean": "Value must be true, false, yes, no, 1, or 0",
    "date": "Value must be a valid date (YYYY-MM-DD)",
    "phone": "Value must be a valid phone number",
    "currency": "Value must be a valid currency amount",
}
DUPLICATE = "Duplicate value"


def as_rules(given: Sequence) -> tuple[Rule, ...]:
    return tuple(Rule.of(r) for r in given)
