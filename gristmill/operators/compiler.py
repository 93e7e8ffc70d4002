"""Compile columns of a schema into one CASE expression each.

A cell's code is the first failure in the order required, type, other rules as
declared; codes are numbered per column in that order. Customs and repeated
values come after and have codes of their own.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass, field

from pyspark.sql import Column
from pyspark.sql import functions as F

from ..functions import script, strict
from ..schema import CODE_OF_NAME, LOCALE_TYPES, TYPE_MESSAGES, ColumnDef, Rule, Schema, rule_message

CUSTOM_BASE, UNIQUE_CODE = 201, 251


@dataclass(frozen=True)
class CompiledColumn:
    """``fn`` maps a value column to its internal code; ``errors`` has (rule name, message) of each code.

    ``number`` gives the value as the checks compare it, if they do; passed to
    ``fn`` as a column of its own it is computed once, whatever refers to it.
    """

    name: str
    fn: Callable[..., Column]
    errors: dict[int, tuple[str, str]]
    required: bool
    unique: bool
    customs: tuple[Rule, ...] = ()
    locale: str | None = None
    number: Callable[[Column], Column] | None = None


@dataclass(frozen=True)
class CompiledSchema:
    columns: tuple[CompiledColumn, ...]
    locale: str | None = None
    names: tuple[str, ...] = field(default=())

    @property
    def count(self) -> int:
        return len(self.columns)


def plain_type_fault(kind: str, v: Column, n: Column | None) -> Column | None:
    """Whether a non-empty value fails its type without a locale; None for types that never do."""
    match kind:
        case "number":
            return n.isNull()
        case "integer":
            return ~script.is_integer(n)
        case "boolean":
            return ~F.lower(v).isin("true", "false", "1", "0", "yes", "no")
        case "date":
            return ~v.rlike(r"\A[0-9]{4}-[0-9]{2}-[0-9]{2}\z")
        case "phone":
            return ~F.length(F.regexp_replace(v, "[^0-9]", "")).between(10, 15)
        case "currency":
            kept = F.regexp_replace(v, "[^0-9.-]", "")
            return ~kept.rlike("[0-9]") | script.number(kept).isNull()
    return None


def rule_fault(rule: Rule, v: Column, n: Column | None) -> Column:
    """Whether a non-empty value fails; what isn't a number fails neither min nor max."""
    match rule.rule:
        case "min":
            return F.coalesce(n < F.lit(float(rule.value)), F.lit(False))
        case "max":
            return F.coalesce(n > F.lit(float(rule.value)), F.lit(False))
        case "minLength":
            return script.utf16_length(v) < rule.value
        case "maxLength":
            return script.utf16_length(v) > rule.value
        case "pattern":
            return ~script.matches(v, rule.pattern, rule.flags)
        case "enum":
            return ~v.isin(*rule.values) if rule.values else F.lit(True)
        case "email":
            return ~script.matches(v, script.EMAIL)
    raise ValueError(rule.rule)


def compile_column(column: ColumnDef, name: str, default_locale: str | None = None) -> CompiledColumn:
    locale = column.locale if column.locale is not None else default_locale
    local = locale is not None and column.type in LOCALE_TYPES
    needed = next((r for r in column.rules if r.rule == "required"), None)
    errors: dict[int, tuple[str, str]] = {}
    if needed:
        errors[1] = "required", rule_message(needed)
    type_code = len(errors) + 1
    if local:
        for i, message in enumerate(strict.locale_check(column.type, F.lit(""), locale).messages):
            errors[type_code + i] = "type", message
    elif column.type in TYPE_MESSAGES:
        errors[type_code] = "type", TYPE_MESSAGES[column.type]
    later = [r for r in column.rules if r.rule not in ("required", "unique", "custom")]
    first = len(errors) + 1
    for i, r in enumerate(later):
        errors[first + i] = r.rule, rule_message(r)
    if len(errors) >= CUSTOM_BASE:
        raise ValueError(f"{name}: more than {CUSTOM_BASE - 1} codes")

    def number(v: Column) -> Column:
        if local and column.type == "number":
            return strict.number_value(v, locale)
        return script.number(strict.locale_check(column.type, v, locale).value if local and column.type == "currency" else v)

    compares = any(r.rule in ("min", "max") for r in later) or not local and column.type in ("number", "integer")

    def fn(v: Column, n: Column | None = None) -> Column:
        n = number(v) if n is None and compares else n
        chain = F.when(v == "", F.lit(1 if needed else 0))
        if local:
            check = strict.locale_check(column.type, v, locale)
            for bad, offset in check.faults:
                chain = chain.when(bad, F.lit(type_code + offset))
            if check.value is not None:
                v = check.value
        elif (bad := plain_type_fault(column.type, v, n)) is not None:
            chain = chain.when(bad, F.lit(type_code))
        for i, r in enumerate(later):
            chain = chain.when(rule_fault(r, v, n), F.lit(first + i))
        return chain.otherwise(F.lit(0)).cast("smallint")

    return CompiledColumn(name, fn, errors, needed is not None, any(r.rule == "unique" for r in column.rules), tuple(r for r in column.rules if r.rule == "custom"), locale, number if compares else None)


def compile_schema(schema: Schema) -> CompiledSchema:
    return CompiledSchema(tuple(compile_column(c, n, schema.locale) for n, c in schema.columns.items()), schema.locale, tuple(schema.columns))


def public_code(column: CompiledColumn, internal: int) -> int:
    if internal == 0:
        return 0
    if internal == UNIQUE_CODE:
        return CODE_OF_NAME["unique"]
    if internal >= CUSTOM_BASE:
        return CODE_OF_NAME["custom"]
    return CODE_OF_NAME.get(column.errors.get(internal, ("",))[0], 0)
