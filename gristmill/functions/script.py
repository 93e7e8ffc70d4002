"""Strings, numbers and regular expressions with the semantics of ECMAScript, as Spark columns.

A value that isn't a number is NULL here, never NaN: Spark sorts NaN above all
numbers, while a comparison with NaN must be false.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: White space beyond ASCII (fixed values); Java's own \\s is ASCII only.
WIDE_SPACE = (0xA0, 0x1680, *range(0x2000, 0x200B), 0x2028, 0x2029, 0x202F, 0x205F, 0x3000, 0xFEFF)
SPACE = r"\s\x{A0}\x{1680}\x{2000}-\x{200A}\x{2028}\x{2029}\x{202F}\x{205F}\x{3000}\x{FEFF}"
LINE_END = r"\n\r\x{2028}\x{2029}"
EMAIL = r"^[^\s@]+@[^\s@]+\.[^\s@]+$"


def let(value: Column, body) -> Column:
    """``body(value)`` with the value in the plan once, however often the body uses it."""
    return F.element_at(F.transform(F.array(value), body), 1)


def trimmed(v: Column) -> Column:
    """Without white space of any kind at the ends."""
    return F.regexp_replace(v, rf"^[{SPACE}]+|[{SPACE}]+\z", "")


def utf16_length(v: Column) -> Column:
    """Length in UTF-16 units."""
    return F.octet_length(F.encode(v, "UTF-16BE")) / F.lit(2)


def _digits(v: Column, base: int, lead: str, members: str) -> Column:
    return F.conv(F.regexp_extract(v, rf"^[{SPACE}]*0[{lead}]([{members}]+)[{SPACE}]*\z", 1), base, 10).try_cast("double")


def number(v: Column) -> Column:
    """The unary plus: decimals with sign and exponent, Infinity, 0x/0b/0o; blank text is 0; else NULL.

    Most numbers begin and end with a digit, sign or point and take the cast at
    once (an x would let it read hexadecimal fractions); the rest, and what the
    cast rejects, is looked at by regular expressions.
    """
    decimal = rf"^[{SPACE}]*([+-]?(?:Infinity|(?:\d+\.?\d*|\.\d+)(?:[eE][+-]?\d+)?))[{SPACE}]*\z"
    plain = F.ascii(v).between(43, 57) & F.substring(v, -1, 1).between(".", "9") & ~F.contains(v, F.lit("x")) & ~F.contains(v, F.lit("X"))

    def odd(x: Column) -> Column:
        return F.coalesce(
            F.regexp_extract(x, decimal, 1).try_cast("double"),
            F.when(x.rlike(rf"^[{SPACE}]*\z"), 0.0),
            _digits(x, 16, "xX", "0-9a-fA-F"), _digits(x, 2, "bB", "01"), _digits(x, 8, "oO", "0-7"),
        )

    # the rare branch stays out of the generated method, which the JVM compiles only if it is short
    return F.coalesce(F.when(plain, v.try_cast("double")), F.when(v == "", 0.0), let(v, odd))


def is_integer(x: Column) -> Column:
    """Finite and whole (NULL counts as not)."""
    return F.coalesce((F.floor(x).cast("double") == x) & (F.abs(x) < float("inf")), F.lit(False)) | F.coalesce((F.abs(x) >= 2.0**53) & (F.abs(x) < float("inf")), F.lit(False))


def leading_number(v: Column) -> Column:
    """The longest leading decimal number, as parseFloat reads it; NULL if there is none."""
    return F.regexp_extract(trimmed(v), r"^([+-]?(?:Infinity|(?:\d+\.?\d*|\.\d+)(?:[eE][+-]?\d+)?))", 1).try_cast("double")


def number_string(x: Column) -> Column:
    """A double as text: 1234, 12345678.9, 1e+21 (not 1234.0, 1.23456789E7, 1.0E21)."""
    return let(x, _number_string)


def _number_string(x: Column) -> Column:
    s = F.abs(x).cast("string")
    mantissa = F.substring_index(s, "E", 1)
    has_exponent = s.contains("E")
    whole, part = F.substring_index(mantissa, ".", 1), F.regexp_replace(F.substring_index(mantissa, ".", -1), r"0+\z", "")
    e = F.substring_index(s, "E", -1).try_cast("int")
    digits = F.concat(whole, part)
    n = F.length(digits)
    big = F.when(n <= e + 1, F.rpad(digits, e + 1, "0")).otherwise(F.concat(F.substring(digits, F.lit(1), e + 1), F.lit("."), F.substring(digits, e + 2, n)))
    small = F.concat(F.lit("0."), F.repeat(F.lit("0"), -e - 1), digits)
    tail = F.when(n > 1, F.concat(F.lit("."), F.substring(digits, F.lit(2), n))).otherwise("")
    scientific = F.concat(F.substring(digits, 1, 1), tail, F.lit("e"), F.when(e > 0, "+").otherwise(""), e.cast("string"))
    plain = F.when(part == "", whole).otherwise(F.concat(whole, F.lit("."), part))
    body = F.when(F.abs(x) == float("inf"), F.lit("Infinity")).when(~has_exponent, plain).when((e >= 0) & (e < 21), big).when((e < 0) & (e >= -6), small).otherwise(scientific)
    body = F.when(~has_exponent & (x != 0) & (F.abs(x) < 1e-6), scientific).otherwise(body)
    return F.when(x == 0, F.lit("0")).otherwise(F.concat(F.when(x < 0, "-").otherwise(""), body))


def regex(source: str, flags: str = "") -> str:
    """An ECMAScript expression as a Java one; raises ValueError for what can't be translated."""
    dot_all, lines = "s" in flags, "m" in flags
    word = "[A-Za-z0-9_]"
    out, i, inside = [], 0, False
    if unknown := set(flags) - set("gimsuyd"):
        raise ValueError(f"flag {''.join(sorted(unknown))}")
    while i < len(source):
        c = source[i]
        if c == "\\":
            d = source[i + 1 : i + 2]
            if not d:
                raise ValueError("a lone backslash at the end")
            step = 2
            if d == "s":
                out.append(SPACE if inside else f"[{SPACE}]")
            elif d == "S":
                out.append(f"[^{SPACE}]")
            elif d == "b" and not inside:
                out.append(f"(?:(?<={word})(?!{word})|(?<!{word})(?={word}))")
            elif d == "b":
                out.append(r"\x08")
            elif d == "B" and not inside:
                out.append(f"(?:(?<={word})(?={word})|(?<!{word})(?!{word}))")
            elif d == "0":
                out.append(r"\x00")
            elif d == "v":
                out.append(r"\x0B")
            elif d == "u" and source[i + 2 : i + 3] == "{":
                end = source.index("}", i)
                out.append(r"\x{" + source[i + 3 : end] + "}")
                step = end + 1 - i
            elif d in "dDwWnrtfxupPkc123456789":
                out.append(c + d)
            elif d.isalpha():
                out.append(d)
            else:
                out.append("\\" + d)
            i += step
            continue
        if inside:
            if c == "]":
                inside = False
                out.append("]")
            else:
                out.append("\\" + c if c in "[&" else c)
        elif c == "[":
            if source.startswith("[^]", i):
                out.append(r"[\s\S]")
                i += 2
            elif source.startswith("[]", i):
                out.append(r"(?!)")
                i += 1
            else:
                inside = True
                out.append("[")
                if source[i + 1 : i + 2] == "^":
                    out.append("^")
                    i += 1
        elif c == ".":
            out.append(r"[\s\S]" if dot_all else f"[^{LINE_END}]")
        elif c == "^":
            out.append(f"(?<![^{LINE_END}])" if lines else r"\A")
        elif c == "$":
            out.append(f"(?![^{LINE_END}])" if lines else r"\z")
        else:
            out.append(c)
        i += 1
    if inside:
        raise ValueError("a character class isn't closed")
    return ("(?iu)" if "i" in flags else "") + (r"\A(?:" + "".join(out) + ")" if "y" in flags else "".join(out))


def matches(v: Column, source: str, flags: str = "") -> Column:
    """Whether the expression is found anywhere in the value."""
    return v.rlike(regex(source, flags))
