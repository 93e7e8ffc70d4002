"""Scalar functions against hand-worked values and slow Python models."""

import math

import pytest
from pyspark.sql import functions as F

from gristmill.functions import dates, liberal, script, similarity
from gristmill.functions.locales import Locale, get_locale, has_locale, locale_ids, register_locale


def over(spark, values, fn):
    df = spark.createDataFrame([(v,) for v in values], "v string")
    return [r.x for r in df.select(fn(F.col("v")).alias("x")).collect()]


def test_number_follows_unary_plus(spark):
    cases = {"": 0.0, "  ": 0.0, "12": 12.0, "1e3": 1000.0, ".5": 0.5, "5.": 5.0, "0x1F": 31.0, "0b11": 3.0, "0o17": 15.0, "1d": None, "inf": None, "Infinity": math.inf, "-Infinity": -math.inf,
             "nan": None, "+5": 5.0, " 7 ": 7.0, "1_0": None, "--5": None, "1.2.3": None, " 5﻿": 5.0, "-0x1": None, ".": None, "12\n": 12.0, "e5": None, "1e400": math.inf}
    assert over(spark, list(cases), script.number) == list(cases.values())


def test_number_text(spark):
    values = {1234.0: "1234", 12345678.9: "12345678.9", 1e21: "1e+21", 1.5e-7: "1.5e-7", 1e-6: "0.000001", 0.1: "0.1", -5.0: "-5", 0.0: "0", 1e300: "1e+300", 0.00001234: "0.00001234"}
    df = spark.createDataFrame([(x,) for x in values], "x double")
    assert [r.s for r in df.select(script.number_string(F.col("x")).alias("s")).collect()] == list(values.values())


@pytest.mark.parametrize("source,flags,text,found", [
    (r"^\d{2}$", "", "12", True), (r"^\d{2}$", "", "12\n", False), (r"^a$", "m", "b\na\nc", True), ("[^]x", "", "\nx", True), ("a.b", "", "a\nb", False), ("a.b", "s", "a\nb", True),
    (r"\s", "", " ", True), (r"^\S+$", "", "a b", False), ("ABC", "i", "xabcx", True), (r"[[&]", "", "[", True), (r"\bcat\b", "", "a cat.", True), ("^b", "y", "ab", False),
])
def test_regular_expressions(spark, source, flags, text, found):
    assert over(spark, [text], lambda v: script.matches(v, source, flags)) == [found]


def test_what_cannot_be_translated_is_rejected():
    for source in ("[a", "a\\"):
        with pytest.raises(ValueError):
            script.regex(source)


def test_length_counts_utf16_units(spark):
    assert over(spark, ["", "ab", "é", "😀"], lambda v: script.utf16_length(v).cast("int")) == [0, 2, 1, 2]


def test_liberal_numbers(spark):
    tr = {"1.234,56": 1234.56, "1234,56": 1234.56, "1.234": 1234.0, "-1.234,56": -1234.56, "abc": None, "12abc": 12.0, "1.2.3": 123.0, "": None, " 5": 5.0}
    assert over(spark, list(tr), lambda v: liberal.parse_number(v, "tr")) == list(tr.values())
    assert over(spark, ["12abc", "abc", ""], lambda v: liberal.validate_number(v, "tr")) == [0, 1, 0]
    assert over(spark, ["1.234.567,5", "--5"], lambda v: liberal.normalize_number(v, "tr")) == ["1234567.5", "5"]


def test_liberal_dates(spark):
    values = {"29.02.2024": "2024-02-29", "29.02.2023": None, "31.04.2024": None, "01/05/1999": "1999-05-01", "2024-01-01": None, "1.1.2024": None, "01.01.1899": None}
    assert over(spark, list(values), lambda v: liberal.normalize_date(v, "tr")) == list(values.values())
    assert over(spark, ["", "x", "01.13.2024", "31.04.2024", "01.01.1800"], lambda v: liberal.validate_date(v, "tr")) == [0, 1, 2, 3, 4]


def test_liberal_currency_phone_boolean(spark):
    assert over(spark, ["₺1.234,56", "1.234,56 TL", "TRY 5", "₺", ""], lambda v: liberal.normalize_currency(v, "tr")) == ["1234.56", "1234.56", "5", None, None]
    assert over(spark, ["₺", "", "₺5", "₺TL100"], lambda v: liberal.validate_currency(v, "tr")) == [1, 0, 0, 0]
    assert over(spark, ["+90 532 123 45 67", "05321234567", "532 123 45 67", "123", "+1 555 123 4567", ""], lambda v: liberal.normalize_phone(v, "tr")) == ["+905321234567"] * 3 + [None] * 3
    assert over(spark, ["EVET", "doğru", "h", "HAYIR", "belki", " yes "], lambda v: liberal.parse_boolean(v, "tr")) == [True, True, False, None, None, True]


def test_calendar(spark):
    df = spark.createDataFrame([(2, 2000), (2, 1900), (4, 2021), (13, 2021), (12, 2021)], "m int, y int")
    assert [r.x for r in df.select(dates.days_in_month(F.col("m"), F.col("y")).alias("x")).collect()] == [29, 28, 30, 0, 31]


def test_registry():
    assert get_locale("xx").id == "en" and not has_locale("xx") and "en-US" in locale_ids()
    own = Locale("custom-test", ("YYYY-MM-DD",), ",", ".", ("TEST",), "+99", 10, ("yep",), ("nope",))
    register_locale(own)
    assert get_locale("custom-test") is own


def test_similarity_scalars():
    assert [similarity.levenshtein(*p) for p in (("hello", "hallo"), ("güneş", "gunes"), ("email", "email_address"), ("", "ab"), ("😀", ""))] == [1, 2, 8, 2, 2]
    assert similarity.normalize(" E-Mail_Address ") == "e mail address" and similarity.normalize("_a") == " a" and similarity.normalize("ISIK") == "isik"
    assert similarity.compute_similarity("first name", "name first") == 1.0
    assert similarity.compute_best_match("e-mail", "email", ["E_Mail"]) == (1.0, "E_Mail", True)
    assert not similarity.contains_match("ab", "abc") and similarity.common_prefix_length("price", "print") == 3


def test_similarity_columns_agree_with_scalars(spark):
    pairs = [("Unit-Price", "unit price"), ("createdAt", "created_at"), ("Product Nam", "name"), ("a b c", "c b a"), ("x", ""), ("telephone", "phone"), ("qty", "quantity")]
    df = spark.createDataFrame(pairs, "a string, b string")
    got = [r.x for r in df.select(similarity.similarity_column(F.col("a"), F.col("b")).alias("x")).collect()]
    assert got == pytest.approx([similarity.compute_similarity(a, b) for a, b in pairs])
