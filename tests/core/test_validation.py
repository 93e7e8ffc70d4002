"""Validation: order of failures, customs and repeated values, statistics, the error matrix."""

import pytest
from pyspark.sql import functions as F

import gristmill as g
from gristmill.operators.validation import ErrorMatrix, bitmap_bytes, code_map_bytes


def frame(spark, rows, names):
    return spark.createDataFrame([(i, *r) for i, r in enumerate(rows)], "_row long" + "".join(f", `{n}` string" for n in names))


def found(v):
    return [(r.row, r.col, r.value, r.code) for r in v.get_errors(10_000).collect()]


def check(spark, values, column, locale=None):
    return [(r[0], r[3]) for r in found(g.validate(frame(spark, [(x,) for x in values], ["v"]), g.Schema({"v": column}, locale)))]


def test_csv_with_errors(spark):
    rows = [("Ali", "", "30", "active"), ("Veli", "v@x.y", "-5", "active"), ("Can", "c@x.y", "3", "unknown"), ("Ece", "e@x.y", "4", "inactive"), ("Su", "s@x.y", "nineteen", "pending")]
    schema = g.Schema({"name": g.ColumnDef("string", [g.required()]), "email": g.ColumnDef("string", [g.required(), g.email()]), "age": g.ColumnDef("integer", [g.minimum(0)]), "status": g.ColumnDef("enum", [g.enum("active", "inactive", "pending")])})
    assert found(g.validate(frame(spark, rows, schema.names), schema)) == [(0, 1, "", 1), (1, 2, "-5", 3), (2, 3, "unknown", 6), (4, 2, "nineteen", 2)]


def test_empty_passes_all_but_required(spark):
    for rule in (g.minimum(5), g.min_length(3), g.pattern("x"), g.enum("a"), g.email()):
        assert check(spark, [""], g.ColumnDef("string", [rule])) == []
    assert check(spark, ["", " "], g.ColumnDef("string", [g.required()])) == [(0, 1)]


def test_required_comes_first_and_not_a_number_passes_bounds(spark):
    assert check(spark, ["", "x", "200"], g.ColumnDef("string", [g.maximum(100), g.required()])) == [(0, 1), (2, 4)]


def test_nulls_missing_and_clashing_columns(spark):
    df = spark.createDataFrame([(0, None, "c0")], "_row long, a string, c0 string")
    schema = g.Schema({"a": g.ColumnDef("string", [g.required()]), "b": g.ColumnDef("string", [g.required()])})
    assert found(g.validate(df, schema)) == [(0, 0, "", 1), (0, 1, "", 1)]
    assert g.validate(df.limit(0), schema).stats().first().total_rows == 0


def test_unique_and_custom_on_one_cell(spark):
    schema = g.Schema({"id": g.ColumnDef("string", [g.unique(), g.custom(lambda v: v != "b", "no b")])})
    v = g.validate(frame(spark, [("a",), ("b",), ("a",), ("b",), ("",), ("",)], ["id"]), schema)
    assert found(v) == [(1, 0, "b", 11), (2, 0, "a", 7), (3, 0, "b", 7)]
    assert v.summary() == {"valid": False, "total_rows": 6, "valid_rows": 3, "error_rows": 3, "error_count": 3, "errors_by_rule": {"custom": 2, "unique": 2}, "errors_by_column": {"id": 4}, "aborted": False}
    assert [r._codes for r in v.codes.orderBy("_row").collect()] == [[0], [201], [251], [251], [0], [0]]


def test_failed_cells_are_not_seen_for_unique(spark):
    assert check(spark, ["x", "x", "12", "12"], g.ColumnDef("number", [g.unique()])) == [(0, 2), (1, 2), (3, 7)]


def test_custom_that_raises_fails(spark):
    with pytest.raises(Exception):
        check(spark, ["x"], g.ColumnDef("string", [g.custom(lambda v: 1 / 0)]))


def test_strict_locale_checks_differ_from_liberal_ones(spark):
    assert check(spark, ["1.234,56", "1234", "45.67", "1.2.3", "12abc", " 5", "+5", "1e3"], g.ColumnDef("number"), "tr") == [(i, 2) for i in range(2, 8)]
    assert check(spark, ["15.03.2024", "31.02.2024", "2024-01-01", "29.02.2023"], g.ColumnDef("date"), "tr") == [(1, 2), (2, 2), (3, 2)]
    assert check(spark, ["$500", "$5,000"], g.ColumnDef("currency", [g.minimum(1000)], locale="en")) == [(0, 3)]
    assert check(spark, ["₺1.234,56"], g.ColumnDef("currency", [g.minimum(99999)], locale="tr")) == []
    assert check(spark, ["1.234,56", "999,99"], g.ColumnDef("number", [g.minimum(1000)]), "tr") == [(1, 3)]
    assert check(spark, ["HAYIR", "evet"], g.ColumnDef("boolean"), "tr") == [(0, 2)]


def test_ten_thousand_rows(spark):
    rows = spark.range(10_000).select(F.col("id").alias("_row"), F.when(F.col("id") % 1000 == 0, "").otherwise(F.col("id").cast("string")).alias("id"), F.lit("n").alias("name"), F.when((F.col("id") % 500 == 0) & (F.col("id") % 1000 != 0), "150").otherwise("50").alias("score"))
    schema = g.Schema({"id": g.ColumnDef("integer", [g.required()]), "name": g.ColumnDef("string", [g.min_length(1)]), "score": g.ColumnDef("number", [g.minimum(0), g.maximum(100)])})
    v = g.validate(rows, schema)
    assert v.stats().first().error_count == 20 and v.get_errors().count() == 20 and v.get_errors(5, 18).count() == 2


def test_row_numbers_follow_the_file(spark, tmp_path):
    spark.range(100).repartition(7).write.parquet(str(tmp_path / "t"))
    df = spark.read.parquet(str(tmp_path / "t"))
    assert sorted(r._row for r in g.with_rows(df).collect()) == list(range(100))


def test_matrix(spark):
    m = ErrorMatrix.blank(spark.range(4).withColumnRenamed("id", "_row"), 3).set_code(1, 2, 5).set_code(3, 0).set_code(3, 1, 201).set_code(9, 9)
    assert m.get_code(1, 2) == 5 and m.has_error(3, 0) and not m.has_error(0, 0) and m.has_row_error(3) and not m.has_row_error(2)
    assert m.counts().first().asDict() == {"errors": 3, "error_rows": 2}
    assert [r._row for r in m.column_errors(0).collect()] == [3]
    assert {r._row: r.cols for r in m.row_error_columns().collect()} == {1: [2], 3: [0, 1]}
    assert [(r.row, r.col, r.code) for r in m.for_each_error()] == [(1, 2, 5), (3, 0, 1), (3, 1, 201)]
    assert m.byte_size() == 4 and m.clear().counts().first().errors == 0
    assert bitmap_bytes(10_000, 8) == 10_000 and code_map_bytes(10, 8) == 80


def test_stream(spark, tmp_path):
    from gristmill.streaming import validate_stream

    spark.createDataFrame([("1",), ("x",)], "n string").write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema("n string").parquet(str(tmp_path / "in"))
    q = validate_stream(stream, g.Schema({"n": g.ColumnDef("number")})).writeStream.format("memory").queryName("checked").trigger(availableNow=True).option("checkpointLocation", str(tmp_path / "cp")).start()
    q.awaitTermination(60)
    assert sorted((r.n, r._codes) for r in spark.table("checked").collect()) == [("1", [0]), ("x", [1])]


def test_counts_of_a_schema_too_wide_for_one_number(spark):
    """Codes are packed into several numbers; customs follow the other codes."""
    columns = {f"c{i}": g.ColumnDef("number", [g.required(), g.minimum(0), g.maximum(9), g.custom(lambda v: v != "5", "Five", native=True)]) for i in range(40)}
    rows = [tuple(str((i * 7 + k) % 14 - 2) if (i + k) % 11 else "" for k in range(40)) for i in range(200)]
    got = {(r.field, r.rule): r.n for r in g.Validator(g.Schema(columns)).validate(spark.createDataFrame(rows, list(columns))).counts().collect()}
    want = {}
    for row in rows:
        for k, v in enumerate(row):
            rule = "required" if v == "" else "min" if int(v) < 0 else "max" if int(v) > 9 else "custom" if v == "5" else None
            if rule:
                want[f"c{k}", rule] = want.get((f"c{k}", rule), 0) + 1
    assert got == want


def test_repeated_values_whose_hashes_meet(spark, monkeypatch):
    """The hash only proposes: values of one hash but different text are no duplicates."""
    rows = [(i, v) for i, v in enumerate(["a", "b", "a", "", "", "c", "b", "a"])]
    monkeypatch.setattr(F, "xxhash64", lambda *_: F.lit(7).cast("long"))
    found = g.Validator(g.Schema({"v": g.ColumnDef("string", [g.unique()])})).validate(spark.createDataFrame(rows, "_row long, v string")).errors.collect()
    assert sorted(r.row for r in found) == [2, 6, 7]
