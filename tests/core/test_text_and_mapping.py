"""Readers, header mapping and the import session."""

import time

import pytest
from pyspark import InheritableThread
from pyspark.sql import functions as F

import gristmill as g
from gristmill.plans import session as ses
from gristmill.sources import delimited
from gristmill.sources.delimited import Options, columns_of, detect_schema, read_compatible, read_native, to_text


@pytest.mark.parametrize("text,rows", [
    ("a,b,c\n1,2\n3,4,5", [["1", "2\n3", "4,5"]]), ("name,age,x\nOmer,25", [["Omer,25"]]), ("a,b\n1,2,3", [["1", "2,3"]]), ('a,b\n1,"x",3\n', [["1", "x"], ["3", ""]]),
    ('a,b,c\n"abc"x,2,3', [["abc", "", "2,3"]]), ('a,b\n"un,1\n2,3', [["un,1\n2,3", ""]]), ('a,b\nx"y,2', [['x"y', "2"]]), ("a,b\r\n1,2\r\n3,4\r\n", [["1", "2"], ["3", "4"]]),
    ("a,b\n\nS,1\n", [["\nS", "1"]]), ('a,b\n\n"S",1\n', [["", ""], ["S", "1"]]), ("a\nx\n\ny", [["x"], [""], ["y"]]), ('a,b\n"q ""z""","l1\nl2"\n', [['q "z"', "l1\nl2"]]), ("a,b", []), ("a,b\n", []),
])
def test_two_scanners(text, rows):
    assert g.parse(text).rows == rows


def test_parse_details():
    assert g.parse("").headers is None and g.parse("").field_count == 0
    assert g.parse("a,b,\n1,2,3").headers == ["a", "b"] and g.parse("a,b,\n1,2,3").field_count == 3
    assert g.parse("1;2\n3;4", Options(";", header=False)).rows == [["1", "2"], ["3", "4"]]
    assert g.parse('a,b\n"",\n1,2', Options(skip_empty_lines=True)).rows == [["1", "2"]]
    assert detect_schema('"a,b",c\r\n').field_count == 2 and detect_schema("a\r\n").line_ending == "\r\n"
    assert g.compile_parser("a,b\n1,2") is g.compile_parser("c,d\n5,6")
    g.clear_parser_cache()


def test_readers(spark, tmp_path):
    text = to_text(["id", "note"], [["1", 'say "hi", twice'], ["2", ""], ["3", "two\nlines"]])
    (tmp_path / "t.csv").write_text(text)
    want = [("1", 'say "hi", twice'), ("2", ""), ("3", "two\nlines")]
    assert sorted(map(tuple, read_native(spark, str(tmp_path / "t.csv")).collect())) == want
    odd = columns_of(read_compatible(spark, str(tmp_path / "t.csv")), ["id", "note"]).orderBy("_row").drop("_row")
    assert [tuple(r) for r in odd.collect()] == want


SCHEMA = g.Schema({"price": g.ColumnDef("number", aliases=("unit price", "amount")), "email": g.ColumnDef("string", [g.email()], aliases=("e-mail",)), "first name": g.ColumnDef()})


def test_map_columns():
    m = g.map_columns(["E-Mail", "Amount", "name first", "", "zzz"], SCHEMA)
    assert [(x.schema_column, x.confidence) for x in m.matches] == [("email", "alias"), ("price", "alias"), ("first name", "fuzzy"), ("", "none"), ("", "none")]
    assert (m.auto_mapped, m.needs_review, m.unmapped, m.unmapped_csv, m.unmapped_schema) == (3, 0, 2, (3, 4), ())
    assert g.should_auto_map(m, 0.8) and not g.should_auto_map(g.map_columns(["price"], SCHEMA), 0.8)
    edited = g.update_mapping(m.matches, 4, "email")
    assert [x.schema_column for x in edited] == ["", "price", "first name", "", "email"] and g.update_mapping(m.matches, 9, "x") == m.matches


def test_apply_mapping(spark):
    df = spark.createDataFrame([("a@b.c", None, "x")], "`e.mail` string, price string, other string")
    out = g.apply_mapping(df, [g.Match(0, "e.mail", "email"), g.Match(1, "price", "price")], SCHEMA).first()
    assert tuple(out) == ("", "a@b.c", "")


def test_score_frame_agrees_with_scalars(spark):
    from gristmill.operators.mapping import score_frame

    heads = ["Unit-Price", "mail", "frst name", "amount"]
    rows = score_frame(spark.createDataFrame([(h,) for h in heads], "header string"), SCHEMA).collect()
    for r in rows:
        assert r.score == pytest.approx(g.compute_best_match(r.header, r.schema_column, SCHEMA.columns[r.schema_column].aliases)[0])


def test_reducer():
    s = ses.initial_state()
    assert ses.reduce(s, "ACCEPT") is s and ses.reduce(s, "NO_SUCH") is s
    s = ses.reduce(s, "LOAD_STRING", content="a,b")
    assert (s.step, s.file_name, s.file_size) == ("parsing", "input.csv", 3) and ses.reduce(s, "LOAD_FILE", file="x") is s
    s = ses.reduce(s, "PARSE_COMPLETE", data=None, headers=["a"], row_count=2, time=1.0)
    s = ses.reduce(s, "SET_MAPPING", mapping=g.map_columns(["prise", "amount"], SCHEMA))
    t = ses.reduce(s, "UPDATE_MAPPING", csv_index=0, schema_column="price")
    assert [m.schema_column for m in t.mapping.matches] == ["price", ""] and (t.mapping.auto_mapped, t.mapping.unmapped) == (1, 1)
    assert ses.reduce(s, "GO_BACK").step == "idle"
    s = ses.reduce(ses.reduce(s, "CONFIRM_MAPPING", mapped=None), "VALIDATE_COMPLETE", result="r", time=2.0, is_bitmap=True)
    assert (s.step, s.validation, s.bitmap_validation) == ("review", None, "r") and ses.reduce(s, "GO_BACK").bitmap_validation is None
    s = ses.reduce(s, "ACCEPT")
    assert s.step == "complete" and ses.reduce(s, "GO_BACK").step == "review" and ses.reduce(s, "RESET") == ses.initial_state()
    assert ses.is_valid_transition("review", "mapping") and not ses.is_valid_transition("idle", "review") and ses.back_steps("parsing") == []
    assert ses.can_go_back("error") and not ses.can_go_forward("idle")


def test_session(spark, tmp_path):
    done = []
    schema = g.Schema({"name": g.ColumnDef("string", [g.required(), g.min_length(2)], aliases=("full_name",)), "email": g.ColumnDef("string", [g.required(), g.email()], aliases=("e-mail",))})
    s = g.ImportSession(spark, schema, on_complete=done.append)
    s.load_string("full_name,E-Mail\nAli,b@c.d\n,x\n")
    assert s.state.step == "review" and s.has_errors and [(e.row, e.code) for e in s.get_errors()] == [(1, 1), (1, 10)]
    assert s.get_cell_error(1, 0).message == "This field is required" and s.error_summary() == {"required": 1, "email": 1}
    result = s.accept()
    assert result.stats["valid_rows"] == 1 and done == [result] and s.is_complete
    assert s.load_string("").step == "error" and s.load_string("q,w\n1,2").step == "mapping"
    s.update_mapping(0, "name")
    assert s.confirm_mapping().step == "review"
    (tmp_path / "f.csv").write_text("name,email\nAli,a@b.c\nVeli,v@x.y\n")
    assert g.ImportSession(spark, schema, max_rows=1).load_file(str(tmp_path / "f.csv")).row_count == 1
    assert g.parse_and_validate(spark, str(tmp_path / "f.csv"), schema).stats().first().total_rows == 2
    assert s.cancel().step == "idle"


def test_native_reader_splits_unless_a_quoted_field_goes_on(spark, tmp_path):
    """Partitions grow with the file; a quoted line break is seen and keeps the file whole."""
    plain, odd = tmp_path / "plain.csv", tmp_path / "odd.csv"
    lines = [f'{i},"name, ""{i}""",x' for i in range(60_000)]
    plain.write_text("\n".join(["a,b,c", *lines]))
    odd.write_text("\n".join(["a,b,c", *lines, '60000,"two\nlines",y']))
    old = spark.conf.get("spark.sql.files.maxPartitionBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "128k")
    try:
        whole, cut = delimited.read_native(spark, str(odd)), delimited.read_native(spark, str(plain))
        assert whole.rdd.getNumPartitions() == 1 and cut.rdd.getNumPartitions() >= 8
        assert not delimited.has_open_lines(spark, str(plain)) and delimited.has_open_lines(spark, str(odd))
        assert cut.count() == 60_000 and cut.agg(F.sum(F.col("a").cast("long")), F.count_distinct("b")).first() == (sum(range(60_000)), 60_000)
        assert whole.where("a = '60000'").first().b == "two\nlines"
        assert delimited.read_native(spark, str(plain), delimited.Options(multiline=True)).rdd.getNumPartitions() == 1
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", old)


def test_windows_line_ends_and_headers(spark, tmp_path):
    path = tmp_path / "crlf.csv"
    path.write_bytes(b'id,"the name"\r\n1,a\r\n\r\n2,"b"\r\n')
    got = delimited.read_native(spark, str(path))
    assert got.columns == ["id", "the name"] and sorted(map(tuple, got.collect())) == [("1", "a"), ("2", "b")]


def test_cancel_interrupts_a_running_import(spark):
    """Called from another thread while rows are read; the session starts over."""
    slow = F.pandas_udf("string")(lambda v: (time.sleep(30), v)[1])
    df = spark.range(8).repartition(4).select(F.col("id").alias("_row"), slow(F.col("id").cast("string")).alias("name"))
    session = g.ImportSession(spark, g.Schema({"name": g.ColumnDef("string")}))
    worker = InheritableThread(target=session.load_frame, args=(df.where("name <> 'x'"),))
    began = time.monotonic()
    worker.start()
    while not spark.sparkContext.statusTracker().getActiveJobsIds() and time.monotonic() - began < 20:
        time.sleep(0.2)
    session.cancel()
    worker.join(25)
    assert not worker.is_alive() and session.state.step == ses.IDLE and time.monotonic() - began < 30


def test_preview_keeps_the_order_of_rows(spark):
    session = g.ImportSession(spark, g.Schema({"name": g.ColumnDef("string")}), max_preview_rows=3)
    session.load_frame(spark.createDataFrame([(i, f"n{i}") for i in (40, 10, 30, 20)], "_row long, name string"))
    assert [r.name for r in session.state.preview] == ["n10", "n20", "n30"]
    session.load_frame(spark.createDataFrame([(f"n{i}",) for i in range(9)], "name string").coalesce(1))
    assert [tuple(r) for r in session.state.preview] == [("n0",), ("n1",), ("n2",)]
