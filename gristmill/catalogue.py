"""Registered queries, each with SQL that says the same in another dialect.

Inputs are derived from the tables by expressions that both dialects read
alike; rules and functions are then applied by this package on one side and
spelled out in SQL on the other.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import schema as s
from .functions import dates, liberal, similarity
from .functions.locales import get_locale
from .operators import mapping
from .operators.validation import CODES, ErrorMatrix, Validator, with_rows
from .plans.session import ImportSession, parse_and_validate
from .sources import delimited
from .workers import shared_dir

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
SQL: dict[str, str] = {}


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def spread(df: DataFrame) -> DataFrame:
    """All cores for a scan with fewer splits than cores (one row group, say); larger scans stay as they are, without a shuffle."""
    n = df.sparkSession.sparkContext.defaultParallelism
    return df.repartition(n) if df.rdd.getNumPartitions() < n else df


def register(name: str, query: Query, sql: str | None = None) -> None:
    QUERIES[name] = query
    if sql:
        SQL[name] = sql


# ---------------------------------------------------------------- one column, one rule


def one_column(name: str, source: str, key: str, expr: str, column: s.ColumnDef, faults: list[tuple[str, int, str]]) -> None:
    """The error table of one derived column ``v``; ``faults`` are SQL conditions in the order of the checks."""

    def query(spark: SparkSession, sf_dir: str) -> DataFrame:
        df = spread(table(spark, sf_dir, source)).select(F.expr(key).cast("long").alias("_row"), F.expr(expr).alias("v"))
        return Validator(s.Schema({"v": column})).validate(df).errors

    codes = " ".join(f"WHEN {c} THEN {code}" for c, code, _ in faults)
    texts = " ".join(f"WHEN {c} THEN '{m}'" for c, _, m in faults)
    register(name, query, f"""
        WITH d AS (SELECT CAST({key} AS BIGINT) AS "row", {expr} AS v FROM {source}),
        e AS (SELECT *, CASE {codes} ELSE 0 END AS code, CASE {texts} END AS message FROM d)
        SELECT "row", CAST(0 AS INTEGER) AS col, 'v' AS field, v AS value, CAST(code AS INTEGER) AS code, message FROM e WHERE code <> 0""")


MONEY = "CAST(CAST({} AS DECIMAL(18,2)) AS STRING)"
NUMBER = r"^[+-]?(\d+\.?\d*|\.\d+)([eE][+-]?\d+)?$"
number_sql = f"(trim(v) = '' OR regexp_matches(trim(v), '{NUMBER}') OR regexp_matches(trim(v), '^0x[0-9A-F]+$'))"
PRICE = MONEY.format("o_totalprice")
odd_numbers = f"CASE o_orderkey % 8 WHEN 0 THEN '12x' WHEN 1 THEN '1e3' WHEN 2 THEN ' 7 ' WHEN 3 THEN '0x1F' WHEN 4 THEN '' WHEN 5 THEN '1.2.3' ELSE {PRICE} END"

one_column("validate_required", "customer", "c_custkey", "CASE WHEN c_custkey % 50 = 0 THEN '' WHEN c_custkey % 51 = 0 THEN ' ' ELSE c_name END", s.ColumnDef("string", [s.required()]), [("v = ''", 1, "This field is required")])
one_column("validate_type_number", "orders", "o_orderkey", odd_numbers, s.ColumnDef("number"), [(f"v <> '' AND NOT {number_sql}", 2, s.TYPE_MESSAGES["number"])])
one_column("validate_type_integer", "orders", "o_orderkey", f"CASE o_orderkey % 5 WHEN 0 THEN '1.0' WHEN 1 THEN CAST(o_custkey AS STRING) WHEN 2 THEN '' WHEN 3 THEN '7e2' ELSE {PRICE} END", s.ColumnDef("integer"),
           [("v <> '' AND CAST(v AS DOUBLE) <> floor(CAST(v AS DOUBLE))", 2, s.TYPE_MESSAGES["integer"])])
one_column("validate_type_boolean", "events", "event_id", "CASE event_id % 7 WHEN 0 THEN 'TRUE' WHEN 1 THEN 'no' WHEN 2 THEN '1' WHEN 3 THEN ' yes' WHEN 4 THEN 'maybe' WHEN 5 THEN '' ELSE event_type END", s.ColumnDef("boolean"),
           [("v <> '' AND lower(v) NOT IN ('true', 'false', '1', '0', 'yes', 'no')", 2, s.TYPE_MESSAGES["boolean"])])
one_column("validate_type_date", "orders", "o_orderkey", "CASE o_orderkey % 5 WHEN 0 THEN '2025-99-99' WHEN 1 THEN '1.2.2020' WHEN 2 THEN '' WHEN 3 THEN '2020-1-05' ELSE CAST(CAST(o_orderdate AS DATE) AS STRING) END", s.ColumnDef("date"),
           [(r"v <> '' AND NOT regexp_full_match(v, '\d{4}-\d{2}-\d{2}')", 2, s.TYPE_MESSAGES["date"])])
one_column("validate_type_phone", "customer", "c_custkey", "CASE c_custkey % 4 WHEN 0 THEN '+90 532 ' || CAST(1000000 + c_custkey AS STRING) WHEN 1 THEN CAST(c_custkey AS STRING) WHEN 2 THEN '' ELSE '(0532) ' || CAST(c_custkey AS STRING) || '-00-11-22' END", s.ColumnDef("phone"),
           [("v <> '' AND length(regexp_replace(v, '[^0-9]', '', 'g')) NOT BETWEEN 10 AND 15", 2, s.TYPE_MESSAGES["phone"])])
one_column("validate_type_currency", "orders", "o_orderkey", f"CASE o_orderkey % 5 WHEN 0 THEN 'USD' WHEN 1 THEN '$' || {PRICE} WHEN 2 THEN '' WHEN 3 THEN '1.2.3' ELSE {PRICE} || ' EUR' END", s.ColumnDef("currency"),
           [(f"v <> '' AND NOT regexp_matches(regexp_replace(v, '[^0-9.-]', '', 'g'), '{NUMBER}')", 2, s.TYPE_MESSAGES["currency"])])
one_column("validate_min", "customer", "c_custkey", MONEY.format("c_acctbal"), s.ColumnDef("number", [s.minimum(0)]), [("CAST(v AS DOUBLE) < 0", 3, "Value must be at least 0")])
one_column("validate_max", "part", "p_partkey", "CAST(p_size AS STRING)", s.ColumnDef("number", [s.maximum(40)]), [("CAST(v AS DOUBLE) > 40", 4, "Value must be at most 40")])
one_column("validate_min_string", "orders", "o_orderkey", odd_numbers, s.ColumnDef("string", [s.minimum(100)]),
           [(r"regexp_matches(v, '^(1e3|0x1F)$') AND false OR v IN (' 7 ', '0x1F') OR (regexp_matches(v, '^\d+\.\d+$') AND TRY_CAST(v AS DOUBLE) < 100)", 3, "Value must be at least 100")])
one_column("validate_min_length", "documents", "doc_id", "text", s.ColumnDef("string", [s.min_length(300)]), [("v <> '' AND length(v) < 300", 8, "Length must be at least 300")])
one_column("validate_max_length", "documents", "doc_id", "text", s.ColumnDef("string", [s.max_length(5000)]), [("length(v) > 5000", 9, "Length must be at most 5000")])
one_column("validate_pattern", "part", "p_partkey", "p_brand", s.ColumnDef("string", [s.pattern(r"^brand#[1-3]\d$", "i")]), [("NOT regexp_matches(lower(v), '^brand#[1-3][0-9]$')", 5, "Value does not match the required pattern")])
one_column("validate_enum", "customer", "c_custkey", "c_mktsegment", s.ColumnDef("enum", [s.enum("BUILDING", "MACHINERY")]), [("v NOT IN ('BUILDING', 'MACHINERY')", 6, "Value must be one of: BUILDING, MACHINERY")])
one_column("validate_email", "customer", "c_custkey", "CASE c_custkey % 5 WHEN 0 THEN 'a b@c.de' WHEN 1 THEN '' WHEN 2 THEN c_name || '@host' WHEN 3 THEN '@x.y' ELSE replace(c_name, '#', '') || '@mail.example' END", s.ColumnDef("string", [s.email()]),
           [(r"v <> '' AND NOT regexp_full_match(v, '[^\s@]+@[^\s@]+\.[^\s@]+')", 10, "Invalid email address")])
one_column("validate_first_error_order", "customer", "c_custkey", f"CASE c_custkey % 6 WHEN 0 THEN '' WHEN 1 THEN 'x' ELSE {MONEY.format('c_acctbal')} END", s.ColumnDef("number", [s.maximum(5000), s.required(), s.minimum(0), s.max_length(6)]),
           [("v = ''", 1, "This field is required"), ("v = 'x'", 2, s.TYPE_MESSAGES["number"]), ("CAST(v AS DOUBLE) > 5000", 4, "Value must be at most 5000"), ("CAST(v AS DOUBLE) < 0", 3, "Value must be at least 0"), ("length(v) > 6", 9, "Length must be at most 6")])
one_column("validate_custom", "events", "event_id", MONEY.format("value"), s.ColumnDef("number", [s.custom(lambda v: v.cast("double") < 50, "Too large", native=True)]), [("CAST(v AS DOUBLE) >= 50", 11, "Too large")])
one_column("validate_custom_python", "events", "event_id", MONEY.format("value"), s.ColumnDef("number", [s.custom(lambda v: v.endswith(("0", "2", "4", "6", "8")), "Must be even")]), [("right(v, 1) NOT IN ('0', '2', '4', '6', '8')", 11, "Must be even")])

UNIQUE_SQL = """
    WITH d AS (SELECT CAST({key} AS BIGINT) AS "row", {expr} AS v FROM {source}),
    n AS (SELECT *, row_number() OVER (PARTITION BY v ORDER BY "row") AS k FROM d WHERE v <> '')
    SELECT "row", CAST(0 AS INTEGER) AS col, 'v' AS field, v AS value, CAST(7 AS INTEGER) AS code, 'Duplicate value' AS message FROM n WHERE k > 1"""


def unique_query(name: str, source: str, key: str, expr: str) -> None:
    one_column(name, source, key, expr, s.ColumnDef("string", [s.unique()]), [])
    SQL[name] = UNIQUE_SQL.format(source=source, key=key, expr=expr)


unique_query("validate_unique", "documents", "doc_id", "text")
unique_query("validate_unique_orders", "orders", "o_orderkey", "CASE WHEN o_orderkey % 3 = 0 THEN '' ELSE CAST(o_custkey AS STRING) END")

# ---------------------------------------------------------------- a table of several columns

CUSTOMER = s.Schema({
    "name": s.ColumnDef("string", [s.required(), s.pattern(r"[02468]$")]),
    "balance": s.ColumnDef("number", [s.minimum(0), s.maximum(9000)]),
    "segment": s.ColumnDef("enum", [s.required(), s.enum("BUILDING", "MACHINERY", "FURNITURE")]),
    "nation": s.ColumnDef("integer", [s.maximum(20)]),
})
CUSTOMER_CELLS = {
    "name": "CASE WHEN c_custkey % 50 = 0 THEN '' ELSE c_name END",
    "balance": f"CASE WHEN c_custkey % 33 = 0 THEN 'n/a' ELSE {MONEY.format('c_acctbal')} END",
    "segment": "CASE WHEN c_custkey % 40 = 0 THEN '' ELSE c_mktsegment END",
    "nation": "CAST(c_nationkey AS STRING)",
}


def customers(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "customer").select((F.col("c_custkey") - 1).cast("long").alias("_row"), *[F.expr(e).alias(n) for n, e in CUSTOMER_CELLS.items()])


def checked_customers(spark: SparkSession, sf_dir: str):
    return Validator(CUSTOMER).validate(customers(spark, sf_dir))


CUSTOMER_FAULTS = {
    "name": [("v = ''", 1, "This field is required", "required"), ("NOT regexp_matches(v, '[02468]$')", 5, "Value does not match the required pattern", "pattern")],
    "balance": [("v = 'n/a'", 2, s.TYPE_MESSAGES["number"], "type"), ("CAST(v AS DOUBLE) < 0", 3, "Value must be at least 0", "min"), ("CAST(v AS DOUBLE) > 9000", 4, "Value must be at most 9000", "max")],
    "segment": [("v = ''", 1, "This field is required", "required"), ("v NOT IN ('BUILDING', 'MACHINERY', 'FURNITURE')", 6, "Value must be one of: BUILDING, MACHINERY, FURNITURE", "enum")],
    "nation": [("CAST(v AS DOUBLE) > 20", 4, "Value must be at most 20", "max")],
}


def case(faults: list[tuple], what: int, other: str) -> str:
    return "CASE " + " ".join(f"WHEN {f[0]} THEN '{f[what]}'" if isinstance(f[what], str) else f"WHEN {f[0]} THEN {f[what]}" for f in faults) + f" ELSE {other} END"


CELLS_SQL = "WITH cells AS (" + " UNION ALL ".join(
    f"""SELECT CAST(c_custkey - 1 AS BIGINT) AS "row", CAST({i} AS INTEGER) AS col, '{n}' AS field, v AS value, CAST({case(CUSTOMER_FAULTS[n], 1, '0')} AS INTEGER) AS code,
        {case(CUSTOMER_FAULTS[n], 2, 'NULL')} AS message, {case(CUSTOMER_FAULTS[n], 3, 'NULL')} AS rule FROM (SELECT c_custkey, {e} AS v FROM customer)"""
    for i, (n, e) in enumerate(CUSTOMER_CELLS.items())) + "), err AS (SELECT * FROM cells WHERE code <> 0) "
COLUMNS = '"row", col, field, value, code, message'

register("error_list", lambda sp, d: checked_customers(sp, d).errors, CELLS_SQL + f"SELECT {COLUMNS} FROM err")
register("error_page", lambda sp, d: checked_customers(sp, d).get_errors(25, 40), CELLS_SQL + f'SELECT {COLUMNS} FROM err ORDER BY "row", col LIMIT 25 OFFSET 40')
register("row_errors", lambda sp, d: checked_customers(sp, d).get_row_errors(99), CELLS_SQL + f'SELECT {COLUMNS} FROM err WHERE "row" = 99')
register("cell_error", lambda sp, d: checked_customers(sp, d).get_cell_error(99, 0), CELLS_SQL + f'SELECT {COLUMNS} FROM err WHERE "row" = 99 AND col = 0')
register("errors_by_rule", lambda sp, d: checked_customers(sp, d).errors_by_rule(), CELLS_SQL + "SELECT rule, count(*) AS n FROM err GROUP BY rule")
register("errors_by_column", lambda sp, d: checked_customers(sp, d).errors_by_column(), CELLS_SQL + "SELECT field, count(*) AS n FROM err GROUP BY field")
register("error_counts", lambda sp, d: checked_customers(sp, d).counts(), CELLS_SQL + "SELECT field, rule, count(*) AS n FROM err GROUP BY field, rule")
STATS_SQL = "SELECT (SELECT count(*) FROM customer) AS total_rows, (SELECT count(*) FROM customer) - count(DISTINCT \"row\") AS valid_rows, count(DISTINCT \"row\") AS error_rows, count(*) AS error_count FROM err"
register("validation_stats", lambda sp, d: checked_customers(sp, d).stats(), CELLS_SQL + STATS_SQL)


def flagship(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Errors per column and rule of a table of several columns."""
    return checked_customers(spark, sf_dir).counts()


# ---- the error matrix


def matrix(spark: SparkSession, sf_dir: str) -> ErrorMatrix:
    return ErrorMatrix(checked_customers(spark, sf_dir).codes, 4)


register("bitmap_rows", lambda sp, d: matrix(sp, d).rows_with_errors().select(F.col("_row").alias("row")), CELLS_SQL + 'SELECT DISTINCT "row" FROM err')
register("bitmap_count", lambda sp, d: matrix(sp, d).counts(), CELLS_SQL + 'SELECT count(*) AS errors, count(DISTINCT "row") AS error_rows FROM err')
register("bitmap_column_errors", lambda sp, d: matrix(sp, d).column_errors(1).select(F.col("_row").alias("row")), CELLS_SQL + 'SELECT "row" FROM err WHERE col = 1')
register("bitmap_row_columns", lambda sp, d: matrix(sp, d).row_error_columns().select(F.col("_row").alias("row"), F.array_join("cols", ",").alias("cols")), CELLS_SQL + 'SELECT "row", string_agg(CAST(col AS VARCHAR), \',\' ORDER BY col) AS cols FROM err GROUP BY "row"')
register("bitmap_set_code", lambda sp, d: matrix(sp, d).clear().set_code(5, 2, 9).cells().select("row", F.col("col").cast("int").alias("col"), F.col("code").cast("int").alias("code")), 'SELECT CAST(5 AS BIGINT) AS "row", CAST(2 AS INTEGER) AS col, CAST(9 AS INTEGER) AS code')
register("bitmap_memory", lambda sp, d: sp.createDataFrame([(matrix(sp, d).byte_size(), checked_customers(sp, d).memory_usage())], "bitmap long, both long"),
         "SELECT CAST(ceil(count(*) * 4 / 32) * 4 AS BIGINT) AS bitmap, CAST(ceil(count(*) * 4 / 32) * 4 + count(*) * 4 AS BIGINT) AS both FROM customer")
register("bitmap_each_error", lambda sp, d: sp.createDataFrame([(r.row, r.col) for r in matrix(sp, d).for_each_error()], "row long, col int"), CELLS_SQL + 'SELECT "row", col FROM err')
register("code_matrix", lambda sp, d: checked_customers(sp, d).codes.select(F.col("_row").alias("row"), F.array_join(CODES, ",").alias("codes")),
         CELLS_SQL + """SELECT "row", string_agg(CAST(CASE WHEN field = 'name' AND code = 5 THEN 2 WHEN field = 'balance' AND code > 0 THEN code - 1 WHEN field = 'segment' AND code = 6 THEN 2
             WHEN field = 'nation' AND code = 4 THEN 2 ELSE code END AS VARCHAR), ',' ORDER BY col) AS codes FROM cells GROUP BY "row\"""")

# ---- custom and unique on one column

BOTH = s.Schema({"v": s.ColumnDef("string", [s.unique(), s.custom(lambda v: F.length(v) > 2, "Too short", native=True)])})
BOTH_SQL = """WITH d AS (SELECT CAST(o_orderkey AS BIGINT) AS "row", CAST(o_custkey AS VARCHAR) AS v FROM orders),
    n AS (SELECT *, row_number() OVER (PARTITION BY v ORDER BY "row") > 1 AS again, length(v) <= 2 AS short FROM d) """


def both(spark: SparkSession, sf_dir: str):
    return Validator(BOTH).validate(table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("_row"), F.col("o_custkey").cast("string").alias("v")))


register("custom_and_unique_errors", lambda sp, d: both(sp, d).errors, BOTH_SQL + """SELECT "row", CAST(0 AS INTEGER) AS col, 'v' AS field, v AS value, CAST(CASE WHEN again THEN 7 ELSE 11 END AS INTEGER) AS code,
    CASE WHEN again THEN 'Duplicate value' ELSE 'Too short' END AS message FROM n WHERE again OR short""")
register("custom_and_unique_counts", lambda sp, d: both(sp, d).errors_by_rule(), BOTH_SQL + "SELECT 'custom' AS rule, count(*) AS n FROM n WHERE short UNION ALL SELECT 'unique', count(*) FROM n WHERE again")
register("custom_and_unique_stats", lambda sp, d: both(sp, d).stats(), BOTH_SQL + "SELECT count(*) AS total_rows, count(*) FILTER (NOT again AND NOT short) AS valid_rows, count(*) FILTER (again OR short) AS error_rows, count(*) FILTER (again OR short) AS error_count FROM n")

# ---------------------------------------------------------------- a wide table, for throughput

LINEITEM = s.Schema({
    "order": s.ColumnDef("integer", [s.required(), s.minimum(1)]), "part": s.ColumnDef("integer", [s.required()]), "supplier": s.ColumnDef("integer", [s.required()]),
    "line": s.ColumnDef("integer", [s.minimum(1), s.maximum(6)]), "quantity": s.ColumnDef("number", [s.minimum(1), s.maximum(45)]), "price": s.ColumnDef("number", [s.minimum(0)]),
    "discount": s.ColumnDef("number", [s.maximum(0.09)]), "tax": s.ColumnDef("number", [s.minimum(0)]), "flag": s.ColumnDef("enum", [s.enum("A", "N")]), "status": s.ColumnDef("enum", [s.enum("O", "F")]), "shipped": s.ColumnDef("date", [s.required()]),
})


def lineitems(spark: SparkSession, sf_dir: str) -> DataFrame:
    text = {"order": "l_orderkey", "part": "l_partkey", "supplier": "l_suppkey", "line": "l_linenumber", "flag": "l_returnflag", "status": "l_linestatus"}
    money = {"quantity": "l_quantity", "price": "l_extendedprice", "discount": "l_discount", "tax": "l_tax"}
    df = spread(table(spark, sf_dir, "lineitem"))
    cells = {n: F.col(c).cast("string") for n, c in text.items()} | {n: F.expr(MONEY.format(c)) for n, c in money.items()} | {"shipped": F.date_format("l_shipdate", "yyyy-MM-dd")}
    return df.select(F.lit(0).cast("long").alias("_row"), *[cells[n].alias(n) for n in LINEITEM.names])


register("lineitem_counts", lambda sp, d: Validator(LINEITEM).validate(lineitems(sp, d)).counts(), """
    SELECT * FROM (SELECT 'order' AS field, 'min' AS rule, count(*) FILTER (l_orderkey < 1) AS n FROM lineitem UNION ALL SELECT 'line' AS field, 'max' AS rule, count(*) FILTER (l_linenumber > 6) AS n FROM lineitem UNION ALL SELECT 'line', 'min', count(*) FILTER (l_linenumber < 1) FROM lineitem
    UNION ALL SELECT 'quantity', 'max', count(*) FILTER (l_quantity > 45) FROM lineitem UNION ALL SELECT 'quantity', 'min', count(*) FILTER (l_quantity < 1) FROM lineitem
    UNION ALL SELECT 'discount', 'max', count(*) FILTER (CAST(l_discount AS DECIMAL(18,2)) > 0.09) FROM lineitem UNION ALL SELECT 'flag', 'enum', count(*) FILTER (l_returnflag NOT IN ('A', 'N')) FROM lineitem
    UNION ALL SELECT 'status', 'enum', count(*) FILTER (l_linestatus NOT IN ('O', 'F')) FROM lineitem) WHERE n > 0""")

# ---------------------------------------------------------------- locales: liberal functions and strict checks

#: How each dialect renders an order's price for a locale.
RENDER = {"tr": (",.", ".,"), "de": (",.", ".,"), "fr": (",.", " ,"), "en": None, "en-GB": None}


def rendered_price(locale: str, spark_side: bool) -> str:
    grouped = "format_number(CAST(o_totalprice AS DECIMAL(18,2)), 2)" if spark_side else "format('{:,.2f}', o_totalprice)"
    swap = RENDER[locale]
    return f"translate({grouped}, '{swap[0]}', '{swap[1]}')" if swap else grouped


def quoted(text: str) -> str:
    return text.replace("'", "''")


def tidy(locale: str) -> str:
    own = get_locale(locale)
    return f"replace(replace(v, '{own.thousands}', ''), '{own.decimal}', '.')"


def plain_sql(x: str) -> str:
    """A double with at most two decimals as text without trailing zeros."""
    return f"regexp_replace(regexp_replace(CAST(CAST({x} AS DECIMAL(18,2)) AS VARCHAR), '0+$', ''), '\\.$', '')"


def over_orders(expr_spark: str, fn: Callable, alias: str) -> Query:
    def query(spark: SparkSession, sf_dir: str) -> DataFrame:
        df = spread(table(spark, sf_dir, "orders")).select(F.col("o_orderkey").alias("k"), F.expr(expr_spark).alias("v"))
        return df.select("k", fn(F.col("v")).alias(alias))

    return query


def strict_check(name: str, expr_spark: str, expr_sql: str, column: s.ColumnDef, faults: list[tuple[str, int, str]]) -> None:
    one_column(name, "orders", "o_orderkey", expr_spark, column, faults)
    SQL[name] = SQL[name].replace(expr_spark + " AS v", expr_sql + " AS v")


DAY = {"tr": ("dd.MM.yyyy", "%d.%m.%Y", "31.02.2021", "01.01.1800", "05.13.2020"), "de": ("dd.MM.yyyy", "%d.%m.%Y", "31.02.2021", "01.01.1800", "05.13.2020"), "fr": ("dd/MM/yyyy", "%d/%m/%Y", "31/02/2021", "01/01/1800", "05/13/2020"),
       "en-GB": ("dd/MM/yyyy", "%d/%m/%Y", "31/02/2021", "01/01/1800", "05/13/2020"), "en": ("MM/dd/yyyy", "%m/%d/%Y", "02/31/2021", "01/01/1800", "13/05/2020")}
GROUPED = {"tr": r"^-?\d{1,3}(\.\d{3})*(,\d+)?$|^-?\d+(,\d+)?$", "en": r"^-?\d{1,3}(,\d{3})*(\.\d+)?$|^-?\d+(\.\d+)?$", "fr": r"^-?\d{1,3}(\s\d{3})*(,\d+)?$|^-?\d+(,\d+)?$"}
GROUPED |= {"de": GROUPED["tr"], "en-GB": GROUPED["en"]}

for loc, (java, c_style, bad_day, bad_year, bad_month) in DAY.items():
    tag = loc.replace("-", "_").lower()
    own = get_locale(loc)

    def sides(build: Callable[[bool], str]) -> tuple[str, str]:
        return build(True), build(False)

    # numbers: rendered, with text after it, not a number, empty
    spark_v, sql_v = sides(lambda side, loc=loc: f"CASE o_orderkey % 9 WHEN 0 THEN 'abc' WHEN 1 THEN '' WHEN 2 THEN {rendered_price(loc, side)} || 'x' WHEN 3 THEN '-' || {rendered_price(loc, side)} WHEN 4 THEN ' ' || {rendered_price(loc, side)} ELSE {rendered_price(loc, side)} END")
    base = f"WITH d AS (SELECT o_orderkey AS k, {sql_v} AS v FROM orders) "
    value = f"TRY_CAST(replace(trim({tidy(loc)}), 'x', '') AS DOUBLE)"
    register(f"number_parse_{tag}", over_orders(spark_v, lambda v, loc=loc: liberal.parse_number(v, loc), "x"), base + f"SELECT k, {value} AS x FROM d")
    register(f"number_validate_{tag}", over_orders(spark_v, lambda v, loc=loc: liberal.validate_number(v, loc), "x"), base + "SELECT k, CAST(CASE WHEN v = 'abc' THEN 1 ELSE 0 END AS INTEGER) AS x FROM d")
    register(f"number_normalize_{tag}", over_orders(spark_v, lambda v, loc=loc: liberal.normalize_number(v, loc), "x"), base + f"SELECT k, {plain_sql(value)} AS x FROM d")
    strict_check(f"number_strict_{tag}", spark_v, sql_v, s.ColumnDef("number", locale=loc), [(f"v <> '' AND NOT regexp_matches(v, '{GROUPED[loc]}')", 2, "Invalid number format")])
    strict_check(f"locale_min_max_{tag}", spark_v, sql_v, s.ColumnDef("number", [s.minimum(1000), s.maximum(200000)], locale=loc),
                 [(f"v <> '' AND NOT regexp_matches(v, '{GROUPED[loc]}')", 2, "Invalid number format"), (f"v <> '' AND {value} < 1000", 3, "Value must be at least 1000"), (f"v <> '' AND {value} > 200000", 4, "Value must be at most 200000")])

    # currency: symbol before, after, alone, none
    sign = quoted(own.symbols[0])
    spark_v, sql_v = sides(lambda side, loc=loc, sign=sign: f"CASE o_orderkey % 6 WHEN 0 THEN '{sign}' WHEN 1 THEN '' WHEN 2 THEN '{sign}' || {rendered_price(loc, side)} WHEN 3 THEN {rendered_price(loc, side)} || ' {get_locale(loc).symbols[-1]}' WHEN 4 THEN 'x' ELSE {rendered_price(loc, side)} END")
    base = f"WITH d AS (SELECT o_orderkey AS k, trim(replace(replace({sql_v}, '{sign}', ''), '{own.symbols[-1]}', '')) AS v, {sql_v} AS raw FROM orders) "
    value = f"TRY_CAST({tidy(loc)} AS DOUBLE)"
    register(f"currency_strip_{tag}", over_orders(spark_v, lambda v, loc=loc: liberal.strip_currency(v, loc), "x"), base + "SELECT k, v AS x FROM d")
    register(f"currency_parse_{tag}", over_orders(spark_v, lambda v, loc=loc: liberal.parse_currency(v, loc), "x"), base + f"SELECT k, {value} AS x FROM d")
    register(f"currency_validate_{tag}", over_orders(spark_v, lambda v, loc=loc: liberal.validate_currency(v, loc), "x"), base + "SELECT k, CAST(CASE WHEN raw <> '' AND v IN ('', 'x') THEN 1 ELSE 0 END AS INTEGER) AS x FROM d")
    register(f"currency_normalize_{tag}", over_orders(spark_v, lambda v, loc=loc: liberal.normalize_currency(v, loc), "x"), base + f"SELECT k, {plain_sql(value)} AS x FROM d")
    strict_check(f"currency_strict_{tag}", spark_v, sql_v, s.ColumnDef("currency", locale=loc), [(f"v = '{sign}'", 2, "Invalid currency format"), ("v = 'x'", 2, "Invalid number in currency")])

    # dates: real ones, a day, a month and a year out of range, another format
    spark_v, sql_v = sides(lambda side, p=(java, c_style, bad_day, bad_year, bad_month): f"CASE o_orderkey % 8 WHEN 0 THEN '{p[2]}' WHEN 1 THEN '{p[3]}' WHEN 2 THEN '' WHEN 3 THEN 'soon' WHEN 4 THEN '{p[4]}' ELSE {f'''date_format(o_orderdate, '{p[0]}')''' if side else f'''strftime(o_orderdate, '{p[1]}')'''} END")
    base = f"WITH d AS (SELECT o_orderkey AS k, o_orderdate AS t, o_orderkey % 8 AS m, {sql_v} AS v FROM orders) "
    register(f"date_parse_{tag}", over_orders(spark_v, lambda v, loc=loc: liberal.parse_date(v, loc)["day"] * 1000000 + liberal.parse_date(v, loc)["month"] * 10000 + liberal.parse_date(v, loc)["year"], "x"), base + "SELECT k, CAST(CASE WHEN m > 4 THEN day(t) * 1000000 + month(t) * 10000 + year(t) END AS INTEGER) AS x FROM d")
    register(f"date_validate_{tag}", over_orders(spark_v, lambda v, loc=loc: liberal.validate_date(v, loc), "x"), base + "SELECT k, CAST(CASE m WHEN 0 THEN 3 WHEN 1 THEN 4 WHEN 3 THEN 1 WHEN 4 THEN 2 ELSE 0 END AS INTEGER) AS x FROM d")
    register(f"date_iso_{tag}", over_orders(spark_v, lambda v, loc=loc: liberal.normalize_date(v, loc), "x"), base + "SELECT k, CASE WHEN m > 4 THEN strftime(t, '%Y-%m-%d') END AS x FROM d")
    strict_check(f"date_strict_{tag}", spark_v, sql_v, s.ColumnDef("date", locale=loc), [(f"v = '{bad_day}'", 2, "Invalid day for month"), (f"v = '{bad_year}'", 2, "Invalid year (1900-2100)"), ("v = 'soon'", 2, "Invalid date format"), (f"v = '{bad_month}'", 2, "Invalid month (1-12)")])

    # phones: with code, another country, too short, national
    code, n = own.country_code, own.phone_digits - len(own.country_code) + 1
    local = f"lpad(CAST(o_orderkey AS STRING), {n}, '5')"
    v = f"CASE o_orderkey % 6 WHEN 0 THEN '{code} ' || {local} WHEN 1 THEN '' WHEN 2 THEN '123' WHEN 3 THEN '0' || {local} WHEN 4 THEN '+7 ' || {local} ELSE '(' || {local} || ')' END"
    base = f"WITH d AS (SELECT o_orderkey AS k, o_orderkey % 6 AS m, {v} AS v, lpad(CAST(o_orderkey AS VARCHAR), {n}, '5') AS l FROM orders) "
    register(f"phone_parse_{tag}", over_orders(v, lambda v, loc=loc: liberal.parse_phone(v, loc), "x"), base + f"SELECT k, CASE m WHEN 1 THEN '' WHEN 2 THEN '{code}123' WHEN 4 THEN '+7' || l ELSE '{code}' || l END AS x FROM d")
    register(f"phone_validate_{tag}", over_orders(v, lambda v, loc=loc: liberal.validate_phone(v, loc), "x"), base + "SELECT k, CAST(CASE WHEN m IN (2, 4) THEN 1 ELSE 0 END AS INTEGER) AS x FROM d")
    register(f"phone_normalize_{tag}", over_orders(v, lambda v, loc=loc: liberal.normalize_phone(v, loc), "x"), base + f"SELECT k, CASE WHEN m IN (0, 3, 5) THEN '{code}' || l END AS x FROM d")
    wrong = n + 1 < own.phone_digits - 2  # the other country's number may also be too short
    strict_check(f"phone_strict_{tag}", v, v, s.ColumnDef("phone", locale=loc), [("v = '123'", 2, "Invalid phone number"), ("starts_with(v, '+7 ')", 2, "Invalid phone number" if wrong else "Wrong country code")])

    # booleans
    yes, no = own.true_values[0], own.false_values[0]
    v = f"CASE o_orderkey % 6 WHEN 0 THEN '{yes}' WHEN 1 THEN '' WHEN 2 THEN '{no}' WHEN 3 THEN 'belki' WHEN 4 THEN ' {own.true_values[0][0].upper()}' || '{own.true_values[0][1:]} ' ELSE '0' END"
    base = "WITH d AS (SELECT o_orderkey AS k, o_orderkey % 6 AS m FROM orders) "
    register(f"boolean_parse_{tag}", over_orders(v, lambda v, loc=loc: liberal.parse_boolean(v, loc), "x"), base + "SELECT k, CASE WHEN m IN (0, 4) THEN true WHEN m IN (2, 5) THEN false END AS x FROM d")
    register(f"boolean_validate_{tag}", over_orders(v, lambda v, loc=loc: liberal.validate_boolean(v, loc), "x"), base + "SELECT k, CAST(CASE WHEN m = 3 THEN 1 ELSE 0 END AS INTEGER) AS x FROM d")
    register(f"boolean_normalize_{tag}", over_orders(v, lambda v, loc=loc: liberal.normalize_boolean(v, loc), "x"), base + "SELECT k, CASE WHEN m IN (0, 4) THEN 'true' WHEN m IN (2, 5) THEN 'false' END AS x FROM d")
    strict_check(f"boolean_strict_{tag}", v, v, s.ColumnDef("boolean", locale=loc), [("v = 'belki'", 2, "Invalid boolean value")])

register("leap_year", lambda sp, d: table(sp, d, "orders").select(F.col("o_orderkey").alias("k"), dates.is_leap_year(F.year("o_orderdate") + F.col("o_orderkey").cast("int") % 400).alias("x")),
         "SELECT o_orderkey AS k, (y % 4 = 0 AND y % 100 <> 0) OR y % 400 = 0 AS x FROM (SELECT o_orderkey, year(o_orderdate) + o_orderkey % 400 AS y FROM orders)")
register("days_in_month", lambda sp, d: table(sp, d, "orders").select(F.col("o_orderkey").alias("k"), dates.days_in_month(F.month("o_orderdate"), F.year("o_orderdate")).alias("x")),
         "SELECT o_orderkey AS k, CAST(day(last_day(o_orderdate)) AS INTEGER) AS x FROM orders")

# ---------------------------------------------------------------- similarity and mapping

PAIRS_SQL = "WITH p AS (SELECT p_partkey AS k, p_name AS a, lead(p_name) OVER (ORDER BY p_partkey) AS b FROM part), q AS (SELECT * FROM p WHERE b IS NOT NULL) "


def name_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each part's name with that of the next part (keys have no gaps)."""
    part = spread(table(spark, sf_dir, "part"))
    nxt = part.select((F.col("p_partkey") - 1).alias("k"), F.col("p_name").alias("b"))
    return part.select(F.col("p_partkey").alias("k"), F.col("p_name").alias("a")).join(nxt, "k")


def pair_query(fn: Callable) -> Query:
    return lambda sp, d: name_pairs(sp, d).select("k", fn(F.col("a"), F.col("b")).alias("x"))


SIMILAR = "CASE WHEN {0} = {1} THEN 1.0 ELSE 1 - levenshtein({0}, {1}) / CAST(greatest(length({0}), length({1})) AS DOUBLE) END"
NORMAL = "regexp_replace(translate(lower(trim({})), '_-', '  '), '\\s+', ' ', 'g')"
TOKENS = "list_filter(string_split({}, ' '), lambda y: y <> '')"
SIDE = "list_avg(list_transform({0}, lambda s: list_max(list_transform({1}, lambda t: " + SIMILAR.format("s", "t") + "))))"
register("levenshtein_names", pair_query(F.levenshtein), PAIRS_SQL + "SELECT k, CAST(levenshtein(a, b) AS INTEGER) AS x FROM q")
register("levenshtein_similarity", pair_query(lambda a, b: F.round(similarity.levenshtein_similarity_column(a, b), 6)), PAIRS_SQL + f"SELECT k, round(CAST({SIMILAR.format('a', 'b')} AS DOUBLE), 6) AS x FROM q")
register("token_similarity", pair_query(lambda a, b: F.round(similarity.token_similarity_column(a, b), 6)), PAIRS_SQL + f"SELECT k, round((x1 + x2) / 2, 6) AS x FROM (SELECT k, {SIDE.format('ta', 'tb')} AS x1, {SIDE.format('tb', 'ta')} AS x2 FROM (SELECT k, {TOKENS.format(NORMAL.format('a'))} AS ta, {TOKENS.format(NORMAL.format('b'))} AS tb FROM q))")
FIRST_WORD = "CASE WHEN k % 2 = 0 THEN {0}(a, ' ', {1}) ELSE {0}(b, ' ', {1}) END"
register("contains_match", lambda sp, d: name_pairs(sp, d).select("k", similarity.contains_match_column(F.col("a"), F.upper(F.expr(FIRST_WORD.format("substring_index", 1)))).alias("x")),
         PAIRS_SQL + f"SELECT k, length(h) >= 3 AND length(t) >= 3 AND (contains(h, t) OR contains(t, h)) AS x FROM (SELECT k, {NORMAL.format('a')} AS h, {NORMAL.format('upper(' + FIRST_WORD.format('split_part', 1) + ')')} AS t FROM q)")
register("common_prefix", pair_query(similarity.common_prefix_length_column), PAIRS_SQL + "SELECT k, CAST(coalesce(list_max(list_filter(range(0, least(length(a), length(b)) + 1), lambda i: left(a, i) = left(b, i))), 0) AS INTEGER) AS x FROM q")
register("normalize_headers", lambda sp, d: table(sp, d, "part").select(F.col("p_partkey").alias("k"), similarity.normalize_column(F.concat(F.lit("  "), F.upper("p_name"), F.lit("__Id-"), F.col("p_brand"))).alias("x")),
         f"SELECT p_partkey AS k, {NORMAL.format(chr(39) + '  ' + chr(39) + ' || upper(p_name) || ' + chr(39) + '__Id-' + chr(39) + ' || p_brand')} AS x FROM part")
register("tokenize_headers", lambda sp, d: table(sp, d, "part").select(F.col("p_partkey").alias("k"), F.array_join(similarity.tokenize_column(F.concat("p_name", F.lit("_-"), F.col("p_brand"))), "|").alias("x")),
         f"SELECT p_partkey AS k, array_to_string({TOKENS.format(NORMAL.format('p_name || ' + chr(39) + '_-' + chr(39) + ' || p_brand'))}, '|') AS x FROM part")
#: The similarity of ``h`` and ``t`` (normalised) of a table n, as a table r with a column score.
SCORED = f"""
    m AS (SELECT *, {TOKENS.format('h')} AS ta, {TOKENS.format('t')} AS tb, coalesce(list_max(list_filter(range(0, least(length(h), length(t)) + 1), lambda i: left(h, i) = left(t, i))), 0) AS p,
          CAST(greatest(length(h), length(t)) AS DOUBLE) AS hi, least(length(h), length(t)) AS lo FROM n),
    r AS (SELECT *, round(CASE WHEN h = t THEN 1.0 ELSE greatest({SIMILAR.format('h', 't')}, CASE WHEN lo >= 3 AND (contains(h, t) OR contains(t, h)) THEN 0.7 + 0.2 * lo / hi ELSE 0 END,
        ({SIDE.format('ta', 'tb')} + {SIDE.format('tb', 'ta')}) / 2, CASE WHEN p >= 3 THEN 0.5 + 0.4 * p / hi ELSE 0 END) END, 6) AS score FROM m)"""
register("compute_similarity", pair_query(lambda a, b: F.round(similarity.similarity_column(a, b), 6)), PAIRS_SQL + f", n AS (SELECT k, {NORMAL.format('a')} AS h, {NORMAL.format('b')} AS t FROM q), {SCORED} SELECT k, score AS x FROM r")

CATALOGUE = s.Schema({
    "price": s.ColumnDef("number", aliases=("unit price", "amount")), "email": s.ColumnDef("string", [s.email()], aliases=("mail", "e-mail", "email address")), "phone": s.ColumnDef("phone", aliases=("tel", "gsm")),
    "created_at": s.ColumnDef("date", aliases=("date", "creation date")), "name": s.ColumnDef("string", aliases=("title", "product name")), "stock": s.ColumnDef("integer", aliases=("quantity", "qty")),
})
HEADERS = ("Unit-Price", "E-Mail", "telephone", "createdAt", "Product Nam", "qty", "misc")


def headers_frame(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame([(h,) for h in HEADERS], "header string")


def text_rows(rows: list[tuple[str, ...]]) -> str:
    return ", ".join("(" + ", ".join(f"'{quoted(x)}'" for x in r) + ")" for r in rows)


CANDIDATES = [(name, x) for name, c in CATALOGUE.columns.items() for x in (name, *c.aliases)]
register("map_columns_scores", lambda sp, d: mapping.score_frame(headers_frame(sp), CATALOGUE).where("score >= 0.6").select("header", "schema_column", F.round("score", 6).alias("score")), f"""
    WITH n AS (SELECT header, schema_column, {NORMAL.format('header')} AS h, {NORMAL.format('matched')} AS t FROM (VALUES {text_rows([(h,) for h in HEADERS])}) AS a(header), (VALUES {text_rows(CANDIDATES)}) AS b(schema_column, matched)),
    {SCORED} SELECT header, schema_column, max(score) AS score FROM r GROUP BY header, schema_column HAVING max(score) >= 0.6""")
#: The driver's search for the best match of each header and column, which stops at an exact one.
register("best_matches", lambda sp, d: sp.createDataFrame([(h, n, round(similarity.compute_best_match(h, n, c.aliases)[0], 6)) for h in HEADERS for n, c in CATALOGUE.columns.items()], "header string, schema_column string, score double"),
         SQL["map_columns_scores"].replace(" HAVING max(score) >= 0.6", ""))
register("map_columns_best", lambda sp, d: mapping.mapping_frame(sp, mapping.map_columns(HEADERS, CATALOGUE)).select("csv_index", "schema_column", "confidence"), """
    SELECT CAST(i AS INTEGER) AS csv_index, c AS schema_column, k AS confidence FROM (VALUES (0, 'price', 'alias'), (1, 'email', 'alias'), (2, 'phone', 'fuzzy'), (3, 'created_at', 'fuzzy'), (4, 'name', 'fuzzy'), (5, 'stock', 'alias'), (6, '', 'none')) AS t(i, c, k)""")

NATION = s.Schema({"region": s.ColumnDef("integer", aliases=("n_regionkey",)), "name": s.ColumnDef("string", [s.required()], aliases=("n_name",)), "key": s.ColumnDef("integer", [s.maximum(20)], aliases=("n_nationkey",))})
WIDER = s.Schema({"name": s.ColumnDef("string", aliases=("n_name",)), "capital": s.ColumnDef("string")})


def mapped_nation(spark: SparkSession, sf_dir: str, schema: s.Schema, edit: tuple[int, str] | None = None) -> DataFrame:
    df = table(spark, sf_dir, "nation")
    found = mapping.map_columns(df.columns, schema).matches
    return mapping.apply_mapping(df, mapping.update_mapping(found, *edit) if edit else found, schema)


register("apply_mapping_reorder", lambda sp, d: mapped_nation(sp, d, NATION), "SELECT CAST(n_regionkey AS VARCHAR) AS region, n_name AS name, CAST(n_nationkey AS VARCHAR) AS key FROM nation")
register("apply_mapping_missing", lambda sp, d: mapped_nation(sp, d, WIDER), "SELECT n_name AS name, '' AS capital FROM nation")
register("manual_mapping", lambda sp, d: mapped_nation(sp, d, NATION, (0, "name")), "SELECT CAST(n_regionkey AS VARCHAR) AS region, CAST(n_nationkey AS VARCHAR) AS name, '' AS key FROM nation")
register("map_and_validate", lambda sp, d: mapping.map_and_validate(table(sp, d, "nation").withColumn("_row", F.col("n_nationkey").cast("long")), NATION)[2].errors,
         "SELECT CAST(n_nationkey AS BIGINT) AS \"row\", CAST(2 AS INTEGER) AS col, 'key' AS field, CAST(n_nationkey AS VARCHAR) AS value, CAST(4 AS INTEGER) AS code, 'Value must be at most 20' AS message FROM nation WHERE n_nationkey > 20")

# ---------------------------------------------------------------- delimited text


def exported(spark: SparkSession, df: DataFrame, label: str, options: delimited.Options) -> str:
    """The frame as delimited text in the session's shared folder."""
    path = f"{shared_dir(spark)}/gristmill-text/{spark.sparkContext.applicationId}/{label}"
    delimited.write_delimited(df, path, options, mode="overwrite")
    return path


def quoted_part(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "part").select(F.col("p_partkey").cast("string").alias("key"), F.concat(F.lit('say "'), F.col("p_name"), F.lit('", twice')).alias("name"), F.when(F.col("p_partkey") % 7 == 0, F.lit("")).otherwise(F.col("p_brand")).alias("brand"))


QUOTED_SQL = "SELECT CAST(p_partkey AS VARCHAR) AS key, 'say \"' || p_name || '\", twice' AS name, CASE WHEN p_partkey % 7 = 0 THEN '' ELSE p_brand END AS brand FROM part"


def csv_query(label: str, options: delimited.Options = delimited.Options(), finish: Callable[[DataFrame], DataFrame] = lambda df: df, compatible: bool = False) -> Query:
    def query(spark: SparkSession, sf_dir: str) -> DataFrame:
        path = exported(spark, quoted_part(spark, sf_dir), label, options)
        if compatible:
            return finish(delimited.columns_of(delimited.read_compatible(spark, path + "/*.csv", options), ["key", "name", "brand"]).drop("_row"))
        return finish(delimited.read_native(spark, path, options))

    return query


register("csv_roundtrip", csv_query("roundtrip"), QUOTED_SQL)
register("csv_semicolon", csv_query("semicolon", delimited.Options(delimiter=";")), QUOTED_SQL)
register("csv_tab", csv_query("tab", delimited.Options(delimiter="\t")), QUOTED_SQL)
register("csv_no_header", csv_query("no_header", delimited.Options(header=False)), QUOTED_SQL.replace("AS key", "AS _c0").replace("AS name", "AS _c1").replace("AS brand", "AS _c2"))
register("csv_compatible", csv_query("compatible", compatible=True), QUOTED_SQL)


def ordered_file(spark: SparkSession, sf_dir: str, label: str) -> DataFrame:
    """``quoted_part`` by key in one file, read with row numbers."""
    df = quoted_part(spark, sf_dir).orderBy(F.col("key").cast("long")).coalesce(1)
    return with_rows(delimited.read_native(spark, exported(spark, df, label, delimited.Options())))


register("csv_max_rows", lambda sp, d: delimited.first_rows(ordered_file(sp, d, "max_rows"), 100).drop("_row"), QUOTED_SQL + " ORDER BY p_partkey LIMIT 100")
register("csv_preview", lambda sp, d: delimited.preview(ordered_file(sp, d, "preview")), QUOTED_SQL.replace("SELECT ", "SELECT CAST(row_number() OVER (ORDER BY p_partkey) - 1 AS BIGINT) AS _row, ", 1) + " ORDER BY p_partkey LIMIT 10")


def text_file(spark: SparkSession, sf_dir: str, label: str, line: str, ending: str = "\n") -> str:
    """One file of lines made from nation by an expression, behind a header, in the order of keys."""
    lines = table(spark, sf_dir, "nation").select(F.col("n_nationkey").cast("int").alias("k"), F.expr(line).alias("value")).unionByName(spark.createDataFrame([(-1, "key,name,region")], "k int, value string"))
    path = f"{shared_dir(spark)}/gristmill-text/{spark.sparkContext.applicationId}/{label}"
    lines.orderBy("k").coalesce(1).select("value").write.mode("overwrite").text(path, lineSep=ending)
    return path


def compatible_rows(label: str, line: str, ending: str = "\n", options: delimited.Options = delimited.Options()) -> Query:
    return lambda sp, d: delimited.columns_of(delimited.read_compatible(sp, text_file(sp, d, label, line, ending) + "/*.txt", options), ["key", "name", "region"])


KEY, REGION = "CAST(n_nationkey AS STRING)", "CAST(n_regionkey AS STRING)"
#: Without quotes a row's last field runs to the line's end, whatever it holds.
register("csv_plain_long_rows", compatible_rows("plain_long", f"{KEY} || ',' || n_name || ',' || {REGION} || CASE WHEN n_nationkey % 3 = 0 THEN ',more' ELSE '' END", "\r\n"),
         f"SELECT CAST(n_nationkey AS BIGINT) AS _row, {KEY} AS key, n_name AS name, {REGION} || CASE WHEN n_nationkey % 3 = 0 THEN ',more' ELSE '' END AS region FROM nation")
#: A short row without quotes takes its missing fields from the next line; at the end of the text it is one field.
register("csv_plain_short_rows", compatible_rows("plain_short", f"{KEY} || ',' || n_name || CASE WHEN n_nationkey % 2 = 1 THEN ',' || {REGION} ELSE '' END"),
         f"""WITH a AS (SELECT n_nationkey AS k, n_name AS n, {REGION} AS r FROM nation)
         SELECT CAST(a.k // 2 AS BIGINT) AS _row, CASE WHEN b.k IS NULL THEN a.k || ',' || a.n ELSE CAST(a.k AS STRING) END AS key, CASE WHEN b.k IS NULL THEN '' ELSE a.n || chr(10) || b.k END AS name,
         CASE WHEN b.k IS NULL THEN '' ELSE b.n || ',' || b.r END AS region FROM a LEFT JOIN a b ON b.k = a.k + 1 WHERE a.k % 2 = 0""")
#: With quotes a short row is padded, a blank line is a row of empty fields, and a quoted field holds quotes and line breaks.
RAGGED = f"CASE WHEN n_nationkey % 2 = 0 THEN '\"' || {KEY} || '\",' || n_name ELSE {KEY} || ',\"' || n_name || chr(10) || '\"\"x\"\"\",' || {REGION} END"
RAGGED_SQL = f"SELECT n_nationkey AS k, {KEY} AS key, CASE WHEN n_nationkey % 2 = 0 THEN n_name ELSE n_name || chr(10) || '\"x\"' END AS name, CASE WHEN n_nationkey % 2 = 0 THEN '' ELSE {REGION} END AS region FROM nation"
BLANKS = f"{RAGGED} || CASE WHEN n_nationkey % 5 = 0 THEN chr(10) ELSE '' END"
register("csv_quoted_ragged", compatible_rows("ragged", BLANKS), f"""WITH a AS ({RAGGED_SQL}), b AS (SELECT k, 0 AS blank, key, name, region FROM a UNION ALL SELECT k, 1, '', '', '' FROM a WHERE k % 5 = 0)
    SELECT CAST(row_number() OVER (ORDER BY k, blank) - 1 AS BIGINT) AS _row, key, name, region FROM b""")
register("csv_quoted_no_blanks", compatible_rows("no_blanks", BLANKS, options=delimited.Options(skip_empty_lines=True)), f"SELECT CAST(k AS BIGINT) AS _row, key, name, region FROM ({RAGGED_SQL})")
register("csv_native_lines", lambda sp, d: delimited.read_native(sp, text_file(sp, d, "native_lines", RAGGED)), f"SELECT key, name, region FROM ({RAGGED_SQL})")
register("csv_native_split", lambda sp, d: delimited.read_native(sp, text_file(sp, d, "native_split", f"{KEY} || ',\"' || n_name || ', \"\"x\"\"\",' || {REGION}"), delimited.Options(multiline=False)), f"SELECT {KEY} AS key, n_name || ', \"x\"' AS name, {REGION} AS region FROM nation")
register("csv_other_quote", lambda sp, d: delimited.columns_of(delimited.read_compatible(sp, text_file(sp, d, "other_quote", f"{KEY} || ',~' || n_name || ', ~~x~~~,' || {REGION}") + "/*.txt", delimited.Options(quote="~")), ["key", "name", "region"]).drop("_row"),
         f"SELECT {KEY} AS key, n_name || ', ~x~' AS name, {REGION} AS region FROM nation")


def from_string(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A literal text of a small table."""
    rows = table(spark, sf_dir, "nation").select(F.col("n_nationkey").cast("string"), "n_name", F.col("n_regionkey").cast("string")).collect()
    return delimited.read_string(spark, delimited.to_text(["key", "name", "region"], [list(r) for r in rows])).drop("_row")


register("csv_from_string", from_string, f"SELECT {KEY} AS key, n_name AS name, {REGION} AS region FROM nation")
register("csv_skip_empty", lambda sp, d: delimited.skip_empty(table(sp, d, "part").select(*[F.when(F.col("p_partkey") % 3 == 0, F.lit("")).otherwise(F.col(c).cast("string")).alias(c) for c in ("p_partkey", "p_name")])), "SELECT CAST(p_partkey AS VARCHAR) AS p_partkey, p_name FROM part WHERE p_partkey % 3 <> 0")
register("parse_and_validate", lambda sp, d: parse_and_validate(sp, exported(sp, quoted_part(sp, d), "validated", delimited.Options()), s.Schema({"key": s.ColumnDef("integer", [s.maximum(50)]), "name": s.ColumnDef(), "brand": s.ColumnDef("string", [s.required()])})).counts(),
         "SELECT * FROM (SELECT 'key' AS field, 'max' AS rule, count(*) FILTER (p_partkey > 50) AS n FROM part UNION ALL SELECT 'brand', 'required', count(*) FILTER (p_partkey % 7 = 0) FROM part) WHERE n > 0")


def session_import(spark: SparkSession, sf_dir: str) -> DataFrame:
    session = ImportSession(spark, CUSTOMER)
    session.load_frame(customers(spark, sf_dir))
    return session.validation.stats()


register("session_import", session_import, CELLS_SQL + STATS_SQL)


def accepted(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The statistics of an accepted import, as its result has them."""
    session = ImportSession(spark, CUSTOMER)
    session.load_frame(customers(spark, sf_dir))
    stats = session.accept().stats
    names = ("total_rows", "valid_rows", "invalid_rows", "error_count")
    return spark.createDataFrame([tuple(int(stats[n]) for n in names)], ", ".join(f"{n} long" for n in names))


register("import_stats", accepted, CELLS_SQL + STATS_SQL.replace("AS error_rows", "AS invalid_rows"))


def auto_maps(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Whether mappings need no review: all schema columns mapped, fuzzy ones with the threshold at least."""
    nation = mapping.map_columns(table(spark, sf_dir, "nation").columns, NATION)
    loose = mapping.map_columns(["Unit-Price", "email", "tel", "createdAt", "Product Nam", "qty"], CATALOGUE)
    rows = [("aliases", 0.8, nation), ("missing", 0.8, mapping.map_columns(HEADERS[:3], CATALOGUE)), ("fuzzy", 0.8, loose), ("fuzzy", 0.91, loose)]
    return spark.createDataFrame([(n, t, mapping.should_auto_map(m, t), len(m.unmapped_schema)) for n, t, m in rows], "name string, threshold double, auto boolean, missing int")


#: createdAt scores 0.9 (one missing character of ten) and Product Nam 0.916667.
register("auto_map", auto_maps, "SELECT * FROM (VALUES ('aliases', 0.8::DOUBLE, true, 0), ('missing', 0.8, false, 3), ('fuzzy', 0.8, true, 0), ('fuzzy', 0.91, false, 0)) AS t(name, threshold, auto, missing)")


def recounted(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A session's mapping after changes by hand: matches that are sure, need review, are open."""
    session = ImportSession(spark, CATALOGUE, auto_map=False)
    session.load_frame(spark.createDataFrame([("x",) * len(HEADERS)], ", ".join(f"`{h}` string" for h in HEADERS)))
    rows = []
    for step, edit in (("first", None), ("moved", (6, "stock")), ("cleared", (0, None))):
        if edit:
            session.update_mapping(*edit)
        m = session.state.mapping
        rows.append((step, m.auto_mapped, m.needs_review, m.unmapped, ",".join(m.unmapped_schema), ",".join(x.schema_column for x in m.matches)))
    return spark.createDataFrame(rows, "step string, sure int, review int, open int, unmapped string, columns string")


register("mapping_recount", recounted, """SELECT * FROM (VALUES ('first', 6, 0, 1, '', 'price,email,phone,created_at,name,stock,'), ('moved', 3, 3, 1, '', 'price,email,phone,created_at,name,,stock'),
    ('cleared', 2, 3, 2, 'price', ',email,phone,created_at,name,,stock')) AS t(step, sure, review, open, unmapped, columns)""")
