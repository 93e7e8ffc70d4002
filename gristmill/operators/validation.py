"""Validation of tables: codes per cell, the error table, statistics.

Codes are columns of one narrow projection, so statistics are one aggregate
over the scan. Only rows whose largest code isn't 0 build and explode
an array of errors. Repeated values are found on (column, value) with a map-side
aggregate and a join that adaptive execution can split, so a value that a
third of all rows share doesn't end in one task.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import cached_property

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..schema import DUPLICATE, Schema
from .compiler import CUSTOM_BASE, UNIQUE_CODE, CompiledSchema, compile_schema, public_code

ROW, CODES = "_row", "_codes"
#: Partitions whose first row numbers are broadcast (16 MB); beyond that they are joined.
OFFSETS = 1_000_000
ERRORS = T.StructType([T.StructField("row", T.LongType()), T.StructField("col", T.IntegerType()), T.StructField("field", T.StringType()), T.StructField("value", T.StringType()), T.StructField("code", T.IntegerType()), T.StructField("message", T.StringType())])


def with_rows(df: DataFrame, order_by: list[str] | None = None) -> DataFrame:
    """A 0-based column ``_row``: by ``order_by`` (a global sort), or in file order without a shuffle.

    File order counts the rows of each partition first, so only one number a
    partition comes to the driver.
    """
    if ROW in df.columns:
        return df
    if order_by:
        df = df.orderBy(*order_by)
    tagged = df.select("*", F.monotonically_increasing_id().alias(ROW))
    part = F.shiftright(F.col(ROW), 33)
    counts = {r.p: r.n for r in tagged.groupBy(part.alias("p")).agg(F.count(F.lit(1)).alias("n")).collect()}
    total, offsets = 0, []
    for p in sorted(counts):
        offsets.append((p, total))
        total += counts[p]
    before = df.sparkSession.createDataFrame(offsets, "_part long, _before long")
    before = F.broadcast(before) if len(offsets) <= OFFSETS else before  # 16 bytes a partition
    row = (F.col("_before") + F.col(ROW).bitwiseAND(F.lit((1 << 33) - 1))).alias(ROW)
    return tagged.join(before, part == F.col("_part")).select(*[F.col(f"`{c}`") for c in df.columns], row)


def _custom(rule, v: Column, eligible: Column) -> Column:
    """Whether an eligible value fails; Python sees only eligible values, a whole batch at a time."""
    if rule.native:
        return eligible & ~F.coalesce(rule.fn(v), F.lit(False))
    fn = rule.fn

    @F.pandas_udf("boolean")
    def passes(values: pd.Series) -> pd.Series:
        return values.map(lambda x: True if x is None else bool(fn(x))).astype(bool)

    return eligible & ~passes(F.when(eligible, v))


class Validation:
    """A lazy result: frames are built on access, and nothing runs before an action."""

    def __init__(self, data: DataFrame, compiled: CompiledSchema, rows: bool = True):
        self.compiled = compiled
        self.data, self.rows = data, rows
        self.has_unique = any(c.unique for c in compiled.columns)

    def _cells(self, data: DataFrame) -> DataFrame:
        names, have = self.compiled.names, set(data.columns)
        cells = [F.coalesce(F.col(f"`{n}`").cast("string"), F.lit("")).alias(f"v{i}") if n in have else F.lit("").alias(f"v{i}") for i, n in enumerate(names)]
        return data.select(ROW, *cells)

    @property
    def _unnumbered(self) -> DataFrame:
        """The data with row numbers only if it came with them: counts need none, nor the scan that numbers rows."""
        return self.data if ROW in self.data.columns else self.data.withColumn(ROW, F.lit(0).cast("long"))

    @cached_property
    def values(self) -> DataFrame:
        """_row and the cells v0 ..."""
        return self._cells(with_rows(self.data) if self.rows else self._unnumbered)

    @cached_property
    def checked(self) -> DataFrame:
        """_row, the values v0 ..., the codes c0 ... (rules, then customs; repeated values are apart)."""
        return self._checked(self.values)

    def _checked(self, values: DataFrame) -> DataFrame:
        numbers = {i: F.col(f"n{i}") for i, c in enumerate(self.compiled.columns) if c.number}
        out = values.select("*", *[self.compiled.columns[i].number(F.col(f"v{i}")).alias(f"n{i}") for i in numbers])
        out = out.select(*values.columns, *[c.fn(F.col(f"v{i}"), numbers.get(i)).alias(f"c{i}") for i, c in enumerate(self.compiled.columns)])
        for i, c in enumerate(self.compiled.columns):
            code, v = F.col(f"c{i}"), F.col(f"v{i}")
            for k, rule in enumerate(c.customs):
                fails = _custom(rule, v, (F.col(f"c{i}") == 0) & (v != ""))
                out = out.withColumn(f"c{i}", F.when(fails, F.lit(CUSTOM_BASE + k)).otherwise(code).cast("smallint"))
        return out

    @property
    def bad(self) -> Column:
        """Whether a row has a code."""
        codes = [F.col(f"c{i}") for i in range(self.compiled.count)]
        return (F.greatest(*codes) if len(codes) > 1 else codes[0]) > 0 if codes else F.lit(False)

    @cached_property
    def duplicates(self) -> DataFrame:
        """row, col, value, custom (the cell's code before), clean (the row had no code): values seen in an earlier row."""
        cells = []
        for i, c in enumerate(self.compiled.columns):
            if c.unique:
                code, v = F.col(f"c{i}"), F.col(f"v{i}")
                cells.append(F.when((v != "") & ((code == 0) | (code >= CUSTOM_BASE)), F.struct(F.lit(i).alias("col"), v.alias("value"), code.alias("custom"))))
        if not cells:
            return self.data.sparkSession.createDataFrame([], "row long, col int, value string, custom smallint, clean boolean")
        long = self.checked.select(F.col(ROW).alias("row"), (~self.bad).alias("clean"), F.explode(F.array_compact(F.array(*cells))).alias("x")).select("row", "x.*", "clean")
        # values travel only if the hash of theirs occurs again; the hash proposes, the value decides
        twice = long.groupBy("col", F.xxhash64("value").alias("hash")).agg(F.count(F.lit(1)).alias("n")).where("n > 1").select(F.col("col").alias("_col"), F.col("hash").alias("_hash"))
        long = long.join(twice, (F.col("col") == F.col("_col")) & (F.xxhash64("value") == F.col("_hash")), "left_semi")
        seen = long.groupBy("col", "value").agg(F.min("row").alias("first"), F.count(F.lit(1)).alias("n")).where("n > 1")
        return long.join(seen, ["col", "value"]).where("row > first").select("row", "col", "value", "custom", "clean")

    @cached_property
    def errors(self) -> DataFrame:
        """The error table: row, col, field, value, code, message; at most one a cell, in no order."""
        structs = []
        for i, c in enumerate(self.compiled.columns):
            code = F.col(f"c{i}")
            message, public = F.lit(None).cast("string"), F.lit(0)
            known = {k: m for k, (_, m) in c.errors.items()} | {CUSTOM_BASE + k: r.message or "Custom validation failed" for k, r in enumerate(c.customs)}
            for internal, text in known.items():
                message = F.when(code == internal, F.lit(text)).otherwise(message)
                public = F.when(code == internal, F.lit(public_code(c, internal))).otherwise(public)
            structs.append(F.when(code > 0, F.struct(F.lit(i).alias("col"), F.lit(c.name).alias("field"), F.col(f"v{i}").alias("value"), public.alias("code"), message.alias("message"))))
        if not structs:
            return self.data.sparkSession.createDataFrame([], ERRORS)
        own = self.checked.select(F.col(ROW).alias("row"), F.explode(F.when(self.bad, F.array_compact(F.array(*structs)))).alias("e")).select("row", "e.*")
        if not self.has_unique:
            return own
        again = self.duplicates
        if any(c.unique and c.customs for c in self.compiled.columns):
            own = own.join(again.where("custom > 0").select("row", "col"), ["row", "col"], "left_anti")
        names = F.array(*[F.lit(n) for n in self.compiled.names])
        return own.select(*ERRORS.names).unionByName(again.select("row", "col", F.element_at(names, F.col("col") + 1).alias("field"), "value", F.lit(public_code(self.compiled.columns[0], UNIQUE_CODE)).alias("code"), F.lit(DUPLICATE).alias("message")))

    @cached_property
    def codes(self) -> DataFrame:
        """_row, the data columns under their names, and _codes: one internal code a column."""
        base, names = self.checked, self.compiled.names
        codes = [F.col(f"c{i}") for i in range(len(names))]
        if self.has_unique:
            again = self.duplicates.groupBy("row").agg(F.collect_set("col").alias("again")).withColumnRenamed("row", "_again_row")
            base = base.join(again, F.col(ROW) == F.col("_again_row"), "left")
            codes = [F.when(F.array_contains("again", i), F.lit(UNIQUE_CODE).cast("smallint")).otherwise(c) if self.compiled.columns[i].unique else c for i, c in enumerate(codes)]
        return base.select(ROW, *[F.col(f"v{i}").alias(n) for i, n in enumerate(names)], F.array(*codes).alias(CODES))

    def _counts(self) -> DataFrame:
        """One row: rows, error rows, and the count of each (column, internal code).

        Rows are first counted by their combination of codes, of which there are
        few, packed into one number (or several, if there are many columns); the
        sums are taken over those.
        """
        known = [[*c.errors, *range(CUSTOM_BASE, CUSTOM_BASE + len(c.customs))] for c in self.compiled.columns]
        packs: list[Column] = []
        place: list[tuple[int, int, int]] = []  # of each column: its number, what it is multiplied by, how many codes it has
        size = 1 << 63
        for i, c in enumerate(self.compiled.columns):
            n, code = len(known[i]) + 1, F.col(f"c{i}").cast("long")
            if c.customs:  # customs follow the other codes at once
                code = F.when(code >= CUSTOM_BASE, code - (CUSTOM_BASE - 1 - len(c.errors))).otherwise(code)
            if size * n >= 1 << 62:
                size = 1
                packs.append(F.lit(0).cast("long"))
            place.append((len(packs) - 1, size, n))
            packs[-1] = packs[-1] + code * F.lit(size).cast("long")
            size *= n
        kinds = self._checked(self._cells(self._unnumbered)).select(*[x.alias(f"k{i}") for i, x in enumerate(packs)]).groupBy(*[f"k{i}" for i in range(len(packs))]).agg(F.count(F.lit(1)).alias("n"))
        total = lambda x: F.coalesce(F.sum(x), F.lit(0))
        own = lambda i: F.expr(f"(k{place[i][0]} div {place[i][1]}L) % {place[i][2]}L")
        sums = [total(F.when(own(i) == at, F.col("n"))).alias(f"n{i}_{k}") for i, codes in enumerate(known) for at, k in enumerate(codes, 1)]
        bad = F.lit(False)
        for i in range(len(packs)):
            bad = bad | (F.col(f"k{i}") != 0)
        return kinds.agg(total(F.col("n")).alias("rows"), total(F.when(bad, F.col("n"))).alias("bad"), *sums)

    def counts(self) -> DataFrame:
        """errors by (field, rule): field, rule, n; a cell that fails custom and repeats counts under both."""
        pairs = [F.struct(F.lit(c.name).alias("field"), F.lit(c.errors[k][0] if k in c.errors else "custom").alias("rule"), F.col(f"n{i}_{k}").alias("n"))
                 for i, c in enumerate(self.compiled.columns) for k in [*c.errors, *range(CUSTOM_BASE, CUSTOM_BASE + len(c.customs))]]
        spark = self.data.sparkSession
        out = self._counts().select(F.explode(F.array(*pairs)).alias("x")).select("x.*") if pairs else spark.createDataFrame([], "field string, rule string, n long")
        if self.has_unique:
            names = F.array(*[F.lit(n) for n in self.compiled.names])
            out = out.unionByName(self.duplicates.groupBy("col").agg(F.count(F.lit(1)).alias("n")).select(F.element_at(names, F.col("col") + 1).alias("field"), F.lit("unique").alias("rule"), "n"))
        return out.where("n > 0").groupBy("field", "rule").agg(F.sum("n").alias("n"))

    def errors_by_rule(self) -> DataFrame:
        """rule, n."""
        return self.counts().groupBy("rule").agg(F.sum("n").alias("n"))

    def errors_by_column(self) -> DataFrame:
        """field, n; as by rule, a cell that fails custom and repeats counts twice."""
        return self.counts().groupBy("field").agg(F.sum("n").alias("n"))

    def stats(self) -> DataFrame:
        """One row: total_rows, valid_rows, error_rows, error_count."""
        sums = [F.col(f"n{i}_{k}") for i, c in enumerate(self.compiled.columns) for k in [*c.errors, *range(CUSTOM_BASE, CUSTOM_BASE + len(c.customs))]]
        total = F.lit(0).cast("long")
        for x in sums:
            total = total + x
        one = self._counts().select("rows", "bad", total.alias("errors"))
        if self.has_unique:
            more = self.duplicates.agg(F.count_if(F.col("custom") == 0).alias("more"), F.count_distinct(F.when(F.col("clean"), F.col("row"))).alias("more_rows"))
            one = one.crossJoin(more).select("rows", (F.col("bad") + F.col("more_rows")).alias("bad"), (F.col("errors") + F.col("more")).alias("errors"))
        return one.select(F.col("rows").alias("total_rows"), (F.col("rows") - F.col("bad")).alias("valid_rows"), F.col("bad").alias("error_rows"), F.col("errors").alias("error_count"))

    # ---- access

    def get_errors(self, limit: int = 100, offset: int = 0) -> DataFrame:
        """A page of the error table in row-major order."""
        return self.errors.orderBy("row", "col").offset(offset).limit(limit)

    def get_row_errors(self, row: int) -> DataFrame:
        return self.errors.where(F.col("row") == row).orderBy("col")

    def get_cell_error(self, row: int, col: int) -> DataFrame:
        """At most one row."""
        return self.errors.where((F.col("row") == row) & (F.col("col") == col))

    def error_summary(self) -> dict[str, int]:
        return {r.rule: r.n for r in self.errors_by_rule().collect()}

    def column_error_summary(self) -> dict[str, int]:
        return {r.field: r.n for r in self.errors_by_column().collect()}

    def memory_usage(self) -> int:
        """Bytes that a bitmap and a byte map of the same table take."""
        n = self.data.count()
        return bitmap_bytes(n, self.compiled.count) + code_map_bytes(n, self.compiled.count)

    def summary(self) -> dict:
        """Statistics as a plain mapping."""
        one = self.stats().first()
        return {"valid": one.error_count == 0, "total_rows": one.total_rows, "valid_rows": one.valid_rows, "error_rows": one.error_rows, "error_count": one.error_count, "errors_by_rule": self.error_summary(), "errors_by_column": self.column_error_summary(), "aborted": False}


class Validator:
    """A compiled schema, to be used on any number of tables."""

    def __init__(self, schema: Schema):
        self.schema, self.compiled = schema, compile_schema(schema)

    def validate(self, data: DataFrame) -> Validation:
        """``data`` has string columns named as in the schema; others are ignored, missing ones empty.

        A column ``_row`` numbers the rows; without it they are numbered in file order.
        """
        return Validation(data, self.compiled)

    def column_names(self) -> list[str]:
        return list(self.compiled.names)

    def column_count(self) -> int:
        return self.compiled.count


def validate(data: DataFrame, schema: Schema) -> Validation:
    return Validator(schema).validate(data)


# ---------------------------------------------------------------- the error matrix


def bitmap_bytes(rows: int, cols: int) -> int:
    """One bit a cell, in words of 32."""
    return -(-rows * cols // 32) * 4


def code_map_bytes(rows: int, cols: int) -> int:
    return rows * cols


class ErrorMatrix:
    """Operations on a frame with ``_row`` and the array ``_codes``."""

    def __init__(self, codes: DataFrame, columns: int):
        self.df, self.columns = codes, columns

    @staticmethod
    def blank(df: DataFrame, columns: int) -> ErrorMatrix:
        """All cells without an error."""
        return ErrorMatrix(with_rows(df).withColumn(CODES, F.array_repeat(F.lit(0).cast("smallint"), columns)), columns)

    def _flag(self) -> Column:
        return F.exists(CODES, lambda x: x != 0)

    def set_code(self, row: int, col: int, code: int = 1) -> ErrorMatrix:
        """Another matrix with that cell's code; a row that isn't there changes nothing."""
        if not 0 <= col < self.columns:
            return self
        put = F.transform(CODES, lambda x, i: F.when(i == col, F.lit(code).cast("smallint")).otherwise(x))
        return ErrorMatrix(self.df.withColumn(CODES, F.when(F.col(ROW) == row, put).otherwise(F.col(CODES))), self.columns)

    def get_code(self, row: int, col: int) -> int:
        got = self.df.where(F.col(ROW) == row).select(F.try_element_at(CODES, F.lit(col + 1)).alias("c")).first()
        return int(got.c) if got and got.c is not None else 0

    def has_error(self, row: int, col: int) -> bool:
        return self.get_code(row, col) != 0

    def has_row_error(self, row: int) -> bool:
        return not self.df.where((F.col(ROW) == row) & self._flag()).isEmpty()

    def rows_with_errors(self) -> DataFrame:
        return self.df.where(self._flag()).select(ROW)

    def counts(self) -> DataFrame:
        """One row: errors, error_rows."""
        n = F.size(F.filter(CODES, lambda x: x != 0))
        return self.df.agg(F.coalesce(F.sum(n), F.lit(0)).cast("long").alias("errors"), F.count_if(self._flag()).alias("error_rows"))

    def column_errors(self, col: int) -> DataFrame:
        """The rows with an error in the column, ascending."""
        return self.df.where(F.element_at(CODES, col + 1) != 0).select(ROW).orderBy(ROW)

    def row_error_columns(self) -> DataFrame:
        """Per row with errors its columns, ascending."""
        places = F.filter(F.sequence(F.lit(0), F.lit(self.columns - 1)), lambda i: F.element_at(CODES, i + 1) != 0)
        return self.df.where(self._flag()).select(ROW, places.alias("cols"))

    def cells(self) -> DataFrame:
        """row, col, code of each error."""
        return self.df.where(self._flag()).select(F.col(ROW).alias("row"), F.posexplode(CODES).alias("col", "code")).where("code <> 0")

    def for_each_error(self) -> Iterator:
        """Row-major, without holding all of them."""
        return self.cells().orderBy("row", "col").toLocalIterator()

    def byte_size(self) -> int:
        return bitmap_bytes(self.df.count(), self.columns)

    def clear(self) -> ErrorMatrix:
        return ErrorMatrix(self.df.withColumn(CODES, F.transform(CODES, lambda x: F.lit(0).cast("smallint"))), self.columns)
