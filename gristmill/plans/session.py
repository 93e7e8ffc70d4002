"""An import from text to checked, schema-ordered rows, step by step.

``reduce`` is a pure function from a state and an action to the next state;
``ImportSession`` reads, maps and validates with Spark and feeds it. Frames in
the state are lazy; a step's side effects stay in the session.
"""

from __future__ import annotations

import time
from collections.abc import Callable, Sequence
from dataclasses import dataclass, replace
from typing import Any

from pyspark.sql import DataFrame, Row, SparkSession
from pyspark.sql import functions as F

from ..operators.mapping import ALIAS, EXACT, FUZZY, NONE, Mapping, Match, apply_mapping, map_columns, should_auto_map
from ..operators.validation import ROW, Validation, Validator, with_rows
from ..schema import Schema
from ..sources import delimited

IDLE, PARSING, MAPPING, VALIDATING, REVIEW, COMPLETE, ERROR = "idle", "parsing", "mapping", "validating", "review", "complete", "error"
#: Steps that may follow each step, and the step that "back" leads to.
FOLLOWS = {
    IDLE: (PARSING,),
    PARSING: (MAPPING, ERROR),
    MAPPING: (VALIDATING, IDLE, ERROR, PARSING),
    VALIDATING: (REVIEW, ERROR),
    REVIEW: (COMPLETE, MAPPING, IDLE, PARSING),
    COMPLETE: (REVIEW, IDLE, PARSING),
    ERROR: (IDLE, PARSING),
}
BACK = {MAPPING: (IDLE,), REVIEW: (MAPPING,), COMPLETE: (REVIEW,), ERROR: (IDLE,)}
#: Rows above which a result is called a bitmap result.
BITMAP_ROWS = 10_000
UNREADABLE = "Failed to read file content"


@dataclass(frozen=True)
class State:
    step: str = IDLE
    raw: DataFrame | None = None
    headers: tuple[str, ...] | None = None
    preview: Any = None
    row_count: int = 0
    mapping: Mapping | None = None
    mapped: DataFrame | None = None
    validation: Validation | None = None
    bitmap_validation: Validation | None = None
    file: str | None = None
    file_name: str | None = None
    file_size: int | None = None
    parse_time: float | None = None
    validation_time: float | None = None
    progress: int = 0
    error: str | None = None


def initial_state() -> State:
    return State()


def is_valid_transition(source: str, target: str) -> bool:
    return target in FOLLOWS.get(source, ())


def back_steps(step: str) -> list[str]:
    return list(BACK.get(step, ()))


def can_go_back(step: str) -> bool:
    return step in BACK


def can_go_forward(step: str) -> bool:
    return step in (MAPPING, REVIEW)


def edited_mapping(mapping: Mapping, csv_index: int, schema_column: str | None) -> Mapping:
    """A mapping after one change by hand, counted anew: every fuzzy match needs review here."""

    def edit(m: Match) -> Match:
        if m.csv_index == csv_index:
            return replace(m, schema_column=schema_column or "", confidence=EXACT if schema_column else NONE, score=1.0 if schema_column else 0.0)
        if schema_column and m.schema_column == schema_column:
            return replace(m, schema_column="", confidence=NONE, score=0.0)
        return m

    matches = tuple(map(edit, mapping.matches))
    known = dict.fromkeys([*(m.schema_column for m in mapping.matches if m.schema_column), *mapping.unmapped_schema])
    used = {m.schema_column for m in matches}
    n = lambda *kinds: sum(m.confidence in kinds for m in matches)
    return Mapping(matches, tuple(m.csv_index for m in matches if not m.schema_column), tuple(c for c in known if c not in used), n(EXACT, ALIAS), n(FUZZY), n(NONE))


def _back(state: State) -> State:
    if state.step in (MAPPING, ERROR):
        return State()
    if state.step == REVIEW:
        return replace(state, step=MAPPING, validation=None, bitmap_validation=None, validation_time=None)
    return replace(state, step=REVIEW) if state.step == COMPLETE else state


def _load(state: State, **more) -> State:
    return State(step=PARSING, **more)


#: Action -> (steps it works in, what it does).
ACTIONS: dict[str, tuple[tuple[str, ...], Callable[..., State]]] = {
    "LOAD_FILE": ((IDLE, MAPPING, REVIEW, COMPLETE, ERROR), lambda s, file, size=None: _load(s, file=file, file_name=file.rsplit("/", 1)[-1], file_size=size)),
    "LOAD_STRING": ((IDLE, MAPPING, REVIEW, COMPLETE, ERROR), lambda s, content, file_name="input.csv": _load(s, file_name=file_name, file_size=len(content))),
    "PARSE_START": ((IDLE, ERROR), lambda s: replace(s, step=PARSING, progress=0)),
    "PARSE_COMPLETE": ((PARSING,), lambda s, data, headers, row_count, time, preview=None: replace(s, step=MAPPING, raw=data, headers=tuple(headers), preview=preview, row_count=row_count, parse_time=time, progress=100)),
    "PARSE_ERROR": ((PARSING,), lambda s, error: replace(s, step=ERROR, error=error)),
    "SET_MAPPING": ((MAPPING,), lambda s, mapping: replace(s, mapping=mapping)),
    "UPDATE_MAPPING": ((MAPPING,), lambda s, csv_index, schema_column: replace(s, mapping=edited_mapping(s.mapping, csv_index, schema_column)) if s.mapping else s),
    "CONFIRM_MAPPING": ((MAPPING,), lambda s, mapped: replace(s, step=VALIDATING, mapped=mapped, progress=0)),
    "SKIP_MAPPING": ((MAPPING,), lambda s, mapping, mapped: replace(s, step=VALIDATING, mapping=mapping, mapped=mapped, progress=0)),
    "VALIDATE_COMPLETE": ((VALIDATING,), lambda s, result, time, is_bitmap: replace(s, step=REVIEW, validation=None if is_bitmap else result, bitmap_validation=result if is_bitmap else None, validation_time=time, progress=100)),
    "VALIDATE_ERROR": ((VALIDATING,), lambda s, error: replace(s, step=ERROR, error=error)),
    "ACCEPT": ((REVIEW,), lambda s: replace(s, step=COMPLETE)),
    "RESET": (tuple(FOLLOWS), lambda s: State()),
    "GO_BACK": (tuple(FOLLOWS), _back),
    "SET_PROGRESS": ((PARSING, VALIDATING), lambda s, progress: replace(s, progress=progress)),
}


def reduce(state: State, action: str, **given) -> State:
    """The next state; an action that the step doesn't allow, or an unknown one, changes nothing."""
    steps, do = ACTIONS.get(action, ((), None))
    return do(state, **given) if state.step in steps else state


@dataclass(frozen=True)
class ImportResult:
    data: DataFrame
    headers: tuple[str, ...]
    mapping: Mapping
    validation: Validation
    stats: dict


def build_import_result(state: State, schema: Schema) -> ImportResult | None:
    """None unless rows are mapped and validated."""
    found = state.validation or state.bitmap_validation
    if state.mapped is None or state.mapping is None or found is None:
        return None
    one = found.stats().first()
    stats = {"total_rows": state.row_count, "valid_rows": state.row_count - one.error_rows, "invalid_rows": one.error_rows, "error_count": one.error_count, "parse_time": state.parse_time or 0, "validation_time": state.validation_time or 0}
    return ImportResult(state.mapped, tuple(schema.names), state.mapping, found, stats)


class ImportSession:
    """Load, map, validate, accept. Options: auto-mapping from a score, preview and row limits, locale, delimiter, quote."""

    def __init__(self, spark: SparkSession, schema: Schema, auto_map: bool = True, auto_map_threshold: float = 0.8, max_preview_rows: int = 10, max_rows: int | None = None,
                 locale: str | None = None, delimiter: str = ",", quote: str = '"', mode: str = "native", on_complete: Callable[[ImportResult], None] | None = None, on_error: Callable[[str], None] | None = None):
        self.spark = spark
        self.schema = replace(schema, locale=locale) if locale is not None else schema
        self.auto_map, self.threshold, self.max_preview_rows, self.max_rows, self.mode = auto_map, auto_map_threshold, max_preview_rows, max_rows, mode
        self.options = delimited.Options(delimiter, quote)
        self.on_complete, self.on_error = on_complete, on_error
        self.state = State()
        self.tag = f"import-{id(self)}"

    def dispatch(self, action: str, **given) -> State:
        self.state = reduce(self.state, action, **given)
        return self.state

    def load_file(self, path: str) -> State:
        if self.dispatch("LOAD_FILE", file=path).step != PARSING:
            return self.state

        def read() -> tuple[DataFrame, list[str]]:
            if self.mode == "compatible":
                df = delimited.read_compatible(self.spark, path, self.options)
                head = df.select("headers").first()
                if head is None:
                    raise ValueError(UNREADABLE)
                return delimited.columns_of(df, head.headers or []), head.headers or []
            line = delimited._first_line(self.spark, path)
            if not line:
                raise ValueError(UNREADABLE)
            headers = delimited._header_fields(line, delimited.detect_schema(line, self.options))
            return with_rows(delimited.read_native(self.spark, path, self.options)), headers

        return self._process(read)

    def load_string(self, content: str, file_name: str = "input.csv") -> State:
        if self.dispatch("LOAD_STRING", content=content, file_name=file_name).step != PARSING:
            return self.state

        def read() -> tuple[DataFrame, list[str]]:
            if not content:
                raise ValueError(UNREADABLE)
            return delimited.read_string(self.spark, content, self.options), delimited.parse(content, self.options).headers or []

        return self._process(read)

    def load_frame(self, df: DataFrame, name: str = "table") -> State:
        """Any frame; its column names are the headers."""
        if self.dispatch("LOAD_STRING", content="", file_name=name).step != PARSING:
            return self.state
        return self._process(lambda: (with_rows(df), [c for c in df.columns if c != ROW]))

    def _process(self, read: Callable[[], tuple[DataFrame, Sequence[str]]]) -> State:
        began = time.perf_counter()
        try:
            self.spark.sparkContext.addJobTag(self.tag)
            df, headers = read()
            if self.max_rows is not None:
                df = delimited.first_rows(df, self.max_rows)
            n = df.count()
            preview = self._preview(df, min(n, self.max_preview_rows))
        except Exception as e:
            return self._fail("PARSE_ERROR", e)
        finally:
            self.spark.sparkContext.removeJobTag(self.tag)
        self.dispatch("PARSE_COMPLETE", data=df, headers=headers, row_count=n, time=(time.perf_counter() - began) * 1000, preview=preview)
        mapping = map_columns(headers, self.schema)
        self.dispatch("SET_MAPPING", mapping=mapping)
        if self.auto_map and should_auto_map(mapping, self.threshold):
            self.dispatch("SKIP_MAPPING", mapping=mapping, mapped=self._mapped(mapping))
            self._validate()
        return self.state

    @staticmethod
    def _preview(df: DataFrame, n: int) -> list[Row]:
        """The first rows. Numbers from 0 in file order let it stop after the first partitions; others take a sort."""
        names = [c for c in df.columns if c != ROW]
        rows = df.where(F.col(ROW) < n).take(n)
        if len(rows) < n:
            rows = df.orderBy(ROW).limit(n).collect()
        return [Row(**{c: r[c] for c in names}) for r in sorted(rows, key=lambda r: r[ROW])]

    def _mapped(self, mapping: Mapping) -> DataFrame:
        raw = self.state.raw
        return apply_mapping(raw, mapping.matches, self.schema, [c for c in raw.columns if c != ROW], [ROW])

    def update_mapping(self, csv_index: int, schema_column: str | None) -> State:
        return self.dispatch("UPDATE_MAPPING", csv_index=csv_index, schema_column=schema_column)

    def confirm_mapping(self) -> State:
        if self.state.step == MAPPING and self.state.mapping:
            self.dispatch("CONFIRM_MAPPING", mapped=self._mapped(self.state.mapping))
            self._validate()
        return self.state

    def _validate(self) -> None:
        began = time.perf_counter()
        try:
            self.spark.sparkContext.addJobTag(self.tag)
            result = Validator(self.schema).validate(self.state.mapped)
            result.stats().first()
        except Exception as e:
            self._fail("VALIDATE_ERROR", e)
            return
        finally:
            self.spark.sparkContext.removeJobTag(self.tag)
        self.dispatch("VALIDATE_COMPLETE", result=result, time=(time.perf_counter() - began) * 1000, is_bitmap=self.state.row_count > BITMAP_ROWS)

    def _fail(self, action: str, e: Exception) -> State:
        self.dispatch(action, error=str(e))
        if self.on_error:
            self.on_error(str(e))
        return self.state

    def accept(self) -> ImportResult | None:
        if self.dispatch("ACCEPT").step != COMPLETE:
            return None
        result = build_import_result(self.state, self.schema)
        if result and self.on_complete:
            self.on_complete(result)
        return result

    def reset(self) -> State:
        return self.dispatch("RESET")

    def go_back(self) -> State:
        return self.dispatch("GO_BACK")

    def cancel(self) -> State:
        """Interrupt what runs and start over."""
        self.spark.sparkContext.cancelJobsWithTag(self.tag)
        return self.reset()

    # ---- access

    @property
    def validation(self) -> Validation | None:
        return self.state.validation or self.state.bitmap_validation

    def get_errors(self, limit: int = 100, offset: int = 0) -> list:
        return self.validation.get_errors(limit, offset).collect() if self.validation else []

    def get_row_errors(self, row: int) -> list:
        return self.validation.get_row_errors(row).collect() if self.validation else []

    def get_cell_error(self, row: int, col: int):
        return self.validation.get_cell_error(row, col).first() if self.validation else None

    def error_summary(self) -> dict[str, int]:
        return self.validation.error_summary() if self.validation else {}

    @property
    def has_errors(self) -> bool:
        return bool(self.validation) and self.validation.stats().first().error_count > 0

    @property
    def is_loading(self) -> bool:
        return self.state.step in (PARSING, VALIDATING)

    @property
    def is_complete(self) -> bool:
        return self.state.step == COMPLETE


def parse_and_validate(spark: SparkSession, path: str, schema: Schema, options: delimited.Options = delimited.Options(), max_rows: int | None = None) -> Validation:
    """Columns by position, without mapping: the first column is the schema's first."""
    df = delimited.read_native(spark, path, options)
    named = df.select(*[F.col(f"`{c}`").alias(n) for c, n in zip(df.columns, schema.names, strict=False)])
    return Validator(schema).validate(delimited.first_rows(with_rows(named), max_rows) if max_rows is not None else named)
