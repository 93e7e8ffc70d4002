"""Delimited text: a native reader for large files and a compatible one for odd files.

``read_native`` uses Spark's CSV reader: RFC 4180, short rows padded, long rows
cut, blank lines dropped. Files split into tasks of any number unless a quoted
field holds a line break; a scan for lines with an odd number of quotes tells.
``read_compatible`` applies exact
rules to each file as a whole (one task a file): two scanners, chosen by
whether the quote character occurs at all, which treat ragged and blank lines
differently.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator, Sequence
from dataclasses import dataclass
from functools import lru_cache

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..workers import visible_to_workers

ROW = "_row"


@dataclass(frozen=True)
class Options:
    delimiter: str = ","
    quote: str = '"'
    header: bool = True
    skip_empty_lines: bool = False
    #: Whether quoted fields may hold line breaks, for the native reader; None lets it look.
    multiline: bool | None = None


@dataclass
class Parsed:
    headers: list[str] | None
    rows: list[list[str]]
    field_count: int

    @property
    def row_count(self) -> int:
        return len(self.rows)


@dataclass(frozen=True)
class Sniffed:
    delimiter: str
    quote: str
    field_count: int
    has_quotes: bool
    line_ending: str


def detect_schema(sample: str, options: Options = Options()) -> Sniffed:
    """Field count of the first line (delimiters outside quotes), line ending, whether a quote occurs."""
    head, found, _ = sample.partition("\n")
    crlf = bool(found) and head.endswith("\r")
    inside, fields = False, 1
    for c in head:
        if c == options.quote[0]:
            inside = not inside
        elif c == options.delimiter[0] and not inside:
            fields += 1
    return Sniffed(options.delimiter, options.quote, fields, options.quote in sample, "\r\n" if crlf else "\n")


def _without_cr(text: str) -> str:
    return text[:-1] if text.endswith("\r") else text


def _plain_rows(text: str, at: int, spec: Sniffed) -> Iterator[list[str]]:
    """No quotes: fields end at the next delimiter, wherever the line ends; the last at the line's end."""
    n = len(text)
    while at < n:
        row, begin = [], at
        for _ in range(spec.field_count - 1):
            cut = text.find(spec.delimiter, begin)
            if cut < 0:
                rest = text[at:]
                rest = _without_cr(rest[:-1] if rest.endswith("\n") else rest)
                if rest:
                    yield [rest]
                return
            row.append(text[begin:cut])
            begin = cut + 1
        end = text.find("\n", begin)
        row.append(_without_cr(text[begin:] if end < 0 else text[begin:end]))
        yield row
        at = n if end < 0 else end + 1


def _quoted_field(text: str, at: int, quote: str) -> tuple[str, int]:
    """The content of a field that opens at ``at``, and where it ends; unclosed, it takes the rest as it is."""
    find, doubled = at + 1, False
    while True:
        close = text.find(quote, find)
        if close < 0:
            return text[at + 1 :], len(text)
        if text[close + 1 : close + 2] != quote:
            body = text[at + 1 : close]
            return body.replace(quote * 2, quote) if doubled else body, close + 1
        doubled, find = True, close + 2


def _quoted_rows(text: str, at: int, spec: Sniffed) -> Iterator[list[str]]:
    """With quotes: short rows are padded, and a row ends with its line or its last field."""
    n, last = len(text), spec.field_count - 1
    while at < n:
        row: list[str] = []
        ended = False
        while len(row) <= last and at < n and not ended:
            if text[at] == spec.quote:
                value, at = _quoted_field(text, at, spec.quote)
                row.append(value)
                follow = text[at : at + 1]
                ended = follow in ("\n", "\r") and follow != ""
                at += 2 if text.startswith("\r\n", at) else len(follow)  # whatever follows is passed over
                continue
            line = text.find("\n", at)
            stop = n if line < 0 else line
            cut = text.find(spec.delimiter, at, stop) if len(row) < last else -1
            if cut < 0:
                row.append(_without_cr(text[at:stop]))
                at, ended = min(n, stop + 1), True
            else:
                row.append(text[at:cut])
                at = cut + 1
        yield row + [""] * (spec.field_count - len(row))


def _header_fields(line: str, spec: Sniffed) -> list[str]:
    """The first line's fields; an empty one after the last delimiter is lost."""
    out, at = [], 0
    while at < len(line):
        if line[at] == spec.quote:
            value, at = _quoted_field(line, at, spec.quote)
            out.append(value)
            at += line.startswith(spec.delimiter, at)
        else:
            cut = line.find(spec.delimiter, at)
            out.append(line[at:] if cut < 0 else line[at:cut])
            at = len(line) if cut < 0 else cut + 1
    return out


@dataclass(frozen=True)
class CompiledParser:
    """A scanner for texts with the sample's shape."""

    spec: Sniffed

    @property
    def field_count(self) -> int:
        return self.spec.field_count

    @property
    def has_quotes(self) -> bool:
        return self.spec.has_quotes

    @property
    def line_ending(self) -> str:
        return self.spec.line_ending

    def fn(self, text: str, start: int = 0) -> list[list[str]]:
        return list((_quoted_rows if self.spec.has_quotes else _plain_rows)(text, start, self.spec))


@lru_cache(maxsize=256)
def _parser(spec: Sniffed) -> CompiledParser:
    return CompiledParser(spec)


def compile_parser(sample: str, options: Options = Options()) -> CompiledParser:
    """The parser for a sample; the same object for the same shape."""
    return _parser(detect_schema(sample, options))


def clear_parser_cache() -> None:
    _parser.cache_clear()


def parse(text: str, options: Options = Options()) -> Parsed:
    """A whole text, on this machine."""
    if not text:
        return Parsed(None, [], 0)
    parser = compile_parser(text, options)
    headers, start = None, 0
    if options.header:
        line, found, _ = text.partition("\n")
        headers = _header_fields(_without_cr(line), parser.spec)
        start = len(line) + 1 if found else len(text)
    rows = parser.fn(text, start) if start < len(text) else []
    if options.skip_empty_lines:
        rows = [r for r in rows if any(r)]
    return Parsed(headers, rows, parser.field_count)


def unique_names(headers: Sequence[str]) -> list[str]:
    """Column names from headers: empty ones become _c<i>, repeats get a number."""
    out: list[str] = []
    for i, h in enumerate(headers):
        name = h or f"_c{i}"
        while name in out:
            name += f"_{i}"
        out.append(name)
    return out


def _first_line(spark: SparkSession, path: str) -> str:
    got = spark.read.text(path).limit(1).collect()
    return got[0].value if got else ""


def has_open_lines(spark: SparkSession, path: str, quote: str = '"') -> bool:
    """Whether some line has an odd number of quotes, without which no quoted field goes on in the next line."""
    return not spark.read.text(path).where((F.length("value") - F.length(F.replace("value", F.lit(quote), F.lit("")))) % 2 == 1).isEmpty()


def read_native(spark: SparkSession, path: str, options: Options = Options(), headers: Sequence[str] | None = None) -> DataFrame:
    """String columns named by the header, nulls as empty; blank lines go, rows of empty fields stay.

    Without quoted line breaks (``options.multiline``; by default the files are
    looked through once, in parallel) they are read in splits, and lines of
    white space alone count as blank. With them each file is one task.
    """
    line = _first_line(spark, path)
    spec = detect_schema(line, options)
    names = list(headers) if headers is not None else _header_fields(_without_cr(line), spec) if options.header else []
    names += [""] * (spec.field_count - len(names))
    columns = unique_names(names)
    schema = ", ".join(f"`{c.replace('`', '``')}` string" for c in columns)
    lines = has_open_lines(spark, path, options.quote) if options.multiline is None else options.multiline
    df = spark.read.csv(path, schema=schema, sep=options.delimiter, quote=options.quote, escape=options.quote, header=options.header, multiLine=lines, enforceSchema=True, ignoreLeadingWhiteSpace=False, ignoreTrailingWhiteSpace=False)
    df = df.select(*[F.coalesce(F.col(f"`{c}`"), F.lit("")).alias(c) for c in columns])
    return skip_empty(df) if options.skip_empty_lines else df


def skip_empty(df: DataFrame) -> DataFrame:
    """Without rows whose fields are all empty."""
    cells = [F.col(f"`{c}`") for c in df.columns if c != ROW]
    return df.where(F.concat(*[F.coalesce(c, F.lit("")) for c in cells]) != "") if cells else df


def read_compatible(spark: SparkSession, path: str, options: Options = Options()) -> DataFrame:
    """file, _row (within the file), headers, fields (as many as the row has).

    A file is one task and one value, so a file of 2 GB or more raises an error.
    """
    for size, name in spark.read.format("binaryFile").load(path).select("length", "path").where(F.col("length") >= 1 << 31).limit(1).collect():
        raise ValueError(f"{name} has {size} bytes; read files of 2 GB or more with read_native")

    def run(batches):
        import pandas as pd

        for b in batches:
            for name, text in zip(b["file"], b["value"], strict=True):
                got = parse(text or "", options)
                for at in range(0, len(got.rows), 4096):
                    part = got.rows[at : at + 4096]
                    yield pd.DataFrame({"file": name, ROW: range(at, at + len(part)), "headers": [got.headers] * len(part), "fields": part})

    visible_to_workers(spark)
    whole = spark.read.text(path, wholetext=True).select(F.input_file_name().alias("file"), "value")
    return whole.mapInPandas(run, f"file string, {ROW} long, headers array<string>, fields array<string>")


def read_string(spark: SparkSession, text: str, options: Options = Options()) -> DataFrame:
    """A literal text as a frame: _row and string columns named by the header; short rows padded, long ones cut."""
    got = parse(text, options)
    names = unique_names([*(got.headers or []), *[""] * (got.field_count - len(got.headers or []))])
    rows = [(i, *(r + [""] * (len(names) - len(r)))[: len(names)]) for i, r in enumerate(got.rows)]
    return spark.createDataFrame(rows, f"{ROW} long" + "".join(f", `{n}` string" for n in names))


def columns_of(df: DataFrame, headers: Sequence[str]) -> DataFrame:
    """Rows of ``read_compatible`` as columns; missing fields are empty, extra ones go."""
    return df.select(ROW, *[F.coalesce(F.try_element_at("fields", F.lit(i + 1)), F.lit("")).alias(n) for i, n in enumerate(unique_names(headers))])


def first_rows(df: DataFrame, n: int) -> DataFrame:
    """The first n rows: by _row if there is one (a filter, no sort), else a limit."""
    return df.where(F.col(ROW) < n) if ROW in df.columns else df.limit(n)


def preview(df: DataFrame, n: int = 10) -> DataFrame:
    return first_rows(df, n)


def write_delimited(df: DataFrame, path: str, options: Options = Options(), mode: str = "errorifexists") -> None:
    """Fields are quoted where they must be; a file a task."""
    df.write.mode(mode).csv(path, sep=options.delimiter, quote=options.quote, escape=options.quote, header=options.header, emptyValue="", ignoreLeadingWhiteSpace=False, ignoreTrailingWhiteSpace=False)


def to_text(headers: Sequence[str], rows: Sequence[Sequence[str]], options: Options = Options()) -> str:
    """A small table as delimited text."""
    q = options.quote

    def cell(x: str) -> str:
        return q + x.replace(q, q * 2) + q if any(c in x for c in (options.delimiter, q, "\n", "\r")) else x

    return "\n".join(options.delimiter.join(map(cell, r)) for r in [headers, *rows])


Reader = Callable[[SparkSession, str, Options], DataFrame]
