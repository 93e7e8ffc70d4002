"""Header mapping: score headers against a schema, assign one to one, project.

Headers are few, so scoring and assignment are done on the driver before a
plan is built; ``score_frame`` is the same as a frame for many headers at once.
"""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass, field, replace

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import similarity
from ..schema import Schema

EXACT, ALIAS, FUZZY, NONE = "exact", "alias", "fuzzy", "none"
_PRIORITY = {EXACT: 3, ALIAS: 2, FUZZY: 1, NONE: 0}


@dataclass(frozen=True)
class Match:
    csv_index: int
    csv_header: str
    schema_column: str = ""
    confidence: str = NONE
    score: float = 0.0


@dataclass(frozen=True)
class Mapping:
    matches: tuple[Match, ...] = ()
    unmapped_csv: tuple[int, ...] = ()
    unmapped_schema: tuple[str, ...] = ()
    auto_mapped: int = 0
    needs_review: int = 0
    unmapped: int = 0
    fields: dict = field(default_factory=dict, compare=False)


def confidence_of(header: str, name: str, via: str, is_alias: bool) -> str:
    h = similarity.normalize(header)
    if h == similarity.normalize(name):
        return EXACT
    return ALIAS if is_alias and h == similarity.normalize(via) else FUZZY


def map_columns(headers: Sequence[str], schema: Schema, fuzzy_threshold: float = 0.6, auto_accept_threshold: float = 0.8) -> Mapping:
    """Best scores first, then exact before alias before fuzzy, then the order of headers and columns."""
    scored = []
    for i, header in enumerate(headers):
        text = similarity.trim(header)
        for k, (name, column) in enumerate(schema.columns.items() if text else ()):
            score, via, is_alias = similarity.compute_best_match(text, name, column.aliases)
            if score >= fuzzy_threshold:
                kind = confidence_of(text, name, via, is_alias)
                scored.append((-score, -_PRIORITY[kind], i, k, Match(i, header, name, kind, score)))
    matches, taken = {}, set()
    for *_, m in sorted(scored, key=lambda x: x[:4]):
        if m.csv_index not in matches and m.schema_column not in taken:
            matches[m.csv_index] = m
            taken.add(m.schema_column)
    every = tuple(matches.get(i, Match(i, h)) for i, h in enumerate(headers))
    sure = sum(m.confidence in (EXACT, ALIAS) or m.confidence == FUZZY and m.score >= auto_accept_threshold for m in every)
    lost = tuple(m.csv_index for m in every if m.confidence == NONE)
    return Mapping(every, lost, tuple(n for n in schema.names if n not in taken), sure, len(every) - sure - len(lost), len(lost))


def update_mapping(matches: Sequence[Match], csv_index: int, schema_column: str) -> tuple[Match, ...]:
    """Set a header's column by hand; it leaves the header that had it, and an empty one unmaps."""
    if all(m.csv_index != csv_index for m in matches):
        return tuple(matches)
    out, stolen = [], False
    for m in matches:
        if m.csv_index == csv_index:
            m = replace(m, schema_column=schema_column, confidence=EXACT if schema_column else NONE, score=1.0 if schema_column else 0.0)
        elif schema_column and m.schema_column == schema_column and not stolen:
            m, stolen = replace(m, schema_column="", confidence=NONE, score=0.0), True
        out.append(m)
    return tuple(out)


def should_auto_map(mapping: Mapping, threshold: float) -> bool:
    """All schema columns are mapped, each exactly, by alias or with a score of at least ``threshold``."""
    return not mapping.unmapped_schema and all(not m.schema_column or m.confidence in (EXACT, ALIAS) or m.confidence == FUZZY and m.score >= threshold for m in mapping.matches)


def apply_mapping(df: DataFrame, matches: Sequence[Match], schema: Schema, columns: Sequence[str] | None = None, keep: Sequence[str] = ()) -> DataFrame:
    """One projection into schema order: missing columns and nulls become empty, others go.

    ``columns`` are the frame's columns by header index (all in order by
    default); ``keep`` are passed through. If two headers have the same target
    the last one wins.
    """
    columns = [c for c in df.columns if c not in keep] if columns is None else list(columns)
    source = {m.schema_column: columns[m.csv_index] for m in sorted(matches, key=lambda m: m.csv_index) if m.schema_column and m.csv_index < len(columns)}
    cells = [F.coalesce(F.col(f"`{source[n]}`").cast("string"), F.lit("")).alias(n) if n in source else F.lit("").alias(n) for n in schema.names]
    return df.select(*[F.col(f"`{k}`") for k in keep], *cells)


def map_and_validate(df: DataFrame, schema: Schema, headers: Sequence[str] | None = None, **thresholds: float):
    """(mapping, mapped frame, validation) of a frame whose column names, or ``headers``, are mapped."""
    from .validation import ROW, validate

    columns = [c for c in df.columns if c != ROW]
    mapping = map_columns(list(headers) if headers is not None else columns, schema, **thresholds)
    mapped = apply_mapping(df, mapping.matches, schema, columns, [ROW] if ROW in df.columns else [])
    return mapping, mapped, validate(mapped, schema)


def mapping_frame(spark: SparkSession, mapping: Mapping) -> DataFrame:
    return spark.createDataFrame([(m.csv_index, m.csv_header, m.schema_column, m.confidence, m.score) for m in mapping.matches], "csv_index int, csv_header string, schema_column string, confidence string, score double")


def score_frame(headers: DataFrame, schema: Schema) -> DataFrame:
    """Every header (column ``header``) with every schema column: header, schema_column, matched, is_alias, score.

    Candidates are literals of the plan, exploded beside each header: no join.
    """
    candidates = F.array(*[F.struct(F.lit(name).alias("schema_column"), F.lit(text).alias("matched"), F.lit(order > 0).alias("is_alias"), F.lit(order).alias("place"))
                           for name, c in schema.columns.items() for order, text in enumerate((name, *c.aliases))])
    pairs = headers.select("header", F.explode(candidates).alias("c")).select("header", "c.*")
    scored = pairs.withColumn("score", similarity.similarity_column(F.col("header"), F.col("matched")))
    # an exact alias ends the search; else the best score, the earliest of equals
    best = F.max(F.struct("score", (-F.col("place")).alias("before"), "matched", "is_alias")).alias("b")
    return scored.groupBy("header", "schema_column").agg(best).select("header", "schema_column", "b.matched", "b.is_alias", "b.score")
