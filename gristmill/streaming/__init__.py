"""Validation of streams (an extension; codes need no state)."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators.compiler import compile_schema
from ..schema import Schema


def validate_stream(stream: DataFrame, schema: Schema) -> DataFrame:
    """The stream with ``_codes``: internal codes of all rules but unique; customs must be native."""
    compiled = compile_schema(schema)
    if any(not r.native for c in compiled.columns for r in c.customs):
        raise ValueError("customs of a stream must be functions of columns")
    have, codes = set(stream.columns), []
    for c in compiled.columns:
        v = F.coalesce(F.col(f"`{c.name}`").cast("string"), F.lit("")) if c.name in have else F.lit("")
        code = c.fn(v)
        for k, r in enumerate(c.customs):
            code = F.when((code == 0) & (v != "") & ~F.coalesce(r.fn(v), F.lit(False)), F.lit(201 + k).cast("smallint")).otherwise(code)
        codes.append(code)
    return stream.withColumn("_codes", F.array(*codes))


def first_seen(stream: DataFrame, key: str, event_time: str, delay: str) -> DataFrame:
    """Rows whose key hasn't been seen within the watermark; state is bounded by the delay."""
    return stream.withWatermark(event_time, delay).dropDuplicatesWithinWatermark([key])
