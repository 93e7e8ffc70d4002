"""Chat formatting: collapse cumulative snapshots, then render, in DataFrame functions only.

Logs often hold a conversation again and again, each time a few turns longer.
A rolling hash of each turn prefix (two 64-bit hashes of position, role and
text, xor-ed along the conversation) tells which conversations are prefixes of
longer ones; an anti-join keeps the maximal ones, which are rendered.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import written

#: Turns in a part: windows, prefix hashes and rendered strings are made part by part.
PART_TURNS = 256
OPEN, CLOSE = "<|im_start|>", "<|im_end|>"


def _offsets(parts: DataFrame, part: str, sums: dict[str, Column], whole: Column) -> DataFrame:
    """Per conversation and part: what the parts before add up to, and the whole conversation's turns."""
    before = Window.partitionBy("conv_id").orderBy(F.col(part).asc_nulls_first()).rowsBetween(Window.unboundedPreceding, -1)
    return parts.select(F.col("conv_id").alias("c"), F.col(part).alias("p"), *[x.over(before).alias(k) for k, x in sums.items()], whole.over(Window.partitionBy("conv_id")).alias("n_turns"))


def numbered(turns: DataFrame) -> DataFrame:
    """Turns with their position from 1, in order of turn, role, text; counted part by part."""
    rows = turns.select("conv_id", turns["turn"].cast("long").alias("turn"), turns["role"].cast("string").alias("role"), turns["text"].cast("string").alias("text")).withColumn("bucket", F.floor(F.col("turn") / PART_TURNS))
    within = Window.partitionBy("conv_id", "bucket").orderBy("turn", "role", "text")
    sizes = rows.groupBy("conv_id", "bucket").agg(F.count(F.lit(1)).alias("n"))
    ahead = _offsets(sizes, "bucket", {"ahead": F.sum("n")}, F.sum("n"))
    rows = rows.withColumn("rank", F.row_number().over(within))
    return rows.join(ahead, rows["conv_id"].eqNullSafe(F.col("c")) & rows["bucket"].eqNullSafe(F.col("p"))).select(
        "conv_id", (F.col("rank") + F.coalesce("ahead", F.lit(0))).cast("long").alias("pos"), "role", "text", "n_turns")


def _hash(salt: int) -> Column:
    return F.xxhash64(F.lit(salt), "pos", F.col("role").isNull(), F.coalesce("role", F.lit("")), F.col("text").isNull(), F.coalesce("text", F.lit("")))


def prefixes(turns: DataFrame) -> DataFrame:
    """Numbered turns with the rolling hashes (x1, x2) of the prefix that ends there."""
    rows = turns.withColumn("part", F.floor((F.col("pos") - 1) / PART_TURNS)).withColumn("h1", _hash(1)).withColumn("h2", _hash(2))
    along = Window.partitionBy("conv_id", "part").orderBy("pos").rowsBetween(Window.unboundedPreceding, 0)
    totals = rows.groupBy("conv_id", "part").agg(F.bit_xor("h1").alias("t1"), F.bit_xor("h2").alias("t2"))
    ahead = _offsets(totals, "part", {"a1": F.bit_xor("t1"), "a2": F.bit_xor("t2")}, F.count(F.lit(1))).drop("n_turns")
    rows = rows.withColumn("r1", F.bit_xor("h1").over(along)).withColumn("r2", F.bit_xor("h2").over(along))
    zero = F.lit(0).cast("long")
    return rows.join(ahead, rows["conv_id"].eqNullSafe(F.col("c")) & (rows["part"] == F.col("p"))).select(
        "conv_id", "pos", "n_turns", F.col("r1").bitwiseXOR(F.coalesce("a1", zero)).alias("x1"), F.col("r2").bitwiseXOR(F.coalesce("a2", zero)).alias("x2"))


def collapsed(turns: DataFrame) -> DataFrame:
    """kept_id of the conversations that stay: prefixes of no longer one, the smallest id of equal ones."""
    hashed = written(prefixes(turns), "prefixes")
    ends = hashed.where("pos = n_turns")
    proper = hashed.where("pos < n_turns").select("pos", "x1", "x2").distinct()
    return ends.join(proper, ["pos", "x1", "x2"], "left_anti").groupBy("pos", "x1", "x2").agg(F.min("conv_id").alias("kept_id")).select("kept_id")


def chat_format(conversations: DataFrame) -> DataFrame:
    """Rendered maximal conversations: conv_id, part, n_turns (of the whole conversation), rendered.

    ``conversations`` has conv_id, turn, role, text; other columns are ignored.
    Turns follow turn, role, text (nulls first); repeated rows are turns of
    their own. A conversation that is a prefix of a longer one, by roles and
    texts, goes; of equal ones the smallest id stays. A part holds 256 turns, so
    a very long conversation has several rows, each of bounded size. A null
    role or text is rendered empty but equals only a null; rows with a null
    conv_id are one conversation. An empty table gives an empty result.
    """
    turns = written(numbered(conversations), "turns")
    kept = collapsed(turns)
    line = F.concat(F.lit(OPEN), F.coalesce("role", F.lit("")), F.lit("\n"), F.coalesce("text", F.lit("")), F.lit(CLOSE + "\n"))
    rows = turns.join(kept, turns["conv_id"].eqNullSafe(kept["kept_id"]), "left_semi")
    parts = rows.groupBy("conv_id", F.floor((F.col("pos") - 1) / PART_TURNS).cast("long").alias("part"))
    return parts.agg(F.max("n_turns").alias("n_turns"), F.sort_array(F.collect_list(F.struct("pos", line.alias("line")))).alias("lines")).select(
        "conv_id", "part", "n_turns", F.array_join(F.transform("lines", lambda x: x["line"]), "").alias("rendered"))
