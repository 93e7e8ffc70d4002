"""A corpus pipeline of five stages over ``documents``.

Each stage takes all rows its predecessor kept and returns the rows it keeps,
with the columns of ``documents``; the last returns the encoded texts.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from gristmill.llm.bpe import bpe_round_trip
from gristmill.llm.common import ASCII_SPACE, documents, sifted, written
from gristmill.llm.decontaminate import contaminated
from gristmill.llm.exact_dedup import exact_dedup
from gristmill.llm.language_id import in_known_languages
from gristmill.llm.queries import byte_bpe
from gristmill.llm.simhash import near_copies, node_of

#: Bits within which the fingerprints of two-word shingles propose near copies; the query of the operator itself has 3.
NEAR_BITS = 9


def without(docs: DataFrame, nodes: DataFrame) -> DataFrame:
    """``docs`` less the rows whose ``node_of`` is in ``nodes``: null or repeated ids don't take other rows along."""
    gone = nodes.select(F.col("node").alias("gone_node")).distinct()
    stay, maybe = sifted(docs, node_of(docs), gone)
    return stay.union(maybe.join(gone, node_of(maybe) == gone["gone_node"], "left_anti"))


def sha_of(docs: DataFrame) -> Column:
    """The digest by which ``exact_dedup`` names a text."""
    return F.sha2(F.regexp_replace(F.coalesce(docs["text"], F.lit("")), ASCII_SPACE + "+", " "), 256)


def language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Texts in no language that the labelled rows teach are rejected: null, without a letter, or unlike all profiles."""
    return in_known_languages(docs)


def exact(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One row of each group of equal texts stays."""
    marks = written(exact_dedup(docs), "marks")
    gone = written(marks.where("NOT kept").select(F.col("doc_id").alias("gone_id"), F.col("text_sha256").alias("gone_sha")).distinct(), "gone")
    stay, maybe = sifted(docs, docs["doc_id"].cast("long"), gone.select("gone_id"))
    kept = stay.union(maybe.join(gone, maybe["doc_id"].eqNullSafe(gone["gone_id"]) & (sha_of(maybe) == gone["gone_sha"]), "left_anti"))
    rows, texts = marks.where("kept").agg(F.count(F.lit(1)), F.count_distinct("text_sha256")).first()
    if rows == texts:
        return kept
    key = "sha256_of_row"  # rows that repeat both id and text
    while key in docs.columns:
        key += "_"
    return kept.withColumn(key, sha_of(kept)).dropDuplicates(["doc_id", key]).drop(key)


def near(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One row of each component of near copies stays: texts that share 80 % or more of their five-word runs."""
    return without(docs, written(near_copies(docs, bits=NEAR_BITS), "near"))


def decontaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold a benchmark item go."""
    by_node = docs.select(node_of(docs).alias("doc_id"), "text")
    leaks = contaminated(by_node, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))
    return without(docs, written(leaks.select(F.col("doc_id").alias("node")), "leaks"))


def encoded(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The token counts and digests of what is left."""
    return bpe_round_trip(docs, *byte_bpe())


STAGES = [
    ("language_id", language),
    ("exact_dedup", exact),
    ("simhash_near_dedup", near),
    ("benchmark_decontamination", decontaminated),
    ("byte_bpe", encoded),
]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = documents(spark, sf_dir)
    for name, stage in STAGES[:-1]:
        docs = written(stage(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)


#: SQL expresses neither the profiles of the first stage nor the fingerprints of the third.
ORACLE_SQL = None
