"""The queries of this subpackage, with their SQL where SQL can express them."""

from __future__ import annotations

from collections.abc import Callable
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession

from .bpe import bpe_round_trip
from .chat import chat_format
from .common import documents
from .decontaminate import contaminated
from .exact_dedup import exact_dedup
from .language_id import language_id
from .language_model import language_model_scores
from .secrets import secret_scan
from .simhash import simhash_dedup
from .substring_dedup import shared_passages
from .token_files import token_files

Query = Callable[[SparkSession, str], DataFrame]


def tokenizer_file(name: str) -> str:
    """Where the box keeps a public tokenizer's file; another path can be given to the operators."""
    import public_tokenizers

    return public_tokenizers.path(name)


def byte_bpe() -> tuple[bytes, str]:
    import public_tokenizers

    return Path(tokenizer_file("byte_bpe_50k.tiktoken")).read_bytes(), public_tokenizers.PATTERN


def op1_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return shared_passages(documents(spark, sf_dir))


def op2_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    return language_id(documents(spark, sf_dir))


def op3_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return contaminated(documents(spark, sf_dir), spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def op4_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return secret_scan(documents(spark, sf_dir))


def op5_language_model(spark: SparkSession, sf_dir: str) -> DataFrame:
    return language_model_scores(documents(spark, sf_dir))


def op6_simhash_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash_dedup(documents(spark, sf_dir))


def op7_chat_format(spark: SparkSession, sf_dir: str) -> DataFrame:
    return chat_format(spark.read.parquet(f"{sf_dir}/conversations.parquet"))


def op8_token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_files(documents(spark, sf_dir), Path(tokenizer_file("word_bpe_49k.json")).read_text())


def op9_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bpe_round_trip(documents(spark, sf_dir), *byte_bpe())


def op10_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact_dedup(documents(spark, sf_dir))


QUERIES: dict[str, Query] = {
    "op1_substring_dedup": op1_substring_dedup,
    "op2_language_id": op2_language_id,
    "op3_decontamination": op3_decontamination,
    "op4_secret_scan": op4_secret_scan,
    "op5_language_model": op5_language_model,
    "op6_simhash_dedup": op6_simhash_dedup,
    "op7_chat_format": op7_chat_format,
    "op8_token_files": op8_token_files,
    "op9_byte_bpe": op9_byte_bpe,
    "op10_exact_dedup": op10_exact_dedup,
}

#: Kinds and patterns of op4 in the order in which its spans are listed; (kind, pattern, group, least length).
SECRET_SQL = (
    ("assign", r"""([Pp][Aa][Ss][Ss][Ww][Oo][Rr][Dd]|[Pp][Aa][Ss][Ss][Ww][Dd]|[Ss][Ee][Cc][Rr][Ee][Tt]|[Tt][Oo][Kk][Ee][Nn]|[Aa][Pp][Ii]_?[Kk][Ee][Yy])["'']?\x20*[:=]\x20*["'']?([A-Za-z0-9+/_.=-]+)""", 2, 6),
    ("access", "AKIA[A-Z0-9]+", 0, 20),
    ("hex", "[0-9a-f]+", 0, 24),
    ("github", "gh[pousr]_[A-Za-z0-9]{36,}", 0, 0),
    ("google", "AIza[A-Za-z0-9_-]{35}", 0, 0),
    ("slack", "xox[abprs]-[A-Za-z0-9-]{10,}", 0, 0),
    ("jwt", r"eyJ[A-Za-z0-9_-]{8,}\.eyJ[A-Za-z0-9_-]{8,}\.[A-Za-z0-9_-]{8,}", 0, 0),
    ("pem", "-----BEGIN [A-Z ]*PRIVATE KEY-----", 0, 0),
)


def secret_sql() -> str:
    """Matches and the texts between them give the spans' places."""
    parts = " UNION ALL ".join(
        f"""SELECT doc_id, {i} AS o, '{kind}' AS kind, unnest(range(1, len(m) + 1)) AS i, m, v, g FROM (
            SELECT doc_id, regexp_extract_all(body, '{p}') AS m, regexp_extract_all(body, '{p}', {group}) AS v, string_split_regex(body, '{p}') AS g FROM d)"""
        for i, (kind, p, group, _) in enumerate(SECRET_SQL))
    least = " ".join(f"WHEN {i} THEN {least}" for i, (*_, least) in enumerate(SECRET_SQL))
    return f"""
        WITH d AS (SELECT doc_id, coalesce(text, '') AS body FROM documents), x AS ({parts}),
        s AS (SELECT doc_id, o, kind, len(m[i]) AS n, len(v[i]) AS vn,
                     list_sum(list_transform(m[:i - 1], lambda y: len(y))) AS before, list_sum(list_transform(g[:i], lambda y: len(y))) AS gaps FROM x),
        t AS (SELECT doc_id, o, kind, CAST(coalesce(before, 0) + gaps AS BIGINT) AS a, CAST(coalesce(before, 0) + gaps + n AS BIGINT) AS b
              FROM s WHERE vn >= CASE o {least} END),
        r AS (SELECT doc_id, count(*) FILTER (o = 0) AS n_assign, count(*) FILTER (o = 1) AS n_access, count(*) FILTER (o = 2) AS n_hex,
                     string_agg(kind || ':' || a || ':' || b, ',' ORDER BY a, o) FILTER (o <= 2) AS base, string_agg(kind || ':' || a || ':' || b, ',' ORDER BY a, o) AS spans
              FROM t GROUP BY doc_id)
        SELECT d.doc_id, coalesce(n_assign, 0) AS n_assign, coalesce(n_access, 0) AS n_access, coalesce(n_hex, 0) AS n_hex,
               sha256(coalesce(base, '')) AS base_sha256, coalesce(spans, '') AS spans
        FROM d LEFT JOIN r ON d.doc_id = r.doc_id"""


SQL: dict[str, str] = {
    "op4_secret_scan": secret_sql(),
    "op7_chat_format": """
        WITH t AS (SELECT conv_id, row_number() OVER (PARTITION BY conv_id ORDER BY turn, role, text) AS pos, count(*) OVER (PARTITION BY conv_id) AS n,
                          '<|im_start|>' || coalesce(role, '') || chr(10) || coalesce(text, '') || '<|im_end|>' || chr(10) AS line FROM conversations),
        p AS (SELECT *, string_agg(line, '') OVER (PARTITION BY conv_id ORDER BY pos ROWS UNBOUNDED PRECEDING) AS pre FROM t),
        kept AS (SELECT min(conv_id) AS conv_id FROM p e WHERE pos = n AND NOT EXISTS (SELECT 1 FROM p q WHERE q.pos < q.n AND q.pos = e.pos AND q.pre = e.pre) GROUP BY pos, pre)
        SELECT conv_id, CAST((pos - 1) // 256 AS BIGINT) AS part, max(n) AS n_turns, string_agg(line, '' ORDER BY pos) AS rendered
        FROM t WHERE conv_id IN (SELECT conv_id FROM kept) GROUP BY conv_id, (pos - 1) // 256""",
    "op10_exact_dedup": r"""
        WITH n AS (SELECT doc_id, regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]+', ' ', 'g') AS body FROM documents),
        g AS (SELECT body, min(doc_id) AS keep_id, count(*) AS group_size FROM n GROUP BY body)
        SELECT n.doc_id, coalesce(g.keep_id, n.doc_id) AS keep_id, CAST(g.group_size AS BIGINT) AS group_size,
               coalesce(g.keep_id, n.doc_id) IS NOT DISTINCT FROM n.doc_id AS kept, sha256(n.body) AS text_sha256
        FROM n JOIN g ON n.body = g.body""",
}
