"""gristmill: tabular-text ingestion and validation on Spark DataFrames.

Text is read, headers are mapped to a schema, columns are put in schema order,
and every cell is checked against types, rules and locale formats.
"""

from .functions.locales import DE, EN, EN_GB, FR, TR, Locale, get_locale, has_locale, locale_ids, register_locale
from .functions.similarity import common_prefix_length, compute_best_match, compute_similarity, contains_match, levenshtein, levenshtein_similarity, normalize, token_similarity, tokenize
from .operators.compiler import compile_column, compile_schema
from .operators.mapping import Mapping, Match, apply_mapping, map_and_validate, map_columns, should_auto_map, update_mapping
from .operators.validation import ErrorMatrix, Validation, Validator, validate, with_rows
from .plans.session import ImportSession, build_import_result, parse_and_validate
from .schema import ERROR_CODES, ColumnDef, Rule, Schema, custom, email, enum, error_code_from_name, max_length, maximum, min_length, minimum, pattern, required, unique
from .sources.delimited import Options, clear_parser_cache, compile_parser, parse, preview, read_compatible, read_native, read_string, write_delimited

__all__ = [n for n in dir() if not n.startswith("_")]
