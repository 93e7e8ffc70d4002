"""Similarity of headers and names: on Python strings and as columns."""

from __future__ import annotations

import re
from collections.abc import Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F

from .script import SPACE, WIDE_SPACE, let, trimmed

_SPACES = "\t\n\v\f\r " + "".join(map(chr, WIDE_SPACE))


def trim(text: str) -> str:
    return text.strip(_SPACES)


def levenshtein(a: str, b: str) -> int:
    """Edit distance in UTF-16 units."""
    x, y = (memoryview(s.encode("utf-16-le", "surrogatepass")).cast("H").tolist() for s in (a, b))
    row = list(range(len(y) + 1))
    for i, c in enumerate(x, 1):
        corner, row[0] = row[0], i
        for j, d in enumerate(y, 1):
            corner, row[j] = row[j], min(row[j] + 1, row[j - 1] + 1, corner + (c != d))
    return row[-1]


def _units(text: str) -> int:
    return len(text.encode("utf-16-le", "surrogatepass")) // 2


def levenshtein_similarity(a: str, b: str) -> float:
    return 1.0 if a == b else 1 - levenshtein(a, b) / max(_units(a), _units(b))


def normalize(text: str) -> str:
    """Trimmed, lower case, dashes and underscores as spaces, runs of spaces as one."""
    return re.sub(f"[{re.escape(_SPACES)}]+", " ", re.sub("[_-]", " ", trim(text).lower()))


def tokenize(text: str) -> list[str]:
    return [t for t in normalize(text).split(" ") if t]


def token_similarity(a: str, b: str) -> float:
    """Each token's best similarity on the other side, averaged per side and then over both."""
    x, y = tokenize(a), tokenize(b)
    if not x or not y:
        return 0.0
    side = lambda p, q: sum(max(levenshtein_similarity(s, t) for t in q) for s in p) / len(p)
    return (side(x, y) + side(y, x)) / 2


def contains_match(a: str, b: str) -> bool:
    x, y = normalize(a), normalize(b)
    return _units(x) >= 3 and _units(y) >= 3 and (x in y or y in x)


def common_prefix_length(a: str, b: str) -> int:
    n = 0
    for c, d in zip(a, b, strict=False):
        if c != d:
            break
        n += _units(c)
    return n


def compute_similarity(header: str, target: str) -> float:
    """1 if equal once normalized, else the best of four scores."""
    h, t = normalize(header), normalize(target)
    if h == t:
        return 1.0
    low, high = sorted((_units(h), _units(t)))
    scores = [levenshtein_similarity(h, t), token_similarity(h, t)]
    if contains_match(h, t):
        scores.append(0.7 + 0.2 * (low / high))
    prefix = common_prefix_length(h, t)
    if prefix >= 3:
        scores.append(0.5 + 0.4 * (prefix / high))
    return max(scores)


def compute_best_match(header: str, name: str, aliases: Sequence[str] = ()) -> tuple[float, str, bool]:
    """(score, what matched, whether that is an alias); earlier candidates win ties."""
    h = normalize(header)
    if h == normalize(name):
        return 1.0, name, False
    best = compute_similarity(header, name), name, False
    for alias in aliases:
        if h == normalize(alias):
            return 1.0, alias, True
        score = compute_similarity(header, alias)
        if score > best[0]:
            best = score, alias, True
    return best


# ---------------------------------------------------------------- as columns


def levenshtein_similarity_column(a: Column, b: Column) -> Column:
    longest = F.greatest(F.length(a), F.length(b))
    return F.when(a == b, 1.0).otherwise(1 - F.levenshtein(a, b) / longest)


def normalize_column(v: Column) -> Column:
    return F.regexp_replace(F.translate(F.lower(trimmed(v)), "_-", "  "), f"[{SPACE}]+", " ")


def tokenize_column(v: Column) -> Column:
    return F.filter(F.split(normalize_column(v), " "), lambda t: t != "")


def _tokens_alike(x: Column, y: Column) -> Column:
    """From two arrays of tokens."""

    def side(p: Column, q: Column) -> Column:
        best = F.transform(p, lambda s: F.array_max(F.transform(q, lambda t: levenshtein_similarity_column(s, t))))
        return F.aggregate(best, F.lit(0.0), lambda acc, x: acc + x) / F.size(p)

    return F.when((F.size(x) == 0) | (F.size(y) == 0), 0.0).otherwise((side(x, y) + side(y, x)) / 2)


def token_similarity_column(a: Column, b: Column) -> Column:
    return let(F.struct(tokenize_column(a).alias("x"), tokenize_column(b).alias("y")), lambda p: _tokens_alike(p["x"], p["y"]))


def _contained(x: Column, y: Column) -> Column:
    return (F.length(x) >= 3) & (F.length(y) >= 3) & (F.contains(x, y) | F.contains(y, x))


def contains_match_column(a: Column, b: Column) -> Column:
    return _contained(normalize_column(a), normalize_column(b))


def common_prefix_length_column(a: Column, b: Column) -> Column:
    short = F.least(F.length(a), F.length(b))
    return F.coalesce(F.array_max(F.transform(F.sequence(F.lit(0), short), lambda i: F.when(F.left(a, i) == F.left(b, i), i).otherwise(0))), F.lit(0))


def similarity_column(header: Column, target: Column) -> Column:
    """Both are normalised once; equal ones cost nothing else."""

    def scores(h: Column, t: Column) -> Column:
        low, high = F.least(F.length(h), F.length(t)), F.greatest(F.length(h), F.length(t))
        split = lambda v: F.filter(F.split(v, " "), lambda x: x != "")
        prefix = F.when(F.left(h, F.lit(3)) == F.left(t, F.lit(3)), common_prefix_length_column(h, t)).otherwise(0)
        return F.greatest(
            levenshtein_similarity_column(h, t),
            F.when(_contained(h, t), 0.7 + 0.2 * (low / high)).otherwise(0.0),
            let(F.struct(split(h).alias("x"), split(t).alias("y")), lambda p: _tokens_alike(p["x"], p["y"])),
            F.when(prefix >= 3, 0.5 + 0.4 * (prefix / high)).otherwise(0.0),
        )

    both = F.struct(normalize_column(header).alias("h"), normalize_column(target).alias("t"))
    return let(both, lambda p: F.when(p["h"] == p["t"], 1.0).otherwise(scores(p["h"], p["t"])))
