"""Secret scans behind a trigram inverted index, in DataFrame functions only.

Each rule's regular expression gives a Boolean trigram query (trigrams that
any match must contain, in lower case). Postings of those trigrams are written
as an index, intersected per query, and the candidates that result are
verified with the expression itself. A rule without mandatory trigrams is run
on every text.
"""

from __future__ import annotations

import re._constants as c
import re._parser as parser
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import written

#: Ids in a block of the index, so that a posting list is bounded.
BLOCK_IDS = 4096
ALTERNATIVES, CLASS_MEMBERS = 256, 8
#: Matches whose lengths are summed as a block.
MATCHES = 64
CUT = "\0"


@dataclass(frozen=True)
class Rule:
    """A kind of secret: its expression and, if part of it decides, that group's least length."""

    kind: str
    pattern: str
    group: int = 0
    least: int = 0


#: The base rules, whose spans are always reported, in this order.
#: The runs of access and hex are maximal, so their least length can stand in the expression.
BASE = (
    Rule("assign", r"""((?i:password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", 2, 6),
    Rule("access", r"AKIA[A-Z0-9]{16,}"),
    Rule("hex", r"[0-9a-f]{24,}"),
)
#: The rules that the method adds.
ADDED = (
    Rule("github", r"gh[pousr]_[A-Za-z0-9]{36,}"),
    Rule("google", r"AIza[A-Za-z0-9_-]{35}"),
    Rule("slack", r"xox[abprs]-[A-Za-z0-9-]{10,}"),
    Rule("jwt", r"eyJ[A-Za-z0-9_-]{8,}\.eyJ[A-Za-z0-9_-]{8,}\.[A-Za-z0-9_-]{8,}"),
    Rule("pem", r"-----BEGIN [A-Z ]*PRIVATE KEY-----"),
)


def _spellings(parsed) -> list[str]:
    """What a match may spell, in lower case; CUT stands for anything."""
    out = [""]
    for op, arg in parsed:
        if op is c.LITERAL:
            some = [chr(arg).lower()]
        elif op is c.IN:
            some = _members(arg)
        elif op is c.BRANCH:
            some = [s for way in arg[1] for s in _spellings(way)]
        elif op is c.SUBPATTERN:
            some = _spellings(arg[-1])
        elif op in (c.MAX_REPEAT, c.MIN_REPEAT):
            low, high, inner = arg
            one = _spellings(inner)
            some = [CUT] if not low and high > 1 else one if low else [*one, ""]
            if low and high > 1:
                some = [s + CUT for s in some]
        elif op in (c.AT, c.ASSERT, c.ASSERT_NOT):
            some = [""]
        else:
            some = [CUT]
        out = list(dict.fromkeys(a + b for a in out for b in some)) if len(out) * len(some) <= ALTERNATIVES else [a + CUT for a in out]
    return out


def _members(items) -> list[str]:
    found: set[str] = set()
    for op, arg in items:
        if op is c.LITERAL:
            found.add(chr(arg).lower())
        elif op is c.RANGE and arg[1] - arg[0] < CLASS_MEMBERS:
            found |= {chr(x).lower() for x in range(arg[0], arg[1] + 1)}
        else:
            return [CUT]
    return sorted(found) if len(found) <= CLASS_MEMBERS else [CUT]


def trigram_query(pattern: str) -> list[frozenset[str]] | None:
    """Alternatives of trigrams that all must occur; None if some match needs no trigram."""
    ways = set()
    for s in _spellings(parser.parse(pattern)):
        ways.add(frozenset(part[i : i + 3] for part in s.split(CUT) for i in range(len(part) - 2)))
    if frozenset() in ways or any(not x.isascii() for w in ways for x in w):
        return None
    return sorted((w for w in ways if not any(o < w for o in ways)), key=sorted)


def postings(docs: DataFrame, trigrams: list[str]) -> DataFrame:
    """The index: block, trigram, and the sorted doc_ids of the block whose text has it."""
    low = docs.where("doc_id IS NOT NULL").select("doc_id", F.lower("text").alias("low"))
    has = F.array_compact(F.array(*[F.when(F.contains("low", F.lit(t)), F.lit(t)) for t in trigrams]))
    return (low.select("doc_id", F.explode(has).alias("trigram"))
            .groupBy(F.floor(F.col("doc_id") / BLOCK_IDS).alias("block"), "trigram").agg(F.sort_array(F.collect_set("doc_id")).alias("ids")))


def candidates(index: DataFrame, queries: dict[int, list[frozenset[str]]]) -> DataFrame:
    """doc_id and the bits of the rules whose trigram query it meets, from intersected postings."""
    lists = index.groupBy("block").agg(F.map_from_entries(F.collect_list(F.struct("trigram", "ids"))).alias("lists"))
    empty = F.array().cast("array<bigint>")

    def meets(ways: list[frozenset[str]]) -> Column:
        found = None
        for way in ways:
            one = None
            for t in sorted(way):
                ids = F.coalesce(F.try_element_at("lists", F.lit(t)), empty)
                one = ids if one is None else F.array_intersect(one, ids)
            found = one if found is None else F.array_union(found, one)
        return found

    def tagged(bit: int, ways: list[frozenset[str]]) -> Column:
        return F.transform(meets(ways), lambda i: F.struct(i.alias("doc_id"), F.lit(1 << bit).cast("long").alias("bit")))

    return lists.select(F.explode(F.concat(*[tagged(bit, ways) for bit, ways in queries.items()])).alias("x")).groupBy(F.col("x.doc_id").alias("hit_id")).agg(F.bit_or("x.bit").alias("bits"))


def spans_of(rule: Rule, order: int, text: Column) -> Column:
    """Leftmost non-overlapping matches as structs (start, order, end, kind), in code points, failing ones dropped."""
    pattern = F.lit(rule.pattern)
    found = F.regexp_extract_all(text, pattern, F.lit(0))
    value = F.regexp_extract_all(text, pattern, F.lit(rule.group))
    gaps = F.split(text, rule.pattern, -1)
    n, gap = F.transform(found, lambda x: F.length(x)), F.slice(F.transform(gaps, lambda x: F.length(x)), F.lit(1), F.size(found))
    parts = F.arrays_zip(n.alias("n"), F.transform(value, lambda x: F.length(x)).alias("v"), F.zip_with(n, gap, lambda x, y: x + y).alias("step"))
    kind = "array<struct<start:int,order:int,end:int,kind:string>>"

    def total(steps: Column) -> Column:
        return F.aggregate(steps, F.lit(0), lambda x, y: x + y)

    # running sums in blocks, so that a text with very many matches costs a block a match, not all before it
    def placed(p: Column) -> Column:
        steps = F.transform(p, lambda x: x["step"])
        blocks = F.sequence(F.lit(0), F.floor((F.size(p) - 1) / MATCHES).cast("int"))
        sums = F.transform(blocks, lambda b: total(F.slice(steps, b * MATCHES + 1, F.lit(MATCHES))))
        ahead = F.transform(blocks, lambda b: total(F.slice(sums, F.lit(1), b)))
        return let(F.struct(p.alias("p"), steps.alias("steps"), ahead.alias("ahead")), lambda x: F.transform(x["p"], lambda m, i: ended(x, m, i)))

    def ended(x: Column, m: Column, i: Column) -> Column:
        block = F.floor(i / MATCHES).cast("int")
        end = F.element_at(x["ahead"], block + 1) + total(F.slice(x["steps"], block * MATCHES + 1, i % MATCHES + 1))
        return F.struct((end - m["n"]).alias("start"), F.lit(order).alias("order"), end.alias("end"), F.lit(rule.kind).alias("kind"), m["v"].alias("v"))

    spans = F.filter(F.when(F.size(parts) > 0, let(parts, placed)), lambda x: x["v"] >= rule.least)
    return F.coalesce(F.transform(spans, lambda x: F.struct(x["start"].alias("start"), x["order"].alias("order"), x["end"].alias("end"), x["kind"].alias("kind"))).cast(kind), F.array().cast(kind))


def let(value: Column, body) -> Column:
    """``body(value)`` with the value computed once."""
    return F.element_at(F.transform(F.array(value), body), 1)


def written_spans(spans: Column) -> Column:
    """kind:start:end, by start and then kind as listed, comma-joined."""
    return F.array_join(F.transform(F.array_sort(spans), lambda s: F.concat_ws(":", s["kind"], s["start"], s["end"])), ",")


def secret_scan(docs: DataFrame, base: tuple[Rule, ...] = BASE, added: tuple[Rule, ...] = ADDED) -> DataFrame:
    """One row per row of ``docs``: doc_id, n_<kind> of each base rule, base_sha256, spans.

    ``docs`` needs doc_id and text; other columns are ignored. A null or empty
    text has no spans. Rows with a null id, which the index can't list, are
    verified against every rule; rows that repeat an id are candidates together
    and verified one by one. An empty table gives an empty result.
    """
    rules = (*base, *added)
    own = docs.select(docs["doc_id"].cast("long").alias("doc_id"), F.coalesce(docs["text"], F.lit("")).alias("text"))
    queries = {i: q for i, r in enumerate(rules) if (q := trigram_query(r.pattern)) is not None}
    if queries:
        index = written(postings(own, sorted({t for q in queries.values() for w in q for t in w})), "postings")
        own = own.join(written(candidates(index, queries), "candidates"), own["doc_id"] == F.col("hit_id"), "left")
        own = own.withColumn("bits", F.when(F.col("doc_id").isNull(), F.lit(-1).cast("long")).otherwise(F.coalesce("bits", F.lit(0).cast("long"))))
    none = F.array().cast("array<struct<start:int,order:int,end:int,kind:string>>")
    text = F.col("text")
    for i, r in enumerate(rules):
        ask = F.col("bits").bitwiseAND(F.lit(1 << i)) != 0 if i in queries else text.rlike(r.pattern)
        own = own.withColumn(f"found_{i}", F.when(ask, spans_of(r, i, text)).otherwise(none))
    first = F.concat(*[F.col(f"found_{i}") for i in range(len(base))])
    every = F.concat(*[F.col(f"found_{i}") for i in range(len(rules))])
    return own.select("doc_id", *[F.size(f"found_{i}").cast("long").alias(f"n_{r.kind}") for i, r in enumerate(base)],
                      F.sha2(written_spans(first), 256).alias("base_sha256"), written_spans(every).alias("spans"))
