"""Language identification with hyperdimensional profiles.

Each letter has a random vector of +1 and -1 (bits from its code point, so all
workers agree without a table). An n-gram's vector binds its letters' vectors,
each permuted by its place; a text's vector bundles those of its n-grams, and
a language's prototype bundles its texts. A text gets the language whose
prototype, less the mean of all prototypes, has the largest cosine.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import arrow_batches, crc_mod, mix

DIMENSIONS, N = 1024, 3
#: A text's weight, spread over its n-grams: large enough that none of a text below 4 G letters rounds to zero.
WEIGHT = 1 << 32
#: Distinct n-grams, and texts, that a task holds per language before it bundles them (sums of 2**20 weights are exact in a double).
HELD, HELD_TEXTS = 100_000, 1 << 20
#: A text of so many n-grams or more whose best cosine is below the floor is in no known language (random letters stay
#: below 0.1 at any length; a shorter text tells too little to be rejected).
FLOOR, FLOOR_GRAMS = 0.1, 24
_tables: list[np.ndarray] = []


def letter_tables() -> tuple[np.ndarray, np.ndarray]:
    """For each code point its lower case (if one code point) and whether it is a letter."""
    if not _tables:
        top = 0x110000
        lower, letter = np.arange(top, dtype=np.int64), np.zeros(top, bool)
        for c in range(top):
            s = chr(c)
            if s.isalpha():
                letter[c] = True
                low = s.lower()
                if len(low) == 1:
                    lower[c] = ord(low)
        _tables.extend((lower, letter))
    return _tables[0], _tables[1]


def gram_codes(text: str, n: int = N) -> np.ndarray:
    """The n-grams of a text as numbers, 21 bits a letter: lower case, every run of other characters one space."""
    lower, letter = letter_tables()
    c = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32)
    ok = letter[c]
    if not ok.any():
        return np.empty(0, np.int64)
    c = np.concatenate(([32], np.where(ok, lower[c], 32), [32])).astype(np.int64)
    c = c[np.concatenate(([True], (c[1:] != 32) | (c[:-1] != 32)))]
    out = c[: len(c) - n + 1].copy()
    for i in range(1, n):
        out = out << 21 | c[i : len(c) - n + 1 + i]
    return out


def letter_bits(points: np.ndarray, dimensions: int) -> np.ndarray:
    """Random vectors of letters as packed bits, one row each."""
    at = np.arange(dimensions // 64, dtype=np.uint64) * np.uint64(0xD1342543DE82EF95)
    return mix((points.astype(np.uint64)[:, None] + np.uint64(1)) * np.uint64(0x9E3779B97F4A7C15) + at)


def gram_vectors(codes: np.ndarray, dimensions: int = DIMENSIONS, n: int = N) -> np.ndarray:
    """The bound vectors of n-grams as +1 and -1; a letter's permutation rotates it by its place."""
    bits = np.zeros((len(codes), dimensions // 64), np.uint64)
    for i in range(n):
        points, back = np.unique(codes >> 21 * (n - 1 - i) & 0x1FFFFF, return_inverse=True)
        bits ^= np.roll(letter_bits(points, dimensions), n - 1 - i, axis=1)[back]
    signs = np.unpackbits(bits.view(np.uint8), axis=1).astype(np.float32)
    signs *= 2
    signs -= 1
    return signs


def counted(text: str) -> tuple[np.ndarray, np.ndarray]:
    return np.unique(gram_codes(text), return_counts=True)


def train(docs: DataFrame, dimensions: int = DIMENSIONS) -> tuple[list[str], np.ndarray]:
    """Languages in order and their prototypes, from columns text and lang (rows with a null are left out).

    Every text bundles with weight 2**32 spread over its n-grams, in whole
    numbers, so sums don't depend on their order. What comes to the driver is
    one vector a language.
    """
    arrow_batches(docs.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[str, dict[int, int]] = {}
        texts: Counter = Counter()

        def bundle(lang: str) -> pa.RecordBatch:
            codes = np.array(list(held[lang]), np.int64)
            weights = np.array(list(held[lang].values()), np.float64)
            total = np.zeros(dimensions)
            for at in range(0, len(codes), 8192):
                total += weights[at : at + 8192] @ gram_vectors(codes[at : at + 8192], dimensions).astype(np.float64)
            return pa.record_batch({"lang": pa.array([lang] * dimensions), "place": pa.array(np.arange(dimensions), pa.int32()), "value": pa.array(total.astype(np.int64))})

        for b in batches:
            for text, lang in zip(b.column("text").to_pylist(), b.column("lang").to_pylist(), strict=True):
                codes, counts = counted(text)
                if len(codes):
                    own = held.setdefault(lang, {})
                    for g, w in zip(codes.tolist(), (counts * WEIGHT // counts.sum()).tolist(), strict=True):
                        own[g] = own.get(g, 0) + w
                    texts[lang] += 1
                    if len(own) > HELD or texts[lang] >= HELD_TEXTS:
                        yield bundle(lang)
                        del held[lang], texts[lang]
        for lang in held:
            yield bundle(lang)

    rows = docs.where("text IS NOT NULL AND lang IS NOT NULL").select("text", "lang")
    sums = rows.mapInArrow(run, "lang string, place int, value long").groupBy("lang", "place").agg(F.sum("value").alias("value")).toArrow()
    names = sorted(set(sums.column("lang").to_pylist()))
    out = np.zeros((len(names), dimensions))
    if names:
        row = {x: i for i, x in enumerate(names)}
        out[[row[x] for x in sums.column("lang").to_pylist()], sums.column("place").to_numpy()] = sums.column("value").to_numpy()
        out /= np.maximum(np.linalg.norm(out, axis=1, keepdims=True), 1e-12)
        if len(names) > 1:
            out -= out.mean(axis=0)
            out /= np.maximum(np.linalg.norm(out, axis=1, keepdims=True), 1e-12)
    return names, out.astype(np.float32)


def predict(docs: DataFrame, names: list[str], prototypes: np.ndarray) -> DataFrame:
    """The columns of ``docs`` but text, then lang_pred, score and n_grams (n-grams with repeats) of its column text."""
    others = [c for c in docs.columns if c != "text"]
    ref = docs.sparkSession.sparkContext.broadcast((names, prototypes))

    def part(texts: list[str | None]) -> tuple[list[str], list[float], list[int]]:
        labels, profiles = ref.value
        langs, scores = ["und"] * len(texts), [0.0] * len(texts)
        counts = [counted(t) if t else None for t in texts]
        rows = [i for i, c in enumerate(counts) if c is not None and len(c[0])]
        if rows and labels:
            grams, back = np.unique(np.concatenate([counts[i][0] for i in rows]), return_inverse=True)
            owner = np.repeat(np.arange(len(rows)), [len(counts[i][0]) for i in rows])
            weight = np.concatenate([counts[i][1] for i in rows]).astype(np.float32)
            total = np.zeros((len(rows), profiles.shape[1]), np.float32)
            for at in range(0, len(grams), 8192):
                inside = (back >= at) & (back < at + 8192)
                dense = np.zeros((len(rows), min(8192, len(grams) - at)), np.float32)
                dense[owner[inside], back[inside] - at] = weight[inside]
                total += dense @ gram_vectors(grams[at : at + 8192], profiles.shape[1])
            cosines = total @ profiles.T / np.maximum(np.linalg.norm(total, axis=1, keepdims=True), 1e-9)
            best = cosines.argmax(axis=1)
            for i, k, c in zip(rows, best.tolist(), cosines[np.arange(len(rows)), best].tolist(), strict=True):
                langs[i], scores[i] = labels[k], min(1.0, max(0.0, c))
        return langs, scores, [0 if c is None else int(c[1].sum()) for c in counts]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for at in range(0, b.num_rows, 64):
                some = b.slice(at, 64)
                langs, scores, grams = part(some.column("text").to_pylist())
                yield pa.record_batch({c: some.column(c) for c in others} | {"lang_pred": pa.array(langs, pa.string()), "score": pa.array(scores, pa.float64()), "n_grams": pa.array(grams, pa.int64())})

    kinds = T.StructType([*(docs.schema[c] for c in others), T.StructField("lang_pred", T.StringType()), T.StructField("score", T.DoubleType()), T.StructField("n_grams", T.LongType())])
    return docs.mapInArrow(run, kinds)


def language_id(docs: DataFrame, held_out: Column | None = None, dimensions: int = DIMENSIONS) -> DataFrame:
    """One row per row of ``docs`` (doc_id, text, lang; others ignored): doc_id, held_out, lang_pred, score, n_grams.

    Trains on rows that aren't held out (by default crc32 of the id as text,
    modulo 3, is 1; a null id isn't held out) and have text and lang. A null
    text, or one without a letter, is ``und`` with score 0, as is every text if
    there is nothing to learn from. Equal cosines go to the first language in
    sorting order. Repeated rows pass through; an empty table gives an empty result.
    """
    held_out = F.coalesce(crc_mod(docs["doc_id"], 3) == 1, F.lit(False)) if held_out is None else held_out
    own = docs.select(docs["doc_id"].cast("long").alias("doc_id"), docs["text"], docs["lang"], held_out.alias("held_out"))
    names, prototypes = train(own.where(~F.col("held_out")), dimensions)
    return predict(own, names, prototypes)


def in_known_languages(docs: DataFrame, floor: float = FLOOR, least: int = FLOOR_GRAMS, dimensions: int = DIMENSIONS) -> DataFrame:
    """The rows of ``docs``, all columns, whose text is in a language that its labelled rows teach.

    A null text, or one without a letter, goes; so does a text of ``least``
    n-grams or more whose best cosine is below ``floor``. If there is no
    labelled row to learn from, every text with a letter stays.
    """
    names, prototypes = train(docs, dimensions)
    found = predict(docs.select(F.struct(*[docs[c] for c in docs.columns]).alias("row"), docs["text"]), names, prototypes)
    known = (F.col("n_grams") > 0) & ((F.col("n_grams") < least) | (F.col("score") >= floor) | F.lit(not names))
    return found.where(known).select("row.*")
