"""What the first review found missing: near copies, rows without an id, passages of a pair, long texts."""

import numpy as np
import pytest
from pyspark.sql import functions as F

pytest.importorskip("public_tokenizers")

import corpus_pipeline
from gristmill.llm import simhash
from gristmill.llm.common import written
from gristmill.llm.components import components
from gristmill.llm.language_id import counted, gram_vectors, train
from gristmill.llm.simhash import copies, runs_of
from gristmill.llm.substring_dedup import chains, shared_passages

SF = "/root/testdata/sf0.001"


def fresh(r, n):
    return [f"u{x}" for x in r.integers(0, 10**9, n)]


def test_near_stage_drops_copies_by_content(spark):
    """Copies with a word changed here and there (0.8 or more of the five-word runs) go, half-equal texts stay, null ids row by row."""
    r = np.random.default_rng(5)
    rows, gone = [], set()
    for i in range(40):
        text = fresh(r, 200)
        copy, half = list(text), text[:100] + fresh(r, 100)
        for at in (30, 90, 150):  # 15 of 196 runs differ: 181 / 211 = 0.86
            copy[at] = "other"
        rows += [(100 + i, text), (200 + i, copy), (300 + i, half)]
        gone.add(200 + i)
    rows += [(None, " ".join(fresh(r, 50))), (None, " ".join([*rows[0][1][:199], "end"]))]
    rows = [(i, t if isinstance(t, str) else " ".join(t), "en") for i, t in rows]
    docs = written(spark.createDataFrame(rows, "doc_id long, text string, lang string"), "docs")
    kept = corpus_pipeline.near(spark, docs, SF).collect()
    assert sorted(x.doc_id or 0 for x in kept) == sorted({i or 0 for i, *_ in rows} - gone)
    assert [x.text for x in kept if x.doc_id is None] == [rows[-2][1]]


def test_copies_against_brute_force():
    r = np.random.default_rng(3)
    texts = [b" ".join(b"w%d" % x for x in r.integers(0, 9, n)) for n in r.integers(0, 12, 120)]
    sets, fp = [runs_of(t, 2) for t in texts], np.zeros(120, np.int64)
    label = list(range(120))
    for i in range(120):
        for j in range(i):
            a, b = set(sets[i].tolist()), set(sets[j].tolist())
            if len(a & b) >= 0.6 * len(a | b):
                x, y = label[i], label[j]
                label = [min(x, y) if v in (x, y) else v for v in label]
    assert copies(fp, sets, 9, 0.6).tolist() == label


def test_decontamination_decides_row_by_row(spark):
    r = np.random.default_rng(11)
    item = spark.read.parquet(f"{SF}/benchmark.parquet").orderBy(F.length("text").desc()).first().text
    rows = [(None, " ".join([*fresh(r, 40), item])), (None, " ".join(fresh(r, 40))), (5, " ".join([*fresh(r, 40), item])), (5, " ".join(fresh(r, 40)))]
    docs = spark.createDataFrame([(*x, "en") for x in rows], "doc_id long, text string, lang string")
    kept = {(x.doc_id, x.text) for x in corpus_pipeline.decontaminated(spark, docs, SF).collect()}
    assert kept == {rows[1], rows[3]}


def test_chain_after_a_gap_joins_its_own_neighbours():
    """A long chain before the gap must not stand in the way of the matches after it."""
    first, second = np.arange(0, 300, 5), np.arange(360, 510, 5)
    a = np.concatenate([first, second])
    assert [len(c) for c in chains(a, a.copy())] == [60, 30]


def test_both_passages_of_a_pair_are_found(spark):
    r = np.random.default_rng(2)
    long, short = fresh(r, 300), fresh(r, 150)
    rows = [(1, [*long, *fresh(r, 60), *short]), (2, [*long, *fresh(r, 60), *short])]
    docs = spark.createDataFrame([(i, " ".join(t)) for i, t in rows], "doc_id long, text string")
    got = shared_passages(docs).orderBy("start").collect()
    assert [(x.doc_id, x.other_id, x.start, x.end, x.other_start, x.other_end) for x in got] == [(2, 1, 0, 300, 0, 300), (2, 1, 360, 510, 360, 510)]


def test_a_long_text_teaches_all_its_ngrams(spark):
    """Thousands of n-grams that occur once each weigh as much as they do in prediction."""
    r = np.random.default_rng(4)
    text = "".join(chr(0x4E00 + x) for x in r.integers(0, 15_000, 6000))
    names, got = train(spark.createDataFrame([(text, "zh")], "text string, lang string"))
    codes, counts = counted(text)
    want = counts.astype(np.float64) @ gram_vectors(codes).astype(np.float64)
    assert names == ["zh"] and np.allclose(got[0], want / np.linalg.norm(want), atol=1e-4)


def test_language_stage_rejects_random_letters(spark):
    """The profiles decide: prose stays, long strings of random letters go; without labels all texts with letters stay."""
    r = np.random.default_rng(12)
    junk = [(9000 + i, "".join(chr(97 + x) if x < 26 else " " for x in r.integers(0, 31, 400)), None) for i in range(20)]
    docs = spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text", "lang")
    more = docs.unionByName(spark.createDataFrame([*junk, (9100, "Ok", None), (9101, "12 34", None), (9102, None, "en")], "doc_id long, text string, lang string"))
    gone = {x.doc_id for x in more.exceptAll(corpus_pipeline.language(spark, more, SF)).collect()}
    assert gone == {x[0] for x in junk} | {9101, 9102}
    none = more.withColumn("lang", F.lit(None).cast("string"))
    assert {x.doc_id for x in none.exceptAll(corpus_pipeline.language(spark, none, SF)).collect()} == {9101, 9102}


def brute_copies(rows, same=0.8, bits=64):
    """Labels of texts linked by their sets of five-word runs."""
    sets = [set(runs_of((t or "").encode()).tolist()) for _, t in rows]
    label = list(range(len(rows)))
    for i in range(len(rows)):
        for j in range(i):
            if label[i] != label[j] and len(sets[i] & sets[j]) >= same * len(sets[i] | sets[j]) - 1e-9:
                x, y = label[i], label[j]
                label = [min(x, y) if v in (x, y) else v for v in label]
    return label


@pytest.mark.parametrize("block", [2048, 16])
def test_near_copies_in_blocks_against_brute_force(spark, monkeypatch, block):
    """Large groups of near copies, chains among them, in one block or many: the same rows go."""
    monkeypatch.setattr(simhash, "BLOCK_ROWS", block)
    r = np.random.default_rng(15)
    rows = []
    for family in range(5):
        text = fresh(r, 260)
        for step in range(40):
            own = list(text) if step % 4 else list(text := [*text[:-6], *fresh(r, 6)])
            for at in r.integers(0, len(own), int(r.integers(0, 3))):
                own[at] = "other"
            rows.append((1000 * family + step, " ".join(own)))
    label = brute_copies(rows)
    docs = written(spark.createDataFrame(rows, "doc_id long, text string"), "docs")
    gone = {x.doc_id for x in simhash.near_copies(docs, bits=9, leaf=64).collect()}
    assert gone == {rows[i][0] for i in range(len(rows)) if label[i] != i}
    assert 100 < len(gone) < 199


def test_fingerprints_that_share_a_half_are_dealt_out(spark):
    """Thousands of fingerprints with one half: no shard holds them all, and no link is lost."""
    r = np.random.default_rng(16)
    low = r.integers(0, 1 << 32, 6000, dtype=np.int64)
    low[:1000] = low[1000:2000] ^ (np.int64(1) << r.integers(0, 31, 1000)) ^ (np.int64(1) << r.integers(0, 31, 1000))
    fp = np.unique(np.concatenate([low | (np.int64(0x1234567) << 32), r.integers(0, 1 << 62, 500, dtype=np.int64)]))
    whole = fp.view(np.uint64)
    want = np.arange(len(fp))
    for i in range(len(fp)):
        near = np.flatnonzero(np.bitwise_count(whole ^ whole[i]) <= 3)
        if len(near) > 1:
            old = np.unique(want[near])
            want[np.isin(want, old)] = old[0]
    docs = written(spark.createDataFrame([(int(x),) for x in fp], "fp long"), "fp")
    got = {x.u: x.v for x in components(simhash.links(docs, len(fp), 3, leaf=64)).collect()}
    assert [got.get(x, x) for x in fp.tolist()] == fp[want].tolist() and len(got) > 900
