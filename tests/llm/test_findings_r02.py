"""What the second review found: texts that travel though no key asks for them."""

import numpy as np
import pytest
from pyspark.sql import functions as F

pytest.importorskip("public_tokenizers")

import corpus_pipeline
from gristmill.llm import common
from gristmill.llm.common import written

SF = "/root/testdata/sf0.001"


def shuffled(spark):
    """Bytes that all stages so far wrote to shuffles."""
    jvm, context = spark.sparkContext._jvm, spark.sparkContext._jsc.sc()
    context.listenerBus().waitUntilEmpty()
    stages = context.statusStore().stageList(jvm.java.util.ArrayList(), False, False, spark.sparkContext._gateway.new_array(jvm.double, 0), jvm.java.util.ArrayList())
    return sum(stages.apply(i).shuffleWriteBytes() for i in range(stages.size()))


@pytest.mark.parametrize("stage", ["exact_dedup", "simhash_near_dedup"])
def test_only_texts_that_a_key_asks_for_travel(spark, stage):
    """However large the tables are: no join is small enough to broadcast, and still the other texts stay where they are."""
    r = np.random.default_rng(11)
    texts = [" ".join(f"{x:x}" for x in r.integers(0, 1 << 60, 250)) for _ in range(1000)]
    rows = [(i, t, "en") for i, t in enumerate(texts)] + [(5000 + i, texts[i] + (" end" if stage == "simhash_near_dedup" else ""), "en") for i in range(20)] + [(None, texts[30], "en")]
    docs = written(spark.createDataFrame(rows, "doc_id long, text string, lang string"), "docs")
    usual = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        before = shuffled(spark)
        kept = written(dict(corpus_pipeline.STAGES)[stage](spark, docs, SF), "kept")
        wrote = shuffled(spark) - before
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", usual)
    assert sorted(x.doc_id if x.doc_id is not None else -1 for x in kept.select("doc_id").collect()) == list(range(1000))
    assert kept.columns == docs.columns
    assert 0 < wrote < sum(map(len, texts)) / 4


@pytest.mark.parametrize("cells", [1, 1 << 18])
def test_sifted_loses_no_row(spark, monkeypatch, cells):
    """All rows of keys are in the second frame, and both hold all rows, also where the filter is far too small."""
    monkeypatch.setattr(common, "CELLS", cells)
    rows = spark.range(3000).select(F.when(F.col("id") > 0, F.col("id")).alias("k"), F.lit("x").alias("a.b"))
    keys = rows.where("k IS NULL OR k % 10 = 0").select("k")
    stay, maybe = common.sifted(rows, rows["k"], keys)
    assert stay.columns == rows.columns == maybe.columns
    assert sorted((x.k or 0) for x in stay.union(maybe).collect()) == list(range(3000))
    assert {x.k for x in maybe.collect()} >= {x.k for x in keys.collect()}
    assert cells == 1 or stay.count() > 2500
    assert common.sifted(rows, rows["k"], keys.limit(0))[0].count() == 3000
