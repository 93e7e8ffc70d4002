"""The merge index of exact dedup: filters, lookups and compaction of many runs, and hot groups."""

import numpy as np
import pytest
from pyspark.sql import functions as F

pytest.importorskip("public_tokenizers")

from gristmill.llm.exact_dedup import KEY, Bloom, Run, compacted, exact_dedup


def run_of(keys, ids, known=None, number=0):
    order = np.argsort(keys, kind="stable")
    keys, ids = keys[order], np.array(ids)[order]
    return Run(keys, np.arange(len(keys), dtype=np.int32), ids, np.ones(len(keys), bool) if known is None else known[order], np.ones(len(keys), np.int64), Bloom.of(keys), number)


def test_filters_and_lookups_of_many_runs():
    r = np.random.default_rng(1)
    every = np.array([r.bytes(32) for _ in range(3000)], KEY)
    runs = [run_of(every[pick := r.choice(len(every), n, replace=False)], pick, number=k) for k, n in enumerate((1, 3, 40, 700, 1500, 2))]
    for x in runs:
        assert x.bloom.may_have(x.keys).all()
        assert not len(x.keys) > 100 or x.bloom.may_have(np.array([r.bytes(32) for _ in range(2000)], KEY)).mean() < 0.02
        for y in runs:
            assert x.find(y).tolist() == np.isin(x.keys, y.keys).tolist()
    many = compacted(runs)
    flat = [k for x in runs for k in x.keys.tolist()]
    want = sorted({k for k in flat if flat.count(k) > 1})
    assert many.keys.tolist() == want
    place = {k: i for i, k in enumerate(every.tolist())}
    assert many.ids.tolist() == [place[k] for k in want] and many.rows.tolist() == [flat.count(k) for k in want]


def test_a_hot_group_over_many_runs(spark):
    """A third of all rows are one text; memtables of 50 rows make hundreds of runs."""
    n = 12_000
    docs = spark.range(n).select((n - F.col("id")).alias("doc_id"), F.when(F.col("id") % 3 == 0, F.lit("the same  text")).when(F.col("id") % 3 == 1, F.concat(F.lit("t"), F.floor(F.col("id") / 30))).otherwise(F.concat(F.lit("own "), "id")).alias("text"))
    got = exact_dedup(docs.repartition(8), memtable_rows=50, range_rows=500)
    text = F.regexp_replace("text", " +", " ")
    groups = docs.groupBy(text.alias("body")).agg(F.min("doc_id").alias("keep_id"), F.count(F.lit(1)).alias("group_size"))
    want = docs.join(groups, text == F.col("body")).select("doc_id", "keep_id", "group_size", (F.col("doc_id") == F.col("keep_id")).alias("kept"), F.sha2("body", 256).alias("text_sha256"))
    assert got.count() == n and got.exceptAll(want).isEmpty() and want.exceptAll(got).isEmpty()
