"""What the n-gram join keeps on disk."""

import os
import time

from pyspark.sql import functions as F

from vaultflow.llm import common, ngram_join


def test_copies_share_no_columns(spark, monkeypatch):
    """Columns that only copies of one text share are no columns of the product, wherever the copies lie."""
    seen = []

    def written(df):
        out = common.materialize(df)
        seen.append((out.columns, out.count()))
        return out

    monkeypatch.setattr(ngram_join, "materialize", written)
    text = lambda k: " ".join(f"w{k}x{j}" for j in range(60))
    docs = spark.createDataFrame([(c * 10 + k, text(k)) for c in range(6) for k in range(10)], "doc_id long, text string").repartitionByRange(6, "doc_id")
    got = {r.doc_id: r.component_id for r in ngram_join.near_components(docs).collect()}
    assert got == {i: i % 10 for i in range(60)}
    assert next(n for columns, n in seen if columns == ["h", "node", "n", "i"]) == 0


def test_no_shuffle_files_stay(spark):
    manager = spark._jvm.org.apache.spark.SparkEnv.get().blockManager().diskBlockManager()
    files = lambda: {f for d in manager.localDirsString() for _, _, names in os.walk(d) for f in names if f.startswith("shuffle_")}
    before = files()
    common.materialize(spark.range(10_000).groupBy(F.pmod(F.xxhash64("id"), F.lit(977)).alias("k")).count())
    until = time.time() + 20
    while files() - before and time.time() < until:
        time.sleep(0.2)
    assert not files() - before


def test_pipeline_keeps_one_stage(spark, monkeypatch):
    """A stage's documents are deleted as soon as the next one's are written."""
    import corpus_pipeline

    left = []

    def written(df):
        out = common.materialize(df)
        left.append([p for p in paths if os.path.exists(p)])
        paths.append(out.stored_at.removeprefix("file://").removeprefix("file:"))
        return out

    paths = []
    monkeypatch.setattr(corpus_pipeline, "materialize", written)
    monkeypatch.setattr(corpus_pipeline, "STAGES", [(str(k), lambda spark, docs, d, k=k: docs.filter(F.col("doc_id") % 7 != k)) for k in range(4)])
    assert corpus_pipeline.run(spark, "/root/testdata/sf0.001").count() > 0
    assert [len(x) for x in left] == [0, 1, 1, 1] and [os.path.exists(p) for p in paths] == [False, False, False, True]
