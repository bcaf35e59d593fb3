"""Queries over odd texts against their SQL."""

import os

import duckdb
import pytest

from vaultflow import registry

TEXTS = ["", "   ", "\n\t \n", None, "#", "# ", "# A title\n\nand text", "#\n\ntext", "\u00a0", "a", "İstanbul\r\nand more", "x" * 50, "a\x0bb \x0b", "## " + "word " * 20]


@pytest.fixture(scope="module")
def odd(spark, tmp_path_factory):
    d = str(tmp_path_factory.mktemp("odd"))
    rows = [(i, t, "en", "web", len(t or "")) for i, t in enumerate(TEXTS)]
    spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long").write.parquet(f"{d}/documents.parquet")
    return d


@pytest.mark.parametrize("name", ["stripped_bodies"])
def test_odd_texts(spark, odd, name):
    df = registry.QUERIES[name](spark, odd)
    c = duckdb.connect()
    c.execute(f"create view documents as select * from '{os.path.join(odd, 'documents.parquet')}/*.parquet'")
    for t in ("events", "conversations"):
        c.execute(f"create view {t} as select * from '/root/testdata/sf0.001/{t}.parquet'")
    want = c.execute(f"select {', '.join(df.columns)} from ({registry.ORACLE[name]})").fetchall()
    key = lambda r: [str(x) for x in r]
    assert sorted((tuple(r) for r in df.collect()), key=key) == sorted(want, key=key)
