"""Hard negatives against all products."""

import random

import numpy as np
import pytest
from pyspark.sql import functions as F
from test_llm import CLASH

from vaultflow.llm import negatives

SCHEMA = "vec_id long, embedding array<float>, label int"


def brute(rows, every=100):
    out, kept = [], []
    for vec_id, v, label in rows:
        if vec_id is None or label is None or v is None or any(x is None or not np.isfinite(x) for x in v):
            continue
        q = [int(np.floor(256 * float(np.float32(x)))) for x in v]
        kept.append((vec_id, (label + 1) % 10 if vec_id % 7 == 0 else label, q))
    dot = lambda a, b: sum(x * y for x, y in zip(a, b, strict=False))
    for i, (a, label, q) in enumerate(kept):
        if a % every:
            continue
        scored = [(-dot(q, v), b, other == label) for j, (b, other, v) in enumerate(kept) if j != i]
        for p, pid, _ in sorted(x for x in scored if x[2])[:5]:
            found = sorted((n, nid) for n, nid, same in scored if not same and -80 * p <= -100 * n <= -100 * p)
            out += [(a, pid, k, nid, -p, -n) for k, (n, nid) in enumerate(found[:5], 1)]
    return sorted(out)


def made(seed, n, dims=8, labels=4, spread=0.2):
    r = np.random.default_rng(seed)
    centers = r.normal(size=(labels, dims))
    rows = []
    for i in range(n):
        v = centers[r.integers(labels)] + spread * r.normal(size=dims)
        rows.append((i, [float(x) for x in v / np.linalg.norm(v)], int(r.integers(labels))))
    return rows


def got(df, *args):
    return sorted(tuple(r) for r in df.select("anchor_id", "positive_id", "rank", "negative_id", "positive_score", "negative_score").collect())


@pytest.mark.parametrize("at_once", [40, 65_536])
def test_rows(spark, at_once, monkeypatch):
    monkeypatch.setattr(negatives, "LEAF", 8)
    monkeypatch.setattr(negatives, "FAN", 4)
    monkeypatch.setattr(negatives, "ANCHORS", 5)
    rows = made(1, 420)
    hot = rows[100][1]
    rows += [(1000 + i, hot, i % 3) for i in range(60)] + [rows[200], rows[100], (300, rows[5][1], 2)]
    rows += [(2000, None, 1), (2100, rows[0][1], None), (None, hot, 1), (2200, [float("nan")] * 8, 1), (2300, [float("inf")] + [0.0] * 7, 1), (2400, [0.5, None] + [0.0] * 6, 1)]
    rows += [(2500, [], 1), (2600, [0.9, 0.1], 1), (2700, [-x for x in hot], 3), (2800, [0.0] * 8, 2), (-100, [3.0 * x for x in hot], 1), (2900, hot, 7)]
    random.Random(2).shuffle(rows)
    df = spark.createDataFrame(rows, SCHEMA).repartition(3).withColumns({c: F.lit("x") for c in [*CLASH, "uid", "id", "q", "tops", "block"]})
    moved = F.expr("if(vec_id % 7 = 0, (label + 1) % 10, label)")
    want = brute(rows)
    assert want and got(negatives.mine(df, F.col("id") % 100 == 0, moved, at_once=at_once)) == want
    assert got(negatives.mine_embeddings(df)) == want


def test_small_tables(spark):
    for rows in ([], [(0, [1.0, 0.0], 1)], [(0, [1.0, 0.0], 1), (1, [1.0, 0.0], 1)], [(100, [1.0], 1), (2, [0.5], 1), (3, [0.45], 2)]):
        assert got(negatives.mine_embeddings(spark.createDataFrame(rows, SCHEMA))) == brute(rows)


def test_tree_covers_and_skips(monkeypatch):
    monkeypatch.setattr(negatives, "LEAF", 128)
    rows = made(3, 4000, spread=0.05)
    q = np.floor(256 * np.array([v for _, v, _ in rows])).astype(np.int64)
    ids = np.arange(4000)
    t = negatives.Tree.loads(negatives.Tree(q, ids, np.array([x for _, _, x in rows]), ids).dumps())
    t.ready(300.0)
    leaves = int((t.children == 0).sum())
    assert sorted(t.ids) == list(range(4000)) and t.level.max() >= 2 and leaves > 20
    visited = []
    for i in range(0, 4000, 97):
        upper, lower = t.bounds(q[i : i + 1])
        products = t.q.astype(np.int64) @ q[i]
        for k in range(len(t.start)):  # bounds hold for all rows below a node
            inside = products[t.start[k] : t.end[k]]
            assert lower[0][k] <= inside.min() and inside.max() <= upper[0][k]
        seen = {}
        best = t.search(q[i].astype(t.kind), upper[0], lower[0], 5, (-1e18, 1e18), seen, rows[i][2], True, i)
        at = [j for j in range(4000) if rows[j][2] == rows[i][2] and j != i]
        assert best == sorted((-int(q[j] @ q[i]), j) for j in at)[:5]
        visited.append(len(seen))
    assert np.mean(visited) < leaves / 2


def test_exact_in_any_size():
    r = np.random.default_rng(4)
    for size, kind in ((100, np.float32), (1 << 20, np.float64), (1 << 27, np.int64)):
        q = r.integers(-size, size, (300, 16))
        t = negatives.Tree(q, np.arange(300), np.zeros(300, np.int64), np.arange(300))
        t.ready(float(negatives.norms(q).max()))
        assert t.kind is kind
        upper, lower = t.bounds(q[:1])
        best = t.search(q[0].astype(t.kind), upper[0], lower[0], 5, (-(1 << 62), 1 << 62), {}, 0, True, 0)
        exact = sorted((-sum(int(a) * int(b) for a, b in zip(q[0], x, strict=True)), j) for j, x in enumerate(q) if j)[:5]
        assert best == exact
    t = negatives.Tree(np.full((2, 16), 1 << 30), np.arange(2), np.zeros(2, np.int64), np.arange(2))
    with pytest.raises(OverflowError):
        t.ready(float(1 << 32))
