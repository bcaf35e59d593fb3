"""Whole results of the two classifiers against plain Python: each document scored alone from its parts."""

import collections
import math
import re
import zlib

import zstandard

from vaultflow.llm import langid, quality, queries
from vaultflow.llm.common import tables

DATA = "/root/testdata/sf0.001"
#: Large enough for dictionaries of both labels.
LABELLED = "/root/testdata/sf0.01"


def held_out(doc_id, of, rest):
    return zlib.crc32(str(doc_id).encode()) % of == rest


def test_quality_scores(spark):
    """Two compressed sizes, the features and the calibrated sum, for every document."""
    docs = tables(spark, LABELLED, "documents")
    model = quality.fit(docs, tables(spark, LABELLED, "labels"))
    assert model.good and model.bad

    def size(text, raw):
        held = zstandard.ZstdCompressionDict(raw)
        held.precompute_compress(level=quality.LEVEL)
        return len(zstandard.ZstdCompressor(level=quality.LEVEL, dict_data=held, write_content_size=False, write_checksum=False, write_dict_id=False).compress(text))

    want = {}
    for r in docs.collect():
        text = (r.text or "").encode()
        n, good, bad = max(1, len(text)), size(text, model.good), size(text, model.bad)
        x = [(bad - good) / n, (bad - good) / (bad + good), good / n, bad / n, math.log(n + 1)]
        z = model.weights[0] + sum(w * (v - m) / s for w, v, m, s in zip(model.weights[1:], x, model.mean, model.scale, strict=True))
        want[r.doc_id] = 1 / (1 + math.exp(-z))
    rows = queries.op7_quality(spark, LABELLED).collect()
    assert len(rows) == len(want)
    for r in rows:
        assert math.isclose(r.score, want[r.doc_id], rel_tol=1e-9, abs_tol=1e-12)
        assert r.predicted == (r.score >= 0.3) and r.held_out == held_out(r.doc_id, 5, 0)


def test_language_predictions(spark):
    """The language of the shortest code by a walk through counts of all contexts, for every tenth document that was not learnt from and is short."""
    docs = tables(spark, DATA, "documents")
    rows = docs.collect()
    learnt = [r for r in rows if r.lang and r.text and not held_out(r.doc_id, 3, 1) and len(r.text.encode()) <= langid.MAX_BYTES]
    assert 0 < len(learnt) < langid.PER_LANGUAGE  # the sample takes all of them
    seen = {}
    for r in learnt:
        data, own = r.text.encode(), seen.setdefault(r.lang, collections.defaultdict(collections.Counter))
        for i in range(len(data)):
            for k in range(min(i, langid.ORDER) + 1):
                own[data[i - k : i]][data[i]] += 1
    total = {lang: {c: (sum(n.values()), len(n)) for c, n in own.items()} for lang, own in seen.items()}

    def bits(lang, data):
        own, sums, out = seen[lang], total[lang], 0.0
        for i, b in enumerate(data):
            for k in range(min(i, langid.ORDER), -1, -1):
                context = data[i - k : i]
                if context in sums:
                    n, kinds = sums[context]
                    if b in own[context]:
                        out += math.log2((n + kinds) / own[context][b])
                        break
                    out += math.log2((n + kinds) / kinds)
            else:
                out += 8
        return out

    got = {r.doc_id: r for r in queries.op8_language_id(spark, DATA).collect()}
    assert len(got) == len(rows)
    checked = 0
    for r in rows:
        text = r.text or ""
        assert got[r.doc_id].held_out == held_out(r.doc_id, 3, 1)
        if not re.search(r"[^\W\d_]", text):
            assert got[r.doc_id].lang_pred == "und"
        elif len(text) < 1500:
            cost = {lang: bits(lang, text.encode()) for lang in seen}
            best = min(cost.values())
            assert cost[got[r.doc_id].lang_pred] <= best * (1 + 1e-5) + 1e-3
            checked += 1
    assert checked > 30
