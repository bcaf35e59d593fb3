"""Byte-level BPE against the tokenizers library."""

import hashlib
import random

import numpy as np
import public_tokenizers
import pytest
from pyspark.sql import functions as F
from test_llm import CLASH, DOCS, odd_rows
from tokenizers import Tokenizer

from vaultflow.llm import bpe, queries
from vaultflow.llm.common import tables

PATH = public_tokenizers.path("byte_bpe_50k.json")
#: Letters on which versions of Unicode differ, all sorts of white space, and other signs beyond ASCII.
ODD = [chr(c) for c in (0x558, 0xC5C, 0x3000, 0xA0, 0x85, 0x1680, 0x2028, 0x1C, 0x661, 0x2164, 0x1F600, 0x10941, 0xE9, 0x301, 0xFF, 0x200B)]


@pytest.fixture(scope="module")
def library():
    return Tokenizer.from_file(PATH)


@pytest.fixture(scope="module")
def ours():
    return bpe.load(PATH)


def ids_of(text, t, size=bpe.CHUNK):
    return np.frombuffer(b"".join(bpe.encoded([text[i : i + size] for i in range(0, len(text), size)], t)), "<u4").tolist()


def test_short_texts(library, ours):
    r = random.Random(3)
    letters = [*"abeitnos AEI019'\"!.,-  \n\t", *ODD, "<|endoftext|>", "<|endof", "'s", "'re", " the", "ing"]
    for _ in range(1500):
        text = "".join(r.choice(letters) for _ in range(r.choice([0, 3, 10, 40, 200])))
        want = library.encode(text, add_special_tokens=False).ids
        assert all(ids_of(text, ours, size) == want for size in (1, 2, 17, bpe.CHUNK)), text


def test_long_runs(library, ours, monkeypatch):
    monkeypatch.setattr(bpe, "RUN", 64)
    r = random.Random(4)
    for letters in ["ab", "aeinrst", " ", "= ", "\n", "0123", "=-_", "ab'é", "!<|>endoftext", "the in", "一二三", " \n", "🙂x"] * 4:
        text = "".join(r.choice(letters) for _ in range(r.choice([300, 3000, 9000]))) + r.choice(["", " x", "y", "!"])
        want = library.encode(text, add_special_tokens=False).ids
        assert all(ids_of(text, ours, size) == want for size in (7, 130, 1000)), text[:50]


def test_memory_is_bounded(library, ours):
    run = bpe.Transducer(ours)
    out = b"".join(run.feed(b"abcde" * 20) for _ in range(400)) + run.finish()
    assert np.frombuffer(out, "<u4").tolist() == library.encode("abcde" * 8000, add_special_tokens=False).ids
    assert run.most <= 2 * ours.window and not run.held


def test_lookahead_suffices():
    """Over all short inputs of small merge lists: what is stable never changes, whatever follows."""
    r = random.Random(5)
    for _ in range(60):
        known, merges = [b"a", b"b"], []
        while len(merges) < 6:
            a, b = r.choice(known), r.choice(known)
            if a + b not in known:
                merges.append((a, b))
                known.append(a + b)
        ids = {t: i for i, t in enumerate(known)}
        ranked = {ids[a] << 32 | ids[b]: (k + 1) << 32 | ids[a + b] for k, (a, b) in enumerate(merges)}
        single = [0] * 256
        single[ord("b")] = 1
        t = bpe.Tokenizer(known, ranked, single, {}, {}, bpe.lookahead(merges))
        for _ in range(40):
            head = bytes(r.choice(b"ab") for _ in range(t.reach + 12))
            seen = set()
            for _ in range(8):
                end, stable = 0, []
                for token in t.tokens(head + bytes(r.choice(b"ab") for _ in range(r.randrange(8)))):
                    end += len(known[token])
                    if end <= len(head) - t.reach:
                        stable.append(token)
                seen.add(tuple(stable))
            assert len(seen) == 1
    with pytest.raises(ValueError):
        bpe.lookahead([(b"ab", b"c")])
    with pytest.raises(ValueError):
        bpe.lookahead([(b"a", b"b"), (b"b", b"c"), (b"ab", b"c"), (b"a", b"bc")])


def test_decoder(library, ours):
    """Any ids, also such as form no character, in pieces of any size."""
    r = random.Random(6)
    for _ in range(500):
        ids = [r.randrange(len(ours.pieces)) for _ in range(r.choice([1, 5, 30]))]
        for size in (1, 3, 100):
            d = bpe.Decoder(ours.pieces)
            got = "".join([*(d.feed(bpe.pack(ids[i : i + size])) for i in range(0, len(ids), size)), d.finish()])
            assert got == library.decode(ids, skip_special_tokens=False)


def brute(text, library):
    ids = library.encode(text or "", add_special_tokens=False).ids
    back = library.decode(ids, skip_special_tokens=False)
    return len(ids), hashlib.sha256(np.array(ids, "<u4").tobytes()).hexdigest(), hashlib.sha256(back.encode()).hexdigest()


def test_query(spark, library):
    sf = "/root/testdata/sf0.001"
    want = sorted((r.doc_id, *brute(r.text, library)) for r in tables(spark, sf, "documents").collect())
    assert sorted(tuple(r) for r in queries.op13_bpe(spark, sf).collect()) == want


def test_odd_rows(spark, library):
    docs = spark.createDataFrame([*odd_rows(), (90, "a" * 100_000, None, None, 1), (91, "x <|endoftext|> y", None, None, 1)], DOCS).repartition(3)
    crowded = docs.withColumns({c: F.lit("x") for c in CLASH})
    want = sorted(((r.doc_id, *brute(r.text, library)) for r in docs.collect()), key=repr)
    assert sorted((tuple(r) for r in bpe.digest_documents(crowded, PATH).collect()), key=repr) == want
    assert bpe.digest_documents(docs.limit(0), PATH).count() == 0
    back = bpe.decode(bpe.encode(crowded, PATH), PATH).collect()
    assert len(back) == docs.count() and all((r.text or "") == r.decoded and r["size"] == "x" for r in back)
    with pytest.raises(ValueError):
        bpe.encode(docs.withColumn("IDS", F.lit(1)), PATH)
