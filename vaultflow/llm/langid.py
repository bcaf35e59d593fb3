"""Language ID by prediction by partial matching.

For each language a byte context tree holds how often each byte followed each context of up to
ORDER bytes. A byte's code length in the longest context that has it is that of its share there;
each context that lacks it costs an escape, with a probability that grows with the number of
different bytes seen there (PPM method C); below order 0 all 256 bytes are equally likely. The statistics are frozen after
training, so the code lengths of all (context, byte) pairs that any language has seen are worked out once into hash
tables of whole keys, a row of languages each, and a text's exact code length is a sum of look-ups: the longest pair that is known, and
the escapes of the contexts before it. The shortest code names the language.

The score is the language's posterior probability, 2 ** -length against the sum over languages, for SPAN bytes of the text's mean
code length (for the whole text where it is shorter): so it tells how clear the text is, where that of a long
text as a whole would always be 1.

The fit reads a bounded sample: the ``most_languages`` languages with the most texts, of each at most ``per_language`` texts and
``texts`` in all (those with the least hash of doc_id; of a doc_id that repeats one text) of at most ``max_bytes`` bytes. Every text is
scored whole.

Defined cases: a null text or one without a letter is ``und`` with score 0; ties go to the first
language in order; without any training text all are ``und``; repeated rows are scored alike; an empty table
gives no rows; other columns aren't read.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .quality import held_out
from .texthash import U, chunks, text_bytes

ORDER, SPAN = 4, 16
PER_LANGUAGE, TEXTS, MOST_LANGUAGES, MAX_BYTES = 1500, 20_000, 128, 8192
#: Cells (bytes times languages) that are summed at a time.
CELLS = 1 << 22


class Places:
    """The place of each of some distinct keys, by open addressing, for many keys at once."""

    def __init__(self, keys: np.ndarray):
        self.keys, self.bits = keys, max(4, int(4 * len(keys)).bit_length())
        self.slots = np.full(1 << self.bits, -1, np.int32)
        rest, at = np.arange(len(keys)), self.first(keys)
        while len(rest):
            free = np.flatnonzero(self.slots[at] < 0)
            slot, i = np.unique(at[free], return_index=True)
            self.slots[slot] = rest[free[i]]
            left = np.ones(len(rest), bool)
            left[free[i]] = False
            rest, at = rest[left], (at[left] + 1) & (len(self.slots) - 1)

    def first(self, keys: np.ndarray) -> np.ndarray:
        with np.errstate(over="ignore"):
            return ((keys * U(0x9E3779B97F4A7C15)) >> U(64 - self.bits)).astype(np.int64)

    def find(self, keys: np.ndarray) -> np.ndarray:
        """Places of keys, -1 for those that aren't held."""
        at = self.first(keys)
        out = self.slots[at]
        if not len(self.keys):
            return out
        rest = np.flatnonzero((out >= 0) & (self.keys[out] != keys))
        while len(rest):
            at[rest] = (at[rest] + 1) & (len(self.slots) - 1)
            out[rest] = self.slots[at[rest]]
            rest = rest[(out[rest] >= 0) & (self.keys[out[rest]] != keys[rest])]
        return out


def grams(data: np.ndarray, k: int) -> np.ndarray:
    """The last k + 1 bytes at each place as one number; before the first byte there are zeros."""
    out = np.zeros(len(data), U)
    for j in range(k + 1):
        out[j:] |= data[: len(data) - j].astype(U) << U(8 * j)
    return out


def ages(offsets: np.ndarray) -> np.ndarray:
    """Bytes of the same text before each place."""
    return np.arange(offsets[-1]) - np.repeat(offsets[:-1], np.diff(offsets))


@dataclass
class Model:
    languages: list[str]
    #: For each order the pairs of context and byte, and bits of each in each language.
    pairs: list[Places]
    bits: list[np.ndarray]
    #: For each order the contexts, and bits of an escape from each.
    contexts: list[Places]
    escapes: list[np.ndarray]

    def code_lengths(self, data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
        """Bits of each text in each language. Contexts do not reach before a text's start."""
        out = np.zeros((len(offsets) - 1, len(self.languages)))
        for i, j in chunks(offsets, max(1 << 14, CELLS // len(self.languages))):
            own = offsets[i : j + 1] - offsets[i]
            full = np.flatnonzero(np.diff(own))
            if len(full):
                cost = self.costs(data[offsets[i] : offsets[j]], ages(own))
                out[i + full] = np.add.reduceat(cost, own[:-1][full], axis=0, dtype=np.float64)
        return out

    def costs(self, data: np.ndarray, age: np.ndarray) -> np.ndarray:
        """Bits of each byte in each language."""
        cost = np.zeros((len(data), len(self.languages)), np.float32)
        whole, todo = grams(data, ORDER), np.arange(len(data))
        for k in range(ORDER, -1, -1):
            here = age[todo] >= k
            now = todo[here]
            key = whole[now] & U((1 << 8 * (k + 1)) - 1)
            at = self.pairs[k].find(key)
            known = at >= 0
            cost[now[known]] += self.bits[k][at[known]]
            now, at = now[~known], self.contexts[k].find(key[~known] >> U(8))
            cost[now[at >= 0]] += self.escapes[k][at[at >= 0]]
            todo = np.sort(np.concatenate([todo[~here], now])) if k else now
        cost[todo] += 8
        return cost


def tables_of(texts: dict[str, list[bytes]]) -> Model:
    """The model of some texts of each language."""
    languages = sorted(texts)
    seen = []
    for x in languages:
        data = np.frombuffer(b"".join(texts[x]), np.uint8)
        offsets = np.concatenate([[0], np.cumsum([len(t) for t in texts[x]])]).astype(np.int64)
        seen.append((grams(data, ORDER), ages(offsets)))
    model, size = Model(languages, [], [], [], []), len(languages)
    for k in range(ORDER + 1):
        own = [np.unique(g[age >= k] & U((1 << 8 * (k + 1)) - 1), return_counts=True) for g, age in seen]
        keys = np.unique(np.concatenate([x for x, _ in own] or [np.zeros(0, U)]))
        n = np.zeros((len(keys), size))
        for j, (x, count) in enumerate(own):
            n[np.searchsorted(keys, x), j] = count
        contexts, of = np.unique(keys >> U(8), return_inverse=True)
        total, kinds = np.zeros((len(contexts), size)), np.zeros((len(contexts), size))
        np.add.at(total, of, n)
        np.add.at(kinds, of, n > 0)
        escape = np.where(total > 0, np.log2((total + kinds) / np.maximum(kinds, 1), where=total > 0, out=np.zeros_like(total)), 0.0)
        shorter = model.bits[-1][np.searchsorted(model.pairs[-1].keys, keys & U((1 << 8 * k) - 1))] if k else 8.0
        share = np.log2((total + kinds)[of] / np.maximum(n, 1), where=n > 0, out=np.zeros_like(n))
        bits = np.where(n > 0, share, escape[of] + shorter)
        model.pairs.append(Places(keys))
        model.bits.append(bits.astype(np.float32))
        model.contexts.append(Places(contexts))
        model.escapes.append(escape.astype(np.float32))
    return model


def fit(docs: DataFrame, per_language: int = PER_LANGUAGE, texts: int = TEXTS, most_languages: int = MOST_LANGUAGES, max_bytes: int = MAX_BYTES) -> Model:
    """A model from (doc_id, text, lang) of documents that aren't held out."""
    usable = docs.select("doc_id", "lang", "text").filter("lang is not null and doc_id is not null").filter(~held_out(F.col("doc_id"), 3, 1)).filter(F.octet_length("text").between(1, max_bytes))
    counts = usable.groupBy("lang").agg(F.count("*").alias("n")).orderBy(F.desc("n"), "lang").limit(most_languages).collect()
    each = min(per_language, texts // max(1, len(counts)))
    # Some twice as many as wanted are let through by their hash alone, then counted; so no language meets in one task.
    rates = docs.sparkSession.createDataFrame([(r["lang"], 2 * each / r["n"]) for r in counts], "lang string, rate double")
    place = F.pmod(F.xxhash64("doc_id", F.lit("sample")), F.lit(1 << 30)) / float(1 << 30)
    some = usable.join(F.broadcast(rates), "lang").withColumn("place", place).filter("place < rate")  # a row a language
    ids = some.select("lang", "doc_id", "place").distinct().withColumn("k", F.row_number().over(Window.partitionBy("lang").orderBy("place", "doc_id"))).filter(F.col("k") <= each)
    rows = some.join(F.broadcast(ids.select("lang", "doc_id")), ["lang", "doc_id"]).groupBy("lang", "doc_id").agg(F.min("text").alias("text")).collect()  # texts rows at most
    found: dict[str, list[bytes]] = {}
    for r in sorted(rows):
        found.setdefault(r["lang"], []).append(r["text"].encode())
    return tables_of(found)


def predict(docs: DataFrame, model: Model) -> DataFrame:
    """(doc_id, lang_pred, score)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            data, offsets = text_bytes(batch.column("text"))
            letters = batch.column("letters").to_pylist()
            if model.languages:
                bits = model.code_lengths(data, offsets)
                best = bits.argmin(axis=1)
                share = SPAN / np.maximum(np.diff(offsets), SPAN)
                score = 1 / np.exp2(np.clip((bits.min(axis=1, keepdims=True) - bits) * share[:, None], -1000, 0)).sum(axis=1)
            known = [bool(x) and bool(model.languages) for x in letters]
            lang = [model.languages[best[i]] if k else "und" for i, k in enumerate(known)]
            value = [float(score[i]) if k else 0.0 for i, k in enumerate(known)]
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(lang, pa.string()), pa.array(value, pa.float64())], names=["doc_id", "lang_pred", "score"])

    text = F.coalesce(F.col("text"), F.lit(""))
    rows = docs.select("doc_id", text.alias("text"), text.rlike(r"\p{L}").alias("letters"))
    return rows.mapInArrow(run, f"doc_id {docs.schema['doc_id'].dataType.simpleString()}, lang_pred string, score double")


def predict_documents(docs: DataFrame) -> DataFrame:
    """(doc_id, held_out, lang_pred, score)."""
    out = predict(docs, fit(docs))
    return out.select("doc_id", held_out(F.col("doc_id"), 3, 1).alias("held_out"), "lang_pred", "score")
