"""Quality classifier by compression.

Two zstandard dictionaries are trained, one from good and one from bad labelled text. A text that
compresses better with the good dictionary looks good: the difference of the two compressed sizes,
normalised by the text's length and by the sizes, with the two sizes a byte and the length, goes
through a logistic calibration fitted on labelled texts that the dictionaries haven't seen.

The fit reads a bounded sample of the labelled rows: at most ``per_class`` texts of each label (those
with the least hash of doc_id) of at most ``max_bytes`` bytes, one for a doc_id, half of them for the dictionaries.
Scoring reads every text whole.

Defined cases: null and empty texts are scored as empty ones; with fewer than MIN_CLASS sampled texts of
a label every score is the share of label 1 (1 where nothing is labelled); labels that are null
or have no document are left out; repeated rows are scored alike; an empty table gives no
rows; texts are compressed whole, whatever their length; equal texts have equal scores; other columns are carried, but for one with the
score's name, which gives way (``keep_good`` takes a name that no column has).
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import temp_name
from .texthash import text_bytes

PER_CLASS, MAX_BYTES, MIN_CLASS = 2000, 32_768, 20
DICTIONARY, LEVEL = 112_640, 3
#: Score from which a text is good.
GOOD = 0.3


@dataclass
class Model:
    good: bytes
    bad: bytes
    mean: np.ndarray
    scale: np.ndarray
    weights: np.ndarray
    share: float

    def compressors(self):
        out = []
        for raw in (self.good, self.bad):
            d = zstandard.ZstdCompressionDict(raw)
            d.precompute_compress(level=LEVEL)
            out.append(zstandard.ZstdCompressor(level=LEVEL, dict_data=d, write_content_size=False, write_checksum=False, write_dict_id=False))
        return out

    def scores(self, texts: Iterator[bytes]) -> np.ndarray:
        if not self.good:
            return np.array([self.share for _ in texts])
        good, bad = self.compressors()
        x = features([(len(t), len(good.compress(t)), len(bad.compress(t))) for t in texts])
        z = np.clip(((x - self.mean) / self.scale) @ self.weights[1:] + self.weights[0], -40, 40)
        return 1 / (1 + np.exp(-z))


def features(sizes: list[tuple[int, int, int]]) -> np.ndarray:
    raw, good, bad = np.array(sizes, float).reshape(-1, 3).T
    n = np.maximum(raw, 1)
    return np.column_stack([(bad - good) / n, (bad - good) / (bad + good), good / n, bad / n, np.log(n + 1)])


def held_out(doc_id: Column, of: int, rest: int) -> Column:
    return F.crc32(F.coalesce(doc_id.cast("string"), F.lit("")).cast("binary")) % of == rest


def logistic(x: np.ndarray, y: np.ndarray, w: np.ndarray, ridge: float = 1e-3) -> np.ndarray:
    """Weighted logistic regression by damped Newton steps."""
    z = np.column_stack([np.ones(len(x)), x])
    theta = np.zeros(z.shape[1])

    def loss(t):
        s = z @ t
        return float((w * (np.logaddexp(0, s) - y * s)).sum() + ridge * (t @ t) / 2)

    for _ in range(60):
        p = 1 / (1 + np.exp(-np.clip(z @ theta, -40, 40)))
        h = z.T @ (z * (w * np.maximum(p * (1 - p), 1e-9))[:, None]) + ridge * np.eye(len(theta))
        step = np.linalg.solve(h, z.T @ (w * (p - y)) + ridge * theta)
        size, now = 1.0, loss(theta)
        while loss(theta - size * step) > now and size > 1e-6:
            size /= 2
        theta = theta - size * step
        if np.abs(size * step).max() < 1e-8:
            break
    return theta


def fit(docs: DataFrame, labels: DataFrame, per_class: int = PER_CLASS, max_bytes: int = MAX_BYTES) -> Model:
    """A model from labels (doc_id, quality) of documents that aren't held out."""
    sized = docs.select("doc_id", "text").filter(F.octet_length("text").between(1, max_bytes))
    usable = labels.filter("quality in (0, 1) and doc_id is not null").filter(~held_out(F.col("doc_id"), 5, 0)).select("doc_id", "quality").distinct()
    usable = usable.join(sized.select("doc_id"), "doc_id", "left_semi")
    counts = {r[0]: r[1] for r in usable.groupBy("quality").count().collect()}
    total = sum(counts.values())
    share = counts.get(1, 0) / total if total else 1.0
    ids = None
    for q in (0, 1):
        some = usable.filter(F.col("quality") == q).orderBy(F.xxhash64("doc_id"), "doc_id").limit(per_class)
        ids = some if ids is None else ids.unionByName(some)
    # 2 * per_class ids; of a doc_id that repeats one text is read.
    rows = sorted(sized.join(F.broadcast(ids), "doc_id").groupBy("doc_id", "quality").agg(F.min("text").alias("text")).collect())
    texts = {q: [r["text"].encode() for r in sorted(rows, key=lambda r: (r["doc_id"] * 2654435761 % 2**32, r["text"])) if r["quality"] == q] for q in (0, 1)}
    none = np.zeros(0)
    if min(map(len, texts.values())) < MIN_CLASS:
        return Model(b"", b"", none, none, none, share)
    try:
        raw = {q: zstandard.train_dictionary(min(DICTIONARY, max(1024, sum(map(len, t[::2])) // 4)), t[::2]).as_bytes() for q, t in texts.items()}
    except zstandard.ZstdError:  # too little text for a dictionary: the text itself serves
        raw = {q: b"\n".join(t[::2])[:DICTIONARY] for q, t in texts.items()}
    model = Model(raw[1], raw[0], none, none, none, share)
    good, bad = model.compressors()
    seen = [(t, q) for q in (0, 1) for t in texts[q][1::2]]
    x = features([(len(t), len(good.compress(t)), len(bad.compress(t))) for t, _ in seen])
    y = np.array([q for _, q in seen], float)
    w = np.where(y == 1, share / y.mean(), (1 - share) / (1 - y.mean()))
    model.mean, model.scale = x.mean(axis=0), x.std(axis=0) + 1e-9
    model.weights = logistic((x - model.mean) / model.scale, y, w)
    return model


def score(docs: DataFrame, model: Model, name: str = "score") -> DataFrame:
    """docs with a score from 0 to 1; each text is read whole. A column of the caller that has the name gives way."""
    docs = docs.drop(name)
    fields = [f for f in docs.schema.fields]
    text = temp_name(docs, "text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            data, offsets = text_bytes(batch.column(text))
            buffer = data.tobytes()
            s = model.scores(buffer[a:b] for a, b in zip(offsets[:-1].tolist(), offsets[1:].tolist(), strict=True))
            yield pa.RecordBatch.from_arrays([*(batch.column(f.name) for f in fields), pa.array(s, pa.float64())], names=[*(f.name for f in fields), name])

    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in fields) + f", `{name}` double"
    return docs.withColumn(text, F.coalesce(F.col("text"), F.lit(""))).mapInArrow(run, schema)


def score_documents(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """(doc_id, held_out, score, predicted)."""
    model = fit(docs, labels)
    out = score(docs.select("doc_id", "text"), model).drop("text")
    return out.select("doc_id", held_out(F.col("doc_id"), 5, 0).alias("held_out"), "score", (F.col("score") >= GOOD).cast("int").alias("predicted"))


def keep_good(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """The documents that the classifier accepts, with their own columns."""
    name = temp_name(docs, "quality")
    return score(docs, fit(docs, labels), name).filter(F.col(name) >= GOOD).select(*docs.columns)
