"""Vectors of chunks: semantic search, related pages, what to embed again."""

from __future__ import annotations

import re

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

FLOOR, RELATIVE = 0.30, 0.55
BLOCK = 2048
#: Rows of a block in a search, queries multiplied at once, and blocks that small tables make at most.
WIDE, SLICE, IDLE = 16384, 512, 12
FOUND = pa.schema([("query_id", pa.int64()), ("vault", pa.string()), ("page_id", pa.string()), ("score", pa.float64())])


def _matrix(column: pa.Array) -> np.ndarray:
    flat = column.flatten().to_numpy(zero_copy_only=False).astype(np.float64)
    return flat.reshape(len(column), -1) if len(column) else np.zeros((0, 0))


def _best(scores: DataFrame, keys: list[str], limit: int) -> DataFrame:
    w = Window.partitionBy(*keys)
    kept = scores.withColumn("_top", F.max("score").over(w)).filter(F.col("score") >= F.col("_top") * RELATIVE).drop("_top")
    return kept.withColumn("rank", F.row_number().over(w.orderBy(F.desc(F.round("score", 6)), "page_id"))).filter(F.col("rank") <= limit)


def _blocks(table: DataFrame, block: int) -> DataFrame:
    """(blocks): how many blocks the rows of table make, as one row. Small tables get blocks of BLOCK rows, for the sake of idle cores."""
    n = F.count("*")
    return table.agg(F.greatest(F.lit(1), F.ceil(n / block), F.least(F.lit(IDLE), F.ceil(n / min(block, BLOCK)))).cast("int").alias("blocks"))


def semantic_search(query_vectors: DataFrame, vectors: DataFrame, limit: int = 10, block: int = WIDE) -> DataFrame:
    """(query_id, vault, page_id, score, rank): the best chunk of each page by dot product.

    Exact, in blocks: queries and vectors are dealt to blocks of about ``block`` rows, and each block of queries meets each block of
    vectors in one task. Of its scores only the best of each page leaves it, if it reaches the floor and the relative cut
    of the block, which is never above that of the whole vault."""
    q, v = query_vectors.select("query_id", "embedding"), vectors.select("vault", "page_id", "embedding")
    of_q, of_v = _blocks(q, block), _blocks(v, block)
    deal = lambda n, *keys: F.pmod(F.xxhash64(*keys), n).cast("int")
    both = of_q.withColumnRenamed("blocks", "nq").crossJoin(of_v.withColumnRenamed("blocks", "nv"))
    every = lambda n: F.explode(F.sequence(F.lit(0), F.col(n) - 1))
    asked = q.crossJoin(F.broadcast(both)).withColumn("i", deal(F.col("nq"), "query_id", "embedding")).withColumn("j", every("nv"))
    stored = v.crossJoin(F.broadcast(both)).withColumn("j", deal(F.col("nv"), "vault", "page_id", "embedding")).withColumn("i", every("nq"))
    asked = asked.select("i", "j", F.col("query_id").cast("long").alias("query_id"), F.lit(None).cast("string").alias("vault"), F.lit(None).cast("string").alias("page_id"), "embedding", F.lit(True).alias("asks"))
    stored = stored.select("i", "j", F.lit(None).cast("long").alias("query_id"), "vault", "page_id", "embedding", F.lit(False).alias("asks"))

    def run(key, table):
        asks = table.column("asks")
        mine, theirs = (x.combine_chunks() for x in (table.filter(asks), table.filter(pc.invert(asks))))
        whole = lambda t, c: pa.concat_arrays(t.column(c).chunks) if t.num_rows else pa.array([], t.schema.field(c).type)
        ids, m, x = whole(mine, "query_id"), _matrix(whole(mine, "embedding")), _matrix(whole(theirs, "embedding"))
        found = []
        for start in range(0, len(m) if len(x) else 0, SLICE):
            s = m[start : start + SLICE] @ x.T
            a, c = np.nonzero(s >= FLOOR)
            part = pa.table({"query_id": ids.take(pa.array(a + start)), "vault": whole(theirs, "vault").take(pa.array(c)), "page_id": whole(theirs, "page_id").take(pa.array(c)), "score": pa.array(s[a, c])})
            found.append(part.group_by(["query_id", "vault", "page_id"]).aggregate([("score", "max")]).rename_columns(["query_id", "vault", "page_id", "score"]).cast(FOUND))
        out = pa.concat_tables([FOUND.empty_table(), *found])
        top = out.group_by(["query_id", "vault"]).aggregate([("score", "max")])
        out = out.join(top, ["query_id", "vault"]) if out.num_rows else out.append_column("score_max", out.column("score"))
        near = pc.greater_equal(out.column("score"), pc.multiply(out.column("score_max"), RELATIVE))
        return out.filter(near.fill_null(True)).select(FOUND.names)  # a null vault has no partner in the join

    scores = asked.unionByName(stored).groupBy("i", "j").applyInArrow(run, "query_id long, vault string, page_id string, score double")
    return _best(scores.groupBy("query_id", "vault", "page_id").agg(F.max("score").alias("score")), ["query_id", "vault"], limit)


def _first(pages: np.ndarray, limit: int) -> tuple[np.ndarray, np.ndarray]:
    """(row, column) of what can be among the first ``limit`` of a row of scores by page: at the floor or over it, not below the relative cut of what is here,
    and with ties of the last one."""
    top = pages.max(axis=1, keepdims=True, initial=0.0)
    keep = pages >= np.maximum(FLOOR, RELATIVE * top)
    if pages.shape[1] > limit:
        rounded = np.round(pages, 6)
        keep &= rounded >= np.partition(rounded, -limit, axis=1)[:, -limit, None]
    return np.nonzero(keep)


def related(vectors: DataFrame, limit: int = 8, block: int = BLOCK) -> DataFrame:
    """(vault, src, page_id, score, rank): for every page the pages nearest by their best pair of chunks.

    Exact and quadratic within a vault, in blocks: pages are dealt with all their chunks to blocks of about ``block`` chunks, and each block is sent to
    the others, where one matrix product gives all scores of two blocks. It is folded to pages, and of a page only what may be among
    its first ``limit`` leaves the task."""
    counts = vectors.groupBy("vault").agg(F.ceil(F.count("*") / block).cast("int").alias("blocks"))
    v = vectors.select("vault", "page_id", "embedding").join(counts, "vault")
    v = v.withColumn("own", F.pmod(F.xxhash64("page_id"), F.col("blocks")).cast("int"))
    sides = F.transform(F.sequence(F.lit(0), F.col("blocks") - 1), lambda o: F.struct(F.least("own", o).alias("i"), F.greatest("own", o).alias("j")))
    dealt = v.withColumn("p", F.explode(sides)).select("vault", "p.i", "p.j", "own", "page_id", "embedding")
    found = pa.schema([("vault", pa.string()), ("src", pa.string()), ("page_id", pa.string()), ("score", pa.float64())])

    def run(key, table):
        vault, i, j = (k.as_py() for k in key)
        table = table.sort_by("page_id").combine_chunks()
        own, m = table.column("own").to_numpy(), _matrix(pa.concat_arrays(table.column("embedding").chunks))
        coded = table.column("page_id").combine_chunks().dictionary_encode()
        of, names = coded.indices.to_numpy(), coded.dictionary
        sets = []
        for side in (i, j):
            at = np.flatnonzero(own == side)
            starts = np.flatnonzero(np.diff(of[at], prepend=-1)) if len(at) else at
            sets.append((m[at], starts, of[at][starts]))
        (x, sx, px), (y, sy, py) = sets
        if not len(x) or not len(y):
            return found.empty_table()
        pages = np.maximum.reduceat(np.maximum.reduceat(x @ y.T, sx, axis=0), sy, axis=1)
        if i == j:
            np.fill_diagonal(pages, -1.0)
        parts = [(px, py, pages)] if i == j else [(px, py, pages), (py, px, pages.T)]
        src, other, score = [], [], []
        for a, b, p in parts:
            r, c = _first(p, limit)
            src.append(a[r])
            other.append(b[c])
            score.append(p[r, c])
        src, other, score = (np.concatenate(z) for z in (src, other, score))
        return pa.table([pa.array([vault] * len(src), pa.string()), names.take(pa.array(src)), names.take(pa.array(other)), pa.array(score)], schema=found)

    scores = dealt.groupBy("vault", "i", "j").applyInArrow(run, "vault string, src string, page_id string, score double")
    return _best(scores, ["vault", "src"], limit)


def hashing_embedder(texts: list[str], size: int = 384) -> np.ndarray:
    """Vectors of unit length from hashed words: no model, but texts that share words are near. For tests and where no model is at hand."""
    out = np.zeros((len(texts), size))
    for i, text in enumerate(texts):
        words = re.findall(r"\w+", text.lower())
        if words:
            h = pd.util.hash_array(np.array(words, dtype=object))
            np.add.at(out[i], (h % size).astype(np.int64), np.where(h >> np.uint64(63), 1.0, -1.0))
    length = np.linalg.norm(out, axis=1, keepdims=True)
    return out / np.where(length > 0, length, 1)


def embed_chunks(chunks: DataFrame, embedder=hashing_embedder, batch: int = 256) -> DataFrame:
    """(vault, page_id, chunk_no, hash, embedding) of chunks (vault, page_id, chunk_no, text, hash). ``embedder`` takes a list of texts and gives a
    row for each; it is called in tasks with at most ``batch`` texts, and its rows are brought to unit length."""

    def run(batches):
        for part in batches:
            for start in range(0, len(part), batch):
                some = part.slice(start, batch)
                m = np.asarray(embedder(some.column("text").to_pylist()), np.float64).reshape(len(some), -1)
                length = np.linalg.norm(m, axis=1, keepdims=True)
                m = (m / np.where(length > 0, length, 1)).astype(np.float32)
                column = pa.ListArray.from_arrays(pa.array(np.arange(len(m) + 1, dtype=np.int32) * m.shape[1], pa.int32()), pa.array(m.ravel()))
                yield pa.RecordBatch.from_arrays([*(some.column(c) for c in ("vault", "page_id", "chunk_no", "hash")), column], names=["vault", "page_id", "chunk_no", "hash", "embedding"])

    c = chunks.select("vault", "page_id", F.col("chunk_no").cast("int").alias("chunk_no"), "hash", "text")
    return c.mapInArrow(run, "vault string, page_id string, chunk_no int, hash string, embedding array<float>")


def stale_vectors(pages: DataFrame, stored: DataFrame) -> DataFrame:
    """(vault, page_id, action): delete what is no page any more, embed what is new or has another hash."""
    have = stored.select("vault", "page_id", "hash").distinct()
    live = pages.select("vault", "page_id", "hash")
    gone = have.join(live, ["vault", "page_id"], "left_anti").select("vault", "page_id", F.lit("delete").alias("action"))
    return gone.unionByName(live.join(have, ["vault", "page_id", "hash"], "left_anti").select("vault", "page_id", F.lit("embed").alias("action")))
