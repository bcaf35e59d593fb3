"""Hard negatives by exact search in cover trees over norm-augmented vectors.

A row's vector x gets one more component, sqrt(M^2 - |x|^2) with M the greatest norm of its tree, and an anchor's gets a zero. All rows then
have length M, and the nearer a row, the higher its inner product. A tree covers its rows level by level: the centres of a level are taken
greedily at half the radius of the level above, every row belongs to a centre within that radius, and where FAN centres don't cover
a node the rest go to the nearest of them; each node keeps the radius that really covers its rows. Distance of the anchor to a centre and the radius
bound the inner products of all rows below from both sides. A best-first descent takes the node with the highest
bound next, leaves out nodes that lie outside the window of scores or hold no label that is asked for, stops once nothing left can come before the
last row it has, and verifies the rows of leaves by exact integer products.

Rows are dealt by ranges of label into trees of at most ``ROWS`` rows, each built by one task and written. Anchors go to the trees
that have their label (for positives), then with the windows found to all trees (for negatives); trees and anchors of a block of at most about
``ANCHORS`` meet by tree and block, sorted so that a task holds one tree while the anchors stream by. Of a tree only the
first few rows for each anchor leave the task.

Defined cases: a row without an id takes no part, as one with a null label, a null vector or any null or non-finite component; a shorter vector counts
as zero in the components that it lacks; components beyond 32 bits after scaling, and products beyond 62 bits, raise; equal scores are ordered by the smaller id; repeated rows are
rows of their own (another row of an anchor's id may be its positive); an anchor without positives, or a positive without rows
in its window, gives no rows; an empty table gives no rows; other columns are not read, whatever their names.
"""

from __future__ import annotations

import heapq
import io
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .common import discard, materialize

#: Rows of a tree, of a leaf, children of a node, anchors that meet a tree in one task.
ROWS, LEAF, FAN, ANCHORS = 65_536, 1024, 16, 50_000
SCALE = 256


def usable(rows: DataFrame, label: Column) -> DataFrame:
    """(uid, id, label, q) of the rows that take part."""
    odd = F.exists("embedding", lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))
    q = F.transform("embedding", lambda x: F.floor(x.cast("double") * SCALE).cast("int"))
    kept = rows.filter(F.col("vec_id").isNotNull() & F.col("label").isNotNull() & F.col("embedding").isNotNull()).filter(~odd)
    return kept.select(F.monotonically_increasing_id().alias("uid"), F.col("vec_id").cast("long").alias("id"), label.cast("long").alias("label"), q.alias("q"))


def matrix(column: pa.Array) -> np.ndarray:
    """Rows of whole numbers, shorter ones filled with zeros."""
    lengths = np.diff(column.offsets.to_numpy())
    flat = column.flatten().to_numpy(zero_copy_only=False)
    width = int(lengths.max(initial=0))
    out = np.zeros((len(column), width), np.int64)
    out[np.arange(width)[None, :] < lengths[:, None]] = flat
    return out


def norms(x: np.ndarray) -> np.ndarray:
    return np.sqrt(np.einsum("ij,ij->i", x.astype(np.float64), x.astype(np.float64)))


class Tree:
    """A cover tree over rows (ids, labels, uids, q). Rows of a node are neighbours, children of a node follow each other."""

    ARRAYS = ("q", "ids", "labels", "uids", "start", "end", "center", "radius", "child", "children", "least", "low", "high", "level")

    def __init__(self, q: np.ndarray, ids: np.ndarray, labels: np.ndarray, uids: np.ndarray):
        n = norms(q)
        self.top = float(n.max(initial=0.0))
        x = np.column_stack([q.astype(np.float64), np.sqrt(np.maximum(self.top**2 - n**2, 0))])
        order = np.lexsort((uids, ids))
        nodes, at = [[order, order[0], self._far(x, order, order[0]), 0]], 0
        first, count, leaves = [], [], []
        while at < len(nodes):
            idx, center, radius, level = nodes[at]
            parts = self._cover(x, idx, center, radius) if len(idx) > LEAF and radius > 0 else []
            first.append(len(nodes) if parts else 0)
            count.append(len(parts))
            nodes += [[part, c, self._far(x, part, c), level + 1] for c, part in parts]
            at += 1
        # Rows in the order of a walk from the root, so that each node has one range of them.
        start, end, stack = np.zeros(len(nodes), np.int64), np.zeros(len(nodes), np.int64), [0]
        filled = 0
        while stack:
            k = stack.pop()
            start[k], end[k] = filled, filled + len(nodes[k][0])
            if count[k]:
                stack += range(first[k], first[k] + count[k])
            else:
                leaves.append(nodes[k][0])
                filled += len(nodes[k][0])
        walk = np.concatenate(leaves)
        place = np.empty(len(walk), np.int64)
        place[walk] = np.arange(len(walk))
        least = np.iinfo(np.int16)
        narrow = q.size == 0 or (q.min() >= least.min and q.max() <= least.max)
        self.q, self.ids, self.labels, self.uids = q[walk].astype(np.int16 if narrow else np.int32), ids[walk], labels[walk], uids[walk]
        self.start, self.end, self.center = start, end, place[np.array([x[1] for x in nodes])]
        self.radius, self.level = np.array([x[2] for x in nodes]), np.array([x[3] for x in nodes])
        self.child, self.children = np.array(first), np.array(count)
        self.least, self.low, self.high = (np.array([f(v[a:b]) for a, b in zip(start, end, strict=True)]) for f, v in ((np.min, self.ids), (np.min, self.labels), (np.max, self.labels)))

    @staticmethod
    def _far(x: np.ndarray, idx: np.ndarray, c: int) -> float:
        return float(np.sqrt(np.square(x[idx] - x[c]).sum(axis=1).max()))

    @staticmethod
    def _cover(x: np.ndarray, idx: np.ndarray, center: int, radius: float) -> list[tuple[int, np.ndarray]]:
        """(centre, its rows): centres farther from each other than half the radius; none if that divides nothing."""
        points = x[idx]
        near, of, left = np.full(len(idx), np.inf), np.zeros(len(idx), np.int64), np.ones(len(idx), bool)
        centers = []
        c = int(np.flatnonzero(idx == center)[0])
        while True:
            d = np.square(points - points[c]).sum(axis=1)
            better = d < near
            near[better], of[better] = d[better], len(centers)
            centers.append(c)
            left &= d > (radius / 2) ** 2
            if len(centers) == FAN or not left.any():
                break
            c = int(np.argmax(np.where(left, near, -1.0)))  # the farthest, so that few centres do
        parts = [(int(idx[c]), idx[of == k]) for k, c in enumerate(centers)]
        return parts if max(len(p) for _, p in parts) < 0.95 * len(idx) else []

    def dumps(self) -> bytes:
        out = io.BytesIO()
        np.savez(out, top=np.array(self.top), **{k: getattr(self, k) for k in self.ARRAYS})
        return out.getvalue()

    @classmethod
    def loads(cls, data: bytes) -> Tree:
        out, files = cls.__new__(cls), np.load(io.BytesIO(data))
        out.top = float(files["top"])
        for k in cls.ARRAYS:
            setattr(out, k, files[k])
        return out

    def ready(self, most: float) -> None:
        """Choose numbers in which products with vectors of norm ``most`` are exact."""
        size = self.top * most
        if size >= 2**62:
            raise OverflowError("a product may not fit a long")
        self.kind = np.float32 if size < 2**23 else np.float64 if size < 2**52 else np.int64
        self.rows = self.q.astype(self.kind)
        self.centers = self.rows[self.center]

    def bounds(self, anchors: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Highest and lowest possible product of each anchor with the rows of each node, as whole numbers."""
        product = (anchors.astype(self.kind) @ self.centers.T).astype(np.float64)
        total = (norms(anchors) ** 2)[:, None] + self.top**2
        d = np.sqrt(np.maximum(total - 2 * product, 0))
        slack = 1e-6 * total + 1e-3
        upper = (total - np.square(np.maximum(d - self.radius, 0))) / 2
        lower = (total - np.square(d + self.radius)) / 2
        return np.floor(upper + slack), np.ceil(lower - slack)

    def search(self, anchor: np.ndarray, upper: np.ndarray, lower: np.ndarray, k: int, window: tuple[float, float], seen: dict, label: int, same: bool, uid: int, least_score: int = -(1 << 62)) -> list[tuple[int, int]]:
        """The first k of (-score, id) within the window, of rows that have the label (``same``) or another one. ``seen`` keeps the
        sorted scores of leaves for the anchor's next window, down to ``least_score``."""
        lo, hi = window
        best: list[tuple[int, int]] = []
        heap = [(-min(upper[0], hi), int(self.least[0]), 0)]
        while heap:
            bound, least, node = heapq.heappop(heap)
            if len(best) == k and (bound, least) >= best[-1]:
                break
            if upper[node] < lo or lower[node] > hi or (not self.low[node] <= label <= self.high[node] if same else self.low[node] == label == self.high[node]):
                continue
            if self.children[node]:
                a = self.child[node]
                for c in range(a, a + self.children[node]):
                    heapq.heappush(heap, (-min(upper[c], hi), int(self.least[c]), c))
                continue
            if node not in seen:  # rows of a leaf stand by id, so a stable sort keeps that order among equal scores
                a, b = self.start[node], self.end[node]
                at = np.flatnonzero(((self.labels[a:b] == label) == same) & (self.uids[a:b] != uid)) + a
                scores = -(self.rows[at] @ anchor).astype(np.int64)
                at, scores = at[scores <= -least_score], scores[scores <= -least_score]
                order = np.argsort(scores, kind="stable")
                seen[node] = scores[order], self.ids[at[order]]
            scores, ids = seen[node]
            i = int(np.searchsorted(scores, -hi))
            more = [x for x in zip(scores[i : i + k].tolist(), ids[i : i + k].tolist(), strict=True) if x[0] <= -lo]
            if more:
                best = sorted([*best, *more])[:k]
        return best


def plant(rows: DataFrame, at_once: int = ROWS) -> tuple[DataFrame, DataFrame]:
    """Trees (shard, labels, tree) over (uid, id, label, q), shards numbered from 0, and the table in which they are written."""
    n, cores = rows.count(), rows.sparkSession.sparkContext.defaultParallelism
    parts = max(1, -(-n // at_once), min(cores, n // 2000))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, size, made = [], 0, 0

        def grown() -> pa.RecordBatch:
            nonlocal made
            table = pa.Table.from_batches(held).combine_chunks()
            ids, labels, uids = (table[c].to_numpy() for c in ("id", "label", "uid"))
            made += 1
            shard = (TaskContext.get().partitionId() << 32) + made
            tree = Tree(matrix(table["q"].combine_chunks()), ids, labels, uids).dumps()
            return pa.RecordBatch.from_arrays([pa.array([shard], pa.int64()), pa.array([np.unique(labels).tolist()], pa.list_(pa.int64())), pa.array([tree], pa.binary())], names=["shard", "labels", "tree"])

        for batch in batches:
            while len(batch):
                take = batch.slice(0, at_once - size)
                held.append(take)
                size += len(take)
                batch = batch.slice(len(take))
                if size == at_once:
                    yield grown()
                    held, size = [], 0
        if size:
            yield grown()

    dealt = rows.repartitionByRange(parts, "label", F.xxhash64("uid")).sortWithinPartitions("label")
    grown = materialize(dealt.mapInArrow(run, "shard long, labels array<long>, tree binary"))
    shards = sorted(r[0] for r in grown.select("shard").collect())  # a number a tree
    numbers = rows.sparkSession.createDataFrame(list(zip(shards, range(len(shards)), strict=True)), "shard long, k int")
    return grown.join(F.broadcast(numbers), "shard").select(F.col("k").alias("shard"), "labels", "tree"), grown


def meet(trees: DataFrame, anchors: DataFrame, blocks: int, k: int, same: bool) -> DataFrame:
    """(uid, anchor_id, top, id, score): for each row (shard, block, uid, id, label, q, tops) of anchors the first k rows of its shard's tree
    within the window below each of tops, which is a pair of lowest and highest score."""
    whole = trees.select("shard", F.explode(F.sequence(F.lit(0), F.lit(blocks - 1))).alias("block"), F.lit(0).alias("kind"), "tree")
    both = whole.unionByName(anchors.withColumn("kind", F.lit(1)), allowMissingColumns=True)
    parts = max(1, min(10_000, trees.count() * blocks))
    sorted_rows = both.repartition(parts, "shard", "block").sortWithinPartitions("shard", "block", "kind")

    def found(tree: Tree, batch: pa.RecordBatch) -> Iterator[tuple]:
        q = matrix(batch.column("q"))
        width = max(q.shape[1], tree.q.shape[1])
        if q.shape[1] < width:
            q = np.pad(q, ((0, 0), (0, width - q.shape[1])))
        if tree.q.shape[1] < width:
            tree.q = np.pad(tree.q, ((0, 0), (0, width - tree.q.shape[1])))
        tree.ready(float(norms(q).max(initial=0.0)))
        uids, ids, labels, tops = (batch.column(c).to_pylist() for c in ("uid", "id", "label", "tops"))
        for a in range(0, len(q), 256):
            upper, lower = tree.bounds(q[a : a + 256])
            for i in range(a, min(a + 256, len(q))):
                seen, anchor, least = {}, q[i].astype(tree.kind), min(x["lo"] for x in tops[i])
                for lo, hi in ((x["lo"], x["hi"]) for x in tops[i]):
                    for score, row in tree.search(anchor, upper[i - a], lower[i - a], k, (lo, hi), seen, labels[i], same, uids[i], least):
                        yield uids[i], ids[i], hi, row, -score

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tree = None
        for batch in batches:
            kinds = batch.column("kind").to_numpy()
            edges = [0, *(np.flatnonzero(kinds == 0)).tolist(), len(kinds)]
            out = []
            for a, b in zip(edges[:-1], edges[1:], strict=True):
                if a < b and kinds[a] == 0:
                    tree = Tree.loads(batch.column("tree")[a].as_py())
                    a += 1
                if a < b:
                    out += found(tree, batch.slice(a, b - a))
            yield pa.RecordBatch.from_arrays([pa.array([x[i] for x in out], pa.int64()) for i in range(5)], names=["uid", "anchor_id", "top", "id", "score"])

    return sorted_rows.mapInArrow(run, "uid long, anchor_id long, top long, id long, score long")


def first(rows: DataFrame, by: list[str], k: int) -> DataFrame:
    """The first k rows of each group with their rank."""
    order = Window.partitionBy(*by).orderBy(F.desc("score"), "id")
    return rows.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= k)


EVERY = 1 << 62


def mine(rows: DataFrame, is_anchor: Column, label: Column, positives: int = 5, negatives: int = 5, low: int = 80, at_once: int = ROWS) -> DataFrame:
    """(anchor_id, positive_id, rank, negative_id, positive_score, negative_score). Anchors are the rows for which ``is_anchor`` (over id)
    holds; a negative of another label has ``low`` to 100 hundredths of the positive's score."""
    part = materialize(usable(rows, label))
    trees, grown = plant(part, at_once)
    anchors = part.filter(is_anchor)
    blocks = max(1, -(-anchors.count() // ANCHORS))
    anchors = anchors.withColumn("block", F.pmod(F.xxhash64("uid", F.lit("block")), F.lit(blocks)).cast("int"))
    every = F.array(F.struct(F.lit(-EVERY).alias("lo"), F.lit(EVERY).alias("hi")))
    # Positives: the trees that have the anchor's label.
    homes = trees.select("shard", F.explode("labels").alias("label"))
    near = meet(trees, anchors.join(homes, "label").withColumn("tops", every), blocks, positives, True)
    pos = materialize(first(near, ["uid"], positives).select("uid", "anchor_id", F.col("id").alias("positive_id"), F.col("score").alias("positive_score")))
    # Negatives: all trees, with the windows below the positives. A score below zero has an empty one.
    score = F.col("positive_score")
    least = F.ceil(score * low / F.lit(100).cast("decimal(3,0)")).cast("long")
    tops = pos.filter(score >= 0).groupBy("uid").agg(F.collect_set(F.struct(least.alias("lo"), score.alias("hi"))).alias("tops"))
    asked = anchors.join(tops, "uid").withColumn("shard", F.explode(F.sequence(F.lit(0), F.lit(trees.count() - 1))))
    neg = materialize(first(meet(trees, asked, blocks, negatives, False), ["uid", "top"], negatives))
    discard(part, grown)
    return pos.join(neg.select("uid", F.col("top").alias("positive_score"), "rank", F.col("id").alias("negative_id"), F.col("score").alias("negative_score")), ["uid", "positive_score"]).select("anchor_id", "positive_id", "rank", "negative_id", "positive_score", "negative_score")


def mine_embeddings(embeddings: DataFrame) -> DataFrame:
    """Anchors are rows whose vec_id is divisible by 100; of every seventh row the label is moved on by one first."""
    moved = F.when(F.col("vec_id") % 7 == 0, (F.col("label") + 1) % 10).otherwise(F.col("label"))
    return mine(embeddings, F.col("id") % 100 == 0, moved)


ORACLE = """
with r as (select row_number() over () as uid, vec_id, (case when vec_id % 7 = 0 then (label + 1) % 10 else label end)::bigint as label, list_transform(embedding, lambda x: floor(256 * x::double)::bigint) as q
  from embeddings where vec_id is not null and label is not null and embedding is not null and len(list_filter(embedding, lambda x: x is null or not isfinite(x))) = 0),
a as (select * from r where vec_id % 100 = 0),
s as (select a.uid, a.vec_id as anchor_id, a.label = r.label as same, r.uid as row_uid, r.vec_id, list_inner_product(a.q::double[], r.q::double[])::bigint as score from a, r),
p as (select * from (select *, row_number() over (partition by uid order by score desc, vec_id) as k from s where same and row_uid <> uid) where k <= 5),
n as (select p.uid, p.anchor_id, p.row_uid, p.vec_id as positive_id, p.score as positive_score, s.vec_id as negative_id, s.score as negative_score,
  row_number() over (partition by p.uid, p.row_uid order by s.score desc, s.vec_id) as rank
  from p join s on p.uid = s.uid and not s.same and 80 * p.score <= 100 * s.score and s.score <= p.score)
select anchor_id, positive_id, rank::int as rank, negative_id, positive_score, negative_score from n where rank <= 5
"""
