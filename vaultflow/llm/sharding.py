"""Sharding by a Feistel permutation of global row numbers.

Rows are numbered 0..n-1 in ascending ``doc_id`` (nulls first; ties by size, then
checksum of the text). A keyed Feistel network with modular halves permutes the
numbers; where the network's domain is a little larger than n, results of n or more
are permuted again (cycle walking) until they fall inside. Row number p goes to shard
``p % shards`` at slot ``p // shards``: shard and slot of any row can be computed, the
counts of the shards differ by one at most and slots have no gaps.

Defined cases: a null text has no bytes; an empty table gives no rows; repeated rows
get numbers of their own, and rows tied in all of these stand in any order, which changes nothing that is
returned; a text of any length is read once for its size and checksum; other columns of the input are carried, never read, but for
columns named shard and slot, which give way.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .common import materialize, temp_name

ROUNDS = 6
#: Steps of cycle walking. The domain has less than sqrt(n) + 1 surplus numbers, all distinct
#: on a cycle, so a walk needs at most that many steps; beyond 64 steps the chance that any row
#: is still outside is below n * (1 / sqrt(n)) ** 64; it would raise.
WALKS = 64


def domain(n: int) -> tuple[int, int]:
    """Sizes of the two halves: the smallest near-square product that holds n."""
    a = max(1, math.isqrt(max(n - 1, 0)) + 1)
    return a, max(1, -(-n // a))


def permute(number: Column, n: int, seed: int) -> Column:
    """The place of row ``number`` (0..n-1) in the shuffled order, also 0..n-1."""
    a, b = domain(n)
    rounds = F.array(*[F.lit(i) for i in range(ROUNDS)])

    def network(x: Column) -> Column:
        # State (left, right); left counts modulo a before even rounds and b before odd ones.
        start = F.struct(F.floor(x / F.lit(b)).cast("long").alias("l"), F.pmod(x, F.lit(b)).cast("long").alias("r"))

        def one(s: Column, i: Column) -> Column:
            size = F.when(i % 2 == 0, F.lit(a)).otherwise(F.lit(b)).cast("long")
            digest = F.md5(F.concat_ws(":", F.lit(str(seed)), i.cast("string"), s["r"].cast("string")))
            f = F.conv(F.substring(digest, 1, 8), 16, 10).cast("long")
            return F.struct(s["r"].alias("l"), F.pmod(s["l"] + f, size).alias("r"))

        return F.aggregate(rounds, start, one, lambda s: s["l"] * F.lit(b) + s["r"])

    surplus = a * b - n
    first = network(number)
    if not surplus:
        return first
    walk = F.array(*[F.lit(0)] * min(surplus, WALKS))
    out = F.aggregate(walk, first, lambda x, _: F.when(x < n, x).otherwise(network(x)))
    return F.when(out < n, out).otherwise(F.raise_error(F.lit(f"a row is outside after {WALKS} steps; choose another seed")).cast("long"))


def number_rows(df: DataFrame, order: list[str], name: str) -> tuple[DataFrame, int]:
    """df with global row numbers in the given order, and the count of rows.

    One range exchange; each part numbers its own rows and adds the count of those before it.
    Only the counts of the parts (one row a partition) meet in one place."""
    part, before = temp_name(df, "part"), temp_name(df, "before")
    cols = [F.col(c).asc_nulls_first() for c in order]
    kept = materialize(df.repartitionByRange(*cols).withColumn(part, F.spark_partition_id()))
    counts = kept.groupBy(part).agg(F.count("*").alias(before)).orderBy(part).collect()  # a row a partition
    offsets, n = [], 0
    for row in counts:
        offsets.append((row[0], n))
        n += row[1]
    starts = df.sparkSession.createDataFrame(offsets, f"{part} int, {before} long")
    local = F.row_number().over(Window.partitionBy(part).orderBy(*cols))
    out = kept.withColumn(name, local - 1).join(F.broadcast(starts), part)
    return out.withColumn(name, F.col(name) + F.col(before)).drop(part, before), n


def shard(df: DataFrame, order: list[str], shards: int, seed: int = 17) -> DataFrame:
    """df with ``shard`` and ``slot``; columns of the caller that have these names give way."""
    if shards < 1:
        raise ValueError("shards must be 1 or more")
    number, place = temp_name(df, "number"), temp_name(df, "place")
    numbered, n = number_rows(df.drop("shard", "slot"), order, number)
    placed = numbered.withColumn(place, permute(F.col(number), n, seed))
    return placed.withColumns({"shard": (F.col(place) % shards).cast("int"), "slot": F.floor(F.col(place) / shards).cast("long")}).drop(number, place)


def shard_documents(docs: DataFrame, shards: int = 24, seed: int = 17) -> DataFrame:
    """(doc_id, size, text_crc32, law, shard, slot, grown_shard) of each document; the law is ``rows``."""
    text = F.coalesce(F.col("text"), F.lit(""))
    narrow = docs.select("doc_id", (F.octet_length(text) + 8).cast("long").alias("size"), F.crc32(text.cast("binary")).alias("text_crc32"))
    out = shard(narrow, ["doc_id", "size", "text_crc32"], shards, seed)
    return out.select("doc_id", "size", "text_crc32", F.lit("rows").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"))


_ROUND = "(select id, x, a, b, n, k, r as l, (l + ('0x' || md5('17:{i}:' || r::varchar)[1:8])::bigint) % {size} as r from {below})"
_NET = "(select id, x, a, b, n, k, (x // b)::bigint as l, (x % b)::bigint as r from w where k = 0 or x >= n)"
for _i in range(ROUNDS):
    _NET = _ROUND.format(i=_i, size="b" if _i % 2 else "a", below=_NET)
ORACLE = f"""
with recursive bit as (select list_transform(range(256), lambda i: list_reduce([i::bigint] || range(8), lambda c, k: case when c % 2 = 1 then xor(c // 2, 3988292384) else c // 2 end)) as table_of),
hexed as (select doc_id, (strlen(coalesce(text, '')) + 8)::bigint as size, hex(encode(coalesce(text, ''))) as x from documents),
d as (select doc_id, size, xor(4294967295, list_reduce([4294967295::bigint] || list_transform(range(0, len(x), 2), lambda i: ('0x' || x[i + 1:i + 2])::bigint),
      lambda c, b: xor(table_of[xor(c, b) % 256 + 1], c // 256))) as text_crc32 from hexed, bit),
q as (select *, row_number() over (order by doc_id nulls first, size, text_crc32) - 1 as id from d),
c as (select count(*)::bigint as n, ceil(sqrt(count(*)))::bigint as a from d),
w as (select id, id as x, a, ((n + a - 1) // a)::bigint as b, n, 0 as k from q, c
      union all select id, (l * b + r)::bigint as x, a, b, n, k + 1 as k from {_NET}),
p as (select id, arg_max(x, k) as place from w group by id)
select doc_id, size, text_crc32, 'rows' as law, (place % 24)::int as shard, (place // 24)::bigint as slot, null::int as grown_shard
from q join p using (id)
"""
