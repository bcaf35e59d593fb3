"""Mixing sources to target weights by capped water-filling.

Each source gets words in proportion to its weight, but at most ``max_epochs`` times its
own size; what a capped source can't take is dealt to the others by weight until none is
above its cap. The levels have a closed form: with sources in ascending cap / weight, the
capped ones are a prefix, and the rest share what is left by weight.

A source's target over its size is a number of whole repetitions and a fraction. All its
documents are repeated the whole number of times; for the fraction, documents in the order
of a seeded hash (of doc_id, or of the text where that is null) are taken once more until their words reach it, to within half a document.

Defined cases: a null source is a source of its own and comes last; a null or empty text has
no words and is never taken; a source without words has target 0; an empty table gives no
rows; equal rows are told apart by their order only; a text of any length counts with all its words; other columns, whatever their names, are
carried by ``sample`` as they are, while ``mix`` replaces those that have the names of its own.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .common import TOKEN, temp_name

#: Hash prefixes that split a source's running sum: 16 ** 3 parts, so that no task holds a source.
PREFIX = 3


def targets(sizes: DataFrame, max_epochs: int = 3, weights: tuple[int, ...] = (1, 2, 3)) -> DataFrame:
    """(source, source_size, target) from one row (source, source_size) for each source."""
    by_name = Window.orderBy(F.col("source").asc_nulls_last())
    place = F.row_number().over(by_name) - 1
    weight = F.element_at(F.array(*[F.lit(float(w)) for w in weights]), (place % len(weights) + 1).cast("int"))
    every = Window.partitionBy()
    order = Window.orderBy("ratio", "place")
    before = order.rowsBetween(Window.unboundedPreceding, -1)
    s = sizes.withColumn("place", place).withColumn("weight", weight)
    s = s.withColumn("cap", (F.col("source_size") * max_epochs).cast("double")).withColumn("ratio", F.col("cap") / F.col("weight"))
    left = F.sum("source_size").over(every) - F.coalesce(F.sum("cap").over(before), F.lit(0.0))
    open_weight = F.sum("weight").over(every) - F.coalesce(F.sum("weight").over(before), F.lit(0.0))
    s = s.withColumn("level", left / open_weight)
    s = s.withColumn("final", F.min(F.when(F.col("level") <= F.col("ratio"), F.struct("ratio", "place", "level"))).over(every)["level"])
    target = F.least("cap", F.col("weight") * F.coalesce(F.col("final"), F.lit(0.0)))
    return s.select("source", "source_size", F.round(target, 6).alias("target"))


def mixed(docs: DataFrame, name: str, seed: str = "mix-1", max_epochs: int = 3, weights: tuple[int, ...] = (1, 2, 3)) -> DataFrame:
    """docs with one more column, a struct of size, source_size, target, copies and taken."""
    h, key, part, start, run, size, total, goal = (temp_name(docs, x) for x in ("hash", "key", "part", "start", "run", "size", "total", "goal"))
    words = F.regexp_count(F.coalesce(F.col("text"), F.lit("")), F.lit(TOKEN)).cast("long")
    sized = docs.withColumn(size, words).withColumn(h, F.md5(F.concat(F.lit(f"{seed}:"), F.coalesce(F.col("doc_id").cast("string"), F.md5("text"), F.lit("")))))
    sized = sized.withColumn(part, F.substring(h, 1, PREFIX)).withColumn(key, F.coalesce(F.concat(F.lit("s"), "source"), F.lit("")))
    # One row for each source and hash prefix: what the prefixes before hold.
    parts = sized.groupBy(key, part).agg(F.sum(size).alias("part_size"))
    sums = parts.groupBy(key).agg(F.sum("part_size").alias("source_size"))
    named = sums.withColumn("source", F.when(F.col(key) != "", F.expr(f"substring({key}, 2)")))
    goals = targets(named, max_epochs, weights).select(F.coalesce(F.concat(F.lit("s"), "source"), F.lit("")).alias(key), F.col("source_size").alias(total), F.col("target").alias(goal))
    in_order = Window.partitionBy(key).orderBy(part)
    starts = parts.select(key, part, (F.sum("part_size").over(in_order) - F.col("part_size")).alias(start)).join(goals, key)
    # Rows of one doc_id and size may differ in their text, so its hash decides between them on every run.
    own = Window.partitionBy(key, part).orderBy(h, "doc_id", size, F.xxhash64("text")).rowsBetween(Window.unboundedPreceding, 0)
    out = sized.withColumn(run, F.sum(size).over(own)).join(starts, [key, part])
    whole = F.when(F.col(total) > 0, F.floor(F.col(goal) / F.col(total))).otherwise(0)
    part_words = F.col(goal) - whole * F.col(total)
    more = (F.col(size) > 0) & (F.col(start) + F.col(run) - F.col(size) / 2 <= part_words)
    copies = F.when(F.col(size) > 0, whole + more.cast("int")).otherwise(0).cast("int")
    taken = (F.col(size) * copies).cast("long")
    out = out.withColumn(name, F.struct(F.col(size).alias("size"), F.col(total).alias("source_size"), F.col(goal).alias("target"), copies.alias("copies"), taken.alias("taken")))
    return out.drop(h, key, part, start, run, size, total, goal)


def mix(docs: DataFrame, seed: str = "mix-1", max_epochs: int = 3, weights: tuple[int, ...] = (1, 2, 3)) -> DataFrame:
    """docs with ``size``, ``source_size``, ``target``, ``copies`` and ``taken``; columns of the caller that have these names give way."""
    names = ("size", "source_size", "target", "copies", "taken")
    name = temp_name(docs, "mixed")
    return mixed(docs.drop(*names), name, seed, max_epochs, weights).withColumns({n: F.col(name)[n] for n in names}).drop(name)


def times(rows: DataFrame, copies: Column) -> DataFrame:
    """Each row as often as ``copies`` says."""
    copy = temp_name(rows, "copy")
    return rows.filter(copies > 0).withColumn(copy, F.explode(F.array_repeat(F.lit(0), copies))).drop(copy)


def repeat(rows: DataFrame) -> DataFrame:
    """Each row of what ``mix`` returns as often as its ``copies`` says."""
    return times(rows, F.col("copies"))


def sample(docs: DataFrame, seed: str = "mix-1", max_epochs: int = 3, weights: tuple[int, ...] = (1, 2, 3)) -> DataFrame:
    """The rows of docs as often as the mix takes them, with their own columns."""
    name = temp_name(docs, "mixed")
    return times(mixed(docs, name, seed, max_epochs, weights), F.col(name)["copies"]).select(*docs.columns)


def mix_documents(docs: DataFrame) -> DataFrame:
    return mix(docs.select("doc_id", "text", "source")).select("doc_id", "size", "source_size", "target", "taken")


ORACLE = f"""
with d as (select doc_id, source, len(regexp_extract_all(coalesce(text, ''), '{TOKEN}'))::bigint as size,
                  md5('mix-1:' || coalesce(doc_id::varchar, md5(text), '')) as h from documents),
s as (select source, sum(size)::bigint as source_size from d group by source),
w as (select *, row_number() over (order by source asc nulls last) - 1 as place from s),
c as (select *, (place % 3 + 1)::double as weight, (source_size * 3)::double as cap,
             (source_size * 3)::double / (place % 3 + 1)::double as ratio from w),
l as (select *, ((sum(source_size) over ())::double - coalesce(sum(cap) over (order by ratio, place rows between unbounded preceding and 1 preceding), 0.0))
             / (sum(weight) over () - coalesce(sum(weight) over (order by ratio, place rows between unbounded preceding and 1 preceding), 0.0)) as level from c),
f as (select level from l where level <= ratio order by ratio, place limit 1),
t as (select source, source_size, round(least(cap, weight * coalesce((select level from f), 0.0)), 6) as target from l),
r as (select d.doc_id, d.size, t.source_size, t.target,
             case when t.source_size > 0 then floor(t.target / t.source_size) else 0 end as whole,
             sum(d.size) over (partition by d.source order by d.h, d.doc_id, d.size rows between unbounded preceding and current row) as run
      from d join t on d.source is not distinct from t.source)
select doc_id, size, source_size, target,
       (case when size > 0 then size * (whole + case when run - size / 2.0 <= target - whole * source_size then 1 else 0 end) else 0 end)::bigint as taken
from r
"""
