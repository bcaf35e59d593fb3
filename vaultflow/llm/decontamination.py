"""Benchmark decontamination by a hash set of normalised test n-grams.

Words are lower-cased runs of letters and digits. Each benchmark item gives its windows of
``width`` consecutive words (an item of fewer words, but not none, is one window). Every window
has an anchor: the adjacent pair of its words with the most letters, so a pair that is rare in
ordinary text. The windows are a hash set under their anchors. Scanning a document looks for words
that begin an anchor, then for the anchors' hashes, and verifies each window at its place word by
word: every occurrence is found, and a collision of anchors changes nothing. Texts are told apart by their MD5.

The anchors are literals and the set is broadcast up to MAX_WINDOWS windows (the count is checked
first). A larger benchmark takes the other way: the documents' pairs are joined with the
anchors, which Spark shuffles.

Defined cases: null and empty texts have no words and no hits; an item without words has no
windows; items that share windows are all counted; repeated documents are told apart; an empty
benchmark leaves every document clean; texts of any length are scanned whole; other columns, whatever their names, are carried
through ``decontaminate`` and ``remove_spans`` as they are; ``score`` replaces those that have the names of its own.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import WORD, materialize, quoted, temp_name, words

WIDTH = 13
MAX_WINDOWS = 100_000


def item_windows(benchmark: DataFrame, width: int = WIDTH) -> DataFrame:
    """(item_id, length, window, place, first, second): each window of an item once. The anchor
    starts at word ``place`` (from 0); its second word is null in a window of one word."""
    w = benchmark.select("item_id", words(F.col("text")).alias("w")).filter(F.size("w") > 0)
    w = w.withColumn("length", F.least(F.size("w"), F.lit(width)))
    windows = F.transform(F.sequence(F.lit(1), F.size("w") - F.col("length") + 1), lambda i: F.slice("w", i, F.col("length")))
    out = w.select("item_id", "length", F.explode(windows).alias("window")).distinct()
    # Pairs with the most letters first, then the first in order, so that equal windows agree.
    pair = F.expr("array_min(transform(sequence(1, greatest(1, length - 1)), i -> struct(-length(window[i - 1]) - coalesce(length(get(window, i)), 0) as short, i - 1 as place)))")
    out = out.withColumn("place", pair["place"])
    return out.select("item_id", "length", F.array_join("window", " ").alias("window"), "place", F.expr("window[place]").alias("first"), F.expr("if(length > 1, window[place + 1], null)").alias("second"))


def hits(docs: DataFrame, key: str, benchmark: DataFrame, width: int = WIDTH, max_windows: int = MAX_WINDOWS) -> DataFrame:
    """(key, start, length, item_id): verified windows of docs, starts counted from 0."""
    items = materialize(item_windows(benchmark, width))
    n = items.count()
    text = docs.select(key, words(F.col("text")).alias("w"))
    around = f"struct(i as at, w[i - 1] as first, get(w, i) as second, slice(w, greatest(1, i - {width}), {2 * width}) as near)"
    if n <= max_windows:
        firsts = sorted(r[0] for r in items.select("first").distinct().collect())
        pairs = sorted(r[0] for r in items.select(F.concat_ws(" ", "first", "second")).distinct().collect())
        starts = f"filter(sequence(1, size(w)), i -> w[i - 1] in ({quoted(firsts)}) and (concat_ws(' ', w[i - 1], get(w, i)) in ({quoted(pairs)}) or w[i - 1] in ({quoted(p for p in pairs if ' ' not in p)})))"
        at = text.filter(F.size("w") > 0).withColumn("at", F.expr(starts))
        near = at.select(key, F.explode(F.expr(f"transform(at, i -> {around})")).alias("x")).select(key, "x.*")
    else:
        every = text.filter(F.size("w") > 0).select(key, F.explode(F.expr("transform(sequence(1, size(w)), i -> struct(i as at, w[i - 1] as first, get(w, i) as second))")).alias("x")).select(key, "x.*")
        one, two = items.filter("second is null").select("first").distinct(), items.select("first", "second").distinct()
        found = every.join(two, ["first", "second"], "left_semi").unionByName(every.join(one, "first", "left_semi").select("first", "second", key, "at"))
        places = found.groupBy(key).agg(F.collect_set("at").alias("at"))
        near = places.join(text, key).select(key, F.explode(F.expr(f"transform(at, i -> {around})")).alias("x")).select(key, "x.*")
    # A window of two words or more is found by its anchor pair, one of a single word by that word.
    keys = near.withColumn("anchor", F.explode(F.array_distinct(F.array(F.concat_ws(" ", "first", "second"), F.col("first")))))
    anchors = items.withColumn("anchor", F.concat_ws(" ", "first", "second")).drop("first", "second")
    both = keys.drop("first", "second").join(F.broadcast(anchors) if n <= max_windows else anchors, "anchor")
    # The window's start, from 0, in the document and among the words near the anchor.
    both = both.withColumn("start", F.col("at") - 1 - F.col("place")).filter("start >= 0")
    inside = F.expr(f"array_join(slice(near, start - greatest(1, at - {width}) + 2, length), ' ') = window")
    return both.filter(inside).select(key, "start", "length", "item_id").distinct()


def covered(spans: Column) -> Column:
    """Words under any of the (start, length) spans."""
    zero = F.struct(F.lit(0).alias("to"), F.lit(0).cast("long").alias("n"))

    def add(s: Column, x: Column) -> Column:
        end = x["start"] + x["length"]
        return F.struct(F.greatest(s["to"], end).alias("to"), (s["n"] + F.greatest(F.lit(0), end - F.greatest(s["to"], x["start"]))).cast("long").alias("n"))

    return F.aggregate(F.array_sort(spans), zero, add, lambda s: s["n"])


def judged(docs: DataFrame, benchmark: DataFrame, name: str, width: int = WIDTH, max_windows: int = MAX_WINDOWS) -> DataFrame:
    """docs with one more column, a struct of n_words, n_hit, n_items, items, contaminated and hit_spans."""
    key, items, spans = (temp_name(docs, x) for x in ("text_hash", "item_list", "span_list"))
    # Equal texts have equal hits: what is found is keyed by the text's 128-bit hash (null for a null text, which has none).
    docs = docs.withColumn(key, F.md5("text"))
    found = hits(docs.select(key, "text"), key, benchmark, width, max_windows)
    by_text = found.groupBy(key).agg(F.collect_set(F.struct("start", "length")).alias(spans), F.collect_set(F.col("item_id").cast("string")).alias(items))
    out = docs.join(by_text, key, "left")
    n_words = F.regexp_count(F.coalesce(F.col("text"), F.lit("")), F.lit(WORD_ANY_CASE)).cast("long")
    out = out.withColumn(spans, F.coalesce(spans, F.array().cast("array<struct<start:int,length:int>>")))
    out = out.withColumn(items, F.array_sort(F.coalesce(F.col(items), F.array().cast("array<string>"))))
    kept = F.struct(n_words.alias("n_words"), covered(F.col(spans)).alias("n_hit"), F.size(items).cast("long").alias("n_items"), F.col(items).alias("items"), F.col(spans).alias("hit_spans"))
    out = out.withColumn(name, kept).drop(key, items, spans)
    rule = (F.col(name)["n_hit"] > 0) & (20 * F.col(name)["n_hit"] >= F.col(name)["n_words"])
    return out.withColumn(name, F.col(name).withField("contaminated", rule))


def score(docs: DataFrame, benchmark: DataFrame, width: int = WIDTH, max_windows: int = MAX_WINDOWS) -> DataFrame:
    """docs with n_words, n_hit, n_items, items, contaminated and hit_spans; columns of the caller that have these names give way."""
    names = ("n_words", "n_hit", "n_items", "items", "contaminated", "hit_spans")
    name = temp_name(docs, "judged")
    return judged(docs.drop(*names), benchmark, name, width, max_windows).withColumns({n: F.col(name)[n] for n in names}).drop(name)


#: WORD over text that isn't lower-cased.
WORD_ANY_CASE = r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+"


def decontaminate(docs: DataFrame, benchmark: DataFrame, width: int = WIDTH) -> DataFrame:
    """The documents that aren't contaminated, with their own columns."""
    name = temp_name(docs, "judged")
    return judged(docs, benchmark, name, width).filter(~F.col(name)["contaminated"]).select(*docs.columns)


def remove_spans(docs: DataFrame, benchmark: DataFrame, width: int = WIDTH) -> DataFrame:
    """docs with ``text`` without the hit words; what stands between the words stays."""
    name = temp_name(docs, "judged")
    spans = F.col(name)["hit_spans"]
    parts = F.expr(f"regexp_extract_all(text, '([^A-Za-z0-9\\\\x80-\\\\x{{10FFFF}}]*)([A-Za-z0-9\\\\x80-\\\\x{{10FFFF}}]*)', 0)")
    keep = F.filter(F.transform(parts, lambda p, i: F.struct(p.alias("p"), i.alias("i"))), lambda x: ~F.exists(spans, lambda s: (x["i"] >= s["start"]) & (x["i"] < s["start"] + s["length"])))
    cleaned = F.when(F.size(spans) > 0, F.array_join(F.transform(keep, lambda x: x["p"]), "")).otherwise(F.col("text"))
    return judged(docs, benchmark, name, width).withColumn("text", cleaned).select(*docs.columns)


def score_documents(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    out = score(docs.select("doc_id", "text"), benchmark)
    return out.select("doc_id", "n_words", "n_hit", "n_items", F.sha2(F.array_join("items", ","), 256).alias("items_sha256"), "contaminated")


ORACLE = f"""
with b as (select item_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '{WORD}') as w from benchmark),
bw as (select distinct item_id, least(len(w), {WIDTH}) as n, array_to_string(w[i:i + least(len(w), {WIDTH}) - 1], ' ') as win
       from (select *, unnest(range(1, len(w) - least(len(w), {WIDTH}) + 2)) as i from b where len(w) > 0)),
d as (select row_number() over () as rid, doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '{WORD}') as w from documents),
dw as (select rid, n, i, array_to_string(w[i:i + n - 1], ' ') as win
       from (select rid, w, n, unnest(range(1, len(w) - n + 2)) as i from d, (select distinct n from bw) where len(w) >= n)),
h as (select rid, item_id, i, dw.n from dw join bw using (n, win)),
c as (select rid, count(distinct p) as n_hit from (select rid, unnest(range(i, i + n)) as p from (select distinct rid, i, n from h)) group by rid),
t as (select rid, count(*) as n_items, string_agg(item, ',' order by item) as items from (select distinct rid, item_id::varchar as item from h) group by rid)
select doc_id, len(w)::bigint as n_words, coalesce(n_hit, 0)::bigint as n_hit, coalesce(n_items, 0)::bigint as n_items,
       sha256(coalesce(items, '')) as items_sha256, coalesce(n_hit, 0) > 0 and 20 * coalesce(n_hit, 0) >= len(w) as contaminated
from d left join c using (rid) left join t using (rid)
"""
