"""Document fingerprints by I-Match with randomised lexicons.

The lexicon keeps terms whose inverse document frequency ln(N / df) lies in a band: not so
common that every document has them, not so rare that they are typing errors. A document's
terms in the lexicon, distinct and sorted, are dealt to ``subsets`` random parts of the lexicon
and each part's terms are hashed; the fingerprint is the list of hashes. Likeness is the share
of equal hashes among the parts where either document has terms. A document without any term
of the lexicon is hashed over all its terms instead.

The lexicon is of bounded size whatever the corpus: the document frequencies sum to N times the
mean number of distinct words w, so at most w / MIN_SHARE terms reach a share of MIN_SHARE
(15,000 terms where a document has 300 distinct words). It is read to the driver and becomes a
hash set in the expression.

Defined cases: a null text counts as empty and an empty text has the fingerprint of no terms;
repeated rows and equal texts have equal fingerprints; ties of doc_id follow each other in the
order of their texts; the one row of a table of one row is its own next document; an empty table
gives no rows; texts of any length are read whole; other columns are not read, whatever their names.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .common import WORD, quoted, words

#: Share of documents that a term of the lexicon is in: idf from 2.3 to 3.9.
MIN_SHARE, MAX_SHARE = 0.02, 0.1
SUBSETS = 24
#: Bytes of text in a part of the doc_id range; documents are put in order in each part by one task.
PART_BYTES = 64 << 20


def document_frequencies(docs: DataFrame) -> DataFrame:
    return docs.select(F.explode(F.array_distinct(words(F.col("text")))).alias("term")).groupBy("term").agg(F.count("*").alias("df"))


def lexicon(docs: DataFrame, min_share: float = MIN_SHARE, max_share: float = MAX_SHARE) -> list[str]:
    """Terms of the band, in order."""
    n = docs.count()
    band = document_frequencies(docs).filter((F.col("df") >= min_share * n) & (F.col("df") <= max_share * n))
    return sorted(r[0] for r in band.select("term").collect())


def dealt(kept: Column, all_words: Column, subsets: int = SUBSETS) -> Column:
    """Hashes of the parts from the sorted terms. A term's part comes from its MD5, so that
    each term is hashed once."""
    tagged = F.transform(kept, lambda t: F.struct((F.conv(F.substring(F.md5(t), 1, 6), 16, 10).cast("int") % subsets).alias("part"), t.alias("term")))
    # In an array of one, so that the terms are tagged once and not for each part.
    def joined(terms: Column) -> Column:
        return F.transform(F.sequence(F.lit(0), F.lit(subsets - 1)), lambda k: F.array_join(F.transform(F.filter(terms, lambda x: x["part"] == k), lambda x: x["term"]), " "))

    hashes = F.transform(F.element_at(F.transform(F.array(tagged), joined), 1), lambda s: F.when(s != "", F.substring(F.md5(s), 1, 8)).otherwise(F.lit("")))
    return F.when(F.size(kept) > 0, hashes).otherwise(F.array(F.substring(F.md5(F.array_join(F.array_sort(F.array_distinct(all_words)), " ")), 1, 16)))


def likeness(a: Column, b: Column) -> Column:
    same = F.size(F.filter(F.zip_with(a, b, lambda x, y: (x == y) & (x != "")), lambda x: x))
    either = F.size(F.filter(F.zip_with(a, b, lambda x, y: (x != "") | (y != "")), lambda x: x))
    return F.when(F.size(a) != F.size(b), F.lit(0.0)).otherwise(same / either)


def fingerprints(rows: DataFrame, texts: dict[str, str], terms: list[str], subsets: int = SUBSETS) -> DataFrame:
    """rows with an array of hashes for each text column: {text column: new column}."""
    listed = quoted(terms)
    for i, (source, out) in enumerate(texts.items()):
        w, kept = f"_vf_words{i}", f"_vf_kept{i}"
        rows = rows.withColumn(w, words(F.col(source)))
        rows = rows.withColumn(kept, F.expr(f"array_sort(array_distinct(filter({w}, w -> w in ({listed}))))"))
        rows = rows.withColumn(out, dealt(F.col(kept), F.col(w), subsets)).drop(w, kept)
    return rows


def with_next(docs: DataFrame, add=None) -> DataFrame:
    """(doc_id, text, next_text): the next document in ascending doc_id; the first after the last.
    ``add`` makes columns from the text; each comes with a column next_... of the next document.

    Documents are dealt to consecutive ranges of doc_id, as many as the bytes of all texts ask for, and each range also gets a
    copy of the first document of the range after it, so that one exchange and a window in each range do. Documents
    of one doc_id (or without any) are in one range."""
    base = docs.select("doc_id", F.coalesce(F.col("text"), F.lit("")).alias("text"))
    ids = base.select(F.col("doc_id").cast("double").alias("x"))
    size = base.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    parts = -(-size // PART_BYTES) + 4 * docs.sparkSession.sparkContext.defaultParallelism
    cuts = sorted(set(ids.approxQuantile("x", [i / parts for i in range(1, parts)], 1 / (4 * parts))))  # a number a part
    placed = base.withColumn("part", F.when(F.col("doc_id").isNull(), -1).otherwise(cuts_below(F.col("doc_id").cast("double"), cuts)))
    firsts = [tuple(r) for r in placed.groupBy("part").agg(F.min("doc_id").alias("doc_id")).orderBy("part").collect()]  # a row a part
    # The first row of a range is the least (doc_id, text) in it; it follows the last row of the range before.
    follows = [(part, doc_id, firsts[i - 1][0]) for i, (part, doc_id) in enumerate(firsts)]
    follows = docs.sparkSession.createDataFrame(follows, f"of int, first {docs.schema['doc_id'].dataType.simpleString()}, `into` int")
    heads = placed.join(F.broadcast(follows), (F.col("part") == F.col("of")) & F.col("doc_id").eqNullSafe(F.col("first")))  # a row a part
    heads = heads.groupBy("into", "doc_id").agg(F.min("text").alias("text")).select("doc_id", "text", F.col("into").alias("part"), F.lit(1).alias("extra"))
    both = placed.withColumn("extra", F.lit(0)).unionByName(heads)
    both = add(both) if add else both
    given = [c for c in both.columns if c not in ("part", "extra", "doc_id")]
    order = Window.partitionBy("part").orderBy("extra", F.col("doc_id").asc_nulls_first(), "text")
    return both.withColumns({f"next_{c}": F.lead(c).over(order) for c in given}).filter("extra = 0").drop("part", "extra")


def cuts_below(x: Column, cuts: list[float]) -> Column:
    """How many of the ascending cuts are x or less, by binary search."""
    if not cuts:
        return F.lit(0)
    held = F.array(*[F.lit(c) for c in cuts])

    def step(s: Column, _: Column) -> Column:
        middle = F.floor((s["low"] + s["high"]) / 2).cast("int")
        up = (s["low"] < s["high"]) & (F.get(held, middle) <= x)
        return F.struct(F.when(up, middle + 1).otherwise(s["low"]).alias("low"), F.when(up | (s["low"] == s["high"]), s["high"]).otherwise(middle).alias("high"))

    rounds = F.array_repeat(F.lit(0), len(cuts).bit_length())
    return F.aggregate(rounds, F.struct(F.lit(0).alias("low"), F.lit(len(cuts)).alias("high")), step, lambda s: s["low"])


def fingerprint_documents(docs: DataFrame) -> DataFrame:
    """(doc_id, n_chars, edited_sha256, fingerprint, edited_fingerprint, near_edited, near_next)."""
    terms = lexicon(docs)
    rows = with_next(docs, lambda d: fingerprints(d, {"text": "own"}, terms)).withColumn("n_chars", F.char_length("text").cast("long"))
    rows = rows.withColumn("edited", F.concat(F.expr("substring(text, 1, cast(n_chars - n_chars div 2 as int))"), F.expr("substring(next_text, 1, cast(n_chars div 2 as int))")))
    rows = fingerprints(rows, {"edited": "changed"}, terms)
    return rows.select(
        "doc_id",
        "n_chars",
        F.sha2("edited", 256).alias("edited_sha256"),
        F.array_join("own", "-").alias("fingerprint"),
        F.array_join("changed", "-").alias("edited_fingerprint"),
        F.round(likeness(F.col("own"), F.col("changed")), 6).alias("near_edited"),
        F.round(likeness(F.col("own"), F.col("next_own")), 6).alias("near_next"),
    )


ORACLE = f"""
with d as (select doc_id, coalesce(text, '') as text, coalesce(lead(coalesce(text, '')) over (order by doc_id nulls first, text),
                  first_value(coalesce(text, '')) over (order by doc_id nulls first, text)) as next_text from documents),
e as (select *, len(text)::bigint as n_chars, left(text, (len(text) - len(text) // 2)::int) || left(next_text, (len(text) // 2)::int) as edited from d),
w as (select doc_id, n_chars, edited, k, regexp_extract_all(translate(t, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '{WORD}') as ws
      from (select doc_id, n_chars, edited, unnest([0, 1, 2]) as k, unnest([text, edited, next_text]) as t from e)),
df as (select term, count(*) as df from (select unnest(list_distinct(ws)) as term from w where k = 0) group by term),
lex as (select list(term) as terms from df where df >= {MIN_SHARE} * (select count(*) from documents) and df <= {MAX_SHARE} * (select count(*) from documents)),
kept as (select w.*, list_sort(list_intersect(list_distinct(ws), coalesce((select terms from lex), []))) as kept from w),
h as (select doc_id, n_chars, edited, k,
             case when len(kept) > 0 then list_transform(range({SUBSETS}), lambda s: case when len(list_filter(kept, lambda t: ('0x' || md5(t)[1:6])::int % {SUBSETS} = s)) > 0
                  then md5(array_to_string(list_filter(kept, lambda t: ('0x' || md5(t)[1:6])::int % {SUBSETS} = s), ' '))[1:8] else '' end)
                  else [md5(array_to_string(list_sort(list_distinct(ws)), ' '))[1:16]] end as fp
      from kept),
p as (select doc_id, any_value(n_chars) as n_chars, any_value(edited) as edited, any_value(fp) filter (k = 0) as own, any_value(fp) filter (k = 1) as changed, any_value(fp) filter (k = 2) as following from h group by doc_id)
select doc_id, n_chars, sha256(edited) as edited_sha256, array_to_string(own, '-') as fingerprint, array_to_string(changed, '-') as edited_fingerprint,
       round(case when len(own) <> len(changed) then 0.0 else len(list_filter(range(1, len(own) + 1), lambda i: own[i] = changed[i] and own[i] <> ''))::double
             / len(list_filter(range(1, len(own) + 1), lambda i: own[i] <> '' or changed[i] <> '')) end, 6) as near_edited,
       round(case when len(own) <> len(following) then 0.0 else len(list_filter(range(1, len(own) + 1), lambda i: own[i] = following[i] and own[i] <> ''))::double
             / len(list_filter(range(1, len(own) + 1), lambda i: own[i] <> '' or following[i] <> '')) end, 6) as near_next
from p
"""
