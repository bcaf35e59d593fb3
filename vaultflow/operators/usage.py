"""Usage log: reads, searches, misses, agents, cold pages and gap clusters."""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator

import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions.text import half_up
from ..functions.udf import vectorised
from .graph import components
from .storage import materialize

#: Words that say nothing about what a search was for. Fixed values.
STOP = frozenset([
    "the", "a", "an", "of", "to", "in", "for", "on", "and", "or", "is", "are", "was", "were", "how", "what", "why", "when", "where", "do", "does",
    "did", "with", "from", "by", "at", "it", "its", "this", "that", "i", "we", "you", "my", "our", "your", "me", "us", "can", "should", "would",
    "could", "about", "get", "set", "use", "using", "need", "want", "find", "show", "tell", "any", "all", "some", "there", "here",
])
THRESHOLD = 0.4


def _miss():
    return (F.col("t") == "search") & (F.col("hits") == 0)


def recent(usage: DataFrame, now, days: int = 30) -> DataFrame:
    return usage.filter(F.col("at") >= F.timestamp_seconds(F.unix_seconds(F.lit(now).cast("timestamp")) - days * 86_400))


def usage_totals(usage: DataFrame) -> DataFrame:
    n = usage.groupBy("vault").agg(F.count_if(F.col("t") == "read").alias("reads"), F.count_if(F.col("t") == "search").alias("searches"), F.count_if(_miss()).alias("misses"))
    return n.withColumn("miss_rate", F.when(F.col("searches") > 0, F.col("misses") / F.col("searches")).otherwise(0.0))


def hot_pages(usage: DataFrame) -> DataFrame:
    return usage.filter("t = 'read'").groupBy("vault", "page").agg(F.count("*").alias("reads"), F.max("at").alias("last_read"), F.countDistinct("agent").alias("agents"))


def gaps(usage: DataFrame) -> DataFrame:
    key = F.lower(F.trim("query"))
    return usage.filter(_miss()).withColumn("gap", key).filter("gap <> ''").groupBy("vault", "gap").agg(F.count("*").alias("misses"), F.max("at").alias("last_asked"), F.countDistinct("agent").alias("agents"))


def daily(usage: DataFrame) -> DataFrame:
    return usage.filter("t in ('read', 'search')").groupBy("vault", F.to_date("at").alias("day")).agg(F.count_if(F.col("t") == "read").alias("reads"), F.count_if(F.col("t") == "search").alias("searches"))


def agent_events(usage: DataFrame) -> DataFrame:
    return usage.groupBy("vault", "agent").agg(F.count("*").alias("events"))


def score_agents(usage: DataFrame) -> DataFrame:
    """One row an agent; a blank name is unknown."""
    agent = F.when(F.coalesce(F.col("agent"), F.lit("")) == "", "unknown").otherwise(F.col("agent"))
    out = usage.withColumn("agent", agent).groupBy("vault", "agent").agg(
        F.count_if(F.col("t") == "read").alias("reads"),
        F.count_if(F.col("t") == "search").alias("searches"),
        F.count_if(_miss()).alias("misses"),
        F.countDistinct(F.when(F.col("t") == "read", F.col("page"))).alias("pages_touched"),
        F.max("at").alias("last_seen"),
    )
    return out.withColumn("miss_rate", F.when(F.col("searches") > 0, half_up(F.col("misses") * 100 / F.col("searches"))).otherwise(0))


def cold_pages(pages: DataFrame, usage: DataFrame) -> DataFrame:
    """Pages that nobody read."""
    read = usage.filter("t = 'read'").select("vault", F.col("page").alias("page_id")).distinct()
    return pages.join(read, ["vault", "page_id"], "left_anti")


def keep_newest(log: DataFrame, most: int = 50_000) -> DataFrame:
    """The newest events of each vault.

    Events are counted by the hour first. Whole hours that hold fewer than ``most`` events together with all later ones stay as they are, hours before
    the one in which the limit falls go; only that hour's events are put in order."""
    order = [F.desc("at"), *[c for c in ("event_id", "agent", "page", "query") if c in log.columns]]
    hours = log.groupBy("vault", F.date_trunc("hour", "at").alias("_hour")).agg(F.count("*").alias("_n"))
    later = Window.partitionBy("vault").orderBy(F.col("_hour").desc_nulls_last()).rowsBetween(Window.unboundedPreceding, -1)
    hours = hours.withColumn("_later", F.coalesce(F.sum("_n").over(later), F.lit(0))).filter(F.col("_later") < most)
    hours = hours.withColumnsRenamed({"vault": "_v", "_hour": "_h"})
    near = log.join(hours, F.col("vault").eqNullSafe(F.col("_v")) & F.date_trunc("hour", "at").eqNullSafe(F.col("_h")))
    whole = near.filter(F.col("_later") + F.col("_n") <= most).select(*log.columns)
    edge = near.filter(F.col("_later") + F.col("_n") > most).withColumn("_k", F.row_number().over(Window.partitionBy("vault").orderBy(*order)))
    return whole.unionByName(edge.filter(F.col("_later") + F.col("_k") <= most).select(*log.columns))


def gap_terms(query: str) -> list[str]:
    """Content words of a search, once each, in order."""
    out = []
    for w in re.sub(r"[^a-z0-9\s-]", " ", query.lower()).split():
        if len(w) > 2 and w not in STOP:
            out.append(w[:-3] + "y" if w.endswith("ies") else w[:-1] if w.endswith("s") else w)
    return list(dict.fromkeys(out))


class Leaders:
    """Leader clustering of queries that come one by one: each joins the first cluster that shares THRESHOLD of the terms of both,
    and the cluster takes over its terms.

    Clusters are found by term and size. A query looks through its terms from the rarest on; a cluster that it first meets at its i-th term can share
    only the terms that are left, so just clusters of a size that these could still reach are looked at, and a word that all
    queries have is hardly ever looked up. Clusters too large for any query are forgotten."""

    def __init__(self, most_terms: int):
        self.most = int(most_terms / THRESHOLD)
        self.terms: dict[int, dict[str, None]] = {}
        self.by_term: dict[str, dict[int, set[int]]] = {}
        self.spread: Counter = Counter()
        self.count = 0

    def _move(self, i: int, terms, size: int, there: bool) -> None:
        for t in terms:
            sizes = self.by_term.setdefault(t, {})
            if there:
                sizes.setdefault(size, set()).add(i)
            else:
                sizes[size].discard(i)
                if not sizes[size]:
                    del sizes[size]

    def home(self, terms: list[str]) -> int | None:
        best, n, seen = None, len(terms), set()
        for k, t in enumerate(sorted(terms, key=lambda t: self.spread[t])):
            largest = (1 / THRESHOLD + 1) * (n - k) - n + 1e-9  # of a cluster that shares n - k terms at most
            for size, own in self.by_term.get(t, {}).items():
                if size > largest:
                    continue
                for i in own - seen:
                    seen.add(i)
                    both = sum(x in self.terms[i] for x in terms)
                    if both / (size + n - both) >= THRESHOLD and (best is None or i < best):
                        best = i
        return best

    def add(self, terms: list[str]) -> tuple[int, list[str]]:
        """The query's cluster, and those of its terms that are among the cluster's first six."""
        i = self.home(terms)
        if i is None:
            i, self.count = self.count, self.count + 1
            self.terms[i] = {}
        own = self.terms[i]
        new = [t for t in terms if t not in own]
        if new:
            self._move(i, own, len(own), False)
            first = new[: max(0, 6 - len(own))]
            own.update(dict.fromkeys(new))
            self.spread.update(new)
            if len(own) <= self.most:
                self._move(i, own, len(own), True)
            else:
                del self.terms[i]
            return i, first
        return i, []


@vectorised("array<string>")
def terms_of(query: pd.Series) -> pd.Series:
    return query.map(lambda q: gap_terms(q or ""))


def led(rows: DataFrame, most_terms: int) -> DataFrame:
    """rows (vault, part, terms, ...) of each part in their order, with ``cluster`` and ``first_terms``. Rows stream by in sorted partitions; what is
    kept between them is the terms of the part's clusters."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, leaders = None, None
        for batch in batches:
            out = []
            for key, terms in zip(zip(batch.column("vault").to_pylist(), batch.column("part").to_pylist(), strict=True), batch.column("terms").to_pylist(), strict=True):
                if key != part:
                    part, leaders = key, Leaders(most_terms)
                out.append(leaders.add(terms))
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array([i for i, _ in out], pa.int64()), pa.array([t for _, t in out], pa.list_(pa.string()))], names=[*batch.schema.names, "cluster", "first_terms"])

    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in rows.schema.fields) + ", cluster long, first_terms array<string>"
    order = [F.desc("n"), F.asc("first"), F.asc("gap")]
    return rows.repartition("vault", "part").sortWithinPartitions("vault", "part", *order).mapInArrow(run, schema)


def cluster_gaps(usage: DataFrame, limit: int = 20) -> DataFrame:
    """Searches without hits, clustered by their words.

    Counting comes first: only distinct queries are clustered. Queries that share no word, even through others, never meet, so each
    connected part is a stream of its own; a cluster's rows are summed up by Spark, not gathered."""
    q = usage.filter(_miss()).withColumn("gap", F.lower(F.trim("query"))).filter("gap <> ''")
    q = q.groupBy("vault", "gap").agg(F.count("*").alias("n"), F.min(F.struct("at", F.trim("query").alias("query"))).alias("f"), F.max("at").alias("last"), F.collect_set("agent").alias("agents"))
    q = q.select("vault", "gap", "n", F.col("f.at").alias("first"), F.col("f.query").alias("query"), "last", "agents", terms_of("f.query").alias("terms")).filter(F.size("terms") > 0)
    q = materialize(q.withColumn("id", F.monotonically_increasing_id()))
    words = q.select("vault", "id", F.explode("terms").alias("term"))
    numbers = materialize(words.select("vault", "term").distinct().withColumn("word", -1 - F.monotonically_increasing_id()))
    parts = components(words.join(numbers, ["vault", "term"]).select(F.col("id").alias("a"), F.col("word").alias("b")))
    dealt = q.join(parts.select(F.col("node").alias("id"), F.col("component").alias("part")), "id")
    most = q.agg(F.max(F.size("terms"))).first()[0] or 0
    rows = led(dealt, most).withColumn("place", F.struct(-F.col("n"), F.col("first"), F.col("gap")))
    shown = F.filter(F.array_sort(F.collect_list(F.when(F.size("first_terms") > 0, F.struct("place", "first_terms")))), lambda x: x.isNotNull())  # six rows at most
    out = rows.groupBy("vault", "part", "cluster").agg(
        F.min_by("query", "place").alias("label"),
        F.flatten(F.transform(shown, lambda x: x["first_terms"])).alias("terms"),
        F.count("*").cast("int").alias("queries"),
        F.sum("n").alias("misses"),
        F.array_sort(F.array_distinct(F.flatten(F.collect_set("agents")))).alias("agents"),
        F.max("last").alias("last_asked"),
    )
    w = Window.partitionBy("vault").orderBy(F.desc("misses"), F.desc("last_asked"), "label")
    return out.withColumn("rank", F.row_number().over(w)).filter(F.col("rank") <= limit).drop("part", "cluster")


def gap_list(clusters: DataFrame, most: int = 20) -> DataFrame:
    """(vault, text): the gaps as a list to work through."""
    line = F.concat(F.lit("- "), "label", F.lit(" ("), F.col("misses").cast("string"), F.lit(" misses)"))
    rows = clusters.filter(F.col("rank") <= most).groupBy("vault").agg(F.array_sort(F.collect_list(F.struct("rank", line.alias("line")))).alias("x"))
    return rows.select("vault", F.array_join(F.transform("x", lambda r: r["line"]), "\n").alias("text"))
