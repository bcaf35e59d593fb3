"""Write journal, versions, attribution, triage, changes, comments, activity."""

from __future__ import annotations

from difflib import SequenceMatcher

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions.text import content_hash, half_up, strip_extension
from ..functions.udf import vectorised
from . import grams, trust


def common_ends(old: list[str], new: list[str]) -> tuple[int, int]:
    """How many lines two texts share at their beginning, and of the rest at their end."""
    equal = [x == y for x, y in zip(old, new, strict=False)]
    head = (*equal, False).index(False)
    equal = [x == y for x, y in zip(reversed(old[head:]), reversed(new[head:]), strict=False)]
    return head, (*equal, False).index(False)


def classify_texts(before: str | None, after: str | None, ignore_final_newline: bool = False) -> tuple[str | None, int, int]:
    """(kind, lines added, lines removed); kind None if nothing changed."""
    if before == after:
        return None, 0, 0
    if before is None:
        return "created", len(after.split("\n")) if after else 0, 0
    if after is None:
        return "deleted", 0, len(before.split("\n"))
    if ignore_final_newline:
        before = before[:-1] if before.endswith("\n") else before
    old, new = before.split("\n"), after.split("\n")
    head, tail = common_ends(old, new)
    removed, added = len(old) - head - tail, len(new) - head - tail
    kind = "appended" if len(new) > len(old) and head == len(old) else "rewritten"
    return kind, added, removed


@vectorised("kind string, lines_added int, lines_removed int")
def classify(before: pd.Series, after: pd.Series) -> pd.DataFrame:
    none = lambda x: None if x is None or x != x else x
    return pd.DataFrame([classify_texts(none(b), none(a)) for b, a in zip(before, after, strict=True)], columns=["kind", "lines_added", "lines_removed"])


def classify_writes(snapshots: DataFrame) -> DataFrame:
    """Journal from (vault, rel_path, at, text), text null for a deletion: each text against the one before it."""
    w = Window.partitionBy("vault", "rel_path").orderBy("at")
    s = snapshots.withColumn("_before", F.lag("text").over(w)).withColumn("_c", classify("_before", "text"))
    return s.filter("_c.kind is not null").select("vault", "rel_path", "at", "_c.kind", "_c.lines_added", "_c.lines_removed", content_hash(F.col("text")).alias("hash"))


def retain_versions(versions: DataFrame, keep: int = 40) -> DataFrame:
    """Versions that differ from the one before, the newest ``keep`` of each page."""
    w = Window.partitionBy("vault", "rel_path").orderBy("at")
    out = versions.withColumn("_h", F.lag("hash").over(w)).filter(F.col("_h").isNull() | (F.col("_h") != F.col("hash"))).drop("_h")
    return out.withColumn("_k", F.row_number().over(Window.partitionBy("vault", "rel_path").orderBy(F.desc("at")))).filter(F.col("_k") <= keep).drop("_k")


def version_at(versions: DataFrame, at) -> DataFrame:
    """(vault, rel_path, at, text): what each page said at a time; ``at`` of a version is when it stopped being current."""
    later = versions.filter(F.col("at") > F.lit(at).cast("timestamp"))
    return later.groupBy("vault", "rel_path").agg(F.min("at").alias("at"), F.min_by("text", "at").alias("text"))


def search_history(versions: DataFrame, queries: DataFrame, most: int = 40) -> DataFrame:
    """(query_id, vault, rel_path, at, line) for queries of 3 characters or more: the first line of each version that holds the text."""
    q = queries.select("query_id", F.lower(F.trim("query")).alias("phrase")).filter(F.length("phrase") >= 3)
    x = versions.select("vault", "rel_path", "at", "text", F.lower("text").alias("b"))

    def first_line(q: Column) -> Column:
        line = F.get(F.filter(F.split("text", "\n"), lambda x: F.lower(x).contains(q)), F.lit(0))
        return F.when(F.col("b").contains(q), F.struct(F.substring(F.trim(line), 1, 240).alias("line")))

    out = grams.matches(q, x, ["vault", "rel_path", "at"], F.col("b"), first_line).select("phrase", "vault", "rel_path", "at", "value.line")
    # Queries of one phrase have the same hits, so hits are ranked before queries are joined in.
    out = out.withColumn("rank", F.row_number().over(Window.partitionBy("phrase").orderBy(F.desc("at"), "vault", "rel_path"))).filter(F.col("rank") <= most)
    return out.join(q, "phrase").select("query_id", "vault", "rel_path", "at", "line", "rank")


def attribution_by_path(attributions: DataFrame, root: str) -> DataFrame:
    """(rel_path, agent, tool, at): the last writer of each file under root."""
    root = root.rstrip("/") + "/"
    own = attributions.filter(F.col("file").startswith(root)).withColumn("rel_path", F.substring("file", len(root) + 1, 1_000_000))
    last = own.groupBy("rel_path").agg(F.max(F.struct("at", "agent", "tool")).alias("x"))
    return last.select("rel_path", "x.agent", "x.tool", "x.at")


def collapse(journal: DataFrame) -> DataFrame:
    """One row a page: the most lines removed and added, kind and time of the latest write."""
    out = journal.groupBy("vault", "rel_path").agg(F.max("lines_removed").alias("lines_removed"), F.max("lines_added").alias("lines_added"), F.max(F.struct("at", "kind")).alias("x"))
    return out.select("vault", "rel_path", "lines_removed", "lines_added", "x.at", "x.kind")


def triage(journal: DataFrame, pages: DataFrame, inbound: DataFrame, ledger: DataFrame, now, limit: int = 12, decay_days: int = trust.DECAY_DAYS) -> DataFrame:
    """The writes of each vault that most need a look, with a score and why."""
    rows = collapse(journal).withColumn("page_id", strip_extension(F.col("rel_path")))
    meta = trust.with_trust(pages.select("vault", "page_id", "title", "hash"), ledger, now, decay_days).drop("hash")
    r = rows.join(meta, ["vault", "page_id"]).join(inbound, ["vault", "page_id"], "left").fillna(0, ["inbound"])
    state = F.when(F.col("trust") == "lapsed", 25).when(F.col("trust") == "unverified", 10).otherwise(0)
    score = F.col("lines_removed") * 3 + F.col("lines_added") * F.lit(0.2).cast("double") + F.log2(F.col("inbound") + 1) * 8 + state + F.when(F.col("kind") == "rewritten", 12).otherwise(0)
    base = F.concat_ws(
        " · ",
        F.when(F.col("lines_removed") > 0, F.concat(F.col("lines_removed").cast("string"), F.lit(" lines removed"))),
        F.when(F.col("inbound") >= 5, F.concat(F.col("inbound").cast("string"), F.lit(" pages link here"))),
        F.when(F.col("trust") == "lapsed", F.lit("you had verified this")),
    )
    why = F.when(base != "", base).when(F.col("kind") == "rewritten", F.lit("rewritten in place")).otherwise(F.concat(F.col("lines_added").cast("string"), F.lit(" lines added")))
    out = r.withColumn("_score", score).withColumn("score", half_up(score)).withColumn("why", why)
    w = Window.partitionBy("vault").orderBy(F.desc("score"), "page_id")
    return out.withColumn("rank", F.row_number().over(w)).filter(F.col("rank") <= limit).drop("_score")


def hubs(inbound: DataFrame, pages: DataFrame, ledger: DataFrame, now, limit: int = 10) -> DataFrame:
    out = inbound.join(trust.with_trust(pages.select("vault", "page_id", "title", "hash"), ledger, now).drop("hash"), ["vault", "page_id"])
    return out.withColumn("rank", F.row_number().over(Window.partitionBy("vault").orderBy(F.desc("inbound"), "page_id"))).filter(F.col("rank") <= limit)


def changes(journal: DataFrame, pages: DataFrame, ledger: DataFrame, writers: DataFrame, quarantine: DataFrame, since, now) -> DataFrame:
    """One row for each page written in [since, now): kinds, lines, last time, writer, trust, and whether it is gone."""
    t = F.col("at")
    rows = journal.filter((t >= F.lit(since).cast("timestamp")) & (t < F.lit(now).cast("timestamp"))).withColumn("page_id", strip_extension(F.col("rel_path")))
    rows = trust.without_quarantined(rows, quarantine)
    rows = rows.groupBy("vault", "page_id", "rel_path").agg(F.array_sort(F.collect_set("kind")).alias("kinds"), F.sum("lines_added").alias("lines_added"), F.sum("lines_removed").alias("lines_removed"), F.max("at").alias("last_at"))
    meta = trust.with_trust(pages.select("vault", "page_id", "title", "hash"), ledger, now).drop("hash")
    out = rows.join(meta, ["vault", "page_id"], "left").join(writers.select("rel_path", "agent"), "rel_path", "left")
    return out.withColumn("gone", F.col("title").isNull()).withColumn("trust", F.coalesce("trust", F.lit("unverified")))


def fold_comments(log: DataFrame) -> DataFrame:
    """Comments with resolved_at: a tombstone (resolve = the comment's id) written after it resolves it."""
    marks = log.filter("resolve is not null").select("vault", F.col("resolve").alias("id"), F.col("at").alias("resolved"))
    c = log.filter("resolve is null").drop("resolve")
    last = c.select("vault", "id", "at").join(marks, ["vault", "id"]).filter("resolved >= at").groupBy("vault", "id").agg(F.max("resolved").alias("resolved_at"))
    return c.join(last, ["vault", "id"], "left").withColumn("open", F.col("resolved_at").isNull())


def activity_feed(activity: DataFrame, kind: str | None = None, since=None, most: int = 50) -> DataFrame:
    out = activity
    if kind:
        out = out.filter(F.col("kind") == kind)
    if since is not None:
        out = out.filter(F.col("at") >= F.lit(since).cast("timestamp"))
    order = [F.desc("at"), *[c for c in ("page_id", "kind", "by") if c in activity.columns]]
    return out.withColumn("rank", F.row_number().over(Window.partitionBy("vault").orderBy(*order))).filter(F.col("rank") <= most)


def reconcile(files: DataFrame, state: DataFrame, now, deletions: bool = False) -> DataFrame:
    """Journal rows that a sweep finds: files whose text is not what state (vault, rel_path, text) says."""
    old = state.select("vault", "rel_path", F.col("text").alias("_before"))
    both = files.select("vault", "rel_path", "text").join(old, ["vault", "rel_path"], "full" if deletions else "left")
    both = both.filter(~F.col("text").eqNullSafe(F.col("_before"))).withColumn("_c", classify("_before", "text"))
    return both.select("vault", "rel_path", F.lit(now).cast("timestamp").alias("at"), "_c.kind", "_c.lines_added", "_c.lines_removed", content_hash(F.col("text")).alias("hash"))


def as_of(asked: DataFrame, facts: DataFrame, keys: list[str], value: str) -> DataFrame:
    """asked (*keys, at) with the value of the latest fact (*keys, at, value) at that time or before; the last one of all where at is null.

    A merge: both are laid on one line of time for each key and the latest fact is carried along, so no fact meets every question. Of facts of one
    time the greatest value counts."""
    one = facts.groupBy(*keys, "at").agg(F.max(value).alias(value))
    line = one.select(*keys, "at", F.struct(F.col(value)).alias("_fact")).unionByName(asked.select(*keys, "at").distinct().withColumn("_fact", F.lit(None).cast(f"struct<{value}:{facts.schema[value].dataType.simpleString()}>")))
    order = Window.partitionBy(*keys).orderBy(F.col("at").asc_nulls_last(), F.col("_fact").isNull()).rowsBetween(Window.unboundedPreceding, 0)
    return line.withColumn("_last", F.last("_fact", ignorenulls=True).over(order)).filter("_fact is null").select(*keys, "at", F.col("_last")[value].alias(value))


def first_holding(lines: DataFrame, versions: DataFrame) -> DataFrame:
    """(vault, rel_path, line_text, found) of distinct lines: the time of the first version that holds the line, also as a part of a longer one.

    Equal lines are found by a join of lines. Only a line that the oldest version has not as a whole line is looked for as a part, in the
    versions before the first that has it."""
    keys = ["vault", "rel_path"]
    v = versions.select(*keys, F.col("at").alias("v_at"), F.col("text").alias("v_text"))
    whole = v.select(*keys, "v_at", F.explode(F.array_distinct(F.split("v_text", "\n"))).alias("line_text")).groupBy(*keys, "line_text").agg(F.min("v_at").alias("equal_at"))
    oldest = v.groupBy(*keys).agg(F.min("v_at").alias("oldest"))
    known = lines.select(*keys, "line_text").distinct().join(whole, [*keys, "line_text"], "left").join(oldest, keys)
    done = known.filter("equal_at = oldest").select(*keys, "line_text", F.col("equal_at").alias("found"))
    rest = known.filter("equal_at is null or equal_at > oldest")
    part = rest.join(v, keys).filter((F.col("equal_at").isNull() | (F.col("v_at") < F.col("equal_at"))) & F.col("v_text").contains(F.col("line_text")))
    part = part.groupBy(*keys, "line_text").agg(F.min("v_at").alias("part_at"))
    rest = rest.join(part, [*keys, "line_text"], "left").select(*keys, "line_text", F.least("part_at", "equal_at").alias("found")).filter("found is not null")
    return done.unionByName(rest)


def blame(lines_of: DataFrame, versions: DataFrame, attributions: DataFrame, unknown: str = "oldest") -> DataFrame:
    """(vault, rel_path, line, text, agent, at) of each line of the files (vault, rel_path, text).

    A line is dated by the first version that holds it; one that the oldest version holds, or a blank one, has no writer. A line that
    no version holds is dated by the oldest version (or the newest)."""
    lines = lines_of.select("vault", "rel_path", F.posexplode(F.split("text", "\n")).alias("line", "line_text"))
    lines = lines.withColumn("line", F.col("line") + 1)
    first = first_holding(lines.filter(F.trim("line_text") != ""), versions)
    ends = versions.groupBy("vault", "rel_path").agg(F.min("at").alias("oldest"), (F.min if unknown == "oldest" else F.max)("at").alias("else_at"))
    dated = lines.join(first, ["vault", "rel_path", "line_text"], "left").join(ends, ["vault", "rel_path"], "left")
    blank = F.trim("line_text") == ""
    old = F.col("found").eqNullSafe(F.col("oldest")) & F.col("found").isNotNull()
    dated = dated.withColumn("at", F.when(blank | old, None).otherwise(F.coalesce("found", "else_at"))).withColumn("_write", ~blank & ~old)
    # The last attribution of the file at or before that time.
    files = lines_of.select("vault", "rel_path").distinct()
    tail = F.reverse(F.split("file", "/"))
    tails = F.transform(F.sequence(F.lit(1), F.size(tail)), lambda i: F.array_join(F.reverse(F.slice(tail, F.lit(1), i)), "/"))
    writers = attributions.select("at", "agent", F.explode(tails).alias("rel_path")).join(files, "rel_path").select("vault", "rel_path", "at", "agent")
    who = as_of(dated.filter("_write"), writers, ["vault", "rel_path"], "agent")
    who = who.select(F.col("vault").alias("_v"), F.col("rel_path").alias("_p"), F.col("at").alias("_at"), "agent")
    out = dated.join(who, (F.col("vault") == F.col("_v")) & (F.col("rel_path") == F.col("_p")) & F.col("at").eqNullSafe(F.col("_at")) & F.col("_write"), "left")
    return out.select("vault", "rel_path", "line", F.col("line_text").alias("text"), "agent", "at")


@vectorised("array<struct<op:string,text:string>>")
def diff_lines(before: pd.Series, after: pd.Series) -> pd.Series:
    """Lines that differ between two texts, with two lines around them: op is ' ', '-' or '+'."""

    def one(b: str | None, a: str | None) -> list[dict]:
        old, new = (b or "").split("\n"), (a or "").split("\n")
        head, tail = common_ends(old, new)
        if head == len(old) == len(new):
            return []
        rows = [(" ", x) for x in old[max(0, head - 2) : head]]
        rows += [("-", x) for x in old[head : len(old) - tail]] + [("+", x) for x in new[head : len(new) - tail]]
        rows += [(" ", x) for x in old[len(old) - tail : len(old) - tail + 2]] if tail else []
        return [{"op": o, "text": t} for o, t in rows]

    return pd.Series([one(b, a) for b, a in zip(before, after, strict=True)])


@vectorised("added int, removed int, same int")
def diff_words(before: pd.Series, after: pd.Series) -> pd.DataFrame:
    """Words added, removed and kept between two texts, by their longest matching runs."""
    rows = []
    for b, a in zip(before, after, strict=True):
        old, new = (b or "").split(), (a or "").split()
        same = sum(m.size for m in SequenceMatcher(None, old, new, autojunk=False).get_matching_blocks())
        rows.append((len(new) - same, len(old) - same, same))
    return pd.DataFrame(rows, columns=["added", "removed", "same"])
