"""Health of a vault: report, gate, trend, token budget, corpus value, folders, facets, timelines."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions.text import age_days, half_up, token_count
from . import links, trust


def stale_pages(pages: DataFrame, now, window: Column | None = None) -> DataFrame:
    """(vault, page_id, title, days) of pages older than their review window."""
    if window is None:
        window = trust.window_days(F.col("page_id"), F.col("title"), trust.HEALTH_RULES)
    return pages.withColumn("days", age_days(F.col("mtime"), now)).filter(F.col("days") > window).select("vault", "page_id", "title", "days")


def health(pages: DataFrame, edges: DataFrame, now, window: Column | None = None) -> DataFrame:
    """One row a vault: score, pages, words, orphans, dead, stale, untagged."""
    total = pages.groupBy("vault").agg(F.count("*").alias("pages"), F.sum("words").cast("long").alias("words"), F.count_if(F.size("tags") == 0).alias("untagged"))
    parts = {"orphans": links.orphans(pages, edges), "dead": links.dead_links(pages), "stale": stale_pages(pages, now, window)}
    out = total
    for name, rows in parts.items():
        out = out.join(rows.groupBy("vault").agg(F.count("*").alias(name)), "vault", "left")
    out = out.fillna(0, [*parts])
    n = F.greatest("pages", F.lit(1))
    lost = F.col("orphans") / n * 35 + F.least(F.col("dead") / n, F.lit(1.0)) * 30 + F.col("stale") / n * 20 + F.col("untagged") / n * 15
    return out.withColumn("score", F.greatest(F.lit(0), half_up(100 - lost)))


def health_gate(report: DataFrame, max_dead: int | None = None, max_stale: int | None = None, min_score: int | None = None) -> DataFrame:
    """(vault, breach): the limits that a vault breaks."""
    tests = []
    for name, limit, worse in (("dead", max_dead, F.col("dead") > (max_dead or 0)), ("stale", max_stale, F.col("stale") > (max_stale or 0)), ("score", min_score, F.col("score") < (min_score or 0))):
        if limit is not None:
            tests.append(F.when(worse, F.lit(name)))
    return report.select("vault", F.explode(F.filter(F.array(*tests), lambda x: x.isNotNull())).alias("breach"))


def trend(points: DataFrame, keep: int = 180, tz: str = "UTC") -> tuple[DataFrame, DataFrame]:
    """The first point of each day, the last ``keep`` days; and (vault, points, change of score)."""
    day = F.to_date(F.from_utc_timestamp("at", tz))
    first = Window.partitionBy("vault", "day").orderBy("at", "score")
    days = points.withColumn("day", day).withColumn("k", F.row_number().over(first)).filter("k = 1")
    latest = Window.partitionBy("vault").orderBy(F.desc("day"))
    days = days.withColumn("k", F.row_number().over(latest)).filter(F.col("k") <= keep).drop("k")
    change = days.groupBy("vault").agg(F.count("*").alias("points"), F.when(F.count("*") > 1, F.max_by("score", "at") - F.min_by("score", "at")).alias("change"))
    return days, change


def tag_counts(pages: DataFrame) -> DataFrame:
    return pages.select("vault", F.explode("tags").alias("tag")).groupBy("vault", "tag").agg(F.count("*").alias("count"))


def folder_counts(pages: DataFrame) -> DataFrame:
    return pages.groupBy("vault", "folder").agg(F.count("*").alias("count"))


def folder_tree(pages: DataFrame, needle: str | None = None) -> DataFrame:
    """(vault, path, name, depth, count, total) of all folders and their ancestors. Folders are counted before their paths are
    expanded, so that a hot folder is one row."""
    own = folder_counts(pages).filter("folder <> ''")
    parts = F.split("folder", "/")
    paths = F.transform(F.sequence(F.lit(1), F.size(parts)), lambda i: F.array_join(F.slice(parts, F.lit(1), i), "/"))
    rows = own.select("vault", "folder", "count", F.explode(paths).alias("path"))
    out = rows.groupBy("vault", "path").agg(F.sum(F.when(F.col("path") == F.col("folder"), F.col("count")).otherwise(0)).alias("count"), F.sum("count").alias("total"))
    out = out.select("vault", "path", F.substring_index("path", "/", -1).alias("name"), (F.size(F.split("path", "/")) - 1).alias("depth"), "count", "total")
    return out if needle is None else out.filter(F.lower("path").contains(needle.lower()))


def token_budget(pages: DataFrame, counter=token_count, top: int = 5) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Folders (pages, tokens, share, fits in 200k), their heaviest pages, and the pages over max(6 * mean, 2000) tokens."""
    p = pages.select("vault", "page_id", "title", "folder", counter(F.col("plain")).alias("tokens"))
    folders = p.groupBy("vault", "folder").agg(F.count("*").alias("pages"), F.sum("tokens").alias("tokens"))
    whole = F.sum("tokens").over(Window.partitionBy("vault"))
    folders = folders.withColumn("share", F.when(whole > 0, F.col("tokens") / whole).otherwise(0.0)).withColumn("fits", F.col("tokens") <= 200_000)
    heavy = Window.partitionBy("vault", "folder").orderBy(F.desc("tokens"), "page_id")
    heaviest = p.withColumn("rank", F.row_number().over(heavy)).filter(F.col("rank") <= top)
    mean = p.groupBy("vault").agg(F.avg("tokens").alias("mean"))
    over = p.join(mean, "vault").filter(F.col("tokens") > F.greatest(F.col("mean") * 6, F.lit(2000)))
    w = Window.partitionBy("vault").orderBy(F.desc("tokens"), "page_id")
    outliers = over.withColumn("rank", F.row_number().over(w)).filter("rank <= 20").drop("mean")
    return folders, heaviest, outliers


def corpus_value(trusted: DataFrame, cold: DataFrame, pack_budget: int = 8000, counter=token_count) -> DataFrame:
    """One row a vault: tokens, 200k windows, verified and cold tokens, tokens saved by a pack."""
    p = trusted.select("vault", "page_id", "trust", counter(F.col("plain")).alias("t"))
    p = p.join(cold.select("vault", "page_id").distinct().withColumn("cold", F.lit(True)), ["vault", "page_id"], "left")
    out = p.groupBy("vault").agg(F.count("*").alias("pages"), F.sum("t").alias("tokens"), F.sum(F.when(F.col("trust") == "verified", F.col("t")).otherwise(0)).alias("verified_tokens"), F.sum(F.when(F.col("cold"), F.col("t")).otherwise(0)).alias("cold_tokens"))
    return out.withColumn("windows", F.ceil(F.col("tokens") / 200_000)).withColumn("saved_per_question", F.greatest(F.lit(0), F.col("tokens") - pack_budget))


def page_status(pages: DataFrame, edges: DataFrame, now) -> DataFrame:
    """pages with the status flags of the explorer."""
    linked = edges.select("vault", F.col("src").alias("page_id")).union(edges.select("vault", F.col("dst").alias("page_id"))).distinct().withColumn("_linked", F.lit(True))
    out = pages.join(linked, ["vault", "page_id"], "left")
    flags = {"orphan": F.col("_linked").isNull(), "untagged": F.size("tags") == 0, "stale180": age_days(F.col("mtime"), now) > 180, "has_links": F.col("_linked").isNotNull()}
    return out.withColumn("status", F.filter(F.array(*[F.when(c, F.lit(n)) for n, c in flags.items()]), lambda x: x.isNotNull())).drop("_linked")


def facets(rows: DataFrame, text: str = "", folders: list[str] = (), tags: list[str] = (), statuses: list[str] = ()) -> DataFrame:
    """(vault, facet, value, count): each facet is counted under the selections of the others."""
    has = lambda col, chosen: F.arrays_overlap(col, F.array(*[F.lit(x) for x in chosen])) if chosen else F.lit(True)
    hit = F.lower("title").contains(text.lower()) | F.lower("plain").contains(text.lower()) if text else F.lit(True)
    r = rows.withColumns({"_f": F.col("folder").isin(list(folders)) if folders else F.lit(True), "_t": has("tags", tags), "_s": has("status", statuses)}).filter(hit)
    out = None
    for name, value, others in (("folder", F.array("folder"), F.col("_t") & F.col("_s")), ("tag", F.col("tags"), F.col("_f") & F.col("_s")), ("status", F.col("status"), F.col("_f") & F.col("_t"))):
        part = r.filter(others).select("vault", F.lit(name).alias("facet"), F.explode(value).alias("value")).groupBy("vault", "facet", "value").agg(F.count("*").alias("count"))
        out = part if out is None else out.unionByName(part)
    return out


def explorer(rows: DataFrame, inbound: DataFrame, sort: str = "mtime", most: int = 200) -> DataFrame:
    """The first pages of each vault in an order: title, folder, tags, words, mtime or backlinks."""
    orders = {"title": [F.asc("title")], "folder": [F.asc("folder"), F.asc("title")], "tags": [F.desc(F.size("tags"))], "words": [F.desc("words")], "mtime": [F.desc("mtime")], "backlinks": [F.desc("inbound")]}
    out = rows.join(inbound, ["vault", "page_id"], "left").fillna(0, ["inbound"])
    return out.withColumn("rank", F.row_number().over(Window.partitionBy("vault").orderBy(*orders[sort], "page_id"))).filter(F.col("rank") <= most)


def pulse(pages: DataFrame, now) -> DataFrame:
    """(vault, newest, oldest, quiet_days, clone): a clone is three pages or more within five minutes."""
    out = pages.groupBy("vault").agg(F.max("mtime").alias("newest"), F.min("mtime").alias("oldest"), F.count("*").alias("pages"))
    clone = (F.col("pages") >= 3) & (F.unix_seconds("newest") - F.unix_seconds("oldest") <= 300)
    return out.select("vault", "newest", "oldest", age_days(F.col("newest"), now).alias("quiet_days"), clone.alias("clone"))


def timeline(pages: DataFrame, now, unit: str = "week", buckets: int | None = None) -> DataFrame:
    """(vault, bucket, folder, count): Monday weeks (26) or months (24) up to now. Future pages count as now, older
    ones in a bucket of null; an empty bucket has a row with a null folder."""
    buckets = buckets or (26 if unit == "week" else 24)
    here = F.date_trunc(unit, F.lit(now).cast("timestamp"))
    step = F.expr(f"interval {'7 days' if unit == 'week' else '1 month'}")
    start = here - F.expr(f"interval {(buckets - 1) * 7} days") if unit == "week" else F.add_months(here, -(buckets - 1)).cast("timestamp")
    at = F.date_trunc(unit, F.least("mtime", F.lit(now).cast("timestamp")))
    rows = pages.select("vault", "folder", F.when(at >= start, at).alias("bucket")).groupBy("vault", "bucket", "folder").agg(F.count("*").alias("count"))
    calendar = pages.select("vault").distinct().select("vault", F.explode(F.sequence(start, here, step)).alias("bucket"))
    empty = calendar.join(rows.select("vault", "bucket").distinct(), ["vault", "bucket"], "left_anti").select("vault", "bucket", F.lit(None).cast("string").alias("folder"), F.lit(0).cast("long").alias("count"))
    return rows.unionByName(empty)


def folder_rot(pages: DataFrame, now) -> DataFrame:
    return pages.groupBy("vault", "folder").agg(F.max("mtime").alias("newest")).select("vault", "folder", age_days(F.col("newest"), now).alias("days"))


def folder_share(pages: DataFrame) -> DataFrame:
    """(vault, folder, pages, words, share, largest): words of a page are 1 at least."""
    out = pages.groupBy("vault", "folder").agg(F.count("*").alias("pages"), F.sum(F.greatest("words", F.lit(1))).cast("long").alias("words"))
    whole = Window.partitionBy("vault")
    share = F.col("words") / F.sum("words").over(whole)
    return out.withColumn("share", share).withColumn("largest", F.max("words").over(whole) == F.col("words"))


def page_filter(pages: DataFrame, folder: str | None = None, path: str | None = None, contains: str | None = None, sourced: bool = False) -> DataFrame:
    """Pages of a folder, with a path, with a text in title or path (first 60), or with a source (first 200)."""
    out, most = pages, None
    if folder is not None:
        out = out.filter(F.col("folder") == folder)
    if path is not None:
        out = out.filter(F.col("rel_path") == path)
    if contains is not None:
        out, most = out.filter(F.lower("title").contains(contains.lower()) | F.lower("rel_path").contains(contains.lower())), 60
    if sourced:
        out, most = out.filter(F.get_json_object("frontmatter_json", "$.source").isNotNull()), 200
    if most:
        out = out.withColumn("_k", F.row_number().over(Window.partitionBy("vault").orderBy("page_id"))).filter(F.col("_k") <= most).drop("_k")
    return out


def folder_pages(pages: DataFrame, offset: int = 0, limit: int = 50) -> DataFrame:
    """Each folder's pages, newest first: position, total and whether more follow."""
    limit = min(200, max(1, limit))
    w = Window.partitionBy("vault", "folder")
    out = pages.withColumn("position", F.row_number().over(w.orderBy(F.desc("mtime"), "page_id")) - 1).withColumn("total", F.count("*").over(w))
    return out.filter(F.col("position").between(offset, offset + limit - 1)).withColumn("has_more", F.col("total") > offset + limit)


def agent_map(pages: DataFrame) -> DataFrame:
    """(vault, part, folder, item, line): a map of each vault for agents, line by line: a head (part 0), folders with their pages (1) and tags
    (2). Ordered by part, folder and item the lines are the map's file; no vault is put together in one row."""
    tags = F.when(F.size("tags") > 0, F.concat(F.lit(" — tags: "), F.array_join(F.transform("tags", lambda t: F.concat(F.lit("#"), t)), " "))).otherwise("")
    about = F.when(F.col("excerpt") != "", F.concat(F.lit(" — "), F.substring("excerpt", 1, 120))).otherwise("")
    line = F.concat(F.lit("- `"), "rel_path", F.lit("` — **"), "title", F.lit("**"), tags, about)
    row = lambda part, folder, item, line: ["vault", F.lit(part).alias("part"), folder.alias("folder"), item.alias("item"), line.alias("line")]
    none = F.lit("")
    head = F.concat(F.lit("# "), "vault", F.lit(" — wiki index: "), F.col("n").cast("string"), F.lit(" pages. Read this map first, then open only the pages you need."))
    heads = pages.groupBy("vault").agg(F.count("*").alias("n")).select(*row(0, none, none, head))
    folders = pages.select("vault", "folder").distinct().select(*row(1, F.col("folder"), none, F.concat(F.lit("## "), F.when(F.col("folder") == "", "(root)").otherwise(F.col("folder")))))
    own = pages.select(*row(1, F.col("folder"), F.col("page_id"), line))
    counts = tag_counts(pages).select(*row(2, none, F.col("tag"), F.concat(F.lit("#"), "tag", F.lit(" ("), F.col("count").cast("string"), F.lit(")"))))
    return heads.unionByName(folders).unionByName(own).unionByName(counts)
