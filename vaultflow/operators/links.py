"""Link resolution, dead links, backlinks, graphs, free paths and merges."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions.text import base_name, slugify


def _only(pages: DataFrame, key, name: str) -> DataFrame:
    """(vault, key, page_id where it is the only one): ambiguous keys are one row, never a fan-out."""
    keyed = pages.select("vault", "page_id", key.alias("key")).distinct()
    return keyed.groupBy("vault", "key").agg(F.count("*").alias("n"), F.min("page_id").alias(name)).withColumn(name, F.when(F.col("n") == 1, F.col(name))).drop("n")


def wanted_links(pages: DataFrame) -> DataFrame:
    return pages.select("vault", F.col("page_id").alias("src"), F.explode("raw_links").alias("target")).withColumn("key", F.lower("target"))


def resolve_links(pages: DataFrame) -> DataFrame:
    """Distinct (vault, src, dst): id first, then a unique base name, then a unique alias; no self links."""
    links = wanted_links(pages).withColumn("base", base_name(F.col("key")))
    ids = pages.select("vault", F.lower("page_id").alias("key"), F.col("page_id").alias("by_id")).groupBy("vault", "key").agg(F.max("by_id").alias("by_id"))
    names = _only(pages, F.lower(base_name(F.col("page_id"))), "by_name").withColumnRenamed("key", "base")
    alias = pages.select("vault", "page_id", F.explode("aliases").alias("a")).withColumn("a", F.lower(F.trim("a"))).filter("a <> ''")
    alias = alias.join(ids, (alias["vault"] == ids["vault"]) & (alias["a"] == ids["key"]), "left_anti")
    # Each declaration counts, so an alias that one page declares twice is ambiguous.
    one = alias.groupBy("vault", F.col("a").alias("key")).agg(F.count("*").alias("n"), F.min("page_id").alias("by_alias"))
    out = links.join(ids, ["vault", "key"], "left").join(names, ["vault", "base"], "left").join(one, ["vault", "key"], "left")
    by_base = one.select("vault", F.col("key").alias("base"), F.col("n").alias("n2"), F.col("by_alias").alias("by_base"))
    out = out.join(by_base, ["vault", "base"], "left")
    aliased = F.when(F.col("n").isNotNull(), F.when(F.col("n") == 1, F.col("by_alias"))).otherwise(F.when(F.col("n2") == 1, F.col("by_base")))
    return out.select("vault", "src", F.coalesce("by_id", "by_name", aliased).alias("dst")).filter("dst is not null and dst <> src").distinct()


def dead_links(pages: DataFrame, include_aliases: bool = False, strict: bool = False) -> DataFrame:
    """(vault, src, target) of links that no id and no base name answers. Aliases count as answers only with
    include_aliases; with strict, links that resolve to no single page are told too."""
    links = wanted_links(pages).select("vault", "src", "target", "key", base_name(F.col("key")).alias("base"))
    if strict:
        names = _only(pages, F.lower(base_name(F.col("page_id"))), "page").filter("page is not null").select("vault", F.col("key").alias("base"))
    else:
        names = pages.select("vault", F.lower(base_name(F.col("page_id"))).alias("base")).distinct()
    ids = pages.select("vault", F.lower("page_id").alias("key")).distinct()
    out = links.join(ids, ["vault", "key"], "left_anti").join(names, ["vault", "base"], "left_anti")
    if include_aliases:
        alias = pages.select("vault", F.explode("aliases").alias("key")).select("vault", F.lower(F.trim("key")).alias("key")).distinct()
        out = out.join(alias, ["vault", "key"], "left_anti")
    return out.select("vault", "src", "target")


def backlinks(pages: DataFrame, edges: DataFrame, outgoing: bool = False) -> DataFrame:
    """(vault, page_id, other, title, folder): who links to each page, or whom it links to."""
    own, other = ("src", "dst") if outgoing else ("dst", "src")
    meta = pages.select("vault", F.col("page_id").alias("other"), "title", "folder")
    return edges.select("vault", F.col(own).alias("page_id"), F.col(other).alias("other")).join(meta, ["vault", "other"]).select("vault", "page_id", "other", "title", "folder")


def inbound(edges: DataFrame) -> DataFrame:
    return edges.groupBy("vault", F.col("dst").alias("page_id")).agg(F.count("*").alias("inbound"))


def orphans(pages: DataFrame, edges: DataFrame) -> DataFrame:
    """Pages without any link in or out."""
    linked = edges.select("vault", F.col("src").alias("page_id")).union(edges.select("vault", F.col("dst").alias("page_id"))).distinct()
    return pages.join(linked, ["vault", "page_id"], "left_anti")


def link_graph(pages: DataFrame, edges: DataFrame, folder: str | None = None) -> tuple[DataFrame, DataFrame]:
    """Nodes (degree, inbound, radius, orphan within the selection) and undirected edges (a, b)."""
    nodes = pages if folder is None else pages.filter((F.col("folder") == folder) | F.col("folder").startswith(folder + "/"))
    kept = nodes.select("vault", "page_id")
    e = edges.join(kept.withColumnRenamed("page_id", "src"), ["vault", "src"], "left_semi").join(kept.withColumnRenamed("page_id", "dst"), ["vault", "dst"], "left_semi")
    pairs = e.select("vault", F.least("src", "dst").alias("a"), F.greatest("src", "dst").alias("b")).filter("a <> b").distinct()
    ends = pairs.select("vault", F.explode(F.array("a", "b")).alias("page_id")).groupBy("vault", "page_id").agg(F.count("*").alias("degree"))
    out = nodes.select("vault", "page_id", "title").join(ends, ["vault", "page_id"], "left").join(inbound(edges), ["vault", "page_id"], "left").fillna(0, ["degree", "inbound"])
    radius = F.least(F.lit(3) + F.lit(2.4) * F.sqrt("inbound"), F.lit(15.0))
    return out.withColumn("radius", radius).withColumn("orphan", F.col("degree") == 0), pairs


def allocate_paths(new: DataFrame, existing: DataFrame) -> DataFrame:
    """new (vault, folder, title, ...) with a free rel_path: slug.md, slug-2.md, ... The k-th new page of a slug takes
    the k-th number that is free."""
    slug = slugify(F.col("title"))
    asked = new.withColumn("slug", slug)
    w = Window.partitionBy("vault", "folder", "slug").orderBy("title", *[c for c in ("id",) if c in new.columns])
    asked = asked.withColumn("rank", F.row_number().over(w))
    taken = existing.select("vault", F.regexp_extract("rel_path", r"^(.*?)/?[^/]*$", 1).alias("folder"), F.regexp_extract("rel_path", r"([^/]*)\.md$", 1).alias("name"))
    taken = taken.withColumn("slug", F.regexp_replace("name", r"-([2-9]|[1-9]\d+)$", "")).withColumn("k", F.coalesce(F.nullif(F.regexp_extract("name", r"-([2-9]|[1-9]\d+)$", 1), F.lit("")).cast("int"), F.lit(1)))
    # A name that itself ends in a number is also a taken name of its own slug.
    taken = taken.select("vault", "folder", "slug", "k").union(taken.select("vault", "folder", F.col("name").alias("slug"), F.lit(1).alias("k"))).distinct()
    used = taken.groupBy("vault", "folder", "slug").agg(F.collect_set("k").alias("used"))
    out = asked.join(used, ["vault", "folder", "slug"], "left").withColumn("used", F.coalesce("used", F.array().cast("array<int>")))
    free = F.array_except(F.sequence(F.lit(1), F.col("rank") + F.size("used")), F.col("used"))
    out = out.withColumn("k", F.element_at(free, F.col("rank")))
    name = F.concat("slug", F.when(F.col("k") > 1, F.concat(F.lit("-"), F.col("k").cast("string"))).otherwise(""), F.lit(".md"))
    return out.withColumn("rel_path", F.when(F.col("folder") == "", name).otherwise(F.concat_ws("/", "folder", name))).drop("slug", "rank", "used", "k")


def merge_pages(files: DataFrame, merges: DataFrame) -> DataFrame:
    """files after merges (vault, keep, lose: paths; title: the loser's): the keeper gets the loser's text without frontmatter and
    leading heading; the loser becomes a pointer with its title as an alias."""
    body = F.regexp_replace(F.regexp_replace("text", r"^---\n[\s\S]*?\n---\n?", ""), r"^\s*#\s+.*\n+", "")
    losers = merges.join(files.select("vault", F.col("rel_path").alias("lose"), F.trim(body).alias("lost")), ["vault", "lose"])
    joined = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("lose", "title", "lost"))), lambda x: F.concat(F.lit("\n\n## Merged from "), x["title"], F.lit("\n\n"), x["lost"])), "")
    keepers = losers.groupBy("vault", F.col("keep").alias("rel_path")).agg(joined.alias("more"))
    gone = merges.select("vault", F.col("lose").alias("rel_path"), "keep", F.col("title").alias("lost_title"))
    out = files.join(keepers, ["vault", "rel_path"], "left").join(gone, ["vault", "rel_path"], "left")
    quoted = F.concat(F.lit('"'), F.replace("lost_title", F.lit('"'), F.lit('\\"')), F.lit('"'))
    pointer = F.concat(
        *[F.lit("---\ntitle: "), quoted, F.lit("\nmerged_into: \""), F.col("keep"), F.lit("\"\naliases: ["), quoted, F.lit("]\n---\n\n# "), F.col("lost_title")],
        *[F.lit("\n\nThis page was merged into [["), F.regexp_replace("keep", r"(?i)\.mdx?$", ""), F.lit("]]. Its content lives there now.\n")],
    )
    text = F.when(F.col("keep").isNotNull(), pointer).when(F.col("more").isNotNull(), F.concat(F.regexp_replace("text", r"\s*$", ""), F.col("more"), F.lit("\n"))).otherwise(F.col("text"))
    return out.withColumn("text", text).select(*files.columns)


def set_source(files: DataFrame, sources: DataFrame) -> DataFrame:
    """files with a source line in the frontmatter of those in sources (vault, rel_path, source)."""
    line = F.concat(F.lit('source: "'), F.replace("source", F.lit('"'), F.lit('\\"')), F.lit('"'))
    out = files.join(sources.select("vault", "rel_path", "source"), ["vault", "rel_path"], "left")
    rest = F.expr("substring(text, 5)")
    text = F.when(F.col("source").isNull(), F.col("text")).when(F.col("text").rlike(r"^---\n[\s\S]*?\n---"), F.concat(F.lit("---\n"), line, F.lit("\n"), rest)).otherwise(F.concat(F.lit("---\n"), line, F.lit("\n---\n\n"), F.col("text")))
    return out.withColumn("text", text).select(*files.columns)
