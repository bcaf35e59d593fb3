"""Vault folders, ignore files, logs and keyed stores."""

from __future__ import annotations

import re

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.usage import keep_newest

#: Folders that are never part of a vault. Fixed values.
SKIPPED = ("node_modules", ".git", ".obsidian", ".trash", ".next", "dist", "build", ".vercel")
JOURNAL = "vault string, rel_path string, kind string, lines_added int, lines_removed int, hash string, at timestamp"
USAGE = "t string, at timestamp, agent string, vault string, page string, query string, hits int, pages int, tokens int"
ATTRIBUTIONS = "at timestamp, file string, agent string, tool string"
COMMENTS = "vault string, id string, at timestamp, page_id string, rel_path string, by string, body string, anchor string, resolve string"
ACTIVITY = "vault string, at timestamp, kind string, by string, page_id string, rel_path string, detail string"
TREND = "vault string, at timestamp, score int, pages int, dead int, orphans int, stale int"


def read_vault(spark: SparkSession, path: str, vault: str) -> DataFrame:
    """(vault, rel_path, text, mtime) of the markdown files under path. Names that begin with a dot or an underscore are not listed by Spark."""
    raw = spark.read.format("text").option("wholetext", True).option("recursiveFileLookup", True).load(path)
    f = raw.select(F.col("_metadata.file_path").alias("p"), F.col("value").alias("text"), F.col("_metadata.file_modification_time").alias("mtime"))
    root = F.regexp_replace(F.lit(path.rstrip("/")), r"^[a-z]+:/*", "/")
    rel = F.expr("url_decode(p)").substr(F.lit(1), F.lit(1_000_000))
    rel = F.regexp_replace(F.regexp_replace(rel, r"^[a-z]+:/*", "/"), "^/+", "/")
    f = f.withColumn("rel_path", F.substring(rel, F.length(root) + 2, F.lit(1_000_000)))
    names = "|".join(re.escape(n) for n in SKIPPED)
    keep = F.col("rel_path").rlike(r"(?i)\.mdx?$") & ~F.col("rel_path").rlike(rf"(^|/)({names}|\.[^/]*)/")
    return f.filter(keep).select(F.lit(vault).alias("vault"), "rel_path", "text", "mtime")


def ignore_regex(pattern: str) -> str | None:
    """An ignore line as a regular expression; None for blanks and comments."""
    line = pattern.strip()
    if not line or line.startswith("#"):
        return None
    anchored, body = line.startswith("/"), line.strip("/") if line.startswith("/") else line.rstrip("/")
    parts = re.split(r"(\*\*|\*|\?)", body)
    wild = {"**": ".*", "*": "[^/]*", "?": "[^/]"}
    text = "".join(wild.get(p) or re.sub(r"([.+^${}()|\[\]\\])", r"\\\1", p) for p in parts)
    return ("^" if anchored else "(^|/)") + text + "(/|$)"


def apply_ignore(files: DataFrame, patterns: list[str]) -> DataFrame:
    out = files
    for p in patterns:
        if regex := ignore_regex(p):
            out = out.filter(~F.col("rel_path").rlike(regex))
    return out


def read_log(spark: SparkSession, path: str, schema: str, since=None, keep: int | None = None) -> DataFrame:
    """An append-only log of JSON lines; torn lines are skipped."""
    log = spark.read.schema(schema).json(path, mode="DROPMALFORMED").filter("at is not null")
    if since is not None:
        log = log.filter(F.col("at") >= F.lit(since).cast("timestamp"))
    if keep is not None:
        one = log if "vault" in log.columns else log.withColumn("vault", F.lit(""))
        log = keep_newest(one, keep).select(*log.columns)
    return log


def read_store(spark: SparkSession, path: str, value: str, key: str = "page_id", lines: bool = False) -> DataFrame:
    """A JSON object of objects as rows: its keys in a column ``key``. lines: a large store, cut into an object a line."""
    raw = spark.read.text(path, wholetext=not lines)
    return raw.select(F.explode(F.from_json("value", f"map<string,struct<{value}>>")).alias(key, "v")).select(key, "v.*")


def write_index(pages: DataFrame, path: str) -> None:
    """Pages without bodies, a folder for each vault."""
    pages.drop("plain", "frontmatter_json", "raw_links", "body").write.mode("overwrite").partitionBy("vault").parquet(path)
