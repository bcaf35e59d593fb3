"""Tables of the knowledge-base jobs derived from the given tables, for Spark and, as SQL, for DuckDB.

Every document is a page of one of three vaults, with links to two other pages and some to pages that do not exist;
events are the usage log and the write journal; conversations are versions."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.text import trimmed
from ..operators.storage import spread

NOW = "2024-02-01 00:00:00"
NOW_S = 1_706_745_600
#: The page that an event reads, and the one that it writes: as many pages as the events ask for, some fifteen or twelve events each.
READ, WRITTEN = "cast(floor(event_id / 15) as bigint)", "cast(floor(event_id / 12) as bigint)"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spread(spark.read.parquet(f"{sf_dir}/{name}.parquet"))


def folder_sql(x: str) -> str:
    return f"('area-' || cast({x} % 4 as string) || '/topic-' || cast({x} % 20 as string))"


def page_sql(x: str) -> str:
    return f"({folder_sql(x)} || '/doc-' || cast({x} as string))"


def vault_sql(x: str) -> str:
    return f"('v' || cast({x} % 3 as string))"


def pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = table(spark, sf_dir, "documents").withColumn("plain", trimmed(F.regexp_replace("text", r"[ \t\n\f\r]+", " "))).withColumn("title", trimmed(F.substring("plain", 1, 40)))
    return d.selectExpr(
        f"{vault_sql('doc_id')} as vault",
        f"{page_sql('doc_id')} as page_id",
        f"{page_sql('doc_id')} || '.md' as rel_path",
        "title",
        f"{folder_sql('doc_id')} as folder",
        "if(doc_id % 7 = 0, cast(array() as array<string>), array(lang, source)) as tags",
        "array('old-' || cast(doc_id as string)) as aliases",
        "concat(array('doc-' || cast(doc_id + 3 as string), 'doc-' || cast((doc_id div 6) * 3 + doc_id % 3 as string)), if(doc_id % 5 = 0, array('missing-' || cast(doc_id as string)), cast(array() as array<string>)), if(doc_id % 11 = 0, array('old-' || cast(doc_id + 6 as string)), cast(array() as array<string>))) as raw_links",
        "case when doc_id % 4 = 0 then '{\"confidence\": \"High\"}' when doc_id % 4 = 1 then '{\"certainty\": 2}' when doc_id % 4 = 2 then '{\"confidence\": [1]}' else '{}' end as frontmatter_json",
        "plain",
        "substring(plain, 1, 240) as excerpt",
        "if(plain = '', 0, size(split(plain, ' '))) as words",
        f"timestamp_seconds({NOW_S} - (doc_id % 400) * 86400 - doc_id % 1000) as mtime",
        "substring(sha1(text), 1, 16) as hash",
        "doc_id",
    )


def ledger(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = table(spark, sf_dir, "documents").filter("(doc_id div 3) % 3 = 0")
    return d.selectExpr(
        f"{vault_sql('doc_id')} as vault",
        f"{page_sql('doc_id')} as page_id",
        "if((doc_id div 3) % 9 = 0, 'changed', substring(sha1(text), 1, 16)) as hash",
        f"timestamp_seconds({NOW_S} - (doc_id % 300) * 86400) as at",
        "'ann' as by",
        "cast(null as string) as note",
    )


def usage(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "events").selectExpr(
        "event_id",
        f"{vault_sql('event_id')} as vault",
        "case event_type when 'view' then 'read' when 'click' then 'search' when 'error' then 'search' when 'purchase' then 'index' else 'health' end as t",
        "cast(ts as timestamp) as at",
        "'agent-' || cast(user_id % 12 as string) as agent",
        f"if(event_type = 'view', {page_sql(READ)}, null) as page",
        "case event_type when 'click' then 'topic' when 'error' then 'Area' || cast(user_id % 20 as string) || ' topic' || cast(user_id as string) end as query",
        "case event_type when 'click' then 1 when 'error' then 0 end as hits",
    )


def journal(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "events").selectExpr(
        f"{vault_sql(WRITTEN)} as vault",
        f"{page_sql(WRITTEN)} || '.md' as rel_path",
        "cast(ts as timestamp) as at",
        "case event_type when 'view' then 'appended' when 'purchase' then 'created' when 'signup' then 'deleted' else 'rewritten' end as kind",
        "cast(floor(value) as bigint) % 50 as lines_added",
        "cast(floor(value) as bigint) % 7 as lines_removed",
    )


def writers(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "events").selectExpr("cast(ts as timestamp) as at", f"'/home/kb/' || {page_sql(WRITTEN)} || '.md' as file", "'agent-' || cast(user_id % 12 as string) as agent", "'edit' as tool")


def versions(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = table(spark, sf_dir, "conversations")
    return c.selectExpr(f"{vault_sql('conv_id')} as vault", "'conv-' || cast(conv_id as string) || '.md' as rel_path", f"timestamp_seconds({NOW_S} - 86400 * 30 + turn * 3600) as at", "substring(sha1(text), 1, 16) as hash", "text", "conv_id", "turn")


def queries(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every twentieth document asks: with its title, or with the second and third word of its text."""
    p = pages(spark, sf_dir).filter("doc_id % 20 = 0")
    return p.selectExpr("cast(doc_id as bigint) as query_id", "if(doc_id % 40 = 0, title, array_join(slice(split(plain, ' '), 2, 2), ' ')) as query")


def quarantine(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "documents").filter("doc_id % 13 = 0").selectExpr(f"{vault_sql('doc_id')} as vault", f"{page_sql('doc_id')} as page_id")


def claims(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pages that each say the size of a type of part."""
    p = table(spark, sf_dir, "part").withColumn("plain", F.expr("'the size of ' || lower(regexp_replace(p_type, '[^A-Za-z ]', ' ')) || ' is ' || cast(p_size as string) || ' units.'"))
    return p.selectExpr("'v0' as vault", "'part/' || cast(p_partkey as string) as page_id", "p_type as title", "plain", "substring(sha1(plain), 1, 16) as hash", f"timestamp_seconds({NOW_S} - p_partkey % 90 * 86400) as mtime")


def vectors(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "embeddings").selectExpr("vec_id", f"{vault_sql('(vec_id div 3)')} as vault", "'page-' || cast(vec_id div 3 as string) as page_id", "cast(vec_id % 3 as int) as chunk_no", "embedding")


#: The same views for DuckDB.
SQL = f"""
with docs as (select *, trim(regexp_replace(text, '\\s+', ' ', 'g')) as plain from documents),
pages as (select {vault_sql('doc_id')} as vault, {page_sql('doc_id')} as page_id, {page_sql('doc_id')} || '.md' as rel_path, trim(substring(plain, 1, 40)) as title,
  {folder_sql('doc_id')} as folder, case when doc_id % 7 = 0 then []::string[] else [lang, source] end as tags, plain, substring(plain, 1, 240) as excerpt,
  case when plain = '' then 0 else len(string_split(plain, ' ')) end as words, {NOW_S} - (doc_id % 400) * 86400 - doc_id % 1000 as mtime,
  substring(sha1(text), 1, 16) as hash, doc_id from docs),
links as (select vault, page_id as src, doc_id, 'doc-' || (doc_id + 3) as target, doc_id + 3 as to_id from pages
  union all select vault, page_id, doc_id, 'doc-' || ((doc_id // 6) * 3 + doc_id % 3), (doc_id // 6) * 3 + doc_id % 3 from pages
  union all select vault, page_id, doc_id, 'missing-' || doc_id, null from pages where doc_id % 5 = 0
  union all select vault, page_id, doc_id, 'old-' || (doc_id + 6), doc_id + 6 from pages where doc_id % 11 = 0),
edges as (select distinct l.vault, l.src, p.page_id as dst from links l join pages p on p.doc_id = l.to_id and p.vault = l.vault where p.page_id <> l.src),
inbound as (select vault, dst as page_id, count(*) as inbound from edges group by all),
ledger as (select {vault_sql('doc_id')} as vault, {page_sql('doc_id')} as page_id, case when (doc_id // 3) % 9 = 0 then 'changed' else substring(sha1(text), 1, 16) end as hash,
  {NOW_S} - (doc_id % 300) * 86400 as at from docs where (doc_id // 3) % 3 = 0),
trusted as (select p.*, case when l.at is null then 'unverified' when l.hash <> p.hash then 'lapsed' when {NOW_S} - l.at > 120 * 86400 then 'aging' else 'verified' end as trust
  from pages p left join ledger l using (vault, page_id)),
usage as (select event_id, {vault_sql('event_id')} as vault, case event_type when 'view' then 'read' when 'click' then 'search' when 'error' then 'search' when 'purchase' then 'index' else 'health' end as t,
  ts as at, 'agent-' || (user_id % 12) as agent, case when event_type = 'view' then {page_sql(READ)} end as page,
  case event_type when 'click' then 'topic' when 'error' then 'Area' || (user_id % 20) || ' topic' || user_id end as query, case event_type when 'click' then 1 when 'error' then 0 end as hits from events),
journal as (select {vault_sql(WRITTEN)} as vault, {page_sql(WRITTEN)} as page_id, {page_sql(WRITTEN)} || '.md' as rel_path, ts as at,
  case event_type when 'view' then 'appended' when 'purchase' then 'created' when 'signup' then 'deleted' else 'rewritten' end as kind,
  floor(value)::bigint % 50 as lines_added, floor(value)::bigint % 7 as lines_removed from events),
writers as (select ts as at, {page_sql(WRITTEN)} || '.md' as rel_path, 'agent-' || (user_id % 12) as agent from events),
versions as (select {vault_sql('conv_id')} as vault, 'conv-' || conv_id || '.md' as rel_path, {NOW_S} - 86400 * 30 + turn * 3600 as at, substring(sha1(text), 1, 16) as hash, text, conv_id, turn from conversations),
queries as (select doc_id as query_id, case when doc_id % 40 = 0 then title else array_to_string(string_split(plain, ' ')[2:3], ' ') end as query from pages where doc_id % 20 = 0),
quarantine as (select {vault_sql('doc_id')} as vault, {page_sql('doc_id')} as page_id from documents where doc_id % 13 = 0)
"""
