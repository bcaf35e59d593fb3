"""One query for each operator over the derived tables, with SQL where SQL can say it."""

from __future__ import annotations

import functools
import re
import uuid

from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions.text import DAY, format_tokens, slugify, strip_leading_title, target_path, token_count
from ..operators import analysis, health, ingest, journal, links, mentions, packs, pages, rank, schema, similar, trust, usage, vectors
from ..operators.storage import materialize, shared_folder
from ..sources import files as sources
from . import views as v

QUERIES: dict = {}
ORACLE: dict = {}
AGE = f"floor(({v.NOW_S} - mtime) / {DAY})::bigint"


def query(sql: str | None = None, with_views: bool = True):
    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            # `at` is a word of DuckDB's grammar.
            ORACLE[f.__name__] = re.sub(r"\bat\b", '"at"', (v.SQL if with_views else "") + sql)
        return f

    return add


def edges_of(s, d):
    return materialize(links.resolve_links(v.pages(s, d)))


def trusted(s, d):
    return trust.with_trust(v.pages(s, d), v.ledger(s, d), v.NOW)


def secs(c):
    return F.unix_seconds(c)


# ---- links
@query("select vault, src, dst from edges")
def link_edges(s, d):
    return links.resolve_links(v.pages(s, d))


@query("select vault, src, target from links l where target like 'missing-%' or target like 'old-%' or not exists (select 1 from pages p where p.vault = l.vault and p.doc_id = l.to_id)")
def dead_links(s, d):
    return links.dead_links(v.pages(s, d)).distinct()


@query("select e.vault, e.dst as page_id, e.src as other, p.title, p.folder from edges e join pages p on p.vault = e.vault and p.page_id = e.src")
def backlinks(s, d):
    return links.backlinks(v.pages(s, d), edges_of(s, d))


@query("select e.vault, e.src as page_id, e.dst as other, p.title, p.folder from edges e join pages p on p.vault = e.vault and p.page_id = e.dst")
def outgoing_links(s, d):
    return links.backlinks(v.pages(s, d), edges_of(s, d), outgoing=True)


@query("select vault, page_id from pages p where doc_id % 2 = 0 and not exists (select 1 from edges e where e.vault = p.vault and e.src = p.page_id and e.src not in (select page_id from quarantine)) and not exists (select 1 from edges e where e.vault = p.vault and e.dst = p.page_id and e.src not in (select page_id from quarantine))".replace("doc_id % 2 = 0 and ", ""))
def orphan_pages(s, d):
    q = v.quarantine(s, d).withColumnRenamed("page_id", "src")
    return links.orphans(v.pages(s, d), edges_of(s, d).join(q, ["vault", "src"], "left_anti")).select("vault", "page_id")


@query("""
, sel as (select * from pages where folder = 'area-1' or folder like 'area-1/%'),
pr as (select distinct vault, least(src, dst) as a, greatest(src, dst) as b from edges where src in (select page_id from sel) and dst in (select page_id from sel)),
dg as (select vault, page_id, count(*) as degree from (select vault, a as page_id from pr union all select vault, b from pr) group by all)
select s.vault, s.page_id, coalesce(degree, 0) as degree, coalesce(inbound, 0) as inbound, round(least(3 + 2.4::double * sqrt(coalesce(inbound, 0)), 15.0::double), 6) as radius, coalesce(degree, 0) = 0 as orphan
from sel s left join dg using (vault, page_id) left join inbound using (vault, page_id)""")
def graph_nodes(s, d):
    nodes, _ = links.link_graph(v.pages(s, d), edges_of(s, d), "area-1")
    return nodes.drop("title").withColumn("radius", F.round("radius", 6))


@query("select distinct vault, least(src, dst) as a, greatest(src, dst) as b from edges")
def graph_edges(s, d):
    return links.link_graph(v.pages(s, d), edges_of(s, d))[1]


@query("""
, n as (select vault, page_id, folder, 'note ' || (doc_id % 5) as title, doc_id as id, 'note-' || (doc_id % 5) as slug, row_number() over (partition by vault, folder, doc_id % 5 order by doc_id) as k from pages where doc_id % 6 < 3)
select vault, folder, title, id, folder || '/' || slug || '-' || (k + 1) || '.md' as rel_path from n""")
def free_paths(s, d):
    p = v.pages(s, d)
    new = p.filter("doc_id % 6 < 3").select("vault", "folder", F.expr("'note ' || cast(doc_id % 5 as string)").alias("title"), F.col("doc_id").alias("id"))
    taken = p.select("vault", F.expr("folder || '/note-' || cast(doc_id % 5 as string) || '.md'").alias("rel_path")).distinct()
    every = new.select("vault", "folder", "title").distinct().select("vault", F.expr("folder || '/' || replace(title, ' ', '-') || '.md'").alias("rel_path"))
    return links.allocate_paths(new, taken.union(every).distinct())


# ---- trust
@query("select vault, page_id, trust from trusted")
def page_trust(s, d):
    return trusted(s, d).select("vault", "page_id", "trust")


@query(f"""select vault, count(*) as pages, count(*) filter (trust = 'verified') as verified, count(*) filter (trust = 'aging') as aging, count(*) filter (trust = 'lapsed') as lapsed,
count(*) filter (trust = 'unverified') as unverified, floor((count(*) filter (trust in ('verified', 'aging'))) * 100 / count(*) + 0.5)::bigint as checked_pct from trusted group by vault""")
def trust_split(s, d):
    return trust.trust_split(trusted(s, d))


@query(f"select l.vault, l.page_id, p.title, floor(120 - ({v.NOW_S} - l.at) / {DAY} + 0.5)::bigint as in_days from ledger l join pages p using (vault, page_id) where floor(120 - ({v.NOW_S} - l.at) / {DAY} + 0.5) <= 60")
def sign_off_forecast(s, d):
    return trust.forecast(v.ledger(s, d), v.pages(s, d), v.NOW)


@query("""
, led as (select vault, case when hash <> 'changed' and (select count(*) from docs) >= 0 then page_id || '-moved' else page_id end as page_id, hash from ledger),
orphan as (select l.*, row_number() over (partition by vault, hash order by page_id) as k from led l where not exists (select 1 from pages p where p.vault = l.vault and p.page_id = l.page_id)),
home as (select vault, hash, min(page_id) as to_id from pages p where not exists (select 1 from led l where l.vault = p.vault and l.page_id = p.page_id) group by all having count(*) = 1)
select l.vault, coalesce(h.to_id, l.page_id) as page_id, l.hash from led l left join orphan o on o.vault = l.vault and o.page_id = l.page_id and o.k = 1 left join home h on h.vault = o.vault and h.hash = o.hash""")
def reconciled_renames(s, d):
    led = v.ledger(s, d).withColumn("page_id", F.expr("if(hash <> 'changed', page_id || '-moved', page_id)"))
    return trust.reconcile_renames(led, v.pages(s, d)).select("vault", "page_id", "hash")


RULE = "case when regexp_matches(lower(page_id || ' ' || title), 'topic-1$|thing') then 0 when contains(lower(page_id || ' ' || title), 'area-2') then 1 else 2 end"
RULES = (("/topic-1\\b|thing/", 30, "a"), ("area-2", 60, "b"))


@query(f"""
, r as (select vault, case when regexp_matches(lower(page_id || ' ' || title), 'topic-1\\b|thing') then 0 when contains(lower(page_id || ' ' || title), 'area-2') then 1 else 2 end as ord from pages)
select k.vault, k.ord, k.label, (select count(*) from r where r.vault = k.vault and r.ord = k.ord) as pages
from (select distinct vault, ord, label from pages, (values (0, 'a'), (1, 'b'), (2, 'default')) t(ord, label)) k""")
def policy_coverage(s, d):
    return trust.policy_coverage(v.pages(s, d), RULES)


@query("select vault, count(*) filter (page_id in (select page_id from quarantine)) as withheld, count(*) filter (page_id not in (select page_id from quarantine)) as shown from pages group by vault")
def quarantine_counts(s, d):
    return trust.withheld(v.pages(s, d), v.quarantine(s, d))


@query("select vault, page_id from pages where doc_id % 13 <> 0")
def shown_pages(s, d):
    return trust.without_quarantined(v.pages(s, d), v.quarantine(s, d)).select("vault", "page_id")


AGENTS = [("v0", "a1", "reader", ["area-0/topic-0", "area-2"], None), ("v1", "a2", "writer", [], None), ("v1", "a3", "admin", ["area-1"], "2024-01-01 00:00:00"), ("v2", "a4", "admin", ["area-3/topic-7"], None)]


def agents(s):
    return s.createDataFrame(AGENTS, "vault string, agent_id string, role string, scopes array<string>, revoked_at string")


@query("""select vault, 'a1' as agent_id, page_id from pages where vault = 'v0' and (page_id like 'area-0/topic-0/%' or page_id like 'area-2/%')
union all select vault, 'a2', page_id from pages where vault = 'v1' union all select vault, 'a4', page_id from pages where vault = 'v2' and page_id like 'area-3/topic-7/%'""")
def agent_scope(s, d):
    return trust.in_scope(v.pages(s, d), agents(s))


@query("select vault, page_id, case (doc_id % 3) when 1 then 'a2' when 2 then 'a4' end as agent_id from pages where doc_id % 3 <> 0")
def writable_pages(s, d):
    return v.pages(s, d).join(trust.with_capability(agents(s), "write"), "vault").select("vault", "page_id", "agent_id")


# ---- health
STALE = """case when regexp_matches(lower(page_id || ' ' || title), 'pricing|cost|rate|invoice') then 30 when regexp_matches(lower(page_id || ' ' || title), 'tool|stack|version|setup|install|config') then 90
when regexp_matches(lower(page_id || ' ' || title), 'client|project|status|roadmap') then 60 else 180 end"""
HEALTH = f"""
, o as (select vault, count(*) as orphans from pages p where not exists (select 1 from edges e where e.vault = p.vault and (e.src = p.page_id)) and not exists (select 1 from edges e where e.vault = p.vault and e.dst = p.page_id) group by vault),
dl as (select vault, count(*) as dead from (select distinct vault, src, target from links l where target like 'missing-%' or target like 'old-%' or not exists (select 1 from pages p where p.vault = l.vault and p.doc_id = l.to_id)) group by vault),
st as (select vault, count(*) as stale from pages where {AGE} > {STALE} group by vault),
t as (select vault, count(*) as pages, sum(words)::bigint as words, count(*) filter (len(tags) = 0) as untagged from pages group by vault),
h as (select vault, pages, words, untagged, coalesce(orphans, 0) as orphans, coalesce(dead, 0) as dead, coalesce(stale, 0) as stale from t left join o using (vault) left join dl using (vault) left join st using (vault))
"""


@query(HEALTH + "select *, greatest(0, floor(100 - (orphans / pages * 35 + least(dead / pages, 1.0) * 30 + stale / pages * 20 + untagged / pages * 15) + 0.5))::bigint as score from h")
def vault_health(s, d):
    return health.health(v.pages(s, d), edges_of(s, d), v.NOW)


@query(HEALTH + "select vault, unnest(list_filter([case when dead > 10 then 'dead' end, case when stale > 1000000 then 'stale' end], lambda x: x is not null)) as breach from h")
def health_gate(s, d):
    return health.health_gate(health.health(v.pages(s, d), edges_of(s, d), v.NOW), max_dead=10, max_stale=1_000_000)


@query(f"select vault, page_id, {AGE} as days from pages where {AGE} > {STALE}")
def stale_pages(s, d):
    return health.stale_pages(v.pages(s, d), v.NOW).select("vault", "page_id", "days")


@query("""
, p as (select vault, at, score, date_trunc('day', at) as day from (select 'v' || (event_id % 3) as vault, ts as at, floor(value)::bigint % 100 as score from events)),
f as (select *, row_number() over (partition by vault, day order by at, score) as k from p),
l as (select *, row_number() over (partition by vault order by day desc) as r from f where k = 1)
select vault, count(*) as points, case when count(*) > 1 then arg_max(score, at) - arg_min(score, at) end as change from l where r <= 20 group by vault""")
def health_trend(s, d):
    e = v.table(s, d, "events").selectExpr("'v' || cast(event_id % 3 as string) as vault", "cast(ts as timestamp) as at", "cast(floor(value) as bigint) % 100 as score")
    return health.trend(e, keep=20)[1]


@query("select vault, tag, count(*) as count from (select vault, unnest(tags) as tag from pages) group by all")
def tag_counts(s, d):
    return health.tag_counts(v.pages(s, d))


@query("select vault, folder, count(*) as count from pages group by all")
def folder_counts(s, d):
    return health.folder_counts(v.pages(s, d))


@query("""
, x as (select vault, folder as path, count(*) as n, true as own from pages group by all union all select vault, split_part(folder, '/', 1), count(*), false from pages group by all)
select vault, path, split_part(path, '/', -1) as name, (len(string_split(path, '/')) - 1)::int as depth, sum(case when own then n else 0 end)::bigint as count, sum(n)::bigint as total from x group by vault, path""")
def folder_tree(s, d):
    return health.folder_tree(v.pages(s, d))


TOK = "ceil(len(plain) / 4)::bigint"


@query(f"""
, f as (select vault, folder, count(*) as pages, sum({TOK})::bigint as tokens from pages group by all)
select *, round(tokens / sum(tokens) over (partition by vault), 9) as share, tokens <= 200000 as fits from f""")
def budget_folders(s, d):
    return health.token_budget(v.pages(s, d))[0].withColumn("share", F.round("share", 9))


@query(f"select vault, folder, page_id, {TOK} as tokens, row_number() over (partition by vault, folder order by {TOK} desc, page_id)::int as rank from pages qualify rank <= 5")
def budget_heaviest(s, d):
    return health.token_budget(v.pages(s, d))[1].select("vault", "folder", "page_id", "tokens", "rank")


@query(f"""
, t as (select vault, page_id, {TOK} as tokens, avg({TOK}) over (partition by vault) as mean from pages)
select vault, page_id, tokens, row_number() over (partition by vault order by tokens desc, page_id)::int as rank from t where tokens > greatest(mean * 6, 2000) qualify rank <= 20""")
def budget_outliers(s, d):
    return health.token_budget(v.pages(s, d))[2].select("vault", "page_id", "tokens", "rank")


@query(f"""
, c as (select vault, page_id from pages except select vault, page from usage where t = 'read')
select vault, count(*) as pages, sum({TOK})::bigint as tokens, sum(case when trust = 'verified' then {TOK} else 0 end)::bigint as verified_tokens,
sum(case when (vault, page_id) in (select (vault, page_id) from c) then {TOK} else 0 end)::bigint as cold_tokens, ceil(sum({TOK}) / 200000)::bigint as windows, greatest(0, sum({TOK}) - 8000)::bigint as saved_per_question
from trusted group by vault""")
def corpus_value(s, d):
    return health.corpus_value(trusted(s, d), usage.cold_pages(v.pages(s, d), v.usage(s, d)))


@query(f"""
, fl as (select p.vault, p.page_id, p.folder, p.tags, (select count(*) from edges e where e.vault = p.vault and (e.src = p.page_id or e.dst = p.page_id)) as n, {AGE} > 180 as old from pages p),
st as (select *, list_filter([case when n = 0 then 'orphan' end, case when len(tags) = 0 then 'untagged' end, case when old then 'stale180' end, case when n > 0 then 'has_links' end], lambda x: x is not null) as status from fl)
select vault, 'folder' as facet, folder as value, count(*) as count from st where list_has_any(tags, ['fr', 'de']) and list_has_any(status, ['stale180']) group by all
union all select vault, 'tag', t, count(*) from (select vault, unnest(tags) as t from st where folder in ('area-1/topic-1', 'area-2/topic-2') and list_has_any(status, ['stale180'])) group by all
union all select vault, 'status', x, count(*) from (select vault, unnest(status) as x from st where folder in ('area-1/topic-1', 'area-2/topic-2') and list_has_any(tags, ['fr', 'de'])) group by all""")
def explorer_facets(s, d):
    rows = health.page_status(v.pages(s, d), edges_of(s, d), v.NOW)
    return health.facets(rows, folders=["area-1/topic-1", "area-2/topic-2"], tags=["fr", "de"], statuses=["stale180"])


@query("select p.vault, p.page_id, coalesce(inbound, 0) as inbound, row_number() over (partition by p.vault order by coalesce(inbound, 0) desc, p.page_id)::int as rank from pages p left join inbound using (vault, page_id) qualify rank <= 200")
def explorer_top(s, d):
    return health.explorer(v.pages(s, d), links.inbound(edges_of(s, d)), "backlinks").select("vault", "page_id", "inbound", "rank")


@query(f"select vault, max(mtime) as newest, min(mtime) as oldest, floor(({v.NOW_S} - max(mtime)) / {DAY})::bigint as quiet_days, count(*) >= 3 and max(mtime) - min(mtime) <= 300 as clone from pages group by vault")
def corpus_pulse(s, d):
    return health.pulse(v.pages(s, d), v.NOW).withColumn("newest", secs("newest")).withColumn("oldest", secs("oldest"))


@query(f"""
, b as (select vault, folder, date_trunc('week', make_timestamp(mtime * 1000000)) as w from pages),
r as (select vault, case when w >= timestamp '2024-01-29' - interval 175 days then w end as bucket, folder, count(*) as count from b group by all)
select vault, epoch(bucket)::bigint as bucket, folder, count from r
union all select vault, epoch(g)::bigint, null, 0 from (select distinct vault from pages), (select unnest(generate_series(timestamp '2024-01-29' - interval 175 days, timestamp '2024-01-29', interval 7 days)) as g)
where not exists (select 1 from r where r.vault = pages.vault and r.bucket = g)""".replace("(select distinct vault from pages), (select", "(select distinct vault from pages) pages, (select"))
def edit_timeline(s, d):
    return health.timeline(v.pages(s, d), v.NOW).withColumn("bucket", secs("bucket"))


@query(f"select vault, folder, floor(({v.NOW_S} - max(mtime)) / {DAY})::bigint as days from pages group by all")
def folder_rot(s, d):
    return health.folder_rot(v.pages(s, d), v.NOW)


@query("""
, f as (select vault, folder, count(*) as pages, sum(greatest(words, 1))::bigint as words from pages group by all)
select *, round(words / sum(words) over (partition by vault), 9) as share, words = max(words) over (partition by vault) as largest from f""")
def folder_share(s, d):
    return health.folder_share(v.pages(s, d)).withColumn("share", F.round("share", 9))


@query("""select vault, folder, page_id, (row_number() over (partition by vault, folder order by mtime desc, page_id) - 1)::int as position, count(*) over (partition by vault, folder) as total,
count(*) over (partition by vault, folder) > 10 as has_more from pages qualify position between 3 and 9""")
def folder_page(s, d):
    return health.folder_pages(v.pages(s, d), offset=3, limit=7).select("vault", "folder", "page_id", "position", "total", "has_more")


@query("select vault, page_id from pages where contains(lower(title), 'th') or contains(lower(rel_path), 'th') qualify row_number() over (partition by vault order by page_id) <= 60")
def page_filter(s, d):
    return health.page_filter(v.pages(s, d), contains="th").select("vault", "page_id")


@query("""
, l as (select vault, folder, page_id, '- `' || rel_path || '` — **' || title || '**' || case when len(tags) > 0 then ' — tags: ' || array_to_string(list_transform(tags, lambda t: '#' || t), ' ') else '' end
 || case when excerpt <> '' then ' — ' || substring(excerpt, 1, 120) else '' end as line from pages),
tc as (select vault, tag, count(*) as c from (select vault, unnest(tags) as tag from pages) group by all)
select vault, 0 as part, '' as folder, '' as item, '# ' || vault || ' — wiki index: ' || count(*) || ' pages. Read this map first, then open only the pages you need.' as line from pages group by vault
union all select distinct vault, 1, folder, '', '## ' || folder from pages union all select vault, 1, folder, page_id, line from l
union all select vault, 2, '', tag, '#' || tag || ' (' || c || ')' from tc""")
def agent_map(s, d):
    return health.agent_map(v.pages(s, d))


# ---- usage
RECENT = f"(select * from usage where at >= make_timestamp({(v.NOW_S - 20 * DAY) * 1_000_000}))"


def recent(s, d):
    return usage.recent(v.usage(s, d), v.NOW, 20)


@query(f"""select vault, count(*) filter (t = 'read') as reads, count(*) filter (t = 'search') as searches, count(*) filter (t = 'search' and hits = 0) as misses,
round((count(*) filter (t = 'search' and hits = 0)) / (count(*) filter (t = 'search')), 9) as miss_rate from {RECENT} group by vault""")
def usage_totals(s, d):
    return usage.usage_totals(recent(s, d)).withColumn("miss_rate", F.round("miss_rate", 9))


@query(f"select vault, page, count(*) as reads, floor(epoch(max(at)))::bigint as last_read, count(distinct agent) as agents from {RECENT} where t = 'read' group by all")
def hot_pages(s, d):
    return usage.hot_pages(recent(s, d)).withColumn("last_read", secs("last_read"))


@query(f"select vault, lower(trim(query)) as gap, count(*) as misses, floor(epoch(max(at)))::bigint as last_asked, count(distinct agent) as agents from {RECENT} where t = 'search' and hits = 0 group by all")
def search_gaps(s, d):
    return usage.gaps(recent(s, d)).withColumn("last_asked", secs("last_asked"))


@query(f"select vault, at::date as day, count(*) filter (t = 'read') as reads, count(*) filter (t = 'search') as searches from {RECENT} where t in ('read', 'search') group by all")
def daily_usage(s, d):
    return usage.daily(recent(s, d))


@query(f"select vault, agent, count(*) as events from {RECENT} group by all")
def agent_events(s, d):
    return usage.agent_events(recent(s, d))


@query("""select vault, agent, count(*) filter (t = 'read') as reads, count(*) filter (t = 'search') as searches, count(*) filter (t = 'search' and hits = 0) as misses, count(distinct page) as pages_touched,
floor(epoch(max(at)))::bigint as last_seen, case when count(*) filter (t = 'search') > 0 then floor((count(*) filter (t = 'search' and hits = 0)) * 100 / (count(*) filter (t = 'search')) + 0.5)::bigint else 0 end as miss_rate from usage group by all""")
def agent_scorecard(s, d):
    return usage.score_agents(v.usage(s, d)).withColumn("last_seen", secs("last_seen"))


@query("select vault, page_id from pages p where not exists (select 1 from usage u where u.vault = p.vault and u.t = 'read' and u.page = p.page_id)")
def cold_pages(s, d):
    return usage.cold_pages(v.pages(s, d), v.usage(s, d)).select("vault", "page_id")


@query("select vault, event_id from usage qualify row_number() over (partition by vault order by at desc, event_id desc) <= 1000")
def newest_events(s, d):
    return usage.keep_newest(v.usage(s, d), 1000).select("vault", "event_id")


@query()
def gap_clusters(s, d):
    return usage.cluster_gaps(v.usage(s, d)).withColumn("last_asked", secs("last_asked"))


# ---- journal
TRI = f"""
, c as (select vault, page_id, rel_path, max(lines_removed) as lines_removed, max(lines_added) as lines_added, max(at) as at, arg_max(kind, (at, kind)) as kind from journal group by vault, page_id, rel_path),
r as (select c.*, t.trust, coalesce(i.inbound, 0) as inbound from c join trusted t using (vault, page_id) left join inbound i using (vault, page_id)),
sc as (select *, floor(lines_removed * 3 + lines_added * 0.2::double + log2(inbound + 1) * 8 + case trust when 'lapsed' then 25 when 'unverified' then 10 else 0 end + case when kind = 'rewritten' then 12 else 0 end + 0.5)::bigint as score,
 concat_ws(' · ', case when lines_removed > 0 then lines_removed || ' lines removed' end, case when inbound >= 5 then inbound || ' pages link here' end, case when trust = 'lapsed' then 'you had verified this' end) as base from r)
"""


@query(TRI + "select vault, page_id, kind, trust, inbound, lines_removed, lines_added, score, case when base <> '' then base when kind = 'rewritten' then 'rewritten in place' else lines_added || ' lines added' end as why, row_number() over (partition by vault order by score desc, page_id)::int as rank from sc qualify rank <= 12")
def triage(s, d):
    out = journal.triage(v.journal(s, d), v.pages(s, d), links.inbound(edges_of(s, d)), v.ledger(s, d), v.NOW)
    return out.select("vault", "page_id", "kind", "trust", "inbound", "lines_removed", "lines_added", "score", "why", "rank")


@query("select i.vault, i.page_id, i.inbound, t.title, t.trust, row_number() over (partition by i.vault order by i.inbound desc, i.page_id)::int as rank from inbound i join trusted t using (vault, page_id) qualify rank <= 10")
def hub_pages(s, d):
    return journal.hubs(links.inbound(edges_of(s, d)), v.pages(s, d), v.ledger(s, d), v.NOW)


@query("""
, j as (select * from journal where at >= timestamp '2024-01-20' and at < timestamp '2024-02-01' and page_id not in (select page_id from quarantine)),
g as (select vault, page_id, rel_path, list_sort(list(distinct kind)) as kinds, sum(lines_added)::bigint as lines_added, sum(lines_removed)::bigint as lines_removed, max(at) as last_at from j group by vault, page_id, rel_path),
w as (select rel_path, arg_max(agent, (at, agent)) as agent from writers group by rel_path)
select g.vault, g.page_id, array_to_string(kinds, ',') as kinds, lines_added, lines_removed, floor(epoch(last_at))::bigint as last_at, coalesce(trust, 'unverified') as trust, t.page_id is null as gone, w.agent from g left join trusted t using (vault, page_id) left join w on w.rel_path = g.rel_path""")
def recent_changes(s, d):
    w = journal.attribution_by_path(v.writers(s, d), "/home/kb")
    out = journal.changes(v.journal(s, d), v.pages(s, d), v.ledger(s, d), w, v.quarantine(s, d), "2024-01-20", v.NOW)
    return out.select("vault", "page_id", F.array_join("kinds", ",").alias("kinds"), "lines_added", "lines_removed", secs("last_at").alias("last_at"), "trust", "gone", "agent")


@query("select rel_path, arg_max(agent, (at, agent)) as agent, floor(epoch(max(at)))::bigint as at from writers group by rel_path")
def last_writers(s, d):
    return journal.attribution_by_path(v.writers(s, d), "/home/kb/").select("rel_path", "agent", secs("at").alias("at"))


@query("""
, l as (select *, lag(hash) over (partition by vault, rel_path order by at) as before from versions), k as (select *, row_number() over (partition by vault, rel_path order by at desc) as r from l where before is null or before <> hash)
select vault, rel_path, at, hash from k where r <= 2""")
def kept_versions(s, d):
    return journal.retain_versions(v.versions(s, d), 2).select("vault", "rel_path", secs("at").alias("at"), "hash")


AT = v.NOW_S - DAY * 30 + 3600


@query(f"select vault, rel_path, min(at) as at, arg_min(text, at) as text from versions where at > {AT} group by all")
def point_in_time(s, d):
    return journal.version_at(v.versions(s, d), "2024-01-02 01:00:00").withColumn("at", secs("at"))


@query("""
, q as (select conv_id as query_id, lower(trim(substring(text, 1, 12))) as n from versions where conv_id % 20 = 0 and turn = 0),
h as (select q.query_id, x.vault, x.rel_path, x.at, substring(trim(list_filter(string_split(x.text, chr(10)), lambda l: contains(lower(l), q.n))[1]), 1, 240) as line
 from versions x join q on contains(lower(x.text), q.n) where length(q.n) >= 3)
select *, row_number() over (partition by query_id order by at desc, vault, rel_path)::int as rank from h qualify rank <= 40""")
def history_search(s, d):
    x = v.versions(s, d)
    q = x.filter("conv_id % 20 = 0 and turn = 0").select(F.col("conv_id").alias("query_id"), F.substring("text", 1, 12).alias("query"))
    return journal.search_history(x, q).withColumn("at", secs("at"))


@query("""
, l as (select *, lag(text) over (partition by vault, rel_path order by at) as before from versions)
select vault, rel_path, at, case when before is null then 'created' when starts_with(text, before || chr(10)) then 'appended' else 'rewritten' end as kind, hash from l where before is null or before <> text""")
def write_journal(s, d):
    return journal.classify_writes(v.versions(s, d)).select("vault", "rel_path", secs("at").alias("at"), "kind", "hash")


@query("""
, o as (select vault, rel_path, text from versions where turn = 0), n as (select vault, rel_path, text from versions where turn = 1)
select n.vault, n.rel_path, case when o.text is null then 'created' when starts_with(n.text, o.text || chr(10)) then 'appended' else 'rewritten' end as kind from n left join o using (vault, rel_path) where o.text is distinct from n.text""")
def reconcile_sweep(s, d):
    x = v.versions(s, d)
    return journal.reconcile(x.filter("turn = 1"), x.filter("turn = 0"), v.NOW).select("vault", "rel_path", "kind")


@query("""
, c as (select 'v' || (event_id % 3) as vault, event_id, ts as at, event_id // 10 as id, event_type = 'error' as mark from events),
o as (select vault, event_id, id, at from c where not mark and event_id % 10 < 5),
m as (select id, vault, at from c where mark)
select o.vault, o.event_id, (select floor(epoch(max(m.at)))::bigint from m where m.vault = o.vault and m.id = o.id and m.at >= o.at) as resolved_at from o""")
def comment_fold(s, d):
    e = v.table(s, d, "events").selectExpr("'v' || cast(event_id % 3 as string) as vault", "event_id", "cast(event_id as string) as id", "cast(ts as timestamp) as at", "event_type", "event_id div 10 as thread")
    comments = e.filter("event_type <> 'error' and event_id % 10 < 5")
    marks = e.filter("event_type = 'error'").join(comments.select("vault", "thread", F.col("id").alias("resolve")), ["vault", "thread"])
    log = comments.select("vault", "id", "at", "event_id", F.lit(None).cast("string").alias("resolve")).unionByName(marks.select("vault", "id", "at", "event_id", "resolve"))
    return journal.fold_comments(log).select("vault", "event_id", secs("resolved_at").alias("resolved_at"))


@query("""select vault, kind, page_id, floor(epoch(at))::bigint as at, row_number() over (partition by vault order by at desc, page_id, kind)::int as rank from journal where at >= timestamp '2024-01-10' and kind = 'rewritten' qualify rank <= 50""")
def activity_feed(s, d):
    a = v.journal(s, d).withColumn("page_id", F.regexp_replace("rel_path", "[.]md$", ""))
    return journal.activity_feed(a, "rewritten", "2024-01-10").select("vault", "kind", "page_id", secs("at").alias("at"), "rank")


@query("""
, cur as (select vault, rel_path, arg_max(text, at) as text from versions group by all),
ln as (select vault, rel_path, unnest(range(1, len(string_split(text, chr(10))) + 1)) as line, unnest(string_split(text, chr(10))) as text from cur),
o as (select vault, rel_path, min(at) as oldest from versions group by all),
f as (select l.vault, l.rel_path, l.line, min(x.at) as found from ln l join versions x on x.vault = l.vault and x.rel_path = l.rel_path and contains(x.text, l.text) group by all)
select l.vault, l.rel_path, l.line::int as line, l.text, case when trim(l.text) = '' or f.found = o.oldest then null else coalesce(f.found, o.oldest) end as at
from ln l left join f using (vault, rel_path, line) left join o using (vault, rel_path)""")
def line_blame(s, d):
    x = v.versions(s, d)
    now = x.groupBy("vault", "rel_path").agg(F.max_by("text", "at").alias("text"))
    w = x.selectExpr("at", "'/home/kb/' || rel_path as file", "'agent-' || cast(turn as string) as agent")
    return journal.blame(now, x, w).select("vault", "rel_path", "line", "text", secs("at").alias("at"))


# ---- ranking
BM = f"""
, tx as (select vault, page_id, regexp_extract_all(lower(title || ' ' || title || ' ' || title || ' ' || array_to_string(tags, ' ') || ' ' || plain), '[a-z0-9][a-z0-9''-]*') as w from pages),
ln as (select vault, page_id, len(w) as length from tx),
po as (select vault, page_id, term, count(*) as tf from (select vault, page_id, unnest(w) as term from tx) group by all),
qt as (select query_id, unnest(list_distinct(regexp_extract_all(lower(query), '[a-z0-9][a-z0-9''-]*'))) as term from queries),
dfs as (select vault, term, count(*) as df from po group by all),
sts as (select vault, count(*) as n, avg(length) as mean from ln group by vault),
bm as (select q.query_id, p.vault, p.page_id, sum(ln(1 + (n - df + 0.5) / (df + 0.5)) * (tf * 2.4::double / (tf + 1.4::double * (1 - 0.72::double + 0.72::double * length / mean)))) as bm25
 from qt q join po p using (term) join dfs d on d.vault = p.vault and d.term = p.term join sts s on s.vault = p.vault join ln l on l.vault = p.vault and l.page_id = p.page_id group by q.query_id, p.vault, p.page_id)
"""
PR = """
, nn as (select vault, page_id, count(*) over (partition by vault) as n from pages),
dg as (select vault, src, count(*) as degree from edges group by all),
r0 as materialized (select vault, page_id, n, 1.0::double / n as rank from nn)""" + "".join(
    f""",
r{i + 1} as materialized (select k.vault, k.page_id, k.n, 0.15::double / k.n + 0.85::double * coalesce(f.inflow, 0.0) as rank from nn k left join
 (select e.vault, e.dst as page_id, sum(r.rank / g.degree) as inflow from edges e join dg g on g.vault = e.vault and g.src = e.src join r{i} r on r.vault = e.vault and r.page_id = e.src group by all) f using (vault, page_id))"""
    for i in range(20)
) + """,
au as (select vault, page_id, rank / max(rank) over (partition by vault) as rank from r20)
"""


@query("select vault, page_id, term, tf from po".join([BM, ""]))
def term_postings(s, d):
    return rank.inverted_index(v.pages(s, d))[0]


@query(BM + "select query_id, vault, page_id, round(bm25, 6) as bm25 from bm")
def bm25_scores(s, d):
    return rank.bm25_over(v.queries(s, d), v.pages(s, d)).withColumn("bm25", F.round("bm25", 6)).withColumn("query_id", F.col("query_id").cast("int"))


@query(PR + "select vault, page_id, round(rank, 6) as rank from au")
def link_authority(s, d):
    return rank.authority(v.pages(s, d), edges_of(s, d)).withColumn("rank", F.round("rank", 6))


SEARCH = BM + PR + """
, lit as (select q.query_id, p.vault, p.page_id, case when lower(title) = q.q then 100 when starts_with(lower(title), q.q) then 60 when contains(lower(title), q.q) then 40 else 0 end + case when contains(lower(page_id), q.q) then 15 else 0 end
 + case when len(list_filter(tags, lambda t: contains(lower(t), q.q))) > 0 then 25 else 0 end + case when contains(lower(plain), q.q) then 10 else 0 end as literal from pages p, (select query_id, lower(trim(query)) as q from queries) q),
ss as (select coalesce(l.query_id, b.query_id) as query_id, p.vault, p.page_id, p.mtime, (coalesce(literal, 0) + least(coalesce(bm25, 0.0) * 3, 35.0)) * (1 + 0.18::double * coalesce(a.rank, 0.0)) as score
 from lit l left join bm b using (query_id, vault, page_id) join pages p using (vault, page_id) left join au a using (vault, page_id))
"""


def _search(s, d, limit):
    p = materialize(v.pages(s, d))
    return rank.search_over(v.queries(s, d), p, rank.authority(p, links.resolve_links(p)), limit)


@query(SEARCH + "select query_id, vault, page_id, round(score, 5) as score, row_number() over (partition by query_id, vault order by round(score, 9) desc, mtime desc, page_id)::int as rank from ss where score > 0 qualify rank <= 10")
def search_top10(s, d):
    return _search(s, d, 10).withColumn("score", F.round("score", 5)).withColumn("query_id", F.col("query_id").cast("int"))


@query()
def search_snippets(s, d):
    return rank.snippets(_search(s, d, 5), v.pages(s, d), v.queries(s, d))


@query("select q.query_id, p.vault, p.page_id, row_number() over (partition by q.query_id, p.vault order by p.page_id)::int as rank from pages p join queries q on contains(lower(title), lower(q.query)) or contains(lower(plain), lower(q.query)) qualify rank <= 25")
def simple_search(s, d):
    return rank.simple_search(v.queries(s, d), materialize(v.pages(s, d))).drop("title").withColumn("query_id", F.col("query_id").cast("int"))


VEC = f"""
with vc as (select {v.vault_sql('(vec_id // 3)')} as vault, 'page-' || (vec_id // 3) as page_id, vec_id, embedding from embeddings),
sc as (select a.query_id, b.vault, b.page_id, max(list_dot_product(a.embedding::double[], b.embedding::double[])) as score from (select vec_id as query_id, embedding from vc where vec_id % 20 = 0) a, vc b group by all),
f as (select * from sc where score >= 0.3), t as (select *, max(score) over (partition by query_id, vault) as top from f)
"""


@query(VEC + "select query_id, vault, page_id, round(score, 3) as score from t where score >= 0.55 * top qualify row_number() over (partition by query_id, vault order by round(score, 6) desc, page_id) <= 1000000", with_views=False)
def semantic_search(s, d):
    x = v.vectors(s, d)
    q = x.filter("vec_id % 20 = 0").select(F.col("vec_id").alias("query_id"), "embedding")
    return vectors.semantic_search(q, x, limit=1_000_000).select("query_id", "vault", "page_id", F.round("score", 3).alias("score"))


@query("""
with vc as (select 'v' || ((vec_id // 3) % 3) as vault, 'page-' || (vec_id // 3) as page_id, embedding from embeddings),
sc as (select a.vault, a.page_id as src, b.page_id, max(list_dot_product(a.embedding::double[], b.embedding::double[])) as score from vc a join vc b on a.vault = b.vault and a.page_id <> b.page_id group by all),
t as (select *, max(score) over (partition by vault, src) as top from sc where score >= 0.3)
select vault, src, page_id, round(score, 3) as score from t where score >= 0.55 * top""", with_views=False)
def related_pages(s, d):
    return vectors.related(v.vectors(s, d), limit=1_000_000).select("vault", "src", "page_id", F.round("score", 3).alias("score"))


@query("""
with vc as (select 'v' || ((vec_id // 3) % 3) as vault, 'page-' || (vec_id // 3) as page_id, embedding from embeddings),
sc as (select a.vault, a.page_id as src, b.page_id, max(list_dot_product(a.embedding::double[], b.embedding::double[])) as score from vc a join vc b on a.vault = b.vault and a.page_id <> b.page_id group by all),
t as (select *, max(score) over (partition by vault, src) as top from sc where score >= 0.3)
select vault, src, page_id, round(score, 3) as score, row_number() over (partition by vault, src order by round(score, 6) desc, page_id)::int as rank from t where score >= 0.55 * top qualify rank <= 8""", with_views=False)
def related_top8(s, d):
    return vectors.related(v.vectors(s, d)).select("vault", "src", "page_id", F.round("score", 3).alias("score"), "rank")


@query("""
, st as (select vault, page_id, case when doc_id % 5 = 0 then 'x' else hash end as hash from pages where doc_id % 3 <> 1 or doc_id % 2 = 0)
select vault, page_id, 'embed' as action from pages where doc_id % 5 = 0 or not (doc_id % 3 <> 1 or doc_id % 2 = 0) union all select vault, page_id || '-gone', 'delete' from st""")
def stale_vectors(s, d):
    p = v.pages(s, d)
    stored = p.filter("doc_id % 3 <> 1 or doc_id % 2 = 0").select("vault", "page_id", F.expr("if(doc_id % 5 = 0, 'x', hash)").alias("hash"))
    gone = stored.withColumn("page_id", F.concat("page_id", F.lit("-gone")))
    return vectors.stale_vectors(p, stored.unionByName(gone))


@query(SEARCH + f"""
, a as (select query_id, vault, page_id, score from (select query_id, vault, page_id, round(score, 5) as score, row_number() over (partition by query_id, vault order by round(score, 9) desc, mtime desc, page_id) as rank from ss where score > 0) where rank <= 10),
vc as (select {v.vault_sql('(vec_id // 3)')} as vault, 'page-' || (vec_id // 3) as page, vec_id // 3 as number, vec_id, embedding from embeddings),
sc as (select x.query_id, y.vault, y.page, any_value(y.number) as number, max(list_dot_product(x.embedding::double[], y.embedding::double[])) as score from (select vec_id as query_id, embedding from vc where vec_id % 20 = 0) x, vc y group by x.query_id, y.vault, y.page),
f as (select * from sc where score >= 0.3), t as (select *, max(score) over (partition by query_id, vault) as top from f),
b as (select query_id, vault, {v.page_sql('number')} as page_id, round(score, 3) as score from t where score >= 0.55 * top qualify row_number() over (partition by query_id, vault order by round(score, 6) desc, page) <= 40)
select query_id, vault, page_id, score, 'literal' as kind from a union all
select query_id, vault, page_id, round(score - 1, 5), 'semantic' from (select b.* from b anti join a using (query_id, vault, page_id) qualify row_number() over (partition by query_id, vault order by score desc, page_id) <= 12)""")
def blended_search(s, d):
    """The first ten hits of a search by words with those of the search by vectors that has its number; vectors belong to the page of their number."""
    found = search_top10(s, d).select("query_id", "vault", "page_id", "score")
    x = v.vectors(s, d)
    near = vectors.semantic_search(x.filter("vec_id % 20 = 0").select(F.col("vec_id").alias("query_id"), "embedding"), x, limit=40)
    number = F.regexp_extract("page_id", r"(\d+)$", 1).cast("long")
    near = near.withColumn("number", number).select("query_id", "vault", F.expr(v.page_sql("number")).alias("page_id"), F.round("score", 3).alias("score"))
    return rank.blended(found, near.withColumn("query_id", F.col("query_id").cast("int"))).withColumn("score", F.round("score", 5))


# ---- analyses
@query(f"""
with pg as (select p_partkey, 'part/' || p_partkey as page_id, trim(regexp_replace('the size of ' || lower(regexp_replace(p_type, '[^A-Za-z ]', ' ', 'g')), '\\s+', ' ', 'g')) as subject, p_size::string as value, {v.NOW_S} - p_partkey % 90 * 86400 as mtime from part),
g as (select subject, max(mtime) as latest from pg group by subject having count(distinct value) >= 2 and count(distinct page_id) >= 2),
t as (select subject, row_number() over (order by latest desc, subject)::int as rank from g qualify rank <= 30)
select 'v0' as vault, rank, subject, 'units' as unit, page_id, value, 'unverified' as trust from pg join t using (subject)""", with_views=False)
def contradictions(s, d):
    return analysis.contradictions(v.claims(s, d), v.ledger(s, d), v.NOW)


@query("""
, b as (select vault, case when doc_id % 4 = 0 then 'high' else '2' end as band, trust from trusted where doc_id % 4 < 2)
select vault, band, count(*) as pages, count(*) filter (trust in ('verified', 'aging')) as verified, count(*) filter (trust = 'lapsed') as lapsed,
case when count(*) filter (trust in ('verified', 'aging', 'lapsed')) > 0 then floor(count(*) filter (trust in ('verified', 'aging')) * 100 / count(*) filter (trust in ('verified', 'aging', 'lapsed')) + 0.5)::bigint end as accuracy from b group by all""")
def confidence_calibration(s, d):
    return analysis.calibration(trusted(s, d))


@query("""
, ed as (select * from edges where src not like '%7' and dst not like '%7'),
lost as (select vault, page_id from pages p where not exists (select 1 from ed e where e.vault = p.vault and (e.src = p.page_id)) and not exists (select 1 from ed e where e.vault = p.vault and e.dst = p.page_id) qualify row_number() over (partition by vault order by page_id) <= 25),
ws as (select vault, page_id, unnest(list_distinct(regexp_extract_all(lower(title || ' ' || substring(plain, 1, 4000)), '[a-z][a-z0-9-]{4,}'))) as word from pages),
nn as (select vault, count(*) as n from pages group by vault),
rare as (select vault, word from ws join nn using (vault) group by vault, word having count(*) <= any_value(n) * 0.15::double),
sh as (select a.vault, a.page_id as orphan, b.page_id as other, count(*) * 2 as s from ws a join lost using (vault, page_id) join rare using (vault, word) join ws b on b.vault = a.vault and b.word = a.word where a.page_id <> b.page_id group by all),
tg as (select a.vault, a.page_id as orphan, b.page_id as other, count(*) * 4 as t from (select vault, page_id, unnest(tags) as tag from pages) a join lost using (vault, page_id) join (select vault, page_id, unnest(tags) as tag from pages) b on b.vault = a.vault and b.tag = a.tag where a.page_id <> b.page_id group by all),
al as (select coalesce(sh.vault, tg.vault) as vault, coalesce(sh.orphan, tg.orphan) as orphan, coalesce(sh.other, tg.other) as other, coalesce(s, 0) + coalesce(t, 0) as b from sh full join tg on sh.vault = tg.vault and sh.orphan = tg.orphan and sh.other = tg.other),
fs as (select al.vault, orphan as page_id, other, b + case when x.folder = y.folder then 3 else 0 end as score from al join pages x on x.vault = al.vault and x.page_id = orphan join pages y on y.vault = al.vault and y.page_id = other)
select vault, page_id, other, score::bigint as score, row_number() over (partition by vault, page_id order by score desc, other)::int as rank from fs where score >= 6 qualify rank <= 3""")
def orphan_rescue(s, d):
    e = edges_of(s, d).filter("src not like '%7' and dst not like '%7'")
    return analysis.rescue_orphans(v.pages(s, d), e, limit=25, letters=4000).select("vault", "page_id", "other", F.col("score").cast("long").alias("score"), "rank")


@query("""
, ed as (select * from edges where src not like '%7' and dst not like '%7'),
lost as (select vault, page_id from pages p where not exists (select 1 from ed e where e.vault = p.vault and (e.src = p.page_id)) and not exists (select 1 from ed e where e.vault = p.vault and e.dst = p.page_id)),
ws as (select vault, page_id, unnest(list_distinct(regexp_extract_all(lower(title || ' ' || plain), '[a-z][a-z0-9-]{4,}'))) as word from pages),
nn as (select vault, count(*) as n from pages group by vault),
rare as (select vault, word from ws join nn using (vault) group by vault, word having count(*) <= any_value(n) * 0.15::double),
sh as (select a.vault, a.page_id as orphan, b.page_id as other, count(*) * 2 as s from ws a join lost using (vault, page_id) join rare using (vault, word) join ws b on b.vault = a.vault and b.word = a.word where a.page_id <> b.page_id group by all),
tg as (select a.vault, a.page_id as orphan, b.page_id as other, count(*) * 4 as t from (select vault, page_id, unnest(tags) as tag from pages) a join lost using (vault, page_id) join (select vault, page_id, unnest(tags) as tag from pages) b on b.vault = a.vault and b.tag = a.tag where a.page_id <> b.page_id group by all),
al as (select coalesce(sh.vault, tg.vault) as vault, coalesce(sh.orphan, tg.orphan) as orphan, coalesce(sh.other, tg.other) as other, coalesce(s, 0) + coalesce(t, 0) as b from sh full join tg on sh.vault = tg.vault and sh.orphan = tg.orphan and sh.other = tg.other),
fs as (select al.vault, orphan as page_id, other, b + case when x.folder = y.folder then 3 else 0 end as score from al join pages x on x.vault = al.vault and x.page_id = orphan join pages y on y.vault = al.vault and y.page_id = other)
select vault, page_id, other, score::bigint as score, row_number() over (partition by vault, page_id order by score desc, other)::int as rank from fs where score >= 6 qualify rank <= 3""")
def orphan_rescue_whole(s, d):
    e = edges_of(s, d).filter("src not like '%7' and dst not like '%7'")
    return analysis.rescue_orphans(v.pages(s, d), e).select("vault", "page_id", "other", F.col("score").cast("long").alias("score"), "rank")


@query()
def near_duplicate_pages(s, d):
    docs = v.pages(s, d).select("vault", F.col("page_id").alias("id"), "title", F.col("plain").alias("text"))
    return similar.with_evidence(similar.near_duplicates(docs), docs).withColumn("score", F.round("score", 6))


# ---- parsing and ingest
@query("""
, k as (select *, trim(regexp_replace(plain, '[^A-Za-z0-9 .,]', '', 'g')) as kept, (doc_id // 3) % 3 = 0 as signed, (doc_id // 3) % 9 = 0 as changed from pages)
select vault, page_id, 0 as pos, 'Heading' as heading, 'unverified' as trust from k union all
select vault, page_id, 1, 'Body', case when not signed then 'unverified' when changed then 'lapsed' else 'verified' end from k where kept <> ''""")
def section_trust(s, d):
    f = vault_files(s, d).withColumn("text", F.regexp_replace("text", pages.FRONT, ""))
    parts = materialize(pages.sections(f).select("vault", "page_id", "pos", "heading", "hash"))
    signed = v.ledger(s, d).select("vault", "page_id", F.col("hash").alias("says"), "at", "by")
    signed = parts.filter("heading = 'Body'").join(signed, ["vault", "page_id"]).withColumn("hash", F.when(F.col("says") == "changed", "changed").otherwise(F.col("hash"))).drop("pos", "says")
    return trust.section_trust(parts, signed).select("vault", "page_id", "pos", "heading", "trust")


def vault_files(s, d):
    p = v.pages(s, d)
    head = F.expr("concat('---\ntitle: Note ', cast(doc_id as string), '\ntags: [alpha, \"#', substring(page_id, 1, 6), '\"]\naliases:\n  - Old ', cast(doc_id as string), '\nconfidence: high\nupdated: 2024-01-05\n---\n')")
    text = F.concat(head, F.lit("# Heading\n\nSee [[doc-3|the third]], [[specs/a#part]] and [b](../specs/b.md) or [w](https://x.org/y.md).\n`#code` ![i](x.png)\n> quoted **bold** #follow-up #AB1234 #IFDEF (#project/x)\n\n## Body\n\n"), F.regexp_replace("plain", r"[^A-Za-z0-9 .,]", ""))
    return p.select("vault", "rel_path", text.alias("text"), "mtime", "doc_id", F.regexp_replace("plain", r"[^A-Za-z0-9 .,]", "").alias("kept"))


KEPT = "trim(regexp_replace(regexp_replace(plain, '[^A-Za-z0-9 .,]', '', 'g'), '\\s+', ' ', 'g'))"


@query(f"""
, k as (select *, 'Heading See the third, specs/a#part and b or w. quoted bold #follow-up #AB1234 #IFDEF (#project/x) Body' || case when {KEPT} = '' then '' else ' ' || {KEPT} end as body from pages)
select vault, page_id, 'Note ' || doc_id as title, 'alpha,' || substring(page_id, 1, 6) || ',follow-up,project/x' as tags, 'Old ' || doc_id as aliases, 'doc-3|specs/a|../specs/b' as links,
len(string_split(body, ' '))::int as words, substring(sha1(body), 1, 16) as hash, true as read from k""")
def parsed_pages(s, d):
    p = pages.parse_pages(vault_files(s, d).select("vault", "rel_path", "text", "mtime"))
    return p.select("vault", "page_id", "title", F.array_join("tags", ",").alias("tags"), F.array_join("aliases", ",").alias("aliases"), F.array_join("raw_links", "|").alias("links"), "words", "hash", F.col("parse_error").isNull().alias("read"))


@query(f"select vault, page_id, unnest([0, 1]) as pos, unnest(['Heading', 'Body']) as heading from pages where trim(regexp_replace(plain, '[^A-Za-z0-9 .,]', '', 'g')) <> '' union all select vault, page_id, 0, 'Heading' from pages where trim(regexp_replace(plain, '[^A-Za-z0-9 .,]', '', 'g')) = ''")
def page_sections(s, d):
    f = vault_files(s, d).withColumn("text", F.regexp_replace("text", pages.FRONT, ""))
    return pages.sections(f).select("vault", "page_id", "pos", "heading")


@query("select vault, page_id, unnest([1, 2]) as depth, unnest(['Heading', 'Body']) as heading from pages")
def page_outline(s, d):
    f = vault_files(s, d).withColumn("text", F.regexp_replace("text", pages.FRONT, ""))
    return pages.outline(f).select("vault", "page_id", "depth", "heading")


@query("""
, w as (select vault, page_id, title, list_filter(string_split(plain, ' '), lambda x: x <> '') as w from pages),
t as (select *, greatest(140, ceil((len(w) - 180) / 23))::int as stride from w where len(w) > 0),
c as (select *, unnest(range(0, (greatest(0, ceil((len(w) - 180) / stride)) + 1)::int)) as chunk_no from t)
select vault, page_id, chunk_no::int as chunk_no, substring(sha1(title || chr(10) || array_to_string(w[chunk_no * stride + 1:chunk_no * stride + 180], ' ')), 1, 16) as hash from c where chunk_no < 24""")
def embedding_chunks(s, d):
    return pages.chunks(v.pages(s, d), most=24).select("vault", "page_id", "chunk_no", "hash")


@query("""
, w as (select vault, page_id, title, list_filter(string_split(plain, ' '), lambda x: x <> '') as w from pages),
c as (select *, unnest(range(0, (greatest(0, ceil((len(w) - 180) / 140)) + 1)::int)) as chunk_no from w where len(w) > 0)
select vault, page_id, chunk_no::int as chunk_no, substring(sha1(title || chr(10) || array_to_string(w[chunk_no * 140 + 1:chunk_no * 140 + 180], ' ')), 1, 16) as hash from c""")
def embedding_chunks_whole(s, d):
    return pages.chunks(v.pages(s, d)).select("vault", "page_id", "chunk_no", "hash")


@query(f"""select vault, page_id, {TOK} as tokens, case when {TOK} >= 1000000 then (floor({TOK} / 100000 + 0.5) / 10)::decimal(20, 1) || 'M' when {TOK} >= 10000 then floor({TOK} / 1000 + 0.5)::bigint || 'k' when {TOK} >= 1000 then (floor({TOK} / 100 + 0.5) / 10)::decimal(20, 1) || 'k' else {TOK}::string end as shown,
coalesce(nullif(substring(regexp_replace(trim(regexp_replace(lower(title), '[^a-z0-9\\s-]', '', 'g')), '\\s+', '-', 'g'), 1, 60), ''), 'untitled') as slug from pages""")
def token_labels(s, d):
    n = token_count(F.col("plain"))
    return v.pages(s, d).select("vault", "page_id", n.alias("tokens"), format_tokens(n).alias("shown"), slugify(F.col("title")).alias("slug"))


@query("select vault, page_id, 'notes/2024/02/2024-02-01-' || coalesce(nullif(substring(regexp_replace(trim(regexp_replace(lower(title), '[^a-z0-9\\s-]', '', 'g')), '\\s+', '-', 'g'), 1, 60), ''), 'untitled') || '.md' as path from pages")
def template_paths(s, d):
    return v.pages(s, d).select("vault", "page_id", target_path(F.lit("/notes/{{year}}/{{month}}/"), F.lit("{{date}}-{{slug}}"), F.col("title"), v.NOW).alias("path"))


@query("select vault, page_id, plain as body from pages")
def stripped_bodies(s, d):
    p = v.pages(s, d)
    return p.select("vault", "page_id", strip_leading_title(F.concat(F.lit("# "), "title", F.lit("\n\n"), "plain"), F.col("title")).alias("body"))


@query()
def captured_pages(s, d):
    h = v.table(s, d, "pages").withColumn("m", ingest.html_to_markdown("html"))
    return ingest.to_pages(h.select("page_id", F.col("m.title").alias("title"), F.col("m.markdown").alias("markdown"), F.col("url").alias("source")), v.NOW).select("page_id", "title", "text")


@query("""
with t as (select *, case when lag(role) over w is not distinct from role and lag(turn) over w is not null then 0 else 1 end as new from conversations window w as (partition by conv_id order by turn)),
b as (select *, sum(new) over (partition by conv_id order by turn) as block from t),
g as (select conv_id, block, any_value(role) as role, string_agg(trim(text), ' ' order by turn) filter (trim(text) <> '') as said from b group by conv_id, block)
select conv_id, count(distinct role)::int as speakers, count(*)::int as blocks, string_agg(said, '|' order by block) as said from g group by conv_id""", with_views=False)
def transcript_blocks(s, d):
    t = ingest.transcripts(v.table(s, d, "conversations"))
    head = F.when(F.col("blocks") < 2, F.col("markdown")).otherwise(F.regexp_replace(F.regexp_replace("markdown", r"^_\d+ speakers: [^\n]*\n\n\*\*[^*]*\*\*\n\n", ""), r"\n\n\*\*[^*]*\*\*\n\n", "|"))
    return t.select("conv_id", "speakers", "blocks", head.alias("said"))


@query("""select doc_id, case when len(w) < 3 then null when len(w) <= 20 then array_to_string(w, ' ') else regexp_replace(array_to_string(w[1:20], ' '), '[,;:]$', '') || '…' end as summary from
(select doc_id, list_filter(string_split(regexp_replace(regexp_replace(plain, '[^A-Za-z ]', ' ', 'g'), '\\s+', ' ', 'g'), ' '), lambda x: x <> '') as w from docs)""")
def output_summaries(s, d):
    p = v.pages(s, d).select("doc_id", F.trim(F.regexp_replace("plain", "[^A-Za-z ]", " ")).alias("t"))
    raw = F.concat(F.lit('<|channel|>Here is the summary: "'), "t", F.lit('"'))
    return p.select("doc_id", ingest.to_summary(raw).alias("summary"))


RULES_PAGE = "# Schema\n\n## Frontmatter fields\n\n| field | required | notes |\n|---|---|---|\n| title | yes | a short string |\n| tags | required | list of tags |\n| owner | optional | text |\n| updated | yes | date |\n"


@query("select vault, page_id, case when doc_id % 2 = 0 then 'tags' else '' end as missing, case when doc_id % 3 = 0 then 'title' else '' end as wrong_type from pages where doc_id % 2 = 0 or doc_id % 3 = 0")
def schema_issues(s, d):
    files = s.createDataFrame([(x, RULES_PAGE) for x in ("v0", "v1", "v2")], "vault string, text string")
    p = v.pages(s, d).withColumn("frontmatter_json", F.expr("concat('{\"title\": ', if(doc_id % 3 = 0, '5', '\"x\"'), if(doc_id % 2 = 0, '', ', \"tags\": [\"a\"]'), ', \"updated\": \"2024-01-05\"}')"))
    out = schema.check_schema(p, schema.schema_rules(files))
    return out.select("vault", "page_id", F.array_join("missing", ",").alias("missing"), F.array_join("wrong_type", ",").alias("wrong_type"))


@query()
def link_suggestions(s, d):
    p = v.pages(s, d).withColumn("title", F.regexp_extract("plain", r"([A-Za-z]{9,})", 1))
    f = v.pages(s, d).select("vault", "rel_path", F.col("plain").alias("text"))
    return mentions.suggest_links(f, p.filter("title <> ''"), edges_of(s, d))


# ---- packs
@query()
def context_packs(s, d):
    f = v.pages(s, d).select("vault", "rel_path", F.col("plain").alias("text"))
    p = materialize(packs.passages(f))
    taken, _ = packs.fill_budget(packs.score_passages(v.queries(s, d), p, trusted(s, d)))
    return taken


@query("""
, t as (select query_id, list_filter(string_split_regex(lower(query), '[^a-z0-9-]+'), lambda x: len(x) > 2) as ts from queries),
q as (select query_id, unnest(ts) as term from t),
x as (select query_id, vault, page_id, sum(least((len(plain) - len(replace(lower(plain), term, ''))) // len(term), 4) * 2 + case when contains(lower(title || ' '), term) then 8 else 0 end) as base, any_value(trust) as trust from trusted, q where contains(lower(plain), term) or contains(lower(title || ' '), term) group by all)
select query_id, vault, page_id, round(base * case trust when 'verified' then 1.35 when 'aging' then 1.1 when 'lapsed' then 0.8 else 1.0 end, 6)::double as score from x""")
def passage_scores(s, d):
    whole = v.pages(s, d).select("vault", "page_id", "rel_path", F.lit(0).alias("pos"), F.lit(None).cast("string").alias("heading"), F.col("plain").alias("text"), token_count(F.col("plain")).alias("tokens"))
    out = packs.score_passages(v.queries(s, d), whole, trusted(s, d))
    return out.select(F.col("query_id").cast("int").alias("query_id"), "vault", "page_id", F.round("score", 6).alias("score"))


@query()
def rendered_packs(s, d):
    f = v.pages(s, d).select("vault", "rel_path", F.col("plain").alias("text"))
    p, t = materialize(packs.passages(f)), trusted(s, d)
    taken, omitted = packs.fill_budget(packs.score_passages(v.queries(s, d), p, t))
    return packs.render_packs(v.queries(s, d), taken, omitted, p, t)


@query()
def gap_lists(s, d):
    return usage.gap_list(usage.cluster_gaps(v.usage(s, d)))


# ---- rewrites
@query("select vault, case k when 1 then 'tags' else 'title' end as name, count(*) filter (k = 1) as missing, count(*) filter (k = 2) as wrong_type from (select vault, doc_id, unnest([1, 2]) as k from pages) where (k = 1 and doc_id % 2 = 0) or (k = 2 and doc_id % 3 = 0) group by all")
def schema_counts(s, d):
    files = s.createDataFrame([(x, RULES_PAGE) for x in ("v0", "v1", "v2")], "vault string, text string")
    p = v.pages(s, d).withColumn("frontmatter_json", F.expr("concat('{\"title\": ', if(doc_id % 3 = 0, '5', '\"x\"'), if(doc_id % 2 = 0, '', ', \"tags\": [\"a\"]'), ', \"updated\": \"2024-01-05\"}')"))
    return schema.schema_breakdown(schema.check_schema(p, schema.schema_rules(files)))


def plain_files(s, d):
    return v.pages(s, d).select("vault", "rel_path", F.col("plain").alias("text"), "doc_id", "title")


@query("select vault, rel_path, md5(case when doc_id % 2 = 0 then '---' || chr(10) || 'source: \"u' || doc_id || '\"' || chr(10) || '---' || chr(10) || chr(10) else '' end || plain) as digest from pages")
def sourced_pages(s, d):
    f = plain_files(s, d)
    src = f.filter("doc_id % 2 = 0").select("vault", "rel_path", F.expr("'u' || cast(doc_id as string)").alias("source"))
    return links.set_source(f.select("vault", "rel_path", "text"), src).select("vault", "rel_path", F.md5("text").alias("digest"))


@query("select vault, rel_path, md5(case when doc_id % 4 = 1 then '---' || chr(10) || 'verified_on: 2024-01-05' || chr(10) || '---' || chr(10) || chr(10) else '' end || plain) as digest from pages")
def stamped_pages(s, d):
    f = plain_files(s, d)
    st = f.filter("doc_id % 4 = 1").select("vault", "rel_path", F.lit("2024-01-05 10:00:00").cast("timestamp").alias("at"))
    return ingest.stamp_trust(f.select("vault", "rel_path", "text"), st).select("vault", "rel_path", F.md5("text").alias("digest"))


@query("""
, m as (select a.vault, a.rel_path as keep, a.page_id as keep_id, b.rel_path as lose, b.title, b.plain from pages a join pages b on b.doc_id = a.doc_id + 3 where a.doc_id % 12 = 0)
select p.vault, p.rel_path, md5(case when l.lose is not null then '---' || chr(10) || 'title: "' || replace(l.title, '"', '\\"') || '"' || chr(10) || 'merged_into: "' || l.keep || '"' || chr(10) || 'aliases: ["' || replace(l.title, '"', '\\"') || '"]' || chr(10) || '---' || chr(10) || chr(10) || '# ' || l.title || chr(10) || chr(10)
 || 'This page was merged into [[' || l.keep_id || ']]. Its content lives there now.' || chr(10)
 when k.keep is not null then p.plain || chr(10) || chr(10) || '## Merged from ' || k.title || chr(10) || chr(10) || k.plain || chr(10) else p.plain end) as digest
from pages p left join m k on k.vault = p.vault and k.keep = p.rel_path left join m l on l.vault = p.vault and l.lose = p.rel_path""")
def merged_pages(s, d):
    f = plain_files(s, d)
    a = f.filter("doc_id % 12 = 0").select("vault", F.col("rel_path").alias("keep"), (F.col("doc_id") + 3).alias("doc_id"))
    merges = a.join(f.select("doc_id", F.col("rel_path").alias("lose"), "title"), "doc_id").drop("doc_id")
    return links.merge_pages(f.select("vault", "rel_path", "text"), merges).select("vault", "rel_path", F.md5("text").alias("digest"))


@query()
def linked_pages(s, d):
    f = plain_files(s, d).select("vault", "rel_path", "text")
    return mentions.apply_links(f, link_suggestions(s, d)).filter("text like '%[[%'")


@query("""
, l as (select vault, rel_path, at, text, lag(text) over (partition by vault, rel_path order by at) as before from versions)
select vault, rel_path, at, (len(string_split(trim(regexp_replace(text, '\\s+', ' ', 'g')), ' ')) - len(string_split(trim(regexp_replace(before, '\\s+', ' ', 'g')), ' ')))::int as growth from l where before is not null""")
def version_growth(s, d):
    x = v.versions(s, d).withColumn("before", F.lag("text").over(Window.partitionBy("vault", "rel_path").orderBy("at"))).filter("before is not null")
    x = x.withColumn("w", journal.diff_words("before", "text"))
    return x.select("vault", "rel_path", secs("at").alias("at"), (F.col("w.added") - F.col("w.removed")).cast("int").alias("growth"))


@query()
def version_diffs(s, d):
    x = v.versions(s, d).withColumn("before", F.lag("text").over(Window.partitionBy("vault", "rel_path").orderBy("at"))).filter("before is not null")
    return x.select("vault", "rel_path", "at", F.explode(journal.diff_lines("before", "text")).alias("line")).select("vault", "rel_path", "at", "line.op", "line.text")


# ---- files, logs and stores, written by Spark in the shared folder and read back
def new_folder(s):
    return f"{shared_folder(s).rstrip('/')}/vf-{uuid.uuid4().hex}"


@query("select vault, t, agent, page, query, hits, floor(epoch(at))::bigint as at_s from usage where event_id % 17 <> 0 and at >= timestamp '2024-01-10 00:00:00'")
def log_events(s, d):
    """A log of JSON lines, every seventeenth of them torn, read back from a day on."""
    line = F.to_json(F.struct("vault", "t", "at", "agent", "page", "query", "hits"))
    torn = F.when(F.col("event_id") % 17 == 0, F.substring(line, F.lit(1), F.floor(F.length(line) / 2).cast("int"))).otherwise(line)
    path = new_folder(s)
    v.usage(s, d).select(torn.alias("value")).write.text(path)
    return sources.read_log(s, path, sources.USAGE, since="2024-01-10").select("vault", "t", "agent", "page", "query", "hits", secs("at").alias("at_s"))


@query("select page_id, hash, 'ann' as signer from ledger")
def ledger_store(s, d):
    """A keyed store of signatures, an object of about a thousand pages a line."""
    ledger, path = v.ledger(s, d), new_folder(s)
    parts = max(1, ledger.count() // 1000)
    entry = F.struct("page_id", F.struct("hash", "by"))
    ledger.groupBy(F.pmod(F.xxhash64("vault", "page_id"), F.lit(parts)).alias("part")).agg(F.to_json(F.map_from_entries(F.collect_list(entry))).alias("value")).select("value").write.text(path)
    return sources.read_store(s, path, "hash:string,by:string", lines=True).withColumnRenamed("by", "signer")


IGNORED = ["# drafts", "", "/area-1/", "topic-*2", "doc-?.md", "area-3/**/doc-*7.md"]


@query(r"""select vault, rel_path from pages where not regexp_matches(rel_path, '^area-1(/|$)') and not regexp_matches(rel_path, '(^|/)topic-[^/]*2(/|$)')
and not regexp_matches(rel_path, '(^|/)doc-[^/][.]md(/|$)') and not regexp_matches(rel_path, '(^|/)area-3/.*/doc-[^/]*7[.]md(/|$)')""")
def listed_files(s, d):
    return sources.apply_ignore(v.pages(s, d), IGNORED).select("vault", "rel_path")


FENCED = "case when doc_id % 9 = 0 then '---\n{bad}\n---\n' || plain when doc_id % 9 = 1 then '---\ntitle: A title\n---\n' || plain else plain end"


@query("""select vault, page_id, doc_id % 9 = 0 as unreadable, case when doc_id % 9 = 1 then 'A title' end as title, md5(case when doc_id % 9 = 0 then '---' || chr(10) || 'title: [' || chr(10) || '---' || chr(10) || plain else plain end) as body
from pages""")
def malformed_pages(s, d):
    """Pages some of which begin with a block that can't be read: these keep their whole text as body and are reported."""
    f = v.pages(s, d).select("vault", "rel_path", "mtime", "doc_id", F.expr(FENCED.format(bad="title: [")).alias("text"))
    p = pages.parse_pages(f)
    errors = pages.parse_errors(p).select("vault", "rel_path", F.lit(True).alias("unreadable"))
    title = F.get_json_object("frontmatter_json", "$.title")
    return p.join(errors, ["vault", "rel_path"], "left").select("vault", "page_id", F.coalesce("unreadable", F.lit(False)).alias("unreadable"), title.alias("title"), F.md5("body").alias("body"))


@query("select vault, page_id, title, words, hash from pages")
def written_index(s, d):
    path = new_folder(s)
    sources.write_index(v.pages(s, d), path)
    return s.read.parquet(path).select("vault", "page_id", "title", "words", "hash")


@query("""
select distinct ext, substring(sha1(content), 1, 16) as hash, 'assets/' || substring(sha1(content), 1, 16) || '.' || ext as rel_path from
(select case doc_id % 6 when 0 then 'gif' when 1 then 'bmp' when 2 then 'webp' when 3 then 'jpg' when 4 then 'png' end as ext,
 case doc_id % 6 when 0 then 'GIF89a'::blob when 1 then 'BM'::blob when 2 then 'RIFF1234WEBP'::blob when 3 then unhex('FFD8FF') when 4 then unhex('89504E47') else 'x'::blob end || encode(text) as content from documents) where ext is not null""", with_views=False)
def stored_images(s, d):
    magic = F.expr("case doc_id % 6 when 0 then binary('GIF89a') when 1 then binary('BM') when 2 then binary('RIFF1234WEBP') when 3 then unhex('FFD8FF') when 4 then unhex('89504E47') else binary('x') end")
    files = v.table(s, d, "documents").select(F.concat(magic, F.col("text").cast("binary")).alias("content"))
    return ingest.store_attachments(files).select("ext", "hash", "rel_path")


# ---- every order, filter and reply
ORDERS = {"title": "title", "folder": "folder, title", "tags": "len(tags) desc", "words": "words desc", "mtime": "mtime desc", "backlinks": "coalesce(inbound, 0) desc"}


@query("".join(f"{', ' if not i else ''}o{i} as (select '{name}' as sort, p.vault, p.page_id, row_number() over (partition by p.vault order by {order}, p.page_id)::int as rank from pages p left join inbound using (vault, page_id) qualify rank <= 200){', ' if i < 5 else ''}" for i, (name, order) in enumerate(ORDERS.items())) + " union all ".join(f"{' ' if not i else ''}select * from o{i}" for i in range(6)))
def explorer_orders(s, d):
    rows, inbound = materialize(v.pages(s, d)), links.inbound(edges_of(s, d))
    each = [health.explorer(rows, inbound, sort).select(F.lit(sort).alias("sort"), "vault", "page_id", "rank") for sort in ORDERS]
    return functools.reduce(lambda a, b: a.unionByName(b), each)


@query("""
select 'folder' as by_what, vault, page_id from pages where folder = 'area-1/topic-1' union all select 'path', vault, page_id from pages where rel_path = 'area-2/topic-2/doc-42.md'
union all select 'contains', vault, page_id from (select vault, page_id from pages where contains(lower(title), 'th') or contains(lower(rel_path), 'th') qualify row_number() over (partition by vault order by page_id) <= 60)
union all select 'sourced', vault, page_id from (select vault, page_id from pages where doc_id % 3 = 0 or doc_id % 5 = 0 qualify row_number() over (partition by vault order by page_id) <= 200)""")
def page_filters(s, d):
    p = v.pages(s, d).withColumn("frontmatter_json", F.expr("if(doc_id % 3 = 0 or doc_id % 5 = 0, '{\"source\": \"u\"}', '{}')"))
    asked = {"folder": {"folder": "area-1/topic-1"}, "path": {"path": "area-2/topic-2/doc-42.md"}, "contains": {"contains": "th"}, "sourced": {"sourced": True}}
    each = [health.page_filter(p, **how).select(F.lit(name).alias("by_what"), "vault", "page_id") for name, how in asked.items()]
    return functools.reduce(lambda a, b: a.unionByName(b), each)


ALONE = "regexp_extract({}, 'doc-([0-9]+)$', 1)::bigint % 6"


@query(f"""
, linked as (select * from edges where {ALONE.format('src')} <> 0 and {ALONE.format('dst')} <> 0)
select vault, page_id from pages p where not exists (select 1 from linked e where e.vault = p.vault and (e.src = p.page_id or e.dst = p.page_id))""")
def unlinked_pages(s, d):
    number = lambda c: F.regexp_extract(c, r"doc-(\d+)$", 1).cast("long") % 6
    return links.orphans(v.pages(s, d), edges_of(s, d).filter((number("src") != 0) & (number("dst") != 0))).select("vault", "page_id")


LETTERS = "trim(regexp_replace(regexp_replace(plain, '[^A-Za-z ]', ' ', 'g'), ' +', ' ', 'g'))"


@query(f"select doc_id, case when t <> '' and length(t) <= 90 then t end as title from (select doc_id, trim(substring({LETTERS}, 1, (doc_id % 120)::int)) as t from docs)")
def title_replies(s, d):
    t = F.trim(F.regexp_replace(F.regexp_replace("plain", "[^A-Za-z ]", " "), " +", " "))
    p = v.pages(s, d).select("doc_id", F.trim(F.substring(t, F.lit(1), (F.col("doc_id") % 120).cast("int"))).alias("t"))
    return p.select("doc_id", ingest.to_title(F.concat(F.lit("## "), "t", F.lit(".;\nand a second line"))).alias("title"))


@query(f"""
, w as (select vault, doc_id, list_filter(string_split(lower({LETTERS}), ' '), lambda x: length(x) between 2 and 30)[1:8] as w from pages),
known as (select distinct vault, w[1] as tag from w where doc_id % 10 = 0 and len(w) > 0),
one as (select vault, doc_id, unnest(w) as tag, unnest(range(len(w))) as pos from w),
own as (select o.vault, doc_id, pos, case when k.tag is null then o.tag else upper(o.tag) end as tag from one o left join known k on k.vault = o.vault and k.tag = o.tag),
firsts as (select vault, doc_id, tag, min(pos) as pos from own group by all)
select doc_id, list(tag order by pos)[1:6] as tags from firsts group by vault, doc_id""")
def tag_replies(s, d):
    t = F.trim(F.regexp_replace(F.regexp_replace("plain", "[^A-Za-z ]", " "), " +", " "))
    w = F.slice(F.filter(F.split(F.lower(t), " "), lambda x: F.length(x).between(2, 30)), 1, 8)
    p = materialize(v.pages(s, d).select("vault", F.col("doc_id").alias("id"), w.alias("w")).filter(F.size("w") > 0))
    raw = F.when(F.col("id") % 2 == 0, F.concat(F.lit('Sure: ["'), F.array_join("w", '", "'), F.lit('"]'))).otherwise(F.array_join("w", "\n- "))
    known = p.filter("id % 10 = 0").select("vault", F.upper(F.col("w")[0]).alias("tag")).distinct()
    return ingest.to_tags(p.select("vault", "id", raw.alias("raw")), known).select(F.col("id").alias("doc_id"), "tags")


@query("""select vault, string_agg('- ' || page_id || ': ' || concat_ws('; ', case when doc_id % 2 = 0 then 'add tags' end, case when doc_id % 3 = 0 then 'retype title' end), chr(10) order by page_id) as text
from pages where doc_id % 2 = 0 or doc_id % 3 = 0 group by vault""")
def fix_lists(s, d):
    files = s.createDataFrame([(x, RULES_PAGE) for x in ("v0", "v1", "v2")], "vault string, text string")
    p = v.pages(s, d).withColumn("frontmatter_json", F.expr("concat('{\"title\": ', if(doc_id % 3 = 0, '5', '\"x\"'), if(doc_id % 2 = 0, '', ', \"tags\": [\"a\"]'), ', \"updated\": \"2024-01-05\"}')"))
    return schema.fix_list(schema.check_schema(p, schema.schema_rules(files)))
