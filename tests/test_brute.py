"""Queries that have no SQL, against plain Python over the smallest tables."""

import collections
import itertools
import random
import re
import time

import pytest
from conftest import DATA
from pyspark.sql import functions as F

from vaultflow import registry
from vaultflow.operators import analysis, grams, journal, mentions, packs, rank, usage
from vaultflow.plans import views


@pytest.fixture(scope="module")
def page_rows(spark):
    return views.pages(spark, DATA).collect()


def test_near_duplicate_pages(spark, page_rows):
    """Every pair of a vault with a similarity of 0.35 or more, and no other."""
    sets = collections.defaultdict(list)
    for p in page_rows:
        w = re.findall("[a-z0-9][a-z0-9']*", f"{p.title} {p.plain}".lower())
        sets[p.vault].append((p.page_id, {tuple(w[i : i + 3]) for i in range(len(w) - 2)}))
    want = {}
    for vault, own in sets.items():
        for (a, x), (b, y) in itertools.combinations(sorted(own), 2):
            if x and y and (s := len(x & y) / len(x | y)) >= 0.35:
                want[vault, a, b] = round(s, 6)
    got = {(r.vault, *sorted((r.a, r.b))): r.score for r in registry.QUERIES["near_duplicate_pages"](spark, DATA).collect()}
    # Copies are paired with the least of their group only.
    assert want and set(got) <= set(want) and all(abs(want[k] - s) < 1e-6 for k, s in got.items())
    up = {}

    def top(x):
        while up.get(x, x) != x:
            x = up[x]
        return x

    for v, a, b in got:
        up[top((v, a))] = top((v, b))
    assert all(top((v, a)) == top((v, b)) for v, a, b in want)
    whole = {(v, i): frozenset(s) for v, own in sets.items() for i, s in own}
    assert {k for k in want if whole[k[0], k[1]] != whole[k[0], k[2]] and all(whole[k[0], k[j]] not in {s for (v, i), s in whole.items() if v == k[0] and i < k[j]} for j in (1, 2))} <= set(got)


def test_gap_clusters(spark):
    """Leader clustering over all searches of a vault at once."""
    rows = [r for r in views.usage(spark, DATA).collect() if r.t == "search" and r.hits == 0]
    found = collections.defaultdict(lambda: collections.defaultdict(list))
    for r in rows:
        found[r.vault][r.query.strip().lower()].append(r)
    want, lists = set(), {}
    for vault, own in found.items():
        order = sorted(own.items(), key=lambda x: (-len(x[1]), min(r.at for r in x[1]), x[0]))
        clusters = []
        for _, events in order:
            label = min((r.at, r.query.strip()) for r in events)[1]
            terms = set(usage.gap_terms(label))
            home = next((c for c in clusters if len(terms & c["terms"]) / len(terms | c["terms"]) >= 0.4), None)
            if home is None:
                clusters.append(home := {"label": label, "terms": set(), "queries": 0, "misses": 0, "last": events[0].at})
            home["terms"] |= terms
            home["queries"] += 1
            home["misses"] += len(events)
            home["last"] = max(home["last"], *(r.at for r in events))
        best = sorted(clusters, key=lambda c: c["label"])
        best = sorted(sorted(best, key=lambda c: c["last"], reverse=True), key=lambda c: -c["misses"])[:20]
        want |= {(vault, c["label"], c["queries"], c["misses"]) for c in best}
        lists[vault] = "\n".join(f"- {c['label']} ({c['misses']} misses)" for c in best)
    got = {(r.vault, r.label, r.queries, r.misses) for r in registry.QUERIES["gap_clusters"](spark, DATA).collect()}
    assert got == want and len({v for v, *_ in got}) == 3
    assert {r.vault: r.text for r in registry.QUERIES["gap_lists"](spark, DATA).collect()} == lists


def test_leaders():
    """The same clusters as by looking at every cluster, also where all queries share a word; and fast there."""
    r = random.Random(11)
    for _ in range(40):
        vocabulary = [f"t{i}" for i in range(r.choice([5, 12, 40]))]
        rows = [list(dict.fromkeys([*(["all"] if r.random() < 0.7 else []), *r.choices(vocabulary, k=r.randint(1, 5))])) for _ in range(150)]
        leaders, clusters = usage.Leaders(max(map(len, rows))), []
        for terms in rows:
            i = next((i for i, c in enumerate(clusters) if len(c & set(terms)) / len(c | set(terms)) >= 0.4), len(clusters))
            if i == len(clusters):
                clusters.append(set())
            clusters[i] |= set(terms)
            assert leaders.add(terms)[0] == i
    began, leaders = time.time(), usage.Leaders(4)
    for k in range(100_000):
        leaders.add(["all", f"a{k % 50_000}", f"b{k % 33_333}", f"c{k}"])
    assert time.time() - began < 60


def test_gap_parts(spark):
    """Parts by shared words, over a chain, a hub and lone queries."""
    t = usage.F.timestamp_seconds(usage.F.lit(0))
    names = [f"word{i:03d} word{i + 1:03d}" for i in range(60)] + [f"hub leaf{i:04d}x" for i in range(300)] + [f"lone{i:02d}q" for i in range(20)]
    log = spark.createDataFrame([("v", "search", n, 0, "ann") for n in names], "vault string, t string, query string, hits int, agent string").withColumn("at", t)
    rows = usage.cluster_gaps(log, 1_000_000).collect()
    order = sorted(names)
    clusters = []
    for n in order:
        terms = set(usage.gap_terms(n))
        home = next((c for c in clusters if len(c[1] & terms) / len(c[1] | terms) >= 0.4), None)
        if home is None:
            clusters.append(home := [n, set(), 0])
        home[1] |= terms
        home[2] += 1
    assert sorted((r.label, r.queries) for r in rows) == sorted((c[0], c[2]) for c in clusters)


def test_context_packs(spark, page_rows):
    """First fit in the order of score a token, over passages scored one by one; and what is written of it."""
    trusted = {(r.vault, r.page_id): r.trust for r in registry.QUERIES["page_trust"](spark, DATA).collect()}
    want, written = set(), {}
    for q in views.queries(spark, DATA).collect():
        words = [w for w in re.split("[^a-z0-9-]+", q.query.lower()) if len(w) > 2]
        for vault in ("v0", "v1", "v2"):
            scored = []
            for p in (p for p in page_rows if p.vault == vault):
                for pos, (heading, text) in enumerate(packs.passages_of(p.plain)):
                    hay, head, tokens = text.lower(), f"{p.title} {heading or ''}".lower(), -(-len(text) // 4)
                    base = sum(min(hay.count(w), 4) * 2 + 8 * (w in head) for w in words if w in hay or w in head)
                    if base:
                        trust = trusted[vault, p.page_id]
                        block = f"## {p.title}{f' — {heading}' if heading else ''}\n`{p.rel_path}` · {trust}\n\n{text.strip()}\n"
                        scored.append((-base * packs.TRUST_WEIGHT[trust] / max(tokens, 1), p.page_id, pos, tokens, block, p.rel_path))
            used, blocks, pages, best = 0, [], set(), {}
            for ratio, page, pos, tokens, block, path in sorted(scored):
                best.setdefault(page, (ratio, page, path))
                if used + tokens <= packs.BUDGET:
                    used += tokens
                    want.add((q.query_id, vault, page, pos, tokens))
                    blocks.append(block)
                    pages.add(page)
            rest = [path for _, page, path in sorted(best.values()) if page not in pages][:20]
            head = f"# Context: {q.query}\n\n{len(blocks)} passages · ~{used} tokens of a {packs.BUDGET} budget.\nEach passage cites its source. Prefer verified passages when they conflict.\n\n"
            tail = "\n---\nAlso matched but did not fit: " + ", ".join(f"`{x}`" for x in rest) if rest else ""
            written[q.query_id, vault] = head + "\n".join(blocks) + tail if blocks else f'No passages in the wiki matched "{q.query}". This gap has been logged.'
    got = {(r.query_id, r.vault, r.page_id, r.pos, r.tokens) for r in registry.QUERIES["context_packs"](spark, DATA).collect()}
    assert got == want
    assert {(r.query_id, r.vault): r.markdown for r in registry.QUERIES["rendered_packs"](spark, DATA).collect()} == written


def test_first_fit(spark):
    """Groups of any order and size, over several partitions and batches."""
    r = random.Random(8)
    rows = [(g, r.randint(0, 9), i, r.randint(1, 40)) for g in "abcde" for i in range(r.choice([1, 30, 400]))]
    df = spark.createDataFrame(rows, "g string, k int, i int, size int").repartition(7)
    before = spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch")
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "13")
    try:
        got = sorted((x.g, x.place, x.i, x.used) for x in packs.first_fit(df, ["g"], [F.col("k"), F.col("i")], "size", 300).collect())
    finally:
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", before)
    want = []
    for g in "abcde":
        used = place = 0
        for _, i, size in sorted((k, i, size) for x, k, i, size in rows if x == g):
            if used + size <= 300:
                used += size
                want.append((g, place, i, used))
                place += 1
    assert got == sorted(want)


def test_substring_search(spark):
    """Phrases of all lengths, beyond ASCII, repeated, and texts that repeat or are null, against a look into every text."""
    r = random.Random(9)
    texts = ["".join(r.choice("abé 語\n") for _ in range(r.choice([0, 1, 2, 3, 30, 400]))) for _ in range(120)] + ["aaa", "aaa", None]
    rows = [("v", i // 2 if i > 100 else i, t) for i, t in enumerate(texts)]
    df = spark.createDataFrame(rows, "v string, i int, t string").repartition(5)
    phrases = [None, "", "zzzz", "a", "é", "語", "ab", "\n", *("".join(r.choice("abé 語") for _ in range(r.randint(1, 6))) for _ in range(60))]
    asked = spark.createDataFrame([(p,) for p in phrases * 2], "phrase string")
    got = sorted((x.i, x.phrase, x.value) for x in grams.matches(asked, df, ["v", "i"], F.col("t"), lambda q: F.when(F.col("t").contains(q), F.length("t"))).collect())
    want = sorted((i, p, len(t)) for _, i, t in rows for p in {p for p in phrases if p} if t is not None and p in t)
    # Texts under one key are verified one by one: equal rows come as often as they stand.
    assert got == want and len(want) > 300
    plan = grams.matches(asked, df, ["v", "i"], F.col("t"), lambda q: F.when(F.col("t").contains(q), 1))._jdf.queryExecution().executedPlan().toString()
    assert "NestedLoop" not in plan and "Cartesian" not in plan


def test_authority_moves_once(spark):
    """Between two writes of the inflow, an iteration has one exchange."""
    seen, write = [], rank.materialize_by

    def spy(df, key, dealt=False):
        if dealt:
            seen.append(df._jdf.queryExecution().executedPlan().toString())
        return write(df, key, dealt)

    p = spark.createDataFrame([("v", f"p{i}") for i in range(40)], "vault string, page_id string")
    e = spark.createDataFrame([("v", f"p{i}", f"p{i * j % 41}") for i in range(40) for j in (2, 3)], "vault string, src string, dst string").distinct()
    rank.materialize_by = spy
    try:
        got = {r.page_id: r.rank for r in rank.authority(p, e, cut=5).collect()}
    finally:
        rank.materialize_by = write
    assert len(seen) == 4 and all(len(re.findall(r"Exchange hashpartitioning", x)) == 5 for x in seen)
    edges = [tuple(r)[1:] for r in e.collect()]
    degree, now = collections.Counter(a for a, _ in edges), {f"p{i}": 1 / 40 for i in range(40)}
    for _ in range(20):
        inflow = collections.Counter()
        for a, b in edges:
            inflow[b] += now[a] / degree[a]
        now = {k: 0.15 / 40 + 0.85 * inflow[k] for k in now}
    assert all(abs(got[k] - x / max(now.values())) < 1e-12 for k, x in now.items())


@pytest.mark.parametrize(("block", "orphans"), [(4000, 4000), (7, 3)])
def test_rescue_orphans(spark, block, orphans, monkeypatch):
    """The best pages by shared words, tags and folder over every pair, with pages and orphans dealt to many tasks."""
    monkeypatch.setattr(analysis, "BLOCK", block)
    monkeypatch.setattr(analysis, "ORPHANS", orphans)
    r = random.Random(12)
    words = [f"word{i:03d}" for i in range(60)]
    rows = [(v, f"p{i:02d}", r.choice(["f", "g"]), f"Title{i:02d}", " ".join(r.choices(words, k=r.choice([0, 3, 9]))) + (" common" if r.random() < 0.5 else ""), r.sample(["x", "y", "z"], r.randint(0, 2))) for v in ("v", "w") for i in range(40)]
    rows += [("v", "odd", "f", None, None, None)]
    df = spark.createDataFrame(rows, "vault string, page_id string, folder string, title string, plain string, tags array<string>")
    edges = spark.createDataFrame([("v", f"p{i:02d}", f"p{i + 1:02d}") for i in range(0, 20)], "vault string, src string, dst string")
    linked = {("v", f"p{i:02d}") for i in range(21)}
    own = {(v, i): set(re.findall("[a-z][a-z0-9-]{4,}", f"{t or ''} {x or ''}".lower())) for v, i, _, t, x, _ in rows}
    want = []
    for vault in ("v", "w"):
        pages = [x for x in rows if x[0] == vault]
        df_of = collections.Counter(w for x in pages for w in own[x[:2]])
        for _, page, folder, _, _, tags in pages:
            if (vault, page) in linked:
                continue
            found = []
            for _, other, at, _, _, theirs in pages:
                shared = sorted(w for w in own[vault, page] & own[vault, other] if df_of[w] <= len(pages) * 0.15)
                score = 2 * len(shared) + 4 * sum(t in (theirs or []) for t in tags or []) + 3 * (at == folder)
                if other != page and score >= 6:
                    found.append((-score, other, shared[:4]))
            want += [(vault, page, other, -score, shared, k) for k, (score, other, shared) in enumerate(sorted(found)[:3], 1)]
    got = [(x.vault, x.page_id, x.other, x.score, x.shared, x["rank"]) for x in analysis.rescue_orphans(df, edges).collect()]
    assert sorted(got) == sorted(want) and len(want) > 30


def test_as_of(spark):
    r = random.Random(10)
    facts = [("a" if i % 3 else "b", r.randint(0, 50), r.choice("xyz")) for i in range(80)]
    asked = [(k, t) for k in "abc" for t in (*range(-2, 55), None)]
    got = {(x.k, x.at): x.who for x in journal.as_of(spark.createDataFrame(asked, "k string, at int"), spark.createDataFrame(facts, "k string, at int, who string"), ["k"], "who").collect()}
    assert got == {(k, t): max(((at, w) for f, at, w in facts if f == k and (t is None or at <= t)), default=(0, None))[1] for k, t in asked}


def test_version_diffs(spark):
    """Taking away what was added and putting back what was removed gives the lines before."""
    rows = views.versions(spark, DATA).orderBy("vault", "rel_path", "at").collect()
    diffs = collections.defaultdict(list)
    for r in registry.QUERIES["version_diffs"](spark, DATA).collect():
        diffs[r.vault, r.rel_path, r.at].append((r.op, r.text))
    checked = 0
    for _, own in itertools.groupby(rows, key=lambda r: (r.vault, r.rel_path)):
        for a, b in itertools.pairwise(own):
            d = diffs.get((b.vault, b.rel_path, b.at), [])
            count = lambda op, d=d: collections.Counter(t for o, t in d if o == op)
            assert collections.Counter(a.text.split("\n")) - count("-") + count("+") == collections.Counter(b.text.split("\n")) and (a.text == b.text) == (not d)
            checked += 1
    assert checked


def test_search_snippets(spark, page_rows):
    """The first five hits of each search, each with the text around the phrase, or else the first of the lines with most of the query's words."""
    plain = {(p.vault, p.page_id): p.plain for p in page_rows}
    asked = {q.query_id: q.query for q in views.queries(spark, DATA).collect()}
    words = lambda t: set(re.findall("[a-z0-9][a-z0-9'-]*", t.lower()))

    def snippet(text, query):
        at = text.lower().find(query.strip().lower())
        if at >= 0:
            start = max(0, at - 60)
            return ("…" if start else "") + text[start : start + 200].strip(" ") + "…"
        lines = [x.strip(" ") for x in text.split("\n") if len(x.strip(" ")) >= 12]
        n = [len(words(x) & words(query)) for x in lines]
        return None if not n or not max(n) else (x := lines[n.index(max(n))])[:220] + "…" * (len(x) > 220)

    rows = registry.QUERIES["search_snippets"](spark, DATA).collect()
    top = {(r.query_id, r.vault, r["rank"], r.page_id) for r in registry.QUERIES["search_top10"](spark, DATA).collect() if r["rank"] <= 5}
    assert {(r.query_id, r.vault, r["rank"], r.page_id) for r in rows} == top and len(rows) == len(top)
    assert all(r.snippet == snippet(plain[r.vault, r.page_id], asked[r.query_id]) for r in rows)


def suggested(raw, self_id, targets, linked, limit=25):
    """Names longest first, each by an expression of its own with spelled-out borders; the first place that is neither masked nor claimed."""
    spans, out = [m.span() for p in mentions.MASKED for m in p.finditer(raw)], []
    if raw.startswith("---") and (end := raw.find("\n---", 3)) >= 0:
        spans.append((0, end + 4))
    names = {(n, t) for t, own in targets if t != self_id and t not in linked for n in own if len(n) >= 4 and n.lower() not in mentions.GENERIC}
    for name, target in sorted(names, key=lambda x: (-len(x[0]), *x)):
        if len(out) >= limit:
            break
        for m in re.finditer(rf"(^|[^\w\[\]-])({re.escape(name)})(?=$|[^\w-])", raw.translate(mentions.ONE_CASE), re.A | re.I):
            at, end = m.start(2), m.end(2)
            if all(end <= a or at >= b for a, b in spans):
                out.append((at, raw[at:end], target))
                spans.append((at, end))
                break
    return out


def test_link_suggestions(spark, page_rows):
    """Every suggestion of every page, and no other."""
    title = {(p.vault, p.page_id): m[0] for p in page_rows if (m := re.search("[A-Za-z]{9,}", p.plain))}
    linked = collections.defaultdict(set)
    for r in registry.QUERIES["link_edges"](spark, DATA).collect():
        linked[r.vault, r.src].add(r.dst)
    alias = {(p.vault, p.page_id): p.aliases for p in page_rows}
    want = set()
    for p in page_rows:
        targets = [(i, [t, *alias[v, i]]) for (v, i), t in title.items() if v == p.vault]
        want |= {(p.vault, p.page_id, *x) for x in suggested(p.plain, p.page_id, targets, linked[p.vault, p.page_id])}
    rows = registry.QUERIES["link_suggestions"](spark, DATA).collect()
    assert want and {(r.vault, r.page_id, r.at, r.mention, r.target) for r in rows} == want
    text = {(p.vault, p.page_id): p.plain for p in page_rows}
    assert all(r.mention in r.line or len(r.line) == 200 for r in rows) and all(r.line in text[r.vault, r.page_id] for r in rows)
    changed = {(r.vault, r.rel_path): r.text for r in registry.QUERIES["linked_pages"](spark, DATA).collect()}
    for v, i in {(v, i) for v, i, *_ in want}:
        raw = text[v, i]
        for _, _, at, mention, _ in sorted((x for x in want if x[:2] == (v, i)), key=lambda x: -x[2]):
            raw = f"{raw[:at]}[[{mention}]]{raw[at + len(mention):]}"
        assert changed[v, f"{i}.md"] == raw


@pytest.mark.parametrize(("at_once", "together"), [(50_000, 4000), (3, 2)])
def test_mentions_of_odd_pages(spark, at_once, together, monkeypatch):
    """Names in code, links and headings, names that overlap, that many pages bear, with signs and beyond ASCII; several automata and tasks."""
    monkeypatch.setattr(mentions, "NAMES", at_once)
    monkeypatch.setattr(mentions, "TEXTS", together)
    monkeypatch.setattr(mentions.mentioned, "__defaults__", (at_once, together))
    names = {"a": ["Context"], "b": ["Context Window", "the window"], "c": ["Élan vital", "C++ guide"], "d": ["Shared name"], "e": ["shared name"], "f": ["Shared Name", "notes", "abc"], "g": ["(x) y"], "h": ["Window Pane"]}
    texts = {
        "a": "---\ntitle: Context Window\n---\n# Context Window\nthe context window pane, `Context Window` and [[Context Window]]. élan VITAL",
        "b": "Context\ncontext-free Context_ [Context](x) https://q/Context contexts (Context)",
        "c": "shared name, shared name; SHARED NAME and shared name.\nC++ guide C++ guides",
        "d": "shared name shared name (x) y(x) y (x) y",
        "e": "",
        "f": "the window pane ```Context``` Élan vitalé élan vital notes",
        "z": None,
    }
    files = spark.createDataFrame([("v", f"{k}.md", t) for k, t in texts.items()] + [("w", "a.md", "Context Window")], "vault string, rel_path string, text string")
    pages = spark.createDataFrame([("v", k, n[0], n[1:]) for k, n in names.items()], "vault string, page_id string, title string, aliases array<string>")
    edges = spark.createDataFrame([("v", "c", "d"), ("v", "b", "h")], "vault string, src string, dst string")
    linked = {"c": {"d"}, "b": {"h"}}
    got = sorted((r.page_id, r.at, r.mention, r.target) for r in mentions.suggest_links(files, pages, edges).collect())
    assert got == sorted((k, *x) for k, t in texts.items() for x in suggested(t or "", k, list(names.items()), linked.get(k, set())))
    assert len(got) > 8
