"""Small hand-made cases."""

import datetime as dt

import pandas as pd
from pyspark.sql import functions as F

from vaultflow.functions import text
from vaultflow.operators import analysis, grams, ingest, journal, links, mentions, packs, pages, rank, schema, similar, trust, usage, vectors
from vaultflow.sources import files as sources

NOW = "2024-02-01 00:00:00"
T = lambda d: dt.datetime(2024, 1, d)


def vault(spark, *rows):
    return spark.createDataFrame([("v", p, t, T(1)) for p, t in rows], "vault string, rel_path string, text string, mtime timestamp")


def parsed(spark, *rows):
    return pages.parse_pages(vault(spark, *rows))


def edges(p):
    return sorted((r.src, r.dst) for r in links.resolve_links(p).collect())


def test_tags(spark):
    body = "---\ntags: [a, '#b']\n---\n#F0837BEC5B308 #AB1234 #IFDEF #project/x #follow-up `#code` " + " ".join(f"#t{'x' * i}" for i in range(1, 15))
    tags = parsed(spark, ("n.md", body)).first().tags
    assert tags[:4] == ["a", "b", "project/x", "follow-up"] and len(tags) == 2 + 12


def test_frontmatter_and_titles(spark):
    p = parsed(spark, ("a/bad.md", "---\ntitle: [\n---\nx"), ("b.md", "---\ntitle: 5\n---\n# Head\nx"), ("c.md", "# Only *this*\n"), ("d.md", "plain"), ("e.md", "---\nname: Named\naliases:\n  - one\n  - two\n---\n"))
    by = {r.page_id: r for r in p.collect()}
    assert by["a/bad"].title == "bad" and by["a/bad"].parse_error and "title" in by["a/bad"].plain
    assert (by["b"].title, by["c"].title, by["d"].title, by["e"].title) == ("Head", "Only *this*", "d", "Named")
    assert by["e"].aliases == ["one", "two"] and by["e"].words == 0 and by["a/bad"].folder == "a"
    assert [r.rel_path for r in pages.parse_errors(p).collect()] == ["a/bad.md"]


def test_plain(spark):
    assert parsed(spark, ("n.md", "# H\n> q `x` ![i](u) [[a|b]] [[c]] [t](u) **b**\n```\ncode\n```\n")).first().plain == "H q b c t b"


def test_links(spark):
    p = parsed(spark, ("specs/spec.md", ""), ("me.md", "[[me]] [[spec#h|x]] [s](../specs/spec.md) [w](https://x) [[old-name]]"), ("new.md", "---\naliases: [old-name]\n---\n"))
    assert edges(p) == [("me", "new"), ("me", "specs/spec")]
    assert sorted(r.target for r in links.dead_links(p).collect()) == ["old-name"]
    assert links.dead_links(p, include_aliases=True).count() == 0
    two = parsed(spark, ("a/spec.md", ""), ("b/spec.md", ""), ("me.md", "[[spec]]"))
    assert edges(two) == [] and links.dead_links(two).count() == 0 and links.dead_links(two, strict=True).count() == 1


def test_ignore(spark):
    f = vault(spark, ("secret/a.md", ""), ("x/secret/b.md", ""), ("notes/n1.md", ""), ("notes/deep/n2.md", ""))
    left = lambda *p: sorted(r.rel_path for r in sources.apply_ignore(f, list(p)).collect())
    assert left("# c", "secret/") == ["notes/deep/n2.md", "notes/n1.md"]
    assert left("/secret") == ["notes/deep/n2.md", "notes/n1.md", "x/secret/b.md"]
    assert left("notes/*.md") == ["notes/deep/n2.md", "secret/a.md", "x/secret/b.md"] and left("notes/**.md")[0] == "secret/a.md"


def test_read_vault(spark, tmp_path):
    for name in ("a.md", "sub dir/b.mdx", "node_modules/c.md", "d.txt"):
        (tmp_path / name).parent.mkdir(exist_ok=True)
        (tmp_path / name).write_text("x")
    assert sorted(r.rel_path for r in sources.read_vault(spark, str(tmp_path), "v").collect()) == ["a.md", "sub dir/b.mdx"]


def test_logs(spark, tmp_path):
    (tmp_path / "u.jsonl").write_text('{"t":"read","at":"2024-01-05T00:00:00Z","agent":"a","vault":"v","page":"p"}\n{"t":"read","at":"2024-01-0')
    assert sources.read_log(spark, str(tmp_path / "u.jsonl"), sources.USAGE).count() == 1
    (tmp_path / "l.json").write_text('{"p":{"hash":"h","by":"ann"},"q":{"hash":"i"}}')
    assert sorted(map(tuple, sources.read_store(spark, str(tmp_path / "l.json"), "hash:string,by:string").collect())) == [("p", "h", "ann"), ("q", "i", None)]


def test_write_kinds():
    c = journal.classify_texts
    assert c(None, "a\nb") == ("created", 2, 0) and c("a\nb", "a\nb\nc") == ("appended", 1, 0) and c("a", None)[0] == "deleted"
    assert c("a\n", "a\nb\n") == ("rewritten", 1, 0) and c("a\nx\nb", "a\ny\nb") == ("rewritten", 1, 1) and c("a", "a")[0] is None
    assert c("a\n", "a\nb\n", ignore_final_newline=True)[0] == "appended"


def test_blame(spark):
    f = spark.createDataFrame([("v", "p.md", "old\nnew\n\nnever")], "vault string, rel_path string, text string")
    v = spark.createDataFrame([("v", "p.md", T(2), "old"), ("v", "p.md", T(4), "old\nnew")], "vault string, rel_path string, at timestamp, text string")
    a = spark.createDataFrame([(T(1), "/r/p.md", "x", "t"), (T(3), "/r/p.md", "y", "t")], "at timestamp, file string, agent string, tool string")
    rows = {r.line: (r.agent, r.at) for r in journal.blame(f, v, a).collect()}
    assert rows == {1: (None, None), 2: ("y", T(4)), 3: (None, None), 4: ("x", T(2))}


def test_trust_and_renames(spark):
    p = spark.createDataFrame([("v", "a", "1"), ("v", "b", "2"), ("v", "c", "3"), ("v", "d", "4"), ("v", "e", "9")], "vault string, page_id string, hash string")
    led = spark.createDataFrame([("v", "a", "1", dt.datetime(2024, 1, 20)), ("v", "b", "x", T(1)), ("v", "c", "3", dt.datetime(2023, 10, 1)), ("v", "gone", "9", T(1))], "vault string, page_id string, hash string, at timestamp")
    assert {r.page_id: r.trust for r in trust.with_trust(p, led, NOW).collect()} == {"a": "verified", "b": "lapsed", "c": "aging", "d": "unverified", "e": "unverified"}
    assert "e" in [r.page_id for r in trust.reconcile_renames(led, p).collect()]
    two = p.union(spark.createDataFrame([("v", "f", "9")], p.schema))
    assert "gone" in [r.page_id for r in trust.reconcile_renames(led, two).collect()]


def test_review_windows(spark):
    row = spark.createDataFrame([("client-stack-setup", "")], "page_id string, title string")
    days = lambda rules: row.select(trust.window_days(F.col("page_id"), F.col("title"), rules)).first()[0]
    assert days(trust.HEALTH_RULES) == 90 and days(trust.POLICY_RULES) == 60 and days((("/[/", 1, ""), (" ", 2, ""))) == 180


def test_gap_clusters(spark):
    q = [("search", T(1), "a", "v", x, 0) for x in ("stripe webhook", "stripe webhook", "stripe webhooks", "how do stripe webhooks work", "tax returns")]
    u = spark.createDataFrame(q, "t string, at timestamp, agent string, vault string, query string, hits int")
    rows = usage.cluster_gaps(u).orderBy("rank").collect()
    assert [(r.label, r.misses) for r in rows] == [("stripe webhook", 4), ("tax returns", 1)]


def test_contradictions(spark):
    claims = [("a", "The timeout is 30 seconds."), ("b", "the timeout is 5 seconds"), ("c", "the timeout is 30 minutes")]
    p = spark.createDataFrame([("v", i, i, t, "h", T(1)) for i, t in claims], "vault string, page_id string, title string, plain string, hash string, mtime timestamp")
    led = spark.createDataFrame([], "vault string, page_id string, hash string, at timestamp")
    assert sorted((r.page_id, r.value) for r in analysis.contradictions(p, led, NOW).collect()) == [("a", "30"), ("b", "5")]


def test_pack_fill(spark):
    s = spark.createDataFrame([(1, "v", "a", 0, 600, 60.0), (1, "v", "b", 0, 500, 45.0), (1, "v", "c", 0, 90, 8.0), (1, "v", "d", 0, 900, 99.0)], "query_id int, vault string, page_id string, pos int, tokens bigint, score double")
    taken, omitted = packs.fill_budget(s, 700)
    assert [r.page_id for r in taken.orderBy("place").collect()] == ["a", "c"] and sorted(r.page_id for r in omitted.collect()) == ["b", "d"]


def test_passages():
    assert packs.passages_of("intro\n# H\nbody\n## E\n") == [(None, "intro"), ("H", "body")]
    long = "\n\n".join("x" * 900 for _ in range(3))
    assert [len(t) for _, t in packs.passages_of(long)] == [900, 900, 900]


def test_mentions():
    raw = "# Context Window\nthe Context Window and Context, `Context`, [[Context]] https://x/Context ending Context-free"
    places = mentions.free_places(raw, mentions.automaton(["CONTEXT", "CONTEXT WINDOW"]))
    names = [{"places": places[n.upper()], "bearers": [{"name": n, "target": t}]} for n, t in (("Context", "c"), ("Context Window", "w"))]
    assert [(s["mention"], s["target"]) for s in mentions.choose(names, 25, False)] == [("Context Window", "w"), ("Context", "c")]
    assert mentions.put_links("a Context b", [(2, "Context"), (9, "zz")]) == "a [[Context]] b"


def test_schema_rules(spark):
    md = "# Tags\n- `hermes`\n## Frontmatter\n| field | required |\n|---|---|\n| title | yes |\n- `owner`: optional text\n```yaml\nupdated: YYYY-MM-DD\ntags: [x]\n```\n"
    bare = "- `id`: number, always\n* **when** a date\n+ plain: a list, if present\n- just words\n```\nno: 1\n```\n| x |\n| Status | n | text |\n"
    files = spark.createDataFrame([("a", md), ("b", bare), ("c", None), ("d", "# Fields\n" + "\n".join(f"- f{i}:" for i in range(40)) + "\n- `f1`: date")], "vault string, text string")
    got = {}
    for r in schema.schema_rules(files).orderBy("vault", "ord").collect():
        got.setdefault(r.vault, []).append((r.name, r.required, r.kind))
    assert got["a"] == [("title", True, "any"), ("owner", False, "string"), ("updated", True, "date"), ("tags", True, "list")]
    assert got["b"] == [("id", True, "any"), ("when", True, "date"), ("plain", False, "list"), ("Status", False, "string")]
    assert got["d"] == [(f"f{i}", True, "any") for i in range(24)] and "c" not in got


def test_ingest(spark):
    title, md = ingest.html_page("<title>t</title><nav>n</nav><article><h1>A &amp; B</h1><p>x <b>y</b> <a href='#z'>z</a><a href=\"https://q\">q</a></p><ul><li>i</li></ul></article>")
    assert title == "A & B" and "**y**" in md and "[q](https://q)" in md and "- i" in md and "# A" not in md and "n" not in md.split()
    assert ingest.html_page("<h1>T</h1><main><h1>T</h1><h2>a <code>b</code></h2><p>x<br>y</p><pre>p <b>q</b></pre><ul><li>i <a href='//l'>k</a></li></ul></main>") == ("T", "## a b\n\nx\ny\n\n```\np q\n```\n\n- i [k](//l)")
    assert ingest.html_page("<nav>n<p>a</p>") == ("Untitled", "n\na") and ingest.html_page(None) == ("Untitled", "")
    raw = spark.createDataFrame([(1, "intro\nAnn: a\n[00:01] Ann: b\nmore\n\nBob: c"), (2, " no labels here ")], "conv_id int, text string")
    assert {r.conv_id: r.text for r in ingest.structure_transcripts(raw).collect()} == {1: "_2 speakers: Ann, Bob._\n\n**Ann**\n\na b more\n\n**Bob**\n\nc", 2: "no labels here"}
    assert ingest.stamp("x", "2024-01-01") == "---\nverified_on: 2024-01-01\n---\n\nx"
    assert ingest.stamp("---\na: 1\nverified_on: 2023-01-01\n---\nx", "2024-01-01") == "---\na: 1\nverified_on: 2024-01-01\n---\nx"
    assert ingest.stamp("---\nverified_on: 2023-01-01\n---\nx", None) == "x"
    r = spark.createDataFrame([("Sure: \"A fine day. More\"", "# Title here.")], "a string, b string").select(ingest.to_summary(F.col("a")), ingest.to_title(F.col("b"))).first()
    assert tuple(r) == ("A fine day.", "Title here")
    tags = ingest.to_tags(spark.createDataFrame([("v", 1, '["Some Tag", "new one", "a b c d e f"]')], "vault string, id int, raw string"), spark.createDataFrame([("v", "Some-Tag")], "vault string, tag string"))
    assert tags.first().tags == ["Some-Tag", "new-one", "a-b-c-d-e-f"]
    blob = spark.createDataFrame([(bytearray(b"\x89PNG1"),), (bytearray(b"\x89PNG1"),), (bytearray(b"<svg"),)], "content binary")
    assert [r.ext for r in ingest.store_attachments(blob).collect()] == ["png"]


def test_merge_and_source(spark):
    f = vault(spark, ("a.md", "A\n"), ("b.md", "---\nx: 1\n---\n# B\nbody"))
    m = spark.createDataFrame([("v", "a.md", "b.md", "B")], "vault string, keep string, lose string, title string")
    by = {r.rel_path: r.text for r in links.merge_pages(f, m).collect()}
    assert by["a.md"] == "A\n\n## Merged from B\n\nbody\n" and "merged_into" in by["b.md"] and "[[a]]" in by["b.md"]
    s = spark.createDataFrame([("v", "b.md", "u"), ("v", "a.md", "w")], "vault string, rel_path string, source string")
    by = {r.rel_path: r.text for r in links.set_source(f, s).collect()}
    assert by["b.md"].startswith('---\nsource: "u"\nx: 1') and by["a.md"].startswith('---\nsource: "w"\n---\n\nA')


def test_near_duplicates_recall(spark):
    words = [f"w{i}" for i in range(400)]
    docs = [("v", "a", "", " ".join(words)), ("v", "b", "", " ".join(words[:300])), ("v", "c", "", " ".join(words[::-1])), ("v", "d", "", " ".join(words)), ("v", "e", "", "two words"), ("v", "f", None, None)]
    got = {(r.a, r.b): r.score for r in similar.near_duplicates(spark.createDataFrame(docs, "vault string, id string, title string, text string")).collect()}
    assert got[("a", "d")] == 1.0 and abs(got[("a", "b")] - 298 / 398) < 1e-9 and set(got) == {("a", "d"), ("a", "b")}


def test_search_finds_words_apart(spark):
    p = parsed(spark, ("x.md", "backup of the postgres cluster"), ("y.md", "other things"))
    q = spark.createDataFrame([(1, "postgres backup")], "query_id bigint, query string")
    hits = rank.search(q, p, *rank.inverted_index(p), rank.authority(p, links.resolve_links(p)))
    assert [r.page_id for r in hits.collect()] == ["x"]


def test_related_blocks_agree(spark):
    import numpy as np

    m = np.random.default_rng(3).normal(size=(60, 8))
    m /= np.linalg.norm(m, axis=1, keepdims=True)
    v = spark.createDataFrame([("v", f"p{i // 2}", i % 2, [float(x) for x in m[i]]) for i in range(60)], "vault string, page_id string, chunk_no int, embedding array<float>")
    rows = lambda b: sorted((r.src, r.page_id, round(r.score, 6)) for r in vectors.related(v, block=b).collect())
    assert rows(2048) == rows(7)


def test_allocate_paths(spark):
    new = spark.createDataFrame([("v", "f", "My Note", 1), ("v", "f", "My Note", 2)], "vault string, folder string, title string, id int")
    old = spark.createDataFrame([("v", "f/my-note.md"), ("v", "f/my-note-3.md")], "vault string, rel_path string")
    assert sorted(r.rel_path for r in links.allocate_paths(new, old).collect()) == ["f/my-note-2.md", "f/my-note-4.md"]


def test_templates(spark):
    r = spark.createDataFrame([("Hello, World!",)], "t string")
    path = r.select(text.target_path(F.lit("/{{year}}/"), F.lit("{{slug}}"), F.col("t"), NOW)).first()[0]
    assert path == "2024/hello-world.md"


def test_diff():
    out = journal.diff_lines.__wrapped__(pd.Series(["a\nb\nc\nd"]), pd.Series(["a\nb\nX\nd"]))[0]
    assert [(r["op"], r["text"]) for r in out] == [(" ", "a"), (" ", "b"), ("-", "c"), ("+", "X"), (" ", "d")]


def test_chunks_hold_every_word(spark):
    words = [f"w{i}" for i in range(20_000)]
    p = spark.createDataFrame([("v", "long", "T", " ".join(words)), ("v", "short", "T", "one two"), ("v", "none", "T", "")], "vault string, page_id string, title string, plain string")
    rows = pages.chunks(p).orderBy("page_id", "chunk_no").collect()
    texts = [r.text.split("\n", 1)[1].split(" ") for r in rows if r.page_id == "long"]
    assert set().union(*texts) == set(words) and all(a[-40:] == b[:40] for a, b in zip(texts, texts[1:], strict=False))
    assert [r.text for r in rows if r.page_id != "long"] == ["T\none two"]
    assert pages.chunks(p, most=24).filter("page_id = 'long'").count() == 24


def test_semantic_search_of_many_queries(spark):
    import numpy as np

    m = np.random.default_rng(4).normal(size=(40, 8))
    m /= np.linalg.norm(m, axis=1, keepdims=True)
    x = spark.createDataFrame([(f"v{i % 2}", f"p{i // 4}", [float(y) for y in m[i]]) for i in range(40)], "vault string, page_id string, embedding array<float>")
    q = spark.range(10_001).select(F.col("id").alias("query_id"), F.element_at(F.lit(m.tolist()).cast("array<array<float>>"), (F.col("id") % 40 + 1).cast("int")).alias("embedding"))
    want = {}
    s = m.astype(np.float32).astype(float) @ m.astype(np.float32).astype(float).T
    for a, b in zip(*np.nonzero(s >= vectors.FLOOR), strict=True):
        page = (int(a), f"v{b % 2}", f"p{b // 4}")
        want[page] = max(want.get(page, 0), s[a, b])
    best = {k[:2]: max(w for l, w in want.items() if l[:2] == k[:2]) for k in want}
    want = {k: round(w, 6) for k, w in want.items() if w >= vectors.RELATIVE * best[k[:2]]}
    for block in (vectors.WIDE, 500):
        rows = vectors.semantic_search(q, x, limit=1000, block=block).select((F.col("query_id") % 40).alias("k"), "query_id", "vault", "page_id", F.round("score", 6).alias("score")).collect()
        assert {(r.k, r.vault, r.page_id): r.score for r in rows} == want
        assert len({r.query_id for r in rows}) == 10_001 and len(rows) == sum(250 + (k[0] == 0) for k in want)
    assert vectors.semantic_search(q, x.limit(0)).count() == vectors.semantic_search(q.limit(0), x).count() == 0


def test_orphans_whole_and_all(spark):
    rare = [f"rare{i}a rare{i}b rare{i}c" for i in range(30)]
    filler = "x " * 3000
    rows = [("v", f"{side}{i:02}", "", filler + rare[i], "f" + side, []) for i in range(30) for side in "ab"]
    p = spark.createDataFrame(rows, "vault string, page_id string, title string, plain string, folder string, tags array<string>")
    none = spark.createDataFrame([], "vault string, src string, dst string")
    got = sorted((r.page_id, r.other, r.score) for r in analysis.rescue_orphans(p, none).collect())
    assert got == sorted((f"{x}{i:02}", f"{y}{i:02}", 6) for i in range(30) for x, y in ("ab", "ba"))
    assert analysis.rescue_orphans(p, none, letters=4000).count() == 0
    assert {r.page_id for r in analysis.rescue_orphans(p, none, limit=25).collect()} == {f"a{i:02}" for i in range(25)}


def test_near_duplicates_at_the_threshold(spark):
    say = lambda k, n: " ".join(f"{k}x{i}" for i in range(n))
    docs = [("v", f"{i}{side}", "", f"{say(i, shared)} {say(f'{i}{side}', 102 - shared)}") for i in range(300) for shared in [54 if i % 2 else 53] for side in "ab"]
    got = {(r.a, r.b, round(r.score, 6)) for r in similar.near_duplicates(spark.createDataFrame(docs, "vault string, id string, title string, text string")).collect()}
    assert got == {(f"{i}a", f"{i}b", round(52 / 148, 6)) for i in range(1, 300, 2)}


def test_writes_of_empty_texts():
    assert journal.classify_texts(None, "") == ("created", 0, 0) and journal.classify_texts(None, "a\nb") == ("created", 2, 0)
    assert journal.common_ends(["a", "b", "c"], ["a", "x", "b", "c"]) == (1, 2) and journal.common_ends(["a"], ["a", "a"]) == (1, 0) and journal.common_ends([], ["a"]) == (0, 0)


def test_shared_phrases():
    run = [f"w{i}" for i in range(40)]
    assert similar.shared_phrases(["x", *run, "y"], ["p", *run, "q"]) == [" ".join(run[:12])]
    assert similar.shared_phrases(["a", "b"], ["a", "b"]) == []


def test_long_chains_of_gaps(spark):
    """Queries that hang together through more words than any fixed number of rounds would follow."""
    rows = [("v", "search", T(1), "a", f"alpha{i} alpha{i + 1}", 0) for i in range(70)]
    u = spark.createDataFrame(rows, "vault string, t string, at timestamp, agent string, query string, hits int")
    out = usage.cluster_gaps(u, limit=100).collect()
    assert sum(r.queries for r in out) == 70


def test_embedded_chunks(spark):
    p = spark.createDataFrame([("v", "a", "Harbour", "boats in the harbour " * 80), ("v", "b", "Forest", "trees in the forest " * 80)], "vault string, page_id string, title string, plain string")
    c = vectors.embed_chunks(pages.chunks(p))
    got = c.collect()
    assert all(abs(sum(x * x for x in r.embedding) - 1) < 1e-5 for r in got) and {(r.page_id, r.chunk_no) for r in got} == {("a", 0), ("a", 1), ("b", 0), ("b", 1)}
    asked = spark.createDataFrame([(1, vectors.hashing_embedder(["boats harbour"])[0].tolist())], "query_id long, embedding array<double>")
    assert [r.page_id for r in vectors.semantic_search(asked, c).collect()] == ["a"]


def test_phrases_inside_words(spark):
    p = spark.createDataFrame([("v", "a b c", "T one", ["x y z"], "the quick brown-fox jumps"), ("v", "q", "Quick", [], "unquick brown-fox jumpsuit")], "vault string, page_id string, title string, tags array<string>, plain string")
    q = spark.createDataFrame([(1, "quick brown-fox jump"), (2, "x y z"), (3, "quick"), (4, "A b C"), (5, "")], "query_id long, query string")
    holds = lambda q: F.lower("title").contains(q) | F.lower("plain").contains(q) | F.lower("page_id").contains(q) | F.exists("tags", lambda g: F.lower(g).contains(q))
    asked, hay = rank.phrases_of(q), F.lower(F.concat_ws("\n", "title", "page_id", F.array_join("tags", "\n"), "plain"))
    hits = grams.matches(asked, p, ["vault", "page_id"], hay, lambda q: F.when(holds(q), True)).join(asked, "phrase")
    got = sorted((r.query_id, r.page_id) for r in hits.collect())
    assert got == [(1, "a b c"), (1, "q"), (2, "a b c"), (3, "a b c"), (3, "q"), (4, "a b c")]


def test_nested_frontmatter():
    import json

    read = lambda t: (x := pages.frontmatter_json(t)) and json.loads(x)
    assert read("a: 1\nb:\n  c: [x, 'y, z']\n  d:\n    - e\n    - f: 1\n      g: two\nh: |\n  line\n   more\n\ni: >-\n  one\n  two\n\n  three\nj: \"k: l\" \nm: n # note") == {
        "a": 1, "b": {"c": ["x", "y, z"], "d": ["e", {"f": 1, "g": "two"}]}, "h": "line\n more\n", "i": "one two\nthree", "j": "k: l", "m": "n"}
    assert read("tags:\n- a\n- b\nlink: https://x.org/a") == {"tags": ["a", "b"], "link": "https://x.org/a"}
    assert read("") == {} and read("# only\n") == {} and read("a:\nb:") == {"a": None, "b": None}
    for bad in ("title: [", "- a", "just text", "a: b: c", "a: 1\n  b: 2", "a: {b: 1}", "x: 1\nplain"):
        assert read(bad) is None, bad
