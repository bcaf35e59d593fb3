"""Streams give what their batch forms give."""

import datetime as dt
import json
import time

from pyspark.sql import functions as F

from vaultflow.operators import journal
from vaultflow.streaming import jobs

AT = dt.datetime(2024, 1, 1)
ROWS = [("v", "p", 0, "a"), ("v", "p", 1, "a"), ("v", "p", 2, "a\nb"), ("v", "q", 1, "x"), ("v", "p", 3, "c"), ("v", "q", 2, None)]


def source(spark, tmp_path, rows, schema):
    folder = tmp_path / "in"
    folder.mkdir()
    (folder / "a.json").write_text("\n".join(json.dumps(r) for r in rows))
    return spark.readStream.schema(schema).json(str(folder))


def drain(df, name, mode="append"):
    q = df.writeStream.format("memory").queryName(name).outputMode(mode).trigger(availableNow=True).start()
    q.awaitTermination(120)
    return df.sparkSession.table(name).collect()


def test_journal_stream(spark, tmp_path):
    schema = "vault string, rel_path string, at timestamp, text string"
    rows = [{"vault": v, "rel_path": p, "at": (AT + dt.timedelta(hours=h)).isoformat(), "text": t} for v, p, h, t in ROWS]
    got = {(r.rel_path, r.at, r.kind, r.replaced) for r in drain(jobs.journal_stream(source(spark, tmp_path, rows, schema)), "j")}
    batch = spark.createDataFrame([(v, p, AT + dt.timedelta(hours=h), t) for v, p, h, t in ROWS], schema)
    assert {x[:3] for x in got} == {(r.rel_path, r.at, r.kind) for r in journal.classify_writes(batch).collect()}
    assert ("p", AT + dt.timedelta(hours=3), "rewritten", "a\nb") in got and ("q", AT + dt.timedelta(hours=2), "deleted", "x") in got


def test_usage_windows(spark, tmp_path):
    schema = "vault string, at timestamp, t string, hits int"
    rows = [{"vault": "v", "at": (AT + dt.timedelta(hours=h)).isoformat(), "t": t, "hits": n} for h, t, n in ((1, "read", None), (2, "search", 0), (30, "search", 3))]
    got = {(r.start, r.reads, r.searches, r.misses) for r in drain(jobs.usage_windows(source(spark, tmp_path, rows, schema)), "u", "complete")}
    assert got == {(AT, 1, 1, 1), (AT + dt.timedelta(days=1), 0, 1, 0)}


def test_debounce_feed_and_hooks(spark):
    f = spark.createDataFrame([("v", "p", AT + dt.timedelta(milliseconds=m), str(m)) for m in (0, 300, 600, 2000)], "vault string, rel_path string, at timestamp, text string")
    assert sorted(r.text for r in jobs.debounced(f).collect()) == ["2000", "600"]
    assert jobs.change_feed(f, AT, AT + dt.timedelta(milliseconds=600)).count() == 2
    a = spark.createDataFrame([("v", "edited"), ("v", "read")], "vault string, kind string")
    h = spark.createDataFrame([("v", "u1", [], True), ("v", "u2", ["read"], True), ("v", "u3", [], False)], "vault string, url string, kinds array<string>, enabled boolean")
    assert sorted((r.url, r.kind) for r in jobs.route(a, h).collect()) == [("u1", "edited"), ("u1", "read"), ("u2", "read")]
    p = spark.createDataFrame([("v", "p.md", AT, "h")], "vault string, rel_path string, mtime timestamp, hash string")
    assert jobs.events_from_times(p).select(F.sum("lines_added")).first()[0] == 0


def rows_of(folder, name, rows):
    folder.mkdir(exist_ok=True)
    (folder / name).write_text("\n".join(json.dumps(r) for r in rows))


def run(df, tmp_path, name, mode="append"):
    """One run to the end of what is there, with a checkpoint, into Parquet; the next run goes on from it."""
    out = str(tmp_path / name)
    df.writeStream.format("parquet").option("checkpointLocation", f"{out}-state").option("path", out).outputMode(mode).trigger(availableNow=True).start().awaitTermination(120)
    return df.sparkSession.read.schema(df.schema).parquet(out).collect()


def test_journal_goes_on_after_a_restart(spark, tmp_path):
    schema, folder = "vault string, rel_path string, at timestamp, text string", tmp_path / "in"
    row = lambda h, t: {"vault": "v", "rel_path": "p", "at": (AT + dt.timedelta(hours=h)).isoformat(), "text": t}
    rows_of(folder, "a.json", [row(0, "a")])
    assert [r.kind for r in run(jobs.journal_stream(spark.readStream.schema(schema).json(str(folder))), tmp_path, "out")] == ["created"]
    rows_of(folder, "b.json", [row(1, "a"), row(2, "a\nb")])
    got = sorted((r.at, r.kind) for r in run(jobs.journal_stream(spark.readStream.schema(schema).json(str(folder))), tmp_path, "out"))
    assert got == [(AT, "created"), (AT + dt.timedelta(hours=2), "appended")]


def test_late_rows_are_dropped(spark, tmp_path):
    schema, folder = "vault string, at timestamp, t string, hits int", tmp_path / "in"
    row = lambda h: {"vault": "v", "at": (AT + dt.timedelta(hours=h)).isoformat(), "t": "read", "hits": None}
    stream = lambda: jobs.usage_windows(spark.readStream.schema(schema).json(str(folder)))
    for name, hours in (("a.json", [1, 2]), ("b.json", [60]), ("c.json", [3, 61]), ("d.json", [120])):
        rows_of(folder, name, [row(h) for h in hours])
        got = run(stream(), tmp_path, "out")
    assert {(r.start, r.reads) for r in got} == {(AT, 2), (AT + dt.timedelta(days=2), 2)}  # the row of hour 3 came after its day was closed


def test_bursts_feed_and_hooks_as_streams(spark, tmp_path):
    schema, folder = "vault string, rel_path string, at timestamp, text string, kind string", tmp_path / "in"
    row = lambda s, t: {"vault": "v", "rel_path": "p", "at": (AT + dt.timedelta(seconds=s)).isoformat(), "text": t, "kind": "edited"}
    rows_of(folder, "a.json", [row(0, "a"), row(0.2, "b"), row(5, "c"), row(600, "d")])
    stream = spark.readStream.schema(schema).json(str(folder))
    run(jobs.debounced(stream), tmp_path, "bursts")
    rows_of(folder, "b.json", [row(1200, "e")])
    got = run(jobs.debounced(spark.readStream.schema(schema).json(str(folder))), tmp_path, "bursts")
    assert {(r.text, r.writes) for r in got} >= {("b", 2), ("c", 1)}
    assert len(run(jobs.change_feed(stream, AT, AT + dt.timedelta(seconds=600)), tmp_path, "feed")) == 3
    hooks = spark.createDataFrame([("v", "u1", [], True), ("v", "u2", ["read"], True)], "vault string, url string, kinds array<string>, enabled boolean")
    assert {r.url for r in run(jobs.route(stream, hooks), tmp_path, "hooks")} == {"u1"}


def test_debounce_by_clock(spark, tmp_path):
    """A burst gives one row soon after its last write, with no later row to wake the stream."""
    provider = "spark.sql.streaming.stateStore.providerClass"
    before = spark.conf.get(provider)
    spark.conf.set(provider, "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")
    try:
        schema = "vault string, rel_path string, at timestamp, text string"
        at = lambda ms: (AT + dt.timedelta(milliseconds=ms)).isoformat()
        rows_of(tmp_path / "in", "a.json", [{"vault": "v", "rel_path": "p", "at": at(m), "text": str(m)} for m in (0, 300, 100)])
        stream = jobs.debounced_by_clock(spark.readStream.schema(schema).json(str(tmp_path / "in")), 400)
        q = stream.writeStream.format("memory").queryName("quiet").outputMode("append").option("checkpointLocation", str(tmp_path / "cp")).start()
        try:
            deadline = time.time() + 90
            while time.time() < deadline and not spark.table("quiet").count():
                time.sleep(0.2)
            assert [(r.rel_path, r.text, r.writes) for r in spark.table("quiet").collect()] == [("p", "300", 3)]
            rows_of(tmp_path / "in", "b.json", [{"vault": "v", "rel_path": "p", "at": at(5000), "text": None}, {"vault": "v", "rel_path": "q", "at": at(1), "text": "x"}])
            while time.time() < deadline and spark.table("quiet").count() < 3:
                time.sleep(0.2)
            assert sorted((r.rel_path, str(r.text), r.writes) for r in spark.table("quiet").collect()) == [("p", "300", 3), ("p", "None", 1), ("q", "x", 1)]
        finally:
            q.stop()
    finally:
        spark.conf.set(provider, before)
