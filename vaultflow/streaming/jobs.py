"""Streams: the write journal, debounced writes, usage windows, the change feed and hooks."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout
from pyspark.sql.streaming.stateful_processor import StatefulProcessor, StatefulProcessorHandle

from ..operators.journal import classify_texts

JOURNAL = "vault string, rel_path string, at timestamp, kind string, lines_added int, lines_removed int, hash string, replaced string"


def _journal(key, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
    import hashlib

    before = state.get[0] if state.exists else None
    rows = pd.concat(list(batches)).sort_values("at", kind="stable")
    out = []
    for at, text in zip(rows["at"], rows["text"], strict=True):
        text = text if isinstance(text, str) else None
        kind, added, removed = classify_texts(before, text)
        if kind:
            digest = hashlib.sha1(text.encode()).hexdigest()[:16] if text is not None else None
            out.append((*key, at, kind, added, removed, digest, before))
        before = text
    if before is None:
        if state.exists:
            state.remove()
    else:
        state.update((before,))
    yield pd.DataFrame(out, columns=["vault", "rel_path", "at", "kind", "lines_added", "lines_removed", "hash", "replaced"])


def journal_stream(files: DataFrame) -> DataFrame:
    """Write events from a stream of (vault, rel_path, at, text), text null for a deletion. Each page's last text is its state;
    unchanged text gives nothing; a replaced text comes along as the version to keep."""
    return files.groupBy("vault", "rel_path").applyInPandasWithState(_journal, JOURNAL, "text string", "append", GroupStateTimeout.NoTimeout)


def debounced(files: DataFrame, quiet: str = "400 milliseconds", late: str = "1 minute") -> DataFrame:
    """The last text of each burst of writes to a page."""
    return files.withWatermark("at", late).groupBy("vault", "rel_path", F.session_window("at", quiet)).agg(F.max_by("text", "at").alias("text"), F.max("at").alias("at"), F.count("*").alias("writes"))


class Quiet(StatefulProcessor):
    """Keeps the last text of a page until nothing was written to it for a while by the clock, then gives it out."""

    def __init__(self, quiet_ms: int):
        self.quiet_ms = quiet_ms

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.last = handle.getValueState("last", "text string, at timestamp, writes bigint, timer bigint")

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:
        text, at, writes, timer = self.last.get() if self.last.exists() else (None, None, 0, None)
        for pdf in rows:
            for t, x in zip(pdf["text"], pdf["at"], strict=True):
                if at is None or x >= pd.Timestamp(at):
                    text, at = t if isinstance(t, str) else None, x.to_pydatetime()
                writes += 1
        if timer is not None:
            self.handle.deleteTimer(timer)
        timer = timerValues.getCurrentProcessingTimeInMs() + self.quiet_ms
        self.handle.registerTimer(timer)
        self.last.update((text, at, writes, timer))
        yield from ()

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        text, at, writes, _ = self.last.get()
        self.last.clear()
        yield pd.DataFrame({"vault": [key[0]], "rel_path": [key[1]], "text": [text], "at": [pd.Timestamp(at)], "writes": [writes]})

    def close(self) -> None:
        pass


def debounced_by_clock(files: DataFrame, quiet_ms: int = 400) -> DataFrame:
    """Like debounced, by the clock of the machines that read: a burst is given out that long after its last write came in, without waiting for
    later rows. The state is one row a page with an open burst; it needs the RocksDB state store (spark.sql.streaming.stateStore.providerClass)."""
    schema = "vault string, rel_path string, text string, at timestamp, writes bigint"
    return files.groupBy("vault", "rel_path").transformWithStateInPandas(Quiet(quiet_ms), schema, "Append", "ProcessingTime")


def usage_windows(usage: DataFrame, size: str = "1 day", slide: str | None = None, late: str = "1 hour") -> DataFrame:
    """Reads, searches and misses of each vault and window; events later than the watermark are dropped."""
    w = F.window("at", size, slide) if slide else F.window("at", size)
    miss = (F.col("t") == "search") & (F.col("hits") == 0)
    return usage.withWatermark("at", late).groupBy("vault", w.alias("w")).agg(F.count_if(F.col("t") == "read").alias("reads"), F.count_if(F.col("t") == "search").alias("searches"), F.count_if(miss).alias("misses")).select("vault", F.col("w.start").alias("start"), "reads", "searches", "misses")


def change_feed(journal: DataFrame, since, now) -> DataFrame:
    """Events in [since, now): the next cursor is now, so that no event comes twice."""
    return journal.filter((F.col("at") >= F.lit(since).cast("timestamp")) & (F.col("at") < F.lit(now).cast("timestamp")))


def route(activity: DataFrame, hooks: DataFrame) -> DataFrame:
    """Activity with the enabled hooks (vault, url, kinds, enabled) that want it; no kinds means all."""
    h = hooks.filter("enabled").select("vault", "url", "kinds")
    return activity.join(h, "vault").filter((F.size("kinds") == 0) | F.array_contains("kinds", F.col("kind"))).drop("kinds")


def events_from_times(pages: DataFrame) -> DataFrame:
    """Journal rows where only modification times are known."""
    return pages.select("vault", "rel_path", F.col("mtime").alias("at"), F.lit("rewritten").alias("kind"), F.lit(0).alias("lines_added"), F.lit(0).alias("lines_removed"), "hash")
