"""Sign-offs: what can still be trusted, rename repair, forecast, policies, quarantine, scopes."""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions.text import DAY, age_days, half_up

DECAY_DAYS = 120
#: (match, days, label), in the order that decides. Fixed values.
POLICY_RULES = (("/pricing|cost|rate|invoice/", 30, "Money moves"), ("/client|project|status|roadmap/", 60, "Work in flight"), ("/tool|stack|version|setup|install|config/", 90, "Tooling drifts"))
#: The older built-in order: tooling before work.
HEALTH_RULES = (POLICY_RULES[0], POLICY_RULES[2], POLICY_RULES[1])
DEFAULT_DAYS = 180
#: Capabilities of each role. Fixed values.
_READ = ("read", "search", "index", "health", "changes", "context")
ROLES = {"reader": _READ, "writer": (*_READ, "write"), "admin": (*_READ, "write", "verify", "manage")}


def with_trust(pages: DataFrame, ledger: DataFrame, now, decay_days: int = DECAY_DAYS) -> DataFrame:
    """pages with ``trust``: unverified, lapsed, aging or verified."""
    signed = ledger.select("vault", "page_id", F.col("hash").alias("_signed"), F.col("at").alias("_signed_at"))
    out = pages.join(signed, ["vault", "page_id"], "left")
    age = F.unix_micros(F.lit(now).cast("timestamp")) - F.unix_micros("_signed_at")
    trust = F.when(F.col("_signed_at").isNull(), "unverified").when(~F.col("_signed").eqNullSafe(F.col("hash")), "lapsed").when(age > decay_days * DAY * 1_000_000, "aging").otherwise("verified")
    return out.withColumn("trust", trust).drop("_signed", "_signed_at")


def section_trust(sections: DataFrame, section_ledger: DataFrame) -> DataFrame:
    """sections with ``trust``; a section's sign-off does not age."""
    signed = section_ledger.select("vault", "page_id", "heading", F.col("hash").alias("_signed"))
    out = sections.join(signed, ["vault", "page_id", "heading"], "left")
    return out.withColumn("trust", F.when(F.col("_signed").isNull(), "unverified").when(F.col("_signed") != F.col("hash"), "lapsed").otherwise("verified")).drop("_signed")


def reconcile_renames(ledger: DataFrame, pages: DataFrame) -> DataFrame:
    """ledger where a sign-off whose page is gone moves to the one unsigned page with its hash; the first such
    sign-off (by page_id) gets it."""
    here = pages.select("vault", "page_id")
    orphan = ledger.join(here, ["vault", "page_id"], "left_anti")
    unsigned = pages.select("vault", "page_id", "hash").join(ledger.select("vault", "page_id"), ["vault", "page_id"], "left_anti")
    home = unsigned.groupBy("vault", "hash").agg(F.count("*").alias("n"), F.min("page_id").alias("moved_to")).filter("n = 1").drop("n")
    first = Window.partitionBy("vault", "hash").orderBy("page_id")
    moves = orphan.withColumn("k", F.row_number().over(first)).filter("k = 1").join(home, ["vault", "hash"]).select("vault", "page_id", "moved_to")
    return ledger.join(moves, ["vault", "page_id"], "left").withColumn("page_id", F.coalesce("moved_to", "page_id")).select(*ledger.columns)


def forecast(ledger: DataFrame, pages: DataFrame, now, decay_days: int = DECAY_DAYS, within: int = 60) -> DataFrame:
    """(vault, page_id, title, in_days): sign-offs that run out soon, those already out included."""
    both = ledger.select("vault", "page_id", "at").join(pages.select("vault", "page_id", "title"), ["vault", "page_id"])
    age = (F.unix_seconds(F.lit(now).cast("timestamp")) - F.unix_seconds("at")) / DAY
    return both.withColumn("in_days", half_up(decay_days - age)).filter(F.col("in_days") <= within).select("vault", "page_id", "title", "in_days")


def trust_split(trusted: DataFrame) -> DataFrame:
    """Counts of each state and the share that was ever checked, in per cent."""
    n = {t: F.count_if(F.col("trust") == t).alias(t) for t in ("verified", "aging", "lapsed", "unverified")}
    out = trusted.groupBy("vault").agg(F.count("*").alias("pages"), *n.values())
    return out.withColumn("checked_pct", half_up((F.col("verified") + F.col("aging")) * 100 / F.col("pages")))


def rule_matches(match: str, page_id: Column, title: Column) -> Column:
    """Substring, or /regex/ without case; a regex that does not compile matches nothing."""
    raw, hay = match.strip(), F.lower(F.concat_ws(" ", page_id, title))
    if not raw:
        return F.lit(False)
    if raw.startswith("/") and raw.rfind("/") > 0:
        body = raw[1 : raw.rfind("/")]
        try:
            re.compile(body)
        except re.error:
            return F.lit(False)
        return hay.rlike("(?i)" + body)
    return hay.contains(raw.lower())


def window_days(page_id: Column, title: Column, rules=POLICY_RULES, default: int = DEFAULT_DAYS) -> Column:
    """Review window of the first rule that matches."""
    out = F.lit(default)
    for match, days, _ in reversed(clean_rules(rules)):
        out = F.when(rule_matches(match, page_id, title), days).otherwise(out)
    return out


def clean_rules(rules) -> list[tuple[str, int, str]]:
    """Rules as they are saved: blank matches and days that are no numbers go, days are 1 at least."""
    out = []
    for match, days, label in rules:
        if match.strip() and isinstance(days, (int, float)) and days == days and abs(days) != float("inf"):
            out.append((match, max(1, int(days + 0.5)), label))
    return out


def policy_coverage(pages: DataFrame, rules=POLICY_RULES) -> DataFrame:
    """(vault, ord, label, pages): pages that each rule governs, 0 included; the last row is the fallback."""
    rules = clean_rules(rules)
    which = F.lit(len(rules))
    for i, (match, _, _) in reversed(list(enumerate(rules))):
        which = F.when(rule_matches(match, F.col("page_id"), F.col("title")), i).otherwise(which)
    counts = pages.withColumn("ord", which).groupBy("vault", "ord").agg(F.count("*").alias("pages"))
    names = F.array(*[F.struct(F.lit(i).alias("ord"), F.lit(r[2]).alias("label")) for i, r in enumerate([*rules, ("", 0, "default")])])
    all_rules = pages.select("vault").distinct().select("vault", F.explode(names).alias("r")).select("vault", "r.ord", "r.label")
    return all_rules.join(counts, ["vault", "ord"], "left").fillna(0, ["pages"])


def without_quarantined(rows: DataFrame, quarantine: DataFrame) -> DataFrame:
    return rows.join(quarantine.select("vault", "page_id").distinct(), ["vault", "page_id"], "left_anti")


def withheld(rows: DataFrame, quarantine: DataFrame) -> DataFrame:
    """(vault, withheld, shown)."""
    q = quarantine.select("vault", "page_id").distinct().withColumn("q", F.lit(True))
    return rows.join(q, ["vault", "page_id"], "left").groupBy("vault").agg(F.count_if("q").alias("withheld"), F.count_if(F.col("q").isNull()).alias("shown"))


def in_scope(pages: DataFrame, agents: DataFrame) -> DataFrame:
    """(vault, agent_id, page_id): pages that each agent that isn't revoked may see. Agents without scopes see all;
    else a page must be a scope or stand below one."""
    live = agents.filter("revoked_at is null")
    parts = F.split("page_id", "/")
    above = F.transform(F.sequence(F.lit(1), F.size(parts)), lambda i: F.array_join(F.slice(parts, F.lit(1), i), "/"))
    prefixes = pages.select("vault", "page_id", F.explode(above).alias("scope"))
    scoped = live.filter(F.size("scopes") > 0).select("vault", "agent_id", F.explode(F.array_distinct("scopes")).alias("scope"))
    every = live.filter((F.size("scopes") <= 0) | F.col("scopes").isNull()).select("vault", "agent_id")
    return prefixes.join(scoped, ["vault", "scope"]).select("vault", "agent_id", "page_id").distinct().unionByName(pages.select("vault", "page_id").join(every, "vault").select("vault", "agent_id", "page_id"))


def with_capability(agents: DataFrame, capability: str) -> DataFrame:
    return agents.filter(F.col("role").isin([r for r, c in ROLES.items() if capability in c]) & F.col("revoked_at").isNull())


def stale_days(now) -> Column:
    return age_days(F.col("mtime"), now)
