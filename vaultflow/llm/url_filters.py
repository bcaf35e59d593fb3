"""URL filters by a cascade of Bloom filters.

A list names domains; each is listed with all its subdomains. The universe of keys is known: every host of the corpus and
its parent domains. Level 0 holds the listed domains; level 1 the keys of the universe that level 0 lets through though they aren't
listed; level 2 the listed domains that level 1 lets through, and so on until a level lets none through. The first level that
lacks a key decides: an even one says unlisted, an odd one listed; past the last level the count of levels decides. Over the
universe the answer is exact, and looking up a URL needs no join: its host's domains are asked one by one.

A filter is built by aggregations over its keys' bit positions, which end in a few binary rows of SEGMENT bytes, and goes into
the expression as bytes. Its size is known from the count of keys before it is built; a list beyond MAX_BYTES
takes the other way, a left semi-join on the domains. Building compares only the keys that a level lets through with the list.

Rules go first: a rule fits its host and all subdomains where the URL's path starts with the
rule's; the longest wins.

Defined cases: a null URL, or one without ``://``, has empty host and path and is allowed; an empty
universe or list gives no levels; repeated URLs are judged alike; a host is cut to the length of the longest listed domain before
its parents are listed, so a very long one costs no more than others; other columns are carried.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import ascii_lower, materialize, temp_name

#: (rule, verdict)
RULES = (("org/", "allow"), ("example.org/es/", "block"), ("example.org/en/1", "block"), ("com/fr/", "allow"), ("com/de/", "block"))
#: The given tables have no list of domains. The registered query takes the hosts of the corpus whose MD5 begins so, a list that grows with it.
LISTED_MD5 = "0"
BITS_PER_KEY, HASHES, MAX_BYTES, MAX_LEVELS = 10, 4, 8_000_000, 40
#: Bytes of a row of a filter.
SEGMENT = 1 << 16


def host_of(url: Column) -> Column:
    after = F.regexp_extract(F.coalesce(url, F.lit("")), r"^(?s).*?://([^/?#]*)", 1)
    return ascii_lower(after)


def path_of(url: Column) -> Column:
    return F.regexp_extract(F.coalesce(url, F.lit("")), r"^(?s).*?://[^/?#]*([^?#]*)", 1)


def rule_of(host: Column, path: Column, rules=RULES) -> tuple[Column, Column]:
    """The rule that fits and its verdict, null where none fits."""
    rule, verdict = F.lit(None).cast("string"), F.lit(None).cast("string")
    for text, says in sorted(rules, key=lambda r: len(r[0])):  # the longest is asked first, so it comes last
        domain, slash, rest = text.partition("/")
        fits = ((host == domain) | host.endswith("." + domain)) & path.startswith(slash + rest)
        rule, verdict = F.when(fits, F.lit(text)).otherwise(rule), F.when(fits, F.lit(says)).otherwise(verdict)
    return rule, verdict


def positions(key: Column, level: int, bits: int) -> list[Column]:
    return [F.pmod(F.xxhash64(key, F.lit(level), F.lit(i)), F.lit(bits)) for i in range(HASHES)]


def bit_of(position: Column) -> Column:
    return F.element_at(F.array(*[F.lit(128 >> i) for i in range(8)]), (position % 8 + 1).cast("int"))


def build_filter(keys: DataFrame, level: int, bits: int) -> bytes:
    """The filter's bytes. Words of 64 bits are set by partial aggregation, then put together to rows of SEGMENT bytes; these come back."""
    words = bits // 64
    at = keys.select(F.explode(F.array(*positions(F.col("key"), level, bits))).alias("p"))
    one = F.call_function("shiftleft", F.lit(1).cast("long"), F.lit(63) - (F.col("p") % 64).cast("int"))  # the first bit is a word's highest
    held = at.select(F.floor(F.col("p") / 64).alias("word"), one.alias("value")).groupBy("word").agg(F.bit_or("value").alias("value"))
    every = keys.sparkSession.range(words).select(F.col("id").alias("word"), F.lit(0).cast("long").alias("value"))
    rows = held.unionByName(every).groupBy("word").agg(F.bit_or("value").alias("value"))
    rows = rows.groupBy(F.floor(F.col("word") * 8 / SEGMENT).alias("segment")).agg(F.array_sort(F.collect_list(F.struct("word", "value"))).alias("x"))
    rows = rows.select("segment", F.unhex(F.array_join(F.transform("x", lambda w: F.lpad(F.hex(w["value"]), 16, "0")), "")).alias("data"))
    return b"".join(bytes(r["data"]) for r in rows.orderBy("segment").collect())  # bits / 8 bytes


def in_filter(key: Column, level: int, data: bytes) -> Column:
    held = F.lit(bytearray(data))
    test = F.lit(True)
    for p in positions(key, level, len(data) * 8):
        byte = F.conv(F.hex(F.substring(held, (F.floor(p / 8) + 1).cast("int"), F.lit(1))), 16, 10).cast("int")
        test = test & (byte.bitwiseAND(bit_of(p)) != 0)
    return test


def cascade(universe: DataFrame, listed: DataFrame) -> list[bytes] | None:
    """Filters of the levels, for distinct keys and listed keys; None if the first would be too large."""
    levels: list[bytes] = []
    ours, theirs = listed, universe
    while len(levels) < MAX_LEVELS:
        n = ours.count()
        if not n:
            return levels
        bits = max(64, 64 * math.ceil(n * BITS_PER_KEY / 64))
        if bits // 8 > MAX_BYTES:
            return None
        levels.append(build_filter(ours, len(levels), bits))
        through = theirs.filter(in_filter(F.col("key"), len(levels) - 1, levels[-1]))
        if len(levels) == 1:  # what level 0 lets through is nearly the list itself
            through = through.join(listed, "key", "left_anti")
        ours, theirs = materialize(through), ours
    raise RuntimeError("the cascade doesn't end; raise BITS_PER_KEY")


def listed_in(key: Column, levels: list[bytes]) -> Column:
    out = F.lit(len(levels) % 2 == 1)
    for i in reversed(range(len(levels))):
        out = F.when(in_filter(key, i, levels[i]), out).otherwise(F.lit(i % 2 == 1))
    return out


def domains_of(host: Column, longest: int) -> Column:
    """The host and its parent domains, as far as they have ``longest`` characters at most."""
    tail = F.right(host, F.lit(longest + 1))
    labels = F.split(tail, r"\.")
    # A host that is longer begins within a label here.
    labels = F.when(F.char_length(host) > longest, F.slice(labels, 2, F.greatest(F.size(labels) - 1, F.lit(0)))).otherwise(labels)
    names = F.transform(F.array(labels), lambda x: F.transform(F.sequence(F.lit(1), F.greatest(F.size(x), F.lit(1))), lambda i: F.array_join(F.slice(x, i, F.size(x)), ".")))
    return F.filter(F.element_at(names, 1), lambda d: d != "")


def judge(pages: DataFrame, blocked: DataFrame, rules=RULES) -> DataFrame:
    """pages with host, path, rule, verdict; blocked has ``domain``."""
    pages = pages.drop("host", "path", "rule", "verdict")
    says, own = temp_name(pages, "says"), temp_name(pages, "listed")
    out = pages.withColumn("host", host_of(F.col("url"))).withColumn("path", path_of(F.col("url")))
    listed = materialize(blocked.select(ascii_lower(F.col("domain")).alias("key")).filter("key <> ''").distinct())
    longest = listed.agg(F.max(F.char_length("key"))).first()[0] or 0
    domains = domains_of(F.col("host"), longest)
    universe = materialize(out.select("host").distinct().select(F.explode(domains).alias("key")).distinct())
    levels = cascade(universe, listed)
    rule, verdict = rule_of(F.col("host"), F.col("path"), rules)
    out = out.withColumn("rule", rule).withColumn(says, verdict)
    if levels is None:
        bad = out.select("host").distinct().select("host", F.explode(domains).alias("key")).join(listed, "key", "left_semi").select("host").distinct()
        out = out.join(bad.withColumn(own, F.lit(True)), "host", "left")
        found = F.coalesce(own, F.lit(False))
    else:
        found = F.exists(domains, lambda d: listed_in(d, levels)) if levels else F.lit(False)
    out = out.withColumn("verdict", F.coalesce(F.col(says), F.when(found, "block").otherwise("allow")))
    return out.select(*pages.columns, "host", "path", "rule", "verdict")


def judge_pages(pages: DataFrame) -> DataFrame:
    hosts = pages.select(host_of(F.col("url")).alias("domain")).distinct()
    blocked = hosts.filter(F.md5("domain").startswith(LISTED_MD5))
    return judge(pages.select("page_id", "url"), blocked).select("page_id", "host", "path", "rule", "verdict")


_CASES = "\n".join(
    f"when (host = '{d}' or suffix(host, '.{d}')) and prefix(path, '/{p}') then '{d}/{p}'" for d, _, p in (r.partition("/") for r, _ in sorted(RULES, key=lambda r: -len(r[0])))
)
_SAYS = "\n".join(f"when '{r}' then '{v}'" for r, v in RULES)
ORACLE = f"""
with u as (select page_id, translate(regexp_extract(coalesce(url, ''), '^(?s).*?://([^/?#]*)', 1), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') as host,
                  regexp_extract(coalesce(url, ''), '^(?s).*?://[^/?#]*([^?#]*)', 1) as path from pages),
d as (select distinct host as domain from u where host <> '' and prefix(md5(host), '{LISTED_MD5}')),
b as (select distinct host from (select distinct host from u) as h, d where host = domain or suffix(host, '.' || domain)),
r as (select *, case {_CASES} end as rule from u)
select page_id, host, path, rule, case when rule is null then case when host in (select host from b) then 'block' else 'allow' end else case rule {_SAYS} end end as verdict from r
"""
