"""Text, time and rounding rules that hold everywhere.

Halves round up (towards positive infinity). White space is ASCII white space plus the Unicode
spaces. Slices count code points. Days are UTC.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: ASCII white space and the Unicode spaces, for use inside a character class.
SPACES = r"\s   -     　﻿"
#: The space and its Unicode kin (category Zs), which SQL's trim takes off.
BLANKS = " \u00a0\u1680\u2000\u2001\u2002\u2003\u2004\u2005\u2006\u2007\u2008\u2009\u200a\u202f\u205f\u3000"
#: A search term. Fixed value.
TERM = r"[a-z0-9][a-z0-9'-]*"
#: A first heading without words.
EMPTY_HEADING = r"^\s*#[ \t]*(?:\n+|\z)"
DAY = 86_400


def half_up(x: Column) -> Column:
    return F.floor(x + 0.5)


def trimmed(text: Column) -> Column:
    """text without blanks at its ends."""
    return F.trim(text, F.lit(BLANKS))


def terms(text: Column) -> Column:
    """Search terms in order, repeats kept."""
    return F.regexp_extract_all(F.lower(F.coalesce(text, F.lit(""))), F.lit(TERM), F.lit(0))


def token_count(text: Column) -> Column:
    """Tokens at four characters each; the default wherever a token counter can be given."""
    return F.ceil(F.length(F.coalesce(text, F.lit(""))) / 4).cast("long")


def format_tokens(n: Column) -> Column:
    """2.3M, 12k, 1.2k or the number."""
    return (
        F.when(n >= 1_000_000, F.format_string("%.1fM", half_up(n / 100_000) / 10))
        .when(n >= 10_000, F.concat(half_up(n / 1000).cast("string"), F.lit("k")))
        .when(n >= 1000, F.format_string("%.1fk", half_up(n / 100) / 10))
        .otherwise(n.cast("string"))
    )


def occurrences(text: Column, needle: Column) -> Column:
    """How often needle stands in text without overlap; 0 for an empty needle."""
    gone = F.length(text) - F.length(F.replace(text, needle, F.lit("")))
    return F.when(F.length(needle) > 0, F.floor(gone / F.length(needle))).otherwise(F.lit(0))


def base_name(path: Column) -> Column:
    return F.substring_index(path, "/", -1)


def dir_name(path: Column) -> Column:
    return F.regexp_extract(path, r"^(.*)/[^/]*$", 1)


def strip_extension(path: Column) -> Column:
    return F.regexp_replace(path, r"(?i)\.mdx?$", "")


def content_hash(text: Column) -> Column:
    """First 16 hex digits of the SHA-1."""
    return F.substring(F.sha1(text), 1, 16)


def age_days(at: Column, now) -> Column:
    """Whole days from at to now."""
    return F.floor((F.unix_seconds(F.lit(now).cast("timestamp")) - F.unix_seconds(at)) / DAY)


def slugify(title: Column) -> Column:
    """Lower case, letters, digits and hyphens, 60 characters."""
    kept = F.trim(F.regexp_replace(F.lower(title), r"[^a-z0-9\s-]", ""))
    s = F.substring(F.regexp_replace(kept, r"\s+", "-"), 1, 60)
    return F.when(s == "", F.lit("untitled")).otherwise(s)


def fill_template(template: Column, title: Column, now) -> Column:
    """{{title}} {{slug}} {{date}} {{time}} {{datetime}} {{year}} {{month}} filled in."""
    at = F.lit(now).cast("timestamp")
    out = F.replace(F.replace(template, F.lit("{{title}}"), title), F.lit("{{slug}}"), slugify(title))
    for name, form in (("date", "yyyy-MM-dd"), ("time", "HH:mm"), ("datetime", "yyyy-MM-dd'T'HH:mm:ss.SSS'Z'"), ("year", "yyyy"), ("month", "MM")):
        out = F.replace(out, F.lit("{{" + name + "}}"), F.date_format(at, form))
    return out


def target_path(folder: Column, filename: Column, title: Column, now) -> Column:
    """The path that a template gives a title."""
    name = fill_template(filename, title, now)
    name = F.when(name.rlike(r"(?i)\.mdx?$"), name).otherwise(F.concat(name, F.lit(".md")))
    where = F.regexp_replace(fill_template(folder, title, now), r"^/+|/+$", "")
    return F.when(where == "", name).otherwise(F.concat(where, F.lit("/"), name))


def strip_frontmatter(raw: Column) -> Column:
    return F.regexp_replace(raw, r"^---\r?\n(?s:.*?)\r?\n---[ \t]*(?:\r?\n|$)", "")


def strip_leading_title(body: Column, title: Column) -> Column:
    """body without its first heading where that says the title again and nothing stands before it; an empty heading says an empty title."""
    first = F.regexp_extract(body, r"^\s*#\s+([^\n]*)", 1)
    same = F.lower(F.trim(first)) == F.lower(F.trim(title))
    none = (trimmed(title) == "") & body.rlike(EMPTY_HEADING)
    return F.when(none, F.regexp_replace(body, EMPTY_HEADING, "")).when(same & (first != ""), F.regexp_replace(body, r"^\s*#\s+[^\n]*\n*", "")).otherwise(body)
