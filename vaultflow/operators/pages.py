"""Markdown files into pages: frontmatter, links, tags, title, plain text, sections, chunks."""

from __future__ import annotations

import json
import re
import textwrap

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.text import SPACES, base_name, content_hash, dir_name, strip_extension
from ..functions.udf import vectorised
from .storage import materialize

FRONT = r"^---[ \t]*\r?\n(?s:(.*?))\r?\n?---[ \t]*(?:\r?\n|$)"
#: Fixed value.
MAX_INLINE_TAGS = 12
SECTIONS = "array<struct<pos:int,depth:int,heading:string,text:string>>"


def _scalar(s: str):
    s = s.strip()
    if len(s) > 1 and s[0] == s[-1] and s[0] in "\"'":
        return s[1:-1]
    if s in ("", "~", "null"):
        return None
    if s in ("true", "false"):
        return s == "true"
    if re.fullmatch(r"[-+]?\d+", s):
        return int(s)
    if re.fullmatch(r"[-+]?\d*\.\d+", s):
        return float(s)
    if s[0] in "[{&*!|>%@`" or re.search(r":\s", s):
        raise ValueError(s)
    return s


def _value(s: str):
    s = s if s[:1] in "\"'" else re.sub(r"\s+#.*$", "", s)
    if s.startswith("["):
        if not s.endswith("]"):
            raise ValueError(s)
        return [_scalar(p) for p in re.findall(r"\s*(\"[^\"]*\"|'[^']*'|[^,]+)", s[1:-1]) if p.strip()]
    return _scalar(s)


FIELD = re.compile(r"([^\s:#\[{][^:]*):(?:\s+(.*))?")


class FrontReader:
    """Fields, lists and text blocks by their indentation, nested as deep as they come; ValueError for anything else."""

    def __init__(self, block: str):
        self.lines, self.at = [line.rstrip() for line in block.split("\n")], 0

    def peek(self) -> tuple[int, str] | None:
        """Indentation and text of the next line that says something."""
        while self.at < len(self.lines):
            text = self.lines[self.at].lstrip()
            if text and not text.startswith("#"):
                return len(self.lines[self.at]) - len(text), text
            self.at += 1
        return None

    def node(self, indent: int):
        following = self.peek()
        out = self.items(indent) if re.match(r"-(\s|$)", following[1]) else self.fields(indent)
        if (rest := self.peek()) and rest[0] > indent:
            raise ValueError(rest[1])
        return out

    def items(self, indent: int) -> list:
        out = []
        while (line := self.peek()) and line[0] == indent and re.match(r"-(\s|$)", line[1]):
            text = line[1][1:].strip()
            if text and FIELD.fullmatch(text):  # the item's first field stands beside the dash
                self.lines[self.at] = " " * (indent + 1 + len(line[1][1:]) - len(line[1][1:].lstrip())) + text
                out.append(self.node(self.peek()[0]))
            else:
                self.at += 1
                out.append(_value(text) if text else self.below(indent))
        return out

    def fields(self, indent: int) -> dict:
        out = {}
        while (line := self.peek()) and line[0] == indent and (m := FIELD.fullmatch(line[1])):
            self.at += 1
            key, text = m[1].strip(), (m[2] or "").strip()
            out[key.strip("\"'")] = self.text(indent, text) if re.fullmatch(r"[|>][-+]?", text) else _value(text) if text else self.below(indent, lists=True)
        if line and line[0] == indent or not out:  # a line that is no field
            raise ValueError(str(line))
        return out

    def below(self, indent: int, lists: bool = False):
        """What is nested under a line; a field's list may stand at its own indentation."""
        line = self.peek()
        inside = line and (line[0] > indent or (lists and line[0] == indent and re.match(r"-(\s|$)", line[1])))
        return self.node(line[0]) if inside else None

    def text(self, indent: int, style: str) -> str:
        own = []
        while self.at < len(self.lines) and (not self.lines[self.at].strip() or len(self.lines[self.at]) - len(self.lines[self.at].lstrip()) > indent):
            own.append(self.lines[self.at])
            self.at += 1
        out = textwrap.dedent("\n".join(own)).strip("\n")
        if style[0] == ">":
            out = re.sub(r"\n(\n*)", lambda m: m[1] or " ", out)
        return out + ("" if style.endswith("-") or not out else "\n")


def frontmatter_json(block: str | None) -> str | None:
    """Fields with scalars, lists, nested fields and text blocks, as people write them at the top of notes, as a JSON object; None if it
    can't be read."""
    if block is None:
        return None
    reader = FrontReader(block)
    try:
        first = reader.peek()
        out = reader.node(first[0]) if first else {}
        return json.dumps(out, ensure_ascii=False) if isinstance(out, dict) and reader.peek() is None else None
    except ValueError:
        return None


@vectorised("string")
def read_frontmatter(block: pd.Series) -> pd.Series:
    return block.map(frontmatter_json)


def to_plain(body: Column) -> Column:
    """Readable prose: code, images and marks go, links leave their text."""
    s = body
    for pattern, by in (
        (r"```[\s\S]*?```", " "),
        (r"`[^`]*`", " "),
        (r"!\[[^\]]*\]\([^)]*\)", " "),
        (r"\[\[[^\]|]+\|([^\]]+)\]\]", "$1"),
        (r"\[\[([^\]|]+)\]\]", "$1"),
        (r"\[([^\]]*)\]\([^)]*\)", "$1"),
        (rf"(?m)^[{SPACES}]{{0,3}}#{{1,6}}[{SPACES}]+", ""),
        (rf"(?m)^[{SPACES}]{{0,3}}>[{SPACES}]?", ""),
        (r"[*_~]", ""),
        (rf"[{SPACES}]+", " "),
    ):
        s = F.regexp_replace(s, pattern, by)
    return F.trim(s)


def clean_target(target: Column) -> Column:
    s = F.trim(F.substring_index(F.substring_index(target, "#", 1), "|", 1))
    return strip_extension(F.regexp_replace(s, r"^\./", ""))


def raw_links(body: Column) -> Column:
    """Targets of wikilinks, then of relative markdown links to notes; each once."""
    wiki = F.regexp_extract_all(body, F.lit(r"\[\[([^\]]+)\]\]"), F.lit(1))
    href = F.transform(F.regexp_extract_all(body, F.lit(r"\[[^\]]*\]\(([^)]+)\)"), F.lit(1)), lambda x: F.trim(x))
    notes = F.filter(href, lambda h: ~h.rlike(r"(?i)^[a-z]+:") & ~h.startswith("#") & h.rlike(r"(?i)\.mdx?$"))
    return F.array_distinct(F.filter(F.transform(F.concat(wiki, notes), clean_target), lambda t: t != ""))


def listed(front: Column, *names: str, split: str | None = None) -> Column:
    """Strings under the first of names that is there: a list, or one string (split where given)."""
    out = F.lit(None).cast("array<string>")
    for name in reversed(names):
        value = F.get_json_object(front, f"$.{name}")
        many = F.from_json(value, "array<string>")
        one = F.split(value, split) if split else F.array(value)
        out = F.when(value.isNotNull(), F.when(value.startswith("["), many).otherwise(one)).otherwise(out)
    return F.coalesce(F.filter(F.transform(out, lambda x: F.trim(x)), lambda t: t != ""), F.array().cast("array<string>"))


def all_tags(front: Column, body: Column) -> Column:
    """Declared tags, then up to 12 inline ones that look like tags."""
    declared = F.array_distinct(F.transform(listed(front, "tags", "tag", split=rf"[,{SPACES}]+"), lambda t: F.regexp_replace(t, "^#", "")))
    prose = F.regexp_replace(F.regexp_replace(body, r"```[\s\S]*?```", " "), r"`[^`]*`", " ")
    inline = F.array_distinct(F.regexp_extract_all(prose, F.lit(rf"(?:^|[{SPACES}(])#([a-zA-Z][\w/-]{{1,48}})"), F.lit(1)))
    good = F.filter(inline, lambda t: t.rlike("[a-z]") & ~F.array_contains(declared, t))
    return F.concat(declared, F.slice(good, 1, MAX_INLINE_TAGS))


def title_of(front: Column, body: Column, rel_path: Column) -> Column:
    def text(name):  # only a string counts; its JSON form is quoted
        raw = F.variant_get(F.try_parse_json(front), f"$.{name}", "variant")
        return F.when(F.schema_of_variant(raw) == "STRING", F.trim(F.get_json_object(front, f"$.{name}")))

    named = F.coalesce(F.when(F.get_json_object(front, "$.title").isNotNull(), F.coalesce(text("title"), F.lit(""))), text("name"), F.lit(""))
    h1 = F.trim(F.regexp_extract(body, rf"(?m)^[{SPACES}]{{0,3}}#[{SPACES}]+(.+)$", 1))
    return F.coalesce(F.nullif(named, F.lit("")), F.nullif(h1, F.lit("")), strip_extension(base_name(rel_path)))


def parse_pages(files: DataFrame) -> DataFrame:
    """files (vault, rel_path, text, mtime) into pages. A block that can't be read leaves the whole file as body
    and says so in parse_error."""
    block = F.when(F.col("text").rlike(FRONT), F.regexp_extract("text", FRONT, 1))
    f = files.select("vault", "rel_path", "text", "mtime").withColumn("_block", block).withColumn("_front", read_frontmatter("_block"))
    bad = F.col("_block").isNotNull() & F.col("_front").isNull()
    f = f.withColumn("parse_error", F.when(bad, F.lit("unreadable frontmatter")))
    f = f.withColumn("body", F.when(F.col("_front").isNotNull(), F.regexp_replace("text", FRONT, "")).otherwise(F.col("text")))
    f = f.withColumn("frontmatter_json", F.coalesce("_front", F.lit("{}"))).withColumn("plain", to_plain(F.col("body")))
    # Written here, as each of the columns below would work out body and plain anew.
    f = materialize(f.select("vault", "rel_path", "mtime", "parse_error", "frontmatter_json", "body", "plain"))
    front, body, plain = F.col("frontmatter_json"), F.col("body"), F.col("plain")
    return f.select(
        "vault",
        strip_extension(F.col("rel_path")).alias("page_id"),
        "rel_path",
        title_of(front, body, F.col("rel_path")).alias("title"),
        dir_name(F.col("rel_path")).alias("folder"),
        all_tags(front, body).alias("tags"),
        listed(front, "aliases", "alias").alias("aliases"),
        raw_links(body).alias("raw_links"),
        "frontmatter_json",
        "plain",
        F.substring(plain, 1, 240).alias("excerpt"),
        F.when(plain == "", 0).otherwise(F.size(F.split(plain, rf"[{SPACES}]+"))).alias("words"),
        "mtime",
        content_hash(plain).alias("hash"),
        "body",
        "parse_error",
    )


def parse_errors(pages: DataFrame) -> DataFrame:
    return pages.filter("parse_error is not null").select("vault", "rel_path", F.col("parse_error").alias("message"))


def split_sections(raw: str) -> list[tuple[int, int, str | None, str]]:
    """(position, depth, heading, text) of each section that has text or a heading; heading None before the first."""
    out, heading, depth, lines, fenced = [], None, 0, [], False

    def flush():
        text = "\n".join(lines).strip()
        if text or heading is not None:
            out.append((len(out), depth, heading, text))

    for line in (raw or "").split("\n"):
        if line.lstrip().startswith("```"):
            fenced = not fenced
        m = None if fenced else re.match(r"(#{1,6})\s+(.*)$", line)
        if m:
            flush()
            heading, depth, lines = m[2].strip(), len(m[1]), []
        else:
            lines.append(line)
    flush()
    return out


@vectorised(SECTIONS)
def read_sections(raw: pd.Series) -> pd.Series:
    return raw.map(lambda r: [{"pos": p, "depth": d, "heading": h, "text": t} for p, d, h, t in split_sections(r)])


def sections(files: DataFrame) -> DataFrame:
    """(vault, page_id, pos, heading, text, hash) of each section with text; the text before the
    first heading is '(intro)'."""
    s = files.select("vault", strip_extension(F.col("rel_path")).alias("page_id"), F.explode(read_sections("text")).alias("s")).filter("s.text <> ''")
    return s.select("vault", "page_id", "s.pos", F.coalesce("s.heading", F.lit("(intro)")).alias("heading"), "s.text", content_hash(F.col("s.text")).alias("hash"))


def outline(files: DataFrame, depth: int = 4) -> DataFrame:
    """(vault, page_id, pos, depth, heading) of headings outside fences."""
    s = files.select("vault", strip_extension(F.col("rel_path")).alias("page_id"), F.explode(read_sections("text")).alias("s"))
    return s.filter(f"s.heading is not null and s.depth <= {depth}").select("vault", "page_id", "s.pos", "s.depth", "s.heading")


def chunks(pages: DataFrame, size: int = 180, overlap: int = 40, most: int | None = None) -> DataFrame:
    """(vault, page_id, chunk_no, text, hash): windows of words, with the title before each, over the whole page.

    With ``most``, long pages get a wider stride, so that no page has more windows; words between them are then lost."""
    words = F.filter(F.split("plain", rf"[{SPACES}]+"), lambda w: w != "")
    p = pages.select("vault", "page_id", "title", words.alias("w")).filter(F.size("w") > 0)
    n = F.size("w")
    stride = F.lit(size - overlap)
    if most is not None:
        stride = F.greatest(stride, F.ceil((n - size) / F.lit(most - 1)).cast("int"))
    # The last window is the first that reaches the end.
    last = F.greatest(F.lit(0), F.ceil((n - size) / stride).cast("int"))
    p = p.withColumn("stride", stride).withColumn("at", F.explode(F.sequence(F.lit(0), last)))
    text = F.concat_ws("\n", "title", F.array_join(F.slice("w", F.col("at") * F.col("stride") + 1, size), " "))
    p = p if most is None else p.filter(F.col("at") < most)
    return p.select("vault", "page_id", F.col("at").alias("chunk_no"), text.alias("text"), content_hash(text).alias("hash"))
