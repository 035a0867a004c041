"""Markdown trees as DataFrames: the scan, and a parse of each note into front matter, links, tags and sections."""

from __future__ import annotations

import json
import re
from collections.abc import Iterator

import pandas as pd
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lumenkb.session import ship_code

SPLIT_LEVEL, MOST_SECTIONS, MOST_HEADING = 3, 512, 120
SKIPPED = ["trash", "node_modules", "target"]

FENCE = re.compile(r" {0,3}(`{3,}|~{3,})(.*)$")
ATX = re.compile(r" {0,3}(#{1,6})(?:[ \t]+(.*?))?(?:[ \t]+#+)?[ \t]*$")
UNDER = re.compile(r" {0,3}(=+|-+)[ \t]*$")
RULE = re.compile(r" {0,3}([-*_])[ \t]*(?:\1[ \t]*){2,}$")
ITEM = re.compile(r"( {0,3}(?:[-*+]|\d{1,9}[.)]))([ \t]+|$)")
QUOTE = re.compile(r" {0,3}>")
WIKI = re.compile(r"\[\[([^\[\]|]+?)(?:\|([^\[\]]*))?\]\]")
INLINE = re.compile(r"(?<!!)\[([^\[\]]*)\]\(<?([^()\s<>]+)>?(?:\s+\"[^\"]*\")?\)")
TAG = re.compile(r"(?:(?<=\s)|^)#([^\W\d][\w/-]*|\d+[^\W\d][\w/-]*)", re.M)
EXTERNAL = re.compile(r"^(?:[a-z][a-z0-9+.-]*:|//|#)", re.I)


def front_matter(text: str) -> tuple[dict, str, int]:
    """The values between leading --- lines (plain scalars, lists and one level of maps), the body, and the lines before it."""
    m = re.match(r"﻿?---[ \t]*\r?\n(.*?)(?:^|\n)---[ \t]*(?:\r?\n|$)", text, re.S)
    if not m:
        return {}, text, 0
    return _mapping(m[1].splitlines()), text[m.end() :], text[: m.end()].count("\n")


def _scalar(s: str):
    s = s.strip()
    if len(s) >= 2 and s[0] == s[-1] and s[0] in "'\"":
        return s[1:-1]
    if s.startswith("[") and s.endswith("]") and not s.startswith("[["):
        return [_scalar(x) for x in re.findall(r"\"[^\"]*\"|'[^']*'|\[\[.*?\]\]|[^,\[\]]+", s[1:-1]) if x.strip()]
    s = re.sub(r"\s+#.*$", "", s)
    known = {"true": True, "false": False, "null": None, "~": None, "": None}
    if s.lower() in known:
        return known[s.lower()]
    if re.fullmatch(r"-?\d+", s):
        return int(s)
    return float(s) if re.fullmatch(r"-?\d+\.\d+", s) else s


def _mapping(lines: list[str]) -> dict:
    out: dict = {}
    key, nested = None, []
    for line in [*lines, "end:"]:
        top = re.match(r"([^\s:#][^:]*):(?:\s+(.*))?$", line)
        if not top:
            nested.append(line)
            continue
        if key is not None and nested:
            items = [x.strip()[1:] for x in nested if x.strip().startswith("-")]
            inner = [x for x in nested if x.strip() and not x.strip().startswith(("-", "#"))]
            if items:
                out[key] = [_scalar(x) for x in items]
            elif inner:
                depth = min(len(x) - len(x.lstrip()) for x in inner)
                out[key] = _mapping([x[depth:] for x in nested])
        key, nested = top[1].strip(), []
        out[key] = _scalar(top[2] or "")
    out.pop("end", None)
    return out


def blocks(body: str) -> Iterator[tuple[str, int, int, str]]:
    """(kind, first character, last character, text): headings h1 to h6, and code, at the top level of a body.

    Lines inside quotes, lists and code hold no headings; a paragraph line above a row of = or - is one.
    """
    at = 0
    fence = None  # mark and start of an open one
    paragraph: list[str] = []
    start, container = 0, -1  # container: the indent that its lines have at least; -1 outside
    for raw in body.splitlines(keepends=True) if "\x0b" not in body else re.findall(r"[^\n]*\n|[^\n]+", body):
        line, here = raw.rstrip("\r\n"), at
        at += len(raw)
        indent = len(line) - len(line.lstrip(" \t"))
        blank = not line.strip()
        if fence:
            m = FENCE.match(line)
            if m and m[1][0] == fence[0][0] and len(m[1]) >= len(fence[0]) and not m[2].strip():
                yield "code", fence[1], at, ""
                fence = None
            continue
        if container >= 0 and not blank and (indent >= container > 0 or QUOTE.match(line) or ITEM.match(line) and not RULE.match(line)):
            container = max(1, len(ITEM.match(line)[0])) if ITEM.match(line) else container
            continue
        m = FENCE.match(line)
        if m and not (m[1][0] == "`" and "`" in m[2]):
            fence, paragraph, container = (m[1], here), [], -1
            continue
        if blank:
            paragraph = []
            container = -1 if container == 0 else container
            continue
        if not paragraph and container < 0 and indent >= 4:
            yield "code", here, at, ""
            continue
        m = ATX.match(line)
        if m:
            yield f"h{len(m[1])}", here, at, m[2] or ""
            paragraph, container = [], -1
            continue
        m = UNDER.match(line)
        if m and paragraph:
            yield ("h1" if m[1][0] == "=" else "h2"), start, at, " ".join(paragraph)
            paragraph = []
            continue
        if RULE.match(line):
            paragraph, container = [], -1
            continue
        if QUOTE.match(line):
            container, paragraph = 0, []
            continue
        m = ITEM.match(line)
        if m and not paragraph:
            container = max(1, len(m[0]))
            continue
        if container >= 0 and not paragraph:
            continue  # a line that goes on a container's paragraph
        container = -1
        if not paragraph:
            start = here
        paragraph.append(line.strip())
    if fence:
        yield "code", fence[1], len(body), ""


def heading_text(raw: str) -> str:
    text = WIKI.sub(lambda m: m[2] or m[1], raw)
    text = INLINE.sub(lambda m: m[1], text)
    return " ".join(re.sub(r"[*`]|(?<!\w)_|_(?!\w)", "", text).split())[:MOST_HEADING]


def sections(title: str, body: str, line_offset: int = 0) -> list[dict]:
    """Parts of a body between headings of the first three levels, with breadcrumbs, UTF-8 byte ranges and line ranges."""
    if not body.strip():
        return []
    heads = [(lo, int(k[1]), heading_text(t)) for k, lo, _, t in blocks(body) if k[0] == "h" and int(k[1]) <= SPLIT_LEVEL]
    starts: list[tuple[int, int, str, str]] = []
    if not heads or body[: heads[0][0]].strip():
        starts.append((0, 0, "", title))
    path: list[tuple[int, str]] = []
    for lo, level, text in heads:
        path = [x for x in path if x[0] < level] + [(level, text)]
        crumbs = [t for n, (_, t) in enumerate(path) if t and not (n == 0 and t == title)]
        starts.append((lo, level, text, " > ".join([title, *crumbs])))
    starts = starts[:MOST_SECTIONS]
    out = []
    for i, (lo, level, text, crumb) in enumerate(starts):
        hi = starts[i + 1][0] if i + 1 < len(starts) else len(body)
        part = body[lo:hi]
        first = line_offset + body.count("\n", 0, lo) + 1
        byte = len(body[:lo].encode())
        out.append({
            "ord": i, "level": level, "heading": text, "breadcrumb": crumb, "byte_start": byte, "byte_end": byte + len(part.encode()),
            "start_line": first, "end_line": first + part.rstrip("\r\n").count("\n"), "text": part,
        })
    return out


def _outside(body: str) -> str:
    """The body with code as blanks, so that places stay."""
    out = list(body)
    for kind, lo, hi, _ in blocks(body):
        if kind == "code":
            out[lo:hi] = [c if c == "\n" else " " for c in body[lo:hi]]
    return re.sub(r"(`+)(?!`)(.+?)(?<!`)\1(?!`)|<!--.*?-->", lambda m: re.sub(r"[^\n]", " ", m[0]), "".join(out), flags=re.S)


def links(body: str) -> list[tuple[str, str | None, str]]:
    """(target, alias, raw) of wiki links and links to notes, in order; none from code."""
    text = _outside(body)
    found = [(m.start(), m[1].strip(), (m[2] or "").strip() or None, m[0]) for m in WIKI.finditer(text)]
    found += [(m.start(), m[2], m[1] or None, m[0]) for m in INLINE.finditer(text) if not EXTERNAL.match(m[2])]
    return [x[1:] for x in sorted(found)]


def tags(meta: dict, body: str) -> list[str]:
    """Tags of the front matter (list or comma text), then those of the body, each once."""
    own = meta.get("tags") or []
    own = [str(x) for x in own] if isinstance(own, list) else re.split(r"[,\s]+", str(own))
    return list(dict.fromkeys(t for t in [x.strip().lstrip("#") for x in own] + TAG.findall(_outside(body)) if t))


def parse(path: str, content: bytes) -> dict:
    text = content.decode("utf-8", "replace")
    meta, body, offset = front_matter(text)
    stem = path.rsplit("/", 1)[-1].removesuffix(".md")
    first = next((heading_text(t) for k, _, _, t in blocks(body) if k == "h1"), "")
    title = first or str(meta.get("title") or "") or stem or "Untitled"
    return {
        "path": path, "title": title, "frontmatter": json.dumps(meta, ensure_ascii=False, sort_keys=True), "body": body, "body_line_offset": offset,
        "content_hash": xxhash.xxh3_64_hexdigest(content), "links": [dict(zip(("target", "alias", "raw_text"), x, strict=True)) for x in links(body)],
        "tags": tags(meta, body), "sections": sections(title, body, offset),
    }


SECTION = "ord:int,level:int,heading:string,breadcrumb:string,byte_start:long,byte_end:long,start_line:int,end_line:int,text:string"
NOTE = f"path string, title string, frontmatter string, body string, body_line_offset int, content_hash string, links array<struct<target:string,alias:string,raw_text:string>>, tags array<string>, sections array<struct<{SECTION}>>, mtime long"


def scan(spark: SparkSession, root: str) -> DataFrame:
    """path (relative to ``root``), mtime, content of each Markdown file; none from hidden or skipped folders."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", True).option("pathGlobFilter", "*.[mM][dD]").load(root)
    base = root.split(":", 1)[-1].strip("/") + "/"
    rel = F.substring_index(F.col("path"), base, -1)
    rows = files.select(rel.alias("path"), F.unix_timestamp("modificationTime").alias("mtime"), "content")
    return rows.where(~F.exists(F.split("path", "/"), lambda x: x.startswith(".") | x.isin(SKIPPED)) & ~F.lower("path").endswith(".excalidraw.md"))


def read_notes(files: DataFrame) -> DataFrame:
    """The parsed notes of scanned files (path, mtime, content)."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            rows = [parse(p, bytes(c)) | {"mtime": m} for p, m, c in zip(pdf["path"], pdf["mtime"], pdf["content"], strict=True)]
            if rows:
                yield pd.DataFrame(rows)

    ship_code(files.sparkSession)
    return files.select("path", "mtime", "content").mapInPandas(run, NOTE)
