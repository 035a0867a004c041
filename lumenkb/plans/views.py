"""Views that let the generic tables stand in for notes, links and queries."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lumenkb.functions.text import first_line
from lumenkb.session import table

#: 2024-06-01 00:00:00 UTC, in seconds.
NOW = 1_717_200_000
LEVELS = ["L0Ephemeral", "L1Resource", "L2Log", "L3Evergreen"]
FOLDERS = ["daily", "docs", "logs", "cards", "misc"]


def notes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """doc_id, path, title, tags, level, mtime, status, body: a note for each document; its title is its first line, its tags are language and source."""
    docs, labels = table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels")
    status = F.when(F.col("toxic") == 1, "superseded").when(F.col("quality") == 0, "deprecated").otherwise("active")
    level = F.element_at(F.array(*map(F.lit, LEVELS)), (F.col("doc_id") % 4 + 1).cast("int"))
    return docs.join(labels, "doc_id", "left").select(
        "doc_id",
        F.concat_ws("/", "source", "lang", F.concat(F.col("doc_id").cast("string"), F.lit(".md"))).alias("path"),
        first_line(F.col("text")).alias("title"),
        F.array("lang", "source").alias("tags"),
        level.alias("level"),
        (F.lit(NOW) - F.col("doc_id") % 730 * 86_400).alias("mtime"),
        status.alias("status"),
        F.col("text").alias("body"),
    )


def pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """id, path, title, html: a note for each page; its path is its language and the first word of its title."""
    p = table(spark, sf_dir, "pages")
    title = F.regexp_extract("html", "<title>([^<]*)</title>", 1)
    lang = F.regexp_extract("html", 'lang="([a-z]*)"', 1)
    word = F.lower(F.regexp_extract(title, r"([\p{L}\p{N}]+)", 1))
    return p.select(F.col("page_id").alias("id"), F.concat(lang, F.lit("/"), word, F.lit(".md")).alias("path"), F.lower(title).alias("title"), "html")


def page_links(spark: SparkSession, sf_dir: str) -> DataFrame:
    """src, pos, raw_target: the links of each page, without the leading slash."""
    found = F.regexp_extract_all("html", F.lit('href="/?([^"]*)"'), F.lit(1))
    return table(spark, sf_dir, "pages").select(F.col("page_id").alias("src"), F.posexplode(found).alias("pos", "raw_target"))


def code_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """id, path, content: a source file for each document; each of its lines is one of six kinds, with a word in or beside comments and quotes."""
    docs = table(spark, sf_dir, "documents")
    ending = F.element_at(F.array(*map(F.lit, ["rs", "py", "md"])), (F.col("doc_id") % 3 + 1).cast("int"))
    path = F.concat(F.col("source"), F.lit("/"), F.col("doc_id").cast("string"), F.lit("."), ending)
    lines = F.transform(F.split("text", "\n", -1), lambda x: F.regexp_replace(x, "[^A-Za-z ]", ""))

    def kinds(x, i):
        of = [F.concat(x, F.lit(" // password")), F.concat(F.lit('"'), x, F.lit(' // " password')), F.concat(x, F.lit(" /* password */ x")), F.concat(x, F.lit(" # password")), F.concat(F.lit("/* "), x, F.lit(" password")), F.concat(F.lit("no/* \\*/pass"), x, F.lit(" 'it\\'s // ' password"))]
        return F.element_at(F.array(*of), ((F.col("doc_id") + i) % 6 + 1).cast("int"))

    return docs.select(F.col("doc_id").alias("id"), path.alias("path"), F.array_join(F.transform(lines, kinds), "\n").alias("content"))


def rule_notes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """doc_id, path, title, status, frontmatter, body: a note with rules, of one of six forms, for each document; its status is the document's."""
    n = F.col("doc_id").cast("string")
    text = lambda form, *cols: F.format_string(form, *(cols or [n] * form.count("%s")))
    forms = [
        text('- [ADR-%s] (warn) [src/**/*.rs] forbidden: "w, %s", remediation: "Use x, y | z."'),
        text("* **R%s**: files: '*.py', must_contain: need_%s | severity: notice"),
        text("- Forbid `old_%s()` in `src/**/*.rs`. -- Remediation: Use new_%s."),
        text("```yaml\n- id: Y%s\n  forbidden: [a%s, b%s]\n  level: warn\n```"),
        text("```text\n- [N%s] forbidden: x\n```"),
        F.lit("plain words"),
    ]
    body = F.concat(
        F.lit("# T\n- [X-0] forbidden: `outside`\n## Non-Negotiable Invariants of ours\n"), F.element_at(F.array(*forms), (F.col("doc_id") % 6 + 1).cast("int")),
        text('\n### More\n- [S-%s] deny: "shared_%s"\n## Other\n- [X-1] forbidden: `after`\n', (F.col("doc_id") % 10).cast("string"), (F.col("doc_id") % 3).cast("string")),
    )
    front = F.when(F.col("doc_id") % 6 == 5, text('{"invariants": [{"must_contain": "f%s", "pattern": "*.md"}], "supersedes": "[[old-%s]]"}'))
    return notes(spark, sf_dir).select("doc_id", F.concat(F.lit("decisions/n"), n, F.lit(".md")).alias("path"), F.concat(F.lit("T"), n).alias("title"), "status", front.alias("frontmatter"), body.alias("body"))


def note_vectors(spark: SparkSession, sf_dir: str) -> DataFrame:
    """id, v: the vectors of active lasting notes. Every second one is drawn towards the vector four ids before, or is its copy."""
    v = table(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("id"), F.col("embedding").cast("array<double>").alias("v"))
    share = F.when(F.floor(F.col("id") / 8) % 7 == 0, 1.0).otherwise((55 + 8 * (F.floor(F.col("id") / 8) % 5)) / 100.0)
    other = v.select((F.col("id") + 4).alias("id"), F.col("v").alias("w"))
    drawn = F.zip_with("v", "w", lambda x, y: F.col("s") * y + (1 - F.col("s")) * x)
    rows = v.join(other, "id", "left").withColumn("s", share).select("id", F.when(F.col("id") % 8 == 7, drawn).otherwise(F.col("v")).alias("v"))
    lasting = notes(spark, sf_dir).where("status = 'active' and level = 'L3Evergreen'").select(F.col("doc_id").alias("id"))
    return rows.join(lasting, "id")


def cards(spark: SparkSession, sf_dir: str) -> DataFrame:
    """doc_id, name, path, body, level: active notes as cards, with their first line under a heading, in a quote or after a heading."""
    said = F.concat(F.lit("C "), F.col("title"))
    rest = F.concat(F.lit("\n\n"), F.col("body"))
    under = F.concat(F.lit("# T\n## Core Concept\n> "), said, F.lit("\n> [!note] x"), rest)
    body = F.when(F.col("doc_id") % 3 == 0, under).when(F.col("doc_id") % 3 == 1, F.concat(F.lit("> "), said, rest)).otherwise(F.concat(F.lit("# T\n"), said, rest))
    return notes(spark, sf_dir).where("status = 'active'").select("doc_id", F.col("title").alias("name"), "path", body.alias("body"), "level")


def traces(spark: SparkSession, sf_dir: str) -> DataFrame:
    """id, trace, hint, title: a log for each conversation, with commands, errors, tracebacks and results that its turns stand for."""
    turns = table(spark, sf_dir, "conversations")
    first = F.substring(F.regexp_replace("text", r"(?s)[^A-Za-z].*$", ""), 1, 20)
    kinds = [
        F.concat(F.lit("$ cargo "), first), F.concat(F.lit("  error: "), first, F.lit(" failed")), F.concat(F.lit("plain "), first),
        F.concat(F.lit("Traceback (most recent call last):\n  File x.py, line 1\nKeyError: "), first), F.lit("test result: 0 FAILED"), F.concat(F.lit("git "), first),
    ]
    line = F.element_at(F.array(*kinds), ((F.col("turn") + F.col("conv_id")) % 6 + 1).cast("int"))
    log = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("turn", line.alias("line")))), lambda x: x["line"]), "\n")
    rows = turns.groupBy(F.col("conv_id").alias("id")).agg(log.alias("trace"))
    return rows.select("id", "trace", F.when(F.col("id") % 5 == 0, "a hint").alias("hint"), F.lit(None).cast("string").alias("title"))
