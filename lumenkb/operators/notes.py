"""Columns of single notes: status, level, dates, names."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lumenkb.functions.text import slugify

#: Folder names that tell a note's level (fixed values), in the order in which they are tried for each folder.
LEVEL_FOLDERS = {
    "L0Ephemeral": ["00_daily", "0_daily", "daily", "ephemeral", "scratch", "inbox", "dailies", "fleeting"],
    "L2Log": ["01_ai_logs", "30_logs", "logs", "ai_logs", "journal", "records", "postmortems"],
    "L3Evergreen": ["20_cards", "2_cards", "cards", "decisions", "concepts", "architecture", "adr", "specs", "rules", "projects", "10_projects", "1_projects", "wiki", "skills", "playbooks", "evergreen"],
    "L1Resource": ["30_resources", "3_resources", "resources", "references", "docs"],
}
#: Kinds in the front matter that tell it before the folders do (fixed values).
LEVEL_KINDS = {
    "L3Evergreen": ["decision", "adr", "card", "concept", "project", "architecture", "evergreen"],
    "L2Log": ["log", "ai-log", "session", "postmortem", "record"],
    "L0Ephemeral": ["daily", "ephemeral", "scratch", "inbox"],
    "L1Resource": ["resource", "reference", "doc"],
}


def level(path: Column, kind: Column, fallback: str = "L1Resource", override: Column | None = None) -> Column:
    """The level by override, kind, innermost telling folder; notes outside folders last; else ``fallback``."""
    def of(value: Column, names: dict[str, list[str]]) -> Column:
        out = F.lit(None).cast("string")
        for name, values in reversed(names.items()):
            out = F.when(value.isin(values), name).otherwise(out)
        return out

    parts = F.split(F.lower(path), "/")
    folders = F.reverse(F.slice(parts, 1, F.size(parts) - 1))
    told = F.filter(F.transform(folders, lambda f: of(f, LEVEL_FOLDERS)), lambda x: x.isNotNull())
    inner = F.when(F.size(told) > 0, F.element_at(told, 1))
    out = F.coalesce(of(F.lower(F.trim(kind)), LEVEL_KINDS), inner, F.when(~path.contains("/"), "L3Evergreen"), F.lit(fallback))
    return out if override is None else F.coalesce(override, out)


def lifecycle(status: Column, superseded_by: Column, tags: Column, body: Column) -> Column:
    """active, superseded, deprecated or archived: by the status text, a successor, status tags, or a callout in the first five lines."""
    s = F.lower(F.trim(status))
    by_text = F.when(s.rlike("^superseded($| |_by)"), "superseded").when(s.rlike("^(deprecated|rejected)($| )|^obsolete$"), "deprecated").when(s.rlike("^archived($| )|^retired$"), "archived")
    by_note = F.when(F.trim(superseded_by) != "", "superseded")
    plain = F.transform(tags, lambda t: F.lower(F.regexp_replace(F.trim(t), "^#+", "")))
    told = F.filter(plain, lambda t: t.isin("status/superseded", "status/deprecated", "status/obsolete", "status/archived"))
    tag = F.when(F.size(told) > 0, F.element_at(told, 1))
    by_tag = F.when(tag == "status/superseded", "superseded").when(tag == "status/archived", "archived").when(tag.isNotNull(), "deprecated")
    head = F.slice(F.split(body, "\n", -1), 1, 5)
    callout = F.exists(head, lambda x: F.upper(F.ltrim(x)).rlike(r"^> \[(SUPERSEDED\]|!?WARN\] SUPERSEDED)"))
    return F.coalesce(by_text, by_note, by_tag, F.when(callout, "superseded"), F.lit("active"))


def stale(date: Column, now: int) -> Column:
    """Whether a day (yyyy-MM-dd text) is over; null if it isn't a date."""
    return F.lit(now) >= F.unix_timestamp(F.try_to_timestamp(date, F.lit("yyyy-MM-dd"))) + 86_400


def category(raw: Column, body: Column) -> Column:
    """The canonical category of a note to be written."""
    c = F.lower(F.trim(raw))
    return (
        F.when(c == "", "log")
        .when(c.isin("card", "cards"), F.when(body.contains("## Non-Negotiable Invariants"), "decision").otherwise("concept"))
        .when(c.isin("adr", "adrs", "decisions"), "decision").when(c.isin("concepts", "wiki"), "concept")
        .when(c.isin("logs", "journal", "daily", "records"), "log").when(c == "projects", "project")
        .when(c.isin("skills", "playbook", "playbooks", "recipe", "recipes", "troubleshooting"), "skill").otherwise(c)
    )


def file_names(notes: DataFrame) -> DataFrame:
    """id, file_name: notes (id, folder, title, body) to be written; equal text in a folder is one file, another text of the same name gets -v2, -v3."""
    rows = notes.select("id", "folder", slugify(F.col("title")).alias("slug"), F.md5("body").alias("hash"))
    first = rows.groupBy("folder", "slug", "hash").agg(F.min("id").alias("first"))
    n = F.row_number().over(Window.partitionBy("folder", "slug").orderBy("first"))
    named = first.withColumn("n", n).select("folder", "slug", "hash", F.concat("slug", F.when(F.col("n") > 1, F.concat(F.lit("-v"), F.col("n").cast("string"))).otherwise(""), F.lit(".md")).alias("file_name"))
    return rows.join(named, ["folder", "slug", "hash"]).select("id", "file_name")


def pack_select(notes: DataFrame, query: str | None = None, tags: list[str] | None = None) -> DataFrame:
    """Notes (path, title, body, tags) with a tag of ``tags`` and with ``query`` in title, body or path; none from passing folders."""
    rows = notes.where(~F.exists(F.split(F.lower("path"), "/"), lambda x: x.isin(LEVEL_FOLDERS["L0Ephemeral"])))
    if tags:
        wanted = [t.lstrip("#").lower() for t in tags]
        rows = rows.where(F.exists("tags", lambda t: F.lower(F.regexp_replace(t, "^#+", "")).isin(wanted)))
    if query:
        rows = rows.where(F.lower("title").contains(query.lower()) | F.lower("body").contains(query.lower()) | F.lower("path").contains(query.lower()))
    return rows


def keyword_score(name: Column, path: Column, concept: Column, keywords: Column, linked: Column) -> Column:
    """20 for a keyword that is the name, 10 for one in it, 4 in the path, 3 in the concept, and 1 if linked; keywords of one byte don't count."""
    n, p, c = F.lower(name), F.lower(path), F.lower(concept)
    one = lambda k: F.when(n == k, 20).when(n.contains(k), 10).otherwise(0) + F.when(p.contains(k), 4).otherwise(0) + F.when(c.contains(k), 3).otherwise(0)
    return F.aggregate(keywords, F.lit(0), lambda a, k: a + F.when(F.octet_length(k) > 1, one(k)).otherwise(0)) + F.when(linked, 1).otherwise(0)
