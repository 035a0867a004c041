"""Which files of a tree are scanned: ignore patterns with negation, and files that stand for their neighbours."""

from __future__ import annotations

import re
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from lumenkb.sources.markdown import scan

#: A comment of an ignore file that names such files, for instance ``# canonical-sibling = index.md, "main.md"``.
DIRECTIVE = re.compile(r"\s*#\s*(?:[\w.-]+:)?canonical-sibling\s*=(.*)$")


@dataclass
class Ignore:
    """``patterns``: (regular expression of a whole path, only for folders, keeps), in their order. ``siblings``: file names."""

    patterns: list[tuple[str, bool, bool]] = field(default_factory=list)
    siblings: list[str] = field(default_factory=list)


def pattern_regex(glob: str) -> str:
    """The regular expression of a pattern without its marks; one that holds a slash is about a path from the root, others about names."""
    anchored = "/" in glob
    out, rest = "" if anchored else "(?:.*/)?", glob.lstrip("/")
    rules = [
        (r"(?:^|(?<=/))\*\*/", lambda m: "(?:.*/)?"), (r"(?<=/)\*\*$", lambda m: ".+"), (r"\*+", lambda m: "[^/]*"), (r"\?", lambda m: "[^/]"),
        (r"\[(!|\^)?(\]?[^\]]+)\]", lambda m: f"[{'^/' if m[1] else ''}{m[2].replace('[', chr(92) + '[')}]"), (r"\\(.)", lambda m: re.escape(m[1])), (r".", lambda m: re.escape(m[0])),
    ]
    at = 0
    while at < len(rest):
        for rule, turn in rules:
            if m := re.compile(rule, re.S).match(rest, at):
                out, at = out + turn(m), m.end()
                break
    return out


def parse_ignore(text: str) -> Ignore:
    """The rules of an ignore file: a pattern a line; ``!`` keeps, a slash at the end is about folders, a backslash escapes."""
    rules = Ignore()
    for line in text.splitlines():
        if m := DIRECTIVE.match(line):
            names = [x.strip().strip("\"'").strip() for x in m[1].split(",")]
            rules.siblings += [x for x in dict.fromkeys(names) if x and x not in rules.siblings]
        line = re.sub(r"(?<!\\)\s+$", "", line)
        if not line or line.startswith("#"):
            continue
        keeps = line.startswith("!")
        glob = line[keeps:].removeprefix("\\") if re.match(r"\\[#!]", line[keeps:]) else line[keeps:]
        if glob.strip("/"):
            rules.patterns.append((pattern_regex(glob.rstrip("/") if glob.endswith("/") else glob), glob.endswith("/"), keeps))
    return rules


def ignored(path: Column, rules: Ignore) -> Column:
    """Whether a file's path is ignored: by the last pattern that is about it, else about its folder, the folder above, and so on."""
    parts = F.split(path, "/")
    levels = F.transform(F.sequence(F.size(parts), F.lit(1)), lambda n: F.array_join(F.slice(parts, F.lit(1), n), "/"))

    def told(p: Column) -> Column:
        out = F.lit(None).cast("boolean")
        for regex, folders, keeps in rules.patterns:  # a later pattern is asked first
            about = p.rlike(f"^{regex}$") & (p != path) if folders else p.rlike(f"^{regex}$")
            out = F.when(about, not keeps).otherwise(out)
        return out

    return F.coalesce(F.get(F.filter(F.transform(levels, told), lambda x: x.isNotNull()), 0), F.lit(False))


def kept_files(files: DataFrame, rules: Ignore) -> DataFrame:
    """``files`` (path, relative to the root, with forward slashes; more) that are scanned.

    No drawings, nothing ignored, and in a folder with a file of one of the siblings' names, which isn't ignored itself,
    no other Markdown file. Folders below it are on their own. Null paths go.
    """
    rows = files.where(F.col("path").isNotNull() & ~F.lower("path").endswith(".excalidraw.md") & ~ignored(F.col("path"), rules))
    if not rules.siblings:
        return rows
    folder, name = F.regexp_replace("path", "[^/]*$", ""), F.regexp_extract("path", "([^/]*)$", 1)
    led = rows.where(name.isin(rules.siblings)).select(folder.alias("_folder")).distinct()
    rows = rows.withColumn("_folder", folder).join(led.withColumn("_led", F.lit(True)), "_folder", "left")
    return rows.where(F.col("_led").isNull() | name.isin(rules.siblings) | ~F.lower("path").endswith(".md")).drop("_folder", "_led")


def scan_kept(spark: SparkSession, root: str, ignore_file: str = ".notesignore") -> DataFrame:
    """``markdown.scan`` of a tree without what the ignore file at its root excludes; without one nothing more is."""
    jvm = spark.sparkContext._jvm
    path = jvm.org.apache.hadoop.fs.Path(f"{root.rstrip('/')}/{ignore_file}")
    fs, text = path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()), ""
    if fs.exists(path):  # Spark's own readers pass over files whose names begin with a dot
        stream = fs.open(path)
        text = bytes(jvm.org.apache.commons.io.IOUtils.toByteArray(stream)).decode("utf-8", "replace")
        stream.close()
    return kept_files(scan(spark, root), parse_ignore(text))
