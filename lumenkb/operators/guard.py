"""Rules over files and diffs."""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lumenkb.functions.code import without_comments

#: What in a pattern or an id says that a rule is about comments too (fixed values); case counts in the first list only.
RAW_MARKS = ["//", "/*", "# ", "<<<<<<<", "======="]
RAW_WORDS = ["PRIVATE KEY", "BEGIN ", "SECRET", "AKIA", "@TS-IGNORE", "@TS-EXPECT-ERROR", "@TS-NOCHECK", "ESLINT-DISABLE", "BIOME-IGNORE", "TYPE: IGNORE", "PYRIGHT: IGNORE", "NOQA", "NOLINT", "TODO(", "FIXME", "WORKAROUND", "HACK"]
RAW_STARTS = ["GHP_", "SK-"]
RAW_IDS = ["SECRET", "TOKEN", "KEY", "SLOP", "COMMENT", "SUPPRESS", "PII", "PRIVACY"]
#: Rules that one plan holds; more go in blocks.
MOST_RULES = 500


def compiled(pattern: str) -> str:
    """The regular expression of a rule's pattern: an identifier as a whole word, ``name()`` as a call, plain text as itself."""
    if re.fullmatch(r"[A-Za-z0-9][A-Za-z0-9_]*[A-Za-z0-9]|[A-Za-z0-9]", pattern):
        return rf"\b{pattern}\b"
    if pattern.endswith("()") and not pattern.endswith("\\()"):
        return (r"\b" if re.match(r"[A-Za-z0-9_]", pattern) else "") + re.escape(pattern[:-2]) + r"\s*\("
    try:
        re.compile(pattern)
    except re.error:
        return re.escape(pattern)
    return pattern if re.search(r"[\\\[\](){}.*+?^$|]", pattern) else re.escape(pattern)


def file_regex(pattern: str) -> str:
    """A regular expression for comma-separated globs with braces; one without a slash is about the file's name."""
    def one(glob: str) -> str:
        m = re.search(r"\{([^{}]*)\}", glob)
        if m:
            return "|".join(one(glob[: m.start()] + x + glob[m.end() :]) for x in m[1].split(","))
        out = re.escape(glob).replace(r"\*\*/", "(.*/)?").replace(r"\*\*", ".*").replace(r"\*", "[^/]*").replace(r"\?", "[^/]")
        return f"(^|.*/){out}$"

    depth, parts, last = 0, [], 0
    for i, c in enumerate(pattern + ","):
        depth += (c == "{") - (c == "}")
        if c == "," and not depth:
            parts.append(pattern[last:i].strip())
            last = i + 1
    return "|".join(one(p) for p in parts if p)


def applies(rule: dict, path: Column) -> Column:
    """Whether a rule is about a file: by its glob, and never about the note that states it."""
    own = F.lit(True)
    if rule.get("source_note"):
        own = ~((path == rule["source_note"]) | path.endswith("/" + rule["source_note"]) | F.lit(rule["source_note"]).endswith(F.concat(F.lit("/"), path)))
    return own & (path.rlike(file_regex(rule["file_pattern"])) if rule.get("file_pattern") else F.lit(True))


def reads_comments(rule: dict) -> bool:
    """Whether a forbidding rule is about whole lines; others are about lines without their comments."""
    pattern, upper, name = rule["pattern"], rule["pattern"].upper(), rule["id"].upper()
    return bool(rule.get("include_comments")) or any(x in pattern for x in RAW_MARKS) or any(x in upper for x in RAW_WORDS) or upper.startswith(tuple(RAW_STARTS)) or any(x in name for x in RAW_IDS)


def rule_list(rules: DataFrame) -> list[list[dict]]:
    """Rules of a table (see ``operators.rules``) as ``forbidden`` and the others take them, in blocks of at most MOST_RULES."""
    rows = [r.asDict() for r in rules.orderBy("id", "kind", "pattern").toLocalIterator()]
    return [rows[i : i + MOST_RULES] for i in range(0, len(rows), MOST_RULES)]


def _each(rules: list[dict], kind: str, text: Column, path: Column, negate: bool = False, code: Column | None = None) -> Column:
    """The rules of a kind that a text violates, as an array; each is a literal pattern, compiled once. ``code``: the text without comments."""
    hits = []
    for r in rules:
        if r["kind"] == kind:
            found = text.rlike(compiled(r["pattern"])) if code is None or reads_comments(r) else (F.trim(code) != "") & code.rlike(compiled(r["pattern"]))
            hits.append(F.when((~found if negate else found) & applies(r, path), F.struct(F.lit(r["id"]).alias("rule_id"), F.lit(r["severity"]).alias("severity"))))
    return F.filter(F.array(*hits), lambda x: x.isNotNull()) if hits else F.array().cast("array<struct<rule_id:string,severity:string>>")


def forbidden(files: DataFrame, rules: list[dict]) -> DataFrame:
    """rule_id, id, line_no, severity: lines of files (id, path, content) that match a forbidding rule, outside comments unless the rule is about these."""
    lines = files.select("id", "path", F.posexplode(F.split("content", "\n", -1)).alias("i", "line")).withColumn("code", without_comments(F.col("line"), F.col("path")))
    rows = lines.select("id", (F.col("i") + 1).cast("long").alias("line_no"), F.explode(_each(rules, "forbidden", F.col("line"), F.col("path"), code=F.col("code"))).alias("v"))
    return rows.select("v.rule_id", "id", "line_no", "v.severity")


def must_contain(files: DataFrame, rules: list[dict]) -> DataFrame:
    """rule_id, id, severity: files that lack what a rule asks for."""
    rows = files.select("id", F.explode(_each(rules, "must_contain", F.col("content"), F.col("path"), negate=True)).alias("v"))
    return rows.select("v.rule_id", "id", "v.severity")


def report(files: DataFrame, rules: list[dict]) -> DataFrame:
    """id, violations, is_passed: passed unless a violation denies."""
    found = forbidden(files, rules).select("id", "severity").unionByName(must_contain(files, rules).select("id", "severity"))
    counts = found.groupBy("id").agg(F.count(F.lit(1)).alias("violations"), F.count_if(F.col("severity") == "deny").alias("denied"))
    rows = files.select("id").join(counts, "id", "left")
    return rows.select("id", F.coalesce("violations", F.lit(0)).alias("violations"), (F.coalesce("denied", F.lit(0)) == 0).alias("is_passed"))


def diff_lines(diffs: DataFrame) -> DataFrame:
    """diff_id, path, kind, line_no, content of unified diffs (diff_id, diff): kind + or - for lines, x for a file that goes.

    A line that starts with @@ opens a hunk and says how many old and new lines it has. Running sums over the lines after
    it tell which of them still belong to it, and their numbers in the new file, so that content that looks like a file
    header stays content. A removed line has the number of the place that it was taken from.
    """
    lines = diffs.select("diff_id", F.posexplode(F.split(F.coalesce("diff", F.lit("")), "\r?\n", -1)).alias("at", "s"))
    head = r"^@@ -\d+(?:,(\d+))? \+(\d+)(?:,(\d+))? @@"
    before = Window.partitionBy("diff_id").orderBy("at")
    lines = lines.withColumn("opens", F.col("s").rlike(head)).withColumn("hunk", F.sum(F.col("opens").cast("int")).over(before))
    number = lambda group: F.when(F.col("opens"), F.coalesce(F.nullif(F.regexp_extract("s", head, group), F.lit("")), F.lit("1")).cast("long"))
    inside = Window.partitionBy("diff_id", "hunk").orderBy("at")
    earlier = inside.rowsBetween(Window.unboundedPreceding, -1)
    for name, group in (("old", 1), ("first", 2), ("new", 3)):
        lines = lines.withColumn(name, F.first(number(group)).over(inside))
    mark = F.when(F.col("s") == "", " ").otherwise(F.substring("s", 1, 1))
    lines = lines.withColumn("mark", F.when(F.col("opens") | (F.col("hunk") == 0), "@").otherwise(mark))
    used = lambda *marks: F.coalesce(F.sum(F.col("mark").isin(*marks).cast("long")).over(earlier), F.lit(0))
    lines = lines.withColumn("old_left", F.col("old") - used("-", " ")).withColumn("new_left", F.col("new") - used("+", " ")).withColumn("line_no", F.col("first") + used("+", " "))
    fits = F.when(F.col("mark").isin("+", "-", " "), (F.col("old_left") > 0) | (F.col("new_left") > 0)).otherwise(F.col("opens") | (F.col("mark") == "\\"))
    # what follows a line that doesn't fit is no part of the hunk either
    lines = lines.withColumn("content", (F.col("hunk") > 0) & F.min(fits.cast("int")).over(inside).cast("boolean"))
    name = lambda x: F.nullif(F.regexp_replace(F.btrim(F.split_part(x, F.lit("\t"), F.lit(1)), F.lit(' "')), "^[ab]/", ""), F.lit("/dev/null"))
    named = F.when(F.col("content"), None).when(F.col("s").startswith("diff --git "), F.coalesce(name(F.regexp_extract("s", "([^ ]*)$", 1)), F.lit(""))).when(F.col("s").startswith("+++ "), name(F.substring("s", 5, 1 << 30)))
    lines = lines.withColumn("path", F.coalesce(F.last(named, ignorenulls=True).over(before), F.lit("")))
    kind = F.when(F.col("content") & F.col("mark").isin("+", "-"), F.col("mark")).when(~F.col("content") & ((F.col("s") == "+++ /dev/null") | F.col("s").startswith("deleted file mode")), "x")
    gone = F.col("kind") == "x"
    rows = lines.withColumn("kind", kind).where("kind is not null")
    return rows.select("diff_id", "path", "kind", F.when(gone, 0).otherwise(F.col("line_no")).cast("long").alias("line_no"), F.when(gone, "").otherwise(F.rtrim(F.substring("s", 2, 1 << 30))).alias("content"))


def audit_diffs(diffs: DataFrame, rules: list[dict]) -> DataFrame:
    """diff_id, rule_id, path, line_no: added lines that a rule forbids, and files whose change takes away what a rule asks for."""
    lines = diff_lines(diffs)
    added = lines.where("kind = '+'").withColumn("code", without_comments(F.col("content"), F.col("path")))
    bad = added.select("diff_id", "path", "line_no", F.explode(_each(rules, "forbidden", F.col("content"), F.col("path"), code=F.col("code"))).alias("v"))
    bad = bad.select("diff_id", "v.rule_id", "path", "line_no")
    asks = [r for r in rules if r["kind"] == "must_contain"]
    for r in asks:
        hit = F.col("content").rlike(compiled(r["pattern"]))
        files = lines.where(applies(r, F.col("path"))).groupBy("diff_id", "path").agg(
            F.max(F.col("kind") == "x").alias("gone"),
            F.max((F.col("kind") == "-") & hit).alias("lost"), F.max((F.col("kind") == "+") & hit).alias("has"),
            F.min(F.when(F.col("kind") == "-", F.col("line_no"))).alias("from_line"), F.min(F.when(F.col("kind") == "+", F.col("line_no"))).alias("to_line"),
        )
        found = files.where("not gone and not has and (lost or to_line is not null)")
        bad = bad.unionByName(found.select("diff_id", F.lit(r["id"]).alias("rule_id"), "path", F.when(F.col("lost"), F.col("from_line")).otherwise(F.col("to_line")).alias("line_no")))
    return bad


def first_rules(rules: DataFrame) -> DataFrame:
    """Rules (id, pattern, source, order) but for repeats of an id and pattern, of which the first stays."""
    w = Window.partitionBy("id", "pattern").orderBy("order")
    return rules.withColumn("_n", F.row_number().over(w)).where("_n = 1").drop("_n")
