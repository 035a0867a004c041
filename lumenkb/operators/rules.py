"""Rules that notes and configuration files state, and which of them hold for a change."""

from __future__ import annotations

import json
import re
import tomllib
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lumenkb.functions.text import slugify
from lumenkb.session import ship_code

#: Headings whose sections state rules, in lower case (fixed values).
HEADINGS = ["non-negotiable invariants", "核心工程铁律", "architectural invariants", "架构铁律"]
#: What keys of an item mean; the others known end a value but say nothing (fixed values).
KEYS = {
    "file_pattern": ["files", "file", "file_pattern", "scope", "paths"],
    "severity": ["severity", "level"],
    "must_contain": ["must_contain", "mustcontain", "must-contain", "must", "require"],
    "forbidden": ["forbidden", "forbid", "deny"],
    "remediation": ["remediation", "fix", "fix_hint", "description", "action"],
    "title": ["title"],
    "include_comments": ["include_comments", "scan_comments"],
    "": ["id", "condition", "pattern"],
}
MEANING = {name: meaning for meaning, names in KEYS.items() for name in names}
#: Severities that only warn (fixed values).
WARNINGS = ["warn", "warning", "info", "notice"]
#: Words that begin a sentence that is a rule, and what may part its remediation from it, in the order tried (fixed values).
VERBS = {"forbidden": "forbidden", "forbid": "forbidden", "deny": "forbidden", "must contain": "must_contain", "must_contain": "must_contain", "require": "must_contain"}
PARTS = ["—", " -- ", " | ", "; "]
#: Folders that state no rules (fixed values).
PASSING = ["00_daily", "01_ai_logs", "30_logs", "daily", "logs", "journal"]

RULE = "id string, title string, source_note string, file_pattern string, kind string, pattern string, severity string, remediation string, include_comments boolean"
QUOTED = re.compile(r"""\\.|(["'`])(?:\\.|(?!\1)[^\\])*+(?:\1|$)|([|,])(?=\s*([\w-]+)\s*:)""", re.S | re.A)


def severity(text: str) -> str:
    return "warn" if text.strip().lower() in WARNINGS else "deny"


def unquoted(value: str) -> str:
    value = value.strip()
    if len(value) > 1 and value[0] == value[-1] and value[0] in "\"'`":
        value = value[1:-1]
    return value.replace("\\\\", "\\")


def bracketed(text: str) -> tuple[str, str] | None:
    """What stands in the brackets that a text begins with, and what comes after them; brackets may hold others."""
    depth = 0
    for m in re.finditer(r"[\[\]]", text if text.startswith("[") else ""):
        depth += 1 if m[0] == "[" else -1
        if not depth:
            return text[1 : m.start()].strip(), text[m.end() :]
    return None


def key_values(text: str) -> dict:
    """The values of known keys: ``key: value`` parts between bars or commas that a known key follows, outside quotes."""
    cuts = [m.start(2) for m in QUOTED.finditer(text) if m[2] and m[3].lower() in MEANING]
    found = {}
    for lo, hi in zip([0, *[c + 1 for c in cuts]], [*cuts, len(text)], strict=True):
        key, colon, value = text[lo:hi].strip().partition(":")
        if colon and (meaning := MEANING.get(key.strip().lower())):
            found[meaning] = unquoted(value)
    return found


def word(text: str) -> tuple[str, str]:
    """A quoted text, else the first run without blanks, and what comes after it."""
    text = text.lstrip()
    if m := re.match(r"([`\"'])(.*?)\1", text, re.S):
        return m[2], text[m.end() :]
    end = m.start() if (m := re.search(r"\s", text)) else len(text)
    return unquoted(text[:end]), text[end:]


def sentence(text: str) -> dict:
    """A rule in words: a verb, what it is about, ``in`` which files, and a remediation after a dash, bar or semicolon."""
    found, text = {}, text.strip()
    for part in PARTS:
        before, there, after = text.partition(part)
        if there and (m := re.match(r"(?:remediation[: ]|fix:|fix_hint:)", after.strip(), re.I | re.A)):
            found.setdefault("remediation", unquoted(after.strip()[m.end() :]))
            text = before.strip()
    verb = re.match(rf"({'|'.join(VERBS)}) ", text, re.I | re.A)
    pattern, rest = word(text[verb.end() :]) if verb else ("", "")
    if not pattern:
        return found if found.get("remediation") else {}
    found[VERBS[verb[1].lower()]] = pattern
    if m := re.match(r"in ", rest.strip(), re.I | re.A):
        glob = word(rest.strip()[m.end() :])[0]
        found |= {"file_pattern": glob.rstrip(".")} if glob else {}
    return found


def item_rules(line: str, source: str) -> list[dict]:
    """The rules of a list item: ``[ID] (severity) [files] ...``, ``**ID**: ...`` or one that begins with or holds a verb."""
    text = line.strip()
    text = text[2:].strip() if text.startswith(("- ", "* ")) else text[1:].strip() if re.match(r"-(?!-)", text) else text
    head, found, colon = bracketed(text), {}, ""
    if head:
        name, rest = head
    elif text.startswith("**"):
        if not (m := re.match(r"\*\*(.*?)\*\*", text, re.S)):
            return []
        name, rest, colon = m[1].strip(), text[m.end() :].lstrip(":"), ":"
        name = name[1:-1].strip() if len(name) > 1 and name[0] == "[" and name[-1] == "]" else name
    else:
        asked = r"(?:forbidden|forbid|deny|must_contain|mustcontain|must-contain|must|require):|^(?:forbid|forbidden|deny|require|must contain) "
        if not re.search(asked, text, re.I | re.A):
            return []
        stem = re.sub(r"(?<=.)\.[^.]*$", "", source.rsplit("/", 1)[-1]) or "anon"
        number = 0
        for byte in text.encode():
            number = (31 * number + byte) % 2**16
        name, rest = f"RULE-{stem}-{number:04x}", text
    if head or colon:
        rest = rest.strip()
        if m := re.match(r"\(([^)]*)\)", rest):
            found["severity"], rest = m[1], rest[m.end() :].lstrip(colon or None).strip()
        if files := bracketed(rest):
            found["file_pattern"], rest = files[0], files[1].lstrip(colon or None).strip()
    found |= key_values(rest)
    if not {"must_contain", "forbidden"} & set(found):
        found = sentence(rest) | {k: v for k, v in found.items() if v or k != "remediation"}
    comments = found.get("include_comments", "").lower() in ("true", "1", "yes")
    shared = {"id": name, "title": found.get("title") or name, "source_note": source, "file_pattern": found.get("file_pattern"), "severity": severity(found.get("severity", "")), "remediation": found.get("remediation", ""), "include_comments": comments}
    return [shared | {"kind": k, "pattern": found[k]} for k in ("must_contain", "forbidden") if name and k in found]


def object_rules(value: dict, default_id: str, source: str) -> list[dict]:
    """The rules of an object in front matter, a YAML block or a configuration file."""
    texts = lambda x: [x] if isinstance(x, str) else [y for y in x if isinstance(y, str)] if isinstance(x, list) else []
    first = lambda *keys: next((value[k] for k in keys if value.get(k) is not None), None)
    text = lambda x: x if isinstance(x, str) else None
    name = value["id"] if isinstance(value.get("id"), str) else default_id
    files = ",".join(texts(first("file_pattern", "files", "scope", "paths"))) or None
    condition = value.get("condition")
    nested = condition if isinstance(condition, dict) else {}
    says = any(k in x for x in (value, nested) for k in ("forbidden", "forbid", "must_contain"))
    if files is None and condition is None and says:
        files = text(value.get("pattern"))
    shared = {
        "title": text(value.get("title")) or name, "source_note": source, "file_pattern": files, "severity": severity(text(first("severity", "level")) or ""),
        "remediation": text(first("remediation", "fix", "fix_hint", "description", "action")) or "", "include_comments": first("include_comments", "scan_comments") is True,
    }
    kinds = {"forbidden": "forbidden", "forbid": "forbidden", "deny": "forbidden", "must_contain": "must_contain", "must": "must_contain", "require": "must_contain"}
    said = [("must_contain", texts(value.get("must_contain"))), ("forbidden", texts(first("forbidden", "forbid")))]
    if isinstance(condition, str) and isinstance(value.get("pattern"), str) and condition.lower() in kinds:
        said.append((kinds[condition.lower()], [value["pattern"]]))
    said += [("must_contain", texts(nested.get("must_contain"))), ("forbidden", texts(nested.get("forbidden", nested.get("forbid"))))]
    return [shared | {"id": f"{name}-{i}" if len(patterns) > 1 else name, "kind": kind, "pattern": p} for kind, patterns in said for i, p in enumerate(patterns, 1)]


def _objects(values, name: str, source: str) -> list[dict]:
    values = values if isinstance(values, list) else []
    return [r for i, v in enumerate(values, 1) if isinstance(v, dict) for r in object_rules(v, f"{name}-{i}", source)]


def _yaml(text: str):
    """The value of a YAML text, None if it is none."""
    try:
        import yaml
    except ImportError as e:
        raise ImportError("rules in YAML need PyYAML") from e
    try:
        return yaml.safe_load(text)
    except yaml.YAMLError:
        return None


def config_rules(path: str, content: str) -> list[dict]:
    """The rules of a TOML or YAML file."""
    if path.lower().endswith(".toml"):
        value = tomllib.loads(content)
    elif path.lower().endswith((".yaml", ".yml")):
        value = _yaml(content)
    else:
        return []
    listed = value if isinstance(value, list) else (value.get("rules", value.get("invariants")) if isinstance(value, dict) else None)
    return _objects(listed, "CONF", path)


def stated(kind: str, text: str, title: str, source: str) -> list[dict]:
    """The rules of one part of a note: its front matter (JSON), a YAML block or a list item."""
    if kind == "front":
        value = json.loads(text)
        known = [value[k] for k in ("invariants", "guard_rules", "rules") if value.get(k) is not None] if isinstance(value, dict) else []
        return _objects(known[0] if known else None, title, source)
    return _objects(_yaml(text), "BODY-RULE", source) if kind == "yaml" else item_rules(text, source)


def rule_parts(notes: DataFrame) -> DataFrame:
    """doc_id, at, kind, text: the parts of notes (doc_id, frontmatter, body) that may state rules.

    Only sections under one of HEADINGS count, up to the next heading of their level or above; deeper ones belong to
    them. Fenced text is neither heading nor item; a YAML fence that closes in such a section is a part.
    """
    lines = notes.select("doc_id", F.posexplode(F.split("body", "\r?\n", -1)).alias("at", "line")).withColumn("s", F.trim(F.regexp_replace("line", r"(?U)^\s+|\s+$", "")))
    order = Window.partitionBy("doc_id").orderBy("at")
    fence = F.col("s").startswith("```")
    lines = lines.withColumn("fence", fence).withColumn("fences", F.sum(fence.cast("int")).over(order))
    inside = (F.col("fences") % 2 == 1) | F.col("fence")
    level = F.length(F.regexp_extract("s", r"^(#+)", 1))
    heading = F.lower(F.trim(F.regexp_replace("s", r"^#+", "")))
    lines = lines.withColumn("level", F.when(~inside & (level > 0), level)).withColumn("opens", F.col("level").isNotNull() & heading.rlike("|".join(re.escape(h) for h in HEADINGS)))
    lines = lines.withColumn("section", F.sum(F.col("opens").cast("int")).over(order))
    within = Window.partitionBy("doc_id", "section").orderBy("at")
    depth, since = F.first("level").over(within), F.min(F.when(~F.col("opens"), F.col("level"))).over(within)
    lines = lines.withColumn("states", (F.col("section") > 0) & (since.isNull() | (since > depth)))
    items = lines.where(~inside & F.col("states") & ~F.col("opens") & F.col("s").rlike(r"^[-*]")).select("doc_id", "at", F.lit("item").alias("kind"), F.col("s").alias("text"))

    blocks = lines.where(inside).withColumn("block", F.ceil(F.col("fences") / 2)).withColumn("closing", F.col("fence") & (F.col("fences") % 2 == 0))
    language = F.lower(F.trim(F.regexp_replace(F.min_by("s", "at"), r"^`+", "")))
    content = F.array_join(F.transform(F.array_sort(F.collect_list(F.when(~F.col("fence"), F.struct("at", "line")))), lambda x: x["line"]), "\n")
    blocks = blocks.groupBy("doc_id", "block").agg(F.max(F.when(F.col("closing"), F.col("at"))).alias("at"), F.max(F.col("closing") & F.col("states")).alias("states"), language.alias("language"), content.alias("text"))
    blocks = blocks.where(F.col("states") & F.col("language").rlike("ya?ml")).select("doc_id", "at", F.lit("yaml").alias("kind"), "text")
    front = notes.where(F.col("frontmatter").rlike('"(invariants|guard_rules|rules)"')).select("doc_id", F.lit(-1).alias("at"), F.lit("front").alias("kind"), F.col("frontmatter").alias("text"))
    return front.unionByName(items).unionByName(blocks)


def listed(frontmatter: Column, key: str) -> Column:
    """The texts of a front matter value that is a text or a list of texts, at the top or under relations."""
    raw = F.coalesce(F.get_json_object(frontmatter, f"$.{key}"), F.get_json_object(frontmatter, f"$.relations.{key}"))
    values = F.coalesce(F.when(raw.startswith("["), F.from_json(raw, "array<string>")), F.array(raw))
    return F.filter(F.transform(values, lambda x: F.trim(x)), lambda x: x.isNotNull() & (x != ""))


def note_rules(notes: DataFrame) -> DataFrame:
    """doc_id, at, n and the columns of RULE: the rules of active notes, in their order within a note.

    ``notes``: doc_id, path, title, status, frontmatter (JSON, or null), body. Notes in passing folders state none. A rule
    without a remediation gets a plain one; where the note supersedes others, the remediation says so.
    """
    parts = F.split(F.lower(F.translate("path", "\\", "/")), "/")
    live = notes.where((F.col("status") == "active") & ~F.arrays_overlap(parts, F.array(*map(F.lit, PASSING))))
    source = F.when(F.coalesce("path", F.lit("")) != "", F.col("path")).otherwise(F.col("title"))
    named = live.select("doc_id", source.alias("source"), F.coalesce("title", F.lit("")).alias("title"), listed(F.col("frontmatter"), "supersedes").alias("olds"))
    rows = rule_parts(live).join(named.drop("olds"), "doc_id")

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        names = [x.split()[0] for x in RULE.split(", ")]
        for pdf in batches:
            out = [[d, a, n, *(r[x] for x in names)] for d, a, k, t, title, s in zip(*(pdf[c] for c in ("doc_id", "at", "kind", "text", "title", "source")), strict=True) for n, r in enumerate(stated(k, t, title, s))]
            yield pd.DataFrame(out, columns=["doc_id", "at", "n", *names])

    ship_code(notes.sparkSession)
    rules = rows.select("doc_id", "at", "kind", "text", "title", "source").mapInPandas(run, f"doc_id long, at int, n int, {RULE}")
    default = F.when(F.col("kind") == "must_contain", F.format_string("Ensure changes include required pattern `%s`.", "pattern")).otherwise(F.format_string("Remove or replace forbidden pattern `%s`.", "pattern"))
    rules = rules.withColumn("remediation", F.when(F.col("remediation") == "", default).otherwise(F.col("remediation"))).join(named.select("doc_id", "olds"), "doc_id")
    add = (F.size("olds") > 0) & ~F.col("remediation").contains("Supersedes ")
    told = F.when(add, F.concat("remediation", F.lit(" (Supersedes "), F.array_join("olds", ", "), F.lit(")"))).otherwise(F.col("remediation"))
    return rules.withColumn("remediation", told).drop("olds")


def reference_slug(raw: Column) -> Column:
    """What a wiki link or path is about: the slug of its last part, without alias and ending; null if there is none."""
    clean = F.regexp_replace(F.regexp_replace(F.trim(raw), r"^\[\[|\]\]$", ""), r"\|.*$", "")
    slug = slugify(F.regexp_replace(F.trim(F.regexp_replace(F.trim(clean), r"\.md$", "")), "^.*/", ""))
    return F.when(slug != "untitled", slug)


def path_slug(path: Column) -> Column:
    return slugify(F.regexp_replace(F.regexp_replace(path, "^.*/", ""), r"(?<=.)\.[^.]*$", ""))


def successors(frontmatter: Column, body: Column) -> Column:
    """The notes that a note names as its successors: in its front matter, else in a callout in the first five lines."""
    callouts = F.filter(F.slice(F.split(body, "\n", -1), 1, 5), lambda x: F.upper(F.ltrim(x)).rlike(r"^> \[(SUPERSEDED\]|!?WARN\] SUPERSEDED)"))
    links = lambda x: F.regexp_extract_all(x, F.lit(r"\[\[.*?\]\]"), F.lit(0))
    words = lambda x: F.trim(F.regexp_extract(x, r"(?i)superseded[ _]by\s*:?(.*)", 1))
    told = F.filter(F.transform(callouts, lambda x: F.when(F.size(links(x)) > 0, links(x)).when(words(x) != "", F.array(words(x)))), lambda x: x.isNotNull())
    own = listed(frontmatter, "superseded_by")
    names = F.when(F.size(own) > 0, own).otherwise(F.coalesce(F.get(told, 0), F.array().cast("array<string>")))
    return F.flatten(F.transform(names, lambda x: F.split(x, ",")))


def retired(before: DataFrame, after: DataFrame) -> DataFrame:
    """path: notes of ``before`` whose rules a change may end. Both: path, status, frontmatter, body.

    That is so where the later state has an active note that says it supersedes this one, or where the note is there, no
    longer active, and names an active note as its successor.
    """
    live = after.where("status = 'active'")
    olds = live.select(F.col("path").alias("by"), F.explode(listed(F.col("frontmatter"), "supersedes")).alias("raw")).select("by", reference_slug(F.col("raw")).alias("slug"))
    was = before.select("path", path_slug(F.col("path")).alias("slug"))
    replaced = was.join(olds, "slug").where("path <> by").select("path")
    there = after.join(before.select("path"), "path", "left_semi")
    named = there.where("status <> 'active'").select("path", F.explode(successors(F.col("frontmatter"), F.col("body"))).alias("raw"))
    kept = named.select("path", reference_slug(F.col("raw")).alias("slug")).join(live.select(F.col("path").alias("by"), path_slug(F.col("path")).alias("slug")), "slug").where("path <> by").select("path")
    # an active note doesn't end its own rules by being superseded; what it dropped still holds
    still = live.select("path")
    return replaced.join(still, "path", "left_anti").union(kept).distinct()


def rules_of_change(before: DataFrame, after: DataFrame) -> DataFrame:
    """doc_id, at, n, RULE's columns and state (current or resurrected): the rules that a change is held to.

    Both: doc_id, path, title, status, frontmatter, body, keyed by path. All rules of the later state hold, and those that
    active notes stated before it, unless the change retires the note properly; so a change can't pass by dropping the
    rule that it breaks. A rule is the same one if id, kind and pattern are; of several the first stays, current before
    resurrected, then by path and place.
    """
    unchanged = F.col("b.path") == F.col("a.path")
    for c in ("status", "title", "frontmatter", "body"):
        unchanged = unchanged & F.col(f"b.{c}").eqNullSafe(F.col(f"a.{c}"))
    changed = before.alias("b").join(after.alias("a"), unchanged, "left_anti")
    old = note_rules(changed.join(retired(before, after), "path", "left_anti")).withColumn("state", F.lit("resurrected"))
    rows = note_rules(after).withColumn("state", F.lit("current")).unionByName(old)
    first = Window.partitionBy("id", "kind", "pattern").orderBy("state", "source_note", "at", "n")
    return rows.withColumn("_n", F.row_number().over(first)).where("_n = 1").drop("_n")
