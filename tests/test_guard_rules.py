"""Rules from notes and files, comments, and rules that a change drops."""

import json
import random

import pytest
from pyspark.sql import functions as F

from lumenkb.functions.code import without_comments
from lumenkb.operators import guard, rules


def character_by_character(line, path):
    """The code of a line, read one character after another."""
    name = path.rsplit("/", 1)[-1]
    ending = name.rsplit(".", 1)[1].lower() if "." in name[1:] else ""
    if ending in ("md", "txt", "rst"):
        return line
    by_hash = ending in ("py", "toml", "sh") or name in ("Makefile", "Dockerfile")
    out, quote, i = "", None, 0
    while i < len(line):
        c = line[i]
        if c == "\\":
            out, i = out + line[i : i + 2], i + 2
        elif quote:
            quote = None if c == quote else quote
            out, i = out + c, i + 1
        elif c in "\"'`":
            quote, out, i = c, out + c, i + 1
        elif line.startswith("/*", i):
            end = line.find("*/", i + 2)
            if end < 0:
                return out
            out, i = out + " ", end + 2
        elif (line.startswith("//", i) and not by_hash) or (c == "#" and by_hash and (i == 0 or line[i - 1].isspace())):
            return out
        else:
            out, i = out + c, i + 1
    return out


def test_comments_equal_a_walk_over_characters(spark):
    r = random.Random(2)
    lines = ["".join(r.choice("ab \"'`\\/*#/\\*") for _ in range(r.randrange(14))) for _ in range(6000)]
    lines += ["", 'x = "http://a" // b', "a/**/b", "/* a */# b", "\\# x", "f('#') # c", "x" * 50_000 + "\\a" * 20_000 + " // y", '"' + "\\'" * 20_000 + '" # z', "a /* " * 20_000 + "*/ b // c"]
    paths = ["a.rs", "x/b.PY", "Makefile", "d.md", ".env", "y/.py", "noending"]
    rows = [(p, x) for x in lines for p in (paths if len(x) < 40 else paths[:2])]
    df = spark.createDataFrame(rows, "path string, line string").select("path", "line", without_comments(F.col("line"), F.col("path")).alias("code"))
    for x in df.collect():
        assert x.code == character_by_character(x.line, x.path), (x.path, x.line)
    assert spark.sql("SELECT 'a.rs' AS path, CAST(NULL AS string) AS line").select(without_comments(F.col("line"), F.col("path"))).first()[0] is None


def test_forbidden_reads_code_only(spark):
    files = spark.createDataFrame([(1, "a.rs", 'run(); // eval()\neval();\n"// " eval()\n/* eval() */\n// SECRET_x'), (2, "b.md", "// eval()")], "id long, path string, content string")
    found = lambda **r: {(x.rule_id, x.id, x.line_no) for x in guard.forbidden(files, [{"id": "E", "kind": "forbidden", "severity": "deny", "pattern": "eval()"} | r]).collect()}
    assert found() == {("E", 1, 2), ("E", 1, 3), ("E", 2, 1)}
    assert found(include_comments=True) == {("E", 1, 1), ("E", 1, 2), ("E", 1, 3), ("E", 1, 4), ("E", 2, 1)}
    assert found(pattern="SECRET_x") == {("E", 1, 5)}  # a pattern about secrets is about comments too
    assert len(found(id="no-comments")) == 5


@pytest.mark.parametrize(
    "line, want",
    [
        ('- [ADR-1] (warning) [src/[ab]/*.rs] forbidden: "a, b | c", remediation: "Use x, not: y"', ("ADR-1", "forbidden", "a, b | c", "src/[ab]/*.rs", "warn", "Use x, not: y")),
        ("- [ADR-2] must_contain: `lease` | files: '*.rs, *.py' | severity: info", ("ADR-2", "must_contain", "lease", "*.rs, *.py", "warn", "")),
        ('* **[ADR-3]**: (notice): [*.go]: Forbid: x\\\\.y, fix: "go"', ("ADR-3", "forbidden", "x\\.y", "*.go", "warn", "go")),
        ("- [ADR-010] Forbid `legacy_lock()` in `src/**/*.rs` — Remediation: Use `lock()`.", ("ADR-010", "forbidden", "legacy_lock()", "src/**/*.rs", "deny", "Use `lock()`.")),
        ("- **ADR-011** Require `fenced()` in src/**/*.rs.; fix: now", ("ADR-011", "must_contain", "fenced()", "src/**/*.rs", "deny", "now")),
        ("- forbid eval", ("RULE-adr-7-%s", "forbidden", "eval", None, "deny", "")),
        ("- prose that says must: have it", None),
        ("- [ADR-9] nothing to see", None),
        ("- **bold without end forbidden: x", None),
        ("- []  forbidden: x", None),
        ("- just words", None),
    ],
)
def test_items(line, want):
    got = rules.item_rules(line, "adr/adr-7.md")
    if want is None:
        assert [(r["id"], r["pattern"]) for r in got] in ([], [("RULE-adr-7-" + got[0]["id"][-4:], "have it")] if got else [])
        return
    (r,) = got
    if "%s" in want[0]:
        number = 0
        for b in line[2:].encode():
            number = (number * 31 + b) & 0xFFFF
        want = (want[0] % f"{number:04x}", *want[1:])
    assert (r["id"], r["kind"], r["pattern"], r["file_pattern"], r["severity"], r["remediation"]) == want
    assert r["title"] == r["id"] and r["source_note"] == "adr/adr-7.md"


def test_one_item_of_two_rules():
    got = rules.item_rules("- [A] forbidden: x, must: y, title: T, scan_comments: yes", "n.md")
    assert [(r["kind"], r["pattern"], r["title"], r["include_comments"]) for r in got] == [("must_contain", "y", "T", True), ("forbidden", "x", "T", True)]


def test_objects():
    of = lambda **v: [(r["id"], r["kind"], r["pattern"], r["file_pattern"], r["severity"]) for r in rules.object_rules(v, "D-1", "n")]
    assert of(forbidden=["a", "b", 3], files=["*.rs", "*.py"]) == [("D-1-1", "forbidden", "a", "*.rs,*.py", "deny"), ("D-1-2", "forbidden", "b", "*.rs,*.py", "deny")]
    assert of(id="X", must_contain="m", pattern="*.go", level="WARN") == [("X", "must_contain", "m", "*.go", "warn")]
    assert of(condition="Require", pattern="p") == [("D-1", "must_contain", "p", None, "deny")]
    assert of(condition={"forbid": ["r"], "must_contain": ["s"]}, paths="z") == [("D-1", "must_contain", "s", "z", "deny"), ("D-1", "forbidden", "r", "z", "deny")]
    assert of(pattern="p") == [] and of(forbidden=None) == []


def test_configuration_files():
    toml = '[[rules]]\nid = "ADR-001"\ntitle = "No Raw SQL"\nfile_pattern = "*.rs"\nforbidden = "execute_raw"\n[[rules]]\nmust_contain = "x"\n'
    assert [(r["id"], r["kind"], r["title"]) for r in rules.config_rules("g/guard.toml", toml)] == [("ADR-001", "forbidden", "No Raw SQL"), ("CONF-2", "must_contain", "CONF-2")]
    assert [r["id"] for r in rules.config_rules("guard.yml", "- forbid: a\n- {id: K, forbid: b}")] == ["CONF-1", "K"]
    assert rules.config_rules("guard.yaml", "invariants:\n  - [no object]\n") == [] and rules.config_rules("a.txt", "x") == []


NOTE = "doc_id long, path string, title string, status string, frontmatter string, body string"


def notes(spark, rows):
    return spark.createDataFrame([(i, *r) for i, r in enumerate(rows)], NOTE)


def test_which_parts_of_a_note_state_rules(spark):
    body = "\n".join([
        "- [OUT-1] forbidden: a", "## Architectural Invariants", "- [IN-1] forbidden: b", "```", "- [FENCED] forbidden: c", "## no heading", "```", "### Deeper", "* [IN-2] forbidden: d",
        "```yml", "- id: Y-1", "  forbidden: e", "```", "```yaml", "not: [closed", "```", "# 核心工程铁律 2", "- [IN-3] forbidden: f", "## Below", "- [IN-4] forbidden: g", "# Other", "- [OUT-2] forbidden: h", "```yaml", "- forbidden: i",
    ])
    got = rules.note_rules(notes(spark, [("adr/x.md", "X", "active", None, body), ("logs/y.md", "Y", "active", None, body), ("adr/z.md", "Z", "superseded", None, body), ("a.md", None, "active", None, None), ("b.md", "", "active", "[1", "")]))
    assert [(r.doc_id, r.at, r.id) for r in got.orderBy("at").collect()] == [(0, 2, "IN-1"), (0, 8, "IN-2"), (0, 12, "Y-1"), (0, 17, "IN-3"), (0, 19, "IN-4")]


def test_front_matter_remediation_and_provenance(spark):
    front = json.dumps({"rules": [{"forbidden": "x"}, {"must_contain": "y", "fix": "do"}], "relations": {"supersedes": ["[[a]]", " b "]}})
    got = rules.note_rules(notes(spark, [("n.md", "N", "active", front, "")])).orderBy("n").collect()
    assert [(r.id, r.remediation) for r in got] == [("N-1", "Remove or replace forbidden pattern `x`. (Supersedes [[a]], b)"), ("N-2", "do (Supersedes [[a]], b)")]


RULED = json.dumps({"invariants": [{"id": "S1", "forbidden": "exec_without_lock"}]})


def held(spark, before, after):
    return {(r.id, r.state) for r in rules.rules_of_change(notes(spark, before), notes(spark, after)).collect()}


def test_a_change_cannot_end_the_rule_that_it_breaks(spark):
    adr = ("decisions/adr-001.md", "ADR 001", "active", RULED, "# ADR")
    by = lambda x: json.dumps({"invariants": [{"id": "S1", "forbidden": "exec_without_lock"}], "superseded_by": x})
    gone = ("decisions/adr-001.md", "ADR 001", "superseded", by("[[adr-002]]"), "# ADR")
    next_ = ("decisions/adr-002.md", "ADR 002", "active", None, "# ADR 002")
    # retired in the same change, and the named successor isn't there; then it is; then it isn't active
    assert held(spark, [adr], [gone]) == {("S1", "resurrected")}
    assert held(spark, [adr, next_], [gone, next_]) == set()
    assert held(spark, [adr, next_], [gone, (*next_[:2], "deprecated", *next_[3:])]) == {("S1", "resurrected")}
    # a callout names it as well
    told = ("decisions/adr-001.md", "ADR 001", "superseded", RULED, "> [SUPERSEDED] see [[adr-002|new]]")
    assert held(spark, [adr, next_], [told, next_]) == set()
    # the note stays active and loses its rule, even if another one says it supersedes it
    weak = ("decisions/adr-001.md", "ADR 001", "active", None, "# ADR")
    over = ("decisions/adr-003.md", "ADR 003", "active", json.dumps({"supersedes": ["decisions/ADR 001.md"]}), "")
    assert held(spark, [adr], [weak]) == {("S1", "resurrected")}
    assert held(spark, [adr], [weak, over]) == {("S1", "resurrected")}
    # the note is deleted, with and without a note that supersedes it
    assert held(spark, [adr], []) == {("S1", "resurrected")}
    assert held(spark, [adr], [over]) == set()
    # nothing changes; a note that was no longer active brings nothing back
    assert held(spark, [adr], [adr]) == {("S1", "current")}
    assert held(spark, [gone], []) == set()


def test_rules_of_a_table_audit_files(spark):
    table = rules.note_rules(notes(spark, [("adr/n.md", "N", "active", RULED, "")]))
    (block,) = guard.rule_list(table)
    files = spark.createDataFrame([(1, "src/a.rs", "exec_without_lock(); // exec_without_lock"), (2, "vault/adr/n.md", "exec_without_lock")], "id long, path string, content string")
    assert [(r.rule_id, r.id, r.line_no) for r in guard.forbidden(files, block).collect()] == [("S1", 1, 1)]
