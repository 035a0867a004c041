"""Markdown parsing, locators and streams."""

import json

import pytest
from pyspark.sql import functions as F

from lumenkb.functions import locators as L
from lumenkb.sources import markdown as M
from lumenkb.streaming import access


def brief(title, body, offset=0):
    return [(s["level"], s["heading"], s["breadcrumb"], s["start_line"], s["end_line"]) for s in M.sections(title, body, offset)]


def test_sections_need_text():
    assert M.sections("x", "") == [] and M.sections("x", "  \n\t\r\n ", 4) == []


def test_no_heading_is_one_section():
    body = "Overview.\n#tag-not-heading\n####### seven hashes\n    ## four-space code\n"
    assert brief("Gateway", body) == [(0, "", "Gateway", 1, 4)]


def test_preamble_and_blank_lead():
    assert brief("Spec", "Intro 1\nIntro 2\n\n## Design\nBody\n") == [(0, "", "Spec", 1, 2), (2, "Design", "Spec > Design", 4, 5)]
    assert brief("Spec", "\n\n## Design\nBody\n") == [(2, "Design", "Spec > Design", 3, 4)]


def test_code_does_not_split():
    body = "## Setup\n```bash\n# comment\n## no heading\n```\n~~~markdown\n### nor here\n~~~\n\n    ## indented\n#not-a-tag\n   ## Three spaces\ndone\n"
    assert [(s[1], s[3], s[4]) for s in brief("G", body)] == [("Setup", 1, 11), ("Three spaces", 12, 13)]
    assert [s[1] for s in brief("F", "## Before\n```rust\n## Inside\n### Still\n")] == ["Before"]


def test_underlined_headings():
    body = "Primary Title\nLine Two\n===\n\nFirst Line  \nSecond Line\n---\nafter\n\npara text\n---\nmore\n"
    got = brief("Primary Title Line Two", body)
    assert [(s[0], s[1], s[3]) for s in got] == [(1, "Primary Title Line Two", 1), (2, "First Line Second Line", 5), (2, "para text", 10)]
    assert got[0][2] == "Primary Title Line Two" and got[1][2] == "Primary Title Line Two > First Line Second Line"


def test_quotes_and_lists_do_not_split():
    body = "> ## Quoted\n> body\n\n- ## Bullet\n  body\n\n1. ### Ordered\n   body\n\n## Real\nbody\n"
    assert [(s[0], s[1], s[3], s[4]) for s in brief("C", body)] == [(0, "", 1, 8), (2, "Real", 10, 11)]


def test_deep_headings_stay_and_breadcrumbs_pop():
    body = "## A\nintro\n#### deep\nx\n### B\ny\n## C\nz\n"
    assert [s[2] for s in brief("G", body)] == ["G > A", "G > A > B", "G > C"]


def test_sections_cover_the_bytes():
    body = "é\n## 知识\nbody\r\n# [[a|b]] **x**\n"
    s = M.sections("t", body, 3)
    assert "".join(x["text"] for x in s) == body and s[-1]["byte_end"] == len(body.encode()) and s[2]["heading"] == "b x" and s[0]["start_line"] == 4


def test_parse_note():
    text = "---\ntitle: My note\ntags: [a, 'b c']\nindex: false\nrelations:\n  superseded_by: \"[[New]]\"\nlist:\n  - 1\n  - two\n---\nSee [[Other#part|it]] and [x](../y.md) and [w](https://a.b) #tag\n`[[no]]` #2024\n```\n[[no]]\n```\n"
    n = M.parse("dir/n.md", text.encode())
    meta = json.loads(n["frontmatter"])
    assert meta == {"title": "My note", "tags": ["a", "b c"], "index": False, "relations": {"superseded_by": "[[New]]"}, "list": [1, "two"]}
    assert n["title"] == "My note" and n["body_line_offset"] == 10 and n["tags"] == ["a", "b c", "tag"]
    assert [(x["target"], x["alias"]) for x in n["links"]] == [("Other#part", "it"), ("../y.md", "x")]


def test_scan_and_read(spark, tmp_path):
    for p, t in {"a.md": "# A\n[[b]]", "sub/b.MD": "b", ".hidden/c.md": "c", "trash/d.md": "d", "e.txt": "e", "f.excalidraw.md": "f"}.items():
        (tmp_path / p).parent.mkdir(exist_ok=True)
        (tmp_path / p).write_text(t)
    got = {r["path"]: r for r in M.read_notes(M.scan(spark, f"file://{tmp_path}")).collect()}
    assert set(got) == {"a.md", "sub/b.MD"} and got["a.md"]["title"] == "A" and got["a.md"]["links"][0]["target"] == "b"


@pytest.mark.parametrize(
    "text, want",
    [
        ("a/b.md", ("a/b.md", None, None, None, None)), ("[a.md:3-9#Part one]", ("a.md", 3, 9, "Part one", None)), ("a.md:4", ("a.md", 4, 4, None, None)),
        ("a.md:0-2", ("a.md", 0, 2, None, "lines count from 1")), ("a.md:5-2", ("a.md", 5, 2, None, "lines run backwards")), ("a.md:x", ("a.md", None, None, None, "malformed lines")), ("plain", ("", None, None, None, "no note")),
    ],
)
def test_parse_locator(spark, text, want):
    r = spark.createDataFrame([(text,)], "t string").select(L.parse_locator(F.col("t")).alias("x")).first()["x"]
    assert tuple(r) == want


def test_snippet_and_slice(spark):
    body = "start " * 60 + "needle here " + "end " * 60
    r = spark.createDataFrame([(body, ["need", "needle"])], "b string, t array<string>")
    got = r.select(L.snippet(F.col("b"), F.col("t")).alias("x")).first()["x"]
    assert "needle" in got and got.startswith("...") and got.endswith("...") and len(got) <= 206
    r = spark.createDataFrame([("a\nb\nc",)], "b string")
    assert r.select(L.line_slice(F.col("b"), F.lit(2), F.lit(9)).alias("x")).first()["x"] == "b\nc"


def test_stream_counts_equal_the_batch(spark, tmp_path):
    rows = [("a", t) for t in (0, 30, 60, 61, 130)] + [("b", 5)]
    for i, part in enumerate((rows[:3], rows[3:])):
        spark.createDataFrame(part, "k string, ts long").coalesce(1).write.parquet(f"{tmp_path}/in/{i}")
    events = spark.readStream.schema("k string, ts long").option("maxFilesPerTrigger", 1).parquet(f"file://{tmp_path}/in/*")
    q = access.access_counts(events, "k").writeStream.outputMode("update").format("memory").queryName("counts").option("checkpointLocation", f"{tmp_path}/cp").trigger(availableNow=True).start()
    q.awaitTermination(120)
    last = {}
    for r in spark.table("counts").collect():
        last[r["k"]] = max(last.get(r["k"], (0, 0)), (r["access_count"], r["last_access"]))
    assert last == {"a": (3, 130), "b": (1, 5)}


def test_snapshots_follow_batches(spark, tmp_path):
    write = access.snapshot_writer(f"{tmp_path}/snap")
    for n, rows in enumerate(([("a", "1", 1), ("b", "1", 1)], [("a", "2", 2), ("c", "1", 1)])):
        write(spark.createDataFrame(rows, "path string, content_hash string, mtime long"), n)
    write(spark.createDataFrame([("a", "2", 2), ("c", "1", 1)], "path string, content_hash string, mtime long"), 1)
    got = {tuple(r) for r in spark.read.parquet(f"{tmp_path}/snap/1").collect()}
    assert got == {("a", "2", 2), ("c", "1", 1)}
