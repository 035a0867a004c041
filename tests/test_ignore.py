"""Scan filters."""

import pytest
from pyspark.sql import functions as F

from lumenkb.sources.ignore import ignored, kept_files, parse_ignore, scan_kept


def kept(spark, text, *paths):
    df = spark.createDataFrame([(p,) for p in paths], "path string")
    return {r.path for r in kept_files(df, parse_ignore(text)).collect()}


def test_patterns_and_negation(spark):
    paths = ["drafts/wip.md", "a/drafts/x/y.md", "drafts.md", "sub/scratch.tmp.md", "notes/drop.md", "notes/keep.md", "root_only.md", "nested/root_only.md", "sub/Diagram.Excalidraw.MD", "x/notes/drop.md"]
    text = "drafts/\n*.tmp.md\nnotes/*.md\n!notes/keep.md\n/root_only.md\n\n# comment\n"
    assert kept(spark, text, *paths) == {"drafts.md", "notes/keep.md", "nested/root_only.md", "x/notes/drop.md"}


@pytest.mark.parametrize(
    "pattern, yes, no",
    [
        ("**/b.md", ["b.md", "x/y/b.md"], ["x/ab.md"]),
        ("a/**", ["a/b.md", "a/x/y.md"], ["ba/x.md", "a.md"]),
        ("a/**/z.md", ["a/z.md", "a/b/c/z.md"], ["z.md", "b/a/z.md"]),
        ("?[0-9]*.md", ["a1.md", "x/b2c.md"], ["1.md", "ab.md"]),
        ("[!a]x.md", ["bx.md"], ["ax.md"]),
        ("\\#a.md", ["#a.md"], ["a.md"]),
        ("\\!a.md", ["!a.md"], ["a.md"]),
        ("a.b.md  ", ["a.b.md"], ["axb.md"]),
        ("x+(y).md", ["x+(y).md"], ["xxy.md"]),
        ("dir", ["dir/a.md", "x/dir/y/a.md"], ["dirs/a.md"]),
    ],
)
def test_pattern_forms(spark, pattern, yes, no):
    rules = parse_ignore(pattern)
    df = spark.createDataFrame([(p,) for p in yes + no], "path string").select("path", ignored(F.col("path"), rules).alias("out"))
    assert {r.path for r in df.collect() if r.out} == set(yes)


def test_later_patterns_and_own_matches_win(spark):
    paths = ["a/x.md", "a/y.md", "b/x.md"]
    assert kept(spark, "*.md\n!x.md\nb/x.md", *paths) == {"a/x.md"}
    assert kept(spark, "!x.md\n*.md", *paths) == set()
    # a kept file counts before its ignored folder
    assert kept(spark, "a/\n!a/x.md", *paths) == {"a/x.md", "b/x.md"}


def test_canonical_siblings(spark):
    rules = parse_ignore('# tool:canonical-sibling = primary.md, "index.md"\n#canonical-sibling = overview.md\n# other = no.md\n')
    assert rules.siblings == ["primary.md", "index.md", "overview.md"] and not rules.patterns
    paths = ["bundle/primary.md", "bundle/variant_a.md", "bundle/data.txt", "bundle/nested/child.md", "plain/note.md", "note.md"]
    text = "# canonical-sibling = primary.md\n"
    assert kept(spark, text, *paths) == set(paths) - {"bundle/variant_a.md"}
    # one that is ignored stands for nobody
    assert kept(spark, text + "primary.md", *paths) == set(paths) - {"bundle/primary.md"}
    assert kept(spark, text, "primary.md", "note.md", "a/b.md") == {"primary.md", "a/b.md"}


def test_scan_of_a_tree(spark, tmp_path):
    for p in ("a.md", "drafts/b.md", "c/primary.md", "c/d.md"):
        (tmp_path / p).parent.mkdir(exist_ok=True)
        (tmp_path / p).write_text("# x")
    assert {r.path for r in scan_kept(spark, f"file://{tmp_path}").collect()} == {"a.md", "drafts/b.md", "c/primary.md", "c/d.md"}
    (tmp_path / ".notesignore").write_text("drafts/\n# canonical-sibling = primary.md\n")
    assert {r.path for r in scan_kept(spark, f"file://{tmp_path}").collect()} == {"a.md", "c/primary.md"}
