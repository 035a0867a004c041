"""Cards for a task within a budget, and skills from traces."""

import math
import random
import re

import pytest
from pyspark.sql import functions as F

from lumenkb.operators import distil, loadout


def concept(spark, *bodies):
    df = spark.createDataFrame([(i, b) for i, b in enumerate(bodies)], "i int, body string")
    return [r[0] for r in df.select("i", loadout.card_concept(F.col("body")).alias("c")).orderBy("i").select("c").collect()]


def test_what_a_card_is_about(spark):
    long = "x" * 89 + " " + "y" * 40
    assert concept(
        spark,
        "# A\n> first\n## Core Concept\ntext before\n> [!note] mark\n> one\n> two\n\n> three\n# B",
        "## Summary\n# empty\n## 核心结论 2\nplain\nlines\n## C\nmore",
        "a\n> \n> [!x]\nb\n> late",
        "intro\n# H\n\npara one\npara two\n\nother",
        "# H1\n# H2\ntext\n# H3\nno",
        f"> {long}",
        "no heading, no quote",
        None,
        "",
    ) == ["one two", "plain lines", None, "para one para two", "text", "x" * 89 + "...", None, None, None]


def test_keywords_meet_cards_that_hold_them(spark):
    r = random.Random(3)
    word = lambda: "".join(r.choice("abé ") for _ in range(r.randrange(1, 9)))
    cards = [(i, word().upper(), f"c/{word()}.md", r.choice([None, word()])) for i in range(80)] + [(99, None, None, None)]
    queries = [(q, sorted({"".join(r.choice("abé") for _ in range(r.randrange(1, 4))) for _ in range(4)})) for q in range(12)]
    got = loadout.keyword_hits(spark.createDataFrame(cards, "doc_id long, name string, path string, concept string"), spark.createDataFrame(queries, "query_id long, keywords array<string>"))
    want = []
    for q, keys in queries:
        for i, n, p, c in cards:
            n, p, c = (x.lower() if x else "" for x in (n, p, c))
            s = sum((20 if n == k else 10 if k in n else 0) + (4 if k in p else 0) + (3 if k in c else 0) for k in keys if len(k.encode()) > 1)
            want += [(q, i, s)] if s else []
    assert sorted(map(tuple, got.select("query_id", "doc_id", "score").collect())) == sorted(want)


def estimate(text):
    dense = re.sub(r"\s", "", text, flags=re.A)
    cjk = len(re.findall("[一-鿿㐀-䶿豈-﫿]", dense))
    return math.ceil((len(dense) - cjk) / 4) + math.ceil(cjk * 2 / 3)


def test_no_text_is_over_budget_and_none_leaves_room(spark):
    r = random.Random(4)
    heads, cards = [], []
    for q in range(60):
        heads.append((q, "n" * r.choice([1, 5, 2000]), "> changes", r.choice(["", "scope " * 10, "范围" * 200, "s" * 900, None]), r.choice([None, [], ["- [[l]]"] * 3, ["- " + "l" * 1300] * 2])))
        cards += [(q, n, f"card{n}", r.choice([None, "c" * r.choice([10, 90, 400]), "prose " * 20 + " [Guard: keep this whole]"])) for n in range(1, r.choice([1, 2, 6]))]
    rows = loadout.loadout_texts(spark.createDataFrame(heads, "query_id long, name string, changes string, scope string, logs array<string>"), spark.createDataFrame(cards, "query_id long, rank long, name string, concept string")).collect()
    assert len(rows) == 60
    for x in rows:
        assert x.tokens == estimate(x.text) < 300
        shown = re.findall(r"\*\*\[\[card(\d)\]\]\*\*", x.text)
        assert shown == [str(n) for n in range(1, x.n_cards + 1)]
        if x.n_cards:
            assert x.tokens <= 281  # three dots may follow a scope that was cut for the first card
    assert {x.n_cards for x in rows} >= {0, 1, 4}
    assert any("[Guard: keep this whole]" in x.text for x in rows)
    assert all(len(c) <= 220 for x in rows for c in re.findall(r"\]\]\*\*: (c+\.*)", x.text))


def test_changes_line(spark):
    line = lambda m, n: spark.createDataFrame([(m, n)], "m array<string>, n int").select(loadout.changes_line(F.col("m"), F.col("n"))).first()[0]
    assert line(["a", "b" * 40, "c", "d"], 7) == "> **Active Changes**: 3 modified modules: `a`, `" + "b" * 27 + "...`, `c` (7 files)"
    assert line([], 2) == "> **Active Changes**: 1 modified modules: various files (2 files)"
    assert "Clean working tree" in line([], 0)
    assert len(line(["x" * 30] * 3, 1000)) == 100


def distilled(spark, *rows):
    df = spark.createDataFrame([(i, *(r if isinstance(r, tuple) else (r, None, None))) for i, r in enumerate(rows)], "id long, trace string, hint string, title string")
    return sorted(distil.skills(df).collect(), key=lambda x: x.id)


def test_a_trace_becomes_a_skill(spark):
    rust = "$ cargo build\n  Compiling x\nerror[E0382]: use of moved value\n  --> src/a.rs:3\nnote\n$ git diff\n> cargo test\ntest result: ok\n"
    python = "python run.py\nTraceback (most recent call last):\n  File \"a.py\", line 1\nKeyError: 'TOKEN'\nerror: later\nTraceback (most recent call last):\nno name"
    shell = "zsh: command not found: foo\nexit status 127\nbrew install foo"
    a, b, c, d, e, f = distilled(spark, rust, python, shell, ("nothing", " a hint ", None), ("", None, " T "), (None, "h" * 80, None))
    assert (a.title, a.summary) == ("Resolve error[E0382]: use of moved value", "error[E0382]: use of moved value")
    assert a.commands_before == ["cargo build"] and a.commands_after == ["git diff", "cargo test"]
    assert a.error_lines == ["error[E0382]: use of moved value", "  --> src/a.rs:3", "note", "$ git diff"]
    assert a.tags == ["type/skill", "topic/rust", "topic/go"] and len(a.prevention) == 2  # "cargo test" ends like "go test"
    # what a traceback names counts before what was told first; one without a name doesn't
    assert b.summary == "KeyError: 'TOKEN'" and b.commands_before == ["python run.py"] and b.commands_after == []
    assert b.tags == ["type/skill", "topic/python"] and len(b.prevention) == 2
    assert (c.title, c.commands_after) == ("Resolve command not found: foo", ["brew install foo"])
    assert (d.title, d.summary, d.error_lines) == ("a hint", " a hint ", [])
    assert (e.title, e.summary, e.commands_before) == ("T", distil.NOTHING, [])
    assert f.title == "Troubleshoot: " + "h" * 60


def test_error_texts_end(spark):
    many = "\n".join(["error: a"] + [f"line {i}" for i in range(40)] + ["error: b", "after", "error: c"])
    (x,) = distilled(spark, many)
    assert x.error_lines == ["error: a", *[f"line {i}" for i in range(24)], "error: b", "error: c"]
    assert x.summary == "error: a"


@pytest.mark.parametrize("n", [20_000])
def test_a_long_trace(spark, n):
    (x,) = distilled(spark, "\n".join(["$ git status", "text"] * n))
    assert len(x.commands_before) == n and x.commands_after == []
