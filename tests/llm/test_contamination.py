import random
import re

import duckdb
import pytest

from lumenkb.llm import contamination, queries
from lumenkb.llm.contamination import contaminated, near_matches
from tests.llm.conftest import ODD

ITEMS = "item_id long, text string, n_words string"
WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")


def words(text):
    return WORD.findall(re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))


def plainly(docs, items, size=10):
    """Every window at every place of every document."""
    windows = {}
    for item, text in items:
        w = words(text)
        n = min(size, len(w))
        if item is not None:
            for s in range(len(w) - n + 1 if n else 0):
                windows.setdefault((n, tuple(w[s : s + n])), set()).add(str(item))
    sizes = {n for n, _ in windows}
    out = []
    for doc, text in docs:
        w, hit, held = words(text), set(), set()
        for n in sizes:
            for s in range(len(w) - n + 1):
                if found := windows.get((n, tuple(w[s : s + n]))):
                    hit |= set(range(s, s + n))
                    held |= found
        out.append((doc, len(w), len(hit), len(held), sorted(held), bool(hit)))
    return sorted(out, key=repr)


def nearly(docs, items, size, span):
    """All stretches of ``span`` words against all windows."""
    out = []
    for doc, text in docs:
        w = words(text)
        for item, t in items:
            x = words(t)
            n = min(size, len(x))
            for s in range(len(x) - n + 1 if n and item is not None else 0):
                need = set(x[s : s + n])
                at = next((a for a in range(len(w)) if w[a] in need and need <= set(w[a : a + span])), None)
                if at is not None:
                    out.append((doc, item, s, at))
    return sorted(set(out), key=repr)


def sample(seed, n_docs=150):
    r = random.Random(seed)
    vocabulary = [f"v{int(r.paretovariate(0.7)) % 60}" for _ in range(500)]
    item = lambda n: " ".join(r.choices(vocabulary, k=n))
    items = [(i, item(r.choice([3, 9, 10, 11, 30]))) for i in range(25)]
    items += [(40, items[0][1]), (41, items[1][1]), (41, items[4][1] + " tail"), (None, "v1"), (42, None), (43, "..."), (44, "Solo"), (45, "é É 知识"), (46, "v1 " * 25)]
    texts = []
    for i in range(n_docs):
        parts = [item(r.choice([0, 3, 20])) for _ in range(4)]
        if i % 3:
            w = r.choice([t for _, t in items if t]).split()
            a = r.randrange(len(w))
            parts.insert(r.randrange(5), ", ".join(w[a : a + r.choice([5, 12, 40])]).title())
        texts.append((i % 140, " ".join(parts)))
    return texts + [(500, "x SOLO y"), (501, "É é é 知识"), (502, "v1 " * 300), (503, items[3][1] + "\n" + items[3][1])] + ODD, items


def frame(spark, items):
    return spark.createDataFrame([(*x, "x") for x in items], ITEMS)


@pytest.mark.parametrize("most", [500_000, 5])
@pytest.mark.parametrize("seeds", [1, 3])
def test_equals_all_windows_at_all_places(spark, docs, monkeypatch, most, seeds):
    monkeypatch.setattr(contamination, "MOST", most)
    texts, items = sample(7)
    rows = contaminated(docs(texts, extra=True), frame(spark, items), seeds=seeds)
    assert rows.columns == ["doc_id", "n_words", "n_hit", "n_items", "items", "contaminated"]
    assert sorted((tuple(x) for x in rows.collect()), key=repr) == plainly(texts, items)


@pytest.mark.parametrize("size", [1, 4])
def test_other_windows(spark, docs, size):
    texts, items = sample(8, 40)
    rows = contaminated(docs(texts), frame(spark, items), window=size)
    assert sorted((tuple(x) for x in rows.collect()), key=repr) == plainly(texts, items, size)


def test_proximity(spark, docs):
    texts, items = sample(9, 40)
    texts += [(600, "beta pad pad alpha pad gamma"), (601, "alpha beta pad pad pad pad pad pad pad gamma")]
    items += [(60, "alpha beta gamma beta")]
    for size, span in ((4, 6), (3, 3)):
        rows = near_matches(docs(texts, extra=True), frame(spark, items), size, span)
        assert sorted({tuple(x) for x in rows.collect()}, key=repr) == nearly(texts, items, size, span)


def test_one_very_long_text(spark, docs):
    passage = " ".join(f"w{i}" for i in range(30))
    texts = [(1, "the of " * 200_000 + passage + " the of" * 1000), (2, passage)]
    items = [(1, passage), (2, "of the of the of the of the of the of the")]
    rows = contaminated(docs(texts), frame(spark, items)).collect()
    assert sorted((x.doc_id, x.n_words, x.n_hit, x.n_items) for x in rows) == [(1, 402030, 402030, 2), (2, 30, 30, 1)]


def test_no_rows(spark, docs):
    items = frame(spark, [(1, "a b")])
    assert contaminated(docs([]), items).count() == 0
    assert [tuple(x) for x in contaminated(docs([(1, "a b")]), items.limit(0)).collect()] == [(1, 2, 0, 0, [], False)]


def test_no_python_on_executors(spark):
    from lumenkb.session import table

    sf = "/root/testdata/sf0.001"
    plan = contaminated(table(spark, sf, "documents"), table(spark, sf, "benchmark"))._jdf.queryExecution().toString()
    assert "Python" not in plan and "Arrow" not in plan


def test_query_equals_its_sql(spark):
    sf = "/root/testdata/sf0.001"
    con = duckdb.connect()
    for t in ("documents", "benchmark"):
        con.sql(f"CREATE VIEW {t} AS SELECT * FROM '{sf}/{t}.parquet'")
    rel = con.sql(queries.oracle_sql()["op12_positional_decontamination"])
    df = queries.op12_positional_decontamination(spark, sf)
    assert df.columns == rel.columns
    assert sorted((tuple(x) for x in df.collect()), key=repr) == sorted(rel.fetchall(), key=repr)
