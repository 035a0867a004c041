import math
import random
import re
from collections import Counter

import duckdb
import pytest

from lumenkb.llm import queries
from lumenkb.llm.wand import lexical_top_k
from tests.llm.conftest import ODD

ITEMS = "item_id long, text string, score string"
TERM = re.compile(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+")


def terms(text):
    return TERM.findall(re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))


def plainly(docs, items, k=10):
    """Every document scored for every item."""
    cut = [(i, Counter(terms(t)), len(terms(t))) for i, t in docs]
    cut = [x for x in cut if x[2]]
    n, total = len(cut), sum(x[2] for x in cut)
    df = Counter(t for _, c, _ in cut for t in c)
    asked = {}
    for item, text in items:
        asked.setdefault(item, []).extend(terms(text))
    out = []
    for item, words in asked.items():
        found = []
        for doc, c, size in cut:
            m = 100 - 75 + (75 * size * n) // total
            score = sum(math.floor(1000 * math.log((2.0 * n + 2) / (2 * df[t] + 1))) * ((10**9 * c[t]) // (1000 * c[t] + 8 * m)) for t in words if c[t])
            if score > 0:
                found.append((-score, doc is None, doc or 0))
        out += [(item, r, None if none else doc, -score) for r, (score, none, doc) in enumerate(sorted(found)[:k], 1)]
    return sorted(out, key=repr)


def got(df):
    return sorted((tuple(x) for x in df.collect()), key=repr)


@pytest.mark.parametrize("shard", [(1 << 15, 1 << 20), (7, 1 << 20), (1000, 40)])
@pytest.mark.parametrize("most_terms", [400_000, 60])
def test_equals_scores_of_all_pairs(spark, docs, shard, most_terms):
    r = random.Random(5)
    vocabulary = [f"w{int(r.paretovariate(0.6)) % 400}" for _ in range(4000)]
    texts = [(r.randrange(-9, 200), " ".join(r.choices(vocabulary, k=r.choice([1, 5, 40, 300])))) for _ in range(250)]
    texts += [(900 + i, "Copies, of one; text: w1 w2") for i in range(40)] + [(None, "W1 w3 Éa éa")] + ODD
    items = [(i, " ".join(r.choices(vocabulary, k=r.choice([1, 8, 50])))) for i in range(20)]
    items += [(50, None), (51, ""), (52, "nowhere to be found"), (53, "w1 W1 w1 w2-w2"), (53, "again copies"), (None, "éa text"), (54, "知识 z one")]
    rows = lexical_top_k(docs(texts, extra=True), spark.createDataFrame([(*x, "x") for x in items], ITEMS), 10, most_terms, *shard)
    assert rows.columns == ["item_id", "rank", "doc_id", "score"]
    assert got(rows) == plainly(texts, items)


def test_one_very_long_text(spark, docs):
    texts = [(1, "a b " * 300_000 + "rare"), (2, "rare a"), (3, "b")]
    items = [(1, "rare a b"), (2, "a " * 5000)]
    assert got(lexical_top_k(docs(texts), spark.createDataFrame([(*x, "x") for x in items], ITEMS))) == plainly(texts, items)


def test_no_rows(spark, docs):
    items = spark.createDataFrame([(1, "a", "x")], ITEMS)
    assert lexical_top_k(docs([]), items).count() == 0
    assert lexical_top_k(docs([(1, "a")]), items.limit(0)).count() == 0
    assert lexical_top_k(docs([(1, None), (2, "...")]), items).count() == 0


def test_query_equals_its_sql(spark):
    sf = "/root/testdata/sf0.001"
    con = duckdb.connect()
    for t in ("documents", "benchmark"):
        con.sql(f"CREATE VIEW {t} AS SELECT * FROM '{sf}/{t}.parquet'")
    rel = con.sql(queries.oracle_sql()["op11_wand_search"])
    df = queries.op11_wand_search(spark, sf)
    assert df.columns == rel.columns
    assert got(df) == sorted(rel.fetchall(), key=repr)
