"""Near pairs of vectors and nearest sections, against all pairs."""

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from lumenkb.operators import vectors as V


def frame(spark, rows):
    return spark.createDataFrame([(i, None if v is None else [None if x is None else float(x) for x in v]) for i, v in rows], "id long, v array<double>")


def clusters(seed, n, dim=24, groups=12, noise=0.25):
    r = np.random.default_rng(seed)
    centres = r.normal(size=(groups, dim))
    m = centres[r.integers(0, groups, n)] / np.sqrt(dim) + noise * r.normal(size=(n, dim)) / np.sqrt(dim)
    return m * r.uniform(0.2, 5, (n, 1))


def all_pairs(m, threshold):
    u = m / np.linalg.norm(m, axis=1)[:, None]
    a, b = np.nonzero(np.triu(u @ u.T, 1) > threshold)
    return set(zip(a.tolist(), b.tolist(), strict=True))


@pytest.mark.parametrize("pivots, cap, noise", [(256, 2048, 0.25), (5, 40, 0.4), (1, 30, 0.3), (64, 25, 3.0)])
def test_near_pairs_are_all_pairs_above_the_threshold(spark, pivots, cap, noise):
    m = clusters(4, 500, noise=noise)
    m[100:140] = m[60:100] + 0.3 * np.abs(m[60:100]).mean() * np.random.default_rng(1).normal(size=(40, 24))
    want = all_pairs(m, 0.88)
    assert want
    rows = V.near_pairs(V.unit_vectors(frame(spark, list(enumerate(m)))), 0.88, pivots, cap).collect()
    assert len(rows) == len({(r.a, r.b) for r in rows})
    assert {(r.a, r.b) for r in rows} == want


def test_clusters_are_not_all_compared():
    u = clusters(5, 3000, dim=32, groups=30, noise=0.15)
    u /= np.linalg.norm(u, axis=1)[:, None]
    p = V.spread_pivots(u, 256, np.arccos(0.88))
    dots = u @ p.T
    home = dots.argmax(axis=1)
    least = np.array([dots[home == c, c].min() if (home == c).any() else 1 for c in range(len(p))])
    visits = V._reach(dots, home, np.sqrt(np.maximum(2 - 2 * p @ p.T, 0)), least, 0.88)
    compared = sum((n := int((home == c).sum())) * (n - 1) // 2 + n * int(visits[:, c].sum()) for c in range(len(p)))
    assert compared < 0.1 * 3000 * 2999 / 2


def test_vectors_without_clusters_are_sent_a_few_times_in_small_portions(spark, monkeypatch):
    """Far apart from each other, they reach all cells: a row for each cell of each vector took the executors' memory."""
    m = np.random.default_rng(9).normal(size=(3000, 64))
    m[1] = m[0]
    sent, portions, frame_of = [], [], pd.DataFrame
    monkeypatch.setattr(V, "SEND", 500)
    monkeypatch.setattr(V, "ship_code", lambda spark: None)

    class Groups:
        """Stands for the rows that are dealt to tasks, which it makes here."""

        def __init__(self, rows):
            self.rows = rows

        def mapInPandas(self, f, schema):
            if "side" not in schema:
                return self.rows.mapInPandas(f, schema)
            for out in f(iter([self.rows.toPandas()])):
                portions.append(len(out)), sent.append(out)
            return spark.createDataFrame([], schema)

        def __getattr__(self, name):
            return getattr(self.rows, name)

    write = V.materialize
    monkeypatch.setattr(V, "materialize", lambda df, tag: Groups(write(df, tag)))
    V.near_pairs(V.unit_vectors(frame(spark, list(enumerate(m)))), cap=500)
    rows = frame_of({"id": np.concatenate([x["id"].to_numpy() for x in sent])})
    assert max(portions) < 600
    assert 2 * 3000 < len(rows) < 16 * 3000  # 6 bundles or a few more; about 128 cells of 256 each before


def test_odd_vectors(spark):
    rows = [(1, [1, 0]), (2, [2, 0]), (3, None), (4, []), (5, [0, 0]), (6, [None, 1]), (7, [float("nan"), 1]), (8, [float("inf"), 1]), (9, [1, 0, 0]), (10, [1, 1e-9, 0]), (None, [1, 0])]
    got = {(r.a, r.b) for r in V.near_pairs(V.unit_vectors(frame(spark, rows))).collect()}
    assert got == {(1, 2), (9, 10)}
    assert V.near_pairs(V.unit_vectors(frame(spark, rows[2:3]))).count() == 0


def test_copies_and_superseded_pairs(spark):
    a, b, c = [1, 0, 0], [1, 0.1, 0], [0, 0, 1]
    v = frame(spark, [(1, a), (2, a), (3, a), (4, b), (5, b), (6, c), (7, c), (8, [0, 0.1, 1])])
    known = lambda *p: spark.createDataFrame(p or [(0, 0)], "a long, b long")
    found = lambda k: {(r.a, r.b, r.kind) for r in V.cosine_duplicates(v, k).collect()}
    every = {(1, 2, "copy"), (1, 3, "copy"), (4, 5, "copy"), (6, 7, "copy"), (1, 4, "cosine"), (6, 8, "cosine")}
    assert found(known()) == every
    # all that links 7 and all between the classes of 6 and 8 is superseded; 1 and 2 each have another link
    assert found(known((7, 6), (6, 8), (8, 7), (8, 7), (1, 2), (1, 4))) == every - {(6, 7, "copy"), (6, 8, "cosine")}
    assert found(known((1, 2), (2, 3), (4, 5))) == every - {(1, 2, "copy"), (4, 5, "copy")}


def test_many_copies_make_no_pairs_of_all(spark):
    v = frame(spark, [(i, [1, 2, 3]) for i in range(3000)] + [(5000, [1, 2, 3.1])])
    rows = V.cosine_duplicates(v, spark.createDataFrame([], "a long, b long")).groupBy("kind").count().collect()
    assert {(r[0], r[1]) for r in rows} == {("copy", 2999), ("cosine", 1)}


def test_sections_roll_up_to_notes(spark):
    r = np.random.default_rng(6)
    m, q = r.normal(size=(400, 8)), r.normal(size=(5, 8))
    sections = spark.createDataFrame([(i, i // 7, m[i].tolist()) for i in range(400)], "section_id long, doc_id long, v array<double>")
    queries = spark.createDataFrame([(i, q[i].tolist()) for i in range(5)], "query_id long, v array<double>")
    for pool, most in ((4, 4096), (10, 12)):
        got = V.section_search(sections, queries, pool, most).orderBy("query_id", "rank").collect()
        want = []
        for i in range(5):
            far = 1 - m @ q[i] / (np.linalg.norm(m, axis=1) * np.linalg.norm(q[i]))
            seen = {}
            for place, s in enumerate(np.lexsort((np.arange(400), far))[: min(5 * pool, most)].tolist(), 1):
                seen.setdefault(s // 7, (s, place))
            want += [(i, doc, n, s, place) for n, (doc, (s, place)) in enumerate(list(seen.items())[:pool], 1)]
        assert [(x.query_id, x.doc_id, x["rank"], x.section_id, x.section_rank) for x in got] == want


def test_only_changed_sections_are_embedded(spark):
    schema = "doc_id long, ord int, text_hash string, text string"
    was = spark.createDataFrame([(1, 0, "a", "a"), (1, 1, "b", "b"), (2, 0, "c", "c")], schema)
    none = spark.createDataFrame([], "doc_id long, ord int, text_hash string, v array<double>")
    embed = F.array(F.length("text").cast("double"), F.rand(1) * 0)
    stats = lambda df: {r.metric: r.value for r in df.collect()}
    store, first = V.embed_pending(was, none, embed)
    assert stats(first) == {"embedded": 3, "reused": 0, "deleted": 0, "pending": 0}
    now = spark.createDataFrame([(1, 0, "a", "a"), (1, 1, "B", "bb"), (1, 2, "d", "d"), (3, 0, "e", "e")], schema)
    after, second = V.embed_pending(now, store, embed, most=2)
    assert stats(second) == {"embedded": 2, "reused": 1, "deleted": 1, "pending": 1}
    assert {(r.doc_id, r.ord): r.v[0] for r in after.collect()} == {(1, 0): 1.0, (1, 1): 2.0, (1, 2): 1.0}
    last, third = V.embed_pending(now, after, embed)
    assert stats(third) == {"embedded": 1, "reused": 3, "deleted": 0, "pending": 0}
    assert V.pending_sections(now, last).count() == 0
