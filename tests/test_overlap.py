"""Near-duplicate word sets against all pairs."""

import numpy as np
import pytest

from lumenkb.operators import graph, overlap


def texts(seed, n, vocabulary=400, common=6):
    """Texts of 1 to 80 words with frequent words, of which a third are changed copies of others."""
    r = np.random.default_rng(seed)
    out = []
    for i in range(n):
        if i % 3 == 2:
            words = [w for w in out[r.integers(0, i)].split() if r.random() > 0.15] + [f"w{x}" for x in r.integers(0, vocabulary, r.integers(0, 5))]
        else:
            words = [f"c{x}" for x in range(common)] + [f"w{int(x)}" for x in vocabulary * r.random(r.integers(1, 80)) ** 2]
        out.append(" ".join(words))
    return out


def all_pairs(rows, least=0.6):
    named: dict = {}
    for doc_id, text in rows:
        if (words := frozenset((text or "").split())) and doc_id is not None:
            named[words] = min(named.get(words, doc_id), doc_id)
    sets = list(named.items())
    return sorted((min(x, y), max(x, y), round(len(a & b) / len(a | b), 6)) for i, (a, x) in enumerate(sets) for b, y in sets[:i] if x != y and len(a & b) / len(a | b) >= least)


def found(spark, rows):
    return sorted(tuple(r) for r in graph.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string")).collect())


@pytest.mark.parametrize("limits, most", [((32768, 10_000_000, 16), 2_000_000), ((40, 3000, 4), 50), ((7, 100, 16), 1)])
def test_pairs_are_all_pairs(spark, monkeypatch, limits, most):
    rows = list(enumerate(texts(3, 400))) + [(900, None), (901, ""), (902, "w1"), (903, "c0 c1 c2 c3")]
    near = overlap.near_sets
    monkeypatch.setattr(graph, "near_sets", lambda sets, least: near(sets, least, dict(zip(("sets", "words", "blocks"), limits, strict=True)), most, small=10))
    want = all_pairs(rows)
    assert len(want) > 50
    assert found(spark, rows) == want


def test_a_doc_id_that_names_two_sets(spark):
    rows = [(1, "a b c d e"), (1, "a b c d f"), (2, "a b c d e f"), (3, "x y z u v"), (None, "x y z u w")]
    assert found(spark, rows) == all_pairs(rows) == [(1, 2, 0.833333), (1, 2, 0.833333)]


def test_sets_that_share_a_rare_word_are_not_listed(spark, monkeypatch):
    """All of 600 sets share two rare words, 179,700 pairs; what is written for a check stays near the result."""
    r = np.random.default_rng(5)
    rows = [(i, " ".join(["rare1", "rare2", *[f"w{x}" for x in r.choice(3000, 60, replace=False)]])) for i in range(600)] + [(i + 1000, " ".join(f"w{x}" for x in range(3000))) for i in range(1)]
    rows.append((700, rows[0][1] + " more"))
    written, write = {}, overlap.materialize

    def counted(df, tag):
        out = write(df, tag)
        written[tag] = out.count()
        return out

    monkeypatch.setattr(overlap, "materialize", counted)
    assert found(spark, rows) == all_pairs(rows) == [(0, 700, round(62 / 63, 6))]
    assert written["likely"] < 20_000


def test_no_sets(spark):
    assert found(spark, [(1, None), (2, "")]) == []
