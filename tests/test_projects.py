"""The project of a query."""

import random

from pyspark.sql import functions as F

from lumenkb.operators import projects as P

PROJECT = "project long, path string, title string, slug string, aliases array<string>, tags array<string>"


def one(spark, f, x):
    return spark.createDataFrame([(x,)], "x string").select(f(F.col("x"))).first()[0]


def test_identifiers(spark):
    assert one(spark, P.normalized, "  Rust_Memory--Core/v2.x: (new)!") == "rust memory core v2 x new"
    assert one(spark, P.derived_aliases, "2024-05-01-rust-memory-phase-2-audit.md") == ["rust-memory-phase-2-audit", "rust-memory", "rust-memory-phase-2"]
    assert one(spark, P.derived_aliases, "plain") == ["plain"] and one(spark, P.derived_aliases, "2024-05-01-") == []


def found(spark, projects, queries, text=(), vectors=(), backlinks=()):
    known = P.harvested(spark.createDataFrame(projects, PROJECT), spark.createDataFrame(list(backlinks), "project long, stem string"))
    rows = P.find_projects(
        spark.createDataFrame(list(enumerate(queries)), "query_id long, query string"), known,
        spark.createDataFrame(list(text), "query_id long, project long, rank int"), spark.createDataFrame(list(vectors), "query_id long, project long, rank int, distance double"),
    )
    got = {r.query_id: (r.project, r.tier) for r in rows.collect()}
    return [got.get(i) for i in range(len(queries))]


KNOWN = [
    (1, "projects/rust-memory.md", "Rust Memory Core", None, ["rmc"], ["rust", "project"]),
    (2, "projects/payment-beta.md", "Payments", "pay-b", None, ["topic billing", None]),
    (3, "projects/zeta.md", None, None, [], None),
]


def test_tiers(spark):
    queries = ["RMC", "rust_memory", "pay-b", "memory rust", "paym", "billing topic", "beta payments", "project", "zt", "new-name", "nothing like it", "by vector", "far vector", "", None, "the zeta project"]
    got = found(spark, KNOWN, queries, text=[(10, 2, 2), (10, 3, 1), (0, 3, 1), (13, 1, 1)], vectors=[(10, 1, 1, 0.1), (11, 2, 1, 0.3), (12, 1, 1, 0.36)], backlinks=[(3, "2024-01-02-new-name-review"), (3, "x")])
    assert got == [
        (1, "exact"), (1, "exact"), (2, "exact"), (1, "match"), (2, "match"), (2, "match"), (2, "match"), None, (3, "subsequence"), (3, "match"), (3, "text"), (2, "vector"), None, None, None, None,
    ]


def plainly(projects, query):
    """The first two tiers by meeting each with each."""
    import re

    norm = lambda s: re.sub(" +", " ", re.sub(r"[^\w ]|_", "", re.sub(r"[-_/:.\s]+", " ", s.lower()))).strip()
    q, ql = norm(query), query.strip().lower()
    names = {i: [p.rsplit("/", 1)[-1].removesuffix(".md"), *([t] if t else []), *([s] if s else []), *(a or [])] for i, p, t, s, a, _ in projects}
    for i, _, t, _, _, _ in sorted(projects, key=lambda x: x[1]):
        if ql in [x.lower() for x in names[i]] or q in (norm(names[i][0]), norm(t or "")):
            return i, "exact"
    for i, _, _, _, _, tags in sorted(projects, key=lambda x: x[1]):
        w = q.split()
        tags = [x for x in tags or [] if x and x.lower() not in P.GENERIC]
        for n in names[i]:
            c, cw = norm(n), norm(n).split()
            if c == q or n.lower().startswith(ql) or c.startswith(q) or (len(c.encode()) >= 3 and q.startswith(c)) or ql in n.lower() or q in c or (cw and set(w) <= set(cw)) or (len(cw) >= 2 and set(cw) <= set(w)):
                return i, "match"
        every = [norm(x) for x in names[i] + tags]
        if any(norm(x) == q or norm(x).startswith(q) or (norm(x) and set(w) <= set(norm(x).split())) for x in tags) or (any(every) and all(any(x in n for n in every) for x in w)):
            return i, "match"
    return None


def test_keys_lose_no_match(spark):
    r = random.Random(6)
    part = lambda: r.choice(["rust", "mem", "memory", "api", "pay", "beta", "x1", "é", "core"])
    name = lambda: r.choice("-_ ").join(part() for _ in range(r.randrange(1, 4)))
    known = [(i, f"p/{name()}-{i}.md", r.choice([None, name()]), r.choice([None, name()]), r.choice([None, [name()]]), r.choice([None, [name(), "project"]])) for i in range(12)]
    queries = [name()[: r.randrange(1, 14)].strip(" -_") or "q" for _ in range(120)]
    for got, query in zip(found(spark, known, queries), queries, strict=True):
        want = plainly(known, query)
        assert got == want or (want is None and got[1] == "subsequence"), query


def test_equal_queries_are_tried_once(spark, monkeypatch):
    tried = spark.sparkContext.accumulator(0)
    matches = P.matches

    def counted(q, *more):
        def seen(x):
            tried.add(1)
            return True

        return F.udf(seen, "boolean")(q) & matches(q, *more)

    monkeypatch.setattr(P, "matches", counted)
    assert found(spark, KNOWN, ["paym", "PAYM", "nothing", " paym "] * 200, text=[(2, 3, 1)]) == ([(2, "match")] * 2 + [(3, "text"), (2, "match")] + ([(2, "match")] * 2 + [None, (2, "match")]) * 199)
    assert tried.value < 100


def test_queries_of_several_words_do_not_try_each_project(spark, monkeypatch):
    tried = spark.sparkContext.accumulator(0)
    matches = P.matches

    def counted(q, *more):
        def seen(x, path):  # of a project, so that it is asked after the join
            tried.add(1)
            return True

        return F.when(F.udf(seen, "boolean")(q, F.col("path")), matches(q, *more))

    monkeypatch.setattr(P, "matches", counted)
    # all names share the first letters of the longest word of each query
    known = [(i, f"p/{i:02}.md", f"thening{i} of thenable{i % 7}", None, None, None) for i in range(40)]
    queries = [f"thening{i} able{j}" for i in range(40) for j in range(2)] + [f"thening{i} of able{i % 7}" for i in range(40)]
    got = found(spark, known, queries)
    for query, one in zip(queries, got, strict=True):
        assert one == plainly(known, query), query
    assert tried.value < 200


def test_names_within_queries_and_letters(spark):
    known = [(1, "p/b.md", "beta beta", None, ["x y"], ["q"]), (2, "p/a.md", "北京", None, None, None), (3, "p/aB-cD.md", None, None, None, None), (4, "a/zz.md", "y x y", None, None, None)]
    queries = ["beta gamma", "y then x", "北京市 map", "acd", "zz z", "-", "bd", "dc", "x", "y q", "q x"]
    want = [(1, "match"), (4, "match"), (2, "match"), (3, "subsequence"), (4, "match"), (3, "exact"), (3, "subsequence"), None, (4, "match"), (1, "match"), (1, "match")]
    got = found(spark, known, queries)
    for query, one, other in zip(queries, got, want, strict=True):
        assert one == other, query
