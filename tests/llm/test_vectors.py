"""Operators 4 and 6."""

import math
import random

import duckdb
import numpy as np
import pandas as pd
from pyspark.sql import functions as F

from lumenkb.llm import queries
from lumenkb.llm.ann import _search_cells, encode_block, nearest
from lumenkb.llm.topk import exact_top_k

SF = "/root/testdata/sf0.001"
ODD = [(0, [0.5, 0.25]), (0, [0.5, -0.25]), (1, [0.5, 0.25]), (2, [0.5, 0.25]), (3, None), (4, []), (5, [1.0, None]), (6, [float("nan"), 1.0]), (7, [float("inf"), 1.0]), (8, [0.0, 0.0]), (9, [1.0]), (None, [1.0, 1.0]), (10, [-0.999, 3.0])]


def table(spark, rows):
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>")
    return df.withColumn("rank", F.lit(1)).withColumn("score", F.lit("x")).withColumn("block", F.lit(0)).withColumn("v", F.lit(0))


def plain(rows, is_query, k, value, measure, skip_zero=False):
    good = [(i, [value(x) for x in v]) for i, v in rows if i is not None and v and all(x is not None and math.isfinite(x) for x in v) and not (skip_zero and not any(v))]
    out = {}
    for n, (i, q) in enumerate(good):
        if is_query(i):
            best = sorted(((-measure(q, v), j) for j, v in good if j != i and len(v) == len(q)))[:k]
            out.setdefault(i, []).append([(j, -s) for s, j in best])
    return out


def test_top_k_on_odd_rows(spark):
    got = exact_top_k(table(spark, ODD).where("vec_id is null or vec_id <> 0 or embedding[1] > 0"), F.col("vec_id") % 2 == 0, k=3).collect()
    rows = [(i, v) for i, v in ODD if not (i == 0 and v[1] < 0)]
    want = plain(rows, lambda i: i % 2 == 0, 3, lambda x: math.floor(256 * float(np.float32(x))), lambda a, b: sum(x * y for x, y in zip(a, b, strict=True)))
    for q, lists in want.items():
        assert [(r["vec_id"], r["score"]) for r in sorted(got, key=lambda r: r["rank"]) if r["query_id"] == q] == lists[0]
    assert exact_top_k(table(spark, []), F.col("vec_id") == 0).count() == 0


def test_top_k_over_many_blocks(spark):
    r = random.Random(2)
    rows = [(i, [r.choice([0.0, 0.5, -0.25, r.uniform(-1, 1)]) for _ in range(6)]) for i in range(300)]
    got = exact_top_k(table(spark, rows), F.col("vec_id") % 50 == 0, block_rows=32, query_rows=2, chunk=1).collect()
    want = plain(rows, lambda i: i % 50 == 0, 5, lambda x: math.floor(256 * float(np.float32(x))), lambda a, b: sum(x * y for x, y in zip(a, b, strict=True)))
    for q, lists in want.items():
        assert [(r["vec_id"], r["score"]) for r in sorted(got, key=lambda r: r["rank"]) if r["query_id"] == q] == lists[0]


def test_op4_equals_sql(spark):
    con = duckdb.connect()
    con.sql(f"create view embeddings as select * from '{SF}/embeddings.parquet'")
    want = set(con.sql(queries.TOPK_SQL).fetchall())
    got = {(r["query_id"], r["rank"], r["vec_id"], r["score"]) for r in queries.op4_exact_topk(spark, SF).collect()}
    assert got == want


def test_nearest_on_odd_rows(spark):
    got = nearest(table(spark, ODD).where("vec_id is null or vec_id <> 0 or embedding[1] > 0"), F.col("vec_id") % 2 == 0, k=3).collect()
    rows = [(i, v) for i, v in ODD if not (i == 0 and v[1] < 0)]
    want = plain(rows, lambda i: i % 2 == 0, 3, lambda x: float(np.float32(x)), lambda a, b: sum(x * y for x, y in zip(a, b, strict=True)), skip_zero=True)
    for q, lists in want.items():
        assert [r["vec_id"] for r in sorted(got, key=lambda r: r["rank"]) if r["query_id"] == q] == [j for j, _ in lists[0]]
    assert not [r for r in got if r["query_id"] == 8]
    assert nearest(table(spark, []), F.col("vec_id") == 0).count() == 0


def test_op6_recall_and_scores(spark):
    rows = [(r["vec_id"], r["embedding"]) for r in spark.read.parquet(f"{SF}/embeddings.parquet").collect()]
    got = queries.op6_one_bit_ann(spark, SF).collect()
    ids, m = np.array([i for i, _ in rows]), np.array([v for _, v in rows], float)
    hits = total = 0
    for q in ids[ids % 20 == 0]:
        s = (m * m[ids == q][0]).sum(axis=1)
        best = [x for x in ids[np.lexsort((ids, -s))] if x != q][:20]
        mine = sorted((r for r in got if r["query_id"] == q), key=lambda r: r["rank"])
        assert [r["rank"] for r in mine] == list(range(1, 21)) and all(abs(r["score"] - s[ids == r["vec_id"]][0]) < 1e-12 for r in mine)
        assert [r["vec_id"] for r in mine] == [r["vec_id"] for r in sorted(mine, key=lambda r: (-r["score"], r["vec_id"]))]
        hits, total = hits + len(set(best) & {r["vec_id"] for r in mine}), total + 20
    assert hits / total >= 0.9


def test_rows_scored_exactly_are_kept():
    r, ids = np.random.default_rng(3), np.arange(21)
    for _ in range(100):
        m = r.standard_normal((21, 16))
        cell = {f"c_{k}": v for k, v in encode_block(ids, m, 128, 29).items()} | {"q_ids": ids.tobytes(), "q_vectors": m.tobytes()}
        got = next(_search_cells(20, 128, 29, 1.9, 64)(iter([pd.DataFrame([cell])])))
        assert got.groupby("query_id").size().tolist() == [20] * 21
