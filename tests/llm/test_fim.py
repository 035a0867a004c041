import hashlib
import random

import duckdb
import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from lumenkb.llm import queries
from lumenkb.llm.bits import Bits
from lumenkb.llm.fim import cut, fill_in_middle, restored
from tests.llm.conftest import ODD



@pytest.mark.parametrize("n", [0, 1, 7, 8, 511, 512, 513, 5000])
@pytest.mark.parametrize("share", [0, 0.02, 0.5, 1])
def test_rank_and_select(n, share):
    bits = np.random.default_rng(n).random(n) < share
    b = Bits(bits)
    ones = np.flatnonzero(bits)
    assert b.ones == len(ones)
    assert b.rank(np.arange(n + 1)).tolist() == np.concatenate([[0], np.cumsum(bits)]).tolist()
    assert b.select(np.arange(len(ones) + 2)).tolist() == [*ones.tolist(), n, n]


def plainly(doc_id, text):
    """The transformation over code points."""
    text = text or ""
    h = hashlib.sha256(f"1:{'' if doc_id is None else doc_id}".encode()).hexdigest()
    h1, h2, h3, h4 = (int(h[i : i + 8], 16) for i in (0, 8, 16, 24))
    n = len(text)
    a, b = sorted((h1 % (n + 1), h2 % (n + 1)))
    if not text or any(x in text for x in ("<P>", "<S>", "<M>")) or h3 % 100 >= 90:
        return doc_id, n, "plain", None, None, text
    x, y, z = text[:a], text[a:b], text[b:]
    out = ("spm", f"<S>{z}<P>{x}<M>{y}") if h4 % 100 < 20 else ("psm", f"<P>{x}<S>{z}<M>{y}")
    return doc_id, n, out[0], a, b - a, out[1]


def test_equals_cuts_of_code_points(spark, docs):
    r = random.Random(3)
    alphabet = "ab é知\U0001f600\x00\n<PSM>"
    texts = [(i, "".join(r.choice(alphabet) for _ in range(r.choice([0, 1, 2, 30, 700])))) for i in range(300)]
    texts += [(1000, "x<P>y"), (1001, "<M"), (1002, "P>é<S"), (1003, "知" * 400_000), (-5, "minus")] + [(2000 + i, "<S" + "é" * i) for i in range(40)]
    rows = fill_in_middle(docs(texts + ODD, extra=True)).withColumn("back", restored(F.col("output"), F.col("form"))).collect()
    assert sorted((tuple(x)[:6] for x in rows), key=repr) == sorted((plainly(*x) for x in texts + ODD), key=repr)
    assert sorted(x.back for x in rows) == sorted(t or "" for _, t in texts + ODD)
    assert {x.form for x in rows} == {"plain", "psm", "spm"}


def test_no_rows(spark, docs):
    assert fill_in_middle(docs([])).count() == 0


def test_spans_of_a_batch(monkeypatch):
    from lumenkb.llm import fim

    monkeypatch.setattr(fim, "SPAN", 16)
    texts = ["", "é" * 20, "abc", "", "知识", "x" * 40, ""]
    whole = pa.array(["skipped", *texts])[1:]  # a slice of a longer buffer
    n, cuts, places = cut(whole, np.arange(7), np.arange(7) * 5)
    raw = whole.buffers()[2].to_pybytes()
    assert n.tolist() == [len(t) for t in texts]
    for t, (a, b), p in zip(texts, cuts.tolist(), places.tolist(), strict=True):
        assert [raw[p[i] : p[i + 1]].decode() for i in range(3)] == [t[:a], t[a:b], t[b:]]


def test_query_equals_its_sql(spark):
    sf = "/root/testdata/sf0.001"
    con = duckdb.connect()
    con.sql(f"CREATE VIEW documents AS SELECT * FROM '{sf}/documents.parquet'")
    rel = con.sql(queries.oracle_sql()["op13_rank_select_fim"])
    got = queries.op13_rank_select_fim(spark, sf)
    assert got.columns == rel.columns
    assert sorted((tuple(x) for x in got.collect()), key=repr) == sorted(rel.fetchall(), key=repr)
