"""Operators 3 and 5, and the pipeline."""

import zlib
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F
from tests.llm.conftest import ODD

from lumenkb.llm import queries
from lumenkb.llm.mixing import document_rates, mix
from lumenkb.llm.toxicity import character_model, clean, decode, logistic, score, words

SF = "/root/testdata/sf0.01"
LABELS = "doc_id long, quality int, toxic int"


@pytest.fixture(scope="module")
def model(spark):
    text = "the idiot and the stupid moron saw a clown in the street . a good morning to all the people in town . " * 30
    return character_model(spark.createDataFrame([(1, text)], "doc_id long, text string"))


@pytest.mark.parametrize("seen, meant", [("1d10t", "idiot"), ("m0r0n", "moron"), ("stuuuupid", "stupid"), ("cl0wn", "clown"), ("$tup1d", "stupid"), ("morning", "morning")])
def test_decode(model, seen, meant):
    assert decode(seen, model) == meant


def test_words_restores_spaced_letters(model):
    got = words("What an i d i o t, they said; m.o.r.o.n too! And 1d1ot.", model, {})
    assert {"idiot", "moron", "what", "said"} <= got


@pytest.mark.parametrize("seen, meant", [("1d10t", "idiot"), ("an 1d10t!", "idiot"), ("$tupid", "stupid"), ("(m0r0n)", "moron"), ("5tup1d,", "stupid"), ("cl0wn" + "n" * 60, "clown")])
def test_words_sends_leeted_tokens_to_the_lattice(model, seen, meant):
    assert meant in words(seen, model, {})


def test_words_segments_spaced_letters(model):
    assert "idiot" in words("t h e i d i o t", model, {})
    assert "saw" in words("s a w", model, {})
    assert "moron" in words("t h e s t u p i d " * 40 + "m o r o n", model, {})


def test_op3_on_held_out_labels(spark):
    got = queries.op3_deobfuscated_toxicity(spark, SF)
    labels = spark.read.parquet(f"{SF}/labels.parquet")
    rows = got.join(labels, "doc_id").collect()
    assert got.count() == spark.read.parquet(f"{SF}/documents.parquet").count()
    assert all(r["held_out"] == (zlib.crc32(str(r["doc_id"]).encode()) % 5 == 0) and 0 <= r["score"] <= 1 and r["predicted"] == (r["score"] >= 0.5) for r in rows)
    held = [r for r in rows if r["held_out"]]
    assert sum(r["predicted"] == r["toxic"] for r in held) >= 0.93 * len(held)


def test_held_out_labels_are_not_learned_from(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet").where("doc_id < 300")
    labels = spark.read.parquet(f"{SF}/labels.parquet")
    turned = labels.withColumn("toxic", F.when(F.crc32(F.col("doc_id").cast("string").cast("binary")) % 5 == 0, 1 - F.col("toxic")).otherwise(F.col("toxic")))
    one, two = ({r["doc_id"]: r["score"] for r in score(docs, x).collect()} for x in (labels, turned))
    assert one == two


def test_score_on_odd_rows(spark, docs):
    labels = spark.createDataFrame([(1, 1, 0), (4, None, None), (None, 1, 1), (5, 1, 1), (5, 1, 0)], LABELS)
    got = score(docs(ODD, extra=True), labels).collect()
    assert Counter(r["doc_id"] for r in got) == Counter(i for i, _ in ODD) and all(0 <= r["score"] <= 1 for r in got)
    none = spark.createDataFrame([], LABELS)
    assert {r["predicted"] for r in score(docs(ODD), none).collect()} == {0}
    assert score(docs([]), labels).count() == 0 and clean(docs([]), none).count() == 0
    assert clean(docs(ODD), none).count() == len(ODD)


def test_logistic_finds_the_boundary():
    x = np.array([[0.0, 0], [0.5, 1], [4, 5], [5, 5]] * 20)
    w = logistic(x, (x[:, 0] > 2).astype(float))
    p = 1 / (1 + np.exp(-(w[0] + x @ w[1:])))
    assert ((p >= 0.5) == (x[:, 0] > 2)).all()


DOMAIN = "CASE quality WHEN 1 THEN 'high' WHEN 0 THEN 'low' END"


def labelled(spark, n=400):
    """Two kinds of text, told by their shape; one in ten of a kind is labelled."""
    rows = [(i, "Some plain words of a text that goes on. " * (3 + i % 5) if i % 4 else "| a | b | c |! " * (8 + i % 5), "en", "hot" if i % 3 else "s1", 0) for i in range(n)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")
    return docs, spark.createDataFrame([(i, int(i % 4 > 0), 0) for i in range(0, n, 3)], LABELS)


def test_rates_reach_the_targets(spark):
    docs, labels = labelled(spark)
    rows = document_rates(docs, labels, F.expr(DOMAIN), {"high": 0.9, "low": 0.1}).collect()
    total = np.sum([np.array(r["p"]) * r["tokens"] * r["rate"] for r in rows], axis=0)
    assert len(rows) == 400 and all(0 <= r["rate"] <= 1 and abs(sum(r["p"]) - 1) < 1e-9 for r in rows)
    assert total[1] / total.sum() == pytest.approx(0.1, abs=0.01)
    assert min(r["rate"] for r in rows if r["doc_id"] % 4) > 0.95


def test_rates_equal_plain_projected_gradient(spark):
    docs, labels = labelled(spark)
    rows = document_rates(docs, labels, F.expr(DOMAIN), {"high": 1, "low": 1}, most=2.0, total_share=1.0).collect()
    p, t = np.array([r["p"] for r in rows]), np.array([float(r["tokens"]) for r in rows])
    held = p.T @ t
    want, rate, past, age, before, history = t.sum() * np.array([0.5, 0.5]), np.ones(len(rows)), np.ones(len(rows)), 0, np.inf, []
    for _ in range(400):
        history.append(p.T @ (rate * t))
        if abs(history[-1] - want).max() <= 1e-4 * want.sum() or len(history) > 8 and abs(history[-1] - history[-9]).max() <= 1e-4 * want.sum():
            break
        squares = ((history[-1] - want) ** 2 / held).sum()
        age = 0 if squares > before else age
        ahead = rate + age / (age + 3) * (rate - past)
        rate, past, age, before = np.clip(ahead - p @ ((p.T @ (ahead * t) - want) / held), 0, 2), rate, age + 1, squares
    assert np.allclose(rate, [r["rate"] for r in rows], atol=1e-9)


def test_op5_reaches_its_targets_and_tells_toxic_from_good(spark):
    rows = queries.op5_soft_mixing(spark, "/root/testdata/sf0.1").collect()
    total = {d: sum(r[f"p_{d}"] * r["tokens"] * r["rate"] for r in rows) for d in queries.MIXTURE}
    for d, share in queries.MIXTURE.items():
        assert total[d] / sum(total.values()) == pytest.approx(share, abs=0.005), total
    # learnt from four fifths of the labels, held against the rest
    docs, labels = (spark.read.parquet(f"/root/testdata/sf0.1/{t}.parquet") for t in ("documents", "labels"))
    held_out = F.crc32(F.col("doc_id").cast("string").cast("binary")) % 5 == 0
    got = document_rates(docs, labels.where(~held_out), F.expr(queries.DOMAIN), queries.MIXTURE).join(labels.where(held_out), "doc_id").collect()
    for place, bad in ((2, lambda r: r["toxic"]), (1, lambda r: r["quality"] == 0 and not r["toxic"])):
        yes, no = [r["p"][place] for r in got if bad(r)], [r["p"][place] for r in got if not bad(r)]
        auc = np.mean([(a > b) + (a == b) / 2 for a in yes for b in no])
        print("held-out AUC", place, len(yes), len(no), auc)
        assert auc > 0.8


def test_mix_repeats_and_drops_by_rate(spark):
    docs, labels = labelled(spark)
    got = mix(docs, labels, F.expr(DOMAIN), {"high": 0.5, "low": 0.5}, most=3.0, total_share=1.0)
    count = Counter(r["doc_id"] for r in got.collect())
    assert got.columns == docs.columns and max(count.values()) <= 3
    assert sum(c for i, c in count.items() if i % 4 == 0) > 1.3 * 100
    again = Counter(r["doc_id"] for r in mix(docs.repartition(5), labels, F.expr(DOMAIN), {"high": 0.5, "low": 0.5}, most=3.0, total_share=1.0).collect())
    assert again == count


def test_mixing_on_odd_rows(spark, docs):
    labels = spark.createDataFrame([(7, 1, 0), (None, 1, 0), (4, None, 0), (5, 0, 0), (5, 0, 0)], LABELS)
    rows = document_rates(docs(ODD, extra=True), labels, F.expr(DOMAIN), {"high": 0.5, "low": 0.5}).collect()
    assert Counter(r["doc_id"] for r in rows) == Counter(i for i, _ in ODD) and all(0 <= r["rate"] <= 1 for r in rows)
    none = spark.createDataFrame([], LABELS)
    assert {tuple(r["p"]) for r in document_rates(docs(ODD, source=None), none, F.expr(DOMAIN), {"a": 1, "b": 1}).collect()} == {(0.5, 0.5)}
    assert document_rates(docs([]), none, F.expr(DOMAIN), {"a": 1, "b": 1}).count() == 0
    assert mix(docs([]), none, F.expr(DOMAIN), {"a": 1, "b": 1}).count() == 0


def test_op5_has_no_python(spark):
    plan = queries.op5_soft_mixing(spark, "/root/testdata/sf0.001")._jdf.queryExecution().toString()
    assert "Python" not in plan and "Pandas" not in plan and "Arrow" not in plan


def test_pipeline_stages(spark):
    import corpus_pipeline as p

    sf = "/root/testdata/sf0.001"
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    toxic = {r["doc_id"] for r in score(docs, spark.read.parquet(f"{sf}/labels.parquet")).where("predicted = 1").collect()}
    kept = docs
    for name, stage in p.STAGES[:-1]:
        before, kept = kept, spark.createDataFrame(stage(spark, kept, sf).collect(), docs.schema)
        assert kept.columns == docs.columns and 0 < kept.count() <= before.count(), name
        ids = {r["doc_id"] for r in kept.collect()}
        assert not ids & toxic and len(ids) == kept.count()
    assert kept.where("n_chars <> length(text)").count() == 0
    packed = p.pack(spark, kept, sf)
    assert {r["doc_id"] for r in packed.collect()} == {r["doc_id"] for r in kept.collect()}
    assert Counter(map(tuple, p.run(spark, sf).drop("sequence_id", "offset").collect())) == Counter(map(tuple, packed.drop("sequence_id", "offset").collect()))


def test_pipeline_on_odd_rows(spark, docs, tmp_path):
    import corpus_pipeline as p

    labels = spark.createDataFrame([(7, 1, 0), (None, 1, 1)], LABELS)
    labels.write.parquet(f"{tmp_path}/labels.parquet")
    for rows in (ODD, []):
        docs(rows).write.mode("overwrite").parquet(f"{tmp_path}/documents.parquet")
        got = p.run(spark, f"file://{tmp_path}")
        assert (got.count() > 0) == bool(rows)
