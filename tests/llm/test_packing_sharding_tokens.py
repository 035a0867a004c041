"""Operators 1, 8 and 10."""

import random
import zlib
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F
from tests.llm.conftest import ODD

from lumenkb.llm.bpe import default_path, encoder, packed, specials
from lumenkb.llm.packing import pack, sum_of_squares
from lumenkb.llm.sharding import interleave
from lumenkb.llm.tokencount import TokenTree, count_tokens

SF = "/root/testdata/sf0.001"


def test_encoder_equals_the_tokenizer_file():
    from tokenizers import Tokenizer

    tok = Tokenizer.from_file(default_path())
    encode, r = encoder(default_path()), random.Random(1)
    texts = ["", " a", "a  b", "x \n\t y", "it's", "<|endoftext|>"]
    texts += ["".join(r.choice(["<|endoftext|>", "<|", "|>", " ", "\n", "a", "..", "endoftext"]) for _ in range(12)) for _ in range(300)]
    texts += ["".join(r.choice("ab 's\n\t1.é知") for _ in range(30)) for _ in range(300)]
    assert all(encode(t) == tok.encode(t, add_special_tokens=False).ids for t in texts)


def test_token_tree_equals_encoding_again():
    r, encode = random.Random(7), encoder(default_path())
    for _ in range(600):
        x = "".join(r.choice("ab 's\n\tr1.elé") for _ in range(r.randint(0, 60)))
        tree = TokenTree(x, encode, r.choice([1, 2, 4]))
        for _ in range(4):
            at, cut, new = r.randint(0, len(x)), r.choice([0, 1, 3, 20]), "".join(r.choice("ab 's\nr") for _ in range(r.choice([0, 1, 5])))
            tree.edit(at, cut, new)
            x = x[:at] + new + x[at + cut :]
            assert tree.total == len(encode(x)) and tree.chars[1] == len(x)


def test_token_tree_makes_and_breaks_special_tokens():
    r, encode, special = random.Random(11), encoder(default_path()), specials(default_path())
    parts = ["<|endoftext|>", "<|endoftext", "<|", "|>", "endoftext", ">", " ", ".", "a"]
    for _ in range(2000):
        x = "".join(r.choices(parts, k=r.randint(0, 12)))
        tree = TokenTree(x, encode, r.choice([1, 2, 4]), special)
        for _ in range(4):
            at, cut, new = r.randint(0, len(x)), r.choice([0, 1, 3, 20]), "".join(r.choices(parts, k=r.randint(0, 2)))
            tree.edit(at, cut, new)
            x = x[:at] + new + x[at + cut :]
            assert tree.total == len(encode(x)) and tree.chars[1] == len(x)


def test_count_tokens_on_odd_rows(docs):
    edits = F.array(F.struct(F.lit(-3).alias("at"), F.lit(10**6).alias("cut"), F.lit("new text").alias("new")), F.struct(F.lit(None).cast("long").alias("at"), F.lit(0).alias("cut"), F.lit(None).cast("string").alias("new")))
    rows = count_tokens(docs(ODD, extra=True).withColumn("edits", edits)).collect()
    assert len(rows) == len(ODD)
    assert {r["n_tokens_after"] for r in rows} == {2}
    encode = encoder(default_path())
    want = Counter((i, len(encode(t or ""))) for i, t in ODD)
    assert Counter((r["doc_id"], r["n_tokens"]) for r in rows) == want
    assert count_tokens(docs([]).withColumn("edits", edits)).count() == 0


def test_op1_equals_encoding_everything_again(spark):
    from lumenkb.llm.queries import op1_edit_aware_tokens

    texts = {r["doc_id"]: r["text"] for r in spark.read.parquet(f"{SF}/documents.parquet").collect()}
    encode = encoder(default_path())
    for r in op1_edit_aware_tokens(spark, SF).collect():
        x = texts[r["doc_id"]]
        n = len(x)
        assert r["n_tokens"] == len(encode(x))
        for at, cut, new in ((n // 4, 8, "[edited]"), (n // 2, 0, " some new words "), (3 * n // 4, 12, "")):
            x = x[:at] + new + x[at + cut :]
        assert r["n_tokens_after"] == len(encode(x)) and r["n_chars_after"] == len(x)


def test_sum_of_squares_takes_the_best_gap():
    r = random.Random(4)
    for _ in range(30):
        budget = r.choice([7, 12])
        items = [r.randint(1, budget) for _ in range(60)]
        bins, offsets = sum_of_squares(np.array(items), budget)
        level: list[int] = []
        square = lambda l: sum(c * c for g, c in Counter(budget - x for x in l).items() if g)
        for s, b, o in zip(items, bins.tolist(), offsets.tolist(), strict=True):
            places = [level[:i] + [x + s] + level[i + 1 :] for i, x in enumerate(level) if x + s <= budget] + [[*level, s]]
            if b == len(level):
                level.append(0)
            assert level[b] == o
            level[b] += s
            assert level[b] <= budget and square(level) == min(map(square, places))


def packed_well(rows, texts, budget):
    encode = encoder(default_path())
    by_doc, by_sequence = {}, {}
    for r in rows:
        by_doc.setdefault(r["doc_id"], []).append(r)
        by_sequence.setdefault(r["sequence_id"], []).append(r)
    for s in by_sequence.values():
        at = 0
        for r in sorted(s, key=lambda r: r["offset"]):
            assert r["offset"] == at
            at += r["length"]
        assert at <= budget
    for i, t in texts.items():
        ids, at = encode(t or "") + [2], 0
        for k, r in enumerate(sorted(by_doc[i], key=lambda r: r["piece"])):
            assert (r["piece"], r["start"]) == (k, at)
            assert r["ids_crc32"] == zlib.crc32(packed(ids[at : at + r["length"]]))
            assert len(ids) <= budget or r["length"] == budget or k == 0
            at += r["length"]
        assert at == len(ids) and (len(ids) > budget or len(by_doc[i]) == 1)
    return len(by_sequence)


def test_op8_packs_every_token_once(spark):
    from lumenkb.llm.queries import op8_sum_of_squares_packing

    texts = {r["doc_id"]: r["text"] for r in spark.read.parquet(f"{SF}/documents.parquet").collect()}
    rows = op8_sum_of_squares_packing(spark, SF).collect()
    used = packed_well(rows, texts, 1024)
    assert used <= 1.05 * sum(r["length"] for r in rows) / 1024 + 1


def test_pack_on_odd_rows(docs):
    rows = pack(docs(ODD, extra=True), budget=8).collect()
    assert sum(r["piece"] == 0 for r in rows) == len(ODD)
    packed_well(rows, {}, 8)
    encode = encoder(default_path())
    assert sum(r["length"] for r in rows) == sum(len(encode(t or "")) + 1 for _, t in ODD)
    assert pack(docs([])).count() == 0


@pytest.mark.parametrize("n", [1, 8, 1003])
def test_shards_hold_each_source_in_proportion(spark, docs, n):
    rows = [(i, f"t{i % 50}", "en", "hot" if i % 3 else f"s{i % 5}", 0) for i in range(n)]
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")
    got = interleave(df, buckets=16).collect()
    assert sorted(r["doc_id"] for r in got) == list(range(n))
    count = Counter(r["shard"] for r in got)
    assert set(count) <= set(range(8)) and max(count.values()) - min(count.get(s, 0) for s in range(8)) <= 1
    for s in range(8):
        assert sorted(r["slot"] for r in got if r["shard"] == s) == list(range(count.get(s, 0)))
    for source, total in Counter(r[3] for r in rows).items():
        per = Counter(r["shard"] for r in got if r["source"] == source)
        assert all(abs(per.get(s, 0) - total / 8) <= 7 for s in range(8))  # a row for each of the six sources, and one
    again = interleave(df.repartition(7), buckets=16).collect()
    assert {(r["doc_id"], r["shard"], r["slot"]) for r in got} == {(r["doc_id"], r["shard"], r["slot"]) for r in again}


def test_shards_on_odd_rows(docs):
    got = interleave(docs(ODD, extra=True)).collect()
    assert Counter((r["doc_id"], r["size"], r["text_crc32"]) for r in got) == Counter((i, len((t or "").encode()) + 1, zlib.crc32((t or "").encode())) for i, t in ODD)
    assert {r["law"] for r in got} == {"rows"} and {r["grown_shard"] for r in got} == {None}
    assert interleave(docs([])).count() == 0
    assert interleave(docs(ODD, source=None)).count() == len(ODD)
