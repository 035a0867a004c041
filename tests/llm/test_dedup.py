"""Operators 2, 7 and 9 against brute force."""

import hashlib
import random
from collections import Counter
from pathlib import Path

import numpy as np
import pytest
from tests.llm.conftest import ODD

from lumenkb.llm import lines, queries
from lumenkb.llm.components import components
from lumenkb.llm.gsaca import suffix_array
from lumenkb.llm.jaccard import jaccard_classes, one_of_each
from lumenkb.llm.lines import RADIUS, block_codes, close, dedup_lines, distance, normalised, simhashes, unit_hashes
from lumenkb.llm.pairs import Forest, listed
from lumenkb.llm.shingles import shingle_set
from lumenkb.llm.suffix import dedup_substrings
from lumenkb.session import shared_dir

SF = "/root/testdata/sf0.001"


def corpus(n=60, seed=3, words=90, edits=3):
    """Texts with exact copies, near copies and a passage that several share."""
    r = random.Random(seed)
    word = lambda: "".join(r.choice("abcdefgh") for _ in range(r.randint(2, 8)))
    base = [" ".join(word() for _ in range(words)) for _ in range(6)]
    passage = " ".join(word() for _ in range(90))
    out = []
    for i in range(n):
        w = base[i % 6].split()
        for _ in range(r.choice([0, 0, edits])):
            w[r.randrange(len(w))] = word()
        text = " ".join(w) if i % 3 else " ".join(word() for _ in range(words))
        cut = r.randrange(len(text))
        out.append((i, text[:cut] + " " + passage + "\n" + text[cut:] if i % 7 == 0 else text))
    return out


def same_classes(got, docs, similarity=0.8):
    sets = [set(shingle_set(t).tolist()) for _, t in docs]
    f, links = Forest(len(docs)), [0] * len(docs)
    for i in range(len(docs)):
        for j in range(i):
            if sets[i] and sets[j] and len(sets[i] & sets[j]) >= similarity * len(sets[i] | sets[j]) - 1e-9:
                f.join(i, j)
                links[i] += 1
                links[j] += 1
    low = {}
    for i, (d, _) in enumerate(docs):
        if d is not None:
            low[f.root(i)] = min(d, low.get(f.root(i), d))
    want = Counter((d, low.get(f.root(i)), links[i]) for i, (d, _) in enumerate(docs))
    assert Counter((r["doc_id"], r["class_id"], r["n_links"]) for r in got) == want


def test_op2_equals_all_pairs(spark):
    docs = [(r["doc_id"], r["text"]) for r in spark.read.parquet(f"{SF}/documents.parquet").collect()]
    same_classes(queries.op2_chosen_path_jaccard(spark, SF).collect(), docs)


@pytest.mark.parametrize("leaf, cap", [(256, 512), (2, 3)])
def test_jaccard_splits_large_buckets_without_loss(docs, leaf, cap):
    rows = corpus()
    same_classes(jaccard_classes(docs(rows), leaf=leaf, cap=cap, part_rows=20).collect(), rows)


def test_jaccard_on_odd_rows(docs):
    got = jaccard_classes(docs(ODD, extra=True)).collect()
    same_classes(got, ODD)
    kept = one_of_each(docs(ODD, extra=True)).collect()
    assert Counter(r["doc_id"] for r in kept) == Counter([1, 2, 3, 4, 5, None, 6, 7, 9])
    assert next(r for r in kept if r["doc_id"] is None)["text"] is None
    assert jaccard_classes(docs([])).count() == 0 and one_of_each(docs([])).count() == 0


def plain_lines(docs, min_words=5, similarity=0.8):
    """All pairs of lines by edit similarity alone."""
    places = {}
    for d, text in sorted(docs, key=lambda x: (x[0] is None, x[0] or 0)):
        for i, x in enumerate(normalised(text or "")):
            if x:
                places.setdefault(x, []).append((d, i))
    lines = list(places)
    f, texts = Forest(len(lines)), [x.decode() for x in lines]
    for i in range(len(lines)):
        for j in range(i):
            if min(lines[i].count(b" "), lines[j].count(b" ")) + 1 >= min_words and close(texts[i], texts[j], similarity):
                f.join(i, j)
    groups = {}
    for i, x in enumerate(lines):
        groups.setdefault(f.root(i), []).extend(places[x])
    gone = {p for g in groups.values() for p in sorted(g)[1:]}
    return {d: "\n".join(x for i, x in enumerate(t.split("\n")) if (d, i) not in gone) for d, t in docs}, f, lines


def line_corpus(n=40):
    r = random.Random(5)
    word = lambda: "".join(r.choice("abcdefghij") for _ in range(r.randint(3, 9)))
    base = [[word() for _ in range(r.randint(4, 40))] for _ in range(12)]
    out = []
    for i in range(n):
        lines = []
        for _ in range(6):
            w = list(r.choice(base))
            if r.random() < 0.4:
                w[r.randrange(len(w))] = word()
            lines.append(" ".join(w) + r.choice(["", ".", " !"]))
        out.append((i, "\n".join(lines)))
    return out


@pytest.mark.parametrize("cap", [4096, 3])
def test_lines_equal_all_pairs(docs, cap):
    rows = line_corpus()
    got = {r["doc_id"]: r["kept_text"] for r in dedup_lines(docs(rows), cap=cap, part_rows=50).collect()}
    assert got == plain_lines(rows)[0]


def test_op7_finds_nine_tenths_of_what_all_pairs_by_edit_similarity_give(spark):
    docs = [(r["doc_id"], r["text"]) for r in spark.read.parquet(f"{SF}/documents.parquet").collect()]
    want, groups, lines = plain_lines(docs)
    got = {r["doc_id"]: r for r in queries.op7_fuzzy_line_dedup(spark, SF).collect()}
    same = sum(got[d]["kept_md5"] == hashlib.md5(t.encode()).hexdigest() for d, t in want.items())
    surplus = sum(t.count("\n") for _, t in docs) - sum(t.count("\n") for t in want.values())
    removed = sum(r["n_removed"] for r in got.values())
    assert same >= 0.97 * len(docs) and 0.99 * surplus <= removed <= surplus + len(docs), (same, removed, surplus)
    # of the pairs themselves, by blocks alone
    pairs = [(i, j) for i in range(len(lines)) for j in range(i) if groups.root(i) == groups.root(j) and close(lines[i].decode(), lines[j].decode(), 0.8)]
    _, whose, code = block_codes(lines)
    blocks = [set() for _ in lines]
    for w, c in zip(whose.tolist(), code.tolist(), strict=True):
        blocks[w].add(c)
    assert len(pairs) > 20 and sum(bool(blocks[i] & blocks[j]) for i, j in pairs) >= 0.9 * len(pairs)


def changed(r, kind, words):
    word = lambda: "".join(r.choice("abcdefghijklmnopqrst") for _ in range(r.randint(2, 9)))
    if kind == "ends":
        return [word() for _ in range(3)] + words + [word() for _ in range(3)]
    if kind == "outer":
        return [word() for _ in range(20)] + words[20:-20] + [word() for _ in range(20)]
    words = list(words)
    for _ in range(max(1, len(words) // 7)):
        if kind == "replaced":
            words[r.randrange(len(words))] = word()
        else:
            words.insert(r.randrange(len(words) + 1), word())
    return words


@pytest.mark.parametrize("kind, sizes", [("ends", [30, 60, 300]), ("outer", [1000]), ("replaced", [6, 8, 10, 13, 20, 35]), ("inserted", [8, 10, 13, 20, 35])])
def test_lines_meet_whatever_has_changed(kind, sizes):
    r = random.Random(3)
    for n in sizes:
        found = total = 0
        while total < 100:
            one = ["".join(r.choice("abcdefghijklmnopqrst") for _ in range(r.randint(2, 9))) for _ in range(n)]
            two = changed(r, kind, one)
            a, b = " ".join(one), " ".join(two)
            if distance(a, b) <= 0.2 * max(len(a), len(b)):
                sim, whose, code = block_codes([a.encode(), b.encode()])
                bits = int(np.bitwise_count(sim.view(np.uint64)[0] ^ sim.view(np.uint64)[1]))
                found += bits <= RADIUS and bool(set(code[whose == 0].tolist()) & set(code[whose == 1].tolist()))
                total += 1
        assert found >= 90, (n, found)


def test_words_added_at_both_ends_of_a_long_line(docs):
    line = " ".join(f"w{chr(97 + i % 26)}{chr(97 + i // 26)}" for i in range(300))
    got = {r["doc_id"]: r["kept_text"] for r in dedup_lines(docs([(1, line), (2, f"one {line} two"), (3, "other text of its own here")])).collect()}
    assert got == {1: line, 2: "", 3: "other text of its own here"}


def test_op7_equals_all_pairs_without_a_radius(spark):
    docs = [(r["doc_id"], r["text"]) for r in spark.read.parquet(f"{SF}/documents.parquet").where("doc_id < 60").collect()]
    rows = spark.createDataFrame(docs, "doc_id long, text string")
    assert {r["doc_id"]: r["kept_text"] for r in dedup_lines(rows).collect()} == plain_lines(docs)[0]


def test_short_and_unspaced_lines_repeat(docs):
    chinese = "这是一个关于数据清洗的很长的句子而且没有任何空格在里面"
    rows = [(1, f"Read more\n{chinese}\n\n---"), (2, f"read more!\nRead less\n{chinese}\n\n---"), (3, chinese.replace("清洗", "整理"))]
    got = {r["doc_id"]: r["kept_text"] for r in dedup_lines(docs(rows)).collect()}
    assert got == {1: rows[0][1], 2: "Read less\n\n---", 3: ""}


def test_lines_on_odd_rows(docs):
    got = dedup_lines(docs(ODD, extra=True)).collect()
    assert Counter(r["doc_id"] for r in got) == Counter(i for i, _ in ODD)
    assert {r["doc_id"]: r["kept_text"] for r in got if r["doc_id"] in (1, 2, 3, 6, 7, 8)} == {1: None, 2: "", 3: "   \n\t ", 6: "\n\n", 7: ODD[9][1], 8: ""}
    assert dedup_lines(docs([])).count() == 0


def test_simhash_pieces():
    r = random.Random(1)
    word = lambda: "".join(r.choice("abcdefgh") for _ in range(r.randint(1, 9)))
    lines = [" ".join(word() for _ in range(n)).encode() for n in [*range(1, 40), 300, 700]]
    hashes, counts = unit_hashes(lines)
    assert np.array_equal(unit_hashes(lines, most=7)[0], hashes)
    cuts = np.cumsum(counts)[:-1]
    plain = [sum(1 << b for b in range(64) if 2 * sum(int(x) >> b & 1 for x in h) > len(h)) for h in np.split(hashes, cuts)]
    assert simhashes(lines).view(np.uint64).tolist() == plain
    _, whose, code = block_codes(lines)
    for k, x in enumerate(lines):
        w = x.split(b" ")
        w[len(w) // 2] = b"changed"
        _, _, new = block_codes([b" ".join(w)])
        assert len(w) < 2 or set(code[whose == k].tolist()) & set(new.tolist())


def test_distance_equals_the_table():
    r = random.Random(2)
    for _ in range(500):
        a, b = ("".join(r.choice("ab ") for _ in range(r.randint(0, 12))) for _ in range(2))
        row = list(range(len(b) + 1))
        for i, x in enumerate(a, 1):
            new = [i]
            for j, y in enumerate(b, 1):
                new.append(min(row[j] + 1, new[-1] + 1, row[j - 1] + (x != y)))
            row = new
        assert distance(a, b) == row[-1] and close(a, b, 0.6) == (row[-1] <= 0.4 * max(len(a), len(b)) + 1e-9)


def test_listed_pairs_meet_once():
    cell, side = np.array([1, 1, 1, 2, 2, 2, 2, 3]), np.array([2, 2, 2, 0, 0, 1, 1, 2])
    for most in (1, 100):
        got = [p for i, j in listed(cell, side, most) for p in zip(i.tolist(), j.tolist(), strict=True)]
        assert got == [(0, 1), (0, 2), (1, 2), (3, 5), (3, 6), (4, 5), (4, 6)]


def test_components(spark):
    edges = [(i, i + 1) for i in range(1, 30)] + [(50, 51), (52, 51), (7, 7), (30, 1)]
    got = {r["node"]: r["root"] for r in components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert got == {**dict.fromkeys(range(1, 31), 1), 50: 50, 51: 50, 52: 50}
    assert components(spark.createDataFrame([], "a long, b long")).count() == 0


def test_suffix_array_equals_sorting():
    r = random.Random(5)
    for t in range(1500):
        s = [r.randrange(r.choice([1, 2, 3, 5])) for _ in range(r.randint(0, 40))] * (1 + t % 3)
        assert suffix_array(s) == sorted(range(len(s)), key=lambda i: s[i:])


def same_bytes(got, docs, length):
    seen = Counter(t.encode()[i : i + length] for _, t in docs for i in range(len(t.encode()) - length + 1))
    want = Counter()
    for d, t in docs:
        b = t.encode()
        gone = np.zeros(len(b), bool)
        for i in range(len(b) - length + 1):
            if seen[b[i : i + length]] > 1:
                gone[i : i + length] = True
        runs = int((np.diff(np.r_[0, gone.astype(int)]) == 1).sum())
        want[d, len(b), int(gone.sum()), runs, hashlib.sha256(np.frombuffer(b, np.uint8)[~gone].tobytes()).hexdigest()] += 1
    assert Counter((r["doc_id"], r["n_bytes"], r["n_removed"], r["n_spans"], r["kept_sha256"]) for r in got) == want


@pytest.mark.parametrize("length, cap, sa", [(100, 2048, 1_000_000), (75, 3, 500)])
def test_substrings_equal_counting_windows(docs, length, cap, sa):
    r = random.Random(9)
    rows = corpus(40, edits=2) + [(100, "For " * 300), (101, "ab" * 200 + "x" + "ab" * 200), (102, "é知" * 150), (103, "\x00" * 300)]
    rows += [(200 + i, rows[i][1] if r.random() < 0.5 else rows[i][1][17:]) for i in range(12)] + [rows[5]]
    same_bytes(dedup_substrings(docs(rows), length=length, cap=cap, part_bytes=4000, sa_bytes=sa).collect(), rows, length)


def test_op9_equals_counting_windows(spark):
    docs = [(r["doc_id"], r["text"]) for r in spark.read.parquet(f"{SF}/documents.parquet").collect()]
    same_bytes(queries.op9_suffix_array_dedup(spark, SF).collect(), docs, 400)


def test_substrings_on_odd_rows(docs):
    rows = [(i, t or "") for i, t in ODD]
    same_bytes(dedup_substrings(docs(ODD, extra=True)).collect(), rows, 400)
    assert dedup_substrings(docs([])).count() == 0


def test_pairs_that_are_told_early_leave_the_others_right():
    r = np.random.default_rng(3)
    word = lambda n: "".join(r.choice(list("abcdefgh "), n))
    pairs = []
    for k in range(600):
        a = word(int(r.integers(80, 400)))
        b = "".join(c for c in a if r.random() > 0.001 * (k % 300)) if k % 3 else word(len(a))
        pairs.append((a, b))
    most = np.array([0.2 * max(len(a), len(b)) for a, b in pairs])
    gone = lines.far_apart(pairs, most)
    assert 200 < gone.sum() < 600
    assert all(lines.distance(a, b) > m for (a, b), m, x in zip(pairs, most, gone.tolist(), strict=True) if x)


def test_few_pairs_and_odd_ones_are_told_as_by_the_distance():
    r = np.random.default_rng(4)
    word = lambda n: "".join(r.choice(list("abcdé语😀 "), n))
    pairs = [("", ""), ("", "a"), ("a" * 30, "b" * 30), ("ab" * 20, "ba" * 20)]
    for n in (1, 3, 20, 90, 300) * 12:
        a = word(n)
        pairs.append((a, "".join(c for c in a if r.random() > 0.25) + word(int(r.integers(0, 4)))))
        pairs.append((a, word(n)))
    most = np.array([r.choice([0.05, 0.2, 0.5]) * max(len(a), len(b)) + 1e-9 for a, b in pairs])
    want = [lines.distance(a, b) > m for (a, b), m in zip(pairs, most, strict=True)]
    assert 20 < sum(want) < 110
    for room, longest in ((1 << 16, 4096), (50, 4096), (1 << 16, 60)):
        assert lines.far_apart(pairs, most, room, longest).tolist() == want


def test_lines_leave_only_the_table_that_the_result_reads(spark, docs):
    folder = Path(shared_dir(spark).removeprefix("file://")) / "lumenkb"
    before = set(folder.glob("*"))
    got = dedup_lines(docs([(1, "one line of more than five words"), (2, "one line of more than five words\nb"), (3, "one line of more than six words")]))
    assert [p.name.split("-")[0] for p in set(folder.glob("*")) - before] == ["gone"]
    assert {r["doc_id"]: r["kept_text"] for r in got.collect()} == {1: "one line of more than five words", 2: "b", 3: ""}
