"""An index kept by batches, against one built anew."""

import random

import pytest
from pyspark.sql import functions as F

from lumenkb.operators import index
from lumenkb.operators.index import TABLES, Conflict, NoteIndex

NOTE = "doc_id long, path string, title string, tags array<string>, links array<string>, body string, mtime long"


def note(r, i, t):
    words = lambda n: " ".join(r.choice("alpha beta gamma délta 知识 x1".split()) for _ in range(n))
    return (i, f"d/{i}.md", words(2), r.choice([None, [], ["a"], ["a", "b", "a"]]), r.choice([None, [], ["x", "y"]]), r.choice([None, "", words(5) + "\n" + words(3)]), t)


def frame(spark, rows):
    return spark.createDataFrame(rows, NOTE)


def held(tables):
    return {t: sorted(map(tuple, df.select(*[c.split()[0] for c in TABLES[t].split(", ")]).collect()), key=repr) for t, df in tables.items()}


def test_ten_batches_equal_an_index_built_anew(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(index, "MOST_SEGMENTS", 4)  # so that some batches merge
    r, now = random.Random(1), {}
    ix = NoteIndex(spark, f"file://{tmp_path}/ix")
    assert ix.read("postings").count() == 0
    for n in range(10):
        changed = {i: note(r, i, n) for i in r.sample(range(30), 6)}
        gone = [i for i in r.sample(range(30), 4) if i not in changed]
        now = {i: x for i, x in (now | changed).items() if i not in gone}
        assert ix.apply("s", n, frame(spark, list(changed.values())), spark.createDataFrame([(i,) for i in gone], "doc_id long"))
    anew = index.derive(frame(spark, list(now.values())))
    assert held({t: ix.read(t) for t in TABLES}) == held(anew)
    assert ix.clean() > 0
    assert held({t: ix.read(t) for t in TABLES}) == held(anew)


def test_a_killed_batch_can_be_run_again(spark, tmp_path, monkeypatch):
    ix = NoteIndex(spark, f"file://{tmp_path}/ix")
    r = random.Random(2)
    first, second = [note(r, i, 0) for i in range(4)], [note(r, i, 1) for i in range(2, 6)]
    ix.apply("s", 0, frame(spark, first))
    before = ix.read("postings")
    with monkeypatch.context() as m:
        m.setattr(NoteIndex, "_commit", lambda *a: (_ for _ in ()).throw(KeyboardInterrupt()))
        with pytest.raises(KeyboardInterrupt):
            ix.apply("s", 1, frame(spark, second))
    assert held({t: ix.read(t) for t in TABLES}) == held(index.derive(frame(spark, first)))
    # a manifest that its writer didn't finish counts for nothing
    (tmp_path / "ix/manifests/00000000000000000002.json").write_text('{"number": 2, "segm')
    assert ix.apply("s", 1, frame(spark, second))
    want = held(index.derive(frame(spark, [*first[:2], *second])))
    assert held({t: ix.read(t) for t in TABLES}) == want
    # the same batch again, and an older one, change nothing; another source has its own numbers
    assert not ix.apply("s", 1, frame(spark, [note(r, 9, 2)])) and not ix.apply("s", 0, frame(spark, [note(r, 9, 2)]))
    assert held({t: ix.read(t) for t in TABLES}) == want
    assert ix.apply("other", 0, frame(spark, []), spark.createDataFrame([(2,)], "doc_id long"))
    assert ix.read("documents").where("doc_id = 2").count() == 0
    # what was read before is what it was
    assert held({"postings": before}) == held({"postings": index.derive(frame(spark, first))["postings"]})


def test_one_of_two_writers_has_to_come_again(spark, tmp_path):
    a, b = (NoteIndex(spark, f"file://{tmp_path}/ix") for _ in range(2))
    r = random.Random(3)
    a.apply("a", 0, frame(spark, [note(r, 1, 0)]))
    was = b.state()
    a.apply("a", 1, frame(spark, [note(r, 2, 0)]))
    with pytest.raises(Conflict):
        b._commit(was, was["segments"], {"b": 0})
    assert b.apply("b", 0, frame(spark, [note(r, 3, 0)]))
    assert {x.doc_id for x in a.read("documents").collect()} == {1, 2, 3}


def test_stale_rows_are_made_anew_within_a_budget(spark, tmp_path, monkeypatch):
    ix, r = NoteIndex(spark, f"file://{tmp_path}/ix"), random.Random(4)
    rows = [note(r, i, 0) for i in range(7)]
    ix.apply("s", 0, frame(spark, rows))
    assert ix.stale().count() == 0
    monkeypatch.setattr(index, "MADE_BY", "2")
    source = frame(spark, rows[:6])  # one note is gone meanwhile
    assert [ix.repair(source, n, 3) for n in range(3)] == [4, 1, 0]
    assert held({t: ix.read(t) for t in TABLES}) == held(index.derive(source))


def test_a_stream_of_changes_counts_once_over_a_restart(spark, tmp_path, monkeypatch):
    ix, r = NoteIndex(spark, f"file://{tmp_path}/ix"), random.Random(5)
    schema = NOTE + ", gone boolean"
    put = lambda n, rows: spark.createDataFrame(rows, schema).coalesce(1).write.mode("append").parquet(f"{tmp_path}/in")
    follow = lambda: ix.follow(spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(f"{tmp_path}/in"), "in", f"file://{tmp_path}/cp").awaitTermination()
    one, two, three = note(r, 1, 1), note(r, 2, 1), note(r, 1, 5)
    put(0, [(*one, None), (*two, False)])
    follow()
    put(1, [(*three, False), (*two[:6], 9, True)])
    with monkeypatch.context() as m:  # killed after the commit, before the stream knows
        whole = NoteIndex.apply
        m.setattr(NoteIndex, "apply", lambda *a: (whole(*a), 1 / 0))
        with pytest.raises(Exception, match="division by zero"):
            follow()
    number = ix.state()["number"]
    follow()
    assert ix.state()["number"] == number
    assert held({t: ix.read(t) for t in TABLES}) == held(index.derive(frame(spark, [three])))


def test_title_and_tags_are_found(spark, tmp_path):
    ix = NoteIndex(spark, f"file://{tmp_path}/ix")
    ix.apply("s", 0, frame(spark, [(1, "a.md", "Rust Memory", ["Storage/Cache"], None, "text", 0)]))
    assert {x.term for x in ix.read("postings").collect()} == {"rust", "memory", "storage", "cache", "text"}
    assert ix.read("documents").select(F.col("n_tokens")).first()[0] == 5
