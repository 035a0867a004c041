"""Conversations as a stream against the batch, over a restart."""

import datetime
import random

from pyspark.sql import functions as F

from lumenkb.operators import sessions
from lumenkb.streaming.compaction import append_by_day, fold_stream

TURN = "session_id long, turn_index long, role string, content string, ts timestamp"
TEXTS = ["plain", "error: bad thing", "error: other thing", "error[E1]: x\n --> a.rs:1", "test result: ok", "resolved it", "long " * 300, "\n".join(["error: bad thing"] * 30)]


def turns(seed, sessions_=6, n=30):
    r, t0 = random.Random(seed), datetime.datetime(2024, 1, 1)
    rows = [(s, i, r.choice(["tool", "tool", "assistant", "user", "system"]), r.choice(TEXTS), t0 + datetime.timedelta(minutes=i)) for s in range(sessions_) for i in range(r.randrange(1, n))]
    return sorted(rows, key=lambda x: x[4])


def test_the_stream_equals_the_batch_over_a_restart(spark, tmp_path):
    rows = turns(1)
    far = [(1000 + n, 0, "user", "later", datetime.datetime(2024, 2, 1 + n)) for n in range(3)]
    source = f"{tmp_path}/in"
    put = lambda part: spark.createDataFrame(part, TURN).coalesce(1).write.mode("append").parquet(source)

    def run():
        stream = fold_stream(spark.readStream.schema(TURN).option("maxFilesPerTrigger", 1).parquet(source), hot=3)
        stream.writeStream.format("parquet").option("checkpointLocation", f"file://{tmp_path}/cp").trigger(availableNow=True).start(f"{tmp_path}/out").awaitTermination()

    third = len(rows) // 3
    put(rows[:third])
    put(rows[third : 2 * third])
    run()
    put(rows[2 * third :])  # the query is started anew from its checkpoint
    for x in far:
        put([x])
    run()
    got = {(x.session_id, x.turn_index): (x.tier, x.solved) for x in spark.read.parquet(f"{tmp_path}/out").where("session_id < 1000").collect()}
    n = spark.read.parquet(f"{tmp_path}/out").where("session_id < 1000").count()
    batch = sessions.fold_turns(spark.createDataFrame(rows, TURN).drop("ts"), hot=3)
    solved = F.regexp_extract("content", r"^\[Superseded error: (?s:.*)resolved in turn (\d+)\]$", 1)
    want = {(x.session_id, x.turn_index): (x.tier, int(x.s) if x.s else None) for x in batch.withColumn("s", solved).collect()}
    assert n == len(rows) and got == want
    assert {t for t, _ in want.values()} == {-1, 0, 1, 2, 3}


def test_observations_are_appended_once_by_day(spark, tmp_path):
    schema = "ts timestamp, text string"
    day = lambda d: (datetime.datetime(2024, 1, d, 12), f"d{d}")
    for part in ([day(1), day(2)], [day(2)]):
        spark.createDataFrame(part, schema).coalesce(1).write.mode("append").parquet(f"{tmp_path}/in")
        append_by_day(spark.readStream.schema(schema).parquet(f"{tmp_path}/in"), f"{tmp_path}/out", f"file://{tmp_path}/cp").awaitTermination()
    assert {(str(x.day), x.n) for x in spark.read.parquet(f"{tmp_path}/out").groupBy("day").agg(F.count("*").alias("n")).collect()} == {("2024-01-01", 1), ("2024-01-02", 2)}
