"""What becomes of intermediate tables."""

import os

from pyspark.sql import functions as F

from lumenkb.session import materialize, shared_dir, tidy


def tables(spark):
    at = shared_dir(spark).removeprefix("file://") + "/lumenkb"
    return set(os.listdir(at)) if os.path.isdir(at) else set()


def test_only_what_a_result_reads_stays(spark):
    @tidy
    def inner(df):
        unread = materialize(df, "unread")
        return materialize(unread.select((F.col("id") * 2).alias("id")), "read")

    @tidy
    def outer(df):
        counted = inner(df)
        return materialize(counted.agg(F.sum("id").alias("n")), "sum")

    before = tables(spark)
    beside = inner(spark.range(5))
    kept = tables(spark) - before
    assert [x.split("-")[0] for x in kept] == ["read"]
    out = outer(spark.range(10))
    assert sorted(x.split("-")[0] for x in tables(spark) - before) == ["read", "sum"]
    # neither another result nor this one has lost anything
    assert out.first()["n"] == 90 and beside.count() == 5 and beside.count() == 5


def test_a_failing_function_leaves_the_next_one_alone(spark):
    @tidy
    def fails(df):
        materialize(df, "left")
        raise ValueError("x")

    try:
        fails(spark.range(1))
    except ValueError:
        pass
    assert tidy(lambda df: df)(materialize(spark.range(3), "own")).count() == 3
