"""Connected components of a graph given by its edges, without ever gathering a component."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lumenkb.session import materialize


def components(edges: DataFrame, limit: int = 60) -> DataFrame:
    """node, root: each node of ``edges`` (a, b; one type) with the smallest node of its component.

    Labels start as the node itself. In each round a node takes the smallest label among itself and its neighbours,
    then the label of that label, so that long chains shrink by jumps; rounds end when no label changes. Each round is
    written to the shared folder. Raises if labels still change after ``limit`` rounds.
    """
    both = edges.where(F.col("a") != F.col("b")).select("a", "b")
    both = materialize(both.union(both.select("b", "a")).distinct(), "edges")
    labels = materialize(both.groupBy(F.col("a").alias("node")).agg(F.min("b").alias("low")).select("node", F.least("node", "low").alias("root")), "labels")
    for _ in range(limit):
        near = both.join(labels.select(F.col("node").alias("b"), F.col("root").alias("low")), "b").groupBy(F.col("a").alias("node")).agg(F.min("low").alias("low"))
        step = labels.join(near, "node").select("node", F.col("root").alias("old"), F.least("root", "low").alias("mid"))
        jump = labels.select(F.col("node").alias("mid"), F.col("root").alias("far"))
        new = materialize(step.join(jump, "mid").select("node", "old", F.least("mid", "far").alias("root")), "labels")
        if new.where(F.col("root") != F.col("old")).isEmpty():
            return new.select("node", "root")
        labels = new.select("node", "root")
    raise RuntimeError("components: labels did not settle")
