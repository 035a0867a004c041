"""Pairs of rows that share a bucket: dealing buckets to tasks, and listing pairs with plain array arithmetic."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lumenkb.session import materialize


def deal(rows: DataFrame, key: str, spread_by: str, cap: int, parts: int, drop_single: bool = True) -> DataFrame:
    """``rows`` with part, cell and side, so that rows that must meet share a part and a cell.

    A bucket of at most ``cap`` rows is one cell. A larger one is cut into chunks of about ``cap`` rows by the hash of
    ``spread_by``, and each pair of chunks is a cell: every pair of rows still meets exactly once (rows of one chunk in
    the cell of that chunk with itself), and no task holds more than two chunks of it. side: 0 or 1, the chunk's place
    in a cell of two chunks; 2 in a cell of one. Rows alone in their bucket go, unless ``drop_single`` is off, which
    saves a join where such rows are rare and no bucket is large.
    """
    sizes = rows.groupBy(key).agg(F.count(F.lit(1)).alias("_n"))
    if drop_single:
        # written, so that Spark can split the join where a bucket is hot
        rows = rows.join(materialize(sizes.where(F.col("_n") > 1), "sizes"), key)
    else:
        large = materialize(sizes.where(F.col("_n") > cap), "large")
        rows = rows.withColumn("_n", F.lit(1)) if large.isEmpty() else rows.join(large, key, "left")
    rows = rows.withColumn("_c", F.coalesce(F.ceil(F.col("_n") / cap).cast("int"), F.lit(1)))
    small = F.array(F.struct(F.lit(0).alias("i"), F.lit(0).alias("j"), F.lit(2).alias("side")))
    own = F.expr(f"cast(pmod(xxhash64({spread_by}, 5), _c) as int)")
    cells = F.transform(
        F.sequence(F.lit(0), F.col("_c") - 1),
        lambda o: F.struct(F.least(o, F.col("_o")).alias("i"), F.greatest(o, F.col("_o")).alias("j"), F.when(o == F.col("_o"), 2).when(o > F.col("_o"), 0).otherwise(1).alias("side")),
    )
    rows = rows.withColumn("_o", own).withColumn("_x", F.explode(F.when(F.col("_c") == 1, small).otherwise(cells)))
    cell = F.xxhash64(key, "_x.i", "_x.j")
    return rows.select(*[c for c in rows.columns if c not in ("_n", "_c", "_o", "_x")], cell.alias("cell"), F.col("_x.side").alias("side"), F.expr(f"cast(pmod(xxhash64({key}, _x.i, _x.j), {parts}) as int)").alias("part"))


def listed(cell: np.ndarray, side: np.ndarray, most: int = 2_000_000) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Positions (i, j) of all pairs within equal cells, about ``most`` at a time. ``cell`` must be sorted, with equal (cell, side) adjacent."""
    n = len(cell)
    if not n:
        return
    starts = np.flatnonzero(np.r_[True, cell[1:] != cell[:-1]])
    ends = np.r_[starts[1:], n]
    # a row pairs with the rows after it: up to its cell's end, and in a cell of two chunks only with the other chunk
    end = np.repeat(ends, ends - starts)
    middle = np.r_[True, (cell[1:] != cell[:-1]) | (side[1:] != side[:-1])]
    at = np.flatnonzero(middle)
    run_end = np.repeat(np.r_[at[1:], n], np.diff(np.r_[at, n]))
    first = np.where(side == 2, np.arange(n) + 1, run_end)
    count = np.maximum(end - first, 0)
    total = np.cumsum(count)
    lo = 0
    while lo < n:
        base = total[lo - 1] if lo else 0
        hi = max(lo + 1, int(np.searchsorted(total, base + most, "right")))
        c = count[lo:hi]
        i = np.repeat(np.arange(lo, hi), c)
        if len(i):
            yield i, np.arange(len(i)) - np.repeat(np.cumsum(c) - c, c) + np.repeat(first[lo:hi], c)
        lo = hi


class Forest:
    """Union-find over positions."""

    def __init__(self, n: int):
        self.up = list(range(n))

    def root(self, x: int) -> int:
        up = self.up
        while up[x] != x:
            up[x] = up[up[x]]
            x = up[x]
        return x

    def join(self, a: int, b: int) -> bool:
        """False if they were joined before."""
        a, b = self.root(a), self.root(b)
        self.up[max(a, b)] = min(a, b)
        return a != b
