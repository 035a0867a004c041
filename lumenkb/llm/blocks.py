"""Vectors in packed blocks, and the grid of query blocks against candidate blocks that two search operators share.

A block holds a bounded number of vectors of one dimension in one row. Each pair of a query block and a candidate block
of the same dimension is one cell, which one task scores. Nothing is broadcast and no cell grows with the input; their
number does, as it must when each query meets each row.
"""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lumenkb.session import materialize, ship_code


def valid_vectors(df: DataFrame, id_col: str = "vec_id", vec_col: str = "embedding", nonzero: bool = False) -> DataFrame:
    """vec_id long, v array<double>: rows whose id isn't null and whose vector has only finite components."""
    v = F.col("v")
    df = df.select(F.col(id_col).cast("long").alias("vec_id"), F.col(vec_col).cast("array<double>").alias("v"))
    good = lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < F.lit(float("inf")))
    df = df.where(F.col("vec_id").isNotNull() & v.isNotNull() & (F.size(v) > 0) & F.forall(v, good))
    return df.where(F.exists(v, lambda x: x != 0)) if nonzero else df


def pack_blocks(vectors: DataFrame, rows: int, tag: str, encode: Callable[[np.ndarray, np.ndarray], dict[str, bytes]], fields: list[str]) -> DataFrame:
    """dim, block and the binary ``fields`` that ``encode(ids, matrix)`` makes of each block of about ``rows`` vectors."""
    blocks = max(1, -(-vectors.count() // rows))
    keyed = vectors.select(F.size("v").alias("dim"), F.expr(f"cast(pmod(xxhash64(vec_id, v), {blocks}) as int)").alias("block"), "vec_id", "v")

    def one(key: tuple, pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("vec_id", kind="stable")
        out = encode(pdf["vec_id"].to_numpy(np.int64), np.stack(pdf["v"].to_list()))
        return pd.DataFrame([[key[0], key[1], *(out[f] for f in fields)]], columns=["dim", "block", *fields])

    ship_code(vectors.sparkSession)
    schema = "dim int, block int, " + ", ".join(f"{f} binary" for f in fields)
    return materialize(keyed.groupBy("dim", "block").applyInPandas(one, schema), tag)


def grid(queries: DataFrame, candidates: DataFrame) -> DataFrame:
    """One row per cell: the candidate block's columns with the prefix c_, the query block's with q_."""
    nq, nc = (x.agg(F.max("block")).first()[0] for x in (queries, candidates))
    if nq is None or nc is None:
        nq = nc = 0

    def spread(df: DataFrame, mark: str, other: str, n: int) -> DataFrame:
        df = df.select("dim", F.col("block").alias(mark), *[F.col(c).alias(f"{mark}_{c}") for c in df.columns if c not in ("dim", "block")])
        return df.withColumn(other, F.explode(F.sequence(F.lit(0), F.lit(n))))

    return spread(candidates, "c", "q", nq).hint("shuffle_hash").join(spread(queries, "q", "c", nc), ["dim", "c", "q"])


def best_of_row(scores: np.ndarray, k: int) -> np.ndarray:
    """Positions of the k largest, ties to the smaller position, in falling order."""
    if len(scores) > k:
        least = np.partition(scores, len(scores) - k)[len(scores) - k]
        above = np.flatnonzero(scores > least)
        at = np.concatenate([above, np.flatnonzero(scores == least)[: k - len(above)]])
    else:
        at = np.arange(len(scores))
    return at[np.lexsort((at, -scores[at]))]


def best_but(scores: np.ndarray, k: int, ids: np.ndarray, own: int) -> np.ndarray:
    """The same without the positions at which the sorted ``ids`` are ``own``."""
    lo, hi = np.searchsorted(ids, own, "left"), np.searchsorted(ids, own, "right")
    if lo == hi:
        return best_of_row(scores, k)
    rest = np.concatenate([np.arange(lo), np.arange(hi, len(ids))])
    return rest[best_of_row(scores[rest], k)]
