"""Operator 4: exact top-k search by exhaustive term-at-a-time accumulation.

Each component of a quantised vector is a term with an integer weight. A candidate block keeps, for each term, a posting
list of the rows and weights that aren't zero. Each term of the query block in turn scatters its weight times its
postings into dense score arrays; each cell selects its own k by partition, and a window merges the cells.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from lumenkb.llm.blocks import best_but, grid, pack_blocks, valid_vectors


def _postings(ids: np.ndarray, m: np.ndarray) -> dict[str, bytes]:
    w = m.astype(np.int64)
    at = [np.flatnonzero(w[:, t]) for t in range(w.shape[1])]
    return {
        "ids": ids.tobytes(),
        "starts": np.cumsum([0, *map(len, at)], dtype=np.int64).tobytes(),
        "rows": np.concatenate(at).astype(np.int32).tobytes(),
        "weights": np.concatenate([w[a, t] for t, a in enumerate(at)]).tobytes(),
    }


def _score_cells(k: int, chunk: int):
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            for cell in pdf.itertuples(index=False):
                ids, qids = np.frombuffer(cell.c_ids, np.int64), np.frombuffer(cell.q_ids, np.int64)
                starts, rows, weights = np.frombuffer(cell.c_starts, np.int64), np.frombuffer(cell.c_rows, np.int32), np.frombuffer(cell.c_weights, np.int64)
                q = np.frombuffer(cell.q_weights, np.int64).reshape(len(qids), -1)
                out = []
                for lo in range(0, len(qids), chunk):
                    part = q[lo : lo + chunk]
                    scores = np.zeros((len(part), len(ids)), np.int64)
                    for t in range(part.shape[1]):
                        have, a, b = np.flatnonzero(part[:, t]), starts[t], starts[t + 1]
                        if b - a == len(ids) and len(have) == len(part):
                            scores += np.multiply.outer(part[:, t], weights[a:b])
                        elif b > a and len(have):
                            scores[np.ix_(have, rows[a:b])] += np.multiply.outer(part[have, t], weights[a:b])
                    for i, row in enumerate(scores):
                        got = best_but(row, k, ids, qids[lo + i])
                        out.append(pd.DataFrame({"query_id": qids[lo + i], "vec_id": ids[got], "score": row[got]}))
                if out:
                    yield pd.concat(out)

    return run


def merge(found: DataFrame, k: int) -> DataFrame:
    """Each query's k best over all cells; a partial window in each task comes before the shuffle."""
    best = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    return found.withColumn("rank", F.row_number().over(best)).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")


def exact_top_k(vectors: DataFrame, is_query, k: int = 5, scale: int = 256, block_rows: int = 4096, query_rows: int = 1024, chunk: int = 128) -> DataFrame:
    """The k largest integer inner products of each query among all other rows, ties to the smaller vec_id.

    ``vectors``: vec_id, embedding; other columns are ignored. ``is_query``: a condition on vec_id. A component x
    counts as floor(scale * x). Null ids, and vectors that are null or empty or hold null or non-finite components,
    take no part; vectors of another dimension than the query's aren't its candidates. Rows that repeat a vec_id are
    candidates (and queries) each, but never of a query with that id. An empty table gives no rows. Products beyond
    a long are not supported.
    """
    v = valid_vectors(vectors).select("vec_id", F.transform("v", lambda x: F.floor(x * scale).cast("double")).alias("v"))
    names = ["ids", "starts", "rows", "weights"]
    candidates = pack_blocks(v, block_rows, "postings", _postings, names)
    queries = pack_blocks(v.where(is_query), query_rows, "queries", lambda ids, m: {"ids": ids.tobytes(), "weights": m.astype(np.int64).tobytes()}, ["ids", "weights"])
    found = grid(queries, candidates).mapInPandas(_score_cells(k, chunk), "query_id long, vec_id long, score long")
    return merge(found, k)
