"""Operator 6: approximate nearest neighbours by inner product over randomly rotated one-bit codes.

The index keeps, per vector, the sign bits of its randomly rotated direction from the block's centre (one bit a
dimension, packed), and three correction scalars: its distance from the centre, the inner product of its direction with
its own code, and its inner product with the centre. Vectors of fewer than ``bits`` dimensions are padded with zeros
before they are turned, which buys narrower bounds for longer codes. A query looks up the bits in tables of partial sums, a byte at a
time, which gives an unbiased estimate of each inner product; its error is bounded with high probability by
``confidence`` standard deviations. The k-th best exact score among the 3k best estimates is a floor that no result
can lie under, so only vectors whose upper bound reaches it are scored exactly.

Every row is indexed; nothing is fitted but the mean of each block, and the rotation comes from a seed.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame

from lumenkb.llm.blocks import best_but, grid, pack_blocks, valid_vectors
from lumenkb.llm.topk import merge

BITS = np.unpackbits(np.arange(256, dtype=np.uint8)[:, None], axis=1).astype(np.float32)


def rotation(dim: int, bits: int, seed: int) -> np.ndarray:
    """The first ``dim`` columns of a random orthogonal matrix: a vector padded with zeros to ``bits`` dimensions, then turned."""
    q, r = np.linalg.qr(np.random.default_rng(seed).standard_normal((bits, bits)))
    return (q * np.sign(np.diag(r)))[:, :dim]


def encode_block(ids: np.ndarray, m: np.ndarray, bits: int, seed: int) -> dict[str, bytes]:
    bits = max(bits, m.shape[1])
    centre = m.mean(axis=0)
    off = m - centre
    far = np.linalg.norm(off, axis=1)
    turned = (off / np.where(far > 0, far, 1)[:, None]) @ rotation(m.shape[1], bits, seed).T
    fit = np.abs(turned).sum(axis=1) / np.sqrt(bits)
    scalars = np.stack([far, np.where(far > 0, fit, 1), off @ centre])
    return {"ids": ids.tobytes(), "codes": np.packbits(turned > 0, axis=1).tobytes(), "scalars": scalars.tobytes(), "centre": centre.tobytes(), "vectors": m.tobytes()}


def estimates(codes: np.ndarray, scalars: np.ndarray, centre: np.ndarray, q: np.ndarray, bits: int, seed: int, confidence: float) -> tuple[np.ndarray, np.ndarray]:
    """Estimated inner products, queries by rows, and the half width of their bounds."""
    bits = max(bits, q.shape[1])
    off = q - centre
    far = np.linalg.norm(off, axis=1)
    turned = ((off / np.where(far > 0, far, 1)[:, None]) @ rotation(q.shape[1], bits, seed).T).astype(np.float32)
    padded = np.pad(turned, ((0, 0), (0, -bits % 8)))
    total = np.zeros((len(codes), len(q)), np.float32)
    for j in range(codes.shape[1]):
        total += (BITS @ padded[:, 8 * j : 8 * j + 8].T)[codes[:, j]]
    along = (2 * total.T - turned.sum(axis=1, dtype=np.float64)[:, None]) / np.sqrt(bits)
    reach = far[:, None] * scalars[0]
    width = confidence * np.sqrt(np.maximum(1 - scalars[1] ** 2, 0)) / scalars[1] / np.sqrt(max(bits - 1, 1))
    return reach * (along / scalars[1]) + scalars[2] + (q @ centre)[:, None], reach * width


def _search_cells(k: int, bits: int, seed: int, confidence: float, chunk: int):
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            for cell in pdf.itertuples(index=False):
                ids, qids = np.frombuffer(cell.c_ids, np.int64), np.frombuffer(cell.q_ids, np.int64)
                vectors, q = np.frombuffer(cell.c_vectors).reshape(len(ids), -1), np.frombuffer(cell.q_vectors).reshape(len(qids), -1)
                codes = np.frombuffer(cell.c_codes, np.uint8).reshape(len(ids), -1)
                scalars, centre = np.frombuffer(cell.c_scalars).reshape(3, -1), np.frombuffer(cell.c_centre)
                out = []
                for lo in range(0, len(qids), chunk):
                    guess, half = estimates(codes, scalars, centre, q[lo : lo + chunk], bits, seed, confidence)
                    upper = guess + half
                    for i in range(len(guess)):
                        one, own = q[lo + i], qids[lo + i]
                        # a sum along each row adds in the same order for equal rows, so that equal vectors tie
                        guessed = best_but(guess[i], 3 * k, ids, own)
                        first = (vectors[guessed] * one).sum(axis=1)
                        # rows whose exact score is known stay, whatever their bound says
                        near = np.union1d(guessed, np.flatnonzero(upper[i] >= np.sort(first)[-k])) if len(first) >= k else np.arange(len(ids))
                        exact = (vectors[near] * one).sum(axis=1)
                        got = best_but(exact, k, ids[near], own)
                        out.append(pd.DataFrame({"query_id": own, "vec_id": ids[near[got]], "score": exact[got]}))
                if out:
                    yield pd.concat(out)

    return run


def nearest(vectors: DataFrame, is_query, k: int = 20, bits: int = 128, seed: int = 29, confidence: float = 1.9, block_rows: int = 8192, query_rows: int = 1024, chunk: int = 64) -> DataFrame:
    """About the k rows of largest inner product with each query, its own left out; ties to the smaller vec_id.

    ``vectors``: vec_id, embedding; other columns are ignored. ``is_query``: a condition on vec_id. Scores are exact.
    Null ids, and vectors that are null, empty or zero or hold null or non-finite components, take no part; vectors of
    another dimension than the query's aren't its candidates. Rows that repeat a vec_id are candidates (and queries)
    each, but never of a query with that id. An empty table gives no rows.
    """
    v = valid_vectors(vectors, nonzero=True)
    index = pack_blocks(v, block_rows, "codes", lambda ids, m: encode_block(ids, m, bits, seed), ["ids", "codes", "scalars", "centre", "vectors"])
    queries = pack_blocks(v.where(is_query), query_rows, "queries", lambda ids, m: {"ids": ids.tobytes(), "vectors": m.tobytes()}, ["ids", "vectors"])
    found = grid(queries, index).mapInPandas(_search_cells(k, bits, seed, confidence, chunk), "query_id long, vec_id long, score double")
    return merge(found, k)


def recall(found: DataFrame, truth: DataFrame) -> float:
    """The share of ``truth``'s (query_id, vec_id) pairs that ``found`` holds."""
    hits = truth.join(found.select("query_id", "vec_id"), ["query_id", "vec_id"], "left_semi").count()
    return hits / max(1, truth.count()) if truth.count() else 1.0


