"""Operator 8: packing documents into fixed-length sequences by the sum-of-squares rule.

Every document is its tokens and an end token. A document longer than ``budget`` is cut into pieces of ``budget``
tokens; what is left over is its first piece. Pieces are dealt at random into groups of about ``group_rows`` rows, and
each group is packed alone, in falling and in random order, of which the better result counts. A piece is placed where the sum over all residual gaps g of
(number of open bins with gap g) squared becomes smallest, opening a bin being one of the places. Groups are what
makes the operator scale: a group costs a bounded part of one task, and only its last open bins are lost.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lumenkb.llm.bpe import default_path, encoder, packed
from lumenkb.session import materialize, ship_code

PIECES = "doc_id long, piece int, start long, length long, ids_crc32 long"
PLACES = PIECES + ", sequence_id long, offset long"


def sum_of_squares(lengths: np.ndarray, budget: int) -> tuple[np.ndarray, np.ndarray]:
    """Bin and offset of each item, items taken in the order given; all lengths lie in 1..budget.

    Moving a bin from gap g to g - s changes the sum by 2 * (N[g - s] - N[g]) + 2; a gap of 0 counts nothing and a new
    bin leaves nothing behind, which the two edge values below express in the same formula. Ties go to the smallest gap.
    """
    count = np.zeros(budget + 1)
    count[0], count[budget] = -0.5, 0.5
    stacks: list[list[int]] = [[] for _ in range(budget + 1)]
    bins, offsets = np.empty(len(lengths), np.int64), np.empty(len(lengths), np.int64)
    opened = 0
    for i, s in enumerate(lengths.tolist()):
        before = count[s:]
        change = np.where(before > 0, count[: budget - s + 1] - before, np.inf)
        g = s + int(change.argmin())
        if g == budget:
            b, opened = opened, opened + 1
        else:
            b = stacks[g].pop()
            count[g] -= 1
        bins[i], offsets[i] = b, budget - g
        if g > s:
            stacks[g - s].append(b)
            count[g - s] += 1
    return bins, offsets


def token_pieces(docs: DataFrame, path: str, budget: int = 1024, end_id: int = 2) -> DataFrame:
    """doc_id, piece, start, length, ids_crc32 of each piece of each document."""

    def cut(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        encode = encoder(path)
        for pdf in batches:
            rows = []
            for doc_id, text in zip(pdf["doc_id"], pdf["text"], strict=True):
                ids = encode(text or "")
                ids.append(end_id)
                raw, n = packed(ids), len(ids)
                start, end = 0, n % budget or min(n, budget)
                piece = 0
                while start < n:
                    rows.append((doc_id, piece, start, end - start, zlib.crc32(raw[4 * start : 4 * end])))
                    piece, start, end = piece + 1, end, end + budget
            yield pd.DataFrame(rows, columns=["doc_id", "piece", "start", "length", "ids_crc32"]).astype({"doc_id": "Int64"})

    ship_code(docs.sparkSession)
    return docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string")).mapInPandas(cut, PIECES)


def pack(docs: DataFrame, path: str | None = None, budget: int = 1024, end_id: int = 2, group_rows: int = 400_000) -> DataFrame:
    """Pack ``docs`` (doc_id, text; other columns are ignored): one row per piece, with its sequence and offset.

    A null or empty text is one end token. Rows that repeat, also with the same or a null doc_id, are packed once each.
    An empty table gives no rows.
    """
    pieces = materialize(token_pieces(docs, path or default_path(), budget, end_id), "pieces")
    groups = max(1, -(-pieces.count() // group_rows))
    # the number of a row is fixed by the table just written, so that a lost task is redone alike
    keyed = pieces.withColumn("grp", F.expr(f"cast(pmod(xxhash64(monotonically_increasing_id()), {groups}) as int)"))

    def place(key: tuple, pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values(["ids_crc32", "doc_id", "piece"], kind="stable")
        full = pdf[pdf["length"] == budget]  # each is a sequence
        mixed = pdf[pdf["length"] < budget]
        falling = mixed.sort_values("length", ascending=False, kind="stable")
        # small groups do better in falling order, large ones in a random one
        tried = [(x, *sum_of_squares(x["length"].to_numpy(), budget)) for x in (falling, mixed)]
        placed, bins, offsets = min(tried, key=lambda x: x[1].max(initial=-1))
        alone = np.arange(len(full)) + bins.max(initial=-1) + 1
        pdf = pd.concat([placed, full]).assign(offset=np.r_[offsets, np.zeros(len(full), np.int64)])
        pdf = pdf.assign(sequence_id=(np.int64(key[0]) << 32) + np.r_[bins, alone]).astype({"doc_id": "Int64"})
        return pdf[["doc_id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset"]]

    return keyed.groupBy("grp").applyInPandas(place, PLACES)
