"""Pairs of word sets that overlap much, all of them, without a list of the pairs that share a rare word.

Words have one order, rarest first (by counts of hashed buckets; any order gives right results, this one little work). Two
sets that share at least ``o`` words share at least ``o - h`` of them among the first words of both, where ``h`` is what the
first words leave of the set that they leave most of. Sets are blocks of about one size. Two blocks whose sizes can go
together meet in one task, with only the first words that those sizes call for; the task counts how many first words two
sets share and passes on those that share enough, a few more than there are results. These are checked on all words.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lumenkb.session import materialize, ship_code

#: Bits of a bucket of words.
BITS = 18
#: Sets and words of a block at most; blocks that the words are cut into at least, unless they are small.
SETS, WORDS, BLOCKS = 32768, 10_000_000, 16
#: First words beyond those that must share one: so many, and one for each so many words of the set.
MORE, EACH = 1, 32
#: Shared first words that are listed at once.
MOST = 2_000_000
EPS = 1e-6


def cut_sizes(counts: list[tuple[int, int]], sets: int = SETS, words: int = WORDS, blocks: int = BLOCKS) -> list[tuple[int, int, int]]:
    """smallest size, largest size, number of blocks that these sizes are dealt to. ``counts``: size and number of sets, ascending."""
    words = min(words, max(words // 40, sum(n * c for n, c in counts) // blocks))
    out: list[list[int]] = []
    for n, c in counts:
        if out and out[-1][2] + c <= sets and out[-1][3] + n * c <= words:
            out[-1][1:] = [n, out[-1][2] + c, out[-1][3] + n * c]
        else:
            out.append([n, n, c, n * c])
    return [(lo, hi, max(-(-c // sets), -(-w // words))) if lo == hi else (lo, hi, 1) for lo, hi, c, w in out]


def first_words(n: np.ndarray, lo: int, hi: int, least: float) -> tuple[np.ndarray, np.ndarray]:
    """For sets of ``n`` words, whether one of ``lo`` to ``hi`` words can be near, and how many first words that calls for."""
    smallest = np.maximum(lo, np.ceil(least * n - EPS))
    o = np.ceil(least / (1 + least) * (n + smallest) - EPS)
    return (smallest <= hi) & (least * lo <= n + EPS), np.minimum(n, n - o + MORE + n // EACH).astype(np.int64)


def shared_counts(one: np.ndarray, ends: np.ndarray, two: np.ndarray, owner: np.ndarray, n_two: int, most: int = MOST) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """Row of the first side, row of the second one and how many codes they share, in portions.

    ``one``: codes of the first side's rows, of which row i has those from ``ends[i]`` to ``ends[i + 1]``; ``two``: sorted
    codes of the second side, ``owner`` their rows.
    """
    lo = np.searchsorted(two, one, "left")
    c = np.searchsorted(two, one, "right") - lo
    total = np.r_[0, np.cumsum(c)]
    upto = total[ends]
    i = 0
    while i < len(ends) - 1:
        j = max(i + 1, int(np.searchsorted(upto, upto[i] + most, "right")) - 1)
        at, to = int(ends[i]), int(ends[j])
        if upto[j] - upto[i] > most:  # one row
            n = np.zeros(n_two, np.int64)
            while at < to:
                stop = min(to, max(at + 1, int(np.searchsorted(total, total[at] + most, "right")) - 1))
                n += np.bincount(owner[ranges(lo[at:stop], c[at:stop])], minlength=n_two)
                at = stop
            y = np.flatnonzero(n)
            yield np.full(len(y), i), y, n[y]
        elif upto[j] > upto[i]:
            row = np.repeat(np.arange(j - i), np.diff(ends[i : j + 1]))
            key = np.repeat(row * n_two, c[at:to]) + owner[ranges(lo[at:to], c[at:to])]
            key.sort()
            first = np.flatnonzero(np.r_[True, key[1:] != key[:-1]])
            yield key[first] // n_two + i, key[first] % n_two, np.diff(np.r_[first, len(key)])
        i = j


def ranges(lo: np.ndarray, c: np.ndarray) -> np.ndarray:
    """lo[0], lo[0] + 1, ... (c[0] of them), lo[1], ..."""
    return np.arange(c.sum()) + np.repeat(lo - np.cumsum(c) + c, c)


def flat(column: pa.Array | pa.ChunkedArray) -> tuple[np.ndarray, np.ndarray]:
    """The elements of a column of lists, and where each list begins, with the end of the last one."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    sizes = column.value_lengths().to_numpy(zero_copy_only=False)
    return column.flatten().to_numpy(zero_copy_only=False), np.r_[0, np.cumsum(sizes, dtype=np.int64)]


def word_order(sets: DataFrame) -> np.ndarray:
    """How many words of ``sets`` (words) are in each bucket: the upper bits of a word. A table of fixed size."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(1 << BITS, np.int64)
        for b in batches:
            total += np.bincount((flat(b.column(0))[0].view(np.uint64) >> np.uint64(64 - BITS)).astype(np.int64), minlength=1 << BITS)
        at = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(at), pa.array(total[at])], names=["bucket", "n"])

    found = sets.select("words").mapInArrow(count, "bucket long, n long").groupBy("bucket").agg(F.sum("n").alias("n")).toArrow()
    out = np.zeros(1 << BITS, np.int64)
    out[found.column("bucket").to_numpy()] = found.column("n").to_numpy()
    return out


def near_sets(sets: DataFrame, least: float, cut: dict | None = None, most: int = MOST, small: int = 200_000) -> DataFrame:
    """a, b (ids, a < b as numbers of ``key``), both (shared words), n, m (words of each) of all pairs with a Jaccard similarity of ``least`` or more.

    ``sets``: key (distinct), words (sorted, distinct 64-bit numbers, at least one); read several times. ``cut``: other
    limits for ``cut_sizes``. Up to ``small`` rows of what is to be checked are broadcast; more are shuffled.
    """
    spark = sets.sparkSession
    ship_code(spark)
    context = spark.sparkContext
    counts = sorted((r[0], r[1]) for r in sets.groupBy(F.size("words").alias("n")).agg(F.count(F.lit(1)).alias("c")).collect())  # a row for each size
    runs = cut_sizes(counts, **(cut or {}))
    held = context.broadcast((word_order(sets), runs))
    share = least / (1 + least)

    def send(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        weight, runs = held.value
        copies = np.array([r[2] for r in runs])
        base = np.cumsum(copies) - copies
        blocks = int(copies.sum())
        for whole in batches:
            for b in (whole.slice(x, 2000) for x in range(0, whole.num_rows, 2000)):
                key = b.column(0).to_numpy(zero_copy_only=False)
                words, ends = flat(b.column(1))
                n = np.diff(ends)
                row = np.repeat(np.arange(len(n)), n)
                w = weight[(words.view(np.uint64) >> np.uint64(64 - BITS)).astype(np.int64)]
                order = np.lexsort((words, w, row))
                code, place = words[order].astype(np.int32), np.arange(len(row)) - ends[row]  # collisions only add to counts
                again = w[order] > 1  # a word alone in its bucket is in no other set
                run = np.searchsorted([r[1] for r in runs], n)
                own = base[run] + key.view(np.uint64).astype(object) % copies[run] if (copies > 1).any() else base[run]
                own = own.astype(np.int64)
                for other, (lo, hi, k) in enumerate(runs):
                    fits, first = first_words(n, lo, hi, least)
                    some = np.flatnonzero(fits)
                    if not len(some):
                        continue
                    keep = again & fits[row] & (place < first[row])
                    sizes = np.bincount(row[keep], minlength=len(n))[some]
                    codes = pa.ListArray.from_arrays(pa.array(np.r_[0, np.cumsum(sizes)].astype(np.int32)), pa.array(code[keep]))
                    for to in range(base[other], base[other] + k):
                        part = np.minimum(own[some], to) * blocks + np.maximum(own[some], to)
                        yield pa.RecordBatch.from_arrays([pa.array(part), pa.array((own[some] > to).astype(np.int32)), pa.array(key[some]), pa.array(n[some]), pa.array((n - first)[some]), codes], names=["part", "side", "key", "n", "rest", "codes"])

    def meet(table: pa.Table) -> pa.Table:
        side = table.column("side").to_numpy()
        blocks = sum(r[2] for r in held.value[1])
        part = table.column("part")[0].as_py()
        alone = part // blocks == part % blocks
        left, right = (table, table) if alone else (table.filter(pa.array(side == 0)), table.filter(pa.array(side == 1)))
        out = []
        if left.num_rows and right.num_rows:
            one, ends = flat(left.column("codes"))
            two, begin = flat(right.column("codes"))
            owner = np.repeat(np.arange(right.num_rows), np.diff(begin))
            order = np.argsort(two, kind="stable")
            k, n, r = (left.column(c).to_numpy() for c in ("key", "n", "rest"))
            l, m, s = (right.column(c).to_numpy() for c in ("key", "n", "rest"))
            for x, y, c in shared_counts(one, ends, two[order], owner[order], right.num_rows, most):
                need = np.ceil(share * (n[x] + m[y]) - EPS) - np.maximum(r[x], s[y])
                ok = (c >= need) & (np.minimum(n[x], m[y]) >= least * np.maximum(n[x], m[y]) - EPS)
                if alone:
                    ok &= x < y
                out.append((k[x[ok]], l[y[ok]]))
        x, y = (np.concatenate([o[i] for o in out]) if out else np.zeros(0, np.int64) for i in range(2))
        return pa.table({"a": np.minimum(x, y), "b": np.maximum(x, y)})

    sent = sets.select("key", "words").mapInArrow(send, "part long, side int, key long, n long, rest long, codes array<int>")
    pairs = materialize(sent.groupBy("part").applyInArrow(meet, "a long, b long"), "likely")

    ids = pairs.select(F.col("a").alias("key")).union(pairs.select("b")).distinct()
    n = ids.count()
    ways = max(4, -(-n // 4096))
    cell = lambda c: F.expr(f"pmod(xxhash64({c}, 3), {ways})")
    dealt = pairs.select("a", "b", (cell("a") * ways + cell("b")).alias("cell"))
    wanted = dealt.select("cell", F.col("a").alias("key")).union(dealt.select("cell", "b")).distinct()
    wanted = materialize(wanted, "wanted")
    full = sets.select("key", "words").join(F.broadcast(wanted) if n <= small and wanted.count() <= small else wanted, "key")

    def check(likely: pa.Table, full: pa.Table) -> pa.Table:
        words, ends = flat(full.column("words"))
        place = {k: i for i, k in enumerate(full.column("key").to_pylist())}
        rows = []
        for a, b in zip(likely.column("a").to_pylist(), likely.column("b").to_pylist(), strict=True):
            x, y = (words[ends[place[k]] : ends[place[k] + 1]] for k in (a, b))
            both = np.sort(np.concatenate([x, y]))
            i = int((both[1:] == both[:-1]).sum())
            if i / (len(x) + len(y) - i) >= least:
                rows.append((a, b, i, len(x), len(y)))
        columns = list(zip(*rows, strict=True)) if rows else [()] * 5
        return pa.table({c: pa.array(v, pa.int64()) for c, v in zip(("a", "b", "both", "n", "m"), columns, strict=True)})

    return dealt.groupBy("cell").cogroup(full.groupBy("cell")).applyInArrow(check, "a long, b long, both long, n long, m long")
