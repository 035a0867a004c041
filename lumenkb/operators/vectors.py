"""Near pairs of vectors without meeting all pairs, and nearest sections rolled up to their notes."""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lumenkb.operators.search import ranked, vector_search
from lumenkb.session import materialize, ship_code

#: Cosines above it make duplicates (fixed value).
DUPLICATE = 0.88
#: At most so many pivots of a dimension, chosen from so many vectors (in the order of a hash of their ids).
PIVOTS, SAMPLE = 256, 4096
#: Vectors on a side of a block that one task compares, of up to WIDTH components; of longer ones as many as take the same memory.
CAP, WIDTH = 4096, 64
#: Rows of vectors that are handed on at once, and rows of products that are held at once.
SEND, HELD = 8192, 512
#: What rounding may do to a bound.
SLACK = 1e-9


def unit_vectors(vectors: DataFrame) -> DataFrame:
    """id, v, u: rows of ``vectors`` (id, v) with a length that isn't zero and only finite components, and their unit vectors."""
    rows = vectors.select(F.col("id").cast("long").alias("id"), F.col("v").cast("array<double>").alias("v")).where("id is not null and v is not null")
    rows = rows.withColumn("_n", F.sqrt(F.aggregate("v", F.lit(0.0), lambda s, x: s + x * x)))
    good = F.forall("v", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < F.lit(float("inf"))))
    return rows.where(good & (F.col("_n") > 0) & (F.col("_n") < F.lit(float("inf")))).select("id", "v", F.transform("v", lambda x: x / F.col("_n")).alias("u"))


def vector_classes(units: DataFrame) -> DataFrame:
    """id, rep, size, u: vectors of equal components (told by 128 bits) are a class, named after its smallest id."""
    keyed = units.select("id", "u", F.xxhash64("v").alias("k1"), F.xxhash64(F.lit(7), "v").alias("k2"))
    first = materialize(keyed.groupBy("k1", "k2").agg(F.min("id").alias("rep"), F.count(F.lit(1)).alias("size")), "vector-classes")
    return keyed.join(first, ["k1", "k2"]).select("id", "rep", "size", "u")


def spread_pivots(sample: np.ndarray, most: int, theta: float) -> np.ndarray:
    """Of the sample, each next pivot the farthest from all before it, until every vector is within the angle of one."""
    if not len(sample):
        return sample
    chosen, near = [0], sample @ sample[0]
    while len(chosen) < most and near.min() < np.cos(theta):
        chosen.append(int(near.argmin()))
        near = np.maximum(near, sample @ sample[chosen[-1]])
    return sample[chosen]


def _by_dim(pdf: pd.DataFrame) -> Iterator[tuple[int, pd.DataFrame, np.ndarray]]:
    for dim, part in pdf.groupby(pdf["u"].map(len)):
        yield dim, part, np.stack(part["u"].to_list())


def _reach(dots: np.ndarray, home: np.ndarray, apart: np.ndarray, least: np.ndarray, threshold: float, bundle: np.ndarray | None = None) -> np.ndarray:
    """Which bundles of cells each vector must be sent to: those that answer for a pair with its own and can hold a vector above the threshold.

    ``bundle``: the bundle of each cell; without it a cell is one. Of two bundles the larger one answers if their
    numbers' sum is odd, else the smaller one. A cell can't hold such a vector if the plane between the two pivots is
    farther than the threshold allows, nor if its pivot is farther than its least member's angle and the threshold's
    together.
    """
    bundle = np.arange(dots.shape[1]) if bundle is None else bundle
    near_plane = dots[np.arange(len(home)), home][:, None] - dots <= np.sqrt(2 - 2 * threshold) * apart[home] + SLACK
    within = np.arccos(np.clip(dots, -1, 1)) <= np.arccos(np.clip(least, -1, 1)) + np.arccos(threshold) + SLACK
    can = np.zeros((len(home), int(bundle.max()) + 1), bool)
    row, cell = np.nonzero(near_plane & within)
    can[row, bundle[cell]] = True
    number, own = np.arange(can.shape[1]), bundle[home][:, None]
    return can & np.where((number + own) % 2 == 1, number > own, number < own)


def bundled(n: np.ndarray, pivots: np.ndarray, cap: int) -> np.ndarray:
    """The bundle of each cell: cells whose pivots are near each other, of at most ``cap`` residents (``n`` of each) but for a cell that has more."""
    bundle, left, number = np.full(len(n), -1), np.ones(len(n), bool), 0
    while left.any():
        at = int(np.argmax(np.where(left, n, -1)))
        total = 0
        for c in np.argsort(np.where(left, -(pivots @ pivots[at]), np.inf), kind="stable")[: left.sum()].tolist():
            if not total or total + n[c] <= cap:
                bundle[c], left[c] = number, False
                total += n[c]
        number += 1
    return bundle


def near_pairs(units: DataFrame, threshold: float = DUPLICATE, pivots: int = PIVOTS, cap: int = CAP) -> DataFrame:
    """a, b (a < b), score: all pairs of ``units`` (id, u; ids are distinct) with a cosine above ``threshold``, each once.

    Each vector's home is its nearest pivot's cell, and cells near each other are a bundle. A vector visits the other
    bundles that may hold a partner of it, which the angles to the pivots of their cells tell without a loss. A bundle
    compares its residents with each other and with its visitors, in blocks of at most ``cap`` on a side. Clustered
    vectors visit few bundles; where there are no clusters at all, none can be told apart and all pairs are compared, still
    in bounded blocks, and a vector is sent only as often as there are blocks of others. Vectors of different dimensions
    aren't compared. Thresholds are above 0.
    """
    spark = units.sparkSession
    ship_code(spark)
    context = spark.sparkContext
    theta = float(np.arccos(threshold))
    sample = units.select("id", "u").orderBy(F.xxhash64("id"), "id").limit(SAMPLE).toPandas()
    chosen = {dim: spread_pivots(m, pivots, theta) for dim, _, m in _by_dim(sample)} if len(sample) else {}
    held = context.broadcast(chosen)

    def settle(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            for dim, part, m in _by_dim(pdf):
                p = held.value.get(dim, np.zeros((1, dim)))  # a dimension outside the sample is one cell
                dots = m @ p.T
                yield part.assign(dim=dim, home=dots.argmax(axis=1), near=dots.max(axis=1))[["id", "u", "dim", "home", "near"]]

    homes = materialize(units.select("id", "u").mapInPandas(settle, "id long, u array<double>, dim int, home int, near double"), "homes")
    room = lambda dim: max(1, cap * WIDTH // max(dim, WIDTH))
    least: dict[int, np.ndarray] = {d: np.ones(len(p)) for d, p in chosen.items()}
    settled: dict[int, np.ndarray] = {d: np.zeros(len(p), np.int64) for d, p in chosen.items()}
    for dim, home, near, n in homes.groupBy("dim", "home").agg(F.min("near"), F.count(F.lit(1))).collect():  # at most a row for each pivot
        least.setdefault(dim, np.ones(1))[home] = near
        settled.setdefault(dim, np.zeros(1, np.int64))[home] = n
    bundles = {dim: bundled(n, chosen.get(dim, np.zeros((1, 1))), room(dim)) for dim, n in settled.items()}
    rooms = {(dim, int(b)): -(-int(settled[dim][of == b].sum()) // room(dim)) for dim, of in bundles.items() for b in range(of.max() + 1)}
    bounds = context.broadcast((least, bundles))

    def visits(dim: int, m: np.ndarray, home: np.ndarray) -> np.ndarray:
        p = held.value.get(dim, np.zeros((1, dim)))
        apart = np.sqrt(np.maximum(2 - 2 * (p @ p.T), 0)) if len(p) > 1 else np.zeros((1, 1))
        return _reach(m @ p.T, home, apart, bounds.value[0][dim], threshold, bounds.value[1][dim])

    def slices(batches: Iterator[pd.DataFrame]) -> Iterator[tuple[int, pd.DataFrame, np.ndarray]]:
        for pdf in batches:
            for lo in range(0, len(pdf), 1024):
                yield from _by_dim(pdf.iloc[lo : lo + 1024])

    def count(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for dim, part, m in slices(batches):
            n = visits(dim, m, part["home"].to_numpy()).sum(axis=0)
            yield pd.DataFrame({"dim": dim, "cell": np.arange(len(n)), "n": n})

    visitors = {(dim, cell): -(-n // room(dim)) for dim, cell, n in homes.mapInPandas(count, "dim int, cell int, n long").groupBy("dim", "cell").agg(F.sum("n")).collect()}
    parts = context.broadcast((rooms, visitors))

    def deal(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        """A row for each block of a vector: dim, bundle, first and second chunk (-1 - chunk for one of visitors), side."""
        rooms, others = parts.value
        for dim, part, m in slices(batches):
            home, ids, us = part["home"].to_numpy(), part["id"].to_numpy(), part["u"].to_list()
            own = bounds.value[1][dim][home]
            can = visits(dim, m, home)
            mix = (ids.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(33)
            out = []
            for i, cell in enumerate(own.tolist()):
                c = int(mix[i]) % rooms[dim, cell]
                out += [(dim, cell, min(c, x), max(c, x), int(x < c), ids[i], us[i]) for x in range(rooms[dim, cell])]
                out += [(dim, cell, -1 - x, c, 1, ids[i], us[i]) for x in range(others.get((dim, cell), 0))]
                for cell in np.flatnonzero(can[i]).tolist():
                    out += [(dim, cell, -1 - int(mix[i]) % max(others[dim, cell], 1), x, 0, ids[i], us[i]) for x in range(rooms[dim, cell])]
                # handed on in portions: a vector goes to many blocks where there are no clusters
                if len(out) >= SEND:
                    yield pd.DataFrame(out, columns=["dim", "cell", "i", "j", "side", "id", "u"])
                    out = []
            if out:
                yield pd.DataFrame(out, columns=["dim", "cell", "i", "j", "side", "id", "u"])

    def compare(pdf: pd.DataFrame) -> pd.DataFrame:
        alone = pdf["i"].iloc[0] == pdf["j"].iloc[0]
        left, right = (pdf, pdf) if alone else (pdf[pdf["side"] == 0], pdf[pdf["side"] == 1])
        if not len(left) or not len(right):
            return pd.DataFrame({"a": [], "b": [], "score": []})
        one, two = (np.stack(x["u"].to_list()) for x in (left, right))
        found = []
        for lo in range(0, len(one), HELD):
            dots = one[lo : lo + HELD] @ two.T
            x, y = np.nonzero(np.triu(dots, 1 + lo) > threshold if alone else dots > threshold)
            found.append((x + lo, y, dots[x, y]))
        x, y, score = (np.concatenate(z) for z in zip(*found, strict=True))
        a, b = left["id"].to_numpy()[x], right["id"].to_numpy()[y]
        return pd.DataFrame({"a": np.minimum(a, b), "b": np.maximum(a, b), "score": score})

    blocks = homes.mapInPandas(deal, "dim int, cell int, i int, j int, side int, id long, u array<double>")
    return blocks.groupBy("dim", "cell", "i", "j").applyInPandas(compare, "a long, b long, score double")


def cosine_duplicates(vectors: DataFrame, superseded: DataFrame, threshold: float = DUPLICATE) -> DataFrame:
    """a, b, score, kind of duplicates among ``vectors`` (id, v; ids are distinct), but for pairs of which one supersedes the other (``superseded``: a, b).

    Equal vectors are a class, so that copies never make all their pairs. kind cosine: two classes by their first ids,
    unless each pair between them is superseded. kind copy: a class's first id and another one of it, unless that one
    has a supersession with all others of the class. Ids without a usable vector take no part.
    """
    members = materialize(vector_classes(unit_vectors(vectors)), "vector-members")
    pairs = near_pairs(members.where("id = rep").select("id", "u"), threshold)
    held = members.select("id", "rep", "size")
    known = superseded.where("a <> b").select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct()
    for side in ("a", "b"):
        known = known.join(held.select(F.col("id").alias(side), F.col("rep").alias(f"{side}_rep"), F.col("size").alias(f"{side}_size")), side)
    known = materialize(known, "superseded")

    between = known.where("a_rep <> b_rep").groupBy(F.least("a_rep", "b_rep").alias("a"), F.greatest("a_rep", "b_rep").alias("b"))
    between = between.agg(F.count(F.lit(1)).alias("m"), F.first(F.col("a_size") * F.col("b_size")).alias("of")).where("m = of")
    classes = pairs.join(between, ["a", "b"], "left_anti").select("a", "b", "score", F.lit("cosine").alias("kind"))

    inside = known.where("a_rep = b_rep").select(F.explode(F.array("a", "b")).alias("id")).groupBy("id").agg(F.count(F.lit(1)).alias("m"))
    copies = held.where("id <> rep").join(inside, "id", "left").where("coalesce(m, 0) < size - 1")
    return classes.unionByName(copies.select(F.col("rep").alias("a"), F.col("id").alias("b"), F.lit(1.0).alias("score"), F.lit("copy").alias("kind")))


def section_search(sections: DataFrame, queries: DataFrame, pool: int, most: int = 4096) -> DataFrame:
    """query_id, doc_id, rank, section_id, section_rank, distance: notes by their nearest section.

    ``sections``: section_id, doc_id, v. ``queries``: query_id, v. Each query takes its min(5 * pool, most) nearest
    sections, ties to the smaller section_id; a note stands where its first section does, and the first ``pool`` of them
    count. section_rank is the section's own place.
    """
    near = vector_search(sections.select(F.col("section_id").alias("doc_id"), "v"), queries, min(5 * pool, most))
    near = near.select("query_id", F.col("doc_id").alias("section_id"), F.col("rank").alias("section_rank"), "distance").join(sections.select("section_id", "doc_id"), "section_id")
    first = near.groupBy("query_id", "doc_id").agg(F.min(F.struct("section_rank", "section_id", "distance")).alias("x"))
    return ranked(first.select("query_id", "doc_id", "x.*"), [F.col("section_rank")], pool).select("query_id", "doc_id", "rank", "section_id", "section_rank", "distance")


def pending_sections(sections: DataFrame, store: DataFrame, most: int | None = None) -> DataFrame:
    """``sections`` (doc_id, ord, text_hash, ...) that wait to be embedded: without a row in ``store`` (doc_id, ord, text_hash), or changed since.

    ``most`` is a run's budget: the first so many by doc_id and ord.
    """
    known = store.select("doc_id", "ord", F.col("text_hash").alias("_was"))
    rows = sections.join(known, ["doc_id", "ord"], "left").where(F.col("_was").isNull() | (F.col("_was") != F.col("text_hash"))).drop("_was")
    return rows if most is None else rows.orderBy("doc_id", "ord").limit(most)


def embed_pending(sections: DataFrame, store: DataFrame, embed: Column, most: int | None = None) -> tuple[DataFrame, DataFrame]:
    """The next ``store`` (doc_id, ord, text_hash, v), and metric, value: how many were embedded, reused and deleted, and are pending.

    ``embed`` is the vector of a section as a column over ``sections``; it is computed for waiting sections only. Rows of
    sections that are gone go; a changed section beyond the budget keeps its old vector, and its hash shows that it waits.
    """
    now = materialize(pending_sections(sections, store, most).select("doc_id", "ord", "text_hash", embed.alias("v")), "embedded")
    kept = store.join(sections.select("doc_id", "ord"), ["doc_id", "ord"], "left_semi").join(now.select("doc_id", "ord"), ["doc_id", "ord"], "left_anti")
    after = materialize(kept.select("doc_id", "ord", "text_hash", "v").unionByName(now), "section-store")
    gone = store.join(sections.select("doc_id", "ord"), ["doc_id", "ord"], "left_anti")
    counts = {"embedded": now, "reused": kept, "deleted": gone, "pending": pending_sections(sections, after)}
    rows = [df.agg(F.count(F.lit(1)).alias("value")).select(F.lit(name).alias("metric"), "value") for name, df in counts.items()]
    return after, reduce(DataFrame.unionByName, rows)
