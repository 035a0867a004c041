"""Operator 2: n-gram Jaccard join by chosen paths.

Documents are sets of five-word shingles; equal sets are one node with its number of copies. Each run splits all nodes
on a token sampled from each set (the one with the smallest hash under the run's seed, so that similar sets sample
the same token with the probability of their similarity). A bucket of at most ``leaf`` nodes is a leaf. A larger one
is split again, twice over, on tokens sampled under seeds of its own, and so on to depth ``DEPTH``, where buckets are
leaves of any size. Leaves are searched by brute force, large ones in chunks against chunks. Runs are repeated as
often as the target recall asks for at the least similarity that counts.

A pair is told only in the first leaf that its two nodes share, so each node can count its links where they are found;
no list of pairs is made. A leaf emits the links that connect it, and the counts.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lumenkb.llm.components import components
from lumenkb.llm.pairs import Forest, deal, listed
from lumenkb.llm.shingles import shingle_set, signature
from lumenkb.session import materialize, ship_code

TEXT_KEY = "xxhash64(cast(text as string))"
DEPTH = 3
BRANCHES = 2


def runs_for(similarity: float, recall: float) -> int:
    """Runs after which a pair at the threshold has met with the probability ``recall``, were every leaf at full depth."""
    below = 1.0
    for _ in range(DEPTH - 1):
        below = 1 - (1 - similarity * below) ** BRANCHES
    return math.ceil(math.log(1 - recall) / math.log(1 - similarity * below))


#: Splits that one run may sample for: the coordinate of a split is its run's first, plus its place among them.
SPLITS = sum(BRANCHES**d for d in range(DEPTH))


def set_table(docs: DataFrame) -> DataFrame:
    """doc_id, text_key, h1, h2 (of the shingle set; null without one), n and sig of each document."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            h1, h2, size, sig = [], [], [], []
            for text in pdf["text"]:
                s = shingle_set(text)
                size.append(len(s))
                a, b = np.frombuffer(xxhash.xxh3_128_digest(s.tobytes()), np.int64)
                h1.append(int(a) if len(s) else None), h2.append(int(b) if len(s) else None)
                sig.append(signature(s).tobytes() if len(s) else None)
            yield pd.DataFrame({"doc_id": pdf["doc_id"].astype("Int64"), "text_key": pdf["text_key"], "h1": pd.array(h1, "Int64"), "h2": pd.array(h2, "Int64"), "n": np.array(size, np.int64), "sig": pd.Series(sig, dtype=object)})

    return docs.select(F.col("doc_id").cast("long"), F.expr(TEXT_KEY).alias("text_key"), F.col("text").cast("string")).mapInPandas(run, "doc_id long, text_key long, h1 long, h2 long, n long, sig binary")


def leaves(nodes: DataFrame, runs: int, leaf: int) -> DataFrame:
    """node, slot, bucket: the leaves of each node. ``slot`` orders the leaves of all nodes alike."""
    runs_of = F.explode(F.sequence(F.lit(0), F.lit(runs - 1)))
    token = F.expr(f"substring(sig, 4 * pmod(run * {SPLITS} + split, 64) + 1, 4)")  # the sampled token, four bytes of the signature
    level = nodes.select("node", "sig", runs_of.alias("run"), F.lit(0).alias("split")).withColumn("bucket", F.xxhash64("run", token))
    done = []
    for _ in range(DEPTH - 1):
        heavy = level.groupBy("bucket").agg(F.count(F.lit(1)).alias("size")).where(F.col("size") > leaf).select("bucket", F.lit(True).alias("heavy"))
        level = materialize(level.join(heavy, "bucket", "left"), "level")
        done.append(level.where(F.col("heavy").isNull()))
        branch = F.explode(F.sequence(F.lit(1), F.lit(BRANCHES)))
        level = level.where("heavy").select("node", "sig", "run", (F.col("split") * BRANCHES).alias("split"), F.col("bucket").alias("parent"), branch.alias("branch"))
        level = level.withColumn("split", F.col("split") + F.col("branch")).withColumn("bucket", F.xxhash64("parent", "split", token))
    out = level.select("node", "run", "split", "bucket")
    for x in done:
        out = out.unionByName(x.select("node", "run", "split", "bucket"))
    return out.select("node", (F.col("run") * SPLITS + F.col("split")).cast("int").alias("slot"), "bucket")


def _columns(pdf: pd.DataFrame) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    sig = np.frombuffer(b"".join(pdf["sig"]), np.uint32).reshape(len(pdf), -1)
    return sig, pdf["n"].to_numpy(), np.stack(pdf["path"].to_list()), pdf["slot"].to_numpy()


def _told_here(i: np.ndarray, j: np.ndarray, sig: np.ndarray, n: np.ndarray, path: np.ndarray, slot: np.ndarray, similarity: float, slack: float) -> tuple[np.ndarray, np.ndarray]:
    """Pairs whose sizes and signatures allow the similarity, and that share no earlier leaf."""
    keep = np.minimum(n[i], n[j]) >= similarity * np.maximum(n[i], n[j])
    i, j = i[keep], j[keep]
    keep = (sig[i] == sig[j]).sum(axis=1) >= (similarity - slack) * sig.shape[1]
    i, j = i[keep], j[keep]
    if not len(i):
        return i, j
    keep = np.argmax((path[i] == path[j]) & (path[i] != 0), axis=1) == slot[i]
    return i[keep], j[keep]


def overlaps(sets: list[np.ndarray], i: np.ndarray, j: np.ndarray, block: int = 8192) -> np.ndarray:
    """Sizes of the intersections of the sets at i and j, as bits of the elements that more than one set holds."""
    owner = np.repeat(np.arange(len(sets)), [len(x) for x in sets])
    _, code, count = np.unique(np.concatenate(sets), return_inverse=True, return_counts=True)
    shared = count > 1
    code, owner = (np.cumsum(shared) - 1)[code[shared[code]]], owner[shared[code]]
    both = np.zeros(len(i), np.int64)
    order = np.argsort(code, kind="stable")
    code, owner = code[order], owner[order]
    for lo in range(0, int(shared.sum()), block):
        a, b = np.searchsorted(code, [lo, lo + block])
        bits = np.zeros((len(sets), block), np.uint8)
        bits[owner[a:b], code[a:b] - lo] = 1
        packed = np.packbits(bits, axis=1).view(np.uint64)
        for k in range(0, len(i), 20_000):
            both[k : k + 20_000] += np.bitwise_count(packed[i[k : k + 20_000]] & packed[j[k : k + 20_000]]).sum(axis=1, dtype=np.int64)
    return both


def set_links(nodes: DataFrame, docs: DataFrame, similarity: float, recall: float, slack: float, leaf: int, cap: int, part_rows: int) -> DataFrame:
    """h1, h2, links, to1, to2: for each node counts of its links (to1 null; sum them), and links that connect groups (links 0).

    ``nodes``: h1, h2, n, sig, copies, text_key. ``docs``: text.
    """
    runs = runs_for(similarity, recall)
    slim = nodes.select(F.struct("h1", "h2").alias("node"), "sig")
    found = materialize(leaves(slim, runs, leaf), "leaves")
    parts = max(8, found.count() // part_rows)
    dealt = materialize(deal(found, "bucket", "node", cap, parts), "dealt")
    met = dealt.select("node").distinct()
    path = F.transform(F.sequence(F.lit(0), F.lit(runs * SPLITS - 1)), lambda s: F.coalesce(F.element_at("_m", s), F.lit(0)))
    paths = found.join(met, "node", "left_semi").groupBy("node").agg(F.map_from_entries(F.collect_list(F.struct("slot", "bucket"))).alias("_m")).select("node", path.alias("path"))
    about = nodes.select(F.struct("h1", "h2").alias("node"), "n", "sig", "copies").join(paths, "node")
    rows = dealt.join(about, "node").select("node.h1", "node.h2", "slot", "cell", "side", "part", "n", "sig", "copies", "path")

    def meet(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values(["cell", "side"], kind="stable")
        sig, n, path, slot = _columns(pdf)
        hit = np.zeros(len(pdf), bool)
        for i, j in listed(pdf["cell"].to_numpy(), pdf["side"].to_numpy(), 200_000):
            i, j = _told_here(i, j, sig, n, path, slot, similarity, slack)
            hit[i] = hit[j] = True
        return pdf[hit].drop(columns="part")

    schema = "h1 long, h2 long, slot int, cell long, side int, n long, sig binary, copies long, path array<long>"
    near = materialize(rows.groupBy("part").applyInPandas(meet, schema), "near")
    # a node's text is that of any of its rows, found by the 64-bit hash of the text
    wanted = nodes.join(near.select("h1", "h2").distinct(), ["h1", "h2"]).select("h1", "h2", "text_key")
    text = docs.select(F.expr(TEXT_KEY).alias("text_key"), F.col("text").cast("string").alias("text")).join(wanted, "text_key").dropDuplicates(["h1", "h2"])
    text = text.select("h1", "h2", "text")
    few = max(8, near.count() // 2000)
    full = near.join(text, ["h1", "h2"]).withColumn("part", F.expr(f"cast(pmod(xxhash64(cell), {few}) as int)"))

    def verify(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values(["cell", "side", "h1", "h2"], kind="stable")
        sig, n, path, slot = _columns(pdf)
        cell, copies, text = pdf["cell"].to_numpy(), pdf["copies"].to_numpy(), pdf["text"].to_list()
        links, groups, edges = np.zeros(len(pdf), np.int64), Forest(len(pdf)), []
        at = np.r_[np.flatnonzero(np.r_[True, cell[1:] != cell[:-1]]), len(cell)]
        for lo, hi in zip(at[:-1], at[1:], strict=True):
            pairs = [_told_here(i + lo, j + lo, sig, n, path, slot, similarity, slack) for i, j in listed(cell[lo:hi], pdf["side"].to_numpy()[lo:hi], 200_000)]
            if not sum(len(i) for i, _ in pairs):
                continue
            sets = [shingle_set(t) for t in text[lo:hi]]
            for i, j in pairs:
                both = overlaps(sets, i - lo, j - lo)
                linked = both >= similarity * (n[i] + n[j] - both) - 1e-9
                i, j = i[linked], j[linked]
                np.add.at(links, i, copies[j])
                np.add.at(links, j, copies[i])
                edges += [(x, y) for x, y in zip(i.tolist(), j.tolist(), strict=True) if groups.join(x, y)]
        h1, h2, some = pdf["h1"].to_numpy(), pdf["h2"].to_numpy(), np.flatnonzero(links)
        a, b = np.array(edges, np.int64).reshape(-1, 2).T
        to = [pd.array([*[None] * len(some), *h[b].tolist()], "Int64") for h in (h1, h2)]
        return pd.DataFrame({"h1": np.r_[h1[some], h1[a]], "h2": np.r_[h2[some], h2[a]], "links": np.r_[links[some], np.zeros(len(a), np.int64)], "to1": to[0], "to2": to[1]})

    return full.groupBy("part").applyInPandas(verify, "h1 long, h2 long, links long, to1 long, to2 long")


def jaccard_classes(docs: DataFrame, similarity: float = 0.8, recall: float = 0.9999, slack: float = 0.3, leaf: int = 256, cap: int = 512, part_rows: int = 50_000) -> DataFrame:
    """doc_id, class_id, n_links, class_key and text_key of each row of ``docs`` (doc_id, text; other columns are ignored).

    Links join documents whose sets of five-word shingles have a Jaccard similarity of ``similarity`` or more; classes
    are the connected groups, named by their smallest doc_id. n_links counts the other rows linked to a row, copies
    included. A text of fewer than five words has one shingle; null texts and texts without words link to nothing and
    are classes of their own. Rows that repeat a doc_id count each; null doc_ids never name a class unless it has no
    other. ``slack``: how far below the threshold a 64-coordinate estimate may lie before a pair is not checked; 0.3
    are six standard deviations. An empty table gives no rows.
    """
    ship_code(docs.sparkSession)
    sets = materialize(set_table(docs), "sets")
    nodes = sets.where(F.col("h1").isNotNull()).groupBy("h1", "h2").agg(F.first("n").alias("n"), F.first("sig").alias("sig"), F.count(F.lit(1)).alias("copies"), F.min("doc_id").alias("low"), F.min("text_key").alias("text_key"))
    nodes = materialize(nodes, "nodes")
    links = materialize(set_links(nodes, docs, similarity, recall, slack, leaf, cap, part_rows), "links")
    at = lambda a, b: F.concat_ws(":", F.hex(a), F.hex(b))
    roots = components(links.where(F.col("to1").isNotNull()).select(at("h1", "h2").alias("a"), at("to1", "to2").alias("b")))
    counted = links.groupBy("h1", "h2").agg(F.sum("links").alias("links"))
    grouped = nodes.select(at("h1", "h2").alias("node"), "h1", "h2", "low").join(roots, "node")
    lows = grouped.groupBy("root").agg(F.min("low").alias("class_low"))
    named = grouped.join(lows, "root").select("h1", "h2", "class_low", "root")
    about = nodes.select("h1", "h2", "copies", "low").join(counted, ["h1", "h2"], "left").join(named, ["h1", "h2"], "left")
    out = sets.select("doc_id", "text_key", "h1", "h2").join(about, ["h1", "h2"], "left")
    return out.select(
        "doc_id",
        F.coalesce("class_low", "low", "doc_id").alias("class_id"),
        (F.coalesce("links", F.lit(0)) + F.coalesce("copies", F.lit(1)) - 1).cast("long").alias("n_links"),
        F.when(F.col("h1").isNotNull(), F.coalesce("root", at("h1", "h2"))).alias("class_key"),
        "text_key",
    )


def one_of_each(docs: DataFrame, **options) -> DataFrame:
    """The rows of ``docs`` (any columns besides doc_id and text) one of each class: that of the smallest doc_id, null ones last.

    Rows equal in doc_id and text are one. Rows without words all stay, but for such copies.
    """
    classes = jaccard_classes(docs, **options)
    own = F.struct(F.col("doc_id").isNull().alias("last"), "doc_id", "text_key")
    first = classes.where(F.col("class_key").isNotNull()).groupBy("class_key").agg(F.min(own).alias("first")).select("first.doc_id", "first.text_key")
    kept = first.union(classes.where(F.col("class_key").isNull()).select("doc_id", "text_key")).distinct()
    kept = kept.select(F.col("doc_id").alias("_id"), F.col("text_key").alias("_key"))
    rows = docs.withColumn("_text", F.expr(TEXT_KEY))
    rows = rows.join(kept, F.col("doc_id").cast("long").eqNullSafe(F.col("_id")) & (F.col("_text") == F.col("_key")), "left_semi")
    return rows.dropDuplicates(["doc_id", "_text"]).drop("_text")
