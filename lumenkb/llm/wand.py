"""Operator 11: ranked lexical search by WAND over document shards.

One pass over the texts writes shards: the posting lists, over a bounded number of documents, of the terms that the
items ask for, with what the corpus counts need. Once these are summed, each shard turns its postings into impacts (what
one occurrence of a term in an item adds to a document's score) and keeps each term's largest. An item's lists are then
walked by WAND: heads sorted by document, a pivot where the largest impacts up to it reach the heap's threshold, and
every head before the pivot jumps to it, so documents that can't beat the threshold are never scored. A task carries an
item's heap from shard to shard, and a window merges the tasks' heaps.
"""

from __future__ import annotations

import re
from array import array
from bisect import bisect_left
from collections import Counter
from collections.abc import Iterator
from functools import reduce
from heapq import heappush, heapreplace

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from lumenkb.session import materialize, ship_code

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
TERM = r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+"
#: The same over the bytes of UTF-8: all bytes of other characters than ASCII belong to terms.
TERM_BYTES = re.compile(rb"[0-9A-Za-z\x80-\xff]+")
LOWER_BYTES = bytes.maketrans(UPPER.encode(), LOWER.encode())
#: A shard is full with so many documents or postings, whichever comes first.
SHARD_DOCS, SHARD_POSTINGS = 1 << 15, 1 << 20
#: Terms of items that are broadcast at once; beyond it items go in blocks.
MOST_TERMS = 400_000

SHARD = "n_docs long, n_terms long, terms array<int>, dfs array<int>, ids binary, nulls int, lengths binary, docs binary, tfs binary"


class Shard:
    """The documents and postings that go to one row."""

    def __init__(self) -> None:
        self.n_docs = self.n_terms = self.postings = 0
        self.ids: list[int | None] = []
        self.lengths: list[int] = []
        self.lists: dict[int, tuple[array, array]] = {}

    def add(self, doc_id: int | None, n: int, counts: Counter) -> None:
        self.n_docs, self.n_terms = self.n_docs + 1, self.n_terms + n
        if counts:
            at = len(self.ids)
            self.ids.append(doc_id)
            self.lengths.append(n)
            self.postings += len(counts)
            for term, tf in counts.items():
                docs, tfs = self.lists.setdefault(term, (array("i"), array("i")))
                docs.append(at)
                tfs.append(tf)

    def row(self) -> list:
        """With documents in the order of their ids, null ones last, and lists in the order of documents."""
        order = sorted(range(len(self.ids)), key=lambda i: (self.ids[i] is None, self.ids[i] or 0))
        place = np.empty(len(order), np.int32)
        place[order] = np.arange(len(order), dtype=np.int32)
        terms, docs, tfs = sorted(self.lists), [], []
        for t in terms:
            d = place[np.frombuffer(self.lists[t][0], np.int32)]
            by = np.argsort(d)
            docs.append(d[by])
            tfs.append(np.frombuffer(self.lists[t][1], np.int32)[by])
        join = lambda x: np.concatenate(x).tobytes() if x else b""
        ids = np.array([self.ids[i] or 0 for i in order], np.int64).tobytes()
        lengths = np.array([self.lengths[i] for i in order], np.int64).tobytes()
        return [self.n_docs, self.n_terms, terms, [len(d) for d in docs], ids, sum(x is None for x in self.ids), lengths, join(docs), join(tfs)]


def _build(held, shard_docs: int, shard_postings: int):
    names = [x.split()[0] for x in SHARD.split(", ")]
    kinds = [pa.int64(), pa.int64(), pa.list_(pa.int32()), pa.list_(pa.int32()), pa.binary(), pa.int32(), pa.binary(), pa.binary(), pa.binary()]
    batch = lambda row: pa.RecordBatch.from_arrays([pa.array([x], k) for x, k in zip(row, kinds, strict=True)], names)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        number, shard = held.value.get, Shard()
        for rows in batches:
            for doc_id, text in zip(rows.column(0).to_pylist(), rows.column(1), strict=True):
                words = TERM_BYTES.findall(text.as_buffer().to_pybytes().translate(LOWER_BYTES))
                if words:
                    counts = Counter(map(number, words))
                    counts.pop(None, None)
                    shard.add(doc_id, len(words), counts)
                if len(shard.ids) >= shard_docs or shard.postings >= shard_postings:
                    yield batch(shard.row())
                    shard = Shard()
        if shard.n_docs:
            yield batch(shard.row())

    return run


class Lists:
    """A shard's postings as impacts, for the terms of one item after another."""

    def __init__(self, row: dict, weights: np.ndarray, n_docs: int, n_terms: int):
        ids = np.frombuffer(row["ids"], np.int64).tolist()
        self.ids: list[int | None] = ids[: len(ids) - row["nulls"]] + [None] * row["nulls"]
        m = 100 - 75 + (75 * np.frombuffer(row["lengths"], np.int64) * n_docs) // n_terms
        docs, tfs = np.frombuffer(row["docs"], np.int32), np.frombuffer(row["tfs"], np.int32).astype(np.int64)
        gain = (1_000_000_000 * tfs) // (1000 * tfs + 8 * m[docs])
        self.lists = {}
        lo = 0
        for term, df in zip(row["terms"], row["dfs"], strict=True):
            impacts = weights[term] * gain[lo : lo + df]
            if most := int(impacts.max()):
                self.lists[term] = array("i", docs[lo : lo + df].tobytes()), array("q", impacts.tobytes()), most
            lo += df

    def search(self, asked: list[tuple[int, int]], k: int, heap: list) -> None:
        """Put the shard's best documents for an item's (term, times) into its ``heap`` of (score, has an id, -id), at most k."""
        lists = [(*self.lists[t], times) for t, times in asked if t in self.lists]
        size = len(lists)
        bounds = [most * times for _, _, most, times in lists]
        at = [0] * size
        # a head is a list's next document, with the list's number in the same integer
        heads = sorted(docs[0] * size + i for i, (docs, _, _, _) in enumerate(lists))
        while heads:
            floor = heap[0][0] if len(heap) == k else 1
            reach = 0
            for head in heads:
                reach += bounds[head % size]
                if reach >= floor:
                    break
            else:
                return
            pivot = head // size
            moved = []
            if heads[0] // size == pivot:
                n, score = bisect_left(heads, (pivot + 1) * size), 0
                for head in heads[:n]:
                    i = head % size
                    docs, impacts, _, times = lists[i]
                    score += impacts[at[i]] * times
                    at[i] += 1
                    if at[i] < len(docs):
                        moved.append(docs[at[i]] * size + i)
                doc_id = self.ids[pivot]
                found = (score, doc_id is not None, -(doc_id or 0))
                if len(heap) < k:
                    heappush(heap, found)
                elif found > heap[0]:
                    heapreplace(heap, found)
            else:
                n = bisect_left(heads, pivot * size)
                for head in heads[:n]:
                    i = head % size
                    docs = lists[i][0]
                    at[i] = bisect_left(docs, pivot, at[i] + 1)
                    if at[i] < len(docs):
                        moved.append(docs[at[i]] * size + i)
            heads[:n] = moved
            heads.sort()


def _search(held, k: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        items, weights, n_docs, n_terms = held.value
        heaps: list[list] = [[] for _ in items]
        for batch in batches:
            for i in range(batch.num_rows):
                lists = Lists(batch.slice(i, 1).to_pylist()[0], weights, n_docs, n_terms)
                for (_, asked), heap in zip(items, heaps, strict=True):
                    lists.search(asked, k, heap)
        rows = [(item, -doc if has else None, score) for (item, _), heap in zip(items, heaps, strict=True) for score, has, doc in heap]
        if rows:
            yield pa.RecordBatch.from_arrays([pa.array(x, pa.int64()) for x in zip(*rows, strict=True)], ["item_id", "doc_id", "score"])

    return run


def lexical_top_k(docs: DataFrame, items: DataFrame, k: int = 10, most_terms: int = MOST_TERMS, shard_docs: int = SHARD_DOCS, shard_postings: int = SHARD_POSTINGS) -> DataFrame:
    """item_id, rank (from 1), doc_id, score: each item's k highest-scoring documents with a score above 0, ties by doc_id.

    ``docs``: doc_id, text. ``items``: item_id, text. Other columns are ignored. Terms are runs of ASCII letters and
    digits and of all other characters beyond ASCII, with A-Z in lower case. Counts are over all documents that have a
    term. Null and empty texts have none: they are neither counted nor found, and such items get no rows. Rows that repeat
    an item_id (or have none) are one item with the terms of all; rows that repeat a doc_id are a document each. A null
    doc_id comes after all others among equal scores. An empty table on either side gives no rows.
    """
    spark = docs.sparkSession
    words = F.regexp_extract_all(F.translate("text", UPPER, LOWER), F.lit(TERM), F.lit(0))
    pairs = items.select(F.col("item_id").cast("long").alias("item_id"), F.explode(words).alias("term"))
    pairs = materialize(pairs.groupBy("item_id", "term").agg(F.count(F.lit(1)).alias("times")), "asked")
    n = pairs.count()
    blocks = 1 if n <= most_terms else 2 * n // most_terms + 1  # about half full; an item is never split
    block = F.pmod(F.xxhash64(F.lit(11), "item_id"), F.lit(blocks))
    found = [_of_block(docs, pairs.where(block == b).collect(), k, shard_docs, shard_postings) for b in range(blocks)]
    ship_code(spark)
    best = Window.partitionBy("item_id").orderBy(F.desc("score"), F.asc_nulls_last("doc_id"))
    rows = reduce(DataFrame.unionByName, found).withColumn("rank", F.row_number().over(best))
    return rows.where(F.col("rank") <= k).select("item_id", "rank", "doc_id", "score")


def _of_block(docs: DataFrame, pairs: list, k: int, shard_docs: int, shard_postings: int) -> DataFrame:
    """item_id, doc_id, score of each task's heaps for the items of ``pairs`` (item_id, term, times), which the driver holds."""
    spark = docs.sparkSession
    context = spark.sparkContext
    ship_code(spark)
    terms = sorted({term for _, term, _ in pairs})
    number = {t: i for i, t in enumerate(terms)}
    vocabulary = context.broadcast({t.encode(): i for t, i in number.items()})
    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").where("text is not null")
    shards = materialize(texts.mapInArrow(_build(vocabulary, shard_docs, shard_postings), SHARD), "shards")
    vocabulary.unpersist()

    n_docs, n_terms = shards.agg(F.sum("n_docs"), F.sum("n_terms")).first()
    df = shards.select(F.explode(F.arrays_zip("terms", "dfs")).alias("x")).groupBy(F.col("x.terms").alias("term")).agg(F.sum("x.dfs").alias("df"))
    weight = F.floor(1000 * F.log((2.0 * (n_docs or 0) + 2) / (2 * F.col("df") + 1)))
    weights = np.zeros(len(terms), np.int64)
    for term, w in df.select("term", weight.alias("w")).collect():  # at most as many as the items' terms
        weights[term] = w
    asked: dict = {}
    for item, term, times in pairs:
        asked.setdefault(item, []).append((number[term], times))
    held = context.broadcast((list(asked.items()), weights, n_docs or 0, n_terms or 1))
    return shards.mapInArrow(_search(held, k), "item_id long, doc_id long, score long")
