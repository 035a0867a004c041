"""Operator 12: benchmark decontamination by a distributed positional inverted index.

The index has a posting (term, document, position) for each word of a document that some item holds, and one under term 0
for each document's end. A window of an item is looked for from its rarest words: their lists, each moved back by the
word's place in the item, are intersected, and a place in a document where all of them agree is a candidate. There the
lists of the other words must agree as well; positions that do so in a row, as long as a window, are an occurrence.

Nothing but DataFrame operations. Tables that come from the items alone are broadcast up to MOST rows, and so are
candidates; beyond it the same joins shuffle, and adaptive execution splits what is hot.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lumenkb.session import materialize

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
WORD = r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+"
#: Rows of a table that is broadcast.
MOST = 500_000


def words(text: Column) -> Column:
    """Runs of digits, lower-case ASCII letters and characters beyond ASCII, after A-Z are in lower case. Null has none."""
    text = F.coalesce(text, F.lit(""))
    lower = F.when(F.octet_length(text) == F.length(text), F.lower(text)).otherwise(F.translate(text, UPPER, LOWER))
    return F.regexp_extract_all(lower, F.lit(WORD), F.lit(0))


def small(df: DataFrame) -> DataFrame:
    """A written table, marked for broadcast if it has at most MOST rows."""
    return F.broadcast(df) if df.count() <= MOST else df


@dataclass
class Index:
    """``postings``: term, doc, pos, doc_id (of ends). ``texts``: class, words, terms of each distinct word sequence of items.
    ``members``: item_id, class. ``places``: class, size, p, term, cf of each word. ``window``: words of a window."""

    postings: DataFrame
    texts: DataFrame
    members: DataFrame
    places: DataFrame
    window: int

    @property
    def ends(self) -> DataFrame:
        return self.postings.where("term = 0").select("doc", "doc_id", F.col("pos").alias("n_words"))


def build(docs: DataFrame, items: DataFrame, window: int) -> Index:
    """The index of ``docs`` (doc_id, text) for the words of ``items`` (item_id, text)."""
    asked = items.where("item_id is not null").select(F.col("item_id").cast("long").alias("item_id"), words(F.col("text")).alias("words")).where(F.size("words") > 0)
    asked = materialize(asked.withColumn("key", F.sha2(F.array_join("words", " "), 256)), "asked")
    # items of equal words are looked for once
    texts = asked.groupBy("key").agg(F.first("words").alias("words")).withColumn("class", F.monotonically_increasing_id())
    texts = materialize(texts, "item-texts")
    members = materialize(asked.join(small(texts.select("key", "class")), "key").select("item_id", "class").distinct(), "members")
    vocabulary = texts.select(F.explode("words").alias("word")).distinct().select("word", (F.monotonically_increasing_id() + 1).alias("term"))
    vocabulary = materialize(vocabulary.unionByName(docs.sparkSession.sql("SELECT '' AS word, 0L AS term")), "vocabulary")

    cut = docs.select(F.monotonically_increasing_id().alias("doc"), F.col("doc_id").cast("long").alias("doc_id"), F.concat(words(F.col("text")), F.array(F.lit(""))).alias("w"))
    rows = cut.select("doc", "doc_id", F.posexplode("w").alias("pos", "word")).join(small(vocabulary), "word")
    postings = materialize(rows.select("term", "doc", "pos", F.when(F.col("term") == 0, F.col("doc_id")).alias("doc_id")), "postings")

    cf = postings.where("term > 0").groupBy("term").agg(F.count(F.lit(1)).alias("cf"))
    places = texts.select("class", F.size("words").alias("size"), F.posexplode("words").alias("p", "word")).join(small(vocabulary), "word")
    places = materialize(places.join(cf, "term", "left").select("class", "size", "p", "term", F.coalesce("cf", F.lit(0)).alias("cf")), "places")
    numbered = places.groupBy("class", "size").agg(F.transform(F.array_sort(F.collect_list(F.struct("p", "term"))), lambda x: x["term"]).alias("terms"))
    return Index(postings, materialize(numbered, "item-terms"), members, places, window)


def rarest(index: Index, most: int) -> DataFrame:
    """class, size, start, p, term, rank of the ``most`` rarest words of each window, which begins at place ``start`` of its item."""
    last = F.greatest(F.col("size") - index.window, F.lit(0))
    starts = F.sequence(F.greatest(F.col("p") - index.window + 1, F.lit(0)), F.least(F.col("p"), last))
    # the last places of an item are in windows that begin at the last start at most
    rows = index.places.where(F.greatest(F.col("p") - index.window + 1, F.lit(0)) <= F.least(F.col("p"), last)).withColumn("start", F.explode(starts))
    by = Window.partitionBy("class", "start").orderBy("cf", "term", "p")
    return rows.withColumn("rank", F.row_number().over(by)).where(F.col("rank") <= most).drop("cf")


def phrases(index: Index, seeds: int = 3) -> DataFrame:
    """doc, class, at, n: runs of words of a document, as long as a window or longer, that are the same in an item."""
    lists = materialize(rarest(index, seeds).select("class", "size", "p", "term").distinct(), "seeds")
    hits = index.postings.join(small(lists), "term").select("doc", "class", "size", (F.col("pos") - F.col("p")).alias("shift"), "p")
    found = hits.groupBy("doc", "class", "size", "shift").agg(F.count(F.lit(1)).alias("m"), F.min("p").alias("lo"), F.max("p").alias("hi")).where(F.col("m") >= F.least(F.lit(seeds), F.lit(index.window), F.col("size")))
    # the words about the rare ones that agree must stand there too
    lo = F.greatest(F.col("lo") - index.window + 1, F.lit(0))
    terms = found.join(small(index.texts.drop("size")), "class").withColumn("lo", lo)
    terms = terms.select("doc", "class", "size", "shift", "lo", F.posexplode(F.slice("terms", F.col("lo") + 1, F.col("hi") + index.window - F.col("lo"))).alias("i", "term"))
    p = F.col("lo") + F.col("i")
    wanted = materialize(terms.select("doc", "class", "size", "shift", p.alias("p"), "term", (F.col("shift") + p).alias("pos")).where("pos >= 0"), "wanted")
    agreed = index.postings.select("term", "doc", "pos").join(small(wanted), ["doc", "pos", "term"])
    row = F.row_number().over(Window.partitionBy("doc", "class", "shift").orderBy("p"))
    runs = agreed.select("doc", "class", "size", "shift", "p", (F.col("p") - row).alias("run"))
    runs = runs.groupBy("doc", "class", "size", "shift", "run").agg(F.min("p").alias("p"), F.count(F.lit(1)).alias("n"))
    return runs.where(F.col("n") >= F.least(F.lit(index.window), F.col("size"))).select("doc", "class", (F.col("shift") + F.col("p")).alias("at"), F.col("n").cast("int").alias("n"))


def near(index: Index, span: int) -> DataFrame:
    """doc, class, start, at: windows of items all of whose different words stand, in any order, within ``span`` words of a document.

    ``at``: where the first such stretch begins. Found from the rarest word's postings, then from those of the second
    rarest near by, then of all others. A window of more different words than ``span`` is never near.
    """
    bucket = lambda x: F.floor(x / span)
    first = materialize(rarest(index, index.window).select("class", "start", "term", "rank"), "windows")
    # of each window's words the rarest occurrence of a term stands for it
    one = Window.partitionBy("class", "start", "term").orderBy("rank")
    first = first.withColumn("_n", F.row_number().over(one)).where("_n = 1").drop("_n")
    order = Window.partitionBy("class", "start")
    first = materialize(first.withColumn("rank", F.row_number().over(order.orderBy("rank"))).withColumn("words", F.count(F.lit(1)).over(order)).where(F.col("words") <= span), "window-words")
    posts = index.postings.where("term > 0").select("term", "doc", "pos")

    def among(found: DataFrame, lists: DataFrame) -> DataFrame:
        """Postings of the words of ``lists`` less than ``span`` from a place that is found."""
        asked = found.join(lists, ["class", "start"]).withColumn("b", F.explode(F.array(bucket(F.col("q")) - 1, bucket(F.col("q")), bucket(F.col("q")) + 1)))
        rows = asked.join(posts.withColumn("b", bucket(F.col("pos"))), ["doc", "term", "b"])
        return rows.where(F.abs(F.col("pos") - F.col("q")) < span)

    found = posts.join(small(first.where("rank = 1")), "term").select("doc", "class", "start", "words", F.col("pos").alias("q"))
    second = first.select("class", "start", "term", "rank").where("rank = 2")
    kept = among(found.where("words > 1"), second).select("doc", "class", "start", "words", "q").distinct()
    found = materialize(found.where("words = 1").unionByName(kept), "near-candidates")
    rows = among(found, first.select("class", "start", "term"))
    stretch = Window.partitionBy("doc", "class", "start", "q").orderBy("pos").rangeBetween(0, span - 1)
    rows = rows.withColumn("held", F.size(F.collect_set("term").over(stretch))).where("held = words")
    return rows.groupBy("doc", "class", "start").agg(F.min("pos").alias("at"))


def near_matches(docs: DataFrame, items: DataFrame, window: int = 10, span: int = 20) -> DataFrame:
    """doc_id, item_id, start, at: proximity matches; see ``near``. Rows that repeat a doc_id give their matches each."""
    index = build(docs, items, window)
    rows = near(index, span).join(index.ends, "doc").join(index.members, "class")
    return rows.select("doc_id", "item_id", "start", F.col("at").cast("long").alias("at"))


def contaminated(docs: DataFrame, items: DataFrame, window: int = 10, seeds: int = 3) -> DataFrame:
    """doc_id, n_words, n_hit, n_items, items (sorted as strings), contaminated: one row for each row of ``docs``.

    ``docs``: doc_id, text. ``items``: item_id, text. Other columns are ignored. A window is ``window`` words in a row of
    an item; an item of fewer words, but not none, is one. A word of a document is hit if an occurrence of a window covers
    it. Null and empty texts have no words; such items, and items without an id, are no windows. Rows that repeat a
    doc_id or have none are counted each; rows that repeat an item_id are windows of the same item. No documents give no
    rows, no items give documents without hits.
    """
    index = build(docs, items, window)
    runs = materialize(phrases(index, seeds), "runs")
    hit = runs.select("doc", F.explode(F.sequence("at", F.col("at") + F.col("n") - 1)).alias("pos")).distinct().groupBy("doc").agg(F.count(F.lit(1)).alias("n_hit"))
    held = runs.select("doc", "class").distinct().join(small(index.members), "class").select("doc", F.col("item_id").cast("string").alias("item")).distinct()
    held = held.groupBy("doc").agg(F.array_sort(F.collect_list("item")).alias("items"))
    rows = index.ends.join(hit, "doc", "left").join(held, "doc", "left")
    items_of = F.coalesce("items", F.array().cast("array<string>"))
    n_hit = F.coalesce("n_hit", F.lit(0))
    return rows.select("doc_id", F.col("n_words").cast("long").alias("n_words"), n_hit.alias("n_hit"), F.size(items_of).cast("long").alias("n_items"), items_of.alias("items"), (n_hit > 0).alias("contaminated"))
