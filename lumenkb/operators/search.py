"""Lexical, vector and hybrid search over batches of queries."""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lumenkb.functions import ranking as R
from lumenkb.functions.text import SEGMENT_CJK, fold_fullwidth, index_tokens, indexed, segmented, tokens
from lumenkb.operators.graph import expand
from lumenkb.session import materialize, ship_code

K1, B = 1.2, 0.75
MOST_QUERIES = 10_000
#: Ways to ask, from the strictest to the weakest.
TIERS = ["strict", "all", "any"]


def postings(docs: DataFrame, text: str = "body") -> DataFrame:
    """doc_id, term, tf."""
    return docs.select("doc_id", F.explode(tokens(F.col(text))).alias("term")).groupBy("doc_id", "term").agg(F.count(F.lit(1)).alias("tf"))


def small_batch(queries: DataFrame) -> DataFrame:
    """``queries``, marked for broadcast if they are known to be at most MOST_QUERIES."""
    return queries if queries.limit(MOST_QUERIES + 1).count() > MOST_QUERIES else F.broadcast(queries)


def corpus_stats(docs: DataFrame, text: str = "body") -> DataFrame:
    """n_docs, total_tokens, avg_len: one row."""
    n = F.size(tokens(F.col(text)))
    return docs.agg(F.count(F.lit(1)).alias("n_docs"), F.sum(n).cast("long").alias("total_tokens"), F.avg(n).alias("avg_len"))


def term_df(index: DataFrame) -> DataFrame:
    return index.groupBy("term").agg(F.count(F.lit(1)).alias("df"), F.sum("tf").cast("long").alias("cf"))


def query_terms(queries: DataFrame, most: int = 8) -> DataFrame:
    """query_id, term: at most ``most`` distinct tokens of each query, longer ones first, then in their order."""
    rows = queries.select("query_id", F.posexplode(F.array_distinct(tokens(F.col("query")))).alias("pos", "term"))
    best = Window.partitionBy("query_id").orderBy(F.desc(F.length("term")), "pos")
    return rows.withColumn("_n", F.row_number().over(best)).where(F.col("_n") <= most).select("query_id", "term")


def bm25(docs: DataFrame, terms: DataFrame, text: str = "body") -> DataFrame:
    """query_id, doc_id, score, matched: BM25 of every document that holds a term of a query."""
    # the length is taken below the explode, else it would be found anew for each word
    cut = docs.select("doc_id", tokens(F.col(text)).alias("_w")).select("doc_id", "_w", F.size("_w").alias("len"))
    words = cut.select("doc_id", "len", F.explode("_w").alias("term"))
    # only words that a query asks for are counted, and each row brings its document's length along
    index = words.join(terms.select("term").distinct(), "term", "left_semi").groupBy("doc_id", "len", "term").agg(F.count(F.lit(1)).alias("tf"))
    df = index.groupBy("term").agg(F.count(F.lit(1)).alias("df"))
    rows = index.join(terms, "term").join(df, "term").join(F.broadcast(corpus_stats(docs, text)))
    idf = F.greatest(F.log((F.col("n_docs") - F.col("df") + 0.5) / (F.col("df") + 0.5)), F.lit(1e-6))
    gain = idf * F.col("tf") * (K1 + 1) / (F.col("tf") + K1 * (1 - B + B * F.col("len") / F.col("avg_len")))
    return rows.groupBy("query_id", "doc_id").agg(F.sum(gain).alias("score"), F.count(F.lit(1)).alias("matched"))


def ranked(hits: DataFrame, by: list[Column], most: int, out: str = "rank", keys: tuple[str, ...] = ("query_id",)) -> DataFrame:
    """``hits`` with a 1-based rank among those of a query, up to ``most``."""
    rows = hits.withColumn(out, F.row_number().over(Window.partitionBy(*keys).orderBy(*by)).cast("long"))
    return rows.where(F.col(out) <= most)


def score_order(column: str = "score") -> list[Column]:
    """Falling by a score, with ties (to nine places) by doc_id."""
    return [F.desc(F.round(column, 9)), F.col("doc_id")]


def query_phrases(queries: DataFrame, most: int = 8) -> DataFrame:
    """query_id, tier, term, times, need: what each tier of a query (see TIERS) asks for.

    A term is the tokens of a phrase with spaces between, ``times`` how often the tier asks for it, ``need`` how many
    different terms a hit must hold. A single CJK character asks for all tokens that begin with it, which the term marks
    by a star. strict: each part of the query between white space is a phrase. all: the same after CJK runs are cut into
    bigrams. any: at most ``most`` different phrases of those; where there are more, Latin ones of three characters and
    more come first, then other Latin ones, then CJK bigrams, longer before shorter.
    """
    text = fold_fullwidth(F.col("query"))
    parts = lambda x: F.posexplode(F.split(F.trim(x), r"\s+")).alias("pos", "part")
    starred = lambda x: F.when((F.length(x) == 1) & x.rlike(SEGMENT_CJK), F.concat(x, F.lit("*"))).otherwise(x)
    term = starred(F.array_join(index_tokens(F.col("part")), " "))
    whole = queries.select("query_id", parts(text)).select("query_id", term.alias("term")).where("term <> ''").withColumn("tier", F.lit(0))
    cut = queries.select("query_id", parts(segmented(text))).select("query_id", "pos", starred(F.array_join(tokens(F.col("part")), " ")).alias("term"), F.regexp_replace(F.lower("part"), r"^[^\p{L}\p{N}_]+|[^\p{L}\p{N}_]+$", "").alias("key"))
    cut = cut.where("term <> ''").groupBy("query_id", "key").agg(F.min("pos").alias("pos"), F.min_by("term", "pos").alias("term"))
    cjk = F.col("key").rlike(SEGMENT_CJK)
    group = F.when(~cjk & (F.length("key") >= 3), 0).when(~cjk, 1).when(F.length("key") >= 2, 2).otherwise(3)
    best = Window.partitionBy("query_id").orderBy(group, F.desc(F.length("key")), "pos")
    some = cut.withColumn("_n", F.row_number().over(best)).where(F.col("_n") <= most).select("query_id", "term", F.lit(2).alias("tier"))
    rows = whole.unionByName(cut.select("query_id", "term", F.lit(1).alias("tier"))).unionByName(some)
    rows = rows.groupBy("query_id", "tier", "term").agg(F.count(F.lit(1)).alias("times"))
    return rows.withColumn("need", F.when(F.col("tier") == 2, 1).otherwise(F.count(F.lit(1)).over(Window.partitionBy("query_id", "tier"))))


#: What of a note is indexed, as far as it has it; tags are texts.
FIELDS = ["title", "body", "tags"]


#: What stands between fields and after the last one among a note's tokens.
BETWEEN, END = "", "\n"


def note_words(docs: DataFrame) -> DataFrame:
    """doc_id, pos, word of a note's FIELDS, with BETWEEN so that no phrase reaches from one field into the next, and END."""
    text = {f: F.array_join("tags", " ") if f == "tags" and dict(docs.dtypes)[f].startswith("array") else F.col(f) for f in FIELDS if f in docs.columns}
    # columns of their own, else each mention below would look for wide characters again
    ready = docs.select("doc_id", *[indexed(F.coalesce(x, F.lit(""))).alias(f"_{f}") for f, x in text.items()])
    marks = [BETWEEN] * (len(text) - 1) + [END]
    words = F.concat(*[x for f, mark in zip(text, marks, strict=True) for x in (tokens(F.col(f"_{f}")), F.array(F.lit(mark)))])
    return ready.select("doc_id", F.posexplode(words).alias("pos", "word"))


def phrase_index(docs: DataFrame, terms: DataFrame) -> tuple[DataFrame, DataFrame]:
    """doc_id, term, tf of each of ``terms`` (distinct; see ``query_phrases``) in each document that holds it, and doc_id, len of all documents.

    One pass reads the texts and keeps the words that a term asks for, and each document's end.
    """
    between = sum(f in docs.columns for f in FIELDS) - 1
    asked = terms.select("term", F.split("term", " ").alias("x")).select("term", F.size("x").alias("n"), F.posexplode("x").alias("off", "word"))
    ends = docs.sparkSession.range(1).select(F.lit(END).alias("word"))
    wanted = small_batch(materialize(asked.select("word").distinct().unionByName(ends), "asked-words"))
    words = note_words(docs)
    if wanted.where("word like '%*'").limit(1).count():  # a word of CJK letters also stands for all that begin like it
        first = F.substring("word", 1, 1)
        words = words.withColumn("word", F.explode(F.when(first.rlike(SEGMENT_CJK), F.array("word", F.concat(first, F.lit("*")))).otherwise(F.array("word"))))
    kept = materialize(words.join(wanted, "word"), "kept-words")

    # a phrase stands where all of its tokens agree on where it begins; a single token begins at itself
    found = kept.where(F.col("word") != END).join(small_batch(asked), "word")
    alone = found.where("n = 1").groupBy("doc_id", "term").agg(F.count(F.lit(1)).alias("tf"))
    starts = found.where("n > 1").groupBy("doc_id", "term", "n", (F.col("pos") - F.col("off")).alias("at")).agg(F.count(F.lit(1)).alias("m")).where("m = n")
    return alone.unionByName(starts.groupBy("doc_id", "term").agg(F.count(F.lit(1)).alias("tf"))), kept.where(F.col("word") == END).select("doc_id", (F.col("pos") - between).alias("len"))


def ladder(docs: DataFrame, queries: DataFrame) -> DataFrame:
    """query_id, tier, doc_id, score, factor: BM25 of the hits of each query's first tier that has any, and the tier's weight.

    A tier that asks for every phrase looks only at the documents that hold the rarest of them, and not at all if one
    of them stands nowhere; the last tier runs for what is left.
    """
    asked = materialize(query_phrases(queries), "phrases")
    found, sizes = phrase_index(docs, asked.select("term").distinct())
    index = materialize(found.join(sizes, "doc_id"), "postings")
    df = index.groupBy("term").agg(F.count(F.lit(1)).alias("df"))
    total = sizes.agg(F.count(F.lit(1)).alias("n_docs"), F.avg("len").alias("avg_len"))
    units = materialize(asked.join(df, "term").join(F.broadcast(total)), "units")  # a row of totals

    idf = F.greatest(F.log((F.col("n_docs") - F.col("df") + 0.5) / (F.col("df") + 0.5)), F.lit(1e-6))
    gain = F.col("times") * idf * F.col("tf") * (K1 + 1) / (F.col("tf") + K1 * (1 - B + B * F.col("len") / F.col("avg_len")))
    score = lambda rows: rows.groupBy("query_id", "tier", "doc_id").agg(F.sum(gain).alias("score"), F.count(F.lit(1)).alias("matched"), F.first("need").alias("need"))

    every = units.where("tier < 2").withColumn("_held", F.count(F.lit(1)).over(Window.partitionBy("query_id", "tier"))).where("_held = need").drop("_held")
    rarest = every.groupBy("query_id", "tier").agg(F.min(F.struct("df", "term")).alias("x")).select("query_id", "tier", F.col("x.term").alias("term"))
    within = rarest.join(index.select("doc_id", "term"), "term").select("query_id", "tier", "doc_id")
    full = score(within.join(every, ["query_id", "tier"]).join(index, ["doc_id", "term"])).where("matched = need")
    full = materialize(full.drop("matched", "need"), "full-hits")
    first = full.groupBy("query_id").agg(F.min("tier").alias("tier"))
    some = score(units.where("tier = 2").join(first.select("query_id"), "query_id", "left_anti").join(index, "term"))
    rows = full.join(first, ["query_id", "tier"]).unionByName(some.drop("matched", "need"))
    return rows.withColumn("factor", F.when(F.col("tier") == 2, R.ANY_TOKENS).otherwise(1.0))


def lexical_hits(docs: DataFrame, queries: DataFrame, pool: int) -> DataFrame:
    """query_id, doc_id, bm25_rank, score, factor: the best hits of each query's tier."""
    return ranked(ladder(docs, queries), score_order(), pool, "bm25_rank")


def bm25_search(docs: DataFrame, queries: DataFrame, limit: int = 10) -> DataFrame:
    """query_id, doc_id, rank, score: pure lexical mode; the score comes from the rank, and inactive notes sink."""
    pool = max(3 * limit, 20)
    hits = lexical_hits(docs, queries, pool)
    live = docs.select("doc_id", F.when(F.col("status") == "active", 1.0).otherwise(R.INACTIVE).alias("_f"))
    rows = hits.join(live, "doc_id").withColumn("score", F.col("factor") / (R.RRF_K + F.col("bm25_rank")) * F.col("_f"))
    return ranked(rows, [F.desc("score"), F.col("bm25_rank"), F.col("doc_id")], limit).select("query_id", "doc_id", "rank", "score")


def tier_hits(docs: DataFrame, queries: DataFrame) -> DataFrame:
    """query_id, tier, n_hits: the first tier with hits, and how many."""
    hits = ladder(docs, queries).groupBy("query_id", "tier").agg(F.count(F.lit(1)).alias("n_hits"))
    return hits.select("query_id", F.element_at(F.array(*map(F.lit, TIERS)), F.col("tier") + 1).alias("tier"), "n_hits")


def scoped_search(docs: DataFrame, queries: DataFrame, prefix: str, level: str, limit: int = 10) -> DataFrame:
    """The same over notes under a path and of a level; the scope holds before anything is counted."""
    return bm25_search(docs.where(F.col("path").startswith(prefix) & (F.col("level") == level)), queries, limit)


def vector_search(vectors: DataFrame, queries: DataFrame, limit: int = 10) -> DataFrame:
    """query_id, doc_id, rank, distance by cosine. ``vectors``: doc_id, v. ``queries``: query_id, v; more than MOST_QUERIES go in blocks."""
    asked = queries.select("query_id", F.col("v").cast("array<double>").alias("v"))
    some = asked.limit(MOST_QUERIES + 1).toPandas()
    if len(some) <= MOST_QUERIES:
        return ranked_near(vectors, some, limit)
    blocks = 2 * asked.count() // MOST_QUERIES + 1  # about half full; a query_id is never split
    block = F.pmod(F.xxhash64(F.lit(11), "query_id"), F.lit(blocks))
    return reduce(DataFrame.unionByName, [ranked_near(vectors, asked.where(block == b).toPandas(), limit) for b in range(blocks)])


def ranked_near(vectors: DataFrame, asked: pd.DataFrame, limit: int) -> DataFrame:
    """The same for queries that the driver holds."""
    ids = asked["query_id"].to_numpy(np.int64)
    ship_code(vectors.sparkSession)
    held = vectors.sparkSession.sparkContext.broadcast(np.stack(asked["v"].to_list()) if len(asked) else np.zeros((0, 1)))

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        q = held.value
        size = np.linalg.norm(q, axis=1)
        for pdf in batches:
            if not len(pdf) or not len(q):
                continue
            m = np.stack(pdf["v"].to_list())
            far = 1 - (q @ m.T) / np.outer(size, np.linalg.norm(m, axis=1))
            doc = pdf["doc_id"].to_numpy()
            for i, row in enumerate(far):
                least = np.partition(row, min(limit, len(row)) - 1)[min(limit, len(row)) - 1]
                at = np.flatnonzero(row <= least + 1e-8)
                yield pd.DataFrame({"query_id": ids[i], "doc_id": doc[at], "distance": row[at]})

    rows = vectors.select("doc_id", F.col("v").cast("array<double>")).mapInPandas(run, "query_id long, doc_id long, distance double")
    return ranked(rows, [F.round("distance", 9), F.col("doc_id")], limit).select("query_id", "doc_id", "rank", "distance")


def fuse(lexical: DataFrame, vector: DataFrame) -> DataFrame:
    """query_id, doc_id, bm25_rank, vector_rank, score: both channels by reciprocal ranks; an empty channel's weight goes to the other.

    ``lexical``: query_id, doc_id, bm25_rank, factor (the weight of the tier that the query's hits are of).
    """
    rows = lexical.select("query_id", "doc_id", "bm25_rank", "factor").join(vector.select("query_id", "doc_id", F.col("rank").alias("vector_rank")), ["query_id", "doc_id"], "full_outer")
    w = Window.partitionBy("query_id")
    lex, vec = F.max("bm25_rank").over(w).isNotNull(), F.max("vector_rank").over(w).isNotNull()
    weight = lambda own, other: F.when(own & other, 0.5).when(own, 1.0).otherwise(0.0)
    rows = rows.withColumn("_b", weight(lex, vec)).withColumn("_v", weight(vec, lex))
    return rows.withColumn("score", R.rrf(F.col("bm25_rank"), F.col("vector_rank"), F.col("_b"), F.col("_v"), F.coalesce("factor", F.lit(1.0)))).drop("_b", "_v", "factor")


def connected(live: DataFrame, edges: DataFrame) -> DataFrame:
    """query_id, doc_id: those of ``live`` that a link joins to another one of the same query, in either direction."""
    both = edges.select(F.col("src").alias("doc_id"), F.col("dst").alias("near")).union(edges.select("dst", "src")).where("doc_id <> near").distinct()
    linked = live.join(both, "doc_id").join(live.select("query_id", F.col("doc_id").alias("near")), ["query_id", "near"], "left_semi")
    return linked.select("query_id", "doc_id").distinct()


def section_locate(hits: DataFrame, sections: DataFrame, terms: DataFrame) -> DataFrame:
    """query_id, doc_id, ord, score: the best section of each hit (query_id, doc_id) by BM25 over all sections (doc_id, ord, body); the first among equals."""
    numbered = sections.select(F.struct("doc_id", "ord").alias("doc_id"), "body")
    scored = bm25(numbered, terms).select("query_id", "doc_id.doc_id", "doc_id.ord", "score").join(hits.select("query_id", "doc_id"), ["query_id", "doc_id"], "left_semi")
    best = scored.groupBy("query_id", "doc_id").agg(F.min(F.struct((-F.round("score", 9)).alias("s"), "ord")).alias("x"))
    return best.select("query_id", "doc_id", F.col("x.ord").cast("long").alias("ord"), (-F.col("x.s")).alias("score"))


MOST_PARENTS = 10


def best_order() -> list[Column]:
    """By final score, then the channels' ranks."""
    return [F.desc(F.round("score", 9)), F.asc_nulls_last("bm25_rank"), F.asc_nulls_last("vector_rank"), F.col("doc_id")]


def scored_pool(docs: DataFrame, queries: DataFrame, vectors: DataFrame, query_vectors: DataFrame, edges: DataFrame, access: DataFrame, now: int, limit: int) -> DataFrame:
    """query_id, doc_id, bm25_rank, vector_rank, status, graph_boost, score of all direct hits, as a table; see ``hybrid_search``."""
    pool = max(3 * limit, 20)
    rows = fuse(lexical_hits(docs, queries, pool), vector_search(vectors, query_vectors, pool))
    rows = rows.join(docs.select("doc_id", "level", "mtime", "status"), "doc_id").join(access, "doc_id", "left")
    rows = rows.withColumn("top", F.max("score").over(Window.partitionBy("query_id")))
    live = rows.where(F.col("status") == "active").select("query_id", "doc_id")
    rows = rows.join(connected(live, edges).withColumn("linked", F.lit(True)), ["query_id", "doc_id"], "left")
    boost = F.when(F.col("linked"), R.BOOST * F.col("top")).otherwise(0.0)
    final = (F.col("score") + boost) * in_time(now) * F.when(F.col("status") == "active", 1.0).otherwise(R.INACTIVE)
    rows = rows.withColumn("graph_boost", boost).withColumn("score", final)
    return materialize(rows.select("query_id", "doc_id", "bm25_rank", "vector_rank", "status", "graph_boost", "score"), "pool")


def in_time(now: int) -> Column:
    """The weight of a note's age and use (level, mtime, access_count, last_access)."""
    used = F.coalesce(R.reinforcement(F.col("access_count"), F.col("last_access"), F.lit(now)), F.lit(1.0))
    return R.decay(F.col("level"), F.col("mtime"), F.lit(now), F.lit(False)) * used


def expansions(pool: DataFrame, docs: DataFrame, edges: DataFrame, access: DataFrame, now: int, limit: int = 10) -> DataFrame:
    """query_id, doc_id, parent, score: what the best active hits of a ``scored_pool`` link to outside of it, half of ``limit`` at most."""
    parents = ranked(pool.where("status = 'active'"), best_order(), min(2 * limit, MOST_PARENTS)).select("query_id", F.col("doc_id").alias("id"), "score")
    near = expand(parents, edges, docs.select(F.col("doc_id").alias("id"), "level", "status"), pool.select("query_id", F.col("doc_id").alias("id")))
    rows = near.withColumnRenamed("id", "doc_id").join(docs.select("doc_id", "level", "mtime"), "doc_id").join(access, "doc_id", "left")
    rows = rows.withColumn("score", F.col("score") * in_time(now))
    return ranked(rows, score_order(), max(limit // 2, 1)).select("query_id", "doc_id", "parent", "score")


def hybrid_search(docs: DataFrame, queries: DataFrame, vectors: DataFrame, query_vectors: DataFrame, edges: DataFrame, access: DataFrame, now: int, limit: int = 10) -> DataFrame:
    """query_id, doc_id, rank, score, graph_boost, expanded_from (null: a direct hit).

    Fuses both channels, lifts active notes that have an active neighbour in the pool by a share of the best score,
    weighs by age, use and status, and adds neighbours outside the pool. ``edges``: src, dst. ``access``: doc_id,
    access_count, last_access.
    """
    pool = scored_pool(docs, queries, vectors, query_vectors, edges, access, now, limit)
    more = expansions(pool, docs, edges, access, now, limit).withColumnRenamed("parent", "expanded_from").withColumn("graph_boost", F.lit(0.0))
    rows = pool.drop("status").unionByName(more, allowMissingColumns=True)
    rows = ranked(rows, best_order(), limit)
    return rows.select("query_id", "doc_id", "rank", F.round("score", 6).alias("score"), F.round("graph_boost", 6).alias("graph_boost"), "expanded_from")


def federated_search(own: DataFrame, shared: DataFrame, queries: DataFrame, limit: int = 10) -> DataFrame:
    """query_id, doc_id, scope, rank, score over an own and a shared corpus (with content_hash); shared copies of own results go."""
    pool = max(2 * limit, 10)

    def scope(docs: DataFrame, name: str, factor: float) -> DataFrame:
        hits = lexical_hits(docs, queries, pool).withColumnRenamed("bm25_rank", "r")
        quality = F.when(F.col("status") == "active", 1.0).otherwise(R.INACTIVE) * F.col("factor")
        rows = hits.join(docs.select("doc_id", "status", "content_hash"), "doc_id")
        return rows.select("query_id", "doc_id", "content_hash", F.lit(name).alias("scope"), (factor * quality / (R.RRF_K + F.col("r"))).alias("score"))

    first = scope(own, "primary", 1.0)
    other = scope(shared, "global", R.GLOBAL).join(first.select("query_id", "content_hash"), ["query_id", "content_hash"], "left_anti")
    order = [F.desc(F.round("score", 9)), F.desc("scope"), F.col("doc_id")]
    rows = ranked(first.unionByName(other), order, limit)
    return rows.select("query_id", "doc_id", "scope", "rank", F.round("score", 6).alias("score"))
