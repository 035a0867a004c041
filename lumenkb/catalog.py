"""Every query of the engine by name; its SQL is in ``oracles``."""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lumenkb import oracles
from lumenkb.functions import ranking as R
from lumenkb.functions import text
from lumenkb.functions.text import estimate_tokens, tokens
from lumenkb.operators import distil, graph, guard, index, loadout, notes, projects, rules, search, sessions, sync
from lumenkb.operators import vectors as near
from lumenkb.plans.views import NOW, cards, code_files, note_vectors, page_links, pages, rule_notes, traces
from lumenkb.plans.views import notes as note_view
from lumenkb.session import materialize, new_folder, table, tidy
from lumenkb.sources import ignore

_queries: dict[str, Callable[[SparkSession, str], DataFrame]] = {}

RULES = [
    {"id": "R1", "kind": "forbidden", "pattern": "password", "severity": "deny", "file_pattern": "**/*.md"},
    {"id": "R2", "kind": "forbidden", "pattern": r"[A-Za-z0-9._]+@[A-Za-z0-9.]+\.[a-z]+", "severity": "warn", "file_pattern": None},
    {"id": "R3", "kind": "must_contain", "pattern": "the", "severity": "warn", "file_pattern": "src1*/**"},
]


def query(f: Callable[[SparkSession, str], DataFrame]) -> Callable[[SparkSession, str], DataFrame]:
    _queries[f.__name__.rstrip("_")] = f = tidy(f)
    return f


def asked(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "benchmark").select(F.col("item_id").alias("query_id"), F.col("text").alias("query"))


def vectors(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("doc_id"), F.col("embedding").cast("array<double>").alias("v"))


def query_vectors(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The vectors of the benchmark items' ids."""
    return vectors(spark, sf_dir).join(table(spark, sf_dir, "benchmark").select(F.col("item_id").alias("doc_id")), "doc_id").select(F.col("doc_id").alias("query_id"), "v")


def accesses(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = table(spark, sf_dir, "events").select("user_id", "event_type", F.unix_timestamp(F.date_trunc("second", "ts")).alias("ts"))
    return sessions.access_counts(e, ["user_id", "event_type"])


def graph_notes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """id, path, title, level, status of each page."""
    p = pages(spark, sf_dir).drop("html")
    level = F.element_at(F.array(*[F.lit(x) for x in ("L0Ephemeral", "L1Resource", "L2Log", "L3Evergreen")]), (F.col("id") % 4 + 1).cast("int"))
    return p.withColumn("level", level).withColumn("status", F.when(F.col("id") % 10 == 9, "superseded").otherwise("active"))


def resolved(spark: SparkSession, sf_dir: str) -> DataFrame:
    return graph.resolve_links(pages(spark, sf_dir), page_links(spark, sf_dir))


def page_edges(spark: SparkSession, sf_dir: str) -> DataFrame:
    return graph.edges(resolved(spark, sf_dir))


@query
def estimate_tokens_(spark, sf_dir):
    return table(spark, sf_dir, "documents").select("doc_id", estimate_tokens(F.col("text")).alias("tokens"))


@query
def safe_names(spark, sf_dir):
    return table(spark, sf_dir, "documents").select("doc_id", text.safe_name(F.concat(F.lit(" ."), F.substring("text", 1, 60), F.lit("?a/b."))).alias("name"))


@query
def one_line(spark, sf_dir):
    return table(spark, sf_dir, "documents").select("doc_id", F.md5(text.one_line(F.col("text"))).alias("line_md5"))


@query
def ansi_strip(spark, sf_dir):
    """Texts with colours about each t that begins a word, and a sequence that never ends."""
    coloured = F.concat(F.replace("text", F.lit(" t"), F.lit(" \x1b[1;31mt\x1b[0m")), F.lit("\x1b\x1b[9;"))
    return table(spark, sf_dir, "documents").select("doc_id", F.md5(text.without_ansi(coloured)).alias("plain_md5"))


@query
def unescape(spark, sf_dir):
    """Texts with every third's line feeds written out, and every fifth's followed by an escaped item."""
    raw = F.when(F.col("doc_id") % 3 == 0, F.replace("text", F.lit("\n"), F.lit("\\n"))).otherwise(F.concat("text", F.lit("\\t\\nx")))
    raw = F.when(F.col("doc_id") % 5 == 0, F.concat(raw, F.lit("\\n- item"))).otherwise(raw)
    return table(spark, sf_dir, "documents").select("doc_id", F.md5(text.unescaped(raw)).alias("text_md5"))


@query
def fuzzy_match(spark, sf_dir):
    """Which first lines hold the letters of the document's source in their order."""
    return table(spark, sf_dir, "documents").select("doc_id", text.is_subsequence(F.upper(F.concat("lang", "source")), text.first_line(F.col("text"))).alias("matches"))


@query
def path_keywords(spark, sf_dir):
    path = F.concat(F.lit("crates/"), "source", F.lit("-"), "lang", F.lit("_v/src/Mod_"), (F.col("doc_id") % 20).cast("string"), F.lit(".test.rs"))
    return table(spark, sf_dir, "documents").select("doc_id", F.array_join(text.path_keywords(path), " ").alias("keywords"))


IGNORED = """
# canonical-sibling = 100.md, '202.md'
src1/
*5.md
!*25.md
/src3/e?/
src4/**/[0-3]*.md
"""


@query
def scan_filter(spark, sf_dir):
    """The notes whose files a scan keeps."""
    return ignore.kept_files(note_view(spark, sf_dir).select("doc_id", "path"), ignore.parse_ignore(IGNORED))


@query
def lifecycle_status(spark, sf_dir):
    n = note_view(spark, sf_dir)
    tags = F.when(F.col("doc_id") % 11 == 0, F.array(F.lit("#status/archived"))).otherwise(F.array().cast("array<string>"))
    return n.select("doc_id", notes.lifecycle(F.when(F.col("status") != "active", F.initcap("status")), F.when(F.col("doc_id") % 13 == 0, "x"), tags, F.col("body")).alias("status"))


@query
def hierarchy_classify(spark, sf_dir):
    folder = F.element_at(F.array(*map(F.lit, ["Daily/x", "docs", "projects/Logs", "cards", "misc", "logs/wiki"])), (F.col("doc_id") % 6 + 1).cast("int"))
    path = F.when(F.col("doc_id") % 7 == 0, F.concat(F.col("doc_id").cast("string"), F.lit(".md"))).otherwise(F.concat_ws("/", folder, F.concat(F.col("doc_id").cast("string"), F.lit(".md"))))
    return table(spark, sf_dir, "documents").select("doc_id", notes.level(path, F.when(F.col("doc_id") % 17 == 0, " Session ")).alias("hierarchy"))


@query
def stale_after(spark, sf_dir):
    day = F.date_format(F.timestamp_seconds(F.lit(NOW) + (F.col("doc_id") % 61 - 30) * 86_400), "yyyy-MM-dd")
    return table(spark, sf_dir, "documents").select("doc_id", day.alias("stale_date"), notes.stale(day, NOW).alias("expired"))


@query
def temporal_decay(spark, sf_dir):
    n = note_view(spark, sf_dir)
    return n.select("doc_id", F.round(R.decay(F.col("level"), F.col("mtime"), F.lit(NOW), F.col("doc_id") % 5 == 0), 6).alias("decay"))


@query
def access_debounce(spark, sf_dir):
    return accesses(spark, sf_dir)


@query
def access_reinforcement(spark, sf_dir):
    return accesses(spark, sf_dir).withColumn("reinforcement", F.round(R.reinforcement(F.col("access_count"), F.col("last_access"), F.lit(NOW)), 6))


@query
def corpus_stats(spark, sf_dir):
    return search.corpus_stats(table(spark, sf_dir, "documents"), "text").withColumn("avg_len", F.round("avg_len", 6))


@query
def term_df(spark, sf_dir):
    return search.term_df(search.postings(table(spark, sf_dir, "documents"), "text"))


def _rounded(df: DataFrame) -> DataFrame:
    return df.select(F.col("query_id").alias("item_id"), "doc_id", "rank", F.round("score", 6).alias("score"))


@query
def bm25_search(spark, sf_dir):
    return _rounded(search.bm25_search(note_view(spark, sf_dir), asked(spark, sf_dir)))


@query
def bm25_tiers(spark, sf_dir):
    return search.tier_hits(note_view(spark, sf_dir), asked(spark, sf_dir)).withColumnRenamed("query_id", "item_id")


@query
def scoped_search(spark, sf_dir):
    return _rounded(search.scoped_search(note_view(spark, sf_dir), asked(spark, sf_dir), "src1", "L3Evergreen"))


@query
def vector_search(spark, sf_dir):
    rows = search.vector_search(vectors(spark, sf_dir), query_vectors(spark, sf_dir))
    return rows.select("query_id", F.col("doc_id").alias("vec_id"), "rank", (F.round("distance", 6) + 0.0).alias("distance"))


@query
def section_knn(spark, sf_dir):
    """The vectors as those of sections, five to a note."""
    sections = table(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("section_id"), F.floor(F.col("vec_id") / 5).alias("doc_id"), F.col("embedding").cast("array<double>").alias("v"))
    rows = near.section_search(sections, query_vectors(spark, sf_dir), 10)
    return rows.withColumn("distance", F.round("distance", 6) + 0.0)


def channels(spark: SparkSession, sf_dir: str, pool: int = 30) -> tuple[DataFrame, DataFrame]:
    lexical = search.lexical_hits(note_view(spark, sf_dir), asked(spark, sf_dir), pool)
    return lexical, search.vector_search(vectors(spark, sf_dir), query_vectors(spark, sf_dir), pool)


@query
def rrf_fusion(spark, sf_dir):
    rows = search.fuse(*channels(spark, sf_dir))
    return rows.select("query_id", F.col("doc_id").alias("id"), *[F.coalesce(c, F.lit(0)).cast("long").alias(c) for c in ("bm25_rank", "vector_rank")], F.round("score", 6).alias("score"))


def hybrid_inputs(spark: SparkSession, sf_dir: str) -> tuple:
    access = accesses(spark, sf_dir).groupBy(F.col("user_id").alias("doc_id")).agg(F.sum("access_count").alias("access_count"), F.max("last_access").alias("last_access"))
    return note_view(spark, sf_dir), asked(spark, sf_dir), vectors(spark, sf_dir), query_vectors(spark, sf_dir), page_edges(spark, sf_dir), access, NOW


@query
def hybrid_search(spark, sf_dir):
    rows = search.hybrid_search(*hybrid_inputs(spark, sf_dir))
    return rows.withColumn("expanded_from", F.coalesce("expanded_from", F.lit(-1))).withColumnRenamed("doc_id", "id")


@query
def graph_expand(spark, sf_dir):
    """What each query's best hits of the hybrid search lead to."""
    docs, queries, v, qv, edges, access, now = hybrid_inputs(spark, sf_dir)
    rows = search.expansions(search.scored_pool(docs, queries, v, qv, edges, access, now, 10), docs, edges, access, now)
    return rows.select("query_id", F.col("doc_id").alias("neighbour"), "parent", F.round("score", 9).alias("score"))


@query
def graph_boost(spark, sf_dir):
    """Which notes of each query's pool have an active neighbour in it."""
    lexical, vector = channels(spark, sf_dir)
    pool = search.fuse(lexical, vector).join(note_view(spark, sf_dir).select("doc_id", "status"), "doc_id")
    linked = search.connected(pool.where("status = 'active'").select("query_id", "doc_id"), page_edges(spark, sf_dir)).withColumn("c", F.lit(True))
    rows = pool.join(linked, ["query_id", "doc_id"], "left")
    return rows.select("query_id", F.col("doc_id").alias("id"), F.coalesce("c", F.lit(False)).alias("connected"))


@query
def section_locate(spark, sf_dir):
    """The lines of documents as sections."""
    n, terms = note_view(spark, sf_dir), search.query_terms(asked(spark, sf_dir))
    hits = search.ranked(search.bm25(n, terms), search.score_order(), 10)
    lines = n.select("doc_id", F.posexplode(F.split("body", "\n", -1)).alias("ord", "body"))
    rows = search.section_locate(hits, lines, terms)
    return rows.select(F.col("query_id").alias("item_id"), "doc_id", "ord", F.round("score", 6).alias("score"))


@query
def federated_search(spark, sf_dir):
    n = note_view(spark, sf_dir).withColumn("content_hash", F.md5("body"))
    return search.federated_search(n.where("doc_id % 2 = 0"), n.where("doc_id % 2 = 1"), asked(spark, sf_dir)).withColumnRenamed("query_id", "item_id")


@query
def link_resolve(spark, sf_dir):
    return resolved(spark, sf_dir).drop("raw_target").withColumn("pos", F.col("pos").cast("long")).fillna({"dst": -1})


@query
def link_edges(spark, sf_dir):
    return page_edges(spark, sf_dir)


@query
def link_stats(spark, sf_dir):
    return resolved(spark, sf_dir).groupBy("resolution").agg(F.count(F.lit(1)).alias("n"))


@query
def backlinks(spark, sf_dir):
    return graph.degree(pages(spark, sf_dir), page_edges(spark, sf_dir)).withColumnRenamed("id", "page_id")


@query
def orphans(spark, sf_dir):
    return graph.orphans(graph_notes(spark, sf_dir), page_edges(spark, sf_dir)).withColumnRenamed("id", "page_id")


@query
def broken_links(spark, sf_dir):
    return resolved(spark, sf_dir).where("resolution = 'broken'").select("src", "raw_target")


@query
def weave_plan(spark, sf_dir):
    return graph.weave_plan(graph_notes(spark, sf_dir), page_edges(spark, sf_dir))


@query
def graph_export(spark, sf_dir):
    g = graph_notes(spark, sf_dir)
    rows = page_edges(spark, sf_dir).join(g.select(F.col("id").alias("src"), F.col("path").alias("src_path")), "src")
    return rows.join(g.select(F.col("id").alias("dst"), F.col("path").alias("dst_path")), "dst").select("src_path", "dst_path").distinct()


@query
def supersession_chain(spark, sf_dir):
    n = note_view(spark, sf_dir)
    # a superseded note's successor: the next note but two of the same rest by three hundred, as far as there are any
    after = n.select(F.col("doc_id").alias("next"))
    rows = n.select(F.col("doc_id").alias("id"), F.when(F.col("status") != "active", F.col("doc_id") + 3).alias("want"))
    rows = rows.join(after, F.col("want") == F.col("next"), "left").select("id", "next")
    return graph.chains(rows).withColumnRenamed("id", "doc_id")


@query
def near_dups(spark, sf_dir):
    return graph.near_duplicates(table(spark, sf_dir, "documents"))


@query
def cosine_dups(spark, sf_dir):
    """Near vectors among active lasting notes; every third drawn one supersedes what it was drawn towards."""
    v = note_vectors(spark, sf_dir)
    superseded = v.where("id % 24 = 7").select("id", F.lit(4).alias("n")).select((F.col("id") - F.col("n")).alias("a"), F.col("id").alias("b"))
    return near.cosine_duplicates(v, superseded).withColumn("score", F.round("score", 6))


def files(spark: SparkSession, sf_dir: str) -> DataFrame:
    return note_view(spark, sf_dir).select(F.col("doc_id").alias("id"), "path", F.col("body").alias("content"))


@query
def guard_forbidden(spark, sf_dir):
    return guard.forbidden(files(spark, sf_dir), RULES).withColumnRenamed("id", "doc_id")


@query
def guard_must_contain(spark, sf_dir):
    return guard.must_contain(files(spark, sf_dir), RULES).withColumnRenamed("id", "doc_id")


@query
def guard_report(spark, sf_dir):
    return guard.report(files(spark, sf_dir), RULES).withColumnRenamed("id", "doc_id")


@query
def guard_diff(spark, sf_dir):
    """A diff for each document: its first line goes, its other lines come."""
    lines = F.split("body", "\n", -1)
    head = F.concat(F.lit("diff --git a/"), "path", F.lit(" b/"), "path", F.lit("\n--- a/"), "path", F.lit("\n+++ b/"), "path", F.lit("\n@@ -1,1 +1,"), (F.size(lines) - 1).cast("string"), F.lit(" @@\n-"), F.element_at(lines, 1))
    body = F.array_join(F.transform(F.slice(lines, F.lit(2), F.greatest(F.size(lines) - 1, F.lit(0))), lambda x: F.concat(F.lit("\n+"), x)), "")
    return guard.audit_diffs(note_view(spark, sf_dir).select(F.col("doc_id").alias("diff_id"), F.concat(head, body).alias("diff")), RULES).drop("path")


COMMENT_RULES = [
    {"id": "C1", "kind": "forbidden", "pattern": "password", "severity": "deny", "include_comments": False},
    {"id": "C2", "kind": "forbidden", "pattern": "password", "severity": "warn", "include_comments": True},
]


@query
def guard_comments(spark, sf_dir):
    return guard.forbidden(code_files(spark, sf_dir), COMMENT_RULES).withColumnRenamed("id", "doc_id")


@query
def guard_rules(spark, sf_dir):
    rows = rules.note_rules(rule_notes(spark, sf_dir))
    return rows.select("doc_id", F.col("at").cast("long").alias("place"), "id", "kind", "pattern", F.coalesce("file_pattern", F.lit("")).alias("file_pattern"), "severity", "remediation")


def changed_rule_notes(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    """The rule notes, and the same after a change: some are gone, some retired (named successors may not be active), some have lost their rules or name a note that is gone as superseded."""
    was = rule_notes(spark, sf_dir)
    kind = F.col("doc_id") % 7
    named = lambda key, n: F.concat(F.lit(f'{{"{key}": "[[decisions/n'), n.cast("string"), F.lit('|x]]"}'))
    front = F.when(kind == 2, named("superseded_by", F.col("doc_id") + 1)).when((kind == 5) & (F.col("doc_id") % 2 == 0), named("supersedes", F.col("doc_id") - 4)).otherwise(F.col("frontmatter"))
    now = was.where("doc_id % 7 <> 1").withColumn("frontmatter", front).withColumn("status", F.when(kind == 2, "superseded").otherwise(F.col("status")))
    return was, now.withColumn("body", F.when(kind == 3, "# T").otherwise(F.col("body")))


@query
def guard_resurrection(spark, sf_dir):
    """The rules that hold for that change, each once."""
    return rules.rules_of_change(*changed_rule_notes(spark, sf_dir)).select("doc_id", "id", "kind", "pattern", "state")


@query
def rule_dedup(spark, sf_dir):
    rows = note_view(spark, sf_dir).select(F.concat(F.lit("R"), (F.col("doc_id") % 50).cast("string")).alias("id"), F.substring("title", 1, 5).alias("pattern"), F.col("path").alias("source"), F.col("doc_id").alias("order"))
    return guard.first_rules(rows).drop("order")


def turns(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "conversations").select(F.col("conv_id").alias("session_id"), F.col("turn").alias("turn_index"), "role", F.col("text").alias("content"))


@query
def gc_turns(spark, sf_dir):
    rows = sessions.fold_turns(turns(spark, sf_dir), hot=2, foldable_role="assistant")
    return rows.select(F.col("session_id").alias("conv_id"), F.col("turn_index").alias("turn"), F.col("tier").alias("fold_tier"), F.col("tokens").alias("tokens_after"))


@query
def gc_summary(spark, sf_dir):
    return sessions.fold_summary(sessions.fold_turns(turns(spark, sf_dir), hot=2, foldable_role="assistant")).withColumnRenamed("session_id", "conv_id")


@query
def offload(spark, sf_dir):
    return sessions.offload(table(spark, sf_dir, "documents").select(F.col("doc_id").alias("id"), F.col("text").alias("content")), 5).withColumnRenamed("id", "doc_id")


def mutated(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    """A snapshot of the notes, and a later state in which some went, some came and some changed."""
    n = note_view(spark, sf_dir)
    was = n.where("doc_id % 10 <> 1").select("path", "doc_id", "body", F.md5("body").alias("content_hash"), "mtime")
    body = F.when(F.col("doc_id") % 10 == 3, F.concat("body", F.lit("\nA line more."))).otherwise(F.col("body"))
    now = n.where("doc_id % 10 <> 2").select("path", "doc_id", body.alias("body"), F.md5(body).alias("content_hash"), (F.col("mtime") + F.when(F.col("doc_id") % 10 == 4, 5).otherwise(0)).alias("mtime"))
    return was, now


@query
def dirty_sets(spark, sf_dir):
    return sync.changes(*mutated(spark, sf_dir)).groupBy("state").agg(F.count(F.lit(1)).alias("n"))


@query
def section_diff(spark, sf_dir):
    cut = lambda d: d.select("doc_id", F.posexplode(F.split("body", "\n", -1)).alias("ord", "line")).select("doc_id", "ord", F.md5("line").alias("text_hash"))
    was, now = mutated(spark, sf_dir)
    return sync.section_reuse(cut(was), cut(now))


@query
def pending_sections(spark, sf_dir):
    """Lines of the later state of the notes that have no vector yet, or one of another text."""
    cut = lambda d: d.select("doc_id", F.posexplode(F.split("body", "\n", -1)).alias("ord", "line")).select("doc_id", F.col("ord").cast("long").alias("ord"), F.md5("line").alias("text_hash"))
    was, now = mutated(spark, sf_dir)
    return near.pending_sections(cut(now), cut(was))


@query
def index_maintenance(spark, sf_dir):
    """Rows, notes and a sum for each table of an index that was built from the earlier state and brought to the later one by two batches."""
    def source(d):
        links = F.array(F.concat(F.lit("n"), (F.col("doc_id") + 1).cast("string")))
        return d.select("doc_id", "path", F.element_at(F.split("body", "\n", -1), 1).alias("title"), F.array(F.regexp_replace("path", "/.*", ""), F.lit("note")).alias("tags"), links.alias("links"), "body", "mtime")

    was, now = mutated(spark, sf_dir)
    state = sync.changes(was, now)
    changed = source(now).join(state.where("state in ('added', 'modified')").select("path"), "path", "left_semi")
    kept = index.NoteIndex(spark, new_folder(spark, "note-index"))
    kept.apply("notes", 0, source(was))
    kept.apply("notes", 1, changed.where("doc_id % 2 = 0"), was.join(state.where("state = 'deleted'"), "path", "left_semi").select("doc_id"))
    kept.apply("notes", 2, changed.where("doc_id % 2 = 1"))
    sums = {"documents": "n_tokens", "postings": "tf", "links": "pos + 1", "tags": "length(tag)", "sections": "ord"}
    rows = [kept.read(t).agg(F.count(F.lit(1)).alias("n_rows"), F.count_distinct("doc_id").alias("n_notes"), F.sum(F.expr(x)).cast("long").alias("total")).select(F.lit(t).alias("name"), "*") for t, x in sums.items()]
    return reduce(DataFrame.unionByName, rows)


@query
def vector_dirty(spark, sf_dir):
    docs = table(spark, sf_dir, "documents").select(F.col("doc_id").cast("string").alias("path"), F.lit("h").alias("content_hash"), F.lit(0).alias("mtime"))
    vecs = table(spark, sf_dir, "embeddings").select(F.col("vec_id").cast("string").alias("path"), F.when(F.col("label") == 3, "old").otherwise("h").alias("content_hash"), F.lit(0).alias("mtime"))
    return sync.changes(vecs, docs).groupBy("state").agg(F.count(F.lit(1)).alias("n"))


@query
def index_health(spark, sf_dir):
    return sync.health(note_view(spark, sf_dir), vectors(spark, sf_dir))


@query
def timeline(spark, sf_dir):
    return sessions.timeline(note_view(spark, sf_dir).select(F.col("doc_id").alias("id"), "path", "level", F.col("mtime").alias("stamp"))).withColumnRenamed("id", "doc_id")


@query
def pack_filter(spark, sf_dir):
    n = note_view(spark, sf_dir).withColumn("tags", F.array(F.concat(F.lit("#"), F.upper("level"))))
    rows = notes.pack_select(n, query="the", tags=["l3evergreen", "#L2Log"])
    return rows.select("doc_id", "level")


@query
def flush_dedup_names(spark, sf_dir):
    n = note_view(spark, sf_dir)
    return notes.file_names(n.select(F.col("doc_id").alias("id"), F.col("level").alias("folder"), "title", "body")).withColumnRenamed("id", "doc_id")


@query
def category_normalize(spark, sf_dir):
    raws = ["", "Card", "adr", "wiki", " Journal ", "projects", "recipe", "other"]
    raw = F.element_at(F.array(*map(F.lit, raws)), (F.col("doc_id") % 8 + 1).cast("int"))
    return table(spark, sf_dir, "documents").select("doc_id", raw.alias("raw"), notes.category(raw, F.col("text")).alias("category"))


def asked_keywords(spark: SparkSession, sf_dir: str) -> DataFrame:
    return asked(spark, sf_dir).select("query_id", F.slice(F.array_sort(F.array_distinct(tokens(F.col("query")))), 1, 6).alias("keywords"))


def ranked_cards(hits: DataFrame, cards: DataFrame, most: int) -> DataFrame:
    """The best ``cards`` (doc_id, name, level, more) of keyword ``hits``; lasting ones score one more, and one point alone isn't enough."""
    rows = hits.join(cards, "doc_id").withColumn("score", F.col("score") + F.when(F.col("level") == "L3Evergreen", 1).otherwise(0)).where("score > 1")
    return search.ranked(rows, [F.desc("score"), F.length("name"), F.col("doc_id")], most)


@query
def loadout_rank(spark, sf_dir):
    """The ten best notes for each query's keywords."""
    known = note_view(spark, sf_dir).where("status = 'active'").select("doc_id", F.col("title").alias("name"), "path", F.col("title").alias("concept"), "level")
    return ranked_cards(loadout.keyword_hits(known, asked_keywords(spark, sf_dir)), known, 10).select("query_id", "doc_id", "score", "rank")


@query
def card_concepts(spark, sf_dir):
    return cards(spark, sf_dir).select("doc_id", loadout.card_concept(F.col("body")).alias("concept"))


@query
def loadout_text(spark, sf_dir):
    """A loadout for each query: its text is the scope (four times over for every fourth), its keywords the modules that have changed."""
    words = asked_keywords(spark, sf_dir)
    known = materialize(cards(spark, sf_dir).select("doc_id", "name", "path", "level", loadout.card_concept(F.col("body")).alias("concept")), "cards")
    best = ranked_cards(loadout.keyword_hits(known, words), known, loadout.MOST_CARDS)
    scope = F.repeat(F.replace("query", F.lit("\n"), F.lit(" ")), F.when(F.col("query_id") % 4 == 0, 4).otherwise(1))
    heads = asked(spark, sf_dir).select("query_id", scope.alias("scope")).join(words, "query_id")
    logs = F.when(F.col("query_id") % 3 == 0, F.array(F.lit("- [[log one]]"), F.lit("- [[log two]]")))
    heads = heads.select("query_id", F.concat(F.lit("Q"), F.col("query_id").cast("string")).alias("name"), loadout.changes_line(F.col("keywords"), F.size("keywords")).alias("changes"), "scope", logs.alias("logs"))
    rows = loadout.loadout_texts(heads, best.select("query_id", "rank", F.col("doc_id").cast("string").alias("name"), "concept"))
    return rows.select("query_id", "n_cards", "tokens", F.md5("text").alias("text_md5"))


@query
def find_project(spark, sf_dir):
    """Pages as projects, asked for by the first words of documents; those that no name answers go to the nearest vectors."""
    p = pages(spark, sf_dir)
    level = F.concat(F.lit("topic "), F.regexp_extract("path", "^([a-z]*)/", 1))
    known = p.select(F.col("id").alias("project"), "path", "title", F.concat(F.lit("slug-"), F.col("id").cast("string")).alias("slug"), F.array(F.concat(F.lit("p"), F.col("id").cast("string"))).alias("aliases"), F.array(level, F.lit("project")).alias("tags"))
    links = page_edges(spark, sf_dir).join(p.select(F.col("id").alias("src"), F.regexp_extract("path", r"([^/]*)\.md$", 1).alias("stem")), "src").select(F.col("dst").alias("project"), "stem")
    n = F.col("doc_id") % 4
    words = F.filter(tokens(F.substring("text", 1, 60)), lambda x: F.length(x) > 3)
    text_ = F.when(n == 0, F.concat(F.lit("P"), (F.col("doc_id") % 300).cast("string"))).when(n == 1, F.get(words, 0)).when(n == 2, F.concat_ws("_", F.get(words, 0), F.get(words, 1))).otherwise(F.concat(F.lit("slug-"), (F.col("doc_id") % 300).cast("string"), F.lit(" slug")))
    queries = table(spark, sf_dir, "documents").select(F.col("doc_id").alias("query_id"), text_.alias("query"))
    hits = search.vector_search(vectors(spark, sf_dir), query_vectors(spark, sf_dir)).select("query_id", F.col("doc_id").alias("project"), "rank", (F.col("distance") / 2).alias("distance"))
    none = hits.select("query_id", "project", "rank").where("false")
    return projects.find_projects(queries, projects.harvested(known, links), none, hits)


@query
def distil_skills(spark, sf_dir):
    rows = distil.skills(traces(spark, sf_dir))
    joined = [F.array_join(c, "\n").alias(c) for c in ("tags", "commands_before", "commands_after", "error_lines")]
    return rows.select(F.col("id").alias("conv_id"), "title", "summary", *joined)


@query
def handoff_claim(spark, sf_dir):
    e = table(spark, sf_dir, "events").select("event_id", "user_id", "event_type", F.unix_timestamp(F.date_trunc("second", "ts")).alias("ts"))
    made = e.where("event_type = 'error'").select(F.col("event_id").alias("handoff_id"), F.when(F.col("user_id") % 2 == 0, F.concat(F.lit("AGENT"), (F.col("user_id") % 5).cast("string"))).alias("to_agent"), (F.col("ts") + 86_400).alias("expires_at"))
    hours = F.explode(F.array(*[F.lit(i) for i in range(6)]))
    claims = e.where("event_type = 'error'").select(F.col("event_id").alias("handoff_id"), "ts", hours.alias("i"))
    claims = claims.select("handoff_id", F.concat(F.lit("agent"), ((F.col("handoff_id") + F.col("i")) % 5).cast("string")).alias("agent"), (F.col("ts") + F.col("i") * 20_000).alias("ts"))
    return sessions.claim(made, claims)


def entry(spark: SparkSession, sf_dir: str) -> DataFrame:
    return hybrid_search(spark, sf_dir)


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return dict(_queries)


def oracle_sql() -> dict[str, str]:
    return oracles.SQL


