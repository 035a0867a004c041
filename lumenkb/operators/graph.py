"""Links between notes: resolution, edges, neighbours, supersession, upkeep reports."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from lumenkb.functions.ranking import INWARD, OUTWARD
from lumenkb.operators.overlap import near_sets
from lumenkb.session import materialize

#: File endings of links that lead to files other than notes (fixed values).
ASSETS = ["png", "jpg", "jpeg", "gif", "webp", "svg", "pdf", "canvas", "excalidraw", "mp4", "webm", "mp3", "wav", "zip", "csv"]


def noext(path):
    """Lower case, forward slashes, without a leading ./ or / and a closing .md."""
    return F.regexp_replace(F.regexp_replace(F.lower(F.translate(path, "\\", "/")), r"^(\./|/)+", ""), r"\.md$", "")


def parent(path):
    return F.when(path.contains("/"), F.regexp_replace(path, "/[^/]*$", "")).otherwise("")


def stem(path):
    return F.regexp_replace(path, "^.*/", "")


def resolve_links(notes: DataFrame, links: DataFrame) -> DataFrame:
    """src, pos, raw_target, resolution (document, self, asset or broken), dst.

    ``notes``: id, path, title. ``links``: src (an id), pos, raw_target. A target is tried as a path relative to its
    note where it says so, then as a full path, a path beside its note, the end of a path, a file name and a title; the
    first that finds a note counts. Among several, one in the note's own folder wins, then the shorter path in bytes,
    then the smaller path and id.
    """
    own = notes.select("id", noext(F.col("path")).alias("p"), F.lower(F.trim("title")).alias("t")).where("p <> ''")
    # written, as titles and links may be cut from long texts and are read several times
    own = materialize(own.withColumn("dir", parent(F.col("p"))), "link-notes")
    rows = links.join(own.select(F.col("id").alias("src"), F.col("dir").alias("src_dir")), "src", "left").withColumn("src_dir", F.coalesce("src_dir", F.lit("")))
    rows = materialize(rows.select("src", "pos", "raw_target", "src_dir"), "links")
    # where a target leads depends on it and on its note's folder, so links that agree on both are told once
    bare = F.trim(F.regexp_replace(F.trim("raw_target"), r"[#^].*$", ""))
    asked = rows.select("raw_target", "src_dir").distinct().withColumn("bare", bare).withColumn("target", noext(F.col("bare")))
    beside = F.when(F.col("src_dir") == "", F.col("target")).otherwise(F.concat_ws("/", "src_dir", "target"))
    asked = asked.withColumn("beside", beside)
    kind = F.when(F.trim("raw_target") == "", "broken").when(F.col("bare") == "", "self").when(F.col("target") == "", "broken")
    kind = kind.when(F.regexp_extract("target", r"\.([a-z0-9]+)$", 1).isin(ASSETS), "asset")
    asked = asked.withColumn("kind", kind).withColumn("up", F.col("bare").rlike(r"(^|/)\.\.(/|$)"))
    # a step up leaves the folder before it; one that leaves the root leads nowhere
    none = F.lit(None).cast("array<string>")
    step = lambda at, x: F.when(x == "..", F.when(F.size(at) > 0, F.slice(at, F.lit(1), F.size(at) - 1)).otherwise(none)).otherwise(F.concat(at, F.array(x)))
    parts = F.filter(F.split("beside", "/"), lambda x: (x != "") & (x != "."))
    flat = F.aggregate(parts, F.array().cast("array<string>"), lambda at, x: F.when(at.isNotNull(), step(at, x)))
    asked = materialize(asked.withColumn("relative", F.when(F.col("up"), F.array_join(flat, "/"))), "asked-links")
    deep, up = F.col("target").contains("/"), F.col("up")
    tiers = [("path", F.when(up, F.col("relative"))), ("path", F.when(~up, F.col("target"))), ("path", F.when(~up, F.col("beside"))), ("end", F.when(~up & deep, F.col("target"))), ("stem", F.when(~up & ~deep, F.col("target"))), ("title", F.when(~up, F.lower(F.trim("bare"))))]
    tried = F.array(*[F.struct(F.lit(i).alias("tier"), F.lit(by).alias("by"), key.alias("key")) for i, (by, key) in enumerate(tiers)])
    tried = asked.where(F.col("kind").isNull()).select("raw_target", "src_dir", F.inline(tried)).where("key is not null")
    # of the notes that share a key only the first of all and the first of each folder can win, so that many make no pairs with many links
    ends = F.transform(F.sequence(F.lit(1), F.size("parts")), lambda i: F.array_join(F.slice("parts", i, F.size("parts")), "/"))
    named = lambda by, keys: F.transform(keys, lambda x: F.struct(F.lit(by).alias("by"), x.alias("key")))
    keys = F.concat(named("path", F.array("p")), named("end", ends), named("stem", F.array(stem(F.col("p")))), named("title", F.filter(F.array("t"), lambda x: x != "")))
    place = F.struct(F.octet_length("p").alias("n"), "p", "id", "dir")
    nearest = materialize(own.withColumn("parts", F.split("p", "/")).select("dir", place.alias("place"), F.inline(keys)).groupBy("by", "key", "dir").agg(F.min("place").alias("place")), "notes-by-key")
    first = materialize(nearest.groupBy("by", "key").agg(F.min("place").alias("place")), "first-by-key")
    hits = tried.join(nearest.withColumnRenamed("dir", "src_dir"), ["by", "key", "src_dir"]).unionByName(tried.join(first, ["by", "key"]))
    order = F.struct("tier", (F.col("place.dir") != F.col("src_dir")).alias("away"), "place")
    best = hits.groupBy("raw_target", "src_dir").agg(F.min(order).alias("best"))
    told = materialize(asked.select("raw_target", "src_dir", "kind").join(best, ["raw_target", "src_dir"], "left").select("raw_target", "src_dir", "kind", F.col("best.place.id").alias("dst")), "told-links")
    out = rows.join(told, ["raw_target", "src_dir"], "left")
    resolution = F.coalesce("kind", F.when(F.col("dst") == F.col("src"), "self").when(F.col("dst").isNotNull() & F.col("src").isNotNull(), "document").otherwise("broken"))
    return out.select("src", "pos", "raw_target", resolution.alias("resolution"), F.when(resolution == "document", F.col("dst")).alias("dst"))


def edges(resolved: DataFrame) -> DataFrame:
    return resolved.where(F.col("resolution") == "document").select("src", "dst").distinct()


def degree(notes: DataFrame, links: DataFrame) -> DataFrame:
    """id, in_links, out_links."""
    ins = links.groupBy(F.col("dst").alias("id")).agg(F.count(F.lit(1)).alias("in_links"))
    outs = links.groupBy(F.col("src").alias("id")).agg(F.count(F.lit(1)).alias("out_links"))
    rows = notes.select("id").join(ins, "id", "left").join(outs, "id", "left")
    return rows.select("id", F.coalesce("in_links", F.lit(0)).alias("in_links"), F.coalesce("out_links", F.lit(0)).alias("out_links"))


def expand(parents: DataFrame, links: DataFrame, notes: DataFrame, pool: DataFrame) -> DataFrame:
    """query_id, id, parent, score: neighbours of each query's ``parents`` (query_id, id, score) outside its ``pool`` (query_id, id), each with its best link.

    ``notes``: id, level, status. A link outwards passes OUTWARD of the parent's score; one inwards INWARD, and only to
    lasting notes. Inactive and passing notes are skipped.
    """
    one_way = lambda near, far, share: links.join(parents.select("query_id", F.col("id").alias(near), "score"), near).select("query_id", F.col(far).alias("id"), F.col(near).alias("parent"), (F.col("score") * share).alias("score"), F.lit(near == "dst").alias("inward"))
    rows = one_way("src", "dst", OUTWARD).unionByName(one_way("dst", "src", INWARD)).join(pool.select("query_id", "id"), ["query_id", "id"], "left_anti")
    rows = rows.join(notes.select("id", "level", "status"), "id")
    rows = rows.where("status = 'active' and level <> 'L0Ephemeral' and (not inward or level = 'L3Evergreen')")
    best = rows.groupBy("query_id", "id").agg(F.min(F.struct((-F.round("score", 12)).alias("s"), "parent", "score")).alias("x"))
    return best.select("query_id", "id", F.col("x.parent").alias("parent"), F.col("x.score").alias("score"))


def orphans(notes: DataFrame, links: DataFrame) -> DataFrame:
    """id: active notes that last and that no link touches. ``notes``: id, level, status."""
    touched = links.select(F.col("src").alias("id")).union(links.select("dst"))
    return notes.where("status = 'active' and level <> 'L0Ephemeral'").select("id").join(touched, "id", "left_anti")


def weave_plan(notes: DataFrame, links: DataFrame) -> DataFrame:
    """dst, sources: for active lasting notes, what the backlink block is to list: path|title of each L1 or L3 note that links there, sorted."""
    to = notes.where("status = 'active' and level = 'L3Evergreen'").select(F.col("id").alias("dst"))
    of = notes.where("level in ('L1Resource', 'L3Evergreen')").select(F.col("id").alias("src"), F.concat_ws("|", noext(F.col("path")), "title").alias("entry"))
    rows = links.join(to, "dst").join(of, "src")
    return rows.groupBy("dst").agg(F.array_join(F.array_sort(F.collect_set("entry")), "; ").alias("sources"))


def chains(successor: DataFrame, most: int = 16) -> DataFrame:
    """id, final_id, hops: where each note's chain of successors ends, by doubling; a cycle ends after ``most`` hops.

    ``successor``: id, next (null: none).
    """
    rows = successor.select("id", "next")
    state = rows.select("id", F.coalesce("next", "id").alias("final_id"), F.when(F.col("next").isNull(), 0).otherwise(1).alias("hops"))
    step = 1
    while step < most:
        ahead = state.select(F.col("id").alias("final_id"), F.col("final_id").alias("far"), F.col("hops").alias("more"))
        state = materialize(state.join(ahead, "final_id").select("id", F.col("far").alias("final_id"), (F.col("hops") + F.col("more")).alias("hops")), "chains")
        step *= 2
    return state.select("id", "final_id", F.col("hops").cast("long").alias("hops"))


def near_duplicates(docs: DataFrame, least: float = 0.6) -> DataFrame:
    """a, b, jaccard: pairs of different word sets with a Jaccard similarity of ``least`` or more.

    A set is named by the smallest doc_id that has it; sets of one name (a doc_id that occurs twice) make no pair.
    """
    from lumenkb.functions.text import tokens

    sets = docs.select("doc_id", F.array_sort(F.array_distinct(F.transform(tokens(F.col("text")), lambda w: F.xxhash64(w)))).alias("words")).where(F.size("words") > 0)
    nodes = sets.groupBy("words").agg(F.min("doc_id").alias("node")).where("node is not null")
    nodes = materialize(nodes.select("node", F.xxhash64("words").alias("key"), "words"), "word-sets")
    names = nodes.select("key", "node")
    rows = near_sets(nodes.select("key", "words"), least)
    rows = rows.join(names.withColumnsRenamed({"key": "a", "node": "one"}), "a").join(names.withColumnsRenamed({"key": "b", "node": "two"}), "b").where("one <> two")
    score = F.col("both") / (F.col("n") + F.col("m") - F.col("both"))
    return rows.select(F.least("one", "two").alias("a"), F.greatest("one", "two").alias("b"), F.round(score, 6).alias("jaccard"))
