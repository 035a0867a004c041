"""What has changed between a snapshot and the state on disk, and how healthy an index is."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def changes(cached: DataFrame, current: DataFrame, key: str = "path") -> DataFrame:
    """``key``, state (added, modified, deleted, clean): both tables have key, content_hash and mtime; either may differ."""
    c = cached.select(key, F.col("content_hash").alias("h"), F.col("mtime").alias("m"))
    rows = c.join(current.select(key, "content_hash", "mtime"), key, "full_outer")
    state = F.when(F.col("h").isNull(), "added").when(F.col("content_hash").isNull(), "deleted")
    state = state.when((F.col("h") != F.col("content_hash")) | (F.col("m") != F.col("mtime")), "modified").otherwise("clean")
    return rows.select(key, state.alias("state"))


def apply_changes(snapshot: DataFrame, changed: DataFrame, key: str = "path", deleted: DataFrame | None = None) -> DataFrame:
    """The next snapshot: rows of ``changed`` replace those of their key, keys of ``deleted`` go."""
    kept = snapshot.join(changed.select(key), key, "left_anti")
    if deleted is not None:
        kept = kept.join(deleted.select(key), key, "left_anti")
    return kept.unionByName(changed)


def section_reuse(old: DataFrame, new: DataFrame) -> DataFrame:
    """doc_id, reused, inserted, deleted: sections (doc_id, ord, text_hash) matched first come first served by equal hash."""
    def numbered(df: DataFrame, mark: str) -> DataFrame:
        n = F.row_number().over(Window.partitionBy("doc_id", "text_hash").orderBy("ord"))
        return df.select("doc_id", "text_hash", n.alias("n"), F.lit(True).alias(mark))

    rows = numbered(old, "was").join(numbered(new, "is"), ["doc_id", "text_hash", "n"], "full_outer")
    return rows.groupBy("doc_id").agg(
        F.count_if(F.col("was").isNotNull() & F.col("is").isNotNull()).alias("reused"),
        F.count_if(F.col("was").isNull()).alias("inserted"),
        F.count_if(F.col("is").isNull()).alias("deleted"),
    )


def health(docs: DataFrame, vectors: DataFrame) -> DataFrame:
    """metric, value: notes, notes without text, notes with a vector, vectors without a note. docs: doc_id, body; vectors: doc_id."""
    rows = docs.select("doc_id", F.col("body"), F.lit(True).alias("d")).join(vectors.select("doc_id", F.lit(True).alias("v")), "doc_id", "full_outer")
    one = rows.agg(
        F.count_if(F.col("d").isNotNull()).alias("documents"), F.count_if(F.col("d").isNotNull() & (F.coalesce(F.trim("body"), F.lit("")) == "")).alias("empty"),
        F.count_if(F.col("d").isNotNull() & F.col("v").isNotNull()).alias("covered"), F.count_if(F.col("d").isNull()).alias("orphan_vectors"),
    )
    return one.select(F.explode(F.create_map(*[x for c in one.columns for x in (F.lit(c), F.col(c))])).alias("metric", "value"))
