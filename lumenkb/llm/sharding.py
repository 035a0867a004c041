"""Operator 10: proportional stratified interleaving into shards.

Rows of each source are ranked in a seeded random order, all rows are sorted by their fractional rank within their
source, and that order is cut into ``shards`` runs whose row counts are at most one apart (law ``rows``). Every run
holds the same share of every source, to within a row for each source that there is.

Both rankings are bucketed: the bucket of a row is a prefix of its sort key, so a rank is a running sum of bucket
counts plus a row number inside one bucket. No source and no shard ever meets in one task, however hot it is.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def _rank(df: DataFrame, keys: list[str], bucket: Column, order: list[Column], out: str) -> DataFrame:
    """0-based rank of each row among those of equal ``keys``, and their number in ``<out>_of``. ``bucket`` never falls along ``order``."""
    df = df.withColumn("_b", bucket)
    counts = df.groupBy(*keys, "_b").agg(F.count(F.lit(1)).alias("_n"))
    before = Window.partitionBy(*keys).orderBy("_b").rowsBetween(Window.unboundedPreceding, -1)
    counts = counts.select(
        *[F.col(k).alias(f"_k{i}") for i, k in enumerate(keys)],
        F.col("_b").alias("_bb"),
        F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_before"),
        F.sum("_n").over(Window.partitionBy(*keys)).alias(f"{out}_of"),
    )
    inside = F.row_number().over(Window.partitionBy(*keys, "_b").orderBy(*order))
    on = F.col("_b") == F.col("_bb")
    for i, k in enumerate(keys):
        on = on & F.col(k).eqNullSafe(F.col(f"_k{i}"))
    df = df.withColumn("_i", inside - 1).join(counts, on)
    return df.withColumn(out, F.col("_i") + F.col("_before")).drop("_b", "_bb", "_i", "_before", "_n", *[f"_k{i}" for i in range(len(keys))])


def interleave(docs: DataFrame, shards: int = 8, seed: int = 17, buckets: int = 1024) -> DataFrame:
    """Deal ``docs`` (doc_id, text, source; other columns are ignored) into shards.

    Returns doc_id, size (UTF-8 bytes and 1; null text: 1), text_crc32 (null text: that of no bytes), law, shard, slot
    and grown_shard (null: this law doesn't promise stability). A null source is a source of its own. Rows that repeat
    are dealt one by one. An empty table gives no rows.
    """
    text = F.coalesce(F.encode(F.col("text").cast("string"), "UTF-8"), F.lit(b""))
    rows = docs.select(
        F.col("doc_id").cast("long").alias("doc_id"),
        F.col("source").cast("string").alias("source"),
        (F.octet_length(text) + 1).cast("long").alias("size"),
        F.crc32(text).alias("text_crc32"),
    )
    rows = rows.withColumn("_h", F.xxhash64(F.lit(seed), "doc_id", "size", "text_crc32"))
    # equal keys are equal rows, between which no order can be told
    order = [F.col(c) for c in ("_h", "doc_id", "size", "text_crc32")]
    by_hash = F.floor((F.col("_h") / 2.0**64 + 0.5) * buckets).cast("int")
    rows = _rank(rows, ["source"], by_hash, order, "_r")
    rows = rows.withColumn("_f", (F.col("_r") + 0.5) / F.col("_r_of"))
    rows = _rank(rows, [], F.floor(F.col("_f") * buckets).cast("int"), [F.col("_f"), F.col("source"), *order], "_g")
    shard = F.expr(f"(_g * {shards}) div _g_of")
    first = F.expr(f"(((_g * {shards}) div _g_of) * _g_of + {shards - 1}) div {shards}")
    return rows.select(
        "doc_id", "size", "text_crc32", F.lit("rows").alias("law"), shard.cast("int").alias("shard"),
        (F.col("_g") - first).cast("long").alias("slot"), F.lit(None).cast("int").alias("grown_shard"), "source",
    )
