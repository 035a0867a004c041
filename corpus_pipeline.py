"""A training corpus from ``documents``: toxic documents go, then repeated lines, near copies and surplus text of low quality; the rest is packed."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lumenkb.llm import jaccard, lines, mixing, packing, queries, toxicity
from lumenkb.session import materialize, table, tidy

#: The share of tokens that each class of the labels is to have, but for toxic text, which the first stage rejects.
MIXTURE = {"high": 0.97, "low": 0.03}


@tidy
def reject_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that score as toxic go. Null and empty texts stay."""
    return toxicity.clean(docs, table(spark, sf_dir, "labels"))


@tidy
def dedup_lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Lines that repeat an earlier one go from the texts, and with their last word a document that had some; n_chars follows."""
    rows = lines.dedup_lines(docs)
    changed = F.col("n_removed") > 0
    rows = rows.where(~changed | F.col("kept_text").rlike(r"\S"))
    text = F.when(changed, F.col("kept_text")).otherwise(F.col("text"))
    n_chars = F.when(changed, F.length("kept_text").cast("long")).otherwise(F.col("n_chars"))
    return rows.select(*[{"text": text, "n_chars": n_chars}.get(c, F.col(c)).alias(c) for c in docs.columns])


@tidy
def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each class of near copies stays, that of the smallest doc_id."""
    return jaccard.one_of_each(docs)


@tidy
def mix_to_targets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents stay with the fitted rate as their chance; rates are at most one, so none is repeated."""
    return mixing.mix(docs, table(spark, sf_dir, "labels"), F.expr(queries.DOMAIN), MIXTURE)


@tidy
def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return packing.pack(docs)


STAGES = [
    ("toxicity", reject_toxic),
    ("line dedup", dedup_lines),
    ("n-gram Jaccard join", drop_near_copies),
    ("mixing sources to target weights", mix_to_targets),
    ("best-fit packing", pack),
]

#: No stage but the mixing has a SQL form; the stages are held against brute force in tests/llm.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The packed sequences of the documents that are left: one row per piece."""
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = materialize(stage(spark, docs, sf_dir), name.replace(" ", "-"))
    return STAGES[-1][1](spark, docs, sf_dir)
