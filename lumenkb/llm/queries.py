"""One query per operator of this subpackage, over its whole table."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lumenkb.session import table


def op1_edit_aware_tokens(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Three edits to each document: a replacement after a quarter, an insertion in the middle, a deletion after three quarters."""
    from lumenkb.llm.tokencount import count_tokens

    docs = table(spark, sf_dir, "documents")
    n = F.length(F.coalesce("text", F.lit("")))
    edit = lambda at, cut, new: F.struct(at.cast("long").alias("at"), F.lit(cut).cast("long").alias("cut"), F.lit(new).alias("new"))
    edits = F.array(edit(F.floor(n / 4), 8, "[edited]"), edit(F.floor(n / 2), 0, " some new words "), edit(F.floor(3 * n / 4), 12, ""))
    return count_tokens(docs.select("doc_id", "text", edits.alias("edits")))


def op2_chosen_path_jaccard(spark: SparkSession, sf_dir: str) -> DataFrame:
    from lumenkb.llm.jaccard import jaccard_classes

    return jaccard_classes(table(spark, sf_dir, "documents")).select("doc_id", "class_id", "n_links")


def op3_deobfuscated_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    from lumenkb.llm.toxicity import score

    return score(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op4_exact_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    from lumenkb.llm.topk import exact_top_k

    return exact_top_k(table(spark, sf_dir, "embeddings"), F.col("vec_id") % 50 == 0)


#: The classes of the labels table as domains, and the share of tokens each is to have.
DOMAIN = "CASE WHEN toxic = 1 THEN 'toxic' WHEN quality = 0 THEN 'low' ELSE 'high' END"
MIXTURE = {"high": 0.93, "low": 0.06, "toxic": 0.01}
#: Of the largest total that needs no repeats; the rest leaves rates room to fall where a document is of two domains.
HEADROOM = 0.9


def op5_soft_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    from lumenkb.llm.mixing import document_rates

    rates = document_rates(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"), F.expr(DOMAIN), MIXTURE, headroom=HEADROOM)
    posterior = [F.element_at("p", i + 1).alias(f"p_{d}") for i, d in enumerate(MIXTURE)]
    return rates.select("doc_id", "tokens", *posterior, "rate")


def op6_one_bit_ann(spark: SparkSession, sf_dir: str) -> DataFrame:
    from lumenkb.llm.ann import nearest

    return nearest(table(spark, sf_dir, "embeddings"), F.col("vec_id") % 20 == 0)


def op7_fuzzy_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    from lumenkb.llm.lines import dedup_lines

    rows = dedup_lines(table(spark, sf_dir, "documents"))
    return rows.select("doc_id", "n_lines", "n_removed", F.md5(F.encode("kept_text", "UTF-8")).alias("kept_md5"))


def op8_sum_of_squares_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    from lumenkb.llm.packing import pack

    return pack(table(spark, sf_dir, "documents"))


def op9_suffix_array_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    from lumenkb.llm.suffix import dedup_substrings

    return dedup_substrings(table(spark, sf_dir, "documents")).drop("kept")


def op10_stratified_shards(spark: SparkSession, sf_dir: str) -> DataFrame:
    from lumenkb.llm.sharding import interleave

    return interleave(table(spark, sf_dir, "documents"))


def op11_wand_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    from lumenkb.llm.wand import lexical_top_k

    return lexical_top_k(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op12_positional_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    from lumenkb.llm.contamination import contaminated

    rows = contaminated(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))
    digest = F.sha2(F.encode(F.array_join("items", ","), "UTF-8"), 256)
    return rows.select("doc_id", "n_words", "n_hit", "n_items", digest.alias("items_sha256"), "contaminated")


def op13_rank_select_fim(spark: SparkSession, sf_dir: str) -> DataFrame:
    from lumenkb.llm.fim import fill_in_middle, restored

    digest = lambda x: F.sha2(F.encode(x, "UTF-8"), 256)
    rows = fill_in_middle(table(spark, sf_dir, "documents"))
    return rows.select("doc_id", "n", "form", "prefix_chars", "middle_chars", digest(F.col("output")).alias("output_sha256"), digest(restored(F.col("output"), F.col("form"))).alias("restored_sha256"))


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {f.__name__: f for f in (op1_edit_aware_tokens, op2_chosen_path_jaccard, op3_deobfuscated_toxicity, op4_exact_topk, op5_soft_mixing, op6_one_bit_ann, op7_fuzzy_line_dedup, op8_sum_of_squares_packing, op9_suffix_array_dedup, op10_stratified_shards, op11_wand_search, op12_positional_decontamination, op13_rank_select_fim)}


TOPK_SQL = """
WITH v AS (
  SELECT vec_id, list_transform(embedding, lambda x: CAST(floor(256 * CAST(x AS DOUBLE)) AS BIGINT)) AS w FROM embeddings
  WHERE vec_id IS NOT NULL AND len(embedding) > 0 AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
), s AS (
  SELECT q.vec_id AS query_id, c.vec_id AS vec_id,
         CAST(list_sum(list_transform(range(1, len(q.w) + 1), lambda i: q.w[i] * c.w[i])) AS BIGINT) AS score
  FROM v q JOIN v c ON q.vec_id % 50 = 0 AND q.vec_id <> c.vec_id AND len(q.w) = len(c.w)
), r AS (
  SELECT *, CAST(row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS INTEGER) AS "rank" FROM s
)
SELECT query_id, "rank", vec_id, score FROM r WHERE "rank" <= 5
"""


LEXICAL_SQL = r"""
WITH d AS (SELECT doc_id, regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+') AS w FROM documents),
q AS (SELECT item_id, regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+') AS w FROM benchmark),
c AS (SELECT count(*) AS nd, CAST(sum(len(w)) AS BIGINT) AS nl FROM d WHERE len(w) > 0),
tok AS (SELECT doc_id, len(w) AS n, unnest(w) AS term FROM d),
post AS (SELECT doc_id, n, term, count(*) AS tf FROM tok GROUP BY ALL),
dfs AS (SELECT term, count(*) AS df FROM post GROUP BY term),
asked AS (SELECT item_id, term, count(*) AS times FROM (SELECT item_id, unnest(w) AS term FROM q) GROUP BY ALL),
s AS (
  SELECT item_id, doc_id, CAST(sum(times * CAST(floor(1000 * ln((2.0 * nd + 2) / (2 * df + 1))) AS BIGINT) * ((1000000000 * tf) // (1000 * tf + 8 * (100 - 75 + (75 * n * nd) // nl)))) AS BIGINT) AS score
  FROM asked JOIN post USING (term) JOIN dfs USING (term), c GROUP BY item_id, doc_id
), r AS (SELECT *, CAST(row_number() OVER (PARTITION BY item_id ORDER BY score DESC, doc_id) AS INTEGER) AS "rank" FROM s WHERE score > 0)
SELECT item_id, "rank", doc_id, score FROM r WHERE "rank" <= 10
"""

LEAKS_SQL = r"""
WITH d AS (SELECT row_number() OVER () AS k, doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM documents),
b AS (SELECT item_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM benchmark WHERE item_id IS NOT NULL),
starts AS (SELECT item_id, w, least(10, len(w)) AS n, unnest(range(1, greatest(len(w) - 9, 1) + 1)) AS s FROM b WHERE len(w) > 0),
win AS (SELECT DISTINCT item_id, n, array_to_string(w[s : s + n - 1], ' ') AS g FROM starts),
pos AS (SELECT k, w, n, unnest(range(1, len(w) - n + 2)) AS s FROM d, (SELECT DISTINCT n FROM win) WHERE len(w) >= n),
occ AS (SELECT k, s, pos.n, item_id FROM pos JOIN win ON win.n = pos.n AND g = array_to_string(w[s : s + pos.n - 1], ' ')),
hit AS (SELECT k, count(DISTINCT p) AS n_hit FROM (SELECT k, unnest(range(s, s + n)) AS p FROM occ) GROUP BY k),
held AS (SELECT k, count(*) AS n_items, string_agg(x, ',' ORDER BY x) AS xs FROM (SELECT DISTINCT k, CAST(item_id AS VARCHAR) AS x FROM occ) GROUP BY k)
SELECT doc_id, CAST(len(w) AS BIGINT) AS n_words, CAST(coalesce(n_hit, 0) AS BIGINT) AS n_hit, CAST(coalesce(n_items, 0) AS BIGINT) AS n_items, sha256(coalesce(xs, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated
FROM d LEFT JOIN hit USING (k) LEFT JOIN held USING (k)
"""

FIM_SQL = """
WITH t AS (SELECT doc_id, coalesce(text, '') AS x, sha256(concat('1:', CAST(doc_id AS VARCHAR))) AS h FROM documents),
u AS (
  SELECT doc_id, x, CAST(length(x) AS BIGINT) AS n, CAST(concat('0x', h[1:8]) AS BIGINT) AS h1, CAST(concat('0x', h[9:16]) AS BIGINT) AS h2,
    CAST(concat('0x', h[17:24]) AS BIGINT) AS h3, CAST(concat('0x', h[25:32]) AS BIGINT) AS h4
  FROM t
), c AS (
  SELECT *, least(h1 % (n + 1), h2 % (n + 1)) AS a, greatest(h1 % (n + 1), h2 % (n + 1)) AS b,
    CASE WHEN n = 0 OR contains(x, '<P>') OR contains(x, '<S>') OR contains(x, '<M>') OR h3 % 100 >= 90 THEN 'plain' WHEN h4 % 100 < 20 THEN 'spm' ELSE 'psm' END AS form
  FROM u
), p AS (SELECT *, substring(x, 1, a) AS prefix, substring(x, a + 1, b - a) AS middle, substring(x, b + 1, n - b) AS suffix FROM c)
SELECT doc_id, n, form, CASE WHEN form <> 'plain' THEN a END AS prefix_chars, CASE WHEN form <> 'plain' THEN b - a END AS middle_chars,
  sha256(CASE form WHEN 'plain' THEN x WHEN 'psm' THEN concat('<P>', prefix, '<S>', suffix, '<M>', middle) ELSE concat('<S>', suffix, '<P>', prefix, '<M>', middle) END) AS output_sha256,
  sha256(x) AS restored_sha256
FROM p
"""


def oracle_sql() -> dict[str, str]:
    return {"op4_exact_topk": TOPK_SQL, "op11_wand_search": LEXICAL_SQL, "op12_positional_decontamination": LEAKS_SQL, "op13_rank_select_fim": FIM_SQL}
