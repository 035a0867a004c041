"""Operator 5: mixing sources to target weights with soft membership, in DataFrame operations only.

Domains are the classes of a labelled table. A naive Bayes classifier over each document's words and a few discrete
traits (source, language, size, length of lines, share of symbols, of repeated words, of bars and exclamation marks)
predicts a posterior over the domains, so that documents without a label, and documents between domains, belong to each
domain in part. Words are hashed to ``BUCKETS`` features, present or absent in a document; only features that tell
domains apart are kept, so the table of weights has a bounded size, whatever the input.

Projected gradient descent then fits a rate for each document, between ``least`` and ``most``, whose expected domain token
totals are nearest to the targets, in squares weighted by one over each domain's expected tokens: the gradient for a
document is its posterior times the domains' residuals, summed over all documents in each step. Rates stay in a
distributed table; each step sends as many numbers to the driver as there are domains.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lumenkb.session import materialize

#: Features of words, and of traits.
BUCKETS, TRAITS = 1 << 18, 1 << 12
ENDS = ".,;:!?\"'()[]*%&#$|-"


def _bucket(share: Column, edges: list[float]) -> Column:
    """How many of ``edges`` a share reaches."""
    return sum((F.when(share >= e, 1).otherwise(0) for e in edges[1:]), F.when(share >= edges[0], 1).otherwise(0)).cast("string")


def keyed(docs: DataFrame) -> list[Column]:
    """128 bits of what a document's posterior depends on, and of its doc_id."""
    of = [F.col("doc_id").cast("long"), F.col("text").cast("string"), F.col("source").cast("string"), F.col("lang").cast("string")]
    # a null must not stand for its neighbour
    of += [F.concat_ws("", *[F.col(c).isNull().cast("string") for c in ("doc_id", "text", "source", "lang")])]
    return [F.xxhash64(*of), F.xxhash64(F.lit(1), *of)]


def featured(docs: DataFrame) -> DataFrame:
    """k1, k2, doc_id, tokens (words) and feature, a row for each feature of each row of ``docs``; feature null once a row."""
    keys = keyed(docs)
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    docs = docs.select(keys[0].alias("k1"), keys[1].alias("k2"), F.col("doc_id").cast("long").alias("doc_id"), F.col("source").cast("string").alias("source"), F.col("lang").cast("string").alias("lang"), text.alias("text"))
    n = F.length("text")
    gone = lambda *chars: sum((n - F.length(F.replace("text", F.lit(c), F.lit(""))) for c in chars[1:]), n - F.length(F.replace("text", F.lit(chars[0]), F.lit(""))))
    some = F.greatest(n, F.lit(1))
    words = F.array_remove(F.split(F.replace(F.lower("text"), F.lit("\n"), F.lit(" ")), " "), "")
    docs = docs.select("k1", "k2", "doc_id", "source", "lang", n.alias("n"), gone("\n").alias("feeds"), (gone("%", "&", "#", "*", "$") / some).alias("symbols"), (gone("|", "!") / some).alias("bars"), F.size(words).alias("tokens"), F.array_distinct(words).alias("words"))
    traits = {
        "source": F.coalesce("source", F.lit("")),
        "lang": F.coalesce("lang", F.lit("")),
        "size": F.least(F.floor(F.log2(F.greatest("n", F.lit(1)))), F.lit(20)).cast("string"),
        "line": _bucket(F.col("n") / (F.col("feeds") + 1), [16, 64, 256, 1024]),
        "symbol": _bucket(F.col("symbols"), [0.002, 0.01, 0.05]),
        "repeat": _bucket(F.size("words") / F.greatest("tokens", F.lit(1)), [0.1, 0.3, 0.5, 0.8]),
        "bar": _bucket(F.col("bars"), [0.002, 0.01]),
    }
    trait = lambda name: F.concat(F.lit(f"\n{name}="), traits[name])
    rows = docs.select("k1", "k2", "doc_id", F.col("tokens").cast("long").alias("tokens"), F.explode(F.concat(F.array(F.lit("\n"), *map(trait, traits)), F.col("words"))).alias("word"))
    name = F.rtrim("word", F.lit(ENDS))
    feature = F.when(F.col("word") == "\n", None).when(F.substring("word", 1, 1) == "\n", -1 - F.pmod(F.xxhash64("word"), F.lit(TRAITS))).when(name != "", F.pmod(F.xxhash64(name), F.lit(BUCKETS)))
    return rows.select("k1", "k2", "doc_id", "tokens", feature.alias("feature"), (F.col("word") == "\n").alias("row")).where("row or feature is not null")


def weights_of(docs: DataFrame, marked: DataFrame, domains: list[str], limit: int, smooth: float, strength: float) -> tuple[DataFrame, list[float]]:
    """feature and w0, w1, ... (log odds of it in each domain), at most BUCKETS + TRAITS rows; and what each domain starts from.

    Learns from at most about ``limit`` labelled rows, picked by a hash of doc_id. A word is as much likelier
    in a domain as it occurs there more often than expected, with ``smooth`` documents added to both, and is kept if that is
    e to the ``strength`` in some domain, either way.
    """
    k = len(domains)
    rows = marked.where(F.col("domain").isin(domains))
    share = min(1.0, limit / max(1, rows.count()))
    # at most about ``limit`` narrow rows: safe to broadcast
    rows = rows.where(F.pmod(F.xxhash64(F.lit(5), "doc_id"), F.lit(1_000_000)) < int(share * 1_000_000))
    sample = docs.withColumn("_id", F.col("doc_id").cast("long")).join(F.broadcast(rows.withColumnRenamed("doc_id", "_id")), "_id")
    seen = _labelled(sample)
    one = lambda d: F.sum(F.when(F.col("domain") == d, F.col("n")).otherwise(0))
    counts = materialize(seen.groupBy("feature").agg(*[one(d).alias(f"c{i}") for i, d in enumerate(domains)]), "counts")
    total = counts.where(F.col("feature").isNull()).first()
    number = [float(total[f"c{i}"] or 0) if total else 0.0 for i in range(k)]
    whole = sum(number) + k
    start = [math.log((x + 1) / whole) for x in number]
    c = [F.col(f"c{i}") for i in range(k)]
    chance_all = (sum(c[1:], c[0]) + 0.5) / (sum(number) + 1.0)
    many = max(1.0, sum(number))
    chance = [chance_all * (c[i] + smooth) / (sum(c[1:], c[0]) * (number[i] / many) + smooth) for i in range(k)]
    told = F.greatest(*[F.abs(F.log(x / chance_all)) for x in chance], F.lit(0.0))
    words = counts.where("feature >= 0").where(told >= strength).select("feature", *[F.least(chance[i], F.lit(0.999)).alias(f"q{i}") for i in range(k)])
    words = materialize(words, "words")
    absent = words.agg(*[F.sum(F.log(1 - F.col(f"q{i}"))).alias(f"q{i}") for i in range(k)]).first()
    start = [s + float(absent[f"q{i}"] or 0) for i, s in enumerate(start)]
    odds = words.select("feature", *[F.log(F.col(f"q{i}") / (1 - F.col(f"q{i}"))).alias(f"w{i}") for i in range(k)])
    traits = counts.where("feature < 0").select("feature", *[F.log((c[i] + 1) / (number[i] + 8)).alias(f"w{i}") for i in range(k)])
    return materialize(odds.union(traits), "weights"), start


def _labelled(sample: DataFrame) -> DataFrame:
    """domain, feature, n: how many documents of the sample have a feature; a null feature counts documents."""
    label = sample.select(*[x.alias(n) for x, n in zip(keyed(sample), ("k1", "k2"), strict=True)], "domain").groupBy("k1", "k2", "domain").agg(F.count(F.lit(1)).alias("times"))
    have = featured(sample.select("doc_id", "text", "source", "lang").distinct()).select("k1", "k2", "feature").distinct()
    return have.join(label, ["k1", "k2"]).groupBy("domain", "feature").agg(F.sum("times").alias("n"))


def posteriors(docs: DataFrame, weights: DataFrame, start: list[float]) -> DataFrame:
    """k1, k2, doc_id, tokens, n (equal rows) and p, an array of the domains' posteriors in their order."""
    k = len(start)
    rows = featured(docs).join(F.broadcast(weights), "feature", "left").where("row or w0 is not null")  # BUCKETS + TRAITS rows at most
    sums = rows.groupBy("k1", "k2", "doc_id", "tokens").agg(F.sum(F.col("row").cast("long")).alias("n"), *[F.sum(F.coalesce(f"w{i}", F.lit(0.0))).alias(f"s{i}") for i in range(k)])
    # equal rows have added the same sums
    logs = sums.select("k1", "k2", "doc_id", "tokens", "n", F.array(*[F.col(f"s{i}") / F.col("n") + start[i] for i in range(k)]).alias("logs"))
    raw = logs.withColumn("raw", F.transform("logs", lambda x: F.exp(x - F.array_max("logs"))))
    total = F.aggregate("raw", F.lit(0.0), lambda a, x: a + x)
    return raw.select("k1", "k2", "doc_id", "tokens", "n", F.transform("raw", lambda x: x / total).alias("p"))


def _moved(state: Column, moves: list[list[float]], least: float, most: float) -> Column:
    """The rate and the one before it after the moves (momentum, then a number for each domain), which are data of the plan, not parts of it, so that the plan doesn't grow with them."""
    dot = lambda m: F.aggregate(F.zip_with("p", F.slice(m, 2, len(moves[0])), lambda a, b: a * b), F.lit(0.0), lambda a, x: a + x)
    step = lambda r, m: F.array(F.greatest(F.lit(least), F.least(F.lit(most), r[0] + m[0] * (r[0] - r[1]) - dot(m))), r[0])
    return F.aggregate(F.array(*[F.array(*map(F.lit, m)) for m in moves]), state, step) if moves else state


def fit_rates(rows: DataFrame, targets: list[float], held: list[float], least: float, most: float, tolerance: float, limit: int = 400) -> tuple[DataFrame, list[list[float]]]:
    """``rows`` (p, tokens, n, any other columns) with rate, and the domain totals before each step.

    A step is r <- clip(y - sum of p_k (total_k(y) - target_k) / held_k), ``held`` being the totals at a rate of one: in
    coordinates in which a token of any document weighs the same, the gradient of the weighted squares over their largest
    possible curvature. y is r, carried on by Nesterov's momentum, which starts anew when the squares grow. It ends when
    no residual is above ``tolerance`` times the targets' sum, or no total has moved by that in eight steps.
    Raises if neither happens within ``limit`` steps.
    """
    k = len(targets)
    scale = max(1.0, sum(targets))
    first = F.lit(float(min(max(1.0, least), most)))
    base, state, moves, history, age, before = rows, F.array(first, first), [], [], 0, math.inf
    for _ in range(limit):
        momentum = age / (age + 3.0)
        now = base.withColumn("_state", _moved(state, moves, least, most)).withColumn("rate", F.element_at("_state", 1))
        ahead = F.col("rate") + momentum * (F.col("rate") - F.element_at("_state", 2))
        of = lambda rate: [F.sum(rate * F.col("tokens") * F.col("n") * F.element_at("p", i + 1)) for i in range(k)]
        got = now.agg(*[x.alias(f"t{i}") for i, x in enumerate(of(F.col("rate")))], *[x.alias(f"y{i}") for i, x in enumerate(of(ahead))]).first()
        totals, away = ([float(got[f"{c}{i}"] or 0) for i in range(k)] for c in "ty")
        history.append(totals)
        moved = max((abs(a - b) for a, b in zip(totals, history[-9], strict=True)), default=0.0) if len(history) > 8 else math.inf
        if max((abs(a - b) for a, b in zip(totals, targets, strict=True)), default=0.0) <= tolerance * scale or moved <= tolerance * scale:
            return now.drop("_state"), history
        squares = sum((a - b) ** 2 / max(1.0, h) for a, b, h in zip(totals, targets, held, strict=True))
        if squares > before:
            age, momentum, away = 0, 0.0, totals
        age, before = age + 1, squares
        moves.append([momentum, *((y - b) / max(1.0, h) for y, b, h in zip(away, targets, held, strict=True))])
        if len(moves) == 8:
            base = materialize(base.withColumn("_held", _moved(state, moves, least, most)).drop("_last").withColumnRenamed("_held", "_last"), "rates")
            state, moves = F.col("_last"), []
    raise RuntimeError(f"rates did not settle in {limit} steps")


def key_rates(docs: DataFrame, labels: DataFrame, domain: Column, weights: dict[str, float], total_share: float | None, least: float, most: float, tolerance: float, headroom: float, limit: int) -> tuple[DataFrame, dict[str, tuple[float, float]]]:
    """k1, k2, doc_id, tokens, n, p, rate; and for each domain its target and what the rates give."""
    domains = list(weights)
    marked = labels.select(F.col("doc_id").cast("long").alias("doc_id"), domain.cast("string").alias("domain")).dropna()
    table, start = weights_of(docs, marked, domains, limit, 8.0, 1.2)
    rows = materialize(posteriors(docs, table, start), "posteriors")
    held = rows.agg(*[F.sum(F.col("tokens") * F.col("n") * F.element_at("p", i + 1)).alias(f"t{i}") for i in range(len(domains))]).first()
    held = [float(held[f"t{i}"] or 0) for i in range(len(domains))]
    whole = sum(weights.values()) or 1.0
    share = [weights[d] / whole for d in domains]
    total = total_share * sum(held) if total_share is not None else headroom * min((most * h / s for h, s in zip(held, share, strict=True) if s > 0), default=0.0)
    targets = [total * s for s in share]
    rated, history = fit_rates(rows, targets, held, least, most, tolerance)
    return rated, dict(zip(domains, zip(targets, history[-1], strict=True), strict=True))


def document_rates(docs: DataFrame, labels: DataFrame, domain: Column, weights: dict[str, float], total_share: float | None = None, least: float = 0.0, most: float = 1.0, tolerance: float = 1e-4, headroom: float = 1.0, limit: int = 20_000) -> DataFrame:
    """doc_id, tokens (words), p (posteriors, in the order of ``weights``), rate of each row of ``docs`` (doc_id, text, source, lang).

    ``labels``: doc_id and the columns of ``domain``, an expression that names a row's domain (null: not labelled).
    ``weights``: the target share of tokens of each domain. ``total_share``: the target total as a share of all tokens;
    unset, ``headroom`` times the largest at which no domain must grow beyond ``most`` times its expected tokens.
    ``limit``: labelled rows that the classifier learns from, about.
    Null texts count as empty, null sources and languages as values of their own. Rows that repeat are rated alike; a
    doc_id labelled twice counts twice in training. Without labels all posteriors are equal. An empty table gives no rows.
    Texts are read whole, at any length.
    """
    rated, _ = key_rates(docs, labels, domain, weights, total_share, least, most, tolerance, headroom, limit)
    return rated.withColumn("_n", F.explode(F.sequence(F.lit(1), F.col("n").cast("int")))).select("doc_id", "tokens", "p", "rate")


def mix(docs: DataFrame, labels: DataFrame, domain: Column, weights: dict[str, float], seed: int = 23, total_share: float | None = None, least: float = 0.0, most: float = 1.0, tolerance: float = 1e-4, headroom: float = 1.0, limit: int = 20_000) -> DataFrame:
    """The rows of ``docs``, each floor(rate) times and once more with a chance of what is left, by a hash of doc_id and text.

    The same rows in any order give the same result. Columns of ``docs`` are kept; see ``document_rates`` for the rest.
    """
    rated, _ = key_rates(docs, labels, domain, weights, total_share, least, most, tolerance, headroom, limit)
    luck = F.pmod(F.xxhash64(F.lit(seed), F.col("doc_id").cast("long"), F.col("text").cast("string")), F.lit(1 << 40)) / float(1 << 40)
    keys = keyed(docs)
    rows = docs.withColumn("_k1", keys[0]).withColumn("_k2", keys[1]).join(rated.select(F.col("k1").alias("_k1"), F.col("k2").alias("_k2"), F.col("rate").alias("_rate")), ["_k1", "_k2"])
    times = (F.floor("_rate") + F.when(luck < F.col("_rate") - F.floor("_rate"), 1).otherwise(0)).cast("int")
    return rows.withColumn("_times", times).where("_times > 0").withColumn("_n", F.explode(F.sequence(F.lit(1), F.col("_times")))).select(*[F.col(c) for c in docs.columns])
