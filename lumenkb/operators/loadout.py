"""Which cards a task needs, and a text of them within a budget of tokens."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lumenkb.functions.text import CJK
from lumenkb.operators.search import small_batch

#: Tokens that cards may fill, tokens that no text reaches, and cards of a text (fixed values).
BUDGET, BOUND, MOST_CARDS = 280, 300, 4
#: Headings of a card's concept, in lower case (fixed values).
CONCEPT = ["core concept", "summary", "核心概念", "核心结论"]

TITLE, SCOPE, CARDS, LOGS = "# Loadout: %s [diff-aware]", "> **Scope**: %s", "## Knowledge and constraints (L3)", "## Recent decisions (L2)"
NO_CARDS, NO_LOGS = "- *(no rule or decision matches these modules)*", "- *(no recent log)*"
PROTOCOL = ["## Protocol", "1. Audit the diff before a commit; a note that replaces a decision names it."]


def card_concept(body: Column) -> Column:
    """What a card is about in one line of at most about 100 characters, or null.

    The quote, else the text, under the first heading that says so and has some; else the first quote; else the first
    paragraph after a heading. Callout marks aren't part of a quote.
    """
    lines = F.transform(F.split(body, "\r?\n", -1), lambda x: F.regexp_replace(x, r"(?U)^\s+|\s+$", ""))
    heading = lambda x: x.startswith("#")
    empty = F.array().cast("array<string>")
    state = F.struct(F.lit(False).alias("seen"), F.lit(False).alias("over"), empty.alias("said"))

    def fold(xs: Column, step) -> Column:
        return F.aggregate(xs, state, lambda s, x: F.when(s["over"], s).otherwise(step(s, x)))["said"]

    def of(seen, over, said) -> Column:
        return F.struct(seen.alias("seen"), over.alias("over"), said.alias("said"))

    def quoted(s: Column, x: Column, ends: Column) -> Column:
        text = F.trim(F.regexp_replace(x, "^>+", ""))
        more = F.when(text.startswith("[!") | (text == ""), s["said"]).otherwise(F.concat(s["said"], F.array(text)))
        return F.when(x.startswith(">"), of(F.lit(True), F.lit(False), more)).otherwise(of(s["seen"], ends, s["said"]))

    def under(i: Column) -> Column:
        rest = F.slice(lines, i + 2, F.size(lines))
        to = F.array_position(F.transform(rest, heading), True).cast("int")
        section = F.when(to > 0, F.slice(rest, F.lit(1), to - 1)).otherwise(rest)
        quote = fold(section, lambda s, x: quoted(s, x, F.size(s["said"]) > 0))
        return F.when(F.size(quote) > 0, quote).otherwise(F.filter(section, lambda x: x != ""))

    tells = lambda x: heading(x) & F.lower(x).rlike("|".join(CONCEPT))
    places = F.filter(F.transform(lines, lambda x, i: F.when(tells(x), i)), lambda i: i.isNotNull())
    told = F.filter(F.transform(places, under), lambda x: F.size(x) > 0)
    first_quote = fold(lines, lambda s, x: quoted(s, x, s["seen"]))

    def paragraph(s: Column, x: Column) -> Column:
        begun = F.size(s["said"]) > 0
        at_heading = of(F.lit(True), s["seen"] & begun, s["said"])
        return F.when(heading(x), at_heading).when(s["seen"] & (x == ""), of(s["seen"], begun, s["said"])).when(s["seen"], of(s["seen"], F.lit(False), F.concat(s["said"], F.array(x)))).otherwise(s)

    found = F.coalesce(F.get(told, 0), F.when(F.size(first_quote) > 0, first_quote), fold(lines, paragraph))
    text = F.trim(F.array_join(found, " "))
    return F.when(F.length(text) > 100, F.concat(F.rtrim(F.substring(text, 1, 90)), F.lit("..."))).otherwise(F.nullif(text, F.lit("")))


def keyword_hits(cards: DataFrame, words: DataFrame) -> DataFrame:
    """query_id, doc_id, score of the cards that a keyword of a query stands in.

    ``cards``: doc_id, name, path, concept. ``words``: query_id, keywords (distinct within a query, in lower case). 20 for
    a keyword that is the name, 10 for one in it, 4 in the path, 3 in the concept; keywords of one byte don't count.
    Cards and keywords meet where a card holds the keyword's first three characters, so not each with each.
    """
    asked = words.select("query_id", F.explode("keywords").alias("k")).where(F.octet_length("k") > 1)
    keys = asked.select("k", F.substring("k", 1, 3).alias("gram")).distinct()
    lower = cards.select("doc_id", *[F.lower(F.coalesce(c, F.lit(""))).alias(c) for c in ("name", "path", "concept")])
    text = F.concat_ws("\n", "name", "path", "concept")
    grams = F.concat(*[F.regexp_extract_all(text, F.lit(f"(?s)(?=({'.' * n}))"), F.lit(1)) for n in (1, 2, 3)])
    held = lower.select("doc_id", F.explode(F.array_distinct(grams)).alias("gram")).join(small_batch(keys), "gram").select("doc_id", "k")
    one = F.when(F.col("name") == F.col("k"), 20).when(F.col("name").contains(F.col("k")), 10).otherwise(0)
    one = one + F.when(F.col("path").contains(F.col("k")), 4).otherwise(0) + F.when(F.col("concept").contains(F.col("k")), 3).otherwise(0)
    rows = held.join(lower, "doc_id").select("doc_id", "k", one.alias("one")).where("one > 0")
    return rows.join(small_batch(asked), "k").groupBy("query_id", "doc_id").agg(F.sum("one").alias("score"))


def shortened(concept: Column) -> Column:
    """A concept for a line: 220 characters at most, but guards at its end stay whole, after at most 60 characters of prose."""
    at = F.call_function("locate", F.lit(" [Guard:"), concept)
    prose, guard = F.substring(concept, F.lit(1), at - 1), F.substring(concept, at, F.length(concept))
    with_guard = F.when(at - 1 > 60, F.concat(F.rtrim(F.substring(prose, 1, 60)), F.lit("..."), guard)).otherwise(concept)
    return F.when(at > 0, with_guard).when(F.length(concept) > 220, F.concat(F.substring(concept, 1, 217), F.lit("..."))).otherwise(concept)


def changes_line(modules: Column, n_files: Column) -> Column:
    """The line of what has changed: the first three modules' names, clamped, and the number of files."""
    clamped = F.transform(F.slice(modules, 1, 3), lambda m: F.concat(F.lit("`"), F.when(F.length(m) > 30, F.concat(F.substring(m, 1, 27), F.lit("..."))).otherwise(m), F.lit("`")))
    named = F.when(F.size(modules) > 0, F.array_join(clamped, ", ")).otherwise("various files")
    line = F.concat(F.lit("> **Active Changes**: "), F.greatest(F.least(F.size(modules), F.lit(3)), F.lit(1)).cast("string"), F.lit(" modified modules: "), named, F.lit(" ("), n_files.cast("string"), F.lit(" files)"))
    line = F.when(F.length(line) > 100, F.concat(F.substring(line, 1, 97), F.lit("..."))).otherwise(line)
    return F.when(n_files > 0, line).otherwise("> **Active Changes**: Clean working tree (no uncommitted changes)")


def solid(text: Column) -> tuple[Column, Column]:
    """How many characters of a text are neither white space nor CJK, and how many are CJK."""
    dense = F.regexp_replace(text, r"\s", "")
    other = F.length(F.regexp_replace(dense, CJK, ""))
    return other, F.length(dense) - other


def estimated(other: Column, cjk: Column) -> Column:
    return F.ceil(other / 4) + F.ceil(cjk * 2 / 3)


def loadout_texts(heads: DataFrame, cards: DataFrame) -> DataFrame:
    """query_id, n_cards, tokens, text: a text for each of ``heads``, of fewer than BOUND tokens.

    ``heads``: query_id, name, changes (a line), scope, logs (lines, the first ones matter more). ``cards``: query_id,
    rank (from 1), name, concept; nulls are empty. Cards are taken in their order as long as the text stays within
    BUDGET, at most MOST_CARDS; the first that doesn't fit ends it. Where not even the first fits, the scope is cut to 60
    characters for it. A text without cards that reaches BOUND loses logs, then its scope by and by, then its last lines.
    """
    line = F.concat(F.lit("- **[["), F.coalesce("name", F.lit("")), F.lit("]]**"), F.coalesce(F.concat(F.lit(": "), shortened(F.col("concept"))), F.lit("")))
    first = cards.where(F.col("rank") <= MOST_CARDS).select("query_id", "rank", line.alias("line"))
    first = first.groupBy("query_id").agg(F.transform(F.array_sort(F.collect_list(F.struct("rank", "line"))), lambda x: x["line"]).alias("lines"))  # MOST_CARDS at most
    rows = heads.select("query_id", "name", "changes", F.coalesce("scope", F.lit("")).alias("scope"), F.coalesce("logs", F.array().cast("array<string>")).alias("logs")).join(first, "query_id", "left")
    rows = rows.withColumn("lines", F.coalesce("lines", F.array().cast("array<string>")))

    def text(scope: Column, lines: Column, logs: Column) -> Column:
        some = lambda xs, none: F.when(F.size(xs) > 0, xs).otherwise(F.array(F.lit(none)))
        title = F.format_string(TITLE, F.coalesce("name", F.lit("")))
        top = F.array(title, F.coalesce("changes", F.lit("")), F.format_string(SCOPE, scope), F.lit(""), F.lit(CARDS))
        return F.array_join(F.concat(top, some(lines, NO_CARDS), F.array(F.lit(""), F.lit(LOGS)), some(logs, NO_LOGS), F.array(F.lit(""), *map(F.lit, PROTOCOL))), "\n")

    tokens = lambda x: estimated(*solid(x))
    short = F.substring(F.col("scope"), 1, 60)
    fits = lambda scope, n: (F.size("lines") >= n) & (tokens(text(scope, F.slice("lines", F.lit(1), F.lit(n)), F.col("logs"))) <= BUDGET)
    dotted = F.concat(short, F.lit("..."))
    rows = rows.withColumn("mode", F.when(fits(F.col("scope"), 1), "whole").when(fits(short, 1), "short").otherwise("none"))
    rows = rows.withColumn("scope", F.when(F.col("mode") == "short", dotted).otherwise(F.col("scope")))
    more = F.lit(1)
    for n in range(2, MOST_CARDS + 1):
        more = F.when(fits(F.col("scope"), n), n).otherwise(more)
    rows = rows.withColumn("n_cards", F.when(F.col("mode") == "none", 0).otherwise(more)).withColumn("lines", F.slice("lines", F.lit(1), F.col("n_cards")))

    fewer = F.transform(F.sequence(F.size("logs"), F.lit(0)), lambda n: text(F.col("scope"), F.col("lines"), F.slice("logs", F.lit(1), n)))
    none = F.array().cast("array<string>")
    tighter = F.array(*[text(F.substring(F.col("scope"), 1, n), F.col("lines"), none) for n in (40, 20, 0)])
    rows = rows.withColumn("tries", F.concat(fewer, tighter)).withColumn("text", F.get(F.filter("tries", lambda x: tokens(x) < BOUND), 0))
    last = F.split(F.element_at("tries", -1), "\n", -1)
    cut = F.filter(F.transform(F.sequence(F.size(last) - 1, F.lit(1)), lambda n: F.array_join(F.slice(last, F.lit(1), n), "\n")), lambda x: tokens(x) < BOUND)
    title = F.get(last, 0)
    bits = F.filter(F.transform(F.sequence(F.lit(1), F.ceil(F.length(title) / 10).cast("int") + 1), lambda i: F.substring(title, F.lit(1), F.greatest(F.length(title) - 10 * i, F.lit(0)))), lambda x: tokens(x) < BOUND)
    rows = rows.withColumn("text", F.coalesce("text", F.get(cut, 0), F.get(bits, 0)))
    return rows.select("query_id", F.col("n_cards").cast("long").alias("n_cards"), tokens(F.col("text")).cast("long").alias("tokens"), "text")
