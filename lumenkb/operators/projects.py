"""Which project a query is about: identifiers and their aliases, then looser matches, then what searches find."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lumenkb.functions.text import is_subsequence
from lumenkb.session import materialize

#: Endings that notes about a project add to its name, in the order tried (fixed values).
MARKERS = ["-phase-", "-phase", "-audit", "-live-", "-live", "-review", "-debug", "-session", "-spec", "-tickets"]
#: Tags that say nothing of a project (fixed values).
GENERIC = ["project", "active"]
#: Cosine distance within which a vector's note still counts (fixed value).
NEAR = 0.35
#: Characters that words are looked up by.
HEAD = 6
TIERS = ["exact", "match", "subsequence", "text", "vector"]


def normalized(name: Column) -> Column:
    """An identifier in lower case, its words parted by single spaces; characters other than letters, digits and separators go."""
    parted = F.regexp_replace(F.lower(name), r"[-_/:.\s\p{Z}]+", " ")
    return F.trim(F.regexp_replace(F.regexp_replace(parted, r"[^\p{L}\p{N} ]", ""), " +", " "))


def derived_aliases(stem: Column) -> Column:
    """Names of a project that the file name of a note about it gives: without its date, and without each ending of MARKERS."""
    bare = F.regexp_replace(F.regexp_replace(F.trim(stem), r"(\.md)+$", ""), r"^\d{4}-\d{2}-\d{2}-", "")
    cut = [F.regexp_replace(F.substring_index(bare, m, 1), "^-+|-+$", "") for m in MARKERS]
    found = F.array(bare, *[F.when(bare.contains(m), x) for m, x in zip(MARKERS, cut, strict=True)])
    return F.when(bare == "", F.array().cast("array<string>")).otherwise(F.array_distinct(F.filter(found, lambda x: x.isNotNull() & (x != ""))))


def harvested(projects: DataFrame, backlinks: DataFrame) -> DataFrame:
    """``projects`` (project, more) with derived: the aliases that the file names of notes which link to them give. ``backlinks``: project, stem."""
    names = backlinks.select("project", F.explode(derived_aliases(F.col("stem"))).alias("alias")).distinct()
    names = names.groupBy("project").agg(F.array_sort(F.collect_list("alias")).alias("derived"))
    return projects.join(names, "project", "left").withColumn("derived", F.coalesce("derived", F.array().cast("array<string>")))


def _words(norm: Column) -> Column:
    return F.filter(F.split(norm, " "), lambda x: x != "")


def _name(x: Column, q: Column, q_lower: Column, q_words: Column) -> Column:
    """Whether a name (lower, norm, words) matches a query: equal, one in the other's beginning, the query within it, or all words of one among the other's."""
    begins = x["lower"].startswith(q_lower) | x["norm"].startswith(q) | ((F.octet_length(x["norm"]) >= 3) & q.startswith(x["norm"]))
    subset = (F.size(F.array_except(q_words, x["words"])) == 0) | ((F.size(F.array_except(x["words"], q_words)) == 0) & (F.size(x["words"]) >= 2))
    return (x["norm"] == q) | begins | x["lower"].contains(q_lower) | x["norm"].contains(q) | ((F.size(x["words"]) > 0) & subset)


def _tag(x: Column, q: Column, q_lower: Column, q_words: Column) -> Column:
    return (x["norm"] == q) | (x["lower"] == q_lower) | x["norm"].startswith(q) | ((F.size(x["words"]) > 0) & (F.size(F.array_except(q_words, x["words"])) == 0))


def matches(q: Column, q_lower: Column, q_words: Column) -> Column:
    """Whether a project (names, tags, every: their normalised forms) matches a query at all, its words taken together at the loosest."""
    named = F.exists("names", lambda x: _name(x, q, q_lower, q_words))
    tagged = F.exists("tags", lambda x: _tag(x, q, q_lower, q_words))
    covered = F.forall(q_words, lambda w: F.exists("every", lambda n: n.contains(w)))
    return (F.size(q_words) > 0) & (named | tagged | (covered & F.exists("every", lambda n: n != "")))


def prepared(names: Column) -> Column:
    """lower, norm and words of each name."""
    norms = F.transform(names, lambda x: F.struct(F.lower(x).alias("lower"), normalized(x).alias("norm")))
    return F.transform(norms, lambda x: F.struct(x["lower"].alias("lower"), x["norm"].alias("norm"), _words(x["norm"]).alias("words")))


def _first(rows: DataFrame, *by: str) -> DataFrame:
    """``by`` and first: the path and project that come first."""
    first = F.struct("path", "project") if "path" in rows.columns else F.col("first")
    return rows.groupBy(*by).agg(F.min(first).alias("first"))


def _exact(asked: DataFrame, known: DataFrame) -> DataFrame:
    """query_id, first: of the projects with a name that is the query."""
    named = lambda by, keys: F.transform(keys, lambda x: F.struct(F.lit(by).alias("by"), x.alias("key")))
    norms = F.array(normalized(F.col("stem")), normalized(F.coalesce("title", F.lit(""))))
    names = _first(known.select("project", "path", F.inline(F.concat(named("lower", F.transform("own", lambda x: F.lower(x))), named("norm", norms)))), "by", "key")
    keys = F.concat(named("lower", F.array("q_lower")), named("norm", F.array("q")))
    return _first(asked.select("query_id", F.inline(keys)).join(names, ["by", "key"]), "query_id")


def _match(asked: DataFrame, known: DataFrame) -> DataFrame:
    """query_id, first: of the projects that ``matches`` holds for. ``asked`` has words.

    It holds where each word of the query is part of a word of the project, where a name begins the query, and where all
    words of a name are words of the query; its other cases are among the first of these.
    """
    asked = asked.withColumn("words", F.array_sort(F.array_distinct("q_words")))
    heard = materialize(known.select("row", "path", "project", F.explode(F.array_distinct(F.flatten(F.transform("every", _words)))).alias("name")), "project-words")
    firsts = _first(heard, "name")
    words = asked.select(F.explode("words").alias("word")).distinct()
    # a word stands in another where the other has a part that begins it
    parts = F.flatten(F.transform(F.sequence(F.lit(1), F.least(F.length("name"), F.lit(HEAD))), lambda n: F.transform(F.sequence(F.lit(1), F.length("name") - n + 1), lambda i: F.substring(F.col("name"), i, n))))
    parts = firsts.select("name", F.explode(F.array_distinct(parts)).alias("head"))
    holds = parts.join(words.withColumn("head", F.substring("word", 1, HEAD)), "head").where(F.col("name").contains(F.col("word")))
    holds = materialize(holds.select("word", "name"), "words-in-words")
    single = _first(holds.join(firsts, "name"), "word")
    single = asked.where(F.size("words") == 1).select("query_id", F.get("words", 0).alias("word")).join(single, "word").select("query_id", "first")

    several = asked.where(F.size("words") > 1)
    wanted = several.select(F.explode("words").alias("word")).distinct()
    places = materialize(holds.join(wanted, "word").join(heard.select("row", "name"), "name").select("word", "row").distinct(), "places-of-words")
    df = places.groupBy("word").agg(F.count(F.lit(1)).alias("n"))
    rarest = several.select("query_id", F.size("words").alias("of"), F.explode("words").alias("word")).join(df, "word").groupBy("query_id", "of").agg(F.array_sort(F.collect_list(F.struct("n", "word"))).alias("x"))
    rarest = rarest.where(F.size("x") == F.col("of")).select("query_id", "of", F.get("x", 0)["word"].alias("word"), F.get("x", 1)["word"].alias("second"))
    rarest = materialize(rarest, "rarest-words")
    pairs = materialize(rarest.select("word", "second").distinct().join(places, "word"), "places-of-rarest")
    both = materialize(pairs.join(places.withColumnRenamed("word", "second"), ["second", "row"]), "places-of-both")
    two = _first(both.join(known.select("row", "path", "project"), "row"), "word", "second")
    two = rarest.where("of = 2").join(two, ["word", "second"]).select("query_id", "first")
    more = rarest.where("of > 2").join(both, ["word", "second"]).select("query_id", "row").join(asked, "query_id").join(known, "row")
    more = _first(more.where(matches(F.col("q"), F.col("q_lower"), F.col("q_words"))), "query_id")

    names = known.select("project", "path", F.inline("names")).groupBy("norm").agg(F.min(F.struct("path", "project")).alias("first"))
    names = materialize(names.withColumn("name_words", _words(F.col("norm"))), "project-names")
    begins = asked.select("query_id", "q", F.explode(F.sequence(F.lit(1), F.length("q"))).alias("n")).select("query_id", F.expr("substring(q, 1, n)").alias("norm"))
    begins = _first(begins.join(names.where(F.octet_length("norm") >= 3), "norm"), "query_id")
    # a name whose words are all asked for is looked up by the one that the fewest queries have
    often = asked.select(F.explode("words").alias("word")).groupBy("word").agg(F.count(F.lit(1)).alias("n"))
    own = F.array_distinct("name_words")
    within = names.where(F.size("name_words") >= 2).select("norm", "name_words", "first", F.size(own).alias("of"), F.explode(own).alias("word")).join(often, "word")
    within = within.groupBy("norm", "of").agg(F.count(F.lit(1)).alias("n"), F.min(F.struct("n", "word")).alias("x"), F.first("name_words").alias("name_words"), F.first("first").alias("first")).where("n = of")
    within = within.select(F.col("x.word").alias("word"), "name_words", "first").join(asked.select("query_id", "words", F.explode("words").alias("word")), "word")
    within = _first(within.where(F.size(F.array_except("name_words", "words")) == 0), "query_id")
    return _first(reduce(DataFrame.unionByName, [single, two, more, begins, within]), "query_id")


def _subsequence(asked: DataFrame, known: DataFrame) -> DataFrame:
    """query_id, first: of the projects whose stem has the query's letters in their order.

    They meet by the two letters, one after the other in the query, that the fewest stems have in this order.
    """
    letters = lambda x: F.regexp_extract_all(F.lower(x), F.lit("(?s)."), F.lit(0))
    stems = _first(known, "stem").withColumn("x", letters(F.col("stem")))
    pairs = F.flatten(F.transform("x", lambda c, i: F.transform(F.slice("x", i + 2, F.size("x")), lambda d: F.concat(c, d))))
    stems = materialize(stems.select("stem", "first", F.explode(F.array_distinct(F.concat("x", pairs))).alias("key")), "letters-of-stems")
    df = stems.groupBy("key").agg(F.count(F.lit(1)).alias("n"))
    keys = F.when(F.size("x") == 1, F.col("x")).otherwise(F.zip_with(F.expr("slice(x, 1, size(x) - 1)"), F.expr("slice(x, 2, size(x))"), lambda c, d: F.concat(c, d)))
    rarest = asked.select("query_id", "q_lower", letters(F.col("q_lower")).alias("x")).select("query_id", "q_lower", F.explode(keys).alias("key")).join(df, "key", "left")
    rarest = rarest.groupBy("query_id", "q_lower").agg(F.min(F.struct(F.coalesce("n", F.lit(0)).alias("n"), "key")).alias("x")).where("x.n > 0")
    rarest = materialize(rarest.select("query_id", "q_lower", F.col("x.key").alias("key")), "rarest-letters")
    met = stems.join(rarest, "key").where(F.length("stem") >= F.length("q_lower"))
    return _first(met.where(is_subsequence(F.col("q_lower"), F.col("stem"))), "query_id")


def find_projects(queries: DataFrame, projects: DataFrame, text_hits: DataFrame, vector_hits: DataFrame) -> DataFrame:
    """query_id, project, tier: the project of each query that has one, by the first tier of TIERS that finds any.

    ``queries``: query_id, query. ``projects``: project (id), path, title, slug, aliases, derived, tags; the first by path
    counts within the first three tiers. ``text_hits``: query_id, project, rank, and ``vector_hits``: query_id, project,
    rank, distance, from searches; the best rank counts, vectors within NEAR only. exact: stem, title, slug or an alias is
    the query. match: see ``matches``. subsequence: the query's letters stand in the stem in their order.

    Equal queries are tried once, and a later tier only tries what the ones before it left. No query is tried on all projects:
    names are looked up by the query or by how it begins, words by the words that hold them, and queries of several words
    by their two rarest ones. Empty queries find nothing.
    """
    stem = F.regexp_replace(F.regexp_replace("path", "^.*/", ""), r"(?<=.)\.[^.]*$", "")
    none = F.array().cast("array<string>")
    own = F.filter(F.concat(F.array(stem, F.col("title"), F.col("slug")), F.coalesce("aliases", none)), lambda x: x.isNotNull())
    tags = F.filter(F.coalesce("tags", none), lambda x: ~F.lower(x).isin(GENERIC))
    known = projects.select("project", "path", stem.alias("stem"), "title", own.alias("own"), prepared(F.concat(own, F.coalesce("derived", none))).alias("names"), prepared(tags).alias("tags"))
    known = known.withColumn("every", F.array_distinct(F.transform(F.concat("names", "tags"), lambda x: x["norm"])))
    known = materialize(known.withColumn("row", F.monotonically_increasing_id()), "projects")
    asked = queries.select("query_id", F.trim("query").alias("query")).where("query <> ''")
    asked = asked.select("query_id", F.lower("query").alias("q_lower"), normalized(F.col("query")).alias("q")).withColumn("q_words", _words(F.col("q")))
    every = materialize(asked, "asked-projects")
    # names answer equal queries alike, so each is tried once; its text is its id until then
    asked = materialize(every.select(F.col("q_lower").alias("query_id"), "q_lower", "q", "q_words").distinct(), "asked-once")
    exact = materialize(_exact(asked, known), "exact-projects")
    asked = materialize(asked.join(exact, "query_id", "left_anti"), "asked-of-names")
    match = materialize(_match(asked.where(F.size("q_words") > 0), known), "matching-projects")
    loose = _subsequence(materialize(asked.join(match, "query_id", "left_anti"), "asked-of-letters"), known)

    tier = lambda df, n, order: df.select("query_id", "project", F.lit(n).alias("tier"), order.alias("order"))
    by_path = F.struct(F.lit(0).cast("long").alias("rank"), F.col("path"))
    names = [tier(df.select("query_id", "first.*"), n, by_path) for n, df in enumerate([exact, match, loose])]
    by_rank = F.struct(F.col("rank").cast("long").alias("rank"), F.lit("").alias("path"))
    texts, near = (h.join(known.select("project"), "project", "left_semi") for h in (text_hits, vector_hits.where(F.col("distance") <= NEAR)))
    best_of = lambda rows: rows.groupBy("query_id").agg(F.min(F.struct("tier", "order", "project")).alias("x"))
    named = best_of(reduce(DataFrame.unionByName, names))
    named = every.join(materialize(named.withColumnRenamed("query_id", "q_lower"), "named-projects"), "q_lower").select("query_id", "x.*")
    searched = tier(texts, 3, by_rank).unionByName(tier(near, 4, by_rank)).join(every.select("query_id"), "query_id", "left_semi")
    best = best_of(named.unionByName(searched))
    return best.select("query_id", F.col("x.project").alias("project"), F.element_at(F.array(*map(F.lit, TIERS)), F.col("x.tier") + 1).alias("tier"))
