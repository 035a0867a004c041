"""Conversations, logs, access events, hand-offs and timelines."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lumenkb.functions.text import estimate_tokens, line_count

LINE_LIMIT, TOKEN_LIMIT, HOT_TURNS = 20, 150, 5
WINDOW_TOKENS, SMART_LOW, SMART_HIGH = 128_000, 0.15, 0.60
#: What a turn says when a build or test run went well (fixed values); the second list in any case.
WENT_WELL = ["test result: ok", "Finished dev", "Finished release", "Build succeeded", "0 failed", "Passed"]
WENT_WELL_ANY_CASE = ["compilation succeeded", "resolved", "all tests passed"]


def succeeded(text: Column) -> Column:
    found = [text.contains(x) for x in WENT_WELL] + [F.lower(text).contains(x) for x in WENT_WELL_ANY_CASE]
    out = found[0]
    for f in found[1:]:
        out = out | f
    return out


def diagnostic(text: Column) -> Column:
    """What a turn says went wrong, or null: a compiler error with its place, the last error of a traceback, a package manager's, a C compiler's."""
    lines = F.transform(F.split(text, "\n", -1), lambda x: F.trim(x))
    code = lambda x: F.regexp_extract(x, r"(error\[E.*)$", 1)
    is_error = lambda x: x.contains("error[E") | x.startswith("error: ")
    at = F.array_position(F.transform(lines, is_error), True).cast("int")
    line = F.element_at(lines, at)
    place = F.filter(F.slice(lines, at + 1, 3), lambda x: x.startswith("-->"))
    summary = F.when(line.contains("error[E"), code(line)).otherwise(line)
    compiler = F.when(F.size(place) > 0, F.concat(summary, F.lit(" on "), F.trim(F.regexp_replace(F.element_at(place, 1), "^-->", "")))).otherwise(summary)
    raised = F.filter(lines, lambda x: x.contains("Error:") | x.contains("Exception:"))
    traced = F.when(text.contains("Traceback (most recent call last):") & (F.size(raised) > 0), F.element_at(raised, -1))
    packages = F.filter(lines, lambda x: x.startswith("npm ERR!"))
    native = F.filter(lines, lambda x: x.contains("fatal error:") | x.contains("undefined reference to"))
    first = lambda a: F.when(F.size(a) > 0, F.element_at(a, 1))
    return F.coalesce(F.when(at > 0, compiler), traced, first(packages), first(native))


def fold_turns(turns: DataFrame, hot: int = HOT_TURNS, foldable_role: str = "tool") -> DataFrame:
    """session_id, turn_index, role, tier, tokens, content: turns after compaction.

    ``turns``: session_id, turn_index, role, content. Turns of the system and the user, and the last ``hot`` ones, stay.
    An error that a later turn resolved, by success or by running into another one, is folded; else long output of
    ``foldable_role`` is. tier: 0 kept by role, 1 kept as recent, 2 offloaded, 3 folded error, -1 kept.
    """
    w = Window.partitionBy("session_id").orderBy("turn_index")
    rows = turns.withColumn("pos", F.row_number().over(w)).withColumn("n", F.count(F.lit(1)).over(Window.partitionBy("session_id")))
    rows = rows.withColumn("diag", diagnostic(F.col("content"))).withColumn("ok", succeeded(F.col("content")))
    # read from the end, what comes later is what has been seen; frames that only grow cost the same for each row
    later = Window.partitionBy("session_id").orderBy(F.desc("turn_index")).rowsBetween(Window.unboundedPreceding, -1)
    before = F.last("diag", ignorenulls=True).over(w.rowsBetween(Window.unboundedPreceding, -1))
    rows = rows.withColumn("before", before)
    # an error unlike the one before it; a success in between counts first, so it doesn't matter what that one said
    turned = F.when(F.col("diag").isNotNull() & ~F.col("ok") & (F.col("before").isNull() | (F.col("before") != F.col("diag"))), F.col("turn_index"))
    rows = rows.withColumn("turned", turned)
    good = F.last(F.when(F.col("ok"), F.col("turn_index")), ignorenulls=True).over(later)
    other = F.last("turned", ignorenulls=True).over(later)
    rows = rows.withColumn("solved", F.when(F.col("diag").isNotNull(), F.least(good, other)))
    recent = F.col("pos") > F.col("n") - hot
    lines = line_count(F.col("content"))
    long = (F.col("role") == foldable_role) & ((lines > LINE_LIMIT) | (estimate_tokens(F.col("content")) > TOKEN_LIMIT))
    tier = F.when(F.col("role").isin("system", "user"), 0).when(recent, 1).when(F.col("solved").isNotNull(), 3).when(long, 2).otherwise(-1)
    rows = rows.withColumn("tier", tier)
    node = F.concat(F.lit("node_"), F.substring(F.md5("content"), 1, 8))
    content = (
        F.when(F.col("tier") == 3, F.concat(F.lit("[Superseded error: "), "diag", F.lit(" (turn "), F.col("turn_index").cast("string"), F.lit(") -> resolved in turn "), F.col("solved").cast("string"), F.lit("]")))
        .when(F.col("tier") == 2, F.concat(F.lit("[Offloaded output: "), node, F.lit(" | "), lines.cast("string"), F.lit(" lines]")))
        .otherwise(F.col("content"))
    )
    rows = rows.withColumn("raw_tokens", estimate_tokens(F.col("content"))).withColumn("content", content)
    return rows.select("session_id", "turn_index", "role", F.col("tier").cast("long").alias("tier"), "raw_tokens", estimate_tokens(F.col("content")).alias("tokens"), "content")


def fold_summary(folded: DataFrame) -> DataFrame:
    """session_id, raw_tokens, compacted_tokens, trr (percent), folded, in_smart_zone."""
    rows = folded.groupBy("session_id").agg(F.sum("raw_tokens").alias("raw_tokens"), F.sum("tokens").alias("compacted_tokens"), F.count_if(F.col("tier") >= 2).alias("folded"))
    trr = F.when(F.col("raw_tokens") > 0, F.greatest(F.col("raw_tokens") - F.col("compacted_tokens"), F.lit(0)) * 100.0 / F.col("raw_tokens")).otherwise(0.0)
    share = F.col("compacted_tokens") / WINDOW_TOKENS
    return rows.select("session_id", "raw_tokens", "compacted_tokens", F.round(trr, 6).alias("trr"), "folded", ((share >= SMART_LOW) & (share <= SMART_HIGH)).alias("in_smart_zone"))


def offload(logs: DataFrame, limit: int = 50) -> DataFrame:
    """id, total_lines, truncated, node_id: logs (id, content) of more than ``limit`` lines are put aside under a node."""
    n = line_count(F.col("content"))
    return logs.select("id", n.alias("total_lines"), (n > limit).alias("truncated"), F.when(n > limit, F.concat(F.lit("node_"), F.substring(F.md5("content"), 1, 8))).alias("node_id"))


def access_counts(events: DataFrame, keys: list[str], gap: int = 60) -> DataFrame:
    """``keys``, access_count, last_access: events (keys, ts in whole seconds) that come ``gap`` seconds or more after the last one counted.

    No stretch shorter than ``gap`` has two events that count, so a stretch of up to 60 seconds is one row, with a bit
    for each second that has an event. What a key gathers grows with the time it spans, not with its events.
    """
    width = min(gap, 60)
    at = F.floor(F.col("ts") / width)
    bits = events.where("ts is not null").select(*keys, at.alias("b"), F.call_function("shiftleft", F.lit(1).cast("long"), (F.col("ts") - at * width).cast("int")).alias("bit"))
    spans = bits.groupBy(*keys, "b").agg(F.bit_or("bit").alias("mask")).groupBy(*keys).agg(F.array_sort(F.collect_list(F.struct("b", "mask"))).alias("spans"))

    def step(a: Column, x: Column) -> Column:
        begin = x["b"] * width
        soonest = F.greatest(F.coalesce(a["last"] + gap - begin, F.lit(0)), F.lit(0))
        left = F.call_function("shiftright", x["mask"], F.least(soonest, F.lit(62)).cast("int"))
        # the lowest bit has as many others below it as its place says
        place = soonest + F.bit_count(left.bitwiseAND(-left) - 1)
        return F.when((soonest < width) & (left != 0), F.struct((a["n"] + 1).alias("n"), (begin + place).cast("long").alias("last"))).otherwise(a)

    start = F.struct(F.lit(0).cast("long").alias("n"), F.lit(None).cast("long").alias("last"))
    return spans.withColumn("x", F.aggregate("spans", start, step)).select(*keys, F.col("x.n").alias("access_count"), F.col("x.last").alias("last_access"))


def claim(handoffs: DataFrame, claims: DataFrame) -> DataFrame:
    """handoff_id, agent, claimed_ts: the first eligible claim of each hand-off.

    ``handoffs``: handoff_id, to_agent (null: anyone), expires_at. ``claims``: handoff_id, agent, ts.
    """
    fits = F.col("to_agent").isNull() | (F.lower("to_agent") == F.lower("agent"))
    rows = claims.join(handoffs, "handoff_id").where(fits & (F.col("ts") < F.col("expires_at")))
    best = rows.groupBy("handoff_id").agg(F.min(F.struct("ts", "agent")).alias("x"))
    return best.select("handoff_id", F.col("x.agent").alias("agent"), F.col("x.ts").alias("claimed_ts"))


def timeline(notes: DataFrame, anchor: str | None = None, before: int = 5, after: int = 5) -> DataFrame:
    """rn, id, kind, date: relevant notes (id, path, level, stamp in seconds), newest first; with an ``anchor``, the rows around its path."""
    path = F.col("path")
    under = lambda *p: path.rlike("^(" + "|".join(p) + ")/")
    seen = path.endswith("-session-observations.md")
    relevant = F.col("level").isin("L2Log", "L3Evergreen", "L0Ephemeral") | seen | under("projects", "10_Projects", "decisions", "20_Cards", "logs", "01_AI_Logs")
    kind = (
        F.when(seen, "observation").when(under("projects", "10_Projects", "1_Projects"), "project")
        .when((F.col("level") == "L3Evergreen") | under("decisions", "20_Cards"), "decision")
        .when((F.col("level") == "L2Log") | under("logs", "01_AI_Logs"), "log")
        .when((F.col("level") == "L0Ephemeral") | under("00_Daily", "daily"), "ephemeral").otherwise("log")
    )
    date = F.date_format(F.timestamp_seconds("stamp"), "yyyy-MM-dd")
    rows = notes.where(relevant).select("id", "path", kind.alias("kind"), date.alias("date"), "stamp")
    # ranks by day need no single task: counts of days, then places within a day
    days = rows.groupBy("date").agg(F.count(F.lit(1)).alias("n"))
    days = days.withColumn("skip", F.coalesce(F.sum("n").over(Window.orderBy(F.desc("date")).rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)))
    rows = rows.join(days.select("date", "skip"), "date")
    rn = F.row_number().over(Window.partitionBy("date").orderBy(F.desc("stamp"), "path")) + F.col("skip")
    rows = rows.select(rn.cast("long").alias("rn"), "id", "path", "kind", "date")
    if anchor is None:
        return rows.drop("path")
    at = rows.where(path == anchor).agg(F.min("rn").alias("at"))
    return rows.join(F.broadcast(at), (F.col("rn") >= F.col("at") - before) & (F.col("rn") <= F.col("at") + after)).drop("path", "at")
