"""Places in notes, and the excerpts shown with a hit."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

SNIPPET = 200


def format_locator(path: Column, start: Column, end: Column, heading: Column) -> Column:
    """path[:start-end][#heading], the heading cut to 48 characters and rid of what would end it."""
    lines = F.when(start.isNotNull(), F.concat(F.lit(":"), start.cast("string"), F.lit("-"), end.cast("string"))).otherwise("")
    clean = F.left(F.trim(F.regexp_replace(heading, r"[\s#\[\]|]+", " ")), F.lit(48))
    return F.concat(path, lines, F.when(F.coalesce(clean, F.lit("")) != "", F.concat(F.lit("#"), clean)).otherwise(""))


def parse_locator(text: Column) -> Column:
    """struct(path, start_line, end_line, heading, error) of a locator; lines count from 1 and don't run backwards."""
    body = F.regexp_replace(F.trim(text), r"^\[|\]$", "")
    path = F.regexp_extract(body, r"^(?i)(.*?\.md)(?=[:#]|$)", 1)
    rest = F.substring(body, F.length(path) + 1, F.lit(10_000))
    lines = F.regexp_extract(rest, r"^:(\d+)(?:-(\d+))?(?=#|$)", 1)
    last = F.regexp_extract(rest, r"^:(\d+)-(\d+)(?=#|$)", 2)
    start, end = F.expr("cast(null as int)"), F.expr("cast(null as int)")
    start = F.when(lines != "", lines.try_cast("int")).otherwise(start)
    end = F.when(last != "", last.try_cast("int")).when(lines != "", lines.try_cast("int")).otherwise(end)
    error = F.when(path == "", "no note").when(rest.startswith(":") & (lines == ""), "malformed lines").when((start == 0) | (end == 0), "lines count from 1").when(start > end, "lines run backwards")
    return F.struct(path.alias("path"), start.alias("start_line"), end.alias("end_line"), F.nullif(F.regexp_extract(rest, "#(.*)$", 1), F.lit("")).alias("heading"), error.alias("error"))


def line_slice(body: Column, start: Column, end: Column) -> Column:
    """Lines ``start`` to ``end``, from 1 and inclusive, cut to what there is."""
    lines = F.split(body, "\n", -1)
    lo = F.greatest(start, F.lit(1))
    return F.array_join(F.slice(lines, lo, F.greatest(F.least(end, F.size(lines)) - lo + 1, F.lit(0))), "\n")


def snippet(body: Column, terms: Column) -> Column:
    """A short body whole; else about SNIPPET characters around the longest of ``terms`` that occurs, with marks where it is cut."""
    flat = F.regexp_replace(F.trim(body), r"\s*\n\s*", " ")
    low = F.lower(flat)
    found = F.filter(F.array_sort(terms, lambda a, b: F.length(b) - F.length(a)), lambda t: (t != "") & low.contains(t))
    hit = F.when(F.size(found) > 0, F.element_at(found, 1)).otherwise("")
    at = F.when(hit != "", F.instr(low, hit)).otherwise(1)
    lo = F.greatest(F.lit(1), F.least(at - F.floor((SNIPPET - F.length(hit)) / 2).cast("int"), F.length(flat) - SNIPPET + 1))
    cut = F.substring(flat, lo, F.lit(SNIPPET))
    return F.when(F.length(flat) <= SNIPPET, flat).otherwise(F.concat(F.when(lo > 1, "...").otherwise(""), F.trim(cut), F.when(lo + SNIPPET <= F.length(flat), "...").otherwise("")))
