"""Skills from execution traces: what was run, what went wrong, and what was run then."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: What in a trace tells its tools (fixed values).
TOOLS = {
    "topic/rust": ["cargo ", "error[E", "could not compile", ".rs:"],
    "topic/python": ["python", "Traceback (most recent call last):", '.py", line', "KeyError", "ImportError"],
    "topic/node": ["npm ", "yarn ", "node_modules", ".ts:", ".js:"],
    "topic/c-cpp": ["ld: symbol(s) not found", "clang", "gcc", "undefined reference"],
    "topic/go": ["fatal error: all goroutines are asleep", "goroutine ", "go test", "go run"],
}
#: How a command's line begins, and what in a line says that something failed (fixed values).
PROMPTS, COMMANDS = ["$ ", "> "], ["cargo ", "python3 ", "python ", "pytest ", "git ", "brew "]
FAILED = ["error[E", "error:", "Traceback", "command not found", "FAILED", "exit status"]
TRACEBACK, HOOK = "Traceback (most recent call last):", "Invalid hook call"
UNNAMED, NOTHING = "Python Traceback Exception", "Execution interrupted or troubleshooting check"
#: Lines of error text, and lines after a traceback's head that may name it (fixed values).
MOST_LINES, AHEAD = 25, 15


def any_of(found: list[Column]) -> Column:
    out = found[0]
    for f in found[1:]:
        out = out | f
    return out


def starts(x: Column, with_: list[str]) -> Column:
    return any_of([x.startswith(w) for w in with_])


def holds(x: Column, what: list[str]) -> Column:
    return any_of([x.contains(w) for w in what])


def _line_states(lines: Column) -> Column:
    """text, s, opens, names, overrides of each line: whether it opens an error text, what it would call the error, and what a traceback does call it."""

    def one(x: Column, i: Column) -> Column:
        s = F.trim(F.regexp_replace(x, r"(?U)^\s+|\s+$", ""))
        ahead = F.filter(F.transform(F.slice(lines, i + 1, AHEAD), lambda y: F.trim(F.regexp_replace(y, r"(?U)^\s+|\s+$", ""))), lambda y: y.contains("Error:") | y.contains("Exception:"))
        error, traced = starts(s, ["error[E", "error:"]), s.startswith(TRACEBACK)
        other = s.contains("command not found") | starts(s, ["fatal error:", "panic:"])
        hook, left = s.contains(HOOK), holds(s, ["exit status", "exit code"])
        names = F.when(error, s).when(traced, UNNAMED).when(other, s).when(hook, "React Invalid hook call").when(left, s)
        return F.struct(x.alias("text"), s.alias("s"), (error | traced | other | hook).alias("opens"), names.alias("names"), F.when(traced & ~error, F.get(ahead, 0)).alias("overrides"))

    return F.transform(lines, one)


def _error_lines(states: Column) -> Column:
    """The lines of error texts: from one that opens it to the next command or test result, MOST_LINES in all, but each opening line."""
    start = F.struct(F.lit(False).alias("inside"), F.array().cast("array<string>").alias("taken"))

    def step(state: Column, line: Column) -> Column:
        inside = state["inside"] | line["opens"]
        taken = F.when(inside, F.concat(state["taken"], F.array(line["text"]))).otherwise(state["taken"])
        ends = (starts(line["s"], [*PROMPTS, "test result:"]) & (F.size(taken) > 2)) | (F.size(taken) >= MOST_LINES)
        return F.struct((inside & ~ends).alias("inside"), taken.alias("taken"))

    return F.aggregate(states, start, step)["taken"]


def _advice(summary: Column, tags: Column) -> Column:
    """Rules that would have prevented it, by tool and error."""
    has = lambda tool: F.array_contains(tags, f"topic/{tool}")
    rules = [
        F.when(has("rust") & holds(summary, ["E0382", "moved"]), "Don't use a value after it is moved; share state between threads in Arc and Mutex."),
        F.when(has("rust"), "Check and test locally after each change."),
        F.when(has("python") & holds(summary, ["KeyError", "TOKEN", "KEY"]), "Look up environment variables with a fallback, or check them at the start."),
        F.when(has("python"), "Pin dependencies in a virtual environment."),
        F.when(summary.contains("command not found"), "Probe for commands before scripts use them, and write down which tools are needed."),
    ]
    told = F.filter(F.array(*rules), lambda x: x.isNotNull())
    return F.when(F.size(told) > 0, told).otherwise(F.array(F.lit("Keep the log and its context, and add a regression test with the fix.")))


def skills(traces: DataFrame) -> DataFrame:
    """id, title, summary, tags, commands_before, commands_after, error_lines, prevention: one row for each of ``traces`` (id, trace, hint, title).

    Commands up to the first line that tells of a failure come before, the others after it. summary: what the last
    traceback names, else the first error told, else the hint. Null traces are empty; hint and title may be null.
    """
    trace = F.coalesce("trace", F.lit(""))
    lines = F.transform(F.split(F.regexp_replace(trace, r"\n\z", ""), "\n", -1), lambda x: F.regexp_replace(x, r"(?U)\s+\z", ""))
    rows = traces.select("id", "hint", "title", trace.alias("trace"), _line_states(lines).alias("l"))
    command = lambda x: F.when(starts(x["s"], PROMPTS), F.trim(F.substring(x["s"], F.lit(3), F.length(x["s"])))).when(starts(x["s"], COMMANDS), x["s"])
    first = F.array_position(F.transform("l", lambda x: holds(x["s"], FAILED)), True).cast("int")
    run = lambda xs: F.filter(F.transform(xs, command), lambda c: c.isNotNull())
    failed = F.when(first > 0, first).otherwise(F.size("l"))
    named = lambda field: F.filter(F.transform("l", lambda x: x[field]), lambda x: x.isNotNull())
    tags = F.concat(F.array(F.lit("type/skill")), F.filter(F.array(*[F.when(holds(F.col("trace"), marks), tag) for tag, marks in TOOLS.items()]), lambda x: x.isNotNull()))
    rows = rows.select(
        "id", "hint", "title", tags.alias("tags"), run(F.slice("l", F.lit(1), failed)).alias("commands_before"), run(F.slice("l", failed + 1, F.size("l"))).alias("commands_after"),
        _error_lines(F.col("l")).alias("error_lines"), F.coalesce(F.try_element_at(named("overrides"), F.lit(-1)), F.get(named("names"), 0), "hint", F.lit(NOTHING)).alias("summary"),
    )
    bare = F.trim(F.regexp_replace(F.regexp_replace(F.regexp_replace("summary", "^(error: )+", ""), "^(zsh: )+", ""), "^(bash: )+", ""))
    by_error = F.when(F.col("summary") == NOTHING, "Execution Troubleshooting & Skill Distillation").otherwise(F.concat(F.lit("Resolve "), F.when(F.octet_length(bare) <= 60, bare).otherwise(F.trim(F.substring(bare, 1, 57)))))
    by_hint = F.when(F.octet_length("hint") <= 60, F.trim("hint")).otherwise(F.concat(F.lit("Troubleshoot: "), F.trim(F.substring("hint", 1, 60))))
    title = F.coalesce(F.trim("title"), by_hint, by_error)
    return rows.select("id", title.alias("title"), "summary", "tags", "commands_before", "commands_after", "error_lines", _advice(F.col("summary"), F.col("tags")).alias("prevention"))
