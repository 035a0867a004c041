"""Comments of code lines, as column functions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Endings of files without comments, of files whose comments begin with a hash, and names of such files (fixed values).
PROSE = ["md", "txt", "rst"]
HASH = ["py", "sh", "bash", "zsh", "rb", "pl", "toml", "yaml", "yml", "conf", "env", "r", "mk"]
HASH_NAMES = ["Makefile", "Dockerfile"]

#: Stand-ins, none of them a character: a backslash that escapes, and what it keeps from opening or closing something.
ESCAPE, HIDDEN = "\ufdd0", {'"': "\ufdd1", "'": "\ufdd2", "`": "\ufdd3", "/": "\ufdd4", "#": "\ufdd5"}
END = " \ufdd6"
STRINGS = r"""("[^"]*+"?|'[^']*+'?|`[^`]*+`?)"""
#: A closed block comment; it takes a blank from the line's end as its second group.
BLOCK = rf"/\*.*?\*/(?=.*( ){END[1]}\z)"


def without_comments(line: Column, path: Column) -> Column:
    """A line of code without its comments; a closed block comment leaves a blank. Null stays null.

    Quotes of three kinds protect what is in them, and a backslash the character after it; an open quote reaches to the
    line's end. Every language has block comments, which don't nest and end with the line at the latest; those of HASH
    have comments from a hash after white space, all others from two slashes. Lines of prose stay as they are.
    """
    name = F.regexp_extract(F.translate(path, "\\", "/"), r"([^/]*)$", 1)
    ending = F.lower(F.regexp_extract(name, r"^.+\.([^.]*)$", 1))
    by_hash = ending.isin(HASH) | name.isin(HASH_NAMES)
    plain = ~line.contains("/") & ~line.contains("#")

    hidden = F.regexp_replace(line, r"(?s)\\(.)", f"{ESCAPE}$1")
    for c, to in HIDDEN.items():
        hidden = F.replace(hidden, F.lit(ESCAPE + c), F.lit(ESCAPE + to))
    marked = F.concat(hidden, F.lit(END))
    cut = lambda rest: F.regexp_replace(marked, rf"(?s){STRINGS}|{BLOCK}|/\*.*|{rest}", "$1$2")
    code = F.replace(F.when(by_hash, cut(r"(?<!\S)#.*")).otherwise(cut("//.*")), F.lit(END), F.lit(""))
    for c, to in HIDDEN.items():
        code = F.replace(code, F.lit(ESCAPE + to), F.lit(ESCAPE + c))
    return F.when(ending.isin(PROSE) | plain, line).otherwise(F.replace(code, F.lit(ESCAPE), F.lit("\\")))
