"""Column functions over text, all inside code generation."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Letters folded before indexing, and what each becomes (fixed values).
ACCENTED = "àâäáãåçéèêëíìîïñóòôöõúùûüýÿ"
PLAIN = "aaaaaaceeeeiiiinooooouuuuyy"
WORD = r"[\p{L}\p{N}]+"
#: The CJK ranges of the token estimate (fixed values).
CJK = "[一-鿿㐀-䶿豈-﫿]"
#: The wider CJK ranges of the index segmenter (fixed values).
SEGMENT_CJK = r"[\x{2E80}-\x{2FDF}\x{3040}-\x{30FF}\x{31F0}-\x{31FF}\x{3400}-\x{4DBF}\x{4E00}-\x{9FFF}\x{AC00}-\x{D7AF}\x{F900}-\x{FAFF}\x{20000}-\x{2FA1F}]"


def fold(text: Column) -> Column:
    return F.translate(F.lower(text), ACCENTED, PLAIN)


def is_ascii(text: Column) -> Column:
    return F.octet_length(text) == F.length(text)


def tokens(text: Column) -> Column:
    """Folded runs of letters and digits, in order."""
    plain = F.regexp_extract_all(F.lower(text), F.lit("[a-z0-9]+"), F.lit(0))
    return F.when(is_ascii(text), plain).otherwise(F.regexp_extract_all(fold(text), F.lit(WORD), F.lit(0)))


def fold_fullwidth(text: Column) -> Column:
    """Full-width forms of ASCII (U+FF01 to U+FF5E) and the ideographic space as their narrow ones."""
    wide = [chr(c) for c in range(0xFF01, 0xFF5F)]
    return F.translate(text, "".join(wide) + "\u3000", "".join(chr(ord(c) - 0xFEE0) for c in wide) + " ")


def segment(text: Column) -> Column:
    """Text with each CJK run written as overlapping bigrams (a run of one as itself), apart from other scripts."""
    runs = F.regexp_extract_all(text, F.lit(rf"{SEGMENT_CJK}+|[^\s{SEGMENT_CJK[1:-1]}]+"), F.lit(0))
    is_cjk = lambda r: r.rlike(rf"^{SEGMENT_CJK}+$")
    pair = lambda r: F.array_join(F.transform(F.sequence(F.lit(1), F.length(r) - 1), lambda i: F.substring(r, i, F.lit(2))), " ")
    return F.array_join(F.transform(runs, lambda r: F.when(is_cjk(r) & (F.length(r) > 1), pair(r)).otherwise(r)), " ")


def segmented(text: Column) -> Column:
    """Text as it is indexed: full-width forms folded, and CJK runs as bigrams where there are any."""
    text = fold_fullwidth(text)
    return F.when(text.rlike(SEGMENT_CJK), segment(text)).otherwise(text)


#: Any character that segmenting might change is of these.
WIDE = r"[^\x00-\x{2E7F}]"


def indexed(text: Column) -> Column:
    """Text as ``index_tokens`` cuts it. Most texts need no more than a look."""
    return F.when(is_ascii(text), text).when(text.rlike(WIDE), segmented(text)).otherwise(text)


def index_tokens(text: Column) -> Column:
    """Tokens of the text as it is indexed. Where texts are long, ``indexed`` is better a column of its own before ``tokens``."""
    return tokens(indexed(text))


def estimate_tokens(text: Column) -> Column:
    """A quarter of the characters that are neither white space nor CJK, and two thirds of the CJK ones, each rounded up."""
    solid = F.regexp_replace(text, r"\s", "")
    other = F.length(F.regexp_replace(solid, CJK, ""))
    return (F.ceil(other / 4) + F.ceil((F.length(solid) - other) * 2 / 3)).cast("long")


def slugify(text: Column) -> Column:
    slug = F.regexp_replace(F.regexp_replace(F.lower(text), r"[^\p{L}\p{N}]+", "-"), "^-+|-+$", "")
    return F.when(slug == "", F.lit("untitled")).otherwise(slug)


def first_line(text: Column) -> Column:
    return F.element_at(F.split(text, "\n", -1), 1)


def line_count(text: Column) -> Column:
    """Lines as a reader counts them: a trailing line feed opens none, and an empty text has none."""
    return F.when(text == "", 0).otherwise(F.size(F.split(F.regexp_replace(text, "\n$", ""), "\n", -1))).cast("long")


def safe_name(title: Column) -> Column:
    """A title as a file name: characters that file systems refuse become underscores, outer blanks and dots go."""
    clean = F.regexp_replace(title, r'[/\\:*?"<>|\x00]', "_")
    clean = F.regexp_replace(F.regexp_replace(clean, r"(?U)^\s+|\s+$", ""), r"^\.+|\.+$", "")
    return F.when(clean == "", F.lit("untitled")).otherwise(clean)


def one_line(text: Column) -> Column:
    """Each run of white space as one space, none at the ends."""
    return F.trim(F.regexp_replace(text, r"(?U)\s+", " "))


def without_ansi(text: Column) -> Column:
    """Text without escape characters, each with its control sequence: from a bracket to the first ASCII letter or the end."""
    return F.regexp_replace(text, r"\x1b(\[[^A-Za-z]*[A-Za-z]?)?", "")


def unescaped(text: Column) -> Column:
    """Written-out line feeds and tabs as such, where the text looks escaped as a whole: it has no line feed, or escaped list items or the known heading."""
    looks = ~text.contains("\n") | text.contains("## Non-Negotiable Invariants\\n") | text.contains("\\n- ")
    plain = F.replace(F.replace(text, F.lit("\\n"), F.lit("\n")), F.lit("\\t"), F.lit("\t"))
    return F.when(text.contains("\\n") & looks, plain).otherwise(text)


def is_subsequence(needle: Column, text: Column) -> Column:
    """Whether the characters of ``needle`` stand in ``text`` in their order, ASCII letters in either case. An empty needle does."""
    upper, lower = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
    text = F.translate(text, upper, lower)
    chars = F.regexp_extract_all(F.translate(needle, upper, lower), F.lit("(?s)."), F.lit(0))

    def after(at: Column, c: Column) -> Column:
        found = F.call_function("locate", c, text, at)
        return F.when((at == 0) | (found == 0), 0).otherwise(found + 1)

    return F.aggregate(chars, F.lit(1), after) > 0


#: Folders that say nothing of a path's subject (fixed values).
LAYOUT = ["src", "crates", "tests", "target", "benches", "examples", "docs", "doc", "lib", ".github", ".git", ".cargo", "node_modules"]


def path_keywords(path: Column) -> Column:
    """The words of a path's segments in order: parts between hyphens and underscores, after the whole where there are several."""
    named = F.filter(F.transform(F.split(path, "/"), lambda x: F.trim(x)), lambda x: (x != "") & ~x.isin(LAYOUT))
    stems = F.transform(named, lambda x: F.lower(F.regexp_replace(x, r"\.[^.]*$", "")))
    parts = lambda x: F.filter(F.split(x, "[_-]"), lambda y: F.octet_length(y) >= 2)
    return F.array_distinct(F.flatten(F.transform(stems, lambda x: F.when(F.size(parts(x)) > 1, F.concat(F.array(x), parts(x))).otherwise(parts(x)))))
