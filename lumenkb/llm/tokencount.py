"""Operator 1: token counts that follow edits.

A document's pre-tokens lie in leaves of about ``fanout`` pre-tokens each, and a segment tree over the leaves holds sums
of characters and of tokens. An edit descends by characters to the leaves that it touches, takes the leaf before them in
where it begins near the start of a leaf, and the leaf after them as long as the new text doesn't end a pre-token where
the old text did. Only that region is encoded again; the sums on its paths to the root are updated. Counts stay exact,
because the pre-token pattern never looks behind, looks ahead of a pre-token by three characters at most except over
white space, and no leaf ends in white space unless the text does. Strings of special tokens are pre-tokens of their own,
whatever they stand beside; an edit can make or break one that begins up to its length before it.
"""

from __future__ import annotations

from collections.abc import Callable, Iterable, Iterator
from itertools import accumulate

import pandas as pd
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lumenkb.llm.bpe import default_path, encoder, specials
from lumenkb.session import ship_code

#: The pre-token pattern of the byte-level vocabulary (a fixed value, published with it).
PATTERN = regex.compile(r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+")
AHEAD = 3


class TokenTree:
    """Token counts of one text under edits. ``special``: strings that ``encode`` takes as one token; none may overlap itself or another."""

    def __init__(self, text: str, encode: Callable[[str], list[int]], fanout: int = 32, special: Iterable[str] = ()):
        self.encode, self.encoded_again = encode, 0
        self.special = regex.compile("(" + "|".join(map(regex.escape, special)) + ")") if special else None
        self.ahead = max([AHEAD, *map(len, special)])
        self.leaves = []
        start = at = waiting = 0
        for w in self.pre_tokens(text):
            at, waiting = at + len(w), waiting + 1
            if waiting >= fanout and not w[-1].isspace() or at == len(text):
                self.leaves.append(text[start:at])
                start, waiting = at, 0
        self.leaves = self.leaves or [""]
        self.width = 1
        while self.width < len(self.leaves):
            self.width *= 2
        self.chars, self.tokens = [0] * (2 * self.width), [0] * (2 * self.width)
        for i, x in enumerate(self.leaves, self.width):
            self.chars[i], self.tokens[i] = len(x), len(encode(x))
        for i in range(self.width - 1, 0, -1):
            self._sum(i)

    def pre_tokens(self, text: str) -> list[str]:
        if self.special is None or not self.special.search(text):
            return PATTERN.findall(text)
        return [w for i, x in enumerate(self.special.split(text)) for w in ([x] if i % 2 else PATTERN.findall(x))]

    def _sum(self, i: int) -> None:
        self.chars[i] = self.chars[2 * i] + self.chars[2 * i + 1]
        self.tokens[i] = self.tokens[2 * i] + self.tokens[2 * i + 1]

    def _set(self, leaf: int, text: str) -> None:
        i = self.width + leaf
        self.leaves[leaf] = text
        self.chars[i], self.tokens[i] = len(text), len(self.encode(text))
        while i > 1:
            i //= 2
            self._sum(i)

    def find(self, at: int) -> tuple[int, int]:
        """The leaf that holds the character at ``at`` (the last one that isn't empty, for the text's end), and the offset in it."""
        i = 1
        while i < self.width:
            i *= 2
            if at >= self.chars[i] and self.chars[i + 1]:
                at -= self.chars[i]
                i += 1
        return i - self.width, at

    def edit(self, at: int, cut: int, new: str) -> None:
        """Put ``new`` in the place of ``cut`` characters from ``at``; both are cut to what there is."""
        at = max(0, min(at, self.chars[1]))
        cut = max(0, min(cut, self.chars[1] - at))
        (lo, off), (hi, _) = self.find(at), self.find(at + cut)
        while lo and off < self.ahead:
            lo -= 1
            off += len(self.leaves[lo])
        old = "".join(self.leaves[lo : hi + 1])
        text = old[:off] + new + old[off + cut :]
        while hi + 1 < len(self.leaves):
            follow, after = self.leaves[hi + 1], hi + 2
            seen = follow
            while len(seen) < self.ahead and after < len(self.leaves):
                seen, after = seen + self.leaves[after], after + 1
            if follow and text and not text[-1].isspace() and len(text) in set(accumulate(map(len, self.pre_tokens(text + seen)))):
                break
            text += follow
            hi += 1
        self._set(lo, text)
        for i in range(lo + 1, hi + 1):
            if self.leaves[i]:
                self._set(i, "")
        self.encoded_again += len(text)

    @property
    def total(self) -> int:
        return self.tokens[1]


def count_tokens(docs: DataFrame, path: str | None = None, fanout: int = 32) -> DataFrame:
    """doc_id, n_tokens, n_tokens_after, n_chars_after, n_chars_encoded_again of each row of ``docs`` (doc_id, text, edits).

    ``edits``: array of (at, cut, new), applied in their order, each to what the ones before it left; places are in
    characters, and are cut to the text. A null text is empty, a null array has no edits, null fields are 0 and empty.
    Texts are read whole; rows that repeat are counted alike; other columns are ignored. An empty table gives no rows.
    """
    ship_code(docs.sparkSession)
    path = path or default_path()

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        encode, special = encoder(path), specials(path)
        for pdf in batches:
            out = []
            for text, edits in zip(pdf["text"], pdf["edits"], strict=True):
                tree = TokenTree(text or "", encode, fanout, special)
                before = tree.total
                for e in edits if edits is not None else ():
                    tree.edit(e["at"] or 0, e["cut"] or 0, e["new"] or "")
                out.append((before, tree.total, tree.chars[1], tree.encoded_again))
            got = pd.DataFrame(out, columns=["n_tokens", "n_tokens_after", "n_chars_after", "n_chars_encoded_again"])
            got.insert(0, "doc_id", pdf["doc_id"].astype("Int64").to_numpy())
            yield got

    rows = docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string"), F.col("edits").cast("array<struct<at:long,cut:long,new:string>>"))
    return rows.mapInPandas(run, "doc_id long, n_tokens long, n_tokens_after long, n_chars_after long, n_chars_encoded_again long")
