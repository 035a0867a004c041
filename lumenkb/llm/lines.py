"""Operator 7: removal of lines that repeat, exactly or nearly, across and within documents.

A line is normalised (lower case, digits as 0, ASCII punctuation as space, words joined by one space). Equal normalised
lines are one node, at any length. Lines of fewer than ``min_words`` words (characters, in scripts without spaces) are not
linked to near ones: in sentence fragments a word is much.

A line's SimHash is made piece by piece, so that changed words spoil the pieces they are in and no other: runs of up to
``PIECE`` words, three counted from the start of the line and three from its end; lines of about ``SHORT`` words or fewer have
all their words and all but each. A line of more than ``LONG`` words has two from either end and ``SEEDS`` runs of ``RUN``
words that its words choose: for each of as many hashes the run with the smallest one, wherever it stands, so that words added,
lost or moved elsewhere change nothing. A 64-bit SimHash of each piece's words is a pigeonhole block. Lines that agree on a
block are compared: a plain 64-bit SimHash of all words may differ in ``RADIUS`` bits, and an edit similarity of
``similarity`` or more decides. Links are closed to connected groups, and the first line of each group (by doc_id, then place)
stays.

Nodes of a block are first compared with the block's smallest one only, a join whose rows follow the number of nodes.
Nodes that this leaves unlinked are then compared with all others of the block, in cells of bounded size.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lumenkb.llm.components import components
from lumenkb.llm.pairs import Forest, deal, listed
from lumenkb.session import materialize, ship_code, shuffles_deleted, tidy

FOLD = bytes(48 if 48 <= i <= 57 else i if i >= 128 or 97 <= i <= 122 or i == 10 else 32 for i in range(256))
#: Words of a piece at most, words of a short line at most, bits in which the codes of whole lines may differ.
PIECE, SHORT, RADIUS = 6, 8, 18
#: Pairs of lines that are compared before what they link is looked at.
BATCH = 1024
#: Words of a line all of whose pieces are counted from its ends at most; runs that longer ones choose, and words of each.
LONG, SEEDS, RUN = 20, 3, 5
#: Characters of scripts without spaces: Thai, Lao, Myanmar, Khmer, kana, Han.
UNSPACED = re.compile("[\u0e00-\u0eff\u1000-\u109f\u1780-\u17ff\u3040-\u30ff\u3400-\u4dbf\u4e00-\u9fff\uf900-\ufaff\U00020000-\U0003ffff]")
POWERS = np.cumprod(np.r_[np.uint64(1), np.full(255, 0x9E3779B97F4A7C15, np.uint64)], dtype=np.uint64)
LANES = np.uint64(0x0101010101010101)


def normalised(text: str) -> list[bytes]:
    """The normalised form of each line of a text, split at line feeds."""
    raw = text.lower().encode("utf-8", "replace").translate(FOLD)
    while b"  " in raw:
        raw = raw.replace(b"  ", b" ")
    return raw.replace(b" \n", b"\n").replace(b"\n ", b"\n").strip(b" ").split(b"\n")


def mix(x: np.ndarray) -> np.ndarray:
    """The finaliser of splitmix64."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def unit_hashes(lines: list[bytes], most: int = 1 << 20) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of the words of the lines, one line after the other, and the number of words of each; none may be empty.

    About ``most`` bytes are hashed at a time, cut between words, so that a very long line takes no more memory.
    """
    raw = b" ".join(lines) + b" "
    out, lo = [], 0
    while lo < len(raw):
        hi = len(raw) if len(raw) - lo <= most else (raw.rfind(b" ", lo, lo + most) + 1 or raw.index(b" ", lo + most) + 1)
        a = np.frombuffer(raw, np.uint8, hi - lo, lo)
        gaps = np.flatnonzero(a == 32)
        starts = np.r_[0, gaps[:-1] + 1]
        length = gaps - starts + 1
        place = np.arange(len(a)) - np.repeat(starts, length)
        code = a * POWERS[place & 255]
        code[gaps] = 0
        out.append(mix(np.add.reduceat(code, starts)))
        lo = hi
    return np.concatenate(out), np.fromiter((x.count(b" ") + 1 for x in lines), np.int64, len(lines))


def majority(hashes: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """A 64-bit SimHash of each run of ``sizes`` hashes: the bits that more than half of the run have."""
    # bytes count up to 255, so longer runs are counted in parts
    parts = -(-sizes // 255)
    whose = np.repeat(np.arange(len(sizes)), parts)
    nth = np.arange(len(whose)) - np.repeat(np.cumsum(parts) - parts, parts)
    starts = np.repeat(np.cumsum(sizes) - sizes, parts) + 255 * nth
    ones = np.empty((len(whose), 8, 8), np.uint8)
    for k in range(8):
        ones[:, k] = np.add.reduceat((hashes >> np.uint64(k)) & LANES, starts).view(np.uint8).reshape(-1, 8)
    if len(whose) > len(sizes):
        ones = np.add.reduceat(ones, np.cumsum(parts) - parts, axis=0, dtype=np.int64)
    bits = 2 * ones.astype(np.int64) > sizes[:, None, None]
    return np.packbits(bits.reshape(-1, 8, 8).transpose(0, 2, 1).reshape(-1, 64), axis=1, bitorder="little").view(np.uint64).ravel()


def simhashes(lines: list[bytes]) -> np.ndarray:
    """A 64-bit SimHash of the words of each normalised line; none may be empty."""
    return majority(*unit_hashes(lines)).view(np.int64) if lines else np.zeros(0, np.int64)


def chosen(hashes: np.ndarray, base: np.ndarray, counts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """For each seed and line (words from ``base`` on, at least RUN) its number and the first word of the run with the smallest hash."""
    lengths = counts - RUN + 1
    starts = np.cumsum(lengths) - lengths
    whose = np.repeat(np.arange(len(counts)), lengths)
    first = np.arange(len(whose)) - starts[whose] + base[whose]
    run = hashes[first]
    for k in range(1, RUN):
        run = mix(run) + hashes[first + k]
    line, word = [], []
    for seed in range(SEEDS):
        key = mix(run ^ mix(np.array([seed + 1], np.uint64)))
        at = np.flatnonzero(key == np.minimum.reduceat(key, starts)[whose])
        one, i = np.unique(whose[at], return_index=True)
        line.append(one), word.append(first[at[i]])
    return np.concatenate(line), np.concatenate(word)


def pieces(counts: np.ndarray, hashes: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """For each piece of lines of ``counts`` words its line, a tag of its kind and place, its size; and the words of all pieces."""
    base = np.cumsum(counts) - counts
    line, tag, size, words = [], [], [], []

    def add(at: np.ndarray, kind: int, picked: np.ndarray) -> None:
        line.append(at), tag.append(np.full(len(at), kind)), size.append(np.full(len(at), picked.shape[1])), words.append(picked.ravel())

    for n in range(1, SHORT + 2):
        at = np.flatnonzero(counts == n)
        if len(at):
            every = base[at, None] + np.arange(n)
            add(at, 0, every)
            for k in range(n if n > 1 else 0):  # of one size with the whole of a line that lacks the word
                add(at, 0, np.delete(every, k, axis=1))
    for length in range(SHORT // 3 + 1, PIECE + 1):
        # lines near the limit between two lengths have pieces of both
        lo, hi = (SHORT if length == SHORT // 3 + 1 else 4 * length), (4 * length + 7 if length < PIECE else 1 << 60)
        at = np.flatnonzero((counts >= lo) & (counts <= hi))
        for k in range(3 if len(at) else 0):
            near = at[(counts[at] >= (k + 1) * length) & ((k < 2) | (counts[at] <= LONG))]
            add(near, 16 * length + k + 1, base[near, None] + k * length + np.arange(length))
            add(near, 16 * length + k + 9, (base + counts)[near, None] - (k + 1) * length + np.arange(length))
    at = np.flatnonzero(counts > LONG - 4)  # lines near the limit have both
    if len(at):
        whose, first = chosen(hashes, base[at], counts[at])
        add(at[whose], 0, first[:, None] + np.arange(RUN))
    if not line:
        return tuple(np.zeros(0, np.int64) for _ in range(4))
    return tuple(np.concatenate(x) for x in (line, tag, size, words))


def block_codes(lines: list[bytes]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The SimHash of each line, and the blocks: the line and the 64-bit code of each, lines ascending, no code twice in a line."""
    hashes, counts = unit_hashes(lines)
    line, tag, size, words = pieces(counts, hashes)
    # a word's place in its piece belongs to it, so that one that occurs twice does not outvote the others
    place = (np.arange(len(words)) - np.repeat(np.cumsum(size) - size, size)).astype(np.uint64)
    code = mix(majority(mix(hashes[words] + place), size) + mix(tag.astype(np.uint64))) if len(line) else np.zeros(0, np.uint64)
    order = np.lexsort((code, line))
    line, code = line[order], code[order]
    new = np.r_[True, (line[1:] != line[:-1]) | (code[1:] != code[:-1])] if len(line) else np.zeros(0, bool)
    return majority(hashes, counts).view(np.int64), line[new], code[new].view(np.int64)


def spaced(line: bytes) -> bytes:
    """The line with each character of a script without spaces as a word of its own."""
    return b" ".join(UNSPACED.sub(r" \g<0> ", line.decode("utf-8", "replace")).encode().split())


def distance(a: str, b: str, most: float = float("inf")) -> float:
    """Levenshtein distance, by bit-parallel columns (Hyyrö 2003) on what equal ends leave; infinite if over ``most``."""
    lo, hi = 0, min(len(a), len(b))
    while lo < hi and a[lo] == b[lo]:
        lo += 1
    a, b = a[lo:], b[lo:]
    while a and b and a[-1] == b[-1]:
        k = 1
        while 2 * k <= min(len(a), len(b)) and a[-2 * k :] == b[-2 * k :]:
            k *= 2
        a, b = a[:-k], b[:-k]
    if not a or not b:
        return len(a) + len(b)
    at: dict[str, int] = {}
    for i, c in enumerate(a):
        at[c] = at.get(c, 0) | 1 << i
    full, top = (1 << len(a)) - 1, 1 << len(a) - 1
    plus, minus, d, rest = full, 0, len(a), len(b)
    for c in b:
        eq = at.get(c, 0)
        diag = (((eq & plus) + plus) ^ plus) | eq | minus
        up, down = minus | (full & ~(diag | plus)), plus & diag
        d += bool(up & top) - bool(down & top)
        rest -= 1
        if d - rest > most:  # the columns left can take one each
            return float("inf")
        up, down = (up << 1 | 1) & full, (down << 1) & full
        plus, minus = down | (full & ~(diag | up)), up & diag
    return d


def middles(a: str, b: str) -> tuple[str, str]:
    """What equal ends leave of two texts, the shorter first."""
    if len(a) > len(b):
        a, b = b, a
    lo, hi = 0, len(a)
    while lo < hi:
        mid = (lo + hi + 1) // 2
        lo, hi = (mid, hi) if a[lo:mid] == b[lo:mid] else (lo, mid - 1)
    a, b = a[lo:], b[lo:]
    lo, hi = 0, len(a)
    while lo < hi:
        mid = (lo + hi + 1) // 2
        lo, hi = (mid, hi) if a[len(a) - mid : len(a) - lo] == b[len(b) - mid : len(b) - lo] else (lo, mid - 1)
    return a[: len(a) - lo], b[: len(b) - lo]


def far_apart(pairs: list[tuple[str, str]], most: np.ndarray, room: int = 1 << 16, longest: int = 4096) -> np.ndarray:
    """Which pairs are more than ``most`` edits apart: anti-diagonals of the band that so many edits can reach, many pairs at once."""
    cut = [middles(a, b) for a, b in pairs]
    size = np.array([(len(a), len(b)) for a, b in cut], np.int64).reshape(-1, 2)
    limit, total = np.floor(most).astype(np.int64), size.sum(axis=1)
    out = size[:, 1] - size[:, 0] > limit
    some = np.flatnonzero(~out & (size[:, 1] > limit))
    units = {k: [np.frombuffer(x.encode("utf-16-le", "surrogatepass"), np.uint16) for x in cut[k]] for k in some.tolist() if size[k, 1] <= longest}
    # long pairs fill a column on their own, and two units of one character would be two edits
    alone = [k for k in some.tolist() if k not in units or any(len(x) != n for x, n in zip(units[k], size[k].tolist(), strict=True))]
    for k in alone:
        out[k] = distance(*cut[k], int(limit[k])) > limit[k]
    some = np.setdiff1d(some, alone)
    some = some[np.lexsort((total[some], limit[some] // 8))]
    lo = 0
    while lo < len(some):
        at = some[lo : lo + min(1024, max(8, room // int(limit[some[lo]] + 8)))]
        lo += len(at)
        out[at] = _banded([units[k] for k in at.tolist()], size[at], limit[at])
    return out


def _banded(units: list[list[np.ndarray]], size: np.ndarray, limit: np.ndarray) -> np.ndarray:
    """Which pairs are more than ``limit`` apart. Cell i of anti-diagonal s, at row i + 1, is the distance of the first i and s - i units."""
    none = np.uint16(1 << 15)
    far, lane = np.zeros(len(units), bool), np.argsort(size.sum(axis=1), kind="stable")
    size, limit = size[lane], limit[lane]
    total, (high, wide), band = size.sum(axis=1), size.max(axis=0).tolist(), int(limit.max())
    one, two = np.full((len(lane), high), 0xFFFE, np.uint16), np.full((len(lane), wide), 0xFFFF, np.uint16)
    for r, k in enumerate(lane.tolist()):
        a, b = units[k]
        one[r, : len(a)], two[r, wide - len(b) :] = a, b[::-1]
    one, two = np.ascontiguousarray(one.T), np.ascontiguousarray(two.T)
    before, last, new = (np.full((high + 2, len(lane)), none) for _ in range(3))
    differ, changed = np.empty((band + 2, len(lane)), bool), np.empty((band + 2, len(lane)), np.uint16)
    last[1], ended = 0, 0
    for s in range(1, int(total[-1]) + 1):
        lo, hi = max(0, (s - band + 1) // 2, s - wide), min(high, s, (s + band) // 2)
        x, y = max(lo, 1), min(hi, s - 1)
        if x <= y:
            change, cell = changed[: y - x + 1], new[x + 1 : y + 2]
            np.not_equal(one[x - 1 : y], two[wide - s + x : wide - s + y + 1], out=differ[: y - x + 1])
            np.add(before[x : y + 1], differ[: y - x + 1], out=change)
            np.minimum(last[x : y + 1], last[x + 1 : y + 2], out=cell)
            np.add(cell, 1, out=cell)
            np.minimum(cell, change, out=cell)
        if lo == 0:
            new[1] = s
        if hi == s:
            new[s + 1] = s
        new[lo] = none  # cells beside the band are of no use to the next ones
        new[hi + 2 : hi + 3] = none
        before, last, new = last, new, before
        while ended < len(lane) and total[ended] == s:
            far[lane[ended]] |= last[size[ended, 0] + 1, ended] > limit[ended]
            ended += 1
        if s % 32 == 0 and ended < len(lane):
            # each way to the end passes this anti-diagonal or the one before, and then takes what the rests differ by
            rest = size[:, 0] - size[:, 1] + s - 2 * np.arange(lo - 1, hi + 1)[:, None]
            least = np.minimum((last[lo : hi + 2] + np.abs(rest)).min(axis=0), (before[lo : hi + 2] + np.abs(rest - 1)).min(axis=0))
            on = np.arange(len(lane)) >= ended
            far[lane[on & (least > limit)]] = True
            on &= least <= limit
            if 4 * on.sum() < 3 * len(lane):
                if not on.any():
                    break
                lane, size, limit, total, ended = lane[on], size[on], limit[on], total[on], 0
                one, two, before, last, new, differ, changed = (np.compress(on, z, axis=1) for z in (one, two, before, last, new, differ, changed))
    return far


def surely_close(a: str, b: str, most: float) -> bool:
    """True only for texts at most ``most`` edits apart: words that differ, each put in its place, are a bound of the distance from above."""
    one, two = a.split(" "), b.split(" ")
    return len(one) == len(two) and sum(max(len(x), len(y)) for x, y in zip(one, two, strict=True) if x != y) <= most


def close(a: str, b: str, similarity: float) -> bool:
    n = max(len(a), len(b))
    most = (1 - similarity) * n + 1e-9
    if n - min(len(a), len(b)) > most:
        return False
    return surely_close(a, b, most) or distance(a, b, most) <= most


def line_table(docs: DataFrame, min_words: int) -> DataFrame:
    """doc_id, k1, k2, line, h1, h2 (128 bits of the normalised line) of all lines with a word.

    norm, sim and blocks (the line's codes) are null where the line is too short to be linked to near ones, and where the
    same task has sent the same line before.
    """
    schema = pa.schema([("doc_id", pa.int64()), ("k1", pa.int64()), ("k2", pa.int64()), ("line", pa.int32()), ("h1", pa.int64()), ("h2", pa.int64()), ("norm", pa.string()), ("sim", pa.int64()), ("blocks", pa.list_(pa.int64()))])

    def frame(rows: list[tuple], norms: list[bytes], sent: set[int]) -> pa.RecordBatch:
        h = np.frombuffer(b"".join(map(xxhash.xxh3_128_digest, norms)), np.int64).reshape(-1, 2)
        new, units = [], []
        for at, (one, x) in enumerate(zip(h[:, 0].tolist(), norms, strict=True)):
            if one in sent:
                continue
            unit = x if x.isascii() or max(x) < 0xE0 else spaced(x)
            if unit.count(b" ") + 1 >= min_words:
                if len(sent) >= 200_000:
                    sent.clear()
                sent.add(one)
                new.append(at), units.append(unit)
        sim, line, code = block_codes(units) if new else (np.zeros(0, np.int64),) * 3
        shown, codes, none = [None] * len(norms), np.zeros(len(norms), np.int64), np.ones(len(norms), bool)
        for at in new:
            shown[at] = norms[at]
        codes[new], none[new] = sim, False
        ends = np.zeros(len(norms) + 1, np.int32)
        ends[1:][new] = np.bincount(line, minlength=len(new))
        ends = np.cumsum(ends, dtype=np.int32)
        blocks = pa.ListArray.from_arrays(pa.array(ends), pa.array(code))
        ids, k1, k2, places = zip(*rows, strict=True)
        columns = [pa.array(ids, pa.int64()), pa.array(k1, pa.int64()), pa.array(k2, pa.int64()), pa.array(places, pa.int32()), pa.array(h[:, 0]), pa.array(h[:, 1]), pa.array(shown, pa.binary()).cast(pa.string()), pa.array(codes, mask=none), blocks]
        return pa.RecordBatch.from_arrays(columns, schema=schema)

    def split(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sent: set[int] = set()
        for b in batches:
            rows, norms, size = [], [], 0
            for doc_id, k1, k2, text in zip(*(b.column(k).to_pylist() for k in range(3)), b.column(3), strict=True):
                for i, x in enumerate(normalised(text.as_py() or "")):
                    if x:
                        rows.append((doc_id, k1, k2, i)), norms.append(x)
                        size += len(x)
                        if size > 1_000_000:
                            yield frame(rows, norms, sent)
                            rows, norms, size = [], [], 0
            if rows:
                yield frame(rows, norms, sent)

    return docs.select("doc_id", "k1", "k2", "text").mapInArrow(split, "doc_id long, k1 long, k2 long, line int, h1 long, h2 long, norm string, sim long, blocks array<long>")


def node_id(h1: np.ndarray, h2: np.ndarray) -> list[str]:
    return [f"{x:x}:{y:x}" for x, y in zip(h1.view(np.uint64).tolist(), h2.view(np.uint64).tolist(), strict=True)]


def line_links(lines: DataFrame, similarity: float, cap: int, part_rows: int) -> DataFrame:
    """a, b: verified links between nodes, enough of them to connect each group. ``lines``: h1, h2, norm, sim, blocks.

    A node stands for itself by h1 until texts are compared; nodes that share h1 by chance are told apart there.
    """
    blocks = lines.where(F.col("blocks").isNotNull()).select(F.explode("blocks").alias("block"), "h1")
    # two numbers a block are kept, so that a block of many nodes is combined before the shuffle
    shared = blocks.groupBy("block").agg(F.min("h1").alias("lead"), F.max("h1").alias("last")).where(F.col("lead") < F.col("last"))
    # written, as other sides of joins with hot keys are, so that Spark can split these
    shared = materialize(shared.select("block", "lead"), "shared")
    met = materialize(blocks.join(shared, "block").where(F.col("h1") != F.col("lead")), "met")
    pairs = materialize(met.select("h1", "lead").distinct(), "pairs")
    wanted = pairs.select("h1").union(pairs.select("lead")).distinct()
    known = lines.where(F.col("norm").isNotNull()).select("h1", "h2", "norm", "sim")
    text = materialize(known.join(wanted, "h1", "left_semi").dropDuplicates(["h1", "h2"]), "texts")

    def compare(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            ok = np.bitwise_count(pdf["sim"].to_numpy().view(np.uint64) ^ pdf["lead_sim"].to_numpy().view(np.uint64)) <= RADIUS
            one, two = pdf["norm"].to_list(), pdf["lead_norm"].to_list()
            most = (1 - similarity) * np.array([max(len(x), len(y)) for x, y in zip(one, two, strict=True)]) + 1e-9
            unsure = [k for k in np.flatnonzero(ok).tolist() if not surely_close(one[k], two[k], most[k])]
            ok[unsure] = ~far_apart([(one[k], two[k]) for k in unsure], most[unsure])
            yield pdf[["h1", "h2", "lead", "lead_h2"]].assign(ok=ok)

    leads = text.select(*[F.col(c).alias(n) for c, n in (("h1", "lead"), ("h2", "lead_h2"), ("norm", "lead_norm"), ("sim", "lead_sim"))])
    both = pairs.join(text, "h1").join(leads, "lead")
    told = materialize(both.mapInPandas(compare, "h1 long, h2 long, lead long, lead_h2 long, ok boolean"), "told")
    name = lambda one, two: F.concat_ws(":", F.lower(F.hex(one)), F.lower(F.hex(two)))
    links = told.where("ok").select(name("h1", "h2").alias("a"), name("lead", "lead_h2").alias("b"))

    # what is not linked to the first node of a block may be linked to others of it, if there are any
    failed = told.where(~F.col("ok")).select("h1", "lead", F.lit(True).alias("rest")).distinct()
    marked = materialize(met.join(failed, ["h1", "lead"], "left").select("block", "h1", F.coalesce("rest", F.lit(False)).alias("rest")), "marked")
    marked = materialize(marked.distinct(), "distinct")
    few = marked.groupBy("block").agg(F.max("rest").alias("some"), F.min("h1").alias("low"), F.max("h1").alias("high"), F.count(F.lit(1)).alias("n"), F.sum(F.expr("cast(xxhash64(h1, rest) as decimal(38))")).alias("all"))
    # blocks of the same nodes are one
    few = few.where("some and low < high").groupBy("low", "high", "n", "all").agg(F.min("block").alias("block")).select("block")
    among = materialize(marked.join(few, "block", "left_semi"), "among")
    n = among.count()
    if not n:
        return links
    dealt = deal(among, "block", "h1", cap, max(32, n // part_rows))

    def meet(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values(["cell", "side", "h1", "h2"], kind="stable")
        cell, side, norm, rest = pdf["cell"].to_numpy(), pdf["side"].to_numpy(), pdf["norm"].to_list(), pdf["rest"].to_numpy()
        sim = pdf["sim"].to_numpy().view(np.uint64)
        size = np.fromiter(map(len, norm), np.int64, len(norm))
        # equal lines of several cells are one, so that what links them holds in all
        name = pd.MultiIndex.from_frame(pdf[["h1", "h2"]]).factorize()[0]
        groups, out, known_far = Forest(len(pdf)), [], set()
        # what isn't rest is linked to the first node of the block, and so to each other
        tied = np.flatnonzero(~rest)
        for x, y in zip(tied[:-1].tolist(), tied[1:].tolist(), strict=True):
            if cell[x] == cell[y]:
                groups.join(int(name[x]), int(name[y]))
        for i, j in listed(cell, side):
            apart = np.bitwise_count(sim[i] ^ sim[j])
            keep = (rest[i] | rest[j]) & (name[i] != name[j]) & (apart <= RADIUS)
            i, j, apart = i[keep], j[keep], apart[keep]
            most = (1 - similarity) * np.maximum(size[i], size[j]) + 1e-9
            keep = np.abs(size[i] - size[j]) <= most
            # likely links first, as what they join needs no more comparisons
            order = np.flatnonzero(keep)[np.argsort(apart[keep], kind="stable")]
            i, j, most = i[order], j[order], most[order]
            left = []
            for k, (x, y) in enumerate(zip(i.tolist(), j.tolist(), strict=True)):
                a, b = int(name[x]), int(name[y])
                if groups.root(a) != groups.root(b):
                    if surely_close(norm[x], norm[y], most[k]):
                        groups.join(a, b)
                        out.append((x, y))
                    else:
                        left.append(k)
            for lo in range(0, len(left), BATCH):
                # those that a link found meanwhile leaves in two groups, each once
                some = {}
                for k in left[lo : lo + BATCH]:
                    a, b = sorted((int(name[i[k]]), int(name[j[k]])))
                    if (a, b) not in known_far and groups.root(a) != groups.root(b):
                        some[a, b] = k
                gone = far_apart([(norm[i[k]], norm[j[k]]) for k in some.values()], most[list(some.values())])
                for ((a, b), k), away in zip(some.items(), gone.tolist(), strict=True):
                    if away:
                        if len(known_far) < 200_000:
                            known_far.add((a, b))
                    elif groups.join(a, b):
                        out.append((int(i[k]), int(j[k])))
        ids = node_id(pdf["h1"].to_numpy(), pdf["h2"].to_numpy())
        return pd.DataFrame({"a": pd.Series([ids[x] for x, _ in out], dtype=object), "b": pd.Series([ids[y] for _, y in out], dtype=object)})

    return links.union(dealt.join(text, "h1").groupBy("part").applyInPandas(meet, "a string, b string"))


@tidy
def written_links(lines: DataFrame, similarity: float, cap: int, part_rows: int) -> DataFrame:
    return materialize(line_links(lines, similarity, cap, part_rows), "links")


@tidy
def repeated_lines(docs: DataFrame, min_words: int, similarity: float, cap: int, part_rows: int) -> DataFrame:
    """k1, k2, lines: the places, in each document, of lines that aren't the first of their group."""
    lines = materialize(line_table(docs, min_words), "lines")
    place = F.struct(F.col("doc_id").isNull().alias("last"), "doc_id", "k1", "k2", "line")
    nodes = materialize(lines.groupBy("h1", "h2").agg(F.min(place).alias("first"), F.count(F.lit(1)).alias("n")), "nodes")
    roots = tidy(components)(written_links(lines.select("h1", "h2", "norm", "sim", "blocks"), similarity, cap, part_rows))
    at = F.concat_ws(":", F.lower(F.hex("h1")), F.lower(F.hex("h2")))
    grouped = materialize(nodes.select(at.alias("node"), "h1", "h2", "first").join(roots, "node"), "grouped")
    best = grouped.groupBy("root").agg(F.min("first").alias("best"))
    # nodes whose group keeps another node's line lose all their lines
    lost = grouped.join(best, "root").where(F.col("best") != F.col("first")).select("h1", "h2", F.lit(True).alias("lost"))
    some = nodes.join(lost, ["h1", "h2"], "left").where((F.col("n") > 1) | F.col("lost")).select("h1", "h2", "lost", "first")
    hit = lines.select("h1", "h2", "k1", "k2", "line").join(materialize(some, "some"), ["h1", "h2"])
    first = (F.col("k1") == F.col("first.k1")) & (F.col("k2") == F.col("first.k2")) & (F.col("line") == F.col("first.line"))
    gone = materialize(hit.where(F.col("lost").isNotNull() | ~first).select("k1", "k2", "line"), "gone")
    return gone.groupBy("k1", "k2").agg(F.collect_set("line").alias("lines"))


def dedup_lines(docs: DataFrame, min_words: int = 5, similarity: float = 0.8, cap: int = 512, part_rows: int = 2_000) -> DataFrame:
    """``docs`` (doc_id, text, any other columns) with n_lines, n_removed and kept_text.

    Equal lines are one at any length; only near ones need ``min_words``. Lines without a word are left alone. Null and
    empty texts have no lines that take part and stay as they are. Rows that are equal in doc_id and text are one document
    and keep the same lines; null doc_ids come last. Texts are read whole. An empty table gives no rows. Columns named
    n_lines, n_removed or kept_text in the input are replaced.
    """
    ship_code(docs.sparkSession)
    docs = docs.drop("n_lines", "n_removed", "kept_text")
    doc_id, text = F.col("doc_id").cast("long"), F.col("text").cast("string")
    keys = [F.xxhash64(doc_id, text), F.xxhash64(F.lit(1), doc_id, text)]  # 128 bits
    slim = docs.select(doc_id.alias("doc_id"), keys[0].alias("k1"), keys[1].alias("k2"), text.alias("text"))
    with shuffles_deleted(docs.sparkSession):
        removed = repeated_lines(slim, min_words, similarity, cap, part_rows)
    removed = removed.select(F.col("k1").alias("_k1"), F.col("k2").alias("_k2"), F.col("lines").alias("_lines"))
    rows = docs.withColumn("_o1", keys[0]).withColumn("_o2", keys[1]).join(removed, (F.col("_o1") == F.col("_k1")) & (F.col("_o2") == F.col("_k2")), "left")
    whole = F.split("text", "\n", -1)
    left = F.filter(whole, lambda x, i: ~F.array_contains(F.col("_lines"), i))
    return rows.select(
        *[F.col(c) for c in docs.columns],
        F.coalesce(F.size(whole), F.lit(0)).cast("long").alias("n_lines"),
        F.coalesce(F.size("_lines"), F.lit(0)).cast("long").alias("n_removed"),
        F.when(F.col("_lines").isNull(), F.col("text")).otherwise(F.array_join(left, "\n")).alias("kept_text"),
    )
