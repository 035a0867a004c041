"""Operator 9: removal of byte strings that occur again, by suffix arrays from linear suffix grouping.

Every byte of a text goes that is covered by a string of ``length`` bytes which also starts at another place of any
text. Each window of that length has one anchor: the place in it where the hash of ``GRAM`` bytes is smallest. Equal
windows have equal anchors at equal places, so windows whose anchor's bytes occur once can't repeat, and all others
need to be compared with windows of the same anchor only. A context is an anchor with all windows that it is the anchor
of. Contexts of equal bytes, told by 128 bits, are one and carry how often they occur.

Different contexts of an anchor are cut down to what some other context of it agrees with. Then all go to suffix arrays:
where what is left of an anchor's contexts is the same bytes in all of them, these become one symbol, and so does a context
that occurs twice, which goes as a pair; any other stays bytes. The suffix array brings equal windows together, and windows
of bytes are compared byte by byte.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lumenkb.llm.gsaca import suffix_array
from lumenkb.llm.lines import mix
from lumenkb.llm.pairs import deal
from lumenkb.session import materialize, ship_code

GRAM = 64
SEGMENT = 1 << 22
#: 128 bits of a document.
KEYS = ["xxhash64(cast(doc_id as long), cast(text as string)) AS k1", "xxhash64(1, cast(doc_id as long), cast(text as string)) AS k2"]


def gram_hashes(b: np.ndarray) -> np.ndarray:
    """A hash of the GRAM bytes from each place, by doubling."""
    h, m, k = b.astype(np.uint64) + np.uint64(1), 0x9E3779B97F4A7C15, 1
    while k < GRAM:
        h = h[:-k] * np.uint64(m) + h[k:]
        m, k = m * m % 2**64, 2 * k
    return mix(h)


def anchors(b: np.ndarray, length: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """first, last (places where windows start), at (place of their anchor) and hash, for each anchor of a text."""
    w = length - GRAM + 1
    found = []
    for lo in range(0, max(len(b) - length + 1, 0), SEGMENT):  # window starts of a segment; a long text is read in overlapping ones
        h = gram_hashes(b[lo : lo + SEGMENT + length - 1])
        key = (h & ~np.uint64(0xFFFFFF)) | np.arange(len(h), dtype=np.uint64)
        n = len(h) - w + 1
        pad = np.full(-len(key) % w, np.iinfo(np.uint64).max)
        rows = np.concatenate([key, pad]).reshape(-1, w)
        ahead = np.minimum.accumulate(rows, axis=1).ravel()
        behind = np.minimum.accumulate(rows[:, ::-1], axis=1)[:, ::-1].ravel()
        at = (np.minimum(behind[:n], ahead[w - 1 : w - 1 + n]) & np.uint64(0xFFFFFF)).astype(np.int64)
        cut = np.flatnonzero(np.r_[True, at[1:] != at[:-1]])
        found.append((lo + cut, lo + np.r_[cut[1:], n] - 1, lo + at[cut], h[at[cut]].view(np.int64)))
    return tuple(np.concatenate(x) for x in zip(*found, strict=True)) if found else (np.zeros(0, np.int64),) * 4


def anchor_table(docs: DataFrame, length: int) -> DataFrame:
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            out = []
            for k1, k2, text in zip(pdf["k1"].tolist(), pdf["k2"].tolist(), pdf["text"], strict=True):
                raw = (text or "").encode()
                if len(raw) >= length:
                    first, last, at, h = anchors(np.frombuffer(raw, np.uint8), length)
                    out.append(pd.DataFrame({"k1": k1, "k2": k2, "first": first, "last": last, "at": at, "anchor": h}))
            if out:
                yield pd.concat(out)

    return docs.select(*map(F.expr, KEYS), F.col("text").cast("string")).mapInPandas(run, "k1 long, k2 long, first long, last long, at long, anchor long")


def context_table(docs: DataFrame, wanted: DataFrame, length: int) -> DataFrame:
    """anchor, c1, c2 (128 bits of the context), k1, k2, first, size, back (from the context's start to the anchor), raw.

    raw is null where the same task has sent the same context before.
    """

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        sent: set[bytes] = set()
        for pdf in batches:
            out: list[tuple] = []
            for k1, k2, text, places in zip(pdf["k1"].tolist(), pdf["k2"].tolist(), pdf["text"], pdf["places"], strict=True):
                raw = text.encode()
                for p in places:
                    first, last, at = p["first"], p["last"], p["at"]
                    part = raw[first : last + length]
                    d = xxhash.xxh3_128_digest(part + (at - first).to_bytes(4, "little"))
                    new = d not in sent
                    if new and len(sent) < 500_000:
                        sent.add(d)
                    out.append((p["anchor"], d, k1, k2, first, len(part), at - first, part if new else None))
                if len(out) > 20_000:
                    yield frame(out)
                    out = []
            if out:
                yield frame(out)

    def frame(rows: list[tuple]) -> pd.DataFrame:
        c = np.frombuffer(b"".join(r[1] for r in rows), np.int64).reshape(-1, 2)
        cols = list(zip(*rows, strict=True))
        return pd.DataFrame({"anchor": cols[0], "c1": c[:, 0], "c2": c[:, 1], "k1": cols[2], "k2": cols[3], "first": cols[4], "size": cols[5], "back": cols[6], "raw": pd.Series(cols[7], dtype=object)})

    rows = docs.select(*map(F.expr, KEYS), F.col("text").cast("string")).join(wanted, ["k1", "k2"])
    return rows.mapInPandas(run, "anchor long, c1 long, c2 long, k1 long, k2 long, first long, size long, back long, raw binary")


def agreement(rows: np.ndarray, cell: np.ndarray) -> np.ndarray:
    """For each row of bytes the longest prefix that it shares with another row of its cell."""
    m, n = rows.shape
    order = np.lexsort((np.ascontiguousarray(rows).view(f"S{n}").ravel(), cell))
    a, b = order[:-1], order[1:]
    other = rows[a] != rows[b]
    same = np.where(other.any(axis=1), other.argmax(axis=1), n) * (cell[a] == cell[b])
    best = np.zeros(m, np.int64)
    best[a] = same
    best[b] = np.maximum(best[b], same)
    return best


def repeated_windows(parts: list[bytes | int], length: int) -> list[np.ndarray]:
    """For each part, the places where a window starts that also starts elsewhere in the parts.

    A number stands for a part without inner differences: a symbol, at place 0 the start of all its windows.
    """
    sizes = np.array([1 if isinstance(p, int) else len(p) for p in parts])
    single = np.array([isinstance(p, int) for p in parts])
    base = np.cumsum(np.r_[0, sizes + 1])
    text = np.zeros(base[-1] + length + 8, np.int64)
    starts_of = np.where(single, 1, sizes - length + 1)
    for k, p in enumerate(parts):
        # UTF-8 has no byte 255; 0 ends a part
        text[base[k] : base[k] + sizes[k]] = p + 256 if single[k] else np.frombuffer(p, np.uint8).astype(np.int64) + 1
    of = np.repeat(np.arange(len(parts)), starts_of)
    start = base[of] + np.arange(len(of)) - np.repeat(np.cumsum(starts_of) - starts_of, starts_of)
    ok = np.zeros(base[-1], bool)
    ok[start] = True
    order = np.array(suffix_array(text[: base[-1]]), np.int64)
    order = order[ok[order]]
    a, b = order[:-1], order[1:]
    same = text[a] == text[b]
    a, b = a[same], b[same]
    symbol = text[a] > 255
    hit = np.zeros(base[-1], bool)
    hit[a[symbol]] = hit[b[symbol]] = True
    a, b = a[~symbol], b[~symbol]
    raw = np.minimum(text, 255).astype(np.uint8)
    eight = np.lib.stride_tricks.sliding_window_view(raw, 8)
    for at in [*range(0, length - 7, 8), *([length - 8] if length % 8 else [])]:
        if not len(a):
            break
        x, y = (np.ascontiguousarray(eight[z + at]).view(np.uint64).ravel() for z in (a, b))
        a, b = a[x == y], b[x == y]
    hit[a] = hit[b] = True
    hits, whose = start[hit[start]], of[hit[start]]
    cuts = np.searchsorted(whose, np.arange(len(parts) + 1))
    return [hits[cuts[k] : cuts[k + 1]] - base[k] for k in range(len(parts))]


def spans(starts: np.ndarray, length: int) -> list[tuple[int, int]]:
    """Maximal runs of bytes covered by windows at sorted ``starts``."""
    if not len(starts):
        return []
    cut = np.flatnonzero(starts[1:] > starts[:-1] + length) + 1
    return list(zip(starts[np.r_[0, cut]].tolist(), (starts[np.r_[cut - 1, len(starts) - 1]] + length).tolist(), strict=True))


def solve(contexts: DataFrame, length: int, cap: int, part_bytes: int, sa_bytes: int) -> DataFrame:
    """c1, c2, lo, hi: what repeats of each context. ``contexts``: anchor, c1, c2, n (how often it occurs), size, back, raw."""
    total = contexts.agg(F.sum("size")).first()[0] or 0
    parts = max(8, int(total // part_bytes))
    dealt = deal(contexts, "anchor", "c1, c2", cap, parts).select("c1", "c2", "n", "size", "back", "raw", "cell", "part")
    # what occurs twice needs no partner of other bytes, nor its own
    twice = contexts.where(F.col("n") > 1).select("c1", "c2", "n", "size", "back", F.lit(None).cast("binary").alias("raw"), F.col("c1").alias("cell"), F.expr(f"cast(pmod(xxhash64(c1, c2), {parts}) as int)").alias("part"))

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        out: list[tuple[int, int, int, int]] = []
        pair = pdf[pdf["raw"].isna()]
        keys = list(zip(pair["c1"].tolist(), pair["c2"].tolist(), pair["size"].tolist(), strict=True))
        hits = repeated_windows([k // 2 for k in range(2 * len(keys))], length) if keys else []
        out += [(*key[:2], 0, key[2]) for key, hit in zip(keys, hits[::2], strict=True) if len(hit)]
        pdf = pdf[pdf["raw"].notna()].sort_values(["cell", "c1", "c2"], kind="stable")
        if not len(pdf):
            return pd.DataFrame(out, columns=["c1", "c2", "lo", "hi"]).astype("int64")
        cell = np.unique(pdf["cell"].to_numpy(), return_inverse=True)[1]
        raw, back, known = pdf["raw"].to_list(), pdf["back"].to_numpy(), pdf["n"].to_numpy() > 1
        size = np.array([len(x) for x in raw])
        forth = np.zeros((len(raw), length), np.uint8)
        before = np.zeros((len(raw), length - GRAM), np.uint8)
        for k, x in enumerate(raw):
            a = np.frombuffer(x, np.uint8) + np.uint8(1)
            right, left = a[back[k] : back[k] + length], a[: back[k]][::-1][: length - GRAM]
            forth[k, : len(right)], before[k, : len(left)] = right, left
        far, near = agreement(forth, cell), agreement(before, cell)
        far, near = np.minimum(far, size - back), np.minimum(near, back)
        # a window starts ``d`` before its anchor
        most, least = np.minimum(near, back), np.maximum(length - far, np.maximum(back - (size - length), 0))
        kept = np.flatnonzero(least <= most)
        edges = np.flatnonzero(np.r_[True, cell[kept[1:]] != cell[kept[:-1]], True]) if len(kept) else np.zeros(1, np.int64)
        c1, c2 = pdf["c1"].to_list(), pdf["c2"].to_list()
        rows: list[int] = []
        strings: list[bytes | int] = []
        used = 0

        def flush() -> None:
            for k, text, starts in zip(rows, strings, repeated_windows(strings, length) if strings else [], strict=True):
                if known[k] or not len(starts):
                    continue
                lo = int(back[k] - most[k])
                if isinstance(text, int):
                    out.append((c1[k], c2[k], lo, int(back[k] - least[k]) + length))
                else:
                    out.extend((c1[k], c2[k], a + lo, b + lo) for a, b in spans(starts, length))
            rows.clear(), strings.clear()

        for lo, hi in zip(edges[:-1].tolist(), edges[1:].tolist(), strict=True):
            own = kept[lo:hi].tolist()
            cut = [raw[k][back[k] - most[k] : back[k] - least[k] + length] for k in own]
            alike = len(own) > 1 and all(x == cut[0] for x in cut) and all(most[k] == most[own[0]] for k in own)
            rows += own
            strings += [int(cell[own[0]])] * len(own) if alike else cut
            used += len(own) if alike else sum(map(len, cut))
            if used >= sa_bytes:
                flush()
                used = 0
        flush()
        return pd.DataFrame(out, columns=["c1", "c2", "lo", "hi"]).astype("int64")

    return dealt.unionByName(twice).groupBy("part").applyInPandas(run, "c1 long, c2 long, lo long, hi long")


def repeated_spans(docs: DataFrame, length: int, cap: int, part_bytes: int, sa_bytes: int) -> DataFrame:
    """k1, k2, spans: array of (lo, hi), unordered and overlapping, of each document with repeats."""
    found = materialize(anchor_table(docs, length), "anchors")
    # written, so that a join with it can be split where an anchor is hot
    again = materialize(found.groupBy("anchor").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") > 1).select("anchor"), "again")
    wanted = found.join(again, "anchor").groupBy("k1", "k2").agg(F.collect_set(F.struct("first", "last", "at", "anchor")).alias("places"))
    seen = materialize(context_table(docs, wanted, length), "contexts")
    contexts = seen.groupBy("anchor", "c1", "c2").agg(F.count(F.lit(1)).alias("n"), F.first("raw", ignorenulls=True).alias("raw"), F.first("size").alias("size"), F.first("back").alias("back"))
    contexts = materialize(contexts, "distinct")
    repeats = materialize(solve(contexts, length, cap, part_bytes, sa_bytes).distinct(), "repeats")
    spans_of = seen.select("c1", "c2", "k1", "k2", "first").join(repeats, ["c1", "c2"])
    return spans_of.groupBy("k1", "k2").agg(F.collect_set(F.struct((F.col("first") + F.col("lo")).alias("lo"), (F.col("first") + F.col("hi")).alias("hi"))).alias("spans"))


def dedup_substrings(docs: DataFrame, length: int = 400, cap: int = 2048, part_bytes: int = 4_000_000, sa_bytes: int = 1_000_000) -> DataFrame:
    """doc_id, n_bytes, n_removed, n_spans, kept_sha256 and kept (bytes) of each row of ``docs`` (doc_id, text; others are ignored).

    Null texts count as empty; texts shorter than ``length`` bytes stay whole. Rows that repeat a text, also under the
    same or a null doc_id, are repeats of each other. What stays need not be valid UTF-8, as cuts may fall inside a
    character. Texts are read whole, at any length. An empty table gives no rows. ``length`` must be at least 72.
    """
    ship_code(docs.sparkSession)
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    found = repeated_spans(docs, length, cap, part_bytes, sa_bytes)

    def cut(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            out = []
            for doc_id, text, places in zip(pdf["doc_id"], pdf["text"], pdf["spans"], strict=True):
                raw = (text or "").encode()
                kept, removed, runs, at = [], 0, 0, -1
                end = 0
                for lo, hi in sorted((p["lo"], p["hi"]) for p in places) if places is not None else ():
                    if lo > at or not runs:
                        kept.append(raw[end:lo])
                        runs += 1
                        removed += hi - lo
                        at = end = hi
                    elif hi > at:
                        removed += hi - at
                        at = end = hi
                kept.append(raw[end:])
                left = b"".join(kept)
                out.append((doc_id, len(raw), removed, runs, hashlib.sha256(left).hexdigest(), left))
            frame = pd.DataFrame(out, columns=["doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256", "kept"])
            yield frame.astype({"doc_id": "Int64"})

    rows = docs.select("*", *map(F.expr, KEYS)).join(found, ["k1", "k2"], "left").select("doc_id", "text", "spans")
    return rows.mapInPandas(cut, "doc_id long, n_bytes long, n_removed long, n_spans long, kept_sha256 string, kept binary")
