"""Operator 3: toxicity of texts after noisy-channel deobfuscation.

A character trigram model is counted over every document. Tokens that look obfuscated (digits or symbols for letters,
letters spaced out, letters repeated) become lattices: each character stands for itself, for the letters it is used
for, or for nothing if it repeats its predecessor. Viterbi decoding under the character model picks the most likely
spelling, and the text is scored as restored: by the evidence weights of its words and word beginnings, which are
log odds over labelled documents, in a logistic model of the strongest weight and of the sum of the strongest three.
"""

from __future__ import annotations

import math
import re
from collections import Counter
from collections.abc import Callable, Iterable, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lumenkb.session import ship_code

#: Letters of the character model, each with its number from 1; everything else is number 0, a boundary.
LETTERS = "abcdefghijklmnopqrstuvwxyzßàáâãäåæçèéêëìíîïðñòóôõöøùúûüýþÿœ"
BASE = 64
#: What symbols and digits are used for (fixed values).
STANDS_FOR = {
    "0": "o", "1": "il", "2": "z", "3": "e", "4": "a", "5": "s", "6": "gb", "7": "t", "8": "b", "9": "g",
    "@": "a", "$": "s", "!": "i", "|": "li", "+": "t", "€": "e", "£": "l", "(": "c", "*": "aeiou",
}
CHANNEL = {"self": math.log(0.9), "swap": math.log(0.3), "drop": math.log(0.5), "again": math.log(0.2)}
SPACED = re.compile(r"(?<![^\W_])(?:[^\W_][ .\-_*]){2,}[^\W_](?![^\W_])")
RUN = re.compile(r"(.)\1\1")
WORD = re.compile(r"[^\W_]+")
EDGE = " \t\r\n.,;:?!\"'()[]{}<>#%&*-_/\\|=~^`«»“”‘’…$"
#: Of them, those that stand for no letter.
QUOTES = "".join(c for c in EDGE if c not in STANDS_FOR)
_codes = np.zeros(0x3000, np.int64)
_codes[[ord(c) for c in LETTERS]] = np.arange(1, len(LETTERS) + 1)


def trigram_counts(docs: DataFrame) -> DataFrame:
    """gram, n: character trigrams of all texts, at most BASE ** 3 rows."""

    def count(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        total = np.zeros(BASE**3, np.int64)
        for pdf in batches:
            # two boundaries stand between texts; a text is never cut, and about 4 MB go at a time
            waiting, size = [], 0
            for text in [*pdf["text"], None]:
                waiting.append((text or "").lower())
                size += len(waiting[-1])
                if size > 4_000_000 or text is None:
                    a = np.frombuffer(f"  {'  '.join(waiting)}  ".encode("utf-32-le", "replace"), np.uint32)
                    a = _codes[np.where(a < len(_codes), a, 0)]
                    total += np.bincount((a[:-2] * BASE + a[1:-1]) * BASE + a[2:], minlength=len(total))
                    waiting, size = [], 0
        at = np.flatnonzero(total)
        yield pd.DataFrame({"gram": at, "n": total[at]})

    return docs.select(F.col("text").cast("string")).mapInPandas(count, "gram long, n long").groupBy("gram").agg(F.sum("n").alias("n"))


def character_model(docs: DataFrame) -> np.ndarray:
    """Log probability of each third character after two others; 4 BASE ** 3 bytes, whatever the input."""
    counts = np.zeros(BASE**3)
    rows = trigram_counts(docs).toPandas()
    counts[rows["gram"].to_numpy(np.int64)] = rows["n"].to_numpy(float)
    cube = counts.reshape(BASE, BASE, BASE)
    one = (cube.sum(axis=(0, 1)) + 1) / (cube.sum() + BASE)
    two = (cube.sum(axis=0) + 8 * one) / (cube.sum(axis=(0, 2))[:, None] + 8)
    return np.log((cube + 8 * two[None]) / (cube.sum(axis=2, keepdims=True) + 8)).astype(np.float32)


def decode(token: str, model: np.ndarray, spaces: bool = False) -> str:
    """The most likely spelling of a lower-case token under the channel and the character model; with ``spaces``, of words.

    A path keeps its spelling as a chain of (rest, character), so that long tokens take time in proportion.
    """
    paths: dict[tuple[int, int], tuple[float, tuple | None]] = {(0, 0): (0.0, None)}
    for i, c in enumerate(token):
        options = [(c, CHANNEL["self"])] if c in LETTERS else []
        options += [(x, CHANNEL["swap"]) for x in STANDS_FOR.get(c, "")]
        again = CHANNEL["again"] if i and token[i - 1] == c else None
        if not options:
            continue
        if spaces and i:  # a word may end before this character
            for (a, b), (cost, text) in list(paths.items()):
                new = cost + float(model[a, b, 0])
                if b and new > paths.get((b, 0), (-math.inf,))[0]:
                    paths[b, 0] = (new, (text, " "))
        step: dict[tuple[int, int], tuple[float, tuple | None]] = {}
        for (a, b), (cost, text) in paths.items():
            if again is not None and b and cost + again > step.get((a, b), (-math.inf,))[0]:
                step[a, b] = (cost + again, text)
            for x, p in options:
                k = int(_codes[ord(x)])
                new = cost + p + float(model[a, b, k])
                if new > step.get((b, k), (-math.inf,))[0]:
                    step[b, k] = (new, (text, x))
        paths = step
    end = max(((cost + float(model[a, b, 0]), n) for n, ((a, b), (cost, _)) in enumerate(paths.items())), key=lambda x: x[0])[1]
    chain, out = list(paths.values())[end][1], []
    while chain is not None:
        chain, x = chain
        out.append(x)
    return "".join(reversed(out))


def obfuscated(token: str) -> bool:
    """Whether a letter stands next to a character of the channel, or characters of the channel alone may spell a word."""
    if any(a.isalpha() != b.isalpha() and (a in STANDS_FOR or b in STANDS_FOR) for a, b in zip(token, token[1:], strict=False)):
        return True
    return len(token) > 1 and token[0] in STANDS_FOR and not token.isdigit() and all(c in STANDS_FOR for c in token) and any(map(str.isalnum, token))


def words(text: str, model: np.ndarray, known: dict[str, str]) -> set[str]:
    """Distinct lower-case words of the restored text. ``known``: a cache of decoded tokens."""
    low = text.lower()
    tokens = set(low.split())
    out = set()
    for t in tokens:
        core = t if t.isalpha() else t.strip(EDGE)
        if core.isalpha():
            if RUN.search(core):
                core = restored(core, model, known)
            out.add(core)
        elif core:
            out.update(WORD.findall(core))
            if obfuscated(core):
                out.add(restored(core, model, known))
        # symbols at a word's ends may be letters too: "a$$", "$hit"; those that close a sentence are tried both ways
        whole = t.strip(QUOTES)
        for w in {whole, whole.rstrip("!|*+")} - {core}:
            if obfuscated(w):
                out.add(restored(w, model, known))
    for m in SPACED.findall(low):
        out.update(restored(re.sub(r"[ .\-_*]", "", m), model, known, spaces=True).split())
    out.discard("")
    return out


def restored(token: str, model: np.ndarray, known: dict[str, str], spaces: bool = False) -> str:
    key = " " + token if spaces else token
    if key not in known:
        if len(known) >= 50_000:
            known.clear()
        known[key] = decode(token, model, spaces)
    return known[key]


def evidence(found: set[str]) -> set[str]:
    """Features of a document: its words, and what they begin with."""
    return {w[:24] for w in found} | {w[:5] + "*" for w in found if len(w) >= 5} | {w[:4] + "*" for w in found if len(w) >= 4}


def strongest(found: set[str], weights: dict[str, float]) -> tuple[float, float]:
    got = sorted((weights[f] for f in evidence(found) if f in weights), reverse=True)[:3]
    return (got[0] if got else 0.0), float(sum(got))


def fit(documents: DataFrame, labels: DataFrame, model: np.ndarray, limit: int = 20_000, least_support: int = 4, features: int = 50_000) -> tuple[dict[str, float], np.ndarray]:
    """Evidence weights and logistic coefficients.

    Learns from at most about ``limit`` labelled rows, picked by a hash of doc_id; of them, only those with
    crc32(doc_id as text) mod 5 other than 0. The driver gets at most ``features`` weights and three numbers a row.
    """
    spark = documents.sparkSession
    rows = labels.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("toxic").cast("int").alias("toxic")).dropna()
    rows = rows.where((F.crc32(F.col("doc_id").cast("string").cast("binary")) % 5) != 0).groupBy("doc_id").agg(F.max("toxic").alias("toxic"))
    share = min(1.0, limit / max(1, rows.count()))
    rows = rows.where(F.pmod(F.xxhash64(F.lit(3), "doc_id"), F.lit(1_000_000)) < int(share * 1_000_000))
    # at most about ``limit`` narrow rows: safe to broadcast
    sample = documents.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).join(F.broadcast(rows), "doc_id")
    held = spark.sparkContext.broadcast(model)

    def tally(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        seen, known = (Counter(), Counter()), {}
        docs = [0, 0]
        for pdf in batches:
            for text, toxic in zip(pdf["text"], pdf["toxic"], strict=True):
                docs[toxic > 0] += 1
                seen[toxic > 0].update(evidence(words(text or "", held.value, known)))
        names = list(seen[1])  # what no toxic document holds has no weight
        if any(docs):
            yield pd.DataFrame({"feature": pd.Series(["", *names], dtype=object), "toxic": [docs[1], *map(seen[1].get, names)], "clean": [docs[0], *(seen[0][x] for x in names)]})
        # elsewhere it may have one, so clean counts are kept too
        names = [x for x in seen[0] if x not in seen[1]]
        yield pd.DataFrame({"feature": pd.Series(names, dtype=object), "toxic": 0, "clean": [seen[0][x] for x in names]})

    sums = sample.mapInPandas(tally, "feature string, toxic long, clean long").groupBy("feature").agg(F.sum("toxic").alias("toxic"), F.sum("clean").alias("clean"))
    kept = sums.where((F.col("toxic") >= least_support) | (F.col("feature") == "")).orderBy(F.desc(F.col("feature") == ""), F.desc(F.col("toxic") / (F.col("clean") + 1)), "feature").limit(features).toPandas()
    if kept.empty or kept["feature"].iloc[0] != "":
        return {}, np.array([-3.0, 1.0, 0.0])
    bad, good = max(1, kept["toxic"].iloc[0]), max(1, kept["clean"].iloc[0])
    kept = kept.iloc[1:]
    odds = np.log((kept["toxic"] + 0.1) / bad) - np.log((kept["clean"] + 0.5) / good)
    weights = {f: float(w) for f, w in zip(kept["feature"], odds, strict=True) if w > 1}
    table = spark.sparkContext.broadcast(weights)

    def measure(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        known: dict[str, str] = {}
        for pdf in batches:
            got = [strongest(words(t or "", held.value, known), table.value) for t in pdf["text"]]
            yield pd.DataFrame({"top": [x[0] for x in got], "three": [x[1] for x in got], "toxic": pdf["toxic"].to_numpy()})

    seen = sample.mapInPandas(measure, "top double, three double, toxic int").toPandas()
    return weights, logistic(seen[["top", "three"]].to_numpy(float), (seen["toxic"] > 0).to_numpy(float))


def logistic(x: np.ndarray, y: np.ndarray, ridge: float = 1.0) -> np.ndarray:
    """Newton's method; the first coefficient is the constant."""
    x = np.column_stack([np.ones(len(x)), x])
    w = np.zeros(x.shape[1])
    for _ in range(30):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        h = (x * (p * (1 - p))[:, None]).T @ x + ridge * np.eye(len(w))
        w = w + np.linalg.solve(h, x.T @ (y - p) - ridge * w)
    return w


def scorer(documents: DataFrame, labels: DataFrame, limit: int = 20_000) -> Callable[[], Callable[[Iterable[str | None]], np.ndarray]]:
    """What makes, in a task, a function from texts to their scores."""
    ship_code(documents.sparkSession)
    model = character_model(documents)
    weights, w = fit(documents, labels, model, limit)
    sc = documents.sparkSession.sparkContext
    held, table = sc.broadcast(model), sc.broadcast(weights)  # both of bounded size

    def start() -> Callable[[Iterable[str | None]], np.ndarray]:
        known: dict[str, str] = {}

        def score_all(texts: Iterable[str | None]) -> np.ndarray:
            x = np.array([[1.0, *strongest(words(t or "", held.value, known), table.value)] for t in texts]).reshape(-1, 3)
            return 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))

        return score_all

    return start


def clean(documents: DataFrame, labels: DataFrame, limit: int = 20_000, threshold: float = 0.5) -> DataFrame:
    """The rows of ``documents`` (any columns besides doc_id and text) that score below ``threshold``."""
    probabilities = scorer(documents, labels, limit)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        score_all = probabilities()
        for whole in batches:
            for lo in range(0, len(whole), 500):  # texts of so many rows at a time are Python's
                b = whole.slice(lo, 500)
                yield b.filter(pa.array(score_all(b.column(at).cast(pa.string()).to_pylist()) < threshold))

    at = documents.columns.index("text")
    return documents.mapInArrow(run, documents.schema)


def score(documents: DataFrame, labels: DataFrame, limit: int = 20_000) -> DataFrame:
    """doc_id, held_out, score and predicted of every row of ``documents`` (doc_id, text; other columns are ignored).

    ``labels`` (doc_id, toxic) is only learned from. Null and empty texts have no evidence and get the base score; rows
    that repeat are scored alike; texts are read whole. Without toxic labels every score is the same low number; an
    empty table gives no rows. A null doc_id has a null held_out.
    """
    probabilities = scorer(documents, labels, limit)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        score_all = probabilities()
        for pdf in batches:
            p = score_all(pdf["text"])
            yield pdf[["doc_id", "held_out"]].assign(score=p, predicted=(p >= 0.5).astype(np.int32))

    doc_id = F.col("doc_id").cast("long")
    rows = documents.select(doc_id.alias("doc_id"), (F.crc32(doc_id.cast("string").cast("binary")) % 5 == 0).alias("held_out"), F.col("text").cast("string").alias("text"))
    return rows.mapInPandas(run, "doc_id long, held_out boolean, score double, predicted int")
