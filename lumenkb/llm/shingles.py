"""Word shingles of whole texts as 64-bit hashes, by array arithmetic."""

from __future__ import annotations

import numpy as np

from lumenkb.llm.lines import POWERS, mix

#: ASCII letters in lower case, digits and all bytes beyond ASCII are parts of words.
PARTS = bytes(i if i >= 128 or 97 <= i <= 122 or 48 <= i <= 57 else 32 for i in range(256))
STEP = np.uint64(0xD6E8FEB86659FD93)


def word_hashes(text: str) -> np.ndarray:
    raw = np.frombuffer(b" " + text.lower().encode("utf-8", "replace").translate(PARTS), np.uint8)
    letter = raw != 32
    starts = np.flatnonzero(letter[1:] & ~letter[:-1]) + 1
    if not len(starts):
        return np.zeros(0, np.uint64)
    place = (np.arange(len(raw)) - np.repeat(np.r_[0, starts], np.diff(np.r_[0, starts, len(raw)]))) & 255
    return mix(np.add.reduceat(np.where(letter, raw.astype(np.uint64) * POWERS[place], np.uint64(0)), starts))


def shingle_set(text: str | None, width: int = 5) -> np.ndarray:
    """Sorted distinct hashes of runs of ``width`` words. A shorter text has one shingle, of all its words; one without words has none."""
    w = word_hashes(text or "")
    if not len(w):
        return w
    n = max(1, len(w) - width + 1)
    h = np.zeros(n, np.uint64)
    for i in range(min(width, len(w))):
        h = h * STEP + w[i : i + n]
    return np.unique(mix(h))


#: Odd multipliers, one for each coordinate of a signature, from a seed.
MULTIPLIERS = np.random.default_rng(41).integers(0, 2**63, 64, dtype=np.uint64) * np.uint64(2) + np.uint64(1)


def signature(shingles: np.ndarray) -> np.ndarray:
    """For each coordinate the upper half of the smallest hash: two sets agree on it as often as their Jaccard similarity."""
    best = np.full(len(MULTIPLIERS), np.iinfo(np.uint64).max)
    for lo in range(0, len(shingles), 16_384):
        best = np.minimum(best, (shingles[lo : lo + 16_384] * MULTIPLIERS[:, None]).min(axis=1))
    return (best >> np.uint64(32)).astype(np.uint32)
