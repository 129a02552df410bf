"""Word shingles as sets of 64-bit numbers, and their MinHash bands."""

from __future__ import annotations

import re

import numpy as np
import xxhash

#: Words in a shingle.
WORDS = 5
_WORD = re.compile("[^\x20\x09-\x0d]+")
_known: dict[str, int] = {}


def word_codes(text: str) -> np.ndarray:
    """A 64-bit number for each word of the lower-cased text, the same in every process."""
    if len(_known) > 200_000:
        _known.clear()
    words = _WORD.findall(text.lower())
    out = np.empty(len(words), np.uint64)
    for i, w in enumerate(words):
        code = _known.get(w)
        if code is None:
            code = _known[w] = xxhash.xxh3_64_intdigest(w.encode("utf-8", "replace"))
        out[i] = code
    return out


def mixed(x: np.ndarray) -> np.ndarray:
    """A bijection on 64-bit numbers that spreads every bit."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def shingle_set(text: str | None, words: int = WORDS) -> np.ndarray:
    """The shingles of the whole text, ascending, each once. A text with fewer words than a shingle is one shingle of
    all its words; a null text, or one without words, has none."""
    code = word_codes(text or "")
    if not len(code):
        return code
    n = max(1, len(code) - words + 1)
    total = np.zeros(n, np.uint64)
    for i in range(min(words, len(code))):
        total = mixed(total + code[i : i + n] + np.uint64(i + 1))
    return np.unique(total)


def choose_bands(threshold: float, recall: float, most: int = 128) -> tuple[int, int]:
    """(bands, rows): as many rows as `most` hashes allow, so that dissimilar sets share bands least often, with just
    enough bands that a pair at the threshold shares one with probability recall."""
    best = None
    for rows in range(1, most + 1):
        bands = max(1, int(np.ceil(np.log(1 - recall) / np.log1p(-(threshold**rows))))) if threshold < 1 else 1
        if bands * rows <= most:
            best = bands, rows
    if best is None:
        raise ValueError("no choice of bands reaches the recall")
    return best


def band_codes(shingles: np.ndarray, bands: int, rows: int, chunk: int = 256) -> np.ndarray:
    """A number for each band of the set's MinHash; sets of the same minima in a band have the same number."""
    random = np.random.default_rng(2024)
    a = random.integers(0, 2**63, bands * rows, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
    c = random.integers(0, 2**63, bands * rows, dtype=np.uint64)
    low = np.full(bands * rows, np.iinfo(np.uint64).max, np.uint64)
    for i in range(0, len(shingles), chunk):
        low = np.minimum(low, (shingles[i : i + chunk, None] * a + c).min(axis=0))
    code = np.arange(1, bands + 1, dtype=np.uint64)
    for column in low.reshape(bands, rows).T:
        code = mixed(code + column)
    return code.view(np.int64)
