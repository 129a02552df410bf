"""Periodic runs of words: repeated k-gram masking, then divide and conquer after Main and Lorentz on what is left.

A run of smallest period q has at least max(least, power * q) words, so at least that many less q of its words stand again
q words further on. Hence each word of a run lies in a k-gram that its document holds twice, k being the least overlap of
all periods (5 for runs of 6 words and 4 periods). Words outside such k-grams can't belong to a run; they cut the document
into segments, most of which are empty. Inside a segment a run crosses the middle of exactly one node of a binary
division, with power / 2 periods on one side of it at least: so each node tries the periods that fit in a side, one pair of
places each, and extends those that match to both ends of the run. Blocks of 2^j words have names (equal names, equal
words), so a pair is tested at once and extended in a logarithm of steps; results are exact.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import compress

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import small_batches

#: Words, and periods, that a run has at least.
LEAST, POWER = 6, 4
_ODD = np.uint64(0x9E3779B97F4A7C15)


def overlap(least: int = LEAST, power: int = POWER) -> int:
    """The k of the k-grams: over all periods q, the fewest words of a run that stand again q words further on."""
    if power < 2 or least < 2:
        raise ValueError("a run needs two words and two periods")
    return min(max(least, power * q) - q for q in range(1, least + 1))


def segments(codes: np.ndarray, k: int) -> list[tuple[int, int]]:
    """(start, end) of the longest stretches of words that k-grams of the text cover that stand in it twice. k-grams are told
    apart by 64-bit numbers: two that had the same would leave more words, never fewer."""
    n = len(codes) - k + 1
    if n < 2:
        return []
    gram = np.zeros(n, np.uint64)
    for i in range(k):
        gram = gram * _ODD + codes[i : i + n].astype(np.uint64) + np.uint64(1)
    ordered = np.sort(gram)
    twice = ordered[1:][ordered[1:] == ordered[:-1]]
    if not len(twice):
        return []
    at = np.flatnonzero(np.isin(gram, twice))
    steps = np.zeros(len(codes) + 2, np.int64)
    np.add.at(steps, at + 1, 1)
    np.add.at(steps, at + k + 1, -1)
    edges = np.flatnonzero(np.diff((np.cumsum(steps) > 0).astype(np.int8)))
    return list(zip(edges[::2].tolist(), edges[1::2].tolist(), strict=True))


def _names(codes: np.ndarray) -> np.ndarray:
    """Row j: for each place the name of the 2^j words from there, -1 where they don't fit."""
    n = len(codes)
    rows = [np.unique(codes, return_inverse=True)[1].astype(np.int32)]
    while 2 << (len(rows) - 1) <= n:
        half, row = 1 << (len(rows) - 1), np.full(n, -1, np.int32)
        m = n - 2 * half + 1
        row[:m] = np.unique(rows[-1][:m].astype(np.int64) * (n + 1) + rows[-1][half : half + m], return_inverse=True)[1]
        rows.append(row)
    return np.array(rows)


def _ends(names: np.ndarray, i: np.ndarray, p: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(first word, last word + 1) of the longest stretch of period p around the equal words at i and i + p."""
    n, low, high = names.shape[1], i.copy(), i + p
    for j in range(len(names) - 1, -1, -1):
        step = 1 << j
        on = high + step <= n
        on[on] = names[j, high[on] - p[on]] == names[j, high[on]]
        high[on] += step
        back = low >= step
        back[back] = names[j, low[back] - step] == names[j, low[back] - step + p[back]]
        low[back] -= step
    return low, high


def segment_runs(codes: np.ndarray, least: int = LEAST, power: int = POWER) -> np.ndarray:
    """Rows (start, length, period) of all runs in the words, ordered by start and period. Takes n log n steps and 4 log n
    bytes a word."""
    n, found = len(codes), []
    if n < least:
        return np.empty((0, 3), np.int64)
    names, low, high = _names(codes), np.array([0]), np.array([n])
    while len(low):
        middle = (low + high) // 2
        for side, right in ((high - middle, True), (middle - low, False)):
            count = 2 * side // power
            m = np.repeat(middle, count)
            p = np.arange(len(m)) - np.repeat(np.cumsum(count) - count, count) + 1
            # the larger side holds this many words twice, p apart; 2^j of them are compared
            j = np.log2((power - 2) * p // 2 + 1).astype(np.int64)
            i = m - 1 if right else m - p - (1 << j) + 1
            same = names[j, i] == names[j, i + p]
            i, p = i[same], p[same]
            if len(i):
                start, end = _ends(names, i, p)
                long = end - start >= np.maximum(least, power * p)
                found.append(np.stack([start, end - start, p], axis=1)[long])
        low, high = np.concatenate([low, middle]), np.concatenate([middle, high])
        wide = high - low >= least
        low, high = low[wide], high[wide]
    runs = np.concatenate(found) if found else np.empty((0, 3), np.int64)
    # a stretch has its smallest period and the multiples that fit
    runs = runs[np.lexsort((runs[:, 2], runs[:, 1], runs[:, 0]))]
    first = np.ones(len(runs), bool)
    first[1:] = (runs[1:, :2] != runs[:-1, :2]).any(axis=1)
    runs = runs[first]
    return runs[np.lexsort((runs[:, 2], runs[:, 0]))]


def word_runs(words: list, least: int = LEAST, power: int = POWER) -> np.ndarray:
    """Rows (start, length, period) of all runs of the words, ordered by start and period."""
    number = dict.fromkeys(words)
    for i, w in enumerate(number):
        number[w] = i
    codes = np.fromiter(map(number.__getitem__, words), np.int64, len(words))
    found = [segment_runs(codes[a:b], least, power) + [a, 0, 0] for a, b in segments(codes, overlap(least, power)) if b - a >= least]
    return np.concatenate(found) if found else np.empty((0, 3), np.int64)


def collapsed(words: list[bytes], runs: np.ndarray) -> bytes:
    """The words joined by a space, of each run its first period alone."""
    if len(runs):
        steps = np.zeros(len(words) + 1, np.int64)
        np.add.at(steps, runs[:, 0] + runs[:, 2], 1)
        np.add.at(steps, runs[:, 0] + runs[:, 1], -1)
        words = compress(words, (np.cumsum(steps)[:-1] == 0).tolist())
    return b" ".join(words)


_RUN = pa.struct([("start", pa.int64()), ("length", pa.int64()), ("period", pa.int64())])


def find_runs(docs: DataFrame, key: str = "doc_id", text: str = "text", least: int = LEAST, power: int = POWER) -> DataFrame:
    """The runs of each whole text, and the text without their repeats.

    Returns key, n_words, runs (start, length, period of each, words being numbered from 0, ordered by start and period)
    and text: the words that no run holds after its first period, joined by one space. Words are runs of anything but
    space, tab, line feed, vertical tab, form feed and carriage return. A run has `least` words and `power` of its smallest
    periods at least, and can't be extended on either side. A null text has no words and stays null; an empty one
    has none. Each row is judged by itself, so null and repeated keys do no harm. Other columns aren't read. An empty
    table gives an empty result.
    """
    overlap(least, power)
    plain = small_batches(docs).select(F.col(key).alias(key), F.col(text).cast("string").cast("binary").alias("_text"))

    def found(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            n, runs, texts = [], [], []
            for t in batch.column(1):
                words = (t.as_py() or b"").split()
                runs.append(word_runs(words, least, power))
                n.append(len(words))
                texts.append(collapsed(words, runs[-1]) if t.is_valid else None)
            at = pa.array(np.concatenate([[0], np.cumsum([len(r) for r in runs])]), pa.int32())
            rows = np.concatenate([np.empty((0, 3), np.int64), *runs])
            spans = pa.StructArray.from_arrays([pa.array(rows[:, i]) for i in range(3)], fields=list(_RUN))
            columns = [batch.column(0), pa.array(n, pa.int64()), pa.ListArray.from_arrays(at, spans), pa.array(texts, pa.binary())]
            yield pa.RecordBatch.from_arrays(columns, ["_key", "n_words", "runs", "_kept"])

    kind = plain.schema[key].dataType.simpleString()
    out = plain.mapInArrow(found, f"_key {kind}, n_words bigint, runs array<struct<start:bigint,length:bigint,period:bigint>>, _kept binary")
    return out.select(F.col("_key").alias(key), "n_words", "runs", F.col("_kept").cast("string").alias(text))
