"""Toxicity: compression-distance classification.

Two zstandard dictionaries are trained, one on ordinary text, one on what sets toxic text apart. Toxic text is mostly
made of ordinary words, so the second dictionary is trained on spans of toxic training texts: words that hold byte grams
far more frequent in toxic than in ordinary texts. Every whole text is cut into overlapping windows, each of which
is compressed twice, after the ordinary dictionary alone and after the toxic one followed by the ordinary one. Both
share the offsets of the ordinary part, so a window without toxic spans has the same length in both; the bytes that a
window saves are its gain. Thresholds on gains are calibrated on training texts that the dictionaries haven't seen.
"""

from __future__ import annotations

from collections import Counter, defaultdict
from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import small_batches
from .labelled import MOST_BYTES, held_out, logistic, share_of, training_rows

#: The lengths of the grams that are looked at: short ones for words of their own, long ones for words that are odd only
#: as a whole.
GRAMS = (5, 8)
WINDOW, OVERLAP = 128, 16
TOXIC_BYTES, ORDINARY_BYTES = 4096, 8192
#: A gram sets toxic text apart if its share of toxic texts is RATIO times that of ordinary ones or more, its
#: log-likelihood ratio is EVIDENCE or more, and its contexts differ, so that a copied passage isn't taken for one.
RATIO, EVIDENCE = 20.0, 30.0


def grams(b: bytes, length: int) -> np.ndarray:
    """The code of the gram at each position."""
    a = np.frombuffer(b, np.uint8).astype(np.uint64)
    n = len(a) - length + 1
    code = np.zeros(max(n, 0), np.uint64)
    for i in range(length if n > 0 else 0):
        code |= a[i : i + n] << np.uint64(8 * i)
    return code


def _frequencies(texts: list[bytes], length: int, chunk: int = 256) -> tuple[np.ndarray, np.ndarray]:
    """Codes, ascending, and how many of the texts hold each."""
    codes, counts = np.empty(0, np.uint64), np.empty(0, np.int64)
    for i in range(0, len(texts), chunk):
        part = np.concatenate([codes, *[np.unique(grams(t, length)) for t in texts[i : i + chunk]]])
        weight = np.concatenate([counts, np.ones(len(part) - len(codes), np.int64)])
        codes, at = np.unique(part, return_inverse=True)
        counts = np.bincount(at, weights=weight, minlength=len(codes)).astype(np.int64)
    return codes, counts


def evidence(toxic: np.ndarray, ordinary: np.ndarray, n_toxic: int, n_ordinary: int) -> np.ndarray:
    """The log-likelihood ratio of each gram for texts of two kinds; 0 unless it is RATIO times more frequent in toxic
    ones."""
    both = np.maximum(toxic + ordinary, 1)
    mean = both * n_toxic / (n_toxic + n_ordinary)
    gain = 2 * (toxic * np.log(np.maximum(toxic, 1) / mean) + ordinary * np.log(np.maximum(ordinary, 1) / np.maximum(both - mean, 1e-9)))
    return np.where((toxic >= 2) & (toxic / n_toxic >= RATIO * (ordinary + 0.5) / n_ordinary), gain, 0.0)


def toxic_spans(toxic: list[bytes], ordinary: list[bytes]) -> list[list[bytes]]:
    """For each toxic text the spans that set toxic text apart.

    The gram of most evidence is taken, and the words that hold it are set aside with all their grams, until no gram
    left has enough. So grams that are frequent only as parts of such words, or next to them, are not taken for more.
    """
    if not toxic or not ordinary:
        return [[] for _ in toxic]
    tables = []
    for length in GRAMS:
        codes, counts = _frequencies(toxic, length)
        others, n_others = _frequencies(ordinary, length)
        at = np.minimum(np.searchsorted(others, codes), max(len(others) - 1, 0))
        elsewhere = np.where(others[at] == codes, n_others[at], 0) if len(others) else np.zeros(len(codes), np.int64)
        inner = np.zeros(len(codes), bool)  # grams across two words
        for i in range(1, length - 1):
            inner |= np.isin((codes >> np.uint64(8 * i)) & np.uint64(255), np.array([9, 10, 13, 32], np.uint64))
        chosen = ~inner & (evidence(counts, elsewhere, len(toxic), len(ordinary)) >= EVIDENCE)
        tables.append((length, codes[chosen], elsewhere[chosen]))
    outside = np.concatenate([t[2] for t in tables])
    if not len(outside):
        return [[] for _ in toxic]

    # for each text the words that hold such grams, by their position, with (begin, end, number of the gram)
    words: list[dict[int, list[tuple[int, int, int]]]] = []
    holders: dict[int, set[int]] = defaultdict(set)
    contexts: dict[int, set[bytes]] = defaultdict(set)
    for d, b in enumerate(toxic):
        own: dict[int, list[tuple[int, int, int]]] = defaultdict(list)
        first = 0
        for length, codes, _ in tables:
            g = grams(b, length)
            near = np.minimum(np.searchsorted(codes, g), len(codes) - 1)
            for i in np.flatnonzero(codes[near] == g) if len(codes) else ():
                i, c = int(i), first + int(near[i])
                middle = i + length // 2
                own[max(b.rfind(b" ", 0, middle + 1), b.rfind(b"\n", 0, middle + 1))].append((i, i + length, c))
                holders[c].add(d)
                contexts[c].add(b[max(i - 10, 0) : i])
            first += len(codes)
        words.append(dict(own))
    holders = {c: h for c, h in holders.items() if 2 * len(contexts[c]) > len(h)}
    dropped = set(range(len(outside))) - set(holders)

    def worth(c: int) -> float:
        return float(evidence(np.array([len(holders[c])]), outside[c : c + 1], len(toxic), len(ordinary))[0])

    left = {c: worth(c) for c in holders}
    spans: list[list[bytes]] = [[] for _ in toxic]
    while left:
        best = max(left, key=lambda c: (left[c], -c))
        if left[best] < EVIDENCE:
            break
        touched = set()
        for d in list(holders[best]):
            for w in [w for w, found in words[d].items() if any(c == best for *_, c in found)]:
                found = sorted(x for x in words[d].pop(w) if x[2] not in dropped)
                touched |= {c for *_, c in found}
                begin, end, _ = found[0]
                for i, j, _ in found[1:]:
                    if i > end:
                        spans[d].append(toxic[d][begin:end])
                        begin = i
                    end = max(end, j)
                spans[d].append(toxic[d][begin:end])
            still = {c for found in words[d].values() for *_, c in found}
            for c in touched - still:
                holders[c].discard(d)
        for c in touched:
            left[c] = worth(c)
        left.pop(best)
    return spans


def train_dictionary(samples: list[bytes], size: int) -> bytes:
    """A zstandard dictionary of the samples; where they are too few to train on, their most frequent ones."""
    try:
        return zstandard.train_dictionary(size, samples).as_bytes()
    except zstandard.ZstdError:
        return b"".join(s for s, _ in Counter(samples).most_common()[::-1])[-size:]


def windows(b: bytes) -> Iterator[bytes]:
    """The whole text in windows of WINDOW bytes, each with the last OVERLAP bytes of the one before."""
    for i in range(0, max(1, len(b) - OVERLAP), WINDOW - OVERLAP):
        yield b[i : i + WINDOW]


class Gains:
    """Measures what windows save with the toxic dictionary. Not to be pickled; each task makes its own."""

    def __init__(self, toxic: bytes, ordinary: bytes) -> None:
        params = zstandard.ZstdCompressionParameters.from_level(
            19, source_size=WINDOW, dict_size=len(toxic) + len(ordinary), min_match=min(GRAMS), strategy=zstandard.STRATEGY_BTULTRA, write_checksum=False, write_content_size=False, write_dict_id=False
        )
        self.with_, self.without = (
            zstandard.ZstdCompressor(compression_params=params, dict_data=self._dictionary(content, params)) for content in (toxic + ordinary, ordinary)
        )

    @staticmethod
    def _dictionary(content: bytes, params: zstandard.ZstdCompressionParameters) -> zstandard.ZstdCompressionDict:
        d = zstandard.ZstdCompressionDict(content.ljust(8), dict_type=zstandard.DICT_TYPE_RAWCONTENT)
        d.precompute_compress(compression_params=params)
        return d

    def of(self, text: str) -> np.ndarray:
        """What is compared with the thresholds: the largest gain, how many windows gain 1, 2 and 4 bytes or more, how many
        there are; all as logarithms."""
        short, plain = self.with_.compress, self.without.compress
        gain = np.array([len(plain(w)) - len(short(w)) for w in windows(text.encode("utf-8", "replace"))])
        return np.log1p([max(gain.max(), 0), (gain >= 1).sum(), (gain >= 2).sum(), (gain >= 4).sum(), len(gain)])


class Model(NamedTuple):
    toxic: bytes
    ordinary: bytes
    weights: np.ndarray

    def score(self, found: np.ndarray) -> float:
        return float(1 / (1 + np.exp(-np.clip(found @ self.weights[:-1] + self.weights[-1], -35, 35))))


def fit(texts: list[str], labels: np.ndarray, share: float | None) -> Model:
    """The model of the texts: dictionaries from two thirds of them, thresholds from the rest. share, the share of
    toxic texts among all labels, moves the probabilities. Without spans that set toxic texts apart, or without texts
    of both labels in the rest, all scores are that share."""
    turn = np.arange(len(texts)) % 3 < 2
    seen = {y: [t.encode("utf-8", "replace") for t, l, s in zip(texts, labels, turn, strict=True) if s and l == y] for y in (0, 1)}
    own = float(labels[~turn].mean()) if (~turn).any() else 0.0
    share = min(max(own if share is None else share, 1e-3), 1 - 1e-3)
    prior = float(np.log(share / (1 - share)))
    spans = toxic_spans(seen[1], seen[0])
    if own in (0.0, 1.0) or not any(spans):
        return Model(b"", b"", np.array([0.0] * 5 + [prior]))
    pieces = [b[i : i + 1024] for b in seen[0] for i in range(0, len(b), 1024)]
    ordinary = train_dictionary(pieces, ORDINARY_BYTES)
    toxic = train_dictionary([b" ".join(s) for s in spans if s], TOXIC_BYTES)
    gains = Gains(toxic, ordinary)
    x = np.array([gains.of(t) for t, s in zip(texts, turn, strict=True) if not s])
    weights = logistic(x, labels[~turn], ridge=0.05)
    weights[-1] += prior - np.log(own / (1 - own))
    return Model(toxic, ordinary, weights)


def train(docs: DataFrame, labels: DataFrame, label: str = "toxic", bounds: tuple[int, int] = (3600, 1800), key: str = "doc_id", text: str = "text", most_bytes: int = MOST_BYTES) -> Model:
    """Fits the model on at most bounds[0] ordinary and bounds[1] toxic labelled rows and most_bytes of their
    texts of each label (see training_rows), which come to the driver. The share of toxic texts is counted over all labels that aren't held out."""
    sample = training_rows(docs, labels, label, bounds, key, text, most_bytes).toArrow()
    rows = sorted(zip(sample["_h"].to_pylist(), sample["text"].to_pylist(), sample["label"].to_pylist(), strict=True))
    return fit([t for _, t, _ in rows], np.array([y for _, _, y in rows], int), share_of(labels, label, key))


def classify(docs: DataFrame, labels: DataFrame, label: str = "toxic", threshold: float = 0.3, bounds: tuple[int, int] = (3600, 1800), key: str = "doc_id", text: str = "text", most_bytes: int = MOST_BYTES) -> DataFrame:
    """Scores every whole text by the gains of its windows alone.

    Returns key, held_out (the row's label, if any, wasn't learnt from), score (0 to 1; higher: toxic likelier) and
    predicted (1 if score >= threshold, else 0). A null text counts as empty: one empty window that gains nothing. Equal
    texts get equal scores. Without labels of both kinds all scores are equal. Other columns aren't read.
    """
    held = docs.sparkSession.sparkContext.broadcast(train(docs, labels, label, bounds, key, text, most_bytes))  # two dictionaries of fixed size

    def scored(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = held.value
        gains = Gains(model.toxic, model.ordinary) if model.toxic else None
        for batch in batches:
            found = [gains.of(t or "") if gains else np.zeros(5) for t in batch.column(2).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array([model.score(x) for x in found], pa.float64())], [key, "held_out", "score"])

    plain = small_batches(docs).select(F.col(key).alias(key), held_out(F.col(key)).alias("held_out"), F.col(text).cast("string").alias("_text"))
    kind = plain.schema[key].dataType.simpleString()
    out = plain.mapInArrow(scored, f"`{key}` {kind}, held_out boolean, score double")
    return out.withColumn("predicted", (F.col("score") >= threshold).cast("int"))
