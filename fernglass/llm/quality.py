"""Quality classifier: naive Bayes support vectors.

A text is the set of its n-grams: of its UTF-8 bytes, 1 to 4 long, and of its repeats, that is runs of words that equal
the word before them. The indicator of each n-gram is scaled by the logarithm of the ratio of its (smoothed) shares in
the two classes; on the scaled indicators, brought to length 1, a linear model of least hinge loss is fitted by dual
coordinate descent. n-grams are hashed to a fixed number of features.
"""

from __future__ import annotations

import re
from collections.abc import Iterator, Sequence
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import small_batches
from .labelled import held_out, logistic, share_of, training_rows

BITS = 17
DIM = 1 << BITS
_MIX = 2654435761
_WORD = re.compile(r"\S+")
#: The runs of repeated words that are told apart.
RUNS = (1, 2, 4, 8, 16)


def features(text: str) -> np.ndarray:
    """The numbers of the n-grams that the text holds, ascending."""
    b = np.frombuffer(text.encode("utf-8", "replace"), np.uint8).astype(np.uint32)
    seen = np.zeros(DIM, bool)
    code = b
    for n in range(1, 5):
        if len(b) < n:
            break
        if n > 1:
            code = code[:-1] | (b[n - 1 :] << np.uint32(8 * (n - 1)))
        seen[((code + np.uint32(n * 0x9E3779B1 & 0xFFFFFFFF)) * np.uint32(_MIX)) >> np.uint32(32 - BITS)] = True
    run = longest = 0
    before = None
    for m in _WORD.finditer(text):
        word = m.group()
        run = run + 1 if word == before else 0
        longest = max(longest, run)
        before = word
    for i, least in enumerate(RUNS):
        if longest >= least:
            seen[(i * 7919 + 13) % DIM] = True
    return np.flatnonzero(seen).astype(np.int32)


class Model(NamedTuple):
    """scaled: for each feature its weight times its log-count ratio; square: the ratio's square."""

    scaled: np.ndarray
    square: np.ndarray
    bias: float
    slope: float
    offset: float

    def margin(self, found: np.ndarray) -> float:
        length = float(self.square[found].sum())
        return self.bias + (float(self.scaled[found].sum()) / np.sqrt(length) if length > 0 else 0.0)

    def score(self, found: np.ndarray) -> float:
        return float(1 / (1 + np.exp(-np.clip(self.slope * self.margin(found) + self.offset, -35, 35))))


#: Bytes of the texts of each label that the model learns from.
MOST_BYTES = 12 << 20


def log_count_ratio(rows: list[np.ndarray], labels: np.ndarray, smooth: float = 1.0) -> np.ndarray:
    """For each feature the log of its share among the features of label 1 over that of label 0."""
    counts = np.full((2, DIM), smooth)
    for x, y in zip(rows, labels, strict=True):
        counts[int(y), x] += 1
    return np.log(counts[1] / counts[1].sum()) - np.log(counts[0] / counts[0].sum())


class Scaled(Sequence):
    """The ratios of each row's features, scaled to length 1. Made when they are read: kept, they would take twice the
    memory of the features."""

    def __init__(self, rows: list[np.ndarray], ratio: np.ndarray) -> None:
        self.rows, self.ratio = rows, ratio

    def __len__(self) -> int:
        return len(self.rows)

    def __getitem__(self, i: int) -> np.ndarray:
        v = self.ratio[self.rows[i]]
        return v / max(np.sqrt(v @ v), 1e-12)


def dual_coordinate_descent(rows: list[np.ndarray], values: Sequence[np.ndarray], labels: np.ndarray, cost: float = 1.0, epochs: int = 20, seed: int = 5) -> tuple[np.ndarray, float]:
    """(w, b) with the least |w|^2 / 2 + b^2 / 2 + cost * sum of hinge losses. One dual variable is solved for at a
    time, in a new random order each epoch; stops when no variable moves by much."""
    y = np.where(labels == 1, 1.0, -1.0)
    w, b = np.zeros(DIM), 0.0
    alpha = np.zeros(len(rows))
    norms = np.array([v @ v for v in values]) + 1.0
    random = np.random.default_rng(seed)
    for _ in range(epochs):
        largest = 0.0
        for i in random.permutation(len(rows)):
            x, v = rows[i], values[i]
            slope = y[i] * (w[x] @ v + b) - 1
            new = min(max(alpha[i] - slope / norms[i], 0.0), cost)
            step = (new - alpha[i]) * y[i]
            if step:
                w[x] += step * v
                b += step
                largest = max(largest, abs(step))
                alpha[i] = new
        if largest < 1e-3 * cost:
            break
    return w, b


def fit(rows: list[np.ndarray], labels: np.ndarray, share: float | None = None, cost: float = 1.0, folds: int = 4) -> Model:
    """The model of the rows. Probabilities are calibrated on margins of models that haven't seen the row, and moved to
    share, the share of label 1 in the whole of the labelled rows (by default in these). With rows of one label alone,
    or none, all scores are that share."""

    def plain(at: np.ndarray) -> tuple[np.ndarray, np.ndarray, float]:
        ratio = log_count_ratio([rows[i] for i in at], labels[at])
        seen = [rows[i] for i in at]
        w, b = dual_coordinate_descent(seen, Scaled(seen, ratio), labels[at], cost)
        return w * ratio, ratio**2, b

    everything = np.arange(len(rows))
    own = float(labels.mean()) if len(rows) else 0.5
    share = min(max(own if share is None else share, 1e-3), 1 - 1e-3)
    prior = np.log(share / (1 - share))
    if own in (0.0, 1.0) or len(rows) < 2:
        return Model(np.zeros(DIM), np.zeros(DIM), 0.0, 0.0, float(prior))
    margins = np.zeros(len(rows))
    for k in range(folds):
        out, rest = everything[everything % folds == k], everything[everything % folds != k]
        if len(out) and 0 < labels[rest].mean() < 1:
            part = Model(*plain(rest), 1.0, 0.0)
            margins[out] = [part.margin(rows[i]) for i in out]
    slope, offset = logistic(margins[:, None], labels)
    return Model(*plain(everything), slope, float(offset + prior - np.log(own / (1 - own))))


def train(docs: DataFrame, labels: DataFrame, label: str = "quality", bound: int = 4000, key: str = "doc_id", text: str = "text", most_bytes: int = MOST_BYTES) -> Model:
    """Fits the model on at most `bound` labelled rows, half of each label, and most_bytes of the texts of each label (see
    training_rows); their features come to the driver, 4 bytes each, at most four for each byte of text, so no more than 32
    times most_bytes (384 MB) whatever the texts are. The share of label 1 is counted over all labels that aren't held out."""

    def found(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = [features(t).tobytes() for t in batch.column(0).to_pylist()]
            yield pa.RecordBatch.from_arrays([pa.array(rows, pa.binary()), batch.column(1), batch.column(2)], ["found", "label", "_h"])

    sample = training_rows(docs, labels, label, (bound // 2, bound - bound // 2), key, text, most_bytes).mapInArrow(found, "found binary, label int, _h bigint").toArrow()
    order = np.lexsort((np.array([len(v) for v in sample["found"].to_pylist()], np.int64), sample["_h"].to_numpy()))
    rows = [np.frombuffer(v, np.int32) for v in sample.column("found").to_pylist()]
    y = sample["label"].to_numpy()
    share = share_of(labels, label, key)
    return fit([rows[i] for i in order], y[order], share)


def classify(docs: DataFrame, labels: DataFrame, label: str = "quality", threshold: float = 0.7, bound: int = 4000, key: str = "doc_id", text: str = "text", most_bytes: int = MOST_BYTES) -> DataFrame:
    """Scores every whole text by its n-grams alone.

    Returns key, held_out (the row's label, if any, wasn't learnt from), score (0 to 1; higher: label 1 likelier) and
    predicted (1 if score >= threshold, else 0). A null text counts as empty; a text without n-grams gets the score of
    the bias. Equal texts get equal scores. Without labels of both kinds all scores are equal. Other columns aren't
    read.
    """
    model = train(docs, labels, label, bound, key, text, most_bytes)
    held = docs.sparkSession.sparkContext.broadcast(model)  # fixed size: two vectors of DIM numbers

    def scored(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = held.value
        for batch in batches:
            scores = [own.score(features(t or "")) for t in batch.column(2).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(scores, pa.float64())], [key, "held_out", "score"])

    plain = small_batches(docs).select(F.col(key).alias(key), held_out(F.col(key)).alias("held_out"), F.col(text).cast("string").alias("_text"))
    kind = plain.schema[key].dataType.simpleString()
    out = plain.mapInArrow(scored, f"`{key}` {kind}, held_out boolean, score double")
    return out.withColumn("predicted", (F.col("score") >= threshold).cast("int"))


def keep_good(docs: DataFrame, labels: DataFrame, label: str = "quality", threshold: float = 0.7, bound: int = 4000, key: str = "doc_id", text: str = "text", most_bytes: int = MOST_BYTES) -> DataFrame:
    """The documents, all columns, without those that classify() gives 0. Scores go along with the rows, so no join
    is needed, and the key need not be unique."""
    model = train(docs, labels, label, bound, key, text, most_bytes)
    held = docs.sparkSession.sparkContext.broadcast(model)
    names = docs.columns
    at = names.index(text)

    def kept(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = held.value
        for batch in batches:
            good = pa.array([own.score(features(t or "")) >= threshold for t in batch.column(at).to_pylist()], pa.bool_())
            yield batch.filter(good)

    return small_batches(docs).mapInArrow(kept, docs.schema)
