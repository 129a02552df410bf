"""Which labelled rows a classifier may learn from, and how scores become probabilities."""

from __future__ import annotations

import logging

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import cut


def held_out(key: Column) -> Column:
    """True for the rows that no classifier learns from: crc32 of the key as text leaves 2 when divided by 4. A null
    key counts as an empty string."""
    return F.crc32(F.coalesce(key.cast("string"), F.lit("")).cast("binary")) % 4 == 2


#: Bytes of the texts of each label that a classifier learns from.
MOST_BYTES = 16 << 20


def training_rows(docs: DataFrame, labels: DataFrame, label: str, bounds: tuple[int, int], key: str = "doc_id", text: str = "text", most_bytes: int = MOST_BYTES) -> DataFrame:
    """(text, label, _h) of labelled rows that aren't held out: of label 0 at most bounds[0], of label 1 at most
    bounds[1], those with the smallest key hashes _h. In that order a text is taken if it fits in what is left of most_bytes,
    which each label has; one that doesn't is passed over, and those after it are tried. So both the rows and their bytes are
    bounded whatever the tables hold. A label all of whose texts are longer than most_bytes has no rows, and is logged.

    The keys of the sample are sent to all tasks. Labels that are null or neither 0 nor 1 are left out; of repeated labels
    of a key the larger holds, of a key's documents the one whose text has the smallest hash. A key without a document
    counts in the bounds, but has no row. Null texts count as empty. Empty tables give no rows.
    """
    known = labels.select(F.col(key).alias("_k"), F.col(label).cast("int").alias("label")).where(F.col("label").isin(0, 1) & F.col("_k").isNotNull() & ~held_out(F.col("_k")))
    known = known.groupBy("_k").agg(F.max("label").alias("label")).withColumn("_h", F.xxhash64(F.col("_k").cast("string"), F.lit(label)))
    parts = [known.where(F.col("label") == value).orderBy("_h", "_k").limit(n) for value, n in enumerate(bounds)]
    texts = docs.select(F.col(key).alias("_k2"), F.coalesce(F.col(text).cast("string"), F.lit("")).alias("text"))
    found = texts.join(F.broadcast(parts[0].unionByName(parts[1])), F.col("_k2") == F.col("_k"))
    found = cut(found.groupBy("_k", "label", "_h").agg(F.min_by("text", F.xxhash64("text")).alias("text")))
    sizes = found.select("label", "_h", F.octet_length("text").alias("size")).collect()  # a few thousand rows of three numbers
    left, kept = dict.fromkeys((0, 1), most_bytes), []
    for x in sorted(sizes):
        if x["size"] <= left[x["label"]]:
            left[x["label"]] -= x["size"]
            kept.append(x["_h"])
    for value in {x["label"] for x in sizes} - {x["label"] for x in sizes if x["_h"] in set(kept)}:
        logging.getLogger(__name__).warning("nothing to learn from: each text labelled %s = %d has more than %d bytes", label, value, most_bytes)
    return found.where(F.col("_h").isin(kept)).select("text", "label", "_h")


def share_of(labels: DataFrame, label: str, key: str = "doc_id") -> float | None:
    """The share of label 1 among all labels that aren't held out; None without any."""
    known = labels.where(F.col(label).isin(0, 1) & F.col(key).isNotNull() & ~held_out(F.col(key)))
    return known.agg(F.avg(F.col(label).cast("double"))).first()[0]


def logistic(x: np.ndarray, labels: np.ndarray, ridge: float = 1e-3, steps: int = 100) -> np.ndarray:
    """(weights..., bias) such that 1 / (1 + exp(-(x @ weights + bias))) is the probability of label 1, by Newton's
    method; targets are drawn in a little, so that separable rows have a finite answer."""
    n1, n0 = int(labels.sum()), int((1 - labels).sum())
    goal = np.where(labels == 1, (n1 + 1) / (n1 + 2), 1 / (n0 + 2))
    x = np.concatenate([x, np.ones((len(x), 1))], axis=1)
    w = np.zeros(x.shape[1])
    for _ in range(steps):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -35, 35)))
        bend = (x * (p * (1 - p))[:, None]).T @ x + ridge * np.eye(len(w))
        step = np.linalg.solve(bend, x.T @ (p - goal) + ridge * w)
        w -= step * min(1.0, 5 / max(np.abs(step).max(), 1e-12))
        if np.abs(step).max() < 1e-9:
            break
    return w
