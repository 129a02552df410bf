"""What the operators on vectors share."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Vectors travel between tasks as bytes of this type; it holds any float or double without change.
PLAIN = np.float64


def to_rows(column: pa.Array | pa.ChunkedArray) -> list[np.ndarray | None]:
    """The vectors of a list column; None where one is null, empty, zero, or holds null or non-finite numbers."""
    column = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    flat = column.flatten().cast(pa.float64()).to_numpy(zero_copy_only=False)
    ends = np.cumsum(np.where(column.is_valid().to_numpy(zero_copy_only=False), column.value_lengths().fill_null(0).to_numpy(zero_copy_only=False), 0))
    out: list[np.ndarray | None] = []
    begin = 0
    for end in ends:
        v = flat[begin:end]
        begin = end
        out.append(v if len(v) and np.isfinite(v).all() and v.any() else None)
    return out


def usable(df: DataFrame, key: str, vector: str) -> DataFrame:
    """(id, d, vec) of the rows whose vector can be compared: vec holds it in double precision, d its length. Rows
    without a key are left out."""

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            got = [(i, v) for i, v in zip(batch.column(0).to_pylist(), to_rows(batch.column(1)), strict=True) if v is not None]
            yield pa.RecordBatch.from_arrays(
                [pa.array([i for i, _ in got], pa.int64()), pa.array([len(v) for _, v in got], pa.int32()), pa.array([v.astype(PLAIN).tobytes() for _, v in got], pa.binary())],
                ["id", "d", "vec"],
            )

    plain = df.select(F.col(key).cast("bigint").alias("id"), F.col(vector).alias("vec")).where("id is not null")
    return plain.mapInArrow(rows, "id bigint, d int, vec binary")


def matrix(column: pa.ChunkedArray) -> np.ndarray:
    """The rows of a vec column, of one length, as a matrix."""
    values = column.to_pylist()
    return np.frombuffer(b"".join(values), PLAIN).reshape(len(values), -1) if values else np.empty((0, 0))


def unit_rows(x: np.ndarray) -> np.ndarray:
    """Each row divided by its length; by its largest part first, so that squares neither vanish nor overflow."""
    x = x / np.abs(x).max(axis=1, keepdims=True)
    return x / np.sqrt(np.einsum("ij,ij->i", x, x))[:, None]


def rotation(d: int, seed: int = 7) -> np.ndarray:
    """A random orthogonal matrix that depends on d and seed alone, the same in every task."""
    q, r = np.linalg.qr(np.random.default_rng([seed, d]).standard_normal((d, d)))
    return q * np.sign(np.diag(r))


def cosines(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """The cosine of each row of a with the same row of b, in double precision, the same whatever the other rows."""
    a, b = a / np.abs(a).max(axis=1, keepdims=True), b / np.abs(b).max(axis=1, keepdims=True)
    dot = (a * b).sum(axis=1)
    return dot / np.sqrt((a * a).sum(axis=1) * (b * b).sum(axis=1))
