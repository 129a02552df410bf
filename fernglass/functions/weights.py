"""Term weights as Column arithmetic."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: The names of the two inverse document frequencies.
STANDARD, PROBABILISTIC = "standard", "probabilistic"
#: BM25's saturation and length parameters.
K1, B = 1.2, 0.75


def log_tf(tf: Column) -> Column:
    """1 + ln(tf), 0 unless tf is positive."""
    return F.when(tf > 0, 1 + F.log(tf.cast("double"))).otherwise(F.lit(0.0))


def idf_standard(df: Column, n: Column) -> Column:
    """ln(n / (df + 1)), 0 for df = 0. Negative for a term in all documents."""
    return F.when(df == 0, F.lit(0.0)).otherwise(F.log(n.cast("double") / (df + 1)))


def idf_probabilistic(df: Column, n: Column) -> Column:
    """ln((n - df) / df), not below 0; 0 for df = 0 and df = n."""
    rest = F.when((df > 0) & (df < n), (n - df).cast("double") / df)
    return F.coalesce(F.greatest(F.lit(0.0), F.log(rest)), F.lit(0.0))


def bm25(tf: Column, length: Column, df: Column, n: Column, mean_length: Column) -> Column:
    return bm25_idf(df, n) * bm25_tf(tf, length, mean_length)


def bm25_idf(df: Column, n: Column) -> Column:
    return F.log(1 + (n - df + 0.5) / (df + 0.5))


def bm25_tf(tf: Column, length: Column, mean_length: Column) -> Column:
    return tf / (tf + F.lit(K1) * (F.lit(1 - B) + F.lit(B) * length / mean_length))
