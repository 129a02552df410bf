"""Sinks: CSV, JSON, HTML, Parquet tables."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Observation
from pyspark.sql import functions as F


def write_csv(df: DataFrame, path: str, single_file: bool = False, mode: str = "overwrite") -> None:
    """CSV with header and doubled quotes. single_file, for exports, merges partitions after the sort, in order."""
    (df.coalesce(1) if single_file else df).write.mode(mode).csv(path, header=True, escape='"', quote='"')


def write_json(df: DataFrame, path: str, mode: str = "overwrite", compression: str | None = None) -> None:
    """One JSON object a line. compression: a codec's name, such as gzip."""
    df.write.mode(mode).json(path, compression=compression)


def write_text(df: DataFrame, column: str, path: str, mode: str = "overwrite") -> None:
    df.select(F.col(column).alias("value")).write.mode(mode).text(path)


#: Rows of a file of a sorted table at most.
FILE_ROWS = 4_000_000


def write_table(df: DataFrame, path: str, sort: Sequence[str] = (), mode: str = "overwrite", file_rows: int = FILE_ROWS, compression: str | None = None) -> None:
    """Parquet; compression: a codec's name. With sort, rows of a first value lie together, and files are sorted, so that reads skip row groups.

    Rows are dealt by the hash of the first column and rebalanced: adaptive execution splits what is larger than its advisory
    size, so a value that half of all rows have becomes several tasks, and files, each of them sorted. No file has more
    than file_rows rows. Ranges would have to be sampled first, which computes df twice.
    """
    dealt = df.hint("rebalance", sort[0]).sortWithinPartitions(*sort) if sort else df
    dealt.write.mode(mode).option("maxRecordsPerFile", file_rows).parquet(path, compression=compression)


def write_observed(df: DataFrame, path: str, totals: dict[str, Column], mode: str = "overwrite", by: Sequence[str] = ()) -> dict[str, int]:
    """Writes Parquet, and returns the totals (aggregates by name) of the rows as they went by: no second pass is made. They
    are of the write that succeeded; tasks that ran twice count once. by: columns that folders are made of."""
    seen = Observation()
    writer = df.observe(seen, *[c.alias(name) for name, c in totals.items()]).write.mode(mode)
    (writer.partitionBy(*by) if by else writer).parquet(path)
    return dict(seen.get)


def write_checked(checked: DataFrame, path: str, mode: str = "overwrite") -> tuple[DataFrame, DataFrame, dict[str, int]]:
    """(accepted, rejected, totals) of rows with reasons (see readers.read_csv_checked), in one pass: both tables lie under path.
    Accepted rows have the columns of the data; rejected ones raw and reasons as well. totals: read, accepted, rejected."""
    accepted = F.size("reasons") == 0
    totals = {"read": F.count("*"), "accepted": F.count_if(accepted), "rejected": F.count_if(~accepted)}
    marked = checked.withColumn("_accepted", accepted)
    seen = write_observed(marked, path, totals, mode, ["_accepted"])
    rows = checked.sparkSession.read.schema(marked.schema).parquet(path)  # one part may have no files
    return rows.where("_accepted").drop("_accepted", "raw", "reasons"), rows.where("not _accepted").drop("_accepted"), seen
