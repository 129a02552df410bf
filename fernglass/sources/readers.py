"""Sources: HTML folders, CSV, wiki dumps."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from fernglass.functions.storage import global_index
from fernglass.functions.text import natural_key


def strings(*names: str) -> T.StructType:
    return T.StructType([T.StructField(n, T.StringType()) for n in names])


# --- fixed values: column names -------------------------------------------------------------------------------------
#: The columns of a player record from HTML.
PLAYER = ("Player", "Position", "Height", "Weight", "BornYear", "BornCity", "BornState", "CurrentTeam", "DiedYear", "College", "HighSchool", "DraftTeam", "DraftYear")
#: The columns of a player record from a wiki dump.
WIKI_PLAYER = ("player_name", "birth_year", "birth_place", "height_ft", "height_in", "weight_lb", "college", "high_school", "draft_year", "draft_round", "info")
# --------------------------------------------------------------------------------------------------------------------


def read_html(spark: SparkSession, folder: str) -> DataFrame:
    """(file, html): each *.html file of the folder whole. A missing folder raises; an empty one gives no rows."""
    read = spark.read.option("pathGlobFilter", "*.html").text(folder, wholetext=True)
    return read.select(F.element_at(F.split("_metadata.file_path", "/"), -1).alias("file"), F.col("value").alias("html"))


def in_file_order(pages: DataFrame, file: str = "file") -> DataFrame:
    """Pages by file name, runs of digits as numbers."""
    return pages.orderBy(natural_key(F.col(file)), file)


def read_csv(spark: SparkSession, path: str, schema: T.StructType | None = None) -> DataFrame:
    """A CSV with header, quotes doubled as usual, line ends allowed in quotes. With a schema, columns are as declared,
    by default all strings; names are stripped. Damaged rows give nulls."""
    reader = spark.read.options(header=True, escape='"', multiLine=True, mode="PERMISSIVE")
    df = reader.schema(schema).csv(path) if schema is not None else reader.csv(path, inferSchema=False)
    return df.toDF(*[c.strip() for c in df.columns])


def read_csv_checked(spark: SparkSession, path: str, schema: T.StructType, required: Sequence[str] = (), header: bool = True) -> DataFrame:
    """The columns of the schema, and raw and reasons: why a row should be rejected, an empty array for a sound one.

    'columns': the row has more or fewer fields than the schema, raw being its text; 'name: type': the field of that name isn't
    empty and can't be read as the type, and is null; 'name: missing': a required field is empty. A row with 'columns'
    has no other reason, as its fields can't be told apart. Rows are read once, and none is left out.
    """
    strings_ = T.StructType([T.StructField(f.name, T.StringType()) for f in schema] + [T.StructField("raw", T.StringType())])
    read = spark.read.options(header=header, escape='"', multiLine=True, mode="PERMISSIVE", columnNameOfCorruptRecord="raw", enforceSchema=True).schema(strings_).csv(path)
    value = {f.name: F.col(f"`{f.name}`").try_cast(f.dataType) for f in schema}
    fields = [F.when(F.col(f"`{f.name}`").isNotNull() & value[f.name].isNull(), F.lit(f"{f.name}: {f.dataType.simpleString()}")) for f in schema]
    fields += [F.when(F.col(f"`{c}`").isNull(), F.lit(f"{c}: missing")) for c in required]
    reasons = F.when(F.col("raw").isNotNull(), F.array(F.lit("columns"))).otherwise(F.array_compact(F.array(*fields)))
    return read.select(*[v.alias(c) for c, v in value.items()], "raw", reasons.alias("reasons"))


def read_csv_inferred(spark: SparkSession, path: str) -> DataFrame:
    """A CSV with header whose column types Spark infers; '007' becomes 7. For parity alone: prefer read_csv."""
    return spark.read.options(header=True, escape='"', multiLine=True, inferSchema=True).csv(path)


def read_wiki_pages(spark: SparkSession, path: str) -> DataFrame:
    """(page): the raw text of each page of a dump, entities not decoded, from the last <page> before </page> up to it.

    Records end at </page>, so pages are framed by the reader: a page lies whole in one row wherever files are split,
    also in a split bz2, and a page on one line is a page. What follows the last page is left out.
    """
    raw = spark.read.text(path, lineSep="</page>")
    return raw.where(F.col("value").contains("<page>")).select(F.regexp_extract("value", r"(?s)^.*(<page>.*)$", 1).alias("page"))


def numbered(df: DataFrame, order: list[str], start: int = 1, name: str = "doc_id") -> DataFrame:
    """Adds a row number in the order of the whole table. Rows are range-sorted and counted by partition; only the
    counts are summed in one place, in a table with a row for each partition."""
    return global_index(df, [F.col(c) for c in order], name, start)
