"""Inverted index as long tables: one row for each document and term."""

from __future__ import annotations

import math
from collections.abc import Sequence
from dataclasses import dataclass, replace

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from fernglass.functions.storage import exists, keys_are_shared, written
from fernglass.functions.text import counted, join_full, tokenize
from fernglass.functions.weights import STANDARD, idf_probabilistic, idf_standard, log_tf
from fernglass.sources.readers import PLAYER
from fernglass.sources.writers import write_json, write_table

from .topk import blocks


@dataclass(frozen=True)
class Index:
    """docs(doc_id, ...), tf(doc_id, term, tf), df(term, df), weights(doc_id, term, tf, df, w_standard, w_probabilistic),
    norms(doc_id, n_standard, n_probabilistic), size(n): one row, the number of documents. What searches for the best alone
    use, and an index may lack: blocks(doc_id, block)."""

    docs: DataFrame
    tf: DataFrame
    df: DataFrame
    weights: DataFrame
    norms: DataFrame
    size: DataFrame
    blocks: DataFrame | None = None

    TABLES = ("docs", "tf", "df", "weights", "norms", "size")

    def save(self, path: str, mode: str = "overwrite") -> None:
        """Parquet tables, those with terms sorted by term, so that a search reads few row groups. tf and the weights are one
        table, postings(doc_id, term, tf, df): weights are made when they are read."""
        tables = {"docs": self.docs, "postings": self.weights.select("doc_id", "term", "tf", "df"), "df": self.df, "norms": self.norms, "size": self.size}
        for name, table in tables.items():
            write_table(table, f"{path}/{name}", ("term",) if name in ("postings", "df") else (), mode)

    @classmethod
    def load(cls, spark: SparkSession, path: str) -> Index:
        """A missing table raises, but blocks, which an index may lack."""
        docs, postings, df, norms, size = (spark.read.parquet(f"{path}/{name}") for name in ("docs", "postings", "df", "norms", "size"))
        placed = spark.read.parquet(f"{path}/blocks") if exists(spark, f"{path}/blocks") else None
        return cls(docs, postings.select("doc_id", "term", "tf"), df, weighed(postings, size), norms, size, placed)

    def of_terms(self, terms: Sequence[str]) -> Index:
        """The index as a search for the terms sees it: the rows of others aren't read. Documents, norms and the size stay."""
        few = lambda df: df.where(F.col("term").isin(list(terms)))
        return replace(self, tf=few(self.tf), df=few(self.df), weights=few(self.weights))

    def export_json(self, path: str, mode: str = "overwrite") -> None:
        """The index as folders of JSON lines, gzipped, for other programs: a line for each document or term. Lists grow with their
        term or document; posting_blocks() gives lists of bounded length. Rows are dealt as they are, before lists are begun: by term
        once, and by document once, for tf and the weights, which are made where they are written."""
        parts = task_parts(self.df)
        held, free = written(document_terms(self.weights, parts), "zstd")
        pairs = lambda value: F.map_from_arrays(F.col("terms.term"), value)
        weight = lambda idf: pairs(F.transform("terms", lambda t: log_tf(t["tf"]) * idf(t["df"], F.col("n"))))
        tables = {
            "postings": postings(self.tf, parts), "df": self.df, "vocabulary": vocabulary(self.df), "norms": self.norms, "meta": self.docs,
            "tf": held.select("doc_id", pairs(F.col("terms.tf")).alias("tf")),
            "weights": held.crossJoin(F.broadcast(self.size)).select("doc_id", weight(idf_standard).alias("standard"), weight(idf_probabilistic).alias("probabilistic")),
        }
        for name, table in tables.items():
            write_json(table, f"{path}/{name}", mode, "gzip")
        free()


def import_json(spark: SparkSession, path: str, meta: str | None = None) -> Index:
    """The index that export_json() wrote. meta: columns and types of the documents' table as DDL, read from the files where
    it isn't given. Weights and norms are read, not made again; the size is the number of documents."""
    docs = (spark.read.schema(meta) if meta else spark.read).json(f"{path}/meta")
    key = docs.schema["doc_id"].dataType.simpleString()
    read = lambda name, schema: spark.read.schema(schema).json(f"{path}/{name}")
    df = read("df", "term string, df bigint")
    tf = read("tf", f"doc_id {key}, tf map<string, bigint>").select("doc_id", F.explode("tf").alias("term", "tf"))
    both = read("weights", f"doc_id {key}, standard map<string, double>, probabilistic map<string, double>")
    pairs = both.select("doc_id", "probabilistic", F.explode("standard").alias("term", "w_standard"))
    weights = pairs.select("doc_id", "term", "w_standard", F.element_at("probabilistic", F.col("term")).alias("w_probabilistic"))
    weights = weights.join(tf, ["doc_id", "term"]).join(df, "term").select("doc_id", "term", "tf", "df", "w_standard", "w_probabilistic")
    norms = read("norms", f"doc_id {key}, n_standard double, n_probabilistic double")
    return Index(docs, tf, df, weights, norms, docs.agg(F.count("*").alias("n")))


def player_documents(players: DataFrame, key: str = "doc_id") -> DataFrame:
    """(doc_id, text, meta) of player records: the fields that aren't empty, joined ('N/A' counts), and the whole record
    beside its main fields. Corrupt records should be out already; their numbers stay unused."""
    meta = F.struct(
        F.col("Player").alias("name"), F.col("Position").alias("position"), F.col("CurrentTeam").alias("team"), F.col("DraftYear").alias("draft_year"),
        F.create_map(*[x for c in PLAYER for x in (F.lit(c), F.col(c))]).alias("all_data"),
    )
    return players.select(F.col(key).alias("doc_id"), join_full(*[F.col(c) for c in PLAYER]).alias("text"), meta.alias("meta"))


def term_frequencies(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """(doc_id, term, tf). A document without tokens, or without a key, has no rows. Counted row by row, without a shuffle,
    unless keys are shared; whether they are is found at once, from the keys alone."""
    docs = docs.where(F.col(key).isNotNull())
    rows = docs.select(F.col(key).alias("doc_id"), F.inline(counted(tokenize(F.col(text)))))
    return rows.groupBy("doc_id", "term").agg(F.sum("tf").alias("tf")) if keys_are_shared(docs, key) else rows


def document_frequencies(tf: DataFrame) -> DataFrame:
    """(term, df), from tf, where each document and term is one row. It reads the column tf, so that a plan that needs tf
    as well shuffles it once for both."""
    return tf.groupBy("term").agg(F.sum((F.col("tf") > 0).cast("bigint")).alias("df"))


def postings(tf: DataFrame, parts: int | None = None) -> DataFrame:
    """(term, doc_ids): ids in rising order. For export: a frequent term's list is one value; searches use tf. parts: rows are
    dealt to so many tasks first (see task_parts), so that what one of them sorts doesn't grow with tf."""
    rows = dealt(tf.select("term", "doc_id"), parts, "term") if parts else tf
    return rows.groupBy("term").agg(F.array_sort(F.collect_list("doc_id")).alias("doc_ids"))


def document_terms(weights: DataFrame, parts: int) -> DataFrame:
    """(doc_id, terms(df, tf, term)) in that order, so that terms of equal weights are neighbours; rows are dealt by document first."""
    rows = dealt(weights.select("doc_id", "df", "tf", "term"), parts, "doc_id")
    return rows.groupBy("doc_id").agg(F.sort_array(F.collect_list(F.struct("df", "tf", "term"))).alias("terms"))


#: Bytes of text for each task that gathers postings; they make a million and a half rows, about.
TASK_BYTES = 16 << 20


def text_parts(docs: DataFrame, text: str = "text") -> int:
    """How many tasks should gather the postings of the documents, from the lengths of their texts alone."""
    return max(1, math.ceil((docs.agg(F.sum(F.octet_length(F.col(text)))).first()[0] or 0) / TASK_BYTES))


def posting_blocks(tf: DataFrame, block: int = 1_000_000, parts: int | None = None) -> DataFrame:
    """(term, block, doc_ids): the same in blocks of so many ids, none longer than that, however frequent the term. Rows are
    dealt as they are: lists that are begun before the shuffle have few ids each, and are sorted there, with all rows of a file's
    part at once. parts: how many tasks gather them (see text_parts), so that what one of them sorts doesn't grow with tf."""
    rows, keys = tf.select("term", F.floor(F.col("doc_id") / block).alias("block"), "doc_id"), ("term", "block")
    dealt = rows.repartition(parts, *keys) if parts else rows.repartition(*keys)
    return dealt.groupBy(*keys).agg(F.array_sort(F.collect_list("doc_id")).alias("doc_ids"))


def vocabulary(df: DataFrame) -> DataFrame:
    """The terms in code-point order."""
    return df.select("term").orderBy("term")


def weighed(postings: DataFrame, size: DataFrame) -> DataFrame:
    """postings(doc_id, term, tf, df) with both TF-IDF weights. The number of documents comes as a one-row table, so the plan
    stays lazy."""
    w = log_tf(F.col("tf"))
    return postings.crossJoin(F.broadcast(size)).select(
        "doc_id", "term", "tf", "df", (w * idf_standard(F.col("df"), F.col("n"))).alias("w_standard"), (w * idf_probabilistic(F.col("df"), F.col("n"))).alias("w_probabilistic")
    )


def term_weights(tf: DataFrame, df: DataFrame, size: DataFrame) -> DataFrame:
    """tf joined with df, and both TF-IDF weights."""
    return weighed(tf.join(df, "term"), size)


#: Terms at most that go to all tasks. They are far fewer in texts: of check_l's 1.8 million terms 73 thousand.
FREQUENT = 1_000_000


def with_frequencies(tf: DataFrame, df: DataFrame, most: int = FREQUENT, joined: DataFrame | None = None) -> DataFrame:
    """(doc_id, term, tf, df) by two joins. Terms with more than one of so many parts of all rows are that many at most, so
    their df goes to all tasks, and their rows, which are most rows, stay where they are; those of the others are shuffled.
    joined: the result as it is saved already, from which the others are read instead."""
    rows = df.agg(F.sum("df")).first()[0] or 0
    often = F.broadcast(df.where(F.col("df") > rows / most))
    seldom = tf.join(often, "term", "left_anti").join(df, "term") if joined is None else joined
    return tf.join(often, "term").unionByName(seldom.where(F.col("df") <= rows / most).select(*tf.columns, "df")).select("doc_id", "term", "tf", "df")


#: Rows of postings in a task, about: what it sorts stays in memory.
TASK_ROWS = 2_000_000
#: Up to so many parts Spark deals rows straight into files; for more, a task holds all rows that it deals, and spills. So there
#: are no more until tasks would have more rows than this.
PARTS, MOST_ROWS = 200, 5_000_000


def task_parts(df: DataFrame, task_rows: int = TASK_ROWS) -> int:
    """How many tasks should gather the postings that df counts."""
    rows = df.agg(F.sum("df")).first()[0] or 0
    return max(1, min(PARTS, math.ceil(rows / task_rows)), math.ceil(rows / max(task_rows, MOST_ROWS)))


def dealt(rows: DataFrame, parts: int, *keys: str) -> DataFrame:
    """The rows dealt by keys, in so many parts; where the cores suffice, adaptive execution chooses how many."""
    few = parts <= rows.sparkSession.sparkContext.defaultParallelism
    return rows.repartition(*keys) if few else rows.repartition(parts, *keys)


def dealt_postings(tf: DataFrame, df: DataFrame, task_rows: int = TASK_ROWS) -> DataFrame:
    """(doc_id, term, tf, df), dealt and sorted by term, by one shuffle of tf: df is dealt likewise and joined there. The number of
    tasks grows with the rows; where the cores suffice, adaptive execution chooses it. A term of more than a quarter of a task's rows is dealt in pieces, by document."""
    parts = task_parts(df, task_rows)
    pieces = F.ceil(F.col("df") * 4 / task_rows).cast("int")
    hot = F.broadcast(df.select("term", pieces.alias("_pieces")).where("_pieces > 1"))  # four for each task at most
    rows = tf.join(hot, "term", "left").select(*tf.columns, F.coalesce(F.pmod(F.xxhash64("doc_id"), F.col("_pieces")), F.lit(0)).cast("int").alias("_piece"))
    all_pieces = df.select("term", "df", F.explode(F.sequence(F.lit(0), F.greatest(pieces, F.lit(1)) - 1)).alias("_piece"))
    keys = ["term", "_piece"]
    joined = dealt(rows, parts, *keys).join(dealt(all_pieces, parts, *keys).hint("shuffle_hash"), keys).select("doc_id", "term", "tf", "df")
    return joined.sortWithinPartitions("term")


def vector_norms(weights: DataFrame) -> DataFrame:
    """(doc_id, n_standard, n_probabilistic): lengths of the weight vectors, 0 where all weights are."""
    length = lambda c: F.sqrt(F.sum(F.col(c) * F.col(c)))
    return weights.groupBy("doc_id").agg(length("w_standard").alias("n_standard"), length("w_probabilistic").alias("n_probabilistic"))


def build(docs: DataFrame, key: str = "doc_id", text: str = "text", keep: list[Column] | None = None) -> Index:
    """The index of the documents. keep: columns of docs that results show. tf is used by three tables; save() and load()
    an index that is searched more than once."""
    tf = term_frequencies(docs, key, text)
    df = document_frequencies(tf)
    size = docs.agg(F.count("*").alias("n"))
    weights = term_weights(tf, df, size)
    return Index(docs.select(F.col(key).alias("doc_id"), *(keep or [])), tf, df, weights, vector_norms(weights), size)


def build_saved(docs: DataFrame, path: str, key: str = "doc_id", text: str = "text", keep: list[Column] | None = None, mode: str = "overwrite", by_block: bool = False) -> Index:
    """Builds the index in the folder, table by table, each from those that are saved already, and loads it. Documents are
    tokenised once, into rows that lie by document for a while: the postings are made from these by one shuffle, and norms
    where they lie, but for seldom terms, which are read from the postings.
    by_block: with blocks, by which searches for the best documents leave most others out (see topk)."""
    spark = docs.sparkSession

    def saved(name: str, df: DataFrame, *sort: str) -> DataFrame:
        write_table(df, f"{path}/{name}", sort, mode, compression="zstd")
        return spark.read.parquet(f"{path}/{name}")

    saved("docs", docs.select(F.col(key).alias("doc_id"), *(keep or [])))
    size = saved("size", docs.agg(F.count("*").alias("n")))
    tf, free = written(term_frequencies(docs, key, text), "zstd")
    df = saved("df", document_frequencies(tf).sortWithinPartitions("term"))
    joined = saved("postings", dealt_postings(tf, df))
    norms = saved("norms", vector_norms(weighed(with_frequencies(tf, df, joined=joined), size)))
    free()
    if by_block:
        saved("blocks", blocks(norms, F.col(f"n_{STANDARD}")))
    return Index.load(spark, path)
