"""Boolean retrieval: a parser for the query language, compiled to one Column or to set operations."""

from __future__ import annotations

import re
from typing import NamedTuple

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from fernglass.functions.text import TOKEN, tokenize

AND, OR, NOT = "AND", "OR", "NOT"
_LEXEME = re.compile(r'"(?P<quoted>[^"]*)"|\b(?P<op>AND|OR|NOT)\b|(?P<word>\S+)', re.IGNORECASE)


class Clause(NamedTuple):
    op: str
    term: str


def is_boolean(query: str) -> bool:
    """Whether a word of the query is an operator, in any case."""
    return any(w.upper() in (AND, OR, NOT) for w in query.split())


def parse(query: str) -> list[Clause]:
    """The query's clauses, to be applied from left to right.

    Clauses are joined by AND unless an operator stands before them; of several, the last counts. A clause is the first
    token of a word or quoted phrase, or, without tokens, the text itself in lower case. Blank quotes are passed over
    and leave the operator standing. There are no brackets; an operator at the end is ignored.
    """
    clauses: list[Clause] = []
    pending = AND
    for m in _LEXEME.finditer(query):
        if m["op"]:
            pending = m["op"].upper()
            continue
        raw = (m["quoted"] if m["quoted"] is not None else m["word"]).strip()
        if not raw:
            continue
        found = re.search(TOKEN, raw.lower())
        clauses.append(Clause(pending, found[0] if found else raw.lower()))
        pending = AND
    return clauses


def condition(clauses: list[Clause], holds) -> Column:  # noqa: ANN001
    """One Column for all clauses; holds(term) says whether a row holds the term. The first clause starts the result
    whatever its operator, but NOT makes it the complement."""
    out = None
    for op, term in clauses:
        now = ~holds(term) if op == NOT else holds(term)
        out = now if out is None else (out | now if op == OR else out & now)
    return out if out is not None else F.lit(False)


def search(docs: DataFrame, query: str, key: str = "doc_id", text: str = "text") -> DataFrame:
    """(doc_id) of the documents that the query fits, in order. One scan without a shuffle but for the order; NOT needs
    no table of all documents. An empty query fits none."""
    clauses = parse(query)
    tokens = docs.select(F.col(key).alias("doc_id"), tokenize(F.col(text)).alias("_t"))
    return tokens.where(condition(clauses, lambda t: F.array_contains("_t", t))).select("doc_id").orderBy("doc_id")


def search_postings(tf: DataFrame, docs: DataFrame, query: str) -> DataFrame:
    """The same from the index: the query's terms alone are read, a flag for each is set by document, and all documents
    are joined only if the query can hold for one without any of its terms."""
    clauses = parse(query)
    terms = sorted({c.term for c in clauses})
    if not terms:
        return docs.select("doc_id").where(F.lit(False))
    flags = {t: f"_f{i}" for i, t in enumerate(terms)}
    hits = tf.where(F.col("term").isin(terms)).groupBy("doc_id").agg(*[F.max(F.col("term") == t).alias(c) for t, c in flags.items()])
    if _holds_for_none(clauses):
        hits = docs.select("doc_id").join(hits, "doc_id", "left")
    return hits.where(condition(clauses, lambda t: F.coalesce(F.col(flags[t]), F.lit(False)))).select("doc_id").orderBy("doc_id")


def _holds_for_none(clauses: list[Clause]) -> bool:
    out = None
    for op, _ in clauses:
        now = op == NOT
        out = now if out is None else (out or now if op == OR else out and now)
    return bool(out)


def search_sets(tf: DataFrame, docs: DataFrame, query: str) -> DataFrame:
    """The same as set operations on lists of documents: intersect, union, anti-join."""
    everything = docs.select("doc_id").distinct()
    out = None
    for op, term in parse(query):
        holders = tf.where(F.col("term") == term).select("doc_id")
        now = everything.join(holders, "doc_id", "left_anti") if op == NOT else holders
        out = now if out is None else (out.union(now).distinct() if op == OR else out.intersect(now))
    return (everything.where(F.lit(False)) if out is None else out).orderBy("doc_id")
