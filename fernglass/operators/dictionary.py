"""The terms of an index by pattern: k-grams for wildcards, deletions for misspellings.

Both tables grow with the vocabulary, not with the documents. A pattern's candidates are read from them by equality, so few
row groups of a sorted table are touched, and are then tested exactly.
"""

from __future__ import annotations

import re
from dataclasses import dataclass
from functools import reduce
from itertools import combinations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Characters of a gram; deletions at most, and of how many first characters.
GRAM, DELETED, HEAD = 3, 2, 8


def grams(terms: DataFrame) -> DataFrame:
    """(gram, term): the grams of each term between ^ and $, each once."""
    marked = F.concat(F.lit("^"), "term", F.lit("$"))
    spots = F.sequence(F.lit(1), F.greatest(F.length("term") + 2 - (GRAM - 1), F.lit(1)))
    return terms.select("term", F.explode(F.array_distinct(F.transform(spots, lambda i: F.substring(marked, i, F.lit(GRAM))))).alias("gram")).select("gram", "term")


def _shorter(word: Column) -> Column:
    """The word without one of its characters, in all ways."""
    spots = F.sequence(F.lit(1), F.greatest(F.length(word), F.lit(1)))
    return F.transform(spots, lambda i: F.concat(F.substring(word, F.lit(1), i - 1), F.substring(word, i + 1, F.length(word))))


def deletions(terms: DataFrame) -> DataFrame:
    """(variant, term): the first HEAD characters of each term without up to DELETED of them, 37 at most. Two terms so many edits
    apart share a variant."""
    one = terms.select("term", F.substring("term", 1, HEAD).alias("_h")).select("term", "_h", _shorter(F.col("_h")).alias("_one"))
    two = F.flatten(F.transform("_one", _shorter))
    return one.select("term", F.explode(F.array_distinct(F.concat(F.array("_h"), "_one", two))).alias("variant")).select("variant", "term")


def literal_grams(wildcard: str) -> list[str]:
    """The grams that each term has that a pattern of * and ? fits."""
    found = {run[i : i + GRAM] for run in re.split(r"[*?]", f"^{wildcard}$") for i in range(len(run) - GRAM + 1)}
    return sorted(found)


def variants(word: str) -> list[str]:
    head = word[:HEAD]
    return sorted({"".join(c for i, c in enumerate(head) if i not in gone) for n in range(DELETED + 1) for gone in combinations(range(len(head)), n)})


def _swapped(words: set[str]) -> set[str]:
    """The words with two neighbouring characters the other way round."""
    return {w[:i] + w[i + 1] + w[i] + w[i + 2 :] for w in words for i in range(len(w) - 1)}


def within(term: Column, value: str, edits: int) -> Column:
    """Whether so many edits make one of the other; two neighbours the other way round are one edit."""
    tests, words = [], {value}
    for done in range(edits + 1):
        if done < edits:
            tests += [F.levenshtein(term, F.lit(w), edits - done) >= 0 for w in sorted(words)]
        else:
            tests.append(term.isin(sorted(words)))
        words = _swapped(words)
    near = reduce(lambda a, b: a | b, tests)
    # lengths alone rule most terms out
    return (F.abs(F.length(term) - len(value)) <= edits) & near


def edits_between(term: Column, value: str, most: int) -> Column:
    """The edits from one to the other, null beyond so many."""
    return reduce(lambda rest, e: F.when(within(term, value, e), e).otherwise(rest), range(most, -1, -1), F.lit(None).cast("int"))


@dataclass(frozen=True)
class Dictionary:
    """grams(gram, term) and deletions(variant, term) of an index's terms, of all fields together."""

    grams: DataFrame
    deletions: DataFrame

    def fitting(self, wildcard: str) -> DataFrame | None:
        """(term) of the candidates of a wildcard pattern; None if it has no gram of its own."""
        own = literal_grams(wildcard)
        if not own:
            return None
        return self.grams.where(F.col("gram").isin(own)).groupBy("term").agg(F.count("*").alias("_n")).where(F.col("_n") == len(own)).select("term")

    def near(self, value: str) -> DataFrame:
        """(term) of the candidates of a misspelling."""
        return self.deletions.where(F.col("variant").isin(variants(value))).select("term").distinct()


def make(df: DataFrame) -> Dictionary:
    """The dictionary of a table of terms."""
    terms = df.select("term").distinct()
    return Dictionary(grams(terms), deletions(terms))
