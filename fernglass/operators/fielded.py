"""Multi-field search: typed fields, a query language, BM25 with field boosts.

A query becomes a small tree. Its leaves are looked up in one scan of the postings, joined with field statistics, and
gathered by document and field; the tree above them is Column arithmetic on that row. So a query is one scan, one
aggregation by document and field, one by document, and a top-k, however many fields and operators it has.
"""

from __future__ import annotations

import re
from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from fernglass.functions.storage import exists, kept_table, keys_are_shared, spread, written
from fernglass.functions.text import digits, first_full, join_full, located, standard_tokens, words_of
from fernglass.functions.weights import bm25_idf, bm25_tf
from fernglass.sources.writers import write_table

from . import dictionary
from .dictionary import Dictionary
from .display import stored_fields

# --- fixed values: fields, types, boosts ----------------------------------------------------------------------------
TEXT_FIELDS = (
    "player", "info", "position", "borncity", "bornstate", "birthplace_other", "currentteam", "draftteam", "college", "highschool", "name", "nfl_player_name",
)
STRING_FIELDS = ("bornyear", "draftyear", "diedyear", "height", "weight", "draft_round", "doc_id", "indexed_at", "birth_year")
SEARCH_FIELDS = {
    "full_name_search": 10.0, "position_search": 8.0, "college_search": 1.0, "location_search": 1.0, "player": 9.0, "position": 7.0, "college": 1.0,
    "currentteam": 7.0, "draftteam": 2.5, "highschool": 1.0, "info": 0.1, "borncity": 1.5, "bornstate": 1.5, "birthplace_other": 1.5,
}
NAME_COLUMNS = ("player", "name", "player_name", "nfl_player_name")
# --------------------------------------------------------------------------------------------------------------------


#: Columns of saved documents: how often the index had been appended to, and whether the row says that a document is gone.
GENERATION, GONE = "_generation", "_gone"


@dataclass(frozen=True)
class FieldIndex:
    """docs(doc_id, stored fields), postings(field, term, doc_id, tf, positions, len), stats(field, n, total_len),
    df(field, term, df): how many documents have the field, how many terms it has in all, how many documents have the
    term. Both are sums, so those of appended parts add up."""

    docs: DataFrame
    postings: DataFrame
    stats: DataFrame
    df: DataFrame

    dictionary: Dictionary | None = None
    #: The same postings where they are made row by row: cheaper for all of them, where the others are for a search.
    by_row: DataFrame | None = None

    TABLES = ("docs", "postings", "stats", "df")

    def save(self, path: str, mode: str = "overwrite") -> None:
        """mode 'append' adds a generation of documents to those that are there, 'overwrite' replaces them. The dictionary, from
        which patterns are looked up, is that of the terms of this part."""
        spark = self.docs.sparkSession
        old = mode == "append" and exists(spark, f"{path}/docs")
        last = spark.read.parquet(f"{path}/docs").agg(F.max(GENERATION)).first()[0] if old else None
        number = F.lit(0 if last is None else last + 1).cast("int")
        postings = self.postings if self.by_row is None else self.by_row
        write_table(postings.withColumn(GENERATION, number), f"{path}/postings", ("term",), mode)
        # all else from what is saved: documents are read once
        own = spark.read.parquet(f"{path}/postings").where(F.col(GENERATION) == number)
        write_table(own.groupBy("field", "term").agg(F.count("*").alias("df")), f"{path}/df", ("term",), mode)
        write_table(_sums(own), f"{path}/stats", (), mode)
        terms, free = written(own.select("field", "term").distinct())
        words = dictionary.make(terms)
        write_table(words.grams, f"{path}/grams", ("gram", "term"), mode)
        write_table(words.deletions, f"{path}/deletions", ("variant", "term"), mode)
        free()
        # documents come last: until then nothing knows of the generation
        write_table(self.docs.withColumns({GENERATION: number, GONE: F.lit(False)}), f"{path}/docs", (), mode)

    @classmethod
    def load(cls, spark: SparkSession, path: str, newest: bool = False) -> FieldIndex:
        """The index over all parts that were saved there; a missing table raises. A document that was appended again counts
        again, unless newest: then its last generation alone is found, and documents that were deleted aren't.

        Postings of older generations are left out by an anti join with the documents that have them, and what those count for
        in the statistics is taken off their sums; so a search reads what it would without them, and them.
        """
        docs, postings, stats, df = (spark.read.parquet(f"{path}/{name}") for name in cls.TABLES)
        stats = stats.groupBy("field").agg(F.sum("n").alias("n"), F.sum("total_len").alias("total_len"))
        df = df.groupBy("field", "term").agg(F.sum("df").alias("df"))
        if newest:
            last = docs.groupBy(F.col("doc_id").alias("_id")).agg(F.max(GENERATION).alias("_last"), F.max_by(GONE, GENERATION).alias("_off"))
            marked = docs.join(last, F.col("doc_id") == F.col("_id"))
            is_stale = (F.col(GENERATION) < F.col("_last")) | F.col("_off")
            stale = marked.where(is_stale).select("doc_id", GENERATION).distinct()
            docs = marked.where(~is_stale).drop("_id", "_last", "_off")
            stale = stale.hint("shuffle_hash")
            off = postings.join(stale, ["doc_id", GENERATION], "left_semi")
            postings = postings.join(stale, ["doc_id", GENERATION], "left_anti")
            less = off.groupBy("field", "term").agg(F.count("*").alias("_less"))
            df = df.join(less, ["field", "term"], "left").select("field", "term", (F.col("df") - F.coalesce("_less", F.lit(0))).alias("df")).where("df > 0")
            fields = _sums(off).select("field", F.col("n").alias("_n"), F.col("total_len").alias("_len"))
            stats = stats.join(fields, "field", "left").select("field", (F.col("n") - F.coalesce("_n", F.lit(0))).alias("n"), (F.col("total_len") - F.coalesce("_len", F.lit(0))).alias("total_len")).where("n > 0")
        # a term of two parts is in both dictionaries
        words = Dictionary(*[spark.read.parquet(f"{path}/{name}").distinct() for name in ("grams", "deletions")])
        return cls(docs.where(f"not {GONE}").drop(GENERATION, GONE), postings.drop(GENERATION), stats, df, words)

    @staticmethod
    def delete(ids: DataFrame, path: str) -> None:
        """From now on load(newest=True) leaves out the documents of the ids (doc_id), in whatever generation they are; one
        that is appended later is there again."""
        spark = ids.sparkSession
        docs = spark.read.parquet(f"{path}/docs")
        last = docs.agg(F.max(GENERATION)).first()[0]
        gone = ids.select(F.col("doc_id").cast(docs.schema["doc_id"].dataType)).distinct().withColumns({GENERATION: F.lit(last + 1).cast("int"), GONE: F.lit(True)})
        gone = docs.limit(0).unionByName(gone, allowMissingColumns=True)
        gone.write.mode("append").parquet(f"{path}/docs")

    @classmethod
    def compact(cls, spark: SparkSession, path: str, to: str) -> FieldIndex:
        """The newest documents of an index as one generation in another folder."""
        cls.load(spark, path, newest=True).save(to)
        return cls.load(spark, to)

    def statistics(self) -> DataFrame:
        """(field, n, mean_len)."""
        return self.stats.select("field", "n", (F.col("total_len") / F.col("n")).alias("mean_len"))


def _sums(postings: DataFrame) -> DataFrame:
    """(field, n, total_len) of postings. One term of each document and field stands at its beginning, so nothing is gathered
    by document."""
    return postings.groupBy("field").agg(F.sum(F.size(F.filter("positions", lambda at: at == 0))).alias("n"), F.sum("tf").alias("total_len"))


def derived_fields(records: DataFrame) -> DataFrame:
    """Records with columns in lower case, nulls as empty text, and the derived search fields, null where they are
    absent. weight is digits alone; weight_text and height_text repeat the two as text."""
    low = records.toDF(*[c.lower() for c in records.columns])
    low = low.select(*[F.col(c) if c == "doc_id" else F.coalesce(F.col(c).cast("string"), F.lit("")).alias(c) for c in low.columns])
    have = set(low.columns)
    get = lambda c: F.col(c) if c in have else F.lit(None).cast("string")
    new = {
        "full_name_search": first_full(*[get(c) for c in NAME_COLUMNS]), "position_search": first_full(get("position")), "college_search": first_full(get("college")),
        "location_search": F.nullif(join_full(get("borncity"), get("bornstate"), get("birthplace_other")), F.lit("")),
    }
    if "weight" in have:
        low = low.withColumn("weight", digits(F.col("weight")))
        new["weight_text"] = F.col("weight")
    if "height" in have:
        new["height_text"] = F.col("height")
    return low.withColumns(new)


def build(docs: DataFrame, text_fields: list[str], string_fields: list[str] | None = None, key: str = "doc_id") -> FieldIndex:
    """The index of the documents. Text fields are tokenised and keep positions; string fields are one term each. A field
    counts for its statistics where it has a term: a null or blank text is as good as absent."""
    parts = [F.struct(F.lit(c).alias("field"), standard_tokens(F.col(c)).alias("tokens")) for c in text_fields]
    parts += [F.struct(F.lit(c).alias("field"), F.when(F.col(c).isNotNull(), F.array(F.col(c).cast("string"))).otherwise(F.array().cast("array<string>")).alias("tokens")) for c in string_fields or []]
    wide = spread(docs).select(F.col(key).alias("doc_id"), F.explode(F.array(*parts)).alias("_p")).select("doc_id", "_p.field", "_p.tokens").where(F.size("tokens") > 0)
    wide = kept_table(wide)  # words are looked for once, not for each table
    placed = wide.select("doc_id", "field", F.size("tokens").cast("bigint").alias("len"), F.posexplode("tokens").alias("at", "term"))
    postings = placed.groupBy("field", "term", "doc_id").agg(F.count("*").alias("tf"), F.array_sort(F.collect_list("at")).alias("positions"), F.first("len").alias("len"))
    stats = wide.groupBy("field").agg(F.count("*").alias("n"), F.sum(F.size("tokens")).alias("total_len"))
    length = F.size("tokens").cast("bigint").alias("len")
    by_row = None if keys_are_shared(docs, key) else wide.select("field", "doc_id", length, F.inline(located(F.col("tokens")))).select(*postings.columns)
    return FieldIndex(docs.withColumnRenamed(key, "doc_id"), postings, stats, postings.groupBy("field", "term").agg(F.count("*").alias("df")), by_row=by_row)


# --- the query language ----------------------------------------------------------------------------------------------


@dataclass
class Leaf:
    """What is looked up. kind: term, phrase, prefix, wildcard, fuzzy, regex, range, exact or all."""

    kind: str
    value: str
    field: str | None = None
    boost: float = 1.0
    slop: int = 0
    ends: tuple[str, str] = ("*", "*")
    without_ends: tuple[bool, bool] = (False, False)


@dataclass
class Group:
    """Clauses of a Boolean query: (occur, node), occur being must, should or not."""

    clauses: list[tuple[str, Node]]
    boost: float = 1.0


Node = Leaf | Group

_LEX = re.compile(r"""\s*(?:(?P<op>AND\b|OR\b|NOT\b|&&|\|\||!)|(?P<sign>[+\-])(?=\S)|(?P<open>\()|(?P<close>\))(?:\^(?P<gboost>[0-9.]+))?
    |(?P<all>\*:\*)|(?P<field>\w+):(?=\S)|/(?P<regex>(?:\\.|[^/\\])+)/|"(?P<phrase>[^"]*)"(?:~(?P<slop>\d+))?|(?P<from>[\[{])(?P<low>\S+)\s+TO\s+(?P<high>[^\s\]}]+)(?P<to>[\]}])
    |(?P<word>(?:\\.|[^\s()"\[\]{}^~:\\])+)(?P<fuzzy>~(?P<edits>[012])?)?)(?:\^(?P<boost>[0-9.]+))?""", re.VERBOSE)  # fmt: skip


class QuerySyntaxError(ValueError):
    pass


class _Parser:
    """Terms (joined by OR), AND, OR, NOT, + and -, "phrases"~slop, prefix*, w?ldcards, fuzzy~, /regular expressions/ of whole
    terms, [a TO b], {a TO b} without the ends, *:* for all documents, ^boost, field:, brackets and \\ escapes."""

    def __init__(self, text: str) -> None:
        self.tokens = []
        at, text = 0, text.rstrip()
        while at < len(text):
            m = _LEX.match(text, at)
            if not m or m.end() == at:
                raise QuerySyntaxError(f"can't read {text[at:]!r}")
            self.tokens.append(m)
            at = m.end()
        self.at = 0

    def peek(self) -> re.Match | None:
        return self.tokens[self.at] if self.at < len(self.tokens) else None

    def group(self, inside: bool, default: str | None) -> Group:
        clauses: list[list] = []
        join, occur, own = None, None, default
        while (m := self.peek()) is not None:
            self.at += 1
            if m["close"]:
                if not inside:
                    raise QuerySyntaxError("a bracket closes that isn't open")
                out = Group([tuple(c) for c in clauses], float(m["gboost"] or 1))
                return out
            if m["op"]:
                word = {"&&": "AND", "||": "OR", "!": "NOT"}.get(m["op"], m["op"])
                if word == "NOT":
                    occur = "not"
                else:
                    join = word
                continue
            if m["sign"]:
                occur = "must" if m["sign"] == "+" else "not"
                continue
            if m["field"]:
                own = m["field"]
                continue
            node: Node = self.group(True, own) if m["open"] else self.leaf(m, own)
            if join == "AND" and clauses and clauses[-1][0] == "should":
                clauses[-1][0] = "must"
            clauses.append([occur or ("must" if join == "AND" else "should"), node])
            join, occur, own = None, None, default
        if inside:
            raise QuerySyntaxError("a bracket isn't closed")
        return Group([tuple(c) for c in clauses])

    @staticmethod
    def leaf(m: re.Match, own: str | None) -> Leaf:
        boost = float(m["boost"] or 1)
        if m["all"]:
            return Leaf("all", "", own, boost)
        if m["regex"] is not None:
            try:
                re.compile(m["regex"])
            except re.error as e:
                raise QuerySyntaxError(f"can't read /{m['regex']}/: {e}") from e
            return Leaf("regex", m["regex"].replace("\\/", "/"), own, boost)
        if m["low"]:
            return Leaf("range", m["low"].lower(), own, boost, ends=(m["low"].lower(), m["high"].lower()), without_ends=(m["from"] == "{", m["to"] == "}"))
        if m["phrase"] is not None:
            return Leaf("phrase", m["phrase"], own, boost, int(m["slop"] or 0))
        word = m["word"]
        plain = re.sub(r"\\(.)", r"\1", word)
        if m["fuzzy"]:
            return Leaf("fuzzy", plain.lower(), own, boost, int(m["edits"] or 2))
        if re.search(r"(?<!\\)[*?]", word):
            return Leaf("prefix" if re.fullmatch(r"[^*?]+\*", word) else "wildcard", plain.lower(), own, boost)
        return Leaf("term", plain, own, boost)


def parse(text: str) -> Group:
    """The query's tree. Raises QuerySyntaxError for what the language doesn't know."""
    return _Parser(text).group(False, None)


@dataclass(frozen=True)
class Exact:
    """One side of a query that asks for a height or a weight."""

    field: str
    value: str


def side(text: str) -> Group | Exact:
    """Digits alone ask for a weight; digits and hyphens, with a hyphen, for a height; all else is a text query."""
    text = text.strip()
    if text.isdigit():
        return Exact("weight", text)
    if "-" in text and all(c.isdigit() or c == "-" for c in text):
        return Exact("height", text)
    return parse(text)


def _readable(text: str) -> Group | Exact:
    """The side, or one that fits nothing where it can't be parsed."""
    try:
        return side(text)
    except QuerySyntaxError:
        return Group([])


@dataclass(frozen=True)
class Plan:
    """must, should: sides; without must, one of should has to fit. without: the side that mustn't. times: what a sole
    exact side's score is multiplied by."""

    must: list[Group | Exact]
    should: list[Group | Exact]
    without: list[Group | Exact]
    times: float = 1.0


def plan(query: str, strict_and: bool = False) -> Plan:
    """How a whole query is taken apart.

    ' NOT ', with a space on both sides and in any case, splits the query once; ' AND ' before it splits once more, the
    two sides being alternatives unless strict_and. Without NOT, ' AND ' splits once, and both sides must fit, each in
    any field. Queries that are split are parsed in upper case. All else is one side, looked for in each field; if it
    asks for a weight or height, its score counts once for each search field. A side that can't be parsed fits nothing,
    and the others stand: as an alternative it adds none, as what mustn't be found it takes none away.
    """
    upper = query.upper()
    if " NOT " in upper:
        positive, negative = upper.split(" NOT ", 1)
        if " AND " in positive:
            both = [_readable(p) for p in positive.split(" AND ", 1)]
            return Plan(both if strict_and else [], [] if strict_and else both, [_readable(negative)])
        return Plan([_readable(positive)], [], [_readable(negative)])
    if " AND " in upper:
        return Plan([_readable(p) for p in upper.split(" AND ", 1)], [], [])
    only = _readable(query)
    return Plan([only], [], [], float(len(SEARCH_FIELDS)) if isinstance(only, Exact) else 1.0)


# --- evaluation ------------------------------------------------------------------------------------------------------


def _phrases(spots: list[Column], slop: int) -> Column:
    """How often the terms at the spots stand as a phrase, as a double. A match needs, for each term, a spot that lies
    its place in the phrase after a common start, or up to slop further on; it counts 1 over 1 plus the most by which one
    does. So two terms the wrong way round are a match with slop 2, of weight 1/3."""
    back = lambda p, k: F.transform(p, lambda x: x - k)
    moved = [back(p, k) for k, p in enumerate(spots)]
    starts = moved[0] if slop == 0 else F.array_distinct(F.concat(*moved))

    def least(start: Column) -> Column:
        gaps = [F.array_min(F.filter(F.transform(m, lambda x: x - start), lambda g: g >= 0)) for m in moved]
        # greatest() would pass over a term that has none
        return F.when(reduce(lambda a, b: a & b, [g.isNotNull() for g in gaps]), F.greatest(*gaps))

    gaps = F.filter(F.transform(starts, least), lambda g: g <= slop)
    return F.aggregate(gaps, F.lit(0.0), lambda total, g: total + 1 / (1 + g))


#: Terms of a pattern that are looked up one by one at most; beyond, postings are tested. Best terms of a misspelling, by field.
MOST_TERMS, FUZZY_TERMS = 1024, 50
_PATTERNS = ("prefix", "wildcard", "fuzzy", "regex", "range")


def _fits(leaf: Leaf) -> Column:
    """Whether a term fits a pattern."""
    term = F.col("term")
    if leaf.kind == "prefix":
        return term.startswith(leaf.value[:-1])
    if leaf.kind == "wildcard":
        return term.rlike("(?s)^" + "".join(".*" if c == "*" else "." if c == "?" else re.escape(c) for c in leaf.value) + "$")
    if leaf.kind == "regex":
        return term.rlike(f"(?s)^(?:{leaf.value})$")
    if leaf.kind == "fuzzy":
        return dictionary.within(term, leaf.value, leaf.slop)
    (low, high), (no_low, no_high) = leaf.ends, leaf.without_ends
    above = F.lit(True) if low == "*" else term > low if no_low else term >= low
    return above & (F.lit(True) if high == "*" else term < high if no_high else term <= high)


def _leaves(node: Node | Exact) -> list[Leaf]:
    if isinstance(node, Exact):
        return []
    return [node] if isinstance(node, Leaf) else [x for _, n in node.clauses for x in _leaves(n)]


#: A term that a pattern stands for: field, term, df, and the edits away from it that it is.
Found = tuple[str, str, int, int | None]


def expand(index: FieldIndex, leaves: list[Leaf]) -> list[list[Found] | None]:
    """The terms that each pattern stands for, by one job over the dictionary and the table df, before any posting is read.
    None where there are more than MOST_TERMS: such a pattern is tested on postings. Of a misspelling's terms the
    FUZZY_TERMS nearest of each field count, ties by term; nearness is 1 less the edits over the shorter length."""
    parts = []
    for i, leaf in enumerate(leaves):
        terms, words = index.df.select("field", "term", "df"), None
        if index.dictionary is not None and leaf.kind in ("wildcard", "fuzzy"):
            words = index.dictionary.fitting(leaf.value) if leaf.kind == "wildcard" else index.dictionary.near(leaf.value)
        if words is not None:
            terms = terms.join(words, "term", "left_semi")
        if leaf.field:
            terms = terms.where(F.col("field") == leaf.field)
        edits = dictionary.edits_between(F.col("term"), leaf.value, leaf.slop) if leaf.kind == "fuzzy" else F.lit(None).cast("int")
        found = terms.where(_fits(leaf)).select(F.lit(i).alias("leaf"), "field", "term", "df", edits.alias("edits"))
        if leaf.kind == "fuzzy":
            order = Window.partitionBy("field").orderBy(_nearness(F.col("edits"), F.length("term"), len(leaf.value)).desc(), "term")
            found = found.withColumn("_n", F.row_number().over(order)).where(F.col("_n") <= FUZZY_TERMS).drop("_n")
        else:
            found = found.limit(MOST_TERMS + 1)
        parts.append(found)
    rows = reduce(lambda a, b: a.unionAll(b), parts).collect() if parts else []  # bounded for each pattern
    out: list[list[Found] | None] = [[] for _ in leaves]
    for r in rows:
        out[r.leaf].append((r.field, r.term, r.df, r.edits))
    return [None if leaf.kind != "fuzzy" and len(x) > MOST_TERMS else sorted(x) for leaf, x in zip(leaves, out, strict=True)]


def _nearness(edits, length, own: int):  # noqa: ANN001, ANN202
    """Of a term of the length that is so many edits from a word of length own."""
    return F.when(edits == 0, 1.0).otherwise(1 - edits / F.least(length, F.lit(own)))


class _Lookup:
    """Collects leaves: which postings they need, and what a (document, field) row is aggregated to."""

    def __init__(self, fields: dict[str, float], found: list[tuple[Leaf, list[Found] | None]] | None = None) -> None:
        self.fields, self.needs, self.aggregates = fields, [], []
        self.found = found or []

    def _add(self, test: Column, *aggregates: Column) -> list[Column]:
        self.needs.append(test)
        out = []
        for a in aggregates:
            name = f"_a{len(self.aggregates)}"
            self.aggregates.append(a.alias(name))
            out.append(F.col(name))
        return out

    def leaf(self, leaf: Leaf, own: str | None = None) -> tuple[Column, Column]:
        """(fits, score) on an aggregated row. own: the field it is looked up in, unless it names one; None for the field
        of the row."""
        name = leaf.field or own
        here = F.col("field") == name if name else F.col("field").isin(list(self.fields))
        term = F.col("term")
        if leaf.kind in ("term", "phrase", "exact"):
            terms = [leaf.value] if leaf.kind == "exact" else words_of(leaf.value)
            if not terms:
                return F.lit(False), F.lit(0.0)
            # a word of several tokens is a phrase, unless it holds but one
            if len(terms) == 1:
                test = here & (term == terms[0])
                (score,) = self._add(test, F.max(F.when(test, bm25_idf(F.col("df"), F.col("n")) * bm25_tf(F.col("tf"), F.col("len"), F.col("mean_len")))))
                return score.isNotNull(), F.coalesce(score, F.lit(0.0)) * leaf.boost
            spots, idfs = [], []
            first = here & (term == terms[0])
            length, mean = F.max(F.when(first, F.col("len"))), F.max(F.when(first, F.col("mean_len")))
            for t in terms:
                test = here & (term == t)
                p, i = self._add(test, F.max(F.when(test, F.col("positions"))), F.max(F.when(test, bm25_idf(F.col("df"), F.col("n")))))
                spots.append(p)
                idfs.append(i)
            long_, mean_ = self._add(F.lit(False), length, mean)
            found = F.coalesce(_phrases(spots, leaf.slop), F.lit(0.0))
            fits = F.coalesce(reduce(lambda a, b: a & b, [p.isNotNull() for p in spots]) & (found > 0), F.lit(False))
            return fits, F.when(fits, reduce(lambda a, b: a + b, idfs) * bm25_tf(found, long_, mean_)).otherwise(0.0) * leaf.boost
        if leaf.kind == "all":
            return F.lit(True), F.lit(leaf.boost)
        terms = next(x for known, x in self.found if known is leaf)
        if leaf.kind == "fuzzy":
            return self.misspelt(leaf, here, terms or [])
        # many terms may fit: they count alike
        test = here & (_fits(leaf) if terms is None else term.isin(sorted({t for _, t, _, _ in terms})) if terms else F.lit(False))
        (hit,) = self._add(test, F.max(F.when(test, F.lit(1.0))))
        return hit.isNotNull(), F.coalesce(hit, F.lit(0.0)) * leaf.boost

    def misspelt(self, leaf: Leaf, here: Column, terms: list[Found]) -> tuple[Column, Column]:
        """Each term scores as if it were as frequent as the most frequent of its field, times its nearness; scores add up."""
        if not terms:
            return F.lit(False), F.lit(0.0)
        spot = lambda field, t: F.concat(field, F.lit("\n"), t)
        near, most = {}, {}
        for field, t, df, edits in terms:
            near[f"{field}\n{t}"] = 1.0 if edits == 0 else 1 - edits / min(len(t), len(leaf.value))
            most[field] = max(df, most.get(field, 0))
        literal = lambda d: F.create_map(*[x for k, v in d.items() for x in (F.lit(k), F.lit(v))])
        weight = F.element_at(literal(near), spot(F.col("field"), F.col("term")))
        test = here & F.col("term").isin(sorted({t for _, t, _, _ in terms})) & spot(F.col("field"), F.col("term")).isin(sorted(near))
        each = weight * bm25_idf(F.element_at(literal(most), F.col("field")), F.col("n")) * bm25_tf(F.col("tf"), F.col("len"), F.col("mean_len"))
        (score,) = self._add(test, F.sum(F.when(test, each)))
        return score.isNotNull(), F.coalesce(score, F.lit(0.0)) * leaf.boost

    def node(self, node: Node, own: str | None = None) -> tuple[Column, Column]:
        if isinstance(node, Leaf):
            return self.leaf(node, own)
        parts = [(occur, *self.node(n, own)) for occur, n in node.clauses]
        must, should, without = ([(f, s) for o, f, s in parts if o == kind] for kind in ("must", "should", "not"))
        if not must and not should:
            return F.lit(False), F.lit(0.0)
        fits = reduce(lambda a, b: a & b, [f for f, _ in must]) if must else reduce(lambda a, b: a | b, [f for f, _ in should])
        for f, _ in without:
            fits = fits & ~f
        score = reduce(lambda a, b: a + b, [F.when(f, s).otherwise(0.0) for f, s in must + should])
        return fits, F.when(fits, score).otherwise(0.0) * node.boost

    def side(self, what: Group | Exact, own: str | None = None) -> tuple[Column, Column]:
        return self.leaf(Leaf("exact", what.value, what.field)) if isinstance(what, Exact) else self.node(what, own)


def _names_a_field(node: Group | Exact | Leaf) -> bool:
    if isinstance(node, Group):
        return any(_names_a_field(n) for _, n in node.clauses)
    return isinstance(node, Leaf) and (node.field is not None or node.kind == "all")


def search_all(index: FieldIndex, query: str, fields: dict[str, float] | None = None, strict_and: bool = False) -> DataFrame:
    """(doc_id, score) of every document that the query fits, scores not rounded. fields: search fields and boosts. A
    blank query fits none; of one whose sides can't all be parsed, see plan()."""
    fields = SEARCH_FIELDS if fields is None else fields
    none = index.postings.select("doc_id", F.lit(0.0).alias("score")).where(F.lit(False))
    if not query.strip():
        return none
    whole = plan(query, strict_and)
    parts = [(kind, what) for kind, group in (("must", whole.must), ("should", whole.should), ("not", whole.without)) for what in group]
    leaves = [x for _, what in parts for x in _leaves(what)]
    patterns = [x for x in leaves if x.kind in _PATTERNS]
    lookup = _Lookup(fields, list(zip(patterns, expand(index, patterns), strict=True)))
    # a side is tried in each search field; one that names fields looks at several at once, and needs them in one row
    wide = any(_names_a_field(what) for _, what in parts)
    sides = []
    for kind, what in parts:
        weights = [(None, 1.0)] if isinstance(what, Exact) or not wide else list(fields.items())
        sides.append((kind, what, [(weight, *lookup.side(what, own)) for own, weight in weights]))
    everything = any(x.kind == "all" for x in leaves)
    if not lookup.needs and not everything:
        return none
    needs = reduce(lambda a, b: a | b, lookup.needs, F.lit(False))
    # the same terms alone are read on both sides
    known = index.postings.where(needs).join(index.df.where(needs), ["field", "term"]).join(F.broadcast(index.statistics()), "field")  # a row for each field
    if everything:  # documents without a term that is looked for have a row, too
        known = known.unionByName(index.docs.select("doc_id").distinct(), allowMissingColumns=True)
    if wide:
        rows = known.groupBy("doc_id").agg(*(lookup.aggregates or [F.count("*").alias("_a")]))
        columns = []
        for i, (_, _, tried) in enumerate(sides):
            columns.append(reduce(lambda a, b: a | b, [f for _, f, _ in tried]).alias(f"_f{i}"))
            columns.append(reduce(lambda a, b: a + b, [F.when(f, s * w).otherwise(0.0) for w, f, s in tried]).alias(f"_s{i}"))
        by_doc = rows.select("doc_id", *columns)
    else:
        boost = F.coalesce(F.element_at(F.create_map(*[x for k, v in fields.items() for x in (F.lit(k), F.lit(float(v)))]), F.col("field")), F.lit(1.0))
        rows = known.groupBy("doc_id", "field").agg(*lookup.aggregates)
        columns = []
        for i, (_, what, ((_, fits, score),)) in enumerate(sides):
            weight = F.lit(1.0) if isinstance(what, Exact) else boost
            columns += [F.max(fits).alias(f"_f{i}"), F.sum(F.when(fits, score * weight).otherwise(0.0)).alias(f"_s{i}")]
        by_doc = rows.groupBy("doc_id").agg(*columns)
    fit = {k: [F.col(f"_f{i}") for i, s in enumerate(sides) if s[0] == k] for k in ("must", "should", "not")}
    test = reduce(lambda a, b: a & b, fit["must"]) if fit["must"] else reduce(lambda a, b: a | b, fit["should"], F.lit(False))
    for f in fit["not"]:
        test = test & ~f
    total = reduce(lambda a, b: a + b, [F.col(f"_s{i}") for i, s in enumerate(sides) if s[0] != "not"], F.lit(0.0))
    return by_doc.where(test).select("doc_id", (total * whole.times).alias("score"))


def search(index: FieldIndex, query: str, limit: int = 10, fields: dict[str, float] | None = None, strict_and: bool = False) -> DataFrame:
    """(doc_id, score): the best documents, scores rounded to 4 digits, ties by id."""
    found = search_all(index, query, fields, strict_and).select("doc_id", F.round("score", 4).alias("score"))
    return found.orderBy(F.col("score").desc(), "doc_id").limit(limit)


def search_with_fields(index: FieldIndex, query: str, limit: int = 10, fields: dict[str, float] | None = None, strict_and: bool = False) -> DataFrame:
    """(doc_id, score, stored fields) of the best documents: what a result shows (see display.stored_fields), in order. A
    few ids meet all documents, so Spark broadcasts them."""
    found = search(index, query, limit, fields, strict_and)
    shown = stored_fields(index.docs.join(F.broadcast(found), "doc_id"))  # at most limit rows
    return shown.orderBy(F.col("score").desc(), "doc_id")


def phrase_documents(index: FieldIndex, phrase: str, name: str) -> DataFrame:
    """(doc_id) of the documents whose field holds the phrase."""
    return search_all(index, f'{name}:"{phrase}"', {name: 1.0}).select("doc_id")
