"""The queries of the library by name. Texts that the tables lack are put together from their columns."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import DecimalType, LongType, StringType, StructField, StructType

from fernglass.functions import text as T
from fernglass.functions.storage import scratch
from fernglass.operators import boolean, display, extract_html, extract_wiki, fielded, index, ranked, records
from fernglass.operators import search as entry
from fernglass.sources import readers, writers
from fernglass.streaming import index_stream

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}

RANKED_QUERY = "the of and that idiot"
#: Without an operator, so that the common entry ranks it.
ENTRY_QUERY = "the of that idiot"
BOOLEAN = {
    "boolean_and": "the of",
    "boolean_or": "trash OR clown",
    "boolean_not": "the NOT of",
    "boolean_mixed": "der OR the AND of",
    "boolean_leading_not": "NOT the",
    "boolean_or_not": "the OR NOT of",
    "boolean_quoted": '"the of" OR "" mit',
    "boolean_missing": "missing-term",
    "boolean_trailing": "the OR",
}
PART_FIELDS = {"p_name": 10.0, "p_type": 7.0, "p_brand": 1.0}
PHRASE = "in the"
PLAYER_QUERY = "machinery bigland 7"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def query(f: Query) -> Query:
    QUERIES[f.__name__] = f
    return f


def _tf(spark: SparkSession, d: str) -> DataFrame:
    return index.term_frequencies(table(spark, d, "documents"))


def _index(spark: SparkSession, d: str) -> index.Index:
    return index.build(table(spark, d, "documents"))


_SAVED: dict[tuple[str, str], str] = {}


def _saved_index(spark: SparkSession, d: str) -> index.Index:
    """The index of the documents as it is searched: built and saved once for a session and folder, sorted by term, then
    loaded."""
    at = (spark.sparkContext.applicationId, d)
    if at not in _SAVED:
        path, _ = scratch(spark)
        index.build_saved(table(spark, d, "documents"), path, keep=[F.col("lang"), F.col("source")], by_block=True)
        _SAVED[at] = path
    return index.Index.load(spark, _SAVED[at])


# --- index ----------------------------------------------------------------------------------------------------------


@query
def tokenize(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "documents").select("doc_id", F.size(T.tokenize(F.col("text"))).cast("bigint").alias("n_tokens"))


@query
def standard_words(spark: SparkSession, d: str) -> DataFrame:
    """Words of the full-text analysis: how many, and a digest of them in order."""
    words = table(spark, d, "documents").select("doc_id", T.standard_tokens(F.col("text")).alias("w"))
    return words.select("doc_id", F.size("w").cast("bigint").alias("n_words"), F.md5(F.array_join("w", " ")).alias("words_md5"))


@query
def term_frequency(spark: SparkSession, d: str) -> DataFrame:
    return _tf(spark, d)


@query
def document_frequency(spark: SparkSession, d: str) -> DataFrame:
    return index.document_frequencies(_tf(spark, d)).orderBy("term")


@query
def postings(spark: SparkSession, d: str) -> DataFrame:
    return index.postings(_tf(spark, d)).select("term", F.array_join(F.col("doc_ids").cast("array<string>"), ",").alias("doc_ids"))


@query
def posting_blocks(spark: SparkSession, d: str) -> DataFrame:
    parts = index.text_parts(table(spark, d, "documents"))
    return index.posting_blocks(_tf(spark, d), 100, parts).select("term", "block", F.array_join(F.col("doc_ids").cast("array<string>"), ",").alias("doc_ids"))


@query
def vocabulary(spark: SparkSession, d: str) -> DataFrame:
    return index.vocabulary(index.document_frequencies(_tf(spark, d)))


@query
def collection_size(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "documents").agg(F.count("*").alias("n"))


@query
def idf_both(spark: SparkSession, d: str) -> DataFrame:
    from fernglass.functions.weights import idf_probabilistic, idf_standard

    i = _index(spark, d)
    both = i.df.crossJoin(F.broadcast(i.size))
    return both.select("term", "df", *[F.round(f(F.col("df"), F.col("n")), 6).alias(c) for c, f in (("idf_standard", idf_standard), ("idf_probabilistic", idf_probabilistic))])


@query
def tfidf_weights(spark: SparkSession, d: str) -> DataFrame:
    return _index(spark, d).weights.select("doc_id", "term", *[F.round(c, 6).alias(c) for c in ("w_standard", "w_probabilistic")])


@query
def transpose_weights(spark: SparkSession, d: str) -> DataFrame:
    w = _index(spark, d).weights.select("term", "doc_id", F.round("w_standard", 6).alias("w_standard"))
    return w.repartition("term").sortWithinPartitions("term", "doc_id")


@query
def doc_norms(spark: SparkSession, d: str) -> DataFrame:
    return _index(spark, d).norms.select("doc_id", *[F.round(c, 6).alias(c) for c in ("n_standard", "n_probabilistic")])


@query
def player_documents(spark: SparkSession, d: str) -> DataFrame:
    players = extract_html.extract_players(_player_pages(spark, d), keep=("doc_id",))
    docs = index.player_documents(records.without_corrupt(players))
    return docs.select("doc_id", "text", F.col("meta.name").alias("name"), F.col("meta.team").alias("team"), F.element_at("meta.all_data", F.lit("BornYear")).alias("born"))


# --- ranked ---------------------------------------------------------------------------------------------------------


@query
def ranked_standard(spark: SparkSession, d: str) -> DataFrame:
    return ranked.search(_saved_index(spark, d), RANKED_QUERY, 10, "standard")


@query
def ranked_probabilistic(spark: SparkSession, d: str) -> DataFrame:
    return ranked.search(_saved_index(spark, d), RANKED_QUERY, 10, "probabilistic")


@query
def ranked_batch(spark: SparkSession, d: str) -> DataFrame:
    return ranked.search_batch(table(spark, d, "benchmark"), _saved_index(spark, d), 10, key="item_id", text="text").select("query_id", F.col("rank").cast("bigint").alias("rank"), "doc_id", "score")


@query
def ranked_batch_pruned(spark: SparkSession, d: str) -> DataFrame:
    """The same by blocks, leaving out what can't be among the best."""
    found = ranked.search_batch(table(spark, d, "benchmark"), _saved_index(spark, d), 10, key="item_id", text="text", prune=True)
    return found.select("query_id", F.col("rank").cast("bigint").alias("rank"), "doc_id", "score")


@query
def ranked_empty(spark: SparkSession, d: str) -> DataFrame:
    return ranked.search(_saved_index(spark, d), "?!", 10)


@query
def total_hits(spark: SparkSession, d: str) -> DataFrame:
    return ranked.total_hits(_saved_index(spark, d), RANKED_QUERY)


@query
def search_ranked_mode(spark: SparkSession, d: str) -> DataFrame:
    return entry.search(_saved_index(spark, d), ENTRY_QUERY, 7)


@query
def search_boolean_mode(spark: SparkSession, d: str) -> DataFrame:
    return entry.search(_saved_index(spark, d), BOOLEAN["boolean_or"], 7)


@query
def search_boolean_total(spark: SparkSession, d: str) -> DataFrame:
    return entry.total(_saved_index(spark, d), BOOLEAN["boolean_or"])


@query
def index_build(spark: SparkSession, d: str) -> DataFrame:
    """A new index, saved and loaded: its weights."""
    path, _ = scratch(spark)
    return index.build_saved(table(spark, d, "documents"), path).weights.select("doc_id", "term", "tf", "df", F.round("w_standard", 6).alias("w_standard"))


@query
def index_json(spark: SparkSession, d: str) -> DataFrame:
    """The index in JSON, read again: terms and their documents."""
    path, _ = scratch(spark)
    _saved_index(spark, d).export_json(path)
    postings_ = spark.read.schema("term string, doc_ids array<bigint>").json(f"{path}/postings")
    df = spark.read.schema("term string, df bigint").json(f"{path}/df")
    return postings_.join(df, "term").select("term", "df", F.array_join(F.col("doc_ids").cast("array<string>"), ",").alias("doc_ids"))


@query
def json_search(spark: SparkSession, d: str) -> DataFrame:
    """A search of the index that was written in JSON and read again."""
    path, _ = scratch(spark)
    _saved_index(spark, d).export_json(path)
    return ranked.search(index.import_json(spark, path), RANKED_QUERY)


def _streamed(spark: SparkSession, d: str) -> str:
    """The documents in four files, each of them a batch of a stream into an index; where that is."""
    (files, _), (path, _), (state, _) = scratch(spark), scratch(spark), scratch(spark)
    docs = table(spark, d, "documents").select("doc_id", "text")
    docs.repartition(4, "doc_id").write.parquet(files)
    index_stream.append_documents(index_stream.read_documents(spark, files, docs.schema, 1), path, state).awaitTermination()
    return path


@query
def stream_ranked(spark: SparkSession, d: str) -> DataFrame:
    """Batch by batch into an index, then searched."""
    return ranked.search(index_stream.load(spark, _streamed(spark, d)), RANKED_QUERY)


@query
def stream_refreshed(spark: SparkSession, d: str) -> DataFrame:
    """The same by norms that were kept, all batches being in them."""
    path = _streamed(spark, d)
    index_stream.refresh(spark, path)
    return ranked.search(index_stream.load(spark, path, kept_norms=True), RANKED_QUERY)


# --- Boolean --------------------------------------------------------------------------------------------------------


def _boolean(text: str) -> Query:
    return lambda spark, d: boolean.search(table(spark, d, "documents"), text)


QUERIES |= {name: _boolean(text) for name, text in BOOLEAN.items()}


@query
def boolean_postings(spark: SparkSession, d: str) -> DataFrame:
    return boolean.search_postings(_tf(spark, d), table(spark, d, "documents"), BOOLEAN["boolean_or_not"])


@query
def boolean_setops(spark: SparkSession, d: str) -> DataFrame:
    return boolean.search_sets(_tf(spark, d), table(spark, d, "documents"), "trash OR der NOT und OR the AND of")


# --- records --------------------------------------------------------------------------------------------------------


def _players(spark: SparkSession, d: str) -> DataFrame:
    """Customers as player records; some have no name or no team."""
    c = table(spark, d, "customer")
    k = F.col("c_custkey")
    return c.select(
        k.alias("doc_id"),
        F.when(k % 11 == 0, F.lit("Unknown")).otherwise(F.col("c_name")).alias("Player"),
        F.when(k % 7 == 0, F.lit("Unknown Status (Meta Missing)")).otherwise(F.col("c_mktsegment")).alias("CurrentTeam"),
    )


@query
def corrupt_filter(spark: SparkSession, d: str) -> DataFrame:
    return records.without_corrupt(_players(spark, d)).select("doc_id", T.join_full(F.col("Player"), F.col("CurrentTeam")).alias("text"))


def _sources(spark: SparkSession, d: str) -> tuple[DataFrame, DataFrame]:
    """Customers and suppliers as two sources: names agree in number and differ in case and outer spaces."""
    c, s = table(spark, d, "customer"), table(spark, d, "supplier")
    number = lambda name: F.substring(name, -9, 9)
    k = F.col("c_custkey")
    first = c.select(
        F.concat(F.lit("player "), number("c_name")).alias("Player"), F.when(k % 3 == 0, "N/A").otherwise(F.concat((k % 8).cast("string"), F.lit("-1"))).alias("Height"),
        F.when(k % 4 == 0, None).otherwise((k % 300).cast("string")).alias("Weight"), F.when(k % 5 == 0, "N/A").otherwise((k % 2).cast("string")).alias("BornYear"),
        F.lit(None).cast("string").alias("DraftYear"), F.col("c_mktsegment").alias("College"), F.lit("").alias("HighSchool"), F.col("c_mktsegment").alias("Position"),
        F.col("c_name").alias("BornCity"), F.col("c_nationkey").alias("BornState"), F.lit("Retired").alias("CurrentTeam"), F.lit("Undrafted").alias("DraftTeam"), F.lit("Alive").alias("DiedYear"),
    )
    k = F.col("s_suppkey")
    second = s.select(
        F.concat(F.lit(" PLAYER "), number("s_name"), F.lit(" ")).alias("player_name"), F.when(k % 5 == 0, "N/A").otherwise((k % 2).cast("string")).alias("birth_year"),
        F.col("s_name").alias("birth_place"), (k % 7).cast("string").alias("height_ft"), F.when(k % 6 == 0, " n/a ").otherwise((k % 12).cast("string")).alias("height_in"),
        F.lit("200 lb").alias("weight_lb"), F.col("s_name").alias("college"), F.col("s_nationkey").alias("high_school"), F.lit("2001").alias("draft_year"),
        F.lit(None).cast("string").alias("draft_round"), F.lit("info").alias("info"),
    )
    return first, second


@query
def outer_join_merge(spark: SparkSession, d: str) -> DataFrame:
    return records.merge_players(*_sources(spark, d))


@query
def left_na_precedence(spark: SparkSession, d: str) -> DataFrame:
    first, second = _sources(spark, d)
    return records.merge_players(first, second, na_as_null=True).select("Player", "Height", "BornYear")


@query
def blank_to_na(spark: SparkSession, d: str) -> DataFrame:
    p = table(spark, d, "part").select("p_partkey", F.when(F.col("p_size") % 2 == 0, F.lit("")).otherwise(F.col("p_brand")).alias("brand"), F.when(F.col("p_size") % 3 == 0, None).otherwise(F.col("p_type")).alias("kind"))
    return records.blanks_to_na(p, ["brand", "kind"])


@query
def distinct_rows(spark: SparkSession, d: str) -> DataFrame:
    c = table(spark, d, "customer").select("c_mktsegment", "c_nationkey")
    return c.union(c).distinct()


# --- HTML -----------------------------------------------------------------------------------------------------------


@query
def html_title_h1(spark: SparkSession, d: str) -> DataFrame:
    h = F.col("html")
    return table(spark, d, "pages").select("page_id", extract_wiki.page_title(h).alias("title"), T.strip_tags(T.first_group(h, extract_html.NAME_IN_H1)).alias("h1"))


@query
def html_links(spark: SparkSession, d: str) -> DataFrame:
    found = extract_html.links(table(spark, d, "pages"), "page_id", "html", "https://example.org", r'<a href="(/[^"]+)">[^<]+</a>')
    return found.select("page_id", F.col("at").cast("bigint").alias("at"), "link")


@query
def html_comments(spark: SparkSession, d: str) -> DataFrame:
    found = extract_html.comment_sections(F.col("html"), "ad 1")
    return table(spark, d, "pages").select("page_id", F.array_join(found, "|").alias("comments"))


@query
def html_unescape(spark: SparkSession, d: str) -> DataFrame:
    c = table(spark, d, "customer").select("c_custkey", F.concat(F.lit("&lt;b&gt; "), F.col("c_name"), F.lit(" &amp; &#39;"), F.col("c_mktsegment"), F.lit("&quot;")).alias("t"))
    return c.select("c_custkey", T.decode_entities(F.array("t"))[0].alias("text"))


_STATES = ("TX", "CA", "NY", "OH")


def _player_pages(spark: SparkSession, d: str) -> DataFrame:
    """Player pages whose fields are the customer's columns; every thirteenth has no meta section."""
    c = table(spark, d, "customer").join(F.broadcast(table(spark, d, "nation")), F.col("c_nationkey") == F.col("n_nationkey"))
    k, say = F.col("c_custkey"), F.lit
    state = F.element_at(F.array(*[F.lit(s) for s in _STATES]), (k % 4 + 1).cast("int"))
    year, n = (1950 + k % 50).cast("string"), (k % 10).cast("string")
    died = F.when(k % 6 == 0, F.concat(say("<strong>Died:</strong> in <b>May</b> "), (2001 + k % 20).cast("string"))).otherwise(
        F.when(k % 6 == 1, F.lit("")).otherwise(F.concat(say("<STRONG>Team</STRONG>: <span><a href='t'>"), F.col("n_name"), say("</a>")))
    )
    draft = F.when(k % 5 == 0, F.lit("")).otherwise(F.concat(say("<strong>Draft</strong>: <a href='d'>"), F.col("c_mktsegment"), say("</a> in <a href='/years/"), year, say("/draft.htm'>")))
    born = F.when(k % 3 == 0, F.concat(say("in&nbsp;Town &amp; Co,&nbsp;<a href='c'>"), F.col("n_name"), say("</a>"))).otherwise(F.concat(say("in&nbsp; Town,&nbsp;<a href='c'>"), state, say("</a>")))
    meta = F.concat(
        say("<div id=\"meta\"><strong>Position</strong>: QB <p><span>6-"), n, say("</span>, <span>2"), n, say("0lb</span> <strong>Born:</strong> <span>May 1, "), year, say("</span> "), born,
        say(" <strong>College</strong>: <a href='x'> "), F.col("c_mktsegment"), say(" </a> <strong>High School</strong>: <a href='y'>H&#39;"), F.col("n_name"), say("</a> "), draft, died, say("<script></script></div>"),
    )
    page = F.concat(say("<html><h1 class='a'><span>"), F.col("c_name"), say("</span></h1>\n"), F.when(k % 13 == 0, F.lit("<div class='b'>nothing</div>")).otherwise(meta), say("</html>"))
    return c.select(k.alias("doc_id"), page.alias("html"))


@query
def player_extract(spark: SparkSession, d: str) -> DataFrame:
    return extract_html.extract_players(_player_pages(spark, d), keep=("doc_id",)).where("CurrentTeam <> 'Unknown Status (Meta Missing)'")


@query
def player_extract_missing(spark: SparkSession, d: str) -> DataFrame:
    return extract_html.extract_players(_player_pages(spark, d), keep=("doc_id",)).where("CurrentTeam = 'Unknown Status (Meta Missing)'")


@query
def natural_sort(spark: SparkSession, d: str) -> DataFrame:
    k = F.col("c_custkey")
    files = table(spark, d, "customer").select(F.concat(F.chr((65 + k % 26).cast("int")), F.lit("_"), k.cast("string"), F.lit(".html")).alias("file"))
    return readers.numbered(files.withColumn("_key", T.natural_key(F.col("file"))), ["_key", "file"], name="place").select("place", "file")


# --- wiki -----------------------------------------------------------------------------------------------------------


def _wiki_pages(spark: SparkSession, d: str) -> DataFrame:
    """Wiki pages on parts: some are players by infobox, some by category, some of another sport, some not articles."""
    p, say = table(spark, d, "part"), F.lit
    k = F.col("p_partkey")
    box = F.when(k % 4 == 0, F.lit("{{Infobox NFL player\n")).when(k % 4 == 1, F.lit("{{Infobox soccer\n")).otherwise(F.lit("{{Infobox person\n"))
    category = F.when(k % 3 == 0, F.lit("[[Category:Chicago Bears players]]")).when(k % 3 == 1, F.lit("[[Category:American football guard players]]")).otherwise(F.lit("[[Category:Parts]]"))
    title = F.concat(F.when(k % 10 == 0, F.lit("Template:")).otherwise(F.lit("")), F.col("p_name"), F.lit(" (part)"))
    page = F.concat(
        say("<page>\n<title>"), title, say("</title>\n"), box, say("| name = "), F.col("p_name"), say("\n| birth_date = {{Birth date and age|"), (1900 + k % 100).cast("string"),
        say("|1|2}}\n| birth_place = [[Town|"), F.col("p_brand"), say("]], ''X''\n| height_ft = 6\n| height_in = "), (k % 12).cast("string"), say("\n| weight_lbs = "), F.col("p_size").cast("string"),
        say("0\n| college = [[State "), F.col("p_type"), say("]]<ref>a b</ref>\n| high_school =\n| draftyear = "), (2000 + k % 20).cast("string"), say("\n| draftround = 1 | draftpick = 3\n}}\n'''"),
        F.col("p_name"), say("''' is a [[part|"), F.col("p_type"), say("]] of  size&nbsp;"), F.col("p_size").cast("string"), say(". It is not a player.\n"), category, say("\n"),
    )
    return p.select("p_partkey", "p_name", "p_size", "p_type", "p_brand", page.alias("page"))


@query
def page_classify(spark: SparkSession, d: str) -> DataFrame:
    p = F.col("page")
    return _wiki_pages(spark, d).where(extract_wiki.is_player_page(p) & extract_wiki.is_article(extract_wiki.page_title(p))).select("p_partkey")


@query
def infobox_fields(spark: SparkSession, d: str) -> DataFrame:
    p = F.col("page")
    named = {c: extract_wiki.infobox_field(p, c) for c in ("birth_place", "height_ft", "height_in", "college", "high_school", "draftround")}
    return _wiki_pages(spark, d).select("p_partkey", extract_wiki.weight(p).alias("weight"), *[c.alias(k) for k, c in named.items()])


@query
def first_sentence(spark: SparkSession, d: str) -> DataFrame:
    return _wiki_pages(spark, d).select("p_partkey", extract_wiki.first_sentence(F.col("page")).alias("info"))


@query
def wiki_players(spark: SparkSession, d: str) -> DataFrame:
    return extract_wiki.extract_wiki_players(_wiki_pages(spark, d))


_BIRTHS = (
    "{{Birth date and age|%Y|1|2}}", "{{Birth date and age|df=yes|%Y|1|2}}", "{{Birth-date|%Y|1|2}}", "{{bda|%Y|1|2}}", "{{birth date|%Y|1|2|df=y}}", "{{Birth date|%Y|1|2}}",
    "birth_date = %Y-01-02", "birth_date = {{birth date and age|%Y|1|2}}", "{{Birth year and age|%Y}}", "{{born in|%Y}}", "{{birth year and age|%Y}}",
    "born = {{birth year and age|%Y}}", "{{Birth| year = %Y | month = 1 | day = 2 }}", "{{death date and age|2020|1|2|%Y|3|4}}", "born long ago",
)


@query
def birth_year(spark: SparkSession, d: str) -> DataFrame:
    k = F.col("c_custkey")
    form = F.element_at(F.array(*[F.lit(b) for b in _BIRTHS]), (k % len(_BIRTHS) + 1).cast("int"))
    made = table(spark, d, "customer").select("c_custkey", F.replace(F.concat(F.lit("before 1777 "), form, F.lit(" after")), F.lit("%Y"), (1900 + k % 100).cast("string")).alias("t"))
    return made.select("c_custkey", extract_wiki.birth_year(F.col("t")).alias("birth_year"))


@query
def wiki_clean(spark: SparkSession, d: str) -> DataFrame:
    n, k = F.col("c_name"), F.col("c_custkey").cast("string")
    raw = F.concat(
        F.lit("&lt;ref name=a&gt;x&lt;/ref&gt;'''"), n, F.lit("''' <ref>r</ref><ref name=b/>is [["), n, F.lit("|the "), k, F.lit("]] and [[plain]] [12] {{t|1}} [http://a.b label "), k,
        F.lit("] [http://c.d] <b>bold</b> &amp; ref {{q}}  end\t "),
    )
    return table(spark, d, "customer").select("c_custkey", extract_wiki.clean_markup(raw).alias("text"))


@query
def clean_name_surname(spark: SparkSession, d: str) -> DataFrame:
    c = table(spark, d, "customer").select("c_custkey", T.without_brackets(F.concat(F.lit(" "), F.col("c_name"), F.lit(" "), F.col("c_mktsegment"), F.lit(" (x) (y z)"))).alias("name"))
    return c.select("c_custkey", "name", T.surname(F.col("name")).alias("surname"))


# --- files ----------------------------------------------------------------------------------------------------------


@query
def page_framing(spark: SparkSession, d: str) -> DataFrame:
    """Pages written as a dump of several files, and framed again."""
    path, _ = scratch(spark)
    pages = _wiki_pages(spark, d).select(F.concat(F.lit("  <siteinfo>x</siteinfo>\n  "), "page", F.lit("</page>")).alias("t"))
    writers.write_text(pages, "t", path)
    page = F.col("page")
    read = readers.read_wiki_pages(spark, path)
    return read.select(extract_wiki.page_title(page).alias("title"), extract_wiki.infobox_field(page, "height_in").alias("height_in"))


def _awkward(spark: SparkSession, d: str) -> DataFrame:
    """Customers with quotes, commas and line ends in their fields."""
    k = F.col("c_custkey")
    name = F.concat("c_name", F.when(k % 2 == 0, F.lit(', the "old" one')).otherwise(F.lit("\nof two lines")))
    return table(spark, d, "customer").select(k.cast("string").alias("key"), name.alias("name"), F.format_string("%03d", k % 1000).alias(" code "))


@query
def csv_round_trip(spark: SparkSession, d: str) -> DataFrame:
    path, _ = scratch(spark)
    writers.write_csv(_awkward(spark, d), path, single_file=True)
    return readers.read_csv(spark, path)


@query
def csv_declared(spark: SparkSession, d: str) -> DataFrame:
    path, _ = scratch(spark)
    writers.write_csv(_awkward(spark, d), path)
    return readers.read_csv(spark, path, readers.strings("key", "name", "code"))


def _damaged(spark: SparkSession, d: str) -> tuple[DataFrame, DataFrame, dict[str, int]]:
    """Customers as lines, some with a field too few or too many, a balance that is no number, or no name; read with checks."""
    source, path = scratch(spark)[0], scratch(spark)[0]
    k, balance = F.col("c_custkey"), F.when(F.col("c_custkey") % 13 == 0, F.lit("much")).otherwise(F.col("c_acctbal").cast("decimal(12,2)").cast("string"))
    fields = [k.cast("string"), F.when(k % 17 == 0, F.lit("")).otherwise(F.col("c_name")), balance]
    line = F.when(k % 7 == 0, F.concat_ws(",", *fields[:2])).when(k % 11 == 0, F.concat_ws(",", *fields, F.lit("more"))).otherwise(F.concat_ws(",", *fields))
    writers.write_text(table(spark, d, "customer").select(line.alias("line")), "line", source)
    schema = StructType([StructField("key", LongType()), StructField("name", StringType()), StructField("balance", DecimalType(12, 2))])
    return writers.write_checked(readers.read_csv_checked(spark, source, schema, required=["name"], header=False), path)


@query
def csv_accepted(spark: SparkSession, d: str) -> DataFrame:
    return _damaged(spark, d)[0].select("key", "name", F.col("balance").cast("string").alias("balance"))


@query
def csv_rejected(spark: SparkSession, d: str) -> DataFrame:
    """Why rows were rejected, and the text of those that couldn't be taken apart."""
    return _damaged(spark, d)[1].select("key", F.array_join("reasons", "|").alias("reasons"), "raw")


@query
def observed_totals(spark: SparkSession, d: str) -> DataFrame:
    """Counted while both tables were written."""
    seen = _damaged(spark, d)[2]
    return spark.createDataFrame([(seen["read"], seen["accepted"], seen["rejected"])], "read long, accepted long, rejected long")


@query
def extraction_totals(spark: SparkSession, d: str) -> DataFrame:
    """Players are extracted and written; how many pages there were, and how many players without a meta section, is counted
    on the way."""
    path, _ = scratch(spark)
    found = extract_html.extract_players(_player_pages(spark, d), keep=("doc_id",))
    seen = writers.write_observed(found, path, {"pages": F.count("*"), "missing": F.count_if(F.col("CurrentTeam") == "Unknown Status (Meta Missing)")})
    read = spark.read.parquet(path).agg(F.count("*").alias("written"))
    return read.select(F.lit(seen["pages"]).cast("bigint").alias("pages"), F.lit(seen["missing"]).cast("bigint").alias("missing"), "written")


@query
def csv_inferred(spark: SparkSession, d: str) -> DataFrame:
    path, _ = scratch(spark)
    writers.write_csv(_awkward(spark, d), path)
    read = readers.read_csv_inferred(spark, path).toDF("key", "name", "code")
    return read.select(F.col("key").cast("bigint").alias("key"), "name", F.col("code").cast("string").alias("code"))


@query
def json_round_trip(spark: SparkSession, d: str) -> DataFrame:
    path, _ = scratch(spark)
    writers.write_json(_awkward(spark, d), path)
    return spark.read.json(path).toDF("code", "key", "name")


@query
def sample_rows(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "customer").select("c_custkey", "c_name").orderBy("c_custkey").limit(3)


@query
def progress_counts(spark: SparkSession, d: str) -> DataFrame:
    return records.counts(_players(spark, d))


# --- fielded --------------------------------------------------------------------------------------------------------


def _part_index(spark: SparkSession, d: str) -> fielded.FieldIndex:
    p = table(spark, d, "part").select(F.col("p_partkey").alias("doc_id"), *PART_FIELDS, F.col("p_size").cast("string").alias("weight"))
    return fielded.build(p, list(PART_FIELDS), ["weight"])


def _fielded(text: str) -> Query:
    def run(spark: SparkSession, d: str) -> DataFrame:
        return fielded.search_all(_part_index(spark, d), text, PART_FIELDS).select("doc_id", F.round("score", 6).alias("score"))

    return run


FIELDED = {"bm25_multifield": "small ring 13", "bm25_and": "red AND economy", "bm25_not": "small NOT economy", "bm25_and_not": "red AND bolt NOT economy", "exact_numeric": "21"}
FIELDED |= {"bm25_range_exclusive": "p_name:{gizmo TO red}", "bm25_transposed": "smlal~1", "bm25_slop": 'p_name:"bolt red"~2'}
FIELDED |= {"bm25_prefix": "ec*", "bm25_wildcard": "b?lt", "bm25_fuzzy": "smoll~1", "bm25_range": "p_name:[rad TO ret]", "bm25_must": "+small -ring economy^2", "bm25_blank": "   "}
FIELDED |= {"bm25_match_all": "*:* -small", "bm25_regex": "/(ri|bo)[a-z]{1,2}/", "bm25_infix": "*lat*", "bm25_fuzzy_score": "bolt~2"}
#: Sides that can't be read: an alternative, what mustn't be found, and what must.
FIELDED |= {"bm25_field_error": "small ( AND ring NOT economy", "bm25_not_error": "small NOT (economy", "bm25_not_regex_error": "ring NOT /[a/"}
QUERIES |= {name: _fielded(text) for name, text in FIELDED.items()}


@query
def bm25_by_dictionary(spark: SparkSession, d: str) -> DataFrame:
    """Patterns on a saved index: their terms are read from its dictionary."""
    path, _ = scratch(spark)
    _part_index(spark, d).save(path)
    found = fielded.search_all(fielded.FieldIndex.load(spark, path), "b?lt glod~2 wid*t", PART_FIELDS)
    return found.select("doc_id", F.round("score", 6).alias("score"))


@query
def append_index(spark: SparkSession, d: str) -> DataFrame:
    """An index saved in two parts, searched as one."""
    path, _ = scratch(spark)
    p = table(spark, d, "part").select(F.col("p_partkey").alias("doc_id"), *PART_FIELDS)
    for k, mode in ((0, "overwrite"), (1, "append")):
        fielded.build(p.where(F.col("doc_id") % 2 == k), list(PART_FIELDS)).save(path, mode)
    return fielded.search_all(fielded.FieldIndex.load(spark, path), FIELDED["bm25_multifield"], PART_FIELDS).select("doc_id", F.round("score", 6).alias("score"))


@query
def reindexed(spark: SparkSession, d: str) -> DataFrame:
    """Documents saved with other texts, then as they are, all of them again, and as many others that are deleted: the newest count."""
    path, _ = scratch(spark)
    p = table(spark, d, "part").select(F.col("p_partkey").alias("doc_id"), *PART_FIELDS)
    other = p.withColumn("p_name", F.concat("p_name", F.lit(" small ring"))).unionByName(p.withColumn("doc_id", -F.col("doc_id") - 1))
    for docs, mode in ((other, "overwrite"), (p, "append"), (p, "append")):
        fielded.build(docs, list(PART_FIELDS)).save(path, mode)
    fielded.FieldIndex.delete(other.where("doc_id < 0").select("doc_id"), path)
    found = fielded.search_all(fielded.FieldIndex.load(spark, path, newest=True), FIELDED["bm25_multifield"], PART_FIELDS)
    return found.select("doc_id", F.round("score", 6).alias("score"))


def _player_index(spark: SparkSession, d: str) -> fielded.FieldIndex:
    """Customers as player records with all search fields."""
    c = table(spark, d, "customer").join(F.broadcast(table(spark, d, "nation")), F.col("c_nationkey") == F.col("n_nationkey"))
    k, place = F.col("c_custkey"), F.replace("n_name", F.lit("_"), F.lit(" "))
    made = c.select(
        k.alias("doc_id"), F.replace("c_name", F.lit("#"), F.lit(" ")).alias("Player"), F.col("c_mktsegment").alias("Position"), F.concat(F.lit("College of "), place).alias("College"),
        F.when(k % 3 == 0, "").otherwise(place).alias("BornCity"), F.when(k % 4 == 0, None).otherwise("Bigland").alias("BornState"), F.lit("").alias("BirthPlace_Other"),
        F.when(k % 5 == 0, "Retired").otherwise(F.concat("c_mktsegment", F.lit(" Bears"))).alias("CurrentTeam"), F.lit("Undrafted").alias("DraftTeam"), F.lit("N/A").alias("HighSchool"),
        F.concat(F.lit("a player of "), place, F.lit(" in "), "c_mktsegment").alias("info"), F.concat(F.lit("6-"), (k % 12).cast("string")).alias("Height"), F.concat((180 + k % 90).cast("string"), F.lit("lb")).alias("Weight"),
    )
    return fielded.build(fielded.derived_fields(made), [*fielded.SEARCH_FIELDS, "height_text", "weight_text"], ["height", "weight"])


@query
def fielded_topk(spark: SparkSession, d: str) -> DataFrame:
    return fielded.search(_player_index(spark, d), PLAYER_QUERY, 10)


@query
def fielded_results(spark: SparkSession, d: str) -> DataFrame:
    found = fielded.search_with_fields(_player_index(spark, d), PLAYER_QUERY, 10)
    return found.select("doc_id", "score", "player", "position", "college", "currentteam", "borncity", "weight")


@query
def fielded_height_text(spark: SparkSession, d: str) -> DataFrame:
    """A field that only the query's own syntax reaches."""
    return fielded.search_all(_player_index(spark, d), "+height_text:11 +machinery").select("doc_id")


@query
def field_statistics(spark: SparkSession, d: str) -> DataFrame:
    return _part_index(spark, d).statistics().select("field", "n", F.round("mean_len", 6).alias("mean_len"))


@query
def phrase_search(spark: SparkSession, d: str) -> DataFrame:
    i = fielded.build(table(spark, d, "documents").select("doc_id", F.lower("text").alias("text")), ["text"])
    return fielded.phrase_documents(i, PHRASE, "text")


@query
def digits_weight(spark: SparkSession, d: str) -> DataFrame:
    p = F.when(F.col("p_partkey") % 5 == 0, F.lit("N/A")).otherwise(F.concat(F.col("p_size").cast("string"), F.lit(" lb")))
    return table(spark, d, "part").select("p_partkey", T.digits(p).alias("weight"))


@query
def derived_fields(spark: SparkSession, d: str) -> DataFrame:
    out = fielded.derived_fields(records.merge_players(*_sources(spark, d)))
    return out.select("player", "weight", "weight_text", "full_name_search", "location_search")


# --- display --------------------------------------------------------------------------------------------------------


@query
def stored_projection(spark: SparkSession, d: str) -> DataFrame:
    k = F.col("c_custkey")
    c = table(spark, d, "customer").select(k.alias("doc_id"), F.col("c_acctbal").alias("score"), F.when(k % 2 == 0, "").otherwise(F.col("c_name")).alias("player"), F.when(k % 3 == 0, None).otherwise(F.col("c_name")).alias("full_name_search"), F.lit("").alias("position"), F.col("c_mktsegment").alias("position_search"))
    return display.stored_fields(c).select("doc_id", "score", "player", "position", "college", "currentteam")


@query
def display_rows(spark: SparkSession, d: str) -> DataFrame:
    k = F.col("c_custkey")
    c = table(spark, d, "customer").select(
        k.alias("rank"), k.alias("doc_id"), (F.col("c_acctbal") / 7).alias("score"), F.col("c_name").alias("Player"), F.col("c_mktsegment").alias("Position"),
        *[F.lit("N/A").alias(s.source) for s in display.PLAYERS if s.source and s.source not in ("Player", "Position")],
    )
    return display.rows(c)
