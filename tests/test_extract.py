import bz2

import pytest
from pyspark.sql import functions as F

from fernglass.functions import text as T
from fernglass.operators import extract_html, extract_wiki
from fernglass.sources import readers

META = """<h1 x="y"><b>Not</b><span> Al &amp; <i>Bo</i> </span></h1><div id="meta"><strong>Positions</strong>: QB/WR
<span>6-2</span>, <span>210lb</span><strong>Born:</strong> May 3, 1985 in&nbsp;Ulm,&nbsp;<a href="q">Germany</a>
<strong>College</strong>: <a href="c">X &#39;Y</a><strong>High School</strong>: <a href="h">Z</a>
<strong>Draft</strong>: 1st by <a href="t">Bears</a> in <a href="/years/2004/draft.htm">2004</a>{tail}<script></script>"""


def record(spark, html):
    return extract_html.extract_players(spark.createDataFrame([(html,)], "html string")).first().asDict()


def test_complete(spark):
    r = record(spark, META.replace("{tail}", "<strong>TEAM</strong>: <a href='z'>Jets</a>"))
    assert r == {
        "Player": "Al & Bo", "Position": "QB/WR", "Height": "6-2", "Weight": "210lb", "BornYear": "1985", "BornCity": "Ulm", "BornState": "Germany", "CurrentTeam": "Jets", "DiedYear": "Alive",
        "College": "X 'Y", "HighSchool": "Z", "DraftTeam": "Bears", "DraftYear": "2004",
    }


@pytest.mark.parametrize("tail, team, died", [("", "Retired", "Alive"), ("<strong>Died:</strong> 2001 <strong>Team</strong>: <a b>C</a>", "Died", "2001")])
def test_status(spark, tail, team, died):
    r = record(spark, META.replace("{tail}", tail))
    assert (r["CurrentTeam"], r["DiedYear"]) == (team, died)


def test_missing(spark):
    r = record(spark, "<h1>A &amp; B</h1>")
    assert r["Player"] == "A &amp; B" and r["CurrentTeam"] == "Unknown Status (Meta Missing)" and r["DraftYear"] == "Undrafted" and r["DiedYear"] == "N/A"
    assert record(spark, None)["Player"] == "Unknown" and record(spark, "<h1><span></span></h1>")["Player"] == ""
    nested = record(spark, '<h1>N</h1><div class="o"><div id="meta"><span>6-1</span></div>')
    assert nested["Height"] == "6-1" and nested["CurrentTeam"] == "Retired"


def test_links(spark):
    html = '<a href="/players/A/b.htm">x</a><a href="/players/A/c.htm">y</a><a href="/players/A/b.htm">z</a><a href="/other">o</a>'
    df = spark.createDataFrame([(1, html)], "id long, html string")
    assert [r.link for r in extract_html.links(df, "id", "html", "h:").orderBy("at").collect()] == ["h:/players/A/b.htm", "h:/players/A/c.htm"]


def test_html_folder(spark, tmp_path):
    for n in (10, 2, 1):
        (tmp_path / f"A_{n}.html").write_text(f"<h1>p{n}</h1>\n")
    (tmp_path / "A_3.txt").write_text("no")
    assert [r.file for r in readers.in_file_order(readers.read_html(spark, str(tmp_path))).collect()] == ["A_1.html", "A_2.html", "A_10.html"]


PAGE = "<page>\n<title>{title}</title>\n{{{{Infobox NFL player\n| birth_date = {{{{Birth date and age|1980|1|2}}}}\n| weight_lbs = 210\n| college = [[State|S]] | x = 1\n}}}}\n'''N''' is (b) a c. More.\n{tail}\n</page>"


@pytest.mark.parametrize("packed", [False, True])
def test_dump(spark, tmp_path, packed):
    dump = "<mediawiki>\n" + "\n".join(PAGE.format(title=f"P{i} (x)", tail="y" * (i % 50)) for i in range(200)) + "\n<page><title>one line</title></page>\n</mediawiki>\n"
    path = tmp_path / ("d.xml.bz2" if packed else "d.xml")
    path.write_bytes(bz2.compress(dump.encode()) if packed else dump.encode())
    pages = readers.read_wiki_pages(spark, str(path))
    assert pages.count() == 201 and pages.where("page like '<page>%'").count() == 201
    players = extract_wiki.extract_wiki_players(pages.union(pages)).collect()
    assert len(players) == 200
    first = players[0]
    assert (first.player_name, first.birth_year, first.weight_lb, first.college, first.height_ft, first.info) == ("P0", "1980", "210 lb", "S", "N/A", "N is (b) a c.")


@pytest.mark.parametrize(
    "page, is_player",
    [
        ("{{Infobox NFL player Infobox soccer", True), ("[[Category:Chicago Bears x", True), ("[[Category:x NFL players]]", True), ("[[Category:x NFL players]] Infobox soccer", False),
        ("[[Category:\nNFL players]]", False), ("nothing", False),
    ],
)
def test_classify(spark, page, is_player):
    assert spark.range(1).select(extract_wiki.is_player_page(F.lit(page))).first()[0] is is_player


@pytest.mark.parametrize(
    "text, year",
    [("{{death date and age|2020|1|2|1950|3|4}} {{Birth date and age|x|1949|1|2}}", "1949"), ("{{Birth Date|1949|1|2}}", None), ("birth_date =1930-1-2", "1930")],
)
def test_birth_year(spark, text, year):
    assert spark.range(1).select(extract_wiki.birth_year(F.lit(text))).first()[0] == year


@pytest.mark.parametrize(
    "field, text, value",
    [
        ("college", "| college = A {{x}} B\n| next = 1", "A B"), ("college", "| College= A\n}}", "A"), ("college", "| college = A", "A"), ("college", "| other = A", ""),
        ("weight", "| weight_kg = 90", "90"), ("weight", "| weight = 210 lb\n", "210 lb"), ("weight", "| weight = 210\n| weight_lb = 99\n", "99 lb"),
    ],
)
def test_infobox(spark, field, text, value):
    c = extract_wiki.weight(F.lit(text)) if field == "weight" else extract_wiki.infobox_field(F.lit(text), field)
    assert spark.range(1).select(c).first()[0] == value


@pytest.mark.parametrize("text, tokens", [("O'Brien 6-2 --x' é1", ["o'brien", "6-2", "x", "1"]), (None, []), ("", [])])
def test_tokenize(spark, text, tokens):
    assert spark.createDataFrame([(text,)], "t string").select(T.tokenize(F.col("t"))).first()[0] == tokens


@pytest.mark.parametrize("text, tokens", [("O'Brien 5-10 N/A 1,000.5 é", ["o'brien", "5", "10", "n", "a", "1,000.5", "é"])])
def test_standard_tokens(spark, text, tokens):
    
    assert spark.createDataFrame([(text,)], "t string").select(T.standard_tokens(F.col("t"))).first()[0] == tokens == T.words_of(text)
