import pytest

from fernglass.operators import boolean, index

DOCS = [(1, "a b"), (2, "b c"), (3, "c"), (4, "foo-and x y"), (5, "foo and"), (6, None)]


@pytest.fixture(scope="module")
def docs(spark):
    return spark.createDataFrame(DOCS, "doc_id long, text string")


@pytest.mark.parametrize(
    "query, clauses",
    [
        ("a b", [("AND", "a"), ("AND", "b")]),
        ("a or b", [("AND", "a"), ("OR", "b")]),
        ("OR a", [("OR", "a")]),
        ("a OR NOT b", [("AND", "a"), ("NOT", "b")]),
        ("NOT a OR b", [("NOT", "a"), ("OR", "b")]),
        ('"x y"', [("AND", "x")]),
        ('a OR "" b', [("AND", "a"), ("OR", "b")]),
        ("and-foo", [("AND", "foo")]),
        ("foo-and", [("AND", "foo-and")]),
        ('"unclosed x', [("AND", "unclosed"), ("AND", "x")]),
        ("(a OR b)", [("AND", "a"), ("OR", "b")]),
        ("a AND(b)", [("AND", "a"), ("AND", "b")]),
        ("ANDY", [("AND", "andy")]),
        ("a NOT", [("AND", "a")]),
        ("?!", [("AND", "?!")]),
        ("", []),
    ],
)
def test_parse(query, clauses):
    assert boolean.parse(query) == clauses


@pytest.mark.parametrize(
    "query, ids",
    [
        ("a b", [1]),
        ("a OR c", [1, 2, 3]),
        ("NOT a", [2, 3, 4, 5, 6]),
        ("OR a", [1]),
        ("b OR NOT c", [1]),
        ("NOT a OR a", [1, 2, 3, 4, 5, 6]),
        ("a OR b AND c", [2]),
        ("b NOT c", [1]),
        ("missing", []),
        ("", []),
        ("foo-and", [4]),
        ("NOT a NOT b", [3, 4, 5, 6]),
    ],
)
def test_three_ways(docs, query, ids):
    tf = index.term_frequencies(docs)
    for found in (boolean.search(docs, query), boolean.search_postings(tf, docs, query), boolean.search_sets(tf, docs, query)):
        assert [r.doc_id for r in found.collect()] == ids


def test_routing():
    assert boolean.is_boolean("salt and pepper") and boolean.is_boolean('"a OR b"') and not boolean.is_boolean("android")
