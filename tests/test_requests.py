import pytest

from pressmill.operators import requests as Q
from pressmill.operators import retrieval as R


def request(**query):
    return Q.request_of({"query": query})


def test_one_kind():
    assert request(match={"field": "title", "query": "council"}).query == R.Match("council", ("title",), "and", {"title": 1.0})
    m = request(multi_match={"query": "council", "fields": ["title^3", "content", "author^2^2"], "operator": "OR", "fuzziness": "auto"})
    assert m.kind == "multi_match" and m.query == R.Match("council", ("title", "content"), "or", {"title": 3.0, "content": 1.0}, True, R.AUTO) and m.size == 100
    assert request(phrase={"query": "a b", "slop": 2}).query == R.Phrase("a b", R.FIELDS, 2)
    assert request(boolean={"expression": "a AND b"}).query == R.Boolean("a AND b")
    assert request(hybrid={"query": "x"}).query == Q.Hybrid("x", 60)
    c = R.encode_cursor(1.5, "7")
    assert Q.request_of({"query": {"hybrid": {"query": "x"}}, "size": 5, "cursor": c}).after == (1.5, "7")


@pytest.mark.parametrize(
    ("raw", "text"),
    [
        ({}, "exactly one"), ({"query": {}}, "exactly one"), ({"query": {"match": {"field": "title", "query": "a"}, "boolean": {"expression": "b"}}}, "exactly one"),
        ({"query": {"match": {"query": "a"}}}, "field is required"), ({"query": {"match": {"field": "nothing", "query": "a"}}}, "unknown field"),
        ({"query": {"phrase": {"query": "a", "slop": 4}}}, "slop"), ({"query": {"boolean": {"expression": "a AND ("}}}, "operand"),
        ({"query": {"hybrid": {"query": "a"}}, "size": 10_001}, "size"), ({"query": {"hybrid": {"query": "a", "k": -1}}}, "k must"),
        ({"query": {"multi_match": {"query": "a", "operator": "xor"}}}, "operator"), ({"query": {"hybrid": {"query": "a", "language": "latin"}}}, "language"),
        ({"query": {"hybrid": {"query": "a"}}, "cursor": "?"}, "cursor"),
    ],
)
def test_refused(raw, text):
    with pytest.raises(ValueError, match=text):
        Q.request_of(raw)


def test_pages(spark):
    hits = spark.createDataFrame([(f"{i}", float(i // 2)) for i in range(7)], "id string, score double")
    seen, after = [], None
    while True:
        p = Q.page_of(hits, 3, after)
        seen += [r["id"] for r in p.hits]
        assert p.total_matches == 7 and p.max_score == 3.0 and p.page_max_score == p.hits[0]["score"]
        if not p.has_more:
            break
        after = R.decode_cursor(p.next_cursor)
    assert seen == ["6", "5", "4", "3", "2", "1", "0"] and p.next_cursor is None
    empty = Q.page_of(hits.limit(0), 3)
    assert (empty.hits, empty.has_more, empty.next_cursor, empty.max_score, empty.total_matches) == ([], False, None, 0.0, 0)
    assert len(Q.page_of(hits, 7).hits) == 7 and not Q.page_of(hits, 7).has_more
    assert not Q.capabilities(False)["semantic"] and Q.capabilities()["phrase"]
