import pytest

from pressmill.functions.stemming import stem as stem_english
from pressmill.operators import boolean as B
from pressmill.operators import embeddings as E
from pressmill.operators import index as I
from pressmill.operators import retrieval as R


@pytest.mark.parametrize(
    ("text", "expected"),
    [('"climate change" AND energy', "climate <-> change & energy"), ("climate (change OR warming)", "climate & ( change | warming )"), ("a b", "a & b"), ("NOT a and b", "!a & b"), ("a or b AND c", "a | b & c"), ('"open quote', "open <-> quote")],
)
def test_boolean(text, expected):
    assert B.render(B.parse(text)) == expected


@pytest.mark.parametrize("text", ["", "()", "(a", "a)", "AND a", "a AND", "a OR OR b", "NOT", "OR", "a AND NOT"])
def test_invalid_boolean(text):
    with pytest.raises(ValueError):
        B.parse(text)


@pytest.fixture(scope="module")
def docs(spark):
    rows = [("1", "Budget vote", None, "the council passed the budget"), ("2", "Harbour", "a strike", "council and harbour strike the the council"), ("3", None, None, None), ("4", "", "", "x budget y council")]
    return spark.createDataFrame(rows, "id string, title string, description string, content string")


def test_match(docs):
    ids = lambda df: sorted(r["id"] for r in df.collect())
    assert ids(R.search(docs, R.Match("council budget"))) == ["1", "2", "4"]
    assert ids(R.search(docs, R.Match("council budget", operator="and"))) == ["1", "4"]
    assert ids(R.search(docs, R.Match("budget", ("title",)))) == ["1"]
    assert ids(R.search(docs, R.Match("budget", weights={"title": 0.0}))) == ["1", "4"]
    assert ids(R.search(docs, R.Match("budgt", fuzziness=1))) == ["1", "4"]
    assert ids(R.search(docs, R.Match("absent"))) == []
    assert ids(R.search(docs.limit(0), R.Match("council"))) == []
    assert ids(R.match_phrase(docs, R.Phrase("the council", ("content",)))) == ["1", "2"]
    assert ids(R.match_phrase(docs, R.Phrase("council the", ("content",), 1))) == ["1"]
    assert ids(R.match_boolean(docs, R.Boolean("council AND NOT harbour"))) == ["1", "4"]
    assert I.ts_rank(I.build(docs, R.FIELDS), "votes", fields=R.FIELDS).collect()[0]["id"] == "1"
    with pytest.raises(ValueError):
        R.match_phrase(docs, R.Phrase("a b", slop=4))


def test_paging(docs):
    hits = R.search(docs, R.Match("council budget"))
    first = R.page(hits, 2).collect()
    cursor = R.encode_cursor(first[-1]["score"], first[-1]["id"])
    rest = R.page(hits, 2, R.decode_cursor(cursor)).collect()
    assert [r["id"] for r in first + rest] == [r["id"] for r in R.page(hits, 10).collect()]
    assert R.normalized(hits).where("total_matches = 3 AND score_normalized <= 1").count() == 3
    for bad in ("!", "e30=", R.encode_cursor(1.0, "00000000-0000")):
        with pytest.raises(ValueError):
            R.decode_cursor(bad)
    with pytest.raises(ValueError):
        R.page(hits, 0)
    assert R.parse_field("title^3") == ("title", 3.0) and R.parse_field("title^x") == ("title", 1.0) and R.parse_field("a^1^2") is None


def test_fusion(spark):
    rows = lambda x: spark.createDataFrame(x, "id string, rank int")
    got = R.top(R.fuse(rows([("both", 2), ("lex", 1)]), rows([("both", 1), ("vec", 2)])), 9).collect()
    assert [r["id"] for r in got] == ["both", "lex", "vec"]


def test_upsert(spark):
    schema = "id string, article_id string, model_name string, embedding array<float>, created_at timestamp"
    from datetime import datetime as dt

    articles = spark.createDataFrame([("a",), ("b",)], "id string")
    batch = spark.createDataFrame([("1", "a", "m", [1.0], dt(2020, 1, 1)), ("2", "b", "m", [1.0], dt(2020, 1, 1)), ("3", "z", "m", [1.0], dt(2020, 1, 1)), ("4", "b", "m", [2.0], dt(2020, 1, 2))], schema)
    once = E.upsert(batch.limit(0), batch, articles)
    again = E.upsert(once, batch, articles)
    assert sorted((r["article_id"], r["embedding"]) for r in again.collect()) == [("a", [1.0]), ("b", [2.0])] and once.count() == 2
    assert [r["article_id"] for r in E.orphans(batch, articles).collect()] == ["z"]


def test_stems():
    assert [stem_english(w) for w in ("councils", "restored", "relational", "hopping", "ponies", "caresses", "is", "élan")] == ["council", "restor", "relat", "hop", "poni", "caress", "is", "élan"]


def test_labels_and_jobs(spark):
    from pressmill.operators import evaluation as V

    assert R.fields_of("AD") == ("title", "subtitle", "author") and R.label_weights({"title": 3.0, "subtitle": 1.0, "author": 2.0}) == [2.0, 0.0, 0.0, 3.0]
    with pytest.raises(ValueError):
        R.fields_of("AX")
    runs = spark.createDataFrame([("a", 1), ("b", 2)], "job string, n int")
    assert V.of_jobs(runs, ["b"]).count() == 1 and V.of_jobs(runs, []).count() == 2
    with pytest.raises(ValueError, match="no job c"):
        V.of_jobs(runs, ["c"])


def test_stored_cells(spark):
    import numpy as np

    from pressmill.operators import ann

    rng = np.random.default_rng(3)
    x = rng.standard_normal((1500, 16)).astype(np.float32)
    x[700:] = x[:800] + 0.1 * rng.standard_normal((800, 16))
    df = spark.createDataFrame([(f"{i:04}", v.tolist()) for i, v in enumerate(x)] + [("n", None), ("z", [0.0] * 16), ("s", [1.0])], "id string, embedding array<float>")
    index = ann.build(df, 16, cell=40)
    shares = [ann.recall(ann.nearest(index, x[i].tolist(), 5), R.nearest(df, x[i].tolist(), 5)) for i in range(6)]
    assert sum(shares) / 6 >= 0.9 and index.vectors.count() == 1500
    some = ann.nearest(index, x[0].tolist(), 2, radius=0.2, sure=0.95)
    assert [r["id"] for r in some.collect()] == ["0000", "0700"]
    assert ann.nearest(ann.build(df.limit(0), 16), [1.0] * 16, 3).count() == 0
