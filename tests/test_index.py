import math

import pytest

from pressmill.functions import stemming as S
from pressmill.operators import index as I
from pressmill.operators import retrieval as R

SCHEMA = "id string, title string, description string, content string, subtitle string, author string, tf int"


@pytest.mark.parametrize(
    ("word", "expected"),
    [
        ("consigned", "consign"), ("knightly", "knight"), ("generously", "generous"), ("happiness", "happi"), ("cries", "cri"), ("ties", "tie"), ("gas", "gas"), ("gaps", "gap"), ("kiwis", "kiwi"),
        ("hoping", "hope"), ("hopping", "hop"), ("luxuriated", "luxuri"), ("feed", "feed"), ("agreed", "agre"), ("say", "say"), ("cry", "cri"), ("nationally", "nation"), ("skies", "sky"),
        ("dying", "die"), ("inning", "inning"), ("proceed", "proceed"), ("relational", "relat"), ("conditional", "condit"), ("communication", "communic"), ("falling", "fall"), ("bed", "bed"), ("used", "use"),
        ("libraries", "librari"), ("library", "librari"), ("youth", "youth"), ("boyish", "boyish"), ("is", "is"), ("élan", "élan"), ("a1b2", "a1b2"),
    ],
)
def test_stems(word, expected):
    assert S.stem(word) == expected


def test_lexemes():
    assert S.lexemes(["the", "libraries", "of", "towns"]) == [("librari", 1), ("town", 3)] and S.lexemes(["of", "the"]) == []


@pytest.fixture(scope="module")
def rows():
    return [
        ("1", "Budget vote", None, "the council passed the budget", "", "Ann Budget", 9), ("2", "Harbour", "a strike", "council and harbour strike the the council", None, None, 9),
        ("3", None, None, None, None, None, 9), ("4", "", "", "x budget y council", "Harbour news", "", 9), ("1", "Budget vote", None, "the council passed the budget", "", "Ann Budget", 9), (None, "budget", None, None, None, None, 9),
    ]


@pytest.fixture(scope="module")
def index(spark, rows):
    return I.build(spark.createDataFrame(rows, SCHEMA))


def ids(df):
    return sorted(r["id"] for r in df.collect())


def test_same_as_without_index(spark, rows, index):
    docs = spark.createDataFrame([r for r in rows if r[0]], SCHEMA)
    for q in (
        R.Match("council budget", R.ALL_FIELDS), R.Match("council budget", R.ALL_FIELDS, "and"), R.Match("budget vote", weights={"title": 3.0}, best_fields=True), R.Match("budgt councl", fuzziness=1),
        R.Match("harbor", R.ALL_FIELDS, fuzziness=R.AUTO), R.Match("absent"), R.Match("budget", weights={"title": 0.0}),
    ):
        want = {tuple(r) for r in R.search(docs, q).collect()}
        assert {tuple(r) for r in I.search(index, q).collect()} == want, q
    for p in (R.Phrase("the council", ("content",)), R.Phrase("council the", ("content",), 1), R.Phrase("the the"), R.Phrase("budget"), R.Phrase("ann budget", R.ALL_FIELDS)):
        assert {(r["id"], r["fields"]) for r in I.match_phrase(index, p).collect()} == {tuple(r) for r in R.match_phrase(docs, p).collect()}, p
    for e in ("council AND NOT harbour", "NOT council", 'NOT "the council" OR strike', "a OR x", '"harbour news" OR vote'):
        assert ids(I.match_boolean(index, R.Boolean(e, R.ALL_FIELDS))) == ids(R.match_boolean(docs, R.Boolean(e, R.ALL_FIELDS))), e


def test_edges(spark, index):
    assert (index.documents, ids(index.lengths)) == (4, ["1", "2", "3", "4"])
    assert I.search(index, R.Match("")).count() == 0 and I.match_phrase(index, R.Phrase("")).count() == 0 and I.ts_rank(index, "the of").count() == 0
    assert ids(I.rank_all(index, R.Match("council"), 10)) == ["1", "2", "3", "4"]
    empty = I.build(spark.createDataFrame([], SCHEMA))
    assert I.search(empty, R.Match("council")).count() == 0 and I.rank_all(empty, R.Match("council"), 3).count() == 0 and I.match_boolean(empty, R.Boolean("NOT a")).count() == 0
    with pytest.raises(ValueError):
        I.match_phrase(index, R.Phrase("a b", slop=4))
    assert ids(I.prefix(index, "counc", ("content",))) == ["1", "2", "4"] and ids(I.term_set(index, ["strike", "vote"], R.FIELDS)) == ["1", "2"]
    assert ids(I.near(index, "budget", "council", 2, "content", ordered=True)) == ["4"] and ids(I.near(index, "budget", "council", 3, "content")) == ["1", "4"]


def test_ts_rank(index):
    got = {r["id"]: r["score"] for r in I.ts_rank(index, "budgets").collect()}
    # of 1: title 1.0, content 0.2, author 0.1; of 4: content
    assert got == {"1": pytest.approx(round((1 + 0.2 / 4 + 0.1 / 9) / 1.64493406685, 4)), "4": pytest.approx(round(0.2 / 1.64493406685, 4))}
    both = {r["id"]: r["score"] for r in I.ts_rank(index, "the budget of councils", "and", ("content",)).collect()}
    pair = lambda d: 0.2 * math.sqrt(1 / (1.005 + 0.05 * math.exp(d / 1.5 - 2)))
    assert both == {"1": pytest.approx(round(pair(3), 4)), "4": pytest.approx(round(pair(2), 4))}
    assert ids(I.ts_rank(index, "budget the council", "phrase", ("content",))) == ["4"] and ids(I.ts_rank(index, "budget council", "phrase", ("content",))) == []


def test_kept_until_files_change(spark, tmp_path, rows):
    path = str(tmp_path / "articles.parquet")
    spark.createDataFrame(rows[:2], SCHEMA).coalesce(1).write.parquet(path)
    one = I.of_table(spark, path)
    assert I.of_table(spark, path) is one
    spark.createDataFrame(rows[3:4], SCHEMA).write.mode("append").parquet(path)
    assert I.of_table(spark, path).documents == 3
