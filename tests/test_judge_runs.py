import json

import pytest
from pyspark.sql import functions as F

from pressmill.operators import judge_runs as J


def test_replies():
    assert J.parse_one('Sure: {"doc_id": "a", "grade": 2} done', "a") == 2
    for reply in ('{"doc_id": "b", "grade": 2}', '{"doc_id": "a", "grade": 4}', '{"doc_id": "a", "grade": true}', "nothing", '{"doc_id": "a"}'):
        with pytest.raises(ValueError):
            J.parse_one(reply, "a")
    got = J.parse_many('```json\n[{"doc_id": "a", "grade": 3, "why": "x"}, {"doc_id": "c", "grade": 9}, {"doc_id": "z", "grade": 1}, 5]\n```', ["a", "b", "c"])
    assert got == ({"a": 3}, ["b", "c"])
    for reply in ("none", "[1", "", '{"doc_id": "a", "grade": 1}'):
        assert J.parse_many(reply, ["a"]) == ({}, ["a"])


def test_prompt(spark):
    text = J.prompt("library", [{"id": "a", "title": "T", "description": None, "content": "C"}, {"id": "b", "title": None}], "Only phrases count.")
    assert text.startswith("Only phrases count.\n\nSearch: library") and "[1] doc_id: a\nTitle: T\nContent: C" in text and "[2] doc_id: b" in text and "Description" not in text
    cut = spark.createDataFrame([("šabcd",), ("šab",), (None,)], "t string").select(J.truncated(F.col("t"), 3).alias("t")).collect()
    assert [r["t"] for r in cut] == ["šab...", "šab", None]


def test_run(spark):
    class Fake:
        """Leaves the second of a batch out, fails on a batch about x, and singly answers 1, or nothing for d3."""

        def answer(self, rubric, prompt):
            ids = [line.split(": ")[1] for line in prompt.splitlines() if "doc_id: " in line]
            if len(ids) > 1:
                if "Search: x" in prompt:
                    raise RuntimeError
                return json.dumps([{"doc_id": d, "grade": 3} for k, d in enumerate(ids) if k != 1])
            return "no idea" if ids == ["d3"] else json.dumps({"doc_id": ids[0], "grade": 1})

    pooled = spark.createDataFrame([("q", f"d{i}") for i in range(5)] + [("r", "d1"), ("r", "d3"), ("q", "gone"), ("q", "d0")], "query_id string, doc_id string")
    articles = spark.createDataFrame([(f"d{i}", "t", None, "c") for i in range(5)] + [("d1", "t", None, "c")], "id string, title string, description string, content string")
    kept = spark.createDataFrame([("q", "d4", 0), ("q", "other", 3)], "query_id string, doc_id string, grade int")
    texts = {"q": "y", "r": "x"}

    def judge(df):
        return J.model_judge(Fake(), 2)(df.withColumn("query_text", F.when(F.col("query_id") == "q", texts["q"]).otherwise(texts["r"])))

    got = {(r["query_id"], r["doc_id"]): r["grade"] for r in J.run(pooled, articles, judge, kept).collect()}
    assert got == {("q", "d0"): 3, ("q", "d1"): 1, ("q", "d2"): 3, ("q", "d3"): -1, ("q", "d4"): 0, ("r", "d1"): 1, ("r", "d3"): -1, ("q", "gone"): -1}


def test_kept_by_query(spark, tmp_path):
    path = str(tmp_path / "grades")
    one = spark.createDataFrame([("q", "a", 1), ("r", "a", 1)], "query_id string, doc_id string, grade int")
    J.save_grades(one, path)
    J.save_grades(spark.createDataFrame([("q", "b", 2)], one.schema), path)
    assert {tuple(r) for r in spark.read.parquet(path).select("query_id", "doc_id", "grade").collect()} == {("q", "b", 2), ("r", "a", 1)}
    J.check_resumable(J.JudgeName("bm25"), J.JudgeName("bm25"))
    with pytest.raises(ValueError):
        J.check_resumable(J.JudgeName("model", "x", "m1", "v1"), J.JudgeName("model", "x", "m1", "v2"))
