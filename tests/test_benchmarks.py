import pytest

from pressmill.functions import embedding as E
from pressmill.plans import benchmarks as B
from pressmill.streaming import ingest as I


def test_templates():
    assert B.render("a {{x}} {{y}}", {"x": "{{y}}", "y": 2}) == "a 2 2"
    assert B.render("{{v}}", {"v": [0.1, 0.2, -0.3]}) == "[0.1,0.2,-0.3]"
    with pytest.raises(KeyError):
        B.render("{{z}}", {})
    with pytest.raises(KeyError):
        B.render("{{x}}", {"x": "{{x}}"})


def test_run(spark):
    spark.createDataFrame([("d1", 2), ("d2", 5)], "id string, n int").createOrReplaceTempView("bench_docs")
    raw = {"id": "s", "templates": [{"name": "t", "sql": "SELECT id FROM bench_docs WHERE n > {{n}} ORDER BY n DESC"}],
           "queries": [{"id": "q1", "category": "c", "engines": {"a": {"template": "t", "params": {"n": 1}}, "b": {"sql": "SELECT nothing"}}}, {"id": "q2", "engines": {"a": {"template": "t"}}}]}
    suite = B.suite_of(raw)
    assert B.validate(spark, suite, ["a", "b"]) == [("q1", "a", "OK"), ("q1", "b", "INVALID"), ("q2", "a", "TEMPLATE_ERR"), ("q2", "b", "SKIP")]
    runs, latency = B.run(spark, B.Spec("j", ["a", "b"]), suite)
    assert [r["doc_id"] for r in runs.where("query_id = 'q1' AND engine = 'a'").orderBy("rank").collect()] == ["d2", "d1"]
    assert runs.where("error IS NOT NULL").count() == 2 and latency.count() == 3
    t = spark.createDataFrame([("e<1>", 0.5), ("e2", None)], "engine string, ndcg double")
    assert "| e<1> | 0.5000 |" in B.as_markdown(t) and "e&lt;1&gt;" in B.as_html(t, "r", "ndcg") and B.as_json(t, "x")["rows"][1]["ndcg"] == "" and B.as_text(t).startswith("engine")


def test_embedder(spark):
    df = spark.createDataFrame([("a b a",), ("",), (None,)], "t string")
    got = [r[0] for r in df.select(E.HashingEmbedder(16).embed(df.t)).collect()]
    assert len(got[0]) == 16 and sum(x * x for x in got[0]) == pytest.approx(1) and got[1] is None and got[2] is None


def test_streaming_ingest(spark, tmp_path):
    m = spark.createDataFrame([("d", "csv", 1, "title", "string", "Title", True)], "dataset string, fmt string, pos int, source_field string, source_type string, target_field string, required boolean")
    rows = [(1, "d", "csv", "b", 1, "ok"), (2, "d", "csv", "b", 2, " ")]
    spark.createDataFrame(rows, I.RAW).write.parquet(str(tmp_path / "in"))
    I.ingest(spark, str(tmp_path / "in"), str(tmp_path / "out"), m, str(tmp_path / "cp")).awaitTermination(120)
    assert [r["record_id"] for r in spark.read.parquet(str(tmp_path / "out/loaded")).collect()] == [1]
    assert [r["reason"] for r in spark.read.parquet(str(tmp_path / "out/rejected")).collect()] == ["empty_required_value/Title"]


def test_sql_with_arguments_and_timeout(spark):
    assert B.run_sql(spark, "SELECT id FROM range(10) WHERE id > :least ORDER BY id", {"least": 7}) == [{"id": 8}, {"id": 9}]
    assert len(B.run_sql(spark, "SELECT id FROM range(10)", most=3)) == 3
    with pytest.raises(TimeoutError):
        B.run_sql(spark, "SELECT count(*) FROM range(100000000000) WHERE sqrt(id) + sin(id) < -2", timeout=1.0)
    with pytest.raises(Exception, match="nothing"):
        B.run_sql(spark, "SELECT * FROM nothing", timeout=5.0)


def test_statuses_of_vectors(spark):
    raw = {"id": "s", "queries": [{"id": "q", "engines": {"a": {"sql": "SELECT {{vector}} AS v", "embed": "text"}, "b": {"sql": "SELECT 1"}}}]}
    suite = B.suite_of(raw)
    broken = lambda text: 1 / 0
    assert [x[2] for x in B.validate(spark, suite, ["a", "b", "c"])] == ["EMBED_ERR", "OK", "SKIP"]
    assert [x[2] for x in B.validate(spark, suite, ["a", "b"], broken, ["a"])] == ["EMBED_ERR", "UNSUPPORTED"]
    assert B.resolve(suite, suite.queries[0], "a", B.vector_of(suite.queries[0], "a", lambda t: [1, 0.5])) == "SELECT [1,0.5] AS v"
