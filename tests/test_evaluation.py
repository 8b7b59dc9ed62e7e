import pytest

from pressmill.operators import evaluation as V
from pressmill.operators import judging as J
from pressmill.sources import files


@pytest.fixture(scope="module")
def data(spark):
    runs = [("j", "q", "c", "e", i + 1, d, 1.0 / (i + 1), None) for i, d in enumerate("abc")] + [("j", "q", "c", "f", i + 1, d, 1.0, None) for i, d in enumerate("xba")]
    runs += [("j", "r", "d", "e", None, None, None, "failed"), ("j", "s", "d", "e", 1, "a", 1.0, None)]
    qrels = [("x", "q", "a", 1), ("x", "q", "b", 3), ("x", "q", "b", 3), ("x", "q", "c", 2), ("x", "q", "x", 0), ("x", "q", "y", -1)]
    return spark.createDataFrame(runs, "job string, query_id string, category string, engine string, rank int, doc_id string, score double, error string"), spark.createDataFrame(qrels, "judge string, query_id string, doc_id string, grade int")


def test_metrics(data):
    runs, qrels = data
    m = {(r["query_id"], r["engine"]): r for r in V.per_query(runs, V.grades(qrels)).collect()}
    assert set(m) == {("q", "e"), ("q", "f"), ("s", "e")}
    e, f = m["q", "e"], m["q", "f"]
    dcg, ideal = 1 / 1 + 7 / 1.584962500721156 + 3 / 2, 7 / 1 + 3 / 1.584962500721156 + 1 / 2
    assert e["ndcg_3"] == pytest.approx(dcg / ideal) and e["p_5"] == pytest.approx(3 / 5) and e["r_3"] == 1.0 and e["ap"] == 1.0 and e["rr"] == 1.0 and e["bpref"] == 1.0
    assert f["rr"] == 0.5 and f["ap"] == pytest.approx((1 / 2 + 2 / 3) / 3) and f["bpref"] == pytest.approx((2 / 3 + 2 / 3) / 3)
    assert not m["s", "e"]["judged"]
    two = V.per_query(runs, V.grades(qrels), threshold=2).where("query_id = 'q' AND engine = 'e'").first()
    assert two["ndcg_3"] == pytest.approx((7 / 1.584962500721156 + 3 / 2) / (7 + 3 / 1.584962500721156))
    a = {r["engine"]: r for r in V.aggregate(runs, V.per_query(runs, V.grades(qrels))).collect()}
    assert (a["e"]["queries"], a["e"]["errors"], a["e"]["judged"], a["f"]["judged"]) == (3, 1, 1, 1)


def test_misplaced_marginal(spark):
    runs = spark.createDataFrame([("j", "q", "c", "e", 1, "m", 1.0, None), ("j", "q", "c", "e", 2, "g", 1.0, None)], "job string, query_id string, category string, engine string, rank int, doc_id string, score double, error string")
    qrels = spark.createDataFrame([("x", "q", "g", 2), ("x", "q", "m", 1)], "judge string, query_id string, doc_id string, grade int")
    assert V.per_query(runs, V.grades(qrels), threshold=2).first()["ndcg_5"] == pytest.approx(0.6309297535714575)


def test_wilcoxon(spark):
    rows = [("j", f"q{i}", e, "c", True, v, v, v, v) for i in range(10) for e, v in (("a", 0.5 + 0.04 * (i + 1)), ("b", 0.5))]
    m = spark.createDataFrame(rows, "job string, query_id string, engine string, category string, judged boolean, ndcg_5 double, ndcg_10 double, ap double, rr double")
    got = V.wilcoxon(m).where("metric = 'ap'").first()
    assert got["n"] == 10 and got["w"] == 0 and V.stars(V.p_value(got["z"])) == "**"
    assert V.wilcoxon(m.where("query_id < 'q3'")).count() == 0


def test_pool_and_latency(spark, data):
    runs, _ = data
    pool = {(r["query_id"], r["doc_id"]): r["sources"] for r in V.pool(runs, 2).collect()}
    assert pool["q", "b"] == ["e", "f"] and ("q", "c") not in pool
    s = spark.createDataFrame([("k", x) for x in (10, 20, 30, 40)], "k string, ns long")
    r = V.latency(s, "k", "ns").first()
    assert (r["min"], r["max"], r["mean"], r["p50"], r["p99"]) == (10, 40, 25, 25, 39)


def test_judges(spark):
    rows = [("q", "1", "harbour strike council", "Harbour strike", None, "", [1.0, 0.0], [1.0, 0.0]), ("q", "2", "harbour strike council", "Other", "harbour", "strike", [0.0, 1.0], [1.0, 0.0]), ("q", "3", "harbour strike council", None, None, None, None, [1.0, 0.0])]
    p = spark.createDataFrame(rows, "query_id string, doc_id string, query_text string, title string, description string, content string, embedding array<float>, query_vector array<float>")
    by = lambda df: {r["doc_id"]: r["grade"] for r in df.collect()}
    assert by(J.lexical(p)) == {"1": 3, "2": 2, "3": 0}
    assert by(J.bm25(p))["3"] == 0 and by(J.vector(p)) == {"1": 3, "2": 0} and set(by(J.hybrid(p))) == {"1", "2"} and set(by(J.manual(p)).values()) == {-1}
    assert J.lexical(p.withColumn("query_text", p.query_text.substr(0, 0))).count() == 0


def test_files(spark, tmp_path):
    lines = spark.createDataFrame([("q 0 d 2",), ("# note",), ("",), ("q 0 d",), ("q 0 d x",)], "value string")
    assert [r["bad"] for r in files.parse_qrels(lines).collect()] == [False, True, True]
    (tmp_path / "a.csv").write_text('a,b\n1,"x\ny"\n2\n')
    got = files.read_csv(spark, str(tmp_path / "a.csv")).collect()
    assert got[0]["b"] == "x\ny" and got[1]["_corrupt"] is not None
    (tmp_path / "a.jsonl").write_text('{"a": 1, "b": null}\nbroken\n')
    got = files.read_jsonl(spark, str(tmp_path / "a.jsonl"), ["a", "b"]).collect()
    assert got[0]["a"] == "1" and got[0]["b"] is None and got[1]["_corrupt"] == "broken"
    files.write_atomically(str(tmp_path / "r.json"), {"schema_version": 1, "x": 2})
    assert files.read_artifact(str(tmp_path / "r.json"))["x"] == 2
    with pytest.raises(ValueError):
        files.read_artifact(str(tmp_path / "r.json"), 2)
