import pytest

from pressmill.plans import tracks as T


def test_tracks(tmp_path):
    for name in ("news/a", "news/b"):
        T.init(tmp_path / name, name)
    (tmp_path / "news/c").mkdir()
    with pytest.raises(ValueError, match="already"):
        T.init(tmp_path / "news/a", "a")
    assert [t.root.name for t in T.resolve("news/*", tmp_path)] == ["a", "b"]
    assert T.resolve("news/b", tmp_path)[0].root.name == "b"
    assert T.resolve(None, tmp_path / "news/a/trec")[0].root.name == "a"
    for where in ("news/c", "other/*"):
        with pytest.raises(ValueError, match="no track"):
            T.resolve(where, tmp_path)


def test_reports(tmp_path):
    t = T.init(tmp_path / "t", "t")
    assert T.status(t) == {"spec": True, "suite": True, "pool": False, "annotations": [], "reports": 0, "latest": None}
    with pytest.raises(ValueError, match="are needed"):
        T.latest_report(t)
    for run in ("20240101T000000Z-a", "20240103T000000Z-a", "20240102T000000Z-a"):
        T.save_report(t, {"schema_version": 1, "run_id": run})
    assert T.latest_report(t).stem == "20240102T000000Z-a" and T.latest_report(t, 1).stem == "20240102T000000Z-a" and T.latest_report(t, 2).stem == "20240101T000000Z-a"
    assert [p.stem[:8] for p in T.clean(t, 1)] == ["20240102", "20240101"] and T.status(t)["reports"] == 3
    T.clean(t, 1, dry=False)
    assert T.status(t)["reports"] == 1


def test_artifacts(spark):
    s = T.spec_of({"id": "s", "engines": [{"name": "a"}, "b"], "metrics": {"k_values": [1, 2], "relevance_threshold": 2}, "runs": {"warmup": 0, "iterations": 5}, "pool": {"depth": 50}})
    assert (s.engines, s.ks, s.threshold, s.warmup, s.runs, s.pool_depth) == (["a", "b"], (1, 2), 2, 0, 5, 50)
    assert T.spec_of({"id": "s"}).ks == (3, 5, 10)
    with pytest.raises(ValueError, match="once"):
        T.spec_of({"id": "s", "engines": ["a", "a"]})
    pool = {"queries": [{"query_id": "q", "docs": [{"doc_id": "1", "sources": ["b", "a"]}, {"doc_id": "2"}]}]}
    assert [tuple(r) for r in T.pool_of(spark, pool).collect()] == [("q", "1", ["a", "b"]), ("q", "2", [])]
    assert T.annotations_of(spark, {"queries": [{"query_id": "q", "docs": [{"doc_id": "1", "grade": -1}]}]}).count() == 1
    with pytest.raises(ValueError, match="from -1 to 3"):
        T.annotations_of(spark, {"queries": [{"query_id": "q", "docs": [{"doc_id": "1", "grade": 4}]}]})
    p = T.provenance(spec_id="s", suite_id=None, engines=[])
    assert set(p) == {"run_id", "tool", "generated_at", "spec_id"}
    df = spark.createDataFrame([(1,)], "n int")
    assert T.export(df, "markdown").startswith("| n |") and "<table>" in T.export(df, "html", "x") and T.export(df, "text").startswith("n")
    with pytest.raises(ValueError):
        T.export(df, "pdf")


def test_shown():
    assert T.masked("a" * 50) == "a" * 50 and T.masked("a" * 30 + "b" * 30) == "a" * 20 + "..." + "b" * 20
    assert [T.duration(x) for x in (0, 1500, 2_500_000, 3_210_000_000)] == ["-", "1.5µs", "2.50ms", "3.21s"]
