import csv
import io
import random

import pytest

from pressmill.sources import files, mappings, records


def write(path, rows, quote=csv.QUOTE_MINIMAL):
    out = io.StringIO()
    csv.writer(out, lineterminator="\n", quoting=quote).writerows(rows)
    path.write_text(out.getvalue())
    return out.getvalue()


@pytest.fixture()
def tiny_splits(spark):
    keys = {"spark.sql.files.maxPartitionBytes": "400", "spark.sql.files.openCostInBytes": "0", "spark.sql.files.minPartitionNum": "1"}
    for k, v in keys.items():
        spark.conf.set(k, v)
    yield
    for k in keys:
        spark.conf.unset(k)


def test_splits_anywhere(spark, tmp_path, tiny_splits):
    """Values over several lines, some longer than several splits, in two files."""
    rng = random.Random(6)
    value = lambda: rng.choice(["a", "", 'say "x"', "two\nlines", "z" * 30, "\n".join(["part"] * rng.choice([1, 3, 60])), "č,š"])
    want = []
    for name in ("a", "b"):
        rows = [[str(i), value(), value()] for i in range(90)]
        write(tmp_path / f"{name}.csv", [["id", "t", "c"], *rows], rng.choice([csv.QUOTE_MINIMAL, csv.QUOTE_ALL]))
        want += rows
    got = files.read_csv(spark, str(tmp_path))
    assert got.rdd.getNumPartitions() > 5
    rows = got.collect()
    assert all(r["_corrupt"] is None for r in rows)
    assert sorted([r["id"], r["t"], r["c"]] for r in rows) == sorted(want)


def test_open_quote_costs_one_record(spark, tmp_path, tiny_splits):
    """The records behind an open quote load; the same for a wrong width and a quote inside a bare value."""
    lines = ["id,t"] + [f"{i},value {i}" for i in range(200)]
    lines[50], lines[90], lines[130] = '49,"open', "89,a,b", '129,a"b'
    (tmp_path / "x.csv").write_text("\n".join(lines) + "\n")
    rows = files.read_csv(spark, str(tmp_path / "x.csv")).collect()
    bad = [r["_corrupt"] for r in rows if r["_corrupt"] is not None]
    assert sorted(bad) == ['129,a"b', '49,"open', "89,a,b"]
    assert {r["id"] for r in rows if r["_corrupt"] is None} == {str(i) for i in range(200)} - {"49", "89", "129"}


def test_small_files(spark, tmp_path):
    (tmp_path / "e.csv").write_text("")
    assert files.read_csv(spark, str(tmp_path / "e.csv")).count() == 0
    (tmp_path / "h.csv").write_text("a,b\n")
    assert files.read_csv(spark, str(tmp_path / "h.csv")).columns == ["a", "b", "_corrupt"] and files.read_csv(spark, str(tmp_path / "h.csv")).count() == 0
    (tmp_path / "o.csv").write_text('a\r\n"x\r\ny"\r\n\r\nz\r\n')
    assert [r["a"] for r in files.read_csv(spark, str(tmp_path / "o.csv")).orderBy("a").collect()] == ["x\r\ny", "z"]
    (tmp_path / "j.jsonl").write_text('{"a": 1.5, "b": [1, "x"], "c": null}\n\n  \n[1]\n{"a": true}\n')
    got = files.read_jsonl(spark, str(tmp_path / "j.jsonl")).collect()
    assert [r["fields"] for r in got] == [{"a": "1.5", "b": "[1 x]"}, None, {"a": "true"}] and got[1]["_corrupt"] == "[1]"


def test_raw_files_to_articles(spark, tmp_path):
    """A file with good and bad records through the parser with its reasons."""
    write(tmp_path / "f.csv", [["t", "n"], ["one", "5"], ["two", "x"], ["", "1"], ["three", "1", "2"]])
    raw = records.raw_records(spark, str(tmp_path / "f.csv"), 2)
    rows = raw.selectExpr("seq AS record_id", "'d' AS dataset", "'csv' AS fmt", "file AS batch", "raw")
    rules = mappings.mapping_of({"kind": "x", "version": "v1", "metadata": {"name": "n"}, "dataset": "d", "fieldMappings": [{"source": "t", "target": "Title", "required": True}, {"source": "n", "sourceType": "int", "target": "Metadata.Extra.n", "required": True}]})
    m = spark.createDataFrame(rules, "dataset string, fmt string, pos int, source_field string, source_type string, target_field string, required boolean")
    got = {r["record_id"]: r["reason"] for r in records.parse_records(rows, m).collect()}
    assert got == {0: None, 1: "conversion_failed/Metadata.Extra.n", 2: "empty_required_value/Title", 3: "read_failed"}
    bad = m.selectExpr("dataset", "fmt", "pos", "source_field", "source_type", "'Nope' AS target_field", "required")
    with pytest.raises(ValueError, match="unknown target"):
        records.parse_records(rows, bad, guarded=True)
    with pytest.raises(ValueError, match="were dropped"):
        records.parse_records(rows.where("record_id > 0"), m, guarded=True)
    with pytest.raises(ValueError, match="no kind.*no name"):
        mappings.mapping_of({"version": "v1", "dataset": "d"})


def test_slices_and_defaults(spark, tmp_path):
    rows = spark.createDataFrame([(f"u{i:03}",) for i in range(50)], "url string")
    assert files.corpus_slice(rows, "url").count() == 50 and [r[0] for r in files.corpus_slice(rows, "url", 3, "head").collect()] == ["u000", "u001", "u002"]
    small, large = ({r[0] for r in files.corpus_slice(rows, "url", n).collect()} for n in (5, 20))
    assert small < large and {r[0] for r in files.corpus_slice(rows, "url", 5, "random", 1).collect()} != {r[0] for r in files.corpus_slice(rows, "url", 5, "random", 2).collect()}
    schema = "id string, title string, url string, language string, created_at timestamp, metadata struct<source_id: string, imported_at: timestamp>"
    df = spark.createDataFrame([(None, "t", "u", None, None, None), ("x", "t", None, "de", None, ("s", None))], schema)
    files.load(df, str(tmp_path / "t"))
    files.load(df, str(tmp_path / "t"))
    got = spark.read.parquet(str(tmp_path / "t"))
    assert got.count() == 4 and got.where("created_at IS NULL OR metadata.imported_at IS NULL OR language IS NULL OR id IS NULL").count() == 0
