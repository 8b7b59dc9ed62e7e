import pyarrow as pa
import pyarrow.parquet as pq
import pytest

from pressmill.functions.embedding import HashingEmbedder
from pressmill.sources import vectors as V


def write(path, rows, **said):
    t = pa.table({"id": [r[0] for r in rows], "embedding": pa.array([r[1] for r in rows], pa.list_(pa.float32()))})
    pq.write_table(t.replace_schema_metadata({k: str(v) for k, v in said.items()}), path)


def test_files(spark, tmp_path):
    folder = tmp_path / "v"
    folder.mkdir()
    write(folder / "a.parquet", [("1", [1.0, 2.0])], model="m", dim=2, row_count=1, pooling="last")
    write(folder / "b.parquet", [("2", [3.0, 4.0]), ("3", None)], model="m", dim=2, row_count=2)
    f = V.read_vectors(spark, str(folder), "m", 2)
    assert (f.model, f.dim, f.declared["pooling"], f.rows.count()) == ("m", 2, "last", 3)
    for model, dim in (("other", None), (None, 3)):
        with pytest.raises(ValueError, match="declares"):
            V.read_vectors(spark, str(folder), model, dim)
    write(folder / "c.parquet", [("4", [1.0, 1.0])], model="m", row_count=7)
    with pytest.raises(ValueError, match="declares 7 rows"):
        V.read_vectors(spark, str(folder))
    write(tmp_path / "plain.parquet", [("1", [1.0])])
    assert V.read_vectors(spark, str(tmp_path / "plain.parquet"), "m").model == "m"


def test_resumed(spark, tmp_path):
    path = str(tmp_path / "out")
    rows = [("1", "t", "a b"), ("2", "t", "c"), ("2", "t", "c"), ("3", None, None)]
    df = spark.createDataFrame(rows, "id string, title string, content string")
    assert {r["id"] for r in V.embed_corpus(df.where("id = '1'"), HashingEmbedder(4), path, "h").collect()} == {"1"}
    files = {p.name for p in (tmp_path / "out").glob("*.parquet")}
    got = V.embed_corpus(df, HashingEmbedder(4), path, "h").collect()
    assert sorted(r["id"] for r in got) == ["1", "2"] and files <= {p.name for p in (tmp_path / "out").glob("*.parquet")}
    assert V.embed_corpus(df, HashingEmbedder(4), path, "h").count() == 2
