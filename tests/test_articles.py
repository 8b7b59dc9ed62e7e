from datetime import datetime, timedelta

import pytest
from pyspark.sql import functions as F

from pressmill.operators import articles as A
from pressmill.plans import evaluation_queries


def test_mapping_faults():
    ok = {"source_field": "a", "target_field": "Title"}
    assert A.mapping_faults([ok, {"source_field": "w", "target_field": "Metadata.Extra.words"}]) == []
    assert len(A.mapping_faults([{"source_field": "", "target_field": "Title"}, {"source_field": "a", "target_field": "Nope"}, {"source_field": "a", "target_field": "Metadata.PublishedAt"}, {"source_field": "a", "target_field": "Metadata.Extra."}])) == 4
    assert A.mapping_faults([])


def test_articles(spark, tmp_path):
    schema = "record_id long, reason string, fields map<string,string>"
    rows = [(1, None, {"ID": "x", "Title": "t", "PublishedAt": "2018-01-02T03:04:05+02:00", "Metadata.Category": "c", "Metadata.Extra.words": "5"}), (2, "read_failed", None), (3, None, {"Title": "u", "PublishedAt": "2018-01-02 03:04:05"})]
    got = A.as_articles(spark.createDataFrame(rows, schema)).orderBy("title").collect()
    assert got[0]["id"] == "x" and got[0]["published_at"] == datetime(2018, 1, 2, 1, 4, 5) and got[0]["metadata"]["extra"] == {"words": "5"} and got[0]["metadata"]["category"] == "c"
    assert len(got[1]["id"]) == 40 and got[1]["published_at"] == datetime(2018, 1, 2, 3, 4, 5) and got[1]["language"] == "english"
    A.guard(spark.createDataFrame(rows, schema))
    with pytest.raises(ValueError):
        A.guard(spark.createDataFrame(rows[1:2], schema))
    base = A.bootstrap(spark, str(tmp_path / "t"))
    assert base.count() == 0 and A.bootstrap(spark, str(tmp_path / "t")).columns == base.columns
    new = A.as_articles(spark.createDataFrame(rows, schema))
    once = A.upsert(base, new)
    assert once.count() == 2 and A.upsert(once, new.withColumn("title", F.lit("z"))).where("title = 'z'").count() == 2
    c = spark.createDataFrame([("12812abd-31d6-4e36-a812-584bd0461200", "2020-01-01T00:00:00Z"), ("no", "x")], "id string, created_at string")
    got = A.from_canonical(c).collect()
    assert [r["bad"] for r in got] == [False, True] and got[0]["created_at"] == datetime(2020, 1, 1) and got[1]["created_at"] is not None


def test_datetime_fallbacks_take_offsets_and_long_fractions(spark, tmp_path):
    values = {
        "a": "2016-06-09T17:31:54+02:00", "b": "2019-01-24T22:11:35.732084150Z", "c": " 2019-01-24T22:11:35.5-05:30 ", "d": "2016-02-07T07:44:29", "e": "2018-09-07 19:46:52.625395", "f": "2018-09-07 19:46:52.1234567",
        "g": "2019-01-24T22:11:35+25:00", "h": "2019-02-30T22:11:35Z", "i": "2018-05-04 01:19:24 +0530", "j": "2018-05-04", "k": None, "l": "2018-05-04 01:19:24+05:30", "m": "2018-05-04T24:19:24Z",
    }
    spark.createDataFrame(list(values.items()), "id string, published_at string").write.parquet(str(tmp_path / "articles.parquet"))
    got = {r["id"]: r["us"] for r in evaluation_queries.datetime_fallbacks_all(spark, str(tmp_path)).collect()}
    us = lambda *a: (datetime(*a) - datetime(1970, 1, 1)) // timedelta(microseconds=1)
    assert got == {
        "a": us(2016, 6, 9, 15, 31, 54), "b": us(2019, 1, 24, 22, 11, 35, 732084), "c": us(2019, 1, 25, 3, 41, 35, 500000), "d": us(2016, 2, 7, 7, 44, 29),
        "e": us(2018, 9, 7, 19, 46, 52, 625395), "f": us(2018, 9, 7, 19, 46, 52, 123456),
    }
