import random

import pytest

from pressmill.sources import records as R


def slow_csv(s):
    """One character at a time."""
    if s.endswith("\n"):
        s = s[:-1]
        s = s[:-1] if s.endswith("\r") else s
    out, i, n = [], 0, len(s)
    while True:
        b = ""
        if i < n and s[i] == '"':
            i += 1
            while True:
                if i >= n:
                    return None
                if s[i] == '"':
                    if i + 1 < n and s[i + 1] == '"':
                        b, i = b + '"', i + 2
                        continue
                    i += 1
                    break
                b, i = b + s[i], i + 1
            if i < n and s[i] != ",":
                return None
        else:
            while i < n and s[i] != ",":
                if s[i] in '"\r\n':
                    return None
                b, i = b + s[i], i + 1
        out.append(b)
        if i >= n:
            return out
        i += 1


def test_structural_index_equals_state_machine():
    rng = random.Random(1)
    raws = ["".join(rng.choice('a",\n"é,') for _ in range(rng.randint(0, 12))) for _ in range(5000)]
    assert R._csv_fields(raws) == [slow_csv(r) for r in raws]
    assert R._csv_fields([None, ""]) == [None, [""]]


@pytest.mark.parametrize(
    ("value", "kind", "ok"),
    [
        ("12", "int", True), ("+7", "int", True), ("12.5", "int", False), ("0x1F", "int", False), ("99999999999999999999", "int", False), (" 1", "int", False),
        ("1e3", "float", True), ("nan", "float", True), ("1e999", "float", False), ("0x1p-2", "float", True), ("abc", "float", False),
        ("T", "bool", True), ("TRUE", "bool", True), ("yes", "bool", False), ("2", "bool", False),
        ("2023-10-30 10:12:35.000000", "datetime", True), ("2023-11-27 16:52:44", "datetime", True), ("2018-01-02T03:04:05+02:00", "datetime", True),
        ("2022-05-04", "datetime", False), ("2021-02-30 10:00:00", "datetime", False), ("2019-07-08 24:61:00", "datetime", False), ("0001-01-01T00:00:00Z", "datetime", False),
        ("2022-05-04", "date", True), ("2022-02-29", "date", False),
        ("zz2a91c4-77d0-4b1e-9c55-0a1b2c3d4e5f", "uuid", False), ("{3f2a91c4-77d0-4b1e-9c55-0a1b2c3d4e5f}", "uuid", True), ("3f2a91c477d04b1e9c550a1b2c3d4e5f", "uuid", True),
        ("http://h.example/a b", "url", True), ("ftp://h.example/a", "url", False), ("http:///path", "url", False), ("/local", "url", False), ("http://a b/", "url", False),
        ("http://h:x/", "url", False), ("http://h/%zz", "url", False), ("x", "thing", False),
    ],
)
def test_types(value, kind, ok):
    assert (R.convert(value, kind) is not None) == ok


def test_reasons(spark):
    m = [("c", "csv", 1, "title", "string", "Title", True), ("c", "csv", 2, "n", "int", "Extra.n", True), ("c", "csv", 3, "u", "url", "URL", False), ("j", "jsonl", 1, "title", "string", "Title", True), ("j", "jsonl", 2, "u", "url", "URL", True)]
    mapping = spark.createDataFrame(m, "dataset string, fmt string, pos int, source_field string, source_type string, target_field string, required boolean")
    raws = [
        ("c", "csv", "a,1,", None), ("c", "csv", "a,1", "read_failed"), ("c", "csv", 'a"b,1,', "read_failed"), ("c", "csv", " ,1,", "empty_required_value/Title"), ("c", "csv", "a,x,", "conversion_failed/Extra.n"),
        ("c", "csv", '"a\n""b""",2,not a url\n', None), ("c", "csv", None, "read_failed"), ("c", "csv", "", "read_failed"), ("other", "csv", "a", "read_failed"), ("c", "csv", "a,1,\nb,2,", "read_failed"),
        ("j", "jsonl", '{"title": 5, "u": "http://h/"}', None), ("j", "jsonl", '{"title": null, "u": "http://h/"}', "missing_source_column/Title"), ("j", "jsonl", '{"title": "a"}', "missing_source_column/URL"),
        ("j", "jsonl", '{"title": "a", "u": "x"}', "conversion_failed/URL"), ("j", "jsonl", "[]", "read_failed"), ("j", "jsonl", '{"title": NaN}', "read_failed"), ("j", "jsonl", '{"title": "a"} {}', "read_failed"), ("j", "jsonl", "", "read_failed"),
    ]
    df = spark.createDataFrame([(i, a, b, "b1", r, "z") for i, (a, b, r, _) in enumerate(raws)], "record_id long, dataset string, fmt string, batch string, raw string, reason string")
    got = R.parse_records(df, mapping).orderBy("record_id").collect()
    assert [r["reason"] for r in got] == [x[3] for x in raws]
    assert got[5]["fields"] == {"Title": 'a\n"b"', "Extra.n": "2"} and got[10]["fields"]["Title"] == "5"
    report = {r["dataset"]: r for r in R.preprocess_report(R.parse_records(df, mapping)).collect()}
    assert report["c"]["total_records"] == 9 and report["c"]["processed_records"] == 2 and report["c"]["drops"]["read_failed"] == 5
    assert R.parse_records(df.limit(0), mapping).count() == 0
    assert R.parse_records(df, mapping.limit(0)).where("reason = 'read_failed'").count() >= 10
