"""Readers and writers of the file formats: CSV, JSON lines and Parquet as all-text records, grades as TREC lines, canonical articles."""

from __future__ import annotations

import json
import os
import tempfile

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from pressmill.sources.records import _csv_fields, json_fields, raw_records


LONGEST_LINE = 10 * 1024 * 1024


def read_csv(spark: SparkSession, path: str) -> DataFrame:
    """All columns as text, by the first line's names; records that break quoting or width keep their raw form in _corrupt. Files are read in splits."""
    first = spark.read.option("lineSep", "\n").text(path).limit(1).collect()
    names = (_csv_fields([first[0]["value"].removesuffix("\r")])[0] if first else None) or []
    if not names:
        return spark.createDataFrame([], "_corrupt string")

    def cells(batches):
        for g in batches:
            rows = [c if c is not None and len(c) == len(names) else None for c in _csv_fields(g["raw"].tolist())]
            yield pd.DataFrame({**{f"c{k}": [r and r[k] for r in rows] for k in range(len(names))}, "_corrupt": [None if r else x for r, x in zip(rows, g["raw"])]})

    kept = raw_records(spark, path, len(names)).where("raw <> ''").select("raw")
    out = kept.mapInPandas(cells, ", ".join([*(f"c{k} string" for k in range(len(names))), "_corrupt string"]))
    return out.toDF(*names, "_corrupt")


def read_jsonl(spark: SparkSession, path: str, keys: list[str] | None = None) -> DataFrame:
    """One object a line as (fields map<string,string>, _corrupt), or a column for each of keys: null values are absent, others their text.

    Blank lines are skipped; a line that isn't one object, or is longer than LONGEST_LINE bytes, keeps its (cut) raw form in _corrupt.
    """
    lines = spark.read.text(path).where(~F.col("value").rlike("^\\s*\\z"))

    def fields(batches):
        for g in batches:
            got = [json_fields(x) if len(x.encode("utf-8", "surrogatepass")) <= LONGEST_LINE else None for x in g["value"]]
            yield pd.DataFrame({"fields": got, "_corrupt": [None if f is not None else x[:1000] for f, x in zip(got, g["value"])]})

    out = lines.mapInPandas(fields, "fields map<string,string>, _corrupt string")
    return out if keys is None else out.select(*[F.col("fields")[k].alias(k) for k in keys], "_corrupt")


def flattened(df: DataFrame) -> DataFrame:
    """Every leaf column as text under its dotted name; repeated values joined by commas."""

    def leaves(kind: T.StructType, path: str, name: str):
        for f in kind.fields:
            here, shown = f"{path}`{f.name}`", f"{name}{f.name}"
            if isinstance(f.dataType, T.StructType):
                yield from leaves(f.dataType, here + ".", shown + ".")
            elif isinstance(f.dataType, T.ArrayType):
                yield F.array_join(F.col(here).cast("array<string>"), ",").alias(shown)
            elif isinstance(f.dataType, T.MapType):
                yield F.to_json(F.col(here)).alias(shown)
            else:
                yield F.col(here).cast("string").alias(shown)

    return df.select(*leaves(df.schema, "", ""))


def canonical(articles: DataFrame) -> DataFrame:
    """The flat interchange record: all text, times as RFC 3339, empty values left out."""
    time = lambda c: F.date_format(c, "yyyy-MM-dd'T'HH:mm:ss.SSSSSS'Z'")
    full = lambda c: F.when(F.length(c) > 0, c)
    text = [full(F.col(c)).alias(c) for c in ("id", "title", "subtitle", "content", "author", "description", "url", "language", "published_at")]
    meta = [full(F.col(f"metadata.{a}")).alias(b) for a, b in (("source_id", "source_id"), ("source_name", "source_name"), ("category", "category"))]
    return articles.select(*text, time("created_at").alias("created_at"), *meta, time("metadata.imported_at").alias("imported_at"))


def write_canonical(articles: DataFrame, path: str, form: str = "json") -> None:
    """JSON lines without null keys, or Parquet."""
    w = canonical(articles).write.mode("overwrite")
    (w.option("ignoreNullFields", "true").json if form == "json" else w.parquet)(path)


def with_defaults(articles: DataFrame) -> DataFrame:
    """Load defaults: an id from the url or title if there is none, language english, created and imported now."""
    own = F.coalesce(F.when(F.length("id") > 0, F.col("id")), F.sha1(F.coalesce("url", "title", F.lit(""))))
    out = articles.withColumn("id", own).withColumn("language", F.coalesce("language", F.lit("english"))).withColumn("created_at", F.coalesce("created_at", F.current_timestamp()))
    if "metadata" in articles.columns:
        out = out.withColumn("metadata", F.coalesce("metadata", F.struct(*[F.lit(None).cast(f.dataType).alias(f.name) for f in articles.schema["metadata"].dataType.fields])).withField("imported_at", F.coalesce("metadata.imported_at", F.current_timestamp())))
    return out


def load(articles: DataFrame, path: str) -> None:
    """Appends articles with their defaults to the table at path."""
    with_defaults(articles).write.mode("append").parquet(path)


def qrels_lines(qrels: DataFrame) -> DataFrame:
    """A TREC line per grade: query, 0, document, grade; unjudged documents are left out."""
    return qrels.where("grade >= 0").select(F.concat_ws(" ", "query_id", F.lit("0"), "doc_id", F.col("grade").cast("string")).alias("line"))


def parse_qrels(lines: DataFrame) -> DataFrame:
    """(query_id, doc_id, grade, bad): blank lines and comments are skipped, a line without four fields or a whole grade is bad."""
    p = F.split(F.trim("value"), r"\s+")
    rows = lines.where((F.trim("value") != "") & ~F.trim("value").startswith("#")).select(p.alias("p"), F.get(p, F.lit(3)).try_cast("int").alias("grade"))
    bad = (F.size("p") != 4) | F.col("grade").isNull()
    return rows.select(F.col("p")[0].alias("query_id"), F.get("p", F.lit(2)).alias("doc_id"), "grade", bad.alias("bad"))


def nested_sample(rows: DataFrame, key: str, n: int) -> DataFrame:
    """The n rows with the smallest hash of their key: the same on every run, and smaller samples lie within larger ones."""
    return rows.orderBy(F.xxhash64(key), key).limit(n)


def corpus_slice(rows: DataFrame, key: str, n: int | None = None, way: str = "nested", seed: int = 42) -> DataFrame:
    """All rows, the first n in order of key ("head"), a sample of n by hash of key and seed ("random"), or one that lies within larger ones ("nested")."""
    if n is None:
        return rows
    order = {"head": [F.col(key)], "random": [F.xxhash64(F.lit(seed), key), F.col(key)], "nested": [F.xxhash64(key), F.col(key)]}
    return rows.orderBy(*order[way]).limit(n)


def normalize_url(url: Column) -> Column:
    """An absolute http(s) URL with a host, trimmed; else empty."""
    u = F.trim(url)
    ok = F.lower(F.try_parse_url(u, F.lit("PROTOCOL"))).isin("http", "https") & (F.length(F.try_parse_url(u, F.lit("HOST"))) > 0)
    return F.when(ok, u).otherwise("")


def write_atomically(path: str, value: dict) -> None:
    """JSON artifact, replaced in one step."""
    d = os.path.dirname(os.path.abspath(path))
    handle, tmp = tempfile.mkstemp(dir=d)
    with os.fdopen(handle, "w") as f:
        json.dump(value, f, indent=1, sort_keys=True)
        f.flush()
        os.fsync(f.fileno())
    os.replace(tmp, path)


def read_artifact(path: str, version: int = 1) -> dict:
    with open(path) as f:
        got = json.load(f)
    if got.get("schema_version") != version:
        raise ValueError(f"{path}: schema_version must be {version}")
    return got
