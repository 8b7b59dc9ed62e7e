"""Files of vectors with what they say about themselves, and embedding a corpus in batches that can be resumed."""

from __future__ import annotations

import glob
from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from pressmill.functions.embedding import Embedder, document_prompt

KEYS = ("model", "dim", "pooling", "normalized", "row_count", "created_at")


@dataclass(frozen=True)
class VectorFile:
    rows: DataFrame  # (id, embedding)
    model: str | None
    dim: int | None
    declared: dict[str, str]


def _footers(path: str) -> list:
    import pyarrow.parquet as pq

    return [pq.read_metadata(p) for p in sorted(glob.glob(f"{path}/*.parquet")) or [path]]


def read_vectors(spark: SparkSession, path: str, model: str | None = None, dim: int | None = None) -> VectorFile:
    """id and embedding of a Parquet file or folder, with the key/values of the footers; files that declare another model or length than asked for are an error.

    Only footers are read here. A declared row_count that isn't the footers' own sum is an error too.
    """
    footers = _footers(path)
    said = [{k.decode(): v.decode() for k, v in (f.metadata or {}).items() if k.decode() in KEYS} for f in footers]
    declared = {k: v for s in said for k, v in s.items() if k != "row_count"}
    for key, asked in (("model", model), ("dim", dim)):
        values = {s[key] for s in said if key in s}
        if len(values) > 1 or asked is not None and values - {str(asked)}:
            raise ValueError(f"{path} declares {key} {', '.join(sorted(values))}" + (f", not {asked}" if asked is not None else ""))
    for s, f in zip(said, footers):
        if "row_count" in s and int(s["row_count"]) != f.num_rows:
            raise ValueError(f"{path} declares {s['row_count']} rows and has {f.num_rows}")
    rows = spark.read.parquet(path).select(F.col("id").cast("string").alias("id"), F.col("embedding").cast("array<float>").alias("embedding"))
    return VectorFile(rows, declared.get("model", model), int(declared["dim"]) if "dim" in declared else dim, declared)


def embed_corpus(articles: DataFrame, embedder: Embedder, path: str, model: str, prompt: Callable = document_prompt) -> DataFrame:
    """Vectors of all articles that the table at ``path`` doesn't have yet, appended to it; the whole table.

    An interrupted run goes on where it stopped: what was written stays. Articles without tokens have no vector and are tried again.
    """
    spark = articles.sparkSession
    schema = "id string, embedding array<double>, model string"
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    there = p.getFileSystem(spark._jsc.hadoopConfiguration()).exists(p)
    todo = articles.select("id", "title", "content").dropDuplicates(["id"])
    if there:
        todo = todo.join(spark.read.schema(schema).parquet(path).where(F.col("model") == model).select("id"), "id", "left_anti")
    new = todo.select("id", embedder.embed(prompt(F.col("title"), F.col("content"))).alias("embedding"), F.lit(model).alias("model")).where("embedding IS NOT NULL")
    new.write.mode("append").parquet(path)
    return spark.read.schema(schema).parquet(path)
