"""Judges that grade pooled documents by rule: lexical overlap, BM25 over each query's pool, vectors, and a mix.

pooled(query_id, doc_id, query_text, title, description, content [, embedding, query_vector]) to (query_id, doc_id, grade).
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from pressmill.functions import text as T

K1, B = 1.5, 0.75


def _steps(x: Column, *bounds: float) -> Column:
    """3, 2 or 1 for the first bound reached, else 0."""
    return F.when(x >= bounds[0], 3).when(x >= bounds[1], 2).when(x >= bounds[2], 1).otherwise(0)


def lexical(pooled: DataFrame) -> DataFrame:
    """Half of the terms in the title: 3; half anywhere: 2; a quarter: 1. A query without terms grades nothing."""
    body = F.concat_ws(" ", "description", "content")
    q = pooled.select("query_id", "doc_id", T.judge_terms(F.col("query_text")).alias("q"), F.array_distinct(T.judge_tokens(F.col("title"))).alias("t"), F.array_distinct(T.judge_tokens(body)).alias("b"))
    title, other = F.size(F.array_intersect("q", "t")), F.size(F.array_intersect("q", F.array_except("b", "t")))
    n = F.size("q")
    grade = F.when(title / n >= 0.5, 3).when((title + other) / n >= 0.5, 2).when((title + other) / n >= 0.25, 1).otherwise(0)
    return q.where(n > 0).select("query_id", "doc_id", grade.alias("grade"))


def bm25_scores(pooled: DataFrame) -> DataFrame:
    """(query_id, doc_id, score, norm): BM25 with the query's pool as the corpus; norm is relative to the pool's best."""
    text = F.concat_ws(" ", "title", "description", "content")
    d = pooled.select("query_id", "doc_id", T.judge_terms(F.col("query_text")).alias("q"), T.judge_tokens(text).alias("toks")).withColumn("dl", F.size("toks"))
    per_query = d.groupBy("query_id").agg(F.count("*").alias("n"), F.avg("dl").alias("avgdl"))
    tf = d.select("query_id", "doc_id", "dl", F.explode("q").alias("term"), "toks")
    tf = tf.withColumn("tf", F.size(F.filter("toks", lambda t: t == F.col("term")))).drop("toks").where("tf > 0")
    df = tf.groupBy("query_id", "term").agg(F.count("*").alias("df"))
    parts = tf.join(df, ["query_id", "term"]).join(per_query, "query_id")
    idf = F.log(1 + (F.col("n") - F.col("df") + 0.5) / (F.col("df") + 0.5))
    part = idf * F.col("tf") * (K1 + 1) / (F.col("tf") + K1 * (1 - B + B * F.col("dl") / F.col("avgdl")))
    # added in the order of the terms, so that equal documents get equal sums
    ordered = F.sort_array(F.collect_list(F.struct("term", part.alias("part"))))
    sums = parts.groupBy("query_id", "doc_id").agg(F.aggregate(ordered, F.lit(0.0), lambda s, x: s + x["part"]).alias("score"))
    best = sums.groupBy("query_id").agg(F.max("score").alias("best"))
    out = d.select("query_id", "doc_id").join(sums, ["query_id", "doc_id"], "left").join(best, "query_id", "left")
    score = F.coalesce("score", F.lit(0.0))
    return out.select("query_id", "doc_id", score.alias("score"), F.when(F.col("best") > 0, score / F.col("best")).otherwise(0.0).alias("norm"))


def _rounded(x: Column) -> Column:
    return F.floor(x * 1e6 + 0.5) / 1e6


def bm25(pooled: DataFrame) -> DataFrame:
    return bm25_scores(pooled).select("query_id", "doc_id", _steps(_rounded(F.col("norm")), 0.66, 0.40, 0.15).alias("grade"))


def vector(pooled: DataFrame) -> DataFrame:
    """By cosine; documents or queries without a vector stay ungraded."""
    c = _rounded(T.cosine(F.col("embedding"), F.col("query_vector")))
    return pooled.where("embedding IS NOT NULL AND query_vector IS NOT NULL").select("query_id", "doc_id", _steps(c, 0.70, 0.55, 0.40).alias("grade"))


def hybrid(pooled: DataFrame) -> DataFrame:
    """Half the pool's BM25, half the cosine where positive."""
    c = F.greatest(T.cosine(F.col("embedding"), F.col("query_vector")), F.lit(0.0))
    with_vector = pooled.where("embedding IS NOT NULL AND query_vector IS NOT NULL").select("query_id", "doc_id", c.alias("c"))
    mixed = bm25_scores(pooled).join(with_vector, ["query_id", "doc_id"]).withColumn("x", _rounded(0.5 * F.col("norm") + 0.5 * F.col("c")))
    return mixed.select("query_id", "doc_id", _steps(F.col("x"), 0.66, 0.40, 0.15).alias("grade"))


def manual(pooled: DataFrame) -> DataFrame:
    """Leaves every document to a person."""
    return pooled.select("query_id", "doc_id", F.lit(-1).alias("grade"))


def remaining(pooled: DataFrame, graded: DataFrame) -> DataFrame:
    """What a judge that is resumed still has to grade."""
    return pooled.join(graded.select("query_id", "doc_id"), ["query_id", "doc_id"], "left_anti")
