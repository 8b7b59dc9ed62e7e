"""Validation and bulk upsert of vectors, and lookups by id."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

UUID = "^[0-9a-fA-F]{8}(-[0-9a-fA-F]{4}){3}-[0-9a-fA-F]{12}$"


def validation(rows: DataFrame, dim: int = 64) -> DataFrame:
    """One row: total, bad ids, null vectors, vectors of another length, and rows to load."""
    ok_id, null, length = F.col("article_id").rlike(UUID), F.col("embedding").isNull(), F.size("embedding") != dim
    ok_id = F.coalesce(ok_id, F.lit(False))
    return rows.agg(
        F.count("*").alias("total"), F.count_if(~ok_id).alias("bad_ids"), F.count_if(ok_id & null).alias("null_vectors"),
        F.count_if(ok_id & ~null & length).alias("bad_dim"), F.count_if(ok_id & ~null & ~length).alias("to_load"),
    )


def valid(rows: DataFrame, dim: int = 64) -> DataFrame:
    return rows.where(F.col("article_id").rlike(UUID) & F.col("embedding").isNotNull() & (F.size("embedding") == dim))


def upsert(current: DataFrame, batch: DataFrame, articles: DataFrame) -> DataFrame:
    """The table after the batch: one row per article and model, the batch's latest over the current; orphans are skipped."""
    keys = ["article_id", "model_name"]
    last = Window.partitionBy(*keys).orderBy(F.desc("created_at"), F.desc("id"))
    new = batch.withColumn("r", F.row_number().over(last)).where("r = 1").drop("r").join(articles.select(F.col("id").alias("article_id")).distinct(), "article_id", "left_semi")
    return current.join(new, keys, "left_anti").select(*batch.columns).unionByName(new.select(*batch.columns))


def orphans(batch: DataFrame, articles: DataFrame) -> DataFrame:
    return batch.join(articles.select(F.col("id").alias("article_id")).distinct(), "article_id", "left_anti")


def by_ids(rows: DataFrame, ids: DataFrame, key: str = "id") -> DataFrame:
    """Rows of the given ids; an empty list gives an empty result."""
    return rows.join(ids.select(F.col("id").alias(key)).distinct(), key, "left_semi")
