"""From parsed records to article rows, canonical records back to rows, and loads that overwrite by id."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from pressmill.sources.mappings import EXTRA, mapping_faults

__all__ = ["as_articles", "bootstrap", "from_canonical", "guard", "mapping_faults", "parsed_time", "upsert"]

SCHEMA = (
    "id string, title string, subtitle string, content string, author string, description string, url string, language string, published_at timestamp, created_at timestamp, "
    "metadata struct<source_id: string, source_name: string, category: string, imported_at: timestamp, extra: map<string,string>>"
)


def parsed_time(text: Column) -> Column:
    """A timestamp of any of the accepted date and time layouts; local values are UTC."""
    return F.regexp_replace(F.regexp_replace(text, r"Z$", "+00:00"), r"^(\S+)T", "$1 ").try_cast("timestamp")


def as_articles(parsed: DataFrame) -> DataFrame:
    """Article rows of the records that load: (record_id, reason, fields) to SCHEMA; the id is the record's own, else a hash of url or title."""
    f = lambda k: F.col("fields")[k]
    own = F.coalesce(f("ID"), F.sha1(F.coalesce(f("URL"), f("Title"), F.col("record_id").cast("string"))))
    extra = F.map_filter(F.transform_keys("fields", lambda k, _: F.when(F.startswith(k, F.lit(EXTRA)), F.substring(k, F.lit(len(EXTRA) + 1), F.length(k))).otherwise(F.concat(F.lit("\u0000"), k))), lambda k, _: ~F.startswith(k, F.lit("\u0000")))
    return parsed.where("reason IS NULL").select(
        own.alias("id"), f("Title").alias("title"), f("Subtitle").alias("subtitle"), f("Content").alias("content"), f("Author").alias("author"), f("Description").alias("description"), f("URL").alias("url"),
        F.coalesce(f("Language"), F.lit("english")).alias("language"), parsed_time(f("PublishedAt")).alias("published_at"), parsed_time(f("CreatedAt")).alias("created_at"),
        F.struct(f("Metadata.SourceId").alias("source_id"), f("Metadata.SourceName").alias("source_name"), f("Metadata.Category").alias("category"), parsed_time(f("Metadata.ImportedAt")).alias("imported_at"), extra.alias("extra")).alias("metadata"),
    )


def guard(parsed: DataFrame) -> None:
    """Fails if there were records and not one of them loads."""
    r = parsed.agg(F.count("*").alias("total"), F.count_if(F.col("reason").isNull()).alias("loaded")).first()
    if r["total"] and not r["loaded"]:
        raise ValueError(f"all {r['total']} records were dropped")


def from_canonical(records: DataFrame) -> DataFrame:
    """Rows of flat canonical records: a bad id makes bad true, a bad creation time is now, other bad times are null."""
    names = set(records.columns)
    text = lambda c: F.col(c) if c in names else F.lit(None).cast("string")
    bad = ~F.coalesce(text("id").rlike("^[0-9a-fA-F]{8}(-[0-9a-fA-F]{4}){3}-[0-9a-fA-F]{12}$"), F.lit(False))
    return records.select(
        *[text(c).alias(c) for c in ("id", "title", "subtitle", "content", "author", "description", "url", "language")],
        parsed_time(text("published_at")).alias("published_at"), F.coalesce(parsed_time(text("created_at")), F.current_timestamp()).alias("created_at"),
        F.struct(*[text(c).alias(c) for c in ("source_id", "source_name", "category")], parsed_time(text("imported_at")).alias("imported_at")).alias("metadata"), bad.alias("bad"),
    )


def upsert(current: DataFrame, batch: DataFrame) -> DataFrame:
    """The table after the batch: rows of the batch replace those with the same id; of several in a batch the last created stays."""
    last = Window.partitionBy("id").orderBy(F.desc("created_at"), F.xxhash64(F.to_json(F.struct("title", "content"))))
    new = batch.withColumn("_r", F.row_number().over(last)).where("_r = 1").drop("_r")
    return current.join(new.select("id"), "id", "left_anti").unionByName(new, allowMissingColumns=True)


def bootstrap(spark: SparkSession, path: str, schema: str = SCHEMA) -> DataFrame:
    """The article table at path, created empty if there is none."""
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    if not p.getFileSystem(spark._jsc.hadoopConfiguration()).exists(p):
        spark.createDataFrame([], schema).write.parquet(path)
    return spark.read.schema(schema).parquet(path)
