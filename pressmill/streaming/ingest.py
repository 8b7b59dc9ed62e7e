"""Streaming ingest: files of raw records that arrive in a folder are parsed and appended in micro-batches.

Each batch is written to its own folder by number, so a batch that is repeated after a failure replaces itself.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from pressmill.sources.records import parse_records

RAW = "record_id long, dataset string, fmt string, batch string, line_no long, raw string"


def ingest(spark: SparkSession, source: str, target: str, mappings: DataFrame, checkpoint: str, available_now: bool = True):
    """Starts the query: loaded records go to target/loaded, the others with their reason to target/rejected."""

    def write(df: DataFrame, number: int) -> None:
        parsed = parse_records(df, mappings).persist()
        try:
            parsed.where("reason IS NULL").drop("reason").write.mode("overwrite").parquet(f"{target}/loaded/part={number}")
            parsed.where("reason IS NOT NULL").drop("fields").write.mode("overwrite").parquet(f"{target}/rejected/part={number}")
        finally:
            parsed.unpersist()

    w = spark.readStream.schema(RAW).parquet(source).writeStream.foreachBatch(write).option("checkpointLocation", checkpoint)
    return (w.trigger(availableNow=True) if available_now else w).start()
