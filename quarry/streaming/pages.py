"""Incremental acquisition: pages that arrive as files are extracted, kept once a file key, and written batch by batch."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from quarry.functions import html as H
from quarry.functions import urls as U


def arriving(spark: SparkSession, folder: str, schema: str = "page_id long, url string, html string") -> DataFrame:
    return spark.readStream.schema(schema).parquet(folder)


def unique_pages(pages: DataFrame) -> DataFrame:
    """The first page of each file key: state holds keys alone."""
    return pages.withColumn("file_key", U.file_key(F.col("url"))).dropDuplicates(["file_key"])


def start(pages: DataFrame, out: str, checkpoint: str) -> StreamingQuery:
    """Extracted pages as Parquet; the checkpoint makes each file key appear exactly once, also over restarts."""
    found = H.extract(unique_pages(pages)).where("markdown is not null").drop("hrefs", "error")
    return found.writeStream.format("parquet").option("path", out).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def event_counts(events: DataFrame, width: str = "1 hour", late: str = "2 hours") -> DataFrame:
    """Events by type in tumbling windows; rows later than ``late`` are dropped."""
    return events.withWatermark("ts", late).groupBy(F.window("ts", width), "event_type").agg(F.count(F.lit(1)).alias("n")).select(F.col("window.start").alias("start"), "event_type", "n")
