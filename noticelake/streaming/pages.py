"""Pages as they arrive: a file stream, each address once within the watermark, through the same block parser."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from noticelake.operators.html import page_blocks

SCHEMA = "page_id bigint, url string, html string, fetched_at timestamp"


def arriving(spark: SparkSession, folder: str, delay: str = "1 hour", files_per_trigger: int = 100) -> DataFrame:
    """New Parquet files of pages; a page that comes again within the delay is dropped, and state older than that is let go."""
    stream = spark.readStream.schema(SCHEMA).option("maxFilesPerTrigger", files_per_trigger).parquet(folder)
    return stream.withWatermark("fetched_at", delay).dropDuplicatesWithinWatermark(["url"])


def block_stream(spark: SparkSession, folder: str, out: str, checkpoint: str, delay: str = "1 hour"):
    """Start writing the blocks of arriving pages; exactly once by the file sink's log."""
    blocks = page_blocks(arriving(spark, folder, delay)).withColumn("written_at", F.current_timestamp())
    return blocks.writeStream.format("parquet").option("path", out).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
