"""Feed entries that arrive as files: a stream with late data bounded by a watermark. An addition to the batch operators."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F
from pyspark.sql.types import StructType


def landed(spark: SparkSession, folder: str, schema: StructType, files: int = 100) -> DataFrame:
    """Rows of Parquet files as they land in a folder."""
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", files).parquet(folder)


def unique_links(stream: DataFrame, at: str = "fetched_at", delay: str = "14 days") -> DataFrame:
    """The first arrival of each link within the watermark. Which copy that is follows arrival, not the batch order."""
    timed = stream.withColumn("_at", F.col(at).cast("timestamp")).withWatermark("_at", delay)
    return timed.dropDuplicatesWithinWatermark(["link"]).drop("_at")


def counts_by_window(stream: DataFrame, at: str = "fetched_at", size: str = "1 day", delay: str = "14 days") -> DataFrame:
    """(`start`, `source_name`, `n`) per window of time and source."""
    timed = stream.withColumn("_at", F.col(at).cast("timestamp")).withWatermark("_at", delay)
    return timed.groupBy(F.window("_at", size), "source_name").agg(F.count("*").alias("n")).select(F.col("window.start").alias("start"), "source_name", "n")
