"""Append-only ingest of page files as a stream; the engine's own extension."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from linework.operators.datasets import suffix
from linework.sources.files import IMAGE_SUFFIXES, RAW_SUFFIXES

FILES = "path string, modificationTime timestamp, length long, content binary"


def page_stream(spark: SparkSession, folder: str, per_trigger: int = 1000) -> DataFrame:
    """New page files of a folder as they arrive; each is read once."""
    files = spark.readStream.format("binaryFile").schema(FILES).option("maxFilesPerTrigger", per_trigger).load(folder)
    return files.where(suffix(F.col("path")).isin(*IMAGE_SUFFIXES, *RAW_SUFFIXES))


def arrivals(pages: DataFrame, width: str = "5 minutes", late: str = "10 minutes") -> DataFrame:
    """Files and bytes per window of modification time; later files than the watermark are left out."""
    windows = pages.withWatermark("modificationTime", late).groupBy(F.window("modificationTime", width))
    return windows.agg(F.count("*").alias("files"), F.sum("length").alias("bytes")).select("window.start", "window.end", "files", "bytes")


def ingest(pages: DataFrame, out: str, checkpoint: str) -> StreamingQuery:
    """Starts writing pages to Parquet, each once."""
    return pages.writeStream.format("parquet").option("path", out).option("checkpointLocation", checkpoint).outputMode("append").trigger(availableNow=True).start()
