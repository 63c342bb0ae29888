"""Files as they arrive: the same tables as of a batch, by Structured Streaming."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from quire.sources import tables

_FILES = "path string, modificationTime timestamp, length bigint, content binary"


def stream(spark: SparkSession, path: str, table: str = "docs", files_per_batch: int = 1000, **options) -> DataFrame:
    """A streaming table of the files that appear in a folder; each file is parsed once, in one row."""
    files = spark.readStream.format("binaryFile").schema(_FILES).option("maxFilesPerTrigger", files_per_batch).load(path)
    return tables.tables(files, table, **options)


def ingest(spark: SparkSession, path: str, target: str, checkpoint: str, table: str = "docs", **options):
    """Appends the rows of new files to a Parquet table; exactly once, by the checkpoint. Returns the query."""
    return stream(spark, path, table, **options).writeStream.format("parquet").option("path", target).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
