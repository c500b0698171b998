"""File twins of the Kafka topic (A5): JSON-lines folders, batch or stream."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from perkflow.sources.wire import decode_transactions


def read_json_transactions(spark: SparkSession, path: str, keep_corrupt: bool = True) -> DataFrame:
    """Batch read of JSON-lines transaction files through the wire decoder."""
    return decode_transactions(spark.read.text(path), keep_corrupt=keep_corrupt)


def stream_json_transactions(spark: SparkSession, path: str,
                             max_files_per_trigger: int | None = None,
                             keep_corrupt: bool = True) -> DataFrame:
    """Streaming read of a folder of JSON-lines files (new files = new data)."""
    reader = spark.readStream.format("text")
    if max_files_per_trigger:
        reader = reader.option("maxFilesPerTrigger", str(max_files_per_trigger))
    return decode_transactions(reader.load(path), keep_corrupt=keep_corrupt)


def stream_parquet_table(spark: SparkSession, folder: str, name: str,
                         max_files_per_trigger: int | None = None) -> DataFrame:
    """Stream the ``<name>.parquet`` table of a data folder: one file, or a folder of part files.

    The schema comes from the files. A folder is streamed part by part (oldest
    first), and parts added later are picked up.
    """
    path = f"{folder.rstrip('/')}/{name}.parquet"
    reader = spark.readStream.format("parquet").schema(spark.read.parquet(path).schema)
    if max_files_per_trigger:
        reader = reader.option("maxFilesPerTrigger", str(max_files_per_trigger))
    hpath = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    fs = hpath.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    if fs.getFileStatus(hpath).isDirectory():
        return reader.load(path)
    return reader.option("pathGlobFilter", f"{name}.parquet").load(folder)
