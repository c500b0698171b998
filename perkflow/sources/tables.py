"""Parquet tables of a data folder."""

from __future__ import annotations

import os

from pyspark.sql import DataFrame, SparkSession

TABLES = ("region", "nation", "customer", "supplier", "part", "orders",
          "lineitem", "events", "documents", "embeddings", "pages",
          "benchmark", "labels", "conversations")


def read_table(spark: SparkSession, data_dir: str, name: str) -> DataFrame:
    """Read ``<data_dir>/<name>.parquet`` (file or folder of part files)."""
    return spark.read.parquet(os.path.join(data_dir, f"{name}.parquet"))
