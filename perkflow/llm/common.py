"""Small helpers shared by the training-data operators."""

from __future__ import annotations

import os
import uuid
from collections.abc import Callable

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from perkflow.session import checkpoint_root


def utf8(text: str | Column) -> Column:
    """A text column as its UTF-8 bytes; null reads as empty.

    Operators work on bytes: a text that is not valid UTF-8 then cannot fail
    the hand-over to Python.
    """
    c = F.col(text) if isinstance(text, str) else text
    return F.coalesce(c.cast("binary"), F.lit(b""))


def private_name(df: DataFrame, wanted: str) -> str:
    """A column name that clashes with none of ``df``'s (case-insensitively)."""
    taken = {c.lower() for c in df.columns}
    name = wanted
    while name.lower() in taken:
        name = "_" + name
    return name


def save(df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` as Parquet in the shared checkpoint folder and read it back.

    Cuts the lineage: later stages depend on files that every executor can
    read, so a lost executor costs only its running tasks. A retention rule on
    ``<spark.checkpoint.dir>/perkflow-llm`` may drop tables of finished jobs.
    """
    spark = df.sparkSession
    path = os.path.join(checkpoint_root(spark), "perkflow-llm", f"{name}-{uuid.uuid4().hex}")
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


FILTER_BITS = 1 << 25


def key_filter(keys: DataFrame, key: str) -> Callable[[Column], Column]:
    """A test that holds for all of ``keys`` and fails for most others, to spare the others a shuffle.

    One bit per hash value: 4 MB to broadcast, however many keys there are. With
    very many keys it lets everything pass, so an exact join must follow.
    """
    def place(c: Column) -> Column:
        return F.pmod(F.xxhash64(c), F.lit(FILTER_BITS)) + 1

    rows = keys.select(place(F.col(key)).alias("at")).groupBy(F.bitmap_bucket_number("at").alias("part")) \
        .agg(F.bitmap_construct_agg(F.bitmap_bit_position("at")).alias("bits")).collect()  # at most 1024 rows of 4 KB
    part_bytes = 4096
    bits = np.zeros(FILTER_BITS // 8, np.uint8)
    for r in rows:
        start = (r["part"] - 1) * part_bytes
        bits[start:start + part_bytes] = np.frombuffer(bytes(r["bits"]), np.uint8)
    shared = keys.sparkSession.sparkContext.broadcast(bits)

    @F.arrow_udf("boolean")
    def may_hold(at: pa.Array) -> pa.Array:
        i = at.to_numpy(zero_copy_only=False) - 1
        return pa.array((shared.value[i >> 3] >> (i & 7).astype(np.uint8)) & 1 == 1)

    return lambda c: may_hold(place(c))


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet")
