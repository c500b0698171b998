"""File sinks (A7, A8, A9); the Kafka sink is in sources.kafka."""

from __future__ import annotations

import datetime as dt
import os

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from perkflow import config
from perkflow.functions.time import to_datetime
from perkflow.sources.wire import encode_value


def write_ndjson(df: DataFrame, path: str, mode: str = "overwrite") -> None:
    """Rows as JSON lines in the wire format (one object per line)."""
    df.select(encode_value(df).alias("value")).write.mode(mode).text(path)


def members_csv_path(folder: str, as_of: str | dt.datetime) -> str:
    return os.path.join(folder, f"{config.MEMBERS_CSV_PREFIX}{to_datetime(as_of):%Y%m%d_%H%M%S}")


def write_members_csv(members: DataFrame, folder: str, as_of: str | dt.datetime,
                      mode: str = "overwrite") -> str:
    """All-member table as CSV with a header, highest spend first.

    A global sort range-partitions the rows, so part files are written in
    parallel and read back in order.
    """
    path = members_csv_path(folder, as_of)
    (members.orderBy(F.col("total_spend").desc(), F.col("member_id"))
     .write.mode(mode).option("header", True).csv(path))
    return path


def write_fulfillment_csv(report: DataFrame, path: str, mode: str = "overwrite") -> None:
    """Fulfilment report (display headers already applied) as CSV."""
    report.write.mode(mode).option("header", True).csv(path)
