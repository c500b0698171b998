"""JSON wire format: decode (A2) and encode (A6/A7) transaction messages.

One JSON object per message, event time as 'yyyy-MM-dd HH:mm:ss' text. The
decode path is shared by the Kafka reader and the file readers, so malformed
messages are routed the same way everywhere.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from perkflow import config
from perkflow.sources.schemas import TRANSACTIONS_COLUMNS, TRANSACTIONS_SCHEMA

CORRUPT_COL = "_corrupt"

_DECODE_SCHEMA = T.StructType(
    list(TRANSACTIONS_SCHEMA.fields) + [T.StructField(CORRUPT_COL, T.StringType())])

JSON_OPTIONS = {
    "timestampFormat": config.WIRE_TIME_FORMAT,
    "timestampNTZFormat": config.WIRE_TIME_FORMAT,
    # wall times on the wire are read as UTC instants
    "timeZone": "UTC",
}


def decode_transactions(raw: DataFrame, value_col: str = "value", keep_corrupt: bool = True,
                        keep_value: bool = False) -> DataFrame:
    """Bytes/strings holding JSON -> typed transaction columns.

    Malformed messages come back with NULL fields and the raw text in
    ``_corrupt``; amounts with more decimals are rounded to scale 2.
    """
    opts = dict(JSON_OPTIONS, mode="PERMISSIVE", columnNameOfCorruptRecord=CORRUPT_COL)
    parsed = raw.select(F.from_json(F.col(value_col).cast("string"), _DECODE_SCHEMA, opts).alias("m"),
                        *([value_col] if keep_value else []))
    cols = [F.col(f"m.{c}").alias(c) for c in TRANSACTIONS_COLUMNS]
    if keep_corrupt:
        cols.append(F.col(f"m.{CORRUPT_COL}").alias(CORRUPT_COL))
    if keep_value:
        cols.append(F.col(value_col))
    return parsed.select(*cols)


REQUIRED_COLUMNS = ("member_id", "member_name", "transaction_type", "amount", "transaction_time")


def is_valid() -> Column:
    """The one rule for a decoded message: it parsed, and what the summary needs is there."""
    ok = F.col(CORRUPT_COL).isNull()
    for c in REQUIRED_COLUMNS:
        ok = ok & F.col(c).isNotNull()
    return ok


def valid_rows(decoded: DataFrame) -> DataFrame:
    return decoded.where(is_valid()).drop(CORRUPT_COL)


def corrupt_rows(decoded: DataFrame) -> DataFrame:
    """Messages that did not parse, as they came."""
    return decoded.where(F.col(CORRUPT_COL).isNotNull()).select(CORRUPT_COL)


def rejected_rows(raw: DataFrame, value_col: str = "value") -> DataFrame:
    """Messages that the rule refuses, as they came, with what is wrong (``reason``)."""
    message = F.col(value_col).cast("string")
    decoded = decode_transactions(raw, value_col, True, keep_value=True)
    missing = F.concat_ws(",", *[F.when(F.col(c).isNull(), F.lit(c)) for c in REQUIRED_COLUMNS])
    return decoded.where(~is_valid()).select(
        message.alias("value"),
        F.when(F.col(CORRUPT_COL).isNotNull(), F.lit("malformed")).otherwise(F.concat(F.lit("missing "), missing))
        .alias("reason"))


def encode_value(df: DataFrame) -> Column:
    """All columns of ``df`` as one JSON text (the message value)."""
    return F.to_json(F.struct(*[F.col(c) for c in df.columns]), JSON_OPTIONS)


def encode_transactions(tx: DataFrame) -> DataFrame:
    """Transactions -> single ``value`` column of JSON text."""
    sel = tx.select(*TRANSACTIONS_COLUMNS)
    return sel.select(encode_value(sel).alias("value"))
