import datetime as dt
from decimal import Decimal

from perkflow.sources.schemas import TRANSACTIONS_COLUMNS
from pyspark.sql import types as T

TX_NTZ_SCHEMA = T.StructType([
    T.StructField("transaction_id", T.LongType()),
    T.StructField("member_id", T.LongType()),
    T.StructField("member_name", T.StringType()),
    T.StructField("transaction_type", T.StringType()),
    T.StructField("amount", T.DecimalType(18, 2)),
    T.StructField("game_type", T.StringType()),
    T.StructField("transaction_time", T.TimestampNTZType()),
])


def ts(s: str) -> dt.datetime:
    return dt.datetime.fromisoformat(s)


def tx_rows(spark, rows):
    """rows: (id, member, name, type, amount, game, time-text)."""
    data = [(r[0], r[1], r[2], r[3], None if r[4] is None else Decimal(str(r[4])), r[5],
             None if r[6] is None else ts(r[6])) for r in rows]
    return spark.createDataFrame(data, TX_NTZ_SCHEMA).select(*TRANSACTIONS_COLUMNS)
