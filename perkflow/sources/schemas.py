"""Declared (never inferred) schemas."""

from __future__ import annotations

from pyspark.sql import types as T

MONEY = T.DecimalType(18, 2)

# Source transactions as they arrive on the wire (one JSON object per message).
# Event time is an instant in streams (watermarks need TimestampType) and a
# naive TimestampNTZ in batch tables; see functions.time for the conversion.
TRANSACTIONS_SCHEMA = T.StructType([
    T.StructField("transaction_id", T.LongType()),
    T.StructField("member_id", T.LongType()),
    T.StructField("member_name", T.StringType()),
    T.StructField("transaction_type", T.StringType()),
    T.StructField("amount", MONEY),
    T.StructField("game_type", T.StringType()),
    T.StructField("transaction_time", T.TimestampType()),
])

TRANSACTIONS_COLUMNS = [f.name for f in TRANSACTIONS_SCHEMA.fields]

# Redemption ledger: every column NOT NULL, key (member_id, offer_type,
# redemption_date).
LEDGER_SCHEMA = T.StructType([
    T.StructField("member_id", T.LongType(), False),
    T.StructField("member_name", T.StringType(), False),
    T.StructField("offer_type", T.StringType(), False),
    T.StructField("redeemed_at", T.TimestampNTZType(), False),
    T.StructField("redemption_date", T.DateType(), False),
])
LEDGER_KEY = ["member_id", "offer_type", "redemption_date"]
LEDGER_COLUMNS = [f.name for f in LEDGER_SCHEMA.fields]

SUMMARY_KEY = ["member_id", "member_name", "window_start", "window_end"]
SUMMARY_COLUMNS = SUMMARY_KEY + [
    "total_spend", "total_winnings", "net_amount", "transaction_count",
    "last_transaction",
]

# The stored summary: money sums carry ten digits more than an amount, windows are naive wall time.
COMPACTED_SCHEMA = T.StructType([
    T.StructField("member_id", T.LongType()),
    T.StructField("member_name", T.StringType()),
    T.StructField("window_start", T.TimestampNTZType()),
    T.StructField("window_end", T.TimestampNTZType()),
    T.StructField("total_spend", T.DecimalType(28, 2)),
    T.StructField("total_winnings", T.DecimalType(28, 2)),
    T.StructField("net_amount", T.DecimalType(28, 2)),
    T.StructField("transaction_count", T.LongType()),
    T.StructField("last_transaction", T.TimestampNTZType()),
    T.StructField("window_date", T.DateType()),
])

# Redemption requests (the write path's input): who asked for which offer when.
REQUEST_SCHEMA = T.StructType([
    T.StructField("member_id", T.LongType()),
    T.StructField("member_name", T.StringType()),
    T.StructField("offer_type", T.StringType()),
    T.StructField("requested_at", T.TimestampNTZType()),
])
