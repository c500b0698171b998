"""Adapter: the generic ``events`` table -> gaming transactions.

events(event_id, ts, user_id, event_type, value, props) becomes
transactions(transaction_id, member_id, member_name, transaction_type, amount,
game_type, transaction_time). Pure projection: no shuffle, column-pruned and
filter-pushable down to the parquet scan.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from perkflow.sources.schemas import MONEY, TRANSACTIONS_COLUMNS

# ---------------------------------------------------------------------------
# FIXED VALUES (fixture mapping; the golden counts depend on them)
# ---------------------------------------------------------------------------
BET_EVENT_TYPES = ("purchase", "click")
WIN_EVENT_TYPES = ("view", "signup")
CASHOUT_EVENT_TYPES = ("error",)
AMOUNT_FACTOR = 50
# props.k in 0..99 -> game: k < 40 slot, k < 65 blackjack, k < 85 roulette,
# otherwise poker (the 40/25/20/15 popularity shares)
GAME_CUTS = ((40, "slot"), (65, "blackjack"), (85, "roulette"))
GAME_REST = "poker"
MEMBER_NAME_PREFIX = "Member "
# ---------------------------------------------------------------------------


def transaction_type_of(event_type: Column) -> Column:
    return (F.when(event_type.isin(*BET_EVENT_TYPES), F.lit("bet"))
            .when(event_type.isin(*WIN_EVENT_TYPES), F.lit("win"))
            .when(event_type.isin(*CASHOUT_EVENT_TYPES), F.lit("cashout")))


def game_type_of(k: Column) -> Column:
    expr = None
    for cut, name in GAME_CUTS:
        expr = F.when(k < cut, F.lit(name)) if expr is None else expr.when(k < cut, F.lit(name))
    return expr.otherwise(F.lit(GAME_REST))


def transactions_from_events(events: DataFrame) -> DataFrame:
    """Map the events table to the transaction schema (batch, NTZ time)."""
    # a malformed props value yields NULL (and the last game) instead of failing the job
    k = F.get_json_object(F.col("props"), "$.k").try_cast("int")
    amount = (F.col("value").cast(MONEY) * F.lit(AMOUNT_FACTOR)).cast(MONEY)
    return events.select(
        F.col("event_id").alias("transaction_id"),
        F.col("user_id").alias("member_id"),
        F.concat(F.lit(MEMBER_NAME_PREFIX), F.col("user_id").cast("string")).alias("member_name"),
        transaction_type_of(F.col("event_type")).alias("transaction_type"),
        amount.alias("amount"),
        game_type_of(k).alias("game_type"),
        F.col("ts").alias("transaction_time"),
    ).select(*TRANSACTIONS_COLUMNS)
