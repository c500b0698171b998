"""Per-member tumbling-window totals (the core materialized view, D1).

groupBy(member_id, member_name, window(time, size)) with conditional sums,
count and max. Spark plans it as partial aggregate -> shuffle on the keys ->
final aggregate, so a member holding a large share of all rows reaches the
shuffle as at most one partial row per (map task, window).
The same function takes a batch or a streaming DataFrame.
"""

from __future__ import annotations

import datetime as dt

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from perkflow import config
from perkflow.functions.time import duration_seconds, to_datetime, ts_lit


def spend_expr(typ: Column, amount: Column) -> Column:
    return F.when(typ == "bet", amount).otherwise(F.lit(0))


def winnings_expr(typ: Column, amount: Column) -> Column:
    return F.when(typ == "win", amount).otherwise(F.lit(0))


def net_expr(typ: Column, amount: Column) -> Column:
    """win -> +amount, bet -> -amount, anything else (cashout, NULL) -> 0."""
    return (F.when(typ == "win", amount)
            .when(typ == "bet", -amount)
            .otherwise(F.lit(0)))


def member_window_summary(tx: DataFrame, window: str = config.DEFAULT_WINDOW,
                          time_col: str = "transaction_time", also_by: tuple[str, ...] = ()) -> DataFrame:
    """Transactions -> one row per (member_id, member_name, window), and per value of the ``also_by`` columns."""
    typ, amount = F.col("transaction_type"), F.col("amount")
    agg = tx.groupBy("member_id", "member_name", F.window(time_col, window).alias("w"), *also_by).agg(
        F.sum(spend_expr(typ, amount)).alias("total_spend"),
        F.sum(winnings_expr(typ, amount)).alias("total_winnings"),
        F.sum(net_expr(typ, amount)).alias("net_amount"),
        F.count(F.lit(1)).alias("transaction_count"),
        F.max(time_col).alias("last_transaction"),
    )
    return agg.select(
        "member_id", "member_name",
        F.col("w.start").alias("window_start"), F.col("w.end").alias("window_end"),
        "total_spend", "total_winnings", "net_amount", "transaction_count", "last_transaction", *also_by,
    )


def rollup_windows(summary: DataFrame, window: str) -> DataFrame:
    """Roll a finer summary up to a coarser tumbling size.

    The coarse size must be a multiple of the fine one; sums and counts add,
    last_transaction is the max of maxes.
    """
    agg = summary.groupBy("member_id", "member_name", F.window("window_start", window).alias("w")).agg(
        F.sum("total_spend").alias("total_spend"),
        F.sum("total_winnings").alias("total_winnings"),
        F.sum("net_amount").alias("net_amount"),
        F.sum("transaction_count").alias("transaction_count"),
        F.max("last_transaction").alias("last_transaction"),
    )
    return agg.select(
        "member_id", "member_name",
        F.col("w.start").alias("window_start"), F.col("w.end").alias("window_end"),
        "total_spend", "total_winnings", "net_amount", "transaction_count", "last_transaction",
    )


# --- source-side time pruning ------------------------------------------------
# A predicate on window bounds is an opaque expression over the raw time column
# once pushed through the aggregate, so parquet row-group statistics and
# partition pruning cannot use it. These helpers restate it as a plain range on
# the source time column. They only ever keep a superset of the rows of every
# window that the window predicate keeps, so results are unchanged.

def restrict_to_interval(tx: DataFrame, start, end, time_col: str = "transaction_time") -> DataFrame:
    """Rows that can belong to a window contained in [start, end]."""
    t = F.col(time_col)
    return tx.where((t >= ts_lit(start)) & (t < ts_lit(end)))


def restrict_before(tx: DataFrame, bound, time_col: str = "transaction_time") -> DataFrame:
    """Rows that can belong to a window ending strictly before ``bound``."""
    return tx.where(F.col(time_col) < ts_lit(bound))


def restrict_window_end_after(tx: DataFrame, lower, window: str,
                              time_col: str = "transaction_time") -> DataFrame:
    """Rows that can belong to a window with window_end > ``lower``."""
    if lower is None:
        return tx
    edge = to_datetime(lower) - dt.timedelta(seconds=duration_seconds(window))
    return tx.where(F.col(time_col) > ts_lit(edge))
