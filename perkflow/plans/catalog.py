"""Materialized tables and SQL over views.

The summary is the one expensive table every dashboard question reads, so it
is written once (partitioned by window date) and the other views are defined
over it; offers stay views (filters) so they can never go stale against the
summary. The ledger is never dropped by a rebuild.
"""

from __future__ import annotations

import datetime as dt

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from perkflow import config
from perkflow.functions.time import duration_seconds, to_date, to_datetime, ts_lit
from perkflow.operators import analytics
from perkflow.operators.offers import drink_offers, hotel_room_offers
from perkflow.operators.summary import member_window_summary, restrict_to_interval

VIEW_NAMES = ("gaming_transactions", "member_daily_summary", "hotel_room_offers", "drink_offers",
              "redeemed_offers", "game_stats", "member_leaderboard")


def rebuild_summary(spark: SparkSession, tx: DataFrame, table_path: str,
                    window: str = config.DEFAULT_WINDOW, buckets: int | None = None,
                    table_name: str = "member_daily_summary") -> DataFrame:
    """Recompute the summary from the source and overwrite its table.

    Partitioned by ``window_date`` so interval and history predicates prune
    whole days. With ``buckets`` the table is also bucketed (and sorted) by
    ``member_id`` and registered as ``table_name`` in the session catalog:
    per-member work on it (member totals for the leaderboard, latest offer
    per member, distinct members) then needs no shuffle of the summary. Size
    ``buckets`` so one bucket of one day is a few hundred MB.
    Returns the table as written.
    """
    s = member_window_summary(tx, window).withColumn("window_date", F.to_date("window_start"))
    if buckets:
        # each (day, bucket) in one task and so in one file, but no task holds a bucket's whole history
        # (bucket ids use the same hash as hash partitioning)
        (s.repartition("window_date", F.pmod(F.hash("member_id"), F.lit(buckets))).write.mode("overwrite").partitionBy("window_date")
         .bucketBy(buckets, "member_id").sortBy("member_id")
         .option("path", table_path).saveAsTable(table_name))
        return spark.table(table_name)
    # rows of a day together in few files, a large day split over several tasks
    s.hint("rebalance", "window_date").write.mode("overwrite").partitionBy("window_date").parquet(table_path)
    return spark.read.parquet(table_path)


def rebuild_days(spark: SparkSession, tx: DataFrame, table_path: str, first_day, last_day,
                 window: str = config.DEFAULT_WINDOW) -> DataFrame:
    """Recompute the windows that start on [first_day, last_day] and overwrite only those days (backfill).

    Reads only the transactions of these days; the other days' files stay as
    they are. ``window`` must divide a day, so that no window spans two.
    """
    if 86_400 % duration_seconds(window):
        raise ValueError(f"windows of {window} span days")
    lo, hi = to_datetime(to_date(first_day)), to_datetime(to_date(last_day)) + dt.timedelta(days=1)
    s = member_window_summary(restrict_to_interval(tx, lo, hi), window) \
        .where((F.col("window_start") >= ts_lit(lo)) & (F.col("window_start") < ts_lit(hi))) \
        .withColumn("window_date", F.to_date("window_start"))
    s.hint("rebalance", "window_date").write.mode("overwrite").option("partitionOverwriteMode", "dynamic") \
        .partitionBy("window_date").parquet(table_path)
    return spark.read.parquet(table_path)


def register_views(spark: SparkSession, tx: DataFrame, summary: DataFrame,
                   ledger: DataFrame | None = None,
                   hotel_threshold=config.DEFAULT_HOTEL_THRESHOLD,
                   drink_threshold=config.DEFAULT_DRINK_THRESHOLD,
                   leaderboard: bool = False) -> list[str]:
    """Temp views under the dashboard's table names (A16); returns those it registered.

    ``leaderboard=True`` also registers the ranked member leaderboard, whose
    ranks are computed when the view is defined.
    """
    views = {"gaming_transactions": tx, "member_daily_summary": summary,
             "hotel_room_offers": hotel_room_offers(summary, hotel_threshold),
             "drink_offers": drink_offers(summary, drink_threshold), "game_stats": analytics.game_stats(tx)}
    if leaderboard:
        views["member_leaderboard"] = analytics.member_leaderboard(summary)
    if ledger is not None:
        views["redeemed_offers"] = ledger
    for name, df in views.items():
        df.createOrReplaceTempView(name)
    return [n for n in VIEW_NAMES if n in views]


def run_sql(spark: SparkSession, text: str, args: dict | None = None) -> DataFrame:
    """Arbitrary SQL over the views with named parameters (``:name``) instead of splicing."""
    return spark.sql(text, args=args or {})
