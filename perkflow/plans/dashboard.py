"""The dashboard's read path over materialized tables.

The reference's dashboard polls SQL over views the stream processor keeps up
to date. Here the same questions read two stored tables: the member summary
(written once by ``catalog.rebuild_summary`` or compacted from the streaming
change log, partitioned by window date) and the redemption ledger
(partitioned by redemption date). Window predicates on ``window_start`` /
``window_end`` prune date partitions of the summary; day predicates prune the
ledger. Nothing here rescans the raw transactions.

With ``changelog_path`` the dashboard is live: closed windows come from the
compacted table up to its committed boundary, open ones from the newest
versions in the change log, so every tab includes windows that still change.
"""

from __future__ import annotations

import datetime as dt
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from perkflow import config
from perkflow.functions.time import (date_lit, duration_seconds, interval_bounds, time_filter,
                                     time_filter_lower_bound, to_date, to_datetime, ts_lit)
from perkflow.operators import analytics, ledger, offers
from perkflow.plans.catalog import rebuild_summary
from perkflow.sources.schemas import SUMMARY_COLUMNS
from perkflow.streaming import changelog


@dataclass
class Dashboard:
    spark: SparkSession
    summary_path: str
    ledger_path: str
    hotel_threshold: int = config.DEFAULT_HOTEL_THRESHOLD
    drink_threshold: int = config.DEFAULT_DRINK_THRESHOLD
    interval_seconds: int = config.DEFAULT_INTERVAL_SECONDS
    window: str = config.DEFAULT_WINDOW
    table_name: str | None = None     # read a bucketed catalog table instead of the path
    changelog_path: str | None = None  # the summary stream's change log; summary_path is its compacted table

    @classmethod
    def build(cls, spark: SparkSession, tx: DataFrame, summary_path: str, ledger_path: str,
              window: str = config.DEFAULT_WINDOW, buckets: int | None = None,
              table_name: str = "member_daily_summary", **kw) -> "Dashboard":
        """Materialize the summary from transactions (A15) and open the dashboard on it.

        ``buckets`` writes it bucketed by member_id (see ``catalog.rebuild_summary``).
        """
        rebuild_summary(spark, tx, summary_path, window, buckets, table_name)
        return cls(spark, summary_path, ledger_path, window=window,
                   table_name=table_name if buckets else None, **kw)

    # --- tables -----------------------------------------------------------------
    def summary(self, first_day=None, last_day=None) -> DataFrame:
        """The summary table, pruned to ``window_date`` partitions in [first_day, last_day].

        Spark does not derive partition filters from predicates on
        ``window_start`` / ``window_end``, so the questions that bound the
        window state the date range explicitly.
        """
        if self.changelog_path:
            df = self._live_summary()
        else:
            df = (self.spark.table(self.table_name) if self.table_name
                  else self.spark.read.parquet(self.summary_path))
        if first_day is not None:
            df = df.where(F.col("window_date") >= date_lit(first_day))
        if last_day is not None:
            df = df.where(F.col("window_date") <= date_lit(last_day))
        return df.select(*SUMMARY_COLUMNS)

    def _live_summary(self) -> DataFrame:
        """Compacted windows and the newest versions of the others, with ``window_date``."""
        log = changelog.read_changelog(self.spark, self.changelog_path)
        boundary = changelog.committed_boundary(self.spark, self.summary_path)
        if boundary is not None:
            log = log.where(F.col("window_end") > ts_lit(boundary))
        live = changelog.newest_versions(log).withColumn("window_date", F.to_date("window_start"))
        columns = [*SUMMARY_COLUMNS, "window_date"]
        if boundary is None:
            return live.select(*columns)
        return changelog.compacted_rows(self.spark, self.summary_path, boundary).select(*columns) \
            .unionByName(live.select(*columns))

    def _window_starting_after(self, end_after) -> dt.date | None:
        """First window date that can hold a window ending after ``end_after``."""
        if end_after is None:
            return None
        return (to_datetime(end_after) - dt.timedelta(seconds=duration_seconds(self.window))).date()

    def ledger(self) -> DataFrame:
        return ledger.read_ledger(self.spark, self.ledger_path)

    def _threshold(self, kind: str):
        return self.hotel_threshold if kind == config.HOTEL else self.drink_threshold

    # --- offer tabs (F1, F2, F6, F7, E3, D8, D9) ------------------------------------
    def interval_offers(self, kind: str, which: str, as_of, today=None) -> DataFrame:
        """Qualifying windows of the current or previous interval, with already_redeemed."""
        cs, ce, ps, pe = interval_bounds(as_of, self.interval_seconds)
        start, end = (cs, ce) if which == "current" else (ps, pe)
        day = today or to_date(as_of)
        done = ledger.read_ledger(self.spark, self.ledger_path, day, day)
        return offers.interval_offers(self.summary(start, end), done, kind, self._threshold(kind), start, end, day)

    def _history(self, kind: str, as_of, time_window: str) -> DataFrame:
        _, _, ps, _ = interval_bounds(as_of, self.interval_seconds)
        first = self._window_starting_after(time_filter_lower_bound(time_window, as_of))
        return offers.qualifying_history(self.summary(first, ps), kind, self._threshold(kind), ps,
                                         time_filter(time_window, as_of))

    def history(self, kind: str, as_of, time_window: str = "All Time") -> DataFrame:
        return self._history(kind, as_of, time_window).orderBy(F.col("window_start").desc())

    def last_windows(self, kind: str, as_of, k: int = 3, time_window: str = "All Time") -> DataFrame:
        return offers.last_windows(self._history(kind, as_of, time_window), k)

    def history_window_counts(self, kind: str, as_of, k: int = 3, time_window: str = "All Time") -> DataFrame:
        return offers.history_window_counts(self._history(kind, as_of, time_window), k)

    def interval_counts(self, as_of) -> DataFrame:
        _, ce, ps, _ = interval_bounds(as_of, self.interval_seconds)
        return offers.interval_qualifier_counts(self.summary(ps, ce), as_of, self.interval_seconds,
                                                self.hotel_threshold, self.drink_threshold)

    # --- fulfilment tab (F4, F5, F9, D6, D7) ----------------------------------------
    def pending(self, today) -> DataFrame:
        rows = offers.offer_rows(self.summary())   # fixed-threshold offer views
        return ledger.pending_from_rows(rows, ledger.read_ledger(self.spark, self.ledger_path, today, today), today)

    def pending_counts(self, today) -> DataFrame:
        return ledger.pending_counts(self.pending(today))

    def fulfilled(self) -> DataFrame:
        return ledger.fulfilled_offers(self.ledger())

    def fulfilled_counts(self) -> DataFrame:
        return ledger.fulfilled_counts(self.fulfilled())

    def fulfilled_report(self, offer_filter: str = "All", member_search: str | None = None,
                         literal: bool = False) -> DataFrame:
        return ledger.fulfilled_report(self.fulfilled(), offer_filter, member_search, literal)

    def redeem(self, requests: DataFrame) -> int:
        """Append a batch of redemption requests (single writer)."""
        return ledger.append_redemptions(self.spark, requests, self.ledger_path)

    # --- analytics and members tabs (D2-D5, D10-D12, F3, F8) --------------------------
    def _pred(self, time_window: str, as_of):
        return None if time_window == "All Time" else time_filter(time_window, _now(as_of))

    def _filtered(self, time_window: str, as_of) -> DataFrame:
        lower = None if time_window == "All Time" else time_filter_lower_bound(time_window, _now(as_of))
        return self.summary(self._window_starting_after(lower))

    def stats(self, time_window: str = "All Time", as_of=None) -> DataFrame:
        return analytics.overall_stats(self._filtered(time_window, as_of), self._pred(time_window, as_of))

    def reward_distribution(self, time_window: str = "All Time", as_of=None) -> DataFrame:
        return analytics.reward_eligibility_distribution(
            self._filtered(time_window, as_of), self.hotel_threshold, self.drink_threshold,
            self._pred(time_window, as_of))

    def win_loss(self, time_window: str = "All Time", as_of=None) -> DataFrame:
        return analytics.win_loss_distribution(self._filtered(time_window, as_of), self._pred(time_window, as_of))

    def top_spenders(self, time_window: str = "All Time", as_of=None, limit: int = 10) -> DataFrame:
        return analytics.top_spenders(self._filtered(time_window, as_of), self._pred(time_window, as_of), limit)

    def all_members(self, time_window: str = "All Time", as_of=None) -> DataFrame:
        return analytics.all_members(self._filtered(time_window, as_of), self.hotel_threshold,
                                     self.drink_threshold, self._pred(time_window, as_of))

    def leaderboard(self) -> DataFrame:
        return analytics.member_leaderboard(self.summary())

    def row_count(self) -> DataFrame:
        return self.summary().agg(F.count(F.lit(1)).alias("row_count"))


def _now(as_of) -> dt.datetime:
    """``as_of``, or the wall clock in UTC where none is given."""
    return dt.datetime.now(dt.timezone.utc).replace(tzinfo=None) if as_of is None else to_datetime(as_of)
