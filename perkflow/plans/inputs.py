"""Shared inputs of the registered queries: data folder -> transactions -> summary -> offers -> ledger.

Nothing is collected or cached here: every accessor returns a lazy DataFrame,
so a query plan built from them scans only the columns and rows it uses.
"""

from __future__ import annotations

import datetime as dt
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from perkflow import config
from perkflow.operators import ledger as ledger_ops
from perkflow.operators.offers import drink_offers, hotel_room_offers, offer_rows
from perkflow.functions.time import date_lit, duration_seconds, to_date, to_datetime
from perkflow.operators.summary import member_window_summary, restrict_to_interval
from perkflow.sources.events_adapter import transactions_from_events
from perkflow.sources.fixtures import simulated_requests_from_rows
from perkflow.sources.tables import read_table


@dataclass(frozen=True)
class Params:
    window: str = config.DEFAULT_WINDOW
    hotel_threshold: int = config.DEFAULT_HOTEL_THRESHOLD
    drink_threshold: int = config.DEFAULT_DRINK_THRESHOLD
    as_of: str = config.FIXTURE_AS_OF
    today: str = config.FIXTURE_TODAY
    interval_seconds: int = config.FIXTURE_INTERVAL_SECONDS
    history_windows: int = 3
    top_k: int = 10


class Inputs:
    def __init__(self, spark: SparkSession, data_dir: str, params: Params = Params()):
        self.spark, self.data_dir, self.p = spark, data_dir, params

    def events(self) -> DataFrame:
        return read_table(self.spark, self.data_dir, "events")

    def tx(self) -> DataFrame:
        return transactions_from_events(self.events())

    def summary(self, window: str | None = None, tx: DataFrame | None = None) -> DataFrame:
        return member_window_summary(self.tx() if tx is None else tx, window or self.p.window)

    def hotel(self, window: str | None = None, summary: DataFrame | None = None) -> DataFrame:
        s = self.summary(window) if summary is None else summary
        return hotel_room_offers(s, config.DEFAULT_HOTEL_THRESHOLD)

    def drink(self, window: str | None = None, summary: DataFrame | None = None) -> DataFrame:
        s = self.summary(window) if summary is None else summary
        return drink_offers(s, config.DEFAULT_DRINK_THRESHOLD)

    def offer_rows(self, window: str | None = None, summary: DataFrame | None = None) -> DataFrame:
        """Both offer types in one pass over the summary."""
        s = self.summary(window) if summary is None else summary
        return offer_rows(s, config.DEFAULT_HOTEL_THRESHOLD, config.DEFAULT_DRINK_THRESHOLD)

    def ledger(self, window: str | None = None, summary: DataFrame | None = None,
               rows: DataFrame | None = None) -> DataFrame:
        """Ledger built from the simulated redemption desk (first request per key wins)."""
        r = self.offer_rows(window, summary) if rows is None else rows
        return ledger_ops.new_redemptions(simulated_requests_from_rows(r), None)


    def ledger_on(self, day, window: str | None = None) -> DataFrame:
        """The ledger's rows for one ``redemption_date``, read from that day's source rows only.

        A stored ledger is partitioned by date and a date predicate prunes it
        to one partition. The simulated desk requests at ``window_end``, so the
        rows dated ``day`` come from windows ending on that day, whose
        transactions all lie in [day - window, day + 1 day): that range is
        pushed to the source scan instead of aggregating every day.
        """
        w = window or self.p.window
        d0 = to_datetime(to_date(day))
        tx = restrict_to_interval(self.tx(), d0 - dt.timedelta(seconds=duration_seconds(w)),
                                  d0 + dt.timedelta(days=1))
        led = self.ledger(w, summary=self.summary(w, tx=tx))
        return led.where(F.col("redemption_date") == date_lit(day))


MONEY_COLUMNS = ("amount", "total_spend", "total_winnings", "net_amount", "loss_amount",
                 "metric_value", "total_revenue", "total_bet", "total_won")


def money_as_double(df: DataFrame) -> DataFrame:
    """Output edge of the registered queries (oracle comparison).

    Decimal money columns leave as double and DATE columns as ISO
    'yyyy-MM-dd' text, a representation both engines render the same way.
    The library itself keeps decimals and dates.
    """
    def edge(f):
        c = F.col(f"`{f.name}`")
        if f.name in MONEY_COLUMNS and isinstance(f.dataType, T.DecimalType):
            return c.cast("double").alias(f.name)
        if isinstance(f.dataType, T.DateType):
            return F.date_format(c, "yyyy-MM-dd").alias(f.name)
        return c
    return df.select(*[edge(f) for f in df.schema.fields])
