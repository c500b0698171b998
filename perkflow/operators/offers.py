"""Reward offers over the member summary."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from perkflow import config
from perkflow.functions.text import metric_label
from perkflow.session import materialize
from perkflow.functions.time import (date_lit, interval_bounds, interval_label, window_before,
                                     window_in_interval)

OFFER_BASE_COLUMNS = ["member_id", "member_name", "total_spend", "transaction_count",
                      "net_amount", "last_transaction", "window_start", "window_end"]


def hotel_predicate(threshold=config.DEFAULT_HOTEL_THRESHOLD) -> Column:
    """Spend at or above the threshold (inclusive)."""
    return F.col("total_spend") >= F.lit(threshold)


def drink_predicate(threshold=config.DEFAULT_DRINK_THRESHOLD) -> Column:
    """A net loss of at least the threshold (inclusive); net 0 never qualifies."""
    net = F.col("net_amount")
    return (net < 0) & (F.abs(net) >= F.lit(threshold))


def offer_predicate(kind: str, threshold) -> Column:
    return hotel_predicate(threshold) if kind == config.HOTEL else drink_predicate(threshold)


def reward_status(hotel_threshold=config.DEFAULT_HOTEL_THRESHOLD,
                  drink_threshold=config.DEFAULT_DRINK_THRESHOLD) -> Column:
    """Hotel wins over drink; otherwise no reward."""
    return (F.when(hotel_predicate(hotel_threshold), F.lit(config.HOTEL_LABEL))
            .when(drink_predicate(drink_threshold), F.lit(config.DRINK_LABEL))
            .otherwise(F.lit(config.NO_REWARD_LABEL)))


def _offer_columns(kind: str) -> list[Column]:
    cols = [F.col(c) for c in OFFER_BASE_COLUMNS]
    if kind == config.DRINK:
        # loss_amount sits right after net_amount
        cols.insert(5, F.abs(F.col("net_amount")).alias("loss_amount"))
    return cols


def hotel_room_offers(summary: DataFrame, threshold=config.DEFAULT_HOTEL_THRESHOLD) -> DataFrame:
    """Windows whose spend qualifies for a hotel room (B1)."""
    return summary.where(hotel_predicate(threshold)).select(
        *_offer_columns(config.HOTEL), F.lit(config.HOTEL_REWARD_TYPE).alias("reward_type"))


def drink_offers(summary: DataFrame, threshold=config.DEFAULT_DRINK_THRESHOLD) -> DataFrame:
    """Windows whose net loss qualifies for a drink (B2)."""
    return summary.where(drink_predicate(threshold)).select(
        *_offer_columns(config.DRINK), F.lit(config.DRINK_REWARD_TYPE).alias("reward_type"))


def offers(summary: DataFrame, kind: str, threshold=None) -> DataFrame:
    """The offers of one type; no threshold means the default one, 0 means 0."""
    if kind == config.HOTEL:
        return hotel_room_offers(summary, config.DEFAULT_HOTEL_THRESHOLD if threshold is None else threshold)
    return drink_offers(summary, config.DEFAULT_DRINK_THRESHOLD if threshold is None else threshold)


def redeemed_members(ledger: DataFrame, offer_type: str, day) -> DataFrame:
    """Members with a redemption of ``offer_type`` on ``day`` (one row each)."""
    return (ledger.where((F.col("offer_type") == offer_type) & (F.col("redemption_date") == date_lit(day)))
            .select("member_id").distinct())


def interval_offers(summary: DataFrame, ledger: DataFrame, kind: str, threshold,
                    start, end, today) -> DataFrame:
    """Qualifying windows inside [start, end] with ``already_redeemed`` (F1/F2).

    The redemptions of ``today`` are at most one row per member and type; the
    join is left to the planner, which broadcasts it only when its measured
    size is under the broadcast threshold and sort-merges otherwise.
    """
    base = summary.where(offer_predicate(kind, threshold) & window_in_interval(start, end))
    flagged = redeemed_members(ledger, kind, today).withColumn("_redeemed", F.lit(True))
    joined = base.join(flagged, "member_id", "left")
    return (joined.select(*_offer_columns(kind),
                          F.coalesce(F.col("_redeemed"), F.lit(False)).alias("already_redeemed"))
            .orderBy(F.col("member_id").asc(), F.col("window_start").desc()))


def qualifying_history(summary: DataFrame, kind: str, threshold, before,
                       time_predicate: Column | None = None) -> DataFrame:
    """Qualifying windows that ended strictly before ``before``, in no order."""
    cond = offer_predicate(kind, threshold) & window_before(before)
    if time_predicate is not None:
        cond = cond & time_predicate
    return summary.where(cond).select(*_offer_columns(kind))


def offer_history(summary: DataFrame, kind: str, threshold, before,
                  time_predicate: Column | None = None) -> DataFrame:
    """Qualifying windows that ended strictly before ``before``, newest first."""
    return qualifying_history(summary, kind, threshold, before, time_predicate) \
        .orderBy(F.col("window_start").desc())


def last_windows(history: DataFrame, k: int = 3, materialize_input: bool = False) -> DataFrame:
    """Rows of the ``k`` most recent distinct windows, with a display label.

    ``history`` is best given unsorted (``qualifying_history``): only the
    result's rows are ordered. The k newest windows come from a top-k over the
    distinct windows (a small partial aggregate and TakeOrderedAndProject); the
    result has at most k rows, so broadcasting it into the semi-join is
    size-safe. ``history`` is read by both sides; when it is computed from raw
    transactions rather than read from the summary table,
    ``materialize_input`` computes it once.
    """
    return _newest(history, k, materialize_input).orderBy(F.col("window_start").desc(), F.col("member_id"))


def _newest(history: DataFrame, k: int, materialize_input: bool) -> DataFrame:
    if materialize_input:
        history = materialize(history)
    newest = (history.select("window_start", "window_end").distinct()
              .orderBy(F.col("window_start").desc(), F.col("window_end").desc()).limit(k))
    kept = history.join(F.broadcast(newest), ["window_start", "window_end"], "left_semi")
    return kept.withColumn("interval_label", interval_label())


def history_window_counts(history: DataFrame, k: int = 3, materialize_input: bool = False) -> DataFrame:
    """Qualifying rows per window for the ``k`` newest windows."""
    return (_newest(history, k, materialize_input)
            .groupBy("window_start", "window_end", "interval_label")
            .agg(F.count(F.lit(1)).alias("qualifying_members"))
            .orderBy(F.col("window_start").desc()))


def latest_per_member(df: DataFrame, metric: str) -> DataFrame:
    """Latest window per member, then the highest metric.

    ``row_number() == 1`` is planned as a partial WindowGroupLimit before the
    shuffle and a final one after it, so each map task forwards one row per
    member however many windows that member has.
    """
    w = Window.partitionBy("member_id").orderBy(
        F.col("window_end").desc(), F.col(metric).desc(), F.col("member_name").desc())
    return df.withColumn("_rn", F.row_number().over(w)).where(F.col("_rn") == 1).drop("_rn")


def offer_rows(summary: DataFrame, hotel_threshold=config.DEFAULT_HOTEL_THRESHOLD,
               drink_threshold=config.DEFAULT_DRINK_THRESHOLD) -> DataFrame:
    """Both offer views in one pass: one row per (window, qualifying offer type).

    Columns: member_id, member_name, offer_type, metric_value (spend for hotel,
    loss for drink), window_start, window_end. Reading hotel and drink offers
    as two filters of the same summary would make the planner prune each
    branch differently and aggregate the source twice; a single projection
    with an explode keeps one aggregate under every consumer.
    """
    h, d = hotel_predicate(hotel_threshold), drink_predicate(drink_threshold)
    hotel_row = F.when(h, F.struct(F.lit(config.HOTEL).alias("offer_type"),
                                   F.col("total_spend").alias("metric_value")))
    drink_row = F.when(d, F.struct(F.lit(config.DRINK).alias("offer_type"),
                                   F.abs(F.col("net_amount")).alias("metric_value")))
    return (summary.where(h | d)
            .select("member_id", "member_name", "window_start", "window_end",
                    F.explode(F.array(hotel_row, drink_row)).alias("o"))
            .where(F.col("o").isNotNull())
            .select("member_id", "member_name", "o.offer_type", "o.metric_value",
                    "window_start", "window_end"))


def offer_rows_of(hotel: DataFrame, drink: DataFrame) -> DataFrame:
    """Offer rows from the two offer views (when they are separate tables)."""
    cols = ["member_id", "member_name", "offer_type", "metric_value", "window_start", "window_end"]
    h = hotel.select(F.lit(config.HOTEL).alias("offer_type"), F.col("total_spend").alias("metric_value"), "*")
    d = drink.select(F.lit(config.DRINK).alias("offer_type"), F.col("loss_amount").alias("metric_value"), "*")
    return h.select(*cols).unionByName(d.select(*cols))


def latest_offer_rows(rows: DataFrame) -> DataFrame:
    """Latest, then largest, offer per member and offer type, in display shape.

    ``row_number() == 1`` over (member_id, offer_type) runs as a partial
    WindowGroupLimit before the shuffle and a final one after it, so each map
    task forwards one row per member and type however many windows qualify.
    """
    w = Window.partitionBy("member_id", "offer_type").orderBy(
        F.col("window_end").desc(), F.col("metric_value").desc(), F.col("member_name").desc())
    latest = rows.withColumn("_rn", F.row_number().over(w)).where(F.col("_rn") == 1)
    is_hotel = F.col("offer_type") == config.HOTEL
    return latest.select(
        "member_id", "member_name", "offer_type",
        F.when(is_hotel, F.lit(config.HOTEL_LABEL)).otherwise(F.lit(config.DRINK_LABEL)).alias("offer_display"),
        "metric_value",
        F.when(is_hotel, metric_label(config.SPEND_LABEL_PREFIX, "metric_value"))
         .otherwise(metric_label(config.LOSS_LABEL_PREFIX, "metric_value")).alias("metric_label"),
        "window_start", "window_end")


def latest_offers(hotel: DataFrame, drink: DataFrame) -> DataFrame:
    """Latest hotel and latest drink offer per member in one shape, from the two offer views."""
    return latest_offer_rows(offer_rows_of(hotel, drink))


def interval_qualifier_counts(summary: DataFrame, as_of, interval_seconds: int,
                              hotel_threshold=config.DEFAULT_HOTEL_THRESHOLD,
                              drink_threshold=config.DEFAULT_DRINK_THRESHOLD) -> DataFrame:
    """Rows on track (current interval) and qualified (previous interval) per offer type.

    One pass over the summary with conditional counts instead of four queries.
    """
    cs, ce, ps, pe = interval_bounds(as_of, interval_seconds)
    h, d = hotel_predicate(hotel_threshold), drink_predicate(drink_threshold)
    cur, prev = window_in_interval(cs, ce), window_in_interval(ps, pe)
    return summary.where(window_in_interval(ps, ce)).agg(
        F.count_if(h & cur).alias("hotel_current"),
        F.count_if(h & prev).alias("hotel_previous"),
        F.count_if(d & cur).alias("drink_current"),
        F.count_if(d & prev).alias("drink_previous"),
    )
