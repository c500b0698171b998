"""Registered queries: name -> (spark, data_dir) -> DataFrame.

Each entry is one operator of the coverage list, evaluated on the whole data
folder with the fixed fixture clock (as_of, today) and default thresholds.
Money columns leave as double so the DuckDB oracle can compare values.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from perkflow import config
from perkflow.functions.text import clock_text, redeemed_badge
from perkflow.functions.time import interval_bounds, interval_start_col, time_filter
from perkflow.operators import analytics, ledger, offers
from perkflow.operators.summary import (member_window_summary, restrict_before, restrict_to_interval,
                                        restrict_window_end_after, rollup_windows)
from perkflow.plans.inputs import Inputs, Params, money_as_double
from perkflow.sources.wire import decode_transactions, encode_transactions, valid_rows
from perkflow.functions.time import instant_to_ntz, time_filter_lower_bound, to_date, ts_lit

QueryFn = Callable[[SparkSession, str], DataFrame]
REGISTRY: dict[str, QueryFn] = {}
P = Params()


def query(name: str):
    def deco(fn):
        def run(spark: SparkSession, data_dir: str) -> DataFrame:
            return money_as_double(fn(Inputs(spark, data_dir, P)))
        run.__name__ = fn.__name__
        run.__doc__ = fn.__doc__
        REGISTRY[name] = run
        return fn
    return deco


# --- sources -----------------------------------------------------------------

@query("transactions")
def q_transactions(i: Inputs) -> DataFrame:
    """events -> declared transaction schema (A4 adapter)."""
    return i.tx()


@query("decode_transactions")
def q_decode_transactions(i: Inputs) -> DataFrame:
    """Encode every transaction as its JSON wire message and decode it back.

    The wire carries second-precision time text, so event times come back
    truncated to the second.
    """
    decoded = valid_rows(decode_transactions(encode_transactions(i.tx())))
    return decoded.withColumn("transaction_time", instant_to_ntz(F.col("transaction_time")))


# --- summary -----------------------------------------------------------------

@query("member_window_summary")
def q_summary(i: Inputs) -> DataFrame:
    """Per member x 5-minute tumbling window totals."""
    return i.summary()


@query("member_window_summary_1h")
def q_summary_1h(i: Inputs) -> DataFrame:
    return i.summary("1 hour")


@query("member_window_summary_1d")
def q_summary_1d(i: Inputs) -> DataFrame:
    return i.summary("1 day")


@query("daily_rollup")
def q_daily_rollup(i: Inputs) -> DataFrame:
    """5-minute summary rolled up to 1-day windows."""
    return rollup_windows(i.summary(), "1 day")


@query("summary_row_count")
def q_summary_row_count(i: Inputs) -> DataFrame:
    """COUNT(*) of the summary."""
    return i.summary().agg(F.count(F.lit(1)).alias("row_count"))


# --- offers ------------------------------------------------------------------

@query("hotel_room_offers")
def q_hotel(i: Inputs) -> DataFrame:
    return i.hotel()


@query("drink_offers")
def q_drink(i: Inputs) -> DataFrame:
    return i.drink()


@query("hotel_room_offers_1d")
def q_hotel_1d(i: Inputs) -> DataFrame:
    return i.hotel("1 day")


@query("drink_offers_1d")
def q_drink_1d(i: Inputs) -> DataFrame:
    return i.drink("1 day")


def _interval(i: Inputs, kind: str, which: str) -> DataFrame:
    cs, ce, ps, pe = interval_bounds(i.p.as_of, i.p.interval_seconds)
    start, end = (cs, ce) if which == "current" else (ps, pe)
    thr = i.p.hotel_threshold if kind == config.HOTEL else i.p.drink_threshold
    # the summary is only needed for windows inside [start, end]
    s = member_window_summary(restrict_to_interval(i.tx(), start, end), i.p.window)
    return offers.interval_offers(s, i.ledger_on(i.p.today), kind, thr, start, end, i.p.today)


@query("hotel_current")
def q_hotel_current(i: Inputs) -> DataFrame:
    """Hotel-qualifying windows in the current interval with already_redeemed."""
    return _interval(i, config.HOTEL, "current")


@query("hotel_previous")
def q_hotel_previous(i: Inputs) -> DataFrame:
    return _interval(i, config.HOTEL, "previous")


@query("drink_current")
def q_drink_current(i: Inputs) -> DataFrame:
    """Drink-qualifying windows in the current interval with already_redeemed."""
    return _interval(i, config.DRINK, "current")


@query("drink_previous")
def q_drink_previous(i: Inputs) -> DataFrame:
    return _interval(i, config.DRINK, "previous")


@query("interval_qualifier_count")
def q_interval_counts(i: Inputs) -> DataFrame:
    """On-track and qualified row counts for both offer types."""
    cs, ce, ps, pe = interval_bounds(i.p.as_of, i.p.interval_seconds)
    s = member_window_summary(restrict_to_interval(i.tx(), ps, ce), i.p.window)
    return offers.interval_qualifier_counts(s, i.p.as_of, i.p.interval_seconds,
                                            i.p.hotel_threshold, i.p.drink_threshold)


def _history(i: Inputs, kind: str, time_window: str = "All Time") -> DataFrame:
    """Qualifying windows that ended before the previous interval, in no order."""
    _, _, ps, _ = interval_bounds(i.p.as_of, i.p.interval_seconds)
    thr = i.p.hotel_threshold if kind == config.HOTEL else i.p.drink_threshold
    tx = restrict_before(i.tx(), ps)
    lower = time_filter_lower_bound(time_window, i.p.as_of)
    if lower is not None:
        tx = restrict_window_end_after(tx, lower, i.p.window)
    s = member_window_summary(tx, i.p.window)
    return offers.qualifying_history(s, kind, thr, ps, None if lower is None else time_filter(time_window, i.p.as_of))


def _newest_first(history: DataFrame) -> DataFrame:
    return history.orderBy(F.col("window_start").desc())


@query("hotel_history")
def q_hotel_history(i: Inputs) -> DataFrame:
    """Hotel-qualifying windows that ended before the previous interval."""
    return _newest_first(_history(i, config.HOTEL))


@query("drink_history")
def q_drink_history(i: Inputs) -> DataFrame:
    return _newest_first(_history(i, config.DRINK))


@query("hotel_last_windows")
def q_hotel_last_windows(i: Inputs) -> DataFrame:
    """Rows of the 3 newest historical hotel windows."""
    return offers.last_windows(_history(i, config.HOTEL), i.p.history_windows, materialize_input=True)


@query("drink_last_windows")
def q_drink_last_windows(i: Inputs) -> DataFrame:
    return offers.last_windows(_history(i, config.DRINK), i.p.history_windows, materialize_input=True)


@query("hotel_history_window_counts")
def q_hotel_history_counts(i: Inputs) -> DataFrame:
    """Qualifying members per newest historical window."""
    return offers.history_window_counts(_history(i, config.HOTEL), i.p.history_windows,
                                         materialize_input=True)


@query("drink_history_window_counts")
def q_drink_history_counts(i: Inputs) -> DataFrame:
    return offers.history_window_counts(_history(i, config.DRINK), i.p.history_windows,
                                         materialize_input=True)


# --- analytics ---------------------------------------------------------------

def _filtered_summary(i: Inputs, kind: str):
    lower = time_filter_lower_bound(kind, i.p.as_of)
    s = member_window_summary(restrict_window_end_after(i.tx(), lower, i.p.window), i.p.window)
    return s, time_filter(kind, i.p.as_of)


@query("all_members")
def q_all_members(i: Inputs) -> DataFrame:
    """All windows with reward status, All Time."""
    return analytics.all_members(i.summary(), i.p.hotel_threshold, i.p.drink_threshold)


@query("all_members_today")
def q_all_members_today(i: Inputs) -> DataFrame:
    """All windows with reward status, Today filter."""
    s, pred = _filtered_summary(i, "Today")
    return analytics.all_members(s, i.p.hotel_threshold, i.p.drink_threshold, pred)


@query("all_members_display")
def q_all_members_display(i: Inputs) -> DataFrame:
    """All windows with '$1,234.50' money text."""
    return analytics.all_members_display(
        analytics.all_members(i.summary(), i.p.hotel_threshold, i.p.drink_threshold))


@query("top_spenders")
def q_top_spenders(i: Inputs) -> DataFrame:
    """Top 10 (member, window) rows by spend."""
    return analytics.top_spenders(i.summary(), None, i.p.top_k)


@query("top_spenders_last_hour")
def q_top_spenders_last_hour(i: Inputs) -> DataFrame:
    s, pred = _filtered_summary(i, "Last Hour")
    return analytics.top_spenders(s, pred, i.p.top_k)


@query("overall_stats")
def q_overall_stats(i: Inputs) -> DataFrame:
    """Distinct members, revenue, transactions, average, winners/losers."""
    return analytics.overall_stats(i.summary())


@query("overall_stats_today")
def q_overall_stats_today(i: Inputs) -> DataFrame:
    s, pred = _filtered_summary(i, "Today")
    return analytics.overall_stats(s, pred)


@query("reward_eligibility_counts")
def q_reward_counts(i: Inputs) -> DataFrame:
    return analytics.reward_eligibility_counts(i.summary(), i.p.hotel_threshold, i.p.drink_threshold)


@query("reward_eligibility_distribution")
def q_reward_distribution(i: Inputs) -> DataFrame:
    return analytics.reward_eligibility_distribution(i.summary(), i.p.hotel_threshold, i.p.drink_threshold)


@query("win_loss_distribution")
def q_win_loss(i: Inputs) -> DataFrame:
    return analytics.win_loss_distribution(i.summary())


@query("game_stats")
def q_game_stats(i: Inputs) -> DataFrame:
    """Per-game performance with house edge."""
    return analytics.game_stats(i.tx())


@query("win_rate")
def q_win_rate(i: Inputs) -> DataFrame:
    return analytics.win_rate(i.tx())


@query("win_rate_by_game")
def q_win_rate_by_game(i: Inputs) -> DataFrame:
    return analytics.win_rate(i.tx(), by_game=True)


@query("member_leaderboard")
def q_leaderboard(i: Inputs) -> DataFrame:
    """All-time per-member totals with rank by spend."""
    return analytics.member_leaderboard(i.summary())


@query("approx_member_count")
def q_approx_members(i: Inputs) -> DataFrame:
    """Distinct members per window, and whether the approximate count is close to it."""
    s = i.summary()
    return analytics.approximation_check(analytics.approx_member_count(s), s)


# --- ledger and fulfilment ------------------------------------------------------

@query("redeemed_ledger")
def q_ledger(i: Inputs) -> DataFrame:
    """Ledger rows from the simulated redemption desk, one per key."""
    return i.ledger()


@query("redeemed_today")
def q_redeemed_today(i: Inputs) -> DataFrame:
    """DISTINCT (member_id, offer_type) redeemed today."""
    return ledger.redeemed_on(i.ledger_on(i.p.today), i.p.today)


@query("latest_hotel_offer")
def q_latest_hotel(i: Inputs) -> DataFrame:
    """Latest, then highest-spend hotel window per member."""
    return offers.latest_per_member(i.hotel(), "total_spend")


@query("latest_drink_offer")
def q_latest_drink(i: Inputs) -> DataFrame:
    return offers.latest_per_member(i.drink(), "loss_amount")


@query("latest_offers")
def q_latest_offers(i: Inputs) -> DataFrame:
    """Latest hotel UNION ALL latest drink offer per member."""
    return offers.latest_offer_rows(i.offer_rows())


@query("pending_offers")
def q_pending(i: Inputs) -> DataFrame:
    """Latest offer per member and type not redeemed today (F4, C2) - flagship."""
    return ledger.pending_from_rows(i.offer_rows(), i.ledger_on(i.p.today), i.p.today)


@query("pending_offers_1d")
def q_pending_1d(i: Inputs) -> DataFrame:
    return ledger.pending_from_rows(i.offer_rows("1 day"), i.ledger_on(i.p.today, "1 day"), i.p.today)


@query("pending_counts")
def q_pending_counts(i: Inputs) -> DataFrame:
    """Total / hotel / drink pending."""
    return ledger.pending_counts(q_pending(i))


@query("fulfilled_offers")
def q_fulfilled(i: Inputs) -> DataFrame:
    """All redemptions newest first with display label."""
    return ledger.fulfilled_offers(i.ledger())


@query("fulfilled_counts")
def q_fulfilled_counts(i: Inputs) -> DataFrame:
    return ledger.fulfilled_counts(ledger.fulfilled_offers(i.ledger()))


@query("fulfilled_report")
def q_fulfilled_report(i: Inputs) -> DataFrame:
    """Drink redemptions of members whose name matches 'member 1' (F9, B8, B9, B11, H5)."""
    return ledger.fulfilled_report(ledger.fulfilled_offers(i.ledger()), config.DRINK_LABEL, "member 1")


@query("offer_redeemed_check")
def q_redeemed_check(i: Inputs) -> DataFrame:
    """For every latest offer: has that member redeemed that type today?."""
    req = offers.latest_offer_rows(i.offer_rows()).select("member_id", "offer_type")
    return ledger.offer_redeemed_check(req, i.ledger_on(i.p.today), i.p.today)


@query("redeem_offers")
def q_redeem(i: Inputs) -> DataFrame:
    """Rows a redemption batch adds: every latest offer requested at as_of.

    Requests already in the ledger for that day are removed by the anti-join.
    """
    req = offers.latest_offer_rows(i.offer_rows()).select("member_id", "member_name", "offer_type",
                                                          ts_lit(i.p.as_of).alias("requested_at"))
    # every request is dated as_of, so only that day's ledger rows can collide
    return ledger.new_redemptions(req, i.ledger_on(to_date(i.p.as_of)))


# --- SQL over views ------------------------------------------------------------

SQL_OVER_VIEWS = """
SELECT member_id, member_name, COUNT(*) AS offer_windows, SUM(total_spend) AS offer_spend
FROM hotel_room_offers
WHERE total_spend >= :min_spend
GROUP BY member_id, member_name"""
SQL_OVER_VIEWS_ARGS = {"min_spend": 7500}


@query("sql_over_views")
def q_sql_over_views(i: Inputs) -> DataFrame:
    """Parameterized SQL text over the registered views."""
    from perkflow.plans.catalog import register_views, run_sql
    tx = i.tx()
    register_views(i.spark, tx, i.summary(tx=tx))
    out = run_sql(i.spark, SQL_OVER_VIEWS, SQL_OVER_VIEWS_ARGS)
    return out.withColumn("offer_spend", F.col("offer_spend").cast("double"))


# --- the live dashboard's own interval, short time filters, empty ranges ----------

LIVE = Params(as_of="2024-01-04 06:17:00", today="2024-01-04", interval_seconds=config.DEFAULT_INTERVAL_SECONDS)
EMPTY = Params(as_of="2031-01-01 00:00:00", today="2031-01-01")


def query_at(name: str, params: Params):
    """Registers a query that runs with other parameters than the fixture's."""
    def deco(fn):
        def run(spark: SparkSession, data_dir: str) -> DataFrame:
            return money_as_double(fn(Inputs(spark, data_dir, params)))
        run.__name__ = name
        run.__doc__ = fn.__doc__
        REGISTRY[name] = run
        return fn
    return deco


def _register_live() -> None:
    for kind in (config.HOTEL, config.DRINK):
        for which in ("current", "previous"):
            query_at(f"{kind}_{which}_5m", LIVE)(lambda i, k=kind, w=which: _interval(i, k, w))
    query_at("interval_qualifier_count_5m", LIVE)(q_interval_counts)
    query_at("hotel_history_today", LIVE)(lambda i: _newest_first(_history(i, config.HOTEL, "Today")))
    query_at("drink_history_last_hour", LIVE)(lambda i: _newest_first(_history(i, config.DRINK, "Last Hour")))
    query_at("drink_last_windows_today", LIVE)(
        lambda i: offers.last_windows(_history(i, config.DRINK, "Today"), i.p.history_windows, True))
    query_at("hotel_history_window_counts_today", LIVE)(
        lambda i: offers.history_window_counts(_history(i, config.HOTEL, "Today"), i.p.history_windows, True))

    def members(i):
        s, pred = _filtered_summary(i, "Last 5 Minutes")
        return analytics.all_members(s, i.p.hotel_threshold, i.p.drink_threshold, pred)

    def stats(i):
        return analytics.overall_stats(*_filtered_summary(i, "Last 5 Minutes"))

    def rewards(kind, distribution=True):
        def of(i):
            s, pred = _filtered_summary(i, kind)
            f = analytics.reward_eligibility_distribution if distribution else analytics.reward_eligibility_counts
            return f(s, i.p.hotel_threshold, i.p.drink_threshold, pred)
        return of

    query_at("all_members_last_5_minutes", LIVE)(members)
    query_at("overall_stats_last_5_minutes", LIVE)(stats)
    query_at("top_spenders_last_5_minutes", LIVE)(
        lambda i: analytics.top_spenders(*_filtered_summary(i, "Last 5 Minutes"), i.p.top_k))
    query_at("reward_eligibility_counts_last_hour", LIVE)(rewards("Last Hour", False))
    query_at("reward_eligibility_distribution_today", LIVE)(rewards("Today"))
    query_at("win_loss_distribution_last_hour", LIVE)(
        lambda i: analytics.win_loss_distribution(*_filtered_summary(i, "Last Hour")))
    # no window ends after this clock: sums over nothing must come out as the dashboard shows them
    query_at("overall_stats_empty", EMPTY)(lambda i: analytics.overall_stats_display(stats(i)))
    query_at("reward_eligibility_distribution_empty", EMPTY)(rewards("Last 5 Minutes"))
    query_at("win_loss_distribution_empty", EMPTY)(
        lambda i: analytics.win_loss_distribution(*_filtered_summary(i, "Last 5 Minutes")))

    def report(offer_filter, search=None, literal=False):
        return lambda i: ledger.fulfilled_report(ledger.fulfilled_offers(i.ledger()), offer_filter, search, literal)

    def badges(i):
        rows = _interval(i, config.HOTEL, "previous")
        return rows.select("member_id", "window_start", clock_text("window_start").alias("starts_at"),
                           redeemed_badge().alias("badge"))

    query_at("hotel_previous_badges", P)(badges)
    query_at("interval_activity", P)(
        lambda i: i.tx().where(F.col("transaction_time").isNotNull())
        .groupBy(interval_start_col(F.col("transaction_time"), config.DEFAULT_INTERVAL_SECONDS).alias("interval_start"))
        .agg(F.count("*").alias("transactions")))
    query_at("fulfilled_report_hotel", P)(report(config.HOTEL_LABEL))
    query_at("fulfilled_report_all", P)(report("All"))
    query_at("fulfilled_report_literal", P)(report("All", "MEMBER 1", True))

    def over_views(text, **which):
        def of(i):
            from perkflow.plans.catalog import register_views, run_sql
            tx = i.tx()
            register_views(i.spark, tx, i.summary(tx=tx), i.ledger() if which.get("ledger") else None,
                           leaderboard=which.get("leaderboard", False))
            return run_sql(i.spark, text)
        return of

    query_at("sql_over_summary", P)(over_views(
        "SELECT member_id, COUNT(*) AS windows, CAST(SUM(net_amount) AS DOUBLE) AS net FROM member_daily_summary "
        "GROUP BY member_id HAVING COUNT(*) >= 3"))
    query_at("sql_over_game_stats", P)(over_views(
        "SELECT game_type, house_edge FROM game_stats WHERE bet_count >= 10"))
    query_at("sql_over_ledger", P)(over_views(
        "SELECT offer_type, COUNT(*) AS redemptions, COUNT(DISTINCT member_id) AS members FROM redeemed_offers "
        "GROUP BY offer_type", ledger=True))
    query_at("sql_over_leaderboard", P)(over_views(
        "SELECT member_id, CAST(total_spend AS DOUBLE) AS total_spend, spend_rank FROM member_leaderboard "
        "WHERE spend_rank <= 20", leaderboard=True))


_register_live()


def q_summary_typed(spark: SparkSession, data_dir: str) -> DataFrame:
    """Summary columns with their own types: money as DECIMAL, the window's day as DATE."""
    return Inputs(spark, data_dir, P).summary().select(
        "member_id", "window_start", F.to_date("window_start").alias("window_date"),
        F.col("total_spend").cast("decimal(38,2)").alias("total_spend"),
        F.col("net_amount").cast("decimal(38,2)").alias("net_amount"))


REGISTRY["summary_typed"] = q_summary_typed
