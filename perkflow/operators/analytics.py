"""Dashboard analytics over the summary and the transactions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from perkflow import config
from perkflow.functions.text import money_text
from perkflow.operators.offers import drink_predicate, hotel_predicate, reward_status
from perkflow.operators.ranking import with_global_rank


def _where(df: DataFrame, predicate: Column | None) -> DataFrame:
    return df if predicate is None else df.where(predicate)


def overall_stats(summary: DataFrame, time_predicate: Column | None = None) -> DataFrame:
    """Distinct members, revenue, transactions, average spend, winning/losing rows.

    Averages and winning/losing counts are over (member, window) rows, as the
    dashboard computes them. The average is the exact decimal sum divided by
    the count in double, so it does not depend on summation order.
    """
    net = F.col("net_amount")
    return _where(summary, time_predicate).agg(
        F.countDistinct("member_id").alias("total_members"),
        F.sum("total_spend").alias("total_revenue"),
        F.sum("transaction_count").alias("total_transactions"),
        (F.sum("total_spend").cast("double") / F.count("total_spend")).alias("avg_spend_per_member"),
        F.sum(F.when(net >= 0, 1).otherwise(0)).cast("long").alias("winning_members"),
        F.sum(F.when(net < 0, 1).otherwise(0)).cast("long").alias("losing_members"),
    )


def overall_stats_display(stats: DataFrame) -> DataFrame:
    """Empty-table aggregates (NULL) shown as 0, as the dashboard does."""
    return stats.select(*[F.coalesce(F.col(c), F.lit(0)).alias(c) for c in stats.columns])


def reward_eligibility_counts(summary: DataFrame,
                              hotel_threshold=config.DEFAULT_HOTEL_THRESHOLD,
                              drink_threshold=config.DEFAULT_DRINK_THRESHOLD,
                              time_predicate: Column | None = None) -> DataFrame:
    """Hotel-eligible, drink-eligible and total rows (D3); a row can count twice."""
    return _where(summary, time_predicate).agg(
        F.sum(F.when(hotel_predicate(hotel_threshold), 1).otherwise(0)).cast("long").alias("hotel_eligible"),
        F.sum(F.when(drink_predicate(drink_threshold), 1).otherwise(0)).cast("long").alias("drink_eligible"),
        F.count(F.lit(1)).alias("total"),
    )


def reward_eligibility_distribution(summary: DataFrame,
                                    hotel_threshold=config.DEFAULT_HOTEL_THRESHOLD,
                                    drink_threshold=config.DEFAULT_DRINK_THRESHOLD,
                                    time_predicate: Column | None = None) -> DataFrame:
    """(reward, reward_count): hotel, drink and the remainder total - hotel - drink.

    Windows eligible for both are subtracted twice in the remainder, exactly as
    the dashboard's bar chart shows it. Empty aggregates count as 0.
    """
    return eligibility_rows(reward_eligibility_counts(summary, hotel_threshold, drink_threshold, time_predicate))


def eligibility_rows(counts: DataFrame) -> DataFrame:
    """The rows of D4 from the counts of D3."""
    h = F.coalesce(F.col("hotel_eligible"), F.lit(0)).cast("long")
    d = F.coalesce(F.col("drink_eligible"), F.lit(0)).cast("long")
    t = F.coalesce(F.col("total"), F.lit(0)).cast("long")
    names = config.DISTRIBUTION_REWARD_NAMES
    arr = F.array(
        F.struct(F.lit(names[0]).alias("reward"), h.alias("reward_count")),
        F.struct(F.lit(names[1]).alias("reward"), d.alias("reward_count")),
        F.struct(F.lit(names[2]).alias("reward"), (t - h - d).alias("reward_count")),
    )
    return counts.select(F.inline(arr))


def win_loss_distribution(summary: DataFrame, time_predicate: Column | None = None) -> DataFrame:
    """(status, status_count, percent) for Winners / Losers."""
    return win_loss_rows(overall_stats(summary, time_predicate))


def win_loss_rows(stats: DataFrame) -> DataFrame:
    """The rows of D5 from the statistics of D2."""
    w = F.coalesce(F.col("winning_members"), F.lit(0)).cast("long")
    lo = F.coalesce(F.col("losing_members"), F.lit(0)).cast("long")
    total = w + lo
    names = config.DISTRIBUTION_STATUS_NAMES

    def pct(x: Column) -> Column:
        return F.when(total > 0, x.cast("double") * 100.0 / total.cast("double"))

    return stats.select(F.inline(F.array(
        F.struct(F.lit(names[0]).alias("status"), w.alias("status_count"), pct(w).alias("percent")),
        F.struct(F.lit(names[1]).alias("status"), lo.alias("status_count"), pct(lo).alias("percent")),
    )))


def top_spenders(summary: DataFrame, time_predicate: Column | None = None, limit: int = 10) -> DataFrame:
    """Top-``limit`` (member, window) rows by spend (F8); a member may appear twice.

    ORDER BY + LIMIT plans as TakeOrderedAndProject: each task keeps its own
    top-k, only k rows per task reach the final merge.
    """
    return (_where(summary, time_predicate)
            .orderBy(F.col("total_spend").desc(), F.col("member_id"), F.col("window_start"))
            .limit(limit)
            .select("member_name", "total_spend", "transaction_count", "net_amount"))


def all_members(summary: DataFrame, hotel_threshold=config.DEFAULT_HOTEL_THRESHOLD,
                drink_threshold=config.DEFAULT_DRINK_THRESHOLD,
                time_predicate: Column | None = None) -> DataFrame:
    """Every (member, window) row with its reward status, highest spend first."""
    return (_where(summary, time_predicate)
            .select("member_id", "member_name", "total_spend", "transaction_count", "net_amount",
                    "last_transaction", reward_status(hotel_threshold, drink_threshold).alias("reward_status"))
            .orderBy(F.col("total_spend").desc(), F.col("member_id"), F.col("last_transaction")))


def all_members_display(members: DataFrame) -> DataFrame:
    """Money columns as '$1,234.50' text (H8)."""
    return (members.withColumn("total_spend", money_text("total_spend"))
            .withColumn("net_amount", money_text("net_amount")))


def game_stats(tx: DataFrame) -> DataFrame:
    """Per game: bets, wins, amounts and house edge = (bet - won) / bet."""
    typ, amt = F.col("transaction_type"), F.col("amount")
    out = tx.groupBy("game_type").agg(
        F.count_if(typ == "bet").alias("bet_count"),
        F.count_if(typ == "win").alias("win_count"),
        F.sum(F.when(typ == "bet", amt).otherwise(F.lit(0))).alias("total_bet"),
        F.sum(F.when(typ == "win", amt).otherwise(F.lit(0))).alias("total_won"),
    )
    bet, won = F.col("total_bet").cast("double"), F.col("total_won").cast("double")
    return out.withColumn("house_edge", F.when(bet != 0, (bet - won) / bet)).orderBy(
        F.col("house_edge").desc_nulls_last(), F.col("game_type"))


def win_rate(tx: DataFrame, by_game: bool = False) -> DataFrame:
    """Wins per bet, overall or per game."""
    typ = F.col("transaction_type")
    aggs = [F.count_if(typ == "bet").alias("bets"), F.count_if(typ == "win").alias("wins")]
    out = tx.groupBy("game_type").agg(*aggs) if by_game else tx.agg(*aggs)
    rate = F.when(F.col("bets") > 0, F.col("wins").cast("double") / F.col("bets"))
    return out.withColumn("win_rate", rate)


def member_totals(summary: DataFrame) -> DataFrame:
    """All-time totals per member (re-aggregates the window summary)."""
    return summary.groupBy("member_id", "member_name").agg(
        F.sum("total_spend").alias("total_spend"),
        F.sum("total_winnings").alias("total_winnings"),
        F.sum("net_amount").alias("net_amount"),
        F.sum("transaction_count").alias("transaction_count"),
        F.count(F.lit(1)).alias("active_windows"),
        F.max("last_transaction").alias("last_transaction"),
    )


def member_leaderboard(summary: DataFrame, partitions: int | None = None) -> DataFrame:
    """All-time member totals ranked by spend, rank() semantics.

    The rank is computed without a single-partition window (see ranking.py).
    """
    ranked = with_global_rank(member_totals(summary), "total_spend", True, "spend_rank", partitions)
    return ranked.orderBy(F.col("spend_rank"), F.col("member_id"), F.col("member_name"))


def approx_member_count(summary: DataFrame, rsd: float = 0.05) -> DataFrame:
    """Approximate distinct members per window (D13) over the summary."""
    return summary.groupBy("window_start", "window_end").agg(
        F.approx_count_distinct("member_id", rsd).alias("approx_members"))


def approximation_check(approx: DataFrame, summary: DataFrame, rsd: float = 0.05) -> DataFrame:
    """Per window: the exact member count, and whether the approximate one is within 3 deviations (at least 1)."""
    exact = summary.groupBy("window_start", "window_end").agg(F.count_distinct("member_id").alias("members"))
    off = F.abs(F.col("approx_members") - F.col("members"))
    return exact.join(approx, ["window_start", "window_end"], "left").select(
        "window_start", "window_end", "members",
        F.coalesce(off <= F.greatest(F.lit(1.0), 3 * rsd * F.col("members")), F.lit(False)).alias("approximation_holds"))
