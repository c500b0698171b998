"""Continuously maintained all-time views: game performance and member totals.

Both are keyed aggregates without a time window: the game view has one state
row per game, the member view one per (member, name), held in the state store
(RocksDB) and updated incrementally. Each micro-batch writes its changed rows
to a change log (``batch_id=`` folders, overwritten on retry); the current
view is the newest row per key, and derived columns (house edge, rank) are
computed when the view is read, so they always reflect the latest totals.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from perkflow.operators.ranking import with_global_rank
from perkflow.operators.summary import net_expr, spend_expr, winnings_expr
from perkflow.streaming.summary_stream import _batch_writer, _start, _trigger


def game_totals_stream(tx: DataFrame) -> DataFrame:
    """Per-game bet/win counts and amounts, updated as transactions arrive."""
    typ, amt = F.col("transaction_type"), F.col("amount")
    return tx.groupBy("game_type").agg(
        F.count_if(typ == "bet").alias("bet_count"),
        F.count_if(typ == "win").alias("win_count"),
        F.sum(spend_expr(typ, amt)).alias("total_bet"),
        F.sum(winnings_expr(typ, amt)).alias("total_won"),
    )


def member_totals_stream(tx: DataFrame) -> DataFrame:
    """All-time per-member totals (the leaderboard's input), updated incrementally."""
    typ, amt, t = F.col("transaction_type"), F.col("amount"), F.col("transaction_time")
    return tx.groupBy("member_id", "member_name").agg(
        F.sum(spend_expr(typ, amt)).alias("total_spend"),
        F.sum(winnings_expr(typ, amt)).alias("total_winnings"),
        F.sum(net_expr(typ, amt)).alias("net_amount"),
        F.count(F.lit(1)).alias("transaction_count"),
        F.max(t).alias("last_transaction"),
    )


def start_totals_changelog(totals: DataFrame, path: str, checkpoint: str,
                           trigger: str | None = "availableNow",
                           n_state_partitions: int | None = None) -> StreamingQuery:
    """Update-mode keyed totals -> change log."""
    w = (totals.writeStream.outputMode("update").option("checkpointLocation", checkpoint)
         .foreachBatch(_batch_writer(path)))
    return _start(_trigger(w, trigger), totals.sparkSession, n_state_partitions)


def latest_by_key(spark: SparkSession, path: str, key: list[str]) -> DataFrame:
    """Newest row per key of a change log (partial WindowGroupLimit before the shuffle)."""
    log = spark.read.option("basePath", path).parquet(path)
    w = Window.partitionBy(*key).orderBy(F.col("batch_id").desc())
    return log.withColumn("_rn", F.row_number().over(w)).where(F.col("_rn") == 1).drop("_rn", "batch_id")


def current_game_stats(spark: SparkSession, path: str) -> DataFrame:
    """Current game view with house edge = (bet - won) / bet."""
    g = latest_by_key(spark, path, ["game_type"])
    bet, won = F.col("total_bet").cast("double"), F.col("total_won").cast("double")
    return g.withColumn("house_edge", F.when(bet != 0, (bet - won) / bet)).select(
        "game_type", "bet_count", "win_count", "total_bet", "total_won", "house_edge")


def current_leaderboard(spark: SparkSession, path: str, partitions: int | None = None) -> DataFrame:
    """Current all-time member totals ranked by spend (distributed global rank, see ranking.py)."""
    totals = latest_by_key(spark, path, ["member_id", "member_name"])
    ranked = with_global_rank(totals, "total_spend", True, "spend_rank", partitions)
    return ranked.orderBy(F.col("spend_rank"), F.col("member_id"), F.col("member_name"))
