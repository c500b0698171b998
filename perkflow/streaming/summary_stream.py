"""Incremental member summary.

Transactions stream in, get an event-time watermark (10 s allowed lateness)
and are aggregated into tumbling windows by the same function the batch path
uses. Two emit policies:

* update mode (default, results visible while a window is open): every
  micro-batch writes the changed summary rows to a change log folder
  ``batch_id=<n>``; the current table is the newest version of every key.
* append mode ("emit on window close"): one final row per window once the
  watermark passes its end.

Each micro-batch overwrites only its own ``batch_id`` folder, so a batch that
is re-run after a failure replaces its output instead of duplicating it. The
stream's progress and aggregation state live under ``checkpointLocation``.
"""

from __future__ import annotations

import os
import time
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming import StreamingQuery, StreamingQueryListener

from perkflow import config
from perkflow.functions.time import instant_to_ntz, ntz_to_instant
from perkflow.operators.summary import member_window_summary, net_expr, spend_expr, winnings_expr
from perkflow.session import STATE_CONF
from perkflow.sources.events_adapter import transactions_from_events
from perkflow.sources.files import stream_parquet_table

TIME_COL = "transaction_time"
INSTANT_OUTPUT_COLS = ("window_start", "window_end", "last_transaction")


def with_event_time(tx: DataFrame, delay: str = config.WATERMARK_DELAY,
                    time_col: str = TIME_COL) -> DataFrame:
    """Event time as an instant (watermarks need TimestampType) plus the watermark."""
    if isinstance(tx.schema[time_col].dataType, T.TimestampNTZType):
        tx = tx.withColumn(time_col, ntz_to_instant(F.col(time_col)))
    return tx.withWatermark(time_col, delay)


def summary_stream(tx: DataFrame, window: str = config.DEFAULT_WINDOW,
                   delay: str = config.WATERMARK_DELAY) -> DataFrame:
    """Streaming member summary (I2 tumbling windows, I6 incremental state)."""
    return member_window_summary(with_event_time(tx, delay), window)


def rollup_stream(tx: DataFrame, fine: str = config.DEFAULT_WINDOW, coarse: str = "1 day",
                  delay: str = config.WATERMARK_DELAY) -> DataFrame:
    """Chained time-window aggregation: fine windows rolled into coarse ones.

    Two stateful aggregates in one append-mode query: the fine windows close
    as the watermark passes them, and their ``window_time`` feeds the coarse
    windows, so no state holds raw transactions for a whole day.
    """
    t = with_event_time(tx, delay)
    typ, amount = F.col("transaction_type"), F.col("amount")
    fine_agg = t.groupBy("member_id", "member_name", F.window(TIME_COL, fine).alias("w")).agg(
        F.sum(spend_expr(typ, amount)).alias("total_spend"),
        F.sum(winnings_expr(typ, amount)).alias("total_winnings"),
        F.sum(net_expr(typ, amount)).alias("net_amount"),
        F.count(F.lit(1)).alias("transaction_count"),
        F.max(TIME_COL).alias("last_transaction"))
    coarse_agg = fine_agg.groupBy("member_id", "member_name",
                                  F.window(F.window_time("w"), coarse).alias("w")).agg(
        F.sum("total_spend").alias("total_spend"),
        F.sum("total_winnings").alias("total_winnings"),
        F.sum("net_amount").alias("net_amount"),
        F.sum("transaction_count").alias("transaction_count"),
        F.max("last_transaction").alias("last_transaction"))
    return coarse_agg.select("member_id", "member_name", F.col("w.start").alias("window_start"),
                             F.col("w.end").alias("window_end"), "total_spend", "total_winnings",
                             "net_amount", "transaction_count", "last_transaction")


def approx_members_stream(tx: DataFrame, window: str = config.DEFAULT_WINDOW,
                          delay: str = config.WATERMARK_DELAY, rsd: float = 0.05) -> DataFrame:
    """Streaming form of the distinct-member count per window.

    Exact COUNT(DISTINCT) is not supported on streams; the HyperLogLog++ sketch
    keeps a fixed-size state per window instead of every member id.
    """
    t = with_event_time(tx, delay)
    agg = t.groupBy(F.window(TIME_COL, window).alias("w")).agg(
        F.approx_count_distinct("member_id", rsd).alias("approx_members"))
    return agg.select(F.col("w.start").alias("window_start"), F.col("w.end").alias("window_end"),
                      "approx_members")


def events_transaction_stream(spark: SparkSession, data_dir: str,
                              max_files_per_trigger: int | None = None) -> DataFrame:
    """The data folder's events table as a stream of transactions."""
    return transactions_from_events(stream_parquet_table(spark, data_dir, "events", max_files_per_trigger))


def to_wall_time(df: DataFrame) -> DataFrame:
    """Instant columns of a summary batch back to naive UTC wall time (batch shape)."""
    for c in INSTANT_OUTPUT_COLS:
        if c in df.columns and isinstance(df.schema[c].dataType, T.TimestampType):
            df = df.withColumn(c, instant_to_ntz(F.col(c)))
    return df


def _batch_writer(path: str, files_per_batch: int | None = None):
    """Write one micro-batch into its own ``batch_id=`` folder.

    ``files_per_batch`` bounds the number of files per batch (a repartition of
    the batch's output rows only); without it every state partition writes
    one file per trigger.
    """
    def write(batch: DataFrame, batch_id: int) -> None:
        out = to_wall_time(batch)
        if files_per_batch:
            out = out.repartition(files_per_batch)
        out.write.mode("overwrite").parquet(os.path.join(path, f"batch_id={batch_id}"))
    return write


@contextmanager
def state_partitions(spark: SparkSession, n: int | None):
    """Number of state-store partitions for a stream started inside the block.

    A streaming query fixes its state partitioning at its first start from
    ``spark.sql.shuffle.partitions`` and keeps it in the checkpoint; ``start()``
    snapshots the session conf, so the setting is applied only around it and
    the caller's value is restored afterwards. A restarted query keeps the
    count stored in its checkpoint.
    """
    with _set_for_now(spark, {"spark.sql.shuffle.partitions": str(n)} if n else {}):
        yield


@contextmanager
def state_store(spark: SparkSession):
    """The state store of a stream started inside the block: RocksDB with bounded memory.

    Without it a session that ``build_session`` did not make keeps all open windows
    on the executors' heaps. What the session itself sets about the store holds, and
    a restarted query keeps the store of its checkpoint.
    """
    with _set_for_now(spark, {k: v for k, v in STATE_CONF.items() if spark.conf.get(k, None) is None}):
        yield


@contextmanager
def _set_for_now(spark: SparkSession, conf: dict[str, str]):
    """Session settings inside the block; afterwards each is as it was, set or not."""
    old = {k: spark.conf.get(k, None) for k in conf}
    try:
        for k, v in conf.items():
            spark.conf.set(k, v)
        yield
    finally:
        for k, v in old.items():
            spark.conf.unset(k) if v is None else spark.conf.set(k, v)


def _start(writer, spark: SparkSession, n_state: int | None) -> StreamingQuery:
    with state_partitions(spark, n_state), state_store(spark):
        return writer.start()


def _trigger(writer, trigger: str | None):
    if trigger in (None, "availableNow"):
        return writer.trigger(availableNow=True)
    if trigger == "once":
        return writer.trigger(once=True)
    return writer.trigger(processingTime=trigger)  # I11: e.g. "5 seconds"


def start_summary_changelog(summary: DataFrame, changelog_path: str, checkpoint: str,
                            trigger: str | None = "availableNow",
                            query_name: str | None = None,
                            files_per_batch: int | None = None,
                            n_state_partitions: int | None = None) -> StreamingQuery:
    """Update-mode summary -> change log."""
    w = (summary.writeStream.outputMode("update")
         .option("checkpointLocation", checkpoint)
         .foreachBatch(_batch_writer(changelog_path, files_per_batch)))
    if query_name:
        w = w.queryName(query_name)
    return _start(_trigger(w, trigger), summary.sparkSession, n_state_partitions)


def start_summary_on_close(summary: DataFrame, closed_path: str, checkpoint: str,
                           trigger: str | None = "availableNow",
                           files_per_batch: int | None = None,
                           n_state_partitions: int | None = None) -> StreamingQuery:
    """Append-mode summary: one final row per window after the watermark passes it (I4)."""
    w = (summary.writeStream.outputMode("append")
         .option("checkpointLocation", checkpoint)
         .foreachBatch(_batch_writer(closed_path, files_per_batch)))
    return _start(_trigger(w, trigger), summary.sparkSession, n_state_partitions)


class LateRows(StreamingQueryListener):
    """Rows that stateful operators dropped as too late, by query id, over the whole run.

    Add it with ``spark.streams.addListener`` before the query starts. The
    query's own ``recentProgress`` keeps only its latest entries and would
    undercount a long stream.
    """

    def __init__(self):
        self.dropped: dict[str, int] = {}
        self.ended: set[str] = set()

    def onQueryStarted(self, event) -> None:
        pass

    def onQueryProgress(self, event) -> None:
        key = str(event.progress.id)
        late = sum(op.numRowsDroppedByWatermark for op in event.progress.stateOperators)
        self.dropped[key] = self.dropped.get(key, 0) + late

    def onQueryIdle(self, event) -> None:
        pass

    def onQueryTerminated(self, event) -> None:
        self.ended.add(str(event.id))

    def total(self, query: StreamingQuery, wait_s: float = 30) -> int:
        """Total of a query; waits for the events of one that has ended."""
        until = time.monotonic() + wait_s
        while not query.isActive and query.id not in self.ended and time.monotonic() < until:
            time.sleep(0.05)
        return self.dropped.get(query.id, 0)


def run_to_completion(query: StreamingQuery, timeout_s: float | None = None) -> StreamingQuery:
    """Wait for an availableNow/once query to finish, however long; surface its failure."""
    finished = query.awaitTermination(timeout_s)
    if timeout_s is not None and not finished:
        query.stop()
        raise TimeoutError(f"stream {query.id} did not finish within {timeout_s}s")
    if query.exception() is not None:
        raise RuntimeError(f"stream failed: {query.exception()}")
    return query
