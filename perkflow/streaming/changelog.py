"""Reading the summary change log.

Update mode re-emits a window every time it changes. Offers are a filter over
the summary, and a window can stop qualifying (a later win lifts a drink
window's net above -threshold), so a sink of already-filtered rows would go
stale. The change log keeps the unfiltered rows; current state is the newest
version per key, and offers are filtered when read.
"""

from __future__ import annotations

import datetime as dt

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from perkflow import config
from perkflow.functions.time import to_datetime, ts_lit
from perkflow.operators.ledger import read_ledger
from perkflow.operators.offers import drink_offers, hotel_room_offers, offer_predicate, redeemed_members
from perkflow.sources.schemas import COMPACTED_SCHEMA, SUMMARY_COLUMNS, SUMMARY_KEY


def read_changelog(spark: SparkSession, path: str) -> DataFrame:
    """All versions, with the ``batch_id`` partition column."""
    return spark.read.option("basePath", path).parquet(path)


def _fs(spark: SparkSession, path: str):
    hpath = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return hpath.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()), hpath


def _names(spark: SparkSession, path: str) -> list[str]:
    fs, hpath = _fs(spark, path)
    return [f.getPath().getName() for f in fs.listStatus(hpath)] if fs.exists(hpath) else []


def _boundary_folder(table_path: str) -> str:
    return table_path.rstrip("/") + "_boundary"


def committed_boundary(spark: SparkSession, table_path: str) -> dt.datetime | None:
    """Up to which window end the compacted table is complete.

    Each compaction commits by creating one empty file that is named after its
    boundary, as its last step; the newest one counts. Folders of the table
    under other boundaries belong to unfinished compactions and are not read.
    """
    marks = _marks(spark, table_path)
    return _EPOCH + dt.timedelta(microseconds=max(marks)) if marks else None


def _marks(spark: SparkSession, table_path: str) -> list[int]:
    return [int(n) for n in _names(spark, _boundary_folder(table_path)) if n.isdigit()]


_EPOCH = dt.datetime(1970, 1, 1)


def stored_watermark(spark: SparkSession, checkpoint: str) -> dt.datetime | None:
    """Watermark of the newest committed batch of a stream: no window ending by then changes any more."""
    done = [int(n) for n in _names(spark, f"{checkpoint}/commits") if n.isdigit()]
    if not done:
        return None
    lines = spark.read.text(f"{checkpoint}/offsets/{max(done)}")
    ms = lines.select(F.get_json_object("value", "$.batchWatermarkMs").cast("long").alias("ms")) \
        .where(F.col("ms").isNotNull()).first()
    return _EPOCH + dt.timedelta(milliseconds=ms["ms"]) if ms else None


def current_summary(spark: SparkSession, path: str, compacted_table: str | None = None) -> DataFrame:
    """Newest version of every (member, window) key.

    ``row_number() == 1`` over the key runs as a partial WindowGroupLimit on
    each map task before the shuffle, so a key updated in many batches sends
    one row per task.

    With ``compacted_table`` (see ``compact_changelog``) closed windows come
    from that table up to its committed boundary, and only change-log rows of
    windows ending after it are de-duplicated; the predicate on ``window_end``
    lets Parquet statistics skip old change-log files.
    """
    log = read_changelog(spark, path)
    boundary = committed_boundary(spark, compacted_table) if compacted_table else None
    if boundary is not None:
        log = log.where(F.col("window_end") > ts_lit(boundary))
    live = newest_versions(log)
    if boundary is None:
        return live.select(*SUMMARY_COLUMNS)
    return compacted_rows(spark, compacted_table, boundary).select(*SUMMARY_COLUMNS) \
        .unionByName(live.select(*SUMMARY_COLUMNS))


def newest_versions(log: DataFrame) -> DataFrame:
    w = Window.partitionBy(*SUMMARY_KEY).orderBy(F.col("batch_id").desc())
    return log.withColumn("_rn", F.row_number().over(w)).where(F.col("_rn") == 1).drop("_rn")


def compacted_rows(spark: SparkSession, table_path: str, boundary: dt.datetime) -> DataFrame:
    """The compacted table's committed rows, with ``window_date``; empty where it holds none."""
    last = (boundary - _EPOCH) // dt.timedelta(microseconds=1)
    paths = [f"{table_path.rstrip('/')}/boundary={m}" for m in sorted(_marks(spark, table_path)) if m <= last]
    paths = [p for p in paths if _exists(spark, p)]         # a compaction that found no window has none
    if not paths:
        return spark.createDataFrame([], COMPACTED_SCHEMA)
    return spark.read.schema(COMPACTED_SCHEMA).option("basePath", table_path).parquet(*paths) \
        .select(*COMPACTED_SCHEMA.fieldNames())


def _exists(spark: SparkSession, path: str) -> bool:
    fs, hpath = _fs(spark, path)
    return fs.exists(hpath)


def current_hotel_offers(spark: SparkSession, path: str, threshold=config.DEFAULT_HOTEL_THRESHOLD,
                         compacted_table: str | None = None) -> DataFrame:
    return hotel_room_offers(current_summary(spark, path, compacted_table), threshold)


def current_drink_offers(spark: SparkSession, path: str, threshold=config.DEFAULT_DRINK_THRESHOLD,
                         compacted_table: str | None = None) -> DataFrame:
    return drink_offers(current_summary(spark, path, compacted_table), threshold)


def flagged_offers(spark: SparkSession, path: str, ledger_path: str, kind: str, today, threshold=None,
                   compacted_table: str | None = None) -> DataFrame:
    """Windows that qualify now, with ``already_redeemed`` as the ledger stands now.

    The change log holds no flags: a redemption, or a change of day, shows at
    the next read although the window itself did not change. Only the day's
    partition of the ledger is read.
    """
    if threshold is None:
        threshold = config.DEFAULT_HOTEL_THRESHOLD if kind == config.HOTEL else config.DEFAULT_DRINK_THRESHOLD
    current = current_summary(spark, path, compacted_table).where(offer_predicate(kind, threshold))
    done = redeemed_members(read_ledger(spark, ledger_path), kind, today).withColumn("_r", F.lit(True))
    return current.join(done, "member_id", "left") \
        .select(*SUMMARY_COLUMNS, F.coalesce(F.col("_r"), F.lit(False)).alias("already_redeemed"))


def compact_changelog(spark: SparkSession, path: str, table_path: str, checkpoint: str,
                      closed_before: str | dt.datetime | None = None) -> int:
    """Move windows that ended by ``closed_before`` into a compacted summary table.

    ``checkpoint`` is the stream's checkpoint folder: by default everything
    that its stored watermark closed is compacted, and a later
    ``closed_before`` is refused, because its windows may still change.

    The table is partitioned by the boundary of the compaction that wrote a row
    and by the window's date. Closed windows never change, so a compaction only
    adds a folder, with the windows between the committed boundary and its own;
    it replaces nothing that is committed. The new boundary is committed last:
    an interrupted compaction is simply run again, and overwrites its own
    folder, or another boundary's run leaves that folder unread. Returns the
    number of rows added.
    """
    limit = stored_watermark(spark, checkpoint)
    if limit is None:
        return 0
    until = limit if closed_before is None else to_datetime(closed_before)
    if until > limit:
        raise ValueError(f"windows ending by {until} may still change: the stream's watermark is {limit}")
    before = committed_boundary(spark, table_path)
    if before is not None and until <= before:
        return 0
    log = read_changelog(spark, path).where(F.col("window_end") <= ts_lit(until))
    if before is not None:
        log = log.where(F.col("window_end") > ts_lit(before))
    fresh = newest_versions(log).select(*SUMMARY_COLUMNS, F.to_date("window_start").alias("window_date"))
    own = f"{table_path.rstrip('/')}/boundary={(until - _EPOCH) // dt.timedelta(microseconds=1)}"
    # a large day is split over several tasks and files, small ones are not scattered
    fresh.hint("rebalance", "window_date").write.mode("overwrite").partitionBy("window_date").parquet(own)
    _commit_boundary(spark, table_path, until)
    return spark.read.schema(COMPACTED_SCHEMA).parquet(own).count()


def _commit_boundary(spark: SparkSession, table_path: str, until: dt.datetime) -> None:
    micros = (until - _EPOCH) // dt.timedelta(microseconds=1)
    fs, hpath = _fs(spark, f"{_boundary_folder(table_path)}/{micros}")
    fs.createNewFile(hpath)


def expirable_batches(spark: SparkSession, path: str, compacted_table: str) -> DataFrame:
    """(batch_id) of the change-log batches whose every row is final in the compacted table.

    A batch folder is no longer needed once the newest window it holds ended at
    or before the committed boundary; a retention job may remove it.
    """
    boundary = committed_boundary(spark, compacted_table)
    newest = read_changelog(spark, path).groupBy("batch_id").agg(F.max("window_end").alias("newest"))
    done = F.lit(False) if boundary is None else F.col("newest") <= ts_lit(boundary)
    return newest.where(done).select("batch_id")
