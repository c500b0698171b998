"""Redemption ledger: one offer per member, type and day.

The ledger is an append-only Parquet table partitioned by ``redemption_date``.
Parquet has no primary key or MERGE, so uniqueness of (member_id, offer_type,
redemption_date) rests on three things: a single writer, de-duplication of
each request batch on the key, and a left-anti join against the rows already
stored. Re-running the same batch appends nothing.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from perkflow import config
from perkflow.functions.text import datetime_text, name_matches, offer_display, offer_type_of_label
from perkflow.functions.time import date_lit
from perkflow.operators.offers import latest_offer_rows, latest_offers
from perkflow.sources.schemas import LEDGER_COLUMNS, LEDGER_KEY, LEDGER_SCHEMA


def redemption_rows(requests: DataFrame) -> DataFrame:
    """Requests (member_id, member_name, offer_type, requested_at) -> ledger-shaped rows.

    ``redeemed_at`` is truncated to whole seconds and the date derived from it.
    Rows with a NULL in any ledger column are dropped (the ledger is NOT NULL).
    The truncation stays on the naive wall time (no detour through the session
    time zone, whose DST gaps could shift it).
    """
    r = F.col("requested_at").cast("timestamp_ntz")
    at = F.make_timestamp_ntz(F.year(r), F.month(r), F.dayofmonth(r), F.hour(r), F.minute(r), F.second(r))
    rows = requests.select(
        F.col("member_id").cast("long").alias("member_id"),
        F.col("member_name").cast("string").alias("member_name"),
        F.col("offer_type").cast("string").alias("offer_type"),
        at.alias("redeemed_at"),
        F.to_date(at).alias("redemption_date"),
    )
    return rows.dropna(subset=LEDGER_COLUMNS)


def first_per_key(rows: DataFrame) -> DataFrame:
    """Earliest request per ledger key (the first insert wins, as with a primary key).

    Planned as a partial WindowGroupLimit before the shuffle, so a key with
    very many duplicate requests forwards one row per map task.
    """
    w = Window.partitionBy(*LEDGER_KEY).orderBy(F.col("redeemed_at").asc(), F.col("member_name").asc())
    return rows.withColumn("_rn", F.row_number().over(w)).where(F.col("_rn") == 1).drop("_rn")


def new_redemptions(requests: DataFrame, ledger: DataFrame | None) -> DataFrame:
    """Rows a batch of requests adds to the ledger: de-duplicated, not yet stored."""
    rows = first_per_key(redemption_rows(requests))
    if ledger is None:
        return rows
    return rows.join(ledger.select(*LEDGER_KEY), LEDGER_KEY, "left_anti")


def empty_ledger(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame([], LEDGER_SCHEMA)


def read_ledger(spark: SparkSession, path: str, first_day=None, last_day=None) -> DataFrame:
    """Ledger table at ``path`` (empty if nothing was written yet), pruned to the days asked for.

    Read-side key de-duplication guards against a second writer having
    slipped in; with a single writer it removes nothing.
    """
    if not _exists(spark, path):
        return empty_ledger(spark)
    df = spark.read.schema(LEDGER_SCHEMA).parquet(path).select(*LEDGER_COLUMNS)
    if first_day is not None:
        df = df.where(F.col("redemption_date") >= date_lit(first_day))
    if last_day is not None:
        df = df.where(F.col("redemption_date") <= date_lit(last_day))
    return first_per_key(df)


def append_redemptions(spark: SparkSession, requests: DataFrame, path: str) -> int:
    """Single-writer append of a request batch; returns the number of rows added.

    The batch is staged first (cuts the lineage back to its source). Its first
    and last date, two values, bound what is read of the stored ledger: only
    those date partitions are de-duplicated and anti-joined. The new rows are
    staged too, so the append never re-reads files it is writing.
    """
    staging = f"{path.rstrip('/')}_staging"
    first_per_key(redemption_rows(requests)).write.mode("overwrite").parquet(f"{staging}/batch")
    batch = spark.read.schema(LEDGER_SCHEMA).parquet(f"{staging}/batch")
    first, last = batch.agg(F.min("redemption_date"), F.max("redemption_date")).first()
    if first is None:
        return 0
    fresh = batch
    if _exists(spark, path):
        stored = read_ledger(spark, path, first, last).select(*LEDGER_KEY)
        batch.join(stored, LEDGER_KEY, "left_anti").write.mode("overwrite").parquet(f"{staging}/fresh")
        fresh = spark.read.schema(LEDGER_SCHEMA).parquet(f"{staging}/fresh")
    n = fresh.count()
    if n:
        # few files a day: not one per task and day
        fresh.select(*LEDGER_COLUMNS).hint("rebalance", "redemption_date") \
            .write.mode("append").partitionBy("redemption_date").parquet(path)
    return n


def _exists(spark: SparkSession, path: str) -> bool:
    jvm = spark.sparkContext._jvm
    hpath = jvm.org.apache.hadoop.fs.Path(path)
    fs = hpath.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    return fs.exists(hpath)


def redeemed_on(ledger: DataFrame, day) -> DataFrame:
    """Distinct (member_id, offer_type) redeemed on ``day``.

    The date predicate prunes partitions of a date-partitioned ledger.
    """
    return (ledger.where(F.col("redemption_date") == date_lit(day))
            .select("member_id", "offer_type").distinct())


def offer_redeemed_check(requests: DataFrame, ledger: DataFrame, day) -> DataFrame:
    """Set form of the per-member check: has (member, type) redeemed on ``day``?.

    One aggregate over the day's ledger partition and one left join for the
    whole batch, instead of one lookup per member.
    """
    counts = (ledger.where(F.col("redemption_date") == date_lit(day))
              .groupBy("member_id", "offer_type").agg(F.count(F.lit(1)).alias("redeemed_count")))
    out = requests.join(counts, ["member_id", "offer_type"], "left")
    return out.withColumn("redeemed_count", F.coalesce(F.col("redeemed_count"), F.lit(0))) \
              .withColumn("already_redeemed", F.col("redeemed_count") > 0)


def pending_offers(hotel: DataFrame, drink: DataFrame, ledger: DataFrame, today) -> DataFrame:
    """Latest offer per member and type that was not redeemed ``today``."""
    return pending_from_latest(latest_offers(hotel, drink), ledger, today)


def pending_from_rows(rows: DataFrame, ledger: DataFrame, today) -> DataFrame:
    """F4 from single-pass offer rows (see offers.offer_rows)."""
    return pending_from_latest(latest_offer_rows(rows), ledger, today)


def pending_from_latest(latest: DataFrame, ledger: DataFrame, today) -> DataFrame:
    """Latest offers minus today's redemptions, newest window first, then the larger metric.

    Written as a left-anti join (Catalyst does not turn LEFT JOIN + IS NULL
    into one). Today's redemptions are at most one row per member and type;
    the planner broadcasts them only when their measured size is under the
    broadcast threshold and sort-merges otherwise.
    """
    done = redeemed_on(ledger, today)
    return (latest.join(done, ["member_id", "offer_type"], "left_anti").select(*latest.columns)
            .orderBy(F.col("window_end").desc(), F.col("metric_value").desc(),
                     F.col("member_id"), F.col("offer_type")))


def pending_counts(pending: DataFrame) -> DataFrame:
    """Total / hotel / drink pending."""
    t = F.col("offer_type")
    return pending.agg(
        F.count(F.lit(1)).alias("total_pending"),
        F.count_if(t == config.HOTEL).alias("pending_hotel"),
        F.count_if(t == config.DRINK).alias("pending_drink"),
    )


def fulfilled_offers(ledger: DataFrame) -> DataFrame:
    """All redemptions, newest first, with a display label."""
    return (ledger.select("member_id", "member_name", "offer_type", "redeemed_at",
                          offer_display("offer_type").alias("offer_display"))
            .orderBy(F.col("redeemed_at").desc(), F.col("member_id"), F.col("offer_type")))


def fulfilled_counts(fulfilled: DataFrame) -> DataFrame:
    """Total / hotel / drink / distinct members fulfilled."""
    t = F.col("offer_type")
    return fulfilled.agg(
        F.count(F.lit(1)).alias("total_fulfilled"),
        F.count_if(t == config.HOTEL).alias("fulfilled_hotel"),
        F.count_if(t == config.DRINK).alias("fulfilled_drink"),
        F.countDistinct("member_id").alias("unique_members"),
    )


def filter_fulfilled(fulfilled: DataFrame, offer_filter: str = "All",
                     member_search: str | None = None, literal: bool = False) -> DataFrame:
    """Keep one offer type (by display label, or All) and a name search."""
    out = fulfilled
    code = offer_type_of_label(offer_filter)
    if offer_filter != "All":
        if code is None:
            raise ValueError(f"unknown offer filter {offer_filter!r}")
        out = out.where(F.col("offer_type") == code)
    if member_search:
        out = out.where(name_matches("member_name", member_search, literal))
    return out


def fulfilled_report(fulfilled: DataFrame, offer_filter: str = "All",
                     member_search: str | None = None, literal: bool = False) -> DataFrame:
    """Filtered report with display headers and a text timestamp."""
    h = config.FULFILLMENT_CSV_HEADERS
    out = filter_fulfilled(fulfilled, offer_filter, member_search, literal)
    return out.orderBy(F.col("redeemed_at").desc(), F.col("member_id"), F.col("offer_type")).select(
        F.col("member_id").alias(h[0]),
        F.col("member_name").alias(h[1]),
        F.col("offer_display").alias(h[2]),
        datetime_text("redeemed_at").alias(h[3]),
    )
