"""The dashboard's tables kept current by deltas: statistics, offers, latest offers, late rows.

One streaming query reads the transactions. Each micro-batch adds its partial
sums to the windows that may still change, and from a window's previous and new
version everything else follows without reading the summary again:

* ``windows``: the summary. A version holds the windows still open, each as a
  whole, and those that just closed, which no later batch touches.
* ``offer_log``: insert (+1) and retract (-1) rows of both offers, from a
  window's old against its new version (I7). Added up it is the offers.
* ``stats``: additive totals per window, hour and day (D2-D5, D8, D9, I10), with a
  mergeable sketch of the members (D13). A time range is answered from the
  fewest stored rows. Its parts are months: their rows are few, however many
  transactions there are, and a version that touches years writes few files.
* ``members``: windows per member, so that a distinct count is a row count.
* ``totals`` and ``histogram``: all-time totals per member, and how many members
  have each total spend, in bands of growing width; a rank is the members in the
  bands above and those above in the own band (D12, E4).
* ``latest``: per member the open offers and the newest closed one per type (E1,
  E2, F4).
* ``late``: transactions whose window had closed (I5), by the rule of Spark's
  stateful aggregate: the window's end is not after the previous batches' newest
  event time less the allowed lateness. ``correct_late`` merges them.

A micro-batch may hold several arrivals, numbered by an ``arrival`` column. They
take effect one after the other, nulls first: each is late or not by what came
before it, and each changes the windows it touches, which are emitted again, with
their offers retracted and inserted again. So a backlog of many arrivals needs few
micro-batches, and gives the rows that one micro-batch for each of them gives.

Keyed tables are rewritten by touched part only, see ``versions``. A batch that
is run again after its commit does nothing, before it replaces its own files.
``stats`` and ``latest`` use the offer thresholds that the job was started with.
"""

from __future__ import annotations

import datetime as dt
from collections.abc import Callable
from concurrent.futures import ThreadPoolExecutor
from dataclasses import dataclass, field

from pyspark import inheritable_thread_target
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming import StreamingQuery

from perkflow import config
from perkflow.functions.time import date_lit, duration_seconds, instant_to_ntz, ts_lit
from perkflow.operators import offers
from perkflow.operators.offers import drink_predicate, hotel_predicate, latest_offer_rows, offer_rows
from perkflow.operators.summary import member_window_summary
from perkflow.sources.schemas import COMPACTED_SCHEMA, SUMMARY_COLUMNS, SUMMARY_KEY, TRANSACTIONS_COLUMNS, TRANSACTIONS_SCHEMA
from perkflow.streaming.summary_stream import TIME_COL, _trigger
from perkflow.streaming.versions import Commit, Versions

HOUR, DAY = 3600, 86_400
MONEY = T.DecimalType(28, 2)
_EPOCH = dt.datetime(1970, 1, 1)

SUMS = ["total_spend", "total_winnings", "net_amount", "transaction_count"]
OFFER_COLUMNS = ["member_id", "member_name", "offer_type", "metric_value", "window_start", "window_end"]
COUNTS = ["windows", "spend_rows", "transactions", "winning", "losing", "hotel", "drink"]

ARRIVAL = "arrival"
#: ``closed`` of a version that a later arrival of its own micro-batch replaced: a change, but not a row of the summary.
REPLACED = 2

WINDOWS_SCHEMA = T.StructType([*COMPACTED_SCHEMA.fields[:-1], T.StructField(ARRIVAL, T.LongType()),
                               T.StructField("changed", T.BooleanType()),
                               T.StructField("old", T.StructType(COMPACTED_SCHEMA.fields[4:9])),
                               T.StructField("version", T.LongType()), T.StructField("closed", T.IntegerType()),
                               T.StructField("window_date", T.DateType())])
FRESH_SCHEMA = T.StructType([*COMPACTED_SCHEMA.fields[:-1], T.StructField(ARRIVAL, T.LongType())])
STATS_SCHEMA = T.StructType([
    T.StructField("size", T.IntegerType()), T.StructField("window_start", T.TimestampNTZType()),
    T.StructField("window_end", T.TimestampNTZType()), T.StructField("revenue", MONEY),
    *[T.StructField(c, T.LongType()) for c in COUNTS], T.StructField("members", T.BinaryType()),
    T.StructField("first_day", T.DateType())])     # of the month
MEMBERS_SCHEMA = T.StructType([T.StructField("member_id", T.LongType()), T.StructField("windows", T.LongType()),
                               T.StructField("bucket", T.IntegerType())])
LATEST_SCHEMA = T.StructType([
    T.StructField("member_id", T.LongType()), T.StructField("member_name", T.StringType()),
    T.StructField("offer_type", T.StringType()), T.StructField("metric_value", MONEY),
    T.StructField("window_start", T.TimestampNTZType()), T.StructField("window_end", T.TimestampNTZType()),
    T.StructField("bucket", T.IntegerType())])


TOTALS_SCHEMA = T.StructType([
    T.StructField("member_id", T.LongType()), T.StructField("member_name", T.StringType()),
    *[T.StructField(c, MONEY) for c in SUMS[:3]], T.StructField("transaction_count", T.LongType()),
    T.StructField("active_windows", T.LongType()), T.StructField("last_transaction", T.TimestampNTZType()),
    T.StructField("was", MONEY), T.StructField("state", T.IntegerType()), T.StructField("bucket", T.IntegerType())])
HISTOGRAM_SCHEMA = T.StructType([T.StructField("value", MONEY), T.StructField("n", T.LongType()),
                                 T.StructField("band", T.IntegerType())])


# --- covering a time range by stored windows ----------------------------------------------------

def cover(start: dt.datetime, end: dt.datetime, sizes: tuple[int, ...]) -> list[tuple[int, dt.datetime, dt.datetime]]:
    """Ranges (size, from, to) that fill [start, end) with the fewest aligned windows of the given sizes.

    Each size divides the next. Windows of the smallest size that are not
    wholly inside are left out. At most two ranges a size, one of the largest.
    """
    second = dt.timedelta(seconds=1)
    smallest = min(sizes)
    a = -((_EPOCH - start) // (smallest * second)) * smallest      # rounded up
    b = (end - _EPOCH) // (smallest * second) * smallest
    out: list[tuple[int, int, int]] = []

    def fill(lo: int, hi: int, left: list[int]) -> None:
        if lo >= hi:
            return
        size, smaller = left[-1], left[:-1]
        first, last = -(-lo // size) * size, hi // size * size
        if first >= last:
            fill(lo, hi, smaller)
        else:
            fill(lo, first, smaller)
            out.append((size, first, last))
            fill(last, hi, smaller)

    fill(a, b, sorted(sizes))
    return [(s, _EPOCH + dt.timedelta(seconds=x), _EPOCH + dt.timedelta(seconds=y)) for s, x, y in out]


# --- pure steps of a version --------------------------------------------------------------------

def merged_windows(previous: DataFrame, fresh: DataFrame) -> DataFrame:
    """Every version that windows had: as before (unless replaced), and after each arrival that changed them.

    ``changed`` tells the latter, ``old`` is the version before the change (null if new),
    ``replaced`` that a later arrival follows.
    """
    def side(df: DataFrame, is_new: bool) -> DataFrame:
        arrival = F.col(ARRIVAL) if is_new and ARRIVAL in df.columns else F.lit(None)
        return df.select(*SUMMARY_COLUMNS, arrival.cast("long").alias(ARRIVAL), F.lit(is_new).alias("changed"))

    values = [f.name for f in COMPACTED_SCHEMA.fields[4:9]]
    in_order = Window.partitionBy(*SUMMARY_KEY).orderBy("changed", F.col(ARRIVAL).asc_nulls_first())
    so_far = in_order.rowsBetween(Window.unboundedPreceding, Window.currentRow)
    sums = [F.sum(c).over(so_far).cast(COMPACTED_SCHEMA[c].dataType).alias(c) for c in SUMS]
    versions = side(previous, False).unionByName(side(fresh, True)).select(
        *SUMMARY_KEY, *sums, F.max("last_transaction").over(so_far).alias("last_transaction"), ARRIVAL, "changed")
    return versions.select("*", F.lag(F.struct(*values)).over(in_order).alias("old"),
                           F.lead(F.lit(True), 1, False).over(in_order).alias("replaced")).where("changed or not replaced")


def signed_changes(rows: DataFrame) -> DataFrame:
    """(sign, summary columns): +1 for every changed window's new version, -1 for its old one; none if both are equal."""
    values = [f.name for f in COMPACTED_SCHEMA.fields[4:9]]
    differs = F.lit(False)
    for c in values:
        differs = differs | ~F.col("old")[c].eqNullSafe(F.col(c))
    new = F.struct(F.lit(1).alias("sign"), *[F.col(c).alias(c) for c in values])
    old = F.struct(F.lit(-1).alias("sign"), *[F.col("old")[c].alias(c) for c in values])
    return rows.where(F.col("changed") & (F.col("old").isNull() | differs)).select(
        *SUMMARY_KEY, ARRIVAL, F.col("old").isNull().alias("inserted"),
        F.inline(F.filter(F.array(new, F.when(F.col("old").isNotNull(), old)), lambda x: x.isNotNull())))


def offer_changes(changes: DataFrame, hotel_threshold, drink_threshold) -> DataFrame:
    """Signed rows of both offers, each from its own row: an equal one is neither retracted nor inserted before."""
    hotel = F.struct(F.lit(config.HOTEL).alias("offer_type"), F.col("total_spend").alias("metric_value"))
    drink = F.struct(F.lit(config.DRINK).alias("offer_type"), F.abs("net_amount").cast(MONEY).alias("metric_value"))
    kinds = F.array(F.when(hotel_predicate(hotel_threshold), hotel), F.when(drink_predicate(drink_threshold), drink))
    return changes.select("sign", *SUMMARY_COLUMNS, ARRIVAL, F.inline(F.filter(kinds, lambda k: k.isNotNull())))


def month_of(day: dt.date) -> dt.date:
    return day.replace(day=1)


def next_month(first_day: dt.date) -> dt.date:
    return month_of(first_day + dt.timedelta(days=31))


def stats_changes(changes: DataFrame, window_seconds: int, hotel_threshold, drink_threshold) -> DataFrame:
    """What the signed rows add to the totals of their window, hour and day, a row for each of their windows.

    Rows are added up by window only; ``added_stats`` adds up the windows of an hour and a day.
    """
    net = F.col("net_amount")
    flags = {"windows": F.lit(1), "spend_rows": F.col("total_spend").isNotNull().cast("long"),
             "transactions": F.col("transaction_count"), "winning": (net >= 0).cast("long"), "losing": (net < 0).cast("long"),
             "hotel": hotel_predicate(hotel_threshold).cast("long"), "drink": drink_predicate(drink_threshold).cast("long")}
    sign = F.col("sign")
    windows = changes.groupBy("window_start", "window_end").agg(
        F.sum(sign * F.col("total_spend")).cast(MONEY).alias("revenue"),
        *[F.sum(sign * c).cast("long").alias(n) for n, c in flags.items()],
        F.hll_sketch_agg(F.when(F.col("inserted") & (sign > 0), F.col("member_id")), 12).alias("members"))
    at = F.struct(F.lit(window_seconds).alias("size"), F.col("window_start"), F.col("window_end"))
    wider = []
    for unit, size in (("hour", HOUR), ("day", DAY)):
        start = F.date_trunc(unit, "window_start").cast("timestamp_ntz")
        wider.append(F.struct(F.lit(size).alias("size"), start.alias("window_start"),
                              (start + F.expr(f"INTERVAL {size} SECOND")).alias("window_end")))
    return windows.select(F.trunc(F.to_date("window_start"), "month").alias("first_day"), "revenue", *COUNTS, "members",
                          F.inline(F.array(at, *wider)))


def added_stats(rows: DataFrame) -> DataFrame:
    return rows.groupBy("size", "window_start", "window_end", "first_day").agg(
        F.sum("revenue").cast(MONEY).alias("revenue"), *[F.sum(c).alias(c) for c in COUNTS],
        F.hll_union_agg("members").alias("members")).select(*STATS_SCHEMA.fieldNames())


def remaining_offers(current: DataFrame, log: DataFrame, closed_by: dt.datetime | None) -> DataFrame:
    """Offers after a log: of each member and type the open ones, and the newest of those that cannot change."""
    both = current.select(F.lit(1).alias("sign"), *OFFER_COLUMNS).unionByName(log.select("sign", *OFFER_COLUMNS))
    left = both.groupBy(*OFFER_COLUMNS).agg(F.sum("sign").alias("n")).where("n > 0").drop("n")
    if closed_by is None:
        return left
    closed = F.col("window_end") <= ts_lit(closed_by)
    newest = Window.partitionBy("member_id", "offer_type", "closed").orderBy(
        F.col("window_end").desc(), F.col("metric_value").desc(), F.col("member_name").desc())
    return left.withColumn("closed", closed).withColumn("place", F.row_number().over(newest)) \
        .where(~F.col("closed") | (F.col("place") == 1)).select(*OFFER_COLUMNS)


KEPT_AS_IT_WAS, CHANGED, NEW = 0, 1, 2


def member_totals(held: DataFrame, changes: DataFrame) -> DataFrame:
    """All-time totals per member after signed changes, with the spend before (``was``) and the member's ``state``."""
    sign = F.col("sign")
    added = [c.name for c in TOTALS_SCHEMA.fields[2:7]]
    more = changes.select(
        "member_id", "member_name", *[(sign * F.col(c)).alias(c) for c in SUMS],
        (F.col("inserted") & (sign > 0)).cast("long").alias("active_windows"),
        F.when(sign > 0, F.col("last_transaction")).alias("last_transaction"), F.lit(True).alias("is_new"))
    both = held.select("member_id", "member_name", *added, "last_transaction", F.lit(False).alias("is_new")) \
        .unionByName(more)
    old = F.max(F.when(~F.col("is_new"), F.struct("total_spend")))
    state = F.when(~F.max("is_new"), KEPT_AS_IT_WAS).when(old.isNull(), NEW).otherwise(CHANGED)
    return both.groupBy("member_id", "member_name").agg(
        *[F.sum(c).cast(TOTALS_SCHEMA[c].dataType).alias(c) for c in added],
        F.max("last_transaction").alias("last_transaction"), old["total_spend"].cast(MONEY).alias("was"),
        state.cast("int").alias("state"))


NULL_BAND = -(1 << 30)


def band(value: Column) -> Column:
    """Bands of values in order, eight to a doubling; null values come last."""
    x = value.cast("double")
    return F.coalesce((F.signum(x) * F.floor(F.log2(F.abs(x) + 1) * 8)).cast("int"), F.lit(NULL_BAND))


def histogram_changes(totals: DataFrame) -> DataFrame:
    """(value, n, band): members that left and reached a total spend."""
    reached = F.struct(F.col("total_spend").alias("value"), F.lit(1).alias("n"))
    left = F.struct(F.col("was").alias("value"), F.lit(-1).alias("n"))
    moves = F.when(F.col("state") == NEW, F.array(reached)).when(F.col("state") == CHANGED, F.array(reached, left))
    return totals.where(F.col("state") != KEPT_AS_IT_WAS).select(F.inline(moves)) \
        .groupBy("value").agg(F.sum("n").alias("n")).where("n <> 0").withColumn("band", band(F.col("value")))


def together(spark: SparkSession, steps: list[Callable[[], dict]]) -> dict:
    """What independent steps return, merged. Their Spark jobs share the cluster; all have ended when this returns or raises."""
    with ThreadPoolExecutor(len(steps)) as pool:
        running = [pool.submit(inheritable_thread_target(spark)(step)) for step in steps]
    return {k: v for r in running for k, v in r.result().items()}


# --- the job --------------------------------------------------------------------------------------

@dataclass
class KeptTables:
    """Writer and reader of the kept tables under ``root``. There is one writer at a time."""
    spark: SparkSession
    root: str
    window: str = config.DEFAULT_WINDOW
    delay: str = config.WATERMARK_DELAY
    hotel_threshold: int = config.DEFAULT_HOTEL_THRESHOLD
    drink_threshold: int = config.DEFAULT_DRINK_THRESHOLD
    buckets: int = 16
    files: Versions = field(init=False)

    def __post_init__(self):
        if DAY % duration_seconds(self.window):
            raise ValueError(f"windows of {self.window} span days")
        self.files = Versions(self.spark, self.root)

    # --- writing ------------------------------------------------------------------------------
    def start(self, tx: DataFrame, checkpoint: str, trigger: str | None = "availableNow") -> StreamingQuery:
        writer = tx.writeStream.option("checkpointLocation", checkpoint).foreachBatch(self.process)
        return _trigger(writer, trigger).start()

    def _closed_by(self, c: Commit) -> dt.datetime | None:
        """No window ending by then takes transactions any more."""
        seen = c.facts.get("seen")
        return None if seen is None else dt.datetime.fromisoformat(seen) - self._delay()

    def _delay(self) -> dt.timedelta:
        return dt.timedelta(seconds=duration_seconds(self.delay))

    def process(self, batch: DataFrame, batch_id: int) -> None:
        """One micro-batch of transactions."""
        c = self.files.newest()
        if c.facts.get("batch", -1) >= batch_id:
            return
        version = c.version + 1
        if isinstance(batch.schema[TIME_COL].dataType, T.TimestampType):
            batch = batch.withColumn(TIME_COL, instant_to_ntz(F.col(TIME_COL)))
        if ARRIVAL not in batch.columns:
            batch = batch.withColumn(ARRIVAL, F.lit(None).cast("long"))
        seen, before = _time(c.facts.get("seen")), []
        for arrival, newest in batch.groupBy(ARRIVAL).agg(F.max(TIME_COL)) \
                .orderBy(F.col(ARRIVAL).asc_nulls_first()).collect():        # one row per arrival
            before.append((arrival, None if seen is None else seen - self._delay()))
            seen = max((t for t in (newest, seen) if t is not None), default=None)
        on_time = batch
        if "seen" in c.facts or len(before) > 1:
            bounds = self.spark.createDataFrame(before, "_a long, _closed_by timestamp_ntz")
            placed = batch.withColumn("_w", F.window(TIME_COL, self.window)) \
                .join(F.broadcast(bounds), F.col(ARRIVAL).eqNullSafe(F.col("_a")))
            is_late = F.coalesce(F.col("_w")["end"] <= F.col("_closed_by"), F.lit(False))
            on_time = placed.where(~is_late).drop("_w", "_a", "_closed_by")
            placed.where(is_late).select(*TRANSACTIONS_COLUMNS).write.mode("overwrite") \
                .parquet(self.files.folder("late", version))
        fresh = member_window_summary(on_time, self.window, also_by=(ARRIVAL,)).select(*SUMMARY_COLUMNS, ARRIVAL)
        facts = {"batch": batch_id, "open": version, "seen": seen.isoformat() if seen else None}
        closes = self._closed_by(c.next(facts, {}))
        is_closed = F.lit(0) if closes is None else (F.col("window_end") <= ts_lit(closes)).cast("int")
        self._publish(c, merged_windows(self._open(c), fresh), is_closed, closes, facts)

    def _publish(self, c: Commit, windows: DataFrame, is_closed: Column, closes: dt.datetime | None, facts: dict,
                 closed_days: bool = False) -> Commit:
        """Write the next version of every table from merged windows, then commit it."""
        version = c.version + 1
        path = self.files.folder("windows", version)
        windows.withColumn("closed", F.when(F.col("replaced"), REPLACED).otherwise(is_closed)).drop("replaced").withColumn("window_date", F.to_date("window_start")) \
            .hint("rebalance", "closed", "window_date").write.mode("overwrite") \
            .partitionBy("closed", "window_date").parquet(path)
        rows = self._windows_of(version)
        qualifies = hotel_predicate(self.hotel_threshold) | drink_predicate(self.drink_threshold)
        was = F.coalesce((F.col("old")["total_spend"] >= self.hotel_threshold)
                         | (F.col("old")["net_amount"] <= -self.drink_threshold), F.lit(False))
        bucket = self._bucket()
        days, active, joined, offered = rows.where("changed").agg(
            F.collect_set("window_date"), F.collect_set(bucket), F.collect_set(F.when(F.col("old").isNull(), bucket)),
            F.collect_set(F.when(F.coalesce(qualifies, F.lit(False)) | was, bucket))).first()  # at most `buckets` and the days of a batch
        changes = signed_changes(rows)
        log_path = self.files.folder("offer_log", version)

        def offered_now() -> dict:
            offer_changes(changes, self.hotel_threshold, self.drink_threshold).write.mode("overwrite").parquet(log_path)
            if not offered:
                return {}
            held = self.files.read_parts(c, "latest", "bucket", LATEST_SCHEMA, offered)
            log = self.spark.read.schema(self._log_schema()).parquet(log_path)
            if closed_days:
                # a correction may retract a closed offer, behind which no older one is kept
                hit = log.select("member_id").distinct()
                held = held.join(hit, "member_id", "left_anti").select(*OFFER_COLUMNS).unionByName(
                    self._offer_rows(c).join(hit, "member_id", "left_semi").select(*OFFER_COLUMNS))
            return {"latest": self.files.write_parts(
                c, "latest", "bucket", remaining_offers(held, log, closes).withColumn("bucket", bucket), offered)}

        def stats_now() -> dict:
            months = sorted({month_of(d) for d in days})
            held = self.files.read_parts(c, "stats", "first_day", STATS_SCHEMA, months)
            more = stats_changes(changes, duration_seconds(self.window), self.hotel_threshold, self.drink_threshold)
            return {"stats": self.files.write_parts(
                c, "stats", "first_day", added_stats(held.unionByName(more.select(*STATS_SCHEMA.fieldNames()))), months)}

        def members_now() -> dict:
            held = self.files.read_parts(c, "members", "bucket", MEMBERS_SCHEMA, joined)
            more = changes.where("inserted and sign > 0").select("member_id", F.lit(1).cast("long").alias("windows"),
                                                                  bucket.alias("bucket"))
            return {"members": self.files.write_parts(
                c, "members", "bucket", held.unionByName(more).groupBy("member_id", "bucket")
                .agg(F.sum("windows").alias("windows")), joined)}

        def totals_now() -> dict:
            held = self.files.read_parts(c, "totals", "bucket", TOTALS_SCHEMA, active)
            written = self.files.write_parts(
                c, "totals", "bucket", member_totals(held, changes).withColumn("bucket", bucket), active)
            totals = self.spark.read.schema(TOTALS_SCHEMA).parquet(self.files.folder("totals", version))
            moves = histogram_changes(totals)
            bands = [r["band"] for r in moves.select("band").distinct().collect()]     # a few hundred at most
            held = self.files.read_parts(c, "histogram", "band", HISTOGRAM_SCHEMA, bands)
            return {"totals": written, "histogram": self.files.write_parts(
                c, "histogram", "band", held.unionByName(moves.select(*HISTOGRAM_SCHEMA.fieldNames()))
                .groupBy("value", "band").agg(F.sum("n").alias("n")).where("n > 0"), bands)}

        tables = together(self.spark, [offered_now] + [step for step, parts in (
            (stats_now, days), (members_now, joined), (totals_now, active)) if parts])
        if closed_days:
            tables["closed_days"] = {**c.tables.get("closed_days", {}), **{str(d): version for d in days}}
        done = c.next(facts, tables)
        self.files.commit(done)
        return done

    def correct_late(self) -> int:
        """Merge the late transactions captured so far into the closed windows of their days; returns their number.

        Runs between batches, in the job that writes them. The days touched are
        written as a whole in a version of their own, and the correction flows
        to every other table as a batch does.
        """
        c = self.files.newest()
        after = c.facts.get("corrected", -1)
        late = self.late_transactions(c).where(F.col("version") > after)
        fresh = member_window_summary(late, self.window)
        days, n = late.agg(F.collect_set(F.to_date(TIME_COL)), F.count("*")).first()
        if not n:
            return 0
        previous = self._closed(c).where(F.col("window_date").isin(days))
        # an interrupted batch may have left late rows under this version
        late.drop("version").limit(0).write.mode("overwrite").parquet(self.files.folder("late", c.version + 1))
        self._publish(c, merged_windows(previous, fresh), F.lit(1), self._closed_by(c), {"corrected": c.version},
                      closed_days=True)
        return n

    # --- reading ------------------------------------------------------------------------------
    def _bucket(self) -> Column:
        return F.pmod(F.hash("member_id"), F.lit(self.buckets))

    def _windows(self, *paths: str) -> DataFrame:
        if not paths:
            return self.spark.createDataFrame([], WINDOWS_SCHEMA)
        return self.spark.read.schema(WINDOWS_SCHEMA).option("basePath", f"{self.root}/windows").parquet(*paths)

    def _windows_of(self, version: int) -> DataFrame:
        return self._windows(self.files.folder("windows", version))

    def _state_folders(self, closed: int, versions) -> list[str]:
        """The folders of windows in one state: those of other states are not listed, and there is one a day in each."""
        folders = [self.files.folder("windows", v) for v in versions]
        return [f"{f}/closed={closed}" for f in folders if f"closed={closed}" in self.files.names(f)]

    def _open(self, c: Commit) -> DataFrame:
        """Windows that may still change: in the newest batch's version, as corrections hold closed ones only."""
        return self._windows(*self._state_folders(0, [c.facts["open"]] if "open" in c.facts else []))

    def _closed(self, c: Commit) -> DataFrame:
        """Closed windows: for a corrected day its newest correction and what closed later."""
        rows = self._windows(*self._state_folders(1, range(c.version + 1)))
        since = c.tables.get("closed_days")
        for v in sorted(set((since or {}).values())):       # one set of days per correction, looked up by hash
            days = [dt.date.fromisoformat(d) for d, of in since.items() if of == v]
            rows = rows.where((F.col("version") >= v) | ~F.col("window_date").isin(days))
        return rows

    def summary(self, first_day=None, last_day=None) -> DataFrame:
        """The member summary as of the newest commit, with open windows."""
        c = self.files.newest()
        rows = self._open(c).unionByName(self._closed(c))
        if first_day is not None:
            rows = rows.where(F.col("window_date") >= date_lit(first_day))
        if last_day is not None:
            rows = rows.where(F.col("window_date") <= date_lit(last_day))
        return rows.select(*SUMMARY_COLUMNS)

    def _log_schema(self) -> T.StructType:
        return T.StructType([T.StructField("sign", T.IntegerType()), *FRESH_SCHEMA.fields,
                             T.StructField("offer_type", T.StringType()), T.StructField("metric_value", MONEY)])

    def offer_log(self) -> DataFrame:
        """(version, sign, arrival, offer_type, metric_value, summary columns): offers inserted and withdrawn."""
        c = self.files.newest()
        path = f"{self.root}/offer_log"
        schema = T.StructType([*self._log_schema().fields, T.StructField("version", T.LongType())])
        if c.version < 0:
            return self.spark.createDataFrame([], schema)
        return self.spark.read.schema(schema).option("basePath", path).parquet(path).where(F.col("version") <= c.version)

    def _offer_rows(self, c: Commit) -> DataFrame:
        rows = self._open(c).unionByName(self._closed(c)).select(*SUMMARY_COLUMNS)
        return offer_rows(rows, self.hotel_threshold, self.drink_threshold).withColumn(
            "metric_value", F.col("metric_value").cast(MONEY))

    def latest_offers(self) -> DataFrame:
        """Latest offer per member and type in display shape, from the kept rows."""
        rows = self.files.read_parts(self.files.newest(), "latest", "bucket", LATEST_SCHEMA)
        return latest_offer_rows(rows.select(*OFFER_COLUMNS))

    def late_transactions(self, c: Commit | None = None) -> DataFrame:
        """Transactions that came after their window had closed, with the version that refused them."""
        c = c or self.files.newest()
        path = f"{self.root}/late"
        schema = T.StructType([T.StructField(f.name, T.TimestampNTZType() if f.name == TIME_COL else f.dataType)
                               for f in TRANSACTIONS_SCHEMA.fields] + [T.StructField("version", T.LongType())])
        if not self.files.names(path):
            return self.spark.createDataFrame([], schema)
        return self.spark.read.schema(schema).option("basePath", path).parquet(path).where(F.col("version") <= c.version)

    # --- statistics -----------------------------------------------------------------------------
    def stats_rows(self, start: dt.datetime | None = None, end: dt.datetime | None = None) -> DataFrame:
        """The fewest stored totals that cover all windows, or those inside [start, end)."""
        c = self.files.newest()
        months = [dt.datetime.fromisoformat(m) for m in sorted(c.tables.get("stats", {}))]
        if not months:
            return self.spark.createDataFrame([], STATS_SCHEMA)
        lo, hi = start or months[0], end or next_month(months[-1])
        parts = cover(lo, hi, tuple(sorted({duration_seconds(self.window), HOUR, DAY})))
        wanted = [m.date() for m in months if any(m < b and next_month(m) > a for _, a, b in parts)]
        rows = self.files.read_parts(c, "stats", "first_day", STATS_SCHEMA, wanted)
        inside = F.lit(False)
        for size, a, b in parts:
            inside = inside | ((F.col("size") == size) & (F.col("window_start") >= ts_lit(a))
                               & (F.col("window_start") < ts_lit(b)))
        return rows.where(inside)

    def _totals(self, start=None, end=None) -> DataFrame:
        return self.stats_rows(start, end).agg(
            F.sum("revenue").alias("total_revenue"), *[F.sum(c).alias(c) for c in COUNTS],
            F.hll_sketch_estimate(F.hll_union_agg("members")).alias("member_estimate"))

    def overall_stats(self) -> DataFrame:
        """D2 over all time: kept totals, and the number of members as that of kept rows."""
        c = self.files.newest()
        members = self.files.read_parts(c, "members", "bucket", MEMBERS_SCHEMA) \
            .agg(F.count("member_id").alias("total_members"))
        both = self._totals().unionByName(members, allowMissingColumns=True)
        return both.agg(*[F.max(x).alias(x) for x in both.columns]).select(
            "total_members", "total_revenue", F.col("transactions").alias("total_transactions"),
            (F.col("total_revenue").cast("double") / F.col("spend_rows")).alias("avg_spend_per_member"),
            F.col("winning").alias("winning_members"), F.col("losing").alias("losing_members"))

    def spend_ranks(self) -> DataFrame:
        """(value, spend_rank) of every total spend that a member has, highest first, nulls last."""
        c = self.files.newest()
        rows = self.files.read_parts(c, "histogram", "band", HISTOGRAM_SCHEMA)
        bands = rows.groupBy("band").agg(F.sum("n").alias("own"))      # a few hundred at most
        higher = Window.orderBy(F.col("band").desc()).rowsBetween(Window.unboundedPreceding, -1)
        above = bands.select("band", F.coalesce(F.sum("own").over(higher), F.lit(0)).alias("above"))
        within = Window.partitionBy("band").orderBy(F.col("value").desc()).rowsBetween(Window.unboundedPreceding, -1)
        return rows.withColumn("higher", F.coalesce(F.sum("n").over(within), F.lit(0))).join(F.broadcast(above), "band") \
            .select("value", (F.col("above") + F.col("higher") + 1).cast("long").alias("spend_rank"))

    def leaderboard(self) -> DataFrame:
        """All-time member totals with rank() by spend, from kept rows; no job runs while it is built."""
        c = self.files.newest()
        totals = self.files.read_parts(c, "totals", "bucket", TOTALS_SCHEMA).drop("was", "state", "bucket")
        ranked = totals.join(self.spend_ranks(), F.col("total_spend").eqNullSafe(F.col("value"))).drop("value")
        return ranked.orderBy("spend_rank", "member_id", "member_name")

    def last_windows(self, kind: str, before: dt.datetime, k: int = 3) -> DataFrame:
        """The offers of the k newest windows that have one, read from the days that hold these windows only."""
        newest = self.newest_qualifying(kind, before, k)
        spans = newest.select("window_start", "window_end").collect()        # k rows
        if not spans:
            return offers.last_windows(self.summary().where(F.lit(False)), k)
        rows = self.summary(min(s for s, _ in spans), max(s for s, _ in spans))
        threshold = self.hotel_threshold if kind == config.HOTEL else self.drink_threshold
        return offers.last_windows(offers.qualifying_history(rows, kind, threshold, before), k)

    def range_stats(self, start: dt.datetime | None = None, end: dt.datetime | None = None) -> DataFrame:
        """D2-D5 of the windows inside [start, end), members estimated from the merged sketches."""
        return self._totals(start, end)

    def eligibility(self) -> DataFrame:
        """D3: hotel, drink and all windows."""
        return self._totals().select(F.col("hotel").alias("hotel_eligible"), F.col("drink").alias("drink_eligible"),
                                     F.coalesce("windows", F.lit(0)).alias("total"))

    def newest_qualifying(self, kind: str, before: dt.datetime, k: int = 3) -> DataFrame:
        """(window_start, window_end, qualifying_members) of the newest windows with an offer.

        Read from the stored totals, a few months back at a time until k are found.
        """
        c = self.files.newest()
        months = [m for m in sorted(c.tables.get("stats", {}), reverse=True) if m <= before.date().isoformat()]
        found, step = [], 1
        while months and len(found) < k:
            some, months, step = months[:step], months[step:], step * 2
            rows = self.files.read_parts(c, "stats", "first_day", STATS_SCHEMA, some) \
                .where((F.col("size") == duration_seconds(self.window)) & (F.col(kind) > 0)
                       & (F.col("window_end") < ts_lit(before)))
            found += rows.orderBy(F.col("window_start").desc()).limit(k).select("window_start", "window_end", kind).collect()
        schema = "window_start timestamp_ntz, window_end timestamp_ntz, qualifying_members long"
        return self.spark.createDataFrame([tuple(r) for r in found[:k]], schema)


def _time(text: str | None) -> dt.datetime | None:
    return None if text is None else dt.datetime.fromisoformat(text)
