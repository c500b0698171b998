"""Registered queries over tables that a stream keeps current by deltas (``streaming.kept``).

The transactions arrive six times a month, those of a third of a month in two
halves by their id, so that most windows change in two arrivals. Two jobs read
the same arrivals. One allows them to be eleven days late, so every row is on
time and windows are emitted again; the other allows ten seconds, so that the
second half is mostly late, is captured, and is merged afterwards.

A micro-batch takes one arrival where there are few, and several where there are
many: the number of micro-batches grows with the rows, not with the months.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from perkflow import config
from perkflow.functions.time import interval_bounds, interval_label, time_filter_lower_bound, to_datetime
from perkflow.operators import analytics, ledger
from perkflow.operators.offers import offers
from perkflow.plans.inputs import Inputs, Params, money_as_double
from perkflow.plans.live_registry import live_dashboard, table_state
from perkflow.plans.oracle import ORACLE_SQL, summary_cte, tx_cte, with_
from perkflow.plans.registry import REGISTRY
from perkflow.plans.streams_registry import _run_dir
from perkflow.streaming.kept import KeptTables
from perkflow.streaming.summary_stream import run_to_completion

P = Params()
KEPT_ORACLE: dict[str, str] = {}
_BUILT: dict[tuple, KeptTables] = {}


def _arrival():
    """With which arrival a transaction comes: by month, third of the month, and half."""
    t = F.col("transaction_time")
    third = F.least(F.floor((F.dayofmonth(t) - 1) / 11), F.lit(2))
    return ((F.year(t) * 12 + F.month(t)) * 6 + third * 2 + F.col("transaction_id") % 2).cast("long")


_ARRIVAL_SQL = """((year(transaction_time) * 12 + month(transaction_time)) * 6
  + least(floor((day(transaction_time) - 1) / 11), 2) * 2 + transaction_id % 2)"""


#: Micro-batches of a run at least, if there are as many arrivals, and rows that one takes on average at most.
BATCHES, BATCH_ROWS = 8, 2_000_000


def micro_batches(rows: list[int]) -> list[int]:
    """The micro-batch of every arrival, given their rows: consecutive ones together, of about equal size."""
    total = sum(rows)
    n = max(BATCHES, -(-total // BATCH_ROWS))
    if len(rows) <= n:
        return list(range(len(rows)))
    out, before = [], 0
    for r in rows:
        out.append(min(n - 1, (2 * before + r) * n // (2 * total)))
        before += r
    return [sorted(set(out)).index(x) for x in out]


def _kept(spark: SparkSession, data_dir: str, delay: str) -> KeptTables:
    """Streams the micro-batches one after the other, each as soon as its files are there.

    The transactions are dealt to them in one pass, whatever their number.
    """
    key = (*table_state(spark, data_dir), delay)
    if key not in _BUILT:
        root = _run_dir(spark, "kept")
        tx = Inputs(spark, data_dir, P).tx().withColumn("arrival", _arrival())
        kept = KeptTables(spark, f"{root}/tables", delay=delay)
        arrivals = tx.groupBy("arrival").count().orderBy(F.col("arrival").asc_nulls_first()).collect()   # six a month
        dealt = micro_batches([r["count"] for r in arrivals])
        firsts = [r["arrival"] for i, r in enumerate(arrivals) if i and dealt[i] != dealt[i - 1]]
        part = sum((F.coalesce(F.col("arrival") >= first, F.lit(False)).cast("int") for first in firsts), F.lit(0))
        if arrivals:
            tx.withColumn("part", part).write.partitionBy("part").parquet(f"{root}/dealt")
        for i in sorted(set(dealt)):
            spark.read.schema(tx.schema).parquet(f"{root}/dealt/part={i}").write.parquet(f"{root}/in/part-{i:05d}")
            stream = spark.readStream.schema(tx.schema).parquet(f"{root}/in/*")
            run_to_completion(kept.start(stream, f"{root}/checkpoint"))
        _BUILT[key] = kept
    return _BUILT[key]


def on_time(spark: SparkSession, data_dir: str) -> KeptTables:
    return _kept(spark, data_dir, "11 days")


def corrected(spark: SparkSession, data_dir: str) -> KeptTables:
    kept = _kept(spark, data_dir, config.WATERMARK_DELAY)
    kept.correct_late()
    return kept


def _entry(name: str, job: Callable, ask: Callable[[KeptTables], DataFrame], sql: str, doc: str) -> None:
    def run(spark: SparkSession, data_dir: str) -> DataFrame:
        return money_as_double(ask(job(spark, data_dir)))
    run.__name__, run.__doc__ = name, doc
    REGISTRY[name] = run
    KEPT_ORACLE[name] = sql


def _win_loss(k: KeptTables) -> DataFrame:
    return analytics.win_loss_rows(k.overall_stats())


def _eligibility(k: KeptTables) -> DataFrame:
    return analytics.eligibility_rows(k.eligibility())


for _prefix, _job, _how in (("mv", on_time, "whose windows changed in two batches"),
                            ("late_corrected", corrected, "after the late transactions were merged")):
    _entry(f"{_prefix}_overall_stats", _job, KeptTables.overall_stats, ORACLE_SQL["overall_stats"],
           f"D2 from kept totals {_how}.")
    _entry(f"{_prefix}_reward_eligibility_distribution", _job, _eligibility, ORACLE_SQL["reward_eligibility_distribution"],
           f"D3 and D4 from kept totals {_how}.")
    _entry(f"{_prefix}_win_loss_distribution", _job, _win_loss, ORACLE_SQL["win_loss_distribution"],
           f"D5 from kept totals {_how}.")
    _entry("summary_reemitted" if _prefix == "mv" else "late_corrected_summary", _job, KeptTables.summary,
           ORACLE_SQL["member_window_summary"], f"The summary {_how} (I3, I5).")


def _added_up(kind: str) -> Callable[[KeptTables], DataFrame]:
    def ask(k: KeptTables) -> DataFrame:
        log = k.offer_log().where(F.col("offer_type") == kind).drop("version", "arrival", "offer_type", "metric_value")
        columns = [c for c in log.columns if c != "sign"]
        left = log.groupBy(*columns).agg(F.sum("sign").alias("n")).where("n > 0")
        return offers(left, kind, 0)       # all of them qualify: only the offer's columns are added
    return ask


for _kind in (config.HOTEL, config.DRINK):
    _sql = ORACLE_SQL["hotel_room_offers" if _kind == config.HOTEL else "drink_offers"]
    _entry(f"{_kind}_offer_log", on_time, _added_up(_kind), _sql, "The offers as the sum of inserted and withdrawn ones (I7).")
    _entry(f"{_kind}_offer_log_corrected", corrected, _added_up(_kind), _sql,
           "The offers as the sum of inserted and withdrawn ones, corrections included (I7, I5).")


def _pending(job: Callable):
    def run(spark: SparkSession, data_dir: str) -> DataFrame:
        board = live_dashboard(spark, data_dir)
        done = ledger.read_ledger(spark, board.ledger_path, P.today, P.today)
        return ledger.pending_from_latest(job(spark, data_dir).latest_offers(), done, P.today)
    return run


def mv_pending_offers(spark: SparkSession, data_dir: str) -> DataFrame:
    """F4 from the kept latest offers and today's partition of the stored ledger; no scan of the history."""
    return money_as_double(_pending(on_time)(spark, data_dir))


def mv_pending_counts(spark: SparkSession, data_dir: str) -> DataFrame:
    """D6 over the kept latest offers."""
    return ledger.pending_counts(_pending(on_time)(spark, data_dir))


def late_corrected_pending_offers(spark: SparkSession, data_dir: str) -> DataFrame:
    """F4 after the late transactions were merged, which withdraws and adds closed offers."""
    return money_as_double(_pending(corrected)(spark, data_dir))


for _run, _of in ((mv_pending_offers, "pending_offers"), (mv_pending_counts, "pending_counts"),
                  (late_corrected_pending_offers, "pending_offers")):
    REGISTRY[_run.__name__] = _run
    KEPT_ORACLE[_run.__name__] = ORACLE_SQL[_of]


def _late(k: KeptTables) -> DataFrame:
    return k.late_transactions().drop("version")


_entry("late_transactions", corrected, _late, with_(tx_cte()) + f""",
arrivals AS (SELECT *, {_ARRIVAL_SQL} AS arrival,
                    time_bucket(INTERVAL '{P.window}', transaction_time) + INTERVAL '{P.window}' AS window_end FROM tx),
seen AS (SELECT arrival, max(max(transaction_time)) OVER (ORDER BY arrival ROWS BETWEEN UNBOUNDED PRECEDING
                AND 1 PRECEDING) AS newest FROM arrivals GROUP BY arrival)
SELECT transaction_id, member_id, member_name, transaction_type, CAST(amount AS DOUBLE) AS amount, game_type,
       transaction_time
FROM arrivals JOIN seen USING (arrival) WHERE window_end <= newest - INTERVAL '{config.WATERMARK_DELAY}'""",
       "Transactions captured after their window had closed (I5).")

_RANGE = ("2024-01-05 13:25:00", "2024-01-19 07:40:00")


def _range_totals(k: KeptTables) -> DataFrame:
    return k.range_stats(*map(to_datetime, _RANGE)).select(
        "total_revenue", F.col("transactions").alias("total_transactions"), F.col("winning").alias("winning_members"),
        F.col("losing").alias("losing_members"), F.col("hotel").alias("hotel_eligible"),
        F.col("drink").alias("drink_eligible"), F.col("windows").alias("total"))


_entry("range_totals", on_time, _range_totals, with_(tx_cte(), summary_cte(P.window)) + f"""
SELECT CAST(SUM(total_spend) AS DOUBLE) AS total_revenue, CAST(SUM(transaction_count) AS BIGINT) AS total_transactions,
       COUNT(*) FILTER (net_amount >= 0) AS winning_members, COUNT(*) FILTER (net_amount < 0) AS losing_members,
       COUNT(*) FILTER (total_spend >= {P.hotel_threshold}) AS hotel_eligible,
       COUNT(*) FILTER (net_amount < 0 AND abs(net_amount) >= {P.drink_threshold}) AS drink_eligible, COUNT(*) AS total
FROM summary WHERE window_start >= TIMESTAMP '{_RANGE[0]}' AND window_end <= TIMESTAMP '{_RANGE[1]}'""",
       "D2 to D5 of any range, from the fewest stored 5-minute, hour and day totals (I10, B7).")


def mv_member_estimates(spark: SparkSession, data_dir: str) -> DataFrame:
    """Members by time filter, from merged sketches: their exact number, and whether the estimate is close."""
    kept, summary = on_time(spark, data_dir), Inputs(spark, data_dir, P).summary()
    out = None
    for name in config.TIME_FILTERS:
        lower = time_filter_lower_bound(name, P.as_of)
        inside = F.lit(True) if lower is None else F.col("window_end") > F.lit(str(lower)).cast("timestamp_ntz")
        exact = summary.where(inside).agg(F.count_distinct("member_id").alias("members"))
        # windows that end after `lower` start at or after the window that holds it
        start = None if lower is None else interval_bounds(lower, 300)[0]
        both = exact.unionByName(kept.range_stats(start).select("member_estimate"), allowMissingColumns=True) \
            .agg(F.max("members").alias("members"), F.coalesce(F.max("member_estimate"), F.lit(0)).alias("estimate"))
        # 2^12 registers: 1.04 / 64 is a deviation
        close = F.abs(F.col("estimate") - F.col("members")) <= F.greatest(F.lit(1.0), 3 * 1.04 / 64 * F.col("members"))
        row = both.select(F.lit(name).alias("time_filter"), "members", close.alias("estimate_holds"))
        out = row if out is None else out.unionByName(row)
    return out


REGISTRY["mv_member_estimates"] = mv_member_estimates
KEPT_ORACLE["mv_member_estimates"] = with_(tx_cte(), summary_cte(P.window)) + " UNION ALL ".join(
    f"""SELECT '{n}' AS time_filter, COUNT(DISTINCT member_id) AS members, TRUE AS estimate_holds FROM summary WHERE {w}"""
    for n, w in (("Today", f"window_end > date_trunc('day', TIMESTAMP '{P.as_of}')"),
                 ("Last Hour", f"window_end > TIMESTAMP '{P.as_of}' - INTERVAL '1 hour'"),
                 ("Last 5 Minutes", f"window_end > TIMESTAMP '{P.as_of}' - INTERVAL '5 minutes'"), ("All Time", "TRUE")))


def _newest_counts(kind: str) -> Callable[[KeptTables], DataFrame]:
    def ask(k: KeptTables) -> DataFrame:
        _, _, before, _ = interval_bounds(P.as_of, P.interval_seconds)
        return k.newest_qualifying(kind, before, P.history_windows).withColumn("interval_label", interval_label())
    return ask


def _last_windows(kind: str) -> Callable[[KeptTables], DataFrame]:
    def ask(k: KeptTables) -> DataFrame:
        return k.last_windows(kind, interval_bounds(P.as_of, P.interval_seconds)[2], P.history_windows)
    return ask


for _kind in (config.HOTEL, config.DRINK):
    _entry(f"kept_{_kind}_window_counts", on_time, _newest_counts(_kind), ORACLE_SQL[f"{_kind}_history_window_counts"],
           "D9: the newest windows with an offer, from a few days of kept totals (E3).")
    _entry(f"kept_{_kind}_last_windows", on_time, _last_windows(_kind), ORACLE_SQL[f"{_kind}_last_windows"],
           "E3: their offers, from the days of these windows only.")

for _prefix, _job in (("kept", on_time), ("late_corrected", corrected)):
    _entry(f"{_prefix}_member_leaderboard", _job, KeptTables.leaderboard, ORACLE_SQL["member_leaderboard"],
           "D12 and E4 from kept totals and a kept histogram of them.")
