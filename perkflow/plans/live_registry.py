"""Registered queries over stored and live tables.

The ``mv_`` entries ask the dashboard's questions of kept tables, as the
dashboard does: the summary stream's change log, the table it is compacted
into, and the stored ledger. The tables are derived once per application and
data folder from its whole ``events`` table; windows that end after the
compaction boundary are still read from the change log.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from perkflow import config
from perkflow.operators import name_index
from perkflow.plans import catalog
from perkflow.plans.dashboard import Dashboard
from perkflow.plans.inputs import Inputs, Params, money_as_double
from perkflow.plans.oracle import ORACLE_SQL, SUMMARY_OUT, summary_cte, tx_cte, with_
from perkflow.plans.registry import REGISTRY
from perkflow.plans.streams_registry import _changelog_run, _run_dir
from perkflow.sources.fixtures import simulated_requests_from_rows
from perkflow.sources.schemas import SUMMARY_COLUMNS
from perkflow.streaming import changelog

P = Params()
LIVE_ORACLE: dict[str, str] = {}
_BUILT: dict[tuple, Dashboard] = {}


def table_state(spark: SparkSession, data_dir: str, name: str = "events") -> tuple:
    """The application and the paths, sizes and times of a table's files: what was derived from them holds as long."""
    hpath = spark._jvm.org.apache.hadoop.fs.Path(f"{data_dir.rstrip('/')}/{name}.parquet")
    fs = hpath.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    files = [(f.getPath().toString(), f.getLen(), f.getModificationTime()) for f in fs.listStatus(hpath)]
    return spark.sparkContext.applicationId, tuple(sorted(files))


def live_dashboard(spark: SparkSession, data_dir: str) -> Dashboard:
    """Drains the summary stream, compacts up to noon of the fixture's day, fills the stored ledger."""
    key = table_state(spark, data_dir)
    if key not in _BUILT:
        log = _changelog_run(spark, data_dir)
        root = _run_dir(spark, "live")
        checkpoint = log.rsplit("/", 1)[0] + "/checkpoint"
        limit = changelog.stored_watermark(spark, checkpoint)
        until = min(changelog.to_datetime(P.as_of), limit) if limit else None
        changelog.compact_changelog(spark, log, f"{root}/summary", checkpoint, until)
        board = Dashboard(spark, f"{root}/summary", f"{root}/ledger", interval_seconds=P.interval_seconds,
                          changelog_path=log)
        board.redeem(simulated_requests_from_rows(Inputs(spark, data_dir, P).offer_rows()))
        _BUILT[key] = board
    return _BUILT[key]


def _mv(name: str, ask: Callable[[Dashboard], DataFrame]) -> None:
    def run(spark: SparkSession, data_dir: str) -> DataFrame:
        return money_as_double(ask(live_dashboard(spark, data_dir)))
    run.__name__ = f"mv_{name}"
    run.__doc__ = f"{name}, read from the kept tables."
    REGISTRY[f"mv_{name}"] = run
    LIVE_ORACLE[f"mv_{name}"] = ORACLE_SQL[name]


for _kind in (config.HOTEL, config.DRINK):
    for _which in ("current", "previous"):
        _mv(f"{_kind}_{_which}", lambda d, k=_kind, w=_which: d.interval_offers(k, w, P.as_of, P.today))
    _mv(f"{_kind}_history", lambda d, k=_kind: d.history(k, P.as_of))
    _mv(f"{_kind}_last_windows", lambda d, k=_kind: d.last_windows(k, P.as_of))
    _mv(f"{_kind}_history_window_counts", lambda d, k=_kind: d.history_window_counts(k, P.as_of))
_mv("interval_qualifier_count", lambda d: d.interval_counts(P.as_of))
_mv("fulfilled_offers", lambda d: d.fulfilled())
_mv("fulfilled_counts", lambda d: d.fulfilled_counts())
_mv("fulfilled_report", lambda d: d.fulfilled_report(config.DRINK_LABEL, "member 1"))
_mv("fulfilled_report_literal", lambda d: d.fulfilled_report("All", "MEMBER 1", True))
_mv("all_members", lambda d: d.all_members())
_mv("all_members_today", lambda d: d.all_members("Today", P.as_of))
_mv("top_spenders", lambda d: d.top_spenders())
_mv("member_leaderboard", lambda d: d.leaderboard())
_mv("summary_row_count", lambda d: d.row_count())


def rebuild_summary(spark: SparkSession, data_dir: str) -> DataFrame:
    """Writes the summary table, rewrites a range of its days as a backfill does, and reads it back."""
    path = f"{_run_dir(spark, 'rebuild')}/summary"
    tx = Inputs(spark, data_dir, P).tx()
    catalog.rebuild_summary(spark, tx, path)
    return money_as_double(catalog.rebuild_days(spark, tx, path, "2024-01-10", P.today).select(*SUMMARY_COLUMNS))


def _indexed_report(name: str, offer_filter: str, search: str, literal: bool) -> None:
    def run(spark: SparkSession, data_dir: str) -> DataFrame:
        fulfilled = live_dashboard(spark, data_dir).fulfilled()
        path = f"{_run_dir(spark, 'names')}/index"
        name_index.add_names(spark, fulfilled, path)
        return name_index.indexed_report(spark, fulfilled, path, offer_filter, search, literal)
    run.__name__, run.__doc__ = f"{name}_indexed", "The report with its name search answered from a trigram index (B9, F9)."
    REGISTRY[run.__name__] = run
    LIVE_ORACLE[run.__name__] = ORACLE_SQL[name]


_indexed_report("fulfilled_report", config.DRINK_LABEL, "member 1", False)
_indexed_report("fulfilled_report_literal", "All", "MEMBER 1", True)
REGISTRY["rebuild_summary"] = rebuild_summary
LIVE_ORACLE["rebuild_summary"] = with_(tx_cte(), summary_cte(P.window)) + f"SELECT {SUMMARY_OUT} FROM summary"
