"""The materialized read path answers exactly what the registered queries answer."""

import pytest

import __spark_entry__ as entry
from perkflow.plans.dashboard import Dashboard
from perkflow.plans.inputs import Inputs, money_as_double
from perkflow.sources.fixtures import simulated_requests_from_rows
from tests.conftest import SF_SMALL

Q = entry.queries()
AS_OF, TODAY = "2024-01-16 12:00:00", "2024-01-16"


@pytest.fixture(scope="module")
def dash(spark):
    import tempfile
    root = tempfile.mkdtemp(prefix="perkflow-dash-")
    i = Inputs(spark, SF_SMALL)
    d = Dashboard.build(spark, i.tx(), f"{root}/summary", f"{root}/ledger", interval_seconds=86400)
    assert d.redeem(simulated_requests_from_rows(i.offer_rows())) > 0
    assert d.redeem(simulated_requests_from_rows(i.offer_rows())) == 0   # idempotent
    return d


def _rows(df):
    return sorted(map(tuple, money_as_double(df).collect()), key=repr)


@pytest.mark.parametrize("name,call", [
    ("pending_offers", lambda d: d.pending(TODAY)),
    ("hotel_previous", lambda d: d.interval_offers("hotel", "previous", AS_OF, TODAY)),
    ("drink_current", lambda d: d.interval_offers("drink", "current", AS_OF, TODAY)),
    ("hotel_history", lambda d: d.history("hotel", AS_OF)),
    ("drink_last_windows", lambda d: d.last_windows("drink", AS_OF)),
    ("hotel_history_window_counts", lambda d: d.history_window_counts("hotel", AS_OF)),
    ("interval_qualifier_count", lambda d: d.interval_counts(AS_OF)),
    ("fulfilled_offers", lambda d: d.fulfilled()),
    ("overall_stats", lambda d: d.stats()),
    ("overall_stats_today", lambda d: d.stats("Today", AS_OF)),
    ("reward_eligibility_distribution", lambda d: d.reward_distribution()),
    ("win_loss_distribution", lambda d: d.win_loss()),
    ("top_spenders", lambda d: d.top_spenders()),
    ("top_spenders_last_hour", lambda d: d.top_spenders("Last Hour", AS_OF)),
    ("all_members_today", lambda d: d.all_members("Today", AS_OF)),
    ("member_leaderboard", lambda d: d.leaderboard()),
    ("summary_row_count", lambda d: d.row_count()),
])
def test_dashboard_equals_registered_query(spark, dash, name, call):
    assert _rows(call(dash)) == _rows(Q[name](spark, SF_SMALL))


def test_dashboard_reads_prune_dates(spark, dash):
    df = dash.interval_offers("hotel", "previous", AS_OF, TODAY)
    plan = spark._jvm.PythonSQLUtils.explainString(df._jdf.queryExecution(), "formatted")
    part = [ln for ln in plan.splitlines() if ln.startswith("PartitionFilters")]
    assert any("window_date" in ln for ln in part), "summary must be pruned to the interval's days"
    assert any("redemption_date" in ln for ln in part), "ledger must be pruned to today's partition"


@pytest.fixture(scope="module")
def bucketed(spark):
    import tempfile
    root = tempfile.mkdtemp(prefix="perkflow-dash-b-")
    i = Inputs(spark, SF_SMALL)
    d = Dashboard.build(spark, i.tx(), f"{root}/summary", f"{root}/ledger", interval_seconds=86400,
                        buckets=4, table_name="member_daily_summary_bucketed")
    d.redeem(simulated_requests_from_rows(i.offer_rows()))
    return d


@pytest.mark.parametrize("name,call", [
    ("pending_offers", lambda d: d.pending(TODAY)),
    ("member_leaderboard", lambda d: d.leaderboard()),
    ("overall_stats", lambda d: d.stats()),
    ("hotel_previous", lambda d: d.interval_offers("hotel", "previous", AS_OF, TODAY)),
])
def test_bucketed_dashboard_equals_registered_query(spark, bucketed, name, call):
    assert _rows(call(bucketed)) == _rows(Q[name](spark, SF_SMALL))


def test_bucketing_removes_the_per_member_shuffle(spark, bucketed):
    from perkflow.operators import analytics, offers
    for df in (analytics.member_totals(bucketed.summary()),
               offers.latest_offer_rows(offers.offer_rows(bucketed.summary()))):
        plan = df._jdf.queryExecution().executedPlan().toString()
        assert "Exchange" not in plan and "Bucketed: true" in plan


def test_bucketed_table_has_one_file_per_day_and_bucket(bucketed):
    import glob
    days = glob.glob(f"{bucketed.summary_path}/window_date=*")
    files = glob.glob(f"{bucketed.summary_path}/window_date=*/*.parquet")
    assert days and len(files) <= 4 * len(days)


def test_an_append_to_the_ledger_writes_few_files_a_day(spark, tmp_dir):
    """Each day's rows come from one task, however many tasks read the batch."""
    import datetime as dt
    import glob
    from perkflow.operators import ledger
    rows = [(i, f"M{i}", "drink", dt.datetime(2024, 1, 1 + i % 10, 12)) for i in range(400)]
    requests = spark.createDataFrame(rows, "member_id long, member_name string, offer_type string, requested_at timestamp_ntz")
    key = "spark.sql.adaptive.coalescePartitions.enabled"
    old = spark.conf.get(key)
    spark.conf.set(key, "false")
    try:
        assert ledger.append_redemptions(spark, requests, f"{tmp_dir}/ledger") == 400
    finally:
        spark.conf.set(key, old)
    assert len(glob.glob(f"{tmp_dir}/ledger/redemption_date=*/*.parquet")) == 10
    assert ledger.read_ledger(spark, f"{tmp_dir}/ledger").count() == 400
