"""Steps of a kept-table version: what they shuffle, what they add up, and that independent ones run at a time."""

import datetime as dt
import threading
from decimal import Decimal

import pytest
from pyspark.sql import functions as F

from perkflow.sources.schemas import SUMMARY_COLUMNS
from perkflow.streaming.kept import (STATS_SCHEMA, WINDOWS_SCHEMA, added_stats, offer_changes, signed_changes, stats_changes,
                                     together)

T0 = dt.datetime(2024, 1, 5, 23, 50)
MIN = dt.timedelta(minutes=1)


def _versions(spark):
    """A new window, one that changed, one whose new version equals the old one, one with nulls, one unchanged."""
    def row(member, start, spend, net, n, old=None, changed=True):
        money = [None if x is None else Decimal(x) for x in (spend, spend, net)]
        return (member, None if member is None else f"Member {member}", start, start + 5 * MIN, *money, n, start + MIN, 1,
                changed, old and (Decimal(old[0]), Decimal(old[0]), Decimal(old[1]), old[2], start + MIN), 0, 0,
                start.date())
    return spark.createDataFrame([
        row(1, T0, 6000, -6000, 2),
        row(2, T0, 7000, -7000, 3, old=(6500, -6500, 2)),
        row(3, T0 + 5 * MIN, 6000, -6000, 1, old=(6000, -6000, 1)),
        row(None, T0 + 5 * MIN, None, None, 1),
        row(4, T0 + 15 * MIN, 10, 10, 1),
        row(5, T0, 9000, -9000, 1, changed=False)], WINDOWS_SCHEMA)


def _plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


def test_offers_of_a_version_are_compared_within_their_row(spark):
    log = offer_changes(signed_changes(_versions(spark)), 5000, 500)
    assert "Exchange" not in _plan(log)
    assert {(r["member_id"], r["sign"], r["offer_type"], int(r["metric_value"])) for r in log.collect()} == {
        (m, s, kind, value) for m, s, value in ((1, 1, 6000), (2, 1, 7000), (2, -1, 6500)) for kind in ("hotel", "drink")}
    assert log.count() == 6 and set(SUMMARY_COLUMNS) < set(log.columns)


def test_stats_are_added_up_by_window_before_hours_and_days(spark):
    changes = signed_changes(_versions(spark))
    more = stats_changes(changes, 300, 5000, 500)
    plan = _plan(more)
    assert plan.index("Generate") < plan.index("Aggregate")     # outermost first: rows are widened after the sum
    got = {(r["size"], r["window_start"]): (r["revenue"], r["windows"], r["spend_rows"], r["transactions"], r["winning"],
                                            r["losing"], r["hotel"], r["drink"], r["estimate"])
           for r in added_stats(more.select(*STATS_SCHEMA.fieldNames()))
           .withColumn("estimate", F.hll_sketch_estimate("members")).collect()}
    day1, day2 = dt.datetime(2024, 1, 5), dt.datetime(2024, 1, 6)
    first, other = (Decimal(6500), 1, 1, 3, 0, 1, 1, 1, 1), (None, 1, 0, 1, None, None, None, None, 0)
    last = (Decimal(10), 1, 1, 1, 1, 0, 0, 0, 1)
    both = (Decimal(6500), 2, 1, 4, 0, 1, 1, 1, 1)
    got = {k: tuple(0 if x is None else x for x in v) for k, v in got.items()}
    assert got == {k: tuple(0 if x is None else x for x in v) for k, v in {
        (300, T0): first, (300, T0 + 5 * MIN): other, (300, T0 + 15 * MIN): last,
        (3600, T0.replace(minute=0)): both, (3600, day2): last, (86400, day1): both, (86400, day2): last}.items()}


def test_independent_steps_run_at_a_time_and_end_before_a_failure_is_told(spark):
    meet, ended = threading.Barrier(2, timeout=60), []

    def step(name, fails=False):
        def run():
            meet.wait()
            if fails:
                raise ValueError(name)
            ended.append(name)
            return {name: spark.range(3).count()}
        return run

    assert together(spark, [step("a"), step("b")]) == {"a": 3, "b": 3}
    with pytest.raises(ValueError):
        together(spark, [step("c", fails=True), step("d")])
    assert ended[-1] == "d"
