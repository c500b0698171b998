"""Golden counts of FIXTURES.md §4 (sf0.001 and sf0.01)."""

import pytest
from pyspark.sql import functions as F

from perkflow import config
from perkflow.operators import ledger, offers
from perkflow.plans.inputs import Inputs
from tests.conftest import SF_MID, SF_SMALL


def _counts(spark, sf, window):
    i = Inputs(spark, sf)
    s = i.summary(window).cache()
    h, d = i.hotel(summary=s), i.drink(summary=s)
    hk = h.select("member_id", "member_name", "window_start")
    dk = d.select("member_id", "member_name", "window_start")
    both = hk.join(dk, ["member_id", "member_name", "window_start"]).count()
    n, nh, nd = s.count(), h.count(), d.count()
    prev_h = offers.interval_offers(s, i.ledger(summary=s), config.HOTEL, 5000,
                                    "2024-01-15", "2024-01-16", "2024-01-16").count()
    prev_d = offers.interval_offers(s, i.ledger(summary=s), config.DRINK, 1000,
                                    "2024-01-15", "2024-01-16", "2024-01-16").count()
    pend = ledger.pending_offers(h, d, i.ledger(summary=s), "2024-01-16")
    ph = pend.where(F.col("offer_type") == "hotel").count()
    pd_ = pend.where(F.col("offer_type") == "drink").count()
    s.unpersist()
    return (n, nh, nd, both, n - nh - nd + both, prev_h, prev_d, ph, pd_)


@pytest.mark.parametrize("sf,window,expected", [
    (SF_SMALL, "5 minutes", (993, 56, 285, 56, 708, 2, 10, 12, 14)),
    (SF_SMALL, "1 hour", (951, 56, 279, 56, 672, 2, 10, 12, 13)),
    (SF_SMALL, "1 day", (397, 73, 145, 64, 243, 2, 6, 14, 12)),
    (SF_MID, "5 minutes", (9963, 528, 2655, 528, 7308, 14, 77, 140, 122)),
    (SF_MID, "1 day", (4006, 712, 1427, 642, 2509, 20, 40, 141, 138)),
])
def test_golden_counts(spark, sf, window, expected):
    assert _counts(spark, sf, window) == expected


def test_ledger_and_transaction_totals_sf001(spark):
    i = Inputs(spark, SF_MID)
    led = i.ledger()
    by_type = {r.offer_type: r["count"] for r in led.groupBy("offer_type").count().collect()}
    assert by_type == {"hotel": 172, "drink": 669}
    today = {r.offer_type: r["count"] for r in
             led.where(F.col("redemption_date") == F.lit("2024-01-16").cast("date"))
             .groupBy("offer_type").count().collect()}
    assert today == {"hotel": 7, "drink": 28}
    tx = i.tx()
    t = {r.transaction_type: (r.n, float(r.amt or 0)) for r in
         tx.groupBy("transaction_type").agg(F.count("*").alias("n"), F.sum("amount").alias("amt")).collect()}
    assert t["bet"] == (3987, 9870338.50) and t["win"] == (3999, 9947183.50) and t["cashout"][0] == 2014
    games = {r.game_type: r["count"] for r in tx.groupBy("game_type").count().collect()}
    assert games == {"slot": 3957, "blackjack": 2511, "roulette": 1988, "poker": 1544}


def test_invariants(spark):
    i = Inputs(spark, SF_SMALL)
    tx = i.tx()
    s5, s1d = i.summary("5 minutes", tx=tx), i.summary("1 day", tx=tx)
    assert s5.where(F.col("net_amount") != F.col("total_winnings") - F.col("total_spend")).count() == 0
    tot = lambda df, c: df.agg(F.sum(c)).collect()[0][0]
    assert tot(s5, "total_spend") == tot(s1d, "total_spend") == \
        tx.where(F.col("transaction_type") == "bet").agg(F.sum("amount")).collect()[0][0]
    assert tot(s5, "transaction_count") == tx.count()
    led = i.ledger()
    assert led.groupBy("member_id", "offer_type", "redemption_date").count().where("count > 1").count() == 0
    pend = ledger.pending_offers(i.hotel(), i.drink(), led, "2024-01-16")
    today = ledger.redeemed_on(led, "2024-01-16")
    assert pend.join(today, ["member_id", "offer_type"]).count() == 0


@pytest.mark.parametrize("window", ["5 minutes", "1 hour", "1 day"])
def test_day_restricted_ledger_is_exact(spark, window):
    i = Inputs(spark, SF_SMALL)
    full = i.ledger(window)
    for day in ["2024-01-01", "2024-01-16", "2024-01-30", "2024-01-31"]:
        want = full.where(F.col("redemption_date") == F.lit(day).cast("date"))
        got = i.ledger_on(day, window)
        assert sorted(map(tuple, got.collect())) == sorted(map(tuple, want.collect()))
