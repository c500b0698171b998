"""Hand-made tables for the quirks the reference's SQL defines (FIXTURES §5)."""

from decimal import Decimal

from pyspark.sql import functions as F

from perkflow import config
from perkflow.operators import analytics, ledger, offers
from perkflow.operators.summary import member_window_summary
from perkflow.sources.wire import corrupt_rows, decode_transactions, valid_rows
from tests.helpers import ts, tx_rows


def _summary(spark, rows, window="5 minutes"):
    return member_window_summary(tx_rows(spark, rows), window)


def test_inclusive_thresholds(spark):
    s = _summary(spark, [
        (1, 1, "A", "bet", 5000.00, "slot", "2024-01-01 10:00:01"),
        (2, 2, "B", "bet", 1000.00, "slot", "2024-01-01 10:00:01"),
        (3, 3, "C", "bet", 4999.99, "slot", "2024-01-01 10:00:01"),
        (4, 4, "D", "bet", 999.99, "slot", "2024-01-01 10:00:01"),
    ])
    hotel = {r.member_id for r in offers.hotel_room_offers(s).collect()}
    drink = {r.member_id: r.loss_amount for r in offers.drink_offers(s).collect()}
    assert hotel == {1}
    assert set(drink) == {1, 2, 3}  # 999.99 loss misses the drink by a cent
    assert drink[2] == Decimal("1000.00")


def test_net_zero_counts_as_winning_and_no_drink(spark):
    s = _summary(spark, [
        (1, 1, "A", "bet", 1500, "slot", "2024-01-01 10:00:01"),
        (2, 1, "A", "win", 1500, "slot", "2024-01-01 10:00:02"),
    ])
    row = s.collect()[0]
    assert row.net_amount == 0
    assert offers.drink_offers(s).count() == 0
    st = analytics.overall_stats(s).collect()[0]
    assert (st.winning_members, st.losing_members) == (1, 0)


def test_cashout_only_window(spark):
    s = _summary(spark, [(1, 7, "Z", "cashout", 300, "slot", "2024-01-01 10:00:01"),
                         (2, 7, "Z", "cashout", 200, "slot", "2024-01-01 10:01:01")])
    r = s.collect()[0]
    assert (r.total_spend, r.total_winnings, r.net_amount, r.transaction_count) == (0, 0, 0, 2)


def test_null_type_amount_time(spark):
    s = _summary(spark, [
        (1, 1, "A", None, 100, "slot", "2024-01-01 10:00:01"),      # type NULL: 0 money, counted
        (2, 1, "A", "bet", None, "slot", "2024-01-01 10:00:02"),    # amount NULL: ignored by sum
        (3, 1, "A", "bet", 50, "slot", "2024-01-01 10:00:03"),
        (4, 1, "A", "bet", 70, "slot", None),                       # time NULL: no window
    ])
    rows = s.collect()
    assert len(rows) == 1
    r = rows[0]
    assert r.total_spend == Decimal("50.00")
    assert r.net_amount == Decimal("-50.00")
    assert r.transaction_count == 3


def test_renamed_member_splits(spark):
    s = _summary(spark, [(1, 1, "Ann", "bet", 10, "slot", "2024-01-01 10:00:01"),
                         (2, 1, "Anne", "bet", 10, "slot", "2024-01-01 10:00:02")])
    assert s.count() == 2


def test_hotel_and_drink_same_window(spark):
    s = _summary(spark, [(1, 1, "A", "bet", 6000, "slot", "2024-01-01 10:00:01")])
    status = analytics.all_members(s).collect()[0].reward_status
    assert status == config.HOTEL_LABEL
    c = analytics.reward_eligibility_counts(s).collect()[0]
    assert (c.hotel_eligible, c.drink_eligible, c.total) == (1, 1, 1)
    dist = {r.reward: r.reward_count for r in analytics.reward_eligibility_distribution(s).collect()}
    # the remainder subtracts the overlapping window twice, as the chart does
    assert dist == {"Hotel Room": 1, "Free Drink": 1, "No Reward": -1}


def test_history_bound_is_exclusive_and_days_stay_apart(spark):
    s = _summary(spark, [
        (1, 1, "A", "bet", 6000, "slot", "2024-01-15 23:55:01"),  # window ends at 2024-01-16 00:00
        (2, 1, "A", "bet", 6000, "slot", "2024-01-14 10:00:01"),
        (3, 2, "B", "bet", 6000, "slot", "2024-01-13 10:00:01"),  # same clock time, other day
    ])
    hist = offers.offer_history(s, config.HOTEL, 5000, "2024-01-16 00:00:00")
    assert {r.window_start for r in hist.collect()} == {ts("2024-01-14 10:00:00"), ts("2024-01-13 10:00:00")}
    last = offers.last_windows(hist, 3).collect()
    assert len({(r.window_start, r.window_end) for r in last}) == 2
    assert {r.interval_label for r in last} == {"10:00:00 - 10:05:00"}
    counts = offers.history_window_counts(hist, 3).collect()
    assert len(counts) == 2 and all(r.qualifying_members == 1 for r in counts)


def test_interval_containment_not_overlap(spark):
    s = _summary(spark, [(1, 1, "A", "bet", 6000, "slot", "2024-01-16 00:02:00")], window="1 hour")
    led = ledger.empty_ledger(spark)
    # an interval [00:00, 00:05] does not contain the 1-hour window [00:00, 01:00]
    out = offers.interval_offers(s, led, config.HOTEL, 5000, "2024-01-16 00:00:00", "2024-01-16 00:05:00",
                                 "2024-01-16")
    assert out.count() == 0


def _requests(spark, rows):
    return spark.createDataFrame(
        [(m, n, t, ts(a)) for m, n, t, a in rows],
        "member_id long, member_name string, offer_type string, requested_at timestamp_ntz")


def test_duplicate_requests_and_rerun_add_one_row(spark, tmp_dir):
    path = f"{tmp_dir}/ledger"
    req = _requests(spark, [
        (1, "O'Brien", "hotel", "2024-01-16 10:00:00.700"),
        (1, "O'Brien", "hotel", "2024-01-16 09:00:00"),
        (1, "O'Brien", "drink", "2024-01-16 11:00:00"),
        (2, "B", "hotel", "2024-01-17 01:00:00"),
        (None, "X", "hotel", "2024-01-16 01:00:00"),
    ])
    assert ledger.append_redemptions(spark, req, path) == 3
    assert ledger.append_redemptions(spark, req, path) == 0
    rows = ledger.read_ledger(spark, path).orderBy("member_id", "offer_type").collect()
    assert [(r.member_id, r.offer_type, str(r.redemption_date)) for r in rows] == [
        (1, "drink", "2024-01-16"), (1, "hotel", "2024-01-16"), (2, "hotel", "2024-01-17")]
    hotel1 = [r for r in rows if r.member_id == 1 and r.offer_type == "hotel"][0]
    assert hotel1.redeemed_at == ts("2024-01-16 09:00:00")  # first request wins
    assert hotel1.member_name == "O'Brien"
    check = ledger.offer_redeemed_check(
        _requests(spark, [(1, "O'Brien", "hotel", "2024-01-16 12:00:00"),
                          (2, "B", "hotel", "2024-01-16 12:00:00")]).select("member_id", "offer_type"),
        ledger.read_ledger(spark, path), "2024-01-16").orderBy("member_id").collect()
    assert [r.already_redeemed for r in check] == [True, False]


def test_pending_excludes_redeemed_today_only(spark):
    s = _summary(spark, [
        (1, 1, "A", "bet", 6000, "slot", "2024-01-16 10:00:01"),
        (2, 2, "B", "bet", 6000, "slot", "2024-01-16 10:00:01"),
    ])
    led = ledger.new_redemptions(_requests(spark, [(1, "A", "hotel", "2024-01-16 11:00:00"),
                                                   (2, "B", "hotel", "2024-01-15 11:00:00")]), None)
    pend = ledger.pending_offers(offers.hotel_room_offers(s), offers.drink_offers(s), led, "2024-01-16")
    got = {(r.member_id, r.offer_type) for r in pend.collect()}
    assert got == {(2, "hotel"), (1, "drink"), (2, "drink")}
    labels = {r.metric_label for r in pend.where(F.col("offer_type") == "hotel").collect()}
    assert labels == {"Spend: $6000.00"}


def test_fulfilled_report_filters(spark):
    led = ledger.new_redemptions(_requests(spark, [(1, "Alice", "hotel", "2024-01-16 11:00:00"),
                                                   (2, "alfred", "drink", "2024-01-16 12:00:00"),
                                                   (3, "Bob", "drink", "2024-01-16 13:00:00")]), None)
    f = ledger.fulfilled_offers(led)
    rep = ledger.fulfilled_report(f, config.DRINK_LABEL, "AL").collect()
    assert [tuple(r) for r in rep] == [(2, "alfred", config.DRINK_LABEL, "2024-01-16 12:00:00")]
    assert list(ledger.fulfilled_report(f).columns) == list(config.FULFILLMENT_CSV_HEADERS)
    # regex by default, literal on request
    assert ledger.fulfilled_report(f, "All", "^b").count() == 1
    assert ledger.fulfilled_report(f, "All", "a.", literal=True).count() == 0
    c = ledger.fulfilled_counts(f).collect()[0]
    assert (c.total_fulfilled, c.fulfilled_hotel, c.fulfilled_drink, c.unique_members) == (3, 1, 2, 3)


def test_malformed_json_goes_to_corrupt(spark):
    raw = spark.createDataFrame([
        ('{"transaction_id":1,"member_id":1001,"member_name":"A","transaction_type":"bet",'
         '"amount":12.349,"game_type":"slot","transaction_time":"2024-01-01 00:00:01"}',),
        ("{not json",),
    ], "value string")
    dec = decode_transactions(raw)
    good = valid_rows(dec).collect()
    assert len(good) == 1 and good[0].amount == Decimal("12.35")
    assert corrupt_rows(dec).collect()[0]._corrupt == "{not json"


def test_money_text(spark):
    from perkflow.functions.text import money_text
    df = spark.createDataFrame([(Decimal("1234.5"),), (Decimal("-1234.5"),)], "x decimal(18,2)")
    assert [r[0] for r in df.select(money_text("x")).collect()] == ["$1,234.50", "$-1,234.50"]


def test_malformed_props_do_not_fail_the_adapter(spark):
    from perkflow.sources.events_adapter import GAME_REST, transactions_from_events
    import datetime as dt
    ev = spark.createDataFrame(
        [(1, dt.datetime(2024, 1, 1), 7, "purchase", 1.5, '{"k": "x"}'),
         (2, dt.datetime(2024, 1, 1), 7, "view", 2.0, "{bad"),
         (3, dt.datetime(2024, 1, 1), 7, "click", 3.0, '{"k": 10}')],
        "event_id long, ts timestamp_ntz, user_id long, event_type string, value double, props string")
    games = [r.game_type for r in transactions_from_events(ev).orderBy("transaction_id").collect()]
    assert games == [GAME_REST, GAME_REST, "slot"]
