"""Kept tables: deltas, retractions, late rows, range cover, interrupted versions."""

import datetime as dt
import random

import pytest
from pyspark.sql import functions as F

from perkflow.operators import analytics
from perkflow.operators import offers as offer_ops
from perkflow.operators.offers import latest_offer_rows, offer_rows
from perkflow.operators.summary import member_window_summary
from perkflow.sources.schemas import SUMMARY_COLUMNS
from perkflow.streaming.kept import KeptTables, cover
from tests.helpers import tx_rows


def random_tx(n, seed, days=2):
    rng = random.Random(seed)
    rows = []
    for i in range(n):
        t = dt.datetime(2024, 1, 1) + dt.timedelta(seconds=rng.randrange(days * 86400 // 8) * 8)
        rows.append((i, rng.randrange(6), f"M{rng.randrange(2)}", rng.choice(["bet", "bet", "win", "cashout", None]),
                     rng.choice([50, 700, 1500, 5200, None]), "slot", str(t)))
    return rows


def rows_of(df):
    return sorted((tuple(r) for r in df.collect()), key=str)


def stats_equal(kept, want):
    a, b = kept.overall_stats().first().asDict(), analytics.overall_stats(want).first().asDict()
    assert a == b


def check(spark, kept, all_tx):
    """Every kept table against the same question over all transactions."""
    want = member_window_summary(all_tx).cache()
    assert rows_of(kept.summary()) == rows_of(want.select(*SUMMARY_COLUMNS))
    stats_equal(kept, want)
    assert rows_of(analytics.eligibility_rows(kept.eligibility())) == rows_of(analytics.reward_eligibility_distribution(want))
    offers = offer_rows(want)
    assert rows_of(kept.latest_offers()) == rows_of(latest_offer_rows(offers))
    added = kept.offer_log().groupBy(*offers.columns).agg(F.sum("sign").alias("n")).where("n <> 0")
    assert rows_of(added.select(*offers.columns)) == rows_of(offers)
    assert added.where("n <> 1").count() == 0
    board = analytics.member_leaderboard(want)
    assert rows_of(kept.leaderboard().select(*board.columns)) == rows_of(board)
    lo, hi = dt.datetime(2024, 1, 1, 3, 10), dt.datetime(2024, 1, 2, 9, 20)
    inside = want.where((F.col("window_start") >= F.lit(str(lo)).cast("timestamp_ntz"))
                        & (F.col("window_end") <= F.lit(str(hi)).cast("timestamp_ntz")))
    r, w = kept.range_stats(lo, hi).first(), analytics.overall_stats(inside).first()
    assert (r["total_revenue"], r["transactions"], r["winning"] or 0, r["losing"] or 0) == \
        (w["total_revenue"], w["total_transactions"], w["winning_members"] or 0, w["losing_members"] or 0)
    assert abs((r["member_estimate"] or 0) - w["total_members"]) <= 1
    return want


def test_windows_that_change_twice_and_a_retracted_offer(spark, tmp_dir):
    kept = KeptTables(spark, tmp_dir, delay="3 days", buckets=3)
    parts = [[(1, 1, "A", "bet", 2000, "slot", "2024-01-01 10:00:01"), (2, 2, "B", "bet", 6000, "slot", "2024-01-01 10:00:02")],
             [(3, 1, "A", "win", 1500, "slot", "2024-01-01 10:01:00"), (4, 3, None, "bet", 1000, "slot", None)],
             [(5, 1, "A", "bet", 500, "slot", "2024-01-01 10:02:00"), (6, None, None, "bet", 9000, "slot", "2024-01-02 10:02:00")]]
    for n, part in enumerate(parts):
        kept.process(tx_rows(spark, part), n)
        check(spark, kept, tx_rows(spark, [r for p in parts[:n + 1] for r in p]))
    log = [(r["version"], r["sign"], r["member_id"], r["offer_type"]) for r in kept.offer_log().collect()]
    drink = [x for x in sorted(log, key=str) if x[2] == 1]
    assert drink == [(0, 1, 1, "drink"), (1, -1, 1, "drink"), (2, 1, 1, "drink")]


def test_random_batches_equal_the_batch_summary(spark, tmp_dir):
    rows = random_tx(400, 7)
    kept = KeptTables(spark, tmp_dir, delay="3 days", buckets=4)
    for n in range(3):
        kept.process(tx_rows(spark, rows[n::3]), n)
    want = check(spark, kept, tx_rows(spark, rows))
    for kind in ("hotel", "drink"):
        got = [tuple(r) for r in kept.newest_qualifying(kind, dt.datetime(2024, 1, 2, 20), 3).collect()]
        per = offer_rows(want).where((F.col("offer_type") == kind) & (F.col("window_end") < "2024-01-02 20:00:00")) \
            .groupBy("window_start", "window_end").count().orderBy(F.desc("window_start")).limit(3)
        assert got == [tuple(r) for r in per.collect()]
        before = dt.datetime(2024, 1, 2, 20)
        history = offer_ops.qualifying_history(want, kind, 5000 if kind == "hotel" else 1000, before)
        last = kept.last_windows(kind, before)
        assert rows_of(last) == rows_of(offer_ops.last_windows(history))
        plan = spark._jvm.PythonSQLUtils.explainString(last._jdf.queryExecution(), "formatted")
        scans = [ln for ln in plan.splitlines() if ln.startswith("PartitionFilters")]
        assert scans and all("window_date" in x and ">=" in x and "<=" in x for x in scans)


def test_late_rows_are_kept_and_corrected(spark, tmp_dir):
    """Batches in time order but for a share of rows that come a batch or more too late, among them closed offers' wins."""
    rows = sorted(random_tx(360, 11, days=3), key=lambda r: r[6])
    rng = random.Random(3)
    parts = [[], [], [], []]
    for i, r in enumerate(rows):
        parts[min(3, i * 3 // len(rows) + (rng.random() < 0.2) + (rng.random() < 0.1))].append(r)
    kept = KeptTables(spark, tmp_dir, buckets=2)
    seen, late = None, []
    for n, part in enumerate(parts):
        for r in part:
            t = dt.datetime.fromisoformat(r[6])
            end = t - dt.timedelta(minutes=t.minute % 5, seconds=t.second) + dt.timedelta(minutes=5)
            if seen is not None and end <= seen - dt.timedelta(seconds=10):
                late.append(r[0])
        seen = max([seen] * (seen is not None) + [dt.datetime.fromisoformat(r[6]) for r in part])
        kept.process(tx_rows(spark, part), n)
        if n == 2:
            assert kept.correct_late() == len(late) > 10
            check(spark, kept, tx_rows(spark, [r for p in parts[:3] for r in p]))
    assert sorted(r["transaction_id"] for r in kept.late_transactions().collect()) == sorted(late)
    assert kept.correct_late() > 0 and kept.correct_late() == 0
    check(spark, kept, tx_rows(spark, rows))


def test_interrupted_and_repeated_versions_lose_and_repeat_nothing(spark, tmp_dir, monkeypatch):
    rows = random_tx(200, 5)
    kept = KeptTables(spark, tmp_dir, delay="1 hour", buckets=2)
    kept.process(tx_rows(spark, rows[:100]), 0)

    def broken(*_):
        raise OSError("lost before the commit")

    before = rows_of(kept.summary())
    with monkeypatch.context() as m:
        m.setattr(kept.files, "commit", broken)
        with pytest.raises(OSError):
            kept.process(tx_rows(spark, rows[100:]), 1)
    assert rows_of(kept.summary()) == before           # nothing of it is read
    assert kept.correct_late() == 0
    kept.process(tx_rows(spark, rows[100:]), 1)
    after = rows_of(kept.summary())
    kept.process(tx_rows(spark, rows[100:]), 1)        # run again after its commit
    assert rows_of(kept.summary()) == after and kept.files.newest().version == 1
    n_late = kept.late_transactions().count()
    assert n_late > 0
    with monkeypatch.context() as m:
        m.setattr(kept.files, "commit", broken)
        with pytest.raises(OSError):
            kept.process(tx_rows(spark, rows[:50]), 2)     # leaves late rows under the next version
    assert kept.correct_late() == n_late
    assert kept.late_transactions().count() == n_late
    check(spark, kept, tx_rows(spark, rows))


def test_empty_batches_and_no_batches(spark, tmp_dir):
    kept = KeptTables(spark, tmp_dir)
    assert kept.summary().count() == kept.latest_offers().count() == kept.offer_log().count() == 0
    assert kept.correct_late() == 0
    kept.process(tx_rows(spark, [(1, 1, "A", "bet", 1, "slot", "2024-01-01 10:00:01")]).limit(0), 0)
    stats_equal(kept, member_window_summary(tx_rows(spark, [(1, 1, "A", "bet", 1, "slot", "2024-01-01 10:00:01")]).limit(0)))
    kept.process(tx_rows(spark, [(1, 1, "A", "bet", 1, "slot", "2024-01-01 10:00:01")]), 1)
    assert kept.overall_stats().first()["total_members"] == 1


def test_cover_uses_the_fewest_windows():
    sizes = (300, 3600, 86400)
    rng = random.Random(2)
    start0 = dt.datetime(2024, 1, 1)
    for _ in range(300):
        a = start0 + dt.timedelta(seconds=rng.randrange(4 * 86400), microseconds=rng.choice([0, 0, 7]))
        b = a + dt.timedelta(seconds=rng.randrange(4 * 86400))
        got = cover(a, b, sizes)
        held = sorted((x, y) for _, x, y in got)
        assert all(y == x for (_, y), (x, _) in zip(held[:-1], held[1:]))
        small = [start0 + dt.timedelta(seconds=300 * i) for i in range(10 * 288)]
        inside = [t for t in small if t >= a and t + dt.timedelta(seconds=300) <= b]
        assert (held == []) == (inside == []), (a, b)
        if inside:
            assert held[0][0] == inside[0] and held[-1][1] == inside[-1] + dt.timedelta(seconds=300)
        n = sum((y - x) // dt.timedelta(seconds=s) for s, x, y in got)
        # greedily from the left, the largest aligned window that fits
        t, end, least = (inside[0], held[-1][1], 0) if inside else (None, None, 0)
        while inside and t < end:
            size = next(s for s in sorted(sizes, reverse=True)
                        if (t - start0) % dt.timedelta(seconds=s) == dt.timedelta(0) and t + dt.timedelta(seconds=s) <= end)
            t, least = t + dt.timedelta(seconds=size), least + 1
        assert n == least


def test_reads(spark, tmp_dir):
    """Statistics and latest offers read their own tables only, a range as few rows as its cover has windows."""
    kept = KeptTables(spark, tmp_dir, delay="3 days", buckets=2)
    kept.process(tx_rows(spark, random_tx(300, 4, days=3)), 0)
    for df, tables in ((kept.overall_stats(), {"stats", "members"}), (kept.latest_offers(), {"latest"}),
                       (kept.eligibility(), {"stats"}), (kept.leaderboard(), {"totals", "histogram"})):
        files = df.inputFiles()
        assert files and {f.split(tmp_dir.strip("/") + "/")[1].split("/")[0] for f in files} <= tables
    lo, hi = dt.datetime(2024, 1, 1, 22, 50), dt.datetime(2024, 1, 3, 1, 10)
    n = sum((y - x) // dt.timedelta(seconds=s) for s, x, y in cover(lo, hi, (300, 3600, 86400)))
    assert n == 2 + 1 + 1 + 1 + 2 and kept.stats_rows(lo, hi).count() <= n
    day = kept.stats_rows(dt.datetime(2024, 1, 2), dt.datetime(2024, 1, 3))
    assert [r["size"] for r in day.collect()] == [86400] and len({f.split("day=")[1][:10] for f in day.inputFiles()}) <= 2


def test_a_version_of_many_days_writes_statistics_by_month(spark, tmp_dir):
    """The files that a version writes for its statistics grow with the months that it touches, not with the days."""
    rows = [(i, i % 5, "A", "bet", 6000, "slot", str(dt.datetime(2023, 12, 30, 23, 58) + dt.timedelta(days=2 * i, hours=i)))
            for i in range(40)]
    kept = KeptTables(spark, tmp_dir, buckets=2)
    kept.process(tx_rows(spark, rows[::2]), 0)
    kept.process(tx_rows(spark, rows[1::2]), 1)
    months = {r[6][:7] for r in rows}
    assert len(kept.files.newest().tables["stats"]) == len(months) == 4
    assert kept.correct_late() > 10
    folders = [n for n in kept.files.names(kept.files.folder("stats", 2)) if "=" in n]
    assert 0 < len(folders) <= len(months)
    want = check(spark, kept, tx_rows(spark, rows))
    for before in (dt.datetime(2024, 3, 1), dt.datetime(2024, 1, 2)):
        got = [tuple(r) for r in kept.newest_qualifying("hotel", before, 3).collect()]
        per = offer_rows(want).where((F.col("offer_type") == "hotel") & (F.col("window_end") < F.lit(str(before)))) \
            .groupBy("window_start", "window_end").count().orderBy(F.desc("window_start")).limit(3)
        assert got == [tuple(r) for r in per.collect()]


def test_bands_keep_the_order():
    from pyspark.sql import SparkSession

    from perkflow.streaming.kept import band
    spark = SparkSession.getActiveSession()
    rng = random.Random(8)
    values = sorted({round(rng.choice([-1, 1]) * rng.random() * 10 ** rng.randrange(0, 12), 2) for _ in range(500)} | {0.0, 0.01})
    rows = spark.createDataFrame([(str(v),) for v in values] + [(None,)], "v string") \
        .select(F.col("v").cast("decimal(28,2)").alias("v")).select("v", band(F.col("v")).alias("b")).collect()
    got = [r["b"] for r in sorted(rows, key=lambda r: (r["v"] is not None, r["v"] or 0))]
    assert got == sorted(got)


def test_a_micro_batch_of_many_arrivals_gives_what_one_for_each_gives(spark, tmp_dir):
    """The same arrivals one by one and several at once: versions, retractions and late rows are the same."""
    def arrival(i):
        return None if i == 3 else (i * 7) % 5
    # a few windows only, which several arrivals change
    rows = [(*r[:6], f"2024-01-0{1 + i % 2} 10:{i * 13 % 20:02d}:{i % 60:02d}") for i, r in enumerate(random_tx(300, 21))]
    for delay in ("30 minutes", "3 days"):
        one, many = (KeptTables(spark, f"{tmp_dir}/{delay[0]}-{n}", delay=delay, buckets=2) for n in ("one", "many"))
        arrivals = [[r for r in rows if arrival(r[0]) == a] for a in (None, 0, 1, 2, 3, 4)]
        for n, part in enumerate(arrivals):
            one.process(tx_rows(spark, part), n)
        a = F.when(F.col("transaction_id") != 3, F.col("transaction_id") * 7 % 5).cast("long")
        for n, parts in enumerate((arrivals[:4], arrivals[4:])):
            many.process(tx_rows(spark, [r for p in parts for r in p]).withColumn("arrival", a), n)
        for _ in range(2):
            assert rows_of(many.summary()) == rows_of(one.summary())
            assert rows_of(many.late_transactions().drop("version")) == rows_of(one.late_transactions().drop("version"))
            assert rows_of(many.offer_log().drop("version", "arrival")) == rows_of(one.offer_log().drop("version", "arrival"))
            assert many.offer_log().where("sign < 0").count() > 0 or delay != "3 days"
            assert rows_of(many.latest_offers()) == rows_of(one.latest_offers())
            assert rows_of(many.leaderboard()) == rows_of(one.leaderboard())
            stats_equal(many, one.summary())
            assert many.correct_late() == one.correct_late()
        assert many.files.newest().version < one.files.newest().version
        check(spark, many, tx_rows(spark, rows))


def test_micro_batches_grow_with_rows_and_not_with_months():
    from perkflow.plans import kept_registry as k
    assert k.micro_batches([]) == [] and k.micro_batches([5] * 6) == list(range(6))
    for months in (2, 60, 360):
        dealt = k.micro_batches([16_700] * 6 * months)
        assert dealt == sorted(dealt) and set(dealt) == set(range(max(dealt) + 1))
        assert len(set(dealt)) == max(k.BATCHES, -(-16_700 * 6 * months // k.BATCH_ROWS))
    assert k.micro_batches([10 ** 9, 1, 1, 1, 1, 1, 1, 1, 1, 1])[0] == 0
