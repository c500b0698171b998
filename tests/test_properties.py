"""Property tests: the summary equals a brute-force computation for any row
order and any partitioning of the input (SURVEY §5.6)."""

import datetime as dt
from collections import defaultdict
from decimal import Decimal

from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st

from perkflow.operators.summary import member_window_summary
from tests.helpers import TX_NTZ_SCHEMA

BASE = dt.datetime(2024, 1, 1)
row = st.tuples(
    st.integers(1, 4),                                              # member
    st.sampled_from(["bet", "win", "cashout", None]),               # type
    st.one_of(st.none(), st.integers(0, 900_000).map(lambda c: Decimal(c) / 100)),  # amount
    st.one_of(st.none(), st.integers(0, 3 * 3600)),                 # seconds after BASE
)


def _sql_sum(values):
    """SQL SUM: NULLs ignored, NULL when every input is NULL."""
    vals = [v for v in values if v is not None]
    return sum(vals, Decimal(0)) if vals else None


def brute_force(rows):
    groups = defaultdict(list)
    for (m, typ, amt, off) in rows:
        if off is None:
            continue                                    # no event time, no window
        start = BASE + dt.timedelta(seconds=(off // 300) * 300)
        groups[(m, f"M{m}", start)].append((typ, amt, BASE + dt.timedelta(seconds=off)))
    out = []
    for (m, n, s), items in groups.items():
        spend = _sql_sum(a if t == "bet" else Decimal(0) for t, a, _ in items)
        wins = _sql_sum(a if t == "win" else Decimal(0) for t, a, _ in items)
        net = _sql_sum(a if t == "win" else (None if a is None else -a) if t == "bet" else Decimal(0)
                       for t, a, _ in items)
        out.append((m, n, s, s + dt.timedelta(minutes=5), spend, wins, net, len(items),
                    max(ts for _, _, ts in items)))
    return sorted(out)


@settings(max_examples=12, deadline=None, suppress_health_check=[HealthCheck.function_scoped_fixture])
@given(rows=st.lists(row, min_size=0, max_size=40), parts=st.integers(1, 5), seed=st.integers(0, 99))
def test_summary_matches_brute_force(spark, rows, parts, seed):
    data = [(i, m, f"M{m}", typ, amt, "slot", None if off is None else BASE + dt.timedelta(seconds=off))
            for i, (m, typ, amt, off) in enumerate(rows)]
    df = spark.createDataFrame(data, TX_NTZ_SCHEMA)
    shuffled = df.orderBy((df.transaction_id * (seed + 7)) % 41).repartition(parts)
    got = sorted(tuple(r) for r in member_window_summary(shuffled).collect())
    assert got == brute_force(rows)


request = st.tuples(st.integers(1, 3), st.sampled_from(["hotel", "drink"]), st.integers(0, 3 * 86400 - 1))


@settings(max_examples=6, deadline=None, suppress_health_check=[HealthCheck.function_scoped_fixture])
@given(reqs=st.lists(request, min_size=1, max_size=25), chunks=st.integers(1, 3))
def test_ledger_batches_equal_one_batch(spark, tmp_path_factory, reqs, chunks):
    from perkflow.operators import ledger
    path = str(tmp_path_factory.mktemp("ledger") / "l")
    rows = sorted((m, f"M{m}", t, BASE + dt.timedelta(seconds=s)) for m, t, s in reqs)
    rows.sort(key=lambda r: r[3])                      # requests arrive in time order
    schema = "member_id long, member_name string, offer_type string, requested_at timestamp_ntz"
    size = -(-len(rows) // chunks)
    for k in range(0, len(rows), size):
        ledger.append_redemptions(spark, spark.createDataFrame(rows[k:k + size], schema), path)
    again = ledger.append_redemptions(spark, spark.createDataFrame(rows, schema), path)
    got = sorted(tuple(r) for r in ledger.read_ledger(spark, path).collect())
    want = {}
    for m, n, t, at in rows:                           # first request per (member, type, day) wins
        want.setdefault((m, t, at.date()), (m, n, t, at, at.date()))
    assert again == 0
    assert got == sorted(want.values())
