"""Every registered query against its DuckDB twin, on the whole sf0.001 folder."""

import pytest

import __spark_entry__ as entry
from perkflow.plans import kept_registry, live_registry, oracle, streams_registry
from perkflow.plans.registry import REGISTRY
from tests.conftest import SF_SMALL
from tests.oracle_check import compare, duck

QUERIES = REGISTRY
ORACLE = oracle.ORACLE_SQL | streams_registry.STREAM_ORACLE | live_registry.LIVE_ORACLE | kept_registry.KEPT_ORACLE


@pytest.fixture(scope="module")
def con():
    return duck(SF_SMALL)


def test_every_query_has_an_oracle():
    assert set(QUERIES) == set(ORACLE)
    assert set(QUERIES) <= set(entry.queries()) and set(ORACLE) <= set(entry.oracle_sql())


def test_typed_columns_keep_their_types(spark, con):
    """Decimals and dates reach the comparison as such, on both sides."""
    got = QUERIES["summary_typed"](spark, SF_SMALL)
    want = con.sql(ORACLE["summary_typed"])
    kinds = dict(zip(want.columns, map(str, want.types)))
    assert {c: t.upper() for c, t in got.dtypes if c.endswith(("spend", "amount", "date"))} == \
        {c: t for c, t in kinds.items() if c.endswith(("spend", "amount", "date"))}


@pytest.mark.parametrize("name", sorted(ORACLE))
def test_query_matches_oracle(spark, con, name):
    got = QUERIES[name](spark, SF_SMALL).toPandas()
    want = con.sql(ORACLE[name]).df()
    problem = compare(got, want)
    assert problem is None, f"{name}: {problem}"


def test_entry_smoke(spark):
    df = entry.entry(spark)
    rows = df.collect()
    assert len(rows) == 26  # 12 hotel + 14 drink pending at sf0.001 (5-minute windows)
    assert df.columns == ["member_id", "member_name", "offer_type", "offer_display", "metric_value",
                          "metric_label", "window_start", "window_end"]
