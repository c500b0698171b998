"""Trigram index: the same names as a test of all, fewer of them tested."""

import random

import pytest
from pyspark.sql import functions as F

from perkflow.functions.text import name_matches
from perkflow.operators import name_index as N

SEARCHES = ["Member 1", "member 12", "MEMBER 3$", "^mem.*7", "ber 2+3", "ber 2?3", "colou*r", "colou+r", "a.c", "ab", "",
            "(x|Member 4)", r"Member \d5$", "[mM]ember 6", "ünd", "ÜND", "x{2}", "er*? 8", "zzzz", "Strasse", "ſan", "İst"]


@pytest.fixture(scope="module")
def indexed(spark, tmp_path_factory):
    rng = random.Random(4)
    names = [f"Member {i}" for i in range(300)] + ["Color", "colouur", "ab", "a", "", None, "Ünder", "ünder", "x\ny", "abc", "aXc",
                                                   "STRASSE", "san", "SAN", "ſan", "İstanbul", "istanbul", "a.c", "Me(mber 1", "zz"]
    names += rng.choices(names, k=100)
    df = spark.createDataFrame([(n,) for n in names], "member_name string")
    path = str(tmp_path_factory.mktemp("names"))
    N.add_names(spark, df.limit(150), path)
    N.add_names(spark, df, path, N.indexed_names(spark, path))
    return df, path


def rows(df):
    return sorted(r["member_name"] for r in df.collect())


@pytest.mark.parametrize("search", SEARCHES)
def test_same_names_as_testing_all(spark, indexed, search):
    df, path = indexed
    for literal in (False, True):
        want = rows(df.where(name_matches("member_name", search, literal)).distinct())
        assert rows(N.matching_names(spark, path, search, literal)) == want


def test_fewer_names_are_tested_and_few_buckets_read(spark, indexed):
    df, path = indexed
    total = df.where("member_name is not null").distinct().count()
    assert N.indexed_names(spark, path).count() == total
    some = N.candidates(spark, path, "member 12")
    assert some.count() == 11 < total
    plan = spark._jvm.PythonSQLUtils.explainString(some._jdf.queryExecution(), "formatted")
    assert any(ln.startswith("PartitionFilters") and "bucket" in ln for ln in plan.splitlines())
    assert N.candidates(spark, path, "zzzz").count() == 0


def test_trigrams_of_a_pattern():
    assert N.required_trigrams("Abcd") == ["abc", "bcd"]
    assert N.required_trigrams("abc?d") == N.required_trigrams("ab") == N.required_trigrams("a(bcd)") == []
    assert N.required_trigrams("abcd*xyz") == ["abc", "xyz"]
    assert N.required_trigrams("abc+xyz") == ["abc", "xyz"]
    assert N.required_trigrams("a(b", literal=True) == ["a(b"]


def test_report_equals_the_plain_one(spark, indexed, tmp_dir):
    from perkflow.operators import ledger
    from perkflow.plans.inputs import Inputs
    from tests.conftest import SF_SMALL
    fulfilled = ledger.fulfilled_offers(Inputs(spark, SF_SMALL).ledger())
    path = f"{tmp_dir}/names"
    N.add_names(spark, fulfilled, path)
    for search, literal in (("member 1", False), ("MEMBER 2", True), (None, False), ("ember (1|2)", False)):
        got = N.indexed_report(spark, fulfilled, path, "All", search, literal).collect()
        assert got == ledger.fulfilled_report(fulfilled, "All", search, literal).collect()
