"""Distributed global rank equals Spark's rank() (ties, NULLs, both directions)."""

import random
from decimal import Decimal

import pytest
from pyspark.sql import Window
from pyspark.sql import functions as F

from perkflow.operators.ranking import with_global_rank


def _frame(spark, n, seed, nulls=True):
    rnd = random.Random(seed)
    rows = []
    for i in range(n):
        v = None if (nulls and rnd.random() < 0.05) else Decimal(rnd.choice(range(0, 40))) * Decimal("12.5")
        rows.append((i, v))
    # a hot value held by a large share of rows
    rows += [(n + i, Decimal("0")) for i in range(n // 3)]
    return spark.createDataFrame(rows, "id long, v decimal(28,2)")


@pytest.mark.parametrize("descending", [True, False])
@pytest.mark.parametrize("buckets", [1, 3, 16])
def test_rank_matches_window_rank(spark, descending, buckets):
    df = _frame(spark, 400, seed=buckets)
    order = F.col("v").desc() if descending else F.col("v").asc()
    want = df.withColumn("r", F.rank().over(Window.orderBy(order)))
    got = with_global_rank(df, "v", descending, "r", buckets)
    assert sorted(map(tuple, got.select("id", "r").collect())) == \
        sorted(map(tuple, want.select("id", "r").collect()))


def test_rank_of_empty_frame(spark):
    df = spark.createDataFrame([], "id long, v decimal(28,2)")
    assert with_global_rank(df, "v", True, "r", 4).count() == 0
