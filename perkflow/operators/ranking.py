"""Global rank without a single-partition window.

``rank().over(Window.orderBy(x))`` moves every row into one task. Here the
rank of a value is 1 + the number of rows ordered strictly before it, built
from distributed pieces:

1. histogram of distinct values (partial aggregation absorbs hot values);
2. the distinct values range-partitioned in rank order, as many partitions as
   the session shuffles into, written once so that every value keeps its place;
3. rows per partition, one number each, turned into offsets;
4. within each partition a running sum over its distinct values;
5. an equi-join of the value -> rank table back onto the rows (a value that
   very many rows share is split by adaptive skew handling).

The result equals Spark's ``rank()`` (NULLs last for descending, first for
ascending order).
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from perkflow.session import materialize


def rank_table(df: DataFrame, order_col: str, descending: bool = True,
               partitions: int | None = None, rank_col: str = "rank") -> DataFrame:
    """Distinct values of ``order_col`` with their rank. ``partitions``: of the distinct values."""
    v = F.col(order_col)
    in_order = v.desc_nulls_last() if descending else v.asc_nulls_first()
    hist = df.groupBy(order_col).agg(F.count(F.lit(1)).alias("_n"))
    ranged = hist.repartitionByRange(partitions, in_order) if partitions else hist.repartitionByRange(in_order)
    placed = materialize(ranged.withColumn("_p", F.spark_partition_id()))
    # one row per partition: a bounded table
    totals = placed.groupBy("_p").agg(F.sum("_n").alias("_pn"))
    before = Window.orderBy("_p").rowsBetween(Window.unboundedPreceding, -1)
    offsets = totals.select("_p", F.coalesce(F.sum("_pn").over(before), F.lit(0)).alias("_off"))
    within = Window.partitionBy("_p").orderBy(in_order).rowsBetween(Window.unboundedPreceding, -1)
    return (placed.withColumn("_pre", F.coalesce(F.sum("_n").over(within), F.lit(0)))
            .join(F.broadcast(offsets), "_p")
            .select(v, (F.lit(1) + F.col("_off") + F.col("_pre")).cast("long").alias(rank_col)))


def with_global_rank(df: DataFrame, order_col: str, descending: bool = True,
                     rank_col: str = "rank", partitions: int | None = None,
                     materialize_input: bool = True) -> DataFrame:
    """``df`` plus ``rank_col`` = rank() over the whole frame by ``order_col``.

    The input feeds the histogram and the final join; with
    ``materialize_input`` it is computed once and checkpointed instead of
    being recomputed by both of them.
    """
    if materialize_input:
        df = materialize(df)
    ranks = rank_table(df, order_col, descending, partitions, rank_col).withColumnRenamed(order_col, "_rv")
    return df.join(ranks, df[order_col].eqNullSafe(ranks["_rv"]), "inner").drop("_rv")
