"""Name search over the fulfilled report by a trigram index.

The index is a table of (trigram, member_name), one row for each trigram of each
distinct name, partitioned by a bucket of the trigram. A search derives the
trigrams that every matching name must hold, reads only their buckets, and puts
the names that hold all of them to the exact test of ``name_matches``; the
report is then joined to the names that pass. Upper and lower case of A-Z is
one, as in the search itself.

A pattern that prescribes no three characters in a row (a short one, or one
with groups, classes, alternatives or escapes) has no trigrams to look for:
all distinct names are tested.

Defined cases: a null name matches nothing and is not indexed; names shorter
than three characters are indexed under a trigram of their own, the empty one,
with all other names, so that a search without trigrams finds every name; names
that come twice are indexed once, in whatever run; an empty index matches
nothing.
"""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from perkflow.functions.text import name_matches
from perkflow.operators.ledger import filter_fulfilled, fulfilled_report

BUCKETS = 64
_ALL = ""
_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
_FOLD = str.maketrans(_UPPER, _LOWER)


def _bucket(trigram: Column) -> Column:
    return F.pmod(F.xxhash64(trigram), F.lit(BUCKETS)).cast("int")


def index_rows(names: DataFrame, name: str = "member_name") -> DataFrame:
    """(trigram, member_name, bucket) of the distinct names."""
    folded = F.translate(F.col("member_name"), _UPPER, _LOWER)
    n = F.char_length(folded)
    some = F.when(n >= 3, F.transform(F.sequence(F.lit(1), n - 2), lambda i: F.substring(folded, i, F.lit(3)))) \
        .otherwise(F.array().cast("array<string>"))
    rows = names.where(F.col(name).isNotNull()).select(F.col(name).alias("member_name")).distinct() \
        .select(F.explode(F.array_union(F.array(F.lit(_ALL)), some)).alias("trigram"), "member_name")
    return rows.withColumn("bucket", _bucket(F.col("trigram")))


def add_names(spark: SparkSession, names: DataFrame, path: str, known: DataFrame | None = None) -> None:
    """Append the names that the index does not hold; ``known`` has those it does (``indexed_names``)."""
    fresh = names.select("member_name").distinct()
    if known is not None:
        fresh = fresh.join(known, "member_name", "left_anti")
    index_rows(fresh).hint("rebalance", "bucket").write.mode("append").partitionBy("bucket").parquet(path)


def indexed_names(spark: SparkSession, path: str) -> DataFrame:
    return _held(spark, path).where((F.col("bucket") == _bucket(F.lit(_ALL))) & (F.col("trigram") == _ALL)) \
        .select("member_name").distinct()


def _held(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema("trigram string, member_name string, bucket int").parquet(path)


def required_trigrams(pattern: str, literal: bool = False) -> list[str]:
    """Trigrams that every name matching the search holds, case folded; none if that cannot be told."""
    if literal:
        runs = [pattern]
    elif re.search(r"[|()\[\]{}\\]", pattern):
        return []
    else:
        # a character before ? or * may be missing; one before + is there at least once
        parts = re.sub(r"[^.^$+*?][?*][?+]?", ".", pattern)
        runs = re.split(r"[.^$+*?]+", parts)
    return sorted({run[i:i + 3].translate(_FOLD) for run in runs for i in range(len(run) - 2)})


def candidates(spark: SparkSession, path: str, pattern: str, literal: bool = False) -> DataFrame:
    """(member_name): distinct indexed names that hold all trigrams of the search."""
    wanted = required_trigrams(pattern, literal)
    if not wanted:
        return indexed_names(spark, path)
    rows = spark.range(1).select(*[_bucket(F.lit(t)).alias(f"b{i}") for i, t in enumerate(wanted)]).first()
    held = _held(spark, path).where(F.col("bucket").isin(sorted(set(rows))) & F.col("trigram").isin(wanted))
    return held.groupBy("member_name").agg(F.count_distinct("trigram").alias("n")) \
        .where(F.col("n") == len(wanted)).select("member_name")


def matching_names(spark: SparkSession, path: str, pattern: str, literal: bool = False) -> DataFrame:
    return candidates(spark, path, pattern, literal).where(name_matches("member_name", pattern, literal))


def indexed_report(spark: SparkSession, fulfilled: DataFrame, path: str, offer_filter: str = "All",
                   member_search: str | None = None, literal: bool = False) -> DataFrame:
    """``ledger.fulfilled_report`` with the name search answered from the index (which holds every name of the ledger)."""
    if not member_search:
        return fulfilled_report(fulfilled, offer_filter)
    names = matching_names(spark, path, member_search, literal)
    return fulfilled_report(filter_fulfilled(fulfilled, offer_filter).join(names, "member_name", "left_semi"))
