"""Merkle manifest of a dataset: a hash tree per group of rows, and one over the groups' roots.

A node is a lowercase hex sha256; the parent of a run of three nodes (the last
run of a level may hold fewer, even one) hashes their concatenated hex text.
Rows are numbered in their group by a range partitioning and per-partition
counts, so that no task sees a whole group. Each aligned block of ``BLOCK``
leaves is one row that keeps every level as one concatenated hex string:
fixed-width substrings of a level hash its parents, and the substrings on both
sides of a node are its sibling segments. The blocks' roots are the leaves of
the next round, and the groups' roots those of the tree above, until one node
is left. On the way back each block hands its proof to its members.

Defined cases: a null field reads as ``-``, other fields as their UTF-8 byte
count, ``:`` and value, so that an empty text differs from a null one, and long
texts are hashed where they are read and never shuffled. Null groups and null
order keys come first; ties in the order key are ordered by leaf, and repeated
rows have equal leaves, so their order does not show. A lone leaf is its own
root. An empty table gives an empty manifest. Columns that are not asked for
are ignored, whatever their names. Groups of any size are split into blocks.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from perkflow.llm.common import save

RUN = 3                     # nodes of a run
HEX = 64                    # hex characters of a node
LEVELS = 6                  # levels that a block closes
BLOCK = RUN ** LEVELS
_POWERS = [RUN ** i for i in range(LEVELS)]


def field(c: Column) -> Column:
    """A value's part of a leaf: ``-`` if null, else UTF-8 byte count, ``:`` and the value."""
    data = c.cast("string").cast("binary")
    size = F.octet_length(data).cast("string").cast("binary")
    return F.coalesce(F.concat(size, F.lit(b":"), data), F.lit(b"-"))


def leaf(*columns: Column) -> Column:
    return F.sha2(F.concat(*map(field, columns)), 256)


# --- positions --------------------------------------------------------------------------------

def numbered(rows: DataFrame, order: list[str]) -> DataFrame:
    """``rows`` with ``pos``, the place in its ``grp`` by ``order``, and ``total``, the group's size.

    Rows equal in all of ``order`` are interchangeable; a running number keeps
    them from landing in one partition.
    """
    keys = ["grp", *order, "tie"]
    placed = rows.withColumn("tie", F.monotonically_increasing_id()) \
        .repartitionByRange(*[F.col(k) for k in keys]).sortWithinPartitions(*keys).drop("tie")
    placed = save(placed.withColumn("part", F.spark_partition_id())
                  .withColumn("at", F.monotonically_increasing_id()), "merkle-placed")
    spans = placed.groupBy("grp", "part").agg(F.min("at").alias("first_at"), F.count("*").alias("n"))
    group = Window.partitionBy("grp")
    before = group.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    spans = spans.select(F.col("grp").alias("span_grp"), F.col("part").alias("span_part"), "first_at",
                         F.coalesce(F.sum("n").over(before), F.lit(0)).alias("behind"),
                         F.sum("n").over(group).alias("total"))
    same = F.col("grp").eqNullSafe(F.col("span_grp")) & (F.col("part") == F.col("span_part"))
    return placed.join(spans, same).withColumn("pos", F.col("at") - F.col("first_at") + F.col("behind")) \
        .drop("part", "at", "span_grp", "span_part", "first_at", "behind")


# --- blocks -----------------------------------------------------------------------------------

def _let(value: Column, body) -> Column:
    """``body`` of a value that is computed once."""
    return F.element_at(F.transform(F.array(value), body), 1)


def _parents(level: Column) -> Column:
    runs = F.ceil(F.length(level) / (RUN * HEX)).cast("int")
    hashed = F.transform(F.sequence(F.lit(0), runs - 1),
                         lambda i: F.sha2(F.substring(level, i * (RUN * HEX) + 1, F.lit(RUN * HEX)), 256))
    return F.array_join(hashed, "").cast("binary")


def blocks(nodes: DataFrame) -> DataFrame:
    """One row per aligned block: its members in order, the levels below its root as hex strings, its root.

    The last block of a larger group closes as many levels as the others, even
    with one node left, because the group's level as a whole still has several.
    """
    block = F.floor(F.col("pos") / BLOCK).alias("block")
    packed = nodes.groupBy("grp", block).agg(
        F.first("total").alias("total"), F.sort_array(F.collect_list(F.struct("pos", "node", "kept"))).alias("members"))
    lowest = F.array_join(F.transform("members", lambda m: m["node"]), "").cast("binary")
    to_close = F.filter(F.array(*map(F.lit, _POWERS)), lambda p: p < F.col("total"))
    levels = F.aggregate(to_close, F.array(lowest),
                         lambda done, _: F.array_append(done, _let(F.element_at(done, -1), _parents)))
    packed = packed.withColumn("levels", levels)
    return packed.withColumn("root", F.element_at("levels", -1).cast("string")) \
        .withColumn("levels", F.slice("levels", 1, F.size("levels") - 1))


def _segments(levels: Column, i: Column) -> Column:
    """Sibling segments of the block's i-th member, lowest level first."""
    def of_level(level: Column, depth: Column) -> Column:
        return _let(F.floor(i / F.element_at(F.array(*map(F.lit, _POWERS)), depth + 1)).cast("int"), lambda j: F.struct(
            F.substring(level, (j - j % RUN) * HEX + 1, (j % RUN) * HEX).cast("string").alias("left"),
            F.substring(level, (j + 1) * HEX + 1, (RUN - 1 - j % RUN) * HEX).cast("string").alias("right")))

    return F.transform(levels, of_level)


def _climb(nodes: DataFrame) -> list[DataFrame]:
    """Rounds of blocks, until every group is one block."""
    rounds = []
    while True:
        rounds.append(save(blocks(nodes), "merkle-blocks"))
        largest = rounds[-1].agg(F.max("total")).first()[0] or 0
        if largest <= BLOCK:
            return rounds
        nodes = rounds[-1].select("grp", F.col("block").alias("pos"), F.ceil(F.col("total") / BLOCK).alias("total"),
                                  F.col("root").alias("node"), F.struct(F.lit(0).alias("none")).alias("kept"))


def _descend(rounds: list[DataFrame], above: DataFrame) -> DataFrame:
    """The leaves with their proofs; ``above`` has (grp, pos, path, subroot, top) of every group's single block."""
    for own in reversed(rounds):
        over = above.select(F.col("grp").alias("over_grp"), F.col("pos").alias("over_pos"), "path", "subroot", "top")
        met = own.join(over, F.col("grp").eqNullSafe(F.col("over_grp")) & (F.col("block") == F.col("over_pos")))
        member = F.transform("members", lambda m, i: F.struct(
            m["pos"].alias("pos"), m["node"].alias("node"), m["kept"].alias("kept"),
            F.concat(_segments(F.col("levels"), i), F.col("path")).alias("path")))
        above = met.select("grp", "subroot", "top", F.inline(member))
    return above


_NO_PATH = "CAST(array() AS array<struct<left:string,right:string>>)"


def manifest(rows: DataFrame, group: Column, order: Column, node: Column, *kept: Column) -> DataFrame:
    """(group, row_key, leaf, subroot, root, proof, kept): one row per row of ``rows``.

    ``node`` is a row's leaf (see ``leaf``), ``order`` its place in the group;
    ``kept`` are orderable columns to carry along as a struct. ``proof`` lists
    the siblings left and right of the row's path, from its leaf to the root.
    """
    leaves = save(rows.select(group.alias("grp"), order.alias("row_key"), node.alias("node"),
                              F.struct(F.lit(0).alias("none"), *kept).alias("kept")), "merkle-leaves")
    placed = numbered(leaves, ["row_key", "node"]) \
        .select("grp", "pos", "total", "node", F.struct("row_key", "kept").alias("kept"))
    rounds = _climb(placed)
    groups = rounds[-1].select(F.lit(0).alias("grp"), F.struct(F.col("grp").alias("of")).alias("kept"),
                               F.col("root").alias("node"))
    upper = _climb(numbered(groups.withColumn("by", F.col("kept.of")), ["by"]).drop("by"))
    start = upper[-1].select("grp", F.lit(0).cast("long").alias("pos"), F.expr(_NO_PATH).alias("path"),
                             F.lit(None).cast("string").alias("subroot"), F.col("root").alias("top"))
    tops = _descend(upper, start).select(F.col("kept.of").alias("grp"), F.lit(0).cast("long").alias("pos"), "path",
                                         F.col("node").alias("subroot"), "top")
    return _descend(rounds, tops).select(
        F.col("grp").alias("group"), F.col("kept.row_key").alias("row_key"), F.col("node").alias("leaf"), "subroot",
        F.col("top").alias("root"), F.col("path").alias("proof"), F.col("kept.kept").alias("kept"))


# --- checking a row against the root ----------------------------------------------------------

def folded(node: Column, proof: Column) -> Column:
    """The root that a leaf and its proof lead to."""
    return F.aggregate(proof, node, lambda h, s: F.sha2(F.concat(s["left"], h, s["right"]), 256))


def siblings(proof: Column) -> Column:
    """All sibling nodes of a proof as one hex string."""
    return F.array_join(F.transform(proof, lambda s: F.concat(s["left"], s["right"])), "")
