"""MinHash near-duplicates: banding, signature verification, exact confirmation, star contraction.

A text's set holds its distinct word shingles; texts with equal sets are one
*node*. Every node gets the minima of many universal hash functions, in bands.
Nodes that agree on a band share a bucket. Candidates come from the buckets in
two passes, neither of which pairs up a bucket's members:

1. *Stars.* Each member is paired with one centre of its bucket. Buckets take
   their centre by one of a few random orders, so that a large group of near
   copies is tried against several centres. Pairs whose signatures are
   similar enough are confirmed on the full sets; confirmed links are
   contracted to components.
2. *The rest, exactly.* Buckets whose members are still in several components
   are compared across components, block by block with numpy: signatures first,
   then the full sets of the nodes that still matter. A block hands on only the
   links that join components.

So every bucket pair is either in one component or has been compared. Two texts
of similarity 0.8 miss all 32 bands of 5 with probability 3e-6. Components are
found by alternating large-star and small-star steps on tables in the shared
checkpoint folder; nothing per document reaches the driver.

Defined cases: a text with fewer words than a shingle has its whole sequence as
its one shingle; without words (or null) the set is empty and linked with
nothing; repeated ids and rows are rows of their own, judged by their text; a
component's id is its smallest non-null document id; extra columns of any name
are ignored or, when dropping duplicates, pass through.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from perkflow.llm.common import key_filter, save, utf8
from perkflow.llm.repetition import _mixed


@dataclass(frozen=True)
class NearDup:
    """``deviations``: how far below the limit a signature may estimate a pair that is still confirmed.

    ``orders``: random orders by which buckets choose their centre. ``block``
    and ``block_shingles``: nodes, and shingles of their sets, in a block.
    """
    shingle: int = 5
    percent: int = 80
    bands: int = 32
    rows: int = 5
    orders: int = 4
    block: int = 512
    block_shingles: int = 2_000_000
    deviations: float = 5.0

    @property
    def minima(self) -> int:
        return self.bands * self.rows

    @property
    def least_equal(self) -> int:
        """Equal minima that a pair needs to be confirmed on its sets."""
        share = self.percent / 100
        return int(self.minima * share - self.deviations * (self.minima * share * (1 - share)) ** 0.5)


# --- sets and signatures ----------------------------------------------------------------------

_ODD = (np.random.default_rng(20).integers(0, 2 ** 63, 64, dtype=np.uint64) << np.uint64(1)) | np.uint64(1)


def shingle_set(text: bytes, k: int) -> np.ndarray:
    """Sorted distinct 64-bit hashes of the text's k-word shingles; A-Z count as a-z."""
    words = text.lower().split()
    if not words:
        return np.zeros(0, np.uint64)
    h = np.fromiter(map(xxhash.xxh3_64_intdigest, words), np.uint64, len(words))
    m = min(k, len(words))
    total = h[:len(h) - m + 1] * _ODD[0]
    for i in range(1, m):
        total = total + h[i:len(h) - m + 1 + i] * _ODD[i % 64]
    if m < k:  # the whole sequence, told apart from a shingle of k words
        total = total + np.uint64(k - m) * _ODD[63]
    return np.unique(_mixed(total))


class Signer:
    """Minima of universal (multiply-add-shift) hash functions, and their band keys."""

    CHUNK = 512

    def __init__(self, how: NearDup):
        rng = np.random.default_rng(8)
        self.a = (rng.integers(0, 2 ** 63, how.minima, dtype=np.uint64) << np.uint64(1) | np.uint64(1))[None, :]
        self.b = rng.integers(0, 2 ** 63, how.minima, dtype=np.uint64)[None, :]
        self.how = how
        self.mix = _ODD[1:1 + how.rows][None, :]
        self.band = (np.arange(how.bands, dtype=np.uint64) + np.uint64(1)) * _ODD[40]
        self.room = np.empty((self.CHUNK, how.minima), np.uint64)

    def minima(self, shingles: np.ndarray) -> np.ndarray:
        least = np.full(self.how.minima, np.iinfo(np.uint64).max, np.uint64)
        for i in range(0, len(shingles), self.CHUNK):
            part = shingles[i:i + self.CHUNK, None]
            out = self.room[:len(part)]
            np.multiply(part, self.a, out=out)
            out += self.b
            np.minimum(least, out.min(axis=0), out=least)
        return least >> np.uint64(32)

    def keys(self, minima: np.ndarray) -> np.ndarray:
        joined = (minima.reshape(self.how.bands, self.how.rows) * self.mix).sum(axis=1, dtype=np.uint64) + self.band
        return _mixed(joined).view(np.int64)


_SKETCH = "struct<n: bigint, node: binary, minima: binary, keys: array<bigint>>"


def sketch_column(text: str | Column, how: NearDup) -> Column:
    """Set size, 128-bit digest of the set (null when empty), the minima's low 16 bits, the band keys."""
    @F.arrow_udf(_SKETCH)
    def sketch(texts: pa.Array) -> pa.Array:
        signer = Signer(how)
        n, node, minima, keys = [], [], [], []
        for t in texts:
            s = shingle_set(t.as_py(), how.shingle)
            n.append(len(s))
            if not len(s):
                node.append(None)
                minima.append(None)
                keys.append(None)
                continue
            m = signer.minima(s)
            node.append(xxhash.xxh3_128_digest(s.tobytes()))
            minima.append(m.astype("<u2").tobytes())
            keys.append(signer.keys(m))
        return pa.StructArray.from_arrays(
            [pa.array(n, pa.int64()), pa.array(node, pa.binary()), pa.array(minima, pa.binary()),
             pa.array(keys, pa.list_(pa.int64()))], ["n", "node", "minima", "keys"])

    return sketch(utf8(text))


def full_sets(texts: DataFrame, how: NearDup) -> DataFrame:
    """(node, shingles) of the rows of (wanted, text) whose set has the digest ``wanted``.

    A map over the joined rows, so that Spark does not evaluate the sets of all
    texts as a join key beforehand.
    """
    def of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            node, sets = [], []
            for wanted, text in zip(batch.column("wanted"), batch.column("text")):
                s = shingle_set(text.as_py(), how.shingle).tobytes()
                if xxhash.xxh3_128_digest(s) == wanted.as_py():
                    node.append(wanted.as_py())
                    sets.append(s)
            yield pa.RecordBatch.from_arrays([pa.array(node, pa.binary()), pa.array(sets, pa.binary())],
                                             ["node", "shingles"])

    return texts.mapInArrow(of, "node binary, shingles binary")


@F.arrow_udf(T.IntegerType())
def equal_minima(a: pa.Array, b: pa.Array) -> pa.Array:
    """How many minima two signatures share."""
    if not len(a):
        return pa.array([], pa.int32())
    x = np.frombuffer(b"".join(a.to_pylist()), "<u2").reshape(len(a), -1)
    y = np.frombuffer(b"".join(b.to_pylist()), "<u2").reshape(len(a), -1)
    return pa.array((x == y).sum(axis=1), pa.int32())


@F.arrow_udf(T.LongType())
def shared_shingles(a: pa.Array, b: pa.Array) -> pa.Array:
    """Size of the intersection of two full sets."""
    return pa.array([intersection(np.frombuffer(x.as_buffer(), "<u8"), np.frombuffer(y.as_buffer(), "<u8"))
                     for x, y in zip(a, b)], pa.int64())


def intersection(x: np.ndarray, y: np.ndarray) -> int:
    """Of two sorted arrays without repeats."""
    if len(x) > len(y):
        x, y = y, x
    at = np.searchsorted(y, x)
    at[at == len(y)] = 0
    return int(np.count_nonzero(y[at] == x))


# --- candidates and links ---------------------------------------------------------------------

def _ordered(x: Column, y: Column) -> list[Column]:
    return [F.least(x, y).alias("a"), F.greatest(x, y).alias("b")]


def _similar_size(how: NearDup) -> Column:
    """No pair of more different sizes can reach the limit."""
    return 100 * F.least("n_a", "n_b") >= how.percent * F.greatest("n_a", "n_b")


def _with_both(pairs: DataFrame, nodes: DataFrame, value: str) -> DataFrame:
    """``pairs`` (a, b) with a value of either node; a node of many pairs is split by adaptive execution."""
    out = pairs
    for side in ("a", "b"):
        out = out.join(nodes.select(F.col("node").alias(side), F.col(value).alias(f"{value}_{side}"),
                                    *([F.col("n").alias(f"n_{side}")] if "n" in nodes.columns else [])), side)
    return out


def star_pairs(buckets: DataFrame, how: NearDup) -> DataFrame:
    """Each member of a bucket with the bucket's centre, distinct."""
    order = F.pmod(F.col("key"), F.lit(how.orders))
    ranked = F.struct(F.xxhash64(order, "node").alias("at"), F.col("node").alias("node"))
    centres = buckets.groupBy("key").agg(F.min(ranked)["node"].alias("centre"))
    return buckets.join(centres, "key").where(F.col("centre") != F.col("node")) \
        .select(*_ordered(F.col("centre"), F.col("node"))).distinct()


def accepted(pairs: DataFrame, reps: DataFrame, how: NearDup) -> DataFrame:
    """The pairs that sizes and signatures accept."""
    both = _with_both(pairs, reps.select("node", "minima", "n"), "minima").where(_similar_size(how))
    return both.where(equal_minima("minima_a", "minima_b") >= how.least_equal).select("a", "b")


def confirmed(pairs: DataFrame, sets: DataFrame, how: NearDup) -> DataFrame:
    """The pairs whose full sets reach the limit."""
    both = _with_both(pairs, sets, "shingles")
    n = (F.octet_length("shingles_a") + F.octet_length("shingles_b")) / 8
    shared = shared_shingles("shingles_a", "shingles_b")
    return both.select("a", "b", shared.alias("shared"), n.cast("long").alias("n")) \
        .where(100 * F.col("shared") >= how.percent * (F.col("n") - F.col("shared"))).select("a", "b")


class _Cell:
    """Rows of one cell as arrays: two blocks of a bucket's nodes, or one block against itself."""

    def __init__(self, rows: pa.Table, how: NearDup):
        self.how, self.rows = how, rows
        self.n = rows["n"].to_numpy()
        roots: dict[bytes, int] = {}
        self.part = np.array([roots.setdefault(r, len(roots)) for r in rows["root"].to_pylist()])
        self.parts = len(roots)
        self.minima = np.frombuffer(b"".join(rows["minima"].to_pylist()), "<u2").reshape(len(rows), -1)
        self.keys = np.array(rows["keys"].combine_chunks().flatten()).reshape(len(rows), -1)
        self.band = int(np.flatnonzero(self.keys[0] == rows["key"][0].as_py())[0])
        self.block = rows["block"].to_numpy()
        self.across = rows["row_block"][0].as_py() != rows["column_block"][0].as_py()

    def accepted(self, i: int) -> np.ndarray:
        """Later rows that sizes and signatures accept with row i, are of another component, and share no earlier band."""
        j = slice(i + 1, None)
        percent = self.how.percent
        other = (self.part[j] != self.part[i]) \
            & (100 * np.minimum(self.n[j], self.n[i]) >= percent * np.maximum(self.n[j], self.n[i]))
        if self.across:
            other &= self.block[j] != self.block[i]
        at = np.flatnonzero(other) + i + 1
        if len(at):
            at = at[(self.minima[at] == self.minima[i]).sum(axis=1) >= self.how.least_equal]
        if len(at):
            at = at[(self.keys[at] == self.keys[i]).argmax(axis=1) == self.band]
        return at


_CELL = ["key", "row_block", "column_block"]


def _by_cell(handle):
    """A function of batches sorted by cell that gives every whole cell of two rows or more to ``handle``."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: pa.Table | None = None
        for batch in batches:
            now = pa.Table.from_batches([batch])
            held = now if held is None else pa.concat_tables([held, now])
            change = np.zeros(max(0, len(held) - 1), bool)
            for name in _CELL:
                v = held[name].to_numpy()
                change |= v[1:] != v[:-1]
            edges = [0, *(np.flatnonzero(change) + 1).tolist()]
            for start, end in zip(edges, edges[1:]):
                if end - start > 1:
                    yield from handle(held.slice(start, end - start))
            held = held.slice(edges[-1])
        if held is not None and len(held) > 1:
            yield from handle(held)
    return run


def cross_links(buckets: DataFrame, reps: DataFrame, sets: DataFrame, how: NearDup) -> DataFrame:
    """Confirmed links that join components sharing a bucket. ``buckets``: key, node, n, root.

    A bucket with several components is cut into blocks and every two blocks
    meet in a cell. First the signatures alone tell which nodes of a cell have
    a pair to confirm; then these nodes meet in the cell again with their full
    sets. A pair is looked at in the first band it shares. A cell hands on only
    links that join components not yet joined in it, at most one fewer than it
    has components, so no list of pairs is ever made.
    """
    mixed = buckets.groupBy("key").agg(F.min("root").alias("x"), F.max("root").alias("y"),
                                       F.count("*").alias("size"), F.sum("n").alias("shingles")) \
        .where(F.col("x") != F.col("y")).select("key", F.greatest(
            F.ceil(F.col("size") / how.block), F.ceil(F.col("shingles") / how.block_shingles)).cast("int").alias("blocks"))
    rows = buckets.join(mixed, "key").withColumn("block", F.pmod(F.xxhash64("node"), F.col("blocks")).cast("int")) \
        .withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
    cells = rows.select("key", F.least("block", "other").alias("row_block"),
                        F.greatest("block", "other").alias("column_block"), "block", "node", "root", "n") \
        .join(reps.select("node", "minima", "keys"), "node")

    def to_confirm(rows: pa.Table) -> Iterator[pa.RecordBatch]:
        cell = _Cell(rows, how)
        wanted = np.zeros(len(rows), bool)
        if cell.parts > 1:
            for i in range(len(rows) - 1):
                at = cell.accepted(i)
                wanted[at] = True
                wanted[i] |= len(at) > 0
        if wanted.any():
            yield from rows.take(np.flatnonzero(wanted)).combine_chunks().to_batches()

    def confirm(rows: pa.Table) -> Iterator[pa.RecordBatch]:
        cell = _Cell(rows, how)
        joined = list(range(cell.parts))

        def top(k: int) -> int:
            while joined[k] != k:
                joined[k] = k = joined[joined[k]]
            return k

        shingles = [np.frombuffer(s.as_buffer(), "<u8") for s in rows["shingles"]]
        node = rows["node"].to_pylist()
        a, b = [], []
        for i in range(len(rows) - 1):
            for j in cell.accepted(i).tolist():
                x, y = top(cell.part[i]), top(cell.part[j])
                if x != y and reaches(shingles[i], shingles[j], how.percent):
                    joined[y] = x
                    a.append(node[i])
                    b.append(node[j])
        if a:
            yield pa.RecordBatch.from_arrays([pa.array(a, pa.binary()), pa.array(b, pa.binary())], ["a", "b"])

    def dealt(cells: DataFrame) -> DataFrame:
        return cells.repartition(*_CELL).sortWithinPartitions(*_CELL)

    cells = dealt(cells)
    left = save(cells.mapInArrow(_by_cell(to_confirm), cells.schema), "cells")
    whole = dealt(left.join(sets, "node").select(*left.columns, "shingles"))
    return whole.mapInArrow(_by_cell(confirm), "a binary, b binary")


def reaches(x: np.ndarray, y: np.ndarray, percent: int) -> bool:
    """Whether two full sets reach the limit."""
    shared = intersection(x, y)
    return 100 * shared >= percent * (len(x) + len(y) - shared)


# --- components -------------------------------------------------------------------------------

def _state(edges: DataFrame) -> tuple:
    row = edges.agg(F.count("*"), F.bit_xor(F.xxhash64("u", "v"))).first()
    return row[0], row[1]


def components(links: DataFrame) -> DataFrame:
    """(node, root) of every node that is not its component's smallest, by alternating star steps.

    Large-star links every greater neighbour of a node to the node's smallest
    neighbour, small-star every smaller one and the node itself. Minima are
    aggregated before the shuffle, so a node of many links costs one row per
    task. Ends when a round changes nothing: then all links are stars.
    """
    edges = save(links.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v"))
                 .where(F.col("u") != F.col("v")).distinct(), "links")
    state = _state(edges)
    while True:
        both = edges.union(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m"))
        large = both.join(least, "u").where(F.col("v") > F.col("u")).select(F.col("v").alias("u"), F.col("m").alias("v")) \
            .where(F.col("u") != F.col("v")).distinct()
        large = save(large, "large-star")
        least = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(least, "u").where(F.col("v") != F.col("m")).select(F.col("v").alias("u"), F.col("m").alias("v")) \
            .union(least.select("u", F.col("m").alias("v"))).distinct()
        edges = save(small, "small-star")
        before, state = state, _state(edges)
        if state == before:
            return edges.select(F.col("u").alias("node"), F.col("v").alias("root"))


# --- the operator -----------------------------------------------------------------------------

def _classes(docs: DataFrame, doc_id: str, text: str, how: NearDup) -> tuple[DataFrame, DataFrame]:
    """(sketches of all rows, (node, component_id, root, copies) of all nodes)."""
    own = docs.select(F.col(doc_id).alias("doc_id"), F.col(text).alias("text"))
    s = sketch_column("text", how)
    sketches = save(own.select("doc_id", F.xxhash64("text").alias("text_hash"), s.alias("s"))
                    .select("doc_id", "text_hash", "s.*"), "sketches")
    # copies meet before the shuffle: one row per task and node
    reps = save(sketches.where(F.col("node").isNotNull()).groupBy("node").agg(
        F.min("doc_id").alias("doc_id"), F.count("*").alias("copies"), F.first("n").alias("n"),
        F.first("minima").alias("minima"), F.first("keys").alias("keys")), "nodes")

    postings = reps.select("node", "n", F.explode("keys").alias("key"))
    shared = postings.groupBy("key").agg(F.count("*").alias("size")).where("size > 1").select("key")
    buckets = save(postings.join(shared, "key"), "buckets")
    wanted = reps.join(buckets.select("node").distinct(), "node", "left_semi")
    near = save(wanted.select("node", "doc_id", "n", "minima", "keys"), "bucket-nodes")

    ids = near.select(F.col("doc_id").alias("id"), F.col("node").alias("wanted"))
    wanted_ids = key_filter(ids, "id")
    texts = own.where(wanted_ids(F.col("doc_id"))).join(ids, F.col("doc_id").eqNullSafe(F.col("id"))) \
        .select("wanted", utf8("text").alias("text"))
    sets = save(full_sets(texts, how).groupBy("node").agg(F.first("shingles").alias("shingles")), "sets")

    stars = accepted(star_pairs(buckets, how), near, how)
    first = components(confirmed(stars, sets, how))
    rooted = buckets.join(first, "node", "left").select(
        "key", "node", "n", F.coalesce("root", "node").alias("root"))
    cross = cross_links(rooted, near, sets, how)
    root_of = first.select(F.col("node"), F.col("root"))
    roots = cross
    for side in ("a", "b"):
        roots = roots.join(root_of.select(F.col("node").alias(side), F.col("root").alias(f"root_{side}")), side, "left")
    second = components(roots.select(F.coalesce("root_a", "a").alias("a"), F.coalesce("root_b", "b").alias("b")))

    final = near.select("node", "doc_id").join(first, "node", "left") \
        .select("node", "doc_id", F.coalesce("root", "node").alias("middle")) \
        .join(second.select(F.col("node").alias("middle"), F.col("root").alias("top")), "middle", "left") \
        .select("node", "doc_id", F.coalesce("top", "middle").alias("root"))
    least = final.groupBy("root").agg(F.min("doc_id").alias("component_id"))
    linked = final.join(least, "root").select("node", "root", "component_id")
    classes = reps.select("node", "doc_id", "copies").join(linked, "node", "left").select(
        "node", F.when(F.col("root").isNull(), F.col("doc_id")).otherwise(F.col("component_id")).alias("component_id"),
        F.coalesce("root", "node").alias("root"), "copies")
    return sketches, classes


#: A text that holds more than this share of the rows is looked up by broadcast; there are fewer than 1024 such.
_HOT_SHARE = 1024


def near_duplicates(docs: DataFrame, doc_id: str = "doc_id", text: str = "text",
                    how: NearDup = NearDup()) -> DataFrame:
    """Per row: ``doc_id, n_shingles, component_id`` (and ``text_hash``, and ``root``, which names the component)."""
    sketches, classes = _classes(docs, doc_id, text, how)
    classes = save(classes, "classes")
    total = classes.agg(F.sum("copies")).first()[0] or 0
    out = ["doc_id", "n_shingles", "component_id", "text_hash", "root"]
    with_words = sketches.where(F.col("node").isNotNull()) \
        .select("doc_id", F.col("n").alias("n_shingles"), "text_hash", "node")
    # the copies of a very common text stay where they are, the other rows meet their text's class in a shuffle
    hot = F.broadcast(classes.where(F.col("copies") * _HOT_SHARE > total).select("node", "component_id", "root"))
    common = with_words.join(hot, "node").select(*out)
    others = with_words.join(hot.select("node"), "node", "left_anti") \
        .join(classes.select("node", "component_id", "root"), "node").select(*out)
    without = sketches.where(F.col("node").isNull()).select(
        "doc_id", F.col("n").alias("n_shingles"), F.col("doc_id").alias("component_id"), "text_hash",
        F.lit(None).cast(classes.schema["root"].dataType).alias("root"))
    return common.unionByName(others).unionByName(without)


def without_near_duplicates(docs: DataFrame, doc_id: str = "doc_id", text: str = "text",
                            how: NearDup = NearDup()) -> DataFrame:
    """``docs`` with one row of every component: that of its smallest id. Texts without words all stay.

    A row is found again by its id and a hash of its text, so that other texts
    under a repeated id are not taken for it; rows that agree in both are kept
    once. Of several texts under the smallest id, that of the smallest hash stays.
    """
    judged = save(near_duplicates(docs, doc_id, text, how), "near-duplicates")
    same = ["doc_id", "text_hash"]
    first = judged.where((F.col("n_shingles") > 0) & F.col("doc_id").eqNullSafe(F.col("component_id")))
    several_texts = first.groupBy("root").agg(F.min("text_hash").alias("least"), F.max("text_hash").alias("most")) \
        .where("least < most").select("root", "least")
    gone = judged.where(~F.col("doc_id").eqNullSafe(F.col("component_id"))).select(*same).unionByName(
        first.join(several_texts, "root").where(F.col("text_hash") > F.col("least")).select(*same)).distinct()
    again = judged.where((F.col("n_shingles") > 0) & F.col("doc_id").eqNullSafe(F.col("component_id"))) \
        .groupBy(*same).count().where("count > 1").select(*same)

    # only rows that may be among these are dealt out and joined; the others, most of them, stay where they are
    some = save(gone.select(*same, F.lit(True).alias("gone")).unionByName(again.select(*same, F.lit(False).alias("gone"))),
                "doubles")
    may_match = key_filter(some, "doc_id")(F.col(doc_id))
    untouched = docs.where(~may_match)
    looked_at = docs.where(may_match)
    gone, again = some.where("gone"), some.where("NOT gone")

    def is_row(of: DataFrame) -> Column:
        return looked_at[doc_id].eqNullSafe(of["doc_id"]) & (F.xxhash64(looked_at[text]) == of["text_hash"])

    kept = looked_at.join(gone, is_row(gone), "left_anti")
    once = kept.join(again, is_row(again), "left_anti")
    several = kept.join(again, is_row(again), "left_semi")
    return untouched.unionByName(once).unionByName(several.dropDuplicates([doc_id, text]))
