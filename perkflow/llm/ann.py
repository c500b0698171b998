"""Approximate nearest neighbours by largest inner product, over balanced posting lists.

Largest inner product becomes smallest distance by one more coordinate that
brings all vectors to the same length. The centroids come from balanced
bisection of a bounded sample, refined by a few rounds of k-means, and are held
in memory as a neighbour graph. Every vector is indexed: it goes to the list of
its nearest centroid and, near a boundary, to further lists whose centroids are
at most ``boundary`` times as far, up to ``replicas``. A query walks the graph
best-first and searches all lists whose centroids are at most ``reach`` times as
far as the nearest one, and at least so many that there are enough candidates.

A query's lists are searched in rounds, nearest first: after a round, the k-th
best found so far bounds what the further lists need to hand on, so that these
hand on little, however many they are. Lists are dealt in blocks of bounded size
against blocks of the queries that search them, so neither a popular list nor a
popular query meets in one task. Each block finds its best pairs by a matrix
product and scores them again in double precision, component after component;
the blocks' best are merged.

Defined cases: vectors that are null, empty, zero, hold a null or a non-finite
component, or differ from the table's most common length take no part, as do
rows without id; a repeated id stands for its smallest vector; ties go to the
smaller id; extra columns are ignored.
"""

from __future__ import annotations

from dataclasses import dataclass
from heapq import heappop, heappush

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from perkflow.llm.common import save


@dataclass(frozen=True)
class Ann:
    """``sample_rows`` bounds what the centroids are fitted on, ``max_lists`` what is held in memory."""
    k: int = 20
    list_rows: int = 512
    max_lists: int = 8192
    sample_rows: int = 65_536
    rounds: int = 3
    degree: int = 16
    replicas: int = 4
    boundary: float = 1.12
    reach: float = 1.19         # set by recall, see the README
    least_lists: int = 8
    walk: int = 24              # steps that a walk on the graph takes at least
    first_lists: int = 8        # searched in the first round
    widen: int = 16             # a round reaches so many times as many lists as the one before
    block_rows: int = 2048
    block_queries: int = 4096
    seed: int = 7


# --- centroids and their graph ----------------------------------------------------------------

def balanced_cells(x: np.ndarray, n: int) -> np.ndarray:
    """Means of ``n`` cells of equal size, by repeated bisection along the line between two halves."""
    out, todo = [], [(np.arange(len(x)), n)]
    while todo:
        rows, parts = todo.pop()
        if parts == 1 or len(rows) < 2:
            out.append(x[rows].mean(axis=0))
            continue
        part = x[rows]
        middle = part.mean(axis=0)
        a = part[((part - middle) ** 2).sum(axis=1).argmax()]
        b = part[((part - a) ** 2).sum(axis=1).argmax()]
        cut = max(1, len(rows) * (parts // 2) // parts)
        for _ in range(4):
            order = np.argsort(part @ (b - a), kind="stable")
            a, b = part[order[:cut]].mean(axis=0), part[order[cut:]].mean(axis=0)
        todo += [(rows[order[cut:]], parts - parts // 2), (rows[order[:cut]], parts // 2)]
    return np.unique(np.stack(out), axis=0)


def nearest(x: np.ndarray, centroids: np.ndarray, rows: int = 2048) -> np.ndarray:
    half = (centroids ** 2).sum(axis=1) / 2
    return np.concatenate([(x[i:i + rows] @ centroids.T - half).argmax(axis=1) for i in range(0, len(x), rows)])


@dataclass(frozen=True)
class Centroids:
    """Centroids, their neighbour lists, and the entries from which a walk may start.

    ``spread``: mean squared distance of a centroid's sample vectors to it.
    """
    points: np.ndarray
    links: list[np.ndarray]
    entries: np.ndarray
    walk: int
    spread: np.ndarray

    @staticmethod
    def fit(x: np.ndarray, n: int, how: Ann) -> Centroids:
        points = balanced_cells(x, n)
        for _ in range(how.rounds):
            own = nearest(x, points)
            count = np.bincount(own, minlength=len(points))
            total = np.zeros_like(points)
            np.add.at(total, own, x)
            used = count > 0
            points[used] = total[used] / count[used, None]
        points = np.unique(points, axis=0)
        m = len(points)
        links: list[set[int]] = [{i - 1, (i + 1) % m} - {i, -1} for i in range(m)]  # keeps the graph connected
        half = (points ** 2).sum(axis=1) / 2
        for i in range(0, m, 512):
            near = half - points[i:i + 512] @ points.T
            for j, row in enumerate(np.argpartition(near, min(how.degree, m - 1), axis=1)[:, :how.degree + 1]):
                for other in row.tolist():
                    if other != i + j:
                        links[i + j].add(other)
                        links[other].add(i + j)
        entries = np.random.default_rng(how.seed).permutation(m)[:int(m ** 0.5) + 1]
        own = nearest(x, points)
        spread = np.bincount(own, ((x - points[own]) ** 2).sum(axis=1), m) / np.maximum(np.bincount(own, minlength=m), 1)
        return Centroids(points, [np.array(sorted(s), np.int64) for s in links], entries, how.walk, spread)

    def within(self, v: np.ndarray, ratio: float, least: int, sizes: np.ndarray | None = None,
               enough: int = 0, most: int | None = None) -> tuple[np.ndarray, np.ndarray]:
        """Centroids by distance: those at most ``ratio`` times as far as the nearest, and at least ``least``.

        Who needs no more than the ``most`` nearest ones says so, which ends
        the walk earlier.

        With ``sizes`` of the lists, the nearest ones count as one until they
        hold ``enough`` rows together: a list of a few outliers says nothing
        about how far the neighbours are. Lists whose members are, by their
        spread, as near on average as the nearest centroid's are added: a tight
        group's centroid lies further out than that of a wide one.
        """
        points, links = self.points, self.links
        seen = np.zeros(len(points), bool)
        heap: list[tuple[float, int]] = []
        distance: dict[int, float] = {}

        def look(nodes: np.ndarray) -> None:
            seen[nodes] = True
            for d, i in zip(np.sqrt(((points[nodes] - v) ** 2).sum(axis=1)).tolist(), nodes.tolist()):
                distance[i] = d
                heappush(heap, (d, i))

        look(self.entries)
        base, done, rows = np.inf, 0, 0
        while heap:
            d, i = heappop(heap)
            if done >= max(least, self.walk) and (d > ratio * base or most is not None and done >= most):
                break
            done += 1
            if sizes is not None:
                rows += int(sizes[i])
            if rows >= enough:
                base = min(base, d)
            fresh = links[i][~seen[links[i]]]
            if len(fresh):
                look(fresh)
        ids = np.fromiter(distance, np.int64, len(distance))
        far = np.fromiter(distance.values(), np.float64, len(distance))
        order = np.lexsort((ids, far))
        ids, far = ids[order], far[order]
        first = 0 if sizes is None else min(int(np.searchsorted(np.cumsum(sizes[ids]), enough)), len(ids) - 1)
        n = max(least, int(np.searchsorted(far, ratio * far[first], "right")))
        taken = np.arange(len(ids)) < n
        if sizes is not None:
            members = far ** 2 + self.spread[ids]
            taken |= members <= members[first]
        return ids[taken], far[taken]


# --- vectors ----------------------------------------------------------------------------------

def usable(vectors: DataFrame, vec_id: str, embedding: str) -> DataFrame:
    """(vec_id, v): one row per id, finite nonzero vectors of the most common length."""
    x = F.col(embedding)
    infinite = F.lit(float("inf"))
    finite = F.forall(x, lambda c: c.isNotNull() & ~F.isnan(c) & (F.abs(c) < infinite))
    some = vectors.where(F.col(vec_id).isNotNull() & x.isNotNull() & finite & F.exists(x, lambda c: c != 0)) \
        .select(F.col(vec_id).alias("vec_id"), x.alias("v"))
    return some.groupBy("vec_id").agg(F.min("v").alias("v"))


def _squared(v: Column) -> Column:
    return F.aggregate(v, F.lit(0.0), lambda s, c: s + c.cast("double") * c.cast("double"))


def matrix(column: pa.ChunkedArray | pa.Array) -> np.ndarray:
    """A list column as a matrix of doubles."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    flat = column.flatten().to_numpy(zero_copy_only=False).astype(np.float64)
    return flat.reshape(len(column), -1)


def lengthened(x: np.ndarray, longest: float) -> np.ndarray:
    """With the coordinate that brings every vector to the longest one's length."""
    rest = np.sqrt(np.maximum(longest ** 2 - (x ** 2).sum(axis=1), 0))
    return np.hstack([x, rest[:, None]])


def as_query(x: np.ndarray, longest: float) -> np.ndarray:
    return np.hstack([x * (longest / np.sqrt((x ** 2).sum(axis=1)))[:, None], np.zeros((len(x), 1))])


def inner_products(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Row by row, summed from the first component to the last."""
    out = np.zeros(len(a))
    for j in range(a.shape[1]):
        out += a[:, j] * b[:, j]
    return out


def namable(vec_ids: np.ndarray, v: np.ndarray, k: int) -> np.ndarray:
    """Rows that k best can name: of equal vectors those with the k + 1 smallest ids (one may be the query's own)."""
    _, same = np.unique(np.ascontiguousarray(v).view(f"V{v.itemsize * v.shape[1]}").ravel(), return_inverse=True)
    order = np.lexsort((vec_ids, same))
    same = same[order]
    return np.sort(order[np.arange(len(order)) - np.searchsorted(same, same) <= k])


def best_pairs(query_ids: np.ndarray, q: np.ndarray, vec_ids: np.ndarray, v: np.ndarray, k: int,
               bound: np.ndarray | None = None, bound_ids: np.ndarray | None = None,
               step: int = 512) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Each query's k best of these vectors, its own id excepted: (query row, vector row, score).

    With ``bound`` (-inf: none) only those before a neighbour of that score and
    of the id in ``bound_ids`` that the query already has.
    """
    kept = namable(vec_ids, v, k)
    vec_ids, v = vec_ids[kept], v[kept]
    bound = np.full(len(q), -np.inf) if bound is None else bound
    bound_ids = query_ids if bound_ids is None else bound_ids
    # far above the rounding of a sum of len products, so that no true neighbour is missed
    slack = 1e-12 * q.shape[1] * np.sqrt((q ** 2).sum(axis=1) * (v ** 2).sum(axis=1).max())
    least = bound - slack
    found = []
    for start in range(0, len(q), step):
        rough = q[start:start + step] @ v.T
        at = least[start:start + step].copy()
        if len(v) > k + 1:
            many = np.flatnonzero(np.isneginf(at) | ((rough >= at[:, None]).sum(axis=1) > 4 * k))
            if len(many):
                kth = np.partition(rough[many], len(v) - k - 1, axis=1)[:, len(v) - k - 1]  # own id included
                at[many] = np.maximum(at[many], kth - slack[start + many])
        rows, columns = np.nonzero(rough >= at[:, None])
        rows += start
        other = query_ids[rows] != vec_ids[columns]
        rows, columns = rows[other], columns[other]
        score = inner_products(q[rows], v[columns])
        before = (score > bound[rows]) | (score == bound[rows]) & (vec_ids[columns] < bound_ids[rows])
        rows, columns, score = rows[before], columns[before], score[before]
        order = np.lexsort((vec_ids[columns], -score, rows))
        rows, columns, score = rows[order], columns[order], score[order]
        top = np.arange(len(rows)) - np.searchsorted(rows, rows) < k
        found.append((rows[top], kept[columns[top]], score[top]))
    return tuple(np.concatenate(part) for part in zip(*found))


# --- index and search -------------------------------------------------------------------------

def build(vectors: DataFrame, how: Ann) -> tuple[Centroids, float]:
    """Centroids fitted on a sample of ``usable`` vectors, and the longest vector's length."""
    n, longest = vectors.agg(F.count("*"), F.max(_squared(F.col("v")))).first()
    longest = float(longest or 1.0) ** 0.5
    share = min(1.0, how.sample_rows / max(1, n))
    at = F.pmod(F.xxhash64("vec_id"), F.lit(1 << 30))
    rows = vectors.where(at < int(share * (1 << 30))).limit(2 * how.sample_rows).select("vec_id", "v").toArrow()
    order = np.argsort(rows["vec_id"].to_numpy(), kind="stable")
    x = matrix(rows["v"])[order] if len(rows) else np.ones((1, 1))
    lists = min(how.max_lists, max(1, n // how.list_rows), len(x))
    return Centroids.fit(lengthened(x, longest) if len(rows) else x, lists, how), longest


def search(vectors: DataFrame, is_query: Column, vec_id: str = "vec_id", embedding: str = "embedding",
           how: Ann = Ann()) -> DataFrame:
    """(query_id, rank, vec_id, score): the nearest found to every row for which ``is_query`` holds (over vec_id)."""
    spark = vectors.sparkSession
    kind = vectors.schema[vec_id].dataType
    good = usable(vectors, vec_id, embedding)
    good = save(good, "vectors")
    common = good.groupBy(F.size("v").alias("size")).count().orderBy(F.desc("count"), "size").first()
    good = good.where(F.size("v") == (common["size"] if common else 0))
    index, longest = build(good, how)
    shared = spark.sparkContext.broadcast(index)  # at most max_lists centroids of fixed degree
    id_type, v_type = kind.simpleString(), good.schema["v"].dataType.simpleString()

    def replicate(batches):
        for batch in batches:
            x = lengthened(matrix(batch.column("v")), longest)
            found = []
            for v in x:
                ids, far = shared.value.within(v, how.boundary, 1, most=how.replicas)
                found.append(ids[far <= how.boundary * far[0]][:how.replicas].tolist())
            yield _dealt(batch, found)

    postings = save(good.mapInArrow(replicate, f"list int, lists array<int>, vec_id {id_type}, v {v_type}"), "postings")
    sizes = np.zeros(len(index.points), np.int64)
    for r in postings.groupBy("list").count().collect():  # one row per list
        sizes[r["list"]] = r["count"]
    shared_sizes = spark.sparkContext.broadcast(sizes)

    def probe(batches):
        for batch in batches:
            x = as_query(matrix(batch.column("v")), longest)
            lists = [shared.value.within(v, how.reach, how.least_lists, shared_sizes.value,
                                         how.replicas * (how.k + 1))[0].tolist() for v in x]
            yield pa.RecordBatch.from_arrays([batch.column("vec_id"), batch.column("v"),
                                              pa.array(lists, pa.list_(pa.int32()))], ["vec_id", "v", "lists"])

    probes = save(good.where(is_query).mapInArrow(probe, f"vec_id {id_type}, v {v_type}, lists array<int>"), "probes")
    most = probes.agg(F.max(F.size("lists"))).first()[0] or 0
    best, start, stop = None, 0, how.first_lists
    while True:
        found = search_round(postings, probes, best, start, stop, sizes, how)
        by = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
        best = (found if best is None else best.drop("rank").unionByName(found)) \
            .withColumn("rank", F.row_number().over(by)).where(F.col("rank") <= how.k)
        if stop >= most:
            return best.select("query_id", "rank", "vec_id", "score")
        best, start, stop = save(best, "best"), stop, stop * how.widen


def search_round(postings: DataFrame, probes: DataFrame, best: DataFrame | None, start: int, stop: int,
                 sizes: np.ndarray, how: Ann) -> DataFrame:
    """(query_id, vec_id, score) from each query's lists ``start`` to ``stop``, nearest first.

    Every pair comes at most once, and none that meets in a list of an earlier
    round or comes after the query's k-th in ``best``.
    """
    spark = probes.sparkSession
    id_type, v_type = probes.schema["vec_id"].dataType.simpleString(), probes.schema["v"].dataType.simpleString()
    now = F.slice("lists", start + 1, stop - start)
    asked = {r["list"]: r["count"]
             for r in probes.select(F.explode(now).alias("list")).groupBy("list").count().collect()}  # one row per list
    plan = [(i, -(-int(sizes[i]) // how.block_rows), -(-n // how.block_queries)) for i, n in asked.items() if sizes[i]]
    blocks = F.broadcast(spark.createDataFrame(plan, "list int, row_blocks int, query_blocks int"))
    if best is None:
        bounded = probes.withColumns({"bound": F.lit(None).cast("double"), "bound_id": F.lit(None).cast(id_type)})
    else:
        last = best.where(F.col("rank") == how.k).select("query_id", F.col("score").alias("bound"),
                                                         F.col("vec_id").alias("bound_id"))
        bounded = probes.where(F.size("lists") > start) \
            .join(last, F.col("vec_id") == F.col("query_id"), "left").drop("query_id")
    n_lists = len(sizes)

    def ask(batches):
        for batch in batches:
            for at in range(0, len(batch), 1024):
                part = batch.slice(at, 1024)
                lists = part.column("lists").to_pylist()
                earlier, these = ([x[a:b] for x in lists] for a, b in ((0, start), (start, stop)))
                dealt = pa.array(np.repeat(np.arange(len(part)), [len(x) for x in these]))
                yield pa.RecordBatch.from_arrays(
                    [pa.array([i for x in these for i in x], pa.int32()), bit_rows(earlier, n_lists).take(dealt),
                     bit_rows(these, n_lists).take(dealt),
                     *(part.column(c).take(dealt) for c in ("vec_id", "v", "bound", "bound_id"))],
                    ["list", "earlier", "these", "vec_id", "v", "bound", "bound_id"])

    queries = bounded.mapInArrow(ask, f"list int, earlier binary, these binary, vec_id {id_type}, v {v_type}, "
                                      f"bound double, bound_id {id_type}")

    def dealt(side: DataFrame, own: str, other: str, mine: str, theirs: str) -> DataFrame:
        return side.join(blocks, "list").select(
            *side.columns, F.pmod(F.xxhash64("vec_id"), F.col(mine)).cast("int").alias(own),
            F.explode(F.sequence(F.lit(0), F.col(theirs) - 1)).alias(other))

    cell = ["list", "row_block", "query_block"]
    left = dealt(postings, "row_block", "query_block", "row_blocks", "query_blocks")
    right = dealt(queries, "query_block", "row_block", "query_blocks", "row_blocks")

    def compare(rows: pa.Table, asking: pa.Table) -> pa.Table:
        names = ["query_id", "vec_id", "score"]
        if not len(rows) or not len(asking):
            q = i = np.zeros(0, np.int64)
            score = np.zeros(0)
        else:
            bound = asking["bound"].fill_null(-np.inf).to_numpy()
            bound_ids = asking["bound_id"].fill_null(rows["vec_id"][0]).to_numpy()
            q, i, score = best_pairs(asking["vec_id"].to_numpy(), matrix(asking["v"]), rows["vec_id"].to_numpy(),
                                     matrix(rows["v"]), how.k, bound, bound_ids)
            new = ~met_before(rows["list"][0].as_py(), rows["lists"].to_pylist(), bits_of(asking["earlier"], n_lists),
                              bits_of(asking["these"], n_lists), q, i)
            q, i, score = q[new], i[new], score[new]
        return pa.table([asking["vec_id"].take(pa.array(q)), rows["vec_id"].take(pa.array(i)), pa.array(score)], names)

    return left.groupBy(*cell).cogroup(right.groupBy(*cell)).applyInArrow(
        compare, f"query_id {id_type}, vec_id {id_type}, score double")


def bit_rows(lists: list[list[int]], n: int) -> pa.Array:
    """Sets of numbers below ``n``, a bit each."""
    marks = np.zeros((len(lists), n), bool)
    marks[np.repeat(np.arange(len(lists)), [len(x) for x in lists]), [i for x in lists for i in x]] = True
    return pa.array([r.tobytes() for r in np.packbits(marks, axis=1)], pa.binary())


def bits_of(column: pa.ChunkedArray, n: int) -> np.ndarray:
    packed = np.frombuffer(b"".join(column.to_pylist()), np.uint8).reshape(len(column), -1)
    return np.unpackbits(packed, axis=1, count=n).view(bool)


def met_before(own: int, lists: list[list[int]], earlier: np.ndarray, these: np.ndarray, q: np.ndarray,
               i: np.ndarray) -> np.ndarray:
    """Marks pairs (query row, vector row) that meet in a list of an earlier round, too, or in one numbered below ``own``.

    That list names the pair, or knows k better ones, so this one need not.
    """
    width = max(len(x) for x in lists)
    padded = np.array([x + [own] * (width - len(x)) for x in lists])[i]
    at = q[:, None]
    return (earlier[at, padded] | these[at, padded] & (padded < own)).any(axis=1)


def _dealt(batch: pa.RecordBatch, found: list[list[int]]) -> pa.RecordBatch:
    """A row for every list found to a vector."""
    at = pa.array([i for i, ids in enumerate(found) for _ in ids], pa.int64())
    return pa.RecordBatch.from_arrays(
        [pa.array([x for ids in found for x in ids], pa.int32()), pa.array(found, pa.list_(pa.int32())).take(at),
         batch.column("vec_id").take(at), batch.column("v").take(at)], ["list", "lists", "vec_id", "v"])
