from dataclasses import replace

import numpy as np
from pyspark.sql import functions as F

from perkflow.llm import ann as A


def product(a, b):
    """First component to last (the built-in sum compensates its rounding)."""
    out = 0.0
    for x, y in zip(a, b):
        out += x * y
    return out


def brute(ids, x, query_ids, k=20):
    """{query: [(vec_id, score)]}, by all products."""
    out = {}
    for q in query_ids:
        v = x[ids.index(q)]
        score = [(product(v, w), i) for i, w in zip(ids, x) if i != q]
        out[q] = [(i, s) for s, i in sorted(score, key=lambda t: (-t[0], t[1]))[:k]]
    return out


def found(df):
    out = {}
    for r in sorted(df.collect(), key=lambda r: (r["query_id"], r["rank"])):
        out.setdefault(r["query_id"], []).append((r["vec_id"], r["score"]))
        assert len(out[r["query_id"]]) == r["rank"]
    return out


def recall(got, want):
    return np.mean([len({i for i, _ in got[q]} & {i for i, _ in w}) / max(1, len(w)) for q, w in want.items()])


def test_query_recall(results, duck):
    rows = duck.execute("SELECT vec_id, embedding FROM embeddings ORDER BY vec_id").fetchall()
    ids, x = [r[0] for r in rows], [list(map(float, r[1])) for r in rows]
    want = brute(ids, x, [i for i in ids if i % 20 == 0])
    table = results("op7_ann_posting_lists").sort_values(["query_id", "rank"])
    got = {q: list(zip(g.vec_id, g.score)) for q, g in table.groupby("query_id")}
    assert set(got) == set(want) and recall(got, want) >= 0.9
    exact = dict(zip(ids, x))
    for q, pairs in got.items():
        assert len(pairs) == 20 and pairs == sorted(pairs, key=lambda p: (-p[1], p[0]))
        assert all(s == product(exact[q], exact[i]) for i, s in pairs)


def test_recall_with_many_lists_and_blocks(spark):
    rng = np.random.default_rng(3)
    centres = rng.normal(size=(12, 16))
    x = (centres[rng.integers(0, 12, 3000)] + 0.6 * rng.normal(size=(3000, 16))) * rng.uniform(0.5, 2, (3000, 1))
    x = x.astype(np.float32)
    df = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "vec_id long, embedding array<float>")
    how = A.Ann(k=10, list_rows=32, block_rows=64, block_queries=8, sample_rows=1000)
    got = found(A.search(df, F.col("vec_id") % 50 == 0, how=how))
    want = brute(list(range(3000)), x.astype(float).tolist(), range(0, 3000, 50), 10)
    assert recall(got, want) >= 0.9


def test_copies_tie_to_the_smaller_id(spark):
    rng = np.random.default_rng(4)
    hot = rng.normal(size=8).tolist()
    rows = [(i, hot if i % 3 else rng.normal(size=8).tolist()) for i in range(900)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    got = found(A.search(df, F.col("vec_id") == 400, how=A.Ann(k=5, list_rows=16, block_rows=32)))
    assert [i for i, _ in got[400]] == [1, 2, 4, 5, 7]


def test_graph_walk_finds_the_nearest_centroids():
    rng = np.random.default_rng(5)
    index = A.Centroids.fit(rng.normal(size=(4000, 12)), 200, A.Ann())
    hits = 0
    for v in rng.normal(size=(100, 12)):
        ids, far = index.within(v, 1.1, 4)
        true = np.sqrt(((index.points - v) ** 2).sum(axis=1))
        want = set(np.flatnonzero(true <= 1.1 * true.min())) | set(np.argsort(true)[:4])
        hits += len(want & set(ids.tolist())) / len(want)
        assert np.allclose(true[ids], far)
    assert hits / 100 > 0.97


def test_edge_rows(spark):
    nan, inf = float("nan"), float("inf")
    rows = [(0, [1.0, 0.0]), (20, [0.0, 2.0]), (1, [1.0, 1.0]), (1, [1.0, 1.0]), (1, [3.0, 3.0]), (2, None), (3, []),
            (40, [0.0, 0.0]), (5, [nan, 1.0]), (60, [inf, 1.0]), (7, [1.0, None]), (8, [1.0, 2.0, 3.0]),
            (None, [1.0, 1.0]), (9, [-0.0, -1.0])]
    df = spark.createDataFrame([(i, v, 0, 0) for i, v in rows],
                               "vec_id long, embedding array<double>, score int, list int")
    got = found(A.search(df, F.col("vec_id") % 20 == 0))
    assert got == {0: [(1, 1.0), (9, 0.0), (20, 0.0)], 20: [(1, 2.0), (0, 0.0), (9, -2.0)]}
    assert A.search(df.limit(0), F.col("vec_id") % 20 == 0).collect() == []


def test_default_reach_loses_no_neighbours_of_vectors_without_structure():
    """All lists that hold one of a query's neighbours are searched, with as many lists as check_l has."""
    rng, how = np.random.default_rng(6), A.Ann()
    x = rng.normal(size=(10_000, 64))
    longest = np.sqrt((x ** 2).sum(axis=1).max())
    points = A.lengthened(x, longest)
    index = A.Centroids.fit(points, 100, how)
    own = A.nearest(points, index.points)
    sizes = np.bincount(own, minlength=len(index.points)) * 5
    hits = []
    for q, v in enumerate(A.as_query(x[:60], longest)):
        score = x @ x[q]
        score[q] = -np.inf
        ids, _ = index.within(v, how.reach, how.least_lists, sizes, how.replicas * (how.k + 1))
        hits.append(np.isin(own[np.argsort(-score)[:20]], ids).mean())
    assert np.mean(hits) >= 0.99, np.mean(hits)


def test_rounds_find_what_one_search_finds(spark):
    """Vectors without structure in 60 lists or more, a third of them equal: neighbours, ties and recall of the whole search."""
    rng = np.random.default_rng(8)
    x = rng.normal(size=(4000, 24)).astype(np.float32)
    x[::3] = x[0]
    df = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "vec_id long, embedding array<float>")
    how = A.Ann(k=10, list_rows=32, least_lists=2, first_lists=2, widen=3, block_rows=128, block_queries=16)
    good = A.usable(df, "vec_id", "embedding")
    assert len(A.build(good, how)[0].points) >= 60
    asked = F.col("vec_id") % 50 == 0
    got = found(A.search(df, asked, how=how))
    assert got == found(A.search(df, asked, how=replace(how, first_lists=10_000)))
    want = brute(list(range(4000)), x.astype(float).tolist(), range(0, 4000, 50), 10)
    assert recall(got, want) >= 0.97
    assert got[300] == want[300]  # a copy: the smallest ids of all copies


def test_best_pairs_with_bounds():
    rng = np.random.default_rng(9)
    v = rng.integers(-2, 3, (400, 6)).astype(float)  # many ties
    v = np.concatenate([v, np.repeat(v[:1], 300, axis=0)])
    ids = rng.permutation(len(v)) + 100
    for k in (1, 5, 2000):
        bound, bound_ids = rng.choice([-np.inf, 0.0, 6.0, 12.0], 60), rng.integers(100, 800, 60)
        rows, columns, score = A.best_pairs(ids[:60], v[:60], ids, v, k, bound, bound_ids, step=7)
        for q in range(60):
            all_pairs = sorted((-product(v[q], w), int(i)) for i, w in zip(ids, v) if i != ids[q])
            want = [(i, -s) for s, i in all_pairs[:k] if (s, i) < (-bound[q], bound_ids[q])]
            mine = rows == q
            got = list(zip(ids[columns[mine]].tolist(), score[mine].tolist()))
            assert got == want
