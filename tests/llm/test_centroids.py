import hashlib
import math

import numpy as np
import pytest

from perkflow.llm import centroids as C


def test_query_equals_sql(matches_sql):
    matches_sql("op13_centroid_clustering")


def test_gain_holds_for_every_point_of_the_sphere_and_is_below_the_drift():
    rng = np.random.default_rng(3)
    below = 0
    for _ in range(300):
        k, d = 4, int(rng.integers(2, 6))
        centers = rng.normal(0, 10, (k, d))
        moved = centers + rng.normal(0, rng.choice([0.1, 3, 30]), (k, d)) * (rng.random((k, 1)) < 0.8)
        radii = rng.random(k) * rng.choice([0.5, 5, 30])
        gain = C.gains(centers, moved, radii)
        drift = np.sqrt(((moved - centers) ** 2).sum(axis=1))
        for i in range(k):
            way = rng.normal(size=(400, d))
            x = centers[i] + way / np.sqrt((way ** 2).sum(axis=1))[:, None] * radii[i]
            others = [j for j in range(k) if j != i]
            closer = [np.sqrt(((x - centers[j]) ** 2).sum(axis=1)) - np.sqrt(((x - moved[j]) ** 2).sum(axis=1))
                      for j in others]
            assert max(c.max() for c in closer) <= gain[i] + 1e-9
            most = drift[others].max()
            assert gain[i] <= most * (1 + 1e-8)
            below += gain[i] < 0.9 * most
    assert below > 200      # loosened by less than the full drift


def lloyd(rows, how):
    """The same clustering with every distance computed, in Python's integers."""
    kept = [(i, [math.floor(how.scale * float(x)) for x in v]) for i, v in rows if v is not None
            and len(v) == how.size and all(x is not None and math.isfinite(x) for x in v)]
    mark = lambda i: (i is None, hashlib.sha256(f"1:{i}".encode()).hexdigest() if i is not None else "")
    centers = [v for _, v in sorted(kept, key=lambda r: (mark(r[0]), r[1]))[:how.clusters]]

    def far(a, b):
        return sum((x - y) ** 2 for x, y in zip(a, b))

    def nearest(v):
        return min(range(len(centers)), key=lambda c: (far(v, centers[c]), c))

    for _ in range(how.rounds):
        members = {}
        for _, v in kept:
            members.setdefault(nearest(v), []).append(v)
        centers = [[sum(x) // len(members[c]) for x in zip(*members[c])] if c in members else centers[c]
                   for c in range(len(centers))]
    return sorted(((i, nearest(v), far(v, centers[nearest(v)])) for i, v in kept), key=str), centers


def check(spark, rows, how, parts=3):
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>").repartition(parts)
    found, centers = C.cluster(df, how=how)
    want, want_centers = lloyd(rows, how)
    assert sorted((tuple(r) for r in found.collect()), key=str) == want
    assert centers.tolist() == want_centers


def test_groups_ties_repeats_and_unusable_vectors_equal_lloyd(spark):
    rng = np.random.default_rng(5)
    how = C.KMeans(clusters=6, rounds=4, size=3, scale=8)
    middles = rng.normal(0, 20, (9, 3))
    rows = [(i, (middles[i % 9] + rng.normal(0, 4, 3)).tolist()) for i in range(700)]
    rows += [(i, [float(i % 3), 0.0, -1.0]) for i in range(700, 760)]            # many ties
    rows += [(1, rows[1][1])] * 40 + [(None, [1.0, 2.0, 3.0]), (None, [1.0, 2.0, 2.9])]
    rows += [(900, None), (901, []), (902, [1.0, 2.0]), (903, [1.0, None, 2.0]), (904, [1.0, float("nan"), 0.0]),
             (905, [float("-inf"), 0.0, 0.0]), (906, [-0.0, 0.0, -0.01])]
    check(spark, rows, how)


def test_some_vectors_are_spared_the_scan_and_none_changes_for_it():
    rng = np.random.default_rng(8)
    middles = rng.normal(0, 400, (8, 16))
    x = np.floor(middles[rng.integers(0, 8, 3000)] + rng.normal(0, 40, (3000, 16))).astype(np.int64)
    centers = x[:8].copy()
    own, upper, lower, _ = C.assigned(x, C.Move(centers), np.zeros(3000, int), np.zeros(3000), np.zeros(3000))
    spared = 0
    for _ in range(6):
        new = np.array([x[own == c].sum(axis=0) // max(1, (own == c).sum()) if (own == c).any() else centers[c]
                        for c in range(8)])
        radii = np.array([upper[own == c].max(initial=0) for c in range(8)])
        move = C.Move(new, np.sqrt(((new - centers) ** 2).sum(axis=1)),
                      C.gains(centers.astype(float), new.astype(float), radii))
        own, upper, lower, scan = C.assigned(x, move, own, upper, lower)
        centers = new
        far = ((x[:, None, :] - centers[None]) ** 2).sum(axis=2)
        assert (own == far.argmin(axis=1)).all()
        assert (upper ** 2 >= far.min(axis=1) * (1 - 1e-12)).all()
        spared += (~scan).sum()
    assert spared > 3000


def test_few_vectors_none_and_clashing_names(spark):
    how = C.KMeans(clusters=4, size=2)
    check(spark, [(1, [0.5, 0.5]), (2, [-0.5, 0.25])], how)
    check(spark, [(7, [0.5, 0.5])] * 9, how)
    check(spark, [], how)
    df = spark.createDataFrame([(1, [1.0, 0.0], 5, 6.0, "x", [1])],
                               "vec_id long, embedding array<double>, own int, upper double, cluster string, v array<int>")
    assert [tuple(r) for r in C.cluster(df, how=how)[0].collect()] == [(1, 0, 0)]


def test_totals(spark):
    how = C.KMeans(clusters=2, size=1, scale=1)
    df = spark.createDataFrame([(i, [float(x)]) for i, x in enumerate([0, 1, 10, 11, 12])],
                               "vec_id long, embedding array<double>")
    rows = C.with_totals(*C.cluster(df, how=how)).collect()
    by = {r["cluster"]: r["cluster_inertia"] for r in rows}
    assert {r["inertia"] for r in rows} == {sum(by.values())}
    assert all(by[c] == sum(r["distance"] for r in rows if r["cluster"] == c) for c in by)


def test_large_components(spark):
    how = C.KMeans(clusters=3, size=2, scale=1)
    check(spark, [(i, [float(2 ** 26 - i * 7919 * k), -float(2 ** 26 - i)]) for i in range(40) for k in (1, 300)], how)
    df = spark.createDataFrame([(1, [1e30, 0.0])], "vec_id long, embedding array<double>")
    with pytest.raises(Exception, match="too large"):
        C.cluster(df, how=how)
