import itertools
import random

import numpy as np
from pyspark.sql import functions as F

from perkflow.llm import minhash as M


def word_sets(texts: dict, k: int) -> dict:
    lower = bytes(c + 32 if 65 <= c <= 90 else c for c in range(256))
    out = {}
    for i, t in texts.items():
        words = (t or "").encode().translate(lower).split()
        out[i] = frozenset(tuple(words[j:j + k]) for j in range(len(words) - k + 1)) if len(words) >= k \
            else frozenset([tuple(words)]) if words else frozenset()
    return out


def brute(texts: dict, k: int, percent: int = 80) -> dict:
    """Smallest reachable id of every document, by all pairs that share a shingle."""
    sets = word_sets(texts, k)
    by_shingle = {}
    for i, s in sets.items():
        for x in s:
            by_shingle.setdefault(x, []).append(i)
    parent = {i: i for i in texts}

    def find(i):
        while parent[i] != i:
            i = parent[i]
        return i

    tried = set()
    for members in by_shingle.values():
        for a, b in itertools.combinations(members, 2):
            if (a, b) not in tried:
                tried.add((a, b))
                if 100 * len(sets[a] & sets[b]) >= percent * len(sets[a] | sets[b]):
                    x, y = sorted((find(a), find(b)))
                    parent[y] = x
    return {i: find(i) for i in texts}


def test_query_equals_brute_force(results, duck):
    texts = dict(duck.execute("SELECT doc_id, text FROM documents").fetchall())
    got = results("op8_minhash_neardup").set_index("doc_id")
    assert len(got) == len(texts)
    sets, want = word_sets(texts, 4), brute(texts, 4)
    for i in texts:
        assert got.loc[i, "n_shingles"] == len(sets[i])
        assert got.loc[i, "component_id"] == want[i], i
        assert got.loc[i, "kept"] == (want[i] == i)


def family(rng, n, words, swaps, start):
    """n copies of one text, each with some words replaced, and a chain of copies of copies."""
    base = [f"w{rng.randrange(5000)}" for _ in range(words)]
    out = {}
    for i in range(n):
        copy = list(base)
        for _ in range(rng.randrange(swaps)):
            copy[rng.randrange(words)] = f"x{rng.random()}"
        out[start + i] = " ".join(copy)
        if i % 7 == 0:
            base = copy
    return out


def test_large_families_equal_brute_force(spark):
    rng = random.Random(4)
    texts = {}
    for f, (n, words, swaps) in enumerate([(60, 150, 5), (120, 120, 9), (30, 300, 4), (10, 12, 3)]):
        texts |= family(rng, n, words, swaps, 1000 * f)
    shared = " ".join(f"s{i}" for i in range(80))
    texts |= {5000 + i: shared + " " + " ".join(f"y{rng.random()}" for _ in range(40)) for i in range(40)}
    docs = spark.createDataFrame(list(texts.items()), "doc_id long, text string").repartition(5)
    how = M.NearDup(shingle=4, block=16)
    got = {r["doc_id"]: r["component_id"] for r in M.near_duplicates(docs, how=how).collect()}
    assert got == brute(texts, 4)


def test_the_second_pass_alone_joins_every_component(spark):
    """Without stars, blocks of 16 must join what the links join."""
    rng = random.Random(9)
    texts = family(rng, 70, 120, 12, 0) | family(rng, 40, 60, 6, 100)
    docs = spark.createDataFrame(list(texts.items()), "doc_id long, text string")
    how = M.NearDup(shingle=4, block=16)
    rows = docs.select("doc_id", M.sketch_column("text", how).alias("s")).select("doc_id", "s.*") \
        .groupBy("node").agg(F.min("doc_id").alias("doc_id"), *[F.first(c).alias(c) for c in ("n", "minima", "keys")])
    joined = docs.join(rows.select("doc_id", F.col("node").alias("wanted")), "doc_id")
    sets = M.full_sets(joined.select("wanted", F.col("text").cast("binary").alias("text")), how)
    buckets = rows.select("node", "n", F.explode("keys").alias("key"), F.col("node").alias("root"))
    links = M.cross_links(buckets, rows, sets, how)
    least = {bytes(r["node"]): r["doc_id"] for r in rows.collect()}
    root = {bytes(r["node"]): least[bytes(r["root"])] for r in M.components(links).collect()}
    want = brute(texts, 4)
    got = {}
    for node, i in least.items():
        got.setdefault(root.get(node, i), set()).add(i)
    wanted = {}
    for i in least.values():
        wanted.setdefault(want[i], set()).add(i)
    assert sorted(map(sorted, got.values())) == sorted(map(sorted, wanted.values()))


def test_signatures_estimate_similarity():
    rng = np.random.default_rng(2)
    how = M.NearDup()
    signer = M.Signer(how)
    x = rng.integers(0, 2 ** 63, 3000, dtype=np.uint64)
    y = np.concatenate((x[:2700], rng.integers(0, 2 ** 63, 300, dtype=np.uint64)))
    equal = (signer.minima(x) == signer.minima(y)).mean()
    assert abs(equal - 2700 / 3300) < 0.12
    assert (signer.minima(x) == signer.minima(x[::-1].copy())).all()


def test_components_of_a_long_chain_and_a_star(spark):
    key = lambda i: i.to_bytes(4, "big")
    links = [(i, i + 1) for i in range(100, 160)] + [(7, i) for i in range(200, 300)] + [(301, 300), (301, 301)]
    df = spark.createDataFrame([(key(a), key(b)) for a, b in links], "a binary, b binary")
    got = {int.from_bytes(r["node"], "big"): int.from_bytes(r["root"], "big") for r in M.components(df).collect()}
    assert got == {i: 100 for i in range(101, 161)} | {i: 7 for i in range(200, 300)} | {301: 300}
    assert M.components(df.limit(0)).collect() == []


def test_edge_rows(spark):
    long = " ".join(f"v{i}" for i in range(30_000))
    rows = [(1, None), (2, ""), (3, " \n"), (4, "one two"), (5, "ONE two"), (6, "one two three four five"),
            (6, "one two three four five"), (6, "quite another text with its own words"), (None, "one Two"),
            (8, long), (9, long + " end"), (None, None)]
    docs = spark.createDataFrame([(i, t, 0) for i, t in rows], "doc_id long, text string, component_id int")
    got = sorted(((r["doc_id"], r["n_shingles"], r["component_id"]) for r in M.near_duplicates(docs).collect()),
                 key=str)
    want = [(1, 0, 1), (2, 0, 2), (3, 0, 3), (4, 1, 4), (5, 1, 4), (6, 1, 6), (6, 1, 6), (6, 3, 6), (None, 1, 4),
            (8, 29_996, 8), (9, 29_997, 8), (None, 0, None)]
    assert got == sorted(want, key=str)
    left = M.without_near_duplicates(docs)
    assert left.columns == docs.columns
    assert sorted(((r["doc_id"], (r["text"] or "")[:5]) for r in left.collect()), key=str) == sorted(
        [(1, ""), (2, ""), (3, " \n"), (4, "one t"), (6, "one t"), (6, "quite"), (8, "v0 v1"), (None, "")], key=str)
    empty = docs.limit(0)
    assert M.near_duplicates(empty).collect() == [] and M.without_near_duplicates(empty).collect() == []


def test_key_filter_holds_for_every_key(spark):
    from perkflow.llm.common import key_filter
    keys = spark.createDataFrame([(i,) for i in range(0, 5000, 7)] + [(None,)], "k long")
    test = key_filter(keys, "k")
    every = spark.range(5000).select("id").union(spark.createDataFrame([(None,)], "id long"))
    hit = {r["id"] for r in every.where(test(F.col("id"))).collect()}
    wanted = set(range(0, 5000, 7)) | {None}
    assert wanted <= hit and len(hit - wanted) < 10
    assert every.where(key_filter(keys.limit(0), "k")(F.col("id"))).count() == 0


def test_one_text_of_a_component_stays_under_a_repeated_id(spark):
    base = [f"w{i}" for i in range(200)]

    def copy(k):
        return " ".join([*base[:150 + k], f"x{k}", *base[151 + k:]])

    other = " ".join(f"o{i}" for i in range(60))
    rows = [(5, copy(1)), (5, copy(2)), (5, copy(3)), (5, other), (6, copy(4)), (None, copy(5)), (None, "n " + other[:90]),
            (None, None), (None, ""), (5, copy(1))]
    nulls = [(None, copy(k).replace("w", "v")) for k in range(3)]
    docs = spark.createDataFrame(rows + nulls, "doc_id long, text string")
    kept = [(r["doc_id"], r["text"]) for r in M.without_near_duplicates(docs, how=M.NearDup(shingle=5)).collect()]
    story = [t for _, t in kept if t and t.startswith("w0 ")]
    assert len(story) == 1 and (5, story[0]) in kept and story[0] in {copy(1), copy(2), copy(3)}
    assert len([t for _, t in kept if t and t.startswith("v0 ")]) == 1
    assert (5, other) in kept and (None, None) in kept and (None, "") in kept


def test_a_very_common_text_is_looked_up_by_broadcast(spark):
    common = " ".join(f"c{i}" for i in range(30))
    rows = [(i, common) for i in range(10, 900)] + [(i, f"t{i} is a text of its own, number {i}") for i in range(900, 1000)] \
        + [(3, common + " and"), (4, None)]
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(6)
    found = M.near_duplicates(docs, how=M.NearDup(shingle=4))
    got = {r["doc_id"]: r["component_id"] for r in found.collect()}
    assert got == brute(dict(rows), 4) and len(got) == len(rows)
    plan = found._jdf.queryExecution().executedPlan().toString()
    assert "LeftAnti, BuildRight" in plan and plan.count("BroadcastHashJoin") >= 2
