import hashlib
import random
from collections import defaultdict

from pyspark.sql import functions as F

from perkflow.llm import merkle


def H(*parts):
    return hashlib.sha256("".join(parts).encode()).hexdigest()


def levels(nodes):
    out = [nodes]
    while len(out[-1]) > 1:
        out.append([H(*out[-1][i:i + 3]) for i in range(0, len(out[-1]), 3)])
    return out


def path(tree, p):
    out = []
    for level in tree[:-1]:
        first = p - p % 3
        out.append(("".join(level[first:p]), "".join(level[p + 1:first + 3])))
        p //= 3
    return out


def brute(rows):
    """rows: (group, key, leaf)."""
    groups = defaultdict(list)
    for r in rows:
        groups[r[0]].append(r)
    names = sorted(groups, key=lambda g: (g is not None, (g or "").encode()))
    for g in names:
        groups[g].sort(key=lambda r: (r[1] is not None, r[1] or 0, r[2]))
    trees = {g: levels([r[2] for r in groups[g]]) for g in names}
    top = levels([trees[g][-1][0] for g in names])
    return sorted(((g, r[1], r[2], trees[g][-1][0], top[-1][0], path(trees[g], p) + path(top, i))
                   for i, g in enumerate(names) for p, r in enumerate(groups[g])), key=str)


def value(v):
    return "-" if v is None else f"{len(str(v).encode())}:{v}"


def found(df):
    m = merkle.manifest(df, F.col("s"), F.col("k"), merkle.leaf(F.col("s"), F.col("k")))
    rows = sorted(((r["group"], r["row_key"], r["leaf"], r["subroot"], r["root"], [tuple(x) for x in r["proof"]])
                   for r in m.collect()), key=str)
    return m, rows


def test_query_equals_sql(matches_sql):
    matches_sql("op11_merkle_manifest")


def test_every_tampered_text_with_a_line_break_is_seen(results, duck):
    import zlib
    texts = dict(duck.execute("SELECT doc_id, text FROM documents").fetchall())
    got = results("op11_merkle_manifest")
    for doc_id, verified in zip(got["doc_id"], got["verified"]):
        changed = zlib.crc32(str(doc_id).encode()) % 2 == 0 and "\n" in (texts[doc_id] or "")
        assert verified == (not changed)


def test_hot_group_many_groups_nulls_and_repeats_equal_brute_force(spark):
    """The hot group needs several blocks and rounds, the groups' tree two blocks."""
    rng = random.Random(1)
    rows = [(rng.choice(["a", "ß", None]) if rng.random() < 0.2 else "hot", rng.randrange(9000)) for _ in range(4000)]
    rows += [(f"s{i}", i) for i in range(800)] + [("hot", 5)] * 40 + [("hot", None)] * 3
    df = spark.createDataFrame(rows, "s string, k long").repartition(5)
    m, got = found(df)
    assert got == brute([(s, k, H(value(s), value(k))) for s, k in rows])
    assert m.where(merkle.folded(F.col("leaf"), F.col("proof")) != F.col("root")).count() == 0
    assert m.where(merkle.folded(F.sha2(F.col("leaf"), 256), F.col("proof")) == F.col("root")).count() == 0


def test_block_sizes_around_a_full_block(spark):
    for n in (3, merkle.BLOCK, 3 * merkle.BLOCK + 1):
        rows = [("g", i) for i in range(n)]
        _, got = found(spark.createDataFrame(rows, "s string, k long"))
        assert got == brute([(s, k, H(value(s), value(k))) for s, k in rows]), n


def test_a_lone_leaf_is_the_root(spark):
    _, got = found(spark.createDataFrame([(None, None)], "s string, k long"))
    assert got == [(None, None, H("--"), H("--"), H("--"), [])]


def test_empty_table_and_clashing_names(spark):
    none = spark.createDataFrame([], "s string, k long")
    assert found(none)[1] == []
    names = "s string, k long, grp int, pos int, node string, kept int, tie int, part int, path string, total int"
    rows = [("a", 1, 0, 0, "x", 0, 0, 0, "p", 0), ("a", 2, 0, 0, "x", 0, 0, 0, "p", 0)]
    assert found(spark.createDataFrame(rows, names))[1] == \
        brute([("a", i, H(value("a"), value(i))) for i in (1, 2)])


def test_fields_are_told_apart(spark):
    texts = ["", None, "-", "é" * 3, "x" * 3_000_000, "1:a"]
    df = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "i int, t string")
    got = [r[0] for r in df.orderBy("i").select(merkle.leaf(F.col("t"))).collect()]
    assert got == [H(value(t)) for t in texts]
