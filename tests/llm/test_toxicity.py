import random

import numpy as np
from pyspark.sql import functions as F

from perkflow.llm import toxicity as T
from perkflow.llm.queries import toxic_held_out


def test_held_out_documents(results, duck):
    got = results("op12_toxicity_pu")
    labels = dict(duck.execute("SELECT doc_id, max(toxic) FROM labels GROUP BY doc_id").fetchall())
    assert len(got) == duck.execute("SELECT count(*) FROM documents").fetchone()[0]
    held = [(labels[i], p, s) for i, h, s, p in got.itertuples(index=False) if h and i in labels]
    assert len(held) > 60
    caught = [p for y, p, _ in held if y == 1]
    assert sum(caught) >= 0.7 * len(caught)
    assert sum(p for y, p, _ in held if y == 0) <= 0.05 * len(held)
    assert ((got["score"] >= 0.7) == (got["predicted"] == 1)).all()
    assert got["score"].between(0, 1).all()


def test_gradients_are_those_of_the_risk():
    rng = np.random.default_rng(1)
    p, u, prior, e = rng.normal(0, 2, 5), rng.normal(0, 2, 7), 0.13, 1e-6
    as_toxic, corrected, as_clean = T.gradients(p, u, prior)
    for i in range(5):
        q = p.copy()
        q[i] += e
        a, b = T.risk(q, u, prior), T.risk(p, u, prior)
        assert np.isclose((a[0] - b[0]) / e, as_toxic[i], atol=1e-5)
        assert np.isclose((a[1] - b[1]) / e, corrected[i], atol=1e-5)
    for i in range(7):
        q = u.copy()
        q[i] += e
        a, b = T.risk(p, q, prior), T.risk(p, u, prior)
        assert a[0] == b[0] and np.isclose((a[1] - b[1]) / e, as_clean[i], atol=1e-5)


def test_corrected_risk_stays_non_negative_where_a_plain_one_would_not():
    """Every toxic text hides in the unlabelled sample under a feature of its own."""
    rng = np.random.default_rng(2)
    n = 60
    toxic = [[0] + [int(rng.integers(1, n))] for _ in range(30)]
    unlabelled = [[int(rng.integers(1, n))] for _ in range(170)] + [[0, i] for i in range(1, 31)]
    t = T.Training(steps=600, l2=0.0)
    a, b = T.Sparse(toxic, n), T.Sparse(unlabelled, n)
    w, bias = T.fit(a, b, 0.15, t)
    assert T.risk(a.times(w) + bias, b.times(w) + bias, 0.15)[1] > -0.05
    assert w[0] == w.max()
    plain = T.fit(a, b, 0.15, T.Training(steps=600, l2=0.0, give_back=-1.0))
    assert T.risk(a.times(plain[0]) + plain[1], b.times(plain[0]) + plain[1], 0.15)[1] \
        < T.risk(a.times(w) + bias, b.times(w) + bias, 0.15)[1]


def test_places_hold_the_features_of_a_text():
    rng = random.Random(3)
    texts = [" ".join(rng.choice(["abc", "abcdefgh", "Abcdxyz", "ünderß", "x-y", "UN!der", ""]) + rng.choice(["", "q"])
                      for _ in range(rng.randrange(30))).encode() for _ in range(60)]
    names = sorted({f for t in texts for f in T.features(t)})
    for kept in (names, names[::3], []):
        places = T.Places(kept)
        for t in texts:
            want = sorted(kept.index(f) for f in T.features(t) if f in kept)
            assert places.of(t) == want
    assert T.features(b"Badword badworse") == [
        b"#2", b"=badword", b"=badworse", b"^4badw", b"2^4badw", b"^5badwo", b"2^5badwo", b"^6badwor", b"2^6badwor",
        b"$4word", b"$4orse", b"$5dword", b"$5worse"]


def corpus(spark, n=600):
    rng = random.Random(4)
    rows = []
    for i in range(n):
        text = [f"word{rng.randrange(400)}" for _ in range(rng.randrange(20, 60))]
        toxic = i % 6 == 0
        for _ in range(3 if toxic else 0):
            text.insert(rng.randrange(len(text)), rng.choice(["vile", "nastig", "nastien"]))
        rows.append((i, " ".join(text), int(toxic)))
    docs = spark.createDataFrame([(i, t) for i, t, _ in rows], "doc_id long, text string")
    labels = spark.createDataFrame([(i, y) for i, _, y in rows if i % 5 < 3], "doc_id long, toxic int")
    return docs, labels, {i: y for i, _, y in rows}


def test_learns_from_toxic_labels_only_and_scores_every_row(spark):
    docs, labels, truth = corpus(spark)
    labels = labels.unionByName(labels.where("toxic = 1")).unionByName(
        spark.createDataFrame([(None, 1), (3, None), (5, 7), (99_999, 1)], "doc_id long, toxic int"))
    odd = [(9000, None), (9001, ""), (9002, "nastien " * 200_000), (9003, "word1 " * 200_000), (None, "vile vile nastig"),
           (0, "a second row of this id")]
    some = docs.unionByName(spark.createDataFrame(odd, "doc_id long, text string"))
    some = some.unionByName(some.limit(40)).withColumn("toxic", F.lit("x")).withColumn("at", F.lit(1)) \
        .withColumn("id", F.lit(2)).withColumn("y", F.lit(0))
    model = T.train(some, labels, ~toxic_held_out("doc_id"))
    got = some.select("doc_id", "text", T.score_column(model, "text").alias("score")).collect()
    assert len(got) == 600 + len(odd) + 40
    wrong = [(r["doc_id"], r["score"]) for r in got if r["doc_id"] in truth and r["text"] != odd[-1][1]
             and (r["score"] >= 0.7) != (truth[r["doc_id"]] == 1)]
    assert len(wrong) <= 0.025 * len(got), wrong
    by = {r["doc_id"]: r["score"] for r in got}
    assert by[9000] == by[9001] < 0.7 and by[9002] > 0.7 > by[9003] and by[None] > 0.7


def test_without_examples(spark):
    docs, labels, _ = corpus(spark, 30)
    least = T.Training().least_prior
    for d, lab in ((docs, labels.where("toxic = 0")), (docs, labels.limit(0)), (docs.limit(0), labels)):
        model = T.train(d, lab, F.lit(True))
        assert np.allclose(model.scores([b"", b"vile"]), least)
    assert docs.limit(0).select(T.score_column(model, "text")).collect() == []


def test_prior_can_be_given_and_labels_outside_the_fold_do_not_matter(spark):
    docs, labels, _ = corpus(spark, 240)
    fold = F.col("doc_id") % 4 != 0
    other = labels.withColumn("toxic", F.when(fold, F.col("toxic")).otherwise(1 - F.col("toxic")))
    how = T.Training(prior=0.2)
    a, b = T.train(docs, labels, fold, how), T.train(docs, other, fold, how)
    assert a.names == b.names and a.weights.tolist() == b.weights.tolist() and a.bias == b.bias
