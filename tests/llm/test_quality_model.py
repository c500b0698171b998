import zlib

import numpy as np
from pyspark.sql import functions as F

from perkflow.llm import quality_model as Q


def walk(model, row):
    """One row, tree by tree and node by node."""
    raw = model.prior
    for feature, threshold, leaf in zip(model.feature, model.threshold, model.leaf):
        node = 0
        while node < len(feature):
            node = 2 * node + (2 if row[feature[node]] > threshold[node] else 1)
        raw += leaf[node - len(feature)]
    return 1 / (1 + np.exp(-raw))


def test_flat_arrays_equal_a_walk():
    rng = np.random.default_rng(3)
    x = rng.normal(size=(500, 6))
    y = ((x[:, 0] > 0) ^ (x[:, 1] > 0.5)).astype(float)
    model = Q.fit(x, y, Q.Training(trees=15, depth=3))
    got = model.scores(x, rows=64)
    assert np.allclose(got, [walk(model, r) for r in x])
    assert ((got > 0.5) == y).mean() > 0.95


def test_degenerate_training():
    x = np.zeros((4, 2))
    assert Q.fit(x[:0], np.zeros(0)).scores(x).tolist() == [0.5] * 4
    assert (Q.fit(x, np.ones(4)).scores(x) > 0.8).all()
    assert np.allclose(Q.fit(x, np.array([0, 1, 0, 1.])).scores(x), 0.5)


def test_query_on_held_out_labels(results, duck):
    got = results("op1_quality_classifier")
    labels = dict(duck.execute("SELECT doc_id, quality FROM labels").fetchall())
    assert len(got) == duck.execute("SELECT count(*) FROM documents").fetchone()[0]
    assert got.score.between(0, 1).all()
    assert (got.predicted == (got.score >= 0.3)).all()
    assert (got.held_out == got.doc_id.map(lambda i: zlib.crc32(str(i).encode()) % 5 == 0)).all()
    held = got[got.held_out & got.doc_id.isin(labels)]
    truth = held.doc_id.map(labels).to_numpy()
    assert (held.predicted.to_numpy()[truth == 1] == 1).mean() > 0.98
    assert (held.predicted.to_numpy()[truth == 0] == 0).mean() > 0.9


def test_edge_rows(spark):
    rows = [(1, "good text here. and more", "x"), (1, "good text here. and more", "x"), (2, None, "x"), (None, "", "x"),
            (3, "x" * 500_000, "x"), (4, "\n\t ", "x")] + [(10 + i, "bad $$ word$$ " * 4, "x") for i in range(8)] \
        + [(30 + i, "fine words of prose. " * 3, "x") for i in range(8)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, score string")
    labels = spark.createDataFrame([(10 + i, 0) for i in range(8)] + [(30 + i, 1) for i in range(8)]
                                   + [(1, 1), (1, 0), (2, 1), (None, 1), (3, None), (99, 1)], "doc_id long, quality int")
    model = Q.train(docs, labels, F.lit(True), Q.Training(least_weight=0.1))
    out = docs.select("doc_id", "score", Q.score_column(model, "text").alias("p")).collect()
    assert len(out) == len(rows) and all(0 <= r["p"] <= 1 for r in out)
    assert {r["p"] < 0.3 for r in out if r["doc_id"] in range(10, 18)} == {True}
    assert {r["p"] > 0.3 for r in out if r["doc_id"] in range(30, 38)} == {True}
    nothing = Q.train(docs.limit(0), labels.limit(0), F.lit(True))
    assert docs.limit(0).select(Q.score_column(nothing, "text")).collect() == []
    assert {r[0] for r in docs.select(Q.score_column(nothing, "text")).collect()} == {0.5}


def test_training_is_bounded(spark):
    docs = spark.range(200).select(F.col("id").alias("doc_id"), F.concat(F.lit("w "), F.col("id")).alias("text"))
    labels = docs.select("doc_id", (F.col("doc_id") % 2).cast("int").alias("quality"))
    model = Q.train(docs.union(docs), labels, F.lit(True), Q.Training(train_rows=20, trees=2))
    assert abs(model.prior) < 2
