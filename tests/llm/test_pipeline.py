import numpy as np
import public_tokenizers as P
import pytest
from pyspark.sql import functions as F
from tokenizers import Tokenizer

import corpus_pipeline as C
from perkflow.llm import quality_model, repetition
from perkflow.llm.common import save
from perkflow.llm.queries import quality_trees
from tests.llm.conftest import SF
from tests.llm.test_minhash import brute
from tests.llm.test_packing import check_pieces


@pytest.fixture(scope="module")
def stages(spark):
    """Each stage's rows over sf0.01, every stage written and read again."""
    docs, out = spark.read.parquet(f"{SF}/documents.parquet"), {}
    out["documents"] = docs.toPandas()
    for name, stage in C.STAGES:
        docs = save(stage(spark, docs, SF), f"test-{name}")
        out[name] = docs.toPandas()
    return out


def texts(frame):
    return dict(zip(frame.doc_id, frame.text))


def test_names_and_columns(stages):
    assert [n for n, _ in C.STAGES] == ["quality_rules", "quality_classifier", "near_dedup", "packing"]
    for name, _ in C.STAGES[:-1]:
        assert list(stages[name].columns) == list(stages["documents"].columns)


def test_rules(stages):
    def kept(text):
        n_words, chars, symbols, _, repeat, line_chars, *grams = repetition.text_stats(text.encode(), (5, 6, 7, 8, 9, 10))
        return not (n_words < 10 or 100 * repeat > 20 * n_words or 100 * line_chars > 30 * chars
                    or 100 * symbols > 10 * chars
                    or any(100 * g > share * chars for g, share in zip(grams, (30, 29, 28, 27, 26, 25))))
    want = {i for i, t in texts(stages["documents"]).items() if kept(t)}
    assert set(stages["quality_rules"].doc_id) == want and 0 < len(want) < len(stages["documents"])


def test_classifier(spark, stages):
    trees = quality_trees(spark, SF)
    before = texts(stages["quality_rules"])
    x = np.array([quality_model.statistics(t.encode()) for t in before.values()])
    want = {i for i, s in zip(before, trees.scores(x)) if s >= 0.3}
    assert set(stages["quality_classifier"].doc_id) == want


def test_near_dedup(stages):
    roots = brute(texts(stages["quality_classifier"]), 5)
    assert sorted(stages["near_dedup"].doc_id) == sorted(i for i, r in roots.items() if i == r)
    assert len(stages["near_dedup"]) < len(stages["quality_classifier"])


def test_packing(stages):
    library = Tokenizer.from_file(P.path("word_bpe_49k.json"))
    check_pieces(stages["packing"], {i: library.encode(t, add_special_tokens=False).ids + [2]
                                     for i, t in texts(stages["near_dedup"]).items()})


def test_run_packs_what_the_stages_keep(spark, stages):
    got = C.run(spark, SF).groupBy("doc_id").agg(F.sum("length").alias("n")).toPandas()
    want = stages["packing"].groupby("doc_id").length.sum()
    assert dict(zip(got.doc_id, got.n)) == want.to_dict()


def test_clean_labelled_documents_stay(stages, duck):
    """Of the labelled clean documents the filtering stages lose hardly any."""
    clean = {i for (i,) in duck.execute("SELECT doc_id FROM labels WHERE quality = 1").fetchall()}
    for before, after in (("documents", "quality_rules"), ("quality_rules", "quality_classifier")):
        had = clean & set(stages[before].doc_id)
        assert len(had & set(stages[after].doc_id)) >= 0.95 * len(had)


def test_edge_rows(spark):
    long = " ".join(f"word{i}" for i in range(20_000)) + "."
    rows = [(1, None), (2, ""), (3, long), (3, long), (4, long + " more"), (None, "This is a fine text. " * 2),
            (5, "junk $$$ " * 40)]
    docs = spark.createDataFrame([(i, t, "en", None, 0) for i, t in rows],
                                 "doc_id long, text string, lang string, _repetition string, n_chars long")
    for name, stage in C.STAGES:
        out = stage(spark, docs, SF)
        assert name == "packing" or out.columns == docs.columns
        assert stage(spark, docs.limit(0), SF).collect() == []
        out.collect()
    assert sorted(r["doc_id"] or 0 for r in C.near_dedup(spark, docs, SF).collect()) == [0, 1, 2, 3, 5]
