import hashlib
import random

import numpy as np
import public_tokenizers as P
import pytest
import tiktoken

from perkflow.llm.bpe import Bpe, Merger, Vocabulary, parse_ranks
from perkflow.llm.segments import parts, segments
from tests.llm.conftest import SF


@pytest.fixture(scope="module")
def ranks():
    with open(P.path("byte_bpe_50k.tiktoken"), "rb") as f:
        return parse_ranks(f.read())


@pytest.fixture(scope="module")
def library(ranks):
    return tiktoken.Encoding("own", pat_str=P.PATTERN, mergeable_ranks=ranks, special_tokens={})


def test_equals_library_on_odd_texts(ranks, library):
    v = Vocabulary(ranks, P.PATTERN)
    rng = random.Random(1)
    letters = "ab cé\n\t \x1c\x85'sS1٣.!,;)\"<|endoftext|>ünd  aaaaaaa日本🙂"
    for _ in range(400):
        t = "".join(rng.choice(letters) for _ in range(rng.randrange(0, 200)))
        ids = np.frombuffer(v.encode(t), np.int32)
        assert ids.tolist() == library.encode_ordinary(t)
        assert v.encode_all([t.encode()]) == [ids.tobytes()]
        assert v.decode(ids) == t.encode()


def test_long_pre_token(ranks, library):
    t = "abcdefghij" * 20_000 + "aaaa" * 20_000
    assert Merger(ranks)(t.encode()) == library.encode_ordinary(t)


def test_parts_keep_segments():
    t = "the  qui \n\n é,x " * 5_000 + "\t" * 3_000 + "z" * 3_000
    assert "".join(parts(t, 1_000)) == t
    assert [s for p in parts(t, 1_000) for s in segments(p)] == segments(t)


def test_query_equals_library(results, library, duck):
    texts = dict(duck.execute("SELECT doc_id, text FROM documents").fetchall())
    got = results("op3_bpe_round_trip")
    assert len(got) == len(texts)
    for r in got.itertuples():
        ids = library.encode_ordinary(texts[r.doc_id] or "")
        assert r.n_tokens == len(ids)
        assert r.ids_sha256 == hashlib.sha256(" ".join(map(str, ids)).encode()).hexdigest()
        assert r.decoded_sha256 == hashlib.sha256((texts[r.doc_id] or "").encode()).hexdigest()


def test_edge_rows(spark):
    bpe = Bpe(spark, P.path("byte_bpe_50k.tiktoken"), P.PATTERN)
    docs = spark.createDataFrame([(1, None), (2, ""), (2, ""), (3, "x" * 300_000)], "ids long, text string")
    out = docs.select("ids", bpe.encode("text").alias("n")).select("ids", "n", bpe.decode("n").alias("back"))
    rows = sorted(out.collect(), key=lambda r: (r["ids"], len(r["back"])))
    assert [bytes(r["back"]) for r in rows] == [b"", b"", b"", b"x" * 300_000]
    assert [len(r["n"]) for r in rows][:3] == [0, 0, 0]
    assert out.limit(0).collect() == []
    plan = out._jdf.queryExecution().executedPlan().toString()
    assert plan.count("encode_texts(") == 1, plan


def test_small_cache_changes_nothing(ranks, library):
    v = Vocabulary(ranks, P.PATTERN)
    v.pieces.limit = v.memory.half = 6
    t = "one two, three two. one's 4 five! one two\n\n  three " * 20
    texts = [t, "", " ", t[:77], "\u00a0 x", "a" * (2 << 20)]
    got = v.encode_all([x.encode() for x in texts])
    assert [np.frombuffer(g, np.int32).tolist() for g in got] == [library.encode_ordinary(x) for x in texts]


def test_digests_in_one_place_equal_those_of_encode_and_decode(spark):
    from pyspark.sql import functions as F
    bpe = Bpe(spark, P.path("byte_bpe_50k.tiktoken"), P.PATTERN)
    rows = [(1, None), (2, ""), (3, "one two one"), (3, "one two one"), (4, "x" * 40_000 + " y" * 300_000), (5, "日本 é\n")]
    docs = spark.createDataFrame(rows, "done long, text string")
    plain = docs.select("done", bpe.encode("text").alias("n")).select(
        "done", F.size("n").cast("long").alias("n_tokens"),
        F.sha2(F.concat_ws(" ", F.col("n").cast("array<string>")), 256).alias("ids_sha256"),
        F.sha2(bpe.decode("n"), 256).alias("decoded_sha256"))
    at_once = docs.select("done", bpe.round_trip("text").alias("r")).select("done", "r.*")
    assert sorted(map(tuple, at_once.collect())) == sorted(map(tuple, plain.collect()))
    assert docs.limit(0).select(bpe.round_trip("text")).collect() == []


def test_pre_tokens_share_a_queue(ranks, library):
    rng = random.Random(3)
    syllables = ["th", "in", "er", "é", "ß", "o", "日", " ", "aaa", "\x00", "X9"]
    pieces = ["".join(rng.choice(syllables) for _ in range(rng.randrange(1, 12))).encode() for _ in range(3_000)]
    pieces += [b"the", b"a" * 1_000, ("ab" * 3_000).encode(), "ñ".encode(), b"\x00"]
    merger = Merger(ranks)
    got = [np.frombuffer(x, "<i4").tolist() for x in merger.many(pieces)]
    assert got == [library._core_bpe.encode_single_piece(p) for p in pieces]
    assert merger.many([]) == []
    assert not any(merger.words) and not any(b is not None for b in merger.buckets)


def test_a_merge_that_makes_a_lower_rank_comes_first():
    tokens = [bytes([b]) for b in range(256)] + [b"abc", b"xab", b"ab", b"bc", b"cab"]
    made = {t: i for i, t in enumerate(tokens)}
    merger, rng = Merger(made), random.Random(4)
    pieces = ["".join(rng.choice("abcx") for _ in range(rng.randrange(2, 40))).encode() for _ in range(500)]
    assert [np.frombuffer(x, "<i4").tolist() for x in merger.many(pieces)] == [merger(p) for p in pieces]


def test_units_of_one_hash_keep_their_own_ids():
    from perkflow.llm import units
    memory = units.IdMemory(lambda new: [np.frombuffer(u, np.uint8).astype("<u2").tobytes() for u in new], 6,
                            np.dtype("<u2"), lambda raw, starts, ends: (ends - starts).astype(np.uint64))
    texts = [b"ab ba ab cd", b"ba", b"", b"abc cba cd ab " * 3, b"a" * 3_000 + b" " + b"b" * 3_000]
    for _ in range(3):
        got = units.encoded(texts, units.words_at, memory)
        assert [np.frombuffer(x, "<u2").astype(np.uint8).tobytes() for x in got] == [t.replace(b" ", b"") for t in texts]
