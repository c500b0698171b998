import zlib

import numpy as np
import public_tokenizers as P
import pytest
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from perkflow.llm import packing as K

FILE = P.path("word_bpe_49k.json")


@pytest.fixture(scope="module")
def library():
    return Tokenizer.from_file(FILE)


def check_pieces(pieces, tokens: dict, window=4096):
    """Every id in exactly one piece, sequences gapless, little padding. ``tokens``: ids by document."""
    for doc, own in pieces.groupby("doc_id"):
        own = own.sort_values("start")
        ids = tokens[doc]
        assert (own.doc_tokens == len(ids)).all()
        assert own.start.tolist() == [0, *own.length.cumsum().tolist()[:-1]] and own.length.sum() == len(ids)
        for r in own.itertuples():
            part = np.asarray(ids[r.start:r.start + r.length], "<u4").tobytes()
            assert r.ids_crc32 == zlib.crc32(part) and r.length > 0
    assert set(pieces.doc_id) == set(tokens)
    padding = 0
    for _, own in pieces.groupby("sequence_id"):
        own = own.sort_values("offset")
        assert own.offset.tolist() == [0, *own.length.cumsum().tolist()[:-1]]
        total = own.length.sum()
        assert total <= window
        padding += 0 if total & (total - 1) == 0 else window - total
    assert padding == 0


def test_query_holds_every_id_once(results, library, duck):
    texts = dict(duck.execute("SELECT doc_id, coalesce(text, '') FROM documents").fetchall())
    tokens = {i: library.encode(t, add_special_tokens=False).ids + [2] for i, t in texts.items()}
    check_pieces(results("op5_bm25_packing"), tokens)


def test_words_equal_the_library(library):
    with open(FILE, encoding="utf-8") as f:
        worker = K._Words(f.read())
    worker.memory.half = worker.pieces.limit = 10
    texts = ["", "Σας ΣΑΣ ﬁ e\u0301 Å ½² ªº ʼn ŉ ß ẞ straße's ǅ <|endoftext|><|startoftext|>x <|x", "A" * 90 + "é" * 60, "It's  A<|endoftext|>test\x1cof\x85ÉtÉ é 12 34ab's'S ẞ İ 日本 🙂", "x" * 3_000, "a b " * 50]
    texts += ["Word. word, WORD!? it's it,'s don't. 12. 3), \"Hi\" é. é.) x.y. <|ENDOFTEXT|> <|endoftext|>. \u00bb, ",
              "a b\tc\nd\u00a0e \u2003 f ", " ", "word " * 300_000, "é" * 700_000 + " x"]
    got = [np.frombuffer(b, "<u2").tolist() for b in worker.encode([t.encode() for t in texts])]
    assert got == [library.encode(t, add_special_tokens=False).ids for t in texts]


def test_neighbours_are_ranked_by_bm25():
    rng = np.random.default_rng(5)
    how = K.Packing(query_tokens=1000, neighbours=1000)
    items = [K.Item(i, rng.integers(0, 40, rng.integers(1, 30)).astype("<u2"), 0, 0) for i in range(60)]
    idf = rng.random(50).astype(np.float32) + 0.1
    index = K.ShardIndex(items, idf, 12.0, how)
    index.unused[[3, 8]] = False
    for seed in (0, 17):
        brute = {}
        for i, x in enumerate(items):
            norm = how.k1 * (1 - how.b + how.b * len(x.tokens) / 12.0)
            tf = [(t, int((x.tokens == t).sum())) for t in set(items[seed].tokens.tolist())]
            brute[i] = sum(idf[t] * c * (how.k1 + 1) / (c + norm) for t, c in tf)
        want = sorted((i for i in brute if brute[i] > 0 and i not in (3, 8)), key=lambda i: (-brute[i], i))
        got = index.neighbours(seed)
        assert set(got) == set(want)
        assert np.allclose([brute[i] for i in got], [brute[i] for i in want], rtol=1e-4)


def test_windows_hold_related_documents():
    """Two vocabularies, interleaved: most windows should hold one of them."""
    rng = np.random.default_rng(1)
    out = {}
    packer = K.Packer(np.ones(1000, np.float32), 64.0, K.Packing(window=256, shard_tokens=20_000),
                      lambda item, n, seq, off: out.setdefault(seq, set()).add(item.key % 2))
    for i in range(1000):
        packer.add(i, (rng.integers(0, 400, 64) + 500 * (i % 2)).astype("<u2"))
    packer.close()
    assert sum(len(kinds) == 1 for kinds in out.values()) > 0.8 * len(out)


def test_edge_rows(spark, library):
    rows = [(1, None, "x"), (2, "", "x"), (3, "word " * 30_000, "x"), (4, "a b c", "x")] \
        + [(10 + i, "the same text again", "x") for i in range(40)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, start string")
    pieces = K.pack(docs, FILE, 2, how=K.Packing(window=1024, shard_tokens=3_000))
    got = pieces.withColumn("ids_crc32", F.crc32("ids")).toPandas()
    check_pieces(got, {i: library.encode(t or "", add_special_tokens=False).ids + [2] for i, t, _ in rows}, 1024)
    assert K.pack(docs.limit(0), FILE, 2).collect() == []
    twice = spark.createDataFrame([(None, "a"), (None, "a")], "doc_id string, text string")
    assert sorted(r["length"] for r in K.pack(twice, FILE, 2).collect()) in ([1, 1, 2], [2, 2], [1, 1, 1, 1])


def test_tokenizers_that_need_context_are_refused():
    with open(P.path("byte_bpe_50k.json"), encoding="utf-8") as f:
        with pytest.raises(ValueError):
            K.check_tokenizer(f.read())


def test_windows_go_on_with_the_seeds_neighbours():
    """More related documents than are ranked or looked up at a time: the window holds them alone."""
    out = {}
    packer = K.Packer(np.ones(1000, np.float32), 8.0, K.Packing(window=512, shard_tokens=8_000, neighbours=4, query_tokens=2),
                      lambda item, n, seq, off: out.setdefault(seq, set()).add(item.key % 10))
    for i in range(1000):   # ten kinds; two documents of a kind share few of its 20 tokens
        packer.add(i, (np.random.default_rng(i).permutation(20)[:8] + 20 * (i % 10)).astype("<u2"))
    packer.close()
    assert sum(len(kinds) <= 2 for kinds in out.values()) > 0.8 * len(out)  # the last windows take what is left


def test_related_documents_meet_in_a_shard(spark, library):
    """The rows of a kind are far apart in the table, and two large groups are copies."""
    words = ["apple pear plum cherry fig", "engine wheel brake clutch gear", "violin cello flute harp drum",
             "river lake ocean pond creek"]
    rows = [(i, " ".join(np.random.default_rng(i).choice(words[i % 4].split(), 30))) for i in range(1200)]
    rows += [(2000 + i, words[i % 2] + " copy") for i in range(800)]
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(8)
    how = K.Packing(window=256, shard_tokens=6_000)  # two shards a kind, about
    ids = K.tokenized(docs, FILE, 2, "doc_id", "text").where("ids IS NOT NULL").select("key", "ids").localCheckpoint()
    got = [(r["key"], np.frombuffer(r["ids"], "<u2")) for r in ids.collect()]
    n, held = sum(len(t) for _, t in got), np.bincount(np.concatenate([np.unique(t) for _, t in got]), minlength=49_500)
    idf = np.log1p((len(got) - held + 0.5) / (held + 0.5)).astype(np.float32)
    shared = spark.sparkContext.broadcast((idf, n / len(got)))
    size = {k: len(t) for k, t in got}
    shard = {r["key"]: r["shard"] for r in K.dealt(ids, shared, len(got), n, np.dtype("<u2"), how).collect()}
    tokens, kinds = {}, {}
    for key, s in shard.items():
        tokens[s] = tokens.get(s, 0) + size[key]
        kinds.setdefault(s, []).append(key % 4 if key < 2000 else key % 2)
    assert len(shard) == 2000 and max(tokens.values()) < 1.3 * how.shard_tokens
    purity = sum(max(k.count(x) for x in range(4)) for k in kinds.values()) / 2000
    assert purity > 0.8, purity     # dealt by chance: about a third


def test_wide_numbers_are_sorted_by_the_unstable_sort(monkeypatch):
    """A stable sort of 64-bit numbers takes several times as long, and equal numbers cannot be told apart."""
    from perkflow.llm import packing
    sort, kinds = np.sort, []

    def noted(x, kind=None):
        kinds.append((x.dtype.itemsize, kind))
        return sort(x, kind=kind)

    monkeypatch.setattr(packing.np, "sort", noted)
    for kind in ("<u2", "<u4", "<i8"):
        x = np.random.default_rng(3).integers(0, 500, 2000).astype(kind)
        values, counts = packing.distinct(x)
        want = np.unique(x, return_counts=True)
        assert np.array_equal(values, want[0]) and np.array_equal(counts, want[1])
    assert kinds[0] == (2, "stable") and all(k != "stable" for size, k in kinds if size > 2)


def test_marks_are_cut_as_by_a_plain_loop_and_only_ascii_letters_are_lowered():
    from perkflow.llm import units
    text = "A. b!? c .. 7) é. x.y. (z) \"q\" ... .a end.".encode() + b"\xff" + b"Z, \xff?"
    raw = np.frombuffer(text, np.uint8)
    starts, ends = units.words_at(raw)
    want = []
    for a, b in zip(starts.tolist(), ends.tolist()):
        e = b
        while e > a and text[e - 1:e] in [bytes([x]) for x in b'.,;:!?)"']:
            e -= 1
        cut = a < e < b and text[e - 1:e].isalnum()
        want += [(a, e), (e, b)] if cut else [(a, b)]
    got = units.split_marks(raw, starts, ends)
    assert list(zip(got[0].tolist(), got[1].tolist())) == want
    every = np.arange(256, dtype=np.uint8)
    assert units.lowered(every).tolist() == [x + 32 if 65 <= x <= 90 else x for x in range(256)]


def test_pieces_go_to_the_model_in_the_letters_of_their_bytes(library):
    import json
    from tokenizers.pre_tokenizers import ByteLevel
    assert sorted(K.LETTERS.values()) == sorted(ByteLevel.alphabet()) and sorted(K.LETTERS) == list(range(256))
    with open(FILE, encoding="utf-8") as f:
        content = f.read()
    texts = ["ÀÉß ŉ naïve \x00x a­b x\x7f İI ªº 7é", "Plain words, plain."]
    worker = K._Words(content)
    worker.tokenizer = None     # plain words need the model only
    got = [np.frombuffer(b, "<u2").tolist() for b in worker.encode([t.encode() for t in texts])]
    assert got == [library.encode(t, add_special_tokens=False).ids for t in texts]
    spec = json.loads(content)
    spec["pre_tokenizer"]["pretokenizers"][1]["use_regex"] = True
    other = json.dumps(spec)
    got = [np.frombuffer(b, "<u2").tolist() for b in K._Words(other).encode([t.encode() for t in texts])]
    assert got == [Tokenizer.from_str(other).encode(t, add_special_tokens=False).ids for t in texts]


def test_distinct_tokens_of_many_documents_at_once():
    rng = np.random.default_rng(8)
    docs = [rng.integers(0, 30, rng.integers(1, 50)).astype("<u2") for _ in range(40)]
    owner, terms, counts = K.distinct_of_each(docs, 30)
    for i, d in enumerate(docs):
        want, n = np.unique(d, return_counts=True)
        assert terms[owner == i].tolist() == want.tolist() and counts[owner == i].tolist() == n.tolist()


def test_a_worker_remembers_words_in_few_bytes():
    """What a worker holds outlives its task, and adds up over an executor's workers and a pipeline's stages."""
    import tracemalloc
    with open(FILE, encoding="utf-8") as f:
        worker = K._Words(f.read())
    letters = np.array(list("abcdefghijklmnop"))
    words = np.unique(["".join(w) for w in letters[np.random.default_rng(6).integers(0, 16, (60_000, 9))]]).tolist()
    worker.encode([b"a"])
    tracemalloc.start()
    worker.encode([" ".join(words[i:i + 2_000]).encode() for i in range(0, len(words), 2_000)])
    held = tracemalloc.get_traced_memory()[0]
    tracemalloc.stop()
    assert held < 100 * len(words), held / len(words)


def test_tokenizing_holds_few_rows_at_a_time(spark, monkeypatch):
    monkeypatch.setattr(K, "_BATCH_ROWS", 3)
    docs = spark.createDataFrame([(i, f"word{i} and more") for i in range(20)], "doc_id long, text string").coalesce(1)
    rows = K.tokenized(docs, FILE, 2, "doc_id", "text").collect()
    assert sorted(r["key"] for r in rows if r["ids"] is not None) == list(range(20))
    totals = [dict(zip(r["terms"], r["n"])) for r in rows if r["terms"] is not None]
    assert len(totals) == 1 and totals[0][K.N_DOCS] == 20
