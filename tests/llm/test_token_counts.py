import public_tokenizers as P
import pytest
from tokenizers import Tokenizer

from perkflow.llm.token_counts import TokenCounter, _Counter, check_tokenizer, frequent_segments

FILE = P.path("byte_bpe_50k.json")


@pytest.fixture(scope="module")
def library():
    return Tokenizer.from_file(FILE)


def test_query_equals_library(results, library, duck):
    texts = dict(duck.execute("SELECT doc_id, coalesce(text, '') FROM documents").fetchall())
    got = results("op9_token_counts")
    assert len(got) == len(texts)
    for r in got.itertuples():
        n = len(library.encode(texts[r.doc_id], add_special_tokens=False).ids)
        assert (r.n_tokens, r.n_bytes, r.over_limit) == (n, len(texts[r.doc_id].encode()), n > 1024)


def test_special_strings_and_small_cache(library):
    with open(FILE, encoding="utf-8") as f:
        counter = _Counter(f.read(), ["the", " of"])
    counter.lengths.limit = counter.memory.half = 5
    texts = ["", "<|endoftext|>", " <|endoftext|> a<|endoftext|><|endoftext|>b", "<|endof text|>",
             "the of the\n\n  x\x1c\x85 y  ", "é" * 500 + " 日本 🙂", "a\n \u00a0b", "\n", " ", "a \n b\n\n", "\r\n  x \x0b\x0cy", "  end  "] * 2
    assert counter.counts([t.encode() for t in texts]) == [len(library.encode(t, add_special_tokens=False).ids) for t in texts]


def test_edge_rows(spark):
    docs = spark.createDataFrame([(1, None), (1, None), (2, ""), (3, "of " * 200_000)], "n long, text string")
    counter = TokenCounter(spark, FILE, frequent_segments(docs))
    got = sorted((r["n"], r["c"]) for r in docs.select("n", counter.count("text").alias("c")).collect())
    assert got[:3] == [(1, 0), (1, 0), (2, 0)] and got[3][1] > 200_000 - 1
    empty = docs.limit(0)
    assert frequent_segments(empty) == []
    assert empty.select(counter.count("text")).collect() == []


def test_other_tokenizers_are_refused():
    with open(P.path("word_bpe_49k.json"), encoding="utf-8") as f:
        with pytest.raises(ValueError):
            check_tokenizer(f.read())


def cut_marks(segment: str) -> list[str]:
    """Marks behind an ASCII letter or digit at the end are a unit of their own."""
    word = segment.rstrip('.,;:!?)"')
    return [word, segment[len(word):]] if word != segment and word[-1:].isascii() and word[-1:].isalnum() else [segment]


def test_segments_found_on_bytes_equal_the_pattern():
    import random

    from perkflow.llm import units
    from perkflow.llm.segments import segments
    rng = random.Random(3)
    texts = ["".join(rng.choice("ab é\n\t \x0b\x1c.,'日  ") for _ in range(rng.randrange(0, 30))) for _ in range(400)]
    raw, behind = units.laid_out([t.encode() for t in texts])
    starts, ends = units.segments_at(raw)
    data = raw.tobytes()
    import numpy as np
    found = {}
    for text, s, e in sorted(zip(np.searchsorted(behind, starts, "right").tolist(), starts.tolist(), ends.tolist())):
        found.setdefault(text, []).append(data[s:e].decode())
    for i, t in enumerate(texts):
        assert "".join(found.get(i, [])) == t
        want = [c for s in segments(t) for c in cut_marks(s)]
        assert found.get(i, []) == want
    hashes = units.Hasher()(raw, starts, ends)
    by_hash = {}
    for h, s, e in zip(hashes.tolist(), starts.tolist(), ends.tolist()):
        assert by_hash.setdefault(h, data[s:e]) == data[s:e]
    assert len(by_hash) == len({data[s:e] for s, e in zip(starts.tolist(), ends.tolist())})


def thue_morse(n: int) -> tuple[str, str]:
    """A word and its complement that a polynomial hash modulo a power of two cannot tell apart."""
    word = "".join("ab"[i.bit_count() % 2] for i in range(n))
    return word, word.translate(str.maketrans("ab", "ba"))


@pytest.mark.parametrize("n", [128, 256, 1024, 4096])
def test_units_of_one_hash_are_told_apart(n, library):
    import numpy as np
    import tiktoken

    from perkflow.llm import units
    from perkflow.llm.bpe import Vocabulary, parse_ranks
    from perkflow.llm.packing import _Words
    a, b = thue_morse(n)
    raw, _ = units.laid_out([a.encode(), b.encode()])
    starts, ends = units.words_at(raw)
    assert n < 1024 or len(set(units.Hasher()(raw, starts, ends).tolist())) == 1
    batches = [[f"{a} {b} {a}", b], [a], [f"x {b}", f"{b} {a}"]]
    with open(P.path("byte_bpe_50k.tiktoken"), "rb") as f:
        ranks = parse_ranks(f.read())
    other = tiktoken.Encoding("own", pat_str=P.PATTERN, mergeable_ranks=ranks, special_tokens={})
    words_library = Tokenizer.from_file(P.path("word_bpe_49k.json"))
    with open(FILE, encoding="utf-8") as f:
        counter = _Counter(f.read(), [])
    with open(P.path("word_bpe_49k.json"), encoding="utf-8") as f:
        words = _Words(f.read())
    vocabulary = Vocabulary(ranks, P.PATTERN)
    for texts in batches:
        data = [t.encode() for t in texts]
        assert counter.counts(data) == [len(library.encode(t, add_special_tokens=False).ids) for t in texts]
        assert [np.frombuffer(x, np.int32).tolist() for x in vocabulary.encode_all(data)] == \
            [other.encode_ordinary(t) for t in texts]
        assert [np.frombuffer(x, words.kind).tolist() for x in words.encode(data)] == \
            [words_library.encode(t, add_special_tokens=False).ids for t in texts]


def test_a_hash_that_tells_nothing_changes_nothing():
    import random

    import numpy as np

    from perkflow.llm import units
    rng = random.Random(6)
    texts = [" ".join(rng.choice(["a", "ab", "x" * 8, "x" * 9, "x" * 8 + "y", "w" * 70, "w" * 69 + "v", "q" * 64])
                      for _ in range(40)).encode() for _ in range(9)]
    raw, _ = units.laid_out(texts)
    starts, ends = units.words_at(raw)
    one, number = units.distinct(raw, starts, ends, lambda r, s, e: np.zeros(len(s), np.uint64))
    data = raw.tobytes()
    all_units = [data[s:e] for s, e in zip(starts.tolist(), ends.tolist())]
    assert [all_units[one[k]] for k in number.tolist()] == all_units
    assert len(one) == len(set(all_units))


def test_the_table_is_broadcast_with_its_lengths(spark, library):
    docs = spark.createDataFrame([("the cat the cat the dogs",)] * 3, "text string")
    counter = TokenCounter(spark, FILE, frequent_segments(docs))
    _, head, lengths = counter.shared.value
    assert head and lengths.tolist() == [len(library.encode(s, add_special_tokens=False).ids) for s in head]
