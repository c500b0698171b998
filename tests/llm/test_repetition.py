from collections import Counter

import pytest
from hypothesis import given, settings, strategies as st

from perkflow.llm import repetition as R

LENGTHS = (5, 6, 7, 8, 9, 10)


def brute(text: bytes):
    words = text.split()
    chars = [len(w.decode()) for w in words]
    out = []
    for n in LENGTHS:
        windows = [tuple(words[i:i + n]) for i in range(len(words) - n + 1)]
        count = Counter(windows)
        inside = {i + k for i, w in enumerate(windows) if count[w] > 1 for k in range(n)}
        out.append((len(inside), sum(chars[i] for i in inside)))
    seen, dup = set(), 0
    for line in text.split(b"\n"):
        if line.split():
            dup += line in seen
            seen.add(line)
    return len(words), sum(chars), sum(chr(c) in "#*$%&|<>" for c in text), dup, out


@settings(max_examples=200, deadline=None)
@given(st.lists(st.sampled_from(["a", "b", "é#", "the", "\n", "x|y", "\t"]), max_size=60))
def test_statistics_equal_brute_force(pieces):
    text = " ".join(pieces).encode()
    got = R.text_stats(text, LENGTHS)
    n_words, chars, symbols, dup, windows = brute(text)
    assert got[:5] == (n_words, chars, symbols, dup, windows[0][0])
    assert got[6:] == tuple(c for _, c in windows)


def test_hash_collisions_do_not_count():
    import numpy as np
    numbers = np.arange(12)
    same = np.zeros(8, np.uint64)  # every window hash collides
    assert not R.repeated_windows(numbers, same, 5).any()


def test_query_matches_sql(matches_sql):
    matches_sql("op2_repetition_rules")


def test_edge_rows(spark):
    rows = [(1, None, 9), (2, "", 9), (2, "", 9), (None, "one two", 9), (5, "w " * 300_000, 9),
            (6, " ".join(f"w{i}" for i in range(50_000)), 9), (7, "a \x0b b\x1cc\x85d " * 3, 9)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, n_words int")
    out = R.with_verdict(docs).collect()
    assert len(out) == 7 and all(r["n_words"] == 9 for r in out)
    got = {(r["doc_id"], r["repetition"]["n_words"], r["repetition"]["kept"]) for r in out}
    assert got == {(1, 0, False), (2, 0, False), (None, 2, False), (5, 300_000, False),
                   (6, 50_000, True), (7, 6, False)}
    assert R.with_verdict(docs.limit(0)).collect() == []


def test_lengths_are_checked():
    with pytest.raises(ValueError):
        R.stats_column("text", R.Limits(ngram_chars={3: 10}))
