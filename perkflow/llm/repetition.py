"""Quality rules: how much of a text lies inside repeated word n-grams and lines.

Words are the maximal runs of bytes outside ``\\x20\\x09-\\x0D``. For each n the
window hashes of a text are one polynomial combination of its word numbers,
computed for all windows at once; equal windows are found by sorting the
hashes and confirmed on the words themselves, so a hash collision cannot
change a result. An (n+1)-gram repeats only if its n-gram does, so a text
without a repeated window of one length skips all longer ones.

Everything is per document: no shuffle, memory bounded by the longest text.
Defined cases: a null or empty text has no words and fails the base rule;
repeated rows are judged alike; extra columns pass through untouched.
"""

from __future__ import annotations

from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from perkflow.llm.common import private_name, utf8

SYMBOLS = b"#*$%&|<>"
_IS_SYMBOL = np.zeros(256, bool)
_IS_SYMBOL[list(SYMBOLS)] = True
_IS_SPACE = np.zeros(256, bool)
_IS_SPACE[[0x20, *range(0x09, 0x0E)]] = True


@dataclass(frozen=True)
class Limits:
    """Verdict limits, in percent of the characters in words.

    ``ngram_chars``: largest share inside repeated n-grams, by n.
    ``line_chars``: largest share inside lines that repeat an earlier one.
    ``symbols``: most symbol characters per 100 word characters.
    """
    min_words: int = 10
    repeat_words: int = 20
    ngram_chars: dict[int, int] = field(default_factory=lambda: {5: 30, 6: 29, 7: 28, 8: 27, 9: 26, 10: 25})
    line_chars: int = 30
    symbols: int = 10


STATS = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "dup_line_chars")


def ngram_columns(limits: Limits) -> list[str]:
    return [f"dup_{n}gram_chars" for n in sorted(limits.ngram_chars)]


def word_numbers(words: list[bytes]) -> np.ndarray:
    """Each word as a dense number, equal words alike."""
    seen: dict[bytes, int] = {}
    number = seen.setdefault
    return np.fromiter((number(w, len(seen)) for w in words), np.int64, len(words))


def _mixed(numbers: np.ndarray) -> np.ndarray:
    """64-bit finaliser (multiply, xor-shift), so that neighbouring numbers do not line up."""
    x = (numbers.astype(np.uint64) + np.uint64(1)) * np.uint64(0x9E3779B97F4A7C15)
    x ^= x >> np.uint64(29)
    x *= np.uint64(0xBF58476D1CE4E5B9)
    return x ^ (x >> np.uint64(32))


def repeated_windows(numbers: np.ndarray, hashes: np.ndarray, n: int) -> np.ndarray:
    """Marks the windows of n words that occur at least twice. ``hashes``: the window hashes."""
    order = np.argsort(hashes, kind="stable")
    ranked = hashes[order]
    same = ranked[1:] == ranked[:-1]
    out = np.zeros(len(hashes), bool)
    if not same.any():
        return out
    a, b = order[:-1][same], order[1:][same]
    equal = np.ones(len(a), bool)
    for k in range(n):
        equal &= numbers[a + k] == numbers[b + k]
    if equal.all():
        out[a] = True
        out[b] = True
        return out
    # a collision of hashes: count the windows themselves
    windows = np.lib.stride_tricks.sliding_window_view(numbers, n)
    _, inverse, counts = np.unique(windows, axis=0, return_inverse=True, return_counts=True)
    return counts[inverse.reshape(-1)] > 1


def covered(starts: np.ndarray, n_words: int, n: int) -> np.ndarray:
    """Marks the words inside at least one marked window of n words."""
    edge = np.zeros(n_words + 1, np.int32)
    at = np.flatnonzero(starts)
    np.add.at(edge, at, 1)
    np.add.at(edge, at + n, -1)
    return np.cumsum(edge[:-1]) > 0


def text_stats(text: bytes, lengths: tuple[int, ...]) -> tuple[int, ...]:
    """STATS, then the characters inside repeated n-grams for each length."""
    raw = np.frombuffer(text, np.uint8)
    starts_char = (raw & 0xC0) != 0x80
    spaces = int(np.count_nonzero(_IS_SPACE[raw]))
    word_chars = int(np.count_nonzero(starts_char)) - spaces
    n_symbols = int(np.count_nonzero(_IS_SYMBOL[raw]))
    words = text.split()
    n_words = len(words)

    seen: set[bytes] = set()
    n_dup_lines = dup_line_chars = 0
    for line in text.split(b"\n"):
        if line.strip():
            if line in seen:
                n_dup_lines += 1
                dup_line_chars += sum(len(w.decode("utf-8", "replace")) for w in line.split())
            else:
                seen.add(line)

    n_repeat, chars = 0, [0] * len(lengths)
    if n_words > min(lengths):
        numbers = word_numbers(words)
        if int(numbers.max()) + 1 < n_words:  # some word occurs twice
            mixed = _mixed(numbers)
            word_len = None
            hashes, done = mixed.copy(), 1
            for i, n in enumerate(lengths):
                if n > n_words:
                    break
                while done < n:  # rolling: extend every window by one word
                    hashes = hashes[:-1] * np.uint64(0xD6E8FEB86659FD93) + mixed[done:]
                    done += 1
                windows = repeated_windows(numbers, hashes, n)
                if not windows.any():
                    break
                inside = covered(windows, n_words, n)
                if n == 5:
                    n_repeat = int(np.count_nonzero(inside))
                if word_len is None:
                    ends = np.concatenate(([0], np.cumsum(starts_char & ~_IS_SPACE[raw])))
                    edges = np.diff(np.concatenate(([1], _IS_SPACE[raw].astype(np.int8), [1])))
                    word_len = ends[np.flatnonzero(edges == 1)] - ends[np.flatnonzero(edges == -1)]
                chars[i] = int(word_len[inside].sum())
    return (n_words, word_chars, n_symbols, n_dup_lines, n_repeat, dup_line_chars, *chars)


def stats_column(text: str | Column, limits: Limits = Limits()) -> Column:
    """Struct of the text's statistics (longs)."""
    lengths = tuple(sorted(limits.ngram_chars))
    if 5 not in lengths:
        raise ValueError("ngram_chars needs length 5, which n_repeat_words is defined on")
    if min(lengths) != 5:
        raise ValueError("lengths below 5 are not supported: the early stop assumes 5 is the shortest")
    names = [*STATS, *ngram_columns(limits)]
    kind = ", ".join(f"{n}: bigint" for n in names)

    @F.arrow_udf(f"struct<{kind}>")
    def stats(texts: pa.Array) -> pa.Array:
        rows = [text_stats(t.as_py(), lengths) for t in texts]
        columns = zip(*rows) if rows else [()] * len(names)
        return pa.StructArray.from_arrays([pa.array(c, pa.int64()) for c in columns], names)

    return stats(utf8(text))


def with_verdict(docs: DataFrame, text: str = "text", limits: Limits = Limits(),
                 into: str = "repetition") -> DataFrame:
    """``docs`` plus one struct column: the statistics, ``base_failed`` and ``kept``."""
    tmp = private_name(docs, "_stats")
    out = docs.withColumn(tmp, stats_column(text, limits))
    s = F.col(tmp)
    base_failed = ((s["n_words"] < limits.min_words)
                   | (100 * s["n_repeat_words"] > limits.repeat_words * s["n_words"]))
    bad = ((100 * s["dup_line_chars"] > limits.line_chars * s["word_chars"])
           | (100 * s["n_symbols"] > limits.symbols * s["word_chars"]))
    for n, share in limits.ngram_chars.items():
        bad = bad | (100 * s[f"dup_{n}gram_chars"] > share * s["word_chars"])
    verdict = F.struct(*[s[n].alias(n) for n in [*STATS, *ngram_columns(limits)]],
                       base_failed.alias("base_failed"), (~(base_failed | bad)).alias("kept"))
    return out.withColumn(tmp, verdict).withColumnRenamed(tmp, into)
