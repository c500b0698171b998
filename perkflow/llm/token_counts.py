"""Token counts per text by a map-side two-tier lookup of pre-token lengths.

First tier: a compact table of the corpus's most frequent segments and their
token counts, encoded once by a small job and broadcast. It is found in one pass over all texts, in which each
task counts its own segments in bounded memory and hands on only its most
frequent ones; pre-tokens themselves are never shuffled. Second tier: segments
outside the table are encoded by the tokenizer library in batches and
remembered in a bounded cache of the Python worker. Which segments are in the
table decides only how fast a count is found, never the count.

Defined cases: null counts as the empty text (0 bytes, 0 tokens); special
strings of the tokenizer inside a text count as one token each, the library's
default; bytes that are not UTF-8 count as U+FFFD; repeated rows count alike;
very long texts are counted whole, in bounded parts; an empty table has an empty
table of segments and no rows; extra columns are ignored, whatever their names.
"""

from __future__ import annotations

import json
import os
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from perkflow.llm import units
from perkflow.llm.common import utf8
from perkflow.llm.segments import BoundedCache, parts, segments

#: Entries of the broadcast table; at most 48 characters each, so under 10 MB.
HEAD_ENTRIES = 32_768
#: Segments that one task may count at once, and hand on.
TASK_ENTRIES, TASK_HEAD = 200_000, 8_192
LONGEST = 48
#: Characters whose segments are looked up together.
_GROUP_CHARS = 1 << 21


def check_tokenizer(content: str) -> list[str]:
    """The special strings of a byte-level BPE tokenizer file; raises where segments would not be independent."""
    spec = json.loads(content)
    pre = spec.get("pre_tokenizer") or {}
    post = spec.get("post_processor")
    if (spec.get("normalizer") is not None or pre.get("type") != "ByteLevel" or pre.get("add_prefix_space")
            or not pre.get("use_regex", True) or post not in (None, {}) and post.get("type") != "ByteLevel"):
        raise ValueError("not a plain byte-level tokenizer: its segments are not independent")
    for t in spec.get("added_tokens", []):
        if t.get("single_word") or t.get("lstrip") or t.get("rstrip"):
            raise ValueError(f"added token {t['content']!r} depends on its surroundings")
    return [t["content"] for t in spec.get("added_tokens", [])]


def head_counts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """A task's most frequent segments with their counts (lossy once TASK_ENTRIES are held)."""
    hasher = units.Hasher()
    count: dict[bytes, int] = {}
    rest: Counter[str] = Counter()

    def trim(most: int) -> None:
        kept = {k: count[k] for k in sorted(count, key=count.__getitem__, reverse=True)[:most]}
        count.clear()
        count.update(kept)

    for batch in batches:
        texts = batch.column(0).to_pylist()
        plain = [units.is_plain(t) for t in texts]
        for t in (t for t, p in zip(texts, plain) if not p):
            for part in parts(t.decode("utf-8", "replace")):
                rest.update(segments(part))
                if len(rest) > TASK_ENTRIES:
                    rest = Counter(dict(rest.most_common(TASK_ENTRIES // 2)))
        for _, group in units.grouped([t for t, p in zip(texts, plain) if p]):
            raw, _ = units.laid_out(group)
            starts, ends = units.segments_at(raw)
            if not len(starts):
                continue
            one, number = units.distinct(raw, starts, ends, hasher)
            n = np.bincount(number)
            often = np.flatnonzero((n > 1) & (ends[one] - starts[one] <= LONGEST))  # once in a megabyte is not frequent
            data = raw.tobytes()
            at = one[often]
            for k, s, e in zip(n[often].tolist(), starts[at].tolist(), ends[at].tolist()):
                unit = data[s:e]
                count[unit] = count.get(unit, 0) + k
            if len(count) > TASK_ENTRIES:
                trim(TASK_ENTRIES // 2)
    trim(TASK_HEAD)
    for unit, n in count.items():
        rest[unit.decode()] += n
    top = [(s, n) for s, n in rest.most_common(TASK_HEAD) if len(s) <= LONGEST and n > 1]
    yield pa.RecordBatch.from_arrays([pa.array([s for s, _ in top], pa.string()),
                                      pa.array([n for _, n in top], pa.int64())], ["segment", "n"])


def frequent_segments(docs: DataFrame, text: str = "text", entries: int = HEAD_ENTRIES) -> list[str]:
    """The corpus's most frequent segments (a list of bounded length)."""
    heads = docs.select(utf8(text).alias("text")).mapInArrow(head_counts, "segment string, n bigint")
    total = heads.groupBy("segment").agg(F.sum("n").alias("n"))
    rows = total.orderBy(F.desc("n"), "segment").limit(entries).collect()
    return [r["segment"] for r in rows]


def _tokenizer(content: str):
    os.environ["TOKENIZERS_PARALLELISM"] = "false"
    from tokenizers import Tokenizer
    return Tokenizer.from_str(content)


def head_lengths(spark: SparkSession, content: str, head: list[str]) -> np.ndarray:
    """The token counts of the table's segments, each encoded once, in a few tasks."""
    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tokenizer = _tokenizer(content)
        for batch in batches:
            found = tokenizer.encode_batch(batch.column("segment").to_pylist(), add_special_tokens=False)
            yield pa.RecordBatch.from_arrays([batch.column("i"), pa.array([len(e) for e in found], pa.int32())], ["i", "n"])

    rows = spark.createDataFrame(list(enumerate(head)), "i int, segment string") \
        .mapInArrow(encode, "i int, n int").toArrow()
    out = np.zeros(len(head), np.int32)
    out[rows["i"].to_numpy()] = rows["n"].to_numpy()
    return out


_LOADED: dict[int, _Counter] = {}


class _Counter:
    """``lengths``: the token counts of ``head``, where they are known."""

    def __init__(self, content: str, head: list[str], lengths: list[int] | None = None):
        self.tokenizer = _tokenizer(content)
        lengths = self.encoded(head) if lengths is None else lengths
        special = check_tokenizer(content)
        self.special = regex.compile("|".join(map(regex.escape, sorted(special, key=len, reverse=True)))) \
            if special else None
        self.special_bytes = [x.encode() for x in special]
        self.hasher = units.Hasher()
        self.memory = units.Memory(lambda new: self.encoded([u.decode() for u in new]), 600_000,
                                   dict(zip([s.encode() for s in head], lengths)))
        self.lengths = BoundedCache(lambda u: self.encoded([u])[0], longest=LONGEST, limit=100_000,
                                    pinned=dict(zip(head, lengths)))

    def encoded(self, units: list[str]) -> list[int]:
        return [len(e) for e in self.tokenizer.encode_batch(units, add_special_tokens=False)]

    def counts(self, texts: list[bytes]) -> list[int]:
        """Token counts, group by group; texts that need the library's own cutting one by one."""
        out = [0] * len(texts)
        slow = [i for i, t in enumerate(texts) if not self.plain(t)]
        for i, n in zip(slow, self._slow([texts[i].decode("utf-8", "replace") for i in slow])):
            out[i] = n
        fast = [i for i, t in enumerate(texts) if self.plain(t)]
        for numbers, group in units.grouped([texts[i] for i in fast]):
            raw, behind = units.laid_out(group)
            starts, ends = units.segments_at(raw)
            if not len(starts):
                continue
            one, number = units.distinct(raw, starts, ends, self.hasher)
            lengths = np.array(self.memory.values(raw, starts[one], ends[one]), np.int64)[number]
            total = np.bincount(np.searchsorted(behind, starts, "right"), lengths, len(group))
            for i, n in zip(numbers, total.tolist()):
                out[fast[i]] = int(n)
        return out

    def plain(self, text: bytes) -> bool:
        """Whether the text's segments can be counted each by itself."""
        return units.is_plain(text) and not any(s in text for s in self.special_bytes)

    def _slow(self, texts: list[str]) -> list[int]:
        out = [0] * len(texts)
        held: list[tuple[int, list[str]]] = []
        size = 0
        for i, text in enumerate(texts):
            plain = self.special.split(text) if self.special else [text]
            out[i] = len(plain) - 1
            for part in (p for x in plain for p in parts(x)):
                held.append((i, segments(part)))
                size += len(part)
                if size > _GROUP_CHARS:
                    self._add(held, out)
                    held, size = [], 0
        self._add(held, out)
        return out

    def _add(self, held: list[tuple[int, list[str]]], out: list[int]) -> None:
        known = self.lengths
        missing = known.unknown(set().union(*(s for _, s in held)))
        for unit, n in zip(missing, self.encoded(missing)):
            known.keep(unit, n)
        look_up = known.__getitem__
        for i, own in held:
            out[i] += sum(map(look_up, own))


class TokenCounter:
    """Counts tokens of a byte-level tokenizer file. ``head``: see ``frequent_segments``."""

    def __init__(self, spark: SparkSession, tokenizer_path: str, head: list[str]):
        if len(head) > HEAD_ENTRIES or any(len(s) > LONGEST for s in head):
            raise ValueError("the table to broadcast is larger than its documented bound")
        with open(tokenizer_path, encoding="utf-8") as f:
            content = f.read()
        check_tokenizer(content)
        self.shared = spark.sparkContext.broadcast((content, head, head_lengths(spark, content, head)))

    def count(self, text: str | Column) -> Column:
        shared = self.shared

        @F.arrow_udf("bigint")
        def n_tokens(texts: pa.Array) -> pa.Array:
            content, head, lengths = shared.value
            key = hash((content, len(head), tuple(head[:64])))
            if key not in _LOADED:
                _LOADED.clear()
                _LOADED[key] = _Counter(content, head, lengths.tolist())
            return pa.array(_LOADED[key].counts(texts.to_pylist()), pa.int64())

        return n_tokens(utf8(text))
