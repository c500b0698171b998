"""Byte-level BPE encoding and decoding from a file of merge ranks.

Encoding one pre-token keeps its symbols in a linked list and every adjacent
pair that is in the vocabulary in a queue with one bucket per merge rank. A
two-level bitmap over the ranks marks the buckets in use; find-first-set on its
two words gives the lowest rank, the bucket's heap the leftmost position.
Merging changes at most two pairs, whose earlier entries stay queued and are
skipped when they surface (stale). n bytes cost O(n log n), however long the
pre-token. Short pre-tokens share a list and a queue, so that a bucket is taken
once for all of them.

Defined cases: a null or empty text encodes to an empty list; bytes that are
not UTF-8 count as U+FFFD; decoding ids outside the vocabulary raises; repeated
rows are encoded alike; an empty table gives no rows; extra columns are ignored,
whatever their names. Very long texts are handled in bounded parts, so memory
follows the longest text. No shuffle.
"""

from __future__ import annotations

import base64
import hashlib
from heapq import heappop, heappush
from struct import pack

import numpy as np
import pyarrow as pa
import regex
from pyspark import Broadcast
from pyspark.sql import Column, SparkSession
from pyspark.sql import functions as F

from perkflow.llm import units
from perkflow.llm.common import utf8
from perkflow.llm.segments import BoundedCache, parts

class Merger:
    """Merges the bytes of pre-tokens by rank.

    The queue outlives a call, because it is empty again after one: a bucket
    for every rank, holding one position or a heap of them, and a bitmap of the
    buckets in use in words of 256 ranks.
    """

    #: Up to so many bytes a pre-token shares a queue with others, of so many bytes together.
    SHORT, TOGETHER = 1024, 1 << 15

    def __init__(self, ranks: dict[bytes, int]):
        self.ranks = ranks
        n = max(ranks.values()) + 1
        self.buckets: list[None | int | list[int]] = [None] * n
        self.first_pairs = [-1] * 65_536    # rank of two bytes, by their values
        for token, rank in ranks.items():
            if len(token) == 2:
                self.first_pairs[token[0] << 8 | token[1]] = rank
        self.single = [ranks.get(bytes([b]), -1) for b in range(256)]
        self.words = [0] * (n // 256 + 1)
        self.bit = [1 << i for i in range(max(256, len(self.words)))]
        # what can occur inside UTF-8, for pre-tokens with a gap between them
        self.inner = {token: rank for token, rank in ranks.items() if units.GAP not in token}
        self.inner_pairs = np.array(self.first_pairs, np.int32)
        self.inner_pairs[units.GAP << 8:] = self.inner_pairs[units.GAP::256] = -1
        self.inner_single = np.array(self.single, np.int32)
        self.inner_single[units.GAP] = -2

    def __call__(self, piece: bytes) -> list[int]:
        """The ids of one pre-token: the lowest-ranked, then leftmost pair is merged next, again and again."""
        rank_of = self.ranks.get
        whole = rank_of(piece)
        if whole is not None:
            return [whole]
        buckets, words, bit = self.buckets, self.words, self.bit
        n = len(piece)
        end = list(range(1, n + 1))         # of the symbol that starts at a position
        before = list(range(-1, n - 1))     # start of the symbol to the left
        table = self.first_pairs
        pair = [table[a << 8 | b] for a, b in zip(piece, piece[1:])]    # rank of the pair starting here
        pair.append(-1)
        symbol = [self.single[b] for b in piece]    # id of the symbol that starts here
        summary = 0                         # upper level of the bitmap: words with a bit set
        changed = range(n - 1)
        while True:
            for i in changed:
                rank = pair[i]
                if rank < 0:
                    continue
                bucket = buckets[rank]
                if bucket is None:
                    buckets[rank] = i
                    w = rank >> 8
                    words[w] |= bit[rank & 255]
                    summary |= bit[w]
                elif bucket.__class__ is int:
                    buckets[rank] = [bucket, i] if bucket < i else [i, bucket]
                else:
                    heappush(bucket, i)
            while summary:
                w = (summary & -summary).bit_length() - 1
                bits = words[w]
                rank = (w << 8) + (bits & -bits).bit_length() - 1
                bucket = buckets[rank]
                if bucket.__class__ is int:
                    i = bucket
                    buckets[rank] = None
                    words[w] = bits = bits & bits - 1
                    if not bits:
                        summary &= summary - 1
                else:
                    i = heappop(bucket)
                    if len(bucket) == 1:
                        buckets[rank] = bucket[0]
                if pair[i] == rank:
                    break                   # else stale: this pair was merged or changed since
            else:
                break
            j = end[i]
            end[i] = k = end[j]
            symbol[i] = rank
            pair[j] = -1
            if k < n:
                before[k] = i
                pair[i] = rank_of(piece[i:end[k]], -1)
            else:
                pair[i] = -1
            h = before[i]
            if h >= 0:
                pair[h] = rank_of(piece[h:k], -1)
                changed = (h, i)
            else:
                changed = (i,)
        out, i = [], 0
        while i < n:
            out.append(symbol[i])
            i = end[i]
        return out

    def many(self, pieces: list[bytes]) -> list[bytes]:
        """The ids of each pre-token (UTF-8) as little-endian 32-bit integers; short ones share a queue."""
        whole = list(map(self.ranks.get, pieces))
        out = [b"" if rank is None else pack("<i", rank) for rank in whole]
        some, size = [], 0
        for i, piece in enumerate(pieces):
            if whole[i] is not None:
                continue
            if len(piece) > self.SHORT:
                ids = self(piece)
                out[i] = pack(f"<{len(ids)}i", *ids)
                continue
            some.append(i)
            size += len(piece)
            if size > self.TOGETHER:
                self._fill(pieces, some, out)
                some, size = [], 0
        self._fill(pieces, some, out)
        return out

    def _fill(self, pieces: list[bytes], some: list[int], out: list[bytes]) -> None:
        if some:
            ids, edges = self._together([pieces[i] for i in some])
            raw, edges = ids.tobytes(), (edges * 4).tolist()
            for i, a, b in zip(some, edges, edges[1:]):
                out[i] = raw[a:b]

    def _together(self, pieces: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        """The ids of all pre-tokens end to end, and where each one's begin.

        The pre-tokens lie in one list with a byte between them that no pair
        crosses. A bucket is taken as a whole and its positions are merged from
        left to right, unless a merge makes a pair of a lower rank: that is next.
        """
        text = b"\xff".join([b"", *pieces, b""])
        raw = np.frombuffer(text, np.uint8)
        rank_of, buckets, words, bit = self.inner.get, self.buckets, self.words, self.bit
        ranks = np.append(self.inner_pairs[raw[:-1].astype(np.int32) << 8 | raw[1:]], -1)
        end, before = list(range(1, len(text) + 1)), list(range(-1, len(text) - 1))
        symbol, pair = self.inner_single[raw].tolist(), ranks.tolist()
        summary = 0
        order = np.flatnonzero(ranks >= 0)
        order = order[np.argsort(ranks[order], kind="stable")]
        starts = np.flatnonzero(np.diff(ranks[order], prepend=-1))
        queued = order.tolist()
        for rank, a, b in zip(ranks[order[starts]].tolist(), starts.tolist(), [*starts[1:].tolist(), len(queued)]):
            buckets[rank] = queued[a:b]
            words[rank >> 8] |= bit[rank & 255]
            summary |= bit[rank >> 8]
        while summary:
            w = (summary & -summary).bit_length() - 1
            bits = words[w]
            rank = (w << 8) + (bits & -bits).bit_length() - 1
            words[w] = bits = bits & bits - 1
            if not bits:
                summary &= summary - 1
            bucket = buckets[rank]
            buckets[rank] = None
            bucket.sort()
            n = 0
            for i in bucket:
                n += 1
                if pair[i] != rank:
                    continue                # stale: this pair was merged or changed since
                j = end[i]
                end[i] = k = end[j]
                symbol[i] = rank
                symbol[j] = -2
                pair[j] = -1
                before[k] = i
                h = before[i]
                pair[i] = right = rank_of(text[i:end[k]], -1)
                pair[h] = left = rank_of(text[h:k], -1)
                if right >= 0:
                    if buckets[right] is None:
                        buckets[right] = [i]
                        words[right >> 8] |= bit[right & 255]
                        summary |= bit[right >> 8]
                    else:
                        buckets[right].append(i)
                if left >= 0:
                    if buckets[left] is None:
                        buckets[left] = [h]
                        words[left >> 8] |= bit[left & 255]
                        summary |= bit[left >> 8]
                    else:
                        buckets[left].append(h)
                if 0 <= right < rank or 0 <= left < rank:
                    if n < len(bucket):
                        buckets[rank] = bucket[n:]
                        words[w] |= bit[rank & 255]
                        summary |= bit[w]
                    break
        found = np.array(symbol, np.int32)
        live = found != -2
        return found[live].astype("<i4"), np.cumsum(live)[raw == units.GAP]


class Vocabulary:
    """Ranks of a vocabulary file with the pattern that splits texts into pre-tokens."""

    def __init__(self, ranks: dict[bytes, int], pattern: str):
        self.ranks, self.n_ranks = ranks, max(ranks.values()) + 1
        self.pattern = regex.compile(pattern)
        self.merged = Merger(ranks)
        self.memory = units.IdMemory(self._learn, 2_000_000, np.dtype("<i4"), units.Hasher())  # segments, most of them one pre-token
        self.pieces = BoundedCache(self._ids, limit=100_000)  # pre-tokens of the other segments
        self.decimal = np.array(list(map(str, range(self.n_ranks))), object)
        self.bytes_of = np.full(self.n_ranks, b"", object)
        for token, rank in ranks.items():
            self.bytes_of[rank] = token

    def _ids(self, pre_token: str) -> bytes:
        ids = self.merged(pre_token.encode())
        return pack(f"<{len(ids)}i", *ids)

    def _learn(self, new: list[bytes]) -> list[bytes]:
        cut = [self.pattern.findall(segment.decode()) for segment in new]
        missing = self.pieces.unknown({p for pieces in cut if len(pieces) > 1 for p in pieces})
        merged = self.merged.many([s for s, pieces in zip(new, cut) if len(pieces) == 1] + [p.encode() for p in missing])
        known = dict(zip(missing, merged[len(merged) - len(missing):]))
        for piece, ids in known.items():
            self.pieces.keep(piece, ids)
        single = iter(merged)
        return [next(single) if len(pieces) == 1 else
                b"".join([known[p] if p in known else self.pieces[p] for p in pieces]) for pieces in cut]

    def encode(self, text: str) -> bytes:
        """The text's ids as little-endian 32-bit integers."""
        look_up = self.pieces.__getitem__
        return b"".join(b"".join(map(look_up, self.pattern.findall(p))) for p in parts(text))

    def encode_all(self, texts: list[bytes]) -> list[bytes]:
        """Each text's ids; the segments of plain texts are looked up many at a time."""
        out = [b""] * len(texts)
        plain = [i for i, t in enumerate(texts) if units.is_plain(t)]
        for i in set(range(len(texts))).difference(plain):
            out[i] = self.encode(texts[i].decode("utf-8", "replace"))
        for numbers, group in units.grouped([texts[i] for i in plain]):
            found = units.encoded(group, units.segments_at, self.memory)
            for i, ids in zip(numbers, found):
                out[plain[i]] = ids
        return out

    def digests(self, ids: np.ndarray) -> tuple[str, str]:
        """Hex sha256 of the ids as decimals joined by a space, and of the bytes they decode to."""
        as_text, as_bytes = hashlib.sha256(), hashlib.sha256()
        step = 1 << 18
        for i in range(0, len(ids), step):
            some = ids[i:i + step]
            as_text.update(((" " if i else "") + " ".join(self.decimal[some].tolist())).encode())
            as_bytes.update(self.decode(some))
        return as_text.hexdigest(), as_bytes.hexdigest()

    def decode(self, ids: np.ndarray) -> bytes:
        if len(ids) and (ids.min() < 0 or ids.max() >= self.n_ranks):
            raise ValueError("an id is not in the vocabulary")
        step = 1 << 18
        return b"".join(b"".join(self.bytes_of[ids[i:i + step]].tolist()) for i in range(0, len(ids), step))


def parse_ranks(content: bytes) -> dict[bytes, int]:
    """Lines of base64 token and rank."""
    return {base64.b64decode(token): int(rank) for token, rank in map(bytes.split, content.splitlines())}


_LOADED: dict[tuple, Vocabulary] = {}


class Bpe:
    """Column functions for one vocabulary file.

    The file (a fixed size, about 1 MB) is read once on the driver and
    broadcast; each Python worker parses it once and keeps a bounded cache.
    """

    def __init__(self, spark: SparkSession, ranks_path: str, pattern: str):
        with open(ranks_path, "rb") as f:
            self.content: Broadcast = spark.sparkContext.broadcast(f.read())
        self.pattern = pattern

    def _loader(self):
        content, pattern = self.content, self.pattern

        def vocabulary() -> Vocabulary:
            key = (hash(content.value), pattern)
            if key not in _LOADED:
                _LOADED.clear()
                _LOADED[key] = Vocabulary(parse_ranks(content.value), pattern)
            return _LOADED[key]

        return vocabulary

    def encode(self, text: str | Column) -> Column:
        """``array<int>`` of ids; a null text gives an empty array."""
        vocabulary = self._loader()

        @F.arrow_udf("array<int>")
        def encode_texts(texts: pa.Array) -> pa.Array:
            v = vocabulary()
            ids = v.encode_all(texts.to_pylist())
            ends = np.cumsum([0, *map(len, ids)]) // 4
            if ends[-1] >= 2 ** 31:
                raise ValueError("a batch holds 2^31 ids; lower spark.sql.execution.arrow.maxRecordsPerBatch")
            values = pa.Array.from_buffers(pa.int32(), int(ends[-1]), [None, pa.py_buffer(b"".join(ids))])
            return pa.ListArray.from_arrays(pa.array(ends, pa.int32()), values)

        return encode_texts(utf8(text))

    def round_trip(self, text: str | Column) -> Column:
        """``struct<n_tokens, ids_sha256, decoded_sha256>`` of a text that is encoded and decoded in one place.

        For checking a corpus: the ids, larger than the texts, stay in the worker.
        """
        vocabulary = self._loader()

        @F.arrow_udf("struct<n_tokens: bigint, ids_sha256: string, decoded_sha256: string>")
        def encode_and_decode(texts: pa.Array) -> pa.Array:
            v = vocabulary()
            n, of_ids, of_bytes = [], [], []
            for start in range(0, len(texts), 256):
                for found in v.encode_all(texts.slice(start, 256).to_pylist()):
                    ids = np.frombuffer(found, "<i4")
                    a, b = v.digests(ids)
                    n.append(len(ids))
                    of_ids.append(a)
                    of_bytes.append(b)
            return pa.StructArray.from_arrays(
                [pa.array(n, pa.int64()), pa.array(of_ids, pa.string()), pa.array(of_bytes, pa.string())],
                ["n_tokens", "ids_sha256", "decoded_sha256"])

        return encode_and_decode(utf8(text))

    def decode(self, ids: str | Column) -> Column:
        """``binary`` of the ids' bytes; null ids give no bytes.

        The coalesce keeps Spark from chaining decode onto an encode of the
        same plan, which would encode a second time.
        """
        vocabulary = self._loader()

        @F.arrow_udf("binary")
        def decode_ids(lists: pa.Array) -> pa.Array:
            v = vocabulary()
            return pa.array([v.decode(x.values.to_numpy(zero_copy_only=False)) for x in lists], pa.binary())

        c = F.col(ids) if isinstance(ids, str) else ids
        return decode_ids(F.coalesce(c, F.array().cast("array<int>")))
