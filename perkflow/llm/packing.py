"""Lexical retrieval packing: training windows filled with a document's BM25 neighbours.

Every text is tokenized once and its ids are kept in a table of the shared
checkpoint folder. Document frequencies of all tokens are counted over the
whole corpus (one number per vocabulary entry).

Documents are dealt by content to *shards* of bounded size: a document's BM25
weights are projected to a few dimensions, and a tree of planes, fitted on a
bounded sample to halve its tokens again and again, names the shard. Rows are
shuffled once, by shard. A shard has an inverted index with BM25 weights; the
next unused document is the seed of a window, its most telling tokens are the
query, and the neighbours that the index returns fill the window greedily, best
first, until it is full. When no unused document shares these tokens, the
seed's next ones are asked, and only when none shares any token is another seed
taken. The document that does not fit is cut, and its rest is the next seed.
What is left of a shard's last window joins the task's next shard; what is left
of a task's last window is cut into sequences whose lengths are powers of two,
so nothing needs padding.

Neighbours in another shard are out of reach. Memory is bounded by a shard and
the longest text. A lost executor's tasks are run again from the table, with
the same result.

Defined cases: a null or empty text is the end id alone; repeated rows are
documents of their own; special strings in a text become special ids, the
library's default; a null id is carried along; extra columns are ignored.
"""

from __future__ import annotations

import json
import os
import re
from array import array
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import regex
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from perkflow.llm import units
from perkflow.llm.common import save, utf8
from perkflow.llm.segments import BoundedCache, parts


@dataclass(frozen=True)
class Packing:
    """``query_tokens``: how many of a seed's tokens, by inverse document frequency, are looked up at a time.

    ``neighbours``: how many items are ranked at a time. ``sample_rows`` and
    ``max_leaves`` bound the tree that deals documents to shards, ``dimensions``
    is the size of the vectors it sees.
    """
    window: int = 4096
    shard_tokens: int = 2_000_000
    query_tokens: int = 24
    neighbours: int = 32
    k1: float = 1.2
    b: float = 0.75
    dimensions: int = 64
    sample_rows: int = 65_536
    max_leaves: int = 4096
    seed: int = 7


# --- tokenizing -----------------------------------------------------------------------------

def check_tokenizer(content: str) -> int:
    """Vocabulary size of a tokenizer file whose words between white space are independent; else raises."""
    spec = json.loads(content)
    pre = [p["type"] for p in (spec.get("pre_tokenizer") or {}).get("pretokenizers", [])]
    norm = [n["type"] for n in (spec.get("normalizer") or {}).get("normalizers", [])]
    if pre != ["Split", "ByteLevel"] or not set(norm) <= {"NFC", "Replace", "Lowercase"} or spec.get("post_processor"):
        raise ValueError("not a tokenizer that drops white space and splits words by themselves")
    added = spec.get("added_tokens", [])
    if any(t.get("single_word") or t.get("lstrip") or t.get("rstrip") for t in added):
        raise ValueError("an added token depends on its surroundings")
    return 1 + max([*spec["model"]["vocab"].values(), *(t["id"] for t in added)])


def _letters() -> dict[int, str]:
    """The printable letter that byte-level vocabularies write for each byte."""
    kept = [*range(0x21, 0x7f), *range(0xa1, 0xad), *range(0xae, 0x100)]
    others = [b for b in range(256) if b not in set(kept)]
    return {b: chr(b) for b in kept} | {b: chr(256 + i) for i, b in enumerate(others)}


LETTERS = _letters()


class _Words:
    """A worker's tokenizer with bounded memories of words and of the pieces that words share.

    New pieces, in lower case and split already, go straight to the library's
    model, in the letters that stand for their bytes.
    """

    #: Up to here no letter composes with another one, and lower case is the same in every library.
    BEYOND_LATIN = re.compile("[\u0250-\U0010ffff]")
    #: With this pattern a word of letters is one piece.
    LETTERS_TOGETHER = r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+"

    def __init__(self, content: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer
        self.tokenizer = Tokenizer.from_str(content)
        self.model = self.tokenizer.model
        spec = json.loads(content)
        to_bytes = spec["pre_tokenizer"]["pretokenizers"][1]
        # else the library changes or cuts a piece once more
        self.direct = not to_bytes.get("add_prefix_space", True) and not to_bytes.get("use_regex", True)
        size = check_tokenizer(content)
        self.kind = id_type(size)
        self.special = [t["content"] for t in spec.get("added_tokens", [])]
        self.special_lower = [s.lower().encode() for s in self.special]
        self.special_marks = any(s[-1] in '.,;:!?)"' for s in self.special)
        pattern = spec["pre_tokenizer"]["pretokenizers"][0]["pattern"]["Regex"]
        self.split, self.letters_together = regex.compile(pattern + "|\n"), pattern == self.LETTERS_TOGETHER
        self.memory = units.IdMemory(self._learn, 800_000, self.kind, units.Hasher())
        self.pieces = BoundedCache(self._ids, limit=150_000)

    def _whole(self, text: str) -> bytes:
        return np.array(self.tokenizer.encode(text, add_special_tokens=False).ids, self.kind).tobytes()

    def _plain(self, text: str) -> bool:
        """Whether words may be cut here, not by the library."""
        return (text.isascii() or not self.BEYOND_LATIN.search(text)) and not any(s in text for s in self.special)

    def _learn(self, new: list[bytes]) -> list[bytes]:
        """The ids of words, their unknown pieces encoded first."""
        found: list[bytes] = []
        for i in range(0, len(new), 4096):
            text = b"\n".join(new[i:i + 4096]).decode("utf-8", "replace")
            words = text.split("\n")
            if self._plain(text):
                found += self._of_plain(words, text)
            else:
                found += [self._of_plain([w], w)[0] if self._plain(w) else self._whole(w) for w in words]
        return found

    def _of_plain(self, words: list[str], text: str) -> list[bytes]:
        """``text``: the words, joined by line ends."""
        low = text.lower().split("\n")
        if not self.letters_together:
            return self._of_pieces(low, set(words))
        out, others = [b""] * len(low), []
        ids_of, tokens_of, letter = self._ids, self.model.tokenize, self.kind.char
        for i, w in enumerate(low):
            if not w.isalpha():
                others.append(i)
            elif self.direct and w.isascii():
                out[i] = array(letter, [t.id for t in tokens_of(w)]).tobytes()
            else:
                out[i] = ids_of(w)
        if others:
            for i, ids in zip(others, self._of_pieces([low[i] for i in others], {words[i] for i in others})):
                out[i] = ids
        return out

    def _of_pieces(self, low: list[str], words: set[str]) -> list[bytes]:
        pieces = self.split.findall("\n".join(low))
        look_up, out, ids = self._ids_of(set(pieces).difference("\n"), words).__getitem__, [], b""
        for piece in pieces:
            if piece == "\n":
                out.append(ids)
                ids = b""
            else:
                ids += look_up(piece)
        return [*out, ids]

    def _ids_of(self, wanted: set[str], words: set[str]) -> dict[str, bytes]:
        """The ids of pieces. They are remembered unless they are whole words, which ``memory`` keeps."""
        shared = wanted - words
        found = {piece: self.pieces[piece] for piece in shared}
        found.update((piece, self._ids(piece)) for piece in wanted & words)
        return found

    def _ids(self, piece: str) -> bytes:
        if not self.direct:
            return self._whole(piece)
        if not (piece.isascii() and piece.isprintable()):
            piece = piece.encode().decode("latin-1").translate(LETTERS)
        return array(self.kind.char, [t.id for t in self.model.tokenize(piece)]).tobytes()

    def encode(self, texts: list[bytes]) -> list[bytes]:
        """The ids of each text. Words are cut at ASCII white space; the library cuts them further where needed."""
        out: list[bytes] = []
        for numbers, group in units.grouped(texts):
            if len(group[0]) < units.GROUP_BYTES:
                out += self._encode_group(group)
            else:
                out.append(b"".join(map(self._encode_part, parts(group[0].decode("utf-8", "replace"), 1 << 18))))
        return out

    def _encode_part(self, part: str) -> bytes:
        """A part of a very long text; a run without white space may be as long as the text."""
        raw = part.encode()
        return self._encode_group([raw])[0] if len(raw) < units.GROUP_BYTES else self._whole(part)

    def _encode_group(self, texts: list[bytes]) -> list[bytes]:
        return units.encoded(texts, self._units_at, self.memory, self._lowered)

    def _lowered(self, raw: np.ndarray) -> np.ndarray:
        """Lower case, which the tokenizer makes anyway, unless that would make a special string."""
        low = units.lowered(raw)
        data = low.tobytes()
        return raw if any(s in data for s in self.special_lower) else low

    def _units_at(self, raw: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        starts, ends = units.words_at(raw)
        return (starts, ends) if self.special_marks else units.split_marks(raw, starts, ends)


def id_type(vocabulary: int) -> np.dtype:
    return np.dtype("<u2" if vocabulary <= 1 << 16 else "<u4")


_LOADED: dict[int, _Words] = {}
#: Rows whose texts and ids a worker holds at a time.
_BATCH_ROWS = 1024


def tokenized(docs: DataFrame, tokenizer_path: str, end_id: int, doc_id: str, text: str) -> DataFrame:
    """(key, ids) for every text and, for every task, one row with its token statistics (``terms``, ``n``).

    ``ids``: the text's ids and the end id, as little-endian integers of
    ``id_type``. ``terms``: tokens, and N_DOCS and N_TOKENS; ``n``: in how many
    of the task's documents, and these two totals.
    """
    with open(tokenizer_path, encoding="utf-8") as f:
        content = f.read()
    vocabulary = check_tokenizer(content)
    kind = id_type(vocabulary)
    shared, end = docs.sparkSession.sparkContext.broadcast(content), np.array([end_id], kind).tobytes()
    names = ["key", "ids", "terms", "n"]

    def of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key = hash(shared.value)
        if key not in _LOADED:
            _LOADED.clear()
            _LOADED[key] = _Words(shared.value)
        held, n, size, key_kind = np.zeros(vocabulary, np.int64), 0, 0, None
        longs = pa.list_(pa.int64())
        for batch in (b.slice(i, _BATCH_ROWS) for b in batches for i in range(0, b.num_rows, _BATCH_ROWS)):
            key_kind = batch.schema.field("key").type
            found = [ids + end for ids in _LOADED[key].encode(batch.column("text").to_pylist())]
            for ids in found:
                tokens = np.sort(np.frombuffer(ids, kind), kind="stable")
                held[tokens[1:][tokens[1:] != tokens[:-1]]] += 1
                held[tokens[0]] += 1
                size += len(tokens)
            n += len(found)
            nothing = pa.nulls(len(found), longs)
            yield pa.RecordBatch.from_arrays([batch.column("key"), pa.array(found, pa.binary()), nothing, nothing], names)
        if n:
            terms = np.flatnonzero(held)
            yield pa.RecordBatch.from_arrays(
                [pa.nulls(1, key_kind), pa.nulls(1, pa.binary()),
                 pa.array([[N_DOCS, N_TOKENS, *terms.tolist()]], longs),
                 pa.array([[n, size, *held[terms].tolist()]], longs)], names)

    texts = docs.select(F.col(doc_id).alias("key"), utf8(text).alias("text"))
    schema = T.StructType([T.StructField("key", texts.schema["key"].dataType), T.StructField("ids", T.BinaryType()),
                           T.StructField("terms", T.ArrayType(T.LongType())), T.StructField("n", T.ArrayType(T.LongType()))])
    return texts.mapInArrow(of, schema)


# --- corpus statistics ----------------------------------------------------------------------

N_DOCS, N_TOKENS = -1, -2


def frequencies(table: DataFrame, vocabulary: int) -> tuple[np.ndarray, int, int]:
    """Documents that hold each token, documents, tokens: over all tasks of ``tokenized``."""
    # at most vocabulary + 2 rows per task, and in all
    rows = table.where(F.col("terms").isNotNull()).select(F.explode(F.arrays_zip("terms", "n")).alias("x")) \
        .groupBy("x.terms").agg(F.sum("x.n").alias("n"))
    total = dict(rows.toArrow().to_pandas().itertuples(index=False))
    out = np.zeros(vocabulary, np.int64)
    for term, n in total.items():
        if term >= 0:
            out[term] = n
    return out, int(total.get(N_DOCS, 0)), int(total.get(N_TOKENS, 0))


def distinct(tokens: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Distinct tokens in order, with their counts."""
    # equal numbers cannot be told apart: radix sort for 16-bit ids, the faster unstable one for wider numbers
    ranked = np.sort(tokens, kind="stable" if tokens.dtype.itemsize <= 2 else "quicksort")
    new = np.ones(len(ranked), bool)
    np.not_equal(ranked[1:], ranked[:-1], out=new[1:])
    first = np.flatnonzero(new)
    return ranked[first], np.diff(first, append=len(ranked))


def distinct_of_each(docs: list[np.ndarray], vocabulary: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Each document's distinct tokens in order: the document's number, the token, its count there."""
    lengths = np.array([len(d) for d in docs])
    pairs, counts = distinct(np.repeat(np.arange(len(docs)) * vocabulary, lengths) + np.concatenate(docs))
    return *np.divmod(pairs, vocabulary), counts


# --- shards by content ----------------------------------------------------------------------

class Projection:
    """Unit vectors of few dimensions whose products follow those of the documents' BM25 weights."""

    def __init__(self, idf: np.ndarray, mean_length: float, how: Packing):
        self.idf, self.mean, self.how = idf, max(mean_length, 1.0), how
        self.axes = np.random.default_rng(how.seed).standard_normal((len(idf), how.dimensions), np.float32)

    def __call__(self, docs: list[np.ndarray]) -> np.ndarray:
        return np.concatenate([self._some(docs[i:i + 512]) for i in range(0, len(docs), 512)])

    def _some(self, docs: list[np.ndarray]) -> np.ndarray:
        how, lengths = self.how, np.array([len(d) for d in docs])
        owner, terms, counts = distinct_of_each(docs, len(self.idf))
        norm = how.k1 * (1 - how.b + how.b * lengths / self.mean)
        weight = (self.idf[terms] * counts * (how.k1 + 1) / (counts + norm[owner])).astype(np.float32)
        first = np.searchsorted(owner, np.arange(len(docs) + 1)).tolist()
        out = np.empty((len(docs), how.dimensions), np.float32)
        for i, (a, b) in enumerate(zip(first, first[1:])):     # the products of one document at a time
            np.einsum("i,ij->j", weight[a:b], self.axes[terms[a:b]], out=out[i])
        return out / np.maximum(np.sqrt((out ** 2).sum(axis=1, keepdims=True)), 1e-9)


@dataclass(frozen=True)
class Planes:
    """A binary tree: below node i hang ``kids[i]``; a leaf is written as -1 - number."""
    axes: np.ndarray
    cuts: np.ndarray
    kids: np.ndarray

    #: Weight of a row's random number, which parts equal vectors.
    JITTER = 1e-4

    @staticmethod
    def fit(x: np.ndarray, salt: np.ndarray, tokens: np.ndarray, leaves: int) -> Planes:
        """Each plane lies across the widest spread and parts the sample's tokens as its leaves are."""
        axes, cuts, kids = [], [], []
        numbers = iter(range(leaves))

        def grow(rows: np.ndarray, n: int) -> int:
            if n == 1:
                return -1 - next(numbers)
            node = len(axes)
            axis, cut = np.zeros(x.shape[1]), 0.0
            if len(rows):
                part = x[rows] - x[rows].mean(axis=0)
                axis = np.linalg.eigh(part.T.astype(np.float64) @ part)[1][:, -1]
            at = x[rows] @ axis + Planes.JITTER * salt[rows]
            order = np.argsort(at, kind="stable")
            mass = np.cumsum(tokens[rows][order])
            k = int(np.searchsorted(mass, mass[-1] * (n // 2) / n)) if len(rows) else 0
            if len(rows):
                cut = at[order[k]]
            axes.append(axis)
            cuts.append(cut)
            kids.append(None)
            kids[node] = (grow(rows[order[:k + 1]], n // 2), grow(rows[order[k + 1:]], n - n // 2))
            return node

        grow(np.arange(len(x)), leaves)
        return Planes(np.array(axes).reshape(-1, x.shape[1]), np.array(cuts), np.array(kids, np.int64).reshape(-1, 2))

    def leaf(self, x: np.ndarray, salt: np.ndarray) -> np.ndarray:
        at = np.full(len(x), 0 if len(self.axes) else -1)
        while (inner := np.flatnonzero(at >= 0)).size:
            node = at[inner]
            value = (x[inner] * self.axes[node]).sum(axis=1) + self.JITTER * salt[inner]
            at[inner] = self.kids[node, (value > self.cuts[node]).astype(int)]
        return -1 - at


def _salts(n: int, start: int) -> np.ndarray:
    """A random number in [0, 1) for each of a task's rows from the ``start``-th on, the same in every run."""
    x = (np.arange(start, start + n, dtype=np.uint64) + (np.uint64(TaskContext.get().partitionId()) << np.uint64(40)))
    x = (x + np.uint64(1)) * np.uint64(0x9E3779B97F4A7C15)
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    return (x ^ (x >> np.uint64(31))) / 2.0 ** 64


def dealt(ids: DataFrame, shared, n_docs: int, n_tokens: int, kind: np.dtype, how: Packing) -> DataFrame:
    """``ids`` (key, ids) plus ``shard`` and ``at``, the row's place in the table; in partitions by shard."""
    spark = ids.sparkSession
    shards = max(1, -(-n_tokens // how.shard_tokens))
    leaves = min(shards, how.max_leaves)
    per_leaf = -(-shards // leaves)     # of a leaf that is still too large: dealt by chance

    def vectors(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[pa.RecordBatch, list[np.ndarray], np.ndarray, np.ndarray, int]]:
        idf, mean_length = shared.value
        project, start = Projection(idf, mean_length, how), 0
        for batch in batches:
            if batch.num_rows:
                docs = [np.frombuffer(x.as_py(), kind) for x in batch.column("ids")]
                yield batch, docs, project(docs), _salts(len(docs), start), start
                start += len(docs)

    def sampled(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for _, docs, x, salt, _ in vectors(batches):
            yield pa.RecordBatch.from_arrays([pa.array(x.tolist(), pa.list_(pa.float32())), pa.array(salt),
                                              pa.array([len(d) for d in docs], pa.int64())], ["x", "salt", "tokens"])

    x, salt, tokens = np.zeros((0, how.dimensions), np.float32), np.zeros(0), np.zeros(0, np.int64)
    if leaves > 1:
        share = min(1.0, how.sample_rows / max(1, n_docs))
        some = ids.select("ids") if share == 1.0 else ids.select("ids").sample(share, how.seed)
        found = some.mapInArrow(sampled, "x array<float>, salt double, tokens long").toArrow().combine_chunks()
        if len(found):
            x = found["x"].combine_chunks().flatten().to_numpy().reshape(len(found), -1)
            salt, tokens = found["salt"].to_numpy(), found["tokens"].to_numpy()
    planes = spark.sparkContext.broadcast(Planes.fit(x, salt, tokens, leaves))

    def with_shard(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part = TaskContext.get().partitionId() << 40
        for batch, docs, x, salt, start in vectors(batches):
            again = (salt * (1 << 20)).astype(np.int64) % per_leaf
            shard = planes.value.leaf(x, salt) * per_leaf + again
            yield pa.RecordBatch.from_arrays(
                [batch.column("key"), batch.column("ids"), pa.array(shard, pa.int32()),
                 pa.array(np.arange(len(docs)) + start + part, pa.int64())], ["key", "ids", "shard", "at"])

    schema = T.StructType([*ids.schema.fields, T.StructField("shard", T.IntegerType()), T.StructField("at", T.LongType())])
    return ids.mapInArrow(with_shard, schema).repartition(leaves * per_leaf, "shard").sortWithinPartitions("shard", "at")


# --- packing --------------------------------------------------------------------------------

@dataclass
class Item:
    """What is left of a document: its ids from ``start`` on."""
    key: object
    tokens: np.ndarray
    start: int
    total: int


class ShardIndex:
    """Inverted index over a shard's items with BM25 weights."""

    def __init__(self, items: list[Item], idf: np.ndarray, mean_length: float, how: Packing):
        found = [distinct_of_each([x.tokens for x in items[i:i + 512]], len(idf)) for i in range(0, len(items), 512)]
        owner = np.concatenate([x[0] + 512 * i for i, x in enumerate(found)])
        terms = np.concatenate([x[1] for x in found])
        counts = np.concatenate([x[2] for x in found]).astype(np.float32)
        self.terms_of = np.split(terms, np.searchsorted(owner, np.arange(1, len(items))))
        lengths = np.array([len(x.tokens) for x in items], np.float32)
        norm = how.k1 * (1 - how.b + how.b * lengths / mean_length)
        weight = idf[terms] * counts * (how.k1 + 1) / (counts + norm[owner])
        by_term = np.argsort(terms, kind="stable")
        self.owner, self.weight = owner[by_term], weight[by_term]
        self.first = np.concatenate(([0], np.cumsum(np.bincount(terms, minlength=len(idf)))))
        self.idf, self.how = idf, how
        self.unused = np.ones(len(items), bool)

    def _add(self, scores: np.ndarray, terms: np.ndarray) -> None:
        for t in terms:
            a, b = self.first[t], self.first[t + 1]
            scores[self.owner[a:b]] += self.weight[a:b]

    def _best(self, scores: np.ndarray) -> list[int]:
        scores[~self.unused] = 0
        hits = np.flatnonzero(scores)
        if len(hits) > self.how.neighbours:
            hits = hits[np.argpartition(-scores[hits], self.how.neighbours)[:self.how.neighbours]]
        return hits[np.lexsort((hits, -scores[hits]))].tolist()

    def _terms(self, seed: int) -> np.ndarray:
        terms = self.terms_of[seed]
        return terms[np.argsort(-self.idf[terms], kind="stable")]

    def neighbours(self, seed: int) -> list[int]:
        """The best unused items by falling score, then position; only items that share a query token."""
        scores = np.zeros(len(self.terms_of), np.float32)
        self._add(scores, self._terms(seed)[:self.how.query_tokens])
        return self._best(scores)

    def ranked(self, seed: int) -> Iterator[int]:
        """All unused items that share a token with the seed, those of its most telling tokens first.

        Whoever takes an item marks it used before asking for the next one.
        """
        scores, terms = np.zeros(len(self.terms_of), np.float32), self._terms(seed)
        for i in range(0, len(terms), self.how.query_tokens):
            self._add(scores, terms[i:i + self.how.query_tokens])
            while some := self._best(scores):
                yield from some


class Packer:
    """Packs one task's documents; ``put`` receives (item, length, sequence, offset) for every piece."""

    def __init__(self, idf: np.ndarray, mean_length: float, how: Packing, put):
        self.idf, self.mean, self.how, self.put = idf, max(mean_length, 1.0), how, put
        self.pool: list[Item] = []
        self.held = 0
        self.sequence = 0

    def add(self, key, tokens: np.ndarray) -> None:
        item = Item(key, tokens, 0, len(tokens))
        while len(item.tokens) >= self.how.window:
            self._take(item, self.how.window, 0)
            self.sequence += 1
        if len(item.tokens):
            self.pool.append(item)
            self.held += len(item.tokens)
            if self.held >= self.how.shard_tokens:
                self._pack()

    def end_shard(self) -> None:
        """The next document is of another shard."""
        if self.held >= self.how.window:
            self._pack()

    def _take(self, item: Item, n: int, offset: int) -> None:
        self.put(item, n, self.sequence, offset)
        item.tokens, item.start = item.tokens[n:], item.start + n

    def _pack(self) -> None:
        """Fills windows from the pool until what is left does not fill one."""
        items = self.pool
        index = ShardIndex(items, self.idf, self.mean, self.how)
        order = iter(range(len(items)))
        left, rest = self.held, None
        while left >= self.how.window:
            seed = rest if rest is not None else next(i for i in order if index.unused[i])
            rest, room = None, self.how.window
            ranked = iter([])
            i = seed
            while True:
                index.unused[i] = False
                n = min(room, len(items[i].tokens))
                self._take(items[i], n, self.how.window - room)
                room -= n
                if not room:
                    break
                if i == seed:
                    ranked = index.ranked(seed)
                i = next(ranked, None)
                if i is None:   # no unused item shares a token: go on with another seed
                    i = seed = next(j for j in order if index.unused[j])
            if len(items[i].tokens):
                rest = i
            self.sequence += 1
            left -= self.how.window
        self.pool = [x for x in items if len(x.tokens)]
        self.held = left

    def close(self) -> None:
        """Packs the rest; the last, partly filled window becomes sequences of powers of two."""
        self.end_shard()
        pool, left = iter(self.pool), self.held
        item = next(pool, None)
        while left:
            size = 1 << (left.bit_length() - 1)
            room = size
            while room:
                n = min(room, len(item.tokens))
                self._take(item, n, size - room)
                room -= n
                if not len(item.tokens):
                    item = next(pool, None)
            self.sequence += 1
            left -= size
        self.pool, self.held = [], 0


_BATCH_PIECES, _BATCH_TOKENS = 4096, 4_000_000


def pack(docs: DataFrame, tokenizer_path: str, end_id: int, doc_id: str = "doc_id", text: str = "text",
         how: Packing = Packing()) -> DataFrame:
    """One row per piece: ``doc_id, start, length, ids, doc_tokens, sequence_id, offset``.

    ``ids``: the piece's ids as little-endian unsigned 32-bit integers. The
    ids of all texts are written to the shared checkpoint folder when called.
    """
    if how.query_tokens < 1 or how.neighbours < 1:
        raise ValueError("query_tokens and neighbours must be positive")
    if how.window < 1 or how.window & (how.window - 1):
        raise ValueError("window must be a power of two")
    spark = docs.sparkSession
    with open(tokenizer_path, encoding="utf-8") as f:
        vocabulary = check_tokenizer(f.read())
    kind = id_type(vocabulary)
    table = save(tokenized(docs, tokenizer_path, end_id, doc_id, text), "token-ids")
    in_docs, n_docs, n_tokens = frequencies(table, vocabulary)
    ids = table.where(F.col("ids").isNotNull()).select("key", "ids")
    idf = np.log1p((n_docs - in_docs + 0.5) / (in_docs + 0.5)).astype(np.float32)
    shared = spark.sparkContext.broadcast((idf, n_tokens / max(1, n_docs)))  # one number per vocabulary entry
    key_type = ids.schema["key"].dataType
    schema = T.StructType([T.StructField("doc_id", key_type), T.StructField("start", T.LongType()),
                           T.StructField("length", T.LongType()), T.StructField("ids", T.BinaryType()),
                           T.StructField("doc_tokens", T.LongType()), T.StructField("sequence_id", T.LongType()),
                           T.StructField("offset", T.LongType())])

    def pack_part(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part = TaskContext.get().partitionId() << 40
        rows: list[tuple] = []
        waiting = [0]
        keys = None

        def put(item: Item, n: int, sequence: int, offset: int) -> None:
            rows.append((item.key, item.start, n, item.tokens[:n].astype("<u4").tobytes(), item.total,
                         part + sequence, offset))
            waiting[0] += n

        def written() -> pa.RecordBatch:
            columns = list(zip(*rows))
            rows.clear()
            waiting[0] = 0
            kinds = [keys, pa.int64(), pa.int64(), pa.binary(), pa.int64(), pa.int64(), pa.int64()]
            return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds)], schema.names)

        idf, mean_length = shared.value
        packer, last = Packer(idf, mean_length, how, put), None
        for batch in batches:
            keys = batch.schema.field("key").type
            for key, x, shard in zip(batch.column("key"), batch.column("ids"), batch.column("shard").to_pylist()):
                if shard != last:
                    packer.end_shard()
                    last = shard
                packer.add(key.as_py(), np.frombuffer(x.as_py(), kind))
                if len(rows) >= _BATCH_PIECES or waiting[0] >= _BATCH_TOKENS:
                    yield written()
        packer.close()
        if rows:
            yield written()

    return dealt(ids, shared, n_docs, n_tokens, kind, how).mapInArrow(pack_part, schema)
