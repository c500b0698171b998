"""Toxicity classifier learnt from confirmed toxic examples and unlabelled text (non-negative PU learning).

A text is the set of its words and of their beginnings and ends, those that it
holds twice or more being features of their own, and a mark of its length. Training never
reads a negative label: it minimises the risk
``prior * loss(toxic as toxic) + max(0, loss(unlabelled as clean) - prior *
loss(toxic as clean))`` of a logistic model, whose second part corrects the
unlabelled sample for the toxic share (``prior``) that hides in it. Where a
step finds that part negative, the model has begun to fit the unlabelled
sample's toxic texts as clean, and the step is taken back along its gradient.

At most ``positives`` toxic and about ``unlabelled`` other documents, chosen by
hash, are read for training; ``candidates`` and ``features`` bound what of them
reaches the driver. Scoring is per whole text, with no shuffle. Labels,
language, source and id are never inputs of a score.

Defined cases: a null text scores as the empty text, which holds no feature;
bytes that are not UTF-8 count as U+FFFD; very long texts are read whole; a
document repeated under one id is one example, an id with contradicting labels
counts as toxic; repeated rows score alike; extra columns are ignored, whatever
their names; with an empty table or without toxic examples the score is the
smallest prior throughout. Ties among candidates and features go to the smaller
feature.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterable
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from perkflow.llm.common import save, utf8

_BREAKS = bytes(32 if c < 128 and not chr(c).isalnum() else c for c in range(256))
#: (mark of the kind, bytes a word must exceed, what is taken of it): whole words, beginnings and ends.
_KINDS = ((b"=", 0, slice(None)), *((b"^%d" % n, n, slice(n)) for n in (4, 5, 6)),
          *((b"$%d" % n, n, slice(-n, None)) for n in (4, 5)))
_TWICE = b"2"
_LENGTHS = [b"#%d" % n for n in range(33)]


@dataclass(frozen=True)
class Training:
    positives: int = 4096
    unlabelled: int = 16_384
    candidates: int = 20_000
    features: int = 1024
    least_seen: int = 3         # toxic examples that hold a candidate
    least_z: float = 5.0        # deviations by which a feature is more frequent in them than in unlabelled text
    least_lift: float = 3.0     # and how many times as frequent; a feature of toxic text alone reaches 1 / prior
    prior: float | None = None  # share of toxic text; None: the share among the labels to learn from
    least_prior: float = 0.001
    steps: int = 400
    rate: float = 0.05
    l2: float = 1e-4
    give_back: float = 1.0      # length of the step back where the corrected risk is negative


def words(text: bytes) -> Counter[bytes]:
    return Counter(text.decode("utf-8", "replace").lower().encode().translate(_BREAKS).split())


def _parts(found: Iterable[bytes], longer: int, cut: slice) -> set[bytes]:
    return {w[cut] for w in found if len(w) > longer}


def _length(found: Counter[bytes]) -> bytes:
    """The feature that says how long a text is: its number of words, in powers of two."""
    return b"#%d" % found.total().bit_length()


def features(text: bytes) -> list[bytes]:
    """What a text holds, and with a mark in front, what it holds twice or more."""
    found = words(text)
    out = [_length(found)]
    for mark, longer, cut in _KINDS:
        count: Counter[bytes] = Counter()
        for w, n in found.items():
            if len(w) > longer:
                count[w[cut]] += n
        for part, n in count.items():
            out.append(mark + part)
            if n > 1:
                out.append(_TWICE + mark + part)
    return out


class Places:
    """Numbers of given features, and which of them a text holds."""

    def __init__(self, names: Iterable[bytes]):
        self.number = {n: i for i, n in enumerate(names)}
        self.kinds = []
        for mark, longer, cut in _KINDS:
            named = (n[len(_TWICE):] if n.startswith(_TWICE) else n for n in self.number)
            self.kinds.append((mark, longer, cut, {n[len(mark):] for n in named if n.startswith(mark)}))

    def of(self, text: bytes) -> list[int]:
        found = words(text)
        held = [_length(found)]
        for mark, longer, cut, known in self.kinds:
            hits = dict.fromkeys(known & _parts(found, longer, cut) if known else (), 0)
            if hits:
                for w, n in found.items():
                    if len(w) > longer and w[cut] in hits:
                        hits[w[cut]] += n
            for part, n in hits.items():
                held.append(mark + part)
                if n > 1:
                    held.append(_TWICE + mark + part)
        return sorted(self.number[h] for h in held if h in self.number)


# --- risk and training ------------------------------------------------------------------------

class Sparse:
    """Rows of feature numbers."""

    def __init__(self, rows: list[list[int]], n: int):
        self.n, self.rows = n, len(rows)
        self.at = np.array([i for r in rows for i in r], np.int64)
        self.row = np.repeat(np.arange(len(rows)), [len(r) for r in rows])

    def times(self, w: np.ndarray) -> np.ndarray:
        return np.bincount(self.row, w[self.at], self.rows)

    def gathered(self, g: np.ndarray) -> np.ndarray:
        return np.bincount(self.at, g[self.row], self.n)


def _sigmoid(x: np.ndarray) -> np.ndarray:
    return 0.5 * (1 + np.tanh(x / 2))


def risk(toxic: np.ndarray, unlabelled: np.ndarray, prior: float) -> tuple[float, float]:
    """The two parts, from raw scores: of toxic examples as toxic, and the corrected one of clean text as clean."""
    return (prior * float(np.logaddexp(0, -toxic).mean()),
            float(np.logaddexp(0, unlabelled).mean() - prior * np.logaddexp(0, toxic).mean()))


def gradients(toxic: np.ndarray, unlabelled: np.ndarray, prior: float):
    """Of both parts of ``risk`` by the raw scores: (part 1 by toxic, part 2 by toxic, part 2 by unlabelled)."""
    n, m = len(toxic), len(unlabelled)
    return -prior * _sigmoid(-toxic) / n, -prior * _sigmoid(toxic) / n, _sigmoid(unlabelled) / m


def fit(toxic: Sparse, unlabelled: Sparse, prior: float, t: Training) -> tuple[np.ndarray, float]:
    """Weights and bias by Adam steps over all examples."""
    n = toxic.n
    w = np.zeros(n + 1)
    w[n] = np.log(prior / (1 - prior))
    first, second = np.zeros(n + 1), np.zeros(n + 1)
    for step in range(1, t.steps + 1):
        fp, fu = toxic.times(w[:n]) + w[n], unlabelled.times(w[:n]) + w[n]
        as_toxic, corrected, as_clean = gradients(fp, fu, prior)
        if risk(fp, fu, prior)[1] >= 0:
            gp, gu = as_toxic + corrected, as_clean
        else:
            gp, gu = -t.give_back * corrected, -t.give_back * as_clean
        g = np.append(toxic.gathered(gp) + unlabelled.gathered(gu), gp.sum() + gu.sum())
        g[:n] += t.l2 * w[:n]
        first, second = 0.9 * first + 0.1 * g, 0.999 * second + 0.001 * g ** 2
        w -= t.rate * (first / (1 - 0.9 ** step)) / (np.sqrt(second / (1 - 0.999 ** step)) + 1e-8)
    return w[:n], float(w[n])


@dataclass(frozen=True)
class Model:
    names: tuple[bytes, ...]
    weights: np.ndarray
    bias: float

    def scores(self, texts: list[bytes]) -> np.ndarray:
        places = Places(self.names)
        return _sigmoid(np.array([self.bias + self.weights[places.of(t)].sum() for t in texts]))


# --- Spark ------------------------------------------------------------------------------------

def _examples(docs: DataFrame, labels: DataFrame, may_learn: Column, t: Training, doc_id: str, text: str,
              label: str) -> tuple[DataFrame, float]:
    """(toxic, text) of the chosen documents, written once, and the prior."""
    usable = labels.where(may_learn & F.col(label).isin(0, 1) & F.col(doc_id).isNotNull()) \
        .groupBy(F.col(doc_id).alias("id")).agg(F.max(label).alias("y"))
    n_labels, n_toxic = usable.agg(F.count("*"), F.sum("y")).first()
    n_toxic = n_toxic or 0
    prior = t.prior if t.prior is not None else n_toxic / max(1, n_labels)
    wide = 1 << 30
    share = min(1.0, 4 * t.positives / max(1, n_toxic))
    chosen = usable.where((F.col("y") == 1) & (F.pmod(F.xxhash64("id"), F.lit(wide)) < int(share * wide))) \
        .orderBy(F.xxhash64("id"), "id").limit(t.positives).select("id")
    own = docs.select(F.col(doc_id).alias("id"), utf8(text).alias("text"))
    # at most ``positives`` ids: a proven bound for the broadcast
    toxic = own.join(F.broadcast(chosen), "id").groupBy("id").agg(F.min("text").alias("text"))
    share = min(1.0, t.unlabelled / max(1, docs.count()))
    at = F.xxhash64("id", "text", F.lit(12))
    other = own.withColumn("at", at).where(F.pmod("at", F.lit(wide)) < int(share * wide)) \
        .groupBy("at").agg(F.min("text").alias("text"))
    both = toxic.select(F.lit(True).alias("toxic"), "text").unionByName(other.select(F.lit(False).alias("toxic"), "text"))
    return save(both, "toxicity-examples"), min(max(prior, t.least_prior), 0.5)


def _held(names: list[bytes]):
    shared = Places(names)

    @F.arrow_udf("array<int>")
    def places(texts: pa.Array) -> pa.Array:
        return pa.array([shared.of(x.as_py()) for x in texts], pa.list_(pa.int32()))

    return places


def _all_features():
    @F.arrow_udf("array<binary>")
    def all_features(texts: pa.Array) -> pa.Array:
        return pa.array([features(x.as_py()) for x in texts], pa.list_(pa.binary()))

    return all_features


def train(docs: DataFrame, labels: DataFrame, may_learn: Column, t: Training = Training(), doc_id: str = "doc_id",
          text: str = "text", label: str = "toxic") -> Model:
    """Learns from the toxic labels for which ``may_learn`` (over ``labels``) holds, and from unlabelled documents."""
    examples, prior = _examples(docs, labels, may_learn, t, doc_id, text, label)
    n = {r["toxic"]: r["n"] for r in examples.groupBy("toxic").agg(F.count("*").alias("n")).collect()}
    none = Model((), np.zeros(0), float(np.log(t.least_prior / (1 - t.least_prior))))
    if not n.get(True) or not n.get(False):
        return none
    seen = examples.where("toxic").select(F.explode(_all_features()("text")).alias("name")).groupBy("name").count()
    top = seen.where(F.col("count") >= t.least_seen).orderBy(F.desc("count"), "name").limit(t.candidates).collect()
    names, in_toxic = [bytes(r["name"]) for r in top], np.array([r["count"] for r in top], np.float64)
    in_other = np.zeros(len(names))
    for r in examples.where("not toxic").select(F.explode(_held(names)("text")).alias("i")).groupBy("i").count().collect():
        in_other[r["i"]] = r["count"]
    p, u = in_toxic / n[True], in_other / n[False]
    both = (in_toxic + in_other) / (n[True] + n[False])
    z = (p - u) / np.sqrt(np.maximum(both * (1 - both) * (1 / n[True] + 1 / n[False]), 1e-300))
    telling = (z >= t.least_z) & (p >= t.least_lift * u) & ~np.array([x[:1] == b"#" for x in names], bool)
    order = sorted(np.flatnonzero(telling).tolist(), key=lambda i: (-z[i], names[i]))[:t.features]
    kept = [*(names[i] for i in order), *_LENGTHS]
    rows = examples.select("toxic", _held(kept)("text").alias("held")).toArrow()
    held: dict[bool, list] = {True: [], False: []}
    for y, h in sorted(zip(rows["toxic"].to_pylist(), rows["held"].to_pylist())):
        held[y].append(h)
    weights, bias = fit(Sparse(held[True], len(kept)), Sparse(held[False], len(kept)), prior, t)
    return Model(tuple(kept), weights, bias)


def score_column(model: Model, text: str | Column) -> Column:
    """Probability that a text is toxic."""
    @F.arrow_udf("double")
    def toxicity_score(texts: pa.Array) -> pa.Array:
        return pa.array(model.scores(texts.to_pylist()), pa.float64())

    return toxicity_score(utf8(text))
