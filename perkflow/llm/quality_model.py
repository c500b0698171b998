"""Quality classifier: histogram gradient-boosted trees over document statistics.

Every text becomes a short vector of statistics (lengths, character classes,
word and line repetition). The trees are grown level by level on histograms of
gradients over quantile bins, and stored as flat arrays, one row per tree, so
that a batch of texts walks all trees at once by index arithmetic in numpy.

Training sees at most ``train_rows`` labelled documents, chosen by a hash of
their id; only their statistics reach the driver. Scoring is per document, with
no shuffle. Labels, language, source and id are never inputs of a score.

Defined cases: a null text scores as the empty text; a document repeated under
one id trains once (smallest statistics), every row of it is scored; an id with
contradicting labels counts as quality 0; without usable labels the score is
the smoothed prior; extra columns pass through.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from perkflow.llm.common import utf8
from perkflow.llm.repetition import _IS_SPACE, _IS_SYMBOL, _mixed, word_numbers

FEATURES = ("log_chars", "log_words", "word_length", "upper", "digits", "symbols", "exclamations", "stops", "spaces",
            "non_ascii", "distinct_words", "top_word", "word_after_itself", "line_length", "lines_again",
            "lines_stopped", "entropy", "words_ending_in_symbol", "bars", "distinct_4grams")


@dataclass(frozen=True)
class Training:
    train_rows: int = 16_384
    trees: int = 60
    depth: int = 4
    rate: float = 0.2
    bins: int = 64
    l2: float = 1.0
    least_weight: float = 2.0      # sum of second derivatives on either side of a split


def statistics(text: bytes) -> list[float]:
    raw = np.frombuffer(text, np.uint8)
    count = np.bincount(raw, minlength=256)
    n_bytes = max(1, len(raw))
    chars = int(len(raw) - count[0x80:0xC0].sum())
    letters = max(1, int(count[65:91].sum() + count[97:123].sum()))
    p = count[count > 0] / n_bytes
    words = text.split()
    n = len(words)
    numbers = word_numbers(words)
    top = int(np.bincount(numbers).max()) if n else 0
    distinct = int(numbers.max()) + 1 if n else 0
    again = int(np.count_nonzero(numbers[1:] == numbers[:-1])) if n > 1 else 0
    ends = np.flatnonzero(np.diff(np.concatenate((_IS_SPACE[raw], [True])).astype(np.int8)) == 1) if n else raw[:0]
    last = raw[ends]
    four = 1.0
    if n > 4:
        m = _mixed(numbers)
        h = m[:-3]
        for k in range(1, 4):
            h = h * np.uint64(0xD6E8FEB86659FD93) + m[k:n - 3 + k]
        four = len(np.unique(h)) / len(h)
    lines = [x for x in text.split(b"\n") if x.strip()]
    n_lines = max(1, len(lines))
    stopped = sum(x.rstrip()[-1:] in (b".", b"!", b"?", b":") for x in lines)
    return [np.log1p(chars), np.log1p(n), (n_bytes - int(count[_IS_SPACE].sum())) / max(1, n),
            count[65:91].sum() / letters, count[48:58].sum() / n_bytes, count[_IS_SYMBOL].sum() / n_bytes,
            count[33] / n_bytes, (count[44] + count[46] + count[58] + count[59]) / n_bytes,
            count[_IS_SPACE].sum() / n_bytes, count[128:].sum() / n_bytes, distinct / max(1, n), top / max(1, n),
            again / max(1, n), chars / n_lines, 1 - len(set(lines)) / n_lines, stopped / n_lines,
            float(-(p * np.log2(p)).sum()) if len(p) else 0.0,
            np.count_nonzero(_IS_SYMBOL[last]) / max(1, n), count[124] / max(1, n), four]


@dataclass(frozen=True)
class Trees:
    """``feature`` and ``threshold``: (tree, inner node) in heap order; ``leaf``: (tree, leaf)."""
    prior: float
    feature: np.ndarray
    threshold: np.ndarray
    leaf: np.ndarray

    def scores(self, x: np.ndarray, rows: int = 4096) -> np.ndarray:
        """Probability of label 1 for every row of ``x``."""
        depth = (self.leaf.shape[1] if self.leaf.size else 1).bit_length() - 1
        tree = np.arange(len(self.feature))[None, :]
        out = np.empty(len(x))
        for i in range(0, len(x), rows):
            part = x[i:i + rows]
            row = np.arange(len(part))[:, None]
            node = np.zeros((len(part), len(self.feature)), np.int64)
            for _ in range(depth):
                node = 2 * node + 1 + (part[row, self.feature[tree, node]] > self.threshold[tree, node])
            raw = self.prior + self.leaf[tree, node - (2 ** depth - 1)].sum(axis=1) if len(self.feature) \
                else np.full(len(part), self.prior)
            out[i:i + rows] = 1 / (1 + np.exp(-raw))
        return out


def fit(x: np.ndarray, y: np.ndarray, t: Training = Training()) -> Trees:
    """Grows the trees for labels 0 and 1."""
    n, m = x.shape
    share = (y.sum() + 1) / (n + 2)
    prior = float(np.log(share / (1 - share)))
    inner, leaves = 2 ** t.depth - 1, 2 ** t.depth
    if n == 0 or y.min() == y.max():
        return Trees(prior, np.zeros((0, inner), np.int64), np.zeros((0, inner)), np.zeros((0, leaves)))
    cuts = [np.unique(np.quantile(x[:, j], np.arange(1, t.bins) / t.bins, method="lower")) for j in range(m)]
    binned = np.stack([np.searchsorted(c, x[:, j]) for j, c in enumerate(cuts)], axis=1)
    edges = np.full((m, t.bins), np.inf)
    for j, c in enumerate(cuts):
        edges[j, :len(c)] = c
    cell = binned + np.arange(m)[None, :] * t.bins
    raw = np.full(n, prior)
    feature = np.zeros((t.trees, inner), np.int64)
    threshold = np.full((t.trees, inner), np.inf)
    leaf = np.zeros((t.trees, leaves))
    for k in range(t.trees):
        p = 1 / (1 + np.exp(-raw))
        g, h = p - y, p * (1 - p)
        node = np.zeros(n, np.int64)        # within its level
        for d in range(t.depth):
            width = 2 ** d
            at = (node[:, None] * (m * t.bins) + cell).ravel()
            shape = (width, m, t.bins)
            gs = np.bincount(at, np.repeat(g, m), width * m * t.bins).reshape(shape)
            hs = np.bincount(at, np.repeat(h, m), width * m * t.bins).reshape(shape)
            gl, hl = gs.cumsum(2), hs.cumsum(2)
            ga, ha = gl[:, :, -1:], hl[:, :, -1:]
            gr, hr = ga - gl, ha - hl
            gain = gl ** 2 / (hl + t.l2) + gr ** 2 / (hr + t.l2) - ga ** 2 / (ha + t.l2)
            gain[(hl < t.least_weight) | (hr < t.least_weight) | ~np.isfinite(edges)[None]] = 0
            best = gain.reshape(width, -1).argmax(1)
            split = gain.reshape(width, -1)[np.arange(width), best] > 1e-9
            f, b = best // t.bins, best % t.bins
            first = width - 1
            feature[k, first:first + width] = np.where(split, f, 0)
            threshold[k, first:first + width] = np.where(split, edges[f, b], np.inf)
            node = 2 * node + (x[np.arange(n), feature[k, first + node]] > threshold[k, first + node])
        sums = np.bincount(node, g, leaves), np.bincount(node, h, leaves)
        leaf[k] = -t.rate * sums[0] / (sums[1] + t.l2)
        raw += leaf[k][node]
    return Trees(prior, feature, threshold, leaf)


def _statistics_udf():
    @F.arrow_udf("array<double>")
    def text_statistics(texts: pa.Array) -> pa.Array:
        return pa.array([statistics(t.as_py()) for t in texts], pa.list_(pa.float64()))
    return text_statistics


def train(docs: DataFrame, labels: DataFrame, may_learn: Column, t: Training = Training(),
          doc_id: str = "doc_id", text: str = "text", label: str = "quality") -> Trees:
    """Fits on the labelled documents for which ``may_learn`` (over ``labels``) holds."""
    # a share by hash of the id first, so that the ordered limit sees a few times train_rows at most
    share = min(1.0, 4 * t.train_rows / max(1, labels.count()))
    at = F.pmod(F.xxhash64(F.col(doc_id)), F.lit(1 << 30))
    chosen = labels.where(at < int(share * (1 << 30))).where(may_learn & F.col(label).isin(0, 1) & F.col(doc_id).isNotNull()) \
        .groupBy(F.col(doc_id).alias("id")).agg(F.min(label).alias("y")) \
        .orderBy(F.xxhash64("id"), "id").limit(t.train_rows)
    # at most train_rows pairs of id and label: a proven bound for the broadcast
    rows = docs.select(F.col(doc_id).alias("id"), F.col(text).alias("text")).join(F.broadcast(chosen), "id") \
        .select("id", "y", _statistics_udf()(utf8("text")).alias("x")) \
        .groupBy("id").agg(F.min("x").alias("x"), F.min("y").alias("y")) \
        .orderBy("id").toArrow()
    x = np.array(rows["x"].to_pylist(), np.float64).reshape(-1, len(FEATURES))
    return fit(x, np.array(rows["y"].to_pylist(), np.float64), t)


def score_column(model: Trees, text: str | Column) -> Column:
    """Probability of label 1."""
    @F.arrow_udf("double")
    def quality_score(texts: pa.Array) -> pa.Array:
        x = np.array([statistics(t.as_py()) for t in texts], np.float64).reshape(-1, len(FEATURES))
        return pa.array(model.scores(x), pa.float64())

    return quality_score(utf8(text))
