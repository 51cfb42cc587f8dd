"""Quality by histogram gradient-boosted trees over document statistics.

Statistics of a bounded, documented sample of labelled documents are cut into at most 64 bins; trees of bounded depth are
grown level by level on histograms of gradients. All trees are flattened into arrays, and a batch of documents walks all
trees at once with numpy.
"""

from __future__ import annotations

from collections import Counter

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from inkveil.llm.common import map_slices
from inkveil.llm.labelled import THRESHOLD, filter_documents, label_rows, sample_ids, sampled_texts, score_documents

#: At most so many labelled documents are fitted on.
SAMPLE = 20_000
TREES, DEPTH, RATE, BINS, LEAST_HESSIAN, SHRINK = 80, 4, 0.15, 64, 2.0, 1.0

_CLASSES = np.zeros(256, np.int64)  # of bytes: 0 other, 1 lower case, 2 upper case, 3 digit, 4 space, 5 line end, 6 sentence marks, 7 symbols, 8 beyond ASCII
_CLASSES[0x61:0x7B], _CLASSES[0x41:0x5B], _CLASSES[0x30:0x3A], _CLASSES[0x80:] = 1, 2, 3, 8
_CLASSES[[0x20, 0x09]], _CLASSES[[0x0A, 0x0D]] = 4, 5
_CLASSES[[ord(c) for c in ".,;:?'\"-()"]], _CLASSES[[ord(c) for c in "!#$%&*+/<=>@[\\]^_`{|}~"]] = 6, 7

FEATURES = ("bytes", "words", *(f"share_{k}" for k in range(9)), "entropy", "word_length", "longest_word", "distinct_words", "top_word", "distinct_pairs", "lines", "distinct_lines", "line_length", "capital_words", "symbol_words")


def statistics(text: str) -> list[float]:
    """Figures about one whole text; all 0 for an empty one."""
    raw = text.encode()
    if not raw:
        return [0.0] * len(FEATURES)
    counts = np.bincount(np.frombuffer(raw, np.uint8), minlength=256)
    shares = np.bincount(_CLASSES, counts, 9) / len(raw)
    p = counts[counts > 0] / len(raw)
    words = text.split()
    n, lines = max(1, len(words)), text.split("\n")
    met = Counter(words)
    pairs = len(set(zip(words, words[1:], strict=False)))
    capital = sum(c for w, c in met.items() if w[0].isupper())
    symbol = sum(c for w, c in met.items() if not w[-1].isalnum())
    return [np.log1p(len(raw)), np.log1p(len(words)), *shares, float(-(p * np.log2(p)).sum()), sum(len(w) * c for w, c in met.items()) / n, max(map(len, met), default=0), len(met) / n, max(met.values(), default=0) / n, pairs / max(1, n - 1), np.log1p(len(lines)), len(set(lines)) / len(lines), len(text) / len(lines), capital / n, symbol / n]


def matrix(texts: list[str]) -> np.ndarray:
    return np.array([statistics(t) for t in texts], float).reshape(len(texts), len(FEATURES))


class BoostedTrees:
    """Flat arrays over all trees: feature (-1 at leaves), threshold, left, value; the right child follows the left."""

    def __init__(self, base: float, feature: np.ndarray, threshold: np.ndarray, left: np.ndarray, value: np.ndarray, roots: np.ndarray, depth: int):
        self.base, self.feature, self.threshold, self.left, self.value, self.roots, self.depth = base, feature, threshold, left, value, roots, depth

    @classmethod
    def fit(cls, x: np.ndarray, y: np.ndarray, trees: int = TREES, depth: int = DEPTH, rate: float = RATE) -> BoostedTrees:
        if not len(y) or y.min() == y.max():
            share = (y.sum() + 0.5) / (len(y) + 1.0)
            return cls(float(np.log(share / (1 - share))), *[np.empty(0, k) for k in (int, float, int, float, int)], 0)
        edges = [np.unique(np.quantile(x[:, f], np.linspace(0, 1, BINS)[1:-1])) for f in range(x.shape[1])]
        binned = np.stack([np.searchsorted(e, x[:, f], side="left") for f, e in enumerate(edges)], 1)  # bin b: x <= edges[b]
        base = float(np.log(y.mean() / (1 - y.mean())))
        raw = np.full(len(y), base)
        feature, threshold, left, value, roots = [], [], [], [], []
        for _ in range(trees):
            p = 1 / (1 + np.exp(-raw))
            g, h = p - y, np.maximum(p * (1 - p), 1e-9)
            roots.append(len(feature))
            level, node = [len(feature)], np.full(len(y), len(feature))
            feature.append(-1), threshold.append(0.0), left.append(-1), value.append(0.0)
            for d in range(depth + 1):
                place = np.full(len(feature), -1)
                place[level] = np.arange(len(level))
                slot = place[node]
                live = slot >= 0
                sums_g, sums_h = (np.bincount(slot[live], w[live], len(level)) for w in (g, h))
                for k, at in enumerate(level):
                    value[at] = -rate * sums_g[k] / (sums_h[k] + SHRINK)
                if d == depth:
                    break
                best = [(1e-6, -1, -1)] * len(level)
                for f, e in enumerate(edges):
                    if not len(e):
                        continue
                    key = slot[live] * BINS + binned[live, f]
                    below_g, below_h = (np.cumsum(np.bincount(key, w[live], len(level) * BINS).reshape(-1, BINS), 1)[:, : len(e)] for w in (g, h))
                    above_g, above_h = sums_g[:, None] - below_g, sums_h[:, None] - below_h
                    gain = below_g**2 / (below_h + SHRINK) + above_g**2 / (above_h + SHRINK) - (sums_g**2 / (sums_h + SHRINK))[:, None]
                    gain[(below_h < LEAST_HESSIAN) | (above_h < LEAST_HESSIAN)] = -1
                    for k, b in enumerate(gain.argmax(1).tolist()):
                        if gain[k, b] > best[k][0]:
                            best[k] = (gain[k, b], f, b)
                following = []
                for k, at in enumerate(level):
                    _, f, b = best[k]
                    if f < 0:
                        continue
                    feature[at], threshold[at], left[at] = f, float(edges[f][b]), len(feature)
                    following += [len(feature), len(feature) + 1]
                    own = node == at
                    node[own] = len(feature) + (binned[own, f] > b)
                    for _ in range(2):
                        feature.append(-1), threshold.append(0.0), left.append(-1), value.append(0.0)
                level = following
                if not level:
                    break
            raw += np.array(value)[node]
        return cls(base, np.array(feature), np.array(threshold), np.array(left), np.array(value), np.array(roots), depth)

    def predict(self, x: np.ndarray) -> np.ndarray:
        """Probabilities of label 1; all trees are walked at once, one level a step."""
        at = np.tile(self.roots, (len(x), 1)).astype(np.int64)
        rows = np.arange(len(x))[:, None]
        for _ in range(self.depth if len(self.roots) else 0):
            f = self.feature[at]
            inner = f >= 0
            below = self.left[at] + (x[rows, np.maximum(f, 0)] > self.threshold[at])
            at = np.where(inner, below, at)
        raw = self.base + (self.value[at].sum(1) if len(self.roots) else 0)
        return 1 / (1 + np.exp(-raw)) * np.ones(len(x))


class QualityModel:
    def __init__(self, trees: BoostedTrees):
        self.trees = trees

    def score(self, texts: list[str]) -> np.ndarray:
        return self.trees.predict(matrix(texts)) if texts else np.empty(0)


def fit(docs: DataFrame, labels: DataFrame, folds: int | None = None, fold: int = 0, most: int = SAMPLE) -> QualityModel:
    """Learn from at most `most` labelled rows outside the held-out fold; no labels give the score 0.5."""
    texts = sampled_texts(docs, sample_ids(label_rows(labels, "quality", folds, fold), most))

    def run(rows: pa.RecordBatch) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([rows.column("doc_id"), rows.column("label"), pa.array(matrix(rows.column("text").to_pylist()).tolist(), pa.list_(pa.float64()))], ["doc_id", "label", "x"])

    rows = map_slices(texts.select("doc_id", "text", "label"), run, "doc_id long, label int, x array<double>")
    # Of rows with one id the one whose statistics come first is learnt from, whatever order they are read in.
    rows = rows.groupBy("doc_id").agg(F.min(F.struct("x", "label")).alias("e")).select("doc_id", "e.label", "e.x").collect()
    rows.sort(key=lambda r: r.doc_id)
    return QualityModel(BoostedTrees.fit(np.array([r.x for r in rows], float).reshape(len(rows), len(FEATURES)), np.array([r.label for r in rows], float)))


def score(docs: DataFrame, labels: DataFrame, folds: int = 5, fold: int = 0) -> DataFrame:
    """doc_id, held_out, score, predicted for every row of docs.

    Null texts score as empty ones (all statistics 0); equal texts score alike, repeated rows stay; a null doc_id is not held out;
    labels of missing documents, null labels and extra columns are ignored; empty tables give no rows.
    """
    return score_documents(docs, fit(docs, labels, folds, fold).score, folds, fold)


def keep_good(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """The rows of docs that are predicted to be of good quality, with all their columns."""
    return filter_documents(docs, fit(docs, labels).score, lambda s: s >= THRESHOLD)
