"""Quality rules: gradient-boosted trees over document statistics.

Trees are fitted on histograms with a log loss, under monotonic constraints on chosen statistics, and
flattened into node arrays; scoring walks all trees of all rows at once, one level a step.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from rangelake.llm.common import ready
from rangelake.llm.docstats import BASE, FEATURES, describe_all
from rangelake.llm.training import MOST_LABELS, base_logit, bin_edges, binned, labelled_features, sigmoid

#: More symbols, repeats or capitals never raise a document's score.
MONOTONE = {"symbol_share": -1, "dup_line_share": -1, "repeat_share": -1, "upper_share": -1, "loud_share": -1}
#: Documents below this score are rejected. A document that no statistic speaks against scores well above it.
VERDICT = 0.5


@dataclass
class Trees:
    """Node k splits on feature[k] at threshold[k] (up to it: left[k]); leaves lead to themselves and hold value[k]."""

    roots: np.ndarray
    feature: np.ndarray
    threshold: np.ndarray
    left: np.ndarray
    right: np.ndarray
    value: np.ndarray
    depth: int
    base: float

    def score(self, x: np.ndarray) -> np.ndarray:
        at = np.broadcast_to(self.roots, (len(x), len(self.roots)))
        rows = np.arange(len(x))[:, None]
        for _ in range(self.depth):
            at = np.where(x[rows, self.feature[at]] <= self.threshold[at], self.left[at], self.right[at])
        return sigmoid(self.base + self.value[at].sum(axis=1))


def fit_trees(x: np.ndarray, y: np.ndarray, *, trees: int = 80, depth: int = 3, rate: float = 0.15, bins: int = 64, l2: float = 1.0, least: int = 5, monotone: dict[int, int] | None = None) -> Trees:
    """No rows, or labels of one kind, give a model without splits."""
    monotone = monotone or {}
    edges = bin_edges(x, bins)
    b = binned(x, edges)
    base = base_logit(y)
    z = np.full(len(y), base)
    feature, threshold, left, right, value, roots = [], [], [], [], [], []

    def node() -> int:
        for a, v in ((feature, 0), (threshold, 0.0), (value, 0.0)):
            a.append(v)
        left.append(len(left))
        right.append(len(right))
        return len(left) - 1

    for _ in range(trees if len(np.unique(y)) > 1 else 0):
        p = sigmoid(z)
        g, h = y - p, p * (1 - p)
        root = node()
        roots.append(root)
        todo = [(root, np.arange(len(y)), -np.inf, np.inf, 0)]
        while todo:
            k, rows, low, high, level = todo.pop()
            gs, hs = g[rows].sum(), h[rows].sum()
            w = float(np.clip(gs / (hs + l2), low, high))
            best = (1e-6, None)
            if level < depth and len(rows) >= 2 * least:
                for f, e in enumerate(edges):
                    if not len(e):
                        continue
                    n = len(e) + 1
                    gl, hl, cl = (np.cumsum(np.bincount(b[rows, f], q, n))[:-1] for q in (g[rows], h[rows], np.ones(len(rows))))
                    wl, wr = np.clip(gl / (hl + l2), low, high), np.clip((gs - gl) / (hs - hl + l2), low, high)
                    gain = gl * wl - 0.5 * (hl + l2) * wl**2 + (gs - gl) * wr - 0.5 * (hs - hl + l2) * wr**2 - (gs * w - 0.5 * (hs + l2) * w**2)
                    sign = monotone.get(f, 0)
                    gain[(cl < least) | (len(rows) - cl < least) | (sign * (wr - wl) < 0)] = -np.inf
                    s = int(gain.argmax())
                    if gain[s] > best[0]:
                        best = (gain[s], (f, s, (wl[s] + wr[s]) / 2))
            if best[1] is None:
                value[k] = rate * w
                z[rows] += value[k]
                continue
            f, s, mid = best[1]
            sign, go_left = monotone.get(f, 0), b[rows, f] <= s
            feature[k], threshold[k] = f, float(edges[f][s])
            left[k], right[k] = node(), node()
            bounds = {0: ((low, high), (low, high)), 1: ((low, mid), (mid, high)), -1: ((mid, high), (low, mid))}[sign]
            todo += [(left[k], rows[go_left], *bounds[0], level + 1), (right[k], rows[~go_left], *bounds[1], level + 1)]
    return Trees(np.array(roots, int), np.array(feature, int), np.array(threshold), np.array(left, int), np.array(right, int), np.array(value), depth, base)


def fit_quality_rules(docs: DataFrame, labels: DataFrame, column: str = "quality", most: int = MOST_LABELS) -> Trees:
    """Trees fitted on at most `most` labelled documents."""
    x, y = labelled_features(docs, labels, column, most)
    return fit_trees(x, y, monotone={FEATURES.index(k): v for k, v in MONOTONE.items()})


def quality_rules(docs: DataFrame, model: Trees, *, verdict: float = VERDICT, least_words: int = 50, most_repeats: int = 50) -> DataFrame:
    """docs with n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, score and kept.

    Null and empty texts have no words, so base_failed holds for them. Rows are independent: repeated
    rows, null doc_ids and an empty table need no rule. Other columns pass through, columns of docs
    with the names added here are replaced. Nothing is shuffled; only text goes to Python, and only
    statistics come back.
    """
    ready(docs.sparkSession)
    added = [*BASE, "base_failed", "score", "kept"]
    kinds = [*["long"] * len(BASE), "boolean", "double", "boolean"]

    @F.arrow_udf(f"struct<{', '.join(f'{n}: {k}' for n, k in zip(added, kinds))}>")
    def judge(texts: pa.Array) -> pa.Array:
        base, x = describe_all(t.as_py() for t in texts)
        failed = (base[:, 0] < least_words) | (100 * base[:, 4] > most_repeats * base[:, 0])
        score = model.score(x)
        return pa.StructArray.from_arrays([*map(pa.array, base.T), pa.array(failed), pa.array(score), pa.array(~failed & (score >= verdict))], added)

    # a generator, so that a filter on what it gives isn't pushed below it and Python isn't run twice
    return docs.drop(*added).select("*", F.inline_outer(F.array(judge("text"))))
