"""Quality classifier: a generalised additive model with pairwise interactions.

Boosting goes round the features in turn; each step fits a shallow tree on one feature's bins to the
gradient and adds it to that feature's lookup table. The pairs whose joint bins explain most of what
is left get two-dimensional tables in the same way. Scoring looks up bins and adds.
"""

from __future__ import annotations

from dataclasses import dataclass
from itertools import combinations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame

from rangelake.llm.common import ready
from rangelake.llm.docstats import FEATURES, describe_all
from rangelake.llm.training import MOST_LABELS, base_logit, bin_edges, binned, labelled_features, sigmoid

THRESHOLD = 0.7


@dataclass
class Additive:
    edges: list[np.ndarray]
    tables: list[np.ndarray]
    coarse: list[np.ndarray]
    pairs: list[tuple[int, int]]
    pair_tables: list[np.ndarray]
    base: float

    def score(self, x: np.ndarray) -> np.ndarray:
        b, c = binned(x, self.edges), binned(x, self.coarse)
        z = np.full(len(x), self.base)
        for f, t in enumerate(self.tables):
            z += t[b[:, f]]
        for (f, g), t in zip(self.pairs, self.pair_tables):
            z += t[c[:, f], c[:, g]]
        return sigmoid(z)


def _cuts(g: np.ndarray, h: np.ndarray, leaves: int, l2: float) -> list[tuple[int, int]]:
    """A best-first tree over ordered bins: the (begin, end) of its leaves."""
    def best(a: int, z: int) -> tuple[float, int]:
        gl, hl = np.cumsum(g[a:z])[:-1], np.cumsum(h[a:z])[:-1]
        if not len(gl):
            return 0.0, a
        gs, hs = g[a:z].sum(), h[a:z].sum()
        gain = gl**2 / (hl + l2) + (gs - gl) ** 2 / (hs - hl + l2) - gs**2 / (hs + l2)
        return float(gain.max()), a + 1 + int(gain.argmax())

    spans = [(0, len(g))]
    while len(spans) < leaves:
        found = [(*best(a, z), k) for k, (a, z) in enumerate(spans)]
        gain, at, k = max(found)
        if gain <= 1e-9:
            break
        a, z = spans[k]
        spans[k : k + 1] = [(a, at), (at, z)]
    return spans


def fit_additive(x: np.ndarray, y: np.ndarray, *, rounds: int = 150, pair_rounds: int = 60, rate: float = 0.08, bins: int = 32, pair_bins: int = 8, pairs: int = 6, leaves: int = 3, l2: float = 2.0) -> Additive:
    """No rows, or labels of one kind, give a model that scores every row alike."""
    edges, coarse, base = bin_edges(x, bins), bin_edges(x, pair_bins), base_logit(y)
    tables = [np.zeros(len(e) + 1) for e in edges]
    model = Additive(edges, tables, coarse, [], [], base)
    if len(np.unique(y)) < 2:
        return model
    b, c, z = binned(x, edges), binned(x, coarse), np.full(len(y), base)
    for _ in range(rounds):
        for f, t in enumerate(tables):
            if len(t) < 2:
                continue
            p = sigmoid(z)
            g, h = np.bincount(b[:, f], y - p, len(t)), np.bincount(b[:, f], p * (1 - p), len(t))
            step = np.zeros(len(t))
            for i, j in _cuts(g, h, leaves, l2):
                step[i:j] = rate * g[i:j].sum() / (h[i:j].sum() + l2)
            t += step
            z += step[b[:, f]]
    sides = [len(e) + 1 for e in coarse]

    def grid(f: int, k: int) -> tuple[np.ndarray, np.ndarray]:
        p, flat = sigmoid(z), c[:, f] * sides[k] + c[:, k]
        return tuple(np.bincount(flat, q, sides[f] * sides[k]).reshape(sides[f], sides[k]) for q in (y - p, p * (1 - p)))

    def quarters(g: np.ndarray, h: np.ndarray) -> tuple[float, list]:
        """A tree of depth two: a cut on one axis, then one of its own in each half on the other."""
        found = []
        for turned in (False, True):
            a, w = (g.T, h.T) if turned else (g, h)
            (lo, hi) = ([*_cuts(a.sum(1), w.sum(1), 2, l2)] * 2)[:2]
            leaves2 = [(r, s) for r in dict.fromkeys((lo, hi)) for s in _cuts(a[slice(*r)].sum(0), w[slice(*r)].sum(0), 2, l2)]
            gain = sum(a[slice(*r), slice(*s)].sum() ** 2 / (w[slice(*r), slice(*s)].sum() + l2) for r, s in leaves2)
            found.append((float(gain), [(s, r) if turned else (r, s) for r, s in leaves2]))
        return max(found, key=lambda q: q[0])

    ranked = sorted(((quarters(*grid(f, k))[0], f, k) for f, k in combinations(range(len(sides)), 2) if sides[f] > 1 and sides[k] > 1), reverse=True)
    model.pairs = [(f, k) for _, f, k in ranked[:pairs]]
    model.pair_tables = [np.zeros((sides[f], sides[k])) for f, k in model.pairs]
    for _ in range(pair_rounds):
        for (f, k), t in zip(model.pairs, model.pair_tables):
            g, h = grid(f, k)
            step = np.zeros_like(t)
            for r, s in quarters(g, h)[1]:
                cell = slice(*r), slice(*s)
                step[cell] = rate * g[cell].sum() / (h[cell].sum() + l2)
            t += step
            z += step[c[:, f], c[:, k]]
    return model


def fit_quality_gam(docs: DataFrame, labels: DataFrame, column: str = "quality", most: int = MOST_LABELS) -> Additive:
    """The model, fitted on at most `most` labelled documents."""
    return fit_additive(*labelled_features(docs, labels, column, most))


def quality_scores(docs: DataFrame, model: Additive, *, threshold: float = THRESHOLD) -> DataFrame:
    """Per row of docs: doc_id, score (0 to 1) and predicted (score >= threshold).

    Null texts score as empty ones. Rows are independent: repeated rows, null doc_ids and an empty
    table need no rule; other columns aren't read. Nothing is shuffled.
    """
    ready(docs.sparkSession)

    def run(batches):
        for d in batches:
            score = model.score(describe_all(d["text"])[1])
            yield pd.DataFrame({"doc_id": d["doc_id"].array, "score": score, "predicted": (score >= threshold).astype("int32")})

    kind = docs.schema["doc_id"].dataType.simpleString()
    return docs.select("doc_id", "text").mapInPandas(run, f"doc_id {kind}, score double, predicted int")
