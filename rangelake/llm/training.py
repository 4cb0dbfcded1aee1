"""Labelled rows for the models that are fitted here."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from rangelake.llm.common import ready
from rangelake.llm.docstats import FEATURES, describe_all

#: Most labelled rows that a model is fitted on: those whose doc_ids hash lowest.
MOST_LABELS = 20_000


def labelled_features(docs: DataFrame, labels: DataFrame, column: str, most: int = MOST_LABELS) -> tuple[np.ndarray, np.ndarray]:
    """(features, labels) of at most `most` labelled documents, in a fixed order.

    Rows with a null doc_id or label don't count. A doc_id is one document: of several labels the largest
    counts, of several texts the one whose statistics are largest. The labels are bounded by most, so
    they can be broadcast, and so is what comes back, however often rows repeat.
    """
    ready(docs.sparkSession)
    known = labels.filter(F.col("doc_id").isNotNull() & F.col(column).isNotNull()).groupBy("doc_id").agg(F.max(column).cast("double").alias("y"))
    known = known.orderBy(F.xxhash64("doc_id"), "doc_id").limit(most)
    rows = docs.select("doc_id", "text").join(F.broadcast(known), "doc_id")
    names = [f"f{k}" for k in range(len(FEATURES))]
    kind = docs.schema["doc_id"].dataType.simpleString()

    def run(batches):
        for b in batches:
            out = pd.DataFrame(describe_all(b["text"])[1], columns=names)
            out.insert(0, "doc_id", b["doc_id"].array)
            out.insert(1, "y", b["y"].to_numpy())
            yield out

    got = rows.mapInPandas(run, f"doc_id {kind}, y double, " + ", ".join(f"{k} double" for k in names))
    got = got.groupBy("doc_id").agg(F.max(F.struct(*names, "y")).alias("d")).select("d.*").toPandas()
    got = got.sort_values(["y", *names], kind="stable")
    return got[names].to_numpy(np.float64).reshape(-1, len(FEATURES)), got["y"].to_numpy(np.float64)


def bin_edges(x: np.ndarray, bins: int) -> list[np.ndarray]:
    """Per feature the inner quantiles; bin k holds values above edge k-1 and up to edge k."""
    return [np.unique(np.quantile(x[:, f], np.linspace(0, 1, bins + 1)[1:-1])) if len(x) else np.zeros(0) for f in range(x.shape[1])]


def binned(x: np.ndarray, edges: list[np.ndarray]) -> np.ndarray:
    return np.stack([np.searchsorted(e, x[:, f], "left") for f, e in enumerate(edges)], axis=1) if len(edges) else np.zeros((len(x), 0), int)


def sigmoid(z: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(z, -40, 40)))


def base_logit(y: np.ndarray) -> float:
    """The log-odds of label 1, pulled towards even odds by one row of each kind."""
    p = (y.sum() + 1) / (len(y) + 2)
    return float(np.log(p / (1 - p)))
