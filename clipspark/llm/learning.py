"""Bounded samples of labelled rows, and small linear models fitted to them."""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .tables import pick, written


def held_out(key: Column) -> Column:
    """Whether a row is kept from learning."""
    return F.coalesce(F.crc32(key.cast("string").cast("binary")) % 3 == 1, F.lit(False))


def labelled_sample(docs: DataFrame, labels: DataFrame, column: str, most: tuple[int, int]) -> tuple[DataFrame, float]:
    """((doc_id, label, text) of a bounded number of distinct texts, share of label 1).

    The ids are drawn by hash; at most ``sum(most)`` reach the join, so it may be broadcast. An
    id or a text with both labels has label 1."""
    known = pick(labels, "doc_id", column).filter(~held_out(F.col("doc_id")) & F.col(column).isNotNull() & F.col("doc_id").isNotNull())
    known = known.groupBy("doc_id").agg(F.max(column).alias("label"))
    counts = {r.label: r.n for r in known.groupBy("label").agg(F.count("*").alias("n")).collect()}
    share = counts.get(1, 0) / max(1, sum(counts.values()))
    drawn = None
    for label, rows in ((0, most[0]), (1, most[1])):
        part = known.filter(F.col("label") == label).orderBy(F.xxhash64("doc_id"), "doc_id").limit(rows)
        drawn = part if drawn is None else drawn.union(part)
    sample = docs.select("doc_id", "text").join(F.broadcast(drawn), "doc_id")
    return written(sample.groupBy("text").agg(F.min("doc_id").alias("doc_id"), F.max("label").alias("label")).select("doc_id", "label", "text")), share


def fit(row: np.ndarray, index: np.ndarray, rows: int, scale: np.ndarray, target: np.ndarray, weight_of_row: np.ndarray, ridge: float = 1.0, values: np.ndarray | None = None) -> tuple[np.ndarray, float]:
    """(weights, bias) of a logistic regression by accelerated gradient steps. Row ``row[i]``
    has feature ``index[i]``, with value 1 or ``values[i]``; ``scale`` favours features."""
    k = len(scale)
    w, b = np.zeros(k), 0.0
    x = scale[index] if values is None else scale[index] * values
    w_old, b_old = w, b
    size = max(1.0, float(np.bincount(row, x * x, minlength=rows).max(initial=0)) + 1)
    step = 4.0 / (size * max(1e-9, weight_of_row.sum()) * 1.0)
    for t in range(1, 301):
        m = (t - 1) / (t + 2)
        w_at, b_at = w + m * (w - w_old), b + m * (b - b_old)
        z = b_at + np.bincount(row, w_at[index] * x, minlength=rows)
        g = weight_of_row * (1 / (1 + np.exp(-np.clip(z, -50, 50))) - target)
        w_old, b_old = w, b
        w = w_at - step * (np.bincount(index, g[row] * x, minlength=k) + ridge * w_at)
        b = b_at - step * g.sum()
    return w * scale, b


def platt(margin: np.ndarray, label: np.ndarray, weigh: np.ndarray) -> tuple[float, float]:
    """Slope and offset that turn margins into probabilities of label 1 (Newton steps)."""
    a, c = 1.0, 0.0
    t = np.where(label == 1, (label.sum() + 1) / (label.sum() + 2), 1 / ((1 - label).sum() + 2))
    for _ in range(50):
        p = 1 / (1 + np.exp(-np.clip(a * margin + c, -50, 50)))
        g = np.array([(weigh * (p - t) * margin).sum() + 1e-3 * a, (weigh * (p - t)).sum()])
        s = weigh * p * (1 - p)
        h = np.array([[(s * margin * margin).sum(), (s * margin).sum()], [(s * margin).sum(), s.sum()]]) + 1e-3 * np.eye(2)
        step = np.linalg.solve(h, g)
        a, c = a - np.clip(step[0], -1, 1), c - np.clip(step[1], -1, 1)
    return (a, c) if a > 0 else (1.0, 0.0)
