"""Labelled rows for classifiers: a bounded sample of the training part, and the logistic fit they share."""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

FOLDS = 5


def held_out(id_col: str) -> Column:
    """True for rows whose labels are never learned from: crc32 of the id as text, modulo 5, is 0. False for null ids."""
    return F.coalesce(F.crc32(F.col(id_col).cast("string")) % FOLDS == 0, F.lit(False))


def training_ids(labels: DataFrame, label: str, per_class: int, id_col: str = "doc_id") -> DataFrame:
    """``(id, label)`` of at most ``per_class`` ids of each class outside the held-out part, in the order of a hash.

    Repeated ids count once, with the larger label; null ids and labels are left out.
    """
    rows = labels.select(F.col(id_col).alias("id"), F.col(label).cast("int").alias("label")).where("id IS NOT NULL AND label IS NOT NULL").where(~held_out("id"))
    rows = rows.groupBy("id").agg(F.max("label").alias("label"))
    return rows.where("label = 1").orderBy(F.xxhash64("id"), "id").limit(per_class).unionByName(rows.where("label = 0").orderBy(F.xxhash64("id"), "id").limit(per_class))


def labelled_texts(docs: DataFrame, labels: DataFrame, label: str, per_class: int, id_col: str, text_col: str) -> DataFrame:
    """``(id, text, label)`` of the sample: at most ``2 * per_class`` rows, so the ids are broadcast.

    Of rows that repeat an id one text is taken, that with the smallest hash; an id of any number of rows adds no more.
    """
    texts = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"))
    rows = texts.join(F.broadcast(training_ids(labels, label, per_class)), "id")
    first = F.min(F.struct(F.xxhash64("text").alias("h"), "text", "label")).alias("first")
    return rows.groupBy("id").agg(first).select("id", "first.text", "first.label")


def class_shares(labels: DataFrame, label: str, id_col: str = "doc_id") -> tuple[int, int]:
    """Labelled rows of the training part by class, over the whole table: ``(ordinary, positive)``."""
    rows = labels.where(F.col(id_col).isNotNull() & F.col(label).isNotNull()).where(~held_out(id_col))
    n = {r[0]: r[1] for r in rows.groupBy(F.col(label).cast("int")).count().collect()}
    return n.get(0, 0), n.get(1, 0)


def sigmoid(x: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(x, -40, 40)))


def fit_logistic(x: np.ndarray, y: np.ndarray, weight: np.ndarray, ridge: float = 0.03, rounds: int = 40) -> np.ndarray:
    """Weights of a ridge logistic regression by Newton steps; the first belongs to the constant."""
    x = np.column_stack([np.ones(len(x)), x])
    w = np.zeros(x.shape[1])
    penalty = ridge * weight.sum() * np.r_[1e-6, np.full(x.shape[1] - 1, 1e-2)]
    for _ in range(rounds):
        p = sigmoid(x @ w)
        slope = x.T @ (weight * (p - y)) + penalty * w
        curve = (x * (weight * p * (1 - p))[:, None]).T @ x + np.diag(penalty + 1e-9)
        step = np.linalg.solve(curve, slope)
        w -= step
        if np.abs(step).max() < 1e-8:
            break
    return w
