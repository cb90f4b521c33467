"""Bounded labelled samples for fitting, and a small logistic calibration."""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import text_of

#: Longer texts are scored like all others but not used for fitting.
MOST_SAMPLE_BYTES = 65_536


def smallest_ids(rows: DataFrame, most: int, id_col: str = "doc_id") -> DataFrame:
    """At most ``most`` distinct ids, those of the smallest hash: the same ones at every run and partitioning."""
    ids = rows.select(F.col(id_col).alias("id")).where("id IS NOT NULL").distinct()
    return ids.orderBy(F.xxhash64("id"), "id").limit(most)


def sample_texts(docs: DataFrame, ids: DataFrame, id_col: str = "doc_id", text_col: str = "text", most_bytes: int = MOST_SAMPLE_BYTES) -> DataFrame:
    """id, columns of ``ids`` and text of the documents named; ``ids`` must be bounded, as it is broadcast."""
    texts = docs.select(F.col(id_col).alias("id"), text_of(text_col).alias("text")).where(F.octet_length("text") <= most_bytes)
    return texts.join(F.broadcast(ids), "id").dropDuplicates(["id"])


def learnable(labels: DataFrame, label: str, held_out: Column, id_col: str = "doc_id") -> DataFrame:
    """Labelled rows outside the held-out fold, with ``label`` cast to int."""
    return labels.where(~held_out & F.col(label).isNotNull()).select(id_col, F.col(label).cast("int").alias("label"))


def sigmoid(z: np.ndarray) -> np.ndarray:
    return 0.5 * (1.0 + np.tanh(0.5 * z))


class Calibration:
    """Ridge logistic regression by Newton steps, on standardised features."""

    def __init__(self, x: np.ndarray, y: np.ndarray, ridge: float = 0.1, steps: int = 30):
        self.mean, self.scale = x.mean(0), x.std(0) + 1e-9
        z = self._prepared(x)
        self.weights = np.zeros(z.shape[1])
        for _ in range(steps):
            p = sigmoid(z @ self.weights)
            hessian = (z * (p * (1 - p))[:, None]).T @ z + ridge * np.eye(z.shape[1])
            self.weights -= np.linalg.solve(hessian, z.T @ (p - y) + ridge * self.weights)

    def _prepared(self, x: np.ndarray) -> np.ndarray:
        return np.c_[(x - self.mean) / self.scale, np.ones(len(x))]

    def __call__(self, x: np.ndarray) -> np.ndarray:
        return sigmoid(self._prepared(x) @ self.weights)
