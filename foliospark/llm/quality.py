"""Text quality by positive-unlabelled learning with the non-negative unbiased risk.

Trusted positives are documents labelled good; unlabelled web text is a sample of all documents. With class prior
``pi`` the risk of a scorer is pi * E_P[loss(+)] + max(0, E_U[loss(-)] - pi * E_P[loss(-)]): the second part estimates
the risk on the unseen negatives and cannot be negative, so where a batch makes it negative the step climbs back.
The prior is estimated first, from a classifier of positives against unlabelled: above a threshold that only positives
pass, the share of unlabelled texts over the share of positives is pi.

The scorer is linear over a byte histogram, shape statistics and hashed words of the whole text.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass
from operator import eq
from zlib import compress, crc32, decompress

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import arrow_map, fold, give_back, text_blocks, union_all
from .labelled import learnable, sample_texts, sigmoid, smallest_ids

FOLDS, HELD_OUT = 3, 1
POSITIVES, UNLABELLED = 3_000, 5_000
HASHED = 1024
SHAPE = 10
WIDTH = 256 + SHAPE + HASHED
BLOCK_BYTES = 2_000_000
#: Columns and rows of a matrix that are worked on at a time.
SLICE, ROWS = 64, 512


def features(text: bytes, out: np.ndarray) -> None:
    """Fill the float row ``out`` of WIDTH zeros; an empty text has only its flag."""
    n = len(text)
    shape = out[256 : 256 + SHAPE]
    if not n:
        shape[0] = 1
        return
    out[:256] = np.sqrt(np.bincount(np.frombuffer(text, np.uint8), minlength=256) / n)
    shape[1] = np.log1p(n) / 10
    words = text.split()
    if words:
        counts = Counter(words)
        shape[2] = len(counts) / len(words)
        shape[3] = sum(map(eq, words, words[1:])) / len(words)
        shape[4] = max(counts.values()) / len(words)
        shape[5] = np.log1p(n / len(words)) / 3
        bucket = np.fromiter(map(crc32, counts), np.uint32, len(counts)) % HASHED
        weight = np.fromiter(counts.values(), np.float64, len(counts)) / len(words)
        out[256 + SHAPE :] = np.sqrt(np.bincount(bucket, weight, HASHED))
    lines = text.split(b"\n")
    shape[6] = len(set(lines)) / len(lines)
    shape[7] = np.log1p(n / len(lines)) / 10
    shape[8] = min(1.0, 10 * len(words) / n)
    shape[9] = np.log1p(len(lines)) / 10


def feature_rows(texts: list[bytes]) -> np.ndarray:
    x = np.zeros((len(texts), WIDTH), np.float32)
    for row, text in zip(x, texts, strict=True):
        features(text, row)
    return x


def packed(x: np.ndarray) -> list[bytes]:
    """The rows, mostly zeros, as they travel to the driver."""
    return [compress(r.tobytes(), 1) for r in x]


def unpacked(rows: list[bytes]) -> np.ndarray:
    x = np.empty((len(rows), WIDTH), np.float32)
    for row, part in zip(x, rows, strict=True):
        row[:] = np.frombuffer(decompress(part), np.float32)
    return x


@dataclass
class Scorer:
    mean: np.ndarray
    scale: np.ndarray
    weights: np.ndarray
    bias: float
    prior: float

    def __call__(self, x: np.ndarray) -> np.ndarray:
        return sigmoid(((x - self.mean) / self.scale) @ self.weights + self.bias).astype(np.float64)


class Adam:
    def __init__(self, size: int, rate: float):
        self.m, self.v, self.t, self.rate = np.zeros(size, np.float32), np.zeros(size, np.float32), 0, rate

    def step(self, w: np.ndarray, g: np.ndarray) -> None:
        self.t += 1
        self.m += 0.1 * (g - self.m)
        self.v += 0.001 * (g * g - self.v)
        w -= self.rate * (self.m / (1 - 0.9**self.t)) / (np.sqrt(self.v / (1 - 0.999**self.t)) + 1e-8)


def estimate_prior(p: np.ndarray, u: np.ndarray, epochs: int = 20, least_share: float = 0.2) -> float:
    """Share of positives in ``u``; rows of both are standardised, with a last column of ones.

    A classifier of positives against unlabelled is fitted on one half of either. On the other half, the share of
    unlabelled over the share of positives above a threshold is the prior where only positives lie above, and larger
    elsewhere; the estimate is the least value over thresholds that leave ``least_share`` of the positives above.
    """
    half_p, half_u = len(p) // 2, len(u) // 2
    w, adam = np.zeros(p.shape[1], np.float32), Adam(p.shape[1], 0.003)
    rng = np.random.default_rng(11)
    for _ in range(epochs * max(1, half_p // 256)):
        a, b = p[rng.integers(0, half_p, 256)], u[rng.integers(0, half_u, 256)]
        adam.step(w, (sigmoid(b @ w) @ b - sigmoid(-(a @ w)) @ a) / 256 + 0.01 * w)
    zp, zu = np.sort(p[half_p:] @ w), np.sort(u[half_u:] @ w)
    cuts = zp[: int(len(zp) * (1 - least_share)) + 1]
    share_p = 1 - np.arange(len(cuts)) / len(zp)
    share_u = 1 - np.searchsorted(zu, cuts, "left") / len(zu)
    slack = np.sqrt(share_u * (1 - share_u) / len(zu) + share_p * (1 - share_p) / len(zp))
    return float(np.clip(((share_u + slack) / share_p).min(), 0.05, 0.98))


def moments(*parts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Mean and deviation of each column over the rows of all parts, without a copy of them all."""
    found = []
    for k in range(0, parts[0].shape[1], SLICE):
        some = np.concatenate([x[:, k : k + SLICE] for x in parts])
        found.append((some.mean(0), some.std(0)))
    mean, deviation = zip(*found, strict=True)
    return np.concatenate(mean), np.concatenate(deviation)


def standardised(x: np.ndarray, order: np.ndarray, mean: np.ndarray, scale: np.ndarray) -> np.ndarray:
    """The rows in the order given, with a last column of ones."""
    out = np.ones((len(x), x.shape[1] + 1), np.float32)
    for i in range(0, len(x), ROWS):
        out[i : i + ROWS, :-1] = (x[order[i : i + ROWS]] - mean) / scale
    return out


def fit(positive: np.ndarray, unlabelled: np.ndarray, prior: float | None = None, epochs: int = 60) -> Scorer:
    """Minimise the non-negative risk; without rows of either kind the score is constant."""
    width = positive.shape[1]
    if len(positive) < 4 or len(unlabelled) < 4:
        return Scorer(np.zeros(width, np.float32), np.ones(width, np.float32), np.zeros(width, np.float32), 0.0, 0.5)
    mean, deviation = moments(positive, unlabelled)
    scale = deviation + 0.02
    rng = np.random.default_rng(7)
    p, u = (standardised(x, rng.permutation(len(x)), mean, scale) for x in (positive, unlabelled))
    pi = estimate_prior(p, u) if prior is None else prior
    w, adam = np.zeros(p.shape[1], np.float32), Adam(p.shape[1], 0.005)
    size = 256
    for _ in range(epochs * max(1, len(u) // size)):
        a, b = p[rng.integers(0, len(p), size)], u[rng.integers(0, len(u), size)]
        za, zb = a @ w, b @ w
        negative_risk = np.logaddexp(0, zb).mean() - pi * np.logaddexp(0, za).mean()
        negative_grad = (sigmoid(zb) @ b - pi * (sigmoid(za) @ a)) / size
        positive_grad = -pi * (sigmoid(-za) @ a) / size
        adam.step(w, (positive_grad + negative_grad if negative_risk >= 0 else -negative_grad) + 1e-4 * w)
    return Scorer(mean, scale, w[:-1].copy(), float(w[-1]), pi)


def train(docs: DataFrame, labels: DataFrame, label: str = "quality", id_col: str = "doc_id", text_col: str = "text", positives: int = POSITIVES, unlabelled: int = UNLABELLED) -> Scorer:
    """Fit on at most ``positives`` trusted rows and ``unlabelled`` rows, none of the held-out fold; labels are read of these only.

    Features are computed where the texts are; the driver gets a fixed number of rows of fixed width, compressed, and holds
    them twice at most.
    """
    held_out = fold(F.col(id_col), FOLDS) == HELD_OUT
    trusted = learnable(labels, label, held_out, id_col).where("label = 1")
    ids = union_all([smallest_ids(trusted, positives, id_col).withColumn("kind", F.lit(1)), smallest_ids(docs.where(~held_out), unlabelled, id_col).withColumn("kind", F.lit(0))])
    kinds = ids.groupBy("id").agg(F.max("kind").alias("trusted"), F.min("kind").alias("least"))  # an id can be in both samples

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            x = feature_rows([t.as_buffer().to_pybytes() for t in batch.column(1)])
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(2), batch.column(3), pa.array(packed(x), pa.binary())], names=["id", "trusted", "least", "x"])

    rows = sample_texts(docs, kinds, id_col, text_col).select(F.col("id").cast("string").alias("id"), "text", "trusted", "least").transform(arrow_map, run, "id string, trusted int, least int, x binary").collect()
    rows.sort(key=lambda r: r["id"])
    scorer = fit(unpacked([r["x"] for r in rows if r["trusted"] == 1]), unpacked([r["x"] for r in rows if r["least"] == 0]))
    del rows
    give_back()
    return scorer


def score(docs: DataFrame, scorer: Scorer, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """id, score double for each row; null and empty texts get the score of an empty text. Other columns are ignored."""
    model = docs.sparkSession.sparkContext.broadcast(scorer)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            scores = score_column(batch.column(1), model.value)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(scores, pa.float64())], names=["id", "score"])

    kind = docs.schema[id_col].dataType.simpleString()
    return docs.select(F.col(id_col).alias("id"), F.col(text_col).cast("string").alias("text")).transform(arrow_map, run, f"id {kind}, score double").withColumnRenamed("id", id_col)


def score_column(texts: pa.Array, scorer: Scorer) -> np.ndarray:
    out = np.zeros(len(texts))
    for i, j, data, at in text_blocks(texts, BLOCK_BYTES):
        raw = data.tobytes()
        for a in range(i, j, 512):
            b = min(j, a + 512)
            out[a:b] = scorer(feature_rows([raw[at[k - i] : at[k - i + 1]] for k in range(a, b)]))
    return out


def keep_good(docs: DataFrame, scorer: Scorer, text_col: str = "text", least: float = 0.5) -> DataFrame:
    """The rows of ``docs`` whose text scores at least ``least``, all columns, without a shuffle."""
    model, where = docs.sparkSession.sparkContext.broadcast(scorer), docs.columns.index(text_col)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield batch.filter(pa.array(score_column(batch.column(where), model.value) >= least))

    return docs.transform(arrow_map, run, docs.schema)
