"""Toxicity by compression distance: one zstandard dictionary of toxic text, one of ordinary text.

Words are first written in a fixed-width code, so that every word costs the same when it is new and the same when a
dictionary knows it: a hash of the whole word, then one of its first ``STEM`` characters, which the forms of a word share.
(On plain bytes a known word of five letters saves two or three bytes, which drowns among the syllables that any two
dictionaries know by chance; README has the figures.) A text is cut into windows of ``WORDS`` words. Each window is compressed with either dictionary; the ordinary length less the toxic length is its distance.

Both dictionaries are trained (``zstandard.train_dictionary``) on the bounded labelled sample: the ordinary one on windows
of ordinary texts, the toxic one on the passages of toxic texts that set them apart: runs of words of which the whole or the
stem is significantly more frequent there. The toxic compressor knows ordinary text too, as toxic text mostly is ordinary; the
ordinary one gets filler of the same length instead, so offsets cost the same and the distance is due to toxic passages.

Thresholds on the distances (how many windows pass each, and the largest distances) are calibrated to a probability
by logistic regression on labelled texts that the dictionaries have not seen.
"""

from __future__ import annotations

import hashlib
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import arrow_map, fold, union_all
from .decontaminate import words_of
from .labelled import Calibration, learnable, sample_texts, smallest_ids

FOLDS, HELD_OUT = 4, 2
TOXIC_ROWS, ORDINARY_ROWS = 2_000, 4_000
#: Characters of a stem, bytes of a code (half for the word, half for the stem), words of a window.
STEM, CODE, WORDS = 5, 16, 16
LEVEL = 3
ORDINARY_BYTES, TOXIC_BYTES = 65_536, 4_096
THRESHOLDS = (1, 3, 5, 7, 10)
#: For dictionaries; the rest of the labelled sample calibrates.
FIT_SHARE = 0.7
#: A word or stem sets toxic texts apart if it is so many times as frequent there, by so many standard errors, in so many texts.
LIFT, SIGMAS, LEAST_TEXTS = 5, 9, 10
MOST_CODES = 500_000


class Codes(dict):
    """Fixed-width code of each word, remembered for at most MOST_CODES words."""

    def __missing__(self, word: bytes) -> bytes:
        if len(self) >= MOST_CODES:
            self.clear()
        stem = word.decode("utf-8", "replace")[:STEM].encode()
        code = self[word] = half(word) + half(b"\0" + stem)
        return code


def half(part: bytes) -> bytes:
    return hashlib.blake2b(part, digest_size=CODE // 2).digest()


def halves(codes: list[bytes]) -> set[bytes]:
    return {c[k : k + CODE // 2] for c in codes for k in (0, CODE // 2)}


def windows(codes: list[bytes]) -> list[bytes]:
    return [b"".join(codes[i : i + WORDS]) for i in range(0, len(codes), WORDS)] or [b""]


def trained(samples: list[bytes], size: int) -> bytes:
    """Content of a trained dictionary; of fewer samples than training takes, the samples themselves."""
    samples = [s for s in samples if len(s) >= 8]
    try:
        return zstandard.train_dictionary(min(size, max(256, sum(map(len, samples)) // 8)), samples).as_bytes()
    except zstandard.ZstdError:
        return b"".join(samples)[-size:]


def compressor(content: bytes):
    parameters = zstandard.ZstdCompressionParameters.from_level(LEVEL, source_size=WORDS * CODE, dict_size=len(content), write_content_size=False, write_checksum=False, write_dict_id=False)
    if len(content) < 8:
        return zstandard.ZstdCompressor(compression_params=parameters).compress
    known = zstandard.ZstdCompressionDict(content, dict_type=zstandard.DICT_TYPE_RAWCONTENT)
    known.precompute_compress(compression_params=parameters)
    return zstandard.ZstdCompressor(dict_data=known, compression_params=parameters).compress


class Distances:
    """Compresses windows with both dictionaries."""

    def __init__(self, toxic: bytes, ordinary: bytes):
        filler = np.random.default_rng(5).integers(0, 256, len(toxic), dtype=np.uint8).tobytes()
        self.toxic, self.ordinary = compressor(ordinary + toxic), compressor(ordinary + filler)
        self.codes = Codes()

    def recode(self, text: bytes) -> list[bytes]:
        codes = self.codes
        return [codes[w] for w in words_of(text)]

    def features(self, text: bytes) -> list[float]:
        """Largest distances, and how many windows pass each threshold, of the whole text."""
        toxic, ordinary = self.toxic, self.ordinary
        d = np.array([len(ordinary(w)) - len(toxic(w)) for w in windows(self.recode(text))])
        d[::-1].sort()
        n = len(d)
        passed = [int(np.count_nonzero(d >= k)) for k in THRESHOLDS]
        return [*d[:4].tolist(), *[0.0] * max(0, 4 - n), *np.log1p(passed), np.log(n), *(p / n for p in passed)]


@dataclass
class Model:
    toxic: bytes
    ordinary: bytes
    calibration: Calibration | None
    base: float

    def scorer(self):
        distances = Distances(self.toxic, self.ordinary)

        def score(texts: list[bytes]) -> np.ndarray:
            if self.calibration is None:
                return np.full(len(texts), self.base)
            return self.calibration(np.array([distances.features(t) for t in texts], float).reshape(len(texts), -1))

        return score


def fit(toxic: list[bytes], ordinary: list[bytes], toxic_share: float | None = None) -> Model:
    """Without enough texts of both classes the score is the share of toxic ones."""
    base = len(toxic) / max(1, len(toxic) + len(ordinary)) if toxic_share is None else toxic_share
    a, b = int(len(toxic) * FIT_SHARE), int(len(ordinary) * FIT_SHARE)
    if a < 2 or b < 2:
        return Model(b"", b"", None, base)
    codes = Codes()
    recode = lambda t: [codes[w] for w in words_of(t)]
    in_toxic, in_ordinary = Counter(), Counter()
    for t in toxic[:a]:
        in_toxic.update(halves(recode(t)))
    for t in ordinary[:b]:
        in_ordinary.update(halves(recode(t)))

    def apart(c: bytes) -> bool:
        x, y = in_toxic[c], in_ordinary[c]
        p = (x + y) / (a + b)
        error = np.sqrt(p * (1 - p) * (1 / a + 1 / b)) + 1e-12
        return x >= LEAST_TEXTS and (x + 0.5) / a > LIFT * (y + 0.5) / b and (x / a - y / b) / error > SIGMAS

    telling = {c for c in in_toxic if apart(c)}
    passages: list[bytes] = []
    for t in toxic[:a]:
        run = [c for c in recode(t) if not telling.isdisjoint((c[: CODE // 2], c[CODE // 2 :]))]
        passages += [b"".join(run[i : i + 8]) for i in range(0, len(run), 8)]
    plain = [w for t in ordinary[:b] for w in windows(recode(t))]
    plain = [plain[i] for i in np.random.default_rng(0).permutation(len(plain))[:120_000]]
    model = Model(trained(passages, TOXIC_BYTES), trained(plain, ORDINARY_BYTES), None, base)
    distances = Distances(model.toxic, model.ordinary)
    x = np.array([distances.features(t) for t in toxic[a:] + ordinary[b:]], float)
    y = np.r_[np.ones(len(toxic) - a), np.zeros(len(ordinary) - b)]
    model.calibration = Calibration(x, y)
    if 0 < base < 1 and len(toxic) > a:  # the sample is richer in toxic texts than the labels
        odds = (base / (1 - base)) / ((len(toxic) - a) / max(1, len(ordinary) - b))
        model.calibration.weights[-1] += np.log(odds)
    return model


def train(docs: DataFrame, labels: DataFrame, label: str = "toxic", id_col: str = "doc_id", text_col: str = "text", toxic_rows: int = TOXIC_ROWS, ordinary_rows: int = ORDINARY_ROWS) -> Model:
    """Fit on at most ``toxic_rows`` + ``ordinary_rows`` labelled texts (of bounded length), none of the held-out fold."""
    known = learnable(labels, label, fold(F.col(id_col), FOLDS) == HELD_OUT, id_col)
    n, n_toxic = known.agg(F.count("label"), F.coalesce(F.sum("label"), F.lit(0))).first()
    ids = union_all([smallest_ids(known.where(f"label = {k}"), most, id_col).withColumn("label", F.lit(k)) for k, most in ((1, toxic_rows), (0, ordinary_rows))])
    rows = sample_texts(docs, ids.groupBy("id").agg(F.max("label").alias("label")), id_col, text_col).collect()
    rows.sort(key=lambda r: hashlib.blake2b(str(r["id"]).encode()).digest())
    by = {k: [r["text"].encode() for r in rows if r["label"] == k] for k in (0, 1)}
    return fit(by[1], by[0], n_toxic / n if n else 0.0)


def score(docs: DataFrame, model: Model, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """id, score double for each row.

    Null and empty texts have one empty window. Very long texts are scored whole, window by window. Repeated rows are scored
    each, alike; a null id is passed on. Other columns are ignored, nothing is shuffled. An empty table gives an empty result.
    """
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scorer = shared.value.scorer()
        for batch in batches:
            scores = [float(scorer([t.as_buffer().to_pybytes() if t.is_valid else b""])[0]) for t in batch.column(1)]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(scores, pa.float64())], names=["id", "score"])

    kind = docs.schema[id_col].dataType.simpleString()
    return docs.select(F.col(id_col).alias("id"), F.col(text_col).cast("string").alias("text")).transform(arrow_map, run, f"id {kind}, score double").withColumnRenamed("id", id_col)
