import random
import tracemalloc
from zlib import crc32

import numpy as np
import pytest
from pyspark.sql import functions as F

from foliospark.llm import quality, toxicity
from foliospark.llm.common import fold


def auc(scores, labels):
    s, y = np.array(scores), np.array(labels)
    return np.mean([(a > b) + 0.5 * (a == b) for a in s[y == 1] for b in s[y == 0]])


@pytest.fixture(scope="module")
def made(spark):
    rng = random.Random(6)
    vocabulary = ["".join(rng.choice("abcdefghijklmnop") for _ in range(rng.randint(2, 7))) for _ in range(300)]
    rows, labels = [], []
    for i in range(900):
        words = [rng.choice(vocabulary) for _ in range(rng.randint(30, 150))]
        good, toxic = rng.random() < 0.8, rng.random() < 0.3
        if toxic:
            for _ in range(max(2, len(words) // 25)):
                words.insert(rng.randrange(len(words)), rng.choice(["zzidiot", "qqscum", "yyloser"]))
        if not good:
            words = [w.upper() + "!!" for w in words]
        rows.append((i, " ".join(words), "x"))
        if rng.random() < 0.7:
            labels.append((i, int(good), int(toxic)))
    rows += [(900, None, "x"), (901, "", "x"), (None, "abc", "x"), (5, rows[5][1], "x"), (902, "word " * 200_000, "x")]
    labels += [(900, None, None), (None, 1, 1), (9999, 1, 0)]
    return spark.createDataFrame(rows, "doc_id bigint, text string, score string").repartition(4), spark.createDataFrame(labels, "doc_id bigint, quality int, toxic int"), dict((i, (q, t)) for i, q, t in labels)


def test_folds(spark):
    found = spark.range(50).select("id", fold(F.col("id"), 3).alias("f")).collect()
    assert all(r.f == crc32(str(r.id).encode()) % 3 for r in found)


def test_quality_on_held_out_rows(made):
    docs, labels, known = made
    scorer = quality.train(docs, labels)
    assert 0.65 < scorer.prior < 0.95
    found = quality.score(docs, scorer).collect()
    assert len(found) == docs.count() and all(0 <= r.score <= 1 for r in found)
    held = [(r.score, known[r.doc_id][0]) for r in found if r.doc_id in known and known[r.doc_id][0] is not None and crc32(str(r.doc_id).encode()) % 3 == 1]
    assert auc(*zip(*held, strict=True)) > 0.97
    kept = quality.keep_good(docs, scorer)
    assert kept.columns == docs.columns and kept.count() == sum(r.score >= 0.5 for r in found)


def test_toxicity_on_held_out_rows(made):
    docs, labels, known = made
    found = toxicity.score(docs, toxicity.train(docs, labels)).collect()
    assert len(found) == docs.count() and all(0 <= r.score <= 1 for r in found)
    held = [(r.score, known[r.doc_id][1]) for r in found if r.doc_id in known and known[r.doc_id][1] is not None and crc32(str(r.doc_id).encode()) % 4 == 2]
    assert auc(*zip(*held, strict=True)) > 0.9


def test_without_labels_or_documents(spark, made, empty):
    docs, labels, _ = made
    none = labels.limit(0)
    assert {r.score for r in quality.score(docs, quality.train(docs, none)).collect()} == {0.5}
    assert {r.score for r in toxicity.score(docs, toxicity.train(docs, none)).collect()} == {0.0}
    assert quality.score(empty, quality.train(empty, labels)).count() == 0
    assert toxicity.score(empty, toxicity.train(empty, labels)).count() == 0


def test_non_negative_risk_finds_the_positives():
    rng = np.random.default_rng(0)
    p, n = rng.normal(2, 1, (1500, 5)).astype(np.float32), rng.normal(-2, 1, (600, 5)).astype(np.float32)
    u = np.concatenate([rng.normal(2, 1, (1400, 5)).astype(np.float32), n])
    scorer = quality.fit(p, u)
    assert abs(scorer.prior - 0.7) < 0.08
    assert (scorer(p) > 0.5).mean() > 0.95 and (scorer(n) < 0.5).mean() > 0.95


def test_quality_fit_takes_little_more_than_a_copy_of_its_rows():
    rng = np.random.default_rng(4)
    positive, unlabelled = ((rng.random((n, quality.WIDTH), np.float32) < 0.1).astype(np.float32) for n in (1_500, 2_500))
    both = np.concatenate([positive, unlabelled])
    mean, deviation = quality.moments(positive, unlabelled)
    assert np.array_equal(mean, both.mean(0)) and np.array_equal(deviation, both.std(0))
    assert np.array_equal(quality.unpacked(quality.packed(positive)), positive)
    assert sum(map(len, quality.packed(positive))) < 0.5 * positive.nbytes
    del both
    tracemalloc.start()
    quality.fit(positive, unlabelled, epochs=1)
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert peak < 1.6 * (positive.nbytes + unlabelled.nbytes)
