import random

import pytest

COLUMNS = "doc_id bigint, text string, lang string, source string, n_chars bigint"


def prose(rng, n, words=60):
    vocabulary = ["".join(rng.choice("abcdefghijklmnop") for _ in range(rng.randint(2, 7))) for _ in range(words)]
    return " ".join(rng.choice(vocabulary) for _ in range(n))


@pytest.fixture(scope="session")
def rows():
    """Nulls, empty, blank and very long texts, exact and near copies, repeated rows, shared lines and passages."""
    rng = random.Random(5)
    base = [prose(rng, rng.randint(5, 120), 400) for _ in range(30)]
    passage = prose(rng, 60, 400)
    texts = [*base, *base[:6], base[0], base[0]]
    texts += [t + " " + passage for t in base[6:12]]
    for t in base[12:18]:
        w = t.split()
        w[len(w) // 2] = "changed"
        texts.append(" ".join(w))
    texts += [None, None, "", "   ", "\n", "a", "a b", "A B", "aaaa" * 200, "é😀 日本 " * 90, "x " * 500, prose(rng, 30_000, 900)]
    texts += ["\n".join([f"line {i % 7}", "shared line", prose(rng, 8), "", "shared line"]) for i in range(24)]
    out = [(i, t, "en", f"s{i % 12}" if i % 13 else None, None) for i, t in enumerate(texts)]
    return [*out, out[3], (None, base[4], None, None, 3), (None, None, None, None, None)]


@pytest.fixture(scope="session")
def docs(spark, rows):
    return spark.createDataFrame(rows, COLUMNS).repartition(5).cache()


@pytest.fixture(scope="session")
def clashing(docs):
    """The same rows with columns named like those that operators use inside."""
    from pyspark.sql import functions as F

    names = ["id", "t", "row", "digest", "n", "a", "b", "label", "line", "pos", "spans", "hits", "__doc", "key", "shard", "first"]
    return docs.select(*docs.columns, *[F.lit("x").alias(c) for c in names])


@pytest.fixture(scope="session")
def empty(spark):
    return spark.createDataFrame([], COLUMNS)
