import itertools
import random
import re
import time

import numpy as np

from foliospark.llm import common, components, ngram_join


def shingle_set(t):
    w = re.findall(rb"[^\x20\x09-\x0D]+", re.sub(rb"[A-Z]", lambda m: m[0].lower(), (t or "").encode()))
    return frozenset(tuple(w[k : k + 5]) for k in range(len(w) - 4)) if len(w) >= 5 else frozenset([tuple(w)] if w else [])


def brute(rows):
    sets = [(i, shingle_set(t)) for i, t, *_ in rows]
    parent = {i: i for i, _ in sets if i is not None}

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for (i, x), (j, y) in itertools.combinations([s for s in sets if s[0] is not None and s[1]], 2):
        if 100 * len(x & y) >= 80 * len(x | y):
            a, b = sorted((find(i), find(j)))
            parent[b] = a
    return sorted((i is None, i or 0, len(s), find(i) if i is not None else None) for i, s in sets)


def result(frame):
    return sorted((r.doc_id is None, r.doc_id or 0, r.n_shingles, r.component_id) for r in ngram_join.similar_components(frame).collect())


def test_against_brute_force(rows, docs, clashing, empty):
    expected = brute(rows)
    assert result(clashing) == expected
    assert result(empty) == []


def test_chains_thresholds_and_large_groups(spark, monkeypatch):
    rng = random.Random(8)
    base = [f"w{i}" for i in range(120)]
    rows, w = [], list(base)
    for k in range(40):  # a drifting chain: neighbours are alike, ends are not
        rows.append((k, " ".join(w)))
        w[rng.randrange(len(w))] = f"x{k}"
    for k in range(60):  # copies of one text with a few changes each
        v = list(base[::-1])
        for _ in range(rng.randint(0, 3)):
            v[rng.randrange(len(v))] = f"y{rng.randrange(99)}"
        rows.append((100 + k, " ".join(v)))
    rows += [(200 + k, " ".join(base[:40]) + " " + " ".join(f"z{k}_{i}" for i in range(rng.randint(5, 200)))) for k in range(30)]
    frame = spark.createDataFrame(rows, "doc_id bigint, text string").repartition(3)
    assert result(frame) == brute(rows)
    monkeypatch.setattr(ngram_join, "MOST_BROADCAST", 3)
    monkeypatch.setattr(ngram_join, "ROUNDS", 1)
    assert result(frame) == brute(rows)


def test_shingles_of_blocks():
    texts = ["", "a", "A a", "a b c d e f", " \t\n", "é b c d e", "x" * 50]
    raw = [t.encode() for t in texts]
    data, at = np.frombuffer(b"".join(raw), np.uint8), np.concatenate(([0], np.cumsum([len(r) for r in raw])))
    d, h = ngram_join.shingles(data, at)
    assert np.bincount(d, minlength=len(texts)).tolist() == [len(shingle_set(t)) for t in texts]


def test_components(spark):
    rng = random.Random(2)
    links = [(rng.randrange(60), rng.randrange(60)) for _ in range(45)] + [(100 + i, 101 + i) for i in range(40)] + [(200, 201 + i) for i in range(50)] + [(5, 5), (None, 3)]
    parent = {}
    find = lambda x: x if parent.setdefault(x, x) == x else find(parent[x])
    for a, b in links:
        if a is not None and a != b:
            x, y = sorted((find(a), find(b)))
            parent[y] = x
    found = {r.v: r.label for r in components.connected_components(spark.createDataFrame(links, "a bigint, b bigint")).collect()}
    assert found == {v: find(v) for v in list(parent)}


def test_keep_one_keeps_the_least_id_and_null_ids(rows, clashing):
    least = {c for is_null, i, _, c in brute(rows) if not is_null and c == i}
    kept = [r.doc_id for r in ngram_join.keep_one(clashing).collect()]
    assert {i for i in kept if i is not None} == least and kept.count(None) == 2


def shuffle_files(spark):
    files = spark._jvm.org.apache.spark.SparkEnv.get().blockManager().diskBlockManager().getAllFiles().mkString("\n")
    return {f for f in files.split("\n") if "/shuffle_" in f}


def test_a_written_table_leaves_no_shuffle_files(spark):
    spark.conf.set(common.CLEANUP, "false")
    before = shuffle_files(spark)
    rows = spark.range(5_000).selectExpr("id", "id % 7 AS k").repartition(3, "k")
    table = common.materialize(rows.join(rows.groupBy("k").count(), "k"), "joined")
    for _ in range(20):  # files are deleted behind the call
        if not (left := shuffle_files(spark) - before):
            break
        time.sleep(0.2)
    assert not left and table.count() == 5_000
    assert spark.conf.get(common.CLEANUP) == "false"
    spark.conf.unset(common.CLEANUP)
