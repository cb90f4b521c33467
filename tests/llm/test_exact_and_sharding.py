import hashlib
from collections import Counter, defaultdict

import numpy as np
from pyspark.sql import functions as F

from foliospark.llm import common, exact_dedup, sharding


def brute(rows):
    groups = defaultdict(list)
    for i, t, *_ in rows:
        groups[t or ""].append(i)
    out = []
    for t, ids in groups.items():
        keep = max((i for i in ids if i is not None), default=None)
        sha = hashlib.sha256(t.encode()).hexdigest()
        rest = list(ids)
        rest.remove(keep)
        out += [(keep, keep, len(ids), True, sha), *((i, keep, len(ids), False, sha) for i in rest)]
    return Counter(out)


def test_exact_dedup_matches_brute_force(rows, docs, clashing):
    for frame, support in ((docs, 1 / 500), (clashing, 0.02), (docs, 0.4)):
        assert Counter(tuple(r) for r in exact_dedup.exact_dedup(frame, support=support).collect()) == brute(rows)


def test_heavy_hitter_is_answered_without_a_shuffle_of_its_rows(spark):
    frame = spark.range(4000).select(F.col("id").alias("doc_id"), F.when(F.col("id") % 2 == 0, "hot").otherwise(F.col("id").cast("string")).alias("text"))
    found = exact_dedup.exact_dedup(frame).where("text_sha256 = sha2('hot', 256)").agg(F.count("doc_id"), F.max("keep_id"), F.min("group_size"), F.sum(F.col("kept").cast("int"))).first()
    assert tuple(found) == (2000, 3998, 2000, 1)


def test_empty_tables(empty):
    assert exact_dedup.exact_dedup(empty).count() == 0
    assert sharding.assign_shards(empty).count() == 0


def test_release_deletes_scratch_tables(spark):
    frame = common.materialize(spark.range(3).toDF("x"), "t")
    assert frame.count() == 3
    common.release(spark)
    assert not [x for x in common._made if x[0] is spark]


def jump(key, n):
    b, j = -1, 0
    while j < n:
        b = j
        key = (key * 2862933555777941757 + 1) % (1 << 64)
        j = int((b + 1) * (float(1 << 31) / ((key >> 33) + 1)))
    return b


def test_jump_hash_moves_rows_only_into_the_new_shard():
    keys = np.random.default_rng(0).integers(-(1 << 63), 1 << 63, 5000, dtype=np.int64)
    for n in (1, 2, 40, 1000):
        now, grown = sharding.jump_hash(keys, n), sharding.jump_hash(keys, n + 1)
        assert now.tolist() == [jump(int(k) % (1 << 64), n) for k in keys]
        assert ((now == grown) | (grown == n)).all()
        assert abs((now != grown).mean() - 1 / (n + 1)) < 0.03
    assert sharding.jump_hash(keys[:0], 3).tolist() == []


def test_slots_are_gapless_and_sizes_right(rows, docs):
    found = sharding.assign_shards(docs, rows_per_block=2).collect()
    assert len(found) == len(rows)
    slots = defaultdict(list)
    for r in found:
        slots[r.shard].append(r.slot)
        assert r.law == "key" and r.grown_shard in (r.shard, 40)
    assert all(sorted(s) == list(range(len(s))) for s in slots.values())
    assert Counter((r.doc_id, r.size) for r in found) == Counter((i, len((t or "").encode()) + 16) for i, t, *_ in rows)
