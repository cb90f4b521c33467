import random
from collections import Counter

import numpy as np
import pytest

from foliospark.llm import substring_dedup as sd
from foliospark.llm import suffix_array as sx


def sorted_suffixes(t, cap):
    order = sorted(range(len(t)), key=lambda i: t[i:])
    common = [0]
    for a, b in zip(order, order[1:], strict=False):
        k = 0
        while k < cap and max(a, b) + k < len(t) and t[a + k] == t[b + k]:
            k += 1
        common.append(k)
    return order, common


@pytest.mark.parametrize(("queue", "mapped"), [(96_000_000, 64_000_000), (64, 16)])
def test_suffix_array_and_prefixes(monkeypatch, queue, mapped):
    monkeypatch.setattr(sx, "QUEUE_BYTES", queue)
    monkeypatch.setattr(sx, "TEXT_BYTES", mapped)
    rng = random.Random(0)
    for _ in range(250):
        n, s, cap = rng.randint(0, 60), rng.choice([1, 2, 3, 5, 30]), rng.choice([3, 10, 200])
        t = [rng.randint(1, s) for _ in range(n)]
        t = ((t * 3)[:90] if rng.random() < 0.3 else t) + [0]
        chunks = list(sx.suffix_array(np.array(t, rng.choice([np.uint8, np.uint16])), cap, base_names=rng.choice([1, 3, 10**6])))
        at = np.concatenate([a for a, _ in chunks])[::-1].tolist()
        order, common = sorted_suffixes(t, cap)
        assert sorted(at) == list(range(len(t))) and [t[i : i + cap] for i in at] == [t[i : i + cap] for i in order]
        assert np.concatenate([p for _, p in chunks])[::-1].tolist() == common


def brute(rows, length):
    texts = [(t or "").encode() for _, t, *_ in rows]
    seen = Counter(t[k : k + length] for t in texts for k in range(len(t) - length + 1))
    out = []
    for (i, *_), t in zip(rows, texts, strict=True):
        gone = np.zeros(len(t) + 1, int)
        for k in range(len(t) - length + 1):
            if seen[t[k : k + length]] > 1:
                gone[k] += 1
                gone[k + length] -= 1
        gone = np.cumsum(gone)[:-1] > 0
        out.append((i, len(t), int(gone.sum()), int((np.diff(np.concatenate(([0], gone.astype(int)))) == 1).sum()), bytes(np.frombuffer(t, np.uint8)[~gone])))
    return Counter(out)


@pytest.mark.parametrize("length", [200, 40])
def test_cut_matches_brute_force(rows, clashing, length):
    found = sd.cut_repeats(clashing, length=length, shard_bytes=20_000).collect()
    short = [r for r in rows if len(r[1] or "") < 20_000]
    expected = brute(rows if length == 200 else short, length) if length == 200 else None
    got = Counter((r.doc_id, r.n_bytes, r.n_removed, r.n_spans, bytes(r.kept)) for r in found)
    if expected is not None:
        assert got == expected
    else:
        assert sum(r.n_removed for r in found) > 0 and all(len(r.kept) == r.n_bytes - r.n_removed for r in found)


def test_long_texts_are_cut_into_overlapping_parts(spark, monkeypatch):
    monkeypatch.setattr(sd, "BLOCK_BYTES", 700)
    rng = random.Random(4)
    part = "".join(rng.choice("abcdef ") for _ in range(900))
    rows = [(1, "".join(rng.choice("abcdef ") for _ in range(3000)) + part), (2, part + "tail"), (3, "ab" * 700), (4, "z" * 1500)]
    import pyarrow as pa

    column = pa.array([t for _, t in rows])
    windows = Counter()
    for block in sd.pieces(column, 200):
        piece, at, count, *_ = sd.segments(block, 200)
        for p, a, n in zip(piece, at, count, strict=True):
            row, offset, _ = block[p]
            windows.update((row, offset + a + k) for k in range(n))
    assert windows == Counter((r, k) for r, (_, t) in enumerate(rows) for k in range(len(t) - 199))


def test_empty_table(empty):
    assert sd.cut_repeats(empty).count() == 0


def test_key_gram_that_also_stands_before_one_copy_of_the_passage(spark):
    rng = random.Random(5)
    text = lambda n: "".join(rng.choice("abcdefghij ") for _ in range(n))
    rows = []
    for i in range(0, 80, 2):
        passage = text(260)
        rows += [(i, text(300) + passage + text(300)), (i + 1, text(300) + passage[90:170] + passage + text(300))]
    frame = spark.createDataFrame(rows, "doc_id bigint, text string")
    assert Counter((r.doc_id, r.n_bytes, r.n_removed, r.n_spans, bytes(r.kept)) for r in sd.cut_repeats(frame).collect()) == brute(rows, 200)


def test_suffix_array_comes_out_while_it_is_made(monkeypatch):
    left = []
    monkeypatch.setattr(sx.SymbolQueue, "close", lambda self: left.append(self))
    text = np.append(np.random.default_rng(6).integers(1, 20, 500), 0).astype(np.uint8)
    chunks = sx.suffix_array(text, 10)
    next(chunks)
    before = len(left)  # the first induction, of S* substrings, is over
    assert len(list(chunks)) > 1 and len(left) == before + 2
