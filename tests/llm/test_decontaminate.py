import random
import re

import pytest

from foliospark.llm import decontaminate as dc

WORD = re.compile(rb"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")


def words(t):
    return WORD.findall(re.sub(rb"[A-Z]", lambda m: m[0].lower(), (t or "").encode()))


def brute(text, items, window):
    w = words(text)
    hit, found = set(), set()
    for item, t in items:
        x = words(t)
        if not x or item is None:
            continue
        n = min(window, len(x))
        wins = {tuple(x[k : k + n]) for k in range(len(x) - n + 1)}
        for k in range(len(w) - n + 1):
            if tuple(w[k : k + n]) in wins:
                hit |= set(range(k, k + n))
                found.add(str(item))
    return len(w), len(hit), sorted(found)


@pytest.mark.parametrize("block_words", [2_000_000, 12])
def test_against_brute_force(spark, block_words):
    rng = random.Random(3)
    text = lambda n, v: " ".join(rng.choice(["a", "B", "cc", "d", "é", "1"][:v]) + rng.choice(["", ",", "-x"]) for _ in range(n))
    items = [(i, text(rng.randint(0, 14), rng.randint(2, 6))) for i in range(25)] + [(25, None), (None, "a b c"), (26, "zz"), (3, "again zz")]
    rows = [(i, text(rng.randint(0, 60), rng.randint(1, 6)), "x") for i in range(120)] + [(120, None, "x"), (120, None, "x"), (None, "zz", "x"), (121, "", "x")]
    frame = spark.createDataFrame(rows, "doc_id bigint, text string, hits string").repartition(3)
    bench = spark.createDataFrame(items, "item_id bigint, text string")
    for window in (4, 10):
        found = sorted(((r.doc_id is None, r.doc_id or 0, r.n_words, sum(h.last - h.first for h in r.hits), r["items"]) for r in dc.find_contamination(frame, bench, window=window, block_words=block_words).collect()))
        assert found == sorted((i is None, i or 0, *brute(t, items, window)) for i, t, _ in rows)


def test_no_items_and_no_documents(spark, docs, empty):
    none = spark.createDataFrame([], "item_id bigint, text string")
    assert all(not r.hits and not r["items"] for r in dc.find_contamination(docs, none).collect())
    assert dc.find_contamination(empty, none).count() == 0
    assert dc.decontaminate(empty, none).count() == 0


def test_spans_are_cut_and_mostly_benchmark_text_goes(spark):
    item = "one two three four five six seven eight nine ten eleven"
    long = " ".join(f"w{i}" for i in range(30))
    rows = [(1, f"Start, {item.upper()}! {long}", "x"), (2, item, "x"), (3, None, "x"), (4, "clean", "x")]
    frame = spark.createDataFrame(rows, "doc_id bigint, text string, note string")
    bench = spark.createDataFrame([(7, item)], "item_id bigint, text string")
    assert {r.doc_id: r.text for r in dc.decontaminate(frame, bench).collect()} == {1: f"Start, {long}", 3: None, 4: "clean"}
    more = bench.unionByName(spark.createDataFrame([(8, " ".join(f"v{i}" for i in range(45)))], "item_id bigint, text string"))
    assert {r.doc_id: r.text for r in dc.decontaminate(frame, more, block_words=20).collect()} == {1: f"Start, {long}", 3: None, 4: "clean"}


def test_an_automaton_of_a_block_stays_small():
    rng = random.Random(1)
    items = [(str(i), [b"%d" % rng.randrange(20_000) for _ in range(100)]) for i in range(500)]
    automaton = dc.SuffixAutomaton(items, dc.WINDOW)
    assert automaton.nbytes() < 400 * 50_000 / 4  # under a hundred bytes a word
    for item, words in items[:50]:
        assert automaton.match(words) == ([(0, 100)], {item})


def test_long_items_are_cut_without_losing_windows(spark):
    words = [f"w{i}" for i in range(70)]
    bench = spark.createDataFrame([(1, " ".join(words)), (2, "a b"), (3, None)], "item_id bigint, text string")
    blocks = list(dc.item_blocks(bench, "item_id", "text", 25, 10))
    windows = {tuple(w[k : k + 10]) for b in blocks for i, w in b if i == "1" for k in range(len(w) - 9)}
    assert windows == {tuple(x.encode() for x in words[k : k + 10]) for k in range(61)} and ("2", [b"a", b"b"]) in blocks[-1]
    assert all(sum(len(w) for _, w in b) <= 25 for b in blocks)
