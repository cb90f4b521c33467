"""Benchmark decontamination with a generalised suffix automaton of the test items.

The items are normalised to words and inserted into one automaton per block of at most ``BLOCK_WORDS`` item words, coded in
arrays (24 bytes a state, 12 a further transition), so what a task holds has a fixed size however many items there are.
Each document streams through an automaton once: the state after a word is the longest suffix of the words so far that
occurs in some item. States know which item windows end in them, so a match yields both the hit words and the items.

Benchmarks of one block, which is the usual case, need one pass and no shuffle. More blocks take a pass each, so that no task
holds two automata; only hits are then gathered, by document.

A window is ``window`` consecutive words of an item; a shorter item, unless empty, is one window.
"""

from __future__ import annotations

import hashlib
from array import array
from bisect import bisect_left
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import Broadcast
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import arrow_map, fresh, materialize, union_all

WINDOW = 10
BLOCK_WORDS = 500_000

#: A-Z become a-z; ASCII letters and digits and all bytes from 0x80 on are word bytes, others separate.
_WORD_BYTES = set(range(0x30, 0x3A)) | set(range(0x41, 0x5B)) | set(range(0x61, 0x7B)) | set(range(0x80, 0x100))
_NORMAL = bytes((b + 32 if 0x41 <= b <= 0x5A else b) if b in _WORD_BYTES else 0x20 for b in range(256))


def words_of(text: bytes) -> list[bytes]:
    return text.translate(_NORMAL).split()


class SuffixAutomaton:
    """Generalised suffix automaton over word numbers; also the item windows that end in each state.

    ``code`` and ``after`` hold a state's first transition, ``keys`` and ``targets`` all others by (state, word); those of
    the root are in ``root``. ``size`` and ``item`` hold the window that a state ends, if any: an item's number, or -1 and below
    for the entry -1 - item of ``several``, pairs of size and item numbers. ``up`` is the nearest state with windows on the way
    to the root.
    """

    def __init__(self, items: list[tuple[str, list[bytes]]], window: int):
        self.vocabulary: dict[bytes, int] = {}
        self.names = sorted({item for item, _ in items})
        number = {name: k for k, name in enumerate(self.names)}
        self.shortest = min((min(len(w), window) for _, w in items if w), default=window)
        self.code, self.after, self.link, self.length = array("i", [-1]), array("i", [-1]), array("i", [-1]), array("i", [0])
        self._more: dict[int, int] = {}  # further transitions by state << 32 | word
        self._words: dict[int, list[int]] = {}  # the words of a state's further transitions
        coded = [(number[item], array("i", [self.vocabulary.setdefault(w, len(self.vocabulary)) for w in words])) for item, words in items]
        for _, codes in coded:
            last = 0
            for c in codes:
                last = self._extend(last, c)
        ended: dict[int, object] = {}  # of a state: size << 32 | item, or a set of them
        for item, codes in coded:
            n = min(window, len(codes))
            state = 0
            for k, c in enumerate(codes):
                state = self._get(state, c)
                while state and self.length[self.link[state]] >= n:
                    state = self.link[state]
                if k + 1 >= n:
                    own, known = n << 32 | item, ended.get(state)
                    if known is None:
                        ended[state] = own
                    elif isinstance(known, set):
                        known.add(own)
                    elif known != own:
                        ended[state] = {known, own}
        states = len(self.code)
        self.size, self.item, self.several = array("i", bytes(4 * states)), array("i", bytes(4 * states)), []
        for state, own in ended.items():
            if isinstance(own, set):
                self.size[state], self.item[state] = max(own) >> 32, -1 - len(self.several)
                self.several.append(sorted(((x >> 32, x & 0xFFFFFFFF) for x in own), reverse=True))
            else:
                self.size[state], self.item[state] = own >> 32, own & 0xFFFFFFFF
        ended.clear()
        self.up = array("i", bytes(4 * states))
        for state in np.argsort(np.frombuffer(self.length, np.int32), kind="stable")[1:].tolist():
            self.up[state] = state if self.size[state] else self.up[self.link[state]]
        self.root = array("i", [self._get(0, c) for c in range(len(self.vocabulary))])
        by_key = sorted(k for k in self._more if k >> 32)
        self.keys, self.targets = array("q", by_key), array("i", [self._more[k] for k in by_key])
        del self._more, self._words

    def _get(self, state: int, c: int) -> int | None:
        return self.after[state] if self.code[state] == c else self._more.get(state << 32 | c)

    def _put(self, state: int, c: int, to: int) -> None:
        if self.code[state] in (-1, c):
            self.code[state], self.after[state] = c, to
        else:
            if (key := state << 32 | c) not in self._more:
                self._words.setdefault(state, []).append(c)
            self._more[key] = to

    def _add(self, length: int, link: int) -> int:
        for column, value in ((self.code, -1), (self.after, -1), (self.link, link), (self.length, length)):
            column.append(value)
        return len(self.code) - 1

    def _extend(self, last: int, c: int) -> int:
        """The state of the prefix that ends with ``c``, after that of the prefix before it."""
        known = self._get(last, c)
        if known is not None:
            return known if self.length[known] == self.length[last] + 1 else self._clone(last, c, known)
        new = self._add(self.length[last] + 1, 0)
        p = last
        while p >= 0 and (known := self._get(p, c)) is None:
            self._put(p, c, new)
            p = self.link[p]
        if p >= 0:
            self.link[new] = known if self.length[known] == self.length[p] + 1 else self._clone(p, c, known)
        return new

    def _clone(self, p: int, c: int, q: int) -> int:
        clone = self._add(self.length[p] + 1, self.link[q])
        self.link[q] = clone
        if self.code[q] >= 0:
            self._put(clone, self.code[q], self.after[q])
        for word in self._words.get(q, ()):
            self._put(clone, word, self._more[q << 32 | word])
        while p >= 0 and self._get(p, c) == q:
            self._put(p, c, clone)
            p = self.link[p]
        return clone

    def nbytes(self) -> int:
        """Bytes of the arrays, and of the words about."""
        columns = (self.code, self.after, self.link, self.length, self.size, self.item, self.up, self.root, self.keys, self.targets)
        return sum(x.itemsize * len(x) for x in columns) + sum(len(w) + 130 for w in self.vocabulary) + 100 * sum(map(len, self.several))

    def match(self, words: list[bytes]) -> tuple[list[tuple[int, int]], set[str]]:
        """Merged half-open runs of hit words, and the items with a window in ``words``."""
        runs: list[list[int]] = []
        found: set[int] = set()
        state = length = 0
        code, after, link, longest_of, up, root, keys, targets, shortest = self.code, self.after, self.link, self.length, self.up, self.root, self.keys, self.targets, self.shortest
        last_key = len(keys)
        for k, c in enumerate(map(self.vocabulary.get, words)):
            if c is None:
                state = length = 0
                continue
            while state:
                if code[state] == c:
                    state = after[state]
                    length += 1
                    break
                key = state << 32 | c
                at = bisect_left(keys, key)
                if at < last_key and keys[at] == key:
                    state = targets[at]
                    length += 1
                    break
                state = link[state]
                length = longest_of[state]
            else:
                state, length = root[c], 1
            if length >= shortest and up[state]:
                longest = self._windows(state, length, found)
                if longest:
                    start = k + 1 - longest
                    while runs and runs[-1][1] >= start:  # an earlier run that touches or overlaps
                        start = min(start, runs.pop()[0])
                    runs.append([start, k + 1])
        return [(a, b) for a, b in runs], {self.names[i] for i in found}

    def _windows(self, state: int, length: int, found: set[int]) -> int:
        """Adds the items of all windows of at most ``length`` words that end in a state; the longest size of them, or 0."""
        longest = 0
        state = self.up[state]
        while state > 0:
            item = self.item[state]
            for n, i in [(self.size[state], item)] if item >= 0 else self.several[-1 - item]:
                if n <= length:
                    longest = max(longest, n)
                    found.add(i)
            state = self.up[self.link[state]]
        return longest


def word_spans(text: bytes) -> list[tuple[int, int]]:
    """Byte span of each word of ``words_of(text)``."""
    if not text:
        return []
    inside = np.frombuffer(text.translate(_NORMAL), np.uint8) != 0x20
    # str.split also cuts at other ASCII white space, but those bytes are separators already
    edge = np.flatnonzero(np.diff(np.concatenate(([False], inside, [False])).astype(np.int8)))
    return list(zip(edge[::2].tolist(), edge[1::2].tolist(), strict=True))


def item_blocks(items: DataFrame, item_col: str, text_col: str, block_words: int, window: int) -> Iterator[list[tuple[str, list[bytes]]]]:
    """Items as (id, words) in blocks of at most ``block_words`` words; rows stream to the driver one partition at a time.

    A longer item is cut into parts that overlap by a window less one word, so that it has the same windows.
    """
    block: list[tuple[str, list[bytes]]] = []
    total = 0
    most = max(block_words, 2 * window)
    for item, text in items.select(F.col(item_col).cast("string"), text_col).toLocalIterator():
        whole = words_of((text or "").encode())
        if item is None:
            continue
        for at in range(0, len(whole) if len(whole) <= most else len(whole) - window + 1, most - window + 1 if len(whole) > most else most):
            words = whole[at : at + most]
            if block and total + len(words) > block_words:
                yield block
                block, total = [], 0
            block.append((item, words))
            total += len(words)
    if block:
        yield block


def automata(items: DataFrame, item_col: str, text_col: str, window: int, block_words: int) -> list[Broadcast]:
    """One automaton a block, made and shipped one after the other; without items, one that matches nothing."""
    context = items.sparkSession.sparkContext
    return [context.broadcast(SuffixAutomaton(b, window)) for b in item_blocks(items, item_col, text_col, block_words, window)] or [context.broadcast(SuffixAutomaton([], window))]


HITS = pa.list_(pa.struct([("first", pa.int64()), ("last", pa.int64())]))


def scanned(docs: DataFrame, id_col: str, text_col: str, automaton: Broadcast) -> DataFrame:
    """id, t (hash of the text), n_words, hits, items of each row by one automaton."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            n_words, hits, found = [], [], []
            for text in batch.column(2):
                words = words_of(text.as_buffer().to_pybytes()) if text.is_valid else []
                runs, names = automaton.value.match(words)
                n_words.append(len(words))
                hits.append([{"first": a, "last": b} for a, b in runs])
                found.append(sorted(names))
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(n_words, pa.int64()), pa.array(hits, HITS), pa.array(found, pa.list_(pa.string()))], names=["id", "t", "n_words", "hits", "items"])

    text = F.col(text_col).cast("string")
    rows = docs.select(F.col(id_col).alias("id"), F.xxhash64(text).alias("t"), text.alias("text"))
    return rows.transform(arrow_map, run, f"id {docs.schema[id_col].dataType.simpleString()}, t bigint, n_words bigint, hits array<struct<first:bigint,last:bigint>>, items array<string>")


def united(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """id, t, n_words, and hits and items of several automata as those of one."""
    for batch in batches:
        hits = [[{"first": a, "last": b} for a, b in merged([(h["first"], h["last"]) for h in row])] for row in batch.column(3).to_pylist()]
        items = [sorted(set(row)) for row in batch.column(4).to_pylist()]
        yield pa.RecordBatch.from_arrays([*batch.columns[:3], pa.array(hits, HITS), pa.array(items, pa.list_(pa.string()))], names=batch.schema.names)


def all_hits(docs: DataFrame, id_col: str, text_col: str, blocks: list[Broadcast]) -> DataFrame:
    """``scanned`` by every automaton. What the further passes hit is gathered by document; rows that repeat id and text share it."""
    first = scanned(docs, id_col, text_col, blocks[0])
    if len(blocks) == 1:
        return first
    more = union_all([scanned(docs, id_col, text_col, b).where("size(hits) > 0") for b in blocks[1:]])
    more = materialize(more.groupBy("id", "t").agg(F.flatten(F.collect_set("hits")).alias("h"), F.flatten(F.collect_set("items")).alias("i")), "item-hits")
    joined = first.join(more.withColumnsRenamed({"id": "x", "t": "y"}), F.col("id").eqNullSafe(F.col("x")) & F.col("t").eqNullSafe(F.col("y")), "left")
    both = joined.select("id", "t", "n_words", F.when(F.col("h").isNull(), F.col("hits")).otherwise(F.concat("hits", "h")).alias("hits"), F.when(F.col("i").isNull(), F.col("items")).otherwise(F.concat("items", "i")).alias("items"))
    return both.transform(arrow_map, united, both.schema)


def find_contamination(
    docs: DataFrame, items: DataFrame, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id", item_text_col: str = "text", window: int = WINDOW, block_words: int = BLOCK_WORDS
) -> DataFrame:
    """id, n_words, hits array<struct<first,last>> (word runs, last exclusive), items array<string>, sorted, per document row.

    Null and empty texts have no words; very long ones stream through whole. Items with a null id, or without words, have no
    window; repeated items count once (by id). Repeated rows are answered each. Extra columns of either table are ignored. No
    items: no hits. Empty documents table: empty result.
    """
    blocks = automata(items, item_col, item_text_col, window, block_words)
    return all_hits(docs, id_col, text_col, blocks).drop("t").withColumnRenamed("id", id_col)


def merged(runs: list[tuple[int, int]]) -> list[tuple[int, int]]:
    """Overlapping or touching runs become one."""
    out: list[tuple[int, int]] = []
    for a, b in sorted(runs):
        if out and a <= out[-1][1]:
            out[-1] = (out[-1][0], max(b, out[-1][1]))
        else:
            out.append((a, b))
    return out


def cut_words(text: bytes, runs: list[tuple[int, int]]) -> bytes:
    """``text`` without the bytes from the first to the last word of each run, and the separators up to the next word."""
    spans = word_spans(text)
    out, at = [], 0
    for a, b in runs:
        out.append(text[at : spans[a][0]])
        at = spans[b][0] if b < len(spans) else spans[b - 1][1]
    return b"".join([*out, text[at:]])


def decontaminate(
    docs: DataFrame, items: DataFrame, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id", window: int = WINDOW, most_share: float = 0.5, block_words: int = BLOCK_WORDS
) -> DataFrame:
    """The rows of ``docs``, all columns, with hit spans removed from the text.

    A row whose hit words are more than ``most_share`` of its words is dropped. Rows without hits are returned as they
    are, null, empty and very long texts and repeated rows included. Items of one block: decisions are made where the row is read,
    nothing is shuffled. An empty table gives an empty result.
    """
    blocks = automata(items, item_col, "text", window, block_words)
    where, width = docs.columns.index(text_col), len(docs.columns)
    rows, schema = docs, docs.schema
    if len(blocks) > 1:
        doc, t, runs = fresh(docs.columns, "__doc", "__t", "__hits")
        found = all_hits(docs, id_col, text_col, blocks).where("size(hits) > 0").select(F.col("id").alias(doc), F.col("t").alias(t), F.col("hits").alias(runs)).distinct()
        rows = docs.join(found, F.col(id_col).eqNullSafe(F.col(doc)) & (F.xxhash64(F.col(text_col).cast("string")) == F.col(t)), "left").select(*docs.columns, runs)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keep, texts = [], []
            known = batch.column(width).to_pylist() if batch.num_columns > width else None
            for k, text in enumerate(batch.column(where)):
                raw = text.as_buffer().to_pybytes() if text.is_valid else b""
                words = words_of(raw)
                hits = blocks[0].value.match(words)[0] if known is None else [(h["first"], h["last"]) for h in known[k] or ()]
                share = sum(b - a for a, b in hits) / max(1, len(words))
                keep.append(share <= most_share)
                texts.append((cut_words(raw, hits) if hits else raw).decode("utf-8", "replace") if text.is_valid else None)
            columns = [pa.array(texts, batch.schema.field(k).type) if k == where else batch.column(k) for k in range(width)]
            yield pa.RecordBatch.from_arrays(columns, names=batch.schema.names[:width]).filter(pa.array(keep, pa.bool_()))

    return rows.transform(arrow_map, run, schema)


def digest_items(names: list[str]) -> str:
    return hashlib.sha256(",".join(names).encode()).hexdigest()
