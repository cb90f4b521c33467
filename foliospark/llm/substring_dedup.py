"""Exact substring deduplication: every byte covered by a string of ``length`` bytes that starts anywhere else goes.

Sharding. A window of ``length`` bytes is keyed by its least hash of GRAM-byte grams, so equal windows share a key wherever
they stand. A maximal run of windows of one key is a segment; a text of n bytes has about 2n / length of them. Keys met once
cannot hold a repeated window, so only segments of the other keys go on; nor can a segment whose key gram stands in one place, if
the gram with as many bytes to the left or to the right as the longer side of a window must have is met once, over all places
of it in all segments. Segments of equal content are combined and carry their number, so no group of copies meets in one task.

Sorting. Segments are dealt to shards by key. Each shard is one text, each segment behind a separator, whose suffix array and
common prefixes come from external induced sorting (``suffix_array``), with its queues and texts on disk where they
exceed their memory bounds. Positions whose common prefix with a neighbour reaches ``length`` start a repeated window; a suffix
of a segment that stands for several copies has its equals beside it.

Cutting. Repeated windows go back to all places of their segment and become byte spans of each document.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import arrow_map, discard, materialize, string_buffers, text_of
from .hashing import prefix_hash, span_hash
from .ngram_join import tidy, with_ids
from .suffix_array import suffix_array

LENGTH = 200
GRAM = 16
BLOCK_BYTES = 1_500_000
SHARD_BYTES = 3_000_000
#: Low bits of a packed (hash, position): positions in a block.
_PLACE = np.uint64((1 << 26) - 1)


def pieces(column: pa.Array, length: int) -> Iterator[list[tuple[int, int, np.ndarray]]]:
    """Row, offset and bytes of texts, long ones cut into parts that overlap by length - 1 bytes, grouped into blocks."""
    values, offsets = string_buffers(column)
    block: list[tuple[int, int, np.ndarray]] = []
    size = 0
    for row in range(len(offsets) - 1):
        data = values[offsets[row] : offsets[row + 1]]
        for at in range(0, len(data) - length + 1, BLOCK_BYTES):
            part = data[at : at + BLOCK_BYTES + length - 1]
            if block and size + len(part) > BLOCK_BYTES:
                yield block
                block, size = [], 0
            block.append((row, at, part))
            size += len(part)
    if block:
        yield block


def sliding_least(x: np.ndarray, width: int) -> np.ndarray:
    """Least value of each ``width`` neighbours, by least values from block starts and to block ends."""
    n = len(x)
    rows = -(-n // width)
    padded = np.full(rows * width, np.iinfo(x.dtype).max, x.dtype)
    padded[:n] = x
    grid = padded.reshape(rows, width)
    from_start = np.minimum.accumulate(grid, 1).ravel()
    to_end = np.minimum.accumulate(grid[:, ::-1], 1)[:, ::-1].ravel()
    return np.minimum(to_end[: n - width + 1], from_start[width - 1 : n])


def segments(block: list[tuple[int, int, np.ndarray]], length: int) -> tuple[np.ndarray, ...]:
    """Of each segment of a block: piece number, offset in the piece, windows, key, content hash, number of distinct anchors,
    hash of the key gram at the first anchor with the bytes to its left, and to its right, as far as the segment has them
    (else 0). Then segment number, left and right hash of each further anchor, without repeats."""
    data = np.concatenate([p for _, _, p in block])
    sizes = np.array([len(p) for _, _, p in block])
    ends = np.cumsum(sizes)
    starts = ends - sizes
    sums = prefix_hash(data)
    at = np.arange(len(data) - GRAM + 1)
    gram = span_hash(sums, at, at + GRAM)
    packed = (gram & ~_PLACE) | at.astype(np.uint64)
    anchor = (sliding_least(packed, length - GRAM + 1) & _PLACE).astype(np.int64)
    valid = np.ones(len(anchor) + length, bool)
    for e in ends.tolist():
        valid[max(0, e - length + 1) : e] = False
    window = np.flatnonzero(valid[: len(anchor)])
    anchor = anchor[window]
    key = gram[anchor]
    new = np.ones(len(window), bool)
    new[1:] = (window[1:] != window[:-1] + 1) | (key[1:] != key[:-1])
    head = np.flatnonzero(new)
    tail = np.append(head[1:], len(window)) - 1
    moved = np.concatenate(([0], np.cumsum(anchor[1:] != anchor[:-1])))
    first, last = window[head], window[tail]
    piece = np.searchsorted(starts, first, "right") - 1
    side = (length - GRAM) // 2

    def around(place: np.ndarray, first: np.ndarray, last: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        to = place + GRAM + side
        return (
            np.where(place - side >= first, span_hash(sums, np.maximum(place - side, 0), place + GRAM), np.uint64(0)),
            np.where(to <= last + length, span_hash(sums, place, np.minimum(to, len(data))), np.uint64(0)),
        )

    left, right = around(anchor[head], first, last)
    again = ~new
    again[1:] &= anchor[1:] != anchor[:-1]
    again = np.flatnonzero(again)
    owner = np.searchsorted(head, again, "right") - 1
    further = np.unique(np.stack((owner.astype(np.uint64), *around(anchor[again], first[owner], last[owner]))), axis=1)
    return piece, first - starts[piece], last - first + 1, key[head], span_hash(sums, first, last + length), moved[tail] - moved[head] + 1, left, right, further[0].astype(np.int64), further[1], further[2]


def segment_table(texts: DataFrame, length: int) -> DataFrame:
    """id, t, at, windows, key, content, anchors, left, right and further (left and right at the anchors after the first, null
    without any) of each segment of the texts (id, t, text)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for block in pieces(batch.column(2), length):
                piece, at, windows, key, content, anchors, left, right, owner, lefts, rights = segments(block, length)
                further = pa.StructArray.from_arrays([pa.array(lefts.view(np.int64)), pa.array(rights.view(np.int64))], ["left", "right"])
                offsets = np.searchsorted(owner, np.arange(len(key) + 1)).astype(np.int32)
                further = pa.ListArray.from_arrays(pa.array(offsets, mask=np.append(offsets[1:] == offsets[:-1], False)), further)
                row = pa.array(np.array([r for r, _, _ in block])[piece])
                at = at + np.array([o for _, o, _ in block])[piece]
                yield pa.RecordBatch.from_arrays(
                    [batch.column(0).take(row), batch.column(1).take(row), pa.array(at, pa.int64()), pa.array(windows, pa.int32()), pa.array(key.view(np.int64)), pa.array(content.view(np.int64)), pa.array(anchors, pa.int32()), pa.array(left.view(np.int64)), pa.array(right.view(np.int64)), further],
                    names=["id", "t", "at", "windows", "key", "content", "anchors", "left", "right", "further"],
                )

    return texts.transform(arrow_map, run, f"id {texts.schema['id'].dataType.simpleString()}, t bigint, at bigint, windows int, key bigint, content bigint, anchors int, left bigint, right bigint, further array<struct<left:bigint,right:bigint>>")


def cut_segments(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Bytes of the listed segments (struct of at, size, key, content, copies) of each text."""
    for batch in batches:
        values, offsets = string_buffers(batch.column(0))
        out: dict[str, list] = {k: [] for k in ("key", "content", "copies", "bytes")}
        for row, listed in enumerate(batch.column(1).to_pylist()):
            text = values[offsets[row] : offsets[row + 1]]
            for s in listed:
                out["key"].append(s["key"])
                out["content"].append(s["content"])
                out["copies"].append(s["copies"])
                out["bytes"].append(text[s["at"] : s["at"] + s["size"]].tobytes())
        yield pa.RecordBatch.from_arrays([pa.array(out["key"], pa.int64()), pa.array(out["content"], pa.int64()), pa.array(out["copies"], pa.int32()), pa.array(out["bytes"], pa.binary())], names=list(out))


def repeated_windows(length: int):
    """For the segments of a shard: runs [first, last] of repeated windows of each, as key, content, first, last."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        keys, contents, copies, sizes, text = [], [], [], [], []
        for batch in batches:
            values, offsets = string_buffers(batch.column(3))
            keys.append(batch.column(0).to_numpy())
            contents.append(batch.column(1).to_numpy())
            copies.append(batch.column(2).to_numpy())
            sizes.append(np.diff(offsets))
            text.append(values[offsets[0] : offsets[-1]])
        if not keys:
            return
        raw, lengths = np.concatenate(text), np.concatenate(sizes).astype(np.int64)
        text.clear()
        wide = np.uint16 if len(raw) and raw.max() > 0xF4 else np.uint8  # UTF-8 leaves room for two more symbols
        whole = np.ones(len(raw) + len(lengths) + 1, wide)  # a separator behind each segment
        whole[-1] = 0
        place = np.ones(len(whole), bool)
        ends = np.cumsum(lengths + 1) - 1
        place[ends] = place[-1] = False
        whole[place] = raw.astype(wide) + wide(2)
        del raw
        seen = np.append(np.repeat(np.concatenate(copies) > 1, lengths + 1), False)
        above = False  # the suffix array comes from the largest suffix down
        for at, prefix in suffix_array(whole, length):
            hit = prefix >= length
            seen[at[hit]] = True
            seen[at[1:][hit[:-1]]] = True
            if above:
                seen[at[0]] = True
            above = bool(hit[-1])
        seen &= np.arange(len(whole)) <= np.repeat(np.append(ends, 0), np.append(lengths + 1, 1)) - length
        edge = np.flatnonzero(np.diff(np.concatenate(([False], seen, [False])).astype(np.int8)))
        first, last = edge[::2], edge[1::2] - 1
        starts = ends - lengths
        segment = np.searchsorted(starts, first, "right") - 1
        keys, contents = np.concatenate(keys), np.concatenate(contents)
        for i in range(0, len(first), 50_000):
            s = segment[i : i + 50_000]
            yield pa.RecordBatch.from_arrays([pa.array(keys[s]), pa.array(contents[s]), pa.array(first[i : i + 50_000] - starts[s]), pa.array(last[i : i + 50_000] - starts[s])], names=["key", "content", "first", "last"])

    return run


def merged_spans(first: np.ndarray, end: np.ndarray) -> list[tuple[int, int]]:
    """Maximal runs of the union of half-open byte ranges."""
    by = np.argsort(first, kind="stable")
    first, end = first[by], np.maximum.accumulate(end[by])
    head = np.concatenate(([True], first[1:] > end[:-1]))
    return list(zip(first[head].tolist(), end[np.append(np.flatnonzero(head)[1:] - 1, len(end) - 1)].tolist(), strict=True))


def repeated_spans(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", length: int = LENGTH, shard_bytes: int = SHARD_BYTES) -> DataFrame:
    """id, t (hash of the text), spans array<struct<first,last>> (last exclusive, maximal, in order) of the texts with repeats."""
    spark = docs.sparkSession
    texts = docs.select(F.col(id_col).alias("id"), F.xxhash64(text_of(text_col)).alias("t"), text_of(text_col).alias("text")).where(F.octet_length("text") >= length)
    found = materialize(segment_table(texts, length), "segments")
    again = materialize(found.groupBy("key").agg(F.sum("anchors").alias("n")).where("n > 1").select("key"), "repeated-keys")
    keyed = materialize(found.join(again, "key"), "keyed-segments")
    discard(found, again)
    tidy(spark)
    anchored = keyed.select("key", "left", "right").unionByName(keyed.where("further IS NOT NULL").select("key", F.inline("further")))
    repeated = {s: materialize(anchored.where(f"{s} != 0").groupBy("key", s).count().where("count > 1").select("key", s, F.lit(True).alias(f"{s}_again")), f"repeated-{s}") for s in ("left", "right")}
    live = keyed.join(repeated["left"], ["key", "left"], "left").join(repeated["right"], ["key", "right"], "left")
    live = materialize(live.where("anchors > 1 OR left_again OR right_again").select("id", "t", "at", "windows", "key", "content"), "live-segments")
    discard(keyed, *repeated.values())
    tidy(spark)
    kinds = live.groupBy("key", "content", "windows").agg(F.count(F.lit(1)).alias("n"), F.min(F.struct("id", "t", "at")).alias("place"))
    kinds = materialize(kinds.select("key", "content", "windows", F.least("n", F.lit(2)).cast("int").alias("copies"), F.col("place.id").alias("id"), F.col("place.t").alias("t"), F.col("place.at").alias("at")), "kinds")
    total = kinds.agg(F.coalesce(F.sum(F.col("windows") + length), F.lit(0))).first()[0]
    listed = kinds.groupBy("id", "t").agg(F.collect_list(F.struct("at", (F.col("windows") + (length - 1)).alias("size"), "key", "content", "copies")).alias("listed"))
    listed = materialize(listed, "listed")
    discard(kinds)
    tidy(spark)
    few = listed.withColumnsRenamed({"id": "i", "t": "u"})
    some = with_ids(texts, few.select(F.col("u").alias("t")).distinct(), "left_semi", "t")  # a row that repeats id and text is cut again, to the same segments
    cut = some.join(few, F.col("id").eqNullSafe(F.col("i")) & (F.col("t") == F.col("u"))).select("text", "listed").transform(arrow_map, cut_segments, "key bigint, content bigint, copies int, bytes binary")
    shards = max(1, -(-int(total) // shard_bytes))
    repeats = cut.repartition(shards, "key").transform(arrow_map, repeated_windows(length), "key bigint, content bigint, first bigint, last bigint")
    repeats = materialize(repeats.distinct(), "repeats")
    discard(listed)
    tidy(spark)
    spans = live.join(repeats, ["key", "content"]).select("id", "t", (F.col("at") + F.col("first")).alias("first"), (F.col("at") + F.col("last") + length).alias("last"))
    spans = materialize(spans.groupBy("id", "t").agg(F.collect_set(F.struct("first", "last")).alias("spans")), "spans")
    discard(live, repeats)
    tidy(spark)
    return spans


def cut_repeats(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", length: int = LENGTH, shard_bytes: int = SHARD_BYTES) -> DataFrame:
    """id, n_bytes, n_removed, n_spans, kept binary of each row of ``docs``, and the spans array<struct<first,last>>.

    Null and empty texts have no bytes, texts under ``length`` bytes no repeats. Rows that repeat id and text are copies of each
    other, hence removed whole (if long enough). Other columns are ignored. An empty table gives an empty result.
    """
    spans = repeated_spans(docs, id_col, text_col, length, shard_bytes)
    texts = docs.select(F.col(id_col).alias("id"), F.xxhash64(text_of(text_col)).alias("t"), text_of(text_col).alias("text"))
    kind = docs.schema[id_col].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            n_bytes, removed, n_spans, kept, out = [], [], [], [], []
            values, offsets = string_buffers(batch.column(1))
            for row, found in enumerate(batch.column(2).to_pylist()):
                text = values[offsets[row] : offsets[row + 1]].tobytes()
                runs = merged_spans(np.array([s["first"] for s in found]), np.array([s["last"] for s in found])) if found else []
                at, rest = 0, []
                for a, b in runs:
                    rest.append(text[at:a])
                    at = b
                kept.append(b"".join([*rest, text[at:]]))
                n_bytes.append(len(text))
                removed.append(len(text) - len(kept[-1]))
                n_spans.append(len(runs))
                out.append([{"first": a, "last": b} for a, b in runs])
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array(n_bytes, pa.int64()), pa.array(removed, pa.int64()), pa.array(n_spans, pa.int64()), pa.array(kept, pa.binary()), pa.array(out, pa.list_(pa.struct([("first", pa.int64()), ("last", pa.int64())])))],
                names=["id", "n_bytes", "n_removed", "n_spans", "kept", "spans"],
            )

    joined = texts.join(spans.withColumnsRenamed({"id": "i", "t": "u"}), F.col("id").eqNullSafe(F.col("i")) & (F.col("t") == F.col("u")), "left").select("id", "text", "spans")
    return joined.transform(arrow_map, run, f"id {kind}, n_bytes bigint, n_removed bigint, n_spans bigint, kept binary, spans array<struct<first:bigint,last:bigint>>").withColumnRenamed("id", id_col)
