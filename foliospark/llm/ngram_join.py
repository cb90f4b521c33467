"""Exact Jaccard self-join on word 5-gram sets with a vertically partitioned global n-gram order.

Order. One pass counts hashed n-grams in up to ``2 ** MOST_BUCKET_BITS`` buckets, about one for each n-gram of a small
corpus. The global order is (size class of the bucket's count, hash): rare n-grams first, the same everywhere. It is
cut into ``FRAGMENTS`` ranges of equal load.

Candidates. Two sets of similarity 0.8 share an n-gram among the first n - ceil(0.8 n) + 1 of either; two sets of given
sizes that need an overlap of o share one among the first n - o + 1. Only n-grams in two such prefixes are kept.

Links. Groups of near copies are not expanded into pairs. In rounds, every set is compared with the leader it shares most
prefix n-grams with; sets that get linked are one class, and only n-grams still shared by different classes live on. When the
pairs left between classes are few (a small multiple of the rows), or rounds stop helping, each of them is compared, so
no link between classes is lost; an n-gram of many sets is then cut into blocks of ``BLOCK_ROWS`` sets, and each pair of
blocks is a key of its own. Identical sets are one class from the start.

Counting. Each compared pair meets once per fragment; partial overlaps are counted there and summed per pair.

N-grams are 64-bit hashes and are counted as such. Words over ``LONG_WORD`` bytes are hashed by BLAKE2b, shorter ones by a
polynomial, for which no structured collisions of that length exist.
"""

from __future__ import annotations

import gc
from collections.abc import Iterator
from dataclasses import dataclass
from hashlib import blake2b

import numpy as np
import pyarrow as pa
from pyspark import Broadcast
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import arrow_map, discard, fresh, materialize, text_blocks, text_of, union_all
from .components import connected_components
from .hashing import mix, prefix_hash, span_hash

N = 5
LEAST_BUCKET_BITS, MOST_BUCKET_BITS, CHUNK_BITS = 16, 21, 16
FRAGMENTS = 3
BLOCK_BYTES = 250_000
#: N-grams that wait to be counted.
WAITING = 300_000
#: Longer words are hashed one by one.
LONG_WORD = 64
#: Estimated bytes of a broadcast set of ids, and those of a row besides its id; larger sets are joined by a shuffle.
MOST_BROADCAST, ROW_BYTES = 32_000_000, 48
ROUNDS = 8
#: Pairs left, for each posting, at which they are compared one by one.
PAIRS_A_ROW = 3
#: Sets of one n-gram that meet in one task when all that is left is compared.
BLOCK_ROWS = 1_000

#: White space of the word pattern, A-Z to a-z.
_LOWER = np.array([b + 32 if 0x41 <= b <= 0x5A else b for b in range(256)], np.uint8)
_SPACE = np.array([b == 0x20 or 0x09 <= b <= 0x0D for b in range(256)])
_PLACE = mix(np.arange(1, N + 1, dtype=np.uint64)) | np.uint64(1)


def word_hashes(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """Hash of each word, lower-cased; a slice of the text at a time, as that takes many bytes for each of its own."""
    out = np.empty(len(starts), np.uint64)
    size = ends - starts
    short = starts + np.minimum(size, LONG_WORD)
    for base in range(0, len(data), BLOCK_BYTES):
        i, j = np.searchsorted(starts, (base, base + BLOCK_BYTES))
        if i < j:
            out[i:j] = span_hash(prefix_hash(_LOWER[data[base : base + BLOCK_BYTES + LONG_WORD]]), starts[i:j] - base, short[i:j] - base)
    for k in np.flatnonzero(size > LONG_WORD).tolist():
        out[k] = int.from_bytes(blake2b(_LOWER[data[starts[k] : ends[k]]].tobytes(), digest_size=8).digest(), "little")
    return out


def shingles(data: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Document numbers and n-gram hashes of the texts data[at[i]:at[i + 1]], distinct, sorted by both."""
    inside = ~_SPACE[data]
    edge = np.zeros(len(data) + 1, bool)
    edge[at] = True
    starts = np.flatnonzero(inside & (edge[:-1] | np.concatenate(([True], ~inside[:-1]))))
    ends = np.flatnonzero(inside & (edge[1:] | np.concatenate((~inside[1:], [True])))) + 1
    word = word_hashes(data, starts, ends)
    doc = np.searchsorted(at, starts, "right") - 1
    per_doc = np.bincount(doc, minlength=len(at) - 1)
    first = np.cumsum(per_doc) - per_doc
    hashes, owners = [], []
    if len(word) >= N:
        full = np.flatnonzero(doc[: len(doc) - N + 1] == doc[N - 1 :])
        hashes.append(mix(sum(word[full + k] * _PLACE[k] for k in range(N))))
        owners.append(doc[full])
    for m in range(1, N):  # whole texts of fewer words
        short = np.flatnonzero(per_doc == m)
        if len(short):
            hashes.append(mix(sum((word[first[short] + k] * _PLACE[k] for k in range(m)), np.full(len(short), m, np.uint64))))
            owners.append(short)
    if not hashes:
        return np.zeros(0, np.int64), np.zeros(0, np.uint64)
    h, d = np.concatenate(hashes), np.concatenate(owners)
    order = np.lexsort((h, d))
    h, d = h[order], d[order]
    keep = np.ones(len(h), bool)
    keep[1:] = (h[1:] != h[:-1]) | (d[1:] != d[:-1])
    return d[keep], h[keep]


def blocks(batch: pa.RecordBatch) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """First row, end row, document numbers and n-grams of each block of a batch with the text in column 1."""
    for i, j, data, at in text_blocks(batch.column(1), BLOCK_BYTES):
        yield i, j, *shingles(data, at)


class Counts:
    """Counts of hashed n-grams, a byte each; a task's count of a bucket stops at 255."""

    def __init__(self, bits: int):
        self.bits, self.counts, self.waiting, self.held = bits, np.zeros(1 << bits, np.uint8), [], 0

    def add(self, h: np.ndarray) -> None:
        self.waiting.append((h >> np.uint64(64 - self.bits)).astype(np.uint32))
        self.held += len(h)
        if self.held > WAITING:
            self.flush()

    def flush(self) -> None:
        if self.waiting:
            bucket = np.sort(np.concatenate(self.waiting))
            head = np.flatnonzero(np.concatenate(([True], bucket[1:] != bucket[:-1])))
            times = np.diff(np.append(head, len(bucket)))
            at = bucket[head]
            self.counts[at] = np.minimum(self.counts[at] + times, 255)
            self.waiting, self.held = [], 0

    def chunks(self) -> list[tuple[int, bytes]]:
        self.flush()
        return [(c, part.tobytes()) for c, part in enumerate(self.counts.reshape(-1, 1 << CHUNK_BITS)) if part.any()]


def profile(bits: int):
    """Set size and signature of each text, then the task's n-gram counts by chunk of buckets."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts = Counts(bits)
        names = ["id", "n", "s1", "s2", "chunk", "counts"]
        kind = pa.int64()
        for batch in batches:
            kind = batch.column(0).type
            size, one, two = (np.zeros(batch.num_rows, t) for t in (np.int64, np.uint64, np.uint64))
            for i, j, d, h in blocks(batch):
                counts.add(h)
                n = np.bincount(d, minlength=j - i)
                size[i:j] = n
                full = n > 0
                begin = (np.cumsum(n) - n)[full]
                if full.any():
                    one[i:j][full] = np.add.reduceat(mix(h + np.uint64(1)), begin)
                    two[i:j][full] = np.add.reduceat(mix(h ^ np.uint64(0xA5A5A5A5A5A5A5A5)), begin)
            n = batch.num_rows
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(size), pa.array(one.view(np.int64)), pa.array(two.view(np.int64)), pa.nulls(n, pa.int32()), pa.nulls(n, pa.binary())], names=names)
        rows = counts.chunks()
        for k in range(0, len(rows), 32):
            some = rows[k : k + 32]
            n = len(some)
            yield pa.RecordBatch.from_arrays([pa.nulls(n, kind), *[pa.nulls(n, pa.int64())] * 3, pa.array([c for c, _ in some], pa.int32()), pa.array([b for _, b in some], pa.binary())], names=names)

    return run


def summed_counts(rows: pa.Table) -> np.ndarray:
    """The sum of the parts of a chunk's counts; a part has one or four bytes for each."""
    total = np.zeros(1 << CHUNK_BITS, np.int64)
    for part in rows.column("counts"):
        raw = part.as_buffer()
        total += np.frombuffer(raw, np.uint8 if raw.size == 1 << CHUNK_BITS else np.uint32)
    return np.minimum(total, 2**32 - 1)


def add_counts(rows: pa.Table) -> pa.Table:
    return pa.table({"chunk": rows.column("chunk").slice(0, 1), "counts": pa.array([summed_counts(rows).astype(np.uint32).tobytes()], pa.binary())})


def to_classes(rows: pa.Table) -> pa.Table:
    counts = summed_counts(rows)
    size_class = np.log2(counts + 1).astype(np.uint8)
    load = np.bincount(size_class, counts, 64).astype(np.int64)
    return pa.table({"chunk": rows.column("chunk").slice(0, 1), "counts": pa.array([size_class.tobytes()], pa.binary()), "load": pa.array([load.tobytes()], pa.binary())})


@dataclass
class Order:
    """Size class of each bucket, a byte each, and how many n-grams each class holds."""

    size_class: np.ndarray
    load: np.ndarray

    def bucket(self, h: np.ndarray) -> np.ndarray:
        return (h >> np.uint64(64 - (len(self.size_class).bit_length() - 1))).astype(np.int64)

    def classes(self, h: np.ndarray) -> np.ndarray:
        return self.size_class[self.bucket(h)]

    def fragment(self, h: np.ndarray) -> np.ndarray:
        """Range of the global order; the place inside a class goes by the hash."""
        before = np.concatenate(([0], np.cumsum(self.load)[:-1])).astype(np.float64)
        c = self.classes(h)
        place = before[c] + self.load[c] * ((h >> np.uint64(40)).astype(np.float64) / (1 << 24))
        return np.minimum(FRAGMENTS - 1, (place * FRAGMENTS / max(1, self.load.sum())).astype(np.int64))


def counted_order(chunks: DataFrame, bits: int) -> Order:
    """Counts are added in two levels, so that no task gathers the parts of all others."""
    some = chunks.withColumn("salt", F.pmod(F.xxhash64("counts"), F.lit(16))).groupBy("chunk", "salt").applyInArrow(add_counts, "chunk int, counts binary")
    size_class, load = np.zeros(1 << bits, np.uint8), np.zeros(64, np.int64)
    for chunk, part, own in some.groupBy("chunk").applyInArrow(to_classes, "chunk int, counts binary, load binary").collect():
        size_class[chunk << CHUNK_BITS : (chunk + 1) << CHUNK_BITS] = np.frombuffer(part, np.uint8)
        load += np.frombuffer(own, np.int64)
    return Order(size_class, load)


def required(n):
    """Least overlap of a set of n with any set that it can link with."""
    return (80 * n + 99) // 100


def _blocks_in_order(batch: pa.RecordBatch, order: Order) -> Iterator[tuple[pa.Array, np.ndarray, np.ndarray, np.ndarray]]:
    """Ids, set sizes, document numbers and n-grams in the global order, of each block of (id, text)."""
    for i, j, d, h in blocks(batch):
        by = np.argsort(d * 64 + order.classes(h), kind="stable")  # by class, then hash, in each document
        yield batch.column(0).slice(i, j - i), np.bincount(d, minlength=j - i), d[by], h[by]


def required_sql(n: str):
    return F.floor((80 * F.col(n) + 99) / 100)


def prefixes(texts: DataFrame, shared: Broadcast) -> DataFrame:
    """id, n, prefix array<bigint> (in order) of each text (id, text) that has n-grams: the first of them in the global order."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for ids, n, d, h in _blocks_in_order(batch, shared.value):
                place = np.arange(len(d)) - (np.cumsum(n) - n)[d]
                length = np.where(n > 0, n - required(n) + 1, 0)
                prefix = pa.ListArray.from_arrays(pa.array(np.concatenate(([0], np.cumsum(length))), pa.int32()), pa.array(h[place < length[d]].view(np.int64)))
                yield pa.RecordBatch.from_arrays([ids, pa.array(n, pa.int64()), prefix], names=["id", "n", "prefix"]).filter(pa.array(n > 0))

    return texts.transform(arrow_map, run, f"id {texts.schema['id'].dataType.simpleString()}, n bigint, prefix array<bigint>")


def fragment_parts(texts: DataFrame, shared: Broadcast) -> DataFrame:
    """id, parts array<binary> of each text (id, text): all of its n-grams by fragment of the global order."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for ids, n, d, h in _blocks_in_order(batch, shared.value):
                # fragments are ranges of the order, so they follow one another
                sizes = np.bincount(d * FRAGMENTS + shared.value.fragment(h), minlength=len(n) * FRAGMENTS)
                ends = np.concatenate(([0], np.cumsum(sizes) * 8)).astype(np.int32)
                parts = pa.Array.from_buffers(pa.binary(), len(sizes), [None, pa.py_buffer(ends.tobytes()), pa.py_buffer(h.tobytes())])
                parts = pa.ListArray.from_arrays(pa.array(np.arange(len(n) + 1) * FRAGMENTS, pa.int32()), parts)
                yield pa.RecordBatch.from_arrays([ids, parts], names=["id", "parts"])

    return texts.transform(arrow_map, run, f"id {texts.schema['id'].dataType.simpleString()}, parts array<binary>")


def count_overlaps(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Replaces the two last columns, fragment parts of two sets, by the size of their intersection."""
    for batch in batches:
        k = batch.num_columns - 2
        x, _ = tokens(batch.column(k))
        y, row = tokens(batch.column(k + 1))
        x.sort()
        at = np.minimum(np.searchsorted(x, y), max(0, len(x) - 1))
        found = np.bincount(row[x[at] == y] if len(x) else row[:0], minlength=batch.num_rows)
        yield pa.RecordBatch.from_arrays([*batch.columns[:k], pa.array(found, pa.int64())], names=[*batch.schema.names[:k], "overlap"])


def tokens(parts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Tokens of all rows, each combined with a mark of its row, and the row of each."""
    offsets = np.frombuffer(parts.buffers()[1], np.int32)[parts.offset : parts.offset + len(parts) + 1]
    raw = np.frombuffer(parts.buffers()[2], np.uint8)[offsets[0] : offsets[-1]] if parts.buffers()[2] is not None else np.zeros(0, np.uint8)
    row = np.repeat(np.arange(len(parts)), np.diff(offsets) // 8)
    return np.frombuffer(raw.tobytes(), np.uint64) ^ mix(row.astype(np.uint64) + np.uint64(1)), row


def with_ids(frame: DataFrame, ids: DataFrame, how: str, on: str = "id") -> DataFrame:
    """Semi or anti join of ``frame`` on its key; the keys are broadcast if their bytes are within the bound."""
    return frame.join(F.broadcast(ids) if fits(ids, on) else ids, on, how)


def fits(ids: DataFrame, column: str) -> bool:
    """Whether a hash table of the rows, one id each, stays within MOST_BROADCAST bytes."""
    size = F.sum(F.octet_length(F.col(column).cast("string")) + ROW_BYTES)
    return ids.agg(F.coalesce(size, F.lit(0))).first()[0] <= MOST_BROADCAST


def linked(pairs: DataFrame, texts: DataFrame, order: Broadcast) -> DataFrame:
    """a, b of the pairs (a, b, na, nb) that are similar enough: partial overlaps by fragment, summed per pair.

    Sets are made again from the texts of the documents compared, so the sets of all others are never stored.
    """
    pairs = materialize(pairs, "pairs")
    wanted = materialize(pairs.select(F.explode(F.array("a", "b")).alias("id")).distinct(), "pair-ids")
    parts = materialize(fragment_parts(with_ids(texts, wanted, "left_semi"), order), "parts")
    met = (
        pairs.join(parts.withColumnRenamed("id", "a"), "a")
        .select("a", "b", "na", "nb", F.posexplode("parts").alias("fragment", "x"))
        .join(parts.select(F.col("id").alias("b"), F.posexplode("parts").alias("fragment", "y")), ["b", "fragment"])
        .select("a", "b", "na", "nb", "x", "y")
    )
    kind = met.schema["a"].dataType.simpleString()
    partial = met.transform(arrow_map, count_overlaps, f"a {kind}, b {kind}, na bigint, nb bigint, overlap bigint")
    summed = partial.groupBy("a", "b", "na", "nb").agg(F.sum("overlap").alias("overlap"))
    found = materialize(summed.where("100 * overlap >= 80 * (na + nb - overlap)").select("a", "b"), "new-links")
    discard(pairs, wanted, parts)
    return found


def tidy(spark: SparkSession) -> None:
    """Between two steps: let the session drop shuffle files of the last, and executors give back heap that it has left empty.

    An executor's container also has to hold its Python workers, and its heap does not shrink by itself.
    """
    gc.collect()
    spark._jvm.System.gc()
    n = spark.sparkContext.defaultParallelism
    spark.range(n, numPartitions=n).select(F.java_method(F.lit("java.lang.System"), F.lit("gc"))).write.format("noop").mode("overwrite").save()


def enough(count: str) -> str:
    """SQL: ``count`` common prefix n-grams, and all of the longer rest, can make up the overlap that a link needs."""
    rest = "greatest(floor((80 * na + 99) / 100), floor((80 * nb + 99) / 100)) - 1"
    return f"180 * ({count} + {rest}) >= 80 * (na + nb)"


#: SQL: both places of the n-gram are early enough to be the first common one of sets that link.
EARLY = "ia + floor((80 * (na + nb) + 179) / 180) <= na AND ib + floor((80 * (na + nb) + 179) / 180) <= nb"
SIZES_FIT = "100 * least(na, nb) >= 80 * greatest(na, nb)"


def find_links(sets: DataFrame, texts: DataFrame, order: Broadcast) -> list[DataFrame]:
    """Tables of links (a, b) that join every two sets of similarity 0.8 or more in one component.

    A posting's leader is the member whose prefix is shared to the largest part: in a group of near copies it is a text
    with few changes, which most others link with. Ties, and from the second round on near ties, go by a hash of the round.
    """
    spark = sets.sparkSession
    postings = sets.select("id", "n", F.posexplode("prefix").alias("place", "token"))
    # a table of its own, so that the files of its shuffle are gone when all postings are shuffled
    shared = materialize(postings.groupBy("token").count().where("count > 1").select("token"), "shared-tokens")
    known = materialize(postings.join(shared, "token").withColumn("label", F.col("id")), "members")
    discard(shared)
    tidy(spark)
    share = F.count(F.lit(1)) / F.max(F.col("n") - required_sql("n") + 1)
    members = materialize(known.join(known.groupBy("id").agg(share.alias("share")), "id"), "members")
    discard(known)
    out: list[DataFrame] = []
    before = float("inf")
    for turn in range(ROUNDS + 1):
        central = F.col("share") if turn == 0 else F.floor(F.col("share") * 8)
        lead = F.max(F.struct(central.alias("c"), F.xxhash64(F.lit(turn), "id").alias("h"), "id", "n", "label"))
        mixed = materialize(members.groupBy("token").agg(F.min("label").alias("lo"), F.max("label").alias("hi"), lead.alias("lead")).where("lo != hi").select("token", "lead"), "mixed")
        still = materialize(members.join(mixed, "token"), "members")
        discard(members, mixed)
        members = still
        of_class = members.groupBy("token", "label").count()
        rows, left = of_class.groupBy("token").agg(F.sum("count").alias("s"), F.sum(F.col("count") * F.col("count")).alias("q")).agg(F.sum("s"), F.sum((F.col("s") * F.col("s") - F.col("q")) / 2)).first()
        if not rows:
            return out
        if left <= PAIRS_A_ROW * rows or left > 0.9 * before or turn == ROUNDS:
            break
        before = left
        tried = members.where("label != lead.label").select(F.col("id").alias("a"), F.col("lead.id").alias("b"), F.col("n").alias("na"), F.col("lead.n").alias("nb")).where(SIZES_FIT)
        # a leader leads only some of the n-grams that a pair shares; half of those needed are a good sign
        best = tried.groupBy("a", "b", "na", "nb").count().where(enough("2 * count")).groupBy("a", "na").agg(F.max(F.struct("count", "b", "nb")).alias("top")).select("a", F.col("top.b").alias("b"), "na", F.col("top.nb").alias("nb"))
        new = linked(best, texts, order)
        tidy(spark)
        if new.isEmpty():
            break
        out.append(new)
        labels = materialize(members.select("id", "label").distinct(), "member-labels")
        side = lambda c: labels.select(F.col("id").alias(c), F.col("label").alias(f"l{c}"))  # noqa: E731, B023
        roots = connected_components(new.join(side("a"), "a").join(side("b"), "b").select(F.col("la").alias("a"), F.col("lb").alias("b")))
        relabelled = members.join(roots.select(F.col("v").alias("label"), F.col("label").alias("root")), "label", "left").select("token", "id", "n", "place", "share", F.coalesce("root", "label").alias("label"))
        relabelled = materialize(relabelled, "members")
        discard(members, labels, roots)
        members = relabelled
        tidy(spark)
    blocked = members.join(members.groupBy("token").agg(F.ceil(F.count(F.lit(1)) / BLOCK_ROWS).alias("blocks")), "token").withColumn("own", F.pmod(F.xxhash64("id"), "blocks"))
    one, two = (
        blocked.select("token", F.col("own").alias(own), F.explode(F.expr("sequence(0L, blocks - 1)")).alias(other), F.col("id").alias(k), F.col("n").alias(f"n{k}"), F.col("place").alias(f"i{k}"), F.col("label").alias(f"l{k}"))
        for k, own, other in (("a", "x", "y"), ("b", "y", "x"))
    )
    met = one.join(two, ["token", "x", "y"]).where("a < b AND la != lb").where(SIZES_FIT).where(EARLY).select("a", "b", "na", "nb").distinct()
    # n-grams of one class only are none that two classes share, so the members left have all that a pair shares in its prefixes
    held = materialize(members.groupBy("id").agg(F.collect_set("token").alias("tokens")), "held")
    both = met.join(held.select(F.col("id").alias("a"), F.col("tokens").alias("ta")), "a").join(held.select(F.col("id").alias("b"), F.col("tokens").alias("tb")), "b")
    out.append(linked(both.where(enough("size(array_intersect(ta, tb))")).select("a", "b", "na", "nb"), texts, order))
    discard(members, held)
    return out


def similar_components(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """id, n_shingles, component_id for each row of ``docs``.

    Two texts link when 100 * |intersection| >= 80 * |union| of their sets of 5-word shingles; component_id is the least id
    reachable. A text of one to four words has one n-gram, the whole of it. Null, empty and blank texts have none and link with
    nothing. A row with a null id links with nothing and has a null component_id. Rows that repeat an id are one vertex.
    Very long texts are read whole; the n-grams of one text must fit the memory of a task. Equal similarities are no ties:
    every link counts. Other columns are ignored. An empty table gives an empty result.
    """
    spark = docs.sparkSession
    tidy(spark)  # what the session ran before
    texts = docs.select(F.col(id_col).alias("id"), text_of(text_col).alias("text"))
    kind = docs.schema[id_col].dataType.simpleString()
    bytes_ = docs.select(F.coalesce(F.sum(F.octet_length(text_col)), F.lit(0))).first()[0]
    bits = min(MOST_BUCKET_BITS, max(LEAST_BUCKET_BITS, int(bytes_ // 6).bit_length()))  # a word has some six bytes
    rows = materialize(texts.transform(arrow_map, profile(bits), f"id {kind}, n bigint, s1 bigint, s2 bigint, chunk int, counts binary"), "profile")
    order = spark.sparkContext.broadcast(counted_order(rows.where("chunk IS NOT NULL").select("chunk", "counts"), bits))
    sizes = rows.where("chunk IS NULL").select("id", "n", "s1", "s2")
    known = sizes.where("id IS NOT NULL AND n > 0")
    groups = materialize(known.groupBy("n", "s1", "s2").agg(F.min("id").alias("b"), F.count(F.lit(1)).alias("count")).where("count > 1").drop("count"), "equal-sets")
    same = materialize(known.join(groups, ["n", "s1", "s2"]).where("id != b").select(F.col("id").alias("a"), "b"), "equal-links")
    texts = texts.where("id IS NOT NULL")
    sets = materialize(prefixes(with_ids(texts, same.select(F.col("a").alias("id")).distinct(), "left_anti"), order), "sets")
    links = find_links(sets, texts, order)
    discard(sets)
    order.destroy()
    labels = connected_components(union_all([same, *links]))
    discard(groups, same, *links)
    tidy(spark)
    return sizes.join(labels, F.col("id") == F.col("v"), "left").select(F.col("id").alias(id_col), F.col("n").alias("n_shingles"), F.coalesce("label", "id").alias("component_id"))


def keep_one(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The rows of ``docs``, all columns, but for those whose component has a smaller id; rows with null ids stay."""
    found = materialize(similar_components(docs, id_col, text_col).where(F.col("component_id") < F.col(id_col)).select(F.col(id_col).alias("id")).distinct(), "near-copies")
    few = fits(found, "id")
    tidy(docs.sparkSession)
    (name,) = fresh(docs.columns, "__copy")
    found = found.withColumnRenamed("id", name)
    return docs.join(F.broadcast(found) if few else found, F.col(id_col) == F.col(name), "left_anti")
