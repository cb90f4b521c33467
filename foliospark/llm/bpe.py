"""Byte-level BPE encoding and decoding by merge replay over a corpus block.

A task's documents are split by the pattern; the distinct pieces of a block form its corpus. All of them are laid out in
one token array with links to the live neighbours, and an inverted index holds, for each token pair that merges, the
positions where the pair stands. Merges are applied in rank order, each to all of its positions at once; only the
neighbours of a merged pair are looked at again. In a piece that holds a pair more than once the leftmost goes first and
the others go back to the index, so a lower rank that comes up there is merged before them: every piece ends exactly as
if it had been merged alone.

Encoded pieces stay in a bounded table of the task, so frequent pieces are replayed once. Nothing is shuffled.
"""

from __future__ import annotations

import base64
import hashlib
import heapq
from collections.abc import Iterator
from itertools import islice

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import arrow_map, text_blocks

#: Most pieces kept encoded in a task between blocks.
CACHE_PIECES = 100_000
#: Text of a block; one longer text is a block of its own.
BLOCK_BYTES = 1_000_000
#: Rows of a result batch.
OUT_ROWS = 500


def read_ranks(path: str) -> dict[bytes, int]:
    """The merge ranks of a file with a base64 token and its rank on each line."""
    with open(path, "rb") as f:
        return {base64.b64decode(token): int(rank) for token, rank in (line.split() for line in f if line.strip())}


class MergeReplay:
    """Encodes sets of byte strings by replaying merges over all of them; made once, on the driver, and broadcast."""

    def __init__(self, ranks: dict[bytes, int]):
        self.tokens = {rank: token for token, rank in ranks.items()}
        self.single = np.array([ranks[bytes([b])] for b in range(256)], np.int32)
        pairs = {}
        for token, rank in ranks.items():
            for k in range(1, len(token)):
                if (a := ranks.get(token[:k])) is not None and (b := ranks.get(token[k:])) is not None:
                    pairs[a << 32 | b] = rank
        self.pairs = np.array(sorted(pairs), np.int64)
        self.pair_rank = np.array([pairs[k] for k in self.pairs.tolist()], np.int64)

    def rank(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """Rank of the token that each two neighbours merge to, or -1."""
        key = a.astype(np.int64) << 32 | b
        at = np.minimum(np.searchsorted(self.pairs, key), len(self.pairs) - 1)
        return np.where(self.pairs[at] == key, self.pair_rank[at], -1)

    def encode(self, pieces: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        """Tokens of all pieces in a row, and the len + 1 offsets of each piece's tokens."""
        size = np.fromiter(map(len, pieces), np.int64, len(pieces))
        token = self.single[np.frombuffer(b"".join(pieces), np.uint8)]
        word = np.repeat(np.arange(len(pieces), dtype=np.int32), size)
        n = len(token)
        if not n:
            return token, np.zeros(len(pieces) + 1, np.int64)
        # one place more, so that -1 is a dead neighbour
        left, right = np.arange(-1, n, dtype=np.int32), np.arange(1, n + 2, dtype=np.int32)
        starts = np.concatenate(([0], np.flatnonzero(np.diff(word)) + 1))
        left[starts] = -1
        right[np.concatenate((starts[1:] - 1, [n - 1]))] = -1
        token = np.append(token, np.int32(-1))

        index: dict[int, list[np.ndarray]] = {}
        order: list[int] = []

        def put(ranks: np.ndarray, at: np.ndarray) -> None:
            by = np.argsort(ranks, kind="stable")
            ranks, at = ranks[by], at[by]
            cut = np.flatnonzero(np.diff(ranks)) + 1
            for r, where in zip(ranks[np.concatenate(([0], cut))].tolist(), np.split(at, cut), strict=True):
                if r in index:
                    index[r].append(where)
                else:
                    index[r] = [where]
                    heapq.heappush(order, r)

        at = np.flatnonzero(right[:n] >= 0).astype(np.int32)
        ranks = self.rank(token[at], token[at + 1])
        if (ranks >= 0).any():
            put(ranks[ranks >= 0], at[ranks >= 0])
        while order:
            r = heapq.heappop(order)
            found = index.pop(r)
            at = found[0] if len(found) == 1 else np.unique(np.concatenate(found))
            after = right[at]
            live = (after >= 0) & (token[at] >= 0)
            at, after = at[live], after[live]
            same = self.rank(token[at], token[after]) == r  # a merge nearby may have taken one of the two
            at, after = at[same], after[same]
            if not len(at):
                continue
            first = np.ones(len(at), bool)
            first[1:] = word[at[1:]] != word[at[:-1]]
            if not first.all():
                put(np.full(len(at) - int(first.sum()), r), at[~first])
                at, after = at[first], after[first]
            token[at], token[after] = r, -1
            beyond = right[after]
            right[at] = beyond
            left[beyond] = at  # for -1 this writes the spare place
            before = left[at]
            p, q = np.concatenate((before, at)), np.concatenate((at, beyond))
            live = (p >= 0) & (q >= 0)
            p, q = p[live], q[live]
            if len(p):
                ranks = self.rank(token[p], token[q])
                if (some := ranks >= 0).any():
                    put(ranks[some], p[some])
        alive = token[:n] >= 0
        counts = np.bincount(word[alive], minlength=len(pieces))
        return token[:n][alive], np.concatenate(([0], np.cumsum(counts)))


class Pieces(dict):
    """Numbers of pieces; new ones are numbered as they come."""

    def __missing__(self, piece: str) -> int:
        number = self[piece] = len(self)
        return number


class Codec:
    """Encodes and decodes whole texts."""

    def __init__(self, replay: MergeReplay, pattern: str):
        self.replay = replay
        self.split = regex.compile(pattern).findall
        self._forget()

    def _forget(self) -> None:
        self.pieces = Pieces()
        self.digits: list[str] = []  # ids of each piece, joined by commas
        self.plain: list[bytes] = []  # its decoded bytes

    def encode_block(self, texts: list[str]) -> list[np.ndarray]:
        """The piece numbers of each text; ``digits`` and ``plain`` then have what each piece stands for."""
        if len(self.pieces) > CACHE_PIECES:
            self._forget()
        number = self.pieces.__getitem__
        out = [np.fromiter(map(number, self.split(t)), np.int32) for t in texts]
        fresh = list(islice(self.pieces, len(self.digits), None))
        tokens, at = self.replay.encode([p.encode() for p in fresh])
        del fresh
        flat, ends = tokens.tolist(), at.tolist()
        token = self.replay.tokens.__getitem__
        for a, b in zip(ends, ends[1:], strict=False):
            ids = flat[a:b]
            self.digits.append(",".join(map(str, ids)))
            self.plain.append(b"".join(map(token, ids)))  # decoding maps over concatenation, so it is done by piece
        return out

    def ids(self, numbers: np.ndarray) -> list[int]:
        digits = ",".join(map(self.digits.__getitem__, numbers.tolist()))
        return list(map(int, digits.split(","))) if digits else []


def result(codec: Codec, rows: pa.Array, encoded: list[np.ndarray], with_ids: bool) -> pa.RecordBatch:
    n, ids_hash, text_hash, all_ids = [], [], [], []
    for numbers in encoded:
        listed = numbers.tolist()
        digits = ",".join(map(codec.digits.__getitem__, listed))
        n.append(digits.count(",") + 1 if digits else 0)
        ids_hash.append(hashlib.sha256(digits.encode()).hexdigest())
        text_hash.append(hashlib.sha256(b"".join(map(codec.plain.__getitem__, listed))).hexdigest())
        if with_ids:
            all_ids.append(np.fromstring(digits, np.int32, sep=","))
    columns = [rows, pa.array(n, pa.int64()), pa.array(ids_hash, pa.string()), pa.array(text_hash, pa.string())]
    if with_ids:
        columns.append(pa.array(all_ids, pa.list_(pa.int32())))
    return pa.RecordBatch.from_arrays(columns, names=["id", "n_tokens", "ids_sha256", "decoded_sha256", "ids"][: len(columns)])


def encode_documents(docs: DataFrame, ranks_path: str, pattern: str, id_col: str = "doc_id", text_col: str = "text", with_ids: bool = True) -> DataFrame:
    """id, n_tokens, ids_sha256, decoded_sha256 and, if asked for, ids array<int> for each row of ``docs``.

    Null and empty texts have no tokens. Repeated rows are encoded each. Characters that the pattern never matches have
    no token. Other columns are ignored. An empty table gives an empty result. The ranks (about a megabyte, fixed by the
    vocabulary file) are broadcast.
    """
    replay = docs.sparkSession.sparkContext.broadcast(MergeReplay(read_ranks(ranks_path)))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        codec = Codec(replay.value, pattern)
        for batch in batches:
            for i, j, _, _ in text_blocks(batch.column(1), BLOCK_BYTES):
                encoded = codec.encode_block([t or "" for t in batch.column(1).slice(i, j - i).to_pylist()])
                for k in range(0, len(encoded), OUT_ROWS):
                    some = encoded[k : k + OUT_ROWS]
                    yield result(codec, batch.column(0).slice(i + k, len(some)), some, with_ids)

    kind = docs.schema[id_col].dataType.simpleString()
    schema = f"id {kind}, n_tokens bigint, ids_sha256 string, decoded_sha256 string" + ", ids array<int>" * with_ids
    return docs.select(F.col(id_col).alias("id"), F.col(text_col).cast("string").alias("text")).transform(arrow_map, run, schema).withColumnRenamed("id", id_col)


def decode_documents(encoded: DataFrame, ranks_path: str, id_col: str = "doc_id", ids_col: str = "ids") -> DataFrame:
    """id, bytes binary for each row; null ids decode to no bytes."""
    ranks = encoded.sparkSession.sparkContext.broadcast(read_ranks(ranks_path))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        token = {rank: token for token, rank in ranks.value.items()}.__getitem__
        for batch in batches:
            decoded = [b"".join(map(token, ids or ())) for ids in batch.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(decoded, pa.binary())], names=["id", "bytes"])

    kind = encoded.schema[id_col].dataType.simpleString()
    return encoded.select(F.col(id_col).alias("id"), F.col(ids_col).alias("ids")).transform(arrow_map, run, f"id {kind}, bytes binary").withColumnRenamed("id", id_col)
