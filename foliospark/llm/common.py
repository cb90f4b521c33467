"""What the operators of this subpackage share: scratch tables, schema guards and Arrow blocks."""

from __future__ import annotations

import contextlib
import ctypes
import gc
import tempfile
import uuid
from collections.abc import Callable, Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

_made: list[tuple[SparkSession, str]] = []


def scratch_root(spark: SparkSession) -> str:
    """The shared folder the cluster names in spark.checkpoint.dir; one of our own only where that is unset."""
    root = spark.conf.get("spark.checkpoint.dir", "")
    if not root:
        root = "file://" + tempfile.mkdtemp(prefix="scratch-")
        spark.conf.set("spark.checkpoint.dir", root)
    return root.rstrip("/")


#: Whether Spark deletes the shuffle files of an SQL execution at its end.
CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


@contextlib.contextmanager
def setting(spark: SparkSession, key: str, value: str) -> Iterator[None]:
    """The session's ``key`` is ``value`` inside the block, and as before after it."""
    before = spark.conf.get(key, None)
    spark.conf.set(key, value)
    try:
        yield
    finally:
        if before is None:
            spark.conf.unset(key)
        else:
            spark.conf.set(key, before)


def materialize(df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` as a table in the shared scratch folder and read it back.

    This cuts the lineage with files that every executor can reach, so a lost executor costs a reread and not a
    recomputation. ``release`` removes the tables of a session when their readers are done. The shuffle files of the write
    are of no use once the table is there and go with it; else they fill the disk until the driver collects its garbage.
    """
    spark = df.sparkSession
    path = f"{scratch_root(spark)}/{name}-{uuid.uuid4().hex[:12]}"
    with setting(spark, CLEANUP, "true"):
        df.write.parquet(path)
    _made.append((spark, path))
    table = spark.read.schema(df.schema).parquet(path)
    table.scratch_path = path
    return table


def release(spark: SparkSession) -> None:
    """Delete every scratch table this process wrote for ``spark``; frames that read them are then unusable."""
    jvm, conf = spark._jvm, spark._jsc.hadoopConfiguration()
    for entry in [x for x in _made if x[0] is spark]:
        path = jvm.org.apache.hadoop.fs.Path(entry[1])
        path.getFileSystem(conf).delete(path, True)
        _made.remove(entry)


def discard(*tables: DataFrame) -> None:
    """Delete scratch tables that only tables written since were made from."""
    for table in tables:
        spark = table.sparkSession
        path = spark._jvm.org.apache.hadoop.fs.Path(table.scratch_path)
        path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)
        _made[:] = [x for x in _made if x[1] != table.scratch_path]


#: Most bytes of an Arrow batch between the JVM and Python; long texts then come a few at a time.
BATCH_BYTES = 4 << 20


def arrow_map(frame: DataFrame, run: Callable, schema) -> DataFrame:
    """``mapInArrow`` with batches of bounded size, whatever the length of the texts."""
    spark = frame.sparkSession
    key = "spark.sql.execution.arrow.maxBytesPerBatch"
    digits = str(spark.conf.get(key)).lower().removesuffix("b")
    if not digits.isdigit() or int(digits) > BATCH_BYTES:
        spark.conf.set(key, str(BATCH_BYTES))

    def bounded(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        lean_memory()
        yield from run(batches)
        give_back()

    return frame.mapInArrow(bounded, schema)


def lean_memory() -> None:
    """Let a worker's larger arrays, Arrow's too, be mappings of their own, which go back to the system when they are freed."""
    pa.set_memory_pool(pa.system_memory_pool())  # the usual pool keeps what it once had
    with contextlib.suppress(OSError, AttributeError):  # other C libraries
        libc = ctypes.CDLL("libc.so.6")
        libc.mallopt(-3, 1 << 20)  # M_MMAP_THRESHOLD, which else grows with the arrays
        libc.mallopt(-1, 1 << 20)  # M_TRIM_THRESHOLD


def give_back() -> None:
    """Return freed memory of a reused worker to the system, for the tasks that follow."""
    gc.collect()
    pa.default_memory_pool().release_unused()
    with contextlib.suppress(OSError, AttributeError):  # other C libraries
        ctypes.CDLL("libc.so.6").malloc_trim(0)


def load(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{table}.parquet")


def text_of(col: str = "text") -> Column:
    """A null text counts as empty."""
    return F.coalesce(F.col(col), F.lit(""))


def fresh(columns: list[str], *names: str) -> list[str]:
    """The names, lengthened until none of ``columns`` is like them."""
    taken = {c.lower() for c in columns}
    out = []
    for name in names:
        while name.lower() in taken:
            name += "_"
        out.append(name)
        taken.add(name.lower())
    return out


def union_all(frames: list[DataFrame]) -> DataFrame:
    return reduce(DataFrame.unionByName, frames)


def fold(doc_id: Column, modulus: int) -> Column:
    """crc32 of the id's decimal digits, modulo ``modulus``; a null id is in fold 0."""
    return F.coalesce(F.pmod(F.crc32(doc_id.cast("string").cast("binary")), F.lit(modulus)), F.lit(0)).cast("int")


def string_buffers(column: pa.Array | pa.ChunkedArray) -> tuple[np.ndarray, np.ndarray]:
    """The UTF-8 bytes of a text column without a copy, and len + 1 offsets; nulls have no bytes."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    large = pa.types.is_large_string(column.type) or pa.types.is_large_binary(column.type)
    if column.null_count:
        column = column.fill_null("" if pa.types.is_string(column.type) or pa.types.is_large_string(column.type) else b"")
    _, at, data = column.buffers()
    if len(column) == 0:
        return np.zeros(0, np.uint8), np.zeros(1, np.int64)
    offsets = np.frombuffer(at, np.int64 if large else np.int32)[column.offset : column.offset + len(column) + 1].astype(np.int64)
    values = np.frombuffer(data, np.uint8) if data is not None and data.size else np.zeros(0, np.uint8)
    return values, offsets


def text_blocks(column: pa.Array, most_bytes: int) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """Cut a text column into runs of rows of at most ``most_bytes`` bytes (one longer row stands alone).

    Yields first row, end row, bytes, offsets into those bytes.
    """
    values, offsets = string_buffers(column)
    n, i = len(offsets) - 1, 0
    while i < n:
        j = max(i + 1, int(np.searchsorted(offsets, offsets[i] + most_bytes, "right")) - 1)
        yield i, j, values[offsets[i] : offsets[j]], offsets[i : j + 1] - offsets[i]
        i = j
