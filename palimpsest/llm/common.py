"""Helpers that the operators of this subpackage share: staged tables, Arrow slices, word hashing.

Conventions that hold for every operator here: a null text is an empty text, a null key is a key of
its own, input columns other than those named are never read (so names cannot clash), and an empty
table gives an empty result with the same columns.
"""

from __future__ import annotations

import ctypes
import tempfile
import uuid
from collections.abc import Callable, Iterator
from contextlib import suppress
from functools import wraps

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Bytes of text that one vectorised step takes at most (one longer text is a step of its own).
STEP_BYTES = 2 << 20


def shared_dir(spark: SparkSession) -> str:
    """The folder that all executors share. A temporary one only in a local session that names none; a cluster must name it."""
    name = spark.conf.get("spark.checkpoint.dir", None)
    if not name:
        if not spark.sparkContext.master.startswith("local["):
            raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
        name = tempfile.mkdtemp(prefix="palimpsest-")
        spark.conf.set("spark.checkpoint.dir", name)
    return name.rstrip("/")


def staged_at(df: DataFrame, label: str, **options: str) -> tuple[DataFrame, str]:
    """Write a table to the shared folder and read it again: the lineage ends there, lost executors or not. Its path comes second."""
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/{label}-{uuid.uuid4().hex}"
    df.write.options(**options).parquet(path)
    rest(spark)
    return spark.read.schema(df.schema).parquet(path), path


def rest(spark: SparkSession) -> None:
    """Give back what the driver has freed when a job is done: its Python's memory, and its heap if over half of what it may have is in use or garbage.

    Plans and finished tasks leave much garbage; a heap that grew for it is the driver's for good otherwise, and operators have many jobs.
    """
    give_back()
    heap = spark._jvm.java.lang.Runtime.getRuntime()
    if heap.totalMemory() * 2 > heap.maxMemory():
        spark._jvm.java.lang.System.gc()


def staged(df: DataFrame, label: str, **options: str) -> DataFrame:
    return staged_at(df, label, **options)[0]


def unstage(spark: SparkSession, *paths: str) -> None:
    """Delete staged tables that no later step reads."""
    for path in paths:
        folder = spark._jvm.org.apache.hadoop.fs.Path(path)
        folder.getFileSystem(spark._jsc.hadoopConfiguration()).delete(folder, True)


#: Rows of an Arrow batch: with whole texts in them, the session's usual number would hold a worker's memory many times over.
BATCH_ROWS = 500


def documents(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", rows: int = BATCH_ROWS) -> DataFrame:
    """Only (doc_id, text), a null text as an empty one. The session's Arrow batches become small ones."""
    df.sparkSession.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(rows))
    return df.select(F.col(id_col).cast("long").alias("doc_id"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))


def code_units(column: Column) -> Column:
    """Number of `[^\\x20\\x09-\\x0D]+` words of a text column, in built-in functions."""
    return F.size(F.filter(F.split(F.coalesce(column, F.lit("")), "[\\x20\\x09-\\x0D]+"), lambda x: x != "")).cast("long")


def text_bytes(array: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """One uint8 array of all texts of a string array, and the n + 1 offsets of the texts in it."""
    if isinstance(array, pa.ChunkedArray):
        array = array.combine_chunks()
    if array.null_count:
        array = array.fill_null("")
    kind = np.int64 if pa.types.is_large_string(array.type) or pa.types.is_large_binary(array.type) else np.int32
    _, offsets, data = array.buffers()
    if len(array) == 0 or offsets is None:
        return np.zeros(0, np.uint8), np.zeros(len(array) + 1, np.int64)
    offs = np.frombuffer(offsets, kind)[array.offset : array.offset + len(array) + 1].astype(np.int64)
    raw = np.frombuffer(data, np.uint8)[offs[0] : offs[-1]] if data is not None else np.zeros(0, np.uint8)
    return raw, offs - offs[0]


def steps(batches: Iterator[pa.RecordBatch], column: str = "text", most: int = STEP_BYTES) -> Iterator[pa.RecordBatch]:
    """Cut record batches so that the texts of each come to `most` bytes, or are a single text."""
    for batch in batches:
        if batch.num_rows == 0:
            continue
        offs = text_bytes(batch.column(column))[1]
        first = 0
        while first < batch.num_rows:
            last = max(first + 1, int(np.searchsorted(offs, offs[first] + most, "right")) - 1)
            yield batch.slice(first, last - first)
            first = last


def lean(run: Callable) -> Callable:
    """A mapInArrow function that gives its worker's freed memory back to the system when a task ends: idle workers stay small."""

    @wraps(run)
    def leaner(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        try:
            yield from run(batches)
        finally:
            give_back()

    return leaner


def lean_groups(run: Callable) -> Callable:
    """The same for an applyInArrow function of batches."""

    @wraps(run)
    def leaner(key: tuple[pa.Scalar, ...], batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        try:
            yield from run(key, batches)
        finally:
            give_back()

    return leaner


def give_back() -> None:
    """Give a worker's freed memory back to the system."""
    for k in range(2):
        _powers[k] = np.ones(1, np.uint64)
    pa.default_memory_pool().release_unused()
    with suppress(OSError, AttributeError):
        ctypes.CDLL("libc.so.6").malloc_trim(0)


#: Odd multiplier of the prefix hash and its inverse modulo 2**64.
BASE = 0x9E3779B97F4A7C15
_INVERSE = pow(BASE, -1, 1 << 64)
_powers = [np.ones(1, np.uint64), np.ones(1, np.uint64)]


def powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """BASE**i and BASE**-i for i below n at least."""
    if len(_powers[0]) < n:
        for k, base in enumerate((BASE, _INVERSE)):
            step = np.full(max(n, 1 << 16), np.uint64(base))
            step[0] = 1
            _powers[k] = np.multiply.accumulate(step)
    return _powers[0], _powers[1]


def mix(x: np.ndarray, seed: int = 0) -> np.ndarray:
    """splitmix64's finaliser."""
    x = x + np.uint64((0x9E3779B97F4A7C15 * (seed + 1)) & (2**64 - 1))
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


_BYTES = mix(np.arange(256, dtype=np.uint64), 7)
LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32
SPACE = np.zeros(256, bool)
SPACE[[9, 10, 11, 12, 13, 32]] = True


def prefix_hash(raw: np.ndarray, lower: bool = False) -> np.ndarray:
    """C with span_hash(C, i, j) a 64-bit hash of raw[i:j]."""
    table = _BYTES[LOWER] if lower else _BYTES
    out = np.zeros(len(raw) + 1, np.uint64)
    np.cumsum(table[raw] * powers(len(raw) + 1)[0][: len(raw)], out=out[1:])
    return out


def span_hash(prefix: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    inverse = powers(len(prefix))[1]
    return mix((prefix[end] - prefix[start]) * inverse[start] + (end - start).astype(np.uint64))


class Words:
    """The words `[^\\x20\\x09-\\x0D]+` of a step's texts: start, end (bytes), first (word offsets of the n texts)."""

    def __init__(self, raw: np.ndarray, offs: np.ndarray) -> None:
        inside = np.zeros(len(raw) + 1, bool)
        inside[:-1] = ~SPACE[raw]
        begin = inside.copy()
        begin[1:] &= ~inside[:-1]
        heads = offs[:-1][np.diff(offs) > 0]
        begin[heads] = inside[heads]
        stop = np.zeros(len(raw) + 1, bool)
        stop[1:] = inside[:-1] & ~inside[1:]
        stop[heads] |= inside[np.maximum(heads - 1, 0)] & (heads > 0)
        self.raw, self.offs = raw, offs
        self.start, self.end = np.flatnonzero(begin), np.flatnonzero(stop)
        self.first = np.searchsorted(self.start, offs)
        self.counts = np.diff(self.first)

    def hashes(self, lower: bool = False) -> np.ndarray:
        return span_hash(prefix_hash(self.raw, lower), self.start, self.end)

    def text_of(self) -> np.ndarray:
        """The text that each word belongs to."""
        return np.repeat(np.arange(len(self.counts)), self.counts)


def shingles(hashes: np.ndarray, first: np.ndarray, width: int) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of all runs of `width` words that stay in a text, and the offsets of the texts among them."""
    n = len(hashes) - width + 1
    counts = np.maximum(np.diff(first) - width + 1, 0)
    out = np.concatenate([[0], np.cumsum(counts)])
    if n <= 0:
        return np.zeros(0, np.uint64), out
    acc = np.zeros(n, np.uint64)
    for k in range(width):
        acc = acc * np.uint64(0xD6E8FEB86659FD93) + hashes[k : k + n]
    acc = mix(acc, width)
    at = np.repeat(first[:-1] - out[:-1], counts) + np.arange(out[-1])
    return acc[at], out


def runs_of(ordered: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The distinct values of a sorted array, and where each one's run begins and ends: work follows the array, never the range of values."""
    begins = np.flatnonzero(np.concatenate([[True], ordered[1:] != ordered[:-1]])) if len(ordered) else np.zeros(0, np.int64)
    return ordered[begins], begins, np.append(begins[1:], len(ordered)) if len(ordered) else begins


def segment_sums(values: np.ndarray, offs: np.ndarray) -> np.ndarray:
    total = np.concatenate([np.zeros(1, values.dtype if values.dtype.kind == "f" else np.int64), np.cumsum(values, dtype=None if values.dtype.kind == "f" else np.int64)])
    return total[offs[1:]] - total[offs[:-1]]


# -- Keys that are met twice -----------------------------------------------------------------------------

#: Most bits of a broadcast table, whatever the input, as a power of two: 32 MB. Smaller inputs have smaller tables.
TABLE_BITS = 28


def table_bits(total: int) -> int:
    """The size of a table for `total` keys: four bits each, as a power of two."""
    return min(TABLE_BITS, max(16, int(total).bit_length() + 2))


def _size_of(table) -> int:
    return (len(table.value) * 8).bit_length() - 1


def key_bits(total: int) -> int:
    """Leading bits of a 64-bit key that tell about `total` keys apart."""
    return min(32 + TABLE_BITS - 3, max(40, int(total).bit_length() + 8))


def packed_keys(key: np.ndarray, shared: np.ndarray) -> pa.RecordBatch:
    """Sorted distinct keys of a step as 32-bit rests by bucket; one that the step itself has met twice is written twice."""
    bucket, begins, ends = runs_of((key >> np.uint64(32)).astype(np.int64))
    low = key.astype(np.uint32)
    rows = [np.concatenate([low[a:b], low[a:b][shared[a:b]]]).tobytes() for a, b in zip(begins.tolist(), ends.tolist(), strict=True)]
    return pa.RecordBatch.from_arrays([pa.array(bucket, pa.int32()), pa.array(rows, pa.binary())], ["bucket", "packed"])


def _rests(table: pa.Table) -> tuple[np.ndarray, np.ndarray]:
    """The distinct rests of a bucket and how often each was sent."""
    low = np.sort(np.concatenate([np.frombuffer(x.as_buffer(), np.uint32) for x in table.column("packed").combine_chunks()]))
    values, begins, ends = runs_of(low)
    return values, ends - begins


#: Bytes of a table that the driver fetches at once: its JVM holds what it fetches several times over.
PIECE = 2 << 20


def _broadcast(packed: DataFrame, part: Callable, buckets: int, width: int):
    """The parts of a table side by side; its caller destroys it when the last job that reads it is done."""
    whole = bytearray(buckets * width)  # sent as it is: the driver's Python holds a table once
    flags = np.frombuffer(whole, np.uint8)
    parts = packed.groupBy("bucket").applyInArrow(part, "bucket int, flags binary")
    # Dealt evenly, whatever partitions the parts were made in; they are made once and then fetched partition by partition.
    for r in parts.repartition(max(2, -(-len(flags) // PIECE))).toLocalIterator():
        flags[r.bucket * width : (r.bucket + 1) * width] = np.frombuffer(r.flags, np.uint8)
    table = packed.sparkSession.sparkContext.broadcast(whole)
    del flags, whole
    rest(packed.sparkSession)
    return table


def shared_table(packed: DataFrame, bits: int, size: int = TABLE_BITS):
    """A broadcast bit table in which each key that was met twice has its bit set. Other keys may hit a set bit, so a hit is a candidate and nothing more."""
    kept = size - (bits - 32)

    def part(key: tuple, table: pa.Table) -> pa.Table:
        low, count = _rests(table)
        flags = np.zeros(1 << kept, bool)
        flags[low[count > 1] >> np.uint32(32 - kept)] = True
        return pa.table({"bucket": pa.array([key[0].as_py()], pa.int32()), "flags": pa.array([np.packbits(flags).tobytes()], pa.binary())})

    return _broadcast(packed, part, 1 << (bits - 32), (1 << kept) // 8)


def in_table(table, keys: np.ndarray) -> np.ndarray:
    """Which 64-bit keys have their bit set."""
    flags = np.frombuffer(table.value, np.uint8)
    slot = keys >> np.uint64(64 - _size_of(table))
    return ((flags[slot >> np.uint64(3)] >> (np.uint8(7) - (slot & np.uint64(7)).astype(np.uint8))) & 1).astype(bool)


#: Numbers of sightings from which a key is on level 1, 2 and 3.
LEVELS = (2, 8, 64)


def level_table(packed: DataFrame, bits: int, size: int = TABLE_BITS):
    """A broadcast table of 2-bit levels, as large as a bit table: 0 is a key that was met once at most; a slot has the highest level of its keys."""
    kept = size - 1 - (bits - 32)

    def part(key: tuple, table: pa.Table) -> pa.Table:
        low, count = _rests(table)
        flags = np.zeros(1 << kept, np.uint8)
        for level, least in enumerate(LEVELS, 1):
            flags[low[count >= least] >> np.uint32(32 - kept)] = level
        four = flags.reshape(-1, 4) << np.array([0, 2, 4, 6], np.uint8)
        return pa.table({"bucket": pa.array([key[0].as_py()], pa.int32()), "flags": pa.array([four.sum(1, dtype=np.uint8).tobytes()], pa.binary())})

    return _broadcast(packed, part, 1 << (bits - 32), (1 << kept) // 4)


def levels_of(table, keys: np.ndarray) -> np.ndarray:
    flags = np.frombuffer(table.value, np.uint8)
    slot = keys >> np.uint64(65 - _size_of(table))
    return (flags[slot >> np.uint64(2)] >> ((slot & np.uint64(3)).astype(np.uint8) * np.uint8(2))) & np.uint8(3)


def _row_hash(columns: list[np.ndarray]) -> np.ndarray:
    out = np.zeros(len(columns[0]), np.uint64)
    for column in columns:
        out = mix(out + column.astype(np.int64).view(np.uint64), 5)
    return out


def value_table(values: DataFrame, most: int):
    """A broadcast bit table of a frame's rows of longs (null: 0), to leave out rows early: `in_values` is true for each of its rows and for a few others.

    most: a bound of its number of rows, for the table's size.
    """
    size = table_bits(most * 4)
    inner = min(size, 20)

    def send(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            x = _row_hash([c.fill_null(0).to_numpy(zero_copy_only=False) for c in batch.columns])
            if len(x):
                slot = np.unique(x >> np.uint64(64 - size))
                bucket, begins, ends = runs_of((slot >> np.uint64(inner)).astype(np.int64))
                low = (slot & np.uint64((1 << inner) - 1)).astype(np.uint32)
                yield pa.RecordBatch.from_arrays([pa.array(bucket, pa.int32()), pa.array([low[a:b].tobytes() for a, b in zip(begins.tolist(), ends.tolist(), strict=True)], pa.binary())], ["bucket", "packed"])

    def part(key: tuple, table: pa.Table) -> pa.Table:
        flags = np.zeros(1 << inner, bool)
        flags[_rests(table)[0]] = True
        return pa.table({"bucket": pa.array([key[0].as_py()], pa.int32()), "flags": pa.array([np.packbits(flags).tobytes()], pa.binary())})

    return _broadcast(values.mapInArrow(send, "bucket int, packed binary"), part, 1 << (size - inner), (1 << inner) // 8)


def in_values(table, *columns: np.ndarray) -> np.ndarray:
    return in_table(table, _row_hash(list(columns)))
