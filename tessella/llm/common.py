"""Shared building blocks: vectorised word hashing over Arrow buffers, packed hash-bucket exchanges, shared scratch tables.

Rows that Python produces in bulk (n-gram hashes, anchors, counts) never travel as one Spark row each.  A map task packs
the entries bound for one hash bucket into a single binary row; a bucket task unpacks them into numpy arrays.  The shuffle
therefore moves nearly incompressible hash bytes only, and a bucket's memory is its share of the entries.
"""

from __future__ import annotations

import ctypes
import threading
import uuid
from collections.abc import Callable, Iterable, Iterator
from contextlib import contextmanager

import numpy as np
import pyarrow as pa
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

# The separators between words, space and tab to carriage return.
SEPARATORS = (0x20, 0x09, 0x0A, 0x0B, 0x0C, 0x0D)
WORD_SPLIT = "[\\x20\\x09-\\x0D]+"
SLICE_BYTES = 1 << 20

_U64 = np.uint64
_BASE = 0x9E3779B97F4A7C15 | 1
_IS_SEP = np.zeros(256, bool)
_IS_SEP[list(SEPARATORS)] = True
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
_SEEDS = np.random.default_rng(20240607).integers(1, 1 << 63, size=(2, 256), dtype=np.uint64) * _U64(2) + _U64(1)
_powers: dict[str, np.ndarray] = {}


def return_memory() -> None:
    """Make the allocator give large freed arrays back at once; workers are reused and would keep their peak."""
    try:
        libc = ctypes.CDLL("libc.so.6")
        libc.mallopt(-3, 1 << 20)
        libc.mallopt(-1, 8 << 20)
        libc.malloc_trim(0)
    except (OSError, AttributeError):  # another C library: it keeps its own policy
        pass
    pa.default_memory_pool().release_unused()


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/documents.parquet")


def fold(column: str, modulus: int):
    """crc32 of the id as text, modulo ``modulus``; a null id counts as the empty string."""
    return F.crc32(F.coalesce(F.col(column).cast("string"), F.lit(""))) % F.lit(modulus)


def shuffle_partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


BATCH_BYTES = "spark.sql.execution.arrow.maxBytesPerBatch"


def limit_batches(spark: SparkSession, size: str = "8m") -> None:
    """Keep Arrow batches small, as texts can be very long, unless the caller has set a size.

    Spark reads the setting when a plan runs, after the operator has returned, so it stays.
    """
    if spark.conf.get(BATCH_BYTES, size) == size:
        spark.conf.set(BATCH_BYTES, size)


def scratch(spark: SparkSession, label: str) -> str:
    """A fresh path in the folder that all executors share; the cluster's own setting wins."""
    base = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if not base:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        base = spark.conf.get("spark.sql.warehouse.dir").rstrip("/") + "/_scratch"
    return f"{base.rstrip('/')}/{label}-{uuid.uuid4().hex}"


def delete(spark: SparkSession, path: str) -> None:
    """Remove a scratch table that no plan reads any more."""
    target = spark._jvm.org.apache.hadoop.fs.Path(path)
    target.getFileSystem(spark._jsc.hadoopConfiguration()).delete(target, True)


CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
_cleaning = threading.Lock()
_cleaners: list[str] = []


@contextmanager
def _clean_shuffles(spark: SparkSession):
    """Shuffle files go when their step is done; the caller's setting returns with the last step that is under way."""
    with _cleaning:
        _cleaners.append(_cleaners[0] if _cleaners else spark.conf.get(CLEANUP, "false"))
        spark.conf.set(CLEANUP, "true")
    try:
        yield
    finally:
        with _cleaning:
            before = _cleaners.pop()
            if not _cleaners:
                spark.conf.set(CLEANUP, before)


def saved(df: DataFrame, label: str) -> DataFrame:
    """Cut the lineage: write to the shared folder and read back.  The step's shuffle files go as soon as it is done."""
    spark = df.sparkSession
    path = scratch(spark, label)
    with _clean_shuffles(spark):
        df.write.parquet(path)
    table = spark.read.schema(df.schema).parquet(path)
    table._scratch_path = path
    return table


def forget(table: DataFrame) -> None:
    """Delete a table of ``saved`` after its last reader has run."""
    delete(table.sparkSession, table._scratch_path)


def schema_with(df: DataFrame, **columns: str) -> str:
    """DDL of a frame's columns and further ones."""
    kinds = [(f.name, f.dataType.simpleString()) for f in df.schema.fields] + list(columns.items())
    return ", ".join(f"`{name.replace('`', '``')}` {kind}" for name, kind in kinds)


def compress(array: np.ndarray) -> bytes:
    return zstandard.ZstdCompressor(level=1).compress(np.ascontiguousarray(array).tobytes())


def expand(data: bytes, dtype) -> np.ndarray:
    return np.frombuffer(zstandard.ZstdDecompressor().decompress(data), dtype)


def _power(n: int) -> tuple[np.ndarray, np.ndarray]:
    have = _powers.get("p")
    if have is None or len(have) < n:
        size = max(n, SLICE_BYTES + 1)
        inverse = pow(_BASE, -1, 1 << 64)
        steps = np.full(size, _BASE, _U64)
        steps[0] = 1
        back = np.full(size, inverse, _U64)
        back[0] = 1
        p, q = np.cumprod(steps, dtype=_U64), np.cumprod(back, dtype=_U64)
        if size > 1 << 24:
            return p, q
        _powers["p"], _powers["q"] = p, q
    return _powers["p"], _powers["q"]


def mix(h: np.ndarray) -> np.ndarray:
    """A bijective finaliser on 64-bit lanes."""
    h = h ^ (h >> _U64(33))
    h = h * _U64(0xFF51AFD7ED558CCD)
    h = h ^ (h >> _U64(33))
    h = h * _U64(0xC4CEB9FE1A85EC53)
    return h ^ (h >> _U64(33))


class Words:
    """The words of a run of texts: for each its hash, its text's ordinal and its place there."""

    def __init__(self, data: np.ndarray, offsets: np.ndarray, lower: bool, lanes: int = 1, separators: np.ndarray = _IS_SEP):
        n = len(data)
        self.n_docs = len(offsets) - 1
        sep = separators[data]
        edge = np.zeros(n + 1, bool)
        edge[offsets] = True
        before = np.empty(n, bool)
        after = np.empty(n, bool)
        if n:
            before[0], after[-1] = True, True
            before[1:], after[:-1] = sep[:-1], sep[1:]
        word = ~sep
        self.starts = np.flatnonzero(word & (before | edge[:n]))
        self.ends = np.flatnonzero(word & (after | edge[1:])) + 1
        first = np.searchsorted(self.starts, offsets)
        self.first = first
        self.count = np.diff(first)
        self.doc = np.repeat(np.arange(self.n_docs), self.count)
        self.place = np.arange(len(self.starts)) - first[:-1][self.doc]
        text = _LOWER[data] if lower else data
        p, q = _power(n + 1)
        self.hash = []
        for lane in range(lanes):
            total = np.zeros(n + 1, _U64)
            np.cumsum(_SEEDS[lane][text] * p[:n], out=total[1:])
            self.hash.append(mix((total[self.ends] - total[self.starts]) * q[self.starts]))

    def grams(self, size: int, lane: int = 0) -> tuple[np.ndarray, np.ndarray]:
        """Hash of every ``size`` consecutive words of one text, and the index of its first word."""
        at = np.flatnonzero(self.place + size <= self.count[self.doc]) if len(self.doc) else np.zeros(0, np.int64)
        h = self.hash[lane]
        total = np.zeros(len(at), _U64)
        for k in range(size):
            total = total * _U64(_BASE) + h[at + k]
        return mix(total + _U64(size)), at


def text_buffers(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The UTF-8 bytes and offsets of an Arrow string column, nulls as empty."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    if column.null_count:
        column = column.fill_null("")
    wide = pa.types.is_large_string(column.type)
    buffers = column.buffers()
    offsets = np.frombuffer(buffers[1], np.int64 if wide else np.int32)[column.offset : column.offset + len(column) + 1]
    offsets = offsets.astype(np.int64)
    data = np.frombuffer(buffers[2], np.uint8) if buffers[2] is not None else np.zeros(0, np.uint8)
    return data, offsets


def word_slices(column: pa.Array, lower: bool, lanes: int = 1, separators: np.ndarray = _IS_SEP) -> Iterator[tuple[int, int, Words]]:
    """Cut a column into runs of texts of about SLICE_BYTES and hash the words of each."""
    if not len(column):
        return
    return_memory()
    data, offsets = text_buffers(column)
    at, n = 0, len(offsets) - 1
    while at < n:
        to = max(at + 1, int(np.searchsorted(offsets, offsets[at] + SLICE_BYTES, "right")) - 1)
        part = data[offsets[at] : offsets[to]]
        yield at, to, Words(part, offsets[at : to + 1] - offsets[at], lower, lanes, separators)
        at = to


def bucket_of(h: np.ndarray, buckets: int) -> np.ndarray:
    return ((h >> _U64(40)) * _U64(buckets)) >> _U64(24)


def by_bucket(bucket: np.ndarray) -> Iterator[tuple[int, np.ndarray]]:
    """For each bucket in use, the indices of its entries in their order."""
    if not len(bucket):
        return
    small = bucket.astype(np.uint16) if bucket.max() < 65536 else bucket
    order = np.argsort(small, kind="stable")
    ordered = bucket[order]
    cuts = np.flatnonzero(np.diff(ordered)) + 1
    for part in np.split(order, cuts):
        yield int(bucket[part[0]]), part


def runs(*keys: np.ndarray) -> np.ndarray:
    """Starts of the runs of equal rows in sorted columns."""
    n = len(keys[0])
    if not n:
        return np.zeros(0, np.int64)
    change = np.zeros(n, bool)
    change[0] = True
    for k in keys:
        change[1:] |= k[1:] != k[:-1]
    return np.flatnonzero(change)


def ids(column: pa.Array) -> np.ndarray:
    """Ids as int64; ``null_mask`` tells a null from the 0 that stands for it here."""
    return column.cast(pa.int64()).fill_null(0).to_numpy(zero_copy_only=False)


def null_mask(column: pa.Array) -> np.ndarray:
    return column.is_null().to_numpy(zero_copy_only=False)


def id_bytes(column: pa.Array) -> bytes:
    """Ids and which are null; ``id_array`` reads them."""
    return bundle(ids(column), null_mask(column))


def id_array(body) -> pa.Array:
    values, nulls = unbundle(body)
    return pa.array(np.frombuffer(values, np.int64), mask=np.frombuffer(nulls, bool))


def arrow_batch(schema: pa.Schema, rows: list[tuple]) -> pa.RecordBatch:
    columns = list(zip(*rows, strict=True)) if rows else [[] for _ in schema]
    return pa.RecordBatch.from_arrays([pa.array(c, t.type) for c, t in zip(columns, schema, strict=True)], schema=schema)


def map_buckets(df: DataFrame, key: str, work: Callable[[int, pa.Table], Iterable[pa.RecordBatch]], schema: str, partitions: int) -> DataFrame:
    """Bring the rows of each bucket together and hand them over, one bucket at a time."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = [b for b in batches if b.num_rows]
        if not held:
            return
        return_memory()
        table = pa.Table.from_batches(held)
        keys = table[key].to_numpy()
        for bucket, rows in by_bucket(keys - keys.min()):
            yield from work(bucket + int(keys.min()), table.take(pa.array(rows)))
        del held, table
        return_memory()

    return df.repartition(partitions, key).mapInArrow(run, schema)


# --- questions to all rows, asked and answered in bulk -----------------------------------------------------------------
# A task groups its rows into flushes.  A flush has a name of its own, a table that only its own resolver needs (kept
# rows, ids), and questions packed by hash bucket.  Answers return to the flush by name, so questions refer to rows by
# their ordinal in the flush, which costs a byte or so, and not by a key.

ASK = "bucket int, flush long, body binary"
ASK_ARROW = pa.schema([("bucket", pa.int32()), ("flush", pa.int64()), ("body", pa.binary())])


def bundle(*arrays: np.ndarray | bytes) -> bytes:
    """Arrays (or bytes) one after the other, with their lengths before them."""
    parts = [a if isinstance(a, bytes) else np.ascontiguousarray(a).tobytes() for a in arrays]
    return np.array([len(parts), *map(len, parts)], np.int64).tobytes() + b"".join(parts)


def unbundle(body: bytes) -> list[memoryview]:
    n = int(np.frombuffer(body, np.int64, 1)[0])
    sizes = np.frombuffer(body, np.int64, n, 8)
    view, at, out = memoryview(body), 8 + 8 * n, []
    for size in sizes:
        out.append(view[at : at + int(size)])
        at += int(size)
    return out


def planes(array: np.ndarray) -> bytes:
    """Compressed byte planes of 32-bit numbers that are mostly small: the high bytes cost next to nothing."""
    return zstandard.ZstdCompressor(level=3).compress(np.ascontiguousarray(array.astype("<i4").view(np.uint8).reshape(-1, 4).T).tobytes())


def from_planes(data) -> np.ndarray:
    flat = np.frombuffer(zstandard.ZstdDecompressor().decompress(data), np.uint8)
    return np.ascontiguousarray(flat.reshape(4, -1).T).view("<i4").reshape(-1)


def small(array: np.ndarray, dtype=np.int32) -> bytes:
    """Compressed differences: for values that rise, or repeat."""
    return compress(np.diff(array.astype(dtype), prepend=array.dtype.type(0)).astype(dtype))


def unsmall(data, dtype=np.int32) -> np.ndarray:
    return np.cumsum(expand(data, dtype), dtype=dtype)


def ask_all(
    asks: DataFrame,
    answer: Callable[[int, list[tuple[int, bytes]]], Iterable[tuple[int, bytes]]],
    resolve: Callable[[int, bytes, list[bytes]], Iterable[pa.RecordBatch]],
    schema: str,
    partitions: int,
    tables: DataFrame | None = None,
) -> DataFrame:
    """``asks``: rows of ASK; a bucket of -1 marks a flush's table, others questions.

    Large tables come apart, as ``tables``, and skip the first exchange.

    ``answer`` gets a bucket and its (flush, question) pairs, in order of flush, and yields (flush, answer); ``resolve``
    gets a flush's name, table and answers, these in order of bucket.  So what they do does not depend on the order in
    which a shuffle delivers rows.  The rows of an asking task must come in a fixed order: from files, or sorted.
    """

    def answers(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[int, list[tuple[int, bytes]]] = {}
        for batch in batches:
            for bucket, flush, body in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if bucket < 0:
                    yield arrow_batch(ASK_ARROW, [(-1, flush, body)])
                else:
                    held.setdefault(bucket, []).append((flush, body))
        return_memory()
        for bucket in sorted(held):
            asked = sorted(held.pop(bucket), key=lambda row: row[0])
            rows = [(bucket, flush, body) for flush, body in answer(bucket, asked)]
            if rows:
                yield arrow_batch(ASK_ARROW, rows)
        return_memory()

    def resolved(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        current, table, parts = None, b"", []
        return_memory()
        for batch in batches:
            for bucket, flush, body in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if flush != current:
                    if current is not None:
                        yield from resolve(current, table, parts)
                    current, table, parts = flush, b"", []
                if bucket < 0:
                    table = body
                else:
                    parts.append(body)
        if current is not None:
            yield from resolve(current, table, parts)
        return_memory()

    # A table travels by its flush's name, a question by its bucket.
    route = F.when(F.col("bucket") < 0, F.col("flush")).otherwise(F.col("bucket").cast("long"))
    answered = asks.withColumn("route", route).repartition(partitions, "route").select("bucket", "flush", "body").mapInArrow(answers, ASK)
    if tables is not None:
        answered = answered.unionAll(tables)
    return answered.repartition(partitions, "flush").sortWithinPartitions("flush", "bucket").mapInArrow(resolved, schema)


def low48(h: np.ndarray) -> bytes:
    """The low six bytes of each hash: the bucket tells the rest apart well enough."""
    return np.ascontiguousarray(h.astype("<u8")).view(np.uint8).reshape(-1, 8)[:, :6].tobytes()


def from48(data, bucket: int = 0) -> np.ndarray:
    out = np.zeros((len(data) // 6, 8), np.uint8)
    out[:, :6] = np.frombuffer(data, np.uint8).reshape(-1, 6)
    return out.view("<u8").reshape(-1) | _U64(bucket << 48)


# Entries that a flush should have for each bucket.
PER_BUCKET = 64


def flush_size(least: int, buckets: int) -> int:
    """Entries of a flush: more with more buckets, so that rows (flushes times buckets) stay few beside entries."""
    return max(least, PER_BUCKET * buckets)


def flush_name(sequence: int) -> int:
    return (TaskContext.get().partitionId() << 32) + sequence
