"""Token ids in binary files that readers can open at any document.

A file is a run of independent zstandard frames followed by a seek table in a skippable frame, as in the public seekable
format: for each frame its compressed size, its size and a checksum, then a footer with the number of frames.  The
checksum is the low half of XXH64 of the frame's plain bytes, as the format says.  A frame holds whole documents: their
number, then for each its id, the number of its ids and whether its id is null, then all ids as little-endian unsigned 32-bit integers (16-bit where the vocabulary allows).  A reader of one document needs
the table and one frame.

Writing: rows go to tasks by ranges of ids, each task sorts its rows and writes one file under a name of its own attempt,
renamed when complete; so a repeated task replaces its file whole.  Files go to the folder that all executors share.
Reading: the manifest has one row per frame (first document, documents, tokens); running totals over it place each frame.

Defined results: null or empty text has its end id only; rows that repeat an id stand together, ordered by text within a
file (many such rows may span files, dealt by a hash of the text); a very long text is one document of one frame, in memory
of its size; a null id comes first and stays null; an empty table gives no rows; other columns, of whatever name, are ignored.
"""

from __future__ import annotations

import os
import struct
import zlib
from collections.abc import Iterator
from urllib.parse import urlparse

import numpy as np
import pyarrow as pa
import xxhash
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from . import common as C
from .token_ids import encoder, groups

# Fixed values of the seekable zstandard format.
SKIPPABLE_MAGIC = 0x184D2A5E
SEEK_MAGIC = 0x8F92EAB1
CHECKSUM_FLAG = 0x80
FRAME_BYTES = 1 << 20
MANIFEST = "path string, part long, frame int, documents long, tokens long"
MANIFEST_ARROW = pa.schema([("path", pa.string()), ("part", pa.int64()), ("frame", pa.int32()), ("documents", pa.int64()), ("tokens", pa.int64())])


def open_shared(path: str, mode: str):
    """A file of the shared store; local schemes directly, others through Arrow's file systems."""
    parsed = urlparse(path)
    if parsed.scheme in ("", "file"):
        if "w" in mode:
            os.makedirs(os.path.dirname(parsed.path), exist_ok=True)
        return open(parsed.path, mode)
    from pyarrow import fs

    system, inner = fs.FileSystem.from_uri(path)
    return system.open_output_stream(inner) if "w" in mode else system.open_input_file(inner)


def move_shared(source: str, target: str) -> None:
    parsed = urlparse(source)
    if parsed.scheme in ("", "file"):
        os.replace(parsed.path, urlparse(target).path)
        return
    from pyarrow import fs

    system, inner = fs.FileSystem.from_uri(source)
    system.move(inner, fs.FileSystem.from_uri(target)[1])


def checksum(plain: bytes) -> int:
    return xxhash.xxh64_intdigest(plain) & 0xFFFFFFFF


class Writer:
    """Collects documents into frames and writes them; ``close`` adds the seek table."""

    def __init__(self, file, frame_bytes: int = FRAME_BYTES, level: int = 1):
        self.file, self.frame_bytes = file, frame_bytes
        self.compressor = zstandard.ZstdCompressor(level=level, write_checksum=True)
        self.table: list[tuple[int, int, int]] = []
        self.counts: list[tuple[int, int]] = []
        self.ids: list[int | None] = []
        self.parts: list[bytes] = []
        self.held = 0

    def add(self, doc: int | None, tokens: bytes) -> None:
        self.ids.append(doc)
        self.parts.append(tokens)
        self.held += len(tokens)
        if self.held >= self.frame_bytes:
            self.flush()

    def flush(self) -> None:
        if not self.ids:
            return
        lengths = np.array([len(p) // 4 for p in self.parts], "<i8")
        values = np.frombuffer(b"".join(self.parts), "<u4")
        width = 2 if not len(values) or values.max() < 65536 else 4
        ids, no_id = np.array([i or 0 for i in self.ids], "<i8"), np.array([i is None for i in self.ids], np.uint8)
        plain = struct.pack("<qq", len(ids), width) + ids.tobytes() + lengths.tobytes() + no_id.tobytes() + values.astype(f"<u{width}").tobytes()
        frame = self.compressor.compress(plain)
        self.file.write(frame)
        self.table.append((len(frame), len(plain), checksum(plain)))
        self.counts.append((len(self.ids), int(lengths.sum())))
        self.ids, self.parts, self.held = [], [], 0

    def close(self) -> None:
        self.flush()
        body = b"".join(struct.pack("<III", *row) for row in self.table) + struct.pack("<IBI", len(self.table), CHECKSUM_FLAG, SEEK_MAGIC)
        self.file.write(struct.pack("<II", SKIPPABLE_MAGIC, len(body)) + body)
        self.file.close()


class Reader:
    """Opens a file through its seek table and decompresses single frames."""

    def __init__(self, file):
        self.file = file
        file.seek(0, 2)
        end = file.tell()
        file.seek(end - 9)
        n, flags, magic = struct.unpack("<IBI", file.read(9))
        if magic != SEEK_MAGIC or not flags & CHECKSUM_FLAG:
            raise ValueError("no seek table with checksums")
        file.seek(end - 9 - 12 * n)
        self.table = np.frombuffer(file.read(12 * n), "<u4").reshape(n, 3)
        self.starts = np.concatenate([[0], np.cumsum(self.table[:, 0], dtype=np.int64)])

    def frame(self, k: int) -> tuple[pa.Array, np.ndarray, np.ndarray]:
        """Ids of the documents, their numbers of tokens, and all token ids of frame ``k``."""
        self.file.seek(int(self.starts[k]))
        packed, size, expected = (int(x) for x in self.table[k])
        plain = zstandard.ZstdDecompressor().decompress(self.file.read(packed), max_output_size=size)
        if checksum(plain) != expected:
            raise ValueError(f"frame {k} is damaged")
        n, width = struct.unpack_from("<qq", plain)
        ids, lengths, no_id = np.frombuffer(plain, "<i8", n, 16), np.frombuffer(plain, "<i8", n, 16 + 8 * n), np.frombuffer(plain, np.uint8, n, 16 + 16 * n)
        values = np.frombuffer(plain[16 + 17 * n :], f"<u{width}").astype("<u4")
        return pa.array(ids, mask=no_id.astype(bool)), lengths, values


def write_tokens(docs: DataFrame, tokenizer: str, folder: str, end_id: int = 2) -> DataFrame:
    """Encode ``docs`` (doc_id, text), write files in ascending order of ids, and return the manifest, one row per frame."""
    spark = docs.sparkSession
    C.limit_batches(spark)
    end = np.array([end_id], "<u4").tobytes()
    lean = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    ranged = lean.repartitionByRange(C.shuffle_partitions(spark), F.col("doc_id").asc_nulls_first(), F.xxhash64("text")).sortWithinPartitions(F.col("doc_id").asc_nulls_first(), "text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        context = TaskContext.get()
        part = context.partitionId()
        path = f"{folder}/part-{part:06d}.tokens"
        draft = f"{folder}/draft-{part:06d}-{context.taskAttemptId()}"
        writer = None
        encode = encoder(tokenizer)
        for batch in batches:
            doc, texts = batch.column(0).to_pylist(), batch.column(1).fill_null("").to_pylist()
            writer = writer or Writer(open_shared(draft, "wb"))
            for lo, hi in groups(texts):
                for i, ids in zip(range(lo, hi), encode.encode(texts[lo:hi]), strict=True):
                    writer.add(doc[i], ids + end)
        if writer:
            writer.close()
            move_shared(draft, path)
            yield C.arrow_batch(MANIFEST_ARROW, [(path, part, k, n, tokens) for k, (n, tokens) in enumerate(writer.counts)])

    return C.saved(ranged.mapInArrow(run, MANIFEST), "token-manifest")


READ = "doc_id long, start long, n_tokens long, ids_crc32 long"
READ_ARROW = pa.schema([("doc_id", pa.int64()), ("start", pa.int64()), ("n_tokens", pa.int64()), ("ids_crc32", pa.int64())])


def read_tokens(manifest: DataFrame) -> DataFrame:
    """(doc_id, start, n_tokens, ids_crc32) of every document, from the files that ``manifest`` lists.

    Running totals: per file over its own frames, and over one row per file for what stands before it.
    """
    files = manifest.groupBy("part").agg(F.sum("tokens").alias("of_file"))
    before = files.select("part", (F.sum("of_file").over(Window.orderBy("part")) - F.col("of_file")).alias("before"))
    inside = Window.partitionBy("part").orderBy("frame")
    placed = manifest.withColumn("inside", F.sum("tokens").over(inside) - F.col("tokens")).join(before, "part").select("path", "frame", (F.col("before") + F.col("inside")).alias("start"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        name, reader = None, None
        for batch in batches:
            for path, frame, start in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if path != name:
                    name, reader = path, Reader(open_shared(path, "rb"))
                doc, lengths, ids = reader.frame(frame)
                ends = np.cumsum(lengths)
                starts = ends - lengths
                data = memoryview(ids.tobytes())
                crc = [zlib.crc32(data[4 * s : 4 * e]) for s, e in zip(starts, ends, strict=True)]
                yield pa.RecordBatch.from_arrays([doc, pa.array(starts + start), pa.array(lengths), pa.array(crc, pa.int64())], schema=READ_ARROW)

    spread = placed.repartition(C.shuffle_partitions(manifest.sparkSession), "path", "frame").sortWithinPartitions("path", "frame")
    return spread.mapInArrow(run, READ)


def op10_token_store(spark, sf_dir: str) -> DataFrame:
    import public_tokenizers

    manifest = write_tokens(C.documents(spark, sf_dir), public_tokenizers.path("byte_bpe_50k.json"), C.scratch(spark, "tokens"))
    return read_tokens(manifest)
