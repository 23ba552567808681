"""Exact substring deduplication through difference-cover anchors.

A difference cover D modulo p contains, for every residue r, a pair (a, b) with a - b = r.  So for any two occurrences
of the same ``window`` words there is a shift below p that puts both on cover positions, and the ``window - p + 1`` words
there form one anchor that both hash.  Only cover positions are hashed: |D| / p of them (4 of 13 by default).

1. Each text hashes its anchors; a bucket exchange finds the anchors that occur more than once.
2. Each repeated anchor extends to the windows that hold it at a shift below p; these candidates get a 128-bit hash.
3. A second exchange keeps, for each window hash, its first occurrence (document id, then place); the others are
   repeats, and every word under a repeat is removed.

No pairs are made.  A map task resolves what repeats inside its own batch, so a passage that a third of all rows share
reaches its bucket once per batch.

Defined results: null or empty text has no words; an empty table gives an empty one; a very long text is one text as any
other, held whole by one task; rows that repeat a document id and its text count as one occurrence
and get the same result; rows that repeat an id with another text are separate texts that tie on the id, where the
smaller place comes first; a null id sorts last and stays null.  Other columns
are carried along; ``kept_text``, ``n_words`` and ``n_removed`` replace columns of those names.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import common as C

# A perfect difference set modulo 13.
PERIOD, COVER = 13, (0, 1, 3, 9)
FLUSH = 1 << 19
# Buckets that a task takes one after the other.
PER_TASK = 3
WORD = re.compile(r"[^\x20\x09-\x0D]+")
# Repeated rows share a key, 128 bits of their id and text.
KEY, KEY2, PLACES = "_row_key", "_row_key2", "_places"
FOUND = "row_key long, row_key2 long, places binary"
FOUND_ARROW = pa.schema([("row_key", pa.int64()), ("row_key2", pa.int64()), ("places", pa.binary())])


def _repeats(order_by: tuple[np.ndarray, ...], h: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    """Entries in order of hash, then of ``order_by``, and the index in that order of each entry's first."""
    order = np.lexsort((*order_by[::-1], *h[::-1]))
    starts = C.runs(*(x[order] for x in h))
    return order, np.repeat(starts, np.diff(np.append(starts, len(order))))


def _late(h0: np.ndarray, h1: np.ndarray, no_id: np.ndarray, ids: np.ndarray, place: np.ndarray) -> np.ndarray:
    """Which windows start later than the first of the same hash; a null id is the last of all."""
    order, first = _repeats((no_id, ids, place), [h0, h1])
    start = order[first]
    late = np.zeros(len(h0), bool)
    late[order] = (no_id[order] != no_id[start]) | (ids[order] != ids[start]) | (place[order] != place[start])
    return late


def _resolve(_: int, table: bytes, answers: list[bytes]) -> Iterator[pa.RecordBatch]:
    """A flush's places, per text: those it knew of and those that the answers add."""
    parts = [C.unbundle(a) for a in [table, *answers]]
    keys = np.frombuffer(parts[0].pop(0), np.int64).reshape(2, -1)
    doc, place = (np.concatenate([C.unsmall(p[i]) for p in parts]) for i in (0, 1))
    order = np.lexsort((place, doc))
    doc, place = doc[order], place[order]
    starts = C.runs(doc)
    ends = np.append(starts, len(doc))[1:]
    for at in range(0, len(starts), 5_000):
        bounds = zip(starts[at : at + 5_000], ends[at : at + 5_000], strict=True)
        yield C.arrow_batch(FOUND_ARROW, [(*keys[:, doc[s]].tolist(), place[s:e].tobytes()) for s, e in bounds])


def _keys(batch: pa.RecordBatch) -> np.ndarray:
    names = batch.schema.names
    return np.stack([batch.column(names.index(k)).to_numpy() for k in (KEY, KEY2)])


def repeated_anchors(docs: DataFrame, window: int = 20, period: int = PERIOD, cover: tuple[int, ...] = COVER) -> DataFrame:
    """Per text (``_row_key``) the places of anchors that occur more than once."""
    tasks = C.shuffle_partitions(docs.sparkSession)
    size, n = window - period + 1, PER_TASK * tasks
    if size < 1 or {(a - b) % period for a in cover for b in cover} != set(range(period)):
        raise ValueError("the cover must reach every difference, and the window must be as long as the period")
    enough = C.flush_size(FLUSH, n)
    on_cover = np.zeros(period, bool)
    on_cover[list(cover)] = True

    def flush(name: int, held: list[tuple[np.ndarray, ...]]) -> pa.RecordBatch:
        keys = np.concatenate([x[0] for x in held], 1)
        base = np.cumsum([0, *(x[0].shape[1] for x in held[:-1])])
        h, place = (np.concatenate([x[i] for x in held]) for i in (1, 3))
        doc = np.concatenate([x[2] + b for x, b in zip(held, base, strict=True)])
        # What repeats here is known to repeat: its first occurrence asks and is enough.
        order, first = _repeats((), [h])
        twice = np.zeros(len(h), bool)
        twice[order] = np.bincount(first, minlength=len(h))[first] > 1
        lead = np.zeros(len(h), bool)
        lead[order] = first == np.arange(len(h))
        rows = [(-1, name, C.bundle(keys, C.small(doc[twice]), C.small(place[twice])))]
        lead = np.flatnonzero(lead)
        for bucket, at in C.by_bucket(C.bucket_of(h[lead], n)):
            at = lead[at]
            rows.append((bucket, name, C.bundle(h[at], C.small(doc[at]), C.small(place[at]))))
        return C.arrow_batch(C.ASK_ARROW, rows)

    def anchors(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple[np.ndarray, ...]] = []
        count = sequence = 0
        for batch in batches:
            key = _keys(batch)
            for lo, hi, words in C.word_slices(batch.column(batch.schema.names.index("text")), lower=False):
                h, at = words.grams(size)
                keep = on_cover[words.place[at] % period]
                h, at = h[keep], at[keep]
                held.append((key[:, lo:hi], h, words.doc[at], words.place[at]))
                count += len(h)
                if count >= enough:
                    yield flush(C.flush_name(sequence), held)
                    held, count, sequence = [], 0, sequence + 1
        if count:
            yield flush(C.flush_name(sequence), held)

    def answer(bucket: int, rows: list[tuple[int, bytes]]) -> Iterator[tuple[int, bytes]]:
        parts = [C.unbundle(body) for _, body in rows]
        h = np.concatenate([np.frombuffer(p[0], np.uint64) for p in parts])
        order, first = _repeats((), [h])
        found = np.zeros(len(h), bool)
        found[order] = np.bincount(first, minlength=len(h))[first] > 1
        at = 0
        for (name, _), p in zip(rows, parts, strict=True):
            doc, place = C.unsmall(p[1]), C.unsmall(p[2])
            keep = found[at : at + len(doc)]
            at += len(doc)
            if keep.any():
                yield name, C.bundle(C.small(doc[keep]), C.small(place[keep]))

    asks = docs.select(KEY, KEY2, "text").mapInArrow(anchors, C.ASK)
    return C.ask_all(asks, answer, _resolve, FOUND, tasks)


def repeated_windows(marked: DataFrame, window: int = 20, period: int = PERIOD) -> DataFrame:
    """Per text the places of windows whose words also start earlier.

    ``marked``: the row key, doc_id, text and ``_places``, the repeated anchors.  Rows are sorted by key first, as a join
    may deliver them in any order.
    """
    tasks = C.shuffle_partitions(marked.sparkSession)
    n = PER_TASK * tasks
    enough = C.flush_size(FLUSH, n)

    def flush(name: int, held: list[tuple[np.ndarray, ...]]) -> pa.RecordBatch:
        keys = np.concatenate([x[0] for x in held], 1)
        base = np.cumsum([0, *(x[0].shape[1] for x in held[:-1])])
        ids, no_id, h0, h1, place = (np.concatenate([x[i] for x in held]) for i in (1, 2, 3, 4, 6))
        doc = np.concatenate([x[5] + b for x, b in zip(held, base, strict=True)])
        # Whatever starts later than the first of this flush is a repeat; one entry of the first asks whether it is.
        late = _late(h0, h1, no_id[doc], ids[doc], place)
        rows = [(-1, name, C.bundle(keys, C.small(doc[late]), C.small(place[late])))]
        asks = np.flatnonzero(~late)
        # Repeated rows (same id and place) ask each: only these share a start.
        for bucket, at in C.by_bucket(C.bucket_of(h0[asks], n)):
            at = asks[at]
            used, ref = np.unique(doc[at], return_inverse=True)
            known = (C.small(ids[used], np.int64), C.compress(no_id[used]), C.small(used), C.small(ref))
            rows.append((bucket, name, C.bundle(h0[at], h1[at], *known, C.small(place[at]))))
        return C.arrow_batch(C.ASK_ARROW, rows)

    def windows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple[np.ndarray, ...]] = []
        count = sequence = 0
        for batch in batches:
            names = batch.schema.names
            key, doc_id = _keys(batch), batch.column(names.index("doc_id"))
            ids, no_id = C.ids(doc_id), C.null_mask(doc_id)
            marks = batch.column(names.index(PLACES)).to_pylist()
            for lo, hi, words in C.word_slices(batch.column(names.index("text")), lower=False, lanes=2):
                edge = np.zeros(len(words.starts) + 1, np.int64)
                for i in range(lo, hi):
                    start, last = words.first[i - lo], max(words.count[i - lo] - 1, 0)
                    p = np.frombuffer(marks[i], np.int32)
                    np.add.at(edge, start + np.maximum(p - period + 1, 0), 1)
                    np.add.at(edge, start + np.minimum(p, last) + 1, -1)
                wanted = np.cumsum(edge[:-1]) > 0
                h0, at = words.grams(window, 0)
                h1, _ = words.grams(window, 1)
                keep = wanted[at]
                h0, h1, at = h0[keep], h1[keep], at[keep]
                # 96 bits tell windows apart.
                held.append((key[:, lo:hi], ids[lo:hi], no_id[lo:hi], h0, h1.astype(np.uint32), words.doc[at], words.place[at]))
                count += len(at)
                if count >= enough:
                    yield flush(C.flush_name(sequence), held)
                    held, count, sequence = [], 0, sequence + 1
        if count:
            yield flush(C.flush_name(sequence), held)

    def answer(bucket: int, rows: list[tuple[int, bytes]]) -> Iterator[tuple[int, bytes]]:
        h0s, h1s, ids, nulls, docs, places = [], [], [], [], [], []
        for _, body in rows:
            h0, h1, known, no_id, used, ref, place = C.unbundle(body)
            ref = C.unsmall(ref)
            h0s.append(np.frombuffer(h0, np.uint64))
            h1s.append(np.frombuffer(h1, np.uint32))
            ids.append(C.unsmall(known, np.int64)[ref])
            nulls.append(C.expand(no_id, bool)[ref])
            docs.append(C.unsmall(used)[ref])
            places.append(C.unsmall(place))
        late = _late(*(np.concatenate(x) for x in (h0s, h1s, nulls, ids, places)))
        at = 0
        for (name, _), doc, p in zip(rows, docs, places, strict=True):
            keep = late[at : at + len(doc)]
            at += len(doc)
            if keep.any():
                yield name, C.bundle(C.small(doc[keep]), C.small(p[keep]))

    asks = marked.select(KEY, KEY2, "doc_id", "text", PLACES).sortWithinPartitions(KEY, KEY2).mapInArrow(windows, C.ASK)
    return C.ask_all(asks, answer, _resolve, FOUND, tasks)


def _keyed(found: DataFrame) -> DataFrame:
    """One row per key: repeated rows can stand in several flushes."""
    return found.groupBy(F.col("row_key").alias(KEY), F.col("row_key2").alias(KEY2)).agg(F.max("places").alias(PLACES))


def substring_dedup(docs: DataFrame, window: int = 20) -> DataFrame:
    """The rows of ``docs`` with ``kept_text`` (null for a text that loses nothing), ``n_words`` and ``n_removed``.

    Kept words are joined by one space wherever a text loses words.
    """
    spark = docs.sparkSession
    C.limit_batches(spark)
    docs = docs.drop("kept_text", "n_words", "n_removed", KEY, KEY2, PLACES)
    row = [F.col("doc_id").cast("string"), F.col("text")]
    keyed = docs.withColumn(KEY, F.xxhash64(*row)).withColumn(KEY2, F.xxhash64(F.lit(1), *row))
    anchors = _keyed(repeated_anchors(keyed, window))
    # Both joins need all texts by key; with the same columns in the same plan Spark deals them out once.
    late = _keyed(repeated_windows(keyed.join(anchors, [KEY, KEY2]), window))
    joined = keyed.join(late, [KEY, KEY2], "left").drop(KEY, KEY2)

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            names = batch.schema.names
            marks = batch.column(names.index(PLACES))
            texts = batch.column(names.index("text"))
            n_words, n_removed, kept = [], [], []
            for lo, hi, words in C.word_slices(texts, lower=False):
                for i in range(lo, hi):
                    count = int(words.count[i - lo])
                    n_words.append(count)
                    data = marks[i].as_py()
                    if not data:
                        n_removed.append(0)
                        kept.append(None)
                        continue
                    p = np.frombuffer(data, np.int32)
                    edge = np.zeros(count + window + 1, np.int64)
                    np.add.at(edge, p, 1)
                    np.add.at(edge, p + window, -1)
                    gone = np.cumsum(edge)[:count] > 0
                    n_removed.append(int(gone.sum()))
                    kept.append(" ".join(w for w, g in zip(WORD.findall(texts[i].as_py()), gone, strict=True) if not g))
            columns = [batch.column(i) for i, name in enumerate(names) if name != PLACES]
            fields = [batch.schema.field(i) for i, name in enumerate(names) if name != PLACES]
            fields += [pa.field("kept_text", pa.string()), pa.field("n_words", pa.int64()), pa.field("n_removed", pa.int64())]
            yield pa.RecordBatch.from_arrays([*columns, pa.array(kept, pa.string()), pa.array(n_words, pa.int64()), pa.array(n_removed, pa.int64())], schema=pa.schema(fields))

    return joined.mapInArrow(cut, C.schema_with(docs, kept_text="string", n_words="long", n_removed="long"))


def op3_substring_dedup(spark, sf_dir: str) -> DataFrame:
    docs = C.documents(spark, sf_dir).select("doc_id", "text")
    out = substring_dedup(docs, 20)
    whole = F.array_join(F.filter(F.split("text", C.WORD_SPLIT), lambda w: w != ""), " ")
    kept = F.coalesce("kept_text", whole, F.lit(""))
    return out.select("doc_id", "n_words", "n_removed", F.sha2(kept, 256).alias("kept_sha256"))
