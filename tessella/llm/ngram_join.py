"""Exact Jaccard self-join over word n-gram sets: rare-first prefix filtering, verified once per pair.

1. A bucket exchange over all n-gram hashes finds those that more than one text of this table holds, with their counts.
   An n-gram of one text only matches nothing, but it counts towards that text's size and comes first in the rare-first
   order, so a text with more such n-grams than its prefix is long has no partner and leaves here.
2. The others, one per distinct set, index the rest of their prefix.  A pair must share a prefix n-gram, have sizes within
   the threshold, its positions in the rare-first order must leave room for the overlap that the threshold needs, and so
   must the parts of both sets on either side of a pivot hash (suffix filter).  All of this is decided before sets are read.
3. A first round takes each prefix n-gram's smallest member with the others; components of the links among these are found.
   A second round takes the pairs that are still in different components and were not in the first.  So a group of thousands
   of near copies costs a row per copy and shared n-gram, while no link that joins two components is missed.
4. Verification intersects the sets, once per pair.

Hot n-grams: a flush of sets sends one entry for an n-gram, however many of its sets share it (the smallest member in the
first round, the range of components in the second), and is told what to compare with.  Only n-grams with members
in different components bring their members together; their pairs are dealt out in blocks.  A set with many partners is
joined by salted keys, so its pairs are spread over all tasks.

Counts above ``COMMON`` tie, and the hash orders them; a flush that sees that many texts with one n-gram sends its count
without the texts, so a passage in a third of all rows stays a few entries per flush.

Defined results: null, empty or blank text has no n-grams and no links; fewer words than ``size`` make one n-gram of the
whole sequence; equal sets always link; very long texts are one set as others are, held whole by one task; rows that repeat
an id are one document with the links of each; an empty table gives an empty one; a null id is never a component id unless
a group has no other.  Other columns, of whatever name, are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import common as C
from .components import components

COMMON = 64
# Sets without any id are named by their digest, from here on.  Ids may be as large: see ``_component_ids``.
UNNAMED = 1 << 62
FLUSH = 700_000
# Buckets that a task takes one after the other.
PER_TASK = 3
_U = np.uint64


def prefix_length(n, percent: int):
    """How many n-grams in order any partner at the threshold must meet: n - ceil(n * percent / 100) + 1."""
    return n - (n * percent + 99) // 100 + 1


def _sets(words: C.Words, size: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Distinct (text, n-gram) entries in text order, then per text its number of n-grams and a two-lane digest."""
    h, at = words.grams(size)
    doc = words.doc[at]
    short = np.flatnonzero((words.count > 0) & (words.count < size))
    if len(short):
        extra = []
        for i in short:
            total = _U(0)
            with np.errstate(over="ignore"):
                for x in words.hash[0][words.first[i] : words.first[i + 1]]:
                    total = total * _U(C._BASE) + x
                extra.append(C.mix(np.array([total + _U(words.count[i])], _U))[0])
        h, doc = np.concatenate([h, np.array(extra, _U)]), np.concatenate([doc, short])
    order = np.lexsort((h, doc))
    h, doc = h[order], doc[order]
    keep = C.runs(h, doc)
    h, doc = h[keep], doc[keep]
    n = np.bincount(doc, minlength=words.n_docs)
    digests = []
    for salt in (0x1B873593CC9E2D51, 0x38B34AE5A1E38B93):
        total = np.zeros(len(h) + 1, _U)
        np.cumsum(C.mix(h ^ _U(salt)), out=total[1:])
        ends = np.searchsorted(doc, np.arange(words.n_docs + 1))
        digests.append((total[ends[1:]] - total[ends[:-1]]).view(np.int64))
    return h, doc, n, *digests


SETS = "digest long, digest2 long, n int, ids array<long>, hashes binary"
SETS_ARROW = pa.schema([("digest", pa.int64()), ("digest2", pa.int64()), ("n", pa.int32()), ("ids", pa.list_(pa.int64())), ("hashes", pa.binary())])


def ngram_sets(docs: DataFrame, size: int, percent: int) -> DataFrame:
    """A row per distinct set of a flush: 128 bits that equal sets share, the set's size, the ids of its rows there, and,
    where it can have a partner, the n-grams that other texts hold too, the rarest first.

    Within this operator a hash is its bucket and 48 bits.
    """
    tasks = C.shuffle_partitions(docs.sparkSession)
    buckets = PER_TASK * tasks
    enough = C.flush_size(FLUSH, buckets)

    def flush(name: int, held: list[tuple]) -> pa.RecordBatch:
        ids = pa.concat_arrays([x[5] for x in held])
        base = np.cumsum([0, *(len(x[2]) for x in held[:-1])])
        h = np.concatenate([x[0] for x in held])
        doc = np.concatenate([x[1] + b for x, b in zip(held, base, strict=True)])
        n, d, d2 = (np.concatenate([x[i] for x in held]) for i in (2, 3, 4))
        # Equal sets within the flush ask once.
        order = np.lexsort((d2, d))
        one = np.zeros(len(n), bool)
        one[order[C.runs(d[order], d2[order])]] = True
        keep = one[doc]
        h, doc = h[keep], doc[keep]
        order = np.argsort(h, kind="stable")
        seen = np.diff(np.append(C.runs(h[order]), len(order)))
        count = np.empty(len(h), np.int64)
        count[order] = np.repeat(seen, seen)
        common = count >= COMMON
        rows, sure, sure_doc = [], [np.zeros(0, _U)], [np.zeros(0, np.int64)]
        for bucket, at in C.by_bucket(C.bucket_of(h, buckets)):
            few, many = at[~common[at]], at[common[at]]
            # A common n-gram's count goes once; for its texts here the answer is known.
            alone, alone_n = np.unique(h[many], return_counts=True)
            rows.append((bucket, name, C.bundle(C.low48(h[few]), C.small(doc[few]), C.low48(alone), alone_n.astype(np.int32))))
            sure.append((h[many] & _U((1 << 48) - 1)) | _U(bucket << 48))
            sure_doc.append(doc[many])
        own = (np.stack([d, d2, n]).astype(np.int64), C.id_bytes(ids), np.concatenate(sure), C.compress(np.concatenate(sure_doc).astype(np.int32)))
        rows.append((-1, name, C.bundle(*own)))
        return C.arrow_batch(C.ASK_ARROW, rows)

    def ask(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple] = []
        count = sequence = 0
        for batch in batches:
            for lo, hi, words in C.word_slices(batch.column(1), lower=True):
                held.append((*_sets(words, size), batch.column(0).slice(lo, hi - lo)))
                count += len(held[-1][0]) + hi - lo
                if count >= enough:
                    yield flush(C.flush_name(sequence), held)
                    held, count, sequence = [], 0, sequence + 1
        if held:
            yield flush(C.flush_name(sequence), held)

    def answer(bucket: int, rows: list[tuple[int, bytes]]) -> Iterator[tuple[int, bytes]]:
        parts = [C.unbundle(body) for _, body in rows]
        asked = [C.from48(p[0], bucket) for p in parts]
        h, many = np.concatenate(asked), np.concatenate([C.from48(p[2], bucket) for p in parts])
        many_n = np.concatenate([np.frombuffer(p[3], np.int32) for p in parts])
        unique, inverse = np.unique(np.concatenate([h, many]), return_inverse=True)
        total = np.minimum(np.bincount(inverse, np.concatenate([np.ones(len(h)), many_n]), len(unique)), COMMON)
        count = total[inverse[: len(h)]].astype(np.uint8)
        at = 0
        for (name, _), p, mine in zip(rows, parts, asked, strict=True):
            n = count[at : at + len(mine)]
            at += len(mine)
            keep = n > 1
            if keep.any():
                yield name, C.bundle(C.low48(mine[keep]), C.small(C.unsmall(p[1])[keep]), C.compress(n[keep]), np.array([bucket], np.int64))

    def resolve(_: int, table: bytes, answers: list[bytes]) -> Iterator[pa.RecordBatch]:
        texts, ids, sure, sure_doc = C.unbundle(table)
        d, d2, size_n = np.frombuffer(texts, np.int64).reshape(3, -1)
        ids = C.id_array(ids)
        hs, docs_, ns = [np.frombuffer(sure, _U)], [C.expand(sure_doc, np.int32)], []
        ns.append(np.full(len(hs[0]), COMMON, np.uint8))
        for body in answers:
            h, doc, n, bucket = C.unbundle(body)
            hs.append(C.from48(h, int(np.frombuffer(bucket, np.int64)[0])))
            docs_.append(C.unsmall(doc))
            ns.append(C.expand(n, np.uint8))
        h, doc, n = (np.concatenate(x) for x in (hs, docs_, ns))
        order = np.lexsort((h, n, doc))
        h, doc = h[order], doc[order]
        shared = np.searchsorted(doc, np.arange(len(d) + 1))
        possible = size_n - np.diff(shared) < prefix_length(size_n, percent)
        # The first row of each distinct set asked for it.
        order = np.lexsort((d2, d))
        starts = C.runs(d[order], d2[order])
        ends = np.append(starts, len(order))[1:]
        for at in range(0, len(starts), 1_000):
            first = order[starts[at : at + 1_000]]
            lists = [h[shared[i] : shared[i + 1]].tobytes() if size_n[i] and possible[i] else None for i in first]
            lo, hi = starts[at], ends[min(at + 1_000, len(ends)) - 1]
            offsets = pa.array(np.append(starts[at : at + 1_000], hi).astype(np.int32) - np.int32(lo))
            grouped = pa.ListArray.from_arrays(offsets, ids.take(pa.array(order[lo:hi])))
            yield pa.RecordBatch.from_arrays([pa.array(d[first]), pa.array(d2[first]), pa.array(size_n[first].astype(np.int32)), grouped, pa.array(lists, pa.binary())], schema=SETS_ARROW)

    asks = docs.select("doc_id", "text").mapInArrow(ask, C.ASK)
    return C.ask_all(asks, answer, resolve, SETS, tasks)


PAIRS = pa.schema([("a", pa.int64()), ("b", pa.int64())])
PAIRS_DDL = "a long, b long"
# Members of an n-gram that are compared in one block, and pairs that are held at a time.
BLOCK = 4096
PAIR_BLOCK = 1 << 20
# What an index entry says of its set: name, component, size, place of the n-gram, shared n-grams, and those below the pivot.
NODE, PART, SIZE, PLACE, SHARED, LOW = range(6)


def _low(h: np.ndarray) -> int:
    return int(((h & _U((1 << 48) - 1)) < _U(1 << 47)).sum())


def _possible(a: np.ndarray, b: np.ndarray, percent: int) -> np.ndarray:
    """Length, positional and suffix filters, for pairs of entries (columns) whose sets meet at these places of the order."""
    need = -((-percent * (a[SIZE] + b[SIZE])) // (100 + percent))
    length = np.minimum(a[SIZE], b[SIZE]) * 100 >= percent * np.maximum(a[SIZE], b[SIZE])
    position = np.minimum(a[SIZE] - a[PLACE], b[SIZE] - b[PLACE]) >= need
    halves = np.minimum(a[LOW], b[LOW]) + np.minimum(a[SHARED] - a[LOW], b[SHARED] - b[LOW])
    return (a[NODE] != b[NODE]) & length & position & (halves >= need)


def _pairs(a: np.ndarray, b: np.ndarray) -> Iterator[pa.RecordBatch]:
    """Distinct pairs of names, the smaller first."""
    if len(a):
        pairs = np.unique(np.stack([np.minimum(a, b), np.maximum(a, b)], 1), axis=0)
        yield pa.RecordBatch.from_arrays([pa.array(pairs[:, 0]), pa.array(pairs[:, 1])], schema=PAIRS)


def _entries(batches: Iterator[pa.RecordBatch], percent: int, enough: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Flushes of prefix entries of sets (node, part, n, hashes): their hashes, and what they say of their sets."""
    hs: list[np.ndarray] = []
    tells: list[np.ndarray] = []
    count = 0
    for batch in batches:
        for node, part, n, hashes in zip(*(c.to_pylist() for c in batch.columns), strict=True):
            h = np.frombuffer(hashes, _U)
            single = n - len(h)
            prefix = h[: prefix_length(n, percent) - single]
            told = np.empty((6, len(prefix)), np.int64)
            told[:] = np.array([node, part, n, 0, len(h), _low(h)])[:, None]
            told[PLACE] = np.arange(single, single + len(prefix))
            hs.append(prefix)
            tells.append(told)
            count += len(prefix)
            if count >= enough:
                yield np.concatenate(hs), np.concatenate(tells, 1)
                hs, tells, count = [], [], 0
    if count:
        yield np.concatenate(hs), np.concatenate(tells, 1)


def _pack(told: np.ndarray) -> bytes:
    return C.bundle(*(C.compress(row) for row in told))


def _unpack(body) -> np.ndarray:
    return np.stack([C.expand(row, np.int64) for row in C.unbundle(body)])


def star_candidates(sets: DataFrame, percent: int) -> DataFrame:
    """Pairs (a < b) of ``sets`` (node, part, n, hashes): the smallest member of each prefix n-gram with the others.

    A flush asks with its own smallest member of each n-gram; the bucket answers with the smallest of all.
    """
    tasks = C.shuffle_partitions(sets.sparkSession)
    buckets = PER_TASK * tasks
    enough = C.flush_size(FLUSH // 2, buckets)

    def ask(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for sequence, (h, told) in enumerate(_entries(batches, percent, enough)):
            order = np.lexsort((told[NODE], h))
            h, told = h[order], told[:, order]
            starts = C.runs(h)
            name = C.flush_name(sequence)
            rows = [(-1, name, C.bundle(h, _pack(told)))]
            for bucket, at in C.by_bucket(C.bucket_of(C.mix(h[starts]), buckets)):
                rows.append((bucket, name, C.bundle(h[starts[at]], C.small(starts[at]), _pack(told[:, starts[at]]))))
            yield C.arrow_batch(C.ASK_ARROW, rows)

    def answer(_: int, rows: list[tuple[int, bytes]]) -> Iterator[tuple[int, bytes]]:
        parts = [C.unbundle(body) for _, body in rows]
        h = np.concatenate([np.frombuffer(p[0], _U) for p in parts])
        told = np.concatenate([_unpack(p[2]) for p in parts], 1)
        order = np.lexsort((told[NODE], h))
        starts = C.runs(h[order])
        centre = np.empty(len(h), np.int64)
        centre[order] = np.repeat(order[starts], np.diff(np.append(starts, len(h))))
        at = 0
        for (name, _), p in zip(rows, parts, strict=True):
            n = len(p[0]) // 8
            yield name, C.bundle(bytes(p[1]), _pack(told[:, centre[at : at + n]]))
            at += n

    def resolve(_: int, table: bytes, answers: list[bytes]) -> Iterator[pa.RecordBatch]:
        h, told = C.unbundle(table)
        h, told = np.frombuffer(h, _U), _unpack(told)
        centres = np.empty_like(told)
        ends = np.append(C.runs(h), len(h))
        length = np.zeros(len(h), np.int64)
        length[ends[:-1]] = np.diff(ends)
        for body in answers:
            starts, found = C.unbundle(body)
            starts, found = C.unsmall(starts).astype(np.int64), _unpack(found)
            where = np.repeat(starts, length[starts]) + _ramp(length[starts])
            centres[:, where] = np.repeat(found, length[starts], 1)
        keep = _possible(centres, told, percent)
        yield from _pairs(centres[NODE][keep], told[NODE][keep])

    asks = sets.select("node", "part", "n", "hashes").mapInArrow(ask, C.ASK)
    return C.ask_all(asks, answer, resolve, PAIRS_DDL, tasks)


def _ramp(lengths: np.ndarray) -> np.ndarray:
    """0, 1, ... for each length."""
    return np.arange(lengths.sum()) - np.repeat(np.cumsum(lengths) - lengths, lengths)


ENTRY = "bucket int, hash binary, told binary"
ENTRY_ARROW = pa.schema([("bucket", pa.int32()), ("hash", pa.binary()), ("told", pa.binary())])
JOB = "job long, left binary, right binary"
JOB_ARROW = pa.schema([("job", pa.int64()), ("left", pa.binary()), ("right", pa.binary())])


def cross_candidates(sets: DataFrame, percent: int) -> DataFrame:
    """Distinct pairs (a < b) of ``sets`` (node, part, n, hashes) of different ``part`` that share a prefix n-gram.

    A flush first asks whether an n-gram has members of different parts at all, with one entry for each n-gram.
    """
    tasks = C.shuffle_partitions(sets.sparkSession)
    buckets = PER_TASK * tasks
    enough = C.flush_size(FLUSH // 2, buckets)

    def ask(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for sequence, (h, told) in enumerate(_entries(batches, percent, enough)):
            order = np.argsort(h, kind="stable")
            h, told = h[order], told[:, order]
            starts = C.runs(h)
            least, most = np.minimum.reduceat(told[PART], starts), np.maximum.reduceat(told[PART], starts)
            name = C.flush_name(sequence)
            rows = [(-1, name, C.bundle(h, _pack(told)))]
            for bucket, at in C.by_bucket(C.bucket_of(C.mix(h[starts]), buckets)):
                rows.append((bucket, name, C.bundle(h[starts[at]], C.small(starts[at]), C.compress(least[at]), C.compress(most[at]))))
            yield C.arrow_batch(C.ASK_ARROW, rows)

    def answer(_: int, rows: list[tuple[int, bytes]]) -> Iterator[tuple[int, bytes]]:
        parts = [C.unbundle(body) for _, body in rows]
        h = np.concatenate([np.frombuffer(p[0], _U) for p in parts])
        least, most = (np.concatenate([C.expand(p[i], np.int64) for p in parts]) for i in (2, 3))
        order = np.argsort(h, kind="stable")
        starts = C.runs(h[order])
        mixed = np.minimum.reduceat(least[order], starts) < np.maximum.reduceat(most[order], starts)
        apart = np.empty(len(h), bool)
        apart[order] = np.repeat(mixed, np.diff(np.append(starts, len(h))))
        at = 0
        for (name, _), p in zip(rows, parts, strict=True):
            n = len(p[0]) // 8
            found = C.unsmall(p[1])[apart[at : at + n]]
            at += n
            if len(found):
                yield name, C.bundle(C.small(found))

    def resolve(_: int, table: bytes, answers: list[bytes]) -> Iterator[pa.RecordBatch]:
        h, told = C.unbundle(table)
        h, told = np.frombuffer(h, _U), _unpack(told)
        if not answers:
            return
        starts = np.concatenate([C.unsmall(C.unbundle(a)[0]) for a in answers]).astype(np.int64)
        ends = np.append(C.runs(h), len(h))
        length = np.zeros(len(h), np.int64)
        length[ends[:-1]] = np.diff(ends)
        at = np.repeat(starts, length[starts]) + _ramp(length[starts])
        h, told = h[at], told[:, at]
        rows = [(bucket, h[i].tobytes(), _pack(told[:, i])) for bucket, i in C.by_bucket(C.bucket_of(C.mix(h), buckets))]
        yield C.arrow_batch(ENTRY_ARROW, rows)

    def deal(bucket: int, rows: pa.Table) -> Iterator[pa.RecordBatch]:
        """Blocks of members that must be compared: in order of size, and only blocks whose sizes can be alike."""
        h = np.concatenate([np.frombuffer(x, _U) for x in rows["hash"].to_pylist()])
        told = np.concatenate([_unpack(x) for x in rows["told"].to_pylist()], 1)
        order = np.lexsort((told[NODE], told[SIZE], h))
        h, told = h[order], told[:, order]
        bounds = np.append(C.runs(h), len(h))
        job, held, size = bucket << 32, [], 0
        for s, e in zip(bounds[:-1], bounds[1:], strict=True):
            if (told[PART, s:e] == told[PART, s]).all():
                continue
            if e - s <= BLOCK:
                held.append(told[:, s:e])
                size += int(e - s) ** 2
                if size >= BLOCK**2:
                    yield C.arrow_batch(JOB_ARROW, [(job, _groups(held), b"")])
                    job, held, size = job + 1, [], 0
                continue
            for i in range(s, e, BLOCK):
                left = told[:, i : min(i + BLOCK, e)]
                yield C.arrow_batch(JOB_ARROW, [(job, _groups([left]), b"")])
                job += 1
                for j in range(i + BLOCK, e, BLOCK):
                    right = told[:, j : min(j + BLOCK, e)]
                    if right[SIZE][0] * percent > left[SIZE][-1] * 100:
                        break
                    yield C.arrow_batch(JOB_ARROW, [(job, _pack(left), _pack(right))])
                    job += 1
        if held:
            yield C.arrow_batch(JOB_ARROW, [(job, _groups(held), b"")])

    def compare(left: np.ndarray, right: np.ndarray, same: bool) -> Iterator[pa.RecordBatch]:
        step = max(1, PAIR_BLOCK // max(1, right.shape[1]))
        for at in range(0, left.shape[1], step):
            i, j = (x.ravel() for x in np.indices((min(step, left.shape[1] - at), right.shape[1])))
            i += at
            if same:
                i, j = i[i < j], j[i < j]
            keep = (left[PART][i] != right[PART][j]) & _possible(left[:, i], right[:, j], percent)
            yield from _pairs(left[NODE][i[keep]], right[NODE][j[keep]])

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for left, right in zip(batch.column(1).to_pylist(), batch.column(2).to_pylist(), strict=True):
                if right:
                    yield from compare(_unpack(left), _unpack(right), False)
                    continue
                every, ends = C.unbundle(left)
                every = _unpack(every)
                for s, e in zip(*_bounds(np.frombuffer(ends, np.int64)), strict=True):
                    yield from compare(every[:, s:e], every[:, s:e], True)

    asks = sets.select("node", "part", "n", "hashes").mapInArrow(ask, C.ASK)
    entries = C.ask_all(asks, answer, resolve, ENTRY, tasks)
    jobs = C.map_buckets(entries, "bucket", deal, JOB, tasks)
    return jobs.repartition(tasks, "job").select("job", "left", "right").mapInArrow(work, PAIRS_DDL).distinct()


def _groups(held: list[np.ndarray]) -> bytes:
    return C.bundle(_pack(np.concatenate(held, 1)), np.cumsum([x.shape[1] for x in held]))


def _bounds(ends: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    return np.concatenate([[0], ends[:-1]]), ends


CHECKED = "a long, b long, linked boolean"
CHECKED_ARROW = pa.schema([("a", pa.int64()), ("b", pa.int64()), ("linked", pa.bool_())])


def verified(pairs: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """``pairs`` with whether their Jaccard similarity reaches the threshold.

    A node of many pairs is spread over tasks by a salt from the other node, and its set goes where there are pairs for it.
    """
    salts = F.lit(C.shuffle_partitions(pairs.sparkSession))

    def with_set(rows: DataFrame, side: str, other: str) -> DataFrame:
        salted = rows.withColumn("salt", F.pmod(F.xxhash64(other), salts))
        own = sets.select(F.col("node").alias(side), F.col("n").alias(f"n{side}"), F.col("hashes").alias(f"h{side}"))
        wanted = salted.select(side, "salt").distinct().join(own, side)
        return salted.join(wanted, [side, "salt"]).drop("salt")

    joined = with_set(with_set(pairs, "a", "b"), "b", "a").select("a", "b", "na", "nb", "ha", "hb")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = []
            for a, b, na, nb, ha, hb in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                shared = len(np.intersect1d(np.frombuffer(ha, _U), np.frombuffer(hb, _U), assume_unique=True))
                rows.append((a, b, shared * 100 >= percent * (na + nb - shared)))
            yield C.arrow_batch(CHECKED_ARROW, rows)

    return joined.mapInArrow(run, CHECKED)


def _component_ids(names: DataFrame, parts: DataFrame) -> DataFrame:
    """(digest, digest2, component_id): the smallest id of a set's component.

    A component's name is its least node.  Names below UNNAMED are ids.  Of others, which hold sets without ids or ids as
    large, the least id is looked up.
    """
    named = names.join(parts, "node", "left").withColumn("component", F.coalesce("component", "node"))
    high = named.where(F.col("component") >= UNNAMED).groupBy("component").agg(F.min("first_id").alias("least"))
    low = named.where(F.col("component") < UNNAMED).select("digest", "digest2", F.col("component").alias("component_id"))
    return low.unionByName(named.join(high, "component").select("digest", "digest2", F.col("least").alias("component_id")))


def ngram_join(docs: DataFrame, size: int = 5, percent: int = 75) -> DataFrame:
    """(doc_id, n_shingles, component_id) for each row of ``docs`` (doc_id, text)."""
    C.limit_batches(docs.sparkSession)
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    rows = C.saved(ngram_sets(docs, size, percent), "ngram-sets")
    # One node per distinct set, named by its smallest id, or by its digest where no row has one.
    names = rows.where("n > 0").groupBy("digest", "digest2").agg(F.min(F.array_min("ids")).alias("first_id"))
    names = names.withColumn("node", F.coalesce("first_id", F.lit(UNNAMED) + F.shiftrightunsigned("digest", 2)))
    lists = rows.where("hashes IS NOT NULL").groupBy("digest", "digest2", "n").agg(F.max("hashes").alias("hashes"))
    sets = C.saved(lists.join(names, ["digest", "digest2"]).select("node", F.col("node").alias("part"), "n", "hashes"), "ngram-nodes")
    first = C.saved(verified(star_candidates(sets, percent), sets, percent), "ngram-stars")
    linked = first.where("linked").select("a", "b")
    parts = components(linked)
    apart = sets.drop("part").join(parts, "node", "left").select("node", F.coalesce("component", "node").alias("part"), "n", "hashes")
    apart = C.saved(apart, "ngram-apart")
    rest = cross_candidates(apart, percent).join(first.select("a", "b"), ["a", "b"], "left_anti")
    more = verified(rest, sets, percent).where("linked").select("a", "b")
    grown = components(parts.where("node <> component").toDF("a", "b").unionByName(more))
    found = _component_ids(names, C.saved(grown, "ngram-components"))
    out = rows.join(found, ["digest", "digest2"], "left").select("n", "component_id", F.explode("ids").alias("doc_id"))
    return out.select("doc_id", F.col("n").cast("long").alias("n_shingles"), F.when(F.col("n") > 0, F.col("component_id")).otherwise(F.col("doc_id")).alias("component_id"))


def op9_ngram_join(spark, sf_dir: str) -> DataFrame:
    return ngram_join(C.documents(spark, sf_dir), 5, 75)
