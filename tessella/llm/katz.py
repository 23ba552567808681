"""Katz backoff language model: Good-Turing discounts, exactly normalised backoff weights, counts in hash-partitioned tables.

P(w | h) = d(c(h,w)) c(h,w) / c(h)          if c(h,w) >= min_count
         = alpha(h) P(w)                     otherwise
P(w)     = d(c(w)) c(w) / N                  if c(w) > 0, else the mass that the discounts free (all unknown words: one event)
alpha(h) = (1 - sum of the first line over seen w) / (1 - sum of P(w) over the same w)

Pairs below ``min_count`` stay out of the model, as count cutoffs do; their mass is in alpha, so each history still sums
to 1.  Discounts follow Katz for counts up to ``top``.  Words above it keep their weight.  Pairs above it, and any where a table is
too small for Good-Turing (a count of counts is 0, or a discount leaves (0, 1)), lose half a count, so that a history
whose pairs are all frequent still has mass for others.  The unigram frees 1 / (N + 1) at least.

The corpus is larger than any worker.  A flush of rows (about ``FLUSH_TOKENS`` tokens) numbers its own words.
1. It asks for the counts of its distinct words and pairs, by hash bucket, with its own training counts; the buckets add
   them up, which yields the count tables, the counts of counts, N and V, and answer.  One flush that asks for a pair is told to
   own it.
2. Owners add their pairs' mass to their histories; buckets of histories add that up, give alpha, and answer.
3. Each flush walks its tokens: pair, else alpha times the unigram, else the unknown word.

Histories include the start of a text; the end is a token.  Words are told apart by 64 bits, pairs by 48 beside their bucket.

Defined results: null or empty text is the end token alone; repeated rows count, and are scored, each; a null id stays
null; with no training rows at all every token is unknown and has probability 1.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import common as C

FLUSH_TOKENS = 1_000_000
PER_TASK = 3
TOP = 5
START, END = np.uint64(0x5BD1E9955BD1E995), np.uint64(0x27D4EB2F165667C5)
_U = np.uint64
STATS = 4 + 2 * (TOP + 2)  # N, V, pairs, unused; then counts of counts 0..TOP+1 of words and of pairs
SCORE = "doc_id long, held_out boolean, n_tokens long, n_known long, base_part double, score double"
SCORE_ARROW = pa.schema([("doc_id", pa.int64()), ("held_out", pa.bool_()), ("n_tokens", pa.int64()), ("n_known", pa.int64()), ("base_part", pa.float64()), ("score", pa.float64())])
STATE = "flush long, body binary, stats binary"
STATE_ARROW = pa.schema([("flush", pa.int64()), ("body", pa.binary()), ("stats", pa.binary())])


def pair_hash(first: np.ndarray, second: np.ndarray) -> np.ndarray:
    return C.mix(first * _U(C._BASE) + C.mix(second))


def good_turing(counts_of_counts: np.ndarray, top: int = TOP) -> np.ndarray:
    """Discounts of counts 0..top + 1, the last for all above; 1 where there is none."""
    n = counts_of_counts.astype(float)
    d = np.ones(top + 2)
    if n[1] == 0:
        return d
    tail = (top + 1) * n[top + 1] / n[1]
    for r in range(1, top + 1):
        if n[r] and n[r + 1] and tail < 1:
            found = ((r + 1) * n[r + 1] / n[r] / r - tail) / (1 - tail)
            if 0 < found < 1:
                d[r] = found
    return d


@dataclass
class Model:
    """The numbers that every task needs: a fixed few, whatever the corpus."""

    total: int
    words: int
    word_discount: np.ndarray
    pair_discount: np.ndarray
    word_scale: float
    unknown: float

    @classmethod
    def of(cls, stats: np.ndarray) -> Model:
        total, words = int(stats[0]), int(stats[1])
        of_words, of_pairs = stats[4 : 4 + TOP + 2], stats[4 + TOP + 2 :]
        d = good_turing(of_words)
        r = np.arange(TOP + 2)
        freed = float((of_words * r * (1 - d))[1 : TOP + 1].sum()) / total if total else 1.0
        least = 1 / (total + 1)
        return cls(total, words, d, good_turing(of_pairs), 1.0 if freed >= least else total / (total + 1), max(freed, least) if total else 1.0)

    def unigram(self, count: np.ndarray) -> np.ndarray:
        known = self.word_scale * self.word_discount[np.minimum(count, TOP + 1)] * count / max(self.total, 1)
        return np.where(count > 0, known, self.unknown)

    def pair(self, count: np.ndarray, history: np.ndarray) -> np.ndarray:
        d = self.pair_discount[np.minimum(count, TOP + 1)]
        return np.where(d < 1, d * count, count - 0.5) / np.maximum(history, 1)


class Flush:
    """Rows numbered by their own vocabulary; 0 is the start, 1 the end."""

    def __init__(self, held: list[tuple]):
        self.doc_id = pa.concat_arrays([x[0] for x in held])
        self.train = np.concatenate([x[1] for x in held])
        self.n_words = np.concatenate([x[3] for x in held])
        words, token, count = np.unique(np.concatenate([x[2] for x in held]), return_inverse=True, return_counts=True)
        # The commonest words get the smallest numbers, which pack best.
        order = np.argsort(-count, kind="stable")
        rank = np.empty(len(order), np.int32)
        rank[order] = np.arange(len(order))
        words, token = words[order], rank[token]
        self.hash = np.concatenate([np.array([START, END], _U), words])
        # Tokens with the end after each text, and the history of each.
        ends = np.cumsum(self.n_words + 1) - 1
        self.token = np.ones(len(token) + len(ends), np.int32)
        is_word = np.ones(len(self.token), bool)
        is_word[ends] = False
        self.token[is_word] = token + 2
        self.text = np.repeat(np.arange(len(ends)), self.n_words + 1)

    def histories(self) -> np.ndarray:
        return histories(self.token, self.n_words)


def histories(token: np.ndarray, n_words: np.ndarray) -> np.ndarray:
    history = np.empty_like(token)
    history[1:] = token[:-1]
    history[np.cumsum(n_words + 1) - n_words - 1] = 0
    return history


def flushes(batches: Iterator[pa.RecordBatch], size: int) -> Iterator[tuple[int, Flush]]:
    """Batches of (doc_id, train, text, part).  ``part`` numbers the input's partition, also where a task's number differs."""
    held: list[tuple] = []
    count = sequence = part = 0
    for batch in batches:
        part = batch.column(3)[0].as_py() if batch.num_rows else part
        train = batch.column(1).to_numpy(zero_copy_only=False)
        for lo, hi, words in C.word_slices(batch.column(2), lower=True):
            held.append((batch.column(0).slice(lo, hi - lo), train[lo:hi], words.hash[0], words.count))
            count += len(words.starts) + hi - lo
            if count >= size:
                yield (part << 32) + sequence, Flush(held)
                held, count, sequence = [], 0, sequence + 1
    if held:
        yield (part << 32) + sequence, Flush(held)


def _distinct(flush: Flush) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Training counts of the flush's words; its distinct pairs' hashes and training counts; the pair of each token."""
    train = flush.train[flush.text]
    word_train = np.bincount(flush.token, train, len(flush.hash)).astype(np.int64)
    word_train[0] = flush.train.sum()
    history = flush.histories()
    codes, pair = np.unique(history.astype(np.int64) << 32 | flush.token, return_inverse=True)
    pair_train = np.bincount(pair, train, len(codes)).astype(np.int64)
    h = pair_hash(flush.hash[codes >> 32], flush.hash[codes & 0xFFFFFFFF])
    return word_train, h, pair_train, codes, pair


def count_tables(docs: DataFrame, min_count: int) -> DataFrame:
    """One row per flush with its tokens and the counts of its words and pairs, and rows of statistics."""
    tasks = C.shuffle_partitions(docs.sparkSession)
    buckets = PER_TASK * tasks

    def questions(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for name, flush in flushes(batches, FLUSH_TOKENS):
            word_train, h, pair_train, _, _ = _distinct(flush)
            of_word, of_pair = dict(C.by_bucket(C.bucket_of(flush.hash, buckets))), dict(C.by_bucket(C.bucket_of(h, buckets)))
            rows, none = [], np.zeros(0, np.int64)
            for bucket in sorted(of_word.keys() | of_pair.keys()):
                w, p = of_word.get(bucket, none), of_pair.get(bucket, none)
                rows.append((bucket, name, C.bundle(C.low48(flush.hash[w]), C.compress(word_train[w].astype(np.int32)), C.low48(h[p]), C.compress(pair_train[p].astype(np.int32)))))
            yield C.arrow_batch(C.ASK_ARROW, rows)

    def tables(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for name, flush in flushes(batches, FLUSH_TOKENS):
            yield C.arrow_batch(C.ASK_ARROW, [(-1, name, C.bundle(C.id_bytes(flush.doc_id), flush.train, C.planes(flush.n_words), C.planes(flush.token), flush.hash))])

    def answer(bucket: int, rows: list[tuple[int, bytes]]) -> Iterator[tuple[int, bytes]]:
        parts = [C.unbundle(body) for _, body in rows]
        stats = np.zeros(STATS, np.int64)
        totals, owners = [], []
        for kind in (0, 2):
            h = np.concatenate([C.from48(p[kind]) for p in parts])
            n = np.concatenate([C.expand(p[kind + 1], np.int32) for p in parts]).astype(np.int64)
            order = np.argsort(h, kind="stable")
            starts = C.runs(h[order])
            sums = np.add.reduceat(n[order], starts) if len(starts) else np.zeros(0, np.int64)
            total = np.empty(len(h), np.int64)
            total[order] = np.repeat(sums, np.diff(np.append(starts, len(h))))
            owner = np.zeros(len(h), bool)
            owner[order[starts]] = True
            totals.append(total)
            owners.append(owner)
            if kind == 0:
                sums = sums[h[order][starts] != START & _U((1 << 48) - 1)]
                stats[0], stats[1] = sums.sum(), (sums > 0).sum()
                stats[4 : 4 + TOP + 2] = np.bincount(sums[sums <= TOP + 1], minlength=TOP + 2)
            else:
                stats[2] = (sums > 0).sum()
                stats[4 + TOP + 2 :] = np.bincount(sums[sums <= TOP + 1], minlength=TOP + 2)
        w = p = 0
        for k, ((name, _), part) in enumerate(zip(rows, parts, strict=True)):
            n_words, n_pairs = len(part[0]) // 6, len(part[2]) // 6
            pairs = totals[1][p : p + n_pairs]
            in_model = pairs >= max(min_count, 1)
            # The flush that asks first owns a pair of the model: the lowest bit.
            coded = np.where(in_model, 2 * pairs + owners[1][p : p + n_pairs], 0)
            yield name, C.bundle(np.array([bucket], np.int64), C.compress(totals[0][w : w + n_words]), C.compress(coded), stats if k == 0 else b"")
            w, p = w + n_words, p + n_pairs

    def resolve(name: int, table: bytes, answers: list[bytes]) -> Iterator[pa.RecordBatch]:
        ids, train, n_words, token, h = C.unbundle(table)
        flush = Flush.__new__(Flush)
        flush.train, flush.n_words, flush.token, flush.hash = np.frombuffer(train, bool), C.from_planes(n_words), C.from_planes(token), np.frombuffer(h, _U)
        flush.text = np.repeat(np.arange(len(flush.n_words)), flush.n_words + 1)
        _, pairs, _, codes, pair = _distinct(flush)
        word_count, pair_count = np.zeros(len(flush.hash), np.int64), np.zeros(len(pairs), np.int64)
        of_word, of_pair = dict(C.by_bucket(C.bucket_of(flush.hash, buckets))), dict(C.by_bucket(C.bucket_of(pairs, buckets)))
        stats = np.zeros(STATS, np.int64)
        for body in answers:
            bucket, words, coded, more = C.unbundle(body)
            bucket = int(np.frombuffer(bucket, np.int64)[0])
            if bucket in of_word:
                word_count[of_word[bucket]] = C.expand(words, np.int64)
            if bucket in of_pair:
                pair_count[of_pair[bucket]] = C.expand(coded, np.int64)
            if len(more):
                stats += np.frombuffer(more, np.int64)
        owned = np.flatnonzero(pair_count & 1)
        of_token = (pair_count >> 1)[pair]
        # Words that can be histories of the model and are backed off from here, or own mass: they will ask for their weight.
        used = np.zeros(len(flush.hash), bool)
        used[flush.histories()[of_token == 0]] = True
        used &= word_count >= max(min_count, 1)
        used[codes[owned] >> 32] = True
        asked = np.flatnonzero(used)
        body = C.bundle(
            ids, train, C.planes(flush.n_words), C.planes(flush.token), C.compress(word_count), C.small(asked), flush.hash[asked],
            # Of each token the count of its pair; the pairs that this flush owns, with their counts.
            C.compress(of_token), C.small(codes[owned], np.int64), C.compress(pair_count[owned] >> 1),
        )
        yield C.arrow_batch(STATE_ARROW, [(name, body, stats.tobytes())])

    lean = docs.select("doc_id", "train", "text", F.spark_partition_id().alias("part"))
    return C.ask_all(lean.mapInArrow(questions, C.ASK), answer, resolve, STATE, tasks, lean.mapInArrow(tables, C.ASK))


def _model(states: DataFrame) -> Model:
    """The sums of the statistics: a fixed few numbers, added up by the executors."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(STATS, np.int64)
        for batch in batches:
            for body in batch.column(0).to_pylist():
                total += np.frombuffer(body, np.int64)
        yield pa.RecordBatch.from_arrays([pa.array(np.arange(STATS)), pa.array(total)], names=["at", "n"])

    sums = states.select("stats").mapInArrow(run, "at long, n long").groupBy("at").agg(F.sum("n").alias("n")).collect()
    stats = np.zeros(STATS, np.int64)
    for at, n in sums:
        stats[at] = n
    return Model.of(stats)


class State:
    """A flush with its counts."""

    def __init__(self, body: bytes):
        ids, train, n_words, token, words, asked, h, pairs, codes, owned = C.unbundle(body)
        self.ids, self.train = bytes(ids), np.frombuffer(train, bool)
        self.n_words, self.token = C.from_planes(n_words), C.from_planes(token)
        self.asked, self.hash = C.unsmall(asked), np.frombuffer(h, _U)
        self.word_count, self.pair_count = C.expand(words, np.int64), C.expand(pairs, np.int64)
        self.owned, self.owned_count = C.unsmall(codes, np.int64), C.expand(owned, np.int64)
        self.history = histories(self.token, self.n_words)
        self.ends = np.cumsum(self.n_words + 1)

    def per_text(self, values: np.ndarray) -> np.ndarray:
        return np.add.reduceat(values, self.ends - self.n_words - 1) if len(self.ends) else np.zeros(0)


def score_texts(states: DataFrame, model: Model) -> DataFrame:
    tasks = C.shuffle_partitions(states.sparkSession)
    buckets = PER_TASK * tasks

    def questions(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for name, body in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                state = State(body)
                first, word = state.owned >> 32, state.owned & 0xFFFFFFFF
                seen = np.bincount(first, model.pair(state.owned_count, state.word_count[first]), len(state.word_count))[state.asked]
                below = np.bincount(first, model.unigram(state.word_count[word]), len(state.word_count))[state.asked]
                rows = []
                for bucket, at in C.by_bucket(C.bucket_of(state.hash, buckets)):
                    has = np.flatnonzero(below[at] > 0)
                    rows.append((bucket, name, C.bundle(state.hash[at], C.small(has), seen[at[has]], below[at[has]])))
                yield C.arrow_batch(C.ASK_ARROW, rows)

    def tables(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for name, body in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                state = State(body)
                seen, off = state.pair_count > 0, np.flatnonzero(state.pair_count == 0)
                word = np.log10(model.unigram(state.word_count))
                direct = np.log10(np.where(seen, model.pair(state.pair_count, state.word_count[state.history]), 1))
                score = state.per_text(np.where(seen, direct, word[state.token]))
                known = state.per_text((state.word_count[state.token] > 0).astype(np.int64))
                base = state.per_text(np.log10(state.word_count[state.token] + 1))
                # Histories that are backed off from, numbered as they were asked for; others have weight 1.
                number = np.full(len(state.word_count), -1, np.int32)
                number[state.asked] = np.arange(len(state.asked))
                text = np.repeat(np.arange(len(state.ends)), state.n_words + 1)[off]
                history = number[state.history[off]]
                text, history = text[history >= 0], history[history >= 0]
                # Answers come by bucket: where each belongs.
                places = np.concatenate([np.zeros(0, np.int64), *(at for _, at in C.by_bucket(C.bucket_of(state.hash, buckets)))])
                yield C.arrow_batch(C.ASK_ARROW, [(-1, name, C.bundle(state.ids, state.train, state.n_words, known.astype(np.int64), base, score, C.small(text), C.planes(history), C.planes(places)))])

    def answer(bucket: int, rows: list[tuple[int, bytes]]) -> Iterator[tuple[int, bytes]]:
        parts = [C.unbundle(body) for _, body in rows]
        asked = [np.frombuffer(p[0], _U) for p in parts]
        h, at = np.unique(np.concatenate(asked), return_inverse=True)
        seen, below = np.zeros(len(h)), np.zeros(len(h))
        start = 0
        for mine, p in zip(asked, parts, strict=True):
            has = at[start : start + len(mine)][C.unsmall(p[1])]
            np.add.at(seen, has, np.frombuffer(p[2]))
            np.add.at(below, has, np.frombuffer(p[3]))
            start += len(mine)
        alpha = np.where(below > 0, (1 - seen) / (1 - below), 1.0)
        start = 0
        for (name, _), mine in zip(rows, asked, strict=True):
            yield name, C.bundle(np.array([bucket], np.int64), alpha[at[start : start + len(mine)]])
            start += len(mine)

    def resolve(_: int, table: bytes, answers: list[bytes]) -> Iterator[pa.RecordBatch]:
        ids, train, n_words, known, base, score, text, history, places = C.unbundle(table)
        ids, train, n_words = C.id_array(ids), np.frombuffer(train, bool), np.frombuffer(n_words, np.int32)
        places = C.from_planes(places)
        alpha = np.ones(len(places))
        parts = sorted(((int(np.frombuffer(b, np.int64)[0]), a) for b, a in map(C.unbundle, answers)), key=lambda x: x[0])
        if parts:
            alpha[places] = np.concatenate([np.frombuffer(a) for _, a in parts])
        weight = np.bincount(C.unsmall(text), np.log10(alpha)[C.from_planes(history)], len(ids))
        n = n_words.astype(np.int64) + 1
        yield pa.RecordBatch.from_arrays(
            [ids, pa.array(~train), pa.array(n), pa.array(np.frombuffer(known, np.int64)), pa.array(np.frombuffer(base)), pa.array(np.frombuffer(score) + weight)], schema=SCORE_ARROW
        )

    return C.ask_all(states.select("flush", "body").mapInArrow(questions, C.ASK), answer, resolve, SCORE, tasks, states.select("flush", "body").mapInArrow(tables, C.ASK))


def katz_scores(docs: DataFrame, train, min_count: int = 2) -> DataFrame:
    """Score every row of ``docs`` (doc_id, text) by a model of the rows where the column ``train`` is true."""
    C.limit_batches(docs.sparkSession)
    lean = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(train, F.lit(False)).alias("train"), "text")
    states = C.saved(count_tables(lean, min_count), "katz-counts")
    model = _model(states)
    size = F.lit(float(np.log10(model.total + model.words + 1)))
    scored = score_texts(states, model)
    return scored.select("doc_id", "held_out", "n_tokens", "n_known", F.lit(model.total).cast("long").alias("train_tokens"), (F.col("base_part") - F.col("n_tokens") * size).alias("base_score"), "score")


def op2_katz(spark, sf_dir: str) -> DataFrame:
    return katz_scores(C.documents(spark, sf_dir), C.fold("doc_id", 7) != 2, min_count=1)
