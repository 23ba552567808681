"""Benchmark decontamination: rare n-gram seeds, then Smith-Waterman alignment of words.

1. The corpus is counted for the words of the benchmark (all rows; the table has a row per benchmark word).
2. Of every benchmark n-gram, adjoining or with gaps (``MASKS``), the rate expected by chance follows from its words' shares.
   Those below ``RARE`` a position are seeds: rare by their words, however often a leaked item itself was copied.  The rate
   is a constant, so an item has the same seeds in a corpus of any size with the same shares; chance hits stay in
   proportion to the corpus.
3. Seeds are looked up in every text.  Hits of one item on near diagonals make a candidate region.
4. Each region is aligned with its item: +2 a match, -1 an edit or a gap.  A text is contaminated by an item if the score
   reaches ``share`` of the item's full score, or ``run`` words' worth: paraphrases and excerpts pass, chance does not.

Words are runs of letters, digits and bytes beyond ASCII, with capitals of ASCII and Latin-1 lowered, so punctuation
and capitals do not hide a copy.  The seed index holds ``BLOCK`` items and about ``BLOCK_BYTES`` of text at most; a larger benchmark is taken in blocks, by
hash of the item, with a pass over the corpus each.

Defined results: null or empty texts and items match nothing; repeated rows match each; a null document or item id is kept
as null; items of fewer than ``SHORT`` words are not searched, as chance would match them.  An alignment that holds no seed,
a few common words in order, counts as chance too.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import common as C

# Words of a seed, from its first: pairs over up to two others, then longer ones where the pairs are common.  Those with gaps
# hold in copies of which every second or third word was changed.
MASKS = ((0, 1), (0, 2), (0, 3), (0, 1, 2), (0, 1, 3), (0, 2, 3), (0, 2, 4), (0, 3, 6), (0, 1, 3, 4), (0, 2, 4, 6), (0, 1, 2, 3, 4))
RARE = 2.5e-7
SHORT = 5
BLOCK, BLOCK_BYTES = 50_000, 32 << 20
_SEPARATORS = np.ones(256, bool)
_SEPARATORS[[*range(48, 58), *range(65, 91), *range(97, 123), *range(128, 256)]] = False
MATCHES = "doc_id long, item_id long, score double, start int, stop int, item_words int"
MATCHES_ARROW = pa.schema([("doc_id", pa.int64()), ("item_id", pa.int64()), ("score", pa.float64()), ("start", pa.int32()), ("stop", pa.int32()), ("item_words", pa.int32())])
MATCH, EDIT, GAP = 2, -1, -1


def _slices(column: pa.Array) -> Iterator[tuple[int, int, C.Words]]:
    """Words of runs of texts, with Latin-1 capitals (two bytes in UTF-8) lowered first."""
    data, offsets = C.text_buffers(column)
    before = np.empty_like(data)
    before[:1], before[1:] = 0, data[:-1]
    capital = (before == 0xC3) & (data >= 0x80) & (data <= 0x9E) & (data != 0x97)
    if capital.any():
        data = data + capital.astype(np.uint8) * np.uint8(32)
    lowered = pa.Array.from_buffers(pa.large_string(), len(offsets) - 1, [None, pa.py_buffer(offsets), pa.py_buffer(data)])
    return C.word_slices(lowered, lower=True, separators=_SEPARATORS)


class Lookup:
    """Sorted hashes with a bitmap before them: most misses cost one read."""

    def __init__(self, hashes: np.ndarray):
        self.hashes = hashes
        self.bits = np.zeros(1 << 20, bool)
        self.bits[(hashes & np.uint64((1 << 20) - 1)).astype(np.int64)] = True

    def find(self, h: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Places in ``h`` that are held, and where each is held."""
        at = np.flatnonzero(self.bits[(h & np.uint64((1 << 20) - 1)).astype(np.int64)])
        where = np.searchsorted(self.hashes, h[at])
        hit = self.hashes[np.minimum(where, len(self.hashes) - 1)] == h[at] if len(self.hashes) else np.zeros(len(at), bool)
        return at[hit], where[hit]


@dataclass
class Items:
    """A block of the benchmark: items as word hashes, and their seeds."""

    ids: list[int | None]
    words: list[np.ndarray]
    seeds: list[tuple[tuple[int, ...], Lookup, np.ndarray, np.ndarray, np.ndarray]]  # mask, hashes, first entry of each, items, places


def read_items(benchmark: DataFrame) -> tuple[list[int | None], list[np.ndarray]]:
    table = benchmark.select(F.col("item_id").cast("long").alias("item_id"), "text").toArrow()
    words: list[np.ndarray] = []
    for _, _, w in _slices(table["text"].combine_chunks()) if table.num_rows else ():
        words += [w.hash[0][a:b] for a, b in zip(w.first[:-1], w.first[1:], strict=True)]
    return table["item_id"].to_pylist(), words


def word_counts(docs: DataFrame, words: np.ndarray) -> tuple[np.ndarray, int]:
    """How often each of ``words`` (sorted hashes) occurs in all texts, and the number of all words."""
    find = Lookup(words)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts = np.zeros(len(words) + 1, np.int64)
        for batch in batches:
            for _, _, w in _slices(batch.column(0)):
                _, where = find.find(w.hash[0])
                counts[:-1] += np.bincount(where, minlength=len(words))
                counts[-1] += len(w.starts)
        at = np.flatnonzero(counts)
        yield pa.RecordBatch.from_arrays([pa.array(at), pa.array(counts[at])], names=["at", "n"])

    # One row per benchmark word at most.
    rows = docs.select("text").mapInArrow(run, "at long, n long").groupBy("at").agg(F.sum("n").alias("n")).collect()
    counts = np.zeros(len(words) + 1, np.int64)
    for r in rows:
        counts[r["at"]] = r["n"]
    return counts[:-1], int(counts[-1])


def masked(h: np.ndarray, at: np.ndarray, mask: tuple[int, ...]) -> np.ndarray:
    """Hashes of the words of ``mask`` from each place in ``at``."""
    total = np.zeros(len(at), np.uint64)
    for k in mask:
        total = total * np.uint64(C._BASE) + h[at + k]
    return C.mix(total + np.uint64(MASKS.index(mask)))


def choose_seeds(ids: list, words: list[np.ndarray], vocabulary: np.ndarray, share: np.ndarray) -> Items:
    """The masked n-grams of each item whose words' shares give less than ``RARE`` together."""
    log_share = np.log(np.maximum(share, 1e-18))
    logs = [log_share[np.searchsorted(vocabulary, w)] for w in words]
    taken: list[dict[tuple[int, ...], np.ndarray]] = [{} for _ in words]
    seeds = []
    for mask in MASKS:
        hs, items, places = [np.zeros(0, np.uint64)], [np.zeros(0, np.int64)], [np.zeros(0, np.int64)]
        for i, w in enumerate(words):
            n = len(w) - mask[-1]
            if len(w) < SHORT or n <= 0:
                continue
            # The last mask is a seed wherever nothing rarer begins.
            new = (sum(logs[i][k : k + n] for k in mask) < np.log(RARE)) | (mask == MASKS[-1])
            # A seed within this one, from the same word, is found wherever this one is.
            for other, held in taken[i].items():
                if set(other) < set(mask):
                    new &= ~held[:n]
            taken[i][mask] = new
            at = np.flatnonzero(new)
            hs.append(masked(w, at, mask))
            items.append(np.full(len(at), i))
            places.append(at)
        h, item, place = (np.concatenate(x) for x in (hs, items, places))
        order = np.argsort(h, kind="stable")
        h, item, place = h[order], item[order], place[order]
        first = C.runs(h)
        seeds.append((mask, Lookup(h[first]), np.append(first, len(h)), item, place))
    return Items(ids, words, seeds)


def smith_waterman(left: list[np.ndarray], right: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Best local scores of pairs of sequences, with the ends (in either) of one best alignment.

    All pairs at once, row by row; gaps within a row follow from a running maximum.
    """
    rows, columns = max(map(len, left)), max(map(len, right))
    a, b = np.zeros((len(left), rows), np.uint64), np.ones((len(left), columns), np.uint64)
    for i, (x, y) in enumerate(zip(left, right, strict=True)):
        a[i, : len(x)], b[i, : len(y)] = x, y
    ramp = np.arange(columns, dtype=np.int32) * -GAP
    before = np.zeros((len(left), columns + 1), np.int32)
    best, end_a, end_b = (np.zeros(len(left), np.int32) for _ in range(3))
    for i in range(rows):
        new = np.where(a[:, i : i + 1] == b, MATCH, EDIT).astype(np.int32) + before[:, :-1]
        np.maximum(new, before[:, 1:] + GAP, out=new)
        np.maximum(new, 0, out=new)
        new = np.maximum.accumulate(new + ramp, axis=1) - ramp
        at = new.argmax(1)
        top = new[np.arange(len(left)), at]
        better = top > best
        best[better], end_a[better], end_b[better] = top[better], i + 1, at[better] + 1
        before[:, 1:] = new
    return best, end_a, end_b


def find_leaks(docs: DataFrame, items: Items, share: float, run_words: int) -> DataFrame:
    sizes = np.array([len(w) for w in items.words], np.int64)

    def candidates(words: C.Words) -> list[tuple[int, int, int, int]]:
        """(text, item, first word, end) of regions that share seeds with an item."""
        texts, which, diagonals = [], [], []
        left = words.count[words.doc] - words.place
        for mask, lookup, first, item, place in items.seeds:
            at = np.flatnonzero(left > mask[-1])
            hit, seed = lookup.find(masked(words.hash[0], at, mask))
            many = first[seed + 1] - first[seed]
            entry = np.repeat(first[seed], many) + np.arange(int(many.sum())) - np.repeat(np.cumsum(many) - many, many)
            at = np.repeat(at[hit], many)
            texts.append(words.doc[at])
            which.append(item[entry])
            diagonals.append(words.place[at] - place[entry])
        text, item, diagonal = (np.concatenate(x) for x in (texts, which, diagonals))
        if not len(text):
            return []
        order = np.lexsort((diagonal, item, text))
        text, item, diagonal = text[order], item[order], diagonal[order]
        new = np.ones(len(text), bool)
        new[1:] = (text[1:] != text[:-1]) | (item[1:] != item[:-1]) | (np.diff(diagonal) > np.maximum(sizes[item[1:]] // 2, 4))
        starts = np.flatnonzero(new)
        ends = np.append(starts[1:], len(text))
        return [
            (int(text[s]), int(item[s]), max(int(diagonal[s]) - 4, 0), min(int(diagonal[e - 1] + sizes[item[s]]) + 8, int(words.count[text[s]])))
            for s, e in zip(starts, ends, strict=True)
        ]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids = batch.column(0).to_pylist()
            rows = []
            for lo, _, words in _slices(batch.column(1)):
                found = sorted(candidates(words), key=lambda c: (sizes[c[1]], c[3] - c[2]))
                best: dict[tuple[int, int], tuple] = {}
                for at in range(0, len(found), 128):
                    part = found[at : at + 128]
                    left = [items.words[i] for _, i, _, _ in part]
                    right = [words.hash[0][words.first[t] + a : words.first[t] + b] for t, _, a, b in part]
                    score, end_a, end_b = smith_waterman(left, right)
                    # The start, by aligning backwards from the end.
                    _, _, back = smith_waterman([x[:e][::-1] for x, e in zip(left, end_a, strict=True)], [x[:e][::-1] for x, e in zip(right, end_b, strict=True)])
                    for (t, i, a, _), s, e, length in zip(part, score.tolist(), end_b.tolist(), back.tolist(), strict=True):
                        if s >= min(share * MATCH * sizes[i], MATCH * run_words) and s > best.get((t, i), (0,))[0]:
                            best[t, i] = (s, a + e - length, a + e)
                rows += [(ids[lo + t], items.ids[i], s / (MATCH * int(sizes[i])), a, e, int(sizes[i])) for (t, i), (s, a, e) in sorted(best.items())]
            yield C.arrow_batch(MATCHES_ARROW, rows)

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(run, MATCHES)


def decontaminate(docs: DataFrame, benchmark: DataFrame, share: float = 0.55, run_words: int = 18) -> DataFrame:
    """One row per text and item that contaminates it: the alignment's score (1: the whole item), its words in the text."""
    spark = docs.sparkSession
    C.limit_batches(spark)
    # Bounded in items and in bytes; a repeated item is one.
    benchmark = benchmark.select(F.col("item_id").cast("long").alias("item_id"), "text").distinct()
    n, size = benchmark.agg(F.count("*"), F.coalesce(F.sum(F.octet_length("text")), F.lit(0))).first()
    blocks = max(1, -(-n // BLOCK), -(-size // BLOCK_BYTES))
    found = None
    for k in range(blocks):
        part = benchmark if blocks == 1 else benchmark.where(F.pmod(F.xxhash64("item_id", "text"), F.lit(blocks)) == k)
        ids, words = read_items(part)
        vocabulary = np.unique(np.concatenate([np.zeros(0, np.uint64), *words]))
        counts, total = word_counts(docs, vocabulary)
        leaks = find_leaks(docs, choose_seeds(ids, words, vocabulary, counts / max(total, 1)), share, run_words)
        found = leaks if found is None else found.unionAll(leaks)
    return found


def op7_decontamination(spark, sf_dir: str) -> DataFrame:
    return decontaminate(C.documents(spark, sf_dir), spark.read.parquet(f"{sf_dir}/benchmark.parquet"))
