"""Token counts of a byte-level BPE by compiled finite-state transducers.

Two deterministic transducers, each with a scan.

* Splitter.  Over classes of characters, it marks where a piece begins (letters, digits, other signs, white space, and the
  contractions).  A text is cut into chunks of fixed width; each chunk's state map (entry state to exit state) is computed
  for all chunks at once; the maps compose by a parallel prefix scan, which gives each chunk's true entry state, and the
  marks follow from a second pass over all chunks.
* Counter.  Over bytes, its transitions are annotated with the number of tokens that they emit.  A state is the longest
  suffix that begins some token, with, for each position in it, the last token of the encoding of the text up to there and
  the difference in number of tokens; that is all that later tokens can depend on, and it is bounded by the longest token.
  States are compiled when first met and kept; the transducer restarts at each piece, so only distinct pieces are read.

Whether two tokens may stand beside each other is decided by merging their bytes by the merge ranks and comparing.
A byte's transition may emit fewer than no tokens: it can complete a longer token.

Strings of added tokens are cut out first, each counted as one, as the library does by default.

Defined results: null or empty text has no bytes and no tokens; repeated rows are counted each; a null id stays null.
"""

from __future__ import annotations

import json
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import common as C
from .token_ids import byte_alphabet

CHUNK = 64
SLICE = 1 << 20
# The most pieces and states that a worker keeps.
PIECES, STATES = 800_000, 400_000
COUNTS = "doc_id long, n_bytes long, n_tokens long"
COUNTS_ARROW = pa.schema([("doc_id", pa.int64()), ("n_bytes", pa.int64()), ("n_tokens", pa.int64())])

# Classes of characters.  The letters of contractions need classes of their own.
LETTER, DIGIT, OTHER, SPACE, BLANK, QUOTE, FINAL, R, V, L, E, BREAK = range(12)
_LETTERS = (LETTER, FINAL, R, V, L, E)
N_CLASSES = 12


@lru_cache(maxsize=1)
def character_classes() -> np.ndarray:
    """The class of every code point.  BREAK is no character: it stands before and after a text."""
    table = np.full(0x110001, OTHER, np.uint8)
    for pattern, kind in ((r"\p{L}+", LETTER), (r"\p{N}+", DIGIT), (r"\s+", BLANK)):
        every = "".join(map(chr, range(0xD800))) + "퟿" + "".join(map(chr, range(0xE000, 0x110000)))
        for found in regex.finditer(pattern, every):
            start = found.start() if found.start() < 0xD800 else found.start() - 0xD801 + 0xE000
            table[start : start + len(found.group())] = kind
    table[ord(" ")], table[ord("'")] = SPACE, QUOTE
    for c, kind in zip("stmdrvle", (FINAL,) * 4 + (R, V, L, E), strict=True):
        table[ord(c)] = kind
    table[0x110000] = BREAK
    return table


# States of the splitter: what the last characters were.  Marks: whether a piece begins at the character just read, or began at
# the one before it (decided late), or, of a contraction that did not complete, at the letter after its quote.
BEGIN, LATE = 1, 2
(S_BREAK, S_LETTER, S_DIGIT, S_OTHER, S_SPACE1, S_SPACE, S_BLANK1, S_BLANK, S_QUOTE, S_QR, S_QV, S_QL, S_DONE) = range(13)
N_STATES = 13


@lru_cache(maxsize=1)
def splitter() -> tuple[np.ndarray, np.ndarray]:
    """Transitions and marks by state and class.

    Of white space before a sign the last character is alone, or leads the sign's piece if it is a space; the marks for it
    come when the sign is read.  A quote at the beginning of a piece may start a contraction.
    """
    step = np.zeros((N_STATES, N_CLASSES), np.uint8)
    mark = np.zeros((N_STATES, N_CLASSES), np.uint8)
    run = {**dict.fromkeys(_LETTERS, S_LETTER), DIGIT: S_DIGIT, OTHER: S_OTHER, QUOTE: S_OTHER}
    for state in range(N_STATES):
        for kind in range(N_CLASSES):
            after_white = state in (S_SPACE1, S_SPACE, S_BLANK1, S_BLANK)
            if kind == BREAK:
                step[state, kind], mark[state, kind] = S_BREAK, BEGIN
            elif kind in (SPACE, BLANK):
                one = S_SPACE1 if kind == SPACE else S_BLANK1
                more = S_SPACE if kind == SPACE else S_BLANK
                step[state, kind], mark[state, kind] = (more, 0) if after_white else (one, BEGIN)
            elif after_white:
                # A run of one has begun already; of a longer run, the last character begins anew.
                late = LATE if state in (S_SPACE, S_BLANK) else 0
                if state in (S_SPACE1, S_SPACE):
                    step[state, kind], mark[state, kind] = run[kind], late
                else:
                    step[state, kind], mark[state, kind] = S_QUOTE if kind == QUOTE else run[kind], late | BEGIN
            elif state in (S_QR, S_QV, S_QL) and kind == {S_QR: E, S_QV: E, S_QL: L}[state]:
                step[state, kind] = S_DONE
            elif state in (S_QR, S_QV, S_QL):
                # No contraction: the letter after the quote began a piece.
                same = kind in _LETTERS
                step[state, kind] = S_LETTER if same else S_QUOTE if kind == QUOTE else run[kind]
                mark[state, kind] = LATE | (0 if same else BEGIN)
            elif state == S_QUOTE and kind in (FINAL, R, V, L):
                step[state, kind] = {FINAL: S_DONE, R: S_QR, V: S_QV, L: S_QL}[kind]
            elif state in (S_QUOTE, S_OTHER):
                same = kind in (OTHER, QUOTE)
                step[state, kind], mark[state, kind] = (S_OTHER, 0) if same else (run[kind], BEGIN)
            elif (state == S_LETTER and kind in _LETTERS) or (state == S_DIGIT and kind == DIGIT):
                step[state, kind] = state
            else:
                step[state, kind], mark[state, kind] = S_QUOTE if kind == QUOTE else run[kind], BEGIN
    return step, mark


def compose(maps: np.ndarray) -> np.ndarray:
    """Inclusive prefix composition of state maps (one per row): doubling steps, each over all rows at once."""
    maps, width = maps.copy(), 1
    while width < len(maps):
        # First the earlier map, then the later.
        maps[width:] = np.take_along_axis(maps[width:], maps[:-width], axis=1)
        width *= 2
    return maps


def piece_starts(classes: np.ndarray) -> np.ndarray:
    """Indices at which pieces begin, for a run of classes in which BREAK separates texts (and begins a piece itself)."""
    step, mark = splitter()
    n = len(classes)
    rows = -(-n // CHUNK)
    grid = np.full(rows * CHUNK, BREAK, np.uint8)
    grid[:n] = classes
    grid = np.ascontiguousarray(grid.reshape(rows, CHUNK).T)
    by_class = np.ascontiguousarray(step.T)
    maps = np.tile(np.arange(N_STATES, dtype=np.uint8), (rows, 1))
    for column in grid:
        maps = by_class[column[:, None], maps]
    state = np.full(rows, S_BREAK, np.uint8)
    state[1:] = compose(maps)[:-1, S_BREAK]
    flat = step.astype(np.uint8).ravel()
    marks = np.empty((CHUNK, rows), np.uint8)
    for j, column in enumerate(grid):
        at = state.astype(np.int16) * N_CLASSES + column
        marks[j] = mark.ravel()[at]
        state = flat[at]
    marks = marks.T.ravel()[:n]
    begin = (marks & BEGIN) > 0
    begin[:-1] |= (marks[1:] & LATE) > 0
    return np.flatnonzero(begin)


class Counter:
    """The lazily compiled counting transducer of one vocabulary."""

    def __init__(self, path: str):
        with open(path, encoding="utf-8") as f:
            described = json.load(f)
        kind = described["pre_tokenizer"]
        if described["model"]["type"] != "BPE" or kind["type"] != "ByteLevel" or kind.get("add_prefix_space") or described["normalizer"]:
            raise ValueError("a byte-level BPE without normalizer or added space is needed")
        self.added = [t["content"] for t in described["added_tokens"]]
        alphabet = byte_alphabet()
        added = set(self.added)
        as_bytes = lambda t: bytes(alphabet[c] for c in t)
        self.tokens = {as_bytes(t) for t in described["model"]["vocab"] if t not in added}
        self.rank = {}
        for i, m in enumerate(described["model"]["merges"]):
            a, b = m.split(" ") if isinstance(m, str) else m
            self.rank.setdefault((as_bytes(a), as_bytes(b)), i)
        self.prefixes = {t[:k] for t in self.tokens for k in range(len(t) + 1)}
        self.beside: dict[tuple[bytes, bytes], bool] = {}
        self._reset()

    def _reset(self) -> None:
        # A state: suffix, last tokens and numbers of tokens at its positions (the last number is 0, others relative to it).
        self.states: list[tuple] = [(b"", (None,), (0,))]
        self.number = {self.states[0]: 0}
        self.moves: dict[int, tuple[int, int]] = {}

    def merge(self, data: bytes) -> list[bytes]:
        """Plain BPE: merge the pair of least rank until none is left."""
        parts = [data[i : i + 1] for i in range(len(data))]
        while len(parts) > 1:
            best = min(range(len(parts) - 1), key=lambda i: self.rank.get((parts[i], parts[i + 1]), 1 << 30))
            pair = (parts[best], parts[best + 1])
            if pair not in self.rank:
                break
            merged, i = [], 0
            while i < len(parts):
                if i + 1 < len(parts) and (parts[i], parts[i + 1]) == pair:
                    merged.append(parts[i] + parts[i + 1])
                    i += 2
                else:
                    merged.append(parts[i])
                    i += 1
            parts = merged
        return parts

    def _fits(self, left: bytes | None, token: bytes) -> bool:
        key = (left, token)
        found = self.beside.get(key)
        if found is None:
            found = self.merge(token) == [token] if left is None else self.merge(left + token) == [left, token]
            self.beside[key] = found
        return found

    def _compile(self, state: int, byte: int) -> tuple[int, int]:
        suffix, last, count = self.states[state]
        grown = suffix + bytes((byte,))
        for cut in range(len(grown)):
            # The longest token that may follow the encoding of what stands before it is the last of the encoding.
            if grown[cut:] in self.tokens and self._fits(last[cut], grown[cut:]):
                token, total = grown[cut:], count[cut] + 1
                break
        else:
            raise ValueError("a byte has no token")
        keep = next(k for k in range(len(grown) + 1) if grown[k:] in self.prefixes)
        new = (grown[keep:], (*last, token)[keep:], tuple(c - total for c in (*count, total)[keep:]))
        at = self.number.get(new)
        if at is None:
            at = self.number[new] = len(self.states)
            self.states.append(new)
        move = self.moves[state << 8 | byte] = (at, total)
        return move

    def count(self, piece: bytes) -> int:
        moves, state, emitted = self.moves, 0, 0
        for byte in piece:
            move = moves.get(state << 8 | byte)
            if move is None:
                move = self._compile(state, byte)
            state = move[0]
            emitted += move[1]
        if len(self.states) > STATES:
            self._reset()
        if len(self.beside) > 4 * STATES:
            self.beside.clear()
        return emitted


class TokenCounter:
    """Counts tokens of texts; keeps the counts of pieces it has met."""

    def __init__(self, path: str):
        self.counter = Counter(path)
        self.known: dict[str, int] = {}
        self.added = regex.compile("|".join(map(regex.escape, sorted(self.counter.added, key=len, reverse=True)))) if self.counter.added else None

    def _plain(self, texts: list[str]) -> np.ndarray:
        """Counts of texts without added tokens."""
        joined = "\0" + "\0".join(texts) + "\0"
        classes = character_classes()[np.frombuffer(joined.encode("utf-32-le", "surrogatepass"), np.uint32)]
        lengths = np.fromiter(map(len, texts), np.int64, len(texts))
        breaks = np.concatenate([[0], np.cumsum(lengths + 1)])
        classes[breaks] = BREAK
        starts = piece_starts(classes)
        bounds = [*starts.tolist(), len(joined)]
        pieces = [joined[a:b] for a, b in zip(bounds, bounds[1:], strict=False)]
        if len(self.known) > PIECES:
            self.known.clear()
        known, count = self.known, self.counter.count
        for piece in set(pieces).difference(known):
            known[piece] = count(piece.encode())
        totals = np.concatenate([[0], np.cumsum(np.fromiter(map(known.__getitem__, pieces), np.int64, len(pieces)))])
        at = np.searchsorted(starts, breaks)
        # Between two breaks: without the first break's own piece.
        return totals[at[1:]] - totals[at[:-1] + 1]

    def counts(self, texts: list[str]) -> np.ndarray:
        parts: list[str] = []
        owner: list[int] = []
        extra = np.zeros(len(texts), np.int64)
        for i, text in enumerate(texts):
            if self.added and any(a in text for a in self.counter.added):
                cut = self.added.split(text)
                extra[i] = len(cut) - 1
                parts += cut
                owner += [i] * len(cut)
            else:
                parts.append(text)
                owner.append(i)
        return extra + np.bincount(owner, self._plain(parts), len(texts)).astype(np.int64)


@lru_cache(maxsize=2)
def token_counter(path: str) -> TokenCounter:
    return TokenCounter(path)


def count_tokens(docs: DataFrame, tokenizer: str) -> DataFrame:
    """(doc_id, n_bytes, n_tokens) of every row of ``docs`` (doc_id, text)."""
    C.limit_batches(docs.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counter = token_counter(tokenizer)
        for batch in batches:
            texts = batch.column(1).fill_null("")
            sizes = pa.compute.binary_length(texts).cast(pa.int64())
            ends = np.cumsum(sizes.to_numpy(zero_copy_only=False))
            at, n = 0, len(texts)
            found = [np.zeros(0, np.int64)]
            while at < n:
                to = max(at + 1, int(np.searchsorted(ends, (ends[at - 1] if at else 0) + SLICE, "right")))
                found.append(counter.counts(texts.slice(at, to - at).to_pylist()))
                at = to
            yield pa.RecordBatch.from_arrays([batch.column(0), sizes, pa.array(np.concatenate(found))], schema=COUNTS_ARROW)

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(run, COUNTS)


def op5_token_counts(spark, sf_dir: str) -> DataFrame:
    import public_tokenizers

    counted = count_tokens(C.documents(spark, sf_dir), public_tokenizers.path("byte_bpe_50k.json"))
    return counted.withColumn("over_limit", F.col("n_tokens") > 512)
