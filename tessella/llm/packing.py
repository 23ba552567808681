"""Vector bin packing of token sequences with the dot-product heuristic.

Examples have three sizes: tokens, segments (one each) and loss-bearing tokens; a sequence has a limit on each.  Whole
sequences are cut off long examples first.  The remainders wait in a window; an open sequence takes, again and again, the
example that fits and whose size vector, scaled by the limits, has the largest dot product with what the sequence has left,
so a sequence short of segments asks for long examples and one short of loss-bearing tokens for prompts.  When nothing
whole fits, an example is cut to fill the gap exactly (``cut``).  What is left when the input of a task ends goes into
sequences whose lengths are powers of two, which need no padding.

Each task packs its own rows: no shuffle, memory bounded by the window, and a lost task is redone alike.  A sequence id is
the task's number times 2^32 plus the sequence's number there.

Defined results: null or empty text still has its end token; repeated rows are packed each; a null id stays null; a very
long text is cut into whole sequences, in memory of its size; an empty table gives no rows; other columns, of whatever name,
are ignored.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import common as C
from .token_ids import encoder, groups

WINDOW = 256
PIECES = pa.schema([("doc_id", pa.int64()), ("start", pa.int64()), ("length", pa.int64()), ("ids_crc32", pa.int64()), ("doc_tokens", pa.int64()), ("sequence_id", pa.int64()), ("offset", pa.int64()), ("loss_tokens", pa.int64())])
PIECES_DDL = "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long, loss_tokens long"


class Packer:
    """Places examples (id, ids as bytes, loss flags or None) into sequences; yields rows of PIECES."""

    def __init__(self, limits: tuple[int, int, int], first_sequence: int, window: int = WINDOW):
        self.limits = np.array(limits, float)
        self.size, self.segments, self.loss = limits
        self.sequence = first_sequence
        self.window = window
        # Waiting remainders: their sizes beside their pieces (a segment each); a slot without tokens is free.
        self.tokens, self.bearing = np.zeros(2 * window), np.zeros(2 * window)
        self.waiting: list[tuple | None] = [None] * (2 * window)
        self.free = list(range(2 * window - 1, -1, -1))
        self.rows: list[tuple] = []

    def _row(self, piece: tuple, offset: int) -> None:
        doc, ids, flags, start, total = piece
        n = len(ids) // 4
        self.rows.append((doc, start, n, zlib.crc32(ids), total, self.sequence, offset, n if flags is None else int(flags.sum())))

    @staticmethod
    def _cut(piece: tuple, n: int) -> tuple[tuple, tuple]:
        doc, ids, flags, start, total = piece
        return (doc, ids[: 4 * n], None if flags is None else flags[:n], start, total), (doc, ids[4 * n :], None if flags is None else flags[n:], start + n, total)

    def _fit(self, piece: tuple, room: np.ndarray) -> int:
        """The most leading tokens of a piece that fit."""
        if room[1] < 1:
            return 0
        n = int(min(len(piece[1]) // 4, room[0]))
        if piece[2] is None:
            return int(min(n, room[2]))
        return int(np.searchsorted(np.cumsum(piece[2][:n]), room[2], "right"))

    def add(self, doc, ids: bytes, flags: np.ndarray | None = None) -> None:
        piece = (doc, ids, flags, 0, len(ids) // 4)
        while len(piece[1]) // 4 >= self.size:
            n = self._fit(piece, self.limits)
            if n < self.size:
                break
            head, piece = self._cut(piece, n)
            self._row(head, 0)
            self.sequence += 1
        while len(piece[1]) // 4 > self.size:
            head, piece = self._cut(piece, self.size)
            self._wait(head)
        if piece[1]:
            self._wait(piece)
        while 2 * self.window - len(self.free) >= self.window:
            self._fill()

    def _wait(self, piece: tuple) -> None:
        if not self.free:
            self._fill()
        slot = self.free.pop()
        n = len(piece[1]) // 4
        self.tokens[slot], self.bearing[slot] = n, n if piece[2] is None else piece[2].sum()
        self.waiting[slot] = piece

    def _take(self, slot: int) -> tuple:
        piece = self.waiting[slot]
        self.waiting[slot] = None
        self.tokens[slot] = self.bearing[slot] = 0
        self.free.append(slot)
        return piece

    def _fill(self, size: int | None = None) -> None:
        """Close one sequence of ``size`` tokens, or of as many as the other limits leave."""
        room = np.array([size or self.size, self.segments, self.loss], float)
        offset = 0
        while room[0] > 0 and room[1] > 0:
            # The dot product of sizes and room, both as shares of the limits.
            weight = room / self.limits**2
            score = self.tokens * weight[0] + self.bearing * weight[2] + weight[1]
            score[(self.tokens > room[0]) | (self.bearing > room[2]) | (self.tokens == 0)] = -1
            slot = int(score.argmax())
            if score[slot] > 0:
                piece = self._take(slot)
            else:
                # Nothing whole fits: the longest example is cut to the gap.
                slot = int(self.tokens.argmax())
                if self.waiting[slot] is None:
                    break
                n = self._fit(self.waiting[slot], room)
                if n == 0:
                    break
                piece, rest = self._cut(self._take(slot), n)
                if rest[1]:
                    self._wait(rest)
            n = len(piece[1]) // 4
            self._row(piece, offset)
            offset += n
            room -= (n, 1, n if piece[2] is None else piece[2].sum())
        self.sequence += 1

    def finish(self) -> None:
        while (left := int(self.tokens.sum())) > 0:
            self._fill(self.size if left >= self.size else 1 << (left.bit_length() - 1))

    def drain(self) -> list[tuple]:
        rows, self.rows = self.rows, []
        return rows


def pack(
    docs: DataFrame, tokenizer: str, max_tokens: int = 1024, max_segments: int = 64, max_loss: int = 1024, end_id: int = 0, prompt_column: str | None = None, answer_column: str | None = None
) -> DataFrame:
    """Pack the rows of ``docs`` (doc_id, text).  ``prompt_column``: how many leading tokens of a row bear no loss.

    ``answer_column``: a text that follows ``text``, tokenised apart; its tokens and the end bear loss, those of ``text`` do not.
    """
    C.limit_batches(docs.sparkSession)
    if prompt_column and answer_column:
        raise ValueError("a prompt is a number of tokens or a text, not both")
    columns = ["doc_id", "text", *([prompt_column] if prompt_column else []), *([answer_column] if answer_column else [])]
    end = np.array([end_id], "<u4").tobytes()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode = encoder(tokenizer)
        packer = Packer((max_tokens, max_segments, max_loss), TaskContext.get().partitionId() << 32)
        for batch in batches:
            doc, texts = batch.column(0).to_pylist(), batch.column(1).fill_null("").to_pylist()
            prompts = batch.column(2).fill_null(0).to_pylist() if prompt_column else None
            answers = batch.column(2).fill_null("").to_pylist() if answer_column else None
            for lo, hi in groups(texts):
                follow = encode.encode(answers[lo:hi]) if answers else [b""] * (hi - lo)
                for i, ids, more in zip(range(lo, hi), encode.encode(texts[lo:hi]), follow, strict=True):
                    prompt = None if prompts is None and answers is None else prompts[i] if prompts else len(ids) // 4
                    ids += more + end
                    packer.add(doc[i], ids, None if prompt is None else np.arange(len(ids) // 4) >= prompt)
            yield C.arrow_batch(PIECES, packer.drain())
        packer.finish()
        yield C.arrow_batch(PIECES, packer.drain())

    if min(max_tokens, max_segments, max_loss) < 1:
        raise ValueError("each limit must be at least 1")
    lean = docs.select(F.col("doc_id").cast("long").alias("doc_id"), *columns[1:])
    return lean.mapInArrow(run, PIECES_DDL)


def instruction_packing(spark, sf_dir: str) -> DataFrame:
    """Every answer of ``conversations`` with the turn before it as its prompt, under three limits that all bind.

    An example's doc_id is conv_id * 2^20 + turn.
    """
    import public_tokenizers

    turns = spark.read.parquet(f"{sf_dir}/conversations.parquet")
    answers = turns.where("role = 'assistant'").select("conv_id", "turn", F.col("text").alias("answer"))
    prompts = turns.where("role <> 'assistant'").select("conv_id", (F.col("turn") + 1).alias("turn"), "text")
    examples = answers.join(prompts, ["conv_id", "turn"], "left")
    named = examples.select((F.col("conv_id") * (1 << 20) + F.col("turn")).alias("doc_id"), "text", "answer")
    return pack(named, public_tokenizers.path("byte_bpe_50k.json"), 1024, 12, 512, answer_column="answer")


def op4_packing(spark, sf_dir: str) -> DataFrame:
    import public_tokenizers

    return pack(C.documents(spark, sf_dir), public_tokenizers.path("byte_bpe_50k.json"))
