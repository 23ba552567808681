"""Token ids, counts, files and packing against the library."""

from __future__ import annotations

import io
import random
import zlib
from collections import defaultdict

import numpy as np
import public_tokenizers
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from tokenizers import Tokenizer

from tessella.llm import packing, token_counts, token_ids, token_store
from tessella.llm.common import scratch

from .fixtures import EMPTY, SCHEMA, awkward, corpus, frame

PATH = public_tokenizers.path("byte_bpe_50k.json")
LIBRARY = Tokenizer.from_file(PATH)
PIECES = ["'", "'s", "'re", "'ll", " ", "  ", "\n", "\t", " ", "　", "a", "r", "e", "l", "v", "Zé", "ß1", "२", "²", "!?", "$", "中", "😀", "<|endoftext|>", "hello", "\0", "’"]


def library_ids(text):
    return LIBRARY.encode(text or "", add_special_tokens=False).ids


@settings(max_examples=200, deadline=None)
@given(st.lists(st.lists(st.sampled_from(PIECES), max_size=20).map("".join), max_size=5))
def test_encoder_and_counter_agree_with_the_library(texts):
    expected = [library_ids(t) for t in texts]
    assert [np.frombuffer(b, "<u4").tolist() for b in token_ids.encoder(PATH).encode(texts)] == expected
    if texts:
        assert token_counts.token_counter(PATH).counts(texts).tolist() == [len(e) for e in expected]


def test_both_ways_to_split_agree():
    split = token_ids.Splitter()
    contexts = ["{}", " {}", "a{}b", "1{} 2", " {}  {}a", "!{}'s", "\n{} \n{}\n"]
    for c in range(0x10000):
        if not 0xD800 <= c < 0xE000:
            for x in contexts:
                t = x.format(*[chr(c)] * x.count("{}"))
                assert split.plane(t) == split.any(t), t
    beyond = "a \U0001d400b \U0001f600  \U00020000 1"
    assert split(beyond) == split.any(beyond) and "".join(split(beyond)) == beyond


@settings(max_examples=100, deadline=None)
@given(st.text(max_size=60))
def test_any_text(text):
    text = text.encode("utf-8", "replace").decode()
    assert token_counts.token_counter(PATH).counts([text])[0] == len(library_ids(text))


def test_classes_agree_with_the_pattern_on_every_character():
    import regex

    every = [chr(c) for c in range(0x110000) if not 0xD800 <= c < 0xE000]
    table = token_counts.character_classes()
    for pattern, kinds in ((r"\p{L}", token_counts._LETTERS), (r"\p{N}", (token_counts.DIGIT,)), (r"\s", (token_counts.SPACE, token_counts.BLANK))):
        found = {m.start() for m in regex.finditer(pattern, "".join(every))}
        assert {i for i, c in enumerate(every) if table[ord(c)] in kinds} == found


def test_composition_is_associative_and_matches_steps():
    rng = np.random.default_rng(0)
    maps = rng.integers(0, 5, (17, 5)).astype(np.uint8)
    state, states = 2, []
    for m in maps:
        state = m[state]
        states.append(state)
    assert token_counts.compose(maps)[:, 2].tolist() == states


def test_counts_query(spark):
    rows = [*corpus(), (None, "no id"), (3, "twice"), (3, "twice")]
    got = sorted((tuple(r) for r in token_counts.count_tokens(awkward(spark, rows), PATH).collect()), key=repr)
    assert got == sorted([(i, len((t or "").encode()), len(library_ids(t))) for i, t in rows], key=repr)
    assert token_counts.count_tokens(spark.createDataFrame(EMPTY, SCHEMA), PATH).count() == 0


def check_packing(rows, got, limits, end):
    ids = defaultdict(list)
    for i, t in rows:
        ids[i].append([*library_ids(t), end])
    pieces, sequences = defaultdict(list), defaultdict(list)
    for r in got:
        pieces[r.doc_id].append(r)
        sequences[r.sequence_id].append(r)
    assert set(pieces) == set(ids)
    for i, texts in ids.items():
        assert sum(r.length for r in pieces[i]) == sum(map(len, texts))
        if len(texts) == 1:
            at = 0
            for r in sorted(pieces[i], key=lambda r: r.start):
                part = texts[0][r.start : r.start + r.length]
                assert (r.start, r.doc_tokens, r.ids_crc32) == (at, len(texts[0]), zlib.crc32(np.array(part, "<u4").tobytes()))
                at += r.length
    for rs in sequences.values():
        at = 0
        for r in sorted(rs, key=lambda r: r.offset):
            assert r.offset == at and r.length > 0
            at += r.length
        assert at <= limits[0] and len(rs) <= limits[1] and sum(r.loss_tokens for r in rs) <= limits[2]
    return sequences


@pytest.mark.parametrize("limits", [(1024, 64, 1024), (64, 3, 64), (32, 8, 10)])
def test_packing(spark, limits):
    rows = [*corpus(), (None, "no id"), (None, None), (4, "a b c")]
    got = packing.pack(awkward(spark, rows), PATH, *limits).collect()
    sequences = check_packing(rows, got, limits, 0)
    if limits[1] == 64:
        lengths = [sum(r.length for r in rs) for rs in sequences.values()]
        assert all(n & (n - 1) == 0 for n in lengths)
    assert packing.pack(spark.createDataFrame(EMPTY, SCHEMA), PATH).count() == 0


def test_packing_with_prompts(spark):
    rng = random.Random(5)
    rows = [(i, " ".join(["tok"] * rng.randint(1, 90)), rng.randint(0, 60)) for i in range(80)]
    df = spark.createDataFrame(rows, "doc_id long, text string, prompt int")
    got = packing.pack(df, PATH, 128, 4, 60, prompt_column="prompt").collect()
    check_packing([r[:2] for r in rows], got, (128, 4, 60), 0)
    loss = defaultdict(int)
    for r in got:
        loss[r.doc_id] += r.loss_tokens
    assert loss == {i: max(len(library_ids(t)) + 1 - p, 0) for i, t, p in rows}
    with pytest.raises(ValueError):
        packing.pack(df, PATH, 0)


def test_each_limit_of_instruction_packing_binds(spark, tmp_path):
    rng = random.Random(6)
    text = lambda n: " ".join(rng.choice(["tok", "ens", "of", "text"]) for _ in range(n))

    def totals(name, sizes):
        rng.shuffle(sizes)
        rows = [(i, turn, role, text(n)) for i, (a, b) in enumerate(sizes) for turn, (role, n) in enumerate([("user", a), ("assistant", b)])]
        rows += [(9000, 0, "assistant", "no prompt"), (9001, 0, "user", None), (9001, 1, "assistant", None), (9002, 0, "user", "no answer")]
        spark.createDataFrame(rows, "conv_id long, turn long, role string, text string").repartition(2).write.parquet(f"{tmp_path}/{name}/conversations.parquet")
        sequences, loss = defaultdict(list), defaultdict(int)
        for r in packing.instruction_packing(spark, f"{tmp_path}/{name}").collect():
            sequences[r.sequence_id].append(r)
            loss[r.doc_id] += r.loss_tokens
        assert loss == {(i << 20) + turn: len(library_ids(t or "")) + 1 for i, turn, role, t in rows if role == "assistant"}
        found = [(sum(r.length for r in rs), len(rs), sum(r.loss_tokens for r in rs)) for rs in sequences.values()]
        assert all(a <= 1024 and b <= 12 and c <= 512 for a, b, c in found)
        return found

    # Short examples, long prompts with short answers, short prompts with long answers: each limit ends some sequence.
    mixed = totals("mixed", [(3, 3)] * 300 + [(300, 5)] * 60 + [(4, 200)] * 60)
    assert any(a == 1024 and b < 12 and c < 512 for a, b, c in mixed)
    assert any(a < 1024 and b == 12 and c < 512 for a, b, c in mixed)
    assert any(a < 1024 and c == 512 for a, b, c in totals("answers", [(4, 200)] * 60))


def test_token_store(spark):
    rows = [*corpus(), (None, "no id"), (3, "twice"), (3, "twice"), (-(1 << 63), "least"), ((1 << 63) - 1, "greatest")]
    manifest = token_store.write_tokens(awkward(spark, rows), PATH, scratch(spark, "tokens"), 2)
    got = sorted((tuple(r) for r in token_store.read_tokens(manifest).collect()), key=lambda r: r[1])
    order = sorted(rows, key=lambda r: (r[0] is not None, r[0] or 0, r[1] or ""))
    at = 0
    assert len(got) == len(order)
    for row, (i, t) in zip(got, order):
        ids = [*library_ids(t), 2]
        assert row == (i, at, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes()))
        at += len(ids)
    empty = token_store.write_tokens(spark.createDataFrame(EMPTY, SCHEMA), PATH, scratch(spark, "tokens"))
    assert token_store.read_tokens(empty).count() == 0


class Kept(io.BytesIO):
    def close(self):
        self.data = self.getvalue()


def test_a_reader_opens_single_frames_and_notices_damage():
    rng = np.random.default_rng(1)
    docs = [(k, rng.integers(0, 70_000, rng.integers(0, 300)).astype("<u4")) for k in range(200)]
    file = Kept()
    writer = token_store.Writer(file, frame_bytes=4096)
    for k, ids in docs:
        writer.add(k, ids.tobytes())
    writer.close()
    reader = token_store.Reader(io.BytesIO(file.data))
    assert len(reader.table) > 20
    seen = []
    for k in reversed(range(len(reader.table))):
        doc, lengths, ids = reader.frame(k)
        seen = [(int(d), ids[e - n : e].tolist()) for d, n, e in zip(doc, lengths, np.cumsum(lengths))] + seen
    assert seen == [(k, ids.tolist()) for k, ids in docs]
    # The frames are plain zstandard: a reader that knows nothing of the table skips it.
    import zstandard

    assert zstandard.ZstdDecompressor().stream_reader(io.BytesIO(file.data), read_across_frames=True).read()
    damaged = bytearray(file.data)
    at = len(damaged) - 9 - 12 * len(reader.table) + 8
    damaged[at] ^= 1
    with pytest.raises(ValueError, match="damaged"):
        token_store.Reader(io.BytesIO(bytes(damaged))).frame(0)
