"""Substring dedup and the n-gram join against plain Python."""

from __future__ import annotations

import hashlib
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from tessella.llm import common as C
from tessella.llm import components, katz, ngram_join, substring_dedup

from .fixtures import EMPTY, LOWER, SCHEMA, WORD, awkward, corpus, frame


def plain_substrings(rows, window):
    seen, out = {}, {}
    order = sorted(rows, key=lambda r: (r[0] is None, r[0] or 0))
    for i, text in order:
        w = WORD.findall(text or "")
        for s in range(len(w) - window + 1):
            seen.setdefault(tuple(w[s : s + window]), (i, s))
    for i, text in order:
        w = WORD.findall(text or "")
        gone = [False] * len(w)
        for s in range(len(w) - window + 1):
            if seen[tuple(w[s : s + window])] != (i, s):
                gone[s : s + window] = [True] * window
        out[i] = (len(w), sum(gone), " ".join(x for x, g in zip(w, gone) if not g))
    return out


@pytest.mark.parametrize("seed", [1, 2])
@pytest.mark.parametrize("flush", [50, 1 << 19])
def test_substring_dedup(spark, seed, flush, monkeypatch):
    monkeypatch.setattr(substring_dedup, "FLUSH", flush)
    monkeypatch.setattr(C, "PER_BUCKET", 1)
    rows = corpus(seed)
    expected = plain_substrings(rows, 20)
    assert sum(e[1] for e in expected.values()) > 100
    got = substring_dedup.substring_dedup(awkward(spark, rows), 20).collect()
    assert len(got) == len(rows)
    for r in got:
        kept = " ".join(WORD.findall(r.text or "")) if r.kept_text is None else r.kept_text
        assert (r.n_words, r.n_removed, kept) == expected[r.doc_id], r.doc_id


def test_substring_repeated_rows_nulls_and_empty(spark):
    long = " ".join(f"a{i}" for i in range(30))
    rows = [(5, long), (5, long), (None, long), (9, long + " tail"), (2, "x " * 45)]
    got = sorted((tuple(r) for r in substring_dedup.substring_dedup(frame(spark, rows), 20).select("doc_id", "n_words", "n_removed").collect()), key=repr)
    # The two equal rows are one occurrence, the first; within x x x ... every later window repeats the first.
    assert got == sorted([(5, 30, 0), (5, 30, 0), (None, 30, 30), (9, 31, 30), (2, 45, 44)], key=repr)
    assert substring_dedup.substring_dedup(spark.createDataFrame(EMPTY, SCHEMA), 20).count() == 0


def test_cover_must_reach_every_difference(spark):
    with pytest.raises(ValueError):
        substring_dedup.repeated_anchors(frame(spark, [(1, "a")]), 20, 13, (0, 1, 3))


def plain_join(rows, size, percent):
    sets = {}
    for i, t in rows:
        w = [x.translate(LOWER) for x in WORD.findall(t or "")]
        sets[i] = {tuple(w[k : k + size]) for k in range(len(w) - size + 1)} if len(w) >= size else {tuple(w)} if w else set()
    parent = {i: i for i in sets}

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    links = 0
    for a in sets:
        for b in sets:
            if a < b and sets[a] and sets[b] and 100 * len(sets[a] & sets[b]) >= percent * len(sets[a] | sets[b]):
                links += 1
                x, y = find(a), find(b)
                parent[max(x, y)] = min(x, y)
    return {i: (len(sets[i]), find(i)) for i in sets}, links


@pytest.mark.parametrize("seed,percent,size", [(1, 75, 5), (2, 75, 5), (3, 50, 2), (4, 60, 1)])
@pytest.mark.parametrize("flush,common", [(700_000, 64), (60, 3)])
def test_ngram_join(spark, seed, percent, size, flush, common, monkeypatch):
    monkeypatch.setattr(ngram_join, "FLUSH", flush)
    monkeypatch.setattr(C, "PER_BUCKET", 1)
    monkeypatch.setattr(ngram_join, "COMMON", common)
    rows = corpus(seed)
    expected, links = plain_join(rows, size, percent)
    assert links > 5
    got = {r.doc_id: (r.n_shingles, r.component_id) for r in ngram_join.ngram_join(awkward(spark, rows), size, percent).collect()}
    assert got == expected


def test_ngram_join_nulls_repeats_and_empty(spark):
    text = "the quick brown fox jumps over it"
    rows = [(7, text), (7, text), (None, text), (3, text.upper()), (8, None), (9, " "), (None, None)]
    got = sorted((tuple(r) for r in ngram_join.ngram_join(frame(spark, rows)).collect()), key=repr)
    assert got == sorted([(7, 3, 3), (7, 3, 3), (None, 3, 3), (3, 3, 3), (8, 0, 8), (9, 0, 9), (None, 0, None)], key=repr)
    assert ngram_join.ngram_join(spark.createDataFrame(EMPTY, SCHEMA)).count() == 0


def _joined(spark, rows):
    return {r.doc_id: r.component_id for r in ngram_join.ngram_join(frame(spark, rows)).collect()}


def test_ngram_join_small_tables(spark):
    text = "one two three four five six seven"
    assert _joined(spark, [(4, text)]) == {4: 4}
    assert _joined(spark, [(4, text), (5, "other words stand here in this one")]) == {4: 4, 5: 5}
    # Copies within one flush, with nothing else that shares an n-gram.
    one = spark.createDataFrame([(i, t, "en", "s", 1) for i, t in ((6, text), (4, text), (9, "x y"))], SCHEMA).coalesce(1)
    assert {r.doc_id: r.component_id for r in ngram_join.ngram_join(one).collect()} == {6: 4, 4: 4, 9: 9}


def test_ngram_join_takes_any_id(spark):
    low, high = -(1 << 63), (1 << 63) - 1
    a, b, c = ("a b c d e f g h i j", "k l m n o p q r s t", "u v w x y z aa bb cc dd")
    rows = [(high, a), (high - 1, a + " z"), (None, a), (low, b), (high - 2, b), (None, c), (None, c)]
    got = sorted(((r.doc_id, r.component_id) for r in ngram_join.ngram_join(frame(spark, rows)).collect()), key=repr)
    assert got == sorted([(high, high - 1), (high - 1, high - 1), (None, high - 1), (low, low), (high - 2, low), (None, None), (None, None)], key=repr)


def _nodes(spark, texts, size=1):
    """Sets as the join makes them, each n-gram shared."""
    rows = [(i, i, len(set(t)), np.array(sorted({hash_of(w) for w in t}), np.uint64).tobytes()) for i, t in enumerate(texts)]
    return spark.createDataFrame(rows, "node long, part long, n int, hashes binary").repartition(3)


def hash_of(word):
    return int.from_bytes(hashlib.sha256(word.encode()).digest()[:8], "little")


@pytest.mark.parametrize("block", [4096, 8])
def test_pairs_are_proposed_once_and_none_is_missed(spark, monkeypatch, block):
    monkeypatch.setattr(ngram_join, "BLOCK", block)
    rng = random.Random(5)
    bases = [[f"w{rng.randrange(40)}" for _ in range(rng.randint(6, 20))] for _ in range(15)]
    texts = [[rng.choice([w, w, w, w, w, f"w{rng.randrange(40)}"]) for w in bases[i % 15]] for i in range(60)]
    sets = _nodes(spark, texts)
    alike = {(i, j) for i in range(60) for j in range(i) if 100 * len({*texts[i]} & {*texts[j]}) >= 50 * len({*texts[i]} | {*texts[j]})}
    stars = [(r.a, r.b) for r in ngram_join.star_candidates(sets, 50).collect()]
    cross = [(r.a, r.b) for r in ngram_join.cross_candidates(sets, 50).collect()]
    assert len(set(stars)) == len(stars) and len(set(cross)) == len(cross)
    assert {(j, i) for i, j in alike} <= set(cross) and set(stars) <= set(cross) and len(alike) > 20
    pairs = spark.createDataFrame(cross, ngram_join.PAIRS_DDL)
    checked = ngram_join.verified(pairs, sets, 50).collect()
    assert len(checked) == len(cross) and {(r.b, r.a) for r in checked if r.linked} == alike


def test_near_copies_stay_linear(spark, monkeypatch):
    """A group of near copies of one text ends as one component, and the candidates do not grow with its square."""
    base = [f"b{i}" for i in range(200)]
    rows = [(i, " ".join([*base[: i % 150], f"only{i}", *base[i % 150 :]])) for i in range(150)]
    counts = []
    real = ngram_join.verified

    def counted(pairs, sets, percent):
        counts.append(pairs.count())
        return real(pairs, sets, percent)

    monkeypatch.setattr(ngram_join, "verified", counted)
    assert set(_joined(spark, rows).values()) == {0}
    # A copy meets the smallest member of each of its prefix n-grams, and afterwards nobody.
    assert 149 <= counts[0] <= 150 * 60 and counts[1] == 0


@pytest.mark.parametrize("operator", ["katz", "substring", "join"])
def test_order_of_arrival_does_not_matter(spark, monkeypatch, operator):
    """What a shuffle delivers in another order, as after a lost executor, gives the same owners, statistics and results."""
    monkeypatch.setattr(katz, "FLUSH_TOKENS", 300)
    monkeypatch.setattr(substring_dedup, "FLUSH", 60)
    monkeypatch.setattr(ngram_join, "FLUSH", 60)
    monkeypatch.setattr(C, "PER_BUCKET", 1)
    real = C.ask_all
    run = {
        "katz": lambda df: katz.katz_scores(df, F.col("doc_id") % 3 != 0, 1),
        "substring": lambda df: substring_dedup.substring_dedup(df, 20).select("doc_id", "text", "n_removed", "kept_text"),
        "join": ngram_join.ngram_join,
    }[operator]
    results = []
    for seed in (1, 2):

        def shuffled(asks, answer, resolve, schema, partitions, tables=None, seed=seed):
            mixed = C.saved(asks.repartition(5, F.rand(seed)).sortWithinPartitions(F.rand(seed)), "mixed")
            return real(mixed, answer, resolve, schema, partitions, tables)

        monkeypatch.setattr(C, "ask_all", shuffled)
        results.append(sorted(map(repr, run(frame(spark, corpus(3))).collect())))
    assert results[0] == results[1]


def test_components(spark):
    edges = [(i, i + 1) for i in range(40)] + [(100, 90), (90, 95), (7, 7), (200, 201), (201, 202), (202, 200)]
    got = {r.node: r.component for r in components.components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert got == {**{i: 0 for i in range(41)}, 90: 90, 95: 90, 100: 90, 200: 200, 201: 200, 202: 200}
    assert components.components(spark.createDataFrame([], "a long, b long")).count() == 0
