"""Language model, classifiers, fingerprints, decontamination."""

from __future__ import annotations

import hashlib
import math
import random
from collections import Counter, defaultdict

import numpy as np
import pytest
import regex
import xxhash
from pyspark.sql import functions as F

from tessella.llm import common as C
from tessella.llm import decontamination, katz, quality, spotsigs, toxicity
from tessella.llm.labelled import labelled_sample

from .fixtures import EMPTY, LOWER, SCHEMA, WORD, awkward, corpus, frame

# --- Katz -----------------------------------------------------------------------------------------------------------------


def plain_katz(rows, train, min_count):
    docs = [(i, [w.translate(LOWER) for w in WORD.findall(t or "")] + [1], train(i)) for i, t in rows]
    uni, bi = Counter(), Counter()
    for _, w, t in docs:
        if t:
            uni.update(w)
            bi.update(zip([0, *w[:-1]], w))
    stats = np.zeros(katz.STATS, np.int64)
    stats[0], stats[1] = sum(uni.values()), len(uni)
    for counts, at in ((uni, 4), (bi, 4 + katz.TOP + 2)):
        for c in counts.values():
            if c <= katz.TOP + 1:
                stats[at + c] += 1
    model = katz.Model.of(stats)
    history = Counter()
    for (h, _), c in bi.items():
        history[h] += c
    one = lambda c: float(model.unigram(np.array([c]))[0])
    pair = lambda c, h: float(model.pair(np.array([c]), np.array([history[h]]))[0])
    seen, below = defaultdict(float), defaultdict(float)
    for (h, w), c in bi.items():
        if c >= min_count:
            seen[h] += pair(c, h)
            below[h] += one(uni[w])

    def p(h, w):
        c = bi.get((h, w), 0)
        if c >= min_count:
            return pair(c, h)
        return ((1 - seen[h]) / (1 - below[h]) if h in seen else 1.0) * one(uni.get(w, 0))

    return docs, uni, p


@pytest.mark.parametrize("min_count", [1, 2])
@pytest.mark.parametrize("flush", [200, 1_000_000])
def test_katz(spark, min_count, flush, monkeypatch):
    monkeypatch.setattr(katz, "FLUSH_TOKENS", flush)
    rows = corpus(7)
    docs, uni, p = plain_katz(rows, lambda i: i % 3 != 0, min_count)
    n = sum(uni.values())
    got = {r.doc_id: r for r in katz.katz_scores(awkward(spark, rows), F.col("doc_id") % 3 != 0, min_count).collect()}
    for i, w, train in docs:
        r = got[i]
        assert (r.held_out, r.n_tokens, r.n_known, r.train_tokens) == (not train, len(w), sum(x in uni for x in w), n)
        assert r.base_score == pytest.approx(sum(math.log10((uni.get(x, 0) + 1) / (n + len(uni) + 1)) for x in w))
        assert r.score == pytest.approx(sum(math.log10(p(h, x)) for h, x in zip([0, *w[:-1]], w)))
    for h in [0, *list(uni)[:20]]:
        assert sum(p(h, w) for w in [*uni, "never seen"]) == pytest.approx(1)


def test_op2_keeps_pairs_seen_once(spark, tmp_path):
    frame(spark, corpus(7)).write.parquet(f"{tmp_path}/documents.parquet")
    docs = spark.read.parquet(f"{tmp_path}/documents.parquet")
    train = {r.doc_id: r.train for r in docs.select("doc_id", (C.fold("doc_id", 7) != 2).alias("train")).collect()}
    made, _, p = plain_katz([(r.doc_id, r.text) for r in docs.collect()], train.get, 1)
    got = {r.doc_id: r.score for r in katz.op2_katz(spark, str(tmp_path)).collect()}
    assert len(got) == len(made) and not all(train.values())
    for i, w, _ in made:
        assert got[i] == pytest.approx(sum(math.log10(p(h, x)) for h, x in zip([0, *w[:-1]], w)))


def test_katz_edges(spark):
    rows = [(None, None), (1, ""), (1, ""), (2, "A a b")]
    got = katz.katz_scores(frame(spark, rows), F.lit(True)).collect()
    assert len(got) == 4 and all(math.isfinite(r.score) for r in got)
    assert katz.katz_scores(spark.createDataFrame(EMPTY, SCHEMA), F.lit(True)).count() == 0
    none = katz.katz_scores(frame(spark, rows), F.lit(False)).collect()
    assert {(r.n_known, r.score, r.base_score) for r in none} == {(0, 0.0, 0.0)}


# --- classifiers ------------------------------------------------------------------------------------------------------------


def marked(seed, n=400):
    rng = random.Random(seed)
    rows, labels = [], []
    for i in range(n):
        w = [f"{rng.choice('bcdfg')}{rng.choice('aeiou')}{rng.choice('lmnrst')}{rng.choice('aeiou')}x{rng.randint(0, 60)}" for _ in range(rng.randint(5, 60))]
        toxic = i % 4 == 0
        if toxic:
            for _ in range(2):
                w.insert(rng.randrange(len(w)), rng.choice(["grobnak", "zuffen" + rng.choice(["ed", "ing", "er"])]))
        bad = i % 3 == 0
        text = " ".join(x.upper() + "!!" for x in w) if bad else " ".join(w).capitalize() + "."
        rows.append((i, text))
        labels.append((i, int(not bad), int(toxic)))
    return rows, labels


LABELS = "doc_id long, quality int, toxic int"


def test_held_out_rows_are_never_learnt_from(spark):
    rows, labels = marked(1)
    import zlib

    sample, share = labelled_sample(frame(spark, rows), spark.createDataFrame(labels, LABELS), "toxic", 50)
    ids = [r.doc_id for r in sample.collect()]
    assert len(ids) == 100 and all(zlib.crc32(str(i).encode()) % 5 for i in ids) and 0.2 < share < 0.3


def test_toxicity_learns_words_and_prefixes(spark):
    rows, labels = marked(2)
    model = toxicity.learn(frame(spark, rows), spark.createDataFrame(labels, LABELS))
    fresh, truth = marked(3)
    extra = [(9000, None), (9001, ""), (None, "plain words"), (9002, "a " * 30000)]
    got = {r.doc_id: r.score for r in toxicity.score_toxicity(awkward(spark, [*fresh, *extra]), model).collect()}
    assert len(got) == len(fresh) + 4 and all(0 <= s <= 1 for s in got.values())
    right = sum((got[i] >= 0.5) == bool(t) for i, _, t in truth)
    assert right / len(truth) > 0.95
    assert toxicity.score_toxicity(spark.createDataFrame(EMPTY, SCHEMA), model).count() == 0


def test_toxicity_learns_behind_a_common_header(spark):
    header = " ".join(f"header{i}" for i in range(30)) + " "
    rows, labels = marked(2)
    model = toxicity.learn(frame(spark, [(i, header + t) for i, t in rows]), spark.createDataFrame(labels, LABELS))
    assert "grobnak" in model.lexicon.words
    fresh, truth = marked(3)
    got = {r.doc_id: r.score for r in toxicity.score_toxicity(frame(spark, [(i, header + t) for i, t in fresh]), model).collect()}
    assert sum((got[i] >= 0.5) == bool(t) for i, _, t in truth) / len(truth) > 0.95


def test_toxicity_without_labels(spark):
    none = spark.createDataFrame([], LABELS)
    model = toxicity.learn(frame(spark, [(1, "you are an idiot")]), none)
    scores = {r.doc_id: r.score for r in toxicity.score_toxicity(frame(spark, [(1, "you are an idiot, you worthless scum"), (2, "fine weather")]), model).collect()}
    assert scores[1] > scores[2]


def test_the_grammar_scores_clauses_not_words():
    score = toxicity.Scorer(toxicity.Lexicon(dict.fromkeys(["idiot"], 3.0)))
    best = lambda text: score.features(text)[0]
    assert best("you idiot") > best("an idiot") > best("he is not an idiot") > 0
    assert best("an idiot") > best('she said "an idiot" there')
    assert best("I will kill you") > 0 and best("we kill time") == 0
    assert best("they said I kill you") < best("I kill you")
    # Context ends with its clause.
    assert best("not here. an idiot") == best("an idiot")
    sums = lambda text: score.clauses(text)[1]
    found = sums("an idiot. he is not an idiot. she said idiot")
    assert found[toxicity.PLAIN] > 0 and found[toxicity.NEGATED] > 0 and found[toxicity.REPORTED] > 0


def test_each_machine_of_the_grammar_decides_something():
    score = toxicity.Scorer(toxicity.Lexicon(dict.fromkeys(["idiot", "stupid"], 3.0)))
    best = lambda text: score.features(text)[0]
    kinds = lambda text: {k for k, x in enumerate(score.clauses(text)[1]) if x}
    # Phrases: their words alone are nothing.
    assert kinds("I hope you all die") == {toxicity.MENACE} and not kinds("I hope. you all die") and not kinds("they die")
    assert kinds("shut up") == kinds("drop dead") == kinds("go to hell") == {toxicity.PLAIN} and not kinds("stand up") and not kinds("shut the door up")
    # An insult after an insult; a vowed threat; what a negation leaves of either.
    assert kinds("a stupid idiot") == {toxicity.PLAIN, toxicity.STRONG} and kinds("stupid. idiot") == {toxicity.PLAIN}
    assert kinds("I will kill you") == {toxicity.VOWED} and best("I will kill you") > best("I kill you")
    assert kinds("I will not kill you") == {toxicity.DENIED} and best("I will not kill you") < best("I kill you")
    # A quotation goes on over clauses, up to its mark or the end of the paragraph; after it insults count in full.
    assert kinds('it read "fine. ok" you idiot') == {toxicity.AIMED}
    assert best('it read "fine. ok" you idiot') == best("you idiot")
    assert kinds('it went "fine. you idiot. ok" then') == {toxicity.REPORTED}
    assert kinds('an "open mark\nyou idiot') == {toxicity.AIMED}
    assert kinds("idiot, you there") == {toxicity.PLAIN, toxicity.AIM_LATE}


def test_a_composition_does_what_its_parts_do_in_turn():
    rng = random.Random(0)
    parts = [(0, toxicity._negation), ((False, False), toxicity._reported), ((0, 0, 0), toxicity._target)]
    whole = toxicity.Transducer(*parts[0])
    for part in parts[1:]:
        whole = whole.then(toxicity.Transducer(*part))
    machine, state, states = toxicity.Machine(whole, 17), 0, [start for start, _ in parts]
    for _ in range(2000):
        symbol = out = rng.randrange(10)
        for k, (_, step) in enumerate(parts):
            states[k], out = step(states[k], out)
        state, emitted = machine.move(state, symbol)
        assert emitted == out


def test_a_repeated_id_is_one_row_of_the_sample(spark):
    rows = [(1, "a"), (1, "b"), (1, "b"), (2, "c"), (None, "d")]
    sample, _ = labelled_sample(frame(spark, rows), spark.createDataFrame([(1, 1, 1), (2, 0, 0), (2, 0, 0), (None, 1, 1)], LABELS), "toxic", 5, held_out=9, modulus=8)
    assert sorted((r.doc_id, r.text, r.label) for r in sample.collect()) == [(1, "a", 1), (2, "c", 0)]


def test_quality(spark):
    rows, labels = marked(4)
    forest = quality.learn(frame(spark, rows), spark.createDataFrame(labels, LABELS))
    fresh, truth = marked(5)
    extra = [(9000, None), (9001, ""), (None, "x"), (9002, "word " * 40000)]
    got = {r.doc_id: r.q for r in quality.score_quality(awkward(spark, [*fresh, *extra]), forest, "q").collect()}
    assert len(got) == len(fresh) + 4 and all(0 <= s <= 1 for s in got.values())
    assert sum((got[i] >= 0.3) == bool(q) for i, q, _ in truth) / len(truth) > 0.95
    assert quality.score_quality(spark.createDataFrame(EMPTY, SCHEMA), forest).count() == 0
    one = quality.learn(frame(spark, rows), spark.createDataFrame([(1, 1, 0)], LABELS))
    assert one.probability(np.zeros((2, len(quality.FEATURES)))).tolist() == pytest.approx([1, 1], abs=1e-3)


def test_flat_trees_walk_like_nested_ones():
    rng = np.random.default_rng(0)
    x = rng.normal(size=(600, 4))
    y = ((x[:, 0] > 0) ^ (x[:, 1] > 0.5)).astype(float)
    f = quality.fit_forest(x, y, trees=20, leaves=6)

    def walk(row):
        total = f.start
        for at in f.roots:
            while f.left[at] != at:
                at = f.left[at] if row[f.feature[at]] <= f.threshold[at] else f.right[at]
            total += f.value[at]
        return total

    assert f.margin(x[:50]).tolist() == pytest.approx([walk(r) for r in x[:50]])
    assert ((f.probability(x) > 0.5) == y).mean() > 0.9


# --- fingerprints -----------------------------------------------------------------------------------------------------------


def plain_signatures(text):
    """Chains by walking the words; hashed as Spark does."""
    tokens: list[tuple[bool, str]] = [(True, "")]
    run = 0
    found = [w for w in regex.split(r"[^\p{L}\p{N}]+", text.lower()) if w]
    for i, w in enumerate(found):
        if w in spotsigs.ANCHORS:
            tokens.append((True, w))
            run = 0
            continue
        tokens.append((False, w))
        run += 1
        if run == spotsigs.STRETCH and i + 1 < len(found) and found[i + 1] not in spotsigs.ANCHORS:
            tokens.append((True, ""))
            run = 0
    out = set()
    for i, (anchor, w) in enumerate(tokens):
        content = [x for a, x in tokens[i:] if not a][:2] if anchor else []
        if content:
            h = 42
            for x in (*content, "")[:2]:
                h = xxhash.xxh64_intdigest(x.encode(), h)
            whole = xxhash.xxh64_intdigest(h.to_bytes(8, "little"), xxhash.xxh64_intdigest(w.encode(), 42))
            out.add(whole - (1 << 64 if whole >> 63 else 0))
    return frozenset(out)


def test_op6_against_plain_python(spark, tmp_path):
    rng = random.Random(8)
    mixed = [" ".join(rng.choice(["the", "of", "la", "UND", f"k{rng.randint(0, 60)}", f"Ü{rng.randint(0, 9)}-x"]) for _ in range(rng.randint(1, 80))) for _ in range(30)]
    rows = [(i, t) for i, t in enumerate([*mixed, "the " * 9000, "a b", "the", "one", "x y z " * 50, "😀é the 𝒳 fox", None, "", " .. "])]
    rows += [(None, "no id at all"), (-(1 << 63), "The cat and the dog."), (1000, "The cat and the dog."), ((1 << 63) - 1, "word " * 3000)]
    awkward(spark, rows).write.parquet(f"{tmp_path}/documents.parquet")
    got = spotsigs.op6_spotsigs(spark, str(tmp_path)).collect()
    order = sorted(rows, key=lambda r: (-(r[0] if r[0] is not None else -(1 << 63)), [-ord(c) for c in r[1] or ""]))
    digits = lambda s: "".join(f"{h & 0xFFFFFFFF:08x}".upper() for h in sorted(s))
    alike = lambda a, b: 1.0 if a == b else len(a & b) / len(a | b)
    expected = []
    for k, (i, t) in enumerate(order):
        t, after = t or "", order[(k + 1) % len(order)][1] or ""
        third = len(t) // 3
        edited = t[: len(t) - third] + after[:third]
        own, of_edited, of_next = map(plain_signatures, (t, edited, after))
        expected.append((i, len(t), hashlib.sha256(edited.encode()).hexdigest(), digits(own), digits(of_edited), pytest.approx(alike(own, of_edited)), pytest.approx(alike(own, of_next))))
    assert len(got) == len(rows)
    for want in expected:
        assert any(tuple(r) == want for r in got if r.doc_id == want[0]), want


def test_spotsigs(spark):
    rows = [*corpus(), (None, "no id at all"), (1000, "The cat and the dog."), (999, "The cat and the dog.")]
    pairs = {r.doc_id: (r.text, r.next_text) for r in spotsigs.with_next_text(frame(spark, rows)).collect()}
    order = sorted(rows, key=lambda r: (r[0] is None, -(r[0] or 0)))
    assert len(pairs) == len(rows)
    for k, (i, t) in enumerate(order):
        assert pairs[i] == (t or "", order[(k + 1) % len(order)][1] or "")
    assert spotsigs.with_next_text(spark.createDataFrame(EMPTY, SCHEMA)).count() == 0


def test_spotsigs_pairs_match_brute_force(spark):
    rng = random.Random(3)
    base = [" ".join(rng.choice(["the", "of", "and", f"k{rng.randint(0, 300)}"]) for _ in range(150)) for _ in range(8)]
    rows = []
    for i in range(40):
        w = base[i % 8].split()
        for _ in range(rng.randint(0, 12)):
            w[rng.randrange(len(w))] = f"n{rng.randint(0, 9)}"
        rows.append((i, " ".join(w)))
    df = frame(spark, rows)
    sets = {i: plain_signatures(t) for i, t in rows}
    assert sets == {r.doc_id: frozenset(r.s) for r in spotsigs.signature_sets(df).collect()}
    names = {}
    for i, s in sets.items():
        names[s] = min(i, names.get(s, i))
    nodes = {i: s for s, i in names.items()}
    expected = {(a, b) for a in nodes for b in nodes if a < b and 100 * len(nodes[a] & nodes[b]) >= 75 * len(nodes[a] | nodes[b])}
    got = {(r.a, r.b) for r in spotsigs.near_pairs(df).collect()}
    assert got == expected and expected


# --- decontamination --------------------------------------------------------------------------------------------------------


def plain_alignment(a, b):
    h = np.zeros((len(a) + 1, len(b) + 1), int)
    for i in range(1, len(a) + 1):
        for j in range(1, len(b) + 1):
            h[i, j] = max(0, h[i - 1, j - 1] + (2 if a[i - 1] == b[j - 1] else -1), h[i - 1, j] - 1, h[i, j - 1] - 1)
    return h.max()


def test_alignment_scores():
    rng = np.random.default_rng(0)
    left = [rng.integers(2, 6, rng.integers(1, 12)).astype(np.uint64) for _ in range(30)]
    right = [rng.integers(2, 6, rng.integers(1, 20)).astype(np.uint64) for _ in range(30)]
    scores, _, _ = decontamination.smith_waterman(left, right)
    assert scores.tolist() == [plain_alignment(a.tolist(), b.tolist()) for a, b in zip(left, right)]


def test_decontamination(spark):
    rng = random.Random(1)
    vocabulary = [f"v{rng.randint(0, 3000)}x" for _ in range(2000)]
    text = lambda n: [rng.choice(vocabulary) for _ in range(n)]
    items = [(k, text(rng.randint(15, 50))) for k in range(30)]
    rows, expected = [], set()
    for i in range(150):
        w = text(rng.randint(0, 200))
        if i % 3 == 0:
            k, item = items[i % 30]
            copy = [x if rng.random() > 0.12 else "edited" for x in item]
            at = rng.randint(0, len(w))
            w = w[:at] + [x.upper() + "!" for x in copy] + w[at:]
            expected.add((i, k))
        rows.append((i, " ".join(w)))
    rows += [(None, " ".join(items[0][1])), (7000, None), (7001, "")]
    expected.add((None, 0))
    bench = spark.createDataFrame([(k, " ".join(w) + ".") for k, w in items] + [(500, None), (501, "too short"), (None, "")], "item_id long, text string")
    got = {(r.doc_id, r.item_id): r for r in decontamination.decontaminate(awkward(spark, rows), bench).collect()}
    assert set(got) == expected
    whole = got[None, 0]
    assert (whole.score, whole.start, whole.stop) == (1.0, 0, len(items[0][1]))
    assert decontamination.decontaminate(spark.createDataFrame(EMPTY, SCHEMA), bench).count() == 0
    assert decontamination.decontaminate(frame(spark, rows), bench.limit(0)).count() == 0


@pytest.mark.parametrize("every", [2, 3, 4])
def test_edited_copies_are_found_as_by_aligning_all(spark, every):
    """Every second, third or fourth word changed: what reaches the threshold when all pairs are aligned, and nothing else.

    Only for items of under 14 words may an alignment be left out, where no copy was planted: common words in order by chance.
    """
    rng = random.Random(every)
    weights = [1 / (k + 1) for k in range(3000)]
    text = lambda n: rng.choices(range(3000), weights, k=n)
    items = [text(rng.choice([6, 9, 14, 30, 45, 80])) for _ in range(24)]
    rows = [text(rng.randint(0, 300)) for _ in range(200)]
    for i, item in enumerate(items):
        copy = [x if (j + 1) % every else rng.randint(3000, 9000) for j, x in enumerate(item)]
        rows[i * 3] += copy
    worth = lambda item: min(0.55 * 2 * len(item), 36)
    expected = set()
    for d, row in enumerate(rows):
        pairs = [np.array(item, np.uint64) + np.uint64(2) for item in items]
        if row:
            scores, _, _ = decontamination.smith_waterman(pairs, [np.array(row, np.uint64) + np.uint64(2)] * len(pairs))
            expected |= {(d, k) for k, s in enumerate(scores.tolist()) if s >= worth(items[k])}
    assert expected
    words = lambda w: " ".join(f"w{x}" for x in w)
    bench = spark.createDataFrame([(k, words(w)) for k, w in enumerate(items)], "item_id long, text string")
    found = decontamination.decontaminate(frame(spark, [(d, words(w)) for d, w in enumerate(rows)]), bench).collect()
    found = {(r.doc_id, r.item_id) for r in found}
    assert found <= expected
    assert all(len(items[k]) < 14 and d != 3 * k for d, k in expected - found)


def test_seeds_are_the_same_at_every_size(spark):
    """A corpus fifty times as large with the same shares gives the same seeds."""
    rng = random.Random(5)
    text = lambda n: " ".join(f"w{rng.randint(0, 400)}" for _ in range(n))
    bench = spark.createDataFrame([(k, text(30)) for k in range(10)], "item_id long, text string")
    ids, words = decontamination.read_items(bench)
    vocabulary = np.unique(np.concatenate(words))
    docs = frame(spark, [(k, text(100)) for k in range(40)])
    chosen = []
    for times in (1, 50):
        counts, total = decontamination.word_counts(docs.crossJoin(spark.range(times).select()), vocabulary)
        chosen.append([(m, lookup.hashes.tolist(), place.tolist()) for m, lookup, _, _, place in decontamination.choose_seeds(ids, words, vocabulary, counts / total).seeds])
    assert chosen[0] == chosen[1] and sum(len(p) for _, _, p in chosen[0]) > 100


def test_large_benchmarks_go_in_blocks(spark, monkeypatch):
    monkeypatch.setattr(decontamination, "BLOCK", 4)
    items = [(k, " ".join(f"q{k}w{j}" for j in range(20))) for k in range(11)]
    found = decontamination.decontaminate(frame(spark, items), spark.createDataFrame(items, "item_id long, text string")).collect()
    assert sorted((r.doc_id, r.item_id) for r in found) == [(k, k) for k in range(11)]


def test_members_of_equal_signature_sets(spark):
    rows = [(5, "the quick fox runs to a hill"), (2, "The quick fox runs to a hill!"), (9, "the quick fox runs to a hill"), (7, "other words"), (8, None)]
    assert {tuple(r) for r in spotsigs.members(frame(spark, rows)).collect()} == {(2, 5), (2, 9)}
