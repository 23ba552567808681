"""Toxicity by a weighted finite-state pattern grammar.

A lexicon maps words to classes: insults with learnt weights, words of threat, vows, wishes, deaths, targets, negations,
reports.  Six small transducers over the classes are composed into one deterministic machine that reads a clause and
rewrites its insults and threats by context:

    phrase       wish .. death -> threat (up to 3 words between); hush + up, drop + death, go .. hell -> insult
    insult       insult -> strong insult, up to 2 words after another insult
    threat       threat -> vowed threat, up to 3 words after a vow ("will", "going to")
    negation     insult or threat -> negated one, up to 3 words after a negation
    reported     insult or threat -> reported one, after a verb of speech up to the end of the clause, or inside quotation
                 marks up to the closing one or the end of the paragraph, over any clauses between
    target       a threat counts only with a target up to 3 words before or after it; an insult is aimed if a target stands
                 up to 4 words before it, and is marked late by one up to 3 words later

The machine's outputs carry weights; a clause's score is their sum, so a word alone never decides: its clause does.  A text's
score is a logistic function of its clauses: the strongest, the sums by kind, how many match, their share and the mean of all.  States of the
composed machine are made when first met.

Learnt, from a bounded sample of labelled rows (``per_class`` of each label, documented in ``labelled``): the insult lexicon
(words, and prefixes of 3 to 6 letters, far commoner in toxic texts; of these the ``lexicon`` surest, a bound of the fit like
``per_class``), on one half of the sample, and the logistic weights on the other.  Words that begin alike in several
inflections are one entry through their prefix.  Without labelled rows of both kinds, the seed lexicon and fixed weights hold.

Defined results: null or empty text has no clauses and gets the score of a text without patterns; a very long text is read
whole, by one task, in memory of its length; repeated rows are scored each; a null id is held out if crc32 of the empty text
says so, and stays null; an empty table gives an empty one; other columns, of whatever name, are ignored.
"""

from __future__ import annotations

import math
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import common as C
from .labelled import labelled_sample
from .spotsigs import word_list

PER_CLASS = 3000
GROUP_WORDS = 16
LEXICON = 4000
TOKEN = regex.compile(r"[\p{L}\p{N}']+|[.!?;:\n\"“”«»]")
OTHER, INSULT, THREAT, TARGET, NEGATION, REPORT, QUOTE, BREAK, PARAGRAPH, VOW, WISH, DEATH, HUSH, UP, GO, HELL, DROP = range(17)
# What the composed machine emits.
NONE, PLAIN, AIMED, NEGATED, REPORTED, MENACE, REPORTED_MENACE, AIM_LATE, STRONG, VOWED, DENIED = range(11)
KINDS = 11

# Seeds of the classes, in four languages.
SEEDS = {
    INSULT: "idiot stupid moron loser scum trash pathetic worthless disgusting imbecile dumb retard vermin dumm dreck abschaum trottel versager débile ordure racaille minable estúpido imbécil basura escoria inútil",
    THREAT: "kill murder hurt destroy stab shoot beat strangle töten umbringen schlagen tuer frapper détruire matar golpear destruir",
    TARGET: "you your yours yourself u they them their he his she him her these those du dich dir dein deine ihr euch sie tu te toi ton ta vous votre ils elles tú te ti usted ustedes vosotros ellos ellas",
    NEGATION: "not no never neither nor isn't aren't wasn't don't doesn't won't nicht kein keine nie niemals pas jamais aucun nunca jamás ningún tampoco",
    REPORT: "said says say wrote writes called calls reported reports quoted quotes claimed sagte schrieb nannte behauptete dit écrit appelé dijo escribió llamó",
    VOW: "will shall gonna going werde werden wird vais allons voy vamos",
    WISH: "hope wish hoffe wünsche espère souhaite espero ojalá",
    DEATH: "die dead rot suffer stirb sterben verrecke meurs crève crever muere muérete morir",
    HUSH: "shut",
    UP: "up",
    GO: "go geh va vete",
    HELL: "hell hölle enfer infierno",
    DROP: "drop",
}


class Transducer:
    """A deterministic letter-to-letter transducer: (state, symbol) to (state, output)."""

    def __init__(self, start, step):
        self.start, self.step = start, step

    def then(self, other: Transducer) -> Transducer:
        """The composition: what this one emits, the other reads."""

        def step(state, symbol):
            mine, out = self.step(state[0], symbol)
            theirs, final = other.step(state[1], out)
            return (mine, theirs), final

        return Transducer((self.start, other.start), step)


class Machine:
    """A transducer with numbered states, which are made when first met."""

    def __init__(self, transducer: Transducer, symbols: int):
        self.step, self.symbols = transducer.step, symbols
        self.states, self.number = [transducer.start], {transducer.start: 0}
        self.moves: dict[int, tuple[int, int]] = {}

    def move(self, state: int, symbol: int) -> tuple[int, int]:
        key = state * self.symbols + symbol
        found = self.moves.get(key)
        if found is None:
            new, out = self.step(self.states[state], symbol)
            if new not in self.number:
                self.number[new] = len(self.states)
                self.states.append(new)
            found = self.moves[key] = (self.number[new], out)
        return found


# Symbols between the stages: classes, then rewritten ones.
STRONG_INSULT, VOWED_THREAT, NEG_INSULT, NEG_THREAT, REP_INSULT, REP_THREAT = range(17, 23)
INSULTS, THREATS = (INSULT, STRONG_INSULT), (THREAT, VOWED_THREAT)
ENDS = (BREAK, PARAGRAPH)


def _phrase(state: tuple[int, int, int], symbol: int):
    """How recently a wish and a going were read, and whether the last word was the first of a pair (hush, drop)."""
    wish, go, first = state
    after = (max(wish - 1, 0), max(go - 1, 0), 0)
    if symbol in ENDS:
        return (0, 0, 0), symbol
    if symbol == WISH:
        return (4, after[1], 0), OTHER
    if symbol == GO:
        return (after[0], 3, 0), OTHER
    if symbol in (HUSH, DROP):
        return (*after[:2], symbol), OTHER
    if (symbol == UP and first == HUSH) or (symbol == DEATH and first == DROP) or (symbol == HELL and go):
        return (0, 0, 0), INSULT
    if symbol == DEATH and wish:
        return (0, 0, 0), THREAT
    return after, OTHER if symbol in (UP, DEATH, HELL) else symbol


def _insult(left: int, symbol: int):
    if symbol == INSULT:
        return 3, STRONG_INSULT if left else INSULT
    return 0 if symbol in ENDS else max(left - 1, 0), symbol


def _threat(left: int, symbol: int):
    if symbol == VOW:
        return 4, OTHER
    if symbol == THREAT and left:
        return max(left - 1, 0), VOWED_THREAT
    return 0 if symbol in ENDS else max(left - 1, 0), symbol


def _negation(left: int, symbol: int):
    if symbol in ENDS:
        return 0, symbol
    if symbol == NEGATION:
        return 4, OTHER
    if left:
        symbol = NEG_INSULT if symbol in INSULTS else NEG_THREAT if symbol in THREATS else symbol
    return max(left - 1, 0), symbol


def _reported(state: tuple[bool, bool], symbol: int):
    """Whether a verb of speech stands before in the clause, and whether a quotation is open."""
    said, quoted = state
    if symbol == PARAGRAPH:
        return (False, False), BREAK
    if symbol == BREAK:
        return (False, quoted), BREAK
    if symbol == REPORT:
        return (True, quoted), OTHER
    if symbol == QUOTE:
        return (said, not quoted), OTHER
    if said or quoted:
        symbol = REP_INSULT if symbol in INSULTS else REP_THREAT if symbol in THREATS else symbol
    return (said, quoted), symbol


def _target(state: tuple[int, int, int], symbol: int):
    """How recently a target, an insult not aimed yet, and a threat not aimed yet (below 0: a vowed one) were read."""
    target, insult, threat = state
    after = (max(target - 1, 0), max(insult - 1, 0), threat - (threat > 0) + (threat < 0))
    if symbol == BREAK:
        return (0, 0, 0), NONE
    if symbol == TARGET:
        if threat:
            return (4, 0, 0), MENACE if threat > 0 else VOWED
        return (4, 0, 0), AIM_LATE if insult else NONE
    if symbol in INSULTS:
        if target:
            return (after[0], 0, after[2]), STRONG if symbol == STRONG_INSULT else AIMED
        return (0, 3, after[2]), STRONG if symbol == STRONG_INSULT else PLAIN
    if symbol in THREATS:
        vowed = symbol == VOWED_THREAT
        return ((*after[:2], 0), VOWED if vowed else MENACE) if target else ((0, after[1], -3 if vowed else 3), NONE)
    out = {NEG_INSULT: NEGATED, REP_INSULT: REPORTED, NEG_THREAT: DENIED, REP_THREAT: REPORTED_MENACE}
    return after, out.get(symbol, NONE)


def grammar() -> Machine:
    whole = Transducer((0, 0, 0), _phrase)
    for start, step in ((0, _insult), (0, _threat), (0, _negation), ((False, False), _reported), ((0, 0, 0), _target)):
        whole = whole.then(Transducer(start, step))
    return Machine(whole, 17)


# The weight of each output beside an insult's own weight; without labels, also the logistic weights.
OUTPUT_WEIGHT = (0.0, 1.0, 1.3, 0.35, 0.35, 1.5, 0.4, 0.3, 1.4, 2.0, 0.1)
# The weight of a threat, and of an insult by phrase, in place of a word's own.
THREAT_WEIGHT = PHRASE_WEIGHT = 3.0
# The most words in a row without a class that the machine's memory can tell apart.
MEMORY = 5


@dataclass
class Lexicon:
    """Classes of words, and weights of insults by word or prefix."""

    words: dict[str, float] = field(default_factory=dict)
    prefixes: dict[str, float] = field(default_factory=dict)

    def __post_init__(self) -> None:
        self.classes = {w: k for k, names in SEEDS.items() if k != INSULT for w in names.split()}
        self.classes |= dict.fromkeys('"“”«»', QUOTE) | dict.fromkeys(".!?;:", BREAK) | {"\n": PARAGRAPH}
        self.known: dict[str, tuple[int, float]] = {}

    def look_up(self, word: str) -> tuple[int, float]:
        word = word.lower()
        weight = self.words.get(word, 0.0)
        for k in range(3, min(len(word), 6) + 1):
            weight = max(weight, self.prefixes.get(word[:k], 0.0))
        if weight:
            return INSULT, weight
        return self.classes.get(word, OTHER), 0.0

    def of(self, words: list[str]) -> list[tuple[int, tuple[int, float]]]:
        """The words that have a class, with their places."""
        known = self.known
        if len(known) > 300_000:
            known.clear()
        for w in set(words).difference(known):
            known[w] = self.look_up(w)
        get = known.__getitem__
        return [(i, c) for i, c in enumerate(map(get, words)) if c[0]]


class Scorer:
    def __init__(self, lexicon: Lexicon):
        self.lexicon = lexicon
        self.machine = grammar()

    def clauses(self, text: str) -> tuple[list[float], list[float], int]:
        """The scores of the clauses that match, sums by kind of output, and the number of clauses."""
        words = TOKEN.findall(text)
        move = self.machine.move
        sums, scores = [0.0] * KINDS, []
        clause = pending = 0.0
        state = at = 0
        ends = 1
        for i, (kind, weight) in self.lexicon.of(words):
            for _ in range(min(i - at, MEMORY)):
                state = move(state, OTHER)[0]
            state, out = move(state, kind)
            at = i + 1
            if out:
                if out == AIM_LATE:
                    value = pending
                elif out in (MENACE, VOWED, REPORTED_MENACE, DENIED):
                    value = THREAT_WEIGHT
                else:
                    value = pending = weight or PHRASE_WEIGHT
                value *= OUTPUT_WEIGHT[out]
                sums[out] += value
                clause += value
            elif kind in ENDS:
                ends += 1
                if clause:
                    scores.append(clause)
                clause = 0.0
        if clause:
            scores.append(clause)
        return scores, sums, ends

    def features(self, text: str) -> list[float]:
        """Of a text: its strongest clause, sums by kind (logarithms), how many clauses match, their share, and the mean of all."""
        scores, sums, ends = self.clauses(text)
        matched = (math.log1p(len(scores)), math.log1p(1000 * len(scores) / (ends + 2)), math.log1p(100 * sum(scores) / (ends + 2)))
        return [max(scores, default=0.0), *(math.log1p(x) for x in sums[1:]), *matched]


N_FEATURES = KINDS + 3


def learn_lexicon(sample: DataFrame, size: int = LEXICON) -> Lexicon:
    """Words and prefixes that mark label 1, from ``sample`` (text, label).  Near copies of a text count once."""

    def counts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: Counter = Counter()
        for batch in batches:
            for text, label in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                words = {w.lower() for w in TOKEN.findall(text or "") if len(w) > 2}
                keys = {" " + w for w in words} | {w[:k] for w in words for k in range(3, 7) if len(w) >= k}
                seen.update((k, label) for k in keys)
        rows: dict[str, list[int]] = {}
        for (k, label), n in seen.items():
            rows.setdefault(k, [0, 0])[label] += n
        part = [(k, n[0], n[1]) for k, n in rows.items()]
        schema = pa.schema([("key", pa.string()), ("clean", pa.int64()), ("toxic", pa.int64())])
        for at in range(0, len(part), 50_000):
            yield C.arrow_batch(schema, part[at : at + 50_000])

    totals = {r["label"]: r["n"] for r in sample.groupBy("label").agg(F.count("*").alias("n")).collect()}
    n_clean, n_toxic = totals.get(0, 0), totals.get(1, 0)
    if not n_clean or not n_toxic:
        return Lexicon(dict.fromkeys(SEEDS[INSULT].split(), 3.0), {})
    found = sample.select("text", "label").mapInArrow(counts, "key string, clean long, toxic long").groupBy("key").agg(F.sum("clean").alias("clean"), F.sum("toxic").alias("toxic"))
    odds = F.log((F.col("toxic") + 0.5) / (n_toxic + 1.0)) - F.log((F.col("clean") + 0.5) / (n_clean + 1.0))
    sure = odds / F.sqrt(1 / (F.col("toxic") + 0.5) + 1 / (F.col("clean") + 0.5))
    # A mark: at least ten times as common, and that beyond chance; the surest first.
    marks = found.withColumn("odds", odds).withColumn("sure", sure).where((F.col("odds") > 2.3) & (F.col("sure") > 2.2) & (F.col("toxic") >= max(3, n_toxic // 400)))
    rows = marks.orderBy(F.desc("sure"), "key").limit(size).collect()
    words = dict.fromkeys(SEEDS[INSULT].split(), 1.0) | {r["key"][1:]: float(r["odds"]) for r in rows if r["key"][0] == " "}
    return Lexicon(words, {r["key"]: float(r["odds"]) for r in rows if r["key"][0] != " "})


def fit_logistic(x: np.ndarray, y: np.ndarray, ridge: float = 1.0, rounds: int = 40) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Weights (last: intercept) of standardised features, by Newton's method with a ridge."""
    mean, scale = x.mean(0), x.std(0)
    scale[scale == 0] = 1
    z = np.hstack([(x - mean) / scale, np.ones((len(x), 1))])
    w = np.zeros(z.shape[1])
    penalty = np.eye(len(w)) * ridge
    penalty[-1, -1] = 1e-6
    for _ in range(rounds):
        p = 1 / (1 + np.exp(-np.clip(z @ w, -30, 30)))
        step = np.linalg.solve((z * (p * (1 - p))[:, None]).T @ z + penalty, z.T @ (y - p) - penalty @ w)
        w += step
        if np.abs(step).max() < 1e-8:
            break
    return mean, scale, w


@dataclass
class ToxicityModel:
    lexicon: Lexicon
    mean: np.ndarray
    scale: np.ndarray
    weights: np.ndarray


def learn(docs: DataFrame, labels: DataFrame, per_class: int = PER_CLASS, lexicon: int = LEXICON) -> ToxicityModel:
    """Fit on rows of ``labels`` (doc_id, toxic) outside the held-out fold."""
    sample, share = labelled_sample(docs, labels, "toxic", per_class)
    # One of a group of near copies: those whose least word hashes are the same, over the whole text.
    least = F.slice(F.sort_array(F.transform(F.array_distinct("_words"), lambda w: F.xxhash64(w))), 1, GROUP_WORDS)
    sample = sample.withColumn("_words", word_list(F.coalesce("text", F.lit("")))).withColumn("group", F.xxhash64(least, "label"))
    sample = C.saved(sample.groupBy("group").agg(F.min_by(F.struct("text", "label"), "doc_id").alias("row")).select("row.text", "row.label", (F.pmod(F.xxhash64(F.col("group"), F.lit(7)), F.lit(2)) == 0).alias("first")), "toxicity-sample")
    found = learn_lexicon(sample.where("first"), lexicon)

    def measure(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scorer = Scorer(found)
        schema = pa.schema([("x", pa.list_(pa.float64())), ("y", pa.int32())])
        for batch in batches:
            texts, labels_ = (c.to_pylist() for c in batch.columns)
            yield C.arrow_batch(schema, [(scorer.features(t or ""), y) for t, y in zip(texts, labels_, strict=True)])

    # At most 2 * per_class rows of a few numbers.
    rows = sample.where("not first").select("text", F.col("label").cast("int").alias("label")).mapInArrow(measure, "x array<double>, y int").collect()
    y = np.array([r["y"] for r in rows], float)
    if len(set(y)) < 2:
        weights = np.array([1.0, *([0.0] * (N_FEATURES - 1)), -3.0])
        return ToxicityModel(found, np.zeros(N_FEATURES), np.ones(N_FEATURES), weights)
    x = np.array([r["x"] for r in rows])
    mean, scale, weights = fit_logistic(x, y)
    # The sample is balanced; the table is not.
    share = min(max(share, 1e-6), 1 - 1e-6)
    weights[-1] += math.log(share / (1 - share)) - math.log(y.mean() / (1 - y.mean()))
    return ToxicityModel(found, mean, scale, weights)


SCORES = "doc_id long, score double"
SCORES_ARROW = pa.schema([("doc_id", pa.int64()), ("score", pa.float64())])


def score_toxicity(docs: DataFrame, model: ToxicityModel) -> DataFrame:
    """(doc_id, score) of every row of ``docs`` (doc_id, text)."""
    C.limit_batches(docs.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scorer = Scorer(model.lexicon)
        for batch in batches:
            texts = batch.column(1).fill_null("").to_pylist()
            x = np.array([scorer.features(t) for t in texts]).reshape(-1, N_FEATURES)
            z = (x - model.mean) / model.scale @ model.weights[:-1] + model.weights[-1]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(1 / (1 + np.exp(-np.clip(z, -30, 30))))], schema=SCORES_ARROW)

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(run, SCORES)


def op1_toxicity(spark, sf_dir: str) -> DataFrame:
    docs = C.documents(spark, sf_dir)
    model = learn(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))
    scored = score_toxicity(docs, model)
    return scored.select("doc_id", (C.fold("doc_id", 5) == 0).alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))
