"""Text quality by histogram gradient-boosted trees over document statistics.

Statistics describe a text's form only: lengths, shares of kinds of characters, repetition of lines and words, function
words.  Bins are quantiles; a tree grows best-first from gradient histograms; trees are complete in depth once flattened
into arrays (feature, threshold, child offsets, value), so a batch walks all trees level by level in numpy.

Fitted on a bounded sample (``per_class`` rows of each label, see ``labelled``) on the driver: the sample's statistics are
a few numbers a row.  Trees stop where a held-aside fifth of the sample no longer improves.

Defined results: null or empty text has its statistics (all 0) and a score like any other; repeated rows are scored each;
a null id is held out if crc32 of the empty text says so, and stays null.  Without both labels the score is their share.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import common as C
from .labelled import labelled_sample

PER_CLASS = 6000
# Function words of four languages.
FUNCTION_WORDS = frozenset(
    "the of and to in is that for it as was with be by on this are at from or an he his her not have has but they you we"
    " der die das und in den von zu mit ist des auf für nicht ein eine dem sich auch als es an er"
    " le la les de des et un une du en est que pour dans qui sur par au pas avec se"
    " el los las y del que en por con una su para al lo como más no".split()
)
FEATURES = (
    "characters", "words", "word length", "long words", "distinct words", "top word", "top pair", "function words", "capital letters", "words in capitals", "digits", "white space",
    "stops", "commas", "exclamations", "bars", "signs", "other signs", "symbols at word ends", "lines", "line length", "repeated lines", "repeated line characters", "short lines",
    "lines without end", "sentence length", "letters beyond ASCII", "entropy of bytes", "longest word", "words without letters", "brackets", "links", "repeated pairs", "alternate case",
)
_WORD_SIGN = regex.compile(r"[^\w\s.,;:?\"')\]]+(?=\s|$)")
_CASE = regex.compile(r"\p{Ll}\p{Lu}")


def statistics(text: str) -> list[float]:
    """The statistics named in FEATURES."""
    n = len(text)
    if not n:
        return [0.0] * len(FEATURES)
    data = np.frombuffer(text.encode("utf-8", "surrogatepass"), np.uint8)
    counts = np.bincount(data, minlength=256)
    share = counts[counts > 0] / len(data)
    words = text.split()
    m = max(len(words), 1)
    lower = [w.lower() for w in words]
    tally: dict[str, int] = {}
    for w in lower:
        tally[w] = tally.get(w, 0) + 1
    distinct = len(tally)
    pairs: dict[tuple[str, str], int] = {}
    for p in zip(lower, lower[1:], strict=False):
        pairs[p] = pairs.get(p, 0) + 1
    lines = [x.strip() for x in text.split("\n") if x.strip()]
    seen: set[str] = set()
    again = again_chars = 0
    for x in lines:
        if x in seen:
            again += 1
            again_chars += len(x)
        seen.add(x)
    k = max(len(lines), 1)
    c = counts.tolist()
    upper, small = sum(c[65:91]), sum(c[97:123])
    digits = sum(c[48:58])
    space = c[32] + c[10] + c[9] + c[13]
    stops = c[46] + c[33] + c[63]
    signs = sum(c[33:48]) + sum(c[58:65]) + sum(c[91:97]) + sum(c[123:127])
    odd = c[35] + c[36] + c[37] + c[38] + c[42] + c[94] + c[126] + c[61] + c[43] + c[60] + c[62] + c[95] + c[92]
    high = len(data) - sum(c[:128])
    lengths = list(map(len, words)) or [0]
    return [
        math.log1p(n), math.log1p(m), sum(lengths) / m, sum(x > 12 for x in lengths) / m, distinct / m, max(tally.values(), default=0) / m, max(pairs.values(), default=0) / m,
        sum(t for w, t in tally.items() if w.strip(".,;:!?") in FUNCTION_WORDS) / m, upper / n, sum(w.isupper() and len(w) > 1 for w in words) / m, digits / n, space / n,
        stops / m, c[44] / m, c[33] / m, c[124] / m, signs / n, odd / n, len(_WORD_SIGN.findall(text)) / m, math.log1p(k), math.log1p(n / k), again / k, again_chars / n, sum(len(x) < 20 for x in lines) / k,
        sum(x[-1] not in ".!?\"'»”" for x in lines) / k, math.log1p(m / max(stops, 1)), high / n, float(-(share * np.log2(share)).sum()), math.log1p(max(lengths)), sum(not any(ch.isalpha() for ch in w) for w in tally) / max(distinct, 1),
        (c[40] + c[41] + c[91] + c[93] + c[123] + c[125]) / n, text.count("http") / m, 1 - len(pairs) / max(m - 1, 1), len(_CASE.findall(text)) / max(upper + small, 1),
    ]


@dataclass
class Forest:
    """All trees in flat arrays; a leaf points to itself."""

    feature: np.ndarray
    threshold: np.ndarray
    left: np.ndarray
    right: np.ndarray
    value: np.ndarray
    roots: np.ndarray
    depth: int
    start: float

    def margin(self, x: np.ndarray) -> np.ndarray:
        at = np.tile(self.roots, (len(x), 1))
        rows = np.arange(len(x))[:, None]
        for _ in range(self.depth):
            at = np.where(x[rows, self.feature[at]] <= self.threshold[at], self.left[at], self.right[at])
        return self.start + self.value[at].sum(1)

    def probability(self, x: np.ndarray) -> np.ndarray:
        return 1 / (1 + np.exp(-np.clip(self.margin(x), -30, 30)))


def fit_forest(x: np.ndarray, y: np.ndarray, trees: int = 120, leaves: int = 12, rate: float = 0.1, bins: int = 64, ridge: float = 1.0, least: int = 20, patience: int = 15) -> Forest:
    """Histogram gradient boosting of log loss; every fifth row is held aside to decide when to stop."""
    aside = np.arange(len(x)) % 5 == 4
    edges = [np.unique(np.quantile(x[:, f], np.linspace(0, 1, bins + 1)[1:-1])) for f in range(x.shape[1])]
    binned = np.stack([np.searchsorted(e, x[:, f], "left") for f, e in enumerate(edges)], 1).astype(np.int64)
    flat = binned + np.arange(x.shape[1]) * bins
    share = np.clip(y[~aside].mean() if (~aside).any() else 0.5, 1e-6, 1 - 1e-6)
    start = math.log(share / (1 - share))
    margin = np.full(len(x), start)
    feature, threshold, left, right, value, roots = [], [], [], [], [], []
    depth, best, best_at, lengths = 0, math.inf, 0, []
    for _ in range(trees):
        p = 1 / (1 + np.exp(-margin))
        g, h = p - y, np.maximum(p * (1 - p), 1e-6)

        def split(rows: np.ndarray) -> tuple[float, int, int]:
            cells = flat[rows].ravel()
            shape = (x.shape[1], bins)
            size = x.shape[1] * bins
            gs = np.bincount(cells, np.repeat(g[rows], x.shape[1]), size).reshape(shape).cumsum(1)
            hs = np.bincount(cells, np.repeat(h[rows], x.shape[1]), size).reshape(shape).cumsum(1)
            ns = np.bincount(cells, minlength=size).reshape(shape).cumsum(1)
            total_g, total_h, n = gs[:, -1:], hs[:, -1:], len(rows)
            gain = gs**2 / (hs + ridge) + (total_g - gs) ** 2 / (total_h - hs + ridge) - total_g**2 / (total_h + ridge)
            gain[(ns < least) | (n - ns < least)] = -1
            f, b = np.unravel_index(int(gain.argmax()), shape)
            return float(gain[f, b]), int(f), int(b)

        def node(rows: np.ndarray, level: int) -> tuple:
            at = len(feature)
            feature.append(0)
            threshold.append(0.0)
            left.append(at)
            right.append(at)
            value.append(-rate * g[rows].sum() / (h[rows].sum() + ridge))
            return (*split(rows), at, rows, level)

        roots.append(len(feature))
        open_ = [node(np.flatnonzero(~aside), 0)]
        grown = 1
        while grown < leaves and open_:
            i = max(range(len(open_)), key=lambda j: open_[j][0])
            gain, f, b, at, rows, level = open_.pop(i)
            if gain <= 1e-6 or b >= len(edges[f]):
                continue
            goes = binned[rows, f] <= b
            feature[at], threshold[at], value[at] = f, float(edges[f][b]), 0.0
            for side, part in ((left, rows[goes]), (right, rows[~goes])):
                side[at] = len(feature)
                open_.append(node(part, level + 1))
            depth = max(depth, level + 1)
            grown += 1
        new = Forest(*(np.array(v) for v in (feature, threshold, left, right, value)), np.array(roots[-1:]), depth, 0.0)
        margin += new.margin(x)
        check = aside if aside.any() else ~aside
        loss = float(np.logaddexp(0, np.where(y[check] > 0, -margin[check], margin[check])).mean())
        lengths.append(len(feature))
        if loss < best - 1e-5:
            best, best_at = loss, len(roots)
        elif len(roots) - best_at >= patience:
            break
    best_at = max(best_at, 1)
    cut = lengths[best_at - 1]
    return Forest(np.array(feature[:cut]), np.array(threshold[:cut]), np.array(left[:cut]), np.array(right[:cut]), np.array(value[:cut]), np.array(roots[:best_at]), depth, start)


def learn(docs: DataFrame, labels: DataFrame, per_class: int = PER_CLASS) -> Forest:
    """Fit on rows of ``labels`` (doc_id, quality) outside the held-out fold; the sample's odds are set to the table's."""
    sample, share = labelled_sample(docs, labels, "quality", per_class)
    schema = pa.schema([("key", pa.int64()), ("x", pa.list_(pa.float64())), ("y", pa.int32())])

    def measure(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keys, texts, labels_ = (c.to_pylist() for c in batch.columns)
            yield C.arrow_batch(schema, [(k, statistics(t or ""), y) for k, t, y in zip(keys, texts, labels_, strict=True)])

    # At most 2 * per_class rows of a few numbers.
    rows = sample.select(F.xxhash64("doc_id").alias("key"), "text", F.col("label").cast("int").alias("label")).mapInArrow(measure, "key long, x array<double>, y int").collect()
    rows.sort(key=lambda r: r["key"])
    y = np.array([r["y"] for r in rows], float)
    share = min(max(share, 1e-6), 1 - 1e-6)
    if len(set(y)) < 2:
        none = np.zeros(1, np.int64)
        return Forest(none, np.zeros(1), none, none, np.zeros(1), none, 0, math.log(share / (1 - share)))
    forest = fit_forest(np.array([r["x"] for r in rows]), y)
    forest.start += math.log(share / (1 - share)) - math.log(y.mean() / (1 - y.mean()))
    return forest


def score_quality(docs: DataFrame, forest: Forest, name: str = "score") -> DataFrame:
    """``docs`` with the column ``name``, which replaces one of that name."""
    C.limit_batches(docs.sparkSession)
    docs = docs.drop(name)
    at = docs.columns.index("text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            x = np.array([statistics(t or "") for t in batch.column(at).to_pylist()]).reshape(-1, len(FEATURES))
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(forest.probability(x))], names=[*batch.schema.names, name])

    return docs.mapInArrow(run, C.schema_with(docs, **{name: "double"}))


def op8_quality(spark, sf_dir: str) -> DataFrame:
    docs = C.documents(spark, sf_dir)
    forest = learn(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))
    scored = score_quality(docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text"), forest)
    return scored.select("doc_id", (C.fold("doc_id", 5) == 0).alias("held_out"), "score", (F.col("score") >= 0.3).cast("int").alias("predicted"))
