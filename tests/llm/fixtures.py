"""Small tables for the operators' tests, with every awkward kind of row."""

from __future__ import annotations

import random
import re
import string

WORD = re.compile(r"[^\x20\x09-\x0D]+")
LOWER = str.maketrans(string.ascii_uppercase, string.ascii_lowercase)
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"


def words(rng: random.Random, n: int, size: int = 400) -> list[str]:
    return [f"w{int(rng.paretovariate(0.7)) % size}" for _ in range(n)]


def corpus(seed: int = 1, n: int = 60) -> list[tuple]:
    """Copies, near copies, shared passages, null and empty texts, one long text, repeated rows, a row without id."""
    rng = random.Random(seed)
    passage = words(rng, 40)
    texts: list[str | None] = []
    for i in range(n):
        kind = i % 6
        if kind == 0 or not texts:
            texts.append(" ".join(words(rng, rng.randint(1, 120))))
        elif kind == 1:
            base = (texts[rng.randrange(len(texts))] or "").split()
            for _ in range(max(1, len(base) // 60)):
                if base:
                    base[rng.randrange(len(base))] = "changed"
            texts.append(" ".join(base))
        elif kind == 2:
            texts.append(texts[rng.randrange(len(texts))])
        elif kind == 3:
            texts.append(" ".join(words(rng, 30) + passage + words(rng, 20)))
        elif kind == 4:
            texts.append("Über  Straße\tNaïve x\n\n" + " ".join(words(rng, 25)).upper() + " <|endoftext|> it's ")
        else:
            texts.append(rng.choice([None, "", "   \n", "one", "one two three four"]))
    texts.append(" ".join(words(rng, 6000)))
    rows = [(i * 3 % (2 * n), t) for i, t in enumerate(texts)]
    rows = list({i: t for i, t in rows}.items())
    return rows


def frame(spark, rows):
    return spark.createDataFrame([(i, t, "en", "s", len(t or "")) for i, t in rows], SCHEMA).repartition(3)


def awkward(spark, rows):
    """The same rows with columns whose names the operators use inside."""
    from pyspark.sql import functions as F

    df = frame(spark, rows)
    for name in ("score", "places", "_places", "n_words", "kept_text", "part", "bucket", "flush", "hash", "key", "node", "train"):
        df = df.withColumn(name, F.lit("x"))
    return df


EMPTY: list[tuple] = []
