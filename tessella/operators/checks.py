"""CHECK predicates over rows: a row with a null passes, as in SQL constraints."""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def violations(rows: DataFrame, predicate: Column) -> DataFrame:
    return rows.where(~F.coalesce(predicate, F.lit(True)))


def counted(rows: DataFrame, **predicates: Column) -> DataFrame:
    """(check_name, violations): all checks in one pass."""
    counts = rows.agg(*(F.count_if(~F.coalesce(p, F.lit(True))).alias(name) for name, p in predicates.items()))
    stack = ", ".join(f"'{n}', `{n}`" for n in predicates)
    return counts.selectExpr(f"stack({len(predicates)}, {stack}) AS (check_name, violations)")


_NUMBER = r"[-+]?\d+(?:\.\d+)?"
_NAME = r"[a-z_][a-z0-9_]*"
_TEXT = r"'(?:[^']|'')*'"


def conjuncts(expression: str) -> list[str]:
    """Parts that AND joins outside brackets and quotes; the AND of a BETWEEN stays."""
    parts, depth, start, quoted, between = [], 0, 0, False, False
    for found in re.finditer(r"'|\(|\)|\bbetween\b|\band\b", expression, re.IGNORECASE):
        word = found.group().lower()
        if word == "'":
            quoted = not quoted
        elif quoted:
            continue
        elif word in "()":
            depth += 1 if word == "(" else -1
        elif word == "between" and depth == 0:
            between = True
        elif word == "and" and depth == 0:
            if between:
                between = False
            else:
                parts.append(expression[start : found.start()])
                start = found.end()
    parts.append(expression[start:])
    out = []
    for p in map(str.strip, parts):
        inner = re.fullmatch(r"\((.*)\)", p, re.DOTALL)
        out += conjuncts(inner.group(1)) if inner and _balanced(inner.group(1)) else [p]
    return [p for p in out if p]


def _balanced(text: str) -> bool:
    depth = 0
    for c in re.sub(_TEXT, "", text):
        depth += {"(": 1, ")": -1}.get(c, 0)
        if depth < 0:
            return False
    return depth == 0


def lower_check(expression: str) -> tuple[str | None, list[str]]:
    """A SQL predicate for the parts of a CHECK that can be told from a row, and the parts left out.

    Told are: column against number (either side), length bounds, lists of texts, BETWEEN, column against column, and a
    bare boolean column.
    """
    sound, left = [], []
    comparison = r"(<=|>=|<>|!=|=|<|>)"
    forms = (
        rf"{_NAME}\s*{comparison}\s*{_NUMBER}",
        rf"{_NUMBER}\s*{comparison}\s*{_NAME}",
        rf"(?:char_length|length)\s*\(\s*{_NAME}\s*\)\s*{comparison}\s*\d+",
        rf"{_NAME}\s+(?:not\s+)?in\s*\(\s*{_TEXT}(?:\s*,\s*{_TEXT})*\s*\)",
        rf"{_NAME}\s+between\s+{_NUMBER}\s+and\s+{_NUMBER}",
        rf"{_NAME}\s*{comparison}\s*{_NAME}",
        _NAME,
    )
    for part in conjuncts(expression):
        (sound if any(re.fullmatch(f, part, re.IGNORECASE) for f in forms) else left).append(part)
    return (" AND ".join(f"({p})" for p in sound) or None), left


def check_rows(rows: DataFrame, expression: str) -> DataFrame:
    """Rows that a CHECK would refuse, as far as it can be told."""
    predicate, _ = lower_check(expression)
    return rows.limit(0) if predicate is None else violations(rows, F.expr(predicate))
