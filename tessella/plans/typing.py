"""Types of view columns: views are analysed by Spark over empty tables of the described shape, in order of dependence."""

from __future__ import annotations

import re

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import types as T

from ..ddl.tokens import Cursor, tokens
from ..functions.text import TYPE_ALIASES

# PostgreSQL type names and the Spark types that hold their values.
SPARK_TYPES = {
    "smallint": "smallint", "integer": "int", "bigint": "bigint", "real": "float", "double precision": "double", "numeric": "decimal(38,18)", "boolean": "boolean", "text": "string", "character varying": "string", "character": "string",
    "uuid": "string", "citext": "string", "name": "string", "bytea": "binary", "date": "date", "timestamp": "timestamp_ntz", "timestamp without time zone": "timestamp_ntz", "timestamp with time zone": "timestamp", "json": "variant",
    "jsonb": "variant", "interval": "string", "time": "string", "vector": "array<float>",
}


def spark_type(name: str) -> str:
    """The Spark type for a PostgreSQL type name; what is not known is text."""
    low = re.sub(r"\s+", " ", name.strip().lower())
    depth = low.count("[]")
    base, mods = re.fullmatch(r"([^(\[]*?)\s*(\([^)]*\))?\s*(?:\[\])*", low).groups()
    base = TYPE_ALIASES.get(base, base)
    found = f"decimal{mods.replace(' ', '')}" if base == "numeric" and mods else SPARK_TYPES.get(base, "string")
    return "array<" * depth + found + ">" * depth


def view_columns(spark: SparkSession, columns: DataFrame, views: dict[str, str]) -> tuple[dict[str, T.StructType], dict[str, str]]:
    """Schemas of ``views`` (name: SELECT) over ``columns`` (table_name, column_name, type, position); and what cannot be typed, with why.

    The catalog is small: one row per column.  Views may build on each other in any order.
    """
    from pyspark.errors import AnalysisException, ParseException

    shapes: dict[str, list[tuple[int, str, str]]] = {}
    for r in columns.collect():
        shapes.setdefault(r["table_name"], []).append((r["position"], r["column_name"], spark_type(r["type"])))
    for table, cols in shapes.items():
        ddl = ", ".join(f"`{name}` {kind}" for _, name, kind in sorted(cols))
        spark.createDataFrame([], ddl).createOrReplaceTempView(table.replace(".", "__"))
    known = set(shapes)
    typed: dict[str, T.StructType] = {}
    failed: dict[str, str] = {}
    waiting = dict(views)
    while waiting:
        progress = False
        for name, sql in list(waiting.items()):
            text = sql
            for table in sorted(known | set(typed), key=len, reverse=True):
                text = re.sub(rf"(?<![\w.]){re.escape(table)}(?![\w.])", table.replace(".", "__"), text)
            try:
                frame = spark.sql(text)
            except (AnalysisException, ParseException) as e:
                failed[name] = str(e).splitlines()[0][:200]
                continue
            typed[name] = frame.schema
            frame.createOrReplaceTempView(name.replace(".", "__"))
            failed.pop(name, None)
            del waiting[name]
            progress = True
        if not progress:
            break
    return typed, failed


def is_updatable(select: str) -> bool:
    """Whether rows of the view are rows of one table: one FROM item, no grouping, set operation, limit, window or aggregate."""
    parts = list(tokens(select))
    words = [t.low for t in parts if t.kind == "word"]
    if not words or words[0] != "select":
        return False
    if set(words) & {"distinct", "group", "having", "limit", "offset", "union", "intersect", "except", "join", "over", "with"}:
        return False
    calls = {a.low for a, b in zip(parts, parts[1:], strict=False) if a.kind == "word" and b.text == "("}
    if calls & {"count", "sum", "avg", "min", "max", "array_agg", "string_agg", "json_agg", "jsonb_agg", "bool_and", "bool_or", "unnest", "generate_series"}:
        return False
    at = next((i for i, t in enumerate(parts) if t.low == "from"), None)
    if at is None:
        return False
    c = Cursor(parts[at + 1 :])
    if not c.name()[1]:
        return False
    if c.peek() not in ("", "where", "order", ","):
        c.take("as")
        c.name()
    return c.peek() in ("", "where", "order")
