"""Static checks of migration statements, as filters over a table of facts."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators import sequence
from ..operators.graph import materialise
from .facts import GUARDED_BY_EXISTS, GUARDED_BY_REPLACE, read_tokens
from .tokens import Token, split_statements, split_tokens, tokens

STATEMENTS = "file string, idx long, byte_start long, text string"
FACTS = (
    "file string, idx long, byte_start long, text string, verb string, kind string, key string, identity string, table_identity string, guarded boolean, replace boolean, cascade boolean, concurrent boolean, "
    "definer boolean, search_path string, actions array<string>, added_label string, unvalidated boolean, volatile_default boolean, needs_default boolean, dropped_columns array<string>, dependencies array<string>"
)
# Functions whose result differs from row to row.
VOLATILE = ("random", "clock_timestamp", "gen_random_uuid", "uuid_generate_v4", "nextval", "timeofday")


def statements(files: DataFrame) -> DataFrame:
    """``files`` (file, sql) to one row per statement."""

    def run(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for part in parts:
            rows = [(f, i, at, text) for f, sql in zip(part["file"], part["sql"].fillna(""), strict=True) for i, (at, text) in enumerate(split_statements(sql))]
            yield pd.DataFrame(rows, columns=["file", "idx", "byte_start", "text"])

    return files.select("file", "sql").mapInPandas(run, STATEMENTS)


def _row(parts: list[Token]) -> tuple:
    f = read_tokens(parts)
    commands = f.detail.get("commands", []) if f.verb == "alter" else []
    added = [c["column"] for c in commands if c["action"] == "add column" and c.get("column")]
    return (
        f.verb, f.kind, f.key, f.identity if f.name else None, f"{f.schema}.{f.table}" if f.table else None, f.guarded, f.replace, f.cascade, f.concurrent,
        bool(f.detail.get("definer")), f.detail.get("search_path"), [c["action"] for c in commands], next((c["value"] for c in commands if c["action"] == "add value"), None),
        any(c["action"] == "add constraint" and not c["not_valid"] for c in commands), any(x["default"] and any(v in x["default"] for v in VOLATILE) for x in added),
        any(x["not_null"] and x["default"] is None and x["identity"] is None for x in added), [c["column"] for c in commands if c["action"] == "drop column"], f.dependencies,
    )


def facts(rows: DataFrame) -> DataFrame:
    """Statements with their facts."""
    names = [c.split()[0] for c in FACTS.split(", ")][4:]

    def run(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for part in parts:
            found = pd.DataFrame([_row(list(tokens(t))) for t in part["text"]], columns=names)
            yield pd.concat([part.reset_index(drop=True), found], axis=1)

    return rows.mapInPandas(run, FACTS)


# Arrow's types of the columns of FACTS.
_ARROW = {"string": pa.string(), "long": pa.int64(), "boolean": pa.bool_(), "array<string>": pa.list_(pa.string())}
# Statements in a batch of facts.
BATCH = 20_000


def file_facts(files: DataFrame) -> DataFrame:
    """``facts`` of the ``statements`` of files (file, sql), from one reading of each text.

    Reading takes long beside the bytes of a table, so files are dealt anew however few tasks they come in.
    """
    schema = pa.schema([(name, _ARROW[kind]) for name, kind in (c.split() for c in FACTS.split(", "))])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        batch = lambda rows: pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), schema.types, strict=True)], schema=schema)
        rows: list[tuple] = []
        for b in batches:
            for file, sql in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
                for i, (at, text, parts) in enumerate(split_tokens(sql or "")):
                    rows.append((file, i, at, text, *_row(parts)))
                    if len(rows) == BATCH:
                        yield batch(rows)
                        rows = []
        if rows:
            yield batch(rows)

    return files.select(F.col("file").cast("string"), "sql").repartition("file").mapInArrow(run, FACTS)


def _found(rows: DataFrame, code: str, severity: str, message: str) -> DataFrame:
    return rows.select(F.lit(code).alias("code"), F.lit(severity).alias("severity"), "file", F.col("idx").cast("long").alias("idx"), F.coalesce("key", F.lit("")).alias("subject"), F.lit(message).alias("message"))


def intents(f: DataFrame) -> DataFrame:
    """(file, idx, intent, key, column_name) that a history states: drops of objects and columns, changes of rows, blocks, enum labels."""
    one = lambda rows, intent, column: rows.select("file", "idx", F.lit(intent).alias("intent"), "key", column.cast("string").alias("column_name"))
    none = F.lit(None)
    return (
        one(f.where("verb = 'drop'"), "drop", none)
        .unionByName(one(f.where("size(dropped_columns) > 0").withColumn("_c", F.explode("dropped_columns")), "drop_column", F.col("_c")))
        .unionByName(one(f.where(F.col("verb").isin("insert", "update", "delete")), "rows", none))
        .unionByName(one(f.where("verb = 'do'"), "block", none))
        .unionByName(one(f.where("added_label IS NOT NULL"), "add_label", F.col("added_label")))
    )


def silent_column_drops(f: DataFrame) -> DataFrame:
    """(key, column_name) of dropped columns for which no file both drops them and changes rows of their table, or runs a block."""
    found = intents(f)
    drops = found.where("intent = 'drop_column'").select("file", "key", "column_name")
    rows, blocks = found.where("intent = 'rows'").select("file", "key").distinct(), found.where("intent = 'block'").select("file").distinct()
    told = drops.join(rows, ["file", "key"], "left_semi").unionByName(drops.join(blocks, "file", "left_semi"))
    return drops.select("key", "column_name").distinct().join(told.select("key", "column_name"), ["key", "column_name"], "left_anti")


def check_statements(f: DataFrame, split_concurrent: bool = True) -> DataFrame:
    """(code, severity, file, idx, subject, message) of all checks over a table of facts, which are made once for all of them."""
    f = materialise(f)
    has = lambda action: F.array_contains("actions", action)
    create, drop, verb, kind = F.col("verb") == "create", F.col("verb") == "drop", F.col("verb"), F.col("kind")
    guarded = F.col("guarded") | F.col("replace")
    replaced = sequence.missing_guard(f, "file", "idx", create & kind.isin("policy", "trigger") & ~F.col("replace"), F.col("guarded") & drop & kind.isin("policy", "trigger"))
    created = f.where(create & kind.isin("table", "view", "materialized-view")).select("file", "idx", "identity")
    uses = f.where(~drop).select("file", "idx", "key", F.explode("dependencies").alias("identity"))
    early = sequence.forward_references(uses, created, "file", "identity", "idx").withColumn("key", F.col("identity"))
    labels = f.where("added_label IS NOT NULL").select("file", "idx", F.col("added_label").alias("label"))
    later = f.where(F.col("text").contains("'")).join(labels.withColumnsRenamed({"idx": "_added"}), "file").where((F.col("idx") > F.col("_added")) & F.col("text").contains(F.concat(F.lit("'"), "label", F.lit("'"))) & F.col("added_label").isNull())
    routines = f.where(create & kind.isin("function", "procedure"))
    closed = f.where((verb == "revoke") & F.lower("text").rlike(r"\bfrom\s+public\b")).select("file", F.col("identity").alias("_closed"))
    open_ = routines.join(closed, (routines["file"] == closed["file"]) & (routines["identity"] == closed["_closed"]), "left_anti")
    concurrent = "warning" if split_concurrent else "error"
    rules = [
        (f.where(create & kind.isin(*GUARDED_BY_EXISTS) & ~guarded), "C01", "error", "created without IF NOT EXISTS"),
        (f.where(create & kind.isin("type", "enum", "domain")), "C02", "error", "types cannot be guarded; use a DO block"),
        (f.where(create & kind.isin(*GUARDED_BY_REPLACE) & ~guarded), "C03", "error", "created without OR REPLACE"),
        (replaced, "C05", "error", "a policy or trigger must directly follow its DROP IF EXISTS"),
        (f.where("concurrent"), "C06", concurrent, "runs outside a transaction"),
        (f.where((verb == "insert") & ~F.col("guarded")), "C07", "error", "INSERT without ON CONFLICT"),
        (f.where(verb.isin("update", "delete", "truncate")), "C08", "warning", "changes rows; review"),
        (f.where(drop & F.col("cascade")), "C09", "error", "DROP ... CASCADE"),
        (f.where(drop & ~F.col("guarded")), "C10", "error", "DROP without IF EXISTS"),
        (f.where((verb == "set") & F.lower("text").rlike(r"\bsearch_path\b")), "C11", "warning", "sets the session's search_path"),
        (f.where("unvalidated"), "C12", "warning", "a constraint that scans the table; add it NOT VALID first"),
        (f.where(has("set type")), "C13", "warning", "rewrites the table"),
        (sequence.missing_guard(f, "file", "idx", has("set not null"), has("validate constraint")), "C14", "warning", "SET NOT NULL scans the table"),
        (f.where("volatile_default"), "C15", "warning", "a volatile default rewrites the table"),
        (f.where("needs_default"), "C16", "error", "a NOT NULL column without default"),
        (early, "C17", "error", "refers to what is created later"),
        (later, "C18", "error", "uses an enum label added in the same transaction"),
        (open_, "C19", "warning", "PUBLIC may execute it; revoke"),
        (routines.where(F.col("definer") & F.col("search_path").isNull()), "C20", "error", "SECURITY DEFINER without search_path"),
    ]
    out = None
    for rows, code, severity, message in rules:
        found = _found(rows, code, severity, message)
        out = found if out is None else out.unionByName(found)
    return out

