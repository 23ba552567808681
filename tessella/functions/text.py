"""Scalar expressions on text: names, versions, white space, secrets."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Shapes of secrets, and what replaces them.
SECRETS = (
    (r"(?i)(postgres(?:ql)?://[^:/\s]+:)[^@\s]+@", "$1***@"),
    (r"(?i)((?:password|passwd|pwd|secret|token|api[_-]?key)\s*[=:]\s*)[^\s&;,'\"]+", "$1***"),
    (r"\beyJ[A-Za-z0-9_-]{8,}\.[A-Za-z0-9_-]{8,}\.[A-Za-z0-9_-]*", "***"),
)
# Type names and their aliases.
TYPE_ALIASES = {
    "int2": "smallint", "int4": "integer", "int": "integer", "int8": "bigint", "float4": "real", "float8": "double precision", "bool": "boolean", "varchar": "character varying",
    "bpchar": "character", "decimal": "numeric", "timestamptz": "timestamp with time zone", "timetz": "time with time zone",
}


def collapse(text: Column) -> Column:
    return F.trim(F.regexp_replace(text, r"[ \t\n\r\f]+", " "))


def slug(text: Column, width: int = 60) -> Column:
    """Lower case, runs of other characters as one underscore, none at either end, cut."""
    plain = F.regexp_replace(F.regexp_replace(F.lower(text), "[^a-z0-9]+", "_"), "^_+|_+$", "")
    return F.regexp_replace(F.substring(plain, 1, width), "_+$", "")


def version_prefix(name: Column) -> Column:
    """The leading digits of a file name, eight at least; null without."""
    found = F.regexp_extract(name, "^([0-9]{8,})", 1)
    return F.when(found != "", found)


def redact(text: Column) -> Column:
    for pattern, replacement in SECRETS:
        text = F.regexp_replace(text, pattern, replacement)
    return text


def quote_name(name: Column) -> Column:
    """A name as SQL needs it: quoted unless it is a plain lower-case one."""
    return F.when(name.rlike("^[a-z_][a-z0-9_$]*$"), name).otherwise(F.concat(F.lit('"'), F.replace(name, F.lit('"'), F.lit('""')), F.lit('"')))


def canonical_type(name: Column) -> Column:
    """A type's full name, its modifiers kept."""
    base = F.trim(F.regexp_extract(F.lower(name), r"^([a-z0-9_ ]+?)\s*(\(.*\))?(\[\])*$", 1))
    rest = F.regexp_extract(F.lower(name), r"(\(.*\))?((?:\[\])*)$", 0)
    aliases = F.create_map(*(F.lit(x) for kv in TYPE_ALIASES.items() for x in kv))
    return F.concat(F.coalesce(aliases[base], base), rest)


def normal_sql(text: Column) -> Column:
    """Line ends as one kind, no blanks at line ends, one empty line in a row at most, no final semicolon."""
    for pattern, replacement in ((r"\r\n?", "\n"), (r"[ \t]+\n", "\n"), (r"\n{3,}", "\n\n"), (r"[\s;]+$", "")):
        text = F.regexp_replace(text, pattern, replacement)
    return text


def stable_json(bag: Column) -> Column:
    """JSON of a map with its keys in order."""
    return F.to_json(F.map_from_entries(F.array_sort(F.map_entries(bag))))


def json_depth(text: Column) -> Column:
    """How deep brackets nest outside strings."""
    marks = F.regexp_replace(F.regexp_replace(text, r'"(?:[^"\\]|\\.)*"', ""), r"[^\[\]{}]", "")
    start = F.struct(F.lit(0).alias("now"), F.lit(0).alias("most"))

    def step(acc, c):
        now = acc["now"] + F.when(c.isin("[", "{"), 1).otherwise(-1)
        return F.struct(now.alias("now"), F.greatest(acc["most"], now).alias("most"))

    return F.aggregate(F.filter(F.split(marks, ""), lambda c: c != ""), start, step, lambda acc: acc["most"])


def intake_problem(document: Column, required: tuple[str, ...] = (), depth: int = 64) -> Column:
    """Why a JSON document is refused, or null: not an object, too deep, a key missing, or text that looks like a secret."""
    problem = F.when(F.try_parse_json(document).isNull() | ~F.trim(document).startswith("{"), "no object").when(json_depth(document) > depth, "too deep")
    for key in required:
        problem = problem.when(F.get_json_object(document, f"$.{key}").isNull(), f"no {key}")
    for pattern, _ in SECRETS:
        problem = problem.when(document.rlike(pattern), "secret")
    return problem
