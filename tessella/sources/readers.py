"""Sources of definition text and of saved states, by prefix: ``dir:``, ``git:``, ``dump:``, ``catalog:``, ``database:``,
``migrations:`` and ``empty:``.
"""

from __future__ import annotations

import subprocess
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..ddl.replay import OBJECTS, replay_histories
from ..operators import pgcatalog
from . import pg_views

FILES = "file string, sql string"
BOOTSTRAP = "_bootstrap"
FORMAT_VERSION = 1
# Fixed value: what marks the lineage line in a migration's head.
LINEAGE_MARK = "-- lineage:"
HEAD = 4096


def sql_directory(spark: SparkSession, path: str, bootstrap: bool = False) -> DataFrame:
    """(file, sql) of all .sql files below a folder, or of those in its bootstrap folder, which Spark hides otherwise."""
    reader = spark.read.option("recursiveFileLookup", True).option("pathGlobFilter", "*.sql")
    rows = reader.text(f"{path.rstrip('/')}/{BOOTSTRAP}" if bootstrap else path, wholetext=True)
    return rows.select(F.col("_metadata.file_path").alias("file"), F.col("value").alias("sql"))


def dump(spark: SparkSession, path: str) -> DataFrame:
    """One SQL text as one file."""
    return spark.read.text(path, wholetext=True).select(F.col("_metadata.file_path").alias("file"), F.col("value").alias("sql"))


def git(spark: SparkSession, ref: str, path: str = ".", repository: str = ".") -> DataFrame:
    """(file, sql) at a commit; INDEX reads what is staged."""
    run = lambda *a: subprocess.run(["git", "-C", repository, *a], capture_output=True, text=True, check=True).stdout
    if ref.startswith("-"):
        raise ValueError("a ref does not begin with a dash")
    listing = run("ls-files", "--", path) if ref == "INDEX" else run("ls-tree", "-r", "--name-only", ref, "--", path)
    prefix = "" if ref == "INDEX" else ref
    names = sorted(n for n in listing.splitlines() if n.endswith(".sql") and f"/{BOOTSTRAP}/" not in f"/{n}")
    return spark.createDataFrame([(n, run("show", f"{prefix}:{n}")) for n in names], FILES)


def objects_of(files: DataFrame, history: str = "current") -> DataFrame:
    """The objects that (file, sql) define, in order of files."""
    return replay_histories(files.withColumn("history", F.lit(history)))


def empty(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame([], OBJECTS)


def write_catalog(objects: DataFrame, path: str) -> None:
    """A saved state: JSON lines with the format's version on each."""
    objects.withColumn("format_version", F.lit(FORMAT_VERSION)).write.mode("overwrite").json(path)


def catalog(spark: SparkSession, path: str) -> DataFrame:
    """A saved state; rows that are no objects are left out, and another format is an error."""
    rows = spark.read.schema(OBJECTS + ", format_version int").json(path)
    checked = rows.where("key IS NOT NULL AND kind IS NOT NULL AND hash IS NOT NULL")
    other = F.raise_error(F.concat(F.lit("format version "), F.col("format_version").cast("string"), F.lit(f" is not {FORMAT_VERSION}")))
    ok = F.when(F.col("format_version") == FORMAT_VERSION, F.col("hash")).otherwise(other.cast("string"))
    return checked.withColumn("hash", ok).drop("format_version")


def database(spark: SparkSession, url: str, **options: str) -> DataFrame:
    """The objects of a live database, out of its system catalogs over JDBC; the driver must be on the class path."""
    return pgcatalog.state(pg_views.database(spark, url, **options))


def migrations(spark: SparkSession, path: str, history: str = "migrations") -> DataFrame:
    return objects_of(sql_directory(spark, path), history)


def migration_files(spark: SparkSession, path: str, excluded: DataFrame | None = None) -> DataFrame:
    """(file, name, version, concurrent) of migration files; ``excluded`` (file) is left out."""
    name = F.element_at(F.split("file", "/"), -1)
    rows = sql_directory(spark, path).select("file", name.alias("name"), F.nullif(F.regexp_extract(name, "^([0-9]{8,})", 1), F.lit("")).alias("version"), F.lower("sql").contains("concurrently").alias("concurrent"))
    return rows if excluded is None else rows.join(excluded, "file", "left_anti")


def lineage(spark: SparkSession, path: str) -> DataFrame:
    """(file, version, from_fp, to_fp, format) from the lineage line in each file's head."""
    head = F.substring("sql", 1, HEAD)
    line = F.regexp_extract(head, f"(?m)^{LINEAGE_MARK}[ ]*(.*)$", 1)
    bag = F.str_to_map(line, F.lit("\\s+"), F.lit("="))
    rows = sql_directory(spark, path).where(head.contains(LINEAGE_MARK)).withColumn("bag", bag)
    name = F.element_at(F.split("file", "/"), -1)
    return rows.select("file", F.regexp_extract(name, "^([0-9]{8,})", 1).alias("version"), F.col("bag")["from"].alias("from_fp"), F.col("bag")["to"].alias("to_fp"), F.try_to_number(F.col("bag")["format"], F.lit("999")).cast("int").alias("format"))


def applied_versions(spark: SparkSession, path: str) -> DataFrame:
    """A history table saved as Parquet; no table is an empty history."""
    from pyspark.errors import AnalysisException

    try:
        return spark.read.parquet(path).select(F.col("version").cast("string").alias("version"))
    except AnalysisException:
        return spark.createDataFrame([], "version string")


def append_history(known: DataFrame, new: DataFrame) -> DataFrame:
    """What an insert that skips known versions would add."""
    return new.select("version").distinct().join(known, "version", "left_anti")


REPORT = "file string, score int, grade string, errorCount int, warningCount int, diagnostics array<struct<code string, severity string, message string>>"


def scan_reports(spark: SparkSession, path: str) -> DataFrame:
    """Saved scan reports; documents that are no reports are left out."""
    return spark.read.schema(REPORT).option("multiLine", True).json(path).where("score IS NOT NULL AND grade IS NOT NULL")


CONTRACT = "schemas map<string, struct<enums: array<struct<name: string, values: array<string>>>, tables: array<struct<name: string, columns: array<struct<name: string, type: string, nullable: boolean>>>>>>"


def contract(spark: SparkSession, path: str) -> DataFrame:
    """An exported type contract as (table_name, column_name, type, not_null); a document of another shape fails."""
    rows = spark.read.text(path, wholetext=True).select(F.from_json("value", CONTRACT, {"mode": "FAILFAST"}).alias("c"))
    tables = rows.select(F.explode("c.schemas").alias("schema", "s")).select("schema", F.explode("s.tables").alias("t"))
    return tables.select("schema", "t.name", F.explode("t.columns").alias("col")).select(F.concat_ws(".", "schema", "name").alias("table_name"), F.col("col.name").alias("column_name"), F.col("col.type").alias("type"), (~F.col("col.nullable")).alias("not_null"))


SOURCES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "dir": lambda spark, payload: objects_of(sql_directory(spark, payload)),
    "git": lambda spark, payload: objects_of(git(spark, *payload.split(":", 1)) if ":" in payload else git(spark, payload)),
    "dump": lambda spark, payload: objects_of(dump(spark, payload)),
    "catalog": catalog,
    "database": database,
    "migrations": migrations,
    "empty": lambda spark, _: empty(spark),
}


def read_source(spark: SparkSession, source: str) -> DataFrame:
    """``prefix:payload`` through its reader."""
    prefix, _, payload = source.partition(":")
    if prefix not in SOURCES:
        raise ValueError(f"unknown source {prefix!r}; known are {', '.join(SOURCES)}")
    return SOURCES[prefix](spark, payload)
