"""Grouped reports: counts, findings, scores, fingerprints."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

# Penalties and grade bounds.
ERROR_COST, WARNING_COST = 10, 3
GRADES = (("A", 90), ("B", 80), ("C", 70), ("D", 60), ("F", 0))


def count_by(rows: DataFrame, column: str, missing: str = "-") -> DataFrame:
    return rows.groupBy(F.coalesce(F.col(column), F.lit(missing)).alias(column)).agg(F.count("*").alias("n"))


def collapse_space(text: Column) -> Column:
    return F.regexp_replace(F.trim(F.regexp_replace(text, "[ \t\n\r\f]+", " ")), "^ | $", "")


def findings_rollup(findings: DataFrame) -> DataFrame:
    """Per code: how many, and its first severity."""
    rows = findings.where("severity IN ('error', 'warning')")
    return rows.groupBy("code").agg(F.count("*").alias("n"), F.min_by("severity", "seq").alias("severity"))


def top_samples(findings: DataFrame, n: int = 5, width: int = 120) -> DataFrame:
    """(code, samples): the first ``n`` messages of each code, white space collapsed, cut and joined."""
    rows = findings.where("severity IN ('error', 'warning')").withColumn("sample", F.substring(collapse_space(F.col("message")), 1, width)).where("sample <> ''")
    # min_by with a count keeps n per group without sorting whole groups in one array.
    place = F.row_number().over(Window.partitionBy("code").orderBy("seq"))
    kept = rows.withColumn("_n", place).where(F.col("_n") <= n)
    listed = F.array_sort(F.collect_list(F.struct("_n", "sample")))
    return kept.groupBy("code").agg(F.array_join(F.transform(listed, lambda s: s["sample"]), " | ").alias("samples"))


def grade(score: Column) -> Column:
    out = F.when(score >= GRADES[0][1], GRADES[0][0])
    for name, bound in GRADES[1:]:
        out = out.when(score >= bound, name)
    return out


def scan_scores(findings: DataFrame, by: str = "file", error_cost: int = ERROR_COST, warning_cost: int = WARNING_COST) -> DataFrame:
    """(by, errors, warnings, score, grade)."""
    counted = findings.groupBy(by).agg(F.count_if(F.col("severity") == "error").alias("errors"), F.count_if(F.col("severity") == "warning").alias("warnings"))
    score = F.greatest(F.lit(0).cast("long"), 100 - error_cost * F.col("errors") - warning_cost * F.col("warnings"))
    return counted.withColumn("score", score).withColumn("grade", grade(F.col("score")))


def grade_histogram(scores: DataFrame) -> DataFrame:
    """Every grade with its number of reports, zero included."""
    names = scores.sparkSession.createDataFrame([(g,) for g, _ in GRADES], "grade string")
    counted = scores.groupBy("grade").agg(F.count("*").alias("_n"))
    return F.broadcast(names).join(counted, "grade", "left").select("grade", F.coalesce("_n", F.lit(0)).cast("long").alias("n"))


def score_stats(scores: DataFrame) -> DataFrame:
    return scores.agg(F.count("*").alias("n"), F.round(F.avg("score"), 6).alias("average"), F.median("score").alias("median"), F.min("score").alias("least"), F.max("score").alias("most"))


def diagnostic_counts(findings: DataFrame) -> DataFrame:
    return findings.groupBy("severity", "code").agg(F.count("*").alias("n"))


def repeats(findings: DataFrame, text: Column) -> DataFrame:
    """Equal texts once, with their number and the place of the first."""
    return findings.groupBy(text.alias("text")).agg(F.count("*").alias("n"), F.min("seq").alias("first_seq"))


def duplicates(rows: DataFrame, keys: list[str]) -> DataFrame:
    return rows.groupBy(*keys).agg(F.count("*").alias("n")).where("n > 1")


def fingerprint(rows: DataFrame, by: list[str], key: str = "key", digest: str = "hash") -> DataFrame:
    """Per group the sha256 of its 'key=hash' lines in order of keys.  One string per group: group by what bounds it."""
    line = F.concat(F.col(key), F.lit("="), F.col(digest))
    return rows.groupBy(*by).agg(F.sha2(F.array_join(F.array_sort(F.collect_list(line)), "\n"), 256).alias("fingerprint"))


def bag_fingerprint(rows: DataFrame, key: str = "key", digest: str = "hash") -> DataFrame:
    """An order-free fingerprint of a whole table: sums of row hashes, combined on the map side; its size does not grow."""
    h = [F.xxhash64(F.lit(salt), key, digest).cast("decimal(38,0)") for salt in (1, 2)]
    sums = rows.agg(F.count("*").alias("n"), *(F.sum(x).alias(f"s{i}") for i, x in enumerate(h)))
    return sums.select(F.sha2(F.concat_ws(",", "n", "s0", "s1"), 256).alias("fingerprint"))


def precision_recall(manifest: DataFrame, emitted: DataFrame, key: str, destructive: str) -> DataFrame:
    """(matched, missed, excess, precision, recall, f1); what is emitted destructively is excess even if listed."""
    m = manifest.select(key, F.lit(1).alias("_m")).distinct()
    e = emitted.select(key, F.col(destructive).alias("_d"), F.lit(1).alias("_e"))
    both = m.join(e, key, "full_outer")
    listed = F.col("_m").isNotNull() & F.col("_e").isNotNull()
    ok = listed & ~F.coalesce("_d", F.lit(False))
    counts = both.agg(F.count_if(ok).alias("matched"), F.count_if(F.col("_m").isNotNull() & F.col("_e").isNull()).alias("missed"), F.count_if(F.col("_e").isNotNull() & ~ok).alias("excess"))
    p = F.when(F.col("matched") + F.col("excess") == 0, 1.0).otherwise(F.col("matched") / (F.col("matched") + F.col("excess")))
    r = F.when(F.col("matched") + F.col("missed") == 0, 1.0).otherwise(F.col("matched") / (F.col("matched") + F.col("missed")))
    rated = counts.withColumn("precision", p).withColumn("recall", r)
    f1 = F.when(F.col("precision") + F.col("recall") == 0, 0.0).otherwise(2 * F.col("precision") * F.col("recall") / (F.col("precision") + F.col("recall")))
    return rated.select("matched", "missed", "excess", F.round("precision", 9).alias("precision"), F.round("recall", 9).alias("recall"), F.round(f1, 9).alias("f1"))


def units_by_version(files: DataFrame) -> DataFrame:
    """Files (version, name, concurrent) as units: transactional if none of a version's files runs concurrently."""
    names = F.array_sort(F.collect_list(F.struct("concurrent", "name")))
    return files.groupBy("version").agg(F.array_join(F.transform(names, lambda s: s["name"]), ",").alias("files"), (~F.bool_or("concurrent")).alias("transactional"))
