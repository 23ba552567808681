"""As-of lookups by sorting, not by a range join."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def asof_last(probes: DataFrame, events: DataFrame, keys: list[str], value: str, ordinal: str = "ordinal", width: int = 100_000) -> DataFrame:
    """``probes`` with ``value``: of the last event of the same keys at or before the probe's ordinal.

    Rows are dealt by keys and by ordinal range (``width``), so a hot key is spread; each range starts from the last event
    before it, carried over from one row per key and range.
    """
    span = F.floor(F.col(ordinal) / width)
    e = events.select(*keys, F.col(ordinal), F.col(value), span.alias("_span"))
    ends = e.groupBy(*keys, "_span").agg(F.max_by(F.struct(F.col(value)), ordinal).alias("_end"))
    extra = [c for c in probes.columns if c not in keys]
    p = probes.withColumn("_span", span)
    # Ranges with probes only need a carried value too.
    spans = ends.select(*keys, "_span", "_end").unionByName(p.select(*keys, "_span").distinct(), allowMissingColumns=True)
    spans = spans.groupBy(*keys, "_span").agg(F.max("_end").alias("_end"))
    before = Window.partitionBy(*keys).orderBy("_span").rowsBetween(Window.unboundedPreceding, -1)
    carried = spans.select(*keys, "_span", F.last("_end", ignorenulls=True).over(before).alias("_carried"))
    row = F.struct(*extra)
    both = e.select(*keys, "_span", F.col(ordinal).alias("_at"), F.lit(0).alias("_probe"), F.struct(F.col(value)).alias("_event")).unionByName(
        p.select(*keys, "_span", F.col(ordinal).alias("_at"), F.lit(1).alias("_probe"), row.alias("_row")), allowMissingColumns=True
    )
    upto = Window.partitionBy(*keys, "_span").orderBy("_at", "_probe").rowsBetween(Window.unboundedPreceding, 0)
    found = both.withColumn("_last", F.last("_event", ignorenulls=True).over(upto)).where("_probe = 1")
    joined = found.join(carried, [*keys, "_span"], "left")
    return joined.select(*keys, *(F.col(f"_row.{c}").alias(c) for c in extra), F.coalesce("_last", "_carried")[value].alias(value))


def covered(probes: DataFrame, log: DataFrame, elements: DataFrame, target: str = "target", element: str = "privilege", verb: str = "verb", ordinal: str = "ordinal", on: str = "GRANT", width: int = 100_000) -> DataFrame:
    """``probes`` (ordinal, target) with ``implied``: at that point every element's last transition is ``on``.

    No probe is multiplied by the elements: an event adds or takes 1 where it changes its element's state, and a running
    sum per target, dealt by ordinal range like ``asof_last``, is compared with their number.
    """
    before = F.lag(verb).over(Window.partitionBy(target, element).orderBy(ordinal))
    known = log.join(F.broadcast(elements.select(element).distinct()), element, "left_semi").withColumn("_before", before)
    was, now = F.coalesce(F.col("_before") == on, F.lit(False)), F.col(verb) == on
    span = F.floor(F.col(ordinal) / width).alias("_span")
    steps = known.select(target, ordinal, span, (now.cast("int") - was.cast("int")).alias("_step")).where("_step <> 0")
    asked = probes.select(target, ordinal, span)
    totals = steps.groupBy(target, "_span").agg(F.sum("_step").alias("_sum")).unionByName(asked.select(target, "_span", F.lit(0).cast("long").alias("_sum")).distinct())
    earlier = Window.partitionBy(target).orderBy("_span").rowsBetween(Window.unboundedPreceding, -1)
    carried = totals.groupBy(target, "_span").agg(F.sum("_sum").alias("_sum")).select(target, "_span", F.coalesce(F.sum("_sum").over(earlier), F.lit(0)).alias("_carried"))
    both = steps.withColumn("_probe", F.lit(0)).unionByName(asked.withColumn("_step", F.lit(0)).withColumn("_probe", F.lit(1)))
    upto = Window.partitionBy(target, "_span").orderBy(ordinal, "_probe").rowsBetween(Window.unboundedPreceding, 0)
    held = both.withColumn("_held", F.sum("_step").over(upto)).where("_probe = 1").join(carried, [target, "_span"], "left")
    size = F.broadcast(elements.select(element).distinct().agg(F.count("*").alias("_size")))
    return held.join(size, how="cross").select(ordinal, target, (F.col("_held") + F.coalesce("_carried", F.lit(0)) == F.col("_size")).alias("implied"))
