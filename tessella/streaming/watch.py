"""Continuous re-planning: a folder of SQL files as a stream; each batch of changes plans anew against a base state."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from ..ddl import checks
from ..plans import api
from ..sources import readers


def watch(spark: SparkSession, path: str, base: DataFrame, emit: Callable[[DataFrame, int], None], checkpoint: str, once: bool = False) -> StreamingQuery:
    """Whenever files arrive under ``path``, plan from ``base`` to the folder's state and hand the plan over.

    The trigger debounces: files that arrive while a batch runs make one next batch.
    """
    stream = spark.readStream.option("recursiveFileLookup", True).option("pathGlobFilter", "*.sql").option("wholetext", True).text(path)

    def replan(_: DataFrame, number: int) -> None:
        emit(api.plan(base, readers.objects_of(readers.sql_directory(spark, path))), number)

    writer = stream.writeStream.foreachBatch(replan).option("checkpointLocation", checkpoint)
    return (writer.trigger(availableNow=True) if once else writer.trigger(processingTime="1 second")).start()


def check_stream(spark: SparkSession, path: str) -> DataFrame:
    """A streaming table of statement facts of arriving files: stateless, to be written wherever findings go."""
    files = spark.readStream.option("pathGlobFilter", "*.sql").option("wholetext", True).text(path).select(F.col("_metadata.file_path").alias("file"), F.col("value").alias("sql"))
    return checks.facts(checks.statements(files))
