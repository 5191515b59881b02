"""Documents as a stream, and the state of projects from their messages."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quarry.sources.documents import documents

#: Fixed states of a project, and the state that each message leads to.
NEXT = {"open": "Unloaded", "load": "Loading", "loaded": "Ready", "change": "Stale", "fail": "Error", "close": "Unloaded"}


def document_stream(spark: SparkSession, path: str, glob: str = "*.json") -> DataFrame:
    """``documents`` of the files that appear under ``path``, each once, by the same columns as the batch scan."""
    stream = spark.readStream.option("wholetext", True).option("pathGlobFilter", glob).schema("value string").format("text").load(path)
    return documents(stream.select(F.col("_metadata.file_path").alias("path"), F.col("value").alias("content")))


def project_states(messages: DataFrame) -> DataFrame:
    """``(project, state, since, n)`` from ``messages(project, message, ts)``: the last message decides; unknown ones don't.

    An ordinary aggregation, so it serves batches and (in update or complete mode) streams alike: the fold over a
    project's messages depends on the last known one alone.
    """
    to = F.element_at(F.create_map(*[F.lit(x) for pair in NEXT.items() for x in pair]), F.col("message"))
    known = messages.withColumn("__to", to).where(F.col("__to").isNotNull())
    return known.groupBy("project").agg(F.max_by("__to", "ts").alias("state"), F.max("ts").alias("since"), F.count("*").alias("n"))
