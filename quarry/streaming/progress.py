"""Progress as JSON Lines: metrics observed while rows pass, of batches and of streams."""

from __future__ import annotations

import json
import threading
import uuid

from pyspark.sql import Column, DataFrame, Observation, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.listener import StreamingQueryListener


def decoding_metrics() -> list[Column]:
    """What a decode of documents tells: definitions, documents that can't be read, modules (as an estimate-free count of first definitions)."""
    first = (F.col("ord") == 0) & (F.col("family") == "value")
    return [F.count(F.when(F.col("error").isNull(), 1)).alias("definitions"), F.count("error").alias("errors"), F.count(F.when(first, 1)).alias("modules")]


def observed(rows: DataFrame, name: str, metrics: list[Column]) -> tuple[DataFrame, Observation]:
    """``rows`` unchanged, and metrics that are counted as they pass: known after the first action over them."""
    watch = Observation(name)
    return rows.observe(watch, *metrics), watch


def line(kind: str, **said) -> str:
    """A message: ``type`` first, as progress or result; what is None is left out."""
    return json.dumps({"type": kind} | {k: v for k, v in said.items() if v is not None}, separators=(",", ":"), default=str)


def result_lines(spark: SparkSession, watch: Observation, message: str, failing: str = "errors") -> DataFrame:
    """``(ord, line)``: a progress line with the observed metrics and a result line, successful where ``failing`` is 0."""
    got = watch.get
    return spark.createDataFrame([(0, line("progress", message=message, **got)), (1, line("result", success=got.get(failing, 0) == 0))], "ord int, line string")


class ProgressLines(StreamingQueryListener):
    """Writes a line for each micro-batch of streaming queries, and one when a query ends, each as a small file in ``folder``.

    Files are written whole and then renamed, so a reader of JSON Lines sees no half ones; the folder may be any that
    Hadoop reaches. Metrics that a stream observes come with their names. ``lines`` holds them too, the latest 1,000.
    """

    def __init__(self, spark: SparkSession, folder: str) -> None:
        self.spark, self.folder, self.lines, self.lock = spark, folder.rstrip("/"), [], threading.Lock()

    def onQueryStarted(self, event) -> None:
        self._say(str(event.id), "started", line("progress", message="started", query=event.name))

    def onQueryProgress(self, event) -> None:
        p = event.progress
        metrics = {name: row.asDict() for name, row in (p.observedMetrics or {}).items()}
        self._say(str(p.id), f"batch-{p.batchId:012d}", line("progress", message=f"batch {p.batchId}", query=p.name, rows=p.numInputRows, metrics=metrics or None))

    def onQueryIdle(self, event) -> None:
        pass

    def onQueryTerminated(self, event) -> None:
        self._say(str(event.id), "ended", line("result", success=event.exception is None, message=event.exception))

    def _say(self, query: str, what: str, said: str) -> None:
        with self.lock:
            self.lines = [*self.lines[-999:], said]
        jvm, conf = self.spark._jvm, self.spark.sparkContext._jsc.hadoopConfiguration()
        part = jvm.org.apache.hadoop.fs.Path(f"{self.folder}/_{uuid.uuid4().hex}")
        fs = part.getFileSystem(conf)
        out = fs.create(part, True)
        out.write(bytearray((said + "\n").encode()))
        out.close()
        whole = jvm.org.apache.hadoop.fs.Path(f"{self.folder}/{query}-{what}.jsonl")
        fs.delete(whole, False)
        fs.rename(part, whole)
