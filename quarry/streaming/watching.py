"""Watching files: bursts of changes become one event each, and only documents whose content changed are decoded again."""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quarry.functions import globs
from quarry.sources.documents import DEFINITION, definitions, documents, files

#: Fixed kinds of file events.
KINDS = ("created", "modified", "deleted", "renamed")
#: Files of one refresh that are read by one scan.
SCAN = 10_000


def settled(events: DataFrame, gap: str = "100 milliseconds", late: str = "10 seconds", ignore: Sequence[str] = ()) -> DataFrame:
    """``(path, kind, first, last, n)``: one row for each burst of events on a path, when nothing came for ``gap``.

    ``events(event_type, path, new_path, ts timestamp)`` may be a stream or a table. A session ends ``gap`` after its last
    event, so a burst gives one row however many events it has; n counts them, doubled ones once. kind is deleted where
    the last event deleted the file (or renamed it away), else modified: what to do is read the file. A rename is also an
    event of the new path. On a stream a burst is given when the watermark, ``late`` behind the newest event, passed its
    end; later events are dropped. Events of unknown kind, without path or time, and of paths that a glob of ``ignore``
    matches, are left out.
    """
    known = events.where(F.col("event_type").isin(*KINDS) & F.col("path").isNotNull() & F.col("ts").isNotNull())
    here = F.struct(F.col("path"), F.col("event_type").isin("deleted", "renamed").alias("gone"))
    there = F.struct(F.col("new_path").alias("path"), F.lit(False).alias("gone"))
    both = F.when((F.col("event_type") == "renamed") & F.col("new_path").isNotNull(), F.array(here, there)).otherwise(F.array(here))
    rows = known.select("ts", F.explode(both).alias("e")).select("ts", "e.path", "e.gone")
    for pattern in ignore:
        rows = rows.where(~globs.matches(F.col("path"), pattern))
    same = ["path", "gone", "ts"]
    rows = rows.withWatermark("ts", late).dropDuplicatesWithinWatermark(same) if events.isStreaming else rows.dropDuplicates(same)
    burst = rows.groupBy("path", F.session_window("ts", gap).alias("s")).agg(F.max_by("gone", "ts").alias("gone"), F.min("ts").alias("first"), F.max("ts").alias("last"), F.count("*").alias("n"))
    return burst.select("path", F.when(F.col("gone"), "deleted").otherwise("modified").alias("kind"), "first", "last", "n")


#: A store's row: a definition as decoded, or one row with ``gone`` or ``error``; digest tells the content it came from.
STORED = f"path string, digest string, gone boolean, {DEFINITION}"


class Store:
    """Definitions of watched documents, one folder a refresh: what changed is added, nothing is rewritten until ``compact``.

    A document's rows are those of its last refresh. A refresh that is run again writes the same folder anew, so each
    counts once. ``root`` is the folder that holds the watched files, ``at`` the store's own, both shared by all executors.
    """

    def __init__(self, spark: SparkSession, root: str, at: str) -> None:
        self.spark, self.root, self.at = spark, root.rstrip("/"), at.rstrip("/")

    def _rows(self) -> DataFrame:
        return self.spark.read.schema(f"{STORED}, refresh long").option("basePath", self.at).parquet(self.at)

    def _exists(self, before: int | None = None) -> bool:
        where = self.spark._jvm.org.apache.hadoop.fs.Path(self.at)
        fs = where.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration())
        found = [s.getPath().getName() for s in fs.listStatus(where)] if fs.exists(where) else []
        return any(n.startswith("refresh=") and (before is None or int(n[8:]) < before) for n in found)

    def current(self, before: int | None = None) -> DataFrame:
        """Each document's rows of its last refresh (of those before ``before``); documents that are gone have none."""
        if not self._exists(before):
            return self.spark.createDataFrame([], STORED)
        rows = self._rows() if before is None else self._rows().where(F.col("refresh") < before)
        last = rows.groupBy("path").agg(F.max("refresh").alias("refresh"))
        return rows.join(last, ["path", "refresh"]).where("NOT gone").drop("refresh")

    def refresh(self, changed: DataFrame, number: int) -> None:
        """Take ``changed(path, kind, last)``: the paths' files are read, and those whose content is new are decoded.

        The paths of one refresh reach the driver, ``SCAN`` at a time, to be read; contents don't. Of several rows for a
        path the last counts. A file that can't be found any more counts as deleted.
        """
        last = changed.groupBy("path").agg(F.max_by("kind", "last").alias("kind"))
        wanted = [r["path"] for r in last.where("kind <> 'deleted'").toLocalIterator()]
        found = None
        for i in range(0, len(wanted), SCAN):
            there = [p for p in (f"{self.root}/{w}" for w in wanted[i : i + SCAN]) if self._is_file(p)]
            part = files(self.spark, there) if there else None
            found = part if found is None else found if part is None else found.unionByName(part)
        if found is None:
            found = self.spark.createDataFrame([], "path string, content string")
        # A file's path as watched: what follows the root.
        found = found.select(F.substring_index(F.col("path"), f"{self._name()}/", -1).alias("path"), "content").withColumn("digest", F.sha2("content", 256))
        held = self.current(number).groupBy("path").agg(F.first("digest").alias("__held"))
        new = found.join(held, "path", "left").where(~F.col("digest").eqNullSafe(F.col("__held"))).drop("__held")
        docs = documents(new.select("path", "content"))
        rows = definitions(docs).join(docs.select("doc_id", "path"), "doc_id").join(new.select("path", "digest"), "path").withColumn("gone", F.lit(False))
        gone = last.join(found.select("path"), "path", "left_anti").join(held.where(F.col("__held").isNotNull()), "path", "left_semi").select("path", F.lit(True).alias("gone"))
        out = rows.unionByName(gone, allowMissingColumns=True)
        out.selectExpr(*[f.split()[0] for f in STORED.split(", ")]).write.mode("overwrite").parquet(f"{self.at}/refresh={number}")

    def _name(self) -> str:
        return self.root.rsplit("/", 1)[-1]

    def _is_file(self, path: str) -> bool:
        where = self.spark._jvm.org.apache.hadoop.fs.Path(path)
        fs = where.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration())
        return fs.exists(where) and fs.getFileStatus(where).isFile()

    def compact(self, number: int) -> None:
        """Write the rows of all refreshes up to ``number`` as that one; older folders can go then, and are deleted."""
        self.current().write.mode("overwrite").parquet(f"{self.at}/_compact")
        kept = self.spark.read.schema(STORED).parquet(f"{self.at}/_compact")
        kept.write.mode("overwrite").parquet(f"{self.at}/refresh={number}")
        where = self.spark._jvm.org.apache.hadoop.fs.Path(self.at)
        fs = where.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration())
        for s in fs.listStatus(where):
            name = s.getPath().getName()
            if name == "_compact" or name.startswith("refresh=") and int(name[8:]) < number:
                fs.delete(s.getPath(), True)


def watch(bursts: DataFrame, store: Store, checkpoint: str):
    """A stream's writer that refreshes ``store`` with each micro-batch of ``settled`` bursts: start it with any trigger."""
    act: Callable[[DataFrame, int], None] = lambda batch, number: None if batch.isEmpty() else store.refresh(batch, number)
    return bursts.writeStream.foreachBatch(act).option("checkpointLocation", checkpoint).outputMode("append")
