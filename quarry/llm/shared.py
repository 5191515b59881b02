"""Helpers that the training-data operators share: tables, the shared folder, word patterns, connected components."""

from __future__ import annotations

import atexit
import re
import tempfile
import uuid
import weakref
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: A word is a run of anything but ASCII white space.
WORD = r"[^\x20\x09-\x0D]+"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share: ``spark.checkpoint.dir``; where it is unset in one process (tests), a temporary one.

    On a cluster a folder of the driver's machine would not do, so there the setting is required.
    """
    found = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if not found:
        if not re.fullmatch(r"local(\[.*\])?", spark.sparkContext.master):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        found = f"file://{tempfile.mkdtemp(prefix='quarry-')}"
        spark.conf.set("spark.checkpoint.dir", found)
    return found.rstrip("/")


def scratch(spark: SparkSession, what: str) -> str:
    """A new path in the shared folder, deleted when the session's process ends."""
    path = f"{shared_dir(spark)}/quarry/{what}-{uuid.uuid4().hex}"
    atexit.register(_delete, spark, path)
    return path


def _delete(spark: SparkSession, path: str) -> None:
    jvm = spark.sparkContext._jvm
    if spark.sparkContext._jsc is not None and jvm is not None:
        where = jvm.org.apache.hadoop.fs.Path(path)
        where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(where, True)


def materialize(df: DataFrame, what: str) -> DataFrame:
    """Write ``df`` to the shared folder as Parquet and read it back: cuts the lineage and survives lost executors."""
    path = scratch(df.sparkSession, what)
    df.write.parquet(path)
    out = df.sparkSession.read.schema(df.schema).parquet(path)
    _PATHS[out] = path
    return out


_PATHS: weakref.WeakKeyDictionary[DataFrame, str] = weakref.WeakKeyDictionary()


def release(*tables: DataFrame) -> None:
    """Delete what ``materialize`` wrote for tables that nothing reads any more."""
    for df in tables:
        _delete(df.sparkSession, _PATHS.pop(df))


def n_words(text: Column) -> Column:
    """Number of words; 0 for null."""
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def unused(df: DataFrame, name: str) -> str:
    """``name``, or the first of it with underscores before that no column of ``df`` has."""
    taken = {c.lower() for c in df.columns}
    while name.lower() in taken:
        name = f"_{name}"
    return name


def components(edges: DataFrame, what: str = "components") -> DataFrame:
    """Connected components of undirected ``edges(a long, b long)``.

    Returns ``(id long, component_id long)`` for every vertex with an edge; ``component_id`` is the smallest id reachable.
    Rounds of contraction: every vertex joins the neighbour that ranks first by a hash of its id (random ranks shrink
    long chains geometrically, hot vertices are reduced by partial aggregation), and the edges are rewritten to the
    merged vertices until none is left. Only the number of remaining edges reaches the driver. Loops and repeated or
    null edges are ignored; an empty input gives an empty result.
    """
    rank = lambda c: F.struct(F.xxhash64(c).alias("r"), c.alias("v"))
    left = edges.where("a <> b").select("a", "b").distinct()
    left = materialize(left, what)
    both = left.select(F.col("a").alias("id")).union(left.select("b")).distinct()
    label = materialize(both.select("id", F.col("id").alias("c")), what)
    while not left.isEmpty():
        out = left.union(left.select("b", "a"))
        step = out.groupBy("a").agg(F.min(rank(F.col("b"))).alias("m")).select(F.col("a").alias("v"), F.least(F.col("m"), rank(F.col("a")))["v"].alias("to"))
        jump = step.alias("s").join(step.select(F.col("v").alias("to"), F.col("to").alias("far")), "to").select("v", F.col("far").alias("to"))
        step, was = materialize(jump, what), (left, label)
        label = materialize(label.join(step, label["c"] == step["v"], "left").select("id", F.coalesce("to", "c").alias("c")), what)
        for side in ("a", "b"):
            left = left.join(step.select(F.col("v").alias(side), "to"), side).drop(side).withColumnRenamed("to", side)
        left = materialize(left.where("a <> b").select("a", "b").distinct(), what)
        release(step, *was)
    least = label.groupBy("c").agg(F.min("id").alias("component_id"))
    return label.join(least, "c").select("id", "component_id")


def bounded_sample(df: DataFrame, key: str, n: int) -> DataFrame:
    """At most ``n`` rows: the first by a hash of ``key``.

    Rows whose hash lies beyond what about 4 * n rows have are dropped before the ordering, so partitions together
    send about that many rows, however many partitions there are.
    """
    share = min(1.0, 4.0 * n / max(1, df.count()))
    spot = F.xxhash64(key)
    near = df.where(spot.isNotNull() & (spot.cast("double") < -(2.0**63) + share * 2.0**64)) if share < 1 else df
    return near.orderBy(spot, key).limit(n)


def cells(df: DataFrame, key: str, id: str, count: str, block: int) -> DataFrame:
    """Deal the members of each ``key`` into pairs of blocks: adds ``cell`` (string), ``side`` (int, the row's block) and
    ``alone`` (boolean, the cell of one block).

    ``count`` holds the key's number of rows. A key of up to ``block`` rows is one cell; a larger one has
    ceil(count / block) blocks, and each row goes to the cells of its block with every other. Two rows meet where the
    cell is alone, or, if their sides differ, in the cell of both blocks: any two rows in exactly one cell, and a cell
    has about 2 * ``block`` rows at most.
    """
    blocks = F.greatest(F.ceil(F.col(count) / block).cast("int"), F.lit(1))
    df = df.withColumn("side", F.pmod(F.xxhash64(id), blocks).cast("int")).withColumn("__t", F.explode(F.sequence(F.lit(0), blocks - 1)))
    cell = F.concat_ws(":", F.col(key).cast("string"), F.least("side", "__t").cast("string"), F.greatest("side", "__t").cast("string"))
    return df.withColumn("cell", cell).withColumn("alone", F.col("side") == F.col("__t")).drop("__t")


def cells_across(df: DataFrame, key: str, id: str, group: str, block: int) -> DataFrame:
    """Deal the members of each ``key`` so that any two of different ``group`` meet: adds cell, side and alone as ``cells`` does.

    A key of up to ``block`` rows is one cell. In a larger one the strangers (rows outside the key's largest group) are
    dealt into blocks of their own, and each of these meets all rows in blocks: a row of the largest group goes to
    ceil(strangers / block) cells, not to as many as the key has blocks. Keys of one group alone are left out.
    """
    sizes = df.groupBy(key, group).agg(F.count("*").alias("__c"))
    large = sizes.groupBy(key).agg(F.sum("__c").alias("__n"), F.max("__c").alias("__l"), F.max_by(group, F.struct("__c", group)).alias("__g")).where("__n > __l")
    df = df.join(large, key).withColumn("alone", F.col("__n") <= block)
    blocks = lambda n: F.greatest(F.ceil(n / block).cast("int"), F.lit(1))
    every, few = blocks(F.col("__n")), blocks(F.col("__n") - F.col("__l"))
    mine, stranger = F.pmod(F.xxhash64(id), every), F.col(group) != F.col("__g")
    row = lambda i, j, side: F.struct(i.cast("int").alias("i"), j.cast("int").alias("j"), F.lit(side).alias("side"))
    right = F.transform(F.sequence(F.lit(0), few - 1), lambda i: row(i, mine, 1))
    left = F.transform(F.sequence(F.lit(0), every - 1), lambda j: row(F.pmod(F.xxhash64(id, F.lit(1)), few), j, 0))
    to = F.when(F.col("alone"), F.array(row(F.lit(0), F.lit(0), 0))).when(stranger, F.concat(left, right)).otherwise(right)
    df = df.withColumn("__to", F.explode(to)).withColumn("side", F.col("__to.side"))
    return df.withColumn("cell", F.concat_ws(":", F.col(key).cast("string"), "__to.i", "__to.j")).drop("__n", "__l", "__g", "__to")


def meeting(cell: np.ndarray, side: np.ndarray, alone: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """All pairs (i, j) of rows that meet, for rows sorted by cell: row i with row i + 1, then i + 2, and so on."""
    left, step = np.arange(len(cell)), 1
    while len(left):
        left = left[left + step < len(cell)]
        left = left[cell[left] == cell[left + step]]
        i = left[alone[left] | (side[left] != side[left + step])]
        if len(i):
            yield i, i + step
        step += 1


def grouped_batches(batches: Iterator[pa.RecordBatch], key: str) -> Iterator[pa.Table]:
    """Tables that hold whole groups of consecutive rows with one ``key``, many small groups at a time."""
    rest = None
    for batch in batches:
        if batch.num_rows == 0:
            continue
        rows = pa.Table.from_batches([batch])
        rows = rows if rest is None else pa.concat_tables([rest, rows])
        keys = rows.column(key)
        same = pc.equal(keys, keys[len(keys) - 1])
        cut = len(keys) - pc.sum(same).as_py()
        if cut:
            yield rows.slice(0, cut)
        rest = rows.slice(cut)
    if rest is not None:
        yield rest
