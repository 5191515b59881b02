"""Exact top-k search with a vector-approximation file: bounds from quantised cells, exact vectors in the order of the bounds."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .shared import grouped_batches, materialize, table
from .vectors import matrix, usable

K, EVERY, SCALE = 5, 50, 256
#: Cells of one dimension (a byte each in the file); most rows of a block of codes and of a block of queries.
CELLS, CANDIDATES, QUERIES = 256, 65_536, 16_384
#: A block of codes is made smaller, down to so many rows, where that gives every core some blocks.
LEAST_CANDIDATES = 1024
#: Salts by which equal vectors are dealt out before the smallest ids are found.
SALTS = 64
#: Queries whose bounds a task holds at a time; candidates a query reads before its k-th exact score is first known.
CHUNK, FIRST_READ = 128, 16


def scaled(vector: Column) -> Column:
    """floor(256 * x) of every component, x as double."""
    return F.transform(vector, lambda x: F.floor(x.cast("double") * SCALE))


def fits(vector: Column) -> Column:
    """Is a usable vector small enough that its inner product with any other such fits 64 bits, whatever the order of summing?

    The largest component, scaled, times the root of their number may be 2^31: then a product of two is 2^62 at most.
    """
    most = F.array_max(F.transform(vector, lambda x: F.abs(x.cast("double") * SCALE) + 1))
    return F.coalesce(most * F.sqrt(F.size(vector)) <= 2.0**31, F.lit(True))


class Grid:
    """Cells of equal width over the whole numbers of each dimension: cell c of a dimension holds low + c * width and the
    width - 1 numbers after it. Where a dimension has no more numbers than cells, a code tells the number."""

    def __init__(self, low: list[int], high: list[int], cells: int = CELLS) -> None:
        self.low = np.array(low, np.float64)
        self.width = np.array([max(1, -(-(b - a + 1) // cells)) for a, b in zip(low, high, strict=True)], np.float64)

    def codes(self, exact: np.ndarray) -> np.ndarray:
        full = np.zeros((len(exact), len(self.low)))
        full[:, : exact.shape[1]] = exact
        return np.floor((full - self.low) / self.width).clip(0, 255).astype(np.uint8)

    def bounds(self, codes: np.ndarray, queries: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Score of each query with the centres of each vector's cells, and how far the exact one may be from it.

        |q . v - q . centre| is at most the sum of |q_j| * (width_j - 1) / 2, which depends on the query alone; some more
        is for rounding.
        """
        centre = codes * self.width + (self.low + (self.width - 1) / 2)
        scores = queries @ centre.T
        wide = np.abs(queries) @ np.maximum(np.abs(self.low), np.abs(self.low + self.width * 256))
        return scores, np.abs(queries) @ ((self.width - 1) / 2) + wide * 1e-12 + 1e-6


def grid_of(rows: DataFrame, cells: int = CELLS) -> Grid:
    """Two numbers a dimension reach the driver, and a row of them a task is shuffled; 0 is in every range, as shorter vectors
    are filled up with it."""

    def ends(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        low, high = np.zeros(0, np.int64), np.zeros(0, np.int64)
        for b in batches:
            x = matrix(b.column("v"), np.int64)
            wide = max(len(low), x.shape[1])
            low, high = np.pad(low, (0, wide - len(low))), np.pad(high, (0, wide - len(high)))
            if len(x):
                low[: x.shape[1]], high[: x.shape[1]] = np.minimum(low[: x.shape[1]], x.min(axis=0)), np.maximum(high[: x.shape[1]], x.max(axis=0))
        yield pa.RecordBatch.from_arrays([pa.array([low.tolist()], pa.list_(pa.int64())), pa.array([high.tolist()], pa.list_(pa.int64()))], names=["low", "high"])

    parts = rows.select("v").mapInArrow(ends, "low array<long>, high array<long>")
    found = parts.select(F.posexplode(F.arrays_zip("low", "high")).alias("j", "x")).groupBy("j").agg(F.min("x.low").alias("a"), F.max("x.high").alias("b")).orderBy("j").collect()
    return Grid([r["a"] for r in found], [r["b"] for r in found], cells)


def approximation_file(rows: DataFrame, grid: Grid) -> DataFrame:
    """``(row, vec_id, codes)``, a byte for each dimension, written to the shared folder: all that the scan reads of a vector."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            codes = grid.codes(matrix(b.column("v"), np.float64))
            yield pa.RecordBatch.from_arrays([b.column("row"), b.column("vec_id"), pa.array([c.tobytes() for c in codes], pa.binary())], names=["row", "vec_id", "codes"])

    kind = rows.schema["vec_id"].dataType.simpleString()
    return materialize(rows.select("row", "vec_id", "v").mapInArrow(run, f"row long, vec_id {kind}, codes binary"), "approximation")


def scan(file: DataFrame, asked: DataFrame, grid: Grid, k: int, n: int, m: int, candidates: int, queries: int) -> DataFrame:
    """``(query_id, row, low, high)``: the rows of each block of codes that may be among a query's k best, by the block alone.

    Every block of codes meets every block of queries in one cell of bounded size: a set of queries against all rows in
    blocks, no join. Blocks hold codes; of the exact vectors only the queries' own travel.
    """
    cores = file.sparkSession.sparkContext.defaultParallelism
    block = max(min(candidates, LEAST_CANDIDATES), min(candidates, -(-n // (4 * cores))))
    nc, nq = (F.lit(max(1, -(-size // of))) for size, of in ((n, block), (m, queries)))
    none = F.lit(None)
    mine = file.select(F.pmod(F.xxhash64("row"), nc).alias("c"), F.explode(F.sequence(F.lit(0), nq - 1)).alias("q"), F.lit(0).alias("role"), "row", "vec_id", "codes", none.cast("array<bigint>").alias("v"))
    ask = asked.select(F.explode(F.sequence(F.lit(0), nc - 1)).alias("c"), F.pmod(F.xxhash64("vec_id"), nq).alias("q"), F.lit(1).alias("role"), none.cast("long").alias("row"), "vec_id", none.cast("binary").alias("codes"), "v")
    cell = F.concat_ws(":", "c", "q").alias("cell")
    dealt = mine.unionByName(ask).select(cell, "role", "row", "vec_id", "codes", "v").repartition("cell").sortWithinPartitions("cell", "role")
    kind = file.schema["vec_id"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for t in grouped_batches(batches, "cell"):
            cells = t.column("cell").combine_chunks().dictionary_encode().indices.to_numpy(zero_copy_only=False)
            ends = [0, *(np.flatnonzero(np.diff(cells)) + 1).tolist(), len(cells)]
            for begin, end in zip(ends, ends[1:], strict=False):
                part = t.slice(begin, end - begin)
                border = int(np.searchsorted(part.column("role").to_numpy(), 1))
                if 0 < border < len(part):
                    yield from answers(part.slice(0, border), part.slice(border), grid, k)

    return dealt.mapInArrow(run, f"query_id {kind}, row long, low double, high double")


def answers(here: pa.Table, asks: pa.Table, grid: Grid, k: int) -> Iterator[pa.RecordBatch]:
    """Rows of one block whose upper bound reaches the k-th best lower bound of the block, for each query of a block."""
    codes = np.frombuffer(b"".join(here.column("codes").to_pylist()), np.uint8).reshape(len(here), len(grid.low))
    row, ids, who = here.column("row").to_numpy(), here.column("vec_id").to_numpy(), asks.column("vec_id").to_numpy()
    got = matrix(asks.column("v"), np.float64)
    exact = np.zeros((len(asks), codes.shape[1]))
    exact[:, : got.shape[1]] = got
    for at in range(0, len(asks), CHUNK):
        own, query = who[at : at + CHUNK], exact[at : at + CHUNK]
        scores, off = grid.bounds(codes, query)
        scores[own[:, None] == ids[None, :]] = -np.inf
        best = min(k, scores.shape[1])
        reach = np.partition(scores, scores.shape[1] - best, axis=1)[:, -best] - 2 * off
        i, j = np.nonzero((scores >= reach[:, None]) & (scores > -np.inf))
        yield pa.RecordBatch.from_arrays([pa.array(own[i]), pa.array(row[j]), pa.array(scores[i, j] - off[i]), pa.array(scores[i, j] + off[i])], names=["query_id", "row", "low", "high"])


def top_k(vectors: DataFrame, k: int = K, every: int = EVERY, candidates: int = CANDIDATES, queries: int = QUERIES, cells: int = CELLS) -> DataFrame:
    """``(query_id, rank, vec_id, score)``: the k largest integer inner products of each query with all other rows.

    Queries are the rows whose vec_id is divisible by ``every``; ties go to the smaller vec_id. Vectors that are null or
    hold null or non-finite components take no part, nor do rows without vec_id; shorter vectors count as filled up with
    zeros. Vectors so large that their scores might not fit 64 bits (``fits``: with 64 components, one of 2^20 or more) are
    left out as well. Repeated rows are candidates each; a query id that repeats asks once, with its smallest vector, and none of
    its own rows is a candidate. Other columns are dropped. Scores are exact while they fit 64 bits.

    1. Of equal vectors only the k + 1 smallest ids can be in any answer; the others leave, dealt over salts first, so that no
    task orders all copies of one vector. 2. The approximation file is
    written once; its codes are scanned in blocks, and rows stay whose upper bound reaches the k-th best lower bound of
    the block, then of all blocks. 3. Exact vectors are read in the order of their upper bounds: the first few of each
    query, then those whose bound still reaches the k-th exact score, so that the k best are certain.
    """
    rows = vectors.where(usable(F.col("embedding")) & F.col("vec_id").isNotNull()).where(fits(F.col("embedding"))).select("vec_id", scaled(F.col("embedding")).alias("v"))
    rows = rows.groupBy("vec_id", "v").agg(F.count("*").alias("copies"))
    rows = materialize(rows, "scaled")
    asked = rows.where(F.col("vec_id") % every == 0).groupBy("vec_id").agg(F.min("v").alias("v"))
    smallest = lambda df, *by: df.withColumn("place", F.row_number().over(Window.partitionBy(*by).orderBy("vec_id"))).where(F.col("place") <= k + 1).drop("place")
    dealt = smallest(rows.withColumn("salt", F.pmod(F.xxhash64("vec_id"), F.lit(SALTS))), "v", "salt").drop("salt")
    rows = materialize(smallest(dealt, "v").withColumn("row", F.monotonically_increasing_id()), "distinct")
    grid = grid_of(rows, cells)
    file = approximation_file(rows, grid)
    # A query's exact vector and the candidates' are both arrays: whatever the lengths, what is beyond the shorter adds 0.
    product = F.aggregate(F.zip_with("v", "q", lambda x, y: F.coalesce(x * y, F.lit(0).cast("long"))), F.lit(0).cast("long"), lambda a, x: a + x)
    by = Window.partitionBy("query_id")
    read = lambda found: found.join(rows.select("row", "vec_id", "v", "copies"), "row").join(asked.select(F.col("vec_id").alias("query_id"), F.col("v").alias("q")), "query_id").select("query_id", "vec_id", "copies", product.alias("score"))

    near = materialize(scan(file, asked, grid, k, file.count(), asked.count(), candidates, queries), "near")
    kth = near.withColumn("n", F.row_number().over(by.orderBy(F.desc("low")))).where(F.col("n") == k).select(F.col("query_id").alias("of"), F.col("low").alias("least"))
    near = near.join(kth, F.col("query_id") == F.col("of"), "left").where(F.col("least").isNull() | (F.col("high") >= F.col("least")))
    near = materialize(near.withColumn("n", F.row_number().over(by.orderBy(F.desc("high"), "row"))).select("query_id", "row", "high", "n"), "candidates")
    first = materialize(read(near.where(F.col("n") <= max(k, FIRST_READ))), "first-read")
    sure = first.withColumn("n", F.row_number().over(by.orderBy(F.desc("score")))).where(F.col("n") == k).select(F.col("query_id").alias("of"), "score")
    rest = near.where(F.col("n") > max(k, FIRST_READ)).join(sure, (F.col("query_id") == F.col("of")) & (F.col("high") >= F.col("score")), "left_semi")
    every_one = first.unionByName(read(rest)).withColumn("copy", F.explode(F.sequence(F.lit(1), F.least("copies", F.lit(k)).cast("int"))))
    rank = F.row_number().over(by.orderBy(F.desc("score"), "vec_id"))
    return every_one.withColumn("rank", rank).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")


def op8_vector_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The five best partners of every fiftieth of ``embeddings``."""
    return top_k(table(spark, sf_dir, "embeddings"))


OP8_SQL = """
WITH v AS (SELECT vec_id, list_transform(embedding, lambda x: floor(256 * x::DOUBLE)::BIGINT) AS e FROM embeddings
           WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
q AS (SELECT * FROM v WHERE vec_id % 50 = 0),
s AS (SELECT q.vec_id AS query_id, v.vec_id, list_inner_product(q.e::DOUBLE[], v.e::DOUBLE[])::BIGINT AS score
      FROM q JOIN v ON q.vec_id <> v.vec_id),
r AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id)::INT AS rank FROM s)
SELECT query_id, rank, vec_id, score FROM r WHERE rank <= 5
"""
