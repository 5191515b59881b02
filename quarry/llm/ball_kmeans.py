"""Centroid clustering by ball k-means: clusters are balls, and a vector meets only the centroids that can be nearer than its own."""

from __future__ import annotations

import hashlib
import math
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .shared import materialize, release, table
from .vectors import usable

CLUSTERS, DIMENSIONS, ROUNDS, SCALE = 16, 64, 3, 64
#: Largest size of a component: squared distances of up to 64 such components fit 64 bits.
LARGEST = 1 << 27
#: Bytes of one component as a vector is stored: the first kind that holds all of its components.
KINDS = (np.int8, np.int16, np.int32)
#: Vectors that are compared at a time.
BLOCK = 4096


@dataclass(frozen=True)
class Balls:
    """Centroids (whole numbers), and for each the squared radius of its members before it moved and how far it moved.

    ``distances`` holds the squared distance of every two centroids, ``neighbours`` the centroids that a member of a ball
    can be nearer to, nearest first: those whose squared distance is at most four times the ball's squared radius.
    """

    centroids: np.ndarray
    reach: tuple[int | None, ...]

    @property
    def distances(self) -> np.ndarray:
        d = self.centroids[:, None, :] - self.centroids[None, :, :]
        return (d * d).sum(axis=2)

    def neighbours(self) -> list[np.ndarray]:
        out = []
        for k, row in enumerate(self.distances):
            near = np.argsort(row, kind="stable")
            limit = self.reach[k]
            out.append(np.array([j for j in near if j != k and (limit is None or int(row[j]) <= 4 * limit)], np.int64))
        return out


def moved(radius: int, by: int) -> int:
    """A squared radius around a moved centre that holds all that lay within the old one: by the triangle inequality, rounded up."""
    return (math.isqrt(radius) + 1 + math.isqrt(by) + 1) ** 2


def nearest(x: np.ndarray, centroids: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Number and squared distance of the nearest centroid, ties to the smaller number: all are compared."""
    d = np.stack([((x - c) ** 2).sum(axis=1) for c in centroids], axis=1)
    return d.argmin(axis=1), d.min(axis=1)


def reassigned(x: np.ndarray, own: np.ndarray, balls: Balls) -> tuple[np.ndarray, np.ndarray, int]:
    """As ``nearest`` for vectors that belong to balls; also the number of distances to other centroids that it took.

    A centroid c' at squared distance D from the own one c is strictly farther than c from a vector whose squared distance
    d to c has 4 * d < D. So a ball's stable core, all with 4 * d below the D of its nearest neighbour, keeps its
    centroid, and a vector of the i-th annulus meets the first i neighbours.
    """
    to, best, met = own.copy(), np.empty(len(x), np.int64), 0
    distances, neighbours = balls.distances, balls.neighbours()
    for k in np.unique(own):
        here = np.flatnonzero(own == k)
        rows = x[here]
        d = ((rows - balls.centroids[k]) ** 2).sum(axis=1)
        number, least = np.full(len(here), k), d.copy()
        for j in neighbours[k]:
            ring = np.flatnonzero(4 * d >= distances[k, j])  # beyond them lies the core, or an inner annulus
            if not len(ring):
                break
            met += len(ring)
            e = ((rows[ring] - balls.centroids[j]) ** 2).sum(axis=1)
            wins = (e < least[ring]) | ((e == least[ring]) & (j < number[ring]))
            number[ring[wins]], least[ring[wins]] = j, e[wins]
        to[here], best[here] = number, least
    return to, best, met


def packed(rows: np.ndarray) -> list[bytes]:
    """Each row in the narrowest kind that holds it."""
    size = np.maximum(rows.max(axis=1, initial=0), -rows.min(axis=1, initial=0) - 1)
    return [r.astype(KINDS[0] if s < 1 << 7 else KINDS[1] if s < 1 << 15 else KINDS[2]).tobytes() for r, s in zip(rows, size, strict=True)]


def unpacked(codes: pa.Array, width: int) -> np.ndarray:
    out = np.zeros((len(codes), width), np.int64)
    data = codes.to_pylist()
    lengths = np.fromiter(map(len, data), np.int64, len(data))
    for kind in KINDS:
        here = np.flatnonzero(lengths == width * np.dtype(kind).itemsize)
        if len(here):
            out[here] = np.frombuffer(b"".join(data[i] for i in here), kind).reshape(len(here), width)
    return out


def whole(vector: Column, scale: int) -> Column:
    """floor(scale * x) of every component, x as double."""
    return F.transform(vector, lambda x: F.floor(x.cast("double") * scale))


def kept_vectors(vectors: DataFrame, dimensions: int, scale: int) -> DataFrame:
    """``(vec_id, v)`` of vectors with exactly ``dimensions`` finite components, each below ``LARGEST`` in size when scaled."""
    small = F.forall("embedding", lambda x: F.abs(x.cast("double") * scale) < LARGEST)
    rows = vectors.select("vec_id", "embedding").where(usable(F.col("embedding")) & (F.size("embedding") == dimensions))
    return rows.where(F.coalesce(small, F.lit(False))).select("vec_id", whole(F.col("embedding"), scale).alias("v"))


def first_centroids(rows: DataFrame, clusters: int) -> list[list[int]]:
    """The vectors whose id has the smallest hashes, in that order: ``clusters`` rows reach the driver."""
    spot = F.sha2(F.concat(F.lit("1:"), F.col("vec_id").cast("string")), 256)
    return [r["v"] for r in rows.where("vec_id IS NOT NULL").select(spot.alias("h"), "v").orderBy("h", "v").limit(clusters).collect()]


def assigned(rows: DataFrame, balls: Balls, width: int) -> DataFrame:
    """``(vec_id, codes, cluster, distance)``; rows without a cluster meet all centroids, others those that their ball leaves."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole_batch in batches:
            for at in range(0, whole_batch.num_rows, BLOCK):
                b = whole_batch.slice(at, BLOCK)
                x = unpacked(b.column("codes"), width)
                own = b.column("cluster")
                if own.null_count:
                    to, d = nearest(x, balls.centroids)
                else:
                    to, d, _ = reassigned(x, own.to_numpy().astype(np.int64), balls)
                yield pa.RecordBatch.from_arrays([b.column("vec_id"), b.column("codes"), pa.array(to, pa.int32()), pa.array(d, pa.int64())], names=["vec_id", "codes", "cluster", "distance"])

    return rows.select("vec_id", "codes", "cluster").mapInArrow(run, f"vec_id {rows.schema['vec_id'].dataType.simpleString()}, codes binary, cluster int, distance long")


def measured(rows: DataFrame, width: int) -> dict[int, tuple[list[int], int, int, int]]:
    """Per cluster its component sums, number, largest distance and inertia: summed in tasks, then by (cluster, component)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            x, of, d = unpacked(b.column("codes"), width), b.column("cluster").to_numpy(), b.column("distance").to_numpy()
            out = [(int(k), x[of == k].sum(axis=0), int((of == k).sum()), int(d[of == k].max()), sum(map(int, d[of == k]))) for k in np.unique(of)]
            columns = list(zip(*out, strict=True)) or [()] * 5
            yield pa.RecordBatch.from_arrays([pa.array(columns[0], pa.int32()), pa.array([s.tolist() for s in columns[1]], pa.list_(pa.int64())), pa.array(columns[2], pa.int64()), pa.array(columns[3], pa.int64()),
                pa.array([str(i) for i in columns[4]], pa.string())], names=["cluster", "sums", "n", "far", "inertia"])

    parts = rows.mapInArrow(run, "cluster int, sums array<long>, n long, far long, inertia string")
    exact = lambda c: F.sum(c.cast("decimal(38,0)"))
    by_component = parts.select("cluster", F.posexplode("sums").alias("j", "s"), "n", "far", "inertia").groupBy("cluster", "j").agg(exact(F.col("s")).alias("s"), F.sum("n").alias("n"), F.max("far").alias("far"), exact(F.col("inertia")).alias("inertia"))
    found: dict[int, tuple[list[int], int, int, int]] = {}
    for r in by_component.orderBy("cluster", "j").collect():  # one number for each component of a centroid
        sums = found.setdefault(r["cluster"], ([], r["n"], r["far"], int(r["inertia"])))[0]
        sums.append(int(r["s"]))
    return found


def ball_kmeans(vectors: DataFrame, clusters: int = CLUSTERS, rounds: int = ROUNDS, dimensions: int = DIMENSIONS, scale: int = SCALE) -> DataFrame:
    """``(vec_id, cluster, distance, cluster_inertia, inertia, centroid_sha256)`` of each vector that is kept.

    Kept are vectors with exactly ``dimensions`` components, none null or not finite; their components become
    floor(scale * x), and vectors with one of 2^27 or more in size are left out, as distances would not fit 64 bits. The
    first centroids are the vectors whose ids have the smallest hashes (of rows that share an id, the smaller vector
    first; rows without an id are clustered but start none; with fewer vectors there are fewer centroids). ``rounds`` times all
    vectors go to their nearest centroid (ties: the smaller number) and every centroid with members moves to their floored
    mean; then they are assigned once more. All in whole numbers, so the result is exact and the same in every run.
    Repeated rows count each; other columns are dropped; without vectors, or ids, there are no rows. An inertia beyond 64
    bits is null.

    A round reads the vectors once, with the cluster of the round before, and writes them to the shared folder, a byte a
    component where that holds them. Only sums per cluster and component are shuffled.
    """
    kind = vectors.schema["vec_id"].dataType.simpleString()

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            x = b.column("v").flatten().to_numpy(zero_copy_only=False).reshape(b.num_rows, dimensions)
            yield pa.RecordBatch.from_arrays([b.column("vec_id"), pa.array(packed(x), pa.binary()), pa.nulls(b.num_rows, pa.int32())], names=["vec_id", "codes", "cluster"])

    kept = kept_vectors(vectors, dimensions, scale)
    start = first_centroids(kept, clusters)
    rows = materialize(kept.mapInArrow(pack, f"vec_id {kind}, codes binary, cluster int"), "vectors")
    if not start:
        return rows.select("vec_id", "cluster", F.lit(0).cast("long").alias("distance"), F.lit(0).cast("long").alias("cluster_inertia"), F.lit(0).cast("long").alias("inertia"), F.lit("").alias("centroid_sha256")).where("false")
    balls = Balls(np.array(start, np.int64), (None,) * len(start))
    for last in [False] * rounds + [True]:
        now = materialize(assigned(rows, balls, dimensions), "assigned")
        release(rows)
        rows, found = now, measured(now, dimensions)
        if not last:
            balls = updated(balls, found)
    fits = lambda n: n if n < 1 << 63 else None
    total = sum(inertia for *_, inertia in found.values())
    told = [(k, fits(found[k][3]), hashlib.sha256(",".join(map(str, balls.centroids[k].tolist())).encode()).hexdigest()) for k in found]
    of = rows.sparkSession.createDataFrame(told, "cluster int, cluster_inertia long, centroid_sha256 string")  # a row for each cluster
    out = rows.join(F.broadcast(of), "cluster")
    return out.select("vec_id", "cluster", "distance", "cluster_inertia", F.lit(fits(total)).cast("long").alias("inertia"), "centroid_sha256")


def updated(balls: Balls, found: dict[int, tuple[list[int], int, int, int]]) -> Balls:
    """Balls around the floored means of their members; an empty one stays."""
    centroids, reach = balls.centroids.copy(), []
    for k in range(len(centroids)):
        if k not in found:
            reach.append(0)
            continue
        sums, n, far, _ = found[k]
        new = np.array([s // n for s in sums], np.int64)
        reach.append(moved(far, int(((new - centroids[k]) ** 2).sum())))
        centroids[k] = new
    return Balls(centroids, tuple(reach))


def op12_ball_kmeans(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Sixteen clusters of all ``embeddings``."""
    return ball_kmeans(table(spark, sf_dir, "embeddings"))


_ROUND = """a{n} AS (SELECT vec_id, v, c, d FROM (SELECT vec_id, v, c, d, row_number() OVER (PARTITION BY rid ORDER BY d, c) AS r
  FROM (SELECT rid, vec_id, v, c, list_sum(list_transform(list_zip(v, m), lambda p: (p[1] - p[2]) * (p[1] - p[2])))::BIGINT AS d FROM kept, c{n})) WHERE r = 1)"""
_MOVE = """s{n} AS (SELECT c, list(x ORDER BY j) AS m FROM (SELECT c, j, (sum(x) - (((sum(x) % count(*)) + count(*)) % count(*)))::BIGINT // count(*) AS x
  FROM (SELECT c, unnest(v) AS x, generate_subscripts(v, 1) AS j FROM a{n}) GROUP BY c, j) GROUP BY c),
c{next} AS (SELECT c, coalesce(s{n}.m, c{n}.m) AS m FROM c{n} LEFT JOIN s{n} USING (c))"""
OP12_SQL = f"""
WITH kept AS MATERIALIZED (SELECT row_number() OVER () AS rid, vec_id, list_transform(embedding, lambda x: floor(64 * x::DOUBLE)::BIGINT) AS v FROM embeddings
  WHERE len(embedding) = 64 AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0 AND len(list_filter(embedding, lambda x: abs(64 * x::DOUBLE) >= {LARGEST})) = 0),
c0 AS (SELECT (row_number() OVER (ORDER BY h, v) - 1)::INT AS c, v AS m FROM (SELECT sha256('1:' || vec_id) AS h, v FROM kept WHERE vec_id IS NOT NULL ORDER BY h, v LIMIT 16)),
{", ".join(_ROUND.format(n=n) + ", " + _MOVE.format(n=n, next=n + 1) for n in range(ROUNDS))}, {_ROUND.format(n=ROUNDS)}
SELECT vec_id, a{ROUNDS}.c AS cluster, d AS distance, (sum(d) OVER (PARTITION BY a{ROUNDS}.c))::BIGINT AS cluster_inertia, (sum(d) OVER ())::BIGINT AS inertia, sha256(array_to_string(m, ',')) AS centroid_sha256
FROM a{ROUNDS} JOIN c{ROUNDS} USING (c)
"""
