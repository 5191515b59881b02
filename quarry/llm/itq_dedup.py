"""Embedding near-duplicates: iterative quantisation to binary codes, multi-index Hamming tables, reranking by original vectors."""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .shared import bounded_sample, cells, components, grouped_batches, materialize, meeting, table
from .vectors import matrix, usable

COSINE = 0.9
#: Codes of this many bits come from one rotation; several rotations give the bits of all tables.
BITS = 64
#: A key of a table has so many bits that about 2**ROWS_OF_KEY vectors share it, LEAST_SUB at least.
LEAST_SUB, ROWS_OF_KEY = 10, 9
#: Of pairs at the threshold, so many may share no key; and so many standard deviations of the first code's differing bits pass.
MISS, DEVIATIONS = 0.01, 3.5
#: The rotations are fitted on so many vectors at most, the first by a hash of vec_id.
SAMPLE, STEPS = 10_000, 40
BLOCK = 1024


@dataclass(frozen=True)
class Plan:
    """How codes are cut: ``tables`` keys of ``sub`` bits from ``words`` codes, and the bits that candidates' first codes may differ in.

    ``centred`` says whether the mean is taken off before the rotations, which balances the bits.
    """

    sub: int
    tables: int
    most_bits: int
    centred: bool

    @property
    def words(self) -> int:
        return -(-self.sub * self.tables // BITS)


def plan_for(n: int, cosine: float = COSINE, mean_square: float = 0.0, miss: float = MISS) -> Plan:
    """Enough tables for the threshold, whatever the number of vectors.

    Two unit vectors at angle t differ in a bit with probability t / pi. Without the mean (squared norm m), a pair of
    cosine c stands at (c - m) / (1 - m); where that is under 0.5, the mean stays. A key of s bits agrees with probability p**s, so
    log(miss) / log(1 - p**s) tables leave ``miss`` of such pairs apart; s grows with log2(n), so a key's rows don't.
    """
    apart = (cosine - mean_square) / (1.0 - mean_square) if mean_square < 1 else 0.0
    centred = apart >= min(0.5, cosine)
    p = 1.0 - math.acos(max(-1.0, min(1.0, apart if centred else cosine))) / math.pi
    sub = max(LEAST_SUB, math.ceil(math.log2(max(n, 1))) - ROWS_OF_KEY)
    tables = max(1, math.ceil(math.log(miss) / math.log(1.0 - p**sub))) if p < 1 else 1
    most = math.ceil(BITS * (1 - p) + DEVIATIONS * math.sqrt(BITS * p * (1 - p)))
    return Plan(sub, tables, min(most, BITS), centred)


def learn(sample: np.ndarray, seed: int, centred: bool = True, bits: int = BITS, steps: int = STEPS) -> tuple[np.ndarray, np.ndarray]:
    """Mean and projection of unit vectors to ``bits`` dimensions whose signs are balanced codes.

    Principal directions (completed by random ones where the vectors have fewer dimensions), then alternating: codes =
    signs of the rotated sample, rotation = the orthogonal matrix that brings the sample nearest to its codes. Each seed
    starts from a rotation of its own and ends in another.
    """
    rng = np.random.default_rng(seed)
    mean = sample.mean(axis=0) if len(sample) and centred else np.zeros(sample.shape[1])
    flat = sample - mean
    if sample.shape[1] >= bits:
        _, axes = np.linalg.eigh(flat.T @ flat)
        plane = axes[:, ::-1][:, :bits]
    else:
        plane = rng.standard_normal((sample.shape[1], bits))
    flat = flat @ plane
    turn, _ = np.linalg.qr(rng.standard_normal((bits, bits)))
    for _ in range(steps if len(sample) else 0):
        u, _, w = np.linalg.svd(np.where(flat @ turn >= 0, 1.0, -1.0).T @ flat)
        turn = w.T @ u.T
    return mean, plane @ turn


def unit(vectors: np.ndarray) -> np.ndarray:
    """Rows scaled to length 1 in double precision (scaled by their largest component first, so squares neither overflow nor vanish)."""
    big = np.abs(vectors).max(axis=1, keepdims=True, initial=0.0)
    v = vectors / np.where(big > 0, big, 1.0)
    return v / np.maximum(np.sqrt((v * v).sum(axis=1, keepdims=True)), 1e-300)


def codes_of(vectors: np.ndarray, rotations: list[tuple[np.ndarray, np.ndarray]]) -> np.ndarray:
    """A row of 64-bit codes for each vector, one of each rotation."""
    x = unit(vectors)
    return np.column_stack([np.packbits((x - mean) @ projection >= 0, axis=1, bitorder="little").view(np.int64).ravel() for mean, projection in rotations])


def keys_of(codes: np.ndarray, plan: Plan) -> np.ndarray:
    """The key of each row in each table: ``sub`` bits of the codes after those of the tables before."""
    bits = np.unpackbits(codes.view(np.uint8), axis=1, bitorder="little")[:, : plan.sub * plan.tables].reshape(len(codes), plan.tables, plan.sub)
    return bits.astype(np.int64) @ (1 << np.arange(plan.sub, dtype=np.int64))


def candidate_pairs(t: pa.Table, plan: Plan) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Pairs of rows that meet in a cell and whose first codes are near, each in the cell of the first table they share alone."""
    cell = t.column("cell").combine_chunks().dictionary_encode().indices.to_numpy(zero_copy_only=False)
    side, alone, own = (t.column(c).to_numpy() for c in ("side", "alone", "number"))
    codes = np.frombuffer(b"".join(t.column("codes").to_pylist()), np.int64).reshape(len(cell), plan.words)
    first, keys = codes[:, 0].copy().view(np.uint64), keys_of(codes, plan)
    for i, j in meeting(cell, side, alone):
        near = np.bitwise_count(first[i] ^ first[j]) <= plan.most_bits
        i, j = i[near], j[near]
        here = (keys[i] == keys[j]).argmax(axis=1) == own[i]
        if here.any():
            yield i[here], j[here]


def near_vectors(vectors: DataFrame, cosine: float = COSINE, sample: int = SAMPLE, miss: float = MISS) -> DataFrame:
    """``(vec_id, n_links, component_id, kept)`` for every row: links are pairs found with a cosine of at least ``cosine``.

    Vectors that are null, zero or hold null or non-finite components link with nothing, nor do rows without vec_id.
    Shorter vectors count as filled up with zeros. Equal vectors (as of repeated rows) are one during the search and
    link with each other; n_links counts rows. Other columns are dropped; an empty table gives no rows.

    Each vector is listed once in each table of the plan; the keys that more than BLOCK rows share are dealt into cells. A
    first pass over narrow rows (key, id, codes) finds who has a candidate in a cell; only these bring their vectors to
    it. Cells emit sums and a root for each row, never pairs. vec_id must be an integer.
    """
    spark = vectors.sparkSession
    big = F.array_max(F.transform("embedding", lambda x: F.abs(x.cast("double"))))
    v = vectors.select("vec_id", "embedding", (usable(F.col("embedding")) & F.col("vec_id").isNotNull() & (big > 0)).alias("good"))
    v = v.withColumn("good", F.coalesce("good", F.lit(False)))
    same = [F.when(F.col("good"), F.xxhash64(F.lit(k), "embedding")).alias(f"h{k}") for k in (1, 2)]
    rows = materialize(v.select("vec_id", "good", *same), "vectors")
    reps = v.where("good").select("vec_id", "embedding", *same).groupBy("h1", "h2").agg(F.min_by("embedding", "vec_id").alias("embedding"), F.min("vec_id").cast("long").alias("id"), F.count("*").alias("copies"))
    widest = v.where("good").agg(F.max(F.size("embedding"))).first()[0] or 0
    picked = bounded_sample(v.where("good").select("vec_id", "embedding"), "vec_id", sample).select("embedding").toPandas()["embedding"]
    fitted = np.zeros((len(picked), max(widest, 1)))
    for k, x in enumerate(picked):
        fitted[k, : len(x)] = x
    fitted = unit(fitted)
    centre = fitted.mean(axis=0) if len(fitted) else np.zeros(1)
    plan = plan_for(reps.count(), cosine, float(centre @ centre), miss)
    model = spark.sparkContext.broadcast([learn(fitted, seed, plan.centred) for seed in range(plan.words)])

    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            x = np.zeros((b.num_rows, len(model.value[0][0])))
            got = matrix(b.column("embedding"), np.float64)
            x[:, : got.shape[1]] = got
            codes = codes_of(x, model.value)
            keys = keys_of(codes, plan)
            keys = pa.ListArray.from_arrays(pa.array(np.arange(len(keys) + 1, dtype=np.int32) * plan.tables), pa.array(keys.ravel()))
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array([c.tobytes() for c in codes], pa.binary()), keys], names=[*b.schema.names, "codes", "keys"])

    item = reps.schema["embedding"].dataType.simpleString()
    reps = reps.select("h1", "h2", "id", "copies", "embedding").mapInArrow(encode, f"h1 long, h2 long, id long, copies long, embedding {item}, codes binary, keys array<long>")
    reps = materialize(reps, "codes")

    listed = reps.select("id", "codes", F.posexplode("keys").alias("number", "word")).select("id", "codes", "number", (F.col("number").cast("long") * (1 << plan.sub) + F.col("word")).alias("key"))
    full = listed.groupBy("key").agg(F.count("*").alias("n")).where(F.col("n") > BLOCK)
    dealt = cells(listed.join(full, "key", "left").withColumn("n", F.coalesce("n", F.lit(1))), "key", "id", "n", BLOCK)
    dealt = dealt.select("cell", "side", "alone", "number", "id", "codes")

    def with_partners(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for t in grouped_batches(batches, "cell"):
            seen = [np.empty(0, np.int64)]
            for i, j in candidate_pairs(t, plan):
                seen += [np.unique(i), np.unique(j)]
            yield from t.take(pa.array(np.unique(np.concatenate(seen)))).to_batches()

    met = dealt.repartition("cell").sortWithinPartitions("cell").mapInArrow(with_partners, "cell string, side int, alone boolean, number int, id long, codes binary")

    def rerank(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for t in grouped_batches(batches, "cell"):
            x, ids, copies = unit(matrix(t.column("embedding"), np.float64)), t.column("id").to_numpy(), t.column("copies").to_numpy()
            links, low, high = np.zeros(len(ids), np.int64), [np.empty(0, np.int64)], [np.empty(0, np.int64)]
            for i, j in candidate_pairs(t, plan):
                near = np.einsum("ij,ij->i", x[i], x[j]) >= cosine
                i, j = i[near], j[near]
                np.add.at(links, i, copies[j])
                np.add.at(links, j, copies[i])
                low.append(i)
                high.append(j)
            i, j = np.concatenate(low), np.concatenate(high)
            root = ids.copy()
            while len(i):  # smallest id of each connected set inside the cell
                before = root.copy()
                np.minimum.at(root, i, root[j])
                np.minimum.at(root, j, root[i])
                if np.array_equal(before, root):
                    break
            keep = links > 0
            yield pa.RecordBatch.from_arrays([pa.array(ids[keep]), pa.array(links[keep]), pa.array(root[keep])], names=["id", "links", "root"])

    near = met.join(reps.select("id", "copies", "embedding"), "id").repartition("cell").sortWithinPartitions("cell")
    near = materialize(near.mapInArrow(rerank, "id long, links long, root long"), "links")
    found = near.groupBy("id").agg(F.sum("links").alias("links"))
    joined = components(near.select(F.col("id").alias("a"), F.col("root").alias("b")))
    by = reps.select("h1", "h2", "id", "copies").join(found, "id", "left").join(joined, "id", "left")
    by = by.select(F.col("h1").alias("g1"), F.col("h2").alias("g2"), (F.coalesce("links", F.lit(0)) + F.col("copies") - 1).alias("n"), F.coalesce("component_id", "id").alias("c"))
    # Unusable vectors have no hash; they are dealt out by their id and find nothing.
    spread = F.coalesce("h1", F.xxhash64("vec_id"))
    out = rows.withColumn("h1", spread).join(by, (F.col("h1") == F.col("g1")) & (F.coalesce("h2", F.lit(0)) == F.col("g2")) & F.col("good"), "left")
    component = F.coalesce(F.col("c").cast(vectors.schema["vec_id"].dataType), "vec_id")
    return out.select("vec_id", F.coalesce("n", F.lit(0)).alias("n_links"), component.alias("component_id"), F.coalesce(component == F.col("vec_id"), F.lit(True)).alias("kept"))


def op3_itq_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Near-duplicate classes of all ``embeddings``."""
    return near_vectors(table(spark, sf_dir, "embeddings"))
