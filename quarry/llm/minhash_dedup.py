"""MinHash near-duplicates: banded candidates, odd sketches that estimate high similarities, exact confirmation on full sets."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .shared import cells_across, components, grouped_batches, materialize, meeting, table

SHINGLE = 5
PERCENT = 75
#: A pair of similarity 0.75 shares no band with probability (1 - 0.75**5)**32 = 0.0002.
BANDS, ROWS = 32, 5
#: Samples of an odd sketch (the first BANDS * ROWS make the bands) and its bits.
SAMPLES, SKETCH_BITS = 288, 1024
#: Candidates whose odd sketches estimate less than this are dropped: over three standard deviations below 0.75.
LEAST_ESTIMATE = 0.66
BLOCK = 512

SPACE = np.zeros(256, dtype=bool)
SPACE[[0x20, *range(0x09, 0x0E)]] = True
LOWER = bytes(c + 32 if 65 <= c <= 90 else c for c in range(256))
_random = np.random.default_rng(20240229)
SPREAD = _random.integers(1, 1 << 63, SHINGLE, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
TIMES = _random.integers(1, 1 << 63, SAMPLES, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
PLUS = _random.integers(0, 1 << 63, SAMPLES, dtype=np.uint64)
BASE = int(_random.integers(1 << 40, 1 << 62)) * 2 + 1


def scramble(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit numbers that spreads every bit (the finaliser of SplitMix64)."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


class Shingler:
    """64-bit hashes of the distinct shingles of a text, by whole-array operations."""

    def __init__(self) -> None:
        self.powers = self.power_table(256)

    @staticmethod
    def power_table(n: int) -> np.ndarray:
        return np.concatenate([np.ones(1, np.uint64), np.cumprod(np.full(n - 1, BASE, np.uint64))])

    def __call__(self, text: str | None) -> np.ndarray:
        raw = np.frombuffer((text or "").encode("utf-8", "surrogatepass").translate(LOWER), np.uint8)
        solid = ~SPACE[raw]
        edge = np.flatnonzero(np.diff(solid, prepend=False, append=False))
        starts, size = edge[0::2], edge[1::2] - edge[0::2]
        if not len(starts):
            return np.empty(0, np.uint64)
        if size.max() > len(self.powers):
            self.powers = self.power_table(int(size.max()) * 2)
        first = np.concatenate([[0], np.cumsum(size)[:-1]])
        place = np.arange(int(size.sum())) - np.repeat(first, size)
        words = scramble(np.add.reduceat((raw[solid].astype(np.uint64) + np.uint64(1)) * self.powers[place], first))
        n = len(words)
        if n < SHINGLE:
            return scramble(np.array([np.sum(words * SPREAD[:n]) + np.uint64(n)], np.uint64))
        mixed = np.zeros(n - SHINGLE + 1, np.uint64)
        for j in range(SHINGLE):
            mixed += words[j : n - SHINGLE + 1 + j] * SPREAD[j]
        return np.unique(scramble(mixed))


def minhashes(shingles: np.ndarray) -> np.ndarray:
    """One minimum for each of the multiply-add orders; long sets go through in pieces."""
    least = np.full(len(TIMES), np.iinfo(np.uint64).max, np.uint64)
    for at in range(0, len(shingles), 2048):
        np.minimum(least, (shingles[at : at + 2048, None] * TIMES + PLUS).min(axis=0), out=least)
    return least


def odd_sketch(samples: np.ndarray) -> bytes:
    """Bit s is the parity of the number of (order, minimum) samples that hash to s."""
    slots = scramble(samples + np.arange(len(samples), dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15)) % np.uint64(SKETCH_BITS)
    return np.packbits(np.bincount(slots.astype(np.int64), minlength=SKETCH_BITS) & 1).tobytes()


def similarity(differing_bits):
    """Jaccard similarity that odd sketches with so many differing bits estimate (-inf where they are too full to tell)."""
    left = 1.0 - 2.0 * np.asarray(differing_bits, dtype=float) / SKETCH_BITS
    with np.errstate(divide="ignore", invalid="ignore"):
        return np.where(left > 0, 1.0 + SKETCH_BITS / (4.0 * SAMPLES) * np.log(np.maximum(left, 1e-300)), -np.inf)


#: The most differing bits that still estimate LEAST_ESTIMATE.
MOST_BITS = int(np.flatnonzero(similarity(np.arange(SKETCH_BITS)) >= LEAST_ESTIMATE)[-1])


def signatures(docs: DataFrame, text: str) -> DataFrame:
    """``(doc_id, n_shingles, digest, bands, sketch)``; digest stands for the set: equal sets, equal digests."""
    kind = docs.schema["doc_id"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        shingles, step = Shingler(), np.arange(BANDS, dtype=np.uint64)
        for b in batches:
            counts, digests, bands, sketches = [], [], [], []
            for t in b.column(1).to_pylist():
                found = shingles(t)
                counts.append(len(found))
                if len(found):
                    samples = minhashes(found)
                    order = np.arange(1, len(found) + 1, dtype=np.uint64)
                    digests.append(f"{int(np.sum(scramble(found ^ np.uint64(len(found)))) ):016x}{int(np.sum(scramble(found + order))):016x}")
                    bands.append(scramble((samples[: BANDS * ROWS].reshape(BANDS, ROWS) * SPREAD[:ROWS]).sum(axis=1, dtype=np.uint64) + step).view(np.int64))
                    sketches.append(odd_sketch(samples))
                else:
                    digests.append(None)
                    bands.append(np.empty(0, np.int64))
                    sketches.append(None)
            at = np.concatenate([[0], np.cumsum([len(x) for x in bands])]).astype(np.int32)
            flat = pa.array(np.concatenate(bands) if bands else np.empty(0, np.int64), pa.int64())
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(counts, pa.int64()), pa.array(digests, pa.string()), pa.ListArray.from_arrays(pa.array(at), flat), pa.array(sketches, pa.binary())], names=["doc_id", "n_shingles", "digest", "bands", "sketch"])

    return docs.select("doc_id", F.col(text)).mapInArrow(run, f"doc_id {kind}, n_shingles long, digest string, bands array<long>, sketch binary")


def similar(a: np.ndarray, b: np.ndarray, percent: int) -> bool:
    both = len(np.intersect1d(a, b, assume_unique=True))
    return both > 0 and 100 * both >= percent * (len(a) + len(b) - both)


def confirmed(pairs: DataFrame, texts: DataFrame, percent: int) -> DataFrame:
    """Those of ``pairs(a, b)`` whose full sets are similar enough; ``texts(id, text)`` holds whole texts.

    The texts of all b of one a are brought to the text of a, in chunks of ``BLOCK`` b: an a with very many partners is
    spread over tasks, its text sent to each.
    """
    size = pairs.groupBy("a").agg(F.count("*").alias("n"))
    chunks = F.ceil(F.col("n") / BLOCK).cast("int")
    members = pairs.join(size, "a").select(F.col("b").alias("id"), "a", F.pmod(F.xxhash64("b"), chunks).cast("int").alias("chunk"), F.lit(1).alias("role"))
    heads = size.select(F.col("a").alias("id"), "a", F.explode(F.sequence(F.lit(0), chunks - 1)).alias("chunk"), F.lit(0).alias("role"))
    rows = members.unionByName(heads).join(texts.hint("merge"), "id").select("a", "chunk", "role", "id", "text")
    rows = rows.repartition("a", "chunk").sortWithinPartitions("a", "chunk", "role")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        shingles, now, heads = Shingler(), None, []
        for batch in batches:
            out = []
            for a, chunk, role, id, t in zip(*(batch.column(i).to_pylist() for i in range(5)), strict=True):
                if (a, chunk) != now:
                    now, heads = (a, chunk), []
                found = shingles(t)
                if role == 0:
                    heads.append(found)
                elif any(similar(head, found, percent) for head in heads):
                    out.append((a, id))
            yield pa.RecordBatch.from_arrays([pa.array([x[k] for x in out], pa.int64()) for k in (0, 1)], names=["a", "b"])

    return rows.mapInArrow(run, "a long, b long").distinct()


def likely(pairs: DataFrame, reps: DataFrame, percent: int) -> DataFrame:
    """``pairs(a, b)`` whose sizes allow the similarity and whose odd sketches estimate enough: the XOR's population count has one bound."""
    one = lambda c: reps.select(F.col("id").alias(c), F.col("sketch").alias(f"__{c}"), F.col("n_shingles").alias(f"n_{c}"))
    df = pairs.join(one("a"), "a").join(one("b"), "b").where(100 * F.least("n_a", "n_b") >= percent * F.greatest("n_a", "n_b"))
    words = lambda c: [F.conv(F.hex(F.substring(c, k + 1, 4)), 16, 10).cast("long") for k in range(0, SKETCH_BITS // 8, 4)]
    bits = sum((F.bit_count(x.bitwiseXOR(y)) for x, y in zip(words("__a"), words("__b"), strict=True)), F.lit(0))
    return df.where(bits <= MOST_BITS).select("a", "b")


def open_pairs(t: pa.Table, percent: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Pairs of rows (i, j) still to be confirmed, and their differing bits, best first.

    They meet in a cell, belong to different components, share no earlier band than the cell's (there they were met
    already), have sizes that allow the similarity and odd sketches that estimate enough.
    """
    cell = t.column("cell").combine_chunks().dictionary_encode().indices.to_numpy(zero_copy_only=False)
    side, alone, comp, band, n = (t.column(c).to_numpy() for c in ("side", "alone", "comp", "band", "n_shingles"))
    prints = t.column("bands").combine_chunks().flatten().to_numpy().reshape(len(cell), BANDS)
    bits = np.frombuffer(b"".join(t.column("sketch").to_pylist()), np.uint64).reshape(len(cell), -1)
    found = [(np.empty(0, np.int64),) * 3]
    for i, j in meeting(cell, side, alone):
        ok = (comp[i] != comp[j]) & (100 * np.minimum(n[i], n[j]) >= percent * np.maximum(n[i], n[j]))
        i, j = i[ok], j[ok]
        ok = (prints[i] == prints[j]).argmax(axis=1) == band[i]
        i, j = i[ok], j[ok]
        differ = np.bitwise_count(bits[i] ^ bits[j]).sum(axis=1, dtype=np.int64)
        ok = differ <= MOST_BITS
        found.append((i[ok], j[ok], differ[ok]))
    i, j, differ = (np.concatenate(x) for x in zip(*found, strict=True))
    best = np.argsort(differ, kind="stable")
    return i[best], j[best], differ[best]


MEMBER = "cell string, side int, alone boolean, band int, id long, comp long, n_shingles long, bands array<long>, sketch binary"


def with_partners(rows: DataFrame, percent: int) -> DataFrame:
    """Those of ``rows`` (of a cell) that have a pair to confirm in their cell; rows, never pairs, are emitted."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for t in grouped_batches(batches, "cell"):
            i, j, _ = open_pairs(t, percent)
            yield from t.take(pa.array(np.union1d(i, j))).to_batches()

    return rows.repartition("cell").sortWithinPartitions("cell").mapInArrow(run, MEMBER)


def linked_in_cells(rows: DataFrame, percent: int) -> DataFrame:
    """Confirmed links ``(a, b)`` of components, from ``rows`` with their whole texts.

    The pairs of a cell are taken best first; those whose components a confirmed link has joined meanwhile are skipped,
    so a cell emits fewer links than it has rows.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        shingles = Shingler()
        for t in grouped_batches(batches, "cell"):
            i, j, _ = open_pairs(t, percent)
            comp, text = t.column("comp").to_pylist(), t.column("text")
            joined: dict[int, int] = {}
            sets: dict[int, np.ndarray] = {}
            links = []

            def root(c: int, joined=joined) -> int:
                while (up := joined.get(c, c)) != c:
                    c = up
                return c

            def set_of(k: int, sets=sets, text=text) -> np.ndarray:
                if k not in sets:
                    sets[k] = shingles(text[k].as_py())
                return sets[k]

            for x, y in zip(i.tolist(), j.tolist(), strict=True):
                a, b = root(comp[x]), root(comp[y])
                if a != b and similar(set_of(x), set_of(y), percent):
                    joined[max(a, b)] = min(a, b)
                    links.append((comp[x], comp[y]))
            yield pa.RecordBatch.from_arrays([pa.array([x[k] for x in links], pa.int64()) for k in (0, 1)], names=["a", "b"])

    return rows.repartition("cell").sortWithinPartitions("cell").mapInArrow(run, "a long, b long").distinct()


def near_duplicates(docs: DataFrame, text: str = "text", percent: int = PERCENT) -> DataFrame:
    """``(doc_id, n_shingles, component_id, kept)`` for every row of ``docs``.

    Documents with 100 * |A and B| >= percent * |A or B| over distinct five-word shingles are linked; component_id is the
    smallest doc_id reachable. 1. Equal sets collapse to their smallest doc_id. 2. In every band bucket each document is
    a candidate with the bucket's smallest id only; odd sketches discard, full sets confirm; components form. 3. In
    buckets that still hold several components, all pairs across components are estimated in cells of bounded size: those
    outside a bucket's largest component against all of the bucket. The survivors are confirmed there. So every pair that shares a band is linked, refuted, or already in one component, and
    no task emits the pairs of a group.

    Null or empty texts have no shingles and link with nothing. Rows that share a doc_id are one document; a row with a
    null doc_id stays alone (component null). doc_id must be an integer. Other columns are dropped; an empty table gives no rows.
    """
    sig = materialize(signatures(docs, text), "signatures")
    named = sig.where("n_shingles > 0 AND doc_id IS NOT NULL")
    reps = named.groupBy("digest").agg(F.min_by(F.struct("n_shingles", "bands", "sketch"), "doc_id").alias("s"), F.min("doc_id").cast("long").alias("id"))
    reps = materialize(reps.select("digest", "id", "s.n_shingles", "s.bands", "s.sketch"), "representatives")
    keys = reps.select("id", F.posexplode("bands").alias("band", "value")).select("id", "band", F.xxhash64("band", "value").alias("key"))
    buckets = keys.groupBy("key").agg(F.min("id").alias("a"), F.count("*").alias("n")).where("n > 1")
    shared = materialize(keys.join(buckets, "key"), "buckets")
    # Only documents that share a bucket are compared; their texts are fetched once. Both sides grow with the corpus, so neither is broadcast.
    texts = docs.select(F.col("doc_id").cast("long").alias("id"), F.col(text).alias("text"))
    texts = materialize(texts.hint("merge").join(shared.select("id").distinct(), "id"), "texts")
    stars = likely(shared.where("id <> a").select("a", F.col("id").alias("b")).distinct(), reps, percent)
    first = materialize(components(confirmed(materialize(stars, "stars"), texts, percent)), "first-components")

    comp = lambda df: df.join(first, "id", "left").withColumn("comp", F.coalesce("component_id", "id")).drop("component_id")
    members = comp(shared.select("key", "band", "id"))
    rest = cells_across(members, "key", "id", "comp", BLOCK).join(reps.drop("digest"), "id")
    rest = materialize(with_partners(rest.selectExpr("cell", "side", "alone", "band", "id", "comp", "n_shingles", "bands", "sketch"), percent), "open-cells")
    second = components(linked_in_cells(rest.join(texts.hint("merge"), "id"), percent)).withColumnRenamed("id", "comp")
    final = comp(reps.select("digest", "id")).join(second, "comp", "left").select("digest", F.coalesce("component_id", "comp").alias("component_id"))
    kind = docs.schema["doc_id"].dataType
    # Texts without words have no digest; they are dealt out by their id and find nothing.
    out = sig.select("doc_id", "n_shingles", F.coalesce("digest", F.concat(F.lit("-"), F.xxhash64("doc_id"))).alias("digest")).join(final, "digest", "left")
    component = F.coalesce(F.when(F.col("doc_id").isNotNull(), F.col("component_id")).cast(kind), "doc_id")
    return out.select("doc_id", "n_shingles", component.alias("component_id"), F.coalesce(component == F.col("doc_id"), F.lit(True)).alias("kept"))


def op9_minhash_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Near-duplicate classes of all ``documents``."""
    return near_duplicates(table(spark, sf_dir, "documents"))


#: All pairs that share a shingle, and the closure of their links: exact, for small tables.
OP9_SQL = r"""
WITH RECURSIVE w AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS l FROM documents),
s AS MATERIALIZED (SELECT DISTINCT doc_id, array_to_string(l[i : i + 4], ' ') AS g
  FROM (SELECT doc_id, l, unnest(range(1, CASE WHEN len(l) = 0 THEN 1 ELSE greatest(len(l) - 3, 2) END)) AS i FROM w)),
n AS MATERIALIZED (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id),
b AS (SELECT x.doc_id AS a, y.doc_id AS b, count(*) AS k FROM s x JOIN s y ON x.g = y.g AND x.doc_id <> y.doc_id GROUP BY ALL),
e AS MATERIALIZED (SELECT b.a, b.b FROM b JOIN n p ON b.a = p.doc_id JOIN n q ON b.b = q.doc_id WHERE 100 * k >= 75 * (p.n + q.n - k)),
r AS (SELECT a, b FROM e UNION SELECT r.a, e.b FROM r JOIN e ON r.b = e.a),
c AS (SELECT a, min(b) AS least FROM r GROUP BY a)
SELECT w.doc_id, coalesce(n.n, 0)::BIGINT AS n_shingles, least(w.doc_id, coalesce(c.least, w.doc_id)) AS component_id, least(w.doc_id, coalesce(c.least, w.doc_id)) = w.doc_id AS kept
FROM w LEFT JOIN n ON w.doc_id = n.doc_id LEFT JOIN c ON w.doc_id = c.a
"""
