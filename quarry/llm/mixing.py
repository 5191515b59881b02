"""Mixing sources to target weights: Efraimidis-Spirakis order within each source, complete epochs before a fraction."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .shared import WORD, materialize, n_words, table

WEIGHTS = (5, 2, 1)
MAX_EPOCHS = 3
#: Quality weights are held within these bounds, so no slice of the keys can hold much of a source.
LEAST_QUALITY, MOST_QUALITY = 0.5, 2.0
SLICES = 1024


def letter_share(text: Column) -> Column:
    """A quality weight from 0.5 to 2: the share of letters among characters that are no white space; 0.5 for none."""
    solid = F.regexp_replace(text, r"[\x20\x09-\x0D]+", "")
    letters = F.regexp_replace(solid, r"[\x00-\x40\x5B-\x60\x7B-\x7F]+", "")
    return F.coalesce(0.5 + 1.5 * F.try_divide(F.length(letters), F.length(solid)), F.lit(LEAST_QUALITY))


def uniform(*cols: Column, seed: int) -> Column:
    """A number in (0, 1) that depends on the values of ``cols`` and the seed alone."""
    digits = F.substring(F.md5(F.concat_ws(":", *[c.cast("string") for c in cols], F.lit(str(seed)))), 1, 13)
    return (F.conv(digits, 16, 10).cast("double") + 0.5) / float(1 << 52)


def digest(text: str) -> Column:
    return F.md5(F.coalesce(F.col(text), F.lit("")))


def source_targets(sizes: DataFrame, weights: Sequence[int], most: float) -> DataFrame:
    """``(source, source_size, weight, target)`` from one row per source ``(source, source_size)``.

    Sources in code point order, null last, get the weights in turn; their places are counted by ranges, so sources as
    many as hosts are in no one task. Level L solves sum(min(weight * L, most * size)) = total; capped sources stop at
    most * size, and the excess goes to the others by weight. Each pass is one aggregate of the source table; only its
    three sums reach the driver. Ends when no further source is capped.
    """
    order = F.col("source").asc_nulls_last()
    by = sizes.repartitionByRange(order).sortWithinPartitions(order).withColumn("__m", F.monotonically_increasing_id())
    part, inside = F.shiftright("__m", 33), F.col("__m").bitwiseAND((1 << 33) - 1)
    by = materialize(by.withColumn("__part", part).withColumn("__place", inside).drop("__m"), "ordered-sources")
    ahead = F.coalesce(F.sum("__c").over(Window.orderBy("__part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))  # a row for each range
    ranges = by.groupBy("__part").agg(F.count("*").alias("__c")).select("__part", ahead.alias("__ahead"))
    which = F.element_at(F.array(*[F.lit(w) for w in weights]), ((F.col("__place") + F.col("__ahead")) % len(weights) + 1).cast("int"))
    by = materialize(by.join(ranges, "__part").withColumn("weight", which).drop("__part", "__place", "__ahead"), "sources")
    cap = F.lit(float(most)) * F.col("source_size")
    total = by.agg(F.sum("source_size")).first()[0] or 0
    level, capped = 0.0, -1
    while True:
        full = F.col("weight") * F.lit(level) > cap
        free, spent, n = by.agg(F.sum(F.when(~full, F.col("weight"))), F.sum(F.when(full, cap)), F.count_if(full)).first()
        if n == capped or not free:
            break
        level, capped = (total - (spent or 0.0)) / free, n
    return by.withColumn("target", F.least(F.col("weight") * F.lit(level), cap).cast("double"))


def mix(docs: DataFrame, text: str = "text", quality: Column | None = None, weights: Sequence[int] = WEIGHTS, most: float = MAX_EPOCHS, seed: int = 7, slices: int = SLICES) -> DataFrame:
    """Words that the mix takes of each document: ``(doc_id, source, size, source_size, target, taken)``, a row for each input row.

    A source's target of e complete epochs and a rest takes each of its documents e times, then documents in order of
    -ln(u) / quality until the rest is spent; the last of these is cut, so that a source's taken words are its target
    rounded down. Ties go by doc_id and text digest. Null or empty texts have size 0 and take 0; a null source is a source.
    Equal rows are one with a count until the end, so repeated rows and ids are in no one group.

    Hot sources: keys are cut into ``slices`` of 1 - u^(1/quality), which are pre-aggregated, so a prefix sum runs over
    at most ``slices`` sums per source, and within one slice of one source.
    """
    weight = F.least(F.greatest(quality if quality is not None else letter_share(F.col(text)), F.lit(LEAST_QUALITY)), F.lit(MOST_QUALITY))
    rows = docs.select("doc_id", "source", n_words(F.col(text)).alias("size"), F.coalesce(weight, F.lit(1.0)).cast("double").alias("w"), digest(text).alias("h"))
    rows = rows.groupBy("doc_id", "source", "size", "w", "h").agg(F.count("*").alias("copies"))
    key = -F.log(uniform(F.coalesce(F.col("doc_id").cast("string"), F.lit("")), F.col("h"), seed=seed)) / F.col("w")
    rows = rows.withColumn("key", key).drop("w").withColumn("slice", F.floor((1 - F.exp(-F.col("key"))) * slices).cast("int"))
    rows = materialize(rows.withColumn("named", F.concat(F.col("source").isNull().cast("string"), F.coalesce("source", F.lit("")))), "mix-keys")
    slice_sums = materialize(rows.groupBy("named", "source", "slice").agg(F.sum(F.col("size") * F.col("copies")).alias("n")), "mix-slices")
    targets = source_targets(slice_sums.groupBy("named", "source").agg(F.sum("n").alias("source_size")), weights, most)
    before = F.coalesce(F.sum("n").over(Window.partitionBy("named").orderBy("slice").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    slice_sums = slice_sums.withColumn("before", before).drop("source", "n").join(targets.drop("source", "weight"), "named")
    inside = Window.partitionBy("named", "slice").orderBy("key", "doc_id", "h", "size").rowsBetween(Window.unboundedPreceding, -1)
    ranked = rows.withColumn("prior", F.coalesce(F.sum(F.col("size") * F.col("copies")).over(inside), F.lit(0)))
    ranked = ranked.join(slice_sums, ["named", "slice"]).withColumn("copy", F.explode(F.sequence(F.lit(0).cast("long"), F.col("copies") - 1)))
    whole = F.floor(F.col("target"))
    epochs = F.coalesce(F.floor(F.try_divide(whole, F.col("source_size"))), F.lit(0))
    rest = whole - epochs * F.col("source_size")
    part = F.least(F.greatest(rest - F.col("before") - F.col("prior") - F.col("copy") * F.col("size"), F.lit(0)), F.col("size"))
    return ranked.select("doc_id", "source", "size", "source_size", "target", (epochs * F.col("size") + part).cast("long").alias("taken"), F.col("h").alias("text_hash"))


def mixed_documents(docs: DataFrame, text: str = "text", length: str | None = "n_chars", **how) -> DataFrame:
    """The mix itself: each document as often as it is taken, whole in complete passes and cut after a word in a part.

    Same columns as ``docs``; ``length`` is counted anew. Documents of which nothing is taken are left out. Rows that
    repeat in ``docs`` are matched by doc_id, source and text digest, then by number: in the order of their other columns.
    """
    same = ["d", "s", "h"]
    keys = lambda df, h: df.withColumns({"d": F.coalesce(F.col("doc_id").cast("string"), F.lit("")), "s": F.concat(F.col("source").isNull().cast("string"), F.coalesce("source", F.lit(""))), "h": h})
    number = lambda name, *order: F.row_number().over(Window.partitionBy(*same).orderBy(*order)).alias(name)
    taken = keys(mix(docs, text, **how), F.col("text_hash")).where("taken > 0").select(*same, "size", "taken")
    taken = taken.select(*same, "size", "taken", number("m", F.desc("taken"))).alias("t")
    rest = F.to_json(F.struct(F.lit(0).alias("_"), *[F.col(f"row.{c}") for c in docs.columns if c != text]))
    rows = keys(docs.select(F.struct(*docs.columns).alias("row"), "doc_id", "source", digest(text).alias("__h")), F.col("__h"))
    rows = rows.select("row", *same, rest.alias("rest")).select("row", *same, number("n", "rest")).alias("r")
    # The row numbers are compared outside the join's keys: both sides stay dealt out by the same columns, in one shuffle each.
    on = [F.col(f"r.{c}") == F.col(f"t.{c}") for c in same]
    df = rows.join(taken, on[0] & on[1] & on[2] & (F.col("n") - F.col("m") == 0))
    df = df.select("row", "size", "taken", F.explode(F.sequence(F.lit(1), F.ceil(F.col("taken") / F.col("size")).cast("int"))).alias("copy"))
    left, old = F.least(F.col("taken") - (F.col("copy") - 1) * F.col("size"), F.col("size")), F.col("row")[text]
    df = df.select("row", F.when(left == F.col("size"), old).otherwise(first_words(old, left.cast("int"))).alias("new"))
    size = F.when(F.col("new").eqNullSafe(old), F.col("row")[length]).otherwise(F.length("new")) if length in docs.columns else None
    changed = {text: F.col("new")} | ({length: size.cast(docs.schema[length].dataType)} if size is not None else {})
    return df.select(*[changed.get(c, F.col("row")[c]).alias(c) for c in docs.columns])


def first_words(text: Column, n: Column) -> Column:
    """``text`` up to the end of its n-th word, white space kept."""
    word = F.regexp_extract_all(text, F.lit(r"[\x20\x09-\x0D]*" + WORD), F.lit(0))
    return F.array_join(F.slice(word, 1, n), "")


def op5_mix_sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The mix of all ``documents``."""
    return mix(table(spark, sf_dir, "documents")).select("doc_id", "size", "source_size", "target", "taken")


#: The same mix in SQL: caps by a recursive query over the sources, prefix sums by windows.
OP5_SQL = r"""
WITH RECURSIVE d AS (
  SELECT doc_id, source, md5(coalesce(text, '')) AS h, len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+'))::BIGINT AS size,
         regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]+', '', 'g') AS solid FROM documents),
k AS (SELECT doc_id, source, size,
         -ln((('0x' || substr(md5(doc_id::VARCHAR || ':' || h || ':7'), 1, 13))::BIGINT::DOUBLE + 0.5) / 4503599627370496.0)
         / CASE WHEN length(solid) = 0 THEN 0.5
           ELSE greatest(0.5, least(2.0, 0.5 + 1.5 * length(regexp_replace(solid, '[\x00-\x40\x5B-\x60\x7B-\x7F]+', '', 'g'))::DOUBLE / length(solid))) END AS key FROM d),
s AS (SELECT source, source_size, [5, 2, 1][((row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3 + 1)::INT] AS weight
      FROM (SELECT source, sum(size)::BIGINT AS source_size FROM d GROUP BY source)),
t AS (SELECT sum(source_size)::DOUBLE AS total FROM s),
r AS (SELECT 0 AS i, 0.0::DOUBLE AS level, -1::BIGINT AS n
      UNION ALL
      SELECT i + 1, ((SELECT total FROM t) - coalesce((SELECT sum(3.0::DOUBLE * source_size) FROM s WHERE weight * level > 3.0::DOUBLE * source_size), 0))
                    / (SELECT sum(weight) FROM s WHERE NOT weight * level > 3.0::DOUBLE * source_size),
             (SELECT count(*) FROM s WHERE weight * level > 3.0::DOUBLE * source_size)
      FROM r WHERE n <> (SELECT count(*) FROM s WHERE weight * level > 3.0::DOUBLE * source_size)),
g AS (SELECT source, source_size, least(weight * (SELECT level FROM r ORDER BY i DESC LIMIT 1), 3.0::DOUBLE * source_size) AS target FROM s),
p AS (SELECT k.doc_id, k.size, g.source_size, g.target, floor(g.target) AS whole,
             coalesce(floor(floor(g.target) / nullif(g.source_size, 0)), 0) AS epochs,
             coalesce(sum(k.size) OVER (PARTITION BY k.source ORDER BY k.key, k.doc_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS before
      FROM k JOIN g ON k.source IS NOT DISTINCT FROM g.source)
SELECT doc_id, size, source_size, target,
       (epochs * size + least(greatest(whole - epochs * source_size - before, 0), size))::BIGINT AS taken FROM p
"""
