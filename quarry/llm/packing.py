"""Packing: optimal length buckets by dynamic programming over the global histogram, token-budget batches inside them."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .shared import materialize, table
from .token_counts import VOCABULARY, count_tokens, counter, proven_whole_tokens, vocabulary_path

#: Longest sequence in tokens; longer documents are cut into pieces of this length and a rest, so the histogram has so many bars at most.
MAX_LEN = 2048
BUCKETS = 8
#: Padded tokens of one batch.
BUDGET = 65_536
SHARDS = 2048


def optimal_boundaries(histogram: dict[int, int], buckets: int) -> list[int]:
    """Upper bounds of at most ``buckets`` length buckets with the least total padding over ``{length: count}``.

    Exact: cost(i, j) of padding lengths i+1..j to length j comes from prefix sums, and best[k][j] = min over i of
    best[k-1][i] + cost(i, j), one vectorised row at a time: O(buckets * distinct lengths squared).
    """
    lengths = sorted(n for n, c in histogram.items() if n > 0 and c > 0)
    if not lengths:
        return []
    size = np.array([0, *lengths], dtype=np.float64)
    count = np.array([0, *[histogram[n] for n in lengths]], dtype=np.float64)
    rows, units = np.cumsum(count), np.cumsum(count * size)
    m = len(lengths)
    best = np.full(m + 1, np.inf)
    best[0] = 0.0
    back = []
    for _ in range(min(buckets, m)):
        now, come = best.copy(), np.arange(m + 1)
        for j in range(1, m + 1):
            pad = best[:j] + size[j] * (rows[j] - rows[:j]) - (units[j] - units[:j])
            i = int(np.argmin(pad))
            now[j], come[j] = pad[i], i
        now[0] = 0.0
        back.append(come)
        best = now
    bounds, j = [], m
    for come in reversed(back):
        if j == 0:
            break
        bounds.append(lengths[j - 1])
        j = int(come[j])
    return bounds[::-1]


def pieces(docs: DataFrame, length: Column, max_len: int, *keep: str) -> DataFrame:
    """A row for each piece of at most ``max_len`` units: ``keep``, piece, start, n_units; a document of 0 units has one piece of 0."""
    df = docs.select(*keep, F.coalesce(length, F.lit(0)).cast("long").alias("__n"))
    df = df.withColumn("piece", F.explode(F.sequence(F.lit(0), F.greatest(F.ceil(F.col("__n") / max_len) - 1, F.lit(0)).cast("int"))))
    start = F.col("piece").cast("long") * max_len
    return df.select(*keep, "piece", start.alias("start"), F.least(F.col("__n") - start, F.lit(max_len)).cast("int").alias("n_units"))


def pack(docs: DataFrame, length: Column, max_len: int = MAX_LEN, buckets: int = BUCKETS, budget: int = BUDGET, shards: int = SHARDS, keep: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """Pieces with their bucket and batch: ``keep``, piece, start, n_units, bucket_len, batch_id, padding.

    ``length`` counts a row's units (words or tokens; null is 0). The histogram of piece lengths covers all rows and has
    at most ``max_len`` bars, which is what reaches the driver. Batches hold budget // bucket_len pieces of one bucket,
    and only a bucket's last batch may hold fewer. A piece of 0 units has bucket_len 0 and a null batch_id: it needs no
    place. Repeated rows are packed as often as they come.

    Positions inside a bucket are counted per shard and shifted by the shards before it, so a bucket with most of the rows
    is never in one task; the shifts are buckets * shards numbers at most. The shard is a hash of the piece's row, moved on
    by its place among the rows read, so that repeated rows (or ids, or null ids) are dealt out too; it is stored before it is used.
    """
    rows = materialize(pieces(docs, length, max_len, *keep).withColumn("__shard", shard_of(keep, shards)), "pieces")
    return placed(rows, buckets, budget, keep)


def shard_of(keep: tuple[str, ...], shards: int) -> Column:
    return F.pmod(F.xxhash64(*keep, "piece", "n_units") + F.monotonically_increasing_id() % shards, F.lit(shards)).cast("int")


def placed(rows: DataFrame, buckets: int, budget: int, keep: tuple[str, ...]) -> DataFrame:
    """Stored pieces with ``__shard`` placed in buckets and batches, as ``pack`` says."""
    histogram = {r["n_units"]: r["count"] for r in rows.where("n_units > 0").groupBy("n_units").count().collect()}
    bounds = optimal_boundaries(histogram, buckets)
    bucket = F.array_min(F.filter(F.array(*[F.lit(b) for b in bounds]) if bounds else F.array().cast("array<int>"), lambda b: b >= F.col("n_units")))
    rows = rows.withColumn("bucket_len", F.when(F.col("n_units") > 0, bucket).otherwise(0).cast("int"))
    sums = rows.groupBy("bucket_len", "__shard").agg(F.count("*").alias("__c"))
    ahead = F.coalesce(F.sum("__c").over(Window.partitionBy("bucket_len").orderBy("__shard").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    sums = sums.select(F.col("bucket_len").alias("__b"), F.col("__shard").alias("__s"), ahead.alias("__ahead"))
    place = F.row_number().over(Window.partitionBy("__shard", "bucket_len").orderBy(*keep, "piece")) - 1
    rows = rows.withColumn("__place", place).join(sums, (F.col("__shard") == F.col("__s")) & (F.col("bucket_len") == F.col("__b")))
    capacity = F.greatest(F.floor(F.lit(budget) / F.col("bucket_len")), F.lit(1))
    batch = F.when(F.col("n_units") > 0, F.floor((F.col("__ahead") + F.col("__place")) / capacity))
    return rows.select(*keep, "piece", "start", "n_units", "bucket_len", batch.cast("long").alias("batch_id"), (F.col("bucket_len") - F.col("n_units")).alias("padding"))


def pack_tokens(docs: DataFrame, **how) -> DataFrame:
    """``pack`` by the tokens of ``text``: start is a token position, n_units counts tokens, and the budget holds for tokens."""
    keep = how.get("keep", ("doc_id",))
    return pack(count_tokens(docs, keep=keep), F.col("n_tokens"), **how)


def pack_texts(docs: DataFrame, text: str = "text", max_len: int = MAX_LEN, buckets: int = BUCKETS, budget: int = BUDGET, shards: int = SHARDS, keep: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """``pack_tokens`` with what is packed: ``keep``, row, piece, start, n_units, bucket_len, batch_id, padding, text.

    ``row`` numbers the rows of ``docs``, so that rows that share an id stay apart; a row's pieces in order, joined, are its
    whole text (null as empty). A long text is cut at every ``max_len``-th token; where such a token begins inside a
    character, before that character. Places are found on narrow rows; texts are shuffled once, to meet them.
    """
    number = docs.withColumn("__row", F.monotonically_increasing_id()).select(*keep, F.col("__row").alias("row"), F.coalesce(F.col(text), F.lit("")).alias("__text"))
    cut = materialize(cut_texts(number, max_len).withColumn("__shard", shard_of((*keep, "row"), shards)), "pieces")
    where = placed(cut.drop("text"), buckets, budget, (*keep, "row"))
    return where.join(cut.select(F.col("row").alias("__r"), F.col("piece").alias("__p"), "text"), (F.col("row") == F.col("__r")) & (F.col("piece") == F.col("__p"))).drop("__r", "__p")


def cut_texts(rows: DataFrame, max_len: int, vocabulary: str = VOCABULARY) -> DataFrame:
    """A row for each piece of ``__text``: the other columns, piece, start, n_units, text. Only texts of more tokens are encoded whole."""
    from tokenizers import Tokenizer

    whole = rows.sparkSession.sparkContext.broadcast(proven_whole_tokens(Tokenizer.from_file(vocabulary_path(vocabulary))))
    kept = [f for f in rows.schema.fields if f.name != "__text"]
    schema = T.StructType([*kept, T.StructField("piece", T.IntegerType()), T.StructField("start", T.LongType()), T.StructField("n_units", T.IntegerType()), T.StructField("text", T.StringType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        of = counter(vocabulary, whole.value)
        for full in batches:
            for at in range(0, full.num_rows, 256):
                b = full.slice(at, 256)
                source, piece, units, texts = [], [], [], []
                for i, told in enumerate(b.column("__text").to_pylist()):
                    n = of.count(told)
                    parts = [told] if n <= max_len else pieces_of(told, of.token_bytes(told), max_len)
                    for k, part in enumerate(parts):
                        source.append(i)
                        piece.append(k)
                        units.append(min(n - k * max_len, max_len))
                        texts.append(part)
                whose = pa.array(source, pa.int64())
                columns = [b.column(f.name).take(whose) for f in kept]
                yield pa.RecordBatch.from_arrays([*columns, pa.array(piece, pa.int32()), pa.array([k * max_len for k in piece], pa.int64()), pa.array(units, pa.int32()), pa.array(texts, pa.string())], names=schema.names)

    return rows.mapInArrow(run, schema)


def pieces_of(text: str, sizes: list[int], max_len: int) -> list[str]:
    """The text cut before every ``max_len``-th token, by the tokens' bytes; never inside a character."""
    data, ends, out, begin = text.encode("utf-8", "surrogatepass"), np.cumsum(sizes), [], 0
    for i in range(max_len, len(sizes), max_len):
        end = int(ends[i - 1])
        while end > begin and data[end] & 0xC0 == 0x80:  # a byte inside a character
            end -= 1
        out.append(data[begin:end].decode("utf-8", "surrogatepass"))
        begin = end
    return [*out, data[begin:].decode("utf-8", "surrogatepass")]


def op1_length_buckets(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pieces of all ``documents`` in length buckets and batches; the unit is the token."""
    return pack_tokens(table(spark, sf_dir, "documents"))
