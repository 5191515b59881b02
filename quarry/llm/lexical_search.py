"""Ranked lexical search by three-phase uniform thresholds (TPUT) over term-partitioned postings."""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .shared import grouped_batches, materialize, release, table

K = 50
#: A term is a run of letters, digits and whatever lies beyond ASCII.
TERM = re.compile(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+")
LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
#: Documents whose postings a task packs at a time; entries of one part of a list; documents of a shard.
PACK, PART, SHARD = 2048, 16384, 4096
#: Distinct query terms, and terms of items in one block of items, that are sent to every task; with more, terms are met by a join, items in blocks.
MOST_TERMS, BLOCK_TERMS = 200_000, 200_000
#: Fixed numbers of the score: partial(tf, m) = UNIT * tf div (1000 * tf + 20 * m).
UNIT = 1_000_000_000


def terms_of(text: str | None) -> list[str]:
    """All terms of a whole text in order; only A-Z are lower-cased."""
    return TERM.findall(text.translate(LOWER)) if text else []


def item_terms(items: DataFrame, id: str, text: str) -> DataFrame:
    """``(item, term)``, each once; rows that share an id are one item, rows without id or text none."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            pairs = [(i, t) for i, text in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True) for t in set(terms_of(text))]
            ids, found = zip(*pairs, strict=True) if pairs else ((), ())
            yield pa.RecordBatch.from_arrays([pa.array(ids, b.schema.field(0).type), pa.array(found, pa.string())], names=["item", "term"])

    kind = items.schema[id].dataType.simpleString()
    return items.where(F.col(id).isNotNull()).select(id, text).mapInArrow(run, f"item {kind}, term string").distinct()


def packed_postings(docs: DataFrame, wanted: frozenset[str] | None, id: str, text: str) -> DataFrame:
    """``(task, term, at, tf, size, ids, n_docs, n_terms)``: a row per term of some documents of one task, its ``at`` their places in
    the task and ``tf``, ``size`` arrays beside; a row without term holds the ids of all these documents and counts."""
    whole = pa.list_(pa.int32())
    kind = docs.schema[id].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        task, place = TaskContext.get().partitionId(), 0
        for full in batches:
            for start in range(0, full.num_rows, PACK):
                b = full.slice(start, PACK)
                lists: dict[str, tuple[list[int], list[int]]] = {}
                sizes = []
                for i, words in enumerate(map(terms_of, b.column(1).to_pylist())):
                    sizes.append(len(words))
                    for term, n in Counter(words if wanted is None else filter(wanted.__contains__, words)).items():
                        at, tf = lists.setdefault(term, ([], []))
                        at.append(i)
                        tf.append(n)
                size = np.array(sizes, np.int32)
                count = len(lists) + 1
                yield pa.RecordBatch.from_arrays([
                    pa.array([task] * count, pa.int64()), pa.array([None, *lists], pa.string()), pa.array([np.arange(len(size)) + place, *(np.array(at) + place for at, _ in lists.values())], whole),
                    pa.array([None, *(tf for _, tf in lists.values())], whole), pa.array([size, *(size[at] for at, _ in lists.values())], whole),
                    pa.array([b.column(0).to_pylist(), *[None] * len(lists)], pa.list_(b.schema.field(0).type)),
                    pa.array([int((size > 0).sum()), *[0] * len(lists)], pa.int64()), pa.array([sum(sizes), *[0] * len(lists)], pa.int64())],
                    names=["task", "term", "at", "tf", "size", "ids", "n_docs", "n_terms"])
                place += len(size)

    return docs.select(id, text).mapInArrow(run, f"task long, term string, at array<int>, tf array<int>, size array<int>, ids array<{kind}>, n_docs long, n_terms long")


def lengths(size: np.ndarray, n: int, total: int) -> np.ndarray:
    """A document's m = 50 + (50 * size * N) div L, in whole numbers also where the product is beyond 64 bits."""
    if len(size) and 50 * int(size.max()) * n >= 1 << 63:
        return np.array([50 + 50 * int(s) * n // total for s in size], np.int64)
    return 50 + 50 * size * n // max(total, 1)


def lists_by_term(packed: DataFrame, weights: DataFrame, n: int, total: int) -> DataFrame:
    """``(term, part, w, rows, scores)``: inverted lists in parts of about ``PART`` entries, by descending partial score.

    A long list, of a word that most documents hold, is as many parts in as many tasks as its length asks.
    """
    spot = F.pmod(F.xxhash64("task", F.get("at", 0)), F.greatest(F.ceil(F.col("df") / PART), F.lit(1))).cast("int")
    dealt = packed.join(weights, "term").select(F.concat_ws(":", "term", spot.cast("string")).alias("key"), "term", "w", spot.alias("part"), "base", "at", "tf", "size").repartition("key").sortWithinPartitions("key")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for t in grouped_batches(batches, "key"):
            rows = flat(t.column("at")) + np.repeat(t.column("base").to_numpy(), counts(t.column("at")))
            tf, m = flat(t.column("tf")).astype(np.int64), lengths(flat(t.column("size")).astype(np.int64), n, total)
            score = UNIT * tf // (1000 * tf + 20 * m)
            keys = t.column("key").combine_chunks().dictionary_encode()
            code = np.repeat(keys.indices.to_numpy(zero_copy_only=False), counts(t.column("at")))
            order = np.lexsort((rows, -score, code))
            ends = np.flatnonzero(np.diff(code[order])) + 1
            first = np.unique(keys.indices.to_numpy(zero_copy_only=False), return_index=True)[1]
            cut = lambda x: np.split(x[order], ends)
            yield pa.RecordBatch.from_arrays([t.column("term").take(first).combine_chunks(), t.column("part").take(first).combine_chunks(), t.column("w").take(first).combine_chunks(),
                pa.array(cut(rows), pa.list_(pa.int64())), pa.array(cut(score.astype(np.int32)), pa.list_(pa.int32()))], names=["term", "part", "w", "rows", "scores"])

    return dealt.mapInArrow(run, "term string, part int, w long, rows array<long>, scores array<int>")


def flat(lists: pa.ChunkedArray) -> np.ndarray:
    return lists.combine_chunks().flatten().to_numpy(zero_copy_only=False)


def counts(lists: pa.ChunkedArray) -> np.ndarray:
    return np.diff(lists.combine_chunks().offsets.to_numpy())


def best(rows: DataFrame, by: str, order: list[Column], k: int, spread: Column) -> DataFrame:
    """The first k rows of each ``by`` with ``rank``, found in two steps, so that one with very many rows isn't ordered in one task."""
    near = rows.withColumn("__s", spread).withColumn("__n", F.row_number().over(Window.partitionBy(by, "__s").orderBy(*order))).where(F.col("__n") <= k).drop("__n", "__s")
    return near.withColumn("rank", F.row_number().over(Window.partitionBy(by).orderBy(*order))).where(F.col("rank") <= k)


@dataclass(frozen=True)
class Item:
    """An item's terms that count, with their weights, its uniform threshold, and a lower bound of its k-th score."""

    id: object
    terms: tuple[str, ...]
    weights: tuple[int, ...]
    threshold: int
    least: int


def scores_in(shard: dict[str, tuple[np.ndarray, np.ndarray]], item: Item, size: int) -> tuple[np.ndarray, np.ndarray]:
    """Partial sums of a shard's documents and the number of entries in them, over entries that reach the item's threshold."""
    total, seen = np.zeros(size, np.int64), np.zeros(size, np.int64)
    for term, w in zip(item.terms, item.weights, strict=True):
        if term in shard:
            at, score = shard[term]
            n = int(np.searchsorted(-score, -(-(-item.threshold // w)), side="right"))  # w * score >= threshold
            total[at[:n]] += w * score[:n]
            seen[at[:n]] += 1
    return total, seen


def shards_of(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[np.ndarray, list, dict[str, tuple[np.ndarray, np.ndarray]]]]:
    """Each shard's rows and ids, and its fetched entries by term: places in the shard and scores, highest first."""
    for b in batches:
        for rows, ids, terms, ends, places, scores in zip(*(b.column(c) for c in ("rows", "ids", "terms", "ends", "places", "scores")), strict=True):
            at, score = np.frombuffer(places.as_py(), np.int32), np.frombuffer(scores.as_py(), np.int32).astype(np.int64)
            cut = ends.values.to_numpy()
            yield rows.values.to_numpy(), ids.as_py(), {t: (at[i:j], score[i:j]) for t, i, j in zip(terms.as_py(), cut, cut[1:], strict=False)}


def gathered(dealt: DataFrame, kind: str) -> DataFrame:
    """A row for each shard: its rows and ids in order, and by term (``ends`` tells where) places and scores, highest score first."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for t in grouped_batches(batches, "shard"):
            numbers = t.column("shard").to_numpy()
            borders = [0, *(np.flatnonzero(np.diff(numbers)) + 1).tolist(), len(numbers)]
            for i, j in zip(borders, borders[1:], strict=False):
                part = t.slice(i, j - i)
                terms = np.array([x or "" for x in part.column("term").to_pylist()], object)
                own = np.array([x is None for x in part.column("term").to_pylist()])
                rows = flat(part.filter(pa.array(own)).column("rows"))
                ids = [x for l in part.filter(pa.array(own)).column("ids").to_pylist() for x in l]
                order = np.argsort(rows)
                rows = rows[order]
                lists = part.filter(pa.array(~own))
                names, code = np.unique(terms[~own].astype(str), return_inverse=True)
                code = np.repeat(code, counts(lists.column("rows")))
                at, score = np.searchsorted(rows, flat(lists.column("rows"))).astype(np.int32), flat(lists.column("scores"))
                down = np.lexsort((-score, code))
                ends = [0, *np.cumsum(np.bincount(code, minlength=len(names))).tolist()]
                yield pa.RecordBatch.from_arrays([pa.array([numbers[i]]), pa.array([rows], pa.list_(pa.int64())), pa.array([[ids[x] for x in order]], t.schema.field("ids").type), pa.array([names.tolist()], pa.list_(pa.string())),
                    pa.array([ends], pa.list_(pa.int64())), pa.array([at[down].tobytes()], pa.binary()), pa.array([score[down].tobytes()], pa.binary())], names=["shard", "rows", "ids", "terms", "ends", "places", "scores"])

    return dealt.mapInArrow(run, f"shard long, rows array<long>, ids array<{kind}>, terms array<string>, ends array<long>, places binary, scores binary")


def rank_documents(docs: DataFrame, items: DataFrame, k: int = K, id: str = "doc_id", text: str = "text", item_id: str = "item_id", item_text: str = "text") -> DataFrame:
    """``(item_id, rank, doc_id, score)``: for each item the k documents of highest positive score, ties to smaller ids.

    Every row of ``docs`` is a document, repeated rows and rows without id too (without id last of equal scores); null and
    empty texts have no terms and count for nothing. Rows of ``items`` with one id are one item; items without terms have
    no rows. Other columns are dropped.

    Postings of the items' terms are packed by term and stored in lists ordered by partial score. 1. The heads of the
    lists, k entries each, give partial sums; the k-th of an item's is a lower bound of its k-th score. 2. An item with m
    lists needs of each the entries of at least a m-th of that bound: a document without any scores less than the bound.
    Every list sends its entries down to the lowest threshold any item sets, once, to shards of documents. There entries that
    reach an item's threshold are summed; the k-th sum over all shards is the better bound, and documents stay candidates whose
    sum, with the threshold less one for every list not seen, reaches it. 3. What candidates lack is looked up in the rest of
    the lists, and exact scores decide.
    """
    spark = docs.sparkSession
    asked = materialize(item_terms(items, item_id, item_text), "item-terms")
    vocabulary = asked.select("term").distinct()
    few = vocabulary.limit(MOST_TERMS + 1).collect()
    wanted = frozenset(r["term"] for r in few) if len(few) <= MOST_TERMS else None
    packed = packed_postings(docs, wanted, id, text)
    raw = materialize(packed if wanted is not None else packed.join(vocabulary.withColumn("asked", F.lit(True)), "term", "left").where("term IS NULL OR asked").drop("asked"), "postings")
    about = raw.where("term IS NULL")
    n, total = about.agg(F.coalesce(F.sum("n_docs"), F.lit(0)), F.coalesce(F.sum("n_terms"), F.lit(0))).first()
    # Rows of all tasks are numbered one after another: a few numbers a task, a table that Spark sizes itself.
    tasks = about.groupBy("task").agg(F.max(F.element_at("at", -1) + 1).alias("n"))
    w_all = Window.orderBy("task").rowsBetween(Window.unboundedPreceding, -1)
    base = materialize(tasks.select("task", F.coalesce(F.sum("n").over(w_all), F.lit(0)).alias("base")), "bases")
    raw_based = raw.join(base, "task")
    df = raw.where("term IS NOT NULL").groupBy("term").agg(F.sum(F.size("at")).alias("df"))
    weight = F.floor(1000 * F.log((F.lit(2.0) * n + 2.0) / (2.0 * F.col("df") + 1.0))).cast("long")
    weights = materialize(df.select("term", "df", weight.alias("w")).where("w > 0"), "weights")  # what weighs nothing adds nothing
    lists = materialize(lists_by_term(raw_based.where("term IS NOT NULL"), weights, n, total), "lists")

    heads = lists.select("term", "w", F.explode(F.arrays_zip(F.slice("rows", 1, k).alias("row"), F.slice("scores", 1, k).alias("score"))).alias("e")).select("term", "w", "e.row", "e.score")
    heads = best(heads, "term", [F.desc("score"), F.col("row")], k, F.pmod(F.xxhash64("row"), F.lit(64)))
    sums = asked.join(heads, "term").groupBy("item", "row").agg(F.sum(F.col("w") * F.col("score")).alias("sum"))
    kth = best(sums, "item", [F.desc("sum")], k, F.pmod(F.xxhash64("row"), F.lit(64))).where(F.col("rank") == k).select("item", F.col("sum").alias("least"))
    known = asked.join(weights, "term").groupBy("item").agg(F.array_sort(F.collect_list(F.struct("term", "w"))).alias("terms")).join(kth, "item", "left")
    known = materialize(known.select("item", "terms", F.coalesce("least", F.lit(1)).alias("least")), "items")

    threshold = F.expr("greatest(least div size(terms) + if(least % size(terms) > 0, 1, 0), 1)")
    needed = known.select(threshold.alias("t"), F.explode("terms").alias("x")).groupBy(F.col("x.term").alias("term")).agg(F.min(F.expr("t div x.w + if(t % x.w > 0, 1, 0)")).alias("from"))
    fetched = lists.join(needed, "term").withColumn("__n", F.size(F.filter("scores", lambda s: s >= F.col("from"))))
    shards = materialize(to_shards(fetched, about.join(base, "task"), docs.schema[id].dataType.simpleString()), "shards")
    rest = fetched.where(F.col("__n") < F.size("rows")).select("term", F.explode(F.arrays_zip(F.expr("slice(rows, __n + 1, size(rows))").alias("row"), F.expr("slice(scores, __n + 1, size(scores))").alias("score"))).alias("e")).select("term", "e.row", "e.score")
    partly = frozenset(r["term"] for r in fetched.where(F.col("__n") < F.size("rows")).select("term").distinct().limit(MOST_TERMS + 1).collect())
    partly = partly if len(partly) <= MOST_TERMS else None

    n_blocks = max(1, -(-(known.agg(F.sum(F.size("terms"))).first()[0] or 0) // BLOCK_TERMS))
    found = []
    for block in range(n_blocks):  # a stated set of items against all rows, in blocks of items
        held = [Item(r["item"], tuple(x["term"] for x in r["terms"]), tuple(x["w"] for x in r["terms"]), max(1, -(-r["least"] // len(r["terms"]))), r["least"]) for r in known.where(F.pmod(F.xxhash64("item"), F.lit(n_blocks)) == block).collect()]
        if held:
            found.append(answers(shards, rest, partly, held, k, known.schema["item"].dataType.simpleString(), docs.schema[id].dataType.simpleString()))
    if not found:
        kinds = f"item_id {known.schema['item'].dataType.simpleString()}, rank int, doc_id {docs.schema[id].dataType.simpleString()}, score long"
        return spark.createDataFrame([], kinds)
    out = found[0]
    for more in found[1:]:
        out = out.unionByName(more)
    release(raw)
    return out


def to_shards(fetched: DataFrame, about: DataFrame, kind: str) -> DataFrame:
    """The fetched entries of all lists, gathered by shards of documents; a list's part leaves as one piece a shard."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            out: list[tuple] = []
            for term, rows, scores, n in zip(b.column("term").to_pylist(), b.column("rows"), b.column("scores"), b.column("__n").to_pylist(), strict=True):
                at, score = rows.values.to_numpy()[:n], scores.values.to_numpy()[:n]
                shard = at // SHARD
                order = np.argsort(shard, kind="stable")
                ends = np.flatnonzero(np.diff(shard[order])) + 1
                out += [(int(shard[p[0]]), term, at[p], score[p]) for p in np.split(order, ends) if len(p)]
            columns = list(zip(*out, strict=True)) or [()] * 4
            yield pa.RecordBatch.from_arrays([pa.array(columns[0], pa.int64()), pa.array(columns[1], pa.string()), pa.array(columns[2], pa.list_(pa.int64())), pa.array(columns[3], pa.list_(pa.int32()))], names=["shard", "term", "rows", "scores"])

    entries = fetched.select("term", "rows", "scores", "__n").mapInArrow(run, "shard long, term string, rows array<long>, scores array<int>")
    own = about.select("base", F.explode(F.arrays_zip(F.col("at").alias("at"), F.col("ids").alias("id"))).alias("e")).select((F.col("base") + F.col("e.at")).alias("row"), "e.id")
    groups = own.groupBy(F.expr(f"row div {SHARD}").alias("shard")).agg(F.collect_list(F.struct("row", "id")).alias("x"))
    members = groups.select("shard", F.lit(None).cast("string").alias("term"), F.col("x.row").alias("rows"), F.lit(None).cast("array<int>").alias("scores"), F.col("x.id").alias("ids"))
    both = entries.withColumn("ids", F.lit(None).cast(f"array<{kind}>")).unionByName(members)
    return gathered(both.repartition("shard").sortWithinPartitions("shard"), kind)


def answers(shards: DataFrame, rest: DataFrame, partly: frozenset[str] | None, items: list[Item], k: int, item_kind: str, id_kind: str) -> DataFrame:
    """The k best documents of each of ``items``: bounds from the shards, then look-ups for what stays."""

    def sums(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows, _, shard in shards_of(batches):
            out = []
            for number, item in enumerate(items):
                total, _ = scores_in(shard, item, len(rows))
                top = np.sort(total[total >= item.least])[::-1][:k]
                out += [(number, int(s)) for s in top]
            columns = list(zip(*out, strict=True)) or [()] * 2
            yield pa.RecordBatch.from_arrays([pa.array(columns[0], pa.int32()), pa.array(columns[1], pa.int64())], names=["number", "sum"])

    top = shards.mapInArrow(sums, "number int, sum long")
    kth = best(top, "number", [F.desc("sum")], k, F.pmod(F.xxhash64("sum"), F.lit(64))).where(F.col("rank") == k)
    least = {r["number"]: r["sum"] for r in kth.collect()}  # a number for each item of the block
    bounds = [max(item.least, least.get(i, 1)) for i, item in enumerate(items)]

    def candidates(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows, ids, shard in shards_of(batches):
            for number, item in enumerate(items):
                total, n = scores_in(shard, item, len(rows))
                here = np.flatnonzero((n > 0) & (total + (item.threshold - 1) * (len(item.terms) - n) >= bounds[number]))
                if not len(here):
                    continue
                place = np.full(len(rows), -1)
                place[here] = np.arange(len(here))
                exact, lacks = np.zeros(len(here), np.int64), [[] for _ in here]
                for term, w in zip(item.terms, item.weights, strict=True):
                    at, score = shard.get(term, (np.zeros(0, np.int64), np.zeros(0, np.int64)))
                    mine = place[at]
                    exact[mine[mine >= 0]] += w * score[mine >= 0]
                    if partly is None or term in partly:  # part of this list stayed behind
                        for i in np.setdiff1d(np.arange(len(here)), mine):
                            lacks[i].append(term)
                yield pa.RecordBatch.from_arrays([pa.array([number] * len(here), pa.int32()), pa.array(rows[here]), pa.array([ids[i] for i in here], id_type), pa.array(exact), pa.array(lacks, pa.list_(pa.string()))],
                    names=["number", "row", "doc_id", "score", "lacks"])

    id_type = pa.from_numpy_dtype({"bigint": "int64", "int": "int32"}[id_kind]) if id_kind in ("bigint", "int") else pa.string()
    stay = materialize(shards.mapInArrow(candidates, f"number int, row long, doc_id {id_kind}, score long, lacks array<string>"), "candidates")
    told = shards.sparkSession.createDataFrame([(n, i.id, t, w) for n, i in enumerate(items) for t, w in zip(i.terms, i.weights, strict=True)], f"number int, item_id {item_kind}, term string, w long")
    ask = stay.select("number", "row", F.explode("lacks").alias("term"))
    more = ask.join(rest, ["term", "row"]).join(told, ["number", "term"]).groupBy("number", "row").agg(F.sum(F.col("w") * F.col("score")).alias("more"))
    exact = stay.join(more, ["number", "row"], "left").select("number", "row", "doc_id", (F.col("score") + F.coalesce("more", F.lit(0))).alias("score")).where("score > 0")
    first = best(exact, "number", [F.desc("score"), F.asc_nulls_last("doc_id")], k, F.pmod(F.xxhash64("row"), F.lit(256)))
    return first.join(told.select("number", "item_id").distinct(), "number").select("item_id", "rank", "doc_id", "score")


def op11_lexical_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The fifty best of all ``documents`` for each item of ``benchmark``."""
    return rank_documents(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


_TERMS = r"regexp_extract_all(translate({}, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+')"
OP11_SQL = f"""
WITH d AS MATERIALIZED (SELECT row_number() OVER () AS r, doc_id, {_TERMS.format("coalesce(text, '')")} AS t FROM documents),
c AS (SELECT (count(*) FILTER (len(t) > 0))::BIGINT AS n, sum(len(t))::BIGINT AS l FROM d),
q AS (SELECT DISTINCT item_id, unnest({_TERMS.format("text")}) AS term FROM benchmark WHERE item_id IS NOT NULL),
p AS (SELECT r, term, count(*)::BIGINT AS tf FROM (SELECT r, unnest(t) AS term FROM d) WHERE term IN (SELECT term FROM q) GROUP BY r, term),
w AS (SELECT term, floor(1000 * ln((2 * n + 2)::DOUBLE / (2 * count(*) + 1)::DOUBLE))::BIGINT AS w FROM p, c GROUP BY term, n),
m AS (SELECT r, doc_id, 50 + ((50 * len(t)::BIGINT * n) // greatest(l, 1)) AS m FROM d, c),
s AS (SELECT item_id, m.r, doc_id, sum(w * ((1000000000 * tf) // (1000 * tf + 20 * m)))::BIGINT AS score
      FROM q JOIN p USING (term) JOIN w USING (term) JOIN m ON p.r = m.r GROUP BY ALL),
k AS (SELECT *, row_number() OVER (PARTITION BY item_id ORDER BY score DESC, doc_id NULLS LAST)::INT AS rank FROM s WHERE score > 0)
SELECT item_id, rank, doc_id, score FROM k WHERE rank <= 50
"""
