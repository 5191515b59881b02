"""Toxicity by compression distance: overlapping windows of words are compressed with two Zstandard dictionaries, trained on
windows of ordinary and of toxic texts; single words also with one of words that tell toxic documents from ordinary ones."""

from __future__ import annotations

import functools
import hashlib
import heapq
import math
from collections import Counter
from collections.abc import Container, Iterable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import zstandard as zstd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .shared import bounded_sample, table

#: Bounds of the labelled sample that a classifier is fitted on: rows of each label, characters of each text.
MAX_TOXIC, MAX_ORDINARY, MAX_CHARS = 2_000, 4_000, 20_000
#: Sizes of the trained dictionaries: of windows of ordinary and of toxic texts, and of the selected words.
ORDINARY_BYTES, TOXIC_BYTES, WORD_BYTES = 8192, 8192, 4096
#: Words of a window, and words between the beginnings of two windows: every word but the first and last few is in two of them.
WINDOW, STEP = 16, 8
#: A dictionary is trained on so many windows at most.
MAX_WINDOWS = 30_000
#: The word dictionary's samples are words of toxic texts with a beginning of so many bytes (the blank included) that toxic
#: documents hold far more often: LEAST_DOCS of them at least, LEAST_RATIO times the share of ordinary ones, and LEAST_WEIGHT
#: for documents times the logarithm of that ratio.
PREFIXES = (5, 6, 7, 8)
LEAST_DOCS, LEAST_RATIO, LEAST_WEIGHT = 3, 4.0, 12.0
#: A word is compressed between two fixed strings that all dictionaries hold: they cost the same few bytes and keep
#: short words compressible, so that the lengths tell what the word itself costs.
BEFORE, AFTER = bytes(range(200, 232)), bytes(range(160, 192))
LONGEST = 64
#: Words whose distances a process remembers.
REMEMBERED = 200_000
THRESHOLD = 0.7
#: Folds of the labelled texts, and the most that a text scores where no classifier can be fitted.
FOLDS, UNKNOWN = 4, 0.5


def words_of(text: str) -> list[bytes]:
    return text.lower().encode("utf-8", "surrogatepass").split()


def parts_of(word: bytes) -> list[bytes]:
    """The word; of a longer one than ``LONGEST`` bytes, its pieces."""
    return [word] if len(word) <= LONGEST else [word[i : i + LONGEST] for i in range(0, len(word), LONGEST)]


def windows_of(words: list[bytes]) -> list[bytes]:
    """Overlapping windows over all words; a shorter text is one window."""
    parts = words if max(map(len, words), default=0) <= LONGEST else [p for w in words for p in parts_of(w)]
    return [b" ".join(parts[i : i + WINDOW]) for i in range(0, max(len(parts) - STEP, min(len(parts), 1)), STEP)]


class Distance:
    """Bytes that a window costs with the ordinary dictionary less those with the toxic one, and the like for single words."""

    def __init__(self, ordinary: bytes, toxic: bytes, words: bytes) -> None:
        self.by_ordinary, self.by_toxic = (self.compressor(d, zstd.STRATEGY_GREEDY) for d in (ordinary, toxic))
        self.by_common, self.by_words = (self.compressor(d + BEFORE + AFTER) for d in (ordinary, ordinary + words))
        self.known: dict[bytes, int] = {}

    @staticmethod
    def compressor(content: bytes, strategy: int = zstd.STRATEGY_LAZY):
        how = zstd.ZstdCompressionParameters(
            window_log=15, chain_log=15, hash_log=13, search_log=4, min_match=4, target_length=64, strategy=strategy,
            format=zstd.FORMAT_ZSTD1_MAGICLESS, write_content_size=False, write_checksum=False, write_dict_id=False)
        dictionary = zstd.ZstdCompressionDict(content, dict_type=zstd.DICT_TYPE_RAWCONTENT)
        dictionary.precompute_compress(compression_params=how)
        return zstd.ZstdCompressor(dict_data=dictionary, compression_params=how).compress

    def word(self, word: bytes) -> int:
        """Of a word; of a longer one than ``LONGEST`` bytes, the largest of its pieces."""
        between = [BEFORE + b" " + p + b" " + AFTER for p in parts_of(word)]
        return max(len(self.by_common(w)) - len(self.by_words(w)) for w in between)

    def windows(self, words: list[bytes]) -> np.ndarray:
        """Of each window of a text, a byte of the window."""
        a, b = self.by_ordinary, self.by_toxic
        return np.array([(len(a(w)) - len(b(w))) / (len(w) + 8) for w in windows_of(words)] or [0.0])

    def features(self, text: str) -> list[float]:
        """Of windows, the mean distance and the largest; of words, the three largest distances and the shares of words with
        at least 2, 3 and 4 bytes; 0 for a text without words."""
        if len(self.known) > REMEMBERED:
            self.known.clear()
        words = words_of(text)
        found = list(map(self.known.get, words))
        if None in found:
            for w in {w for w, d in zip(words, found, strict=True) if d is None}:
                self.known[w] = self.word(w)
            found = [self.known[w] for w in words]
        d = np.array(found or [0], dtype=np.int64)
        top = np.sort(np.partition(d, -3)[-3:])[::-1] if len(d) > 3 else np.sort(d)[::-1]
        top = [*map(float, np.maximum(top, 0)), 0.0, 0.0][:3]
        by_window = self.windows(words)
        return [float(by_window.mean()), float(by_window.max()), *top, *(float(np.count_nonzero(d >= k)) / (len(d) + 20.0) for k in (2, 3, 4))]


def trained(size: int, samples: list[bytes]) -> bytes:
    """A trained dictionary's bytes; where samples are too few to train on, the samples themselves."""
    try:
        return zstd.train_dictionary(size, samples).as_bytes()
    except (zstd.ZstdError, ValueError):
        return b"".join(samples)[-size:]


def first_by_hash(windows: Iterable[tuple[bytes, bytes]], most: int = MAX_WINDOWS) -> list[tuple[bytes, bytes]]:
    """At most ``most`` of all pairs of a hash and a window: the first."""
    return heapq.nsmallest(most, windows)


def prefixes(word: bytes) -> list[bytes]:
    return [(b" " + word + b" ")[:n] for n in PREFIXES]


def documents_with(texts: Iterable[str], among: Container[bytes] | None = None) -> Counter[bytes]:
    """Number of texts with each beginning of a word (of those ``among``)."""
    n: Counter[bytes] = Counter()
    for t in texts:
        found = {p for w in set(words_of(t)) for p in prefixes(w)}
        n.update(found if among is None else (p for p in found if p in among))
    return n


def joined(parts: list[bytes], n: int) -> list[bytes]:
    return [b"".join(parts[i : i + n]) for i in range(0, len(parts), n)]


@dataclass(frozen=True)
class Model:
    """Dictionaries and the calibrated logistic weights; without usable labels, ``share`` is every text's score."""

    ordinary: bytes = b""
    toxic: bytes = b""
    words: bytes = b""
    weights: tuple[float, ...] = ()
    share: float = 0.0

    def scorer(self):
        if not self.weights:
            return lambda text: self.share
        distance, w = Distance(self.ordinary, self.toxic, self.words), np.array(self.weights)
        return lambda text: float(1.0 / (1.0 + math.exp(-max(-60.0, min(60.0, float(np.dot(w[:-1], distance.features(text)) + w[-1]))))))


@functools.lru_cache(maxsize=2)
def scorer(model: Model):
    """One for each worker process, so that its tasks share the distances of words."""
    return model.scorer()


def logistic(x: np.ndarray, y: np.ndarray, weight: np.ndarray, ridge: float = 1e-3, steps: int = 50) -> list[float]:
    """Ridge logistic regression of weighted rows by Newton steps; weights for the plain features, the constant last."""
    mean, spread = x.mean(axis=0), x.std(axis=0) + 1e-9
    z = np.column_stack([(x - mean) / spread, np.ones(len(x))])
    w = np.zeros(z.shape[1])
    penalty = ridge * weight.sum() * np.eye(len(w))
    for _ in range(steps):
        p = 1.0 / (1.0 + np.exp(-np.clip(z @ w, -60, 60)))
        w += np.linalg.solve((z * (weight * p * (1 - p))[:, None]).T @ z + penalty, z.T @ (weight * (y - p)) - penalty @ w)
    plain = w[:-1] / spread
    return [*plain.tolist(), float(w[-1] - plain @ mean)]


class Folds:
    """Labelled texts dealt into folds, and the dictionaries of all folds but one (of all: for None)."""

    def __init__(self, toxic: list[str], ordinary: list[str], n: int) -> None:
        self.n, self.texts = n, [[texts[k::n] for k in range(n)] for texts in (ordinary, toxic)]
        spot = lambda w: hashlib.blake2b(w, digest_size=8).digest()
        of = lambda texts: ((spot(w), w) for t in texts for w in windows_of(words_of(t)))
        self.windows = [[first_by_hash(of(fold)) for fold in folds] for folds in self.texts]
        bad = [documents_with(fold) for fold in self.texts[1]]
        total: Counter[bytes] = Counter()
        for d in bad:
            total.update(d)
        often = {p for p, k in total.items() if k >= LEAST_DOCS}
        self.documents = [[documents_with(fold, often) for fold in self.texts[0]], [Counter({p: k for p, k in d.items() if p in often}) for d in bad]]

    def others(self, apart: int | None) -> list[int]:
        return [k for k in range(self.n) if k != apart]

    def words(self, apart: int | None) -> list[bytes]:
        """All occurrences in toxic texts of words whose first bytes tell toxic from ordinary documents."""
        others = self.others(apart)
        b, a = (sum((d[k] for k in others), Counter()) for d in self.documents)
        n_b, n_a = (sum(len(t[k]) for k in others) for t in self.texts)
        ratio = {p: ((k + 0.5) / (n_a + 1)) / ((b[p] + 0.5) / (n_b + 1)) for p, k in a.items() if k >= LEAST_DOCS}
        telling = {p for p, r in ratio.items() if r >= LEAST_RATIO and a[p] * math.log(r) >= LEAST_WEIGHT}
        found = [w for k in others for t in self.texts[1][k] for w in words_of(t)] if telling else []
        tells = {w for w in set(found) if not telling.isdisjoint(prefixes(w))}
        return [b" " + w.strip(b".,;:!?|") + b" " for w in found if w in tells]

    def dictionaries(self, apart: int | None = None) -> list[bytes]:
        """Of ordinary and of toxic windows, and of the selected words (there may be none)."""
        windows = [[w for _, w in first_by_hash(p for k in self.others(apart) for p in by[k])] for by in self.windows]
        words = self.words(apart)
        np.random.default_rng(1).shuffle(words)
        return [trained(ORDINARY_BYTES, windows[0]), trained(TOXIC_BYTES, windows[1]), trained(WORD_BYTES, joined(words, 8))]


def fit(toxic: list[str], ordinary: list[str], folds: int = FOLDS) -> Model:
    """The calibration sees each text by the dictionaries of the other folds, the model has those of all texts.

    Each fold holds a text of either label, so the same way serves from two distinct texts of each on. With fewer,
    nothing can be held apart: then every text scores the share of toxic ones, or ``UNKNOWN`` where that is less, so
    that no text reaches the threshold.
    """
    unique = lambda texts: list(dict.fromkeys(t for t in texts if t.strip()))  # copies would count their words many times
    toxic, ordinary = unique(toxic), unique(ordinary)
    share = (len(toxic) + 0.5) / (len(toxic) + len(ordinary) + 1.0)
    n = min(folds, len(toxic), len(ordinary))
    if n < 2:
        return Model(share=min(share, UNKNOWN))
    parts = Folds(toxic, ordinary, n)
    x, y = [], []
    for k in range(n):
        distance = Distance(*parts.dictionaries(k))
        for label in (0, 1):
            x += map(distance.features, parts.texts[label][k])
            y += [float(label)] * len(parts.texts[label][k])
    # Where most labels are toxic, either label counts alike: else a text of neither kind would score their share.
    weight = np.where(np.array(y) == 1, min(1.0, len(ordinary) / len(toxic)), 1.0)
    return Model(*parts.dictionaries(), weights=tuple(logistic(np.array(x), np.array(y), weight)))


def held_out(doc_id: Column) -> Column:
    return F.coalesce(F.crc32(doc_id.cast("string")) % 3 == 1, F.lit(False))


def fit_on(docs: DataFrame, labels: DataFrame, max_toxic: int = MAX_TOXIC, max_ordinary: int = MAX_ORDINARY, max_chars: int = MAX_CHARS) -> Model:
    """Fit on a bounded sample of labelled rows that are not held out: the first by a hash of doc_id, of either label.

    Of several labels for one doc_id the largest counts. At most max_toxic + max_ordinary ids are broadcast, and so many
    texts of at most max_chars characters (repeated rows of an id: one of them) meet in one task, where the model is
    fitted; only the model reaches the driver.
    """
    known = labels.where(F.col("toxic").isNotNull() & F.col("doc_id").isNotNull() & ~held_out(F.col("doc_id"))).groupBy("doc_id").agg(F.max("toxic").alias("toxic"))
    ids = bounded_sample(known.where("toxic = 1"), "doc_id", max_toxic).union(bounded_sample(known.where("toxic = 0"), "doc_id", max_ordinary))
    short = docs.select("doc_id", F.substring("text", 1, max_chars).alias("text")).where("text is not null")
    rows = short.join(F.broadcast(ids), "doc_id").groupBy("doc_id", "toxic").agg(F.min("text").alias("text"))
    rows = rows.select("toxic", "text", F.xxhash64("doc_id").alias("spot"), "doc_id").repartition(1).sortWithinPartitions("spot", "doc_id").select("toxic", "text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        found: dict[bool, list[str]] = {True: [], False: []}
        for b in batches:
            for toxic, text in zip(*(b.column(k).to_pylist() for k in (0, 1)), strict=True):
                found[toxic == 1].append(text)
        m = fit(found[True], found[False])
        yield pa.RecordBatch.from_pylist([{"ordinary": m.ordinary, "toxic": m.toxic, "words": m.words, "weights": list(m.weights), "share": m.share}], schema=pa.schema(
            [("ordinary", pa.binary()), ("toxic", pa.binary()), ("words", pa.binary()), ("weights", pa.list_(pa.float64())), ("share", pa.float64())]))

    m = rows.mapInArrow(run, "ordinary binary, toxic binary, words binary, weights array<double>, share double").first()
    if m is None:  # no labelled text at all
        return fit([], [])
    return Model(bytes(m["ordinary"]), bytes(m["toxic"]), bytes(m["words"]), tuple(m["weights"]), m["share"])


def score(docs: DataFrame, model: Model, text: str = "text", name: str = "toxicity") -> DataFrame:
    """``docs`` with a column ``name`` (0 to 1) in place of any of that name; null text is scored as empty.

    One narrow pass; a process remembers the distances of a bounded number of words. Repeated rows score alike.
    """
    kept = [c for c in docs.columns if c.lower() != name.lower()]
    rows = docs.select(*kept)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        of = scorer(model)
        for b in batches:
            scores = pa.array([of(t or "") for t in b.column(text).to_pylist()], pa.float64())
            yield pa.RecordBatch.from_arrays([*b.columns, scores], names=[*b.schema.names, name])

    return rows.mapInArrow(run, T.StructType([*rows.schema.fields, T.StructField(name, T.DoubleType())]))


def op10_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Scores of every whole text of ``documents``; a fixed threshold decides."""
    docs = table(spark, sf_dir, "documents")
    model = fit_on(docs, table(spark, sf_dir, "labels"))
    scored = score(docs.select("doc_id", "text"), model)
    return scored.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), F.col("toxicity").alias("score"), (F.col("toxicity") >= THRESHOLD).cast("int").alias("predicted"))
