"""Language identification by compression: a text belongs to the language whose raw-content dictionary compresses it best."""

from __future__ import annotations

import functools
import re
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import zstandard as zstd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .shared import table

#: Bounds of the labelled sample: texts of each language, and code points taken of each, from a place given by a hash.
TEXTS, SLICE = 192, 512
#: Bytes of text that are compressed at a time; a window costs what its language's dictionary leaves of it.
WINDOW = 1024
#: All dictionaries end with these strings, and shorter windows than SHORT are compressed between them: they cost the same few
#: bytes in each language, and keep short texts compressible, so that sizes tell what the text itself costs.
BEFORE, AFTER, SHORT = bytes(range(200, 232)), bytes(range(160, 192)), 256
#: A prediction is rejected as too narrow where the next best language takes less than this share more bytes.
MARGIN = 0.01
#: More labels than this are no set of languages to hold a dictionary each in memory.
MOST_LANGUAGES = 1000
UNKNOWN = "und"
LETTER = re.compile(r"[^\W\d_]")
#: Runs of bytes that belong to no word: they say nothing of a language.
BETWEEN = re.compile(rb"[\x00-\x60\x7b-\x7f]+")


def has_letter(text: str) -> bool:
    """Does a text hold a Unicode letter? (Word characters that are neither digits nor letters, as roman numerals, don't count.)"""
    return any(m.group().isalpha() for m in LETTER.finditer(text))


@dataclass(frozen=True)
class Model:
    """Language and raw-content dictionary of each, the language with most labelled rows first."""

    languages: tuple[str, ...] = ()
    contents: tuple[bytes, ...] = ()


def letters(text: str) -> bytes:
    """The whole text in lower case as UTF-8, every run of ASCII characters but letters as one blank."""
    return BETWEEN.sub(b" ", text.lower().encode("utf-8", "surrogatepass"))


def compressor(content: bytes):
    how = zstd.ZstdCompressionParameters(
        window_log=18, chain_log=17, hash_log=17, search_log=3, min_match=4, target_length=32, strategy=zstd.STRATEGY_GREEDY,
        format=zstd.FORMAT_ZSTD1_MAGICLESS, write_content_size=False, write_checksum=False, write_dict_id=False)
    dictionary = zstd.ZstdCompressionDict(content, dict_type=zstd.DICT_TYPE_RAWCONTENT)
    dictionary.precompute_compress(compression_params=how)
    return zstd.ZstdCompressor(dict_data=dictionary, compression_params=how).compress


class Identifier:
    """Compressors of all languages, one each in a process."""

    def __init__(self, model: Model) -> None:
        self.languages, self.compress = model.languages, [compressor(c) for c in model.contents]

    def sizes(self, text: str) -> np.ndarray:
        """Compressed bytes of the whole text by each language, summed over its windows."""
        data = letters(text)
        if len(data) < SHORT:
            data = BEFORE + b" " + data + b" " + AFTER
        windows = [data[i : i + WINDOW] for i in range(0, len(data), WINDOW)]
        return np.array([sum(len(c(w)) for w in windows) for c in self.compress], np.int64)

    def __call__(self, text: str | None) -> tuple[str, float, float]:
        """Language, score from 0 to 1 and margin: how many more bytes, as a share, the next best language takes."""
        if text is None or not self.languages or not has_letter(text):
            return UNKNOWN, 0.0, 0.0
        sizes = self.sizes(text)
        best = int(sizes.argmin())  # the first of equal sizes: the one with most labelled rows
        more = (np.delete(sizes, best) - sizes[best]) / float(sizes[best])
        return self.languages[best], float(1.0 / (1.0 + np.exp(-more / MARGIN).sum())), float(more.min(initial=1.0))


@functools.lru_cache(maxsize=2)
def identifier(model: Model) -> Identifier:
    return Identifier(model)


def held_out(doc_id: Column) -> Column:
    return F.coalesce(F.crc32(doc_id.cast("string")) % 5 == 0, F.lit(False))


def fit_on(docs: DataFrame, texts: int = TEXTS, slice_chars: int = SLICE) -> Model:
    """Dictionaries from rows with text, lang and doc_id that are not held out: a bounded sample of each language.

    Of each language the ``texts`` distinct texts first by hash, a slice of ``slice_chars`` code points of each, from a
    place that the hash gives. Rows far from being first are dropped before any ordering, by the language's number of
    rows, so no language's rows meet in one task; a sample of at most languages * texts slices reaches the driver.
    Fewer rows give smaller dictionaries; no rows give a model that knows no language. Raises ValueError for more labels
    than ``MOST_LANGUAGES``.
    """
    usable = F.col("lang").isNotNull() & F.col("text").isNotNull() & F.col("doc_id").isNotNull() & ~held_out(F.col("doc_id"))
    rows = docs.where(usable).select("lang", "text", F.xxhash64("text").alias("spot"))
    counts = rows.groupBy("lang").agg(F.count("*").alias("n"))
    sizes = {r["lang"]: r["n"] for r in counts.limit(MOST_LANGUAGES + 1).collect()}
    if len(sizes) > MOST_LANGUAGES:
        raise ValueError(f"more than {MOST_LANGUAGES} languages")
    if not sizes:
        return Model()
    # Of a language with many rows about 32 * texts are near enough; copies share a spot, so they leave or stay as one.
    share = F.element_at(F.create_map(*[F.lit(x) for lang, n in sizes.items() for x in (lang, min(1.0, 32.0 * texts / n))]), F.col("lang"))
    near = rows.where(F.col("spot").cast("double") <= -(2.0**63) + share * 2.0**64)
    start = 1 + F.pmod(F.col("spot"), F.greatest(F.length("text") - slice_chars, F.lit(0)) + 1)
    near = near.select("lang", "spot", F.substring("text", start.cast("int"), F.lit(slice_chars)).alias("part")).distinct()
    # Few languages keep few rows each by now; the smallest of each are found by partial aggregation.
    first = near.groupBy("lang").agg(F.slice(F.array_sort(F.collect_set(F.struct("spot", "part"))), 1, texts).alias("parts"))
    found = {r["lang"]: [p["part"] for p in r["parts"]] for r in first.collect()}
    languages = sorted(found, key=lambda lang: (-sizes[lang], lang))
    contents = [letters(" ".join(found[lang])) + BEFORE + AFTER for lang in languages]
    return Model(tuple(languages), tuple(contents))


def identify(docs: DataFrame, model: Model, text: str = "text", margin: float = MARGIN, prefix: str = "lang_") -> DataFrame:
    """``docs`` with ``<prefix>pred``, ``<prefix>score``, ``<prefix>margin`` and ``<prefix>rejected``, in place of any of these names.

    The prediction is the learned language that compresses the whole text smallest, ``und`` for null and for texts without
    a letter, or where nothing was learned. rejected: it is ``und``, or the margin to the next best is narrower than
    ``margin``. One narrow pass; equal texts are told alike.
    """
    names = [f"{prefix}{n}" for n in ("pred", "score", "margin", "rejected")]
    rows = docs.select(*[c for c in docs.columns if c.lower() not in [n.lower() for n in names]])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        of = identifier(model)
        for b in batches:
            told = [of(t) for t in b.column(text).to_pylist()]
            lang, score, wide = list(zip(*told, strict=True)) or ((), (), ())
            rejected = [p == UNKNOWN or m < margin for p, m in zip(lang, wide, strict=True)]
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(lang, pa.string()), pa.array(score, pa.float64()), pa.array(wide, pa.float64()), pa.array(rejected, pa.bool_())], names=[*b.schema.names, *names])

    kinds = (T.StringType(), T.DoubleType(), T.DoubleType(), T.BooleanType())
    return rows.mapInArrow(run, T.StructType([*rows.schema.fields, *[T.StructField(n, k) for n, k in zip(names, kinds, strict=True)]]))


def op13_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The language of every whole text of ``documents``; ``rejected`` marks narrow margins."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text", "lang")
    told = identify(docs.select("doc_id", "text"), fit_on(docs))
    return told.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "lang_pred", F.col("lang_score").alias("score"), F.col("lang_margin").alias("margin"), F.col("lang_rejected").alias("rejected"))
