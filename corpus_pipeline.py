"""The corpus pipeline: toxic documents go, near-duplicates go, secrets are redacted, sources are mixed, the rest is packed."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quarry.llm import minhash_dedup, mixing, packing, secret_scan, toxicity
from quarry.llm.shared import materialize, scratch, table, unused


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose score stays under the threshold; the classifier is fitted on labelled rows of ``docs``."""
    model = toxicity.fit_on(docs, table(spark, sf_dir, "labels"))
    name = unused(docs, "toxicity")
    return toxicity.score(docs, model, name=name).where(F.col(name) < toxicity.THRESHOLD).select(*docs.columns)


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near-duplicates: the first by the number that its row gets here.

    Rows are decided on by their own text, so rows that share an id, or have none, go only if their text is a copy or near
    copy of a kept row's. Texts without words stay.
    """
    number = unused(docs, "number")
    rows = materialize(docs.withColumn(number, F.monotonically_increasing_id()), "numbered")
    dropped = minhash_dedup.near_duplicates(rows.select(F.col(number).alias("doc_id"), "text")).where("NOT kept").select(F.col("doc_id").alias(number))
    return rows.join(dropped, number, "left_anti").select(*docs.columns)


def redact_secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, each secret replaced by its kind in brackets."""
    return secret_scan.redact_secrets(docs)


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The mix: documents as often as their source's target takes them."""
    return mixing.mixed_documents(docs)


def pack_lengths(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of all documents, with their text, in length buckets and batches, counted in tokens.

    ``row`` numbers the rows that the mix gave: a document that it took several times is as many rows. The pieces of a row in
    order, joined, are its redacted text, so the result is the corpus itself.
    """
    return packing.pack_texts(docs)


STAGES = [
    ("toxicity", drop_toxic),
    ("near_duplicates", drop_near_duplicates),
    ("secrets", redact_secrets),
    ("mixing", mix_sources),
    ("packing", pack_lengths),
]

#: Training a classifier and compressing windows can't be said in SQL; tests hold the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``; each result is written as Parquet and read again as the next one's input."""
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        path = scratch(spark, f"stage-{name}")
        stage(spark, docs, sf_dir).write.parquet(path)
        docs = spark.read.parquet(path)
    return docs
