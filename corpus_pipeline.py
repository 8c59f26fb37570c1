"""The corpus pipeline: toxicity, line dedup, near-duplicates, mixing, packing.

Every stage takes (spark, docs, sf_dir) and works on all that its predecessor kept. ``run``
writes each stage's result as Parquet to the shared checkpoint folder and reads it again.
"""

from __future__ import annotations

import functools
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from shelfscan.llm import lines, mixing, packing, simhash, toxicity
from shelfscan.llm.settings import MIX, SITE, TOXIC_FROM, VOCABULARY, vocabulary


FIELDS = ("doc_id", "text", "lang", "source", "n_chars")


def _sheltered(stage):
    """A stage that meets columns beside those of documents under names of its own making.

    They come back under the names they had, whatever these are. Empty tables, null columns,
    empty and very long texts, ties and repeated rows go through every stage as its operator
    says.
    """

    @functools.wraps(stage)
    def run(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
        own = {c: f"extra_{i}_" for i, c in enumerate(docs.columns) if c.lower() not in FIELDS}
        done = stage(spark, docs.select(*[F.col(f"`{c}`").alias(own.get(c, c)) for c in docs.columns]), sf_dir)
        return done.select(*[F.col(own.get(c, c)).alias(c) for c in docs.columns])

    return run


@_sheltered
def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose score stays under the limit, as they came; null and empty texts stay."""
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet")
    scored = toxicity.score_toxicity(docs, labels)
    return scored.filter(F.col("score") < TOXIC_FROM).select(*docs.columns)


@_sheltered
def drop_boilerplate(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, without the lines that many sites hold; n_chars follows the text."""
    left = lines.remove_boilerplate(docs, SITE)
    return left.withColumn(
        "n_chars",
        F.when(F.col("n_removed") > 0, F.length("text")).otherwise(F.col("n_chars")).cast("long"),
    ).select(*docs.columns)


@_sheltered
def keep_one_of_each(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each SimHash group: the one with the least doc_id, null ids last.

    Texts of one id that are in different groups each stay; of equal rows one stays.
    """
    return simhash.representatives(docs, width=3, bits=2)


@_sheltered
def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents chosen to the target weights; one row for each time one is used."""
    mixed = mixing.mix(docs, **MIX)
    times = F.explode(F.sequence(F.lit(1), F.col("mix_copies")))
    return mixed.select(*docs.columns, times.alias("mix_time")).drop("mix_time")


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of the documents' tokens with their places in sequences; other columns end here."""
    return packing.pack_documents(docs, vocabulary(VOCABULARY))


STAGES = [
    ("toxicity", drop_toxic),
    ("line_dedup", drop_boilerplate),
    ("simhash_dedup", keep_one_of_each),
    ("mixing", mix_sources),
    ("packing", pack),
]

# Learned scores, fingerprints and token ids are beyond SQL.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    shared = spark.conf.get("spark.checkpoint.dir", None) or tempfile.mkdtemp(prefix="pipeline-")
    folder = f"{shared.rstrip('/')}/pipeline-{uuid.uuid4().hex}"
    for name, stage in STAGES:
        stage(spark, docs, sf_dir).write.parquet(f"{folder}/{name}")
        docs = spark.read.parquet(f"{folder}/{name}")
    return docs
