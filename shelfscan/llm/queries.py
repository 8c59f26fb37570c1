"""Registered queries of this folder; their SQL is in ``oracles``."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import (
    classlm,
    credentials,
    hnsw,
    lines,
    mixing,
    neighbours,
    packing,
    passages,
    sharding,
    shared,
    simhash,
    spelling,
    toxicity,
    whitening,
)
from .oracles import ORACLES  # noqa: F401
from .settings import MIX, SHARDS, SITE, TOXIC_FROM, VOCABULARY, vocabulary
from .shared import documents, embeddings, remainder

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}


def _registered(function):
    QUERIES[function.__name__] = function
    return function


@_registered
def op2_mixing(spark: SparkSession, sf: str) -> DataFrame:
    """Chosen documents with their leaf, tokens and number of copies."""
    mixed = mixing.mix(documents(spark, sf), **MIX)
    return mixed.select(
        "doc_id",
        F.col("mix_0").alias("domain"),
        F.col("mix_1").alias("language"),
        F.col("mix_2").alias("leaf"),
        "mix_tokens",
        "mix_copies",
    )


@_registered
def op3_simhash(spark: SparkSession, sf: str) -> DataFrame:
    found = simhash.near_duplicates(documents(spark, sf), width=3, bits=2)
    return found.withColumn("fingerprint", F.lower(F.lpad(F.hex("fingerprint"), 16, "0")))


@_registered
def op6_packing(spark: SparkSession, sf: str) -> DataFrame:
    return packing.pack_documents(documents(spark, sf), vocabulary(VOCABULARY), 4096, 1)


@_registered
def op8_secrets(spark: SparkSession, sf: str) -> DataFrame:
    found = credentials.find_secrets(documents(spark, sf), repository=f"concat(lang, '/', {SITE})", owner=SITE)

    def joined(spans):
        part = F.transform(
            spans,
            lambda s: F.concat_ws(
                ":",
                F.element_at(F.array(*map(F.lit, credentials.KINDS)), s["kind"] + 1),
                s["start"].cast("string"),
                s["end"].cast("string"),
            ),
        )
        return F.array_join(part, ",")

    base = F.filter("spans", lambda s: s["kind"] < 3)

    def number(kind):
        return F.size(F.filter("spans", lambda s: s["kind"] == kind)).cast("long")

    counts = [number(k).alias(f"n_{name}") for k, name in enumerate(credentials.KINDS[:3])]
    live = F.size(F.filter("spans", lambda s: s["verdict"] == "live")).cast("long")
    return found.select(
        "doc_id",
        *counts,
        F.sha2(joined(base), 256).alias("base_sha256"),
        joined(F.col("spans")).alias("spans"),
        live.alias("n_live"),
    )


@_registered
def op10_line_dedup(spark: SparkSession, sf: str) -> DataFrame:
    return lines.remove_boilerplate(documents(spark, sf), SITE).select(
        "doc_id", "text", "n_lines", "n_removed"
    )


@_registered
def op9_toxicity(spark: SparkSession, sf: str) -> DataFrame:
    """Scores of all documents; rows with remainder 1 are never learned from."""
    labels = spark.read.parquet(f"{sf}/labels.parquet").filter(remainder("doc_id", 3) != 1)
    found = toxicity.score_toxicity(documents(spark, sf).select("doc_id", "text"), labels)
    return found.select(
        "doc_id",
        (remainder("doc_id", 3) == 1).alias("held_out"),
        "score",
        (F.col("score") >= TOXIC_FROM).cast("int").alias("predicted"),
    )


@_registered
def op5_class_lm(spark: SparkSession, sf: str) -> DataFrame:
    """Scores of all documents by a model of those that are not held out."""
    docs = documents(spark, sf).select("doc_id", "text")
    model = classlm.train(docs.filter(remainder("doc_id", 5) != 1))
    return classlm.score(docs, model).select(
        "doc_id",
        (remainder("doc_id", 5) == 1).alias("held_out"),
        "n_tokens",
        "n_known",
        F.lit(model.total).cast("long").alias("train_tokens"),
        "base_score",
        "score",
    )


@_registered
def op7_projection_dedup(spark: SparkSession, sf: str) -> DataFrame:
    return neighbours.near_duplicates(embeddings(spark, sf), threshold=0.93)


@_registered
def op1_hnsw(spark: SparkSession, sf: str) -> DataFrame:
    """20 nearest of every twentieth vector, among all others."""
    vectors = embeddings(spark, sf)
    index = hnsw.build_index(vectors, "vec_id", "embedding", copies=21)
    asked = vectors.filter(F.col("vec_id") % 20 == 0)
    found = hnsw.search(shared.cut(index), asked, "vec_id", "embedding", k=20)
    return found.select("query_id", "rank", F.col("id").alias("vec_id"), "score")


@_registered
def op4_passages(spark: SparkSession, sf: str) -> DataFrame:
    return passages.shared_passages(documents(spark, sf))


@_registered
def op13_sharding(spark: SparkSession, sf: str) -> DataFrame:
    """Shard and slot of every document; shards differ by at most one row."""
    text = F.coalesce("text", F.lit(""))
    rows = documents(spark, sf).select(
        "doc_id",
        (F.octet_length(text) + F.lit(1).cast("long")).alias("size"),
        F.crc32(F.encode(text, "UTF-8")).alias("text_crc32"),
    )
    placed = sharding.assign(rows, **SHARDS, order=("doc_id", "size", "text_crc32"))
    return placed.select(
        "doc_id",
        "size",
        "text_crc32",
        F.lit("rows").alias("law"),
        "shard",
        "slot",
        F.lit(None).cast("int").alias("grown_shard"),
        "shard_row",
    )


@_registered
def op12_whitening(spark: SparkSession, sf: str) -> DataFrame:
    """Up to eight whitened components of every vector, fitted on all of them."""
    vectors = embeddings(spark, sf).select("vec_id", "embedding")
    model = whitening.fit(vectors)
    error = whitening.identity_error(vectors, model)
    found = whitening.whiten(vectors, model)
    parts = model.variances[:8] / max(model.variances.sum(), 1e-300)
    explained = F.array(*[F.lit(float(x)) for x in parts]).cast("array<double>")
    return found.select(
        "vec_id", "deviation", F.posexplode("whitened").alias("at", "whitened")
    ).select(
        "vec_id",
        (F.col("at") + 1).alias("component"),
        F.lit(model.n).cast("long").alias("n"),
        "deviation",
        "whitened",
        F.element_at(explained, F.col("at") + 1).alias("explained"),
        F.lit(error).cast("double").alias("identity_error"),
    )


@_registered
def op11_spelling(spark: SparkSession, sf: str) -> DataFrame:
    """Every word of six letters and five occurrences with its form and root."""
    words = spelling.count_words(documents(spark, sf), drop_every=199, min_length=6, min_count=5)
    return spelling.variants(words, times=5)
