"""Small helpers that the operators of this folder share."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


def documents(spark: SparkSession, sf: str) -> DataFrame:
    return spark.read.parquet(f"{sf}/documents.parquet")


def embeddings(spark: SparkSession, sf: str) -> DataFrame:
    return spark.read.parquet(f"{sf}/embeddings.parquet")


def shared_folder(spark: SparkSession) -> str:
    """The folder for written tables that all executors see."""
    named = spark.conf.get("spark.checkpoint.dir", None)
    if named:
        return named.rstrip("/")
    if not spark.sparkContext.master.startswith("local"):
        raise RuntimeError("spark.checkpoint.dir must name a folder that all executors share")
    return tempfile.mkdtemp(prefix="llm-test-")


def cut(df: DataFrame) -> DataFrame:
    """Compute ``df`` once into the shared checkpoint folder and go on from there.

    The folder is the one that ``spark.checkpoint.dir`` names. Where no folder is set, a
    temporary one is made on a session of one machine, as in tests; on a cluster it is an error. Spark removes checkpoints that are
    no longer referenced if ``spark.cleaner.referenceTracking.cleanCheckpoints`` is on.
    """
    context = df.sparkSession.sparkContext
    if not context.getCheckpointDir():
        context.setCheckpointDir(shared_folder(df.sparkSession))
    return df.checkpoint()


def stored(df: DataFrame) -> DataFrame:
    """As ``cut``, but as a Parquet table: for large inputs, which stay compressed that way."""
    context = df.sparkSession.sparkContext
    if not context.getCheckpointDir():
        cut(df.limit(0))
    path = f"{context.getCheckpointDir().rstrip('/')}/table-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def worker_state(name: str, make):
    """An object that lives as long as the Python worker, so that tasks share caches.

    Functions of this folder travel to workers by value, so their module globals do not
    outlive a task; the attribute of an installed module does.
    """
    import pyspark

    held = pyspark.__dict__.setdefault("_worker_state", {})
    if name not in held:
        held[name] = make()
    return held[name]


def unused(columns: list[str], name: str) -> str:
    """``name`` with as many underscores as it takes to differ from all ``columns``."""
    taken = {c.lower() for c in columns}
    while name.lower() in taken:
        name += "_"
    return name


def inner(docs: DataFrame, without: tuple[str, ...], **more: Column) -> tuple[DataFrame, dict]:
    """``docs`` under names of this folder, so that no column of theirs clashes with inner ones.

    Columns are called in_0_, in_1_, ...; ``more`` are columns computed over ``docs``. Returns the
    rows, and for each column of ``docs`` that is not in ``without`` its inner name.
    """
    names = {c: f"in_{i}_" for i, c in enumerate(docs.columns) if c.lower() not in without}
    rows = docs.select(
        *[F.col(f"`{c}`").alias(n) for c, n in names.items()], *[v.alias(n) for n, v in more.items()]
    )
    return rows, names


def usable(vector: str):
    """True for vectors that are not null, not zero, and hold only finite components."""
    finite = F.forall(vector, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    return F.coalesce(finite & F.exists(vector, lambda x: x != 0), F.lit(False))


def remainder(column: str, divisor: int):
    """crc32 of an id written as text, modulo ``divisor``; null ids count as an empty text."""
    return F.crc32(F.encode(F.coalesce(F.col(column).cast("string"), F.lit("")), "UTF-8")) % divisor
