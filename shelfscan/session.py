"""Session settings the operators are tuned for."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import SparkSession

SETTINGS = {
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    # Page rows carry whole documents: small Arrow batches keep Python workers flat.
    "spark.sql.execution.arrow.maxRecordsPerBatch": "512",
}


def apply_settings(spark: SparkSession) -> SparkSession:
    """Set the run-time options above on an existing session."""
    for key, value in SETTINGS.items():
        spark.conf.set(key, value)
    return spark


def local_session(cores: str | int = "*", partitions: int = 8) -> SparkSession:
    """A session for tests and the benchmark on one machine."""
    builder = (
        SparkSession.builder.master(f"local[{cores}]")
        .appName("shelfscan")
        .config("spark.ui.enabled", "false")
        .config("spark.driver.memory", "12g")
        .config("spark.sql.shuffle.partitions", str(partitions))
    )
    return apply_settings(builder.getOrCreate())


def scratch_folder(spark: SparkSession) -> str:
    """A new folder for written tables, in the shared folder the cluster names.

    Where ``spark.checkpoint.dir`` is unset it is a temporary one on a session of one machine,
    as in tests, and an error on a cluster, whose executors would not see it.
    """
    shared = spark.conf.get("spark.checkpoint.dir", None)
    if shared:
        return f"{shared.rstrip('/')}/shelfscan-{uuid.uuid4().hex}"
    if not spark.sparkContext.master.startswith("local"):
        raise RuntimeError("spark.checkpoint.dir must name a folder that all executors share")
    return tempfile.mkdtemp(prefix="shelfscan-")
