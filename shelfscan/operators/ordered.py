"""Ordered computations that stay exact and balanced when one key is very large.

A plain window ``PARTITION BY key ORDER BY time`` puts a whole key into one task.
Every function here cuts a key into buckets along its order, works inside the
buckets in parallel, and carries what the earlier buckets contribute (a sum, the
last value, the rows just before) into each of them. Only one row per bucket is
ever ordered within the whole key.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

_BUCKET = "_bucket"
_SEED = "_is_row"

# Map-side pruning of row_number() <= n is Spark's own up to this n
# (spark.sql.optimizer.windowGroupLimitThreshold).
_GROUP_LIMIT = 1000


def join_keys(left: DataFrame, right: DataFrame, keys: Sequence[str], how: str = "inner") -> DataFrame:
    """Join on equal keys where null equals null; the keys appear once."""
    other = right.withColumnsRenamed({k: f"_r_{k}" for k in keys})
    condition = F.lit(True)
    for key in keys:
        condition = condition & F.col(key).eqNullSafe(F.col(f"_r_{key}"))
    joined = left.join(other, condition, how)
    if how in ("full", "right"):
        joined = joined.withColumns({k: F.coalesce(k, f"_r_{k}") for k in keys})
    return joined.drop(*[f"_r_{k}" for k in keys])


def hour_bucket(time: str, hours: int = 1) -> Column:
    """Bucket number of a timestamp column, for the ``bucket`` arguments below."""
    return F.floor(F.unix_micros(F.col(time)) / F.lit(hours * 3_600_000_000)).cast("bigint")


def _seeded(rows: DataFrame, seeds: DataFrame) -> DataFrame:
    return rows.withColumn(_SEED, F.lit(1)).unionByName(
        seeds.withColumn(_SEED, F.lit(0)), allowMissingColumns=True
    )


def running_sums(
    df: DataFrame,
    by: Sequence[str],
    bucket: Column,
    order: Sequence[str],
    values: Mapping[str, Column],
    partitions: int | None = None,
) -> DataFrame:
    """Add inclusive running sums of ``values`` in ``order`` within each key.

    ``bucket`` must not decrease along ``order``. Each bucket starts from a seed
    row that holds the sum of all earlier buckets of the key. ``partitions``: tasks that the
    buckets are dealt to for ordering, where the session's number is too few for the rows.
    """
    rows = df.withColumn(_BUCKET, bucket)
    for name, value in values.items():
        rows = rows.withColumn(name, value.cast("bigint"))
    earlier = Window.partitionBy(*by).orderBy(_BUCKET).rowsBetween(
        Window.unboundedPreceding, -1
    )
    seeds = (
        rows.groupBy(*by, _BUCKET)
        .agg(*[F.sum(name).alias(name) for name in values])
        .withColumns({name: F.sum(name).over(earlier) for name in values})
    )
    inside = Window.partitionBy(*by, _BUCKET).orderBy(_SEED, *order).rowsBetween(
        Window.unboundedPreceding, 0
    )
    seeded = _seeded(rows, seeds)
    if partitions:
        seeded = seeded.repartition(partitions, *by, _BUCKET)
    return (
        seeded
        .withColumns({name: F.coalesce(F.sum(name).over(inside), F.lit(0)) for name in values})
        .filter(F.col(_SEED) == 1)
        .drop(_SEED, _BUCKET)
    )


def carry_forward(
    df: DataFrame,
    by: Sequence[str],
    bucket: Column,
    order: Sequence[str],
    value: str,
) -> DataFrame:
    """Replace nulls of ``value`` by the last non-null one at or before the row."""
    rows = df.withColumn(_BUCKET, bucket)
    earlier = Window.partitionBy(*by).orderBy(_BUCKET).rowsBetween(
        Window.unboundedPreceding, -1
    )
    position = F.when(F.col(value).isNotNull(), F.struct(*order))
    seeds = (
        rows.groupBy(*by, _BUCKET)
        .agg(F.max_by(value, position).alias(value))
        .withColumn(value, F.last(value, ignorenulls=True).over(earlier))
    )
    inside = Window.partitionBy(*by, _BUCKET).orderBy(_SEED, *order).rowsBetween(
        Window.unboundedPreceding, 0
    )
    return (
        _seeded(rows, seeds)
        .withColumn(value, F.last(value, ignorenulls=True).over(inside))
        .filter(F.col(_SEED) == 1)
        .drop(_SEED, _BUCKET)
    )


def rolling(
    df: DataFrame,
    by: Sequence[str],
    bucket: Column,
    order: Sequence[str],
    frames: Mapping[str, tuple[Column, int]],
    block: int = 100_000,
) -> DataFrame:
    """Aggregates over the last *n* rows (current one included) of each key.

    ``frames`` maps an output column to (aggregate, n). Rows are numbered per key,
    cut into blocks of ``block`` rows, and the last rows of a block are repeated in
    the next one, so every frame is complete inside a single block.
    """
    reach = max(n for _, n in frames.values()) - 1
    if reach >= block:
        raise ValueError("block must be larger than the widest frame")
    numbered = running_sums(df, by, bucket, order, {"_n": F.lit(1)})
    index = F.col("_n") - 1
    own = F.floor(index / F.lit(block)).cast("bigint")
    spread = numbered.withColumn("_own", own).withColumn(
        "_block",
        F.explode(
            F.when(index % block >= block - reach, F.array(F.col("_own"), F.col("_own") + 1))
            .otherwise(F.array(F.col("_own")))
        ),
    )
    window = Window.partitionBy(*by, "_block").orderBy("_n")
    return (
        spread.withColumns(
            {name: agg.over(window.rowsBetween(1 - n, 0)) for name, (agg, n) in frames.items()}
        )
        .filter(F.col("_own") == F.col("_block"))
        .drop("_n", "_own", "_block")
    )


def latest_n(
    df: DataFrame,
    by: Sequence[str],
    order: Sequence[str],
    n: int,
    salts: int = 256,
) -> DataFrame:
    """The ``n`` rows of each key that come last in ``order``.

    Up to Spark's group-limit threshold the rank filter already prunes before the
    shuffle; beyond it a salted first pass does the same for hot keys.
    """
    newest = [F.col(c).desc() for c in order]
    if not by:
        return df.orderBy(*newest).limit(n)
    if n > _GROUP_LIMIT:
        salted = df.withColumn("_salt", F.pmod(F.xxhash64(*order), F.lit(salts)))
        first = Window.partitionBy(*by, "_salt").orderBy(*newest)
        df = salted.withColumn("_rank", F.row_number().over(first)).filter(
            F.col("_rank") <= n
        ).drop("_rank", "_salt")
    last = Window.partitionBy(*by).orderBy(*newest)
    return df.withColumn("_rank", F.row_number().over(last)).filter(F.col("_rank") <= n).drop(
        "_rank"
    )


def _value_bucket(value: str) -> Column:
    """Log-linear bucket of a number, non-decreasing in the number."""
    magnitude = F.floor(F.log1p(F.abs(F.col(value)).cast("double")) * 256)
    return (F.signum(F.col(value).cast("double")) * magnitude).cast("int")


def floor_percentiles(
    df: DataFrame,
    by: Sequence[str],
    value: str,
    points: Mapping[str, float],
) -> DataFrame:
    """Exact percentiles at the sorted position ``floor(n * p)`` (zero-based).

    Equal values are counted before the shuffle, bucket totals locate the bucket
    each position falls into, and only the distinct values of those buckets are
    ordered.
    """
    counts = (
        df.filter(F.col(value).isNotNull())
        .groupBy(*by, F.col(value).alias("_v"))
        .agg(F.count("*").alias("_c"))
        .withColumn("_b", _value_bucket("_v"))
    )
    whole = Window.partitionBy(*by)
    upto = whole.orderBy("_b").rowsBetween(Window.unboundedPreceding, 0)
    wanted = F.array(
        *[F.struct(F.lit(name).alias("name"), F.lit(float(p)).alias("p")) for name, p in points.items()]
    )
    targets = (
        counts.groupBy(*by, "_b")
        .agg(F.sum("_c").alias("_bc"))
        .withColumns({"_end": F.sum("_bc").over(upto), "_total": F.sum("_bc").over(whole)})
        .withColumn("_point", F.explode(wanted))
        .withColumn(
            "_at",
            F.least(F.floor(F.col("_total") * F.col("_point.p")), F.col("_total") - 1),
        )
        .filter((F.col("_at") < F.col("_end")) & (F.col("_at") >= F.col("_end") - F.col("_bc")))
        .select(
            *by, "_b", "_at", F.col("_point.name").alias("_name"),
            (F.col("_end") - F.col("_bc")).alias("_start"),
        )
    )
    keys = [*by, "_b"]
    inside = Window.partitionBy(*by, "_b", "_name").orderBy("_v").rowsBetween(
        Window.unboundedPreceding, 0
    )
    found = (
        join_keys(counts, targets, keys)
        .withColumn("_upto", F.col("_start") + F.sum("_c").over(inside))
        .filter((F.col("_at") < F.col("_upto")) & (F.col("_at") >= F.col("_upto") - F.col("_c")))
    )
    return found.groupBy(*by).agg(
        *[F.max(F.when(F.col("_name") == name, F.col("_v"))).alias(name) for name in points]
    )
