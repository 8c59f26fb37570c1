"""Request analytics: totals, recent statistics, period reports, rolling samples.

Canonical columns: ``start_time``, ``end_time`` (timestamp), ``success``,
``response_size``, ``error_type``, ``retry_count`` plus any key columns.
Durations are whole microseconds, so sums are exact and plans may add them up in
any order.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .ordered import (
    carry_forward,
    floor_percentiles,
    hour_bucket,
    join_keys,
    latest_n,
    rolling,
    running_sums,
)

INSUFFICIENT = "Insufficient data for the requested period"


def _mean_ms(total_us: Column, n: Column) -> Column:
    return total_us / n / 1000


def _percent(part: Column, n: Column) -> Column:
    return part / n * 100


def requests_from(df: DataFrame) -> DataFrame:
    """Add ``duration_us`` (exact) and ``duration_ms``."""
    spent = F.unix_micros("end_time") - F.unix_micros("start_time")
    return df.withColumn("duration_us", spent).withColumn(
        "duration_ms", F.col("duration_us") / 1000
    )


def request_ends(events: DataFrame, request_id: str = "request_id") -> DataFrame:
    """One row per request: its start and end, null where that event is not there, and the
    values of the end."""
    ended = F.col("kind") == "end"
    return events.groupBy(request_id).agg(
        F.max(F.when(F.col("kind") == "start", F.col("ts"))).alias("start_time"),
        F.max(F.when(ended, F.col("ts"))).alias("end_time"),
        *[F.max(F.when(ended, F.col(c))).alias(c)
          for c in ("success", "response_size", "error_type", "retry_count")],
    )


def pair_requests(events: DataFrame, request_id: str = "request_id") -> DataFrame:
    """One row per request from its start and end events.

    An end without a start counts as started when it ended; a start without an
    end is still active.
    """
    return with_active(request_ends(events, request_id))


def with_active(ends: DataFrame) -> DataFrame:
    return ends.withColumn("active", F.col("end_time").isNull()).withColumn(
        "start_time", F.coalesce("start_time", "end_time")
    )


def active_requests(
    events: DataFrame, by: Sequence[str], request_id: str = "request_id", bucket: Column | None = None
) -> DataFrame:
    """Requests in flight after each event.

    Starts count +1 and paired ends -1; an end whose start was never seen changes
    nothing.
    """
    known = (
        events.groupBy(*by, request_id)
        .agg(
            F.min(F.when(F.col("kind") == "start", F.col("ts"))).alias("_started"),
            F.max(F.when(F.col("kind") == "end", F.col("ts"))).alias("_ended"),
        )
        .select(
            *by,
            request_id,
            F.explode(
                F.array_compact(
                    F.array(
                        F.when(
                            F.col("_started").isNotNull(),
                            F.struct(F.col("_started").alias("ts"), F.lit(1).alias("step")),
                        ),
                        F.when(
                            F.col("_ended").isNotNull(),
                            F.struct(
                                F.col("_ended").alias("ts"),
                                F.when(F.col("_started").isNotNull(), -1).otherwise(0).alias("step"),
                            ),
                        ),
                    )
                )
            ).alias("_e"),
        )
        .select(*by, request_id, "_e.ts", "_e.step")
        .withColumn("_rank", -F.col("step"))
    )
    return (
        running_sums(
            known, by, bucket if bucket is not None else hour_bucket("ts"),
            ["ts", "_rank", request_id], {"active": F.col("step")},
        )
        .drop("_rank")
    )


def request_totals(
    requests: DataFrame, by: Sequence[str] = ()
) -> DataFrame:
    """Lifetime counters. ``total`` counts starts, the others count ends."""
    ended = F.col("end_time").isNotNull()
    return requests.groupBy(*by).agg(
        F.count_if(F.col("start_time").isNotNull()).alias("total"),
        F.count_if(ended & F.col("success")).alias("successful"),
        F.count_if(ended & ~F.col("success")).alias("failed"),
        F.count_if(~ended).alias("active_requests"),
        F.coalesce(F.sum(F.when(ended, F.col("response_size"))), F.lit(0)).alias(
            "total_bytes_downloaded"
        ),
    )


def keep_latest(
    df: DataFrame, n: int, by: Sequence[str] = (), order: Sequence[str] = ("end_time",)
) -> DataFrame:
    """Bounded history: the last ``n`` rows per key, or of the whole table."""
    return latest_n(df, by, order, n)


def recent_stats(
    requests: DataFrame,
    by: Sequence[str],
    n: int = 100,
    order: Sequence[str] = ("end_time",),
) -> DataFrame:
    """Success rate, mean and 95th percentile over the last ``n`` requests of a key."""
    recent = latest_n(requests_from(requests), by, order, n)
    stats = recent.groupBy(*by).agg(
        F.count("*").alias("requests"),
        _percent(F.count_if("success"), F.count("*")).alias("success_rate_percent"),
        _mean_ms(F.sum("duration_us"), F.count("*")).alias("avg_response_time_ms"),
        # at most n values per key
        F.array_sort(F.collect_list("duration_us")).alias("_sorted"),
    )
    at = F.floor(F.size("_sorted") * F.lit(0.95)).cast("int")
    return stats.withColumn(
        "p95_response_time_ms", F.get("_sorted", at) / 1000
    ).drop("_sorted")


def floor_percentile(
    df: DataFrame, by: Sequence[str], column: str, p: float, name: str = "percentile"
) -> DataFrame:
    """Exact percentile at position ``floor(n * p)`` per key."""
    return floor_percentiles(df, by, column, {name: p})


def _since(time: str, now: str | Column, minutes: int) -> Column:
    moment = F.lit(now).cast("timestamp") if isinstance(now, str) else now
    return F.col(time) >= moment - F.make_dt_interval(mins=F.lit(minutes))


def system_report(
    samples: DataFrame,
    now: str | Column,
    minutes: int = 10,
    by: Sequence[str] = (),
    memory: str = "memory_usage_mb",
    cpu: str = "cpu_percent",
) -> DataFrame:
    """Mean, maximum and minimum of memory and cpu over the period."""
    def mean(c: str) -> Column:
        return F.sum(c).cast("double") / F.count(c)

    return samples.filter(_since("ts", now, minutes)).groupBy(*by).agg(
        F.count("*").alias("snapshots_analyzed"),
        mean(memory).alias("memory_avg_mb"),
        F.max(memory).cast("double").alias("memory_max_mb"),
        F.min(memory).cast("double").alias("memory_min_mb"),
        mean(cpu).alias("cpu_avg_percent"),
        F.max(cpu).cast("double").alias("cpu_max_percent"),
        F.min(cpu).cast("double").alias("cpu_min_percent"),
    )


def request_report(
    requests: DataFrame, now: str | Column, minutes: int = 10, by: Sequence[str] = ()
) -> DataFrame:
    """Counts, success rate and response times of requests started in the period."""
    period = requests_from(requests.filter(_since("start_time", now, minutes)))
    counts = period.groupBy(*by).agg(
        F.count("*").alias("total_requests"),
        F.count_if("success").alias("successful_requests"),
        F.count_if(~F.col("success")).alias("failed_requests"),
        _percent(F.count_if("success"), F.count("*")).alias("success_rate_percent"),
        _mean_ms(F.sum("duration_us"), F.count("*")).alias("avg_ms"),
        (F.min("duration_us") / 1000).alias("min_ms"),
        (F.max("duration_us") / 1000).alias("max_ms"),
    )
    points = floor_percentiles(
        period, by, "duration_us", {"p50": 0.5, "p95": 0.95, "p99": 0.99}
    )
    return join_keys(counts, points, by, "left").select(
        *counts.columns, *[(F.col(p) / 1000).alias(f"{p}_ms") for p in ("p50", "p95", "p99")]
    )


def errors_by_type(requests: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    """Failed requests per error type; a missing or empty type is ``Unknown``."""
    kind = F.coalesce(F.nullif(F.col("error_type"), F.lit("")), F.lit("Unknown"))
    return (
        requests.filter(~F.col("success"))
        .groupBy(*by, kind.alias("error_type"))
        .agg(F.count("*").alias("errors"))
    )


def performance_report(
    samples: DataFrame,
    requests: DataFrame,
    by: Sequence[str],
    now: str | Column,
    minutes: int = 10,
) -> DataFrame:
    """System and request report per key, or an error when one side has no rows.

    ``errors`` maps the error types of the period's failed requests to their numbers; it is
    empty where none failed.
    """
    system = system_report(samples, now, minutes, by)
    traffic = request_report(requests, now, minutes, by)
    # One entry for each type of error.
    errors = errors_by_type(requests.filter(_since("start_time", now, minutes)), by).groupBy(*by).agg(
        F.map_from_entries(F.array_sort(F.collect_list(F.struct("error_type", "errors")))).alias("errors")
    )
    both = join_keys(join_keys(system, traffic, by, "full"), errors, by, "left")
    enough = F.col("snapshots_analyzed").isNotNull() & F.col("total_requests").isNotNull()
    values = [c for c in system.columns + traffic.columns if c not in by]
    none = F.expr("cast(map() as map<string,bigint>)")
    return both.select(
        *by,
        F.lit(minutes).alias("period_minutes"),
        F.when(~enough, F.lit(INSUFFICIENT)).alias("error"),
        *[F.when(enough, F.col(c)).alias(c) for c in values],
        F.when(enough, F.coalesce("errors", none)).alias("errors"),
    )


def current_metrics(
    samples: DataFrame,
    requests: DataFrame,
    by: Sequence[str],
    n: int = 100,
    sample_order: Sequence[str] = ("ts",),
    request_order: Sequence[str] = ("end_time",),
) -> DataFrame:
    """One row per key: newest sample, lifetime totals, and figures of the last ``n`` requests.

    Keys without ended requests have 0 for the latter, keys without samples a null ``system``.
    """
    newest = latest_sample(samples, by, sample_order)
    system = newest.select(*by, F.struct(*[c for c in newest.columns if c not in by]).alias("system"))
    ended = requests.filter(F.col("end_time").isNotNull())
    recent = recent_stats(ended, by, n, request_order).drop("requests")
    joined = join_keys(
        join_keys(system, request_totals(requests, by), by, "full"), recent, by, "left"
    )
    counted = ("total", "successful", "failed", "active_requests", "total_bytes_downloaded")
    figures = ("success_rate_percent", "avg_response_time_ms", "p95_response_time_ms")
    return joined.select(
        *by, "system",
        *[F.coalesce(F.col(c), F.lit(0)).alias(c) for c in counted],
        *[F.coalesce(F.col(c), F.lit(0.0)).alias(c) for c in figures],
    )


def rolling_sample(
    samples: DataFrame,
    requests: DataFrame,
    by: Sequence[str],
    sample_id: str,
    request_id: str,
    bucket_hours: int = 1,
) -> DataFrame:
    """Attach to each sample the state of the requests ended by then.

    Mean duration of the last 10 and success rate of the last 50; 0 ms and 100 %
    before the first request.
    """
    finished = requests_from(requests.filter(F.col("end_time").isNotNull()))
    rolled = rolling(
        finished, by, hour_bucket("end_time", bucket_hours), ["end_time", request_id],
        {
            "_sum10": (F.sum("duration_us"), 10),
            "_n10": (F.count("duration_us"), 10),
            "_ok50": (F.count_if("success"), 50),
            "_n50": (F.count("success"), 50),
        },
    ).select(
        *by,
        F.col("end_time").alias("ts"),
        F.lit(0).alias("_kind"),
        F.col(request_id).alias("_id"),
        F.struct(
            _mean_ms(F.col("_sum10"), F.col("_n10")).alias("response_time_ms"),
            _percent(F.col("_ok50"), F.col("_n50")).alias("success_rate"),
        ).alias("_state"),
    )
    own = samples.select(
        *by, "ts", F.lit(1).alias("_kind"), F.col(sample_id).alias("_id"),
        F.struct(*[c for c in samples.columns if c not in (*by, "ts", sample_id)]).alias("_sample"),
    )
    merged = own.unionByName(rolled, allowMissingColumns=True)
    attached = carry_forward(
        merged, by, hour_bucket("ts", bucket_hours), ["ts", "_kind", "_id"], "_state"
    )
    return attached.filter(F.col("_kind") == 1).select(
        *by, F.col("_id").alias(sample_id), "ts", "_sample.*",
        F.coalesce("_state.response_time_ms", F.lit(0.0)).alias("response_time_ms"),
        F.coalesce("_state.success_rate", F.lit(100.0)).alias("success_rate"),
    )


def uptime(samples: DataFrame, by: Sequence[str] = (), now: str | Column | None = None) -> DataFrame:
    """Seconds from the oldest retained sample to ``now`` (default: the newest one)."""
    moment = F.max("ts") if now is None else F.lit(now).cast("timestamp")
    return samples.groupBy(*by).agg(
        ((F.unix_micros(moment) - F.unix_micros(F.min("ts"))) / 1_000_000).alias("uptime_seconds")
    )


def latest_sample(samples: DataFrame, by: Sequence[str], order: Sequence[str] = ("ts",)) -> DataFrame:
    """The newest sample of each key."""
    rest = [c for c in samples.columns if c not in by]
    return (
        samples.groupBy(*by)
        .agg(F.max_by(F.struct(*rest), F.struct(*order)).alias("_s"))
        .select(*by, "_s.*")
    )
