"""Request analytics (Q) on the requests, samples and events tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from shelfscan.operators import requests as rq

from . import query
from .views import micros, request_events, requests, rolled_samples, samples, with_views

NOW = "2024-01-31 00:00:00"
MINUTES = 15 * 24 * 60
CUTOFF = "epoch_us(timestamp '2024-01-31 00:00:00' - interval '21600 minutes')"


@query("q1_requests_from", with_views("""
select request_id, start_us, end_us, duration_us, duration_us / 1000 as duration_ms, success
from requests""", "requests"))
def _(spark, sf):
    return rq.requests_from(requests(spark, sf)).select(
        "request_id", micros("start_time").alias("start_us"), micros("end_time").alias("end_us"),
        "duration_us", "duration_ms", "success",
    )


@query("q2_pair_requests", with_views("""
select request_id,
  coalesce(max(ts_us) filter (kind = 'start'), max(ts_us) filter (kind = 'end')) as start_us,
  max(ts_us) filter (kind = 'end') as end_us,
  bool_or(success) filter (kind = 'end') as success,
  max(response_size) filter (kind = 'end') as response_size,
  max(error_type) filter (kind = 'end') as error_type,
  max(retry_count) filter (kind = 'end') as retry_count,
  count(*) filter (kind = 'end') = 0 as active
from request_events group by request_id""", "request_events"))
def _(spark, sf):
    return rq.pair_requests(request_events(spark, sf)).select(
        "request_id", micros("start_time").alias("start_us"), micros("end_time").alias("end_us"),
        "success", "response_size", "error_type", "retry_count", "active",
    )


@query("q3_active_requests", with_views("""
select request_id, host, ts_us, step, cast(sum(step) over (partition by host
  order by ts_us, -step, request_id rows unbounded preceding) as bigint) as active
from (select request_id, host, ts_us,
        case when kind = 'start' then 1
             when count(*) filter (kind = 'start') over (partition by request_id) > 0 then -1
             else 0 end as step
      from request_events)""", "request_events"))
def _(spark, sf):
    out = rq.active_requests(request_events(spark, sf), ["host"])
    return out.select("request_id", "host", micros("ts").alias("ts_us"), "step", "active")


@query("q4_request_totals", with_views("""
with paired as (select request_id, host, count(*) filter (kind = 'end') as ends,
    bool_or(success) as success, max(response_size) as response_size
  from request_events group by request_id, host)
select host, count(*) as total, count(*) filter (ends > 0 and success) as successful,
  count(*) filter (ends > 0 and not success) as failed,
  count(*) filter (ends = 0) as active_requests,
  cast(coalesce(sum(response_size) filter (ends > 0), 0) as bigint) as total_bytes_downloaded
from paired group by host""", "request_events"))
def _(spark, sf):
    events = request_events(spark, sf)
    return rq.request_totals(
        rq.pair_requests(events.withColumn("request_id", F.struct("host", "request_id")))
        .withColumn("host", F.col("request_id.host")),
        ["host"],
    )


@query("q5_recent_stats", with_views("""
with last100 as (select * from requests qualify
    row_number() over (partition by host order by end_us desc, request_id desc) <= 100),
ranked as (select *, row_number() over (partition by host order by duration_us) - 1 as pos,
    count(*) over (partition by host) as n from last100)
select host, count(*) as requests,
  count(*) filter (success) / count(*) * 100 as success_rate_percent,
  sum(duration_us) / count(*) / 1000 as avg_response_time_ms,
  max(duration_us) filter (pos = cast(floor(n * 0.95::double) as bigint)) / 1000 as p95_response_time_ms
from ranked group by host""", "requests"))
def _(spark, sf):
    return rq.recent_stats(requests(spark, sf), ["host"], 100, ["end_time", "request_id"])


@query("q6_system_report", with_views(f"""
select host, count(*) as snapshots_analyzed,
  sum(memory_usage_mb)::double / count(*) as memory_avg_mb,
  max(memory_usage_mb)::double as memory_max_mb, min(memory_usage_mb)::double as memory_min_mb,
  sum(cpu_percent)::double / count(*) as cpu_avg_percent,
  max(cpu_percent)::double as cpu_max_percent, min(cpu_percent)::double as cpu_min_percent
from samples where ts_us >= {CUTOFF} group by host""", "samples"))
def _(spark, sf):
    return rq.system_report(samples(spark, sf), NOW, MINUTES, ["host"])


_REPORT = f"""
period as (select *, row_number() over (partition by host order by duration_us) - 1 as pos,
    count(*) over (partition by host) as n from requests where start_us >= {CUTOFF}),
report as (select host, count(*) as total_requests,
  count(*) filter (success) as successful_requests,
  count(*) filter (not success) as failed_requests,
  count(*) filter (success) / count(*) * 100 as success_rate_percent,
  sum(duration_us) / count(*) / 1000 as avg_ms,
  min(duration_us) / 1000 as min_ms, max(duration_us) / 1000 as max_ms,
  max(duration_us) filter (pos = cast(floor(n * 0.5::double) as bigint)) / 1000 as p50_ms,
  max(duration_us) filter (pos = cast(floor(n * 0.95::double) as bigint)) / 1000 as p95_ms,
  max(duration_us) filter (pos = cast(floor(n * 0.99::double) as bigint)) / 1000 as p99_ms
from period group by host)"""


@query("q7_request_report", with_views(f"with {_REPORT} select * from report", "requests"))
def _(spark, sf):
    return rq.request_report(requests(spark, sf), NOW, MINUTES, ["host"])


@query("q8_floor_percentile", with_views("""
select host, success, max(duration_us) filter (pos = cast(floor(n * 0.95::double) as bigint)) as p95
from (select *, row_number() over (partition by host, success order by duration_us) - 1 as pos,
        count(*) over (partition by host, success) as n from requests)
group by host, success""", "requests"))
def _(spark, sf):
    return rq.floor_percentile(
        rq.requests_from(requests(spark, sf)), ["host", "success"], "duration_us", 0.95, "p95"
    )


@query("q9_errors_by_type", with_views("""
select host, coalesce(nullif(error_type, ''), 'Unknown') as error_type, count(*) as errors
from requests where not success group by 1, 2""", "requests"))
def _(spark, sf):
    return rq.errors_by_type(requests(spark, sf), ["host"])


@query("q10_rolling_sample", with_views("select * from rolled_samples", "rolled_samples"))
def _(spark, sf):
    return rolled_samples(spark, sf).select(
        "sample_id", "host", micros("ts").alias("ts_us"),
        F.col("memory_usage_mb").cast("double").alias("memory_usage_mb"),
        "cpu_percent", "response_time_ms", "success_rate",
    )


@query("q11_keep_latest", with_views("""
select request_id, host, end_us from requests
qualify row_number() over (partition by host order by end_us desc, request_id desc) <= 1000""",
                                     "requests"))
def _(spark, sf):
    return rq.keep_latest(
        requests(spark, sf), 1000, ["host"], ["end_time", "request_id"]
    ).select("request_id", "host", micros("end_time").alias("end_us"))


@query("q12_uptime", with_views("""
select host, (max(ts_us) - min(ts_us)) / 1000000 as uptime_seconds from samples group by host""",
                                "samples"))
def _(spark, sf):
    return rq.uptime(samples(spark, sf), ["host"])


@query("q13_performance_report", with_views(f"""
with told as (select * replace (case when retry_count = 3 then concat(host, '-late') else host end as host) from requests),
{_REPORT.replace("from requests", "from told")},
failures as (select host, string_agg(concat(error_type, ':', n), ',' order by error_type) as errors
  from (select host, coalesce(nullif(error_type, ''), 'Unknown') as error_type, count(*) as n
    from told where not success and start_us >= {CUTOFF} group by 1, 2) group by 1),
system as (select host, count(*) as snapshots_analyzed,
  sum(memory_usage_mb)::double / count(*) as memory_avg_mb,
  max(memory_usage_mb)::double as memory_max_mb, min(memory_usage_mb)::double as memory_min_mb,
  sum(cpu_percent)::double / count(*) as cpu_avg_percent,
  max(cpu_percent)::double as cpu_max_percent, min(cpu_percent)::double as cpu_min_percent
  from samples where ts_us >= {CUTOFF} group by host)
select coalesce(r.host, s.host) as host, 21600 as period_minutes,
  case when r.host is null or s.host is null then 'Insufficient data for the requested period' end as error,
  case when r.host is not null then snapshots_analyzed end as snapshots_analyzed,
  case when r.host is not null then memory_avg_mb end as memory_avg_mb,
  case when r.host is not null then memory_max_mb end as memory_max_mb,
  case when r.host is not null then memory_min_mb end as memory_min_mb,
  case when r.host is not null then cpu_avg_percent end as cpu_avg_percent,
  case when r.host is not null then cpu_max_percent end as cpu_max_percent,
  case when r.host is not null then cpu_min_percent end as cpu_min_percent,
  case when s.host is not null then total_requests end as total_requests,
  case when s.host is not null then successful_requests end as successful_requests,
  case when s.host is not null then failed_requests end as failed_requests,
  case when s.host is not null then success_rate_percent end as success_rate_percent,
  case when s.host is not null then avg_ms end as avg_ms,
  case when s.host is not null then min_ms end as min_ms,
  case when s.host is not null then max_ms end as max_ms,
  case when s.host is not null then p50_ms end as p50_ms,
  case when s.host is not null then p95_ms end as p95_ms,
  case when s.host is not null then p99_ms end as p99_ms,
  case when r.host is not null and s.host is not null then coalesce(errors, '') end as errors
from report r full join system s on r.host = s.host left join failures f on f.host = r.host""", "requests", "samples"))
def _(spark, sf):
    # Requests retried three times go by a key that no sample has.
    late = F.when(F.col("retry_count") == 3, F.concat("host", F.lit("-late"))).otherwise(F.col("host"))
    told = requests(spark, sf).withColumn("host", late)
    report = rq.performance_report(samples(spark, sf), told, ["host"], NOW, MINUTES)
    each = F.transform(
        F.array_sort(F.map_entries("errors")),
        lambda e: F.concat(e["key"], F.lit(":"), e["value"].cast("string")),
    )
    return report.withColumn("errors", F.array_join(each, ","))


@query("q15_current_metrics", with_views("""
with newest as (select host, ts_us, cast(memory_usage_mb as double) as memory_usage_mb, cpu_percent, open_files from samples
  qualify row_number() over (partition by host order by ts_us desc, sample_id desc) = 1),
totals as (select host, count(*) as total, count(*) filter (success) as successful, count(*) filter (not success) as failed,
    cast(sum(response_size) as bigint) as total_bytes_downloaded from requests group by 1),
last100 as (select * from requests qualify row_number() over (partition by host order by end_us desc, request_id desc) <= 100),
ranked as (select *, row_number() over (partition by host order by duration_us) - 1 as pos,
    count(*) over (partition by host) as n from last100),
recent as (select host, count(*) filter (success) / count(*) * 100 as success_rate_percent,
    sum(duration_us) / count(*) / 1000 as avg_response_time_ms,
    max(duration_us) filter (pos = cast(floor(n * 0.95::double) as bigint)) / 1000 as p95_response_time_ms
  from ranked group by host)
select host, ts_us, memory_usage_mb, cpu_percent, open_files, total, successful, failed, 0 as active_requests,
  total_bytes_downloaded, success_rate_percent, avg_response_time_ms, p95_response_time_ms
from newest join totals using (host) join recent using (host)""", "requests", "samples"))
def _(spark, sf):
    found = rq.current_metrics(
        samples(spark, sf), requests(spark, sf), ["host"], 100, ["ts", "sample_id"], ["end_time", "request_id"]
    )
    return found.select(
        "host", F.unix_micros("system.ts").alias("ts_us"),
        F.col("system.memory_usage_mb").cast("double").alias("memory_usage_mb"),
        "system.cpu_percent", "system.open_files",
        *[c for c in found.columns if c not in ("host", "system")],
    )


@query("q14_latest_sample", with_views("""
select host, sample_id, ts_us, cast(memory_usage_mb as double) as memory_usage_mb, cpu_percent, open_files
from samples qualify row_number() over (partition by host order by ts_us desc, sample_id desc) = 1""",
                                       "samples"))
def _(spark, sf):
    out = rq.latest_sample(samples(spark, sf), ["host"], ["ts", "sample_id"])
    return out.select(
        "host", "sample_id", micros("ts").alias("ts_us"),
        F.col("memory_usage_mb").cast("double").alias("memory_usage_mb"), "cpu_percent", "open_files",
    )
