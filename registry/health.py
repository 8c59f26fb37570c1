"""Health checks, alerts and throttle advice (H)."""

from __future__ import annotations

from pyspark.sql import functions as F

from shelfscan.operators import health as hl

from . import query
from .views import day_stats, micros, requests, rolled_samples, samples, with_views

_BREACHES = """
breaches as (
  select sample_id, host, ts_us, 'high_memory' as alert_type, 'memory_usage_mb' as metric,
    memory_usage_mb as value, 500.0::double as threshold from rolled_samples where memory_usage_mb > 500
  union all select sample_id, host, ts_us, 'high_cpu', 'cpu_percent', cpu_percent::double, 80.0
    from rolled_samples where cpu_percent > 80
  union all select sample_id, host, ts_us, 'low_success_rate', 'success_rate', success_rate, 70.0
    from rolled_samples where success_rate < 70)"""


@query("h1_breaches", with_views(f"with {_BREACHES} select * from breaches", "rolled_samples"))
def _(spark, sf):
    return hl.breaches(rolled_samples(spark, sf)).select(
        "sample_id", "host", micros("ts").alias("ts_us"), "alert_type", "metric", "value", "threshold"
    )


@query("h2_alerts", with_views(f"""
with {_BREACHES},
ordered as (select host, alert_type, ts_us, row_number() over (partition by host, alert_type order by ts_us) as n
  from (select distinct host, alert_type, ts_us from breaches)),
fold as (select host, alert_type, ts_us, n, true as fired, ts_us as last from ordered where n = 1
  union all select o.host, o.alert_type, o.ts_us, o.n, o.ts_us - f.last > 3600000000,
    case when o.ts_us - f.last > 3600000000 then o.ts_us else f.last end
  from fold f join ordered o on o.host = f.host and o.alert_type = f.alert_type and o.n = f.n + 1)
select host, alert_type, ts_us from fold where fired""", "rolled_samples", recursive=True))
def _(spark, sf):
    broken = hl.breaches(rolled_samples(spark, sf))
    # 48 gaps (two days) per chunk, so one key spans many chunks
    return hl.alerts(broken, ["host", "alert_type"], 3600, chunk_gaps=48).select(
        "host", "alert_type", micros("ts").alias("ts_us")
    )


def _f(value: str, decimals: int) -> str:
    return f"printf('%.{decimals}f', {value})"


@query("h3_basic_health", with_views(f"""
with s as (select host, day, coalesce(memory_usage_mb, 0) as m, success_rate_percent as r,
    avg_response_time_ms as t from day_stats)
select host, day, 'memory_usage' as name,
  case when m > 1000 then 'critical' when m > 500 then 'warning' else 'ok' end as status,
  concat(case when m > 1000 then 'Memory usage very high: ' when m > 500 then 'Memory usage moderate: '
    else 'Memory usage normal: ' end, {_f('m', 1)}, 'MB') as message,
  case when m > 1000 then 'Consider restarting the process or increasing resources'
    when m > 500 then 'Monitor memory growth' end as recommendation from s
union all select host, day, 'success_rate',
  case when r < 50 then 'critical' when r < 80 then 'warning' else 'ok' end,
  concat(case when r < 50 then 'Success rate very low: ' when r < 80 then 'Success rate low: '
    else 'Success rate good: ' end, {_f('r', 1)}, '%'),
  case when r < 50 then 'Check connectivity and possible blocking'
    when r < 80 then 'Investigate recent errors and adjust settings' end from s
union all select host, day, 'response_time', case when t > 10000 then 'warning' else 'ok' end,
  concat(case when t > 10000 then 'Response time high: ' else 'Response time good: ' end, {_f('t', 0)}, 'ms'),
  case when t > 10000 then 'Check network latency and optimize requests' end from s""", "day_stats"))
def _(spark, sf):
    return hl.basic_health(day_stats(spark, sf), ["host", "day"])


_CHECKS = f"""
s as (select *, memory_usage_mb as m, cpu_percent::double as c, success_rate_percent as r,
    avg_response_time_ms as t, failed / total * 100 as e, open_files as o from day_stats),
checks as (
select host, day, 'memory_usage' as name,
  case when m is null or m > 512 then 'critical' when m > 384 then 'warning' else 'ok' end as status,
  case when m is null then 'Error checking memory: no sample'
    when m > 512 then concat('Memory usage exceeded limit: ', {_f('m', 1)}, 'MB > 512.0MB')
    when m > 384 then concat('High memory usage: ', {_f('m', 1)}, 'MB (limit: 512.0MB)')
    else concat('Normal memory usage: ', {_f('m', 1)}, 'MB') end as message, m as detail from s
union all select host, day, 'cpu_usage',
  case when c is null or c > 80 then 'critical' when c > 60 then 'warning' else 'ok' end,
  case when c is null then 'Error checking CPU: no sample'
    when c > 80 then concat('CPU usage exceeded limit: ', {_f('c', 1)}, '% > 80.0%')
    when c > 60 then concat('High CPU usage: ', {_f('c', 1)}, '%')
    else concat('Normal CPU usage: ', {_f('c', 1)}, '%') end, c from s
union all select host, day, 'request_performance',
  case when r < 50 or t > 15000 then 'critical' when r < 80 or t > 8000 then 'warning' else 'ok' end,
  concat(case when r < 50 or t > 15000 then 'Critical' when r < 80 or t > 8000 then 'Degraded' else 'Good' end,
    ' performance - Success: ', {_f('r', 1)}, '%, Time: ', {_f('t', 0)}, 'ms'), r from s
union all select host, day, 'error_rates',
  case when e > 50 then 'critical' when e > 20 then 'warning' else 'ok' end,
  concat(case when e > 50 then 'High' when e > 20 then 'Elevated' else 'Low' end, ' error rate: ',
    {_f('e', 1)}, '%'), e from s
union all select host, day, 'system_resources', case when o is null or o > 100 then 'warning' else 'ok' end,
  case when o is null then 'Error checking resources: no sample'
    when o > 100 then concat('Too many open files: ', o, ' > 100')
    else concat('Normal system resources: ', o, ' open files') end, o::double from s)"""


@query("h4_health_checks", with_views(f"with {_CHECKS} select * from checks", "day_stats"))
def _(spark, sf):
    d = F.col("details")
    return hl.health_checks(day_stats(spark, sf), ["host", "day"]).select(
        "host", "day", "name", "status", "message",
        F.coalesce(d["rss_mb"], d["cpu_percent"], d["success_rate_percent"], d["error_rate"], d["open_files"])
        .alias("detail"),
    )


@query("h5_overall_status", with_views(f"""
with {_CHECKS}
select host, day, case max(case status when 'critical' then 2 when 'warning' then 1 else 0 end)
    when 2 then 'critical' when 1 then 'warning' else 'healthy' end as overall_status,
  count(*) filter (status <> 'ok') as failing_checks from checks group by host, day""", "day_stats"))
def _(spark, sf):
    checks = hl.health_checks(day_stats(spark, sf), ["host", "day"])
    return hl.overall_status(checks, ["host", "day"])


@query("h6_recommended_actions", with_views(f"""
with {_CHECKS}
select host, day, name, case name when 'memory_usage' then 'high_memory'
    when 'request_performance' then 'poor_performance' else 'high_error_rate' end as action,
  case when name = 'memory_usage' then
    case when coalesce(detail, 0) > 512 * 0.95::double then 'aggressive' else 'basic' end end as cleanup_mode
from checks where status = 'critical' and name in ('memory_usage','request_performance','error_rates')""",
                                            "day_stats"))
def _(spark, sf):
    checks = hl.health_checks(day_stats(spark, sf), ["host", "day"])
    return hl.recommended_actions(checks).select("host", "day", "name", "action", "cleanup_mode")


def _recent_sql(key: str) -> str:
    return f"""
recent as (select {key} as k, count(*) as measurements,
    sum(duration_us) / count(*) / 1000 as avg_response_time_ms,
    count(*) filter (success) / count(*) as success_rate
  from (select * from requests qualify
    row_number() over (partition by {key} order by end_us desc, request_id desc) <= 50)
  group by 1)"""


# Client keys are (host, day): many of them have fewer than 50 requests, a few fewer than 10.
_KEY = "concat(host, '/', cast(start_us // 43200000000 as varchar))"


def _keyed(spark, sf):
    half_day = F.floor(F.unix_micros(F.col("start_time")) / F.lit(43_200_000_000)).cast("string")
    return requests(spark, sf).withColumn("k", F.concat("host", F.lit("/"), half_day))


@query("h7_throttle_advice", with_views(f"""
with {_recent_sql(_KEY)},
judged as (select *, case when measurements < 10 then 1.0::double when success_rate < 0.7::double then 1.5
    when avg_response_time_ms > 5000 then 1.2
    when success_rate > 0.95::double and avg_response_time_ms < 2000 then 0.9 else 1.0 end as factor
  from recent)
select *, case when measurements < 10 then 'insufficient data'
    when success_rate < 0.7::double then concat('low success rate (', {_f('success_rate * 100', 1)}, '%)')
    when avg_response_time_ms > 5000 then concat('high response time (', {_f('avg_response_time_ms', 0)}, 'ms)')
    when success_rate > 0.95::double and avg_response_time_ms < 2000 then concat('good performance (success: ',
      {_f('success_rate * 100', 1)}, '%, time: ', {_f('avg_response_time_ms', 0)}, 'ms)')
    else 'no change' end as reason,
  case when factor > 1 then least(factor, 30.0::double) when factor < 1 then greatest(factor, 0.1::double)
    else 1.0::double end as new_delay,
  2.0::double as error_action_delay, 1.5::double as slow_action_delay
from judged""", "requests"))
def _(spark, sf):
    return hl.throttle_advice(_keyed(spark, sf), ["k"], order=["end_time", "request_id"])


@query("h8_recent_performance", with_views(f"""
with {_recent_sql("host")} select k as host, measurements, avg_response_time_ms, success_rate from recent
union all select 'host_without_requests', 0, 0, 1""", "requests"))
def _(spark, sf):
    req = requests(spark, sf)
    keys = req.select("host").distinct().union(
        spark.sql("select 'host_without_requests' as host")
    )
    return hl.recent_performance(req, ["host"], 50, ["end_time", "request_id"], keys)


@query("h9_memory_band", with_views(f"""
with m as (select sample_id, cast(memory_usage_mb as double) as used from samples)
select sample_id, case when used > 460.8::double then 'aggressive' when used > 358.4::double then 'basic'
    else 'none' end as band,
  case when used > 460.8::double then concat('aggressive_cleanup (use: ', {_f('used', 1)}, 'MB > 460.8MB)')
    when used > 358.4::double then concat('basic_cleanup (use: ', {_f('used', 1)}, 'MB > 358.4MB)')
    else '' end as reason from m""", "samples"))
def _(spark, sf):
    return hl.memory_band(samples(spark, sf)).select("sample_id", "band", "reason")
