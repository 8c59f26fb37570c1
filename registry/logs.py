"""Log analytics (L) and the log, request and sample readers (S3-S5)."""

from __future__ import annotations

from pyspark.sql import functions as F

from shelfscan.operators import logs as lg
from shelfscan.sources import readers

from . import query
from .tables import scratch, table, tasks
from .views import attempts, micros, requests, samples, with_views

# One run per ten orders, one page per order; some lines belong to no layout.
_LINES = """array(
  if(o_orderkey % 10 = 0, concat(t, ' - src.main - INFO - Iniciando busca por: pedido ', o_orderkey div 10), null),
  if(o_orderkey % 3 = 0, concat(t, ' - src.main - INFO - Página ', o_orderkey % 10 + 1, ': Layout detectado: poly-card'),
     concat(t, ' - INFO - Page ', o_orderkey % 10 + 1, ': Layout detected: classic')),
  concat(t, ' - src.main - INFO - Página ', o_orderkey % 10 + 1, ': ', o_custkey % 60, ' containers encontrados'),
  if(o_orderkey % 4 = 1, null, concat(t, ' - src.main - INFO - Página ', o_orderkey % 10 + 1, ': ', o_custkey % 50, ' produtos extraídos')),
  if(o_orderkey % 17 = 0, 'Traceback (most recent call last):', null),
  if(o_orderkey % 19 = 0, concat(t, ' - src.utils - WARNING - Tempo de espera'), null),
  if(o_orderkey % 70 = 39, concat(t, ' - src.utils - ERROR - Erro na execução: ', o_orderstatus), null),
  if(o_orderkey % 70 = 39, 'Traceback (most recent call last):', null),
  if(o_orderkey % 70 = 39, '  File "run.py", line 7, in visit', null),
  if(o_orderkey % 70 = 39, if(o_orderkey % 2 = 0, 'ValueError', 'net.errors.ConnectionError: demorou'), null))"""


def log_lines(spark, sf):
    """(file, block, line, value): a file per thousand orders, a block per hundred."""
    orders = table(spark, sf, "orders").selectExpr(
        "*", "date_format(timestamp_seconds(1735689600 + o_orderkey * 3), 'yyyy-MM-dd HH:mm:ss') as t"
    )
    return orders.selectExpr(
        "concat('run_', o_orderkey div 1000) as file", "o_orderkey div 100 as block", "o_orderkey",
        f"posexplode({_LINES}) as (seq, value)",
    ).filter("value is not null").selectExpr("file", "block", "o_orderkey * 10 + seq as line", "value")


_LINES_SQL = """
raw_lines as (
  select *, make_timestamp(1735689600000000 + o_orderkey * 3000000) as ts, o_orderkey % 10 + 1 as page,
    concat('run_', o_orderkey // 1000) as file from orders),
lines as (
  select file, o_orderkey * 10 as line, ts, 'src.main' as logger, 'INFO' as level,
    concat('Iniciando busca por: pedido ', o_orderkey // 10) as message, null as page, null as layout, null as containers,
    null as products from raw_lines where o_orderkey % 10 = 0
  union all select file, o_orderkey * 10 + 1, ts, case when o_orderkey % 3 = 0 then 'src.main' end, 'INFO',
    case when o_orderkey % 3 = 0 then concat('Página ', page, ': Layout detectado: poly-card')
      else concat('Page ', page, ': Layout detected: classic') end, page,
    case when o_orderkey % 3 = 0 then 'poly-card' else 'classic' end, null, null from raw_lines
  union all select file, o_orderkey * 10 + 2, ts, 'src.main', 'INFO',
    concat('Página ', page, ': ', o_custkey % 60, ' containers encontrados'), page, null, o_custkey % 60, null from raw_lines
  union all select file, o_orderkey * 10 + 3, ts, 'src.main', 'INFO',
    concat('Página ', page, ': ', o_custkey % 50, ' produtos extraídos'), page, null, null, o_custkey % 50
    from raw_lines where o_orderkey % 4 <> 1
  union all select file, o_orderkey * 10 + 4, null, null, null, null, null, null, null, null
    from raw_lines where o_orderkey % 17 = 0
  union all select file, o_orderkey * 10 + 5, ts, 'src.utils', 'WARNING', 'Tempo de espera', null, null, null, null
    from raw_lines where o_orderkey % 19 = 0
  union all select file, o_orderkey * 10 + 6, ts, 'src.utils', 'ERROR', concat('Erro na execução: ', o_orderstatus),
    null, null, null, null from raw_lines where o_orderkey % 70 = 39
  union all select file, o_orderkey * 10 + i, null, null, null, null, null, null, null, null
    from raw_lines, generate_series(7, 9) s(i) where o_orderkey % 70 = 39),
run_lines as (select *, cast(sum(case when message like 'Iniciando busca%' then 1 else 0 end) over
    (partition by file order by line rows unbounded preceding) as bigint) as run from lines)"""


@query("s3_read_run_log", f"""
with {_LINES_SQL}
select file, run, epoch_us(ts) as ts_us, logger, level, message from run_lines""")
def _(spark, sf):
    path = f"{scratch(spark)}/logs"
    parts = tasks(table(spark, sf, "orders"))
    (
        log_lines(spark, sf).repartition(parts, "file").sortWithinPartitions("file", "line")
        .select("file", "value").write.partitionBy("file").text(path)
    )
    parsed = readers.read_run_log(spark, path)
    return lg.with_run(parsed, partitions=parts).select(
        F.regexp_extract("file", "file=([^/]+)", 1).alias("file"), "run", micros("ts").alias("ts_us"),
        "logger", "level", "message",
    )


@query("s4_read_json_log", with_views("""
select ts_us, case when success then 'INFO' else 'ERROR' end as level, concat('call ', call_id) as message,
  case when attempt_id % 3 < 2 then attempt end as page_number,
  case when attempt_id % 2 = 0 then attempt * 2 else attempt * 3 end as products_found,
  exception as exception_type from attempts""", "attempts"))
def _(spark, sf):
    path = f"{scratch(spark)}/json_log"
    attempts(spark, sf).select(
        F.date_format("ts", "yyyy-MM-dd'T'HH:mm:ss.SSSSSS'Z'").alias("timestamp"),
        F.when(F.col("success"), "INFO").otherwise("ERROR").alias("level"),
        F.lit("jobs").alias("logger"),
        F.concat(F.lit("call "), F.col("call_id").cast("string")).alias("message"),
        F.expr("if(attempt_id % 3 = 0, attempt, null)").alias("page_number"),
        F.expr("if(attempt_id % 3 = 1, attempt, null)").alias("page"),
        F.expr("if(attempt_id % 2 = 0, attempt * 2, null)").alias("products_found"),
        F.expr("if(attempt_id % 2 = 1, attempt * 3, null)").alias("products_count"),
        F.expr("if(success, null, named_struct('type', exception, 'message', 'é'))").alias("exception"),
    ).write.json(path)
    return readers.read_json_log(spark, path).select(
        micros("ts").alias("ts_us"), "level", "message", "page_number", "products_found",
        F.col("exception.type").alias("exception_type"),
    )


@query("s5_read_requests", with_views("""
select request_id, host, start_us, end_us, duration_us, duration_us / 1000 as duration_ms, success, response_size,
  error_type, retry_count from requests
union all select sample_id, host, ts_us, null, null, cast(memory_usage_mb as double), null, null, null, cast(open_files as integer)
from samples""", "requests", "samples"))
def _(spark, sf):
    def seconds(c):
        return (F.unix_micros(c) / 1_000_000).alias(c if c != "ts" else "timestamp")

    path = scratch(spark)
    requests(spark, sf).select(
        "request_id", "host", seconds("start_time"), seconds("end_time"), "success", "response_size",
        "error_type", "retry_count",
    ).write.json(f"{path}/requests")
    samples(spark, sf).select(
        "sample_id", "host", seconds("ts"), F.col("memory_usage_mb").cast("double").alias("memory_usage_mb"),
        F.col("open_files").cast("int").alias("open_files"),
    ).write.json(f"{path}/samples")
    req = readers.read_requests(spark, f"{path}/requests").select(
        "request_id", "host", micros("start_time").alias("start_us"), micros("end_time").alias("end_us"),
        "duration_us", "duration_ms", "success", "response_size", "error_type", "retry_count",
    )
    smp = readers.read_samples(spark, f"{path}/samples").select(
        F.col("sample_id").alias("request_id"), "host", micros("ts").alias("start_us"),
        F.col("memory_usage_mb").alias("duration_ms"), F.col("open_files").alias("retry_count"),
    )
    return req.unionByName(smp, allowMissingColumns=True)


def parsed_runs(spark, sf):
    lines = readers.parse_run_log(log_lines(spark, sf))
    return lg.with_run(lines, partitions=tasks(table(spark, sf, "orders")))


@query("l1_at_least", f"""
with {_LINES_SQL} select file, line, level, message from lines where level in ('WARNING', 'ERROR')""")
def _(spark, sf):
    return lg.at_least(readers.parse_run_log(log_lines(spark, sf)), "warning").select(
        "file", "line", "level", "message"
    )


@query("l2_log_page_stats", f"""
with {_LINES_SQL}
select file, run, cast(page as integer) as page, max(layout) as layout, cast(max(containers) as integer) as containers,
  cast(max(products) as integer) as products from run_lines where page is not null group by 1, 2, 3""")
def _(spark, sf):
    return lg.log_page_stats(parsed_runs(spark, sf))


@query("l3_log_runs", f"""
with {_LINES_SQL}
select file, run, max(case when message like 'Iniciando%' then message[22:] end) as search_term,
  epoch_us(min(ts)) as started_us, epoch_us(max(ts)) as ended_us, count(*) as lines,
  cast(coalesce(sum(products), 0) as bigint) as products, count(*) filter (level = 'ERROR') as errors,
  (epoch_us(max(ts)) - epoch_us(min(ts))) // 1000000 as duration_seconds,
  case when count(*) filter (level = 'ERROR') > 0 then 'error' else 'success' end as outcome
from run_lines group by 1, 2""")
def _(spark, sf):
    runs = lg.log_runs(parsed_runs(spark, sf))
    return runs.withColumns({"started_us": micros("started"), "ended_us": micros("ended")}).drop("started", "ended")


@query("l4_log_errors", f"""
with {_LINES_SQL}
select file, level, case when level = 'WARNING' then 'Tempo de espera'
    when line // 10 % 2 = 0 then 'ValueError' else 'ConnectionError' end as error,
  count(*) as records, epoch_us(min(ts)) as first_us, epoch_us(max(ts)) as last_us
from lines where level in ('WARNING', 'ERROR') group by 1, 2, 3""")
def _(spark, sf):
    records = lg.whole_records(readers.parse_run_log(log_lines(spark, sf)))
    digest = lg.log_errors(records, ["file"], "WARNING")
    return digest.withColumns({"first_us": micros("first_seen"), "last_us": micros("last_seen")}).drop(
        "first_seen", "last_seen"
    )
