"""Derived tables, each as a DataFrame and as the SQL text of the same rows."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from shelfscan.operators.ordered import join_keys
from shelfscan.operators.requests import latest_sample, requests_from, rolling_sample

from .rendered import ID_SQL, LISTING_SQL
from .tables import table


def micros(c: str) -> F.Column:
    return F.unix_micros(F.col(c))


# --- requests, samples, request events, attempts --------------------------------

_K = "cast(regexp_extract(props,'[0-9]+',0) as bigint)"
_HOST = "concat('host', cast(user_id % 10 as string))"
_US = "cast(round(value * 100000) as bigint)"
_ERROR = f"""case when event_type <> 'error' then null else
    case {_K} % 4 when 0 then null when 1 then 'NetworkException'
    when 2 then 'RateLimitException' else 'BlockedException' end end"""


def requests_of(events: DataFrame) -> DataFrame:
    return events.selectExpr(
        "event_id as request_id",
        f"{_HOST} as host",
        "cast(ts as timestamp) as start_time",
        f"timestamp_micros(unix_micros(cast(ts as timestamp)) + {_US}) as end_time",
        "event_type <> 'error' as success",
        f"{_K} * 1024 as response_size",
        f"{_ERROR} as error_type",
        f"cast({_K} % 4 as int) as retry_count",
    )


def samples_of(events: DataFrame) -> DataFrame:
    return events.selectExpr(
        "event_id as sample_id",
        f"{_HOST} as host",
        "cast(ts as timestamp) as ts",
        "cast(cast(round(value * 10000) as decimal(18,0)) * 0.001 as decimal(18,3)) as memory_usage_mb",
        f"{_K} as cpu_percent",
        f"{_K} * 2 as open_files",
    )


def request_events_of(req: DataFrame) -> DataFrame:
    number = "(response_size div 1024)"
    return (
        req.withColumn(
            "e",
            F.expr(f"""explode(filter(array(
                named_struct('kind', 'start', 'ts', start_time, 'keep', {number} % 17 <> 0),
                named_struct('kind', 'end', 'ts', end_time, 'keep', {number} % 19 <> 0)
            ), x -> x.keep))"""),
        )
        .select(
            "request_id", "host", "e.kind", "e.ts",
            *[F.when(F.col("e.kind") == "end", F.col(c)).alias(c)
              for c in ("success", "response_size", "error_type", "retry_count")],
        )
    )


def attempts_of(events: DataFrame) -> DataFrame:
    return events.selectExpr(
        "event_id as attempt_id",
        "user_id as call_id",
        f"cast(1 + {_K} % 5 as int) as attempt",
        "cast(ts as timestamp) as ts",
        "event_type <> 'error' as success",
        f"""case when event_type = 'error' then case {_K} % 6 when 0 then 'NetworkException'
            when 1 then 'RateLimitException' when 2 then 'BlockedException'
            when 3 then 'ConnectionError' when 4 then 'ValueError'
            else 'ParsingException' end end as exception""",
        f"""cast(case when event_type = 'error' then case {_K} % 5 when 0 then 429 when 1 then 500
            when 2 then 404 when 3 then 503 end end as int) as status_code""",
        f"case {_K} % 4 when 0 then 'default' when 1 then 'network' when 2 then 'rate_limit' else 'gentle' end as policy",
    )


def requests(spark: SparkSession, sf: str) -> DataFrame:
    return requests_of(table(spark, sf, "events"))


def samples(spark: SparkSession, sf: str) -> DataFrame:
    return samples_of(table(spark, sf, "events"))


def request_events(spark: SparkSession, sf: str) -> DataFrame:
    return request_events_of(requests(spark, sf))


def attempts(spark: SparkSession, sf: str) -> DataFrame:
    return attempts_of(table(spark, sf, "events"))


def rolled_samples(spark: SparkSession, sf: str) -> DataFrame:
    """Samples with the rolling request state of their host."""
    return rolling_sample(
        samples(spark, sf), requests(spark, sf), ["host"], "sample_id", "request_id"
    )


def day_stats(spark: SparkSession, sf: str) -> DataFrame:
    """Request and process figures per host and day, one health-check window each."""
    day = F.floor(F.unix_micros(F.col("start_time")) / F.lit(86_400_000_000)).cast("bigint")
    req = requests_from(requests(spark, sf)).groupBy("host", day.alias("day")).agg(
        F.count("*").alias("total"),
        F.count_if(~F.col("success")).alias("failed"),
        (F.count_if("success") / F.count("*") * 100).alias("success_rate_percent"),
        (F.sum("duration_us") / F.count("*") / 1000).alias("avg_response_time_ms"),
    )
    smp = latest_sample(
        samples(spark, sf).withColumn(
            "day", F.floor(F.unix_micros(F.col("ts")) / F.lit(86_400_000_000)).cast("bigint")
        ),
        ["host", "day"], ["ts", "sample_id"],
    )
    return join_keys(req, smp.drop("sample_id", "ts"), ["host", "day"], "left").withColumn(
        "memory_usage_mb", F.col("memory_usage_mb").cast("double")
    )


_DK = "cast(regexp_extract(props,'[0-9]+',0) as bigint)"

SQL: dict[str, str] = {
    "requests": f"""requests as (select event_id as request_id,
        concat('host', cast(user_id % 10 as varchar)) as host, epoch_us(ts) as start_us,
        cast(round(value * 100000) as bigint) as duration_us,
        epoch_us(ts) + cast(round(value * 100000) as bigint) as end_us,
        event_type <> 'error' as success, {_DK} * 1024 as response_size,
        {_ERROR.replace(_K, _DK)} as error_type,
        cast({_DK} % 4 as integer) as retry_count from events)""",
    "samples": f"""samples as (select event_id as sample_id,
        concat('host', cast(user_id % 10 as varchar)) as host, epoch_us(ts) as ts_us,
        cast(cast(round(value * 10000) as decimal(18,0)) * 0.001 as decimal(18,3)) as memory_usage_mb,
        {_DK} as cpu_percent, {_DK} * 2 as open_files
        from events)""",
    "request_events": """request_events as (
        select request_id, host, 'start' as kind, start_us as ts_us, null::boolean as success,
            null::bigint as response_size, null::varchar as error_type, null::integer as retry_count
        from requests where (response_size // 1024) % 17 <> 0
        union all
        select request_id, host, 'end', end_us, success, response_size, error_type, retry_count
        from requests where (response_size // 1024) % 19 <> 0)""",
    "attempts": f"""attempts as (select event_id as attempt_id, user_id as call_id,
        cast(1 + {_DK} % 5 as integer) as attempt, epoch_us(ts) as ts_us,
        event_type <> 'error' as success,
        case when event_type = 'error' then case {_DK} % 6 when 0 then 'NetworkException'
            when 1 then 'RateLimitException' when 2 then 'BlockedException'
            when 3 then 'ConnectionError' when 4 then 'ValueError'
            else 'ParsingException' end end as exception,
        case when event_type = 'error' then case {_DK} % 5 when 0 then 429 when 1 then 500
            when 2 then 404 when 3 then 503 end end as status_code,
        case {_DK} % 4 when 0 then 'default' when 1 then 'network' when 2 then 'rate_limit' else 'gentle' end as policy
        from events)""",
    "rolled_samples": """rolled as (select host, end_us, request_id,
    sum(duration_us) over w10 / count(*) over w10 / 1000 as response_time_ms,
    count(*) filter (success) over w50 / count(*) over w50 * 100 as success_rate
  from requests
  window w10 as (partition by host order by end_us, request_id rows between 9 preceding and current row),
         w50 as (partition by host order by end_us, request_id rows between 49 preceding and current row)),
merged as (select host, ts_us, 1 as kind, sample_id as id, memory_usage_mb, cpu_percent,
    null::double as response_time_ms, null::double as success_rate from samples
  union all select host, end_us, 0, request_id, null, null, response_time_ms, success_rate from rolled),
filled as (select *, last_value(response_time_ms ignore nulls) over w as rt,
    last_value(success_rate ignore nulls) over w as sr
  from merged window w as (partition by host order by ts_us, kind, id rows unbounded preceding)),
rolled_samples as (select id as sample_id, host, ts_us, cast(memory_usage_mb as double) as memory_usage_mb, cpu_percent,
  coalesce(rt, 0) as response_time_ms, coalesce(sr, 100) as success_rate
from filled where kind = 1)""",
    "day_stats": """day_requests as (select host, start_us // 86400000000 as day, count(*) as total,
        count(*) filter (not success) as failed,
        count(*) filter (success) / count(*) * 100 as success_rate_percent,
        sum(duration_us) / count(*) / 1000 as avg_response_time_ms
      from requests group by 1, 2),
    day_samples as (select * from (select *, ts_us // 86400000000 as day from samples)
      qualify row_number() over (partition by host, day order by ts_us desc, sample_id desc) = 1),
    day_stats as (select r.*, cast(s.memory_usage_mb as double) as memory_usage_mb, s.cpu_percent,
        s.open_files
      from day_requests r left join day_samples s on r.host = s.host and r.day = s.day)""",
}
SQL.update(LISTING_SQL)
SQL.update(ID_SQL)
_NEEDS = {
    "listing_products": ["listing_pages"],
    "id_all_cards": ["id_pages"],
    "id_products": ["id_pages", "id_all_cards"],
    "request_events": ["requests"],
    "rolled_samples": ["requests", "samples"],
    "day_stats": ["requests", "samples"],
}


def with_views(body: str, *names: str, recursive: bool = False) -> str:
    """SQL text: the named derived tables in front of ``body``."""
    wanted: list[str] = []
    for name in names:
        for part in [*_NEEDS.get(name, []), name]:
            if part not in wanted:
                wanted.append(part)
    ctes = ",\n".join(SQL[n] for n in wanted)
    body = body.strip()
    word = "with recursive" if recursive else "with"
    if body.lower().startswith("with "):
        return f"{word} {ctes},\n{body[5:]}"
    return f"{word} {ctes}\n{body}"
