"""Retry audit and error records (T, E) on the attempts table."""

from __future__ import annotations

from pyspark.sql import functions as F

from shelfscan.operators import retry as rt

from . import query
from .views import attempts, micros, with_views

# The policies' own threshold of 5 and three others.
_BREAKERS = {"default": 5, "network": 2, "rate_limit": 3, "gentle": 1}
_POLICIES = """
policies as (select * from (values
  ('default', 3, 1.0::double, 60.0::double, 'exponential', true,
    ['NetworkException','RateLimitException','ConnectionError','TimeoutError'], 5),
  ('network', 5, 2.0, 60.0, 'exponential', true, ['NetworkException','ConnectionError','TimeoutError'], 2),
  ('rate_limit', 3, 30.0, 300.0, 'linear', true, ['RateLimitException'], 3),
  ('gentle', 2, 1.0, 10.0, 'fixed', false,
    ['NetworkException','RateLimitException','ConnectionError','TimeoutError'], 1)
  ) p(policy, max_attempts, base_delay, max_delay, strategy, jitter, retryable, breaker))"""

_CIRCUIT = """
counted as (select *, sum(case when success then 0 else 1 end) over w as failures,
    sum(case when success then 1 else 0 end) over w as island
  from attempts window w as (partition by call_id order by ts_us, attempt_id rows unbounded preceding)),
circuit as (select *, cast(sum(case when success then 0 else 1 end) over
    (partition by call_id, island order by ts_us, attempt_id rows unbounded preceding) as bigint) as failure_run
  from counted)"""

_ORDER = ["ts", "attempt_id"]


def policies(spark):
    return rt.policy_table(spark, [(*p[:-1], _BREAKERS[p[0]]) for p in rt.POLICIES])


@query("t1_retry_verdict", with_views(f"""
with {_POLICIES}, {_CIRCUIT},
judged as (select attempt_id, c.policy, exception, attempt,
  case when success then 'succeeded' when failure_run >= breaker then 'circuit_open'
    when attempt >= max_attempts then 'attempt_limit'
    when exception in ('BlockedException','ValueError','TypeError') then 'non_retryable'
    when list_contains(retryable, exception) then 'retryable'
    when exception = 'NetworkException' and status_code in (429,500,502,503,504) then 'status_code'
    else 'not_listed' end as reason
  from circuit c join policies p on c.policy = p.policy)
select *, reason in ('retryable','status_code') as retry from judged""", "attempts"))
def _(spark, sf):
    state = rt.circuit_state(attempts(spark, sf), ["call_id"], policies(spark), _ORDER)
    return rt.retry_verdict(state, policies(spark)).select(
        "attempt_id", "policy", "exception", "attempt", "reason", "retry"
    )


@query("t2_expected_delay", with_views(f"""
with {_POLICIES},
waits as (select attempt_id, a.policy, attempt, max_delay as cap, jitter,
  base_delay * case strategy when 'linear' then attempt::double
    when 'exponential' then pow(2.0::double, attempt - 1) else 1.0::double end as delay
  from attempts a join policies p on a.policy = p.policy)
select attempt_id, policy, attempt,
  least(case when jitter then delay * 0.5::double else delay end, cap) as min_delay,
  least(delay, cap) as max_delay from waits""", "attempts"))
def _(spark, sf):
    return rt.expected_delay(attempts(spark, sf), rt.policy_table(spark)).select(
        "attempt_id", "policy", "attempt", "min_delay", "max_delay"
    )


@query("t3_circuit_state", with_views(f"""
with {_POLICIES}, {_CIRCUIT}
select attempt_id, call_id, c.policy, ts_us, failure_run, failure_run >= breaker as circuit_open
from circuit c join policies p on c.policy = p.policy""",
                                      "attempts"))
def _(spark, sf):
    return rt.circuit_state(attempts(spark, sf), ["call_id"], policies(spark), _ORDER).select(
        "attempt_id", "call_id", "policy", micros("ts").alias("ts_us"), "failure_run", "circuit_open"
    )


_PCT = """(case when 2 * ({a} * 10000 - {a} * 10000 // {b} * {b}) > {b} then 1
   when 2 * ({a} * 10000 - {a} * 10000 // {b} * {b}) < {b} then 0
   else ({a} * 10000 // {b}) % 2 end + {a} * 10000 // {b}) / 100.0::double"""


@query("t4_retry_summary", with_views(f"""
with {_POLICIES}, {_CIRCUIT},
calls as (select call_id % 10 as grp, call_id, count(*) as attempts,
    max_by(success, ts_us * 1000000 + attempt_id) as ok,
    max_by(failure_run >= breaker, ts_us * 1000000 + attempt_id) as opened
  from (select c.*, breaker, ts_us - 1700000000000000 as t from circuit c join policies p on c.policy = p.policy) group by 1, 2),
summary as (select grp, cast(sum(attempts) as bigint) as total_attempts,
    count(*) filter (ok and attempts > 1) as successful_retries,
    count(*) filter (not ok) as failed_after_retries,
    count(*) filter (not ok and opened) as circuit_breaker_activations
  from calls group by grp)
select *, {_PCT.format(a="(total_attempts - failed_after_retries)", b="total_attempts")} as success_rate_percent,
  {_PCT.format(a="successful_retries", b="total_attempts")} as retry_success_rate_percent
from summary""".replace("ts_us * 1000000 + attempt_id", "row(t, attempt_id)"), "attempts"))
def _(spark, sf):
    state = rt.circuit_state(attempts(spark, sf), ["call_id"], policies(spark), _ORDER)
    return rt.retry_summary(
        state.withColumn("grp", F.col("call_id") % 10), ["grp"], "call_id", _ORDER
    )


@query("e1_error_records", with_views("""
select attempt_id, exception as error_type,
  case exception when 'NetworkException' then 'NETWORK_ERROR' when 'RateLimitException' then 'RATE_LIMIT_ERROR'
    when 'BlockedException' then 'BLOCKED_ERROR' when 'ParsingException' then 'PARSING_ERROR'
    else exception end as error_code,
  concat('attempt ', attempt, ' failed') as error_message,
  case when exception = 'NetworkException' then cast(status_code as varchar) end as status_code,
  case when exception = 'NetworkException' then cast(attempt - 1 as varchar) end as retry_count,
  case exception when 'RateLimitException' then '0' end as requests_made,
  case when exception in ('NetworkException','RateLimitException','BlockedException','ParsingException')
    then 3 else 0 end as context_fields
from attempts where exception is not null""", "attempts"))
def _(spark, sf):
    rows = attempts(spark, sf).withColumns(
        {
            "message": F.concat(F.lit("attempt "), F.col("attempt").cast("string"), F.lit(" failed")),
            "retry_count": F.col("attempt") - 1,
        }
    )
    return rt.error_records(rows).select(
        "attempt_id", "error_type", "error_code", "error_message",
        *[F.col("context")[c].alias(c) for c in ("status_code", "retry_count", "requests_made")],
        F.size("context").alias("context_fields"),
    )
