"""Log analytics on parsed run logs (see ``sources.readers``)."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .ordered import carry_forward, running_sums

# Level order and the message forms of a run.
LEVELS = {"DEBUG": 10, "INFO": 20, "WARNING": 30, "ERROR": 40, "CRITICAL": 50}
RUN_START = r"^(?:Iniciando busca por: |Starting search for: |Starting crawling: )"
RUN_TERM = r"^(?:Iniciando busca por: |Starting search for: |Starting crawling: term=')([^']*)"
PAGE_LAYOUT = r"^(?:Página|Page) (\d+): (?:Layout detectado|Layout detected): (\S+)"
PAGE_CONTAINERS = r"^(?:Página|Page) (\d+): (\d+) (?:containers encontrados|containers found)"
PAGE_PRODUCTS = r"^(?:Página|Page) (\d+): (\d+) (?:produtos extraídos|products extracted)"
# The last line of a traceback: the exception's class, perhaps its module and message.
RAISED = r"^(?:[A-Za-z_]\w*\.)*([A-Za-z_]\w*)(?:: (.*))?$"
HEAD = r"^((?:\S+\s+){0,2}\S+)"


def severity(level: Column) -> Column:
    ranks = F.create_map(*[F.lit(x) for pair in LEVELS.items() for x in pair])
    return ranks[F.upper(level)]


def at_least(logs: DataFrame, level: str, column: str = "level") -> DataFrame:
    """Records of the given level or above; lines without a level are dropped."""
    return logs.filter(severity(F.col(column)) >= LEVELS[level.upper()])


def _number(pattern: str, group: int) -> Column:
    return F.nullif(F.regexp_extract("message", pattern, group), F.lit("")).cast("int")


def with_run(
    logs: DataFrame, file: str = "file", bucket: str = "block", order: Sequence[str] = ("line",),
    partitions: int | None = None,
) -> DataFrame:
    """Number the runs of each file; lines before the first start belong to run 0.

    ``bucket`` (a file split) bounds what one task orders of a file, ``partitions`` how many tasks
    share the splits.
    """
    start = F.when(F.col("message").rlike(RUN_START), 1).otherwise(0)
    return running_sums(logs, [file], F.col(bucket), list(order), {"run": start}, partitions)


def whole_records(
    logs: DataFrame, file: str = "file", bucket: str = "block", order: Sequence[str] = ("line",),
    value: str = "value",
) -> DataFrame:
    """One row per log record: its first line's columns, and what the lines after it tell.

    Lines without a level belong to the record before them in their file, also in another split;
    those before a file's first record make a row without a level. Adds ``more_lines`` (how many)
    and ``exception`` (type, message), read from the last line that names one; null without. Of a
    record's lines only counts and that one line are ever gathered.
    """
    place = F.struct(bucket, *order)
    marked = logs.withColumn("_record", F.when(F.col("level").isNotNull(), place))
    carried = carry_forward(marked, [file], F.col(bucket), list(order), "_record")
    columns = [c for c in logs.columns if c != file]
    first = F.col("level").isNotNull()
    named = ~first & F.col(value).rlike(RAISED)
    raised = F.struct(
        F.regexp_extract(value, RAISED, 1).alias("type"),
        F.nullif(F.regexp_extract(value, RAISED, 2), F.lit("")).alias("message"),
    )
    return (
        carried.groupBy(file, "_record")
        .agg(
            F.max(F.when(first, F.struct(*columns))).alias("_first"),
            F.count_if(~first).alias("more_lines"),
            F.max_by(F.when(named, raised), F.when(named, place)).alias("exception"),
        )
        .select(file, "_first.*", "more_lines", "exception")
    )


def log_page_stats(
    runs: DataFrame, by: Sequence[str] = ("file", "run")
) -> DataFrame:
    """Layout, containers and products per page of each run."""
    page = F.coalesce(
        _number(PAGE_LAYOUT, 1), _number(PAGE_CONTAINERS, 1), _number(PAGE_PRODUCTS, 1)
    )
    layout = F.nullif(F.regexp_extract("message", PAGE_LAYOUT, 2), F.lit(""))
    return (
        runs.withColumn("page", page)
        .filter(F.col("page").isNotNull())
        .groupBy(*by, "page")
        .agg(
            F.max(layout).alias("layout"),
            F.max(_number(PAGE_CONTAINERS, 2)).alias("containers"),
            F.max(_number(PAGE_PRODUCTS, 2)).alias("products"),
        )
    )


def log_runs(runs: DataFrame, by: Sequence[str] = ("file", "run")) -> DataFrame:
    """Term, start, end, duration, lines, products and outcome of each run."""
    errors = severity(F.col("level")) >= LEVELS["ERROR"]
    term = F.nullif(F.regexp_extract("message", RUN_TERM, 1), F.lit(""))
    return (
        runs.groupBy(*by)
        .agg(
            F.max(term).alias("search_term"),
            F.min("ts").alias("started"),
            F.max("ts").alias("ended"),
            F.count("*").alias("lines"),
            F.coalesce(F.sum(_number(PAGE_PRODUCTS, 2)), F.lit(0)).alias("products"),
            F.count_if(errors).alias("errors"),
        )
        .withColumn(
            "duration_seconds",
            ((F.unix_micros("ended") - F.unix_micros("started")) / 1_000_000).cast("bigint"),
        )
        .withColumn("outcome", F.when(F.col("errors") > 0, "error").otherwise("success"))
    )


def log_errors(logs: DataFrame, by: Sequence[str] = (), level: str = "ERROR") -> DataFrame:
    """Records per exception type, or per first words of the message without one."""
    head = F.regexp_extract("message", HEAD, 1)
    kind = F.coalesce(F.col("exception.type"), head) if "exception" in logs.columns else head
    return (
        at_least(logs, level)
        .groupBy(*by, "level", kind.alias("error"))
        .agg(F.count("*").alias("records"), F.min("ts").alias("first_seen"), F.max("ts").alias("last_seen"))
    )
