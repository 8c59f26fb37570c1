"""State of streams kept as tables, one folder a micro-batch.

A micro-batch of a ``foreachBatch`` sink writes each of its tables to ``<path>/<name>/batch=<id>``,
replacing what an earlier attempt of the same batch left there, and closes the batch last. Readers
and later batches only see closed batches, so a failure in mid-batch, a repeated batch and a restart
from the checkpoint give the same tables. Nothing is held in memory between batches.

The mark is the greatest event time of all closed batches less the delay. Rows whose time is
behind it come late: they go to the table ``late`` as they are, counted per batch.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

CLOSED = "batch long, top_us long, mark_us long, base long, rows long, late long"


class StreamTables:
    def __init__(self, spark: SparkSession, path: str) -> None:
        self.spark, self.path = spark, path.rstrip("/")

    def put(self, name: str, rows: DataFrame, batch: int) -> None:
        rows.write.mode("overwrite").parquet(f"{self.path}/{name}/batch={batch}")

    def get(self, name: str, first: int, last: int) -> DataFrame:
        """Rows of the batches ``first`` to ``last``; only their folders are read."""
        found = self.spark.read.parquet(f"{self.path}/{name}")
        return found.filter(F.col("batch").between(first, last)).drop("batch")

    def closed(self) -> DataFrame:
        """One row a closed batch: its mark, rows and late rows, and the batch merged last."""
        try:
            return self.spark.read.schema(CLOSED).parquet(f"{self.path}/closed")
        except AnalysisException as error:
            if error.getCondition() != "PATH_NOT_FOUND":
                raise
            return self.spark.createDataFrame([], CLOSED)

    def last_closed(self, before: int | None = None):
        found = self.closed()
        if before is not None:
            found = found.filter(F.col("batch") < before)
        return found.orderBy(F.col("batch").desc()).first()

    def newest(self, name: str) -> DataFrame | None:
        """The table of the batch that was closed last."""
        last = self.last_closed()
        return self.get(name, last.batch, last.batch) if last else None

    def all(self, name: str) -> DataFrame | None:
        last = self.last_closed()
        return self.get(name, 0, last.batch) if last else None

    def remove(self, name: str, first: int, last: int) -> None:
        """Remove a table's folders of some batches, on whatever store they lie."""
        hadoop = self.spark._jvm.org.apache.hadoop.fs
        for batch in range(first, last + 1):
            folder = hadoop.Path(f"{self.path}/{name}/batch={batch}")
            folder.getFileSystem(self.spark._jsc.hadoopConfiguration()).delete(folder, True)


Step = Callable[[StreamTables, DataFrame, int, object, int], int]


def keep_tables(
    stream: DataFrame,
    path: str,
    checkpoint: str,
    time: Column,
    delay_seconds: float,
    step: Step,
    late: Callable[[int], Column] | None = None,
    trigger: dict | None = None,
) -> StreamingQuery:
    """Start a query that runs ``step(tables, rows, batch, before, mark_us)`` on every micro-batch.

    ``rows`` are the batch's rows that do not come late; ``before`` is the closed row of the batch
    before, or None; ``mark_us`` the mark with this batch's rows included. ``step`` returns the
    number of the batch up to which its tables are merged (-1: none). ``late`` tells late rows
    from the mark, by default those whose ``time`` is behind it; rows without a time are late.
    ``path`` and ``checkpoint`` belong together: batches are numbered by the checkpoint.
    """
    moment = F.unix_micros(time)
    behind = late or (lambda mark: moment < F.lit(mark))
    known: dict[int, object] = {}

    def run(rows: DataFrame, batch: int) -> None:
        spark = rows.sparkSession
        tables = StreamTables(spark, path)
        before = known[batch - 1] if batch - 1 in known else tables.last_closed(batch)
        rows = rows.persist()
        try:
            top = rows.agg(F.max(moment)).first()[0]
            tops = [t for t in (top, before and before.top_us) if t is not None]
            top = max(tops) if tops else None
            mark = None if top is None else top - int(delay_seconds * 1_000_000)
            lost = moment.isNull()
            if before is not None and before.mark_us is not None:
                lost = lost | F.coalesce(behind(before.mark_us), F.lit(False))
            tables.put("late", rows.filter(lost), batch)
            base = step(tables, rows.filter(~lost), batch, before, mark)
            counts = rows.agg(F.count("*").alias("rows"), F.count_if(lost).alias("late")).first()
            closed = spark.createDataFrame([(batch, top, mark, base, counts[0], counts[1])], CLOSED)
            tables.put("closed", closed.drop("batch").coalesce(1), batch)
            known.clear()
            known[batch] = closed.first()
        finally:
            rows.unpersist()

    writer = stream.writeStream.foreachBatch(run).option("checkpointLocation", checkpoint)
    return writer.trigger(**(trigger or {"availableNow": True})).start()


def merging(name: str, merge: Callable[[DataFrame], DataFrame], every: int):
    """How tables of one ``name`` that add up are kept: batches, and now and then one base.

    Returns ``put(tables, rows, batch, before) -> base`` and ``get(tables) -> rows or None``.
    Every ``every`` batches the last base and all batches since are merged into a new base, so
    that a reader meets at most that many; older folders are removed once that is closed.
    """

    def since(tables: StreamTables, base: int, last: int) -> DataFrame:
        found = tables.get(name, base + 1, last)
        return found if base < 0 else found.unionByName(tables.get(f"{name}_base", base, base))

    def put(tables: StreamTables, rows: DataFrame, batch: int, before) -> int:
        tables.put(name, rows, batch)
        base = -1 if before is None else before.base
        if batch - base < every:
            return base
        tables.put(f"{name}_base", merge(since(tables, base, batch)), batch)
        # What the base before was made of; readers that started then have had all its time.
        tables.remove(name, max(0, base - every + 1), base)
        return batch

    def get(tables: StreamTables) -> DataFrame | None:
        last = tables.last_closed()
        return None if last is None else merge(since(tables, last.base, last.batch))

    return put, get
