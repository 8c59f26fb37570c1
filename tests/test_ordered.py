"""Ordered primitives and alerts against brute force, with one key holding most rows."""

import random
from collections import defaultdict

import pytest
from pyspark.sql import functions as F

from shelfscan.operators import health as hl
from shelfscan.operators import ordered as od
from shelfscan.operators import retry as rt


@pytest.fixture(scope="module")
def rows():
    rng = random.Random(7)
    out = []
    for i in range(3000):
        key = "hot" if rng.random() < 0.7 else rng.choice(["a", "b", None])
        out.append((i, key, rng.randrange(0, 400_000), rng.randrange(-50, 50), rng.random() < 0.3))
    return out


@pytest.fixture(scope="module")
def table(spark, rows):
    return spark.createDataFrame(rows, "id long, k string, s long, v long, flag boolean").withColumn(
        "ts", F.timestamp_seconds("s")
    ).repartition(7)


def by_key(rows):
    groups = defaultdict(list)
    for r in sorted(rows, key=lambda r: (r[2], r[0])):
        groups[r[1]].append(r)
    return groups


ORDER = ["ts", "id"]


def test_running_sums(table, rows):
    got = {r.id: r.total for r in od.running_sums(
        table, ["k"], od.hour_bucket("ts"), ORDER, {"total": F.col("v")}).collect()}
    for group in by_key(rows).values():
        total = 0
        for r in group:
            total += r[3]
            assert got[r[0]] == total


def test_carry_forward(table, rows):
    marked = table.withColumn("mark", F.when(F.col("flag"), F.col("id")))
    got = {r.id: r.mark for r in od.carry_forward(
        marked, ["k"], od.hour_bucket("ts"), ORDER, "mark").collect()}
    for group in by_key(rows).values():
        last = None
        for r in group:
            last = r[0] if r[4] else last
            assert got[r[0]] == last


def test_rolling_crosses_blocks(table, rows):
    frames = {"s3": (F.sum("v"), 3), "n9": (F.count("*"), 9)}
    got = {r.id: (r.s3, r.n9) for r in od.rolling(
        table, ["k"], od.hour_bucket("ts"), ORDER, frames, block=25).collect()}
    assert len(got) == len(rows)
    for group in by_key(rows).values():
        for i, r in enumerate(group):
            assert got[r[0]] == (sum(x[3] for x in group[max(0, i - 2): i + 1]), min(i + 1, 9))


@pytest.mark.parametrize("n", [5, 1200])
def test_latest_n(table, rows, n):
    got = {r.id for r in od.latest_n(table, ["k"], ORDER, n, salts=16).collect()}
    assert got == {r[0] for group in by_key(rows).values() for r in group[-n:]}
    whole = sorted(rows, key=lambda r: (r[2], r[0]))[-n:]
    assert {r.id for r in od.latest_n(table, [], ORDER, n).collect()} == {r[0] for r in whole}


def test_floor_percentiles(table, rows):
    points = {"p0": 0.0, "p50": 0.5, "p95": 0.95, "p100": 1.0}
    for column, index in (("s", 2), ("v", 3)):
        got = {r.k: r for r in od.floor_percentiles(table, ["k"], column, points).collect()}
        for key, group in by_key(rows).items():
            values = sorted(r[index] for r in group)
            for name, p in points.items():
                assert got[key][name] == values[min(int(len(values) * p), len(values) - 1)]


def test_circuit_state(table, rows):
    state = rt.circuit_state(table.withColumn("success", F.col("flag")), ["k"], 3, ORDER)
    got = {r.id: (r.failure_run, r.circuit_open) for r in state.collect()}
    for group in by_key(rows).values():
        run = 0
        for r in group:
            run = 0 if r[4] else run + 1
            assert got[r[0]] == (run, run >= 3)


@pytest.mark.parametrize("chunk_gaps", [2, 7, 500])
def test_alerts_are_greedy(table, rows, chunk_gaps):
    gap = 900
    got = sorted(
        (str(r.k), r.s) for r in hl.alerts(table, ["k"], gap, chunk_gaps=chunk_gaps).collect()
    )
    want = []
    for key, group in by_key(rows).items():
        last = None
        for r in group:
            if last is None or r[2] - last > gap:
                last = r[2]
                want.append((str(key), last))
    assert got == sorted(want)


def test_tasks_that_order_a_log_grow_with_its_rows(spark, tmp_path, monkeypatch):
    """As many tasks as the session has, for any number of lines, each held ever more of them."""
    import registry
    from registry import tables

    registry.load_all()
    monkeypatch.setattr(tables, "_ROWS_PER_TASK", 50)
    spark.range(2000).selectExpr(
        "id as o_orderkey", "id % 100 as o_custkey", "'F' as o_orderstatus"
    ).write.parquet(f"{tmp_path}/orders.parquet")
    rows = registry.QUERIES["s3_read_run_log"](spark, str(tmp_path))
    assert rows.rdd.getNumPartitions() == 40
    runs = rows.groupBy("file").agg(F.max("run").alias("last"), F.countDistinct("run").alias("n"))
    assert sorted(map(tuple, runs.collect())) == [("run_0", 100, 100), ("run_1", 100, 100)]
