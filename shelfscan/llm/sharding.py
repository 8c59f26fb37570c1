"""A reproducible shuffle into shards by a Feistel permutation of global row numbers.

Rows are sorted by range over the whole table and numbered 0..n-1. A Feistel network over as
many bits as n needs permutes the numbers; where it leaves 0..n-1 it is applied again until it
is back (cycle walking), which is a permutation of 0..n-1. The permuted number gives the shard
(its remainder) and the slot in it (its quotient), so that shards differ by at most one row.
Both directions are plain functions of the number: ``permuted``, ``place_of`` and ``row_of``
need no table.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .shared import cut, unused

ROUNDS = 8
# Fixed values of the round function: odd multipliers below 2**31, so that products of 32-bit
# numbers stay below 2**63.
MULTIPLIERS = (0x7FEB352D, 0x45D9F3B5)
_LOW = 0xFFFFFFFF


def _mixed(value):
    """A 32-bit hash of 32-bit numbers (whole numbers or int64 arrays)."""
    for factor in MULTIPLIERS:
        value = value ^ (value >> 16)
        value = (value * factor) & _LOW
    return value ^ (value >> 15)


def round_keys(seed: int) -> list[int]:
    keys = []
    for n in range(ROUNDS):
        keys.append(_mixed((seed + 0x9E37 * (n + 1)) & _LOW) ^ _mixed((seed >> 32) & _LOW))
    return keys


def halves(n: int) -> tuple[int, int]:
    """Bits of the upper and the lower half: together the least that count n numbers."""
    bits = max(2, (n - 1).bit_length())
    if bits > 62:
        raise ValueError("more than 2**62 rows")
    return bits // 2, bits - bits // 2


def _network(value, n: int, keys: list[int], inverse: bool):
    """One pass through the network; halves of unequal width take turns."""
    upper, lower = halves(n)
    high, low = value >> lower, value & ((1 << lower) - 1)
    for at in reversed(range(ROUNDS)) if inverse else range(ROUNDS):
        if at % 2:
            low = low ^ (_mixed((high + keys[at]) & _LOW) & ((1 << lower) - 1))
        else:
            high = high ^ (_mixed((low + keys[at]) & _LOW) & ((1 << upper) - 1))
    return (high << lower) | low


def permuted(rows: np.ndarray, n: int, seed: int, inverse: bool = False) -> np.ndarray:
    """Places of row numbers in the shuffle (``inverse``: row numbers of places)."""
    keys = round_keys(seed)
    rows = np.asarray(rows, dtype=np.int64)
    if len(rows) and (rows.min() < 0 or rows.max() >= n):
        raise ValueError("row numbers must be within 0..n-1")
    out = _network(rows, n, keys, inverse)
    outside = np.flatnonzero(out >= n)
    while len(outside):
        out[outside] = _network(out[outside], n, keys, inverse)
        outside = outside[out[outside] >= n]
    return out


def place_of(row: int, n: int, shards: int, seed: int) -> tuple[int, int]:
    """(shard, slot) of a row number."""
    place = int(permuted(np.array([row]), n, seed)[0])
    return place % shards, place // shards


def row_of(shard: int, slot: int, n: int, shards: int, seed: int) -> int:
    """The row number at a slot of a shard."""
    return int(permuted(np.array([slot * shards + shard]), n, seed, inverse=True)[0])


def numbered(rows: DataFrame, order: list[Column], name: str) -> tuple[DataFrame, int]:
    """``rows`` with their number in ``order`` as column ``name``, and how many there are.

    One range shuffle: partitions are sorted, kept in the shared folder and counted; a row's
    number is its place in its partition plus the rows of all partitions before. Equal rows are
    told apart by where they were read, so that many of them spread over partitions; which of
    them gets which number makes no difference to the result.
    """
    tie, part, at, before = (unused(rows.columns, x) for x in ("tie", "part", "at", "before"))
    placed = rows.withColumn(tie, F.monotonically_increasing_id())
    placed = placed.repartitionByRange(*order, tie).sortWithinPartitions(*order, tie)
    placed = cut(
        placed.drop(tie)
        .withColumn(part, F.spark_partition_id())
        .withColumn(at, F.monotonically_increasing_id().bitwiseAND(F.lit((1 << 33) - 1)))
    )
    counts = placed.groupBy(part).agg(F.count("*").alias(before))
    upto = W.orderBy(part).rowsBetween(W.unboundedPreceding, -1)
    # One row a partition.
    starts = cut(
        counts.select(part, before, F.coalesce(F.sum(before).over(upto), F.lit(0)).alias(at))
    )
    total = starts.agg(F.sum(before)).first()[0] or 0
    first = starts.select(F.col(part).alias(before), F.col(at).alias(name))
    found = placed.join(F.broadcast(first), F.col(part) == F.col(before))
    return (
        found.withColumn(name, F.col(name) + F.col(at)).select(*rows.columns, name),
        int(total),
    )


def assign(
    docs: DataFrame, shards: int = 8, seed: int = 7, order: tuple[str, ...] = ("doc_id",)
) -> DataFrame:
    """All columns of ``docs`` with shard_row, shard_place (long), shard (int), slot (long).

    Rows are numbered by the columns ``order`` (nulls first) and then by a hash of the whole
    row, whatever the files and their partitions; equal rows are rows of their own and
    interchangeable. Shards have equal numbers of rows, or one more in the first ones, and
    slots 0, 1, 2, ...; row numbers, and so shards, depend on all rows. Texts may be null,
    empty or very long, they only move with their row. An empty table gives an empty result.
    Input columns of the four result names are replaced.
    """
    if shards < 1:
        raise ValueError("at least one shard")
    made = ("shard_row", "shard_place", "shard", "slot")
    kept = docs.select(*[c for c in docs.columns if c.lower() not in made])
    whole = unused(kept.columns, "whole")
    hashed = kept.withColumn(whole, F.xxhash64(*kept.columns))
    rows, n = numbered(
        hashed, [*(F.col(c).asc_nulls_first() for c in order), F.col(whole)], "shard_row"
    )

    def run(numbers: pd.Series) -> pd.Series:
        return pd.Series(permuted(numbers.to_numpy(), n, seed))

    place = F.pandas_udf(run, "long")
    return rows.withColumn("shard_place", place("shard_row")).select(
        *kept.columns,
        "shard_row",
        "shard_place",
        F.pmod("shard_place", F.lit(shards)).cast("int").alias("shard"),
        F.expr(f"shard_place div {shards}").alias("slot"),
    )


def write_shards(assigned: DataFrame, path: str, files_of: int = 1_000_000) -> None:
    """Write ``assigned`` as Parquet, one folder a shard, its files sorted by slot.

    A file takes the slots of one range of ``files_of``, so that a slot's file is known too.
    """
    block = unused(assigned.columns, "block")
    (
        assigned.withColumn(block, F.expr(f"slot div {int(files_of)}"))
        .repartition("shard", block)
        .sortWithinPartitions("shard", "slot")
        .drop(block)
        .write.partitionBy("shard")
        .parquet(path)
    )
