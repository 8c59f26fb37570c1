"""Embedding near-duplicates by sorted projection passes.

Each pass orders the vectors of a label lexicographically by concatenated random hashes (signs
of random projections) and compares every vector with its neighbours in a window of that order.
Ranks of all passes are found first, on hashes and ids alone. A pair belongs to the first pass
in which both are in one window, which any task can tell from the ranks that travel with the
vectors, so links are counted once without ever listing pairs; for the components each block
sends a spanning forest of its links. The number of passes follows from how many leading bits
the windows' vectors share, measured over the sorted hashes of all of them, so that a pair at the
threshold is missed with a chance of at most ``miss``, also where vectors point one way.

A vector whose window is full of links may have more of them outside. Such crowded vectors are
compared once more, with all of their component, in pairs of blocks.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .components import components
from .shared import cut, usable

_BITS = 60
_TRIAL = 3


def _hashes(vectors: np.ndarray, passes: int, seed: int) -> np.ndarray:
    """One number of _BITS random sign bits per vector and pass, first projections first."""
    out = np.empty((len(vectors), passes), np.int64)
    weights = 1 << np.arange(_BITS - 1, -1, -1, dtype=np.int64)
    for p in range(passes):
        plane = np.random.default_rng((seed, p)).standard_normal((vectors.shape[1], _BITS))
        out[:, p] = (vectors @ plane > 0) @ weights
    return out


def _keys(distinct: DataFrame, passes: int, seed: int) -> DataFrame:
    """(id, label, pass, hash, other) of every vector and pass; other is the next pass's hash."""

    def run(batches):
        for batch in batches:
            lengths = batch.column(2).value_lengths().to_numpy(zero_copy_only=False)
            found = np.empty((batch.num_rows, passes), np.int64)
            for length in np.unique(lengths):
                at = np.nonzero(lengths == length)[0]
                found[at] = _hashes(_unit(_matrix(batch.column(2).take(pa.array(at)))), passes, seed)
            every = pa.array(np.repeat(np.arange(batch.num_rows), passes))
            yield pa.RecordBatch.from_arrays(
                [
                    batch.column(0).take(every),
                    batch.column(1).take(every),
                    pa.array(np.tile(np.arange(passes, dtype=np.int32), batch.num_rows)),
                    pa.array(found.reshape(-1)),
                    pa.array(np.roll(found, -1, axis=1).reshape(-1)),
                ],
                names=["id", "label", "pass", "hash", "other"],
            )

    return distinct.select("id", "label", "vector").mapInArrow(
        run, "id long, label string, pass int, hash long, other long"
    )


def _matrix(column: pa.Array) -> np.ndarray:
    """Vectors as rows of doubles; shorter ones, whose labels differ, are filled with zeros."""
    flat = np.asarray(column.flatten(), np.float64)
    lengths = column.value_lengths().to_numpy(zero_copy_only=False).astype(np.int64)
    widest = int(lengths.max(initial=1))
    if (lengths == widest).all():
        return flat.reshape(len(column), widest)
    out = np.zeros((len(column), widest))
    row = np.repeat(np.arange(len(column)), lengths)
    out[row, np.arange(len(flat)) - np.repeat(np.cumsum(lengths) - lengths, lengths)] = flat
    return out


def _unit(vectors: np.ndarray) -> np.ndarray:
    """Rows of length 1; divided by the largest entry first, so that no square over- or underflows."""
    vectors = vectors / np.abs(vectors).max(axis=1, keepdims=True)
    return vectors / np.linalg.norm(vectors, axis=1, keepdims=True)


def passes_for(spans: dict[int, int], threshold: float, miss: float) -> int:
    """Passes needed so that a pair at the threshold is missed with a chance of at most ``miss``.

    ``spans``: number of vectors by how many leading bits hold their window; two vectors that
    agree in one bit more are in one window, whatever else is.
    """
    total = sum(spans.values())
    if not total:
        return 2
    same_bit = 1 - math.acos(threshold) / math.pi
    hits = [(min(same_bit ** (bits + 1) if bits >= 0 else 1.0, 0.99), n / total) for bits, n in spans.items()]

    def missed(passes: int) -> float:
        return sum(part * (1 - hit) ** passes for hit, part in hits)

    most = 2
    while missed(most) > miss:
        most *= 2
    return next(p for p in range(max(2, most // 2), most + 1) if missed(p) <= miss)


def _spans(keys: DataFrame, window: int, threshold: float) -> dict[int, int]:
    """Vectors of sorted passes by the bits that they share with the one ``window`` ranks on.

    -1 stands for labels that end before, and for windows full of links, whose vectors are counted
    another way: by bits of another hash the last one is as near as the threshold. At most
    _BITS + 2 rows. Vectors whose window ends in another task's rows are left out, as this only
    sets the number of passes.
    """
    # Bits that two vectors at the threshold may differ in.
    near = _BITS * math.acos(threshold) / math.pi + 1

    def run(batches):
        counts: dict[int, int] = {}
        parts: list[list[np.ndarray]] = [[], [], []]
        held = 0

        def count():
            joined = [np.concatenate(p) for p in parts]
            for bits, n in _agreed(*joined, window, near):
                counts[bits] = counts.get(bits, 0) + n
            return [[p[-window:]] for p in joined]

        for batch in batches:
            for part, column in zip(parts, batch.columns):
                part.append(column.to_numpy(zero_copy_only=False))
            held += batch.num_rows
            if held > 64 * window:
                parts, held = count(), window
        if held:
            count()
        yield pa.RecordBatch.from_arrays(
            [pa.array(list(counts), pa.int32()), pa.array(list(counts.values()), pa.int64())],
            names=["bits", "n"],
        )

    placed = keys.repartitionByRange("pass", "label", "hash", "id")
    rows = placed.sortWithinPartitions("pass", "label", "hash", "id").select(
        F.concat_ws("/", "pass", "label").alias("label"), "hash", "other"
    )
    found = rows.mapInArrow(run, "bits int, n long").groupBy("bits").agg(F.sum("n").alias("n"))
    return {r["bits"]: r["n"] for r in found.collect()}


def _agreed(labels: np.ndarray, hashes: np.ndarray, others: np.ndarray, window: int, near: float):
    """(bits, vectors) of the pairs of rows ``window`` apart; see ``_spans``."""
    if len(labels) <= window:
        return []
    inside = labels[:-window] == labels[window:]
    inside &= np.bitwise_count(others[:-window] ^ others[window:]) > near
    apart = (hashes[:-window] ^ hashes[window:])[inside]
    bits = np.full(len(apart), _BITS)
    some = apart > 0
    bits[some] = _BITS - 1 - np.floor(np.log2(apart[some].astype(np.float64))).astype(int)
    values, n = np.unique(np.append(bits, np.full(int((~inside).sum()), -1)), return_counts=True)
    return zip(values.tolist(), n.tolist())


def _global_ranks(keys: DataFrame) -> DataFrame:
    """(id, pass, rank): places in the order of (pass, label, hash, id), by range sort."""
    n = max(1, int(keys.sparkSession.conf.get("spark.sql.shuffle.partitions")))
    order = ["pass", "label", "hash", "id"]
    placed = cut(
        keys.repartitionByRange(n, *order)
        .sortWithinPartitions(*order)
        .select("id", "pass", F.monotonically_increasing_id().alias("place"))
    )
    part = F.shiftright("place", 33)
    # One row per partition.
    sizes = placed.groupBy(part.alias("part")).count().orderBy("part").collect()
    starts, at = [], 0
    for row in sizes:
        starts.append((row["part"], at))
        at += row["count"]
    table = keys.sparkSession.createDataFrame(starts, "part long, start long")
    low = F.col("place") - F.shiftleft(part, 33)
    return placed.join(F.broadcast(table), part == F.col("part")).select(
        "id", "pass", (F.col("start") + low).alias("rank")
    )


def _compare(table: pa.Table, block_rows: int, window: int, threshold: float) -> pa.Table:
    """Links of one block of one pass: new links per vector, and a spanning forest.

    ``crowded`` marks vectors with links to a quarter of their window or more.
    """
    p = table.column("pass")[0].as_py()
    ids = table.column("id").to_numpy()
    ranks = np.asarray(table.column("ranks").combine_chunks().flatten()).reshape(len(ids), -1)
    order = np.argsort(ranks[:, p], kind="stable")
    ids, ranks = ids[order], ranks[order]
    vectors = _matrix(table.column("vector").combine_chunks())[order]
    vectors = _unit(vectors)
    labels = np.unique(table.column("label").to_numpy(zero_copy_only=False), return_inverse=True)[1][order]
    weights = table.column("weight").to_numpy()[order]
    block = table.column("block")[0].as_py()
    mine = ranks[:, p] // block_rows == block
    counts = np.zeros(len(ids), np.int64)
    inside = np.zeros(len(ids), np.int64)
    parent = np.arange(len(ids))

    def root(x: int) -> int:
        while parent[x] != x:
            parent[x] = parent[parent[x]]
            x = parent[x]
        return x

    step = 256
    for at in range(0, int(mine.sum()), step):
        end = min(at + step, int(mine.sum()))
        stop = min(end + window, len(ids))
        close = vectors[at:end] @ vectors[at:stop].T >= threshold
        i, j = np.nonzero(close)
        i, j = i + at, j + at
        # Either vector may be the first; each pair of ranks at most ``window`` apart once.
        keep = (j > i) & (ranks[j, p] - ranks[i, p] <= window) & (labels[i] == labels[j])
        i, j = i[keep], j[keep]
        inside += np.bincount(i, minlength=len(ids)) + np.bincount(j, minlength=len(ids))
        fresh = np.ones(len(i), bool)
        for q in range(p):
            fresh &= np.abs(ranks[i, q] - ranks[j, q]) > window
        i, j = i[fresh], j[fresh]
        np.add.at(counts, i, weights[j])
        np.add.at(counts, j, weights[i])
        for x, y in zip(i.tolist(), j.tolist()):
            a, b = root(x), root(y)
            if a != b:
                parent[max(a, b)] = min(a, b)
    roots = np.array([root(x) for x in range(len(ids))], np.int64)
    some = (counts > 0) | (inside >= window // 2)
    return pa.table(
        {
            "id": pa.array(ids[some]),
            "n": pa.array(counts[some]),
            "root": pa.array(ids[roots[some]]),
            "crowded": pa.array(inside[some] >= window // 2),
        }
    )


def _count_all(table: pa.Table, threshold: float) -> pa.Table:
    """Links between (or within) the two blocks of a component that meet in this group."""
    a, b = table.column("a")[0].as_py(), table.column("b")[0].as_py()
    ids, own = table.column("id").to_numpy(), table.column("own").to_numpy()
    vectors = _matrix(table.column("vector").combine_chunks())
    vectors = _unit(vectors)
    weights = table.column("weight").to_numpy()
    left, right = np.nonzero(own == a)[0], np.nonzero(own == b)[0]
    counts = np.zeros(len(ids), np.int64)
    for at in range(0, len(left), 256):
        i = left[at : at + 256]
        close = vectors[i] @ vectors[right].T >= threshold
        if a == b:
            close &= i[:, None] != right[None, :]
        counts[i] += close @ weights[right]
        if a != b:
            counts[right] += weights[i] @ close
    return pa.table({"id": pa.array(ids), "n": pa.array(counts)})


def _recount(crowded: DataFrame, distinct: DataFrame, threshold: float, block_rows: int) -> DataFrame:
    """(id, exact): links of all members of crowded components, counted against all of them.

    ``crowded``: (id, component) of the members.
    """
    sizes = crowded.groupBy("component").agg(
        F.ceil(F.count("*") / block_rows).cast("long").alias("blocks")
    )
    rows = (
        crowded.join(sizes, "component")
        .join(distinct.select("id", "weight", "vector"), "id")
        .withColumn("own", F.pmod(F.xxhash64("id"), F.col("blocks")))
    )
    pairs = rows.select(
        "component", "id", "weight", "vector", "own",
        F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)).alias("other"),
    ).select("*", F.least("own", "other").alias("a"), F.greatest("own", "other").alias("b"))
    return (
        pairs.groupBy("component", "a", "b")
        .applyInArrow(lambda t: _count_all(t, threshold), "id long, n long")
        .groupBy("id")
        .agg(F.sum("n").alias("exact"))
    )


def near_duplicates(
    vectors: DataFrame,
    id_column: str = "vec_id",
    vector_column: str = "embedding",
    label_column: str = "label",
    threshold: float = 0.93,
    window: int = 512,
    block_rows: int = 2048,
    miss: float = 0.01,
    seed: int = 11,
) -> DataFrame:
    """One row for each row of ``vectors``: vec_id, n_links, component_id, kept.

    Two vectors with equal labels that are not null are linked if their cosine, in double
    precision, reaches ``threshold`` and a pass brings them into one window. Vectors that are
    null, zero, or hold null or non-finite components, and vectors without a label, have no
    links and are components of their own. Equal vectors of a label are compared as one and
    linked with each other; vectors of different lengths never are. Rows with null ids take no
    part and are kept alone. Of different vectors with one id any one takes part; rows that
    repeat an id share its result. Extra columns are ignored; an empty table gives none.
    """
    vector = F.col(vector_column).cast("array<double>")
    rows = vectors.select(F.col(id_column).cast("long").alias("id"))
    good = vectors.select(
        F.col(id_column).cast("long").alias("id"),
        F.concat_ws(":", F.size(vector), F.col(label_column).cast("string")).alias("label"),
        # Equal vectors stand for their least id; 0 and -0 are equal.
        F.transform(vector, lambda x: x + F.lit(0.0)).alias("vector"),
    ).filter(
        usable("vector") & F.col(label_column).isNotNull() & F.col(id_column).isNotNull()
    )
    keyed = cut(
        good.withColumn("h1", F.xxhash64("vector")).withColumn(
            "h2", F.xxhash64(F.lit(1), "vector")
        )
    )
    alike = keyed.groupBy("label", "h1", "h2").agg(
        F.min("id").alias("id"), F.count("*").alias("weight"), F.first("vector").alias("vector")
    )
    distinct = cut(alike.dropDuplicates(["id"]))
    # How long the windows' common prefixes are is seen in a few passes.
    passes = passes_for(_spans(_keys(distinct, _TRIAL, seed), window, threshold), threshold, miss)
    keys = _keys(distinct, passes, seed)
    ranks = (
        _global_ranks(keys)
        .groupBy("id")
        .agg(F.array_sort(F.collect_list(F.struct("pass", "rank"))).alias("r"))
        .select("id", F.col("r.rank").alias("ranks"))
    )
    ranked = distinct.select("id", "label", "weight", "vector").join(ranks, "id")
    rank = F.col("rank")
    block = F.floor(rank / block_rows)
    # The first rows of a block are also the window of the block before.
    blocks = F.when((rank % block_rows < window) & (block > 0), F.array(block, block - 1))
    links = cut(
        ranked.select("*", F.posexplode("ranks").alias("pass", "rank"))
        .withColumn("block", F.explode(blocks.otherwise(F.array(block))))
        .groupBy("pass", "block")
        .applyInArrow(
            lambda t: _compare(t, block_rows, window, threshold),
            "id long, n long, root long, crowded boolean",
        )
    )
    grouped = cut(components(links.select("id", "root")).withColumnRenamed("node", "id"))
    counted = links.groupBy("id").agg(F.sum("n").alias("n"))
    full = links.filter("crowded").select("id").distinct()
    crowds = full.join(grouped, "id").select("component").distinct()
    exact = _recount(
        grouped.join(crowds, "component", "left_semi"), distinct, threshold, block_rows
    )
    by_first = (
        distinct.select("label", "h1", "h2", "id", "weight")
        .join(counted, "id", "left")
        .join(exact, "id", "left")
        .join(grouped, "id", "left")
        .select(
            "label",
            "h1",
            "h2",
            (F.coalesce("exact", "n", F.lit(0)) + F.col("weight") - 1).alias("n_links"),
            F.coalesce("component", "id").alias("component_id"),
        )
    )
    result = (
        keyed.join(by_first, ["label", "h1", "h2"])
        .groupBy("id")
        .agg(F.max("n_links").alias("n_links"), F.min("component_id").alias("component_id"))
    )
    return rows.join(result, "id", "left").select(
        F.col("id").alias("vec_id"),
        F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"),
        F.coalesce("component_id", "id").alias("component_id"),
        F.coalesce(F.coalesce("component_id", "id") == F.col("id"), F.lit(True)).alias("kept"),
    )
