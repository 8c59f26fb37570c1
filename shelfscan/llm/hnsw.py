"""Approximate nearest neighbours by inner product: one HNSW graph per shard.

Vectors are dealt to shards by hash; a shard has a bounded number of rows, so the graph of a
shard is built in one task's memory however many shards there are. A graph is one row of flat
arrays: vectors, ids, and per layer the members and a fixed number of neighbour positions each.
Blocks of queries are sent to every shard, and the shards' results are merged by rank.

Inner products become distances by one more component that gives all vectors of a shard the
length of its longest; shards are kept apart by bands of norms, so that this component does not
drown the others. Equal vectors are one node that carries as many of its least ids as a
result can hold, which is all that a search can return of them.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .shared import cut, usable

_FANOUT = 16
_TOGETHER = 16
_INDEX = (
    "shard int, length int, nodes binary, vectors binary, held binary, held_ids binary, "
    "layers array<struct<members: binary, links: binary>>"
)


def _lengthened(vectors: np.ndarray) -> np.ndarray:
    """One more component, so that all are as long as the longest, which is scaled to 1."""
    vectors = vectors / np.abs(vectors).max()
    squares = (vectors**2).sum(axis=1)
    most = squares.max()
    rest = np.sqrt(np.maximum(most - squares, 0.0))
    return (np.concatenate([vectors, rest[:, None]], axis=1) / np.sqrt(most)).astype(np.float32)


def _directions(queries: np.ndarray) -> np.ndarray:
    queries = queries / np.abs(queries).max(axis=1, keepdims=True)
    return queries / np.linalg.norm(queries, axis=1, keepdims=True)


def _search(
    space: np.ndarray, links: np.ndarray, queries: np.ndarray, starts: np.ndarray, width: int
) -> tuple[np.ndarray, np.ndarray]:
    """Best-first search of one layer for many queries in step.

    Returns positions and squared distances, nearest first, padded with -1 and infinity.
    ``starts``: (queries, k) positions to begin with, -1 for none.
    """
    n, rows = len(queries), np.arange(len(queries))[:, None]
    seen = np.zeros((n, len(space) + 1), bool)
    seen[:, -1] = True  # position -1 is no node
    norms = np.einsum("ij,ij->i", space, space)

    def distances(at: np.ndarray) -> np.ndarray:
        d = norms[at] - 2 * np.einsum("qkd,qd->qk", space[at], queries)
        return np.where(at < 0, np.inf, d)

    best = np.full((n, width), -1)
    near = np.full((n, width), np.inf, np.float32)
    best[:, : starts.shape[1]] = starts[:, :width]
    near[:, : starts.shape[1]] = distances(starts[:, :width])
    seen[rows, starts] = True
    open_ = best >= 0
    while True:
        # The two nearest nodes of each query that are not expanded yet.
        waiting = np.where(open_, near, np.inf)
        chosen = np.argpartition(waiting, 1, axis=1)[:, :2] if width > 1 else waiting.argmin(1)[:, None]
        ready = np.take_along_axis(waiting, chosen, 1) < np.inf
        active = ready.any(axis=1)
        if not active.any():
            break
        a = np.nonzero(active)[0]
        rows_a = a[:, None]
        picked = np.where(ready[a], best[rows_a, chosen[a]], -1)
        np.put_along_axis(open_, chosen, False, 1)
        found = []
        for k in range(picked.shape[1]):
            part = np.where(picked[:, k : k + 1] < 0, -1, links[picked[:, k]])
            part = np.where(seen[rows_a, part], -1, part)
            seen[rows_a, part] = True
            found.append(part)
        more = np.concatenate(found, axis=1)
        d = norms[more] - 2 * np.einsum("qkd,qd->qk", space[more], queries[a])
        d = np.where(more < 0, np.inf, d)
        every = np.concatenate([best[a], more], axis=1)
        dist = np.concatenate([near[a], d], axis=1)
        state = np.concatenate([open_[a], more >= 0], axis=1)
        keep = np.argpartition(dist, width - 1, axis=1)[:, :width]
        best[a] = np.take_along_axis(every, keep, 1)
        near[a] = np.take_along_axis(dist, keep, 1)
        open_[a] = np.take_along_axis(state, keep, 1) & (near[a] < np.inf)
    order = near.argsort(axis=1)
    near = np.take_along_axis(near, order, 1)
    best = np.where(near < np.inf, np.take_along_axis(best, order, 1), -1)
    return best, near


def _diverse(space: np.ndarray, node: np.ndarray, cand: np.ndarray, most: int) -> np.ndarray:
    """Neighbours for each node out of its candidates (nearest first, -1 for none).

    A candidate nearer to a chosen neighbour than to the node gives way; free places are
    filled with the nearest that gave way.
    """
    n, k = cand.shape
    points = space[cand]
    norms = np.einsum("nkd,nkd->nk", points, points)
    own = space[node]
    to_node = norms + np.einsum("nd,nd->n", own, own)[:, None] - 2 * np.einsum("nkd,nd->nk", points, own)
    between = norms[:, :, None] + norms[:, None, :] - 2 * (points @ points.transpose(0, 2, 1))
    valid = cand >= 0
    chosen = np.zeros((n, k), bool)
    for j in range(k):
        blocked = (chosen & (between[:, j, :] < to_node[:, j : j + 1])).any(axis=1)
        chosen[:, j] = valid[:, j] & ~blocked & (chosen.sum(axis=1) < most)
    # Chosen first, then the others in order.
    rank = np.where(chosen, 0, np.where(valid, 1, 2)) * k + np.arange(k)
    order = rank.argsort(axis=1)[:, :most]
    out = np.take_along_axis(cand, order, 1)
    return np.pad(out, ((0, 0), (0, most - out.shape[1])), constant_values=-1)


def build_graph(vectors: np.ndarray, seed: int = 5, width: int = 96):
    """(members, links) per layer, bottom first; links are positions in the shard.

    Nodes are inserted in growing batches; a batch sees the graph before it and itself.
    """
    space = _lengthened(vectors)
    n = len(space)
    rng = np.random.default_rng(seed)
    levels = np.minimum((-np.log(rng.random(n)) / np.log(_FANOUT)).astype(int), 6)
    order = rng.permutation(n)
    top = int(levels.max(initial=0))
    layers = [np.full((n + 1, _FANOUT * (2 if level == 0 else 1)), -1) for level in range(top + 1)]
    # The entry is the first inserted of the highest nodes.
    entry = int(order[np.argmax(levels[order] == top)])
    order = np.concatenate(([entry], order[order != entry]))
    done = 1
    while done < n:
        batch = order[done : done + min(512, max(1, done // 2))]
        at = np.full((len(batch), 1), entry)
        queries = space[batch]
        for level in range(top, -1, -1):
            links = layers[level]
            inserting = levels[batch] >= level
            found, _ = _search(space, links[:-1], queries, at[:, :1], width if inserting.any() else 1)
            at = found[:, :1]
            rows = np.nonzero(inserting)[0]
            if not len(rows):
                continue
            nodes = batch[rows]
            # Candidates: what the search found, and the nearest of the batch itself.
            inner = space[nodes]
            squares = np.einsum("nd,nd->n", inner, inner)
            apart = squares[:, None] + squares[None, :] - 2 * (inner @ inner.T)
            np.fill_diagonal(apart, np.inf)
            near_batch = nodes[np.argsort(apart, axis=1)[:, : min(16, len(nodes) - 1)]]
            cand = np.concatenate([found[rows][:, :48], near_batch.reshape(len(nodes), -1)], axis=1)
            cand = _sorted(space, nodes, cand)
            most = links.shape[1]
            links[nodes] = _diverse(space, nodes, cand, most)
            _link_back(space, links, nodes, most)
        done += len(batch)
    out = []
    for level, links in enumerate(layers):
        members = np.nonzero(levels >= level)[0]
        out.append((members, links[members]))
    return entry, out


def _sorted(space: np.ndarray, nodes: np.ndarray, cand: np.ndarray) -> np.ndarray:
    """Candidates of each node nearest first, repeats and the node itself removed."""
    cand = np.where(cand == nodes[:, None], -1, cand)
    by_id = np.sort(cand, axis=1)
    by_id[:, 1:][by_id[:, 1:] == by_id[:, :-1]] = -1
    points = space[by_id]
    d = ((points - space[nodes][:, None, :]) ** 2).sum(axis=2)
    d = np.where(by_id < 0, np.inf, d)
    return np.take_along_axis(by_id, d.argsort(axis=1), 1)


def _link_back(space: np.ndarray, links: np.ndarray, nodes: np.ndarray, most: int) -> None:
    """Add the reverse of new links; where a node has too many, choose again."""
    source = np.repeat(nodes, most)
    target = links[nodes].reshape(-1)
    keep = target >= 0
    source, target = source[keep], target[keep]
    order = np.argsort(target, kind="stable")
    source, target = source[order], target[order]
    unique, first, count = np.unique(target, return_index=True, return_counts=True)
    widest = int(count.max(initial=0))
    more = np.full((len(unique), widest), -1)
    column = np.arange(len(target)) - np.repeat(first, count)
    more[np.repeat(np.arange(len(unique)), count), column] = source
    for at in range(0, len(unique), 256):
        u = unique[at : at + 256]
        cand = _sorted(space, u, np.concatenate([links[u], more[at : at + 256]], axis=1))
        links[u] = _diverse(space, u, cand[:, : most * 3], most)


def search_graph(entry: int, layers, vectors: np.ndarray, queries: np.ndarray, k: int, width: int):
    """Positions of about the ``width`` (k at least) largest inner products for each query, -1
    for none; they are to be ranked by exact products."""
    space = _lengthened(vectors)
    n = len(space)
    asked = _directions(queries)
    asked = np.concatenate([asked, np.zeros((len(queries), 1))], axis=1).astype(np.float32)
    at = np.full((len(queries), 1), entry)
    for level in range(len(layers) - 1, -1, -1):
        members, links = layers[level]
        full = np.full((n, links.shape[1]), -1)
        full[members] = links
        found, _ = _search(space, full, asked, at, max(width, k) if level == 0 else 1)
        at = found[:, :1]
    return found


def _shard_row(table: pa.Table, copies: int) -> pa.Table:
    """The index row of one shard; input: shard, length, vector, ids (least of equal vectors)."""
    length = table.column("length")[0].as_py()
    table = table.sort_by("first")
    vectors = np.asarray(table.column("vector").combine_chunks().flatten(), np.float64).reshape(-1, length)
    held = table.column("ids").combine_chunks()
    entry, layers = build_graph(vectors)
    return pa.table(
        {
            "shard": pa.array([table.column("shard")[0].as_py()], pa.int32()),
            "length": pa.array([length], pa.int32()),
            "nodes": pa.array([np.array([entry], "<i4").tobytes()]),
            "vectors": pa.array([vectors.astype("<f8").tobytes()]),
            "held": pa.array([held.value_lengths().to_numpy(zero_copy_only=False).astype("<i4").tobytes()]),
            "held_ids": pa.array([np.asarray(held.flatten(), "<i8").tobytes()]),
            "layers": pa.array(
                [[{"members": m.astype("<i4").tobytes(), "links": x.astype("<i4").tobytes()} for m, x in layers]],
                pa.list_(pa.struct([("members", pa.binary()), ("links", pa.binary())])),
            ),
        }
    )


def _band(vector: str) -> F.Column:
    """Number of a vector's band of norms: 1/2 to 2 is 0, 2 to 8 is 1; nothing overflows."""
    largest = F.array_max(F.transform(vector, F.abs))
    rest = F.aggregate(
        vector, F.lit(0.0), lambda total, x: total + (x / largest) * (x / largest)
    )
    return F.floor((F.log2(largest) + F.log2(rest) / 2) / 2 + 0.5).cast("int")


def build_index(
    vectors: DataFrame, id_column: str, vector_column: str, shard_rows: int = 8192, copies: int = 21
) -> DataFrame:
    """One row per shard with its graph as flat arrays. Unusable vectors are left out.

    Equal vectors are one node with their ``copies`` least ids. Vectors with different numbers of
    components are in different shards, and so are vectors whose norms differ much: within a shard
    they differ by a factor of four at most, so that one long vector does not blur the others. Of
    repeated rows one counts; extra columns are ignored; an empty table gives an empty index.
    """
    good = vectors.select(
        F.col(id_column).cast("long").alias("id"),
        F.transform(F.col(vector_column).cast("array<double>"), lambda x: x + F.lit(0.0)).alias("vector"),
    ).filter(usable("vector") & F.col("id").isNotNull())
    first = F.row_number().over(W.partitionBy("vector").orderBy("id"))
    nodes = cut(
        good.distinct()
        .withColumn("n", first)
        .filter(F.col("n") <= copies)
        .groupBy("vector")
        .agg(F.sort_array(F.collect_list("id")).alias("ids"))
        .select(
            "vector", "ids", F.size("vector").alias("length"), F.col("ids")[0].alias("first"),
            _band("vector").alias("band"),
        )
    )
    # One row per number of components and band of norms, of which doubles have some 500.
    sizes = sorted((tuple(r[:2]), r[2]) for r in nodes.groupBy("length", "band").count().collect())
    shards, at = F.lit(None).cast("int"), 0
    for (length, band), n in sizes:
        count = -(-n // shard_rows)
        own = F.pmod(F.xxhash64("first"), F.lit(count)) + at
        shards = F.when((F.col("length") == length) & (F.col("band") == band), own).otherwise(shards)
        at += count
    return (
        nodes.withColumn("shard", shards.cast("int"))
        .drop("band")
        .repartitionByRange(max(1, at), "shard")
        .groupBy("shard")
        .applyInArrow(lambda t: _shard_row(t, copies), _INDEX)
    )


def _meet(shard: pa.Table, asked: pa.Table, k: int, width: int) -> pa.Table:
    """The k nearest of one shard for each query of some blocks."""
    out = []
    for row in shard.to_pylist() if asked.num_rows else []:
        length = row["length"]
        vectors = np.frombuffer(row["vectors"], "<f8").reshape(-1, length)
        fan = [(np.frombuffer(x["members"], "<i4"), x["links"]) for x in row["layers"]]
        layers = [(m, np.frombuffer(x, "<i4").reshape(len(m), -1)) for m, x in fan]
        entry = int(np.frombuffer(row["nodes"], "<i4")[0])
        held = np.frombuffer(row["held"], "<i4")
        ends = np.cumsum(held)
        held_ids = np.frombuffer(row["held_ids"], "<i8")
        queries = np.concatenate(
            [np.frombuffer(x, "<f8").reshape(-1, length) for x in asked.column("asked").to_pylist()]
        )
        query_ids = np.concatenate([np.frombuffer(x, "<i8") for x in asked.column("asked_ids").to_pylist()])
        for at in range(0, len(queries), 512):
            part, part_ids = queries[at : at + 512], query_ids[at : at + 512]
            found = search_graph(entry, layers, vectors, part, k + 1, width)
            # All that was found is ranked by exact products; k + 1 nodes hold the k best ids.
            exact = np.where(found < 0, -np.inf, np.einsum("qkd,qd->qk", vectors[found], part))
            least = -np.partition(-exact, min(k, exact.shape[1] - 1), axis=1)[:, min(k, exact.shape[1] - 1)]
            for query_id, nodes, scores, limit in zip(part_ids, found, exact, least):
                some = (nodes >= 0) & (scores >= limit)
                nodes, scores = nodes[some], scores[some]
                if not len(nodes):
                    continue
                ids = np.concatenate([held_ids[ends[x] - held[x] : ends[x]] for x in nodes])
                values = np.repeat(scores, held[nodes])
                own = ids != query_id
                ids, values = ids[own], values[own]
                best = np.lexsort((ids, -values))[:k]
                out.append((np.full(len(best), query_id), ids[best], values[best]))
    columns = [np.concatenate(c) for c in zip(*out)] if out else [[], [], []]
    return pa.table(
        {
            "query_id": pa.array(columns[0], pa.int64()),
            "id": pa.array(columns[1], pa.int64()),
            "score": pa.array(columns[2], pa.float64()),
        }
    )


def _query_block(table: pa.Table) -> pa.Table:
    length = table.column("length")[0].as_py()
    flat = np.asarray(table.column("vector").combine_chunks().flatten(), "<f8")
    return pa.table(
        {
            "length": pa.array([length], pa.int32()),
            "block": pa.array([table.column("block")[0].as_py()], pa.int64()),
            "asked": pa.array([flat.tobytes()]),
            "asked_ids": pa.array([table.column("id").to_numpy().astype("<i8").tobytes()]),
        }
    )


def search(
    index: DataFrame,
    queries: DataFrame,
    id_column: str,
    vector_column: str,
    k: int = 20,
    width: int = 160,
    block_rows: int = 2048,
) -> DataFrame:
    """(query_id, rank, id, score): each query's k nearest by inner product, itself excluded.

    Scores are in double precision on the original vectors; equal scores rank by id. A query
    with fewer candidates of its length gets all that are found. Unusable queries have no rows;
    repeated ids count as one query.
    """
    asked = queries.select(
        F.col(id_column).cast("long").alias("id"),
        F.col(vector_column).cast("array<double>").alias("vector"),
    ).filter(usable("vector") & F.col("id").isNotNull()).dropDuplicates(["id"])
    n = max(1, -(-asked.count() // block_rows))
    blocks = (
        asked.withColumn("length", F.size("vector"))
        .withColumn("block", F.pmod(F.xxhash64("id"), F.lit(n)))
        .groupBy("length", "block")
        .applyInArrow(_query_block, "length int, block long, asked binary, asked_ids binary")
    )
    # Every shard meets every block of its length. The blocks go to the shards, whose rows are
    # larger; a shard is copied once for _TOGETHER blocks, so that no task holds more of them.
    known = index.select(F.col("shard").alias("to"), F.col("length").alias("of_length"))
    sent = blocks.join(F.broadcast(known), F.col("length") == F.col("of_length")).select(
        "to", F.expr(f"block div {_TOGETHER}").alias("part"), "asked", "asked_ids"
    )
    parts = F.sequence(F.lit(0), F.lit((n - 1) // _TOGETHER)).cast("array<long>")
    resident = index.withColumn("part", F.explode(parts))
    found = (
        resident.groupBy("shard", "part")
        .cogroup(sent.groupBy("to", "part"))
        .applyInArrow(lambda a, b: _meet(a, b, k, width), "query_id long, id long, score double")
    )
    order = W.partitionBy("query_id").orderBy(F.desc("score"), "id")
    return (
        found.withColumn("rank", F.row_number().over(order))
        .filter(F.col("rank") <= k)
        .select("query_id", "rank", "id", "score")
    )
