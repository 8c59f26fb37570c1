"""Mixing sources to target weights through a tree of groups.

Built from DataFrame functions only. A budget of tokens is passed down the tree level by level.
At each node the children share what the node got in proportion to their weights; a child whose
supply (its tokens times ``max_epochs``) is smaller keeps its supply, and the others share the
rest in proportion. As a node's supply is that of all below it, a shortage is met by siblings
first and reaches an ancestor's siblings only when the whole node is short.

A leaf then takes whole epochs and a token-prefix of one more, in an order seeded by epoch. The
prefix is found from token sums of hash ranges; only the range that holds its end is sorted.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .shared import cut, inner

# Plans of up to so many rows (under 100 bytes each) go to every executor.
_BROADCAST_ROWS = 100_000


def _paths(levels: int) -> list[list[str]]:
    return [[f"level_{i}" for i in range(n)] for n in range(levels + 1)]


def allocate(leaves: DataFrame, levels: int, budget: Column, max_epochs: int) -> DataFrame:
    """Add ``target`` (whole tokens, rounded down) to ``leaves``.

    ``leaves``: one row per leaf with level_0.., weight_0.. (of the node at each level among
    its siblings) and ``tokens``. ``budget``: expression over ``all_tokens``.
    """
    paths = _paths(levels)
    supply = F.col("tokens").cast("double") * max_epochs
    rows = leaves.withColumn("supply", supply).withColumn("one", F.lit(1))
    total = W.partitionBy("one")
    rows = rows.withColumn("all_tokens", F.sum("tokens").over(total)).withColumn(
        "share", F.least(budget.cast("double"), F.sum("supply").over(total))
    )
    for n in range(levels):
        # One row per child carries its sums; the sibling order is by supply per weight.
        node, child = paths[n], paths[n + 1]
        sums = (
            rows.groupBy(*child)
            .agg(
                F.max(f"weight_{n}").alias("w"),
                F.sum("supply").alias("s"),
                F.max("share").alias("give"),
            )
            .withColumn("ratio", F.col("s") / F.col("w"))
        )
        order = [F.col("ratio").asc(), F.col(child[-1]).asc()]
        group = W.partitionBy(*node) if node else W.partitionBy(F.lit(1))
        before = group.orderBy(*order).rowsBetween(W.unboundedPreceding, -1)
        after = group.orderBy(*order).rowsBetween(0, W.unboundedFollowing)
        level = (
            (F.col("give") - F.coalesce(F.sum("s").over(before), F.lit(0.0)))
            / F.sum("w").over(after)
        )
        sums = sums.withColumn("level", level)
        # The first sibling, in that order, whose supply per weight covers the level.
        water = F.min(F.when(F.col("level") <= F.col("ratio"), F.struct("ratio", child[-1], "level")))
        sums = sums.withColumn("water", water.over(group)["level"]).withColumn(
            "share_", F.least(F.col("s"), F.coalesce(F.col("water") * F.col("w"), F.col("s")))
        )
        keys = [F.col(f"rows.{c}").eqNullSafe(F.col(f"sums.{c}")) for c in child]
        condition = keys[0]
        for key in keys[1:]:
            condition = condition & key
        rows = (
            rows.alias("rows")
            .join(sums.select(*child, "share_").alias("sums"), condition)
            .select("rows.*", "sums.share_")
            .drop("share")
            .withColumnRenamed("share_", "share")
        )
    return rows.withColumn("target", F.floor(F.col("share") + F.lit(1e-6)).cast("long")).drop(
        "supply", "share", "one"
    )


def place(seed: int, epoch: str, key: str) -> str:
    """SQL text: a document's hash in an epoch; 12 hex digits of an md5."""
    return f"substr(md5(concat('{seed}:', {epoch}, ':', {key})), 1, 12)"


def _small(df: DataFrame) -> DataFrame:
    """Computed once, and sent to every executor if its rows are counted and few."""
    df = cut(df)
    return F.broadcast(df) if df.count() <= _BROADCAST_ROWS else df


def mix(
    docs: DataFrame,
    levels: dict[str, str],
    weights: dict[str, list[tuple[str, float]]],
    budget_share: float = 1.0,
    max_epochs: int = 2,
    seed: int = 7,
    range_rows: int = 20_000,
) -> DataFrame:
    """Choose documents so that the tokens of the tree's nodes follow the target weights.

    ``levels``: name -> SQL expression over ``docs``, from the top of the tree to its leaves;
    null groups are named "unknown". ``weights``: level name -> (group, weight) among its
    siblings; groups not listed have weight 1. The budget is ``budget_share`` of all tokens;
    a text has one token more than it has spaces and line feeds.

    Returns all columns of ``docs`` with level columns ``mix_0``.., ``mix_tokens`` and
    ``mix_copies`` (at least 1): how often the document is to be used. Documents that are not
    chosen have no row. Repeated rows and null ids are documents of their own, ordered by the
    hash of id and text; equal rows are chosen together only if the prefix holds them all or
    by position where it ends among them. Texts of any length are counted whole. Input columns
    mix_0.., mix_tokens and mix_copies are replaced; other names may be any. Empty tables give an
    empty result.
    """
    names = list(levels)
    made = (*[f"mix_{i}" for i in range(len(names))], "mix_tokens", "mix_copies")
    text = F.coalesce("text", F.lit(""))
    bare = F.replace(F.replace(text, F.lit(" "), F.lit("")), F.lit("\n"), F.lit(""))
    words = 1 + F.octet_length(text) - F.octet_length(bare)
    rows, inputs = inner(
        docs,
        made,
        doc_id=F.col("doc_id"),
        hash=F.xxhash64("text"),
        mix_tokens=words.cast("long"),
        **{
            f"level_{i}": F.coalesce(F.expr(e).cast("string"), F.lit("unknown"))
            for i, e in enumerate(levels.values())
        },
    )
    path = [f"level_{i}" for i in range(len(names))]
    leaves = rows.groupBy(*path).agg(
        F.sum("mix_tokens").alias("tokens"), F.count("*").alias("n_docs")
    )
    for i, name in enumerate(names):
        weight = F.lit(1.0)
        for group, value in reversed(weights.get(name, [])):
            weight = F.when(F.col(f"level_{i}") == group, F.lit(float(value))).otherwise(weight)
        leaves = leaves.withColumn(f"weight_{i}", weight)
    budget = F.floor(F.col("all_tokens") * F.lit(budget_share))
    planned = _small(
        allocate(leaves, len(names), budget, max_epochs)
        .withColumn("whole", F.floor(F.col("target") / F.col("tokens")).cast("long"))
        .withColumn("rest", F.col("target") - F.col("whole") * F.col("tokens"))
        .withColumn("ranges", F.ceil(F.col("n_docs") / F.lit(range_rows)).cast("long"))
        .select(*path, "whole", "rest", "ranges")
    )
    identity = "coalesce(cast(doc_id as string), '')"
    placed = (
        rows.join(planned, path)
        .withColumn("place_", F.expr(place(seed, "cast(whole as string)", identity)))
        .withColumn(
            "range_",
            F.floor(
                F.conv("place_", 16, 10).cast("double") / F.lit(float(16**12)) * F.col("ranges")
            ).cast("long"),
        )
    )
    sums = placed.groupBy(*path, "range_", "rest").agg(F.sum("mix_tokens").alias("sum_"))
    running = W.partitionBy(*path).orderBy("range_")
    ends = _small(
        sums.withColumn("upto_", F.sum("sum_").over(running))
        .withColumn("from_", F.col("upto_") - F.col("sum_"))
        .select(
            *path,
            "range_",
            "from_",
            F.when(F.col("upto_") <= F.col("rest"), "all")
            .when(F.col("from_") < F.col("rest"), "part")
            .otherwise("none")
            .alias("take_"),
        )
    )
    known = placed.join(ends, [*path, "range_"])
    simple = known.filter("take_ <> 'part'").withColumn(
        "extra_", (F.col("take_") == "all").cast("long")
    )
    inside = W.partitionBy(*path, "range_").orderBy("place_", "doc_id", "mix_tokens", "hash")
    last = known.filter("take_ = 'part'").withColumn(
        "extra_",
        (
            F.col("from_")
            + F.sum("mix_tokens").over(inside.rowsBetween(W.unboundedPreceding, 0))
            <= F.col("rest")
        ).cast("long"),
    )
    chosen = simple.unionByName(last).withColumn("mix_copies", F.col("whole") + F.col("extra_"))
    return chosen.filter("mix_copies > 0").select(
        *[F.col(n).alias(c) for c, n in inputs.items()],
        *[F.col(c).alias(f"mix_{i}") for i, c in enumerate(path)],
        "mix_tokens",
        "mix_copies",
    )
