"""Removal of boilerplate lines by the number of distinct sites that hold them.

Every line is hashed. One HyperLogLog sketch of sites per line hash is merged by aggregation;
where its estimate is too near the threshold to decide, the sites are counted exactly. Copies
of a line on one site are reduced before the sketches are built, so a line that a third of all
documents hold sends at most its sites per task.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .shared import cut, inner

_LG_K = 10
_SLICES = 16
# Up to so many line hashes (8 bytes each) are sent to every executor; more are joined by shuffle.
_BROADCAST_ROWS = 500_000
# Six standard errors of a sketch with 2**_LG_K registers.
_DOUBT = 6 * 1.04 / 2 ** (_LG_K / 2)


def _line_hashes(text: str) -> F.Column:
    """(position, hash) of the lines that are not blank."""
    return F.filter(
        F.transform(
            F.split(text, "\n"),
            lambda x, i: F.struct(
                i.alias("line"),
                F.when(F.trim(x) != "", F.xxhash64(F.trim(x))).alias("hash"),
            ),
        ),
        lambda x: x["hash"].isNotNull(),
    )


def widespread(lines: DataFrame, min_sites: int) -> DataFrame:
    """(hash) of lines on at least ``min_sites`` distinct sites; ``lines``: hash, site."""
    once = lines.filter(F.col("site").isNotNull()).groupBy("hash", "site").agg(F.lit(1).alias("one"))
    # A line on one site alone needs no sketch.
    several = (
        once.groupBy("hash")
        .agg(F.min("site").alias("low"), F.max("site").alias("high"))
        .filter("low <> high" if min_sites > 1 else "true")
        .select("hash")
    )
    held = cut(once.select("hash", "site").join(several, "hash"))
    # One sketch for each slice of a line's sites, so that no task reads all of a hot line's.
    sliced = held.groupBy("hash", F.pmod("site", F.lit(_SLICES)).alias("slice")).agg(
        F.hll_sketch_agg("site", F.lit(_LG_K)).alias("sketch")
    )
    merged = sliced.groupBy("hash").agg(F.hll_union_agg("sketch").alias("sketch"))
    judged = cut(merged.select("hash", F.hll_sketch_estimate("sketch").alias("estimate")))
    sure = judged.filter(F.col("estimate") > min_sites * (1 + _DOUBT) + 1).select("hash")
    doubtful = judged.filter(
        F.col("estimate").between(min_sites * (1 - _DOUBT) - 1, min_sites * (1 + _DOUBT) + 1)
    )
    counted = (
        held.join(doubtful, "hash", "left_semi")
        .groupBy("hash")
        .agg(F.count("*").alias("sites"))
        .filter(F.col("sites") >= min_sites)
        .select("hash")
    )
    return sure.union(counted)


def remove_boilerplate(docs: DataFrame, site: str, min_sites: int = 10) -> DataFrame:
    """All columns of ``docs`` with ``text`` less its widespread lines, and ``n_lines``,
    ``n_removed``.

    Lines end at a line feed and are compared without outer spaces; blank lines are kept and
    never counted. ``site`` is an SQL expression; a null site counts for no line. A text that
    loses all its lines becomes empty, a null text stays null with 0 lines. Rows with equal or
    null ids are separate documents. Texts of any length are split whole, in the memory of one
    task. Input columns n_lines and n_removed are replaced; other names may be any. An empty table
    gives an empty result.
    """
    rows, names = inner(
        docs,
        ("text", "n_lines", "n_removed"),
        text=F.col("text"),
        key=F.xxhash64("doc_id", "text"),
        site=F.expr(site).cast("string"),
    )
    found = rows.select(
        F.when(F.col("site").isNotNull(), F.xxhash64("site")).alias("mark"),
        F.inline(_line_hashes("text")),
    )
    bad = cut(widespread(found.select("hash", F.col("mark").alias("site")), min_sites))
    if bad.count() <= _BROADCAST_ROWS:
        bad = F.broadcast(bad)
    # Which documents hold a bad line: by document content, so that equal rows share a key.
    held = (
        rows.select("key", F.inline(_line_hashes("text")))
        .join(bad, "hash", "left_semi")
        .distinct()
        .groupBy("key")
        .agg(F.collect_set("hash").alias("bad"))
    )
    joined = rows.join(held, "key", "left")
    lines = F.split("text", "\n")
    left = F.filter(
        lines,
        lambda x: (F.trim(x) == "") | ~F.array_contains("bad", F.xxhash64(F.trim(x))),
    )
    text = F.when(F.col("bad").isNull(), F.col("text")).otherwise(F.array_join(left, "\n"))
    n_lines = F.when(F.col("text").isNull(), 0).otherwise(F.size(lines))
    removed = F.when(F.col("bad").isNull(), 0).otherwise(F.size(lines) - F.size(left))
    done = joined.select(
        *names.values(),
        text.alias("left"),
        n_lines.cast("long").alias("lines"),
        removed.cast("long").alias("removed"),
    )
    return done.select(
        *[
            F.col(names.get(c, "left")).alias(c)
            for c in docs.columns
            if c in names or c.lower() == "text"
        ],
        F.col("lines").alias("n_lines"),
        F.col("removed").alias("n_removed"),
    )
