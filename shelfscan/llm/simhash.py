"""SimHash near-duplicates found through deletion-variant signatures.

A fingerprint is cut into ``bits // 2 + 1`` segments, so that of two fingerprints at most
``bits`` apart one segment differs in at most one bit. Every segment is indexed once for each
of its bits with that bit removed; equal variants are joined and verified by bit count.

Work is done on distinct fingerprints, so copies cost one row. A variant that more than
``crowd`` fingerprints share is not expanded into pairs: its fingerprints get keys with the
remaining differences removed as well, so that all fingerprints with an equal key are within
reach by construction and one link to the least of them says as much as all pairs would.
"""

from __future__ import annotations

from itertools import combinations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .components import components
from .shared import cut, inner

_BLOCK = 200_000


def _fingerprint(text: str, width: int) -> int:
    """Majority of the bits of the shingles' XXH64 (seed 42), as a signed 64-bit number."""
    from xxhash import xxh64_intdigest

    words = text.encode("utf-8", "replace").lower().split()
    if not words:
        return 0
    joined = b" ".join(words)
    n = max(1, len(words) - width + 1)
    ends = np.cumsum(np.fromiter(map(len, words), np.int64, len(words)) + 1) - 1
    starts = np.concatenate(([0], ends[:-1] + 1))[:n].tolist()
    stops = ends[min(width, len(words)) - 1 :].tolist()
    ones = np.zeros(64, np.int64)
    for at in range(0, n, _BLOCK):
        hashes = np.array(
            [
                xxh64_intdigest(joined[a:b], 42)
                for a, b in zip(starts[at : at + _BLOCK], stops[at : at + _BLOCK])
            ],
            "<u8",
        )
        bits = np.unpackbits(hashes.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
        ones += bits.sum(axis=0, dtype=np.int32)
    set_bits = np.packbits((2 * ones > n).astype(np.uint8), bitorder="little")
    return int(set_bits.view("<i8")[0])


def fingerprints(docs: DataFrame, width: int = 3, more: tuple[str, ...] = ()) -> DataFrame:
    """(doc_id, fingerprint) of whole texts; one row for each row of ``docs``.

    ``more`` are whole-number columns to keep beside them. ASCII letters are lower-cased; words are runs of anything but ASCII white space; fewer
    words than ``width`` make one shingle; no word, or a null text, gives fingerprint 0.
    """

    def run(batches):
        for batch in batches:
            values = [_fingerprint(t.as_py() or "", width) for t in batch.column(0)]
            yield pa.RecordBatch.from_arrays(
                [*batch.columns[1:], pa.array(values, pa.int64())],
                names=["doc_id", *more, "fingerprint"],
            )

    rows = docs.select(
        F.col("text").cast("string"), F.col("doc_id").cast("long"), *[F.col(c).cast("long") for c in more]
    )
    kind = ", ".join(f"{c} long" for c in ("doc_id", *more, "fingerprint"))
    return rows.mapInArrow(run, kind)


def _segments(bits: int) -> list[tuple[int, int]]:
    """(first bit, end) of each segment."""
    n = bits // 2 + 1
    edges = [64 * i // n for i in range(n + 1)]
    return list(zip(edges, edges[1:]))


def _signed(mask: int) -> int:
    return mask - (1 << 64) if mask >> 63 else mask


def _mask(first: int, end: int, without: tuple[int, ...] = ()) -> int:
    mask = ((1 << (end - first)) - 1) << first
    for bit in without:
        mask &= ~(1 << bit)
    return mask


def _keys(masks: list[tuple[int, int]], fp: str = "fp") -> F.Column:
    """Rows (variant, masked fingerprint) for numbered masks."""
    table = F.array(*[F.struct(F.lit(k).alias("k"), F.lit(_signed(m)).alias("m")) for k, m in masks])
    return F.inline(
        F.transform(
            table,
            lambda x: F.struct(
                x["k"].alias("variant"), F.col(fp).bitwiseAND(x["m"]).alias("masked")
            ),
        )
    )


def _crowded_links(crowded: DataFrame, segments, bits: int) -> DataFrame:
    """Links among the fingerprints of crowded variants, to the least of each full key."""
    everything, keyed = (1 << 64) - 1, None
    for number, (first, end) in enumerate(segments):
        rest = [b for b in range(64) if not first <= b < end]
        inside = crowded.filter(F.col("variant").between(first, end - 1))
        # Either the removed bit differs, and one fewer of the other bits, or none of them.
        one = inside.select(
            "fp",
            "variant",
            F.col("fp").bitwiseAND(F.expr("~shiftleft(1L, variant)")).alias("part"),
        )
        none = inside.select("fp", F.lit(64 + number).alias("variant"), F.col("fp").alias("part"))
        for rows, n in ((one, bits - 1), (none.distinct(), bits)):
            removed = [_mask(0, 64, c) & everything for c in combinations(rest, n)]
            if removed:
                more = rows.select(
                    "fp", F.col("variant").alias("of"), _keys(list(enumerate(removed)), "part")
                )
                keyed = more if keyed is None else keyed.union(more)
    root = F.min("fp").over(W.partitionBy("of", "variant", "masked"))
    return (
        keyed.withColumn("root", root)
        .filter("fp <> root")
        .select(F.col("root").alias("a"), F.col("fp").alias("b"))
    )


def links(prints: DataFrame, bits: int = 2, crowd: int = 256) -> DataFrame:
    """(a, b) links whose closure is that of all pairs of ``prints.fp`` at most ``bits`` apart.

    ``prints``: distinct fingerprints in column fp.
    """
    segments = _segments(bits)
    masks = [
        (bit, _mask(first, end, (bit,))) for first, end in segments for bit in range(first, end)
    ]
    keyed = prints.select("fp", _keys(masks))
    shared = cut(
        keyed.withColumn("n", F.count("*").over(W.partitionBy("variant", "masked"))).filter("n > 1")
    )
    few = shared.filter(F.col("n") <= crowd).select("variant", "masked", "fp")
    left, right = few.withColumnRenamed("fp", "a"), few.withColumnRenamed("fp", "b")
    pairs = (
        left.join(right, ["variant", "masked"])
        .filter((F.col("a") < F.col("b")) & (F.bit_count(F.col("a").bitwiseXOR(F.col("b"))) <= bits))
        .select("a", "b")
    )
    crowded = shared.filter(F.col("n") > crowd).select("variant", "fp")
    if crowded.isEmpty():
        return pairs
    return pairs.union(_crowded_links(cut(crowded), segments, bits))


def _rooted(prints: DataFrame, bits: int, crowd: int) -> DataFrame:
    """(fp, least, root): each fingerprint's least doc_id, and the least fingerprint it reaches."""
    least = prints.groupBy(F.col("fingerprint").alias("fp")).agg(F.min("doc_id").alias("least"))
    found = components(links(least.select("fp"), bits, crowd)).withColumnsRenamed(
        {"node": "fp", "component": "root"}
    )
    return least.join(found, "fp", "left").withColumn("root", F.coalesce("root", "fp"))


def near_duplicates(
    docs: DataFrame, width: int = 3, bits: int = 2, crowd: int = 256
) -> DataFrame:
    """(doc_id, fingerprint long, component_id) for every row of ``docs``.

    Documents whose fingerprints differ in at most ``bits`` bits are linked; component_id is
    the least doc_id reachable. Rows without words are linked like any other (fingerprint 0).
    Null doc_ids keep their row and take part, but never name a component. Repeated rows each
    give a row. Very long texts are hashed in blocks of shingles; other columns, whatever their
    names, are ignored. An empty table gives an empty result.
    """
    prints = cut(fingerprints(docs, width))
    rooted = _rooted(prints, bits, crowd)
    first = rooted.groupBy("root").agg(F.min("least").alias("component_id"))
    named = rooted.join(first, "root").select(F.col("fp").alias("fingerprint"), "component_id")
    return prints.join(named, "fingerprint").select("doc_id", "fingerprint", "component_id")


def representatives(
    docs: DataFrame, width: int = 3, bits: int = 2, crowd: int = 256
) -> DataFrame:
    """All columns of one row of ``docs`` for each group of ``near_duplicates``.

    It is the row with the least doc_id; rows with a null id come last, and equal ids are told
    apart by a hash of the whole row. So texts that share an id but belong to different groups
    each keep a row, and of equal rows one stays. Rows are known by two hashes of 64 bits over
    all columns, and equal rows become one before the shuffle.
    """
    rows, names = inner(docs, (), text=F.col("text"), doc_id=F.col("doc_id").cast("long"))
    own = list(names.values())
    rows = rows.withColumns({"one": F.xxhash64(*own), "two": F.xxhash64(F.lit(1), *reversed(own))})
    prints = cut(fingerprints(rows, width, ("one", "two")))
    roots = _rooted(prints, bits, crowd).select(F.col("fp").alias("fingerprint"), "root")
    rank = F.struct(F.col("doc_id").isNull().alias("last"), "doc_id", "one", "two")
    chosen = prints.join(roots, "fingerprint").groupBy("root").agg(F.min(rank).alias("row"))
    kept = rows.drop("text", "doc_id").dropDuplicates(["one", "two"])
    return kept.join(chosen.select("row.one", "row.two"), ["one", "two"], "left_semi").select(
        *[F.col(n).alias(c) for c, n in names.items()]
    )
