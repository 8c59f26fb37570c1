"""Best-fit packing of tokenised documents into sequences of a fixed length.

Bulk-synchronous best-fit. Pieces of one length are interchangeable, so documents and gaps
are range-sorted by counting: Spark counts the pieces of each length, and what the supersteps
move are ranges of ranks ("pieces 0..k of length 700 go to bins b..b+k"), never rows. There
are at most ``capacity`` lengths and gaps, however many documents there are. Each superstep
sorts both sides, finds for every gap the largest piece that fits it in one sweep, settles
conflicts by rank, updates the gaps and repeats; new sequences are opened only when nothing
fits, and no more of them than the remaining tokens need. The pieces then learn their places
from their ranks, which Spark numbers in salted buckets of each length.
"""

from __future__ import annotations

import json
import re
import zlib

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .shared import cut, worker_state

PIECES = (
    "doc_id long, piece int, start long, length long, ids_crc32 long"
)
_BUCKETS, _BUCKET_ROWS = 64, 20_000
_KNOWN = 300_000
_CHARS = 1 << 20


# How vocabularies that drop white space normalise and split a text.
_NORMAL = [("NFC", None), ("Replace", r"\s+"), ("Lowercase", None)]
_PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+"
# The same for lower-cased ASCII and Latin-1 letters, where it needs no Unicode tables.
_SPLIT = re.compile(r"'s|'t|'re|'ve|'m|'ll|'d|[a-zß-öø-ÿ]+|[0-9]|[^ \t-\ra-zß-öø-ÿ0-9]+")
_SIMPLE = re.compile(r"[\x00-\x7fÀ-ÖØ-öø-ÿ]*\Z")


class _Encoder:
    """Token ids of texts as little-endian 32-bit numbers.

    Where the vocabulary splits texts as above, a simple text is split here, and the ids of its
    parts (words, digits, runs of other signs) come from a bounded cache; unknown parts of many
    texts are encoded together. Other texts and vocabularies go to the tokenizer whole. The
    cache has two halves: parts in the older one move to the newer when they are used, and the
    older is given up when the newer is full, so that common parts stay.
    """

    def __init__(self, path: str) -> None:
        import os

        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer, pre_tokenizers

        self.whole = Tokenizer.from_file(path)
        self.parts = None
        self.known: list[dict[str, bytes | None]] = [{}, {}]
        with open(path, encoding="utf-8") as file:
            told = json.load(file)
        rules = [
            (n["type"], n.get("pattern", {}).get("Regex"))
            for n in (told.get("normalizer") or {}).get("normalizers", [])
        ]
        splits = (told.get("pre_tokenizer") or {}).get("pretokenizers", [])
        patterns = [p["pattern"].get("Regex") for p in splits if p["type"] == "Split"]
        suffix = told["model"].get("end_of_word_suffix")
        if rules == _NORMAL and patterns == [_PATTERN] and len(splits) == 2 and suffix:
            self.parts = Tokenizer(self.whole.model)
            self.parts.pre_tokenizer = pre_tokenizers.Sequence(
                [pre_tokenizers.WhitespaceSplit(), pre_tokenizers.ByteLevel(False, use_regex=False)]
            )
            self.last = np.zeros(self.whole.get_vocab_size() + 1, dtype=bool)
            self.last[[i for t, i in self.whole.get_vocab().items() if t.endswith(suffix)]] = True
            # Special tokens in a text are the tokenizer's business.
            self.special = [t["content"] for t in told.get("added_tokens", [])]

    def _simple(self, text: str) -> bool:
        return (
            self.parts is not None
            and (text.isascii() or _SIMPLE.match(text) is not None)
            and not any(t in text for t in self.special)
        )

    def _learn(self, unknown: list[str]) -> None:
        for at in range(0, len(unknown), 2_000):
            some = unknown[at : at + 2_000]
            ids = np.array(self.parts.encode(" ".join(some), add_special_tokens=False).ids, "<u4")
            # A part's last token is one that ends a word.
            ends = (np.flatnonzero(self.last[ids]) + 1) * 4
            if len(ends) != len(some):
                for part in some:
                    one = self.whole.encode(part, add_special_tokens=False).ids
                    self.known[0][part] = np.array(one, "<u4").tobytes()
                continue
            raw, first = ids.tobytes(), 0
            for part, end in zip(some, ends.tolist()):
                self.known[0][part] = raw[first:end]
                first = end

    def encode(self, texts: list[str]) -> list[bytes]:
        if len(self.known[0]) > _KNOWN:
            self.known = [{}, self.known[0]]
        new, old = self.known
        split = [_SPLIT.findall(t.lower()) if self._simple(t) else None for t in texts]
        found = [None if parts is None else list(map(new.get, parts)) for parts in split]
        unknown = []
        for parts, ids in zip(split, found):
            if ids is None or None not in ids:
                continue
            for part in [p for p, i in zip(parts, ids) if i is None]:
                if part not in new:
                    new[part] = old.get(part)
                    if new[part] is None:
                        unknown.append(part)
        self._learn(unknown)
        out = []
        for text, parts, ids in zip(texts, split, found):
            if parts is None:
                whole = self.whole.encode(text, add_special_tokens=False).ids
                out.append(np.array(whole, "<u4").tobytes())
            else:
                out.append(b"".join(map(new.__getitem__, parts) if None in ids else ids))
        return out


def _some(batch: pa.RecordBatch):
    """The ids and texts of a batch, about _CHARS characters at a time."""
    ids, texts, size = [], [], 0
    for doc_id, text in zip(batch.column(0).to_pylist(), batch.column(1)):
        ids.append(doc_id)
        texts.append(text.as_py() or "")
        size += len(texts[-1])
        if size > _CHARS:
            yield ids, texts
            ids, texts, size = [], [], 0
    if ids:
        yield ids, texts


def pieces(
    docs: DataFrame, vocabulary: str, capacity: int = 4096, end_id: int = 1
) -> DataFrame:
    """Cut every document's ids (its text's, then ``end_id``) into pieces of ``capacity``.

    Null text counts as empty: one piece with the end id alone. Rows with equal or null
    doc_id are separate documents. Other columns, whatever their names, are ignored. A text of
    any length is encoded whole, in the memory of one task.
    """
    ending = np.array([end_id], "<u4").tobytes()

    def run(batches):
        encoder = worker_state(f"words {vocabulary}", lambda: _Encoder(vocabulary))
        for batch in batches:
            out: list[tuple] = []
            for doc_ids, texts in _some(batch):
                for doc_id, ids in zip(doc_ids, encoder.encode(texts)):
                    ids += ending
                    for n, at in enumerate(range(0, len(ids), capacity * 4)):
                        part = ids[at : at + capacity * 4]
                        out.append((doc_id, n, at // 4, len(part) // 4, zlib.crc32(part)))
            columns = list(zip(*out)) if out else [[]] * 5
            kinds = (pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int64())
            yield pa.RecordBatch.from_arrays(
                [pa.array(c, k) for c, k in zip(columns, kinds)],
                names=["doc_id", "piece", "start", "length", "ids_crc32"],
            )

    rows = docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string"))
    return rows.mapInArrow(run, PIECES)


class _Gaps:
    """Open sequences by gap; each entry is a range (first bin, how many)."""

    def __init__(self) -> None:
        self.ranges: dict[int, list[tuple[int, int]]] = {}

    def add(self, gap: int, first: int, n: int) -> None:
        if gap > 0:
            self.ranges.setdefault(gap, []).append((first, n))

    def take(self, gap: int, n: int) -> tuple[int, int]:
        """Up to ``n`` bins of this gap, from one range."""
        first, have = self.ranges[gap].pop()
        if have > n:
            self.ranges[gap].append((first + n, have - n))
            have = n
        if not self.ranges[gap]:
            del self.ranges[gap]
        return first, have

    def count(self, gap: int) -> int:
        return sum(n for _, n in self.ranges[gap])


def _sweep(left: dict[int, int], gaps: _Gaps) -> list[tuple[int, int, int]]:
    """(gap, length, how many): every gap gets the largest free piece that fits it.

    One pass over lengths and gaps in rising order with a stack of the lengths seen; of the
    pieces and bins that compete, the first by rank are matched.
    """
    lengths, stack, out = sorted(left), [], []
    at = 0
    for gap in sorted(gaps.ranges):
        while at < len(lengths) and lengths[at] <= gap:
            stack.append([lengths[at], left[lengths[at]]])
            at += 1
        want = gaps.count(gap)
        while want and stack:
            n = min(want, stack[-1][1])
            out.append((gap, stack[-1][0], n))
            want -= n
            stack[-1][1] -= n
            if not stack[-1][1]:
                stack.pop()
    return out


def plan(counts: dict[int, int], capacity: int) -> list[tuple[int, int, int, int, int]]:
    """Places for pieces of given counts by length: (length, first rank, n, first bin, offset).

    Pieces of a length with ranks first..first+n-1 go to bins first bin.. in turn, each at
    ``offset`` tokens from the bin's start.
    """
    left = {k: int(n) for k, n in counts.items() if n}
    rank = dict.fromkeys(left, 0)
    gaps, bins, out = _Gaps(), 0, []

    def place(length: int, n: int, first: int, offset: int) -> None:
        out.append((length, rank[length], n, first, offset))
        rank[length] += n
        left[length] -= n
        if not left[length]:
            del left[length]

    while left:
        found = _sweep(left, gaps)
        if found:
            moved = []
            for gap, length, n in found:
                while n:
                    first, got = gaps.take(gap, n)
                    place(length, got, first, capacity - gap)
                    moved.append((gap - length, first, got))
                    n -= got
            for entry in moved:
                gaps.add(*entry)
            continue
        need = -(-sum(k * n for k, n in left.items()) // capacity)
        for length in sorted(left, reverse=True):
            n = min(need, left[length])
            place(length, n, bins, 0)
            gaps.add(capacity - length, bins, n)
            bins, need = bins + n, need - n
            if not need:
                break
    return out


def pack(cut_pieces: DataFrame, capacity: int = 4096) -> DataFrame:
    """Add ``sequence_id`` and ``offset`` to pieces; few sequences, offsets without holes.

    ``cut_pieces`` must give the same rows each time it is read (a table or checkpoint).
    Pieces longer than ``capacity`` or without tokens are an error of the caller. Pieces that
    fill a sequence need no place among others: they get numbers below zero. Buckets of a length
    grow in number with the pieces, so that none holds more than a task can sort.
    """
    full = cut_pieces.filter(F.col("length") == capacity).select(
        "*",
        (F.lit(-1) - F.monotonically_increasing_id()).alias("sequence_id"),
        F.lit(0).cast("long").alias("offset"),
    )
    others = cut_pieces.filter(F.col("length") < capacity)
    buckets = max(_BUCKETS, others.count() // _BUCKET_ROWS)
    rows = others.withColumn(
        "bucket_", F.pmod(F.xxhash64("doc_id", "piece", "ids_crc32"), F.lit(buckets))
    )
    by_bucket = rows.groupBy("length", "bucket_").agg(F.count("*").alias("n_"))
    counts = {r[0]: r[1] for r in by_bucket.groupBy("length").agg(F.sum("n_")).collect()}
    places = sorted(plan(counts, capacity))
    before = by_bucket.select(
        "length",
        "bucket_",
        F.coalesce(
            F.sum("n_").over(
                W.partitionBy("length").orderBy("bucket_").rowsBetween(W.unboundedPreceding, -1)
            ),
            F.lit(0),
        ).alias("before_"),
    )
    within = F.row_number().over(
        W.partitionBy("length", "bucket_").orderBy("doc_id", "piece", "ids_crc32")
    )
    ranked = (
        rows.withColumn("row_", within)
        .join(before, ["length", "bucket_"])
        .withColumn("rank_", F.col("before_") + F.col("row_") - 1)
        .drop("bucket_", "row_", "before_")
    )
    table = np.array(places or np.zeros((0, 5)), dtype=np.int64).reshape(-1, 5)
    keys = (table[:, 0] << 44) + table[:, 1]

    def locate(length: pd.Series, rank: pd.Series) -> pd.DataFrame:
        at = np.searchsorted(keys, (length.to_numpy() << 44) + rank.to_numpy(), "right") - 1
        chosen = table[at]
        return pd.DataFrame(
            {
                "sequence_id": chosen[:, 3] + rank.to_numpy() - chosen[:, 1],
                "offset": chosen[:, 4],
            }
        )

    where = F.pandas_udf(locate, "sequence_id long, offset long")
    return (
        ranked.withColumn("place_", where("length", "rank_"))
        .withColumn("sequence_id", F.col("place_.sequence_id"))
        .withColumn("offset", F.col("place_.offset"))
        .drop("rank_", "place_")
        .unionByName(full)
    )


def pack_documents(
    docs: DataFrame, vocabulary: str, capacity: int = 4096, end_id: int = 1
) -> DataFrame:
    """Tokenise, cut and pack documents: doc_id, piece, start, length, ids_crc32,
    sequence_id, offset, one row per piece. An empty table gives an empty result."""
    return pack(cut(pieces(docs, vocabulary, capacity, end_id)), capacity).select(
        "doc_id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset"
    )
