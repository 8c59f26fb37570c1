"""Spelling variants by permuterm rotations.

A word gets an end mark and is rotated: the rotation that ends with the character at position i
is ``word[i+1:] + mark + word[:i] + word[i]``. All but its last character, the prefix of one
shorter, skips the edited character: words of one length that differ there only have the same
prefix, and the word that lacks the character is that prefix itself, one of its own rotations.
So the rotations are sorted by prefix, and one scan of a prefix's rows finds all neighbours by
replacement, insertion and deletion, without comparing any two words. A prefix has at most one
row for each letter that may be skipped and one for the shorter word, so no group is large,
however common a word is; occurrences are counted in the tasks before any shuffle.
"""

from __future__ import annotations

import re
import zlib
from collections import Counter

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .sharding import numbered
from .shared import cut

# Letters: A-Z, a-z and U+00C0..U+00FF, as UTF-8 bytes; only A-Z have been lower-cased.
_RUN = re.compile(rb"(?:[a-z]|\xc3[\x80-\xbf])+")
_BREAK = re.compile(rb"[^A-Za-z\x80-\xff]")
_MARK = "$"
_PART = 1 << 20
_HELD = 200_000
_ROWS = 50_000
# Prefixes up to so many characters are kept as text, longer ones as two 61-bit numbers.
_AS_TEXT = 64
_MODULUS = (1 << 61) - 1
_BASES = (1_000_003, 998_244_353)


def _parts(text: bytes):
    """The text in parts of about _PART bytes, cut where no run can go on."""
    at = 0
    while at < len(text):
        end = at + _PART
        if end < len(text):
            found = _BREAK.search(text, end)
            end = found.start() if found else len(text)
        yield text[at:end]
        at = end


def _occurrences(doc_id: bytes, text: bytes, every: int | None):
    """(word, occurrences) of a text: lower-cased runs, some without one character.

    A run loses the character at its hash modulo its length where ``every`` divides the hash,
    the crc32 of doc_id, a colon and the run.
    """
    start = zlib.crc32(doc_id + b":")
    for part in _parts(text):
        for run, times in Counter(_RUN.findall(part.lower())).items():
            if every:
                value = zlib.crc32(run, start)
                if not value % every:
                    letters = run.decode()
                    at = value % len(letters)
                    run = (letters[:at] + letters[at + 1 :]).encode()
            yield run, times


def count_words(
    docs: DataFrame, drop_every: int | None = None, min_length: int = 6, min_count: int = 5
) -> DataFrame:
    """(word, n): words of at least ``min_length`` characters and ``min_count`` occurrences.

    Null texts hold no word; a null doc_id is an empty text in the hash of ``drop_every``.
    Repeated rows count each time; texts of any length are read in parts, other columns not.
    """

    def run(batches):
        held: Counter = Counter()

        def flushed():
            found = [(w, n) for w, n in held.items() if len(w) >= min_length]
            words = pa.array([w for w, _ in found], pa.binary()).cast(pa.string())
            batch = pa.RecordBatch.from_arrays(
                [words, pa.array([n for _, n in found], pa.int64())], names=["word", "n"]
            )
            held.clear()
            return batch

        for batch in batches:
            texts = batch.column(1).cast(pa.large_binary())
            for doc_id, text in zip(batch.column(0).to_pylist(), texts):
                if not text.is_valid:
                    continue
                for word, times in _occurrences((doc_id or "").encode(), text.as_py(), drop_every):
                    held[word] += times
                if len(held) > _HELD:
                    yield flushed()
        yield flushed()

    rows = docs.select(F.col("doc_id").cast("string"), F.col("text").cast("string"))
    words = rows.mapInArrow(run, "word string, n long")
    return (
        words.groupBy("word")
        .agg(F.sum("n").alias("n"))
        .filter((F.char_length("word") >= min_length) & (F.col("n") >= min_count))
    )


def _numbers(word: str):
    """For i in 0..len(word): numbers in place of the texts ``word[i+1:] + mark + word[:i]``
    (None for the last i) and ``word[i:] + mark + word[:i]``, in one pass over the word."""
    length = len(word)
    sums, powers = [], []
    for base in _BASES:
        s, p = [0], [1]
        for letter in word:
            s.append((s[-1] * base + ord(letter)) % _MODULUS)
            p.append(p[-1] * base % _MODULUS)
        sums.append(s)
        powers.append(p)

    def number(i: int, skip: int) -> str:
        found = []
        for base, s, p in zip(_BASES, sums, powers):
            tail = (s[length] - s[i + skip] * p[length - i - skip]) % _MODULUS
            found.append(((tail * base + ord(_MARK)) * p[i] + s[i]) % _MODULUS)
        return "#%x-%x-%x" % (length + 1 - skip, *found)

    for i in range(length + 1):
        yield number(i, 1) if i < length else None, number(i, 0)


def _rotations(word: str):
    """(prefix, skipped): the word's rotations less a character, and its whole rotations.

    ``skipped``: 2 where a character is left out, 1 where the same character stands before it
    (leaving either out gives the same word), 0 for the whole rotation.
    """
    length = len(word)
    numbers = _numbers(word) if length + 1 > _AS_TEXT else None
    for i in range(length + 1):
        short, whole = next(numbers) if numbers else (None, None)
        if i < length:
            prefix = short if length > _AS_TEXT else word[i + 1 :] + _MARK + word[:i]
            yield prefix, 2 if i == 0 or word[i - 1] != word[i] else 1
        yield whole or word[i:] + _MARK + word[:i], 0


def rotations(words: DataFrame) -> DataFrame:
    """(prefix, skipped, id, n) of all rotations of ``words`` (id, word, n), as in ``_rotations``.

    A word of L characters has 2 L + 1 rows of about L bytes; above 64 characters a prefix is
    kept as its length and two numbers modulo 2^61 - 1, so that the cost stays linear.
    """

    def run(batches):
        out: list[tuple] = []

        def made():
            columns = list(zip(*out)) if out else [[]] * 4
            types = (pa.string(), pa.int32(), pa.int64(), pa.int64())
            out.clear()
            return pa.RecordBatch.from_arrays(
                [pa.array(c, t) for c, t in zip(columns, types)],
                names=["prefix", "skipped", "id", "n"],
            )

        for batch in batches:
            for key, word, n in zip(*(c.to_pylist() for c in batch.columns)):
                for prefix, skipped in _rotations(word):
                    out.append((prefix, skipped, key, n))
                    if len(out) >= _ROWS:
                        yield made()
        yield made()

    rows = words.select("id", "word", "n")
    return rows.mapInArrow(run, "prefix string, skipped int, id long, n long")


def neighbours(words: DataFrame) -> DataFrame:
    """(id, n_near, near, near_n): how many near words each has, and the most frequent one.

    ``words``: id (long, in code-point order of the words), word (distinct, not null), n. Ties
    go to the smaller id; words without neighbours have no row. Each prefix is scanned once: a
    word's neighbours are the rows other than its own, and the best is the first or the second.
    """
    group = W.partitionBy("prefix").orderBy(F.col("n").desc(), F.col("id"))
    whole = group.rowsBetween(W.unboundedPreceding, W.unboundedFollowing)
    member = F.struct("n", "id")
    skipped = F.col("skipped")
    scanned = rotations(words).select(
        "*",
        F.first(member).over(whole).alias("best"),
        F.nth_value(member, 2).over(whole).alias("second"),
        F.sum((skipped > 0).cast("long")).over(whole).alias("replaced"),
        # The word without a character counts once, however many equal ones may be left out.
        F.sum((skipped == 2).cast("long")).over(whole).alias("longer"),
        F.max((skipped == 0).cast("long")).over(whole).alias("shorter"),
    )
    others = F.when(skipped == 0, F.col("longer")).otherwise(
        F.col("replaced") - 1 + F.when(skipped == 2, F.col("shorter")).otherwise(0)
    )
    best = F.when(F.col("best.id") == F.col("id"), F.col("second")).otherwise(F.col("best"))
    rank = F.struct((-best["n"]).alias("less"), best["id"].alias("id"))
    return (
        scanned.filter("second IS NOT NULL")
        .groupBy("id")
        .agg(F.sum(others).alias("n_near"), F.min(rank).alias("top"))
        .select("id", "n_near", F.col("top.id").alias("near"), (-F.col("top.less")).alias("near_n"))
    )


def variants(words: DataFrame, times: int = 5) -> DataFrame:
    """(word, n, n_near, form, form_n, root) for all ``words`` (word, n).

    ``form`` is the most frequent near word where it is at least ``times`` as frequent, else
    null; ``root`` is where following forms ends, found by doubling the steps, the word itself
    if it has none. Each form is more frequent than its word, so there are no circles and the
    rounds grow with the logarithm of the logarithm of the largest n. Words are numbered in
    code-point order first, so that rotations carry numbers. Empty tables give an empty result.
    """
    if times < 2:
        raise ValueError("a form must be more frequent than its word")
    words = numbered(words.select("word", "n"), [F.col("word")], "id")[0]
    given = F.col("near_n") >= F.col("n") * times
    known = cut(
        words.join(neighbours(words), "id", "left").select(
            "id",
            "word",
            "n",
            F.coalesce("n_near", F.lit(0)).cast("long").alias("n_near"),
            F.when(given, F.col("near")).alias("form_id"),
            F.when(given, F.col("near_n")).alias("form_n"),
        )
    )
    # Only words with a form move; the others are roots.
    steps = known.filter("form_id IS NOT NULL").select("id", "form_id", F.col("form_id").alias("to"))
    while True:
        ahead = steps.select(F.col("id").alias("to"), F.col("to").alias("further"))
        joined = cut(steps.join(ahead, "to", "left"))
        steps = joined.select("id", "form_id", F.coalesce("further", "to").alias("to"))
        if joined.filter("further IS NOT NULL").isEmpty():
            break
    names = words.select("id", "word")
    form = names.select(F.col("id").alias("form_id"), F.col("word").alias("form"))
    root = names.select(F.col("id").alias("to"), F.col("word").alias("root"))
    moved = steps.join(form, "form_id").join(root, "to").select("id", "form", "root")
    return known.join(moved, "id", "left").select(
        "word", "n", "n_near", "form", "form_n", F.coalesce("root", "word").alias("root")
    )
