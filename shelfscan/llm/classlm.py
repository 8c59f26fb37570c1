"""Language-model scores from a class-based bigram model (Brown et al.).

A word's probability is that of its class after the last word's class, times that of the word
in its class. Exchange clustering assigns classes: each sweep counts, over the whole training
corpus, which classes stand before and after every unit, and moves half of the units to the
classes that raise the mutual information of neighbouring classes most.

The most frequent words are units of their own; all others share the unit of their ending, and
within it have their own smoothed frequency. So the class model has a fixed size, while the
word counts grow with the corpus: the counts of common words (a bounded number) travel with
the tasks, and the rest are joined by word, where no word is frequent any more.
"""

from __future__ import annotations

import zlib
from collections import Counter
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .shared import cut

END = ""  # stands for the end of a text; no word is empty
_ENDINGS = 1024
_FLUSH = 300_000
_BLOCKS = 16


class _Endings(dict):
    """Unit of a word's last three bytes."""

    def __init__(self, first: int) -> None:
        self.first = first

    def __missing__(self, ending: bytes) -> int:
        self[ending] = unit = self.first + zlib.crc32(ending) % _ENDINGS
        return unit


def words_of(text: str | None) -> list[bytes]:
    """Words of a text, ASCII letters lower-cased; white space is ASCII too."""
    return (text or "").encode("utf-8", "replace").lower().split()


def token_counts(docs: DataFrame) -> DataFrame:
    """(token, c) of all texts; every text has one END."""

    def run(batches):
        counts: Counter = Counter()

        def out():
            batch = pa.RecordBatch.from_arrays(
                [pa.array(list(counts), pa.string()), pa.array(list(counts.values()), pa.int64())],
                names=["token", "n"],
            )
            counts.clear()
            return batch

        for batch in batches:
            for text in batch.column(0):
                counts.update(words_of(text.as_py()))
                counts[b""] += 1
                if len(counts) > _FLUSH:
                    yield out()
        if counts:
            yield out()

    rows = docs.select(F.col("text").cast("string")).mapInArrow(run, "token string, n long")
    return rows.groupBy("token").agg(F.sum("n").alias("c"))


@dataclass
class ClassModel:
    """A trained model; all parts but ``counts`` are of bounded size."""

    counts: DataFrame  # token, c
    total: int  # tokens
    distinct: int
    common: dict[bytes, int]  # word -> count of the commonest words
    units: dict[bytes, int]  # word -> own unit
    classes: np.ndarray  # of units
    transition: np.ndarray  # log10 P(class | class before)
    emission: np.ndarray  # log10 P(unit | class), less the endings' denominators
    own: np.ndarray  # log10(c + 0.5) of own units, which their words don't pay


def _common(counts: DataFrame, most: int) -> dict[bytes, int]:
    """Counts of the commonest words: at most ``most``, all words of a count or none."""
    sizes = counts.groupBy("c").agg(F.count("*").alias("n")).orderBy(F.desc("c")).limit(most)
    room, least = most, None
    for c, n in sizes.collect():
        room -= n
        if room < 0:
            break
        least = c
    if least is None:
        return {}
    return {t.encode(): c for t, c in counts.filter(F.col("c") >= least).collect()}


def _unit_sequences(docs: DataFrame, units: dict[bytes, int]) -> DataFrame:
    """(units): each text's units as 16-bit numbers, between two ENDs."""
    end = units[b""]

    def run(batches):
        endings, get = _Endings(len(units)), units.get
        for batch in batches:
            out = []
            for text in batch.column(0):
                words = words_of(text.as_py())
                found = [endings[w[-3:]] if u is None else u for w, u in zip(words, map(get, words))]
                out.append(np.array([end, *found, end], "<u2").tobytes())
            yield pa.RecordBatch.from_arrays([pa.array(out, pa.binary())], names=["units"])

    return docs.select(F.col("text").cast("string")).mapInArrow(run, "units binary")


def _neighbours(sequences: DataFrame, classes: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
    """Counts (unit, class before) and (unit, class after) over all sequences."""
    size = len(classes)
    rows_each = -(-size // _BLOCKS)

    def run(batches):
        before, after = np.zeros(size * n, np.int64), np.zeros(size * n, np.int64)
        for batch in batches:
            for at in range(0, batch.num_rows, 512):
                part = batch.column(0).slice(at, 512).to_pylist()
                codes = np.frombuffer(b"".join(part), "<u2").astype(np.int64)
                ends = np.cumsum([len(x) // 2 for x in part])
                keep = np.ones(len(codes) - 1, bool)
                keep[ends[:-1] - 1] = False  # the pair between two texts
                first, second = codes[:-1][keep], codes[1:][keep]
                before += np.bincount(second * n + classes[first], minlength=size * n)
                after += np.bincount(first * n + classes[second], minlength=size * n)
        both = np.stack([before, after]).reshape(2, size, n)
        for block in range(_BLOCKS):
            part = both[:, block * rows_each : (block + 1) * rows_each]
            if part.any():
                yield pa.RecordBatch.from_arrays(
                    [pa.array([block], pa.int32()), pa.array([part.tobytes()], pa.binary())],
                    names=["block", "counts"],
                )

    def add(batches):
        block, total = None, None
        for batch in batches:
            for b, raw in zip(batch.column(0).to_pylist(), batch.column(1)):
                block, more = b, np.frombuffer(raw.as_py(), np.int64)
                total = more.copy() if total is None else total + more
        yield pa.RecordBatch.from_arrays(
            [pa.array([block], pa.int32()), pa.array([total.tobytes()], pa.binary())],
            names=["block", "counts"],
        )

    def add_table(table: pa.Table) -> pa.Table:
        return pa.Table.from_batches(list(add(table.to_batches())))

    kind = "block int, counts binary"
    # First within slices of the tasks, then all: no group holds the arrays of every task.
    parts = sequences.mapInArrow(run, kind).withColumn("slice", F.spark_partition_id() % 64)
    summed = parts.groupBy("slice", "block").applyInArrow(
        lambda t: add_table(t.select(["block", "counts"])), kind
    )
    rows = summed.groupBy("block").applyInArrow(add_table, kind).collect()
    out = np.zeros((2, size, n), np.int64)
    for block, raw in rows:
        part = np.frombuffer(raw, np.int64).reshape(2, -1, n)
        out[:, block * rows_each : block * rows_each + part.shape[1]] = part
    return out[0], out[1]


def _class_pairs(after: np.ndarray, classes: np.ndarray, n: int) -> np.ndarray:
    pairs = np.zeros((n, n))
    np.add.at(pairs, classes, after)
    return pairs


def exchange(
    sequences: DataFrame, size: int, n: int, sweeps: int
) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(classes, class pair counts, unit counts) after ``sweeps`` of exchange clustering.

    A sweep scores every unit in every class by the pointwise mutual information that its
    neighbours' classes give and moves one half of the units, in turns, to their best class.
    """
    classes = np.arange(size) % n
    best = None
    for sweep in range(sweeps + 1):
        before, after = _neighbours(sequences, classes, n)
        pairs = _class_pairs(after, classes, n)
        total = max(pairs.sum(), 1.0)
        rows, columns = pairs.sum(axis=1) + 0.5, pairs.sum(axis=0) + 0.5
        pmi = np.log((pairs + 0.01) * total / np.outer(rows, columns))
        value = float((pairs * pmi).sum())
        if best is None or value > best[0]:
            best = (value, classes, pairs, before.sum(axis=1))
        if sweep == sweeps:
            break
        gain = before @ pmi + after @ pmi.T
        wanted = np.where(gain.max(axis=1) > gain[np.arange(size), classes], gain.argmax(axis=1), classes)
        turn = (np.arange(size) + sweep) % 2 == 0
        classes = np.where(turn, wanted, classes)
    return best[1], best[2], best[3]


def train(
    docs: DataFrame, classes: int = 64, own_units: int = 4096, common: int = 200_000, sweeps: int = 8
) -> ClassModel:
    """Learn a model from all texts of ``docs`` (null text: empty).

    ``own_units`` words have units of their own; ``common`` bounds the counts that travel with
    tasks. An empty table gives a model that knows no word.
    """
    counts = cut(token_counts(docs))
    total, distinct = counts.agg(F.coalesce(F.sum("c"), F.lit(0)), F.count("*")).first()
    frequent = _common(counts, common)
    ranked = sorted(frequent, key=lambda w: (-frequent[w], w))[:own_units]
    units = {b"": 0}
    for word in ranked:
        units.setdefault(word, len(units))
    size = len(units) + _ENDINGS
    assigned, pairs, seen = exchange(cut(_unit_sequences(docs, units)), size, classes, sweeps)

    # Tokens and distinct words that share an ending's unit, at most _ENDINGS rows.
    session = docs.sparkSession
    own = session.createDataFrame([(w.decode(),) for w in units], "token string")
    # A text's last bytes: a code point may be cut, as in the tasks.
    ending = F.substring(F.encode("token", "UTF-8"), -3, 3)
    shared = (
        counts.join(F.broadcast(own), "token", "left_anti")
        .groupBy((F.crc32(ending) % _ENDINGS).alias("ending"))
        .agg(F.sum("c"), F.count("*"))
        .collect()
    )
    denominator = np.zeros(size)
    denominator[len(units) :] = np.log10(0.5)
    for bucket, c, v in shared:
        denominator[len(units) + bucket] = np.log10(c + 0.5 * (v + 1))

    members = np.zeros(classes)
    np.add.at(members, assigned, 1)
    mass = np.zeros(classes)
    np.add.at(mass, assigned, seen)
    emission = np.log10((seen + 0.5) / (mass + 0.5 * members)[assigned]) - denominator
    marginal = (pairs.sum(axis=0) + 0.5) / (pairs.sum() + 0.5 * classes)
    kinds = (pairs > 0).sum(axis=1, keepdims=True)
    row = pairs.sum(axis=1, keepdims=True)
    transition = np.log10((pairs + (kinds + 1) * marginal) / (row + kinds + 1))
    logs = np.zeros(size)
    for word, unit in units.items():
        logs[unit] = np.log10(frequent.get(word, 0) + 0.5)
    return ClassModel(
        counts, int(total), int(distinct), frequent, units, assigned, transition, emission, logs
    )


_PART = (
    "row long, doc_id long, n_tokens long, known long, logs double, score double, "
    "token string, times long"
)


def score(docs: DataFrame, model: ClassModel) -> DataFrame:
    """(doc_id, n_tokens, n_known, base_score, score), one row for each row of ``docs``.

    ``base_score`` is the smoothed unigram log10 probability, ``score`` the class model's.
    Null text is empty (one token, the end); null and repeated doc_ids keep their rows. Texts of
    any length are scored whole, in the memory of one task; other columns, whatever their names,
    are ignored. Without training tokens every known count is 0.
    """
    common = {w: float(np.log10(c + 0.5)) for w, c in model.common.items()}
    units, classes = model.units, model.classes
    transition, emission, own = model.transition, model.emission, model.own
    end_known = int(model.total > 0)

    def run(batches):
        from pyspark import TaskContext

        row = TaskContext.get().partitionId() << 40
        endings, unit_of, log_of = _Endings(len(units)), units.get, common.get
        names = [part.split()[0] for part in _PART.split(", ")]
        for batch in batches:
            out: list[list] = [[] for _ in names]
            for doc_id, text in zip(batch.column(0).to_pylist(), batch.column(1)):
                row += 1
                words = [*words_of(text.as_py()), b""]
                logs = list(map(log_of, words))
                found = np.array(
                    [endings[w[-3:]] if u is None else u for w, u in zip(words, map(unit_of, words))]
                )
                kind = classes[found]
                steps = transition[np.concatenate(([classes[0]], kind[:-1])), kind].sum()
                rare = Counter(w for w, x in zip(words, logs) if x is None and w)
                known = [x for x in logs if x is not None]
                paid = float(np.sum(known))
                if not end_known:
                    paid += float(np.log10(0.5))
                value = float(steps + emission[found].sum() + paid - own[found].sum())
                # The text's own row has a key that no word has.
                n = 1 + len(rare)
                more = (
                    [row] * n,
                    [doc_id] + [None] * (n - 1),
                    [len(words)] + [None] * (n - 1),
                    [len(known)] + [None] * (n - 1),
                    [paid] + [None] * (n - 1),
                    [value] + [None] * (n - 1),
                    [b" %d" % row, *rare],
                    [0, *rare.values()],
                )
                for column, values in zip(out, more):
                    column.extend(values)
            kinds = [pa.int64()] * 4 + [pa.float64()] * 2 + [pa.string(), pa.int64()]
            yield pa.RecordBatch.from_arrays(
                [pa.array(c, k) for c, k in zip(out, kinds)], names=names
            )

    rows = docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string"))
    parts = rows.mapInArrow(run, _PART).join(model.counts, "token", "left")
    c = F.coalesce("c", F.lit(0))
    paid = F.col("times") * F.log10(c + 0.5)
    base_each = float(np.log10(model.total + 0.5 * (model.distinct + 1)))
    summed = parts.groupBy("row").agg(
        F.max("doc_id").alias("doc_id"),
        F.max("n_tokens").alias("n_tokens"),
        (F.max("known") + F.sum(F.when(c > 0, F.col("times")).otherwise(0))).alias("n_known"),
        (F.max("logs") + F.sum(paid)).alias("logs"),
        (F.max("score") + F.sum(paid)).alias("score"),
    )
    return summed.select(
        "doc_id",
        "n_tokens",
        "n_known",
        (F.col("logs") - F.col("n_tokens") * base_each).alias("base_score"),
        "score",
    )
