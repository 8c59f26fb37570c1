"""Toxicity of texts after noisy-channel deobfuscation.

A character language model (trigram counts over all texts) scores the readings of a distorted
token. The token's lattice offers for every symbol the letters it may stand for, for a run of
one letter one or two copies, and for a separator nothing; a Viterbi search with states of two
letters finds the likeliest readings, and a word the classifier knows is preferred among them.
Tokens with one reading, which nearly all are, are left as they stand. Restored texts are then
scored: words and word beginnings carry the log-odds that labelled rows give them, and a
logistic curve, fitted on other labelled rows, turns the strongest of a text into a score.
"""

from __future__ import annotations

import re

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .shared import cut, inner

# Letters that a symbol may stand for.
LEET = {
    "0": "o", "1": "il", "2": "z", "3": "e", "4": "a", "5": "s", "6": "g", "7": "t", "8": "b",
    "9": "g", "@": "a", "$": "s", "!": "i", "|": "il", "+": "t", "(": "c", "€": "e", "£": "l",
    "*": "aeiou", "#": "aeiou",
}
_MARKS = "".join(LEET)
_SEPARATORS = " ._-*~/|,"
_WORD = re.compile(r"[^\W\d_]+")
# A letter next to a symbol that may stand for one, or a run of three.
_ODD = re.compile(
    rf"[^\W\d_][{re.escape(_MARKS)}]|[{re.escape(_MARKS)}][^\W\d_]|([^\W\d_])\1\1"
)
_RUN = re.compile(r"(.)\1\1")
_LONG_RUN = re.compile(r"(.)\1{3,}")
# Repeated symbols around a token are decoration.
_DECORATION = re.compile(r"^(?:([^\w\s])\1+|[*#!+|(])+|(?:([^\w\s])\2+|[*#!+|(])+$")
_SEPARATED = re.compile(
    rf"(?<!\w)(?:[^\W_]|[@$!])(?:[{re.escape(_SEPARATORS)}]{{1,2}}(?:[^\W_]|[@$!])){{3,}}(?!\w)"
)
_SPACED = re.compile(r"(?<!\S)(?:\S\s{1,2}){3,}\S(?!\S)")
_LONGEST = 40
_SIZE = 28  # a-z, any other letter, boundary
_SUBSTITUTION = -1.0
_KNOWN_WORD = 12.0


def _codes(text: str) -> np.ndarray:
    """1..26 for a-z, 27 for other letters, 0 for all else."""
    points = np.frombuffer(text.encode("utf-32-le", "replace"), "<u4")
    codes = np.where((points >= 97) & (points <= 122), points - 96, 0)
    return np.where(points >= 192, 27, codes).astype(np.int64)


def character_model(docs: DataFrame) -> np.ndarray:
    """Log-probabilities of a character after two others, from the trigrams of all texts."""

    def run(batches):
        total = np.zeros(_SIZE**3, np.int64)
        for batch in batches:
            for value in batch.column(0):
                text = value.as_py()
                if text:
                    c = np.concatenate(([0, 0], _codes(text.lower()), [0]))
                    grams = (c[:-2] * _SIZE + c[1:-1]) * _SIZE + c[2:]
                    total += np.bincount(grams, minlength=_SIZE**3)
        found = np.nonzero(total)[0]
        yield pa.RecordBatch.from_arrays(
            [pa.array(found), pa.array(total[found])], names=["gram", "n"]
        )

    rows = docs.select(F.col("text").cast("string")).mapInArrow(run, "gram long, n long")
    counts = np.full(_SIZE**3, 0.1)
    # At most _SIZE**3 rows, whatever the corpus.
    for gram, n in rows.groupBy("gram").agg(F.sum("n")).collect():
        counts[gram] += n
    table = counts.reshape(_SIZE, _SIZE, _SIZE)
    return np.log(table / table.sum(axis=2, keepdims=True)).astype(np.float32)


def _lattice(token: str) -> list[tuple[str, float]]:
    """(alternatives, cost) for each position; a run of one letter is one or two positions."""
    out: list[tuple[str, float]] = []
    at = 0
    while at < len(token):
        c, end = token[at], at + 1
        while end < len(token) and token[end] == c:
            end += 1
        if c.isalpha():
            out.append((c, 0.0))
            if end - at == 2:
                out.append((c, 0.0))
            elif end - at > 2:
                out.append((c + "\0", 0.0))
        elif c in LEET:
            options = LEET[c] + ("\0" if c in _SEPARATORS or c == "!" else "")
            out.extend([(options, _SUBSTITUTION)] * min(end - at, 2))
        at = end
    return out


def readings(token: str, model: np.ndarray, keep: int = 24) -> list[tuple[float, str]]:
    """Likeliest letter sequences of a lower-case token, best first.

    Viterbi over states of two letters; ``keep`` states survive each step.
    """
    states: dict[tuple[int, int], list[tuple[float, str]]] = {(0, 0): [(0.0, "")]}
    for options, cost in _lattice(token):
        after: dict[tuple[int, int], list[tuple[float, str]]] = {}
        for (a, b), paths in states.items():
            for letter in options:
                if letter == "\0":
                    after.setdefault((a, b), []).extend(paths)
                    continue
                code = ord(letter) - 96 if "a" <= letter <= "z" else 27
                step = float(model[a, b, code]) + cost
                after.setdefault((b, code), []).extend((s + step, w + letter) for s, w in paths)
        best = {k: sorted(v, reverse=True)[:4] for k, v in after.items()}
        states = dict(sorted(best.items(), key=lambda e: -e[1][0][0])[:keep])
    ends = [(s + float(model[a, b, 0]), w) for (a, b), v in states.items() for s, w in v]
    return sorted(ends, reverse=True)


def _windows(text: str, width: int, overlap: int):
    """The text in windows; what is no longer than ``overlap`` lies in one of them whole."""
    for at in range(0, max(1, len(text) - overlap), width - overlap):
        yield text[at : at + width]


def _words_in(word: str, weigh) -> list[str]:
    """Words that ``weigh`` knows inside a sequence of letters, the longest first at each place."""
    found, at = [], 0
    while at <= len(word) - 4:
        for size in range(min(14, len(word) - at), 3, -1):
            if weigh(word[at : at + size]) > 0:
                found.append(word[at : at + size])
                at += size - 1
                break
        at += 1
    return found


def restored(token: str, model: np.ndarray, weigh) -> list[str]:
    """Words that a distorted token reads as; ``weigh`` tells words the classifier knows.

    Runs of a sign are shortened before the token's length is looked at. A token that is still
    long is read in overlapping windows, and words that the classifier knows as a whole, of five
    letters or more, are added to its plain ones.
    """
    token = _LONG_RUN.sub(r"\1\1\1", token)
    if len(token) <= _LONGEST:
        found = readings(token, model)
        if not found:
            return []
        return [max(found, key=lambda r: r[0] + (_KNOWN_WORD if weigh(r[1]) > 0 else 0.0))[1]]
    whole = getattr(weigh, "whole", None)
    if whole is None:
        return _WORD.findall(token)
    more = {
        word
        for part in _windows(token, _LONGEST, 16)
        for _, reading in readings(part, model)[:4]
        for word in _words_in(reading, whole)
        if len(word) > 4
    }
    plain = _WORD.findall(token)
    return plain + sorted(more.difference(plain))


def _unspaced(span: str, model: np.ndarray, weigh) -> list[str]:
    """Words inside a sequence of single letters, found by the classifier's own words.

    A span of any length is decoded in overlapping windows; all known words of a window's
    likeliest reading that has some count, once for the span. Without any, its readings do.
    """
    letters = "".join(c for c in span if c not in _SEPARATORS and not c.isspace())
    known: list[str] = []
    plain: list[str] = []
    for part in _windows(letters, _LONGEST * 4, 16):
        options = [w for _, w in readings(part, model)[:8]]
        plain.extend(options[:1])
        known.extend(next(filter(None, (_words_in(w, weigh) for w in options)), []))
    return sorted(set(known)) or plain


def _read(token: str, model: np.ndarray, weigh) -> list[str]:
    """Lower-case words of one token."""
    plain = token.strip(".,;:?")
    if plain.isalpha() and not _RUN.search(plain):
        return [plain]
    if _SEPARATED.search(token):
        return _unspaced(token, model, weigh)
    bare = _DECORATION.sub("", token)
    return restored(bare, model, weigh) if _ODD.search(bare) else _WORD.findall(token)


def words_of(text: str, model: np.ndarray, weigh) -> list[str]:
    """Lower-case words of a whole text, distorted tokens restored."""
    text = text.lower()
    spaced = [w for m in _SPACED.finditer(text) for w in _unspaced(m.group(), model, weigh)]
    return [w for token in text.split() for w in _read(token, model, weigh)] + spaced


def _features(word: str) -> list[str]:
    """The word itself and its beginnings; a beginning ends in a sign no word has."""
    return [word] + sorted({word[:n] + "^" for n in (4, 5) if len(word) > 3})


def _weigher(lexicon: dict[str, float]):
    """Function of a word: the largest weight of its features, 0 for most."""
    get = lexicon.get

    def weigh(word: str) -> float:
        found = get(word, 0.0)
        if len(word) > 3:
            found = max(found, get(word[:4] + "^", 0.0), get(word[:5] + "^", 0.0))
        return found

    weigh.whole = lambda word: get(word, 0.0)
    return weigh


def _evidence(model: np.ndarray, lexicon: dict[str, float]):
    """Function of a text: the sum of the strongest three occurrences' weights.

    Tokens repeat, so the weights of a token's words are kept; nearly all have none.
    """
    weigh = _weigher(lexicon)
    known: dict[str, tuple[float, ...]] = {}

    def evidence(text: str) -> float:
        text = text.lower()
        tokens = text.split()
        found = list(map(known.get, tokens))
        if None in found:
            if len(known) > 250_000:
                known.clear()
                found = [None] * len(tokens)
            long: dict[str, tuple[float, ...]] = {}
            for token in {t for t, f in zip(tokens, found) if f is None}:
                weights = tuple(filter(None, map(weigh, _read(token, model, weigh))))
                (known if len(token) <= 200 else long)[token] = weights
            found = [known[t] if t in known else long[t] for t in tokens]
        hits = [w for weights in filter(None, found) for w in weights]
        for match in _SPACED.finditer(text):
            hits.extend(filter(None, map(weigh, _unspaced(match.group(), model, weigh))))
        return sum(sorted(hits, reverse=True)[:3])

    return evidence


def _lexicon(rows: DataFrame, model: np.ndarray, least: int, size: int) -> dict[str, float]:
    """Feature weights: lower bounds of the log-odds, from rows (text, toxic)."""

    def run(batches):
        for batch in batches:
            counts: dict[str, list[int]] = {}
            for text, toxic in zip(batch.column(0), batch.column(1).to_pylist()):
                found = words_of(text.as_py() or "", model, lambda w: 0.0)
                for feature in {f for w in set(found) for f in _features(w)}:
                    counts.setdefault(feature, [0, 0])[toxic] += 1
            yield pa.RecordBatch.from_arrays(
                [
                    pa.array(list(counts)),
                    pa.array([n for n, _ in counts.values()], pa.int64()),
                    pa.array([n for _, n in counts.values()], pa.int64()),
                ],
                names=["feature", "clean", "toxic"],
            )

    sums = {r[0]: r[1] for r in rows.groupBy("toxic").count().collect()}
    clean, toxic = sums.get(0, 0), sums.get(1, 0)
    if not clean or not toxic:
        return {}
    counted = (
        rows.select("text", F.col("toxic").cast("long").alias("toxic"))
        .mapInArrow(run, "feature string, clean long, toxic long")
        .groupBy("feature")
        .agg(F.sum("clean").alias("c"), F.sum("toxic").alias("t"))
        .filter(F.col("t") >= least)
    )
    doubt = 1.64 * F.sqrt(1 / (F.col("t") + 0.5) + 1 / (F.col("c") + 0.5))
    odds = F.log((F.col("t") + 0.5) / (toxic + 1)) - F.log((F.col("c") + 0.5) / (clean + 1))
    kept = (
        counted.withColumn("w", odds - doubt)
        .filter("w > 1")
        .orderBy(F.desc("w"), "feature")
        .limit(size)
    )
    return {r["feature"]: float(r["w"]) for r in kept.select("feature", "w").collect()}


def _curve(evidence: np.ndarray, toxic: np.ndarray) -> tuple[float, float]:
    """Slope and intercept of a logistic curve, by damped Newton steps with a weak prior."""
    slope, base = 0.5, -2.0
    for _ in range(60):
        p = 1 / (1 + np.exp(-np.clip(slope * evidence + base, -30, 30)))
        w = p * (1 - p) + 1e-6
        g = np.array([(evidence * (toxic - p)).sum() - 0.01 * slope, (toxic - p).sum() - 0.01 * base])
        h = np.array(
            [
                [(w * evidence**2).sum() + 0.01, (w * evidence).sum()],
                [(w * evidence).sum(), w.sum() + 0.01],
            ]
        )
        step = np.linalg.solve(h, g)
        slope, base = slope + np.clip(step[0], -1, 1), base + np.clip(step[1], -2, 2)
    return float(max(slope, 0.0)), float(base)


def score_toxicity(
    docs: DataFrame,
    labelled: DataFrame,
    fit_rows: int = 30_000,
    least: int = 5,
    lexicon_size: int = 20_000,
) -> DataFrame:
    """All columns of ``docs`` and ``score`` (0 to 1, higher: likelier toxic).

    ``labelled``: (doc_id, toxic 0/1) rows to learn from; nulls are ignored, of repeated ids
    the larger label holds. The classifier is fitted on at most ``fit_rows`` of them, first by a
    hash of doc_id: half for the weights of words, half for the curve. The character model
    counts all texts. Of the features that tell toxic rows, learned from those rows alone, the
    ``lexicon_size`` with the largest weights are kept. Null text is empty; empty texts have the
    score of no evidence. Whole texts are read, however long, and so are long tokens and spelt-out
    spans. Repeated rows are scored alike. Without labels of both kinds every score is 0.5 or the
    base rate. A column ``score`` in ``docs`` is replaced; other names may be any.
    """
    order = F.xxhash64("doc_id", F.lit("fit"))
    chosen = (
        labelled.filter("doc_id IS NOT NULL AND toxic IN (0, 1)")
        .groupBy(F.col("doc_id").cast("long").alias("doc_id"))
        .agg(F.max(F.col("toxic").cast("int")).alias("toxic"))
        .orderBy(order, "doc_id")
        .limit(fit_rows)
        .withColumn("half", F.pmod(F.xxhash64("doc_id", F.lit("half")), F.lit(2)))
    )
    # At most fit_rows rows of two numbers.
    fit = cut(
        docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string"))
        .join(F.broadcast(cut(chosen)), "doc_id")
        .select("text", "toxic", "half")
    )
    model = character_model(docs)
    lexicon = _lexicon(fit.filter("half = 0"), model, least, lexicon_size)
    rest = fit.filter("half = 1").select("text", F.col("toxic").cast("long").alias("toxic"))
    seen = np.array(_with_evidence(rest, model, lexicon).select("toxic", "evidence").collect())
    slope, base = _curve(seen[:, 1], seen[:, 0]) if len(seen) else (0.0, 0.0)
    inputs, names = inner(docs, ("score",), plain=F.col("text").cast("string"))
    curve = 1 / (1 + F.exp(-(F.lit(slope) * F.col("evidence") + F.lit(base))))
    scored = _with_evidence(inputs.select("plain", *names.values()), model, lexicon)
    scored = scored.select(*names.values(), curve.alias("curve"))
    return scored.select(*[F.col(n).alias(c) for c, n in names.items()], F.col("curve").alias("score"))


def _with_evidence(rows: DataFrame, model: np.ndarray, lexicon: dict[str, float]) -> DataFrame:
    """``rows`` less its first column, the text, and with ``evidence``."""
    names = [*rows.columns[1:], "evidence"]
    schema = rows.select(*rows.columns[1:], F.lit(0.0).alias("evidence")).schema

    def run(batches):
        evidence = _evidence(model, lexicon)
        for batch in batches:
            found = [evidence(text.as_py() or "") for text in batch.column(0)]
            yield pa.RecordBatch.from_arrays(
                [*batch.columns[1:], pa.array(found, pa.float64())], names=names
            )

    return rows.mapInArrow(run, schema)
