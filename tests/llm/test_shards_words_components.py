"""Sharding, spelling variants and whitening against brute force, and on odd rows."""

import itertools
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from shelfscan.llm import sharding, spelling, whitening

DOC = "doc_id long, text string, lang string"


# --- sharding ----------------------------------------------------------------------------


@pytest.mark.parametrize("n", [*range(1, 40), 255, 256, 257, 5000])
def test_network_is_a_permutation(n):
    rows = np.arange(n)
    places = sharding.permuted(rows, n, seed=11)
    assert sorted(places.tolist()) == rows.tolist()
    assert (sharding.permuted(places, n, seed=11, inverse=True) == rows).all()
    assert n < 30 or (places != sharding.permuted(rows, n, seed=12)).any()


def test_network_over_wide_ranges():
    n = 10**12 + 39
    rows = np.array([0, 1, 2, n // 2, n - 1])
    places = sharding.permuted(rows, n, 7)
    assert len(set(places.tolist())) == 5 and places.min() >= 0 and places.max() < n
    assert (sharding.permuted(places, n, 7, inverse=True) == rows).all()
    shard, slot = sharding.place_of(n // 2, n, 8, 7)
    assert sharding.row_of(shard, slot, n, 8, 7) == n // 2


def test_shuffle_moves_rows_evenly():
    n = 80_000
    places = sharding.permuted(np.arange(n), n, 7)
    # Rows of one eighth of the table come to every shard in like number.
    counts = Counter((places[: n // 8] % 8).tolist())
    assert max(abs(c - n / 64) for c in counts.values()) < 5 * (n / 64) ** 0.5
    assert abs(np.corrcoef(np.arange(n), places)[0, 1]) < 0.02


@pytest.fixture(scope="module")
def odd(spark):
    """A hot id, repeated rows, nulls, empty and long texts, columns of the result's names."""
    rows = [(1, "same", "en")] * 300 + [(i, f"text {i}", "de") for i in range(400)]
    rows += [(None, None, None), (None, "x", None), (5, "", "en"), (6, "long " * 40_000, "en")]
    found = spark.createDataFrame(rows, DOC)
    for name in ("tie", "part", "at", "before", "whole", "shard", "Slot", "shard_row", "block"):
        found = found.withColumn(name, F.concat(F.lit(name), F.col("doc_id").cast("string")))
    return found


def test_shards(spark, odd):
    parts = [odd.repartition(7), odd.coalesce(1)]
    found = [sharding.assign(p, 8, 7).collect() for p in parts]
    n = len(found[0])
    for rows in found:
        slots = defaultdict(list)
        for r in rows:
            slots[r["shard"]].append(r["slot"])
            assert (r["shard"], r["slot"]) == sharding.place_of(r["shard_row"], n, 8, 7)
            assert r["tie"] == (None if r["doc_id"] is None else f"tie{r['doc_id']}")
            assert r["block"] == (None if r["doc_id"] is None else f"block{r['doc_id']}")
        assert all(sorted(s) == list(range(len(s))) for s in slots.values())
        sizes = [len(s) for s in slots.values()]
        assert sum(sizes) == odd.count() and max(sizes) - min(sizes) <= 1
        by_row = sorted(rows, key=lambda r: r["shard_row"])
        ids = [-1 if r["doc_id"] is None else r["doc_id"] for r in by_row]
        assert ids == sorted(ids)
    assert sorted(map(repr, found[0])) == sorted(map(repr, found[1]))


def test_written_shards(spark, odd, tmp_path):
    placed = sharding.assign(odd.select("doc_id", "text"), 4, 3)
    sharding.write_shards(placed, f"{tmp_path}/out", files_of=50)
    back = spark.read.parquet(f"{tmp_path}/out")
    assert sorted(map(repr, back.select(placed.columns).collect())) == sorted(map(repr, placed.collect()))
    spans = back.groupBy(F.input_file_name()).agg(
        (F.max("slot") - F.min("slot") + 1 - F.count("*")).alias("holes")
    )
    assert spans.filter("holes <> 0").isEmpty()


def test_no_rows_to_shard(spark):
    assert sharding.assign(spark.createDataFrame([], DOC)).count() == 0


# --- spelling variants -------------------------------------------------------------------


def _near(a, b):
    if abs(len(a) - len(b)) > 1 or a == b:
        return False
    if len(a) > len(b):
        a, b = b, a
    at = next((i for i, (x, y) in enumerate(zip(a, b)) if x != y), len(a))
    return a[at + (len(a) == len(b)) :] == b[at + 1 :]


def _wanted(words, times):
    near = {w: [v for v in words if _near(w, v)] for w in words}
    form = {}
    for w in words:
        best = min(near[w], key=lambda v: (-words[v], v), default=None)
        form[w] = best if best is not None and words[best] >= times * words[w] else None
    root = {}
    for w in words:
        at = w
        while form[at] is not None:
            at = form[at]
        root[w] = at
    return {
        (w, words[w], len(near[w]), form[w], words[form[w]] if form[w] else None, root[w]) for w in words
    }


def _found(rows):
    return {tuple(r[c] for c in ("word", "n", "n_near", "form", "form_n", "root")) for r in rows.collect()}


def test_variants(spark):
    rng = np.random.default_rng(5)
    words = {}
    for letters in itertools.product("aé", repeat=5):
        words["".join(letters)] = int(5 ** rng.integers(1, 7))
    for _ in range(300):
        base = list(rng.choice(list("abÿ"), rng.integers(4, 9)))
        words["".join(base)] = int(5 ** rng.integers(1, 7))
    # One letter more and less, a run of one letter, words around and above the length kept as text.
    for n in (6, 7, 62, 63, 64, 65, 66, 3000, 3001):
        words["z" * n] = 5 * n
        words["y" + "z" * (n - 1)] = n
        words["z" * (n // 2) + "x" + "z" * (n - n // 2 - 1)] = n + 1
    rows = spark.createDataFrame(list(words.items()), "word string, n long")
    got = spelling.variants(rows.repartition(5), 5)
    assert got.count() == len(words)
    assert _found(got) == _wanted(words, 5)


def test_long_word_in_linear_space():
    word = "ab" * 20_000
    assert max(len(p) for p, _ in itertools.islice(spelling._rotations(word), 100)) < 64


def _plain_words(rows, every, min_length, min_count):
    import re

    table = {ord(c): c.lower() for c in "ABCDEFGHIJKLMNOPQRSTUVWXYZ"}
    counts = Counter()
    for doc_id, text in rows:
        for run in re.findall("[A-Za-zÀ-ÿ]+", text or ""):
            run = run.translate(table)
            h = zlib.crc32(f"{'' if doc_id is None else doc_id}:{run}".encode())
            if h % every == 0:
                at = h % len(run)
                run = run[:at] + run[at + 1 :]
            counts[run] += 1
    return {w: n for w, n in counts.items() if len(w) >= min_length and n >= min_count}


def test_word_counts(spark, monkeypatch):
    text = "Hello, Wörld! ÀÉÎ×÷ÿ straße 日本 worlds-world x́y " * 3
    rows = [(1, text), (1, text), (None, text), (2, None), (3, ""), (4, "A" * 5000)]
    rows += [(i, "Common words of Every document in ANY case " + text) for i in range(40)]
    rows += [(7, "aBc" * 700_000 + " " + "word " * 300_000)]
    docs = spark.createDataFrame([(*r, "x") for r in rows], "doc_id long, text string, n string")
    docs = docs.withColumn("word", F.lit("y"))
    got = {r["word"]: r["n"] for r in spelling.count_words(docs, 3, 2, 2).collect()}
    assert got == _plain_words(rows, 3, 2, 2)
    assert spelling.count_words(docs.limit(0)).count() == 0
    assert spelling.variants(spelling.count_words(docs.limit(0))).count() == 0


# --- whitening ---------------------------------------------------------------------------


def _vectors(spark, matrix, more=()):
    rows = [(i, [float(v) for v in row]) for i, row in enumerate(matrix)]
    return spark.createDataFrame(rows + list(more), "vec_id long, v array<double>")


def _check(spark, matrix, more=(), components=8):
    table = _vectors(spark, matrix, more).withColumn("n", F.lit("n")).withColumn("whitened", F.lit("w"))
    model = whitening.fit(table, "v")
    got = sorted(whitening.whiten(table.repartition(3), model, "v", components).collect(), key=lambda r: r["vec_id"])
    assert [r["vec_id"] for r in got] == list(range(len(matrix))) and all(r["n"] == "n" for r in got)
    x = np.floor(1024 * np.asarray(matrix, dtype=float)).astype(np.int64) + 100_000
    n, sums = len(x), x.sum(axis=0)
    assert [r["deviation"] for r in got] == [
        sum((n * int(v) - int(s)) ** 2 for v, s in zip(row, sums)) for row in x
    ]
    a = (n * x - sums) / n
    e, u = np.linalg.eigh(a.T @ a / n)
    e, u = e[::-1], u[:, ::-1]
    k = len(got[0]["whitened"])
    want = a @ u[:, :k] / np.sqrt(e[:k])
    have = np.array([r["whitened"] for r in got])
    sign = np.sign((have * want).sum(axis=0))
    assert np.allclose(have * sign, want, rtol=1e-6, atol=1e-6)
    assert np.allclose(model.variances[:k], e[:k], rtol=1e-9)
    assert k == 0 or whitening.identity_error(table, model, "v", components) < 1e-8
    return model, k


def test_whitening(spark):
    rng = np.random.default_rng(2)
    odd = [(900, None), (901, [1.0, None] + [0.0] * 10), (902, [float("nan")] * 12), (903, [float("inf")] * 12)]
    _, k = _check(spark, rng.normal(size=(400, 12)) @ rng.normal(size=(12, 12)) + 5, odd)
    assert k == 8


def test_whitening_of_ill_conditioned_rows(spark):
    rng = np.random.default_rng(3)
    model, k = _check(spark, rng.normal(size=(500, 6)) * [500, 50, 5, 0.5, 0.05, 0.01])
    assert k == 6 and model.passes >= 3


def test_whitening_of_dependent_and_constant_dimensions(spark):
    rng = np.random.default_rng(4)
    two = rng.integers(-50, 50, (300, 2)).astype(float)
    _, k = _check(spark, np.c_[two, two[:, 0], np.ones(300), np.zeros(300)])
    assert k == 2
    _, k = _check(spark, [[1.0, 2.0, 3.0]] * 7)
    assert k == 0
    _, k = _check(spark, rng.normal(size=(3, 6)))
    assert k == 2


def test_no_rows_to_whiten(spark):
    table = _vectors(spark, [], [(1, None), (2, [])])
    model = whitening.fit(table, "v")
    got = whitening.whiten(table, model, "v").collect()
    assert [(r["vec_id"], r["deviation"], r["whitened"]) for r in got] == [(2, 0, [])]
    assert whitening.identity_error(table, model, "v") is None
    assert whitening.fit(table.limit(0), "v").n == 0
    with pytest.raises(ValueError):
        whitening.fit(_vectors(spark, [[1.0], [2.0, 3.0]]), "v")


# --- token ids ---------------------------------------------------------------------------


def test_encoder_gives_the_tokenizers_ids():
    import random

    from tokenizers import Tokenizer

    from shelfscan.llm import packing
    from shelfscan.llm.settings import vocabulary

    rng = random.Random(1)
    signs = [chr(i) for i in range(256)] + ["'s", "'T", "12", "<|endoftext|>", "́", "日"] * 4 + list("abcABC ") * 9
    texts = ["".join(rng.choice(signs) for _ in range(80)) for _ in range(500)]
    plain = [s for s in signs if s.isascii() or s in "ÀÉßÿ"]
    texts += ["".join(rng.choice(plain) for _ in range(80)) for _ in range(500)] + ["", " ", "don't " * 3000]
    for name in ("word_bpe_49k.json", "byte_bpe_50k.json"):
        path = vocabulary(name)
        encoder, tokenizer = packing._Encoder(path), Tokenizer.from_file(path)
        assert (encoder.parts is not None) == (name == "word_bpe_49k.json")
        got = [ids for at in range(0, len(texts), 100) for ids in encoder.encode(texts[at : at + 100])]
        for text, ids in zip(texts, got):
            want = tokenizer.encode(text, add_special_tokens=False).ids
            assert np.frombuffer(ids, "<u4").tolist() == want


def test_full_pieces_have_sequences_of_their_own(spark):
    from shelfscan.llm import packing

    rows = [(i, 0, 0, [64, 64, 30, 20, 14][i % 5], i) for i in range(500)]
    table = spark.createDataFrame(rows, "doc_id long, piece int, start long, length long, ids_crc32 long")
    got = packing.pack(packing.cut(table.repartition(4)), 64).collect()
    bins = defaultdict(list)
    for r in got:
        bins[r["sequence_id"]].append((r["offset"], r["length"]))
    assert len(got) == 500 and len(bins) == 300
    for members in bins.values():
        at = 0
        for offset, length in sorted(members):
            assert offset == at
            at += length
        assert at <= 64


# --- clashing names, odd rows, long and spelt-out words ----------------------------------

CLASHING = (
    "rest level_0 level_1 weight_0 mix_tokens mix_0 whole take_ range_ place_ supply share hash ranges from_ sum_ "
    "site site_ bad bad_ row_ key mark n_ n_lines line evidence evidence_ text_ plain score mix_time one two root fp "
    "least in_0_ extra_0_ fingerprint component_id length sequence_id"
).split()


@pytest.fixture(scope="module")
def clashing(spark):
    """Odd rows whose columns have the names that operators use inside; each value tells its row."""
    rows = [
        (1, "one two three four five six seven", "en", "src1", 3),
        (1, "one two three four five six seven", "en", "src1", 3),
        (1, "another text under the same id, quite unlike", "en", "src1", 3),
        (2, None, "en", None, None), (None, "no id here", None, "src2", 1), (3, "", "de", "src3", 0),
        (4, "Ünïcode \x0b words\n\n\nand lines  ", "de", "src3", 9), (5, "word " * 30_000, "en", "src1", 150_000),
    ]
    table = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")
    return table.withColumns(
        {n: F.concat(F.lit(n), F.coalesce(F.col("doc_id").cast("string"), F.lit("-"))) for n in CLASHING}
    )


def _kept(rows, replaced=()):
    for r in rows:
        tag = "-" if r["doc_id"] is None else str(r["doc_id"])
        for name in CLASHING:
            if name not in replaced:
                assert r[name] == name + tag, name


def test_operators_keep_columns_of_any_name(spark, clashing):
    from shelfscan.llm import lines, mixing, simhash, toxicity
    from shelfscan.llm.settings import MIX

    columns = clashing.columns
    mixed = mixing.mix(clashing, **{**MIX, "budget_share": 2.0}).collect()
    made = ("mix_0", "mix_tokens")
    _kept(mixed, made)
    assert len(mixed) == 8 and {r["mix_copies"] for r in mixed} == {2}
    assert sorted(r["mix_tokens"] for r in mixed)[-1] == 30_001
    left = lines.remove_boilerplate(clashing, "source", 2).collect()
    _kept(left, ("n_lines",))
    assert {r["doc_id"]: r["n_lines"] for r in left}[4] == 4 and list(left[0].asDict())[:5] == columns[:5]
    labels = spark.createDataFrame([(1, 1), (3, 0), (None, 1), (4, None)], "doc_id long, toxic int")
    scored = toxicity.score_toxicity(clashing, labels).collect()
    _kept(scored, ("score",))
    assert len(scored) == 8 and all(0 <= r["score"] <= 1 for r in scored)
    one = simhash.representatives(clashing)
    assert one.columns == columns
    _kept(one.collect())


def test_one_row_stays_of_each_group(spark):
    from shelfscan.llm import simhash

    text = " ".join(f"w{i}" for i in range(60))
    other = " ".join(f"v{i}" for i in range(60))
    rows = [(1, text), (1, other), (2, other), (3, text), (3, text), (None, text), (None, "alone"), (None, "alone")]
    rows += [(9, None), (8, ""), (7, "b b b")] + [(7, "b b b")] * 40
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(5)
    got = sorted(map(tuple, simhash.representatives(docs).collect()), key=str)
    assert got == sorted([(1, text), (1, other), (None, "alone"), (8, ""), (7, "b b b")], key=str)
    assert simhash.representatives(docs.limit(0)).count() == 0


def test_pipeline_stages_on_odd_rows(spark, clashing, tmp_path):
    import corpus_pipeline

    labels = spark.createDataFrame([(4, 0), (3, 0)], "doc_id long, toxic int")
    labels.write.parquet(f"{tmp_path}/labels.parquet")
    for name, stage in corpus_pipeline.STAGES[:-1]:
        done = stage(spark, clashing, str(tmp_path))
        assert done.columns == clashing.columns, name
        rows = done.collect()
        _kept(rows)
        ids = {r["doc_id"] for r in rows}
        if name in ("line_dedup", "toxicity"):
            assert len(rows) == 8, name
        if name == "simhash_dedup":
            assert len(rows) == 6 and len([r for r in rows if r["doc_id"] == 1]) == 2
            # Null and empty texts have equal fingerprints.
            assert ids == {None, 1, 2, 4, 5}
    packed = corpus_pipeline.STAGES[-1][1](spark, clashing, str(tmp_path))
    assert packed.filter("piece = 0").count() == 8
    for name, stage in corpus_pipeline.STAGES:
        assert stage(spark, clashing.limit(0), str(tmp_path)).count() == 0


@pytest.fixture(scope="module")
def letters(spark):
    from shelfscan.llm import toxicity

    text = "you stupid moron this is a plain sentence of common words and idle talk " * 40
    return toxicity.character_model(spark.createDataFrame([(text,)], "text string"))


def test_long_spans_and_runs_are_decoded_whole(letters):
    from shelfscan.llm import toxicity

    evidence = toxicity._evidence(letters, {"stupid": 3.0, "moron": 2.0})
    alone = evidence("you stupid")
    assert alone == 3.0 and evidence("a plain sentence") == 0.0
    filler = " ".join("plainsentence"[i % 13] for i in range(240))
    assert evidence(f"{filler} s t u p i d") == alone
    assert evidence("s t u p i d m o r o n") == 5.0
    assert evidence(" ".join("stupid" + "plain" * 100 + "moron")) == 5.0
    # Runs of any length, and long tokens.
    assert evidence("st" + "u" * 50 + "pid") == alone
    assert evidence("st" + "u" * 5000 + "pid") == alone
    joined = "pl41n-s3nt3nc3-" * 30
    assert evidence(joined) == 0.0 and evidence(joined + "stup1d-" + joined) == alone
    assert len(toxicity._words_in("xxstupidmoronxx", lambda w: float(w in ("stupid", "moron")))) == 2


# --- embedding near-duplicates -----------------------------------------------------------


def test_vectors_that_point_one_way(spark):
    """Near pairs among vectors of one label with a mean cosine of 0.8."""
    from shelfscan.llm import neighbours

    rng = np.random.default_rng(8)
    n, d = 6000, 64
    shared = rng.standard_normal(d)
    shared /= np.linalg.norm(shared)
    own = rng.standard_normal((n, d))
    own -= np.outer(own @ shared, shared)
    own /= np.linalg.norm(own, axis=1, keepdims=True)
    vectors = np.sqrt(0.8) * shared + np.sqrt(0.2) * own
    # Each of 300 has one partner at a cosine of about 0.94.
    near = own[:300] * 0.7 + np.sqrt(1 - 0.49) * own[300:600]
    vectors = np.vstack([vectors, np.sqrt(0.8) * shared + np.sqrt(0.2) * near])
    rows = [(i, v.tolist(), 1) for i, v in enumerate(vectors)]
    table = spark.createDataFrame(rows, "vec_id long, embedding array<double>, label int").repartition(4)
    unit = vectors / np.linalg.norm(vectors, axis=1, keepdims=True)
    links = (unit @ unit.T >= 0.93) & ~np.eye(len(unit), dtype=bool)
    want = links.sum(axis=1)
    assert want.sum() >= 500
    got = {r["vec_id"]: r["n_links"] for r in neighbours.near_duplicates(table, window=128, block_rows=512).collect()}
    found = np.array([got[i] for i in range(len(unit))])
    assert (found <= want).all() and found.sum() >= 0.95 * want.sum()


def test_passes_follow_the_spans():
    from shelfscan.llm import neighbours

    few = neighbours.passes_for({-1: 100}, 0.93, 0.01)
    some = neighbours.passes_for({5: 100}, 0.93, 0.01)
    many = neighbours.passes_for({5: 10, 20: 90}, 0.93, 0.01)
    assert few == 2 < some < many
    hit = (1 - np.arccos(0.93) / np.pi) ** 6
    assert (1 - hit) ** some <= 0.01 < (1 - hit) ** (some - 1)


def test_vectors_of_any_length(spark):
    from shelfscan.llm import neighbours

    base = np.array([1.0, 2.0, 3.0])
    rows = [(1, base * 1e200), (2, base * 2e200), (3, base * 1e-170), (4, np.array([9.0, 0.1, 0.1])), (5, base * 3e-300)]
    table = spark.createDataFrame([(i, v.tolist(), 1) for i, v in rows], "vec_id long, embedding array<double>, label int")
    got = {r["vec_id"]: (r["n_links"], r["component_id"]) for r in neighbours.near_duplicates(table).collect()}
    assert got == {1: (3, 1), 2: (3, 1), 3: (3, 1), 4: (0, 4), 5: (3, 1)}


# --- nearest neighbours ------------------------------------------------------------------


@pytest.mark.parametrize("factor", [1, 1e4, 1e200])
def test_nearest_with_one_long_vector_and_many_shards(spark, factor):
    from shelfscan.llm import hnsw

    rng = np.random.default_rng(6)
    vectors = rng.standard_normal((1500, 24))
    vectors /= np.linalg.norm(vectors, axis=1, keepdims=True)
    vectors[700] *= factor
    rows = [(i, v.tolist()) for i, v in enumerate(vectors)]
    table = spark.createDataFrame(rows, "vec_id long, embedding array<double>").withColumn("shard", F.lit("x"))
    index = hnsw.build_index(table, "vec_id", "embedding", shard_rows=500)
    index = hnsw.cut(index)
    assert index.count() == (3 if factor == 1 else 4)
    asked = table.filter("vec_id % 20 = 0")
    got = defaultdict(list)
    for r in hnsw.search(index, asked, "vec_id", "embedding", k=20, block_rows=4).orderBy("query_id", "rank").collect():
        got[r["query_id"]].append(r["id"])
        assert r["score"] == pytest.approx(vectors[r["query_id"]] @ vectors[r["id"]], rel=1e-9)
    hits = 0
    for q in range(0, 1500, 20):
        scores = vectors @ vectors[q]
        scores[q] = -np.inf
        hits += len(set(np.argsort(-scores, kind="stable")[:20]) & set(got[q]))
        assert len(got[q]) == 20
    assert hits >= 0.95 * 75 * 20
    none = asked.limit(0)
    assert hnsw.search(index, none, "vec_id", "embedding").count() == 0
