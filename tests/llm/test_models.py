"""Quality, whitening and importance resampling against plain versions, held-out labels, and odd rows."""

from __future__ import annotations

import hashlib
import math
import os
import random
import re
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from meetlake.llm import importance, quality, whitening

SF = "/root/testdata/sf0.01"
HERE = pytest.mark.skipif(not os.path.isdir(SF), reason="the tables aren't here")
ROWS = [
    (1, "The quick brown fox jumps over the lazy dog " * 3, 5), (2, "THE QUICK brown fox jumps over the lazy dog " * 3, 5), (3, None, 5), (4, "", 5), (5, " \t\n .,;", 5), (6, "short", 5), (7, "Short", 5), (7, "Short", 5),
    (7, "another text under the same id", 5), (8, "word " * 20_000, 5), (9, "x" * 50_000, 5), (None, "no id at all", 5), (10, "漢字🙂 mail a@b.co 123", 5), (11, "Straße ÄÖÜ " * 30, 5), (12, "a-b_c d.e " * 8, 5), (13, "a-b_c d.e " * 8, 5),
]
KINDS = "doc_id long, text string, score long"


@pytest.fixture(scope="module")
def docs(spark):
    return spark.createDataFrame(ROWS, KINDS).repartition(3)


# 11: quality


def junk(chance: random.Random, bad: bool) -> str:
    words = [chance.choice(["lorem", "ipsum", "dolor", "sit", "amet", "tempor", "magna"]) for _ in range(chance.randint(3, 60))]
    return " ".join(w + chance.choice(["###", "$$$"]) if bad and chance.random() < 0.5 else w for w in words)


@pytest.fixture(scope="module")
def labelled(spark):
    chance = random.Random(5)
    rows = [(i, junk(chance, i % 4 == 0), int(i % 4 != 0)) for i in range(400)]
    return spark.createDataFrame([r[:2] for r in rows], "doc_id long, text string").repartition(4), spark.createDataFrame([(r[0], r[2]) for r in rows], "doc_id long, quality int")


def plain_average(model: quality.Model, text: str) -> np.ndarray:
    """One feature after the other, their number from the words' lengths."""
    own = text.split()
    own += ["\x00=" for a, b in zip(own, own[1:]) if a == b]
    total = sum((model.vectors[b].sum(axis=0) for w in own for _, b in quality.features([w], len(model.vectors))), np.zeros(model.vectors.shape[1]))
    return total / max(1, sum(1 + sum(max(0, len(w) + 3 - k) for k in (3, 4, 5)) for w in own)) / quality.ONE


def test_quality_averages_all_features_of_whole_texts():
    chance = np.random.default_rng(1)
    model = quality.Model(chance.normal(size=(1 << 10, 4)), chance.normal(size=(4, 2)), chance.normal(size=2))
    texts = [r[1] or "" for r in ROWS if len(r[1] or "") < 1000] + ["ab ab ab a", "x" * 300]
    found = quality.Averages(model)(texts)
    assert np.allclose(found, [plain_average(model, t) for t in texts], atol=1e-12)
    again = quality.Averages(model)
    assert all((again([t]) == f).all() for t, f in zip(reversed(texts), reversed(found)))  # whatever a text stands next to
    long = "y" * (3 * quality.AT_ONCE) + " z"
    assert np.allclose(quality.Averages(model)([long])[0], sum((model.vectors[b].sum(0) for _, b in quality.features(long.split(), 1 << 10)), np.zeros(4)) / sum(len(b) for _, b in quality.features(long.split(), 1 << 10)) / quality.ONE)


def test_quality_tells_held_out_texts(labelled):
    docs, labels = labelled
    found = quality.quality(docs, labels, ~quality.held_out()).where(quality.held_out()).join(labels, "doc_id").collect()
    assert len(found) > 100 and np.mean([r.predicted == r.quality for r in found]) >= 0.97


def test_quality_on_odd_rows(spark, docs, labelled):
    _, labels = labelled
    marks = spark.createDataFrame([(1, 1), (2, 0), (3, 0), (7, 1), (7, 0), (None, 1), (8, None), (9, 5), (10, 0)], "doc_id long, quality int")
    found = quality.quality(docs, marks).collect()
    assert sorted(str(r.doc_id) for r in found) == sorted(str(r[0]) for r in ROWS)
    assert all(0 <= r.score <= 1 and r.predicted == int(r.score >= 0.5) for r in found)
    assert len({r.score for r in found if r.doc_id in (3, 4)}) == 1
    scores = {}
    for r, text in ((r, t) for r in found for i, t, _ in ROWS if i == r.doc_id and i not in (7,)):
        scores.setdefault(text or "", set()).add(r.score)
    assert all(len(x) == 1 for x in scores.values())
    assert {r.score for r in quality.quality(docs, marks.where("false")).collect()} == {0.5}
    assert quality.quality(docs.where("false"), marks).collect() == []
    one = quality.quality(docs.repartition(1), marks).select("doc_id", "score").collect()
    assert sorted(map(str, one)) == sorted(map(str, quality.quality(docs, marks).select("doc_id", "score").collect()))


@HERE
def test_quality_query_on_held_out_labels(spark):
    labels = spark.read.parquet(f"{SF}/labels.parquet")
    rows = quality.query(spark, SF).join(labels, "doc_id").where("held_out").collect()
    assert np.mean([r.predicted == r.quality for r in rows]) >= 0.9
    assert np.mean([r.predicted for r in rows if r.quality == 1]) >= 0.97


# 12: whitening


def spectra():
    chance = np.random.default_rng(3)
    q = np.linalg.qr(chance.normal(size=(40, 40)))[0]
    turned = lambda e: q @ np.diag(e) @ q.T
    yield "ones", np.eye(40)
    yield "copies", turned(np.r_[np.full(20, 5.0), np.ones(20)])
    yield "close", turned(1 + 1e-7 * np.arange(40))
    yield "closer", turned(np.r_[1 + 1e-9 * np.arange(16), np.full(24, 0.5)])
    yield "graded", turned(2.0 ** -np.arange(40))
    yield "one", turned(np.r_[3.0, np.zeros(39)])
    yield "few", np.cov(chance.normal(size=(10, 40)).T, bias=True)
    yield "many", np.cov(chance.normal(size=(5000, 40)).T, bias=True)
    yield "short", np.cov(chance.normal(size=(50, 3)).T, bias=True)
    yield "nothing", np.zeros((4, 4))


@pytest.mark.parametrize(("name", "v"), list(spectra()))
def test_contours_find_every_eigenvalue(name, v):
    v = (v + v.T) / 2
    e, x = whitening.components(v)
    want = np.linalg.eigvalsh(v)[::-1]
    rank = int((want > len(v) * np.finfo(float).eps * 8 * max(np.trace(v), 1e-300)).sum())
    assert len(e) == min(16, rank)
    if len(e):
        assert np.allclose(e, want[: len(e)], rtol=1e-7, atol=1e-13 * want[0])
        assert np.abs(x @ x.T - np.eye(len(e))).max() < 1e-6 and np.abs(v @ x.T - x.T * e).max() < 1e-12 * want[0]


def plain_whitened(vectors: dict[int, list], want: int = 16):
    """Rows of floats to (n, deviations, components' projections, shares)."""
    x = {i: np.floor(64 * np.array(v, float)).astype(np.int64) + 1_000_000 for i, v in vectors.items()}
    u = np.unique(np.stack(list(x.values())), axis=0)
    n, s = len(u), u.sum(0)
    v = (c := (n * u - s) / n).T @ c / n
    e, q = np.linalg.eigh(v)
    e, q = e[::-1][:want], q[:, ::-1][:, :want]
    return n, {i: int(((n * a - s) ** 2).sum()) for i, a in x.items()}, {i: (n * a - s) / n @ q / np.sqrt(e) for i, a in x.items()}, e / np.trace(v)


def test_whitening_against_numpy_and_on_odd_rows(spark):
    chance = np.random.default_rng(8)
    vectors = {i: (chance.normal(size=20) * np.linspace(0.5, 2, 20) + 1).astype(np.float32).tolist() for i in range(200)}
    vectors |= {200 + i: vectors[7] for i in range(100)}  # a third of copies
    odd = [(900, None), (901, []), (902, [float("nan")] * 20), (903, [1.0] * 19 + [None]), (904, [1.0] * 19 + [float("inf")]), (905, [1.0, 2.0]), (906, [3e38] * 20)]
    rows = [(i, v, 7) for i, v in vectors.items()] + [(i, v, 7) for i, v in odd] + [(7, vectors[7], 7), (None, vectors[8], 7)]
    table = spark.createDataFrame(rows, "vec_id long, embedding array<float>, n long").repartition(5)
    found = whitening.whitened(table).collect()
    n, deviations, projected, shares = plain_whitened(vectors)
    assert n == 200 and len(found) == 16 * 302
    assert all(r.n == n and r.deviation == deviations[8 if r.vec_id is None else r.vec_id] for r in found)
    assert {r.identity_error for r in found} == {found[0].identity_error} and found[0].identity_error < 1e-10
    signs = {}
    for r in found:
        want = projected[8 if r.vec_id is None else r.vec_id][r.component - 1]
        sign = signs.setdefault(r.component, 1 if abs(r.whitened - want) < 1e-9 else -1)
        assert abs(r.whitened - sign * want) < 1e-9 and abs(r.explained / shares[r.component - 1] - 1) < 1e-9


def test_whitening_without_variance(spark):
    kinds = "vec_id long, embedding array<float>"
    assert whitening.whitened(spark.createDataFrame([], kinds)).collect() == []
    assert whitening.whitened(spark.createDataFrame([(1, None), (2, [])], kinds)).collect() == []
    assert whitening.whitened(spark.createDataFrame([(1, [1.0, 2.0]), (2, [1.0, 2.0])], kinds)).collect() == []
    found = whitening.whitened(spark.createDataFrame([(1, [1.0, 2.0]), (2, [2.0, 2.0])], kinds)).collect()
    assert sorted((r.vec_id, r.component, r.n, r.deviation, round(r.whitened, 9), r.explained) for r in found) == [(1, 1, 2, 64**2, -1.0, 1.0), (2, 1, 2, 64**2, 1.0, 1.0)]


@HERE
def test_whitening_query(spark):
    rows = spark.read.parquet(f"{SF}/embeddings.parquet").collect()
    n, deviations, projected, shares = plain_whitened({r.vec_id: r.embedding for r in rows})
    found = whitening.query(spark, SF).collect()
    assert len(found) == 16 * len(rows) and all(r.n == n and r.deviation == deviations[r.vec_id] for r in found)
    assert all(abs(abs(r.whitened) - abs(projected[r.vec_id][r.component - 1])) < 1e-9 and abs(r.explained / shares[r.component - 1] - 1) < 1e-9 for r in found)


# 13: importance resampling


def test_crcs_in_matrices_are_those_of_zlib():
    chance = random.Random(1)
    found = [chance.randbytes(chance.choice([0, 1, 2, 3, 7, 31, 255, 256, 257, 511, 512, 513, 5000])) for _ in range(1000)]
    assert importance.crcs(found).tolist() == [zlib.crc32(x) for x in found] and importance.crcs([]).tolist() == []


def plain_resampled(rows, target, words: int = 1, buckets: int = 10_000, least: int = 20, percent: int = 10):
    """doc_id, n_features, weight and score of all rows, and the ids drawn, in order; texts as dictionaries count them."""

    def features(text):
        own = re.findall("[^\x00-\x2f\x3a-\x60\x7b-\x7f]+", (text or "").translate({c: c + 32 for c in range(65, 91)}))
        return own, [zlib.crc32(" ".join(own[i : i + n]).encode()) % buckets for n in range(1, words + 1) for i in range(len(own) - n + 1)]

    s, t = np.zeros(buckets, int), np.zeros(buckets, int)
    for counts, texts in ((s, [r[1] for r in rows]), (t, target)):
        for text in texts:
            for b in features(text)[1]:
                counts[b] += 1
    gain = [math.floor(1000 * math.log((int(t[b]) + 1) * (int(s.sum()) + buckets) / ((int(s[b]) + 1) * (int(t.sum()) + buckets)))) for b in range(buckets)]
    out, fit = [], []
    for doc_id, text, *_ in rows:
        own, held = features(text)
        weight = sum(gain[b] for b in held) // len(held) if held else 0
        h = int(hashlib.sha256(f"2024:{'' if doc_id is None else doc_id}".encode()).hexdigest()[:8], 16)
        score = weight + math.floor(-1000 * math.log(-math.log((h + 0.5) / 4294967296)))
        out.append((doc_id, len(held), weight, score))
        if len(own) >= least:
            fit.append((-score, doc_id is None, doc_id))
    return out, [(d, k + 1) for k, (_, _, d) in enumerate(sorted(fit)[: percent * len(fit) // 100])]


@pytest.mark.parametrize(("words", "percent"), [(1, 10), (1, 60), (2, 50), (1, 100)])
def test_resampling_against_a_plain_version(spark, docs, words, percent):
    chance = random.Random(words)
    rows = [(100 + i, " ".join(chance.choice(["Alpha", "beta", "gamma9", "delta", "Ünder", "x_y"]) for _ in range(chance.randint(0, 60)))) for i in range(300)] + [r[:2] for r in ROWS]
    target = ["alpha beta beta", None, "", "gamma9 ünder"]
    frame = spark.createDataFrame([(*r, 3, 4) for r in rows], "doc_id long, text string, rank long, weight long").repartition(4)
    found = importance.resampled(frame, spark.createDataFrame([(x, 1) for x in target], "text string, doc_id long"), percent=percent, words=words).collect()
    want, drawn = plain_resampled(rows, target, words, percent=percent)
    assert sorted(str((r.doc_id, r.n_features, r.weight, r.score)) for r in found) == sorted(map(str, want))
    assert sorted(((r.doc_id, r["rank"]) for r in found if r["rank"] is not None), key=lambda x: x[1]) == drawn


def test_resampling_of_nothing_and_towards_nothing(spark, docs):
    empty = docs.where("false")
    assert importance.resampled(empty, docs).collect() == []
    found = importance.resampled(docs, empty.select("text"), percent=100).collect()
    assert len(found) == len(ROWS) and sorted(r["rank"] for r in found if r["rank"]) == list(range(1, 1 + sum(r.n_words >= 20 for r in found)))
    assert all(r["rank"] is None for r in importance.resampled(docs, docs, least=10**6).collect())


def test_ranks_of_ties_go_by_ids_over_many_tasks(spark):
    rows = spark.range(3000).select((F.col("id") * 7 % 3000).alias("doc_id"), F.lit(1).alias("weight"), F.lit(2).alias("print"), (F.col("id") % 3).alias("score"), F.lit(True).alias("fit"))
    found = importance.ranked(rows.repartition(8), 50).where("rank is not null").collect()
    order = sorted(((-(r.score)), r.doc_id) for r in rows.collect())[:1500]
    assert [(-r.score, r.doc_id) for r in sorted(found, key=lambda r: r["rank"])] == order and sorted(r["rank"] for r in found) == list(range(1, 1501))
