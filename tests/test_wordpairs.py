"""Packed word pairs against the same counts with a row for each pair, in any number of chunks and blocks."""

import random

import numpy as np
import pytest
from pyspark.sql import functions as F

import __spark_entry__ as entry
from quillmill.operators import topics, wordpairs

RNG = random.Random(11)
TEXTS = ["the cat sat on the mat", "The dog and the cat", "a a a b", "", None, "alone", " b  c\td\nb\x0b\x0cé \x1cx\x85y ", "mat on mat on mat"]
TEXTS += [" ".join(f"w{int(RNG.expovariate(0.05))}" for _ in range(RNG.randrange(1, 90))) for _ in range(150)]


@pytest.fixture(scope="module")
def docs(spark):
    return spark.createDataFrame(list(enumerate(TEXTS)), "doc_id long, text string").repartition(2)


@pytest.fixture(params=[(1_000_000, 700_000), (300, 40)])
def cut(request, monkeypatch):
    monkeypatch.setattr(wordpairs, "TOKENS_A_CHUNK", request.param[0])
    monkeypatch.setattr(wordpairs, "TOKENS_A_CELL", request.param[1])


@pytest.mark.parametrize("window", [2, 5])
def test_pairs_and_scores_are_the_plain_ones(docs, cut, window):
    plain, counts = topics.cooccurrence(docs, window), topics.word_counts(docs)
    held = wordpairs.Pairs(docs, window)
    assert held.near == topics.pair_total(docs, window) and {tuple(r) for r in held.counts.collect()} == {tuple(r) for r in counts.collect()}
    got = {(r.a, r.b): (r.n, r.npmi) for r in held.npmi().collect()}
    want = {(r.a, r.b): (r.n, pytest.approx(r.npmi, abs=1e-9)) for r in topics.normalized_pmi(plain, counts).collect()}
    assert got == want
    scores = {r.term: (r.n, pytest.approx(r.score, abs=1e-8)) for r in topics.word_scores(plain, counts).collect()}
    assert {r.term: (r.n, r.score) for r in held.scores().collect()} == scores


def test_products_need_no_pairs(docs, cut, spark):
    names = ["the", "w3", "b", "alone", "nowhere"]
    chosen = spark.createDataFrame([(i, t, 0.0) for i, t in enumerate(names)], "rank int, term string, score double")
    got = {r.term: r for r in topics.mixtures(wordpairs.Pairs(docs), chosen).collect()}
    want = {r.term: r for r in topics.topic_mixtures(topics.cooccurrence(docs), chosen).collect()}
    assert got.keys() == want.keys() and "alone" not in got
    assert all(got[t].weights == pytest.approx(want[t].weights, abs=1e-9) for t in want)


def test_no_words(spark):
    held = wordpairs.Pairs(spark.createDataFrame([(1, None), (2, " ")], "doc_id long, text string"))
    assert held.npmi().count() == held.scores().count() == held.counts.count() == held.products([]).count() == 0


def test_long_numbers_are_added_too():
    key, n = np.array([2**62, 5, 2**62, 5, 7]), np.array([1, 2, 3, 4, 5])
    for sums in (None, n):
        got = wordpairs.added(key.copy(), sums)
        assert got[0].tolist() == [5, 7, 2**62] and got[1].tolist() == ([2, 1, 2] if sums is None else [6, 5, 4])
    for a in (key, np.array([0.5, -1.0]), np.zeros(0, np.int64)):
        assert (wordpairs.unpacked(wordpairs.packed(a), a.dtype) == a).all()


@pytest.mark.parametrize("name", ["topic_word_weights", "topic_anchors", "topic_assignment", "word_npmi_scores", "word_pair_npmi"])
def test_no_row_for_each_pair(spark, monkeypatch, name):
    """Pairs are neither rows nor made more than once."""
    calls, dealt = [], wordpairs._dealt_pairs
    monkeypatch.setattr(topics, "cooccurrence", lambda *a: pytest.fail("a row a pair"))
    monkeypatch.setattr(wordpairs, "_dealt_pairs", lambda *a: calls.append(a) or dealt(*a))
    assert entry.queries()[name](spark, "/root/testdata/sf0.001").filter(F.lit(True)).limit(1).count() == 1
    assert len(calls) == 1
