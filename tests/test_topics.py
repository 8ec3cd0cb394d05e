"""Co-occurrence, PMI, anchors, mixtures and agreement against dense and enumerated versions."""

import itertools
import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from quillmill.operators import clusters, topics

TEXTS = ["the cat sat on the mat", "The dog and the cat", "a a a b", "", None, "alone", "b  c\td\nb", "mat on mat on mat"]


@pytest.fixture(scope="module")
def docs(spark):
    return spark.createDataFrame(list(enumerate(TEXTS)), "doc_id long, text string")


def dense(window):
    held = [(t or "").lower().split() for t in TEXTS]
    vocab = {w: i for i, w in enumerate(sorted({w for d in held for w in d}))}
    cooc, counts = np.zeros((len(vocab),) * 2), np.zeros(len(vocab))
    for d in held:
        for i, w in enumerate(d):
            counts[vocab[w]] += 1
            for v in d[i + 1 : i + window]:
                cooc[vocab[w], vocab[v]] += 1
                cooc[vocab[v], vocab[w]] += 1
    return vocab, cooc, counts


@pytest.mark.parametrize("window", [2, 5])
def test_cooccurrence_is_the_dense_matrix(docs, window):
    vocab, cooc, counts = dense(window)
    got = np.zeros_like(cooc)
    for r in topics.both_ways(topics.cooccurrence(docs, window)).collect():
        got[vocab[r.a], vocab[r.b]] += r.n
    assert (got == cooc).all()
    assert {r.term: r.n for r in topics.word_counts(docs).collect()} == {w: counts[i] for w, i in vocab.items()}


def dense_scores():
    vocab, cooc, counts = dense(5)
    eps = 1e-9
    p_ij, p_i = np.maximum(cooc / cooc.sum(), eps), counts / counts.sum()
    pmi = np.log(p_ij / np.outer(p_i, p_i + eps)) / np.maximum(-np.log(p_ij), eps)
    return vocab, pmi


def test_scores_equal_the_dense_sums(docs):
    vocab, pmi = dense_scores()
    pairs, counts = topics.cooccurrence(docs), topics.word_counts(docs)
    got = {r.term: r.score for r in topics.word_scores(pairs, counts).collect()}
    assert set(got) == set(vocab)
    for w, i in vocab.items():
        assert got[w] == pytest.approx(pmi[i].sum(), abs=1e-9)
    for r in topics.normalized_pmi(pairs, counts).collect():
        assert r.npmi == pytest.approx(pmi[vocab[r.a], vocab[r.b]], abs=1e-9)
    order = sorted(got, key=lambda w: (-round(got[w], 9), w))
    assert [r.term for r in topics.anchors(topics.word_scores(pairs, counts), 4).orderBy("rank").collect()] == order[:4]


def test_mixtures_equal_a_search(docs, spark):
    """Weights are on the simplex and no worse than any point of a fine grid."""
    vocab, cooc, _ = dense(5)
    chosen = spark.createDataFrame([(0, "cat", 0.0), (1, "mat", 0.0), (2, "a", 0.0)], "rank int, term string, score double")
    got = topics.topic_mixtures(topics.cooccurrence(docs), chosen, tolerance=1e-7, most=20000).collect()
    mass = cooc.sum(1)
    assert {r.term for r in got} == {w for w, i in vocab.items() if mass[i]}
    q = cooc / np.maximum(mass, 1e-12)[:, None]
    rows = q[[vocab[w] for w in ("cat", "mat", "a")]]
    grid = [(i / 40, j / 40, 1 - (i + j) / 40) for i in range(41) for j in range(41 - i)]
    for r in got:
        loss = lambda w, r=r: ((q[vocab[r.term]] - np.array(w) @ rows) ** 2).sum()
        assert sum(r.weights) == pytest.approx(1) and min(r.weights) >= 0
        assert loss(r.weights) <= min(map(loss, grid)) + 1e-6
    assert topics.convergence(spark.createDataFrame(got)).agg(F.sum("n")).first()[0] == len(got)
    shares = topics.topic_words(spark.createDataFrame(got), topics.word_counts(docs)).groupBy("topic").agg(F.sum("share").alias("s")).collect()
    assert [pytest.approx(1)] * 3 == [r.s for r in shares]


def test_documents_take_their_first_anchor(docs, spark):
    chosen = spark.createDataFrame([(0, "zebra", 0.0), (1, "mat", 0.0), (2, "cat", 0.0)], "rank int, term string, score double")
    assert [r.topic for r in topics.assigned(docs, chosen).orderBy("doc_id").collect()] == [2, 2, 0, 0, 0, 0, 0, 1]


def test_too_many_anchors_are_refused(docs, spark):
    chosen = spark.createDataFrame([(i, f"w{i}", 0.0) for i in range(topics.MOST_ANCHORS + 1)], "rank int, term string, score double")
    with pytest.raises(ValueError, match="at most"):
        topics.topic_mixtures(topics.cooccurrence(docs), chosen)


def by_pairs(a, b):
    """Adjusted Rand index by looking at every pair of rows, NMI from its definition."""
    n, both, in_a, in_b = len(a), 0, 0, 0
    for i, j in itertools.combinations(range(n), 2):
        in_a += a[i] == a[j]
        in_b += b[i] == b[j]
        both += a[i] == a[j] and b[i] == b[j]
    expected, top = in_a * in_b / (n * (n - 1) / 2), (in_a + in_b) / 2
    p = lambda x: {k: x.count(k) / n for k in set(x)}
    pa, pb, pab = p(a), p(b), p(list(zip(a, b, strict=True)))
    h = lambda d: -sum(v * math.log(v) for v in d.values())
    mutual = sum(v * math.log(v / (pa[i] * pb[j])) for (i, j), v in pab.items())
    return (both - expected) / (top - expected), mutual / ((h(pa) + h(pb)) / 2)


def test_agreement_equals_all_pairs(spark):
    rng = random.Random(3)
    rows = [(g, rng.choice("abc"), rng.choice("xyzw")) for g in "pq" for _ in range(60)]
    table = clusters.contingency(spark.createDataFrame([*rows, ("p", None, "x"), ("q", "a", None)], "g string, t string, f string"), "t", "f", "g")
    for r in clusters.agreement(table, "g").collect():
        own = [x for x in rows if x[0] == r.g]
        ari, nmi = by_pairs([x[1] for x in own], [x[2] for x in own])
        assert (r.n, r.ari, r.nmi) == (60, pytest.approx(ari), pytest.approx(nmi))
    whole = clusters.agreement(clusters.contingency(spark.createDataFrame([("a", "x"), ("a", "x")], "t string, f string"), "t", "f")).first()
    assert (whole.n, whole.ari, whole.nmi) == (2, 1.0, 1.0)


@pytest.mark.parametrize("seed", range(8))
def test_matching_is_the_best(seed):
    rng = random.Random(seed)
    rows, cols = rng.randrange(1, 6), rng.randrange(1, 6)
    gain = [[rng.randrange(20) for _ in range(cols)] for _ in range(rows)]
    got = clusters.best_matching(gain)
    short, long = sorted((rows, cols))
    best = max(sum(gain[i][j] if rows <= cols else gain[j][i] for i, j in zip(range(short), p, strict=True)) for p in itertools.permutations(range(long), short))
    assert len(got) == short == len({i for i, _ in got}) == len({j for _, j in got})
    assert sum(gain[i][j] for i, j in got) == best


def test_matched_accuracy(spark):
    rows = [("a", "1")] * 5 + [("a", "2")] * 2 + [("b", "1")] * 4 + [("c", "3")] * 3
    held = clusters.contingency(spark.createDataFrame(rows, "t string, f string"), "t", "f")
    assert clusters.matched_accuracy(held).first().accuracy == pytest.approx(9 / 14)


def test_pair_total_needs_no_pairs(spark):
    """The sum of all pairs' counts from the lengths alone, short, empty and null texts too."""
    docs = spark.createDataFrame([(1, "a b c d e f g"), (2, "a"), (3, ""), (4, None), (5, " x\ty  x ")], "doc_id long, text string")
    assert topics.pair_total(docs) == topics.cooccurrence(docs).agg(F.sum("n")).first()[0] == 21
    assert topics.pair_total(docs.filter("doc_id = 4")) == 0
