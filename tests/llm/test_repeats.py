"""Runs of words against brute force: all squares, all runs, whole documents, odd rows."""

import hashlib
import random
import zlib
from fractions import Fraction

import numpy as np
import pytest

from quillmill.llm import repeats as R
from quillmill.llm.queries import QUERIES


def brute(words, shortest=R.SHORTEST, times=R.TIMES):
    """Every maximal stretch with smallest period q, by extending from each place and period."""
    n, out = len(words), []
    for q in range(1, n // times + 1):
        i = 0
        while i + q < n:
            j = i
            while j + q < n and words[j] == words[j + q]:
                j += 1
            length = j - i + q
            if length >= max(shortest, times * q) and not any(all(words[k] == words[k + f] for k in range(i, i + length - f)) for f in range(1, q)):
                out.append((i, length, q))
            i = j + 1
    return sorted(out, key=lambda r: (r[0], r[2]))


def random_texts(seed, n):
    rng = random.Random(seed)
    for _ in range(n):
        letters = rng.choice(["a", "ab", "abc", "abcdefgh"])
        text = []
        while len(text) < rng.randrange(1, 160):
            piece = [rng.choice(letters) for _ in range(rng.randrange(1, 9))]
            text += piece * rng.choice([1, 1, 2, 3, 5])
        yield [w.encode() for w in text]


@pytest.mark.parametrize("seed", range(6))
@pytest.mark.parametrize(("shortest", "times"), [(24, 3), (2, 2), (6, 3), (5, 2)])
def test_runs_equal_brute_force(seed, shortest, times):
    texts = list(random_texts(seed * 10 + times, 60))
    assert R.find(texts, shortest, times) == [brute(t, shortest, times) for t in texts]


def test_special_words():
    fibonacci = [b"a", b"b"]
    pair = (b"a", b"ab")
    while len(pair[1]) < 600:
        pair = (pair[1], pair[1] + pair[0])
    fibonacci = [bytes([c]) for c in pair[1]]
    texts = [[], [b"x"], [b"x"] * 24, [b"x"] * 23, [b"x"] * 3000, [b"x", b"y"] * 500 + [b"x"], fibonacci, [b"q"] + [b"%d" % (i % 8) for i in range(24)] + [b"r"], [b"%d" % i for i in range(50)]]
    assert R.find(texts) == [brute(t) for t in texts]
    assert R.find(texts, 2, 2)[6] == brute(fibonacci, 2, 2)


@pytest.mark.parametrize("seed", range(4))
def test_the_vocabulary_is_every_primitive_square(seed):
    for text in random_texts(100 + seed, 25):
        s = [w[0] for w in text]
        if len(s) < 2:
            continue
        _, symbols = np.unique(s, return_inverse=True)
        factors = R.Factors(symbols)
        start, period = R.covering_pairs(factors, R.blocks(factors), np.full(len(s), len(s)))
        keep = R.primitive(factors, start, period)
        lo, _, p = R.vocabulary(factors, start[keep], period[keep])
        got = {tuple(s[factors.order[a] : factors.order[a] + 2 * b]) for a, b in zip(lo, p, strict=True)}
        want = set()
        for i in range(len(s)):
            for q in range(1, (len(s) - i) // 2 + 1):
                w = s[i : i + q]
                if w == s[i + q : i + 2 * q] and not any(q % f == 0 and w == w[:f] * (q // f) for f in range(1, q)):
                    want.add(tuple(w + w))
        assert got == want
        assert len(got) == len(lo)


def digests(doc_id, text):
    words = (text or "").encode().split()
    words = R.planted(doc_id, words)
    found = brute(words)
    gone = {i for a, n, q in found for i in range(a + q, a + n)}
    top = max(found, key=lambda r: (Fraction(r[1], r[2]), -r[0], -r[2]), default=None)
    runs = "".join(f"{a},{n},{q}\n" for a, n, q in found)
    kept = b" ".join(w for i, w in enumerate(words) if i not in gone)
    return (doc_id, len(found), *(top or (None,) * 3), 1000 * top[1] // top[2] if top else None, hashlib.sha256(runs.encode()).hexdigest(), hashlib.sha256(kept).hexdigest())


COLUMNS = ["doc_id", "n_runs", "start", "length", "period", "exponent_milli", "runs_sha256", "collapsed_sha256"]


def key(row):
    return tuple((x is None, x) for x in row)


def test_query_equals_brute_force(spark):
    sf = "/root/testdata/sf0.001"
    docs = spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "text").collect()
    got = QUERIES["op13_periodic_runs"](spark, sf).select(*COLUMNS).collect()
    small = {r.doc_id for r in docs if len((r.text or "").split()) <= 1500}  # brute force is quadratic
    assert sorted((tuple(r) for r in got if r.doc_id in small), key=key) == sorted((digests(*r) for r in docs if r.doc_id in small), key=key)
    assert len(got) == len(docs) and sum(r.n_runs > 0 for r in got) >= 10


def test_odd_texts(spark, tmp_path):
    rows = [(1, None), (2, ""), (3, " \n\t "), (4, "a " * 24), (5, "a b " * 30), (6, "　 x \x0b y " * 20), (None, "z " * 40), (None, "z " * 40), (7, "w " * 200_000), (8, "A a " * 30)]
    spark.createDataFrame([(*r, "x", "y") for r in rows], "doc_id long, text string, runs string, lang string").write.parquet(f"{tmp_path}/documents.parquet")
    got = QUERIES["op13_periodic_runs"](spark, str(tmp_path)).select(*COLUMNS).collect()
    short = [r for r in rows if r[0] != 7]
    assert sorted((tuple(r) for r in got if r.doc_id != 7), key=key) == sorted((digests(*r) for r in short), key=key)
    held = next(r for r in got if r.doc_id == 7)
    assert (held.n_runs, held.start, held.length, held.period) == (1, 0, 200_000, 1)
    whole = R.word_runs(spark.read.parquet(f"{tmp_path}/documents.parquet"), with_text=True)
    assert set(whole.columns) >= {"doc_id", "lang", "runs", "collapsed"}
    assert {r.doc_id: r.collapsed for r in whole.collect()}[8] == "A a"


def test_planted_follows_its_rule():
    doc_id = next(i for i in range(100) if zlib.crc32(str(i).encode()) % 10 == 0)
    words = [b"%d" % i for i in range(500)]
    g = zlib.crc32(str(doc_id).encode()) // 10
    a = g % 500
    p = 1 + (500 - a) // (3 + g % 8)
    assert R.planted(doc_id, words) == [words[i] if i < a else words[a + (i - a) % p] for i in range(500)]
    assert R.planted(doc_id, []) == [] and R.planted(None, words) == words
