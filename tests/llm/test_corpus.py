"""The corpus operators against brute force, a reference library, round trips and held-out labels."""

import collections
import hashlib
import random
import re
import zlib

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from quillmill.llm import bpe, components, embeddings, fingerprint, jaccard, langid, mixing, pii, quality, sharding, toxicity
from quillmill.llm.common import fold, raw_texts

WORDS = "sea sky rain wind stone tree leaf bird song night day light dark road house door hand voice word time".split()


def prose(rng, n):
    return " ".join(rng.choice(WORDS) + rng.choice(["", "s", "ly", "ing"]) for _ in range(n))


# ---------------------------------------------------------------- 1, 8, 9: learned labels

def labelled(rng, make, n=400):
    return [(i, *make(rng, i)) for i in range(n)]


def accuracy(spark, rows, labels, train, predict, mod, held, column, tmp):
    docs = spark.createDataFrame([(i, t) for i, t, _ in rows], "doc_id long, text string")
    known = spark.createDataFrame([(i, y) for i, _, y in rows], f"doc_id long, {column} int")
    got = predict(docs, train(docs, known.filter(fold("doc_id", mod) != held))).collect()
    truth = {i: y for i, _, y in rows}
    test = [r for r in got if zlib.crc32(str(r.doc_id).encode()) % mod == held]
    return sum(r.predicted == truth[r.doc_id] for r in test) / len(test), got


def test_quality_held_out(spark):
    def make(rng, i):
        bad = rng.random() < 0.3
        lines = [prose(rng, 12).capitalize() + "." for _ in range(4)]
        if bad:
            lines[1:] = [" | ".join(prose(rng, 1) for _ in range(15)) if i % 2 else " ".join(w.upper() + "!!" for w in prose(rng, 15).split()) for _ in range(3)]
        return "\n".join(lines), int(not bad)

    score, got = accuracy(spark, labelled(random.Random(1), make), None, quality.train, quality.predict, 5, 0, "quality", None)
    assert score > 0.97 and all(0 <= r.score <= 1 for r in got)


def test_line_marginals_match_enumeration():
    rng = np.random.default_rng(0)
    doc = np.array([0, 0, 0, 1, 2, 2])
    score, trans = rng.normal(size=6), rng.normal(size=(2, 2))
    good, _, log_z = quality.marginals(score, trans, quality.Chains(doc))
    for d in range(3):
        at = np.flatnonzero(doc == d)
        total, part = 0.0, np.zeros(len(at))
        for bits in np.ndindex(*[2] * len(at)):
            w = np.exp(sum(score[a] * b for a, b in zip(at, bits, strict=True)) + sum(trans[x, y] for x, y in zip(bits, bits[1:], strict=False)))
            total += w
            part += w * np.array(bits)
        assert np.allclose(good[at], part / total) and np.isclose(log_z[d], np.log(total))


def test_toxicity_held_out_and_misspelt(spark):
    bad_words = ["frobnitz", "grumblox", "snarfwit"]

    def make(rng, i):
        words = prose(rng, 60).split()
        bad = rng.random() < 0.25
        for w in rng.sample(bad_words, 3) if bad else ():
            words.insert(rng.randrange(len(words)), w)
        return " ".join(words), int(bad)

    rows = labelled(random.Random(2), make)
    score, got = accuracy(spark, rows, None, toxicity.train, toxicity.predict, 3, 1, "toxic", None)
    assert score > 0.95
    docs = spark.createDataFrame([(i, t) for i, t, _ in rows], "doc_id long, text string")
    model = toxicity.train(docs, spark.createDataFrame([(i, y) for i, _, y in rows], "doc_id long, toxic int"))
    folded = model.folded()
    z = model.pooled(raw_texts(__import__("pyarrow").array([prose(random.Random(5), 60), prose(random.Random(5), 60) + " frobnitzz grumbloxx snarfwitt"])), folded)
    assert z[1] > z[0] + 0.5


def test_long_text_costs_the_sample_itself_alone(spark):
    rng = random.Random(11)
    rows = [(i, f"{prose(rng, 30)} {'frobnitz grumblox' if i % 3 == 0 else 'mild'} {prose(rng, 30)}", int(i % 3 == 0)) for i in range(1, 241)]
    # The first text in hash order is longer than the whole budget.
    tails = spark.range(2000).select("id", F.xxhash64(F.lit(0).cast("long"), F.concat(F.lit("long " * 40_000), F.col("id").cast("string"))).alias("h"))
    rows.append((0, "long " * 40_000 + str(tails.orderBy("h").first().id), 0))
    docs = spark.createDataFrame([(i, t) for i, t, _ in rows], "doc_id long, text string")
    labels = spark.createDataFrame([(i, y, 1 - y) for i, _, y in rows], "doc_id long, toxic int, quality int")
    for column in ("toxic", "quality"):
        kept = quality.labelled(docs, labels, column, (900, 900), 160_000)
        assert len(kept) == 240 and sum(len(t.encode()) for _, t in kept) <= 160_000
    got = toxicity.predict(docs, toxicity.train(docs, labels, max_bytes=160_000)).collect()
    assert sum(r.predicted == (r.doc_id % 3 == 0 and r.doc_id > 0) for r in got) >= 239
    short = spark.createDataFrame([(1, "a b c"), (2, "d " * 900), (3, "e " * 900)], "doc_id long, text string")
    known = spark.createDataFrame([(1, 0, 0), (2, 1, 1), (3, 1, 1)], "doc_id long, toxic int, quality int")
    for train in (toxicity.train, quality.train):
        with pytest.raises(ValueError, match="= 1 fits"):
            train(short, known, max_bytes=1000)


def test_language_held_out(spark):
    kinds = {"aa": "lor mip sunt dol quam", "bb": "straß über grün schön fünf", "cc": "niño año más señal según"}
    rng = random.Random(3)
    rows = [(i, (lang := rng.choice(list(kinds))), " ".join(rng.choices(kinds[lang].split(), k=40))) for i in range(240)]
    docs = spark.createDataFrame(rows, "doc_id long, lang string, text string")
    model = langid.train(docs.filter(fold("doc_id", 4) != 2))
    truth = {i: lang for i, lang, _ in rows}
    got = langid.predict(docs.filter(fold("doc_id", 4) == 2).select("doc_id", "text"), model).collect()
    assert len(got) > 30 and all(r.lang_pred == truth[r.doc_id] for r in got)
    odd = spark.createDataFrame([(1, None), (2, "123 !"), (3, "")], "doc_id long, text string")
    assert {r.lang_pred for r in langid.predict(odd, model).collect()} == {"und"}


def test_every_language_is_learned(spark):
    rows = [(i, f"l{i % 70:02}", f"{chr(0x4E00 + i % 70) * 3} word") for i in range(140)] + [(900, "rare", "quux " * 9)]
    model = langid.train(spark.createDataFrame(rows, "doc_id long, lang string, text string"), windows_per_doc=1)
    assert model.langs == sorted({r[1] for r in rows})


def test_cnn_tables_match_filters():
    model = langid.ByteCnn(["a", "b"])
    classes, _, _ = langid.windows(raw_texts(__import__("pyarrow").array(["Hello wörld " * 40])), 64)
    z, _ = model.pool(classes)
    logit = np.tanh(z) @ model.weight + model.bias
    prob = np.exp(logit - logit.max(1, keepdims=True))
    assert np.allclose(model.probabilities(classes, model.tables()), prob / prob.sum(1, keepdims=True), atol=1e-5)


# ---------------------------------------------------------------- 2: personal data

BASE = {"email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", "ip": r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", "card": r"[0-9]([\x20-]?[0-9])+", "phone": r"\+[0-9][\x20().0-9-]+[0-9]"}


def luhn(d):
    s = 0
    for i, c in enumerate(reversed(d), 1):
        x = int(c) * (2 if i % 2 == 0 else 1)
        s += x - 9 if x > 9 else x
    return s % 10 == 0


def base_spans(text):
    out = []
    for o, kind in enumerate(BASE):
        for m in re.finditer(BASE[kind], text):
            d = re.sub("[^0-9]", "", m[0])
            bad = (kind == "ip" and any(int(x) > 255 for x in m[0].split("."))) or (kind == "card" and not (14 <= len(d) <= 19 and luhn(d))) or (kind == "phone" and not 10 <= len(d) <= 15)
            if not bad:
                out.append((m.start(), o, f"{kind}:{m.start()}:{m.end()}"))
    return ",".join(x[2] for x in sorted(out))


def test_pii_base_spans_on_random_strings(spark):
    rng = random.Random(4)
    parts = [*"ab.@-_+%1234567890 ().é中\n", "4111 1111 1111 1111", "+1 (555) 123-4567", "a@b.co", "1.2.3.4", "256.1.1.1", "..", "@", "378282246310005"]
    rows = [(i, "".join(rng.choice(parts) for _ in range(rng.randint(1, 40)))) for i in range(1500)]
    for r in pii.report(spark.createDataFrame(rows, "doc_id long, text string").repartition(4)).collect():
        want = base_spans(rows[r.doc_id][1])
        assert r.base_sha256 == hashlib.sha256(want.encode()).hexdigest()
        assert r.n_email + r.n_ip + r.n_card + r.n_phone == (want.count(",") + 1 if want else 0)


def test_pii_disclosing_term(spark):
    rows = [(i, f"call zorblax {w} now {w} a0@b.co {v} or") for i, (w, v) in enumerate(zip(["uno", "dos", "tres", "four", "five"], ["red", "blue", "pink", "grey", "teal"], strict=True))]
    rows += [(100 + i, f"call common words {i} mail uno") for i in range(40)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    got = {r.doc_id: r for r in pii.report(docs).collect()}
    assert all(got[i].spans.startswith("term:5:12,email:") for i in range(5))
    assert all(got[100 + i].spans == "" for i in range(40))
    text = {r.doc_id: r.text for r in pii.sanitise(docs).collect()}
    assert text[0] == "call  uno now uno <EMAIL> red or" and text[100] == rows[5][1]


def test_pii_terms_in_constant_frames_and_copies(spark):
    rng = random.Random(9)
    frame = [f"{prose(rng, 8)}\ncontact Zorblax at a@b.co today" for _ in range(6)]
    # Far from its address; one of its four texts stands 100 times.
    far = [f"Quuxley {prose(rng, 90)}\nmail c@d.org" for _ in range(4)]
    page = ["Only Copied Pagewords e@f.net"] * 20  # one text, so no support
    rest = [prose(rng, 30) + " contact today mail" for _ in range(300)]
    texts = frame + far + far[:1] * 99 + page + rest
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(4)
    for r in pii.sanitise(docs).collect():
        before = texts[r.doc_id]
        want = before.replace("Zorblax", "").replace("Quuxley", "")
        for address in ("a@b.co", "c@d.org", "e@f.net"):
            want = want.replace(address, "<EMAIL>")
        assert r.text == want


# ---------------------------------------------------------------- 3: set join

def brute_components(sets, percent):
    parent = {i: i for i in sets}

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    ids = sorted(sets)
    for k, a in enumerate(ids):
        for b in ids[:k]:
            both = len(sets[a] & sets[b])
            if both and 100 * both >= percent * (len(sets[a]) + len(sets[b]) - both):
                x, y = find(a), find(b)
                parent[max(x, y)] = min(x, y)
    return {i: find(i) for i in ids}


@pytest.mark.parametrize("rare", [2, 16])
def test_set_join_matches_brute_force(spark, rare):
    rng = random.Random(6)
    passage = prose(rng, 40)
    rows = []
    for g in range(12):
        base = prose(rng, rng.choice([5, 9, 30, 120, 300])).split()
        for _ in range(rng.choice([1, 2, 6, 25])):
            words = list(base)
            for _ in range(rng.choice([0, 0, 1, 2, 4, 8])):
                words[rng.randrange(len(words))] = f"w{rng.random()}"
            rows.append(" ".join(words))
    rows += [passage + " " + prose(rng, rng.choice([3, 8, 60])) for _ in range(30)] + [passage] * 5 + ["", "one two", "ONE two", "a b c d"]
    rng.shuffle(rows)
    docs = spark.createDataFrame(list(enumerate(rows)), "doc_id long, text string")
    got = {r.doc_id: r for r in jaccard.similar_classes(docs, rare=rare).collect()}
    sets = {}
    for i, t in enumerate(rows):
        w = t.lower().split()
        sets[i] = {tuple(w[k : k + 4]) for k in range(max(1, len(w) - 3))} if w else set()
    want = brute_components(sets, 85)
    assert {i: (r.n_shingles, r.component_id) for i, r in got.items()} == {i: (len(sets[i]), want[i]) for i in sets}


@pytest.mark.parametrize("rare", [1, 16])
def test_set_join_of_small_sets(spark, rare):
    """Sets of four and five shingles can be similar at 0.8."""
    rng = random.Random(8)
    rows = []
    for _ in range(25):
        words = prose(rng, rng.choice([8, 9, 10, 11])).split()
        rows += [" ".join(words), " ".join([*words, "more"]), " ".join(words[1:])]
    docs = spark.createDataFrame(list(enumerate(rows)), "doc_id long, text string")
    got = {r.doc_id: r.component_id for r in jaccard.similar_classes(docs, 5, 80, rare).collect()}
    sets = {i: {tuple(t.split()[k : k + 5]) for k in range(len(t.split()) - 4)} for i, t in enumerate(rows)}
    assert got == brute_components(sets, 80) and len(set(got.values())) < 50


def test_components_of_chains_and_hubs(spark):
    links = [(i, i + 1) for i in range(300)] + [(1000, 1000 + i) for i in range(1, 200)] + [(5000, 4999), (4999, 5000)]
    got = {r.node: r.component for r in components.components(spark.createDataFrame(links, "a long, b long")).collect()}
    assert got == {**{i: 0 for i in range(301)}, **{1000 + i: 1000 for i in range(200)}, 4999: 4999, 5000: 4999}


# ---------------------------------------------------------------- 4: vectors

def test_vectors_match_brute_force(spark):
    rng = np.random.default_rng(7)
    base = rng.normal(size=(300, 16))
    x = np.concatenate([base, base[:80] + rng.normal(scale=0.08, size=(80, 16)), np.repeat(base[:3], 20, 0) + rng.normal(scale=0.02, size=(60, 16)), base[:5]]).astype(np.float32)
    label = np.concatenate([np.arange(300) % 3, np.arange(80) % 3, np.repeat(np.arange(3), 20), np.arange(5) % 3])
    rows = [(i, [float(v) for v in x[i]], int(label[i])) for i in range(len(x))]
    got = {r.vec_id: r for r in embeddings.near_duplicates(spark.createDataFrame(rows, "vec_id long, embedding array<float>, label int"), block=16).collect()}
    n = np.linalg.norm(x.astype(float), axis=1)
    near = (x.astype(float) @ x.astype(float).T / np.outer(n, n) >= 0.93) & (label[:, None] == label[None, :])
    np.fill_diagonal(near, False)
    found, true = sum(r.n_links for r in got.values()), int(near.sum())
    assert 0.97 * true <= found <= true and all(got[i].n_links <= near[i].sum() for i in range(len(x)))


# ---------------------------------------------------------------- 5, 6: mixing and sharding

def test_raking_meets_all_marginals():
    rng = np.random.default_rng(8)
    index = {d: rng.integers(0, k, 60) for d, k in (("source", 5), ("lang", 3), ("topic", 4))}
    tokens = rng.integers(1, 1000, 60).astype(float)
    targets = {d: mixing.tempered(np.bincount(at, tokens, minlength=at.max() + 1), 0.5) for d, at in index.items()}
    weight = mixing.rake(tokens, index, targets)
    for d, at in index.items():
        got = np.bincount(at, weight * tokens, minlength=at.max() + 1)
        assert np.allclose(got / got.sum(), targets[d], atol=1e-6)


def test_sample_moves_shares_to_targets(spark):
    rows = [(i, "s0" if i % 10 < 7 else "s1", "en", "some words in a row " * 5) for i in range(4000)]
    got = mixing.sample(spark.createDataFrame(rows, "doc_id long, source string, lang string, text string"), targets={"source": {"s0": 0.5, "s1": 0.5}})
    n = collections.Counter(r.source for r in got.collect())
    assert abs(n["s0"] / (n["s0"] + n["s1"]) - 0.5) < 0.04 and n["s1"] == 1200


def test_every_source_is_raked_wherever_the_cells_are(spark):
    # Every host has both languages in one proportion, so that few rounds meet the targets.
    rows = [(i, f"host{i % 1200}", "de" if i >= 1200 else "en", "word " * (3 + (i % 1200 < 1100) * 9) * (1 + i // 1200)) for i in range(2400)]
    strata = mixing.with_strata(spark.createDataFrame(rows, "doc_id long, source string, lang string, text string")).localCheckpoint()
    cells = lambda targets, most: {(r[0], r[1], r[2]): r["__weight"] for r in mixing.probabilities(strata, mixing.TEMPERATURE, targets, most).collect()}
    assert len({k[0] for k in cells(None, 10**6)}) == 1200
    targets = {"source": {"host7": 0.25, "host1150": 0.75}}
    near, far = cells(targets, 10**6), cells(targets, 0)
    assert near.keys() == far.keys() and all(np.allclose(near[k], far[k], rtol=1e-6, atol=1e-12) for k in near)
    tokens = collections.Counter()
    for source, lang, topic, n in strata.groupBy(*mixing.CELL).sum("__tokens").collect():
        tokens[source] += near[source, lang, topic] * n
    assert tokens["host1150"] / sum(tokens.values()) == pytest.approx(0.75, abs=1e-6)


def test_shards_have_the_least_capacity(spark):
    rng = random.Random(9)
    texts = [prose(rng, rng.randint(1, 60)) for _ in range(300)] + ["copy of one text " * 30] * 25
    rows = [(i, t) for i, t in enumerate(texts)]
    got = sharding.shard(spark.createDataFrame(rows, "doc_id long, text string"), n_shards=7).collect()
    by = collections.defaultdict(list)
    for r in got:
        by[r.shard].append(r)
        assert r.size == len(texts[r.doc_id].encode()) + 16 and r.text_crc32 == zlib.crc32(texts[r.doc_id].encode())
    assert all(sorted(r.slot for r in rows) == list(range(len(rows))) for rows in by.values())
    copies = {r.shard for r in got if r.doc_id >= 300}
    assert len(copies) == 1 and {r.doc_id for r in by[copies.pop()]} == set(range(300, 325))
    sums = sorted(sum(r.size for r in rows) for rows in by.values())
    assert len(sums) == 7 and sums[-2] < 1.2 * (sum(sums[:-1]) / 6)


@pytest.mark.parametrize("seed", range(6))
def test_shard_plan_is_the_least_and_keeps_to_its_number(seed):
    """Random groups, many of them larger than an even share: never more shards than asked for."""
    rng = np.random.default_rng(seed)
    n, shards = int(rng.integers(1, 120)), int(rng.integers(1, 41))
    size = np.where(rng.random(n) < 0.3, rng.integers(1000, 9000, n), rng.integers(16, 400, n))
    key = np.sort(rng.choice(10**9, n, replace=False))
    split, alone, cuts = sharding.plan_step(sharding.Segments(key, size, np.ones(n, bool), np.full(n, 64)), shards)
    assert not split.any() and len(alone) + len(cuts) + (len(alone) < n) <= shards
    rest = ~np.isin(key, alone)
    sums = np.bincount(np.searchsorted(cuts, key[rest], "right"), size[rest]) if rest.any() else np.zeros(1)
    prefix = np.concatenate([[0], np.cumsum(size[rest])])
    tighter = sharding.greedy(prefix, int(sums.max()) - 1) if rest.any() else None
    assert tighter is None or len(tighter) > shards - len(alone)


# ---------------------------------------------------------------- 7: tokens

@pytest.fixture(scope="module")
def coder():
    import public_tokenizers as P
    import regex
    import tiktoken

    ranks = bpe.RankTable.read(P.path("byte_bpe_50k.tiktoken"))
    own = tiktoken.Encoding("own", pat_str=P.PATTERN, mergeable_ranks=ranks.ranks, special_tokens={})
    return bpe.Encoder(ranks, regex.compile(P.PATTERN)), own


@settings(max_examples=300, deadline=None)
@given(st.one_of(st.text(), st.text("ab", max_size=300), st.text("thein g\n", max_size=300), st.text("é中 \U0001f600a", max_size=80)))
def test_tokens_equal_the_library(coder, text):
    encoder, library = coder
    got = encoder.document(text)
    assert [int(x) for g in got for x in g[0].split()] == library.encode_ordinary(text)
    assert b"".join(g[2] for g in got).decode() == text


# ---------------------------------------------------------------- 10: fingerprints

def test_fingerprints_follow_edits(spark):
    rng = random.Random(10)
    texts = [prose(rng, rng.choice([30, 200, 900])) for _ in range(60)]
    rows = [(i * 3, t) for i, t in enumerate(texts)] + [(500, ""), (501, texts[0])]
    got = {r.doc_id: r for r in fingerprint.fingerprint_edits(spark.createDataFrame(rows, "doc_id long, text string").repartition(3)).collect()}
    order = sorted(rows, reverse=True)
    for (i, t), (_, following) in zip(order, [*order[1:], order[0]], strict=True):
        k = len(t) // 3
        assert got[i].n_chars == len(t)
        assert got[i].edited_sha256 == hashlib.sha256((t[: len(t) - k] + following[:k]).encode()).hexdigest()
    assert got[0].fingerprint == got[501].fingerprint
    near = [got[i].near_edited for i, t in rows if t]
    far = [got[i].near_next for i, t in rows if t and i != 3]
    assert min(near) > 0.15 and sum(near) / len(near) > 0.55 and sum(far) / len(far) < 0.2
    a, b = (fingerprint.fingerprints(raw_texts(__import__("pyarrow").array([t])))[0][None, :] for t in (texts[3], "new words " + texts[3]))
    assert fingerprint.likeness(a, b)[0] > 0.6
