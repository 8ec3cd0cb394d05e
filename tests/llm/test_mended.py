"""Cases that once broke: values are pinned."""

import random
import time
import tracemalloc
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from quillmill.llm import fingerprint, jaccard, langid, mixing, pii, toxicity
from quillmill.llm.common import Words, raw_texts


def test_many_numbers_in_one_text_cost_in_proportion(spark):
    text = ", ".join(f"10.{i % 250}.{i // 250 % 250}.7" for i in range(40_000))
    one = spark.createDataFrame([(1, text)], "doc_id long, text string")
    start = time.time()
    got = pii.report(one).first()
    assert got.n_ip == 40_000 and got.spans.startswith("ip:0:8,ip:10:18") and time.time() - start < 60
    clean = pii.sanitise(one).first().text
    assert clean == ", ".join(["<IP>"] * 40_000)


def test_clashing_columns_pass_sanitise_and_sample(spark):
    names = ["__k", "k", "pattern", "held", "__topic", "__tokens", "__source", "__weight", "__probability"]
    docs = spark.createDataFrame([(i, f"some words mail a{i}@b.co", "s", "en", *names) for i in range(4)], "doc_id long, text string, source string, lang string, " + ", ".join(f"`{n}` string" for n in names))
    for got in (pii.sanitise(docs), mixing.sample(docs)):
        assert got.columns == docs.columns
        rows = got.collect()
        assert len(rows) == 4 and all(list(r)[4:] == names for r in rows)


def test_terms_become_their_class_where_asked(spark):
    rng = random.Random(4)
    words = [f"w{a}{b}" for a in "abcdefgh" for b in "ijklmnop"]
    # Capitalised words stand everywhere, so their class says nothing.
    rows = [(i, f"Zorblax {' '.join(rng.sample(words, 6))} Plain a@b.co") for i in range(5)] + [(100 + i, f"Plain {' '.join(rng.sample(words, 8))} Other") for i in range(60)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    got = {r.doc_id: r.text for r in pii.sanitise(docs, generalise=True).collect()}
    assert all(got[i] == rows[i][1].replace("Zorblax", "<NAME>").replace("a@b.co", "<EMAIL>") for i in range(5))
    assert all(got[i] == t for i, t in rows if i >= 100)


def test_fingerprints_of_null_ids(spark):
    rows = [(None, "the sea of words"), (None, "a sky of stones and rain"), (None, None)]
    got = fingerprint.fingerprint_edits(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert sorted(r.n_chars for r in got) == [0, 16, 24]


def test_near_documents_are_verified(spark):
    rng = random.Random(5)
    text = [" ".join(rng.choice(["sea", "sky", "rain", "stone", "tree", "leaf", "bird"]) + str(rng.randrange(99)) for _ in range(150)) for _ in range(8)]
    rows = list(enumerate(text)) + [(20 + i, t[:400] + "x" + t[400:]) for i, t in enumerate(text)] + [(40, text[3]), (None, text[0]), (50, "")]
    got = {r.doc_id: r.component_id for r in fingerprint.near_documents(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert got == {**{i: i for i in range(8)}, **{20 + i: i for i in range(8)}, 40: 3, None: None, 50: 50}


def test_a_model_predicts_twice(spark):
    docs = spark.createDataFrame([(i, f"plain words here {'frobnitz' if i % 3 == 0 else 'calm'} {i}") for i in range(90)], "doc_id long, text string")
    labels = docs.select("doc_id", (F.col("doc_id") % 3 == 0).cast("int").alias("toxic"))
    model = toxicity.train(docs, labels)
    first, second = (sorted(map(tuple, toxicity.predict(docs, model).collect())) for _ in range(2))
    assert first == second and [r[2] for r in first] == [int(i % 3 == 0) for i in range(90)]


def test_added_columns_replace_their_names(spark):
    docs = spark.createDataFrame([(1, "abc", "x", "y")], "doc_id long, text string, Score string, lang_pred string")
    assert langid.predict(docs, langid.ByteCnn(["aa", "bb"])).columns == ["doc_id", "lang_pred", "score"]


def test_long_words_with_swapped_halves_differ():
    a, b = "a" * 65536, "b" * 65536
    assert len(np.unique(Words(raw_texts(pa.array([a + b, b + a])), lower=True).hash)) == 2


def test_contradictory_targets_are_told(spark):
    # Each source has one language, so both targets can't hold.
    rows = [(i, f"s{i % 2}", "en" if i % 2 else "de", "some words") for i in range(40)]
    docs = spark.createDataFrame(rows, "doc_id long, source string, lang string, text string")
    with pytest.raises(ValueError, match="can't all be met"):
        mixing.sample(docs, targets={"source": {"s0": 0.9, "s1": 0.1}, "lang": {"en": 0.9, "de": 0.1}})


def test_leaves_and_windows_are_merged_once(monkeypatch):
    """What recurs within pieces isn't merged again, long pieces aren't kept, and a full memory changes nothing."""
    import public_tokenizers as P
    import regex
    import tiktoken

    from quillmill.llm import bpe

    ranks = bpe.RankTable.read(P.path("byte_bpe_50k.tiktoken"))
    own = tiktoken.Encoding("own", pat_str=P.PATTERN, mergeable_ranks=ranks.ranks, special_tokens={})
    asked = []
    merge = ranks.merge
    monkeypatch.setattr(ranks, "merge", lambda data: asked.append(data) or merge(data))
    words = [f" {a}{b}{c}" for a in ("anble", "stti", "oftion") for b in ("thonre", "wherer", "") for c in ("nten", "thhe", "q" * 60)]
    text = "".join(words * 3) + " \n\n 123é中"
    monkeypatch.setattr(bpe, "CACHE", 1 << 18)
    assert bpe.Encoder(ranks, regex.compile(P.PATTERN)).digests(text)[3] == " ".join(map(str, own.encode_ordinary(text)))
    short = [d for d in asked if len(d) <= bpe.WINDOW]
    assert len(short) == len(set(short))
    monkeypatch.setattr(bpe, "CACHE", 3)
    small = bpe.Encoder(bpe.RankTable(ranks.ranks), regex.compile(P.PATTERN))
    for _ in range(2):
        assert small.digests(text)[3] == " ".join(map(str, own.encode_ordinary(text)))
    assert len(small.ranks.merged) <= 3


def test_stretches_are_remembered_from_one_task_to_the_next():
    """A worker's second task of the same texts encodes nothing anew, and a step among others leaves no memory taken."""
    import public_tokenizers as P

    from quillmill.llm import bpe

    assert bpe.GPT == P.PATTERN
    path, text = P.path("byte_bpe_50k.tiktoken"), "Anble thonre, sttiwherer. It's 3.14 é中 ok\nOftion thhe"
    first = bpe._encoder(path, P.PATTERN)
    want = first.digests(text)
    again = bpe._encoder(path, P.PATTERN)
    again.learn = None
    try:
        assert again is first and again.digests(text) == want
    finally:
        del again.learn
    pieces = first.find(text)
    assert "".join(first.cut(text)) == text and {"Anble", " thonre", ",", ".", "\n"} <= set(first.cut(text)) & set(pieces)
    few = bpe._encoder(path, P.PATTERN, bpe.FEW)
    assert few is not first and few.digests(text) == want
    few.forget()
    assert not few.known and not few.older and not few.ranks.merged


def test_a_bucket_is_counted_without_an_index_as_long_as_its_tokens():
    rng = np.random.default_rng(4)
    tokens, chunk = rng.integers(0, 3000, 4000, dtype=np.uint32) << np.uint32(20), rng.integers(0, 5, 4000).astype(np.uint32)
    held = Counter(tokens.tolist())
    want = sorted({(int(c), int(t), held[int(t)]) for t, c in zip(tokens, chunk, strict=True) if held[int(t)] > 1})
    got = jaccard.counted(tokens, chunk)
    assert [(int(c), int(t), int(n)) for t, c, n in zip(*got, strict=True)] == want
    assert [len(x) for x in jaccard.counted(tokens[:0], chunk[:0])] == [0, 0, 0]
    n = 1 << 20
    tokens, chunk = rng.integers(0, 1 << 32, n, dtype=np.uint32), np.repeat(np.arange(16, dtype=np.uint32), n // 16)
    tracemalloc.start()
    jaccard.counted(tokens, chunk)
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert peak < 30 * n
