"""Huffman files of token ids: codes against enumeration, blocks and whole files as round trips."""

import itertools
import zlib

import numpy as np
import public_tokenizers
import pytest
from tokenizers import Tokenizer

from quillmill.llm import idfiles as I
from quillmill.llm.queries import QUERIES

PATH = public_tokenizers.path("byte_bpe_50k.json")


def plain_tokenizer():
    t = Tokenizer.from_file(PATH)
    t.encode_special_tokens = True
    return t


def best_cost(weights, limit):
    """The least cost of any prefix code with lengths up to ``limit``, by trying all that Kraft allows."""
    fits = (c for c in itertools.product(range(1, limit + 1), repeat=len(weights)) if sum(2.0**-x for x in c) <= 1)
    return min(sum(w * x for w, x in zip(weights, c, strict=True)) for c in fits)


@pytest.mark.parametrize(("weights", "limit"), [([1, 1, 2, 4, 8], 4), ([1, 1, 2, 4, 8], 3), ([5, 5, 5], 2), ([1, 100, 1, 1, 1], 3), ([7, 3], 1), ([1, 2, 3, 5, 8, 13], 4)])
def test_lengths_are_best_under_the_limit(weights, limit):
    lengths = I.code_lengths(np.array(weights), limit)
    assert lengths.max() <= limit and sum(2.0**-x for x in lengths) <= 1
    assert int((lengths * weights).sum()) == best_cost(weights, limit)


def test_codes_are_canonical_and_free_of_prefixes():
    book = I.Book.of(np.array([9, 4, 7, 300, 2]), np.array([1, 1, 2, 4, 8]))
    codes = [format(c, f"0{n}b") for c, n in zip(book.codes, book.lengths, strict=True)]
    assert codes == sorted(codes) and not any(a != b and b.startswith(a) for a in codes for b in codes)
    with pytest.raises(ValueError, match="don't fit"):
        I.code_lengths(np.ones(5, int), 2)


@pytest.mark.parametrize("n", [1, 2, I.STEP, I.STEP + 1, 5000])
def test_blocks_come_back(n):
    rng = np.random.default_rng(n)
    ids = np.minimum(rng.zipf(1.3, n), 60000)
    book = I.Book.of(*np.unique(ids, return_counts=True))
    codes, lengths = book.by_id()
    rows = {"doc_id": np.array([-3]), "null": np.array([False]), "start": np.array([5]), "skip": np.array([0]), "n": np.array([n]), "here": np.array([n])}
    data = I.block(rows, ids, codes, lengths)
    both = I.unpack([I.parse(data), I.parse(data)], book.table(), book.limit)
    assert all((b == ids).all() for b in both)
    assert I.parse(data)[1]["doc_id"].tolist() == [-3]


def test_checksums_join():
    a, b = b"some bytes here", bytes(range(256)) * 300
    assert I.crc_of_both(zlib.crc32(a), zlib.crc32(b), len(b)) == zlib.crc32(a + b)
    assert I.crc_of_both(zlib.crc32(a), zlib.crc32(b""), 0) == zlib.crc32(a)


TEXTS = [None, "", " ", "  ", "a", "a b", " a  b\n c \t d", "tab\t x  y　 z \x1c q\x1f w​ e", "don't  'll \n\n end ", "é à  ü\r\n", "<|endoftext|> and <|endoftext|>", "\U0001f600 \U0001f600", "x" * 3000, "word " * 20000, "12 3456  789", "  \u0085 a"]


def test_stretches_encode_as_the_whole_text():
    want = [e.ids for e in plain_tokenizer().encode_batch([t or "" for t in TEXTS], add_special_tokens=False)]
    got = I.Encoder(PATH).encode(TEXTS)
    assert [np.frombuffer(x, "<u4").tolist() for x in got] == want


def test_a_full_memory_changes_nothing(monkeypatch):
    monkeypatch.setattr(I, "CACHE", 3)
    held = I.Encoder(PATH)
    for _ in range(2):
        got = [np.frombuffer(x, "<u4").tolist() for t in TEXTS for x in held.encode([t])]
        assert got == [e.ids for e in plain_tokenizer().encode_batch([t or "" for t in TEXTS], add_special_tokens=False)]


def test_files_hold_every_document(spark, tmp_path):
    """Blocks smaller than documents, null and repeated ids, extra columns; starts follow doc_id."""
    rows = [(i, t, "x") for i, t in enumerate(TEXTS)] + [(4, "a", "x"), (4, "B", "x"), (None, "none", "x"), (-7, "least", "x")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, start string")
    folder = str(tmp_path / "ids")
    I.write_ids(docs, folder, PATH, size=700)
    encode = plain_tokenizer().encode
    want, start = [], 0
    for doc_id, text, _ in sorted(rows, key=lambda r: (r[0] is not None, r[0] or 0, r[1] is not None, r[1] or "")):
        ids = encode(text or "", add_special_tokens=False).ids + [I.END]
        want.append((doc_id, start, ids))
        start += len(ids)
    got = sorted(((r.doc_id, r.start, r.ids) for r in I.read_ids(spark, folder).collect()), key=lambda r: r[1])
    assert got == want
    digests = sorted(((r.doc_id, r.start, r.n_tokens, r.ids_crc32) for r in I.read_digests(spark, folder).collect()), key=lambda r: r[1])
    assert digests == [(d, s, len(x), zlib.crc32(np.array(x, "<u4").tobytes())) for d, s, x in want]
    held = spark.read.parquet(f"{folder}/blocks")
    assert {r.n_tokens for r in held.collect()} >= {700} and held.agg({"n_tokens": "sum"}).first()[0] == start


def test_query_equals_the_library(spark):
    sf = "/root/testdata/sf0.001"
    got = sorted(tuple(r) for r in QUERIES["op12_token_files"](spark, sf).select("doc_id", "start", "n_tokens", "ids_crc32").collect())
    docs = sorted((r.doc_id, r.text) for r in spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "text").collect())
    want, start = [], 0
    for (doc_id, _), e in zip(docs, plain_tokenizer().encode_batch([t or "" for _, t in docs], add_special_tokens=False), strict=True):
        want.append((doc_id, start, len(e.ids) + 1, zlib.crc32(np.array([*e.ids, I.END], "<u4").tobytes())))
        start += len(e.ids) + 1
    assert got == want


def test_new_words_go_to_the_model_together_and_stops_are_stretches_of_their_own():
    """The tokenizer itself, slow a word, is not asked for words; equal ids come back."""
    texts = ["A word, and (another) one.", "Ünïcödé straße!! next\nline.\n\nend", "a.b.c ... x., y_. 'tis", "it's 3.14, ok $$$\x01 ÿþ"]
    want = [np.array(e.ids, "<u4").tobytes() for e in plain_tokenizer().encode_batch(texts, add_special_tokens=False)]
    e = I.Encoder(PATH)
    assert e.encode(texts) == want
    assert I.Encoder.stretches("one, two. three")[1] == "," and {",", " one", " word"} <= set(e.known)
    asked = []

    class Asked:
        def encode_batch(self, part, **options):
            asked.extend(part)
            return plain_tokenizer().encode_batch(part, **options)

    words = I.Encoder(PATH)
    words.tokenizer = Asked()
    assert words.encode(["Some words, more words."] * 40) == [np.array(plain_tokenizer().encode("Some words, more words.").ids, "<u4").tobytes()] * 40
    assert sorted(asked) == [",", "."]
