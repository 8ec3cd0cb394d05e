"""Toxicity by subword-bag embeddings averaged into a linear softmax.

A word is the bag of its byte n-grams (widths 3 to 6, with word boundaries) and of itself, each
hashed to a row of an embedding table; its vector is the bag's mean. A document's vector is the average
of its words' vectors, and a linear softmax reads it. In a plain average one toxic word of thousands
drowns, so a word's weight is 1 / ``top`` if it is among the document's ``top`` words of largest toxic
log-odds under that same softmax, else 0. Table and softmax are trained jointly in numpy on a bounded
sample of labelled documents: first on words, as labelled by how many documents of each kind hold them, then
on whole documents through the weighted average. An unseen misspelling shares the vectors of the n-grams
that it keeps.

Since the model is linear after the mean, scoring folds every embedding row into one number, and the
whole text costs one lookup an n-gram.

Defined results: a text without words (null, empty, white space) scores as the least toxic word would,
near 0; words of equal odds weigh alike, of the last ones among the ``top`` any may count, with the same
result; equal texts have equal scores; repeated rows give rows of their own; without labelled documents of
both kinds every score is 0; columns named like an added one are replaced; empty tables give no rows. A text
of any length goes through in one run of its n-grams.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import Texts, fold, give_back, mix64, per_document, pieces, raw_texts, table
from .quality import labelled

WIDTHS = (3, 4, 5, 6)
BITS = 18

# Letters are lower-cased; white space and sentence marks bound words; all else belongs to them.
_FOLD = np.arange(256, dtype=np.uint64)
_FOLD[65:91] += np.uint64(32)
_FOLD[[ord(c) for c in "\t\n\v\f\r .,;:?\"()[]{}|<>"]] = 32


def word_grams(texts: Texts):
    """(bucket of each n-gram, its word, document of each word, 64-bit hash of each word).

    The stream is cut before every boundary byte; a piece is one word with the boundary before it,
    and its n-grams may also take in the boundary after it.
    """
    n_docs = len(texts)
    length = np.diff(texts.offsets)
    # One boundary before each document and one at the end.
    shift = np.arange(n_docs)
    stream = np.full(len(texts.data) + n_docs + 1, 32, np.uint64)
    place = np.arange(len(texts.data)) + np.repeat(shift, length) + 1
    stream[place] = _FOLD[texts.data]
    doc_at = texts.offsets[:-1] + shift
    cut = np.flatnonzero(stream == 32)
    piece = np.cumsum(stream == 32) - 1
    nxt = np.append(cut[1:], len(stream))[piece]
    full = np.diff(np.append(cut, len(stream))) > 1  # pieces with a word
    number = np.cumsum(full) - 1
    doc = np.searchsorted(doc_at, cut[full], "right") - 1
    buckets, words = [], []
    n = len(stream)
    h = stream * np.uint64(0x9E3779B97F4A7C15)
    for w in range(2, max(WIDTHS) + 1):
        h = (h[:-1] ^ (h[:-1] >> np.uint64(29))) * np.uint64(0xBF58476D1CE4E5B9) + stream[w - 1 :] * np.uint64(0x9E3779B97F4A7C15)
        if w in WIDTHS:
            at = np.flatnonzero(np.arange(n - w + 1) + (w - 1) <= nxt[: n - w + 1])
            buckets.append((mix64(h[at]) >> np.uint64(64 - BITS)).astype(np.int32))
            words.append(number[piece[at]])
    # The word itself: an order-aware sum over its bytes.
    inside = np.arange(n) - cut[piece]
    total = np.add.reduceat(mix64(stream * np.uint64(0xD1B54A32D192ED03) + inside.astype(np.uint64)), cut) if len(cut) else np.zeros(0, np.uint64)
    whole = mix64(total[full])
    buckets.append((whole >> np.uint64(64 - BITS)).astype(np.int32))
    words.append(np.arange(len(whole)))
    return np.concatenate(buckets), np.concatenate(words), doc, whole


class SubwordSoftmax:
    def __init__(self, dim: int = 8, top: int = 4, seed: int = 5):
        rng = np.random.default_rng(seed)
        self.embed = rng.uniform(-1 / dim, 1 / dim, (1 << BITS, dim))
        self.weight, self.bias, self.top = np.zeros((dim, 2)), np.zeros(2), top
    def fit(self, bucket, word, mass, epochs: int = 6, batch: int = 4096, rate: float = 0.2, seed: int = 3):
        """``bucket``, ``word``: n-grams in order of their word. ``mass`` [words, 2]: how many clean and toxic documents hold the word. Adagrad, soft labels.

        The table and the softmax move together; a word weighs by the root of how many documents hold it.
        """
        rng = np.random.default_rng(seed)
        begin = np.searchsorted(word, np.arange(len(mass) + 1))
        grown_e, grown_w, grown_b = np.full_like(self.embed, 1e-4), np.full_like(self.weight, 1e-4), np.full(2, 1e-4)
        use = np.flatnonzero(mass.sum(1) > 0)
        self.weight += rng.normal(0, 0.1, self.weight.shape)
        for epoch in range(epochs):
            now = rate * (1 - epoch / epochs)
            for part in np.array_split(rng.permutation(use), max(1, len(use) // batch)):
                count = begin[part + 1] - begin[part]
                row = np.repeat(np.arange(len(part)), count)
                at = np.repeat(begin[part] - np.append(0, np.cumsum(count)[:-1]), count) + np.arange(count.sum())
                rows = bucket[at]
                mean = np.stack([np.bincount(row, self.embed[rows, d], minlength=len(part)) for d in range(self.embed.shape[1])], 1) / count[:, None]
                logit = mean @ self.weight + self.bias
                prob = np.exp(logit - logit.max(1, keepdims=True))
                prob /= prob.sum(1, keepdims=True)
                heavy = mass[part].sum(1)
                grad = (prob - mass[part] / heavy[:, None]) * np.sqrt(heavy)[:, None]
                back = (grad @ self.weight.T) / count[:, None]
                g_w, g_b = mean.T @ grad / len(part), grad.mean(0)
                uniq, where = np.unique(rows, return_inverse=True)
                g_e = np.stack([np.bincount(where, back[row, d], minlength=len(uniq)) for d in range(self.embed.shape[1])], 1)
                grown_e[uniq] += g_e * g_e
                self.embed[uniq] -= now * g_e / np.sqrt(grown_e[uniq])
                grown_w += g_w * g_w
                grown_b += g_b * g_b
                self.weight -= now * g_w / np.sqrt(grown_w)
                self.bias -= now * g_b / np.sqrt(grown_b)
        return self

    def folded(self) -> np.ndarray:
        """Every bucket's share of the toxic log-odds."""
        return (self.embed @ (self.weight[:, 1] - self.weight[:, 0])).astype(np.float32)

    def pooled(self, texts: Texts, folded: np.ndarray) -> np.ndarray:
        """Every document's toxic log-odds: the softmax's input, as it is linear in the average."""
        bucket, word, doc, _ = word_grams(texts)
        n = len(doc)
        odds = np.bincount(word, folded[bucket], minlength=n) / np.maximum(np.bincount(word, minlength=n), 1)
        head, weight = heaviest(odds, doc, self.top)
        own = doc[head]
        total = np.bincount(own, weight * odds[head], minlength=len(texts))
        wordless = np.bincount(own, minlength=len(texts)) == 0
        return np.where(wordless, FLOOR, total) + self.bias[1] - self.bias[0]

    def rescale(self, z: np.ndarray, label: np.ndarray, steps: int = 2000):
        """Stretches the softmax to documents: the scale and bias of a logistic curve over their log-odds ``z``."""
        mean, spread = z.mean(), max(z.std(), 1e-9)
        x = (z - mean) / spread
        a, b = 1.0, 0.0
        for _ in range(steps):
            p = 1 / (1 + np.exp(-(a * x + b)))
            a -= 0.5 * ((p - label) * x).mean()
            b -= 0.5 * (p - label).mean()
        self.weight *= max(a, 1e-3) / spread
        odds = b - max(a, 1e-3) * mean / spread
        self.bias[:] = -odds / 2, odds / 2

    def fit_documents(self, bucket, word, held, label, epochs: int = 4, rate: float = 0.01):
        """Joint training on documents. ``bucket``, ``word``: n-grams in order of their kind of word; ``held``: (document, kind)."""
        doc, kind = held
        n_words, n_docs = int(word.max()) + 1, len(label)
        begin = np.searchsorted(word, np.arange(n_words + 1))
        size = np.diff(begin)
        target = np.eye(2)[label]
        grown_e, grown_w, grown_b = np.full_like(self.embed, 1e-4), np.full_like(self.weight, 1e-4), np.full(2, 1e-4)
        odds = np.bincount(word, self.folded()[bucket], minlength=n_words) / np.maximum(size, 1)
        head, share = heaviest(odds[kind], doc, self.top)
        self.rescale(np.bincount(doc[head], share * odds[kind[head]], minlength=n_docs), label)
        for epoch in range(epochs):
            now = rate * (1 - epoch / epochs)
            odds = np.bincount(word, self.folded()[bucket], minlength=n_words) / np.maximum(size, 1)
            head, share = heaviest(odds[kind], doc, self.top)
            own, of = doc[head], kind[head]
            used, where = np.unique(of, return_inverse=True)
            count = size[used]
            row = np.repeat(np.arange(len(used)), count)
            rows = bucket[np.repeat(begin[used] - np.append(0, np.cumsum(count)[:-1]), count) + np.arange(count.sum())]
            dims = range(self.embed.shape[1])
            vector = np.stack([np.bincount(row, self.embed[rows, d], minlength=len(used)) for d in dims], 1) / count[:, None]
            mean = np.stack([np.bincount(own, share * vector[where, d], minlength=n_docs) for d in dims], 1)
            logit = mean @ self.weight + self.bias
            prob = np.exp(logit - logit.max(1, keepdims=True))
            prob /= prob.sum(1, keepdims=True)
            grad = prob - target
            back = grad @ self.weight.T
            to_word = np.stack([np.bincount(where, share * back[own, d], minlength=len(used)) for d in dims], 1) / count[:, None]
            uniq, at = np.unique(rows, return_inverse=True)
            g_e = np.stack([np.bincount(at, to_word[row, d], minlength=len(uniq)) for d in dims], 1)
            g_w, g_b = mean.T @ grad / n_docs, grad.mean(0)
            grown_e[uniq] += g_e * g_e
            self.embed[uniq] -= now * g_e / np.sqrt(grown_e[uniq])
            grown_w += g_w * g_w
            grown_b += g_b * g_b
            self.weight -= now * g_w / np.sqrt(grown_w)
            self.bias -= now * g_b / np.sqrt(grown_b)
        return self


FLOOR = -6.0


def heaviest(odds: np.ndarray, doc: np.ndarray, top: int) -> tuple[np.ndarray, np.ndarray]:
    """(places of each document's ``top`` words of largest odds, their weights in the document's average)."""
    by = np.lexsort((-odds, doc))
    rank = np.arange(len(by)) - np.searchsorted(doc[by], doc[by])
    head = by[rank < top]
    return head, np.full(len(head), 1 / top)


def train(docs: DataFrame, labels: DataFrame, column: str = "toxic", per_class: tuple[int, int] = (2400, 900), max_bytes: int = 12 << 20) -> SubwordSoftmax | None:
    """Learns from the rows of ``labels`` given; bounded by sum(per_class) documents and ``max_bytes`` of text."""
    rows = labelled(docs, labels, column, per_class, max_bytes)
    if len({y for y, _ in rows}) < 2:
        return None
    texts, label = raw_texts(pa.array([t for _, t in rows])), np.array([y for y, _ in rows])
    kinds, holds, grams, holder, held_kind = [], [], [], [], []
    n_kinds = 0
    for i, _, part in pieces(texts, 1 << 19):
        bucket, word, doc, whole = word_grams(part)
        own, first, at = np.unique(whole, return_index=True, return_inverse=True)
        once = np.unique(at * len(part) + doc)  # a document counts a word once
        held = np.zeros((len(own), 2))
        np.add.at(held, (once // len(part), label[i + once % len(part)]), 1.0)
        holder.append((i + once % len(part)).astype(np.int32))
        held_kind.append((n_kinds + once // len(part)).astype(np.int32))
        n_kinds += len(own)
        chosen = np.zeros(len(whole), bool)
        chosen[first] = True
        keep = chosen[word]
        grams.append((bucket[keep], at[word[keep]].astype(np.int32)))
        kinds.append(own)
        holds.append(held)
    shift = np.cumsum([0, *map(len, kinds)])
    all_kinds, first, at = np.unique(np.concatenate(kinds), return_index=True, return_inverse=True)
    mass = np.zeros((len(all_kinds), 2))
    np.add.at(mass, at, np.concatenate(holds))
    mass /= np.bincount(label, minlength=2) / len(label) * 2  # as if both classes were equally common
    bucket = np.concatenate([b for b, _ in grams])
    word = np.concatenate([w + np.int32(s) for (_, w), s in zip(grams, shift[:-1], strict=True)])
    del grams, kinds, holds
    chosen = np.zeros(len(at), bool)
    chosen[first] = True
    keep = chosen[word]
    bucket, word = bucket[keep], at[word[keep]].astype(np.int32)
    by = np.argsort(word, kind="stable")
    bucket, word = bucket[by], word[by]  # n-grams of a word stand together
    held = np.concatenate(holder), at[np.concatenate(held_kind)]
    del keep, by, chosen, at, first, holder, held_kind
    give_back()
    model = SubwordSoftmax().fit(bucket, word, mass)
    return model.fit_documents(bucket, word, held, label)


def predict(docs: DataFrame, model: SubwordSoftmax | None, threshold: float = 0.7) -> DataFrame:
    """Adds ``score`` and ``predicted``; ``text`` is dropped, other columns pass through."""
    if model is None:
        return docs.drop("text").withColumns({"score": F.lit(0.0), "predicted": F.lit(0)})
    folded = model.folded()
    reader = SubwordSoftmax.__new__(SubwordSoftmax)  # executors need the folded table, not the embeddings
    reader.bias, reader.top = model.bias, model.top

    def score(texts: Texts) -> dict:
        p = 1 / (1 + np.exp(-np.clip(reader.pooled(texts, folded), -60, 60)))
        return {"score": p, "predicted": (p >= threshold).astype(np.int32)}

    return per_document(docs, score, "score double, predicted int")


def op8_toxicity(spark, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    labels = table(spark, sf_dir, "labels").select("doc_id", "toxic").filter(fold("doc_id", 3) != 1)
    model = train(docs, labels)
    return predict(docs.select("doc_id", (fold("doc_id", 3) == 1).alias("held_out"), "text"), model)
