"""Document quality by a linear-chain conditional random field over lines.

Every line is labelled good or bad. A line's emission score reads its own features and those of the
lines before and after it; neighbouring labels are tied by transition weights. Exact
forward-backward marginals, weighted by line length, aggregate into the document's quality, which a
one-dimensional logistic curve maps to a probability. The field is fitted in numpy by its
conditional likelihood on a bounded sample of labelled documents (``per_class`` of each label, ``max_bytes`` of text); each
of their lines carries its document's label.

Defined results: null and empty texts have one empty line; empty tables give no rows; without
labelled documents of both kinds every score is 0.5.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import Texts, Words, fold, per_document, raw_texts, table

# Byte classes: 0 lower, 1 upper, 2 digit, 3 white space, 4 sentence punctuation, 5 pipe, 6 other symbol, 7 high byte.
_KIND = np.full(256, 6, np.int64)
_KIND[97:123], _KIND[65:91], _KIND[48:58] = 0, 1, 2
_KIND[[9, 10, 11, 12, 13, 32]] = 3
_KIND[[ord(c) for c in ".,;:?'\"()-"]] = 4
_KIND[ord("|")] = 5
_KIND[128:] = 7
N_KINDS = 8


def line_features(texts: Texts):
    """(features [lines, k], document of each line, bytes of each line)."""
    data = texts.data
    newline = np.flatnonzero(data == 10) + 1
    begin = np.union1d(texts.offsets[:-1], newline[~np.isin(newline, texts.offsets)]) if len(newline) else texts.offsets[:-1].copy()
    # Empty documents share an offset with their neighbour; give each its own (empty) line.
    doc = np.searchsorted(texts.offsets, begin, "right") - 1
    empty = np.flatnonzero(np.diff(texts.offsets) == 0)
    real = begin < len(data)
    begin, doc = begin[real], doc[real]
    begin = np.concatenate([begin, texts.offsets[empty]])
    doc = np.concatenate([doc, empty])
    length = np.zeros(len(begin), np.int64)
    k = len(begin) - len(empty)
    length[:k] = np.diff(np.append(begin[:k], len(data)))
    order = np.argsort(doc, kind="stable")

    n = len(begin)
    of_byte = np.repeat(np.arange(k), length[:k])
    counts = np.zeros((n, N_KINDS))
    counts[:k] = np.bincount(of_byte * N_KINDS + _KIND[data], minlength=k * N_KINDS).reshape(k, N_KINDS) if k else 0
    words = Words(texts, lower=True)
    line = np.searchsorted(begin[:k], words.start, "right") - 1
    n_words = np.bincount(line, minlength=n).astype(float)
    same = np.zeros(len(line))
    if len(line) > 1:
        same[1:] = (words.hash[1:] == words.hash[:-1]) & (line[1:] == line[:-1])
    adjacent = np.bincount(line, same, minlength=n)
    by = np.lexsort((words.hash, line))
    fresh = np.ones(len(by))
    if len(by) > 1:
        fresh[1:] = (words.hash[by][1:] != words.hash[by][:-1]) | (line[by][1:] != line[by][:-1])
    distinct = np.bincount(line[by], fresh, minlength=n)
    size = np.maximum(counts.sum(1), 1)
    solid = np.maximum(size - counts[:, 3], 1)
    letters = np.maximum(counts[:, 0] + counts[:, 1] + counts[:, 7], 1)
    many = np.maximum(n_words, 1)
    feats = np.stack(
        [
            np.ones(n),
            counts[:, 1] / letters,
            counts[:, 2] / solid,
            counts[:, 4] / solid,
            counts[:, 5] / many,
            counts[:, 6] / solid,
            np.minimum(counts[:, 6] / many, 3),
            counts[:, 7] / solid,
            np.log1p(size) / 5,
            np.log1p(n_words) / 3,
            np.minimum(solid / many, 30) / 10,
            adjacent / many,
            1 - distinct / many,
            (n_words == 0).astype(float),
            (counts[:, 5] > 0).astype(float),
            (counts[:, 6] / many > 0.5).astype(float),
            (counts[:, 1] / letters > 0.6).astype(float),
        ],
        1,
    )
    return feats[order], doc[order], length[order]


def with_neighbours(feats: np.ndarray, doc: np.ndarray) -> np.ndarray:
    """Each line's own features, then the previous and the next line's (zeros at the ends)."""
    before, after = np.zeros_like(feats), np.zeros_like(feats)
    tied = doc[1:] == doc[:-1]
    before[1:][tied] = feats[:-1][tied]
    after[:-1][tied] = feats[1:][tied]
    return np.concatenate([feats, before, after], 1)


class Chains:
    """Documents' lines stepped together: step t holds line t of every document that is so long."""

    def __init__(self, doc: np.ndarray):
        first = np.flatnonzero(np.append(True, doc[1:] != doc[:-1])) if len(doc) else np.zeros(0, int)
        self.first, self.count = first, np.diff(np.append(first, len(doc)))
        by = np.argsort(-self.count, kind="stable")
        self.by_length = first[by]
        sizes = self.count[by]
        self.live = np.searchsorted(-sizes, -np.arange(sizes[0] if len(sizes) else 0), "left")

    def steps(self):
        for t, n in enumerate(self.live):
            yield t, self.by_length[:n] + t


def marginals(score: np.ndarray, trans: np.ndarray, chains: Chains):
    """score: log-potential of `good` over `bad` by line. Returns P(good), pair marginals' sum, log Z."""
    emit = np.stack([np.zeros(len(score)), score], 1)
    alpha = np.zeros_like(emit)
    beta = np.zeros_like(emit)
    steps = list(chains.steps())
    for t, at in steps:
        if t == 0:
            alpha[at] = emit[at]
        else:
            prev = alpha[at - 1]
            alpha[at] = emit[at] + np.logaddexp(prev[:, :1] + trans[0], prev[:, 1:] + trans[1])
    last = chains.first + chains.count - 1
    log_z = np.logaddexp(alpha[last, 0], alpha[last, 1])
    pair = np.zeros((2, 2))
    z_of = np.repeat(log_z, chains.count)
    for t, at in reversed(steps):
        if t == 0:
            break
        nxt = emit[at] + beta[at]
        beta[at - 1] = np.logaddexp(nxt[:, :1] + trans[:, 0], nxt[:, 1:] + trans[:, 1])
        pair += np.exp(alpha[at - 1][:, :, None] + trans[None] + nxt[:, None, :] - z_of[at][:, None, None]).sum(0)
    good = np.exp(np.clip(alpha[:, 1] + beta[:, 1] - z_of, -700, 0))
    return good, pair, log_z


class LineCrf:
    def __init__(self, n_features: int):
        self.mean = np.zeros(n_features)
        self.scale = np.ones(n_features)
        self.weight = np.zeros(3 * n_features)
        self.trans = np.zeros((2, 2))
        self.curve = np.array([1.0, 0.0])

    def inputs(self, feats, doc):
        x = (feats - self.mean) / self.scale
        x[:, 0] = 1.0
        return with_neighbours(x, doc)

    def fit(self, feats, doc, label, length, steps: int = 150, rate: float = 0.1, ridge: float = 1e-3):
        """``label``: of each line. Adam on the conditional log-likelihood, whole sample at a time."""
        self.mean, self.scale = feats.mean(0), feats.std(0) + 1e-3
        x, chains = self.inputs(feats, doc), Chains(doc)
        held = with_neighbours(np.ones((len(doc), 1)), doc)[:, 1] > 0
        seen = np.zeros((2, 2))
        np.add.at(seen, (label[:-1][held[1:]], label[1:][held[1:]]), 1)
        m = [np.zeros_like(self.weight), np.zeros((2, 2))]
        v = [np.zeros_like(self.weight), np.zeros((2, 2))]
        for step in range(1, steps + 1):
            good, pair, _ = marginals(x @ self.weight, self.trans, chains)
            grads = [x.T @ (good - label) / len(doc) + ridge * self.weight, (pair - seen) / len(doc) + ridge * self.trans]
            for p, g, a, b in zip([self.weight, self.trans], grads, m, v, strict=True):
                a += 0.1 * (g - a)
                b += 0.01 * (g * g - b)
                p -= rate * (a / (1 - 0.9**step)) / (np.sqrt(b / (1 - 0.99**step)) + 1e-8)
        return self

    def document_logit(self, feats, doc, length, n_docs: int) -> np.ndarray:
        good, _, _ = marginals(self.inputs(feats, doc) @ self.weight, self.trans, Chains(doc))
        heavy = length + 1.0
        share = np.bincount(doc, good * heavy, minlength=n_docs) / np.maximum(np.bincount(doc, heavy, minlength=n_docs), 1e-9)
        return np.log((share + 1e-4) / (1 - share + 1e-4))

    def calibrate(self, logit, label, steps: int = 2000, rate: float = 0.05):
        a, b = 1.0, 0.0
        for _ in range(steps):
            p = 1 / (1 + np.exp(-(a * logit + b)))
            a -= rate * ((p - label) * logit).mean()
            b -= rate * (p - label).mean()
        self.curve = np.array([max(a, 1e-3), b])
        return self


def fitting(rows: list, most: dict[int, int], max_bytes: int) -> list:
    """Of ``rows`` (label, h, bytes), in order, those that fit their label's share of ``max_bytes``; only texts that don't fit are skipped.

    Shares are as ``most``; what one label leaves of its share is the other's.
    """
    share = {k: max_bytes * n // sum(most.values()) for k, n in most.items()}
    used = {k: min(share[k], sum(r.bytes for r in rows if r.label == k)) for k in share}
    left = {k: max_bytes - sum(n for other, n in used.items() if other != k) for k in share}
    out = []
    for r in rows:
        if r.bytes <= left[r.label]:
            left[r.label] -= r.bytes
            out.append(r)
    return out


def labelled(docs: DataFrame, labels: DataFrame, column: str, per_class: tuple[int, int], max_bytes: int) -> list:
    """(label, text) of at most ``per_class[label]`` labelled documents of each label by hash of doc_id, in order of a hash.

    Texts are chosen by their length, so that at most ``max_bytes`` of them come to the driver. A label of which no text fits is an error.
    """
    rows = labels.filter(F.col(column).isin(0, 1) & F.col("doc_id").isNotNull())
    rows = rows.groupBy("doc_id").agg(F.max(column).cast("int").alias("label"))  # repeated rows: the higher label
    taken = [r for label in (0, 1) for r in rows.filter(F.col("label") == label).orderBy(F.xxhash64("doc_id"), "doc_id").limit(per_class[label]).collect()]
    ids = docs.sparkSession.createDataFrame([tuple(r) for r in taken], "doc_id bigint, label int")
    got = docs.filter(F.col("text").isNotNull()).join(F.broadcast(ids), "doc_id").select("label", "text", F.xxhash64("doc_id", "text").alias("h"))
    first = Window.partitionBy("label").orderBy("h")  # repeated rows of a sampled doc_id stay within the bound
    most = dict(enumerate(per_class))
    sized = got.select("label", "h", F.octet_length("text").alias("bytes")).withColumn("r", F.row_number().over(first))
    sized = sized.filter(F.col("r") <= F.when(F.col("label") == 0, per_class[0]).otherwise(per_class[1])).collect()
    kept = fitting(sorted(sized, key=lambda r: (r.h, r.label)), most, max_bytes)
    for label in {r.label for r in sized} - {r.label for r in kept}:
        raise ValueError(f"no text with {column} = {label} fits its share of {max_bytes} bytes")
    side = docs.sparkSession.createDataFrame([(r.h,) for r in kept], "h bigint").distinct()
    text = {r.h: r.text for r in got.join(F.broadcast(side), "h").select("h", "text").dropDuplicates(["h"]).collect()}
    return [(r.label, text[r.h]) for r in kept]


def train(docs: DataFrame, labels: DataFrame, column: str = "quality", per_class: tuple[int, int] = (900, 900), max_bytes: int = 8 << 20) -> LineCrf | None:
    """Learns from the rows of ``labels`` given; bounded by sum(per_class) documents and ``max_bytes`` of text."""
    rows = labelled(docs, labels, column, per_class, max_bytes)
    if len({y for y, _ in rows}) < 2:
        return None
    feats, doc, length = line_features(raw_texts(pa.array([t for _, t in rows])))
    label = np.array([y for y, _ in rows])
    model = LineCrf(feats.shape[1]).fit(feats, doc, label[doc], length)
    return model.calibrate(model.document_logit(feats, doc, length, len(rows)), label)


def predict(docs: DataFrame, model: LineCrf | None, threshold: float = 0.3) -> DataFrame:
    """Adds ``score`` and ``predicted``; ``text`` is dropped, other columns pass through."""
    if model is None:
        return docs.drop("text").withColumns({"score": F.lit(0.5), "predicted": F.lit(1)})

    def score(texts: Texts) -> dict:
        feats, doc, length = line_features(texts)
        z = model.document_logit(feats, doc, length, len(texts))
        p = 1 / (1 + np.exp(-np.clip(model.curve[0] * z + model.curve[1], -60, 60)))
        return {"score": p, "predicted": (p >= threshold).astype(np.int32)}

    return per_document(docs, score, "score double, predicted int")


def op1_quality(spark, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    labels = table(spark, sf_dir, "labels").select("doc_id", "quality").filter(fold("doc_id", 5) != 0)
    model = train(docs, labels)
    return predict(docs.select("doc_id", (fold("doc_id", 5) == 0).alias("held_out"), "text"), model)
