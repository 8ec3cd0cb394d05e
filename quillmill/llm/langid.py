"""Language identification by a byte convolutional network.

Bytes are folded to classes; filters of several widths slide over fixed-length windows of the whole
text, each filter is max-pooled over its window and a softmax reads the pooled values. The network
is trained in numpy on a bounded sample of labelled documents (``per_lang`` documents a language,
``windows_per_doc`` windows of each, cut on the executors, so that at most ``max_docs`` times that many
windows come to the driver) and applied to every window of every text; a document's
probabilities are the mean of its windows', weighted by their bytes.

Defined results: null texts and texts without a letter give ``und`` with score 1.0; an empty table
gives no rows; without any labelled document every text is ``und`` with score 0.0; with one label all
lettered texts get it; of equally likely languages the first in order of name wins; equal texts have equal
results, whatever their doc_id; repeated rows give rows of their own; columns named like an added one are
replaced. A text of any length goes through in runs of 512 windows.
:func:`identified`, the filter, keeps rows of a known language with a score of MIN_SCORE or more: over a
long mixed text the mean stays near the share of its main language, and with four languages 0.25 is chance.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import Texts, fold, per_document, pieces, raw_texts, table

UND = "und"
MIN_SCORE = 0.35
WIDTHS = (2, 3, 4)

# Byte classes: 0 padding, letters folded to lower case, space, digit, other ASCII, each high byte.
_CLASS = np.full(256, 29, np.int32)
_CLASS[65:91] = np.arange(1, 27)
_CLASS[97:123] = np.arange(1, 27)
_CLASS[[9, 10, 11, 12, 13, 32]] = 27
_CLASS[48:58] = 28
_CLASS[128:] = 30 + np.arange(128)
N_CLASSES = 158
_ASCII_LETTER = np.zeros(256, bool)
_ASCII_LETTER[65:91] = _ASCII_LETTER[97:123] = True


def window_starts(texts: Texts, size: int):
    """(document of each window, its first byte, bytes of text in it): windows start every ``size`` bytes."""
    count = np.maximum(1, -(-np.diff(texts.offsets) // size))
    doc = np.repeat(np.arange(len(texts)), count)
    rank = np.arange(count.sum()) - np.repeat(np.cumsum(count) - count, count)
    begin = texts.offsets[doc] + rank * size
    return doc, begin, np.clip(texts.offsets[doc + 1] - begin, 0, size)


def window_classes(texts: Texts, doc: np.ndarray, begin: np.ndarray, size: int, overlap: int = max(WIDTHS) - 1) -> np.ndarray:
    """Byte classes [windows, size + overlap]: a window reads ``overlap`` bytes more, so no n-gram falls between two."""
    at = begin[:, None] + np.arange(size + overlap)
    inside = at < texts.offsets[doc + 1][:, None]
    source = texts.data if len(texts.data) else np.zeros(1, np.uint8)
    return np.where(inside, _CLASS[source[np.minimum(at, len(source) - 1)]], 0)


def windows(texts: Texts, size: int):
    """(classes, document of each window, bytes of text in each window) of all windows."""
    doc, begin, own = window_starts(texts, size)
    return window_classes(texts, doc, begin, size), doc, own


class ByteCnn:
    """filters[w]: [w, classes, F]; each output is max over positions of the sum of w lookups."""

    def __init__(self, langs: list[str], filters: int = 8, size: int = 256, seed: int = 7):
        rng = np.random.default_rng(seed)
        self.langs, self.size, self.n_filters = langs, size, filters
        self.conv = [rng.normal(0, 0.3, (w, N_CLASSES, filters)).astype(np.float32) for w in WIDTHS]
        self.weight = rng.normal(0, 0.1, (filters * len(WIDTHS), len(langs))).astype(np.float32)
        self.bias = np.zeros(len(langs), np.float32)

    def pool(self, classes: np.ndarray):
        """Max-pooled activations and the position of each maximum."""
        n = classes.shape[1] - max(WIDTHS) + 1
        tops, places = [], []
        for w, table_ in zip(WIDTHS, self.conv, strict=True):
            act = sum(table_[k][classes[:, k : k + n]] for k in range(w))
            place = act.argmax(1)
            tops.append(np.take_along_axis(act, place[:, None], 1)[:, 0])
            places.append(place)
        return np.concatenate(tops, 1), places

    def fit(self, classes: np.ndarray, label: np.ndarray, steps: int = 600, batch: int = 96, rate: float = 0.02, seed: int = 11):
        rng = np.random.default_rng(seed)
        params = [*self.conv, self.weight, self.bias]
        moment = [np.zeros_like(p) for p in params]
        square = [np.zeros_like(p) for p in params]
        share = np.bincount(label, minlength=len(self.langs)).astype(float)
        chance = 1 / share[label]
        chance /= chance.sum()
        for step in range(1, steps + 1):
            pick = rng.choice(len(label), batch, p=chance)
            x, y = classes[pick], label[pick]
            z, places = self.pool(x)
            h = np.tanh(z)
            logit = h @ self.weight + self.bias
            prob = np.exp(logit - logit.max(1, keepdims=True))
            prob /= prob.sum(1, keepdims=True)
            prob[np.arange(batch), y] -= 1
            prob /= batch
            back = (prob @ self.weight.T) * (1 - h * h)
            grads = []
            for g, (w, place) in enumerate(zip(WIDTHS, places, strict=True)):
                grad = np.zeros_like(self.conv[g])
                own = back[:, g * self.n_filters : (g + 1) * self.n_filters]
                for k in range(w):
                    seen = np.take_along_axis(x, place + k, 1)
                    np.add.at(grad[k], (seen, np.arange(self.n_filters)[None, :]), own)
                grads.append(grad)
            grads += [h.T @ prob, prob.sum(0)]
            now = rate * (1 - step / (steps + 1))
            for p, g, m, s in zip(params, grads, moment, square, strict=True):
                m += 0.1 * (g - m)
                s += 0.01 * (g * g - s)
                p -= now * (m / (1 - 0.9**step)) / (np.sqrt(s / (1 - 0.99**step)) + 1e-6)
        return self

    def tables(self):
        """Two-byte lookups that give the same sums with fewer gathers."""
        two = [c[0][:, None, :] + c[1][None, :, :] for c in self.conv]
        tail = self.conv[2][2][:, None, :] + self.conv[2][3][None, :, :]
        flat = lambda t: np.ascontiguousarray(t.reshape(N_CLASSES * N_CLASSES, self.n_filters))
        return [flat(t) for t in two], self.conv[1][2], flat(tail)

    def probabilities(self, classes: np.ndarray, tables_) -> np.ndarray:
        two, third, tail = tables_
        n = classes.shape[1] - max(WIDTHS) + 1
        pair = classes[:, :-1] * N_CLASSES + classes[:, 1:]
        first = pair[:, :n]
        a = two[0][first].max(1)
        act = two[1][first]
        act += third[classes[:, 2 : n + 2]]
        b = act.max(1)
        np.take(two[2], first, axis=0, out=act)
        act += tail[pair[:, 2 : n + 2]]
        c = act.max(1)
        logit = np.tanh(np.concatenate([a, b, c], 1)) @ self.weight + self.bias
        prob = np.exp(logit - logit.max(1, keepdims=True))
        return prob / prob.sum(1, keepdims=True)


def _lettered(texts: Texts) -> np.ndarray:
    """Whether each text holds a letter of any script."""
    hits = np.concatenate([[0], np.cumsum(_ASCII_LETTER[texts.data])])
    found = hits[texts.offsets[1:]] > hits[texts.offsets[:-1]]
    for i in np.flatnonzero(~found & (np.diff(texts.offsets) > 0)):
        found[i] = any(c.isalpha() for c in texts.text(i).decode("utf-8", "replace"))
    return found


def sample(docs: DataFrame, per_lang: int, max_docs: int, windows_per_doc: int, size: int) -> list:
    """(lang, classes) of windows, spread evenly over documents of every language taken by hash of doc_id:
    ``per_lang`` of each at most, fewer (but one) where all would pass ``max_docs``."""
    rows = docs.filter(F.col("lang").isNotNull()).select("doc_id", "lang", F.xxhash64("doc_id").alias("h"))
    n_langs = rows.select("lang").distinct().count()
    if not n_langs:
        return []
    per_lang = max(1, min(per_lang, max_docs // n_langs))
    first = Window.partitionBy("lang").orderBy("h", "doc_id")
    ids = rows.withColumn("r", F.row_number().over(first)).filter(F.col("r") <= per_lang)
    ids = [r[0] for r in ids.select("doc_id").collect()]  # at most per_lang * n_langs
    got = docs.filter(F.col("lang").isNotNull() & F.col("text").isNotNull()).join(
        F.broadcast(docs.sparkSession.createDataFrame([(i,) for i in ids], "doc_id bigint").distinct()), "doc_id", "left_semi"
    )

    def cut(batches):
        for batch in batches:
            for lo, _, texts in pieces(raw_texts(batch.column("text"))):
                doc, begin, own = window_starts(texts, size)
                for i in range(len(texts)):
                    at = np.flatnonzero((doc == i) & (own > 0))
                    if len(at):
                        at = at[np.unique(np.linspace(0, len(at) - 1, min(windows_per_doc, len(at))).astype(int))]
                    made = window_classes(texts, doc[at], begin[at], size).astype(np.uint8)
                    yield pa.RecordBatch.from_pydict({"lang": [batch.column("lang")[lo + i].as_py()], "h": [batch.column("h")[lo + i].as_py()], "classes": [made.tobytes()]})

    cuts = got.select("lang", F.xxhash64("doc_id", "text").alias("h"), "text").mapInArrow(cut, "lang string, h long, classes binary")
    # Repeated rows of a sampled doc_id stay within the bound.
    return cuts.orderBy("h", "lang").limit(per_lang * n_langs).collect()


def train(docs: DataFrame, per_lang: int = 200, max_docs: int = 12_800, windows_per_doc: int = 6, size: int = 256) -> ByteCnn | None:
    """``docs`` (doc_id, lang, text) are the rows to learn from; bounded by per_lang documents of each language and ``max_docs``, or one of each."""
    rows = sample(docs, per_lang, max_docs, windows_per_doc, size)
    langs = sorted({r.lang for r in rows})
    if not langs:
        return None
    classes = [np.frombuffer(r.classes, np.uint8).reshape(-1, size + max(WIDTHS) - 1).astype(np.int32) for r in rows]
    label = np.repeat([langs.index(r.lang) for r in rows], [len(c) for c in classes])
    model = ByteCnn(langs, size=size)
    return model.fit(np.concatenate(classes), label) if len(label) and len(langs) > 1 else model


def predict(docs: DataFrame, model: ByteCnn | None, keep_text: bool = False) -> DataFrame:
    """Adds ``lang_pred`` and ``score`` to every row; ``text`` goes unless asked for, other columns pass through."""
    if model is None:
        return (docs if keep_text else docs.drop("text")).withColumns({"lang_pred": F.lit(UND), "score": F.lit(0.0)})
    tables_ = model.tables()
    langs = np.array([*model.langs, UND], dtype=object)

    def score(texts: Texts) -> dict:
        n, total = len(texts), np.zeros((len(texts), len(model.langs)))
        weight = np.zeros(n)
        doc, begin, own = window_starts(texts, model.size)
        for i in range(0, len(doc), 512):
            part = slice(i, i + 512)
            heavy = own[part] + 1e-9
            prob = model.probabilities(window_classes(texts, doc[part], begin[part], model.size), tables_) * heavy[:, None]
            np.add.at(total, doc[part], prob)
            np.add.at(weight, doc[part], heavy)
        total /= np.maximum(weight, 1e-12)[:, None]
        best = total.argmax(1)
        top = np.clip(total[np.arange(n), best], 0.0, 1.0)
        lettered = _lettered(texts)
        return {"lang_pred": langs[np.where(lettered, best, len(model.langs))], "score": np.where(lettered, top, 1.0)}

    return per_document(docs, score, "lang_pred string, score double", keep_text)


def identified(docs: DataFrame, model: ByteCnn | None, min_score: float = MIN_SCORE) -> DataFrame:
    """The rows of ``docs`` whose language is known with at least ``min_score``; without a model all rows."""
    if model is None:
        return docs
    pick = {c: f"__{i}" for i, c in enumerate(docs.columns)}  # clashing names can't meet the added ones
    got = predict(docs.select(*[F.col(c).alias("text" if c == "text" else n) for c, n in pick.items()]), model, keep_text=True)
    got = got.filter((F.col("lang_pred") != UND) & (F.col("score") >= min_score))
    return got.select(*[F.col("text" if c == "text" else n).alias(c) for c, n in pick.items()])


def op9_language_id(spark, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "lang", "text")
    held = (fold("doc_id", 4) == 2).alias("held_out")
    model = train(docs.filter(fold("doc_id", 4) != 2))
    return predict(docs.select("doc_id", held, "text"), model)
