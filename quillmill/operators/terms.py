"""TF-IDF terms, ranked sentences and extractive summaries, for all documents at once."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, DoubleType, StringType, StructField, StructType

from ..functions import text as T
from ..functions.vocab import CJK

TOKENS_AT_ONCE = 1_000_000  # tokens that a task counts at a time; never a limit


def term_scores(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """(term, tf, df, score) over all documents: tf / all tokens * (ln((1 + N) / (1 + df)) + 1).

    Rows are brought together by ``key`` first; a task then counts some million tokens at a time, so that Spark groups
    counts instead of single tokens. Rows of one key are one document.
    """
    listed = docs.select(F.col(key).alias("key"), F.col(text).alias("text")).repartition("key").sortWithinPartitions("key").select("key", T.tokens(F.col("text")).alias("tokens"))
    terms = listed.mapInArrow(_counted, "term string, tf long, df long").groupBy("term").agg(F.sum("tf").alias("tf"), F.sum("df").alias("df"))
    totals = terms.agg(F.greatest(F.sum("tf"), F.lit(1)).alias("total")).crossJoin(docs.agg(F.greatest(F.count("*"), F.lit(1)).alias("n_docs")))
    scored = terms.join(F.broadcast(totals))  # one row
    idf = F.log((1 + F.col("n_docs")) / (1 + F.col("df"))) + 1.0
    keep = (F.length("term") >= 3) | F.col("term").rlike(CJK)
    return scored.filter(keep).select("term", "tf", "df", (F.col("tf") / F.col("total") * idf).alias("score"))


def _few(batches: Iterator[pa.RecordBatch], n: int = 64) -> Iterator[pa.RecordBatch]:
    """The batches by few documents: what is made of these is many times their size."""
    return (batch.slice(i, n) for batch in batches for i in range(0, batch.num_rows, n))


def _counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(term, tf, df) of every million tokens or so of rows (key, tokens), in order of keys. A document that goes on after a cut
    adds to df only by terms that it didn't have before."""
    held, doc, n, number, last, seen = [], [], 0, 0, None, None

    def flush() -> pa.RecordBatch:
        nonlocal held, doc, n, seen
        coded = pa.chunked_array([t.flatten() for t in held], pa.string()).combine_chunks().dictionary_encode()
        size = max(len(coded.dictionary), 1)
        codes, docs = coded.indices.to_numpy().astype(np.int64), np.concatenate(doc)
        tf = np.bincount(codes, minlength=len(coded.dictionary))
        uses = np.unique((docs - docs[0]) * size + codes) if len(docs) else np.empty(0, np.int64)
        term, of = uses % size, uses // size + (docs[0] if len(docs) else 0)
        known = np.zeros(size, bool)
        if seen is not None:
            known[: len(coded.dictionary)] = pc.is_in(coded.dictionary, seen[1]).to_numpy(zero_copy_only=False)
        fresh = np.ones(len(uses), bool) if seen is None else (of != seen[0]) | ~known[term]
        df = np.bincount(term[fresh], minlength=len(coded.dictionary))
        open_ = coded.dictionary.take(pa.array(term[of == number]))
        seen = (number, pa.concat_arrays([seen[1], open_]) if seen is not None and seen[0] == number else open_)
        held, doc, n = [], [], 0
        return pa.RecordBatch.from_arrays([coded.dictionary, pa.array(tf, pa.int64()), pa.array(df, pa.int64())], names=["term", "tf", "df"])

    for batch in _few(batches):
        tokens, numbers = batch.column("tokens"), []
        for k in batch.column("key").to_pylist():
            if k != last:
                number, last = number + 1, k
            numbers.append(number)
        held.append(tokens)
        doc.append(np.repeat(np.array(numbers, np.int64), pc.list_value_length(tokens).fill_null(0).to_numpy(zero_copy_only=False)))
        n += len(doc[-1])
        if n >= TOKENS_AT_ONCE:
            yield flush()
    if n:
        yield flush()


def key_terms(docs: DataFrame, top_k: int = 15, pool: int = 2000, key: str = "doc_id", text: str = "text") -> DataFrame:
    """The best terms of which none contains another, best first: (rank, term, score).

    The greedy step runs over the ``pool`` best terms, over ten times as many where these don't give top_k, and so on.
    """
    scores = term_scores(docs, key, text)

    def greedy(rows: DataFrame) -> DataFrame:
        listed = rows.agg(F.array_sort(F.collect_list(F.struct((-F.col("score")).alias("minus"), "term"))).alias("all"))
        clash = lambda acc, t: F.exists(acc, lambda p: F.contains(p["term"], t["term"]) | F.contains(t["term"], p["term"]))
        empty = F.array().cast("array<struct<minus:double,term:string>>")
        picked = F.aggregate("all", empty, lambda acc, t: F.when((F.size(acc) >= top_k) | clash(acc, t), acc).otherwise(F.concat(acc, F.array(t))))
        return listed.select(F.posexplode(picked).alias("rank", "t")).select((F.col("rank") + 1).alias("rank"), "t.term", (-F.col("t.minus")).alias("score"))

    while True:
        best = scores.orderBy(F.desc("score"), "term").limit(pool).cache()  # the scores are worked out once; ``pool`` rows stay
        first = greedy(best)
        if best.count() < pool or first.count() >= top_k:
            return first
        best.unpersist()
        pool *= 10


def _weighed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """``weights``, one for each sentence's tokens: their TF-IDF within the document over the root of their number; null without any."""
    for batch in _few(batches):
        sents = batch.column("tokens")
        words = sents.flatten().flatten().dictionary_encode()
        n_sent, n_tok = (pc.list_value_length(x).to_numpy(zero_copy_only=False).astype(np.int64) for x in (sents, sents.flatten()))
        size = max(len(words.dictionary), 1)
        code = words.indices.to_numpy().astype(np.int64)
        doc = np.repeat(np.arange(len(n_sent)), n_sent)  # of each sentence
        sent = np.repeat(np.arange(len(n_tok)), n_tok)  # of each token
        terms, at, tf = np.unique(doc[sent] * size + code, return_inverse=True, return_counts=True)
        once = np.unique(sent * size + code)
        df = np.bincount(np.searchsorted(terms, doc[once // size] * size + once % size), minlength=len(terms))
        of = terms // size
        total = np.bincount(doc[sent], minlength=len(n_sent))
        gain = tf / total[of] * (np.log((1 + n_sent[of]) / (1 + df)) + 1.0)
        weight = np.bincount(sent, weights=gain[at], minlength=len(n_tok)) / np.sqrt(np.maximum(n_tok, 1))
        listed = pa.ListArray.from_arrays(pa.array(np.concatenate([[0], np.cumsum(n_sent)]), pa.int32()), pa.array(weight, pa.float64(), mask=n_tok == 0))
        yield pa.RecordBatch.from_arrays([batch.column("key"), batch.column("sents"), listed], names=["key", "sents", "weights"])


def _scored(docs: DataFrame, key: str, text: str) -> DataFrame:
    """(key, found): each document's sentences with tokens as (ord, score, sentence). A document is a row and its own corpus, so
    nothing is shuffled, and a task holds few documents at a time."""
    cut = docs.select(F.col(key).alias("key"), T.sentences(F.col(text)).alias("sents"))
    listed = cut.select("key", "sents", F.transform("sents", lambda s: T.tokens(s)).alias("tokens"))
    made = StructType([StructField("key", docs.schema[key].dataType), StructField("sents", ArrayType(StringType())), StructField("weights", ArrayType(DoubleType()))])

    def sentence(s: Column, i: Column) -> Column:
        early = F.when(i < 5, F.pow(F.lit(1.15), 5 - i)).otherwise(1.0)
        size_factor = F.when(F.length(s) < 30, 0.7).when(F.length(s) > 260, 0.85).otherwise(1.0)
        return F.struct(i.alias("ord"), (F.get("weights", i) * early * size_factor).alias("score"), s.alias("sentence"))

    found = F.filter(F.transform("sents", sentence), lambda x: x["score"].isNotNull())
    return listed.mapInArrow(_weighed, made).select(F.col("key").alias(key), found.alias("found"))


def ranked_sentences(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """(key, ord, sentence, score) of every sentence with tokens; each document is its own corpus."""
    return _scored(docs, key, text).select(key, F.explode("found").alias("x")).select(key, "x.ord", "x.sentence", "x.score")


def summaries(docs: DataFrame, n: int = 5, key: str = "doc_id", text: str = "text") -> DataFrame:
    """Each document's ``n`` best sentences in reading order: (key, pos, sentence)."""
    best = F.array_sort(F.transform("found", lambda x: F.struct((-F.round(x["score"], 12)).alias("minus"), x["ord"].alias("ord"), x["sentence"].alias("sentence"))))  # equal scores: reading order
    order = F.array_sort(F.transform(F.slice(best, 1, n), lambda x: F.struct(x["ord"].alias("ord"), x["sentence"].alias("sentence"))))
    return _scored(docs, key, text).select(key, F.posexplode(order).alias("pos", "x")).select(key, (F.col("pos") + 1).alias("pos"), "x.sentence")


def keep_first(rows: DataFrame, group: str, order: str, text: str) -> DataFrame:
    """The first of rows whose texts agree but for case and punctuation, within each group."""
    first = Window.partitionBy(group, "__key").orderBy(order)
    marked = rows.withColumn("__key", T.dedupe_key(F.col(text))).filter("__key <> ''")
    return marked.withColumn("__r", F.row_number().over(first)).filter("__r = 1").drop("__r", "__key")
