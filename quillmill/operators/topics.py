"""Anchor-word topics: windowed co-occurrence, normalised PMI, anchors, their mixtures for every word.

All tables are sparse. A symmetric matrix is held once a pair (a <= b, n): its full form has n at (a, b) and
(b, a), and 2 n on the diagonal, as either word sees the other.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import IntegerType, StructField, StructType

from ..functions.shared import saved
from .wordpairs import Pairs, flat_words

EPS = 1e-9
MOST_ANCHORS = 256  # their products with one another are told to every task: 256 * 256 doubles


def words(text: Column) -> Column:
    """Lower-case words between white space."""
    return F.filter(F.split(F.lower(F.coalesce(text, F.lit(""))), r"[ \t-\r]+"), lambda w: w != "")


def word_counts(docs: DataFrame, text: str = "text") -> DataFrame:
    """(term, n)."""
    return docs.select(F.explode(words(F.col(text))).alias("term")).groupBy("term").agg(F.count("*").alias("n"))


def cooccurrence(docs: DataFrame, window: int = 5, text: str = "text") -> DataFrame:
    """(a, b, n): how often two words stand in one stretch of ``window`` words, a <= b.

    The pairs of a document at each distance are its word array zipped with itself, moved; they are counted
    in the task that reads the document before anything is shuffled.
    """
    held = docs.select(words(F.col(text)).alias("w"))
    n = F.size("w")

    def apart(d: int) -> Column:
        moved = F.arrays_zip(F.slice("w", F.lit(1), n - d).alias("a"), F.slice("w", F.lit(1 + d), n - d).alias("b"))
        return F.when(n > d, moved).otherwise(F.array().cast("array<struct<a:string,b:string>>"))

    pairs = held.select(F.explode(F.flatten(F.array(*[apart(d) for d in range(1, window)]))).alias("p")).select("p.a", "p.b")
    return pairs.groupBy(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).agg(F.count("*").alias("n"))


def both_ways(pairs: DataFrame) -> DataFrame:
    """(a, b, n): the full symmetric matrix."""
    sides = F.when(F.col("a") == F.col("b"), F.array(F.struct("a", "b", (2 * F.col("n")).alias("n")))).otherwise(F.array(F.struct("a", "b", "n"), F.struct(F.col("b").alias("a"), F.col("a").alias("b"), "n")))
    return pairs.select(F.explode(sides).alias("s")).select("s.*")


def _pmi(p_ab: Column, p_a: Column, p_b: Column) -> Column:
    p = F.greatest(p_ab, F.lit(EPS))
    return F.log(p / (p_a * (p_b + EPS))) / F.greatest(-F.log(p), F.lit(EPS))


def pair_total(docs: DataFrame, window: int = 5, text: str = "text") -> int:
    """The sum of :func:`cooccurrence`'s counts, from the documents' lengths: nothing is paired or shuffled for it."""
    n = F.size(words(F.col(text)))
    near = sum((F.greatest(n - d, F.lit(0)) for d in range(1, window)), F.lit(0))
    return docs.agg(F.sum(near.cast("long"))).first()[0] or 0


def normalized_pmi(pairs: DataFrame, counts: DataFrame, n_pairs: int | None = None) -> DataFrame:
    """(a, b, n, npmi) of every pair: log(p_ab / (p_a p_b)) / -log(p_ab), p_a and p_b from the words' counts.

    ``n_pairs``: the sum of the pairs' counts where it is known, which spares making all pairs once more.
    """
    total = F.lit(2) * (pairs.agg(F.sum("n")).scalar() if n_pairs is None else F.lit(n_pairs))
    each = counts.select("term", (F.col("n") / counts.agg(F.sum("n")).scalar()).alias("p"))
    met = pairs.join(each.select(F.col("term").alias("a"), F.col("p").alias("p_a")), "a").join(each.select(F.col("term").alias("b"), F.col("p").alias("p_b")), "b")
    p_ab = F.col("n") * F.when(F.col("a") == F.col("b"), 2).otherwise(1) / total
    return met.select("a", "b", "n", "p_a", "p_b", p_ab.alias("p_ab"), _pmi(p_ab, F.col("p_a"), F.col("p_b")).alias("npmi"))


def word_scores(pairs: DataFrame, counts: DataFrame, n_pairs: int | None = None) -> DataFrame:
    """(term, n, score): the sum of a word's normalised PMI with all words, also those it never meets.

    A pair that never meets scores (log eps - log p_a - log(p_b + eps)) / -log eps, which sums over all b in closed
    form; only the difference of pairs that do meet is summed pair by pair.
    """
    never = math.log(EPS)
    n_words, n_all = counts.count(), counts.agg(F.sum("n")).first()[0] or 1
    p = F.col("n") / n_all
    logs = counts.agg(F.sum(F.log(p + EPS))).first()[0] or 0.0
    apart = (never - F.log("p_a") - F.log(F.col("p_b") + EPS)) / -never
    more = normalized_pmi(pairs, counts, n_pairs).withColumn("more", F.col("npmi") - apart)
    sides = F.when(F.col("a") == F.col("b"), F.array("a")).otherwise(F.array("a", "b"))
    # The score isn't symmetric: eps is added to the other word's share alone.
    back = _pmi(F.col("p_ab"), F.col("p_b"), F.col("p_a")) - (never - F.log("p_b") - F.log(F.col("p_a") + EPS)) / -never
    met = more.select(F.explode(sides).alias("term"), F.col("a"), "more", back.alias("back"))
    summed = met.groupBy("term").agg(F.sum(F.when(F.col("term") == F.col("a"), F.col("more")).otherwise(F.col("back"))).alias("met"))
    base = (n_words * (never - F.log(p)) - logs) / -never
    return counts.join(summed, "term", "left").select("term", "n", (base + F.coalesce("met", F.lit(0.0))).alias("score"))


def anchors(scores: DataFrame, k: int) -> DataFrame:
    """(rank, term, score): the ``k`` words of the highest score; equal ones by term. A top-k report."""
    top = scores.select("term", F.round("score", 9).alias("score")).orderBy(F.desc("score"), "term").limit(k)
    return top.select((F.row_number().over(Window.orderBy(F.desc("score"), "term")) - 1).alias("rank"), "term", "score")


def conditional(pairs: DataFrame) -> DataFrame:
    """(a, b, q): the share of b among all words that stand near a."""
    full = both_ways(pairs)
    mass = full.groupBy("a").agg(F.sum("n").alias("mass"))
    return full.join(mass, "a").select("a", "b", (F.col("n") / F.col("mass")).alias("q"))


def simplex_mixtures(products: np.ndarray, gram: np.ndarray, tolerance: float, most: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Exponentiated gradient for all rows at once: w on the simplex with least |q - w A| ** 2, from
    products = q A^T and gram = A A^T. Returns weights, largest last change and steps of each row.

    The step follows from the gram matrix, so no rate has to be chosen; rows that have settled rest.
    """
    n, k = products.shape
    rate = 1.0 / max(2.0 * np.abs(gram).max() * 2.0, 1e-12)
    weights, change, steps = np.full((n, k), 1.0 / max(k, 1)), np.full(n, np.inf), np.zeros(n, np.int64)
    live = np.arange(n)
    for _ in range(most):
        if not len(live):
            break
        w = weights[live]
        power = -rate * 2.0 * (w @ gram - products[live])
        new = w * np.exp(power - power.max(1, keepdims=True))
        new /= new.sum(1, keepdims=True)
        change[live] = np.abs(new - w).max(1) / rate
        weights[live] = new
        steps[live] += 1
        live = live[change[live] > tolerance]
    return weights, change, steps


def _names(chosen: DataFrame) -> list[str]:
    names = [r.term for r in chosen.orderBy("rank").select("term").collect()]
    if len(names) > MOST_ANCHORS:
        raise ValueError(f"{len(names)} anchors, but at most {MOST_ANCHORS} are told to every task")
    return names


def _solved(products: DataFrame, names: list[str], tolerance: float, most: int) -> DataFrame:
    """(term, weights, change, steps) of (term, x): words are solved where they are, in batches, equal products once."""
    k = len(names)
    gram = np.zeros((k, k))
    place = {t: i for i, t in enumerate(names)}
    for r in products.filter(F.col("term").isin(names)).collect():  # a row an anchor
        gram[place[r.term]] = r.x

    def solve(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            x, of = np.unique(np.array(batch.column("x").to_pylist(), float).reshape(-1, k), axis=0, return_inverse=True)
            weights, change, steps = (v[of] for v in simplex_mixtures(x, gram, tolerance, most))
            yield pa.RecordBatch.from_arrays([batch.column("term"), pa.array(weights.tolist(), pa.list_(pa.float64())), pa.array(change), pa.array(steps)], names=["term", "weights", "change", "steps"])

    # Words that stand alone in their document have no neighbours and no row.
    return products.mapInArrow(solve, "term string, weights array<double>, change double, steps long")


def mixtures(pairs: Pairs, chosen: DataFrame, tolerance: float = 1e-4, most: int = 2000) -> DataFrame:
    """:func:`topic_mixtures` without a row for each pair; the products are written once."""
    names = _names(chosen)
    return _solved(saved(pairs.products(names)), names, tolerance, most)


def topic_mixtures(pairs: DataFrame, chosen: DataFrame, tolerance: float = 1e-4, most: int = 2000) -> DataFrame:
    """(term, weights, change, steps): every word's neighbours as a mixture of the anchors' neighbours.

    Products of a word's row with the anchors' rows are a sparse join on the neighbour (each one meets at most as
    many rows as there are anchors), grouped by word; the words are then solved where they are, in batches.
    """
    names = _names(chosen)
    k = len(names)
    q = conditional(pairs)
    rows = q.join(chosen.select(F.col("term").alias("a"), "rank"), "a").select("rank", "b", F.col("q").alias("anchor_q"))
    met = q.join(rows, "b").groupBy("a", "rank").agg(F.sum(F.col("q") * F.col("anchor_q")).alias("x"))
    dense = F.transform(F.sequence(F.lit(0), F.lit(max(k - 1, 0))), lambda i: F.coalesce(F.try_element_at(F.col("m"), i), F.lit(0.0)))
    held = met.groupBy("a").agg(F.map_from_entries(F.collect_list(F.struct("rank", "x"))).alias("m"))
    products = q.select("a").distinct().join(held, "a", "left").select(F.col("a").alias("term"), dense.alias("x"))
    return _solved(products, names, tolerance, most)


def topic_words(mixtures: DataFrame, counts: DataFrame) -> DataFrame:
    """(topic, term, weight, share): p(topic | word), and p(word | topic) by Bayes."""
    each = mixtures.select("term", "weights").join(counts.select("term", "n"), "term").select("term", "n", F.posexplode("weights").alias("topic", "weight"))
    mass = each.groupBy("topic").agg(F.sum(F.col("weight") * F.col("n")).alias("mass"))
    return each.join(F.broadcast(mass), "topic").select("topic", "term", "weight", (F.col("weight") * F.col("n") / F.col("mass")).alias("share"))


def convergence(mixtures: DataFrame) -> DataFrame:
    """Residuals grouped by steps taken: whether, and how late, words settled."""
    return mixtures.groupBy("steps").agg(F.count("*").alias("n"), F.max("change").alias("change"))


def assigned(docs: DataFrame, chosen: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """(key, topic): the rank of the first anchor word in each document, 0 without one."""
    names = pa.array(_names(chosen), pa.string())

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, 64):
                part = batch.slice(at, 64)
                flat, size = flat_words(part.column(1))
                rank = pc.fill_null(pc.index_in(flat, names), -1).to_numpy()
                hit = np.flatnonzero(rank >= 0)
                doc, first = np.unique(np.repeat(np.arange(len(size)), size)[hit], return_index=True)
                topic = np.zeros(len(size), np.int32)
                topic[doc] = rank[hit[first]]
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array(topic)], names=[key, "topic"])

    lowered = docs.select(key, F.lower(F.coalesce(F.col(text), F.lit(""))).alias("__t"))
    return lowered.mapInArrow(run, StructType([docs.schema[key], StructField("topic", IntegerType())]))
