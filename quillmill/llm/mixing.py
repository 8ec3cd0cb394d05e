"""Mixing sources to target weights by iterative proportional fitting.

Documents fall into cells by source, language and topic. Token weights of the cells are raked until
their source, language and topic marginals meet the targets; documents are then sampled with
probabilities proportional to their cell's weight, the heaviest cell's being 1, so the expected
sample meets the targets without taking any document twice.

Topics come from the texts (:class:`Topics`): clusters of all documents' word vectors.

Every source and language is a stratum. Up to ``MAX_CELLS`` cells are raked on the driver; more are a
distributed table that takes the same steps by grouped sums, so only rounding differs. Targets
default to tempered shares (share ** temperature, normalised); given ones are normalised over the
strata that occur, one not given is 0. Raking stops when all factors are within 1e-9 of 1 or after 500
rounds; if a marginal is then still off by more than MISSED of its target, given targets contradict one
another or the cells, an error, while default ones give a warning. A document's draw is a hash of its
doc_id, so a rerun takes the same documents.

Defined results: null source or lang is a stratum of its own, written (none) and told from a value of that
name; null texts are empty; a document without words has no tokens, the topic of an empty text and its cell's
probability; cells without tokens get weight 1; of equally near topics the first counts; equal rows are drawn
together; an empty table gives no rows; extra columns pass, whatever their names; a text of any length goes
through in one run of its words.
"""

from __future__ import annotations

import warnings

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import Texts, Words, give_back, mix64, per_document, pieces, raw_texts, release, saved, short_batches, table, unused

MAX_CELLS = 200_000
DIMENSIONS = ("source", "lang", "topic")
TEMPERATURE = {"source": 0.5, "lang": 0.7, "topic": 1.0}
NONE = "(none)"
MISSED = 0.01
CELL = [f"__{d}" for d in DIMENSIONS]


class Topics:
    """Topics of texts: clusters of word vectors.

    A text's vector sums a fixed random vector, by hash, for each of its distinct words and has unit length;
    less the mean of all documents' vectors, which takes out what all have in common, it has unit length
    again. Centres are found by Lloyd's rounds over all documents' vectors; only sums and ``n`` centres ever are on
    the driver. The first centres are spread over SEEDS vectors, the first by hash, each next one the
    farthest from those taken.
    """

    BUCKETS, DIM, SEEDS = 1 << 15, 24, 512
    PLANES = mix64(np.arange(BUCKETS * DIM, dtype=np.uint64) + np.uint64(77)).reshape(BUCKETS, DIM)
    PLANES = ((PLANES >> np.uint64(40)).astype(np.float32) / np.float32(1 << 23) - 1).astype(np.float32)

    def __init__(self, mean: np.ndarray, centres: np.ndarray):
        self.mean, self.centres = mean.astype(np.float32), centres.astype(np.float32)

    @classmethod
    def vectors(cls, texts: Texts) -> np.ndarray:
        """Unit vectors, of zeros for texts without words."""
        w = Words(texts, lower=True)
        own = np.unique((w.doc * cls.BUCKETS).astype(np.int64) + (w.hash % np.uint64(cls.BUCKETS)).astype(np.int64))
        doc = own // cls.BUCKETS
        x = np.zeros((len(texts), cls.DIM), np.float32)
        if len(own):
            first = np.flatnonzero(np.append(True, doc[1:] != doc[:-1]))
            x[doc[first]] = np.add.reduceat(cls.PLANES[own % cls.BUCKETS], first)
        return unit(x)

    def names(self, texts: Texts) -> list[str]:
        x = self.vectors(texts)
        near = (unit(x - self.mean) @ self.centres.T).argmax(1) if len(self.centres) else np.zeros(len(x), int)
        return [f"topic{k}" for k in np.where(x.any(1), near, 0)]

    @classmethod
    def learned(cls, docs: DataFrame, n: int = 8, rounds: int = 6) -> Topics:
        """From all of ``docs`` (text): one pass over the texts, then ``rounds`` over their vectors."""
        short_batches(docs.sparkSession)

        def project(batches):
            for batch in batches:
                for _, _, part in pieces(raw_texts(batch.column("text")), TOPIC_BYTES):
                    x = cls.vectors(part)
                    x = x[x.any(1)]
                    yield pa.RecordBatch.from_arrays([pa.FixedSizeListArray.from_arrays(pa.array(x.ravel()), cls.DIM).cast(pa.list_(pa.float32()))], names=["x"])
                give_back()

        rows = saved(docs.select(F.coalesce("text", F.lit("")).alias("text")).mapInArrow(project, "x array<float>"))

        def summed(step, k: int) -> np.ndarray:
            """[k, DIM + 1]: sums over all vectors of ``step``'s (place, vector), and their numbers."""

            def sums(batches):
                total = np.zeros((k, cls.DIM + 1))
                for batch in batches:
                    x = np.asarray(batch.column("x").flatten(), dtype=np.float64).reshape(-1, cls.DIM)
                    place, moved = step(x)
                    np.add.at(total, place, np.c_[moved, np.ones(len(moved))])
                yield pa.RecordBatch.from_pydict({"k": pa.array(range(k), pa.int32()), "s": list(total)})

            parts = rows.mapInArrow(sums, "k int, s array<double>").select("k", F.posexplode("s").alias("i", "v")).groupBy("k", "i").agg(F.sum("v").alias("v")).toPandas()
            got = np.zeros((k, cls.DIM + 1))
            got[parts["k"], parts["i"]] = parts["v"]
            return got

        seeds = [np.array(r[0], np.float64) for r in rows.orderBy(F.xxhash64("x"), "x").limit(cls.SEEDS).collect()]
        if not seeds:
            return cls(np.zeros(cls.DIM), np.zeros((0, cls.DIM)))
        whole = summed(lambda x: (np.zeros(len(x), int), x), 1)[0]
        mean = whole[:-1] / whole[-1]
        seeds = unit(np.stack(seeds) - mean)
        taken = [0]
        for _ in range(min(n, len(seeds)) - 1):
            taken.append(int((seeds @ seeds[taken].T).max(1).argmin()))
        centres = seeds[taken]
        for _ in range(rounds):

            def nearest(x, centres=centres):
                x = unit(x - mean)
                return (x @ centres.T).argmax(1), x

            moved = summed(nearest, len(centres))
            centres = np.where(moved[:, -1:] > 0, unit(moved[:, :-1]), centres)
        release(rows)
        return cls(mean, centres)


TOPIC_BYTES = 1 << 18


def unit(x: np.ndarray) -> np.ndarray:
    norm = np.linalg.norm(x, axis=1, keepdims=True)
    return x / np.where(norm > 0, norm, 1)


def rake(tokens: np.ndarray, index: dict[str, np.ndarray], targets: dict[str, np.ndarray], rounds: int = 500, tolerance: float = 1e-9, strict: bool = False) -> np.ndarray:
    """Weights of the cells whose weighted token marginals meet every dimension's target shares.

    ``strict``: targets that can't be met are an error, else a warning.
    """
    weight, total = np.ones(len(tokens)), tokens.sum()
    for _ in range(rounds):
        worst = 0.0
        for d, at in index.items():
            have = np.bincount(at, weight * tokens, minlength=len(targets[d]))
            want = targets[d] * total
            factor = np.where(have > 0, want / np.where(have > 0, have, 1), 1.0)
            worst = max(worst, float(np.abs(factor - 1).max(initial=0)))
            weight = np.where(tokens > 0, weight * factor[at], 1.0)
        if worst < tolerance:
            break
    missed(worst if len(tokens) else 0.0, rounds, strict)
    return weight


def missed(worst: float, rounds: int, strict: bool) -> None:
    """Reports marginals that are still off by the factor 1 + ``worst`` in the last round."""
    if worst > MISSED:
        told = f"targets can't all be met: after {rounds} rounds a marginal is off by {worst:.1%}"
        if strict:
            raise ValueError(told)
        warnings.warn(told, stacklevel=3)


def tempered(tokens: np.ndarray, temperature: float) -> np.ndarray:
    share = np.where(tokens > 0, np.maximum(tokens, 1) ** temperature, 0.0)
    return share / max(share.sum(), 1e-300)


def with_strata(docs: DataFrame, topics: Topics | None = None) -> DataFrame:
    """``docs`` with their strata and ``__tokens``; columns of those names are replaced. Topics are learned
    from ``docs`` unless given. A null source or lang is NONE; a value that is NONE or ends like it gets
    one more space, so that no two values meet."""
    topics = topics or Topics.learned(docs.select("text"))
    named = lambda c: F.coalesce(F.when(F.col(c).rlike(r"^\(none\) *$"), F.concat(F.col(c), F.lit(" "))).otherwise(F.col(c)), F.lit(NONE))
    given = docs.withColumns(
        {
            "__tokens": F.regexp_count(F.coalesce(F.col("text"), F.lit("")), F.lit(r"\S+")).cast("long"),
            "__source": named("source"),
            "__lang": named("lang"),
        }
    )
    return per_document(given, lambda texts: {"__topic": topics.names(texts)}, "__topic string", keep_text=True, max_bytes=TOPIC_BYTES)


def wanted_shares(cells: DataFrame, column: str, temperature: float, given: dict[str, float] | None) -> DataFrame:
    """(column, want): the target share of each of a dimension's values."""
    sums = cells.groupBy(column).agg(F.sum("__tokens").alias("t"))
    shares = sums.withColumn("want", F.when(F.col("t") > 0, F.pow("t", F.lit(temperature))).otherwise(0.0))
    if given:
        side = cells.sparkSession.createDataFrame([(n, max(float(v), 0.0)) for n, v in given.items()], f"{column} string, target double")
        met = sums.join(side, column, "left").withColumn("want", F.when(F.col("t") > 0, F.coalesce("target", F.lit(0.0))).otherwise(0.0))
        met = saved(met.select(column, "t", "want"))
        shares = met if met.filter("want > 0").limit(1).count() else shares
    shares = saved(shares)
    total = shares.agg(F.sum("want")).first()[0]
    return shares.select(column, (F.col("want") / F.lit(max(total or 0.0, 1e-300))).alias("want"))


def rake_table(cells: DataFrame, wanted: dict[str, DataFrame], rounds: int = 500, tolerance: float = 1e-9, strict: bool = False) -> DataFrame:
    """:func:`rake` for a table of cells of any size: adds ``__weight``."""
    total = float(cells.agg(F.sum("__tokens")).first()[0] or 0)
    now = saved(cells.withColumn("__weight", F.lit(1.0)))
    for _ in range(rounds):
        worst = 0.0
        for column, shares in wanted.items():
            have = now.groupBy(column).agg(F.sum(F.col("__weight") * F.col("__tokens")).alias("have"))
            factor = F.when(F.col("have") > 0, F.col("want") * total / F.col("have")).otherwise(1.0)
            factors = saved(have.join(shares, column).select(column, factor.alias("__factor")))
            worst = max(worst, factors.agg(F.max(F.abs(F.col("__factor") - 1))).first()[0] or 0.0)
            then = saved(now.join(factors, column).withColumn("__weight", F.when(F.col("__tokens") > 0, F.col("__weight") * F.col("__factor")).otherwise(1.0)).select(*now.columns))
            release(now)
            release(factors)
            now = then
        if worst < tolerance:
            break
    missed(worst, rounds, strict)
    return now


def probabilities(strata: DataFrame, temperature: dict[str, float], targets: dict[str, dict[str, float]] | None, max_cells: int = MAX_CELLS) -> DataFrame:
    """Every cell with its weight and probability."""
    sums = saved(strata.groupBy(*CELL).agg(F.sum("__tokens").alias("__tokens")))
    targets = targets or {}
    if sums.count() > max_cells:
        got = rake_table(sums, {f"__{d}": wanted_shares(sums, f"__{d}", temperature[d], targets.get(d)) for d in DIMENSIONS}, strict=bool(targets))
        top = got.agg(F.max("__weight")).first()[0]
        return got.select(*CELL, "__weight", (F.col("__weight") / F.lit(max(top, 1e-300))).alias("__probability"))
    cells = sums.toPandas().sort_values(CELL, ignore_index=True)
    tokens = cells["__tokens"].to_numpy(dtype=float)
    index, wanted = {}, {}
    for d, column in zip(DIMENSIONS, CELL, strict=True):
        names, index[d] = np.unique(cells[column].to_numpy(dtype=str), return_inverse=True)
        held = np.bincount(index[d], tokens, minlength=len(names))
        wanted[d] = tempered(held, temperature[d])
        if targets.get(d):
            given = np.array([max(targets[d].get(n, 0.0), 0.0) for n in names]) * (held > 0)
            wanted[d] = given / given.sum() if given.sum() > 0 else wanted[d]
    weight = rake(tokens, index, wanted, strict=bool(targets)) if len(cells) else tokens
    probability = weight / max(weight.max(initial=0.0), 1e-300)
    rows = [(str(s), str(lang), str(t), float(w), float(p)) for s, lang, t, w, p in zip(*[cells[c] for c in CELL], weight, probability, strict=True)]
    side = strata.sparkSession.createDataFrame(rows, ", ".join(f"{c} string" for c in CELL) + ", __weight double, __probability double")
    return F.broadcast(side)  # at most max_cells


def drawn(docs: DataFrame, temperature: dict[str, float] | None = None, targets: dict[str, dict[str, float]] | None = None, seed: int = 20, max_cells: int = MAX_CELLS) -> DataFrame:
    """The sampled rows of ``docs`` (doc_id, source, lang, text and others, none named ``__...``) with their
    stratum, tokens, weight and probability (columns ``__...``)."""
    strata = saved(with_strata(docs))  # so that no text is read for its topic twice
    joined = strata.join(probabilities(strata, TEMPERATURE | (temperature or {}), targets, max_cells), CELL)
    draw = F.shiftrightunsigned(F.xxhash64(F.lit(seed), F.col("doc_id")), 11) / F.lit(float(1 << 53))
    return joined.filter(draw < F.col("__probability"))


def sample(docs: DataFrame, **options) -> DataFrame:
    """The sampled rows of ``docs`` with the columns of ``docs``."""
    used = ("doc_id", "source", "lang", "text")
    others = [c for c in docs.columns if c not in used]
    plain = dict(zip(others, unused([*used, *others], *[f"other{i}" for i in range(len(others))]), strict=True))
    got = drawn(docs.select(*used, *[F.col(f"`{c}`").alias(n) for c, n in plain.items()]), **options)
    return got.select(*[F.col(plain.get(c, c)).alias(c) for c in docs.columns])


def op5_mixing(spark, sf_dir: str) -> DataFrame:
    """The sampled documents: strata, tokens, raked weight and sampling probability."""
    got = drawn(table(spark, sf_dir, "documents").select("doc_id", "source", "lang", "text"))
    return got.select("doc_id", "source", "lang", *[F.col(f"__{c}").alias(n) for c, n in (("topic", "topic"), ("tokens", "n_tokens"), ("weight", "weight"), ("probability", "probability"))])
