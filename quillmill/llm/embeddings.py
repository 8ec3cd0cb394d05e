"""Near-duplicate vectors by an inverted multi-index.

Unit vectors are split into halves, each with its own codebook (k-means in numpy on a bounded sample
of SAMPLE vectors, or SAMPLE_PER_WORD a codeword where that is more; codebooks grow with the square root
of the number of vectors, up to MAX_WORDS, the bound that 1.5 GB of driver memory sets); the product of both codebooks is a grid of cells, and every vector is indexed in
the cell of its nearest pair of centroids. A query visits cells by the multi-sequence order, that is
by the sum of its squared distances to both centroids, until that sum exceeds its least one by a
slack. The slack is the one with which sampled vectors, turned by just the angle of the similarity
threshold in a random direction, are found with probability RECALL; real pairs are at most as far.
Candidates are verified by their cosine in double precision.

A pair is owned by the smaller vec_id's query, so that no pair counts twice. A cell's members and
its queries are split into blocks of at most BLOCK rows, and a task compares one block with another:
it returns each vector's number of links and a spanning forest of them, never the pairs.

Equal vectors are one node, weighted by how many distinct vec_ids hold it. Defined results: vectors
that are null, empty, zero or hold null or non-finite components, and those without a label or vec_id,
link with nothing; vectors of different lengths never link; rows that share a vec_id are one vector, if
their vectors differ each row has its own links; ties have no effect, as every link counts; a vector of
any length is one row; extra columns are left out; an empty table gives no rows.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import saved, table
from .components import components

THRESHOLD, RECALL, SAMPLE, BLOCK, PER_CELL = 0.93, 0.995, 8192, 512, 48
SAMPLE_PER_WORD, MAX_WORDS = 16, 16_384
#: A table of cells is broadcast up to so many rows of 16 bytes; beyond, the join shuffles.
SMALL = 1_000_000


def kmeans(x: np.ndarray, k: int, rounds: int = 15, seed: int = 1) -> np.ndarray:
    rng = np.random.default_rng(seed)
    centres = x[rng.choice(len(x), k, replace=False)].copy()
    for _ in range(rounds):
        square = (centres**2).sum(1)
        step = max(1, (1 << 22) // k)
        near = np.concatenate([(square - 2 * x[i : i + step] @ centres.T).argmin(1) for i in range(0, len(x), step)])
        by = np.argsort(near, kind="stable")
        own, first, count = np.unique(near[by], return_index=True, return_counts=True)
        centres[own] = np.add.reduceat(x[by], first) / count[:, None]
    return centres


class MultiIndex:
    def __init__(self, unit: np.ndarray, k: int, threshold: float = THRESHOLD, recall: float = RECALL, seed: int = 9):
        half = unit.shape[1] // 2
        self.half, self.k = half, min(k, len(np.unique(unit, axis=0)))
        self.books = [kmeans(unit[:, :half], self.k), kmeans(unit[:, half:], self.k)]
        rng = np.random.default_rng(seed)
        base = unit[rng.integers(0, len(unit), 4000)]
        side = rng.normal(size=base.shape)
        side -= (side * base).sum(1, keepdims=True) * base
        norm = np.linalg.norm(side, axis=1, keepdims=True)
        turned = threshold * base + np.sqrt(1 - threshold**2) * side / np.where(norm > 0, norm, 1)
        excess = []
        for i in range(0, len(base), 256):  # a cell's cost is the sum of two distances, so no grid is built
            (a, b), target = self.parts(base[i : i + 256]), self.cells(turned[i : i + 256])
            row = np.arange(len(target))
            excess.append(a[row, target // self.k] + b[row, target % self.k] - a.min(1) - b.min(1))
        self.slack = float(np.quantile(np.concatenate(excess), recall))

    def parts(self, unit: np.ndarray) -> list[np.ndarray]:
        halves = (unit[:, : self.half], unit[:, self.half :])
        return [((h**2).sum(1)[:, None] - 2 * h @ b.T + (b**2).sum(1)).clip(0) for h, b in zip(halves, self.books, strict=True)]

    def cells(self, unit: np.ndarray) -> np.ndarray:
        a, b = self.parts(unit)
        return a.argmin(1) * self.k + b.argmin(1)

    def visited(self, unit: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(row, cell) of every visit. Codewords in order of distance; a pair of ranks is tried only
        while its sum is within the slack, the frontier of the multi-sequence traversal."""
        a, b = self.parts(unit)
        order = [np.argsort(p, 1) for p in (a, b)]
        near = [np.take_along_axis(p, o, 1) for p, o in zip((a, b), order, strict=True)]
        limit = near[0][:, 0] + near[1][:, 0] + self.slack
        rows, cells = [], []
        for i in range(self.k):
            open_rows = np.flatnonzero(near[0][:, i] + near[1][:, 0] <= limit)
            if not len(open_rows):
                break
            at, j = np.nonzero(near[0][open_rows, i][:, None] + near[1][open_rows] <= limit[open_rows][:, None])
            at = open_rows[at]
            rows.append(at)
            cells.append(order[0][at, i] * self.k + order[1][at, j])
        return np.concatenate(rows), np.concatenate(cells)


def _matrix(column: pa.Array, dim: int) -> np.ndarray:
    column = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    return np.asarray(column.flatten(), dtype=np.float64).reshape(-1, dim)


def _found(x, y, ids_x, ids_y, threshold):
    norms = np.linalg.norm(x, axis=1)[:, None] * np.linalg.norm(y, axis=1)[None, :]
    return np.nonzero(((x @ y.T) / norms >= threshold) & (ids_x[:, None] < ids_y[None, :]))


def spanning_forest(i: np.ndarray, j: np.ndarray, n: int) -> np.ndarray:
    """The smallest connected node of each of ``n`` nodes under links i-j, by label passing."""
    label = np.arange(n)
    while True:
        least = label.copy()
        np.minimum.at(least, i, label[j])
        np.minimum.at(least, j, label[i])
        least = least[least]
        if (least == label).all():
            return label
        label = least


def _linked(nodes: DataFrame, dim: int, threshold: float, block: int) -> DataFrame:
    """``nodes`` (group, rep, weight, embedding) of one length: rows (a, b, n): b null: a has n more
    links; else a link of the spanning forest."""
    total = nodes.count()
    groups = max(1, nodes.select("group").distinct().count())
    k = int(np.clip(np.sqrt(total / groups / PER_CELL), 1, MAX_WORDS))
    taken = nodes.orderBy(F.xxhash64("rep")).select("embedding").limit(max(SAMPLE, SAMPLE_PER_WORD * k)).toPandas()["embedding"].to_list()
    sample = np.stack(taken).astype(np.float64)
    sample /= np.linalg.norm(sample, axis=1, keepdims=True)
    index = MultiIndex(sample, k, threshold)

    def visits(batches):
        for batch in batches:
            x = _matrix(batch.column("embedding"), dim)
            unit = x / np.linalg.norm(x, axis=1, keepdims=True)
            step = max(16, min(2048, (1 << 20) // index.k))
            for lo in range(0, len(x), step):
                part = unit[lo : lo + step]
                row, cell = index.visited(part)
                row = np.concatenate([row, np.arange(len(part))])
                cell = np.concatenate([cell, index.cells(part)])
                query = np.ones(len(row), bool)
                query[len(row) - len(part) :] = False
                own = batch.slice(lo, len(part)).take(pa.array(row))
                yield pa.RecordBatch.from_arrays([*own.columns, pa.array(cell, pa.int32()), pa.array(query)], names=[*own.schema.names, "cell", "query"])

    visited = saved(nodes.mapInArrow(visits, "group int, rep long, weight long, embedding array<float>, cell int, query boolean"))
    blocks = lambda q: F.greatest(F.ceil(F.count_if(F.col("query") == q) / block), F.lit(1))
    large = visited.groupBy("group", "cell").agg(blocks(True).alias("q_blocks"), blocks(False).alias("m_blocks")).filter("q_blocks > 1 or m_blocks > 1")
    large = saved(large)
    dealt = visited.join(F.broadcast(large) if large.count() <= SMALL else large, ["group", "cell"], "left")
    own = lambda n: F.pmod(F.xxhash64("rep"), F.coalesce(n, F.lit(1))).cast("int")
    every = lambda n: F.sequence(F.lit(0), (F.coalesce(n, F.lit(1)) - 1).cast("int"))
    dealt = dealt.withColumn("to", F.when(F.col("query"), F.transform(every(F.col("m_blocks")), lambda m: F.struct(own(F.col("q_blocks")).alias("q"), m.alias("m")))).otherwise(F.transform(every(F.col("q_blocks")), lambda q: F.struct(q.alias("q"), own(F.col("m_blocks")).alias("m")))))
    dealt = dealt.select("group", "cell", "query", "rep", "weight", "embedding", F.explode("to").alias("to"))

    def compare(rows: pa.Table) -> pa.Table:
        query = rows.column("query").to_numpy()
        x, ids, weight = _matrix(rows.column("embedding"), dim), rows.column("rep").to_numpy(), rows.column("weight").to_numpy()
        q, m = np.flatnonzero(query), np.flatnonzero(~query)
        a, b, n = [], [], []
        if len(q) and len(m):
            i, j = _found(x[q], x[m], ids[q], ids[m], threshold)
            if len(i):
                links = np.bincount(q[i], weight[m[j]], minlength=len(ids)) + np.bincount(m[j], weight[q[i]], minlength=len(ids))
                nodes_, where = np.unique(np.concatenate([ids[q[i]], ids[m[j]]]), return_inverse=True)
                tree = spanning_forest(where[: len(i)], where[len(i) :], len(nodes_))
                moved = np.flatnonzero(tree != np.arange(len(tree)))
                some = np.flatnonzero(links)
                a = [*ids[some].tolist(), *nodes_[moved].tolist()]
                b = [*[None] * len(some), *nodes_[tree[moved]].tolist()]
                n = [*links[some].astype(int).tolist(), *[0] * len(moved)]
        return pa.table([pa.array(a, pa.int64()), pa.array(b, pa.int64()), pa.array(n, pa.int64())], names=["a", "b", "n"])

    # Dealt by block as well: clustering by cell alone would do for Spark and put a hot cell into one task.
    dealt = dealt.select("group", "cell", F.col("to.q").alias("q"), F.col("to.m").alias("m"), "query", "rep", "weight", "embedding")
    return dealt.repartition("group", "cell", "q", "m").groupBy("group", "cell", "q", "m").applyInArrow(compare, "a long, b long, n long")


def near_duplicates(vectors: DataFrame, threshold: float = THRESHOLD, block: int = BLOCK) -> DataFrame:
    """(vec_id, n_links, component_id, kept) of every row of ``vectors`` (vec_id, embedding, label)."""
    finite = lambda v: v.isNotNull() & ~F.isnan(v) & (F.abs(v) < float("inf"))
    sound = F.col("label").isNotNull() & F.col("embedding").isNotNull() & F.forall("embedding", finite) & F.exists("embedding", lambda v: v != 0)
    rows = vectors.select("vec_id", F.col("label").cast("int").alias("group"), F.col("embedding").cast("array<float>").alias("embedding"), F.coalesce(sound, F.lit(False)).alias("sound"))
    rows = rows.withColumns({"h1": F.xxhash64("embedding"), "h2": F.xxhash64(F.lit(1), "embedding"), "dim": F.coalesce(F.size("embedding"), F.lit(0))})
    nodes = saved(
        rows.filter("sound and vec_id is not null").groupBy("group", "h1", "h2").agg(F.min("vec_id").alias("rep"), F.count_distinct("vec_id").alias("weight"), F.first("embedding").alias("embedding"), F.first("dim").alias("dim"))
    )
    parts = [_linked(nodes.filter(F.col("dim") == d).select("group", "rep", "weight", "embedding"), d, threshold, block) for d in sorted(r[0] for r in nodes.select("dim").distinct().collect())]
    narrow = rows.select("vec_id", "group", "h1", "h2", "sound")
    reps = nodes.select("group", "h1", "h2", "rep", "weight")
    out = narrow.join(reps, ["group", "h1", "h2"], "left")
    if not parts:
        return out.select("vec_id", F.lit(0).cast("long").alias("n_links"), F.col("vec_id").alias("component_id"), F.lit(True).alias("kept"))
    found = parts[0]
    for p in parts[1:]:
        found = found.union(p)
    found = saved(found)
    degree = found.filter("b is null").groupBy(F.col("a").alias("rep")).agg(F.sum("n").alias("n"))
    placed = components(found.filter("b is not null").select("a", "b")).select(F.col("node").alias("rep"), "component")
    out = out.join(degree, "rep", "left").join(placed, "rep", "left")
    linked = F.col("sound") & F.col("rep").isNotNull()
    component = F.when(linked, F.coalesce("component", "rep")).otherwise(F.col("vec_id"))
    return out.select(
        "vec_id",
        F.when(linked, F.col("weight") - 1 + F.coalesce("n", F.lit(0))).otherwise(0).cast("long").alias("n_links"),
        component.alias("component_id"),
        F.coalesce(F.col("vec_id") == component, F.lit(True)).alias("kept"),
    )


def op4_embedding_near_dedup(spark, sf_dir: str) -> DataFrame:
    return near_duplicates(table(spark, sf_dir, "embeddings").select("vec_id", "embedding", "label"))
