"""How well two labellings of the same rows agree, from their contingency table alone."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

MOST_CELLS = 250_000  # of one contingency table whose classes are matched


def contingency(rows: DataFrame, truth: str, found: str, *by: str) -> DataFrame:
    """(by, truth, found, n); rows without one of the labels are left out."""
    return rows.filter(F.col(truth).isNotNull() & F.col(found).isNotNull()).groupBy(*by, F.col(truth).alias("truth"), F.col(found).alias("found")).agg(F.count("*").alias("n"))


def agreement(table: DataFrame, *by: str) -> DataFrame:
    """(by, n, ari, nmi): adjusted Rand index by pair counts, normalised mutual information (arithmetic mean).

    Two labellings of one class each, or of single rows each, agree fully.
    """
    n = F.col("n").cast("double")
    pairs = lambda c: F.col(c).cast("double") * (F.col(c) - 1) / 2
    sides = []
    for side in ("truth", "found"):
        sums = table.groupBy(*by, side).agg(F.sum("n").alias("m"))
        sides.append(sums.groupBy(*by).agg(F.sum(pairs("m")).alias(f"{side}_pairs"), F.sum(F.col("m") * F.log("m")).alias(f"{side}_log")))
    whole = table.groupBy(*by).agg(F.sum("n").alias("n"), F.sum(pairs("n")).alias("same"), F.sum(n * F.log("n")).alias("both_log"))
    met = whole
    for side in sides:
        # Without groups both sides are one row: the join is on a constant.
        met = met.join(side, list(by)) if by else met.withColumn("one", F.lit(1)).join(side.withColumn("one", F.lit(1)), "one").drop("one")
    all_pairs = F.greatest(n * (n - 1) / 2, F.lit(1.0))
    expected = F.col("truth_pairs") * F.col("found_pairs") / all_pairs
    top = (F.col("truth_pairs") + F.col("found_pairs")) / 2
    ari = F.when(F.abs(top - expected) < 1e-12, 1.0).otherwise((F.col("same") - expected) / (top - expected))
    h = lambda side: F.log(n) - F.col(f"{side}_log") / n
    mutual = F.log(n) + (F.col("both_log") - F.col("truth_log") - F.col("found_log")) / n
    mean = (h("truth") + h("found")) / 2
    nmi = F.when(mean < 1e-12, 1.0).otherwise(F.greatest(mutual, F.lit(0.0)) / mean)
    return met.select(*by, F.col("n").cast("long").alias("n"), ari.alias("ari"), nmi.alias("nmi"))


def best_matching(gain: list[list[float]]) -> list[tuple[int, int]]:
    """Pairs (row, column) of a one-to-one matching with the greatest sum (shortest augmenting paths)."""
    n_rows, n_cols = len(gain), len(gain[0]) if gain else 0
    if n_rows > n_cols:
        turned = best_matching([[gain[i][j] for i in range(n_rows)] for j in range(n_cols)])
        return sorted((i, j) for j, i in turned)
    row_price, col_price, owner = [0.0] * n_rows, [0.0] * n_cols, [-1] * n_cols
    for start in range(n_rows):
        reach, via, done, i, last = [float("inf")] * n_cols, [-1] * n_cols, [False] * n_cols, start, -1
        while True:
            for j in range(n_cols):
                slack = -gain[i][j] - row_price[i] - col_price[j]
                if not done[j] and slack < reach[j]:
                    reach[j], via[j] = slack, last
            near = min((j for j in range(n_cols) if not done[j]), key=reach.__getitem__)
            step = reach[near]
            row_price[start] += step
            for j in range(n_cols):
                if done[j]:
                    row_price[owner[j]] += step
                    col_price[j] -= step
                else:
                    reach[j] -= step
            done[near], last = True, near
            if owner[near] < 0:
                break
            i = owner[near]
        while last >= 0:
            before = via[last]
            owner[last] = start if before < 0 else owner[before]
            last = before
    return sorted((i, j) for j, i in enumerate(owner) if i >= 0)


def matched_accuracy(table: DataFrame, *by: str) -> DataFrame:
    """(by, n, accuracy): the share of rows that agree when each truth is matched with one found label at best.

    Only the contingency table's rows of a group go to its one task, and no group may hold more than MOST_CELLS.
    """
    held = F.collect_list(F.struct(F.col("truth").cast("string").alias("t"), F.col("found").cast("string").alias("f"), F.col("n").cast("double").alias("n")))

    def best(cells: list) -> float:
        if not cells:
            return None
        truth, found = sorted({c["t"] for c in cells}), sorted({c["f"] for c in cells})
        if len(truth) * len(found) > MOST_CELLS:
            raise ValueError(f"{len(truth)} by {len(found)} classes are too many to match")
        gain = [[0.0] * len(found) for _ in truth]
        for c in cells:
            gain[truth.index(c["t"])][found.index(c["f"])] += c["n"]
        return sum(gain[i][j] for i, j in best_matching(gain)) / sum(c["n"] for c in cells)

    grouped = table.groupBy(*by).agg(F.sum("n").alias("n"), held.alias("cells"))
    return grouped.select(*by, "n", F.udf(best, "double")("cells").alias("accuracy"))
