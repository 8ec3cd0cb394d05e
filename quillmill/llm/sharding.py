"""Sharding by a minimax contiguous partition, in DataFrame operations.

Rows of equal text are one atomic group; groups stand in the order of a 64-bit hash of their text.
The smallest capacity with which a greedy pass needs no more than the given number of shards is found
by binary search, and the order is cut where that pass cuts. Groups larger than an even share stand
first and get shards of their own, so that they don't raise every other shard's capacity.

The search runs on the driver over segments of the order (hash prefixes), never over groups: a greedy
pass that may cut inside segments bounds the answer from below, one that may not bounds it from
above, and only segments which some cut between both bounds may touch are split further, 8 bits at a
time, until each of those is a single group. So the driver holds about 65,536 sums at first and a
few thousand more each time, at every size, and the capacity found is exact.

Defined results: a null text counts as no bytes and shares the group of empty texts; equal rows get
slots of their own; an empty table gives no rows.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import saved, table

FIRST_BITS = 16
NEXT_BITS = 8
ROW_BYTES = 16


class Segments:
    """Runs of the order: first key, bytes, whether it is one group, bits of its prefix."""

    def __init__(self, first, total, atomic, bits):
        by = np.argsort(first)
        self.first, self.total, self.atomic, self.bits = first[by], total[by], atomic[by], bits[by]

    def replaced(self, gone: np.ndarray, first, total, atomic, bits) -> Segments:
        keep = ~gone
        return Segments(
            np.concatenate([self.first[keep], first]),
            np.concatenate([self.total[keep], total]),
            np.concatenate([self.atomic[keep], atomic]),
            np.concatenate([self.bits[keep], bits]),
        )


def large_groups(total: np.ndarray, n_shards: int) -> np.ndarray:
    """Segments over an even share of what remains once all larger ones have shards of their own."""
    alone = np.zeros(len(total), bool)
    while True:
        left = n_shards - alone.sum()
        share = total[~alone].sum() / max(left, 1)
        more = ~alone & (total > share)
        if not more.any() or left <= 1:
            return alone
        alone[np.flatnonzero(more)[: left - 1]] = True


def greedy(prefix: np.ndarray, capacity: int) -> list[int] | None:
    """Ends of the shards cut between segments with sums ``prefix``; None if a segment is too large."""
    at, ends = 0, []
    while at < len(prefix) - 1:
        nxt = int(np.searchsorted(prefix, prefix[at] + capacity, "right")) - 1
        if nxt <= at:
            return None
        ends.append(nxt)
        at = nxt
    return ends


def smallest(feasible, low: int, high: int) -> int:
    while low < high:
        mid = (low + high) // 2
        low, high = (low, mid) if feasible(mid) else (mid + 1, high)
    return low


def plan_step(seg: Segments, n_shards: int):
    """(segments to split, groups alone, cuts): a mask, first keys of the groups that get shards of
    their own, and first keys of the shards after the first of all others; None until nothing is to split."""
    alone = large_groups(seg.total, n_shards)
    coarse = ~seg.atomic & (alone | (seg.total > max(1, seg.total.sum() // (n_shards * 256))))
    if coarse.any():
        return coarse, None, None
    rest = np.flatnonzero(~alone)
    prefix = np.concatenate([[0], np.cumsum(seg.total[rest])])
    room, whole = n_shards - int(alone.sum()), int(prefix[-1])
    lower = max(1, -(-whole // room))

    def feasible(capacity):
        ends = greedy(prefix, capacity)
        return ends is not None and len(ends) <= room

    upper = smallest(feasible, lower, max(whole, 1))
    unsure = np.zeros(len(rest), bool)
    early = 0
    for k in range(room if not seg.atomic.all() else 0):
        early = max(early, int(np.searchsorted(prefix, prefix[early] + lower, "right")) - 1)
        unsure[early : int(np.searchsorted(prefix, (k + 1) * upper, "left")) + 1] = True
    split = np.zeros(len(seg.total), bool)
    split[rest] = unsure & ~seg.atomic[rest]
    if split.any():
        return split, None, None
    return split, seg.first[alone].tolist(), seg.first[rest[greedy(prefix, upper)[:-1]]].tolist() if len(rest) else []


def cut_keys(rows: DataFrame, n_shards: int) -> tuple[list[int], list[int], int]:
    """Over ``rows`` (h, size): keys of the groups with shards of their own, first keys of the shards
    after the first of all others, and the number of rows."""

    def sums(df, bits):
        got = df.groupBy(F.shiftright("h", 64 - bits).alias("p")).agg(F.min("h"), F.max("h"), F.sum("size"), F.count("*")).toPandas().to_numpy(dtype=np.int64)
        got = got.reshape(-1, 5)
        return got[:, 1], got[:, 3], got[:, 1] == got[:, 2], np.full(len(got), bits), int(got[:, 4].sum())

    *columns, n_rows = sums(rows, FIRST_BITS)
    if not n_rows:
        return [], [], 0
    seg = Segments(*columns)
    while True:
        split, alone, cuts = plan_step(seg, n_shards)
        if cuts is not None:
            return alone, cuts, n_rows
        for bits in sorted(set(seg.bits[split].tolist())):
            gone = split & (seg.bits == bits)
            keys = rows.sparkSession.createDataFrame([(int(k) >> (64 - bits),) for k in seg.first[gone]], "p long")
            inside = rows.withColumn("p", F.shiftright("h", 64 - bits)).join(F.broadcast(keys), "p", "left_semi")  # bounded: see above
            *columns, _ = sums(inside, bits + NEXT_BITS)
            seg, split = seg.replaced(gone, *columns), np.zeros(0, bool)
            break


def shard(docs: DataFrame, n_shards: int = 40, rows_per_slice: int = 20_000) -> DataFrame:
    """Every row of ``docs`` (doc_id, text) with its size, checksum, shard and slot in the shard."""
    raw = F.coalesce("text", F.lit(""))
    rows = saved(
        docs.select(
            "doc_id",
            (F.octet_length(raw).cast("long") + ROW_BYTES).alias("size"),
            F.crc32(raw.cast("binary")).alias("text_crc32"),
            F.xxhash64(raw).alias("h"),
        )
    )
    alone, cuts, n_rows = cut_keys(rows.select("h", "size"), n_shards)
    number = F.lit(len(alone))
    for k in cuts:
        number = number + (F.col("h") >= F.lit(k)).cast("int")
    for i, k in enumerate(alone):
        number = F.when(F.col("h") == F.lit(k), i).otherwise(number)
    # Slots: rows of a shard fall into slices by hash; a slice's first slot is the count of those before it.
    slices = max(16, n_rows // (n_shards * rows_per_slice) + 1)
    placed = rows.withColumn("shard", number).withColumn("slice", F.pmod(F.xxhash64("doc_id", "h"), F.lit(slices)))
    counts = placed.groupBy("shard", "slice").agg(F.count("*").alias("n"))
    before = Window.partitionBy("shard").orderBy("slice").rowsBetween(Window.unboundedPreceding, -1)
    offsets = counts.select("shard", "slice", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("offset"))
    inside = Window.partitionBy("shard", "slice").orderBy("h", "doc_id")
    ranked = placed.withColumn("rank", F.row_number().over(inside) - 1)
    return ranked.join(offsets, ["shard", "slice"]).select(
        "doc_id",
        "size",
        "text_crc32",
        F.lit("bytes").alias("law"),
        "shard",
        (F.col("offset") + F.col("rank")).cast("long").alias("slot"),
        F.lit(None).cast("int").alias("grown_shard"),
    )


def op6_sharding(spark, sf_dir: str) -> DataFrame:
    return shard(table(spark, sf_dir, "documents").select("doc_id", "text"))
