"""Document fingerprints by a randomised edit embedding.

A whole text walks: at each step it copies its current byte and advances by a random bit that all
texts share for that step and byte. Two texts at a small edit distance soon walk in step again, so
edit distance becomes Hamming distance of the copies, the embedding. A walk may fail to meet again, so
WALKS walks with coins of their own embed each text.

Each walk has SLOTS slots, and a slot samples one place of the embedding, read as a hash of the RUN
bytes copied from there. Its place is the last record, before the walk's end, of a random sequence that
all texts share: uniform over the walk, whatever the length, and the same place in walks of lengths L
and M with probability min(L, M) / max(L, M). A fingerprint is the slots' bytes, walk by walk.

BAND slots in a row make a band; texts that agree on a band are candidates (:func:`near_documents`),
and candidates are verified by their fingerprints' likeness: the share of equal slots of the walk in
which they agree most, an estimate of the share of the embedding that they have in common.

Defined results: null texts are empty; texts without bytes have the fingerprint of zeros, which is like
itself (1) and like no other (0); equal texts have equal fingerprints; rows of equal doc_id follow one
another by a hash of their text, null doc_ids come last; repeated rows give rows of their own; an empty
table gives no rows; extra columns are left out. A text of any length walks byte by byte: time and memory
grow in proportion to its length.
"""

from __future__ import annotations

import bisect
import hashlib

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import Texts, mix64, per_document, pieces, raw_texts, saved, scan_partitions, short_batches, table
from .components import components
from .embeddings import spanning_forest

WALKS, SLOTS, RUN, BAND = 4, 48, 3, 3
COINS = 4096  # steps after which the shared coins repeat
PIECE = 2 << 20
END = 255  # a byte that UTF-8 doesn't use; its coin is 0, so a walk stays at its text's end
_G = np.uint64(0x9E3779B97F4A7C15)


def _random(*shape: int, salt: int) -> np.ndarray:
    n = int(np.prod(shape))
    return mix64((np.arange(n, dtype=np.uint64) + np.uint64(salt << 32)) * _G).reshape(shape)


#: One shared advance bit for each step, walk and byte.
_ADVANCE = (_random(COINS, WALKS, 256, salt=1) & np.uint64(1)).astype(np.int8)
_ADVANCE[:, :, END] = 0
_ADVANCE = _ADVANCE.reshape(COINS, WALKS * 256)
#: What each byte of a run adds to a slot.
_VALUE = (_random(RUN, 256, salt=2) >> np.uint64(40)).astype(np.uint8)


def _events(longest: int = 1 << 40) -> dict[int, list[tuple[int, int]]]:
    """step -> [(slot, byte of the run)] of all slots' records up to ``longest``.

    After a record at t the next is the first place past (t + 1) / u - 1, u uniform: that is how records
    of a random sequence fall. A record cuts off the run of the one before.
    """
    events: dict[int, list[tuple[int, int]]] = {}
    for slot in range(WALKS * SLOTS):
        u = (_random(96, salt=100 + slot) >> np.uint64(11)).astype(float) / (1 << 53)
        records, t = [0], 0
        for x in u:
            t = max(t + 1, int(np.ceil((t + 1) / max(x, 1e-12))) - 1)
            if t > longest:
                break
            records.append(t)
        for t, following in zip(records, [*records[1:], longest], strict=True):
            for k in range(min(RUN, following - t)):
                events.setdefault(t + k, []).append((slot, k))
    return events


_EVENTS = {t: [(k, np.array(sorted(s for s, j in found if j == k))) for k in sorted({j for _, j in found})] for t, found in _events().items()}


def fingerprints(texts: Texts) -> np.ndarray:
    """uint8 [documents, WALKS * SLOTS]."""
    n = len(texts)
    length = np.diff(texts.offsets)
    start = texts.offsets[:-1] + np.arange(n)
    data = np.full(len(texts.data) + n + 1, END, np.uint8)
    data[np.arange(len(texts.data)) + np.repeat(np.arange(n), length)] = texts.data
    # One copy a walk; a copy's bytes are raised so that they look up their walk's coins.
    steps_of = np.concatenate([data.astype(np.int16) + 256 * w for w in range(WALKS)])
    some = np.flatnonzero(length > 0)
    out = np.zeros((WALKS * SLOTS, n), np.uint8)
    live = np.tile(some, WALKS)
    walk = np.repeat(np.arange(WALKS), len(some))
    at = start[live] + walk * len(data)
    step = 0
    while len(live):
        char = steps_of.take(at)
        for k, slots in _EVENTS.get(step, ()):
            # A walk's rows stand together; those that have ended keep what they hold.
            edge = np.searchsorted(walk, np.arange(WALKS + 1))
            byte = char & 255
            for slot in slots:
                own = slice(edge[slot // SLOTS], edge[slot // SLOTS + 1])
                value, rows = _VALUE[k].take(byte[own]), live[own]
                if k:
                    out[slot, rows] += value
                else:
                    going = byte[own] != END
                    out[slot, rows[going]] = value[going]
        at += _ADVANCE[step % COINS].take(char)
        step += 1
        if step % 64 == 0:
            going = (steps_of.take(at) & 255) != END
            if going.sum() <= 0.95 * len(going):
                live, walk, at = live[going], walk[going], at[going]
    return out.T.copy()


def likeness(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """0 to 1; only texts without bytes have zeros alone."""
    same = (a == b).reshape(len(a), WALKS, SLOTS).mean(2).max(1)
    empty_a, empty_b = ~a.any(1), ~b.any(1)
    return np.where(empty_a | empty_b, (empty_a & empty_b).astype(float), same)


def to_hex(prints: np.ndarray) -> list[str]:
    whole = prints.tobytes().hex()
    width = 2 * WALKS * SLOTS
    return [whole[i * width : (i + 1) * width] for i in range(len(prints))]


def from_hex(prints: list[str]) -> np.ndarray:
    return np.frombuffer(bytes.fromhex("".join(prints)), np.uint8).reshape(-1, WALKS * SLOTS)


def near_documents(docs: DataFrame, threshold: float = 0.7, block: int = 512) -> DataFrame:
    """(doc_id, component_id) of every row of ``docs`` (doc_id, text): documents whose fingerprints share a
    band and are alike to at least ``threshold`` are linked; component_id is the smallest doc_id reachable.

    Equal fingerprints are one node. A band's nodes are split into blocks of at most ``block`` on average
    and compared block by block; a task returns a spanning forest of the links, never the pairs. Texts
    without bytes and null doc_ids link with nothing.
    """
    prints = saved(fingerprint_documents(docs))
    zeros = "00" * (WALKS * SLOTS)
    nodes = saved(prints.filter((F.col("fingerprint") != zeros) & F.col("doc_id").isNotNull()).groupBy("fingerprint").agg(F.min("doc_id").alias("rep")))
    n_bands, width = WALKS * SLOTS // BAND, 2 * BAND
    band = F.posexplode(F.transform(F.sequence(F.lit(0), F.lit(n_bands - 1)), lambda i: F.substring(F.col("fingerprint"), i * width + 1, F.lit(width)))).alias("band", "key")
    entries = nodes.select("rep", "fingerprint", band)
    sizes = entries.groupBy("band", "key").agg(F.count("*").alias("n")).filter("n > 1").withColumn("blocks", F.ceil(F.col("n") / block).cast("int")).drop("n")
    own = F.pmod(F.xxhash64("rep"), "blocks").cast("int")
    held = entries.join(sizes, ["band", "key"]).withColumn("own", own)
    # A block meets itself and all later ones: (p, q) with p <= q; each row goes to those of its block.
    to = F.transform(F.sequence(F.lit(0), F.col("blocks") - 1), lambda o: F.struct(F.least("own", o).alias("p"), F.greatest("own", o).alias("q")))
    dealt = held.select("band", "key", "rep", "fingerprint", "own", F.explode(to).alias("to")).select("band", "key", F.col("to.p").alias("p"), F.col("to.q").alias("q"), "rep", "fingerprint", "own")
    dealt = dealt.repartition("band", "key", "p", "q").sortWithinPartitions("band", "key", "p", "q")

    def compare(batches):
        """Groups stand together in a partition; one group, at most about two blocks, is held at a time."""
        key, rows = None, []
        for batch in batches:
            columns = [batch.column(c).to_pylist() for c in ("band", "key", "p", "q", "rep", "fingerprint", "own")]
            for r in zip(*columns, strict=True):
                if r[:4] != key:
                    yield from links(key, rows)
                    key, rows = r[:4], []
                rows.append(r[4:])
        yield from links(key, rows)

    def links(key, rows):
        if len(rows) < 2:
            return
        ids, marks, own = np.array([r[0] for r in rows]), from_hex([r[1] for r in rows]), np.array([r[2] for r in rows])
        i, j = [], []
        for k in range(len(rows) - 1):
            others = np.arange(k + 1, len(rows))
            if key[2] != key[3]:
                others = others[own[others] != own[k]]
            if len(others):
                near = others[likeness(np.broadcast_to(marks[k], (len(others), marks.shape[1])), marks[others]) >= threshold]
                i.append(np.full(len(near), k))
                j.append(near)
        if not i or not sum(map(len, i)):
            return
        tree = spanning_forest(np.concatenate(i), np.concatenate(j), len(rows))
        moved = np.flatnonzero(tree != np.arange(len(tree)))
        yield pa.RecordBatch.from_arrays([pa.array(ids[moved], pa.int64()), pa.array(ids[tree[moved]], pa.int64())], names=["a", "b"])

    found = components(saved(dealt.mapInArrow(compare, "a long, b long")))
    out = prints.join(nodes, "fingerprint", "left").join(found.withColumnRenamed("node", "rep"), "rep", "left")
    return out.select("doc_id", F.when(F.col("doc_id").isNotNull(), F.coalesce("component", "rep", "doc_id")).alias("component_id"))


def fingerprint_documents(docs: DataFrame) -> DataFrame:
    """(doc_id, fingerprint) of every row of ``docs`` (doc_id, text)."""
    return per_document(docs.select("doc_id", "text"), lambda t: {"fingerprint": to_hex(fingerprints(t))}, "fingerprint string")


def with_next(docs: DataFrame) -> DataFrame:
    """Rows dealt to slices of consecutive keys (doc_id, hash of the text) so that each row's successor is
    in its slice.

    The order is descending doc_id (equal ids by text hash, null ids last); after the last comes the
    first. A slice's last row's successor, the first row of the slice below, is copied into it (``extra``).
    The driver holds the bounds of each slice alone; texts shuffle once.
    """
    short_batches(docs.sparkSession)
    n = scan_partitions(docs)
    keyed = docs.select("doc_id", F.xxhash64("text").alias("h"), "text")

    def bounds(batches):
        lo = hi = None
        for b in batches:
            keys = [(i is not None, i or 0, h) for i, h in zip(b.column("doc_id").to_pylist(), b.column("h").to_pylist(), strict=True)]
            if keys:
                lo, hi = min([*keys, lo or max(keys)]), max([*keys, hi or min(keys)])
        if lo is not None:
            yield pa.RecordBatch.from_pydict({k: [v] for k, v in zip(("lo0", "lo1", "lo2", "hi0", "hi1", "hi2"), (*lo, *hi), strict=True)})

    ends = keyed.select("doc_id", "h").repartitionByRange(n, "doc_id", "h").mapInArrow(bounds, "lo0 boolean, lo1 long, lo2 long, hi0 boolean, hi1 long, hi2 long")
    rows = sorted(tuple(r) for r in ends.collect())
    lows = [r[:3] for r in rows]
    tops = {r[3:]: k for k, r in enumerate(rows)}
    last = len(rows) - 1

    @F.pandas_udf("array<int>")
    def slices(ids, known, hashes):
        out = []
        for key in zip(known.tolist(), ids.tolist(), hashes.tolist(), strict=True):
            to = [max(bisect.bisect_right(lows, key) - 1, 0)]
            if key in tops:
                to.append(0 if tops[key] == last else tops[key] + 1)
            out.append(to)
        return pd.Series(out)

    # Only keys go through Python here; texts stay in the JVM.
    dealt = keyed.withColumn("to", slices(F.coalesce("doc_id", F.lit(0)), F.col("doc_id").isNotNull(), "h"))
    dealt = dealt.select("doc_id", "h", "text", F.posexplode("to").alias("extra", "slice"))
    return dealt.repartition(n, "slice").sortWithinPartitions("slice", "extra", F.col("doc_id").desc_nulls_last(), F.col("h").desc())


def fingerprint_edits(docs: DataFrame) -> DataFrame:
    """Fingerprints of every text, of its edited text, and their likenesses.

    The edited text replaces the last floor(n/3) code points by the first as many (or all) of the next
    document's. Null texts are empty; a lone row is its own successor; an empty table gives no rows.
    """
    schema = "doc_id long, n_chars long, edited_sha256 string, fingerprint string, edited_fingerprint string, near_edited double, near_next double"

    def prints(raw: list[bytes]) -> np.ndarray:
        return np.concatenate([fingerprints(p) for _, _, p in pieces(raw_texts(pa.array(raw, pa.large_binary()).cast(pa.large_string())), 4 * PIECE)])

    def run(batches):
        pending, chars = [], 0
        for batch in batches:
            ids, extra, slice_ = (batch.column(c).to_pylist() for c in ("doc_id", "extra", "slice"))
            source = raw_texts(batch.column("text"))
            for i in range(len(ids)):
                pending.append((ids[i], slice_[i], extra[i], source.text(i).decode("utf-8")))
                chars += len(pending[-1][3])
                if len(pending) > 1 and chars > PIECE:
                    yield from emit(pending)
                    pending = pending[-1:]
                    chars = len(pending[0][3])
        if len(pending) > 1:
            yield from emit(pending)

    def emit(rows):
        """Rows but the last have their successor after them; extra rows and ends of slices are no results."""
        texts, edited = [r[3] for r in rows], []
        for t, following in zip(texts, texts[1:], strict=False):
            k = len(t) // 3
            edited.append((t[: len(t) - k] + following[:k]).encode() if k else t.encode())
        both = prints([*(t.encode() for t in texts), *edited])  # walks run side by side
        own, changed = both[: len(texts)], both[len(texts) :]
        keep = [i for i in range(len(rows) - 1) if not rows[i][2] and rows[i][1] == rows[i + 1][1]]
        a, b, c = own[:-1][keep], changed[keep], own[1:][keep]
        yield pa.RecordBatch.from_arrays(
            [
                pa.array([rows[i][0] for i in keep], pa.int64()),
                pa.array([len(texts[i]) for i in keep], pa.int64()),
                pa.array([hashlib.sha256(edited[i]).hexdigest() for i in keep], pa.string()),
                pa.array(to_hex(a), pa.string()),
                pa.array(to_hex(b), pa.string()),
                pa.array(likeness(a, b)),
                pa.array(likeness(a, c)),
            ],
            names=["doc_id", "n_chars", "edited_sha256", "fingerprint", "edited_fingerprint", "near_edited", "near_next"],
        )

    return with_next(docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text"))).mapInArrow(run, schema)


def op10_fingerprint(spark, sf_dir: str) -> DataFrame:
    return fingerprint_edits(table(spark, sf_dir, "documents"))
