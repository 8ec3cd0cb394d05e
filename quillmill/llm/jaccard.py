"""N-gram Jaccard join by token-combination prefixes.

A document is the set of its distinct word shingles ("tokens", 64-bit hashes). Tokens are ordered
globally: those of one document alone, then rare ones (held by up to RARE documents), then frequent
ones; hashes order each class. Documents of equal sets are one class, stood for by one of them.

Two sets of at least the similarity share all but few tokens, so among the first tokens of each (the
prefix) they share one; with the prefix extended by K - 1 tokens they share K. Rare tokens are
indexed one by one. Frequent tokens fall into G hash classes, and each pair of tokens in one class is
indexed: with prefixes extended by G, G + 1 shared frequent tokens put two into one class. G grows
with the set, so a document has a number of pairs in proportion to its size. Only documents whose
prefix reaches frequent tokens need that. The smaller document of a pair can miss fewer tokens than
the larger, so each document has a short prefix in one role and a long one in the other. Size,
position, the number of tokens held by no other document and a bitmap of hash bins' parities bound
what a pair can share and reject candidates; all others are verified exactly.

Frequent signatures of large groups link every member with the group's least edited one first; then
only pairs across the components found so far are looked at. So a group of copies costs one pair a
member and no link between components is lost.

How common a token is needs all tokens' counts. Tokens that stand in more than RARE documents of one
run of a task's input are frequent beyond doubt; the HOT most widely so are told to all tasks at once
(8 bytes each) and take no further part. All other documents' tokens go to hash buckets, one packed row
for each run and bucket (4 bytes a token and 8 a chunk), and each chunk of documents gets back which of
its tokens are shared. Tokens are 64-bit hashes: sets are equal if their hashes are.

Defined results: null and empty texts and texts of white space have no tokens, link with nothing and
are components of their own; rows that share a doc_id are one document; null doc_ids keep a null
component unless a class names another; an empty table gives no rows.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import Texts, Words, give_back, mix64, pieces, raw_texts, saved, scan_partitions, short_batches, table
from .components import components

WORDS, PERCENT, RARE = 4, 85, 16
CHUNK_BYTES = 8 << 20
SMALL = 1_000_000
HOT = 250_000
RUN_TOKENS = 1 << 19
#: Signatures of so many rows join their hub by broadcast; there are at most rows / HEAVY of them.
HEAVY = 500
SPREAD = 256
_G = np.uint64(0x9E3779B97F4A7C15)
_STEP = mix64(np.arange(1, 65, dtype=np.uint64) * _G) | np.uint64(1)


def shingles(texts: Texts, words: int = WORDS) -> tuple[np.ndarray, np.ndarray]:
    """(tokens sorted and distinct within each document, first token of each document and the end)."""
    n = len(texts)
    w = Words(texts, lower=True)
    count = np.bincount(w.doc, minlength=n) if len(w.doc) else np.zeros(n, np.int64)
    ends = np.cumsum(count)
    k = len(w.hash)
    if not k:
        return np.zeros(0, np.uint64), np.zeros(n + 1, np.int64)
    total = np.zeros(max(k - words + 1, 0), np.uint64)
    for i in range(words):
        total += w.hash[i : i + len(total)] * _STEP[i]
    whole = np.arange(len(total)) + words <= ends[w.doc[: len(total)]]
    made, doc = mix64(total[whole]), w.doc[: len(total)][whole]
    short = np.flatnonzero((count > 0) & (count < words))
    if len(short):
        extra = np.zeros(len(short), np.uint64)
        for i in range(words - 1):
            has = count[short] > i
            extra[has] += w.hash[(ends - count)[short[has]] + i] * _STEP[i]
        made = np.concatenate([made, mix64(extra + count[short].astype(np.uint64) * _G)])
        doc = np.concatenate([doc, short])
        by = np.argsort(doc, kind="stable")
        made, doc = made[by], doc[by]
    edge = np.searchsorted(doc, np.arange(n + 1))
    for i in range(n):
        made[edge[i] : edge[i + 1]].sort()
    fresh = np.ones(len(made), bool)
    fresh[1:] = (made[1:] != made[:-1]) | (doc[1:] != doc[:-1])
    made, doc = made[fresh], doc[fresh]
    return made, np.searchsorted(doc, np.arange(n + 1))


def _keyed(docs: DataFrame, n_chunks: int) -> DataFrame:
    text = F.coalesce("text", F.lit(""))
    return docs.select(F.pmod(F.xxhash64("doc_id", text), F.lit(n_chunks)).cast("int").alias("chunk"), "doc_id", text.alias("text"))


def runs(batches, words: int):
    """(tokens, chunk of each) of about RUN_TOKENS tokens at a time."""
    held, size = [], 0
    for batch in batches:
        chunk = batch.column("chunk").to_numpy()
        for i, j, part in pieces(raw_texts(batch.column("text")), 1 << 19):
            tokens, edge = shingles(part, words)
            held.append((tokens, np.repeat(chunk[i:j], np.diff(edge))))
            size += len(tokens)
            if size > RUN_TOKENS:
                yield np.concatenate([t for t, _ in held]), np.concatenate([c for _, c in held])
                held, size = [], 0
                give_back()
    if size:
        yield np.concatenate([t for t, _ in held]), np.concatenate([c for _, c in held])


def hot_tokens(keyed: DataFrame, words: int, rare: int) -> np.ndarray:
    """The HOT tokens that most runs hold in more than ``rare`` documents, sorted."""

    def often(batches):
        for tokens, _ in runs(batches, words):
            kinds, times = np.unique(tokens, return_counts=True)
            yield pa.RecordBatch.from_arrays([pa.array(kinds[times > rare].view(np.int64))], names=["token"])

    counts = keyed.select("chunk", "text").mapInArrow(often, "token long").groupBy("token").agg(F.count("*").alias("n"))
    got = counts.orderBy(F.desc("n"), "token").limit(HOT).select("token").toPandas()["token"].to_numpy(dtype=np.int64)
    return np.sort(got.view(np.uint64))


def among(kinds: np.ndarray, tokens: np.ndarray) -> np.ndarray:
    """Whether each of ``tokens`` is one of ``kinds`` (sorted)."""
    if not len(kinds):
        return np.zeros(len(tokens), bool)
    at = np.searchsorted(kinds, tokens)
    at[at == len(kinds)] = 0
    return kinds[at] == tokens


def counted(tokens: np.ndarray, chunk: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(token, chunk, times) of each chunk's distinct ones of those u32 ``tokens`` that occur more than once, by chunk and token.

    Sorts ``tokens`` in place; one number holds chunk and token, so no index as long as a bucket is made.
    """
    if not len(tokens):
        return tokens, chunk, np.zeros(0, np.int64)
    own = chunk.astype(np.uint64) << np.uint64(32)
    own |= tokens
    own.sort()
    tokens.sort()
    again = tokens[1:][tokens[1:] == tokens[:-1]]
    kinds = again[np.append(True, again[1:] != again[:-1])] if len(again) else again
    times = np.searchsorted(tokens, kinds, "right") - np.searchsorted(tokens, kinds)
    own = own[np.append(True, own[1:] != own[:-1])]
    own = own[among(kinds, own.astype(np.uint32))]
    low = own.astype(np.uint32)
    return low, (own >> np.uint64(32)).astype(np.uint32), times[np.searchsorted(kinds, low)]


def shared_tokens(keyed: DataFrame, n_buckets: int, words: int, rare: int, hot: np.ndarray) -> DataFrame:
    """(chunk, bucket, rare, frequent): packed tokens, ``hot`` ones apart, of a chunk that several documents hold."""

    def pack(batches):
        for tokens, chunk in runs(batches, words):
            known = among(hot, tokens)
            tokens, chunk = tokens[~known], chunk[~known].astype(np.uint64)
            bucket = (tokens >> np.uint64(32)) % np.uint64(n_buckets)
            by = np.lexsort((tokens, chunk, bucket))
            tokens, chunk, bucket = tokens[by], chunk[by], bucket[by]
            # Of a chunk's documents no more than rare + 1 need to be told apart.
            n = len(tokens)
            same = np.zeros(n, bool)
            if n > rare + 1:
                k = rare + 1
                same[k:] = (tokens[k:] == tokens[:-k]) & (chunk[k:] == chunk[:-k])
            tokens, chunk, bucket = tokens[~same], chunk[~same], bucket[~same]
            part = np.flatnonzero(np.append(True, (bucket[1:] != bucket[:-1]) | (chunk[1:] != chunk[:-1]))) if len(tokens) else np.zeros(0, np.int64)
            length = np.diff(np.append(part, len(tokens)))
            low = (tokens & np.uint64(0xFFFFFFFF)).astype(np.uint32)
            begin = np.flatnonzero(np.append(True, bucket[part][1:] != bucket[part][:-1])) if len(part) else part
            ends = np.append(begin[1:], len(part))[: len(begin)]
            yield pa.RecordBatch.from_arrays(
                [
                    pa.array(bucket[part[begin]].astype(np.int32), pa.int32()),
                    pa.array([np.stack([chunk[part[a:b]], length[a:b].astype(np.uint64)]).astype(np.uint32).tobytes() for a, b in zip(begin, ends, strict=True)], pa.binary()),
                    pa.array([low[part[a] : part[b - 1] + length[b - 1]].tobytes() for a, b in zip(begin, ends, strict=True)], pa.binary()),
                ],
                names=["bucket", "chunks", "tokens"],
            )

    def count(rows: pa.Table) -> pa.Table:
        give_back()
        heads = [np.frombuffer(x, np.uint32).reshape(2, -1) for x in rows.column("chunks").to_pylist()]
        every = np.concatenate([np.frombuffer(x, np.uint32) for x in rows.column("tokens").to_pylist()])
        own, chunk, times = counted(every, np.concatenate([np.repeat(h[0], h[1]) for h in heads]))
        often = times > rare
        out = {"chunk": [], "bucket": [], "rare": [], "frequent": []}
        begin = np.flatnonzero(np.append(True, chunk[1:] != chunk[:-1])) if len(chunk) else np.zeros(0, np.int64)
        bucket = rows.column("bucket")[0].as_py()
        for a, b in zip(begin, np.append(begin[1:], len(chunk))[: len(begin)], strict=True):
            out["chunk"].append(int(chunk[a]))
            out["bucket"].append(bucket)
            out["rare"].append(own[a:b][~often[a:b]].tobytes())
            out["frequent"].append(own[a:b][often[a:b]].tobytes())
        return pa.table(out, schema=pa.schema([("chunk", pa.int32()), ("bucket", pa.int32()), ("rare", pa.binary()), ("frequent", pa.binary())]))

    packed = keyed.select("chunk", "text").mapInArrow(pack, "bucket int, chunks binary, tokens binary")
    return packed.groupBy("bucket").applyInArrow(count, "chunk int, bucket int, rare binary, frequent binary")


def misses(n: np.ndarray, percent: int) -> tuple[np.ndarray, np.ndarray]:
    """Most tokens that a set of n may miss: as the larger (or either), and as the smaller of a pair."""
    return (100 - percent) * n // 100, (100 - percent) * n // (100 + percent)


def n_classes(small_miss: np.ndarray) -> np.ndarray:
    """G: the power of two near the short prefix's length."""
    return 1 << np.round(np.log2(small_miss + 1)).astype(np.int64)


def _pairs(tokens: np.ndarray, classes: int) -> np.ndarray:
    """Signatures of all token pairs within one of ``classes`` hash classes."""
    group = (mix64(tokens ^ np.uint64(classes)) % np.uint64(classes)).astype(np.int64)
    by = np.lexsort((tokens, group))
    group, tokens = group[by], tokens[by]
    out = []
    for gap in range(1, len(tokens)):
        same = group[gap:] == group[:-gap]
        if not same.any():
            break
        out.append(mix64(tokens[:-gap][same] * _STEP[0] + tokens[gap:][same] * _STEP[1] + np.uint64(classes)))
    return np.concatenate(out) if out else np.zeros(0, np.uint64)


PREFIX = "doc_id long, n long, k1 long, k2 long, alone long, fixed long, singles array<long>, small array<long>, large array<long>, parity array<long>"
PARITY_BITS = 512


def parities(tokens: np.ndarray, edge: np.ndarray) -> np.ndarray:
    """[documents, PARITY_BITS / 64]: for each hash bin, whether it holds an odd number of tokens.

    Bins in which two sets' parities differ hold at least one unshared token each.
    """
    n = len(edge) - 1
    slot = np.repeat(np.arange(n), np.diff(edge)) * PARITY_BITS + (tokens % np.uint64(PARITY_BITS)).astype(np.int64)
    odd = (np.bincount(slot, minlength=n * PARITY_BITS) & 1).astype(np.uint8)
    return np.packbits(odd.reshape(n, PARITY_BITS), axis=1).view(np.int64)


def prefixes(keyed: DataFrame, shared: DataFrame, n_buckets: int, words: int, percent: int, hot: np.ndarray) -> DataFrame:
    """Each document's size, set key, index entries: see PREFIX.

    alone: tokens of no other document; fixed: alone and rare ones; singles: rare tokens at positions
    alone, alone + 1, ... of the long prefix; small and large: pair signatures by role; parity: see
    :func:`parities`, for documents with signatures.
    """

    def work(docs: pa.Table, replies: pa.Table) -> pa.Table:
        marks = {}
        for name in ("rare", "frequent"):
            got = [
                np.frombuffer(x, np.uint32).astype(np.uint64) | np.uint64(b) << np.uint64(32)
                for x, b in zip(replies.column(name).to_pylist(), replies.column("bucket").to_pylist(), strict=True)
            ]
            marks[name] = np.sort(np.concatenate(got)) if got else np.zeros(0, np.uint64)

        columns = {k: [] for k in ("n", "k1", "k2", "alone", "fixed", "singles", "small", "large", "parity")}
        least_size = -(-percent // max(100 - percent, 1))  # below, a set is similar to equal ones alone
        for _, _, part in pieces(raw_texts(docs.column("text")), 1 << 19):
            tokens, edge = shingles(part, words)
            n = np.diff(edge)
            key = ((tokens >> np.uint64(32)) % np.uint64(n_buckets)) << np.uint64(32) | (tokens & np.uint64(0xFFFFFFFF))
            rare, frequent = among(marks["rare"], key), among(marks["frequent"], key) | among(hot, tokens)
            rare &= ~frequent
            sums = [np.concatenate([[np.uint64(0)], np.cumsum(mix64(tokens ^ salt))]) for salt in (_STEP[2], _STEP[3])]
            columns["n"].append(n)
            for name, s in zip(("k1", "k2"), sums, strict=True):
                columns[name].append((s[edge[1:]] - s[edge[:-1]]).view(np.int64))
            n_rare, n_freq = (np.concatenate([[0], np.cumsum(m)])[edge] for m in (rare, frequent))
            n_rare, n_freq = np.diff(n_rare), np.diff(n_freq)
            alone, fixed = n - n_rare - n_freq, n - n_freq
            columns["alone"].append(alone)
            columns["fixed"].append(fixed)
            long_miss, short_miss = misses(n, percent)
            classes = n_classes(short_miss)
            least_n = -(-percent * n // 100)
            least_classes = n_classes(misses(least_n, percent)[1])
            parity = parities(tokens, edge)
            for i in range(len(n)):
                a, b = edge[i], edge[i + 1]
                singles, small, large = [], np.zeros(0, np.uint64), []
                if n[i] >= least_size:
                    if alone[i] <= long_miss[i] and n_rare[i]:
                        singles = tokens[a:b][rare[a:b]][: long_miss[i] + 1 - alone[i]].view(np.int64)
                    if fixed[i] <= long_miss[i] and n_freq[i]:
                        own = tokens[a:b][frequent[a:b]]
                        if fixed[i] <= short_miss[i]:
                            small = _pairs(own[: short_miss[i] + 1 + classes[i] - fixed[i]], int(classes[i]))
                        g = int(least_classes[i])
                        while g <= classes[i]:
                            large.append(_pairs(own[: long_miss[i] + 1 + g - fixed[i]], g))
                            g *= 2
                columns["singles"].append(singles)
                columns["small"].append(small.view(np.int64))
                columns["large"].append(np.concatenate(large).view(np.int64) if large else [])
                columns["parity"].append(parity[i] if large else [])
        flat = [np.concatenate(columns[k]) if columns[k] else np.zeros(0, np.int64) for k in ("n", "k1", "k2", "alone", "fixed")]
        give_back()
        lists = [pa.array(columns[k], pa.list_(pa.int64())) for k in ("singles", "small", "large", "parity")]
        return pa.table([docs.column("doc_id"), *[pa.array(x, pa.int64()) for x in flat], *lists], names=[c.split()[0] for c in PREFIX.split(", ")])

    return keyed.groupBy("chunk").cogroup(shared.groupBy("chunk")).applyInArrow(work, PREFIX)


def _fits(a: str, b: str, percent: int):
    """Whether sets a and b, given sizes and tokens of theirs alone, can still be similar. a: the smaller."""
    least = F.ceil(percent * (F.col(f"{a}.n") + F.col(f"{b}.n")) / (100 + percent))
    return (F.col(f"{a}.n") * 100 >= F.col(f"{b}.n") * percent) & (F.col(f"{a}.alone") <= F.col(f"{a}.n") - least) & (F.col(f"{b}.alone") <= F.col(f"{b}.n") - least)


def _alike(percent: int):
    """Whether the sets' parities leave them few enough unshared tokens."""
    least = F.ceil(percent * (F.col("s.n") + F.col("l.n")) / (100 + percent))
    differ = F.aggregate(F.zip_with("s.parity", "l.parity", lambda x, y: F.bit_count(x.bitwiseXOR(y))), F.lit(0), lambda t, c: t + c)
    return differ <= F.col("s.n") + F.col("l.n") - 2 * least


def _ordered():
    return (F.col("s.n") < F.col("l.n")) | ((F.col("s.n") == F.col("l.n")) & (F.col("s.doc_id") < F.col("l.doc_id")))


def verified(pairs: DataFrame, docs: DataFrame, words: int, percent: int) -> DataFrame:
    """The (a, b) of ``pairs`` whose sets are similar, by their whole texts."""
    ids = saved(pairs.select(F.explode(F.array("a", "b")).alias("doc_id")).distinct())
    side = F.broadcast(ids) if ids.count() <= SMALL else ids  # 8 bytes a row; beyond SMALL rows it shuffles

    def sets(batches):
        for batch in batches:
            for i, j, part in pieces(raw_texts(batch.column("text"))):
                tokens, edge = shingles(part, words)
                yield pa.RecordBatch.from_arrays(
                    [batch.column("doc_id").slice(i, j - i), pa.ListArray.from_arrays(pa.array(edge, pa.int32()), pa.array(tokens.view(np.int64)))], names=["doc_id", "tokens"]
                )
            give_back()

    held = saved(docs.select("doc_id", "text").join(side, "doc_id", "left_semi").mapInArrow(sets, "doc_id long, tokens array<long>"))
    # A document a meets its partners in up to SPREAD groups: its set travels once a group, not once a pair.
    spread = pairs.distinct().withColumn("part", F.pmod(F.xxhash64("b"), F.lit(SPREAD)))
    of_a = spread.select("a", "part").distinct().join(held.withColumnRenamed("doc_id", "a"), "a").select("a", "part", F.lit(None).cast("long").alias("b"), "tokens")
    of_b = spread.join(held.withColumnRenamed("doc_id", "b"), "b").select("a", "part", "b", "tokens")
    met = of_a.union(of_b).repartition("a", "part").sortWithinPartitions("a", "part", F.col("b").asc_nulls_first())

    def alike(batches):
        key, own = None, None
        for batch in batches:
            tokens = batch.column("tokens")
            edge = np.asarray(tokens.offsets)
            flat = np.asarray(tokens.values).view(np.uint64)
            out = []
            for i, (a, part, b) in enumerate(zip(*[batch.column(c).to_pylist() for c in ("a", "part", "b")], strict=True)):
                here = flat[edge[i] : edge[i + 1]]
                if b is None:
                    key, own = (a, part), here.copy()
                elif key == (a, part):
                    common = int(among(own, here).sum())
                    if (100 + percent) * common >= percent * (len(own) + len(here)):
                        out.append((a, b))
            yield pa.RecordBatch.from_arrays([pa.array([x for x, _ in out], pa.int64()), pa.array([y for _, y in out], pa.int64())], names=["a", "b"])

    return met.mapInArrow(alike, "a long, b long").distinct()


def similar_classes(docs: DataFrame, words: int = WORDS, percent: int = PERCENT, rare: int = RARE) -> DataFrame:
    """(doc_id, n_shingles, component_id) of every row of ``docs`` (doc_id, text)."""
    short_batches(docs.sparkSession)
    size = int(str(docs._jdf.queryExecution().optimizedPlan().stats().sizeInBytes()))
    n_chunks = max(8, size // CHUNK_BYTES + 1) if size < 1 << 56 else max(8, 4 * scan_partitions(docs))
    keyed = _keyed(docs, n_chunks)
    hot = hot_tokens(keyed, words, rare)
    shared = shared_tokens(keyed, n_chunks, words, rare, hot)
    rows = saved(prefixes(keyed, shared, n_chunks, words, percent, hot))
    whole = rows.select("doc_id", "n", "k1", "k2")
    reps = saved(whole.filter("n > 0").groupBy("n", "k1", "k2").agg(F.min("doc_id").alias("rep")))
    first = rows.join(reps, ["n", "k1", "k2"]).filter(F.col("doc_id") == F.col("rep")).dropDuplicates(["n", "k1", "k2"])
    index = saved(first.select("doc_id", "n", "alone", "fixed", "singles", "small", "large", "parity").filter((F.size("singles") > 0) | (F.size("large") > 0)))

    # Rare tokens, one by one: at most RARE rows a token.
    single = index.select("doc_id", "n", "alone", F.posexplode("singles").alias("i", "token")).withColumn("at", F.col("alone") + F.col("i"))
    met = (
        single.filter(F.col("at") <= F.floor((100 - percent) * F.col("n") / (100 + percent))).alias("s")
        .join(single.alias("l"), (F.col("s.token") == F.col("l.token")) & _ordered() & _fits("s", "l", percent))
        .select(F.col("s.doc_id").alias("a"), F.col("l.doc_id").alias("b"))
    )
    # Frequent pairs: every document of a signature with the least edited one.
    hard = ("doc_id", "n", "alone", "fixed", "parity")
    small = index.select(*hard, F.explode("small").alias("sig"))
    large = index.select(*hard, F.explode("large").alias("sig"))
    both = small.union(large)
    hub = saved(both.groupBy("sig").agg(F.min(F.struct("fixed", "doc_id", "n", "alone", "parity")).alias("hub"), F.min("doc_id").alias("lo"), F.max("doc_id").alias("hi"), F.count("*").alias("rows")).filter("lo < hi").drop("lo", "hi"))
    # Rows of a heavy signature meet its hub where they are; only the others shuffle by signature.
    heavy = hub.filter(F.col("rows") > HEAVY)
    n_heavy = heavy.count()
    if 0 < n_heavy <= SMALL // 10:
        near = both.join(F.broadcast(heavy), "sig")
        rest = both.join(F.broadcast(heavy.select("sig")), "sig", "left_anti").join(hub.filter(F.col("rows") <= HEAVY), "sig")
        met_hub = near.unionByName(rest)
    else:
        met_hub = both.join(hub, "sig")
    spoke = met_hub.select(F.struct("doc_id", "n", "alone", "parity").alias("x"), F.struct("hub.doc_id", "hub.n", "hub.alone", "hub.parity").alias("y")).filter("x.doc_id <> y.doc_id").distinct()
    order = F.when((F.col("x.n") < F.col("y.n")) | ((F.col("x.n") == F.col("y.n")) & (F.col("x.doc_id") < F.col("y.doc_id"))), F.struct("x", "y")).otherwise(F.struct(F.col("y").alias("x"), F.col("x").alias("y")))
    star = spoke.select(order.alias("p"), F.col("y.doc_id").alias("a"), F.col("x.doc_id").alias("b")).select(F.col("p.x").alias("s"), F.col("p.y").alias("l"), "a", "b")
    star = star.filter(_fits("s", "l", percent) & _alike(percent)).select("a", "b")  # a: the hub
    links = saved(verified(saved(met.union(star).distinct()), docs, words, percent))
    found = saved(components(links))

    # Frequent pairs again, across the components found so far.
    placed = lambda side: side.join(found, F.col("doc_id") == F.col("node"), "left").select("sig", "doc_id", "n", "alone", "parity", F.coalesce("component", "doc_id").alias("c"))
    far_small, far_large = placed(small), placed(large)
    mixed = far_small.union(far_large).groupBy("sig").agg(F.min("c").alias("lo"), F.max("c").alias("hi")).filter("lo < hi").select("sig")
    mixed = saved(mixed)
    rest = (
        far_small.join(mixed, "sig", "left_semi").alias("s")
        .join(far_large.alias("l"), (F.col("s.sig") == F.col("l.sig")) & (F.col("s.c") != F.col("l.c")) & _ordered() & _fits("s", "l", percent) & _alike(percent))
        .select(F.col("s.doc_id").alias("a"), F.col("l.doc_id").alias("b"))
    )
    rest = saved(rest.distinct())
    if not rest.isEmpty():
        more = saved(verified(rest, docs, words, percent))
        if not more.isEmpty():
            found = saved(components(found.select(F.col("node").alias("a"), F.col("component").alias("b")).union(more)))
    out = whole.join(reps, ["n", "k1", "k2"], "left").join(found, F.col("rep") == F.col("node"), "left")
    return out.select("doc_id", F.col("n").alias("n_shingles"), F.coalesce("component", "rep", "doc_id").alias("component_id"))


def without_near_duplicates(docs: DataFrame, words: int = 5, percent: int = 80) -> DataFrame:
    """The rows of ``docs`` whose doc_id is their component's smallest; one of rows that share it. Null doc_ids stay."""
    found = similar_classes(docs.select("doc_id", "text"), words, percent)
    gone = saved(found.filter(F.col("doc_id") != F.col("component_id")).select("doc_id").distinct())
    side = F.broadcast(gone) if gone.count() <= SMALL else gone  # 8 bytes a row; beyond SMALL rows it shuffles
    rows = docs.join(side, "doc_id", "left_anti").select(*docs.columns)
    repeated = docs.filter(F.col("doc_id").isNotNull()).groupBy("doc_id").count().filter("count > 1")
    if repeated.isEmpty():
        return rows
    return rows.filter(F.col("doc_id").isNotNull()).dropDuplicates(["doc_id"]).unionByName(rows.filter(F.col("doc_id").isNull()))


def op3_ngram_jaccard(spark, sf_dir: str) -> DataFrame:
    return similar_classes(table(spark, sf_dir, "documents").select("doc_id", "text"))
