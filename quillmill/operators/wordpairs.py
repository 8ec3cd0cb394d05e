"""Word pairs of all documents at once: the exact counts of :func:`topics.cooccurrence`, without a row for each pair.

1. Chunks: a task reads documents until it has some million words and keeps them as the chunk's distinct words and places in these.
2. Blocks: the chunks' words go, packed, to the blocks of their hashes and are counted there; a word is its block and its place in it, and
   each chunk is told its words' places.
3. Cells: a chunk's pairs are counted where the chunk is and go, as sorted numbers and packed, to the cell of their two blocks. A cell
   gets both blocks' words and counts, adds up its chunks' pairs and makes the result of them.

Nothing is broadcast or gathered: chunks and cells have the same size on average however many documents there are, and both become
more. A document must be one row and is worked on by one task.
"""

from __future__ import annotations

import math
import zlib
from collections.abc import Callable, Iterator
from functools import cached_property

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.shared import bucketed, saved

EPS = 1e-9
NEVER = math.log(EPS)
TOKENS_A_CHUNK = 1_000_000  # words that a task pairs at a time; never a limit
TOKENS_A_CELL = 700_000  # with n of these there are root n blocks and n / 2 cells, of four pairs a word
FEWEST_BLOCKS = 4
ROWS_AT_ONCE = 250_000  # of a cell's result

_CHUNK = "chunk long, words array<string>, tally array<long>, tokens long, near long, lengths binary, code binary"
_DEALT = "block int, chunk long, a binary, b binary"
_PLACED = "block int, words array<string>, tally array<long>, chunk long, places binary"
_CELL = "x int, y int, side int, a binary, b binary"
_BLOCK = "block int, side int, a binary, b binary"


def flat_words(texts: pa.Array) -> tuple[pa.Array, np.ndarray]:
    """All words of lower-case ``texts`` (no nulls) one after the other, as :func:`topics.words` splits them; how many each has."""
    split = pc.ascii_split_whitespace(texts)
    flat = split.flatten()
    full = pc.not_equal(flat, "")
    of = np.repeat(np.arange(len(texts)), pc.list_value_length(split).to_numpy(zero_copy_only=False))
    return flat.filter(full), np.bincount(of[full.to_numpy(zero_copy_only=False)], minlength=len(texts))


def packed(numbers: np.ndarray) -> bytes:
    """The numbers by planes of their bytes, compressed."""
    numbers = np.ascontiguousarray(numbers)
    planes = np.ascontiguousarray(numbers.view(np.uint8).reshape(len(numbers), numbers.itemsize).T)
    return len(numbers).to_bytes(8, "little") + pa.Codec("zstd", 1).compress(planes, asbytes=True)


def unpacked(blob: bytes, kind: type) -> np.ndarray:
    n, width = int.from_bytes(blob[:8], "little"), np.dtype(kind).itemsize
    planes = np.frombuffer(pa.Codec("zstd").decompress(blob[8:], n * width, asbytes=True), np.uint8).reshape(width, n)
    return np.ascontiguousarray(planes.T).view(kind).reshape(n)


def _named(words: pa.Array) -> bytes:
    """Words hold no white space, so one text holds them all."""
    return packed(np.frombuffer(" ".join(words.to_pylist()).encode(), np.uint8))


def _names(blob: bytes) -> pa.Array:
    return flat_words(pa.array([unpacked(blob, np.uint8).tobytes().decode()]))[0]


def _hashes(words: pa.Array) -> np.ndarray:
    return np.fromiter((zlib.crc32(w) for w in words.cast(pa.binary()).to_pylist()), np.int64, len(words))


def _batch(schema: str, *columns) -> pa.RecordBatch:
    names, kinds = zip(*(c.strip().split(" ") for c in schema.split(",")), strict=True)
    types = {"int": pa.int32(), "long": pa.int64(), "double": pa.float64(), "string": pa.string(), "binary": pa.binary(), "array<string>": pa.list_(pa.string()), "array<long>": pa.list_(pa.int64())}
    return pa.RecordBatch.from_arrays([c.cast(types[k]) if isinstance(c, pa.Array) else pa.array(c, types[k]) for c, k in zip(columns, kinds, strict=True)], names=list(names))


def _table(schema: str, rows: list[tuple]) -> pa.Table:
    return pa.Table.from_batches([_batch(schema, *(zip(*rows, strict=True) if rows else [[]] * (schema.count(",") + 1)))])


def _chunked(window: int, most: int) -> Callable:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        first, n, held, lengths, tokens = TaskContext.get().partitionId() << 32, 0, [], [], 0

        def flush() -> pa.RecordBatch:
            coded = pa.concat_arrays(held).dictionary_encode()
            size, hashes = np.concatenate(lengths), _hashes(coded.dictionary)
            order = np.argsort(hashes, kind="stable")  # so that a block's words are one stretch
            own = np.empty(len(order), np.int32)
            own[order] = np.arange(len(order))
            code = own[coded.indices.to_numpy()]
            near = sum(int(np.maximum(size - d, 0).sum()) for d in range(1, window))
            tally = np.bincount(code, minlength=len(order))
            words = pa.ListArray.from_arrays(pa.array([0, len(order)], pa.int32()), coded.dictionary.take(pa.array(order)))
            return _batch(_CHUNK, [first + n], words, [tally], [len(code)], [near], [packed(size.astype(np.int32))], [packed(code)])

        for batch in batches:
            for at in range(0, batch.num_rows, 64):  # of long documents these are millions of words
                flat, size = flat_words(batch.column("t").slice(at, 64))
                held.append(flat)
                lengths.append(size)
                tokens += len(flat)
                if tokens >= most:
                    yield flush()
                    n, held, lengths, tokens = n + 1, [], [], 0
        if tokens:
            yield flush()

    return run


def _apart(lengths: np.ndarray, d: int) -> np.ndarray:
    """Which words have one ``d`` places on in their document."""
    end = np.repeat(np.cumsum(lengths), lengths)
    return np.flatnonzero(np.arange(len(end)) + d < end)


def _dealt_pairs(window: int, blocks: int, largest: int) -> Callable:
    """A chunk's pairs, counted, to their cells: places of both words as one number, sorted, as differences; counts less one."""

    def run(chunk: pa.Table, ids: pa.Table) -> pa.Table:
        if not chunk.num_rows:
            return _table(_CELL, [])
        lengths, code = unpacked(chunk["lengths"][0].as_py(), np.int32), unpacked(chunk["code"][0].as_py(), np.int32)
        held = sorted(zip(ids["block"].to_pylist(), ids["places"].to_pylist(), strict=True))
        places = [unpacked(p, np.int32) for _, p in held]
        block, place = np.repeat([b for b, _ in held], [len(p) for p in places]), np.concatenate(places).astype(np.int64)
        order = np.argsort(block * largest + place)  # own numbers of the words, in order of blocks and places
        block, place = block[order], place[order]
        own = np.empty(len(order), np.int64)
        own[order] = np.arange(len(order))
        word, k = own[code], len(order)
        sizes = [0, *(int(np.maximum(lengths - d, 0).sum()) for d in range(1, window))]
        key = np.empty(sum(sizes), np.int64)
        for d in range(1, window):
            at, to = _apart(lengths, d), slice(sum(sizes[:d]), sum(sizes[: d + 1]))
            one, other = word[at], word[at + d]
            np.minimum(one, other, out=key[to])
            key[to] *= k
            key[to] += np.maximum(one, other, out=one)
        key, n = added(key)
        if not len(key):  # documents of one word
            return _table(_CELL, [])
        a, b = np.divmod(key, k)
        cell = (block[a] * blocks + block[b]).astype(np.uint16 if blocks < 256 else np.int64)
        key = place[a] * largest + place[b]
        del a, b, word
        by = np.argsort(cell, kind="stable")
        cell, n, key = cell[by], n[by], key[by]
        del by
        starts = np.flatnonzero(np.diff(cell, prepend=-1 if cell.dtype == np.int64 else np.uint16(65535)))
        rows = []
        for i, j in zip(starts, [*starts[1:], len(cell)], strict=True):
            rows.append((int(cell[i]) // blocks, int(cell[i]) % blocks, 0, packed(np.diff(key[i:j], prepend=0)), packed(n[i:j] - 1)))
        return _table(_CELL, rows)

    return run


def added(key: np.ndarray, n: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray]:
    """Distinct numbers in order and how often they come, or the sums of their ``n``; ``key`` is used up."""
    if not len(key):
        return key, np.zeros(0, np.int64)
    bits = 0 if n is None else int(n.max()).bit_length()
    if int(key.max()).bit_length() + bits < 64:  # both in one number: far quicker to sort than by order
        if n is not None:
            key <<= bits
            key |= n
        key.sort()
        if n is not None:
            n = key & ((1 << bits) - 1)
            key >>= bits
    else:
        order = np.argsort(key, kind="stable")
        key, n = key[order], None if n is None else n[order]
    starts = np.flatnonzero(np.concatenate([[True], key[1:] != key[:-1]]))
    return key[starts], np.diff(starts, append=len(key)) if n is None else np.add.reduceat(n, starts)


class Pairs:
    """The documents' words and pairs; chunks and blocks are written to the shared folder once."""

    def __init__(self, docs: DataFrame, window: int = 5, text: str = "text"):
        self.window = window
        lowered = docs.select(F.lower(F.coalesce(F.col(text), F.lit(""))).alias("t"))
        self._parts = int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
        self.chunks = bucketed(lowered.mapInArrow(_chunked(window, TOKENS_A_CHUNK), _CHUNK), self._parts, "chunk")
        self.tokens, self.near = (v or 0 for v in self.chunks.agg(F.sum("tokens"), F.sum("near")).first())
        self.n_blocks = max(FEWEST_BLOCKS, math.ceil(math.sqrt(self.tokens / TOKENS_A_CELL)))

    def _apiece(self, rows: DataFrame, groups: int, *by: str) -> DataFrame:
        """``rows`` by ``by`` with a task for each of that many groups: what is packed is small, and Spark would put many into one task."""
        return rows.repartition(max(self._parts, groups), *by)

    @cached_property
    def _placed(self) -> DataFrame:
        """A row a block with its words in their order, and one a chunk and block with the places of the chunk's words."""
        blocks = self.n_blocks

        def to_blocks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                for i in range(batch.num_rows):
                    words, tally = batch.column("words").slice(i, 1).flatten(), batch.column("tally").slice(i, 1).flatten().to_numpy()
                    starts = np.searchsorted(_hashes(words) * blocks >> 32, np.arange(blocks + 1))
                    for block in np.flatnonzero(np.diff(starts)):
                        at = slice(starts[block], starts[block + 1])
                        yield _batch(_DEALT, [int(block)], [batch.column("chunk")[i].as_py()], [_named(words.slice(at.start, at.stop - at.start))], [packed(tally[at])])

        def numbered(rows: pa.Table) -> pa.Table:
            block, names = rows["block"][0].as_py(), [_names(a.as_py()) for a in rows["a"]]
            coded = pa.concat_arrays(names).dictionary_encode()
            order = pc.sort_indices(coded.dictionary).to_numpy()
            place = np.empty(len(order), np.int32)
            place[order] = np.arange(len(order))
            places = place[coded.indices.to_numpy()]
            tally = np.zeros(len(order), np.int64)
            np.add.at(tally, places, np.concatenate([unpacked(b.as_py(), np.int64) for b in rows["b"]]))
            ends = np.cumsum([len(n) for n in names])
            words = pa.ListArray.from_arrays(pa.array([0, len(order)], pa.int32()), coded.dictionary.take(pa.array(order)))
            out = [_batch(_PLACED, [block], words, [tally], [None], [None])]
            for chunk, at in zip(rows["chunk"].to_pylist(), np.split(places, ends[:-1]), strict=True):
                out.append(_batch(_PLACED, [block], [None], [None], [chunk], [packed(at)]))
            return pa.Table.from_batches(out)

        dealt = self._apiece(self.chunks.select("chunk", "words", "tally").mapInArrow(to_blocks, _DEALT), blocks, "block")
        return saved(dealt.groupBy("block").applyInArrow(numbered, _PLACED))

    @property
    def blocks(self) -> DataFrame:
        """(block, words, tally): words in their order."""
        return self._placed.filter("chunk is null").select("block", "words", "tally")

    @cached_property
    def largest(self) -> int:
        return max(self.blocks.agg(F.max(F.size("words"))).first()[0] or 0, 1)

    @property
    def counts(self) -> DataFrame:
        """(term, n)."""
        return self.blocks.select(F.explode(F.arrays_zip("words", "tally")).alias("w")).select(F.col("w.words").alias("term"), F.col("w.tally").alias("n"))

    def _by_chunk(self, rows: DataFrame, made: Callable, schema: str, *more: str) -> DataFrame:
        """``made`` of each chunk (with the columns ``more``) and the ``rows`` (of, ...) of it."""
        return self.chunks.select("chunk", "lengths", "code", *more).groupBy("chunk").cogroup(rows.groupBy("of")).applyInArrow(made, schema)

    def _in_cells(self, made: Callable, schema: str, names: bool) -> DataFrame:
        """``made`` of each cell: both blocks' names (with ``names``) and counts, places of the words of its pairs, the pairs' counts."""
        blocks, largest = self.n_blocks, self.largest
        ids = self._placed.filter("chunk is not null").select(F.col("chunk").alias("of"), "block", "places")
        pairs = self._by_chunk(ids, _dealt_pairs(self.window, blocks, largest), _CELL)

        def to_cells(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                for i, block in enumerate(batch.column("block").to_pylist()):
                    a = _named(batch.column("words").slice(i, 1).flatten()) if names else b""
                    b = packed(batch.column("tally").slice(i, 1).flatten().to_numpy())
                    for other in range(blocks):
                        yield _batch(_CELL, [min(block, other)], [max(block, other)], [1 if block <= other else 2], [a], [b])

        def run(cell: pa.Table) -> pa.Table:
            side, a, b = cell["side"].to_pylist(), cell["a"], cell["b"]
            own = [i for i, s in enumerate(side) if s == 0]
            if not own:
                return _table(schema, [])
            n = np.concatenate([unpacked(b[i].as_py(), np.int64) for i in own])
            n += 1
            key, n = added(np.concatenate([np.cumsum(unpacked(a[i].as_py(), np.int64)) for i in own]), n)
            ends = [side.index(1), side.index(2) if 2 in side else side.index(1)]
            words = [_names(a[i].as_py()) if names else None for i in ends]
            tally = [unpacked(b[i].as_py(), np.int64) for i in ends]
            return made(cell["x"][0].as_py(), cell["y"][0].as_py(), words, tally, key // largest, key % largest, n)

        rows = pairs.unionByName(self.blocks.mapInArrow(to_cells, _CELL))
        return self._apiece(rows, blocks * (blocks + 1) // 2, "x", "y").groupBy("x", "y").applyInArrow(run, schema)

    def _logs(self) -> Callable:
        """Of a word's counts: the logarithm of its share, and with EPS added to it; of a pair's: that of its share."""
        tokens, near = self.tokens, self.near
        return lambda n: np.log(n / tokens), lambda n: np.log(n / tokens + EPS), lambda n: np.log(np.maximum(n / (2.0 * near), EPS))

    def npmi(self, digits: int | None = None) -> DataFrame:
        """(a, b, n, npmi) of every pair, a <= b, as :func:`topics.normalized_pmi`; rounded to ``digits``."""
        schema = "a string, b string, n long, npmi double"
        share, share_eps, pair = self._logs()

        def made(x, y, words, tally, first, second, n) -> pa.Table:
            own, other = [share(t) for t in tally], [share_eps(t) for t in tally]
            out = []
            for at in range(0, len(n), ROWS_AT_ONCE):
                i, j, m = (v[at : at + ROWS_AT_ONCE] for v in (first, second, n))
                a, b = words[0].take(pa.array(i)), words[1].take(pa.array(j))
                turned = pc.greater(a, b)
                turn = turned.to_numpy(zero_copy_only=False)
                logs = pair(np.where((i == j) & (x == y), 2 * m, m))
                value = (logs - np.where(turn, own[1][j] + other[0][i], own[0][i] + other[1][j])) / np.maximum(-logs, EPS)
                value = value if digits is None else np.round(value, digits)
                out.append(_batch(schema, pc.if_else(turned, b, a), pc.if_else(turned, a, b), m, value))
            return pa.Table.from_batches(out)

        return self._in_cells(made, schema, names=True)

    def scores(self) -> DataFrame:
        """(term, n, score) of every word, as :func:`topics.word_scores`."""
        share, share_eps, pair = self._logs()
        tokens = max(self.tokens, 1)
        n_words, logs = self.blocks.select(F.explode("tally").alias("n")).agg(F.count("*"), F.sum(F.log(F.col("n") / tokens + EPS))).first()

        def summed(x, y, words, tally, first, second, n) -> pa.Table:
            own, other = [share(t) for t in tally], [share_eps(t) for t in tally]
            sums, met = [np.zeros(len(t)) for t in tally], [np.zeros(len(t), bool) for t in tally]
            for at in range(0, len(n), ROWS_AT_ONCE):
                i, j, m = (v[at : at + ROWS_AT_ONCE] for v in (first, second, n))
                same = (i == j) & (x == y)
                log = pair(np.where(same, 2 * m, m))
                most, apart = np.maximum(-log, EPS), np.where(same, 0.0, 1.0)  # a word beside itself counts once
                for to, of, place, partner, weight in ((0, 1, i, j, 1.0), (1, 0, j, i, apart)):
                    both = own[to][place] + other[of][partner]
                    more = (log - both) / most - both / NEVER + 1.0  # less what it is where they never meet
                    sums[to] += np.bincount(place, more * weight, len(tally[to]))
                    met[to][place] = True
            rows = []
            for block, each, hit in zip((x, y), sums, map(np.flatnonzero, met), strict=True):
                rows.append((block, 0, packed(np.diff(hit, prepend=0)), packed(each[hit])))
            return _table(_BLOCK, rows)

        def as_blocks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                for i, block in enumerate(batch.column("block").to_pylist()):
                    yield _batch(_BLOCK, [block], [1], [_named(batch.column("words").slice(i, 1).flatten())], [packed(batch.column("tally").slice(i, 1).flatten().to_numpy())])

        def closed(block: pa.Table) -> pa.Table:
            side, a, b = block["side"].to_pylist(), block["a"], block["b"]
            i = side.index(1)
            words, n = _names(a[i].as_py()), unpacked(b[i].as_py(), np.int64)
            score = np.zeros(len(n))
            for i, s in enumerate(side):
                if s == 0:
                    score[np.cumsum(unpacked(a[i].as_py(), np.int64))] += unpacked(b[i].as_py(), np.float64)
            score += (n_words * (NEVER - share(n)) - logs) / -NEVER
            return pa.Table.from_batches([_batch("term string, n long, score double", words, n, score)])

        parts = self._in_cells(summed, _BLOCK, names=False).unionByName(self.blocks.mapInArrow(as_blocks, _BLOCK))
        return self._apiece(parts, self.n_blocks, "block").groupBy("block").applyInArrow(closed, "term string, n long, score double")

    def products(self, names: list[str]) -> DataFrame:
        """(term, x) of all words with neighbours: the product of the word's shares of neighbours with those of each of ``names``.

        No pair is counted but those with a name: a word's products are sums over its neighbours, one by one, of their shares among
        the name's neighbours.
        """
        window = self.window

        def named(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                for i in range(batch.num_rows):
                    words = batch.column("words").slice(i, 1).flatten()
                    rank = pc.fill_null(pc.index_in(words, pa.array(names, pa.string())), -1).to_numpy().astype(np.int64)
                    if (rank < 0).all():
                        continue
                    lengths, code = (unpacked(batch.column(c)[i].as_py(), np.int32) for c in ("lengths", "code"))
                    parts = []
                    for d in range(1, window):
                        at = _apart(lengths, d)
                        for one, other in ((code[at], code[at + d]), (code[at + d], code[at])):
                            hit = rank[one] >= 0
                            parts.append(rank[one[hit]] * len(words) + other[hit])
                    key, n = added(np.concatenate(parts))
                    yield _batch("rank int, term string, n long", (key // len(words)).astype(np.int32), words.take(pa.array(key % len(words))), n)

        near = saved(self.chunks.select("words", "lengths", "code").mapInArrow(named, "rank int, term string, n long").groupBy("rank", "term").agg(F.sum("n").alias("n")))
        mass = {r.rank: r.mass for r in near.groupBy("rank").agg(F.sum("n").alias("mass")).collect()}  # a row a name

        def summed(chunk: pa.Table, near: pa.Table) -> pa.Table:
            if not chunk.num_rows:
                return _table("term string, rank int, x double", [])
            words = chunk["words"].combine_chunks().flatten()
            lengths, code = (unpacked(chunk[c][0].as_py(), np.int32) for c in ("lengths", "code"))
            ranks, pos, n = (near[c].to_numpy() for c in ("rank", "pos", "n"))
            pairs = [(at, at + d) for d in range(1, window) for at in [_apart(lengths, d)]]
            out = []
            for r in [-1, *np.unique(ranks)]:  # -1: how many neighbours a word has
                share = np.ones(len(words))
                if r >= 0:
                    share[:] = 0
                    share[pos[ranks == r]] = n[ranks == r] / mass[int(r)]
                each, sums = share[code], np.zeros(len(code))
                for at, on in pairs:
                    sums[at] += each[on]
                    sums[on] += each[at]
                x = np.bincount(code, sums, len(words))
                hit = np.flatnonzero(x)
                out.append(_batch("term string, rank int, x double", words.take(pa.array(hit)), np.full(len(hit), r, np.int32), x[hit]))
            return pa.Table.from_batches(out)

        local = self.chunks.select(F.col("chunk").alias("of"), F.posexplode("words").alias("pos", "term"))
        rows = self._by_chunk(local.join(near, "term").drop("term"), summed, "term string, rank int, x double", "words").repartition("term")
        held = rows.groupBy("term", "rank").agg(F.sum("x").alias("x")).groupBy("term").agg(F.map_from_entries(F.collect_list(F.struct("rank", "x"))).alias("m"))
        x = lambda i: F.coalesce(F.try_element_at("m", i), F.lit(0.0)) / F.element_at("m", F.lit(-1))
        return held.select("term", F.transform(F.sequence(F.lit(0), F.lit(len(names) - 1)), x).alias("x") if names else F.array().cast("array<double>").alias("x"))
