"""Token ids of a corpus as compact binary files: canonical length-limited Huffman codes from global counts.

Writing
    1. Texts are range-partitioned and sorted by (doc_id, text) and encoded by a tokenizer file; every
       document ends with ``end_id``. The ids are written once, in that order, to the shared folder.
    2. Each task counts its ids, Spark adds the counts up. The code book comes from them: package-merge
       finds the lengths that are best under ``LIMIT`` bits, and canonical codes follow from lengths alone.
       The book has an entry an id that occurs, so the vocabulary bounds it.
    3. Each task cuts its stretch of the id stream into blocks and codes them.

Files (in ``folder``)
    ``codes``   Parquet, a row an id: id, length in bits.
    ``blocks``  Parquet as the container (its commit protocol makes lost executors harmless), a row a
                block: part, first (number of its first id in the whole stream), n_tokens, block (bytes).
    A block stands for itself, given the book. Little-endian: ``IDH1``; u32 ids; u32 documents; u32 ids
    between checkpoints; u32 payload bytes; for each document that has ids here a row of i64 doc_id,
    u8 is-null, i64 start (number of the document's first id in the stream), i64 skip (ids of it before
    this block), i64 n (all its ids), u32 ids here, stored column by column; u32 bit offsets, one for every
    checkpoint; the payload, most significant bit first.

Reading
    A table of 2 ** LIMIT entries gives id and length for the next bits. All checkpoints of a batch of
    blocks are decoded side by side, one id of each a step. Documents that lie in several blocks are put
    together again by their start.

Defined results: null and empty texts hold the end id alone; rows of a doc_id lie next to each other by
text (nulls first), repeated rows give rows of their own, null doc_ids come first; a text of any length
is one document over as many blocks as it takes; no rows give no blocks and an empty book; a book of one
id gives it one bit; ids of more than 24 bits are an error; other columns than doc_id and text are left out.
"""

from __future__ import annotations

import json
import re
import uuid
import zlib
from functools import lru_cache
from itertools import accumulate, chain

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .common import give_back, release, saved, shared_dir, short_batches, table

LIMIT = 18  # bits of the longest code, more only where the book has more ids than fit
BLOCK = 1 << 16  # ids of a block
AT_ONCE = 16  # blocks decoded side by side
STEP = 256  # ids from one checkpoint to the next
CACHE = 1 << 19  # remembered stretches of text, in each of two generations
TEXTS = 16  # cut at a time
REMEMBERED = 64  # characters of the longest remembered one
END = 2

HEADER = np.dtype([("magic", "S4"), ("ids", "<u4"), ("docs", "<u4"), ("step", "<u4"), ("payload", "<u4")])
COLUMNS = (("doc_id", "<i8"), ("null", "<u1"), ("start", "<i8"), ("skip", "<i8"), ("n", "<i8"), ("here", "<u4"))


# ---------------------------------------------------------------- text to ids


_WHITE = "\t-\r \xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000"
_STRETCH = re.compile(f"[{_WHITE}]*[^{_WHITE}]+|[{_WHITE}]+")
_UNSURE = re.compile("[\x85\u180e\u200b-\u200d\ufeff]")  # tables differ on whether these are white space
_ODD = re.compile("[\x85\xa0\u1680\u180e\u2000-\u200d\u2028\u2029\u202f\u205f\u3000\ufeff]")
_RARE = ("  ", " \n", "\n ", "\n\n\n", "\t", "\r", "\v", "\f", "\0")
_LETTERS = "A-Za-z\xc0-\xd6\xd8-\xf6\xf8-\xff"  # letters in every table
_PLAIN = re.compile(f"(\n?)( ?[{_LETTERS}]+)([!-&(-/:-@\\[-`{{-~]*)")  # a match of the split pattern each; no apostrophe
_GLUED = re.compile(f"[.,](?<![0-9{_LETTERS}][.,])")
#: Bytes as a byte-level vocabulary writes them; 1 and 2, which plain stretches don't hold, as bytes that no text has.
_BYTES = {b: chr(b) for b in (*range(33, 127), *range(161, 173), *range(174, 256))}
_BYTES |= {b: chr(256 + i) for i, b in enumerate(b for b in range(256) if b not in _BYTES)} | {1: "\xff"}


class Encoder:
    """A tokenizer file, asked once for each different stretch of a text.

    A byte-level tokenizer never joins a character that isn't white space with white space after it, so a
    text falls into stretches (white space, then other characters), and each is encoded on its own. Stretches
    are remembered in two generations of ``CACHE`` entries. Line feeds, and stops and commas right after a letter or a digit,
    are stretches of their own. Plain ones (a word, signs after it) are cut as the split pattern would; their words go to the tokenizer's model together, with a byte between them that no text holds
    and no merge knows.
    """

    def __init__(self, path: str):
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.tokenizer.encode_special_tokens = True  # their strings in a text are ordinary text
        self.model = self._model(path)
        self.known: dict[str, bytes] = {"": b""}
        self.older: dict[str, bytes] = {}

    def _model(self, path: str):
        """The file's model without its split pattern, and the id of the byte between words; None if words can't be told apart."""
        from tokenizers import Tokenizer

        with open(path, encoding="utf-8") as file:
            held = json.load(file)
        model, cut = held["model"], held["pre_tokenizer"] or {}
        odd = [model.get(k) for k in ("dropout", "unk_token", "continuing_subword_prefix", "end_of_word_suffix", "byte_fallback", "ignore_merges")]
        if model["type"] != "BPE" or any(odd) or held["normalizer"] or not all(t["special"] for t in held["added_tokens"]):
            return None
        if cut.get("type") != "ByteLevel" or cut["add_prefix_space"] or not cut["use_regex"] or [t for t in model["vocab"] if "\xff" in t] != ["\xff"]:
            return None
        alone = Tokenizer(self.tokenizer.model)
        return (alone, model["vocab"]["\xff"]) if set(_BYTES.values()) <= set(model["vocab"]) else None

    @staticmethod
    def stretches(text: str) -> list[str]:
        odd = not text.isascii() and _ODD.search(text)
        if odd and _UNSURE.search(text):
            return [text]
        if not odd and text[-1] not in " \n" and not any(r in text for r in _RARE):  # the same cuts, faster
            cut = text.replace(" ", "\0 ").replace("\n", "\0\n\0")
            if not _GLUED.search(text):  # so each of these begins a match of the split pattern
                cut = cut.replace(".", "\0.").replace(",", "\0,")
            return cut.split("\0")
        return _STRETCH.findall(text)

    def _words(self, words: list[str]):
        """(word, ids as bytes) of matches of the split pattern."""
        alone, between = self.model
        for at in range(0, len(words), 256):
            part = words[at : at + 256]
            ids = np.array(alone.encode_batch_fast(["\1".join(part).encode().decode("latin-1").translate(_BYTES)], add_special_tokens=False)[0].ids, "<u4")
            ends = (np.flatnonzero(ids == between) * 4).tolist()
            if len(ends) != len(part) - 1:
                raise ValueError("the byte between words isn't a token of its own")
            data = ids.tobytes()
            yield from zip(part, map(data.__getitem__, map(slice, [0, *(e + 4 for e in ends)], [*ends, len(data)])), strict=True)

    def _new(self, stretches: list[str]) -> dict[str, bytes]:
        """The ids of each, as bytes, and of words in them."""
        whole, cut, rest = [], [], []
        for s in stretches:
            m = _PLAIN.fullmatch(s) if self.model else None
            if m is None:
                rest.append(s)
            elif m.end(2) - m.start(2) == len(s):
                whole.append(s)
            else:
                cut.append((s, m.groups()))
        known, older = self.known, self.older
        words = set().union(*(g for _, g in cut)).difference(known)
        found = {s: older[s] for s in words if s in older}
        found.update(self._words(list(words.union(whole).difference(found))))
        for s, g in cut:
            found[s] = b"".join([found[w] if w in found else known[w] for w in g])
        for at in range(0, len(rest), 2048):
            part = rest[at : at + 2048]
            for s, e in zip(part, self.tokenizer.encode_batch(part, add_special_tokens=False), strict=True):
                found[s] = np.array(e.ids, "<u4").tobytes()
        return found

    def encode(self, texts: list[str | None]) -> list[bytes]:
        """Little-endian u32 ids of each text. Some texts at a time, so their stretches stay in the processor's cache."""
        return [x for i in range(0, len(texts), TEXTS) for x in self._encode(texts[i : i + TEXTS])]

    def _encode(self, texts: list[str | None]) -> list[bytes]:
        cut = [self.stretches(t) if t else [] for t in texts]
        flat = list(chain.from_iterable(cut))
        ids = list(map(self.known.get, flat))
        missing = [i for i, x in enumerate(ids) if x is None]
        if missing:
            new = {flat[i] for i in missing}
            held = {s: self.older[s] for s in new if s in self.older}
            held.update(self._new(list(new.difference(held))))
            for i in missing:
                ids[i] = held[flat[i]]
            self.known.update({s: x for s, x in held.items() if len(s) <= REMEMBERED})
        ends = list(accumulate(map(len, cut)))
        out = [b"".join(ids[a:b]) for a, b in zip([0, *ends], ends, strict=False)]
        if len(self.known) > CACHE:
            self.known, self.older = {"": b""}, self.known
        return out


@lru_cache(maxsize=2)
def _encoder(path: str) -> Encoder:
    return Encoder(path)


def encoded(docs: DataFrame, path: str, end_id: int = END) -> DataFrame:
    """(doc_id, part, offset, n, ids, seen) in order of doc_id and text: ``offset`` ids come before within ``part``; the
    first row of an Arrow batch holds how often each id occurs in the batch (u32 ids, then as many u32 counts)."""
    short_batches(docs.sparkSession)
    tail = np.array([end_id], "<u4").tobytes()

    def run(batches):
        part, offset = TaskContext.get().partitionId(), 0
        for batch in batches:
            ids = [x + tail for x in _encoder(path).encode(batch.column("text").to_pylist())]
            n = np.array([len(x) // 4 for x in ids], np.int64)
            starts = offset + np.cumsum(n) - n
            offset += int(n.sum())
            if not ids:
                continue
            times = np.bincount(np.frombuffer(b"".join(ids), "<u4"))
            at = np.flatnonzero(times)
            seen = np.concatenate([at, times[at]]).astype("<u4").tobytes()
            columns = [pa.array(np.full(len(n), part, np.int32)), pa.array(starts), pa.array(n), pa.array(ids, pa.binary()), pa.array([seen, *[None] * (len(n) - 1)], pa.binary())]
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), *columns], names=["doc_id", "part", "offset", "n", "ids", "seen"])

    # The row's own number only parts repeated rows, which are all the same, among tasks.
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text", F.monotonically_increasing_id().alias("row"))
    rows = rows.repartitionByRange("doc_id", F.xxhash64("text"), "row").sortWithinPartitions("doc_id", "text")
    return rows.select("doc_id", "text").mapInArrow(run, "doc_id long, part int, offset long, n long, ids binary, seen binary")


def counts(tokens: DataFrame) -> DataFrame:
    """(id, n): how often each id occurs in all documents."""

    def run(batches):
        total = np.zeros(0, np.int64)
        for batch in batches:
            for seen in batch.column("seen"):
                ids, times = np.frombuffer(seen.as_buffer(), "<u4").reshape(2, -1)
                if ids[-1] >= len(total):
                    total = np.append(total, np.zeros(int(ids[-1]) + 1 - len(total), np.int64))
                total[ids] += times
        at = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(at), pa.array(total[at])], names=["id", "n"])

    return tokens.filter("seen is not null").select("seen").mapInArrow(run, "id long, n long").groupBy("id").agg(F.sum("n").alias("n"))


# ---------------------------------------------------------------- the code book


def code_lengths(weights: np.ndarray, limit: int) -> np.ndarray:
    """Lengths of the best prefix code with at most ``limit`` bits (package-merge)."""
    n = len(weights)
    if n < 2:
        return np.ones(n, np.int64)
    if n > 1 << limit:
        raise ValueError(f"{n} ids don't fit into codes of {limit} bits")
    order = np.argsort(weights, kind="stable")
    items = np.asarray(weights, np.int64)[order]
    merged, is_item = items, [np.ones(n, bool)]
    for _ in range(limit - 1):
        pairs = merged[: len(merged) // 2 * 2].reshape(-1, 2).sum(1)
        both = np.concatenate([items, pairs])
        at = np.argsort(both, kind="stable")
        merged = both[at]
        is_item.append(at < n)
    lengths, take = np.zeros(n, np.int64), 2 * n - 2
    for flags in reversed(is_item):
        lightest = int(flags[:take].sum())  # each level takes the lightest items once more
        lengths[:lightest] += 1
        take = 2 * (take - lightest)
    out = np.empty(n, np.int64)
    out[order] = lengths
    return out


class Book:
    """Canonical codes: ids by (length, id) get consecutive codes."""

    def __init__(self, ids: np.ndarray, lengths: np.ndarray):
        at = np.lexsort((ids, lengths))
        self.ids, self.lengths = np.asarray(ids, np.int64)[at], np.asarray(lengths, np.int64)[at]
        self.limit = int(self.lengths[-1]) if len(at) else 1
        if len(at) and (self.ids.max() >= 1 << 24 or self.limit > 24):
            raise ValueError("ids and codes have at most 24 bits")
        # A code of length l covers 2 ** (limit - l) places of the table, in order.
        width = np.left_shift(1, self.limit - self.lengths)
        self.codes = (np.cumsum(width) - width) >> (self.limit - self.lengths)

    @classmethod
    def of(cls, ids: np.ndarray, weights: np.ndarray, limit: int = LIMIT) -> Book:
        return cls(ids, code_lengths(weights, max(limit, int(max(len(ids) - 1, 0)).bit_length())))

    def by_id(self) -> tuple[np.ndarray, np.ndarray]:
        size = int(self.ids.max()) + 1 if len(self.ids) else 0
        codes, lengths = np.zeros(size, np.uint32), np.zeros(size, np.uint8)
        codes[self.ids], lengths[self.ids] = self.codes, self.lengths
        return codes, lengths

    def table(self) -> np.ndarray:
        """id * 256 + length for every value of the next ``limit`` bits."""
        out = np.ones(1 << self.limit, np.uint32)
        filled = np.repeat((self.ids * 256 + self.lengths).astype(np.uint32), np.left_shift(1, self.limit - self.lengths))
        out[: len(filled)] = filled
        return out


# ---------------------------------------------------------------- blocks


def pack(ids: np.ndarray, codes: np.ndarray, lengths: np.ndarray) -> tuple[bytes, np.ndarray]:
    """The payload of ids, and the bit offset of every STEP-th one."""
    bits = lengths[ids].astype(np.int64)
    ends = np.cumsum(bits)
    at = ends - bits
    value = codes[ids].astype(np.uint64) << (64 - bits - (at & 31)).astype(np.uint64)  # at most 31 + 24 bits
    # A code begins in every word of 32 bits; no two share a bit, so their parts in a word and the next may be added.
    first = np.flatnonzero(np.diff(at >> 5, prepend=-1))
    words = np.zeros(len(first) + 1, np.uint64)
    words[:-1] = np.add.reduceat(value >> np.uint64(32), first)
    words[1:] += np.add.reduceat(value & np.uint64(0xFFFFFFFF), first)
    return words.astype(">u4").tobytes()[: int(ends[-1] + 7) >> 3], at[::STEP].astype("<u4")


def block(columns: dict[str, np.ndarray], ids: np.ndarray, codes: np.ndarray, lengths: np.ndarray) -> bytes:
    payload, checkpoints = pack(ids, codes, lengths)
    header = np.array([(b"IDH1", len(ids), len(columns["n"]), STEP, len(payload))], HEADER)
    return b"".join([header.tobytes(), *(np.asarray(columns[c], t).tobytes() for c, t in COLUMNS), checkpoints.tobytes(), payload])


def parse(data) -> tuple[np.void, dict[str, np.ndarray], np.ndarray, np.ndarray]:
    """(header, document columns, checkpoints, payload) of a block."""
    header = np.frombuffer(data, HEADER, 1)[0]
    if header["magic"] != b"IDH1":
        raise ValueError("not a block of ids")
    at, columns = HEADER.itemsize, {}
    for c, t in COLUMNS:
        columns[c] = np.frombuffer(data, t, header["docs"], at)
        at += columns[c].nbytes
    checkpoints = np.frombuffer(data, "<u4", -(-int(header["ids"]) // int(header["step"])), at)
    return header, columns, checkpoints, np.frombuffer(data, np.uint8, header["payload"], at + checkpoints.nbytes)


def unpack(parsed: list, table: np.ndarray, limit: int) -> list[np.ndarray]:
    """The ids of every block; all stretches between checkpoints go side by side."""
    steps = max((int(h["step"]) for h, *_ in parsed), default=0)
    slack = steps * limit // 8 + 8  # a block's last stretch may run on into nothing
    bases = np.cumsum([0, *(len(p) + slack for *_, p in parsed)])
    data = np.zeros(int(bases[-1]) + 4, np.uint32)
    for base, (*_, p) in zip(bases, parsed, strict=False):
        data[base : base + len(p)] = p
    window = (data[:-3] << 24) | (data[1:-2] << 16) | (data[2:-1] << 8) | data[3:]
    position = np.concatenate([np.int64(base) * 8 + c for base, (_, _, c, _) in zip(bases, parsed, strict=False)] or [np.zeros(0, np.int64)])
    lanes = np.empty((steps, len(position)), np.uint32)
    down, end = np.uint32(32 - limit), np.int64(8 * len(window) - 8)
    for k in range(steps):
        entry = table[(window[position >> 3] << (position & 7).astype(np.uint32)) >> down]
        lanes[k] = entry >> 8
        position += entry & 255
        np.minimum(position, end, out=position)
    flat, out, first = np.ascontiguousarray(lanes.T).reshape(-1), [], 0
    for h, _, c, _ in parsed:
        out.append(flat[first * steps : first * steps + int(h["ids"])])
        first += len(c)
    return out


class _Stream:
    """Documents' ids of one part in a row, cut into blocks."""

    def __init__(self, codes: np.ndarray, lengths: np.ndarray, size: int):
        self.codes, self.lengths, self.size, self.rows, self.held = codes, lengths, size, [], 0

    def add(self, doc_id, start: int, ids: np.ndarray):
        skip = 0
        while skip < len(ids):
            here = ids[skip : skip + self.size - self.held]
            self.rows.append((0 if doc_id is None else doc_id, doc_id is None, start, skip, len(ids), len(here), here))
            skip += len(here)
            self.held += len(here)
            if self.held == self.size:
                yield self.flush()

    def flush(self) -> tuple[int, int, bytes]:
        columns = dict(zip((c for c, _ in COLUMNS), zip(*(r[:6] for r in self.rows), strict=True), strict=True))
        data = block({c: np.array(v) for c, v in columns.items()}, np.concatenate([r[6] for r in self.rows]), self.codes, self.lengths)
        out = (self.rows[0][2] + self.rows[0][3], self.held, data)
        self.rows, self.held = [], 0
        return out


def blocks(tokens: DataFrame, book: Book, size: int = BLOCK) -> DataFrame:
    """(part, first, n_tokens, block) of tokens (doc_id, part, start, n, ids) whose files are in order."""
    codes, lengths = book.by_id()

    def run(batches):
        stream, part, due = _Stream(codes, lengths, size), None, None
        done: list = []

        def out():
            got = pa.RecordBatch.from_arrays([pa.array([d[0] for d in done], pa.int32()), pa.array([d[1][0] for d in done], pa.int64()), pa.array([d[1][1] for d in done], pa.int64()), pa.array([d[1][2] for d in done], pa.binary())], names=["part", "first", "n_tokens", "block"])
            done.clear()
            return got

        for batch in batches:
            columns = [batch.column(c) for c in ("doc_id", "part", "start", "ids")]
            for doc_id, at, start, ids in zip(columns[0].to_pylist(), columns[1].to_pylist(), columns[2].to_pylist(), columns[3], strict=True):
                if stream.held and (at != part or start != due):  # a task may read stretches of several parts
                    done.append((part, stream.flush()))
                ids = np.frombuffer(ids.as_buffer(), "<u4")
                part, due = at, start + len(ids)
                done += [(part, b) for b in stream.add(doc_id, start, ids)]
            if len(done) >= 8:
                yield out()
        if stream.held:
            done.append((part, stream.flush()))
        if done:
            yield out()
        give_back()

    return tokens.select("doc_id", "part", "start", "ids").mapInArrow(run, "part int, first long, n_tokens long, block binary")


def write_ids(docs: DataFrame, folder: str, path: str, end_id: int = END, limit: int = LIMIT, size: int = BLOCK) -> None:
    """Encodes all texts of ``docs`` and writes codes and blocks below ``folder``."""
    spark = docs.sparkSession
    tokens = saved(encoded(docs, path, end_id), "zstd")
    rows = counts(tokens).collect()  # at most a row for each id of the vocabulary
    book = Book.of(np.array([r.id for r in rows], np.int64), np.array([r.n for r in rows], np.int64), limit)
    entries = list(zip(book.ids.tolist(), book.lengths.tolist(), strict=True))
    spark.createDataFrame(entries, "id long, length long").coalesce(1).write.parquet(f"{folder}/codes")
    # The ids of all parts before each; a broadcast row for each part of the advisory size keeps the files' order.
    sizes = tokens.groupBy("part").agg(F.sum("n").alias("n"))
    before = sizes.select("part", (F.sum("n").over(Window.orderBy("part")) - F.col("n")).alias("before"))
    placed = tokens.join(F.broadcast(before), "part").withColumn("start", F.col("before") + F.col("offset"))
    blocks(placed, book, size).write.option("compression", "uncompressed").parquet(f"{folder}/blocks")
    release(tokens)


def read_book(spark: SparkSession, folder: str) -> Book:
    rows = spark.read.parquet(f"{folder}/codes").collect()
    return Book(np.array([r.id for r in rows], np.int64), np.array([r.length for r in rows], np.int64))


def read_pieces(spark: SparkSession, folder: str, with_ids: bool = True) -> DataFrame:
    """(doc_id, start, skip, n, here, crc, ids): what each block holds of each document."""
    book = read_book(spark, folder)
    short_batches(spark)
    names = ["doc_id", "start", "skip", "n", "here", "crc", "ids"]

    def run(batches):
        entries = book.table()
        for part in (b.slice(i, AT_ONCE) for b in batches for i in range(0, len(b), AT_ONCE)):
            parsed = [parse(b.as_buffer()) for b in part.column("block")]
            for (_, c, _, _), ids in zip(parsed, unpack(parsed, entries, book.limit), strict=True):
                ends = np.cumsum(c["here"])
                cut = [ids[a:b] for a, b in zip(ends - c["here"], ends, strict=True)]
                yield pa.RecordBatch.from_arrays(
                    [pa.array(c["doc_id"], mask=c["null"].astype(bool)), *(pa.array(c[k]) for k in ("start", "skip", "n")), pa.array(c["here"].astype(np.int64)), pa.array([zlib.crc32(x) for x in cut], pa.int64()), pa.array([x.tobytes() if with_ids else None for x in cut], pa.binary())],
                    names=names,
                )
            give_back()

    return spark.read.parquet(f"{folder}/blocks").select("block").mapInArrow(run, "doc_id long, start long, skip long, n long, here long, crc long, ids binary")


def read_ids(spark: SparkSession, folder: str) -> DataFrame:
    """(doc_id, start, n, ids): every document with its ids, the end id included."""
    held = read_pieces(spark, folder).groupBy("doc_id", "start", "n").agg(F.array_sort(F.collect_list(F.struct("skip", "ids"))).alias("p"))
    joined = F.aggregate("p", F.lit(b""), lambda a, x: F.concat(a, x["ids"]))
    flat = F.udf(lambda b: np.frombuffer(b, "<u4").tolist(), "array<long>", useArrow=True)
    return held.select("doc_id", "start", "n", flat(joined).alias("ids"))


# ---------------------------------------------------------------- checksums of documents in several blocks

_POLYNOMIAL = 0xEDB88320


def _times(a: int, b: int) -> int:
    """Product of two polynomials modulo that of crc32, bits reversed (bit 31 is the constant term)."""
    out = 0
    while a:
        if a & 0x80000000:
            out ^= b
        a = (a << 1) & 0xFFFFFFFF
        b = (b >> 1) ^ (_POLYNOMIAL if b & 1 else 0)
    return out


def crc_of_both(first: int, second: int, n_bytes: int) -> int:
    """crc32 of two byte strings in a row from theirs; ``n_bytes`` is the second one's length."""
    shift, square = 0x80000000, 0x00800000  # 1 and x ** 8
    while n_bytes:
        if n_bytes & 1:
            shift = _times(shift, square)
        square = _times(square, square)
        n_bytes >>= 1
    return _times(first, shift) ^ second


def read_digests(spark: SparkSession, folder: str) -> DataFrame:
    """(doc_id, start, n_tokens, ids_crc32) of every document, from the files alone."""

    def whole(pieces_):
        out = None
        for p in sorted(pieces_, key=lambda p: p["skip"]):
            out = p["crc"] if out is None else crc_of_both(out, p["crc"], 4 * p["here"])
        return out

    crc = F.udf(whole, "long", useArrow=True)
    held = read_pieces(spark, folder, with_ids=False).groupBy("doc_id", "start", "n").agg(F.collect_list(F.struct("skip", "here", "crc")).alias("p"))
    return held.select("doc_id", "start", F.col("n").alias("n_tokens"), crc("p").alias("ids_crc32"))


def op12_token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Writes the ids of all documents as files and returns what reading them back shows."""
    import public_tokenizers

    folder = f"{shared_dir(spark)}/quillmill-ids-{uuid.uuid4().hex}"
    write_ids(table(spark, sf_dir, "documents"), folder, public_tokenizers.path("byte_bpe_50k.json"))
    return read_digests(spark, folder)
