"""Byte-level BPE by a monoid tree reduction.

A piece of text (one match of the split pattern) is an element of a monoid: its token sequence under
a rank table. The piece is halved recursively down to leaves, whose bytes are merged by rank; two
neighbours are joined by re-encoding a window around their border, which grows until its outermost
tokens equal those that were there before. Every adjacent pair of the joined sequence then occurs in
an encoding of its own bytes, and a token sequence all of whose adjacent pairs do so is the one that
merging the whole piece would give, so nothing further out can change. Leaves hold LEAF bytes, so all
pieces that are not tokens themselves and are longer are built by joins. Pieces never merge with one
another, so above them the product is concatenation: a text's tree has FAN children a node, whose ids
and decoded bytes are concatenated on the way up.

The reduction of a piece depends on its bytes alone, so each worker remembers the results of short stretches
of pieces in two generations of ``CACHE`` entries, from one task to the next, and what leaves and windows of up
to WINDOW bytes merge to.

Defined results: null and empty texts have no tokens and the digests of nothing; equal texts have equal
results, repeated rows and null doc_ids give rows of their own; equal ranks don't occur in a rank table,
among equal pairs the leftmost merges first; an empty table gives no rows; columns named like an added
one are replaced. A text of any length is walked piece by piece: its digests are fed FAN * FAN pieces at a time.
"""

from __future__ import annotations

import base64
import hashlib
import re
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from .common import give_back, pieces, raw_texts, short_batches, table

LEAF, FAN = 4, 64
CACHE = 1 << 19  # entries in each of two generations
FEW = 1 << 16  # of them where a step is one of several, whose workers need memory for others
WINDOW = 2 * LEAF  # bytes of the longest remembered leaf or window
CACHED_BYTES = 48
GPT = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""  # the split pattern whose cuts are known
_ODD = re.compile("[\t\v\f\r\x1c-\x1f\x85\xa0\u1680\u180e\u2000-\u200d\u2028\u2029\u202f\u205f\u3000\ufeff]|  | \n|\n |\n\n\n|\0|[ \n]\\Z")
_GLUED = re.compile("[.,](?<![0-9A-Za-z\xc0-\xd6\xd8-\xf6\xf8-\xff][.,])")


class RankTable:
    """``ranks``: token bytes to id; a pair of tokens merges if its bytes are a token, lowest id first."""

    def __init__(self, ranks: dict[bytes, int], most: int | None = None):
        self.ranks, self.most = ranks, most  # most: remembered entries, CACHE if None
        self.one = [bytes([i]) for i in range(256)]
        self.bytes_of = {i: b for b, i in ranks.items()}
        self.decimal_of = {i: str(i) for i in self.bytes_of}
        self.merged: dict[bytes, list[int]] = {}

    @classmethod
    def read(cls, path: str, most: int | None = None) -> RankTable:
        with open(path, "rb") as lines:
            return cls({base64.b64decode(a): int(b) for a, b in map(bytes.split, lines)}, most)

    def full(self, held: dict) -> bool:
        return len(held) >= (self.most or CACHE)

    def leaf(self, data: bytes) -> list[int]:
        """:meth:`merge`, remembered for up to WINDOW bytes: leaves and windows of a few tokens recur all the time."""
        got = self.merged.get(data)
        if got is None:
            got = self.merge(data)
            if len(data) <= WINDOW:
                if self.full(self.merged):
                    self.merged = {}
                self.merged[data] = got
        return got

    def merge(self, data: bytes) -> list[int]:
        """Merges by rank, leftmost first among equals."""
        ranks, get, none = self.ranks, self.ranks.get, 1 << 60
        parts = list(map(self.one.__getitem__, data))
        pair = [get(x + y, none) for x, y in zip(parts, parts[1:], strict=False)]
        while pair:
            best = min(pair)
            if best == none:
                break
            i = pair.index(best)
            x = parts[i] = parts[i] + parts.pop(i + 1)
            del pair[i]
            if i < len(pair):
                pair[i] = get(x + parts[i + 1], none)
            if i:
                pair[i - 1] = get(parts[i - 1] + x, none)
        return [ranks[p] for p in parts]

    def join(self, left: list[int], right: list[int]) -> list[int]:
        """The monoid's product. Windows double on each side until both outer tokens stand."""
        if not left or not right:
            return left + right
        a = b = 1
        of = self.bytes_of.__getitem__
        while True:
            a, b = min(a, len(left)), min(b, len(right))
            window = self.leaf(b"".join(map(of, left[-a:] + right[:b])))
            left_stands = a == len(left) or (len(window) > 1 and window[0] == left[-a])
            right_stands = b == len(right) or (len(window) > 1 and window[-1] == right[b - 1])
            if left_stands and right_stands:
                return left[: len(left) - a] + window + right[b:]
            if not left_stands:
                a *= 2
            if not right_stands:
                b *= 2

    def encode(self, data: bytes) -> list[int]:
        """Ids of one piece: halves level by level, without recursion, so length bounds nothing. As in the
        library, a piece that is a token is that token."""
        if data in self.ranks:
            return [self.ranks[data]]
        level = [self.leaf(data[i : i + LEAF]) for i in range(0, len(data), LEAF)]
        while len(level) > 1:
            level = [self.join(*level[i : i + 2]) if i + 1 < len(level) else level[i] for i in range(0, len(level), 2)]
        return level[0]

    def decode(self, ids: list[int]) -> bytes:
        of = self.bytes_of
        return reduced([of[i] for i in ids], b"")


def reduced(parts: list, between):
    """``parts`` concatenated with ``between``, up a tree of FAN children a node."""
    while len(parts) > FAN:
        parts = [between.join(parts[i : i + FAN]) for i in range(0, len(parts), FAN)]
    return between.join(parts)


@lru_cache(maxsize=2)
def _encoder(path: str, pattern: str, most: int | None = None) -> Encoder:
    import regex

    return Encoder(RankTable.read(path, most), regex.compile(pattern))


class Encoder:
    """Stretches of a text (one piece or some in a row) with a bounded memory: ids in decimal and decoded bytes of each."""

    def __init__(self, ranks: RankTable, pattern):
        self.ranks, self.find, self.simple = ranks, pattern.findall, pattern.pattern == GPT
        self.known: dict[str, tuple[str, bytes]] = {}
        self.older: dict[str, tuple[str, bytes]] = {}

    def forget(self) -> None:
        self.known, self.older, self.ranks.merged = {}, {}, {}

    def cut(self, text: str) -> list[str]:
        """Stretches that begin and end where pieces do. Of plain text: a blank and what follows it, line feeds, and stops
        and commas right after a letter or a digit, which begin a piece whatever comes next."""
        if not self.simple or _ODD.search(text):
            return self.find(text)
        cut = text.replace(" ", "\0 ").replace("\n", "\0\n\0")
        if not _GLUED.search(text):
            cut = cut.replace(".", "\0.").replace(",", "\0,")
        return list(filter(None, cut.split("\0")))

    def learn(self, stretch: str) -> tuple[str, bytes]:
        """The result of a stretch; that of a long one is not remembered."""
        got = self.older.get(stretch)
        if got is None:
            whole = stretch.isascii() and (stretch[1:] if stretch[0] == " " else stretch).isalpha()
            ids = []
            for piece in [stretch] if whole else self.find(stretch):
                ids += self.ranks.encode(piece.encode())
            got = " ".join(map(self.ranks.decimal_of.__getitem__, ids)), self.ranks.decode(ids)
        if len(got[1]) <= CACHED_BYTES:
            self.known[stretch] = got
        return got

    def parts(self, text: str):
        """(ids in decimal, decoded bytes) of a text's stretches, FAN * FAN at a time."""
        cut = self.cut(text)
        for i in range(0, len(cut), FAN * FAN):
            part = cut[i : i + FAN * FAN]
            if self.ranks.full(self.known):
                self.known, self.older = {}, self.known
            got = list(map(self.known.get, part))
            for k, x in enumerate(got):
                if x is None:
                    got[k] = self.known.get(part[k]) or self.learn(part[k])
            yield [x[0] for x in got], [x[1] for x in got]

    def document(self, text: str):
        return [(i, i.count(" ") + 1, t) for ids, texts in self.parts(text) for i, t in zip(ids, texts, strict=True)]

    def digests(self, text: str):
        """(number of ids, digest of the ids, digest of the decoded bytes, ids) of a text."""
        n, ids_sha, text_sha, ids = 0, hashlib.sha256(), hashlib.sha256(), []
        for of_ids, of_text in self.parts(text):
            joined = reduced(of_ids, " ")
            ids_sha.update(((" " if ids else "") + joined).encode())
            text_sha.update(reduced(of_text, b""))
            n += joined.count(" ") + 1
            ids.append(joined)
        return n, ids_sha.hexdigest(), text_sha.hexdigest(), " ".join(ids)


def encode_documents(docs: DataFrame, path: str, pattern: str, with_ids: bool = False) -> DataFrame:
    """Adds ``n_tokens``, ``ids_sha256`` and ``decoded_sha256`` (of ids encoded, then decoded) to every row.

    With ``with_ids`` the row also holds ``token_ids`` array<int>. ``text`` is dropped, other columns pass.
    """
    short_batches(docs.sparkSession)
    added = "n_tokens long, ids_sha256 string, decoded_sha256 string" + ", token_ids array<int>" * with_ids
    names = {f.name for f in StructType.fromDDL(added)} | {"text"}
    kept = [f for f in docs.schema.fields if f.name.lower() not in names]
    schema = docs.select(*[f.name for f in kept]).schema
    for f in StructType.fromDDL(added):
        schema = schema.add(f)

    def run(batches):
        encoder = _encoder(path, pattern, FEW if with_ids else None)
        for batch in batches:
            for lo, hi, texts in pieces(raw_texts(batch.column("text"))):
                count, ids_sha, text_sha, ids = [], [], [], []
                for i in range(len(texts)):
                    n, of_ids, of_text, joined = encoder.digests(texts.text(i).decode("utf-8"))
                    count.append(n)
                    ids_sha.append(of_ids)
                    text_sha.append(of_text)
                    if with_ids:
                        ids.append(joined)
                columns = [pa.array(count, pa.int64()), pa.array(ids_sha, pa.string()), pa.array(text_sha, pa.string())]
                if with_ids:
                    ends = np.cumsum([0, *count]).astype(np.int32)
                    columns.append(pa.ListArray.from_arrays(pa.array(ends), pa.array(np.array(" ".join(ids).split(), np.int32))))
                yield pa.RecordBatch.from_arrays([*(batch.column(f.name).slice(lo, hi - lo) for f in kept), *columns], names=schema.names)
        if with_ids:  # as a step among others the workers' memory is needed elsewhere
            encoder.forget()
        give_back()

    return docs.select(*[f.name for f in kept], "text").mapInArrow(run, schema)


def op7_byte_bpe(spark, sf_dir: str) -> DataFrame:
    import public_tokenizers

    docs = table(spark, sf_dir, "documents").select("doc_id", F.col("text"))
    return encode_documents(docs, public_tokenizers.path("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN)
