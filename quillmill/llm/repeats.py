"""Periodic runs of words inside documents, by the linear tandem-repeat method of Gusfield and Stoye.

A run is a stretch of consecutive words with smallest period q, at least ``max(shortest, times * q)`` words
long, that no neighbouring word extends. Documents are worked on in the tasks that read them; a batch of
texts goes through the steps as one array.

    0. Sieve, which loses nothing: in such a run every word lies in a stretch of w = ceil(shortest * (1 - 1/times))
       words that occurs again in the run. Words outside stretches repeated within their document are left out;
       what remains falls into segments, and no two segments share symbols.
    1. The suffix tree is held as its suffix array with names of all factors of lengths 1, 2, 4, ...: equal
       factors have equal names, so common extensions to either side take one step a length, and a tree
       locus is an interval of the suffix array with a depth.
    2. Lempel-Ziv blocks, each the longest prefix of the rest that began before. Common extensions around the
       borders of each block give pairs (start, period) which cover the leftmost occurrence of every square.
    3. The vocabulary: suffix-link walks from each pair's locus. Taking away the first word of a square and
       adding it at the end gives the next square if the tree has that path; steps along the text itself are
       taken at once, at its end the locus is searched for the edge. A walk stops at squares found before.
       Only primitive squares are kept: the others have a smaller period.
    4. The interval of each vocabulary entry locates all its occurrences. Those of one period at successive
       starts merge into a run; each run is then verified by its extensions.

Work and memory are O(n log n) for n words of one document or batch, whatever repeats.

Defined results: null and empty texts and texts of white space have no words and no runs (null best run; digests of
nothing); repeated rows give rows of their own; null doc_ids are kept; ties for the best run fall to the smallest start,
then period; texts of any length are taken whole, by one task; no rows give no rows; columns named like an
added one are replaced, other columns pass.
"""

from __future__ import annotations

import hashlib
import zlib
from collections.abc import Callable, Iterator
from fractions import Fraction
from itertools import chain, compress

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from .common import give_back, pieces, raw_texts, short_batches, table

SHORTEST, TIMES = 24, 3
MULTIPLIER = np.uint64(0x9E3779B97F4A7C15)


def _spread(first: np.ndarray, counts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """For each i the numbers first[i] .. first[i] + counts[i] - 1 in a row, and i itself as often."""
    owner = np.repeat(np.arange(len(counts)), counts)
    ends = np.cumsum(counts)
    return np.arange(len(owner)) - np.repeat(ends - counts, counts) + first[owner], owner


class Factors:
    """Names of the factors of lengths 2 ** k of a sequence of symbols, and its suffix array."""

    def __init__(self, symbols: np.ndarray):
        n = self.n = len(symbols)
        _, names = np.unique(symbols, return_inverse=True)
        self.levels = [self._ended(names)]
        width = 1
        while names.max() < n - 1:
            later = np.full(n, -1, np.int64)
            later[: n - width] = names[width:]
            _, names = np.unique(names.astype(np.int64) * (n + 1) + later + 1, return_inverse=True)
            self.levels.append(self._ended(names))
            width *= 2
        self.rank = self.levels[-1][:n]
        self.order = np.empty(n, np.int64)
        self.order[self.rank] = np.arange(n)

    @staticmethod
    def _ended(names: np.ndarray) -> np.ndarray:
        return np.append(names, -1).astype(np.int32)  # the empty factor at the end equals no other

    def forward(self, i: np.ndarray, j: np.ndarray) -> np.ndarray:
        """How far the suffixes at i and j (different places) agree."""
        i, j, start = i.copy(), j.copy(), i
        for k in range(len(self.levels) - 1, -1, -1):
            step = (self.levels[k][i] == self.levels[k][j]).astype(np.int64) << k
            i += step
            j += step
        return i - start

    def backward(self, i: np.ndarray, j: np.ndarray) -> np.ndarray:
        """How far the prefixes before i and j agree from their ends."""
        i, j, start = i.copy(), j.copy(), i
        for k in range(len(self.levels) - 1, -1, -1):
            a, b = i - (1 << k), j - (1 << k)
            fits = (a >= 0) & (b >= 0)
            step = (fits & (self.levels[k][np.where(fits, a, 0)] == self.levels[k][np.where(fits, b, 1)])).astype(np.int64) << k
            i -= step
            j -= step
        return start - i

    def same(self, i: np.ndarray, j: np.ndarray, length: np.ndarray) -> np.ndarray:
        """Whether the factors of this length at i and j are equal."""
        out = np.zeros(len(i), bool)
        fits = (i + length <= self.n) & (j + length <= self.n)
        size = np.frexp(np.maximum(length, 1))[1] - 1
        for k in np.unique(size[fits]):
            at = np.flatnonzero(fits & (size == k))
            if k >= len(self.levels):  # longer than any repeated factor
                out[at] = i[at] == j[at]
                continue
            names, last = self.levels[k], length[at] - (1 << int(k))
            out[at] = (names[i[at]] == names[j[at]]) & (names[i[at] + last] == names[j[at] + last])
        out[length == 0] = True
        return out

    def locus(self, i: np.ndarray, length: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The interval [lo, hi] of the suffix array whose suffixes begin like that at i."""
        rank = self.rank[i].astype(np.int64)
        lo, low = rank.copy(), np.zeros(len(i), np.int64)
        hi, high = rank.copy(), np.full(len(i), self.n - 1)
        while (low < lo).any():
            mid = (low + lo) >> 1
            inside = self.same(self.order[mid], i, length)
            lo, low = np.where(inside, mid, lo), np.where(inside, low, np.minimum(mid + 1, lo))
        while (high > hi).any():
            mid = (high + hi + 1) >> 1
            inside = self.same(self.order[mid], i, length)
            hi, high = np.where(inside, mid, hi), np.where(inside, high, np.maximum(mid - 1, hi))
        return lo, hi


def blocks(factors: Factors) -> np.ndarray:
    """Where the Lempel-Ziv blocks begin, and the end."""
    n = factors.n
    before, after = list(range(-1, n - 1)), list(range(1, n + 1))
    smaller, larger = np.empty(n, np.int64), np.empty(n, np.int64)
    rank = factors.rank.tolist()
    # The neighbours in suffix order among all earlier places: take places out from the last to the first.
    for i in range(n - 1, -1, -1):
        r = rank[i]
        a, b = before[r], after[r]
        smaller[i], larger[i] = a, b
        if a >= 0:
            after[a] = b
        if b < n:
            before[b] = a
    place, best = np.arange(n), np.zeros(n, np.int64)
    for near, there in ((smaller, smaller >= 0), (larger, larger < n)):
        at = np.flatnonzero(there)
        best[at] = np.maximum(best[at], factors.forward(place[at], factors.order[near[at]]))
    lengths, out, i = np.maximum(best, 1).tolist(), [], 0
    while i < n:
        out.append(i)
        i += lengths[i]
    return np.array([*out, n])


def covering_pairs(factors: Factors, begins: np.ndarray, longest: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(start, period) of squares around block borders, periods up to ``longest`` of the block's place."""
    h, h1 = begins[:-1], begins[1:]
    h2 = np.append(begins[2:], begins[-1])
    starts, periods = [], []
    # The centre lies in the block and the square reaches over its end.
    k, owner = _spread(np.ones(len(h), np.int64), np.minimum(h1 - h, longest[h]))
    right = h1[owner]
    q = right - k
    ahead, back = factors.forward(right, q), factors.backward(right, q)
    start = np.maximum(q - back, q - k + 1)
    good = (ahead + back >= k) & (ahead > 0)
    starts.append(start[good])
    periods.append(k[good])
    # The square begins before the block.
    k, owner = _spread(np.ones(len(h), np.int64), np.minimum(h2 - h, longest[h]))
    left = h[owner]
    q = left + k
    at = np.flatnonzero(q < factors.n)
    k, left, q = k[at], left[at], q[at]
    ahead, back = factors.forward(left, q), factors.backward(left, q)
    start = np.maximum(left - back, left - k + 1)
    good = (ahead + back >= k) & (ahead > 0)
    starts.append(start[good])
    periods.append(k[good])
    return np.concatenate(starts), np.concatenate(periods)


def primitive(factors: Factors, start: np.ndarray, period: np.ndarray) -> np.ndarray:
    """Whether no proper divisor of ``period`` is a period of the square at ``start``."""
    out = np.ones(len(start), bool)
    if not len(start):
        return out
    top = int(period.max())
    least = np.arange(top + 1)  # the smallest prime factor of each number
    for f in range(2, int(top**0.5) + 1):
        if least[f] == f:
            multiples = least[f * f :: f]
            multiples[multiples == np.arange(f * f, top + 1, f)] = f
    rest = period.copy()
    while (left := np.flatnonzero(rest > 1)).size:
        f = least[rest[left]]
        shorter = period[left] // f
        out[left] &= ~factors.same(start[left], start[left] + shorter, 2 * period[left] - shorter)
        rest[left] //= f
    return out


def vocabulary(factors: Factors, start: np.ndarray, period: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(lo, hi, period): loci of all squares that walks over suffix links reach from the given ones."""
    n, symbols = factors.n, factors.levels[0]
    known = np.zeros(0, np.int64)
    found: list[tuple] = []
    while len(start):
        # One walk for each stretch of text that keeps a period: from its leftmost square.
        first = start - factors.backward(start, start + period)
        at = np.lexsort((start, first, period))
        start, period, first = start[at], period[at], first[at]
        lead = np.append(True, (first[1:] != first[:-1]) | (period[1:] != period[:-1]))
        start, period = start[lead], period[lead]
        # Steps along the text: as long as the next word keeps the period, at most once around.
        steps = np.minimum(factors.forward(start, start + period) - period, period - 1)
        place, owner = _spread(start, steps + 1)
        p = period[owner]
        lo, hi = factors.locus(place, 2 * p)
        keys, at = np.unique(lo * (n + 1) + p, return_index=True)
        new = ~np.isin(keys, known, assume_unique=True)
        found.append((lo[at[new]], hi[at[new]], p[at[new]]))
        fresh = np.zeros(len(place), bool)
        fresh[at[new]] = True
        known = np.union1d(known, keys)
        # Where the text stops: the suffix link's locus, and its edge with the square's first word.
        last = start + steps
        go = (steps < period - 1) & fresh[np.cumsum(steps + 1) - 1]
        last, period = last[go], period[go]
        wanted = symbols[last]
        low, high = factors.locus(last + 1, 2 * period - 1)
        end = high
        while (low < high).any():
            mid = (low + high) >> 1
            less = symbols[np.minimum(factors.order[mid] + 2 * period - 1, n)] < wanted
            low, high = np.where(less, np.minimum(mid + 1, high), low), np.where(less, high, mid)
        hit = (low <= end) & (symbols[np.minimum(factors.order[low] + 2 * period - 1, n)] == wanted)
        start, period = factors.order[low[hit]], period[hit]
    if not found:
        return (np.zeros(0, np.int64),) * 3
    return tuple(np.concatenate(x) for x in zip(*found, strict=True))


def runs(symbols: np.ndarray, segment: np.ndarray, shortest: int = SHORTEST, times: int = TIMES) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(start, length, period) of all runs; symbols of different segments must differ."""
    none = (np.zeros(0, np.int64),) * 3
    if len(symbols) < 2:
        return none
    factors = Factors(symbols)
    longest = np.bincount(segment)[segment] // times  # no longer period fits in ``times`` times
    start, period = covering_pairs(factors, blocks(factors), longest)
    keep = primitive(factors, start, period)
    lo, hi, p = vocabulary(factors, start[keep], period[keep])
    if not len(lo):
        return none
    at, owner = _spread(lo, hi - lo + 1)
    at, p = factors.order[at], p[owner]
    key = np.sort(p * (factors.n + 1) + at)
    p, at = key // (factors.n + 1), key % (factors.n + 1)
    lead = np.flatnonzero(np.append(True, np.diff(key) != 1))
    begin, p = at[lead], p[lead]
    length = np.append(at[lead[1:] - 1], at[-1]) - begin + 2 * p
    keep = length >= np.maximum(shortest, times * p)
    begin, length, p = begin[keep], length[keep], p[keep]
    if (factors.forward(begin, begin + p) + p != length).any() or factors.backward(begin, begin + p).any():
        raise AssertionError("a run is not maximal")
    return begin, length, p


def repeated_stretches(values: np.ndarray, doc: np.ndarray, width: int) -> np.ndarray:
    """Whether each word lies in ``width`` words that its document has more than once (or a hash says so)."""
    n = len(values) - width + 1
    out = np.zeros(len(values) + 1, np.int64)
    if n < 2:
        return out[:-1].astype(bool)
    code = np.zeros(n, np.uint64)
    for k in range(width):
        code = code * MULTIPLIER + values[k : n + k]
    inside = doc[:n] == doc[width - 1 :]
    code = (code ^ (code >> np.uint64(29))) * MULTIPLIER + doc[:n].astype(np.uint64) * np.uint64(0xD1B54A32D192ED03)
    held = np.sort(code[inside])
    again = np.unique(held[1:][held[1:] == held[:-1]])
    if len(again):
        at = np.flatnonzero(inside)
        at = at[again[np.minimum(np.searchsorted(again, code[at]), len(again) - 1)] == code[at]]
        out[at] += 1
        np.add.at(out, at + width, -1)
    return np.cumsum(out[:-1]) > 0


def find(documents: list[list[bytes]], shortest: int = SHORTEST, times: int = TIMES) -> list[list[tuple[int, int, int]]]:
    """The runs (start, length, period) of each document's words, by start, then period."""
    out: list[list[tuple[int, int, int]]] = [[] for _ in documents]
    sizes = np.array([len(w) for w in documents], np.int64)
    n = int(sizes.sum())
    values = np.fromiter(map(hash, chain.from_iterable(documents)), np.int64, n).view(np.uint64)
    doc = np.repeat(np.arange(len(documents)), sizes)
    held = repeated_stretches(values, doc, max(1, -(-shortest * (times - 1) // times)))
    if not held.any():
        return out
    edge = np.flatnonzero(np.diff(np.concatenate([[0], held.view(np.int8), [0]])) != 0)
    # A covered stretch may go on into the next document.
    cuts = np.unique(np.concatenate([edge, np.cumsum(sizes)]))
    begins = np.append(0, cuts[:-1])
    segments = [(a, b) for a, b in zip(begins.tolist(), cuts.tolist(), strict=True) if b - a >= shortest and held[a]]
    ids: dict[bytes, int] = {}
    bases = (np.cumsum(sizes) - sizes).tolist()
    symbols, segment, places = [], [], []
    for k, (a, b) in enumerate(segments):
        d = int(doc[a])
        words = documents[d][a - bases[d] : b - bases[d]]
        symbols.append(np.fromiter((ids.setdefault(w, len(ids)) for w in words), np.int64, len(words)))
        segment.append(np.full(b - a, k))
        places.append(np.arange(a, b))
    if not segments:
        return out
    part, place = np.concatenate(segment), np.concatenate(places)
    for begin, length, period in zip(*(x.tolist() for x in runs(np.concatenate(symbols) + part * len(ids), part, shortest, times)), strict=True):
        at = int(place[begin])
        out[int(doc[at])].append((at - bases[int(doc[at])], length, period))
    return [sorted(r, key=lambda x: (x[0], x[2])) for r in out]


def collapsed(words: list[bytes], found: list[tuple[int, int, int]]) -> list[bytes]:
    """Without the words that a run holds after its first period."""
    if not found:
        return words
    edge = np.zeros(len(words) + 1, np.int64)
    for start, length, period in found:
        edge[start + period] += 1
        edge[start + length] -= 1
    return list(compress(words, np.cumsum(edge[:-1]) == 0))


def best(found: list[tuple[int, int, int]]) -> tuple[int, int, int] | None:
    """The run with the greatest length over period; the first of equals."""
    return max(found, key=lambda r: (Fraction(r[1], r[2]), -r[0], -r[2]), default=None)


Edit = Callable[[int | None, list[bytes]], list[bytes]]
RUN = "struct<start: long, length: long, period: long>"


def word_runs(docs: DataFrame, edit: Edit | None = None, shortest: int = SHORTEST, times: int = TIMES, with_text: bool = False) -> DataFrame:
    """Adds runs (array), best (run), exponent_milli, collapsed_sha256 and, if asked for, collapsed text.

    ``edit`` changes a document's words (doc_id, words) before they are searched.
    """
    short_batches(docs.sparkSession, 500)
    schema = f"runs array<{RUN}>, best {RUN}, exponent_milli long, collapsed_sha256 string, collapsed string"
    added = StructType.fromDDL(schema)
    names = {f.name for f in added.fields}
    kept = [f for f in docs.schema.fields if f.name != "text" and f.name.lower() not in names]
    full = docs.select(*[f.name for f in kept]).schema
    for f in added.fields:
        full = full.add(f)
    run_type = pa.struct([("start", pa.int64()), ("length", pa.int64()), ("period", pa.int64())])

    def struct(r):
        return dict(zip(("start", "length", "period"), r, strict=True)) if r else None

    def results(batch: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
        texts, ids = raw_texts(batch.column("text")), batch.column("doc_id").to_pylist()
        for i, j, part in pieces(texts, 2 << 20):
            words = [part.text(k).split() for k in range(j - i)]
            if edit is not None:
                words = [edit(d, w) for d, w in zip(ids[i:j], words, strict=True)]
            found = find(words, shortest, times)
            short = [b" ".join(collapsed(w, r)) for w, r in zip(words, found, strict=True)]
            top = [best(r) for r in found]
            columns = [
                pa.array([[struct(r) for r in rs] for rs in found], pa.list_(run_type)),
                pa.array([struct(t) for t in top], run_type),
                pa.array([1000 * t[1] // t[2] if t else None for t in top], pa.int64()),
                pa.array([hashlib.sha256(s).hexdigest() for s in short], pa.string()),
                pa.array([s.decode() if with_text else None for s in short], pa.string()),
            ]
            yield pa.RecordBatch.from_arrays([batch.column(f.name).slice(i, j - i) for f in kept] + columns, names=[f.name for f in kept] + added.names)

    def run(batches):
        for batch in batches:
            yield from results(batch)
            give_back()

    return docs.select(*[f.name for f in kept], "text").mapInArrow(run, full)


def planted(doc_id: int | None, words: list[bytes]) -> list[bytes]:
    """The words of a document, of every tenth one with its tail made periodic (by its id's crc32)."""
    n = len(words)
    h = zlib.crc32(str(doc_id).encode()) if doc_id is not None else 1
    if h % 10 or not n:
        return words
    g = h // 10
    a = g % n
    p = 1 + (n - a) // (3 + g % 8)
    cycle = words[a : a + p]
    return words[:a] + (cycle * ((n - a) // p + 1))[: n - a]


def op13_periodic_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The runs of every document whose edit is :func:`planted`, as digests."""
    found = word_runs(table(spark, sf_dir, "documents").select("doc_id", "text"), planted)
    line = F.transform("runs", lambda r: F.concat_ws(",", r["start"], r["length"], r["period"]))
    listed = F.concat(F.array_join(line, "\n"), F.when(F.size("runs") > 0, "\n").otherwise(""))
    return found.select("doc_id", F.size("runs").cast("long").alias("n_runs"), "best.start", "best.length", "best.period", "exponent_milli", F.sha2(listed, 256).alias("runs_sha256"), "collapsed_sha256")
