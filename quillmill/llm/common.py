"""Shared pieces of the corpus operators: tables, shared-folder checkpoints and raw text buffers.

Conventions of every operator here
----------------------------------
* Extra columns pass through or are left out; inner columns take names that the input doesn't use
  (:func:`unused`). Where an operator adds a column to its input, a column of that name (in any case)
  is replaced, as by ``withColumn``.
* A null ``doc_id`` is a value like any other, but for folds (fold 0) and where an operator says so; a
  null text counts as the empty text.
* Repeated rows are kept: each input row gives one output row.
* An empty table gives an empty result with the same schema.
"""

from __future__ import annotations

import ctypes

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from ..functions.shared import saved, shared_dir  # noqa: F401


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def release(df: DataFrame) -> None:
    """Deletes a table made by :func:`saved` once nothing reads it any more."""
    path = getattr(df, "_quillmill_path", None)
    if path:
        jvm = df.sparkSession._jvm
        target = jvm.org.apache.hadoop.fs.Path(path)
        conf = df.sparkSession._jsparkSession.sessionState().newHadoopConf()
        target.getFileSystem(conf).delete(target, True)


def unused(columns, *names: str) -> list[str]:
    """``names``, each with as many underscores before it as it takes to clash with none of ``columns``."""
    taken = {c.lower() for c in columns}
    out = []
    for name in names:
        while name.lower() in taken:
            name = f"_{name}"
        taken.add(name.lower())
        out.append(name)
    return out


def scan_partitions(df: DataFrame) -> int:
    """The number of tasks that read ``df``; it follows the input's bytes."""
    return max(1, df._jdf.queryExecution().toRdd().getNumPartitions())


def fold(doc_id: str, mod: int):
    """crc32 of the decimal doc_id, modulo ``mod``; null ids fall in fold 0."""
    return F.coalesce(F.crc32(F.col(doc_id).cast("string").cast("binary")) % F.lit(mod), F.lit(0))


class Texts:
    """A slice of an Arrow string column as one byte buffer plus document offsets."""

    def __init__(self, data: np.ndarray, offsets: np.ndarray):
        self.data, self.offsets = data, offsets

    def __len__(self) -> int:
        return len(self.offsets) - 1

    def text(self, i: int) -> bytes:
        return self.data[self.offsets[i] : self.offsets[i + 1]].tobytes()

    def doc_of_byte(self) -> np.ndarray:
        return np.repeat(np.arange(len(self), dtype=np.int32), np.diff(self.offsets))


def raw_texts(column: pa.Array) -> Texts:
    """Nulls become empty texts. No byte is copied unless nulls or chunks force it."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    if column.null_count:
        column = column.fill_null("")
    column = column.cast(pa.large_string())
    _, offs, data = column.buffers()
    n = len(column)
    offsets = np.frombuffer(offs, np.int64, n + 1 + column.offset)[column.offset :] if n else np.zeros(1, np.int64)
    if data is None or not n:
        return Texts(np.zeros(0, np.uint8), np.zeros(n + 1, np.int64))
    return Texts(np.frombuffer(data, np.uint8)[offsets[0] : offsets[-1]], offsets - offsets[0])


def pieces(texts: Texts, max_bytes: int = 1 << 20):
    """Cuts a batch into runs of whole documents of about ``max_bytes``: yields (first, last, Texts)."""
    n, i = len(texts), 0
    while i < n:
        j = int(np.searchsorted(texts.offsets, texts.offsets[i] + max_bytes, "right")) - 1
        j = min(n, max(i + 1, j))
        lo, hi = texts.offsets[i], texts.offsets[j]
        yield i, j, Texts(texts.data[lo:hi], texts.offsets[i : j + 1] - lo)
        i = j


def short_batches(spark: SparkSession, rows: int = 1000) -> None:
    """Whole texts are long, so Arrow batches of Spark's default 10,000 rows would take tens of MB a task."""
    name = "spark.sql.execution.arrow.maxRecordsPerBatch"
    if int(spark.conf.get(name)) > rows:
        spark.conf.set(name, str(rows))


def give_back() -> None:
    """Returns freed memory to the system; workers live long and would hold on to their peaks."""
    pa.default_memory_pool().release_unused()
    trim = getattr(ctypes.CDLL(None), "malloc_trim", None)
    if trim is not None:
        trim(0)


def per_document(df: DataFrame, score, schema: str, keep_text: bool = False, max_bytes: int = 1 << 20) -> DataFrame:
    """Runs ``score(Texts) -> dict of columns`` over the text column of ``df``.

    All columns but ``text`` pass through, ``text`` too if asked for; ``schema`` lists the added ones,
    which replace columns of the same name.
    Work goes in small buffers of whole documents, so memory does not grow with the partition.
    """
    short_batches(df.sparkSession)
    out = StructType.fromDDL(schema)
    names = [f.name for f in out.fields]
    kept = [f for f in df.schema.fields if (f.name != "text" or keep_text) and f.name.lower() not in names]
    full = df.select(*[f.name for f in kept]).schema
    for f in out.fields:
        full = full.add(f)

    def run(batches):
        for batch in batches:
            texts = raw_texts(batch.column("text"))
            for i, j, part in pieces(texts, max_bytes):
                got = score(part)
                yield pa.RecordBatch.from_arrays(
                    [batch.column(f.name).slice(i, j - i) for f in kept] + [pa.array(got[k]) for k in names],
                    names=[f.name for f in kept] + names,
                )
            give_back()

    rest = [] if keep_text else ["text"]
    return df.select(*[f.name for f in kept], *rest).mapInArrow(run, full)


def mix64(x: np.ndarray) -> np.ndarray:
    """A 64-bit finaliser: every input bit moves about half of the output bits."""
    x = x ^ (x >> np.uint64(30))
    x = x * np.uint64(0xBF58476D1CE4E5B9)
    x = x ^ (x >> np.uint64(27))
    x = x * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


_TABLE = mix64(np.arange(1, 257, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15))
_SPACE = np.zeros(256, bool)
_SPACE[[9, 10, 11, 12, 13, 32]] = True
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
_PLACE = mix64(np.arange(1, 65537, dtype=np.uint64) * np.uint64(0xD1B54A32D192ED03)) | np.uint64(1)


class Words:
    """Words (runs of bytes outside space and \\t..\\r) of a buffer: hash, document, first byte, length."""

    def __init__(self, texts: Texts, lower: bool):
        data = _LOWER[texts.data] if lower else texts.data
        n = len(data)
        solid = ~_SPACE[data]
        begin = solid.copy()
        if n:
            edge = np.zeros(n + 1, bool)
            edge[texts.offsets] = True
            begin[1:] &= ~solid[:-1] | edge[1:n]
        self.start = np.flatnonzero(begin)
        k = len(self.start)
        self.doc = (np.searchsorted(texts.offsets, self.start, "right") - 1).astype(np.int64)
        at = np.flatnonzero(solid)
        word = np.cumsum(begin[at]) - 1
        self.length = np.bincount(word, minlength=k) if k else np.zeros(0, np.int64)
        place = at - self.start[word] if k else at
        value = _TABLE[data[at]] * _PLACE[place & 65535]
        far = np.flatnonzero(place > 65535)
        if len(far):  # places repeat only together with another odd factor
            value[far] *= mix64((place[far] >> 16).astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)) | np.uint64(1)
        first = np.searchsorted(at, self.start)
        self.hash = mix64(np.add.reduceat(value, first) + self.length.astype(np.uint64)) if k else np.zeros(0, np.uint64)
