"""Helpers shared by the training-data operators: scratch tables in the shared folder, ranks
inside integer classes, and NumPy kernels that cut Arrow text columns into hashed words.

Text kernels work on UTF-8 bytes.  Word rules that name only ASCII characters hold on bytes as
well, because every byte of a longer UTF-8 sequence is at least 0x80.  Batches are handled in
slices of a few megabytes, so a task's memory does not follow the size of its partition.
"""

from __future__ import annotations

import uuid
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from claimlens.session import checkpoint_dir, ship_package

SLICE_BYTES = 1 << 20


#: Rows of whole texts in one Arrow batch.
BATCH_ROWS = 1000


def ready(spark: SparkSession) -> None:
    """Ship the package to the Python workers and keep Arrow batches of whole texts small, so that a
    worker holds a few megabytes of text at a time."""
    ship_package(spark)
    key = "spark.sql.execution.arrow.maxRecordsPerBatch"
    if not 0 < int(spark.conf.get(key)) <= BATCH_ROWS:
        spark.conf.set(key, str(BATCH_ROWS))


# ---------------------------------------------------------------- shared scratch tables

def scratch_path(spark: SparkSession, tag: str) -> str:
    """A new path in the folder that ``spark.checkpoint.dir`` names."""
    return f"{checkpoint_dir(spark).rstrip('/')}/llm-{tag}-{uuid.uuid4().hex}"


def materialise(df: DataFrame, tag: str) -> DataFrame:
    """Write ``df`` as Parquet into the shared folder and read it back: cuts the lineage, and what
    follows reads the same rows however often a task runs again."""
    spark = df.sparkSession
    ready(spark)
    path = scratch_path(spark, tag)
    df.write.parquet(path)
    out = spark.read.schema(df.schema).parquet(path)
    out._scratch_path = path
    return out


def release(df: DataFrame) -> None:
    """Delete a scratch table that nothing lazy refers to any more."""
    path = getattr(df, "_scratch_path", None)
    if path:
        jvm, spark = df.sparkSession._jvm, df.sparkSession
        p = jvm.org.apache.hadoop.fs.Path(path)
        p.getFileSystem(spark._jsc.hadoopConfiguration()).delete(p, True)


def plain_id(docs: DataFrame, doc_id: str) -> tuple[Column, T.DataType]:
    """The id column as ``doc_id`` and its type: whole numbers as longs, ids of any other type as they are."""
    kind = docs.schema[doc_id].dataType
    if isinstance(kind, T.IntegralType):
        return F.col(doc_id).cast("long").alias("doc_id"), T.LongType()
    return F.col(doc_id).alias("doc_id"), kind


def text_crc32(c: Column) -> Column:
    return F.crc32(F.encode(c, "UTF-8"))


def fold(doc_id: Column, k: int) -> Column:
    """crc32(doc_id as text) mod k; a null doc_id counts as empty text."""
    return (F.crc32(F.encode(F.coalesce(doc_id.cast("string"), F.lit("")), "UTF-8")) % k).cast("int")


# ---------------------------------------------------------------- ranks inside classes

def range_ranks(df: DataFrame, cls: str, order: list[str], tag: str) -> tuple[DataFrame, DataFrame]:
    """Give every row a ``rank`` (0, 1, ...) among the rows of its class ``cls`` (an integer column).

    Rows are range-sorted by (class descending, ``order``), so a class of any size spreads over
    as many partitions as it needs.  Each partition numbers its rows per class; the starts are
    running sums over the few (class, partition) counts.  Returns the ranked rows and the class
    histogram (``cls``, ``n``).  ``df`` is read twice (the range bounds are sampled): pass a
    written table.
    """
    schema = T.StructType(df.schema.fields + [T.StructField("pid", T.IntegerType()), T.StructField("local", T.LongType())])

    def number(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pid, seen = TaskContext.get().partitionId(), {}
        for b in batches:
            if not b.num_rows:
                continue
            c = b.column(b.schema.get_field_index(cls)).to_numpy(zero_copy_only=False)
            by = np.argsort(c, kind="stable")
            s = c[by]
            starts = np.flatnonzero(np.r_[True, s[1:] != s[:-1]])
            sizes = np.diff(np.r_[starts, len(s)])
            base = np.array([seen.get(k, 0) for k in s[starts].tolist()], np.int64)
            for k, n in zip(s[starts].tolist(), sizes.tolist(), strict=True):
                seen[k] = seen.get(k, 0) + n
            local = np.empty(len(c), np.int64)
            local[by] = np.arange(len(s)) - np.repeat(starts, sizes) + np.repeat(base, sizes)
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(np.full(len(c), pid, np.int32)), pa.array(local)],
                                             names=[*b.schema.names, "pid", "local"])

    ordered = df.repartitionByRange(F.col(cls).desc(), *order).sortWithinPartitions(F.col(cls).desc(), *order)
    numbered = materialise(ordered.mapInArrow(number, schema), tag)
    counts = numbered.groupBy(cls, "pid").agg(F.count("*").alias("n"))
    before = Window.partitionBy(cls).orderBy("pid").rowsBetween(Window.unboundedPreceding, -1)
    starts = counts.select(cls, "pid", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("first"))
    ranked = numbered.join(starts, [cls, "pid"]).withColumn("rank", F.col("first") + F.col("local")).drop("pid", "local", "first")
    return ranked, counts.groupBy(cls).agg(F.sum("n").alias("n"))


# ---------------------------------------------------------------- words of an Arrow text column

def byte_table(spans: list[tuple[int, int]]) -> np.ndarray:
    """True for bytes outside the given inclusive spans."""
    t = np.ones(256, bool)
    for a, b in spans:
        t[a:b + 1] = False
    return t


#: [^\x20\x09-\x0D]+
BLANK_SEPARATED = byte_table([(0x20, 0x20), (0x09, 0x0D)])
#: [^\x00-\x2F\x3A-\x60\x7B-\x7F]+ after lower-casing A-Z
ALNUM = byte_table([(0x00, 0x2F), (0x3A, 0x40), (0x5B, 0x60), (0x7B, 0x7F)])

_RNG = np.random.default_rng(20240607)
_SYMBOL = _RNG.integers(1, 1 << 63, 256, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_SYMBOL_LOWER = _SYMBOL.copy()
_SYMBOL_LOWER[65:91] = _SYMBOL[97:123]
_BASE = np.uint64(0x9E3779B97F4A7C15 | 1)
_BASE_INV = np.uint64(pow(int(_BASE), -1, 1 << 64))
_GRAM = np.uint64(0xD6E8FEB86659FD93)


def mix64(x: np.ndarray) -> np.ndarray:
    """Bijective finaliser of 64-bit hashes."""
    x = (x ^ (x >> np.uint64(32))) * np.uint64(0xD6E8FEB86659FD93)
    x = (x ^ (x >> np.uint64(32))) * np.uint64(0xD6E8FEB86659FD93)
    return x ^ (x >> np.uint64(32))


_POWERS: dict[int, np.ndarray] = {}


def powers(base: np.uint64, n: int) -> np.ndarray:
    """base ** 0 .. base ** (n - 1) modulo 2 ** 64; the usual slice length is kept for the next call."""
    p = _POWERS.get(int(base))
    if p is None or len(p) < n:
        p = np.full(max(n, 1, SLICE_BYTES), base, np.uint64)
        p[0] = 1
        p = np.multiply.accumulate(p)
        if len(p) <= 2 * SLICE_BYTES:
            _POWERS[int(base)] = p
    return p[:n]


def utf8(col: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Bytes and row offsets of a text column; a null row is empty."""
    if isinstance(col, pa.ChunkedArray):
        col = col.combine_chunks()
    col = pc.fill_null(col.cast(pa.large_string()), "")
    _, off, data = col.buffers()
    offs = np.frombuffer(off, np.int64)[col.offset:col.offset + len(col) + 1]
    raw = np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8)
    return raw[offs[0]:offs[-1]], offs - offs[0]


def slices(batch: pa.RecordBatch, text: str, most: int = SLICE_BYTES) -> Iterator[tuple[pa.RecordBatch, np.ndarray, np.ndarray]]:
    """Row ranges of a batch with about ``most`` bytes of text each (one row at least): the part of
    the batch, its bytes and its row offsets."""
    col = batch.column(batch.schema.get_field_index(text))
    ends = np.cumsum(pc.fill_null(pc.binary_length(col), 0).to_numpy(zero_copy_only=False).astype(np.int64))
    i, n, before = 0, batch.num_rows, 0
    while i < n:
        j = max(i + 1, int(np.searchsorted(ends, before + most, "right")))
        part = batch.slice(i, j - i)
        yield part, *utf8(col.slice(i, j - i))  # only this part is copied
        i, before = j, ends[j - 1]


def gathered(batches: Iterator[pa.RecordBatch], text: str, most: int) -> Iterator[pa.RecordBatch]:
    """Batches joined until they hold about ``most`` bytes of text, and cut where they hold more."""
    held, size = [], 0
    for b in batches:
        for part, data, _ in slices(b, text, most):
            held.append(part)
            size += len(data)
            if size >= most:
                yield pa.concat_batches(held)
                held, size = [], 0
    if held:
        yield pa.concat_batches(held)


class Words:
    """Words of consecutive texts: byte ``start``/``end``, and ``first``, the index of each text's
    first word (one more entry than texts)."""

    def __init__(self, data: np.ndarray, offs: np.ndarray, keep: np.ndarray):
        w = keep[data]
        before, after = np.zeros(len(w), bool), np.zeros(len(w), bool)
        before[1:], after[:-1] = w[:-1], w[1:]
        full = offs[:-1][offs[1:] > offs[:-1]]
        before[full] = False
        after[offs[1:][offs[1:] > offs[:-1]] - 1] = False
        self.data, self.offs = data, offs
        self.start = np.flatnonzero(w & ~before)
        self.end = np.flatnonzero(w & ~after) + 1
        self.first = np.searchsorted(self.start, offs)

    def __len__(self) -> int:
        return len(self.start)

    def hashes(self, lower: bool = True) -> np.ndarray:
        """64-bit hash of every word (prefix sums of a polynomial in the bytes)."""
        if not len(self):
            return np.zeros(0, np.uint64)
        n = len(self.data)
        sums = np.zeros(n + 1, np.uint64)
        np.cumsum((_SYMBOL_LOWER if lower else _SYMBOL)[self.data] * powers(_BASE, n), out=sums[1:])
        return mix64((sums[self.end] - sums[self.start]) * powers(_BASE_INV, n)[self.start])

    def counts(self) -> np.ndarray:
        return np.diff(self.first)


def gram_hashes(words: np.ndarray, k: int) -> np.ndarray:
    """Hash of the k words from each position on (k-1 fewer entries than words)."""
    n = len(words) - k + 1
    if n <= 0:
        return np.zeros(0, np.uint64)
    g = words[:n].copy()
    for j in range(1, k):
        g = g * _GRAM + words[j:n + j]
    return mix64(g)


def pack_ints(a: np.ndarray) -> bytes:
    """Small non-negative integers as compressed byte planes."""
    a = np.ascontiguousarray(a, np.uint32)
    return zlib.compress(a.view(np.uint8).reshape(-1, 4).T.tobytes(), 1)


def unpack_ints(b: bytes) -> np.ndarray:
    planes = np.frombuffer(zlib.decompress(b), np.uint8).reshape(4, -1)
    return np.ascontiguousarray(planes.T).view(np.uint32).ravel()


def pack_longs(a: np.ndarray) -> bytes:
    """64-bit non-negative integers as compressed byte planes."""
    return zlib.compress(np.ascontiguousarray(a, np.uint64).view(np.uint8).reshape(-1, 8).T.tobytes(), 1)


def unpack_longs(b: bytes) -> np.ndarray:
    return np.ascontiguousarray(np.frombuffer(zlib.decompress(b), np.uint8).reshape(8, -1).T).view(np.uint64).ravel()


# ---------------------------------------------------------------- joins on ids

#: Most ids that a join may broadcast (about 64 MB as a hash relation).
BROADCAST_IDS = 2_000_000


def by_ids(df: DataFrame, ids: DataFrame, on: str, how: str) -> DataFrame:
    """Semi or anti join of wide rows with a written table of distinct ids: the ids are broadcast when
    a count proves them few, so the rows stay where they are; beyond that it is a join by shuffle."""
    return df.join(F.broadcast(ids) if ids.count() <= BROADCAST_IDS else ids, on, how)
