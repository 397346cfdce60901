"""Vector codes: product quantisation in integers, with distances through a Walsh-Hadamard transform.

A vector's scaled components are floored to integers and cut into equal consecutive parts.  Every part position
has a codebook; a part's code is the index of its nearest entry.  Parts and entries are filled up with zeros to a
power of two, m, and transformed by the integer Walsh-Hadamard matrix, whose rows are put in order of
sequency (sign changes).  The transform multiplies squared distances by m exactly, so the squared differences of
the coefficients, added up in that order, are a growing lower bound of m times the distance: an entry whose sum
passes the whole distance of a better one is out, most of them after the first, smooth coefficients.  All sums are
integers: 64 bits where the components at hand prove that enough, Python integers beyond.

Training is a Spark job per round: tasks keep one running sum and count per entry, a shuffle adds up the
tasks' sums, and only the codebooks (parts x entries x part length integers) go through the driver.

Defined results: rows with a null vector, or a null or non-finite component, are dropped; a null id or label
is a value like any other (null ids last among the first entries, null labels together); shorter vectors are filled up
with zeros to the longest kept one and to a multiple of the parts; fewer rows than entries give a smaller
codebook; repeated rows count each; equal distances take the lower index; scaled components beyond 10^18 are
held there, errors beyond a long at its largest value; an empty table gives an empty result.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from decimal import Decimal

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from claimlens.llm.common import BROADCAST_IDS, materialise, ready

LONG = (1 << 63) - 1
LIMIT = 10 ** 18


def sequency(m: int) -> np.ndarray:
    """Rows of the m x m Hadamard matrix in natural order, sorted by their number of sign changes."""
    h = np.ones((1, 1), np.int64)
    while len(h) < m:
        h = np.block([[h, h], [h, -h]])
    return np.argsort((np.diff(h, axis=1) != 0).sum(axis=1), kind="stable")


def transform(x: np.ndarray) -> np.ndarray:
    """Walsh-Hadamard coefficients of every row, in order of sequency (a row is filled up to a power of two)."""
    n, width = x.shape
    m = 1 << max(0, width - 1).bit_length()
    y = np.zeros((n, m), x.dtype)
    y[:, :width] = x
    half = 1
    while half < m:
        pairs = y.reshape(n, m // (2 * half), 2, half)
        y = np.stack([pairs[:, :, 0] + pairs[:, :, 1], pairs[:, :, 0] - pairs[:, :, 1]], axis=2).reshape(n, m)
        half *= 2
    return y[:, sequency(m)]


def nearest(x: np.ndarray, entries: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Index of the nearest entry of every row (ties to the lower one) and the squared distance."""
    n, m = len(x), 1 << max(0, x.shape[1] - 1).bit_length()
    most = max((int(np.abs(a).max()) for a in (x, entries) if a.size), default=0)
    # m times a distance is at most m * m * (2 most)^2
    if (2 * m * most) ** 2 > LONG:
        x, entries = x.astype(object), entries.astype(object)
    a, c = transform(x), transform(entries)
    if not n:
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    rows = np.arange(n)
    partial = (a[:, :1] - c[:, 0]) ** 2
    likely = partial.argmin(axis=1)
    bound = ((a - c[likely]) ** 2).sum(axis=1)
    row, entry = np.nonzero(partial <= bound[:, None])
    partial = partial[row, entry]
    for j in range(1, m):
        partial = partial + (a[row, j] - c[entry, j]) ** 2
        stay = partial <= bound[row]
        if not stay.all():
            row, entry, partial = row[stay], entry[stay], partial[stay]
    # rows are in order and every row's likely entry is still there: the first of the least sums wins
    starts = np.searchsorted(row, rows)
    least = np.minimum.reduceat(partial, starts)
    hits = np.flatnonzero(partial == least[row])
    first = hits[np.searchsorted(row[hits], rows)]
    return entry[first], least // m


def matrix(column: pa.Array, width: int) -> np.ndarray:
    """A list column of integers as rows of ``width`` columns, shorter ones filled up with zeros."""
    flat = column.flatten().to_numpy(zero_copy_only=False).astype(np.int64)
    lengths = np.diff(column.offsets.to_numpy()) if len(column) else np.zeros(0, np.int64)
    if (lengths == width).all():
        return flat.reshape(len(column), width)
    out = np.zeros((len(column), width), np.int64)
    out[np.arange(width) < lengths[:, None]] = flat
    return out


def _field(b: pa.RecordBatch, name: str) -> pa.Array:
    return b.column(b.schema.get_field_index(name))


_SUMS = T.StructType([T.StructField("part", T.IntegerType()), T.StructField("entry", T.IntegerType()), T.StructField("place", T.IntegerType()),
                      T.StructField("total", T.DecimalType(38, 0)), T.StructField("n", T.LongType())])


def _sums(books: np.ndarray):
    parts, k, width = books.shape

    def fn(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total, count = np.zeros((parts, k, width), object), np.zeros((parts, k), np.int64)
        for b in batches:
            x = matrix(_field(b, "v"), parts * width)
            fits = not x.size or int(np.abs(x).max()) * max(1, len(x)) <= LONG
            for p in range(parts):
                piece = x[:, p * width:(p + 1) * width]
                at, _ = nearest(piece, books[p])
                count[p] += np.bincount(at, minlength=k)
                for e in np.unique(at):
                    total[p, e] += (piece if fits else piece.astype(object))[at == e].sum(axis=0).astype(object)
        used = np.argwhere(count > 0)
        cells = [(p, e, i, total[p, e, i], count[p, e]) for p, e in used.tolist() for i in range(width)]
        if cells:
            part, entry, place, sums, n = zip(*cells, strict=True)
            yield pa.RecordBatch.from_arrays([pa.array(part, pa.int32()), pa.array(entry, pa.int32()), pa.array(place, pa.int32()),
                                              pa.array([Decimal(int(s)) for s in sums], pa.decimal128(38, 0)), pa.array([int(c) for c in n], pa.int64())],
                                             names=_SUMS.names)
    return fn


def _codes(books: np.ndarray):
    parts, _, width = books.shape

    def fn(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            x = matrix(_field(b, "v"), parts * width)
            found = [nearest(x[:, p * width:(p + 1) * width], books[p]) for p in range(parts)]
            error = sum((d.astype(object) for _, d in found), np.zeros(len(x), object))
            codes = ["".join(f"{e:02x}" for e in row) for row in np.stack([at for at, _ in found], axis=1).tolist()]
            yield pa.RecordBatch.from_arrays([_field(b, "vec_id"), _field(b, "label"), pa.array(codes, pa.string()),
                                              pa.array([min(int(e), LONG) for e in error], pa.int64())], names=["vec_id", "label", "code", "error"])
    return fn


def train(rows: DataFrame, parts: int, entries: int, rounds: int) -> np.ndarray:
    """Codebooks (parts x entries x part length) of a written table of integer vectors (vec_id, label, v)."""
    first = [r["v"] for r in rows.orderBy(F.col("vec_id").asc_nulls_last(), "v").limit(entries).collect()]
    longest = rows.agg(F.max(F.size("v"))).first()[0] or 0
    width = -(-longest // parts)
    start = np.array([v + [0] * (parts * width - len(v)) for v in first], np.int64).reshape(len(first), parts, width)
    books = np.ascontiguousarray(start.transpose(1, 0, 2))
    for _ in range(rounds if first and width else 0):
        sums = rows.select("v").mapInArrow(_sums(books), _SUMS).groupBy("part", "entry", "place").agg(F.sum("total").alias("total"), F.sum("n").alias("n"))
        for p, e, i, total, n in sums.collect():  # one row per component of the codebooks
            books[p, e, i] = int(total) // n
    return books


def digest(books: np.ndarray) -> str:
    return hashlib.sha256(",".join(map(str, books.ravel().tolist())).encode()).hexdigest()


def decode(code: str, books: np.ndarray) -> np.ndarray:
    """The vector of integers that a code stands for."""
    return np.concatenate([books[p, int(code[2 * p:2 * p + 2], 16)] for p in range(len(books))])


def compress(df: DataFrame, vec_id: str = "vec_id", vector: str = "embedding", label: str = "label", parts: int = 8, entries: int = 16,
             rounds: int = 6, scale: int = 4096) -> tuple[DataFrame, np.ndarray]:
    """Codes (vec_id, label, code, error) of every usable row as a written table, and the codebooks.

    Codes hold two hex digits a part (``entries`` at most 256); ``error`` is the squared distance, in
    scaled integers, between the row and its code's vector.
    """
    ready(df.sparkSession)
    named = df.select(F.col(vec_id).alias("vec_id"), F.col(label).alias("label"), F.col(vector).alias("v")).filter("v is not null")
    finite = lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < F.lit(float("inf")))
    held = lambda x: F.floor(F.greatest(F.least(x.cast("double") * scale, F.lit(float(LIMIT))), F.lit(-float(LIMIT)))).cast("long")
    rows = materialise(named.filter(F.forall("v", finite)).withColumn("v", F.transform("v", held)), "codes-rows")
    books = train(rows, parts, entries, rounds)
    schema = T.StructType([*rows.schema.fields[:2], T.StructField("code", T.StringType()), T.StructField("error", T.LongType())])
    return materialise(rows.mapInArrow(_codes(books), schema), "codes"), books


def with_label_error(codes: DataFrame) -> DataFrame:
    """Adds ``label_error``, the error summed over the rows of one label (null labels together)."""
    total = F.least(F.sum(F.col("error").cast("decimal(38,0)")), F.lit(LONG).cast("decimal(38,0)")).cast("long")
    sums = materialise(codes.groupBy(F.col("label").alias("of")).agg(total.alias("label_error")), "codes-labels")
    small = F.broadcast(sums) if sums.count() <= BROADCAST_IDS else sums
    return codes.join(small, F.col("label").eqNullSafe(F.col("of"))).drop("of")
