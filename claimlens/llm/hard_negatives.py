"""Hard-negative mining by Kronecker-packed inner products.

A block of candidates becomes one wide integer per component: every candidate's component, made
non-negative by a bias, sits in a field of its own.  One multiplication of that integer by an anchor's
component multiplies all candidates at once; the sum over the components holds every exact inner product in
its field, and the biases are taken off after unpacking.  Fields are wide enough for the largest sum that
the two blocks at hand can give, so nothing carries into a neighbour, whatever the components.

Work: anchors and candidates are cut into blocks of bounded size, and every anchor block meets every candidate
block in a task of its own (a stated query set against all rows, in blocks).  A task keeps the best few per
anchor, so the result rows of a pass are few.  Two passes: the first finds each anchor's positives, the
second its negatives inside the score window of each positive.

Defined results: rows with a null id, null label, null vector or a null or non-finite component take no part;
a shorter vector counts as if filled up with zeros; rows of one id are never each other's positives, and
a repeated row counts as often as it occurs (as anchor and as candidate); equal scores are ordered by id; scores beyond 64
bits are held at the limits of a long; an anchor without positives, or a positive without negatives, gives
no row; columns of other names are not read; an empty table gives an empty result.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from claimlens.llm.common import materialise, ready

#: Rows of a block: an anchor block and a candidate block meet in one task.
BLOCK_ROWS = 4096
#: Components of a block: long vectors make blocks of fewer rows.
BLOCK_VALUES = 1 << 20
LONG = (1 << 63) - 1


def integers(x: np.ndarray, scale: int) -> np.ndarray:
    """floor(scale * x) exactly: int64 where it fits, else Python integers (``scale`` is a power of two)."""
    x = np.asarray(x, np.float64)
    if not x.size or np.abs(x).max() < 2.0 ** 40:
        return np.floor(x * scale).astype(np.int64)
    # from 2 ** 44 on a double times the scale is whole already
    return np.array([scale * int(v) if abs(v) >= 2.0 ** 52 else int(np.floor(v * scale)) for v in x.ravel()], object).reshape(x.shape)


def padded(column: pa.Array, width: int) -> np.ndarray:
    """Vectors of a list column as a matrix of ``width`` columns, shorter ones filled up with zeros."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    lengths = np.diff(column.offsets.to_numpy()) if len(column) else np.zeros(0, np.int64)
    flat = column.flatten().to_numpy(zero_copy_only=False).astype(np.float64)
    if len(column) and (lengths == width).all():
        return flat.reshape(len(column), width)
    out = np.zeros((len(column), width))
    out[np.arange(width) < lengths[:, None]] = flat
    return out


class PackedBlock:
    """Candidates of one block, packed for inner products with integer anchors.

    ``rows`` holds one candidate a row.  The biased component j of candidate c is the c-th field, of
    ``8 * width`` bits, of the wide integer ``self.packed[j]``.
    """

    def __init__(self, rows: np.ndarray, anchors: np.ndarray):
        self.n = len(rows)
        low, high = (int(rows.min()), int(rows.max())) if rows.size else (0, 0)
        self.bias, spread = -low, high - low
        weight = max((sum(map(abs, a)) for a in anchors.tolist()), default=0)
        # a sum of field products lies within +-weight * spread: twice that, once lifted above zero
        bits = (2 * weight * spread + 1).bit_length()
        self.width = 4 if bits <= 32 else 8 if bits <= 64 else -(-bits // 8)
        self.spread = spread
        lifted = (rows + self.bias).T
        if self.width <= 8:
            kind = np.dtype("<u4" if self.width == 4 else "<u8")
            self.packed = [int.from_bytes(np.ascontiguousarray(c).astype(kind).tobytes(), "little") for c in lifted]
        else:
            self.packed = [int.from_bytes(b"".join(int(v).to_bytes(self.width, "little") for v in c), "little") for c in lifted]
        self.ones = int.from_bytes((1).to_bytes(self.width, "little") * self.n, "little")

    def scores(self, anchor: np.ndarray) -> np.ndarray:
        """Exact inner products of the anchor with every candidate, held at the limits of a long."""
        a = anchor.tolist()
        lift = self.spread * sum(map(abs, a))
        total = lift * self.ones
        for x, fields in zip(a, self.packed, strict=True):
            if x:
                total += x * fields
        back = lift + self.bias * sum(a)
        raw = total.to_bytes(self.width * self.n, "little")
        if self.width <= 8 and abs(back) <= LONG and lift * 2 <= LONG:
            return np.frombuffer(raw, "<u4" if self.width == 4 else "<u8").astype(np.int64) - back
        w = self.width
        exact = (int.from_bytes(raw[i:i + w], "little") - back for i in range(0, w * self.n, w))
        return np.fromiter((max(-LONG - 1, min(LONG, s)) for s in exact), np.int64, self.n)


class _Pair:
    """One anchor block against one candidate block; candidates in order of id."""

    def __init__(self, left: pa.Table, right: pa.Table, scale: int):
        ids = right.column("c_id").to_numpy()
        by = np.argsort(ids, kind="stable")
        self.ids = ids[by]
        self.labels = right.column("c_label").to_numpy()[by]
        width = max(int(np.diff(t.combine_chunks().offsets.to_numpy()).max(initial=0)) for t in (left.column("vector"), right.column("c_vector")))
        self.anchors = integers(padded(left.column("vector"), width), scale)
        self.block = PackedBlock(integers(padded(right.column("c_vector"), width), scale)[by], self.anchors)

    def ranked(self, i: int, keep: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Positions of the candidates in ``keep`` by falling score, ties by id, and their scores."""
        s = self.block.scores(self.anchors[i])[keep]
        order = np.argsort(~s, kind="stable")  # ~s = -s - 1 has no overflow
        return keep[order], s[order]


_FOUND = T.StructType([T.StructField("uid", T.LongType()), T.StructField("positive", T.IntegerType()),
                       T.StructField("vec_id", T.LongType()), T.StructField("score", T.LongType())])


def _table(rows: list[tuple[int, int, int, int]]) -> pa.Table:
    a = np.array(rows, np.int64).reshape(-1, 4)
    return pa.table({"uid": a[:, 0], "positive": a[:, 1].astype(np.int32), "vec_id": a[:, 2], "score": a[:, 3]})


def _positives(k: int, scale: int):
    def fn(left: pa.Table, right: pa.Table) -> pa.Table:
        out = []
        if left.num_rows and right.num_rows:
            pair = _Pair(left, right, scale)
            for i, (uid, vec_id, label) in enumerate(zip(*(left.column(c).to_pylist() for c in ("uid", "vec_id", "label")), strict=True)):
                keep = np.flatnonzero((pair.labels == label) & (pair.ids != vec_id))
                if len(keep):
                    at, s = pair.ranked(i, keep)
                    out += [(uid, 0, int(pair.ids[j]), int(v)) for j, v in zip(at[:k], s[:k], strict=True)]
        return _table(out)
    return fn


def window(positive: int, low: tuple[int, int], high: tuple[int, int]) -> tuple[int, int]:
    """Smallest and largest whole score from low x positive to high x positive (fractions)."""
    return -(-low[0] * positive // low[1]), high[0] * positive // high[1]


def _negatives(k: int, scale: int, low: tuple[int, int], high: tuple[int, int]):
    def fn(left: pa.Table, right: pa.Table) -> pa.Table:
        out = []
        if left.num_rows and right.num_rows:
            pair = _Pair(left, right, scale)
            for i, (uid, label, positives) in enumerate(zip(*(left.column(c).to_pylist() for c in ("uid", "label", "positives")), strict=True)):
                keep = np.flatnonzero(pair.labels != label)
                if not len(keep):
                    continue
                at, s = pair.ranked(i, keep)
                rising = s[::-1]
                for p in positives:
                    least, most = window(p["score"], low, high)
                    if least > most or least > LONG or most < -LONG - 1:
                        continue
                    first = len(s) - int(np.searchsorted(rising, min(most, LONG), "right"))
                    past = len(s) - int(np.searchsorted(rising, max(least, -LONG - 1), "left"))
                    out += [(uid, p["r"], int(pair.ids[at[j]]), int(s[j])) for j in range(first, min(past, first + k))]
        return _table(out)
    return fn


def best(found: DataFrame, by: list[str], k: int) -> DataFrame:
    """The k best rows per key with their rank ``r`` (tasks keep their own best before the shuffle)."""
    order = Window.partitionBy(*by).orderBy(F.desc("score"), "vec_id")
    return found.withColumn("r", F.row_number().over(order)).filter(F.col("r") <= k)


def usable(df: DataFrame, vec_id: str, vector: str, label: Column) -> DataFrame:
    """Rows that take part: (vec_id, label, vector)."""
    finite = lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < F.lit(float("inf")))
    named = df.select(F.col(vec_id).cast("long").alias("vec_id"), label.cast("long").alias("label"), F.col(vector).alias("vector"))
    return named.filter("vec_id is not null and label is not null and vector is not null").filter(F.forall("vector", finite))


def mine(df: DataFrame, anchors: Column, label: Column, vec_id: str = "vec_id", vector: str = "embedding", scale: int = 256,
         positives: int = 5, negatives: int = 3, low: tuple[int, int] = (1, 2), high: tuple[int, int] = (19, 20), block_rows: int = BLOCK_ROWS) -> DataFrame:
    """Hard negatives of every anchor and positive.

    ``anchors`` is a condition on ``vec_id`` and ``label`` that says which rows ask; ``label`` is the label expression over
    the table.  Scores are inner products of floor(scale * component).  Negatives carry another label and score from
    ``low`` to ``high`` (fractions) of the positive.  Returns (anchor_id, positive_id, rank, negative_id,
    positive_score, negative_score).
    """
    spark = df.sparkSession
    ready(spark)
    rows = materialise(usable(df, vec_id, vector, label).withColumn("uid", F.monotonically_increasing_id()), "negatives-rows")
    asks = rows.filter(anchors)
    n_rows, n_asks, width = rows.agg(F.count("*"), F.count_if(anchors), F.max(F.size("vector"))).first()
    block_rows = max(1, min(block_rows, BLOCK_VALUES // max(1, width or 1)))
    c_blocks, a_blocks = max(1, -(-n_rows // block_rows)), max(1, -(-n_asks // block_rows))
    spread = lambda n, salt: F.pmod(F.xxhash64("uid", F.lit(salt)), F.lit(n)).cast("int")
    every = lambda n: F.explode(F.sequence(F.lit(0), F.lit(n - 1)))
    pair = ["a_block", "c_block"]
    # both sides come from one table: the candidates' columns get names of their own
    right = rows.select(spread(c_blocks, 1).alias("c_block"), F.col("vec_id").alias("c_id"), F.col("label").alias("c_label"),
                        F.col("vector").alias("c_vector")).select("*", every(a_blocks).alias("a_block"))
    placed = asks.withColumn("a_block", spread(a_blocks, 2))

    def search(left: DataFrame, fn) -> DataFrame:
        left = left.select("*", every(c_blocks).alias("c_block"))
        return left.groupBy(*pair).cogroup(right.groupBy(*pair)).applyInArrow(lambda a, c: fn(a, c), _FOUND)

    near = best(search(placed, _positives(positives, scale)), ["uid"], positives)
    near = materialise(near.select("uid", "r", F.col("vec_id").alias("positive_id"), F.col("score").alias("positive_score")), "negatives-positives")
    listed = near.groupBy("uid").agg(F.sort_array(F.collect_list(F.struct("r", F.col("positive_score").alias("score")))).alias("positives"))
    found = search(placed.join(listed, "uid"), _negatives(negatives, scale, low, high))
    ranked = best(found, ["uid", "positive"], negatives).select("uid", F.col("positive").alias("r"), F.col("r").alias("rank"),
                                                               F.col("vec_id").alias("negative_id"), F.col("score").alias("negative_score"))
    out = ranked.join(near, ["uid", "r"]).join(asks.select("uid", F.col("vec_id").alias("anchor_id")), "uid")
    return out.select("anchor_id", "positive_id", "rank", "negative_id", "positive_score", "negative_score")
