"""Exact k nearest neighbours of every row of a table, as a Spark join.

Rows go to the nearest of a bounded number of pivots (a deterministic sample); a cell's rows are sorted by
their distance to the pivot and cut into blocks of bounded size, rings that know their least and largest distance.  A
row's neighbours inside its own block give a first radius.  By the triangle inequality a block of pivot p can
hold nothing nearer than

    max(d(x, p) - outer, inner - d(x, p), (d(x, p)^2 - d(x, q)^2) / (2 d(p, q)))

(q is the row's own pivot), so a row asks only the blocks where that bound lies under its radius; all others are
certain to hold no nearer row.  Blocks that follow each other make groups of bounded bytes: a row is sent once to each group with a block that it
asks, and meets there only the blocks that it asks, so rows x groups copies travel at most, not rows x blocks.  The k nearest of all
blocks asked are kept by rank.

Hot cells and groups of equal rows are many blocks, none larger than another; a row with k copies of its own in its block has radius 0 and
asks nobody.  Distances are screened by a matrix product with a
proven error bound and then computed from differences.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from claimlens.session import ship_package, written

#: Blocks at most (their bounds, some 40 bytes each, go to every task); beyond, blocks get larger.
MOST_BLOCKS = 1 << 17
#: Rows that ask one part of a block's search.
ASKERS = 8192
#: Bytes of vectors in a group of blocks; two groups meet in a task.
GROUP_BYTES = 32 << 20
#: Groups that smaller tables are cut into, for the sake of parallel tasks.
GROUPS = 8
#: Share of the squared norms that the screening product may be off.
SLACK = 1e-10
_FOUND = T.StructType([T.StructField("uid", T.LongType()), T.StructField("other", T.LongType()), T.StructField("d2", T.DoubleType())])


def matrix(column: pa.ChunkedArray | pa.Array, width: int) -> np.ndarray:
    """Vectors as rows of a matrix; shorter ones are filled up with zeros."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    flat = column.flatten().to_numpy(zero_copy_only=False).astype(np.float64)
    lengths = np.diff(column.offsets.to_numpy()) if len(column) else np.zeros(0, np.int64)
    if (lengths == width).all():
        return flat.reshape(len(column), width)
    out = np.zeros((len(column), width))
    out[np.arange(width) < lengths[:, None]] = flat
    return out


def squares(x: np.ndarray, y: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Screened squared distances of all pairs, and how far each may be off."""
    xx, yy = (x * x).sum(axis=1), (y * y).sum(axis=1)
    total = xx[:, None] + yy
    return np.maximum(total - 2 * (x @ y.T), 0), SLACK * total


def nearest(x: np.ndarray, asker: np.ndarray, y: np.ndarray, uid: np.ndarray, k: int, chunk: int = 1 << 21) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """(row, other, squared distance) of the k nearest rows of ``y`` for each row of ``x``, itself left out."""
    by = np.argsort(uid, kind="stable")
    y, uid = y[by], uid[by]
    step = max(1, chunk // max(1, len(y)))
    for i in range(0, len(x), step):
        near, off = squares(x[i:i + step], y)
        own = asker[i:i + step, None] == uid
        near[own] = np.inf
        kth = np.partition(near + off, min(k, len(y)) - 1, axis=1)[:, min(k, len(y)) - 1]
        row, col = np.nonzero((near - off <= kth[:, None]) & ~own)
        d = np.empty(len(row))
        for a in range(0, len(row), 1 << 15):
            d[a:a + (1 << 15)] = ((x[i + row[a:a + (1 << 15)]] - y[col[a:a + (1 << 15)]]) ** 2).sum(axis=1)
        order = np.lexsort((col, d, row))
        row, col, d = row[order], col[order], d[order]
        first = np.searchsorted(row, row)
        keep = np.arange(len(row)) - first < k
        yield i + row[keep], uid[col[keep]], d[keep]


def _column(b, name: str):
    return b.column(b.schema.get_field_index(name))


def _with(b: pa.RecordBatch, **more: pa.Array) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([*b.columns, *more.values()], names=[*b.schema.names, *more])


def _assign(pivots: np.ndarray):
    def fn(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            x = matrix(_column(b, "vec"), pivots.shape[1])
            cell = squares(x, pivots)[0].argmin(axis=1) if len(x) else np.zeros(0, np.int64)
            dist = np.sqrt(((x - pivots[cell]) ** 2).sum(axis=1))
            yield _with(b, cell=pa.array(cell.astype(np.int32)), dist=pa.array(dist))
    return fn


def _cut(block_rows: int):
    def fn(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        block, held, last = TaskContext.get().partitionId() << 32, 0, None
        for b in batches:
            out = np.empty(b.num_rows, np.int64)
            for i, c in enumerate(_column(b, "cell").to_pylist()):
                if c != last or held == block_rows:
                    block, held, last = block + 1, 0, c
                out[i] = block
                held += 1
            yield _with(b, block=pa.array(out))
    return fn


def place(rows: DataFrame, pivots: np.ndarray, block_rows: int) -> DataFrame:
    """Rows (uid, vec) with their ``cell``, ``dist`` to its pivot and ``block``, as a written table."""
    f = [T.StructField("cell", T.IntegerType()), T.StructField("dist", T.DoubleType()), T.StructField("block", T.LongType())]
    cells = written(rows.mapInArrow(_assign(pivots), T.StructType([*rows.schema.fields, *f[:2]])), "near-cells")
    order = ["cell", "dist", "uid"]
    ranged = cells.repartitionByRange(*order).sortWithinPartitions(*order)
    return written(ranged.mapInArrow(_cut(block_rows), T.StructType([*rows.schema.fields, *f])), "near-blocks")


def _within(k: int, width: int):
    def fn(block: pa.Table) -> pa.Table:
        x, uid = matrix(block.column("vec"), width), block.column("uid").to_numpy()
        found = [(uid[row], other, d) for row, other, d in nearest(x, uid, x, uid, k)]
        return pa.table([np.concatenate([f[i] for f in found]) for i in range(3)], names=_FOUND.names)
    return fn


def bounds(x: np.ndarray, cell: np.ndarray, pivots: np.ndarray, of: np.ndarray, inner: np.ndarray, outer: np.ndarray) -> np.ndarray:
    """What no row of a block can be nearer to each row of ``x`` (never above the truth)."""
    sq, off = squares(x, pivots)
    low, high = np.sqrt(np.maximum(sq - off, 0)), np.sqrt(sq + off)
    apart = np.sqrt(((pivots[cell][:, None] - pivots) ** 2).sum(axis=2)) if pivots.size < 1 << 16 else np.sqrt(np.maximum(sum(squares(pivots[cell], pivots)), 0))
    own = np.arange(len(x)), cell
    gap = low ** 2 - high[own][:, None] ** 2
    plane = np.where(apart > 0, gap / (2 * np.where(apart > 0, apart, 1)), 0) * (1 - 1e-9)
    return np.maximum(np.maximum(low[:, of] - outer, inner - high[:, of]) * (1 - 1e-9), np.maximum(plane[:, of], 0))


def _route(pivots: np.ndarray, block: np.ndarray, of: np.ndarray, inner: np.ndarray, outer: np.ndarray, pairs: int = 1 << 14):
    def fn(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        step = max(1, (1 << 21) // max(1, len(block)))
        for b in batches:
            x, cell = matrix(_column(b, "vec"), pivots.shape[1]), _column(b, "cell").to_numpy()
            own, radius = _column(b, "block").to_numpy(), _column(b, "radius").to_numpy()
            for i in range(0, b.num_rows, step):
                j = min(b.num_rows, i + step)
                ask = (bounds(x[i:j], cell[i:j], pivots, of, inner, outer) < radius[i:j, None]) & (own[i:j, None] != block)
                row, at = np.nonzero(ask)
                for a in range(0, len(row), pairs):
                    part = b.select(["uid", "vec"]).take(pa.array(i + row[a:a + pairs]))
                    yield pa.RecordBatch.from_arrays([pa.array(block[at[a:a + pairs]]), *part.columns], names=["block", "uid", "vec"])
    return fn


def ask(placed: DataFrame, own: DataFrame, pivots: np.ndarray, k: int) -> DataFrame:
    """Rows (block, uid, vec): the blocks outside its own that a row's neighbours may lie in, as a written table."""
    stats = placed.groupBy("block").agg(F.first("cell").alias("cell"), F.min("dist").alias("lo"), F.max("dist").alias("hi")).orderBy("block").toArrow()
    radius = own.groupBy("uid").agg(F.when(F.count("*") >= k, F.sqrt(F.max("d2")) * (1 + 1e-12)).alias("radius"))
    rows = placed.join(radius, "uid", "left").select("uid", "vec", "cell", "block", F.coalesce("radius", F.lit(float("inf"))).alias("radius"))
    block, of, lo, hi = (stats.column(c).to_numpy() for c in ("block", "cell", "lo", "hi"))
    schema = T.StructType([T.StructField("block", T.LongType()), placed.schema["uid"], placed.schema["vec"]])
    return written(rows.mapInArrow(_route(pivots, block, of, lo, hi), schema), "near-asks")


@dataclass
class Blocks:
    """Blocks by number: cell, inner and outer distance, and the group they travel in."""
    block: np.ndarray
    of: np.ndarray
    inner: np.ndarray
    outer: np.ndarray
    group: np.ndarray


def grouped(placed: DataFrame, width: int, group_bytes: int = GROUP_BYTES) -> Blocks:
    """The blocks of a written table, in groups of at most ``group_bytes`` and an eighth of the rows (or of one block)."""
    stats = placed.groupBy("block").agg(F.first("cell").alias("cell"), F.min("dist").alias("lo"), F.max("dist").alias("hi"), F.count("*").alias("n")).orderBy("block").toArrow()
    block, of, lo, hi, n = (stats.column(c).to_numpy() for c in ("block", "cell", "lo", "hi", "n"))
    most = min(group_bytes // (8 * max(1, width)), -(-int(n.sum()) // GROUPS))
    group, held, now = np.zeros(len(block), np.int32), 0, 0
    for i, rows in enumerate(n.tolist()):
        if held and held + rows > most:
            now, held = now + 1, 0
        group[i], held = now, held + rows
    return Blocks(block, of, lo, hi, group)


def _asked(b: pa.RecordBatch, pivots: np.ndarray, blocks: Blocks) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """(first row, row, group) of the groups that rows of a batch ask, each once."""
    starts = np.flatnonzero(np.r_[True, blocks.group[1:] != blocks.group[:-1]])
    x, cell = matrix(_column(b, "vec"), pivots.shape[1]), _column(b, "cell").to_numpy()
    own, radius = _column(b, "block").to_numpy(), _column(b, "radius").to_numpy()
    step = max(1, (1 << 21) // max(1, len(blocks.block)))
    for i in range(0, b.num_rows, step):
        j = min(b.num_rows, i + step)
        ask = (bounds(x[i:j], cell[i:j], pivots, blocks.of, blocks.inner, blocks.outer) < radius[i:j, None]) & (own[i:j, None] != blocks.block)
        row, at = np.nonzero(np.logical_or.reduceat(ask, starts, axis=1))
        yield i, i + row, at.astype(np.int32)


def _pairs(pivots: np.ndarray, blocks: Blocks):
    """The (asking, asked) groups among a task's rows."""
    def fn(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen = set()
        for b in batches:
            home = blocks.group[np.searchsorted(blocks.block, _column(b, "block").to_numpy())]
            for _, row, at in _asked(b, pivots, blocks):
                seen.update(map(tuple, np.unique(np.stack([home[row], at], axis=1), axis=0).tolist()))
        if seen:
            yield pa.RecordBatch.from_arrays([pa.array(list(c), pa.int32()) for c in zip(*sorted(seen), strict=True)], names=["home", "away"])
    return fn


def _send(pivots: np.ndarray, blocks: Blocks, most: int = 1 << 13):
    """A row for each group that it asks."""
    def fn(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            home = blocks.group[np.searchsorted(blocks.block, _column(b, "block").to_numpy())]
            for _, row, at in _asked(b, pivots, blocks):
                for a in range(0, len(row), most):
                    r = row[a:a + most]
                    yield pa.RecordBatch.from_arrays([pa.array(home[r]), pa.array(at[a:a + most]), *b.take(pa.array(r)).columns], names=["home", "away", *b.schema.names])
    return fn


def _meet(k: int, pivots: np.ndarray, blocks: Blocks, rows: int = 2048):
    """The rows of one group against the blocks of another: up to k rows of each block for a row, none beyond its radius, which shrinks with
    what is found."""
    width = pivots.shape[1]

    def fn(left: pa.Table, right: pa.Table) -> pa.Table:
        found = [np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0)]
        if left.num_rows and right.num_rows:
            asker, cell, own, radius = (left.column(c).to_numpy() for c in ("uid", "cell", "block", "radius"))
            x, limit = matrix(left.column("vec"), width), radius ** 2
            right = right.sort_by([("yblock", "ascending"), ("yid", "ascending")])
            y, uid, of = matrix(right.column("y"), width), right.column("yid").to_numpy(), right.column("yblock").to_numpy()
            here, first = np.unique(of, return_index=True)
            place, last = np.searchsorted(blocks.block, here), np.r_[first[1:], len(of)]
            parts = []
            for i in range(0, len(x), rows):
                j = min(len(x), i + rows)
                low = bounds(x[i:j], cell[i:j], pivots, blocks.of[place], blocks.inner[place], blocks.outer[place])
                best = np.full((j - i, k), np.inf)
                kept = []
                for n in np.argsort(low.min(axis=0), kind="stable").tolist():
                    at = np.flatnonzero((low[:, n] < np.sqrt(limit[i:j]) * (1 + 1e-12)) & (own[i:j] != here[n]))
                    if not len(at):
                        continue
                    a, z = first[n], last[n]
                    near, off = squares(x[i + at], y[a:z])
                    hit = near - off <= limit[i + at][:, None]
                    if np.count_nonzero(hit) > 8 * k * len(at) and z - a > k:
                        hit &= near - off <= np.partition(near + off, k - 1, axis=1)[:, k - 1:k]
                    row, col = np.nonzero(hit)
                    if not len(row):
                        continue
                    d = np.empty(len(row))
                    for c in range(0, len(row), 1 << 15):
                        d[c:c + (1 << 15)] = ((x[i + at[row[c:c + (1 << 15)]]] - y[a + col[c:c + (1 << 15)]]) ** 2).sum(axis=1)
                    order = np.lexsort((uid[a + col], d, row))
                    row, col, d = row[order], col[order], d[order]
                    nth = np.arange(len(row)) - np.searchsorted(row, row)
                    row, col, d, nth = (v[nth < k] for v in (row, col, d, nth))
                    kept.append((at[row], uid[a + col], d))
                    more = np.full((len(at), k), np.inf)
                    more[row, nth] = d
                    best[at] = np.sort(np.hstack([best[at], more]), axis=1)[:, :k]
                    limit[i + at] = np.minimum(limit[i + at], best[at, k - 1] * (1 + 1e-12))
                if kept:
                    row, other, d = (np.concatenate(c) for c in zip(*kept, strict=True))
                    order = np.lexsort((other, d, row))
                    row, other, d = row[order], other[order], d[order]
                    top = np.arange(len(row)) - np.searchsorted(row, row) < k
                    parts.append((asker[i + row[top]], other[top], d[top]))
            if parts:
                found = [np.concatenate(c) for c in zip(*parts, strict=True)]
        return pa.table(found, names=_FOUND.names)
    return fn


def _search(k: int, width: int):
    def fn(left: pa.Table, right: pa.Table) -> pa.Table:
        found = []
        if left.num_rows and right.num_rows:
            asker = left.column("uid").to_numpy()
            found = [(asker[row], other, d) for row, other, d in nearest(matrix(left.column("vec"), width), asker, matrix(right.column("y"), width), right.column("yid").to_numpy(), k)]
        return pa.table([np.concatenate([f[i] for f in found]) if found else np.zeros(0, kind) for i, kind in enumerate((np.int64, np.int64, np.float64))], names=_FOUND.names)
    return fn


def usable(df: DataFrame, id_col: str, vec_col: str, *carry: str) -> DataFrame:
    """Rows with a vector of finite components, with a number of their own (uid), as a written table (uid, id, vec, carried)."""
    finite = lambda v: v.isNotNull() & ~F.isnan(v) & (F.abs(v) < F.lit(float("inf")))
    rows = df.select(F.col(id_col).alias("id"), F.col(vec_col).cast("array<double>").alias("vec"), *carry).where("vec is not null")
    return written(rows.where(F.forall("vec", finite)).select(F.monotonically_increasing_id().alias("uid"), "*"), "near-rows")


def neighbours(rows: DataFrame, k: int, block_rows: int = 2048, most_pivots: int = 1024, group_bytes: int = GROUP_BYTES) -> DataFrame:
    """The k nearest other rows of every row of a written table (uid, vec): (uid, rank, other, distance), Euclidean.

    Fewer than k other rows give all of them.  Of equally far rows any may be taken (the same ones every time).  No row is lost: what a
    block bound excludes lies farther than k rows already found.
    """
    ship_package(rows.sparkSession)
    rows = rows.select("uid", "vec")
    n, width = rows.agg(F.count("*"), F.coalesce(F.max(F.size("vec")), F.lit(0))).first()
    block_rows = max(block_rows, -(-n // MOST_BLOCKS))
    some = rows.orderBy(F.xxhash64("uid")).limit(min(most_pivots, int(np.ceil(np.sqrt(n))) if n else 1)).select("vec").collect()
    pivots = np.zeros((max(1, len(some)), width))
    for i, r in enumerate(some):
        pivots[i, :len(r["vec"])] = r["vec"]
    pivots = np.unique(pivots, axis=0)
    placed = place(rows, pivots, block_rows)
    own = written(placed.groupBy("block").applyInArrow(_within(k, width), _FOUND), "near-own")
    blocks = grouped(placed, width, group_bytes)
    radius = own.groupBy("uid").agg(F.when(F.count("*") >= k, F.sqrt(F.max("d2")) * (1 + 1e-12)).alias("radius"))
    asking = written(placed.join(radius, "uid", "left").select("uid", "vec", "cell", "block", F.coalesce("radius", F.lit(float("inf"))).alias("radius")), "near-asking")
    sides = T.StructType([T.StructField("home", T.IntegerType()), T.StructField("away", T.IntegerType())])
    pairs = written(asking.mapInArrow(_pairs(pivots, blocks), sides).distinct(), "near-pairs")
    left = asking.mapInArrow(_send(pivots, blocks), T.StructType([*sides.fields, *asking.schema.fields]))
    numbers = placed.sparkSession.createDataFrame([(int(b), int(g)) for b, g in zip(blocks.block, blocks.group, strict=True)], "yblock long, yaway int")
    right = placed.select(F.col("block").alias("yblock"), F.col("uid").alias("yid"), F.col("vec").alias("y")).join(F.broadcast(numbers), "yblock") \
        .join(F.broadcast(pairs.toDF("yhome", "yaway")), "yaway")  # (rows / group)^2 pairs at most
    found = left.groupBy("home", "away").cogroup(right.groupBy("yhome", "yaway")).applyInArrow(_meet(k, pivots, blocks), _FOUND)
    order = Window.partitionBy("uid").orderBy("d2", "other")
    best = own.unionByName(found).withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)
    return best.select("uid", "rank", "other", F.sqrt("d2").alias("distance"))


# ---------------------------------------------------------------- search with cells (G6, approximate and exact)

def refined(sample: np.ndarray, cells: int, rounds: int = 10) -> np.ndarray:
    """Cell centres: Lloyd rounds over a bounded sample, from its first rows; empty cells stay where they are."""
    centres = np.unique(sample[:cells], axis=0)
    for _ in range(rounds):
        at = squares(sample, centres)[0].argmin(axis=1)
        n = np.bincount(at, minlength=len(centres))
        sums = np.zeros_like(centres)
        np.add.at(sums, at, sample)
        centres = np.where(n[:, None] > 0, sums / np.maximum(n, 1)[:, None], centres)
    return np.unique(centres, axis=0)


def _probe(centres: np.ndarray, block: np.ndarray, of: np.ndarray, probes: int, pairs: int = 1 << 14):
    """(block, uid, vec) for all blocks of the ``probes`` nearest cells, ``pairs`` rows at a time."""
    def fn(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        step = max(1, (1 << 21) // max(1, len(block), len(centres)))
        for b in batches:
            x = matrix(_column(b, "vec"), centres.shape[1])
            for i in range(0, b.num_rows, step):
                near = np.argsort(squares(x[i:i + step], centres)[0], axis=1, kind="stable")[:, :probes]
                wanted = np.zeros((len(near), len(centres)), bool)
                np.put_along_axis(wanted, near, True, axis=1)
                row, at = np.nonzero(wanted[:, of])
                for a in range(0, len(row), pairs):
                    part = b.select(["uid", "vec"]).take(pa.array(i + row[a:a + pairs]))
                    yield pa.RecordBatch.from_arrays([pa.array(block[at[a:a + pairs]]), *part.columns], names=["block", "uid", "vec"])
    return fn


@dataclass
class Cells:
    """Rows in cells and blocks: ``placed`` (uid, id, vec, cell, dist, block), the centres, and each block's cell, inner and outer distance."""
    placed: DataFrame
    centres: np.ndarray
    block: np.ndarray
    of: np.ndarray
    inner: np.ndarray
    outer: np.ndarray


def index(rows: DataFrame, cells: int = 256, sample: int = 20_000, block_rows: int = 2048) -> Cells:
    """Cells fitted on at most ``sample`` rows (chosen by hash); every row of the written table (uid, id, vec) is assigned."""
    ship_package(rows.sparkSession)
    rows = rows.select("uid", "id", "vec")
    n, width = rows.agg(F.count("*"), F.coalesce(F.max(F.size("vec")), F.lit(0))).first()
    some = rows.orderBy(F.xxhash64("uid")).limit(sample).select("vec").collect()
    x = np.zeros((max(1, len(some)), width))
    for i, r in enumerate(some):
        x[i, :len(r["vec"])] = r["vec"]
    centres = refined(x, min(cells, max(1, int(np.ceil(np.sqrt(n))))))
    placed = place(rows, centres, max(block_rows, -(-n // MOST_BLOCKS)))
    stats = placed.groupBy("block").agg(F.first("cell").alias("cell"), F.min("dist").alias("lo"), F.max("dist").alias("hi")).orderBy("block").toArrow()
    return Cells(placed, centres, *(stats.column(c).to_numpy() for c in ("block", "cell", "lo", "hi")))


def _found(asks: DataFrame, cells: Cells, k: int) -> DataFrame:
    parts = asks.groupBy("block").agg(F.ceil(F.count("*") / ASKERS).cast("int").alias("parts"))
    left = asks.join(parts, "block").withColumn("part", F.pmod(F.xxhash64("uid"), F.col("parts")).cast("int")).drop("parts")
    right = cells.placed.join(parts, "block").select(F.col("block").alias("yblock"), F.explode(F.sequence(F.lit(0), F.col("parts") - 1)).alias("ypart"),
                                                    F.col("uid").alias("yid"), F.col("vec").alias("y"))
    return left.groupBy("block", "part").cogroup(right.groupBy("yblock", "ypart")).applyInArrow(_search(k, cells.centres.shape[1]), _FOUND)


def search(cells: Cells, queries: DataFrame, k: int, probes: int | float, exact: bool = False) -> DataFrame:
    """The k nearest rows of every query of a written table (uid, id, vec): (query_id, rank, id, distance).

    The blocks of the ``probes`` nearest cells (a fraction: that share of all cells) are searched; that is the approximate answer.  ``exact`` then searches every block
    that the triangle inequality does not rule out under the k-th distance found.  A query's own uid plays no part: a row that is
    also a query finds itself.
    """
    probes = max(1, int(np.ceil(probes * len(cells.centres)))) if isinstance(probes, float) else probes
    q = queries.select((-1 - F.col("uid")).alias("uid"), F.col("id").alias("query_id"), "vec")
    asked = q.select("uid", "vec").mapInArrow(_assign(cells.centres), T.StructType([T.StructField("uid", T.LongType()), queries.schema["vec"],
                                                                                   T.StructField("cell", T.IntegerType()), T.StructField("dist", T.DoubleType())]))
    schema = T.StructType([T.StructField("block", T.LongType()), T.StructField("uid", T.LongType()), queries.schema["vec"]])
    asks = written(asked.select("uid", "vec").mapInArrow(_probe(cells.centres, cells.block, cells.of, probes), schema), "probe-asks")
    found = written(_found(asks, cells, k), "probe-found")
    if exact:
        order = Window.partitionBy("uid").orderBy("d2", "other")
        best = found.withColumn("r", F.row_number().over(order)).where(F.col("r") <= k)
        radius = best.groupBy("uid").agg(F.when(F.count("*") >= k, F.sqrt(F.max("d2")) * (1 + 1e-12)).alias("radius"))
        rows = asked.join(radius, "uid", "left").select("uid", "vec", "cell", F.lit(-1).cast("long").alias("block"), F.coalesce("radius", F.lit(float("inf"))).alias("radius"))
        more = rows.mapInArrow(_route(cells.centres, cells.block, cells.of, cells.inner, cells.outer), schema)
        more = written(more.join(asks.select("uid", "block"), ["uid", "block"], "left_anti").select(*schema.names), "exact-asks")
        found = found.unionByName(_found(more, cells, k))
    order = Window.partitionBy("uid").orderBy("d2", "other")
    best = found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)
    ids = cells.placed.select(F.col("uid").alias("other"), "id")
    return best.join(q.select("uid", "query_id"), "uid").join(ids, "other").select("query_id", "rank", "id", F.sqrt("d2").alias("distance"))


def recall(approximate: DataFrame, truth: DataFrame) -> DataFrame:
    """One row: queries, and the share of the true neighbours (``truth``) that were found."""
    hit = truth.select("query_id", "id").join(approximate.select("query_id", "id", F.lit(1).alias("hit")), ["query_id", "id"], "left")
    return hit.agg(F.count_distinct("query_id").alias("queries"), F.round(F.coalesce(F.avg(F.coalesce("hit", F.lit(0))), F.lit(1.0)), 6).alias("recall"))
