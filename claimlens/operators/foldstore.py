"""Nested cross-validation over stored features.

A calibrated model that is chosen by a grid and judged out of fold needs, for every fold, models that have not seen it, and
for every pair of folds, models that have seen neither.  Each of these *sets* leaves out some folds and learns everything
from the other rows: vocabulary, inverse document frequencies, singular directions, categories, medians, means.  The store
fits all sets together:

* document frequencies are counted once per (term, fold); those of a set are sums over its folds;
* the truncated SVD sums A^T A of *all* sets in one pass (a few rows dense at a time) and decomposes it in a task a set; sets
  wider than ``GRAM_WIDTH`` take a block Krylov iteration, one Spark job a pass for all sets, and the driver holds features x (k + 10)
  numbers a set;
* the logistic regressions of all sets and all grid points advance together: one Spark job an iteration sums gradients and
  Hessians (proximal Newton steps, with coordinate descent for l1), so a grid costs about ten passes, however many points it has.

The model that leaves out folds f and g serves twice: it calibrates on g for the scores of f, and on f for those of g.
Matrices of bounded size (vocabulary limit, feature width, grid) are the only things that reach the driver.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator, Sequence
from dataclasses import dataclass
from itertools import combinations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from claimlens.functions.stats import prefix_sums
from claimlens.operators.retrieval import BUCKETS, HELD, TfidfParams, _counted, _hashed_grams, _marked_grams, _words, split_texts
from claimlens.session import discard, ship_package, small_batches, written

#: Fold of the rows that no set may learn from.
TEST = -1
#: Singular directions carried beyond the wanted ones.
SPARE = 10
CHUNK = 1 << 14
#: Bytes of a block of matrix rows on its way to the sum.
BLOCK = 1 << 18
#: Columns up to which a set's A^T A is summed whole (32 MB); wider sets are iterated.
GRAM_WIDTH = 2048
#: Rows of a set that are dense at a time in the sum of A^T A.
DENSE = 256
#: Sets whose features are written and learned from at a time.
AT_ONCE = 8
#: Steps (relative to the coefficients) under which a regression keeps its Hessian.
KEEP = 1e-2
_SUMS = T.StructType([T.StructField("key", T.IntegerType()), T.StructField("first", T.IntegerType()), T.StructField("rows", T.BinaryType()),
                      T.StructField("values", T.BinaryType())])


@dataclass(frozen=True)
class Point:
    """A point of the grid: inverse strength C and penalty (``l1``, ``l2`` or ``none``)."""
    c: float
    penalty: str


def nested_sets(k: int) -> list[frozenset[int]]:
    """Left-out folds of every set: each fold alone, and each pair; the test rows always."""
    return [frozenset({TEST, *s}) for n in (1, 2) for s in combinations(range(k), n)]


# ---------------------------------------------------------------- sums of matrices

def matrix_sums(df: DataFrame, partial: Callable[[Iterator[pa.RecordBatch]], Iterator[tuple[int, np.ndarray]]], columns: int) -> dict[int, np.ndarray]:
    """Sums matrices over the tasks: ``partial`` yields (key, matrix of up to ``columns`` columns) of a task's rows; matrix rows that are zero
    don't travel, the others go in blocks of at most ``BLOCK`` bytes, and those of one key and place are added up together.  Only the sums
    reach the driver."""
    step = max(1, BLOCK // (8 * max(1, columns)))

    def fn(batches):
        for key, m in partial(batches):
            for a in range(0, len(m), step):
                part = m[a:a + step]
                rows = np.flatnonzero(part.any(axis=1))
                if len(rows):
                    full = np.zeros((len(rows), columns))
                    full[:, :m.shape[1]] = part[rows]
                    yield pa.RecordBatch.from_arrays([pa.array([key], pa.int32()), pa.array([a], pa.int32()), pa.array([(a + rows).astype(np.int32).tobytes()], pa.binary()),
                                                      pa.array([full.tobytes()], pa.binary())], names=_SUMS.names)

    def add(t: pa.Table) -> pa.Table:
        key, a = t.column("key")[0].as_py(), t.column("first")[0].as_py()
        out = np.zeros((step, columns))
        for rows, values in zip(t.column("rows"), t.column("values"), strict=True):
            out[np.frombuffer(rows.as_buffer(), np.int32) - a] += np.frombuffer(values.as_buffer()).reshape(-1, columns)
        rows = np.flatnonzero(out.any(axis=1))
        return pa.table([pa.array([key], pa.int32()), pa.array([a], pa.int32()), pa.array([(a + rows).astype(np.int32).tobytes()], pa.binary()),
                         pa.array([out[rows].tobytes()], pa.binary())], names=_SUMS.names)

    sums = df.mapInArrow(fn, _SUMS).groupBy("key", "first").applyInArrow(add, _SUMS).toArrow()
    found: dict[int, list] = {}
    for key, rows, values in zip(sums.column("key").to_pylist(), sums.column("rows"), sums.column("values"), strict=True):
        found.setdefault(key, []).append((np.frombuffer(rows.as_buffer(), np.int32), np.frombuffer(values.as_buffer()).reshape(-1, columns)))
    out = {}
    for key, parts in found.items():
        out[key] = np.zeros((max((int(rows.max()) + 1 for rows, _ in parts if len(rows)), default=0), columns))
        for rows, values in parts:
            out[key][rows] = values
    return out


def padded(m: np.ndarray | None, rows: int, columns: int) -> np.ndarray:
    out = np.zeros((rows, columns))
    if m is not None:
        out[:len(m)] = m[:, :columns]
    return out


# ---------------------------------------------------------------- truncated SVD

class Sparse:
    """Rows of an Arrow batch in compressed form: ``starts`` into ``index`` and ``value``."""

    def __init__(self, index: pa.ListArray, value: pa.ListArray):
        self.index = index.flatten().to_numpy(zero_copy_only=False)
        self.value = value.flatten().to_numpy(zero_copy_only=False)
        offsets = index.offsets.to_numpy()
        self.starts = offsets - offsets[0]

    def chunks(self) -> Iterator[tuple[int, int, np.ndarray, np.ndarray, np.ndarray]]:
        """(first row, end row, row of each entry, index, value), about ``CHUNK`` entries at a time."""
        i, n = 0, len(self.starts) - 1
        while i < n:
            j = max(i + 1, int(np.searchsorted(self.starts, self.starts[i] + CHUNK, "right")) - 1)
            a, b = self.starts[i], self.starts[j]
            yield i, j, np.repeat(np.arange(j - i), np.diff(self.starts[i:j + 1])), self.index[a:b], self.value[a:b]
            i = j

    def times(self, q: np.ndarray) -> np.ndarray:
        """A Q."""
        out = np.zeros((len(self.starts) - 1, q.shape[1]))
        for i, j, row, index, value in self.chunks():
            if len(row):
                first = np.flatnonzero(np.r_[True, row[1:] != row[:-1]])
                out[i + row[first]] = np.add.reduceat(value[:, None] * q[index], first, axis=0)
        return out

    def gram_times(self, q: np.ndarray, into: np.ndarray) -> None:
        """into += A^T (A Q)."""
        y = self.times(q)
        for i, _, row, index, value in self.chunks():
            if len(row):
                by = np.argsort(index, kind="stable")
                first = np.flatnonzero(np.r_[True, index[by][1:] != index[by][:-1]])
                into[index[by][first]] += np.add.reduceat(value[by, None] * y[i + row[by]], first, axis=0)


def _column(b: pa.RecordBatch, name: str) -> pa.Array:
    return b.column(b.schema.get_field_index(name))


def block_svd(rows: DataFrame, widths: dict[int, int], k: int, seed: int = 42, tolerance: float = 1e-7, passes: int = 60) -> dict[int, tuple[np.ndarray, np.ndarray]]:
    """The ``k`` largest singular values and right directions (columns) of the rows of every set.

    ``rows`` is a written table (set, index, value) of sparse rows; ``widths`` gives the columns of each set.  Block Krylov iteration
    with full reorthogonalisation: a pass multiplies the newest block of each unfinished set with A^T A, Rayleigh-Ritz over
    all blocks gives the directions, and a set is finished once the residuals fall under ``tolerance`` of its
    largest eigenvalue or its blocks span everything.  Directions of singular value zero are left out; the
    largest entry of a direction is positive.
    """
    rng = np.random.default_rng(seed)
    blocks, images, out = {}, {}, {}
    wide = min(k + SPARE, max(widths.values(), default=0))
    for s, w in widths.items():
        q = np.linalg.qr(rng.standard_normal((w, min(wide, w))))[0] if w else np.zeros((0, 0))
        blocks[s], images[s] = [q], []
        if not w:
            out[s] = (np.zeros(0), np.zeros((0, 0)))
    for turn in range(passes):
        newest = {s: b[-1] for s, b in blocks.items() if s not in out}
        if not newest:
            break

        def partial(batches, newest=newest):
            sums = {}
            for b in batches:
                of = _column(b, "set").to_numpy()
                for s in np.unique(of).tolist():
                    if s in newest:
                        part = b.filter(pa.array(of == s))
                        sums.setdefault(s, np.zeros(newest[s].shape))
                        Sparse(_column(part, "index"), _column(part, "value")).gram_times(newest[s], sums[s])
            yield from sums.items()

        found = matrix_sums(rows.filter(F.col("set").isin(list(newest))).select("set", "index", "value"), partial, wide)
        for s, q in newest.items():
            images[s].append(padded(found.get(s), *q.shape))
            basis, image = np.hstack(blocks[s]), np.hstack(images[s])
            small = basis.T @ image
            values, u = np.linalg.eigh((small + small.T) / 2)
            order = np.argsort(-values)[:k]
            values, u = values[order], u[:, order]
            residual = np.linalg.norm(image @ u - basis @ u * values, axis=0).max(initial=0)
            fresh = images[s][-1] - basis @ (basis.T @ images[s][-1])
            fresh -= basis @ (basis.T @ fresh)
            left, scale, _ = np.linalg.svd(fresh, full_matrices=False)
            fresh = left[:, scale > 1e-12 * max(values.max(initial=0), 1e-300)][:, :widths[s] - basis.shape[1]]
            if residual <= tolerance * values.max(initial=0) or not fresh.shape[1] or turn == passes - 1:
                held = values > 1e-10 * values.max(initial=0)
                v = basis @ u[:, held]
                out[s] = (np.sqrt(values[held]), _signed(v))
            else:
                blocks[s].append(fresh)
    return out


def _signed(v: np.ndarray) -> np.ndarray:
    """Directions (columns) whose largest entry is positive."""
    return v * np.where(v[np.abs(v).argmax(axis=0), np.arange(v.shape[1])] < 0, -1.0, 1.0) if v.size else v


def _grams(widths: dict[int, int], step: int):
    """Upper triangle of A^T A of the rows of each set in a task, in blocks of ``step`` matrix rows.  One matrix is held at a time as long as
    the rows come set by set."""
    def send(s: int, gram: np.ndarray) -> Iterator[pa.RecordBatch]:
        for a in range(0, len(gram), step):
            yield pa.RecordBatch.from_arrays([pa.array([s], pa.int32()), pa.array([a], pa.int32()), pa.array([b""], pa.binary()),
                                              pa.array([gram[a:a + step, a:].tobytes()], pa.binary())], names=_SUMS.names)

    def fn(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, gram = None, None
        for b in batches:
            of = _column(b, "set").to_numpy()
            for s in np.unique(of).tolist():
                if s != now:
                    if gram is not None:
                        yield from send(now, gram)
                    now, gram = s, np.zeros((widths[s], widths[s]))
                part = b.filter(pa.array(of == s))
                sparse = Sparse(_column(part, "index"), _column(part, "value"))
                for i in range(0, part.num_rows, DENSE):
                    at = sparse.starts[i:i + DENSE + 1]
                    x = np.zeros((len(at) - 1, widths[s]))
                    x[np.repeat(np.arange(len(at) - 1), np.diff(at)), sparse.index[at[0]:at[-1]]] = sparse.value[at[0]:at[-1]]
                    gram += x.T @ x
        if gram is not None:
            yield from send(now, gram)
    return fn


def gram_svd(rows: DataFrame, widths: dict[int, int], k: int) -> dict[int, tuple[np.ndarray, np.ndarray]]:
    """The same directions as ``block_svd`` in one pass, for sets of bounded width: the tasks sum A^T A of their rows, its blocks are added
    up, and a task a set decomposes the sum.  The driver receives the k directions of each set."""
    widths = {s: w for s, w in widths.items() if w}
    step = max(1, BLOCK // (8 * max(widths.values(), default=1)))

    def add(t: pa.Table) -> pa.Table:
        s, a = t.column("key")[0].as_py(), t.column("first")[0].as_py()
        out = np.zeros(len(t.column("values")[0].as_buffer()) // 8)
        for values in t.column("values"):
            out += np.frombuffer(values.as_buffer())
        return pa.table([pa.array([s], pa.int32()), pa.array([a], pa.int32()), pa.array([b""], pa.binary()), pa.array([out.tobytes()], pa.binary())], names=_SUMS.names)

    def decompose(t: pa.Table) -> pa.Table:
        s = t.column("key")[0].as_py()
        w = widths[s]
        gram = np.zeros((w, w))
        for a, values in zip(t.column("first").to_pylist(), t.column("values"), strict=True):
            gram[a:a + step, a:] = np.frombuffer(values.as_buffer()).reshape(-1, w - a)
        values, v = np.linalg.eigh(gram, UPLO="U")
        order = np.argsort(-values)[:k]
        order = order[values[order] > 1e-10 * values.max(initial=0)]
        return pa.table([pa.array([s], pa.int32()), pa.array([len(order)], pa.int32()), pa.array([np.sqrt(values[order]).tobytes()], pa.binary()),
                         pa.array([_signed(v[:, order]).tobytes()], pa.binary())], names=_SUMS.names)

    summed = rows.select("set", "index", "value").mapInArrow(_grams(widths, step), _SUMS).groupBy("key", "first").applyInArrow(add, _SUMS)
    out = {}
    for s, n, sigma, v in summed.groupBy("key").applyInArrow(decompose, _SUMS).collect():
        out[s] = np.frombuffer(sigma).copy(), np.frombuffer(v).reshape(widths[s], n).copy()
    return out


def directions_of(rows: DataFrame, widths: dict[int, int], k: int) -> dict[int, tuple[np.ndarray, np.ndarray]]:
    """Singular values and directions of every set: in one pass where A^T A of a set is of bounded size, else iterated."""
    if max(widths.values(), default=0) > GRAM_WIDTH:
        return block_svd(rows, widths, k)
    found = gram_svd(rows, widths, k)
    return {s: found.get(s, (np.zeros(0), np.zeros((w, 0)))) for s, w in widths.items()}


# ---------------------------------------------------------------- the store

@dataclass
class Store:
    """Features of every set: ``table`` (set, id, fold, label, x), learned from the rows whose fold is not in ``sets[set]``.  ``part`` gives those of some
    sets, and ``rows`` (set, label) the rows that the sets learn from, without features."""
    table: DataFrame
    sets: list[frozenset[int]]
    width: int
    singular: dict[int, np.ndarray]
    part: Callable[[Sequence[int]], DataFrame]
    rows: DataFrame


def learning(sets: Sequence[frozenset[int]]):
    """Rows (set, fold) that a set learns from."""
    left = F.array(*[F.array(*[F.lit(f) for f in sorted(s)]).cast("array<int>") for s in sets])
    return ~F.array_contains(F.element_at(left, F.col("set") + 1), F.col("fold"))


def _sharing(lists: pa.ListArray, folds: list[int]) -> list[np.ndarray]:
    """For every fold, how many of its rows share the texts of each id."""
    fold, of = lists.flatten().field("fold"), pc.list_parent_indices(lists).to_numpy(zero_copy_only=False)
    return [np.bincount(of[pc.fill_null(pc.equal(fold, f), False).to_numpy(zero_copy_only=False)], minlength=len(lists)) for f in folds]


def _loads(folds: list[int], p: TfidfParams):
    """Occurrences of the n-grams of several words in each bucket, over the rows of ``folds``."""
    def partial(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[int, np.ndarray]]:
        out = np.zeros(BUCKETS)
        for b in batches:
            names, code, of, row = _words(_column(b, "_toks"), p)
            weight = sum(_sharing(_column(b, "rows"), folds), np.zeros(b.num_rows))
            for n in range(2, p.ngram[1] + 1):
                at, bucket = _hashed_grams(names, code, of, n)
                out += np.bincount(bucket, weight[row[of[at]]], minlength=BUCKETS)
        yield 0, out.reshape(-1, 64)
    return partial


def _fold_sums(folds: list[int], p: TfidfParams, marks: np.ndarray):
    """(term, df and total of every fold) of the texts of a task, added up before they leave it; of several words, the terms in marked buckets."""
    names = [f"{kind}{i}" for i in range(len(folds)) for kind in ("df", "total")]

    def added(parts: list[pa.Table]) -> pa.Table:
        t = pa.concat_tables(parts).group_by("term", use_threads=False).aggregate([(n, "sum") for n in names])
        return t.select(["term", *[f"{n}_sum" for n in names]]).rename_columns(["term", *names])

    def fn(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        parts, held = [], 0
        for b in batches:
            sharing = _sharing(_column(b, "rows"), folds)
            for row, gram, strings in _marked_grams(_column(b, "_toks"), p, marks):
                row, gram, count = _counted(row, gram, len(strings))
                sums = {}
                for i, n in enumerate(sharing):
                    sums[f"df{i}"] = np.bincount(gram, n[row], minlength=len(strings)).astype(np.int64)
                    sums[f"total{i}"] = np.bincount(gram, n[row] * count, minlength=len(strings)).astype(np.int64)
                at = np.flatnonzero(sum(sums[f"df{i}"] for i in range(len(folds))))
                parts.append(pa.table({"term": strings.take(pa.array(at)), **{n: pa.array(sums[n][at]) for n in names}}))
                held += len(at)
            if held > HELD:
                parts = [added(parts)]
                held = parts[0].num_rows
                if held > HELD // 2:
                    yield from parts[0].combine_chunks().to_batches(max_chunksize=10_000)
                    parts, held = [], 0
        if parts:
            yield from added(parts).combine_chunks().to_batches(max_chunksize=10_000)
    return fn, "term string, " + ", ".join(f"{n} long" for n in names)


def _vectorise(vocabulary: list[str], params: TfidfParams):
    """Every row with the terms of the vocabulary (their place in it and count) that its id's texts have."""
    known, marks = pa.array(vocabulary, pa.string()), np.zeros(BUCKETS, bool)
    for term in vocabulary:
        words = term.split(" ")
        marks[_hashed_grams(pa.array(words, pa.string()), np.arange(len(words)), np.zeros(len(words), np.int64), len(words))[1]] = True

    def fn(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            rows, terms = [np.zeros(0, np.int64)], [np.zeros(0, np.int64)]
            for row, gram, strings in _marked_grams(_column(b, "_toks"), params, marks):
                u = pc.fill_null(pc.index_in(strings.cast(known.type), value_set=known), -1).to_numpy(zero_copy_only=False).astype(np.int64)[gram]
                rows.append(row[u >= 0])
                terms.append(u[u >= 0])
            row, u, tf = _counted(np.concatenate(rows), np.concatenate(terms), len(known))
            # every row of an id has the terms of the id's texts
            lists = _column(b, "rows")
            of = pc.list_parent_indices(lists).to_numpy(zero_copy_only=False).astype(np.int64)
            size = np.bincount(row, minlength=b.num_rows)
            first, long = (np.cumsum(size) - size)[of], size[of]
            row = np.repeat(np.arange(len(of)), long)
            entry = np.arange(len(row)) - np.repeat(np.cumsum(long) - long - first, long)
            flat = lists.flatten()
            carried = {"id": _column(b, "id").take(pa.array(of)), **{c: flat.field(c) for c in ("fold", "label", "cats", "nums")}}
            starts = pa.array(np.r_[0, np.cumsum(long)], pa.int32())
            yield pa.RecordBatch.from_arrays([*carried.values(), *(pa.ListArray.from_arrays(starts, pa.array(v[entry], pa.int32())) for v in (u, tf))], names=[*carried, "index", "count"])
    return fn


def _weighted(which: Sequence[int], place: np.ndarray, idf: np.ndarray, sets: Sequence[frozenset[int]], judged: bool):
    """Unit vectors (set, the row, index, value) of the counted rows under the sets ``which``: of the rows a set learns from, and with ``judged`` of those it
    may be asked of."""
    def fn(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            known = _column(batch, "fold").is_valid().to_numpy(zero_copy_only=False)
            fold = pc.fill_null(_column(batch, "fold"), TEST).to_numpy(zero_copy_only=False)
            for s in which:
                held = known & ~np.isin(fold, list(sets[s]))
                if judged:  # test rows are asked of the sets that leave out one fold at most
                    held |= (len(sets[s]) <= 2) | (known & (fold != TEST))
                if not held.any():
                    continue
                b = batch if held.all() else batch.filter(pa.array(held))
                counts, n = Sparse(_column(b, "index"), _column(b, "count")), b.num_rows
                row, u, tf = np.repeat(np.arange(n), np.diff(counts.starts)), counts.index, counts.value.astype(float)
                p = place[s, u]
                x, at, p = (tf * idf[s, u])[p >= 0], row[p >= 0], p[p >= 0]
                norm = np.sqrt(np.bincount(at, x * x, minlength=n))
                order = np.lexsort((p, at))
                starts = pa.array(np.r_[0, np.cumsum(np.bincount(at, minlength=n))], pa.int32())
                carried = {c: _column(b, c) for c in ("id", "fold", "label", "cats", "nums")}
                yield pa.RecordBatch.from_arrays([pa.array(np.full(n, s, np.int32)), *carried.values(), pa.ListArray.from_arrays(starts, pa.array(p[order], pa.int32())),
                                                  pa.ListArray.from_arrays(starts, pa.array((x / np.where(norm > 0, norm, 1.0)[at])[order], pa.float64()))],
                                                 names=["set", *carried, "index", "value"])
    return fn


def _most_frequent(sets: Sequence[frozenset[int]], folds: list[int], most: int):
    """(set, term, df, total) of each set's ``most`` terms of largest total (ties by term) among those of a task."""
    inside = np.array([[f not in s for f in folds] for s in sets], np.int64).reshape(len(sets), len(folds))

    def fn(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kept = {}
        for b in batches:
            df, total = (np.stack([_column(b, f"{kind}{i}").to_numpy(zero_copy_only=False) for i in range(len(folds))]) for kind in ("df", "total"))
            for s in range(len(sets)):
                d, t = inside[s] @ df, inside[s] @ total
                at = np.flatnonzero(t >= (kept[s].column("total")[-1].as_py() if s in kept and kept[s].num_rows == most else 1))
                new = pa.table({"set": pa.array(np.full(len(at), s, np.int32)), "term": _column(b, "term").take(pa.array(at)), "df": pa.array(d[at]), "total": pa.array(t[at])})
                new = pa.concat_tables([kept[s], new]) if s in kept else new
                kept[s] = new.take(pc.sort_indices(new, [("total", "descending"), ("term", "ascending")])[:most])
        for t in kept.values():
            yield from t.combine_chunks().to_batches()
    return fn


def build(df: DataFrame, id_col: str, label: str, text: str, categorical: Sequence[str], numeric: Sequence[str], sets: Sequence[frozenset[int]],
          max_features: int = 2000, ngrams: int = 2, k: int = 100) -> Store:
    """Features of every set for every row that may be asked of it.

    ``df`` has an integer ``fold`` (``TEST`` for rows that nothing learns from) and unique ids.  Texts become smoothed TF-IDF
    weights of unit length over the ``max_features`` terms most frequent in the learning rows (ties by term), projected on ``k``
    singular directions; categories become indicators (unseen ones all zero); numbers are filled with the learning rows' median and scaled
    by mean and population deviation (constants become 0).  Null text is empty, null categories are a category.
    """
    spark, sets = df.sparkSession, list(sets)
    ship_package(spark)
    cats = [F.coalesce(F.col(c).cast("string"), F.lit("unknown")) for c in categorical]
    small_batches(spark)
    p = TfidfParams(max_features, (1, ngrams))
    base = df.select(F.col(id_col).alias("id"), F.col(text).alias("text"), F.struct(
        F.col("fold").cast("int").alias("fold"), F.col(label).cast("double").alias("label"), F.array(*cats).cast("array<string>").alias("cats"),
        F.array(*[F.col(c).cast("double") for c in numeric]).cast("array<double>").alias("nums")).alias("row"))
    # the texts of an id are split once and written as tokens; terms are counted inside the row, so no row per term of a text is made
    texts = base.groupBy("id").agg(F.collect_list(F.when(F.col("id").isNotNull(), F.coalesce(F.col("text"), F.lit("")))).alias("_texts"), F.collect_list("row").alias("rows"))
    ids = written(texts.select("id", "rows", split_texts("_texts").alias("_toks")), "fold-tokens")
    docs = ids.select("id", F.explode("rows").alias("r")).select("id", "r.*")
    here = F.explode(F.array(*[F.lit(i) for i in range(len(sets))])).alias("set")

    # tasks send one row per term with its counts of every fold; a set adds up the folds it learns from, and a task keeps a set's most frequent terms
    folds = sorted(r[0] for r in docs.select("fold").distinct().collect() if r[0] is not None) or [0]

    def counted(grams: tuple[int, int], marks: np.ndarray) -> DataFrame:
        sums, kinds = _fold_sums(folds, TfidfParams(max_features, grams), marks)
        return ids.select("rows", "_toks").mapInArrow(sums, kinds).groupBy("term").agg(*[F.sum(f"{kind}{i}").alias(f"{kind}{i}") for kind in ("df", "total") for i in range(len(folds))])

    def most_frequent(by_term: DataFrame) -> DataFrame:
        of_set = by_term.mapInArrow(_most_frequent(sets, folds, max_features), "set int, term string, df long, total long")
        return of_set.withColumn("place", F.row_number().over(Window.partitionBy("set").orderBy(F.desc("total"), "term")) - 1).filter(F.col("place") < max_features)

    by_term = counted((1, 1), np.zeros(0, bool))
    if ngrams > 1:
        # a term of several words can only be chosen if it occurs as often as a set's last word of ``max_features``; terms are spread over
        # buckets, and those of a bucket whose terms all together occur less often are not counted
        by_term = by_words = written(by_term, "fold-words")
        last = {r["set"]: r["total"] for r in most_frequent(by_term).filter(F.col("place") == max_features - 1).collect()}
        loads = matrix_sums(ids.select("rows", "_toks"), _loads([f for f in folds if any(f not in s for s in sets)], p), 64).get(0)
        marks = padded(loads, BUCKETS // 64, 64).ravel() >= max(1, min(last.get(s, 1) for s in range(len(sets))))
        by_term = by_term.unionByName(counted((2, ngrams), marks))
    top = most_frequent(by_term)
    vocab = top.select("set", "term", "df", "place").collect()  # at most sets x max_features rows
    words = sorted({r["term"] for r in vocab})
    vocabulary = {t: i for i, t in enumerate(words)}
    # a row is written once with its counts; its vectors under the sets are made where they are read, and what the counts came from is not needed any more
    schema = T.StructType([*docs.schema.fields, T.StructField("index", T.ArrayType(T.IntegerType())), T.StructField("count", T.ArrayType(T.IntegerType()))])
    cores = spark.sparkContext.defaultParallelism
    counts = written(ids.mapInArrow(_vectorise(words, p), schema).repartition(2 * cores), "fold-counts")  # far smaller than what is made of them later
    for done in (ids, *([by_words] if ngrams > 1 else [])):
        discard(done)
    rows = counts.select("fold", "label", "cats", "nums", here).filter(learning(sets))
    sizes = dict(rows.groupBy("set").count().collect())
    place, idf = np.full((len(sets), len(vocabulary)), -1, np.int32), np.zeros((len(sets), len(vocabulary)))
    for s, term, n, at in vocab:
        place[s, vocabulary[term]] = at
        idf[s, vocabulary[term]] = np.log((1 + sizes[s]) / (1 + n)) + 1
    kinds = T.StructType([T.StructField("set", T.IntegerType()), *docs.schema.fields,
                          T.StructField("index", T.ArrayType(T.IntegerType())), T.StructField("value", T.ArrayType(T.DoubleType()))])
    # a set is read in a few tasks of its own, each of which sends one sum, however many rows there are; a union of single partitions would be one task
    tasks = max(2, -(-2 * cores // len(sets)))
    sparse = None
    for s in range(len(sets)):
        one = (counts.coalesce(tasks) if len(sets) > 1 else counts).mapInArrow(_weighted([s], place, idf, sets, False), kinds).select("set", "index", "value")
        sparse = one if sparse is None else sparse.unionAll(one)
    svd = directions_of(sparse, {s: int((place[s] >= 0).sum()) for s in range(len(sets))}, k)

    seen = {(s, c): [] for s in range(len(sets)) for c in range(len(categorical))}
    for s, c, v in sorted(rows.select("set", F.posexplode("cats")).distinct().collect()):  # the categories' domains
        seen[s, c].append(v)
    number = rows.select("set", F.posexplode("nums").alias("c", "x")).filter("x is not null and not isnan(x)")
    medians = number.groupBy("set", "c").agg(F.percentile_approx("x", 0.5, 1_000_000).alias("median"))
    filled = rows.select("set", F.posexplode("nums").alias("c", "x")).join(F.broadcast(medians), ["set", "c"], "left") \
        .withColumn("x", F.coalesce(F.nanvl("x", F.lit(None).cast("double")), "median", F.lit(0.0)))
    scale = {(r["set"], r["c"]): (r["m"], r["mean"], r["sd"]) for r in filled.groupBy("set", "c").agg(
        F.first("median").alias("m"), F.avg("x").alias("mean"), F.stddev_pop("x").alias("sd")).collect()}
    width = max((svd[s][1].shape[1] + sum(len(seen[s, c]) for c in range(len(categorical))) for s in range(len(sets))), default=0) + len(numeric)
    directions = {s: v for s, (_, v) in svd.items()}

    def project(weighted: Callable, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in weighted(batches):
            x = np.zeros((b.num_rows, width))
            of = _column(b, "set").to_numpy()
            for s in np.unique(of).tolist():
                at = np.flatnonzero(of == s)
                part = b.take(pa.array(at))
                v = directions[s]
                x[at, :v.shape[1]] = Sparse(_column(part, "index"), _column(part, "value")).times(v) if v.size else 0.0
                first = v.shape[1]
                words = _column(part, "cats").flatten()
                for c in range(len(categorical)):
                    found = pc.index_in(words.take(pa.array(np.arange(c, len(words), len(categorical)))), value_set=pa.array(seen[s, c], pa.string()))
                    hit = np.flatnonzero(found.is_valid().to_numpy(zero_copy_only=False))
                    x[at[hit], first + found.drop_null().to_numpy(zero_copy_only=False)] = 1.0
                    first += len(seen[s, c])
                numbers = _column(part, "nums").flatten().to_numpy(zero_copy_only=False).astype(float).reshape(part.num_rows, -1) if numeric else None
                for c in range(len(numeric)):
                    median, mean, sd = scale.get((s, c), (None, 0.0, 0.0))
                    raw = np.where(np.isnan(numbers[:, c]), median or 0.0, numbers[:, c])
                    x[at, width - len(numeric) + c] = (raw - mean) / sd if sd else 0.0
            flat = pa.ListArray.from_arrays(pa.array(np.arange(b.num_rows + 1) * width, pa.int32()), pa.array(x.ravel()))
            yield pa.RecordBatch.from_arrays([*(_column(b, n) for n in ("set", "id", "fold", "label")), flat], names=["set", "id", "fold", "label", "x"])

    out = T.StructType([*(f for f in kinds.fields if f.name in ("set", "id", "fold", "label")), T.StructField("x", T.ArrayType(T.DoubleType()))])

    def part(which: Sequence[int]) -> DataFrame:
        weighted = _weighted(list(which), place, idf, sets, True)
        return counts.mapInArrow(lambda batches: project(weighted, batches), out)

    table = part(range(len(sets)))
    return Store(written(table, "fold-store") if len(sets) == 1 else table, sets, width, {s: sigma for s, (sigma, _) in svd.items()}, part, rows.select("set", "label"))


# ---------------------------------------------------------------- all regressions at once

def _sigmoid(m: np.ndarray) -> np.ndarray:
    return 0.5 * (1 + np.tanh(0.5 * m))


def _rows_of(batch: pa.RecordBatch, width: int) -> np.ndarray:
    x = _column(batch, "x").flatten().to_numpy(zero_copy_only=False).reshape(batch.num_rows, width)
    return np.hstack([x, np.ones((len(x), 1))])


def _descend(g: np.ndarray, h: np.ndarray, w: np.ndarray, l1: np.ndarray, sweeps: int = 200) -> np.ndarray:
    """Minimises g d + d H d / 2 + sum l1 |w + d| by coordinate descent, for many models at once."""
    out, left = np.zeros_like(w), np.arange(len(w))
    d, hd = np.zeros_like(w), np.zeros_like(w)
    a = np.maximum(np.diagonal(h, axis1=1, axis2=2), 1e-12)
    for _ in range(sweeps):
        most, root = np.zeros(len(w)), np.sqrt(a)
        for j in range(w.shape[1]):
            z = w[:, j] + d[:, j] - (g[:, j] + hd[:, j]) / a[:, j]
            step = np.sign(z) * np.maximum(np.abs(z) - l1[:, j] / a[:, j], 0) - w[:, j] - d[:, j]
            moved = np.flatnonzero(step)
            if len(moved):
                hd[moved] += h[moved, j] * step[moved, None]
                d[:, j] += step
                most = np.maximum(most, np.abs(step) * root[:, j])
        out[left] = d
        on = np.flatnonzero(most >= 1e-10)
        if not len(on):
            break
        if len(on) < len(left):  # finished models leave
            left, g, h, w, l1, d, hd, a = (m[on] for m in (left, g, h, w, l1, d, hd, a))
    return out


def fit_logistic(rows: DataFrame, weights: dict[tuple[int, float], float], points: dict[int, list[Point]], width: int, iterations: int = 40,
                 tolerance: float = 1e-9) -> dict[tuple[int, int], np.ndarray]:
    """Coefficients (the intercept last) of every set and grid point: minimises the weighted log loss plus the
    penalty / C, the intercept free.

    ``rows`` is a written table (set, label, x, and t, the target between 0 and 1); ``weights`` holds a weight for each (set, label).  Each iteration is one
    pass for all models; a model whose loss rose goes half its step back.  All points of a set start from zero with one Hessian; a model whose
    steps are short keeps its Hessian as long as they shrink tenfold, and asks for the exact gradient only.
    """
    models = [(s, i) for s, ps in points.items() for i in range(len(ps))]
    of = {m: n for n, m in enumerate(models)}
    d = width + 1
    w, old, step = np.zeros((len(models), d)), np.zeros((len(models), d)), np.zeros((len(models), d))
    best = np.full(len(models), np.inf)
    kind = [points[s][i] for s, i in models]
    l1 = np.array([[(1 / p.c if p.penalty == "l1" else 0.0)] * width + [0.0] for p in kind]).reshape(len(models), d)
    l2 = np.array([[(1 / p.c if p.penalty == "l2" else 0.0)] * width + [0.0] for p in kind]).reshape(len(models), d)
    active, fresh, last = np.ones(len(models), bool), np.ones(len(models), bool), np.full(len(models), np.inf)
    grad, hess = np.zeros((len(models), d)), np.zeros((len(models), d, d))
    for turn in range(iterations):
        ask = {s: [i for i in range(len(ps)) if active[of[s, i]]] for s, ps in points.items()}
        ask = {s: [(of[s, i], w[of[s, i]], bool(fresh[of[s, i]])) for i in (which if turn else which[:1])] for s, which in ask.items() if which}
        if not ask:
            break

        def partial(batches, ask=ask):
            sums = {}
            for b in batches:
                sets = _column(b, "set").to_numpy()
                for s in np.unique(sets).tolist():
                    if s not in ask:
                        continue
                    part = b.filter(pa.array(sets == s))
                    x, t = _rows_of(part, width), _column(part, "t").to_numpy()
                    c = np.array([weights[s, v] for v in _column(part, "label").to_pylist()])
                    for n, coef, full in ask[s]:
                        m = x @ coef
                        p = _sigmoid(m)
                        # rows 0..d-1: Hessian; row d: gradient and loss
                        into = sums.setdefault(n, np.zeros((d + 1, d + 1)))
                        if full:
                            y = x * np.sqrt(c * p * (1 - p))[:, None]
                            into[:d, :d] += y.T @ y
                        into[d, :d] += x.T @ (c * (p - t))
                        into[d, d] += (c * (np.logaddexp(0, m) - t * m)).sum()
            yield from sums.items()

        found = matrix_sums(rows.filter(F.col("set").isin(list(ask))).select("set", "label", "t", "x"), partial, d + 1)
        now = np.flatnonzero(active)
        source = {int(n): int(n) if turn else of[models[n][0], 0] for n in now}
        sums = np.stack([padded(found.get(source[int(n)]), d + 1, d + 1) for n in now])
        loss = sums[:, d, d] + (np.abs(w[now]) * l1[now]).sum(axis=1) + 0.5 * (w[now] ** 2 * l2[now]).sum(axis=1)
        worse = loss > best[now] + 1e-12 * np.abs(best[now])
        back = now[worse]
        step[back] *= 0.5
        w[back] = old[back] + step[back]
        on = now[~worse]
        best[on], old[on] = loss[~worse], w[on]
        grad[on] = sums[~worse][:, d, :d] + w[on] * l2[on]
        new = on[fresh[on]]
        hess[new] = sums[~worse][fresh[on]][:, :d, :d]
        hess[new] += np.eye(d) * (l2[new][:, None, :] + 1e-9)
        step[on] = 0.0
        plain = on[~(l1[on] > 0).any(axis=1)]
        if len(plain):
            step[plain] = -np.linalg.solve(hess[plain], grad[plain][:, :, None])[:, :, 0]
        lasso = on[(l1[on] > 0).any(axis=1)]
        if len(lasso):
            step[lasso] = _descend(grad[lasso], hess[lasso], w[lasso], l1[lasso])
        w[on] = old[on] + step[on]
        size = np.abs(step).max(axis=1) / (1 + np.abs(old).max(axis=1))
        active &= size > tolerance
        fresh = (size >= KEEP) | (size > 0.1 * last)
        fresh[back] = True
        last = size
    return {m: w[n] for m, n in of.items()}


# ---------------------------------------------------------------- grid, calibration, out-of-fold scores

def class_weights(store: Store) -> dict[tuple[int, float], float]:
    """Balanced weights n / (2 n_c) of every set's learning rows."""
    n = {(r["set"], r["label"]): r["count"] for r in store.rows.groupBy("set", "label").count().collect()}
    total = {s: sum(c for (t, _), c in n.items() if t == s) for s, _ in n}
    return {(s, y): total[s] / (2 * c) for (s, y), c in n.items()}


def margins(store: Store, models: dict[tuple[int, int], np.ndarray], table: DataFrame | None = None) -> DataFrame:
    """(set, point, id, fold, label, margin) of the rows (of the store, or of ``table``, a part of it) that a set has not learned from, under every point."""
    table = store.table if table is None else table
    width = store.width
    by_set = {}
    for (s, i), w in models.items():
        by_set.setdefault(s, []).append((i, w))

    def fn(batches):
        for b in batches:
            sets = _column(b, "set").to_numpy()
            for s in np.unique(sets).tolist():
                part = b.filter(pa.array(sets == s))
                x = _rows_of(part, width)
                for i, w in by_set.get(s, []):
                    yield pa.RecordBatch.from_arrays([pa.array(np.full(len(x), s, np.int32)), pa.array(np.full(len(x), i, np.int32)),
                                                      *(_column(part, n) for n in ("id", "fold", "label")), pa.array(x @ w)], names=["set", "point", "id", "fold", "label", "margin"])

    t = {f.name: f.dataType for f in table.schema.fields}
    schema = T.StructType([T.StructField("set", T.IntegerType()), T.StructField("point", T.IntegerType()),
                           *[T.StructField(n, t[n]) for n in ("id", "fold", "label")], T.StructField("margin", T.DoubleType())])
    return written(table.filter(~learning(store.sets)).mapInArrow(fn, schema), "fold-margins")


def grouped_auc(scored: DataFrame, by: Sequence[str], score: str = "margin") -> DataFrame:
    """Exact ROC-AUC of every group in one distributed pass over all of them (ties count one half; null with one class)."""
    cells = scored.groupBy(*by, F.col(score).alias("_s")).agg(F.sum("label").cast("long").alias("pos"), F.sum(1 - F.col("label")).cast("long").alias("neg"))
    cum = prefix_sums(cells.select(F.struct(*by, "_s").alias("_key"), "pos", "neg"), "_key", ["pos", "neg"])
    cum = cum.select(*[F.col("_key")[c].alias(c) for c in by], "pos", "neg", "cum_neg")
    # running counts go over all groups: a group starts at its least one
    start = cum.groupBy(*by).agg(F.min(F.col("cum_neg") - F.col("neg")).alias("_start"))
    below = F.col("cum_neg") - F.col("neg") - F.col("_start")
    return cum.join(start, list(by)).groupBy(*by).agg(
        F.try_divide(F.sum(F.col("pos") * (below + F.col("neg") / 2.0)), F.sum("pos") * F.sum("neg").cast("double")).alias("auc"))


def nested_calibration(store: Store, points: Sequence[Point], k: int = 5) -> dict:
    """The grid, the calibrated out-of-fold scores and the calibrated test scores.

    For every fold f the point is chosen by the mean AUC of the models that have not seen f, each on a fold it has not seen either; each of
    these models gets a sigmoid from that fold and scores f, and f's score is the mean.  The test rows are scored in the same way by the
    models that leave out one fold, under the point best over all folds.  Returns the tables ``oof`` and ``test`` (id, label, calibrated), ``grid``
    (C, penalty, mean_auc) and ``chosen`` (the point of each fold, and of the test rows under ``TEST``).
    """
    spark, points = store.table.sparkSession, list(points)
    number = {s: i for i, s in enumerate(store.sets)}
    weights, scored = class_weights(store), None
    for first in range(0, len(store.sets), AT_ONCE):  # the dense features of a few sets are on disk at a time
        which = range(first, min(first + AT_ONCE, len(store.sets)))
        features = written(store.part(which), "fold-store")
        models = fit_logistic(features.filter(learning(store.sets)).withColumn("t", F.col("label")), weights, {i: points for i in which}, store.width)
        more = margins(store, models, features)
        scored = more if scored is None else scored.unionAll(more)
        discard(features)
    table = {(r["set"], r["point"], r["fold"]): r["auc"] for r in grouped_auc(scored.filter(F.col("fold") != TEST), ["set", "point", "fold"]).collect()}
    value = lambda s, p, g: table.get((number[s], p, g)) or 0.0
    chosen, mean = {}, {}
    for f in (*range(k), TEST):
        inner = [g for g in range(k) if g != f]
        auc = [float(np.mean([value(frozenset({TEST, g, f}), p, g) for g in inner])) for p in range(len(points))]
        mean[f], chosen[f] = auc, int(np.argmax(auc))
    # judge f through the model that leaves out f and g, calibrated on g
    wanted = [(number[frozenset({TEST, f, g})], chosen[f], f, g) for f in (*range(k), TEST) for g in range(k) if g != f]
    wanted = spark.createDataFrame([(i, *w) for i, w in enumerate(wanted)], "pair int, set int, point int, judged int, tuned int")
    used = written(scored.join(F.broadcast(wanted), ["set", "point"]), "fold-pairs")
    fit = used.filter(F.col("fold") == F.col("tuned"))
    counts = fit.groupBy("pair").agg(F.sum("label").alias("pos"), F.sum(1 - F.col("label")).alias("neg"))
    # the usual targets of a sigmoid fit: away from 0 and 1 by the sizes of the classes
    target = F.when(F.col("label") == 1, (F.col("pos") + 1) / (F.col("pos") + 2)).otherwise(1 / (F.col("neg") + 2))
    fit = written(fit.join(F.broadcast(counts), "pair").select(F.col("pair").alias("set"), "label", F.array("margin").alias("x"), target.alias("t")), "fold-sigmoids")
    pairs = [r["pair"] for r in wanted.collect()]
    curves = fit_logistic(fit, {(p, y): 1.0 for p in pairs for y in (0.0, 1.0)}, {p: [Point(1.0, "none")] for p in pairs}, 1)
    slopes = spark.createDataFrame([(p, float(w[0]), float(w[1])) for (p, _), w in curves.items()], "pair int, slope double, shift double")
    ready = used.filter(F.col("fold") == F.col("judged")).join(F.broadcast(slopes), "pair") \
        .withColumn("p", 1 / (1 + F.exp(-(F.col("slope") * F.col("margin") + F.col("shift")))))
    mean_score = lambda d: written(d.groupBy("id").agg(F.first("label").alias("label"), F.avg("p").alias("calibrated"), F.count("*").alias("models")), "fold-scores")
    grid = spark.createDataFrame([(float(p.c), p.penalty, mean[TEST][i]) for i, p in enumerate(points)], "C double, penalty string, mean_auc double")
    return {"oof": mean_score(ready.filter(F.col("judged") != TEST)), "test": mean_score(ready.filter(F.col("judged") == TEST)), "grid": grid,
            "chosen": {f: points[p] for f, p in chosen.items()}}
