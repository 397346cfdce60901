"""Distributed statistics that Spark has no single scalable built-in for.

Quantiles are pandas-style (linear interpolation) and exact, without gathering a column into one task: Spark's exact
``percentile`` keeps every distinct value of a group in one aggregation buffer, which does not survive a 100 TB column.

``column_quantiles`` answers many columns of one table at once by distributed selection: each pass counts, for
every column, the rows per bucket of the range that is left for a wanted rank, and the next pass looks into that bucket alone.
``exact_quantiles`` answers any number of groups by one sort of the distinct values with running counts.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

def exact_quantiles(df: DataFrame, value: str, probs: Sequence[float], by: Sequence[str] = ()) -> DataFrame:
    """Rows ``(*by, q_index, prob, value)``: exact interpolated quantile per group.

    NULL (and NaN) values are ignored, as pandas does.  The distinct values of all groups are sorted together over the
    range partitions; running counts, less those of the groups before, give each value its ranks.
    """
    by, probs = list(by), [float(p) for p in probs]
    v = F.col(value).cast("double")
    base = df.select(*by, F.nanvl(v, F.lit(None).cast("double")).alias("_v")).where(F.col("_v").isNotNull())
    cells = base.groupBy(*by, "_v").agg(F.count(F.lit(1)).alias("_c"))
    cum = prefix_sums(cells.select(F.struct(*by, "_v").alias("_key"), "_c"), "_key", ["_c"])
    cum = cum.select(*[F.col("_key")[c].alias(c) for c in [*by, "_v"]], "_c", "cum__c")
    ends = cum.groupBy(*by).agg(F.min(F.col("cum__c") - F.col("_c")).alias("_before"), F.sum("_c").alias("_n"))
    same = [F.col(f"a.{c}").eqNullSafe(F.col(f"b.{c}")) for c in by]
    j = cum.alias("a").join(ends.alias("b"), same) if by else cum.alias("a").crossJoin(F.broadcast(ends.alias("b")))
    end = F.col("cum__c") - F.col("_before")
    at = lambda r: F.max(F.when((end - F.col("_c") <= r) & (r < end), F.col("a._v")))
    aggs = []
    for i, p in enumerate(probs):
        h = (F.col("_n") - 1) * p
        aggs += [at(F.floor(h)).alias(f"a{i}"), at(F.least(F.floor(h) + 1, F.col("_n") - 1)).alias(f"b{i}")]
    picked = j.groupBy(*[F.col(f"a.{c}") for c in by]).agg(F.max("_n").alias("_n"), *aggs)
    one = [F.struct(F.lit(i).alias("q_index"), F.lit(p).alias("prob"),
                    (F.col(f"a{i}") + ((F.col("_n") - 1) * p - F.floor((F.col("_n") - 1) * p)) * (F.col(f"b{i}") - F.col(f"a{i}"))).alias("value"))
           for i, p in enumerate(probs)]
    return picked.where("_n is not null").select(*by, F.explode(F.array(*one)).alias("q")).select(*by, "q.*")


#: Counters that a pass may bring to the driver, over all columns and groups.
CELLS = 1 << 20


def _keys(x: np.ndarray) -> np.ndarray:
    """Signed integers in the order of the doubles (negative zero counts as zero)."""
    bits = (x + 0.0).view(np.int64)
    return np.where(bits < 0, bits ^ np.int64(0x7FFFFFFFFFFFFFFF), bits)


def _value(key: int) -> float:
    k = np.int64(key)
    return float(np.array([k if k >= 0 else k ^ np.int64(0x7FFFFFFFFFFFFFFF)], np.int64).view(np.float64)[0])


def _numbers(column: pa.Array) -> np.ndarray:
    return pc.fill_null(column, float("nan")).to_numpy(zero_copy_only=False)


def _count_buckets(cols: Sequence[str], groups: list, cells: dict, bits: int | None):
    """Per cell and bucket: rows, least and greatest key.  ``cells`` maps (column, group) to (cell, first key, last key, shift).
    Without ``bits`` every key is a bucket of its own."""
    size = 1 << (bits or 0)

    def fn(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = {}
        for b in batches:
            of = pc.index_in(b.column(b.num_columns - 1), pa.array(groups)).to_numpy(zero_copy_only=False) if groups else None
            for c, name in enumerate(cols):
                x = _numbers(b.column(c))
                real = ~np.isnan(x)
                for g in range(max(1, len(groups))):
                    asked = cells.get((name, g))
                    if not asked:
                        continue
                    key, n = np.unique(_keys(x[real & (of == g)] if groups else x[real]), return_counts=True)
                    for cell, first, last, shift in asked:
                        a, z = np.searchsorted(key, first, "left"), np.searchsorted(key, last, "right")
                        if a == z:
                            continue
                        k = key[a:z]
                        if bits is None:
                            yield pa.RecordBatch.from_arrays([pa.array(np.full(len(k), cell, np.int32)), pa.array(np.zeros(len(k), np.int32)), pa.array(n[a:z]), pa.array(k), pa.array(k)],
                                                             names=["cell", "bucket", "n", "lo", "hi"])
                            continue
                        bucket = ((k.view(np.uint64) - np.int64(first).view(np.uint64)) >> np.uint64(shift)).astype(np.int64)
                        count, lo, hi = held.setdefault(cell, (np.zeros(size, np.int64), np.full(size, np.iinfo(np.int64).max), np.full(size, np.iinfo(np.int64).min)))
                        edge = np.flatnonzero(np.r_[True, bucket[1:] != bucket[:-1]])
                        at = bucket[edge]
                        count[at] += np.add.reduceat(n[a:z], edge)
                        lo[at] = np.minimum(lo[at], k[edge])
                        hi[at] = np.maximum(hi[at], k[np.r_[edge[1:], len(k)] - 1])
        for cell, (count, lo, hi) in held.items():
            at = np.flatnonzero(count)
            yield pa.RecordBatch.from_arrays([pa.array(np.full(len(at), cell, np.int32)), pa.array(at.astype(np.int32)), pa.array(count[at]), pa.array(lo[at]), pa.array(hi[at])],
                                             names=["cell", "bucket", "n", "lo", "hi"])
    return fn


def column_quantiles(df: DataFrame, cols: Sequence[str], probs: Sequence[float], by: str | None = None) -> DataFrame:
    """Rows ``([by,] column, q_index, prob, value)``: exact interpolated quantiles of every column, per value of ``by``.

    NULL and NaN values, and rows of a NULL ``by``, are left out; a column without values has no row.  The columns are written once as a narrow
    table; each pass reads it, keeps counters of bounded size in the tasks and brings sums of them to the driver, until the
    buckets of the wanted ranks hold one value each, or so few rows that a last pass brings their values (two to five passes).  Groups too many for that are
    answered by :func:`exact_quantiles`.
    """
    from claimlens.session import ship_package, written
    spark, probs = df.sparkSession, [float(p) for p in probs]
    ship_package(spark)
    number = [F.nanvl(F.col(c).cast("double"), F.lit(None).cast("double")).alias(c) for c in cols]
    base = df if by is None else df.where(F.col(by).isNotNull())
    rows = written(base.select(*number, *([F.col(by).cast("string").alias("_by")] if by else [])), "quantiles")
    most = CELLS // (64 * max(1, len(cols) * len(probs)))
    groups = [] if by is None else [r["_by"] for r in rows.select("_by").distinct().limit(most + 1).collect()]
    if len(groups) > most:
        parts = None
        for c in cols:
            part = exact_quantiles(base, c, probs, [by]).select(by, F.lit(c).alias("column"), "q_index", "prob", "value")
            parts = part if parts is None else parts.unionByName(part)
        return parts
    # the whole range of every column and group is the first bucket
    ends = rows.groupBy(*(["_by"] if by else [])).agg(*[f(c).alias(f"{n}{i}") for i, c in enumerate(cols) for n, f in (("n", F.count), ("lo", F.min), ("hi", F.max))]).collect()
    spans, wanted = {}, []
    for r in ends:
        g = groups.index(r["_by"]) if by else 0
        for i, c in enumerate(cols):
            if r[f"n{i}"]:
                lo, hi = (int(_keys(np.array([r[f"{k}{i}"]]))[0]) for k in ("lo", "hi"))
                spans[c, g] = (r[f"n{i}"], lo, hi)
                for q, p in enumerate(probs):
                    h = (r[f"n{i}"] - 1) * p
                    low = int(np.floor(h))
                    wanted += [(c, g, q, p, h - low, (low, min(low + 1, r[f"n{i}"] - 1)))]
    # state of a rank: (first key, last key, rows before the first key, rows from first to last)
    state = {(c, g, k): (*spans[c, g][1:], 0, spans[c, g][0]) for c, g, _, _, _, ranks in wanted for k in ranks}
    while True:
        open_ = sorted({(c, g, s[0], s[1], s[3]) for (c, g, _), s in state.items() if s[0] < s[1]})
        if not open_:
            break
        # few rows left: their values are counted themselves
        bits = None if sum(x[4] for x in open_) <= CELLS // 4 else max(6, min(16, (CELLS // len(open_)).bit_length() - 1))
        cells, at = {}, {}
        for cell, (c, g, first, last, _) in enumerate(open_):
            cells.setdefault((c, g), []).append((cell, first, last, max(0, (last - first).bit_length() - (bits or 0))))
            at[c, g, first, last] = cell
        found = rows.mapInArrow(_count_buckets(list(cols), groups, cells, bits), "cell int, bucket int, n long, lo long, hi long") \
            .groupBy("cell", *(["lo"] if bits is None else ["bucket"])).agg(
                F.sum("n").alias("n"), *([F.first("bucket").alias("bucket")] if bits is None else [F.min("lo").alias("lo")]), F.max("hi").alias("hi")) \
            .select("cell", "n", "lo", "hi").toArrow().sort_by([("cell", "ascending"), ("lo", "ascending")])
        cell, n, lo, hi = (found.column(c).to_numpy() for c in ("cell", "n", "lo", "hi"))
        for (c, g, k), (first, last, before, _) in state.items():
            if first < last:
                a, z = np.searchsorted(cell, [at[c, g, first, last], at[c, g, first, last] + 1])
                end = before + np.cumsum(n[a:z])
                j = int(np.searchsorted(end, k, "right"))
                state[c, g, k] = (int(lo[a + j]), int(hi[a + j]), int(end[j] - n[a + j]), int(n[a + j]))
    out = []
    for c, g, q, p, part, (low, high) in wanted:
        a, b = _value(state[c, g, low][0]), _value(state[c, g, high][0])
        out.append((groups[g] if by else None, c, q, p, a + part * (b - a)))
    made = spark.createDataFrame(out, "_by string, column string, q_index int, prob double, value double")
    return made.select(*([F.col("_by").cast(df.schema[by].dataType).alias(by)] if by else []), "column", "q_index", "prob", "value")


def quantiles_wide(df: DataFrame, cols: Sequence[str], probs: Sequence[float], names: Sequence[str], by: str | None = None) -> DataFrame:
    """:func:`column_quantiles` with one column per quantile: ``([by,] column, *names)``."""
    aggs = [F.max(F.when(F.col("q_index") == i, F.col("value"))).alias(n) for i, n in enumerate(names)]
    return column_quantiles(df, cols, probs, by).groupBy(*([by] if by else []), "column").agg(*aggs)


def pearson(a: str, b: str):
    """Pairwise-complete Pearson correlation; NULL (not an ANSI error) when a side is constant."""
    both = F.col(a).isNotNull() & F.col(b).isNotNull()
    sa = F.stddev_samp(F.when(both, F.col(a)))
    sb = F.stddev_samp(F.when(both, F.col(b)))
    return F.try_divide(F.covar_samp(a, b), sa * sb)


def prefix_sums(df: DataFrame, order_col: str, cols: Sequence[str], descending: bool = False,
                partitions: int | None = None) -> DataFrame:
    """Inclusive running sums ``cum_<c>`` of ``cols`` along a global order of the unique ``order_col``.

    Distributed: range-partition by the order, checkpoint (so partition ids are
    fixed), total each partition (P rows), prefix the P totals (a bounded window),
    then run a window *within* each range partition and add its offset.
    """
    from claimlens.session import checkpoint_dir
    spark = df.sparkSession
    p = partitions or int(spark.conf.get("spark.sql.shuffle.partitions"))
    order = F.col(order_col).desc() if descending else F.col(order_col).asc()
    checkpoint_dir(spark)
    ranged = df.repartitionByRange(p, order).withColumn("_pid", F.spark_partition_id()).checkpoint(eager=True)
    totals = ranged.groupBy("_pid").agg(*[F.sum(c).alias(f"_t_{c}") for c in cols])
    before = Window.orderBy("_pid").rowsBetween(Window.unboundedPreceding, -1)
    offsets = totals.select("_pid", *[F.coalesce(F.sum(f"_t_{c}").over(before), F.lit(0)).alias(f"_o_{c}")
                                      for c in cols])
    within = Window.partitionBy("_pid").orderBy(order).rowsBetween(Window.unboundedPreceding, 0)
    out = ranged.join(F.broadcast(offsets), "_pid")  # one row per partition: bounded
    out = out.withColumns({f"cum_{c}": F.col(f"_o_{c}") + F.sum(c).over(within) for c in cols})
    return out.drop("_pid", *[f"_o_{c}" for c in cols])


def pearson_table(df: DataFrame, pairs: Sequence[tuple[str, str]], singles: Sequence[str] = ()) -> DataFrame:
    """One-row table of pairwise-complete Pearson correlations ``"a|b"`` (NULL when a side is constant)
    and, for ``singles``, the centred sum of squares ``"ss|c"``.

    Two scans: the column means, then the products of the centred columns of all pairs at once, as matrix products over
    Arrow batches (a missing value counts as zero in them, and a product of the masks counts the complete rows).  Only one
    columns x columns matrix a task leaves the scan.
    """
    from claimlens.session import ship_package
    spark = df.sparkSession
    ship_package(spark)
    cols = list(dict.fromkeys([*(c for p in pairs for c in p), *singles]))
    plain = df.select(*[F.nanvl(F.col(c).cast("double"), F.lit(None).cast("double")).alias(c) for c in cols])
    means = plain.agg(*[F.avg(c).alias(c) for c in cols]).first()
    centre = np.array([0.0 if m is None else m for m in means])
    w = len(cols)

    def fn(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums = np.zeros((4, w, w))
        for b in batches:
            x = np.stack([_numbers(b.column(i)) for i in range(w)], axis=1) - centre
            real = ~np.isnan(x)
            x, real = np.where(real, x, 0.0), real.astype(float)
            sums += np.stack([real.T @ real, x.T @ real, (x * x).T @ real, x.T @ x])
        yield pa.RecordBatch.from_arrays([pa.array(np.arange(4 * w * w, dtype=np.int32)), pa.array(sums.ravel())], names=["at", "v"])

    flat = np.zeros(4 * w * w)
    for at, v in plain.mapInArrow(fn, "at int, v double").groupBy("at").agg(F.sum("v")).collect():  # 4 x columns x columns numbers
        flat[at] = v
    n, s, q, c = flat.reshape(4, w, w)
    place, out = {name: i for i, name in enumerate(cols)}, {}
    for a, b in pairs:
        i, j = place[a], place[b]
        caa, cbb = (q[u, v] - s[u, v] ** 2 / n[i, j] if n[i, j] else 0.0 for u, v in ((i, j), (j, i)))
        both = caa > 1e-14 * q[i, j] and cbb > 1e-14 * q[j, i]
        out[f"{a}|{b}"] = float((c[i, j] - s[i, j] * s[j, i] / n[i, j]) / np.sqrt(caa * cbb)) if both else None
    for name in singles:
        i = place[name]
        out[f"ss|{name}"] = float(max(0.0, q[i, i] - s[i, i] ** 2 / n[i, i])) if n[i, i] else None
    schema = ", ".join(f"`{k}` double" for k in out)
    return spark.createDataFrame([tuple(out.values())], schema)
