"""Sharding by best-fit-decreasing bin packing of indivisible groups.

Rows with equal texts form a group and stay together.  Groups are taken largest first; each goes to
the shard with the tightest remaining capacity that still holds it, found in a balanced tree.
With a fixed capacity new shards open when nothing fits (``capacity=``); with a fixed number of
shards (``shards=``) the smallest capacity that needs no further shard is searched, and a group
above the fair share of what is left gets a shard of its own.

The tree never sees single groups.  Sizes are rounded up to twelve significant bits, so there are at
most about 110,000 size classes whatever the input; equal classes are placed in runs, since the shard
that took one is the tightest for the next until it is full.  Spark ranks the groups inside their
class, and a run names a range of ranks.  Driver memory follows size classes and shards only.

Defined results: null text is a group of its own with no bytes; an empty text is another; a row's size
is the UTF-8 length of its text plus one; repeated rows are rows of one group; fewer groups than
shards leave shards empty; an empty table gives an empty result.
"""

from __future__ import annotations

import random

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from claimlens.llm.common import materialise, range_ranks, ready, release, text_crc32

Run = tuple[int, int, int, int]  # size class, first rank, rank after the last, shard


class GapTree:
    """Remaining capacities in a treap ordered by (capacity, shard): insert, and take out the
    smallest that is at least a given size, in logarithmic expected time."""

    def __init__(self):
        self.root = None
        self.draw = random.Random(7).random

    def insert(self, gap: tuple[int, int]) -> None:
        below, above = self._split(self.root, gap)
        self.root = self._merge(self._merge(below, [gap, self.draw(), None, None]), above)

    def take(self, size: int) -> tuple[int, int] | None:
        """Remove and return the tightest gap of at least ``size``."""
        below, above = self._split(self.root, (size, -1))
        if above is None:
            self.root = below
            return None
        node, parent = above, None
        while node[2] is not None:
            node, parent = node[2], node
        if parent is None:
            above = node[3]
        else:
            parent[2] = node[3]
        self.root = self._merge(below, above)
        return node[0]

    def _split(self, t, key):
        if t is None:
            return None, None
        if t[0] < key:
            low, high = self._split(t[3], key)
            t[3] = low
            return t, high
        low, high = self._split(t[2], key)
        t[2] = high
        return low, t

    def _merge(self, a, b):
        if a is None or b is None:
            return a if b is None else b
        if a[1] > b[1]:
            a[3] = self._merge(a[3], b)
            return a
        b[2] = self._merge(a, b[2])
        return b


def best_fit_decreasing(classes: list[tuple[int, int]], capacity: int, most: int | None = None, first: int = 0) -> list[Run] | None:
    """Runs of the classes (size, count; largest first) into shards of ``capacity``, numbered from
    ``first``; None if that needs more than ``most``.  A class above the capacity gets shards alone."""
    tree, opened, runs = GapTree(), 0, []
    for size, n in classes:
        done = 0
        while done < n:
            gap = tree.take(size)
            if gap is None:
                if most is not None and opened == most:
                    return None
                gap = (max(capacity, size), first + opened)
                opened += 1
            k = min(n - done, gap[0] // size)
            runs.append((size, done, done + k, gap[1]))
            done += k
            tree.insert((gap[0] - k * size, gap[1]))
    return runs


def balanced(classes: list[tuple[int, int]], shards: int) -> list[Run]:
    """Runs into exactly ``shards`` shards with the smallest largest shard that best-fit-decreasing finds."""
    left, total, rest, runs, taken = shards, sum(s * n for s, n in classes), [], [], {}
    for size, n in classes:
        while n > taken.get(size, 0) and left > 1 and size * left >= total:
            k = taken.get(size, 0)
            runs.append((size, k, k + 1, shards - left))
            taken[size], left, total = k + 1, left - 1, total - size
        if n > taken.get(size, 0):
            rest.append((size, n - taken.get(size, 0)))
    if not rest:
        return runs
    low, high, best = -(-total // left), total, None
    while best is None or low < high:
        mid = high if best is None else (low + high) // 2
        found = best_fit_decreasing(rest, mid, left, shards - left)
        if found is None:
            low = mid + 1
        else:
            best, high = found, mid
    return runs + [(s, a + taken.get(s, 0), b + taken.get(s, 0), shard) for s, a, b, shard in best]


def assign_shards(docs: DataFrame, shards: int | None = 16, capacity: int | None = None, doc_id: str = "doc_id", text: str = "text",
                  carry: tuple[str, ...] = ()) -> DataFrame:
    """doc_id, size, text_crc32, the columns in ``carry``, shard and slot (0, 1, ... inside the shard,
    ordered by doc_id and text digest) of every row."""
    if (shards is None) == (capacity is None):
        raise ValueError("give either shards or capacity")
    spark = docs.sparkSession
    ready(spark)
    t = F.col(text).cast("string")
    rows = docs.select(F.col(doc_id).alias("doc_id"), (F.coalesce(F.octet_length(t), F.lit(0)) + 1).cast("bigint").alias("size"),
                       F.coalesce(text_crc32(t), F.lit(0)).alias("text_crc32"), F.coalesce(F.unhex(F.sha2(t, 256)), F.lit(b"")).alias("digest"),
                       *[F.col(c) for c in carry if c not in ("doc_id", "size", "text_crc32", "digest", "shard", "slot")])
    total = rows.groupBy("digest").agg(F.sum("size").alias("bytes")).withColumn("cut", F.greatest(F.length(F.bin("bytes")) - 12, F.lit(0)))
    groups = materialise(total.select("digest", F.expr("shiftleft(shiftright(bytes + shiftleft(1L, cut) - 1L, cut), cut)").alias("class")), "shard-groups")
    ranked, classes = range_ranks(groups, "class", ["digest"], "shard-ranks")
    sizes = sorted(((r["class"], r["n"]) for r in classes.collect()), reverse=True)
    runs = balanced(sizes, shards) if shards is not None else best_fit_decreasing(sizes, capacity)
    table = spark.createDataFrame(runs or [(0, 0, 0, 0)], "class long, low long, high long, shard int")
    inside = (F.col("rank") >= F.col("low")) & (F.col("rank") < F.col("high"))
    placed = ranked.alias("r").join(F.broadcast(table).alias("p"), (F.col("r.class") == F.col("p.class")) & inside).select("digest", "shard")
    put = materialise(rows.join(placed, "digest"), "shard-rows")
    release(groups)
    out, _ = range_ranks(put, "shard", ["doc_id", "digest"], "shard-slots")
    return out.withColumnRenamed("rank", "slot").drop("digest")


def write_shards(assigned: DataFrame, path: str) -> None:
    """One folder of Parquet files per shard, rows in slot order."""
    assigned.repartitionByRange("shard", "slot").sortWithinPartitions("shard", "slot").write.partitionBy("shard").parquet(path)
