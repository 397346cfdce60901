"""Near-duplicate groups by MinHash signatures and a multi-index Hamming join.

Signature: ``slots`` minima of a document's distinct word shingles under independent 64-bit hashes,
``b`` = 32 bits of each.  Two signatures are at distance d when d slots differ.  The slots are cut
into ``chunks`` parts; by the pigeonhole principle two signatures at distance at most
``t = chunks * (errors + 1) - 1`` agree in some chunk up to ``errors`` slots, so indexing each chunk
once per choice of ``errors`` slots left out finds *all* pairs within t.  With 64 slots, 17 chunks and
one error, t = 33; a pair at Jaccard 0.75 lies beyond it with probability below 2e-6.

1. Equal shingle sets are one class (grouped by a 128-bit digest of the set), so copies cost a row.
2. Buckets of the index get a leader, the member that shares most buckets; only the pairs (leader,
   member) are confirmed on the full sets: a group of g near copies costs g pairs, not g * g.
3. Buckets that still hold several components are compared completely, in blocks of ``block`` by
   ``block`` members, by a sharper signature of ``bits`` one-bit minima; pairs of different
   components within its distance (exceeded at the similarity with probability below 1e-6) are
   confirmed on the full sets.  No bucket is cut off.
4. Components by alternating large-star and small-star steps on the confirmed links.

Defined results: null or wordless text has an empty set and is linked with nothing; with fewer than
``n`` words the whole sequence is the one shingle; rows that share a doc_id are one document; rows
with a null doc_id are linked with nothing, have a null component and are kept; an empty table gives
an empty result; other columns are ignored.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from functools import reduce
from itertools import combinations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from claimlens.functions.stats import prefix_sums
from claimlens.llm.common import BLANK_SEPARATED, Words, by_ids, gram_hashes, materialise, mix64, ready, release, slices

_RNG = np.random.default_rng(75)


def shingle_sets(data: np.ndarray, offs: np.ndarray, n: int) -> list[np.ndarray]:
    """Sorted distinct shingle hashes of each text."""
    words = Words(data, offs, BLANK_SEPARATED)
    h = words.hashes()
    g = gram_hashes(h, n)
    out = []
    for a, b in zip(words.first[:-1].tolist(), words.first[1:].tolist(), strict=True):
        if b - a >= n:
            out.append(np.unique(g[a:b - n + 1]))
        elif b > a:
            out.append(mix64(gram_hashes(h[a:b], b - a) + np.uint64(b - a)))
        else:
            out.append(np.zeros(0, np.uint64))
    return out


def signatures(sets: list[np.ndarray], slots: int) -> np.ndarray:
    """MinHash signature (``slots`` values of 32 bits) of each non-empty set."""
    rng = np.random.default_rng(slots)
    turn = rng.integers(0, 1 << 63, slots, dtype=np.uint64)
    by = rng.integers(0, 1 << 62, slots, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
    flat = np.concatenate([np.zeros(0, np.uint64), *sets])
    starts = np.cumsum([0, *(len(s) for s in sets)])[:-1]
    sig = np.empty((len(sets), slots), np.uint32)
    if len(sets):
        for j in range(slots):
            sig[:, j] = mix64(np.minimum.reduceat((flat ^ turn[j]) * by[j], starts)) >> np.uint64(32)
    return sig


def sign(docs: DataFrame, doc_id: str, text: str, n: int, slots: int) -> DataFrame:
    """doc_id, n_shingles, digest of the set (null if empty) and signature."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part, data, offs in slices(batch, "text"):
                sets = shingle_sets(data, offs, n)
                full = [s for s in sets if len(s)]
                rows = iter(signatures(full, slots))
                yield pa.RecordBatch.from_arrays([
                    part.column(0), pa.array([len(s) for s in sets], pa.int64()),
                    pa.array([hashlib.blake2b(s.tobytes(), digest_size=16).digest() if len(s) else None for s in sets], pa.binary()),
                    pa.array([next(rows).tobytes() if len(s) else None for s in sets], pa.binary())],
                    names=["doc_id", "n_shingles", "digest", "sig"])

    return docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.col(text).cast("string").alias("text")) \
        .mapInArrow(run, "doc_id long, n_shingles long, digest binary, sig binary")


def index_keys(sig: np.ndarray, chunks: int, errors: int) -> np.ndarray:
    """Keys of every signature: for each chunk, each choice of ``errors`` slots left out."""
    keys = []
    for c, part in enumerate(np.array_split(np.arange(sig.shape[1]), chunks)):
        for m, left in enumerate(combinations(part, max(1, len(part) - errors))):
            k = np.full(len(sig), c * 1000 + m + 1, np.uint64)
            for j in left:
                k = mix64(k * np.uint64(0x9E3779B97F4A7C15) + sig[:, j].astype(np.uint64))
            keys.append(k)
    return np.stack(keys, 1)


def buckets(classes: DataFrame, slots: int, chunks: int, errors: int) -> DataFrame:
    """Members of the index's buckets of two and more: key, its place among a node's keys, node, size."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            if b.num_rows:
                sig = np.frombuffer(b"".join(b.column(1).to_pylist()), np.uint32).reshape(-1, slots)
                keys = index_keys(sig, chunks, errors)
                node = b.column(0).to_numpy(zero_copy_only=False)
                at = np.tile(np.arange(keys.shape[1], dtype=np.int32), len(node))
                yield pa.RecordBatch.from_arrays([pa.array(keys.ravel().view(np.int64)), pa.array(at), pa.array(np.repeat(node, keys.shape[1]))], names=["key", "at", "node"])

    keys = classes.select("node", "sig").mapInArrow(run, "key long, at int, node long")
    sizes = keys.groupBy("key").agg(F.count("*").alias("size")).filter("size > 1")
    return keys.join(sizes, "key")


def leaders(members: DataFrame) -> DataFrame:
    """Of every bucket the member that shares most buckets (the smallest of equals)."""
    weight = members.groupBy("node").agg(F.sum("size").alias("weight"))
    weighed = members.select("key", "node").join(weight, "node")
    return weighed.groupBy("key").agg(F.max(F.struct("weight", (-F.col("node")).alias("back"))).alias("top")).select("key", (-F.col("top.back")).alias("leader"))


def leader_pairs(members: DataFrame, leader: DataFrame) -> DataFrame:
    """(leader, member) of every bucket, each pair once with a < b."""
    return _ordered(members.select("key", "node").join(leader, "key").select(F.col("leader").alias("x"), F.col("node").alias("y")))


def _ordered(pairs: DataFrame) -> DataFrame:
    return pairs.filter("x != y").select(F.least("x", "y").alias("a"), F.greatest("x", "y").alias("b")).distinct()


def within(pairs: DataFrame, classes: DataFrame, most: int, low: int, high: int) -> DataFrame:
    """Pairs whose signatures are within ``most`` and whose set sizes allow the similarity."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            if b.num_rows:
                x, y = (np.frombuffer(b"".join(b.column(i).to_pylist()), np.uint32).reshape(b.num_rows, -1) for i in (2, 3))
                near = pa.array((x != y).sum(1) <= most)
                yield b.select([0, 1]).filter(near)

    one = classes.select(F.col("node").alias("a"), F.col("sig").alias("sa"), F.col("n").alias("na"))
    two = classes.select(F.col("node").alias("b"), F.col("sig").alias("sb"), F.col("n").alias("nb"))
    both = pairs.join(one, "a").join(two, "b").filter(f"{high} * least(na, nb) >= {low} * greatest(na, nb)")
    return both.select("a", "b", "sa", "sb").mapInArrow(run, "a long, b long")


def confirm(pairs: DataFrame, docs: DataFrame, doc_id: str, text: str, n: int, low: int, high: int) -> DataFrame:
    """The written ``pairs`` with the size ``both`` of the intersection of their full shingle sets and
    ``linked``: high * |both| >= low * |either|.  Only the texts of their documents are read again."""
    def sets(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part, data, offs in slices(batch, "text"):
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array([s.tobytes() for s in shingle_sets(data, offs, n)], pa.binary())], names=["node", "grams"])

    def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            both, linked = [], []
            for x, y in zip(b.column(2), b.column(3), strict=True):
                x, y = (np.frombuffer(v.as_buffer(), np.uint64) for v in (x, y))
                if len(x) > len(y):
                    x, y = y, x
                n_both = int((y[np.minimum(np.searchsorted(y, x), len(y) - 1)] == x).sum())
                both.append(n_both)
                linked.append(high * n_both >= low * (len(x) + len(y) - n_both))
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(both, pa.int64()), pa.array(linked, pa.bool_())], names=["a", "b", "both", "linked"])

    ids = materialise(pairs.select(F.col("a").alias("node")).union(pairs.select("b")).distinct(), "near-ids")
    rows = docs.select(F.col(doc_id).cast("long").alias("node"), F.col(text).cast("string").alias("text"))
    full = materialise(by_ids(rows, ids, "node", "left_semi").mapInArrow(sets, "node long, grams binary").distinct(), "near-sets")
    sides = pairs.join(full.select(F.col("node").alias("a"), F.col("grams").alias("ga")), "a") \
        .join(full.select(F.col("node").alias("b"), F.col("grams").alias("gb")), "b")
    measured = sides.select("a", "b", "ga", "gb").mapInArrow(compare, "a long, b long, both long, linked boolean")
    out = materialise(measured.groupBy("a", "b").agg(F.max("both").alias("both"), F.max("linked").alias("linked")), "near-links")
    release(full)
    release(ids)
    return out


def components(links: DataFrame) -> DataFrame:
    """Alternating stars over links (a < b): node and comp (the smallest node it reaches) for every node that has a link."""
    edges, mark = materialise(links.select("a", "b"), "near-edges"), None
    while True:
        both = edges.unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
        low = both.groupBy("a").agg(F.least(F.col("a"), F.min("b")).alias("m"))
        large = both.filter("b > a").join(low, "a").select(F.col("m").alias("a"), "b").filter("a != b").distinct()
        up = materialise(large, "near-large")
        least = up.groupBy("b").agg(F.min("a").alias("m"))
        small = up.join(least, "b").select(F.col("m").alias("x"), F.explode(F.array("a", "b")).alias("y"))
        nxt = materialise(_ordered(small), "near-small")
        state = nxt.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first()
        release(edges)
        release(up)
        edges = nxt
        if tuple(state) == mark:
            break
        mark = tuple(state)
    stars = edges.groupBy("b").agg(F.min("a").alias("comp")).select(F.col("b").alias("node"), "comp")
    return stars.unionByName(edges.select(F.col("a").alias("node"), F.col("a").alias("comp")).distinct())


def bit_signatures(sets: list[np.ndarray], bits: int) -> np.ndarray:
    """One-bit MinHash: a bit of each of ``bits`` minima, packed into bytes."""
    rng = np.random.default_rng(bits + 1)
    turn = rng.integers(0, 1 << 63, bits, dtype=np.uint64)
    by = rng.integers(0, 1 << 62, bits, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
    flat = np.concatenate([np.zeros(0, np.uint64), *sets])
    starts = np.cumsum([0, *(len(s) for s in sets)])[:-1]
    out = np.zeros((len(sets), bits), bool)
    if len(sets):
        for j in range(bits):
            out[:, j] = mix64(np.minimum.reduceat((flat ^ turn[j]) * by[j], starts)) >> np.uint64(63)
    return np.packbits(out, axis=1)


def bit_distance(low: int, high: int, bits: int) -> int:
    """Distance that a pair at the similarity exceeds with probability below 1e-6."""
    p = (1 - low / high) / 2
    return int(np.ceil(bits * p + 4.8 * np.sqrt(bits * p * (1 - p))))


def _runs(batches: Iterator[pa.RecordBatch], by: list[str]) -> Iterator[pa.Table]:
    """Tables of the rows between two changes of ``by`` in sorted batches."""
    held: pa.Table | None = None
    for b in batches:
        t = pa.Table.from_batches([b])
        t = t if held is None else pa.concat_tables([held, t]).combine_chunks()
        if not t.num_rows:
            continue
        cols = [t.column(c).to_numpy() for c in by]
        cut = np.flatnonzero(np.any([c[1:] != c[:-1] for c in cols], axis=0)) + 1
        edges = [0, *cut.tolist()]
        for x, y in zip(edges[:-1], edges[1:], strict=True):
            yield t.slice(x, y - x)
        held = t.slice(edges[-1])
    if held is not None:
        yield held


def cross_pairs(members: DataFrame, leader: DataFrame, measured: DataFrame, comps: DataFrame, docs: DataFrame, doc_id: str, text: str, n: int, low: int, high: int,
                slots: int, chunks: int, errors: int, bits: int, block: int) -> DataFrame:
    """Pairs that share a bucket but no component, within the distance of their bit signatures,
    found block by block of a bucket's members.  A pair comes out of the first bucket it shares
    only, told by its keys.  Where the intersections of both with the bucket's leader
    are ``measured``, |x & y| <= min(|x & l|, |y & l|) + min(|x - l|, |y - l|) must allow the link."""
    most = bit_distance(low, high, bits)

    def sign_bits(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part, data, offs in slices(batch, "text"):
                sets = shingle_sets(data, offs, n)
                keep = pa.array([len(s) > 0 for s in sets], pa.bool_())
                full = [s for s in sets if len(s)]
                keys = index_keys(signatures(full, slots), chunks, errors)
                yield pa.RecordBatch.from_arrays([part.column(0).filter(keep), pa.array([r.tobytes() for r in bit_signatures(full, bits)], pa.binary()),
                                                  pa.array([r.tobytes() for r in keys], pa.binary()), pa.array([len(s) for s in full], pa.int64())],
                                                 names=["node", "bits", "keys", "n"])

    def near(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for run in _runs(batches, ["key", "i", "j"]):
            node, comp, part, size = (run.column(c).to_numpy() for c in ("node", "comp", "part", "n"))
            sig = np.frombuffer(b"".join(run.column("bits").to_pylist()), np.uint64).reshape(len(node), -1)
            keys = np.frombuffer(b"".join(run.column("keys").to_pylist()), np.uint64).reshape(len(node), -1)
            at = run.column("at")[0].as_py()
            y = np.flatnonzero(part == run.column("j")[0].as_py())
            own = run.column("own").fill_null(-1).to_numpy()
            sig_y, comp_y, size_y, own_y, found = sig[y], comp[y], size[y], own[y], []
            for k in np.flatnonzero(part == run.column("i")[0].as_py()).tolist():
                ok = comp_y != comp[k]
                common = np.minimum(size_y, size[k])
                if own[k] >= 0:
                    bound = np.minimum(own_y, own[k]) + np.minimum(size_y - own_y, size[k] - own[k])
                    common = np.where(own_y >= 0, np.minimum(common, bound), common)
                ok &= high * common >= low * (size_y + size[k] - common)
                ok[ok] = np.bitwise_count(sig_y[ok] ^ sig[k]).sum(1) <= most
                ok[ok] = (keys[y[ok]] == keys[k]).argmax(1) == at
                found += [(node[k], v) for v in node[y[ok]].tolist()]
            if found:
                pairs = np.unique(np.sort(np.array(found, np.int64), axis=1), axis=0)
                yield pa.RecordBatch.from_arrays([pa.array(pairs[:, 0]), pa.array(pairs[:, 1])], names=["x", "y"])

    own = members.join(comps, "node", "left").select("key", "at", "node", F.coalesce("comp", "node").alias("comp"))
    mixed = own.groupBy("key").agg(F.count("*").alias("size"), F.min("comp").alias("lo"), F.max("comp").alias("hi")).filter("lo != hi") \
        .select("key", F.ceil(F.col("size") / block).cast("int").alias("parts"))
    known = measured.select(F.col("a").alias("leader"), F.col("b").alias("node"), F.col("both").alias("own")) \
        .unionByName(measured.select(F.col("b").alias("leader"), F.col("a").alias("node"), F.col("both").alias("own")))
    placed = materialise(own.join(mixed, "key").join(leader, "key").join(known, ["leader", "node"], "left"), "near-mixed")
    ids = materialise(placed.select("node").distinct(), "near-ids")
    rows = docs.select(F.col(doc_id).cast("long").alias("node"), F.col(text).cast("string").alias("text"))
    signed = materialise(by_ids(rows, ids, "node", "left_semi").mapInArrow(sign_bits, "node long, bits binary, keys binary, n long").distinct(), "near-bits")
    dealt = placed.withColumn("part", F.pmod(F.xxhash64("node"), F.col("parts")).cast("int")) \
        .withColumn("other", F.explode(F.sequence(F.lit(0), F.col("parts") - 1))) \
        .select("key", F.least("part", "other").alias("i"), F.greatest("part", "other").alias("j"), "at", "node", "comp", "part",
                (F.col("leader") == F.col("node")).alias("leads"), "own")
    sorted_ = dealt.join(signed, "node").withColumn("own", F.when(F.col("leads"), F.col("n")).otherwise(F.col("own"))).repartition("key", "i", "j").sortWithinPartitions("key", "i", "j")
    return _ordered(sorted_.mapInArrow(near, "x long, y long"))


def near_duplicates(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", n: int = 5, low: int = 75, high: int = 100,
                    slots: int = 64, chunks: int = 17, errors: int = 1, bits: int = 2048, block: int = 512) -> DataFrame:
    """doc_id, n_shingles, component_id and kept (doc_id is its component's smallest) for every row.

    Ids that are no whole numbers are numbered in their order first; that joins the texts with the numbers once.
    """
    ready(docs.sparkSession)
    if not isinstance(docs.schema[doc_id].dataType, T.IntegralType):
        ids = docs.filter(F.col(doc_id).isNotNull()).select(F.col(doc_id).alias("id")).distinct().withColumn("one", F.lit(1))
        ids = materialise(prefix_sums(ids, "id", ["one"]).select("id", F.col("cum_one").cast("long").alias("number")), "near-names")
        numbered = docs.select(F.col(doc_id).alias("id"), F.col(text).alias("text")).join(ids, "id", "left").select(F.col("number").alias("doc_id"), "text")
        out = near_duplicates(materialise(numbered, "near-numbered"), "doc_id", "text", n, low, high, slots, chunks, errors, bits, block)
        named = out.join(ids.select(F.col("id").alias("own"), F.col("number").alias("doc_id")), "doc_id", "left") \
            .join(ids.select(F.col("id").alias("of"), F.col("number").alias("component_id")), "component_id", "left")
        return named.select(F.col("own").alias("doc_id"), "n_shingles", F.col("of").alias("component_id"), "kept")
    most = chunks * (errors + 1) - 1
    signed = materialise(sign(docs, doc_id, text, n, slots), "near-signed")
    classes = materialise(signed.filter("digest is not null and doc_id is not null").groupBy("digest")
                          .agg(F.min("doc_id").alias("node"), F.first("sig").alias("sig"), F.first("n_shingles").alias("n")), "near-classes")
    members = materialise(buckets(classes, slots, chunks, errors), "near-buckets")
    leader = materialise(leaders(members), "near-leaders")
    first = materialise(within(leader_pairs(members, leader), classes, most, low, high), "near-pairs")
    measured = confirm(first, docs, doc_id, text, n, low, high)
    links = [measured.filter("linked")]
    comps = materialise(components(links[0]), "near-comps")
    rest = cross_pairs(members, leader, measured, comps, docs, doc_id, text, n, low, high, slots, chunks, errors, bits, block)
    second = materialise(rest.join(first, ["a", "b"], "left_anti"), "near-more")
    links.append(confirm(second, docs, doc_id, text, n, low, high).filter("linked"))
    shared = signed.filter("digest is not null and doc_id is not null").groupBy("doc_id") \
        .agg(F.min("digest").alias("d1"), F.max("digest").alias("d2")).filter("d1 != d2").select("doc_id")
    same = signed.join(shared, "doc_id").join(classes.select("digest", "node"), "digest").select(F.col("doc_id").alias("x"), F.col("node").alias("y"))
    groups = components(reduce(DataFrame.unionByName, [*(x.select("a", "b") for x in links), _ordered(same)]))
    ids = classes.join(groups, "node", "left").select("digest", F.coalesce("comp", "node").alias("comp"))
    out = signed.select("doc_id", "n_shingles", "digest").join(ids, "digest", "left")
    comp = F.when(F.col("doc_id").isNotNull(), F.coalesce("comp", "doc_id"))
    return out.select("doc_id", "n_shingles", comp.alias("component_id"), F.col("doc_id").eqNullSafe(comp).alias("kept"))
