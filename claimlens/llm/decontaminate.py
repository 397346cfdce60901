"""Benchmark decontamination by winnowing.

A text becomes the sequence of its word hashes.  For a span of ``L`` words the hashes of all
k-grams (k about L/2) are taken, and of every ``w = L - k + 1`` consecutive k-grams the smallest
(the last of equals) is kept.  Both sides keep the same k-gram of any shared run of ``L`` words, so
every such run has a fingerprint in common.  Where a text's fingerprint is one of the benchmark's, the hit is extended: each of
the at most ``w`` spans of ``L`` words around it is looked up among the spans of the benchmark, and the spans found
are joined to runs.  So a text costs its own length, however often a word or a fingerprint repeats on either side.
Items shorter than the span are one window, found with ``L`` = their own length.

A benchmark whose index is at most ``index_bytes`` is sent to every task, and documents stay where they are.  A larger one is
joined in Spark: the documents' distinct fingerprints meet the benchmark's in a semi join, the spans around those that are
left meet the benchmark's spans, and only the runs go back to the documents.  The sides that are joined to are distinct, so
a fingerprint found everywhere multiplies nothing, and skewed partitions of documents can be split.

Defined results: null or wordless text has 0 words and no hits; equal rows each get the same
result; an empty benchmark gives no hits; a null ``item_id`` counts as the empty string; items of
the same id are one item; further columns pass through (but for one named ``__key``, ``__spans`` or ``__items``), and an
input column named as the result column is replaced.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from claimlens.llm.common import _GRAM, ALNUM, Words, gram_hashes, materialise, mix64, ready, slices

RESULT = T.StructType([
    T.StructField("n_words", T.LongType()),
    T.StructField("n_hit", T.LongType()),
    T.StructField("spans", T.ArrayType(T.StructType([T.StructField("start", T.LongType()), T.StructField("end", T.LongType())]))),
    T.StructField("items", T.ArrayType(T.StringType())),
])
_ARROW = pa.struct([("n_words", pa.int64()), ("n_hit", pa.int64()),
                    ("spans", pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())]))), ("items", pa.list_(pa.string()))])


def winnow(words: np.ndarray, first: np.ndarray, span: int) -> tuple[np.ndarray, np.ndarray]:
    """Kept fingerprints of consecutive texts: word positions and k-gram hashes."""
    k = (span + 1) // 2
    w = span - k + 1
    n = len(words) - span + 1
    if n <= 0:
        return np.zeros(0, np.int64), np.zeros(0, np.uint64)
    g = gram_hashes(words, k)
    least, at = g[:n].copy(), np.arange(n)
    for j in range(1, w):
        h = g[j:n + j]
        better = h <= least
        least[better] = h[better]
        at[better] = np.flatnonzero(better) + j
    inside = np.zeros(len(words) + 1, np.int32)
    sizes = np.diff(first)
    long = sizes >= span
    np.add.at(inside, first[:-1][long], 1)
    np.add.at(inside, first[1:][long] - span + 1, -1)
    pos = np.unique(at[np.cumsum(inside[:n]) > 0])
    return pos, g[pos]


def span_hashes(words: np.ndarray, starts: np.ndarray, length: int) -> np.ndarray:
    """Hash of the ``length`` words from each start on."""
    g = words[starts].copy()
    for j in range(1, length):
        g = g * _GRAM + words[starts + j]
    return mix64(g)


def around(pos: np.ndarray, first: np.ndarray, length: int) -> np.ndarray:
    """Starts of the spans of ``length`` words, inside one text, that hold the k-gram at each place."""
    doc = np.searchsorted(first, pos, "right") - 1
    reach = length - (length + 1) // 2
    starts = np.unique((pos[:, None] - np.arange(reach + 1)).ravel()) if len(pos) else pos
    low, high = first[doc], first[doc + 1] - length
    inside = np.zeros(len(starts), bool)
    for j in range(reach + 1):
        at = pos - j
        inside[np.searchsorted(starts, at[(at >= low) & (at <= high)])] = True
    return starts[inside]


def lengths(first: np.ndarray, span: int) -> list[int]:
    sizes = np.minimum(np.diff(first), span)
    return np.unique(sizes[sizes > 0]).tolist()


def item_parts(words: np.ndarray, first: np.ndarray, span: int) -> Iterator[tuple[int, np.ndarray, np.ndarray, np.ndarray, np.ndarray]]:
    """By length of the items' spans: fingerprints, and for every span its text, start and hash."""
    sizes = np.minimum(np.diff(first), span)
    for length in lengths(first, span):
        own = np.flatnonzero(sizes == length)
        back = np.concatenate([np.arange(first[i], first[i + 1]) for i in own])
        _, fp = winnow(words[back], np.r_[0, np.cumsum(np.diff(first)[own])], length)
        starts = np.concatenate([np.arange(first[i], first[i + 1] - length + 1) for i in own])
        yield length, np.unique(fp), np.searchsorted(first, starts, "right") - 1, starts, span_hashes(words, starts, length)


class Index:
    """Fingerprints and spans of the benchmark items, by span length; a span knows the items it occurs in."""

    def __init__(self, items: list[tuple[str, np.ndarray]], span: int):
        names = sorted({item for item, _ in items})
        number = {name: i for i, name in enumerate(names)}
        of = np.array([number[item] for item, _ in items], np.int64)
        first = np.cumsum([0, *(len(t) for _, t in items)])
        self.words = np.concatenate([np.zeros(0, np.uint64), *(t for _, t in items)])
        self.by_span, lists = [], {}
        for length, fps, text, starts, spans in item_parts(self.words, first, span):
            pairs = np.unique(np.rec.fromarrays([spans, of[text]], names="span,item"))
            known, begin = np.unique(pairs["span"], return_index=True)
            ids = [lists.setdefault(tuple(group.tolist()), len(lists)) for group in np.split(pairs["item"], begin[1:])]
            order = np.argsort(spans, kind="stable")
            example = starts[order][np.searchsorted(spans[order], known)]
            self.by_span.append((length, fps, known, example, np.array(ids, np.int64)))
        self.names = [[names[i] for i in group] for group in lists]


def among(values: np.ndarray, known: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Which values are in the sorted ``known``, and where."""
    if not len(known):
        return np.zeros(len(values), bool), np.zeros(len(values), np.int64)
    at = np.minimum(np.searchsorted(known, values), len(known) - 1)
    return known[at] == values, at


def search(w: np.ndarray, first: np.ndarray, index: Index) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Spans of consecutive texts that are spans of items: first word, word after the last, list of items."""
    starts, ends, items = [np.zeros(0, np.int64)], [np.zeros(0, np.int64)], [np.zeros(0, np.int64)]
    for length, fps, known, example, ids in index.by_span:
        pos, fp = winnow(w, first, length)
        begin = around(pos[among(fp, fps)[0]], first, length)
        found, at = among(span_hashes(w, begin, length), known)
        begin, at = begin[found], at[found]
        same = np.ones(len(begin), bool)
        for j in range(length):
            same &= w[begin + j] == index.words[example[at] + j]
        starts.append(begin[same])
        ends.append(begin[same] + length)
        items.append(ids[at[same]])
    return np.concatenate(starts), np.concatenate(ends), np.concatenate(items)


def _item_words(items: DataFrame, item_id: str, text: str) -> DataFrame:
    """(item, words): the word hashes of every item that has words."""
    def read(batches):
        for b in batches:
            for part, data, offs in slices(b, "text"):
                words = Words(data, offs, ALNUM)
                h = words.hashes()
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array([h[i:j].tobytes() for i, j in zip(words.first[:-1], words.first[1:], strict=True)], pa.binary())],
                                                 names=["item", "words"])

    rows = items.select(F.coalesce(F.col(item_id).cast("string"), F.lit("")).alias("item"), F.col(text).cast("string").alias("text"))
    return rows.mapInArrow(read, "item string, words binary").filter("length(words) > 0").distinct()


def find_contamination(docs: DataFrame, items: DataFrame, text: str = "text", item_id: str = "item_id", item_text: str = "text",
                       span: int = 13, result: str = "contamination", index_bytes: int = 64 << 20) -> DataFrame:
    """Add ``result``: words of the text, words inside any shared window, the word ranges they form,
    and the items that have a window in the text."""
    spark = docs.sparkSession
    ready(spark)
    df = docs.drop(result)
    schema = T.StructType(df.schema.fields + [T.StructField(result, RESULT)])
    bench = materialise(_item_words(items, item_id, item_text), "benchmark")
    # a word is one hash in the texts, and a fingerprint, a span and its place in the index: some five times as much
    if 5 * (bench.agg(F.sum(F.length("words"))).first()[0] or 0) <= index_bytes:
        index = Index([(r["item"], np.frombuffer(bytes(r["words"]), np.uint64)) for r in bench.collect()], span)
        return df.mapInArrow(_searcher(spark.sparkContext.broadcast(index), text, result), schema)
    return _joined(df, bench, text, span, result, schema)


def _searcher(sent, text: str, result: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        index = sent.value
        for batch in batches:
            for part, data, offs in slices(batch, text):
                words = Words(data, offs, ALNUM)
                starts, ends, lists = search(words.hashes(), words.first, index)
                named: dict[int, set[str]] = {}
                doc = np.searchsorted(words.first, starts, "right") - 1
                for d, i in set(zip(doc.tolist(), lists.tolist(), strict=True)):
                    named.setdefault(d, set()).update(index.names[i])
                yield pa.RecordBatch.from_arrays([*part.columns, _results(words.first, starts, ends, named)], names=[*part.schema.names, result])
    return run


def _results(first: np.ndarray, starts: np.ndarray, ends: np.ndarray, named: dict[int, set[str]]) -> pa.Array:
    n = int(first[-1])
    marks = np.zeros(n + 1, np.int64)
    np.add.at(marks, starts, 1)
    np.add.at(marks, ends, -1)
    hit = np.cumsum(marks[:n]) > 0
    sums = np.r_[0, np.cumsum(hit)]
    n_hit = sums[first[1:]] - sums[first[:-1]]
    out = [{"n_words": c, "n_hit": 0, "spans": [], "items": []} for c in np.diff(first).tolist()]
    for d in np.flatnonzero(n_hit).tolist():
        h = np.r_[False, hit[first[d]:first[d + 1]], False].astype(np.int8)
        edge = np.diff(h)
        out[d] = {"n_words": int(first[d + 1] - first[d]), "n_hit": int(n_hit[d]),
                  "spans": [{"start": int(s), "end": int(e)} for s, e in zip(np.flatnonzero(edge == 1), np.flatnonzero(edge == -1), strict=True)],
                  "items": sorted(named[d])}
    return pa.array(out, _ARROW)


# ---------------------------------------------------------------- a benchmark too large for the tasks

def _longs(a: np.ndarray) -> pa.Array:
    return pa.array(np.ascontiguousarray(a).view(np.int64))


def _bench_rows(span: int, what: str):
    """Fingerprints (length, hash) or spans (length, hash, item) of items."""
    def fn(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            texts = [np.frombuffer(w, np.uint64) for w in b.column(1).to_pylist()]
            words, first = np.concatenate([np.zeros(0, np.uint64), *texts]), np.cumsum([0, *map(len, texts)])
            for length, fps, text, _, spans in item_parts(words, first, span):
                hashes = fps if what == "prints" else spans
                columns = [pa.array(np.full(len(hashes), length, np.int32)), _longs(hashes)]
                if what == "spans":
                    columns.append(b.column(0).take(pa.array(text)))
                yield pa.RecordBatch.from_arrays(columns, names=["length", "hash", "item"][:len(columns)])
    return fn


def _doc_prints(text: str, sizes: list[int]):
    """Distinct fingerprints (key, length, hash) of texts."""
    def fn(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part, data, offs in slices(batch, text):
                words, keys = Words(data, offs, ALNUM), part.column(part.schema.get_field_index("__key")).to_numpy()
                w = words.hashes()
                for length in sizes:
                    pos, fp = winnow(w, words.first, length)
                    pairs = np.unique(np.rec.fromarrays([keys[np.searchsorted(words.first, pos, "right") - 1], fp], names="key,hash"))
                    yield pa.RecordBatch.from_arrays([_longs(pairs["key"]), pa.array(np.full(len(pairs), length, np.int32)), _longs(pairs["hash"])], names=["key", "length", "hash"])
    return fn


def _doc_spans(text: str):
    """Spans (key, length, hash, start) around the fingerprints that a row lists as shared."""
    def fn(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part, data, offs in slices(batch, text):
                words, keys = Words(data, offs, ALNUM), part.column(part.schema.get_field_index("__key")).to_numpy()
                w = words.hashes()
                shared = part.column(part.schema.get_field_index("__shared")).to_pylist()
                for length in sorted({x["length"] for row in shared for x in row}):
                    pos, fp = winnow(w, words.first, length)
                    doc = np.searchsorted(words.first, pos, "right") - 1
                    own = [np.array([x["hash"] for x in row if x["length"] == length], np.int64).view(np.uint64) for row in shared]
                    hit = np.zeros(len(pos), bool)
                    for d in range(len(own)):
                        a, z = np.searchsorted(doc, [d, d + 1])
                        hit[a:z] = among(fp[a:z], np.sort(own[d]))[0]
                    starts = around(pos[hit], words.first, length)
                    doc = np.searchsorted(words.first, starts, "right") - 1
                    yield pa.RecordBatch.from_arrays([pa.array(keys[doc]), pa.array(np.full(len(starts), length, np.int32)), _longs(span_hashes(w, starts, length)),
                                                      pa.array(starts - words.first[doc])], names=["key", "length", "hash", "start"])
    return fn


def _attach(text: str, result: str):
    def fn(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part, data, offs in slices(batch, text):
                first = Words(data, offs, ALNUM).first
                hits, items = (part.column(part.schema.get_field_index(c)).to_pylist() for c in ("__spans", "__items"))
                runs = [(first[d] + x["start"], first[d] + x["start"] + x["length"]) for d, row in enumerate(hits) for x in row or []]
                starts, ends = np.array(runs, np.int64).reshape(-1, 2).T
                found = _results(first, starts, ends, {d: set(row) for d, row in enumerate(items) if row})
                kept = [i for i, n in enumerate(part.schema.names) if n not in ("__spans", "__items")]
                yield pa.RecordBatch.from_arrays([*(part.column(i) for i in kept), found], names=[*(part.schema.names[i] for i in kept), result])
    return fn


def _joined(df: DataFrame, bench: DataFrame, text: str, span: int, result: str, schema: T.StructType) -> DataFrame:
    """The same results with the benchmark's fingerprints and spans as tables."""
    prints = materialise(bench.mapInArrow(_bench_rows(span, "prints"), "length int, hash long").distinct(), "benchmark-prints")
    spans = materialise(bench.mapInArrow(_bench_rows(span, "spans"), "length int, hash long, item string").distinct(), "benchmark-spans")
    sizes = sorted(r["length"] for r in prints.select("length").distinct().collect())  # at most ``span`` lengths
    keyed = materialise(df.withColumns({"__key": F.monotonically_increasing_id()}), "documents-keyed")
    own = keyed.select("__key", text).mapInArrow(_doc_prints(text, sizes), "key long, length int, hash long")
    shared = own.join(prints, ["length", "hash"], "left_semi").groupBy("key").agg(F.collect_list(F.struct("length", "hash")).alias("__shared"))
    near = keyed.select("__key", text).join(materialise(shared, "documents-shared"), F.col("__key") == F.col("key")).drop("key")
    cuts = materialise(near.mapInArrow(_doc_spans(text), "key long, length int, hash long, start long"), "documents-spans")
    hit = materialise(cuts.join(spans.select("length", "hash").distinct(), ["length", "hash"], "left_semi"), "documents-hits")
    named = hit.select("key", "length", "hash").distinct().join(spans, ["length", "hash"]).groupBy("key").agg(F.collect_set("item").alias("__items"))
    places = hit.groupBy("key").agg(F.collect_list(F.struct("start", "length")).alias("__spans"))
    both = materialise(places.join(named, "key"), "documents-runs")
    out = keyed.join(both, F.col("__key") == F.col("key"), "left").select(*df.columns, "__spans", "__items")
    return out.mapInArrow(_attach(text, result), schema)


def is_contaminated(n_words, n_hit):
    """Some word is hit, and hit words are at least a twentieth of the words."""
    return (n_hit > 0) & (20 * n_hit >= n_words)
