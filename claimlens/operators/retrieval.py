"""Text retrieval as Spark jobs.

Sparse search (TF-IDF cosine, top-k per claim)
----------------------------------------------
* Corpus side (the chunk table): tokens -> stop words removed -> 1..n-grams ->
  term counts -> vocabulary (top ``max_features`` terms by total count, ties by
  term; a bounded table) -> smoothed idf ``ln((1+n)/(1+df)) + 1`` -> L2-normalised
  weights.  The corpus vectors are checkpointed into the shared checkpoint folder.
* Both sides: the texts meet by id **once**; after that tokenising, n-grams, term counts,
  weights and norms are worked out inside the row (Arrow batches, the capped vocabulary is sent to the tasks),
  and the search follows in the same task - no row per term occurrence or per matching (claim, chunk) pair
  is ever made, only k rows per claim leave the search.
* The search reads impact-ordered postings with upper bounds per term (``Postings``), so
  frequent terms are mostly skipped.  A corpus whose measured vectors are at most
  ``INDEX_BYTES`` is sent to the tasks; a larger one meets the claims block against block.

Dense search
------------
Exact inner-product / L2 top-k of every vector against query blocks of bounded bytes:
Arrow batches of vectors are scored against the block in NumPy, and a task keeps a
running top-k per query, so partitions x queries x k rows reach the shuffle.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence
from dataclasses import dataclass, field

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.ml.feature import StopWordsRemover
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_type

from claimlens.functions.stats import prefix_sums
from claimlens.functions.text import TOKEN, english_stop_words
from claimlens.session import materialize, ship_package, small_batches

SCORE_DIGITS = 6


@dataclass
class TfidfParams:
    max_features: int | None = 5000
    ngram: tuple[int, int] = (1, 2)
    stop_words: list[str] | None = field(default_factory=english_stop_words)
    min_df: float = 1
    max_df: float = 1.0


def terms(df: DataFrame, id_col: str, text: str, p: TfidfParams) -> DataFrame:
    """Exploded analyser output ``(id, term)``: lower-cased tokens of 2+ word characters,
    stop words removed, then n-grams of the remaining tokens joined by a space."""
    tok = df.select(id_col, F.regexp_extract_all(F.lower(F.coalesce(F.col(text), F.lit(""))), F.lit(TOKEN), 0).alias("_tok"))
    if p.stop_words:
        tok = StopWordsRemover(inputCol="_tok", outputCol="_kept", stopWords=list(p.stop_words),
                               caseSensitive=False).transform(tok).select(id_col, F.col("_kept").alias("_tok"))
    return tok.select(id_col, F.explode(_grams(F.col("_tok"), p)).alias("term"))


def _grams(tok: Column, p: TfidfParams) -> Column:
    """All n-grams of an array of tokens."""
    grams = []
    lo, hi = p.ngram
    for n in range(lo, hi + 1):
        if n == 1:
            grams.append(tok)
        elif n == 2:
            # adjacent pairs: zip the token array with itself shifted by one
            m = F.size(tok) - 1
            grams.append(F.when(m > 0, F.zip_with(F.slice(tok, 1, F.greatest(m, F.lit(1))),
                                                  F.slice(tok, 2, F.greatest(m, F.lit(1))),
                                                  lambda a, b: F.concat(a, F.lit(" "), b)))
                         .otherwise(F.array().cast("array<string>")))
        else:
            k = F.size(tok) - n + 1
            grams.append(F.when(k > 0, F.transform(
                F.sequence(F.lit(1), F.greatest(k, F.lit(1))),
                lambda i: F.array_join(F.slice(tok, i, n), " "))).otherwise(F.array().cast("array<string>")))
    return grams[0] if len(grams) == 1 else F.concat(*grams)


def split_texts(texts: str) -> Column:
    """The tokens of each text of an array."""
    return F.transform(texts, lambda t: F.regexp_extract_all(F.lower(t), F.lit(TOKEN), 0))


def _tokens(df: DataFrame, id_col: str, text: str, *more: str) -> DataFrame:
    """(id, tokens of each text of the id, further columns): the texts of a repeated id meet, null is empty."""
    texts = df.groupBy(id_col, *more).agg(F.collect_list(F.coalesce(F.col(text), F.lit(""))).alias("_texts"))
    return texts.select(id_col, *more, split_texts("_texts").alias("_toks"))


def _words(rows: pa.ListArray, p: TfidfParams) -> tuple[pa.Array, np.ndarray, np.ndarray, np.ndarray]:
    """(distinct words, their numbers word by word, text of each word, row of each text) of an Arrow batch of texts' tokens, without stop words."""
    texts = rows.flatten()
    words = texts.flatten().dictionary_encode()
    names, code = words.dictionary, words.indices.to_numpy(zero_copy_only=False).astype(np.int64)
    of = pc.list_parent_indices(texts).to_numpy(zero_copy_only=False).astype(np.int64)
    if p.stop_words:
        kept = ~pc.is_in(names, value_set=pa.array([w.lower() for w in p.stop_words], names.type)).to_numpy(zero_copy_only=False)[code]
        code, of = code[kept], of[kept]
    row = pc.list_parent_indices(rows).to_numpy(zero_copy_only=False).astype(np.int64)
    return names, code, of, row


def _row_grams(rows: pa.ListArray, p: TfidfParams) -> Iterator[tuple[np.ndarray, np.ndarray, pa.Array]]:
    """For each n of ``p.ngram``: (row of every n-gram, its place among the strings, the strings) of the texts' tokens of an Arrow batch."""
    names, code, of, row = _words(rows, p)
    at, gram, strings = np.arange(len(code)), code, names
    for n in range(1, p.ngram[1] + 1):
        if n > 1:
            inside = np.flatnonzero(at + n - 1 < len(code))
            inside = inside[of[at[inside] + n - 1] == of[at[inside]]]
            at = at[inside]
            pair, gram = np.unique(gram[inside] * max(len(names), 1) + code[at + n - 1], return_inverse=True)
            strings = pc.binary_join_element_wise(strings.take(pa.array(pair // max(len(names), 1))), names.take(pa.array(pair % max(len(names), 1))), " ")
        if n >= p.ngram[0]:
            yield row[of[at]], gram, strings


#: Buckets over which n-grams of several words are spread by hash.
BUCKETS = 1 << 20


def _hashed_grams(names: pa.Array, code: np.ndarray, of: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
    """(place of the first word, bucket) of every n-gram of n words."""
    h = pd.util.hash_array(np.asarray(names.to_pylist(), object)) if len(names) else np.zeros(0, np.uint64)
    at = np.arange(max(len(code) - n + 1, 0))
    at = at[of[at + n - 1] == of[at]]
    mix = np.zeros(len(at), np.uint64)
    for j in range(n):
        mix = (mix ^ h[code[at + j]]) * np.uint64(0x9E3779B97F4A7C15)
    return at, (mix >> np.uint64(44)).astype(np.int64)


def _marked_grams(rows: pa.ListArray, p: TfidfParams, marks: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray, pa.Array]]:
    """``_row_grams``, of several words those in a marked bucket only: all others are left out before they become strings."""
    names, code, of, row = _words(rows, p)
    if p.ngram[0] == 1:
        yield row[of], code, names
    for n in range(max(p.ngram[0], 2), p.ngram[1] + 1):
        at, bucket = _hashed_grams(names, code, of, n)
        at = at[marks[bucket]]
        gram, strings = code[at], names
        for j in range(1, n):
            pair, gram = np.unique(gram * max(len(names), 1) + code[at + j], return_inverse=True)
            strings = pc.binary_join_element_wise(strings.take(pa.array(pair // max(len(names), 1))), names.take(pa.array(pair % max(len(names), 1))), " ")
        yield row[of[at]], gram, strings


def _counted(row: np.ndarray, gram: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(row, gram, count) of the distinct pairs, by row and gram."""
    pair, count = np.unique(row * max(n, 1) + gram, return_counts=True)
    return pair // max(n, 1), pair % max(n, 1), count


#: Rows of partial term sums that a task holds before it adds them up, and above which it hands them on.
HELD = 1 << 20


def term_frequencies(df: DataFrame, id_col: str, text: str, p: TfidfParams) -> DataFrame:
    """(term, df, total): rows (ids) that hold a term, and its occurrences.  Tasks send sums per term, no row per (id, term)."""
    ship_package(df.sparkSession)
    small_batches(df.sparkSession)

    def added(parts: list[pa.Table]) -> pa.Table:
        t = pa.concat_tables(parts).group_by("term", use_threads=False).aggregate([("df", "sum"), ("total", "sum")])
        return t.select(["term", "df_sum", "total_sum"]).rename_columns(["term", "df", "total"])

    def fn(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        parts, held = [], 0
        for b in batches:
            for row, gram, strings in _row_grams(b.column(0), p):
                _, g, count = _counted(row, gram, len(strings))
                seen = np.bincount(g, minlength=len(strings))
                total = np.bincount(g, count, minlength=len(strings)).astype(np.int64)
                at = np.flatnonzero(seen)
                parts.append(pa.table({"term": strings.take(pa.array(at)), "df": pa.array(seen[at], pa.int64()), "total": pa.array(total[at])}))
                held += len(at)
            if held > HELD:
                parts = [added(parts)]
                held = parts[0].num_rows
                if held > HELD // 2:
                    yield from parts[0].combine_chunks().to_batches(max_chunksize=10_000)
                    parts, held = [], 0
        if parts:
            yield from added(parts).combine_chunks().to_batches(max_chunksize=10_000)

    sums = _tokens(df, id_col, text).select("_toks").mapInArrow(fn, "term string, df long, total long")
    return sums.groupBy("term").agg(F.sum("df").alias("df"), F.sum("total").alias("total"))


def term_counts(df: DataFrame, id_col: str, text: str, p: TfidfParams) -> DataFrame:
    """Term counts ``(id, counts array<struct<term, tf>>)``, terms ascending, one row an id (the texts of a repeated id together).

    The texts meet by id; terms are counted inside the row, so that no row per occurrence is aggregated.
    """
    ship_package(df.sparkSession)
    small_batches(df.sparkSession)
    toks = _tokens(df, id_col, text)

    def fn(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            found = [(row, gram, strings) for row, gram, strings in _row_grams(b.column(1), p)]
            strings = pa.concat_arrays([s for _, _, s in found])
            order = pc.sort_indices(strings).to_numpy()
            place = np.empty(len(order), np.int64)
            place[order] = np.arange(len(order))
            first = np.cumsum([0, *(len(s) for _, _, s in found)])
            row, gram, count = _counted(np.concatenate([r for r, _, _ in found]), place[np.concatenate([g + a for (_, g, _), a in zip(found, first, strict=False)])], len(strings))
            starts = pa.array(np.r_[0, np.cumsum(np.bincount(row, minlength=b.num_rows))], pa.int32())
            pairs = pa.StructArray.from_arrays([strings.take(pa.array(order[gram])), pa.array(count, pa.int64())], names=["term", "tf"])
            yield pa.RecordBatch.from_arrays([b.column(0), pa.ListArray.from_arrays(starts, pairs)], names=[id_col, "counts"])

    pair = T.StructType([T.StructField("term", T.StringType()), T.StructField("tf", T.LongType())])
    return toks.mapInArrow(fn, T.StructType([toks.schema[id_col], T.StructField("counts", T.ArrayType(pair))]))


def row_vectors(df: DataFrame, id_col: str, text: str, vocab: DataFrame, p: TfidfParams) -> DataFrame:
    """L2-normalised TF-IDF vectors ``(id, terms, weights)``, one row an id that holds a term of ``vocab`` (term, idf, place; at most
    ``max_features`` rows, sent to the tasks); ``terms`` are the ascending places."""
    ship_package(df.sparkSession)
    small_batches(df.sparkSession)
    known = vocab.orderBy("place").toArrow()
    names, idf = known.column("term").combine_chunks(), known.column("idf").to_numpy()
    number = known.column("place").to_numpy().astype(np.int32)
    toks = _tokens(df, id_col, text)

    def fn(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            rows, places = [np.zeros(0, np.int64)], [np.zeros(0, np.int64)]
            for row, gram, strings in _row_grams(b.column(1), p):
                place = pc.fill_null(pc.index_in(strings.cast(names.type), value_set=names), -1).to_numpy(zero_copy_only=False).astype(np.int64)[gram]
                rows.append(row[place >= 0])
                places.append(place[place >= 0])
            row, place, count = _counted(np.concatenate(rows), np.concatenate(places), len(names))
            w = count * idf[place]
            norm = np.sqrt(np.bincount(row, w * w, minlength=b.num_rows))
            here = np.flatnonzero(norm > 0)
            starts = pa.array(np.r_[0, np.cumsum(np.bincount(row, minlength=b.num_rows)[here])], pa.int32())
            yield pa.RecordBatch.from_arrays([b.column(0).take(pa.array(here)), pa.ListArray.from_arrays(starts, pa.array(number[place], pa.int32())),
                                              pa.ListArray.from_arrays(starts, pa.array(w / norm[row], pa.float64()))], names=[id_col, "terms", "weights"])

    return toks.mapInArrow(fn, T.StructType([toks.schema[id_col], T.StructField("terms", T.ArrayType(T.IntegerType())),
                                             T.StructField("weights", T.ArrayType(T.DoubleType()))]))


def fit_idf(corpus: DataFrame, id_col: str, text: str, p: TfidfParams) -> DataFrame:
    """Vocabulary with smoothed idf: ``(term, idf)``, at most ``max_features`` rows."""
    tf = terms(corpus, id_col, text, p).groupBy(id_col, "term").agg(F.count(F.lit(1)).alias("tf"))
    return vocabulary(tf, corpus.agg(F.count(F.lit(1)).alias("_n")), id_col, p)


def vocabulary(tf: DataFrame, n_docs: DataFrame, id_col: str, p: TfidfParams) -> DataFrame:
    """Vocabulary from term counts ``(id, term, tf)``: document-frequency filters, then the top
    ``max_features`` terms by total count (ties by term), with idf ``ln((1+n)/(1+df)) + 1``."""
    return _chosen(tf.groupBy("term").agg(F.count(F.lit(1)).alias("df"), F.sum("tf").alias("total")), n_docs, p)


def _chosen(st: DataFrame, n_docs: DataFrame, p: TfidfParams) -> DataFrame:
    """The vocabulary from ``(term, df, total)``."""
    st = st.crossJoin(F.broadcast(n_docs))
    max_dc = F.lit(p.max_df) if isinstance(p.max_df, int) and p.max_df > 1 else F.col("_n") * p.max_df
    min_dc = F.lit(p.min_df) if isinstance(p.min_df, int) or p.min_df > 1 else F.col("_n") * p.min_df
    st = st.where((F.col("df") <= max_dc) & (F.col("df") >= min_dc))
    if p.max_features:
        st = st.orderBy(F.desc("total"), F.asc("term")).limit(p.max_features)
    return st.select("term", (F.log((1 + F.col("_n")) / (1 + F.col("df"))) + 1).alias("idf"))


def _weights(tf: DataFrame, id_col: str) -> DataFrame:
    w = Window.partitionBy(id_col)
    norm = F.sqrt(F.sum(F.col("w") * F.col("w")).over(w))
    return tf.withColumn("w", F.try_divide(F.col("w"), norm)).where(F.col("w").isNotNull())


def vectorize(df: DataFrame, id_col: str, text: str, vocab: DataFrame, p: TfidfParams) -> DataFrame:
    """L2-normalised TF-IDF rows ``(id, term, w)`` over the vocabulary (out-of-vocabulary terms dropped); further
    columns of ``vocab`` are carried.

    ``vocab`` has at most ``max_features`` rows, so it is broadcast.
    """
    vb = F.broadcast(vocab) if p.max_features else vocab  # hint only when capped by max_features
    t = terms(df, id_col, text, p).join(vb, "term")
    tf = t.groupBy(id_col, *vocab.columns).agg(F.count(F.lit(1)).alias("tf"))
    kept = [c for c in vocab.columns if c != "idf"]
    return _weights(tf.select(id_col, *kept, (F.col("tf") * F.col("idf")).alias("w")), id_col)


def _numbered(vocab: DataFrame, p: TfidfParams) -> DataFrame:
    """The vocabulary written once, with each term's ``place``."""
    numbered = prefix_sums(vocab.withColumn("_one", F.lit(1)), "term", ["_one"]) if not p.max_features else \
        vocab.withColumn("cum__one", F.row_number().over(Window.orderBy("term")))  # at most max_features rows
    return materialize(numbered.select("term", "idf", F.col("cum__one").cast("int").alias("place")))


def corpus_vectors(chunks: DataFrame, p: TfidfParams, id_col: str = "chunk_uid", text: str = "text",
                   partitions: int | None = None):
    """Fit the vocabulary on the corpus and vectorise it; returns ``(vocab, vectors)`` with vectors ``(id, term, w)``.

    The terms are counted inside the rows (``term_frequencies``, ``row_vectors``).  Only a vocabulary without limit, which cannot be sent
    to the tasks, takes a row per (id, term): the corpus is then hash-partitioned by id once.
    """
    n_docs = chunks.agg(F.count(F.lit(1)).alias("_n"))
    if p.max_features:
        vocab = _numbered(_chosen(term_frequencies(chunks, id_col, text, p), n_docs, p), p)
        entry = row_vectors(chunks, id_col, text, vocab, p).select(id_col, F.explode(F.arrays_zip("terms", "weights")).alias("e"))
        vectors = entry.select(id_col, F.col("e.terms").alias("place"), F.col("e.weights").alias("w")).join(F.broadcast(vocab.drop("idf")), "place")
        return vocab.drop("place"), vectors.select(id_col, "term", "w")
    docs = chunks.select(id_col, text)
    docs = docs.repartition(partitions, id_col) if partitions else docs.repartition(id_col)
    tf = terms(docs, id_col, text, p).groupBy(id_col, "term").agg(F.count(F.lit(1)).alias("tf"))
    vocab = vocabulary(tf, n_docs, id_col, p)
    w = tf.join(vocab, "term").select(id_col, "term", (F.col("tf") * F.col("idf")).alias("w"))
    return vocab, _weights(w, id_col)


# ---------------------------------------------------------------- sparse top-k
#: Bytes of corpus vectors that are sent to every task; a larger corpus is searched block against block.
INDEX_BYTES = 64 << 20
#: Bytes of vectors in a block of either side.
BLOCK_BYTES = 8 << 20
#: Bytes up to which a corpus is scored as a dense matrix.
DENSE_BYTES = 32 << 20
#: Bytes of one weight of a vector: a place and a double.
ENTRY = 12


class Postings:
    """Vectors by term, in order of impact, and by row.

    ``search`` finds the rows of highest inner product with a query without scoring every row that shares a term: terms are taken by
    falling upper bound (query weight x greatest weight of the term).  A row not met yet can still reach the k-th
    best lower bound only through the head of a term's list, so only heads bring new rows; rows met whose sum and all that is left
    stay below that bound are dropped, and the search ends when the terms left bring no new row and few rows remain.  Those are
    then scored exactly.
    """

    def __init__(self, ids: Sequence, terms: list[np.ndarray], weights: list[np.ndarray]):
        self.ids = list(ids)
        self.first = np.cumsum([0, *(len(t) for t in terms)])
        term = np.concatenate([np.zeros(0, np.int64), *terms]).astype(np.int64)
        weight = np.concatenate([np.zeros(0), *weights])
        row = np.repeat(np.arange(len(self.ids)), np.diff(self.first))
        inside = np.lexsort((term, row))
        self.term, self.weight = term[inside], weight[inside]
        by = np.lexsort((row, -weight, term))
        self.rows, self.impact = row[by], weight[by]
        self.known, self.start = np.unique(term[by], return_index=True)
        self.end = np.r_[self.start[1:], len(by)]
        self.dense = None

    def scores(self, terms: np.ndarray, weights: np.ndarray) -> np.ndarray | None:
        """Exact scores of all rows, where rows x terms are few enough to be held dense (``DENSE_BYTES``); else nothing."""
        if 8 * len(self.ids) * len(self.known) > DENSE_BYTES:
            return None
        if self.dense is None:
            self.dense = np.zeros((len(self.known), len(self.ids)))
            self.dense[np.repeat(np.arange(len(self.known)), self.end - self.start), self.rows] = self.impact
        at = np.minimum(np.searchsorted(self.known, terms), max(len(self.known) - 1, 0))
        held = self.known[at] == terms if len(self.known) else np.zeros(len(terms), bool)
        return weights[held] @ self.dense[at[held]]

    def sharing(self, terms: np.ndarray) -> int:
        """Rows that share a term."""
        at = np.searchsorted(self.known, terms)
        held = [self.rows[self.start[i]:self.end[i]] for i, t in zip(at.tolist(), terms.tolist(), strict=True) if i < len(self.known) and self.known[i] == t]
        return len(np.unique(np.concatenate([np.zeros(0, np.int64), *held])))

    def search(self, terms: np.ndarray, weights: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
        """Candidate rows and their exact scores: all that may be among the k best by rounded score."""
        slack = 2 * 10.0 ** -SCORE_DIGITS
        at = np.minimum(np.searchsorted(self.known, terms), max(len(self.known) - 1, 0))
        held = self.known[at] == terms if len(self.known) else np.zeros(len(terms), bool)
        at, w = at[held], weights[held]
        bound = w * self.impact[self.start[at]] if len(at) else w
        order = np.argsort(-bound, kind="stable")
        left = np.cumsum(bound[order][::-1])[::-1]
        partial, seen = np.zeros(len(self.ids)), np.zeros(len(self.ids), bool)
        met, least = np.zeros(0, np.int64), 0.0
        for n, i in enumerate(order.tolist()):
            after = left[n + 1] if n + 1 < len(order) else 0.0
            if left[n] < least - slack and not len(met) > 4 * k:
                break
            a, z = self.start[at[i]], self.end[at[i]]
            partial[self.rows[a:z]] += w[i] * self.impact[a:z]
            # impacts fall: only the head, where weight x impact + what is left reaches the k-th best, brings new rows
            head = a + int(np.searchsorted(-self.impact[a:z], -(least - slack - after) / w[i], "right")) if w[i] > 0 and least > 0 else z
            rows = self.rows[a:head]
            met = np.concatenate([met, rows[~seen[rows]]])
            seen[rows] = True
            if len(met) >= k:
                least = max(least, float(np.partition(partial[met], len(met) - k)[len(met) - k]))
                met = met[partial[met] + after >= least - slack]
        if not len(met):
            return met, np.zeros(0)
        met = np.sort(met)
        size = self.first[met + 1] - self.first[met]
        entry = np.repeat(self.first[met] - np.r_[0, np.cumsum(size)[:-1]], size) + np.arange(size.sum())
        by = np.argsort(terms, kind="stable")
        place = np.minimum(np.searchsorted(terms[by], self.term[entry]), len(terms) - 1)
        dots = np.where(terms[by][place] == self.term[entry], weights[by][place] * self.weight[entry], 0.0)
        return met, np.add.reduceat(dots, np.r_[0, np.cumsum(size)[:-1]])


def _sparse(df: DataFrame, id_col: str) -> DataFrame:
    """Vectors as rows: (id, terms, weights)."""
    rows = df.groupBy(id_col).agg(F.sort_array(F.collect_list(F.struct("place", "w"))).alias("v"))
    return rows.select(id_col, F.col("v.place").alias("terms"), F.col("v.w").alias("weights"))


def _lists(column) -> list[np.ndarray]:
    column = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    flat, at = column.flatten().to_numpy(zero_copy_only=False), column.offsets.to_numpy()
    return np.split(flat, at[1:-1] - at[0]) if len(column) else []


def _hits(index: Postings, names: list, terms: list[np.ndarray], weights: list[np.ndarray], k: int, types: tuple[pa.DataType, pa.DataType], work: bool = False) -> pa.Table:
    """The best k rows of each query; ``work`` counts the rows that share a term with it, too (else null)."""
    out = []
    for name, t, w in zip(names, terms, weights, strict=True):
        score = None if work else index.scores(t, w)
        if score is None:
            rows, score = index.search(t, w, k)
        else:
            rows = np.flatnonzero(score > 0)
            score = score[rows]
        score = _round_half_up(score)
        if len(score) > k:  # rows below the k-th score cannot be among the best; ties stay until sorted by id
            near = np.flatnonzero(score >= np.partition(score, len(score) - k)[len(score) - k])
        else:
            near = np.arange(len(score))
        best = sorted(zip((-score[near]).tolist(), [index.ids[r] for r in rows[near]], strict=True))[:k]
        sharing = index.sharing(t) if work and best else None
        out += [(name, one, -s, len(rows), sharing) for s, one in best if s < 0]
    columns = list(zip(*out, strict=True)) or [[]] * 5
    kinds = (*types, pa.float64(), pa.int64(), pa.int64())
    return pa.table({n: pa.array(list(c), t) for n, c, t in zip(("_q", "_cid", "score", "scored", "sharing"), columns, kinds, strict=True)})


def search_hits(queries: DataFrame, q_id: str, q_text: str, chunks: DataFrame, k: int, p: TfidfParams, chunk_id: str, chunk_text: str,
                partitions: int | None = None, index_bytes: int = INDEX_BYTES, block_bytes: int = BLOCK_BYTES, work: bool = False) -> DataFrame:
    """The best k chunks of every query in every block of the corpus: (_q, _cid, score, scored, sharing); ``sharing`` is counted for ``work``."""
    ship_package(queries.sparkSession)
    c = chunks.select(F.col(chunk_id).alias("_cid"), F.col(chunk_text).alias("_ct"))
    q = queries.select(F.col(q_id).alias("_q"), q_text)
    if p.max_features:
        vocab = _numbered(_chosen(term_frequencies(c, "_cid", "_ct", p), c.agg(F.count(F.lit(1)).alias("_n")), p), p)
        corpus = materialize(row_vectors(c, "_cid", "_ct", vocab, p))
        asked = row_vectors(q, "_q", q_text, vocab, p)
    else:
        vocab, cvec = corpus_vectors(c, p, "_cid", "_ct")
        vocab = _numbered(vocab, p)
        corpus = materialize(_sparse(cvec.join(vocab.drop("idf"), "term"), "_cid"))
        q = q.repartition(partitions, "_q") if partitions else q.repartition("_q")
        asked = _sparse(vectorize(q, "_q", q_text, vocab, p), "_q")
    schema = T.StructType([asked.schema["_q"], corpus.schema["_cid"], T.StructField("score", T.DoubleType()),
                           T.StructField("scored", T.LongType()), T.StructField("sharing", T.LongType())])
    types = tuple(to_arrow_type(schema[i].dataType) for i in (0, 1))
    size = ENTRY * (corpus.agg(F.sum(F.size("terms"))).first()[0] or 0)
    if size <= index_bytes:
        rows = corpus.toArrow()  # at most index_bytes
        sent = queries.sparkSession.sparkContext.broadcast(Postings(rows.column(0).to_pylist(), _lists(rows.column(1)), _lists(rows.column(2))))

        def run(batches):
            for b in batches:
                yield from _hits(sent.value, b.column(0).to_pylist(), _lists(b.column(1)), _lists(b.column(2)), k, types, work).to_batches()

        return asked.mapInArrow(run, schema)
    asked = materialize(asked)
    cuts = -(-size // block_bytes)
    sides = max(1, -(-ENTRY * (asked.agg(F.sum(F.size("terms"))).first()[0] or 0) // block_bytes))
    block = lambda c, n, salt: F.pmod(F.xxhash64(c, F.lit(salt)), F.lit(n)).cast("int")
    every = lambda n: F.explode(F.sequence(F.lit(0), F.lit(n - 1)))
    left = asked.select("*", block("_q", sides, 1).alias("qb")).select("*", every(cuts).alias("cb"))
    right = corpus.select("_cid", F.col("terms").alias("ct"), F.col("weights").alias("cw"), block("_cid", cuts, 2).alias("dcb")).select("*", every(sides).alias("dqb"))

    def pair(a: pa.Table, c: pa.Table) -> pa.Table:
        if not a.num_rows or not c.num_rows:
            return _hits(Postings([], [], []), [], [], [], k, types)
        index = Postings(c.column("_cid").to_pylist(), _lists(c.column("ct")), _lists(c.column("cw")))
        return _hits(index, a.column("_q").to_pylist(), _lists(a.column("terms")), _lists(a.column("weights")), k, types, work)

    return left.groupBy("qb", "cb").cogroup(right.groupBy("dqb", "dcb")).applyInArrow(pair, schema)


def search_topk(queries: DataFrame, q_id: str, q_text: str, chunks: DataFrame, k: int = 5,
                p: TfidfParams | None = None, chunk_id: str = "chunk_uid", chunk_text: str = "text",
                partitions: int | None = None, **sizes) -> DataFrame:
    """G5 + F1: cosine top-k hits ``(q_id, chunk_uid, score, rank)``; hits with score <= 0 dropped."""
    found = search_hits(queries, q_id, q_text, chunks, k, p or TfidfParams(), chunk_id, chunk_text, partitions, **sizes)
    w = Window.partitionBy("_q").orderBy(F.desc("score"), F.asc("_cid"))
    return (found.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= k)
            .select(F.col("_q").alias(q_id), F.col("_cid").alias(chunk_id), "score", "rank"))


def search_pairs(queries: DataFrame, q_id: str, q_text: str, chunks: DataFrame, k: int = 5, p: TfidfParams | None = None,
                 chunk_id: str = "chunk_uid", chunk_text: str = "text", **sizes) -> DataFrame:
    """Work of the search per query with a hit: chunks scored, and chunks that share a term with it."""
    found = search_hits(queries, q_id, q_text, chunks, k, p or TfidfParams(), chunk_id, chunk_text, work=True, **sizes)
    cells = found.select("_q", "scored", "sharing", F.row_number().over(Window.partitionBy("_q").orderBy(F.desc("score"), "_cid")).alias("rank"))
    return cells.where(F.col("rank") == 1).select(F.col("_q").alias(q_id), "scored", "sharing")


def term_weights(vectors: DataFrame, k: int = 20) -> DataFrame:
    """Total TF-IDF weight per term over a corpus, top k."""
    return (vectors.groupBy("term").agg(F.round(F.sum("w"), SCORE_DIGITS).alias("weight"))
            .orderBy(F.desc("weight"), F.asc("term")).limit(k))


# ---------------------------------------------------------------- dense search
def centroids(vectors: DataFrame, key: str, vec: str = "embedding") -> DataFrame:
    """Mean vector per key: ``(key, centroid array<double>)`` (dimension-wise average)."""
    ex = vectors.select(key, F.posexplode(F.col(vec).cast("array<double>")).alias("i", "x"))
    g = ex.groupBy(key, "i").agg(F.avg("x").alias("x"))
    return g.groupBy(key).agg(F.transform(F.array_sort(F.collect_list(F.struct("i", "x"))),
                                          lambda s: s["x"]).alias("centroid"))


def dense_topk(vectors: DataFrame, v_id: str, queries: DataFrame, q_id: str, q_vec: str,
               k: int = 5, metric: str = "ip", vec: str = "embedding", block_bytes: int = 64 << 20) -> DataFrame:
    """Exact top-k of ``vectors`` for each query vector: ``(q_id, v_id, score, rank)``.

    ``metric='ip'``: inner product, higher is better (G6); ``'l2'``: distance, lower is better (G7);
    equal scores (rounded) go by id.  Queries are sent to the tasks in blocks of at most
    ``block_bytes``, found with a running total of their bytes; a task keeps the best k vectors of each
    query over all its batches, so it emits k rows a query and no row per pair.  NULL vectors and ids,
    and vectors with a NULL or NaN in them, are left out.
    """
    q = materialize(queries.where(F.col(q_vec).isNotNull() & F.col(q_id).isNotNull()).select(
        F.col(q_id).alias("_q"), F.col(q_vec).cast("array<double>").alias("_qv")))
    width, n = q.agg(F.coalesce(F.max(F.size("_qv")), F.lit(1)), F.count(F.lit(1))).first()
    v = vectors.where(F.col(vec).isNotNull() & F.col(v_id).isNotNull()).select(
        F.col(v_id).alias("_v"), F.col(vec).cast("array<double>").alias("_vv"))
    size = max(1, block_bytes // (8 * max(width, 1)))
    if n <= size:
        blocks = [q]
    else:  # blocks of exactly bounded size: the global rank of a query names its block
        ranked = materialize(prefix_sums(q.withColumns({"_key": F.col("_q"), "_one": F.lit(1)}), "_key", ["_one"]))
        blocks = [ranked.where(F.expr(f"(cum__one - 1) div {size}") == i) for i in range(-(-n // size))]
    schema = T.StructType([T.StructField("_q", q.schema["_q"].dataType), T.StructField("_v", v.schema["_v"].dataType),
                           T.StructField("score", T.DoubleType())])
    ship_package(q.sparkSession)
    best = None
    for block in blocks:
        rows = block.select("_q", "_qv").collect()  # at most block_bytes of vectors
        sent = q.sparkSession.sparkContext.broadcast(([r[0] for r in rows], np.array([r[1] for r in rows], float).reshape(len(rows), -1)))
        part = v.mapInArrow(_best_of_task(sent, k, metric, to_arrow_type(schema[0].dataType)), schema)
        best = part if best is None else best.unionByName(part)
    w = Window.partitionBy("_q").orderBy(F.desc("score") if metric == "ip" else F.asc("score"), F.asc("_v"))
    return (best.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= k)
            .select(F.col("_q").alias(q_id), F.col("_v").alias(v_id), "score", "rank"))


def _best_of_task(sent, k: int, metric: str, query_type: pa.DataType):
    """A function over Arrow batches of vectors that yields each query's best k of the task."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names, queries = sent.value
        kept = [(np.empty(0), []) for _ in names]  # keys (lower is better) and ids
        for batch in batches:
            if not batch.num_rows or not names:
                continue
            ids, id_type = batch.column(0), batch.column(0).type
            x = batch.column(1).flatten().to_numpy(zero_copy_only=False).reshape(batch.num_rows, -1)
            for i, query in enumerate(queries):
                raw = x @ query if metric == "ip" else np.sqrt(((x - query) ** 2).sum(axis=1))
                key = _round_half_up(-raw if metric == "ip" else raw)
                old, old_ids = kept[i]
                # rows beyond the k-th key of the batch cannot be among the best; ties stay until sorted by id
                limit = np.partition(key, k - 1)[k - 1] if len(key) > k else np.inf
                at = np.flatnonzero(key <= limit)
                pool = sorted([*zip(old, old_ids), *zip(key[at], ids.take(pa.array(at)).to_pylist())])[:k]
                kept[i] = (np.array([p[0] for p in pool]), [p[1] for p in pool])
        out = [(name, one, key) for name, (keys, best) in zip(names, kept) for key, one in zip(keys, best)]
        if out:
            score = np.array([o[2] for o in out]) * (-1 if metric == "ip" else 1)
            yield pa.RecordBatch.from_arrays([pa.array([o[0] for o in out], query_type), pa.array([o[1] for o in out], id_type), pa.array(score + 0.0)],
                                             names=["_q", "_v", "score"])
    return run


def _round_half_up(x: np.ndarray) -> np.ndarray:
    """Scores to ``SCORE_DIGITS`` decimals, halves away from zero as in SQL."""
    scale = 10.0 ** SCORE_DIGITS
    return np.sign(x) * np.floor(np.abs(x) * scale + 0.5) / scale


# ---------------------------------------------------------------- hit post-processing (G9-G14, H3/H10 inputs)
def context(hits: DataFrame, chunks: DataFrame, q_id: str, chunk_id: str = "chunk_uid",
            text: str = "text") -> DataFrame:
    """G9: 'Document {rank} (Score: {s:.3f}):\\n{text}' joined by blank lines in rank order (k rows per claim)."""
    j = hits.join(chunks.select(chunk_id, text), chunk_id)
    # the score printed with 3 decimals, half-up on its 6-decimal value (integer arithmetic: engine independent)
    t = ((F.round(F.col("score") * 1_000_000).cast("bigint") + 500) / 1000).cast("bigint")
    s3 = F.format_string("%d.%03d", (t / 1000).cast("bigint"), t % 1000)
    part = F.struct("rank", F.format_string("Document %d (Score: %s):\n%s", "rank", s3, text).alias("s"))
    return j.groupBy(q_id).agg(
        F.concat_ws("\n\n", F.transform(F.array_sort(F.collect_list(part)), lambda x: x["s"])).alias("context"),
        F.count(F.lit(1)).alias("retrieved_documents"),
        F.min_by("score", "rank").alias("top_document_score"))


PROMPT_TEMPLATE = """You review sustainability statements of companies against published rules and standards.

Passages found for this statement, best match first:
{context}

Statement under review: "{claim}"

Judge the statement by these passages alone. Name the measure it reports, say where a passage limits or
contradicts it, and rate from 0 (well supported) to 1 (misleading) how far a reader would be misled. When
the passages do not bear on the statement, say so in the rationale.

Reply with one JSON object and nothing else:
{{"kpi": text, "risk_score": number, "rationale": text, "regulatory_issues": [text, ...], "recommendations": [text, ...]}}
"""


def prompt(context_col: Column, claim_col: Column, template: str = PROMPT_TEMPLATE) -> Column:
    """Fill the analysis template (``{context}``, ``{claim}``; ``{{``/``}}`` are literal braces)."""
    pieces = template.replace("{{", "\x00").replace("}}", "\x01")
    head, rest = pieces.split("{context}")
    mid, tail = rest.split("{claim}")
    fix = lambda s: s.replace("\x00", "{").replace("\x01", "}")
    return F.concat(F.lit(fix(head)), context_col, F.lit(fix(mid)), claim_col, F.lit(fix(tail)))


RESPONSE_SCHEMA = T.StructType([
    T.StructField("kpi", T.StringType()), T.StructField("risk_score", T.DoubleType()),
    T.StructField("rationale", T.StringType()),
    T.StructField("regulatory_issues", T.ArrayType(T.StringType())),
    T.StructField("recommendations", T.ArrayType(T.StringType())),
])


def parse_response(raw: Column) -> Column:
    """Parse a model JSON answer; text that is not a JSON object falls back to
    kpi 'Unable to extract', risk 0.5, rationale = raw text, empty lists."""
    parsed = F.from_json(raw, RESPONSE_SCHEMA, {"mode": "PERMISSIVE"})
    ok = F.trim(raw).startswith("{") & parsed.isNotNull() & F.json_object_keys(raw).isNotNull()
    empty = F.array().cast("array<string>")
    return F.when(ok, parsed).otherwise(F.struct(
        F.lit("Unable to extract").alias("kpi"), F.lit(0.5).alias("risk_score"), raw.alias("rationale"),
        empty.alias("regulatory_issues"), empty.alias("recommendations")))


# Fixed value: the rationale of a claim for which nothing was retrieved.
EMPTY_RATIONALE = "Unable to analyze due to lack of relevant context"


def hit_summary(claims: DataFrame, hits: DataFrame, chunks: DataFrame, q_id: str, title: str = "title",
                chunk_id: str = "chunk_uid", source: str | None = None) -> DataFrame:
    """G12-G14 + H3/H10 inputs per claim: n hits, mean score, top score, the first three
    titles, the sources list (``'Unknown'`` when missing); claims without hits keep
    ``n_hits = 0`` (left join), an error note, risk 0.5 and the rationale for it."""
    cols = [chunk_id, F.col(title).alias("_title")]
    cols.append(F.col(source).alias("_source") if source else F.lit(None).cast("string").alias("_source"))
    h = hits.join(chunks.select(*cols), chunk_id)
    agg = h.groupBy(q_id).agg(
        F.count(F.lit(1)).alias("n_hits"), F.avg("score").alias("mean_score"),
        F.max("score").alias("top_score"),
        F.transform(F.slice(F.array_sort(F.collect_list(F.struct("rank", "_title"))), 1, 3),
                    lambda x: x["_title"]).alias("relevant_standards"),
        F.transform(F.array_sort(F.collect_list(F.struct("rank", "_source"))),
                    lambda x: F.coalesce(x["_source"], F.lit("Unknown"))).alias("sources"))
    out = claims.join(agg, q_id, "left")
    return out.withColumns({
        "n_hits": F.coalesce("n_hits", F.lit(0)),
        "retrieval_note": F.when(F.col("n_hits").isNull(), F.lit("No relevant documents found")),
        "fallback_risk": F.when(F.col("n_hits").isNull(), F.lit(0.5)),
        "fallback_rationale": F.when(F.col("n_hits").isNull(), F.lit(EMPTY_RATIONALE)),
    })
