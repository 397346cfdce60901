"""Toxicity by non-negative positive-unlabelled learning.

The classifier sees confirmed toxic examples (P) and unlabelled texts (U), which hold toxic ones at the
class prior.  The risk of a linear scorer f with logistic loss is

    prior * E_P[l(f)]  +  max(0, E_U[l(-f)] - prior * E_P[l(-f)]),

whose second part estimates the loss on clean texts and is kept from going negative: where it does,
a step goes up its gradient instead (NumPy, Adam, all rows in every step).  The prior is the share of
toxic rows among the labelled training rows unless given.

A feature is the presence of a word or of the first four, five or six bytes of a longer word (words as
in the decontamination rule, lower-cased).  Candidates occur in at least ``least`` confirmed toxic rows, a fixed number
whatever the size of the table; the ``features`` of them with the strongest lift over U are used.  Both counts go over all training
rows: tasks count their rows, and what they find of the candidates is added up in Spark.  Only the rows of the fit are
bounded, by ``max_positive`` and ``max_unlabelled``, the smallest hashes of doc_id first; every text is scored whole.

Defined results: without a positive training row the score is the prior (0 without labels) for all;
null and empty texts have no feature and get the score of the bias; rows with a null doc_id are not
learned from but scored; a document with several labels counts as toxic if one says so; repeated rows
are scored each for itself; labels of unknown documents are ignored; an empty table gives an empty
result; an input column named as a result column is replaced.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from claimlens.llm.common import _BASE, _BASE_INV, _SYMBOL_LOWER, ALNUM, SLICE_BYTES, Words, by_ids, gathered, materialise, mix64, powers, ready, release, slices

PREFIXES = (4, 5, 6)


def text_features(words: Words) -> tuple[np.ndarray, np.ndarray]:
    """Feature hashes and the text each belongs to: every word and the first bytes of longer ones."""
    doc = np.repeat(np.arange(len(words.counts())), words.counts())
    hashes, docs = [words.hashes()], [doc]
    if len(words):
        sums = np.zeros(len(words.data) + 1, np.uint64)
        np.cumsum(_SYMBOL_LOWER[words.data] * powers(_BASE, len(words.data)), out=sums[1:])
        for k in PREFIXES:
            long = np.flatnonzero(words.end - words.start > k)
            s = words.start[long]
            hashes.append(mix64((sums[s + k] - sums[s]) * powers(_BASE_INV, len(words.data))[s] + np.uint64(k)))
            docs.append(doc[long])
    return np.concatenate(hashes), np.concatenate(docs)


def found_features(words: Words, known: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Distinct (text, place in the sorted ``known`` features) of consecutive texts."""
    h, doc = text_features(words)
    if not len(known):
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    at = np.minimum(np.searchsorted(known, h), len(known) - 1)
    hit = known[at] == h
    pair = np.unique(doc[hit].astype(np.int64) * len(known) + at[hit])
    return pair // len(known), pair % len(known)


class Model:
    """Linear scorer over sorted feature hashes."""

    def __init__(self, features: np.ndarray, weights: np.ndarray, bias: float):
        self.features, self.weights, self.bias = features, weights, bias

    def scores(self, words: Words) -> np.ndarray:
        doc, at = found_features(words, self.features)
        f = self.bias + np.bincount(doc, weights=self.weights[at], minlength=len(words.counts()))
        return 1 / (1 + np.exp(-np.clip(f, -500, 500)))


def fit_nonnegative(rows: list[list[int]], positive: np.ndarray, size: int, prior: float, steps: int = 400, rate: float = 0.1,
                    decay: float = 1e-4) -> tuple[np.ndarray, float]:
    """Weights and bias that minimise the non-negative risk; ``rows`` are feature numbers present."""
    n = np.array([len(r) for r in rows])
    row, col = np.repeat(np.arange(len(rows)), n), np.array([c for r in rows for c in r], np.int64)
    w, m, v = np.zeros(size + 1), np.zeros(size + 1), np.zeros(size + 1)
    share_p, share_u = positive / max(1, positive.sum()), ~positive / max(1, (~positive).sum())
    for step in range(1, steps + 1):
        f = w[size] + np.bincount(row, weights=w[col], minlength=len(rows))
        s = 1 / (1 + np.exp(-np.clip(f, -500, 500)))
        loss = np.logaddexp(0, f)
        clean = (share_u * loss).sum() - prior * (share_p * loss).sum()
        g_clean = (share_u - prior * share_p) * s
        g = prior * share_p * (s - 1) + g_clean if clean >= 0 else -g_clean
        grad = np.append(np.bincount(col, weights=g[row], minlength=size), g.sum())
        grad[:size] += decay * w[:size]
        m, v = 0.9 * m + 0.1 * grad, 0.999 * v + 0.001 * grad ** 2
        w -= rate * (m / (1 - 0.9 ** step)) / (np.sqrt(v / (1 - 0.999 ** step)) + 1e-8)
    return w[:size], float(w[size])


def train(docs: DataFrame, labels: DataFrame, doc_id: str = "doc_id", text: str = "text", toxic: str = "toxic", prior: float | None = None,
          features: int = 8192, least: int = 3, max_positive: int = 20_000, max_unlabelled: int = 40_000) -> Model:
    """Learn from ``docs`` and their ``labels`` (all of them training rows); ids may be of any type."""
    spark = docs.sparkSession
    ready(spark)
    d = docs.select(F.col(doc_id).alias("doc_id"), F.col(text).cast("string").alias("text")).filter("doc_id is not null")
    marked = labels.select(F.col(doc_id).alias("doc_id"), F.col(toxic).cast("int").alias("toxic")).filter("doc_id is not null and toxic is not null") \
        .groupBy("doc_id").agg(F.max("toxic").alias("toxic")).join(d.select("doc_id").distinct(), "doc_id", "left_semi")
    marked = materialise(marked, "toxic-labels")
    seen, share = marked.agg(F.count("*"), F.avg(F.col("toxic").cast("double"))).first()
    prior = prior if prior is not None else float(share or 0.0)
    confirmed = materialise(marked.filter("toxic = 1").select("doc_id"), "toxic-confirmed")
    if not confirmed.count() or not 0 < prior:
        return Model(np.zeros(0, np.uint64), np.zeros(0), float(np.log(max(prior, 1e-9) / max(1 - prior, 1e-9))))

    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows = 0
        for batch in gathered(batches, "text", 8 * SLICE_BYTES):
            rows, parts = rows + batch.num_rows, []
            for _, data, offs in slices(batch, "text"):
                h, doc = text_features(Words(data, offs, ALNUM))
                # the feature in one number with its text: distinct pairs by one sort
                order = np.lexsort((h, doc))
                h, doc = h[order], doc[order]
                parts.append(h[np.r_[True, (h[1:] != h[:-1]) | (doc[1:] != doc[:-1])][:len(h)]])
            values, n = np.unique(np.concatenate(parts), return_counts=True)
            yield pa.RecordBatch.from_arrays([pa.array(values.view(np.int64)), pa.array(n)], names=["feature", "n"])
        yield pa.RecordBatch.from_arrays([pa.array([None], pa.int64()), pa.array([rows], pa.int64())], names=["feature", "n"])

    count = lambda rows: rows.select("text").mapInArrow(each, "feature long, n long")
    in_p = count(by_ids(d, confirmed, "doc_id", "left_semi")).groupBy("feature").agg(F.sum("n").alias("p"))
    in_p = materialise(in_p.filter(f"feature is null or p >= {least}"), "toxic-candidates")
    known = materialise(in_p.select("feature").filter("feature is not null"), "toxic-features")
    everywhere = materialise(count(d), "toxic-counts")
    in_u = by_ids(everywhere, known, "feature", "left_semi").groupBy("feature").agg(F.sum("n").alias("u"))
    positives = in_p.filter("feature is null").agg(F.sum("p")).first()[0] or 0
    unlabelled = everywhere.filter("feature is null").agg(F.sum("n")).first()[0] or 0
    lift = F.log((F.col("p") + 0.5) / (positives + 1)) - F.log((F.col("u") + 0.5) / (unlabelled + 1))
    best = in_p.join(in_u, "feature").withColumn("lift", lift).filter(F.col("lift") > float(np.log(1.5))) \
        .orderBy(F.desc(F.col("lift") * F.sqrt("p")), "feature").limit(features).select("feature").collect()
    chosen_features = np.sort(np.array([r["feature"] for r in best], np.int64).view(np.uint64))

    spread = [F.xxhash64("doc_id"), "doc_id"]
    chosen = confirmed.orderBy(*spread).limit(max_positive).select("doc_id", F.lit(True).alias("positive")) \
        .unionByName(d.select("doc_id").distinct().orderBy(*spread).limit(max_unlabelled).select("doc_id", F.lit(False).alias("positive")))
    # at most max_positive + max_unlabelled ids, so the texts stay where they are
    sample = d.join(F.broadcast(materialise(chosen, "toxic-chosen")), "doc_id").select("doc_id", "positive", "text")
    sent = spark.sparkContext.broadcast(chosen_features)

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part, data, offs in slices(batch, "text"):
                doc, at = found_features(Words(data, offs, ALNUM), sent.value)
                edges = np.searchsorted(doc, np.arange(part.num_rows + 1))
                yield pa.RecordBatch.from_arrays([part.column(0), part.column(1), pa.ListArray.from_arrays(pa.array(edges, pa.int32()), pa.array(at, pa.int32()))],
                                                 names=["doc_id", "positive", "at"])

    schema = T.StructType([d.schema["doc_id"], T.StructField("positive", T.BooleanType()), T.StructField("at", T.ArrayType(T.IntegerType()))])
    data = sample.mapInArrow(rows, schema).orderBy("doc_id", "positive", F.to_json("at")).collect()  # max_positive + max_unlabelled short rows at most
    w, b = fit_nonnegative([r["at"] for r in data], np.array([r["positive"] for r in data], bool), len(chosen_features), min(prior, 0.99))
    for made in (marked, confirmed, in_p, known, everywhere):
        release(made)
    return Model(chosen_features, w, b)


def score(docs: DataFrame, model: Model, text: str = "text", cutoff: float = 0.7, score_column: str = "score",
          predicted_column: str = "predicted") -> DataFrame:
    """``docs`` with a score (0 to 1) and a prediction (1 from ``cutoff`` on)."""
    ready(docs.sparkSession)
    sent = docs.sparkSession.sparkContext.broadcast(model)
    df = docs.drop(score_column, predicted_column)
    schema = T.StructType(df.schema.fields + [T.StructField(score_column, T.DoubleType()), T.StructField(predicted_column, T.IntegerType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part, data, offs in slices(batch, text):
                s = sent.value.scores(Words(data, offs, ALNUM))
                yield pa.RecordBatch.from_arrays([*part.columns, pa.array(s), pa.array((s >= cutoff).astype(np.int32))],
                                                 names=[*part.schema.names, score_column, predicted_column])

    return df.mapInArrow(run, schema)
