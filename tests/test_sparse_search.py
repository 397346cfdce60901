"""Sparse top-k with upper bounds against scoring every pair."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from claimlens.operators import retrieval as RT

RNG = np.random.default_rng(23)


def vectors(n, terms=60):
    out = []
    for _ in range(n):
        t = np.unique(np.minimum(RNG.zipf(1.3, RNG.integers(1, 12)), terms))
        w = RNG.random(len(t)) + 0.05
        out.append((t, w / np.linalg.norm(w)))
    return out


@pytest.mark.parametrize("k", [1, 3, 10])
def test_candidates_hold_the_best(k):
    rows = vectors(400)
    index = RT.Postings(range(400), [t for t, _ in rows], [w for _, w in rows])
    dense = np.zeros((400, 61))
    for i, (t, w) in enumerate(rows):
        dense[i, t] = w
    scored = shared = 0
    for t, w in vectors(60):
        q = np.zeros(61)
        q[t] = w
        want = dense @ q
        got, score = index.search(t, w, k)
        assert np.allclose(score, want[got], atol=1e-12) and len(set(got.tolist())) == len(got)
        assert np.allclose(np.sort(score)[::-1][:k], np.sort(want[want > 0])[::-1][:k], atol=1e-12)
        scored, shared = scored + len(got), shared + index.sharing(t)
    if k == 1:
        assert scored < 0.5 * shared


def test_nothing_to_find():
    index = RT.Postings([], [], [])
    assert index.search(np.array([1, 2]), np.array([0.5, 0.5]), 3)[0].size == 0 and index.sharing(np.array([1])) == 0
    one = RT.Postings(["a"], [np.array([3])], [np.array([1.0])])
    assert one.search(np.array([1]), np.array([1.0]), 3)[0].size == 0


def test_blocks_give_the_same_hits(spark):
    words = [f"word{i}" for i in range(40)]
    text = lambda n: " ".join(words[min(j, 39)] for j in RNG.zipf(1.4, n) - 1)
    chunks = spark.createDataFrame([(f"c{i}", text(12)) for i in range(90)] + [("null", None), ("empty", ""), ("c0x", "word1 word1")], "chunk_uid string, text string")
    claims = spark.createDataFrame([(i, text(9)) for i in range(70)] + [(100, None), (101, "unknown things")], "claim_id long, t string")
    p = RT.TfidfParams(max_features=5000)
    one = {tuple(r) for r in RT.search_topk(claims, "claim_id", "t", chunks, 3, p).collect()}
    many = {tuple(r) for r in RT.search_topk(claims, "claim_id", "t", chunks, 3, p, index_bytes=0, block_bytes=2000).collect()}
    free = {tuple(r) for r in RT.search_topk(claims, "claim_id", "t", chunks, 3, RT.TfidfParams(max_features=None)).collect()}
    assert one == many == free and {r[0] for r in one} <= set(range(70))
    work = RT.search_pairs(claims, "claim_id", "t", chunks, 3, p).agg(F.sum("scored"), F.sum("sharing")).first()
    assert work[0] <= work[1]
    assert RT.search_topk(claims.limit(0), "claim_id", "t", chunks, 3, p).count() == 0
    assert RT.search_topk(claims, "claim_id", "t", chunks.limit(0), 3, p).count() == 0


def test_dense_scores_are_those_of_the_search():
    rows = vectors(50)
    index = RT.Postings(range(50), [t for t, _ in rows], [w for _, w in rows])
    for t, w in vectors(20):
        every = index.scores(t, w)
        got, score = index.search(t, w, 3)
        assert np.allclose(every[got], score, atol=1e-12) and np.allclose(np.sort(every)[::-1][:3], np.pad(np.sort(score)[::-1], (0, 3))[:3], atol=1e-12)
    assert index.scores(np.array([999]), np.array([1.0])).sum() == 0 and RT.Postings([], [], []).scores(np.array([1]), np.array([1.0])).size == 0


def test_terms_are_counted_inside_the_row(spark):
    """Counts and vectors against exploded terms: repeated ids (texts together, no n-gram across them), nulls, stop words, odd letters."""
    df = spark.createDataFrame([(1, "The Carbon carbon target"), (1, "target of the carbon"), (2, None), (None, "Straße ÉTÉ été 42"), (None, "42 x carbon"), (3, ""), (4, "of the")],
                               "id long, text string")
    for ngram in ((1, 1), (1, 2), (2, 3)):
        p = RT.TfidfParams(max_features=6, ngram=ngram)
        tf = RT.terms(df, "id", "text", p).groupBy("id", "term").agg(F.count("*").alias("tf"))
        want = {tuple(r) for r in tf.groupBy("term").agg(F.count("*"), F.sum("tf")).collect()}
        assert {tuple(r) for r in RT.term_frequencies(df, "id", "text", p).collect()} == want
        vocab, vectors = RT.corpus_vectors(df, p, "id", "text")
        got = {(r["id"], r["term"]): r["w"] for r in vectors.collect()}
        plain = {(r["id"], r["term"]): r["w"] for r in RT.vectorize(df, "id", "text", RT.fit_idf(df, "id", "text", p), p).collect()}
        assert got.keys() == plain.keys() and all(abs(got[key] - plain[key]) < 1e-12 for key in got)


def test_no_row_per_term_is_shuffled(spark):
    """A text of 3,000 equal words sends one sum a term, and a vector is made in the task that holds the text."""
    df = spark.range(40).selectExpr("id", "repeat('alpha beta ', 1500) AS text")
    p = RT.TfidfParams(max_features=10)
    plan = RT.term_frequencies(df, "id", "text", p)._jdf.queryExecution().optimizedPlan().toString()
    assert "Generate" not in plan and "MapInArrow" in plan
    assert {tuple(r) for r in RT.term_frequencies(df, "id", "text", p).collect()} == {("alpha", 40, 60000), ("beta", 40, 60000), ("alpha beta", 40, 60000), ("beta alpha", 40, 59960)}
