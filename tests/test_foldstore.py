"""The nested fold store against plain NumPy versions."""

import re
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from claimlens.functions.text import english_stop_words
from claimlens.operators import foldstore as FS

RNG = np.random.default_rng(3)
WORDS = [f"{a}{b}" for a in "green carbon solar waste water forest energy supply".split() for b in ("", "ly", "ist")]
POINTS = [FS.Point(c, p) for c in (0.1, 10) for p in ("l1", "l2")]


def make_rows(n=120):
    out = []
    for i in range(n):
        label = i % 3 == 0
        words = RNG.choice(WORDS[:14] if label else WORDS[8:], 12).tolist() + ["the", "and"] * 2
        out.append((i, None if i == 7 else " ".join(words), ["north", "south", None][i % 3 if i % 5 else 0], float(RNG.normal(label, 1)) if i % 11 else None,
                    float("nan") if i == 13 else float(i), 1.0 * label, FS.TEST if i % 6 == 5 else i % 5))
    return out


ROWS = make_rows()


@pytest.fixture(scope="module")
def store(spark):
    df = spark.createDataFrame(ROWS, "id long, text string, place string, a double, b double, label double, fold int").repartition(3)
    return FS.build(df, "id", "label", "text", ["place"], ["a", "b"], FS.nested_sets(5), max_features=60, k=6)


def plain_features(left, k=6, max_features=60):
    """(ids, fold, label, X) of one set, all by dense NumPy."""
    stop = set(english_stop_words())
    docs = []
    for r in ROWS:
        w = [t for t in re.findall(r"\w{2,}", (r[1] or "").lower()) if t not in stop]
        docs.append(Counter(w + [f"{x} {y}" for x, y in zip(w, w[1:], strict=False)]))
    learn = [i for i, r in enumerate(ROWS) if r[6] not in left]
    total, df = Counter(), Counter()
    for i in learn:
        total.update(docs[i])
        df.update(docs[i].keys())
    vocabulary = sorted(total, key=lambda t: (-total[t], t))[:max_features]
    idf = np.array([np.log((1 + len(learn)) / (1 + df[t])) + 1 for t in vocabulary])
    a = np.array([[d[t] for t in vocabulary] for d in docs]) * idf
    norm = np.linalg.norm(a, axis=1, keepdims=True)
    a = a / np.where(norm > 0, norm, 1)
    _, sigma, vt = np.linalg.svd(a[learn], full_matrices=False)
    v = vt[:k].T
    v = v * np.sign(v[np.abs(v).argmax(axis=0), np.arange(k)])
    places = [r[2] or "unknown" for r in ROWS]
    known = sorted({places[i] for i in learn})
    parts = [a @ v, np.array([[float(p == q) for q in known] for p in places])]
    for c in (3, 4):
        x = np.array([np.nan if r[c] is None else r[c] for r in ROWS])
        kept = np.sort(x[learn][~np.isnan(x[learn])])
        x = np.where(np.isnan(x), kept[(len(kept) - 1) // 2], x)
        parts.append(((x - x[learn].mean()) / x[learn].std())[:, None])
    return np.hstack(parts), np.array(learn), sigma[:k]


def plain_logistic(x, t, c, point, rounds=20_000):
    """Accelerated proximal gradient on the same loss."""
    x = np.hstack([x, np.ones((len(x), 1))])
    pay = np.r_[np.ones(x.shape[1] - 1), 0.0] / point.c
    l1, l2 = (pay, 0 * pay) if point.penalty == "l1" else (0 * pay, pay if point.penalty == "l2" else 0 * pay)
    rate = 1 / (0.25 * np.linalg.norm(x * np.sqrt(c)[:, None], 2) ** 2 + l2.max())
    w = z = np.zeros(x.shape[1])
    m = 1.0
    for _ in range(rounds):
        p = 1 / (1 + np.exp(-(x @ z)))
        new = z - rate * (x.T @ (c * (p - t)) + l2 * z)
        new = np.sign(new) * np.maximum(np.abs(new) - rate * l1, 0)
        after = (1 + np.sqrt(1 + 4 * m * m)) / 2
        z, w, m = new + (m - 1) / after * (new - w), new, after
    return w


def plain_auc(label, score):
    pos, neg = score[label == 1], score[label == 0]
    return np.mean([(p > neg).mean() + (p == neg).mean() / 2 for p in pos])


def test_features_learn_nothing_from_left_out_folds(store):
    got = {}
    for r in store.table.collect():
        got.setdefault(r["set"], {})[r["id"]] = np.array(r["x"])
    for s in (0, 3, 7, 14):
        x, _, sigma = plain_features(store.sets[s])
        assert np.allclose(store.singular[s], sigma, rtol=1e-6)
        k, cats = len(sigma), x.shape[1] - len(sigma) - 2
        for i, row in got[s].items():
            assert np.allclose(row[:k + cats], x[i, :-2], atol=1e-6) and np.allclose(row[-2:], x[i, -2:], atol=1e-9) and not row[k + cats:-2].any()
    assert len(got[0]) == len(ROWS) and set(got[7]) == {r[0] for r in ROWS if r[6] != FS.TEST}


def test_nested_calibration(store):
    out = FS.nested_calibration(store, POINTS)
    label, fold = np.array([r[5] for r in ROWS]), np.array([r[6] for r in ROWS])
    margin = {}
    for s in store.sets:
        x, learn, _ = plain_features(s)
        y = label[learn]
        c = np.where(y == 1, len(y) / (2 * (y == 1).sum()), len(y) / (2 * (y == 0).sum()))
        for p, point in enumerate(POINTS):
            w = plain_logistic(x[learn], y, c, point)
            margin[s, p] = np.hstack([x, np.ones((len(x), 1))]) @ w
    want = {}
    for f in (*range(5), FS.TEST):
        inner = [g for g in range(5) if g != f]
        auc = [np.mean([plain_auc(label[fold == g], margin[frozenset({FS.TEST, f, g}), p][fold == g]) for g in inner]) for p in range(len(POINTS))]
        best = int(np.argmax(auc))
        assert out["chosen"][f] == POINTS[best]
        if f == FS.TEST:
            grid = [(r["C"], r["penalty"], round(r["mean_auc"], 6)) for r in out["grid"].collect()]
            assert grid == [(q.c, q.penalty, round(a, 6)) for q, a in zip(POINTS, auc, strict=True)]
        total = np.zeros(len(ROWS))
        for g in inner:
            m, y = margin[frozenset({TEST_SET, f, g}), best], label[fold == g]
            pos, neg = (y == 1).sum(), (y == 0).sum()
            t = np.where(y == 1, (pos + 1) / (pos + 2), 1 / (neg + 2))
            slope, shift = plain_logistic(m[fold == g][:, None], t, np.ones(len(y)), FS.Point(1.0, "none"))
            total += 1 / (1 + np.exp(-(slope * m + shift))) / len(inner)
        want.update({ROWS[i][0]: total[i] for i in np.flatnonzero(fold == f)})
    got = {r["id"]: r["calibrated"] for d in ("oof", "test") for r in out[d].collect()}
    assert set(got) == set(want)
    assert max(abs(got[i] - want[i]) for i in want) < 1e-4


TEST_SET = FS.TEST


@pytest.mark.parametrize("rank", [4, 40])
def test_block_svd(spark, rank):
    a = RNG.normal(size=(300, rank)) @ RNG.normal(size=(rank, 80)) * (RNG.random((300, 80)) < 0.3)
    a[5] = 0
    rows = [(i % 2, np.flatnonzero(r).tolist(), r[np.flatnonzero(r)].tolist()) for i, r in enumerate(a)]
    df = spark.createDataFrame(rows, "set int, index array<int>, value array<double>").repartition(4)
    got = FS.block_svd(df, {0: 80, 1: 80, 2: 80, 3: 0}, 10)
    for s in (0, 1):
        _, sigma, vt = np.linalg.svd(a[s::2], full_matrices=False)
        assert np.allclose(got[s][0], sigma[:10], rtol=1e-6) and np.allclose(np.abs(np.sum(got[s][1].T * vt[:10], axis=1)), 1, atol=1e-5)
    assert not len(got[2][0]) and not len(got[3][0])


def test_fit_logistic_reaches_the_optimum(spark):
    x = RNG.normal(size=(200, 5))
    y = (x[:, 0] - x[:, 1] + RNG.normal(size=200) > 0.3) * 1.0
    df = spark.createDataFrame([(0, float(v), float(v), r.tolist()) for r, v in zip(x, y, strict=True)], "set int, label double, t double, x array<double>")
    got = FS.fit_logistic(df, {(0, 0.0): 1.5, (0, 1.0): 0.5}, {0: POINTS + [FS.Point(0.01, "l1"), FS.Point(1000, "l2")]}, 5)
    c = np.where(y == 1, 0.5, 1.5)
    for i, point in enumerate(POINTS + [FS.Point(0.01, "l1"), FS.Point(1000, "l2")]):
        assert np.allclose(got[0, i], plain_logistic(x, y, c, point), atol=1e-6)
    assert not got[0, 4][:5].any()


def test_grouped_auc(spark):
    rows = [(g, float(RNG.integers(0, 2)), float(RNG.integers(0, 6))) for g in range(5) for _ in range(40)] + [(9, 1.0, 2.0), (9, 1.0, 3.0)]
    df = spark.createDataFrame(rows, "g int, label double, margin double").repartition(4)
    got = {r["g"]: r["auc"] for r in FS.grouped_auc(df, ["g"]).collect()}
    for g in range(5):
        label, score = np.array([r[1] for r in rows if r[0] == g]), np.array([r[2] for r in rows if r[0] == g])
        assert abs(got[g] - plain_auc(label, score)) < 1e-12
    assert got[9] is None


def test_store_without_learning_rows(spark):
    df = spark.createDataFrame([(1, "a text here", "x", 1.0, 0.0, FS.TEST)], "id long, text string, place string, a double, label double, fold int")
    store = FS.build(df, "id", "label", "text", ["place"], ["a"], [frozenset({FS.TEST})], k=3)
    assert [r["x"] for r in store.table.collect()] == [[0.0]]
    assert FS.build(df.limit(0), "id", "label", "text", ["place"], ["a"], [frozenset({FS.TEST})], k=3).table.count() == 0
    assert store.table.filter(F.col("fold") == FS.TEST).count() == 1


def test_one_pass_svd(spark):
    """A^T A summed in one pass gives the directions of NumPy's SVD, for sets of different widths."""
    a = {0: RNG.normal(size=(700, 30)) * (RNG.random((700, 30)) < 0.3), 1: RNG.normal(size=(40, 9)), 2: np.outer(RNG.normal(size=20), RNG.normal(size=6))}
    rows = [(s, [int(i) for i in np.flatnonzero(x)], [float(v) for v in x[x != 0]]) for s, m in a.items() for x in m]
    df = spark.createDataFrame(rows, "set int, index array<int>, value array<double>").repartition(5)
    got = FS.directions_of(df, {0: 30, 1: 9, 2: 6, 3: 0}, 5)
    for s, m in a.items():
        _, sigma, vt = np.linalg.svd(m, full_matrices=False)
        rank = min(5, np.linalg.matrix_rank(m))
        v = vt[:rank].T * np.sign(vt[np.arange(rank), np.abs(vt[:rank]).argmax(axis=1)])
        assert np.allclose(got[s][0], sigma[:rank])
        assert np.allclose(got[s][1], v, atol=1e-6)
    assert got[3][1].size == 0


def test_terms_are_counted_inside_the_row(spark):
    """Counts of one- and two-word terms an id, equal to one row per occurrence; texts of a repeated id together."""
    from claimlens.operators.retrieval import TfidfParams, term_counts, terms
    rows = [(1, "green Green power the plant"), (2, None), (3, ""), (4, "a"), (1, "plant green power"), (5, "the of"), (None, "solar solar")]
    df = spark.createDataFrame(rows, "id long, text string")
    got = term_counts(df, "id", "text", TfidfParams())
    assert "Generate" not in got._jdf.queryExecution().optimizedPlan().toString()
    flat = {(r["id"], c["term"], c["tf"]) for r in got.collect() for c in r["counts"]}
    want = {tuple(r) for r in terms(df, "id", "text", TfidfParams()).groupBy("id", "term").count().collect()}
    assert flat == want and len(got.collect()) == 6


def test_regressions_share_and_keep_hessians(spark, monkeypatch):
    """The first pass makes one Hessian a set, and a model near its optimum asks for the gradient only; the optimum is exact."""
    rng = np.random.default_rng(8)
    x = rng.normal(size=(300, 3))
    y = (rng.random(300) < 1 / (1 + np.exp(-(x @ [1.0, -2.0, 0.5] + 0.3)))).astype(float)
    rows = spark.createDataFrame([(0, float(t), float(t), v.tolist()) for t, v in zip(y, x)], "set int, label double, t double, x array<double>").coalesce(2)
    passes = []

    def counted(df, partial, columns):
        found = plain(df, partial, columns)
        passes.append((len(found), sum(bool(m[:columns - 1].any()) for m in found.values())))
        return found

    plain = FS.matrix_sums
    monkeypatch.setattr(FS, "matrix_sums", counted)
    points = [FS.Point(1.0, "l2"), FS.Point(0.1, "l2"), FS.Point(0.1, "l1"), FS.Point(1.0, "none")]
    got = FS.fit_logistic(rows, {(0, 0.0): 1.0, (0, 1.0): 1.0}, {0: points}, 3)
    assert passes[0] == (1, 1) and sum(full for _, full in passes) < sum(n for n, _ in passes)
    full = np.hstack([x, np.ones((300, 1))])
    for i, p in enumerate(points):
        w = got[0, i]
        grad = full.T @ (1 / (1 + np.exp(-full @ w)) - y)
        if p.penalty == "l1":
            assert (np.abs(grad[:3]) <= 1 / p.c + 1e-6).all() and np.allclose((grad[:3] + np.sign(w[:3]) / p.c)[w[:3] != 0], 0, atol=1e-5)
        else:
            assert np.allclose(grad[:3] + (w[:3] / p.c if p.penalty == "l2" else 0), 0, atol=1e-5)
        assert abs(grad[3]) < 1e-5


def test_rare_pairs_are_left_out_exactly(spark):
    """The vocabulary is that of a full count, while pairs in buckets of too few occurrences are not counted."""
    rng = np.random.default_rng(5)
    texts = [" ".join(rng.choice([f"w{j}" for j in range(60)], 30, p=np.arange(60, 0, -1) / 1830)) for _ in range(60)] + [None, ""]
    df = spark.createDataFrame([(i, i % 3 - 1, float(i % 2), t) for i, t in enumerate(texts)], "id long, fold int, label double, text string")
    total = {}
    for i, t in enumerate(texts):
        words = (t or "").split() if i % 3 else []
        for term in [*words, *[f"{a} {b}" for a, b in zip(words, words[1:], strict=False)]]:
            total[term] = total.get(term, 0) + 1
    best = sorted(total, key=lambda t: (-total[t], t))[:40]
    marked = {}
    real = FS._vectorise
    FS._vectorise = lambda words, *a: marked.update(words=words) or real(words, *a)
    try:
        store = FS.build(df, "id", "label", "text", [], [], [frozenset({FS.TEST})], max_features=40, ngrams=2, k=5)
    finally:
        FS._vectorise = real
    assert marked["words"] == sorted(best) and store.table.count() == len(texts)
    from claimlens.operators.retrieval import BUCKETS, TfidfParams
    import pyarrow as pa
    sums, _ = FS._fold_sums([0], TfidfParams(40, (2, 2)), np.zeros(BUCKETS, bool))
    batch = pa.RecordBatch.from_arrays([pa.array([[{"fold": 0}]]), pa.array([[["stone", "tree", "stone"]]])], names=["rows", "_toks"])
    assert sum(b.num_rows for b in sums(iter([batch]))) == 0


def test_store_keeps_counts_once_a_row(spark, monkeypatch):
    """Several sets share one written table of counts; dense features are on disk for a few sets at a time, and gone afterwards."""
    import os
    folders, gone = {}, []
    real, drop = FS.written, FS.discard

    def written(df, tag):
        made = real(df, tag)
        folders.setdefault(tag, []).append(made)
        return made

    def discard(df):
        gone.extend(f.removeprefix("file://") for f in df.inputFiles())
        drop(df)

    monkeypatch.setattr(FS, "written", written)
    monkeypatch.setattr(FS, "discard", discard)
    monkeypatch.setattr(FS, "AT_ONCE", 2)
    rows = [(i, f"green power {'solar' if i % 3 else 'claims'} word{i % 7}", float(i), float(i % 2), FS.TEST if i % 4 == 3 else (i // 4) % 2) for i in range(48)]
    df = spark.createDataFrame(rows, "id long, text string, a double, label double, fold int")
    store = FS.build(df, "id", "label", "text", [], ["a"], FS.nested_sets(2), k=3)
    assert "fold-vectors" not in folders and "fold-store" not in folders
    assert [t.count() for t in folders["fold-counts"]] == [48]
    FS.nested_calibration(store, [FS.Point(1.0, "l2")], k=2)
    assert "fold-learning" not in folders and len(folders["fold-store"]) == 2  # three sets, two at a time
    assert gone and not any(os.path.exists(f) for f in gone)
