import pytest

from claimlens.operators import curves as CV


def _df(spark):
    rows = [(0.9, 1), (0.8, 1), (0.7, 0), (0.6, 1), (0.5, 0), (0.4, 1)]
    return spark.createDataFrame(rows, "score double, label int")


def test_threshold_for_recall_fixture(spark):
    r = CV.threshold_for_recall(_df(spark), 0.75).first()
    assert r["threshold_unshifted"] == pytest.approx(0.6)
    assert r["threshold"] == pytest.approx(0.5)
    assert r["recall"] == pytest.approx(0.75)


def test_auc_matches_pair_count(spark):
    df = _df(spark)
    rows = df.collect()
    pos = [r["score"] for r in rows if r["label"] == 1]
    neg = [r["score"] for r in rows if r["label"] == 0]
    brute = sum((p > n) + 0.5 * (p == n) for p in pos for n in neg) / (len(pos) * len(neg))
    r = CV.roc_auc(df).first()
    assert r["roc_auc"] == pytest.approx(brute, abs=1e-6)
    assert r["gini"] == pytest.approx(2 * brute - 1, abs=1e-6)


def test_auc_with_ties(spark):
    rows = [(0.5, 1), (0.5, 0), (0.7, 1), (0.2, 0), (0.7, 0)]
    df = spark.createDataFrame(rows, "score double, label int")
    pos = [s for s, y in rows if y == 1]
    neg = [s for s, y in rows if y == 0]
    brute = sum((p > n) + 0.5 * (p == n) for p in pos for n in neg) / (len(pos) * len(neg))
    assert CV.roc_auc(df).first()["roc_auc"] == pytest.approx(brute, abs=1e-6)


def test_zero_division_metrics(spark):
    df = spark.createDataFrame([(0, 0), (1, 0)], "label int, pred int")
    r = CV.binary_metrics(df).first()
    assert r["precision"] == 0.0 and r["recall"] == 0.0 and r["f1"] == 0.0 and r["accuracy"] == 0.5
