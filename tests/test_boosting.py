"""Boosted trees of one task against Spark's learner, and their places in the comparisons."""

import numpy as np
from pyspark.ml.classification import GBTClassifier, LinearSVC, LogisticRegression, RandomForestClassifier
from pyspark.ml.feature import VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.ml.linalg import Vectors

from claimlens.operators import boosting as BO
from claimlens.operators import models as M
from claimlens.session import materialize


def _rows(spark, n=400, seed=3):
    """Mostly empty numbers, one number of many values that is negative at times, and a category of two values."""
    rng = np.random.default_rng(seed)
    x = np.where(rng.random((n, 6)) < 0.6, 0.0, rng.random((n, 6)))
    x[:, 5] = rng.standard_normal(n)
    two = (rng.random(n) < 0.4).astype(float)
    y = (x[:, 0] + x[:, 5] * two + 0.3 * rng.standard_normal(n) > 0.4).astype(float)
    parts = [(Vectors.dense(a) if i % 2 else Vectors.sparse(6, np.flatnonzero(a).tolist(), a[a != 0].tolist()), float(b), float(c)) for i, (a, b, c) in enumerate(zip(x, two, y, strict=True))]
    return materialize(spark.createDataFrame(parts, ["v", "two", "label"]).coalesce(1))


def _margins(model, df):
    return np.array([r[0] for r in model.transform(df).select(vector_to_array("rawPrediction")[1]).collect()])


def test_boosted_trees_of_one_task_are_sparks(spark):
    df = _rows(spark)
    df = df.withColumn("two", df["two"].alias("two", metadata={"ml_attr": {"type": "binary", "vals": ["0", "1"]}}))
    df = materialize(VectorAssembler(inputCols=["v", "two"], outputCol="features").transform(df))
    assert BO.binary_features(df).tolist() == [False] * 6 + [True]
    est = GBTClassifier(maxIter=12, maxDepth=4, minInstancesPerNode=3, seed=42)
    own, theirs = M.fitted(est, df), est.fit(df)
    assert isinstance(own, BO.BoostedTrees)
    assert np.abs(_margins(own, df) - _margins(theirs, df)).max() < 1e-9
    # an ensemble of fewer trees is its first trees, and grid points reach the learner
    short = M.fitted(est, df, {est.maxIter: 5, est.stepSize: 0.2})
    assert np.abs(_margins(short, df) - _margins(est.fit(df, {est.maxIter: 5, est.stepSize: 0.2}), df)).max() < 1e-9
    assert np.array_equal(_margins(M.first_trees(own, 5), df), _margins(M.fitted(est, df, {est.maxIter: 5}), df))


def test_row_share_and_larger_tables(spark, monkeypatch):
    df = materialize(VectorAssembler(inputCols=["v", "two"], outputCol="features").transform(_rows(spark)))
    est = GBTClassifier(maxIter=4, maxDepth=2, subsamplingRate=0.8, seed=42)
    a, b = M.fitted(est, df), M.fitted(est, df)
    assert a.trees == b.trees and a.trees != M.fitted(est, df, {est.subsamplingRate: 1.0}).trees
    assert ((_margins(a, df) > 0) == [r[0] == 1 for r in df.select("label").collect()]).mean() > 0.7
    monkeypatch.setattr(BO, "MOST", 100)  # Spark learns what is larger
    assert not isinstance(M.fitted(est, df), BO.BoostedTrees)


def _stepwise(values, most):
    """Thresholds as Spark walks over the distinct values."""
    seen, count = np.unique(values, return_counts=True)
    out, so_far, stride = [], count[0], len(values) / (most + 1)
    target = stride
    for i in range(1, len(seen)):
        before, so_far = so_far, so_far + count[i]
        if abs(before - target) < abs(so_far - target):
            out.append((seen[i - 1] + seen[i]) / 2)
            target += stride
    return out


def test_cuts_of_many_values():
    v = np.sort(np.random.default_rng(0).integers(1, 200, 900) / 7.0)
    for zeros in (0, 100, 5000):
        assert BO.cuts(v, 900 + zeros, 31).tolist() == _stepwise(np.r_[np.zeros(zeros), v], 31)
    assert BO.cuts(np.array([-1.0, 2.0]), 3, 31).tolist() == [-0.5, 1.0]
    assert BO.cuts(np.zeros(0), 10, 31).size == 0


def test_iterated_fits_read_few_partitions_and_forests_keep_theirs(spark, monkeypatch):
    df = materialize(VectorAssembler(inputCols=["v", "two"], outputCol="features").transform(_rows(spark, 200)).repartition(6))
    seen = {}
    for kind in (LogisticRegression, LinearSVC, RandomForestClassifier):
        monkeypatch.setattr(kind, "fit", lambda self, d, params=None: seen.update({type(self).__name__: d.rdd.getNumPartitions()}))
        M.fitted(kind(), df)
    assert seen == {"LogisticRegression": 1, "LinearSVC": 1, "RandomForestClassifier": 6}
    monkeypatch.setattr(M, "ROWS_A_TASK", 50)
    assert M.gathered(df).rdd.getNumPartitions() == 4 and M.gathered(df.limit(0)).rdd.getNumPartitions() <= 1
