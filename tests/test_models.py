"""Properties of the model-side operators: SMOTE geometry, folds, persistence."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from claimlens.operators import models as M
from claimlens.operators.balance import smote
from claimlens.operators.folds import stratified_kfold, stratified_split

SF = "/root/testdata/sf0.001"


def test_smote_points_lie_on_minority_segments(spark):
    e = spark.read.parquet(f"{SF}/embeddings.parquet").withColumn("y", (F.col("label") == 0).cast("int"))
    rows = e.collect()
    mino = {r["vec_id"]: np.array(r["embedding"], dtype=float) for r in rows if r["y"] == 1}
    n_maj = sum(1 for r in rows if r["y"] == 0)
    out = smote(e, "vec_id", "embedding", "y", minority=1, k=5).collect()
    assert len(out) == n_maj - len(mino)
    pts = np.stack(list(mino.values()))
    for r in out[:50]:
        x, s = mino[r["source_id"]], np.array(r["features"])
        # s = x + u (nn - x) for some minority nn and u in [0, 1): check some nn fits
        ok = False
        for nn in pts:
            d = nn - x
            if np.allclose(d, 0):
                continue
            u = float(np.dot(s - x, d) / np.dot(d, d))
            if -1e-9 <= u <= 1 + 1e-9 and np.allclose(x + u * d, s, atol=1e-6):
                ok = True
                break
        assert ok


def test_smote_neighbours_are_exact_beyond_one_block(spark):
    """Small blocks still find the 5 nearest rows of the whole class."""
    rng = np.random.default_rng(3)
    x = rng.normal(size=(240, 3))
    rows = [(i, v.tolist(), 1) for i, v in enumerate(x)] + [(1000 + i, [0.0, 0.0, 0.0], 0) for i in range(720)]
    df = spark.createDataFrame(rows, "id long, vec array<double>, y int")
    out = smote(df, "id", "vec", "y", minority=1, k=5, block_rows=16).collect()
    assert len(out) == 480
    for r in out:
        a, s = x[r["source_id"]], np.array(r["features"])
        d = ((x - a) ** 2).sum(axis=1)
        near = np.argsort(d)[1:6]
        assert min(np.linalg.norm(np.cross(x[j] - a, s - a)) / np.linalg.norm(x[j] - a) for j in near) < 1e-9


def test_folds_are_disjoint_complete_and_stratified(spark):
    df = spark.range(0, 103).withColumn("y", (F.col("id") % 3 == 0).cast("int"))
    f = stratified_kfold(df, "id", "y", 5).collect()
    assert len(f) == 103 and len({r["id"] for r in f}) == 103
    for y in (0, 1):
        sizes = [sum(1 for r in f if r["y"] == y and r["fold"] == k) for k in range(5)]
        assert max(sizes) - min(sizes) <= 1
    s = stratified_split(df, "id", "y", 20).collect()
    n_test = {y: sum(1 for r in s if r["y"] == y and r["split"] == "test") for y in (0, 1)}
    n_all = {y: sum(1 for r in s if r["y"] == y) for y in (0, 1)}
    assert all(n_test[y] == -(-n_all[y] * 20 // 100) for y in (0, 1))


def test_model_save_load_roundtrip(spark, tmp_path):
    rows = [(i, f"claim {'green' if i % 2 else 'plain'} text {i}", float(i % 7), float(i % 2)) for i in range(60)]
    df = spark.createDataFrame(rows, "id long, t string, v double, label double").withColumn("weight", F.lit(1.0))
    m = M.fit_pipeline(df, M.feature_stages("t", [], ["v"], vocab_size=50), M.logistic(weight_col="weight"))
    path = str(tmp_path / "model")
    M.save_model(m, path)
    a = M.scored(m.transform(df), "id").orderBy("id").collect()
    b = M.scored(M.load_model(path).transform(df), "id").orderBy("id").collect()
    assert [round(r["score"], 9) for r in a] == [round(r["score"], 9) for r in b]


def test_dense_topk_blocks_match_single_block(spark):
    from claimlens.operators import retrieval as RT
    e = spark.read.parquet(f"{SF}/embeddings.parquet")
    cents = RT.centroids(e, "label")
    one = {tuple(r) for r in RT.dense_topk(e, "vec_id", cents, "label", "centroid", 3, "ip").collect()}
    many = {tuple(r) for r in RT.dense_topk(e, "vec_id", cents, "label", "centroid", 3, "ip",
                                            block_bytes=3 * 64 * 8).collect()}
    assert one == many and len(one) == 3 * cents.count()


def test_dense_topk_ties_and_missing_vectors(spark):
    """Equal scores go by id over all partitions; NULL and NaN vectors and NULL ids are left out."""
    from claimlens.operators import retrieval as RT
    rows = [(i, [1.0, 0.0]) for i in range(40)] + [(100, [2.0, 0.0]), (101, None), (102, [float("nan"), 0.0]), (None, [3.0, 0.0])]
    v = spark.createDataFrame(rows, "id long, embedding array<double>").repartition(5)
    q = spark.createDataFrame([("a", [1.0, 0.0]), ("b", None)], "q string, qv array<double>")
    got = [tuple(r) for r in RT.dense_topk(v, "id", q, "q", "qv", 3, "ip").orderBy("rank").collect()]
    assert got == [("a", 100, 2.0, 1), ("a", 0, 1.0, 2), ("a", 1, 1.0, 3)]
    near = [tuple(r) for r in RT.dense_topk(v, "id", q, "q", "qv", 2, "l2").orderBy("rank").collect()]
    assert near == [("a", 0, 0.0, 1), ("a", 1, 0.0, 2)]
    assert RT.dense_topk(v.limit(0), "id", q, "q", "qv", 3).count() == 0


def test_row_digest_keeps_values_apart(spark):
    from claimlens.operators.quality import duplicate_count, row_digest
    df = spark.sql("""SELECT * FROM VALUES ('a', 'b', 0.0D, 1), ('a', 'b', -0.0D, 1), ('a","b', NULL, 0.0D, 1), (NULL, 'a","b', 0.0D, 1),
                      ('null', NULL, 0.0D, 1), (NULL, NULL, 0.0D, 1) AS t(x, y, v, n)""")
    assert df.select(row_digest(df).alias("d")).distinct().count() == 5
    assert duplicate_count(df).first()["duplicates"] == 1


def test_grid_search_fits_features_once_per_fold(spark):
    rows = [(i, f"{'green' if i % 2 else 'plain'} word{i % 9}", float(i % 2), i % 7 % 2) for i in range(60)]
    df = spark.createDataFrame(rows, "id long, t string, label double, fold int").withColumn("weight", F.lit(1.0))
    model, table = M.grid_search(df, M.feature_stages("t", [], [], vocab_size=50), folds=2, c_grid=[0.001, 10], penalties=["l2"])
    got = {r["C"]: r["mean_auc"] for r in table.collect()}
    assert got[10.0] == 1.0
    assert M.scored(model.transform(df), "id").where("label <> pred").count() == 0


def test_feature_assembly_by_hand(spark):
    """Population scaling of 1, 2, 3; an unseen category is all zeros; a term of every text keeps its weight."""
    from pyspark.ml import Pipeline
    from pyspark.ml.functions import vector_to_array
    df = spark.createDataFrame([(1, "tree water", "a", 1.0), (2, "tree tree", "b", 2.0), (3, "tree", "a", 3.0)],
                               "id int, t string, c string, v double")
    fitted = Pipeline(stages=M.feature_stages("t", ["c"], ["v"], vocab_size=10)).fit(df)
    more = df.union(spark.createDataFrame([(4, "tree", "unseen", 2.0)], df.schema))
    cols = [vector_to_array(F.col(c)).alias(c) for c in ("_text_vec", "_c_oh", "_num")]
    rows = {r["id"]: r for r in fitted.transform(more).select("id", *cols).collect()}
    assert np.allclose([rows[i]["_num"][0] for i in (1, 2, 3)], [-1.5 ** 0.5, 0, 1.5 ** 0.5])
    assert rows[1]["_c_oh"] == [1.0, 0.0] and rows[2]["_c_oh"] == [0.0, 1.0] and rows[4]["_c_oh"] == [0.0, 0.0]
    water = np.log(4 / 2) + 1  # tree: ln(4 / 4) + 1
    assert np.allclose(rows[1]["_text_vec"], np.array([1.0, water]) / (1 + water ** 2) ** 0.5)
    assert np.allclose(rows[2]["_text_vec"], [1.0, 0.0])


def test_text_takes_over_without_an_embedding(spark):
    from pyspark.ml import Pipeline
    with_vector = spark.createDataFrame([("tree water", [1.0]), ("tree", [2.0])], "t string, emb array<double>")
    assert M.representation_stages(with_vector, "emb", "t", [], [])[1] == "embedding"
    texts = with_vector.drop("emb")
    stages, used = M.representation_stages(texts, "emb", "t", [], [])
    assert used == "tfidf" and Pipeline(stages=stages).fit(texts).transform(texts).first()["features"].size == 2


def test_two_word_terms_and_signed_importance(spark):
    df = spark.createDataFrame([("red tree red tree",), ("red water",)], "t string")
    from pyspark.ml import Pipeline
    fitted = Pipeline(stages=M.text_stages("t", 50, 1.0, 1.0, ngrams=2)).fit(df)
    assert set(fitted.stages[4].vocabulary) == {"red", "tree", "water", "red tree", "tree red", "red water"}
    coef = spark.createDataFrame([("a", 3.0), ("b", -2.0), ("c", 1.0), ("d", 0.0), ("e", -4.0)], "feature string, coefficient double")
    got = {(r["side"], r["rank"]): r["feature"] for r in M.signed_importance(coef, 1).collect()}
    assert got == {("positive", 1): "a", ("negative", 1): "e"}


def test_calibration_never_sees_the_test_part(spark):
    """Ids of the out-of-fold tables are those of the training part, once each; probabilities lie in 0..1."""
    d = spark.createDataFrame([(i, "tree water" if i % 3 else "red stone", float(i % 7), float(i % 3 == 0 or i % 5 == 0), i % 5, 1.0)
                               for i in range(60)], "claim_id int, t string, v double, label double, fold int, weight double")
    st, lr = M.feature_stages("t", [], ["v"], vocab_size=20), M.logistic(weight_col="weight", reg=0.1)
    train, test = d.where("claim_id < 50"), d.where("claim_id >= 50")
    models = M.calibrated_models(train, st, lr, "claim_id", 5)
    got = M.calibrated_scores(models, test, "claim_id").collect()
    assert sorted(r["claim_id"] for r in got) == list(range(50, 60)) and all(0 <= r["calibrated"] <= 1 for r in got)
    assert sorted(r["claim_id"] for r in M.out_of_fold(train, st, lr, "claim_id", 5).collect()) == list(range(50))


def test_records_without_model_or_text(spark):
    d = spark.createDataFrame([(i, "tree water" if i % 2 else "red stone", float(i % 2)) for i in range(20)] + [(99, None, 0.0)], "id long, t string, label double")
    known = d.where("t is not null")
    m = M.fit_pipeline(known, M.feature_stages("t", [], [], vocab_size=20), M.logistic(weight_col=None, reg=0.01, family="multinomial"))
    got = {r["id"]: r for r in M.category_predictions(m, d, "id", ["stone", "tree"], "t").collect()}
    assert got[1]["category"] == "tree" and got[2]["category"] == "stone" and abs(sum(got[1]["probabilities"].values()) - 1) < 1e-9
    assert (got[99]["category"], got[99]["confidence"], got[99]["error"]) == ("Unknown", 0.0, M.NO_TEXT) and got[1]["error"] is None
    assert {r["error"] for r in M.category_predictions(None, d, "id", []).collect()} == {M.NO_MODEL}
    flag = {r["id"]: r for r in M.flag_predictions(m, d, "id", "t").collect()}
    assert flag[1]["is_greenwashing"] and flag[1]["confidence"] == flag[1]["probability"] > 0.5 and not flag[2]["is_greenwashing"]
    assert not flag[99]["is_greenwashing"] and flag[99]["error"] == M.NO_TEXT and len(flag) == 21
    assert {(r["is_greenwashing"], r["confidence"]) for r in M.flag_predictions(None, d, "id").collect()} == {(False, 0.0)}


def test_experiment_record(spark):
    d = spark.createDataFrame([(i, "tree water" if i % 3 else "red stone", float(i % 3 == 0), i % 2, 1.0) for i in range(48)],
                              "id long, t string, label double, fold int, weight double")
    train, test = d.where("id < 36"), d.where("id >= 36")
    rows = M.experiment_record(train, test, M.feature_stages("t", [], [], vocab_size=20), "id", ["LogisticRegression", "SVM"], folds=2).collect()
    at = {(r["part"], r["model"], r["metric"]): r for r in rows}
    assert at["dataset", None, "total_samples"]["value"] == 48 and at["dataset", None, "class_balancing"]["text"] == "SMOTE"
    assert at["best_model", "LogisticRegression", "cv_score"]["value"] == 1.0 and at["cross_validation", "SVM", "std_auc"]["value"] == 0.0
    assert at["model_comparison", "SVM", "accuracy"]["value"] == 1.0


def test_code_tables_of_few_and_many_values(spark, monkeypatch):
    from claimlens.operators import features as FE
    df = spark.createDataFrame([(v,) for v in ["b", "a", None, "b", "c"] * 3], "v string")
    few = {r["_value"]: r["v_encoded"] for r in FE.code_table(df, "v").collect()}
    monkeypatch.setattr(FE, "FEW_VALUES", 1)
    assert few == {"a": 0, "b": 1, "c": 2, "nan": 3} == {r["_value"]: r["v_encoded"] for r in FE.code_table(df, "v").collect()}


def test_group_folds_agree_for_any_number_of_groups(spark, monkeypatch):
    from claimlens.operators import folds as FD
    df = spark.createDataFrame([(i, f"g{i % 9}", int(i % 9 in (0, 1, 2, 3))) for i in range(45)], "id long, g string, y int")
    one = {(r["id"], r["fold"]) for r in FD.group_folds(df, "g", "y", 4).collect()}
    monkeypatch.setattr(FD, "FEW_GROUPS", 0)
    assert one == {(r["id"], r["fold"]) for r in FD.group_folds(df, "g", "y", 4).collect()}
    with pytest.raises(ValueError, match="after 3"):
        FD.group_folds(df.where("y = 1"), "g", "y", 4, max_attempts=3)


def test_first_trees_are_the_smaller_ensemble(spark):
    from pyspark.ml.classification import GBTClassifier, RandomForestClassifier
    from pyspark.ml.feature import VectorAssembler
    rng = np.random.default_rng(4)
    rows = [(i, *rng.normal(size=3).tolist(), float(rng.random() < 0.5), i % 2, 1.0) for i in range(80)]
    d = spark.createDataFrame(rows, "id long, a double, b double, c double, label double, fold int, weight double")
    d = VectorAssembler(inputCols=["a", "b", "c"], outputCol="features").transform(d).cache()
    score = lambda m: [round(float(r["probability"][1]), 12) for r in m.transform(d).orderBy("id").select("probability").collect()]
    big, small = (GBTClassifier(maxIter=n, maxDepth=2, stepSize=0.2, subsamplingRate=0.8, seed=3).fit(d) for n in (8, 3))
    assert score(M.first_trees(big, 3)) == score(small) != score(big)
    forest = RandomForestClassifier(numTrees=6, maxDepth=3, seed=3).fit(d)
    part = M.first_trees(forest, 2)
    trees = [t.transform(d).orderBy("id").select("probability").collect() for t in forest.trees[:2]]
    assert score(part) == [round((float(x["probability"][1]) + float(y["probability"][1])) / 2, 12) for x, y in zip(*trees, strict=True)]
    gb = GBTClassifier(featuresCol="features", labelCol="label", seed=1)
    points = [{gb.maxIter: n, gb.maxDepth: k} for n in (2, 4) for k in (1, 2)]
    fast = M.cross_validate_prefixes(d, [], gb, points, gb.maxIter, folds=2)
    slow = M.cross_validate(d, [], [(gb, p) for p in points], folds=2)
    assert np.allclose(fast, slow, atol=1e-9)


def test_texts_are_split_once_for_all_folds(spark):
    """The stages that learn nothing are applied once; the scores are those of a pipeline fitted a fold."""
    words = ["solar", "coal", "wind", "offset", "audit", "target", "the"]
    rows = [(i, " ".join(words[(i * 7 + j * j) % 7] for j in range(i % 5 + 1)), float(i % 3 == 0), 1.0, i // 2 % 3) for i in range(60)]
    df = spark.createDataFrame(rows, "id long, t string, label double, weight double, fold int")
    stages = M.feature_stages("t", [], [], vocab_size=50)
    made, left = M.prepared(df, stages)
    assert "_terms" in made.columns and not {"t", "_tok", "_w1"} & set(made.columns)
    assert type(left[0]).__name__ == "CountVectorizer" and M.prepared(made, left)[1] == left
    est = M.logistic(reg=0.1)
    got = {r["id"]: (r["fold"], r["score"]) for r in M.out_of_fold(df, stages, est, "id", 3).collect()}
    for f in range(3):
        model = M.fit_pipeline(df.where(F.col("fold") != f), stages, est)
        for r in M.scored(model.transform(df.where(F.col("fold") == f)), "id").collect():
            assert got[r["id"]][0] == f and abs(got[r["id"]][1] - r["score"]) < 1e-6
    assert len(got) == 60
    models = M.calibrated_models(df, stages, est, "id", 3)
    assert M.calibrated_scores(models, df.drop("fold"), "id").count() == 60  # the models take whole texts


def test_fit_pipeline_splits_the_texts_twice(spark):
    read = spark.sparkContext.accumulator(0)

    @F.udf("string")
    def seen(t):
        read.add(1)
        return t
    rows = [(i, f"word{i % 7} stone {'tree' if i % 2 else 'lake'}", float(i % 2), 1.0, float(i)) for i in range(40)]
    df = spark.createDataFrame(rows, "id long, t string, label double, weight double, v double").withColumn("t", seen("t"))
    m = M.fit_pipeline(df, M.feature_stages("t", [], ["v"], vocab_size=50), M.logistic(weight_col="weight", reg=0.1))
    assert read.value <= 2 * len(rows)  # for the vocabulary and for the counts; five times before
    assert m.transform(df).where("prediction = label").count() == len(rows)
