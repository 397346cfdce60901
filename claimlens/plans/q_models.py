"""Model queries (I2, J4-J14, J21, J25-J28): ``pyspark.ml`` training on the labelled document claims.

These are iterative algorithms, so they carry no SQL oracle (rows-only check);
``tests/test_models.py`` checks their properties.
"""

from __future__ import annotations

from concurrent.futures import ThreadPoolExecutor

from pyspark.sql import functions as F

from claimlens.operators import curves as CV
from claimlens.operators import encoder as EN
from claimlens.operators import foldstore as FS
from claimlens.operators import neighbours as NB
from claimlens.operators import models as M
from claimlens.operators import risk as RK
from claimlens.operators.balance import smote
from claimlens.operators.features import value_features
from claimlens.operators.folds import rank_within, stratified_split, with_class_weight
from claimlens.plans.registry import register
from claimlens.plans.sqlparts import TXT
from claimlens.session import materialize, written
from claimlens.sources.claims import claims_txt
from claimlens.sources.tables import table

TEXT = "esg_claim_text"
SVD_K = 100
CATS = ["claimed_metric_type", "project_location"]
NUMS = ["claimed_value", "actual_measured_value", "external_validation_score", "report_year"]


def labelled(spark, sf):
    """Labelled claims with split, fold and balanced class weight columns."""
    c = claims_txt(spark, sf).where(F.col("greenwashing_flag").isNotNull())
    c = materialize(M.prepare(c, NUMS, CATS, "greenwashing_flag", TEXT).select(
        "claim_id", TEXT, *CATS, *NUMS, "label", "claim_category"))
    # one ranking pass gives both the 80/20 split and the 5 folds
    r = rank_within(c, "claim_id", "label", 42)
    r = r.withColumns({"split": F.when(F.col("_rank") <= ((F.col("_n") * 20 + 99) / 100).cast("long"), F.lit("test"))
                                 .otherwise(F.lit("train")),
                       "fold": ((F.col("_rank") - 1) % 5).cast("int")}).drop("_rank", "_n")
    return materialize(with_class_weight(r, "label"))


def stages():
    return M.feature_stages(TEXT, CATS, NUMS, vocab_size=1000)


def _lr_train(spark, sf):
    d = labelled(spark, sf)
    train, test = d.where(F.col("split") == "train"), d.where(F.col("split") == "test")
    m = M.fit_pipeline(train, stages(), M.logistic(weight_col="weight"))
    return M.scored(m.transform(test), "claim_id")


def _lr_grid(spark, sf):
    d = labelled(spark, sf).where(F.col("split") == "train")
    _, table = M.grid_search(d, stages(), n=None)
    return table


def _compare(spark, sf):
    d = labelled(spark, sf)
    return M.compare_models(_part(d, "train"), _part(d, "test"), stages(), "claim_id", oversample=True)


def _train_test(spark, sf):
    d = labelled(spark, sf)
    return M.train_test_auc(_part(d, "train"), _part(d, "test"), stages(), "claim_id")


def _part(d, name):
    return d.where(F.col("split") == name)


def _oof(spark, sf):
    """Out-of-fold scores of the training part; the test part stays unseen."""
    return M.out_of_fold(_part(labelled(spark, sf), "train"), stages(), M.logistic(weight_col="weight"), "claim_id", 5)


def _calibrate(spark, sf):
    """The test part under the mean of five calibrated models of the training part."""
    d = labelled(spark, sf)
    models = M.calibrated_models(_part(d, "train"), stages(), M.logistic(weight_col="weight"), "claim_id")
    return M.calibrated_scores(models, _part(d, "test"), "claim_id")


STORE_CATS = ["claim_category", "project_location", "claimed_metric_type"]
STORE_NUMS = ["claimed_value", "actual_measured_value", "report_year", "abs_value_deviation", "rel_value_deviation"]
GRID = [FS.Point(c, p) for c in M.C_GRID for p in M.PENALTIES]


def _store(spark, sf, sets, claims=None):
    """The labelled claims as a feature store: nothing learns from the test part (fold ``FS.TEST``)."""
    d = (labelled(spark, sf) if claims is None else claims).withColumn("value_deviation", F.col("actual_measured_value") - F.col("claimed_value"))
    d = value_features(d).withColumn("fold", F.when(F.col("split") == "test", F.lit(FS.TEST)).otherwise(F.col("fold")))
    return FS.build(d, "claim_id", "label", TEXT, STORE_CATS, STORE_NUMS, sets, max_features=2000, ngrams=2, k=SVD_K)


def _calibrated(spark, sf):
    return FS.nested_calibration(_store(spark, sf, FS.nested_sets(5)), GRID)


def _calibrated_threshold(spark, sf):
    """SVD of the texts, grid, calibration; the threshold for recall 0.8 from the training part's out-of-fold
    calibrated scores, and the test part's metrics at that threshold."""
    out = _calibrated(spark, sf)
    chosen = CV.threshold_for_recall(out["oof"].select("label", F.col("calibrated").alias("score")), 0.8)
    best = out["chosen"][FS.TEST]
    cut = chosen.select(F.coalesce("threshold", "threshold_unshifted").alias("cut"))
    judged = out["test"].crossJoin(F.broadcast(cut)).select(
        "label", F.col("calibrated").alias("score"), (F.col("calibrated") >= F.col("cut")).cast("int").alias("pred"))
    metrics = CV.binary_metrics(judged, score="score").toDF(*[f"test_{c}" for c in ["accuracy", "precision", "recall", "f1", "roc_auc", "gini"]])
    return chosen.crossJoin(metrics).withColumns({"C": F.lit(float(best.c)), "penalty": F.lit(best.penalty)})


def _calibrated_grid(spark, sf):
    """J4 inside J23: the mean AUC of every grid point over folds that its models have not seen."""
    return _calibrated(spark, sf)["grid"].withColumn("mean_auc", F.round("mean_auc", 6))


def _calibrated_scores(spark, sf):
    """J14 inside J23: out-of-fold calibrated score of every training claim, and that of every test claim."""
    out = _calibrated(spark, sf)
    both = out["oof"].withColumn("part", F.lit("out_of_fold")).unionByName(out["test"].withColumn("part", F.lit("test")))
    return both.select(F.col("id").alias("claim_id"), "label", F.round("calibrated", 6).alias("calibrated"), "models", "part")


def _cv_scores(spark, sf):
    """Per-fold ROC-AUC of the out-of-fold scores plus mean and population std."""
    oof = _oof(spark, sf)
    per = None
    for f in range(5):
        a = CV.roc_auc(oof.where(F.col("fold") == f)).select(F.lit(f).alias("fold"), "roc_auc")
        per = a if per is None else per.unionByName(a)
    summ = per.agg(F.round(F.avg("roc_auc"), 6).alias("mean_auc"), F.round(F.stddev_pop("roc_auc"), 6).alias("std_auc"))
    return per.crossJoin(summ)


def _importance(spark, sf):
    d = labelled(spark, sf).where(F.col("split") == "train")
    m = M.fit_pipeline(d, stages(), M.logistic(weight_col="weight"))
    return M.coefficients(m, d, 20)


def _category_scored(spark, sf):
    """The category model of four fifths of the claims (per category), and its predictions of the rest."""
    from pyspark.ml.feature import StringIndexer
    c = claims_txt(spark, sf).where(F.col("claim_category").isNotNull())
    c = M.prepare(c, NUMS, CATS, "greenwashing_flag", TEXT).select("claim_id", TEXT, *NUMS, "claim_category")
    c = materialize(stratified_split(c, "claim_id", "claim_category"))
    idx = StringIndexer(inputCol="claim_category", outputCol="label", stringOrderType="alphabetAsc").fit(c)
    c = idx.transform(c)
    m = M.fit_pipeline(_part(c, "train"), M.feature_stages(TEXT, [], NUMS, vocab_size=1000),
                       M.logistic(weight_col=None, family="multinomial"))
    test = _part(c, "test")
    return test.select("claim_id", "claim_category"), M.category_predictions(m, test, "claim_id", idx.labels)


def _category(spark, sf):
    """Predictions of unseen claims with their class probabilities."""
    got = _category_scored(spark, sf)[1]
    shown = F.array_sort(F.transform(F.map_entries("probabilities"), lambda e: F.format_string("%s=%.6f", e["key"], e["value"])))
    return got.select("claim_id", "category", F.round("confidence", 6).alias("confidence"), F.array_join(shown, "|").alias("probabilities"), "error")


def _category_unknown(spark, sf):
    """J27 without a model: every claim is ``Unknown``."""
    return M.category_predictions(None, claims_txt(spark, sf, ["claim_id"]), "claim_id", []).drop("probabilities")


def _flag_unknown(spark, sf):
    """J28 without a model: no claim is flagged."""
    return M.flag_predictions(None, claims_txt(spark, sf, ["claim_id"]), "claim_id").drop("probability")


def _training_results(spark, sf):
    """J25 over models and tasks: test accuracy and F1 of the sparse and of the dense (singular directions) text models on both tasks, and
    the state of the retrieval tables."""
    from claimlens.plans.q_retrieval import corpus_chunks
    d = labelled(spark, sf)

    def sparse_flag():
        return CV.binary_metrics(M.scored(M.fit_pipeline(_part(d, "train"), stages(), M.logistic(weight_col="weight")).transform(_part(d, "test")), "claim_id"))

    def dense_category():
        from pyspark.ml.feature import StringIndexer
        from pyspark.ml.functions import array_to_vector
        c = claims_txt(spark, sf, ["claim_id", TEXT, "claim_category"]).where(F.col("claim_category").isNotNull())
        c = materialize(stratified_split(c, "claim_id", "claim_category").withColumn("fold", F.when(F.col("split") == "test", F.lit(FS.TEST)).otherwise(F.lit(0))))
        c = StringIndexer(inputCol="claim_category", outputCol="label", stringOrderType="alphabetAsc").fit(c).transform(c)
        store = FS.build(c, "claim_id", "label", TEXT, [], [], [frozenset({FS.TEST})], max_features=2000, ngrams=2, k=SVD_K).table
        dense = store.select("fold", "label", array_to_vector("x").alias("features"))
        m = M.logistic(weight_col=None, family="multinomial", reg=1e-3).fit(dense.where(F.col("fold") != FS.TEST))
        return CV.multiclass_metrics(m.transform(dense.where(F.col("fold") == FS.TEST)), "label", "prediction")

    asked = [("sparse", "greenwash", sparse_flag), ("dense", "greenwash", lambda: _svd_lr(spark, sf, d)),
             ("sparse", "category", lambda: _category_metrics(spark, sf)), ("dense", "category", dense_category)]
    with ThreadPoolExecutor(len(asked)) as pool:  # each thread only starts Spark jobs; their short iterations wait for each other
        made = list(pool.map(lambda a: materialize(a[2]().select(F.lit(a[0]).alias("model"), F.lit(a[1]).alias("task"), "accuracy", "f1")), asked))
    rows = list(made)
    out = rows[0]
    for r in rows[1:]:
        out = out.unionByName(r)
    out = out.withColumns({"status": F.lit("trained"), "message": F.lit(None).cast("string")})
    n = corpus_chunks(spark, sf).agg(F.count(F.lit(1)).alias("n"))
    return out.unionByName(n.select(F.lit("retrieval").alias("model"), F.lit("rag").alias("task"), F.lit(None).cast("double").alias("accuracy"),
                                    F.lit(None).cast("double").alias("f1"), F.when(F.col("n") > 0, F.lit("ready")).otherwise(F.lit("empty")).alias("status"),
                                    F.concat(F.col("n").cast("string"), F.lit(" chunks")).alias("message")))


def _experiment(spark, sf):
    d = labelled(spark, sf)
    return M.experiment_record(_part(d, "train"), _part(d, "test"), stages(), "claim_id")


def _category_metrics(spark, sf):
    """Accuracy and weighted precision, recall and F1 of the category model on unseen claims."""
    truth, got = _category_scored(spark, sf)
    return CV.multiclass_metrics(truth.join(got, "claim_id"), "claim_category", "category")


def _analysis(spark, sf):
    """H14 with fitted models: both learn from the train part; claims of the test part get their
    probabilities, the blended risk, the alert and the recommendations."""
    from pyspark.ml import Pipeline
    d = labelled(spark, sf)
    features = Pipeline(stages=stages()).fit(_part(d, "train"))
    made = materialize(features.transform(d).select("claim_id", "features", "label", "weight", "split"))
    probability = None
    for column, name in (("gb", "GradientBoosting"), ("lr", "LogisticRegression")):
        m = M.classifiers()[name].fit(_part(made, "train"))
        s = M.scored(m.transform(_part(made, "test")), "claim_id").select("claim_id", F.col("score").alias(column))
        probability = s if probability is None else probability.join(s, "claim_id")
    out = RK.analyze_claims(_part(d, "test").select("claim_id", TEXT).join(probability, "claim_id"), gb="gb", lr="lr")
    return out.select("claim_id", *[F.round(c, 6).alias(c) for c in
                                    ("greenwashing_risk_gb", "greenwashing_risk_lr", "text_risk_score", "rag_risk_score", "overall_risk_score")],
                      "risk_level", "fraud_alert", F.concat_ws("|", "recommendations").alias("recommendations"))


def _flag(spark, sf):
    d = labelled(spark, sf)
    m = M.fit_pipeline(d.where(F.col("split") == "train"), stages(), M.logistic(weight_col="weight"))
    allc = materialize(M.prepare(claims_txt(spark, sf), NUMS, CATS, "greenwashing_flag", TEXT))
    return M.flag_predictions(m, allc, "claim_id")


def _svd(spark, sf):
    """All claims' texts on 100 singular directions of the TF-IDF of one- and two-word terms."""
    c = claims_txt(spark, sf).select("claim_id", TEXT, F.lit(0).alias("fold"), F.lit(0.0).alias("label"))
    store = FS.build(c, "claim_id", "label", TEXT, [], [], [frozenset()], max_features=2000, ngrams=2, k=SVD_K)
    return store.table.select(F.col("id").alias("claim_id"), F.col("x").alias("svd"))


def _svd_lr(spark, sf, claims=None):
    """I2 into J11: directions and scales learned on the training part feed the regression; held-out metrics."""
    store = _store(spark, sf, [frozenset({FS.TEST})], claims)
    learn = written(store.table.filter(FS.learning(store.sets)).withColumn("t", F.col("label")), "svd-learning")
    models = FS.fit_logistic(learn, FS.class_weights(store), {0: [FS.Point(1.0, "l2")]}, store.width)
    scored = FS.margins(store, models).select("label", F.col("margin").alias("score"), (F.col("margin") > 0).cast("int").alias("pred"))
    return CV.binary_metrics(scored, score="score")


def _summary(spark, sf):
    """Tall metrics of the compared models pivoted to one row per metric."""
    cmp = _compare(spark, sf)
    tall = cmp.select("model", F.explode(F.array(*[F.struct(F.lit(m).alias("metric"), F.col(m).alias("value"))
                                                   for m in ["accuracy", "precision", "recall", "f1", "roc_auc"]]))
                      .alias("e")).select("model", "e.*")
    return tall.groupBy("metric").pivot("model").agg(F.first("value"))


register("lr_train")(_lr_train)
register("lr_grid")(_lr_grid)
register("model_compare")(_compare)
register("train_test_auc")(_train_test)
register("oof_scores")(_oof)
register("calibrate")(_calibrate)
register("calibrated_threshold")(_calibrated_threshold)
register("calibrated_grid")(_calibrated_grid)
register("calibrated_scores")(_calibrated_scores)
register("cv_scores")(_cv_scores)
register("feature_importance")(_importance)
register("category_predict")(_category)
register("category_without_model", TXT + "SELECT claim_id, 'Unknown' AS category, CAST(0 AS DOUBLE) AS confidence, 'No model loaded' AS error FROM claims")(_category_unknown)
register("flag_without_model", TXT + "SELECT claim_id, false AS is_greenwashing, CAST(0 AS DOUBLE) AS confidence, 'No model loaded' AS error FROM claims")(_flag_unknown)
register("training_results")(_training_results)
register("experiment_record")(_experiment)
register("category_metrics")(_category_metrics)
register("claim_analysis_models")(_analysis)
register("flag_predict")(_flag)
register("svd_features")(_svd)
register("svd_lr")(_svd_lr)
register("training_summary")(_summary)

# ---------------------------------------------------------------- I8 SMOTE on the embedding table
def _smote(spark, sf):
    e = table(spark, sf, "embeddings").withColumn("is_zero", (F.col("label") == 0).cast("int"))
    return smote(e, "vec_id", "embedding", "is_zero", minority=1, k=5, seed=42)


register("smote")(_smote)


NEIGHBOURS_SQL = """
WITH e AS (SELECT vec_id, CAST(embedding AS DOUBLE[]) AS v FROM embeddings
           WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR isnan(x) OR isinf(x))) = 0),
d AS (SELECT a.vec_id, b.vec_id AS neighbour_id, list_distance(a.v, b.v) AS d FROM e a JOIN e b ON a.vec_id <> b.vec_id)
SELECT vec_id, CAST(row_number() OVER w AS INTEGER) AS rank, neighbour_id, floor(d * 1e6 + 0.5) / 1e6 AS distance FROM d
WINDOW w AS (PARTITION BY vec_id ORDER BY d, neighbour_id) QUALIFY row_number() OVER w <= 5
"""


def _neighbours(spark, sf):
    """The five nearest other rows of every embedding."""
    rows = NB.usable(table(spark, sf, "embeddings"), "vec_id", "embedding")
    ids = rows.select("uid", F.col("id").alias("vec_id"))
    out = NB.neighbours(rows, 5).join(ids, "uid").join(ids.toDF("other", "neighbour_id"), "other")
    return out.select("vec_id", "rank", "neighbour_id", (F.floor(F.col("distance") * 1e6 + 0.5) / 1e6).alias("distance"))


register("nearest_neighbours", NEIGHBOURS_SQL)(_neighbours)


# ---------------------------------------------------------------- C24 importance distribution
def _importance_dist(spark, sf):
    d = labelled(spark, sf).where(F.col("split") == "train")
    m = M.fit_pipeline(d, stages(), M.logistic(weight_col="weight"))
    coef = M.coefficients(m, d, None)
    return coef.agg(F.count_if(F.abs("coefficient") > 0).alias("n_nonzero"),
                    F.round(F.avg(F.abs("coefficient")), 6).alias("mean_abs"),
                    F.round(F.max(F.abs("coefficient")), 6).alias("max_abs"))


register("importance_distribution")(_importance_dist)


def _importance_signed(spark, sf):
    """The 20 largest coefficients of either sign."""
    d = labelled(spark, sf).where(F.col("split") == "train")
    m = M.fit_pipeline(d, stages(), M.logistic(weight_col="weight"))
    return M.signed_importance(M.coefficients(m, d, None), 20)


register("importance_signed")(_importance_signed)


# ---------------------------------------------------------------- D7 + J7 + J8 + J26
def _tune(spark, sf):
    d = labelled(spark, sf)
    train, test = d.where(F.col("split") == "train"), d.where(F.col("split") == "test")
    return M.tune_winner(train, test, stages(), "claim_id", oversample=True)


register("tune_winner")(_tune)


# ---------------------------------------------------------------- I6/I7/J12: embedding vector + scaled numerics
def _representation_lr(d, id_col, embedding, text, numeric):
    """Held-out metrics of the regression over the embedding, or over TF-IDF where there is none."""
    st, used = M.representation_stages(d, embedding, text, [], numeric)
    m = M.fit_pipeline(d.where(F.col("split") == "train"), st, M.logistic(weight_col="weight"))
    s = M.scored(m.transform(d.where(F.col("split") == "test")), id_col)
    return CV.binary_metrics(s, score="score").withColumn("feature_type", F.lit(used))


def _embedding_lr(spark, sf):
    """Precomputed embeddings as the text representation (binary target: label 0 vs rest)."""
    from pyspark.ml.functions import array_to_vector
    from claimlens.sources.tables import table
    e = table(spark, sf, "embeddings")
    d = e.select("vec_id", (F.col("label") == 0).cast("double").alias("label"),
                 F.aggregate(F.col("embedding").cast("array<double>"), F.lit(0.0), lambda a, x: a + x * x)
                 .alias("sq_norm"),
                 array_to_vector(F.col("embedding").cast("array<double>")).alias("emb"))
    d = materialize(with_class_weight(d, "label"))
    r = rank_within(d, "vec_id", "label", 42)
    d = r.withColumn("split", F.when(F.col("_rank") <= ((F.col("_n") * 20 + 99) / 100).cast("long"), F.lit("test"))
                     .otherwise(F.lit("train"))).drop("_rank", "_n")
    return _representation_lr(d, "vec_id", "emb", TEXT, ["sq_norm"])


def _fallback_lr(spark, sf):
    """Claims carry no embedding column, so their texts' TF-IDF is used."""
    return _representation_lr(labelled(spark, sf), "claim_id", "emb", TEXT, NUMS)


def _encoded_lr(spark, sf):
    """The regression over vectors that a pluggable encoder makes of the claim texts in the tasks."""
    d = labelled(spark, sf)
    d = EN.as_vector(EN.encode(d, TEXT, "hashing-128", EN.hashing_encoder(128), 128, "emb"), "emb")
    return _representation_lr(materialize(d), "claim_id", "emb", TEXT, NUMS)


register("embedding_lr")(_embedding_lr)
register("encoded_lr")(_encoded_lr)
register("embedding_fallback_lr")(_fallback_lr)
