"""Model training, tuning, calibration and scoring with ``pyspark.ml``.

Every estimator trains distributed (treeAggregate / tree learners); the only
driver-side objects are model coefficients and metric lists, whose size is set
by the feature width, not by the data.
"""

from __future__ import annotations

from collections.abc import Sequence
from concurrent.futures import ThreadPoolExecutor

import numpy as np
from pyspark import SparkContext
from pyspark.ml import Estimator, Pipeline, PipelineModel
from pyspark.ml.classification import (GBTClassificationModel, GBTClassifier, LinearSVC, LogisticRegression,
                                       RandomForestClassificationModel, RandomForestClassifier)
from pyspark.ml.evaluation import BinaryClassificationEvaluator
from pyspark.ml.feature import (IDF, CountVectorizer, ElementwiseProduct, Imputer, NGram, Normalizer, OneHotEncoder,
                                RegexTokenizer, SQLTransformer, StandardScaler, StopWordsRemover, StringIndexer,
                                VectorAssembler)
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.ml.linalg import Vectors
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from claimlens.functions.text import TOKEN, english_stop_words
from claimlens.operators import boosting as BO
from claimlens.operators import curves as CV
from claimlens.operators.balance import smote
from claimlens.session import materialize, written

# The regularisation grid (C values and penalties) of the calibrated model.
C_GRID = [0.01, 0.1, 1, 10, 100]
PENALTIES = ["l1", "l2"]


class SmoothedIdf(Estimator):
    """Weights term counts by ln((1 + n) / (1 + df)) + 1, the weight of the corpus vectors (G4): a term of
    every text keeps weight 1."""

    def __init__(self, source: str, target: str):
        super().__init__()
        self.source, self.target = source, target

    def _fit(self, df: DataFrame) -> ElementwiseProduct:
        idf = IDF(inputCol=self.source, outputCol=self.target).fit(df).idf
        return ElementwiseProduct(scalingVec=Vectors.dense(idf.toArray() + 1.0), inputCol=self.source, outputCol=self.target)


class PopulationScaler(Estimator):
    """Centres each column and divides it by its population standard deviation (a constant column becomes
    0).  Spark's scaler takes the sample deviation; the ratio of the two depends on the row count only."""

    def __init__(self, source: str, target: str, width: int):
        super().__init__()
        self.source, self.target, self.width = source, target, width

    def _fit(self, df: DataFrame) -> PipelineModel:
        n = df.count()
        ratio = (n / (n - 1)) ** 0.5 if n > 1 else 1.0
        sample = StandardScaler(inputCol=self.source, outputCol=f"{self.target}_s", withMean=True, withStd=True).fit(df)
        return PipelineModel([sample, ElementwiseProduct(scalingVec=Vectors.dense([ratio] * self.width),
                                                         inputCol=f"{self.target}_s", outputCol=self.target)])


def text_stages(text: str, vocab_size: int, min_df: float, max_df: float, ngrams: int = 1) -> list:
    """Terms of up to ``ngrams`` words, their counts, smoothed IDF weights and unit length (``_text_vec``)."""
    stages = [RegexTokenizer(inputCol=text, outputCol="_tok", pattern=TOKEN, gaps=False, minTokenLength=2),
              StopWordsRemover(inputCol="_tok", outputCol="_w1", stopWords=english_stop_words())]
    stages += [NGram(n=n, inputCol="_w1", outputCol=f"_w{n}") for n in range(2, ngrams + 1)]
    # Spark reads a largest document frequency of 1.0 as "one document"; here it is the share of all documents
    most = {"maxDF": max_df} if max_df < 1.0 else {}
    terms = ", ".join(f"_w{n}" for n in range(1, ngrams + 1))
    return [*stages, SQLTransformer(statement=f"SELECT *, concat({terms}) AS _terms FROM __THIS__"),
            CountVectorizer(inputCol="_terms", outputCol="_tf", vocabSize=vocab_size, minDF=min_df, **most),
            SmoothedIdf("_tf", "_tfidf"), Normalizer(inputCol="_tfidf", outputCol="_text_vec", p=2.0)]


def feature_stages(text: str | None, categorical: Sequence[str], numeric: Sequence[str],
                   vocab_size: int = 1000, min_df: float = 1.0, max_df: float = 1.0,
                   embedding: str | None = None, out: str = "features", ngrams: int = 1) -> list:
    """Text TF-IDF (L2-normalised) + one-hot categoricals (unseen -> all zeros) +
    imputed, standardised numerics (+ an optional precomputed embedding vector)."""
    stages, parts = [], []
    if text:
        stages += text_stages(text, vocab_size, min_df, max_df, ngrams)
        parts.append("_text_vec")
    for c in categorical:
        # an unseen value gets the index behind the known ones, which the encoder drops: all zeros
        stages += [StringIndexer(inputCol=c, outputCol=f"_{c}_idx", handleInvalid="keep", stringOrderType="alphabetAsc"),
                   OneHotEncoder(inputCol=f"_{c}_idx", outputCol=f"_{c}_oh", dropLast=True, handleInvalid="error")]
        parts.append(f"_{c}_oh")
    if numeric:
        imp = [f"_{c}_imp" for c in numeric]
        stages += [Imputer(inputCols=list(numeric), outputCols=imp, strategy="median"),
                   VectorAssembler(inputCols=imp, outputCol="_num_raw", handleInvalid="keep"),
                   PopulationScaler("_num_raw", "_num", len(imp))]
        parts.append("_num")
    if embedding:
        parts.append(embedding)
    stages.append(VectorAssembler(inputCols=parts, outputCol=out))
    return stages


def representation_stages(df: DataFrame, embedding: str, text: str, categorical: Sequence[str], numeric: Sequence[str],
                          **options) -> tuple[list, str]:
    """The stages over the ``embedding`` vector when the table has that column, else over the TF-IDF
    of ``text``; with the name of the representation used."""
    if embedding in df.columns:
        return feature_stages(None, categorical, numeric, embedding=embedding, **options), "embedding"
    return feature_stages(text, categorical, numeric, **options), "tfidf"


def prepare(df: DataFrame, numeric: Sequence[str], categorical: Sequence[str], label: str = "label",
            text: str | None = None) -> DataFrame:
    """Cast numerics to double, categoricals to string (NULL -> 'unknown'), label to double."""
    out = df.withColumns({c: F.col(c).cast("double") for c in numeric})
    out = out.withColumns({c: F.coalesce(F.col(c).cast("string"), F.lit("unknown")) for c in categorical})
    if text:
        out = out.withColumn(text, F.coalesce(F.col(text), F.lit("")))
    return out.withColumn("label", F.col(label).cast("double"))


def c_to_reg(c: float, n: int) -> float:
    """sklearn's inverse regularisation C corresponds to regParam = 1 / (C n)."""
    return 1.0 / (c * max(n, 1))


def logistic(weight_col: str | None = "weight", reg: float = 0.0, l1: bool = False,
             family: str = "auto", max_iter: int = 100) -> LogisticRegression:
    lr = LogisticRegression(featuresCol="features", labelCol="label", regParam=reg,
                            elasticNetParam=1.0 if l1 else 0.0, family=family, maxIter=max_iter)
    if weight_col:
        lr.setWeightCol(weight_col)
    return lr


def prob1(col: str = "probability"):
    """P(class 1) from a probability vector."""
    return vector_to_array(F.col(col))[1]


def _inputs(stages: list) -> set:
    """The columns that stages read."""
    return {c for s in stages for c in ([s.source] if isinstance(s, (SmoothedIdf, PopulationScaler)) else
                                        [*([s.getInputCol()] if s.hasParam("inputCol") and s.isDefined("inputCol") else []),
                                         *(s.getInputCols() if s.hasParam("inputCols") and s.isDefined("inputCols") else [])])}


def fit_pipeline(df: DataFrame, stages: list, estimator) -> PipelineModel:
    """The fitted stages and estimator.  The texts are split for the vocabulary and for the term counts, which are written: the stages behind
    them and the estimator's passes read these and no text."""
    n = next((i + 1 for i, s in enumerate(stages) if isinstance(s, CountVectorizer)), 0)
    if not n:
        return Pipeline(stages=[*stages, estimator]).fit(df)
    terms, rest = Pipeline(stages=stages[:n]).fit(df), [*stages[n:], estimator]
    asked = _inputs(rest) | {estimator.getOrDefault(p) for p in ("labelCol", "weightCol") if estimator.hasParam(p) and estimator.isDefined(p)}
    made = terms.transform(df)
    counts = gathered(written(made.select(*[c for c in made.columns if c in asked]), "term-counts"))
    return PipelineModel([*terms.stages, *Pipeline(stages=rest).fit(counts).stages])


def prepared(df: DataFrame, stages: list) -> tuple[DataFrame, list]:
    """The leading stages that learn nothing (tokens, stop words, n-grams) applied once and written, with the stages left: the fits and
    folds that follow do not split the texts again."""
    n = next((i for i, s in enumerate(stages) if isinstance(s, Estimator)), len(stages))
    if not n:
        return df, list(stages)
    made = Pipeline(stages=stages[:n]).fit(df).transform(df)
    asked = _inputs(stages[n:])
    read = {s.getInputCol() for s in stages[:n] if s.hasParam("inputCol")} | (set(made.columns) - set(df.columns))
    return materialize(made.drop(*[c for c in made.columns if c in read - asked])), list(stages[n:])


#: Folds and grid points that are fitted at a time: their iterations are short jobs that wait for each other.
AT_A_TIME = 8
#: Rows a partition of what iterations read: each of them is a job with a task a partition, and a second stage that adds up many partitions.
ROWS_A_TASK = 1 << 15


def gathered(df: DataFrame) -> DataFrame:
    """``df``, which is written, in partitions of about ``ROWS_A_TASK`` rows, for fits of many short passes."""
    return df.coalesce(max(1, -(-df.count() // ROWS_A_TASK)))


def fitted(est, df: DataFrame, point: dict | None = None):
    """``est`` fitted on the written rows ``df``.  Boosted trees of a bounded table are learned in one task, without Spark's jobs a level of
    a tree; everything else by Spark."""
    point = point or {}
    if not isinstance(est, GBTClassifier) or est.isDefined(est.weightCol) or est.isDefined(est.validationIndicatorCol) or BO.entries(df) > BO.MOST:
        # a forest draws its rows by partition, so it keeps those of the table; it makes few passes
        return est.fit(df if isinstance(est, (RandomForestClassifier, GBTClassifier)) else gathered(df), point)
    at = lambda p: point.get(p, est.getOrDefault(p))
    return BO.fit(df, at(est.maxIter), at(est.maxDepth), at(est.stepSize), at(est.subsamplingRate), at(est.minInstancesPerNode), at(est.maxBins), at(est.seed))


def fold_features(train: DataFrame, stages: list, folds: int, keep: Sequence[str]) -> list[tuple[DataFrame, DataFrame]]:
    """(other folds, fold) of every fold as written features, learned from the other folds; the texts are split once for all folds."""
    train, stages = prepared(train, stages)

    def one(f: int) -> tuple[DataFrame, DataFrame]:
        features = Pipeline(stages=stages).fit(train.where(F.col("fold") != f))
        made = materialize(features.transform(train).select(*[c for c in keep if c == "features" or c in train.columns]))
        return made.where(F.col("fold") != f), made.where(F.col("fold") == f)

    with ThreadPoolExecutor(max(1, min(folds, AT_A_TIME))) as pool:  # each thread only starts Spark jobs
        return list(pool.map(one, range(folds)))


def cross_validate(train: DataFrame, stages: list, candidates: Sequence[tuple], folds: int = 5, parallelism: int = AT_A_TIME,
                   each_fold: bool = False) -> list[float] | np.ndarray:
    """Mean ROC-AUC of every ``(estimator, params)`` over the folds of the ``fold`` column (a row a fold with ``each_fold``).

    The features of a fold are fitted once, on its other folds, and written; all candidates of all folds read them,
    ``parallelism`` of them at a time.
    """
    evaluator = BinaryClassificationEvaluator(labelCol="label", metricName="areaUnderROC")
    made = fold_features(train, stages, folds, ["features", "label", "weight", "fold"])
    with ThreadPoolExecutor(parallelism) as pool:  # each thread only starts Spark jobs
        auc = list(pool.map(lambda a: evaluator.evaluate(fitted(a[1][0], a[0][0], a[1][1]).transform(a[0][1])), [(part, c) for part in made for c in candidates]))
    auc = np.array(auc).reshape(folds, len(candidates))
    return auc if each_fold else [float(x) for x in np.mean(auc, axis=0)]


def grid_search(train: DataFrame, stages: list, folds: int = 5, n: int | None = None,
                c_grid: Sequence[float] = C_GRID, penalties: Sequence[str] = PENALTIES):
    """Cross-validated grid over C x penalty by ROC-AUC; folds come from a ``fold`` column.

    Returns ``(model, table)``: the pipeline with the best mean (the first of equal ones) fitted on all
    of ``train``, and rows (C, penalty, regParam, mean_auc).  C counts rows, so a fold's fits use the
    number of rows they learn from.
    """
    lr = logistic(weight_col="weight")
    n = n or train.count()
    points = [(float(c), pen) for c in c_grid for pen in penalties]
    at = lambda c, pen, rows: {lr.regParam: c_to_reg(c, rows), lr.elasticNetParam: 1.0 if pen == "l1" else 0.0}
    auc = cross_validate(train, stages, [(lr, at(c, pen, n * (folds - 1) // folds)) for c, pen in points], folds)
    best = points[int(np.argmax(auc))]
    model = fit_pipeline(train, stages, lr.copy(at(*best, n)))
    rows = [(c, pen, c_to_reg(c, n), m) for (c, pen), m in zip(points, auc)]
    return model, train.sparkSession.createDataFrame(rows, "C double, penalty string, regParam double, mean_auc double")


def classifiers(seed: int = 42) -> dict:
    """J5/J6 estimators: LR, random forest (100), gradient-boosted trees (100), linear SVM."""
    return {
        "LogisticRegression": logistic(weight_col="weight", max_iter=100),
        "RandomForest": RandomForestClassifier(featuresCol="features", labelCol="label", numTrees=100, seed=seed),
        "GradientBoosting": GBTClassifier(featuresCol="features", labelCol="label", maxIter=100, seed=seed),
        "SVM": LinearSVC(featuresCol="features", labelCol="label", maxIter=100),
    }


def scored(pred: DataFrame, id_col: str) -> DataFrame:
    """(id, label, score, pred) from a prediction frame (probability, else raw margin)."""
    if "probability" in pred.columns:
        s = prob1("probability")
    else:
        s = vector_to_array(F.col("rawPrediction"))[1]
    return pred.select(id_col, F.col("label").cast("int").alias("label"), s.alias("score"),
                       F.col("prediction").cast("int").alias("pred"))


def oversampled(df: DataFrame, id_col: str) -> DataFrame:
    """I8 inside training: the feature rows with synthetic ones of the smaller class up to the size of the larger, all of weight 1
    (``features``, ``label``, ``weight``); a table with one class stays as it is."""
    sizes = {r["label"]: r["count"] for r in df.groupBy("label").count().collect()}
    real = df.select("features", "label", F.lit(1.0).alias("weight"))
    if len(sizes) < 2:
        return real
    small = min(sizes, key=lambda y: (sizes[y], y))
    made = smote(df.select(id_col, vector_to_array("features").alias("v"), "label"), id_col, "v", "label", minority=small)
    return real.unionByName(made.select(array_to_vector("features").alias("features"), F.lit(small).alias("label"), F.lit(1.0).alias("weight")))


def compare_models(train: DataFrame, test: DataFrame, stages: list, id_col: str,
                   names: Sequence[str] | None = None, oversample: bool = False) -> DataFrame:
    """Fit the features once and each classifier on ``train`` (with synthetic rows of the smaller class for ``oversample``);
    report accuracy/precision/recall/F1/ROC-AUC on ``test``."""
    features = Pipeline(stages=stages).fit(train)
    learn, judge = (materialize(features.transform(d).select(id_col, "features", "label", "weight")) for d in (train, test))
    if oversample:
        learn = materialize(oversampled(learn, id_col))
    out = None
    asked = {name: est for name, est in classifiers().items() if not names or name in names}
    with ThreadPoolExecutor(4) as pool:  # each thread only starts Spark jobs
        made = list(pool.map(lambda est: materialize(scored(fitted(est, learn).transform(judge), id_col)), asked.values()))
    for name, s in zip(asked, made, strict=True):
        row = CV.binary_metrics(s, score="score").withColumn("model", F.lit(name))
        out = row if out is None else out.unionByName(row)
    return out.select("model", "accuracy", "precision", "recall", "f1", "roc_auc", "gini")


def train_test_auc(train: DataFrame, test: DataFrame, stages: list, id_col: str) -> DataFrame:
    """AUC and Gini on the training and on the test part, one row a model."""
    # Sizes, depths, leaf size, rate and row share of the compared models.
    lr = logistic(weight_col="weight", max_iter=1000)
    rf = RandomForestClassifier(featuresCol="features", labelCol="label", weightCol="weight", numTrees=100, maxDepth=6, minInstancesPerNode=5, seed=42)
    gb = GBTClassifier(featuresCol="features", labelCol="label", weightCol="weight", maxIter=100, maxDepth=4, stepSize=0.1, subsamplingRate=0.7, seed=42)
    features = Pipeline(stages=stages).fit(train)
    parts = {part: materialize(features.transform(d).select(id_col, "features", "label", "weight")) for part, d in (("train", train), ("test", test))}
    out = None
    for name, est in (("LogisticRegression", lr), ("RandomForest", rf), ("GradientBoosting", gb)):
        model, row = est.fit(parts["train"]), None
        for part, d in parts.items():
            a = CV.roc_auc(scored(model.transform(d), id_col)).toDF(f"{part}_auc", f"{part}_gini")
            row = a if row is None else row.crossJoin(a)
        row = row.select(F.lit(name).alias("model"), "*")
        out = row if out is None else out.unionByName(row)
    return out


def out_of_fold(df: DataFrame, stages: list, estimator, id_col: str, k: int = 5) -> DataFrame:
    """For each fold, train on the others and score the fold; union of the k scored folds."""
    made = fold_features(df, stages, k, [id_col, "features", "label", "weight", "fold"])
    with ThreadPoolExecutor(AT_A_TIME) as pool:  # each thread only starts Spark jobs
        models = list(pool.map(lambda part: fitted(estimator.copy(), part[0]), made))
    parts = None
    for f, (m, (_, held)) in enumerate(zip(models, made, strict=True)):
        s = scored(m.transform(held), id_col).withColumn("fold", F.lit(f))
        parts = s if parts is None else parts.unionByName(s)
    return parts


def _logit(c: str = "score"):
    eps = 1e-12
    return F.log((F.col(c) + eps) / (1 - F.col(c) + eps))


def sigmoid_fit(scores: DataFrame) -> tuple[float, float]:
    """Platt scaling: slope and intercept of a one-feature logistic regression on the logit of ``score``."""
    d = scores.select(array_to_vector(F.array(_logit())).alias("_m"), F.col("label").cast("double").alias("label"))
    m = LogisticRegression(featuresCol="_m", labelCol="label", maxIter=100).fit(d)
    return float(m.coefficients[0]), float(m.intercept)


def calibrated_models(train: DataFrame, stages: list, estimator, id_col: str, k: int = 5) -> list:
    """One ``(model, slope, intercept)`` per fold; the model learns from the other folds and its
    sigmoid from the fold it has not seen."""
    rows, rest = prepared(train, stages)
    local = Pipeline(stages=stages[:len(stages) - len(rest)]).fit(train)

    def one(f: int) -> tuple:
        learn = rows.where(F.col("fold") != f)
        features = Pipeline(stages=rest).fit(learn)
        made = materialize(features.transform(rows).select(id_col, "features", *[c for c in ("label", "weight", "fold") if c in rows.columns]))
        m = estimator.copy().fit(made.where(F.col("fold") != f))
        return (PipelineModel([*local.stages, *features.stages, m]), *sigmoid_fit(scored(m.transform(made.where(F.col("fold") == f)), id_col)))

    with ThreadPoolExecutor(max(1, min(k, AT_A_TIME))) as pool:  # each thread only starts Spark jobs
        return list(pool.map(one, range(k)))


def calibrated_scores(models: list, df: DataFrame, id_col: str) -> DataFrame:
    """``(id, label, calibrated)``: the mean of the calibrated probabilities of all models, by id."""
    parts = None
    for m, slope, intercept in models:
        p = 1 / (1 + F.exp(-(F.lit(slope) * _logit() + F.lit(intercept))))
        s = scored(m.transform(df), id_col).select(id_col, "label", p.alias("_p"))
        parts = s if parts is None else parts.unionByName(s)
    return parts.groupBy(id_col).agg(F.first("label").alias("label"), F.avg("_p").alias("calibrated"))


def coefficients(model: PipelineModel, df: DataFrame, k: int | None = 20) -> DataFrame:
    """Coefficient per feature name (mean over classes for multinomial), the top k by |coefficient|
    (all for ``None``)."""
    lr = model.stages[-1]
    feats = model.transform(df.limit(1)).schema["features"].metadata.get("ml_attr", {}).get("attrs", {})
    names = {}
    for group in feats.values():
        for a in group:
            names[a["idx"]] = a.get("name", f"f{a['idx']}")
    coef = lr.coefficientMatrix.toArray().mean(axis=0)
    rows = [(names.get(i, f"f{i}"), float(c)) for i, c in enumerate(coef)]
    t = df.sparkSession.createDataFrame(rows, "feature string, coefficient double")
    return t if k is None else t.orderBy(F.desc(F.abs("coefficient")), "feature").limit(k)


def signed_importance(coef: DataFrame, k: int = 20) -> DataFrame:
    """The k largest positive and the k largest negative coefficients, with their side and rank."""
    side = F.when(F.col("coefficient") > 0, F.lit("positive")).otherwise(F.lit("negative"))
    order = Window.partitionBy("side").orderBy(F.desc(F.abs("coefficient")), "feature")
    return (coef.where(F.col("coefficient") != 0).withColumn("side", side)
            .withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k))


NO_MODEL = "No model loaded"
NO_TEXT = "claim text is missing"


def category_predictions(model: PipelineModel | None, df: DataFrame, id_col: str, labels: Sequence[str], text: str | None = None) -> DataFrame:
    """(id, category, confidence, probabilities, error): the predicted category, its probability and the class -> probability map.

    Without a model, and for a claim whose ``text`` is NULL, the category is ``Unknown`` with confidence 0 and the error says why.
    """
    none = F.lit(None).cast("map<string,double>")
    unknown = lambda d, why: d.select(id_col, F.lit("Unknown").alias("category"), F.lit(0.0).alias("confidence"), none.alias("probabilities"),
                                      F.lit(why).alias("error"))
    if model is None:
        return unknown(df, NO_MODEL)
    p = model.transform(df if text is None else df.where(F.col(text).isNotNull()))
    arr = vector_to_array(F.col("probability"))
    lab = F.array(*[F.lit(x) for x in labels])
    out = p.select(id_col, F.element_at(lab, F.col("prediction").cast("int") + 1).alias("category"), F.array_max(arr).alias("confidence"),
                   F.map_from_arrays(lab, arr).alias("probabilities"), F.lit(None).cast("string").alias("error"))
    return out if text is None else out.unionByName(unknown(df.where(F.col(text).isNull()), NO_TEXT))


def flag_predictions(model: PipelineModel | None, df: DataFrame, id_col: str, text: str | None = None) -> DataFrame:
    """(id, is_greenwashing, confidence, probability, error): p > 0.5 (strict) and p.  Without a model, and for a claim whose
    ``text`` is NULL, the flag is false with confidence 0 and the error says why."""
    nothing = lambda d, why: d.select(id_col, F.lit(False).alias("is_greenwashing"), F.lit(0.0).alias("confidence"),
                                      F.lit(None).cast("double").alias("probability"), F.lit(why).alias("error"))
    if model is None:
        return nothing(df, NO_MODEL)
    p = model.transform(df if text is None else df.where(F.col(text).isNotNull())).select(id_col, prob1("probability").alias("p"))
    out = p.select(id_col, (F.col("p") > 0.5).alias("is_greenwashing"), F.col("p").alias("confidence"), F.col("p").alias("probability"),
                   F.lit(None).cast("string").alias("error"))
    return out if text is None else out.unionByName(nothing(df.where(F.col(text).isNull()), NO_TEXT))


def save_model(model: PipelineModel, path: str) -> None:
    """Spark ML persistence (overwrite)."""
    model.write().overwrite().save(path)


def load_model(path: str) -> PipelineModel:
    return PipelineModel.load(path)


def tuning_grids(n: int) -> dict:
    """Per-model grids in Spark terms (C -> regParam = 1/(C n); penalty -> elasticNet;
    min_samples_split s -> minInstancesPerNode s // 2; an unbounded depth -> 30, Spark's maximum)."""
    # The per-model grids of the tuning step.
    lr_c, lr_pen = [0.1, 1, 10], ["l1", "l2"]
    rf_trees, rf_depth, rf_split = [50, 100, 200], [3, 5, 7, None], [2, 5, 10]
    gb_iter, gb_rate, gb_depth, gb_sub = [50, 100, 200], [0.01, 0.1, 0.2], [3, 5, 7], [0.8, 0.9, 1.0]
    svm_c = [0.1, 1, 10]
    c = classifiers()
    lr, rf, gb, svm = c["LogisticRegression"], c["RandomForest"], c["GradientBoosting"], c["SVM"]
    return {
        "LogisticRegression": [{lr.regParam: c_to_reg(x, n), lr.elasticNetParam: 1.0 if p == "l1" else 0.0}
                               for x in lr_c for p in lr_pen],
        "RandomForest": [{rf.numTrees: t, rf.maxDepth: d or 30, rf.minInstancesPerNode: max(1, s // 2)}
                         for t in rf_trees for d in rf_depth for s in rf_split],
        "GradientBoosting": [{gb.maxIter: t, gb.stepSize: r, gb.maxDepth: d, gb.subsamplingRate: u}
                             for t in gb_iter for r in gb_rate for d in gb_depth for u in gb_sub],
        "SVM": [{svm.regParam: c_to_reg(x, n)} for x in svm_c],
    }, c


def first_trees(model, n: int):
    """The ensemble of the first ``n`` trees of a fitted forest or of fitted boosted trees.  Boosting is sequential, so this is the model
    that ``n`` iterations give; a forest's trees are drawn alike, so it is a forest of ``n`` trees."""
    if isinstance(model, BO.BoostedTrees):
        return model.first(n)
    java = model._java_obj
    sc = SparkContext.getOrCreate()
    of = sc._jvm.org.apache.spark.ml
    boosted = isinstance(model, GBTClassificationModel)
    trees = java.trees()
    kind = of.regression.DecisionTreeRegressionModel if boosted else of.classification.DecisionTreeClassificationModel
    kept = sc._gateway.new_array(kind, n)
    for i in range(n):
        kept[i] = trees[i]
    if boosted:
        weights = sc._gateway.new_array(sc._jvm.double, n)
        for i in range(n):
            weights[i] = model.treeWeights[i]
        return GBTClassificationModel(of.classification.GBTClassificationModel(f"{model.uid}-{n}", kept, weights, model.numFeatures, 2))
    return RandomForestClassificationModel(of.classification.RandomForestClassificationModel(f"{model.uid}-{n}", kept, model.numFeatures, model.numClasses))


def cross_validate_prefixes(train: DataFrame, stages: list, estimator, points: Sequence[dict], size, folds: int = 5, parallelism: int = 4) -> list[float]:
    """Mean ROC-AUC of grid points of a tree ensemble over the folds.  Points that differ in the number of trees (the parameter
    ``size``) only are one fit of the largest; the others are scored as its first trees."""
    evaluator = BinaryClassificationEvaluator(labelCol="label", metricName="areaUnderROC")
    alike: dict[tuple, list[int]] = {}
    for i, p in enumerate(points):
        alike.setdefault(tuple(sorted((k.name, v) for k, v in p.items() if k != size)), []).append(i)
    auc = np.zeros(len(points))
    made = fold_features(train, stages, folds, ["features", "label", "weight", "fold"])

    def group(of: tuple[int, list[int]]) -> list[tuple[int, float]]:
        (rest, held), members = made[of[0]], of[1]
        largest = max(members, key=lambda i: points[i][size])
        model = fitted(estimator, rest, points[largest])
        return [(i, evaluator.evaluate((model if i == largest else first_trees(model, points[i][size])).transform(held))) for i in members]

    with ThreadPoolExecutor(parallelism) as pool:  # each thread only starts Spark jobs
        for done in pool.map(group, [(f, members) for f in range(folds) for members in alike.values()]):
            for i, value in done:
                auc[i] += value
    return [float(x) for x in auc / folds]


def tune_winner(train: DataFrame, test: DataFrame, stages: list, id_col: str,
                candidates: Sequence[str] | None = None, folds: int = 5, fast_mode: bool = False, oversample: bool = False) -> DataFrame:
    """D7 + J7 + J8 + J26: compare the candidates, take the best by test ROC-AUC, tune it with its
    grid by cross-validated ROC-AUC (``fold`` column), and report untuned/tuned metrics and the delta
    in one tall experiment table ``(model, metric, untuned, tuned, delta, best_params)``.  With ``oversample`` the compared and the tuned
    models learn from the balanced rows too; the folds hold real rows only."""
    (train, rest), (test, _) = prepared(train, stages), prepared(test, stages)
    stages = rest
    cmp = materialize(compare_models(train, test, stages, id_col, candidates, oversample))  # a row a model, read by several jobs
    best = cmp.orderBy(F.desc("roc_auc"), "model").first()["model"]  # one row of a bounded table
    n = train.count()
    grids, ests = tuning_grids(n)
    est = ests[best]
    params = "default"
    if fast_mode:
        tuned_metrics = cmp.where(F.col("model") == best)
    else:
        size = {"RandomForest": "numTrees", "GradientBoosting": "maxIter"}.get(best)
        if size:
            auc = cross_validate_prefixes(train, stages, est, grids[best], est.getParam(size), folds)
        else:
            auc = cross_validate(train, stages, [(est, point) for point in grids[best]], folds)
        point = grids[best][int(np.argmax(auc))]
        params = ", ".join(f"{p.name}={v}" for p, v in point.items())
        features = Pipeline(stages=stages).fit(train)
        learn = materialize(features.transform(train).select(id_col, "features", "label", "weight"))
        tuned = fitted(est, materialize(oversampled(learn, id_col)) if oversample else learn, point)
        s = scored(tuned.transform(features.transform(test)), id_col)
        tuned_metrics = CV.binary_metrics(s, score="score").withColumn("model", F.lit(best))
    metrics = ["accuracy", "precision", "recall", "f1", "roc_auc"]
    tall = lambda d, name: d.select(F.explode(F.array(*[F.struct(F.lit(m).alias("metric"), F.col(m).alias(name))
                                                        for m in metrics])).alias("e")).select("e.*")
    u = tall(cmp.where(F.col("model") == best), "untuned")
    t = tall(tuned_metrics, "tuned")
    return (u.join(t, "metric").select(F.lit(best).alias("model"), "metric", "untuned", "tuned",
                                       F.round(F.col("tuned") - F.col("untuned"), 6).alias("delta"),
                                       F.lit(params).alias("best_params")))


def experiment_record(train: DataFrame, test: DataFrame, stages: list, id_col: str, names: Sequence[str] | None = None, folds: int = 5,
                      oversample: bool = True, feature_type: str = "TF-IDF") -> DataFrame:
    """The whole record of an experiment as rows (part, model, metric, value, text).

    Parts: ``model_comparison`` (test metrics of every model), ``cross_validation`` (mean and population deviation of the AUC over the folds of
    the training part), ``best_model`` (best mean AUC: its name, score and test metrics) and ``dataset`` (rows, positive rate, feature width and kind,
    class balancing).
    """
    spark = train.sparkSession
    (train, rest), (test, _) = prepared(train, stages), prepared(test, stages)
    stages = rest
    order = [m for m in classifiers() if not names or m in names]
    with ThreadPoolExecutor(2) as pool:  # each thread only starts Spark jobs
        later = pool.submit(cross_validate, train, stages, [(classifiers()[m], {}) for m in order], folds, each_fold=True)
        compared = {r["model"]: r for r in compare_models(train, test, stages, id_col, names, oversample).collect()}  # a row a model
        auc = later.result()
    compared = [compared[m] for m in order]
    metrics = ["accuracy", "precision", "recall", "f1", "roc_auc", "gini"]
    rows = [("model_comparison", r["model"], m, r[m], None) for r in compared for m in metrics]
    for i, m in enumerate(order):
        rows += [("cross_validation", m, "mean_auc", float(np.mean(auc[:, i])), None), ("cross_validation", m, "std_auc", float(np.std(auc[:, i])), None)]
    best = int(np.argmax(auc.mean(axis=0)))
    rows += [("best_model", order[best], "cv_score", float(auc[:, best].mean()), None)]
    rows += [("best_model", order[best], m, compared[best][m], None) for m in metrics]
    n_train, n_test = train.count(), test.count()
    rate = train.select("label").unionByName(test.select("label")).agg(F.avg("label")).first()[0]
    width = Pipeline(stages=stages).fit(train).transform(train.limit(1)).select("features").first()["features"].size
    rows += [("dataset", None, k, float(v), None) for k, v in (("total_samples", n_train + n_test), ("training_samples", n_train), ("test_samples", n_test),
                                                              ("greenwashing_rate", rate), ("feature_dimension", width))]
    rows += [("dataset", None, "feature_type", None, feature_type), ("dataset", None, "class_balancing", None, "SMOTE" if oversample else "none")]
    out = spark.createDataFrame(rows, "part string, model string, metric string, value double, text string")
    return out.withColumn("value", F.round("value", 6))
