"""Classifier curves and metrics (F3, J15, J17-J20) on any scored table.

Inputs are a table with a 0/1 ``label`` and either a ``score`` (probability) or a
``pred`` (0/1).  Curves first collapse the rows to one row per distinct score
(partial + final aggregate), then take exact distributed running counts over the
scores (``prefix_sums``) - no single-task window over the data.  0/0 ratios are
0, as the usual metric libraries report with ``zero_division=0``.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from claimlens.functions.stats import prefix_sums

R = 6


def _ratio(a, b):
    return F.coalesce(F.try_divide(a.cast("double"), b.cast("double")), F.lit(0.0))


def confusion(df: DataFrame, label: str = "label", pred: str = "pred") -> DataFrame:
    """Binary confusion counts in one row (missing cells are 0)."""
    y, p = F.col(label), F.col(pred)
    return df.agg(F.count_if((y == 0) & (p == 0)).alias("tn"), F.count_if((y == 0) & (p == 1)).alias("fp"),
                  F.count_if((y == 1) & (p == 0)).alias("fn"), F.count_if((y == 1) & (p == 1)).alias("tp"))


def binary_metrics(df: DataFrame, label: str = "label", pred: str = "pred", score: str | None = None) -> DataFrame:
    """Accuracy, precision, recall, F1 (and ROC-AUC when a score is given) in one row."""
    c = confusion(df, label, pred)
    tp, fp, fn, tn = (F.col(x) for x in ("tp", "fp", "fn", "tn"))
    prec, rec = _ratio(tp, tp + fp), _ratio(tp, tp + fn)
    out = c.select(F.round(_ratio(tp + tn, tp + tn + fp + fn), R).alias("accuracy"),
                   F.round(prec, R).alias("precision"), F.round(rec, R).alias("recall"),
                   F.round(_ratio(2 * prec * rec, prec + rec), R).alias("f1"))
    if score is not None:
        out = out.crossJoin(roc_auc(df, label, score))
    return out


def multiclass_metrics(df: DataFrame, label: str = "label", pred: str = "pred") -> DataFrame:
    """J17 for more than two classes: accuracy, and precision, recall and F1 weighted by support, in one row."""
    report = classification_report(df, label, pred)
    line = lambda c: F.max(F.when(F.col("class") == "weighted avg", F.col(c))).alias(c)
    return report.agg(F.max(F.when(F.col("class") == "accuracy", F.col("precision"))).alias("accuracy"),
                      line("precision"), line("recall"), line("f1"))


def classification_report(df: DataFrame, label: str = "label", pred: str = "pred") -> DataFrame:
    """Per class precision/recall/F1/support, plus accuracy, macro and weighted averages."""
    y, p = F.col(label).cast("string"), F.col(pred).cast("string")
    pairs = df.groupBy(y.alias("y"), p.alias("p")).agg(F.count(F.lit(1)).alias("n"))
    # each (y, p, n) cell counts toward the support of y, the predictions of p, and tp when y = p
    as_true = pairs.select(F.col("y").alias("cls"), F.col("n").alias("support"),
                           F.when(F.col("y") == F.col("p"), F.col("n")).otherwise(F.lit(0)).alias("tp"),
                           F.lit(0).cast("long").alias("pred_n"))
    as_pred = pairs.select(F.col("p").alias("cls"), F.lit(0).cast("long").alias("support"),
                           F.lit(0).cast("long").alias("tp"), F.col("n").alias("pred_n"))
    stats = as_true.unionByName(as_pred).groupBy("cls").agg(
        F.sum("tp").alias("tp"), F.sum("pred_n").alias("pred_n"), F.sum("support").alias("support"))
    prec, rec = _ratio(F.col("tp"), F.col("pred_n")), _ratio(F.col("tp"), F.col("support"))
    per = stats.select(F.col("cls").alias("class"), prec.alias("precision"), rec.alias("recall"),
                       _ratio(2 * prec * rec, prec + rec).alias("f1"), F.col("support").cast("double").alias("support"),
                       F.col("tp"))
    tot = per.agg(F.sum("support").alias("n"), F.sum("tp").alias("tp"), F.count(F.lit(1)).alias("k"),
                  F.avg("precision").alias("mp"), F.avg("recall").alias("mr"), F.avg("f1").alias("mf"),
                  (F.sum(F.col("precision") * F.col("support")) / F.sum("support")).alias("wp"),
                  (F.sum(F.col("recall") * F.col("support")) / F.sum("support")).alias("wr"),
                  (F.sum(F.col("f1") * F.col("support")) / F.sum("support")).alias("wf"))
    acc = _ratio(F.col("tp"), F.col("n"))
    rows = tot.select(F.explode(F.array(
        F.struct(F.lit("accuracy").alias("class"), acc.alias("precision"), acc.alias("recall"), acc.alias("f1"),
                 F.col("n").alias("support")),
        F.struct(F.lit("macro avg").alias("class"), F.col("mp").alias("precision"), F.col("mr").alias("recall"),
                 F.col("mf").alias("f1"), F.col("n").alias("support")),
        F.struct(F.lit("weighted avg").alias("class"), F.col("wp").alias("precision"), F.col("wr").alias("recall"),
                 F.col("wf").alias("f1"), F.col("n").alias("support")))).alias("r")).select("r.*")
    out = per.drop("tp").unionByName(rows)
    return out.select("class", *[F.round(c, R).alias(c) for c in ["precision", "recall", "f1", "support"]])


def score_counts(df: DataFrame, label: str = "label", score: str = "score") -> DataFrame:
    """One row per distinct score with its positive and negative counts (map-side combined)."""
    return (df.where(F.col(score).isNotNull() & F.col(label).isNotNull())
            .groupBy(F.col(score).alias("score"))
            .agg(F.sum(F.col(label).cast("long")).alias("pos"), F.sum(1 - F.col(label).cast("long")).alias("neg")))


def _cumulative(df: DataFrame, label: str, score: str) -> DataFrame:
    """Per distinct score t (descending): tp/fp = positives/negatives with score >= t, plus totals."""
    sc = score_counts(df, label, score)
    cum = prefix_sums(sc, "score", ["pos", "neg"], descending=True)
    tot = sc.agg(F.sum("pos").alias("P"), F.sum("neg").alias("N"))
    return cum.crossJoin(F.broadcast(tot)).withColumnsRenamed({"cum_pos": "tp", "cum_neg": "fp"})


def roc_curve(df: DataFrame, label: str = "label", score: str = "score") -> DataFrame:
    """(threshold, fpr, tpr) at every distinct score."""
    c = _cumulative(df, label, score)
    return c.select(F.col("score").alias("threshold"), F.round(_ratio(F.col("fp"), F.col("N")), R).alias("fpr"),
                    F.round(_ratio(F.col("tp"), F.col("P")), R).alias("tpr"))


def roc_auc(df: DataFrame, label: str = "label", score: str = "score") -> DataFrame:
    """Exact ROC-AUC (trapezoids between consecutive distinct scores; ties count one half) and Gini."""
    c = _cumulative(df, label, score)
    # the previous ROC point of a score group is (fp - neg, tp - pos): no lag window needed
    area = F.sum(F.col("neg") * (2 * F.col("tp") - F.col("pos"))) / (2.0 * F.first("P") * F.first("N"))
    a = c.agg(area.alias("auc"))
    return a.select(F.round("auc", R).alias("roc_auc"), F.round(2 * F.col("auc") - 1, R).alias("gini"))


def threshold_for_recall(df: DataFrame, target: float = 0.8, label: str = "label", score: str = "score") -> DataFrame:
    """Highest threshold with recall >= target (``threshold_unshifted``) and the observed rule's
    choice, the next lower distinct score (``threshold``), with recall/precision at the former."""
    c = _cumulative(df, label, score).withColumns({
        "recall": _ratio(F.col("tp"), F.col("P")), "precision": _ratio(F.col("tp"), F.col("tp") + F.col("fp"))})
    ok = c.where(F.col("recall") >= target)
    top = ok.agg(F.max("score").alias("t_hi"))
    at = c.join(F.broadcast(top), F.col("score") == F.col("t_hi")).select("t_hi", "recall", "precision")
    lower = c.crossJoin(F.broadcast(top)).where(F.col("score") < F.col("t_hi")).agg(F.max("score").alias("t_lo"))
    return at.crossJoin(lower).select(F.col("t_lo").alias("threshold"), F.col("t_hi").alias("threshold_unshifted"),
                                      F.round("recall", R).alias("recall"), F.round("precision", R).alias("precision"))


def apply_threshold(df: DataFrame, threshold: float, score: str = "score", out: str = "pred") -> DataFrame:
    """``pred = score >= threshold``."""
    return df.withColumn(out, (F.col(score) >= F.lit(threshold)).cast("int"))
