"""Metric and curve queries (F3, J15-J20) on scored claim tables.

* ``scored_txt``: labelled document claims, score = keyword risk (data lexicon), pred = score > 0.5.
* ``scored_num``: line-item claims, score = the sentiment-score column (many ties), label = flag.
"""

from __future__ import annotations

from pyspark.sql import functions as F

from claimlens.functions import lexicons as L
from claimlens.operators import curves as CV
from claimlens.operators import risk as RK
from claimlens.plans.q_risk import sql_v2
from claimlens.plans.registry import register
from claimlens.plans.sqlparts import NUM, TXT
from claimlens.sources.claims import claims_num, claims_txt

DATA_LEX = {"extreme": L.DATA_V2_EXTREME, "high": L.DATA_V2_HIGH, "vague": L.DATA_V2_VAGUE}


def scored_txt(spark, sf):
    c = claims_txt(spark, sf, ["claim_id", "greenwashing_flag"], lambda d: RK.with_lower(d, "esg_claim_text").withColumn(
        "score", RK.keyword_risk_v2("esg_claim_text", **DATA_LEX, lt=F.col(RK.LOWER))).drop("esg_claim_text", RK.LOWER))
    s = c.where(F.col("greenwashing_flag").isNotNull()).select("claim_id", F.col("greenwashing_flag").alias("label"), "score")
    return s.withColumn("pred", (F.col("score") > 0.5).cast("int"))


def scored_num(spark, sf):
    c = claims_num(spark, sf)
    return c.select("claim_id", F.col("greenwashing_flag").alias("label"),
                    F.col("report_sentiment_score").alias("score"))


S_TXT = TXT.rstrip("\n") + f""",
s AS (SELECT claim_id, greenwashing_flag AS label,
             {sql_v2('esg_claim_text', L.DATA_V2_EXTREME, L.DATA_V2_HIGH, L.DATA_V2_VAGUE)} AS score
      FROM claims WHERE greenwashing_flag IS NOT NULL),
sp AS (SELECT *, CAST(score > 0.5 AS INTEGER) AS pred FROM s)
"""
S_NUM = NUM.rstrip("\n") + """,
sp AS (SELECT claim_id, greenwashing_flag AS label, report_sentiment_score AS score FROM claims)
"""
CONF = """cf AS (SELECT CAST(count_if(label = 0 AND pred = 0) AS BIGINT) AS tn,
                  CAST(count_if(label = 0 AND pred = 1) AS BIGINT) AS fp,
                  CAST(count_if(label = 1 AND pred = 0) AS BIGINT) AS fn,
                  CAST(count_if(label = 1 AND pred = 1) AS BIGINT) AS tp FROM sp)"""


def _ratio(a, b):
    return f"coalesce(CAST({a} AS DOUBLE) / nullif(CAST({b} AS DOUBLE), 0), 0.0)"


def _cum():
    return """sc AS (SELECT score, sum(label) AS pos, sum(1 - label) AS neg FROM sp
              WHERE score IS NOT NULL AND label IS NOT NULL GROUP BY score),
tot AS (SELECT sum(pos) AS P, sum(neg) AS N FROM sc),
cu AS (SELECT sc.*, sum(pos) OVER (ORDER BY score DESC ROWS UNBOUNDED PRECEDING) AS tp,
              sum(neg) OVER (ORDER BY score DESC ROWS UNBOUNDED PRECEDING) AS fp, P, N FROM sc, tot)"""


AUC_SQL = "round(sum(neg * (2 * tp - pos)) / (2.0 * any_value(P) * any_value(N)), 6)"
GINI_SQL = "round(2 * (sum(neg * (2 * tp - pos)) / (2.0 * any_value(P) * any_value(N))) - 1, 6)"

register("confusion", S_TXT.rstrip("\n") + ",\n" + CONF + "\nSELECT tn, fp, fn, tp FROM cf")(
    lambda spark, sf: CV.confusion(scored_txt(spark, sf)))

P_, R_ = _ratio("tp", "tp + fp"), _ratio("tp", "tp + fn")
register("binary_metrics", S_TXT.rstrip("\n") + ",\n" + CONF + ",\n" + _cum() + f"""
SELECT round({_ratio('tp + tn', 'tp + tn + fp + fn')}, 6) AS accuracy, round({P_}, 6) AS precision,
       round({R_}, 6) AS recall, round({_ratio(f'2 * {P_} * {R_}', f'{P_} + {R_}')}, 6) AS f1,
       (SELECT {AUC_SQL} FROM cu) AS roc_auc, (SELECT {GINI_SQL} FROM cu) AS gini
FROM cf""")(lambda spark, sf: CV.binary_metrics(scored_txt(spark, sf), score="score"))

register("classification_report", S_TXT.rstrip("\n") + f""",
pairs AS (SELECT CAST(label AS VARCHAR) AS y, CAST(pred AS VARCHAR) AS p, count(*) AS n FROM sp GROUP BY 1, 2),
st AS (SELECT cls, sum(tp) AS tp, sum(pred_n) AS pred_n, sum(support) AS support FROM (
         SELECT y AS cls, n AS support, CASE WHEN y = p THEN n ELSE 0 END AS tp, 0 AS pred_n FROM pairs
         UNION ALL SELECT p AS cls, 0, 0, n FROM pairs) GROUP BY cls),
per AS (SELECT cls AS class, {_ratio('tp', 'pred_n')} AS precision, {_ratio('tp', 'support')} AS recall,
               CAST(support AS DOUBLE) AS support, tp FROM st),
per2 AS (SELECT *, {_ratio('2 * precision * recall', 'precision + recall')} AS f1 FROM per),
agg AS (SELECT sum(support) AS n, sum(tp) AS tp, avg(precision) AS mp, avg(recall) AS mr, avg(f1) AS mf,
               sum(precision * support) / sum(support) AS wp, sum(recall * support) / sum(support) AS wr,
               sum(f1 * support) / sum(support) AS wf FROM per2)
SELECT class, round(precision, 6) AS precision, round(recall, 6) AS recall, round(f1, 6) AS f1, round(support, 6) AS support FROM per2
UNION ALL SELECT 'accuracy', round({_ratio('tp', 'n')}, 6), round({_ratio('tp', 'n')}, 6), round({_ratio('tp', 'n')}, 6), round(n, 6) FROM agg
UNION ALL SELECT 'macro avg', round(mp, 6), round(mr, 6), round(mf, 6), round(n, 6) FROM agg
UNION ALL SELECT 'weighted avg', round(wp, 6), round(wr, 6), round(wf, 6), round(n, 6) FROM agg""")(
    lambda spark, sf: CV.classification_report(scored_txt(spark, sf)))

register("roc_curve", S_NUM.rstrip("\n") + ",\n" + _cum() + f"""
SELECT score AS threshold, round({_ratio('fp', 'N')}, 6) AS fpr, round({_ratio('tp', 'P')}, 6) AS tpr FROM cu""")(
    lambda spark, sf: CV.roc_curve(scored_num(spark, sf)))

register("auc_gini", S_NUM.rstrip("\n") + ",\n" + _cum() + f"""
SELECT {AUC_SQL} AS roc_auc, {GINI_SQL} AS gini FROM cu""")(lambda spark, sf: CV.roc_auc(scored_num(spark, sf)))

register("threshold_for_recall", S_NUM.rstrip("\n") + ",\n" + _cum() + f""",
rc AS (SELECT *, {_ratio('tp', 'P')} AS recall, {_ratio('tp', 'tp + fp')} AS precision FROM cu),
hi AS (SELECT max(score) AS t_hi FROM rc WHERE recall >= 0.8)
SELECT (SELECT max(score) FROM rc, hi WHERE score < t_hi) AS threshold, t_hi AS threshold_unshifted,
       round(recall, 6) AS recall, round(precision, 6) AS precision
FROM rc JOIN hi ON rc.score = hi.t_hi""")(lambda spark, sf: CV.threshold_for_recall(scored_num(spark, sf), 0.8))


# ---------------------------------------------------------------- J1-J3, I9
from claimlens.operators import folds as FO  # noqa: E402


def _split(spark, sf):
    c = claims_txt(spark, sf, ["claim_id", "greenwashing_flag"]).where(F.col("greenwashing_flag").isNotNull())
    return FO.stratified_split(c, "claim_id", "greenwashing_flag", 20, 42)


register("stratified_split", TXT + """
SELECT claim_id, greenwashing_flag, CASE WHEN rn <= (n * 20 + 99) // 100 THEN 'test' ELSE 'train' END AS split
FROM (SELECT claim_id, greenwashing_flag,
             row_number() OVER (PARTITION BY greenwashing_flag ORDER BY md5(CAST(claim_id AS VARCHAR) || '-42'), CAST(claim_id AS VARCHAR)) AS rn,
             count(*) OVER (PARTITION BY greenwashing_flag) AS n
      FROM claims WHERE greenwashing_flag IS NOT NULL)""")(_split)


def _kfold(spark, sf):
    c = claims_num(spark, sf).select("claim_id", "greenwashing_flag")
    return FO.stratified_kfold(c, "claim_id", "greenwashing_flag", 5, 42)


register("kfold", NUM + """
SELECT claim_id, greenwashing_flag, CAST((rn - 1) % 5 AS INTEGER) AS fold
FROM (SELECT claim_id, greenwashing_flag,
             row_number() OVER (PARTITION BY greenwashing_flag ORDER BY md5(CAST(claim_id AS VARCHAR) || '-42'), CAST(claim_id AS VARCHAR)) AS rn
      FROM claims)""")(_kfold)

register("class_weights", NUM + """
SELECT claim_category, count(*) AS n_c, sum(count(*)) OVER () / (count(*) OVER () * count(*)) AS weight
FROM claims WHERE claim_category IS NOT NULL GROUP BY claim_category""")(
    lambda spark, sf: FO.class_weights(claims_num(spark, sf), "claim_category"))


def _group_folds(spark, sf):
    c = claims_txt(spark, sf, ["claim_id", "organization_name", "greenwashing_flag"]).where(F.col("greenwashing_flag").isNotNull())
    return FO.group_folds(c, "organization_name", "greenwashing_flag", 4, 42)


# every attempt of the deal at once; the first with both labels in all folds is taken
register("group_folds", TXT + """,
l AS (SELECT claim_id, organization_name, greenwashing_flag FROM claims WHERE greenwashing_flag IS NOT NULL),
g AS (SELECT organization_name, count_if(greenwashing_flag = 1) AS pos, count_if(greenwashing_flag = 0) AS neg
      FROM l WHERE organization_name IS NOT NULL GROUP BY 1),
dealt AS (SELECT g.*, a.attempt, CAST((row_number() OVER (PARTITION BY a.attempt ORDER BY
              md5(organization_name || '#' || a.attempt || '-42'), organization_name || '#' || a.attempt) - 1) % 4 AS INTEGER) AS fold
          FROM g, (SELECT unnest(range(200)) AS attempt) a),
sums AS (SELECT attempt, fold, sum(pos) AS p, sum(neg) AS q FROM dealt GROUP BY ALL),
taken AS (SELECT min(attempt) AS attempt FROM (SELECT attempt FROM sums GROUP BY attempt HAVING count(*) = 4 AND min(p) > 0 AND min(q) > 0))
SELECT l.claim_id, l.organization_name, l.greenwashing_flag, d.fold FROM l
LEFT JOIN (SELECT organization_name, fold FROM dealt WHERE attempt = (SELECT attempt FROM taken)) d USING (organization_name)""")(_group_folds)
