"""Smaller operators: first-n batch limit (D5), threshold application (J16), task projection with
NULL-target drop (B18-B20), group-membership semi/anti joins (E6), sequential claim ids (F4)."""

from __future__ import annotations

from pyspark.sql import functions as F

from claimlens.functions import lexicons as L
from claimlens.functions.stats import prefix_sums
from claimlens.operators import curves as CV
from claimlens.operators import features as FE
from claimlens.operators import risk as RK
from claimlens.plans.q_risk import _batch_sql
from claimlens.plans.registry import register
from claimlens.plans.sqlparts import NUM, TXT
from claimlens.sources.claims import claims_num, claims_txt

DATA_LEX = {"extreme": L.DATA_V2_EXTREME, "high": L.DATA_V2_HIGH, "vague": L.DATA_V2_VAGUE}
MAX_CLAIMS = 100


def first_n(df, n: int, key: str = "claim_id"):
    """The first ``n`` rows in a stable key order; 0 means all rows."""
    return df if n == 0 else df.orderBy(key).limit(n)


register("batch_first_n", _batch_sql(DATA_LEX).replace(
    "FROM claims WHERE esg_claim_text IS NULL OR esg_claim_text <> ''),",
    f"FROM (SELECT * FROM claims ORDER BY claim_id LIMIT {MAX_CLAIMS}) WHERE esg_claim_text IS NULL OR esg_claim_text <> ''),")
    .replace("ELSE overall END AS risk_score", "ELSE round(overall, 6) END AS risk_score")
    .replace("ELSE rag END AS rag_risk", "ELSE round(rag, 6) END AS rag_risk"))(
    lambda spark, sf: RK.batch_analysis(first_n(claims_txt(spark, sf), MAX_CLAIMS), v2_lexicon=DATA_LEX)
    .withColumns({c: F.round(c, 6) for c in ["risk_score", "rag_risk"]}))

register("threshold_apply", NUM + """
SELECT claim_id, CAST(report_sentiment_score >= 0.04 AS INTEGER) AS pred FROM claims""")(
    lambda spark, sf: CV.apply_threshold(claims_num(spark, sf).select(
        "claim_id", F.col("report_sentiment_score").alias("score")), 0.04).select("claim_id", "pred"))

register("task_projection", TXT + """
SELECT claim_id, report_year, claim_category, claimed_metric_type, claimed_value, measurement_unit,
       project_location, actual_measured_value, value_deviation, external_validation_score, controversy_flag,
       report_sentiment_score, llm_claim_consistency_score, greenwashing_flag AS label
FROM claims WHERE greenwashing_flag IS NOT NULL""")(
    lambda spark, sf: FE.task_projection(claims_txt(spark, sf), "greenwash").na.drop(subset=["label"]))

register("task_projection_category", TXT + """
SELECT claim_id, report_year, claimed_metric_type, claimed_value, measurement_unit, project_location, actual_measured_value,
       value_deviation, external_validation_score, greenwashing_flag, controversy_flag, report_sentiment_score,
       llm_claim_consistency_score, claim_category AS label
FROM claims WHERE claim_category IS NOT NULL""")(
    lambda spark, sf: FE.task_projection(claims_txt(spark, sf), "category").na.drop(subset=["label"]))


def _membership(spark, sf):
    c = claims_txt(spark, sf)
    risky = (c.groupBy("organization_name").agg(F.avg("greenwashing_flag").alias("r"))
             .where(F.col("r") > 0.5).select("organization_name"))
    semi = c.join(risky, "organization_name", "left_semi").agg(F.count(F.lit(1)).alias("n_in"))
    anti = c.join(risky, "organization_name", "left_anti").agg(F.count(F.lit(1)).alias("n_out"))
    return semi.crossJoin(anti)


register("group_membership", TXT + """, risky AS (
  SELECT organization_name FROM claims GROUP BY organization_name HAVING avg(greenwashing_flag) > 0.5)
SELECT (SELECT count(*) FROM claims WHERE organization_name IN (SELECT organization_name FROM risky)) AS n_in,
       (SELECT count(*) FROM claims WHERE organization_name IS NULL
           OR organization_name NOT IN (SELECT organization_name FROM risky)) AS n_out""")(_membership)


def _sequence(spark, sf):
    c = claims_num(spark, sf).select("claim_id").withColumn("_one", F.lit(1))
    return prefix_sums(c, "claim_id", ["_one"]).select("claim_id", F.col("cum__one").cast("bigint").alias("seq_id"))


register("claim_sequence", NUM + """
SELECT claim_id, row_number() OVER (ORDER BY claim_id) AS seq_id FROM claims""")(_sequence)
