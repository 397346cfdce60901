"""Quality, feature and exploratory queries over the derived claim tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from claimlens.functions.stats import column_quantiles
from claimlens.functions.text import char_count, truncate_display, word_count
from claimlens.operators import explore as X
from claimlens.operators import features as FE
from claimlens.operators import quality as Q
from claimlens.operators.folds import stratified_split
from claimlens.plans.registry import register
from claimlens.plans.sqlparts import NUM, TXT, chars, r6, strip, words
from claimlens.session import written
from claimlens.sources import io as IO
from claimlens.sources.claims import claims_num, claims_txt
from claimlens.sources.tables import table


def num_feat(spark, sf):
    return claims_num(spark, sf).withColumns({"text_length": char_count("esg_claim_text"),
                                               "word_count": word_count("esg_claim_text")})


def txt_feat(spark, sf):
    return claims_txt(spark, sf).withColumns({"text_length": char_count("esg_claim_text"),
                                               "word_count": word_count("esg_claim_text")})


NUM_F = NUM.rstrip("\n") + f""",
claims_f AS (SELECT *, {chars('esg_claim_text')} AS text_length, {words('esg_claim_text')} AS word_count FROM claims)
"""
TXT_F = TXT.rstrip("\n") + f""",
claims_f AS (SELECT *, {chars('esg_claim_text')} AS text_length, {words('esg_claim_text')} AS word_count FROM claims)
"""

# ---------------------------------------------------------------- C6-C11, C19, C22
register("flag_rate_by_category", NUM + """
SELECT claim_category, round(avg(greenwashing_flag), 6) AS flag_rate, count(greenwashing_flag) AS n_claims
FROM claims WHERE claim_category IS NOT NULL GROUP BY claim_category""")(
    lambda spark, sf: X.flag_rate_by(claims_num(spark, sf), "claim_category"))

register("flag_rate_by_year", NUM + """
SELECT report_year, round(avg(greenwashing_flag), 6) AS flag_rate, count(greenwashing_flag) AS n_claims
FROM claims WHERE report_year IS NOT NULL GROUP BY report_year""")(
    lambda spark, sf: X.flag_rate_by(claims_num(spark, sf), "report_year"))

register("category_freq", TXT + """
SELECT claim_category, count(*) AS n, round(count(*) * 100.0 / sum(count(*)) OVER (), 6) AS share_pct
FROM claims WHERE claim_category IS NOT NULL GROUP BY claim_category""")(
    lambda spark, sf: X.frequency(claims_txt(spark, sf), "claim_category"))

register("means_by_flag", TXT_F + """
SELECT greenwashing_flag, round(avg(text_length), 6) AS mean_text_length,
       round(avg(word_count), 6) AS mean_word_count, round(avg(claimed_value), 6) AS mean_claimed_value
FROM claims_f WHERE greenwashing_flag IS NOT NULL GROUP BY greenwashing_flag""")(
    lambda spark, sf: X.means_by_flag(txt_feat(spark, sf), ["text_length", "word_count", "claimed_value"]))

register("top_orgs", NUM + """
SELECT organization_name, count(*) AS n FROM claims WHERE organization_name IS NOT NULL
GROUP BY organization_name ORDER BY n DESC, organization_name LIMIT 10""")(
    lambda spark, sf: X.top_by_count(claims_num(spark, sf), "organization_name", 10))

register("org_rate_having", TXT + """
SELECT organization_name, count(*) AS n, round(avg(greenwashing_flag), 6) AS flag_rate
FROM claims WHERE organization_name IS NOT NULL GROUP BY organization_name HAVING count(*) >= 3
ORDER BY flag_rate DESC NULLS LAST, organization_name LIMIT 10""")(
    lambda spark, sf: X.rate_having(claims_txt(spark, sf), "organization_name", 3, 10))

register("overview", NUM + """
SELECT count(*) AS n_rows, min(report_year) AS min_year, max(report_year) AS max_year,
       count(DISTINCT organization_name) AS n_orgs, count(DISTINCT project_location) AS n_locations,
       round(avg(greenwashing_flag), 6) AS flag_rate FROM claims""")(
    lambda spark, sf: X.overview(claims_num(spark, sf)))

register("class_distribution", TXT + """
SELECT greenwashing_flag, count(*) AS n, round(count(*) / sum(count(*)) OVER (), 6) AS rate
FROM claims WHERE greenwashing_flag IS NOT NULL GROUP BY greenwashing_flag""")(
    lambda spark, sf: X.class_distribution(claims_txt(spark, sf), "greenwashing_flag"))

register("class_distribution_split", TXT + """, r AS (
  SELECT greenwashing_flag, row_number() OVER (PARTITION BY greenwashing_flag ORDER BY md5(CAST(claim_id AS VARCHAR) || '-42'), CAST(claim_id AS VARCHAR)) AS rk,
         count(*) OVER (PARTITION BY greenwashing_flag) AS k FROM claims WHERE greenwashing_flag IS NOT NULL),
s AS (SELECT greenwashing_flag, CASE WHEN rk <= (k * 20 + 99) // 100 THEN 'test' ELSE 'train' END AS split FROM r)
SELECT split, greenwashing_flag, count(*) AS n, round(count(*) / sum(count(*)) OVER (PARTITION BY split), 6) AS rate
FROM s GROUP BY split, greenwashing_flag""")(
    lambda spark, sf: X.class_distribution(
        stratified_split(claims_txt(spark, sf).where(F.col("greenwashing_flag").isNotNull()).select("claim_id", "greenwashing_flag"),
                         "claim_id", "greenwashing_flag"), "greenwashing_flag", "split"))

# ---------------------------------------------------------------- C12-C15
_EDA = X.EDA_NUMERIC


def _corr_sql():
    parts = []
    for a in _EDA:
        for b in _EDA:
            if a == b:
                parts.append(f"SELECT '{a}' AS col_a, '{b}' AS col_b, CASE WHEN stddev_samp({a}) > 0 THEN 1.0 END AS corr FROM claims_f")
            else:
                parts.append(f"SELECT '{a}' AS col_a, '{b}' AS col_b, CASE WHEN isnan(corr({a}, {b})) THEN NULL ELSE round(corr({a}, {b}), 6) END AS corr FROM claims_f")
    return NUM_F + "\nUNION ALL\n".join(parts)


register("corr_matrix", _corr_sql())(lambda spark, sf: X.corr_matrix(num_feat(spark, sf), _EDA))

_CORR_FLAG = NUM_F + ", c AS (" + "\nUNION ALL\n".join(
    f"SELECT '{a}' AS feature, CASE WHEN isnan(corr({a}, greenwashing_flag)) THEN NULL ELSE round(corr({a}, greenwashing_flag), 6) END AS corr FROM claims_f" for a in _EDA) + """)
SELECT feature, corr, CAST(row_number() OVER (ORDER BY corr DESC NULLS LAST, feature) AS INTEGER) AS rank FROM c"""
register("corr_with_flag", _CORR_FLAG)(lambda spark, sf: X.corr_with_flag(num_feat(spark, sf), _EDA))

register("trend_peak", NUM + """, y AS (
  SELECT report_year, round(avg(greenwashing_flag), 6) AS flag_rate FROM claims
  WHERE report_year IS NOT NULL GROUP BY report_year)
SELECT CASE WHEN arg_max(flag_rate, report_year) > arg_min(flag_rate, report_year)
            THEN 'increasing' ELSE 'decreasing' END AS trend,
       (SELECT report_year FROM y ORDER BY flag_rate DESC, report_year LIMIT 1) AS peak_year,
       max(flag_rate) AS peak_rate, count(*) AS n_years FROM y""")(
    lambda spark, sf: X.trend_peak(claims_num(spark, sf)))

register("insights", _CORR_FLAG.replace("SELECT feature, corr, CAST(", "SELECT feature, corr, CAST(", 1).replace(
    "\nSELECT feature, corr, CAST(row_number() OVER (ORDER BY corr DESC NULLS LAST, feature) AS INTEGER) AS rank FROM c",
    """, r AS (SELECT feature, corr, row_number() OVER (ORDER BY corr DESC NULLS LAST, feature) AS rank FROM c),
freq AS (SELECT claim_category, count(*) AS n FROM claims_f WHERE claim_category IS NOT NULL GROUP BY 1),
rate AS (SELECT claim_category, round(avg(greenwashing_flag), 6) AS fr FROM claims_f WHERE claim_category IS NOT NULL GROUP BY 1)
SELECT count(*) AS n_rows, round(avg(greenwashing_flag), 6) AS flag_rate, min(report_year) AS min_year,
       max(report_year) AS max_year, count(DISTINCT organization_name) AS organizations,
       (SELECT claim_category FROM freq ORDER BY n DESC, claim_category LIMIT 1) AS most_common_category,
       (SELECT claim_category FROM rate ORDER BY fr DESC, claim_category LIMIT 1) AS highest_flag_category,
       round(avg(text_length), 6) AS avg_text_length,
       (SELECT feature FROM r WHERE rank = 1) AS strongest_feature,
       (SELECT corr FROM r WHERE rank = 1) AS strongest_corr
FROM claims_f"""))(lambda spark, sf: X.insights(num_feat(spark, sf), _EDA))

# ---------------------------------------------------------------- C16-C18, C4
_MED_COLS = ["claimed_value", "actual_measured_value", "value_deviation", "external_validation_score",
             "report_sentiment_score", "llm_claim_consistency_score", "text_length", "word_count",
             "greenwashing_flag", "report_year"]


def _median_table(spark, sf):
    q = column_quantiles(num_feat(spark, sf), _MED_COLS, [0.5])
    return q.select("column", F.round("value", 6).alias("median"))


register("median_table", NUM_F + "\nUNION ALL\n".join(
    f"SELECT '{c}' AS \"column\", round(median(CAST({c} AS DOUBLE)), 6) AS median FROM claims_f" for c in _MED_COLS))(
    _median_table)

register("histogram", TXT_F + """, b AS (SELECT min(text_length)::DOUBLE AS lo, max(text_length)::DOUBLE AS hi FROM claims_f),
h AS (SELECT CAST(CASE WHEN hi = lo THEN 0 ELSE least(floor((text_length - lo) / ((hi - lo) / 30)), 29) END AS INTEGER) AS bin
      FROM claims_f, b WHERE text_length IS NOT NULL),
e AS (SELECT CAST(unnest(range(30)) AS INTEGER) AS bin, lo, hi FROM b WHERE lo IS NOT NULL)
SELECT e.bin, round(lo + e.bin * (hi - lo) / 30, 6) AS bin_lo, round(lo + (e.bin + 1) * (hi - lo) / 30, 6) AS bin_hi,
       count(h.bin) AS n FROM e LEFT JOIN h ON h.bin = e.bin GROUP BY e.bin, lo, hi""")(
    lambda spark, sf: X.histogram(txt_feat(spark, sf), "text_length", 30))

register("histogram_by_flag", NUM + """, b AS (SELECT greenwashing_flag AS f, min(external_validation_score) AS lo, max(external_validation_score) AS hi
  FROM claims WHERE external_validation_score IS NOT NULL AND greenwashing_flag IS NOT NULL GROUP BY 1),
h AS (SELECT f, CAST(CASE WHEN hi = lo THEN 0 ELSE least(floor((external_validation_score - lo) / ((hi - lo) / 20)), 19) END AS INTEGER) AS bin
      FROM claims JOIN b ON f = greenwashing_flag WHERE external_validation_score IS NOT NULL),
e AS (SELECT f, CAST(unnest(range(20)) AS INTEGER) AS bin, lo, hi FROM b)
SELECT e.f AS greenwashing_flag, e.bin, round(lo + e.bin * (hi - lo) / 20, 6) AS bin_lo, round(lo + (e.bin + 1) * (hi - lo) / 20, 6) AS bin_hi,
       count(h.bin) AS n FROM e LEFT JOIN h ON h.f = e.f AND h.bin = e.bin GROUP BY e.f, e.bin, lo, hi""")(
    lambda spark, sf: X.histogram(claims_num(spark, sf), "external_validation_score", 20, by="greenwashing_flag"))

register("boxplot", NUM + """, q AS (
  SELECT greenwashing_flag, quantile_cont(report_sentiment_score, 0.25) AS q1, quantile_cont(report_sentiment_score, 0.5) AS med,
         quantile_cont(report_sentiment_score, 0.75) AS q3
  FROM claims WHERE greenwashing_flag IS NOT NULL AND report_sentiment_score IS NOT NULL GROUP BY greenwashing_flag)
SELECT greenwashing_flag, round(q1, 6) AS q1, round(med, 6) AS median, round(q3, 6) AS q3, round(q3 - q1, 6) AS iqr,
       round(q1 - 1.5 * (q3 - q1), 6) AS whisker_lo, round(q3 + 1.5 * (q3 - q1), 6) AS whisker_hi FROM q""")(
    lambda spark, sf: X.boxplot(claims_num(spark, sf), "report_sentiment_score", "greenwashing_flag"))

register("describe_text", TXT_F + "\nUNION ALL\n".join(f"""
SELECT '{c}' AS "column", count({c}) AS count, round(avg({c}), 6) AS mean, round(stddev_samp({c}), 6) AS std,
       round(min({c})::DOUBLE, 6) AS min, round(quantile_cont({c}, 0.25), 6) AS q25, round(quantile_cont({c}, 0.5), 6) AS q50,
       round(quantile_cont({c}, 0.75), 6) AS q75, round(max({c})::DOUBLE, 6) AS max FROM claims_f""" for c in ["text_length", "word_count"]))(
    lambda spark, sf: Q.describe(txt_feat(spark, sf), ["text_length", "word_count"]))

# ---------------------------------------------------------------- C1-C3, C5, D1, B4, B7, B22
_TXT_COLS = ["claim_id", "project_id", "organization_name", "report_year", "esg_claim_text", "claim_category",
             "claimed_metric_type", "claimed_value", "measurement_unit", "project_location", "actual_measured_value",
             "value_deviation", "external_validation_score", "greenwashing_flag", "controversy_flag", "source_doc_link",
             "report_sentiment_score", "llm_claim_consistency_score", "timestamp"]
_DOUBLE_COLS = {"claimed_value", "actual_measured_value", "value_deviation", "external_validation_score",
                "report_sentiment_score", "llm_claim_consistency_score"}


def _miss_sql(c):
    q = f'"{c}"'
    inner = f"count_if({q} IS NULL OR isnan({q}))" if c in _DOUBLE_COLS else f"count_if({q} IS NULL)"
    return f"CAST({inner} AS BIGINT)"


register("profile_nulls", TXT + "\nUNION ALL\n".join(
    f"SELECT '{c}' AS \"column\", {_miss_sql(c)} AS missing_count, round({_miss_sql(c)} * 100.0 / count(*), 6) AS missing_pct, "
    f"round(100.0 - round({_miss_sql(c)} * 100.0 / count(*), 6), 6) AS completeness_pct FROM claims" for c in _TXT_COLS))(
    lambda spark, sf: Q.missing_profile(claims_txt(spark, sf)))

register("table_profile", TXT + f"""
SELECT count(*) AS n_rows, {len(_TXT_COLS)} AS n_columns,
       CAST({' + '.join(_miss_sql(c) for c in _TXT_COLS)} AS BIGINT) AS missing_cells,
       (SELECT CAST(coalesce(sum(c - 1), 0) AS BIGINT) FROM (SELECT count(*) AS c FROM claims GROUP BY ALL_COLS)) AS duplicate_rows
FROM claims""".replace("GROUP BY ALL_COLS", "GROUP BY " + ", ".join(f'"{c}"' for c in _TXT_COLS)))(
    lambda spark, sf: Q.table_profile(claims_txt(spark, sf)).withColumn("n_columns", F.col("n_columns").cast("int")))


_ALL_COLS = ", ".join(f'"{c}"' for c in _TXT_COLS)

register("duplicates_full", TXT + f"""
SELECT CAST(coalesce(sum(c - 1), 0) AS BIGINT) AS duplicates, count(*) AS distinct_rows
FROM (SELECT count(*) AS c FROM claims GROUP BY {_ALL_COLS})""")(
    lambda spark, sf: Q.duplicate_count(claims_txt(spark, sf)))

register("duplicates_key", TXT + """
SELECT CAST(coalesce(sum(c - 1), 0) AS BIGINT) AS duplicates, count(*) AS distinct_rows
FROM (SELECT count(*) AS c FROM claims GROUP BY organization_name, esg_claim_text)""")(
    lambda spark, sf: Q.duplicate_count(claims_txt(spark, sf), ["organization_name", "esg_claim_text"]))

register("dedupe", TXT + """
SELECT claim_id, organization_name, esg_claim_text, claim_category FROM (SELECT DISTINCT * FROM claims)""")(
    lambda spark, sf: Q.dedupe(claims_txt(spark, sf)).select("claim_id", "organization_name", "esg_claim_text", "claim_category"))

register("clean_text", TXT + f"""
SELECT claim_id, coalesce({strip('esg_claim_text')}, 'No claim text provided') AS esg_claim_text FROM claims
WHERE length(coalesce({strip('esg_claim_text')}, 'No claim text provided')) >= 10""")(
    lambda spark, sf: Q.clean_text_quality(claims_txt(spark, sf)).select("claim_id", "esg_claim_text"))

register("length_bands", TXT + """
SELECT CAST(count_if(length(esg_claim_text) < 50) AS BIGINT) AS n_short,
       CAST(count_if(length(esg_claim_text) > 500) AS BIGINT) AS n_long,
       count(*) AS n_rows FROM claims""")(lambda spark, sf: Q.length_bands(claims_txt(spark, sf)))

register("length_band_samples", TXT + """, b AS (
  SELECT claim_id, length(esg_claim_text) AS length, esg_claim_text,
         CASE WHEN length(esg_claim_text) < 50 THEN 'short' WHEN length(esg_claim_text) > 500 THEN 'long' END AS band FROM claims)
SELECT band, CAST(row_number() OVER w AS INTEGER) AS rank, claim_id, CAST(length AS INTEGER) AS length, esg_claim_text FROM b WHERE band IS NOT NULL
WINDOW w AS (PARTITION BY band ORDER BY claim_id) QUALIFY row_number() OVER w <= 3""")(
    lambda spark, sf: Q.length_band_samples(claims_txt(spark, sf, ["claim_id", "esg_claim_text"]), "claim_id"))

_CLEAN_COLS = ["claim_id", "organization_name", "esg_claim_text", "claimed_value", "actual_measured_value", "greenwashing_flag",
               "controversy_flag", "timestamp"]


def _raw_claims(spark, sf):
    """The numeric claims as a raw file gives them (timestamp as text, padded claim text), controversial ones twice."""
    c = claims_num(spark, sf).select(*_CLEAN_COLS).withColumns({
        "timestamp": F.date_format("timestamp", "yyyy-MM-dd HH:mm:ss"), "esg_claim_text": F.concat(F.lit("  "), "esg_claim_text", F.lit("\t"))})
    times = F.when(F.col("controversy_flag") == 1, F.array(F.lit(1), F.lit(2))).otherwise(F.array(F.lit(1)))
    return c.select("*", F.explode(times).alias("_time")).drop("_time")  # the joins are made once


_RAW_SQL = NUM.rstrip("\n") + """, once AS (SELECT claim_id, organization_name, esg_claim_text, claimed_value, actual_measured_value,
  greenwashing_flag, controversy_flag, "timestamp" FROM claims)"""
register("clean_claims", _RAW_SQL + """
SELECT claim_id, organization_name, trim(esg_claim_text) AS esg_claim_text, claimed_value, actual_measured_value, greenwashing_flag,
       controversy_flag, CAST("timestamp" AS TIMESTAMP) AS "timestamp" FROM once""")(
    lambda spark, sf: Q.clean_claims(_raw_claims(spark, sf)).withColumn("timestamp", F.col("timestamp").cast("timestamp_ntz")))

register("cleaning_report", _RAW_SQL + """
SELECT count(*) + count_if(controversy_flag = 1) AS rows_before, count(*) AS rows_after, CAST(count_if(controversy_flag = 1) AS BIGINT) AS rows_removed,
       CAST(0 AS BIGINT) AS null_greenwashing_flag, CAST(0 AS BIGINT) AS null_controversy_flag, CAST(0 AS BIGINT) AS bad_claimed_value,
       CAST(0 AS BIGINT) AS bad_actual_measured_value, count(esg_claim_text) + count_if(controversy_flag = 1) AS stripped FROM once""")(
    lambda spark, sf: Q.cleaning_report(_raw_claims(spark, sf)))

register("coerce_numeric", """
SELECT c_custkey, TRY_CAST(substr(c_name, 10) AS DOUBLE) AS name_number, TRY_CAST(c_mktsegment AS DOUBLE) AS segment_number
FROM customer""")(
    lambda spark, sf: Q.coerce_numeric(table(spark, sf, "customer").select(
        "c_custkey", F.expr("substring(c_name, 10)").alias("name_number"),
        F.col("c_mktsegment").alias("segment_number")), ["name_number", "segment_number"]))

_QREC_MISS = lambda rel: " + ".join(_miss_sql(c) for c in _TXT_COLS)
register("quality_record", TXT + f""",
dd AS (SELECT DISTINCT * FROM claims),
cl AS (SELECT * REPLACE (coalesce({strip('esg_claim_text')}, 'No claim text provided') AS esg_claim_text) FROM dd),
clean AS (SELECT * FROM cl WHERE length(esg_claim_text) >= 10),
cat AS (SELECT claim_category, count(*) AS n FROM clean WHERE claim_category IS NOT NULL GROUP BY 1)
SELECT (SELECT count(*) FROM claims) AS original_rows, (SELECT count(*) FROM clean) AS cleaned_rows,
       (SELECT count(*) FROM claims) - (SELECT count(*) FROM clean) AS rows_removed,
       (SELECT count(*) FROM claims) - (SELECT count(*) FROM dd) AS duplicates_removed,
       (SELECT CAST({_QREC_MISS('claims')} AS BIGINT) FROM claims) AS missing_values_original,
       (SELECT CAST({_QREC_MISS('clean')} AS BIGINT) FROM clean) AS missing_values_cleaned,
       (SELECT min(length(esg_claim_text)) FROM clean) AS text_length_min,
       (SELECT max(length(esg_claim_text)) FROM clean) AS text_length_max,
       (SELECT round(avg(length(esg_claim_text)), 6) FROM clean) AS text_length_mean,
       (SELECT count(DISTINCT organization_name) FROM clean) AS unique_organizations,
       (SELECT count(DISTINCT project_location) FROM clean) AS unique_locations,
       (SELECT string_agg(claim_category || '=' || CAST(n AS VARCHAR), ',' ORDER BY claim_category || '=' || CAST(n AS VARCHAR)) FROM cat) AS category_distribution,
       (SELECT round(avg(greenwashing_flag), 6) FROM clean) AS greenwashing_rate""")(
    lambda spark, sf: Q.quality_record(claims_txt(spark, sf)).withColumns(
        {"text_length_min": F.col("text_length_min").cast("bigint"),
         "text_length_max": F.col("text_length_max").cast("bigint")}))

# ---------------------------------------------------------------- B8-B14, B21, D6
register("text_features", TXT + f"""
SELECT claim_id, {chars('esg_claim_text')} AS text_length, {words('esg_claim_text')} AS word_count,
       CASE WHEN {words('esg_claim_text')} > 0
            THEN round(length(replace(esg_claim_text, ' ', '')) / {words('esg_claim_text')}, 6) ELSE 0.0 END AS avg_word_length
FROM claims""")(
    lambda spark, sf: FE.text_features(claims_txt(spark, sf)).select(
        "claim_id", "text_length", "word_count", F.round("avg_word_length", 6).alias("avg_word_length")))

register("value_deviation", TXT + """
SELECT claim_id, round(coalesce(abs(value_deviation), 0.0), 6) AS deviation_abs,
       round(coalesce(value_deviation / nullif(claimed_value, 0.0), 0.0) * 100, 6) AS deviation_pct,
       round(abs(claimed_value - actual_measured_value), 6) AS abs_value_deviation,
       round(abs(claimed_value - actual_measured_value) / (abs(claimed_value) + 1e-6), 6) AS rel_value_deviation
FROM claims""")(
    lambda spark, sf: FE.value_features(claims_txt(spark, sf)).select(
        "claim_id", *[F.round(c, 6).alias(c) for c in
                      ["deviation_abs", "deviation_pct", "abs_value_deviation", "rel_value_deviation"]]))

_AVG_SQL = """CASE WHEN (CASE WHEN external_validation_score IS NULL OR isnan(external_validation_score) THEN 0 ELSE 1 END
  + CASE WHEN report_sentiment_score IS NULL OR isnan(report_sentiment_score) THEN 0 ELSE 1 END
  + CASE WHEN llm_claim_consistency_score IS NULL OR isnan(llm_claim_consistency_score) THEN 0 ELSE 1 END) = 0 THEN 0.0
  ELSE (coalesce(CASE WHEN isnan(external_validation_score) THEN NULL ELSE external_validation_score END, 0)
      + coalesce(CASE WHEN isnan(report_sentiment_score) THEN NULL ELSE report_sentiment_score END, 0)
      + coalesce(CASE WHEN isnan(llm_claim_consistency_score) THEN NULL ELSE llm_claim_consistency_score END, 0))
     / (CASE WHEN external_validation_score IS NULL OR isnan(external_validation_score) THEN 0 ELSE 1 END
  + CASE WHEN report_sentiment_score IS NULL OR isnan(report_sentiment_score) THEN 0 ELSE 1 END
  + CASE WHEN llm_claim_consistency_score IS NULL OR isnan(llm_claim_consistency_score) THEN 0 ELSE 1 END) END"""

register("avg_score", NUM + f"""
SELECT claim_id, round({_AVG_SQL}, 6) AS avg_score FROM claims""")(
    lambda spark, sf: claims_num(spark, sf).select(
        "claim_id", F.round(FE.row_mean_present(FE.SCORE_COLS), 6).alias("avg_score")))

register("label_encode", NUM + """
SELECT claim_id,
  CAST(dense_rank() OVER (ORDER BY coalesce(claim_category, 'nan')) - 1 AS INTEGER) AS claim_category_encoded,
  CAST(dense_rank() OVER (ORDER BY coalesce(claimed_metric_type, 'nan')) - 1 AS INTEGER) AS claimed_metric_type_encoded,
  CAST(dense_rank() OVER (ORDER BY coalesce(project_location, 'nan')) - 1 AS INTEGER) AS project_location_encoded
FROM claims""")(
    lambda spark, sf: FE.label_encode(claims_num(spark, sf)).select(
        "claim_id", "claim_category_encoded", "claimed_metric_type_encoded", "project_location_encoded"))

register("engineer_features", TXT + f"""
SELECT claim_id, {chars('esg_claim_text')} AS text_length, {words('esg_claim_text')} AS word_count,
  round(coalesce(abs(value_deviation), 0.0), 6) AS deviation_abs,
  round(coalesce(value_deviation / nullif(claimed_value, 0.0), 0.0) * 100, 6) AS deviation_pct,
  round({_AVG_SQL}, 6) AS avg_score,
  coalesce(CAST(year("timestamp") AS INTEGER), 0) AS year, coalesce(CAST(month("timestamp") AS INTEGER), 0) AS month,
  CAST(dense_rank() OVER (ORDER BY coalesce(claim_category, 'nan')) - 1 AS INTEGER) AS claim_category_encoded,
  CAST(dense_rank() OVER (ORDER BY coalesce(claimed_metric_type, 'nan')) - 1 AS INTEGER) AS claimed_metric_type_encoded,
  CAST(dense_rank() OVER (ORDER BY coalesce(project_location, 'nan')) - 1 AS INTEGER) AS project_location_encoded
FROM claims""")(
    lambda spark, sf: FE.engineer_features(claims_txt(spark, sf)).select(
        "claim_id", "text_length", "word_count", F.round("deviation_abs", 6).alias("deviation_abs"),
        F.round("deviation_pct", 6).alias("deviation_pct"), F.round("avg_score", 6).alias("avg_score"),
        "year", "month", "claim_category_encoded", "claimed_metric_type_encoded", "project_location_encoded"))


_IMPUTE_NUM = ["claimed_value", "actual_measured_value", "value_deviation", "external_validation_score", "report_year", "greenwashing_flag",
               "controversy_flag", "report_sentiment_score", "llm_claim_consistency_score"]
_IMPUTE_STR = ["organization_name", "claim_category", "claimed_metric_type", "measurement_unit", "project_location"]


def _impute(spark, sf):
    """Every numeric column filled with its median (a column without values stays NULL), every string column with 'unknown'."""
    df = claims_txt(spark, sf).select("claim_id", *_IMPUTE_NUM, *_IMPUTE_STR)
    df = written(df, "impute")  # read for the medians and for the result
    out = FE.impute(df, _IMPUTE_NUM, _IMPUTE_STR, IO.medians_table(df, _IMPUTE_NUM))
    return out.select("claim_id", *[F.round(c, 6).alias(c) for c in _IMPUTE_NUM], *_IMPUTE_STR)


register("impute", TXT + ", m AS (SELECT " + ", ".join(f"median(CAST({c} AS DOUBLE)) AS m_{c}" for c in _IMPUTE_NUM) + " FROM claims)\nSELECT claim_id, "
         + ", ".join(f"round(coalesce(CAST({c} AS DOUBLE), m_{c}), 6) AS {c}" for c in _IMPUTE_NUM) + ", "
         + ", ".join(f"coalesce({c}, 'unknown') AS {c}" for c in _IMPUTE_STR) + " FROM claims, m")(_impute)

_COMPLETE = ["claimed_value", "actual_measured_value", "external_validation_score", "report_year",
             "claimed_metric_type", "project_location", "greenwashing_flag"]


def _present(c):
    return f"{c} IS NOT NULL" + (f" AND NOT isnan({c})" if c in _DOUBLE_COLS else "")


register("drop_incomplete", TXT + f"""
SELECT claim_id, greenwashing_flag FROM claims WHERE {' AND '.join(_present(c) for c in _COMPLETE)}""")(
    lambda spark, sf: FE.drop_incomplete(claims_txt(spark, sf), _COMPLETE).select("claim_id", "greenwashing_flag"))

register("sample_md5", TXT + """
SELECT claim_id, claim_category FROM claims ORDER BY md5(CAST(claim_id AS VARCHAR) || '-42'), claim_id LIMIT 50""")(
    lambda spark, sf: claims_txt(spark, sf).select("claim_id", "claim_category")
    .orderBy(F.md5(F.concat(F.col("claim_id").cast("string"), F.lit("-42"))), "claim_id").limit(50))

register("display_truncate", TXT + """
SELECT claim_id, CASE WHEN length(esg_claim_text) > 100 THEN substr(esg_claim_text, 1, 100) || '...'
                      ELSE esg_claim_text END AS claim_text FROM claims""")(
    lambda spark, sf: claims_txt(spark, sf).select(
        "claim_id", truncate_display("esg_claim_text").alias("claim_text")))
