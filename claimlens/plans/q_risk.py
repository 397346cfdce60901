"""Lexicon/rule risk queries (H1-H15, C20-C21) over the document claims."""

from __future__ import annotations

from pyspark.sql import functions as F

from claimlens.functions import lexicons as L
from claimlens.functions.text import DIGIT
from claimlens.operators import risk as RK
from claimlens.plans.registry import register
from claimlens.plans.sqlparts import TXT, contains
from claimlens.session import materialize, small
from claimlens.sources.claims import claims_txt

D = "::DOUBLE"
DATA_LEX = {"extreme": L.DATA_V2_EXTREME, "high": L.DATA_V2_HIGH, "vague": L.DATA_V2_VAGUE}


def _when_add(t, w, x):
    return f"CASE WHEN {contains(t, w)} THEN {x}{D} ELSE 0.0{D} END"


def _fold(terms):
    s = f"0.0{D}"
    for x in terms:
        s = f"({s} + {x})"
    return s


def _guard(t, e):
    return f"CASE WHEN {t} IS NULL THEN NULL ELSE {e} END"


def sql_v1(t="esg_claim_text"):
    lt = f"lower({t})"
    s = _fold([_when_add(lt, w, 0.3) for w in L.V1_HIGH] + [_when_add(lt, w, 0.1) for w in L.V1_VAGUE])
    return _guard(t, f"least(1.0{D}, {s})")


def sql_v2(t="esg_claim_text", extreme=L.V2_EXTREME, high=L.V2_HIGH, vague=L.V2_VAGUE):
    lt = f"lower({t})"
    anyx = " OR ".join(contains(lt, w) for w in extreme)
    s = _fold([f"CASE WHEN {anyx} THEN 0.4{D} ELSE 0.0{D} END"] + [_when_add(lt, w, 0.2) for w in high]
              + [_when_add(lt, w, 0.1) for w in vague])
    return _guard(t, f"least(1.0{D}, {s})")


def sql_v2_analysis(s):
    band = (f"CASE WHEN {s} > 0.5 THEN '{L.V2_BANDS[0]}' WHEN {s} > 0.2 THEN '{L.V2_BANDS[1]}' "
            f"WHEN {s} IS NOT NULL THEN '{L.V2_BANDS[2]}' END")
    return f"'Keyword-based analysis: Risk score ' || printf('%.2f', {s}) || '. ' || {band}"


def sql_indicators(t="esg_claim_text"):
    lt = f"lower({t})"
    conds = [f"({contains(t, '100%')} OR {contains(lt, 'fully')})",
             f"({contains(lt, 'net zero')} OR {contains(lt, 'net-zero')})",
             f"({contains(lt, 'sustainable')} AND {contains(lt, 'committed')})",
             contains(lt, "carbon neutral"), contains(lt, "renewable"),
             f"(NOT regexp_matches({t}, '{DIGIT}'))"]
    arr = "list_filter([" + ", ".join(f"CASE WHEN {c} THEN '{lbl}' END" for c, lbl in zip(conds, L.INDICATOR_LABELS)) \
        + "], lambda x: x IS NOT NULL)"
    return _guard(t, arr)


def sql_text_risk(t="esg_claim_text"):
    n = f"len({sql_indicators(t)})"
    return _guard(t, f"least({n} * 0.1{D} + CASE WHEN {contains(t, '100%')} THEN 0.2{D} ELSE 0.0{D} END, 1.0{D})")


def measured(spark, sf, **columns):
    """Document claims as ``claim_id`` and the given expressions of their texts (see ``risk.with_lower``),
    which are computed before the claim view's joins."""
    def measure(d):
        return RK.with_lower(d, "esg_claim_text").withColumns(columns).drop("esg_claim_text", RK.LOWER)
    return claims_txt(spark, sf, ["claim_id"], measure)


def _lt():
    return F.col(RK.LOWER)


def _count(lt, ws):
    return "(" + " + ".join(f"CAST({contains(lt, w)} AS INTEGER)" for w in ws) + ")"


# ---------------------------------------------------------------- H1, H2
register("keyword_risk_v1", TXT + f"""
SELECT claim_id, round({sql_v1()}, 6) AS keyword_risk FROM claims""")(
    lambda spark, sf: measured(spark, sf, keyword_risk=F.round(RK.keyword_risk_v1("esg_claim_text", lt=_lt()), 6)))

register("keyword_risk_v2", TXT + f"""
SELECT claim_id, round(s, 6) AS rag_risk_score, {sql_v2_analysis('s')} AS analysis
FROM (SELECT claim_id, {sql_v2()} AS s FROM claims)""")(
    lambda spark, sf: measured(spark, sf, s=RK.keyword_risk_v2("esg_claim_text", lt=_lt()))
    .select("claim_id", F.round("s", 6).alias("rag_risk_score"), RK.v2_analysis("s").alias("analysis")))

register("keyword_risk_v2_data", TXT + f"""
SELECT claim_id, round(s, 6) AS rag_risk_score, {sql_v2_analysis('s')} AS analysis
FROM (SELECT claim_id, {sql_v2('esg_claim_text', L.DATA_V2_EXTREME, L.DATA_V2_HIGH, L.DATA_V2_VAGUE)} AS s FROM claims)""")(
    lambda spark, sf: measured(spark, sf, s=RK.keyword_risk_v2("esg_claim_text", **DATA_LEX, lt=_lt()))
    .select("claim_id", F.round("s", 6).alias("rag_risk_score"), RK.v2_analysis("s").alias("analysis")))

# ---------------------------------------------------------------- H4
register("text_indicators", TXT + f"""
SELECT claim_id, array_to_string({sql_indicators()}, '|') AS risk_indicators,
       CAST(len({sql_indicators()}) AS INTEGER) AS n_indicators, round({sql_text_risk()}, 6) AS text_risk_score
FROM claims""")(
    lambda spark, sf: claims_txt(spark, sf, ["claim_id"], lambda d: RK.text_analysis(RK.with_lower(d, "esg_claim_text"))
                                 .select("doc_id", "source", "lang", "risk_indicators", "text_risk_score")).select(
        "claim_id", F.concat_ws("|", "risk_indicators").alias("risk_indicators"), F.size("risk_indicators").alias("n_indicators"),
        F.round("text_risk_score", 6).alias("text_risk_score")))

# ---------------------------------------------------------------- H9
_LT = "lower(esg_claim_text)"
_FAM = L.ESG_KEYWORDS
_ISSUES_SQL = ("list_filter([" + ", ".join([
    f"CASE WHEN {_count(_LT, _FAM['greenwashing_indicators'])} > 0 THEN "
    f"'Contains ' || CAST({_count(_LT, _FAM['greenwashing_indicators'])} AS VARCHAR) || ' potential greenwashing indicators' END",
    f"CASE WHEN {_count(_LT, L.VAGUE_ENV)} > 2 THEN '{L.ISSUE_TEXT['vague']}' END",
    f"CASE WHEN NOT regexp_matches(esg_claim_text, '{DIGIT}') THEN '{L.ISSUE_TEXT['no_metrics']}' END",
    f"CASE WHEN {_count(_LT, L.SUPERLATIVES)} > 1 THEN '{L.ISSUE_TEXT['superlatives']}' END"]) + "], lambda x: x IS NOT NULL)")

register("keyword_issues", TXT + f"""
SELECT claim_id, {_count(_LT, _FAM['environmental'])} AS environmental, {_count(_LT, _FAM['social'])} AS social,
       {_count(_LT, _FAM['governance'])} AS governance, {_count(_LT, _FAM['greenwashing_indicators'])} AS greenwashing_indicators,
       array_to_string({_ISSUES_SQL}, '|') AS issues, CAST(len({_ISSUES_SQL}) AS INTEGER) AS n_issues,
       {_count(_LT, _FAM['environmental'])} + {_count(_LT, _FAM['social'])} + {_count(_LT, _FAM['governance'])} AS total_esg_keywords
FROM claims WHERE esg_claim_text IS NOT NULL""")(
    lambda spark, sf: measured(spark, sf, k=RK.keyword_counts("esg_claim_text", lt=_lt()),
                               i=RK.keyword_issues("esg_claim_text", lt=_lt()), given=F.col("esg_claim_text").isNotNull())
    .where("given")
    .select("claim_id", "k.environmental", "k.social", "k.governance", "k.greenwashing_indicators",
            F.concat_ws("|", "i").alias("issues"), F.size("i").alias("n_issues"),
            (F.col("k.environmental") + F.col("k.social") + F.col("k.governance")).alias("total_esg_keywords")))


# ---------------------------------------------------------------- H5-H8 with data-derived model scores
def _overall(spark, sf):
    t = F.col("esg_claim_text")

    def measure(d):
        return RK.with_lower(d, "esg_claim_text").withColumns(
            {"text_risk": RK.text_risk(t, lt=_lt()), "rag": RK.keyword_risk_v2(t, lt=_lt()), "given": t.isNotNull()}) \
            .drop("esg_claim_text", RK.LOWER)

    # texts are scored once; the group means and the blend read the written scores
    c = materialize(claims_txt(spark, sf, ["claim_id", "organization_name", "claim_category", "greenwashing_flag"], measure))
    org = small(c.groupBy("organization_name").agg(F.avg("greenwashing_flag").alias("gb")))
    cat = small(c.groupBy("claim_category").agg(F.avg("greenwashing_flag").alias("lr")))
    j = c.where("given").join(org, "organization_name", "left").join(cat, "claim_category", "left")
    j = j.withColumn("overall", RK.overall_risk("gb", "lr", "text_risk", "rag", True))
    j = j.withColumn("level", RK.risk_level("overall"))
    return j.select("claim_id", F.round(RK.model_ensemble("gb", "lr"), 6).alias("greenwashing_risk"),
                    F.round("overall", 6).alias("overall_risk_score"),
                    F.round(RK.overall_risk("gb", "lr", "text_risk", "rag", False), 6).alias("overall_no_rag"),
                    F.col("level").alias("risk_level"), RK.alert_text("level").alias("fraud_alert"),
                    F.concat_ws("|", RK.agent_recommendations("level")).alias("recommendations"))


_LEVEL = lambda s: f"CASE WHEN {s} > 0.6 THEN 'HIGH' WHEN {s} > 0.3 THEN 'MEDIUM' WHEN {s} IS NOT NULL THEN 'LOW' END"
_R = L.AGENT_RECS
register("overall_risk", TXT + f""",
org AS (SELECT organization_name, avg(greenwashing_flag) AS gb FROM claims GROUP BY 1),
cat AS (SELECT claim_category, avg(greenwashing_flag) AS lr FROM claims GROUP BY 1),
j AS (SELECT c.claim_id, coalesce(o.gb, 0.0{D}) AS gb, coalesce(k.lr, 0.0{D}) AS lr,
             {sql_text_risk('c.esg_claim_text')} AS text_risk, {sql_v2('c.esg_claim_text')} AS rag
      FROM claims c LEFT JOIN org o ON c.organization_name IS NOT DISTINCT FROM o.organization_name
      LEFT JOIN cat k ON c.claim_category IS NOT DISTINCT FROM k.claim_category WHERE c.esg_claim_text IS NOT NULL),
s AS (SELECT *, least(greatest(gb, lr) * 0.5{D} + text_risk * 0.25{D} + rag * 0.25{D}, 1.0{D}) AS overall,
             least(greatest(gb, lr) * 0.67{D} + text_risk * 0.33{D} + 0.0{D} * 0.0{D}, 1.0{D}) AS overall_no_rag FROM j),
l AS (SELECT *, {_LEVEL('overall')} AS lvl FROM s)
SELECT claim_id, round((gb + lr) / 2, 6) AS greenwashing_risk, round(overall, 6) AS overall_risk_score,
       round(overall_no_rag, 6) AS overall_no_rag, lvl AS risk_level,
       CASE lvl WHEN 'HIGH' THEN '{L.ALERT_TEXT['HIGH']}' WHEN 'MEDIUM' THEN '{L.ALERT_TEXT['MEDIUM']}' ELSE '{L.ALERT_TEXT['LOW']}' END AS fraud_alert,
       CASE lvl WHEN 'HIGH' THEN '{_R['high_1']}|{_R['high_2']}|{_R['medium']}' WHEN 'MEDIUM' THEN '{_R['medium']}'
                ELSE '{_R['none']}' END AS recommendations
FROM l""")(_overall)


# ---------------------------------------------------------------- H15, C20, C21 (agent path, no model files)
def analysed(spark, sf, lex=None, columns=("claim_id", "claim_category")):
    """Document claims with the text measures of the claim analysis in place of their texts."""
    return claims_txt(spark, sf, columns, lambda d: RK.text_measures(d, "esg_claim_text", lex).drop("esg_claim_text"))


def _batch(spark, sf, lex=None):
    return RK.batch_analysis(analysed(spark, sf, lex))


def _batch_sql(lex=None):
    v2 = sql_v2("esg_claim_text", **(lex or {}))
    return TXT + f""",
b AS (SELECT claim_id, esg_claim_text, coalesce(claim_category, 'Environmental') AS category,
             {sql_text_risk()} AS text_risk, {v2} AS rag FROM claims WHERE esg_claim_text IS NULL OR esg_claim_text <> ''),
s AS (SELECT *, least(0.0{D} * 0.5{D} + text_risk * 0.25{D} + rag * 0.25{D}, 1.0{D}) AS overall FROM b),
l AS (SELECT *, {_LEVEL('overall')} AS lvl FROM s)
SELECT claim_id,
  CASE WHEN length(esg_claim_text) > 100 THEN substr(esg_claim_text, 1, 100) || '...' ELSE esg_claim_text END AS claim_text,
  CASE WHEN esg_claim_text IS NULL THEN 'ERROR' ELSE lvl END AS risk_level,
  CASE WHEN esg_claim_text IS NULL THEN 0.0{D} ELSE overall END AS risk_score,
  CASE WHEN esg_claim_text IS NULL THEN 'Analysis Failed'
       ELSE CASE lvl WHEN 'HIGH' THEN '{L.ALERT_TEXT['HIGH']}' WHEN 'MEDIUM' THEN '{L.ALERT_TEXT['MEDIUM']}' ELSE '{L.ALERT_TEXT['LOW']}' END END AS fraud_alert,
  category, 0.0{D} AS advanced_risk, 0.0{D} AS threshold,
  CASE WHEN esg_claim_text IS NULL THEN 0.0{D} ELSE rag END AS rag_risk,
  CASE WHEN esg_claim_text IS NULL THEN '' ELSE {sql_v2_analysis('rag')} END AS rag_analysis,
  CASE WHEN esg_claim_text IS NULL THEN 'Error: claim text is missing' ELSE 'Success' END AS analysis_status
FROM l"""


def _rounded(df):
    return df.withColumns({c: F.round(c, 6) for c in ["risk_score", "rag_risk"]})


register("batch_analysis", _batch_sql()
         .replace("ELSE overall END AS risk_score", "ELSE round(overall, 6) END AS risk_score")
         .replace("ELSE rag END AS rag_risk", "ELSE round(rag, 6) END AS rag_risk"))(
    lambda spark, sf: _rounded(_batch(spark, sf)))

register("batch_analysis_data", _batch_sql(DATA_LEX)
         .replace("ELSE overall END AS risk_score", "ELSE round(overall, 6) END AS risk_score")
         .replace("ELSE rag END AS rag_risk", "ELSE round(rag, 6) END AS rag_risk"))(
    lambda spark, sf: _rounded(_batch(spark, sf, DATA_LEX)))

register("batch_summary", "WITH r AS (" + _batch_sql(DATA_LEX) + """)
SELECT count(*) AS total_claims, round(avg(risk_score), 6) AS avg_risk,
       CAST(count_if(risk_score > 0.5) AS BIGINT) AS high_risk_claims,
       CAST(count_if(fraud_alert = 'HIGH') AS BIGINT) AS fraud_alerts,
       round(count_if(analysis_status = 'Success') * 100.0 / count(*), 6) AS success_rate FROM r""")(
    lambda spark, sf: RK.batch_summary(_batch(spark, sf, DATA_LEX)))

register("risk_distribution", "WITH r AS (" + _batch_sql(DATA_LEX) + """)
SELECT risk_level, count(*) AS n FROM r GROUP BY risk_level""")(
    lambda spark, sf: RK.risk_distribution(_batch(spark, sf, DATA_LEX)))


# ---------------------------------------------------------------- H12 calibrated path, B25 verdicts
# Fixed value: the stored decision threshold of the calibrated model.
STORED_THRESHOLD = 0.2626


def _calibrated(spark, sf):
    c = materialize(analysed(spark, sf, DATA_LEX, ["claim_id", "claim_category", "organization_name", "greenwashing_flag"]))
    org = small(c.groupBy("organization_name").agg(F.avg("greenwashing_flag").alias("p")))
    j = c.join(org, "organization_name", "left").withColumn("p", F.coalesce("p", F.lit(0.0)))
    out = RK.batch_analysis(j, prob="p", threshold=STORED_THRESHOLD)
    return _rounded(out).withColumns({"advanced_risk": F.round("advanced_risk", 6),
                                      "verdict": RK.verdict("risk_score")})


register("batch_analysis_calibrated", TXT + f""",
org AS (SELECT organization_name, avg(greenwashing_flag) AS p FROM claims GROUP BY 1),
b AS (SELECT c.claim_id, c.esg_claim_text, coalesce(c.claim_category, 'Environmental') AS category,
             coalesce(o.p, 0.0{D}) AS p, {sql_v2('c.esg_claim_text', L.DATA_V2_EXTREME, L.DATA_V2_HIGH, L.DATA_V2_VAGUE)} AS rag
      FROM claims c LEFT JOIN org o ON c.organization_name IS NOT DISTINCT FROM o.organization_name
      WHERE c.esg_claim_text IS NULL OR c.esg_claim_text <> '')
SELECT claim_id,
  CASE WHEN length(esg_claim_text) > 100 THEN substr(esg_claim_text, 1, 100) || '...' ELSE esg_claim_text END AS claim_text,
  CASE WHEN esg_claim_text IS NULL THEN 'ERROR' WHEN p >= {STORED_THRESHOLD}::DOUBLE THEN 'HIGH' ELSE 'LOW' END AS risk_level,
  CASE WHEN esg_claim_text IS NULL THEN 0.0 ELSE round(p, 6) END AS risk_score,
  CASE WHEN esg_claim_text IS NULL THEN 'Analysis Failed' WHEN p >= {STORED_THRESHOLD}::DOUBLE THEN 'HIGH' ELSE 'CLEAR' END AS fraud_alert,
  category, CASE WHEN esg_claim_text IS NULL THEN 0.0 ELSE round(p, 6) END AS advanced_risk,
  CASE WHEN esg_claim_text IS NULL THEN 0.0::DOUBLE ELSE {STORED_THRESHOLD}::DOUBLE END AS threshold,
  CASE WHEN esg_claim_text IS NULL THEN 0.0 ELSE round(rag, 6) END AS rag_risk,
  CASE WHEN esg_claim_text IS NULL THEN '' ELSE {sql_v2_analysis('rag')} END AS rag_analysis,
  CASE WHEN esg_claim_text IS NULL THEN 'Error: claim text is missing' ELSE 'Success' END AS analysis_status,
  CASE WHEN (CASE WHEN esg_claim_text IS NULL THEN 0.0 ELSE round(p, 6) END) > 0.5 THEN 'GREEN-WASH' ELSE 'Clean' END AS verdict
FROM b""")(_calibrated)

# ---------------------------------------------------------------- H13 polarity from a lexicon table
def _polarity(spark, sf):
    from claimlens.sources.tables import table
    lex = spark.createDataFrame(list(L.DATA_POLARITY.items()), "term string, polarity double")
    out = RK.sentiment_polarity(table(spark, sf, "documents"), "doc_id", "text", lex)
    return out.select("doc_id", (F.floor(F.col("polarity") * 1e6 + 0.5) / 1e6).alias("polarity"),
                      F.col("n_matched").cast("bigint"))


def _polarity_sql():
    from claimlens.functions.text import TOKEN
    vals = ", ".join(f"('{k}', {v}::DOUBLE)" for k, v in L.DATA_POLARITY.items())
    return f"""WITH lex(term, polarity) AS (VALUES {vals}),
tok AS (SELECT doc_id, unnest(regexp_extract_all(lower(text), '{TOKEN}')) AS term FROM documents),
h AS (SELECT doc_id, sum(CAST(round(polarity * 1000) AS BIGINT)) / (count(*) * 1000.0) AS p, count(*) AS n
      FROM tok JOIN lex USING (term) GROUP BY doc_id)
SELECT d.doc_id, floor(coalesce(h.p, 0.0) * 1e6 + 0.5) / 1e6 AS polarity, CAST(coalesce(h.n, 0) AS BIGINT) AS n_matched
FROM documents d LEFT JOIN h ON d.doc_id = h.doc_id"""


register("sentiment_lexicon", _polarity_sql())(_polarity)
