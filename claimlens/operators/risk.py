"""Lexicon and rule risk scores (H1-H15) as Column expressions.

Each score is one JVM-side expression over the claim text, so scoring a table
is a single projection inside whole-stage codegen (``lower(text)`` is computed
once by subexpression elimination).  Sums are built as left folds in the order
the rules add their terms, so the double results are bit-identical to the rule
definitions.  A NULL text never gets a score: ``least(1.0, NULL)`` is 1.0 in
Spark, so every cap is guarded.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from claimlens.functions import lexicons as L
from claimlens.functions.text import has_digit, truncate_display, word_count




LOWER = "_lower_text"


def with_lower(df: DataFrame, text: str) -> DataFrame:
    """Add ``lower(text)`` once as its own column; Catalyst keeps it in a separate projection
    (an expensive expression used many times is not inlined), so whole texts are lower-cased
    once per row instead of once per keyword."""
    return df.withColumn(LOWER, F.lower(F.col(text)))


def _c(c):
    return F.col(c) if isinstance(c, str) else c


def _has(t: Column, w: str) -> Column:
    return F.contains(t, F.lit(w))


def _fold(terms: Sequence[Column], start: float = 0.0) -> Column:
    out = F.lit(start)
    for t in terms:
        out = out + t
    return out


def _guard(text: Column, value: Column) -> Column:
    return F.when(text.isNotNull(), value)


def keyword_risk_v1(text, high: Sequence[str] = L.V1_HIGH, vague: Sequence[str] = L.V1_VAGUE,
                    lt: Column | None = None) -> Column:
    """H1: +0.3 per high-risk word present, +0.1 per vague word present, cap 1."""
    text = _c(text)
    t = lt if lt is not None else F.lower(text)
    s = _fold([F.when(_has(t, w), F.lit(0.3)).otherwise(F.lit(0.0)) for w in high]
              + [F.when(_has(t, w), F.lit(0.1)).otherwise(F.lit(0.0)) for w in vague])
    return _guard(text, F.least(F.lit(1.0), s))


def keyword_risk_v2(text, extreme: Sequence[str] = L.V2_EXTREME, high: Sequence[str] = L.V2_HIGH,
                    vague: Sequence[str] = L.V2_VAGUE, lt: Column | None = None) -> Column:
    """H2: +0.4 once if any extreme phrase, +0.2 per high word, +0.1 per vague word, cap 1."""
    text = _c(text)
    t = lt if lt is not None else F.lower(text)
    any_extreme = F.lit(False)
    for w in extreme:
        any_extreme = any_extreme | _has(t, w)
    s = _fold([F.when(any_extreme, F.lit(0.4)).otherwise(F.lit(0.0))]
              + [F.when(_has(t, w), F.lit(0.2)).otherwise(F.lit(0.0)) for w in high]
              + [F.when(_has(t, w), F.lit(0.1)).otherwise(F.lit(0.0)) for w in vague])
    return _guard(text, F.least(F.lit(1.0), s))


def v2_band(score) -> Column:
    score = _c(score)
    return (F.when(score > 0.5, F.lit(L.V2_BANDS[0])).when(score > 0.2, F.lit(L.V2_BANDS[1]))
            .when(score.isNotNull(), F.lit(L.V2_BANDS[2])))


def v2_analysis(score) -> Column:
    """The fallback analysis sentence: 'Keyword-based analysis: Risk score 0.40. <band>'."""
    score = _c(score)
    return F.concat(F.lit("Keyword-based analysis: Risk score "), F.format_string("%.2f", score),
                    F.lit(". "), v2_band(score))


def rag_risk(claim, n_sources, avg_source_score, analysis,
             negative: Sequence[str] = L.RAG_NEGATIVE, positive: Sequence[str] = L.RAG_POSITIVE,
             absolute: Sequence[str] = L.RAG_ABSOLUTE) -> Column:
    """H3: source relevance, analysis tone and absolutist claim wording, clamped to [0, 1].

    ``avg_source_score`` is the mean hit score (a hit without a score counts 0.5).
    """
    claim, n_sources, avg_source_score, analysis = map(_c, (claim, n_sources, avg_source_score, analysis))
    a = F.lower(F.coalesce(analysis, F.lit("")))
    neg = sum((_has(a, w).cast("int") for w in negative), F.lit(0))
    pos = sum((_has(a, w).cast("int") for w in positive), F.lit(0))
    src = F.when(F.coalesce(n_sources, F.lit(0)) > 0,
                 (F.lit(1.0) - F.coalesce(avg_source_score, F.lit(0.5))) * 0.3).otherwise(F.lit(0.6))
    tone = F.when(neg > pos, F.lit(0.3)).when(pos > neg, F.lit(-0.2)).otherwise(F.lit(0.0))
    c = F.lower(claim)
    absol = F.lit(False)
    for w in absolute:
        absol = absol | _has(c, w)
    r = (F.lit(0.0) + src) + tone + F.when(absol, F.lit(0.2)).otherwise(F.lit(0.0))
    return _guard(claim, F.greatest(F.lit(0.0), F.least(F.lit(1.0), r)))


def text_indicators(text, lt: Column | None = None) -> Column:
    """H4: ordered indicator labels present in the text (array<string>)."""
    text = _c(text)
    t = lt if lt is not None else F.lower(text)
    conds = [_has(text, "100%") | _has(t, "fully"),
             _has(t, "net zero") | _has(t, "net-zero"),
             _has(t, "sustainable") & _has(t, "committed"),
             _has(t, "carbon neutral"),
             _has(t, "renewable"),
             ~has_digit(text)]
    arr = F.array(*[F.when(c, F.lit(lbl)) for c, lbl in zip(conds, L.INDICATOR_LABELS)])
    return _guard(text, F.array_compact(arr))


def text_risk(text, lt: Column | None = None, indicators: Column | None = None) -> Column:
    """H4 score: min(1, 0.1 * #indicators + 0.2 * [raw text contains '100%'])."""
    text = _c(text)
    n = F.size(indicators if indicators is not None else text_indicators(text, lt))
    s = n * F.lit(0.1) + F.when(_has(text, "100%"), F.lit(0.2)).otherwise(F.lit(0.0))
    return _guard(text, F.least(s, F.lit(1.0)))


def text_analysis(df: DataFrame, text: str = "esg_claim_text") -> DataFrame:
    """H4 as columns: indicators, text risk, length, words, average word length."""
    t = F.col(text)
    wc = word_count(t)
    lt = F.col(LOWER) if LOWER in df.columns else None
    out = df.withColumn("risk_indicators", text_indicators(t, lt))
    return out.withColumns({
        "text_risk_score": text_risk(t, indicators=F.col("risk_indicators")),
        "avg_word_length": _guard(t, F.when(wc > 0, F.length(F.replace(t, F.lit(" "), F.lit(""))) / wc)
                                  .otherwise(F.lit(0.0))),
    })


def model_ensemble(gb, lr) -> Column:
    """H5: mean of the two model probabilities, an absent model counting 0.0."""
    return (F.coalesce(_c(gb), F.lit(0.0)) + F.coalesce(_c(lr), F.lit(0.0))) / 2


def overall_risk(gb, lr, text_score, rag_score, use_rag: bool = True) -> Column:
    """H6: max(gb, lr) * w1 + text * w2 + rag * w3, capped at 1 (weights .5/.25/.25 or .67/.33/0)."""
    w = (0.5, 0.25, 0.25) if use_rag else (0.67, 0.33, 0.0)
    g = F.greatest(F.coalesce(_c(gb), F.lit(0.0)), F.coalesce(_c(lr), F.lit(0.0)))
    rag = _c(rag_score) if use_rag else F.lit(0.0)
    s = g * w[0] + _c(text_score) * w[1] + F.coalesce(rag, F.lit(0.0)) * w[2]
    return F.when(_c(text_score).isNotNull(), F.least(s, F.lit(1.0)))


def risk_level(score) -> Column:
    """H7: > 0.6 HIGH, > 0.3 MEDIUM, else LOW (strict)."""
    score = _c(score)
    return (F.when(score > 0.6, F.lit("HIGH")).when(score > 0.3, F.lit("MEDIUM"))
            .when(score.isNotNull(), F.lit("LOW")))


def alert_text(level) -> Column:
    level = _c(level)
    return (F.when(level == "HIGH", F.lit(L.ALERT_TEXT["HIGH"]))
            .when(level == "MEDIUM", F.lit(L.ALERT_TEXT["MEDIUM"]))
            .when(level == "LOW", F.lit(L.ALERT_TEXT["LOW"])))


def agent_recommendations(level, indicators=None, intended: bool = False) -> Column:
    """H8: recommendations by level.  By default the indicator branches stay inactive
    (as observed); ``intended=True`` enables them from the H4 indicators."""
    level = _c(level)
    R = L.AGENT_RECS
    items = [F.when(level == "HIGH", F.lit(R["high_1"])), F.when(level == "HIGH", F.lit(R["high_2"])),
             F.when(level.isin("MEDIUM", "HIGH"), F.lit(R["medium"]))]
    if intended and indicators is not None:
        ind = _c(indicators)
        items += [F.when(F.array_contains(ind, "Vague language"), F.lit(R["vague"])),
                  F.when(F.array_contains(ind, L.INDICATOR_LABELS[0]), F.lit(R["extreme"]))]
    recs = F.array_compact(F.array(*items))
    return F.when(level.isNull(), F.lit(None)).when(F.size(recs) == 0, F.array(F.lit(R["none"]))).otherwise(recs)


def keyword_counts(text, families: dict[str, Sequence[str]] = L.ESG_KEYWORDS,
                   lt: Column | None = None) -> Column:
    """H9 counts: number of family words present, per family (struct)."""
    text = _c(text)
    t = lt if lt is not None else F.lower(text)
    return _guard(text, F.struct(*[sum((_has(t, w).cast("int") for w in ws), F.lit(0)).alias(k)
                                   for k, ws in families.items()]))


def keyword_issues(text, families: dict[str, Sequence[str]] = L.ESG_KEYWORDS,
                   vague_env: Sequence[str] = L.VAGUE_ENV, superlatives: Sequence[str] = L.SUPERLATIVES,
                   lt: Column | None = None) -> Column:
    """H9 issues (array<string>, in rule order)."""
    text = _c(text)
    t = lt if lt is not None else F.lower(text)
    gw = sum((_has(t, w).cast("int") for w in families["greenwashing_indicators"]), F.lit(0))
    vague = sum((_has(t, w).cast("int") for w in vague_env), F.lit(0))
    sup = sum((_has(t, w).cast("int") for w in superlatives), F.lit(0))
    I = L.ISSUE_TEXT
    arr = F.array(F.when(gw > 0, F.format_string(I["greenwash"].replace("{n}", "%d"), gw)),
                  F.when(vague > 2, F.lit(I["vague"])),
                  F.when(~has_digit(text), F.lit(I["no_metrics"])),
                  F.when(sup > 1, F.lit(I["superlatives"])))
    return _guard(text, F.array_compact(arr))


def weighted_risk(text, n_hits, mean_hit_score, gw_count, n_issues) -> Column:
    """Factors appended conditionally and zipped with the weights by position.

    f1 = 1 - mean hit score (0.8 without hits), f2 = min(0.2 gw, 1), f3 = min(0.15 issues, 1),
    then 0.3 (< 50 chars) or 0.1 (> 500 chars) if any, then 0.2 if no digit; the
    no-digit factor takes the 4th weight when there is no length factor.
    """
    text, n_hits, mean_hit_score, gw_count, n_issues = map(_c, (text, n_hits, mean_hit_score, gw_count, n_issues))
    w = L.FACTOR_WEIGHTS
    f1 = F.when(F.coalesce(n_hits, F.lit(0)) > 0, F.lit(1.0) - mean_hit_score).otherwise(F.lit(0.8))
    f2 = F.least(gw_count * F.lit(0.2), F.lit(1.0))
    f3 = F.least(n_issues * F.lit(0.15), F.lit(1.0))
    n = F.length(text)
    lenf = F.when(n < 50, F.lit(0.3)).when(n > 500, F.lit(0.1))
    digf = F.when(~has_digit(text), F.lit(0.2))
    s = (F.lit(0.0) + f1 * w[0] + f2 * w[1] + f3 * w[2]
         + F.coalesce(lenf * w[3], F.lit(0.0))
         + F.coalesce(digf * F.when(lenf.isNull(), F.lit(w[3])).otherwise(F.lit(w[4])), F.lit(0.0)))
    return _guard(text, F.least(s, F.lit(1.0)))


def notebook_recommendations(text, score, total_esg, intended: bool = False) -> Column:
    """By score band, + ESG terminology hint, + metrics hint (always, as observed;
    ``intended=True`` emits it only for claims without digits)."""
    text, score, total_esg = map(_c, (text, score, total_esg))
    R = L.NOTEBOOK_RECS
    band = (F.when(score > 0.7, F.array(F.lit(R["high_1"]), F.lit(R["high_2"])))
            .when(score > 0.5, F.array(F.lit(R["medium_1"]), F.lit(R["medium_2"])))
            .otherwise(F.array(F.lit(R["low"]))))
    metrics = F.when(~has_digit(text), F.lit(R["metrics"])) if intended else F.lit(R["metrics"])
    extra = F.array_compact(F.array(F.when(total_esg < 2, F.lit(R["terms"])), metrics))
    return _guard(text, F.concat(band, extra))


def calibrated_decision(prob, threshold) -> Column:
    """struct(risk_level, fraud_alert, recommendations) from p >= threshold."""
    hit = _c(prob) >= _c(threshold)
    return F.struct(F.when(hit, F.lit("HIGH")).otherwise(F.lit("LOW")).alias("risk_level"),
                    F.when(hit, F.lit("HIGH")).otherwise(F.lit("CLEAR")).alias("fraud_alert"),
                    F.when(hit, F.array(*[F.lit(x) for x in L.CALIBRATED_RECS_HIGH]))
                    .otherwise(F.array(*[F.lit(x) for x in L.CALIBRATED_RECS_LOW])).alias("recommendations"))


def verdict(prob_or_label, kind: str = "detector", threshold: float = 0.5) -> Column:
    """Verdict label from a probability (> threshold) or a 0/1 label."""
    yes, no = L.VERDICT_LABELS[kind]
    return F.when(_c(prob_or_label) > threshold, F.lit(yes)).otherwise(F.lit(no))


KEYWORD, DISPLAY, MISSING, EMPTY = "_keyword_risk", "_display", "_missing", "_empty"


def text_measures(df: DataFrame, text: str = "esg_claim_text", v2_lexicon: dict | None = None) -> DataFrame:
    """All that the claim analysis (H14, H15) reads from a text, as columns beside it: indicators, text
    and keyword risk, shortened text, and whether the text is NULL or empty.  With these a table can
    drop its texts before joins."""
    t = F.col(text)
    out = text_analysis(with_lower(df, text), text)
    return out.withColumns({KEYWORD: keyword_risk_v2(t, **(v2_lexicon or {}), lt=F.col(LOWER)),
                            DISPLAY: truncate_display(t), MISSING: t.isNull(),
                            EMPTY: F.coalesce(t == "", F.lit(False))}).drop(LOWER)


def analyze_claims(df: DataFrame, text: str = "esg_claim_text", gb: str | None = None, lr: str | None = None,
                   rag: str | None = None, use_rag: bool = True, intended: bool = False,
                   v2_lexicon: dict | None = None) -> DataFrame:
    """Text analysis -> model scores -> retrieval/keyword risk -> blend -> alert -> recommendations.

    ``gb``/``lr`` name model-probability columns (absent -> 0.0 and a model note);
    ``rag`` names a retrieval-risk column, otherwise the keyword fallback (H2) is used,
    which is what the single-claim path does without a language model.  A table that already
    has its ``text_measures`` needs no text column.
    """
    out = df if KEYWORD in df.columns else text_measures(df, text, v2_lexicon)
    gb_c = F.col(gb) if gb else F.lit(None).cast("double")
    lr_c = F.col(lr) if lr else F.lit(None).cast("double")
    kw = F.col(KEYWORD)
    rag_c = F.col(rag) if rag else kw
    out = out.withColumns({
        "greenwashing_risk_gb": F.coalesce(gb_c, F.lit(0.0)),
        "greenwashing_risk_lr": F.coalesce(lr_c, F.lit(0.0)),
        "model_note": F.when(gb_c.isNull() | lr_c.isNull(), F.lit("model not available")),
        "rag_risk_score": rag_c if use_rag else F.lit(0.0),
        "rag_analysis": v2_analysis(kw) if not rag else F.lit(None).cast("string"),
    })
    out = out.withColumn("overall_risk_score", overall_risk("greenwashing_risk_gb", "greenwashing_risk_lr",
                                                            "text_risk_score", "rag_risk_score", use_rag))
    out = out.withColumn("risk_level", risk_level("overall_risk_score"))
    out = out.withColumn("fraud_alert", alert_text("risk_level"))
    out = out.withColumn("recommendations", agent_recommendations("risk_level", "risk_indicators", intended))
    return out if KEYWORD in df.columns else out.drop(KEYWORD, DISPLAY, MISSING, EMPTY)


def batch_defaults(df: DataFrame) -> DataFrame:
    """Per-row defaults of an uploaded claim file."""
    d = L.BATCH_DEFAULTS
    add = {}
    for c, v in d.items():
        if c in df.columns:
            add[c] = F.coalesce(F.col(c), F.lit(v))
        else:
            add[c] = F.lit(v)
    return df.withColumns(add)


def batch_analysis(df: DataFrame, text: str = "esg_claim_text", id_col: str = "claim_id",
                   prob: str | None = None, threshold: str | float | None = None,
                   include_rag: bool = True, v2_lexicon: dict | None = None) -> DataFrame:
    """The 11-column batch result.  Empty texts are skipped; a NULL text gives an
    ``ERROR`` row.  With ``prob`` + ``threshold`` the calibrated path (H12) is used,
    otherwise the agent path (H14) whose ``fraud_alert`` holds the alert sentence."""
    measured = df if KEYWORD in df.columns else text_measures(df, text, v2_lexicon)
    base = batch_defaults(measured.where(~F.col(EMPTY)))
    kw = F.col(KEYWORD)
    shown = [F.col(id_col).alias("claim_id"), F.col(DISPLAY).alias("claim_text")]
    if prob is not None:
        thr = F.lit(float(threshold)) if isinstance(threshold, (int, float)) else F.col(threshold)
        dec = calibrated_decision(F.col(prob), thr)
        rows = base.select(
            *shown, dec["risk_level"].alias("risk_level"), F.col(prob).alias("risk_score"),
            dec["fraud_alert"].alias("fraud_alert"), F.col("claim_category").alias("category"),
            F.col(prob).alias("advanced_risk"), thr.alias("threshold"),
            (kw if include_rag else F.lit(0.0)).alias("rag_risk"),
            (v2_analysis(kw) if include_rag else F.lit("RAG not run")).alias("rag_analysis"), F.col(MISSING).alias("_err"))
    else:
        rows = analyze_claims(base, text).select(
            *shown, "risk_level", F.col("overall_risk_score").alias("risk_score"), "fraud_alert",
            F.col("claim_category").alias("category"), F.lit(0.0).alias("advanced_risk"),
            F.lit(0.0).alias("threshold"), F.col("rag_risk_score").alias("rag_risk"),
            F.col("rag_analysis"), F.col(MISSING).alias("_err"))
    err = F.col("_err")
    return rows.select(
        "claim_id", "claim_text",
        F.when(err, F.lit("ERROR")).otherwise(F.col("risk_level")).alias("risk_level"),
        F.when(err, F.lit(0.0)).otherwise(F.col("risk_score")).alias("risk_score"),
        F.when(err, F.lit("Analysis Failed")).otherwise(F.col("fraud_alert")).alias("fraud_alert"),
        "category",
        F.when(err, F.lit(0.0)).otherwise(F.col("advanced_risk")).alias("advanced_risk"),
        F.when(err, F.lit(0.0)).otherwise(F.col("threshold")).alias("threshold"),
        F.when(err, F.lit(0.0)).otherwise(F.col("rag_risk")).alias("rag_risk"),
        F.when(err, F.lit("")).otherwise(F.col("rag_analysis")).alias("rag_analysis"),
        F.when(err, F.lit("Error: claim text is missing")).otherwise(F.lit("Success")).alias("analysis_status"))


def batch_summary(results: DataFrame) -> DataFrame:
    """C20: total, mean risk, risk > 0.5, fraud alerts == 'HIGH', success rate (%)."""
    return results.agg(F.count(F.lit(1)).alias("total_claims"),
                       F.round(F.avg("risk_score"), 6).alias("avg_risk"),
                       F.count_if(F.col("risk_score") > 0.5).alias("high_risk_claims"),
                       F.count_if(F.col("fraud_alert") == "HIGH").alias("fraud_alerts"),
                       F.round(F.count_if(F.col("analysis_status") == "Success") * 100.0 / F.count(F.lit(1)), 6)
                       .alias("success_rate"))


def risk_distribution(results: DataFrame) -> DataFrame:
    """Claims per risk level."""
    return results.groupBy("risk_level").agg(F.count(F.lit(1)).alias("n"))


def sentiment_polarity(df: DataFrame, id_col: str, text: str, lexicon: DataFrame, token: str | None = None) -> DataFrame:
    """H13 (re-aimed): polarity = mean weight of the lexicon words found in the text (each
    occurrence counts), 0.0 when none is found.  ``lexicon`` is a ``(term, polarity)`` table,
    joined without a hint (AQE broadcasts it when its measured size is small); texts are
    tokenised whole and only matched tokens are aggregated."""
    from claimlens.functions.text import TOKEN
    tok = df.select(id_col, F.explode(F.regexp_extract_all(F.lower(F.col(text)), F.lit(token or TOKEN), 0))
                    .alias("term"))
    # polarities carry at most 3 decimals: summing them as integer milli-units makes the mean
    # independent of the summation order (one final division)
    milli = F.round(F.col("polarity") * 1000).cast("long")
    hits = tok.join(lexicon, "term").groupBy(id_col).agg(
        (F.sum(milli) / (F.count(F.lit(1)) * 1000.0)).alias("_p"), F.count(F.lit(1)).alias("n_matched"))
    return (df.select(id_col).join(hits, id_col, "left")
            .select(id_col, F.coalesce("_p", F.lit(0.0)).alias("polarity"),
                    F.coalesce("n_matched", F.lit(0)).alias("n_matched")))
