"""K1 stream query: the documents parquet (a file, or a folder of files) as a file source, scored with the batch transform."""

from __future__ import annotations

import os

from claimlens.functions import lexicons as L
from claimlens.plans.q_risk import sql_text_risk, sql_v2, sql_v2_analysis  # noqa: F401
from claimlens.plans.registry import register
from claimlens.sources.tables import table
from claimlens.streaming.scoring import score_claims, stream_score

DATA_LEX = {"extreme": L.DATA_V2_EXTREME, "high": L.DATA_V2_HIGH, "vague": L.DATA_V2_VAGUE}


def _stream(spark, sf):
    docs = table(spark, sf, "documents")
    # a plain path must be a folder for a file source; a pattern may match a file or a folder
    out = stream_score(spark, os.path.join(sf, "documents.parque[t]"), docs.schema, "doc_id", "text", v2_lexicon=DATA_LEX)
    return spark.read.schema(score_claims(docs, "doc_id", "text", v2_lexicon=DATA_LEX).schema).parquet(out)


_A = L.ALERT_TEXT
_R = L.AGENT_RECS
_LEVEL = "CASE WHEN o > 0.6 THEN 'HIGH' WHEN o > 0.3 THEN 'MEDIUM' WHEN o IS NOT NULL THEN 'LOW' END"
register("stream_scoring", f"""
WITH s AS (SELECT doc_id, {sql_text_risk('text')} AS t, {sql_v2('text', L.DATA_V2_EXTREME, L.DATA_V2_HIGH, L.DATA_V2_VAGUE)} AS r
           FROM documents),
o AS (SELECT *, least(0.0::DOUBLE * 0.5::DOUBLE + t * 0.25::DOUBLE + r * 0.25::DOUBLE, 1.0::DOUBLE) AS o FROM s),
l AS (SELECT *, {_LEVEL} AS lvl FROM o)
SELECT doc_id AS claim_id, round(t, 6) AS text_risk_score, round(r, 6) AS rag_risk_score, round(o, 6) AS overall_risk_score,
       lvl AS risk_level,
       CASE lvl WHEN 'HIGH' THEN '{_A['HIGH']}' WHEN 'MEDIUM' THEN '{_A['MEDIUM']}' ELSE '{_A['LOW']}' END AS fraud_alert,
       CASE lvl WHEN 'HIGH' THEN '{_R['high_1']}|{_R['high_2']}|{_R['medium']}' WHEN 'MEDIUM' THEN '{_R['medium']}'
                ELSE '{_R['none']}' END AS recommendations
FROM l""")(_stream)
